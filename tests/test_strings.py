import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions.text import leading_int, run_length, truncate_bytes
from millrace.operators import strings
from millrace.plans.inspect import physical_nodes
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def trie(spark):
    notes = spark.createDataFrame([(1, "app"), (2, "apple"), (3, "app"), (4, "zzz"), (5, "")], "n int, note string")
    titles = spark.createDataFrame([(10, "applesauce"), (11, "apx"), (12, "zzz"), (13, "app")], "t int, title string")
    return titles, notes


@pytest.mark.parametrize(
    ("mode", "want"),
    [("shortest", [(10, 1), (10, 3), (12, 4), (13, 1), (13, 3)]), ("longest", [(10, 2), (12, 4), (13, 1), (13, 3)])],
)
def test_prefixes(trie, mode, want):
    out = strings.prefix_join(*trie, "t", "title", "note", mode).select("t", "n")
    assert sorted(map(tuple, out.collect())) == want


def test_notes_are_broadcast_only_if_small(trie):
    """The same rows either way; local relations have unknown sizes and are shuffled."""
    out = [strings.prefix_join(*trie, "t", "title", "note", "longest", most_broadcast=n) for n in (0, 1 << 70)]
    assert rows(out[0].select("t", "n")) == rows(out[1].select("t", "n"))
    assert "BroadcastHashJoin" in physical_nodes(out[1])


def test_mode_is_checked(trie):
    with pytest.raises(ValueError, match="mode"):
        strings.prefix_join(*trie, "t", "title", "note", "middle")


def test_duplicate_notes_are_kept(spark):
    notes = spark.createDataFrame([("a", "Don't"), ("b", "Don't"), ("a", "Don't")], "n string, note string")
    titles = spark.createDataFrame([(1, "Don't Be a Menace")], "t int, title string")
    assert rows(strings.prefix_join(titles, notes, "t", "title", "note").select("n")) == [("a",), ("a",), ("b",)]


def test_exact_lookup(spark):
    notes = spark.createDataFrame([("a", "apple"), ("b", "app"), ("c", "")], "n string, note string")
    probes = spark.createDataFrame([("apple",), ("app",), ("ap",), ("",)], "title string")
    assert rows(strings.exact_lookup(probes, notes, "title", "note").select("title", "n")) == [("app", "b"), ("apple", "a")]


def test_compressed_prefixes_differ(spark):
    notes = spark.createDataFrame([(1, "100"), (2, "10")], "n int, note string")
    titles = spark.createDataFrame([(1, "1000"), (2, "1" + "0" * 25)], "t int, title string")
    plain = strings.prefix_join(titles, notes, "t", "title", "note", "longest").select("t", "n")
    packed = strings.prefix_join(titles, notes, "t", "title", "note", "longest", compress=True).select("t", "n")
    assert sorted(map(tuple, plain.collect())) == [(1, 1), (2, 1)]
    assert sorted(map(tuple, packed.collect())) == [(1, 2), (2, 1)]  # 10*2 begins 10*25, not 10*3


def test_run_length(spark):
    want = {"": "", "abc": "abc", "1": "1", "1000": "10*3", "112233": "1*22*23*2"}
    df = spark.createDataFrame([(k,) for k in want], "x string").select("x", run_length(F.col("x")).alias("y"))
    assert dict(map(tuple, df.collect())) == want


def encoded(x: str) -> str:
    if not x.startswith("1"):
        return x
    out, i = "", 0
    while i < len(x):
        j = i
        while j < len(x) and x[j] == x[i]:
            j += 1
        out += x[i] + (f"*{j - i}" if j - i > 1 else "")
        i = j
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="1023a\n*", max_size=12).map(lambda s: "1" + s), min_size=1, max_size=20))
def test_run_length_property(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x string").select(run_length(F.col("x")))
    assert [r[0] for r in df.collect()] == [encoded(x) for x in xs]


def test_bounded_equality_and_bytes(spark):
    a = spark.createDataFrame([(1, "x" * 100 + "left"), (2, "short"), (3, "é" * 60)], "a int, s string")
    b = spark.createDataFrame([(1, "x" * 100 + "right"), (2, "short"), (3, "é" * 50), (4, None)], "b int, t string")
    assert rows(strings.bounded_equal_join(a, b, "s", "t").select("a", "b")) == [("1", "1"), ("2", "2"), ("3", "3")]
    cut = spark.createDataFrame([("aé",)], "s string").select(F.hex(truncate_bytes(F.col("s"), 2).cast("binary")))
    assert cut.first()[0] == "61C3"


def test_leading_int(spark):
    want = {"7": 7, " 8x": 8, "4abc": 4, "-3": -3, "+5": 5, "x": None, "": None, "99999999999": None}
    df = spark.createDataFrame([(k,) for k in want], "x string").select("x", leading_int(F.col("x")))
    assert dict(map(tuple, df.collect())) == want
