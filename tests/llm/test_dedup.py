import hashlib
import math
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import common, simhash
from millrace.llm.common import components, joined, numbered
from millrace.llm.exact import chunks, drop_exact_duplicates, exact_duplicates, normalised


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


def expected_groups(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[norm(t)].append(i)
    return groups


# --- components and numbering


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, j) for j in range(2001, 2100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_are_written_in_few_files(spark, monkeypatch):
    """Each file costs processes on a local file system."""
    tables, drop = [], common.discard

    def counted(df):
        tables.append(len(df.inputFiles()))
        drop(df)

    monkeypatch.setattr(common, "discard", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1 + i % 3) for i in range(400)], "a long, b long")
        assert components(edges).count() == 402
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tables) > 2 and set(tables[1:]) == {1}


def test_numbers_have_no_gaps(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") % 1000).alias("v"))
    got = numbered(df, ["k"], ["v"], "i", 5000).groupBy("k").agg(F.count("i").alias("n"), F.countDistinct("i").alias("d"), F.max("i").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in got)


# --- exact


def test_exact_on_the_table(docs, texts):
    groups = expected_groups(texts.items())
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(docs).collect()}
    assert got == want


@pytest.mark.parametrize("collide", [False, True])
def test_exact_on_odd_rows(odd_docs, collide):
    """Colliding chunk hashes are told apart by their texts."""
    out = exact_duplicates(odd_docs, lambda c: F.length(c) % 2) if collide else exact_duplicates(odd_docs)
    got = out.collect()
    assert len(got) == odd_docs.count()
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    for t, g in expected_groups(rows).items():
        own = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
        ids = [i for i in g if i is not None]
        assert len(own) == len(g)
        assert {r.group_size for r in own} == {len(g)}
        assert sum(r.kept for r in own) == 1
        assert {r.keep_id for r in own} == {min(ids) if ids else None}
    kept = drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r.kept for r in got)


def test_any_number_of_collisions(spark, docs, texts):
    """All chunks of the table under seven hashes."""
    groups = expected_groups(texts.items())
    got = exact_duplicates(docs, lambda c: F.pmod(F.xxhash64(c), F.lit(7))).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: (min(g), len(g)) for g in groups.values() for i in g}


CLASHES = ["__key", "__id", "__h1", "__h2", "__id_of", "__base", "__source", "__copy", "__threshold", "__hot", "row", "h1", "first", "kept", "n", "recipe", "keep_id", "TEXT_KEY"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Rows of one doc_id and different texts, repeated rows, and columns with names that operators use."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(0, long), (1, long + " end"), (1, "quite another text of seven words here"), (1, None), (2, " "), (3, "a b"), (3, "a  b"), (4, "x y"), (4, "x y"), (None, "x y"), (None, "no id"), (None, None)]
    rows += [(100 + i, f"text number {i} with words of its own w{i} v{i}") for i in range(30)]
    extra = [(i, t, "s", *[f"{k}{c}" for c in CLASHES]) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))


def test_no_row_is_lost_to_a_shared_doc_id_or_a_column_name(clashing):
    rows = [tuple(r) for r in clashing.collect()]
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    out = drop_exact_duplicates(clashing)
    assert out.columns == clashing.columns
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(groups)
    assert set(got) <= set(rows)  # whole rows, as they came
    for t, g in groups.items():
        own = [r for r in got if norm(r[1]) == t]
        assert len(own) == 1
        ids = [r[0] for r in g if r[0] is not None]
        assert own[0][0] == (min(ids) if ids else None)

    out = simhash.drop_near_duplicates(clashing)
    assert out.columns == clashing.columns
    near = [tuple(r) for r in out.collect()]
    assert set(near) <= set(rows)
    # Linked: 0 and 1 with a word more, repeats of x y, the two spellings of a b, null texts; blanks alone have no words.
    assert sorted((str(r[0]), str(r[1])) for r in near if r[0] is None or r[0] < 100) == sorted(
        [("0", rows[0][1]), ("1", rows[2][1]), ("1", "None"), ("2", " "), ("3", next(r[1] for r in near if r[0] == 3)), ("4", "x y"), ("None", "no id")]
    )
    assert sum(r[0] is not None and r[0] >= 100 for r in near) == 30


def test_rows_are_shuffled_if_the_list_of_keys_is_long(clashing, monkeypatch):
    from millrace.llm import common

    want = sorted(map(str, drop_exact_duplicates(clashing).select("doc_id", "text").collect()))
    monkeypatch.setattr(common, "MOST_KEYS", 0)
    assert sorted(map(str, drop_exact_duplicates(clashing).select("doc_id", "text").collect())) == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_groups_are_joined_like_others(spark, how):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 99, i) for i in range(900)] + [(None, -1), (55, -2)], "k int, i int")
    groups = rows.where("k < 50 or k = 99").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got, want = joined(rows, groups, ["k"], "n", 902, how), rows.join(groups, "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.columns == want.columns


def test_exact_on_no_rows(no_docs):
    assert exact_duplicates(no_docs).count() == 0


def test_chunks_are_the_text_and_find_their_places_again(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text = " ".join(words)
    changed = "another beginning " + text
    df = spark.createDataFrame([(text,), (changed,), ("x" * 10_000,)], "t string").select("t", chunks(normalised(F.col("t"))).alias("c"))
    a, b, c = df.collect()
    assert all("".join(r.c) == r.t for r in (a, b, c))
    assert len(a.c) > 5
    assert len(set(a.c) & set(b.c)) >= 0.9 * len(a.c)
    assert max(map(len, c.c)) <= 2048


# --- SimHash


def bits_of(text, k):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, radius):
    ids = sorted(fps, key=lambda i: (i is None, i))
    parent = {i: i for i in range(len(ids))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    v = np.array([fps[i] for i in ids], dtype=np.uint64)
    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(v[a + 1 :] ^ v[a]) <= radius) + a + 1:
            x, y = find(a), find(int(b))
            parent[max(x, y)] = min(x, y)
    return {i: ids[find(k)] for k, i in enumerate(ids)}


def test_simhash_on_the_table(docs, texts):
    fps = {i: bits_of(t, 3) for i, t in texts.items()}
    got = simhash.simhash_components(docs).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == linked(fps, 2)


def test_hashes_are_those_of_the_engine(spark):
    got = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % 2**64 == int(simhash.shingle_hashes("One two\tTHREE", 3)[0])


def test_simhash_on_odd_rows(odd_docs, no_docs):
    got = simhash.simhash_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    zero = [r for r in got if r.fp == 0]
    assert {r.component_id for r in zero} == {4}
    assert sorted((r.doc_id for r in zero), key=str) == sorted([4, 5, 9, None], key=str)
    assert simhash.simhash_components(no_docs).count() == 0


def groups_of(spark, fps):
    """Components by links and by brute force, as sorted lists of fingerprints."""
    want, groups, mine = linked({x: x for x in fps}, 2), defaultdict(set), defaultdict(set)
    links = simhash.fingerprint_links(spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long"), 2)
    comps = {r.node % 2**64: r.component % 2**64 for r in components(links).collect()}
    for x in fps:
        groups[want[x]].add(x)
        mine[comps.get(x, x)].add(x)
    return sorted(map(sorted, mine.values())), sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("least", [None, (0, 1), (1, 0), (2,), (1, -1, 0)])
@pytest.mark.parametrize("paired", [2, 1024])
def test_links_in_hot_buckets(spark, monkeypatch, paired, least):
    """A ball of fingerprints around one, linked by pairs and by midpoints, whatever thresholds the parts have."""
    monkeypatch.setattr(simhash, "MOST_PAIRED", paired)
    if least:
        cut = np.linspace(0, 64, len(least) + 1).astype(int)
        monkeypatch.setattr(simhash, "plan_parts", lambda *_: [simhash.Part(tuple(range(a, b)), t) for a, b, t in zip(cut, cut[1:], least, strict=False) if t >= 0])
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base[:5] for _ in range(40)]
    near += [n ^ (1 << rng.randrange(64)) for n in near[:60]]
    mine, want = groups_of(spark, set(base + near))
    if least != (1, -1, 0):  # two parts of these cover no radius of 2; the rest does
        assert mine == want


def test_a_bucket_beyond_the_limit_of_pairs(spark):
    """4,000 fingerprints that share half of their bits meet in a bucket of more than MOST_PAIRED; which of them link, pairs say."""
    rng = random.Random(21)
    top = rng.getrandbits(32) << 32
    fps = {top | rng.getrandbits(32) for _ in range(2500)}
    for x in list(fps)[:300]:
        for _ in range(5):
            fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(32)))
    assert len(fps) > 3 * simhash.MOST_PAIRED
    mine, want = groups_of(spark, fps)
    assert mine == want
    assert max(map(len, want)) > 2


@pytest.mark.parametrize("radius", [2, 3, 6, 14])
def test_parts_cover_the_bits_and_the_radius(spark, radius):
    rng = np.random.default_rng(1)
    fps = rng.integers(-(2**63), 2**63 - 1, 2000)
    n, both = simhash.bit_counts(spark.createDataFrame([(int(x),) for x in fps], "fp long"))
    assert n == 2000
    parts = simhash.plan_parts(n, both, radius)
    assert sum(p.threshold + 1 for p in parts) == radius + 1
    bits = [b for p in parts for b in p.bits]
    assert len(bits) == len(set(bits))
    for _ in range(200):
        a = int(rng.integers(0, 2**63))
        b = a
        for k in rng.choice(64, radius, replace=False):
            b ^= 1 << int(k)
        assert any((bin((a ^ b) & (p.mask % 2**64))).count("1") <= p.threshold for p in parts)


def test_near_duplicates_against_all_pairs(spark, docs, texts):
    """Copies with up to four words changed: every pair of the similarity is expected, whatever the fingerprints."""
    rows = {i: t for i, t in texts.items()}
    rng = random.Random(11)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(200)) for _ in range(6)]
    for k, t in enumerate(base):
        for j in range(5):
            w = t.split()
            for _ in range(j):
                w[rng.randrange(200)] = f"changed{rng.randrange(99)}"
            rows[10_000 + 10 * k + j] = " ".join(w)
    first = {}
    for i in sorted(rows):
        first.setdefault(norm(rows[i]), i)
    rows = {i: rows[i] for i in first.values()}
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            few, many = sorted((len(sets[a]), len(sets[b])))
            if few >= 0.8 * many > 0 and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, t) for i, t in rows.items()], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in simhash.near_duplicates(df).collect()}
    want = {i: (find(i), find(i) == i) for i in rows}
    assert sum(not k for _, k in want.values()) >= 20
    assert got == want


def test_near_duplicates_against_every_pair(spark, texts):
    """Every pair of the similarity is expected, whatever the fingerprints and sizes."""
    rng, rows = random.Random(19), dict(texts)
    for k in range(6):
        t = [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range((30, 45, 60, 200, 500, 1500)[k])]
        for j in range(6):
            rows[10_000 + 10 * k + j] = " ".join(t)
            for _ in range(len(t) // 100 + 1):
                t[rng.randrange(len(t))] = f"changed{rng.randrange(99)}"
            t += t[5:17] * j
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids, linked = sorted(i for i in rows if sets[i]), 0
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            few, many = sorted((len(sets[a]), len(sets[b])))
            both = len(sets[a] & sets[b]) if few >= 0.8 * many else 0
            if both and 10 * both >= 8 * (few + many - both):
                linked += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert linked >= 30
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (find(i), find(i) == i) for i in rows}


def test_parities_of_sets():
    """They never say more than sets differ, and tell far sets apart."""
    rng = np.random.default_rng(8)

    def apart(a, b):
        return int(np.bitwise_count((simhash.parities(a) ^ simhash.parities(b)).view(np.uint64)).sum())

    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 2000)), dtype=np.uint64))
        out = len(a) // 9
        b = np.unique(np.append(a[out:], rng.integers(0, 2**64, out, dtype=np.uint64)))  # a similarity of about 0.8
        assert apart(a, b) <= len(np.setxor1d(a, b))
    far = [np.unique(rng.integers(0, 2**64, 150, dtype=np.uint64)) for _ in range(100)]
    assert all(apart(x, y) > 300 / 9 for x, y in zip(far, far[1:], strict=False))


def test_sketches_of_sets():
    """They never say more than sets differ, whatever their sizes, and tell sets of a similarity of 0.72 from similar ones where 256 parities don't."""
    rng = np.random.default_rng(9)

    def numbers(n):
        return np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))

    for _ in range(300):
        a = numbers(int(rng.integers(1, 3000)))
        b = np.unique(np.append(a[int(rng.integers(0, len(a))) :], numbers(int(rng.integers(0, 3000)))))
        assert simhash.least_apart(simhash.sketch(a), simhash.sketch(b)) <= len(np.setxor1d(a, b))
    assert simhash.least_apart(simhash.sketch(a[:0]), simhash.sketch(a)) <= len(a)
    for n in (500, 1800, 2048, 5000):
        a = numbers(n)
        b = np.unique(np.append(a[n * 4 // 25 :], numbers(n * 4 // 25)))
        most = simhash.most_apart(0.8, len(a) + len(b))
        assert simhash.least_apart(simhash.sketch(a), simhash.sketch(b)) > most
        assert int(np.bitwise_count((simhash.parities(a) ^ simhash.parities(b)).view(np.uint64)).sum()) <= most


def test_whole_sets_are_moved_only_for_pairs_near_the_similarity(spark, monkeypatch):
    """Texts of 1,500 words in families whose members have a similarity of about 0.7, and one pair of near copies in each."""
    rng, rows, counts, write = random.Random(5), [], defaultdict(int), simhash.stored

    def changed(words, n):
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = f"c{rng.randrange(10**9)}"
        return out

    for f in range(4):
        base = [f"f{f}w{i}" for i in range(1500)]
        members = [changed(base, 30) for _ in range(8)]
        rows += [" ".join(m) for m in [*members, changed(members[-1], 5)]]

    def counted(df, name):
        out = write(df, name)
        counts[name] += out.count()
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in rows]
    pairs = [(j, i) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.keep_id for r in simhash.near_duplicates(df).collect()}
    up = {i: min([j for j, k in pairs if k == i], default=i) for i in range(len(rows))}
    assert len(pairs) >= 4 and all(got[j] == got[i] for j, i in pairs)
    assert {i for i in got if got[i] == i} == {i for i in up if up[i] == i}
    assert counts["links"] <= counts["sifted"] < counts["candidates"] / 2


def test_groups_that_are_not_similar_make_few_rows_in_hot_buckets(spark):
    """300 texts of six of twelve passages each, no two of a similarity over 0.72: the join of members makes no row for each bucket of the 44,850 pairs."""
    passages = [" ".join(f"p{i}w{j}" for j in range(25)) for i in range(12)]
    rows = [" and and and and ".join(passages[i] for i in x) for x in random.Random(4).sample(list(combinations(range(12), 6)), 300)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert all(r.kept for r in simhash.near_duplicates(df).collect())
    made = []
    runs = store.executionsList()
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if "Join" in node.name() and re.search(r"\[key#\w+, g2#", node.desc()):  # of members, after groups have been paired
                metrics = map(node.metrics().apply, range(node.metrics().size()))
                found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                made += [int(x.get().replace(",", "")) for x in found if x.isDefined()]
    assert made and max(made) < 30_000


def test_a_large_group_of_near_copies_and_a_line_that_all_texts_share(spark):
    """Hot buckets: 300 copies of one text, each with a word changed, and 200 other texts, all with the same line."""
    rng, line, rows = random.Random(3), " ".join(f"line{i}" for i in range(12)), []
    one = [f"o{i}" for i in range(120)]
    for _ in range(300):
        w = list(one)
        w[rng.randrange(120)] = f"c{rng.randrange(10**6)}"
        rows.append(" ".join(w) + " " + line)
    rows += [" ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) + " " + line for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in simhash.near_duplicates(df).collect()}
    assert got == {i: 0 if i < 300 else i for i in range(500)}


def test_repeats_and_rows_without_an_id_link_by_their_texts(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(7, long), (None, long + " more"), (7, long), (None, long), (9, "else " * 3), (None, None), (3, None), (4, "")]
    got = sorted(map(str, simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = [(7, 7, True), (None, 7, False), (7, 7, False), (None, 7, False), (9, 9, True), (None, 3, False), (3, 3, True), (4, 3, False)]
    assert got == sorted(f"Row(doc_id={a}, keep_id={b}, kept={c})" for a, b, c in want)


@pytest.mark.parametrize("words", [9, 14, 19, 29])
def test_pairs_right_at_the_similarity_are_linked(spark, words):
    """The shorter text has four fifths of the longer one's shingles."""
    long = [f"w{i}" for i in range(words)]
    short = long[: 4 + 4 * (words - 4) // 5]
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(short[:-1])[::-1])], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_every_size_of_sets_has_heads_that_meet():
    rng = np.random.default_rng(12)
    common = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    rank = rng.permutation(len(common)) + 1
    for n in (1, 41, 45, 50, 100, 1000):
        for _ in range(50):
            a = np.unique(np.append(rng.choice(common, min(n // 2, 200), replace=False), rng.integers(0, 2**64, n - n // 2, dtype=np.uint64)))
            b = rng.permutation(a)[: math.ceil(0.8 * len(a))]
            assert set(simhash.head(a, 0.8, common, rank)) & set(simhash.head(np.sort(b), 0.8, common, rank))


def test_pairs_whose_fingerprints_lie_apart_are_linked(spark):
    """Similar sets of 41 and more shingles, each pair further apart than 14 bits, and a line that is in all texts."""
    rng, rows = random.Random(17), []
    line = [f"l{i}" for i in range(30)]
    while len(rows) < 40:
        n = rng.choice([41, 60, 120, 400])
        long = [f"w{rng.randrange(10**6)}" for _ in range(n)] + line
        short = long[: 4 + math.ceil(0.8 * (len(long) - 4))]
        a, b = (np.unique(simhash.shingle_hashes(" ".join(w), 5)) for w in (long, short))
        if ((simhash.fingerprint(a) ^ simhash.fingerprint(b)) % 2**64).bit_count() > 14:
            rows += [(len(rows), " ".join(long)), (len(rows) + 1, " ".join(short))]
    got = {r.doc_id: r.keep_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_repeats_of_a_line_do_not_part_near_duplicates(spark):
    """Texts that differ only in how often a line occurs."""
    rng = random.Random(13)
    rows = []
    for k in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + words[:12] * 30))]
    got = {r.doc_id: r.keep_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_near_duplicates_on_odd_rows(odd_docs, no_docs):
    unique = drop_exact_duplicates(odd_docs)
    out = simhash.drop_near_duplicates(unique)
    assert out.columns == odd_docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(None) == unique.where("doc_id is null").count()
    assert 3 not in ids  # lower case apart, equal to 1
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.drop_near_duplicates(no_docs).count() == 0
