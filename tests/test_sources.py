import math

import pytest
from helpers import rows
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from millrace.operators import aggregates, strings
from millrace.sources import csv_source, datagen, sinks
from millrace.sources.schemas import CAST_INFO, TITLE, Field

THREE = (Field("a", "a"), Field("b", "b", 5), Field("c", "c", 5))


@pytest.fixture
def malformed(tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('h,h,h\n1,x,2\n2,y\n3,z,4,5\n4abc,q,7\n5,"h,i",8\n6,k,\n')
    return str(path)


def test_malformed_rows_are_skipped_and_told(spark, malformed):
    got = csv_source.load(spark, malformed, THREE)
    assert rows(got.rows) == [("1", "x", "2"), ("4", "q", "7")]
    assert got.rows.count() == 2
    assert rows(got.rejected) == [("2,y",), ("3,z,4,5",), ('5,"h,i",8',), ("6,k,",)]


def test_strict_mode_fails(spark, malformed):
    with pytest.raises(PySparkException):
        csv_source.load(spark, malformed, THREE, strict=True).rows.collect()


def test_missing_file(spark, tmp_path):
    assert csv_source.load(spark, str(tmp_path / "no"), THREE, missing="empty").rows.count() == 0
    with pytest.raises(AnalysisException):
        csv_source.load(spark, str(tmp_path / "no"), THREE)


def test_raw_scans(spark, malformed):
    assert csv_source.raw_lines(spark, malformed).count() == 7
    block = csv_source.raw_blocks(spark, malformed).first()
    assert block.length == len(block.content)


@pytest.mark.parametrize("kind", ["Uniform", "Zipfian", "Title", "MatchRate"])
def test_round_trip_through_csv(spark, tmp_path, kind):
    made = datagen.generate(spark, kind, n=50)
    sinks.write_csv(made, str(tmp_path / "out"), one_file=True)
    load, key = (csv_source.load_title, "title_id") if kind == "Title" else (csv_source.load_cast_info, "cast_info_id")
    assert rows(load(spark, str(tmp_path / "out"))) == rows(made)
    assert rows(load(spark, str(tmp_path / "out"), limit=3).select(key)) == [("1",), ("2",), ("3",)]
    assert load(spark, str(tmp_path / "out"), limit=0).count() == 1


def test_values_do_not_depend_on_partitions(spark):
    once = rows(datagen.uniform_cast_info(spark, 200))
    assert once == rows(datagen.uniform_cast_info(spark, 200).repartition(7))
    assert once != rows(datagen.uniform_cast_info(spark, 200, seed=1))


def test_uniform_keys(spark):
    df = datagen.uniform_cast_info(spark, 20_000)
    r = df.agg(F.min("movie_id").alias("lo"), F.max("movie_id").alias("hi"), F.min(F.length("note")), F.max(F.length("note"))).first()
    assert (r.lo, r.hi, r[2], r[3]) == (1, 1000, 100, 100)
    assert abs(aggregates.skewness(df, "movie_id").first()[0]) < 0.25
    assert df.where(~F.col("note").rlike("^[a-z]+$")).count() == 0


def test_zipf_keys(spark):
    df = datagen.zipf_cast_info(spark, 20_000)
    assert df.columns == [f.name for f in CAST_INFO]
    assert df.count() == 20_000
    assert aggregates.skewness(df, "movie_id").first()[0] >= 2
    share = {r.movie_id: r.share for r in aggregates.frequencies(df, "movie_id").collect()}
    total = sum(v**-2.0 for v in range(1, 1002))
    assert all(abs(share[v] - v**-2.0 / total) < 0.02 for v in (1, 2, 3))
    assert max(share) <= 1001
    with pytest.raises(ValueError, match="above"):
        datagen.zipf_cast_info(spark, 10, low=0)


@pytest.mark.parametrize("rate", [0.0, 0.25, 0.999, 1.0])
def test_match_rate_is_exact(spark, rate):
    df = datagen.match_rate_cast_info(spark, 1000, rate)
    assert df.where("movie_id = 2001").count() == math.floor(1000 * (1 - rate))
    with pytest.raises(ValueError, match="rate"):
        datagen.match_rate_cast_info(spark, 10, 100)


def test_titles_and_names(spark):
    assert datagen.title(spark, 30).agg(F.countDistinct("title_id")).first()[0] == 30
    assert datagen.title(spark, 3).columns == [f.name for f in TITLE]
    with pytest.raises(NotImplementedError):
        datagen.generate(spark, "Sorted", n=1)
    assert [datagen.rows_for(x << 20, r) for x, r in ((1, "cast_info"), (1, "title"), (512, "cast_info"), (1024, "title"))] == [8457, 3257, 4329605, 3334602]


def test_command_line(spark, tmp_path):
    datagen.main(["Uniform", str(tmp_path / "u"), "--rows", "7", "--max", "3"])
    got = csv_source.load_cast_info(spark, str(tmp_path / "u"))
    assert got.count() == 7
    assert {r.movie_id for r in got.select("movie_id").collect()} <= {1, 2}
    datagen.main(["Title", str(tmp_path / "t"), "--bytes", str(322 * 4), "--one-file"])
    assert csv_source.load_title(spark, str(tmp_path / "t")).count() == 4
    datagen.main(["Strings", str(tmp_path / "s"), "--rows", "3"])
    assert csv_source.load_title(spark, str(tmp_path / "s" / "title")).count() == 3


def test_string_tables_match_row_by_row(spark):
    notes, titles = datagen.string_tables(spark, 40)
    out = strings.prefix_join(titles, notes, "title_id", "title", "note").select("title_id", "cast_info_id", F.length("note").alias("n"))
    assert sorted(map(tuple, out.collect())) == [(i, i, 60) for i in range(1, 41)]


def test_one_note_is_a_prefix_of_one_title(spark, tmp_path):
    note, other = "n" * 100, "o" * 200
    (tmp_path / "c.csv").write_text(f"id,person_id,movie_id,person_role_id,last_title,nr_order,role_id\n1,1,1,1,{note},1,1\n")
    # The header lines of the two relations.
    t = "id,title,imdb_index,kind_id,production_year,imdb_id,phonetic_code,episode_of_id,season_nr,episode_nr,series_years,md5sum\n"
    t += "".join(f"{i},{x},a,1,1,1,p,1,1,1,y,m\n" for i, x in ((1, other), (2, note + "m" * 100)))
    (tmp_path / "t.csv").write_text(t)
    notes, titles = csv_source.load_cast_info(spark, str(tmp_path / "c.csv")), csv_source.load_title(spark, str(tmp_path / "t.csv"))
    assert rows(strings.prefix_join(titles, notes, "title_id", "title", "note").select("title_id", "cast_info_id")) == [("2", "1")]


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b,c", 3)], "i int, s string, n int")
    assert rows(sinks.as_text(df)) == [("1,a,",), ("2,b,c,3",)]  # a null is an empty field
    assert sinks.printable(df).count() == 2
    assert sinks.printable(df, most=2).count() == 0
    lines = spark.createDataFrame([("aaa",), ("b",), ("cc",), ("dddd",)], "value string")
    assert rows(sinks.lines_between(lines, 2, 3, 5)) == [("aaa",), ("cc",)]


def test_lines_keep_the_order_of_the_file(spark, tmp_path):
    want = [f"line {i * 7919 % 1000}" for i in range(3000)]
    (tmp_path / "l.txt").write_text("\n".join(want) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = csv_source.raw_lines(spark, str(tmp_path / "l.txt"), position=True)
        assert got.rdd.getNumPartitions() > 2
        assert [r.value for r in sinks.lines_between(got, 8, 8, 900, *csv_source.POSITION).collect()] == [x for x in want if len(x) == 8][:900]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_written_as_they_are(spark, tmp_path):
    lines = ['a,"b",c', "x", "' y '"]
    sinks.write_lines(spark.createDataFrame([(x,) for x in lines], "value string"), str(tmp_path / "o"), "h,h", one_file=True)
    assert [r.value for r in csv_source.raw_lines(spark, str(tmp_path / "o")).collect()] == ["h,h", *lines]


def test_real_columns(spark, tmp_path):
    fields = (Field("id", "id"), Field("x", "x", real=True), Field("t", "t", 3))
    made = datagen.filled(spark, 40, fields, 42, 1, 5)
    assert [t for _, t in made.dtypes] == ["int", "float", "string"]
    assert made.where("x < 1 or x > 5").count() == 0
    assert made.select("x").distinct().count() > 30
    sinks.write_csv(made, str(tmp_path / "o"))
    assert rows(csv_source.load(spark, str(tmp_path / "o"), fields).rows) == rows(made)


def test_rows_without_a_match_are_random(spark):
    got = [r[0] for r in datagen.match_rate_cast_info(spark, 1000, 0.5).where("movie_id = 2001").select("cast_info_id").orderBy("cast_info_id").collect()]
    gaps = {b - a for a, b in zip(got, got[1:], strict=False)}
    assert len(gaps) > 4  # no regular stride
    assert abs(sum(got) / len(got) - 500) < 60
    other = {r[0] for r in datagen.match_rate_cast_info(spark, 1000, 0.5, seed=1).where("movie_id = 2001").select("cast_info_id").collect()}
    assert 150 < len(other & set(got)) < 350


@pytest.mark.parametrize(("n", "k"), [(1000, 1), (1000, 1000), (3000, 1234)])
def test_smallest_hashes_are_found_in_steps(spark, n, k):
    want = sorted((r.h, r.row) for r in spark.range(1, n + 1).select(datagen.lot(7, F.col("id")).alias("h"), F.col("id").alias("row")).collect())
    assert datagen.smallest(spark, n, k, 7, cells=4, few=5) == want[k - 1]


def test_ids_have_32_bits(spark):
    with pytest.raises(ValueError, match="32 bits"):
        datagen.title(spark, 1 << 31)
