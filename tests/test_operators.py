import pytest
from helpers import rows
from pyspark.sql import functions as F

from millrace import metrics
from millrace.functions.bits import bit_at, bit_mask, radix_bits, radix_id
from millrace.operators import aggregates, joins, ordering, partitioning, sets, validate
from millrace.plans import scratch
from millrace.plans.session import session
from millrace.sources import datagen


def test_bits(spark):
    df = spark.createDataFrame([(0b1111,)], "k int")
    assert df.select(*[bit_at(F.col("k"), i) for i in range(5)]).first()[:] == (True, True, True, True, False)
    assert bit_mask(3) == 0b111
    assert [1 << radix_bits(t) for t in (1, 2, 4, 8, 16)] == [2, 2, 4, 8, 8]


def test_radix_partitions_are_spark_partitions(spark):
    out = partitioning.radix_partition(spark.range(100), "id", 2).withColumn("at", F.spark_partition_id())
    assert out.where("pid <> at").count() == 0
    assert out.where(F.col("pid") != radix_id(F.col("id"), 2)).count() == 0
    assert rows(partitioning.radix_histogram(spark.range(10), "id", 2)) == [("0", "3"), ("1", "3"), ("2", "2"), ("3", "2")]


@pytest.mark.parametrize(("n", "chunks"), [(10, 4), (1000, 7), (3, 5), (0, 2)])
def test_range_chunks_are_those_of_ntile(spark, n, chunks):
    from pyspark.sql import Window

    df = spark.range(n).select((F.col("id") * 7919 % 1009).alias("x"), "id")
    want = df.withColumn("chunk", F.ntile(chunks).over(Window.orderBy("x", "id")).cast("long"))
    assert rows(partitioning.range_chunk(df, ["x", "id"], chunks)) == rows(want)


@pytest.mark.parametrize("kind", ["int", "double", "decimal(12,3)", "date", "timestamp", "string", "boolean", "hot int", "hot string"])
def test_ranks_of_every_type_need_no_single_task(spark, kind):
    """Equal leading values, most of the rows in the last two, are split by the other columns."""
    lead = {"date": "date_add(date'2020-01-01', cast(id * 31 % 97 as int))", "timestamp": "timestamp_seconds(id * 31 % 97)", "boolean": "id % 3 = 0", "hot int": "cast(if(id % 10 < 9, 5, id) as int)", "hot string": "if(id % 10 < 9, 'same', cast(id as string))"}
    df = spark.range(2000).selectExpr(f"{lead.get(kind, f'cast(id * 31 % 97 as {kind})')} as x", "id * 7919 % 2003 as y").withColumn("x", F.when(F.col("y") % 50 != 0, F.col("x")))
    want = [tuple(r) for r in sorted(df.collect(), key=lambda r: (r.x is not None, r.x if r.x is not None else 0, r.y))]
    out = partitioning.ranked(df, ["x", "y"], "i")
    got = out.orderBy("i").collect()
    assert [r.i for r in got] == list(range(2000))
    assert [(r.x, r.y) for r in got] == want
    sizes = df.repartitionByRange("x", "y").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_where_chunks_end(spark):
    df = spark.range(10).select((F.col("id") * 7 % 10).alias("x"), F.lit("a").alias("of"), F.lit(0).alias("__rank"), F.lit(1).alias("__part"))

    def ends(**how):
        got = partitioning.range_chunk(df, ["x"], **how)
        assert got.columns == [*df.columns, "chunk"]
        return [r.chunk for r in got.orderBy("x").collect()]

    assert ends(chunks=3) == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert ends(size=4) == [1, 1, 1, 1, 2, 2, 2, 2, 3, 3]
    assert ends(size=10 // 4, chunks=4) == [1, 1, 2, 2, 3, 3, 4, 4, 4, 4]
    assert ends(size=0, chunks=12) == [12] * 10
    assert [partitioning.chunk_rows(*a) for a in ((10, 4), (10, 4, 2), (10, 4, 3), (3, 8), (3, 8, 100))] == [3, 2, 3, 1, 1]


def test_stored_tables_lie_in_the_shared_folder(spark, tmp_path, monkeypatch):
    assert scratch.shared_dir(spark) == scratch.shared_dir(spark)
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    df = scratch.stored(spark.range(5), "x")
    assert df.count() == 5
    assert [p.name[:2] for p in (tmp_path / "shared").iterdir()] == ["x-"]
    scratch.discard(df)
    assert list((tmp_path / "shared").iterdir()) == []


def test_a_cluster_without_a_shared_folder_raises():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {"spark.checkpoint.dir": "hdfs://host/dir/"}

    assert scratch.shared_dir(Session()) == "hdfs://host/dir"
    Session.conf = {}
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        Context.master = master
        with pytest.raises(RuntimeError, match="share"):
            scratch.shared_dir(Session())


def test_unused_names(spark):
    assert scratch.unused("id", spark.range(1), spark.range(1).toDF("ID_")) == "id__"


def test_aggregates(spark):
    empty = spark.createDataFrame([], "k int")
    assert aggregates.min_max(empty, "k").first()[:] == (None, None)
    assert aggregates.row_count(empty).first()[0] == 0
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("", 4)], "k string, p int")
    assert rows(aggregates.payloads(df, "k", "p")) == [("a", "[1, 2]"), ("b", "[3]")]


def test_orders(spark):
    df = spark.createDataFrame([("b", 1), ("é", 2), ("a", 3)], "k string, i int")
    assert [r.i for r in ordering.total_order(df).collect()] == [3, 1, 2]
    assert [r.i for r in ordering.by_key(df, "k").collect()] == [3, 1, 2]
    assert {r.i: r.at for r in ordering.by_key(df, "k", position="at").collect()} == {3: 0, 1: 1, 2: 2}
    assert [r.i for r in ordering.first_n(df, 2, "i").collect()] == [1, 2]


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert rows(sets.except_all(a, b)) == [("1",), ("2",)]
    assert sets.gathered(a, b, a).count() == 8


def test_checker(spark):
    cast, title = datagen.uniform_cast_info(spark, 300, high=51), datagen.title(spark, 50)
    want = joins.equi_join(cast, title, "movie_id", "title_id", "nested_loop")
    got = joins.equi_join(cast, title, "movie_id", "title_id", "merge")
    assert want.count() == 300
    assert validate.check_result(got, want).first()[:] == (300, 0, 0, 0)
    bad = got.where("cast_info_id > 10").unionByName(got.where("cast_info_id = 20")).withColumn("note", F.when(F.col("cast_info_id") == 30, "x").otherwise(F.col("note")))
    assert validate.check_result(bad, want).first()[:] == (290, 1, 1, 10)
    moved = got.withColumn("movie_id", F.lit(-1))
    assert validate.check_result(moved, want).first().correct == 300
    assert validate.check_result(moved, want, ignore=()).first().wrong == 300


def test_timer(monkeypatch):
    now = iter([0, 3, 5, 9, 10, 14])
    monkeypatch.setattr(metrics.time, "perf_counter", lambda: next(now))
    t = metrics.Timer().start()
    assert t.snapshot("a") == 3
    t.pause().start()  # 5 to 9 doesn't count
    assert t.snapshot("b") == 3
    other = metrics.Timer()
    other.total = 2.0
    t.pause().merge(other)
    assert t.seconds == 12
    assert str(t) == "a 3000 ms, b 3000 ms, total 12000 ms"


def test_session_keeps_the_running_one(spark):
    assert session().sparkContext is spark.sparkContext
