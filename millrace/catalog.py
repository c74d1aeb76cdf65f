"""Registered queries over the driver's tables, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.bits import bit_at, radix_bits, radix_id
from millrace.functions import text
from millrace.operators import aggregates, joins, ordering, partitioning, sets, strings, validate
from millrace.plans.scratch import fresh_dir
from millrace.sources import csv_source, datagen, schemas, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Partitions of the radix queries come from this many threads.
THREADS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# --- joins on integer keys

FACT = "select l_orderkey, l_linenumber, l_quantity, p_partkey, p_name from lineitem join part on l_partkey = p_partkey"


def fact_join(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    left = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    right = table(spark, d, "part").select("p_partkey", "p_name")
    out = joins.equi_join(left, right, "l_partkey", "p_partkey", strategy, threads=THREADS)
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "p_partkey", "p_name")


@registered(FACT)
def join_broadcast(spark: SparkSession, d: str) -> DataFrame:
    return fact_join(spark, d, "broadcast")


@registered(FACT)
def join_shuffle_hash(spark: SparkSession, d: str) -> DataFrame:
    return fact_join(spark, d, "shuffle_hash")


@registered(FACT)
def join_merge(spark: SparkSession, d: str) -> DataFrame:
    return fact_join(spark, d, "merge")


@registered(FACT)
def join_auto(spark: SparkSession, d: str) -> DataFrame:
    return fact_join(spark, d, "auto")


@registered(FACT)
def join_radix(spark: SparkSession, d: str) -> DataFrame:
    return fact_join(spark, d, "radix")


@registered("select c_custkey, n_name from customer, nation where c_nationkey = n_nationkey")
def join_nested_loop(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    right = table(spark, d, "nation").select("n_nationkey", "n_name")
    return joins.equi_join(left, right, "c_nationkey", "n_nationkey", "nested_loop").select("c_custkey", "n_name")


def supplier_customer(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")


WINS = """select s_suppkey, c_custkey, c_name from supplier join (select * from customer
    qualify row_number() over (partition by c_nationkey order by c_custkey{}) = 1) on s_nationkey = c_nationkey"""


@registered(WINS.format(""))
def join_first_wins(spark: SparkSession, d: str) -> DataFrame:
    a, b = supplier_customer(spark, d)
    out = joins.equi_join(a, b, "s_nationkey", "c_nationkey", "broadcast", "first", ["c_custkey"])
    return out.select("s_suppkey", "c_custkey", "c_name")


@registered(WINS.format(" desc"))
def join_last_wins(spark: SparkSession, d: str) -> DataFrame:
    a, b = supplier_customer(spark, d)
    out = joins.equi_join(a, b, "s_nationkey", "c_nationkey", "broadcast", "last", ["c_custkey"])
    return out.select("s_suppkey", "c_custkey", "c_name")


@registered(
    """select s_suppkey, c_custkey, c_name from supplier join (select * from (select *, ntile(4) over (order by c_custkey) as chunk from customer)
    qualify row_number() over (partition by chunk, c_nationkey order by c_custkey desc) = 1) on s_nationkey = c_nationkey"""
)
def join_chunked_build(spark: SparkSession, d: str) -> DataFrame:
    a, b = supplier_customer(spark, d)
    return joins.chunked_build_join(a, b, "s_nationkey", "c_nationkey", ["c_custkey"], 4).select("s_suppkey", "c_custkey", "c_name")


@registered(
    """select s_suppkey, c_custkey
    from (select *, row_number() over (partition by s_nationkey order by s_suppkey) as rn from supplier) as a
    join (select *, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer) as b
    on a.s_nationkey = b.c_nationkey and a.rn = b.rn"""
)
def join_zip(spark: SparkSession, d: str) -> DataFrame:
    a, b = supplier_customer(spark, d)
    return joins.zip_join(a, b, "s_nationkey", "c_nationkey", ["s_suppkey"], ["c_custkey"]).select("s_suppkey", "c_custkey")


@registered(
    """select chunk, s_suppkey, c_custkey
    from (select *, row_number() over (partition by chunk, s_nationkey order by s_suppkey) as rn
        from (select *, ntile(4) over (order by s_nationkey, s_suppkey) as chunk from supplier)) as a
    join (select *, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer) as b
    on a.s_nationkey = b.c_nationkey and a.rn = b.rn"""
)
def join_zip_chunked(spark: SparkSession, d: str) -> DataFrame:
    a, b = supplier_customer(spark, d)
    out = joins.zip_join_chunked(a, b, "s_nationkey", "c_nationkey", ["s_suppkey"], ["c_custkey"], 4)
    return out.select("chunk", "s_suppkey", "c_custkey")


@registered("select o_orderkey, p_name from orders join part on o_orderkey = p_partkey")
def join_range_pruned(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "part").select("p_partkey", "p_name")
    return joins.range_pruned_join(a, b, "o_orderkey", "p_partkey").select("o_orderkey", "p_name")


CHUNK_WINS = """select s_suppkey, c_custkey, c_name from supplier join (select * from (
    select *, {} as chunk from (select *, row_number() over (order by c_custkey) - 1 as r, count(*) over () as n from customer))
    qualify row_number() over (partition by chunk, c_nationkey order by c_custkey desc) = 1) on s_nationkey = c_nationkey"""


def chunk_join(spark: SparkSession, d: str, size: Callable[[int], int], chunks: int | None = None) -> DataFrame:
    a, b = supplier_customer(spark, d)
    out = joins.chunked_build_join(a, b, "s_nationkey", "c_nationkey", ["c_custkey"], chunks, size(b.count()))
    return out.select("s_suppkey", "c_custkey", "c_name")


@registered(CHUNK_WINS.format("r // (n // 8 + 1)"))
def join_chunk_by_threads(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of n / 8 + 1 rows."""
    return chunk_join(spark, d, lambda n: partitioning.chunk_rows(n, THREADS))


@registered(CHUNK_WINS.format("r // case when 50 <= n // 2 then 50 else n // 2 + 1 end"))
def join_chunk_by_size(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of what a cache is said to hold, 50 rows, unless two threads would get fewer."""
    return chunk_join(spark, d, lambda n: partitioning.chunk_rows(n, 2, 50))


@registered(CHUNK_WINS.format("least(r // (n // 8), 7)"))
def join_chunk_last_larger(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of n / 8 rows, of which the eighth takes what is left."""
    return chunk_join(spark, d, lambda n: n // THREADS, THREADS)


@registered(WINS.format(""))
def join_radix_first_wins(spark: SparkSession, d: str) -> DataFrame:
    a, b = supplier_customer(spark, d)
    out = joins.equi_join(a, b, "s_nationkey", "c_nationkey", "radix", "first", ["c_custkey"], THREADS)
    return out.select("s_suppkey", "c_custkey", "c_name")


@registered(
    f"""select unnest([{", ".join(f"'{x}'" for x in sorted([*joins.HINTS, *joins.STRATEGIES]))}]) as strategy, count(*) as n
    from customer join nation on c_nationkey = n_nationkey"""
)
def strategy_names(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a join by each strategy's name has."""
    left, right = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    each = [joins.equi_join(left, right, "c_nationkey", "n_nationkey", x).agg(F.lit(x).alias("strategy"), F.count(F.lit(1)).alias("n")) for x in sorted([*joins.HINTS, *joins.STRATEGIES])]
    return sets.gathered(*each)


# --- from CSV files to a checked result

#: Columns of a cast and a title relation as SQL over orders and part, in the order of their fields.
CAST = {
    "cast_info_id": "o_orderkey",
    "person_id": "o_custkey",
    "movie_id": "o_orderkey % 2500",
    "person_role_id": "o_custkey % 7",
    "note": "concat(o_orderpriority, ' ', o_orderstatus)",
    "nr_order": "o_orderkey % 11",
    "role_id": "1",
}
TITLE = {
    "title_id": "p_partkey",
    "title": "p_name",
    "imdb_index": "concat('i', p_size)",
    "kind_id": "p_size",
    "production_year": "1900 + p_size",
    "imdb_id": "p_partkey % 1000",
    "phonetic_code": "concat('P', 100000 + p_partkey)",
    "episode_of_id": "p_partkey % 13",
    "season_nr": "p_partkey % 5",
    "episode_nr": "p_partkey % 17",
    "series_years": "p_type",
    "md5sum": "md5(p_name)",
}
#: Of ten orders one lacks fields, one has an empty last field and one a field too many; a line of each kind is malformed.
MALFORMED = "o_orderkey % 10 in (3, 5, 7)"


def as_sql(columns: dict[str, str], source: str, where: str = "true") -> str:
    """The relation that a loader is to make of the lines; phonetic_code is cut at its 5 bytes."""
    fields = {f.name: f for f in (*schemas.CAST_INFO, *schemas.TITLE)}
    made = [f"cast({e} as integer) as {c}" if fields[c].width is None else f"left({e}, {fields[c].width}) as {c}" for c, e in columns.items()]
    return f"select {', '.join(made)} from {source} where {where}"


def lines_of(columns: dict[str, str]) -> Column:
    return F.concat_ws(",", *[F.expr(f"cast({e} as string)") for e in columns.values()])


def cast_file(spark: SparkSession, d: str) -> str:
    """A CSV file with a header, malformed lines and numbers with something behind them."""
    good = lines_of(CAST | {"person_role_id": "case when o_orderkey % 5 = 1 then concat(' ', o_custkey % 7, 'abc') else cast(o_custkey % 7 as string) end"})
    bad = F.expr("o_orderkey % 10")
    line = F.when(bad == 3, F.expr("concat(o_orderkey, ',', o_custkey)")).when(bad == 5, F.concat(good, F.lit(",1"))).when(bad == 7, F.regexp_replace(good, "1$", "")).otherwise(good)
    path = f"{fresh_dir(spark, 'csv')}/cast"
    sinks.write_lines(table(spark, d, "orders").select(line), path, ",".join(f.header for f in schemas.CAST_INFO))
    return path


def title_file(spark: SparkSession, d: str) -> str:
    path = f"{fresh_dir(spark, 'csv')}/title"
    sinks.write_csv(table(spark, d, "part").select(*[F.expr(f"cast({e} as string)").alias(c) for c, e in TITLE.items()]), path)
    return path


GOOD_CAST, ALL_TITLE = as_sql(CAST, "orders", f"not {MALFORMED}"), as_sql(TITLE, "part")


@registered(GOOD_CAST)
def load_cast(spark: SparkSession, d: str) -> DataFrame:
    return csv_source.load_cast_info(spark, cast_file(spark, d))


@registered(ALL_TITLE)
def load_title(spark: SparkSession, d: str) -> DataFrame:
    return csv_source.load_title(spark, title_file(spark, d))


@registered(f"{GOOD_CAST} order by o_orderkey limit 1000")
def load_limited(spark: SparkSession, d: str) -> DataFrame:
    """The loader's own limit of rows."""
    return csv_source.load_cast_info(spark, cast_file(spark, d), limit=1000)


@registered(
    """select case when o_orderkey % 10 = 3 then concat(o_orderkey, ',', o_custkey) else concat_ws(',', o_orderkey, o_custkey, o_orderkey % 2500, case when o_orderkey % 5 = 1
    then concat(' ', o_custkey % 7, 'abc') else cast(o_custkey % 7 as varchar) end, concat(o_orderpriority, ' ', o_orderstatus), o_orderkey % 11,
    case when o_orderkey % 10 = 7 then '' else '1,1' end) end as value from orders where """ + MALFORMED
)
def load_rejected(spark: SparkSession, d: str) -> DataFrame:
    return csv_source.load(spark, cast_file(spark, d), schemas.CAST_INFO).rejected


@registered(f"with a as ({GOOD_CAST}) select * from a except all (select * from a order by cast_info_id limit 1000)")
def load_except(spark: SparkSession, d: str) -> DataFrame:
    """What a load of the whole file has that one with a limit hasn't."""
    path = cast_file(spark, d)
    return sets.except_all(csv_source.load_cast_info(spark, path), csv_source.load_cast_info(spark, path, limit=1000))


@registered("select line, length(line) as n from (select unnest(list_prepend('" + ",".join(f.header for f in schemas.TITLE) + "', list(concat_ws(',', " + ", ".join(f"cast({e} as varchar)" for e in TITLE.values()) + ")))) as line from part)")
def raw_line_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one file, its header included."""
    path = f"{fresh_dir(spark, 'csv')}/title"
    sinks.write_csv(table(spark, d, "part").select(*[F.expr(f"cast({e} as string)").alias(f.header if f.header != "id" else "id") for f, e in zip(schemas.TITLE, TITLE.values(), strict=True)]), path, one_file=True)
    return csv_source.raw_lines(spark, path).select(F.col("value").alias("line"), F.length("value").cast("long").alias("n"))


@registered("select cast(sum(length(p_name) + 1) + 7 as bigint) as bytes, true as whole from part")
def raw_block_scan(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of a file of names with a header of six letters, and whether the content has them all."""
    path = f"{fresh_dir(spark, 'csv')}/names"
    sinks.write_lines(table(spark, d, "part").select("p_name"), path, "p_name", one_file=True)
    blocks = csv_source.raw_blocks(spark, f"{path}/*.csv")
    return blocks.agg(F.sum("length").alias("bytes"), F.bool_and(F.col("length") == F.octet_length("content")).alias("whole"))


@registered("select p_name as value from part where length(p_name) between 9 and 11 order by p_partkey limit 20")
def title_list(spark: SparkSession, d: str) -> DataFrame:
    """The first lines of a file with lengths in a range."""
    path = f"{fresh_dir(spark, 'csv')}/names"
    sinks.write_lines(table(spark, d, "part").orderBy("p_partkey").select("p_name"), path, "a name that is a header", one_file=True)
    return sinks.lines_between(csv_source.raw_lines(spark, path, position=True), 9, 11, 20, *csv_source.POSITION)


RESULT = f"select b.*, a.* from ({GOOD_CAST}) as a join ({ALL_TITLE}) as b on movie_id = title_id"


@registered(RESULT)
def join_result(spark: SparkSession, d: str) -> DataFrame:
    """Both files loaded and joined: all columns of the result."""
    cast, title = csv_source.load_cast_info(spark, cast_file(spark, d)), csv_source.load_title(spark, title_file(spark, d))
    return joins.equi_join(cast, title, "movie_id", "title_id").select(*schemas.RESULT_COLUMNS)


@registered(
    f"""with r as ({RESULT}) select count(*) filter (cast_info_id % 9 > 2) + count(*) filter (cast_info_id % 9 = 4) as correct,
    count(*) filter (cast_info_id % 9 = 4) as duplicate, count(*) filter (cast_info_id % 9 = 2) as wrong,
    count(*) filter (cast_info_id % 9 < 2) as missing from r"""
)
def check_result(spark: SparkSession, d: str) -> DataFrame:
    """The checker on a merge join whose rows have been spoiled: of nine two are missing, one is wrong and one comes twice; the key of the join doesn't count."""
    cast, title = csv_source.load_cast_info(spark, cast_file(spark, d)), csv_source.load_title(spark, title_file(spark, d))
    expected, kind = joins.equi_join(cast, title, "movie_id", "title_id"), F.col("cast_info_id") % 9
    got = joins.equi_join(cast, title, "movie_id", "title_id", "merge").withColumn("movie_id", F.lit(-1))
    got = got.where(kind > 1).withColumn("note", F.when(kind == 2, "spoiled").otherwise(F.col("note")))
    return validate.check_result(got.unionByName(got.where(kind == 4)), expected)


# --- generators


def about(df: DataFrame, key: str, *more: Column) -> DataFrame:
    """Rows, different ids, the key's ends."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(df.columns[0]).alias("ids"), F.min(key).alias("low"), F.max(key).alias("high"), *more)


def letters(column: str, n: int) -> Column:
    return F.bool_and(F.col(column).rlike(f"^[a-z]{{{n}}}$"))


@registered("select 20000 as n, 20000 as ids, 1 as low, 50 as high, true as letters, true as even")
def generate_uniform(spark: SparkSession, d: str) -> DataFrame:
    even = (F.abs(F.skewness("movie_id")) < 0.25).alias("even")
    return about(datagen.generate(spark, "Uniform", 20_000, low=1, high=51), "movie_id", letters("note", 100).alias("letters"), even)


@registered("select 20000 as n, 20000 as ids, 1 as low, true as letters, true as skewed, true as first")
def generate_zipf(spark: SparkSession, d: str) -> DataFrame:
    """The first key has a share of 1 / (1 + 1/4 + 1/9 + ...), about 0.608."""
    share = F.avg((F.col("movie_id") == 1).cast("int"))
    return about(datagen.generate(spark, "Zipfian", 20_000), "movie_id", letters("note", 100).alias("letters"), (F.skewness("movie_id") >= 2).alias("skewed"), (F.abs(share - 0.608) < 0.02).alias("first")).drop("high")


@registered("select 20000 as n, 20000 as ids, 1 as low, 2001 as high, true as letters, 15001 as beyond")
def generate_match_rate(spark: SparkSession, d: str) -> DataFrame:
    beyond = F.sum((F.col("movie_id") == 2001).cast("int")).alias("beyond")
    return about(datagen.generate(spark, "MatchRate", 20_000, rate=0.24995), "movie_id", letters("note", 100).alias("letters"), beyond)


@registered("select 3257 as n, 3257 as ids, 1 as low, 3257 as high, true as letters")
def generate_title(spark: SparkSession, d: str) -> DataFrame:
    """A megabyte of rows."""
    return about(datagen.generate(spark, "Title", size_bytes=1 << 20), "title_id", (letters("title", 200) & letters("md5sum", 32)).alias("letters"))


@registered("select i + 1 as id, concat('1', lpad(cast(i as varchar), 59, '0')) as note, concat('1', lpad(cast(i as varchar), 59, '0')) as title from range(2000) as t(i)")
def generate_strings(spark: SparkSession, d: str) -> DataFrame:
    cast, title = datagen.string_tables(spark, 2000)
    out = joins.equi_join(cast, title, "cast_info_id", "title_id")
    return out.select(F.col("cast_info_id").cast("long").alias("id"), "note", "title")


@registered("select unnest(['cast_info', 'title']) as relation, unnest([1048576, 1048576]) as bytes, unnest([8457, 3257]) as n")
def generator_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(r, 1 << 20, datagen.rows_for(1 << 20, r)) for r in schemas.ROW_BYTES], "relation string, bytes int, n int")


# --- partitions, bits, aggregates


@registered("select l_partkey & 7 as pid, count(*) as n from lineitem group by 1")
def radix_histogram(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.radix_histogram(table(spark, d, "lineitem"), "l_partkey", radix_bits(THREADS))


@registered("select l_partkey & 7 as pid, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1")
def radix_join(spark: SparkSession, d: str) -> DataFrame:
    left, right = table(spark, d, "lineitem").select("l_partkey"), table(spark, d, "part").select("p_partkey")
    out = joins.equi_join(left, right, "l_partkey", "p_partkey", "radix", threads=THREADS)
    return out.groupBy(radix_id(F.col("l_partkey"), radix_bits(THREADS)).alias("pid")).agg(F.count(F.lit(1)).alias("n"))


@registered("select l_partkey & 7 as pid, l_orderkey, l_linenumber, l_partkey from lineitem")
def radix_partition(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    out = partitioning.radix_partition(rows, "l_partkey", radix_bits(THREADS))
    return out.select(F.col("pid").cast("long"), "l_orderkey", "l_linenumber", "l_partkey")


@registered("select cast(sum(n) // count(*) as bigint) as a from (select l_partkey & 7, count(*) as n from lineitem group by 1)")
def avg_partition_size(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.average_partition_size(table(spark, d, "lineitem"), "l_partkey", radix_bits(THREADS))


@registered("select min(l_partkey) as mn, max(l_partkey) as mx from lineitem")
def min_max(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.min_max(table(spark, d, "lineitem"), "l_partkey")


@registered("select p_partkey, ((p_partkey >> 3) & 1) = 1 as b from part")
def get_bit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", bit_at(F.col("p_partkey"), 3).alias("b"))


@registered("select count(*) as n from lineitem join part on l_partkey = p_partkey")
def count_result(spark: SparkSession, d: str) -> DataFrame:
    left, right = table(spark, d, "lineitem").select("l_partkey"), table(spark, d, "part").select("p_partkey")
    return aggregates.row_count(joins.equi_join(left, right, "l_partkey", "p_partkey"))


@registered("select p_brand, list(p_partkey order by p_partkey) as payloads from part where p_brand <> '' group by 1")
def payload_lists(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.payloads(table(spark, d, "part"), "p_brand", "p_partkey")


@registered("select l_partkey, count(*) as n, count(*) / (select count(*) from lineitem) as share from lineitem group by 1")
def value_frequency(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.frequencies(table(spark, d, "lineitem"), "l_partkey")


@registered("select round((avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) ** 3) / (avg(x * x) - avg(x) ** 2) ** 1.5, 6) as skew from (select l_partkey::double as x from lineitem)")
def key_skewness(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.skewness(table(spark, d, "lineitem"), "l_partkey").select(F.round("skew", 6).alias("skew"))


# --- strings


def order_part_text(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("tid"), F.col("o_orderkey").cast("string").alias("text"))
    return a, table(spark, d, "part").select(F.col("p_partkey").alias("cid"), F.col("p_partkey").cast("string").alias("note"))


PREFIX = """select tid, cid from (select a.k as tid, b.k as cid, rank() over (partition by a.k order by length(b.s) {}) as r
    from ({}) as a join ({}) as b on starts_with(a.s, b.s)) where r = 1"""
RLE = """select {key} as k, case when starts_with(x, '1') then list_aggregate(list_transform(range(1, length(x) + 1), lambda i:
    case when i > 1 and x[i] = x[i - 1] then '' else x[i] || case when i < length(x) and x[i + 1] = x[i]
    then '*' || cast(length(x[i:]) - length(ltrim(x[i:], x[i])) as varchar) else '' end end), 'string_agg', '') else x end as s
    from (select {key}, cast({key} as varchar) as x from {table})"""
TEXT = "select {key} as k, cast({key} as varchar) as s from {table}"
ORDERS, PART = {"key": "o_orderkey", "table": "orders"}, {"key": "p_partkey", "table": "part"}


@registered(PREFIX.format("asc", TEXT.format(**ORDERS), TEXT.format(**PART)))
def prefix_shortest(spark: SparkSession, d: str) -> DataFrame:
    return strings.prefix_join(*order_part_text(spark, d), "tid", "text", "note", "shortest").select("tid", "cid")


@registered(PREFIX.format("desc", TEXT.format(**ORDERS), TEXT.format(**PART)))
def prefix_longest(spark: SparkSession, d: str) -> DataFrame:
    return strings.prefix_join(*order_part_text(spark, d), "tid", "text", "note", "longest").select("tid", "cid")


@registered(PREFIX.format("asc", RLE.format(**ORDERS), RLE.format(**PART)))
def prefix_rle(spark: SparkSession, d: str) -> DataFrame:
    return strings.prefix_join(*order_part_text(spark, d), "tid", "text", "note", "shortest", compress=True).select("tid", "cid")


@registered("select k as o_orderkey, s as c from (" + RLE.format(**ORDERS) + ")")
def rle(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.run_length(F.col("o_orderkey").cast("string")).alias("c"))


@registered("select o_orderkey as tid, p_partkey as cid from orders join part on cast(o_orderkey as varchar) = cast(p_partkey as varchar)")
def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    return strings.exact_lookup(*order_part_text(spark, d), "text", "note").select("tid", "cid")


@registered("select a.doc_id as x, b.doc_id as y from documents as a join documents as b on encode(a.text)[1:100] = encode(b.text)[1:100] and a.doc_id < b.doc_id")
def bounded_equal(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    a, b = docs.select(F.col("doc_id").alias("x"), F.col("text").alias("s")), docs.select(F.col("doc_id").alias("y"), F.col("text").alias("t"))
    return strings.bounded_equal_join(a, b, "s", "t", 100).where("x < y").select("x", "y")


@registered("select doc_id, hex(encode(text)[1:100]) as h from documents")
def truncate_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.hex(text.truncate_bytes(F.col("text"), 100).cast("binary")).alias("h"))


# --- sets, checks, orders, text


@registered("select o_orderkey from orders where o_orderkey in (select doc_id from labels)")
def check_semi(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("o_orderkey"))
    return validate.matching(table(spark, d, "orders").select("o_orderkey"), labels, "o_orderkey")


@registered("select doc_id from documents where doc_id not in (select doc_id from labels)")
def check_anti(spark: SparkSession, d: str) -> DataFrame:
    return validate.unexpected(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@registered("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def check_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return validate.repeated(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@registered("select concat_ws(',', p_partkey, p_name, p_brand, p_size) as s from part")
def row_to_string(spark: SparkSession, d: str) -> DataFrame:
    return sinks.as_text(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"))


@registered("select p_partkey, p_brand from part order by p_brand, p_name, p_partkey")
def total_order(spark: SparkSession, d: str) -> DataFrame:
    return ordering.total_order(table(spark, d, "part"), "p_brand", "p_name", "p_partkey").select("p_partkey", "p_brand")


@registered("select cast_info_id, movie_id, row_number() over (order by cast_info_id) - 1 as pos from (" + as_sql(CAST, "orders") + ")")
def sort_cast(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(*[F.expr(f"cast({CAST[c]} as int)").alias(c) for c in ("cast_info_id", "movie_id")])
    return ordering.by_key(rows, "cast_info_id", position="pos")


@registered("select title, title_id, row_number() over (order by title, title_id) - 1 as pos from (" + ALL_TITLE + ")")
def sort_title(spark: SparkSession, d: str) -> DataFrame:
    """By a text of which few differ; the id decides between equal ones."""
    rows = table(spark, d, "part").select(F.struct("p_name", F.col("p_partkey").cast("int").alias("p_partkey")).alias("key"))
    return ordering.by_key(rows, "key", position="pos").select(F.col("key.p_name").alias("title"), F.col("key.p_partkey").alias("title_id"), "pos")


@registered("select o_orderkey, o_custkey from orders order by o_orderkey limit 10")
def limit_first_n(spark: SparkSession, d: str) -> DataFrame:
    return ordering.first_n(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 10, "o_orderkey")


@registered("select max(length(html)) as m from pages")
def max_line_length(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.longest(table(spark, d, "pages"), "html")
