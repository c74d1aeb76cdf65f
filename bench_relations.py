"""Seconds of the joins over generated relations of one GiB each (8,659,209 and 3,334,602 rows): one JSON line.

    BENCH_CPUS=8 python bench_relations.py [bytes]

Relations are generated into Parquet first; that isn't counted. A join's time is from reading its files to the last of all 19 columns of its last row.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from millrace.operators import joins
    from millrace.plans.session import SETTINGS
    from millrace.sources import datagen, schemas

    cpus, size = int(os.environ.get("BENCH_CPUS", "8")), int(sys.argv[1]) if sys.argv[1:] else 1 << 30
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(4 * cpus), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    with tempfile.TemporaryDirectory() as out:
        for kind in ("Uniform", "Title"):
            began = time.perf_counter()
            datagen.generate(spark, kind, size_bytes=size).write.parquet(f"{out}/{kind}")
            seconds[f"generate {kind}"] = round(time.perf_counter() - began, 2)
        cast, title = (spark.read.parquet(f"{out}/{k}") for k in ("Uniform", "Title"))
        ways = {x: lambda x=x: joins.equi_join(cast, title, "movie_id", "title_id", x) for x in ("auto", "broadcast", "shuffle_hash", "merge", "radix")}
        ways["range pruned"] = lambda: joins.range_pruned_join(cast, title, "movie_id", "title_id", "auto")
        ways["chunked build"] = lambda: joins.chunked_build_join(cast, title, "movie_id", "title_id", ["title_id"], cpus)
        for name, join in ways.items():
            best = float("inf")
            for _ in range(2):
                began = time.perf_counter()
                join().select(*schemas.RESULT_COLUMNS).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - began)
            seconds[name] = round(best, 2)
        rows = cast.agg(F.count(F.lit(1))).first()[0]
    print(json.dumps({"bytes": size, "rows": rows, "cpus": cpus, "seconds": seconds}))
    spark.stop()


if __name__ == "__main__":
    main()
