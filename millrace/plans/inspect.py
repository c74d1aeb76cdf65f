"""What Catalyst makes of a query: sizes and physical operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate; unknown sizes are estimated as huge."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def physical_nodes(df: DataFrame) -> list[str]:
    """Names of the physical operators, top first; of an adaptive plan the initial ones."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = (re.sub(r"^[\s:+|*-]*(\(\d+\)\s*)?", "", line) for line in text.splitlines())
    return [m[0] for line in lines if (m := re.match(r"[A-Z]\w+", line))]
