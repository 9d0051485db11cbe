"""The operators from SQL text: views, scalar functions and table functions of a session.

A table function is a query over the view of an operator, so calling it plans the operator itself; called with columns of
another table (LATERAL) it becomes an equality join, never a call per row.  Views and functions belong to the session and
replace earlier ones of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PREFIX = "cur_"


@dataclass(frozen=True)
class TableFunction:
    """``name(parameters)``: the ``columns`` of a view where ``condition`` holds; a parameter is (name, column that has its type, or a type)."""

    name: str
    view: str
    parameters: tuple[tuple[str, str], ...]
    condition: str
    columns: tuple[str, ...]


FUNCTIONS = [
    TableFunction("slate", "slates", (("request", "request_id"),), "request_id = request", ("slot", "id", "title", "tier", "pool_size", "next_offset")),
    TableFunction("similar", "similar_items", (("seed", "seed_id"), ("most", "INT")), "seed_id = seed AND rn <= most", ("id", "score", "rn")),
    TableFunction("stratum", "stratum_days", (("day", "release_date"),), "release_date = day", ("stratum",)),
    TableFunction("status", "attempt_statuses", (("of_attempt", "attempt"),), "attempt = of_attempt", ("status",)),
    TableFunction("in_mood", "mood_items", (("wanted", "mood"),), "mood = wanted", ("id",)),
]

# Scalar functions: parameters, result and expression, the same as the column expressions of the operators.
SCALARS = {
    "decade": ("y BIGINT", "STRING", "CASE WHEN y IS NOT NULL THEN concat(CAST(floor(y / 10) * 10 AS BIGINT), 's') END"),
    "popularity_band": ("votes BIGINT", "STRING", "CASE WHEN votes >= 1000 THEN 'mainstream' WHEN votes >= 500 THEN 'familiar' ELSE 'discovery' END"),
    "wilson_low": (
        "k BIGINT, n BIGINT", "DOUBLE",
        "((k / n) + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) - sqrt((k / n) * (1 - k / n) / n + 3.841458820694124 / (4D * n * n)) * 1.959963984540054 / (1 + 3.841458820694124 / n)",
    ),
}


def install(spark: SparkSession, views: dict[str, DataFrame]) -> list[str]:
    """Register the views, the scalar functions and every table function whose view is there; the names of the functions."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    names = []
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({parameters}) RETURNS {result} RETURN {body}")
        names.append(PREFIX + name)
    for f in FUNCTIONS:
        if f.view not in views:
            continue
        kinds = dict(views[f.view].dtypes)
        parameters = ", ".join(f"{p} {kinds.get(kind, kind)}" for p, kind in f.parameters)
        columns = ", ".join(f"{c} {kinds[c]}" for c in f.columns)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{f.name}({parameters}) RETURNS TABLE({columns}) RETURN SELECT {', '.join(f.columns)} FROM {f.view} WHERE {f.condition}")
        names.append(PREFIX + f.name)
    return names
