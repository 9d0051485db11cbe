"""Tiles, distribution ranks and sliding ranges over groups of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatorium.functions import spread
from curatorium.plans.registry import query

c = F.col


@query(
    "runtime_tiles",
    ["catalogue"],
    "SELECT id, pace, ntile(7) OVER (PARTITION BY pace ORDER BY ord) AS tile FROM catalogue",
)
def _(t):
    tiles = spread.ntile(t.catalogue.select("id", "pace", "ord"), ["pace"], [c("ord").asc()], [(spread.integer_bucket("ord"), True)], 7)
    return tiles.select("id", "pace", c("tile").cast("bigint").alias("tile"))


@query(
    "price_ranks",
    (),
    """p AS (SELECT l_returnflag, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem)
       SELECT l_returnflag, l_orderkey, l_linenumber, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 9) AS percent_rank, round(cume_dist() OVER w, 9) AS cume_dist FROM p WINDOW w AS (PARTITION BY l_returnflag ORDER BY quantity)""",
)
def _(t):
    rows = t.raw("lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", c("l_quantity").cast("bigint").alias("quantity"))
    ranks = spread.value_ranks(rows, ["l_returnflag"], "quantity")
    shares = [F.round(n, 9).alias(n) for n in ("percent_rank", "cume_dist")]
    return rows.join(ranks, ["l_returnflag", "quantity"]).select("l_returnflag", "l_orderkey", "l_linenumber", "rank", "dense_rank", *shares)


@query(
    "trailing_week",
    ["ledger"],
    """d AS (SELECT CASE WHEN attempt_id % 3 = 0 THEN 0 ELSE attempt_id END AS owner, day, count(*) AS n, CAST(sum(cost_cents) AS BIGINT) AS cents, max(cost_cents) AS most FROM ledger GROUP BY ALL)
       SELECT owner, day, CAST(sum(n) OVER w AS BIGINT) AS rows, CAST(sum(cents) OVER w AS BIGINT) AS cents, max(most) OVER w AS most FROM d WINDOW w AS (PARTITION BY owner ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""",
)
def _(t):
    rows = t.ledger.withColumn("owner", F.when(c("attempt_id") % 3 == 0, 0).otherwise(c("attempt_id")))
    return spread.sliding_totals(rows, ["owner"], "day", 6, 0, {"cents": c("cost_cents")}, {"most": c("cost_cents")})
