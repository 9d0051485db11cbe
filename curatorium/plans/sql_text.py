"""Queries in SQL text over the operators' views and functions; each must equal the operator's own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatorium import sql
from curatorium.operators import joins as J
from curatorium.operators import ledger as L
from curatorium.plans import requests
from curatorium.plans.ledgers import attempts
from curatorium.plans.registry import ORACLES, query

c = F.col


def _installed(t):
    """The views of the operators that the functions need, over this table folder."""
    rows = attempts(t)
    later = F.concat_ws(":", c("owner").cast("string"), F.date_format(F.date_add("day", 1), "yyyy-MM-dd"))
    planned = rows.select("attempt").unionByName(rows.select(later.alias("attempt"))).distinct()
    days = J.range_join(t.corpus.select("release_date").distinct(), t.strata, "release_date", "gte", "lte")
    sql.install(
        t.spark,
        {
            "catalogue": t.catalogue, "requests": t.requests, "corpus": t.corpus, "facts": t.facts, "planned_attempts": planned,
            "slates": requests.slate(t).select("request_id", "slot", "id", "title", "tier", "pool_size", "next_offset"),
            "similar_items": requests._similar(t, 10),
            "stratum_days": days.select("release_date", "stratum"),
            "attempt_statuses": L.attempt_status(planned, rows, "attempt"),
            "mood_items": t.catalogue.select("id", F.explode("moods").alias("mood")),
        },
    )
    return t.spark


def _same_as(name: str, other: str):
    """Register a query that must return what another one returns."""

    def register(fn):
        query(name)(fn)
        ORACLES[name] = ORACLES[other]
        return fn

    return register


@_same_as("sql_slate_page", "slate_page")
def _(t):
    return _installed(t).sql("SELECT r.request_id, s.* FROM requests r, LATERAL cur_slate(r.request_id) s")


@_same_as("sql_top_k_similar", "top_k_similar")
def _(t):
    return _installed(t).sql("SELECT seeds.seed_id, s.* FROM (SELECT DISTINCT seed_id FROM similar_items) seeds, LATERAL cur_similar(seeds.seed_id, 3) s")


@_same_as("sql_range_join_stratum", "range_join_stratum")
def _(t):
    return _installed(t).sql(
        """SELECT s.stratum, count(*) AS n, count(DISTINCT c.id) AS ids, min(c.release_date) AS first_date, max(c.release_date) AS last_date
           FROM corpus c LEFT JOIN LATERAL cur_stratum(c.release_date) s GROUP BY s.stratum"""
    )


@_same_as("sql_attempt_status", "attempt_status")
def _(t):
    return _installed(t).sql("SELECT p.attempt, s.status FROM planned_attempts p, LATERAL cur_status(p.attempt) s")


@_same_as("sql_filter_mood", "filter_mood")
def _(t):
    return _installed(t).sql("SELECT r.request_id, m.id FROM requests r, LATERAL cur_in_mood(r.mood) m WHERE r.mood <> ''")


@query(
    "sql_bands",
    ["facts"],
    """SELECT (year // 10 * 10) || 's' AS decade, CASE WHEN votes >= 1000 THEN 'mainstream' WHEN votes >= 500 THEN 'familiar' ELSE 'discovery' END AS band, count(*) AS n, count(*) FILTER (WHERE rating >= 5) AS liked FROM facts GROUP BY ALL""",
)
def _(t):
    return _installed(t).sql("SELECT cur_decade(year) AS decade, cur_popularity_band(votes) AS band, count(*) AS n, count_if(rating >= 5) AS liked FROM facts GROUP BY ALL")
