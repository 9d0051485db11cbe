"""Request matching: mood, situation, practical filters, dealbreakers, preference score.

Every predicate takes Columns, so the same code serves one request (literals)
or a joined requests table.  An unset parameter ('' or null) always passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def unset(param: Column) -> Column:
    return param.isNull() | (param == "")


def optional(param: Column, cond: Column) -> Column:
    return F.coalesce(unset(param) | cond, F.lit(False))


def mood_matches(moods: Column, mood: Column) -> Column:
    """A row matches when it carries the mood; no mood means no match."""
    return F.coalesce(~unset(mood) & F.array_contains(moods, mood), F.lit(False))


def situation_matches(situations: Column, situation: Column) -> Column:
    return optional(situation, F.array_contains(situations, situation))


def runtime_bucket(minutes: Column) -> Column:
    return F.when(minutes < 100, "short").when(minutes <= 130, "medium").when(minutes > 130, "long")


def runtime_matches(minutes: Column, runtime: Column) -> Column:
    return optional(runtime, runtime_bucket(minutes) == runtime)


def genre_list(csv: Column) -> Column:
    return F.when(unset(csv), F.array().cast("array<string>")).otherwise(F.split(csv, ","))


def practical_matches(genres_csv: Column, language: Column, pace: Column, weight: Column) -> Column:
    """All requested genres present, and language, pace and weight equal where set."""
    return (
        F.forall(genre_list(genres_csv), lambda g: F.array_contains(F.col("genres"), g))
        & optional(language, F.array_contains("languages", language))
        & optional(pace, F.col("pace") == pace)
        & optional(weight, F.col("emotional_weight") == weight)
    )


def survives_dealbreakers(avoid_heavy: Column, avoid_slow: Column, under_two_hours: Column) -> Column:
    return (
        ~F.coalesce(avoid_heavy & (F.col("emotional_weight") == "heavy"), F.lit(False))
        & ~F.coalesce(avoid_slow & (F.col("pace") == "slow"), F.lit(False))
        & ~F.coalesce(under_two_hours & (F.col("runtime_minutes") >= 120), F.lit(False))
    )


def experience_score(attention: Column, style: Column) -> Column:
    """Number of soft preferences met (0 to 2)."""
    hit_attention = F.coalesce(~unset(attention) & (F.col("attention_demand") == attention), F.lit(False))
    hit_style = F.coalesce(~unset(style) & (F.col("discovery_style") == style), F.lit(False))
    return hit_attention.cast("int") + hit_style.cast("int")


def as_params(requests: DataFrame) -> DataFrame:
    return requests.select(
        "request_id", *[F.col(c).alias(f"q_{c}") for c in requests.columns if c != "request_id"]
    )


def match_requests(catalogue: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per (request, item) passing mood and practical filters, flagged ``exact``.

    Items are joined on their mood; adaptive execution picks the join from the sizes it measures.
    """
    params = as_params(requests).where(~unset(F.col("q_mood")))
    q = lambda c: F.col(f"q_{c}")
    return (
        catalogue.withColumn("q_mood", F.explode(F.array_distinct("moods")))
        .join(params, "q_mood")
        .where(
            practical_matches(q("genres"), q("language"), q("pace"), q("emotional_weight"))
            & runtime_matches(F.col("runtime_minutes"), q("runtime"))
        )
        .withColumn("exact", situation_matches(F.col("situations"), q("situation")))
    )


def relax_if_few(matched: DataFrame, minimum: int = 3) -> DataFrame:
    """Keep exact matches, and the others too where a situation left fewer than ``minimum``.

    Adds ``tier`` (1 exact, 2 fallback).  The test counts exact matches before dealbreakers.
    """
    exact = matched.groupBy("request_id").agg(F.count_if("exact").alias("exact_count"))
    relaxed = ~unset(F.col("q_situation")) & (F.col("exact_count") < minimum)
    return (
        matched.join(exact, "request_id")
        .where(F.col("exact") | relaxed)
        .withColumn("tier", F.when(F.col("exact"), 1).otherwise(2))
    )


def drop_dealbreakers(pool: DataFrame) -> DataFrame:
    return pool.where(
        survives_dealbreakers(F.col("q_avoid_heavy"), F.col("q_avoid_slow"), F.col("q_under_two_hours"))
    )


def with_score(pool: DataFrame) -> DataFrame:
    return pool.withColumn("score", experience_score(F.col("q_attention_demand"), F.col("q_discovery_style")))


def filter_favorites(catalogue: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved rows per user; repeats and ids outside the catalogue drop out."""
    wanted = saved.where(F.col("id").isNotNull() & (F.col("id") != "")).dropDuplicates(["user_id", "id"])
    return wanted.join(catalogue.select("id", "ord"), "id")
