"""Keyed joins with integrity reports, exclusions, reconciliation and comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import jaccard, normalized_title, reasons, same_set


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def keyed_counts(sides: dict[str, tuple[DataFrame, dict[str, Column], dict[str, Column]]]) -> DataFrame:
    """(kind, value, n_<side>, low_<side>_<name>, high_<side>_<name>): rows of every side per key, in one pass over each.

    A side is (rows, keys by kind, values by name): each row counts once for each of its keys.  Counts and the extremes of the
    values tell duplicates, missing sides and differing values apart without a join per question.
    """
    tagged, names = [], []
    for side, (df, keys, values) in sides.items():
        pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("value")) for kind, key in keys.items()])
        tagged.append(df.select(F.lit(side).alias("__side"), *[v.alias(f"__{side}_{n}") for n, v in values.items()], F.inline(pairs)))
        names += [(side, n) for n in values]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    counts = [F.count_if(F.col("__side") == side).alias(f"n_{side}") for side in sides]
    extremes = [f(f"__{side}_{n}").alias(f"{end}_{side}_{n}") for side, n in names for end, f in (("low", F.min), ("high", F.max))]
    return rows.groupBy("kind", "value").agg(*counts, *extremes)


def join_facts_strict(curated: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Curated rows with their facts, and one row per key and broken expectation."""
    tmdb = F.col("tmdb_id")
    counts = keyed_counts({"curated": (curated, {"id": F.col("id"), "tmdb": tmdb}, {"tmdb": tmdb}), "facts": (facts, {"id": F.col("id")}, {"tmdb": tmdb})})
    is_id, held = F.col("kind") == "id", F.col("n_curated") > 0
    both = is_id & held & (F.col("n_facts") > 0) & F.col("value").isNotNull()
    differ = (F.col("low_curated_tmdb") != F.col("high_facts_tmdb")) | (F.col("high_curated_tmdb") != F.col("low_facts_tmdb"))
    found = reasons(
        (is_id & (F.col("n_curated") > 1), "DUPLICATE_ID"),
        (~is_id & (F.col("n_curated") > 1), "DUPLICATE_TMDB_ID"),
        (is_id & held & ~both, "MISSING_FACTS"),
        (both & differ, "ID_MISMATCH"),
    )
    shared = [c for c in facts.columns if c in curated.columns and c != "id"]
    return curated.join(facts.drop(*shared), "id"), counts.select(F.explode(found).alias("code"), "value")


def reconcile_one_to_one(curated: DataFrame, mapping: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per key and violation of curated : mapping : facts = 1 : 1 : 1, as (code, value)."""
    tmdb, by_id = F.col("tmdb_id"), {"id": F.col("id")}
    counts = keyed_counts({"c": (curated, by_id, {"tmdb": tmdb}), "m": (mapping, {**by_id, "tmdb": tmdb}, {"tmdb": tmdb}), "f": (facts, by_id, {"tmdb": tmdb})})
    is_id, in_c, in_m, in_f = F.col("kind") == "id", F.col("n_c") > 0, F.col("n_m") > 0, F.col("n_f") > 0
    off = lambda other: (F.col("low_c_tmdb") != F.col(other)) | (F.col("high_c_tmdb") != F.col(other))
    found = reasons(
        (is_id & (F.col("n_m") > 1), "DUPLICATE_MAPPING_ID"),
        (~is_id & (F.col("n_m") > 1), "DUPLICATE_MAPPED_TMDB_ID"),
        (is_id & in_m & ~in_c, "MAPPING_WITHOUT_CURATED_ROW"),
        (is_id & in_c & ~in_m, "MISSING_MAPPING"),
        (is_id & in_c & ~in_f, "MISSING_FACTUAL_SNAPSHOT"),
        (is_id & in_c & in_m & off("low_m_tmdb"), "MAPPING_ID_DIFFERS"),
        (is_id & in_c & in_f & (off("low_f_tmdb") | off("high_f_tmdb")), "FACTS_ID_DIFFERS"),
    )
    return counts.select(F.explode(found).alias("code"), "value")


def reconcile_membership(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys not present exactly once in every set, with their count per set."""
    tagged = union_all([df.select(key, F.lit(n).alias("__set")) for n, df in sets.items()])
    counts = tagged.groupBy(key).agg(*[F.count_if(F.col("__set") == n).alias(n) for n in sets])
    off = reduce(Column.__or__, [F.col(n) != 1 for n in sets])
    return counts.where(off)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per changed field of keys in both snapshots; arrays compare as sets."""
    types = dict(old.dtypes)

    def text(side: str, f: str) -> Column:
        c = F.col(f"{side}.{f}")
        return F.array_join(F.sort_array(F.array_distinct(c)), "|") if types[f].startswith("array") else c.cast("string")

    a = old.select(key, F.struct(*fields).alias("a"))
    b = new.select(key, F.struct(*fields).alias("b"))
    changes = F.array_compact(
        F.array(
            *[
                F.when(~text("a", f).eqNullSafe(text("b", f)), F.struct(F.lit(f).alias("field"), text("a", f).alias("before"), text("b", f).alias("after")))
                for f in fields
            ]
        )
    )
    return a.join(b, key).select(key, F.explode(changes).alias("c")).select(key, "c.*")


def leak_check(selected: DataFrame, forbidden: DataFrame, key: str) -> DataFrame:
    """Selected rows found in a forbidden set with the reason; nothing is the good answer."""
    return selected.select(key).distinct().join(forbidden.select(key, "reason").distinct(), key)


def firewall(rows: DataFrame, held: DataFrame, key: str = "id", title: str = "title") -> DataFrame:
    """Keys whose id or normalized title occurs on the held side, without an OR join."""
    named = rows.select(key, normalized_title(F.col(title)).alias("__t"))
    titles = held.select(normalized_title(F.col(title)).alias("__t")).where("__t <> ''").distinct()
    by_id = rows.join(held.select(key).distinct(), key, "left_semi").select(key)
    by_title = named.join(titles, "__t", "left_semi").select(key)
    return by_id.unionByName(by_title).distinct()


def collision_check(batch: DataFrame, mapping: DataFrame, key: str, owner: str) -> DataFrame:
    """Batch keys already mapped (with the owner) or repeated inside the batch."""
    counts = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"))  # both branches read one shuffled copy
    taken = counts.where("n > 0").join(mapping.select(key, owner), key)
    taken = taken.select(key, F.lit("ALREADY_MAPPED").alias("kind"), F.col(owner).cast("string").alias("detail"))
    twice = counts.where("n > 1").select(key, F.lit("DUPLICATE_IN_BATCH").alias("kind"), F.col("n").cast("string").alias("detail"))
    return taken.unionByName(twice)


def range_join(rows: DataFrame, ranges: DataFrame, value: str, low: str, high: str, unit: str = "MM") -> DataFrame:
    """Rows with the ranges of dates holding their value, bounds included; null columns where none does.

    Each range is listed once per calendar ``unit`` it touches, so rows meet ranges by an equality join on the unit and
    are compared exactly afterwards.  Bounds and values are dates or their ISO texts; a range with a null bound is ignored.
    """
    start, stop = F.trunc(F.col(low).cast("date"), unit), F.trunc(F.col(high).cast("date"), unit)
    step = F.expr("interval 1 year" if unit.lower() in ("year", "yyyy", "yy") else "interval 1 month")
    cut = ranges.where(start <= stop).withColumn("__unit", F.explode(F.sequence(start, stop, step)))
    placed = rows.withColumn("__of", F.trunc(F.col(value).cast("date"), unit))
    held = (F.col("__of") == F.col("__unit")) & F.col(value).between(F.col(low), F.col(high))
    return placed.join(cut, held, "left").drop("__of", "__unit")


def complete_join(left: DataFrame, sides: dict[str, DataFrame], key: str) -> DataFrame:
    """``left`` with the columns of all sides and ``missing``, the names of the sides without the key.

    Sides have one row per key.  Every input is read once; rows without a missing side are the inner join.
    """
    flags = {name: f"__has_{i}" for i, name in enumerate(sides)}
    wide = reduce(lambda a, name: a.join(sides[name].withColumn(flags[name], F.lit(True)), key, "left"), sides, left)
    absent = F.array_compact(F.array(*[F.when(F.col(flag).isNull(), F.lit(name)) for name, flag in flags.items()]))
    return wide.withColumn("missing", absent).drop(*flags.values())


def joined_or_missing(wide: DataFrame, columns: dict[str, Column], complete: str = "joined") -> DataFrame:
    """One row per complete row with ``columns`` and status ``complete``; else a row per missing side, columns null."""
    whole = F.size("missing") == 0
    states = F.when(whole, F.array(F.lit(complete))).otherwise(F.transform("missing", lambda m: F.concat(F.lit("missing "), m)))
    kept = [F.when(whole, value).alias(name) for name, value in columns.items()]
    return wide.select("*", F.explode(states).alias("status")).select(*[c for c in wide.columns[:1]], *kept, "status")


def overlay_corrections(history: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Effective decision per record: an approved correction bound to the current hash replaces history."""
    bound = corrections.select(key, F.col("decision").alias("c_decision"), F.col("bound_hash"))
    wide = history.join(bound, key, "left")
    fresh = F.col("bound_hash") == F.col("record_hash")
    status = F.when(F.col("c_decision").isNull(), "UNCHANGED").when(fresh, "CORRECTED").otherwise("STALE_CORRECTION")
    return wide.select(
        key,
        F.col("decision").alias("historical"),
        F.coalesce(F.when(fresh, F.col("c_decision")), F.col("decision")).alias("effective"),
        status.alias("status"),
    )


def issue_concordance(records: DataFrame, key: str) -> DataFrame:
    """Per human-flagged field of a revised record: MATCHES, PARTIAL or MISSED against the model's fields."""
    hit = F.array_contains("model_fields", F.col("field"))
    return (
        records.where(F.col("human_decision") == "REVISE")
        .select(key, F.explode("human_fields").alias("field"), "model_fields")
        .select(
            key,
            "field",
            F.when(hit, "MATCHES_HUMAN_DEFECT").when(F.size("model_fields") > 0, "PARTIAL_MATCH").otherwise("MISSED_HUMAN_DEFECT").alias("concordance"),
        )
    )


def extra_issue_queue(records: DataFrame, key: str) -> DataFrame:
    """Model issues outside the human fields, and any issue on a clean record."""
    revised = F.col("human_decision") == "REVISE"
    extra = F.when(revised, F.array_except("model_fields", "human_fields")).otherwise(F.col("model_fields"))
    return records.select(
        key, F.explode(extra).alias("field"), F.when(revised, "EXTRA_ISSUE_ON_DEFECTIVE").otherwise("ISSUE_ON_CLEAN").alias("reason")
    )


def paired_delta(rows: DataFrame, key: str, arm: str, first: str, second: str, values: Sequence[str]) -> DataFrame:
    """Mean of second minus first over keys seen under both arms; one pass, no self join."""
    sums = [F.sum(F.when(F.col(arm) == a, F.col(v))).alias(f"{v}_{a}") for v in values for a in (first, second)]
    pairs = rows.groupBy(key).agg(
        F.count_if(F.col(arm) == first).alias("__a"), F.count_if(F.col(arm) == second).alias("__b"), *sums
    ).where((F.col("__a") > 0) & (F.col("__b") > 0))
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        *[F.avg(F.col(f"{v}_{second}") - F.col(f"{v}_{first}")).alias(f"{v}_delta") for v in values],
    )


def resolve_identity(rows: DataFrame, index: DataFrame, key: str = "canonical_id") -> DataFrame:
    """Numeric id per canonical id; RESOLVED, CONFLICT or MISSING."""
    wide = rows.join(index, key, "left")
    status = F.when(F.col("conflict").isNull(), "MISSING").when(F.col("conflict"), "CONFLICT").otherwise("RESOLVED")
    return wide.select(key, status.alias("status"), F.when(~F.col("conflict"), F.col("resolved_id")).alias("resolved_id"))


def usable_reserves(queue: DataFrame, cell: str, tier: str, ready: Column) -> DataFrame:
    """Reserve rows whose own cell still misses its primary quota."""
    cells = queue.groupBy(cell).agg(F.count_if(F.col(tier) == "primary").alias("quota"), F.count_if(ready).alias("ready"))
    open_cells = cells.where(F.col("ready") < F.col("quota"))
    return queue.where((F.col(tier) == "reserve") & ~ready).join(open_cells, cell)


def approval_freshness(recorded: DataFrame, actual: DataFrame, key: str, hashes: Sequence[str]) -> DataFrame:
    """STALE_APPROVAL per hash that differs from its recomputed value."""
    a = recorded.select(key, F.struct(*hashes).alias("a"))
    b = actual.select(key, F.struct(*hashes).alias("b"))
    stale = F.array_compact(F.array(*[F.when(~F.col(f"a.{h}").eqNullSafe(F.col(f"b.{h}")), F.lit(h)) for h in hashes]))
    return a.join(b, key).select(key, F.explode(stale).alias("field")).withColumn("code", F.lit("STALE_APPROVAL"))


def identity_consistency(artifacts: Sequence[DataFrame], record: str, identity: Sequence[str]) -> DataFrame:
    """Records whose artifacts do not all carry the same identity."""
    rows = union_all([a.select(record, *identity) for a in artifacts])
    return rows.groupBy(record).agg(F.count_distinct(F.struct(*identity)).alias("identities")).where("identities > 1")


def compare_classifications(rows: DataFrame, key: str, ordinals: dict[str, tuple[str, str]], sets: dict[str, tuple[str, str]]) -> DataFrame:
    """Per item: ordinal matches, set overlap and set equality of two classifications."""
    out = {}
    for name, (a, b) in ordinals.items():
        out[f"{name}_match"] = F.coalesce(F.col(a) == F.col(b), F.lit(False))
    for name, (a, b) in sets.items():
        out[f"{name}_jaccard"] = jaccard(F.col(a), F.col(b))
        out[f"{name}_equal"] = same_set(F.col(a), F.col(b))
    return rows.select(key, *[c.alias(n) for n, c in out.items()])


def layered_priority(layers: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Per key the value of the last layer that accepts it."""
    tagged = union_all([df.select(key, F.lit(i).alias("layer"), value) for i, df in enumerate(layers, 1)])
    return tagged.groupBy(key).agg(F.max("layer").alias("layer"), F.max_by(value, "layer").alias(value))


def spec_coverage(misses: DataFrame, mapping: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """A miss is covered only when all vocabulary entries it maps to are defined."""
    known = vocabulary.select("kind", "entry", F.lit(True).alias("__known"))
    wide = misses.join(mapping, "defect", "left").join(known, ["kind", "entry"], "left")
    return wide.groupBy("candidate_id", "defect").agg(
        F.coalesce(F.bool_and(F.coalesce("__known", F.lit(False))), F.lit(False)).alias("covered")
    )


def repair_plan(decisions: DataFrame, copy: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Affected fields of a revised record and a digest of every field that must not change."""
    affected = F.col("affected_fields")
    locked = F.array_compact(
        F.array(*[F.when(~F.array_contains(affected, f), F.concat(F.lit(f"{f}="), F.sha2(F.col(f), 256))) for f in fields])
    )
    return decisions.join(copy, key).select(key, "affected_fields", locked.alias("locked"))
