"""Grouping, distinct, agreement metrics, coverage, usage and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatorium.functions.columns import digest, jaccard, rate, reasons, same_set
from curatorium.functions.spread import discrete_quantiles
from curatorium.operators.joins import union_all


def dedup_best(rows: DataFrame, key: str, best: Sequence[Column], keep: Sequence[str], cell: str) -> DataFrame:
    """One row per key, the greatest by ``best``, with every source cell (cells are a short list)."""
    return rows.groupBy(key).agg(
        F.max_by(F.struct(*keep), F.struct(*[b.alias(f"o{i}") for i, b in enumerate(best)])).alias("__best"),
        F.sort_array(F.collect_set(cell)).alias("cells"),
    ).select(key, "__best.*", "cells")


def collapse_identical(rows: DataFrame, key: str) -> DataFrame:
    """Copies and distinct contents per key; more than one content is a conflict."""
    hashed = rows.withColumn("__d", digest(*[c for c in rows.columns if c != key]))
    return hashed.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("__d").alias("contents")).withColumn(
        "conflict", F.col("contents") > 1
    )


def partition_integrity(rows: DataFrame, run: str, key: str, cell: str, inside: Column, content: Sequence[str]) -> DataFrame:
    """Per run the first failing check: membership, then one cell per key, then identical copies."""
    per_key = rows.withColumn("__d", digest(*content)).groupBy(run, key).agg(
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside"),
        (F.min(cell) != F.max(cell)).alias("crosses"),
        (F.min("__d") != F.max("__d")).alias("conflicts"),
    )
    out = per_key.groupBy(run).agg(
        F.sum("outside").alias("outside"), F.count_if("crosses").alias("cross_cell"), F.count_if("conflicts").alias("conflicting")
    )
    status = (
        F.when(F.col("outside") > 0, "MEMBERSHIP_VIOLATION")
        .when(F.col("cross_cell") > 0, "CROSS_CELL_DUPLICATE")
        .when(F.col("conflicting") > 0, "DUPLICATE_CONFLICT")
        .otherwise("OK")
    )
    return out.withColumn("status", status)


def merge_exclusions(rows: DataFrame, key: str = "id") -> DataFrame:
    """Per id the agreed canonical id, sorted reasons and provenance, and whether sources disagree."""
    return rows.groupBy(key).agg(
        F.min("canonical_id").alias("canonical_id"),
        (F.count_distinct("canonical_id") > 1).alias("conflict"),
        F.array_join(F.sort_array(F.collect_set("reason")), "|").alias("reasons"),
        F.array_join(F.sort_array(F.collect_set("provenance")), "|").alias("provenance"),
    )


def duplicate_owners(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """One row per owner of a repeated key; owners are rows, not a list, so a hot key stays spread."""
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.select(key, owner).join(repeated, key)


def identity_index(sources: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """One value per key over many sources, and whether the sources disagree."""
    pairs = union_all([s.select(key, value) for s in sources])
    return pairs.groupBy(key).agg(
        F.min(value).alias("resolved_id"), (F.min(value) != F.max(value)).alias("conflict"), F.count_distinct(value).alias("ids")
    )


def breakdown(rows: DataFrame, dimensions: Sequence[str], status: str, values: dict[str, str]) -> DataFrame:
    """Counts per status for many single dimensions in one pass (grouping sets)."""
    sets = [[F.col(d)] for d in dimensions]
    dim = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions])
    key = F.coalesce(*[F.when(F.grouping(d) == 0, F.coalesce(F.col(d), F.lit("unknown"))) for d in dimensions])
    grouped = rows.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        dim.alias("dimension"),
        key.alias("value"),
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(status) == v).alias(n) for n, v in values.items()],
    )
    return grouped.select("dimension", "value", "total", *values)


def coverage_by_strata(rows: DataFrame, strata: Column, viable: Column) -> DataFrame:
    """Viable and total per stratum; a row in several strata counts once in each."""
    return (
        rows.select(F.explode(F.array_distinct(strata)).alias("stratum"), viable.alias("__v"))
        .groupBy("stratum")
        .agg(F.count_if("__v").alias("viable"), F.count(F.lit(1)).alias("total"))
        .withColumn("coverage", F.col("viable") / F.col("total"))
    )


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper 95% Wilson bounds of k successes in n."""
    p = k / n
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    margin = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / scale
    return middle - margin, middle + margin


def ordinal_kind(human: Column, model: Column) -> Column:
    """exact / adjacent / severe from 1-based scale positions."""
    distance = F.abs(human - model)
    return F.when(distance == 0, "exact").when(distance == 1, "adjacent").otherwise("severe")


def unpivot_ordinals(rows: DataFrame, key: str, fields: dict[str, tuple[str, str, Sequence[str]]]) -> DataFrame:
    """(key, field, human, model, hi, mi): one row per ordinal field."""
    entries = []
    for name, (human, model, scale) in fields.items():
        levels = F.array(*[F.lit(v) for v in scale])
        entries.append(
            F.struct(
                F.lit(name).alias("field"), F.col(human).alias("human"), F.col(model).alias("model"),
                F.array_position(levels, F.col(human)).alias("hi"), F.array_position(levels, F.col(model)).alias("mi"),
            )
        )
    return rows.select(key, F.explode(F.array(*entries)).alias("e")).select(key, "e.*")


def ordinal_diagnostics(long: DataFrame) -> DataFrame:
    hi, mi = F.col("hi"), F.col("mi")
    kind = ordinal_kind(hi, mi)
    dist = {f"{side}_{i}": F.count_if(F.col(col) == i) for side, col in (("human", "hi"), ("model", "mi")) for i in (1, 2, 3)}
    return long.groupBy("field").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(kind == k).alias(k) for k in ("exact", "adjacent", "severe")],
        *[e.alias(n) for n, e in dist.items()],
        F.count_if((mi == 2) & (hi != 2)).alias("center_hedging"),
    ).withColumns({"model_middle_rate": F.col("model_2") / F.col("total"), "human_middle_rate": F.col("human_2") / F.col("total")})


def transitions(long: DataFrame) -> DataFrame:
    moved = long.where(F.col("hi") != F.col("mi"))
    return moved.groupBy("field", F.concat("human", F.lit(" -> "), "model").alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def weighted_kappa(long: DataFrame, levels: int = 3) -> DataFrame:
    """Quadratic weighted kappa per field from one confusion count; null when chance agreement is complete."""
    span = range(1, levels + 1)
    cell = {(i, j): F.count_if((F.col("hi") == i) & (F.col("mi") == j)) for i in span for j in span}
    counts = long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"c{i}{j}") for (i, j), c in cell.items()])
    human = {i: sum((F.col(f"c{i}{j}") for j in span), F.lit(0)) for i in span}
    model = {j: sum((F.col(f"c{i}{j}") for i in span), F.lit(0)) for j in span}
    weight = {(i, j): 1 - (i - j) ** 2 / (levels - 1) ** 2 for i in span for j in span}
    observed = sum((F.col(f"c{i}{j}") * w for (i, j), w in weight.items()), F.lit(0.0)) / F.col("n")
    expected = sum((human[i] * model[j] * w for (i, j), w in weight.items()), F.lit(0.0)) / (F.col("n") * F.col("n"))
    return counts.select(
        "field", "n", F.when(expected != 1, (observed - expected) / (1 - expected)).alias("kappa")
    )


def multilabel_metrics(rows: DataFrame, human: str, model: str, labels: Sequence[str]) -> DataFrame:
    """Per label tp / fp / fn and their ratios, from one pass over the rows."""
    has = lambda c, v: F.array_contains(c, v)
    sums = []
    for v in labels:
        h, m = has(human, v), has(model, v)
        sums += [F.count_if(h & m).alias(f"{v}|tp"), F.count_if(~h & m).alias(f"{v}|fp"), F.count_if(h & ~m).alias(f"{v}|fn")]
    wide = rows.agg(*sums)
    long = wide.select(
        F.explode(
            F.array(*[F.struct(F.lit(v).alias("label"), *[F.col(f"`{v}|{k}`").alias(k) for k in ("tp", "fp", "fn")]) for v in labels])
        ).alias("r")
    ).select("r.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = long.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when((p + r) != 0, p * r * 2 / (p + r)))


def calibration_summary(rows: DataFrame, human_set: str, model_set: str, ordinals: dict[str, tuple[str, str, Sequence[str]]]) -> DataFrame:
    """Set and ordinal agreement of a whole run in one row."""
    out = [
        F.count(F.lit(1)).alias("n"),
        F.avg(jaccard(F.col(human_set), F.col(model_set))).alias("mean_jaccard"),
        F.count_if(same_set(F.col(human_set), F.col(model_set))).alias("exact_sets"),
        F.count_if(F.size(F.array_distinct(model_set)) > F.size(F.array_distinct(human_set))).alias("over_tagged"),
        F.count_if(jaccard(F.col(human_set), F.col(model_set)) == 0).alias("disjoint_sets"),
    ]
    for name, (h, m, scale) in ordinals.items():
        levels = F.array(*[F.lit(v) for v in scale])
        kind = ordinal_kind(F.array_position(levels, F.col(h)), F.array_position(levels, F.col(m)))
        out += [F.count_if(kind == k).alias(f"{name}_{k}") for k in ("exact", "adjacent", "severe")]
    return rows.agg(*out)


def dealbreaker_risk(human: Column, model: Column, boundary: str) -> Column:
    """UNDERSHOOT when the model misses the boundary value, OVERSHOOT when it invents it."""
    return F.when((human == boundary) & (model != boundary), "UNDERSHOOT").when((human != boundary) & (model == boundary), "OVERSHOOT")


def shortcut_signals() -> Column:
    """Tag pairs a model seems to infer from each other against the human label."""
    model_has = lambda v: F.array_contains("model_moods", v)
    easy = lambda c: F.array_contains(c, "easy-watch")
    eq = lambda col, v: F.col(col) == v
    return reasons(
        (eq("model_pace", "fast") & eq("model_attention", "immersive") & ~eq("human_attention", "immersive"), "fast -> immersive"),
        (model_has("funny") & eq("model_weight", "light") & ~eq("human_weight", "light"), "funny -> light"),
        (model_has("relaxing") & easy("model_situations") & ~easy("human_situations"), "relaxing -> easy-watch"),
        (model_has("thoughtful") & eq("model_attention", "immersive") & ~eq("human_attention", "immersive"), "thoughtful -> immersive"),
        (model_has("exciting") & eq("model_pace", "fast") & ~eq("human_pace", "fast"), "exciting -> fast"),
    )


def diagnostic_delta(baseline: DataFrame, current: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Change of each count and of the rate of end-of-scale predictions, per field."""
    a = baseline.select("field", *[F.col(c).alias(f"a_{c}") for c in counts], ((F.col("model_1") + F.col("model_3")) / F.col("total")).alias("a_end"))
    b = current.select("field", *[F.col(c).alias(f"b_{c}") for c in counts], ((F.col("model_1") + F.col("model_3")) / F.col("total")).alias("b_end"))
    return a.join(b, "field").select(
        "field", *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"{c}_delta") for c in counts], (F.col("b_end") - F.col("a_end")).alias("endpoint_rate_delta")
    )


def confusion_two_layer(rows: DataFrame) -> DataFrame:
    """Confusion on valid outputs only, and fail-closed containment over everything."""
    d, defect = F.col("disposition"), F.col("human_decision") == "REVISE"
    high, low = d == "VALID_HIGH_RISK", d == "VALID_LOW_RISK"
    n = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(high | low).alias("valid"),
        F.count_if(defect & high).alias("tp"),
        F.count_if(defect & low).alias("fn"),
        F.count_if(~defect & high).alias("fp"),
        F.count_if(~defect & low).alias("tn"),
        F.count_if(defect).alias("defects"),
        F.count_if(defect & ~low).alias("contained"),
        F.count_if(~defect & ~low).alias("over_routed"),
    )
    c = F.col
    clean = c("total") - c("defects")
    zero = lambda part, whole: F.coalesce(rate(part, whole), F.lit(0.0))
    return n.select(
        "*",
        zero(c("valid"), c("total")).alias("valid_rate"),
        rate(c("tp"), c("tp") + c("fn")).alias("sensitivity"),
        rate(c("tn"), c("tn") + c("fp")).alias("specificity"),
        rate(c("tp"), c("tp") + c("fp")).alias("ppv"),
        rate(c("tn"), c("tn") + c("fn")).alias("npv"),
        zero(c("contained"), c("defects")).alias("containment_rate"),
        zero(c("tn"), clean).alias("auto_pass_rate"),
        zero(c("contained") + c("over_routed"), c("total")).alias("burden_rate"),
    )


def severity_breakdown(rows: DataFrame) -> DataFrame:
    outcome = (
        F.when(F.col("disposition") == "VALID_HIGH_RISK", "valid_high_risk")
        .when(F.col("disposition") == "VALID_LOW_RISK", "valid_low_risk")
        .otherwise("invalid_or_failure")
    )
    severe = F.when(F.col("severity") == "SEVERE", F.when(outcome == "valid_low_risk", "SEVERE_PASSED").otherwise("SEVERE_CONTAINED"))
    return rows.where(F.col("human_decision") == "REVISE").groupBy("severity", outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.min(severe).alias("severe_outcome")
    )


def threshold_stop(rows: DataFrame, invalid: Column, severe_miss: Column, threshold: int = 6) -> DataFrame:
    n = rows.agg(F.count_if(invalid).alias("invalid_count"), F.count_if(severe_miss).alias("severe_misses"))
    return n.withColumns({"stop": F.col("invalid_count") >= threshold, "pause": F.col("severe_misses") > 0})


def audit_rates(sample: DataFrame) -> DataFrame:
    d, s = F.col("human_decision"), F.col("severity")
    kinds = {
        "approved": d == "APPROVE",
        "minor": (d == "REVISE") & (s == "MINOR"),
        "severe": (d == "REVISE") & (s == "SEVERE"),
        "rejected": d == "REJECT",
    }
    n = sample.agg(F.count(F.lit(1)).alias("sampled"), *[F.count_if(F.coalesce(k, F.lit(False))).alias(name) for name, k in kinds.items()])
    return n.select("*", *[F.coalesce(rate(F.col(k) * 100.0, F.col("sampled")), F.lit(0.0)).alias(f"{k}_percent") for k in kinds])


def usage_totals(rows: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sums that stay null when no row reported the field."""
    return rows.groupBy(*by).agg(*[F.sum(f).alias(f) for f in fields])


def usage_statistics(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, median, min, max and nearest-rank p90 of an integer field."""
    n = F.col("n")
    order = discrete_quantiles(
        rows, by, value,
        {"__lo": F.floor((n + 1) / 2), "__hi": F.floor((n + 2) / 2), "p90": F.floor((n * 9 + 9) / 10)},
    )
    basic = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return order.join(basic, list(by)).select(
        *by, "n", "mean", ((F.col("__lo") + F.col("__hi")) / 2).alias("median"), "min", "max", "p90"
    )


def cost(input_tokens: Column, output_tokens: Column, thinking: Column, in_price: float, out_price: float) -> Column:
    """Price of one call per million tokens; null when tokens are missing."""
    return input_tokens / 1_000_000 * in_price + (output_tokens + F.coalesce(thinking, F.lit(0))) / 1_000_000 * out_price


def project_to_scale(totals: DataFrame, units: str, rounded: Sequence[str], ceiled: Sequence[str], scales: Sequence[int]) -> DataFrame:
    """Per-unit averages of a one-row total times each target scale."""
    spread = totals.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))
    return spread.select(
        "scale",
        *[F.round(F.col(c) / F.col(units) * F.col("scale")).cast("bigint").alias(c) for c in rounded],
        *[F.ceil(F.col(c) / F.col(units) * F.col("scale")).cast("bigint").alias(c) for c in ceiled],
    )


def arm_summary(rows: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Per arm attempts, validity, matches and tokens, with the verdict over both arms."""
    per_arm = rows.groupBy("arm").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if("valid").alias("valid"),
        F.sum(F.when(F.col("valid"), F.col("ordinal_matches"))).alias("matches"), F.sum("output_tokens").alias("tokens"),
    )
    first, second = arms
    few = Window.partitionBy()  # per_arm has one row per arm
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c))).over(few)
    share = lambda arm: pick(arm, "matches") / pick(arm, "valid")
    spend = lambda arm: pick(arm, "tokens") / pick(arm, "attempted")
    verdict = (
        F.when((spend(second) > spend(first) * 1.5) & (share(second) <= share(first)), "REJECT")
        .when((share(second) > share(first) * 1.02) & (spend(second) <= spend(first) * 1.5), "ADOPT")
        .otherwise("INCONCLUSIVE")
    )
    return per_arm.withColumn("verdict", verdict)


def state_counts(rows: DataFrame, state: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.count_if(F.col(state) == v).alias(v.lower()) for v in values])


def content_risk_summary(rows: DataFrame) -> DataFrame:
    n = rows.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("viability") == "VIABLE").alias("viable"),
        F.count_if(F.col("viability") == "MARGINAL").alias("marginal"), F.coalesce(F.bool_or("heterogeneous"), F.lit(False)).alias("mixed"),
    )
    safe = F.col("viable") + F.col("marginal")
    return n.withColumn(
        "decision",
        F.when(~F.col("mixed") & (F.col("viable") == F.col("pages")), "GO")
        .when(~F.col("mixed") & (safe >= F.ceil(F.col("pages") * 0.75)), "CONDITIONAL")
        .otherwise("NO_GO"),
    )


def event_groups(rows: DataFrame, key: str, kind: str, phase: str) -> DataFrame:
    """Events per id with the distinct types and phases (both short vocabularies)."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        F.array_join(F.sort_array(F.collect_set(kind)), "|").alias("types"),
        F.array_join(F.sort_array(F.collect_set(phase)), "|").alias("phases"),
    )


def rule_contribution(hits: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Per rule what it flags, catches, and catches alone."""
    per_pair = hits.groupBy(key, "rule").agg(F.count(F.lit(1)).alias("hits"))
    rules_per = per_pair.groupBy(key).agg(F.count(F.lit(1)).alias("rules"))
    joined = per_pair.join(rules_per, key).join(records.select(key, (F.col("human_decision") == "REVISE").alias("defect")), key)
    return joined.groupBy("rule").agg(
        F.count(F.lit(1)).alias("flagged"),
        F.count_if("defect").alias("caught"),
        F.count_if(~F.col("defect")).alias("clean_flagged"),
        F.count_if(F.col("defect") & (F.col("rules") == 1)).alias("caught_alone"),
        F.sum("hits").alias("hits"),
    ).withColumn("ppv", F.col("caught") / F.col("flagged"))


def leave_one_out(hits: DataFrame, records: DataFrame, key: str, rules: Sequence[str]) -> DataFrame:
    """Change of true and false positives when one rule is omitted: records only that rule flags."""
    per_key = hits.select(key, "rule").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("rule").alias("rule"))
    alone = per_key.where("n = 1").join(records.select(key, (F.col("human_decision") == "REVISE").alias("defect")), key)
    return alone.groupBy("rule").agg((-F.count_if("defect")).alias("delta_tp"), (-F.count_if(~F.col("defect"))).alias("delta_fp")).where(
        F.col("rule").isin(*rules)
    )


def null_profile(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(
        F.lit(column).alias("column"), F.count(F.lit(1)).alias("total"), F.count(column).alias("present"),
        (F.count(F.lit(1)) - F.count(column)).alias("missing"),
    )


def zero_filled(counts: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Counts for a fixed vocabulary, zero where nothing was counted."""
    spark = counts.sparkSession
    listed = spark.createDataFrame([(v,) for v in values], "v string")
    return listed.join(counts.select(F.col(key).alias("v"), "n"), "v", "left").select(F.col("v").alias(key), F.coalesce("n", F.lit(0)).alias("n"))


def agreement_pattern(first: Column, second: Column, human: Column) -> Column:
    a, b = first == human, second == human
    return (
        F.when(a & b, "BOTH_AGREE").when(~a & ~b, "BOTH_DISAGREE").when(a, "ONLY_FIRST_AGREES").otherwise("ONLY_SECOND_AGREES")
    )


def funnel(rows: DataFrame, stratum: str, flags: dict[str, Column]) -> DataFrame:
    return rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("unique"), *[F.count_if(f).alias(n) for n, f in flags.items()])


def rate_gate(rows: DataFrame, minimum: int = 20) -> DataFrame:
    """At most a tenth of clean rows flagged and of minor rows missed; too few rows decide nothing."""
    clean, minor = F.col("human_decision") == "APPROVE", F.coalesce(F.col("severity") == "MINOR", F.lit(False))
    n = rows.agg(
        F.count_if(clean).alias("clean"), F.count_if(minor).alias("minor"),
        F.count_if(clean & (F.col("disposition") == "VALID_HIGH_RISK")).alias("clean_flagged"),
        F.count_if(minor & (F.col("disposition") == "VALID_LOW_RISK")).alias("minor_missed"),
    )
    c = F.col
    within = (c("clean_flagged") <= F.floor(c("clean") * 0.1)) & (c("minor_missed") <= F.floor(c("minor") * 0.1))
    return n.withColumn(
        "gate", F.when((c("clean") < minimum) | (c("minor") < minimum), "INCONCLUSIVE").when(within, "PASS").otherwise("FAIL")
    )


def input_completeness(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    complete = F.lit(True)
    for path in required:
        complete = complete & F.col(path).isNotNull()
    return rows.agg(F.count_if(complete).alias("complete"), F.count_if(~complete).alias("incomplete"))
