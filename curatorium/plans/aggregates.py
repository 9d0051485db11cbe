"""Grouping, metrics, coverage, usage and gates over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatorium.functions.columns import joined
from curatorium.functions.spread import ranked
from curatorium.operators import aggregates as A
from curatorium.operators import predicates as P
from curatorium.operators import ranking as R
from curatorium.operators.joins import range_join
from curatorium.plans.predicates import judged, readiness
from curatorium.plans.registry import query
from curatorium.schemas import MOODS, PACES, WEIGHTS
from curatorium.sources.projections import CTES, Tables

c = F.col
ORDINAL_PAIRS = {"weight": ("human_weight", "model_weight", WEIGHTS), "pace": ("human_pace", "model_pace", PACES)}


@query(
    "dedup_best_per_key",
    ["corpus"],
    """SELECT id, max(votes) AS votes, arg_max(rating, (votes, rating)) AS rating, (SELECT string_agg(cell, '|' ORDER BY cell) FROM (SELECT DISTINCT cell FROM corpus x WHERE x.id = c.id)) AS cells FROM corpus c GROUP BY id""",
)
def _(t):
    out = A.dedup_best(t.corpus, "id", [c("votes"), c("rating")], ["votes", "rating"], "cell")
    return out.withColumn("cells", joined("cells"))


@query(
    "collapse_identical_duplicates",
    ["corpus"],
    """SELECT id, copies, 1::BIGINT AS identical_contents, contents AS full_contents, contents > 1 AS full_conflict FROM (
       SELECT id, count(*) AS copies, count(DISTINCT (cell, page, source_order, votes, rating, release_date)) AS contents FROM corpus GROUP BY id)""",
)
def _(t):
    described = t.corpus.select("id").join(t.raw("part").select(c("p_partkey").alias("id"), "p_name", "p_brand"), "id")
    same = A.collapse_identical(described, "id").select("id", "copies", c("contents").alias("identical_contents"))
    full = A.collapse_identical(t.corpus, "id").select("id", c("contents").alias("full_contents"), c("conflict").alias("full_conflict"))
    return same.join(full, "id")


@query(
    "partition_integrity",
    ["corpus"],
    """k AS (SELECT l_suppkey AS run, l_partkey AS id, count(*) FILTER (WHERE l_suppkey % 10 = 3 AND l_quantity > 45) AS outside, min(year(l_shipdate)) <> max(year(l_shipdate)) AS crosses,
          count(DISTINCT (l_returnflag, l_linestatus)) > 1 AS conflicts FROM lineitem GROUP BY ALL)
       SELECT run, sum(outside)::BIGINT AS outside, count(*) FILTER (WHERE crosses) AS cross_cell, count(*) FILTER (WHERE conflicts) AS conflicting,
       CASE WHEN sum(outside) > 0 THEN 'MEMBERSHIP_VIOLATION' WHEN count(*) FILTER (WHERE crosses) > 0 THEN 'CROSS_CELL_DUPLICATE' WHEN count(*) FILTER (WHERE conflicts) > 0 THEN 'DUPLICATE_CONFLICT' ELSE 'OK' END AS status FROM k GROUP BY run""",
)
def _(t):
    rows = t.raw("lineitem").select(c("l_suppkey").alias("run"), c("l_partkey").alias("id"), F.year("l_shipdate").alias("cell"), "l_returnflag", "l_linestatus", "l_quantity")
    inside = ~((c("run") % 10 == 3) & (c("l_quantity") > 45))
    return A.partition_integrity(rows, "run", "id", "cell", inside, ["l_returnflag", "l_linestatus"])


@query(
    "merge_exclusions",
    ["exclusions"],
    """SELECT id, min(canonical_id) AS canonical_id, count(DISTINCT canonical_id) > 1 AS conflict, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons, string_agg(DISTINCT provenance, '|' ORDER BY provenance) AS provenance FROM exclusions GROUP BY id""",
)
def _(t):
    return A.merge_exclusions(t.exclusions)


@query("find_duplicates", ["catalogue"], "SELECT title, id, n FROM (SELECT title, id, count(*) OVER (PARTITION BY title) AS n FROM catalogue) WHERE n > 1")
def _(t):
    return A.duplicate_owners(t.catalogue, "title", "id")


@query(
    "identity_index",
    ["exclusions"],
    """SELECT canonical_id, min(tmdb) AS resolved_id, count(*) > 1 AS conflict, count(*) AS ids FROM (
       SELECT canonical_id, id AS tmdb FROM exclusions WHERE canonical_id IS NOT NULL UNION SELECT 'm' || p_partkey, CASE WHEN p_size = 20 THEN p_partkey + 1 ELSE p_partkey END FROM part) GROUP BY 1""",
)
def _(t):
    part = t.raw("part").select(
        F.concat(F.lit("m"), c("p_partkey").cast("string")).alias("canonical_id"),
        F.when(c("p_size") == 20, c("p_partkey") + 1).otherwise(c("p_partkey")).alias("id"),
    )
    return A.identity_index([t.exclusions.where(c("canonical_id").isNotNull()), part], "canonical_id", "id")


@query("count_by", ["corpus"], "SELECT cell, count(*) AS n, row_number() OVER (ORDER BY cell) AS place FROM corpus GROUP BY cell")
def _(t):
    counts = t.corpus.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, [], [c("cell").asc()], [(c("cell"), True)], out="place").orderBy("place")


@query(
    "count_and_rate",
    ["readiness"],
    """SELECT count(*) AS total, count(*) FILTER (WHERE hard_n = 0) AS complete, count(*) FILTER (WHERE length(trim(overview)) >= 30) AS usable_overview, count(*) FILTER (WHERE hard_n = 0 AND flag_n = 0) AS ready,
       round(avg(CAST(hard_n = 0 AS INT)), 6) AS complete_rate, round(avg(CAST(length(trim(overview)) >= 30 AS INT)), 6) AS usable_overview_rate, round(avg(CAST(hard_n = 0 AND flag_n = 0 AS INT)), 6) AS ready_rate FROM readiness""",
)
def _(t):
    flags = {"complete": c("readiness") != "BLOCKED", "usable_overview": F.length(F.trim("overview")) >= 30, "ready": c("readiness") == "AUTOMATICALLY_READY"}
    return readiness(t).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(f).alias(n) for n, f in flags.items()],
        *[F.round(F.avg(f.cast("int")), 6).alias(f"{n}_rate") for n, f in flags.items()],
    )


STATUS_COLUMNS = {"ready": "AUTOMATICALLY_READY", "review": "NEEDS_TARGETED_REVIEW", "blocked": "BLOCKED"}


@query(
    "breakdown_by_dimension",
    ["readiness"],
    """b AS (SELECT (year // 10 * 10) || 's' AS decade, genres[1] AS genre, original_language AS lang, CASE WHEN original_language = 'en' THEN 'English' ELSE 'Non-English' END AS lang_group,
        CASE WHEN votes >= 1000 THEN 'mainstream' WHEN votes >= 500 THEN 'familiar' ELSE 'discovery' END AS band, CASE WHEN hard_n > 0 THEN 'b' WHEN flag_n > 0 THEN 'r' ELSE 'a' END AS s FROM readiness),
       l AS (SELECT 'decade' AS dimension, decade AS value, s FROM b UNION ALL SELECT 'genre', genre, s FROM b UNION ALL SELECT 'lang', lang, s FROM b UNION ALL SELECT 'lang_group', lang_group, s FROM b UNION ALL SELECT 'band', band, s FROM b)
       SELECT dimension, value, count(*) AS total, count(*) FILTER (WHERE s = 'a') AS ready, count(*) FILTER (WHERE s = 'r') AS review, count(*) FILTER (WHERE s = 'b') AS blocked FROM l GROUP BY ALL""",
)
def _(t):
    rows = readiness(t).select(
        P.decade(c("year")).alias("decade"), F.element_at("genres", 1).alias("genre"), c("original_language").alias("lang"),
        F.when(c("original_language") == "en", "English").otherwise("Non-English").alias("lang_group"),
        P.popularity_band(c("votes")).alias("band"), "readiness",
    )
    return A.breakdown(rows, ["decade", "genre", "lang", "lang_group", "band"], "readiness", STATUS_COLUMNS)


CTES["stratified"] = (
    ("facts",),
    """SELECT stratum, count(*) FILTER (WHERE length(overview) >= 40) AS viable, count(*) AS total FROM (
       SELECT overview, unnest(list_distinct(list_concat(['decade:' || (year // 10 * 10) || 's', 'votes:' || CASE WHEN votes < 200 THEN 'lt-200' WHEN votes <= 800 THEN '200-800' ELSE 'gt-800' END, 'language:' || original_language], list_transform(genres, lambda g: 'genre:' || g)))) AS stratum FROM facts) GROUP BY stratum""",
)


def stratified(t: Tables) -> DataFrame:
    strata = F.concat(
        F.array(
            F.concat(F.lit("decade:"), P.decade(c("year"))),
            F.concat(F.lit("votes:"), P.vote_coverage_band(c("votes"))),
            F.concat(F.lit("language:"), "original_language"),
        ),
        F.transform("genres", lambda g: F.concat(F.lit("genre:"), g)),
    )
    return A.coverage_by_strata(t.facts, strata, F.length("overview") >= 40)


@query("coverage_by_strata", ["stratified"], "SELECT stratum, viable, total, round(viable * 1.0 / total, 6) AS coverage FROM stratified")
def _(t):
    return stratified(t).withColumn("coverage", F.round("coverage", 6))


@query(
    "wilson_interval",
    ["stratified"],
    """SELECT stratum, round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS lower, round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS upper
       FROM (SELECT stratum, viable::DOUBLE / total AS p, total::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM stratified)""",
)
def _(t):
    low, high = A.wilson(c("viable"), c("total"))
    return stratified(t).select("stratum", F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"))


CTES["ordinal_long"] = (
    ("human_model",),
    """SELECT id, field, human, model, list_position(scale, human) AS hi, list_position(scale, model) AS mi FROM (
       SELECT id, 'weight' AS field, human_weight AS human, model_weight AS model, ['light','moderate','heavy'] AS scale FROM human_model
       UNION ALL SELECT id, 'pace', human_pace, model_pace, ['slow','medium','fast'] FROM human_model)""",
)


def ordinal_long(t: Tables) -> DataFrame:
    return A.unpivot_ordinals(t.human_model, "id", ORDINAL_PAIRS)


@query("ordinal_agreement", ["ordinal_long"], "SELECT id, field, CASE abs(hi - mi) WHEN 0 THEN 'exact' WHEN 1 THEN 'adjacent' ELSE 'severe' END AS agreement FROM ordinal_long")
def _(t):
    return ordinal_long(t).select("id", "field", A.ordinal_kind(c("hi"), c("mi")).alias("agreement"))


DIAG_SQL = """SELECT field, count(*) AS total, count(*) FILTER (WHERE hi = mi) AS exact, count(*) FILTER (WHERE abs(hi - mi) = 1) AS adjacent, count(*) FILTER (WHERE abs(hi - mi) = 2) AS severe,
  count(*) FILTER (WHERE hi = 1) AS human_1, count(*) FILTER (WHERE hi = 2) AS human_2, count(*) FILTER (WHERE hi = 3) AS human_3, count(*) FILTER (WHERE mi = 1) AS model_1, count(*) FILTER (WHERE mi = 2) AS model_2, count(*) FILTER (WHERE mi = 3) AS model_3,
  count(*) FILTER (WHERE mi = 2 AND hi <> 2) AS center_hedging, round(avg(CAST(mi = 2 AS INT)), 6) AS model_middle_rate, round(avg(CAST(hi = 2 AS INT)), 6) AS human_middle_rate, """


@query(
    "ordinal_diagnostics",
    ["ordinal_long"],
    f"""moves AS (SELECT field, string_agg(tr || '=' || n, '|' ORDER BY tr) AS transitions FROM (SELECT field, human || ' -> ' || model AS tr, count(*) AS n FROM ordinal_long WHERE hi <> mi GROUP BY ALL) GROUP BY field)
    {DIAG_SQL} max(transitions) AS transitions FROM ordinal_long JOIN moves USING (field) GROUP BY field""",
)
def _(t):
    long = ordinal_long(t)
    moves = A.transitions(long).groupBy("field").agg(
        joined(F.sort_array(F.collect_list(F.concat("transition", F.lit("="), c("n").cast("string"))))).alias("transitions")
    )
    out = A.ordinal_diagnostics(long).join(moves, "field")
    return out.withColumns({r: F.round(r, 6) for r in ("model_middle_rate", "human_middle_rate")})


@query(
    "weighted_kappa",
    ["ordinal_long"],
    """n AS (SELECT field, count(*)::DOUBLE AS n, avg(1 - (hi - mi) * (hi - mi) / 4.0) AS o FROM ordinal_long GROUP BY field),
       h AS (SELECT field, hi, count(*)::DOUBLE AS k FROM ordinal_long GROUP BY ALL), m AS (SELECT field, mi, count(*)::DOUBLE AS k FROM ordinal_long GROUP BY ALL),
       e AS (SELECT h.field, sum((1 - (hi - mi) * (hi - mi) / 4.0) * h.k * m.k) AS e FROM h JOIN m ON h.field = m.field GROUP BY 1)
       SELECT n.field, n::BIGINT AS n, round((o - e / n / n) / (1 - e / n / n), 6) AS kappa FROM n JOIN e USING (field)""",
)
def _(t):
    return A.weighted_kappa(ordinal_long(t)).withColumn("kappa", F.round("kappa", 6))


@query(
    "multilabel_metrics",
    ["human_model"],
    f"""m AS (SELECT label, count(*) FILTER (WHERE list_contains(human_moods, label) AND list_contains(model_moods, label)) AS tp, count(*) FILTER (WHERE NOT list_contains(human_moods, label) AND list_contains(model_moods, label)) AS fp,
         count(*) FILTER (WHERE list_contains(human_moods, label) AND NOT list_contains(model_moods, label)) AS fn FROM human_model, (SELECT unnest({MOODS}) AS label) GROUP BY label)
       SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0 THEN 2 * tp + fp + fn ELSE 0 END, 0), 6) AS f1 FROM m""",
)
def _(t):
    out = A.multilabel_metrics(t.human_model, "human_moods", "model_moods", MOODS)
    return out.withColumns({r: F.round(r, 6) for r in ("precision", "recall", "f1")})


@query(
    "calibration_summary",
    ["human_model"],
    """x AS (SELECT *, len(list_intersect(human_moods, model_moods)) AS i, len(list_distinct(list_concat(human_moods, model_moods))) AS u, abs(list_position(['light','moderate','heavy'], human_weight) - list_position(['light','moderate','heavy'], model_weight)) AS w,
         abs(list_position(['slow','medium','fast'], human_pace) - list_position(['slow','medium','fast'], model_pace)) AS p FROM human_model)
       SELECT count(*) AS n, round(avg(CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE i::DOUBLE / u END), 6) AS mean_jaccard, count(*) FILTER (WHERE i = u) AS exact_sets, count(*) FILTER (WHERE len(model_moods) > len(human_moods)) AS over_tagged, count(*) FILTER (WHERE u > 0 AND i = 0) AS disjoint_sets,
        count(*) FILTER (WHERE w = 0) AS weight_exact, count(*) FILTER (WHERE w = 1) AS weight_adjacent, count(*) FILTER (WHERE w = 2) AS weight_severe, count(*) FILTER (WHERE p = 0) AS pace_exact, count(*) FILTER (WHERE p = 1) AS pace_adjacent, count(*) FILTER (WHERE p = 2) AS pace_severe FROM x""",
)
def _(t):
    return A.calibration_summary(t.human_model, "human_moods", "model_moods", ORDINAL_PAIRS).withColumn("mean_jaccard", F.round("mean_jaccard", 6))


@query(
    "dealbreaker_risk",
    ["human_model"],
    """SELECT field, risk, count(*) AS n FROM (
       SELECT 'weight' AS field, CASE WHEN human_weight = 'heavy' AND model_weight <> 'heavy' THEN 'UNDERSHOOT' WHEN human_weight <> 'heavy' AND model_weight = 'heavy' THEN 'OVERSHOOT' END AS risk FROM human_model
       UNION ALL SELECT 'pace', CASE WHEN human_pace = 'slow' AND model_pace <> 'slow' THEN 'UNDERSHOOT' WHEN human_pace <> 'slow' AND model_pace = 'slow' THEN 'OVERSHOOT' END FROM human_model) WHERE risk IS NOT NULL GROUP BY ALL""",
)
def _(t):
    long = ordinal_long(t)
    boundary = F.when(c("field") == "weight", "heavy").otherwise("slow")
    risk = A.dealbreaker_risk(c("human"), c("model"), boundary)
    return long.select("field", risk.alias("risk")).where(c("risk").isNotNull()).groupBy("field", "risk").agg(F.count(F.lit(1)).alias("n"))


@query(
    "shortcut_signals",
    ["human_model"],
    """s AS (SELECT unnest([CASE WHEN model_pace = 'fast' AND model_weight = 'heavy' AND human_weight <> 'heavy' THEN 'fast -> immersive' END,
        CASE WHEN list_contains(model_moods, 'funny') AND model_weight = 'light' AND human_weight <> 'light' THEN 'funny -> light' END,
        CASE WHEN list_contains(model_moods, 'relaxing') AND model_pace = 'slow' AND human_pace <> 'slow' THEN 'relaxing -> easy-watch' END,
        CASE WHEN list_contains(model_moods, 'thoughtful') AND model_weight = 'heavy' AND human_weight <> 'heavy' THEN 'thoughtful -> immersive' END,
        CASE WHEN list_contains(model_moods, 'exciting') AND model_pace = 'fast' AND human_pace <> 'fast' THEN 'exciting -> fast' END]) AS signal FROM human_model)
       SELECT signal, count(*) AS n FROM s WHERE signal IS NOT NULL GROUP BY signal""",
)
def _(t):
    attention = lambda w: F.when(c(w) == "heavy", "immersive").when(c(w) == "moderate", "engaged").otherwise("easy")
    place = lambda p: F.when(c(p) == "slow", F.array(F.lit("easy-watch"))).otherwise(F.array(F.lit("alone")))
    rows = t.human_model.withColumns(
        {"human_attention": attention("human_weight"), "model_attention": attention("model_weight"), "human_situations": place("human_pace"), "model_situations": place("model_pace")}
    )
    return rows.select(F.explode(A.shortcut_signals()).alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


@query(
    "diagnostic_delta",
    ["ordinal_long"],
    """d AS (SELECT *, CASE WHEN mi = 2 THEN 1 ELSE mi END AS mj FROM ordinal_long)
       SELECT field, count(*) FILTER (WHERE hi = mj) - count(*) FILTER (WHERE hi = mi) AS exact_delta, count(*) FILTER (WHERE abs(hi - mj) = 2) - count(*) FILTER (WHERE abs(hi - mi) = 2) AS severe_delta,
        round(count(*) FILTER (WHERE mj <> 2)::DOUBLE / count(*) - count(*) FILTER (WHERE mi <> 2)::DOUBLE / count(*), 6) AS endpoint_rate_delta FROM d GROUP BY field""",
)
def _(t):
    long = ordinal_long(t)
    bolder = long.withColumn("mi", F.when(c("mi") == 2, 1).otherwise(c("mi")))
    out = A.diagnostic_delta(A.ordinal_diagnostics(long), A.ordinal_diagnostics(bolder), ["exact", "severe"])
    return out.withColumn("endpoint_rate_delta", F.round("endpoint_rate_delta", 6))


CTES["adjudicated"] = (("review",), "SELECT * FROM review WHERE human_decision IS NOT NULL")


def adjudicated(t: Tables) -> DataFrame:
    return t.review.where(c("human_decision").isNotNull())


@query(
    "confusion_two_layer",
    ["adjudicated"],
    """n AS (SELECT count(*) AS total, count(*) FILTER (WHERE disposition LIKE 'VALID%') AS valid, count(*) FILTER (WHERE human_decision = 'REVISE' AND disposition = 'VALID_HIGH_RISK') AS tp, count(*) FILTER (WHERE human_decision = 'REVISE' AND disposition = 'VALID_LOW_RISK') AS fn,
        count(*) FILTER (WHERE human_decision <> 'REVISE' AND disposition = 'VALID_HIGH_RISK') AS fp, count(*) FILTER (WHERE human_decision <> 'REVISE' AND disposition = 'VALID_LOW_RISK') AS tn, count(*) FILTER (WHERE human_decision = 'REVISE') AS defects,
        count(*) FILTER (WHERE human_decision = 'REVISE' AND disposition <> 'VALID_LOW_RISK') AS contained, count(*) FILTER (WHERE human_decision <> 'REVISE' AND disposition <> 'VALID_LOW_RISK') AS over_routed FROM adjudicated)
       SELECT *, round(valid / total, 6) AS valid_rate, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(tn / nullif(tn + fn, 0), 6) AS npv,
        round(coalesce(contained / nullif(defects, 0), 0), 6) AS containment_rate, round(coalesce(tn / nullif(total - defects, 0), 0), 6) AS auto_pass_rate, round((contained + over_routed) / total, 6) AS burden_rate FROM n""",
)
def _(t):
    out = A.confusion_two_layer(adjudicated(t))
    rates = ["valid_rate", "sensitivity", "specificity", "ppv", "npv", "containment_rate", "auto_pass_rate", "burden_rate"]
    return out.withColumns({r: F.round(r, 6) for r in rates})


@query(
    "severity_breakdown",
    ["review"],
    """SELECT severity, CASE disposition WHEN 'VALID_HIGH_RISK' THEN 'valid_high_risk' WHEN 'VALID_LOW_RISK' THEN 'valid_low_risk' ELSE 'invalid_or_failure' END AS outcome, count(*) AS n,
       min(CASE WHEN severity = 'SEVERE' THEN CASE WHEN disposition = 'VALID_LOW_RISK' THEN 'SEVERE_PASSED' ELSE 'SEVERE_CONTAINED' END END) AS severe_outcome FROM review WHERE human_decision = 'REVISE' GROUP BY 1, 2""",
)
def _(t):
    return A.severity_breakdown(t.review)


@query(
    "threshold_stop",
    ["review"],
    """SELECT count(*) FILTER (WHERE disposition IN ('SCHEMA_INVALID','SEMANTICALLY_INVALID')) AS invalid_count, count(*) FILTER (WHERE severity = 'SEVERE' AND disposition = 'VALID_LOW_RISK') AS severe_misses,
       count(*) FILTER (WHERE disposition IN ('SCHEMA_INVALID','SEMANTICALLY_INVALID')) >= 6 AS stop, count(*) FILTER (WHERE severity = 'SEVERE' AND disposition = 'VALID_LOW_RISK') > 0 AS pause FROM review""",
)
def _(t):
    invalid = c("disposition").isin("SCHEMA_INVALID", "SEMANTICALLY_INVALID")
    return A.threshold_stop(t.review, invalid, (c("severity") == "SEVERE") & (c("disposition") == "VALID_LOW_RISK"))


@query(
    "audit_sample_rates",
    ["adjudicated"],
    """k AS (SELECT candidate_id, row_number() OVER (ORDER BY sha256('rate-seed|' || candidate_id), candidate_id) AS rn, count(*) OVER () AS n FROM review), s AS (SELECT a.* FROM adjudicated a JOIN k USING (candidate_id) WHERE rn <= (n * 33 + 99) // 100)
       SELECT count(*) AS sampled, count(*) FILTER (WHERE human_decision = 'APPROVE') AS approved, count(*) FILTER (WHERE severity = 'MINOR') AS minor, count(*) FILTER (WHERE severity = 'SEVERE') AS severe, 0::BIGINT AS rejected,
        round(100.0 * count(*) FILTER (WHERE human_decision = 'APPROVE') / count(*), 6) AS approved_percent, round(100.0 * count(*) FILTER (WHERE severity = 'MINOR') / count(*), 6) AS minor_percent, round(100.0 * count(*) FILTER (WHERE severity = 'SEVERE') / count(*), 6) AS severe_percent, 0.0::DOUBLE AS rejected_percent FROM s""",
)
def _(t):
    sample = R.sample_rate(t.review.select("candidate_id"), [], R.seeded_hash("rate-seed", "candidate_id"), "candidate_id", F.lit(33))
    out = A.audit_rates(adjudicated(t).join(sample, "candidate_id", "left_semi"))
    return out.withColumns({f"{k}_percent": F.round(f"{k}_percent", 6) for k in ("approved", "minor", "severe", "rejected")})


USAGE_FIELDS = ["input_tokens", "output_tokens", "thinking_tokens", "cached_tokens"]


@query("usage_totals", ["usage"], "SELECT arm, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(thinking_tokens)::BIGINT AS thinking_tokens, sum(cached_tokens)::BIGINT AS cached_tokens FROM usage GROUP BY arm")
def _(t):
    return A.usage_totals(t.usage, USAGE_FIELDS, ["arm"])


@query(
    "usage_statistics",
    ["usage"],
    """SELECT arm, count(*) AS n, round(avg(output_tokens), 4) AS mean, median(output_tokens) AS median, min(output_tokens) AS min, max(output_tokens) AS max, quantile_disc(output_tokens, 0.9) AS p90 FROM usage GROUP BY arm""",
)
def _(t):
    return A.usage_statistics(t.usage, ["arm"], "output_tokens").withColumn("mean", F.round("mean", 4))


@query(
    "cost_per_call",
    ["usage"],
    """SELECT candidate_id, attempt, count(*) AS calls, count(input_tokens) AS priced, sum(CAST(input_tokens * 75 + (output_tokens + coalesce(thinking_tokens, 0)) * 375 AS BIGINT))::BIGINT AS hundred_millionths FROM usage GROUP BY ALL""",
)
def _(t):
    price = A.cost(c("input_tokens"), c("output_tokens"), c("thinking_tokens"), 0.75, 3.75)
    return t.usage.withColumn("usd", price).groupBy("candidate_id", "attempt").agg(
        F.count(F.lit(1)).alias("calls"), F.count("usd").alias("priced"), F.sum(F.round(c("usd") * 100_000_000).cast("bigint")).alias("hundred_millionths")
    )


@query(
    "project_cost_to_scale",
    ["usage"],
    """t AS (SELECT count(DISTINCT candidate_id) AS units, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, count(*) AS requests FROM usage)
       SELECT scale, CAST(round(input_tokens / units * scale) AS BIGINT) AS input_tokens, CAST(round(output_tokens / units * scale) AS BIGINT) AS output_tokens, CAST(ceil(requests / units * scale) AS BIGINT) AS requests FROM t, (SELECT unnest([25, 50, 100, 250, 1000]) AS scale)""",
)
def _(t):
    totals = t.usage.agg(
        F.count_distinct("candidate_id").alias("units"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("requests")
    )
    return A.project_to_scale(totals, "units", ["input_tokens", "output_tokens"], ["requests"], [25, 50, 100, 250, 1000])


@query(
    "arm_summary",
    ["usage"],
    """a AS (SELECT arm, count(*) AS attempted, count(*) FILTER (WHERE valid) AS valid, sum(ordinal_matches) FILTER (WHERE valid)::BIGINT AS matches, sum(output_tokens)::BIGINT AS tokens FROM usage GROUP BY arm),
       v AS (SELECT CASE WHEN m.tokens / m.attempted > h.tokens / h.attempted * 1.5 AND m.matches / m.valid <= h.matches / h.valid THEN 'REJECT' WHEN m.matches / m.valid > h.matches / h.valid * 1.02 AND m.tokens / m.attempted <= h.tokens / h.attempted * 1.5 THEN 'ADOPT' ELSE 'INCONCLUSIVE' END AS verdict FROM a h JOIN a m ON h.arm = 'high' AND m.arm = 'max')
       SELECT a.*, verdict FROM a, v""",
)
def _(t):
    return A.arm_summary(t.usage, ["high", "max"])


STATES = ["INTENT", "FETCHING", "RESPONSE", "TERMINAL", "FAILED"]


@query(
    "state_counts",
    ["ledger"],
    "SELECT day, " + ", ".join(f"count(*) FILTER (WHERE lifecycle = '{s}') AS {s.lower()}" for s in STATES) + " FROM ledger GROUP BY day",
)
def _(t):
    return A.state_counts(t.ledger, "lifecycle", STATES, ["day"])


@query(
    "class_conditioned_coverage",
    (),
    """r AS (SELECT coalesce(l.quality, 0) = 1 AS gold, d.n_chars >= 1000 AS available, CASE d.lang WHEN 'fr' THEN 'HEADING_VARIANT' WHEN 'de' THEN 'HEADING_NESTED' WHEN 'es' THEN 'COMBINED_HEADING' ELSE 'NO_STRUCTURE' END AS classification FROM documents d LEFT JOIN labels l USING (doc_id)),
       k AS (SELECT string_agg(DISTINCT classification, '|' ORDER BY classification) FILTER (WHERE NOT available) AS missing_kinds FROM r)
       SELECT gold, count(*) FILTER (WHERE available) AS available, count(*) FILTER (WHERE NOT available) AS missing, count(*) AS total, any_value(missing_kinds) AS missing_kinds, any_value(CASE WHEN contains(missing_kinds, 'HEADING_NESTED') THEN 'REQUIRES_REVIEW' ELSE 'NOT_INDICATED' END) AS nested_policy FROM r, k GROUP BY gold""",
)
def _(t):
    lang = c("lang")
    rows = t.raw("documents").join(t.raw("labels"), "doc_id", "left").select(
        (F.coalesce("quality", F.lit(0)) == 1).alias("gold"),
        (c("n_chars") >= 1000).alias("available"),
        F.when(lang == "fr", "HEADING_VARIANT").when(lang == "de", "HEADING_NESTED").when(lang == "es", "COMBINED_HEADING").otherwise("NO_STRUCTURE").alias("classification"),
    )
    per_class = rows.groupBy("gold", "classification").agg(F.count_if("available").alias("a"), F.count_if(~c("available")).alias("m"))
    whole = Window.partitionBy()  # a handful of (class, classification) rows
    kinds = joined(F.sort_array(F.collect_set(F.when(c("m") > 0, c("classification"))).over(whole)))
    tagged = per_class.withColumn("missing_kinds", kinds)
    return tagged.groupBy("gold", "missing_kinds").agg(F.sum("a").alias("available"), F.sum("m").alias("missing"), (F.sum("a") + F.sum("m")).alias("total")).withColumn(
        "nested_policy", F.when(c("missing_kinds").contains("HEADING_NESTED"), "REQUIRES_REVIEW").otherwise("NOT_INDICATED")
    )


@query(
    "group_event_ledger",
    ["ledger"],
    """SELECT attempt_id, count(*) AS events, string_agg(DISTINCT lifecycle, '|' ORDER BY lifecycle) AS types, string_agg(DISTINCT phase, '|' ORDER BY phase) AS phases FROM (SELECT *, CASE WHEN day(day) <= 15 THEN 'early' ELSE 'late' END AS phase FROM ledger WHERE lifecycle <> 'FAILED') GROUP BY attempt_id""",
)
def _(t):
    # failed events carry no usable id
    rows = t.ledger.withColumns({"id": F.when(c("lifecycle") != "FAILED", c("attempt_id")), "phase": F.when(F.dayofmonth("day") <= 15, "early").otherwise("late")})
    return A.event_groups(rows, "id", "lifecycle", "phase").withColumnRenamed("id", "attempt_id")


@query("poster_readiness", ["facts"], "SELECT 'poster_path' AS \"column\", count(*) AS total, count(poster_path) AS present, count(*) - count(poster_path) AS missing FROM facts")
def _(t):
    return A.null_profile(t.facts, "poster_path")


@query("null_profile", ["facts"], "SELECT id, title FROM facts WHERE poster_path IS NULL")
def _(t):
    return t.facts.where(c("poster_path").isNull()).select("id", "title").orderBy("id")


FIELDS = ["description", "why_watch", "curiosity_hook", "vibe_summary", "palette"]


@query(
    "defect_tallies",
    ["review"],
    f"""SELECT f.field, count(d.field) AS n FROM (SELECT unnest({FIELDS}) AS field) f LEFT JOIN (SELECT unnest(human_fields) AS field FROM review WHERE human_decision = 'REVISE') d ON d.field = f.field GROUP BY f.field""",
)
def _(t):
    counts = t.review.where("human_decision = 'REVISE'").select(F.explode("human_fields").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    return A.zero_filled(counts, "field", FIELDS)


@query(
    "agreement_pattern",
    ["adjudicated"],
    """SELECT CASE WHEN a AND b THEN 'BOTH_AGREE' WHEN NOT a AND NOT b THEN 'BOTH_DISAGREE' WHEN a THEN 'ONLY_FIRST_AGREES' ELSE 'ONLY_SECOND_AGREES' END AS pattern, count(*) AS n FROM (
       SELECT CASE WHEN disposition = 'VALID_HIGH_RISK' THEN 'REVISE' ELSE 'APPROVE' END = human_decision AS a, CASE WHEN n_chars < 400 THEN 'REVISE' ELSE 'APPROVE' END = human_decision AS b FROM adjudicated) GROUP BY 1""",
)
def _(t):
    first = F.when(c("disposition") == "VALID_HIGH_RISK", "REVISE").otherwise("APPROVE")
    second = F.when(c("n_chars") < 400, "REVISE").otherwise("APPROVE")
    return adjudicated(t).groupBy(A.agreement_pattern(first, second, c("human_decision")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query("exposure_membership", ["exclusions"], "SELECT id, string_agg(DISTINCT provenance || ':' || reason, '|' ORDER BY provenance || ':' || reason) AS exposures, count(DISTINCT provenance) AS sets FROM exclusions GROUP BY id")
def _(t):
    return t.exclusions.groupBy("id").agg(
        joined(F.sort_array(F.collect_set(F.concat("provenance", F.lit(":"), "reason")))).alias("exposures"), F.count_distinct("provenance").alias("sets")
    )


@query(
    "generalization_coverage",
    ["catalogue"],
    """f AS (SELECT 'pace' AS field, unnest(['slow','medium','fast','frantic']) AS value UNION ALL SELECT 'mood', unnest(['funny','exciting','thoughtful','relaxing','emotional','suspenseful']) UNION ALL SELECT 'mood_count', unnest(['0','1','2','3'])),
       x AS (SELECT 'pace' AS field, pace AS value FROM catalogue UNION ALL SELECT 'mood', unnest(moods) FROM catalogue UNION ALL SELECT 'mood_count', CAST(len(moods) AS VARCHAR) FROM catalogue)
       SELECT f.field, f.value, count(x.value) AS n FROM f LEFT JOIN x ON x.field = f.field AND x.value = f.value GROUP BY ALL""",
)
def _(t):
    pair = lambda f, v: F.named_struct(F.lit("field"), F.lit(f), F.lit("value"), v)
    seen = t.catalogue.select(
        F.explode(F.concat(F.array(pair("pace", c("pace")), pair("mood_count", F.size("moods").cast("string"))), F.transform("moods", lambda m: pair("mood", m)))).alias("x")
    ).select("x.*").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    wanted = {"pace": [*PACES, "frantic"], "mood": MOODS, "mood_count": ["0", "1", "2", "3"]}
    parts = [A.zero_filled(seen.where(c("field") == f), "value", v).withColumn("field", F.lit(f)) for f, v in wanted.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "selection_funnel",
    ["corpus", "strata", "exclusions"],
    """u AS (SELECT stratum, any_value(quota) AS quota, c.id, count(*) AS copies, max(votes) AS votes FROM corpus c JOIN strata s ON release_date BETWEEN gte AND lte GROUP BY stratum, c.id),
       f AS (SELECT *, votes >= 20000 AS eligible, id IN (SELECT id FROM exclusions) AS held FROM u)
       SELECT stratum, sum(copies)::BIGINT AS raw, count(*) AS "unique", count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE eligible AND held) AS excluded, count(*) FILTER (WHERE eligible AND NOT held) AS remaining, least(any_value(quota), count(*) FILTER (WHERE eligible AND NOT held)) AS selected FROM f GROUP BY stratum""",
)
def _(t):
    unique = range_join(t.corpus, t.strata, "release_date", "gte", "lte").groupBy("stratum", "quota", "id").agg(F.count(F.lit(1)).alias("copies"), F.max("votes").alias("votes"))
    held = t.exclusions.select("id").distinct().withColumn("held", F.lit(True))
    flagged = unique.join(held, "id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    ok = c("votes") >= 20000
    out = A.funnel(flagged, "stratum", {"eligible": ok, "excluded": ok & c("held"), "remaining": ok & ~c("held")})
    raw = flagged.groupBy("stratum").agg(F.sum("copies").alias("raw"), F.max("quota").alias("quota"))
    return out.join(raw, "stratum").withColumn("selected", F.least("quota", "remaining")).drop("quota")


@query(
    "rate_gate",
    ["adjudicated"],
    """n AS (SELECT count(*) FILTER (WHERE human_decision = 'APPROVE') AS clean, count(*) FILTER (WHERE severity = 'MINOR') AS minor, count(*) FILTER (WHERE human_decision = 'APPROVE' AND disposition = 'VALID_HIGH_RISK') AS clean_flagged, count(*) FILTER (WHERE severity = 'MINOR' AND disposition = 'VALID_LOW_RISK') AS minor_missed FROM adjudicated)
       SELECT *, CASE WHEN clean < 20 OR minor < 20 THEN 'INCONCLUSIVE' WHEN clean_flagged <= floor(clean * 0.1) AND minor_missed <= floor(minor * 0.1) THEN 'PASS' ELSE 'FAIL' END AS gate FROM n""",
)
def _(t):
    return A.rate_gate(adjudicated(t))


@query(
    "input_completeness",
    ["review"],
    "SELECT count(*) FILTER (WHERE disposition LIKE '%LOW_RISK' OR disposition LIKE 'S%') AS complete, count(*) FILTER (WHERE NOT (disposition LIKE '%LOW_RISK' OR disposition LIKE 'S%')) AS incomplete FROM review",
)
def _(t):
    return A.input_completeness(judged(t), ["payload.riskLevel", "payload.issues", "payload.lowRiskCoverage"])
