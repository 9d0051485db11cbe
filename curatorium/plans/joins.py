"""Joins, reconciliation and comparison over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import digest, joined, reasons
from curatorium.operators import joins as J
from curatorium.operators import predicates as P
from curatorium.operators import ranking
from curatorium.operators import titles as N
from curatorium.operators.aggregates import identity_index
from curatorium.plans.checks import editorial
from curatorium.plans.predicates import routing
from curatorium.plans.registry import query
from curatorium.sources.projections import CTES, Tables

c = F.col


@query(
    "join_facts_strict",
    ["catalogue", "facts"],
    """cur AS (SELECT id, title, CASE WHEN runtime_minutes = 150 THEN tmdb_id + 1 ELSE tmdb_id END AS tmdb_id FROM catalogue)
       SELECT c.id, c.title, f.director, f.votes, f.release_date, 'JOINED' AS code FROM cur c JOIN facts f USING (id)
       UNION ALL SELECT CAST(tmdb_id AS VARCHAR), NULL, NULL, NULL, NULL, 'DUPLICATE_TMDB_ID' FROM cur GROUP BY tmdb_id HAVING count(*) > 1
       UNION ALL SELECT id, NULL, NULL, NULL, NULL, 'DUPLICATE_ID' FROM cur GROUP BY id HAVING count(*) > 1
       UNION ALL SELECT id, NULL, NULL, NULL, NULL, 'MISSING_FACTS' FROM cur WHERE id NOT IN (SELECT id FROM facts)
       UNION ALL SELECT c.id, NULL, NULL, NULL, NULL, 'ID_MISMATCH' FROM cur c JOIN facts f USING (id) WHERE c.tmdb_id <> f.tmdb_id""",
)
def _(t):
    # some curated rows carry the id of their neighbour
    wrong = F.when(c("runtime_minutes") == 150, c("tmdb_id") + 1).otherwise(c("tmdb_id"))
    rows, report = J.join_facts_strict(t.catalogue.select("id", "title", wrong.alias("tmdb_id")), t.facts)
    joined_rows = rows.select("id", "title", "director", "votes", "release_date", F.lit("JOINED").alias("code"))
    return joined_rows.unionByName(report.select(c("value").alias("id"), "code"), allowMissingColumns=True)


# mapping with repeated, missing, surplus and wrong entries
CTES["mapping"] = (
    (),
    """SELECT 'm' || p_partkey AS id, CASE WHEN p_size = 14 THEN p_partkey + 1 ELSE p_partkey END AS tmdb_id FROM part WHERE p_size <> 13
       UNION ALL SELECT 'm' || p_partkey, p_partkey FROM part WHERE p_size = 12
       UNION ALL SELECT 'gone' || p_partkey, 1000000000 + p_partkey FROM part WHERE p_size = 11""",
)


def mapping(t: Tables) -> DataFrame:
    part, key = t.raw("part"), c("p_partkey")
    m = F.concat(F.lit("m"), key.cast("string"))
    return (
        part.where("p_size <> 13").select(m.alias("id"), F.when(c("p_size") == 14, key + 1).otherwise(key).alias("tmdb_id"))
        .unionByName(part.where("p_size = 12").select(m.alias("id"), key.alias("tmdb_id")))
        .unionByName(part.where("p_size = 11").select(F.concat(F.lit("gone"), key.cast("string")).alias("id"), (key + 1000000000).alias("tmdb_id")))
    )


@query(
    "reconcile_one_to_one",
    ["catalogue", "facts", "mapping"],
    """mm AS (SELECT id, count(*) AS n, min(tmdb_id) AS tmdb_id FROM mapping GROUP BY id)
SELECT 'DUPLICATE_MAPPING_ID' AS code, id AS value FROM mm WHERE n > 1
UNION ALL SELECT 'MAPPING_WITHOUT_CURATED_ROW', id FROM mm WHERE id NOT IN (SELECT id FROM catalogue)
UNION ALL SELECT 'MISSING_MAPPING', id FROM catalogue WHERE id NOT IN (SELECT id FROM mm)
UNION ALL SELECT 'MISSING_FACTUAL_SNAPSHOT', id FROM catalogue WHERE id NOT IN (SELECT id FROM facts)
UNION ALL SELECT 'MAPPING_ID_DIFFERS', c.id FROM catalogue c JOIN mm ON mm.id = c.id WHERE mm.tmdb_id <> c.tmdb_id
UNION ALL SELECT 'DUPLICATE_MAPPED_TMDB_ID', CAST(tmdb_id AS VARCHAR) FROM mapping GROUP BY tmdb_id HAVING count(*) > 1""",
)
def _(t):
    return J.reconcile_one_to_one(t.catalogue, mapping(t), t.facts)


@query(
    "reconcile_membership",
    ["catalogue", "facts", "mapping"],
    """SELECT id, sum(a)::BIGINT AS curated, sum(b)::BIGINT AS mapped, sum(f)::BIGINT AS facts FROM (
       SELECT id, 1 AS a, 0 AS b, 0 AS f FROM catalogue UNION ALL SELECT id, 0, 1, 0 FROM mapping UNION ALL SELECT id, 0, 0, 1 FROM facts)
       GROUP BY id HAVING sum(a) <> 1 OR sum(b) <> 1 OR sum(f) <> 1""",
)
def _(t):
    return J.reconcile_membership({"curated": t.catalogue, "mapped": mapping(t), "facts": t.facts}, "id")


CTES["shipments"] = (
    (),
    "SELECT l_partkey AS tmdb_id, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS last_flag, count(*) AS n FROM lineitem GROUP BY l_partkey",
)


def shipments(t: Tables) -> DataFrame:
    latest = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return t.raw("lineitem").groupBy(c("l_partkey").alias("tmdb_id")).agg(F.max_by("l_returnflag", latest).alias("last_flag"), F.count(F.lit(1)).alias("n"))


@query(
    "join_readiness_wide",
    ["catalogue", "facts", "shipments", "exclusions"],
    """wide AS (SELECT c.id, c.tmdb_id, COALESCE(s.last_flag IN ('A','N'), false) AS semantic_ready, COALESCE(f.runtime_minutes > 0 AND f.tmdb_id > 0, false) AS facts_ready,
   length(c.vibe_summary) >= 17 AS editorial_ready, c.palette[2] <> '#zz0000' AND c.palette[1] <> c.palette[2] AS palette_ready,
   COALESCE(s.n >= 25, false) AS decided, e.id IS NOT NULL AS in_runtime, COALESCE(f.year % 2 = 0 AND s.last_flag = 'R', false) AS year_conflict, COALESCE(f.poster_path IS NULL AND f.id IS NOT NULL, false) AS poster_conflict
   FROM catalogue c LEFT JOIN facts f ON f.id = c.id LEFT JOIN shipments s ON s.tmdb_id = c.tmdb_id LEFT JOIN (SELECT DISTINCT id FROM exclusions) e ON e.id = c.tmdb_id),
 w2 AS (SELECT *, semantic_ready AND facts_ready AND editorial_ready AND palette_ready AND decided AND NOT (year_conflict OR poster_conflict) AND NOT in_runtime AS promotion_ready FROM wide)
SELECT id, promotion_ready, concat_ws('|', CASE WHEN year_conflict THEN 'year-conflict' END, CASE WHEN poster_conflict THEN 'poster-missing' END) AS conflicts,
 concat_ws('|', CASE WHEN semantic_ready THEN 'semantic-ready' END, CASE WHEN facts_ready THEN 'facts-ready' END, CASE WHEN NOT editorial_ready THEN 'editorial-missing' END,
  CASE WHEN NOT palette_ready THEN 'palette-missing' END, CASE WHEN NOT decided THEN 'human-decision-missing' END, CASE WHEN year_conflict OR poster_conflict THEN 'identity-review' END,
  CASE WHEN in_runtime THEN 'already-in-runtime' END, CASE WHEN NOT promotion_ready THEN 'promotion-blocked' END) AS categories FROM w2""",
)
def _(t):
    facts = t.facts.select("id", c("runtime_minutes").alias("f_minutes"), c("year").alias("f_year"), "poster_path", c("tmdb_id").alias("f_tmdb"))
    runtime = t.exclusions.select(c("id").alias("tmdb_id")).distinct().withColumn("in_runtime", F.lit(True))
    no = lambda x: F.coalesce(x, F.lit(False))
    wide = (
        t.catalogue.join(facts, "id", "left").join(shipments(t), "tmdb_id", "left").join(runtime, "tmdb_id", "left")
        .select(
            "id",
            no(c("last_flag").isin("A", "N")).alias("semantic"),
            no((c("f_minutes") > 0) & (c("f_tmdb") > 0)).alias("facts"),
            (F.length("vibe_summary") >= 17).alias("editorial"),
            ((F.element_at("palette", 2) != "#zz0000") & (F.element_at("palette", 1) != F.element_at("palette", 2))).alias("palette_ok"),
            no(c("n") >= 25).alias("decided"),
            no(c("in_runtime")).alias("in_runtime"),
            reasons(
                (no((c("f_year") % 2 == 0) & (c("last_flag") == "R")), "year-conflict"),
                (no(c("poster_path").isNull() & c("f_tmdb").isNotNull()), "poster-missing"),
            ).alias("conflicts"),
        )
    )
    conflict = F.size("conflicts") > 0
    ready = c("semantic") & c("facts") & c("editorial") & c("palette_ok") & c("decided") & ~conflict & ~c("in_runtime")
    return wide.select(
        "id",
        ready.alias("promotion_ready"),
        joined("conflicts").alias("conflicts"),
        joined(
            reasons(
                (c("semantic"), "semantic-ready"), (c("facts"), "facts-ready"), (~c("editorial"), "editorial-missing"),
                (~c("palette_ok"), "palette-missing"), (~c("decided"), "human-decision-missing"), (conflict, "identity-review"),
                (c("in_runtime"), "already-in-runtime"), (~ready, "promotion-blocked"),
            )
        ).alias("categories"),
    )


@query(
    "join_snapshot_diff",
    ["facts"],
    """SELECT id, 'title' AS field, title AS before, upper(title) AS after FROM facts WHERE runtime_minutes = 90
       UNION ALL SELECT id, 'year', CAST(year AS VARCHAR), CAST(year + 1 AS VARCHAR) FROM facts WHERE runtime_minutes = 92
       UNION ALL SELECT id, 'genres', array_to_string(list_sort(list_distinct(genres)), '|'), array_to_string(list_sort(list_distinct(list_append(genres, 'noir'))), '|') FROM facts WHERE runtime_minutes = 94
       UNION ALL SELECT id, 'poster_path', NULL, '/new.jpg' FROM facts WHERE poster_path IS NULL""",
)
def _(t):
    m = c("runtime_minutes")
    new = t.facts.withColumns(
        {
            "title": F.when(m == 90, F.upper("title")).otherwise(c("title")),
            "year": F.when(m == 92, c("year") + 1).otherwise(c("year")),
            "genres": F.when(m == 94, F.array_append("genres", F.lit("noir"))).otherwise(F.reverse("genres")),
            "poster_path": F.coalesce("poster_path", F.lit("/new.jpg")),
        }
    )
    return J.snapshot_diff(t.facts, new, "id", ["title", "year", "genres", "poster_path", "countries"])


@query("anti_join_exclusions", ["corpus", "exclusions"], "SELECT DISTINCT id FROM corpus WHERE id NOT IN (SELECT id FROM exclusions)")
def _(t):
    return t.corpus.select("id").distinct().join(t.exclusions.select("id").distinct(), "id", "left_anti")


@query("semi_join_membership", ["corpus", "exclusions"], "SELECT cell, count(DISTINCT id) AS ids FROM corpus WHERE id IN (SELECT id FROM exclusions) GROUP BY cell")
def _(t):
    held = t.corpus.select("id", "cell").distinct().join(t.exclusions.select("id").distinct(), "id", "left_semi")
    return held.groupBy("cell").agg(F.count(F.lit(1)).alias("ids"))


@query("leak_check", ["catalogue", "exclusions"], "SELECT DISTINCT c.tmdb_id AS id, reason FROM catalogue c JOIN exclusions e ON e.id = c.tmdb_id WHERE c.pace = 'slow'")
def _(t):
    return J.leak_check(t.catalogue.where("pace = 'slow'").select(c("tmdb_id").alias("id")), t.exclusions, "id")


@query(
    "firewall_or_match",
    ["catalogue", "exclusions"],
    """held AS (SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey IN (SELECT id FROM exclusions WHERE provenance = 'manual'))
       SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT id FROM held) OR regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') IN (SELECT regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') FROM held)""",
)
def _(t):
    rows = t.raw("part").select(c("p_partkey").alias("id"), c("p_name").alias("title"))
    held = rows.join(t.exclusions.where("provenance = 'manual'").select("id").distinct(), "id", "left_semi")
    # held titles come in joined, hyphenated and spaced spellings
    spelled = F.when(c("id") % 3 == 0, F.replace("title", F.lit(" "), F.lit("-"))).when(c("id") % 3 == 1, F.replace("title", F.lit(" "), F.lit(""))).otherwise(F.replace("title", F.lit(" "), F.lit("  ")))
    return J.firewall(rows, held.withColumn("title", F.upper(spelled)))


@query(
    "collision_check",
    ["exclusions", "mapping"],
    """SELECT e.id, 'ALREADY_MAPPED' AS kind, m.id AS detail FROM (SELECT DISTINCT id FROM exclusions) e JOIN mapping m ON m.tmdb_id = e.id
       UNION ALL SELECT id, 'DUPLICATE_IN_BATCH', CAST(count(*) AS VARCHAR) FROM exclusions GROUP BY id HAVING count(*) > 1""",
)
def _(t):
    owners = mapping(t).select(c("tmdb_id").alias("id"), c("id").alias("owner"))
    return J.collision_check(t.exclusions, owners, "id", "owner")


@query(
    "range_join_stratum",
    ["corpus", "strata"],
    "SELECT stratum, count(*) AS n, count(DISTINCT c.id) AS ids, min(release_date) AS first_date, max(release_date) AS last_date FROM corpus c LEFT JOIN strata s ON release_date BETWEEN gte AND lte GROUP BY stratum",
)
def _(t):
    return J.range_join(t.corpus, t.strata, "release_date", "gte", "lte").groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("release_date").alias("first_date"), F.max("release_date").alias("last_date")
    )


@query(
    "join_blind_packets",
    ["routing"],
    """SELECT candidate_id, ord, route, lang, 'joined' AS status FROM routing WHERE route = 'HUMAN_REVIEW_REQUIRED' AND disposition <> 'PROVIDER_FAILURE'
       UNION ALL SELECT candidate_id, NULL, NULL, NULL, 'missing risk_input' FROM routing WHERE route = 'HUMAN_REVIEW_REQUIRED' AND disposition = 'PROVIDER_FAILURE'""",
)
def _(t):
    rows = routing(t)
    queue = rows.where("route = 'HUMAN_REVIEW_REQUIRED'").select("candidate_id", "ord")
    risk = rows.where("disposition <> 'PROVIDER_FAILURE'").select("candidate_id", "lang")
    wide = J.complete_join(queue, {"routing": rows.select("candidate_id", "route"), "risk_input": risk}, "candidate_id")
    return J.joined_or_missing(wide, {name: c(name) for name in ("ord", "route", "lang")})


@query(
    "join_audit_gap",
    ["routing"],
    """SELECT candidate_id, human_decision, route, lang, n_chars, disposition, CASE WHEN repair <> 'NOT_NEEDED' THEN repair END AS repair, 'joined' AS status
         FROM routing WHERE human_decision IS NOT NULL AND disposition <> 'REVIEW_VALID'
       UNION ALL SELECT candidate_id, NULL, NULL, NULL, NULL, NULL, NULL, 'missing verifier' FROM routing WHERE human_decision IS NOT NULL AND disposition = 'REVIEW_VALID'""",
)
def _(t):
    rows = routing(t)
    decisions = rows.where(c("human_decision").isNotNull()).select("candidate_id", "human_decision")
    sides = {
        "routing": rows.select("candidate_id", "route"),
        "blind": rows.select("candidate_id", "lang"),
        "writer": rows.select("candidate_id", "n_chars"),
        "verifier": rows.where("disposition <> 'REVIEW_VALID'").select("candidate_id", "disposition"),
    }
    repaired = rows.where("repair <> 'NOT_NEEDED'").select("candidate_id", "repair")
    wide = J.complete_join(decisions, sides, "candidate_id").join(repaired, "candidate_id", "left")
    return J.joined_or_missing(wide, {name: c(name) for name in ("human_decision", "route", "lang", "n_chars", "disposition", "repair")})


@query(
    "overlay_corrections",
    ["review"],
    """SELECT candidate_id, human_decision AS historical, CASE WHEN lang = 'es' AND source <> 'src2' THEN 'REJECT' ELSE human_decision END AS effective,
       CASE WHEN lang <> 'es' THEN 'UNCHANGED' WHEN source = 'src2' THEN 'STALE_CORRECTION' ELSE 'CORRECTED' END AS status FROM review WHERE human_decision IS NOT NULL""",
)
def _(t):
    history = t.review.where(c("human_decision").isNotNull()).withColumn("record_hash", digest("candidate_id", "text"))
    corrections = history.where("lang = 'es'").select(
        "candidate_id", F.lit("REJECT").alias("decision"), F.when(c("source") == "src2", "old").otherwise(c("record_hash")).alias("bound_hash")
    )
    return J.overlay_corrections(history.select("candidate_id", c("human_decision").alias("decision"), "record_hash"), corrections, "candidate_id")


@query(
    "join_human_model",
    ["human_model"],
    """SELECT h.id, human_weight, model_weight, o_orderstatus AS packet FROM human_model h JOIN orders ON o_orderkey = h.id WHERE o_orderstatus <> 'P' AND o_totalprice >= 50000""",
)
def _(t):
    orders = t.raw("orders")
    human = t.human_model.select("id", "human_weight").join(orders.where("o_orderstatus <> 'P'").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("packet")), "id")
    model = t.human_model.select("id", "model_weight").join(orders.where("o_totalprice >= 50000").select(c("o_orderkey").alias("id")), "id", "left_semi")
    return human.join(model, "id").select("id", "human_weight", "model_weight", "packet")


@query(
    "join_issue_concordance",
    ["review"],
    """SELECT candidate_id, field, CASE WHEN list_contains(model_fields, field) THEN 'MATCHES_HUMAN_DEFECT' WHEN len(model_fields) > 0 THEN 'PARTIAL_MATCH' ELSE 'MISSED_HUMAN_DEFECT' END AS outcome
       FROM (SELECT candidate_id, unnest(human_fields) AS field, model_fields FROM review WHERE human_decision = 'REVISE')
       UNION ALL SELECT candidate_id, field, 'EXTRA_ISSUE_ON_DEFECTIVE' FROM (SELECT candidate_id, unnest(list_filter(model_fields, lambda f: NOT list_contains(human_fields, f))) AS field FROM review WHERE human_decision = 'REVISE')
       UNION ALL SELECT candidate_id, field, 'ISSUE_ON_CLEAN' FROM (SELECT candidate_id, unnest(model_fields) AS field FROM review WHERE human_decision = 'APPROVE')""",
)
def _(t):
    rows = t.review.where(c("human_decision").isNotNull())
    return J.issue_concordance(rows, "candidate_id").withColumnRenamed("concordance", "outcome").unionByName(
        J.extra_issue_queue(rows, "candidate_id").withColumnRenamed("reason", "outcome")
    )


@query(
    "paired_arm_delta",
    ["usage"],
    """SELECT count(*) AS pairs, round(avg(om - oh), 4) AS output_tokens_delta, round(avg(lm - lh), 4) AS latency_ms_delta, round(avg(mm - mh), 4) AS ordinal_matches_delta FROM (
       SELECT candidate_id, sum(output_tokens) FILTER (WHERE arm = 'high') AS oh, sum(output_tokens) FILTER (WHERE arm = 'max') AS om, sum(latency_ms) FILTER (WHERE arm = 'high') AS lh, sum(latency_ms) FILTER (WHERE arm = 'max') AS lm,
        sum(ordinal_matches) FILTER (WHERE arm = 'high') AS mh, sum(ordinal_matches) FILTER (WHERE arm = 'max') AS mm FROM usage WHERE valid GROUP BY candidate_id HAVING count(DISTINCT arm) = 2)""",
)
def _(t):
    values = ["output_tokens", "latency_ms", "ordinal_matches"]
    out = J.paired_delta(t.usage.where("valid"), "candidate_id", "arm", "high", "max", values)
    return out.select("pairs", *[F.round(f"{v}_delta", 4).alias(f"{v}_delta") for v in values])


@query(
    "resolve_identity_lookup",
    ["exclusions"],
    """idx AS (SELECT canonical_id, list_sort(list(DISTINCT tmdb)) AS ids FROM (SELECT canonical_id, id AS tmdb FROM exclusions WHERE canonical_id IS NOT NULL UNION SELECT canonical_id, id + 5 FROM exclusions WHERE provenance = 'supplier') GROUP BY 1)
       SELECT 'm' || p_partkey AS canonical_id, CASE WHEN ids IS NULL THEN 'MISSING' WHEN len(ids) > 1 THEN 'CONFLICT' ELSE 'RESOLVED' END AS status, CASE WHEN len(ids) = 1 THEN ids[1] END AS resolved_id
       FROM part LEFT JOIN idx ON idx.canonical_id = 'm' || p_partkey""",
)
def _(t):
    known = t.exclusions.where(c("canonical_id").isNotNull()).select("canonical_id", "id")
    shifted = t.exclusions.where("provenance = 'supplier'").select("canonical_id", (c("id") + 5).alias("id"))
    wanted = t.raw("part").select(F.concat(F.lit("m"), c("p_partkey").cast("string")).alias("canonical_id"))
    return J.resolve_identity(wanted, identity_index([known, shifted], "canonical_id", "id"))


@query(
    "reserve_substitution",
    ["facts"],
    """q AS (SELECT tmdb_id, (year // 10 * 10) || 's' AS cell, row_number() OVER (PARTITION BY year // 10 ORDER BY votes DESC, rating DESC, tmdb_id) AS rn, poster_path IS NOT NULL AND original_language = 'en' AS ready FROM facts),
       tiered AS (SELECT *, CASE WHEN rn <= 6 THEN 'primary' ELSE 'reserve' END AS tier FROM q WHERE rn <= 9),
       cells AS (SELECT cell, count(*) FILTER (WHERE tier = 'primary') AS quota, count(*) FILTER (WHERE ready) AS ready_n FROM tiered GROUP BY cell)
       SELECT t.tmdb_id, t.cell, t.rn, quota, ready_n AS ready FROM tiered t JOIN cells USING (cell) WHERE tier = 'reserve' AND NOT t.ready AND ready_n < quota""",
)
def _(t):
    best = [c("votes").desc(), c("rating").desc(), c("tmdb_id")]
    cells = t.facts.withColumn("cell", P.decade(c("year")))
    queue = ranking.first_per_group(cells, ["cell"], best, 9, "rn").withColumn("tier", F.when(c("rn") <= 6, "primary").otherwise("reserve"))
    queue = queue.withColumn("is_ready", c("poster_path").isNotNull() & (c("original_language") == "en"))
    return J.usable_reserves(queue, "cell", "tier", c("is_ready")).select("tmdb_id", "cell", c("rn").cast("bigint").alias("rn"), "quota", "ready")


# facts: customers, and the first letters of some names, which many page titles contain
CTES["title_facts"] = (
    (),
    """SELECT c_custkey AS id, c_name AS title, 1980 + c_custkey % 45 AS year, c_nationkey AS kind, c_mktsegment AS segment FROM customer
       UNION ALL SELECT 1000000 + c_custkey, substr(c_name, 1, 16), 1980 + c_custkey % 45, 99, '' FROM customer WHERE c_custkey % 50 = 0""",
)
# pages: named like a variant, longer titles, and pages that only redirects lead to
CTES["wiki_pages"] = (
    ("title_facts",),
    """SELECT title || CASE WHEN kind % 4 = 0 THEN ' (' || year || ' film)' WHEN kind % 4 = 1 THEN ' (film)' ELSE '' END AS page_title, kind = 7 AS disambiguation, CASE WHEN segment = 'BUILDING' THEN 50 ELSE 0 END AS structure_score FROM title_facts WHERE id < 1000000
       UNION ALL SELECT title || ' (film)', false, 0 FROM title_facts WHERE kind % 4 = 3 AND kind < 99 AND segment <> 'BUILDING'
       UNION ALL SELECT 'The Story of ' || title || CASE WHEN id % 2 = 0 THEN ', ' || year ELSE '' END, false, CASE WHEN segment = 'MACHINERY' THEN 70 ELSE 30 END FROM title_facts WHERE kind % 5 = 0
       UNION ALL SELECT 'Another name of ' || id || ' (' || year || ' film)', false, 70 FROM title_facts WHERE kind % 6 = 1""",
)
# redirects: some titles over one step, some over two, some in circles
CTES["wiki_redirects"] = (
    ("title_facts",),
    """SELECT title || ' (film)' AS source, 'Alias ' || id AS target FROM title_facts WHERE kind % 6 = 1
       UNION ALL SELECT 'Alias ' || id, CASE WHEN id % 3 = 0 THEN 'Alias of alias ' || id ELSE 'Another name of ' || id || ' (' || year || ' film)' END FROM title_facts WHERE kind % 6 = 1
       UNION ALL SELECT 'Alias of alias ' || id, CASE WHEN id % 4 = 0 THEN title || ' (film)' ELSE 'Another name of ' || id || ' (' || year || ' film)' END FROM title_facts WHERE kind % 6 = 1 AND id % 3 = 0""",
)


def title_facts(t):
    cust = t.raw("customer")
    year = F.lit(1980).cast("bigint") + c("c_custkey") % 45
    whole = cust.select(c("c_custkey").alias("id"), c("c_name").alias("title"), year.alias("year"), c("c_nationkey").cast("bigint").alias("kind"), c("c_mktsegment").alias("segment"))
    short = cust.where("c_custkey % 50 = 0").select((c("c_custkey") + 1000000).alias("id"), F.substring("c_name", 1, 16).alias("title"), year.alias("year"), F.lit(99).cast("bigint").alias("kind"), F.lit("").alias("segment"))
    return whole.unionByName(short)


def wiki_tables(t):
    """(pages, redirects) drawn from the facts."""
    facts, kind, year = title_facts(t), c("kind"), c("year").cast("string")
    of_year, other = F.concat(F.lit(" ("), year, F.lit(" film)")), F.concat(F.lit("Another name of "), c("id").cast("string"), F.lit(" ("), year, F.lit(" film)"))
    tail = F.when(kind % 4 == 0, of_year).when(kind % 4 == 1, " (film)").otherwise("")
    page = lambda title, structure, off=F.lit(False): (title.alias("page_title"), off.alias("disambiguation"), structure.cast("int").alias("structure_score"))
    building = c("segment") == "BUILDING"
    story = F.concat(F.lit("The Story of "), c("title"), F.when(c("id") % 2 == 0, F.concat(F.lit(", "), year)).otherwise(""))
    pages = J.union_all(
        [
            facts.where("kind < 99").select(*page(F.concat("title", tail), F.when(building, 50).otherwise(0), kind == 7)),
            facts.where((kind % 4 == 3) & (kind < 99) & ~building).select(*page(F.concat("title", F.lit(" (film)")), F.lit(0))),
            facts.where(kind % 5 == 0).select(*page(story, F.when(c("segment") == "MACHINERY", 70).otherwise(30))),
            facts.where(kind % 6 == 1).select(*page(other, F.lit(70))),
        ]
    )
    alias, second = F.concat(F.lit("Alias "), c("id").cast("string")), F.concat(F.lit("Alias of alias "), c("id").cast("string"))
    film = F.concat("title", F.lit(" (film)"))
    third = c("id") % 3 == 0
    steps = F.array_compact(
        F.array(
            F.struct(film.alias("source"), alias.alias("target")),
            F.struct(alias.alias("source"), F.when(third, second).otherwise(other).alias("target")),
            F.when(third, F.struct(second.alias("source"), F.when(c("id") % 4 == 0, film).otherwise(other).alias("target"))),
        )
    )
    return pages, facts.where(kind % 6 == 1).select(F.inline(steps))


@query(
    "resolve_redirects",
    ["wiki_redirects"],
    """RECURSIVE walk AS (SELECT source, target, 1 AS hops FROM wiki_redirects UNION ALL SELECT w.source, r.target, w.hops + 1 FROM walk w JOIN wiki_redirects r ON r.source = w.target WHERE w.hops < 10)
       SELECT source, max(CASE WHEN target NOT IN (SELECT source FROM wiki_redirects) THEN target END) AS final, max(CASE WHEN target NOT IN (SELECT source FROM wiki_redirects) THEN hops END)::BIGINT AS hops FROM walk GROUP BY source""",
)
def _(t):
    return N.redirect_ends(wiki_tables(t)[1])


@query(
    "resolve_title_identity",
    ["wiki_pages", "wiki_redirects"],
    """RECURSIVE walk AS (SELECT source, target, 1 AS hops FROM wiki_redirects UNION ALL SELECT w.source, r.target, w.hops + 1 FROM walk w JOIN wiki_redirects r ON r.source = w.target WHERE w.hops < 10),
       ends AS (SELECT source, target AS final FROM walk WHERE target NOT IN (SELECT source FROM wiki_redirects)),
       f AS (SELECT id, title, year, [title, title || ' (film)', title || ' (' || year || ' film)'] AS asked FROM title_facts),
       v AS (SELECT id, a.asked, coalesce(final, a.asked) AS reached, a.ask FROM (SELECT id, unnest(asked) AS asked, unnest([0, 1, 2]) AS ask FROM f) a LEFT JOIN ends ON ends.source = a.asked),
       p AS (SELECT page_title, structure_score, regexp_replace(lower(page_title), '[^a-z0-9]+', '', 'g') AS key FROM wiki_pages WHERE NOT disambiguation),
       named AS (SELECT id, page_title, arg_min(CASE WHEN reached <> asked THEN asked || ' > ' || reached ELSE asked END, ask) AS path FROM v JOIN p ON key = regexp_replace(lower(reached), '[^a-z0-9]+', '', 'g') GROUP BY id, page_title),
       inside AS (SELECT id, page_title, title || ' > ' || page_title AS path FROM f JOIN p ON contains(key, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'))),
       pairs AS (SELECT id, page_title, coalesce(named.path, inside.path) AS path FROM named FULL JOIN inside USING (id, page_title)),
       s AS (SELECT id, page_title, path, structure_score + CASE WHEN regexp_matches(page_title, '\\b' || year || '\\b') THEN 30 ELSE 0 END
               + CASE WHEN key = regexp_replace(lower(title || year || 'film'), '[^a-z0-9]+', '', 'g') THEN 100 WHEN key = regexp_replace(lower(title || 'film'), '[^a-z0-9]+', '', 'g') THEN 80
                   WHEN key = regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') THEN 60 WHEN contains(key, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g')) THEN 20 ELSE 0 END AS score FROM pairs JOIN f USING (id) JOIN p USING (page_title)),
       b AS (SELECT id, score, count(*) AS n, min(page_title) AS page_title, arg_min(path, page_title) AS path, row_number() OVER (PARTITION BY id ORDER BY score DESC) AS rn FROM s GROUP BY id, score)
       SELECT f.id, CASE WHEN score >= 80 AND n = 1 THEN 'RESOLVED_HIGH_CONFIDENCE' ELSE 'UNRESOLVED_UNIQUE_FILM_PAGE_NOT_ESTABLISHED' END AS result, CASE WHEN score >= 80 AND n = 1 THEN page_title END AS page_title,
         score, CASE WHEN score >= 80 AND n = 1 THEN path END AS path FROM f LEFT JOIN b ON b.id = f.id AND rn = 1""",
)
def _(t):
    pages, redirects = wiki_tables(t)
    found = N.resolve_titles(title_facts(t).select("id", "title", "year"), pages, redirects)
    return found.withColumn("path", F.array_join("path", " > "))


HASHES = ["curated", "facts", "poster", "palette", "editorial", "verifier", "decision"]


@query(
    "approval_freshness",
    ["review"],
    """SELECT candidate_id, 'editorial' AS field, 'STALE_APPROVAL' AS code FROM review WHERE source = 'src1' UNION ALL SELECT candidate_id, 'facts', 'STALE_APPROVAL' FROM review WHERE lang = 'de'
       UNION ALL SELECT candidate_id, 'decision', 'STALE_APPROVAL' FROM review WHERE severity = 'SEVERE'""",
)
def _(t):
    hashed = lambda h, off: F.sha2(F.concat(F.lit(h), "candidate_id", F.when(off, "-old").otherwise("")), 256).alias(h)
    no = F.lit(False)
    stale = {"editorial": c("source") == "src1", "facts": c("lang") == "de", "decision": F.coalesce(c("severity") == "SEVERE", no)}
    recorded = t.review.select("candidate_id", *[hashed(h, stale.get(h, no)) for h in HASHES])
    actual = t.review.select("candidate_id", *[hashed(h, no) for h in HASHES])
    return J.approval_freshness(recorded, actual, "candidate_id", HASHES)


@query("identity_consistency", ["review"], "SELECT candidate_id AS record, CASE WHEN source = 'src4' AND lang = 'fr' THEN 3 ELSE 2 END::BIGINT AS identities FROM review WHERE source = 'src4' OR lang = 'fr'")
def _(t):
    base = t.review.select(c("candidate_id").alias("record"), "candidate_id", "tmdb_id", "source", "lang")
    writer = base.withColumn("tmdb_id", F.when(c("source") == "src4", c("tmdb_id") + 1).otherwise(c("tmdb_id")))
    judge = base.withColumn("candidate_id", F.when(c("lang") == "fr", F.concat(F.lit("x"), "candidate_id")).otherwise(c("candidate_id")))
    return J.identity_consistency([base, writer, judge], "record", ["candidate_id", "tmdb_id"])


@query(
    "compare_classifications",
    ["human_model"],
    """SELECT id, human_weight = model_weight AS weight_match, human_pace = model_pace AS pace_match,
       round(CASE WHEN len(u) = 0 THEN 1.0 ELSE len(list_intersect(human_moods, model_moods)) * 1.0 / len(u) END, 6) AS moods_jaccard, list_sort(human_moods) = list_sort(model_moods) AS moods_equal
       FROM (SELECT *, list_distinct(list_concat(human_moods, model_moods)) AS u FROM human_model)""",
)
def _(t):
    out = J.compare_classifications(
        t.human_model, "id", {"weight": ("human_weight", "model_weight"), "pace": ("human_pace", "model_pace")}, {"moods": ("human_moods", "model_moods")}
    )
    return out.withColumn("moods_jaccard", F.round("moods_jaccard", 6))


CTES["layers"] = (
    ("review",),
    """SELECT candidate_id, 1 AS layer, 'auto' AS version FROM review WHERE disposition = 'VALID_LOW_RISK' UNION ALL SELECT candidate_id, 2, 'repair' FROM review WHERE human_decision = 'REVISE' OR disposition = 'SCHEMA_INVALID'
       UNION ALL SELECT candidate_id, 3, 'renewed' FROM review WHERE severity = 'SEVERE'""",
)


def layers(t: Tables) -> list[DataFrame]:
    r = t.review
    pick = lambda cond, v: r.where(cond).select("candidate_id", F.lit(v).alias("version"))
    return [
        pick("disposition = 'VALID_LOW_RISK'", "auto"),
        pick("human_decision = 'REVISE' OR disposition = 'SCHEMA_INVALID'", "repair"),
        pick("severity = 'SEVERE'", "renewed"),
    ]


@query("layered_source_priority", ["layers"], "SELECT candidate_id, max(layer) AS layer, arg_max(version, layer) AS version FROM layers GROUP BY candidate_id")
def _(t):
    return J.layered_priority(layers(t), "candidate_id", "version")


@query(
    "assemble_production_rows",
    ["catalogue", "facts", "mapping", "exclusions"],
    """acc AS (SELECT c.id, c.tmdb_id FROM catalogue c WHERE c.id NOT IN (SELECT 'm' || id FROM exclusions)),
       mm AS (SELECT id, min(tmdb_id) AS tmdb_id FROM mapping GROUP BY id)
       SELECT a.id, f.title, array_to_string(c.palette, '|') AS palette, m.tmdb_id = a.tmdb_id AS identity_ok, c.palette[1] = c.palette[2] AS palette_collision, 'assembled' AS status
       FROM acc a JOIN facts f ON f.id = a.id JOIN catalogue c ON c.id = a.id JOIN mm m ON m.id = a.id
       UNION ALL SELECT id, NULL, NULL, NULL, NULL, 'missing facts' FROM acc WHERE id NOT IN (SELECT id FROM facts) UNION ALL SELECT id, NULL, NULL, NULL, NULL, 'missing mapping' FROM acc WHERE id NOT IN (SELECT id FROM mm)""",
)
def _(t):
    held = t.exclusions.select(F.concat(F.lit("m"), c("id").cast("string")).alias("id")).distinct()
    accepted = t.catalogue.select("id", "tmdb_id").join(held, "id", "left_anti")
    sides = {
        "facts": t.facts.select("id", "title"),
        "palette": t.catalogue.select("id", "palette"),
        "mapping": mapping(t).groupBy("id").agg(F.min("tmdb_id").alias("m_tmdb")),
    }
    columns = {
        "title": c("title"), "palette": joined("palette"), "identity_ok": c("m_tmdb") == c("tmdb_id"),
        "palette_collision": F.element_at("palette", 1) == F.element_at("palette", 2),
    }
    return J.joined_or_missing(J.complete_join(accepted, sides, "id"), columns, "assembled")


SPEC_MAPPING = "('description','category','MATERIAL_FACTUAL_CONFLICT'),('description','claim','LANGUAGE_CLAIM'),('why_watch','category','SPECULATIVE_HOOK_PREMISE'),('vibe_summary','claim','NOT_DEFINED'),('vibe_summary','category','MATERIAL_FACTUAL_CONFLICT')"
SPEC_VOCABULARY = "('category','MATERIAL_FACTUAL_CONFLICT'),('category','SPECULATIVE_HOOK_PREMISE'),('claim','LANGUAGE_CLAIM')"


@query(
    "spec_coverage",
    ["review"],
    f"""misses AS (SELECT candidate_id, unnest(human_fields) AS defect FROM review WHERE human_decision = 'REVISE' AND len(model_fields) = 0),
       m AS (SELECT * FROM (VALUES {SPEC_MAPPING}) m(defect, kind, entry)), v AS (SELECT * FROM (VALUES {SPEC_VOCABULARY}) v(kind, entry))
       SELECT candidate_id, misses.defect, bool_and(v.entry IS NOT NULL) AS covered FROM misses LEFT JOIN m ON m.defect = misses.defect LEFT JOIN v ON v.kind = m.kind AND v.entry = m.entry GROUP BY ALL""",
)
def _(t):
    misses = t.review.where((c("human_decision") == "REVISE") & (F.size("model_fields") == 0)).select("candidate_id", F.explode("human_fields").alias("defect"))
    return J.spec_coverage(misses, t.literal(SPEC_MAPPING, "defect, kind, entry"), t.literal(SPEC_VOCABULARY, "kind, entry"))


@query(
    "repair_plan",
    ["editorial"],
    """SELECT id, 'description' AS affected_fields, 'why_watch=' || sha256(why_watch) || '|curiosity_hook=' || sha256(curiosity_hook) || '|vibe_summary=' || sha256(vibe_summary) AS locked
       FROM editorial WHERE contains(description, 'TODO')""",
)
def _(t):
    copy = editorial(t)
    decisions = copy.where(c("description").contains("TODO")).select("id", F.array(F.lit("description")).alias("affected_fields"))
    plan = J.repair_plan(decisions, copy, "id", ["description", "why_watch", "curiosity_hook", "vibe_summary"])
    return plan.select("id", joined("affected_fields").alias("affected_fields"), joined("locked").alias("locked"))
