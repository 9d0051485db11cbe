"""The two batch flows end to end: selecting candidates, and taking reviewed records to promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatorium.functions.columns import digest, joined, preimage_hash
from curatorium.operators import aggregates as A
from curatorium.operators import joins as J
from curatorium.operators import predicates as P
from curatorium.operators import ranking as R
from curatorium.operators import sets as S
from curatorium.plans.predicates import routing
from curatorium.plans.registry import query
from curatorium.plans.selection import PROTOCOL
from curatorium.session import stored

c = F.col


@query(
    "select_candidates",
    ["corpus", "strata", "exclusions"],
    f"""best AS (SELECT id, max(votes) AS votes, arg_max(release_date, (votes, rating, release_date)) AS release_date, string_agg(DISTINCT cell, '|' ORDER BY cell) AS cells FROM corpus GROUP BY id),
        ok AS (SELECT b.*, stratum, quota FROM best b JOIN strata ON release_date BETWEEN gte AND lte WHERE votes // 60 BETWEEN 200 AND 2000 AND release_date BETWEEN '1980-01-01' AND '2024-12-31' AND id NOT IN (SELECT id FROM exclusions WHERE provenance <> 'returns'))
        SELECT stratum, id, cells, selection_rank FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('{PROTOCOL}|stage1-select|' || stratum || '|' || id), id) AS selection_rank FROM ok) WHERE selection_rank <= quota""",
)
def _(t):
    """Deduplicate the corpus, keep eligible rows, drop held ids, place them in strata, fill the quotas."""
    best = A.dedup_best(t.corpus, "id", [c("votes"), c("rating"), c("release_date")], ["votes", "release_date"], "cell")
    eligible = best.where(F.size(P.eligibility_reasons(F.floor(c("votes") / 60).cast("bigint"), c("release_date"))) == 0)
    held = t.exclusions.where("provenance <> 'returns'").select("id").distinct()
    placed = J.range_join(eligible.join(held, "id", "left_anti"), t.strata.drop("quota"), "release_date", "gte", "lte").where(c("stratum").isNotNull())
    hashed = preimage_hash("|", PROTOCOL, "stage1-select", c("stratum"), c("id"))
    chosen, _ = R.quota_by_hash(placed, t.strata, "stratum", "id", hashed)
    return chosen.select("stratum", "id", joined("cells").alias("cells"), c("selection_rank").cast("bigint").alias("selection_rank"))


@query(
    "review_and_promote",
    ["routing"],
    """eff AS (SELECT *, CASE WHEN human_decision IS NULL THEN CASE WHEN route = 'AUTO_ELIGIBLE' THEN 'APPROVE' END WHEN lang = 'es' AND source <> 'src2' THEN 'REJECT' ELSE human_decision END AS effective FROM routing WHERE route <> 'QUARANTINED'),
       acc AS (SELECT candidate_id, tmdb_id FROM eff WHERE effective = 'APPROVE'), base AS (SELECT candidate_id, tmdb_id FROM routing WHERE route = 'QUARANTINED' AND human_decision = 'APPROVE')
       SELECT 'accepted' AS part, count(*) AS rows FROM acc UNION ALL SELECT 'baseline', count(*) FROM base UNION ALL SELECT 'promoted', (SELECT count(*) FROM acc) + (SELECT count(*) FROM base) UNION ALL SELECT 'collisions', 0::BIGINT""",
)
def _(t):
    """Route records, overlay corrections on the decisions, accept, and append to the held rows with collision checks."""
    narrow = ["candidate_id", "tmdb_id", "route", "human_decision", "lang", "source"]
    rows = stored(routing(t).select(*narrow, digest("candidate_id", "text").alias("record_hash")), "routed")  # texts are read once
    live = rows.where("route <> 'QUARANTINED'")
    stated = F.coalesce("human_decision", F.when(c("route") == "AUTO_ELIGIBLE", "APPROVE"))
    history = live.select("candidate_id", "tmdb_id", stated.alias("decision"), "record_hash")
    corrections = live.where(c("human_decision").isNotNull() & (c("lang") == "es")).select(
        "candidate_id", F.lit("REJECT").alias("decision"), F.when(c("source") == "src2", "old").otherwise(c("record_hash")).alias("bound_hash")
    )
    effective = J.overlay_corrections(history, corrections, "candidate_id").where("effective = 'APPROVE'").select("candidate_id")
    accepted = stored(rows.select("candidate_id", "tmdb_id").join(effective, "candidate_id", "left_semi"), "accepted")
    baseline = rows.where("route = 'QUARANTINED' AND human_decision = 'APPROVE'").select("candidate_id", "tmdb_id")
    union, collisions = S.promote_append(baseline, accepted, ["candidate_id", "tmdb_id"])
    parts = {"accepted": accepted, "baseline": baseline, "promoted": union, "collisions": collisions}
    tagged = J.union_all([df.select(F.lit(part).alias("part")) for part, df in parts.items()])
    sizes = tagged.agg(*[F.count_if(c("part") == part).alias(part) for part in parts])
    return sizes.select(F.inline(F.array(*[F.struct(F.lit(part).alias("part"), c(part).alias("rows")) for part in parts])))
