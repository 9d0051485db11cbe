"""Quotas, rotation, seeded samples and ordered selection over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import joined, preimage_hash, slug
from curatorium.functions.spread import placed, ranked
from curatorium.operators import predicates as P
from curatorium.operators import ranking as R
from curatorium.operators.joins import range_join, union_all
from curatorium.operators.sets import table_digest
from curatorium.plans.predicates import routing
from curatorium.plans.registry import query
from curatorium.session import stored
from curatorium.sources.projections import CTES, Tables

c = F.col


def best_first():
    return [F.col("votes").desc(), F.col("rating").desc(), F.col("tmdb_id").asc()]


# one row per id, dated by its first order
CTES["candidates"] = (
    ("corpus", "strata"),
    """SELECT id, release_date, stratum, quota FROM (SELECT id, arg_min(release_date, (source_order, page, votes, rating)) AS release_date FROM corpus GROUP BY id) JOIN strata ON release_date BETWEEN gte AND lte""",
)


def candidates(t: Tables) -> DataFrame:
    first = t.corpus.groupBy("id").agg(F.min_by("release_date", F.struct("source_order", "page", "votes", "rating")).alias("release_date"))
    return range_join(first, t.strata, "release_date", "gte", "lte").where(c("stratum").isNotNull()).select("id", "release_date", "stratum")


PROTOCOL = "catalogue-selection.v1"


@query(
    "quota_by_hash_rank",
    ["candidates", "strata"],
    f"""r AS (SELECT *, sha256('{PROTOCOL}|stage1-select|' || stratum || '|' || id) AS h FROM candidates),
        k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, id) AS rn FROM r)
        SELECT stratum, id, rn AS selection_rank, 'selected' AS status FROM k WHERE rn <= quota
        UNION ALL SELECT stratum, NULL, count(id), 'short' FROM strata LEFT JOIN candidates USING (stratum) GROUP BY stratum, strata.quota HAVING count(id) < strata.quota""",
)
def _(t):
    hashed = preimage_hash("|", PROTOCOL, "stage1-select", c("stratum"), c("id"))
    chosen, short = R.quota_by_hash(candidates(t), t.strata, "stratum", "id", hashed)
    return chosen.select("stratum", "id", c("selection_rank").cast("bigint").alias("selection_rank"), F.lit("selected").alias("status")).unionByName(
        short.select("stratum", F.lit(None).cast("bigint").alias("id"), c("available").alias("selection_rank"), F.lit("short").alias("status"))
    )


def _rotation_sql(source: str, cell: str, group: str, seed: str, quota: str, capped: bool = False) -> str:
    order = "votes DESC, rating DESC, tmdb_id"
    groups = f"row_number() OVER (PARTITION BY {cell} ORDER BY {order + ', ' if capped else ''}CAST({group} AS VARCHAR)) - 1"
    cap = "WHERE g < 8" if capped else ""
    offset = f"('0x' || substr(sha256('\"' || {seed} || '\"'), 1, 8))::BIGINT % n" if seed else "0"
    return f"""(SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY k.{cell} ORDER BY k.turn, (g.g - g.off + g.n) % g.n) - 1 AS bucket_index FROM
       (SELECT *, row_number() OVER (PARTITION BY {cell}, {group} ORDER BY {order}) AS turn FROM {source}) k
       JOIN (SELECT *, {offset} AS off FROM (SELECT *, count(*) OVER (PARTITION BY {cell}) AS n FROM (SELECT * FROM (SELECT *, {groups} AS g FROM (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {cell}, {group} ORDER BY {order}) = 1)) {cap}))) g
       ON g.{cell} = k.{cell} AND g.{group} = k.{group}) WHERE bucket_index < {quota})"""


CTES["celled"] = (
    ("facts",),
    """SELECT tmdb_id, votes, rating, genres[1] AS genre, original_language AS lang, (year // 10 * 10) || 's' AS decade, CASE WHEN votes >= 1200 THEN 'mainstream' WHEN votes >= 1000 THEN 'familiar' ELSE 'discovery' END AS band,
       (year // 10 * 10) || 's:' || CASE WHEN votes >= 1200 THEN 'mainstream' WHEN votes >= 1000 THEN 'familiar' ELSE 'discovery' END AS cell,
       (year // 10 * 10) || 's:' || CASE WHEN votes >= 1200 THEN 'mainstream' WHEN votes >= 1000 THEN 'familiar' ELSE 'discovery' END || CASE WHEN original_language = 'en' THEN ':en' ELSE ':other' END AS cell3 FROM facts""",
)


def celled(t: Tables) -> DataFrame:
    band = F.when(c("votes") >= 1200, "mainstream").when(c("votes") >= 1000, "familiar").otherwise("discovery")
    rows = t.facts.select(
        "tmdb_id", "votes", "rating", F.element_at("genres", 1).alias("genre"), c("original_language").alias("lang"),
        P.decade(c("year")).alias("decade"), band.alias("band"),
    )
    side = F.when(c("lang") == "en", "en").otherwise("other")
    return rows.withColumns({"cell": F.concat_ws(":", "decade", "band"), "cell3": F.concat_ws(":", "decade", "band", side)})


def json_seed(*parts):
    """A seed text hashed in its JSON form, quotes included."""
    return F.concat(F.lit('"'), *parts, F.lit('"'))


@query("round_robin", ["celled"], "SELECT decade, genre, tmdb_id, bucket_index FROM " + _rotation_sql("celled", "decade", "genre", "decade || ':demo'", "20"))
def _(t):
    out = R.round_robin(celled(t), ["decade"], "genre", best_first(), json_seed(c("decade"), F.lit(":demo")), F.lit(20), 20)
    return out.select("decade", "genre", "tmdb_id", c("bucket_index").cast("bigint").alias("bucket_index"))


CTES["english"] = (("celled",), "SELECT * FROM celled WHERE lang = 'en'")
CTES["foreign_rows"] = (("celled",), "SELECT * FROM celled WHERE lang <> 'en'")
QUOTA_SQL = "CASE split_part({c}, ':', 2) WHEN 'discovery' THEN 6 ELSE 7 END"


def _halves(rows: DataFrame, cell: str, quota):
    """English rows by genre and other rows by language, half of the quota each."""
    english = R.round_robin(
        rows.where("lang = 'en'"), [cell], "genre", best_first(), json_seed(c(cell), F.lit(":english")), F.ceil(quota / 2), 7
    )
    other = R.round_robin(
        rows.where("lang <> 'en'"), [cell], "lang", best_first(), json_seed(c(cell), F.lit(":non-english")), F.floor(quota / 2), 7, max_groups=8
    )
    return english, other


@query(
    "interleave_two",
    ["english", "foreign_rows"],
    f"""SELECT decade, tmdb_id, 2 * bucket_index AS position FROM {_rotation_sql('english', 'decade', 'genre', "decade || ':english'", '4')}
        UNION ALL SELECT decade, tmdb_id, 2 * bucket_index + 1 FROM {_rotation_sql('foreign_rows', 'decade', 'lang', "decade || ':non-english'", '3', True)}""",
)
def _(t):
    english, other = _halves(celled(t), "decade", F.lit(7))
    cols = ["decade", "tmdb_id", c("bucket_index").cast("bigint").alias("position")]
    return R.interleave(english.select(*cols), other.select(*cols), ["decade"], "position")


@query(
    "cell_quota_selection",
    ["english", "foreign_rows"],
    f"""SELECT cell, tmdb_id, 2 * bucket_index AS position FROM {_rotation_sql('english', 'cell', 'genre', "cell || ':english'", '(' + QUOTA_SQL.format(c='cell') + ' + 1) // 2')}
        UNION ALL SELECT cell, tmdb_id, 2 * bucket_index + 1 FROM {_rotation_sql('foreign_rows', 'cell', 'lang', "cell || ':non-english'", QUOTA_SQL.format(c='cell') + ' // 2', True)}""",
)
def _(t):
    quota = F.when(c("cell").endswith(":discovery"), 6).otherwise(7)
    english, other = _halves(celled(t), "cell", quota)
    cols = ["cell", "tmdb_id", c("bucket_index").cast("bigint").alias("position")]
    return R.interleave(english.select(*cols), other.select(*cols), ["cell"], "position")


_QUOTA = QUOTA_SQL.format(c="cell")


@query(
    "cell_shortage",
    ["english", "foreign_rows"],
    f"""e AS (SELECT cell, count(*) AS n FROM {_rotation_sql('english', 'cell', 'genre', "cell || ':english'", '(' + _QUOTA + ' + 1) // 2')} GROUP BY cell),
        o AS (SELECT cell, count(*) AS n FROM {_rotation_sql('foreign_rows', 'cell', 'lang', "cell || ':non-english'", _QUOTA + ' // 2', True)} GROUP BY cell),
        k AS (SELECT cell, {_QUOTA} AS q FROM (SELECT DISTINCT cell FROM celled UNION SELECT DISTINCT replace(cell, '0s', '5s') FROM celled)),
        w AS (SELECT cell, 'english' AS half, CAST((q + 1) // 2 AS BIGINT) AS wanted, coalesce(n, 0) AS got FROM k LEFT JOIN e USING (cell) UNION ALL SELECT cell, 'other', CAST(q // 2 AS BIGINT), coalesce(n, 0) FROM k LEFT JOIN o USING (cell))
        SELECT cell, half, wanted, got FROM w WHERE got < wanted""",
)
def _(t):
    quota = F.when(c("cell").endswith(":discovery"), 6).otherwise(7)
    rows = stored(celled(t), "celled")  # read for both halves and for the cells
    english, other = _halves(rows, "cell", quota)
    # cells of years that the pool doesn't have are wanted too
    pool = rows.select("cell")
    cells = pool.unionByName(pool.select(F.replace("cell", F.lit("0s"), F.lit("5s")).alias("cell")))
    return R.cell_shortage(cells, {"english": english, "other": other}, "cell", {"english": F.ceil(quota / 2), "other": F.floor(quota / 2)})


@query(
    "primary_and_reserve",
    ["celled"],
    f"""SELECT cell3 AS cell, tmdb_id, CASE WHEN bucket_index < 4 THEN 'primary' ELSE 'reserve' END AS tier, row_number() OVER (ORDER BY bucket_index >= 4, cell3, bucket_index) AS selection_rank FROM {_rotation_sql('celled', 'cell3', 'genre', '', '6')}""",
)
def _(t):
    primary = 4
    picked = R.round_robin(celled(t), ["cell3"], "genre", best_first(), None, F.lit(primary + -(-primary // 2)), primary + -(-primary // 2))
    reserve = c("bucket_index") >= primary
    queue = ranked(
        picked.withColumn("reserve", reserve), [], [c("reserve").asc(), c("cell3").asc(), c("bucket_index").asc()],
        [(c("reserve"), True), (c("cell3"), True)], out="selection_rank",
    )
    return queue.select(c("cell3").alias("cell"), "tmdb_id", F.when(c("reserve"), "reserve").otherwise("primary").alias("tier"), "selection_rank")


@query("seeded_sample", ["review"], "SELECT candidate_id FROM review ORDER BY sha256('audit-seed|' || candidate_id), candidate_id LIMIT 50")
def _(t):
    return R.seeded_sample(t.review.select("candidate_id"), "audit-seed", "candidate_id", 50).select("candidate_id")


@query(
    "audit_sample_rate",
    ["review"],
    """SELECT candidate_id, rn AS sample_rank FROM (SELECT candidate_id, row_number() OVER (ORDER BY sha256('rate-seed|' || candidate_id), candidate_id) AS rn, count(*) OVER () AS n FROM review) WHERE rn <= (n * 33 + 99) // 100""",
)
def _(t):
    rows = t.review.select("candidate_id")
    return R.sample_rate(rows, [], R.seeded_hash("rate-seed", "candidate_id"), "candidate_id", F.lit(33)).select("candidate_id", "sample_rank")


@query(
    "blind_order",
    ["routing"],
    """SELECT candidate_id, row_number() OVER (ORDER BY sha256('blind-seed' || chr(10) || candidate_id), candidate_id) AS blind_ordinal FROM routing WHERE route <> 'QUARANTINED'""",
)
def _(t):
    rows = routing(t).where("route <> 'QUARANTINED'").select("candidate_id")
    return R.seeded_order(rows, [], R.seeded_hash("blind-seed", "candidate_id", "\n"), "candidate_id", "blind_ordinal").select("candidate_id", "blind_ordinal")


@query(
    "qa_sample_severe_plus_rate",
    ["adjudicated"],
    """SELECT candidate_id, 'severe' AS cohort FROM adjudicated WHERE severity = 'SEVERE' UNION ALL
       SELECT candidate_id, 'sampled' FROM (SELECT candidate_id, row_number() OVER (ORDER BY sha256('qa' || chr(10) || candidate_id), candidate_id) AS rn, count(*) OVER () AS n FROM adjudicated WHERE severity IS DISTINCT FROM 'SEVERE') WHERE rn <= (n * 25 + 99) // 100""",
)
def _(t):
    rows = t.review.where(c("human_decision").isNotNull()).select("candidate_id", F.coalesce(c("severity") == "SEVERE", F.lit(False)).alias("severe"))
    sampled = R.sample_rate(rows.where("NOT severe"), [], R.seeded_hash("qa", "candidate_id", "\n"), "candidate_id", F.lit(25))
    return rows.where("severe").select("candidate_id", F.lit("severe").alias("cohort")).unionByName(sampled.select("candidate_id", F.lit("sampled").alias("cohort")))


@query(
    "greedy_coverage_sample",
    ["catalogue"],
    """f AS (SELECT id, list_distinct(list_concat(list_transform(moods, lambda m: 'mood:' || m), list_transform(languages, lambda l: 'language:' || l), list_transform(genres, lambda g: 'genre:' || g),
          ['attention:' || attention_demand, 'weight:' || emotional_weight, 'discovery:' || discovery_style, 'era:' || CASE WHEN year < 1990 THEN '1970-1989' WHEN year < 2010 THEN '1990-2009' ELSE '2010-present' END,
           'runtime:' || CASE WHEN runtime_minutes < 90 THEN 'under-90' WHEN runtime_minutes <= 120 THEN '90-120' ELSE 'over-120' END])) AS f FROM catalogue),
     picks AS (WITH RECURSIVE g(step, chosen, seen) AS (SELECT 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) UNION ALL
       SELECT step + 1, list_append(chosen, best.id), list_distinct(list_concat(seen, best.f)) FROM (
         SELECT step, chosen, seen, arg_min({'id': f.id, 'f': f.f}, (-len(list_filter(f.f, lambda x: NOT list_contains(seen, x))), f.id)) AS best FROM g, f WHERE step < 16 AND NOT list_contains(chosen, f.id) GROUP BY step, chosen, seen))
       SELECT chosen FROM g WHERE step = 16)
     SELECT unnest(chosen) AS id, CAST(generate_subscripts(chosen, 1) AS INTEGER) AS pick FROM picks""",
)
def _(t):
    tag = lambda col, name: F.transform(col, lambda v: F.concat(F.lit(f"{name}:"), v))
    one = lambda name, col: F.concat(F.lit(f"{name}:"), col)
    features = F.concat(
        tag("moods", "mood"), tag("languages", "language"), tag("genres", "genre"),
        F.array(
            one("attention", c("attention_demand")), one("weight", c("emotional_weight")), one("discovery", c("discovery_style")),
            one("era", P.era(c("year"))), one("runtime", P.runtime_band(c("runtime_minutes"))),
        ),
    )
    ids = R.greedy_coverage(t.catalogue, "id", features, 16)
    order = t.spark.createDataFrame(list(zip(ids, range(1, len(ids) + 1))), "id string, pick int")
    return t.catalogue.select("id").join(F.broadcast(order), "id")


@query(
    "partition_contiguity",
    ["corpus"],
    """cells AS (SELECT cell, min(release_date) AS gte, max(release_date) AS lte FROM corpus GROUP BY cell),
       o AS (SELECT *, lag(lte) OVER (ORDER BY gte) AS prev, lead(gte) OVER (ORDER BY gte) AS next FROM cells)
       SELECT cell, gte, lte, coalesce(CASE WHEN prev IS NULL THEN CASE WHEN gte <> '1995-01-01' THEN 'START_BOUND' END WHEN CAST(gte AS DATE) - CAST(prev AS DATE) < 1 THEN 'OVERLAP' WHEN CAST(gte AS DATE) - CAST(prev AS DATE) > 1 THEN 'GAP' END,
         CASE WHEN next IS NULL AND lte <> '2001-12-31' THEN 'END_BOUND' END, 'OK') AS problem FROM o""",
)
def _(t):
    cells = t.corpus.groupBy("cell").agg(F.min("release_date").alias("gte"), F.max("release_date").alias("lte"))
    return R.partition_contiguity(cells, "gte", "lte", "1995-01-01", "2001-12-31")


@query(
    "sequence_completeness",
    (),
    """r AS (SELECT conv_id, turn + 1 AS page, CASE WHEN length(text) > 1500 THEN -1 ELSE 0 END AS drift FROM conversations WHERE role <> 'system' UNION ALL SELECT conv_id, turn + 1, 0 FROM conversations WHERE length(text) < 60 AND role <> 'system' UNION ALL SELECT conv_id, turn + 40, 0 FROM conversations WHERE length(text) < 30),
       p AS (SELECT conv_id, max(turn) + 1 AS planned FROM conversations GROUP BY conv_id),
       g AS (SELECT p.conv_id, planned, page, count(page) AS copies, min(drift) AS drift FROM p LEFT JOIN r ON r.conv_id = p.conv_id GROUP BY ALL),
       s AS (SELECT conv_id, planned, count(*) FILTER (WHERE page BETWEEN 1 AND planned) AS received, count(*) FILTER (WHERE copies > 1) AS duplicated, count(*) FILTER (WHERE page > planned) AS unexpected, count(*) FILTER (WHERE drift < 0) AS drifted FROM g GROUP BY ALL)
       SELECT *, planned - received AS missing, CASE WHEN unexpected > 0 THEN 'UNEXPECTED_PAGE' WHEN duplicated > 0 THEN 'DUPLICATE_PAGE' WHEN received < planned THEN 'INCOMPLETE' WHEN drifted > 0 THEN 'TOTAL_DRIFT' ELSE 'COMPLETE' END AS status FROM s""",
)
def _(t):
    turns = t.raw("conversations")
    planned = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("planned"))
    size = F.length("text")
    page = lambda step, drift: [c("conv_id"), (c("turn") + step).alias("page"), drift.alias("drift")]
    # system turns were lost, short turns came twice, very short ones also far too late
    received = union_all(
        [
            turns.where("role <> 'system'").select(*page(1, F.when(size > 1500, -1).otherwise(0))),
            turns.where((size < 60) & (c("role") != "system")).select(*page(1, F.lit(0))),
            turns.where(size < 30).select(*page(40, F.lit(0))),
        ]
    )
    reported = received.join(planned, "conv_id").select("conv_id", "page", (c("planned") + c("drift")).alias("total"))
    return R.sequence_completeness(reported, planned, "conv_id", "page", "total")


@query("first_contributor", ["exclusions"], "SELECT source, count(*) AS ids FROM (SELECT id, arg_min(provenance, source_ord) AS source FROM exclusions GROUP BY id) GROUP BY source")
def _(t):
    first = R.first_contributor(t.exclusions, "id", "source_ord", "provenance")
    return first.groupBy(c("provenance").alias("source")).agg(F.count(F.lit(1)).alias("ids"))


HEADINGS = ["Plot", "Reception", "Critical response", "Release and reception", "Reviews by critics", "Themes", "Cast", "Legacy reception", "Production", "Places"]
# section outlines: one page per conversation, one section per turn
CTES["sections"] = (
    (),
    f"SELECT conv_id AS page, turn AS pos, CAST(1 + length(text) % 4 AS INTEGER) AS level, {HEADINGS}[CAST((length(text) // 4 + turn) % 10 AS INT) + 1] AS heading FROM conversations",
)


def sections(t: Tables) -> DataFrame:
    size = F.length("text")
    names = F.array(*[F.lit(h) for h in HEADINGS])
    return t.raw("conversations").select(
        c("conv_id").alias("page"), c("turn").alias("pos"), (size % 4 + 1).cast("int").alias("level"),
        F.element_at(names, (F.floor(size / 4) + c("turn")).cast("int") % 10 + 1).alias("heading"),
    )


CTES["ancestry"] = (
    ("sections",),
    """SELECT s.page, s.pos, s.level, s.heading, coalesce(string_agg(a.heading, '|' ORDER BY a.pos), '') AS ancestors FROM sections s LEFT JOIN sections a ON a.page = s.page AND a.pos < s.pos AND a.level < s.level
       AND NOT EXISTS (SELECT 1 FROM sections b WHERE b.page = s.page AND b.pos > a.pos AND b.pos < s.pos AND b.level <= a.level) GROUP BY ALL""",
)


def ancestry(t: Tables) -> DataFrame:
    return R.section_ancestors(sections(t), "page", "pos", "level", "heading", max_level=4)


@query("section_ancestors", ["ancestry"], "SELECT page, pos, level, heading, ancestors FROM ancestry")
def _(t):
    return ancestry(t).withColumn("ancestors", joined("ancestors"))


def heading_preference():
    h = F.lower("heading")
    return F.when(h.rlike("^critical (response|reception)$"), 0).when(h == "reception", 1).when(h == "release and reception", 2).otherwise(3)


@query(
    "preferred_candidate",
    ["sections"],
    """SELECT page, arg_min(pos, (pref, pos)) AS pos, arg_min(heading, (pref, pos)) AS heading FROM (SELECT *, CASE lower(heading) WHEN 'critical response' THEN 0 WHEN 'critical reception' THEN 0 WHEN 'reception' THEN 1 WHEN 'release and reception' THEN 2 ELSE 3 END AS pref FROM sections) GROUP BY page""",
)
def _(t):
    return R.preferred_candidate(sections(t), "page", heading_preference(), "pos", ["pos", "heading"])


@query(
    "next_unresolved",
    ["review"],
    """SELECT lang, arg_min(candidate_id, ord) FILTER (WHERE human_decision IS NULL) AS next_id, min(ord) FILTER (WHERE human_decision IS NULL) AS next_order,
       coalesce(max(ord) FILTER (WHERE human_decision IS NOT NULL) > min(ord) FILTER (WHERE human_decision IS NULL), false) AS out_of_order FROM review GROUP BY lang""",
)
def _(t):
    return R.next_unresolved(t.review, "lang", "ord", c("human_decision").isNotNull(), "candidate_id")


@query("top_repeated", ["catalogue"], "SELECT pace, emotional_weight, attention_demand, count(*) AS n FROM catalogue GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, pace, emotional_weight, attention_demand LIMIT 10")
def _(t):
    return R.top_repeated(t.catalogue, ["pace", "emotional_weight", "attention_demand"])


@query(
    "cohort_extension",
    ["review"],
    """p AS (SELECT source, count(*) AS have FROM review WHERE human_decision = 'APPROVE' GROUP BY source),
       n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn FROM review WHERE human_decision IS DISTINCT FROM 'APPROVE' AND n_chars >= 300)
       SELECT source, candidate_id, 'prior' AS origin FROM review WHERE human_decision = 'APPROVE' UNION ALL SELECT n.source, candidate_id, 'new' FROM n LEFT JOIN p USING (source) WHERE rn <= 30 - coalesce(have, 0)""",
)
def _(t):
    prior = t.review.where("human_decision = 'APPROVE'").select("source", "candidate_id")
    return R.cohort_extension(prior, t.review.where("n_chars >= 300").select("source", "candidate_id", "ord"), "source", "candidate_id", "ord", 30)


@query(
    "unique_slug",
    ["catalogue"],
    """s AS (SELECT id, tmdb_id, emotional_weight, replace(title, ' ', '-') || '-' || year AS slug FROM catalogue),
       n AS (SELECT slug, count(*) AS n FROM s WHERE emotional_weight <> 'light' GROUP BY slug)
       SELECT id, CASE WHEN n > 1 OR slug IN (SELECT slug FROM s WHERE emotional_weight = 'light') THEN slug || '-' || tmdb_id ELSE slug END AS unique_slug FROM s JOIN n USING (slug) WHERE emotional_weight <> 'light'""",
)
def _(t):
    rows = t.catalogue
    text = slug(F.initcap("title"), c("year"))
    taken = rows.where("emotional_weight = 'light'").select(text.alias("slug"))
    return R.unique_slugs(rows.where("emotional_weight <> 'light'"), taken, "tmdb_id", text).select("id", "unique_slug")


# letters, ligatures, fractions and scripts that decompose to something, or to nothing, of a slug
_TAILS = [(" Café", "-cafe"), (" ﬁne ÅNGSTRÖM", "-fine-angstrom"), (" Ǆ№5", "-dzno5"), (" ½", "-1-2"), (" 東京", "")]


@query(
    "title_slugs",
    ["catalogue"],
    f"""SELECT id, replace(title, ' ', '-') || ({[tail for _, tail in _TAILS]})[1 + ord % 5] || CASE WHEN ord % 7 = 0 THEN '' ELSE '-' || year END AS slug FROM catalogue""",
)
def _(t):
    tail = F.element_at(F.array(*[F.lit(text) for text, _ in _TAILS]), (c("ord") % 5 + 1).cast("int"))
    return t.catalogue.select("id", slug(F.concat(F.initcap("title"), tail), F.when(c("ord") % 7 != 0, c("year"))).alias("slug"))


@query(
    "first_k_qualifying",
    ["review"],
    """q AS (SELECT source, ord, candidate_id, disposition = 'VALID_HIGH_RISK' AND n_chars >= 400 AS ok FROM review),
       r AS (SELECT *, row_number() OVER (PARTITION BY source, ok ORDER BY ord) AS rn, count(*) FILTER (WHERE ok) OVER (PARTITION BY source) AS n FROM q)
       SELECT source, candidate_id, CASE WHEN ok AND rn <= 4 THEN rn END AS rank, CASE WHEN ok AND rn <= 4 THEN 'SELECTED' WHEN ok THEN 'AFTER_QUOTA' ELSE 'NOT_QUALIFIED' END AS reason, CASE WHEN n < 4 THEN 'SHORT' ELSE 'READY' END AS class_status FROM r""",
)
def _(t):
    both = (c("disposition") == "VALID_HIGH_RISK") & (c("n_chars") >= 400)
    out = R.first_k_qualifying(t.review, "source", "ord", "candidate_id", both)
    return out.select("source", "candidate_id", c("rank").cast("bigint").alias("rank"), "reason", "class_status")


@query("sort_multi_key", ["facts"], "SELECT tmdb_id, votes, rating, row_number() OVER (ORDER BY votes DESC, rating DESC, tmdb_id) AS place FROM facts")
def _(t):
    return placed(t.facts.select("tmdb_id", "votes", "rating"), best_first()).orderBy("place")


DIGEST_SQL = """p AS (SELECT g, sha256(j) AS d FROM src),
 n AS (SELECT g, CAST('0x' || substr(d, 1, 15) AS BIGINT) AS a, CAST('0x' || substr(d, 16, 15) AS BIGINT) AS b, CAST('0x' || substr(d, 31, 15) AS BIGINT) AS c, CAST('0x' || substr(d, 46, 15) AS BIGINT) AS e FROM p)
 SELECT g AS {name}, sha256(concat_ws(':', CAST(sum(a) AS VARCHAR), CAST(sum(b) AS VARCHAR), CAST(sum(c) AS VARCHAR), CAST(sum(e) AS VARCHAR), CAST(count(*) AS VARCHAR))) AS digest, count(*) AS rows FROM n GROUP BY g"""


@query(
    "canonical_order",
    ["corpus"],
    """src AS (SELECT cell AS g, '{"id":' || id || ',"page":' || page || ',"votes":' || votes || '}' AS j FROM corpus), """ + DIGEST_SQL.format(name="cell"),
)
def _(t):
    # the digest of a cell is the same for every delivery order of its pages
    return table_digest(t.corpus.select("cell", "id", "page", "votes").orderBy(F.desc("votes")), ["cell"])


@query("stable_sort_text", ["catalogue"], "SELECT title, id, row_number() OVER (ORDER BY title, id) AS place FROM catalogue")
def _(t):
    # binary text order, ties by id
    return placed(t.catalogue.select("title", "id"), [c("title").asc(), c("id").asc()]).orderBy("place")
