"""Requests against the catalogue: filter, relax, rank, page, compare, explain."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatorium.functions.columns import joined, settle
from curatorium.functions.spread import ranked
from curatorium.operators import filters, ranking, slates
from curatorium.plans.registry import query
from curatorium.schemas import SITUATIONS
from curatorium.sources.projections import CTES, Tables

CTES["matched"] = (
    ("catalogue", "requests"),
    """
SELECT r.request_id, c.*, r.situation AS q_situation, r.genres AS q_genres, r.runtime AS q_runtime, r.language AS q_language,
  r.pace AS q_pace, r.emotional_weight AS q_emotional_weight, r.attention_demand AS q_attention_demand, r.mood AS q_mood,
  r.discovery_style AS q_discovery_style, r.avoid_heavy, r.avoid_slow, r.under_two_hours, r.page_offset,
  (r.situation = '' OR list_contains(c.situations, r.situation)) AS exact
FROM catalogue c JOIN requests r ON r.mood <> '' AND list_contains(c.moods, r.mood)
WHERE (r.genres = '' OR len(list_filter(string_split(r.genres, ','), lambda g: NOT list_contains(c.genres, g))) = 0)
  AND (r.runtime = '' OR r.runtime = CASE WHEN runtime_minutes < 100 THEN 'short' WHEN runtime_minutes <= 130 THEN 'medium' ELSE 'long' END)
  AND (r.language = '' OR list_contains(c.languages, r.language))
  AND (r.pace = '' OR r.pace = c.pace) AND (r.emotional_weight = '' OR r.emotional_weight = c.emotional_weight)
""",
)
CTES["relaxed"] = (
    ("matched",),
    """
SELECT *, CASE WHEN exact THEN 1 ELSE 2 END AS tier FROM (
  SELECT *, count(*) FILTER (WHERE exact) OVER (PARTITION BY request_id) AS exact_count FROM matched)
WHERE exact OR (q_situation <> '' AND exact_count < 3)
""",
)
CTES["pool"] = (
    ("relaxed",),
    """
SELECT *, CAST(q_attention_demand <> '' AND q_attention_demand = attention_demand AS INT)
        + CAST(q_discovery_style <> '' AND q_discovery_style = discovery_style AS INT) AS score
FROM relaxed
WHERE NOT (avoid_heavy AND emotional_weight = 'heavy') AND NOT (avoid_slow AND pace = 'slow')
  AND NOT (under_two_hours AND runtime_minutes >= 120)
""",
)
CTES["ranked_pool"] = (
    ("pool",),
    """
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tier, score DESC, ord) AS position,
  count(*) OVER (PARTITION BY request_id) AS pool_size FROM pool
""",
)
CTES["slate"] = (
    ("ranked_pool",),
    """
SELECT * FROM (SELECT *, CASE WHEN pool_size <= 3 THEN position - 1 ELSE (position - 1 - page_offset % pool_size + pool_size) % pool_size END AS slot,
  CASE WHEN pool_size <= 3 THEN 0 ELSE (page_offset + 3) % pool_size END AS next_offset FROM ranked_pool) WHERE slot < 3
""",
)


def matched(t: Tables) -> DataFrame:
    return filters.match_requests(t.catalogue, t.requests)


def pool(t: Tables) -> DataFrame:
    return filters.with_score(filters.drop_dealbreakers(filters.relax_if_few(matched(t))))


def slate(t: Tables) -> DataFrame:
    return ranking.slate_page(ranking.rank_pool(pool(t)))


def _with_params(t: Tables) -> DataFrame:
    """Every (request, item) carrying the request's mood, before other filters."""
    params = filters.as_params(t.requests)
    return t.catalogue.withColumn("q_mood", F.explode("moods")).join(params, "q_mood")


@query("filter_mood", ["catalogue", "requests"], "SELECT request_id, id FROM catalogue c JOIN requests r ON r.mood <> '' AND list_contains(c.moods, r.mood)")
def _(t):
    return _with_params(t).where(filters.mood_matches(F.col("moods"), F.col("q_mood"))).select("request_id", "id")


@query("filter_situation_exact", ["matched"], "SELECT request_id, id FROM matched WHERE exact")
def _(t):
    return matched(t).where("exact").select("request_id", "id")


@query(
    "filter_runtime_bucket",
    ["catalogue"],
    "SELECT b.bucket, id, runtime_minutes FROM catalogue JOIN (VALUES ('short'), ('medium'), ('long')) b(bucket) ON b.bucket = CASE WHEN runtime_minutes < 100 THEN 'short' WHEN runtime_minutes <= 130 THEN 'medium' ELSE 'long' END",
)
def _(t):
    return t.catalogue.select(filters.runtime_bucket(F.col("runtime_minutes")).alias("bucket"), "id", "runtime_minutes")


@query("filter_practical", ["matched"], "SELECT request_id, id, exact FROM matched")
def _(t):
    return matched(t).select("request_id", "id", "exact")


@query(
    "filter_dealbreakers",
    ["relaxed"],
    "SELECT request_id, id FROM relaxed WHERE NOT (avoid_heavy AND emotional_weight = 'heavy') AND NOT (avoid_slow AND pace = 'slow') AND NOT (under_two_hours AND runtime_minutes >= 120)",
)
def _(t):
    return filters.drop_dealbreakers(filters.relax_if_few(matched(t))).select("request_id", "id")


@query(
    "stable_rank",
    ["matched"],
    """SELECT request_id, id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, ord) AS position FROM (
      SELECT *, CAST(q_attention_demand <> '' AND q_attention_demand = attention_demand AS INT)
        + CAST(q_discovery_style <> '' AND q_discovery_style = discovery_style AS INT) AS score FROM matched)""",
)
def _(t):
    return ranking.rank_pool(filters.with_score(matched(t)), by_tier=False).select("request_id", "id", "score", "position")


@query("pool_exact_then_fallback", ["ranked_pool"], "SELECT request_id, id, tier, score, position, pool_size FROM ranked_pool")
def _(t):
    return ranking.rank_pool(pool(t)).select("request_id", "id", "tier", "score", "position", "pool_size")


@query("relax_if_few", ["relaxed"], "SELECT request_id, id, tier, exact_count FROM relaxed")
def _(t):
    return filters.relax_if_few(matched(t)).select("request_id", "id", "tier", "exact_count")


@query("slate_page", ["slate"], "SELECT request_id, slot, id, title, tier, pool_size, next_offset FROM slate")
def _(t):
    return slate(t).select("request_id", "slot", "id", "title", "tier", "pool_size", "next_offset")


@query(
    "filter_favorites",
    ["catalogue"],
    """SELECT DISTINCT o_custkey AS user_id, c.id, c.ord FROM lineitem JOIN orders ON o_orderkey = l_orderkey
       JOIN catalogue c ON c.id = 'm' || l_partkey WHERE l_returnflag <> 'R'""",
)
def _(t):
    saved = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("m"), F.col("l_partkey").cast("string"))).alias("id"),
    )
    return filters.filter_favorites(t.catalogue, saved).select("user_id", "id", "ord")


# the seeds are the first item of each language
CTES["seeds"] = (("catalogue",), "SELECT * FROM catalogue QUALIFY row_number() OVER (PARTITION BY languages[1] ORDER BY ord) = 1")
SIMILAR_SQL = """
scored AS (SELECT s.id AS seed_id, c.id, c.ord,
  2 * len(list_filter(s.moods, lambda x: list_contains(c.moods, x))) + 2 * len(list_filter(s.genres, lambda x: list_contains(c.genres, x)))
  + len(list_filter(s.situations, lambda x: list_contains(c.situations, x)))
  + CAST(s.pace = c.pace AS INT) + CAST(s.emotional_weight = c.emotional_weight AS INT)
  + CAST(s.attention_demand = c.attention_demand AS INT) + CAST(s.discovery_style = c.discovery_style AS INT) AS score
  FROM seeds s JOIN catalogue c ON c.id <> s.id)
SELECT seed_id, id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, ord) AS rn FROM scored) WHERE rn <= {k}
"""


def _seeds(t: Tables) -> DataFrame:
    per_language = t.catalogue.withColumn("language", F.element_at("languages", 1))
    return ranking.first_per_group(per_language, ["language"], [F.col("ord")], 1, "r")


def _similar(t: Tables, k: int) -> DataFrame:
    found = ranking.similar_items(t.catalogue, _seeds(t), k)
    return found.select("seed_id", "id", F.col("score").cast("bigint").alias("score"), F.col("rn").cast("bigint").alias("rn"))


@query("similar_items", ["seeds"], SIMILAR_SQL.format(k=10))
def _(t):
    return _similar(t, 10)


@query("top_k_similar", ["seeds"], SIMILAR_SQL.format(k=3))
def _(t):
    return _similar(t, 3)


CTES["differences"] = (
    ("slate",),
    """
SELECT *, row_number() OVER (PARTITION BY request_id, first_id, second_id ORDER BY priority) AS rank FROM (
 SELECT *, count(*) FILTER (WHERE summary IS NOT NULL AND category IN ('attention','emotional weight'))
     OVER (PARTITION BY request_id, first_id, second_id ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
 FROM (
  SELECT p.request_id, a.id AS first_id, b.id AS second_id, p.category,
   CASE p.category WHEN 'attention' THEN CASE WHEN a.q_attention_demand <> '' THEN 1 ELSE 14 END
     WHEN 'emotional weight' THEN CASE WHEN a.q_emotional_weight <> '' OR a.avoid_heavy THEN 2 ELSE 13 END
     WHEN 'style' THEN CASE WHEN a.q_discovery_style <> '' THEN 3 ELSE 15 END
     WHEN 'pace' THEN CASE WHEN a.q_pace <> '' OR a.avoid_slow THEN 4 ELSE 11 END
     WHEN 'runtime' THEN CASE WHEN a.q_runtime <> '' OR a.under_two_hours THEN 5 ELSE 12 END
     WHEN 'genre' THEN 16 ELSE 17 END AS priority,
   CASE p.category WHEN 'attention' THEN a.attention_demand <> b.attention_demand WHEN 'emotional weight' THEN a.emotional_weight <> b.emotional_weight
     WHEN 'style' THEN a.discovery_style <> b.discovery_style WHEN 'pace' THEN a.pace <> b.pace WHEN 'runtime' THEN a.runtime_minutes <> b.runtime_minutes
     WHEN 'genre' THEN list_sort(list_distinct(a.genres)) <> list_sort(list_distinct(b.genres))
     ELSE list_sort(list_distinct(a.moods)) <> list_sort(list_distinct(b.moods)) END AS differs,
   CASE p.category WHEN 'attention' THEN CASE a.attention_demand WHEN 'easy' THEN 'easygoing' WHEN 'engaged' THEN 'engaging' ELSE 'immersive' END
     WHEN 'emotional weight' THEN CASE a.emotional_weight WHEN 'light' THEN 'lighter' WHEN 'moderate' THEN 'emotionally balanced' ELSE 'heavier' END
     WHEN 'style' THEN a.discovery_style WHEN 'pace' THEN CASE a.pace WHEN 'slow' THEN 'slower' WHEN 'medium' THEN 'steady' ELSE 'faster' END
     WHEN 'runtime' THEN a.runtime_minutes || CASE WHEN a.runtime_minutes < 100 THEN ' min, shorter' WHEN a.runtime_minutes <= 130 THEN ' min, medium length' ELSE ' min, longer' END
     WHEN 'genre' THEN array_to_string(a.genres, ', ') ELSE array_to_string(list_filter(a.moods, lambda m: NOT list_contains(b.moods, m)), ', ') END AS first_value,
   CASE p.category WHEN 'attention' THEN CASE b.attention_demand WHEN 'easy' THEN 'easygoing' WHEN 'engaged' THEN 'engaging' ELSE 'immersive' END
     WHEN 'emotional weight' THEN CASE b.emotional_weight WHEN 'light' THEN 'lighter' WHEN 'moderate' THEN 'emotionally balanced' ELSE 'heavier' END
     WHEN 'style' THEN b.discovery_style WHEN 'pace' THEN CASE b.pace WHEN 'slow' THEN 'slower' WHEN 'medium' THEN 'steady' ELSE 'faster' END
     WHEN 'runtime' THEN b.runtime_minutes || CASE WHEN b.runtime_minutes < 100 THEN ' min, shorter' WHEN b.runtime_minutes <= 130 THEN ' min, medium length' ELSE ' min, longer' END
     WHEN 'genre' THEN array_to_string(b.genres, ', ') ELSE array_to_string(list_filter(b.moods, lambda m: NOT list_contains(a.moods, m)), ', ') END AS second_value,
   CASE WHEN p.category IN ('attention','emotional weight') THEN
       CASE WHEN (e.aw < e.bw OR e.aa < e.ba) AND NOT (e.bw < e.aw OR e.ba < e.aa) THEN a.title || ' is the gentler, lower-effort watch tonight.'
            WHEN (e.bw < e.aw OR e.ba < e.aa) AND NOT (e.aw < e.bw OR e.aa < e.ba) THEN b.title || ' is the gentler, lower-effort watch tonight.' END
     WHEN p.category = 'pace' AND a.pace <> 'medium' AND b.pace <> 'medium' THEN
       CASE WHEN a.pace = 'fast' THEN a.title || ' moves faster; ' || b.title || ' takes its time.' ELSE b.title || ' moves faster; ' || a.title || ' takes its time.' END
     WHEN p.category = 'runtime' AND abs(a.runtime_minutes - b.runtime_minutes) >= 25 THEN
       CASE WHEN a.runtime_minutes < b.runtime_minutes THEN a.title ELSE b.title END || ' is the shorter commitment tonight.'
     WHEN p.category = 'runtime' AND abs(a.runtime_minutes - b.runtime_minutes) >= 10 THEN
       CASE WHEN a.runtime_minutes < b.runtime_minutes THEN b.title ELSE a.title END || ' asks for about ' || abs(a.runtime_minutes - b.runtime_minutes) || ' more minutes.' END AS summary
  FROM (SELECT DISTINCT request_id, category FROM slate, (VALUES ('attention'),('emotional weight'),('style'),('pace'),('runtime'),('genre'),('mood')) c(category)) p
  JOIN slate a ON a.request_id = p.request_id JOIN slate b ON b.request_id = a.request_id AND a.slot < b.slot
  , LATERAL (SELECT list_position(['light','moderate','heavy'], a.emotional_weight) AS aw, list_position(['light','moderate','heavy'], b.emotional_weight) AS bw,
      list_position(['easy','engaged','immersive'], a.attention_demand) AS aa, list_position(['easy','engaged','immersive'], b.attention_demand) AS ba) e
 ) WHERE differs)
WHERE NOT (category IN ('attention','emotional weight') AND summary IS NOT NULL AND earlier > 0)
""",
)
_PAIR_COLUMNS = "request_id, first_id, second_id, rank, category, first_value, second_value, summary"


@query("compare_pairs", ["differences"], f"SELECT {_PAIR_COLUMNS} FROM differences WHERE rank <= 2")
def _(t):
    return slates.compare_pairs(slate(t)).withColumn("rank", F.col("rank").cast("bigint"))


@query("limit_factors", ["differences"], f"SELECT {_PAIR_COLUMNS} FROM differences WHERE rank <= 1")
def _(t):
    return slates.compare_pairs(slate(t), limit=1).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "outlier_of_three",
    ["slate"],
    """
three AS (SELECT * FROM slate QUALIFY count(*) OVER (PARTITION BY request_id) = 3),
long AS (
  SELECT request_id, id, slot, 1 AS d, 'attention_demand' AS dim, attention_demand AS v, q_attention_demand <> '' AS settled FROM three
  UNION ALL SELECT request_id, id, slot, 2, 'emotional_weight', emotional_weight, q_emotional_weight <> '' OR (avoid_heavy AND max(emotional_weight = 'heavy') OVER (PARTITION BY request_id)) FROM three
  UNION ALL SELECT request_id, id, slot, 3, 'pace', pace, q_pace <> '' OR (avoid_slow AND max(pace = 'slow') OVER (PARTITION BY request_id)) FROM three),
val AS (SELECT request_id, d, dim, v, bool_or(settled) AS settled, count(*) AS n, list(id ORDER BY slot) AS ids FROM long GROUP BY ALL),
split AS (SELECT m.request_id, m.d, m.dim, m.v AS mv, o.v AS ov, m.ids AS mids, o.ids[1] AS oid FROM val m JOIN val o ON m.request_id = o.request_id AND m.d = o.d AND m.n = 2 AND o.n = 1
  WHERE NOT m.settled AND CASE m.dim WHEN 'attention_demand' THEN 'easy' IN (m.v, o.v) WHEN 'emotional_weight' THEN 'heavy' IN (m.v, o.v) ELSE 'slow' IN (m.v, o.v) AND 'fast' IN (m.v, o.v) END)
SELECT request_id, arg_min(oid, d) AS outlier_id, array_to_string(arg_min(mids, d), '|') AS majority_ids, string_agg(dim, '|' ORDER BY d) AS dimensions,
 arg_min(CASE dim WHEN 'attention_demand' THEN CASE WHEN ov = 'easy' THEN 'It asks less of your attention than the other two.' ELSE 'It asks for more of your attention; the other two are easier to settle into.' END
   WHEN 'emotional_weight' THEN CASE WHEN ov = 'heavy' THEN 'It carries a heavier emotional charge than the other two.' ELSE 'It stays emotionally lighter than the other two.' END
   ELSE CASE WHEN ov = 'fast' THEN 'It moves at a much quicker clip; the other two take their time.' ELSE 'It takes its time more than the other two.' END END, d) AS observation
FROM split GROUP BY request_id HAVING count(DISTINCT oid) = 1
""",
)
def _(t):
    out = slates.outlier_of_three(slate(t))
    return out.withColumns({"majority_ids": joined("majority_ids"), "dimensions": joined("dimensions")})


@query(
    "reason_list",
    ["pool"],
    """SELECT request_id, id, concat_ws('|', 'fits your ' || q_mood || ' mood',
  CASE WHEN q_situation <> '' AND list_contains(situations, q_situation) THEN 'perfect for ' || CASE q_situation WHEN 'alone' THEN 'you alone' WHEN 'date-night' THEN 'a date night' WHEN 'friends' THEN 'friends' WHEN 'family' THEN 'the family' ELSE 'an easy watch' END END,
  CASE WHEN q_attention_demand = attention_demand THEN 'matches the ' || CASE attention_demand WHEN 'easy' THEN 'easygoing' WHEN 'engaged' THEN 'engaging' ELSE 'immersive' END || ' headspace' END,
  CASE WHEN q_discovery_style = discovery_style THEN 'keeps things ' || discovery_style END,
  CASE WHEN q_pace = pace THEN CASE pace WHEN 'medium' THEN 'keeps an even rhythm' WHEN 'slow' THEN 'leans slower' ELSE 'leans faster' END END,
  CASE WHEN q_emotional_weight = emotional_weight THEN CASE emotional_weight WHEN 'moderate' THEN 'has room for feeling without going all the way under' WHEN 'light' THEN 'stays lighter' ELSE 'stays heavier' END END) AS reasons
FROM pool""",
)
def _(t):
    return pool(t).select("request_id", "id", joined(slates.reason_list()).alias("reasons"))


@query(
    "presentation_labels",
    ["catalogue"],
    """SELECT id, year || ' · ' || runtime_minutes || ' min' AS compact_facts, array_to_string(genres[1:2], ' · ') AS genre_summary,
  CASE WHEN emotional_weight = 'light' THEN 'Gentle emotional lift' WHEN emotional_weight = 'heavy' THEN 'Emotionally weighty'
    WHEN pace = 'slow' THEN 'Patient burn' WHEN pace = 'fast' THEN 'Moves quickly'
    WHEN attention_demand = 'easy' THEN 'Easygoing' WHEN attention_demand = 'engaged' THEN 'Keeps you engaged' ELSE 'Full-attention watch' END AS cue,
  CASE pace WHEN 'slow' THEN 'Slow burn' WHEN 'fast' THEN 'Fast-moving' ELSE 'Balanced pace' END AS pace_label,
  upper(emotional_weight[1]) || emotional_weight[2:] AS weight_label,
  'Ends around ' || strftime(TIMESTAMP '2024-01-01 22:15:00' + to_minutes(runtime_minutes), '%-I:%M %p') AS finish_label
FROM catalogue""",
)
def _(t):
    now = F.lit("2024-01-01 22:15:00").cast("timestamp_ntz")
    return t.catalogue.select("id", *[c.alias(n) for n, c in slates.presentation_labels(now).items()])


def _links(t: Tables) -> DataFrame:
    """One shared link per catalogue row; sizes and types decide its shape and its defects."""
    part = t.raw("part")
    key, size = F.col("p_partkey"), F.col("p_size")
    m = lambda k: F.concat(F.lit("m"), k.cast("string"))
    moods = F.array(*[F.lit(v) for v in ["funny", "exciting", "thoughtful", "relaxing", "emotional", "suspenseful", "gloomy"]])
    state = (
        F.when(size <= 15, F.concat(F.lit("ts:"), m(key), F.lit(";"), m(key + 1), F.lit(";"), m(key + 2)))
        .when(size <= 25, F.concat(F.lit("dl:"), m(key), F.lit(";"), m(key + 3)))
        .when(size <= 30, F.concat(F.lit("dl:"), m(key), F.lit(";"), m(key + 1), F.lit(";md;"), m(key + 2)))
        .when(size <= 40, F.concat(F.lit("pk:"), m(key)))
        .when(size <= 45, F.concat(F.lit("pk:"), m(key), F.lit(";three;"), m(key), F.lit(";"), m(key + 1), F.lit(";"), m(key + 2)))
        .when(size == 46, F.concat(F.lit("ts:"), m(key)))
        .when(size == 47, F.lit("nothing"))
        .otherwise(F.concat(F.lit("pk:"), m(key), F.lit(";duel;dl:"), m(key), F.lit(";"), m(key + 4)))
    )
    filt = F.when(F.col("p_type") == "SMALL", F.concat(F.lit("g="), F.replace("p_name", F.lit(" "), F.lit(",")), F.lit("|r=short|p=slow"))).when(
        F.col("p_type") == "LARGE", "r=endless"
    ).otherwise("")
    pref = F.when(F.col("p_type") == "PROMO", "a=easy|dh=1|dt=1").otherwise("")
    part = settle(part, state=state, filt=filt, pref=pref)
    return part.select(
        key.alias("link_id"),
        F.concat(
            F.lit("https://app.example/?mode="), F.when(size == 2, "simple").otherwise("decision"),
            F.lit("&v="), F.when(size % 2 == 0, "v4").otherwise("v6"),
            F.lit("&m="), F.element_at(moods, (key % 7 + 1).cast("int")),
            F.lit("&s="), F.when(size % 3 == 0, "date-night").otherwise("nowhere"),
            F.lit("&f="), F.url_encode("filt"), F.lit("&d="), F.url_encode("pref"), F.lit("&ds="), F.url_encode("state"), F.lit("#top"),
        ).alias("url"),
    )


@query(
    "apply_share_link_state",
    (),
    """
SELECT p_partkey AS link_id, CASE WHEN p_size % 2 = 0 THEN 'v4' ELSE 'v6' END AS version,
  ['funny','exciting','thoughtful','relaxing','emotional','suspenseful'][CAST(p_partkey % 7 AS INT) + 1] AS mood,
  CASE WHEN p_size % 3 = 0 THEN 'date-night' END AS situation,
  CASE WHEN p_type = 'SMALL' THEN replace(p_name, ' ', '|') ELSE '' END AS genres,
  CASE WHEN p_type = 'SMALL' THEN 'short' END AS runtime, NULL AS language, CASE WHEN p_type = 'SMALL' THEN 'slow' END AS pace,
  NULL AS emotional_weight, CASE WHEN p_type = 'PROMO' THEN 'easy' END AS attention_demand, NULL AS discovery_style,
  p_type = 'PROMO' AS avoid_heavy, false AS avoid_slow, p_type = 'PROMO' AS under_two_hours,
  CASE WHEN p_size <= 15 THEN 'ts' WHEN p_size <= 30 THEN 'dl' ELSE 'pk' END AS kind,
  CASE WHEN p_size <= 15 THEN 'm' || p_partkey || '|m' || (p_partkey + 1) || '|m' || (p_partkey + 2)
    WHEN p_size <= 25 THEN 'm' || p_partkey || '|m' || (p_partkey + 3)
    WHEN p_size <= 30 THEN 'm' || p_partkey || '|m' || (p_partkey + 1) || '|m' || (p_partkey + 2)
    WHEN p_size <= 40 THEN 'm' || p_partkey
    WHEN p_size <= 45 THEN 'm' || p_partkey || '|m' || p_partkey || '|m' || (p_partkey + 1) || '|m' || (p_partkey + 2)
    ELSE 'm' || p_partkey || '|m' || p_partkey || '|m' || (p_partkey + 4) END AS ids
FROM part, (SELECT max(p_partkey) AS top FROM part) x
WHERE p_size NOT IN (2, 46, 47) AND p_partkey % 7 <> 6 AND p_type <> 'LARGE'
  AND CASE WHEN p_size <= 15 THEN p_partkey + 2 WHEN p_size <= 25 THEN p_partkey + 3 WHEN p_size <= 30 THEN p_partkey + 2
     WHEN p_size <= 40 THEN p_partkey WHEN p_size <= 45 THEN p_partkey + 2 ELSE p_partkey + 4 END <= top
""",
)
def _(t):
    return slates.decode_links(_links(t), t.catalogue)


@query(
    "distinct_options",
    ["catalogue"],
    """o AS (SELECT DISTINCT 'genre' AS option, unnest(genres) AS value FROM catalogue UNION SELECT DISTINCT 'language', unnest(languages) FROM catalogue)
       SELECT option, value, row_number() OVER (ORDER BY option, value) AS place FROM o""",
)
def _(t):
    each = F.explode(
        F.concat(
            F.transform("genres", lambda g: F.named_struct(F.lit("option"), F.lit("genre"), F.lit("value"), g)),
            F.transform("languages", lambda v: F.named_struct(F.lit("option"), F.lit("language"), F.lit("value"), v)),
        )
    )
    options = t.catalogue.select(each.alias("o")).select("o.*").distinct()
    buckets = [(F.col("option"), True), (F.substring("value", 1, 2), True)]
    return ranked(options, [], [F.col("option").asc(), F.col("value").asc()], buckets, out="place").orderBy("place")


@query(
    "distribution_matrix",
    ["catalogue"],
    """
cells AS (SELECT mood, situation, count(*) AS n FROM (SELECT id, unnest(moods) AS mood, situations FROM catalogue), LATERAL (SELECT unnest(situations) AS situation) GROUP BY ALL),
wide AS (PIVOT cells ON situation IN ('alone','date-night','friends','family','easy-watch') USING sum(n) GROUP BY mood)
SELECT mood, COALESCE("alone",0)::BIGINT AS alone, COALESCE("date-night",0)::BIGINT AS date_night, COALESCE("friends",0)::BIGINT AS friends, COALESCE("family",0)::BIGINT AS family, COALESCE("easy-watch",0)::BIGINT AS easy_watch,
  CAST(least(COALESCE("alone",0), COALESCE("date-night",0), COALESCE("friends",0), COALESCE("family",0), COALESCE("easy-watch",0)) AS BIGINT) AS smallest FROM wide
""",
)
def _(t):
    wide = (
        t.catalogue.select(F.explode("moods").alias("mood"), "situations")
        .select("mood", F.explode("situations").alias("situation"))
        .groupBy("mood")
        .pivot("situation", SITUATIONS)
        .count()
        .fillna(0)
    )
    named = wide.select("mood", *[F.col(f"`{s}`").alias(s.replace("-", "_")) for s in SITUATIONS])
    return named.withColumn("smallest", F.least(*[F.col(s.replace("-", "_")) for s in SITUATIONS]))


SOFT_AXES = ("attention_demand", "discovery_style")


def axis_audit(catalogue: DataFrame) -> DataFrame:
    """Per mood and axis value: how many rows carry it and whether choosing it changes the first three.

    Hard axes filter the pool; soft axes only reorder it.  The first three rows of
    every (mood, axis, value) are enough to build each slate, so slates are made
    from that bounded table.
    """
    pair = lambda axis, value: F.named_struct(F.lit("axis"), F.lit(axis), F.lit("value"), value)
    axes = F.concat(
        F.transform("situations", lambda s: pair("situation", s)),
        F.array(
            pair("runtime", filters.runtime_bucket(F.col("runtime_minutes"))),
            *[pair(a, F.col(a)) for a in ("pace", "emotional_weight", *SOFT_AXES)],
        ),
    )
    long = catalogue.select(F.explode("moods").alias("mood"), "ord", "id", axes.alias("axes")).select(
        "mood", "ord", "id", F.explode("axes").alias("a")
    ).select("mood", "ord", "id", "a.axis", "a.value")
    counts = long.groupBy("mood", "axis", "value").agg(F.count(F.lit(1)).alias("value_count"))
    pools = counts.where(F.col("axis") == "pace").groupBy("mood").agg(F.sum("value_count").alias("pool_size"))
    heads = ranking.first_per_group(_near_the_first(long, ["mood", "axis", "value"], "ord", "id", 3), ["mood", "axis", "value"], [F.col("ord")], 3, "r")
    options = counts.select("mood", "axis", F.col("value").alias("chosen"))
    seen = heads.join(options, ["mood", "axis"]).where(
        F.col("axis").isin(*SOFT_AXES) | (F.col("value") == F.col("chosen"))
    )
    ordered = Window.partitionBy("mood", "axis", "chosen").orderBy((F.col("value") == F.col("chosen")).desc(), "ord")
    chosen = _slate_text(seen.withColumn("p", F.row_number().over(ordered)).where("p <= 3"), ["mood", "axis", "chosen"])
    base_rows = ranking.first_per_group(heads.where(F.col("axis") == "pace"), ["mood"], [F.col("ord")], 3, "p")
    base = _slate_text(base_rows, ["mood"]).withColumnRenamed("slate", "base_slate")
    return (
        counts.join(pools, "mood")
        .join(chosen.withColumnRenamed("chosen", "value"), ["mood", "axis", "value"])
        .join(base, "mood")
        .select("mood", "axis", "value", "pool_size", "value_count", "slate", (F.col("slate") != F.col("base_slate")).alias("changes_slate"))
    )


SAMPLES = 64


def _near_the_first(rows: DataFrame, keys: list[str], order: str, key: str, n: int) -> DataFrame:
    """The rows of each group that may be among its first ``n``, and few others, without sorting a group.

    Rows are dealt over samples by a hash; the first rows of ``n`` samples are ``n`` rows of the group, so nothing behind the
    ``n``-th of them can be among the first ``n``.  Groups with rows in fewer samples keep all rows, and null, the first
    in order, stays.  The keys are short
    vocabularies, so the limits are few.
    """
    at = F.col(order)
    firsts = rows.groupBy(*keys, F.pmod(F.xxhash64(order, key), F.lit(SAMPLES)).alias("__sample")).agg(F.min(at).alias("__first"))
    limits = firsts.groupBy(*keys).agg(F.get(F.sort_array(F.collect_list("__first")), F.lit(n - 1)).alias("__limit"))
    limits = limits.select(*[F.col(k).alias(f"__{k}") for k in keys], "__limit")
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    met = rows.join(F.broadcast(limits), same).where(F.col("__limit").isNull() | at.isNull() | (at <= F.col("__limit")))
    return met.select(*rows.columns)


def _slate_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    ids: Column = F.transform(F.sort_array(F.collect_list(F.struct("p", "id"))), lambda s: s["id"])
    return rows.groupBy(*keys).agg(F.array_join(ids, "|").alias("slate"))


@query(
    "axis_audit",
    ["catalogue"],
    """
m AS (SELECT *, unnest(moods) AS mood FROM catalogue),
ax AS (
  SELECT mood, ord, id, 'situation' AS axis, unnest(situations) AS value FROM m
  UNION ALL SELECT mood, ord, id, 'runtime', CASE WHEN runtime_minutes < 100 THEN 'short' WHEN runtime_minutes <= 130 THEN 'medium' ELSE 'long' END FROM m
  UNION ALL SELECT mood, ord, id, 'pace', pace FROM m UNION ALL SELECT mood, ord, id, 'emotional_weight', emotional_weight FROM m
  UNION ALL SELECT mood, ord, id, 'attention_demand', attention_demand FROM m UNION ALL SELECT mood, ord, id, 'discovery_style', discovery_style FROM m),
cnt AS (SELECT mood, axis, value, count(*) AS value_count FROM ax GROUP BY ALL),
base AS (SELECT mood, count(*) AS pool_size, string_agg(id, '|' ORDER BY ord) FILTER (WHERE rn <= 3) AS base_slate FROM (SELECT *, row_number() OVER (PARTITION BY mood ORDER BY ord) AS rn FROM m) GROUP BY mood),
sl AS (SELECT mood, axis, chosen, string_agg(id, '|' ORDER BY rn) AS slate FROM (
  SELECT c.mood, c.axis, c.value AS chosen, a.id, row_number() OVER (PARTITION BY c.mood, c.axis, c.value ORDER BY (a.value = c.value) DESC, a.ord) AS rn
  FROM cnt c JOIN ax a ON a.mood = c.mood AND a.axis = c.axis AND (c.axis IN ('attention_demand','discovery_style') OR a.value = c.value)) WHERE rn <= 3 GROUP BY ALL)
SELECT c.mood, c.axis, c.value, pool_size, value_count, slate, slate <> base_slate AS changes_slate
FROM cnt c JOIN base b ON b.mood = c.mood JOIN sl s ON s.mood = c.mood AND s.axis = c.axis AND s.chosen = c.value
""",
)
def _(t):
    return axis_audit(t.catalogue)
