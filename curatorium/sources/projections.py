"""Projections of the star-schema tables onto the curated data model.

Each projection exists twice: as a DataFrame (``Tables``) and as SQL (``CTES``),
so a result can be checked against an independent engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.schemas import MOODS, SITUATIONS

# (dependencies, SQL) per projection name
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _two_sql(values: list[str], a: str, b: str) -> str:
    lst, n = _sql_list(values), len(values)
    return (
        f"CASE WHEN {a} % {n} = {b} % {n} THEN [{lst}[CAST({a} % {n} AS INT) + 1]] "
        f"ELSE [{lst}[CAST({a} % {n} AS INT) + 1], {lst}[CAST({b} % {n} AS INT) + 1]] END"
    )


# request_id, mood, situation, genres, runtime, language, pace, weight, attention, style,
# avoid_heavy, avoid_slow, under_two_hours, page_offset  ('' = not set)
REQUEST_COLUMNS = (
    "request_id, mood, situation, genres, runtime, language, pace, emotional_weight, attention_demand, "
    "discovery_style, avoid_heavy, avoid_slow, under_two_hours, page_offset"
)
REQUEST_VALUES = """
(1, 'funny', '', '', '', '', '', '', '', '', false, false, false, 0),
(2, 'exciting', 'friends', '', '', '', '', '', 'easy', '', true, false, false, 3),
(3, 'thoughtful', 'alone', 'red', '', '', '', 'heavy', 'immersive', 'adventurous', false, false, false, 1),
(4, 'relaxing', 'family', '', 'short', '', '', '', '', 'familiar', false, true, false, 0),
(5, 'emotional', 'date-night', '', 'medium', '', 'medium', '', '', '', false, false, true, 6),
(6, 'suspenseful', 'easy-watch', '', 'long', '', '', '', 'engaged', 'different', false, false, false, 2),
(7, 'funny', 'family', 'red', 'short', 'Brand#3', 'slow', '', '', '', false, false, false, 0),
(8, 'funny', 'family', 'red', 'short', 'Brand#7', 'slow', '', 'easy', 'familiar', true, false, false, 0),
(9, 'exciting', 'alone', 'plate', '', 'Brand#11', '', 'light', '', '', false, false, true, 1),
(10, 'thoughtful', 'friends', 'red,plate', '', '', '', '', 'immersive', '', false, true, true, 5),
(11, 'relaxing', 'date-night', 'hot', 'medium', 'Brand#21', 'medium', '', 'easy', 'different', false, false, false, 1000),
(12, 'emotional', '', 'small', '', '', 'fast', 'moderate', '', 'adventurous', true, true, false, 4),
(13, 'suspenseful', 'alone', '', '', 'Brand#5', '', '', '', '', false, false, false, 0),
(14, 'funny', 'easy-watch', 'large,rod', 'long', 'Brand#2', 'fast', 'heavy', '', '', false, false, false, 0),
(15, 'exciting', 'family', 'ring', '', '', 'slow', 'light', 'engaged', '', false, false, true, 2),
(16, '', 'friends', '', '', '', '', '', '', '', false, false, false, 0),
(17, 'thoughtful', 'easy-watch', '', '', '', 'slow', 'heavy', '', 'familiar', true, false, false, 0),
(18, 'relaxing', 'alone', 'widget', 'long', 'Brand#9', '', '', '', '', false, true, false, 7),
(19, 'emotional', 'friends', 'hot,ring', 'medium', 'Brand#14', '', '', 'immersive', '', false, false, true, 1),
(20, 'suspenseful', 'date-night', '', 'short', '', 'slow', 'moderate', 'easy', 'different', false, false, false, 9)
"""

# stratum, first ship date, last ship date, quota
STRATA_VALUES = """
('s1', '1995-01-01', '1996-06-30', 24),
('s2', '1996-07-01', '1997-12-31', 24),
('s3', '1998-01-01', '1998-12-31', 33),
('s4', '1999-01-01', '2000-06-30', 45),
('s5', '2000-07-01', '2001-12-31', 54)
"""

CTES["requests"] = ((), f"SELECT * FROM (VALUES {REQUEST_VALUES}) AS r({REQUEST_COLUMNS})")
CTES["strata"] = ((), f"SELECT * FROM (VALUES {STRATA_VALUES}) AS s(stratum, gte, lte, quota)")

CTES["catalogue"] = (
    (),
    f"""
SELECT 'm' || p_partkey AS id, p_partkey AS ord, p_partkey AS tmdb_id, p_name AS title,
  1980 + p_partkey % 45 AS year, string_split(p_name, ' ') AS genres, [p_brand] AS languages,
  {_two_sql(MOODS, "p_size", "p_partkey")} AS moods,
  {_two_sql(SITUATIONS, "p_partkey", "p_size")} AS situations,
  CASE WHEN p_size <= 16 THEN 'slow' WHEN p_size <= 33 THEN 'medium' ELSE 'fast' END AS pace,
  CASE WHEN p_type IN ('ECONOMY','STANDARD') THEN 'light' WHEN p_type IN ('PROMO','SMALL') THEN 'moderate' ELSE 'heavy' END AS emotional_weight,
  ['easy','engaged','immersive'][CAST(p_partkey % 3 AS INT) + 1] AS attention_demand,
  ['familiar','different','adventurous'][CAST((p_partkey // 3) % 3 AS INT) + 1] AS discovery_style,
  70 + 2 * p_size AS runtime_minutes,
  'A ' || lower(p_type) || ' tale of the ' || p_name || ' from ' || p_brand AS description,
  CASE WHEN p_size = 50 THEN 'Watch.' ELSE 'Watch the ' || p_name || ' for its ' || lower(p_type) || ' charm' END AS why_watch,
  CASE WHEN p_size = 49 THEN 'A ' || lower(p_type) || ' tale of the ' || p_name || ' from ' || p_brand || '?' ELSE 'What hides behind the ' || p_name || '?' END AS curiosity_hook,
  'size ' || p_size || ' and ' || lower(p_type) AS vibe_summary,
  [printf('#%06x', (p_partkey * 7919) % 16777216),
   CASE WHEN p_size = 48 THEN '#zz0000' WHEN p_size = 47 THEN printf('#%06x', (p_partkey * 7919) % 16777216) ELSE printf('#%06x', (p_partkey * 104729 + 17) % 16777216) END] AS palette
FROM part
""",
)

# parts without shipments and the large promo parts carry no facts
CTES["facts"] = (
    (),
    """
SELECT 'm' || p.p_partkey AS id, p.p_partkey AS tmdb_id, p.p_name AS title,
  CAST(1980 + p.p_partkey % 45 AS INT) AS year, 'Director ' || (p.p_partkey % 40) AS director,
  ['Country ' || (p.p_partkey % 7)] AS countries, [p.p_brand] AS spoken_languages,
  string_split(p.p_name, ' ') AS genres,
  CASE WHEN p.p_size = 46 THEN 0 ELSE 70 + 2 * p.p_size END AS runtime_minutes,
  CASE WHEN p.p_size % 13 = 0 THEN NULL ELSE '/p' || p.p_partkey || '.jpg' END AS poster_path,
  CASE WHEN p.p_size < 5 THEN p.p_name ELSE 'A ' || lower(p.p_type) || ' story about the ' || p.p_name || ' of ' || p.p_brand END AS overview,
  CASE WHEN CAST(substr(p.p_brand, 7) AS INT) <= 12 THEN 'en' ELSE 'l' || substr(p.p_brand, 7) END AS original_language,
  p.p_type = 'PROMO' AND p.p_size = 1 AS adult, p.p_size % 10 = 3 AS softcore,
  l.votes, l.rating, l.release_date
FROM part p JOIN (
  SELECT l_partkey, count(*) * 40 AS votes, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS rating,
    strftime(min(l_shipdate), '%Y-%m-%d') AS release_date
  FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey
WHERE NOT (p.p_type = 'PROMO' AND p.p_size >= 49)
""",
)

CTES["corpus"] = (
    (),
    """
SELECT l_partkey AS id, 'y' || year(l_shipdate) AS cell, l_linenumber AS page, l_orderkey AS source_order,
  CAST(floor(l_extendedprice) AS BIGINT) AS votes, CAST(l_quantity AS BIGINT) AS rating,
  strftime(l_shipdate, '%Y-%m-%d') AS release_date
FROM lineitem
""",
)

# three sources of already held or rejected ids
CTES["exclusions"] = (
    (),
    """
SELECT l_partkey AS id, 'm' || l_partkey AS canonical_id, 'returned' AS reason, 'returns' AS provenance, 1 AS source_ord
FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48 GROUP BY l_partkey
UNION ALL
SELECT l_partkey, 'm' || l_partkey, 'held supplier', 'supplier', 2
FROM lineitem WHERE l_suppkey = 7 GROUP BY l_partkey
UNION ALL
SELECT p_partkey, CASE WHEN p_size = 3 THEN 'x' || p_partkey WHEN p_size = 4 THEN NULL ELSE 'm' || p_partkey END, 'small promo', 'manual', 3
FROM part WHERE p_type = 'PROMO' AND p_size <= 6
""",
)

CTES["human_model"] = (
    (),
    """
SELECT o_orderkey AS id,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'heavy' WHEN o_orderpriority = '3-MEDIUM' THEN 'moderate' ELSE 'light' END AS human_weight,
  CASE WHEN o_totalprice >= 340000 THEN 'heavy' WHEN o_totalprice >= 170000 THEN 'moderate' ELSE 'light' END AS model_weight,
  CASE o_orderstatus WHEN 'F' THEN 'fast' WHEN 'O' THEN 'medium' ELSE 'slow' END AS human_pace,
  CASE WHEN o_custkey % 3 = 0 THEN 'fast' WHEN o_custkey % 3 = 1 THEN 'medium' ELSE 'slow' END AS model_pace,
  CASE WHEN o_orderpriority = '5-LOW' THEN CAST([] AS VARCHAR[]) WHEN o_orderstatus = 'F' THEN ['funny','exciting'] WHEN o_orderstatus = 'O' THEN ['exciting'] ELSE ['thoughtful','relaxing'] END AS human_moods,
  CASE WHEN o_totalprice >= 400000 THEN ['funny','exciting'] WHEN o_totalprice >= 200000 THEN ['exciting','thoughtful','relaxing'] WHEN o_totalprice >= 100000 THEN ['thoughtful'] ELSE CAST([] AS VARCHAR[]) END AS model_moods
FROM orders
""",
)

# one review case per document: human labels where adjudicated, a model payload from the text
CTES["review"] = (
    (),
    """
SELECT 'd' || d.doc_id AS candidate_id, d.doc_id AS ord, d.doc_id + 1000 AS tmdb_id, d.lang, d.source, d.n_chars, d.text,
  CASE l.quality WHEN 0 THEN 'REVISE' WHEN 1 THEN 'APPROVE' END AS human_decision,
  CASE WHEN l.quality = 0 AND l.toxic = 1 THEN 'SEVERE' WHEN l.quality = 0 THEN 'MINOR' END AS severity,
  CASE WHEN d.n_chars < 60 THEN 'MALFORMED_JSON' WHEN d.n_chars > 15000 THEN 'PROVIDER_FAILURE'
       WHEN regexp_matches(d.text, '[0-9]{3}') THEN 'VALID_HIGH_RISK'
       WHEN d.lang = 'de' AND d.n_chars > 8000 THEN 'SEMANTICALLY_INVALID'
       WHEN d.lang = 'es' AND d.n_chars < 150 THEN 'SCHEMA_INVALID' ELSE 'VALID_LOW_RISK' END AS disposition,
  CASE WHEN d.n_chars < 400 THEN ['description'] WHEN d.lang = 'en' THEN ['why_watch','vibe_summary'] ELSE ['curiosity_hook'] END AS human_fields,
  CASE WHEN regexp_matches(d.text, '[0-9]{3}') THEN ['description','why_watch'] WHEN d.lang = 'fr' THEN ['curiosity_hook'] ELSE CAST([] AS VARCHAR[]) END AS model_fields
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""",
)

CTES["usage"] = (
    (),
    """
SELECT l_orderkey AS candidate_id, CAST(l_linenumber AS BIGINT) AS attempt,
  CASE WHEN l_linestatus = 'O' THEN 'high' ELSE 'max' END AS arm,
  CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) * 100 END AS input_tokens,
  CAST(floor(l_extendedprice) AS BIGINT) AS output_tokens,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(round(l_discount * 100) AS BIGINT) END AS thinking_tokens,
  CAST(NULL AS BIGINT) AS cached_tokens,
  l_returnflag <> 'R' AS valid, CAST(l_suppkey % 5 AS BIGINT) AS ordinal_matches, CAST(round(l_tax * 100) AS BIGINT) AS latency_ms
FROM lineitem
""",
)

CTES["ledger"] = (
    (),
    """
SELECT event_id AS seq, user_id AS attempt_id,
  CASE event_type WHEN 'signup' THEN 'INTENT' WHEN 'view' THEN 'FETCHING' WHEN 'click' THEN 'RESPONSE' WHEN 'purchase' THEN 'TERMINAL' ELSE 'FAILED' END AS lifecycle,
  CAST(round(value * 100) AS BIGINT) AS cost_cents, props AS payload, CAST(ts AS DATE) AS day
FROM events
""",
)


#: Session setting: partitions for tables of long texts; unset, the files' own splits stay.
TEXT_PARTITIONS = "spark.curatorium.textPartitions"


class Tables:
    """Lazy DataFrames of the raw tables and their projections."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """A table of long texts, in the splits its files give.

        Files of a single row group can't be split; a user who has such files can ask for a number of partitions.
        """
        wanted = self.spark.conf.get(TEXT_PARTITIONS, None)
        return self.raw(name).repartition(int(wanted)) if wanted else self.raw(name)

    def literal(self, values: str, columns: str) -> DataFrame:
        """A fixed parameter table; known size, so safe to broadcast."""
        return self.spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")

    @cached_property
    def requests(self) -> DataFrame:
        return self.literal(REQUEST_VALUES, REQUEST_COLUMNS)

    @cached_property
    def strata(self) -> DataFrame:
        return self.literal(STRATA_VALUES, "stratum, gte, lte, quota")

    @cached_property
    def catalogue(self) -> DataFrame:
        key, size, kind = F.col("p_partkey"), F.col("p_size"), F.lower("p_type")
        description = F.concat(F.lit("A "), kind, F.lit(" tale of the "), "p_name", F.lit(" from "), "p_brand")
        first = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(key * 7919 % 16777216), 6, "0")))
        second = F.concat(F.lit("#"), F.lower(F.lpad(F.hex((key * 104729 + 17) % 16777216), 6, "0")))
        return self.raw("part").select(
            F.concat(F.lit("m"), key.cast("string")).alias("id"),
            key.alias("ord"),
            key.alias("tmdb_id"),
            F.col("p_name").alias("title"),
            (F.lit(1980) + key % 45).alias("year"),
            F.split("p_name", " ").alias("genres"),
            F.array("p_brand").alias("languages"),
            F.array_distinct(F.array(_pick(MOODS, size % 6), _pick(MOODS, key % 6))).alias("moods"),
            F.array_distinct(F.array(_pick(SITUATIONS, key % 5), _pick(SITUATIONS, size % 5))).alias("situations"),
            F.when(size <= 16, "slow").when(size <= 33, "medium").otherwise("fast").alias("pace"),
            F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "light")
            .when(F.col("p_type").isin("PROMO", "SMALL"), "moderate")
            .otherwise("heavy")
            .alias("emotional_weight"),
            _pick(["easy", "engaged", "immersive"], key % 3).alias("attention_demand"),
            _pick(["familiar", "different", "adventurous"], F.floor(key / 3) % 3).alias("discovery_style"),
            (F.lit(70) + size * 2).alias("runtime_minutes"),
            description.alias("description"),
            F.when(size == 50, "Watch.")
            .otherwise(F.concat(F.lit("Watch the "), "p_name", F.lit(" for its "), kind, F.lit(" charm")))
            .alias("why_watch"),
            F.when(size == 49, F.concat(description, F.lit("?")))
            .otherwise(F.concat(F.lit("What hides behind the "), "p_name", F.lit("?")))
            .alias("curiosity_hook"),
            F.concat(F.lit("size "), size.cast("string"), F.lit(" and "), kind).alias("vibe_summary"),
            F.array(first, F.when(size == 48, "#zz0000").when(size == 47, first).otherwise(second)).alias("palette"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        part, key, size = self.raw("part"), F.col("p_partkey"), F.col("p_size")
        shipped = (
            self.raw("lineitem")
            .groupBy("l_partkey")
            .agg(
                (F.count(F.lit(1)) * 40).alias("votes"),
                F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("rating"),
                F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("release_date"),
            )
        )
        brand = F.substring("p_brand", 7, 10)
        about = F.concat(F.lit("A "), F.lower("p_type"), F.lit(" story about the "), "p_name", F.lit(" of "), "p_brand")
        return (
            part.where(~((F.col("p_type") == "PROMO") & (size >= 49)))
            .join(shipped, F.col("l_partkey") == key)
            .select(
                F.concat(F.lit("m"), key.cast("string")).alias("id"),
                key.alias("tmdb_id"),
                F.col("p_name").alias("title"),
                (F.lit(1980) + key % 45).cast("int").alias("year"),
                F.concat(F.lit("Director "), (key % 40).cast("string")).alias("director"),
                F.array(F.concat(F.lit("Country "), (key % 7).cast("string"))).alias("countries"),
                F.array("p_brand").alias("spoken_languages"),
                F.split("p_name", " ").alias("genres"),
                F.when(size == 46, 0).otherwise(F.lit(70) + size * 2).alias("runtime_minutes"),
                F.when(size % 13 == 0, F.lit(None))
                .otherwise(F.concat(F.lit("/p"), key.cast("string"), F.lit(".jpg")))
                .alias("poster_path"),
                F.when(size < 5, F.col("p_name")).otherwise(about).alias("overview"),
                F.when(brand.cast("int") <= 12, "en").otherwise(F.concat(F.lit("l"), brand)).alias("original_language"),
                ((F.col("p_type") == "PROMO") & (size == 1)).alias("adult"),
                (size % 10 == 3).alias("softcore"),
                "votes",
                "rating",
                "release_date",
            )
        )

    @cached_property
    def corpus(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("id"),
            F.concat(F.lit("y"), F.year("l_shipdate").cast("string")).alias("cell"),
            F.col("l_linenumber").alias("page"),
            F.col("l_orderkey").alias("source_order"),
            F.floor("l_extendedprice").cast("bigint").alias("votes"),
            F.col("l_quantity").cast("bigint").alias("rating"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("release_date"),
        )

    @cached_property
    def exclusions(self) -> DataFrame:
        line, part = self.raw("lineitem"), self.raw("part")

        def source(ids: DataFrame, canonical: Column, reason: str, provenance: str, position: int) -> DataFrame:
            return ids.select(
                "id",
                canonical.alias("canonical_id"),
                F.lit(reason).alias("reason"),
                F.lit(provenance).alias("provenance"),
                F.lit(position).alias("source_ord"),
            )

        same = F.concat(F.lit("m"), F.col("id").cast("string"))
        returned = (
            line.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 48))
            .select(F.col("l_partkey").alias("id"))
            .distinct()
        )
        held = line.where(F.col("l_suppkey") == 7).select(F.col("l_partkey").alias("id")).distinct()
        manual = part.where((F.col("p_type") == "PROMO") & (F.col("p_size") <= 6)).select(
            F.col("p_partkey").alias("id"), "p_size"
        )
        renamed = (
            F.when(F.col("p_size") == 3, F.concat(F.lit("x"), F.col("id").cast("string")))
            .when(F.col("p_size") == 4, F.lit(None))
            .otherwise(same)
        )
        return (
            source(returned, same, "returned", "returns", 1)
            .unionByName(source(held, same, "held supplier", "supplier", 2))
            .unionByName(source(manual, renamed, "small promo", "manual", 3))
        )

    @cached_property
    def human_model(self) -> DataFrame:
        priority, price, status = F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_orderstatus")
        none = F.array().cast("array<string>")

        def tags(*names: str) -> Column:
            return F.array(*[F.lit(n) for n in names])

        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.when(priority.isin("1-URGENT", "2-HIGH"), "heavy")
            .when(priority == "3-MEDIUM", "moderate")
            .otherwise("light")
            .alias("human_weight"),
            F.when(price >= 340000, "heavy").when(price >= 170000, "moderate").otherwise("light").alias("model_weight"),
            F.when(status == "F", "fast").when(status == "O", "medium").otherwise("slow").alias("human_pace"),
            F.when(F.col("o_custkey") % 3 == 0, "fast")
            .when(F.col("o_custkey") % 3 == 1, "medium")
            .otherwise("slow")
            .alias("model_pace"),
            F.when(priority == "5-LOW", none)
            .when(status == "F", tags("funny", "exciting"))
            .when(status == "O", tags("exciting"))
            .otherwise(tags("thoughtful", "relaxing"))
            .alias("human_moods"),
            F.when(price >= 400000, tags("funny", "exciting"))
            .when(price >= 200000, tags("exciting", "thoughtful", "relaxing"))
            .when(price >= 100000, tags("thoughtful"))
            .otherwise(none)
            .alias("model_moods"),
        )

    @cached_property
    def review(self) -> DataFrame:
        size, lang = F.col("n_chars"), F.col("lang")
        digits = F.col("text").rlike("[0-9]{3}")

        def tags(*names: str) -> Column:
            return F.array(*[F.lit(n) for n in names])

        return (
            self.texts("documents")
            .join(self.raw("labels"), "doc_id", "left")
            .select(
                F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("candidate_id"),
                F.col("doc_id").alias("ord"),
                (F.col("doc_id") + 1000).alias("tmdb_id"),
                "lang",
                "source",
                "n_chars",
                "text",
                F.when(F.col("quality") == 0, "REVISE").when(F.col("quality") == 1, "APPROVE").alias("human_decision"),
                F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "SEVERE")
                .when(F.col("quality") == 0, "MINOR")
                .alias("severity"),
                F.when(size < 60, "MALFORMED_JSON")
                .when(size > 15000, "PROVIDER_FAILURE")
                .when(digits, "VALID_HIGH_RISK")
                .when((lang == "de") & (size > 8000), "SEMANTICALLY_INVALID")
                .when((lang == "es") & (size < 150), "SCHEMA_INVALID")
                .otherwise("VALID_LOW_RISK")
                .alias("disposition"),
                F.when(size < 400, tags("description"))
                .when(lang == "en", tags("why_watch", "vibe_summary"))
                .otherwise(tags("curiosity_hook"))
                .alias("human_fields"),
                F.when(digits, tags("description", "why_watch"))
                .when(lang == "fr", tags("curiosity_hook"))
                .otherwise(F.array().cast("array<string>"))
                .alias("model_fields"),
            )
        )

    @cached_property
    def usage(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("candidate_id"),
            F.col("l_linenumber").cast("bigint").alias("attempt"),
            F.when(F.col("l_linestatus") == "O", "high").otherwise("max").alias("arm"),
            F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("bigint") * 100).alias("input_tokens"),
            F.floor("l_extendedprice").cast("bigint").alias("output_tokens"),
            F.when(F.col("l_returnflag") != "N", F.round(F.col("l_discount") * 100).cast("bigint")).alias("thinking_tokens"),
            F.lit(None).cast("bigint").alias("cached_tokens"),
            (F.col("l_returnflag") != "R").alias("valid"),
            (F.col("l_suppkey") % 5).cast("bigint").alias("ordinal_matches"),
            F.round(F.col("l_tax") * 100).cast("bigint").alias("latency_ms"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("seq"),
            F.col("user_id").alias("attempt_id"),
            F.when(kind == "signup", "INTENT")
            .when(kind == "view", "FETCHING")
            .when(kind == "click", "RESPONSE")
            .when(kind == "purchase", "TERMINAL")
            .otherwise("FAILED")
            .alias("lifecycle"),
            F.round(F.col("value") * 100).cast("bigint").alias("cost_cents"),
            F.col("props").alias("payload"),
            F.to_date("ts").alias("day"),
        )
