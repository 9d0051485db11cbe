"""Sources and sinks: JSON shapes rebuilt from the tables, parsed back, written and read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatorium.functions.columns import joined
from curatorium.functions.spread import integer_bucket, ranked
from curatorium.operators import ledger
from curatorium.operators.joins import union_all
from curatorium.plans.registry import query
from curatorium.schemas import CATALOGUE
from curatorium.session import ensure_checkpoint_dir
from curatorium.sources import readers, sinks

c = F.col

CATALOGUE_SQL = """SELECT id, ord, title, array_to_string(moods, '|') AS moods, array_to_string(situations, '|') AS situations, pace,
  emotional_weight, attention_demand, discovery_style, array_to_string(palette, '|') AS palette FROM catalogue"""


def _catalogue_text(df):
    return df.select(
        "id", "ord", "title", joined("moods").alias("moods"), joined("situations").alias("situations"), "pace",
        "emotional_weight", "attention_demand", "discovery_style", joined("palette").alias("palette"),
    )


@query("scan_catalogue", ["catalogue"], CATALOGUE_SQL)
def _(t):
    # curated rows as JSON lines, read back through the reader
    path = _folder(t, "catalogue")
    t.catalogue.select(*[f.name for f in CATALOGUE if f.name in t.catalogue.columns]).write.json(path)
    return _catalogue_text(readers.read_catalogue(t.spark, path))


@query("scan_keyed_map", ["facts"], "SELECT id, title, year, runtime_minutes, poster_path FROM facts")
def _(t):
    # objects of up to 1000 consecutive keys, so no object grows with the table
    fields = ["title", "year", "runtime_minutes", "poster_path"]
    objects = t.facts.groupBy(integer_bucket("tmdb_id", 1000).alias("chunk")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("id", F.struct(*fields))))).alias("text")
    )
    schema = T.StructType.fromDDL("title string, year int, runtime_minutes int, poster_path string")
    return readers.parse_keyed_map(objects, "text", schema)


@query(
    "scan_paged_corpus",
    ["corpus"],
    """SELECT cell AS cell_id, source_order AS requested_page, id, release_date, votes AS vote_count, rating AS vote_average FROM corpus
       UNION ALL SELECT cell, source_order, id + 1000000, release_date, votes + 1, rating FROM corpus""",
)
def _(t):
    def result(id_, votes):
        return F.struct(
            id_.alias("id"),
            F.lit(None).cast("string").alias("title"),
            F.col("release_date"),
            votes.alias("vote_count"),
            F.col("rating").cast("double").alias("vote_average"),
        )

    # a page of two results per corpus row
    results = F.array(result(F.col("id"), F.col("votes")), result(F.col("id") + 1000000, F.col("votes") + 1))
    page = F.struct(
        F.col("source_order").cast("int").alias("page"), F.lit(1).alias("total_pages"), F.lit(2).cast("bigint").alias("total_results"), results.alias("results")
    )
    text = t.corpus.select(
        F.to_json(F.struct(F.col("cell").alias("cell_id"), F.col("source_order").cast("int").alias("requested_page"), page.alias("response"))).alias("text")
    )
    path = _folder(t, "corpus")
    text.write.text(path)
    return readers.read_paged_corpus(t.spark, path).select(
        "cell_id", F.col("requested_page").cast("bigint").alias("requested_page"), "id", "release_date", "vote_count",
        F.col("vote_average").cast("bigint").alias("vote_average"),
    )


# two runs wrote an artifact per decided candidate; the second one only for some, and some files are torn, repeat a name or
# carry another id
@query(
    "scan_artifact_directory",
    ["review"],
    """adjudicated AS (SELECT * FROM review WHERE human_decision IS NOT NULL),
       f AS (SELECT candidate_id, lang, source, CASE WHEN source = 'src3' THEN 'x' WHEN source = 'src4' THEN 'x' WHEN source = 'src5' THEN 'x' END AS problem FROM adjudicated
         UNION ALL SELECT candidate_id, lang, source, NULL FROM adjudicated WHERE ord % 3 = 0)
       SELECT candidate_id AS identity, count(*) AS artifacts, count(problem) AS unusable, CASE WHEN count(problem) = count(*) THEN 'UNUSABLE' WHEN count(*) > 1 THEN 'REPEATED' ELSE 'MATERIALIZED' END AS status
       FROM f WHERE lang <> 'fr' GROUP BY candidate_id""",
)
def _(t):
    path = _folder(t, "run")
    rows = t.review.where(c("human_decision").isNotNull())
    record = F.to_json(F.struct(F.when(c("source") == "src5", "somebody").otherwise(c("candidate_id")).alias("candidateId"), c("human_decision").alias("decision"), c("n_chars")))
    text = F.when(c("source") == "src3", F.substring(record, 1, 25)).when(c("source") == "src4", F.regexp_replace(record, r"\}$", ',"decision":"REVISE"}')).otherwise(record)
    whole = F.to_json(F.struct(c("candidate_id").alias("candidateId"), c("human_decision").alias("decision"), c("n_chars")))
    runs = (("first", rows, text), ("second", rows.where("ord % 3 = 0"), whole), ("evidencePackets", rows.where("ord % 5 = 0"), whole))
    files = union_all([some.select(F.lit(run).alias("run"), "candidate_id", body.alias("value")) for run, some, body in runs])
    sinks.write_artifacts(files, path, "run", "candidate_id", "value")
    schema = "candidateId string, decision string, n_chars bigint"
    parsed = readers.read_artifact_directory(t.spark, path, schema, "candidateId", r"([^/]+)[.]json$", "/evidencePackets/")
    return readers.artifact_summary(parsed, t.review.where("lang <> 'fr'"), "candidate_id").drop("provenance")


def _ledger_lines(t):
    """Sealed records as lines: some payloads were rewritten later, some names are there twice, costly records lost their tail."""
    daily = ranked(t.ledger, ["attempt_id"], [c("seq").asc()], [(integer_bucket("seq"), True)], out="pos").withColumn("pos", c("pos") - 1)
    sealed = ledger.seal(daily.select("attempt_id", "pos", "lifecycle", "payload", "cost_cents"), "pos", SEALED, ["attempt_id"])
    cost = c("cost_cents")
    line = F.to_json(F.struct("pos", "lifecycle", F.when(cost % 211 == 7, "{}").otherwise(c("payload")).alias("payload"), "prev_hash", "hash"))
    twice = F.regexp_replace(line, r"\}$", ',"pos":0}')
    text = F.when(cost > 25000, F.lit('{"seq":}')).when(cost > 20000, F.substring(line, 1, 20)).when(cost % 509 == 3, twice).otherwise(line)
    return sealed.select("attempt_id", "pos", text.alias("line"))


SEALED = ["lifecycle", "payload"]


@query(
    "scan_event_ledger",
    ["ledger"],
    """w AS (SELECT attempt_id FROM ledger UNION SELECT -1 - c_custkey FROM customer WHERE c_nationkey = 3),
       l AS (SELECT *, cost_cents > 20000 OR cost_cents % 509 = 3 AS is_bad, cost_cents > 20000 AND cost_cents <= 25000 AS is_torn FROM ledger),
       s AS (SELECT attempt_id, count(*) AS lines, count(*) FILTER (WHERE is_bad) AS bad, arg_max(is_torn, seq) AS torn, bool_or(NOT is_bad AND cost_cents % 211 = 7 AND payload <> '{}') AS rewritten FROM l GROUP BY attempt_id)
       SELECT w.attempt_id, coalesce(lines, 0) AS lines, coalesce(bad, 0) AS bad, CASE WHEN lines IS NULL THEN 'EMPTY' WHEN rewritten THEN 'WAL_CORRUPTION' WHEN bad = 0 THEN 'VALID' WHEN bad = 1 AND torn THEN 'TORN_TRAILING_RECORD' ELSE 'WAL_CORRUPTION' END AS status
       FROM w LEFT JOIN s USING (attempt_id)""",
)
def _(t):
    # some ledgers were opened but never written
    opened = t.ledger.select("attempt_id").unionByName(t.raw("customer").where("c_nationkey = 3").select((-1 - F.col("c_custkey")).alias("attempt_id")))
    path = _folder(t, "wal")
    _ledger_lines(t).write.parquet(path)
    lines = t.spark.read.parquet(path)
    # the chain of the records that can be read decides as well
    fields = "pos bigint, lifecycle string, payload string, prev_hash string, hash string"
    readable = lines.where(readers.is_strict_json(c("line"))).select("attempt_id", F.from_json("line", fields).alias("r")).select("attempt_id", "r.*")
    broken = ledger.chain_validate(readable, "pos", SEALED, ["attempt_id"])
    return readers.ledger_status(lines, "attempt_id", "pos", "line", F.when(readers.is_strict_json(c("line")), F.lit(True)), opened, broken)


@query("scan_identity_only", ["review"], "SELECT candidate_id AS \"candidateId\", tmdb_id AS \"tmdbId\" FROM review")
def _(t):
    text = F.to_json(
        F.struct(
            F.col("candidate_id").alias("candidateId"), F.col("tmdb_id").alias("tmdbId"),
            F.col("human_decision").alias("humanDecision"), "severity",
        )
    )
    path = _folder(t, "identities")
    t.review.select(text.alias("text")).write.text(path)
    return readers.read_identity_only(t.spark, path, {"candidateId": "string", "tmdbId": "bigint"})


def _folder(t, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("sink_snapshot_overwrite", ["catalogue"], CATALOGUE_SQL)
def _(t):
    root = _folder(t, "snapshot")
    sinks.overwrite_snapshot(_catalogue_text(t.catalogue), root)
    return sinks.read_snapshot(t.spark, root)


@query(
    "sink_if_changed",
    ["catalogue"],
    """SELECT 1 AS attempt, 'same rows' AS content, true AS wrote, count(*) AS stored_rows FROM catalogue
       UNION ALL SELECT 2, 'same rows', false, count(*) FROM catalogue
       UNION ALL SELECT 3, 'without the slow ones', true, count(*) FROM catalogue WHERE pace <> 'slow'""",
)
def _(t):
    root, rows = _folder(t, "changed"), _catalogue_text(t.catalogue)
    log = []
    for attempt, content, frame in (
        (1, "same rows", rows),
        (2, "same rows", rows.orderBy(F.desc("id"))),
        (3, "without the slow ones", rows.where("pace <> 'slow'")),
    ):
        wrote = sinks.write_if_changed(frame, root)
        log.append((attempt, content, wrote, sinks.read_snapshot(t.spark, root).count()))
    return t.spark.createDataFrame(log, "attempt int, content string, wrote boolean, stored_rows bigint")


@query("sink_append_ledger", ["ledger"], "SELECT day, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM ledger GROUP BY day")
def _(t):
    path = _folder(t, "ledger")
    half = t.ledger.agg(F.floor((F.min("seq") + F.max("seq")) / 2)).first()[0]
    sinks.append_ledger(t.ledger.where(F.col("seq") <= half), path)
    sinks.append_ledger(t.ledger.where(F.col("seq") > half), path)
    stored = t.spark.read.parquet(path)
    return stored.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
