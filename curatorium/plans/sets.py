"""Set accounting, digests, promotion and pseudonyms over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatorium.operators import sets as S
from curatorium.plans.registry import query
from curatorium.plans.selection import DIGEST_SQL
from curatorium.sources.projections import CTES, Tables

c = F.col

CTES["tagged"] = (("exclusions",), "SELECT DISTINCT id, provenance AS tag FROM exclusions")


def tagged(t: Tables) -> DataFrame:
    named = {n: t.exclusions.where(c("provenance") == n) for n in ("returns", "supplier", "manual")}
    return S.tag_sets(named)


@query("union_sets", ["tagged"], "SELECT tag, count(*) AS n FROM tagged GROUP BY tag UNION ALL SELECT 'union', count(DISTINCT id) FROM tagged")
def _(t):
    return S.set_sizes(tagged(t))


@query("set_accounting", ["tagged"], "SELECT combination, count(*) AS n FROM (SELECT id, string_agg(tag, '+' ORDER BY tag) AS combination FROM tagged GROUP BY id) GROUP BY combination")
def _(t):
    return S.set_accounting(tagged(t))


@query("intersection_count", ["tagged"], "SELECT tag, count(*) AS shared FROM tagged WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.09) GROUP BY tag")
def _(t):
    base = t.raw("lineitem").where("l_discount >= 0.09").select(c("l_partkey").alias("id"))
    return S.intersection_counts(base, tagged(t))


@query(
    "set_equality",
    ["facts"],
    """a AS (SELECT l_partkey AS id FROM lineitem), b AS (SELECT tmdb_id AS id FROM facts),
       x AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT id FROM a EXCEPT SELECT id FROM b)) AS only_first, (SELECT count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a)) AS only_second)
       SELECT only_first, only_second, only_first = 0 AND only_second = 0 AS equal FROM x""",
)
def _(t):
    return S.sets_equal(t.raw("lineitem").select(c("l_partkey").alias("id")).distinct(), t.facts.select(c("tmdb_id").alias("id")))


@query("row_digest", ["facts"], """SELECT tmdb_id, sha256('{"original_language":"' || original_language || '","release_date":"' || release_date || '","tmdb_id":' || tmdb_id || ',"votes":' || votes || '}') AS row_digest FROM facts""")
def _(t):
    rows = t.facts.select("votes", "tmdb_id", "release_date", "original_language")
    return S.row_digest(rows).select("tmdb_id", "row_digest")


@query("table_digest", ["corpus"], """src AS (SELECT 'corpus' AS g, '{"id":' || id || ',"release_date":"' || release_date || '"}' AS j FROM corpus), """ + DIGEST_SQL.format(name="source"))
def _(t):
    return S.table_digest(t.corpus.select(F.lit("corpus").alias("source"), "id", "release_date"), ["source"])


@query(
    "promote_append",
    ["catalogue"],
    """base AS (SELECT id, tmdb_id FROM catalogue WHERE pace = 'slow'), acc AS (SELECT CASE WHEN runtime_minutes = 160 THEN 'm' || (tmdb_id - 1) ELSE id END AS id, tmdb_id FROM catalogue WHERE pace <> 'slow')
       SELECT 'id' AS key, id AS value, 'DUPLICATE_IN_BATCH' AS kind FROM acc GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'id', id, 'ALREADY_IN_BASELINE' FROM acc WHERE id IN (SELECT id FROM base)
       UNION ALL SELECT 'rows', CAST((SELECT count(*) FROM base) + (SELECT count(*) FROM acc) AS VARCHAR), 'TOTAL'
       UNION ALL SELECT 'baseline', CAST((SELECT count(*) FROM base) AS VARCHAR), 'UNCHANGED'""",
)
def _(t):
    rows = t.catalogue.select("id", "tmdb_id", "pace", "runtime_minutes")
    base = rows.where("pace = 'slow'").select("id", "tmdb_id")
    renamed = F.when(c("runtime_minutes") == 160, F.concat(F.lit("m"), (c("tmdb_id") - 1).cast("string"))).otherwise(c("id"))
    accepted = rows.where("pace <> 'slow'").select(renamed.alias("id"), "tmdb_id")
    union, collisions = S.promote_append(base, accepted, ["id", "tmdb_id"])
    # every row of the baseline is still there: counts of equal rows before and after
    before = base.select("*", F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(union.select("*", F.lit(0).alias("old"), F.lit(1).alias("new")))
    equal = before.groupBy("id", "tmdb_id").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    sizes = equal.agg(F.coalesce(F.sum("new"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(c("new") > 0, c("old"))), F.lit(0)).alias("kept"))
    row = lambda key, value, kind: F.struct(F.lit(key).alias("key"), F.col(value).cast("string").alias("value"), F.lit(kind).alias("kind"))
    return collisions.unionByName(sizes.select(F.inline(F.array(row("rows", "total", "TOTAL"), row("baseline", "kept", "UNCHANGED")))))


@query(
    "partition_conservation",
    ["tagged"],
    """h AS (SELECT id, count(*) AS n FROM tagged GROUP BY id), p AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_suppkey <> 9)
       SELECT coalesce(p.id, h.id) AS id, CASE WHEN p.id IS NULL THEN 'NOT_IN_POPULATION' WHEN n IS NULL THEN 'UNASSIGNED' ELSE 'OVERLAP' END AS problem FROM p FULL JOIN h ON p.id = h.id WHERE p.id IS NULL OR n IS NULL OR n > 1""",
)
def _(t):
    population = t.raw("lineitem").where("l_suppkey <> 9").select(c("l_partkey").alias("id")).distinct()
    return S.partition_conservation(tagged(t), population)


SECRET = b"exclusion-secret"
_PAD = SECRET.ljust(64, b"\0")


def _blob(pad: int) -> str:
    return "unhex('" + bytes(b ^ pad for b in _PAD).hex() + "')"


@query(
    "pseudonymize_ids",
    ["catalogue", "exclusions"],
    f"""SELECT sha256({_blob(0x5C)} || unhex(sha256({_blob(0x36)} || encode(CAST(tmdb_id AS VARCHAR))))) AS pseudonym, pace FROM catalogue WHERE tmdb_id NOT IN (SELECT id FROM exclusions)""",
)
def _(t):
    # both sides are compared by pseudonym only
    held = S.pseudonymize(t.exclusions.select("id").distinct(), "id", SECRET)
    return S.pseudonymize(t.catalogue.select("tmdb_id", "pace"), "tmdb_id", SECRET).join(held, "pseudonym", "left_anti")
