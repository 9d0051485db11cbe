"""Palette jobs over a pixel table: every vector is an image of 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatorium.functions.columns import joined
from curatorium.operators import pixels as P
from curatorium.plans.registry import query
from curatorium.sources.projections import CTES, Tables

c = F.col

# label 0: black and white with some colour; label 1: one flat colour; others: three channels from the value
CTES["pixel_rows"] = (
    (),
    """SELECT vec_id AS image, i % 8 AS x, i // 8 AS y, label, CASE WHEN label = 0 THEN CASE WHEN v < -300 THEN 200 WHEN v < 0 THEN 0 ELSE 255 END WHEN label = 1 THEN 100 ELSE v % 256 END AS r,
        CASE WHEN label = 0 THEN CASE WHEN v < -300 THEN 30 WHEN v < 0 THEN 0 ELSE 255 END WHEN label = 1 THEN 110 ELSE (v * 7) % 256 END AS g,
        CASE WHEN label = 0 THEN CASE WHEN v < 0 THEN 0 ELSE 255 END WHEN label = 1 THEN 120 ELSE (v * 13) % 256 END AS b, CASE WHEN i % 16 = label THEN 0 ELSE 255 END AS a
       FROM (SELECT vec_id, label, i, CASE WHEN label = 0 THEN q ELSE abs(q) END AS v FROM (SELECT vec_id, label, unnest(range(64)) AS i, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) AS q FROM embeddings))""",
)


def pixel_rows(t: Tables) -> DataFrame:
    spread = t.raw("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    q = F.floor(c("e").cast("double") * 1000).cast("bigint")
    flat = spread.select("vec_id", "label", "i", F.when(c("label") == 0, q).otherwise(F.abs(q)).alias("v"))
    bw = lambda red: F.when(c("v") < -300, red).when(c("v") < 0, 0).otherwise(255)
    channel = lambda red, flat_value, by: F.when(c("label") == 0, bw(red)).when(c("label") == 1, flat_value).otherwise((c("v") * by) % 256)
    return flat.select(
        c("vec_id").alias("image"), (c("i") % 8).alias("x"), F.floor(c("i") / 8).alias("y"), "label",
        channel(200, 100, 1).alias("r"), channel(30, 110, 7).alias("g"), channel(0, 120, 13).alias("b"),
        F.when(c("i") % 16 == c("label"), 0).otherwise(255).alias("a"),
    )


CTES["histogram"] = (
    ("pixel_rows",),
    """SELECT image, qr AS r, qg AS g, qb AS b, count(*) AS n, CAST(sum(r + g + b) AS BIGINT) AS raw_sum, count(*) FILTER (WHERE greatest(r, g, b) > 45 AND (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) >= 0.22) AS chromatic_n,
       0.2126 * qr + 0.7152 * qg + 0.0722 * qb AS lum, qr || ',' || qg || ',' || qb AS key FROM (
       SELECT *, CAST(least(255, floor(r / 16 + 0.5) * 16) AS INTEGER) AS qr, CAST(least(255, floor(g / 16 + 0.5) * 16) AS INTEGER) AS qg, CAST(least(255, floor(b / 16 + 0.5) * 16) AS INTEGER) AS qb FROM pixel_rows WHERE a >= 128) GROUP BY image, qr, qg, qb""",
)
HEX_SQL = "printf('#%02x%02x%02x', {0}r, {0}g, {0}b)"
CTES["evidence"] = (
    ("histogram",),
    f"""SELECT *, CASE WHEN far_ok THEN CASE WHEN f_lum > s_lum THEN s_hex || '|' || f_hex ELSE f_hex || '|' || s_hex END ELSE printf('#%02x%02x%02x|#%02x%02x%02x', dk, dk, dk, lt, lt, lt) END AS palette,
       chromatic_n / valid AS coverage, CASE WHEN c_score IS NOT NULL AND s_score > 0 THEN c_score / s_score ELSE 0 END AS score_share,
       CASE WHEN c_hex IS NULL THEN NULL WHEN f_lum > c_lum OR (f_lum = c_lum AND f_key > c_key) THEN c_hex || '|' || f_hex ELSE f_hex || '|' || c_hex END AS colored_pair FROM (
     SELECT image, valid, chromatic_n, f_lum, f_hex, f_key, s.score AS s_score, far_ok, CASE WHEN s.d >= 48 THEN s.lum ELSE fa.lum END AS s_lum, CASE WHEN s.d >= 48 THEN s.hex ELSE fa.hex END AS s_hex, co.score AS c_score, co.hex AS c_hex, co.lum AS c_lum, co.key AS c_key,
       CASE WHEN lt0 - dk0 < 48 AND dk0 <> 0 THEN greatest(0, lt0 - 48) ELSE dk0 END AS dk, CASE WHEN lt0 - dk0 < 48 AND dk0 = 0 THEN 48 ELSE lt0 END AS lt FROM (
       SELECT f.image, any_value(f.valid) AS valid, any_value(f.chromatic_n) AS chromatic_n, any_value(f_lum) AS f_lum, any_value(f_hex) AS f_hex, any_value(f_key) AS f_key, any_value(greatest(0, center - 36)) AS dk0, any_value(least(255, center + 36)) AS lt0,
         arg_min(o, (-o.score, -o.n, o.key)) AS s, arg_min(o, (-o.d, o.key)) AS fa, arg_min(o, (-o.score, -o.n, o.key)) FILTER (WHERE o.d >= 48 AND greatest(o.r, o.g, o.b) > 45 AND (greatest(o.r, o.g, o.b) - least(o.r, o.g, o.b)) / greatest(o.r, o.g, o.b) >= 0.22) AS co,
         coalesce(max(o.d) >= 48, false) AS far_ok
       FROM (SELECT image, sum(n) AS valid, CAST(sum(chromatic_n) AS BIGINT) AS chromatic_n, CAST(floor(sum(raw_sum) / sum(n) / 3 + 0.5) AS INTEGER) AS center, arg_min(r, (-n, lum, key)) AS fr, arg_min(g, (-n, lum, key)) AS fg, arg_min(b, (-n, lum, key)) AS fb, arg_min(lum, (-n, lum, key)) AS f_lum, arg_min(key, (-n, lum, key)) AS f_key,
               arg_min({HEX_SQL.format('')}, (-n, lum, key)) AS f_hex FROM histogram GROUP BY image) f
       LEFT JOIN (SELECT h.image, {{'r': h.r, 'g': h.g, 'b': h.b, 'n': h.n, 'lum': h.lum, 'key': h.key, 'hex': {HEX_SQL.format('h.')}, 'd': sqrt((h.r - m.fr) ** 2 + (h.g - m.fg) ** 2 + (h.b - m.fb) ** 2), 'score': h.n * (1 + pow(sqrt((h.r - m.fr) ** 2 + (h.g - m.fg) ** 2 + (h.b - m.fb) ** 2), 1.35))}} AS o
                  FROM histogram h JOIN (SELECT image, arg_min(r, (-n, lum, key)) AS fr, arg_min(g, (-n, lum, key)) AS fg, arg_min(b, (-n, lum, key)) AS fb FROM histogram GROUP BY image) m ON m.image = h.image WHERE (h.r, h.g, h.b) <> (m.fr, m.fg, m.fb)) x ON x.image = f.image
       GROUP BY f.image))""",
)


@query("color_histogram", ["histogram"], "SELECT image, r, g, b, n, raw_sum, chromatic_n FROM histogram")
def _(t):
    return P.color_histogram(pixel_rows(t)).select("image", "rgb.r", "rgb.g", "rgb.b", "n", "raw_sum", "chromatic_n")


def evidence(t: Tables) -> DataFrame:
    return P.two_color_palette(P.palette_evidence(P.color_histogram(pixel_rows(t))))


@query("two_color_palette", ["evidence"], "SELECT image, palette FROM evidence")
def _(t):
    return evidence(t).select("image", joined("palette").alias("palette"))


FINAL_SQL = "CASE WHEN palette = '#000000|#ffffff' AND ({cond}) AND colored_pair IS NOT NULL THEN colored_pair ELSE palette END"


@query(
    "chromatic_correction",
    ["evidence"],
    f"SELECT image, round(coverage, 6) AS coverage, round(score_share, 6) AS score_share, {FINAL_SQL.format(cond='coverage >= 0.25 OR score_share >= 0.2')} AS palette FROM evidence",
)
def _(t):
    found = P.chromatic_evidence(evidence(t))
    return found.select(
        "image", F.round("coverage", 6).alias("coverage"), F.round("score_share", 6).alias("score_share"), joined(P.chromatic_correction(found)).alias("palette")
    )


VARIANTS = [("coverage", 0.25, None), ("share", None, 0.2), ("both", 0.25, 0.2), ("loose", 0.01, 0.01), ("off", None, None)]


def _variant_sql(name, cov, share) -> str:
    cond = " OR ".join([f"coverage >= {cov}"] * (cov is not None) + [f"score_share >= {share}"] * (share is not None)) or "false"
    return f"SELECT '{name}' AS variant, label, palette = '#000000|#ffffff' AND ({cond}) AS fired, {FINAL_SQL.format(cond=cond)} AS final FROM evidence JOIN (SELECT vec_id, label FROM embeddings) e ON e.vec_id = image"


@query(
    "palette_quality",
    ["evidence"],
    "v AS (" + " UNION ALL ".join(_variant_sql(*v) for v in VARIANTS) + """),
      h AS (SELECT *, ('0x' || substr(final, 2, 2))::INT AS r1, ('0x' || substr(final, 4, 2))::INT AS g1, ('0x' || substr(final, 6, 2))::INT AS b1, ('0x' || substr(final, 10, 2))::INT AS r2, ('0x' || substr(final, 12, 2))::INT AS g2, ('0x' || substr(final, 14, 2))::INT AS b2 FROM v)
      SELECT variant, count(*) FILTER (WHERE fired AND label = 0) AS corrected, count(*) FILTER (WHERE fired AND label = 1) AS altered, count(*) FILTER (WHERE fired AND label > 1) AS collateral, 0::BIGINT AS invalid,
       count(*) FILTER (WHERE (r1, g1, b1) = (r2, g2, b2)) AS identical, count(*) FILTER (WHERE sqrt((r1-r2)**2 + (g1-g2)**2 + (b1-b2)**2) < 48) AS too_close, (SELECT count(*) FROM (SELECT final FROM h x WHERE x.variant = h.variant GROUP BY final HAVING count(*) > 1)) AS repeated FROM h GROUP BY variant""",
)
def _(t):
    labels = t.raw("embeddings").select(c("vec_id").alias("image"), (c("label") == 0).alias("suspected"), (c("label") == 1).alias("neutral"))
    return P.palette_quality(P.chromatic_evidence(evidence(t)).join(labels, "image"), VARIANTS)
