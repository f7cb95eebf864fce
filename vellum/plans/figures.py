"""Queries on regions and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import figures as P
from vellum.operators import regions as R
from vellum.plans.fixtures import ctes, image_rows, load
from vellum.plans.registry import query
from vellum.plans.scalars import _BYTE, _CLIP, _SEARCH, _TOK, CHROMATIC, HUES

# --- Text scores

_ALPHA = r"1.0::DOUBLE - len(list_filter({tok}, lambda x: regexp_matches(regexp_replace(x, '^[!-/:-@\[-`{{-~]+|[!-/:-@\[-`{{-~]+$', '', 'g'), '^\p{{L}}{{2,}}$'))) / greatest(len({tok}), 1)"


def alpha_sql(t: str) -> str:
    return _ALPHA.format(tok=_TOK.format(t))


def density_sql(t: str) -> str:
    """RE2 has no look-ahead and an ASCII word border: accents become '_', and asset ids are sought in the shorter of two line prefixes."""
    flat = rf"regexp_replace({t}, '[À-ÖØ-öø-ɏ]', '_', 'g')"
    money = rf"len(regexp_extract_all({flat}, '(?i)[$€£¥]|\b(?:USD|EUR|GBP|JPY|CHF|CAD|AUD|CNY|HKD|SGD|NZD|KRW)\b|\(\d{{1,3}}(?:,\d{{3}})*\)|\d+(?:\.\d+)?[x%]'))"
    units = rf"len(regexp_extract_all({flat}, '(?i)\b(?:sq\s?ft|sf|m2|psf|keys|MW|GWh|TEU|dwt|mt|bbl)\b'))"
    a, b = (rf"regexp_extract(ln, '^.*[{c}]\w*')" for c in ("0-9", "A-Za-z"))
    assets = rf"coalesce(list_sum(list_transform(string_split({flat}, chr(10)), lambda ln: len(regexp_extract_all(CASE WHEN length({a}) < length({b}) THEN {a} ELSE {b} END, '(?i)\b[A-Z0-9]{{9,12}}\b')))), 0)"
    periods = rf"len(regexp_extract_all({flat}, '\b(?:FY|Q[1-4]|LTM)\d{{2}}\b|\b2[0O]\d{{2}}[E]?\b'))"
    return f"least(({money} * 2.0::DOUBLE + ({units} + {assets}) * 3.0::DOUBLE + {periods} * 1.5::DOUBLE) / greatest(len({_TOK.format(t)}), 1), 1.0::DOUBLE)"


def risk_sql(t: str) -> str:
    head = f"lower(substring({t}, 1, 200))"
    return rf"CASE WHEN len(regexp_extract_all({t}, '(?m)\.{{5,}}\s*\d+$')) > 1 THEN 1.0::DOUBLE WHEN (regexp_matches({head}, '^(?:article|section)\s+\d') AND NOT contains({head}, 'note')) OR regexp_matches({head}, 'forward[- ]looking|risk factors|disclaimer') THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END"


@query("d9_alpha_ratio", f"SELECT doc_id, round({alpha_sql('text')}, 9) AS v1 FROM documents")
def d9(spark, d):
    return load(spark, d, "documents").select("doc_id", F.round(T.alpha_ratio(F.col("text")), 9).alias("v1"))


@query("d10_entity_density", f"SELECT doc_id, round({density_sql('text')}, 9) AS v2 FROM documents")
def d10(spark, d):
    return load(spark, d, "documents").select("doc_id", F.round(T.entity_density(F.col("text")), 9).alias("v2"))


_TITLE = r"^[^\p{Lu}\p{Ll}]*(?:\p{Lu}\p{Ll}*(?:[^\p{Lu}\p{Ll}]+|$))+$"
_UPPER = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"


def region_sql(items: str, keys: str, order: str) -> str:
    """CTEs texts, grids and verdicts of regions; items has keys, order, l and text."""
    k = keys.split(", ")
    on = " AND ".join(f"a.{c} = b.{c}" for c in k)
    return rf"""texts AS (SELECT {keys}, count(*) AS n_items, string_agg(coalesce(text, ''), ' ' ORDER BY {order}) AS text FROM {items} GROUP BY {keys}),
    wide AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n, min(l) OVER (PARTITION BY {keys}) AS lo, max(l) OVER (PARTITION BY {keys}) AS hi, lag(l) OVER (PARTITION BY {keys} ORDER BY l, {order}) AS before FROM {items}),
    marked AS (SELECT *, CASE WHEN coalesce(l - before, 0) >= greatest(15.0::DOUBLE, (hi - lo) * 0.02::DOUBLE) THEN 1 ELSE 0 END AS starts FROM wide),
    clusters AS (SELECT *, sum(starts) OVER (PARTITION BY {keys} ORDER BY l, {order} ROWS UNBOUNDED PRECEDING) AS cluster FROM marked),
    sizes AS (SELECT {keys}, cluster, count(*) AS size, any_value(n) AS n FROM clusters GROUP BY {keys}, cluster),
    col AS (SELECT {keys}, count(*) FILTER (WHERE size > n * 0.1::DOUBLE) AS columns, any_value(n) AS n FROM sizes GROUP BY {keys}),
    halves AS (SELECT {keys}, coalesce(string_agg(coalesce(text, ''), ' ' ORDER BY {order}) FILTER (WHERE l > (lo + hi) / 2), '') AS right_text FROM wide GROUP BY {keys}),
    ratios AS (SELECT *, len(regexp_extract_all(right_text, '\p{{Nd}}')) / greatest(length(right_text), 1) AS digits, len(list_filter({_TOK.format('right_text')}, lambda x: regexp_matches(x, '{_TITLE}') OR regexp_matches(x, '{_UPPER}'))) / greatest(len({_TOK.format('right_text')}), 1) AS titles FROM halves),
    grids AS (SELECT {', '.join('a.' + c for c in k)}, CASE WHEN n <= 5 THEN 0.0::DOUBLE WHEN columns >= 3 THEN 1.0::DOUBLE WHEN columns = 2 THEN CASE WHEN digits > 0.4::DOUBLE OR titles > 0.25::DOUBLE THEN 0.85::DOUBLE ELSE 0.2::DOUBLE END ELSE 0.0::DOUBLE END AS v3 FROM col a JOIN ratios b ON {on}),
    scores AS (SELECT {', '.join('a.' + c for c in k)}, n_items, {alpha_sql('text')} AS v1, {density_sql('text')} AS v2, v3, {risk_sql('text')} AS v4 FROM texts a JOIN grids b ON {on}),
    verdicts AS (SELECT *, CASE WHEN score0 > 0.50::DOUBLE THEN 'chart' ELSE 'general' END AS decision, CASE WHEN v3 = 1.0::DOUBLE THEN 'Grid' WHEN v3 = 0.85::DOUBLE THEN 'KV' ELSE 'Freeform' END AS layout_structure, CASE WHEN v4 > 0.5::DOUBLE THEN 'TOC/Legal' ELSE 'None' END AS risk_flag
        FROM (SELECT *, (v1 * 0.35::DOUBLE + v3 * 0.30::DOUBLE + v2 * 0.35::DOUBLE) * (1.0::DOUBLE - v4) AS score0 FROM scores))"""


_REGIONS = ctes("region_items").rstrip() + ", " + region_sql("region_items", "doc_id, page_no", "item_no")
_KEYS = ["doc_id", "page_no"]


@query("d11_grid_score", _REGIONS + " SELECT doc_id, page_no, v3 FROM grids")
def d11(spark, d):
    return R.grid_score(load(spark, d, "region_items"), _KEYS)


@query("d12_risk_penalty", _REGIONS + f" SELECT doc_id, page_no, {risk_sql('text')} AS v4 FROM texts")
def d12(spark, d):
    return R.region_text(load(spark, d, "region_items"), _KEYS).select(*_KEYS, T.risk_penalty(F.col("text")).alias("v4"))


@query("d13_region_verdict", _REGIONS + " SELECT doc_id, page_no, n_items, round(v1, 9) AS v1, round(v2, 9) AS v2, v3, v4, round(score0, 3) AS score, decision, layout_structure, risk_flag FROM verdicts")
def d13(spark, d):
    out = R.region_verdict(load(spark, d, "region_items"), _KEYS)
    return out.withColumns({"v1": F.round("v1", 9), "v2": F.round("v2", 9)})


# --- Spans and shapes

_VISIBLE = "visible AS (SELECT * FROM spans WHERE coalesce(alpha, 1) <> 0 AND coalesce(flags, 0) & 8 = 0)"
_IN_CLIP = "inside AS (SELECT s.* FROM visible s JOIN clips c USING (figure_id) WHERE s.x0 < c.cx1 AND c.cx0 < s.x1 AND s.y0 < c.cy1 AND c.cy0 < s.y1)"
_GOOD = f"""good AS (SELECT f.*, s.sx0, s.sy0, s.sx1, s.sy1 FROM bytes f JOIN searches s USING (figure_id) WHERE {CHROMATIC} AND x1 - x0 >= 2 AND y1 - y0 >= 2 AND x0 < sx1 AND sx0 < x1 AND y0 < sy1 AND sy0 < y1)"""
_DIST = "sqrt(pow(greatest(0.0::DOUBLE, a.x0 - b.x1, b.x0 - a.x1), 2) + pow(greatest(0.0::DOUBLE, a.y0 - b.y1, b.y0 - a.y1), 2))"
_NEAR = f"""bound AS (SELECT figure_id, seq, text, hex, dist, r8, g8, b8 FROM (SELECT a.figure_id, a.seq, a.text, printf('#%02x%02x%02x', r8, g8, b8) AS hex, {_DIST} AS dist, r8, g8, b8, greatest(floor(sx0 / 50), floor(greatest(b.x0, 0) / 50)) AS col, greatest(floor(sy0 / 50), floor(greatest(b.y0, 0) / 50)) AS row_, b.seq AS shape_seq FROM inside a JOIN good b USING (figure_id) WHERE {_DIST} <= 150)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY figure_id, seq ORDER BY dist, col, row_, shape_seq) = 1)"""
_FIG = ctes("figures", "shapes").rstrip() + f", {_BYTE}, {_CLIP}, {_SEARCH}, {_VISIBLE}, {_IN_CLIP}, {_GOOD}, {_NEAR}"


@query("b23_spans_in_clip", _FIG + " SELECT figure_id, seq FROM inside")
def b23(spark, d):
    return P.spans_in_clip(load(spark, d, "spans"), load(spark, d, "figures")).select("figure_id", "seq")


@query("b12_span_pixels", ctes("figures") + "SELECT figure_id, seq, x0 * scale - ox AS qx0, y0 * scale - oy AS qy0, x1 * scale - ox AS qx1, y1 * scale - oy AS qy1 FROM spans JOIN (SELECT *, trunc(greatest(0.0::DOUBLE, l * scale - 60)) AS ox, trunc(greatest(0.0::DOUBLE, (792 - t) * scale - 60)) AS oy FROM figures) USING (figure_id)")
def b12(spark, d):
    return P.span_pixels(load(spark, d, "spans"), load(spark, d, "figures"))


@query("b19_edge_distance", ctes("spans", "shapes") + f"SELECT a.seq, round({_DIST}, 6) AS dist FROM spans a JOIN shapes b ON a.figure_id = b.figure_id AND a.seq = b.seq")
def b19(spark, d):
    a = load(spark, d, "spans")
    b = load(spark, d, "shapes").select("figure_id", "seq", *(F.col(c).alias("h" + c) for c in P.RECT))
    gap = G.edge_distance([F.col(c) for c in P.RECT], [F.col("h" + c) for c in P.RECT])
    return a.join(b, ["figure_id", "seq"]).select("seq", F.round(gap, 6).alias("dist"))


_CELLS = "(SELECT figure_id, seq, unnest(range(greatest(0, floor(x0 / 50))::BIGINT, least({c}, floor(x1 / 50) + 1)::BIGINT)) AS gx, y0, y1 FROM {t})"


def _grid(t: str) -> str:
    return f"(SELECT figure_id, seq, gx, unnest(range(greatest(0, floor(y0 / 50))::BIGINT, least(16, floor(y1 / 50) + 1)::BIGINT)) AS gy FROM {_CELLS.format(c=13, t=t)})"


@query("d1_spatial_grid", ctes("spans", "shapes") + f"SELECT DISTINCT a.figure_id, a.seq AS span_seq, b.seq AS shape_seq FROM {_grid('spans')} a JOIN {_grid('shapes')} b USING (figure_id, gx, gy)")
def d1(spark, d):
    return P.spatial_grid(load(spark, d, "spans"), load(spark, d, "shapes"))


def _bound(spark, d):
    figures = load(spark, d, "figures")
    return P.nearest_shape(P.spans_in_clip(load(spark, d, "spans"), figures), load(spark, d, "shapes"), figures)


@query("d2_nearest_shape", _FIG + " SELECT figure_id, seq, text, hex, round(dist, 6) AS dist, r8, g8, b8 FROM bound")
def d2(spark, d):
    return _bound(spark, d).withColumn("dist", F.round("dist", 6))


@query("d3_method_choice", _FIG + " SELECT f.figure_id, count(i.seq) AS n_spans, CASE WHEN count(i.seq) < 5 THEN 'raster' ELSE 'vector' END AS method FROM figures f LEFT JOIN inside i USING (figure_id) GROUP BY f.figure_id")
def d3(spark, d):
    return P.method_choice(load(spark, d, "spans"), load(spark, d, "figures"))


@query(
    "d3_with_ocr",
    _FIG + """, raster AS (SELECT f.figure_id FROM figures f LEFT JOIN inside i USING (figure_id) GROUP BY f.figure_id HAVING count(i.seq) < 5)
    SELECT figure_id, seq, text, x0, y0, x1, y1, 'span' AS origin FROM inside UNION ALL SELECT figure_id, seq, 'ocr ' || text, x0, y0, x1, y1, 'ocr' FROM spans WHERE figure_id IN (SELECT figure_id FROM raster)""",
)
def d3b(spark, d):
    spans = load(spark, d, "spans")
    points = F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"))
    ocr = spans.select("figure_id", "seq", F.concat(F.lit("ocr "), "text").alias("text"), points.alias("points"))
    return P.with_ocr(spans, load(spark, d, "figures"), ocr)


_PROBE = """strips AS (SELECT image_id, seq, 'left' AS direction, 0 AS dir_no, greatest(0, x0 - 3) AS edge, greatest(0, x0 - 3) - 15 AS after, greatest(0, x0 - 3) AS before, greatest(0, y0) AS top, least(30, y1) AS bottom FROM probes WHERE least(40, x0) > greatest(0, x0 - 3)
    UNION ALL SELECT image_id, seq, 'right', 1, least(40, x1 + 3), least(40, x1 + 3) - 1, least(40, x1 + 3) + 15, greatest(0, y0), least(30, y1) FROM probes WHERE least(40, x1 + 3) > greatest(0, x1)),
    found AS (SELECT s.image_id, s.seq, direction, dir_no, abs(x - edge) AS dist, y, r, g, b FROM strips s JOIN pixels p ON s.image_id = p.image_id AND p.x > s.after AND p.x < s.before AND p.y >= s.top AND p.y < s.bottom
        WHERE NOT ((r > 240 AND g > 240 AND b > 240) OR (r < 20 AND g < 20 AND b < 20) OR (abs(r - g) < 15 AND abs(g - b) < 15)) QUALIFY ROW_NUMBER() OVER (PARTITION BY s.image_id, s.seq, direction ORDER BY abs(x - edge), y) = 1)"""
_PIX = ctes("pixels", "probes").rstrip() + f", {_PROBE}"


def _probe(spark, d):
    return P.raster_probe(load(spark, d, "probes"), load(spark, d, "pixels"), 40, 30, reach=3)


@query("d4_raster_probe", _PIX + " SELECT image_id, seq, direction, dir_no, dist, y, r, g, b FROM found")
def d4(spark, d):
    return _probe(spark, d)


@query("d4_probe_strips", _PIX + " SELECT image_id, seq, direction, dir_no, dist, y, r, g, b FROM found")
def d4s(spark, d):
    """The same on images as rows of bytes, of which only the strips are read."""
    return P.raster_probe_images(load(spark, d, "probes"), image_rows(load(spark, d, "images")), reach=3)


@query("d5_best_candidate", _PIX + " SELECT image_id, seq, direction, dist, printf('#%02x%02x%02x', r, g, b) AS hex FROM found QUALIFY ROW_NUMBER() OVER (PARTITION BY image_id, seq ORDER BY dist, dir_no) = 1")
def d5(spark, d):
    return P.best_candidate(_probe(spark, d))


_HINTS = r"hints AS (SELECT figure_id, seq, 'Data Point: ''' || trim(text) || ''' is on/near ' || hex AS hint FROM bound WHERE regexp_matches(text, '\p{Nd}') AND length(trim(text)) < 10 QUALIFY ROW_NUMBER() OVER (PARTITION BY figure_id ORDER BY seq) <= 30)"


@query("d6_data_hints", _FIG + f", {_HINTS} SELECT figure_id, seq, hint FROM hints")
def d6(spark, d):
    return P.data_hints(_bound(spark, d))


def shades_sql(source: str) -> str:
    return f"""{HUES.replace('FROM legends', f'FROM {source}')}, ranked AS (SELECT *, count(*) OVER (PARTITION BY figure_id, hue) AS n, ROW_NUMBER() OVER (PARTITION BY figure_id, hue ORDER BY lum, seq) - 1 AS k FROM hues),
    shades AS (SELECT *, 'Legend Key: ''' || label || ''' == ' || printf('#%02x%02x%02x', r, g, b) || ' (' || name || ')' AS legend FROM (SELECT *, CASE WHEN n = 1 THEN hue WHEN n = 2 THEN CASE k WHEN 0 THEN 'Dark ' ELSE 'Light ' END || hue WHEN n = 3 THEN CASE k WHEN 0 THEN 'Dark ' WHEN 1 THEN 'Medium ' ELSE 'Light ' END || hue ELSE 'Luminance-' || CAST(floor(k / (n - 1) * 100) AS INT) || ' ' || hue END AS name FROM ranked))"""


_SHADES = ctes("legends").rstrip() + ", " + shades_sql("legends")


@query("d7_shade_names", _SHADES + " SELECT figure_id, seq, hue, name, legend FROM shades")
def d7(spark, d):
    return P.shade_names(load(spark, d, "legends"))


@query("d8_legend_set", _SHADES + " SELECT figure_id, list_sort(list(DISTINCT legend)) AS legends FROM shades GROUP BY figure_id")
def d8(spark, d):
    return P.legend_set(P.shade_names(load(spark, d, "legends")))


# --- Whole figures: verdict, context, request, chunk

_WHOLE = (
    _FIG
    + ", items AS (SELECT figure_id, seq, x0 AS l, text FROM inside), "
    + region_sql("items", "figure_id", "seq")
    + f", {_HINTS}, bindings AS (SELECT figure_id, seq, trim(text) AS label, r8 AS r, g8 AS g, b8 AS b FROM bound WHERE NOT (regexp_matches(text, '\\p{{Nd}}') AND length(trim(text)) < 10) AND length(trim(text)) > 0), "
    + shades_sql("bindings")
    + """, modes AS (SELECT f.figure_id, f.label, coalesce(v.n_items, 0) AS n_items, CASE WHEN regexp_matches(f.label, 'chart|figure') AND coalesce(v.n_items, 0) > 0 THEN 'chart' ELSE coalesce(v.decision, 'chart') END AS mode, v.layout_structure FROM figures f LEFT JOIN verdicts v USING (figure_id)),
    contexts AS (SELECT m.figure_id, m.mode, 'DETECTED LEGENDS (Definitions):' || chr(10) || '[' || coalesce(array_to_string(g.legends, ', '), '') || ']' || chr(10) || chr(10) || 'DATA POINT LOCATION HINTS:' || chr(10) || '[' || coalesce(h.hints, '') || ']' || chr(10) || 'LAYOUT: ' || coalesce(layout_structure, '') AS context
        FROM modes m LEFT JOIN (SELECT figure_id, list_sort(list(DISTINCT legend)) AS legends FROM shades GROUP BY figure_id) g USING (figure_id) LEFT JOIN (SELECT figure_id, string_agg(hint, ', ' ORDER BY seq) AS hints FROM hints GROUP BY figure_id) h USING (figure_id))"""
)


def _modes(spark, d):
    figures = load(spark, d, "figures")
    items = P.spans_in_clip(load(spark, d, "spans"), figures).select("figure_id", "seq", F.col("x0").alias("l"), "text")
    return P.mode_override(figures, R.region_verdict(items, ["figure_id"], "seq"))


def _contexts(spark, d):
    bound = _bound(spark, d)
    words = bound.filter(~T.numeric_label(F.col("text")) & (F.length(T.strip(F.col("text"))) > 0))
    legends = words.select("figure_id", "seq", T.strip(F.col("text")).alias("label"), F.col("r8").alias("r"), F.col("g8").alias("g"), F.col("b8").alias("b"))
    return P.figure_context(_modes(spark, d), P.legend_set(P.shade_names(legends)), P.data_hints(bound))


@query("d14_mode_override", _WHOLE + " SELECT figure_id, mode, layout_structure FROM modes")
def d14(spark, d):
    return _modes(spark, d)


@query("d15_figure_context", _WHOLE + " SELECT figure_id, mode, context FROM contexts")
def d15(spark, d):
    return _contexts(spark, d)


@query("d16_analysis_requests", _WHOLE + " SELECT figure_id, CASE WHEN mode = 'chart' THEN 'analyst' ELSE 'consultant' END AS prompt, CASE WHEN mode = 'chart' THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END AS temperature, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Analyze:' AS message FROM contexts")
def d16(spark, d):
    return P.analysis_requests(_contexts(spark, d))


_RESPONSES = "CASE WHEN figure_id % 7 = 3 THEN '[Error: timeout]' WHEN figure_id % 11 <> 5 THEN 'A ' || mode || ' with ' || n_items || ' labels' END"


def _responses(spark, d):
    figures = load(spark, d, "figures")
    n = P.spans_in_clip(load(spark, d, "spans"), figures).groupBy("figure_id").agg(F.count("*").alias("n_items"))
    met = _modes(spark, d).join(n, "figure_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    fid = F.col("figure_id")
    text = F.when(fid % 7 == 3, "[Error: timeout]").when(fid % 11 != 5, F.concat(F.lit("A "), "mode", F.lit(" with "), F.col("n_items").cast("string"), F.lit(" labels")))
    captions = F.slice(F.array(F.lit("Sales"), F.concat(F.lit("Page "), fid.cast("string"))), 1, (fid % 3).cast("int"))
    return met.select("figure_id", "mode", "n_items", captions.alias("captions"), text.alias("description"))


@query(
    "d17_visual_chunks",
    _WHOLE + rf"""SELECT figure_id, '[' || upper(mode) || ' ANALYSIS]' || chr(10) || 'Title: ' || CASE figure_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Sales' ELSE 'Sales | Page ' || figure_id END || chr(10) || description AS clean_text, description AS raw_text, len({_TOK.format('description')}) AS token_count, 'visual' AS type, mode
    FROM (SELECT *, {_RESPONSES} AS description FROM modes) WHERE n_items > 0 AND description IS NOT NULL AND NOT starts_with(description, '[Error')""",
)
def d17(spark, d):
    return P.visual_chunks(_responses(spark, d))[0]


@query("d17_rejected_figures", _WHOLE + f"SELECT * FROM (SELECT figure_id, CASE WHEN n_items = 0 THEN 'no text in figure' WHEN description IS NULL THEN 'no response' WHEN starts_with(description, '[Error') THEN 'model error' END AS reason FROM (SELECT *, {_RESPONSES} AS description FROM modes)) WHERE reason IS NOT NULL")
def d17r(spark, d):
    return P.visual_chunks(_responses(spark, d))[1]
