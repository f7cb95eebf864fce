"""Queries of the text, geometry and colour rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import color as C
from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import chunks as K
from vellum.plans.fixtures import ctes, load
from vellum.plans.registry import query

_TOK = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("a3_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def a3(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query(
    "a4_native_text_chunks",
    ctes("files") + rf"SELECT file_name AS source, sha256(content) AS doc_hash, {_STRIP.format('content')} AS clean_text, content AS raw_text, 1 AS page_number, len({_TOK.format('content')}) AS token_count, 'native' AS type, 'standard' AS method FROM files WHERE regexp_extract(lower(file_name), '\.[^.]+$') IN ('.md', '.txt')",
)
def a4(spark, d):
    return K.native_text_chunks(load(spark, d, "files"))


@query("b1_drop_furniture", ctes("layout_items") + "SELECT doc_id, item_no, label FROM layout_items WHERE label NOT IN ('page_header', 'page_footer')")
def b1(spark, d):
    return K.drop_furniture(load(spark, d, "layout_items")).select("doc_id", "item_no", "label")


_KIND = rf"kinds AS (SELECT *, CASE WHEN label = 'table' THEN 'table' WHEN label IN ('picture', 'figure', 'chart') THEN 'visual' WHEN length({_STRIP.format('text')}) > 0 THEN 'text' END AS kind FROM layout_items WHERE label NOT LIKE 'page_%')"


@query("b2_item_kind", ctes("layout_items").rstrip() + f", {_KIND} SELECT doc_id, item_no, kind FROM kinds WHERE kind IS NOT NULL")
def b2(spark, d):
    return K.item_kind(load(spark, d, "layout_items")).select("doc_id", "item_no", "kind")


@query("b3_reading_order", ctes("layout_items").rstrip() + f", {_KIND} SELECT doc_id, item_no, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY CASE WHEN kind = 'text' THEN 1 ELSE 0 END, item_no) AS chunk_no FROM kinds WHERE kind IS NOT NULL")
def b3(spark, d):
    return K.reading_order(load(spark, d, "layout_items")).select("doc_id", "item_no", F.col("chunk_no").cast("long").alias("chunk_no"))


@query(
    "b4_text_chunks",
    ctes("layout_items").rstrip() + f", {_KIND} SELECT doc_id, item_no, page_no AS page_number, {_STRIP.format('text')} AS clean_text, text AS raw_text, len({_TOK.format('text')}) AS token_count, round(least(l, r) / page_w, 9) AS x, round(least(t, b) / page_h, 9) AS y, round((greatest(l, r) - least(l, r)) / page_w, 9) AS width, round((greatest(t, b) - least(t, b)) / page_h, 9) AS height, 'text' AS type FROM kinds WHERE kind = 'text'",
)
def b4(spark, d):
    out = K.text_chunks(load(spark, d, "layout_items"))
    return out.withColumns({c: F.round(c, 9) for c in ("x", "y", "width", "height")})


@query("b5_token_count", f"SELECT doc_id, len({_TOK.format('text')}) AS n_tokens FROM documents")
def b5(spark, d):
    return load(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query("b6_strip", f"SELECT doc_id, sha256({_STRIP.format("(' ' || chr(10) || text || chr(9))")}) AS stripped FROM documents")
def b6(spark, d):
    padded = F.concat(F.lit(" \n"), "text", F.lit("\t"))
    return load(spark, d, "documents").select("doc_id", F.sha2(T.strip(padded).cast("binary"), 256).alias("stripped"))


@query(
    "b7_bbox_sanitise",
    ctes("layout_items") + """SELECT doc_id, item_no, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN w < 0 THEN x + w ELSE x END)), 9) AS x, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN h < 0 THEN y + h ELSE y END)), 9) AS y, round(least(1.0::DOUBLE, abs(w)), 9) AS width, round(least(1.0::DOUBLE, abs(h)), 9) AS height
    FROM (SELECT doc_id, item_no, l / page_w AS x, b / page_h AS y, (r - l) / page_w AS w, (t - b) / page_h AS h FROM layout_items)""",
)
def b7(spark, d):
    return K.boxes(load(spark, d, "layout_items")).withColumns({c: F.round(c, 9) for c in ("x", "y", "width", "height")})


_CLIP = "clips AS (SELECT *, greatest(0.0::DOUBLE, l - (r - l) * 0.1::DOUBLE) AS cx0, greatest(0.0::DOUBLE, 792 - t - (t - b) * 0.1::DOUBLE) AS cy0, least(612.0::DOUBLE, r + (r - l) * 0.1::DOUBLE) AS cx1, least(792.0::DOUBLE, 792 - b + (t - b) * 0.1::DOUBLE) AS cy1 FROM figures)"
_SEARCH = "searches AS (SELECT *, greatest(0.0::DOUBLE, cx0 - 150) AS sx0, greatest(0.0::DOUBLE, cy0 - 150) AS sy0, least(612.0::DOUBLE, cx1 + 150) AS sx1, least(792.0::DOUBLE, cy1 + 150) AS sy1 FROM clips)"


def clip(figures):
    c = G.clip_rect(F.col("l"), F.col("b"), F.col("r"), F.col("t"), 612, 792)
    return figures.withColumns(c)


@query("b8_clip_rect", ctes("figures").rstrip() + f", {_CLIP} SELECT figure_id, round(cx0, 6) AS cx0, round(cy0, 6) AS cy0, round(cx1, 6) AS cx1, round(cy1, 6) AS cy1 FROM clips")
def b8(spark, d):
    return clip(load(spark, d, "figures")).select("figure_id", *(F.round(c, 6).alias(c) for c in ("cx0", "cy0", "cx1", "cy1")))


@query("b9_search_rect", ctes("figures").rstrip() + f", {_CLIP}, {_SEARCH} SELECT figure_id, round(sx0, 6) AS sx0, round(sy0, 6) AS sy0, round(sx1, 6) AS sx1, round(sy1, 6) AS sy1 FROM searches")
def b9(spark, d):
    s = G.search_rect({c: F.col(c) for c in ("cx0", "cy0", "cx1", "cy1")}, 612, 792)
    return clip(load(spark, d, "figures")).select("figure_id", *(F.round(v, 6).alias(k) for k, v in s.items()))


@query(
    "b10_crop_box",
    ctes("figures") + "SELECT figure_id, CAST(trunc(greatest(0.0::DOUBLE, l * scale - 60)) AS INT) AS px0, CAST(trunc(greatest(0.0::DOUBLE, (792 - t) * scale - 60)) AS INT) AS py0, CAST(trunc(least(img_w::DOUBLE, r * scale + 60)) AS INT) AS px1, CAST(trunc(least(img_h::DOUBLE, (792 - b) * scale + 60)) AS INT) AS py1 FROM figures",
)
def b10(spark, d):
    box = G.crop_box(F.col("l"), F.col("b"), F.col("r"), F.col("t"), 792, F.col("scale"), F.col("img_w"), F.col("img_h"))
    return load(spark, d, "figures").select("figure_id", *(v.alias(k) for k, v in box.items()))


@query("b13_polygon_bbox", ctes("spans") + "SELECT seq, list_min([x0, x1, x1 + 1, x0 - 1]) AS x0, list_min([y0, y0 + 2, y1, y1 - 1]) AS y0, list_max([x0, x1, x1 + 1, x0 - 1]) AS x1, list_max([y0, y0 + 2, y1, y1 - 1]) AS y1 FROM spans")
def b13(spark, d):
    corners = F.array(F.array("x0", "y0"), F.array("x1", F.col("y0") + 2), F.array(F.col("x1") + 1, F.col("y1")), F.array(F.col("x0") - 1, F.col("y1") - 1))
    return load(spark, d, "spans").select("seq", corners.alias("p")).select("seq", *(v.alias(k) for k, v in G.polygon_box(F.col("p")).items()))


@query(
    "b14_clean_noise",
    ctes("noisy") + r"""SELECT doc_id, sha256(array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'Page \d+ of \d+', ' ', 'g'), '^\p{Nd}+\n?$', ' ', 'g'), '(?i)confidential', ' ', 'g'), '(?i)draft', ' ', 'g'), '_{5,}', ' ', 'g'), '\s{2,}', ' ', 'g'), '\s+'), lambda x: x <> ''), ' ')) AS cleaned FROM noisy""",
)
def b14(spark, d):
    return load(spark, d, "noisy").select("doc_id", F.sha2(T.clean_noise(F.col("text")).cast("binary"), 256).alias("cleaned"))


@query("b15_min_length_filter", ctes("lines") + "SELECT doc_id, item_no FROM lines WHERE length(line) >= 50")
def b15(spark, d):
    return load(spark, d, "lines").filter(T.long_enough(F.col("line"))).select("doc_id", "item_no")


@query("b16_item_probe", ctes("layout_items") + "SELECT doc_id, item_no, upper(label) AS label, replace(substring(text, 1, 50), chr(10), ' ') AS shown, l, t, r, b, contains(text, 'the') AS has_phrase FROM layout_items WHERE page_no = 1")
def b16(spark, d):
    return K.item_probe(load(spark, d, "layout_items").withColumn("text", F.col("text")), "the")


_BYTE = "bytes AS (SELECT *, CAST(trunc(r * 255) AS INT) AS r8, CAST(trunc(g * 255) AS INT) AS g8, CAST(trunc(b * 255) AS INT) AS b8 FROM shapes WHERE r IS NOT NULL)"
CHROMATIC = "NOT ((r8 > 240 AND g8 > 240 AND b8 > 240) OR (r8 < 20 AND g8 < 20 AND b8 < 20) OR (abs(r8 - g8) < 15 AND abs(g8 - b8) < 15))"


def _bytes(spark, d):
    return load(spark, d, "shapes").filter("r IS NOT NULL").select("seq", *(C.to_byte(F.col(c)).alias(f"{c}8") for c in "rgb"))


@query("b17_is_chromatic", ctes("shapes").rstrip() + f", {_BYTE} SELECT seq, {CHROMATIC} AS chromatic FROM bytes")
def b17(spark, d):
    return _bytes(spark, d).select("seq", C.chromatic(F.col("r8"), F.col("g8"), F.col("b8")).alias("chromatic"))


@query("b18_rgb_hex", ctes("shapes").rstrip() + f", {_BYTE} SELECT seq, printf('#%02x%02x%02x', r8, g8, b8) AS hex FROM bytes")
def b18(spark, d):
    return _bytes(spark, d).select("seq", C.rgb_hex(F.col("r8"), F.col("g8"), F.col("b8")).alias("hex"))


@query("b20_luminance", ctes("legends") + "SELECT seq, round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) AS luminance FROM legends")
def b20(spark, d):
    return load(spark, d, "legends").select("seq", F.round(C.luminance(F.col("r"), F.col("g"), F.col("b")), 6).alias("luminance"))


HUES = """hues AS (SELECT *, CASE WHEN s < 0.15::DOUBLE THEN 'Gray' WHEN deg < 15 OR deg > 345 THEN 'Red' WHEN deg < 45 THEN 'Orange' WHEN deg < 70 THEN 'Yellow' WHEN deg < 150 THEN 'Green' WHEN deg < 200 THEN 'Cyan' WHEN deg < 260 THEN 'Blue' WHEN deg < 300 THEN 'Purple' ELSE 'Pink' END AS hue,
        0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS lum FROM (
    SELECT *, (sector / 6 - floor(sector / 6)) * 360 AS deg FROM (SELECT *, CASE WHEN span = 0 THEN 0.0::DOUBLE WHEN total / 2 <= 0.5::DOUBLE THEN span / total ELSE span / (2 - total) END AS s,
        CASE WHEN span = 0 THEN 0.0::DOUBLE WHEN rr = high THEN (high - bb) / span - (high - gg) / span WHEN gg = high THEN 2 + (high - rr) / span - (high - bb) / span ELSE 4 + (high - gg) / span - (high - rr) / span END AS sector
    FROM (SELECT *, high - low AS span, high + low AS total FROM (SELECT *, greatest(rr, gg, bb) AS high, least(rr, gg, bb) AS low FROM (SELECT *, r / 255.0::DOUBLE AS rr, g / 255.0::DOUBLE AS gg, b / 255.0::DOUBLE AS bb FROM legends))))))"""


@query("b21_base_hue", ctes("legends").rstrip() + f", {HUES} SELECT seq, hue FROM hues")
def b21(spark, d):
    return load(spark, d, "legends").select("seq", C.base_hue(F.col("r"), F.col("g"), F.col("b")).alias("hue"))


@query("b22_numeric_label", ctes("spans") + r"SELECT seq, regexp_matches(text, '\p{Nd}') AND length(trim(text)) < 10 AS is_number FROM spans")
def b22(spark, d):
    return load(spark, d, "spans").select("seq", T.numeric_label(F.col("text")).alias("is_number"))


@query("b11_visible_spans", ctes("spans") + "SELECT figure_id, seq FROM spans WHERE coalesce(alpha, 1) <> 0 AND coalesce(flags, 0) & 8 = 0")
def b11(spark, d):
    from vellum.operators.figures import visible_spans

    return visible_spans(load(spark, d, "spans")).select("figure_id", "seq")
