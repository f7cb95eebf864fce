"""Text, shapes and pixels of figures: binding labels to colours, naming shades, requests and chunks."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import color as C
from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.sources.files import bgr_at, latin, strip_lines

PAGE = (612.0, 792.0)
RECT = ("x0", "y0", "x1", "y1")


def visible_spans(spans: DataFrame) -> DataFrame:
    """Spans that are neither transparent nor flagged 8; missing values mean visible."""
    return spans.filter((F.coalesce("alpha", F.lit(1)) != 0) & (F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(8)) == 0))


def _cols(prefix: str) -> list[Column]:
    return [F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")]


def figure_boxes(figures: DataFrame) -> DataFrame:
    """Figures with their clip box (c..) and search box (s..)."""
    out = figures.withColumns(G.clip_rect(F.col("l"), F.col("b"), F.col("r"), F.col("t"), *PAGE))
    return out.withColumns(G.search_rect({k: F.col(k) for k in ("cx0", "cy0", "cx1", "cy1")}, *PAGE))


def spans_in_clip(spans: DataFrame, figures: DataFrame) -> DataFrame:
    """Visible spans that touch their figure's clip box."""
    boxes = figure_boxes(figures).select("figure_id", "cx0", "cy0", "cx1", "cy1")
    met = visible_spans(spans).join(boxes, "figure_id").filter(G.overlap(_cols(""), _cols("c")))
    return met.select(*spans.columns)


def span_pixels(spans: DataFrame, figures: DataFrame) -> DataFrame:
    """(figure_id, seq, qx0..qy1): span boxes in pixels of the figure's crop."""
    crop = G.crop_box(F.col("l"), F.col("b"), F.col("r"), F.col("t"), PAGE[1], F.col("scale"), F.col("img_w"), F.col("img_h"))
    boxes = figures.select("figure_id", "scale", crop["px0"].alias("ox"), crop["py0"].alias("oy"))
    move = lambda c, o: (F.col(c) * F.col("scale") - F.col(o)).alias("q" + c)
    return spans.join(boxes, "figure_id").select("figure_id", "seq", move("x0", "ox"), move("y0", "oy"), move("x1", "ox"), move("y1", "oy"))


def cell_range(low: Column, high: Column, cell: float, count: int) -> Column:
    """Numbers of the grid cells that a stretch covers, inside the page; none outside."""
    first = F.greatest(F.lit(0), F.floor(low / cell).cast("int"))
    last = F.least(F.lit(count), F.floor(high / cell).cast("int") + 1) - 1
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def to_cells(rects: DataFrame, box: list[Column], cell: float = 50.0, page: tuple[float, float] = PAGE) -> DataFrame:
    """One row for each grid cell that a box covers."""
    out = rects.withColumn("gx", F.explode(cell_range(box[0], box[2], cell, ceil(page[0] / cell))))
    return out.withColumn("gy", F.explode(cell_range(box[1], box[3], cell, ceil(page[1] / cell))))


def spatial_grid(spans: DataFrame, shapes: DataFrame, cell: float = 50.0) -> DataFrame:
    """(figure_id, span_seq, shape_seq) of spans and shapes that share a grid cell, each pair once."""
    a = to_cells(spans, _cols(""), cell).select("figure_id", F.col("seq").alias("span_seq"), "gx", "gy")
    b = to_cells(shapes, _cols(""), cell).select("figure_id", F.col("seq").alias("shape_seq"), "gx", "gy")
    return a.join(b, ["figure_id", "gx", "gy"]).select("figure_id", "span_seq", "shape_seq").distinct()


def nearest_shape(spans: DataFrame, shapes: DataFrame, figures: DataFrame, reach: float = 150.0, use_grid: bool = True) -> DataFrame:
    """(figure_id, seq, text, hex, dist, r8, g8, b8): for each span the nearest filled, chromatic shape.

    The shape overlaps the figure's search box, is 2 or wider and high, and lies within reach. Ties go to
    the shape whose first 50-point cell inside the search box is first by column, then row, then seq. With
    use_grid, spans and shapes meet by cells as wide as reach, so a crowded page is many small groups;
    without it, by figure.
    """
    fill = {f"{c}8": C.to_byte(F.col(c)) for c in "rgb"}
    wide = (F.col("x1") - F.col("x0") >= 2.0) & (F.col("y1") - F.col("y0") >= 2.0)
    good = shapes.filter(F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull() & wide).withColumns(fill).filter(C.chromatic(F.col("r8"), F.col("g8"), F.col("b8")))
    boxes = figure_boxes(figures).select("figure_id", *(f"s{c}" for c in RECT))
    good = good.join(boxes, "figure_id").filter(G.overlap(_cols(""), _cols("s")))
    first = lambda lo, s: F.greatest(F.floor(F.col(s) / 50.0), F.floor(F.greatest(F.col(lo), F.lit(0.0)) / 50.0))
    good = good.select("figure_id", F.col("seq").alias("shape_seq"), *(F.col(c).alias("h" + c) for c in RECT), "r8", "g8", "b8", first("x0", "sx0").alias("col"), first("y0", "sy0").alias("row"))
    keys = ["figure_id"]
    if use_grid:
        keys += ["gx", "gy"]
        grown = [F.col("x0") - reach, F.col("y0") - reach, F.col("x1") + reach, F.col("y1") + reach]
        far = (PAGE[0] + 2 * reach, PAGE[1] + 2 * reach)
        good = to_cells(good, [F.greatest(c, F.lit(0.0)) for c in _cols("h")], reach, far)
        spans = to_cells(spans, [F.greatest(c, F.lit(0.0)) for c in grown], reach, far)
    met = spans.join(good, keys).withColumn("dist", G.edge_distance(_cols(""), _cols("h"))).filter(F.col("dist") <= reach)
    best = met.groupBy("figure_id", "seq", "text").agg(F.min(F.struct("dist", "col", "row", "shape_seq", "r8", "g8", "b8")).alias("m"))
    return best.select("figure_id", "seq", "text", C.rgb_hex(F.col("m.r8"), F.col("m.g8"), F.col("m.b8")).alias("hex"), F.col("m.dist").alias("dist"), "m.r8", "m.g8", "m.b8")


def method_choice(spans: DataFrame, figures: DataFrame, least: int = 5) -> DataFrame:
    """(figure_id, n_spans, method): raster for figures with fewer than `least` visible spans in their clip box."""
    n = spans_in_clip(spans, figures).groupBy("figure_id").agg(F.count("*").alias("n"))
    n_spans = F.coalesce("n", F.lit(0)).cast("long")
    return figures.select("figure_id").join(n, "figure_id", "left").select("figure_id", n_spans.alias("n_spans"), F.when(n_spans < least, "raster").otherwise("vector").alias("method"))


def with_ocr(spans: DataFrame, figures: DataFrame, ocr: DataFrame) -> DataFrame:
    """Spans in clip, and for raster figures the OCR lines (figure_id, seq, text, points) besides."""
    own = spans_in_clip(spans, figures).select("figure_id", "seq", "text", *RECT, F.lit("span").alias("origin"))
    box = G.polygon_box(F.col("points"))
    raster = method_choice(spans, figures).filter("method = 'raster'").select("figure_id")
    return own.unionByName(ocr.join(raster, "figure_id", "left_semi").select("figure_id", "seq", "text", *(v.alias(k) for k, v in box.items()), F.lit("ocr").alias("origin")))


def probe_strips(probes: DataFrame, width: Column, height: Column, reach: int, gap: int = 15, start_near: bool = False) -> DataFrame:
    """(columns of probes, direction, dir_no, edge, sx0, sx1, sy0, sy1): the strips that a probe looks at, left and right of its text box; ends exclusive.

    The scan goes by columns outward, rows from the top. It starts at the far edge of a strip `reach`
    wide beside the box (start_near: at the box). Left covers gap - 1 columns from distance 1, right gap
    from distance 0.
    """
    side = 0 if start_near else reach
    top, bottom = F.greatest(F.lit(0), F.col("y0")), F.least(height, F.col("y1"))
    left, right = F.greatest(F.lit(0), F.col("x0") - side), F.least(width, F.col("x1") + side)
    p = probes.filter(bottom > top)
    # The part of the page between box and edge must not be empty, if the scan begins beyond it.
    beside = (F.least(width, F.col("x0")) > left, right > F.greatest(F.lit(0), F.col("x1"))) if side else (F.lit(True), F.lit(True))
    made = (
        ("left", 0, beside[0] & (left > 0), left, F.greatest(F.lit(0), left - gap + 1), left),
        ("right", 1, beside[1] & (right < width), right, right, F.least(width, right + gap)),
    )
    columns = lambda edge, lo, hi: {"edge": edge, "sx0": lo, "sx1": hi, "sy0": top, "sy1": bottom}
    strips = [p.filter(on).select(*p.columns, F.lit(name).alias("direction"), F.lit(no).alias("dir_no"), *(c.cast("long").alias(k) for k, c in columns(edge, lo, hi).items())) for name, no, on, edge, lo, hi in made]
    return reduce(DataFrame.unionByName, strips)


_FOUND = ("image_id", "seq", "direction", "dir_no", "m.dist", "m.y", "m.r", "m.g", "m.b")


def raster_probe(probes: DataFrame, pixels: DataFrame, width: int, height: int, reach: int, gap: int = 15, start_near: bool = False) -> DataFrame:
    """(image_id, seq, direction, dir_no, dist, y, r, g, b): first chromatic pixel beyond a text box, in a table of pixels of equally large images. The strips are those of probe_strips."""
    strips = probe_strips(probes.select("image_id", "seq", *RECT), F.lit(width), F.lit(height), reach, gap, start_near)
    strips = strips.withColumn("x", F.explode(F.sequence(F.col("sx0"), F.col("sx1") - 1))).withColumn("dist", F.abs(F.col("x") - F.col("edge")))
    lit = pixels.filter(C.chromatic(F.col("r"), F.col("g"), F.col("b"))).select("image_id", "x", "y", "r", "g", "b")
    met = strips.join(lit, ["image_id", "x"]).filter((F.col("y") >= F.col("sy0")) & (F.col("y") < F.col("sy1")))
    best = met.groupBy("image_id", "seq", "direction", "dir_no").agg(F.min(F.struct("dist", "y", "r", "g", "b")).alias("m"))
    return best.select(*_FOUND)


def raster_probe_images(probes: DataFrame, images: DataFrame, reach: int, gap: int = 15, start_near: bool = False) -> DataFrame:
    """raster_probe on images (origin, height, width, nChannels, data), each with a size of its own: only the bytes of the probes' strips are read.

    Each strip's stretch of an image line is one row, of which the best pixel is found in place; no rows of pixels are made.
    """
    size = images.select(F.col("origin").alias("image_id"), "width", "height")
    strips = probe_strips(probes.select("image_id", "seq", *RECT).join(size, "image_id"), F.col("width"), F.col("height"), reach, gap, start_near)
    strips = strips.select(F.col("image_id").alias("origin"), "seq", "direction", "dir_no", "edge", *(F.col("s" + c).alias(c) for c in RECT))
    found = strip_lines(images, strips).withColumn("line", latin(F.col("line")))
    last = F.floor(F.length("line") / F.col("channels")).cast("int") - 1

    def pixel(at: Column) -> Column:
        rgb = bgr_at(F.col("line"), at, F.col("channels"))
        return F.struct(F.abs(F.greatest(F.col("x0"), F.lit(0)) + at - F.col("edge")).alias("dist"), F.col("y").cast("long").alias("y"), *(v.alias(c) for c, v in rgb.items()))

    lit = F.filter(F.transform(F.sequence(F.lit(0), last), pixel), lambda p: C.chromatic(p["r"], p["g"], p["b"]))
    best = found.select(F.col("origin").alias("image_id"), "seq", "direction", "dir_no", F.array_min(lit).alias("m"))
    # Stretches without a chromatic pixel go after the grouping: a filter before it would make all pixels a second time.
    return best.groupBy("image_id", "seq", "direction", "dir_no").agg(F.min("m").alias("m")).filter("m IS NOT NULL").select(*_FOUND)


def best_candidate(found: DataFrame) -> DataFrame:
    """The nearest candidate of each probe; left wins ties."""
    best = found.groupBy("image_id", "seq").agg(F.min(F.struct("dist", "dir_no", "direction", "r", "g", "b")).alias("m"))
    return best.select("image_id", "seq", "m.direction", "m.dist", C.rgb_hex(F.col("m.r"), F.col("m.g"), F.col("m.b")).alias("hex"))


def data_hints(bound: DataFrame, most: int = 30) -> DataFrame:
    """(figure_id, seq, hint) of numeric labels with a colour, the first `most` of each figure."""
    numbers = bound.filter(T.numeric_label(F.col("text")))
    order = Window.partitionBy("figure_id").orderBy("seq")
    hint = F.concat(F.lit("Data Point: '"), T.strip(F.col("text")), F.lit("' is on/near "), F.col("hex"))
    return numbers.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("figure_id", "seq", hint.alias("hint"))


def shade_names(legends: DataFrame) -> DataFrame:
    """(figure_id, seq, hue, name, legend): legends named by hue, and by rank of brightness where a figure has several of a hue."""
    rgb = [F.col(c) for c in "rgb"]
    x = legends.withColumns({"hue": C.base_hue(*rgb), "lum": C.luminance(*rgb)})
    n = F.count("*").over(Window.partitionBy("figure_id", "hue"))
    x = x.withColumns({"n": n, "k": F.row_number().over(Window.partitionBy("figure_id", "hue").orderBy("lum", "seq")) - 1})
    rank = F.floor(F.col("k") / (F.col("n") - 1) * 100).cast("int").cast("string")
    mod = F.when(F.col("n") == 2, F.when(F.col("k") == 0, "Dark ").otherwise("Light ")).when(F.col("n") == 3, F.when(F.col("k") == 0, "Dark ").when(F.col("k") == 1, "Medium ").otherwise("Light "))
    name = F.when(F.col("n") == 1, F.col("hue")).otherwise(F.concat(F.coalesce(mod, F.concat(F.lit("Luminance-"), rank, F.lit(" "))), "hue"))
    legend = F.concat(F.lit("Legend Key: '"), "label", F.lit("' == "), C.rgb_hex(*rgb), F.lit(" ("), name, F.lit(")"))
    return x.select("figure_id", "seq", "hue", name.alias("name"), legend.alias("legend"))


def legend_set(named: DataFrame) -> DataFrame:
    """(figure_id, legends): the distinct legend texts of each figure, sorted."""
    return named.groupBy("figure_id").agg(F.array_sort(F.collect_set("legend")).alias("legends"))


def mode_override(figures: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(figure_id, mode, layout_structure): figures labelled chart or figure that have text are charts; others keep the verdict."""
    forced = F.lower("label").rlike("chart|figure") & (F.coalesce("n_items", F.lit(0)) > 0)
    met = figures.join(verdicts.select("figure_id", "n_items", "decision", "layout_structure"), "figure_id", "left")
    return met.select("figure_id", F.when(forced, "chart").otherwise(F.coalesce("decision", F.lit("chart"))).alias("mode"), "layout_structure")


def figure_context(modes: DataFrame, legends: DataFrame, hints: DataFrame) -> DataFrame:
    """(figure_id, mode, context): legends, hints and layout as one text."""
    listed = hints.groupBy("figure_id").agg(F.array_sort(F.collect_list(F.struct("seq", "hint"))).alias("h")).select("figure_id", F.transform("h", lambda x: x["hint"]).alias("hints"))
    join = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(c, ", "), F.lit("")), F.lit("]"))
    text = F.concat(F.lit("DETECTED LEGENDS (Definitions):\n"), join("legends"), F.lit("\n\nDATA POINT LOCATION HINTS:\n"), join("hints"), F.lit("\nLAYOUT: "), F.coalesce("layout_structure", F.lit("")))
    return modes.join(legends, "figure_id", "left").join(listed, "figure_id", "left").select("figure_id", "mode", text.alias("context"))


def analysis_requests(contexts: DataFrame) -> DataFrame:
    """(figure_id, prompt, temperature, message): what an external model is asked about each figure."""
    chart = F.col("mode") == "chart"
    return contexts.select("figure_id", F.when(chart, "analyst").otherwise("consultant").alias("prompt"), F.when(chart, 0.0).otherwise(0.2).alias("temperature"), F.concat(F.lit("Context:\n"), "context", F.lit("\n\nAnalyze:")).alias("message"))


def visual_chunks(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejects) of (figure_id, mode, n_items, captions, description).

    Figures without text, without a description or with an error for one are rejects, with the reason.
    """
    reason = F.when(F.coalesce("n_items", F.lit(0)) == 0, "no text in figure").when(F.col("description").isNull(), "no response").when(F.col("description").startswith("[Error"), "model error")
    x = responses.withColumn("reason", reason)
    text = F.concat(F.lit("["), F.upper("mode"), F.lit(" ANALYSIS]\nTitle: "), F.array_join("captions", " | "), F.lit("\n"), "description")
    chunks = x.filter("reason IS NULL").select("figure_id", text.alias("clean_text"), F.col("description").alias("raw_text"), T.token_count(F.col("description")).alias("token_count"), F.lit("visual").alias("type"), "mode")
    return chunks, x.filter("reason IS NOT NULL").select("figure_id", "reason")
