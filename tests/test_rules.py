"""Boundaries of the rules, on rows made by hand."""

import random
import struct
import zlib

from pyspark.sql import functions as F

from vellum.functions import color as C
from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import chunks as K
from vellum.operators import figures as P
from vellum.operators import index as I
from vellum.operators import ledger as L
from vellum.operators import regions as R
from vellum.operators import tables as TB
from vellum.sources import files as S


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_text_rules(spark):
    assert column(spark, ["", " \n", "a b c", None], T.token_count) == [0, 0, 3, -1] or column(spark, ["", " \n", "a b c"], T.token_count) == [0, 0, 3]
    assert column(spark, [" x \n"], T.strip) == ["x"]
    assert column(spark, ["x" * 49, "x" * 50, None], T.long_enough) == [False, True, False]
    assert column(spark, ["7" * 9, "7" * 10, "abc", " 123 "], T.numeric_label) == [True, False, False, True]
    assert column(spark, ["Page 1 of 3 redrafted", "12\n", "12 x", None], T.clean_noise) == ["re ed", "", "12 x", ""]
    assert column(spark, ["a..... 1", "a..... 1\nb..... 2", "section 4 x", "section 4 note", "Risk Factors"], T.risk_penalty) == [0.0, 1.0, 0.8, 0.0, 0.8]
    assert column(spark, ["{}", '{"a": 1}\ntext', 'x ```json\n{"a": 1, }\n``` y', "{'a'}", "none", None], T.chatty_json) == ["{}", '{"a": 1}', '{"a": 1}', None, None, None]


def test_colours(spark):
    rows = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128), (255, 64, 0), (255, 0, 64), (0, 0, 0)], "r int, g int, b int")
    hues = [r[0] for r in rows.select(C.base_hue(F.col("r"), F.col("g"), F.col("b"))).collect()]
    assert hues == ["Red", "Green", "Blue", "Gray", "Orange", "Pink", "Gray"]
    rows = spark.createDataFrame([(241, 241, 241), (240, 241, 241), (19, 19, 19), (100, 114, 100), (100, 115, 100)], "r int, g int, b int")
    assert [r[0] for r in rows.select(C.chromatic(F.col("r"), F.col("g"), F.col("b"))).collect()] == [False, False, False, False, True]


def test_boxes_stay_in_the_unit_square(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([tuple(rng.uniform(-3, 3) for _ in range(4)) for _ in range(200)], "x double, y double, w double, h double")
    out = rows.select(*G.sanitise(*(F.col(c) for c in "xywh")).values()).collect()
    assert all(0 <= v <= 1 for r in out for v in r)


def test_grid_and_brute_force_agree(spark):
    rng = random.Random(2)
    spans, shapes = [], []
    for i in range(300):
        x, y = rng.randrange(560), rng.randrange(760)
        spans.append((i % 4, i, f"s{i}", float(x), float(y), float(x + 30), float(y + 10), 255, 0))
        x, y = rng.randrange(-40, 600), rng.randrange(-40, 780)
        shapes.append((i % 4, i, float(x), float(y), float(x + rng.randrange(1, 60)), float(y + rng.randrange(1, 60)), rng.random(), rng.random(), rng.random()))
    box = "x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame(spans, f"figure_id long, seq long, text string, {box}, alpha int, flags int")
    b = spark.createDataFrame(shapes, f"figure_id long, seq long, {box}, r double, g double, b double")
    f = spark.createDataFrame([(i, 60.0, 100.0, 500.0, 600.0) for i in range(4)], "figure_id long, l double, b double, r double, t double")
    grid = sorted(P.nearest_shape(a, b, f).collect())
    assert grid and grid == sorted(P.nearest_shape(a, b, f, use_grid=False).collect())


def test_five_spans_and_ten_rows(spark):
    spans = spark.createDataFrame([(f, i, "x", 100.0, 200.0, 120.0, 210.0, None, None) for f, n in ((1, 4), (2, 5)) for i in range(n)], "figure_id long, seq long, text string, x0 double, y0 double, x1 double, y1 double, alpha int, flags int")
    f = spark.createDataFrame([(i, 60.0, 100.0, 500.0, 700.0) for i in (1, 2, 3)], "figure_id long, l double, b double, r double, t double")
    assert {r.figure_id: r.method for r in P.method_choice(spans, f).collect()} == {1: "raster", 2: "vector", 3: "raster"}
    cells = spark.createDataFrame([(d, "S", 1, r, 1, str(r)) for d, n in ((1, 10), (2, 11)) for r in range(1, n + 1)], "doc long, sheet string, sheet_no int, row_no int, col_no int, value string")
    assert sorted((r.doc, r.rows) for r in TB.table_segments(cells, ["a"]).collect()) == [(1, "0-10"), (2, "0-10"), (2, "10-11")]
    assert TB.cells_to_text(cells.limit(0)).count() == 0


def test_shades_do_not_depend_on_order(spark):
    rows = [(1, i, f"L{i}", 40 * i + 20, 0, 0) for i in range(1, 5)] + [(2, 1, "only", 0, 0, 200), (3, 1, "a", 200, 0, 0), (3, 2, "b", 90, 0, 0)]
    schema = "figure_id long, seq long, label string, r int, g int, b int"
    names = lambda x: sorted((r.figure_id, r.seq, r.name) for r in P.shade_names(spark.createDataFrame(x, schema)).collect())
    assert names(rows) == names(rows[::-1])
    assert names(rows) == [(1, 1, "Luminance-0 Red"), (1, 2, "Luminance-33 Red"), (1, 3, "Luminance-66 Red"), (1, 4, "Luminance-100 Red"), (2, 1, "Blue"), (3, 1, "Light Red"), (3, 2, "Dark Red")]


def test_regions_of_five_items_have_no_grid(spark):
    rows = [(k, i, float(200 * (i % 3)), "Total 12") for k, n in ((1, 5), (2, 6)) for i in range(n)]
    found = R.grid_score(spark.createDataFrame(rows, "k long, item_no long, l double, text string"), ["k"])
    assert {r.k: r.v3 for r in found.collect()} == {1: 0.0, 2: 1.0}


def test_upsert_and_ledger_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id string, v int")
    once = I.upsert_points(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 2), ("c", 2)] == sorted(map(tuple, I.upsert_points(once, new).collect()))
    assert sorted(map(tuple, I.upsert_points(old, new.limit(0)).collect())) == [("a", 1), ("b", 1)]
    clash = I.upsert_points(old.toDF("chunk_id", "batch"), new.toDF("chunk_id", "batch"))
    assert clash.columns == ["chunk_id", "batch"] and sorted(map(tuple, clash.collect())) == [("a", 1), ("b", 2), ("c", 2)]
    files = spark.createDataFrame([("h1", "x", 2), ("h1", "w", 1), ("h2", "y", 3)], "doc_hash string, filename string, seq int")
    first = L.ledger_append(files.select("doc_hash").limit(0), files)
    assert sorted((r.doc_hash, r.filename) for r in first.collect()) == [("h1", "w"), ("h2", "y")]
    assert L.ledger_append(first.select("doc_hash"), files).count() == 0


def test_chunk_ids_are_deterministic(spark):
    df = spark.createDataFrame([("h", "text", 1)], "d string, k string, n int")
    assert df.select(K.chunk_id(F.col("d"), F.col("k"), F.col("n"))).first() == df.select(K.chunk_id(F.col("d"), F.col("k"), F.col("n"))).first()


def test_topk_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    p = spark.createDataFrame([(i, [rng.random() - 0.5 for _ in range(8)]) for i in range(60)] + [(99, [0.0] * 8)], "vec_id long, embedding array<double>")
    q = p.filter("vec_id % 5 = 0")
    whole = sorted(I.cosine_topk(p, q, 3).collect())
    monkeypatch.setattr(I, "BROADCAST_ROWS", 5)
    assert whole == sorted(I.cosine_topk(p, q, 3).collect()) and len(whole) == 36


def test_drop_zone_hides_dot_and_underscore(spark, tmp_path):
    for name in ("a.txt", "b.MD", ".hidden.txt", "_temporary", "c.xyz"):
        (tmp_path / name).write_text("x")
    found = S.route_files(S.drop_zone_scan(spark, str(tmp_path)).select("file_name"))
    assert {r.file_name: r.route for r in found.collect()} == {"a.txt": "native_stream", "b.MD": "native_stream", "c.xyz": "unsupported"}


def test_blob_folders(spark):
    import pytest

    df = spark.createDataFrame([("tables", "a.json"), ("attic", "b.json")], "folder string, file_name string")
    assert df.filter("folder = 'tables'").select(S.blob_path(F.col("folder"), F.col("file_name"))).first()[0] == "tables/a.json"
    with pytest.raises(Exception, match="Invalid blob folder"):
        df.select(S.blob_path(F.col("folder"), F.col("file_name"))).collect()


def test_blob_kinds(spark, tmp_path):
    """Markdown goes to tables only, JSON to all three folders, both into one store."""
    import pytest

    one = lambda folder: spark.createDataFrame([(folder, "a", "x")], "folder string, file_name string, body string")
    S.write_blobs(one("layouts"), str(tmp_path / "b"))
    S.write_blobs(one("tables"), str(tmp_path / "b"), "md")
    assert sorted((r.kind, r.blob_path) for r in spark.read.parquet(str(tmp_path / "b")).collect()) == [("json", "layouts/a"), ("md", "tables/a")]
    with pytest.raises(Exception, match="Invalid blob folder"):
        S.write_blobs(one("layouts"), str(tmp_path / "c"), "md")


def test_supersession_of_large_names(spark):
    rng = random.Random(6)
    rows = [(f, v, f"h{f}{v}") for f in ("a", "b", None) for v in rng.sample(range(-200, 200), 60)]
    want = {}
    for f in ("a", "b", None):
        mine = sorted(r[1:] for r in rows if r[0] == f)
        want |= {(f, v): (nxt and nxt[1]) for (v, _), nxt in zip(mine, [*mine[1:], None], strict=True)}
    df = spark.createDataFrame(rows, "filename string, version long, doc_hash string").withColumn("part", F.lit(1))
    got = L.supersession(df, most=7)
    assert got.columns == ["filename", "version", "doc_hash", "part", "superseded_by_hash", "is_superseded"]
    assert {(r.filename, r.version): r.superseded_by_hash for r in got.collect()} == want and got.count() == len(rows)


def test_image_pixels(spark, tmp_path):
    rows = [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (9, 8, 7)]]
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))
    found = {(r.x, r.y): (r.r, r.g, r.b) for r in S.image_pixels(spark, str(tmp_path)).collect()}
    assert found == {(x, y): rows[y][x] for x in range(2) for y in range(2)}


def test_terms_of_any_length_are_attached(spark):
    from vellum.operators.grounding import term_injection

    chunks = spark.createDataFrame([("c1", "The Net Asset Value per Share, as of today"), ("c2", "asset value"), ("c3", "")], "chunk_id string, clean_text string")
    terms = spark.createDataFrame([("net asset value per share", "m5"), ("Asset Value", "m2"), ("the net asset value per share as of today and on", "m11"), ("--", "none")], "term string, meaning string")
    got = {(r.chunk_id, r.meaning) for r in term_injection(chunks, terms).collect()}
    assert got == {("c1", "m5"), ("c1", "m2"), ("c2", "m2")}


def test_terms_and_texts_do_not_pass_through_the_driver(spark, tmp_path):
    from vellum.operators import grounding

    spark.range(3000).selectExpr("concat('k', id) AS chunk_id", "concat('the red ring ', id % 9) AS clean_text").write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    met = grounding.term_injection(chunks, chunks.select(F.lit("red ring").alias("term"), F.lit("x").alias("meaning")))
    assert met.count() == 3000
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_tables_without_a_page_are_on_page_one(spark):
    from vellum.operators import chunks

    items = spark.createDataFrame([(1, 0, "table", "x", None), (1, 1, "text", "x", None), (1, 2, "picture", None, None), (1, 3, "text", "x", 2)], "doc_id int, item_no int, label string, text string, page_no long")
    assert {(r.item_no, r.kind, r.page_no) for r in chunks.item_kind(items).collect()} == {(0, "table", 1), (3, "text", 2)}


def test_cell_names(spark):
    from vellum.operators import grounding

    def name(n):
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    numbers = [1, 26, 27, 52, 676, 702, 703, 1378, 16_384, 18_278, 18_279, 475_254]
    rows = spark.createDataFrame([(n,) for n in numbers], "c int").select("c", grounding.cell_name(F.lit(7), F.col("c")).alias("n")).collect()
    assert {r.c: r.n for r in rows} == {n: f"{name(n)}7" for n in numbers}


def test_asset_ids_look_ahead_in_their_line(spark):
    import re

    from vellum.functions import text

    texts = ["ABCDEFGHI 1", "abcdefghij", "1 ABCDEFGHIJ", "123456789 x", "x 123456789", "ABCDEFGH1 ABCDEFGHI\n2", "A1234567890BC ABCDEF1234", "a-b1c2d3e4f5g6 longestword9 words,", "", "1234567890 1 abcdefghi 9z"]
    want = [len(re.findall(r"(?i)\b(?=[A-Z0-9]{9,12}\b)(?=.*\d)(?=.*[A-Z])[A-Z0-9]{9,12}\b", t)) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.asset_ids(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == want and sum(want) > 4


def test_probe_strips_of_images_of_several_sizes(spark):
    rng = random.Random(12)
    images, pixels = [], {}
    for i, (w, h, n) in enumerate(((9, 7, 3), (30, 4, 4), (1, 1, 3), (12, 12, 1))):
        rgb = [[tuple(rng.choice([255, 0, 130, 200]) for _ in range(3)) for _ in range(w)] for _ in range(h)]
        data = bytearray(b"".join(bytes([*reversed(p), *[77] * (n - 3)][:n]) for row in rgb for p in row))
        images.append((i, h, w, n, data))
        if n >= 3:
            pixels[i] = rgb
    probes = [(rng.randrange(5), s, x, y, x + rng.randrange(4), y + rng.randrange(4)) for s in range(120) for x, y in [(rng.randrange(-3, 14), rng.randrange(-3, 10))]]
    im = spark.createDataFrame(images, "origin long, height int, width int, nChannels int, data binary")
    pr = spark.createDataFrame(probes, "image_id long, seq long, x0 long, y0 long, x1 long, y1 long")
    for near in (False, True):
        got = sorted(tuple(r) for r in P.raster_probe_images(pr, im, 2, 5, near).collect())
        want = []
        for i, rgb in pixels.items():
            table = spark.createDataFrame([(i, x, y, *p) for y, row in enumerate(rgb) for x, p in enumerate(row)], "image_id long, x long, y long, r int, g int, b int")
            want += [tuple(r) for r in P.raster_probe(pr.filter(F.col("image_id") == i), table, len(rgb[0]), len(rgb), 2, 5, near).collect()]
        assert got == sorted(want) and got
    boxes = pr.withColumnRenamed("image_id", "origin")
    got = sorted((r.origin, r.seq, r.x, r.y, r.r, r.g, r.b) for r in S.strip_pixels(im, boxes).collect())
    assert got == sorted((i, s, x, y, *pixels[i][y][x]) for i, s, x0, y0, x1, y1 in probes if i in pixels for y in range(max(y0, 0), min(y1, len(pixels[i]))) for x in range(max(x0, 0), min(x1, len(pixels[i][0]))))
    lines = S.strip_lines(im, boxes)
    assert lines.count() == len({(i, s, y) for i, s, x, y, *_ in got})


def test_images_are_made_row_by_row(spark):
    from tests.conftest import SF
    from vellum.plans import fixtures

    rows = fixtures.image_rows(fixtures.load(spark, SF, "images"))
    assert sorted(rows.collect()) == sorted(fixtures.coded_images(fixtures.load(spark, SF, "pixels")).collect())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "explode" not in plan


def test_pixels_of_strips_are_made_once(spark):
    from tests.conftest import SF
    from vellum.plans import fixtures

    met = P.raster_probe_images(fixtures.load(spark, SF, "probes"), fixtures.image_rows(fixtures.load(spark, SF, "images")), reach=3)
    assert met._jdf.queryExecution().optimizedPlan().toString().count("array_min(") == 1


def test_entity_density_is_the_same_with_and_without_digits(spark):
    """One formula for all texts, against the one that looks for numbers only where digits are."""
    texts = ["", None, "pay EUR or usd, $ and £", "no hits here", "12x of (1,200) USD, FY24", "keys and 40 MW\nAB12345678Z", "sq ft in Q3", "\u0663x of \u0664%", "ABCDEFGHIJ", "FY\u0662\u0663 usd"]
    t = F.col("t")
    count = lambda p: F.regexp_count(t, F.lit(p))
    hits = count(T.MONEY) * 2.0 + (count(T.UNITS) + T.asset_ids(t)) * 3.0 + count(T.PERIODS) * 1.5
    plain = F.least(hits / F.greatest(T.token_count(t), F.lit(1)), F.lit(1.0))
    rows = spark.createDataFrame([(x,) for x in texts + [f"{x} {'word ' * 20}" for x in texts if x]], "t string").select("t", plain.alias("a"), T.entity_density(t).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and len({r.a for r in rows}) > 3
