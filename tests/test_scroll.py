"""Pages of a sorted store, and totals taken while writing."""

import random
import re

from pyspark.sql import functions as F

from vellum.operators import ledger
from vellum.sources.scroll import Scroll


def test_pages_joined_give_the_whole_answer_once(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"c{i:04}", rng.choice(["visual", "text", None]), i % 3) for i in range(700)] + [(None, "visual", 0)]
    rng.shuffle(rows)
    points = spark.createDataFrame(rows, "chunk_id string, type string, page long").withColumn("embedding", F.array(F.lit(1.0)))
    store = Scroll.write(points, str(tmp_path / "s"), parts=9)
    got, after = [], None
    while page := [r.chunk_id for r in store.page(23, after, type="visual", page=1).collect()]:
        got += page
        after = page[-1]
    assert got == sorted(c for c, t, p in rows if c and t == "visual" and p == 1)
    assert "embedding" not in store.page(5).columns and store.page(5, "zzz").count() == 0
    assert store.page(5, type="none").count() == 0
    late = store.page(10, "c0600")
    plan = late._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"part#\d+ (?:IN|=) \(?([\d,]+)", plan.split("PartitionFilters")[1])
    assert read and {int(p) for p in read[0].split(",")} <= {part for part, _, high in store.bounds if high > "c0600"}, plan  # parts before the cursor aren't read
    assert "GreaterThan(chunk_id,c0600)" in plan


def test_empty_store(spark, tmp_path):
    store = Scroll.write(spark.createDataFrame([], "chunk_id string, type string"), str(tmp_path / "s"))
    assert store.page(5).count() == 0 and store.page(5, "a", type="x").count() == 0


def test_totals_are_those_of_the_written_rows(spark, tmp_path):
    report = spark.createDataFrame([("a", "success", 3), ("b", "success", 4), ("c", "failed", 0)], "file_name string, status string, total_chunks long").repartition(3)
    got = ledger.written_report(report, str(tmp_path / "r"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ledger.run_summary(spark.read.parquet(str(tmp_path / "r"))).collect()))
    chunks = spark.createDataFrame([("visual", 2, 5), (None, None, None), ("text", 9, 0)], "type string, page_number int, token_count int")
    assert tuple(ledger.written_chunks(chunks, str(tmp_path / "c")).first()) == (3, 5, 1, 2, 9)
    assert tuple(ledger.written_chunks(chunks.limit(0), str(tmp_path / "d")).first()) == (0, 0, 0, 0, None)
    assert ledger.written_report(report.limit(0), str(tmp_path / "e")).count() == 0
