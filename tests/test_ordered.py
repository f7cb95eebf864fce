"""Groups cut into ranges give the numbers, next values and ledgers of whole groups."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import chunks, ledger, tables
from vellum.operators.ordered import followed, numbered


def groups(spark):
    rng = random.Random(2)
    rows = [("hot", rng.randrange(10**15), i) for i in range(3000)] + [(None, None if i % 9 == 0 else i, i) for i in range(300)] + [(f"s{i % 40}", i * 7 % 11, i) for i in range(400)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, v long, id long").repartition(5)


def place(r):
    return (r[1] is not None, r[1] or 0, r[2])


@pytest.mark.parametrize("most", [10, 250, 10**6])
def test_numbers_and_next_values(spark, most):
    rows, df = groups(spark)
    number, after = {}, {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=place)
        for i, r in enumerate(own):
            number[k, r[2]] = i + 1
            after[k, r[2]] = own[i + 1][2] if i + 1 < len(own) else None
    got = numbered(df, ["k"], [F.col("v"), F.col("id")], "n", most, parts=7)
    assert got.columns == ["k", "v", "id", "n"]
    assert {(r.k, r.id): r.n for r in got.collect()} == number and got.count() == len(rows)
    got = followed(df, ["k"], ["v", "id"], "id", "next", most, parts=7)
    assert {(r.k, r.id): r.next for r in got.collect()} == after


def test_a_large_group_is_numbered_in_many_tasks(spark):
    df = spark.range(200_000).select(F.lit(1).alias("doc"), (F.col("id") * 7919 % 200_003).alias("place"))
    got = numbered(df, ["doc"], [F.col("place")], "n", most=10_000, parts=16)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.filter("n = 1").count() == 1 and got.agg(F.max("n")).first()[0] == 200_000
    assert got.orderBy("n").limit(100).agg(F.max("place")).first()[0] <= 150
    assert max(sizes) < 120_000


def test_hot_documents_in_reading_order_and_segments(spark):
    items = spark.createDataFrame([(1, i, 1 + i // 10, ("text", "table", "chart")[i * 7 % 3], f"t{i}") for i in range(500)], "doc_id long, item_no long, page_no long, label string, text string")
    key = lambda df: sorted((r.doc_id, r.item_no, r.chunk_no) for r in df.collect())
    assert key(chunks.reading_order(items, most=20)) == key(chunks.reading_order(items))
    cells = spark.createDataFrame([(1, f"Sheet{s}", s, r, c, f"{s}.{r}.{c}") for s in (1, 2) for r in range(1, 99) for c in (1, 2)], "doc long, sheet string, sheet_no int, row_no int, col_no int, value string")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(tables.table_segments(cells, ["a", "b"], most=15)) == key(tables.table_segments(cells, ["a", "b"]))


def test_supersession_in_batches_with_sparse_versions_and_ties(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([rng.randrange(10**17), 5, 10**16]), f"h{i % 50:02}") for i in range(300)]
    schema = "filename string, version long, doc_hash string"
    distinct = sorted(set(rows), key=lambda r: (r[0] or "", r[1], r[2]))
    want = {}
    for r, s in zip(distinct, [*distinct[1:], (object(), 0, "")], strict=True):
        want[r] = s[2] if s[0] == r[0] else None
    whole = ledger.supersession(spark.createDataFrame(distinct, schema), most=20)
    as_dict = lambda df: {(r.filename, r.version, r.doc_hash): r.superseded_by_hash for r in df.collect()}
    assert as_dict(whole) == want
    state = ledger.supersession(spark.createDataFrame([], schema))
    for k in (0, 1, 2, 1):
        state = ledger.supersede(state, spark.createDataFrame(rows[k::3], schema), most=20)
        state = spark.createDataFrame(state.collect(), state.schema)
    assert as_dict(state) == want and state.count() == len(want)
    assert state.filter("is_superseded <> (superseded_by_hash IS NOT NULL)").count() == 0
