"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import ann, decontaminate, jaccard, mixing, packing, quality, spelling, store, suffix, tokencount, toxicity, weak, whitening
from vellum.llm.shared import shared_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.classify(read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.repeats(read(spark, sf_dir, "documents")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_join(read(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "store")
    store.write_store(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    store.check_roots(spark, path)
    return store.document_index(spark, path)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def sql_op1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def sql_op3_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_suffix_dedup(spark, sf_dir).select("doc_id", "n_bytes", (F.col("n_removed") <= F.col("n_bytes")).alias("within"), ((F.col("n_spans") > 0) == (F.col("n_removed") >= 100)).alias("whole_spans"))


def sql_op4_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def sql_op7_first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document once, within the window of its block."""
    return op7_source_mixing(spark, sf_dir).filter("pass_no = 0").select("doc_id", "source", F.expr("release <= slot AND slot < deadline").alias("in_window"))


def sql_op9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_nearest_neighbours(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("n_found"), F.max("rank").cast("long").alias("last_rank"))


def sql_op10_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_toxicity(spark, sf_dir).select("doc_id", "held_out", F.expr("score BETWEEN 0 AND 1 AND predicted = CAST(score >= 0.5 AS INT)").alias("sound"))


def sql_op12_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_embedding_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*_OPERATORS, *_PARTS)}


_OPERATORS = (op1_quality_rules, op2_quality_classifier, op3_suffix_dedup, op4_token_counts, op5_ngram_jaccard, op6_token_store, op7_source_mixing, op8_best_fit_packing, op9_nearest_neighbours, op10_toxicity, op11_spelling_variants, op12_embedding_whitening, op13_benchmark_decontamination)
#: What SQL can say of the results of operators that it can't express whole.
_PARTS = (sql_op1_statistics, sql_op3_bytes, sql_op4_bytes, sql_op7_first_pass, sql_op9_found, sql_op10_held_out, sql_op12_deviation)


#: op5 by brute force: all pairs of different sets that share a shingle, then all sets that each one reaches by links.
_OP5 = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, row_number() OVER () AS nr, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
rows_ AS (
    SELECT doc_id, nr, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS shingles
    FROM words
),
sets AS (SELECT min(nr) AS s, min(doc_id) AS low, shingles, len(shingles) AS n FROM rows_ WHERE len(shingles) > 0 GROUP BY shingles),
tokens AS (SELECT s, n, unnest(shingles) AS token FROM sets),
links AS (
    SELECT a.s AS a, b.s AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.s <> b.s
    GROUP BY a.s, b.s, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reach AS (SELECT s, s AS t FROM sets UNION SELECT r.s, l.b FROM reach r JOIN links l ON l.a = r.t),
low AS (SELECT r.s, min(x.low) AS component_id FROM reach r JOIN sets x ON x.s = r.t GROUP BY r.s),
degree AS (SELECT a AS s, count(*) AS n_links FROM links GROUP BY a)
SELECT r.doc_id, CAST(len(r.shingles) AS BIGINT) AS n_shingles, coalesce(low.component_id, r.doc_id) AS component_id, coalesce(d.n_links, 0) AS n_links
FROM rows_ r LEFT JOIN sets x ON x.shingles = r.shingles AND len(r.shingles) > 0 LEFT JOIN low ON low.s = x.s LEFT JOIN degree d ON d.s = x.s
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The table of the usual crc32, and the crc32 of a list of bytes b with it.
_CRC = "crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"
_CRC_OF = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295)"

#: op11 by brute force: words that share what is left after one deletion.
_OP11 = rf"""
WITH RECURSIVE {_CRC},
runs AS (
    SELECT doc_id, run, count(*) AS c
    FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
),
coded AS (
    SELECT run, c, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END)) AS b
    FROM runs
),
hashed AS (SELECT run, c, {_CRC_OF} AS h FROM coded, crc),
words AS (
    SELECT word, CAST(sum(c) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, c FROM hashed)
    GROUP BY word HAVING length(word) >= 6 AND sum(c) >= 5
),
short AS (SELECT word, n, i, substring(word, 1, CAST(i - 1 AS INT)) || substring(word, CAST(i + 1 AS INT)) AS d FROM words, unnest(range(1, length(word) + 1)) u(i)),
near AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM short a JOIN short b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
    UNION SELECT s.word, w.word, w.n FROM short s JOIN words w ON s.d = w.word
    UNION SELECT w.word, s.word, s.n FROM short s JOIN words w ON s.d = w.word
),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
follow AS (SELECT word, word AS here, 0 AS k FROM forms UNION ALL SELECT f.word, g.form, k + 1 FROM follow f JOIN forms g ON g.word = f.here WHERE g.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(here, k) AS root FROM follow GROUP BY word) r USING (word)
"""

#: op13 by brute force: all runs of as many words as a phrase has.
_OP13 = r"""
WITH docs AS (SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS p FROM items WHERE len(w) > 0),
runs AS (SELECT nr, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM docs, (SELECT DISTINCT n FROM phrases), unnest(range(1, len(w) - n + 2)) u(i)),
hits AS (SELECT nr, i, n, item FROM runs JOIN phrases USING (n, p)),
words AS (SELECT nr, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) u(j) GROUP BY nr),
found AS (SELECT nr, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT nr, item FROM hits) GROUP BY nr)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (nr) LEFT JOIN found USING (nr)
"""


_STATISTICS = r"""
WITH docs AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT nr, line, count(*) AS n FROM (SELECT nr, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
again AS (SELECT nr, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines FROM lines GROUP BY nr),
runs AS (SELECT nr, i, array_to_string(w[i:i + 4], ' ') AS p FROM docs, unnest(range(1, len(w) - 3)) u(i)),
twice AS (SELECT nr, i FROM runs QUALIFY count(*) OVER (PARTITION BY nr, p) > 1),
under AS (SELECT nr, count(DISTINCT j) AS n_repeat_words FROM twice, unnest(range(i, i + 5)) u(j) GROUP BY nr)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed
FROM docs LEFT JOIN again USING (nr) LEFT JOIN under USING (nr)
"""
_DEVIATION = """
WITH good AS (SELECT row_number() OVER () AS nr, vec_id, embedding AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT nr, vec_id, unnest(range(len(v))) AS d, CAST(floor(64 * unnest(v)::DOUBLE) AS HUGEINT) + 1000000 AS x FROM good),
s AS (SELECT d, sum(x) AS s, count(*) AS n FROM x GROUP BY d)
SELECT vec_id, n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation FROM x JOIN s USING (d) GROUP BY nr, vec_id, n
"""


def oracles() -> dict[str, str]:
    return {
        "op5_ngram_jaccard": _OP5,
        "op11_spelling_variants": _OP11,
        "op13_benchmark_decontamination": _OP13,
        "sql_op1_statistics": _STATISTICS,
        "sql_op3_bytes": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, true AS within, true AS whole_spans FROM documents",
        "sql_op4_bytes": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents",
        "sql_op7_first_pass": "SELECT doc_id, source, true AS in_window FROM documents",
        "sql_op9_found": "SELECT vec_id AS query_id, least(20, (SELECT count(*) FROM embeddings) - 1) AS n_found, least(20, (SELECT count(*) FROM embeddings) - 1) AS last_rank FROM embeddings WHERE vec_id % 20 = 0",
        "sql_op10_held_out": f"WITH {_CRC}, coded AS (SELECT doc_id, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS b FROM documents) SELECT doc_id, {_CRC_OF} % 5 = 0 AS held_out, true AS sound FROM coded, crc",
        "sql_op12_deviation": _DEVIATION,
    }
