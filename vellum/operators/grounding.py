"""Conversation state, citations, definitions and context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T


def conversation_state(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_messages, n_chars): each message with the size of the state after it.

    The state after a message is the conversation's messages with n_messages up to its own; so every text is kept
    once, not once for each later turn.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("conv_id", "turn", "role", "text", F.count("*").over(order).alias("n_messages"), F.sum(F.coalesce(F.length("text"), F.lit(0))).over(order).alias("n_chars"))


def final_state(turns: DataFrame) -> DataFrame:
    """(conv_id, n_messages, messages, last_role): each conversation's state after its last turn."""
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return said.select("conv_id", F.size("m").alias("n_messages"), F.transform("m", lambda x: F.concat_ws(": ", x["role"], x["text"])).alias("messages"), F.element_at("m", -1)["role"].alias("last_role"))


def cell_name(row: Column, col: Column) -> Column:
    """Spreadsheet name such as C15 of a row and a column counted from 1, up to column ZZZZ."""
    letter = lambda n: F.char((n % 26 + 65).cast("long"))
    place, first, parts = col.cast("long") - 1, 0, []  # names of k letters begin at 26 + 26**2 ... + 26**(k - 1)
    for k in range(4):
        parts.insert(0, F.when(place >= first, letter(F.floor((place - first) / 26**k))).otherwise(""))
        first += 26 ** (k + 1)
    return F.concat(*parts, row.cast("string"))


def citations(chunks: DataFrame, length: int = 120) -> DataFrame:
    """(chunk_id, source_file, page_number, blurb): where a chunk's text is from."""
    return chunks.select("chunk_id", F.col("source").alias("source_file"), "page_number", F.substring("clean_text", 1, length).alias("blurb"))


def cell_citations(cells: DataFrame) -> DataFrame:
    """(doc, native_id, blurb) of the cells that have a value."""
    return cells.filter("value IS NOT NULL").select("doc", "sheet", cell_name(F.col("row_no"), F.col("col_no")).alias("native_id"), F.col("value").alias("blurb"))


#: Fixed value: how a clause defines a term.
DEFINITION = r'"([^"]+)" means ([^.]+)\.'


def definitions_extract(clauses: DataFrame) -> DataFrame:
    """(doc, clause_no, term, meaning) of the definitions in each clause's text. Declared only; own semantics."""
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(DEFINITION), 1).alias("term"), F.regexp_extract_all("text", F.lit(DEFINITION), 2).alias("meaning"))
    return clauses.select("doc", "clause_no", F.explode(found).alias("d")).select("doc", "clause_no", "d.term", "d.meaning")


def term_nodes(definitions: DataFrame) -> DataFrame:
    """(node, run, term, meaning): definitions (term, meaning) by the trie node where they are looked up, their first word, or their first two if they have more; run: all their words."""
    terms = definitions.select("term", "meaning", T.lower_words(F.col("term")).alias("_w")).filter(F.size("_w") > 0).distinct()
    return terms.select(F.array_join(F.slice("_w", 1, 2), " ").alias("node"), F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias("run"), "term", "meaning")


def term_injection(chunks: DataFrame, definitions: DataFrame) -> DataFrame:
    """(chunk_id, term, meaning): definitions whose term stands in the chunk. Declared only; own semantics.

    Words are lower-case runs of letters and digits. Each distinct word and pair of words of a chunk is looked up once
    among the nodes of term_nodes(), whatever lengths the terms have; terms met there are then compared with the chunk's words.
    Both joins are merges: texts that compress well are estimated far too small, and would pass through the driver to be broadcast.
    """
    w = chunks.select("chunk_id", T.lower_words(F.col("clean_text")).alias("w")).filter(F.size("w") > 0)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w")), lambda x, y: F.concat(x, F.lit(" "), y))
    hits = w.select("chunk_id", F.explode(F.array_distinct(F.concat("w", pairs))).alias("node")).join(term_nodes(definitions).hint("merge"), "node")
    whole = w.select("chunk_id", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("words"))
    return hits.join(whole.hint("merge"), "chunk_id").filter(F.col("words").contains(F.col("run"))).select("chunk_id", "term", "meaning").distinct()


def context_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """ranked (query_id, rank, chunk_id, token_count) cut where the running sum of tokens passes budget. Declared only; own semantics."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum("token_count").over(order)).filter(F.col("used") <= budget)


def token_counted(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("token_count", T.token_count(F.col("clean_text")))
