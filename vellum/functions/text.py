"""Text expressions: Column -> Column, JVM side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that these rules are defined by.
CURRENCY = r"(?iUd)[$€£¥]|\b(USD|EUR|GBP|JPY|CHF|CAD|AUD|CNY|HKD|SGD|NZD|KRW)\b"
MONEY = CURRENCY + r"|\(\d{1,3}(?:,\d{3})*\)|\d+(?:\.\d+)?[x%]"
UNITS = r"(?iUd)\b(sq\s?ft|sf|m2|psf|keys|MW|GWh|TEU|dwt|mt|bbl)\b"
ASSET_ID = r"(?iUd)\b[A-Z0-9]{9,12}\b"
PERIODS = r"(?Ud)\b(?:FY|Q[1-4]|LTM)\d{2}\b|\b2[0O]\d{2}[E]?\b"
DOT_LEADER = r"(?md)\.{5,}\s*\d+$"
LEGAL_START = r"^(article|section)\s+\d"
DISCLAIMER = r"forward[- ]looking|risk factors|disclaimer"
NOISE = (r"(?U)Page \d+ of \d+", r"^\p{Nd}+\n?$", r"(?i)confidential", r"(?i)draft", r"_{5,}", r"(?U)\s{2,}")
TITLE_WORD = r"^[^\p{Lu}\p{Ll}]*(?:\p{Lu}\p{Ll}*(?:[^\p{Lu}\p{Ll}]+|$))+$"
UPPER_WORD = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"
PUNCTUATION = r"!-/:-@\[-`{-~"


def strip(t: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def tokens(t: Column) -> Column:
    """Parts between white space; none for an empty text."""
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


def token_count(t: Column) -> Column:
    return F.size(tokens(t))


def lower_words(t: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def alpha_ratio(t: Column) -> Column:
    """1 less the share of tokens that are two letters or more, ASCII punctuation around them aside."""
    bare = F.transform(tokens(t), lambda x: F.regexp_replace(x, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", ""))
    words = F.size(F.filter(bare, lambda x: x.rlike(r"^\p{L}{2,}$")))
    return F.lit(1.0) - words / F.greatest(token_count(t), F.lit(1))


def asset_ids(t: Column) -> Column:
    """Number of asset ids: words of 9 to 12 letters and digits with a digit and a letter at their place or later in the line.

    Each line is cut once after the words of its last digit and its last letter; that is linear in its length.
    """
    upto = lambda line, p: F.length(F.regexp_extract(line, p, 0))
    cut = lambda line: F.substring(line, F.lit(1), F.least(upto(line, r"(?Ud)^.*\d\w*"), upto(line, r"(?iUd)^.*[A-Z]\w*")))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"\p{Nd}"))
    return F.aggregate(lines, F.lit(0), lambda n, line: n + F.regexp_count(cut(line), F.lit(ASSET_ID)))


def entity_density(t: Column) -> Column:
    """Weighted hits of amounts (2), units and asset ids (3) and periods (1.5) per token, 1 at most.

    A text without digits has no asset ids and no periods, and its amounts are currency signs and names.
    """
    count = lambda p: F.regexp_count(t, F.lit(p))
    numbers = count(MONEY) * 2.0 + asset_ids(t) * 3.0 + count(PERIODS) * 1.5
    hits = count(UNITS) * 3.0 + F.when(~t.rlike(r"\p{Nd}"), count(CURRENCY) * 2.0).otherwise(numbers)
    return F.least(hits / F.greatest(token_count(t), F.lit(1)), F.lit(1.0))


def risk_penalty(t: Column) -> Column:
    """1 for two table-of-contents lines or more, 0.8 for legal or disclaimer openings, else 0."""
    head = F.lower(F.substring(t, 1, 200))
    legal = head.rlike(LEGAL_START) & ~head.contains("note")
    return F.when(F.regexp_count(t, F.lit(DOT_LEADER)) > 1, 1.0).when(legal | head.rlike(DISCLAIMER), 0.8).otherwise(0.0)


def clean_noise(t: Column) -> Column:
    """Page marks, bare numbers, watermarks and rules blanked out, white space collapsed; null gives ''."""
    for p in NOISE:
        t = F.regexp_replace(t, p, " ")
    return F.coalesce(F.array_join(tokens(t), " "), F.lit(""))


def long_enough(t: Column, least: int = 50) -> Column:
    return F.coalesce(F.length(t) >= least, F.lit(False))


def numeric_label(t: Column) -> Column:
    """A data point: it has a digit and fewer than ten characters, trimmed."""
    return strip(t).rlike(r"\p{Nd}") & (F.length(strip(t)) < 10)


def chatty_json(reply: Column, repair_arrays: bool = False) -> Column:
    """The JSON in a model's reply as text, or null: fenced part, outermost braces, one comma repair."""
    fenced = F.when(F.regexp_count(reply, F.lit("```")) >= 2, F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)).otherwise(F.when(reply.contains("```"), F.substring_index(reply, "```", -1)).otherwise(reply))
    first, last = F.instr(fenced, "{"), F.length(fenced) - F.instr(F.reverse(fenced), "}") + 1
    body = F.when((first > 0) & fenced.contains("}"), F.substring(fenced, first, F.greatest(last - first + 1, F.lit(0)))).otherwise(fenced)
    fixed = F.regexp_replace(body, r",\s*\}", "}")
    if repair_arrays:
        fixed = F.regexp_replace(fixed, r",\s*\]", "]")
    good = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(good(body), body).when(good(fixed), fixed)
