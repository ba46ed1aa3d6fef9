"""Checks that a quoted sentence really stands in the text it is said to come from."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from episodika.functions.text import let

# Share of words that must meet in one window, and what is a word.
QUOTE_MATCH = 0.7
WORD = r"[a-z0-9]{3,}"
MIN_WORDS = 4
MIN_WINDOW = 30


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def quoted(quote: Column, text: Column) -> Column:
    """True when 70% of the quote's distinct words fall into one stretch of about twice its length."""

    def check(w: Column) -> Column:
        size = F.greatest(2 * F.size(w["said"]), F.lit(MIN_WINDOW))
        stop = F.greatest(F.size(w["held"]) - F.floor(size / 2), F.lit(1)).cast("int")
        starts = F.sequence(F.lit(0), stop - 1, F.greatest(F.floor(size / 4), F.lit(1)).cast("int"))

        def enough(i: Column) -> Column:
            met = F.array_intersect(w["want"], F.slice(w["held"], i + 1, size))
            return F.size(met) >= QUOTE_MATCH * F.size(w["want"])

        return (F.size(w["want"]) >= MIN_WORDS) & F.exists(starts, enough)

    said = words(quote)
    return let(F.struct(said.alias("said"), F.array_distinct(said).alias("want"), words(text).alias("held")), check)


def grounded(quote: Column, text: Column, clues: Column, missing: Column) -> Column:
    """A verdict stands when its quote does and at most a third of the clues (one at least) stay unconfirmed."""
    allowed = F.greatest(F.size(F.coalesce(clues, F.array())), F.lit(3))
    return quoted(quote, text) & (F.size(F.coalesce(missing, F.array())) * 3 <= allowed)


def inside_one_piece(evidence: Column, pieces: Column) -> Column:
    return F.exists(pieces, lambda p: p.contains(evidence))


def split_over_boundary(evidence: Column, text: Column, pieces: Column) -> Column:
    """The evidence stands in the text but in none of its pieces."""
    return text.contains(evidence) & ~inside_one_piece(evidence, pieces)
