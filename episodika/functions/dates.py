"""Dates inside free text, found with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from episodika.functions.text import let

# The four written forms with the group numbers of year, month and day.
DATE_FORMS = (
    (r"(?i)([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+((?:19|20)\d\d)", (3, 1, 2)),
    (r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3,9})\.?,?\s+((?:19|20)\d\d)", (3, 2, 1)),
    (r"(?i)((?:19|20)\d\d)\s+([a-z]{3,9})\s+(\d{1,2})\b", (1, 2, 3)),
    (r"((?:19|20)\d\d)[-/.](\d{1,2})[-/.](\d{1,2})\b", (1, 2, 3)),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DATE_KEY = r"(?i)air|date|release|broadcast|premiere"
DUB_KEY = r"(?i)en|usa|\bus\b|dub|sub|date2|america"


def _found(text: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    """All matches of one form with their position: lengths of what lies between matches give the offsets."""
    year, month, day = groups
    length = lambda s, x: s + F.length(x)

    def read_all(found: Column) -> Column:
        def read(match: Column, i: Column) -> Column:
            word = F.regexp_extract(match, pattern, month)
            named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(word, 1, 3))).cast("int")
            number = F.when(word.rlike(r"^\d+$"), word.try_cast("int")).otherwise(named)
            before = F.concat(F.slice(found["between"], 1, i + 1), F.slice(found["matches"], 1, i))
            iso = F.format_string(
                "%s-%02d-%02d",
                F.regexp_extract(match, pattern, year),
                F.coalesce(number, F.lit(0)),
                F.regexp_extract(match, pattern, day).try_cast("int"),
            )
            return F.struct(F.aggregate(before, F.lit(0), length).alias("at"), F.try_to_date(iso, "yyyy-MM-dd").alias("day"))

        return F.transform(found["matches"], read)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(matches.alias("matches"), F.split(text, pattern, -1).alias("between")), read_all)


def parse_dates(text: Column | str) -> Column:
    """Dates in order of appearance, impossible ones dropped, each once."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    every = let(t, lambda s: F.concat(*[_found(s, pattern, groups) for pattern, groups in DATE_FORMS]))
    valid = F.filter(every, lambda x: x["day"].isNotNull())
    return F.array_distinct(F.transform(F.array_sort(valid), lambda x: x["day"]))


def infobox_dates(infobox: Column) -> Column:
    """Air dates of an infobox map: date-like fields in order, fields of dubs and foreign releases last."""
    keys = F.filter(F.map_keys(infobox), lambda k: k.rlike(DATE_KEY))
    home = F.filter(keys, lambda k: ~k.rlike(DUB_KEY))
    abroad = F.filter(keys, lambda k: k.rlike(DUB_KEY))
    return F.array_distinct(F.flatten(F.transform(F.concat(home, abroad), lambda k: parse_dates(infobox[k]))))
