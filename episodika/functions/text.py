"""Text functions as column expressions; everything here but entity decoding and letter folding stays inside the JVM."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# ---- Fixed values: patterns and limits that decide results --------------------------------------------------------
PLACEHOLDER = (
    r"(to be added|tba|tbd|wip|missing|coming soon|n/?a|none|[?.]+|under construction|summarize the episode here|"
    r"need translation\b.*|here's where you put the description of the plot\b.*)[.!]?"
)
EPISODE_NAME = r"(에피소드|episode|제)\s*\d+\s*(화|회)?"
TAB_LABEL = r"\|-\|[ \t]*([^=\n]{0,60})=[ \t]*"
FIRST_TAB = r"^\s*([A-Za-z][^=\n]{0,60})=[ \t]*"
JAPANESE = r"[぀-ヿ㐀-鿿]"
SENTENCE_END = r"[.!?…][\s\"'”’)\]]*$"
SENTENCE_GAP = r"(?<=[.!?])[\"'”’)\]]*\s+"
SEASON_WORDS = r"\b(\d+(st|nd|rd|th) season|season \d+|part \d+|(the )?final season|2nd|ii+|tv)\b.*"
MIN_BODY = {"episode": 20, "other": 50}
PARAGRAPH_TARGET = 700
JAPANESE_SHARE = 0.3
SHORT_LINE = 50
#: what (?U)\s matches
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# --------------------------------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where the body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    """Both ends without any Unicode white space.

    Trimming by a list of characters lays out the whole text; one that begins and ends with a printed ASCII character stays as it is.
    """

    def trimmed(x: Column) -> Column:
        b = x.cast("binary")
        printed = [F.substring(b, i, 1).between(F.lit(b"!"), F.lit(b"~")) for i in (1, -1)]
        return F.when(printed[0] & printed[1], x).otherwise(F.btrim(x, F.lit(SPACE)))

    return let(_col(text), trimmed)


def replace_marked(text: Column, marks: tuple[str, ...], pattern: str, new: str) -> Column:
    """``regexp_replace`` for a pattern that never matches without one of ``marks``, which are looked for in bytes first."""
    return let(text, lambda x: F.when(reduce(or_, [x.contains(m) for m in marks]), F.regexp_replace(x, pattern, new)).otherwise(x))


def at_least(text: Column | str, n: int | Column) -> Column:
    """Has ``n`` characters or more; those of a text of ``4 * n`` bytes need not be counted."""
    t = _col(text)
    return (F.octet_length(t) >= 4 * n) | (F.length(t) >= n)


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(r"(?isU)\A(?:" + pattern + r")\z")


@F.arrow_udf(T.StringType())
def _decode_entities(text: pa.Array) -> pa.Array:
    # About 2,200 named entities with prefix rules; no built-in function knows them.
    return pa.array([v if v is None or "&" not in v else html.unescape(v) for v in text.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def ascii_fold(text: pa.Array) -> pa.Array:
    """Letters without marks, everything else outside ASCII dropped. Spark has no Unicode normalisation."""
    return pa.array(
        [
            "" if v is None else v if v.isascii() else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode()
            for v in text.to_pylist()
        ],
        pa.string(),
    )


def clean_html(text: Column | str) -> Column:
    """Description markup to plain text; hidden spoiler spans go as a whole."""
    t = F.coalesce(_col(text), F.lit(""))
    t = F.regexp_replace(t, r"(?s)~!.*?!~", " ")
    t = F.regexp_replace(t, r"<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = _decode_entities(t)
    t = F.regexp_replace(t, r"(?U)\n\s*\n+", "\n\n")
    return strip(F.regexp_replace(t, r"[ \t]+", " "))


def clean_markup(text: Column | str) -> Column:
    """Chunk body without spoiler marks, links, references, templates, emphasis and stray line-head punctuation."""
    t = F.coalesce(_col(text), F.lit(""))
    # each pattern with what a text must hold for it to match, and beginning with the one character or class that it needs
    for marks, pattern, new in (
        (("~!",), r"(?s)~!.*?!~", " "),
        (("~!",), "~!", " "),
        (("!~",), "!~", " "),
        (("](",), r"(?=[!\[])!?\[([^\]\n]*)\]\((?:https?://|/)[^)\s]*\)", "$1"),
        (("<",), r"(?is)<(?:ref[^>]*/>|ref.*?</ref>|/?[a-z][^>\n]{0,80}>)", " "),
        (("{{",), r"\{\{[^{}]*\}\}", " "),
        (("[[",), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"),
        (("{{", "}}", "[[", "]]", "''", "__", "**"), r"(?=[{}\[\]'_*])(?:\{\{|\}\}|\[\[|\]\]|'{2,}|__|\*\*)", ""),
        ((",", ";", ":"), r"(?m)^[ \t]*[,;:][ \t]*", ""),
        # a single space stays as it is
        (("  ", "\t"), r"[ \t]{2,}|\t", " "),
        (("\n",), r"(?U)\n\s*\n+", "\n"),
    ):
        t = replace_marked(t, marks, pattern, new)
    return strip(t)


def is_placeholder(line: Column) -> Column:
    return full_match(strip(line), PLACEHOLDER)


def is_episode_name(line: Column) -> Column:
    return full_match(strip(line), EPISODE_NAME)


def head_of(text: Column | str) -> Column:
    return F.substring_index(_col(text), "\n", 1)


def body_of(text: Column | str) -> Column:
    """What follows the first line; empty when there is one line only."""
    t = _col(text)
    # cut as bytes: nothing is counted, and a line end is never inside a character
    rest = F.substring(t.cast("binary"), F.octet_length(head_of(t)) + 2, F.octet_length(t)).cast("string")
    return F.when(t.contains("\n"), rest).otherwise(F.lit(""))


def clean_plot(text: Column | str) -> Column:
    """Plot without tab marks, romanised tabs, mostly Japanese lines and short lines that are no sentence."""
    t = F.coalesce(_col(text), F.lit(""))
    tabbed = F.regexp_replace(t, FIRST_TAB, "|-|$1=")
    bodies = F.split(tabbed, TAB_LABEL, -1)
    labels = F.concat(F.array(F.lit("")), F.regexp_extract_all(tabbed, F.lit(TAB_LABEL), F.lit(1)))
    kept = F.transform(
        F.filter(F.arrays_zip(labels.alias("label"), bodies.alias("body")), lambda p: ~F.lower(p["label"]).contains("romaji")),
        lambda p: p["body"],
    )
    t = F.when(t.contains("|-|"), F.array_join(kept, "\n")).otherwise(t)

    def wanted(line: Column) -> Column:
        japanese = F.length(line) - F.length(F.regexp_replace(line, JAPANESE, ""))
        solid = F.length(F.regexp_replace(line, r"(?U)\s", ""))
        # each Japanese letter takes three bytes: a line of single bytes has none
        wide = F.octet_length(line) > F.length(line)
        is_short = ~at_least(line, SHORT_LINE) & ~line.rlike("(?U)" + SENTENCE_END)
        return ~(wide & (japanese > solid * JAPANESE_SHARE)) & ~is_short

    return F.array_join(F.filter(F.transform(F.split(t, "\n", -1), strip), wanted), "\n")


def paragraphs(text: Column | str, target: int = PARAGRAPH_TARGET) -> Column:
    """Paragraphs packed in order into pieces of about ``target`` characters; overlong ones are cut at sentence ends."""
    parts = F.filter(F.transform(F.split(_col(text), r"\n+", -1), strip), lambda p: p != "")
    parts = F.flatten(
        F.transform(
            parts,
            lambda p: F.when(~at_least(p, 2 * target + 1), F.array(p)).otherwise(
                F.filter(F.split(p, r"(?U)(?<=[.!?])\s+", -1), lambda x: x != "")
            ),
        )
    )

    # parts have no space at their ends, so the piece that grows needs no trimming; it is counted by its parts and joined when full
    sized = F.transform(parts, lambda p: F.struct(p.alias("text"), F.length(p).alias("size")))
    none = F.array().cast("array<string>")
    empty = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("size"))

    def pack(state: Column, part: Column) -> Column:
        def step(full: Column) -> Column:
            begins = full | (state["size"] == 0)
            return F.struct(
                F.when(full, F.array_append(state["done"], F.array_join(state["open"], "\n"))).otherwise(state["done"]).alias("done"),
                F.when(begins, F.array(part["text"])).otherwise(F.array_append(state["open"], part["text"])).alias("open"),
                F.when(begins, part["size"]).otherwise(state["size"] + 1 + part["size"]).alias("size"),
            )

        return step((state["size"] > 0) & (state["size"] + part["size"] > target))

    return F.aggregate(
        sized,
        empty,
        pack,
        lambda s: F.when(s["size"] > 0, F.array_append(s["done"], F.array_join(s["open"], "\n"))).otherwise(s["done"]),
    )


def sentences(text: Column | str) -> Column:
    """Sentences of every line, cut after the end mark and any closing quotes."""
    lines = F.filter(F.transform(F.split(_col(text), "\n", -1), strip), lambda p: p != "")
    cut = F.flatten(F.transform(lines, lambda p: F.split(p, "(?U)" + SENTENCE_GAP, -1)))
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def fixed_pieces(text: Column | str, size: int = PARAGRAPH_TARGET) -> Column:
    def cut(flat: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(flat) - 1), F.lit(size))
        return F.when(flat == "", F.array().cast("array<string>")).otherwise(
            F.transform(starts, lambda i: F.substring(flat, i + 1, F.lit(size)))
        )

    return let(strip(F.regexp_replace(_col(text), r"(?U)\s+", " ")), cut)


def overlapping_pieces(pieces: Column) -> Column:
    """Each piece with the last sentence of the piece before and the first sentence of the piece after."""

    def edges(p: Column) -> Column:
        return let(
            sentences(p),
            lambda s: F.struct(
                p.alias("text"),
                F.try_element_at(s, F.lit(1)).alias("first"),
                F.try_element_at(s, F.lit(-1)).alias("last"),
            ),
        )

    def join(cut: Column) -> Column:
        around = F.transform(
            cut,
            lambda p, i: F.array(
                F.when(i > 0, F.get(cut, i - 1)["last"]), p["text"], F.get(cut, i + 1)["first"]
            ),
        )
        return F.transform(around, lambda xs: F.array_join(F.filter(xs, lambda x: x.isNotNull() & (x != "")), "\n"))

    return let(F.transform(pieces, edges), join)


def norm_title(title: Column | str) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(_col(title), F.lit(""))), r"\((?:episode|anime)\)", "")
    return F.regexp_replace(t, r"[^a-z0-9]+", "")


def norm_name(text: Column | str) -> Column:
    """Lower case without anything that is not a letter or digit of some script."""
    return F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"(?U)[\W_]+", "")


def name_key(name: Column | str) -> Column:
    """Order- and accent-insensitive key: sorted ASCII words."""
    return name_key_of_ascii(ascii_fold(_col(name)))


def name_key_of_ascii(plain: Column) -> Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(plain), F.lit(r"[a-z0-9]+"), F.lit(0))), " ")


def _without_season(title: Column) -> Column:
    plain = F.regexp_replace(F.lower(ascii_fold(title)), r"\(.*?\)", " ")
    return F.regexp_replace(plain, "(?i)" + SEASON_WORDS, "")


def title_key(title: Column | str) -> Column:
    return F.regexp_replace(_without_season(_col(title)), r"[^a-z0-9]+", "")


def wiki_slugs(titles: Column, most: int | None = None) -> Column:
    """Address guesses for an array of titles, the first ``most`` of them; None keeps all."""

    def of_part(part: Column) -> Column:
        words = F.regexp_extract_all(part, F.lit(r"[a-z0-9]+"), F.lit(0))
        joined = F.array_join(words, "")
        short = F.array_join(F.slice(words, 1, 2), "")
        return F.concat(
            F.when(F.length(joined) >= 4, F.array(F.array_join(words, "-"), joined)).otherwise(F.array()),
            F.when((F.size(words) > 2) & (F.length(short) >= 5), F.array(short)).otherwise(F.array()),
        )

    def of_title(plain: Column) -> Column:
        return F.flatten(F.transform(F.array_distinct(F.array(plain, F.element_at(F.split(plain, ":| - ", -1), 1))), of_part))

    # letter folding runs once over the joined titles, a Python function cannot run inside a higher-order function
    plain = F.split(ascii_fold(F.array_join(titles, "\u0001", "")), "\u0001", -1)
    cleaned = F.transform(
        plain, lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), r"\(.*?\)", " "), "(?i)" + SEASON_WORDS, "")
    )
    slugs = F.array_distinct(F.flatten(F.transform(cleaned, of_title)))
    return slugs if most is None else F.slice(slugs, 1, most)


def same_title(a: Column, normalised: Column) -> Column:
    """Equal, or one inside the other with at least five characters each."""
    x, y = norm_title(a), F.coalesce(normalised, F.lit(""))
    inside = (F.least(F.length(x), F.length(y)) >= 5) & (x.contains(y) | y.contains(x))
    return (x != "") & (y != "") & ((x == y) | inside)


def source_id(urls: Column, host: str) -> Column:
    """Number at the end of the first address of ``host``; NULL when that address ends otherwise."""
    first = F.get(F.filter(urls, lambda u: u.contains(host)), F.lit(0))
    return F.regexp_extract(first, r"(?:^|/)(\d+)/*$", 1).try_cast("bigint")


def image_url(path: Column | str, size: str) -> Column:
    p = _col(path)
    # Fixed value: the image host of the episode source.
    return F.when(p.isNotNull() & (p != ""), F.concat(F.lit(f"https://image.tmdb.org/t/p/{size}"), p))


def names_of(items: Column) -> Column:
    named = F.filter(items, lambda x: x["name"].isNotNull() & (x["name"] != ""))
    return F.coalesce(F.transform(named, lambda x: x["name"]), F.array().cast("array<string>"))


def first_present(values: Column, keys: tuple[str, ...]) -> Column:
    """Value of the first key of the list that is present and not empty in a map."""
    return F.coalesce(*[F.nullif(values[k], F.lit("")) for k in keys])


def is_prose(text: Column, at_least: int = 500) -> Column:
    stops = (F.length(text) - F.length(F.replace(text, F.lit(". "), F.lit("")))) / 2
    return (F.length(text) >= at_least) & (stops >= 3)


def as_date(text: Column | str) -> Column:
    """ISO date at the start of a string, NULL otherwise."""
    head = F.substring(_col(text), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def host_matches(url: Column | str, host: str) -> Column:
    name = F.try_parse_url(_col(url), F.lit("HOST"))
    return F.coalesce((name == host) | name.endswith("." + host), F.lit(False))


def episode_label(season: Column, number: Column, abs_ep: Column, title: Column) -> Column:
    # Fixed format of an episode label.
    lead = F.when(F.coalesce(season, F.lit(0)) != 0, F.format_string("%d기 %d화 ", season, number)).otherwise(F.lit(""))
    tail = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(" 〈"), title, F.lit("〉"))).otherwise(F.lit(""))
    return F.concat(lead, F.format_string("(전체 %d화)", abs_ep), tail)
