"""Wiki markup: templates are read by a small balanced-brace helper, everything else is column expressions.

Nested braces are not a regular language, so finding them is the one step that needs Python; it returns the templates and
the text without them, and Spark does the rest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from episodika.functions.dates import infobox_dates
from episodika.functions.text import PLACEHOLDER, first_present, full_match, is_prose, let, replace_marked, strip

# ---- Fixed values: patterns and key lists ---------------------------------------------------------------------------
INLINE = r"nihongo\d?|nihongo[ -]?(?:title|foot)|tt|tooltip|w|wp|wikipedia|lang|ruby|abbr|small|big|nowrap|c|color"
SHOWS_LAST = r"lang|color|c"
SCROLL = r"scroll ?box|scroll"
PLOT = r"(?i)plot|summ[ae]ry|syn?[oy]?p[no]?sis|overview|story|recap"
NOT_PLOT = (
    r"(?i)trivia|note|differ|reference|gallery|character|cast|credit|music|navigat|quote|staff|appearance|see also|"
    r"external|link|source|song|soundtrack|video|image|screenshot|error|goof|mistake|production|reception|release|"
    r"home media|dvd|preview|broadcast|rating|voice|change|adapt|comparison|censor|spell|item|jutsu|technique|battle|"
    r"event|location|omake|script|transcript|chronolog"
)
EVENT = r"(?i)event|battle|fight"
PART = r"(?i)^(part|segment|skit|scene|story|featured duel)\b"
CAST = r"(?i)characters?|appearances?"
SPAN = r"(?i)episodes?\s*(\d{1,4})\s*[-–~]\s*(\d{1,4})"
YEAR = r"\b(19|20)\d\d\b"
EPISODE_KEYS = (
    "number (overall)", "overall", "ep number", "episode number", "episode_number", "episodenumber", "epnum", "ep_num",
    "ep num", "episode", "number", "#", "ep", "no",
)
TITLE_KEYS = ("ep title", "episode title", "name of episode", "name", "title", "en title", "translation", "english")
CHAPTER_KEYS = (
    "adapted from", "adaptedfrom", "adapted", "adaptation", "manga chapters", "chapters", "chapter", "manga",
)
SEASON_KEYS = ("season", "partofseason", "season number", "seriesname", "series")
EPISODE_BOX_FIELD = r"(?i)air|date|prev|next|episode|kanji|romaji|japanese"
SKIPPED_BOX = (
    r"(?i)quote|nihongo|tabs?\b|theme|disambig|for\b|redirect|stub|spoiler|main\b|see also|navbox|navigation|"
    r"translation|ruby|color|scroll|cleanup|delete|icon"
)
KINDS = (
    ("episode", r"episode|\bep\b"),
    ("chapter", r"chapter|volume|\bbook\b|novel|manga"),
    ("music", r"song|music|album|\bost\b|soundtrack|opening|ending"),
    ("person", r"staff|actor|actress|seiyu|voice|\bcast\b|author|real|people"),
    ("arc", r"\barc\b|saga"),
    ("media", r"game|movie|film|\bova\b|dvd|blu-?ray|merch|anime|series|stage|event"),
    ("character", r"character|chara|\bchar\b|individual|person|human|demon|titan|hero|villain"),
    ("ability", r"abilit|technique|quirk|jutsu|magic|spell|power|skill|fruit|\bnen\b|breathing|curse|stand|move"),
    ("item", r"item|weapon|object|tool|equipment|artifact|vehicle|ship|sword|food"),
    ("location", r"location|place|city|country|island|village|world|town|planet|building|kingdom"),
    ("group", r"organi[sz]ation|group|team|clan|guild|squad|family|crew|affiliation|school|race|species|faction"),
)
MIN_WIKITEXT, MIN_PLOT, MIN_PART, MIN_ANY = 200, 500, 100, 40
# -----------------------------------------------------------------------------------------------------------------------



@dataclass(frozen=True)
class Limits:
    """Longest section text, infobox field and note in characters, most links and cast members; None keeps all."""

    section: int | None = None
    field: int | None = None
    note: int | None = None
    links: int | None = None
    cast: int | None = None


NO_LIMITS = Limits()


def _cut(value: Column, limit: int | None) -> Column:
    return value if limit is None else F.substring(value, 1, limit)


def _first(values: Column, limit: int | None) -> Column:
    return values if limit is None else F.slice(values, 1, limit)


_INLINE = re.compile(rf"\{{\{{\s*({INLINE}|{SCROLL})\s*\|([^{{}}]*)\}}\}}", re.I)
_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]")
_MEDIA = re.compile(r"\s*(file|image|category):", re.I)


def _show(match: re.Match) -> str:
    """What a display template shows: its first unnamed value, its last for some, the longest of a scroll box."""
    name = match.group(1).strip().lower()
    values = [v for v in re.split(r"\|(?![^\[]*\]\])", match.group(2))]
    if re.fullmatch(SCROLL, name):
        return max((v.partition("=")[2] if re.match(r"\s*\w+\s*=", v) else v for v in values), key=len, default="")
    shown = [v.strip() for v in values if v.strip() and not re.match(r"\s*[\w ]+=", v)]
    return (shown[-1] if re.fullmatch(SHOWS_LAST, name) else shown[0]) if shown else ""


def _spans(text: str, opener: str):
    """Top-level ``{{…}}`` or ``[[…]]`` spans; unbalanced marks are left alone."""
    stack: list[tuple[str, int]] = []
    for mark in _MARK.finditer(text):
        token = mark.group()
        if token in ("{{", "[["):
            stack.append((token, mark.start()))
        elif stack and stack[-1][0] == ("{{" if token == "}}" else "[["):
            kind, start = stack.pop()
            if kind == opener and not any(k == opener for k, _ in stack):
                yield start, mark.end()


def _fields(inner: str) -> list[str]:
    """Splits template content at its own bars, not at those of nested templates or links."""
    depth, last, out = 0, 0, []
    for mark in re.finditer(r"\{\{|\[\[|\}\}|\]\]|\|", inner):
        token = mark.group()
        if token == "|" and depth == 0:
            out.append(inner[last : mark.start()])
            last = mark.end()
        elif token != "|":
            depth = max(0, depth + (1 if token in ("{{", "[[") else -1))
    return out + [inner[last:]]


def _read(text: str, unwrap: bool) -> dict:
    shown = None
    while shown != text:
        shown, text = text, _INLINE.sub(_show, text)
    for start, end in reversed(list(_spans(text, "[["))):
        if _MEDIA.match(text, start + 2):
            text = text[:start] + text[end:]
    templates, rest, last = [], [], 0
    for start, end in _spans(text, "{{"):
        name, *params = _fields(text[start + 2 : end - 2])
        fields = {}
        for i, param in enumerate(params, 1):
            key, eq, value = param.partition("=")
            fields[key.strip().lower() if eq else str(i)] = value if eq else param
        name = name.strip().lower().replace("_", " ")
        templates.append({"name": name, "fields": list(fields.items()), "n": len(params)})
        prose = [] if not unwrap or re.search("quote|list|table", name) else [
            v.strip() for k, v in fields.items() if not re.search(NOT_PLOT, k) and len(v.strip()) >= 300 and v.count(". ") >= 3
        ]
        rest += [text[last:start], "\n" + "\n\n".join(prose) + "\n" if prose else ""]
        last = end
    return {"templates": templates, "rest": "".join(rest) + text[last:]}


_TEMPLATE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("n", T.IntegerType()),
    ]
)
_PAGE = T.StructType([T.StructField("templates", T.ArrayType(_TEMPLATE)), T.StructField("rest", T.StringType())])
_PAGE_ARROW = pa.struct(
    [
        ("templates", pa.list_(pa.struct([("name", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("n", pa.int32())]))),
        ("rest", pa.string()),
    ]
)


@F.arrow_udf(_PAGE)
def _read_page(text: pa.Array) -> pa.Array:
    return pa.array([_read(v or "", False) for v in text.to_pylist()], _PAGE_ARROW)


@F.arrow_udf(_PAGE)
def _read_page_unwrapped(text: pa.Array) -> pa.Array:
    return pa.array([_read(v or "", True) for v in text.to_pylist()], _PAGE_ARROW)


def _prepared(wikitext: Column) -> Column:
    t = wikitext
    for marks, pattern, new in (
        (("<g", "<G"), r"(?is)<gallery.*?</gallery>", ""),
        (("<r", "<R"), r"(?is)<ref[^>]*/>|<ref.*?</ref>", ""),
        (("<!--",), r"(?s)<!--.*?-->", ""),
        (("<b", "<B"), r"(?i)<br\s*/?>", " ⏎ "),
    ):
        t = replace_marked(t, marks, pattern, new)
    return t


def plain(text: Column) -> Column:
    """Shown text of markup without templates."""
    t = text
    # each pattern with what a text must hold for it to match
    for marks, pattern, new in (
        (("{{",), r"\{\{[^{}]*\}\}", ""),
        (("{|",), r"(?s)\{\|.*?\|\}", ""),
        (("[[",), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"),
        (("[//", "[http"), r"\[(?:https?:)?//[^\s\]]*\s*([^\]]*)\]", "$1"),
        (("''",), r"'{2,}", ""),
        (("<",), r"</?[A-Za-z][^>\n]*>", ""),
        (("==",), r"(?m)^={2,}[^=\n].*?={2,}[ \t]*$", ""),
        (("*", "#", ":", ";"), r"(?m)^[*#:;]+", ""),
    ):
        t = replace_marked(t, marks, pattern, new)
    return t


def section_text(text: Column) -> Column:
    t = replace_marked(plain(text), ("⏎",), r"[ \t]*⏎[ \t]*", "\n")
    t = replace_marked(t, (",", ";", ":"), r"(?m)^[ \t]*[,;:][ \t]*", "")
    return strip(replace_marked(t, ("\n\n\n",), r"\n{3,}", "\n\n"))


def field_text(value: Column, limit: int | None = None) -> Column:
    t = F.regexp_replace(F.replace(plain(value), F.lit("⏎"), F.lit(",")), r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"(?:\s*,)+", ",")
    return _cut(F.regexp_replace(t, r"^[ ,]+|[ ,]+$", ""), limit)


def section_links(text: Column) -> Column:
    none = F.array().cast("array<string>")
    linked = F.when(text.contains("[["), F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]*)"), F.lit(1))).otherwise(none)
    found = F.transform(linked, strip)
    return F.array_distinct(F.filter(found, lambda x: (x != "") & ~x.contains(":")))


def sections(rest: Column) -> Column:
    """Second-level sections in order: title, text, links; what comes before the first is ``_lead``."""
    heading = r"(?m)^==([^=\n][^\n]*?)==[ \t]*$"

    def build(s: Column) -> Column:
        titles = F.concat(F.array(F.lit("_lead")), F.transform(s["titles"], lambda x: strip(plain(x))))
        return F.transform(
            s["bodies"],
            lambda body, i: F.struct(
                F.get(titles, i).alias("title"), section_text(body).alias("text"), section_links(body).alias("links")
            ),
        )

    return let(
        F.struct(
            F.regexp_extract_all(rest, F.lit(heading), F.lit(1)).alias("titles"), F.split(rest, heading, -1).alias("bodies")
        ),
        build,
    )


def _kind_of(name: Column) -> Column:
    kind = F.lit(None).cast("string")
    for label, pattern in reversed(KINDS):
        kind = F.when(name.rlike("(?i)" + pattern), label).otherwise(kind)
    return kind


def _is_episode_box(t: Column) -> Column:
    telling = F.size(F.filter(F.map_keys(t["fields"]), lambda k: k.rlike(EPISODE_BOX_FIELD)))
    return t["name"].contains("infobox") | t["name"].contains("episode") | (telling >= 2)


def _is_any_box(t: Column) -> Column:
    return ~t["name"].rlike(SKIPPED_BOX) & (
        t["name"].contains("infobox") | t["name"].contains("box") | (t["n"] >= 5) | _kind_of(t["name"]).isNotNull()
    )


def _box(page: Column, test) -> Column:
    return F.get(F.filter(page["templates"], lambda t: (t["n"] >= 3) & test(t)), F.lit(0))


def _infobox(box: Column, limits: Limits) -> Column:
    none = F.create_map().cast("map<string,string>")
    return F.coalesce(F.transform_values(box["fields"], lambda k, v: field_text(v, limits.field)), none)


def parse_page(wikitext: Column, limits: Limits = NO_LIMITS) -> Column:
    """Any page: kind, infobox name and fields, section texts, links. Very short pages are stubs."""
    text = F.coalesce(wikitext, F.lit(""))
    page = _read_page(_prepared(text))

    def build(p: Column) -> Column:
        box = _box(p, _is_any_box)

        def with_sections(s: Column) -> Column:
            told = F.filter(s, lambda x: (x["text"] != "") & (F.length(text) >= MIN_WIKITEXT))
            return F.struct(
                F.when(F.length(text) < MIN_WIKITEXT, "stub").otherwise(F.coalesce(_kind_of(box["name"]), F.lit("other"))).alias("kind"),
                box["name"].alias("infobox_name"),
                _infobox(box, limits).alias("infobox"),
                F.transform(
                    told, lambda x: F.struct(x["title"].alias("title"), _cut(x["text"], limits.section).alias("text"))
                ).alias("sections"),
                _first(F.array_distinct(F.flatten(F.transform(s, lambda x: x["links"]))), limits.links).alias("links"),
            )

        return let(sections(p["rest"]), with_sections)

    return let(page, build)


def parse_episode(wikitext: Column, limits: Limits = NO_LIMITS) -> Column:
    """Episode page: number, dates, season, title, arc, chapters, plot, short synopsis, span and cast."""
    page = _read_page_unwrapped(_prepared(F.coalesce(wikitext, F.lit(""))))
    return let(page, lambda p: let(F.struct(_infobox(_box(p, _is_episode_box), limits).alias("box"), sections(p["rest"]).alias("s")), lambda e: _episode(e, limits)))


def _episode(e: Column, limits: Limits) -> Column:
    box, s = e["box"], e["s"]
    by_length = lambda a, b: F.length(b) - F.length(a)
    named = F.array_sort(
        F.transform(F.filter(s, lambda x: x["title"].rlike(PLOT) & (x["text"] != "")), lambda x: x["text"]), by_length
    )
    pieces = F.filter(
        s,
        lambda x: (x["title"] != "_lead") & (x["text"] != "")
        & (x["title"].rlike(PLOT) | x["title"].rlike(PART) | (~x["title"].rlike(NOT_PLOT) & (F.length(x["text"]) >= MIN_PART))),
    )
    lead = F.coalesce(F.get(F.filter(s, lambda x: x["title"] == "_lead"), F.lit(0))["text"], F.lit(""))

    def choose(c: Column) -> Column:
        longest = F.coalesce(F.length(F.get(c["named"], F.lit(0))), F.lit(0))
        found = F.when(is_prose(c["lead"]) & (F.length(c["lead"]) > F.length(c["joined"])), c["lead"]).otherwise(c["joined"])
        better = (longest < MIN_PLOT) & (F.length(found) >= MIN_ANY) & (F.length(found) > longest)
        plots = F.when(better, F.array(found)).otherwise(c["named"])
        return F.filter(plots, lambda x: ~full_match(strip(x), PLACEHOLDER))

    joined = F.array_join(F.transform(pieces, lambda x: x["text"]), "\n\n")
    plots = let(F.struct(named.alias("named"), joined.alias("joined"), lead.alias("lead")), choose)
    events = F.transform(
        F.filter(s, lambda x: x["title"].rlike(EVENT) & (x["text"] != "")),
        lambda x: F.concat(x["title"], F.lit(": "), F.regexp_replace(x["text"], r"\s*\n\s*", "; ")),
    )
    note = _cut(F.array_join(F.filter(F.concat(F.array(lead), events), lambda x: x != ""), "\n"), limits.note)
    note = F.when(F.length(note) >= MIN_ANY, note).otherwise("")
    numbers = [F.nullif(F.regexp_extract(F.coalesce(box[k], F.lit("")), r"^\D{0,10}(\d{1,4})\D{0,3}$", 1), F.lit("")) for k in EPISODE_KEYS]
    dated = lambda k: F.when(~box[k].rlike(YEAR), F.nullif(box[k], F.lit("")))

    def span(k: str) -> Column:
        # numbers are read where there are some: an empty text costs a caught error in each cast
        first, last = (F.regexp_extract(box[k], SPAN, g).cast("int") for g in (1, 2))
        return F.when(box[k].rlike(SPAN), F.when((last - first).between(1, 9), last - first + 1))

    cast = F.filter(s, lambda x: x["title"].rlike(CAST))
    in_order = F.filter(cast, lambda x: x["title"].rlike("(?i)order"))
    listed = F.coalesce(F.get(in_order, F.lit(0)), F.get(cast, F.lit(0)))
    return let(
        plots,
        lambda p: F.struct(
            box.alias("infobox"),
            F.coalesce(*numbers).cast("int").alias("episode_no"),
            infobox_dates(box).alias("airdates"),
            F.coalesce(F.lower(first_present(box, SEASON_KEYS)), F.lit("")).alias("season"),
            F.coalesce(*[dated(k) for k in TITLE_KEYS]).alias("title"),
            F.nullif(box["arc"], F.lit("")).alias("arc"),
            first_present(box, CHAPTER_KEYS).alias("chapters"),
            F.coalesce(F.get(p, F.lit(0)), F.lit("")).alias("plot"),
            F.when(F.size(p) > 1, F.element_at(p, -1)).when(F.size(p) == 0, note).otherwise("").alias("synopsis"),
            F.coalesce(*[span(k) for k in EPISODE_KEYS], F.lit(1)).alias("span"),
            F.coalesce(_first(listed["links"], limits.cast), F.array().cast("array<string>")).alias("characters"),
        ),
    )
