"""Text functions over whole documents, pages, conversations and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodika.functions import dates, dialogue, ground, text as t
from episodika.operators.dedup import digest, keep_one
from episodika.plans.derived import documents, pages, spread, table, text_of
from episodika.plans.registry.base import query
from episodika.plans.tidy import tidy


# ---- the same steps as SQL text -------------------------------------------------------------------------------------
def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_chain(x: str, steps) -> str:
    for pattern, new, flags in steps:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g{flags}')"
    return x


def sql_clean_html(x: str) -> str:
    x = sql_chain(x, [("~!.*?!~", " ", "s"), (r"<br\s*/?>", "\n", ""), ("<[^>]+>", " ", "")])
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        x = f"replace({x}, '{name}', '{char}')"
    x = sql_chain(x, [("&amp;?", "&", ""), (r"\n\s*\n+", "\n\n", ""), (r"[ \t]+", " ", "")])
    return sql_strip(x)


def sql_clean_markup(x: str) -> str:
    x = sql_chain(x, [("~!.*?!~", " ", "s")])
    x = f"replace(replace({x}, '~!', ' '), '!~', ' ')"
    x = sql_chain(
        x,
        [
            (r"!?\[([^\]\n]*)\]\((?:https?://|/)[^)\s]*\)", r"\1", ""),
            (r"<ref[^>]*/>|<ref.*?</ref>|</?[a-z][^>\n]{0,80}>", " ", "si"),
            (r"\{\{[^{}]*\}\}", " ", ""),
            (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", ""),
            (r"\{\{|\}\}|\[\[|\]\]|''{2,}|__|\*\*", "", ""),
            (r"(?m)^[ \t]*[,;:][ \t]*", "", ""),
            (r"[ \t]+", " ", ""),
            (r"\n\s*\n+", "\n", ""),
        ],
    )
    return sql_strip(x)


PLACEHOLDER_SQL = t.PLACEHOLDER.replace("'", "''")
EPISODE_SQL = t.EPISODE_NAME


def sql_is_placeholder(x: str) -> str:
    return f"regexp_full_match({sql_strip(x)}, '{PLACEHOLDER_SQL}', 'si')"


def sql_clean_plot(x: str) -> str:
    lines = f"list_transform(string_split({x}, chr(10)), lambda l: {sql_strip('l')})"
    return rf"""array_to_string(list_filter({lines}, lambda l:
      NOT (length(l) - length(regexp_replace(l, '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}]', '', 'g'))
           > length(regexp_replace(l, '\s', '', 'g')) * 0.3)
      AND NOT (length(l) < 50 AND NOT regexp_matches(l, '[.!?…][\s"''”’)\]]*$'))), chr(10))"""


def sql_paragraphs(x: str, target: int = 700) -> str:
    parts = f"list_filter(list_transform(string_split_regex({x}, '\\n+'), lambda p: {sql_strip('p')}), lambda p: p <> '')"
    cut = (
        f"flatten(list_transform({parts}, lambda p: CASE WHEN length(p) <= {2 * target} THEN [p] ELSE "
        r"list_filter(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: y <> '') END))"
    )
    return f"""list_filter(string_split(list_reduce({cut}, lambda acc, p:
      struct_pack(done := CASE WHEN acc.buf <> '' AND length(acc.buf) + length(p) > {target} THEN acc.done || acc.buf || chr(2) ELSE acc.done END,
                  buf := CASE WHEN acc.buf = '' OR length(acc.buf) + length(p) > {target} THEN p
                              ELSE acc.buf || chr(10) || p END),
      struct_pack(done := '', buf := '')).done || chr(2) || list_reduce({cut}, lambda acc, p:
      struct_pack(buf := CASE WHEN acc.buf = '' OR length(acc.buf) + length(p) > {target} THEN p
                              ELSE acc.buf || chr(10) || p END),
      struct_pack(buf := '')).buf, chr(2)), lambda y: y <> '')"""


def sql_sentences(x: str) -> str:
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda p: {sql_strip('p')}), lambda p: p <> '')"
    gap = r"""([.!?])["''”’)\]]*\s+"""
    cut = rf"flatten(list_transform({lines}, lambda p: string_split(regexp_replace(p, '{gap}', '\1' || chr(1), 'g'), chr(1))))"
    return f"list_filter(list_transform({cut}, lambda s: {sql_strip('s')}), lambda s: s <> '')"


# ---- cleaning -------------------------------------------------------------------------------------------------------
@query("clean_html", f"SELECT page_id, length(x) AS n, md5(x) AS digest FROM (SELECT page_id, {sql_clean_html('html')} AS x FROM pages)")
def clean_html(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", t.clean_html("html").alias("x"))
    return rows.select("page_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


MARKED_SQL = """marked AS (SELECT doc_id, lang,
   replace(replace(replace(text, '. ', '. [[Target page|shown]] {{note|a=b}} ''''''bold'''''' '),
     ', ', ' ~!hidden' || chr(10) || 'part!~, [label](https://example.org/x?y=1) <ref name="r">cited</ref> '),
     chr(10), chr(10) || ' ; ' || chr(10) || chr(10) || '<i class="x">') AS m FROM documents)"""


def marked(spark, sf_dir):
    m = F.col("text")
    for old, new in (
        (". ", ". [[Target page|shown]] {{note|a=b}} '''bold''' "),
        (", ", ' ~!hidden\npart!~, [label](https://example.org/x?y=1) <ref name="r">cited</ref> '),
        ("\n", '\n ; \n\n<i class="x">'),
    ):
        m = F.replace(m, F.lit(old), F.lit(new))
    return documents(spark, sf_dir).select("doc_id", "lang", m.alias("m"))


@query("clean_markup", f"WITH {MARKED_SQL} SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, {sql_clean_markup('m')} AS x FROM marked)")
def clean_markup(spark, sf_dir):
    rows = marked(spark, sf_dir).select("doc_id", t.clean_markup("m").alias("x"))
    return rows.select("doc_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


LINES_SQL = """lines AS (SELECT doc_id, i, CASE WHEN length(l) < 6 THEN 'TBA.' WHEN length(l) < 12 THEN ' Episode ' || length(l) || ' '
   WHEN length(l) < 20 THEN 'Need translation of ' || l ELSE l END AS line
   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""


@query(
    "placeholder_filter",
    f"""WITH {LINES_SQL} SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE {sql_is_placeholder('line')}) AS placeholders,
    count(*) FILTER (WHERE regexp_full_match({sql_strip('line')}, '{EPISODE_SQL}', 'i')) AS episode_names FROM lines GROUP BY doc_id""",
)
def placeholder_filter(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l"))
    n = F.length("l")
    line = (
        F.when(n < 6, "TBA.")
        .when(n < 12, F.concat(F.lit(" Episode "), n, F.lit(" ")))
        .when(n < 20, F.concat(F.lit("Need translation of "), "l"))
        .otherwise(F.col("l"))
    )
    return lines.withColumn("line", line).groupBy("doc_id").agg(
        F.count("*").alias("lines"),
        F.count_if(t.is_placeholder(F.col("line"))).alias("placeholders"),
        F.count_if(t.is_episode_name(F.col("line"))).alias("episode_names"),
    )


TABBED_SQL = """tabbed AS (SELECT doc_id, lang, text, CASE WHEN lang = 'fr' THEN 'Japanese=日本語の説明です。' || chr(10) || '|-|Romaji title= ' || text
    || chr(10) || '|-|English (US)= ' || text WHEN lang = 'de' THEN text || chr(10) || '日本語だけの長い行です。日本語だけの長い行です。日本語だけの長い行です。' || chr(10) || 'Turn 3: Name'
    ELSE text END AS p FROM documents)"""


def tabbed(spark, sf_dir):
    ja = "日本語だけの長い行です。" * 3
    p = (
        F.when(
            F.col("lang") == "fr",
            F.concat(F.lit("Japanese=日本語の説明です。\n|-|Romaji title= "), "text", F.lit("\n|-|English (US)= "), "text"),
        )
        .when(F.col("lang") == "de", F.concat("text", F.lit(f"\n{ja}\nTurn 3: Name")))
        .otherwise(F.col("text"))
    )
    return documents(spark, sf_dir).select("doc_id", "lang", p.alias("p"))


@query(
    "clean_plot",
    f"""WITH {TABBED_SQL}, chosen AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN '日本語の説明です。' || chr(10) || chr(10) || text ELSE p END AS p FROM tabbed)
    SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, {sql_clean_plot('p')} AS x FROM chosen)""",
)
def clean_plot(spark, sf_dir):
    rows = tabbed(spark, sf_dir).select("doc_id", t.clean_plot("p").alias("x"))
    return rows.select("doc_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


# ---- splitting ------------------------------------------------------------------------------------------------------
def pieces_sql(expression: str) -> str:
    return f"""WITH p AS (SELECT doc_id, {expression} AS pieces FROM documents),
    e AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM p)
    SELECT doc_id, CAST(i AS INTEGER) AS i, length(piece) AS n, md5(piece) AS digest FROM e"""


def exploded(rows):
    rows = rows.select("doc_id", F.posexplode("pieces").alias("pos", "piece"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("i"), F.length("piece").cast("long").alias("n"), F.md5("piece").alias("digest"))


@query("chunk_paragraphs", pieces_sql(sql_paragraphs("text")))
def chunk_paragraphs(spark, sf_dir):
    return exploded(documents(spark, sf_dir).select("doc_id", t.paragraphs("text").alias("pieces")))


@query("chunk_sentences", pieces_sql(sql_sentences("text")))
def chunk_sentences(spark, sf_dir):
    return exploded(documents(spark, sf_dir).select("doc_id", t.sentences("text").alias("pieces")))


@query(
    "chunk_fixed",
    rf"""WITH f AS (SELECT doc_id, {sql_strip(r"regexp_replace(text, '\s+', ' ', 'g')")} AS flat FROM documents),
    s AS (SELECT doc_id, flat, unnest(range(0, length(flat), 700)) AS pos FROM f)
    SELECT doc_id, CAST(pos // 700 + 1 AS INTEGER) AS i, length(substr(flat, pos + 1, 700)) AS n, md5(substr(flat, pos + 1, 700)) AS digest FROM s""",
)
def chunk_fixed(spark, sf_dir):
    return exploded(documents(spark, sf_dir).select("doc_id", t.fixed_pieces("text").alias("pieces")))


@query(
    "chunk_overlap",
    f"""WITH p AS (SELECT doc_id, {sql_paragraphs('text')} AS pieces FROM documents),
    e AS (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM p),
    s AS (SELECT *, {sql_sentences('piece')} AS s FROM e),
    o AS (SELECT doc_id, i, array_to_string(list_filter([lag(s[-1]) OVER w, piece, lead(s[1]) OVER w], lambda x: x IS NOT NULL AND x <> ''), chr(10)) AS piece
          FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id, CAST(i AS INTEGER) AS i, length(piece) AS n, md5(piece) AS digest FROM o""",
)
def chunk_overlap(spark, sf_dir):
    return exploded(documents(spark, sf_dir).select("doc_id", t.overlapping_pieces(t.paragraphs("text")).alias("pieces")))


@query(
    "chunk_statistics",
    f"""WITH p AS (SELECT 'paragraph' AS method, unnest({sql_paragraphs('text')}) AS piece FROM documents
      UNION ALL SELECT 'sentence', unnest({sql_sentences('text')}) FROM documents UNION ALL SELECT 'whole', text FROM documents)
    SELECT method, count(*) AS chunks, round(avg(length(piece)), 4) AS mean_chars FROM p GROUP BY method""",
)
def chunk_statistics(spark, sf_dir):
    # every text is read and cut once, all methods come out of one pass
    cut = documents(spark, sf_dir).select(
        F.explode(
            F.create_map(
                F.lit("paragraph"), t.paragraphs("text"),
                F.lit("sentence"), t.sentences("text"),
                F.lit("whole"), F.array("text"),
            )
        ).alias("method", "pieces")
    )
    per_text = cut.select(
        "method",
        F.size("pieces").cast("long").alias("n"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + F.length(p)).alias("chars"),
    )
    totals = per_text.groupBy("method").agg(F.sum("n").alias("chunks"), F.sum("chars").alias("chars"))
    return totals.select("method", "chunks", F.round(F.col("chars") / F.col("chunks"), 4).alias("mean_chars"))


@query(
    "evidence_boundary_split",
    f"""WITH e AS (SELECT doc_id, text, substr(text, CAST(length(text) // 2 AS INTEGER) + 1, 60) AS evidence, {sql_paragraphs('text')} AS pieces FROM documents)
    SELECT doc_id, contains(text, evidence) AND len(list_filter(pieces, lambda p: contains(p, evidence))) = 0 AS split FROM e""",
)
def evidence_boundary_split(spark, sf_dir):
    evidence = F.substring(F.col("text"), F.floor(F.length("text") / 2).cast("int") + 1, F.lit(60))
    split = ground.split_over_boundary(evidence, F.col("text"), t.paragraphs("text"))
    return documents(spark, sf_dir).select("doc_id", split.alias("split"))


# ---- duplicates -----------------------------------------------------------------------------------------------------
@query(
    "dedup_keep_latest",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id // 20 DESC, doc_id) AS pick,
      min(doc_id) OVER (PARTITION BY lang, text) AS first_id FROM documents)
    SELECT doc_id, lang, source, first_id FROM r WHERE pick = 1""",
)
def dedup_keep_latest(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "lang", "source", F.col("doc_id").alias("first_id"), digest("text").alias("body"))
    better = F.struct(F.floor(F.col("doc_id") / 20), -F.col("doc_id"))
    return keep_one(d, ["lang", "body"], better, "first_id").drop("body")


TIDY_SQL = f"""raw_chunks AS (SELECT source AS series_id, doc_id AS seq, 'c' || doc_id AS chunk_id,
    CASE lang WHEN 'en' THEN 'event' WHEN 'fr' THEN 'episode' WHEN 'de' THEN 'character' ELSE 'summary' END AS type,
    CASE WHEN n_chars > 600 THEN CAST(doc_id // 20 AS INTEGER) END AS abs_ep,
    'head 〈Episode 12〉 ' || source || chr(10) || CASE WHEN n_chars < 120 THEN 'TBA' || chr(10) || 'Episode 3' ELSE text END AS text FROM documents
    UNION ALL SELECT source, doc_id + 1000000000, 'd' || doc_id, 'event', CAST(n_chars AS INTEGER), 'other head' || chr(10) || text FROM documents WHERE lang = 'en'),
cleaned AS (SELECT *, split_part(text, chr(10), 1) AS head,
    list_filter(string_split({sql_clean_markup("substr(text, length(split_part(text, chr(10), 1)) + 2)")}, chr(10)),
      lambda x: NOT {sql_is_placeholder('x')} AND NOT (type = 'episode' AND regexp_full_match({sql_strip('x')}, '{EPISODE_SQL}', 'i'))) AS ls FROM raw_chunks),
bodies AS (SELECT *, array_to_string(ls, chr(10)) AS body FROM cleaned),
kept AS (SELECT * FROM bodies WHERE type = 'summary' OR length(body) >= CASE WHEN type = 'episode' THEN 20 ELSE 50 END),
out_ AS (SELECT series_id, seq, chunk_id, type, abs_ep, CASE WHEN type = 'summary' THEN {sql_clean_markup('text')}
    ELSE regexp_replace(head, '(?i) 〈{EPISODE_SQL}〉', '', 'g') || chr(10) || body END AS text,
    CASE WHEN type IN ('summary', 'character') THEN chunk_id ELSE body END AS k FROM kept)"""


def tidy_input(spark, sf_dir):
    d = documents(spark, sf_dir)
    kind = F.when(F.col("lang") == "en", "event").when(F.col("lang") == "fr", "episode").when(F.col("lang") == "de", "character")
    body = F.when(F.col("n_chars") < 120, "TBA\nEpisode 3").otherwise(F.col("text"))
    a = d.select(
        F.col("source").alias("series_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("c"), "doc_id").alias("chunk_id"),
        kind.otherwise("summary").alias("type"),
        F.when(F.col("n_chars") > 600, F.floor(F.col("doc_id") / 20).cast("int")).alias("abs_ep"),
        F.concat(F.lit("head 〈Episode 12〉 "), "source", F.lit("\n"), body).alias("text"),
    )
    b = d.filter("lang = 'en'").select(
        F.col("source").alias("series_id"), (F.col("doc_id") + 1_000_000_000).alias("seq"),
        F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.lit("event").alias("type"), F.col("n_chars").cast("int").alias("abs_ep"),
        F.concat(F.lit("other head\n"), "text").alias("text"),
    )
    return a.unionByName(b)


@query(
    "chunk_tidying",
    f"""WITH {TIDY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, type, k ORDER BY coalesce(abs_ep, 0) DESC, seq) AS pick,
      min(seq) OVER (PARTITION BY series_id, type, k) AS first_seq FROM out_)
    SELECT chunk_id, type, abs_ep, first_seq AS seq, md5(text) AS digest FROM r WHERE pick = 1""",
)
def chunk_tidying(spark, sf_dir):
    return tidy(tidy_input(spark, sf_dir)).select("chunk_id", "type", "abs_ep", "seq", F.md5("text").alias("digest"))


# ---- names, titles, addresses ---------------------------------------------------------------------------------------
FOLD_SQL = r"regexp_replace(strip_accents(lower({x})), '[^\x00-\x7F]', '', 'g')"


@query(
    "name_normalisation",
    rf"""WITH n AS (SELECT conv_id, turn, text AS x FROM conversations)
    SELECT conv_id, turn, md5(regexp_replace(regexp_replace(lower(x), '\((?:episode|anime)\)', '', 'g'), '[^a-z0-9]+', '', 'g')) AS title_norm,
      md5(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')) AS name_norm,
      md5(array_to_string(list_sort(regexp_extract_all({FOLD_SQL.format(x='x')}, '[a-z0-9]+')), ' ')) AS name_key
    FROM n""",
)
def name_normalisation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn",
        F.md5(t.norm_title("text")).alias("title_norm"), F.md5(t.norm_name("text")).alias("name_norm"),
        F.md5(t.name_key("text")).alias("name_key"),
    )


TITLES_SQL = """titles AS (SELECT p_partkey, p_name || ' ' || p_type || CASE WHEN p_size < 10 THEN ' 2nd Season' WHEN p_size < 20 THEN ': Part ' || p_size
   WHEN p_size < 30 THEN ' (TV) - Extra' ELSE ' III' END AS title FROM part)"""


def titles(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tail = (
        F.when(F.col("p_size") < 10, " 2nd Season")
        .when(F.col("p_size") < 20, F.concat(F.lit(": Part "), "p_size"))
        .when(F.col("p_size") < 30, " (TV) - Extra")
        .otherwise(" III")
    )
    return p.select("p_partkey", F.concat("p_name", F.lit(" "), "p_type", tail).alias("title"))


SEASONLESS_SQL = r"regexp_replace(regexp_replace(lower(title), '\(.*?\)', ' ', 'g'), '(?i)" + t.SEASON_WORDS + "', '', 'g')"


@query("title_keys", f"WITH {TITLES_SQL} SELECT p_partkey, regexp_replace({SEASONLESS_SQL}, '[^a-z0-9]+', '', 'g') AS title_key FROM titles")
def title_keys(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", t.title_key("title").alias("title_key"))


@query(
    "wiki_address_guesses",
    f"""WITH {TITLES_SQL}, c AS (SELECT p_partkey, {SEASONLESS_SQL} AS plain FROM titles),
    parts AS (SELECT p_partkey, 1 AS o, plain AS part FROM c UNION ALL
              SELECT p_partkey, 2, string_split_regex(plain, ':| - ')[1] FROM c WHERE string_split_regex(plain, ':| - ')[1] <> plain),
    w AS (SELECT p_partkey, o, regexp_extract_all(part, '[a-z0-9]+') AS ws FROM parts),
    g AS (SELECT p_partkey, o, 1 AS j, array_to_string(ws, '-') AS slug FROM w WHERE length(array_to_string(ws, '')) >= 4
      UNION ALL SELECT p_partkey, o, 2, array_to_string(ws, '') FROM w WHERE length(array_to_string(ws, '')) >= 4
      UNION ALL SELECT p_partkey, o, 3, array_to_string(ws[1:2], '') FROM w WHERE len(ws) > 2 AND length(array_to_string(ws[1:2], '')) >= 5),
    d AS (SELECT p_partkey, slug, min(o * 10 + j) AS place FROM g GROUP BY 1, 2)
    SELECT p_partkey, string_agg(slug, ' ' ORDER BY place) AS slugs FROM d GROUP BY 1""",
)
def wiki_address_guesses(spark, sf_dir):
    rows = titles(spark, sf_dir).select("p_partkey", t.wiki_slugs(F.array("title")).alias("s"))
    return rows.filter(F.size("s") > 0).select("p_partkey", F.array_join("s", " ").alias("slugs"))


@query(
    "same_title_pairs",
    """WITH a AS (SELECT p_partkey, p_name AS t, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS x,
       regexp_replace(lower(CASE WHEN p_size < 20 THEN p_name ELSE split_part(p_name, ' ', 2) END || CASE WHEN p_size > 30 THEN '!' ELSE '' END), '[^a-z0-9]+', '', 'g') AS y FROM part)
    SELECT p_partkey, x <> '' AND y <> '' AND (x = y OR (least(length(x), length(y)) >= 5 AND (contains(x, y) OR contains(y, x)))) AS same FROM a""",
)
def same_title_pairs(spark, sf_dir):
    other = F.concat(
        F.when(F.col("p_size") < 20, F.col("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2))),
        F.when(F.col("p_size") > 30, "!").otherwise(""),
    )
    return table(spark, sf_dir, "part").select("p_partkey", t.same_title(F.col("p_name"), t.norm_title(other)).alias("same"))


@query(
    "address_fields",
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
      coalesce(regexp_extract(url, '^https?://([^/?#:]+)', 1) = 'example.com' OR regexp_extract(url, '^https?://([^/?#:]+)', 1) LIKE '%.example.com', FALSE) AS on_host,
      CAST(nullif(regexp_extract(url, '/(\d+)/*$', 1), '') AS BIGINT) AS tail_id,
      replace(substr(url, strpos(url, '/') + 2), '_', ' ') AS page_title,
      CASE WHEN length(html) > 2000 THEN 'https://image.tmdb.org/t/p/w300/' || page_id END AS image FROM pages""",
)
def address_fields(spark, sf_dir):
    url = F.col("url")
    path = F.when(F.length("html") > 2000, F.concat(F.lit("/"), "page_id"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract(url, r"^https?://([^/?#]+)", 1).alias("host"),
        t.host_matches(url, "example.com").alias("on_host"),
        t.source_id(F.array(url), "example").alias("tail_id"),
        F.replace(F.split_part(url, F.lit("//"), F.lit(2)), F.lit("_"), F.lit(" ")).alias("page_title"),
        t.image_url(path, "w300").alias("image"),
    )


@query(
    "text_flags",
    """SELECT doc_id, length(text) >= 500 AND (length(text) - length(replace(text, '. ', ''))) / 2 >= 3 AS is_prose,
      split_part(text, chr(10), 1) AS head, md5(CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END) AS body,
      len(regexp_extract_all(text, '[A-Za-z0-9]{2,}')) AS words, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS distinct_words
    FROM documents""",
)
def text_flags(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{2,}"), F.lit(0))
    lower = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return documents(spark, sf_dir).select(
        "doc_id", t.is_prose(F.col("text")).alias("is_prose"), t.head_of("text").alias("head"), F.md5(t.body_of("text")).alias("body"),
        F.size(found).cast("long").alias("words"), F.size(F.array_distinct(lower)).cast("long").alias("distinct_words"),
    )


# ---- dates ----------------------------------------------------------------------------------------------------------
@query(
    "parse_dates",
    """WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 40 AS e FROM orders)
    SELECT o_orderkey, CASE WHEN day(d) = 1 THEN CAST(d AS VARCHAR) || ',' || CAST(e AS VARCHAR)
      ELSE CAST(d AS VARCHAR) || ',' || CAST(e AS VARCHAR) || ',' || CAST(d + 1 AS VARCHAR) END AS days FROM x""",
)
def parse_dates(spark, sf_dir):
    d = F.to_date("o_orderdate")
    e = F.date_add(d, 40)
    parts = F.concat(
        F.lit("Aired "), F.date_format(d, "MMMM d"), F.lit("th, "), F.date_format(d, "yyyy"), F.lit(" (TV); TBA, Spring 2027 / "),
        F.date_format(e, "d MMM yyyy"), F.lit("; 2019-02-31; "),
        F.when(F.dayofmonth(d) == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(F.date_add(d, 1), "yyyy MMMM d")),
    )
    found = dates.parse_dates(parts)
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return orders.select(
        "o_orderkey", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("days")
    )


@query(
    "iso_date_prefix",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) WHEN o_orderstatus = 'O' THEN NULL
      ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""",
)
def iso_date_prefix(spark, sf_dir):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("o_orderstatus") == "F", iso).when(F.col("o_orderstatus") == "O", F.concat(F.lit("x"), iso)).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", t.as_date(raw).alias("day"))


# ---- grounding and dialogue -----------------------------------------------------------------------------------------
@query(
    "quote_grounding",
    """WITH q AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS said FROM benchmark WHERE item_id = 0),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS ws, list_distinct(said) AS want,
                 greatest(2 * len(said), 30) AS size FROM documents, q)
    SELECT doc_id, len(want) >= 4 AND len(list_filter(range(0, greatest(len(ws) - size // 2, 1), greatest(size // 4, 1)),
      lambda i: len(list_intersect(want, ws[i + 1:i + size])) >= 0.7 * len(want))) > 0 AS grounded FROM d""",
)
def quote_grounding(spark, sf_dir):
    quote = F.lit(text_of(spark, sf_dir, 0))
    return documents(spark, sf_dir).select("doc_id", ground.quoted(quote, F.col("text")).alias("grounded"))


@query(
    "last_assistant_turn",
    """WITH l AS (SELECT conv_id, max(turn) AS assistant_turn FROM conversations WHERE role = 'assistant' GROUP BY 1),
    ids AS (SELECT DISTINCT conv_id FROM conversations),
    u AS (SELECT c.conv_id, max(c.turn) AS user_turn FROM conversations c JOIN l USING (conv_id) WHERE role = 'user' AND turn < assistant_turn GROUP BY 1)
    SELECT ids.conv_id, assistant_turn, a.text AS assistant_text, user_turn, b.text AS user_text FROM ids LEFT JOIN l USING (conv_id) LEFT JOIN u USING (conv_id)
    LEFT JOIN conversations a ON a.conv_id = ids.conv_id AND a.turn = assistant_turn
    LEFT JOIN conversations b ON b.conv_id = ids.conv_id AND b.turn = user_turn""",
)
def last_assistant_turn(spark, sf_dir):
    return dialogue.last_turns(table(spark, sf_dir, "conversations"))


@query(
    "dialogue_rules",
    r"""WITH m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Seen ' || turn || '화까지, 4.5점 and then ' || conv_id || '화'
        WHEN 'assistant' THEN turn || '기 ' || conv_id || '화, 별 4개' ELSE 'Season ' || turn || ' text ' || conv_id END AS msg FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(msg, '까지') THEN CAST(turn AS VARCHAR)
        ELSE array_to_string(regexp_extract_all(msg, '\d+'), ',') END AS numbers,
      regexp_matches(msg, '(?i)\d+\s*(기|시즌|season|쿨)|(시즌|season)\s*\d+') AS season,
      regexp_matches(msg, '4\.5점') AS rated_45, regexp_matches(msg, '별 4개') AS rated_4 FROM m""",
)
def dialogue_rules(spark, sf_dir):
    msg = (
        F.when(F.col("role") == "user", F.concat(F.lit("Seen "), "turn", F.lit("화까지, 4.5점 and then "), "conv_id", F.lit("화")))
        .when(F.col("role") == "assistant", F.concat("turn", F.lit("기 "), "conv_id", F.lit("화, 별 4개")))
        .otherwise(F.concat(F.lit("Season "), "turn", F.lit(" text "), "conv_id"))
    )
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", msg.alias("msg"))
    m = F.col("msg")
    return c.select(
        "conv_id", "turn", F.array_join(dialogue.episode_numbers(m), ",").alias("numbers"), dialogue.says_season(m).alias("season"),
        dialogue.rating_said(F.lit(4.5), m).alias("rated_45"), dialogue.rating_said(F.lit(4.0), m).alias("rated_4"),
    )


@query(
    "json_each",
    """SELECT event_type, 'k' AS key, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY 1""",
)
def json_each(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))
