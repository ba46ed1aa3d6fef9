"""Secrets in texts, and weak candidates that only count together.

Strong spans are found by pattern alone. Weak candidates - an account name, a short secret, an endpoint - are common in clean
text, so one is reported only when a complementary part stands near it: parts of a document become intervals, cut into bins
of the scope's width, and meet in an interval join on (document, bin). The join is a semi join: a part asks whether
a partner exists, pairs are never listed.

Positions come from the pieces between the matches: the text split by a pattern and the matches of the same pattern, laid
end to end, are the text again, so running lengths are offsets.

Defined cases: a null text is an empty text. Rows that repeat id and text have the same spans. Ties in start are ordered by
kind as listed. Further columns are kept, columns called like a result give way to it. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from episodika.llm.common import replace_columns, whole
from episodika.session import cut_lineage

# --- fixed values: patterns and shortest lengths --------------------------------------------------------------------
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_CHARS, ACCESS_CHARS, WEAK_CHARS = 12, 18, 6
#: weak parts: an account name, an endpoint (addresses with a path or port, or a host given by name)
LOGIN = r"""(?:[uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD])["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})"""
ENDPOINT = r"(?:https?|ftp|ssh|postgres|mysql|redis|amqp|mongodb)://[A-Za-z0-9.:/_@?&=%+~#-]+"
KINDS = ["assign", "access", "hex", "weak_assign", "login", "endpoint"]
# --- end of fixed values --------------------------------------------------------------------------------------------

#: widest gap, in code points, between parts of one credential; width of a bin of the interval join
SCOPE, BIN = 400, 1024
#: the parts that make a weak one count, by rank: a short secret needs an account or endpoint, those need a secret
PARTNERS = {3: [1, 4, 5], 4: [0, 3], 5: [0, 1, 3]}


def _matches(text: Column, pattern: str, value_group: int, rank: int) -> Column:
    """struct<rank, parts>: gap before, length and value length of each leftmost non-overlapping match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    zipped = F.arrays_zip(found.alias("m"), values.alias("v"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("g"))
    parts = F.transform(
        zipped, lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["v"]).alias("size"))
    )
    return F.struct(F.lit(rank).alias("rank"), parts.alias("parts"))


def parts_of(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Strong spans and weak candidates: doc, row (hash of the text), start, end, rank in ``KINDS``."""
    base = docs.select(F.col(id).alias("doc"), F.xxhash64(whole(text)).alias("row"), whole(text).alias("body"))
    plans = [(ASSIGN, 1, 0), (ACCESS, 0, 1), (HEX, 0, 2), (LOGIN, 1, 4), (ENDPOINT, 0, 5)]
    kinds = F.array(*[F.when(F.col("body").rlike(p), _matches(F.col("body"), p, group, rank)) for p, group, rank in plans])
    found = base.select("doc", "row", F.explode(kinds).alias("kind")).select("doc", "row", "kind.rank", F.posexplode("kind.parts").alias("nth", "part"))
    found = found.select("doc", "row", "rank", "nth", "part.*").distinct()
    before = Window.partitionBy("doc", "row", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).withColumn("start", F.col("end") - F.col("len"))
    rank, size = F.col("rank"), F.col("size")
    rank = F.when((rank == 0) & (size < ASSIGN_CHARS), F.when(size >= WEAK_CHARS, F.lit(3))).when((rank == 1) & (size < ACCESS_CHARS), None).otherwise(rank)
    return found.select("doc", "row", "start", "end", rank.alias("rank")).where("rank is not null")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates with a complementary part at most ``scope`` code points away."""
    partners = F.create_map(*[x for k, v in PARTNERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    bins = lambda low, high: F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / BIN), F.floor(high / BIN)))
    weak = parts.where(F.col("rank") >= 3).select("*", F.explode(partners[F.col("rank")]).alias("needs"))
    weak = weak.withColumn("bin", bins(F.col("start") - scope, F.col("end") + scope))
    other = parts.where("rank <> 2").select(
        F.col("doc").alias("o_doc"), F.col("row").alias("o_row"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.col("rank").alias("o_rank"), bins(F.col("start"), F.col("end")).alias("o_bin"),
    )
    near = (
        weak["doc"].eqNullSafe(other["o_doc"]) & (weak["row"] == other["o_row"]) & (weak["bin"] == other["o_bin"])
        & (weak["needs"] == other["o_rank"]) & (other["o_start"] <= weak["end"] + scope) & (other["o_end"] >= weak["start"] - scope)
    )
    return weak.join(other, near, "left_semi").select(*parts.columns).distinct()


def scan_secrets(docs: DataFrame, scope: int = SCOPE, text: str = "text", id: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with ``spans``: array<struct<start, rank, end>> in order."""
    parts = cut_lineage(parts_of(docs, text, id))
    spans = parts.where("rank < 3").unionByName(linked(parts, scope))
    spans = spans.groupBy("doc", "row").agg(F.sort_array(F.collect_set(F.struct("start", "rank", "end"))).alias("_spans"))
    spans = spans.withColumnsRenamed({"doc": "_doc", "row": "_drow"})
    base = replace_columns(docs, _row=F.xxhash64(whole(text)))
    joined = base.join(spans, base[id].eqNullSafe(spans["_doc"]) & (base["_row"] == spans["_drow"]), "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    return replace_columns(joined, spans=F.coalesce("_spans", none)).drop("_row", "_doc", "_drow", "_spans")


def described(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every reported span, overlapping ones together, replaced by ``mark``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(
        spans, start,
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
            .otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    whole_text = whole(text)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(whole_text, (done["at"] + 1).cast("int"), F.length(whole_text))))
