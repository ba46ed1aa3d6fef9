"""Language identification: evidence of the text, its markup and its place, fused by Bayes' rule.

* Text: letter trigrams, hashed to ``BUCKETS``, under one multinomial per language. Every label that has a
  row with a letter is a language, whatever its share. Its counts come from a bounded sample of its own rows: those with the smallest hashes of id
  and text in each of ``SALTS`` groups, ``SAMPLE`` rows of a label at most (rows that repeat come together), and all rows of a group that has few.
* Markup: a declared language is right with probability ``TRUST``.
* Place: how languages are spread over a host, smoothed by its domain, that by the address suffix, that by all
  rows. The counts are soft - shares of the text's evidence - and grouped over all rows; a row's own share is taken out.

Texts do not move: their evidence is one number for each language. Counts of a host are combined in the tasks before they move.
A row is rejected when it has no letters, or no language reaches ``LEAST``. What speaks against the best language is not only the others but also that the
text is none of them: its log likelihood per trigram is held against a level of that language, below what texts of the language's own sample have, each
left out of the counts that it is judged by. The level is ``MARGIN`` under their median, or ``SPREADS`` times the way to their lowest tenth, and never
lower than what a trigram has that is drawn evenly. ``confidence`` is the product of both; with few trigrams the level says little. A language with a
handful of sample rows has a loose level.

Defined cases: a null or letterless text has language ``und`` and is rejected. A null host is one host; an empty or unknown declared language is
no evidence. Rows that repeat are treated alike. Further columns are kept in ``languages``. Without any labelled row all
texts are ``und``. Empty table: empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from episodika.llm.common import numbered, replace_columns, whole
from episodika.session import cut_lineage

#: rows of each label that the text model is fitted on, groups that they are drawn from, and buckets of trigrams
SAMPLE, SALTS, BUCKETS = 1024, 64, 1 << 16
#: weight of a trigram's evidence (neighbours overlap), reliability of a declaration, rows that a level's parent counts for, least posterior
TEMPER, TRUST, PARENT_ROWS, LEAST = 0.3, 0.9, 10.0, 0.5
#: how far under the median of a language's own texts its level is, in nats per trigram or in ways to their lowest tenth; share of texts in no known language
MARGIN, SPREADS, FOREIGN = 2.0, 4.0, 0.01
#: bytes of a text whose trigrams are looked up at once
CHUNK = 1 << 20

_OTHER = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all trigrams of bytes of the lower-cased letters, words apart by one blank."""
    letters = _OTHER.sub(" ", text.lower()).strip()
    raw = np.frombuffer(f" {letters} ".encode() if letters else b"", np.uint8)
    for at in range(0, max(0, len(raw) - 2), CHUNK):
        x = raw[at : at + CHUNK + 2].astype(np.uint32)
        yield ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def fit_text(labelled: DataFrame, text: str = "text", label: str = "lang", id: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray, list[float]]:
    """Languages, their log probabilities of the buckets and their levels; at most languages x buckets numbers come to the driver.

    ``sample`` bounds the rows of each label, not of all: no label is lost to the others' number.
    """
    rows = labelled.where(F.col(label).isNotNull() & (F.col(label) != "") & whole(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(label).alias("label"), F.xxhash64(F.col(id), whole(text)).alias("row"), whole(text).alias("text"))
    salts = max(1, min(SALTS, sample))
    least = Window.partitionBy("label", "salt").orderBy("row")
    chosen = rows.select("label", "row", F.pmod(F.xxhash64(F.lit("salt"), "row"), F.lit(salts)).alias("salt"))
    chosen = chosen.withColumn("n", F.row_number().over(least)).where(F.col("n") <= sample // salts).select("label", "row").distinct()
    rows = cut_lineage(rows.join(F.broadcast(chosen), ["label", "row"], "left_semi").select("label", "text"))  # at most ``sample`` numbers a label

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, content in zip(batch["label"], batch["text"], strict=True):
                own = totals.setdefault(language, np.zeros(BUCKETS, np.int64))
                for grams in trigrams(content):
                    own += np.bincount(grams, minlength=BUCKETS)
        for language, own in totals.items():
            some = np.flatnonzero(own)
            yield pd.DataFrame({"label": language, "gram": some, "n": own[some]})

    found = rows.mapInPandas(count, "label string, gram int, n long").groupBy("label", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["label"].unique())
    counts = np.full((len(languages), BUCKETS), 0.1)
    for n, language in enumerate(languages):
        own = found[found["label"] == language]
        counts[n, own["gram"].to_numpy()] += own["n"].to_numpy()
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), levels(rows, languages, counts)


def levels(rows: DataFrame, languages: list[str], counts: np.ndarray) -> list[float]:
    """The log likelihood per trigram of each language under which a text speaks for none; ``rows`` (label, text) are the sample that was counted."""
    counts, totals, at = counts.astype(np.float32), counts.sum(axis=1), {x: n for n, x in enumerate(languages)}

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for language, content in zip(batch["label"], batch["text"], strict=True):
                own = np.zeros(BUCKETS, np.int64)
                for grams in trigrams(content):
                    own += np.bincount(grams, minlength=BUCKETS)
                if (n := own.sum()) and language in at:
                    some, k = np.flatnonzero(own), at[language]
                    left = np.log(np.maximum(counts[k, some] - own[some], 0.1) / (totals[k] - n))
                    out.append((language, float(own[some] @ left / n)))
            yield pd.DataFrame(out, columns=["label", "mean"])

    shares = F.percentile_approx("mean", [0.1, 0.5])
    found = dict(rows.mapInPandas(judge, "label string, mean double").groupBy("label").agg(shares).collect())
    level = lambda low, mid: max(mid - max(MARGIN, SPREADS * (mid - low)), -float(np.log(BUCKETS)))
    return [level(*found[x]) for x in languages]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _softmax(values: Column) -> Column:
    shifted = _let(values, lambda vs: _let(F.array_max(vs), lambda top: F.transform(vs, lambda v: F.exp(v - top))))
    return _let(
        shifted, lambda powers: _let(F.aggregate(powers, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(powers, lambda p: p / total))
    )


def text_evidence(rows: DataFrame, languages: list[str], log: np.ndarray, text: str = "text", id: str = "id") -> DataFrame:
    """``rows`` without its text, with ``grams`` (number of trigrams) and ``evidence`` (array: tempered log likelihoods)."""
    others = [c for c in rows.columns if c != text]
    table = np.ascontiguousarray(log.T)  # buckets x languages: one trigram's numbers stand together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, sums = [], []
            for content in batch[text]:
                n, total = 0, np.zeros(len(languages))
                for buckets in trigrams(content.as_py()):
                    n += len(buckets)
                    total += table[buckets].sum(axis=0, dtype=np.float64)
                grams.append(n)
                sums.append(TEMPER * total)
            # all other columns go through as they are, whatever their types
            found = [pa.array(grams, pa.int64()), pa.array(sums, pa.list_(pa.float64()))]
            yield pa.record_batch([*[batch[c] for c in others], *found], names=[*others, "grams", "evidence"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != text)
    return rows.mapInArrow(run, f"{schema}, grams long, evidence array<double>")


def place_priors(rows: DataFrame, n_languages: int) -> DataFrame:
    """host, n, counts, parent: soft counts of each host and the smoothed shares of the levels above it."""
    shares = [F.sum(F.when(F.col("grams") > 0, F.get("soft", F.lit(i))).otherwise(0.0)) for i in range(n_languages)]
    hosts = rows.groupBy("host", "domain", "suffix").agg(F.count_if(F.col("grams") > 0).cast("double").alias("n"), F.array(*shares).alias("counts"))

    def level(table: DataFrame, *keys: str) -> DataFrame:
        sums = [F.sum(F.get("counts", F.lit(i))) for i in range(n_languages)]
        return table.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*sums).alias("counts"))

    domains = level(hosts, "domain", "suffix")
    suffixes = level(domains, "suffix")
    everything = level(suffixes).first()
    flat = F.array(*[F.lit(float(((everything["counts"] or [])[i : i + 1] or [0.0])[0] or 0.0) + 1.0) for i in range(n_languages)])
    flat = F.transform(flat, lambda c: c / F.lit(float(everything["n"] or 0.0) + n_languages))
    smooth = lambda counts, n, parent: F.transform(F.arrays_zip(counts.alias("c"), parent.alias("p")), lambda x: (x["c"] + PARENT_ROWS * x["p"]) / (n + PARENT_ROWS))
    suffixes = suffixes.select("suffix", smooth(F.col("counts"), F.col("n"), flat).alias("suffix_share"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", smooth(F.col("counts"), F.col("n"), F.col("suffix_share")).alias("parent"))
    return hosts.join(domains, ["domain", "suffix"]).select("host", "domain", "suffix", F.col("n").alias("host_n"), "counts", "parent")


def address_parts(host: Column) -> tuple[Column, Column]:
    """Domain (the last two labels of a host) and suffix (the last); a name without a dot has an empty suffix."""
    labels = F.split(host, r"\.", -1)
    suffix = F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise(F.lit(""))
    domain = F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(host)
    return domain, suffix


def languages(rows: DataFrame, model: tuple[list[str], np.ndarray, list[float]]) -> DataFrame:
    """``rows`` (any columns with text, declared, host) without these three, with language, confidence, kept; columns called like a result give way."""
    plain, at = numbered(rows)
    told = _languages(plain.withColumnsRenamed({at[c]: c for c in ("text", "declared", "host")}), model)
    gone = {"text", "declared", "host", "language", "confidence", "kept"}
    others = [F.col(f"c{i}").alias(c) for i, c in enumerate(rows.columns) if c.lower() not in gone]
    return told.select(*others, "language", "confidence", "kept")


def _languages(rows: DataFrame, model: tuple[list[str], np.ndarray, list[float]]) -> DataFrame:
    known, log, *own_levels = model
    if not known:
        return replace_columns(rows, language=F.lit("und"), confidence=F.lit(0.0), kept=F.lit(False)).drop("text", "declared", "host")
    host = F.lower(F.coalesce(F.col("host"), F.lit("")))
    domain, suffix = address_parts(host)
    placed = replace_columns(rows, text=whole("text"), host=host, domain=domain, suffix=suffix)
    evidence = cut_lineage(text_evidence(placed, known, log)).withColumn("soft", _softmax(F.col("evidence")))
    priors = place_priors(evidence, len(known))
    joined = evidence.join(priors, ["host", "domain", "suffix"])
    own = F.when(F.col("grams") > 0, 1.0).otherwise(0.0)
    prior = F.transform(
        F.arrays_zip("counts", "parent", "soft"),
        lambda x: F.log((F.greatest(x["counts"] - x["soft"] * own, F.lit(0.0)) + PARENT_ROWS * x["parent"]) / (F.col("host_n") - own + PARENT_ROWS)),
    )
    codes = F.array(*map(F.lit, known))
    said = F.lower(F.substring_index(F.coalesce(F.col("declared"), F.lit("")), "-", 1))
    declared = F.transform(
        codes, lambda c: F.when(~F.array_contains(codes, said), 0.0).when(c == said, float(np.log(TRUST))).otherwise(float(np.log((1 - TRUST) / max(1, len(known) - 1))))
    )
    total = F.transform(F.arrays_zip("evidence", prior.alias("prior"), declared.alias("declared")), lambda x: x["evidence"] + x["prior"] + x["declared"])
    fused = joined.withColumn("found", _let(_softmax(total), lambda p: F.struct(F.array_max(p).alias("best"), F.array_position(p, F.array_max(p)).alias("at"))))
    at, lettered = F.col("found.at").cast("int") - 1, F.col("grams") > 0
    over = F.get("evidence", at) - F.lit(TEMPER) * F.col("grams") * F.get(F.array(*map(F.lit, own_levels[0])), at)
    best = F.col("found.best") / (1 + F.exp(-over) * F.lit(FOREIGN / (1 - FOREIGN)))
    out = replace_columns(
        fused, language=F.when(lettered, F.get(codes, at)).otherwise("und"),
        confidence=F.when(lettered, best).otherwise(0.0), kept=lettered & (best >= LEAST),
    )
    return out.drop("declared", "host", "domain", "suffix", "grams", "evidence", "soft", "host_n", "counts", "parent", "found")


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host of web pages: visible text, the html element's language, the address's host."""
    html = whole("html")
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    return pages.select(
        "page_id", text.alias("text"), F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1).alias("declared"),
        F.regexp_extract(whole("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1).alias("host"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, declared (its language column), host (its source)."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
