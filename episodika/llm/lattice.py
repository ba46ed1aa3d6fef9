"""Language-model scores of documents: word counts with a subword lattice behind them.

A word's probability is its discounted share of the training tokens plus, with the mass that discounting frees, the probability that a
lattice of subword pieces gives it: a first piece, further pieces, an end. All segmentations count; their sum is a forward
recursion in log space. The pieces are an existing vocabulary whose scores (ranks) give the first weights; expectation steps over the distinct training
words - forward and backward sums, added up per piece - fit them to the corpus. What comes to the driver is one number for each piece of the vocabulary and
a few totals, and the scores of the ``COMMON`` commonest words, which texts need not move to meet; all other words, their counts and scores stay tables,
and meet the texts in a join.

Texts keep to a language: each of the ``CLASSES`` commonest labels of the training rows has word shares and a lattice of its own, discounted in
the same way towards the shares of all rows. Training rows of all further labels and without a label are one more class. A text's score is the log of
its probabilities under the classes, weighted by their training documents and added up. No label is looked at when a text is scored.

The model is a probability distribution over texts as sequences of words and one end: shares, freed mass and lattice add up to 1.

Defined cases: a null text is an empty text, which is its end alone. A document with a null id is a training document. Repeated rows count once
for each row. Other columns are not looked at. Without any training document all words come from the lattice. Empty table: empty result.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from episodika.llm.common import as_text, from_text, whole
from episodika.llm.tokens import vocabulary_path
from episodika.session import cut_lineage

FOLDS, HELD_OUT, ROUNDS = 5, 1, 2
#: commonest labels that have word shares of their own; all other training rows share one class
CLASSES = 8
#: commonest words, whose scores every task gets; words that a counting task holds before it passes counts on
COMMON, HELD_WORDS = 20_000, 300_000
#: share of a class's freed mass that goes to its own lattice; the rest goes to the shares of all rows
OWN_LATTICE = 0.8
#: stands for a text's end among the words, which are never empty; its share of the base that discounting falls back on
END, END_SHARE = "", 1e-3
_BASE = np.uint64(0x100000001B3)


class Lattice:
    """Pieces of a vocabulary with log weights. A word is a blank and its bytes: pieces with the blank come first, others follow."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.pieces = pieces
        self.first = np.fromiter((p[:1] == b" " for p in pieces), bool, len(pieces))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(p) for p in pieces}:
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == size])
            raw = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(len(ids), size)
            keys = np.zeros(len(ids), np.uint64)
            for column in raw.T:
                keys = keys * _BASE + column + np.uint64(1)
            order = np.argsort(keys)
            self.tables[size] = keys[order], ids[order]
        self.set_weights(weights, float(weights.sum()))

    def set_weights(self, weights: np.ndarray, ends: float) -> None:
        """Expected counts of the pieces and of ends, made probabilities: first pieces and all that may follow each add up to 1."""
        first = weights[self.first].sum()
        rest = weights[~self.first].sum() + ends
        self.log = np.log(np.where(self.first, weights / first, weights / rest))
        self.log_end = math.log(ends / rest)

    def _edges(self, words: list[bytes]) -> tuple:
        """Sorted by end: start, end, piece of every piece found in the words; offsets of words; reach of each end in its word."""
        raw = np.frombuffer(b"".join(b" " + w for w in words), np.uint8)
        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        offsets = np.cumsum(lengths) - lengths
        left = np.repeat(offsets + lengths, lengths) - np.arange(len(raw))  # bytes up to the word's end
        keys, at, found = np.zeros(len(raw), np.uint64), np.arange(len(raw)), []
        for size in range(1, max(self.tables) + 1):
            inside = left[at] >= size
            at, keys = at[inside], keys[inside]
            if not len(at):
                break
            keys = keys * _BASE + raw[at + size - 1] + np.uint64(1)
            if size in self.tables:
                known, ids = self.tables[size]
                slot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[slot] == keys
                found.append((at[hit], np.full(int(hit.sum()), size), ids[slot[hit]]))
        start, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        # nodes: one more than bytes for each word
        word = np.repeat(np.arange(len(words)), lengths)
        begin, reach = start + word[start], start - offsets[word[start]]
        return begin, begin + size, piece, reach, reach + size, offsets + np.arange(len(words)), lengths, len(raw) + len(words)

    def forward(self, words: list[bytes], weights: list[tuple[np.ndarray, float]] | None = None) -> np.ndarray:
        """Log probability of each word, the sum over all its segmentations; a row for each of several sets of weights."""
        begin, end, piece, _, reach, offsets, lengths, nodes = self._edges(words)
        found = []
        for self.log, self.log_end in weights or [(self.log, self.log_end)]:
            alpha = self._sums(begin, end, piece, reach, offsets, nodes)
            found.append(alpha[offsets + lengths] + self.log_end)
        return np.array(found) if weights else found[0]

    def _sums(self, begin, end, piece, reach, starts, nodes) -> np.ndarray:
        sums = np.full(nodes, -np.inf)
        sums[starts] = 0.0
        order = np.argsort(reach, kind="stable")
        cuts = np.flatnonzero(np.diff(reach[order])) + 1
        for step in np.split(order, cuts):
            if len(step):
                np.logaddexp.at(sums, end[step], sums[begin[step]] + self.log[piece[step]])
        return sums

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected number of each piece in the words, each word once."""
        begin, end, piece, low, high, offsets, lengths, nodes = self._edges(words)
        alpha = self._sums(begin, end, piece, high, offsets, nodes)
        size = lengths[np.searchsorted(offsets, begin, side="right") - 1]
        beta = self._sums(end, begin, piece, size - low, offsets + lengths, nodes)
        last = np.repeat(alpha[offsets + lengths], lengths + 1)
        share = np.exp(alpha[begin] + self.log[piece] + beta[end] - last[begin])
        return np.bincount(piece, weights=share, minlength=len(self.pieces))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a word's beginning as a blank, and first weights from the vocabulary's scores, which are ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:] and not any(b in piece for b in (b"\t", b"\n", b"\r", b"\x0b", b"\x0c")):
            weights[piece] = max(weights.get(piece, 0.0), 1 / (3.0 - model.get_score(i)))
    least = min(weights.values(), default=1.0)
    for b in [b" ", *(bytes([n]) for n in range(256) if n != 0x20)]:
        weights.setdefault(b, least)
    return list(weights), np.array(list(weights.values()))


def _held(id: str) -> Column:
    """Held-out rows by their id; a null id is a training row."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def classes_of(docs: DataFrame, label: str | None, id: str = "doc_id", most: int = CLASSES) -> list[str]:
    """The ``most`` commonest labels of the training rows; a model without labels has one class for all."""
    if label is None or label not in docs.columns:
        return []
    rows = docs.where(F.col(label).isNotNull() & ~_held(id)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return [row[0] for row in rows.orderBy(F.desc("n"), label).limit(most).collect()]


def _texts(docs: DataFrame, labels: list[str], label: str | None, text: str, id: str) -> DataFrame:
    """doc_id, held_out, class (-1: none of ``labels``), text."""
    group = F.coalesce(F.array_position(F.array(*map(F.lit, labels)), F.col(label)).cast("int") - 1, F.lit(-1)) if labels else F.lit(-1)
    return docs.select(F.col(id).alias("doc_id"), _held(id).alias("held_out"), group.alias("class"), whole(text).alias("text"))


def _tokens(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), b""]


def vocabulary_counts(texts: DataFrame, n_classes: int, held_words: int = HELD_WORDS) -> DataFrame:
    """word, c, c0, c1, ..., rest: how often each word stands in training texts, in those of each class and of none; words of other texts too.

    A task adds up its own texts and passes counts on whenever it holds ``held_words`` words.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters: dict[tuple[bool, int], Counter] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for (held, group), counter in counters.items():
                yield pd.DataFrame({"word": [w.decode() for w in counter], "class": group, "n": [0] * len(counter) if held else list(counter.values())})
            counters.clear()

        for batch in batches:
            for held, group, content in zip(batch["held_out"], batch["class"], batch["text"], strict=True):
                counters.setdefault((held, -1 if held else group), Counter()).update(_tokens(content))
                if sum(map(len, counters.values())) > held_words:
                    yield from flush()
        yield from flush()

    rows = texts.mapInPandas(count, "word string, class int, n long")
    own = [F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(n_classes)]
    own.append(F.sum(F.when(F.col("class") < 0, F.col("n")).otherwise(0)).alias("rest"))
    return rows.groupBy("word").agg(F.sum("n").alias("c"), *own)


def commonest(scored: DataFrame, most: int = COMMON) -> DataFrame:
    """The words above the lowest count that at most ``most`` words reach, counts taken in steps of an eighth of a doubling.

    A few hundred numbers choose the step; no task sorts words or sends more of them than it has above it.
    """
    step = F.floor(8 * F.log2("c"))
    sizes = scored.where("c > 0").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    lowest, held = math.inf, 0
    for at, n in sorted(((r["step"], r["n"]) for r in sizes), reverse=True):
        held += n
        if held > most:
            break
        lowest = at
    return scored.where((F.col("c") > 0) & (step >= lowest)) if lowest < math.inf else scored.where("false")


def text_sums(texts: DataFrame, common: pd.DataFrame, columns: list[str]) -> DataFrame:
    """One row per text: key, doc_id, held_out, n_tokens, the sums of ``columns`` over its common words, its other words and their times.

    ``common`` (word and ``columns``) is bounded: the words that most texts share need not move at all.
    """
    kind = dict(texts.dtypes)["doc_id"]
    texts = texts.withColumn("doc_id", as_text("doc_id"))
    index = {w.encode(): i for i, w in enumerate(common["word"])}
    table = np.vstack([common[columns].to_numpy(float), np.zeros(len(columns))])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            sums, words, times, sizes = np.zeros((len(batch), len(columns))), [], [], []
            for n, content in enumerate(batch["text"]):
                tokens = _tokens(content)
                counts = Counter(tokens)
                found = np.fromiter((index.get(w, -1) for w in counts), np.int64, len(counts))
                often = np.fromiter(counts.values(), np.int64, len(counts))
                sums[n] = often @ table[found]
                rest = [(w, t) for w, t, i in zip(counts, often.tolist(), found.tolist(), strict=True) if i < 0]
                words.append([w.decode() for w, _ in rest])
                times.append([t for _, t in rest])
                sizes.append(len(tokens))
            out = pd.DataFrame({"key": range(key, key + len(batch)), "doc_id": batch["doc_id"].to_numpy(), "held_out": batch["held_out"].to_numpy(), "n_tokens": sizes, "words": words, "times": times})
            key += len(batch)
            yield out.assign(**{c: sums[:, i] for i, c in enumerate(columns)})

    schema = "key long, doc_id string, held_out boolean, n_tokens long, words array<string>, times array<long>"
    return from_text(texts.mapInPandas(add_up, schema + "".join(f", {c} double" for c in columns)), kind)


Weights = tuple[np.ndarray, float]


def fit(vocab: DataFrame, path: str, columns: list[str], rounds: int = ROUNDS) -> list[Weights]:
    """Log weights of the pieces and of the end for each of the ``columns``, fitted to the distinct words that it counts."""
    pieces, weights = vocabulary(path)
    training = vocab.where((F.col("word") != END) & (F.greatest(F.lit(0), *columns) > 0)).select("word", *columns)
    types = [n or 0 for n in training.agg(F.count(F.lit(1)), *[F.count_if(F.col(c) > 0) for c in columns]).first()[1:]]
    start, prior = Lattice(pieces, weights), weights / weights.sum()
    fitted = [(start.log, start.log_end)] * len(columns)
    for _ in range(rounds if any(types) else 0):

        def expect(batches: Iterator[pd.DataFrame], fitted=fitted) -> Iterator[pd.DataFrame]:
            own = _lattice(path)
            totals = np.zeros((len(columns), len(pieces)))
            for batch in batches:
                for k, c in enumerate(columns):
                    words = [w.encode() for w in batch["word"][batch[c] > 0]]
                    if words:
                        own.log, own.log_end = fitted[k]
                        totals[k] += own.expected(words)
            k, piece = np.nonzero(totals)
            yield pd.DataFrame({"k": k, "piece": piece, "n": totals[k, piece]})

        found = np.zeros((len(columns), len(pieces)))
        for k, piece, n in training.mapInPandas(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n")).collect():
            found[k, piece] = n
        fitted = []
        for own, n in zip(found, types, strict=True):
            start.set_weights(own + 0.01 * max(n, 1) * prior + 1e-6, float(max(n, 1)))
            fitted.append((start.log, start.log_end))
    return fitted


@functools.lru_cache(maxsize=2)
def _lattice(path: str) -> Lattice:
    return Lattice(*vocabulary(path))


def lm_scores(
    docs: DataFrame, path: str | None = None, rounds: int = ROUNDS, label: str | None = "lang", text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``."""
    path = path or vocabulary_path("piece_bpe_32k.model")
    labels = classes_of(docs, label, id)
    texts = _texts(docs, labels, label, text, id)
    vocab = cut_lineage(vocabulary_counts(texts, len(labels)))
    columns = [f"c{k}" for k in range(len(labels))]
    if not labels or vocab.where((F.col("word") == END) & (F.col("rest") > 0)).count():  # each training text has one end
        columns.append("rest")
    sums = [f(c) for c in columns for f in (F.sum, lambda c: F.count_if(F.col(c) > 0))]
    ends = [F.sum(F.when(F.col("word") == END, F.col(c)).otherwise(0)) for c in columns]
    known = vocab.where("c > 0").agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), *sums, *ends).first()
    total, distinct, once, twice, *rest = (x or 0 for x in known)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    freed = discount * distinct / total if total else 1.0
    sizes = list(zip(rest[: 2 * len(columns) : 2], rest[1 : 2 * len(columns) : 2], strict=True))
    documents = np.array(rest[2 * len(columns) :], float) + 1
    log_class = np.log10(documents / documents.sum())
    fitted = fit(vocab, path, columns, rounds)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            lattices = _lattice(path).forward([w.encode() for w in batch["word"]], fitted) + math.log(1 - END_SHARE)
            lattices[:, (batch["word"] == END).to_numpy()] = math.log(END_SHARE)
            with np.errstate(divide="ignore"):
                share = np.maximum(batch["c"].to_numpy() - discount, 0) / max(total, 1)
                every = np.logaddexp(np.log(share), np.logaddexp.reduce(lattices) - math.log(len(lattices)) + math.log(freed))
                found = []
                for own, c, (size, types) in zip(lattices, columns, sizes, strict=True):
                    behind = np.logaddexp(every + math.log(1 - OWN_LATTICE), own + math.log(OWN_LATTICE))
                    inside = np.maximum(batch[c].to_numpy() - discount, 0) / max(size, 1)
                    found.append(np.logaddexp(np.log(inside), behind + (math.log(discount * types / size) if size else 0.0)) / math.log(10))
            yield batch[["word", "c"]].assign(**{f"p{k}": p for k, p in enumerate(found)})

    names = [f"p{k}" for k in range(len(columns))]
    scored = vocab.mapInPandas(score, "word string, c long, " + ", ".join(f"{n} double" for n in names))
    base = F.log10((F.col("c") + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    scored = cut_lineage(scored.select("word", "c", (F.col("c") > 0).cast("double").alias("n_known"), base.alias("base_score"), *names))
    columns = ["n_known", "base_score", *names]
    common = commonest(scored).toPandas()
    rows = cut_lineage(text_sums(texts, common, columns))
    others = rows.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    others = others.join(scored, "word").groupBy("key").agg(*[F.sum(F.col("times") * F.col(c)).alias(f"other_{c}") for c in columns])
    rows = rows.drop("words", "times").join(others, "key", "left")
    sums = rows.withColumns({c: F.col(c) + F.coalesce(f"other_{c}", F.lit(0.0)) for c in columns})
    each = F.array(*[F.col(n) + float(p) for n, p in zip(names, log_class, strict=True)])
    top = F.array_max(each)
    score_sum = top + F.log10(F.aggregate(each, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - top)))
    return sums.select(
        "doc_id", "held_out", "n_tokens", F.round("n_known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), "base_score", score_sum.alias("score")
    )
