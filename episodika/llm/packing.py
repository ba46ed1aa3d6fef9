"""Tokens of documents packed into windows of fixed length with bounded memory.

Every task packs its own documents and holds at most ``OPEN`` windows. A document's full windows leave at once; its rest goes
to the open window with the least room that holds it. When none does, the fullest window is topped up with the rest's
beginning and leaves full. What is open at a task's end is poured together into full windows and one left over.
Left-overs of ``FAN`` tasks at a time are merged in the same way, so padding is at most one window for ``FAN`` tasks.

Only left-overs move (less than a window for each task). Window numbers are (task, count). A task that runs again on the same
input file part makes the same windows; results are written to the shared folder before left-overs are merged.

Defined cases: a null text is an empty text, which is its end token alone. Repeated rows are packed once for each row. Other
columns are not looked at. Empty table: empty result.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from episodika.llm.common import as_text, from_text, whole
from episodika.llm.tokens import LETTERS, Encoder, vocabulary_path
from episodika.session import cut_lineage

LENGTH, END_ID, OPEN, FAN = 2048, 1, 32, 256
#: fixed value: the vocabulary's pattern of words
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    # this vocabulary lower-cases, drops blanks and never merges across them
    return Encoder(path, WORD, lambda text: text.split(" "), lower=True)


class Packer:
    """Open windows of one task. A piece is (doc, start, ids, tokens of the document)."""

    def __init__(self, length: int, capacity: int, first: int):
        self.length, self.capacity, self.next = length, capacity, first
        self.open: list[tuple[int, int, list]] = []  # (room, tie, pieces), by room
        self.done: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def _put(self, room: int, pieces: list) -> None:
        if room == 0:
            self._emit(pieces)
        else:
            self.tie = getattr(self, "tie", 0) + 1
            bisect.insort(self.open, (room, self.tie, pieces), key=lambda w: w[:2])

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self._emit([(doc, start, ids[: self.length], total)])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            at = bisect.bisect_left(self.open, len(ids), key=lambda w: w[0])
            if at < len(self.open):  # best fit: the least room that is enough
                room, _, pieces = self.open.pop(at)
            elif len(self.open) < self.capacity:
                room, pieces = self.length, []
            else:  # none fits: the fullest window is topped up and leaves
                room, _, pieces = self.open.pop(0)
            n = min(room, len(ids))
            self._put(room - n, [*pieces, (doc, start, ids[:n], total)])
            start, ids = start + n, ids[n:]

    def close(self) -> list:
        """Pieces of the one window that is left when all open ones are poured together; the others leave full."""
        pieces = [piece for _, _, window in reversed(self.open) for piece in window]
        self.open, room, window = [], self.length, []
        for doc, start, ids, total in pieces:
            while len(ids):
                n = min(room, len(ids))
                window.append((doc, start, ids[:n], total))
                start, ids, room = start + n, ids[n:], room - n
                if not room:
                    self._emit(window)
                    room, window = self.length, []
        return window

    def rows(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def _frame(rows: list[tuple], left: list, task: int) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS, dtype="object").assign(task=task, ids=None)
    if left:
        rest = pd.DataFrame([(d, s, len(i), None, t, None, None, task, i.astype("<u4").tobytes()) for d, s, i, t in left], columns=[*COLUMNS, "task", "ids"], dtype="object")
        out = pd.concat([out, rest]) if len(out) else rest
    return out


def pack(
    docs: DataFrame, path: str | None = None, length: int = LENGTH, open_windows: int = OPEN, fan: int = FAN, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or vocabulary_path("word_bpe_49k.json")
    kind = dict(docs.dtypes)[id]
    base = docs.select(as_text(id), whole(text).alias("text"))
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        packer, end = Packer(length, open_windows, task << 32), np.array([END_ID], np.uint32)
        for batch in batches:
            keys = batch["doc_id"].astype("object").where(batch["doc_id"].notna(), None)
            for doc, content in zip(keys, batch["text"], strict=True):
                ids = np.concatenate([_encoder(path).encode(content), end])
                packer.add(doc, 0, ids, len(ids))
            yield _frame(packer.rows(), [], task)
        left = packer.close()
        yield _frame(packer.rows(), left, task)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task", kind="stable")
        first = (1 << 62) + (int(group["task"].iloc[0]) // fan << 32)
        packer = Packer(length, open_windows, first)
        keys = group["doc_id"].astype("object").where(group["doc_id"].notna(), None)
        for doc, start, ids, total in zip(keys, group["start"], group["ids"], group["doc_tokens"], strict=True):
            packer.add(doc, int(start), np.frombuffer(ids, "<u4"), int(total))
        window = packer.close()
        if window:
            packer._emit(window)
        return pd.DataFrame(packer.rows(), columns=COLUMNS, dtype="object")

    packed = cut_lineage(base.mapInPandas(fill, f"{schema}, task long, ids binary"))
    full = packed.where("ids is null").select(*COLUMNS)
    left = packed.where("ids is not null").groupBy(F.floor(F.col("task") / fan).alias("many")).applyInPandas(merge, schema)
    return from_text(full.unionByName(left), kind)
