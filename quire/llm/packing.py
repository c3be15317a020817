"""Packing token sequences into as few bins as possible: best fit, then a swap-based local search.

Documents are tokenized whole and get an end id; only those longer than a sequence are cut, into full
pieces and a rest. Full pieces are sequences of their own. The others are dealt by hash into groups of about
`GROUP` pieces, and each group is packed by itself: best fit in decreasing order, then local search.
The search goes through the underfull bins from the least filled on and moves a piece into another one, or exchanges one for one,
two for one or one for two, whichever raises the sum of squared fills most, until the bin is empty or nothing raises it. It ends at
the lower bound, or when no exchange between any two underfull bins raises the sum: no bin is given up before. The loosely filled bins
of all groups are then packed once more among each other, so that groups cost no more than a few bins.

Null or empty text: the end id alone. Very long texts are read whole and cut into pieces. Repeated rows are pieces of their own; of
equally long pieces any may come first (by their number in the table). Other columns are not read. An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import staged
from quire.llm.tokens import pieces, tokenizer_path

#: Pieces of a group, and the fill under which a bin is packed again.
GROUP, LOOSE = 16384, 0.97


def tokenize(docs: DataFrame, capacity: int = 4096, end_id: int = 1, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ordinal (unique) and, if asked for, ids (binary, little-endian
    unsigned 32-bit). Row by row, no shuffle."""
    path, kind = vocabulary or tokenizer_path("word_bpe_49k.json"), dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal, encoder = TaskContext.get().partitionId() << 33, pieces(path, words=True)
        for batch in batches:
            rows, out = [], [[], [], [], [], [], []]
            for i, raw in enumerate(encoder.encode(batch["text"].to_pylist())):
                ids = np.append(np.frombuffer(raw, encoder.dtype), end_id).astype("<u4").tobytes()
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    for column, x in zip(out, (k, at // 4, len(part) // 4, zlib.crc32(part), ordinal, part if with_ids else None), strict=True):
                        column.append(x)
                    ordinal += 1
            columns = [batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:5]), pa.array(out[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ordinal", "ids"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ordinal long, ids binary")
    return found if with_ids else found.drop("ids")


class Bins:
    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        self.least = -(-sum(lengths) // capacity)
        self.known: dict[int, tuple] = {}

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that has room."""
        by_room: dict[int, list[int]] = {}
        rooms = 0  # bit r: some bin has room r
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            n = self.lengths[i]
            if above := rooms >> n:
                room = n + (above & -above).bit_length() - 1
                held = by_room[room]
                b = held.pop()
                if not held:
                    rooms &= ~(1 << room)
                self.bins[b].append(i)
                self.fill[b] += n
                room -= n
            else:
                b, room = len(self.bins), self.capacity - n
                self.bins.append([i])
                self.fill.append(n)
            if room:
                by_room.setdefault(room, []).append(b)
                rooms |= 1 << room

    def _parts(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted, distinct: the pieces' lengths of bin b, and these with 0 and the sums of two; remembered until the bin changes."""
        if b not in self.known:
            items = np.array([self.lengths[x] for x in self.bins[b]], np.int64)
            first, second = np.triu_indices(len(items), 1)
            ones = np.unique(items)
            self.known[b] = ones, np.unique(np.concatenate([[0], ones, items[first] + items[second]]))
        return self.known[b]

    def _best(self, s: int, others: np.ndarray) -> tuple[int, int, int, bool] | None:
        """(bin t, length given by s, length taken from t, are two given?) of the exchange that raises the sum of squared fills
        most: a move, one for one, one for two, or two for one. None if none raises it."""
        fill = np.array([self.fill[t] for t in others], np.int64)
        room, least, found = self.capacity - fill, np.maximum(0, self.fill[s] - fill), None
        ones, sums = self._parts(s)
        pairs = np.setdiff1d(sums, np.append(ones, 0), assume_unique=True) if len(self.bins[s]) > 1 else ones[:0]
        for gives, which, two in ((ones, 1, False), (pairs, 0, True)):
            if not len(gives):
                continue
            takes = [self._parts(t)[which] for t in others]
            count = np.fromiter(map(len, takes), np.int64, len(takes))
            begin = np.arange(len(others), dtype=np.int64) * (2 * self.capacity)
            keys, ends = np.concatenate(takes) + np.repeat(begin, count), np.cumsum(count)
            # for each length given, the least that may be taken back, so that t gets as full as it can
            wanted = np.maximum(0, gives[:, None] - room[None, :])
            at = np.searchsorted(keys, wanted + begin)
            take = keys[np.minimum(at, len(keys) - 1)] - begin
            gain = gives[:, None] - take
            gain[(at >= ends) | (gain <= least)] = 0
            rise = gain * (gain + fill - self.fill[s])
            k = int(rise.argmax())
            i, j = divmod(k, len(others))
            if gain[i, j] > 0 and (found is None or rise[i, j] > found[0]):
                found = int(rise[i, j]), int(others[j]), int(gives[i]), int(take[i, j]), two
        return found and found[1:]

    def _pick(self, b: int, total: int, most: int) -> list[int]:
        """Pieces of bin b, at most so many, whose lengths have that sum."""
        if total == 0:
            return []
        items = self.bins[b]
        for x in items:
            if self.lengths[x] == total:
                return [x]
        return next([x, y] for k, x in enumerate(items) for y in items[k + 1 :] if most > 1 and self.lengths[x] + self.lengths[y] == total)

    def local_search(self) -> None:
        """Empty bins by exchanges that raise the sum of squared fills. Each accepted exchange raises it, so this ends: when
        the bins are as few as their total length allows, or when no exchange between two underfull bins raises it."""
        live, clock = sum(1 for b in self.bins if b), 1
        changed, tested = dict.fromkeys(range(len(self.bins)), 1), dict.fromkeys(range(len(self.bins)), 0)
        moving = True
        while moving and live > self.least:
            moving = False
            for s in sorted((b for b in changed if self.bins[b] and self.fill[b] < self.capacity), key=lambda b: (self.fill[b], b)):
                while self.bins[s] and self.fill[s] < self.capacity and live > self.least:
                    # pairs that failed before fail again unless one of the two has changed
                    since = 0 if changed[s] > tested[s] else tested[s]
                    others = np.array([t for t in changed if t != s and changed[t] > since and self.bins[t] and self.fill[t] < self.capacity], np.int64)
                    tested[s] = clock
                    if not len(others) or not (found := self._best(s, others)):
                        break
                    t, given, taken, two = found
                    give, take = self._pick(s, given, 2 if two else 1), self._pick(t, taken, 1 if two else 2)
                    self.bins[s] = [x for x in self.bins[s] if x not in give] + take
                    self.bins[t] = [x for x in self.bins[t] if x not in take] + give
                    self.fill[s] -= given - taken
                    self.fill[t] += given - taken
                    clock += 1
                    for b in (s, t):
                        changed[b] = clock
                        self.known.pop(b, None)
                    moving = True
                    live -= not self.bins[s]


def pack(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin, offset in it and the bin's fill, for each length."""
    state = Bins(lengths, capacity)
    state.best_fit()
    state.local_search()
    where, offset, fill = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
    for b, items in enumerate(state.bins):
        at = 0
        for i in items:
            where[i], offset[i], fill[i] = b, at, state.fill[b]
            at += lengths[i]
    return where, offset, fill


def _packed(items: DataFrame, capacity: int, n: int, round_no: int) -> DataFrame:
    groups = max(1, -(-n // GROUP))
    grouped = items.withColumn("grp", F.pmod(F.xxhash64("ordinal", F.lit(round_no)), F.lit(groups)))
    kinds = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal", ignore_index=True)
        where, offset, fill = pack(pdf["length"].tolist(), capacity)
        first = (round_no << 60) + (int(pdf["grp"].iloc[0]) << 32)
        return pdf.drop(columns="grp").assign(sequence_id=np.array(where, np.int64) + first, offset=np.array(offset, np.int64), fill=np.array(fill, np.int64))

    return grouped.groupBy("grp").applyInPandas(run, f"{kinds}, sequence_id long, `offset` long, fill long")


def pack_pieces(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """`items` (a stored table with length and a unique ordinal) with sequence_id and offset."""
    whole = items.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("ordinal"), "offset": F.lit(0).cast("long")})
    rest = items.where(F.col("length") < capacity)
    n = rest.count()
    first = staged(_packed(rest, capacity, n, 1), "packed")
    if n <= GROUP:
        return whole.unionByName(first.drop("fill"))
    tight, loose = first.where(F.col("fill") >= LOOSE * capacity), first.where(F.col("fill") < LOOSE * capacity)
    again = _packed(loose.drop("sequence_id", "offset", "fill"), capacity, loose.count(), 2)
    return whole.unionByName(tight.drop("fill")).unionByName(again.drop("fill"))


def pack_documents(docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    items = staged(tokenize(docs, capacity, vocabulary=vocabulary), "pieces")
    return pack_pieces(items, capacity).drop("ordinal")
