"""Packing documents into training windows by minimum bin slack.

A document fills whole windows by itself; what remains of it is packed with the
remainders of others.  For each window the longest remainder is set in, and a
bitset dynamic programme over the lengths left finds the multiset that fills the
window closest to its capacity; backtracking gives how many of each length it
takes, and the same multiset is used as often as the counts allow.  A multiset that
leaves a little slack waits for other remainders; when the task ends, or too many wait,
its slack is filled with a cut from the multisets that are filled worst.  What is left
then is less than a window and is cut into powers of two, which need no padding.

Every task packs what it reads, so nothing is shuffled; remainders wait in a pool
whose size bounds a task's memory: at ``pool`` of them windows are made, and if more
than half can't be filled, they are topped up, as at the end.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .chunked import encoder, slices, trim
from .common import small_batches, table

#: Rows of the result.
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def closest_fill(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths, at most as often as ``counts`` has them, whose sum comes closest to ``capacity`` from below.

    Bit s of ``reach`` tells whether the sum s is possible; the sets before each
    step are kept to walk back.
    """
    reach, steps = 1, []
    mask, goal = (1 << (capacity + 1)) - 1, 1 << capacity
    for length in sorted((k for k, n in counts.items() if n and k <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left:  # 1, 2, 4, ... copies at once
            take = min(take, left)
            grown = (reach | reach << (length * take)) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            take *= 2
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * take
            at -= length * take
    return out


def windows(counts: Counter, capacity: int) -> Iterator[tuple[list[int], int]]:
    """(lengths of a window, how many windows are filled so), until all of ``counts`` is used up."""
    left = Counter({k: n for k, n in counts.items() if n})
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = closest_fill(left, capacity - longest)
        left[longest] += 1
        used = Counter([longest, *rest])
        times = min(left[k] // n for k, n in used.items())
        yield sorted(used.elements(), reverse=True), times
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


class Packer:
    """Takes documents one by one, gives (piece, sequence, offset) once its window is full."""

    def __init__(self, capacity: int, first_sequence: int, pool: int = 16_384):
        self.capacity, self.sequence, self.pool = capacity, first_sequence, pool
        self.waiting: list[Piece] = []

    def _emit(self, pieces: list[Piece]) -> list[tuple[Piece, int, int]]:
        out, offset = [], 0
        for p in pieces:
            out.append((p, self.sequence, offset))
            offset += len(p.ids)
        self.sequence += 1
        return out

    def add(self, doc: int | None, ids: np.ndarray) -> list[tuple[Piece, int, int]]:
        out, n, c = [], len(ids), self.capacity
        for start in range(0, n - n % c, c):
            out += self._emit([Piece(doc, start, ids[start : start + c], n)])
        if n % c:
            self.waiting.append(Piece(doc, n - n % c, ids[n - n % c :].copy(), n))
        return out + (self._pack() if len(self.waiting) >= self.pool else [])

    def _pack(self, last: bool = False) -> list[tuple[Piece, int, int]]:
        """Fills windows from the pool; what would leave one short waits on, or is topped up."""
        by: dict[int, list[Piece]] = defaultdict(list)
        for p in reversed(self.waiting):
            by[len(p.ids)].append(p)
        out, short, n = [], [], 0
        for lengths, times in windows(Counter({k: len(v) for k, v in by.items()}), self.capacity):
            for _ in range(times):
                pieces = [by[k].pop() for k in lengths]
                if sum(lengths) == self.capacity:
                    out += self._emit(pieces)
                else:
                    short.append(pieces)
                    n += len(pieces)
        if last or n > self.pool // 2:
            return out + self._top_up(short)
        self.waiting = [p for pieces in short for p in pieces]
        return out

    def _top_up(self, groups: list[list[Piece]]) -> list[tuple[Piece, int, int]]:
        """Fills the slack of groups, the fullest first, with cuts from the emptiest; less than a window waits on."""
        groups = sorted(groups, key=lambda g: -sum(len(p.ids) for p in g))
        out, fillers, i, j = [], [], 0, len(groups)
        while i < j:
            now, room = list(groups[i]), self.capacity - sum(len(p.ids) for p in groups[i])
            i += 1
            while room and (fillers or i < j):
                if not fillers:
                    j -= 1
                    fillers = list(groups[j])
                p = fillers.pop()
                if len(p.ids) > room:
                    fillers.append(Piece(p.doc, p.start + room, p.ids[room:], p.doc_tokens))
                    p = Piece(p.doc, p.start, p.ids[:room], p.doc_tokens)
                now.append(p)
                room -= len(p.ids)
            if room:
                fillers += now
            else:
                out += self._emit(now)
        self.waiting = fillers
        return out

    def finish(self) -> list[tuple[Piece, int, int]]:
        """All that waits: full windows, then powers of two."""
        out = self._pack(last=True)
        left = sum(len(p.ids) for p in self.waiting)
        rest, self.waiting = self.waiting[::-1], []
        while rest:
            room, now = min(self.capacity, 1 << (left.bit_length() - 1)), []
            left -= room
            while room:
                p = rest.pop()
                if len(p.ids) > room:
                    rest.append(Piece(p.doc, p.start + room, p.ids[room:], p.doc_tokens))
                    p = Piece(p.doc, p.start, p.ids[:room], p.doc_tokens)
                now.append(p)
                room -= len(p.ids)
            out += self._emit(now)
        return out


def rows(got: list[tuple[Piece, int, int]], with_ids: bool, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """SCHEMA batches of ``most`` ids each, one piece at least: a pool gives millions at once, which would lie in this process and in the JVM several times."""
    i, n = 0, 0
    for j in range(len(got) + 1):
        size = len(got[j][0].ids) if j < len(got) else most + 1
        if j > i and n + size > most:
            some, values, ends = got[i:j], np.empty(n, "<i4"), np.cumsum([0, *(len(p.ids) for p, _, _ in got[i:j])])
            for (p, _, _), a, b in zip(some, ends, ends[1:]):
                values[a:b] = p.ids
            columns = [
                [p.doc for p, _, _ in some], [p.start for p, _, _ in some], np.diff(ends), [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:])],
                [p.doc_tokens for p, _, _ in some], [s for _, s, _ in some], [o for _, _, o in some],
            ]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)) if with_ids else pa.nulls(len(some), pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
            i, n = j, 0
        n += size


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """SCHEMA rows, one for each piece of each row of ``docs`` (doc_id, text; other columns are dropped).

    Null and empty texts are the end id alone; repeated rows and equal doc_ids are
    packed each; a very long text fills windows by itself; an empty table gives no
    rows.  ``ids`` is null unless ``with_ids``.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            names, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for i, j in slices(texts):
                out = []
                for doc, text in zip(names[i:j], texts[i:j]):
                    out += packer.add(doc, np.frombuffer(enc.one(text) + end, enc.dtype))
                yield from rows(out, with_ids)
        yield from rows(packer.finish(), with_ids)
        trim()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str, file: str = "word_bpe_49k.json", capacity: int = 2048) -> DataFrame:
    """All documents packed into windows of ``capacity`` tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(file), capacity, with_ids=False).drop("ids")
