"""Token ids in a compact binary table, coded by a static range asymmetric numeral system.

All blocks share one frequency table.  A segment holds whole documents; its ids
are cut into blocks, and each block is coded by interleaved states that take turns
over its ids, so one vectorised step codes an id of every state of every block.
Blocks are independent, carry a checksum, and hold checkpoints (states and stream
position) from which decoding can start inside.

The file format is a Parquet table, so that any store Spark reaches will do.  A
row is a segment: its part and number, its first doc_id, its tokens, the names
and lengths of its documents, its blocks.  Parts, and segments of a part, follow
each other by their first doc_id.  A second table of the same folder holds the frequencies.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batched import column_encoder
from .chunked import afresh, encoder
from .common import Scratch, drop_scratch, running, scratch_path, small_batches, table

#: Fixed values of the format: frequency bits, least state, states of a block, steps of a block, steps between checkpoints.
SCALE, LOW, LANES, STEPS, CHECK = 20, 1 << 31, 64, 512, 256
BLOCK = LANES * STEPS
_SCALE, _LOW, _32 = np.uint64(SCALE), np.uint64(LOW), np.uint64(32)


class Frequencies:
    """Shares of 2**SCALE for all ids that occur, one at least."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        total, room = int(counts.sum()), 1 << SCALE
        if len(ids) > room:
            raise ValueError("more distinct ids than shares")
        share = np.maximum(1, (counts.astype(float) * room / max(total, 1)).astype(np.int64))
        # the rounding's rest is settled with the most frequent ids
        order, off = np.argsort(-share, kind="stable"), room - int(share.sum())
        k = 0
        while off and len(share):
            i = order[k % len(order)]
            change = off if off > 0 else -min(-off, int(share[i]) - 1)
            share[i] += change
            off -= change
            k += 1
        self.ids, self.share = ids.astype(np.int64), share
        size = int(ids.max()) + 1 if len(ids) else 1
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[self.ids] = share
        self.start[self.ids] = np.cumsum(share) - share
        self.slot = np.repeat(self.ids, share).astype(np.uint32)


def encode_blocks(x: np.ndarray, f: Frequencies) -> list[dict]:
    """Codes ids (blocks, steps * LANES), id i in state i % LANES, at once."""
    blocks, steps = len(x), x.shape[1] // LANES
    ids = x.reshape(blocks, steps, LANES)
    state = np.full((blocks, LANES), LOW, np.uint64)
    words = np.zeros((steps, blocks, LANES), np.uint32)
    out = np.zeros((steps, blocks, LANES), bool)
    checks = []
    for t in range(steps - 1, -1, -1):
        i = ids[:, t]
        freq = f.freq[i]
        full = state >= freq << np.uint64(63 - SCALE)
        words[t], out[t] = state, full
        state = np.where(full, state >> _32, state)
        whole = state // freq
        state = (whole << _SCALE) + (state - whole * freq) + f.start[i]
        if t and t % CHECK == 0:
            checks.append((t, state.copy()))
    by_block, shown = words.transpose(1, 0, 2), out.transpose(1, 0, 2)
    done = []
    for b in range(blocks):
        stream = by_block[b][shown[b]]
        before = np.cumsum(shown[b].sum(axis=1))
        marks = [(t, int(before[t - 1]), s[b].tobytes()) for t, s in reversed(checks)]
        done.append({"stream": stream.tobytes(), "states": state[b].tobytes(), "marks": marks})
    return done


def decode_blocks(blocks: list[dict], steps: int, f: Frequencies, first: int = 0) -> np.ndarray:
    """Ids (blocks, (steps - first) * LANES); ``first`` may be 0 or a checkpoint's step.  Words that a damaged stream lacks count as 0; checksums tell."""
    streams = [np.frombuffer(b["stream"], "<u4") for b in blocks]
    start = [0] * len(blocks)
    states = [b["states"] for b in blocks]
    if first:
        marks = [next(m for m in b["marks"] if m[0] == first) for b in blocks]
        start, states = [m[1] for m in marks], [m[2] for m in marks]
    base = np.cumsum([0, *map(len, streams[:-1])])
    stream = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
    at = (base + np.array(start)).astype(np.int64)
    state = np.stack([np.frombuffer(s, np.uint64) for s in states])
    out = np.empty((len(blocks), steps - first, LANES), np.uint32)
    low = np.uint64((1 << SCALE) - 1)
    for t in range(steps - first):
        slot = state & low
        ids = f.slot[slot]
        out[:, t] = ids
        state = f.freq[ids] * (state >> _SCALE) + slot - f.start[ids]
        need = state < _LOW
        rank = np.cumsum(need, axis=1)
        take = np.where(need, np.minimum(at[:, None] + rank - 1, len(stream) - 1), 0)
        state = np.where(need, state << _32 | stream[take], state)
        at += rank[:, -1]
    return out.reshape(len(blocks), -1)


def encode_segment(ids: np.ndarray, f: Frequencies) -> list[dict]:
    """Blocks of one segment: the last one is filled up with the first known id."""
    out = []
    n_full = len(ids) // BLOCK
    if n_full:
        out += encode_blocks(ids[: n_full * BLOCK].reshape(n_full, BLOCK).astype(np.int64), f)
    rest = ids[n_full * BLOCK :]
    if len(rest):
        padded = np.full(-(-len(rest) // LANES) * LANES, f.ids[0], np.int64)
        padded[: len(rest)] = rest
        out += encode_blocks(padded[None], f)
    for k, b in enumerate(out):
        part = ids[k * BLOCK : (k + 1) * BLOCK]
        b |= {"n": len(part), "crc": zlib.crc32(part.astype("<u4").tobytes())}
    return out


def decode_range(block: dict, f: Frequencies, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of one block, decoded from the last checkpoint before them."""
    steps = -(-block["n"] // LANES)
    first = max([m[0] for m in block["marks"] if m[0] * LANES <= start], default=0)
    return decode_blocks([block], steps, f, first)[0][start - first * LANES : end - first * LANES]


def decode_segment(blocks: list[dict], f: Frequencies) -> np.ndarray:
    """All ids of a segment; raises if a block's checksum differs."""
    full = [b for b in blocks if b["n"] == BLOCK]
    parts = list(decode_blocks(full, STEPS, f)) if full else []
    for b in blocks[len(full) :]:
        parts.append(decode_blocks([b], -(-b["n"] // LANES), f)[0][: b["n"]])
    for b, p in zip(blocks, parts):
        if zlib.crc32(p.astype("<u4").tobytes()) != b["crc"]:
            raise ValueError("a block's checksum differs")
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


_BLOCK = pa.struct([("stream", pa.binary()), ("states", pa.binary()), ("marks", pa.list_(pa.struct([("step", pa.int32()), ("at", pa.int32()), ("states", pa.binary())]))), ("n", pa.int32()), ("crc", pa.int64())])
_BLOCK_SQL = "array<struct<stream:binary,states:binary,marks:array<struct<step:int,at:int,states:binary>>,n:int,crc:bigint>>"
SEGMENT = f"part long, segment long, low long, n long, docs array<bigint>, lengths array<bigint>, blocks {_BLOCK_SQL}"


def _tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of tokens (part, doc_id, ids), and for each task its counts of ids (doc_id null, ids null, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, press = column_encoder(path), TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
        total = np.zeros(max(enc.rules.vocabulary, end_id + 1), np.int64)
        end = np.array([end_id], enc.dtype).tobytes()

        def rows(names: list, ids: list, counts: list) -> pa.RecordBatch:
            arrays = [pa.array([part] * len(names), pa.int64()), pa.array(names, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["part", "doc_id", "ids", "counts"])

        for batch in batches:
            names = batch["doc_id"].to_pylist()
            for i, j, ids, ends in enc.encode(batch["text"]):
                total += np.bincount(ids, minlength=len(total))
                total[end_id] += j - i
                raw, at = ids.tobytes(), (ends * enc.dtype.itemsize).tolist()
                yield rows(names[i:j], [press.compress(raw[a:b] + end) for a, b in zip([0, *at], at)], [None] * (j - i))
        yield rows([None], [None], [zlib.compress(total.astype("<i8").tobytes())])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part long, doc_id long, ids binary, counts binary")


def _frequencies(tokens: DataFrame) -> Frequencies:
    """The tasks' counts summed; what comes to the driver is a row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for c in batch["counts"].to_pylist():
                got = np.frombuffer(zlib.decompress(c), "<i8")
                total = got if total is None else total + got
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    rows = tokens.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    rows.sort()
    return Frequencies(np.array([r["id"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64))


def _in_order(ranges: DataFrame, low: str, high: str) -> bool:
    """Whether ranges that follow each other by their lower ends never touch."""
    scratch = Scratch(ranges.sparkSession)
    good = running(ranges.select(low, high), [low, high], scratch, high=high).where(F.col("before") >= F.col(low)).isEmpty()
    scratch.drop()
    return good


def _segments(tokens: DataFrame, f: Frequencies, vocabulary: int, segment: int) -> DataFrame:
    """SEGMENT rows of tokens whose tasks read them in order; a segment lies in one part."""
    dtype = np.dtype("<u2") if vocabulary <= 65_536 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size, now = TaskContext.get().partitionId(), 0, 0, None
        names: list[int | None] = []
        held: list[bytes] = []
        press = zstandard.ZstdDecompressor()

        def flush() -> pa.RecordBatch:
            nonlocal names, held, size, number
            lengths = [len(b) // dtype.itemsize for b in held]
            ids = np.frombuffer(b"".join(held), dtype)
            blocks = [b | {"marks": [dict(zip(("step", "at", "states"), m)) for m in b["marks"]]} for b in encode_segment(ids, f)]
            one = [[now], [task << 32 | number], [names[0]], [len(ids)], [names], [lengths], [blocks]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(_BLOCK)]
            number, names, held, size = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(one, kinds)], ["part", "segment", "low", "n", "docs", "lengths", "blocks"])

        for batch in batches:
            for part, name, packed in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
                if held and (part != now or size >= segment):
                    yield flush()
                now = part
                names.append(name)
                held.append(press.decompress(packed))
                size += len(held[-1]) // dtype.itemsize
        if held:
            yield flush()

    small_batches(tokens.sparkSession)
    return tokens.select("part", "doc_id", "ids").mapInArrow(afresh(run), SEGMENT)


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, segment: int = 32 * BLOCK, part_bytes: int = 48 << 20) -> None:
    """Writes the ids of all rows of ``docs`` (doc_id, text), each followed by ``end_id``, in ascending doc_id order.

    Null texts are empty ones; null doc_ids come first; rows that share a doc_id
    are ordered by their ids.  Texts are encoded once.  Where the tasks that read
    them hold ranges of doc_id that don't overlap, as with clustered input, ids
    stay in the tasks' parts; otherwise they are dealt by ranges of doc_id.
    """
    spark, between = docs.sparkSession, f"{folder}/unordered"
    _tokens(docs, path, end_id).write.option("compression", "none").parquet(between)
    tokens = spark.read.parquet(between)
    f = _frequencies(tokens)
    spark.createDataFrame([(json.dumps({"ids": f.ids.tolist(), "share": f.share.tolist()}),)], "frequencies string").coalesce(1).write.text(f"{folder}/frequencies")
    vocabulary, rows = encoder(path).vocabulary, tokens.where("ids is not null")
    ends = rows.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    done = False
    if ends.where("unnamed").isEmpty() and _in_order(ends, "low", "high"):
        _segments(rows.sortWithinPartitions("part", "doc_id", "ids"), f, vocabulary, segment).write.option("compression", "none").parquet(f"{folder}/segments")
        # a file read in two tasks may have been out of order inside
        told = spark.read.parquet(f"{folder}/segments").select("low", F.array_max("docs").alias("high"), "segment")
        done = _in_order(told, "low", "high")
        if not done:
            drop_scratch(spark, f"{folder}/segments")
    if not done:
        size = rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, -(-int(size) // part_bytes))
        dealt = rows.repartitionByRange(parts, F.col("doc_id"), F.xxhash64("ids")).withColumn("part", F.spark_partition_id().cast("long"))
        _segments(dealt.sortWithinPartitions("doc_id", "ids"), f, vocabulary, segment).write.option("compression", "none").parquet(f"{folder}/segments")
    drop_scratch(spark, between)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document of a folder that write() made."""
    told = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/frequencies").collect()))
    f = Frequencies(np.array(told["ids"], np.int64), np.array(told["share"], np.int64))
    segments = spark.read.parquet(f"{folder}/segments")
    some = segments.select("part", "segment", "low", "n")
    # parts follow each other by their first doc_id, segments inside a part likewise
    parts = some.groupBy(F.col("part").alias("_p")).agg(F.min(F.struct("low")).alias("first"))
    some = some.join(parts, F.col("part") == F.col("_p")).select("first", "part", "low", "segment", "n")
    places = running(some, ["first", "part", "low", "segment"], Scratch(spark), value="n").select("segment", F.coalesce("before", F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                blocks = [b | {"marks": [(m["step"], m["at"], m["states"]) for m in b["marks"]]} for b in r["blocks"]]
                ids = decode_segment(blocks, f).astype("<u4")
                ends = np.cumsum(r["lengths"])
                starts = ends - r["lengths"]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                found = [ids[a:b].astype("i4") for a, b in zip(starts, ends)] if with_ids else [None] * len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["docs"], pa.int64()), pa.array([r["segment"]] * len(ends), pa.int64()), pa.array(starts, pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array(crcs, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                    ["doc_id", "segment", "at", "n_tokens", "ids_crc32", "ids"],
                )

    small_batches(spark, 8)
    got = segments.select("segment", "docs", "lengths", "blocks").mapInArrow(afresh(run), "doc_id long, segment long, at long, n_tokens long, ids_crc32 long, ids array<int>")
    got = got.join(places, "segment").withColumn("start", F.col("at") + F.col("before"))
    return got.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op3_token_binary(spark: SparkSession, sf_dir: str, file: str = "byte_bpe_50k.json") -> DataFrame:
    """Writes the ids of all documents and reads them back."""
    folder = scratch_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(file))
    return read(spark, folder, with_ids=False)
