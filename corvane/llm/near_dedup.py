"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A text is the multiset of its five-word shingles.  For each shingle a Poisson
process of points (time, height, component) is drawn from the shingle's hash, in
height intervals (0,1], (1,2], (2,4], (4,8], ...: a text with the shingle n times
sees the points of height n or less.  The first point of each component is its
signature; two texts agree in a component with a probability equal to their
weighted Jaccard similarity.  Only points before a time limit that fits the text's
weight are drawn, so long texts cost little more than reading them.

Bands of the signature are buckets.  Every member of a bucket is compared with the
bucket's first member, the links are closed to classes, and then with a member
drawn for each bucket where classes still differ.  What is left are members of one
bucket in different classes.  They meet in blocks of bounded size, as vectors of
hashed shingle counts: the sum of the smaller counts is never less than the overlap
of two bags, so pairs whose sum is too small can't be links and never leave the
block.  The few others are verified.  So no link between two texts of a bucket is
lost, and no group is expanded into its pairs.  Similarity is always verified on the
whole shingle multisets, and a text travels once for up to ``HUB`` of its partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunked import afresh, slices
from .common import Scratch, small_batches, table

BANDS, ROWS = 30, 6
#: Partners that one copy of a text serves, members of a block, places of a count vector, bytes that are hashed at once.
HUB, BLOCK, PLACES, PIECE = 256, 128, 512, 1 << 21
_M = BANDS * ROWS
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_WORD = (1 << 64) - 1


def _times_gold(n: int) -> np.uint64:
    return np.uint64(n * int(_GOLD) & _WORD)


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of shifts and odd products."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse; tables of more than PIECE are not kept."""
    got = _powers
    if len(got.get("up", ())) < n:
        got = {}
        for name, base in (("up", _BASE), ("down", _BASE_BACK)):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            got[name] = np.multiply.accumulate(x)
        if n <= 2 * PIECE:
            _powers.update(got)
    return got["up"], got["down"]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and their hashes.  Bytes are hashed in pieces that end at white space, so memory follows the longest word."""
    buffer = np.frombuffer(data, np.uint8)
    starts, words, at = [], [], 0
    while at < len(buffer):
        end = min(len(buffer), at + PIECE)
        while end < len(buffer) and not _WHITE[buffer[end - 1]]:
            more = np.flatnonzero(_WHITE[buffer[end : end + PIECE]])
            end = min(len(buffer), end + (int(more[0]) + 1 if len(more) else PIECE))
        part = buffer[at:end]
        inside = ~_WHITE[part]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        first, last = edge[::2], edge[1::2]
        up, down = _power(len(part) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[part] * up[: len(part)])])
        words.append(_mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _GOLD))
        starts.append(first + at)
        at = end
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none.astype(np.uint64), *words])


def shingles(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The hashes of all shingles of each text, repeats included.

    Words are what ASCII white space separates.  A text of fewer words than
    ``width`` is one shingle; one without words has none.
    """
    parts = [(t or "").encode() for t in texts]
    ends_of = np.cumsum([len(p) + 1 for p in parts])
    starts, word = _word_hashes(b" ".join(parts) + b" ")
    cuts = np.searchsorted(starts, ends_of)
    out, first = [], 0
    odd = _mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(word) - width + 1
    if n > 0:
        joined = word[:n] * odd[0]
        for k in range(1, width):
            joined = joined + word[k : k + n] * odd[k]
        joined = _mix(joined)
    for last in cuts:
        if last - first >= width:
            out.append(joined[first : last - width + 1])
        elif last > first:
            few = word[first:last]
            out.append(_mix((few * odd[: len(few)]).sum(keepdims=True) + _times_gold(len(few))))
        else:
            out.append(np.zeros(0, np.uint64))
        first = last
    return out


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = _M) -> np.ndarray:
    """(bags, m) uint64 BagMinHash signatures of non-empty bags (distinct hashes, counts)."""
    out = np.zeros((len(bags), m), np.uint64)
    if not bags:
        return out
    weight = np.array([c.sum() for _, c in bags], float)
    limit = (np.log(m) + 2.0) * m / weight
    todo = np.arange(len(bags))
    while len(todo):
        unfilled = _draw([bags[i] for i in todo], limit[todo], m, out, todo)
        todo = todo[unfilled]
        limit[todo] *= 3
    return out


def _draw(bags, limit: np.ndarray, m: int, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Draws all points before the limits; tells which bags have a component without any."""
    of = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    element, count = np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags])
    best = np.full(len(bags) * m, np.inf)
    mark = np.zeros(len(bags) * m, np.uint64)
    level, low, high = 0, 0, 1
    while len(of):
        seed = _mix(element + _times_gold(level + 1))
        a_of, a_seed, a_count, time = of, seed, count, np.zeros(len(of))
        rate, step = float(high - low), 0
        while len(a_of):
            step += 1
            point = _mix(a_seed + _times_gold(step))
            u = ((point >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
            time = time - np.log(u) / rate
            on = time <= limit[a_of]
            a_of, a_seed, a_count, time, point = a_of[on], a_seed[on], a_count[on], time[on], point[on]
            where = _mix(point ^ _GOLD)
            slot = a_of * m + (where % np.uint64(m)).astype(np.int64)
            if high - low > 1:
                height = low + 1 + ((where >> np.uint64(32)) % np.uint64(high - low)).astype(np.int64)
                seen = height <= a_count
                slot, t, p = slot[seen], time[seen], point[seen]
            else:
                t, p = time, point
            np.minimum.at(best, slot, t)
            won = t == best[slot]
            mark[slot[won]] = p[won]
        level, low, high = level + 1, high, high * 2
        more = count > low
        of, element, count = of[more], element[more], count[more]
    out[rows] = mark.reshape(-1, m)
    return ~np.isfinite(best.reshape(-1, m)).all(axis=1)


def bag(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, key (of the text), weight (shingles) and buckets of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = _mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        place = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
        for batch in batches:
            texts = batch["text"].to_pylist()
            buckets, weights = [], []
            for i, j in slices(texts, 1_500_000):
                got = shingles(texts[i:j])
                full = [k for k, s in enumerate(got) if len(s)]
                sig = signatures([bag(got[k]) for k in full], bands * rows).reshape(-1, bands, rows)
                hashed = _mix((sig * salt).sum(axis=2) + place).view(np.int64)
                by = dict(zip(full, hashed))
                buckets += [by.get(k) for k in range(j - i)]
                weights += [len(s) for s in got]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["key"], pa.array(weights, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "key", "weight", "buckets"]
            )

    small_batches(docs.sparkSession)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5("text").alias("key"))
    return some.mapInArrow(afresh(run), "doc_id long, key string, weight long, buckets array<long>")


def count_vector(hashes: np.ndarray) -> tuple[bytes, int]:
    """How many shingles have each hashed place, up to 255 each, and how many are beyond that."""
    n = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % PLACES, minlength=PLACES)
    kept = np.minimum(n, 255)
    return kept.astype(np.uint8).tobytes(), int((n - kept).sum())


def most_overlap(one: np.ndarray, one_beyond: int, others: np.ndarray, others_beyond: np.ndarray) -> np.ndarray:
    """No less than the shingles that one bag shares with each of others, from their count_vector()s."""
    return np.minimum(one[None], others).sum(axis=1, dtype=np.int64) + np.minimum(one_beyond, others_beyond)


def _verified(pairs: DataFrame, texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose texts overlap by ``least`` or more.

    The partners of a node are dealt to groups of about HUB; each group gets the
    node's text once, before its partners', and holds one bag and a batch.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).alias("groups"))
    dealt = scratch.kept(pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).alias("g"), "b"), "near-dealt")
    partners = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "g", F.lit(1).alias("partner"), "b", "text")
    hubs = dealt.select("a", "g").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "g", F.lit(0).alias("partner"), F.col("a").alias("b"), "text")
    rows = hubs.union(partners).repartition("a", "g").sortWithinPartitions("a", "g", "partner", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            a, b, partner, bodies = (batch[k].to_pylist() for k in ("a", "b", "partner", "text"))
            good = []
            for i, j in slices(bodies, 1_500_000):
                for k, s in zip(range(i, j), shingles(bodies[i:j])):
                    if not partner[k]:
                        hub = bag(s)
                    elif overlap(hub, bag(s)) >= least - 1e-12:
                        good.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], ["a", "b"])

    small_batches(pairs.sparkSession)
    return scratch.kept(rows.select("a", "partner", "b", "text").mapInArrow(afresh(run), "a long, b long"), "near-links")


_MEMBER = "array<struct<node:bigint,label:bigint,weight:bigint,counts:binary,beyond:bigint>>"


def _possible(left: DataFrame, texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of ``left`` (bucket, node, weight, label, n) that share a bucket, are in different classes and may overlap by ``least``.

    The members of a bucket lie in blocks of about BLOCK: classes of more than half
    of that in blocks of their own, the others together, whole.  Two blocks of one
    class don't meet.
    """

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, got = batch["text"].to_pylist(), []
            for i, j in slices(bodies, 1_500_000):
                got += [count_vector(s) for s in shingles(bodies[i:j])]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([c for c, _ in got], pa.binary()), pa.array([r for _, r in got], pa.int64())], ["node", "counts", "beyond"])

    small_batches(left.sparkSession)
    some = texts.join(left.select("node").distinct(), "node", "left_semi").select("node", "text")
    some = scratch.kept(some.mapInArrow(afresh(vectors), "node long, counts binary, beyond long"), "near-counts")
    sizes = left.groupBy("bucket", "label").agg(F.count("*").alias("own"))
    own = F.col("own") > BLOCK // 2
    place = F.when(own, F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / BLOCK))).otherwise(F.pmod(F.xxhash64("label"), F.ceil(F.col("n") / BLOCK)))
    rows = left.join(sizes, ["bucket", "label"]).withColumns({"class": F.when(own, F.col("label")).otherwise(F.lit(-1)), "place": place}).join(some, "node")
    blocks = rows.groupBy("bucket", "class", "place").agg(F.collect_list(F.struct("node", "label", "weight", "counts", "beyond")).alias("members"))
    blocks = scratch.kept(blocks, "near-blocks")
    p, q = blocks.alias("p"), blocks.alias("q")
    ordered = F.struct("p.class", "p.place") <= F.struct("q.class", "q.place")
    other = (F.col("p.class") != F.col("q.class")) | (F.col("p.class") < 0)
    meet = p.join(q, (F.col("p.bucket") == F.col("q.bucket")) & ordered & other)
    meet = meet.select(F.col("p.members").alias("x"), F.col("q.members").alias("y"), ((F.col("p.class") == F.col("q.class")) & (F.col("p.place") == F.col("q.place"))).alias("same"))

    def unpacked(members: pa.StructArray) -> tuple[np.ndarray, ...]:
        number = [members.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("node", "label", "weight", "beyond")]
        return (*number, np.frombuffer(b"".join(members.field("counts").to_pylist()), np.uint8).reshape(-1, PLACES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                node, label, weight, beyond, counts = unpacked(batch["x"][k].values)
                node2, label2, weight2, beyond2, counts2 = unpacked(batch["y"][k].values)
                same, found = batch["same"][k].as_py(), set()
                for i in range(len(node)):
                    near = (label2 != label[i]) & (np.minimum(weight2, weight[i]) >= least * np.maximum(weight2, weight[i]) - 1e-9)
                    if same:
                        near[: i + 1] = False
                    at = np.flatnonzero(near)
                    if len(at):
                        most = most_overlap(counts[i], beyond[i], counts2[at], beyond2[at])
                        at = at[most >= least * (weight[i] + weight2[at] - most) - 1e-9]
                        found |= {(min(node[i], m), max(node[i], m)) for m in node2[at]}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    small_batches(left.sparkSession, 16)
    pairs = scratch.kept(meet.mapInArrow(afresh(run), "a long, b long").distinct(), "near-possible")
    small_batches(left.sparkSession)
    return pairs


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label for all nodes of links (a, b): label is the least node of the connected component.

    Each round takes the least label of the neighbours and then the label of that
    label, until nothing changes; links and labels stay distributed.
    """
    both = scratch.kept(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-edges")
    labels = scratch.kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        upper = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = scratch.kept(step.join(upper, "label").select("node", "old", F.least("label", "up").alias("label")), "near-labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (node, label) after more links (a, b): only the classes that they join are walked, not their members."""
    name = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    ends = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    between = scratch.kept(ends.where("a <> b").distinct(), "near-between")
    if between.isEmpty():
        return labels
    moved = components(between, scratch)
    told = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return scratch.kept(told.union(moved.join(labels.select("node"), "node", "left_anti").select("node", "label")), "near-labels")


def near_classes(docs: DataFrame, least: float = 0.8, bands: int = BANDS, rows: int = ROWS, hold: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate classes of ``docs`` (doc_id, text; other columns are ignored, whatever their names).

    First result, a row for each row of ``docs``: doc_id, key, class_id (the least
    doc_id of its class), class_texts (distinct texts in it) and class_key (the key
    of the text that stays, null without words).  Second, a row for
    each class of two rows or more: the doc_id and key that stay, and how many rows
    have both.  Null, empty and blank texts are in no class with others, equal or
    not; repeated rows are one class; a null doc_id is the least; of texts whose
    least doc_id is the same, the one with the least md5 stays; an empty table gives
    no rows.  A very long text is hashed piece by piece.

    A pair of similarity s shares a bucket with a probability of 1 - (1 - s**rows)**bands,
    0.9999 for 0.8; pairs that share one are found for sure.  Up to ``hold`` rows of
    names are given to all tasks at once, more are joined by a shuffle; the rows are
    the same.
    """
    spark = docs.sparkSession
    scratch, result = Scratch(spark), Scratch(spark)
    signed = result.kept(_signed(docs, bands, rows), "near-signed")
    worded = signed.where("weight > 0")
    per = worded.groupBy("key", "doc_id").agg(F.count("*").alias("n"), F.first("weight").alias("weight"))
    per = per.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("one"), F.sum("n").alias("n_rows"), F.first("weight").alias("weight"))
    # buckets are joined by one row of each text
    texts = worded.dropDuplicates(["key"]).select("key", "buckets").join(per, "key")
    nodes = scratch.kept(texts.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    members = nodes.select("node", "weight", F.explode("buckets").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min(F.struct("node", "weight")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    shared = scratch.kept(members.join(hubs, "bucket"), "near-members")
    alike = lambda x, y: F.least(x, y) >= least * F.greatest(x, y)  # noqa: E731  no overlap of weights further apart reaches it
    stars = shared.where((F.col("node") != F.col("hub.node")) & alike(F.col("weight"), F.col("hub.weight")))
    stars = scratch.kept(stars.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), "near-stars")

    wanted = shared.select("node").distinct().join(nodes.select("node", "key", F.col("one.doc_id").alias("doc_id")), "node")
    wanted = scratch.kept(wanted, "near-wanted")
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", F.md5("text").alias("_key"))
    few = F.broadcast(wanted) if wanted.count() <= hold else wanted
    bodies = source.join(few, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("node", "text")
    bodies = scratch.kept(bodies.dropDuplicates(["node"]), "near-texts")

    labels = components(_verified(stars, bodies, least, scratch), scratch)

    def mixed() -> DataFrame:
        """Members of buckets with different classes: bucket, node, weight, label, n (members)."""
        placed = shared.select("bucket", "node", "weight").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high")
        return scratch.kept(placed.join(several.select("bucket", "n"), "bucket"), "near-mixed")

    left = mixed()
    drawn = left.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "node").alias("h"), "node", "weight", "label")).alias("hub"))
    second = left.join(drawn, "bucket").where((F.col("label") != F.col("hub.label")) & alike(F.col("weight"), F.col("hub.weight")))
    second = second.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b")).distinct()
    second = scratch.kept(second.join(stars, ["a", "b"], "left_anti"), "near-second")
    labels = joined(labels, _verified(second, bodies, least, scratch), scratch)

    pairs = _possible(mixed(), bodies, least, scratch).join(stars.union(second), ["a", "b"], "left_anti")
    labels = joined(labels, _verified(scratch.kept(pairs, "near-pairs"), bodies, least, scratch), scratch)

    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("key", "label", "one", "n_rows")
    named = scratch.kept(named, "near-labelled")
    classes = named.groupBy("label").agg(F.min(F.struct("one.doc_id", "key", "one.n")).alias("stays"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("class_texts"))
    named = result.kept(named.select("key", "label").join(classes, "label"), "near-named")
    scratch.drop()
    out = signed.select("doc_id", "key", "weight").join(named.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (F.col("weight") > 0), "left")
    out = out.select("doc_id", "key", F.when(F.col("weight") > 0, F.col("stays.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts"), F.col("stays.key").alias("class_key"))
    keepers = named.where("n_rows > 1").select(F.col("stays.doc_id").alias("doc_id"), F.col("stays.key").alias("key"), F.col("stays.n").alias("n")).distinct()
    return out, keepers


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, the document that stays, and how many distinct texts are in the class."""
    out, _ = near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "class_texts", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("stays"))
