"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Distinct vectors are dealt to regions, each to its nearest pivot; pivots are means of a
bounded sample.  A region is a shard, or several where it is crowded.  In a shard,
points are inserted in batches: a greedy search from the medoid proposes
neighbours, and relaxed distance pruning keeps an edge only if no kept neighbour
is clearly nearer to its end, so edges point in diverse directions; edges back
are pruned alike.  One edge of each point follows a cycle, so every point can be
reached.  Blocks of queries run a beam search on the shards of the regions nearest to
them, and the best of those are merged.  How many regions that takes depends on the
vectors: it is measured with a fixed number of points, whose true neighbours one scan
finds, so that a wanted share of neighbours lies in the regions that are searched.  Distances that are returned are in double precision on the original
vectors, and all that a beam holds is ordered by them, then by vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, materialised, small_batches, table

#: A distance that stands for any larger one, so that no point counts as absent.
_FAR = float(np.finfo("f4").max) / 4


def _squares(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x[rows] - q[:, None, :]
    with np.errstate(over="ignore"):
        return np.minimum(np.einsum("bkd,bkd->bk", d, d), _FAR)


def scale_of(x: np.ndarray) -> tuple[float, str]:
    """What vectors are divided by in searches, and the type they then have: doubles where sizes differ widely."""
    size = np.abs(x).max(axis=1)
    return float(size.max()), "f4" if size.max() <= 1e6 * size.min() else "f8"


class Graph:
    def __init__(self, x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 11):
        self.x, self.degree, self.beam, self.alpha = np.ascontiguousarray(x), degree, beam, alpha
        n = len(x)
        self.links = np.full((n, degree), -1, np.int32)
        self.used = np.ones(n, np.int32)
        order = np.random.default_rng(seed).permutation(n)
        self.links[order, 0] = np.roll(order, -1)  # the cycle; it is never pruned
        centre = self.x.mean(axis=0, keepdims=True)
        self.entry = int(((self.x - centre) ** 2).sum(axis=1).argmin()) if n else 0
        done = 0
        while done < n:  # batches grow with the graph, so early points find each other
            rows = order[done : done + int(min(256, max(8, done // 4)))]
            self._insert(rows)
            done += len(rows)

    @staticmethod
    def load(x: np.ndarray, links: np.ndarray, entry: int) -> Graph:
        g = Graph.__new__(Graph)
        g.x, g.links, g.entry = np.ascontiguousarray(x), links, entry
        return g

    def search(self, q: np.ndarray, beam: int, expand: int = 4) -> np.ndarray:
        """For each query the rows in its beam, nearest first, then by row, -1 where there are fewer."""
        b, n = len(q), len(self.x)
        beam = min(beam, n)
        rows = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf, self.x.dtype)
        open_ = np.zeros((b, beam), bool)
        seen = np.zeros((b, n), bool)
        rows[:, 0], open_[:, 0], seen[:, self.entry] = self.entry, True, True
        dist[:, 0] = _squares(self.x, rows[:, :1], q)[:, 0]
        live = np.arange(b)
        while len(live):
            take = np.argsort(~open_[live], axis=1, kind="stable")[:, :expand]
            picked = np.take_along_axis(open_[live], take, axis=1)
            nodes = np.where(picked, np.take_along_axis(rows[live], take, axis=1), -1)
            open_[live[:, None], take] = False
            near = np.where(nodes[:, :, None] >= 0, self.links[nodes], -1).reshape(len(live), -1).astype(np.int64)
            near.sort(axis=1)  # so that a row met twice in one step stands side by side
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[live[:, None], near]
            near = np.where(fresh, near, -1)
            seen[np.repeat(live, fresh.sum(axis=1)), near[fresh]] = True
            new = np.where(fresh, _squares(self.x, near, q[live]), np.inf)
            every = np.concatenate([dist[live], new], axis=1)
            both = np.concatenate([rows[live], near], axis=1)
            keep = np.lexsort((both, every), axis=1)[:, :beam]
            dist[live] = np.take_along_axis(every, keep, axis=1)
            rows[live] = np.take_along_axis(both, keep, axis=1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), keep, axis=1) & np.isfinite(dist[live])
            live = live[open_[live].any(axis=1)]
        return np.where(np.isfinite(dist), rows, -1)

    def _prune(self, points: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Diverse neighbours (points, degree - 1) out of candidates ``near`` (-1: none), nearest first."""
        near = np.where(near == points[:, None], -1, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        d = np.where(near >= 0, _squares(self.x, near, self.x[points]), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
        v = self.x[near]
        norms = np.einsum("bkd,bkd->bk", v, v)
        between = norms[:, :, None] + norms[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        alive, each = np.isfinite(d), np.arange(len(points))
        out = np.full((len(points), self.degree - 1), -1, np.int32)
        for k in range(self.degree - 1):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            out[some, k] = near[each, first][some]
            alive[each, first] = False
            alive &= self.alpha**2 * between[each, first] > d
        return out

    def _set(self, points: np.ndarray, chosen: np.ndarray) -> None:
        self.links[points, 1:] = chosen
        self.used[points] = 1 + (chosen >= 0).sum(axis=1)

    def _insert(self, points: np.ndarray) -> None:
        found = self.search(self.x[points], self.beam)
        # points of one batch may be each other's neighbours
        mates = np.broadcast_to(points[None, :], (len(points), len(points)))
        if len(points) > 48:
            d = _squares(self.x, mates, self.x[points])
            mates = points[np.argsort(d, axis=1)[:, :17]]
        self._set(points, self._prune(points, np.concatenate([found, mates], axis=1)))
        source = np.repeat(points, self.degree - 1)
        target = self.links[points, 1:].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):  # some edges back for each point at a time
            start = np.r_[True, target[1:] != target[:-1]]
            place = np.arange(len(target)) - np.maximum.accumulate(np.where(start, np.arange(len(target)), 0))
            now = place < 32
            self._back(source[now], target[now], place[now])
            source, target = source[~now], target[~now]

    def _back(self, source: np.ndarray, target: np.ndarray, place: np.ndarray) -> None:
        ends, of = np.unique(target, return_inverse=True)
        extra = np.full((len(ends), 32), -1, np.int64)
        extra[of, place] = source
        fits = self.used[ends] + (extra >= 0).sum(axis=1) <= self.degree
        for i in np.flatnonzero(fits):
            more = [s for s in extra[i] if s >= 0 and s not in self.links[ends[i]]]
            self.links[ends[i], self.used[ends[i]] : self.used[ends[i]] + len(more)] = more
            self.used[ends[i]] += len(more)
        full = np.flatnonzero(~fits)
        for i in range(0, len(full), 256):
            some = full[i : i + 256]
            points = ends[some].astype(np.int64)
            self._set(points, self._prune(points, np.concatenate([self.links[points, 1:].astype(np.int64), extra[some]], axis=1)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and ``e`` (array of double) of the rows that take part, one for each vec_id.

    Rows with a null id, a null, empty or zero vector, or a component that is null or
    not finite take no part; of rows that share a vec_id the least vector does.
    """
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where("vec_id is not null and size(e) > 0")
    rows = rows.where(F.forall("e", finite) & F.exists("e", lambda v: v != 0))
    return rows.groupBy("vec_id").agg(F.min("e").alias("e"))


def _nearest(x: np.ndarray, pivots: np.ndarray, n: int = 1) -> np.ndarray:
    """For each row of x the ``n`` nearest pivots, ties to the first; worked out in blocks."""
    out, norms = [], (pivots**2).sum(axis=1)
    step = max(1, 4_000_000 // max(1, len(pivots)))
    for i in range(0, len(x), step):
        d = norms[None] - 2 * (x[i : i + step] @ pivots.T)
        out.append(np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def pivots(points: DataFrame, shards: int, most: int = 4096, each: int = 32, rounds: int = 6) -> dict[int, np.ndarray]:
    """Pivots by number of components: means of a sample, about one for each shard, ``most`` at most.

    The sample are the points whose hash is least, ``each`` for a pivot, so it has a
    bound of most * each; where regions grow beyond a shard for that, they have
    several.
    """
    wanted = min(shards, most)
    lists = points.select("e").orderBy(F.xxhash64("e"), "e").limit(wanted * each).toArrow()["e"].combine_chunks()
    sizes, flat, out = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False), {}
    start = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        x = flat[start[sizes == dim][:, None] + np.arange(dim)[None]]
        most_of = np.abs(x).max()
        x = x / most_of
        centres = x[: max(1, round(wanted * len(x) / len(sizes)))].copy()
        for _ in range(rounds if len(centres) > 1 else 0):
            of = _nearest(x, centres)[:, 0]
            n = np.bincount(of, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, of, x)
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
        out[dim] = centres * most_of
    return out


def _routed(rows: DataFrame, centres: dict[int, np.ndarray], n: int) -> DataFrame:
    """``rows`` (id columns, e) once for each of the ``n`` regions nearest to e; vectors of a length without pivots are region 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("e")
            lists = batch.column(place)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            start, took, regions = np.cumsum(sizes) - sizes, [], []
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = flat[start[at][:, None] + np.arange(dim)[None]]
                top = np.abs(x).max(axis=1, keepdims=True)  # a huge vector has huge distances; its direction decides
                near = _nearest(np.where(top > 1e100, x / top, x), centres[dim], n) if dim in centres else np.zeros((len(at), 1), np.int64)
                took.append(np.repeat(at, near.shape[1]))
                regions.append(near.reshape(-1))
            if took:
                got = batch.take(pa.array(np.concatenate(took)))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(np.concatenate(regions).astype("i4"))], [*got.schema.names, "region"])

    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in rows.dtypes) + ", region int")


def probes(points: DataFrame, centres: dict[int, np.ndarray], k: int, share: float = 0.97, sample: int = 128) -> int:
    """How many regions hold ``share`` of the ``k`` nearest of ``sample`` points, on average.

    ``points`` (e, region) are scanned once; each task tells its own nearest of each sample point.
    """
    if max((len(c) for c in centres.values()), default=0) < 2:
        return 1
    dim = max(centres, key=lambda d: len(centres[d]))
    rows = points.where(F.size("e") == dim).select("e").orderBy(F.xxhash64("e"), "e").limit(sample).collect()
    q = np.array([r["e"] for r in rows], "f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = np.full((len(q), k + 1), np.inf), np.zeros((len(q), k + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = batch["e"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                d = (q**2).sum(axis=1)[:, None] - 2 * (q @ x.T) + (x**2).sum(axis=1)[None]
                every = np.concatenate([best, d], axis=1)
                regions = np.concatenate([where, np.broadcast_to(batch["region"].to_numpy(), d.shape)], axis=1)
                keep = np.argsort(every, axis=1, kind="stable")[:, : k + 1]
                best, where = np.take_along_axis(every, keep, axis=1), np.take_along_axis(regions, keep, axis=1)
        some = np.isfinite(best)
        of = np.broadcast_to(np.arange(len(q))[:, None], best.shape)
        yield pa.RecordBatch.from_arrays([pa.array(of[some]), pa.array(best[some]), pa.array(where[some])], ["q", "d", "region"])

    near = points.where(F.size("e") == dim).select("e", "region").mapInArrow(run, "q long, d double, region long")
    near = near.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("d", "region"))).where(F.col("place").between(2, k + 1)).collect()  # the first is the point itself
    order = _nearest(q, centres[dim], len(centres[dim])).argsort(axis=1)
    needed = np.sort([int(order[r["q"], r["region"]]) + 1 for r in near]) if near else np.ones(1, int)
    return int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))) - 1)])


def build(vectors: DataFrame, k: int, shard_rows: int = 8192, degree: int = 32, beam: int = 64) -> tuple[DataFrame, dict[int, np.ndarray], int]:
    """Index of all usable() vectors: a row for each shard with vectors, ids, links and entry; the pivots; and the regions to search for a query.

    Equal vectors are one point.  Of their ids the first ``k + 1`` are kept: no
    other can be among the ``k`` nearest of anything, as ties go to small ids.
    """
    first = W.partitionBy("e").orderBy("vec_id")
    some = vectors.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    points = some.groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    scratch = Scratch(vectors.sparkSession)
    points = scratch.kept(points, "ann-points")
    centres = pivots(points, max(1, -(-points.count() // shard_rows)))
    small_batches(vectors.sparkSession, 4096)
    points = routed = scratch.kept(_routed(points, centres, 1).withColumn("dim", F.size("e")), "ann-regions")
    parts = points.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    points = points.join(F.broadcast(parts), ["dim", "region"])  # a row for each region, which have a bound
    points = points.withColumn("shard", F.pmod(F.xxhash64("e"), F.col("parts")).cast("int")).drop("parts")

    def shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(low=[i[0] for i in rows["ids"]]).sort_values("low")
        x = np.stack(rows["e"].to_list()).astype("f8")
        scale, kind = scale_of(x)
        g = Graph((x / scale).astype(kind), degree, beam)
        ids = [np.asarray(i, "i8") for i in rows["ids"]]
        ends = np.cumsum([len(i) for i in ids]).astype("i8")
        blobs = [[x.tobytes()], [np.concatenate(ids).tobytes()], [ends.tobytes()], [g.links.tobytes()]]
        return pd.DataFrame(dict(zip(("dim", "region", "shard", "x", "ids", "ends", "links", "entry"), ([int(key[0])], [int(key[1])], [int(key[2])], *blobs, [g.entry]))))

    index = points.groupBy("dim", "region", "shard").applyInPandas(shard, "dim int, region int, shard int, x binary, ids binary, ends binary, links binary, entry int")
    index = materialised(index, "ann-index")
    n = probes(routed, centres, k)
    scratch.drop()
    return index, centres, n


def search(index: DataFrame, centres: dict[int, np.ndarray], queries: DataFrame, k: int, probes: int, beam: int = 128, block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each query (vec_id, e) in the ``probes`` regions nearest to it, those of its own id left out."""
    spark = queries.sparkSession
    small_batches(spark, 4096)
    routed = materialised(_routed(queries, centres, probes).withColumn("dim", F.size("e")), "ann-queries")
    blocks = routed.groupBy("dim", "region").agg(F.ceil(F.count("*") / block).alias("blocks"))
    grouped = routed.join(F.broadcast(blocks), ["dim", "region"]).groupBy("dim", "region", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"))
    asked = grouped.agg(F.collect_list("vec_id").alias("q_ids"), F.flatten(F.collect_list("e")).alias("q"))
    pairs = asked.join(index, ["dim", "region"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["x"], "f8").reshape(-1, r["dim"])
                ids, ends = np.frombuffer(r["ids"], "i8"), np.frombuffer(r["ends"], "i8")
                starts = np.r_[0, ends[:-1]]
                scale, kind = scale_of(x)
                g = Graph.load((x / scale).astype(kind), np.frombuffer(r["links"], "i4").reshape(len(x), -1), r["entry"])
                q = np.array(r["q"], "f8").reshape(-1, r["dim"])
                near = np.clip(q / scale, -1e18, 1e18).astype(kind)  # beyond that all points are as far
                got: tuple[list, list, list] = ([], [], [])
                for q_id, v, rows in zip(r["q_ids"], q, g.search(near, max(beam, k + 1))):
                    rows = rows[rows >= 0]
                    exact = np.repeat(np.sqrt(((x[rows] - v) ** 2).sum(axis=1)), ends[rows] - starts[rows])
                    names = np.concatenate([ids[starts[i] : ends[i]] for i in rows])
                    order = np.lexsort((names, exact))
                    order = order[names[order] != q_id][:k]
                    got[0].extend([q_id] * len(order))
                    got[1].extend(names[order].tolist())
                    got[2].extend(exact[order].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], ["query_id", "vec_id", "score"])

    small_batches(spark, 1)
    names = ["q_ids", "q", "dim", "x", "ids", "ends", "links", "entry"]
    found = materialised(pairs.select(*names).mapInArrow(run, "query_id long, vec_id long, score double"), "ann-found")
    small_batches(spark)
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann_graph(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The nearest neighbours of every hundredth vector: all others where there are fewer than ``k``, ties to the smaller vec_id.

    What takes no part, and what a repeated vec_id stands for, is said at usable();
    equal vectors are each other's nearest; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    vectors = materialised(usable(table(spark, sf_dir, "embeddings")), "ann-vectors")
    index, centres, n = build(vectors, k)
    return search(index, centres, vectors.where("vec_id % 100 = 0"), k, n)
