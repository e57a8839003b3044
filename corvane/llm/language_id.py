"""Language identification by a convolutional network over bytes.

A text's UTF-8 bytes are cut into windows of fixed length.  Filters of several
widths run over each window, the largest response of each filter is kept, and a
softmax layer over those gives the window's languages; a text's probabilities are
the mean of its windows', weighted by their bytes.  The network is trained in
numpy with Adam on a bounded sample of labelled texts; it is a few hundred
kilobytes and travels with the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunked import afresh
from .common import small_batches, table

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class ByteNetwork:
    """filters[width][k]: weights (256, filters) of the byte at place k; dense layer on all pooled responses."""

    languages: list[str]
    length: int
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray
    _pairs: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def new(languages: list[str], length: int = 192, widths: tuple[int, ...] = (2, 3, 4), n: int = 16, seed: int = 7) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        filters = {w: rng.normal(0, 0.3, (w, 256, n)).astype("f4") for w in widths}
        for t in filters.values():
            t[:, 0] = 0  # padding
        return ByteNetwork(
            languages, length, filters, np.zeros(n * len(widths), "f4"), rng.normal(0, 0.2, (n * len(widths), len(languages))).astype("f4"), np.zeros(len(languages), "f4")
        )

    # -- scoring ---------------------------------------------------------
    def _responses(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width the responses (windows, places, filters); neighbouring bytes are looked up in pairs."""
        if not self._pairs:
            for w, t in self.filters.items():
                both = [(t[k][:, None] + t[k + 1][None]).reshape(65536, -1) for k in range(0, w - 1, 2)]
                self._pairs[w] = [*both, *([t[w - 1]] if w % 2 else [])]
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        out = []
        for w, tables in self._pairs.items():
            places = x.shape[1] - w + 1
            got = None
            for k, t in enumerate(tables):
                at = x[:, 2 * k : 2 * k + places] if len(t) == 256 else pair[:, 2 * k : 2 * k + places]
                part = np.take(t, at, axis=0)
                got = part if got is None else np.add(got, part, out=got)
            out.append(got)
        return out

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (windows, languages) of uint8 windows."""
        pooled = np.concatenate([r.max(axis=1) for r in self._responses(x)], axis=1)
        z = np.maximum(pooled + self.bias, 0) @ self.dense + self.out
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def texts(self, texts: list[bytes], block: int = 256) -> np.ndarray:
        """Probabilities (texts, languages) of non-empty texts, all their windows included."""
        n = self.length
        sizes = np.array([-(-len(t) // n) for t in texts])
        x = np.frombuffer(b"".join(t.ljust(k * n, b"\0") for t, k in zip(texts, sizes)), np.uint8).reshape(-1, n)
        p = np.concatenate([self.windows(x[i : i + block]) for i in range(0, len(x), block)])
        ends = np.cumsum(sizes)
        weight = np.full(len(x), float(n))
        weight[ends - 1] = [len(t) - (k - 1) * n for t, k in zip(texts, sizes)]
        total = np.add.reduceat(p * weight[:, None], ends - sizes, axis=0)
        return total / np.array([len(t) for t in texts], float)[:, None]

    # -- training --------------------------------------------------------
    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on cross-entropy; the gradient of a pooled filter goes to the bytes of its largest response."""
        rng = np.random.default_rng(seed)
        params = [*self.filters.values(), self.bias, self.dense, self.out]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                xb, yb = x[rows], y[rows]
                self._pairs.clear()
                tops, values = [], []
                for w, t in self.filters.items():
                    r = t[0][xb[:, : xb.shape[1] - w + 1]]
                    for k in range(1, w):
                        r += t[k][xb[:, k : xb.shape[1] - w + 1 + k]]
                    tops.append(r.argmax(axis=1))
                    values.append(r.max(axis=1))
                hidden = np.maximum(np.concatenate(values, axis=1) + self.bias, 0)
                z = hidden @ self.dense + self.out
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(yb)), yb] -= 1
                z /= len(yb)
                back = (z @ self.dense.T) * (hidden > 0)
                grads, n = [], values[0].shape[1]
                for j, (w, t) in enumerate(self.filters.items()):
                    g, b = np.zeros_like(t), back[:, j * n : (j + 1) * n]
                    for k in range(w):
                        bytes_at = np.take_along_axis(xb, tops[j] + k, axis=1)
                        np.add.at(g[k], (bytes_at, np.arange(n)[None, :]), b)
                    g[:, 0] = 0
                    grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ z + 1e-4 * self.dense, z.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self._pairs.clear()


def learnable() -> Column:
    """Rows that training may use: doc_id's checksum leaves 0 or 2 by 3."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1


def learn(docs: DataFrame, sample: int = 18_000, length: int = 192) -> ByteNetwork | None:
    """A network from ``sample`` labelled rows at most: windows of ``length`` characters of the labelled texts, of all of them alike.

    A window is chosen by a hash of doc_id, text and its place against the share
    that the number of windows allows, equal ones once, those of the least hashes if
    there are more.  None without labelled texts.
    """
    most = 1 << 30
    usable = docs.where(learnable() & F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    n = usable.agg(F.sum(F.ceil(F.length("text") / length))).first()[0] or 0
    share = int(min(1.0, 1.1 * sample / max(1, n)) * most)
    mark = lambda i: F.xxhash64(F.lit("lang"), F.col("_key"), i)
    places = F.filter(F.sequence(F.lit(0), F.ceil(F.length("text") / length).cast("int") - 1), lambda i: F.pmod(mark(i), F.lit(most)) < share)
    some = usable.withColumn("_key", F.xxhash64("doc_id", "text")).withColumn("_at", F.explode(places))
    some = some.select("lang", F.substring("text", (F.col("_at") * length + 1).cast("int"), F.lit(length)).alias("window"), mark(F.col("_at")).alias("h")).distinct()
    rows = sorted((r["lang"], r["window"]) for r in some.orderBy("h", "lang", "window").limit(sample).collect())
    languages = sorted({lang for lang, _ in rows})
    # every third window is also shown cut short, as short texts are
    shown = [(lang, q) for i, (lang, p) in enumerate(rows) for q in ((p, p[: 16 + len(p) % 7 * 16]) if i % 3 == 0 else (p,))]
    pieces = [(part, lang) for lang, q in shown if _LETTER.search(q) for data in [q.encode()] for part in (data[i : i + length] for i in range(0, len(data), length))]
    if not pieces:
        return None
    net = ByteNetwork.new(languages, length)
    net.train(np.frombuffer(b"".join(p.ljust(length, b"\0") for p, _ in pieces), np.uint8).reshape(-1, length), np.array([languages.index(lang) for _, lang in pieces]))
    return net


def identify(net: ByteNetwork | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, probability) of each whole text; null and letterless ones, and all if there is no network, are unknown with 0."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    known = [i for i, t in enumerate(texts) if net is not None and t and _LETTER.search(t)]
    if known:
        p = net.texts([texts[i].encode() for i in known])
        for i, row in zip(known, p):
            out[i] = (net.languages[int(row.argmax())], min(1.0, float(row.max())))
    return out


def predicted(docs: DataFrame, net: ByteNetwork | None, lang: str = "_lang", score: str = "_score") -> DataFrame:
    """``docs``, all columns kept, plus the language and its probability, from ``text`` alone, under names that ``docs`` doesn't have."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = identify(net, batch.column(place).to_pylist())
            more = [pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, lang, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(afresh(run), schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document: ``und`` with 0 for null, empty and letterless texts; equal texts alike; no rows for an empty table."""
    docs = table(spark, sf_dir, "documents")
    net = learn(docs)
    got = predicted(docs.select("doc_id", "text"), net)
    return got.select("doc_id", (~learnable()).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
