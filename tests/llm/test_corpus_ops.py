"""Operators over the whole corpus, against plain versions of what they compute."""

import random
import re
from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline
from corvane.llm import ann_graph, mixing, near_dedup

from .conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_op4_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(mixing.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, mixing.op4_mixing(spark, sf_dir).collect())) == sorted(want)


def test_op4_odd_and_empty(spark, odd_dir, empty_dir):
    got = mixing.op4_mixing(spark, odd_dir).collect()
    assert len(got) == len(rows()) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    assert mixing.op4_mixing(spark, empty_dir).count() == 0


def test_unequal_odds(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "'s' source", "1L size", "case when id % 2 = 0 then 1L else 9L end favour")
    from pyspark.sql import functions as F

    how = mixing.plan(docs, F.col("size"), F.col("favour"), share=0.3)
    got = {r["favour"]: r["n"] for r in mixing.with_copies(docs, how, F.col("size"), F.col("favour")).groupBy("doc.favour").agg(F.sum("copies").alias("n")).collect()}
    assert got[1] + got[9] == 1200 and got[9] > 3 * got[1]


def test_op4_certain_documents_and_odds(spark):
    """Documents whose odds reach 1 are taken; the others in proportion to their favour, over many seeds."""
    from pyspark.sql import functions as F

    docs = spark.range(300).selectExpr("id doc_id", "'s' source", "1L size", "case when id < 20 then 1000L when id % 2 = 0 then 1L else 3L end favour").cache()
    taken = Counter()
    for seed in range(12):
        how = mixing.plan(docs, F.col("size"), F.col("favour"), share=0.4, seed=str(seed))
        got = mixing.with_copies(docs, how, F.col("size"), F.col("favour"), seed=str(seed)).where("copies > 0").select("doc.*").collect()
        assert len(got) == 120 and sum(r["favour"] == 1000 for r in got) == 20
        taken.update(r["favour"] for r in got)
    # 100 of 280 others: 140 with 3 c and 140 with c, so 75 and 25 each time
    assert abs(taken[3] / 12 - 75) < 5 and abs(taken[1] / 12 - 25) < 5


def test_op4_repeated_rows_meet_their_target(spark, tmp_path):
    data = [(None, "w " * 20, "a") for _ in range(400)] + [(i, "x " * 30, "b") for i in range(50)] + [(7, "x " * 300, "c") for i in range(20)]
    spark.createDataFrame(data, "doc_id long, text string, source string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op4_mixing(spark, f"file://{tmp_path}").collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(mixing.ORACLE_SQL).fetchall()))
    for size, largest in ((8000, 20), (1500, 30), (6000, 300)):
        own = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= largest


def test_op4_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "s", 5, "a", 1.0, 2, 3, "x") for i in range(9)], "doc_id long, source string, words int, need string, target double, rest int, copies int, `p.q` string")
    got = mixing.with_copies(docs, mixing.plan(docs, F.col("words")), F.col("words")).select("doc.*", F.col("copies").alias("taken"))
    assert got.columns == [*docs.columns, "taken"] and sum(r["taken"] for r in got.collect()) in (13, 14)


def brute_classes(docs):
    bags = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    up = {i: i for i in bags}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(bags)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = bags[i], bags[j]
            lo, hi = sorted((sum(a.values()), sum(b.values())))
            if lo and lo >= 0.8 * hi and sum((a & b).values()) >= (0.8 - 1e-12) * sum((a | b).values()):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def planted():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    out, texts = [], []
    for _ in range(30):
        texts.append([word() for _ in range(rnd.choice([3, 8, 60, 300]))])
    for _ in range(150):
        t = list(rnd.choice(texts))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
            t[rnd.randrange(len(t))] = word()
        if rnd.random() < 0.1:
            t = t * 2
        texts.append(t)
    for i, t in enumerate(texts):
        out.append((i, " ".join(t)))
    return [*out, (500, None), (501, ""), (502, ""), (503, "\n")]


def test_op8_equals_all_pairs(spark, sf_dir, tmp_path, empty_dir):
    docs = planted()
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    for d in (f"file://{tmp_path}", sf_dir):
        own = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.op8_near_dedup(spark, d).collect()}
        assert got == brute_classes(own)
    assert near_dedup.op8_near_dedup(spark, empty_dir).count() == 0


def test_op8_small_buckets_lose_nothing(spark):
    """With one row a band, buckets hold many texts that aren't alike; the classes are the same."""
    docs = spark.createDataFrame(planted(), "doc_id long, text string")
    out, _ = near_dedup.near_classes(docs, bands=30, rows=1)
    assert {r["doc_id"]: r["class_id"] for r in out.collect()} == brute_classes(planted())


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a = (np.unique(pool[:200]), rng.integers(1, 9, 200))
    b = (np.unique(pool[100:]), rng.integers(1, 9, 200))
    sig = near_dedup.signatures([a, b], 4096)
    assert abs((sig[0] == sig[1]).mean() - near_dedup.overlap(a, b)) < 0.03


def test_op5_recall_and_odd_vectors(spark, tmp_path, empty_dir):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24)).astype("f4")
    x[100:600] = x[7]  # a common vector
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(10_000, None, 0), (10_100, [0.0] * 24, 0), (10_200, [float("nan")] * 24, 0), (10_300, [None] * 24, 0), (10_400, [1.0] * 5, 0)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = ann_graph.op5_ann_graph(spark, f"file://{tmp_path}").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 3000, 100))
    e, hit = x.astype("f8"), 0
    for q, found in by.items():
        d = np.sqrt(((e - e[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        hit += len({v for v, _ in found} & set(want.tolist()))
        assert found == sorted(found, key=lambda f: (f[1], f[0])) and all(abs(d[v] - s) < 1e-12 for v, s in found)
    assert hit >= 0.9 * 10 * len(by)
    assert [v for v, _ in by[200]] == [7, *range(100, 109)]
    assert ann_graph.op5_ann_graph(spark, empty_dir).count() == 0


def brute_nearest(rows, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], "f8")
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        out[int(ids[q])] = [int(ids[i]) for i in np.lexsort((ids, d)) if i != q][:k]
    return out


def found_nearest(spark, rows, tmp_path, name, **more):
    spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/{name}")
    vectors = ann_graph.usable(spark.read.parquet(f"file://{tmp_path}/{name}"))
    index, centres, n = ann_graph.build(vectors, 10, **more)
    got = ann_graph.search(index, centres, vectors.where("vec_id % 100 = 0"), 10, n).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    return by


def test_op5_ties_and_large_components(spark, tmp_path):
    hot = [(i, np.eye(120)[i]) for i in range(120)]
    assert found_nearest(spark, hot, tmp_path, "hot") == brute_nearest(hot)
    rng = np.random.default_rng(2)
    wide = [(i, v * (1e20 if i == 7 else 1)) for i, v in enumerate(rng.normal(size=(50, 8)))]
    assert found_nearest(spark, wide, tmp_path, "wide") == brute_nearest(wide)


def test_op5_recall_over_many_shards(spark, tmp_path):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 32)) * 2
    rows = [(i, v) for i, v in enumerate(centre[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 32)))]
    want, got = brute_nearest(rows), found_nearest(spark, rows, tmp_path, "many", shard_rows=200)
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 9 * len(want)


def test_pipeline_on_odd_documents(spark, odd, odd_dir):
    docs, sizes = odd, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd_dir).cache()
        assert docs.columns == odd.columns, name
        sizes.append(docs.count())
    assert sizes[0] == len(rows()) - 4  # null, empty, white, digits only
    assert docs.where("text like '%Abc123xyz%'").count() == 0
    kept = [r["doc_id"] for r in docs.collect()]
    assert kept.count(104) == 0  # 103 has the same text
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd_dir).count() > 0


def test_copies_without_ids(spark):
    """Null doc_ids: each class keeps one row, whichever other classes lack ids too."""
    a, b = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    docs = spark.createDataFrame([(None, a), (None, a), (None, b), (4, b), (5, b + " y z 1 2 3 4 5 6 7")], "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r["text"] for r in got) == sorted([a, b, b + " y z 1 2 3 4 5 6 7"])


def test_pipeline_equals_plain_stages(spark, sf_dir):
    """Brute force: all texts here have letters; one document of each class stays; the mix is SQL; windows hold every id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = corpus_pipeline.keep_languages(spark, docs, sf_dir).cache()
    two = corpus_pipeline.drop_near_copies(spark, one, sf_dir).cache()
    assert one.count() == docs.count()
    classes = brute_classes([(r["doc_id"], r["text"]) for r in one.collect()])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(set(classes.values()))
    three = corpus_pipeline.hide_secrets(spark, two, sf_dir).cache()
    con = duckdb.connect()
    con.register("documents", three.toPandas())
    want = Counter({r[0]: r[4] // r[1] for r in con.execute(mixing.ORACLE_SQL).fetchall() if r[1] and r[4]})
    four = corpus_pipeline.mix_sources(spark, three, sf_dir).cache()
    assert Counter(r["doc_id"] for r in four.collect()) == want
    whole = corpus_pipeline.run(spark, sf_dir)
    per = {r["doc_id"]: r["n"] for r in whole.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).selectExpr("doc_id", "`sum(length)` / doc_tokens n").collect()}
    assert per == {k: float(v) for k, v in want.items()}


def test_op8_bound_and_blocks(spark, monkeypatch):
    """Count vectors never tell less than the overlap; with tiny blocks and hub groups the classes are the same."""
    rng = np.random.default_rng(4)
    for n in (3, 200, 5000, 300_000):
        a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
        b[: n // 2] = a[: n // 2]
        (x, xr), (y, yr) = near_dedup.count_vector(a), near_dedup.count_vector(b)
        most = near_dedup.most_overlap(np.frombuffer(x, np.uint8), xr, np.frombuffer(y, np.uint8)[None], np.array([yr]))[0]
        assert n // 2 <= most <= n
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "HUB", 3)
    docs = spark.createDataFrame(planted(), "doc_id long, text string")
    out, _ = near_dedup.near_classes(docs, bands=30, rows=1)
    assert {r["doc_id"]: r["class_id"] for r in out.collect()} == brute_classes(planted())


def test_op8_odd_rows(spark, odd):
    """Very long texts in pieces, repeated rows, null ids, clashing and dotted column names."""
    text = "w " * 40 + " ".join(f"v{i}" for i in range(5000)) + " " + "z" * 9000
    whole = near_dedup.shingles([None, text, "a"])
    old, near_dedup.PIECE = near_dedup.PIECE, 1000
    assert all((x == y).all() for x, y in zip(whole, near_dedup.shingles([None, text, "a"])))
    near_dedup.PIECE = old
    rows = [(None, text, 1, "x"), (None, text, 1, "x"), (5, f"{text} end", 2, None), (6, "", 0, "y"), (6, "", 0, "y"), (7, None, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, `a.b` string")
    got = sorted((repr(r["doc_id"]), repr(r["class_id"]), r["class_texts"]) for r in near_dedup.near_classes(docs)[0].collect())
    assert got == [("5", "None", 2), ("6", "6", 1), ("6", "6", 1), ("7", "7", 1), ("None", "None", 2), ("None", "None", 2)]
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(repr(r["doc_id"]) for r in kept) == ["6", "6", "7", "None"]
    assert kept[0].__fields__ == docs.columns
