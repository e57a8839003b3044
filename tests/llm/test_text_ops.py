"""Operators on single texts, against plain versions of what they compute."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
import zstandard
from tokenizers import Tokenizer

from corvane.llm import batched, chunked, language_id, packing, quality_rules, quality_trees, secret_scan, token_binary, token_counts
from corvane.llm.chunked import ChunkEncoder

from .conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def base(text):
    w = WORD.findall(text or "")
    g = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_op1_counts(spark, odd_dir, sf_dir):
    import pyarrow.parquet as pq

    want = Counter((r[0], *base(r[1])) for r in rows())
    got = quality_rules.op1_quality_rules(spark, odd_dir).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    assert all(tuple(r)[1:6] == base(texts[r["doc_id"]]) for r in quality_rules.op1_quality_rules(spark, sf_dir).collect())


def test_decision_list_finds_planted_rules():
    rnd = random.Random(1)
    data = []
    for _ in range(3000):
        x = [rnd.random() for _ in quality_rules.FEATURES]
        data.append((0 if x[2] > 0.8 or (x[0] < 0.3 and x[7] > 0.7) else 1, *x))
    found = quality_rules.learn(data)
    assert 2 <= len(found) <= 8
    x = np.array(data)[:, 1:]
    caught = np.zeros(len(x), bool)
    for r in found:
        caught |= quality_rules._holds([(quality_rules.FEATURES.index(n), w, t) for n, w, t in r.conditions], x)
    assert (caught == (np.array(data)[:, 0] == 0)).mean() > 0.97
    assert quality_rules.learn([]) == []


def plain_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|(?a:(?i:passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_op2_base_spans(spark, odd_dir, sf_dir):
    for d in (odd_dir, sf_dir):
        texts = defaultdict(set)
        for r in spark.read.parquet(f"{d}/documents.parquet").collect():
            texts[r["doc_id"]].add(hashlib.sha256(plain_spans(r["text"]).encode()).hexdigest())
        for r in secret_scan.op2_secret_scan(spark, d).collect():
            assert r["base_sha256"] in texts[r["doc_id"]]


def test_novelty_tells_secrets_from_words():
    n = secret_scan.Novelty()
    kinds = lambda t: [k for _, _, k in secret_scan.find(t, n)[1]]
    assert kinds("aws key is wJalrXUtnFEMI7K7MDENG2bPxRfiCY then") == ["novel"]
    assert kinds("key = your_password_here1") == kinds("session: aaaaaaaaaaaaaaaaaaaa1") == kinds("token=token: abcdefgh") == []
    assert secret_scan.redacted("a password=Abc123x b", secret_scan.find("a password=Abc123x b", n)[1]) == "a [SECRET] b"


@pytest.mark.parametrize("prefix", "ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk- sk_live_ rk_live_ xoxa- xoxb- xoxp- xoxr- xoxs- AIza eyJ npm_ hf_".split())
def test_each_prefix_is_found_alone(prefix):
    t = f"export G={prefix}11ABQ7ZLY0w9XkTrV5mNcE2u"
    assert secret_scan.find(t, secret_scan.Novelty())[1] == [(9, len(t), "novel")]


@pytest.mark.parametrize("before", ["the secret aws_secret_access_key = ", "auth refresh_token_value = ", "key: client_secret_value = ", "key=auth_signature=", "key is private_session_cookie: "])
def test_names_beside_sensitive_words_leave_the_secret_its_context(before):
    t = f"{before}wJa1rXUtnFEMI7K7MDENG2bPxRfiCYqZ84hTs0Lv then"
    spans = secret_scan.find(t, secret_scan.Novelty())[1]
    assert spans and spans[-1][1] == len(t) - 5 and secret_scan.redacted(t, spans).endswith("[SECRET] then")


def test_candidates_overlap():
    string = "[A-Za-z0-9+/_=~.-]"
    plain = re.compile(secret_scan._CONTEXT.pattern.replace(f"(?={string}{{12}})", f"(?=({string}{{12,}}))"), re.ASCII | re.IGNORECASE)
    for t in ["key=" * 50, "token=key1=" * 9 + " secret is auth: x", "the secret aws_secret_access_key = 'abcdefgh12345' key"]:
        assert secret_scan.candidates(t) == sorted({m.span(1) for i in range(len(t)) if (m := plain.match(t, i))})


@pytest.mark.parametrize("before", ["key:\t", "auth\t=\t", "session\t", 'set_key("', "auth( "])
def test_tabs_and_brackets_separate(before):
    t = f"{before}wJa1rXUtnFEMI7K7MDENG2bPxRfiCY"
    assert secret_scan.find(t, secret_scan.Novelty())[1] == [(len(before), len(t), "novel")]


TRICKY = ["", " ", "a  b", "<|endoftext|> x", "it's 'S We'LL", "“q” — x…", "İstanbul ΣΑΣ 中文", "\x1c x", "a\xa0b", "foo\n\n bar", "x\n", " lead", "tail ", "\n \nbar", "x²½3", "é é", "a" * 3000]


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_chunks_give_the_library_ids(path):
    e = ChunkEncoder(path, max_entries=50)
    texts = TRICKY + [r[1] for r in rows()]
    assert [np.frombuffer(g, e.dtype).tolist() for g in e.encode(texts)] == [ids_of(path, t) for t in texts]


def test_op7_prefixes():
    c = token_counts.PrefixCounts(BYTE, max_entries=100)
    rnd = random.Random(2)
    for t in TRICKY + [rows()[-2][1]]:
        assert c.count(t) == len(ids_of(BYTE, t))
        for k in rnd.sample(range(len(t) + 1), min(len(t) + 1, 6)):
            assert c.at(t, k) == len(ids_of(BYTE, t[:k]))
    w = c.within(rows()[5][1], 20)
    assert len(ids_of(BYTE, rows()[5][1][:w])) <= 20 < len(ids_of(BYTE, rows()[5][1][: w + 1]))


def test_op7_longest_prefix_of_unsure_texts():
    c = token_counts.PrefixCounts(BYTE, max_entries=1000)
    texts = TRICKY[:-1] + ["x <|endoftext|>  y <|endo", "def f():\n        return  1\n\n\n    # é", "中文字符" * 9, "Ünïcödé Ελλάδα Россия  " + "нескончаемый" * 9, "a  b misinformations", "a  rawdownloadcloneembedreportprints", "a \n \n  b 😀😀 \u200d x"]
    for t in texts:
        at = [len(c.rules.whole(t[:k])) // c.rules.dtype.itemsize for k in range(len(t) + 1)]
        assert [c.within(t, n) for n in range(at[-1] + 2)] == [max(k for k, x in enumerate(at) if x <= n) for n in range(at[-1] + 2)]
        assert [c.at(t, k) for k in range(len(t) + 1)] == at


def test_op7_query(spark, odd_dir):
    want = Counter((r[0], len((r[1] or "").encode()), len(ids_of(BYTE, r[1]))) for r in rows())
    assert Counter(tuple(r)[:3] for r in token_counts.op7_token_counts(spark, odd_dir).collect()) == want


def test_op3_round_trip(spark, odd_dir, odd, tmp_path):
    for k, parts in enumerate((1, 7)):  # in place, and dealt by ranges
        folder = f"file://{tmp_path}/t{k}"
        token_binary.write(odd.repartition(parts), folder, BYTE, segment=20_000)
        got = token_binary.read(spark, folder).orderBy("start").collect()
        at = 0
        names = [r["doc_id"] for r in got]
        assert names == sorted(names, key=lambda n: (n is not None, n or 0))
        left = Counter((r[0], tuple([*ids_of(BYTE, r[1]), 2])) for r in rows())
        for r in got:
            assert r["start"] == at and r["n_tokens"] == len(r["ids"])
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            left[(r["doc_id"], tuple(r["ids"]))] -= 1
            at += r["n_tokens"]
        assert not any(left.values())


def test_blocks_checkpoints_and_checksums():
    rnd = np.random.default_rng(4)
    ids = np.minimum(rnd.geometric(0.01, 2 * token_binary.BLOCK + 777), 5000)
    f = token_binary.Frequencies(*np.unique(ids, return_counts=True))
    blocks = token_binary.encode_segment(ids, f)
    assert (token_binary.decode_segment(blocks, f) == ids).all()
    half = token_binary.decode_blocks(blocks[:2], token_binary.STEPS, f, first=token_binary.CHECK)
    assert (half[1] == ids[token_binary.BLOCK + token_binary.CHECK * token_binary.LANES : 2 * token_binary.BLOCK]).all()
    broken = bytearray(blocks[0]["stream"])
    broken[1000] ^= 1
    with pytest.raises((ValueError, IndexError)):
        token_binary.decode_segment([blocks[0] | {"stream": bytes(broken)}, *blocks[1:]], f)


def test_closest_fill_equals_all_subsets():
    rnd = random.Random(6)
    for _ in range(60):
        counts = Counter(rnd.randint(1, 30) for _ in range(rnd.randint(0, 9)))
        c = rnd.randint(1, 60)
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums}
        got = packing.closest_fill(counts, c)
        assert sum(got) == max(s for s in sums if s <= c) and not Counter(got) - counts


def test_op10_query(spark, odd_dir):
    got = packing.op10_packing(spark, odd_dir).collect()
    left = Counter((r[0], len(ids_of(WORDS, r[1])) + 1) for r in rows())
    ids = defaultdict(set)
    for r in rows():
        ids[r[0]].add(tuple([*ids_of(WORDS, r[1]), 1]))
    seen = Counter()
    for r in got:
        seen[(r["doc_id"], r["doc_tokens"])] += r["length"]
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    assert seen == Counter({k: k[1] * n for k, n in left.items()})
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        total = 0
        for o, n in sorted(parts):
            assert o == total
            total += n
        assert total <= 2048 and total & (total - 1) == 0  # full, or a power of two


def test_op6_learns(spark, sf_dir, odd_dir, empty_dir):
    got = language_id.op6_language_id(spark, sf_dir)
    assert got.count() == 200
    hit = got.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").selectExpr("avg(cast(lang = lang_pred as int))").first()[0]
    assert hit > 0.93
    odd = {r["doc_id"]: r for r in language_id.op6_language_id(spark, odd_dir).collect()}
    assert all(odd[i]["lang_pred"] == "und" for i in (100, 101, 102, 105)) and odd[106]["lang_pred"] in ("de", "en")
    assert language_id.op6_language_id(spark, empty_dir).count() == 0


def test_op9_trees(spark, sf_dir, odd_dir, empty_dir):
    x = np.random.default_rng(3).random((2000, len(quality_trees.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.6)).astype(int)
    data = [(int(a), *b) for a, b in zip(y, x)]
    assert ((quality_trees.train(data[:1500]).score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    for d, n in ((odd_dir, len(rows())), (empty_dir, 0), (sf_dir, 200)):
        got = quality_trees.op9_quality_trees(spark, d).collect()
        assert len(got) == n and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


@pytest.mark.parametrize("op", [quality_rules.op1_quality_rules, secret_scan.op2_secret_scan, token_binary.op3_token_binary, token_counts.op7_token_counts, packing.op10_packing])
def test_empty_tables(spark, empty_dir, op):
    assert op(spark, empty_dir).count() == 0


ODD_CUTS = ["a\n\nb", "we'll they're 'tis x'll!!'re", "a  b   c\n \n d", "Привет, мир! как дела", "漢字かな混じり文 test", "x!!<|endoftext|>y <|endoftext|> z", "0x" + "1234567890" * 30, "\x1c\x1d a", "　　全角", "a" * 700 + " b" + "=" * 300, "don't'll''s 's\n's", " \n\n\n  \n x", "!!'r '", "\x85  x"]


def test_op7_every_prefix_of_odd_texts():
    c = token_counts.PrefixCounts(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "!", "<|endoftext|>", "é", "漢", "1", "Hello", "\t", "...", "Ω"]
    for t in [*ODD_CUTS, *("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 18))) for _ in range(120))]:
        full = [len(c.rules.tokenizer.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert [c.at(t, k) for k in range(len(t) + 1)] == full and c.count(t) == full[-1]
        for limit in {0, 1, 2, 3, 5, 8, full[-1] // 2, max(0, full[-1] - 1)}:
            assert c.within(t, limit) == max(k for k in range(len(t) + 1) if full[k] <= limit)


@pytest.mark.parametrize("word", ["xq" * 100_000, " " * 200_000 + "x", "é" * 100_000, "key" * 30_000, "key=k1" * 10_000])
def test_long_words_take_linear_time(word):
    began = time.process_time()
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert c.count(word) > 512 and c.within(word, 512) < len(word)
    secret_scan.find(word, secret_scan.Novelty())
    assert time.process_time() - began < 20


def test_op1_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(quality_rules.BASE_SQL).fetchall()
    got = quality_rules.op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_learners_on_given_labels(spark):
    """Held-out quality of the rules and the trees on the labels of the given tables, and of the languages."""
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    trees = [(r["predicted"], labels[r["doc_id"]]) for r in quality_trees.op9_quality_trees(spark, d).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    kept = [(int(r["kept"]), labels[r["doc_id"]]) for r in quality_rules.op1_quality_rules(spark, d).collect() if labels.get(r["doc_id"]) is not None]
    assert np.mean([a == b for a, b in trees]) > 0.8 and np.mean([a == b for a, b in kept]) > 0.8


def test_sample_has_a_bound(spark):
    """One doc_id that stands for many rows doesn't make the sample larger."""
    docs = spark.range(500).selectExpr("7L doc_id", "concat('a text number ', id, ' of many') text", "'en' lang")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    from corvane.llm.statistics import labelled

    assert 20 <= len(labelled(docs, labels, "quality", 50)) <= 50


def test_own_names_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c", True, "r", 1.0, "x")], "doc_id long, text string, kept boolean, rule string, `_stats` double, `a.b` string")
    got = quality_rules.apply_rules(docs, []).select("doc.*").columns
    assert got == docs.columns == quality_trees.scored(docs, quality_trees.train([])).select("doc.*").columns


def plain_network(net, text):
    """The network's languages for one text, byte by byte."""
    data, total = text.encode(), np.zeros(len(net.languages))
    for at in range(0, len(data), net.length):
        part = data[at : at + net.length]
        x = part.ljust(net.length, b"\0")
        pooled = [max(sum(t[k, x[i + k], f] for k in range(w)) for i in range(net.length - w + 1)) for w, t in net.filters.items() for f in range(t.shape[2])]
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.dense + net.out
        p = np.exp(z - z.max())
        total += len(part) * p / p.sum()
    return total / len(data)


def test_op6_equals_plain_network():
    net = language_id.ByteNetwork.new(["a", "b", "c"], 24, n=4)
    for text in ["short", "a longer text with some more windows than one, é ü ß", "x" * 24, "漢字" * 9]:
        assert np.allclose(net.texts([text.encode()])[0], plain_network(net, text), atol=1e-4)


def test_op9_equals_plain_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, len(quality_trees.FEATURES)))
    model = quality_trees.train([(int(a[0] + a[1] > 0), *a) for a in x], trees=5)
    for row, raw in zip(x, model.raw(x)):
        plain = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            plain += leaf[node - len(f)]
        assert abs(plain - raw) < 1e-9


def test_packing_by_slack_to_the_end():
    """Few documents: nearly all windows are multisets with one cut at most, and all but the last part are full."""
    rng, packer, out = np.random.default_rng(4), packing.Packer(2048, 0), []
    for d in range(125):
        out += packer.add(d, np.arange(rng.integers(1, 5000), dtype="u2"))
    out += packer.finish()
    windows = defaultdict(list)
    for p, seq, offset in out:
        assert offset == sum(len(q.ids) for q in windows[seq])
        windows[seq].append(p)
    sizes = [sum(len(p.ids) for p in w) for w in windows.values()]
    assert sum(s != 2048 for s in sizes) <= 11 and all(s & (s - 1) == 0 for s in sizes)
    pieces = Counter(p.doc for p, _, _ in out)
    assert sum(pieces.values()) - sum(-(-p.doc_tokens // 2048) for p in {q.doc: q for q, _, _ in out}.values()) <= 1.2 * len(windows) ** 0.5 + 60


def test_ids_from_a_checkpoint():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 900, token_binary.BLOCK + 77)
    known, counts = np.unique(ids, return_counts=True)
    f = token_binary.Frequencies(known, counts)
    for b, part in zip(token_binary.encode_segment(ids, f), (ids[: token_binary.BLOCK], ids[token_binary.BLOCK :])):
        for a, z in ((0, 5), (len(part) // 2, len(part) // 2 + 9), (len(part) - 3, len(part))):
            assert (token_binary.decode_range(b, f, a, z) == part[a:z]).all()


def test_workers_forget_encoders_of_earlier_stages():
    path = public_tokenizers.path("word_bpe_49k.json")
    chunked.encoder(path).one("some words")
    held = []

    def run(batches):
        held.append(len(chunked._made))
        yield from batches

    assert list(chunked.afresh(run)(iter([1, 2]))) == [1, 2] and held == [0]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_is_kept_once(file):
    enc, odd = ChunkEncoder(public_tokenizers.path(file)), ["x\ny z", "a\n b", "don't stop'll", "'s o'clock", " .a. b", "a ", "\ta", "naïve x", "$1.50 (abc)... abc"]
    assert enc.encode(odd) == [enc.whole(t) for t in odd]
    enc.encode(["grumblefrotz grumblefrotz. and grumblefrotz, again grumblefrotz!"])
    assert "grumblefrotz" in enc.chunks and not [p for p in enc.pieces if "grumblefrotz" in p]


def test_packed_ids_leave_in_small_batches(monkeypatch):
    class Docs:
        sparkSession = None

        def selectExpr(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(packing, "small_batches", lambda _: None)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    path, texts = WORDS, [" ".join("abcdefghij"[i % 10] for _ in range(700 + i % 7)) for i in range(3000)] + [None, "", "word " * 5000]
    run, most, ids, size = packing.pack(Docs(), path), 0, {}, 0
    for batch in run(iter([pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})])):
        most = max(most, batch.nbytes)
        for r in batch.to_pylist():
            assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["sequence_id"] >> 40 == 3
            ids.setdefault(r["doc_id"], {})[r["start"]] = r["ids"]
            size += r["length"]
    known = {t: [*ids_of(path, t), 1] for t in set(texts)}
    assert size > 2_000_000 and most < 5_000_000
    assert [sum((p for _, p in sorted(ids[i].items())), []) for i in range(len(texts))] == [known[t] for t in texts]
    plain = packing.pack(Docs(), path, with_ids=False)
    got = [r for b in plain(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a", None]})])) for r in b.to_pylist()]
    assert sum(r["length"] for r in got) == 3 and {r["ids"] for r in got} == {None}
    assert list(plain(iter([]))) == []


def words_of(rnd, n, letters="etaoinshré'."):
    return ["".join(rnd.choices(letters, k=rnd.randint(1, 9))) for _ in range(n)]


def test_op3_asks_the_library_for_many_words_at_a_time(monkeypatch):
    class Docs:
        sparkSession = None

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    class Asked:
        def __init__(self, path):
            self.real = Tokenizer.from_file(path)
            self.model = SimpleNamespace(tokenize=self.tokenize)

        def __getattr__(self, name):
            return getattr(self.real, name)

        def tokenize(self, text):
            calls.append(text)
            return self.real.model.tokenize(text)

    calls, rnd = [], random.Random(8)
    texts = [" ".join(words_of(rnd, 400)) for _ in range(30)] + [None, "", "a  b", "x\n"]
    want = [[*ids_of(BYTE, t), 2] for t in texts]
    monkeypatch.setattr(token_binary, "small_batches", lambda _: None)
    monkeypatch.setattr(token_binary, "F", SimpleNamespace(col=lambda _: SimpleNamespace(cast=lambda _: SimpleNamespace(alias=lambda _: None))))
    monkeypatch.setattr(token_binary, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(tokenizers, "Tokenizer", SimpleNamespace(from_file=Asked))
    chunked.release()
    out = [r for b in token_binary._tokens(Docs(), BYTE, 2)(iter([pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})])) for r in b.to_pylist()]
    chunked.release()
    assert [np.frombuffer(zstandard.ZstdDecompressor().decompress(r["ids"]), "<u2").tolist() for r in out[:-1]] == want
    counts = np.frombuffer(zlib.decompress(out[-1]["counts"]), "<i8")
    assert {i: n for i, n in enumerate(counts.tolist()) if n} == Counter(i for w in want for i in w)
    assert len(calls) * 5 < len({w for t in texts if t for w in t.split()})


def test_columns_give_the_library_ids():
    rules, rnd = ChunkEncoder(BYTE), random.Random(9)
    enc, thinned = batched.BatchEncoder(rules, slots=1 << 12, size=1500), []
    thin = enc._thin
    enc._thin = lambda: (thin(), thinned.append(enc.held))
    common = words_of(rnd, 300)
    texts = [None, *TRICKY, *(r[1] for r in rows()), "à la à, voilà", "they'llx 'sx x'\xa0y", "tab\tand\x00nul", "é" * 300 + " x"]
    texts += [" ".join(words_of(rnd, 40, "etaoinshr'.é1\n") + rnd.sample(common, 20)) for _ in range(300)]
    texts += [" ".join(rnd.sample(common, 9)) + "\n" for _ in range(300)] + ["longest " * 700 + "x" * 2000, " ".join(words_of(rnd, 5000))]
    rnd.shuffle(texts)
    for column in (pa.array(texts, pa.string()), pa.array(["no", *texts], pa.large_string()).slice(1), pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        got = []
        for i, j, ids, ends in enc.encode(column):
            assert i == len(got) and len(ends) == j - i and ends[-1] == len(ids)
            got += [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist())]
        assert got == [np.frombuffer(rules.whole(t or ""), rules.dtype).tolist() for t in column.to_pylist()]
    assert any(thinned) and len(thinned) > 3  # with some units kept
    with pytest.raises(ValueError):
        batched.BatchEncoder(ChunkEncoder(WORDS))
