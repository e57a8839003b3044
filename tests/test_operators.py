"""Small cases with known results, and sequential models of what windows compute."""

import difflib
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.models import model
from corvane.operators import cite, dedup, extract, layout, rules, store, structure, tables
from corvane.plans import answer, ingest
from corvane.sources import files


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_split_and_fences(spark):
    text = "intro\n# A\n1. x\nmore\n## b\ntext\n```\n# x\n1. y\n```"
    got = structure.markdown_split(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc int, text string"), "doc").orderBy("doc", "seg").collect()
    assert [(r["text"], r["header_path"], r["node_type"], r["list_index"]) for r in got] == [
        ("intro", "/", "section", None), ("# A", "/A/", "section", None), ("1. x\nmore", "/A/", "list_item", 1), ("## b\ntext\n```\n# x\n1. y\n```", "/A/b/", "section", None),
    ]


def model_of_links(rows):
    parent, count, out = {}, {}, []
    for node, kind, key in rows:
        if kind == "section":
            parent[key] = node
            out.append([node, "article", None, None])
        else:
            count[key] = count.get(key, 0) + 1
            p = parent.get(key)
            out.append([node, "paragraph", p, count[key] - 1 if p else None])
    has = {r[2] for r in out}
    for key, node in parent.items():
        if node not in has:
            next(r for r in out if r[0] == node)[1] = "paragraph"
    return {tuple(r) for r in out}


def test_links_equal_a_sequential_model(spark):
    rnd = random.Random(3)
    rows = [(f"n{i}", rnd.choice(["section", "list_item", "list_item"]), rnd.choice("abcdefg")) for i in range(400)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "node_id string, node_type string, section_key string, pos int")
    got = structure.link_parents(df).select("node_id", "node_level", "parent_article", "article_child_index").collect()
    assert {tuple(r) for r in got} == model_of_links(rows)


def test_upsert_cases(spark):
    s = "ref string, hash string, pos int"
    run = lambda b, st: [(r["pos"], r["action"]) for r in store.upsert_diff(spark.createDataFrame([("k", h, i) for i, h in enumerate(b)], s), spark.createDataFrame([("k", st)] if st else [], "ref string, hash string")).collect()]
    assert run("BA", "A") == [(1, "update")]
    assert run("AA", "A") == []
    assert run("BB", None) == [(0, "insert")]


def test_rules(spark):
    r = rules.merge("eu_regulation", [])
    df = spark.createDataFrame([(1, "> (3) foo\nbody\n  Article 5\n\n\nx")], "doc int, text string")
    assert rules.apply(df, r, "doc").first()["text"] == "3. foo\nbody\n\n## Article 5\n\nx"
    assert [rules.problem(x) for x in ({"type": "x"}, {"type": "heading", "pattern": "(", "level": 1}, {"type": "heading", "pattern": "a", "level": 9}, {"type": "regex_replace", "pattern": "a", "replacement": "$1"}, {"type": "regex_replace", "pattern": r"\d", "replacement": ""}, {"type": "heading", "pattern": "a", "level": 2})] == ["type", "pattern", "level", "replacement", "digits", None]


def test_citations(spark):
    assert column(spark, "a [1]. b [2][3] c [4] d", cite.cited) == [1, 2]
    assert column(spark, "none", cite.cited) is None


def reference_clean(t):
    found = re.findall(f"({T.PERSON})", t)
    return re.sub(T.PERSON, "", t, count=len(found) - 1) if len(found) != 1 else re.sub(T.PERSON, "", t)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_personal_tuples(spark, n):
    text = "x" + "".join(f" and Ann Lee{i} a.b@c.com 1234567{i} then" for i in range(n))
    want = text if n == 0 else reference_clean(text)
    assert column(spark, text, T.clean_text) == want


def test_scalars(spark):
    assert column(spark, "  Prüfung, der\t Größe! ", T.norm_text) == "prüfung der größe"
    assert column(spark, "abc", T.uuid_from) == str(uuid.UUID("900150983cd24fb0d6963f7d28e17f72"))
    assert column(spark, "", lambda c: T.is_watermark(c, "ab", "cd"))
    assert re.match(T.glob_regex("*.t[!a]t"), "x.tbt") and not re.match(T.glob_regex("*.t[!a]t"), "x.tat")


def greedy(texts, least):
    norm = lambda t: re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", t.lower())).strip()
    heads, out = [], []
    for i, t in enumerate(map(norm, texts)):
        h = next((h for h in heads if difflib.SequenceMatcher(None, t, norm(texts[h])).ratio() >= least), None)
        if h is None:
            heads.append(i)
        out.append(i if h is None else h)
    return out


def test_fuzzy_clusters_equal_a_greedy_pass(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(5, 60))) for _ in range(12)]
    texts = []
    for _ in range(60):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        texts.append("".join(t))
    got = dedup.clusters(spark.createDataFrame(list(enumerate(texts)), "pos int, text string")).orderBy("pos").collect()
    assert [r["head"] for r in got] == greedy(texts, 0.88)


def test_fuzzy_clusters_run_to_the_end_or_fail(spark):
    texts = ["a" * (20 - k) + "b" * k for k in range(0, 12, 2)]  # each is similar to the one before only
    df = spark.createDataFrame(list(enumerate(texts)), "pos int, text string")
    assert [r["head"] for r in dedup.clusters(df).orderBy("pos").collect()] == greedy(texts, 0.88)
    with pytest.raises(RuntimeError):
        dedup.clusters(df, rounds=2)


def test_html_table():
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr></table>"
    assert tables.table_to_markdown(html) == "|   a |   b |\n|----:|----:|\n|   1 |   2 |\n|   1 |   3 |\n\n"
    assert tables.table_to_markdown(None) == ""


def test_replies_and_errors(spark):
    df = spark.createDataFrame([(1, "It must hold."), (2, "boom")], "article_id int, text string")

    def fails(prompt):
        if "boom" in prompt:
            raise RuntimeError("no")
        return model("rules")(prompt)

    got = {r["article_id"]: r for r in extract.complete(df, fails).collect()}
    assert got[2]["error"] == "RuntimeError: no"
    assert extract.requirements(spark.createDataFrame([(1, got[1]["reply"])], "article_id int, reply string")).first()["id"] == "1-REQ-001"


def test_ingest_twice_changes_nothing(spark):
    docs = spark.createDataFrame([("a", "# A\n1. x\n2. y"), ("b", "# B\nonly")], "doc string, text string")
    nodes, vectors = ingest.ingest(docs, spark.createDataFrame([], "ref string, hash string"), model("hashing"))
    assert nodes.count() == 4 and vectors.count() == 3
    again, _ = ingest.ingest(docs, nodes.select("ref", "hash"), model("hashing"))
    assert again.count() == 0


def test_answer_modes(spark):
    rows = spark.createDataFrame([("k", 0, "one"), ("k", 1, "two")], "key string, pos int, text string")
    echo = lambda p: p.strip()
    assert answer.synthesize(rows, echo, "key").first()["answer"] == "Source 1:\none\n---------------------\nSource 2:\ntwo"
    assert answer.synthesize(rows, echo, "key", "simple_summarize").first()["answer"] == "one\ntwo"
    with pytest.raises(ValueError):
        answer.synthesize(rows, echo, "key", "other")


def test_scan_and_load(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# hi")
    (tmp_path / ".hidden").write_text("no")
    got = files.load(files.scan(spark, f"file://{tmp_path}")).collect()
    assert [r["text"] for r in got] == ["# hi"]


def test_upsert_stream(spark, tmp_path):
    from corvane.streaming import ingest as stream

    schema = "ref string, hash string, pos int"
    spark.createDataFrame([("a", "1", 0), ("b", "1", 1)], schema).write.parquet(str(tmp_path / "in"))
    for extra in (None, [("a", "2", 0)]):
        if extra:
            spark.createDataFrame(extra, schema).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), f"file://{tmp_path}/table", f"file://{tmp_path}/check")
        q.awaitTermination(60)
    df = spark.createDataFrame([], schema)
    assert {(r["ref"], r["hash"]) for r in stream.stored(spark, f"file://{tmp_path}/table", df.schema).collect()} == {("a", "2"), ("b", "1")}


def test_first_table_line(spark):
    lines = spark.createDataFrame([(0, 1, 5.0, 0.0), (0, 2, 9.0, 0.0)], "page int, line int, y0 double, x0 double")
    tabs = spark.createDataFrame([(0, 7, 6.0)], "page int, tab int, y1 double")
    assert [tuple(r) for r in layout.tables_before(lines, tabs).collect()] == [(0, 7, 2)]


def test_first_table_line_walks_each_row_once(spark):
    lines = spark.range(30_000).selectExpr("0 page", "int(id) line", "double(id % 15000) y0", "double(id % 7) x0")
    tabs = spark.range(3_000).selectExpr("0 page", "int(id) tab", "id * 5 - 0.5 y1")
    got = layout.tables_before(lines, tabs)
    # a frame from the current row to the end is summed up anew for each row
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    first = {t: min((i for i in (5 * t, 5 * t + 15_000)), key=lambda i: (i % 7, i)) for t in range(3_000)}
    assert {r["tab"]: r["line"] for r in got.collect()} == first


def test_first_table_line_of_odd_rows(spark):
    lines = spark.createDataFrame([(0, 1, None, 0.0), (0, 2, 5.0, None), (0, 3, 5.0, 8.0), (0, 4, 9.0, 1.0), (None, 5, 9.0, 1.0)], "page int, line int, y0 double, x0 double")
    tabs = spark.createDataFrame([(0, 1, 5.0), (0, 1, 7.0), (0, 2, None), (None, 3, 1.0), (0, 4, 10.0), (0, 5, 5.5)], "page int, tab int, y1 double")
    assert sorted(tuple(r) for r in layout.tables_before(lines, tabs).collect()) == [(0, 1, 3), (0, 5, 4)]


def test_person_pattern_has_the_same_matches(spark):
    rnd = random.Random(6)
    parts = ["ann", "lee", "a.b", " ", "  ", "@", "x@y", ".com 12345678", ".com", " 12345678", "\n", "_", "%-"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(4, 30))) for _ in range(3000)] + ["a b c@d.com 12345678e f g@h.com 12345678"] * 2
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    pair = [F.regexp_extract_all("t", F.lit(f"({p})"), 1) for p in (T.PERSON, T._PERSON_FAST)]
    assert df.where(F.size(pair[0]) > 0).count() > 20 and df.where(pair[0] != pair[1]).count() == 0
