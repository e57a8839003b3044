"""Readers, pages, sections, state, profiles and answers on small cases with known results."""

import io
import json
import zipfile

import duckdb
import pytest

from corvane.models import model
from corvane.operators import cite, pages, rules, sections, structure, tables
from corvane.plans import answer, corpus, prompts
from corvane.sources import files, readers, state


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_office_files():
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>some</w:t></w:r><w:r><w:t> text</w:t></w:r></w:p><w:tbl><w:tr>{cell("k")}{cell("v")}</w:tr><w:tr>{cell("a")}{cell("1")}</w:tr></w:tbl>'
    doc = zipped(word__document_DOT_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>")
    assert readers.read("/x/a.DOCX", doc)[0][0] == "# Top\n\nsome text\n\n| k   |   v |\n|:----|----:|\n| a   |   1 |"
    par = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    slide = f"<p:sld {A}><p:sp><p:txBody>{par('one')}{par(' ')}</p:txBody></p:sp><p:pic/><a:tbl><a:tr><a:tc>{par('x')}</a:tc><a:tc>{par('')}</a:tc><a:tc>{par('y')}</a:tc></a:tr></a:tbl></p:sld>"
    deck = zipped(ppt__slides__slide1_DOT_xml=slide, ppt__slides__slide2_DOT_xml=f"<p:sld {A}/>")
    assert [t for t, _ in readers.read("b.pptx", deck)] == ["Slide 1\none\n[Image]\nx | y"]
    sheet = f'<worksheet {M}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2"><v>3</v></c></row></sheetData></worksheet>'
    book = zipped(xl__worksheets__sheet1_DOT_xml=sheet, xl__sharedStrings_DOT_xml=f"<sst {M}><si><t>name</t></si></sst>")
    text, meta = readers.read("c.xlsx", book)[0]
    assert text.split("\n")[0] == "|   name |    | 7   |" and (meta["h1"], meta["level"], meta["category"]) == ("sheet1", "1", "excel")


def test_other_files():
    mail = b"From a@b Thu\nSubject: hi\nFrom: a@b\n\nbody\nmore\nFrom c@d Fri\nSubject: two\n\nx\n"
    got = [t for t, _ in readers.read("a.mbox", mail)]
    assert len(got) == 2 and "Subject: hi" in got[0] and got[0].endswith("Content: body\nmore")
    book = zipped(c_DOT_opf='<package><manifest><item id="1" href="b.xhtml"/><item id="2" href="a.xhtml"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></package>', a_DOT_xhtml="<p>second</p>", b_DOT_xhtml="<head><title>t</title></head><p>first</p>")
    assert readers.read("a.epub", book)[0][0] == "first\nsecond"
    with pytest.raises(NotImplementedError):
        readers.read("a.pdf", b"%PDF")
    assert readers.read("a.pdf", b"%PDF", {".pdf": lambda p, d: [("page", {})]}) == [("page", {})]
    assert readers.read("/a.b/noext", "naïve".encode() + b"\xff")[0][0] == "naïve"


def test_load_options(spark):
    rows = spark.createDataFrame([("/d/a.md", b"# x"), ("/d/b.pdf", b"p"), ("/d/c.txt", b"  ")], "path string, content binary")
    got = {r["path"]: r for r in files.load(rows, filename_as_id=True, with_errors=True, file_metadata=lambda p: {"len": len(p), "no": None}).collect()}
    assert got["/d/a.md"]["id"] == "/d/a.md_part_0" and got["/d/a.md"]["metadata"] == {"file_path": "/d/a.md", "len": "7", "category": "Markdown"}
    assert "NotImplementedError" in got["/d/b.pdf"]["error"] and "/d/c.txt" not in got
    with pytest.raises(Exception, match="extractor"):
        files.load(rows, raise_on_error=True).collect()


def test_sections_repeat_and_end(spark):
    rows = [("/t/a.md", "#One\nx\n[!b.md]\n# Two\ny\n# One\nz"), ("/t/b.md", "-- in --\n###deep\nd\n[!./../t/a.md]\n[!none.md]")]
    got = sections.section_tree(spark.createDataFrame(rows, "path string, text string"), spark.createDataFrame([("/t/a.md",)], "path string")).orderBy("place").collect()
    assert [(r["id"], r["level"], r["h1"], r["h3"], r["text"]) for r in got] == [("h1_One", "1", "One", "", "z"), ("h1_One_sub", "0", "One", "", "in"), ("h3_deep", "3", "One", "deep", "d"), ("h1_Two", "1", "Two", "", "y")]


def test_tree_has_no_depth_limit(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n40", "n0")], "parent string, child string")
    got = structure.linked_tree(links, spark.createDataFrame([("n0",)], "id string"))
    assert got.count() == 41 and got.agg({"depth": "max"}).first()[0] == 40


def test_semantic_split(spark):
    text = "Cats purr. Cats sleep. Cats purr and sleep. Tax law is dry. Tax law is long. Tax law is dry and long."
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    got = structure.semantic_split(rows, "id", model("hashing", 256), buffer=0, percentile=0.7).orderBy("id", "chunk").collect()
    assert " ".join(r["text"] for r in got) == text and len(got) >= 2 and {r["id"] for r in got} == {1}


def span(text, size=11.0, flags=0, font="F", y=0.0):
    return {"text": text, "size": size, "flags": flags, "font": font, "x0": 0.0, "y0": y, "x1": 50.0, "y1": y + 10}


def line(n, spans, block=0):
    return {"line": n, "x0": 0.0, "y0": 20.0 * n, "x1": 90.0, "y1": 20.0 * n + 10, "block": block, "spans": spans}


def test_page_parts():
    info = {"body": 11, "sizes": [20, 15], "by_size": True}
    page = {"info": info, "images": [{"image": 0, "rect": {"x0": 0, "y0": 90, "x1": 9, "y1": 95}, "name": "i.png"}], "links": [{"rect": {"x0": 1, "y0": 61, "x1": 5, "y1": 65}, "uri": "u"}]}
    page["tables"] = [{"tab": 0, "rect": {"x0": 0, "y0": 18, "x1": 90, "y1": 32}, "markdown": "|t|"}]
    page["lines"] = [line(0, [span("Long", 20)]), line(1, [span("in the table")]), line(2, [span("and wide", 15)], 1), line(3, [span("click", y=60.0), span("b", flags=18)], 2), line(4, [span("• item")], 2), line(5, [span("x = 1", flags=8)], 3), line(6, [span("cut-")], 4), line(7, [span("off")], 4)]
    got = pages.render(page)
    assert "in the table" not in got and got.startswith("# Long\n") and got.index("|t|") < got.index("## and wide\n") < got.index("[click](u) **_b_**\n") < got.index("\n-  item\n")
    assert "```\nx = 1\n" in got and got.index("![i.png](i.png)") < got.index("cut") and "cut\noff" in got
    two = {**page, "tables": [], "images": [], "links": [], "lines": [line(0, [span("A title of", 20)]), line(1, [span("two lines", 20)]) | {"y0": 12.0, "y1": 22.0}]}
    assert pages.render(two).startswith("# A title of two lines\n")
    assert pages.margins(3) == (3, 3, 3, 3) and pages.margins((1, 2)) == (0, 1, 0, 2)
    with pytest.raises(ValueError):
        pages.margins((1, 2, 3))


def test_fonts_vote(spark):
    def row(page, n, text, size, font="F"):
        return (1, page, n, [(text, float(size), 0, font)])

    lines = [row(0, 0, "Big", 20), row(0, 1, "1 One and more", 11), row(0, 2, "1.1 Two", 11), row(0, 3, "plain text that is long enough to be the body", 11), row(0, 4, "Next", 16), row(0, 5, "1.1.1 Three", 11)]
    df = spark.createDataFrame(lines, "doc int, page int, line int, spans array<struct<text:string,size:double,flags:int,font:string>>")
    got = pages.header_info(pages.fonts(df)).first()
    assert (got["body"], list(got["sizes"]), got["by_size"]) == (11, [20, 16], False)


def test_nested_tables_and_html():
    text = "a\n<table>\n<tr><td>o\n<table>\n<tr><td>i</td></tr>\n</table>\n</td></tr>\n</table>\nb"
    got = tables.replace_tables(text)
    assert got.startswith("a|") and got.endswith("b") and "<table" not in got
    assert tables.pipe_table(["x"], [["1.5"], ["10"], [""]]) == "|    x |\n|-----:|\n|  1.5 |\n| 10   |\n|      |"
    assert cite.html_of("### Q:\na\\_b\n\n- one\n- **two**\n") == "<h3>Q:</h3>\n<p>a_b</p>\n<ul>\n<li>one</li>\n<li><strong>two</strong></li>\n</ul>\n"


def test_profile():
    found = {"document_type": "law", "document_class": "eu_regulation", "discovered_rules": [{"type": "heading", "pattern": "^Annex", "level": 1}]}
    replies = iter(["```json\n" + json.dumps(found) + "\n```", json.dumps({"rules": [{"type": "heading", "pattern": "^Annex", "level": 1}]})])
    got = rules.generate_profile("Article 5\ntext", lambda p: next(replies))
    assert len(got["rules"]) == 1 and got["document_class"] == "eu_regulation" and got["confidence"] == 0.0
    whole = rules.generate_profile("x", lambda p: json.dumps(found), review=False)
    assert [r["priority"] for r in whole["rules"]] == [10, 20, 110, 130, 1000]
    for bad in ({"rules": []}, {**found, "discovered_rules": [{"type": "heading", "pattern": "", "level": 1}]}, {**found, "discovered_rules": "no"}):
        with pytest.raises(ValueError):
            rules.generate_profile("x", lambda p, b=bad: json.dumps(b))
    assert rules.python_replacement("$1. x") == "\\1. x"


def test_state(spark, tmp_path):
    d = f"file://{tmp_path}"
    assert state.load_json(spark, f"{d}/a/b.json", 5) == 5
    state.save_json(spark, f"{d}/a/b.json", {"x": "é"})
    state.save_json(spark, f"{d}/a/b.json", {"heading_rules": [{"pattern": "^§", "level": 1}]})
    assert state.load_rules(spark, family="b", folder=f"{d}/a") == [{"pattern": "^§", "level": 1, "strip_match": False}]
    state.save_json(spark, f"{d}/a/c.json", {"heading_rules": [{"level": 1}]})
    assert state.load_rules(spark, f"{d}/a/c.json") == state.load_rules(spark) == state.load_rules(spark, f"{d}/none.json") == []
    family = {"family_id": "f", "family_description": "", "hierarchy": [{"level": 1, "name": "n", "pattern": "^x"}]}
    state.save_family(spark, f"{d}/families", family)
    assert state.load_family(spark, f"{d}/families", "f")["hierarchy"] == family["hierarchy"] and state.list_families(spark, f"{d}/families") == ["f"]
    for k in range(4):
        state.save(spark.range(k), f"{d}/t")
    assert state.versions(spark, f"{d}/t") == [2, 3] and state.newest(spark, f"{d}/t").count() == 3 and state.newest(spark, f"{d}/t", 3).count() == 2
    with pytest.raises(ValueError):
        state.drop_tables(spark, d, [])
    with pytest.raises(ValueError):
        state.one_path(spark.createDataFrame([("a",), ("b",)], "path string"))


def test_answers_fold(spark):
    rows = spark.createDataFrame([("k", 0, "one"), ("k", 1, "two"), ("k", 2, "three")], "key string, pos int, text string")
    asked = spark.createDataFrame([("k", "why"), ("none", "what")], "key string, question string")
    show = lambda p: f"<{p.strip()}>"

    def got(mode, **more):
        return {r["key"]: r["answer"] for r in answer.synthesize(rows, show, "key", mode, questions=asked, **more).collect()}

    assert got("refine") == {"k": "<<<one>\ntwo>\nthree>", "none": "Empty Response"}
    assert got("compact", chunk=9)["k"] == "<<one\n\ntwo>\nthree>"
    assert got("cite_compact")["k"] == "<Source 1:\none\n\nSource 2:\ntwo\n\nSource 3:\nthree>"
    assert got("tree_summarize", chunk=14)["k"].startswith("<") and got("generation") == {"k": "<why>", "none": "<what>"}
    assert "Question: why" in got("compact", templates=prompts.select)["k"]
    with pytest.raises(ValueError):
        answer.synthesizer("no_text")
    told = answer.synthesize(rows, lambda p: '{"a": "x"}', "key", "compact", fields=("a", "b")).first()
    assert (told["a"], told["b"]) == ("x", None) and len(answer.NAMES) == 16 and set(answer.MODES) <= set(answer.NAMES)
    assert prompts.select("cite_compact", "answer", chat=True)[0]["role"] == "system"


def test_extraction_resumes(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "must do", "article", "/x/", None, None, 0), ("b", "must not", "article", None, None, None, 1), ("c", "kid", "paragraph", None, "a", 0, 2)], "node_id string, text string, node_level string, header_path string, parent_article string, article_child_index int, pos int")
    d = f"file://{tmp_path}/run"

    def first(prompt):
        if "must not" in prompt:
            raise RuntimeError("down")
        return '{"requirements": [{"requirement": "do it", "id": "own"}]}'

    one = corpus.extract_corpus(nodes, first, d)
    assert {r["article_id"]: (r["status"], r["child_count"], r["requirements_extracted"]) for r in one.coverage.collect()} == {"a": ("success", 1, 1), "b": ("error", 0, 0)}
    two = corpus.extract_corpus(nodes, lambda p: '{"requirements": [{"requirement": "do it"}]}' if "must not" in p else 1 / 0, d)
    rows = {r["source_article_id"]: r for r in two.requirements.collect()}
    assert rows["a"]["id"] == "own" and rows["b"]["id"] == "b-REQ-001" and rows["a"]["source_section"] == "/x/"
    assert two.merged.count() == 1 and two.payload.first()["requirements_raw_count"] == 2
    corpus.save_payload(spark, two, f"{d}/final.json")
    assert state.load_json(spark, f"{d}/final.json")["article_nodes_cached_or_processed"] == 2


def test_file_cache_of_pages_with_one_address(spark, tmp_path):
    from corvane import catalogue

    rows = [(0, "/a", "x"), (1, "/a", "y"), (2, "/a", "y"), (3, "/b", "z"), (4, None, "z"), (6, None, "z")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    told = con.execute(catalogue.oracle_sql()["q65_file_cache"]).fetchall()
    got = catalogue.queries()["q65_file_cache"](spark, f"file://{tmp_path}").select("path", "checksum", "n_documents").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, told)) and len(got) == 6


def test_file_cache_by_path(spark, tmp_path):
    """Files that their path tells apart: the latest checksum, and the documents of all entries."""
    load = lambda *rows: state.add_to_cache(spark, f"file://{tmp_path}/cache", spark.createDataFrame(rows, "path string, checksum string, text string"))
    load(("/a", "1", "one"), ("/a", "1", "two"), ("/b", None, "three"))
    cache = load(("/a", "2", "four"), ("/b", None, "three"))
    assert sorted(tuple(r) for r in state.cache_index(cache).collect()) == [("/a", "2", 3), ("/b", None, 1)]
