"""The queries of the document engine and the SQL each one equals.

The input tables stand in for documents: orders are articles, line items their
paragraphs, conversations ordered children, embeddings leaf vectors with their
label as parent, pages files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .models import model
from .operators import cite, dedup, extract, layout, retrieve, rules, store, structure, tables
from .plans import answer, ingest
from .session import shared_dir
from .sources import files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- retrieval ------------------------------------------------------------
def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("node_id"), "embedding", F.col("label").alias("parent"), F.concat(F.lit("v"), F.col("vec_id")).alias("text"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    query = v.where("node_id = 0").first()["embedding"]
    return retrieve.top_k(v, query, 10)


_HITS = """WITH h AS (SELECT vec_id AS node_id, label AS parent, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT *, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings)
  ORDER BY score DESC, vec_id LIMIT 10),
p AS (SELECT parent, max(score) AS score, min(rank) AS first_rank, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY rank) AS hit_ids
  FROM h GROUP BY parent ORDER BY 2 DESC, 3 LIMIT 3) """


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.parent_scores(_hits(spark, d), 3)


@_query(_HITS + """SELECT p.parent, round(p.score, 6) AS score, hit_ids, count(*) AS n_children, string_agg('v' || e.vec_id, chr(10) || chr(10) ORDER BY e.vec_id) AS context
  FROM p JOIN embeddings e ON e.label = p.parent GROUP BY 1, 2, 3""")
def q01_parent_expansion_merged(spark, d):
    rows = retrieve.siblings(_parents(spark, d), _vectors(spark, d), order=(F.col("node_id"),))
    return retrieve.merged(rows).select("parent", F.round("score", 6).alias("score"), "hit_ids", "n_children", "context")


@_query(_HITS + """SELECT * FROM (SELECT p.parent, round(p.score, 6) AS score, e.vec_id AS node_id, row_number() OVER (PARTITION BY p.parent ORDER BY e.vec_id) AS place
  FROM p JOIN embeddings e ON e.label = p.parent) WHERE place <= 5""")
def q02_parent_expansion_siblings(spark, d):
    rows = retrieve.siblings(_parents(spark, d), _vectors(spark, d), order=(F.col("node_id"),), most=5)
    return rows.select("parent", F.round("score", 6).alias("score"), "node_id", "place")


@_query(_HITS + "SELECT node_id, round(score, 6) AS score FROM h")
def q03_vector_topk(spark, d):
    return _hits(spark, d).select("node_id", F.round("score", 6).alias("score"))


@_query(_HITS + "SELECT parent, round(score, 6) AS score, first_rank, hit_ids FROM p")
def q04_parent_score_max(spark, d):
    ids = F.array_join(F.transform("hits", lambda h: h["node_id"].cast("string")), ",")
    return _parents(spark, d).select("parent", F.round("score", 6).alias("score"), "first_rank", ids.alias("hit_ids"))


# -- structure ------------------------------------------------------------
def _rendered(spark: SparkSession, d: str, head: str = "# Order ") -> DataFrame:
    """Each order as markdown: a heading, a section, its line items as a numbered list, a fence that looks like one."""
    items = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))).alias("ls")
    )
    item = F.array_join(F.transform("ls", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". part "), x["l_partkey"].cast("string"), F.lit("\nfrom "), x["l_suppkey"].cast("string"))), "\n")
    o = _t(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.concat(F.lit("intro\n" + head), F.col("o_orderkey").cast("string"), F.lit("\nstatus "), F.col("o_orderstatus"), F.lit("\n## "), F.col("o_orderpriority"), F.lit("\n"), F.coalesce(item, F.lit("none")), F.lit("\n```\n# no heading\n```\nend\n"))
    return o.select(F.col("o_orderkey").alias("doc"), text.alias("text"))


_RENDER = """WITH RECURSIVE ls AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem),
it AS (SELECT l_orderkey, string_agg(i || '. part ' || l_partkey || chr(10) || 'from ' || l_suppkey, chr(10) ORDER BY i) AS item FROM ls GROUP BY 1),
docs AS (SELECT o_orderkey AS doc, 'intro' || chr(10) || '{head}' || o_orderkey || chr(10) || 'status ' || o_orderstatus || chr(10) || '## ' || o_orderpriority || chr(10) || coalesce(item, 'none')
  || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || 'end' AS text FROM orders LEFT JOIN it ON l_orderkey = o_orderkey),
ln AS (SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
fe AS (SELECT *, regexp_matches(line, '^\\s*```') AS fence FROM ln),
ins AS (SELECT *, sum(CAST(fence AS INT)) OVER w % 2 AS inside FROM fe WINDOW w AS (PARTITION BY doc ORDER BY pos)),
kd AS (SELECT *, CASE WHEN fence OR inside = 1 THEN 'body' WHEN {h1} THEN 'h1' WHEN regexp_matches(line, '^##\\s+.+') THEN 'h2' WHEN regexp_matches(line, '^\\d+\\.\\s+.+') THEN 'li' ELSE 'body' END AS kind,
  trim(regexp_replace(line, '^#{{1,2}}\\s+', '')) AS title FROM ins),
sg AS (SELECT *, sum(CAST(kind <> 'body' AS INT)) OVER w AS seg, last_value(CASE WHEN kind = 'h1' THEN title END IGNORE NULLS) OVER w AS h1,
  last_value(CASE WHEN kind = 'h1' THEN '' WHEN kind = 'h2' THEN title END IGNORE NULLS) OVER w AS h2, last_value(CASE WHEN kind = 'li' THEN 'list_item' WHEN kind <> 'body' THEN 'section' END IGNORE NULLS) OVER w AS tp
  FROM kd WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
nd AS (SELECT doc, seg, trim(string_agg(line, chr(10) ORDER BY pos)) AS text, coalesce(max(tp), 'section') AS node_type, coalesce(max(h1), '') AS h1, coalesce(max(h2), '') AS h2,
  max(CASE WHEN kind = 'li' THEN CAST(regexp_extract(line, '^(\\d+)\\.', 1) AS INT) END) AS list_index FROM sg GROUP BY doc, seg)
SELECT doc, seg, text, node_type, h1, h2, '/' || CASE WHEN h1 <> '' THEN h1 || '/' ELSE '' END || CASE WHEN h2 <> '' THEN h2 || '/' ELSE '' END AS header_path, list_index FROM nd WHERE text <> ''"""


@_query(_RENDER.format(head="# Order ", h1="regexp_matches(line, '^#\\s+.+')"))
def q05_markdown_split(spark, d):
    return structure.markdown_split(_rendered(spark, d), "doc")


@_query(_RENDER.format(head="Order ", h1="regexp_matches(line, '^#\\s+.+') OR regexp_matches(line, '^Order \\d+')"))
def q06_heading_rules_split(spark, d):
    return structure.markdown_split(_rendered(spark, d, "Order "), "doc", heading=F.when(F.col("line").rlike(r"^(?:Order \d+)"), 1))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sections and line items as list items of one stream; the key is the order."""
    o = _t(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("node_id"), F.lit("section").alias("node_type"), F.col("o_orderkey").alias("section_key"), F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b")).alias("pos"))
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    n = _t(spark, d, "lineitem").withColumn("n", F.row_number().over(w).cast("long"))
    n = n.select(F.concat(F.lit("l"), F.col("l_orderkey"), F.lit("-"), F.col("n")).alias("node_id"), F.lit("list_item").alias("node_type"), F.col("l_orderkey").alias("section_key"), F.struct(F.lit(1).alias("a"), F.col("n").alias("b")).alias("pos"))
    return o.unionByName(n)


_LINK = """WITH ls AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
r AS (SELECT 'o' || o_orderkey AS node_id, 'section' AS node_type, o_orderkey AS k, 0 AS n FROM orders UNION ALL SELECT 'l' || l_orderkey || '-' || n, 'list_item', l_orderkey, n FROM ls),
x AS (SELECT *, last_value(CASE WHEN node_type = 'section' THEN node_id END IGNORE NULLS) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS par,
  sum(CAST(node_type = 'list_item' AS INT)) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS ix,
  max(CASE WHEN node_type = 'list_item' THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS has FROM r),
linked AS (SELECT node_id, CASE WHEN node_type = 'list_item' OR has = 0 THEN 'paragraph' ELSE 'article' END AS node_level, CASE WHEN node_type = 'list_item' THEN par END AS parent_article,
  CASE WHEN node_type = 'list_item' AND par IS NOT NULL THEN CAST(ix AS INT) END AS article_child_index, node_type FROM x) """


@_query(_LINK + "SELECT node_id, node_level, parent_article, article_child_index FROM linked")
def q07_link_parents(spark, d):
    return structure.link_parents(_nodes(spark, d)).select("node_id", "node_level", "parent_article", "article_child_index")


@_query(_LINK + "SELECT node_id FROM linked WHERE node_type = 'section' AND node_level = 'paragraph'")
def q08_promote_childless(spark, d):
    return structure.link_parents(_nodes(spark, d)).where("node_type = 'section' and node_level = 'paragraph'").select("node_id")


@_query(_LINK + "SELECT node_id, parent_article FROM linked WHERE node_level = 'paragraph'")
def q09_leaf_filter(spark, d):
    return structure.leaves(structure.link_parents(_nodes(spark, d))).select("node_id", "parent_article")


# -- stores ---------------------------------------------------------------
def _batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents by source and length as refs that change; what is stored are documents of an earlier run."""
    docs = _t(spark, d, "documents").withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    batch = docs.select(F.concat_ws("-", "source", (F.col("n_chars") % 37).cast("string")).alias("ref"), "hash", F.col("doc_id").alias("pos"))
    old = docs.where("n_chars % 3 = 0").groupBy(F.concat_ws("-", "source", (F.col("n_chars") % 37).cast("string")).alias("ref")).agg(F.min_by("hash", "doc_id").alias("hash"))
    return batch, old


_BATCH = """WITH dd AS (SELECT *, sha256(coalesce(text, '')) AS hash FROM documents),
b AS (SELECT source || '-' || (n_chars % 37) AS ref, hash, doc_id AS pos FROM dd),
s AS (SELECT source || '-' || (n_chars % 37) AS ref, arg_min(hash, doc_id) AS hash FROM dd WHERE n_chars % 3 = 0 GROUP BY 1) """


@_query(_BATCH + """, c AS (SELECT b.*, s.hash AS st, coalesce(lag(b.hash) OVER (PARTITION BY b.ref ORDER BY pos), s.hash) AS pv FROM b LEFT JOIN s USING (ref))
SELECT ref, hash, pos, CASE WHEN st IS NULL THEN 'insert' ELSE 'update' END AS action FROM (SELECT *, max(pos) OVER (PARTITION BY ref) AS mx FROM c WHERE hash IS DISTINCT FROM pv) WHERE pos = mx""")
def q10_upsert_diff(spark, d):
    return store.upsert_diff(*_batch(spark, d)).select("ref", "hash", "pos", "action")


@_query(_BATCH + "SELECT ref, hash FROM s WHERE ref NOT IN (SELECT ref FROM b WHERE pos % 7 > 2)")
def q11_upsert_delete(spark, d):
    batch, old = _batch(spark, d)
    return store.deletes(batch.where("pos % 7 > 2"), old).select("ref", "hash")


@_query(_BATCH + "SELECT hash, min(pos) AS pos FROM b WHERE hash NOT IN (SELECT hash FROM s) GROUP BY hash")
def q12_duplicates_only(spark, d):
    return store.duplicates_only(*_batch(spark, d)).select("hash", "pos")


@_query("""WITH f AS (SELECT url AS path, sha256(html) AS checksum, page_id FROM pages) SELECT path, checksum FROM f
WHERE (path, checksum) NOT IN (SELECT path, CASE WHEN page_id % 3 = 0 THEN 'old' ELSE checksum END FROM f WHERE page_id % 2 = 0)""")
def q13_file_manifest_resume(spark, d):
    f = _t(spark, d, "pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("checksum"), "page_id")
    seen = f.where("page_id % 2 = 0").select("path", F.when(F.col("page_id") % 3 == 0, "old").otherwise(F.col("checksum")).alias("checksum"))
    return store.not_in_manifest(f, seen).select("path", "checksum")


# -- text -----------------------------------------------------------------
def _dirty() -> F.Column:
    extra = "\n \n\n\nundefined undefined undefined\nsee .... and . . . .\n[some/file.md]\nxls(\"a.xlsx\")\nAnn Lee ann.lee@x.com 12345678 tail"
    return F.concat(F.coalesce("text", F.lit("")), F.lit(extra))


@_query()
def q14_text_clean(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.clean_text(_dirty())).alias("clean"))


@_query("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^\\pL\\pN_\\s]', '', 'g')) AS norm FROM documents""")
def q15_norm_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.norm_text(F.col("text")).alias("norm"))


@_query()
def q16_fuzzy_dedup(spark, d):
    """All benchmark passages, and each again with a word at its end."""
    b = _t(spark, d, "benchmark")
    rows = b.select((F.col("item_id") * 2).alias("pos"), "text").union(b.select((F.col("item_id") * 2 + 1).alias("pos"), F.concat("text", F.lit(" again"))))
    return dedup.clusters(rows)


# -- extraction -----------------------------------------------------------
def _talks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, d, "conversations")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first"))
    c = c.join(first, "conv_id")
    art = c.where("turn = first").select(F.col("conv_id").alias("article_id"), "text")
    kids = c.where("turn > first").select(F.col("conv_id").alias("parent"), F.when(F.col("turn") % 5 != 0, F.col("turn")).alias("idx"), F.col("turn").alias("pos"), "text")
    return art, kids


_ART = """WITH c AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations),
a AS (SELECT conv_id AS article_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY CASE WHEN turn = f THEN -1 WHEN turn % 5 <> 0 THEN turn ELSE 1000000000 END, turn) AS text,
  CAST(count(*) FILTER (turn > f) AS INT) AS n_children FROM c GROUP BY conv_id) """


@_query(_ART + "SELECT article_id, coalesce(text, '') AS text, n_children FROM a")
def q17_assemble_article(spark, d):
    return extract.assemble(*_talks(spark, d), key="article_id")


@_query(_ART + ", g AS (SELECT conv_id, count(*) AS n FROM conversations WHERE text LIKE '%?%' GROUP BY 1) SELECT article_id, n_children, CAST(length(coalesce(text, '')) AS INT) AS text_length, CASE WHEN article_id % 7 = 0 THEN 0 ELSE coalesce(n, 0) END AS requirements_extracted, CASE WHEN article_id % 7 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN article_id % 7 = 0 THEN 'late' END AS error FROM a LEFT JOIN g ON conv_id = article_id")
def q18_coverage_log(spark, d):
    found = _t(spark, d, "conversations").where("text like '%?%'").select(F.col("conv_id").alias("article_id"))
    texts = extract.assemble(*_talks(spark, d), key="article_id")
    failed = texts.where("article_id % 7 = 0").select("article_id", F.lit("late").alias("error"))
    return extract.coverage(texts, found, "article_id", failed)


@_query("""SELECT article_id, article_id || '-REQ-' || lpad(CAST(n AS VARCHAR), 3, '0') AS id, 'topic' AS topic, requirement, severity FROM (
SELECT event_id AS article_id, 1 AS n, event_type AS requirement, 'high' AS severity FROM events UNION ALL SELECT event_id, 3, CAST(user_id AS VARCHAR), 'medium' FROM events)""")
def q19_requirement_parse(spark, d):
    reply = F.concat(F.lit('Here:\n```json\n{"requirements": [{"topic": " topic", "requirement": "'), F.col("event_type"), F.lit('", "severity": "high"}, {"requirement": " "}, {"topic": "topic", "requirement": "'), F.col("user_id").cast("string"), F.lit('"}]}\n```'))
    return extract.requirements(_t(spark, d, "events").select(F.col("event_id").alias("article_id"), reply.alias("reply"))).select("article_id", "id", "topic", "requirement", "severity")


@_query("SELECT DISTINCT conv_id AS article_id, conv_id % 3 = 0 AS cached FROM conversations")
def q20_requirement_resume(spark, d):
    every = _t(spark, d, "conversations").select(F.col("conv_id").alias("article_id")).distinct()
    cache = every.where("article_id % 3 = 0")
    return extract.to_process(every, cache).withColumn("cached", F.lit(False)).unionByName(cache.withColumn("cached", F.lit(True)))


# -- rules ----------------------------------------------------------------
_LINES = "WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) "


def _doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


_MARK = "CASE pos % 4 WHEN 0 THEN '> ' WHEN 1 THEN '  (' || pos || ') ' WHEN 2 THEN '  Article ' || pos || ' ' ELSE 'CHAPTER IV ' END || line"


@_query(_LINES + f"SELECT doc_id, pos, regexp_replace(regexp_replace({_MARK}, '^>\\s?', ''), '^(\\s*)\\(?(\\d+)\\)\\s+', '\\1\\2. ') AS line FROM ln")
def q21_rule_regex_rewrite(spark, d):
    return _doc_lines(spark, d).withColumn("line", F.expr(_MARK)).withColumn("line", rules.rewrite(F.col("line"), rules.merge("", [])))


@_query(_LINES + f", m AS (SELECT doc_id, pos, {_MARK} AS line FROM ln) SELECT doc_id, pos, CASE pos % 4 WHEN 2 THEN '## ' || regexp_replace(line, '^\\s+|\\s+$', '', 'g') WHEN 3 THEN '# ' || regexp_replace(line, '^\\s+|\\s+$', '', 'g') ELSE line END AS line FROM m")
def q22_rule_heading(spark, d):
    return _doc_lines(spark, d).withColumn("line", F.expr(_MARK)).withColumn("line", rules.promote(F.col("line"), rules.merge("eu_regulation", [])))


_BLANKS = "CASE WHEN pos % 5 IN (1, 2) THEN ' ' WHEN pos % 5 = 4 THEN '# h' ELSE 'x' || line END"


@_query(_LINES + f""", m AS (SELECT doc_id, pos, {_BLANKS} AS line FROM ln), k AS (SELECT * FROM (SELECT *, lag(trim(line) = '') OVER w AS pb FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE trim(line) <> '' OR NOT coalesce(pb, false)),
n AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS pl FROM k)
SELECT doc_id, pos, 1 AS sub, line FROM n UNION ALL SELECT doc_id, pos, 0, '' FROM n WHERE line LIKE '# %' AND trim(pl) <> ''""")
def q23_blank_lines(spark, d):
    rows = _doc_lines(spark, d).withColumn("line", F.expr(_BLANKS))
    return rules.blank_before_headings(rules.collapse_blanks(rows, "doc_id"), "doc_id")


_OWN = [{"type": "heading", "pattern": "^Annex", "level": 1}, {"type": "heading", "pattern": "^Part", "level": 1, "priority": 15}]


@_query(r"""SELECT CAST(row_number() OVER (ORDER BY p, o) AS INT) AS place, pattern, source FROM (VALUES (10, 0, '^>\s?', 'static_generic'), (20, 1, '^(\s*)\(?(\d+)\)\s+', 'static_generic'),
(110, 2, '^CHAPTER\s+[IVXLCM\d]+\b', 'static_eu_regulation'), (130, 3, '^\s*Article\s+\d+\s*', 'static_eu_regulation'), (1000, 4, '^Annex', 'ai'), (15, 5, '^Part', 'ai')) t(p, o, pattern, source)""")
def q24_rule_merge_priority(spark, d):
    got = rules.merge("eu_regulation", _OWN)
    return spark.createDataFrame([(i, r["pattern"], r["source"]) for i, r in enumerate(got, 1)], "place int, pattern string, source string")


@_query(r"""SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'type' WHEN p_size % 4 = 0 AND NOT p_size % 9 BETWEEN 1 AND 6 THEN 'level' WHEN p_size % 4 = 1 AND p_brand LIKE '%3' THEN 'replacement' WHEN p_size % 4 = 2 THEN 'digits' END AS problem FROM part""")
def q25_rule_validate(spark, d):
    p = _t(spark, d, "part")
    k = F.col("p_size") % 4
    kind = F.when(k == 0, "heading").when(k < 3, "regex_replace").otherwise("other")
    new = F.when(k == 1, F.when(F.col("p_brand").endswith("3"), "a$").otherwise("a")).otherwise("")
    return p.select("p_partkey", rules.problem_column(kind, F.lit(r"^\d+"), F.col("p_size") % 9, new).alias("problem"))


@_query(r"""WITH l AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents WHERE text <> ''),
n AS (SELECT *, len(ls) AS n, list_filter(ls, lambda x: regexp_matches(x, '^\s*>?\s*Article\s+\d+\b|^\s*>?\s*CHAPTER\s+[IVXLCM\d]+\b|^\s*>?\s*Section\s+\d+\b|^\s*\(?\d+\)\s+|^\s*\d+\.\s+|^\s*>|^\s*#{1,6}\s+|^Whereas:$|^[A-Z][A-Z\s,\-()0-9]{10,}$')) AS t FROM l)
SELECT doc_id, md5(substr('=== BEGINNING ===' || chr(10) || array_to_string(ls[1:250], chr(10)) || chr(10) || chr(10) || '=== STRUCTURAL SIGNALS ===' || chr(10) || array_to_string(t[1:500], chr(10)) || chr(10) || chr(10) || '=== MIDDLE ===' || chr(10)
|| array_to_string(ls[greatest(n // 2 - 125, 0) + 1:n // 2 + 125], chr(10)) || chr(10) || chr(10) || '=== END ===' || chr(10) || array_to_string(ls[greatest(n - 249, 1):n], chr(10)), 1, 24000)) AS sample FROM n""")
def q26_representative_sample(spark, d):
    return _t(spark, d, "documents").where("text <> ''").select("doc_id", F.md5(rules.sample(F.col("text"))).alias("sample"))


# -- citations ------------------------------------------------------------
@_query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS source_no, 'Source ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ':' || chr(10) || text || chr(10) AS text FROM conversations")
def q27_cite_sources(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    return cite.label_sources(rows, "conv_id", "turn")


_ANSWER = "text || ' a [2]. b [1][3] c [4] d [' || (turn % 3) || ']'"


@_query("SELECT conv_id, turn, '1,2,' || '0' AS cited FROM conversations WHERE false UNION ALL SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '0,1,2' ELSE '1,2' END FROM conversations")
def q28_cite_extract(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(cite.cited(F.expr(_ANSWER)).cast("array<string>"), ",").alias("cited"))


def _cited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, d, "conversations")
    rows = c.withColumn("source_no", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    sources = rows.select(F.col("conv_id").alias("key"), "source_no", F.concat(F.lit("/data/LLM/c"), F.col("conv_id"), F.lit("/"), F.col("turn")).alias("path"), "text", F.col("role").alias("h1"), F.lit("").alias("h2"), F.when(F.col("turn") % 2 == 1, "odd").alias("h3"))
    answers = c.groupBy(F.col("conv_id").alias("key")).agg(F.concat(F.lit("so [1]. and [0]! but [2][99]"), F.max("turn").cast("string")).alias("answer"))
    return answers, sources


_DETAIL = """WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
a AS (SELECT unnest([0, 1, 2]) AS number),
x AS (SELECT conv_id AS key, number, '[' || number || ']  ' || chr(10) || '**Directory:** /c' || conv_id || '/' || turn || '  ' || chr(10) || '**Text:** ' || text || '  ' || chr(10) || '**Heading 1:** ' || role || '  '
|| CASE WHEN turn % 2 = 1 THEN chr(10) || '**Heading 3:** odd  ' ELSE '' END AS detail FROM s JOIN a ON no = CASE WHEN number = 0 THEN n ELSE number END) """


@_query(_DETAIL + "SELECT * FROM x")
def q29_cite_details(spark, d):
    return cite.details(*_cited(spark, d))


@_query("SELECT doc_id, regexp_replace(text, '([_\\[\\]()~`>#+\\-=|{}.!\\\\])', '\\\\\\1', 'g') AS escaped FROM documents")
def q30_escape_markdown(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.escape_markdown(F.col("text")).alias("escaped"))


@_query("SELECT doc_id, regexp_replace(md5(text), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid FROM documents")
def q31_uuid_from_key(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.uuid_from(F.col("text")).alias("uuid"))


# -- files ----------------------------------------------------------------
_PATH = "concat('/root/', CASE page_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'bc' WHEN 2 THEN '.h' ELSE '' END, CASE WHEN page_id % 4 < 3 THEN '/' ELSE '' END, 'p', page_id, CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.PDF' ELSE '.txt' END)"
_FILES = f"WITH f AS (SELECT page_id, {_PATH} AS path FROM pages) "


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.expr(_PATH).alias("path"))


@_query(_FILES + """SELECT path, 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.PDF' ELSE '.txt' END AS name, CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.PDF' ELSE '.txt' END AS suffix,
CASE page_id % 3 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'application/pdf' ELSE 'text/plain' END AS mime, split_part(substr(path, 7), '/', 1) AS main_dir FROM f""")
def q32_file_metadata(spark, d):
    return files.metadata(_paths(spark, d), root="/root").select("path", "name", "suffix", "mime", "main_dir")


@_query(_FILES + "SELECT path FROM f WHERE page_id % 3 <> 1 AND page_id % 4 <> 2 AND NOT regexp_matches(path, '^.*p.7[.]...?$') AND NOT starts_with(path, '/root/b') AND (page_id % 3 <> 0 OR path LIKE '%p1%')")
def q33_file_filters(spark, d):
    return files.prune(_paths(spark, d), exclude=("*p?7.*",), exclude_dirs=("/root/b",), required=(".md", ".txt"), tree_root=("p1*.md",)).select("path")


# -- layout ---------------------------------------------------------------
def _spans(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 3).alias("flags"), F.col("p_brand").alias("font"), F.col("p_name").alias("text"))


_FONTS = "WITH f AS (SELECT p_size || '_' || (p_partkey % 3) || '_' || p_brand AS ident, p_size AS size, sum(length(trim(p_name))) AS n_chars, count(*) AS n FROM part GROUP BY 1, 2) "


@_query(_FONTS + "SELECT ident, size, CAST(n_chars AS BIGINT) AS n_chars, n FROM f")
def q34_font_histogram(spark, d):
    return layout.font_histogram(_spans(spark, d))


@_query(_FONTS + """, s AS (SELECT size, sum(n_chars) AS c FROM f GROUP BY 1), b AS (SELECT size AS body FROM s WHERE size >= 10 ORDER BY c DESC, size LIMIT 1)
SELECT size, CAST(row_number() OVER (ORDER BY size DESC) AS INT) AS level FROM s, b WHERE size > body AND size <= 60 ORDER BY size DESC LIMIT 3""")
def q34b_heading_sizes(spark, d):
    return layout.heading_sizes(layout.font_histogram(_spans(spark, d)), largest=60)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents, turns as pages, with a header and a page number."""
    c = _t(spark, d, "conversations").withColumn("page", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)
    ls = F.concat(F.array(F.lit("Report A-12"), F.concat(F.lit("page "), F.col("page").cast("string"))), F.split(F.coalesce("text", F.lit("")), "(?<=[.!?]) "), F.array(F.lit("(c) nobody")))
    return c.select(F.col("conv_id").alias("doc"), "page", ls.alias("lines"))


_EDGE = """WITH c AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page, text FROM conversations),
p AS (SELECT doc, page, list_concat(list_concat(['Report A-12', 'page ' || page], string_split(regexp_replace(coalesce(text, ''), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))), ['(c) nobody']) AS ls FROM c),
five AS (SELECT doc, page, list_resize({cut}, 5, '') AS f FROM p),
cell AS (SELECT doc, page, unnest(f) AS line, generate_subscripts(f, 1) - 1 AS slot FROM five),
m AS (SELECT *, regexp_replace(line, '[0-9]{{1,4}}', '@', 'g') AS mk FROM cell), l AS (SELECT doc, max(page) AS last FROM cell GROUP BY 1),
pr AS (SELECT a.doc, a.page, a.slot, a.line, CASE WHEN greatest(length(a.mk), length(b.mk)) > 0 THEN
  len(list_filter(range(1, least(length(a.mk), length(b.mk)) + 1), lambda i: a.mk[i] = b.mk[i]))::DOUBLE / greatest(length(a.mk), length(b.mk)) END AS s
  FROM m a JOIN l USING (doc) JOIN m b ON a.doc = b.doc AND a.slot = b.slot AND b.page >= greatest(a.page - 8, 1) AND b.page < least(a.page + 8, last + 1))
SELECT doc, page, slot, line, round(sc, 6) AS score, sc > {least} AS is_edge FROM (SELECT doc, page, slot, line, {score} AS sc FROM pr GROUP BY 1, 2, 3, 4)"""


@_query(_EDGE.format(cut="ls[1:5]", least=0.3, score="CASE WHEN max(CAST(s IS NULL AS INT)) = 1 THEN [1.0, 0.75, 0.5, 0.5, 0.5][slot + 1]::DOUBLE ELSE avg(s) * [1.0, 0.75, 0.5, 0.5, 0.5][slot + 1]::DOUBLE END"))
def q35_header_scores(spark, d):
    return layout.edge_scores(_pages(spark, d))


@_query(_EDGE.format(cut="list_resize(list_reverse(ls), 5, '')", least=0.5, score="CASE WHEN max(CAST(s IS NULL AS INT)) = 1 THEN [0.5, 0.5, 0.5, 0.75, 1.0][slot + 1]::DOUBLE ELSE avg(s) END").replace("list_resize(list_resize(list_reverse(ls), 5, ''), 5, '')", "list_reverse(list_resize(list_reverse(ls), 5, ''))"))
def q35b_footer_scores(spark, d):
    return layout.edge_scores(_pages(spark, d), top=False)


@_query("""WITH p AS (SELECT l_orderkey % 50 AS page, row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS point, CAST(l_partkey % 100 AS DOUBLE) AS x, l_quantity AS y FROM lineitem),
r AS (SELECT s_suppkey % 50 AS page, s_suppkey AS rect, CAST(s_suppkey % 90 AS DOUBLE) AS x0, CAST(s_suppkey % 40 AS DOUBLE) AS y0 FROM supplier)
SELECT p.page, point, rect FROM p JOIN r ON p.page = r.page AND x BETWEEN x0 AND x0 + 10 AND y BETWEEN y0 AND y0 + 10""")
def q36_geometry_join(spark, d):
    w = W.partitionBy(F.col("l_orderkey") % 50).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    points = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("page"), F.row_number().over(w).alias("point"), (F.col("l_partkey") % 100).cast("double").alias("x"), F.col("l_quantity").alias("y"))
    s = _t(spark, d, "supplier")
    x0, y0 = (F.col("s_suppkey") % 90).cast("double"), (F.col("s_suppkey") % 40).cast("double")
    return layout.points_in_rects(points, s.select((F.col("s_suppkey") % 50).alias("page"), F.col("s_suppkey").alias("rect"), x0.alias("x0"), (x0 + 10).alias("x1"), y0.alias("y0"), (y0 + 10).alias("y1")))


@_query("""WITH w AS (SELECT doc_id, list_distinct(string_split(coalesce(text, ''), ' ')) AS t FROM documents), p AS (SELECT a.doc_id, a.t AS x, b.t AS y FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM p""")
def q37_jaccard(spark, d):
    # hashes of words are shuffled, not words
    w = _t(spark, d, "documents").select("doc_id", F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda x: F.xxhash64(x))).alias("t"))
    nxt = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return w.join(nxt, "doc_id").select("doc_id", F.round(T.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@_query("""WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM embeddings),
ds AS (SELECT label, vec_id, round(1 - list_cosine_similarity(e, nx), 9) AS dist FROM v WHERE nx IS NOT NULL), t AS (SELECT label, quantile_cont(dist, 0.95) AS cut FROM ds GROUP BY 1)
SELECT v.label, v.vec_id, CAST(coalesce(sum(CAST(dist > cut AS INT)) OVER (PARTITION BY v.label ORDER BY v.vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk FROM v LEFT JOIN ds USING (label, vec_id) LEFT JOIN t ON t.label = v.label""")
def q38_semantic_breaks(spark, d):
    order = W.partitionBy("label").orderBy("vec_id")
    v = _t(spark, d, "embeddings").withColumn("next", F.lead("embedding").over(order)).withColumn("dist", F.round(1 - T.cosine(F.col("embedding"), F.col("next")), 9))
    cut = v.groupBy("label").agg(F.percentile("dist", 0.95).alias("cut"))
    far = F.sum((F.col("dist") > F.col("cut")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1))
    return v.join(cut, "label").select("label", "vec_id", F.coalesce(far, F.lit(0)).alias("chunk"))


@_query("""SELECT doc_id, bare = '' OR contains('the of to', bare) OR contains(bare, 'the of') AS mark FROM (SELECT doc_id, regexp_replace(text, '[0-9​\n]', '', 'g') AS bare FROM documents)""")
def q39_watermark_filter(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.is_watermark(F.col("text"), "the 12of", "the 3of to").alias("mark"))


@_query("""WITH w AS (SELECT n_regionkey, greatest(6, max(length(n_name))) AS w, max(length(CAST(n_nationkey AS VARCHAR))) AS k FROM nation GROUP BY 1),
r AS (SELECT n_regionkey, string_agg('| ' || lpad(CAST(n_nationkey AS VARCHAR), 5, ' ') || ' | ' || rpad(n_name, CAST(w AS INT), ' ') || ' |', chr(10) ORDER BY n_nationkey) AS body FROM nation JOIN w USING (n_regionkey) GROUP BY 1)
SELECT n_regionkey, '|   key | ' || rpad('name', CAST(w AS INT), ' ') || ' |' || chr(10) || '|------:|:' || repeat('-', w + 1) || '|' || chr(10) || body || chr(10) || chr(10) AS markdown FROM r JOIN w USING (n_regionkey)""")
def q40_html_table_to_md(spark, d):
    n = _t(spark, d, "nation")
    rows = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: F.concat(F.lit("<tr><td>"), x["n_nationkey"].cast("string"), F.lit("</td><td>"), x["n_name"], F.lit("</td></tr>"))), "")
    return rows.select("n_regionkey", tables.html_tables(F.concat(F.lit("<table><tr><th>key</th><th>name</th></tr>"), body, F.lit("</table>"))).alias("markdown"))


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q41_csv_round_trip(spark, d):
    n, path = _t(spark, d, "nation"), f"{shared_dir(spark)}/backup-{uuid.uuid4().hex}"
    files.backup_csv(n, path)
    return files.restore_csv(spark, path, n.schema)


@_query("""SELECT 'r' || r_regionkey AS id, 'r' || r_regionkey AS root, 0 AS depth, 'r' || r_regionkey AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, 'r' || n_regionkey || '/n' || n_nationkey FROM nation
UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2, 'r' || n_regionkey || '/n' || n_nationkey || '/s' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def q42_linked_tree(spark, d):
    c = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    links = _t(spark, d, "nation").select(c("r", "n_regionkey").alias("parent"), c("n", "n_nationkey").alias("child")).union(_t(spark, d, "supplier").select(c("n", "s_nationkey"), c("s", "s_suppkey")))
    return structure.linked_tree(links, _t(spark, d, "region").select(c("r", "r_regionkey").alias("id")))


@_query(_RENDER.format(head="# Order ", h1="regexp_matches(line, '^#\\s+.+')").replace("SELECT doc, seg, text, node_type, h1, h2, '/'", ", fin AS (SELECT doc, seg, text, node_type, h1, h2, '/'") + """),
lk AS (SELECT *, regexp_replace(md5(doc || '|' || seg), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS id, max(CASE WHEN node_type = 'section' THEN seg END) OVER k AS last_s, max(CASE WHEN node_type = 'list_item' THEN seg END) OVER k AS last_i FROM fin WINDOW k AS (PARTITION BY doc, header_path)),
pa AS (SELECT *, last_value(CASE WHEN node_type = 'section' THEN id END IGNORE NULLS) OVER (PARTITION BY doc, header_path ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS par FROM lk)
SELECT id AS node_id, 'paragraph' AS node_level, CASE WHEN node_type = 'list_item' THEN par END AS parent_article, 64 AS n_dimensions FROM pa WHERE node_type = 'list_item' OR (seg = last_s AND (last_i IS NULL OR last_i < last_s))""")
def q43_embed_leaf_pipeline(spark, d):
    stored = spark.createDataFrame([], "ref string, hash string")
    _, vectors = ingest.ingest(_rendered(spark, d), stored, model("hashing"))
    return vectors.select("node_id", "node_level", "parent_article", F.size("embedding").alias("n_dimensions"))


@_query("""SELECT conv_id, string_agg(array_to_string(list_filter(string_split_regex('Source ' || n || ':' || chr(10) || coalesce(text, ''), '[ \\n\\t\\r\\x0b\\x0c]+'), lambda x: x <> '')[1:12], ' '), chr(10) || '---------------------' || chr(10) ORDER BY turn) AS answer
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1""")
def q44_accumulate_stub(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), "text")
    return answer.synthesize(rows, _first_words, "conv_id").select("conv_id", "answer")


def _first_words(prompt: str) -> str:
    return " ".join(prompt.split()[:12])


@_query("SELECT p_partkey, round(((p_partkey * 7919) % 16777216 // 65536) / 255.0, 6) AS r, round(((p_partkey * 7919) % 16777216 // 256 % 256) / 255.0, 6) AS g, round(((p_partkey * 7919) % 256) / 255.0, 6) AS b FROM part")
def q45_rgb_from_int(spark, d):
    r, g, b = T.rgb((F.col("p_partkey") * 7919 % 16777216).cast("int"))
    return _t(spark, d, "part").select("p_partkey", F.round(r, 6).alias("r"), F.round(g, 6).alias("g"), F.round(b, 6).alias("b"))


from . import documents_catalogue  # noqa: E402, F401  its queries are added on import
