"""Queries of search, ranking and top-k over the hits, vectors and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import in_wiki, prefers_text_search
from tidemark.operators import retrieval as R
from tidemark.session import ensure_checkpoint_dir, read_table

QUERIES, SQL = {}, {}
C = F.col
#: The query batch of text searches: the first line with a word of every document whose id is divisible by 50, with the
#: vector of the same id.
FIRST_LINE = r"[^\n\r]*[A-Za-z0-9_][^\n\r]*"
_QTAB = f"(SELECT doc_id qid, regexp_extract(coalesce(text, ''), '{FIRST_LINE}', 0) qtext FROM documents WHERE doc_id % 50 = 0)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def texts(spark, sf):
    d = read_table(spark, sf, "documents").filter("doc_id % 50 = 0")
    return d.select(C("doc_id").alias("qid"), F.regexp_extract(F.coalesce("text", F.lit("")), FIRST_LINE, 0).alias("qtext"))


_DIST = "list_sum(list_transform(list_zip({0}::DOUBLE[], {1}::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_KNN = f"""SELECT q, vec_id, round(d, 6) distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, vec_id)::int rank FROM (
 SELECT a.vec_id q, b.vec_id, {_DIST.format('a.embedding', 'b.embedding')} d FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 10"""


@query("rnk01_exact_knn", f"SELECT q query_id, vec_id, distance, rank FROM ({_KNN})")
def rnk01(spark, sf):
    e = read_table(spark, sf, "embeddings")
    found = R.exact_neighbours(e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, 10, "query_id", "vec_id", "embedding")
    return found.withColumn("distance", F.round("distance", 6))


_BM = f"""q AS (SELECT * FROM {_QTAB}), qt AS (SELECT DISTINCT qid, unnest(list_transform(regexp_extract_all(qtext, '([A-Za-z0-9_]+)', 1), lambda w: lower(w))) term FROM q),
dt AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '([A-Za-z0-9_]+)', 1), lambda w: lower(w)) t FROM documents), st AS (SELECT count(*) n, avg(len(t)) mean FROM dt),
tf AS (SELECT term, doc_id, l, count(*) tf FROM (SELECT doc_id, len(t) l, unnest(t) term FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) df FROM tf GROUP BY term),
bs AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 9) score FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::int rank FROM bs QUALIFY rank <= 10)"""


@query("rnk02_bm25", f"WITH {_BM} SELECT qid, doc_id, round(score, 6) score, rank FROM bm")
def rnk02(spark, sf):
    return R.bm25(texts(spark, sf), read_table(spark, sf, "documents"), 10, "qid", "qtext", "doc_id", "text").withColumn("score", F.round("score", 6))


@query("rnk02_text_index", f"WITH {_BM} SELECT qid, doc_id, round(score, 6) score, rank FROM bm")
def rnk02_index(spark, sf):
    """The same from a stored index that was built of the English documents with other texts first, and then updated."""
    from tidemark.operators.textindex import TextIndex

    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    index = TextIndex(spark, f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}", 16)
    index.update(d.filter("lang = 'en'").withColumn("text", F.reverse("text")), "doc_id", "text")
    index.update(d, "doc_id", "text", whole=True)
    return index.search(texts(spark, sf), 10, "qid", "qtext").withColumn("score", F.round("score", 6))


def _lists(spark, sf):
    words = R.bm25(texts(spark, sf), read_table(spark, sf, "documents"), 10, "qid", "qtext", "doc_id", "text").select("qid", C("doc_id").alias("item"), "rank")
    e = read_table(spark, sf, "embeddings")
    near = R.exact_neighbours(e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid"), e, 10, "qid", "vec_id", "embedding").select("qid", C("vec_id").alias("item"), "rank")
    return words, near


_NEAR = f"""nv AS (SELECT a.vec_id qid, b.vec_id item, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST.format('a.embedding', 'b.embedding')}, b.vec_id)::int rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10)"""
_FUSED = f"""WITH {_BM}, {_NEAR}, u AS (SELECT qid, doc_id item, rank FROM bm UNION ALL SELECT * FROM nv),
hy AS (SELECT qid, item, round(sum(1.0::double / (60 + rank)), 12) rrf FROM u GROUP BY ALL), hp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, item)::int place FROM hy QUALIFY place <= 10)"""


@query("rnk03_hybrid", _FUSED + " SELECT qid, item, round(rrf, 9) rrf, place FROM hp")
def rnk03(spark, sf):
    words, near = _lists(spark, sf)
    return R.reciprocal_rank_fusion(words.unionByName(near), ["qid"], ["item"], "rank", 10).withColumn("rrf", F.round("rrf", 9))


_SHORT = "length(trim(qtext)) BETWEEN 1 AND 48 AND len(regexp_split_to_array(trim(qtext), '\\s+')) <= 3 AND regexp_full_match(trim(qtext), '[\\p{L}\\p{N}\\-_./:#@\\s]+')"


@query("rnk04_routed_search", _FUSED + f""", r AS (SELECT qid, {_SHORT} AND qid IN (SELECT qid FROM bm) fts FROM q)
SELECT qid, 'fts_prefer' retrieval_mode, doc_id item, rank place FROM bm JOIN r USING (qid) WHERE fts UNION ALL SELECT qid, 'hybrid', item, place FROM hp JOIN r USING (qid) WHERE NOT fts""")
def rnk04(spark, sf):
    """Keyword-like queries with text hits take these alone; all others the fused list."""
    words, near = _lists(spark, sf)
    route = texts(spark, sf).join(words.select("qid").distinct().withColumn("hit", F.lit(True)), "qid", "left").select("qid", (prefers_text_search(C("qtext")) & C("hit").isNotNull()).alias("fts"))
    fused = R.reciprocal_rank_fusion(words.unionByName(near), ["qid"], ["item"], "rank", 10)
    first = words.join(route.filter("fts"), "qid").select("qid", F.lit("fts_prefer").alias("retrieval_mode"), "item", C("rank").alias("place"))
    return first.unionByName(fused.join(route.filter("not fts"), "qid").select("qid", F.lit("hybrid").alias("retrieval_mode"), "item", "place"))


def hits(spark, sf):
    """Distinct hits with their identity."""
    h = read_table(spark, sf, "search_hits").dropDuplicates(["hit_id"])
    return h.withColumn("identity", R.hit_identity(C("project"), C("source"), C("path"), C("heading"), C("qualified_symbol"), C("segment_index")))


_HITS = """h AS (SELECT *, concat_ws('|', coalesce(project, ''), coalesce(source, ''), coalesce(path, ''), coalesce(heading, ''), coalesce(qualified_symbol, ''), coalesce(segment_index::varchar, '')) idn
 FROM (SELECT *, row_number() OVER (PARTITION BY hit_id) rn FROM search_hits) WHERE rn = 1)"""


@query("rnk05_score_norm", f"WITH {_HITS} SELECT hit_id, round(1 / (1 + greatest(score::double, 0)), 6) distance FROM h WHERE score IS NOT NULL")
def rnk05(spark, sf):
    return hits(spark, sf).filter("score is not null").select("hit_id", F.round(R.similarity_of(C("score").cast("double")), 6).alias("distance"))


def _corpus_ranks(spark, sf, keys):
    place = F.row_number().over(Window.partitionBy("query_id", *keys).orderBy("score", "hit_id"))
    return hits(spark, sf).filter("score is not null").withColumn("rank", place)


_RANKS = _HITS + ", cr AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score, hit_id) rank FROM h WHERE score IS NOT NULL)"


@query("rnk06_rrf", f"WITH {_RANKS}, t AS (SELECT query_id, hit_id, round(1.0::double / (60 + rank), 12) rrf FROM cr) SELECT query_id, hit_id, round(rrf, 9) rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, hit_id)::int place FROM t QUALIFY place <= 10")
def rnk06(spark, sf):
    return R.reciprocal_rank_fusion(_corpus_ranks(spark, sf, ["source"]), ["query_id"], ["hit_id"], "rank", 10).withColumn("rrf", F.round("rrf", 9))


@query("rnk07_relevance", f"WITH {_HITS} SELECT hit_id, round(CASE WHEN rrf_score IS NOT NULL THEN least(rrf_score::double * 61, 1) WHEN score IS NOT NULL THEN 1 / (1 + greatest(score::double, 0)) END, 6) relevance FROM h")
def rnk07(spark, sf):
    return hits(spark, sf).select("hit_id", F.round(R.relevance(C("rrf_score").cast("double"), C("score").cast("double")), 6).alias("relevance"))


@query("rnk08_corpus_all", f"WITH {_RANKS} SELECT query_id, source, hit_id, rank::int rank FROM cr WHERE rank <= 10")
def rnk08(spark, sf):
    """Both corpora, each with its own list, before they are fused."""
    return _corpus_ranks(spark, sf, ["source"]).filter("rank <= 10").select("query_id", "source", "hit_id", C("rank").cast("int").alias("rank"))


@query("rnk09_federation", f"""WITH {_HITS}, pr AS (SELECT *, row_number() OVER (PARTITION BY query_id, project ORDER BY score, hit_id) rank FROM h WHERE score IS NOT NULL AND project IS NOT NULL),
t AS (SELECT query_id, project, hit_id, round(1.0::double / (60 + rank), 12) rrf FROM pr WHERE rank <= 5) SELECT query_id, project, hit_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, project, hit_id)::int place FROM t QUALIFY place <= 10""")
def rnk09(spark, sf):
    """Each project's five best, fused across projects."""
    each = _corpus_ranks(spark, sf, ["project"]).filter("project is not null and rank <= 5")
    return R.reciprocal_rank_fusion(each, ["query_id"], ["project", "hit_id"], "rank", 10).select("query_id", "project", "hit_id", "place")


BUDGET, LEAST, MOST_HITS = 400, 0.45, 100
_PACK = f"""WITH RECURSIVE {_HITS}, o AS (SELECT query_id, hit_id, content, coalesce(pinned, false) pin, coalesce(score::double, 'inf') score, row_number() OVER (PARTITION BY query_id ORDER BY (NOT coalesce(pinned, false)), coalesce(score::double, 'inf'), hit_id) i FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score NULLS LAST, hit_id) <= 100)),
f AS (SELECT query_id, 0::bigint i, 0::bigint total, false stopped, NULL::bigint hit_id, NULL::varchar kept FROM (SELECT DISTINCT query_id FROM o) UNION ALL
 SELECT query_id, i, CASE WHEN stop THEN total ELSE total + coalesce(length(txt), 0) END, stop, CASE WHEN stop THEN NULL ELSE hit_id END, txt FROM (
 SELECT *, CASE WHEN content IS NULL THEN NULL WHEN NOT over_ THEN content WHEN room >= 80 THEN cut ELSE CASE WHEN sz <= 80 THEN content ELSE substr(content, 1, 62) || E'\\n... [truncated]\\n' END END txt FROM (
  SELECT *, CASE WHEN sz <= room THEN content ELSE substr(content, 1, (room - 18)::int) || E'\\n... [truncated]\\n' END cut, stopped OR (content IS NOT NULL AND NOT pin AND (total >= {BUDGET} OR (over_ AND room < 80))) stop FROM (
   SELECT o.query_id, o.i, o.hit_id, o.content, o.pin, f.total, f.stopped, length(o.content) sz, greatest({BUDGET} - f.total, 0) room, coalesce(f.total + length(o.content) > {BUDGET}, false) over_ FROM f JOIN o ON o.query_id = f.query_id AND o.i = f.i + 1)))),
packed AS (SELECT query_id, i, hit_id, kept FROM f WHERE hit_id IS NOT NULL)"""


def _packed(spark, sf, include_content=True):
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(C("score").asc_nulls_last(), "hit_id"))
    h = hits(spark, sf).withColumn("place", place).filter(C("place") <= MOST_HITS).select("query_id", F.struct("pinned", F.struct(F.coalesce(C("score").cast("double"), F.lit(float("inf"))).alias("far"), "hit_id").alias("ord"), C("hit_id").alias("id"), "content").alias("h"), "score")
    # A search gives 100 hits at most, so this is what one task holds of a query.
    return h.groupBy("query_id").agg(F.collect_list("h").alias("hits"), F.count("*").alias("n"), F.max(R.relevance(F.lit(None).cast("double"), C("score").cast("double"))).alias("best")).withColumn("kept", R.char_budget(C("hits"), BUDGET, include_content))


@query("rnk11_char_budget", _PACK + " SELECT query_id, hit_id, kept content, (row_number() OVER (PARTITION BY query_id ORDER BY i) - 1)::int pos FROM packed")
def rnk11(spark, sf):
    return _packed(spark, sf).select("query_id", F.posexplode("kept").alias("pos", "k")).select("query_id", C("k.id").alias("hit_id"), C("k.content").alias("content"), "pos")


@query("flt14_without_content", _PACK + " SELECT query_id, hit_id, NULL::varchar content, (i - 1)::int pos FROM o")
def flt14(spark, sf):
    """Hits asked for without contents: all of them in order, and no budget."""
    return _packed(spark, sf, False).select("query_id", F.posexplode("kept").alias("pos", "k")).select("query_id", C("k.id").alias("hit_id"), C("k.content").alias("content"), "pos")


@query("rnk10_bounded_recall", _PACK + f""", s AS (SELECT query_id, count(*) n, max(CASE WHEN score < 'inf' THEN 1 / (1 + greatest(score, 0)) END) best FROM o GROUP BY query_id), p AS (SELECT query_id, count(*) kept FROM packed GROUP BY query_id)
SELECT query_id, CASE WHEN reason = 'hits_above_threshold' THEN 'inject' ELSE 'abstain' END decision, reason, round(best, 6) max_relevance FROM (SELECT *, CASE WHEN n = 0 THEN 'no_hits' WHEN best < {LEAST} THEN 'best_relevance_below_min_score' WHEN coalesce(kept, 0) = 0 THEN 'char_budget_exhausted' ELSE 'hits_above_threshold' END reason FROM s LEFT JOIN p USING (query_id))""")
def rnk10(spark, sf):
    decision, reason = R.recall_decision(C("n"), C("best"), F.size("kept"), LEAST)
    return _packed(spark, sf).select("query_id", decision.alias("decision"), reason.alias("reason"), F.round("best", 6).alias("max_relevance"))


@query("rnk12_truncate", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 482) || E'\\n... [truncated]\\n' END content FROM documents")
def rnk12(spark, sf):
    from tidemark.functions.text import cut_text

    return read_table(spark, sf, "documents").select("doc_id", cut_text(C("text"), F.lit(500)).alias("content"))


@query("rnk13_argument_bounds", "SELECT DISTINCT query_id, least(coalesce(nullif(query_id % 200, 0), 10), 100) AS \"limit\" FROM search_hits")
def rnk13(spark, sf):
    """Asked limits, 10 by default and 100 at most."""
    asked = F.when(C("query_id") % 200 != 0, C("query_id") % 200)
    return read_table(spark, sf, "search_hits").select("query_id", F.least(F.coalesce(asked, F.lit(10)), F.lit(100)).alias("limit")).distinct()


@query("rnk14_read_document", "SELECT file_path, string_agg(content, chr(10) || chr(10) ORDER BY start_line, segment_index, id) content FROM (SELECT DISTINCT id, file_path, start_line, segment_index, content FROM code_chunks) GROUP BY file_path")
def rnk14(spark, sf):
    """A file's segments in order; a file is bounded by the size gate of the scan."""
    c = read_table(spark, sf, "code_chunks").select("id", "file_path", "start_line", "segment_index", "content").distinct()
    parts = F.array_sort(F.collect_list(F.struct("start_line", "segment_index", "id", "content")))
    return c.groupBy("file_path").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("content"))


@query("rnk15_confidence", f"WITH {_HITS} SELECT hit_id, round(CASE WHEN score IS NOT NULL THEN 1 / (1 + greatest(score::double, 0)) END, 6) confidence FROM h")
def rnk15(spark, sf):
    return hits(spark, sf).select("hit_id", F.round(R.confidence_of(C("score")), 6).alias("confidence"))


@query("flt04_late_wiki_filter", f"WITH {_HITS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, hit_id) rank FROM h WHERE score IS NOT NULL) SELECT query_id, hit_id FROM t WHERE rank <= 10 AND lower(split_part(regexp_replace(path, '^[^/]*/', ''), '/', 1)) <> 'archive'")
def flt04(spark, sf):
    """A namespace filter after the limit: fewer hits than asked for may stay (here the namespace ``archive``)."""
    top = _corpus_ranks(spark, sf, []).filter("rank <= 10")
    return top.filter(F.lower(F.split(F.regexp_replace("path", "^[^/]*/", ""), "/")[0]) != "archive").select("query_id", "hit_id")


@query("flt07_abstain_gate", f"WITH {_HITS} SELECT query_id, hit_id FROM (SELECT *, max(CASE WHEN score IS NOT NULL THEN 1 / (1 + greatest(score::double, 0)) END) OVER (PARTITION BY query_id) best FROM h) WHERE best >= {LEAST}")
def flt07(spark, sf):
    """All hits of a query whose best relevance reaches the bar; the best comes by an aggregate and a join, so a hot
    query is no hot task."""
    h = hits(spark, sf)
    best = h.groupBy("query_id").agg(F.max(R.relevance(F.lit(None).cast("double"), C("score").cast("double"))).alias("best")).filter(C("best") >= LEAST)
    return h.join(best.select("query_id"), "query_id", "left_semi").select("query_id", "hit_id")


@query("agg07_best_relevance", f"WITH {_HITS} SELECT query_id, round(max(CASE WHEN score IS NOT NULL THEN 1 / (1 + greatest(score::double, 0)) END), 6) best FROM h GROUP BY query_id")
def agg07(spark, sf):
    return hits(spark, sf).groupBy("query_id").agg(F.round(F.max(R.relevance(F.lit(None).cast("double"), C("score").cast("double"))), 6).alias("best"))


@query("agg16_project_order", "SELECT query_id, array_to_string(list(project ORDER BY first_hit), ',') projects FROM (SELECT query_id, project, min(hit_id) first_hit FROM search_hits WHERE project IS NOT NULL GROUP BY ALL) GROUP BY query_id")
def agg16(spark, sf):
    """Projects of a query in order of first appearance, each once (a query asks for 8 at most)."""
    each = read_table(spark, sf, "search_hits").filter("project is not null").groupBy("query_id", "project").agg(F.min("hit_id").alias("first"))
    return each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "project"))), lambda x: x["project"]), ",").alias("projects"))


@query("set01_list_union", "SELECT query_id, source, hit_id FROM search_hits WHERE source = 'vault' UNION ALL SELECT query_id, source, hit_id FROM search_hits WHERE source = 'code'")
def set01(spark, sf):
    h = read_table(spark, sf, "search_hits").select("query_id", "source", "hit_id")
    return h.filter("source = 'vault'").unionByName(h.filter("source = 'code'"))


@query("top01_nearest_limit", f"WITH {_HITS} SELECT hit_id, round(score::double, 6) score FROM h WHERE score IS NOT NULL ORDER BY score, hit_id LIMIT 20")
def top01(spark, sf):
    return hits(spark, sf).filter("score is not null").orderBy("score", "hit_id").limit(20).select("hit_id", F.round(C("score").cast("double"), 6).alias("score"))


@query("top06_candidates", f"WITH {_HITS} SELECT query_id, hit_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, path, hit_id)::int rank FROM h WHERE confidence IS NOT NULL) WHERE rank <= 5")
def top06(spark, sf):
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(C("confidence").desc(), "path", "hit_id"))
    return hits(spark, sf).filter("confidence is not null").withColumn("rank", place).filter("rank <= 5").select("query_id", "hit_id", "rank")


@query("top10_score_sort", f"WITH {_HITS} SELECT hit_id, (row_number() OVER (ORDER BY confidence DESC, hit_id))::int place FROM h WHERE confidence IS NOT NULL QUALIFY place <= 50")
def top10(spark, sf):
    best = hits(spark, sf).filter("confidence is not null").orderBy(C("confidence").desc(), "hit_id").limit(50)
    return best.withColumn("place", F.row_number().over(Window.orderBy(C("confidence").desc(), "hit_id"))).select("hit_id", "place")


@query("top02_fused_order", f"WITH {_RANKS}, t AS (SELECT query_id, hit_id, round(1.0::double / (60 + rank), 12) rrf FROM cr) SELECT query_id, hit_id, (row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, hit_id))::int place FROM t QUALIFY place <= 5")
def top02(spark, sf):
    return R.reciprocal_rank_fusion(_corpus_ranks(spark, sf, ["source"]), ["query_id"], ["hit_id"], "rank", 5).select("query_id", "hit_id", "place")


_TOOL = _FUSED.replace("a.vec_id % 50 = 0", "a.vec_id % 50 = 0 AND a.vec_id IN (SELECT qid FROM q) AND b.vec_id IN (SELECT doc_id FROM documents)")


@query("rnk16_retrieval", _TOOL + f""", r AS (SELECT qid, {_SHORT} AND qid IN (SELECT qid FROM bm) fts FROM q)
SELECT qid query_id, doc_id chunk_id, rank place, 'fts_prefer' AS mode FROM bm JOIN r USING (qid) WHERE fts UNION ALL SELECT qid, item, place, 'hybrid' FROM hp JOIN r USING (qid) WHERE NOT fts""")
def rnk16(spark, sf):
    """The search tool over all documents; those without a vector are found by their words only."""
    from tidemark import api

    e = read_table(spark, sf, "embeddings").select(C("vec_id").alias("chunk_id"), C("embedding").alias("vector"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("status", "string"), ("pinned", "boolean"), ("valid_from", "string"), ("valid_until", "string"), ("confidence", "double"))]
    notes = read_table(spark, sf, "documents").select(C("doc_id").alias("chunk_id"), "text").join(e, "chunk_id", "left").select("*", *none)
    asked = texts(spark, sf).select(C("qid").alias("query_id"), C("qtext").alias("text")).join(e.withColumnRenamed("chunk_id", "query_id"), "query_id", "left")
    return api.search(notes, asked, "2025-01-01T00:00:00Z", 10)


_SEGMENT = "(SELECT id, max(vector) v FROM code_chunks GROUP BY id)"


@query("rnk16_code_search", f"""SELECT query_id, segment_id, round(d, 6) distance, rank FROM (SELECT a.id query_id, b.id segment_id, {_DIST.format('a.v', 'b.v')} d,
 row_number() OVER (PARTITION BY a.id ORDER BY {_DIST.format('a.v', 'b.v')}, b.id)::int rank FROM {_SEGMENT} a, {_SEGMENT} b WHERE ('0x' || substr(a.id, 1, 8))::bigint % 50 = 0) WHERE rank <= 10""")
def rnk16_code(spark, sf):
    """The code search tool: segments nearest to every segment whose id, a hash in hexadecimal, is divisible by 50."""
    from tidemark import api

    s = read_table(spark, sf, "code_chunks").groupBy(C("id").alias("segment_id")).agg(F.max("vector").alias("vector"))
    asked = s.filter(F.conv(F.substring("segment_id", 1, 8), 16, 10).cast("long") % 50 == 0).withColumnRenamed("segment_id", "query_id")
    return api.code_search(s, asked, 10).withColumn("distance", F.round("distance", 6))
