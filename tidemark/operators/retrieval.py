"""Retrieval over batches of queries: exact nearest neighbours, BM25, fusion, relevance, gates and budgets.

A query is a row, so one plan serves a batch. Ranked lists are long-form rows ``query, rank, ...``; top-k reports use
ranking windows, which Spark limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import cut_text
from tidemark.session import cut_lineage, spread, write_shared

RRF_K = 60
#: Queries that one pass holds in memory per task (10,000 vectors of 384 doubles are 31 MB); more go in several passes.
QUERY_BLOCK = 10_000
#: Terms of the queries that one pass holds in memory per task, repeated ones too.
TERM_BLOCK = 200_000
#: Queries a task scores at once; its largest temporary has so many rows of the base's batch.
STEP = 256


def _passes(rows: DataFrame, key: str, weight: Column, most: int):
    """The rows in blocks of about ``most`` by weight, each as Arrow. What needs several blocks is written once, a folder
    per block, so a pass reads its own rows only."""
    total = rows.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    if total == 0:
        return
    if total <= most:
        yield rows.toArrow()
        return
    # A block may hold a quarter more than the mean; several times that is no concern.
    count = -(-total // most) + 1
    stored = write_shared(rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(17), key), F.lit(count))), "_block")
    for i in range(count):
        got = stored.filter(F.col("_block") == i).drop("_block").toArrow()
        if got.num_rows:
            yield got


def exact_neighbours(queries: DataFrame, base: DataFrame, k: int, query_id: str, base_id: str, vector: str) -> DataFrame:
    """``query_id, base_id, distance, rank``: the k rows of ``base`` nearest to each query by squared distance, ties by
    id. Ids keep their types (numbers or text). The base is read once per block of queries and never moved: each task
    keeps the k best of its own rows, and only those are shuffled. Null ids and vectors, and vectors of another length than
    most queries of the block, have no neighbours."""
    spark = base.sparkSession
    rows = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v")).filter("q is not null and v is not null")
    found = None
    for got in _passes(rows, "q", F.lit(1), QUERY_BLOCK):
        part = _block_neighbours(spark, got, rows.schema["q"].dataType, base, k, base_id, vector)
        found = part if found is None else found.unionByName(part)
    kinds = f"{query_id} {rows.schema['q'].dataType.simpleString()}, {base_id} {base.schema[base_id].dataType.simpleString()}"
    if found is None:
        return spark.createDataFrame([], f"{kinds}, distance double, rank int")
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "b"))
    best = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_id), F.col("b").alias(base_id), "distance", "rank")


def _ranks(ids):
    """Numbers in the order of the ids, for sorting by several keys."""
    import numpy as np

    return np.unique(ids, return_inverse=True)[1].reshape(ids.shape) if ids.dtype == object else ids


def _keep_best(best, at: slice, score, ids, k: int) -> None:
    """Merge candidates (rows x any number; smaller scores are better, infinite ones are none) into the k best so far."""
    import numpy as np

    scores, names = best
    changed = np.flatnonzero(score.min(axis=1) <= scores[at, -1])
    if not len(changed):
        return
    rows = np.arange(at.start, at.stop)[changed]
    all_scores, all_ids = np.concatenate([scores[rows], score[changed]], 1), np.concatenate([names[rows], ids[changed]], 1)
    order = np.lexsort((_ranks(all_ids), all_scores), axis=1)[:, :k]
    scores[rows], names[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)


def _best_batch(ids, best, sign: float, q_type, b_type):
    """What a task found: query, id and score of its best rows."""
    import numpy as np
    import pyarrow as pa

    row, col = np.nonzero(np.isfinite(best[0]))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)).cast(q_type), pa.array(best[1][row, col], b_type), pa.array(sign * best[0][row, col])], ["q", "b", "score"])


def _block_neighbours(spark, got, q_kind, base: DataFrame, k: int, base_id: str, vector: str) -> DataFrame:
    import numpy as np

    vecs = got["v"].combine_chunks()
    sizes = vecs.value_lengths().to_numpy()
    dim = int(np.bincount(sizes).argmax())
    keep = np.flatnonzero(sizes == dim)
    matrix = vecs.take(keep).flatten().to_numpy(zero_copy_only=False).reshape(len(keep), dim)
    shared = spark.sparkContext.broadcast((got["q"].combine_chunks().take(keep), matrix))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, m = shared.value
        mm, best = (m * m).sum(1), None
        for batch in batches:
            good = np.flatnonzero(batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
            if not len(good):
                continue
            x = np.asarray(batch.column(1).take(pa.array(good)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(good), dim)
            b = batch.column(0).take(pa.array(good)).to_numpy(zero_copy_only=False)
            order = np.argsort(b, kind="stable")
            x, b = x[order], b[order]
            if best is None:
                best, b_type = (np.full((len(m), k), np.inf), np.full((len(m), k), b[0], b.dtype)), batch.column(0).type
            xx, t = (x * x).sum(1), min(k + 8, len(x))
            for start in range(0, len(m), STEP):
                at = slice(start, min(start + STEP, len(m)))
                far = np.maximum(mm[at, None] + xx[None] - 2 * (m[at] @ x.T), 0)
                near = np.argpartition(far, t - 1, axis=1)[:, :t]
                if t < len(x):
                    # More rows than these may be as near as the k-th one: then ids decide, on exact distances.
                    edge = np.partition(np.take_along_axis(far, near, 1), k - 1, axis=1)[:, k - 1]
                    close = far <= (edge + 1e-9 * (mm[at] + xx.max()))[:, None]
                    for i in np.flatnonzero(close.sum(1) > t):
                        there = np.flatnonzero(close[i])
                        near[i] = there[np.lexsort((there, ((m[start + i] - x[there]) ** 2).sum(1)))[:t]]
                exact = ((m[at, None, :] - x[near]) ** 2).sum(2)
                _keep_best(best, at, exact, b[near], k)
        if best is not None:
            yield _best_batch(ids, best, 1.0, ids.type, b_type)

    b_kind = base.schema[base_id].dataType
    rows = base.select(F.col(base_id), F.col(vector).cast("array<double>")).filter(F.col(base_id).isNotNull())
    return rows.mapInArrow(run, f"q {q_kind.simpleString()}, b {b_kind.simpleString()}, score double").withColumnRenamed("score", "distance")


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)"), 1), lambda w: F.lower(w))


def bm25(queries: DataFrame, docs: DataFrame, k: int, query_id: str, query_text: str, doc_id: str, doc_text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, doc_id, score, rank``: the k best documents of each query by BM25, ties by id. Null and empty texts are
    documents without terms; null ids are left out; repeated rows of a document are documents each.

    One pass counts in how many documents each term of the queries is (combined before the shuffle), the next scores
    documents where they lie, in blocks of queries: a word that half of all queries and documents have adds numbers in a
    task's block and never pairs to a shuffle. Each task keeps the k best of its own documents."""
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).alias("q"), F.array_sort(F.array_distinct(terms(F.coalesce(F.col(query_text), F.lit(""))))).alias("terms")).filter("q is not null and size(terms) > 0")
    texts = spread(docs.select(F.col(doc_id).alias("d"), F.coalesce(F.col(doc_text), F.lit("")).alias("text")).filter("d is not null"))
    kinds = f"q {asked.schema['q'].dataType.simpleString()}, b {docs.schema[doc_id].dataType.simpleString()}, score double"
    # A document's row with the empty term carries its length, so that one pass over the texts gives all counts.
    split = texts.select(terms(F.col("text")).alias("all"))
    marked = split.select(F.size("all").alias("len"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("all"))).alias("term"))
    wanted = asked.select(F.explode("terms").alias("term")).distinct().unionByName(spark.createDataFrame([("",)], "term string"))
    counts = cut_lineage(marked.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("len").alias("words")))
    whole = counts.filter("term = ''").first()
    found = None
    if whole is not None and whole["df"] and whole["words"]:
        n, mean = whole["df"], whole["words"] / whole["df"]
        weighed = _weighed(asked, counts)
        for got in _passes(weighed, "q", F.size("terms"), TERM_BLOCK):
            part = texts.mapInArrow(_scorer(spark, got, k, n, mean, k1, b), kinds)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], kinds)
    return _ranked(found, k, query_id, doc_id)


def _weighed(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """``asked(q, terms)`` with the number of documents of each term, null where no document has it."""
    exploded = asked.select("q", F.posexplode("terms").alias("at", "term")).join(counts.select("term", "df"), "term", "left")
    return exploded.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term", "df"))), lambda x: F.struct(x["term"].alias("term"), x["df"].alias("df"))).alias("terms"))


def _ranked(found: DataFrame, k: int, query_id: str, doc_id: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "b"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("b").alias(doc_id), "score", "rank")


def _weights(got, n: int) -> tuple[list, dict]:
    """Of a block of queries (q, terms (term, df)) the numbers and weights of each one's terms, and the numbers by term."""
    import numpy as np

    vocabulary: dict = {}
    lists = got["terms"].to_pylist()
    return [[(vocabulary.setdefault(t["term"], len(vocabulary)), np.log(1 + (n - t["df"] + 0.5) / (t["df"] + 0.5))) for t in terms_ if t["df"]] for terms_ in lists], vocabulary


def _score(asked: list, postings: dict, names, best, k: int) -> None:
    """Merge documents into the k best of each query. ``postings``: by number of a term the places of its documents in
    ``names`` and their weights, or None and the weights of all ``names``."""
    import numpy as np

    total = np.zeros(len(names))
    for q, pairs in enumerate(asked):
        seen = [(postings[t], idf) for t, idf in pairs if t in postings]
        if not seen:
            continue
        for (where, weight), idf in seen:
            if where is None:
                total += idf * weight
            else:
                total[where] += idf * weight
        if len(seen) == 1 and seen[0][0][0] is not None:
            touched = seen[0][0][0]
        elif any(where is None for (where, _), _ in seen) or 8 * sum(len(where) for (where, _), _ in seen) > len(names):
            touched = np.flatnonzero(total)  # weights are positive
        else:
            touched = np.unique(np.concatenate([where for (where, _), _ in seen]))
        score = total[touched].round(9)
        total[touched] = 0.0
        if len(score) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            touched, score = touched[keep], score[keep]
        _keep_best(best, slice(q, q + 1), -score[None], names[touched][None], k)


def _scorer(spark, got, k: int, n: int, mean: float, k1: float, b: float):
    """Arrow function: the k best of the partition's documents for each query of a block. ``got``: q, terms (term, df)."""
    each, vocabulary = _weights(got, n)
    shared = spark.sparkContext.broadcast((got["q"].combine_chunks(), each, vocabulary))

    def run(batches):
        import re
        from collections import Counter

        import numpy as np

        ids, asked, known = shared.value
        word = re.compile(r"[A-Za-z0-9_]+")
        best = None
        for batch in batches:
            b_type, names = batch.column(0).type, batch.column(0).to_numpy(zero_copy_only=False)
            if not len(names):
                continue
            if best is None:
                best = (np.full((len(asked), k), np.inf), np.full((len(asked), k), names[0], names.dtype))
            postings: dict = {}
            for i, text in enumerate(batch.column(1).to_pylist()):
                said = word.findall(text)
                length = k1 * (1 - b + b * len(said) / mean)
                for t, tf in Counter(map(str.lower, said)).items():
                    if (at := known.get(t)) is not None:
                        postings.setdefault(at, ([], []))
                        postings[at][0].append(i)
                        postings[at][1].append(tf * (k1 + 1) / (tf + length))
            postings = {t: (np.array(where), np.array(weight)) for t, (where, weight) in postings.items()}
            _score(asked, postings, names, best, k)
        if best is not None:
            yield _best_batch(ids, best, -1.0, ids.type, b_type)

    return run


def reciprocal_rank_fusion(lists: DataFrame, query: list[str], identity: list[str], rank: str, limit: int, k: int = RRF_K) -> DataFrame:
    """``query, identity, rrf, place`` from ranked lists in long form: the sum of 1 / (k + rank), ranks from 1, over all
    lists an identity is in; ties by identity."""
    total = lists.groupBy(*query, *identity).agg(F.round(F.sum(1.0 / (k + F.col(rank))), 12).alias("rrf"))
    place = F.row_number().over(Window.partitionBy(*query).orderBy(F.col("rrf").desc(), *identity))
    return total.withColumn("place", place).filter(F.col("place") <= limit)


def semantic_graph(asked: DataFrame, vectors: DataFrame, nodes: DataFrame, max_nodes: int = 100, neighbours: int = 5, least: float = 0.7) -> DataFrame:
    """``key_a, key_b, confidence`` of undirected links by meaning. ``asked`` and ``nodes``: node_key, path, label;
    ``vectors``: path, label, vector, one per place. Of the nodes asked that have a vector the first ``max_nodes`` by key (200
    at most) are taken, and of each the nearest ``neighbours`` (8 at most) other nodes with enough confidence. Hits that
    are no node, and the node itself, don't count; of several nodes of one place the smallest key does. Nothing is
    stored."""
    place = nodes.groupBy("path", "label").agg(F.min("node_key").alias("target"))
    base = vectors.join(place, ["path", "label"]).select("target", "vector")
    picked = asked.join(vectors, ["path", "label"]).orderBy("node_key").limit(min(max_nodes, 200)).select("node_key", "vector")
    k = min(neighbours, 8)
    near = exact_neighbours(picked, base, k + 1, "node_key", "target", "vector").filter("node_key <> target")
    hits = near.withColumn("confidence", confidence_of(F.col("distance"))).filter(F.col("confidence") >= least)
    order = Window.partitionBy("node_key").orderBy(F.col("confidence").desc(), "target")
    best = hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    pairs = best.groupBy(F.least("node_key", "target").alias("key_a"), F.greatest("node_key", "target").alias("key_b"))
    return pairs.agg(F.round(F.max("confidence"), 6).alias("confidence"))


def similarity_of(score: Column) -> Column:
    """A BM25 score as a distance."""
    return 1 / (1 + F.greatest(score, F.lit(0.0)))


def relevance(rrf: Column, distance: Column) -> Column:
    """0..1: of a fused score, else of a distance, else null."""
    return F.when(rrf.isNotNull(), F.least(rrf * (RRF_K + 1), F.lit(1.0))).when(distance.isNotNull(), 1 / (1 + F.greatest(distance, F.lit(0.0))))


def confidence_of(distance: Column) -> Column:
    d = distance.cast("double")
    finite = ~F.isnan(d) & (F.abs(d) < float("inf"))
    return F.when(finite, F.least(F.greatest(1 / (1 + F.greatest(d, F.lit(0.0))), F.lit(0.0)), F.lit(1.0)))


def char_budget(hits: Column, most: int, include_content: bool = True) -> Column:
    """Of an array of structs (pinned, ord, id, content) the packed ones in order: pinned first; the others stop at the
    first that finds the budget spent or less than 80 characters left; what doesn't fit is cut; pinned ones always stay,
    as a stub of 80 if need be; null contents cost nothing. Without contents all hits stay, and nothing is spent."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct((~F.coalesce(h["pinned"], F.lit(False))).alias("after"), h["ord"].alias("ord"), h["id"].alias("id"), h["content"].alias("content"))))
    if not include_content:
        return F.transform(ordered, lambda h: F.struct(h["id"].alias("id"), F.lit(None).cast("string").alias("content")))
    kind = "array<struct<id:bigint,content:string>>"
    state = F.struct(F.lit(0).alias("total"), F.lit(False).alias("stopped"), F.array().cast(kind).alias("kept"))

    def step(s, h):
        size, left, pinned = F.length(h["content"]), F.greatest(F.lit(most) - s["total"], F.lit(0)), ~h["after"]
        over = s["total"] + size > most
        stop = s["stopped"] | (h["content"].isNotNull() & ~pinned & ((s["total"] >= most) | (over & (left < 80))))
        text = F.when(h["content"].isNull(), F.lit(None)).when(~over, h["content"]).when(left >= 80, cut_text(h["content"], left)).otherwise(cut_text(h["content"], F.least(F.lit(80), size)))
        keep = F.concat(s["kept"], F.array(F.struct(h["id"].alias("id"), text.alias("content"))))
        return F.struct(
            F.when(stop, s["total"]).otherwise(s["total"] + F.coalesce(F.length(text), F.lit(0))).cast("int").alias("total"),
            stop.alias("stopped"), F.when(stop, s["kept"]).otherwise(keep).alias("kept"),
        )

    return F.aggregate(ordered, state, step, lambda s: s["kept"])


def recall_decision(hits: Column, best: Column, kept: Column, least: float | None) -> tuple[Column, Column]:
    """Decision and reason of one query: hits found, their best relevance, hits left after the budget."""
    weak = F.lit(False) if least is None else F.coalesce(best < least, F.lit(False))
    reason = F.when(hits == 0, "no_hits").when(weak, "best_relevance_below_min_score").when(kept == 0, "char_budget_exhausted").otherwise("hits_above_threshold")
    return F.when(reason == "hits_above_threshold", "inject").otherwise("abstain"), reason


def hit_identity(*parts: Column) -> Column:
    return F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
