"""A stored full-text index: postings and document statistics as snapshot tables.

Postings lie in segments, each of some thousand documents of one update, as one block for each term: the places of its
documents in the segment and how often each has it, packed into a byte or two a posting. Blocks lie in parts by the hash of
their term, so a search reads the parts of its terms only, and of these, by a filter that reaches the scan, their rows. It
then brings the blocks of a segment together and scores documents there, so that a frequent word which many queries ask for
adds numbers and makes no pairs. An update appends segments of new and changed documents under a new generation and upserts
the documents' own rows; places that no document's row names count for nothing until ``compact`` writes the index anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.retrieval import TERM_BLOCK, _best_batch, _passes, _ranked, _score, _weighed, _weights, terms
from tidemark.operators.tables import SnapshotTable
from tidemark.session import cut_lineage, spread, write_shared

#: Terms that are named in the scan's filter; more are met by a join.
NAMED_TERMS = 1000
#: Ids that are sent to all tasks; where more are to be met, the texts are joined.
NAMED_IDS = 500_000
#: A segment has so many documents at most, and ends once it has so many words.
SEGMENT_DOCS, SEGMENT_WORDS = 32_768, 4_000_000
#: Documents that a task of a search has, about.
TASK_DOCS = 20_000


class TextIndex:
    """``doc_id`` and texts under a folder; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        self.spark, self.parts = spark, parts
        self.postings = SnapshotTable(spark, f"{root.rstrip('/')}/blocks", "term", parts)
        self.docs = SnapshotTable(spark, f"{root.rstrip('/')}/places", "d", parts)

    def update(self, docs: DataFrame, doc_id: str, text: str, whole: bool = False) -> dict:
        """Take documents that are new or have another text than before; with ``whole`` they are all there are, and others
        are dropped. Null ids are ignored, null texts have no terms, of repeated ids the greatest text counts. Postings are
        written first: a run that dies before the documents' rows changes no result. Returns how many were taken.

        Only ids and digests are shuffled to tell which documents to take, and texts are read where they lie, unless both
        those to take and those to leave are more than all tasks can be told."""
        rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("d"), F.coalesce(text, F.lit("")).alias("text"))
        digest = F.unhex(F.sha2("text", 256))
        kind = rows.schema["d"].dataType.simpleString()
        stored = self.docs.read(f"d {kind}, gen int, seg long, pos int, len int, digest binary")
        old = stored.select("d", F.col("digest").alias("_old"))
        seen = write_shared(rows.select("d", digest.alias("digest")).groupBy("d").agg(F.count("*").alias("n"), F.max("digest").alias("digest")).join(old, "d", "left"))
        repeated = F.col("n") > 1
        leave = repeated | F.coalesce(F.col("digest") == F.col("_old"), F.lit(False))
        ids, left, twice = seen.agg(F.count("*"), F.count_if(leave), F.count_if(repeated)).first()
        fresh = _at(spread(rows), seen.filter(leave).select("d"), left, seen.filter(~leave).select("d"), ids - left).withColumn("digest", digest)
        taken = ids - left
        if twice:
            same = _at(rows, seen.filter(~repeated).select("d"), ids - twice, seen.filter(repeated).select("d"), twice)
            first = same.groupBy("d").agg(F.max("text").alias("text")).withColumn("digest", digest).join(old, "d", "left")
            first = cut_lineage(first.filter(F.col("_old").isNull() | (F.col("_old") != F.col("digest"))).drop("_old"))
            taken, fresh = taken + first.count(), fresh.unionByName(first)
        # Of an update that failed behind its postings these have a generation that no document gets.
        gen = self.postings.version() + 1
        own = stored.limit(0)
        if taken:
            # In order of ids, so that a task which is repeated gives the same places.
            made = fresh.sortWithinPartitions("d").mapInArrow(_inverter(gen), f"term string, gen int, seg long, docs binary, tfs binary, d {kind}, pos int, len int, digest binary")
            self.postings.append(made)
            named = self.postings.lookup(self.spark.createDataFrame([("",)], "term string"))
            own = named.filter((F.col("term") == "") & (F.col("gen") == gen)).select(*stored.columns)
        gone = stored.join(seen.select("d"), "d", "left_anti").select("d") if whole else stored.limit(0).select("d")
        touched = cut_lineage(own.select("d").unionByName(gone))
        if not touched.isEmpty() or not self.docs.version():
            self.docs.merge(touched, "d", lambda had: had.join(touched, "d", "left_anti").unionByName(own), stored.schema)
        return {"taken": taken}

    def search(self, queries: DataFrame, k: int, query_id: str, query_text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """``query_id, doc_id, score, rank`` by BM25, as ``retrieval.bm25`` gives it."""
        asked = queries.select(F.col(query_id).alias("q"), F.array_sort(F.array_distinct(terms(F.coalesce(F.col(query_text), F.lit(""))))).alias("terms")).filter("q is not null and size(terms) > 0")
        wanted = cut_lineage(asked.select(F.explode("terms").alias("term")).distinct())
        few = [r[0] for r in wanted.limit(NAMED_TERMS + 1).collect()]
        docs = self.docs.read()
        kinds = f"q {asked.schema['q'].dataType.simpleString()}, b {docs.schema['d'].dataType.simpleString()}, score double"
        n, words = docs.agg(F.count("*"), F.sum("len")).first()
        found = None
        if few and words:
            if len(few) <= NAMED_TERMS:
                posts = self.postings.lookup(wanted).filter(F.col("term").isin(few))
            else:
                posts = self.postings.read().join(F.broadcast(wanted) if wanted.count() <= TERM_BLOCK else wanted, "term", "left_semi")
            posts = posts.join(docs.select("gen", "seg").distinct(), ["gen", "seg"], "left_semi")
            laid = _laid(docs, posts, n)
            counts = cut_lineage(laid.mapInArrow(_count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0"))
            for got in _passes(_weighed(asked, counts), "q", F.size("terms"), TERM_BLOCK):
                part = laid.mapInArrow(_scorer(self.spark, got, k, n, words / n, k1, b), kinds)
                found = part if found is None else found.unionByName(part)
        if found is None:
            found = self.spark.createDataFrame([], kinds)
        return _ranked(found, k, query_id, "doc_id")

    def compact(self) -> None:
        """Write the postings anew without those that count for nothing."""
        stored, docs = self.postings.read(), self.docs.read()
        laid = _laid(docs, stored.filter("term <> ''").join(docs.select("gen", "seg").distinct(), ["gen", "seg"], "left_semi"), docs.count())
        blocks = laid.mapInArrow(_live, "term string, gen int, seg long, docs binary, tfs binary")
        self.postings.replace(blocks.unionByName(docs.withColumn("term", F.lit("")), allowMissingColumns=True).select(*stored.columns))


def _at(rows: DataFrame, leave: DataFrame, left: int, take: DataFrame, taken: int) -> DataFrame:
    """Rows of the ids to take, which are all but those to leave: the fewer ids of the two are sent to the rows."""
    if not left:
        return rows
    ids, how, count = (leave, "left_anti", left) if left <= taken else (take, "left_semi", taken)
    return rows.join(F.broadcast(ids) if count <= NAMED_IDS else ids, "d", how)


def _laid(docs: DataFrame, posts: DataFrame, n: int) -> DataFrame:
    """Live documents and blocks with those of a segment together, documents first; kept, as it is read several times."""
    both = docs.select("gen", "seg", "pos", "d", "len").unionByName(posts.select("gen", "seg", "term", "docs", "tfs"), allowMissingColumns=True)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, n // TASK_DOCS)
    return cut_lineage(both.repartition(tasks, "gen", "seg").sortWithinPartitions("gen", "seg", "term"))


def _pack(numbers):
    """Numbers as bytes of seven bits, the lowest first, all but a number's last marked; and where each one ends."""
    import numpy as np

    size = np.ones(len(numbers), np.int64)
    for bits in (7, 14, 21, 28):
        size += numbers >> bits > 0
    ends = size.cumsum()
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for i in range(size.max(initial=0)):
        more = size > i
        out[(ends - size)[more] + i] = (numbers[more] >> 7 * i & 127) | (size[more] > i + 1) << 7
    return out, ends


def _unpack(data):
    import numpy as np

    b = np.frombuffer(data, np.uint8)
    last = b < 128
    if last.all():
        return b.astype(np.int64)
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, starts)


def _binary(data, ends):
    import numpy as np
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])


class _Vocabulary(dict):
    """Numbers of terms by the words that are met."""

    def __init__(self):
        self.names: list[str] = []

    def __missing__(self, said: str) -> int:
        low = said.lower()
        if low not in self.keys():
            self[low] = len(self.names)
            self.names.append(low)
        self[said] = at = self[low]
        return at


def _inverter(gen: int):
    """Arrow function: d, text, digest of documents as blocks of segments, and the documents' places as rows without term."""

    def run(batches):
        import re

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        word = re.compile(r"[A-Za-z0-9_]+")
        seg = TaskContext.get().partitionId() << 24
        kept, said, lens, numbers = [], [], [], _Vocabulary()

        def segment():
            size = np.array(lens, np.int64)
            keys, tf = np.unique(np.concatenate(said) << 32 | np.repeat(np.arange(len(size)), size), return_counts=True)
            term, at = keys >> 32, keys & 0xFFFFFFFF
            begin = np.flatnonzero(np.diff(term, prepend=-1))
            gap = np.diff(at, prepend=0)
            gap[begin] = at[begin]
            last = np.append(begin[1:], len(keys)) - 1 if len(keys) else begin
            packed = [_binary(data, ends[last]) for data, ends in (_pack(gap), _pack(tf))]
            rows = pa.Table.from_batches(kept)
            d, digest = rows.column(0).combine_chunks(), rows.column(2).combine_chunks()
            for names, blocks, d_, pos, len_, digest_ in (
                (numbers.names, packed, pa.nulls(len(begin), d.type), pa.nulls(len(begin), pa.int32()), pa.nulls(len(begin), pa.int32()), pa.nulls(len(begin), digest.type)),
                ([""] * len(size), [pa.nulls(len(size), pa.binary())] * 2, d, pa.array(np.arange(len(size), dtype=np.int32)), pa.array(size.astype(np.int32)), digest),
            ):
                count = len(names)
                columns = [pa.array(names, pa.string()), pa.array(np.full(count, gen, np.int32)), pa.array(np.full(count, seg, np.int64)), *blocks, d_, pos, len_, digest_]
                yield pa.RecordBatch.from_arrays(columns, ["term", "gen", "seg", "docs", "tfs", "d", "pos", "len", "digest"])

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                some = batch.slice(start, 4096)
                if lens and (len(lens) + some.num_rows > SEGMENT_DOCS or sum(lens) >= SEGMENT_WORDS):
                    yield from segment()
                    seg, kept, said, lens, numbers = seg + 1, [], [], [], _Vocabulary()
                kept.append(some)
                for text in some.column(1).to_pylist():
                    words = word.findall(text)
                    lens.append(len(words))
                    said.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        if lens:
            yield from segment()

    return run


def _segments(batches):
    """Rows of each segment, with its live documents' ids, lengths and places, and its blocks."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def tell(held):
        rows = pa.Table.from_batches(held)
        own = rows.filter(pc.is_null(rows["term"]))
        blocks = rows.filter(pc.is_valid(rows["term"]))
        pos = own["pos"].to_numpy()
        alive = np.full(SEGMENT_DOCS, -1)
        alive[pos] = np.arange(len(pos))
        return own, alive, blocks

    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        gen, seg = batch.column("gen").to_numpy(), batch.column("seg").to_numpy()
        cuts = np.flatnonzero((gen[1:] != gen[:-1]) | (seg[1:] != seg[:-1])) + 1
        for a, z in zip([0, *cuts], [*cuts, batch.num_rows]):
            if now != (now := (gen[a], seg[a])) and held:
                yield tell(held)
                held = []
            held.append(batch.slice(a, z - a))
    if held:
        yield tell(held)


def _count(batches):
    """Arrow function: in how many live documents of a segment each term is."""
    import pyarrow as pa

    for _, alive, blocks in _segments(batches):
        df = [int((alive[_unpack(x).cumsum()] >= 0).sum()) for x in blocks["docs"].to_pylist()]
        yield pa.RecordBatch.from_arrays([blocks["term"].combine_chunks(), pa.array(df, pa.int64())], ["term", "df"])


def _live(batches):
    """Arrow function: blocks without places of documents that aren't live."""
    import numpy as np
    import pyarrow as pa

    for _, alive, blocks in _segments(batches):
        out: list = []
        for row in blocks.to_pylist():
            at, tf = _unpack(row["docs"]).cumsum(), _unpack(row["tfs"])
            keep = alive[at] >= 0
            if keep.any():
                out.append((row["term"], row["gen"], row["seg"], _pack(np.diff(at[keep], prepend=0))[0].tobytes(), _pack(tf[keep])[0].tobytes()))
        kinds = {"term": pa.string(), "gen": pa.int32(), "seg": pa.int64(), "docs": pa.binary(), "tfs": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out) if out else [[]] * 5, kinds.values())], list(kinds))


def _scorer(spark, got, k: int, n: int, mean: float, k1: float, b: float):
    """Arrow function: the k best of the partition's documents for each query of a block. ``got``: q, terms (term, df)."""
    each, vocabulary = _weights(got, n)
    shared = spark.sparkContext.broadcast((got["q"].combine_chunks(), each, vocabulary))

    def run(batches):
        import numpy as np

        ids, asked, known = shared.value
        best = None
        for own, alive, blocks in _segments(batches):
            d = own["d"].combine_chunks()
            names, length = d.to_numpy(zero_copy_only=False), k1 * (1 - b + b * own["len"].to_numpy() / mean)
            if not len(names):
                continue
            if best is None:
                best, b_type = (np.full((len(asked), k), np.inf), np.full((len(asked), k), names[0], names.dtype)), d.type
            postings: dict = {}
            for term, docs, tfs in zip(*[blocks[c].to_pylist() for c in ("term", "docs", "tfs")]):
                if (t := known.get(term)) is None:
                    continue
                where, tf = alive[_unpack(docs).cumsum()], _unpack(tfs)
                if (where < 0).any():
                    where, tf = where[where >= 0], tf[where >= 0]
                weight = tf * (k1 + 1) / (tf + length[where])
                if 4 * len(where) > len(names):
                    dense = np.zeros(len(names))
                    dense[where] = weight
                    postings[t] = (None, dense)
                elif len(where):
                    postings[t] = (where, weight)
            _score(asked, postings, names, best, k)
        if best is not None:
            yield _best_batch(ids, best, -1.0, ids.type, b_type)

    return run
