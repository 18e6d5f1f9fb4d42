"""Encoding a corpus with a public byte-level BPE tokenizer.

Texts longer than ``chunk_chars`` are cut into overlapping chunks, each of which is a row of its own. Chunks are
pre-tokenised in parallel; where the boundaries of a chunk and of the one before agree inside the overlap, both scans have
resynchronised, for a pre-token depends only on what follows its start. There the text is cut for good. Both ends of a
piece lie in the text its chunk carries, so pieces are cut out where the chunks are, encoded in parallel and put together
again: each text is sliced once, and the work is linear in its length. Chunks that don't agree anywhere in the overlap
(one endless word) are joined to the chunk before, so the result is that of encoding the whole text, always. A text of one
chunk is one piece. Decoding concatenates raw bytes.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import spread, write_shared

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a text are an array of integers; an empty and a null text have none.
IDS = "ids array<int>"


@lru_cache(maxsize=2)
def encoding_of(vocabulary: bytes):
    """The tokenizer of a rank file's content, once per process. No special tokens: strings that look like them are text."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("tidemark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str):
    """The tokenizer of a rank file."""
    with open(path, "rb") as f:
        return encoding_of(f.read())


def _shared(spark, path: str):
    """A rank file (about 1 MB), read by the driver and sent to the tasks, whose machines needn't have it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoder(vocabulary, text: str):
    """An Arrow function: appends ``ids`` to a batch and drops its text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoding_of(vocabulary.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = [np.asarray(enc.encode_ordinary(t), dtype=np.int32) if t else np.empty(0, np.int32) for t in batch.column(at).to_pylist()]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            values = np.concatenate(found) if found else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), ids], [*names, "ids"])

    return run


def boundaries(text: str, start: int, stop: int) -> list[int]:
    """Ends of pre-tokens in [start, stop] of a text scanned from its beginning, at which it may be cut: the character
    before is no white space (else what follows the cut would change what comes before it)."""
    import regex

    return [m.end() for m in regex.finditer(PATTERN, text) if start <= m.end() <= stop and not text[m.end() - 1].isspace()]


def _cutter(chunk: int, overlap: int):
    """Arrow function: doc, uid, text to a row per chunk, with the text behind it that overlaps the next one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                count = -(-len(text) // chunk)
                for at in range(0, count, 1024):
                    ks = range(at, min(at + 1024, count))
                    row = pa.array([i] * len(ks))
                    parts = pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in ks])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(ks, pa.int32()), pa.array([k == count - 1 for k in ks]), parts], ["doc", "uid", "k", "last", "chunk"])

    return run


def _scanner(chunk: int, overlap: int):
    """Arrow function: adds the boundaries of each chunk in its own overlap with the chunk before (head) and after (tail),
    as places in the whole text. The last pre-token of a chunk that is cut off may go on behind it, so its end counts for
    nothing."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            heads, tails = [], []
            for k, last, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                base, full = k * chunk, len(text)
                ends = [e for e in boundaries(text, 1, full) if last or e < full]
                heads.append([base + e for e in ends if e <= overlap])
                tails.append([base + e for e in ends if chunk < e <= chunk + overlap])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, kind), pa.array(tails, kind)], [*batch.schema.names, "head", "tail"])

    return run


def encode_corpus(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = f"{TOKENIZERS}/{BYTE_BPE_50K}", chunk_chars: int = 2048, overlap: int = 128) -> DataFrame:
    """``id_col, ids`` with one row per input row, repeated ones too. An empty and a null text give an empty list; rows of
    a null id are kept. Other columns of ``docs`` aren't read. White space, control characters and strings like special
    tokens are encoded as they are.

    ``chunk_chars``: what a chunk holds besides the overlap. Scanning costs as much again as encoding, and chunks are
    written and shuffled, so texts of one chunk, which is one piece, aren't scanned."""
    rows = spread(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    kind, vocabulary = rows.schema["doc"].dataType.simpleString(), _shared(docs.sparkSession, tokenizer)
    whole = rows.filter(~long).mapInArrow(_encoder(vocabulary, "text"), f"doc {kind}, {IDS}")
    made = f"doc {kind}, uid long, k int, last boolean, chunk string"
    chunked = rows.filter(long).select("doc", F.monotonically_increasing_id().alias("uid"), "text").mapInArrow(_cutter(chunk_chars, overlap), made)
    # Chunks of one text are scanned by many tasks, and written, so their number in the table is fixed from here on.
    scanned = write_shared(chunked.repartition("uid", "k").mapInArrow(_scanner(chunk_chars, overlap), f"{made}, head array<int>, tail array<int>"))
    pieces = _pieces(scanned, chunk_chars)
    coded = pieces.mapInArrow(_encoder(vocabulary, "piece"), f"doc {kind}, uid long, run int, {IDS}")
    stitched = coded.groupBy("uid").agg(F.first("doc").alias("doc"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "ids"))), lambda p: p["ids"])).alias("ids"))
    return whole.unionByName(stitched.select("doc", "ids")).select(F.col("doc").alias(id_col), "ids")


def _pieces(scanned: DataFrame, chunk: int) -> DataFrame:
    """``doc, uid, run, piece``: texts cut where the scans of neighbouring chunks agree."""
    # Without texts: at most a million short rows per document, as a string holds 2 GB.
    order = Window.partitionBy("uid").orderBy("k")
    cut = F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    marks = (
        scanned.select("uid", "k", "head", "tail").withColumn("at", cut)
        .withColumn("run", F.max(F.when(F.col("at").isNotNull(), F.col("k"))).over(order))
        .withColumn("next", F.lead("at").over(order)).withColumn("alone", F.col("at").isNotNull() & (F.lead("run").over(order).isNull() | (F.lead("run").over(order) > F.col("run"))))
        .select("uid", "k", "at", "run", "next", "alone")
    )
    start = F.coalesce(F.col("at") - F.col("k") * chunk, F.lit(0))
    stop = F.when(F.col("last"), F.length("chunk")).otherwise(F.coalesce(F.col("next") - F.col("k") * chunk, F.lit(chunk)))
    parts = scanned.select("doc", "uid", "k", "last", "chunk").join(marks, ["uid", "k"]).select("doc", "uid", "k", "run", "alone", F.substring("chunk", start + 1, stop - start).alias("piece"))
    joined = parts.filter("not alone").groupBy("uid", "run").agg(F.first("doc").alias("doc"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda p: p["piece"]), "").alias("piece"))
    return parts.filter("alone").select("doc", "uid", "run", "piece").unionByName(joined)


def decode_corpus(coded: DataFrame, id_col: str, ids_col: str = "ids", tokenizer: str = f"{TOKENIZERS}/{BYTE_BPE_50K}") -> DataFrame:
    """``id_col, text`` from token ids: the tokens' bytes in a row, read as UTF-8. A null list gives a null text."""
    rows = coded.select(F.col(id_col).alias("doc"), F.col(ids_col).alias("ids"))
    vocabulary = _shared(coded.sparkSession, tokenizer)

    def run(frames):
        import pandas as pd

        enc = encoding_of(vocabulary.value)
        for pdf in frames:
            yield pd.DataFrame({"doc": pdf["doc"], "text": [None if x is None else enc.decode_bytes([int(i) for i in x]).decode("utf-8", "replace") for x in pdf["ids"]]})

    return rows.mapInPandas(run, f"doc {rows.schema['doc'].dataType.simpleString()}, text string").withColumnRenamed("doc", id_col)


def count_tokens(docs: DataFrame, text_col: str, tokenizer: str = f"{TOKENIZERS}/{BYTE_BPE_50K}") -> DataFrame:
    """``docs`` with its text replaced by ``tokens``, the number of its tokens (0 for empty and null)."""
    kept = docs.drop(text_col).columns
    rows, vocabulary = spread(docs.select(*kept, F.col(text_col).alias("_text"))), _shared(docs.sparkSession, tokenizer)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoding_of(vocabulary.value)
        for batch in batches:
            n = np.array([len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(len(kept)).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(n)], [*kept, "tokens"])

    schema = rows.drop("_text").schema.add("tokens", "long")
    return rows.mapInArrow(run, schema)
