"""The k most similar vectors of every vector, by a permutation index.

A bounded sample of vectors serves as pivots. Each vector is represented by its ``width`` nearest pivots in order and
posted in the inverted files of the first ``posts`` of them, so what a vector costs doesn't depend on the size of the
collection. Inside a posting list the others are ranked by Spearman's footrule between the pivot orders, the nearest
``candidates`` (in a shorter list all) are reranked by exact cosine similarity, and the lists' findings are merged per
vector.

Posting lists that the sample shows to be longer than ``longest`` mean lists, or than ``most_rows``, are cut by the next
pivots of the permutation, again and again as long as this makes them shorter, unless this loses neighbours that the
whole list has. Memory doesn't depend on this: a vector is posted a few thousand rows at a time, however many lists it is
in, a list is compared in blocks, and its vectors lie in a file beyond 32 MB; its ids and permutations stay. Pivots are drawn from the vectors, so a region that holds a third of these has a third
of the pivots, and its lists are no longer than others.

Copies of a vector, also rescaled ones whose directions differ by rounding, are one vector in the index and come back as
members afterwards, so a group of copies of any size adds rows in proportion to itself, never its pairs. Equal cosines fall
to the smallest id among the copies, in the lists and where these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import spread


#: Cosines in single precision that lie closer together than this may be equal to 6 digits.
BLUR = 4e-6
#: Directions are one if they fall into one cell of this width on each of so many fixed random axes: rounding moves them by
#: some 1e-8 there, so one group of rescaled copies in fifty or so is two, and unlike directions never meet by chance.
CELL, AXES = 1e-6, 6
#: Vectors looked at and rows posted at once, cosines in a block, and bytes from which an array lies in a file.
SLICE, BLOCK, ROOM = 2048, 1 << 22, 32_000_000
#: Vectors whose true neighbours in the whole collection are looked up where the sample knows too few.
ASKED = 512
#: Bytes of posted vectors a task should read, and the most tasks.
TASK_BYTES, MOST_TASKS = 12_000_000, 50_000


@dataclass(frozen=True)
class IndexOptions:
    """The mean length of a posting list follows the square root of the collection (``list_factor`` times it,
    ``min_list`` at least), and so does the number of pivots, up to ``max_pivots`` (the bound of what is sent to every
    task: 4096 pivots of 384 floats are 6 MB): with lists of a fixed length recall would fall as the collection grows.
    The sample tells how many true neighbours share a list; while these are fewer than ``recall``, lists are made longer
    (``efforts``: by how much, and in how many sublists a vector is posted where its list is cut). In a sample far smaller
    than the collection neighbours are farther apart, so the estimate is then too low rather than too high: where it is
    too low for the first effort, the neighbours of some vectors in the whole collection decide, and long lists stay
    whole where cut ones are what loses them.
    ``candidates`` and ``longest`` are in lengths of a mean list; ``most_rows`` is the length in rows from which lists are
    cut whatever the mean (20,000 vectors of 384 floats are 31 MB). ``sample_rows`` bounds the sample from which pivots are
    drawn and long lists are foreseen (13 MB on the driver)."""

    posts: int = 3
    width: int = 24
    list_factor: float = 3.2
    min_list: int = 300
    candidates: float = 2.0
    longest: float = 4.0
    most_rows: int = 20_000
    max_pivots: int = 4096
    recall: float = 0.94
    efforts: tuple = ((1.0, 2), (1.3, 2), (1.6, 2), (2.0, 3), (2.6, 3), (4.0, 4), (6.0, 5))
    sample_rows: int = 8_192
    seed: int = 7

    def list_rows(self, total: int) -> int:
        return max(self.min_list, round(self.list_factor * total**0.5))


def _sliced(batches):
    """Arrow batches of ``SLICE`` rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _room(shape: tuple, dtype: str):
    """An array without content; a large one lies in an unnamed file."""
    import tempfile

    import numpy as np

    if np.prod(shape, dtype=float) * np.dtype(dtype).itemsize <= ROOM:
        return np.empty(shape, dtype)
    with tempfile.TemporaryFile() as f:
        return np.asarray(np.memmap(f, dtype, "w+", shape=shape))


def _directions(vecs, dim: int):
    """Of an Arrow column of vectors: the places of the usable ones, these, and a hash of the direction of each. Not
    usable are all-zero vectors, vectors of another length and those with NaN or infinity: they are similar to nothing."""
    import numpy as np
    import xxhash

    lengths = np.asarray(vecs.value_lengths().fill_null(-1))
    keep = np.flatnonzero(lengths == dim)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    flat = np.asarray(vecs.flatten().to_numpy(zero_copy_only=False), dtype="<f4")
    whole = len(keep) == len(lengths)
    x = (flat if whole else np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in keep] or [flat[:0]])).reshape(len(keep), dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    keep, x = keep[good], np.ascontiguousarray(x[good])
    keys = np.array([xxhash.xxh64_intdigest(y) for y in _cells(x)], np.uint64).astype(np.int64)
    return keep, x, keys


def _cells(x):
    """The cells of vectors' directions on the axes."""
    import numpy as np

    y = _scaled(x)
    y /= np.sqrt((y * y).sum(axis=1, keepdims=True))
    axes = np.random.default_rng(5).normal(size=(y.shape[1], AXES))
    return np.floor(np.einsum("rd,da->ra", y, axes) / CELL).astype(np.int64)


def _scaled(x):
    """Vectors in double precision with 1 as their greatest component: no overflow in the squares, and the same for
    rescaled copies."""
    import numpy as np

    x = x.astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True) + 0.0


def _members_of(dim: int):
    """Arrow function: id and vector to id and the hash of the vector's direction."""

    def run(batches):
        import pyarrow as pa

        for batch in _sliced(batches):
            keep, _, keys = _directions(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(keys, pa.int64())], ["id", "rep"])

    return run


def _pack(dim: int):
    """Arrow function: id and vector to the hash of its direction, the id and the vector's bytes, those of equal weight
    side by side and compressed. A direction that the partition has had is left out, unless a smaller id than the one
    given away turns up: this follows at the end."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def batch_of(keys, ids, x):
            planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), dim, 4).transpose(0, 2, 1)).reshape(len(x), dim * 4)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.string()), pa.array([codec.compress(p, asbytes=True) for p in planes], pa.binary())], ["key", "first", "packed"])

        codec = pa.Codec("zstd", 1)
        had: dict = {}
        later: dict = {}
        for batch in _sliced(batches):
            keep, x, keys = _directions(batch.column(1), dim)
            ids, new = batch.column(0).take(pa.array(keep)).to_pylist(), []
            for i, (key, name) in enumerate(zip(keys.tolist(), ids)):
                if key not in had:
                    new.append(i)
                elif name < had[key]:
                    later[key] = x[i].copy()
                else:
                    continue
                had[key] = name
            yield batch_of(keys[new], [ids[i] for i in new], np.ascontiguousarray(x[new]))
        rest = list(later)
        for at in range(0, len(rest), 2048):
            part = rest[at : at + 2048]
            yield batch_of(part, [had[key] for key in part], np.stack([later[key] for key in part]))

    return run


def _unpack(blobs, dim: int):
    """Unit vectors of packed ones, in double precision only where asked for."""
    import numpy as np
    import pyarrow as pa

    codec = pa.Codec("zstd")
    planes = np.frombuffer(b"".join(codec.decompress(b, dim * 4, asbytes=True) for b in blobs), np.uint8).reshape(len(blobs), 4, dim)
    x = _scaled(np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<f4").reshape(len(blobs), dim))
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def permutations(x, pivots, width: int):
    """The nearest pivots of unit vectors, in order; equal similarities fall to the smaller pivot number."""
    import numpy as np

    width, out = min(width, len(pivots)), []
    for at in range(0, len(x), 2048):
        sims = x[at : at + 2048] @ pivots.T
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width] if width < sims.shape[1] else np.tile(np.arange(width), (len(sims), 1))
        near.sort(axis=1)
        order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
        out.append(np.take_along_axis(near, order, 1).astype(np.int16))
    return np.concatenate(out)


def list_keys(perm, posts: int, long_lists: frozenset, sublists: int = 2) -> list[tuple]:
    """Posting lists of one permutation: its first pivots; a list known to be long is left for so many sublists by the next
    pivots."""
    keys, todo = [], [(int(p),) for p in perm[:posts]]
    while todo:
        key = todo.pop()
        if key in long_lists:
            todo += [(*key, p) for p in [int(p) for p in perm if int(p) not in key][:sublists]]
        else:
            keys.append(key)
    return sorted(set(keys))


def footrule_block(pos, rows, width: int):
    """Footrule distances of some rows to all: the sum over pivots of how far apart their places are, where a pivot
    that isn't among the nearest has place ``width``. ``pos``: pivots x rows, the places as bytes."""
    import numpy as np

    out = np.zeros((len(rows), pos.shape[1]), np.int16)
    for places in pos:
        mine = places[rows][:, None]
        out += np.abs(mine - places[None, :])
    return out


def _nearest(x, row: int, others, take: int):
    """The ``take`` of the other rows that are nearest to a row, equal ones (to 6 digits) by place."""
    import numpy as np

    mine = x[row].astype(np.float64)
    # Nothing is nearer than the same direction: enough of these among the first ones, and the others needn't be seen.
    if len(others) > 64:
        same = others[:64][(x[others[:64]].astype(np.float64) @ mine).round(6) >= 1.0]
        if len(same) >= take:
            return same[:take]
    exact = x[others].astype(np.float64) @ mine
    return others[np.lexsort((others, -exact.round(6)))[:take]]


def _posts(dim: int, width: int, posts: int, sublists: int, shared):
    """Arrow function: id and vector to a row for each list that the vector is posted in, some rows at a time."""
    pack = _pack(dim)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, long_ = shared.value
        for batch in pack(batches):
            if not batch.num_rows:
                continue
            perm = permutations(_unpack(batch.column("packed").to_pylist(), dim), at, width)
            keys = [list_keys(p, posts, long_, sublists) for p in perm]
            pick = np.repeat(np.arange(len(perm)), [len(x) for x in keys])
            names, perms = (",".join(map(str, y)) for x in keys for y in x), pa.array([p.tobytes() for p in perm], pa.binary())
            for i in range(0, len(pick), SLICE):
                part = pa.array(pick[i : i + SLICE])
                yield pa.RecordBatch.from_arrays([pa.array([next(names) for _ in part], pa.string()), batch.column("key").take(part), batch.column("first").take(part), perms.take(part), batch.column("packed").take(part)], ["list", "rep", "first", "perm", "packed"])

    return run


def _read_list(batches, dim: int):
    """Of one posting list, in the order of the smallest ids, so that the smaller place is the smaller id: hashes, ids, unit
    vectors and permutations, each hash once."""
    import tempfile

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    reps, firsts, perms = [], [], []
    with tempfile.TemporaryFile() as f:
        for batch in _sliced(batches):
            reps.append(np.asarray(batch.column("rep")))
            firsts.append(batch.column("first"))
            perms.append(np.frombuffer(b"".join(batch.column("perm").to_pylist()), np.int16).reshape(batch.num_rows, -1))
            f.write(_unpack(batch.column("packed").to_pylist(), dim).data)
        f.flush()
        rep, first = np.concatenate(reps), pa.chunked_array(firsts, pa.string()).combine_chunks()
        order = np.asarray(pc.sort_indices(pa.table({"first": first, "rep": rep}), [("first", "ascending"), ("rep", "ascending")])).astype(np.int64)
        order = order[np.sort(np.unique(rep[order], return_index=True)[1])]
        came, x = np.memmap(f, "<f4", "r", shape=(len(rep), dim)), _room((len(order), dim), "<f4")
        for at in range(0, len(order), SLICE):
            x[at : at + SLICE] = came[order[at : at + SLICE]]
    return rep[order], first.take(pa.array(order)), x, np.concatenate(perms)[order]


def _list_neighbours(dim: int, k: int, width: int, candidates: int, least: float | None = None):
    """Grouped Arrow function: of one posting list, for each vector its best k by exact cosine among the ``candidates``
    nearest by footrule, equal ones (to 6 digits) by their smallest id; with ``least`` only those not clearly below it.
    Works through the list in blocks of rows."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        ids, names, x, perm = _read_list(batches, dim)
        n = len(ids)
        if n < 2:
            return
        c, pos = min(candidates, n - 1), None
        if c < n - 1:
            seen, col = np.unique(perm, return_inverse=True)
            pos = _room((len(seen), n), "int8")
            pos[:] = width
            pos[col.reshape(perm.shape), np.arange(n)[:, None]] = np.arange(perm.shape[1], dtype=np.int8)
        step = max(1, min(256, BLOCK // n))
        for at in range(0, n, step):
            rows = np.arange(at, min(at + step, n))
            sims = x[rows] @ x.T
            sims[np.arange(len(rows)), rows] = -2
            if least is not None:
                # Rows with nothing near enough give no rows, whatever is nearest.
                some = sims.max(axis=1) >= least - 2 * BLUR
                rows, sims = rows[some], sims[some]
                if not len(rows):
                    continue
            if pos is not None:
                far = footrule_block(pos, rows, width)
                far[np.arange(len(rows)), rows] = np.iinfo(np.int16).max
                # Of equal distances all stay in: the cut is by distance, not by place.
                edge = np.partition(far, c - 1, axis=1)[:, c - 1 : c]
                sims[far > edge] = -2
            take = min(k + 3, n - 1)
            best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
            # Where more than these may be as near as the last one wanted, which of them have the smallest ids.
            if take < n - 1:
                last = -np.partition(-np.take_along_axis(sims, best, 1), min(k, take - 1), axis=1)[:, min(k, take - 1)]
                close = (sims >= last[:, None] - BLUR) & (sims > -2)
                for i in np.flatnonzero(close.sum(axis=1) > take):
                    best[i] = _nearest(x, rows[i], np.flatnonzero(close[i]), take)
            exact = np.einsum("rd,rtd->rt", x[rows].astype(np.float64), x[best].astype(np.float64))
            exact[np.take_along_axis(sims, best, 1) <= -2] = -2
            order = np.lexsort((best, -exact.round(6)), axis=1)[:, : k + 1]
            best, exact = np.take_along_axis(best, order, 1), np.take_along_axis(exact, order, 1)
            kept = exact > -2 if least is None else exact >= least - 1e-6
            right = best[kept]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], kept.sum(axis=1))), pa.array(ids[right]), names.take(pa.array(right)), pa.array(exact[kept])], ["rep", "other", "first", "cosine"])

    # Spark tells by these whether a list comes whole or in batches.
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def nearest_neighbours(vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, options: IndexOptions = IndexOptions(), least: float | None = None) -> DataFrame:
    """``id, neighbour, cosine, place``: for each id its k most similar other ids by cosine, equal ones (to 6 digits)
    by id. Ids are text. Every row is indexed and every row is a query. ``least`` leaves out neighbours below a cosine,
    which doesn't change the places of the others.

    All-zero, null, empty, non-finite vectors and such of another length than most are similar to nothing and have no
    rows. Repeated rows of an id with the same vector count once; unlike vectors of one id are compared each, and the
    best similarity counts. Null ids are ignored; an empty table gives an empty result."""
    import numpy as np

    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).filter("id is not null and vector is not null")
    total = rows.select("id").count()
    # A bounded sample: the ids whose hash lies below a bar, a fifth more than asked for, the smallest of these.
    bar = min(1.0, 1.2 * options.sample_rows / max(1, total))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(options.seed), "id"), 11)
    sample = rows.filter(place <= F.lit(int(bar * 2**53))).orderBy(place, "id").limit(options.sample_rows)
    drawn = sample.select(F.size("vector").alias("dim"), "vector").filter("dim > 0").toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], "id string, neighbour string, cosine double, place int")
    dim = int(np.bincount(drawn["dim"].to_numpy()).argmax())
    _, x, keys = _directions(drawn["vector"].combine_chunks(), dim)
    x = _scaled(x[np.sort(np.unique(keys, return_index=True)[1])])
    if not len(x):
        return spark.createDataFrame([], "id string, neighbour string, cosine double, place int")
    x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
    pivots, width, length, long_lists, sublists = _fit(x, total, k, options, lambda asked: _true_neighbours(spread(rows), asked, dim, k, least))
    shared = spark.sparkContext.broadcast((pivots, long_lists))

    # Copies of a vector are one key. A partition posts a key once, or twice if its smallest id came late; lists drop what
    # was posted several times but for the smallest id.
    posted = spread(rows).mapInArrow(_posts(dim, width, options.posts, sublists, shared), "list string, rep long, first string, perm binary, packed binary")
    # As many tasks as the posted vectors need, not as the session has by default: lists spread over them by their names.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-options.posts * total * dim * 4 // TASK_BYTES)))
    found = posted.repartition(tasks, "list").groupBy("list").applyInArrow(_list_neighbours(dim, k, width, round(options.candidates * length), least), "rep long, other long, first string, cosine double")
    # With a bound, those clearly below are left out: they have places after all others; those equal to 6 digits don't.
    pairs = found.groupBy("rep", "other").agg(F.max("cosine").alias("cosine"), F.min("first").alias("first"))
    near = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy(F.round("cosine", 6).desc(), "first"))).filter(F.col("_n") <= k + 1).drop("_n", "first")
    best = _members(spread(rows).mapInArrow(_members_of(dim), "id string, rep long").select("rep", "id"), near, k)
    return best if least is None else best.filter(F.col("cosine") >= least)


def _true_neighbours(rows: DataFrame, asked, dim: int, k: int, least: float | None):
    """Of unit vectors, their k nearest among all rows but their copies, of those with a cosine of ``least``: the places of
    the asked and the unit vectors found."""
    import numpy as np

    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in _sliced(batches):
            vecs = batch.column(1).filter(pc.equal(pc.list_value_length(batch.column(1)), dim))
            x = np.asarray(vecs.flatten().to_numpy(zero_copy_only=False), "<f4").reshape(-1, dim)
            x = np.ascontiguousarray(x[np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)])
            if not len(x):
                continue
            u = x / np.abs(x).max(axis=1, keepdims=True)
            sims = shared.value @ u.T / np.sqrt((u * u).sum(axis=1))
            sims[sims > 1 - 1e-6] = -2
            take = min(k, len(x))
            best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
            near = np.take_along_axis(sims, best, 1)
            ask, place = np.nonzero(near >= (-1 if least is None else least))
            yield pa.RecordBatch.from_arrays([pa.array(ask, pa.int32()), pa.array(near[ask, place].astype(float)), pa.array([y.tobytes() for y in x[best[ask, place]]], pa.binary())], ["ask", "cosine", "vector"])

    found = rows.select("id", "vector").mapInArrow(run, "ask int, cosine double, vector binary")
    found = found.withColumn("_n", F.dense_rank().over(Window.partitionBy("ask").orderBy(F.round("cosine", 6).desc()))).filter(F.col("_n") <= k)
    got = found.groupBy("ask", F.col("_n")).agg(F.min("vector").alias("vector")).select("ask", "vector").toArrow()
    x = _scaled(np.frombuffer(b"".join(got["vector"].to_pylist()), "<f4").reshape(-1, dim))
    return np.asarray(got["ask"]), (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _fit(x, total: int, k: int, options: IndexOptions, ask=None):
    """Pivots, width, mean list, long lists and sublists, from a sample of unit vectors: the first of ``efforts`` with
    which enough of the nearest neighbours that the sample knows share a list. ``ask`` gives the true neighbours of some
    vectors, for a collection beyond the sample in which the first effort seems too small."""
    import numpy as np

    asked = np.arange(0, len(x), max(1, len(x) // 1000))
    near = max(1, min(round(k * len(x) / max(1, total)), len(x) - 1, k))
    one, other = asked[:0], x[:0]
    if len(x) > 1:
        sims = x[asked] @ x.T
        sims[np.arange(len(asked)), asked] = -2
        true = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        one, other = np.repeat(asked, near), x[true.ravel()]

    def fit(factor: float, sublists: int, whole: bool):
        length = round(options.list_rows(total) * factor)
        count = min(max(2 * options.posts, -(-options.posts * total // length)), options.max_pivots, len(x))
        pivots = np.ascontiguousarray(x[:count])
        width = min(options.width, count)
        perm = permutations(x, pivots, width)
        long_lists = frozenset() if whole else _long_lists(perm, total / len(x), options.posts, min(options.longest * length, options.most_rows), width, sublists)
        last = len(x) < 2 or count <= 2 * options.posts
        if last or not len(one):
            return last, 1.0, (pivots, width, length, long_lists, sublists)
        lists = lambda perm: [set(list_keys(p, options.posts, long_lists, sublists)) for p in perm]
        mine = dict(zip(np.unique(one).tolist(), lists(perm[np.unique(one)])))
        share = np.mean([not mine[i].isdisjoint(y) for i, y in zip(one.tolist(), lists(permutations(other, pivots, width)))])
        return last, share, (pivots, width, length, long_lists, sublists)

    last, share, got = fit(*options.efforts[0], False)
    if last or share >= options.recall:
        return got
    beyond = ask is not None and total > 2 * len(x)
    if beyond:
        asked = np.arange(0, len(x), max(1, len(x) // ASKED))
        found, other = ask(x[asked])
        one = asked[found]
    for effort in options.efforts:
        for whole in (False, True)[: 1 + beyond]:
            last, share, got = fit(*effort, whole)
            if last or share >= options.recall:
                return got
    return got


def _long_lists(perm, weight: float, posts: int, most: float, width: int, sublists: int = 2) -> frozenset:
    """Posting lists, and sublists of long ones, that the sample foresees to exceed ``most`` rows. Where the sublists
    wouldn't be shorter, as in a list of vectors with one permutation, cutting ends."""
    from collections import Counter

    long_: frozenset = frozenset()
    parents: dict = {}
    for depth in range(1, width):
        sizes = Counter(key for p in perm for key in list_keys(p, posts, long_, sublists) if len(key) == depth)
        more = {key for key, n in sizes.items() if n * weight > most and n < 0.8 * parents.get(key[:-1], n + n)}
        if not more:
            break
        long_ |= more
        parents = sizes
    return long_


def _members(copies: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """From vectors to ids: a vector's first k + 1 ids stand for all its copies, for nobody needs more of them."""
    copies = copies.distinct()
    first = copies.withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("_n") <= k + 1)
    first = first.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    one = lambda cosine, i: F.struct((-F.round(cosine, 6)).alias("far"), i.alias("id"), cosine.alias("cosine"))
    others = near.join(first.withColumnRenamed("rep", "other"), "other").select("rep", F.transform("ids", lambda i: one(F.col("cosine"), i)).alias("c"))
    own = first.filter(F.size("ids") > 1).select("rep", F.transform("ids", lambda i: one(F.lit(1.0), i)).alias("c"))
    # At most (k + 1)(k + 1) + k + 1 per vector; of these the best k + 1, one of which may be the id itself.
    ranked = others.unionByName(own).groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, k + 1).alias("all"))
    top = copies.join(ranked, "rep").select("id", F.explode(F.slice(F.filter("all", lambda c: c["id"] != F.col("id")), 1, k)).alias("c"))
    # An id with one vector, the usual case, has its order already; one with several takes its best.
    best = top.groupBy("id", F.col("c.id").alias("neighbour")).agg(F.max("c.cosine").alias("cosine"))
    order = Window.partitionBy("id").orderBy(F.round("cosine", 6).desc(), "neighbour")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("id", "neighbour", "cosine", "place")


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """``id_a, id_b`` (the smaller id first) of which one is among the other's neighbours with at least that cosine."""
    near = neighbours.filter(F.col("cosine") >= least)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
