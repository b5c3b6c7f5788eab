"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the order of its NEAR nearest pivots (of at most PIVOTS reference vectors, taken from a bounded
sample farthest first, until each vector of the sample is nearer than APART to one).  So a dense group supplies few pivots,
however many vectors it has, and its members agree on most of their nearest ones.  If few pivots are that far apart, each
vector is near all of them, and all are compared.  A vector enters the inverted list of every pair of its pivots, so two vectors meet in a list exactly if they share at least two pivots:
the shared-pivot count, without emitting what shares fewer.  A pair that meets in several lists belongs to the one of the
two smallest pivots it shares.  Members of a list are compared by cosine in double precision.  Lists are dealt into chunks,
and each pair of chunks is a run of bounded size; a run returns, for each vector, how many links it found there, and a
spanning forest of them.

Equal vectors are collapsed first and stand for all their copies, so groups of copies are never expanded into pairs.
The index approximates: tests hold its recall against brute force (0.93 or more at a cosine of 0.9, 0.99 or more at 0.95;
with the pivots drawn from the data, 0.95 or more in dense groups).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored
from .components import components

#: Pivots in all (the sample's bound), nearest ones that describe a vector, least cosine of a link, rows of a chunk.
PIVOTS, NEAR, LEAST, CHUNK = 512, 7, 0.9, 1024
#: Vectors that pivots are chosen from, most cosine of two pivots, components of the pairs that are verified together.
SAMPLE, APART, BLOCK = 4096, 0.5, 1 << 22


def unit_rows(v: np.ndarray) -> np.ndarray:
    unit = v / np.abs(v).max(1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def by_length(vs: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and unit vectors of the rows of each length."""
    at, flat = vs.offsets.to_numpy(), vs.values.to_numpy()
    sizes = np.diff(at)
    for d in np.unique(sizes):
        pick = np.flatnonzero(sizes == d)
        yield int(d), pick, unit_rows(np.stack([flat[at[k] : at[k + 1]] for k in pick]))


def spread(unit: np.ndarray) -> np.ndarray:
    """Pivots: the first vector, then always the one farthest from those taken, while its cosine to each is at most APART."""
    taken, close = [0], unit @ unit[0]
    while len(taken) < PIVOTS and close[k := int(close.argmin())] <= APART:
        taken.append(k)
        close = np.maximum(close, unit @ unit[k])
    return unit[taken]


def describe(unit: np.ndarray, pivots: np.ndarray, near: int = NEAR) -> np.ndarray:
    """The `near` nearest pivots of each vector, nearest first; ties go to the earlier pivot."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :near].astype(np.int16)


def _run(key: int, same: bool, side: np.ndarray, ids: np.ndarray, weight: np.ndarray, near: np.ndarray, unit: np.ndarray, pivots: int) -> Iterator[tuple[int, int, int]]:
    """(class, links, other): links counted in this run, and links of a spanning forest (links 0, other's class)."""
    left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min()))
    if not len(left) or not len(right):
        return
    links, found = np.zeros(len(ids)), []
    root = np.arange(len(ids))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    step = max(1, BLOCK // unit.shape[1] // len(right))
    for at in range(0, len(left), step):
        i, j = np.nonzero(unit[left[at : at + step]] @ unit[right].T >= LEAST - 1e-12)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        i, j = left[i + at], right[j]
        sure = np.einsum("ij,ij->i", unit[i], unit[j]) >= LEAST
        i, j = i[sure], j[sure]
        if not i.size:
            continue
        # the two smallest shared pivots name the list that the pair belongs to
        shared = np.where((near[i][:, :, None] == near[j][:, None, :]).any(2), near[i], 32767).astype(np.int64)
        shared.sort(1)
        mine = shared[:, 0] * pivots + shared[:, 1] == key
        i, j = i[mine], j[mine]
        links += np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
        while (apart := np.flatnonzero(root[i] != root[j])).size:
            i, j = i[apart], j[apart]
            for a, b in zip(i[:1024].tolist(), j[:1024].tolist(), strict=True):
                if (x := top(a)) != (y := top(b)):
                    root[x] = y
                    found.append((a, b))
            while (root[root] != root).any():
                root = root[root]
    for k in np.flatnonzero(links):
        yield int(ids[k]), int(links[k]), int(ids[k])
    for a, b in found:
        yield int(ids[a]), 0, int(ids[b])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing:
    n_links 0, component_id their own id, kept (null id: null and false).  Vectors of different lengths never link.  Rows
    that repeat an id are vectors of their own.
    """
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.coalesce(good & finite, F.lit(False)))
    rows = rows.select("vec_id", "ok", F.when(F.col("ok"), F.col("v")).alias("v"), F.when(F.col("ok"), F.struct(F.xxhash64("v"), F.xxhash64(F.lit("second"), "v"))).alias("same"))
    classes = rows.where("ok").groupBy("same").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    taken = classes.select("v").orderBy(F.xxhash64(F.lit("pivot"), "v"), "v").limit(SAMPLE).toArrow()["v"].combine_chunks()
    pivots = classes.sparkSession.sparkContext.broadcast({d: spread(unit) for d, _, unit in by_length(taken)})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weight = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for d, pick, unit in by_length(batch.column(2)):
                p = pivots.value.get(d, np.eye(d)[:PIVOTS])
                if len(p) < 2:
                    p = np.concatenate([p, -p])
                near = np.sort(describe(unit, p), axis=1)
                for k, x, u in zip(pick.tolist(), near, unit, strict=True):
                    data, desc = u.tobytes(), x.tobytes()
                    out += [((d << 32) + int(a) * PIVOTS + int(b), ids[k], weight[k], desc, data) for a, b in combinations(x, 2)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            for i in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 50_000], strict=True), kinds, strict=True)], names=["list", "id", "weight", "near", "unit"])

    posted = arrow_map(classes.select("id", "weight", "v"), index, "list long, id long, weight long, near binary, unit binary")
    sizes = stored(posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK), "lists")
    dealt = posted.join(sizes, "list", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / CHUNK).cast("int"), F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("list", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "weight", "near", "unit")
    dealt = dealt.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def runs(table: pa.Table, cuts: np.ndarray, keys: np.ndarray) -> Iterator[tuple]:
            ids, weight, side = (table[c].to_numpy() for c in ("id", "weight", "chunk"))
            near, unit = table["near"].to_pylist(), table["unit"].to_pylist()
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    u = np.frombuffer(b"".join(unit[a:b])).reshape(b - a, -1)
                    x = np.frombuffer(b"".join(near[a:b]), np.int16).reshape(b - a, -1)
                    yield from _run(int(keys[a, 0]) & 0xFFFFFFFF, keys[a, 1] == keys[a, 2], side[a:b], ids[a:b], weight[a:b], x, u, PIVOTS)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("list", "i", "j")], 1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
            if not last:  # the last run may go on
                held = table.slice(int(cuts[-2])).to_batches()
                cuts = cuts[:-1]
            else:
                held = []
            out = list(runs(table, cuts, keys))
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c)], names=["id", "links", "other"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 20_000:
                yield from flush(False)
        yield from flush(True)

    found = stored(arrow_map(dealt, compare, "id long, links long, other long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("links = 0").select(F.col("id").alias("a"), F.col("other").alias("b")))
    slim = classes.select("same", "id", "least", "weight")
    named = slim.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").select("same", "least", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
    named = stored(named, "named")
    tops = named.groupBy("root").agg(F.min("least").alias("top"))
    of = named.join(tops, "root").select("same", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("top").alias("component_id"))
    out = rows.where("ok").select("vec_id", "same").join(of, "same").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
