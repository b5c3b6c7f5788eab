"""SimHash fingerprints and their near-duplicate groups by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments.  When two fingerprints differ in at most three bits, one of the segments
differs in at most one.  So each segment is indexed as it stands and once for every position with that bit wiped: equal
segments meet under the first key, segments one bit apart under exactly one of the others, where they stand on opposite
sides of the wiped bit.  Keys with one fingerprint, or with one side only, are dropped by a count that is combined before
the shuffle; the others are joined by equality and verified by the number of differing bits.

A key that many fingerprints share is dealt into chunks; each pair of chunks is compared in one task of bounded size that
returns a spanning forest of the verified links, so its pairs are never emitted and no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, dealt, free, slim, stored, texts
from .components import components

WORDS, SEED, BITS = 3, 42, 3
#: Fingerprints under one key that are joined pair by pair; above, chunks of CHUNK are compared within tasks.
SMALL, CHUNK = 16, 1024
#: Shingles held at a time.
HELD = 1 << 17
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _counts(digests: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(digests), np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)


def fingerprint(text: bytes) -> int:
    """Bit set where over half of the shingles' XXH64 have it; a text without words has 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    digest, flat = xxhash.xxh64_digest, b" ".join(words)
    if len(words) <= WORDS:
        return int.from_bytes(digest(flat, SEED), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    ends = ends.tolist()
    n, total = len(words) - WORDS + 1, np.zeros(64, np.int64)
    for i in range(0, n, HELD):
        j = min(n, i + HELD)
        total += _counts([digest(flat[s:e], SEED) for s, e in zip(starts[i:j], ends[i + WORDS - 1 : j + WORDS - 1], strict=True)])
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), fp (the fingerprint as a signed long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    rows = slim(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("th"))
    return arrow_map(rows, run, docs.select("doc_id").schema.add("th", "long").add("fp", "long"))


def _keys(fps: DataFrame) -> DataFrame:
    """fp -> (fp, slot, part, side): slot is the segment and the wiped bit (32: none), part the segment without it."""
    out = []
    for k in range(2):
        part = F.shiftrightunsigned("fp", 32) if k else F.col("fp").bitwiseAND(0xFFFFFFFF)
        out.append(F.struct(F.lit(33 * k + 32).alias("slot"), part.alias("part"), F.lit(0).alias("side")))
        for p in range(32):
            bit = F.shiftright(part, p).bitwiseAND(1)
            out.append(F.struct(F.lit(33 * k + p).alias("slot"), part.bitwiseAND(0xFFFFFFFF ^ (1 << p)).alias("part"), bit.cast("int").alias("side")))
    return fps.select("fp", F.inline(F.array(*out)))


def _forest(key: tuple, table: pa.Table) -> pa.Table:
    """Links of a spanning forest between the fingerprints of one pair of chunks."""
    fp, chunk, side = (table.column(c).to_numpy() for c in ("fp", "chunk", "side"))
    bits = fp.view(np.uint64)
    equal = key[0].as_py() % 33 == 32
    root = np.arange(len(fp))
    links = []
    i_c, j_c = key[2].as_py(), key[3].as_py()
    rows = np.flatnonzero(chunk == i_c)
    others = np.flatnonzero(chunk == j_c)
    for i in rows:
        near = others[np.bitwise_count(bits[others] ^ bits[i]) <= BITS]
        near = near[near != i] if equal else near[side[near] != side[i]]
        while len(near := near[root[near] != root[i]]):
            old = root[near[0]]
            links.append((fp[i], fp[near[0]]))
            root[root == old] = root[i]
    a = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": a[:, 0], "b": a[:, 1]})


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints that differ in at most BITS bits, or a spanning forest of them."""
    keys = _keys(dealt(fps))  # a slim table comes in few splits, and each row becomes 66
    n = keys.groupBy("slot", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("side").alias("ones"))
    shared = stored(n.where("n > 1 AND (slot % 33 = 32 OR (ones > 0 AND ones < n))").select("slot", "part", "n"), "keys")
    hits = stored(keys.join(shared, ["slot", "part"]), "hits")
    left = hits.where(F.col("n") <= SMALL).select("slot", "part", F.col("fp").alias("a"), F.col("side").alias("sa"))
    right = hits.where(F.col("n") <= SMALL).select("slot", "part", F.col("fp").alias("b"), F.col("side").alias("sb"))
    pairs = left.join(right, ["slot", "part"]).where("(slot % 33 = 32 AND a < b) OR (sa = 0 AND sb = 1)")
    few = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")
    many = hits.where(F.col("n") > SMALL).withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int"))
    many = many.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.select("slot", "part", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fp", "chunk", "side")
    return few.unionByName(many.groupBy("slot", "part", "i", "j").applyInArrow(_forest, "a long, b long"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp, root (least fingerprint of the group), component_id (least doc_id reachable by links) of every row.

    Texts that are null or without words share fingerprint 0 and link with each other.  Rows that repeat an id keep a row
    each; a null id takes no part in the least (null only where no linked row has an id).  No rows in, no rows out.
    """
    prints = stored(fingerprints(docs), "prints")
    least = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = components(links(least.select("fp")))
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tops = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(named.join(tops, "root").select("fp", "root", "component_id"))
    return prints.join(of, "fp").select("doc_id", "th", "fp", "root", "component_id")


def hexed(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def stage(docs: DataFrame) -> DataFrame:
    """One row of each group stays: the one of least id (null last), then of least text hash; of equal rows, one.

    Groups are those of `groups`, so most near copies of a similarity of 0.8 to 0.9 stay (figures in the README).  Null texts
    count as empty and are one group with texts without words.  No rows in, no rows out."""
    first = groups(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), "th")).alias("m"))
    key = free(docs.columns, "n", "id", "th")
    keep = first.select(*[c.alias(x) for c, x in zip((F.col("m.n"), F.coalesce("m.i", F.lit(0)), F.col("m.th")), key, strict=True)])
    here = (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64("text"))
    # repeated rows are dropped before the texts are dealt, and the join takes them as they were dealt
    rows = docs.withColumns(dict(zip(key, here, strict=True))).dropDuplicates(key)
    return rows.join(keep, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
