"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes holds, for the contexts of 0 to `order` preceding bytes, which bytes follow
how often.  The statistics are then frozen, and the exact code length of a byte under PPM-C is a table entry: the longest
context known to any language predicts; a byte it has not seen costs an escape (novel bytes / (count + novel bytes)) and is
then predicted by the next shorter context, without the bytes already ruled out; below the empty context all remaining bytes
are equally likely.  So the lengths of all 256 bytes in any context obey sum(2**-length) = 1.  A text gets the language whose
tree codes it in the fewest bits.

Contexts at the start of a text are filled with line feeds.  Only text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, buffers, chunks, free, slim, stored

#: Bounds of the training sample: bytes of each language, bytes of all, bytes of a text.  All languages share them.
SAMPLE_BYTES, TOTAL_BYTES, TEXT_BYTES = 400_000, 4_000_000, 65_536
#: Bound of the model's table of costs: contexts that the sample holds least often are left out until it fits.
MODEL_BYTES = 64 << 20
ORDER, CHUNK = 3, 1 << 20
#: Contexts whose code lengths are computed at a time.
NODES = 2048
UNKNOWN = "und"


@dataclass
class Model:
    """`nodes2` and `nodes3` find the node of the longest known context; `cost` holds bits by language, node and byte class."""

    langs: list[str]
    classes: np.ndarray  # byte -> column of cost; the last column stands for each byte that no language has
    nodes2: np.ndarray
    nodes3: np.ndarray
    cost: np.ndarray

    def bits(self, parts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) for each language (columns).  A long text goes slice by slice, each after the bytes before it."""
        pad = b"\n" * ORDER
        if len(parts) == 1 and len(parts[0]) > CHUNK:
            text = parts[0]
            return sum(self._bits([text[i : i + CHUNK]], text[i - ORDER : i] if i else pad) for i in range(0, len(text), CHUNK))
        return self._bits(parts, pad)

    def _bits(self, parts: list[bytes], lead: bytes) -> np.ndarray:
        pad = b"\n" * ORDER
        buf = np.frombuffer(lead + pad.join(parts), np.uint8)
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        b = buf.astype(np.int32)
        node = self.nodes2[(b[1:-1] << 8) + b[2:]] if len(b) > 2 else np.zeros(0, np.int32)
        node = self.nodes3[b[:-3], node[:-1]]  # the context of byte i+3
        at = node * self.cost.shape[2] + self.classes[buf[ORDER:]]
        starts = np.cumsum(lens + ORDER) - lens - ORDER
        cuts = np.stack([starts, starts + lens], 1).ravel()
        out = np.zeros((len(parts), len(self.langs)))
        if not at.size:
            return out
        cuts = np.minimum(cuts, at.size)
        for k in range(len(self.langs)):
            bits = np.append(self.cost[k].ravel()[at], np.float32(0))
            out[:, k] = np.add.reduceat(bits, cuts, dtype=np.float64)[::2]
        out[lens == 0] = 0
        return out


def _contexts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context, byte) of each place of the texts, by order from 0 to ORDER."""
    pad = b"\n" * ORDER
    at = np.flatnonzero(np.concatenate([np.r_[np.zeros(ORDER, bool), np.ones(len(t), bool)] for t in texts]))
    b = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    byte, ctx = b[at].astype(np.int32), np.zeros(len(at), np.int32)
    for k in range(ORDER + 1):
        if k:
            ctx = ctx + (b[at - k].astype(np.int32) << (8 * (k - 1)))
        yield ctx, byte


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts, of several such lists."""
    values, at = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
    counts = np.zeros(len(values), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in found]))
    return values, counts


def train(samples: dict[str, list[bytes]]) -> Model | None:
    """Context trees of each language.  Contexts that the whole sample holds once only, and the rarest of those that would
    make the table larger than MODEL_BYTES, are left out, but for the empty one.  A context is at least as frequent as those
    that it ends, so what is left is closed under taking shorter contexts."""
    langs = sorted(k for k, v in samples.items() if any(v))
    if not langs:
        return None
    seen = np.zeros(256, bool)
    # distinct contexts of each order with their counts, by language; one language's sample is laid out at a time
    own_found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for lang in langs:
        for k, (ctx, byte) in enumerate(_contexts(samples[lang])):
            seen[byte] = True
            if k:
                own_found[k - 1].append(np.unique(ctx, return_counts=True))
    width = int(seen.sum()) + 1
    classes = np.full(256, width - 1, np.int32)
    classes[seen] = np.arange(width - 1)
    found = [_merged(own) for own in own_found]
    often = np.sort(np.concatenate([n for _, n in found]))[::-1]
    most = max(0, MODEL_BYTES // (4 * width * len(langs)) - 1)
    least = max(2, int(often[most]) + 1 if most < len(often) else 0)
    known = [np.zeros(1, np.int32), *(values[n >= least] for values, n in found)]
    first = np.cumsum([0, *map(len, known)])
    cost = np.zeros((len(langs), first[-1], width), np.float32)
    for i in range(len(langs)):
        rows = _contexts(samples[langs[i]])
        tail = before = None
        for k in range(ORDER + 1):
            ctx, byte = next(rows)
            node = np.searchsorted(known[k], ctx)
            ok = (node < len(known[k])) & (known[k][np.minimum(node, len(known[k]) - 1)] == ctx) if len(known[k]) else np.zeros(len(ctx), bool)
            count = np.bincount(node[ok] * width + classes[byte[ok]], minlength=len(known[k]) * width).reshape(-1, width).astype(np.float64)
            own, own_tail = np.zeros_like(count), np.zeros_like(count)
            if k:
                up = np.searchsorted(known[k - 1], known[k] & ((1 << (8 * (k - 1))) - 1)) if k > 1 else np.zeros(len(known[k]), np.int64)
            for at in range(0, len(count), NODES):
                part, here = slice(at, at + NODES), count[at : at + NODES]
                n, d, has = here.sum(1, keepdims=True), (here > 0).sum(1, keepdims=True), here > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    if not k:
                        own_tail[:] = np.log2(max(1, 256 - int(d[0, 0])))
                        escape = np.where(d < 256, -np.log2(d / (n + d)), 0)
                        own[part] = np.where(has, -np.log2(here / np.where(d < 256, n + d, n)), escape + own_tail)
                    else:
                        above, above_tail = before[0][up[part]], tail[up[part]]
                        left = np.where(has, 0, above)
                        ln, ld = left.sum(1, keepdims=True), (left > 0).sum(1, keepdims=True)
                        lost = np.where(left > 0, -np.log2(left / (ln + ld)), np.where(ld > 0, -np.log2(ld / (ln + ld)), 0) + above_tail)
                        own[part] = np.where(n > 0, np.where(has, -np.log2(here / (n + d)), -np.log2(d / (n + d)) + lost), before[1][up[part]])
                        own_tail[part] = lost
            tail, before = own_tail, (count, own)
            cost[i, first[k] : first[k + 1]] = own
    nodes2 = np.zeros(65536, np.int32)
    one = np.zeros(256, np.int32)
    one[known[1]] = first[1] + np.arange(len(known[1]))
    nodes2[:] = np.tile(one, 256)
    nodes2[known[2]] = first[2] + np.arange(len(known[2]))
    nodes3 = np.tile(np.arange(first[3], dtype=np.int32), (256, 1))
    low = nodes2[known[3] & 0xFFFF]
    nodes3[known[3] >> 16, low] = first[3] + np.arange(len(known[3]))
    # nodes2 is addressed by (second last << 8) + last byte
    return Model(langs, classes, nodes2, nodes3, cost)


def sample(docs: DataFrame, usable: Column) -> dict[str, list[bytes]]:
    """A bounded sample of labelled texts: of each language SAMPLE_BYTES at most, and its part of TOTAL_BYTES.  Copies of a text
    count once.  A text that is longer than the bound gives a stretch of it, from a place that its hash tells."""
    rows = slim(docs, "text", "lang").where(usable & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = rows.select("lang", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"), "text")
    sizes = stored(rows.groupBy("lang", "h").agg(F.first("n").alias("n")).groupBy("lang").agg(F.sum(F.least("n", F.lit(TEXT_BYTES))).alias("bytes")), "languages")
    count = sizes.count()
    if not count:
        return {}
    each = max(64, min(SAMPLE_BYTES, TOTAL_BYTES // count))
    piece = min(TEXT_BYTES, each) // 4  # characters, of 4 bytes at most
    draw = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    # all copies of a text are drawn together: one of them comes to the driver
    wanted = rows.join(sizes, "lang").where(draw < F.lit(1.2 * each) / F.col("bytes"))
    start = F.pmod(F.xxhash64("h"), F.length("text") - piece + 1).cast("int") + 1
    part = F.when(F.col("n") <= min(TEXT_BYTES, each), F.col("text")).otherwise(F.substr("text", start, F.lit(piece)))
    got = wanted.select("lang", part.alias("text"), "h").dropDuplicates(["lang", "h"])
    out: dict[str, list[bytes]] = {}
    used: dict[str, int] = {}
    for r in sorted(got.toLocalIterator(), key=lambda r: (r["lang"], r["h"], r["text"])):
        t = r["text"].encode()
        if used.get(r["lang"], 0) + len(t) <= each:
            used[r["lang"]] = used.get(r["lang"], 0) + len(t)
            out.setdefault(r["lang"], []).append(t)
    return out


def predict(docs: DataFrame, usable: Column, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """`keep` columns and, under `names`, lang_pred, score (the share of the best language among all, by code length) and bits_per_byte.

    Texts that are null or hold no letter: `und`, score 0, null bits.  Without any labelled text all are `und`.
    """
    model = train(sample(docs, usable))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample's bounds
    whole, letter = free(keep, "text", "letters")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(whole), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letter))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(names[0], "string").add(names[1], "double").add(names[2], "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            letters = batch.column(len(keep) + 1).to_numpy(zero_copy_only=False).astype(bool)
            at, data = buffers(column)
            n = len(column)
            lang, best, rate = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, np.nan)
            for i, j in chunks(column, CHUNK) if m else ():
                bits = m.bits([bytes(data[at[k] : at[k + 1]]) for k in range(i, j)])
                ok, low = letters[i:j], bits.min(1)
                share = 1 / np.exp2(-np.minimum(bits - low[:, None], 1000)).sum(1)
                lang[i:j] = np.where(ok, np.array(m.langs, object)[bits.argmin(1)], UNKNOWN)
                best[i:j] = np.where(ok, share, 0)
                rate[i:j] = np.where(ok, low / np.maximum(1, at[i + 1 : j + 1] - at[i:j]), np.nan)
            cols = [batch.column(k) for k in range(len(keep))] + [pa.array(lang, pa.string()), pa.array(best), pa.array(rate, mask=np.isnan(rate))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    return arrow_map(rows, score, schema)


def in_training(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text leaves another remainder than 2 by 4; those without an id do not train."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row, repeated rows included; an empty table gives none."""
    out = predict(docs, in_training(F.col("doc_id")), ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def stage(docs: DataFrame) -> DataFrame:
    """Documents in some language: those that are `und`, or that no language codes in fewer than 8 bits a byte, go.

    So null texts, and texts without a letter, go; repeated rows stay or go together; no rows in, none out; without any
    labelled text all go."""
    keep = docs.columns
    lang, score, rate = free(keep, "lang_pred", "score", "bits_per_byte")
    found = predict(docs, in_training(F.col("doc_id")), keep, (lang, score, rate))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(rate) < 8)).select(*[F.col(f"`{c}`") for c in keep])
