"""Byte-level BPE by a sentencepiece model that is written straight from a vocabulary of ranked byte strings.

The model is a protocol buffer: one piece for each token, its bytes mapped to printable characters one by one, scored by
its negative rank; an unknown piece after them; identity normalisation, no dummy prefix, no escaped white space.  BPE then
merges the neighbours whose joint piece has the least rank, as the rank file asks.  Pieces' places are the ranks.
Texts are split by the public pattern and each pre-token is encoded by itself; decoding maps each id back to its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import arrow_map, chunks, slim
from .pretokens import Pieces, split

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK = 1 << 21


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, k = [], 0
    for b in range(256):
        out.append(chr(b) if b in own else chr(256 + k))
        k += b not in own
    return out


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        ranked = {int(n): base64.b64decode(b) for b, n in (line.split() for line in f if line.strip())}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks must run from 0 without gaps")
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(tag: int, payload: bytes) -> bytes:
    return _varint(tag << 3 | 2) + _varint(len(payload)) + payload


def _number(tag: int, n: int) -> bytes:
    return _varint(tag << 3) + _varint(n)


def serialise(tokens: list[bytes]) -> bytes:
    """ModelProto of the pieces, then `<unk>`; types: 1 normal, 2 unknown; trainer model type 2: BPE."""
    chars = byte_chars()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -r) + _number(3, 1)) for r, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", -len(tokens)) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(24, 0) + _number(40, len(tokens)) + b"".join(_varint(t << 3) + b"\xff" * 9 + b"\x01" for t in (41, 42, 43))
    normalizer = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.chars = str.maketrans(dict(enumerate(byte_chars())))

    def ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each pre-token; one that is a token itself is that token."""
        raw = [p.encode() for p in pieces]
        got = self.sp.encode([r.decode("latin-1").translate(self.chars) for r in raw], num_threads=1)
        whole = self.whole.get
        return [[w] if (w := whole(r)) is not None else g for r, g in zip(raw, got, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def entries(self, pieces: list[str]) -> Iterator[tuple[bytes, int, bytes]]:
        """For the cache: decimal ids joined by commas, their number, the bytes that they decode to."""
        for ids in self.ids(pieces):
            yield ",".join(map(str, ids)).encode(), len(ids), self.decode(ids)


_codecs: dict[str, tuple[Codec, Pieces]] = {}


def _codec(path: str) -> tuple[Codec, Pieces]:
    if path not in _codecs:
        c = Codec(path)
        _codecs[path] = c, Pieces(c.entries)
    return _codecs[path]


def _digest(text: str, cache: Pieces) -> tuple[int, str, str, str]:
    """Number of ids, SHA-256 of ids and of decoded bytes, the decoded text; texts go by CHUNK characters of pieces."""
    n, ids, out, first = 0, hashlib.sha256(), hashlib.sha256(), True
    pieces = split(text)
    for i in range(0, len(pieces), CHUNK):
        a, b, c = zip(*cache.of(pieces[i : i + CHUNK]), strict=True)
        n += sum(b)
        ids.update((b"" if first else b",") + b",".join(a))
        out.update(b"".join(c))
        first = False
    return n, ids.hexdigest(), out.hexdigest()


def roundtrip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text counts as empty: no ids, digests of nothing."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache = _codec(path)
        for batch in batches:
            column, rows = batch.column(1), []
            for i, j in chunks(column, CHUNK):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                split_ = [split(t) for t in texts]
                if (size := sum(map(len, split_))) > CHUNK:
                    rows += [_digest(t, cache) for t in texts]
                    continue
                got, at = cache.of([p for ps in split_ for p in ps]), 0
                assert len(got) == size
                for ps in split_:
                    own = got[at : at + len(ps)]
                    at += len(ps)
                    rows.append((sum([x[1] for x in own]), hashlib.sha256(b",".join([x[0] for x in own])).hexdigest(), hashlib.sha256(b"".join([x[2] for x in own])).hexdigest()))
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(slim(docs, "doc_id", "text"), run, docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of every row."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = _codec(path)
        for batch in batches:
            ids = [[i for p in codec.ids(split(t or "")) for i in p] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return arrow_map(slim(docs, "doc_id", "text"), run, docs.select("doc_id").schema.add("ids", ArrayType(IntegerType())))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from the table that `encode` gives; null ids give a null text."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = _codec(path)
        for batch in batches:
            out = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", F.col("ids")), run, encoded.select("doc_id").schema.add("text", "string"))
