"""Token ids in compressed blocks: an adaptive context-mixing range coder.

File format.  A store is a Parquet folder (so Spark's commit protocol covers lost executors).  A part (parts in ascending order of doc_id)
is a run of rows, numbered by `block` from 0: groups of LANES blocks or fewer, each group after its head.  A block holds BLOCK ids or fewer: `n`,
`crc` (crc32 of the ids as little-endian unsigned 32-bit integers) and `payload`.  A head (`n` is HEAD) holds the shares of ids of its group and its guesses,
deflated, with their own crc32, and lists in `ids` the documents that begin after the last head: `doc_id`, `n`.
Blocks know nothing of each other: each starts from the same state, so any block can be read with its group's head alone.

Model of a block.  Two tables of its group, of which the head has the entries that were met often enough, hold the id that follows the last id
(order 1) and the last two ids (order 2) most often, each with a confidence from 0 to 3: how often it does.  How much weight each prediction gets
is learned within the block: for every pair of confidences, the adaptive shares of "order 2 right", "order 1 right", "neither" are the
mixing weights.  If neither is right, the order-0 model codes the id by its count in the group.  Both choices narrow a carry-propagating range
coder once, with 64-bit state and 32-bit words.  Blocks are coded side by side, one vector operation for all blocks of a group at a time; the
writer, who has all ids, looks guesses up for many steps at once.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, buffers, chunks, scratch, slim
from .pretokens import starts

VOCABULARY, END = "byte_bpe_50k.json", 2
BLOCK, LANES, LONGEST = 1024, 8192, 4096
#: Bytes of texts that are tokenised at once (a longer text stands alone), and how many of their pieces are.
TEXTS, CHUNK = 1 << 22, 1 << 21
#: Pieces that the library is given in one text.
JOINED = 256
#: A choice among the three has one of _KINDS parts, LEAST at least; an id without a right guess one of _TOTAL of its own; shares move by 1/2**RATE.
_KINDS, _TOTAL, LEAST, RATE = 1 << 12, 1 << 16, 2, 5
_SPAN = (_KINDS - 3 * LEAST) << 4
#: Pairs of ids share so many places for their guess; a guess needs a place met so often; steps whose guesses the writer looks up at once.
SLOTS, OFTEN, STEPS = 1 << 16, 4, 16
_TOP, _WORD, _PARTS, _LAST, _ALL = np.uint64(1 << 32), np.uint64(32), np.uint64(28), np.uint64((1 << 28) - 1), np.uint64((1 << 64) - 1)
_LOW, _RIGHT = np.uint64((1 << 32) - 1), np.array([[1], [2]])


def _slots(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where the guess stands that follows two ids, of 32 bits without sign."""
    out = last * np.uint32(40503)
    out += before * np.uint32(60493)
    out >>= np.uint32(8)
    out &= np.uint32(SLOTS - 1)
    return out


class _Mix:
    """Weights of all lanes; both sides drive them in the same order.  Arrays of two rows hold something for "order 2 right", then for "either right"."""

    def __init__(self, lanes: int):
        self.shares = np.repeat(np.array([_SPAN // 4, _SPAN // 2], np.int32), lanes * 16)
        self.least, self.rows = np.array([[LEAST], [2 * LEAST]], np.int32), np.array([[0], [lanes * 16]]) + np.arange(lanes) * 16
        self.edges = np.zeros((4, lanes), np.int32)  # of the three kinds, of _KINDS parts
        self.edges[3], self.lane, self.n = _KINDS, np.arange(lanes), lanes

    def look(self, pair: np.ndarray) -> None:
        """`pair`: of confidences, 0 to 15."""
        self.at = self.rows + pair
        self.held = self.shares.take(self.at)
        np.add(self.held >> 4, self.least, out=self.edges[1:3])

    def part(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the share of each lane's kind begins (0: order 2 right, 1: order 1 right, 2: neither), and its size."""
        at = self.lane + kind * np.int64(self.n)
        low = self.edges.take(at)
        return low, self.edges.take(at + self.n) - low

    def learn(self, kind: np.ndarray) -> None:
        self.shares[self.at] = self.held + (((kind < _RIGHT) * np.int32(_SPAN) - self.held) >> RATE)


class Shares:
    """What a group of blocks knows: each id's share of 2**16, by its count in the group (without counts, one part each), and its guesses.

    `guess`: id * 4 + confidence that follows each id, then that of each place of pairs; where there is none, an id is to follow itself, and a pair 0.
    """

    NONE = np.append(np.arange(_TOTAL, dtype=np.int32) << 2, np.zeros(SLOTS, np.int32))

    def __init__(self, size: np.ndarray | None = None, guess: np.ndarray | None = None):
        self.size = np.ones(_TOTAL, np.int64) if size is None else size.astype(np.int64)
        if len(self.size) != _TOTAL or self.size.sum() != _TOTAL:
            raise ValueError(f"shares of {_TOTAL} ids must sum to {_TOTAL}")
        self.guess = self.NONE if guess is None else guess
        # one more part and id stand for a right guess: it takes the whole of its choice
        whole = np.append(self.size, _TOTAL).astype(np.int32)
        self.whole, self.start = whole, np.append(np.cumsum(self.size) - self.size, 0).astype(np.int32)
        self.owner = np.repeat(np.arange(_TOTAL + 1, dtype=np.int32), np.append(self.size, 1))

    @classmethod
    def of(cls, ids: np.ndarray) -> Shares:
        """An id that occurs has one part at least."""
        counts = np.bincount(ids, minlength=_TOTAL)
        if len(counts) > _TOTAL:
            raise ValueError("ids must be in 0 to 65535")
        if not counts.any():
            return cls()
        size = (counts > 0) + counts * (_TOTAL - np.count_nonzero(counts)) // counts.sum()
        size[counts.argmax()] += _TOTAL - size.sum()
        ids, guess = ids.astype(np.uint32, copy=False), cls.NONE.copy()
        cls._most(ids[:-1], ids[1:], guess[:_TOTAL])
        cls._most(_slots(ids[1:-1], ids[:-2]), ids[2:], guess[_TOTAL:])
        return cls(size, guess)

    @staticmethod
    def _most(place: np.ndarray, after: np.ndarray, guess: np.ndarray) -> None:
        """For each place met at least OFTEN times the id most often after it, by how large a part: under 1/8, 1/4, 1/2, or more."""
        if not len(place):
            return
        pairs = place << np.uint32(16)
        pairs |= after
        pairs.sort()
        begin = np.concatenate(([0], np.flatnonzero(pairs[1:] != pairs[:-1]) + 1, [len(pairs)]))
        pairs, n = pairs[begin[:-1]], begin[1:] - begin[:-1]
        begin = np.append(0, np.flatnonzero((pairs[1:] ^ pairs[:-1]) >= _TOTAL) + 1)
        pairs = pairs.astype(np.int64)
        every, best = np.add.reduceat(n, begin), np.maximum.reduceat(n << 16 | pairs & 0xFFFF, begin)
        most = best >> 16
        sure = (8 * most >= every) * 1 + (4 * most >= every) + (2 * most >= every)
        often = every >= OFTEN
        guess[(pairs[begin] >> 16)[often]] = ((best & 0xFFFF) << 2 | sure)[often]

    def dump(self) -> bytes:
        sure, ids = self.guess & 3, (self.guess >> 2) - (self.NONE >> 2) & 0xFFFF
        return zlib.compress(self.size.astype("<u4").tobytes() + ids.astype("<u2").tobytes() + sure.astype(np.uint8).tobytes(), 1)

    @classmethod
    def load(cls, data: bytes) -> Shares:
        data, n = zlib.decompress(data), len(cls.NONE)
        if len(data) != 4 * _TOTAL + 3 * n:
            raise ValueError("a head of another length")
        ids = (np.frombuffer(data, "<u2", n, 4 * _TOTAL) + (cls.NONE >> 2)) & 0xFFFF
        return cls(np.frombuffer(data, "<u4", _TOTAL), (ids << 2 | np.frombuffer(data, np.uint8, n, 4 * _TOTAL + 2 * n)).astype(np.int32))


class _Out:
    """Words stand in the order in which lanes gave them; a carry waits in the upper half of its lane's last word."""

    def __init__(self, lanes: int):
        self.words, self.lanes, self.n = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, np.int32), 0
        self.lowest, self.range, self.last = np.zeros(lanes, np.uint64), np.full(lanes, _ALL), np.zeros(lanes, np.int64)

    def put(self, start: np.ndarray, size: np.ndarray, on: int) -> None:
        """Narrow the first `on` lanes to their shares, of 2**28 parts."""
        low, rng = self.lowest[:on], self.range[:on]
        r = rng >> _PARTS
        more = r * start[:on].astype(np.uint64)
        low += more
        if (over := np.flatnonzero(low < more)).size:
            self.words[self.last[over]] += np.uint64(1)
        np.multiply(r, size[:on].astype(np.uint64), out=rng)
        if (short := np.flatnonzero(rng < _TOP)).size:
            x = low[short]
            self._write(short, x >> _WORD)
            low[short] = x << _WORD
            rng[short] <<= _WORD

    def _write(self, lanes: np.ndarray, words: np.ndarray) -> None:
        at, self.n = self.n, self.n + len(lanes)
        if self.n > len(self.words):
            self.words, self.lanes = np.append(self.words, np.zeros_like(self.words)), np.append(self.lanes, np.zeros_like(self.lanes))
        self.words[at : self.n], self.lanes[at : self.n] = words, lanes
        self.last[lanes] = np.arange(at, self.n)

    def ends(self) -> list[bytes]:
        every = np.arange(len(self.lowest))
        for shift in (32, 0):
            self._write(every, self.lowest >> np.uint64(shift) & _LOW)
        order = np.argsort(self.lanes[: self.n], kind="stable")
        words, sizes = self.words[order], np.bincount(self.lanes[: self.n])
        while (over := np.flatnonzero(words > _LOW)).size:  # never a lane's first word
            words[over] &= _LOW
            words[over - 1] += np.uint64(1)
        data, ends = words.astype("<u4"), np.cumsum(sizes).tolist()
        return [data[e - n : e].tobytes() for e, n in zip(ends, sizes.tolist(), strict=True)]


def _running(sizes: list[int]) -> np.ndarray:
    """How many lanes still run at each step; sizes descend."""
    return np.searchsorted(-np.array(sizes), -np.arange(sizes[0]), side="left")


def pack(blocks: list[np.ndarray], shares: Shares | None = None) -> list[bytes]:
    """Payloads of blocks of at most LONGEST ids.  Longer blocks come first within a batch, so that lanes that have ended are the last."""
    shares = shares or Shares()
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    if blocks and len(blocks[order[0]]) > LONGEST:
        raise ValueError(f"blocks hold {LONGEST} ids at most")
    for i in range(0, len(order), LANES):
        part = order[i : i + LANES]
        most = len(blocks[part[0]])
        fill = int(shares.size.argmax())  # of lanes that have ended
        ids = np.full((most + 2, len(part)), fill, np.int32)
        ids[:2] = 0  # before the first
        for k, p in enumerate(part):
            if len(b := blocks[p]) and (b.min() < 0 or b.max() >= _TOTAL):
                raise ValueError("ids must be in 0 to 65535")
            if not shares.size[b].all():
                raise ValueError("an id without a share")
            ids[2 : len(b) + 2, k] = b
        m, o = _Mix(len(part)), _Out(len(part))
        live = _running([len(blocks[p]) for p in part]).tolist()
        for t in range(0, most, STEPS):
            x = ids[t + 2 : min(t + STEPS, most) + 2]
            last, before = (ids[t + k : t + k + len(x)].view(np.uint32) for k in (1, 0))
            one, two = shares.guess.take(last), shares.guess.take(_slots(last, before) + np.uint32(_TOTAL))
            kind = np.where(two >> 2 == x, 0, np.where(one >> 2 == x, 1, 2))
            own = np.where(kind < 2, _TOTAL, x)
            start, whole, pair = shares.start.take(own), shares.whole.take(own), (two & 3) * 4 + (one & 3)
            for k in range(len(x)):
                m.look(pair[k])
                low, part_ = m.part(kind[k])
                o.put((low << 16) + part_ * start[k], part_ * whole[k], live[t + k])
                m.learn(kind[k])
        for p, payload in zip(part, o.ends(), strict=True):
            out[p] = payload
    return out


class _In:
    def __init__(self, payloads: list[bytes]):
        n = max(map(len, payloads)) // 4 + 3
        self.words, self.rows = np.zeros((len(payloads), n), np.uint32), np.arange(len(payloads))
        for k, p in enumerate(payloads):
            self.words[k, : len(p) // 4] = np.frombuffer(p, "<u4")
        w = self.words[:, :2].astype(np.uint64)
        self.code = (w[:, 0] << _WORD) | w[:, 1]
        self.at, self.range, self.end = np.full(len(payloads), 2), np.full(len(payloads), _ALL), n - 1

    def peek(self) -> np.ndarray:
        """Which of 2**28 parts the code lies in."""
        self.r = self.range >> _PARTS
        return np.minimum(self.code // self.r, _LAST).astype(np.int32)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        self.code -= self.r * start.astype(np.uint64)
        np.multiply(self.r, size.astype(np.uint64), out=self.range)
        if (short := np.flatnonzero(self.range < _TOP)).size:
            at = self.at[short]
            self.code[short] = (self.code[short] << _WORD) | self.words[short, np.minimum(at, self.end)]
            self.at[short] = at + 1
            self.range[short] <<= _WORD


def unpack(payloads: list[bytes], sizes: list[int], shares: Shares | None = None) -> list[np.ndarray]:
    shares = shares or Shares()
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(payloads)
    order = sorted(range(len(payloads)), key=lambda k: -sizes[k])
    for i in range(0, len(order), LANES):
        part = order[i : i + LANES]
        most = sizes[part[0]]
        m, src = _Mix(len(part)), _In([payloads[p] for p in part])
        ids = np.zeros((most, len(part)), np.int32)
        last, before, at = np.zeros(len(part), np.uint32), np.zeros(len(part), np.uint32), np.zeros((2, len(part)), np.int64)
        for t in range(most):  # lanes that have ended run on, over zeros, and nothing reads what they give
            at[0] = last
            np.add(_slots(last, before), _TOTAL, out=at[1])
            held = shares.guess.take(at)
            (one, two), sure = held >> 2, held & 3
            m.look(sure[1] * 4 + sure[0])
            v = src.peek()
            past1, past2 = (v >> 16 >= m.edges[1:3]).view(np.int8)
            kind = past1 + past2
            low, part_ = m.part(kind)
            first, any_ = low << 16, kind < 2
            new = shares.owner.take(np.where(any_, _TOTAL, ((v - first) / part_).astype(np.int64)))  # 28 bits by 12: exact
            src.take(first + part_ * shares.start.take(new), part_ * shares.whole.take(new))
            x = ids[t] = np.where(any_, np.where(kind < 1, two, one), new)
            m.learn(kind)
            last, before = x.view(np.uint32), last
        for k, p in enumerate(part):
            out[p] = ids[: sizes[p], k].copy()
    return out


class Known:
    """Ids of the pieces met so far, one after another in one array; most are forgotten once there are over `most`, or they hold over `room` bytes."""

    def __init__(self, path: str, most: int = 700_000, room: int = 1 << 25):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, "rb") as f:
            held = json.load(f)
        how = held.get("pre_tokenizer") or {}
        if held.get("normalizer") or held.get("post_processor") or how.get("type") != "ByteLevel" or how.get("add_prefix_space") or not how.get("use_regex"):
            raise ValueError(f"{path}: texts are not cut by the public pattern alone")
        self.most, self.room, self.added = most, room, Added(path).tokens
        # the library's own way with a piece, but pieces come cut and spelt as its pre-tokenizer would have them, with a line feed between them
        self.lib = Tokenizer.from_file(path)
        self.lib.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        vocabulary = self.lib.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelt = np.zeros(256, "<u4")
        self.spelt[plain] = plain
        rest = np.setdiff1d(np.arange(256), plain)
        self.spelt[rest] = 256 + np.arange(len(rest))
        self.clear()

    def clear(self) -> None:
        """Place 0 is that of END."""
        self.at: dict[bytes, int] = {}
        self.first, self.size, self.ids, self.met, self.held = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([END], "<u4"), np.zeros(1, np.int32), 0
        for token in self.added:
            self._add([token.encode()], np.array([self.lib.token_to_id(token)], "<u4"), np.ones(1, np.int64))

    def trim(self) -> None:
        """Only pieces that were asked for twice or more stay, if they are no more than half."""
        if len(self.at) <= self.most and self.held <= self.room:
            return
        kept = np.flatnonzero(self.met[1:] > 1) + 1
        pieces, size = list(self.at), self.size[kept]  # in the order of their places
        ids = self.ids[np.repeat(self.first[kept] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        pieces = [pieces[k - 1] for k in kept.tolist()]
        self.clear()
        if 2 * len(pieces) <= self.most and 2 * (sum(map(len, pieces)) + 4 * len(ids)) <= self.room:
            new = [k for k, x in enumerate(pieces) if x not in self.at]  # tokens are there again
            if len(new) < len(pieces):
                stay = np.zeros(len(pieces), bool)
                stay[new] = True
                ids, size, pieces = ids[np.repeat(stay, size)], size[stay], [pieces[k] for k in new]
            self._add(pieces, ids, size)

    def _add(self, pieces: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.at.update(zip(pieces, range(len(self.size), len(self.size) + len(pieces)), strict=True))
        self.first = np.append(self.first, len(self.ids) + np.cumsum(size) - size)
        self.met = np.append(self.met, np.zeros(len(pieces), np.int32))
        self.size, self.ids, self.held = np.append(self.size, size), np.append(self.ids, ids), self.held + sum(map(len, pieces)) + 4 * len(ids)

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where each of these different pieces stands."""
        ends, data = buffers(pieces)
        ends, data = ends.tolist(), bytes(data)
        keys = [data[i:j] for i, j in itertools.pairwise(ends)]
        out = np.fromiter(map(self.at.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        if (new := np.flatnonzero(out < 0)).size:
            asked = [keys[k] for k in new.tolist()]
            out[new] = np.arange(len(new)) + len(self.size)
            self._add(asked, *self._encode(asked))
        self.met[out] += 1
        return out

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each piece has: its bytes end where those of its last id end."""
        end = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        spelt = self.spelt[np.frombuffer(b"".join(pieces), np.uint8)]
        text = np.insert(spelt, end[:-1], 10).tobytes().decode("utf-32-le")
        at = [0, *(end + np.arange(1, len(end) + 1)).tolist()]
        runs = [text[at[k] : at[min(k + JOINED, len(pieces))] - 1] for k in range(0, len(pieces), JOINED)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.lib.encode_batch_fast(runs, add_special_tokens=False)])
        so_far = np.cumsum(self.bytes[ids])
        last = np.searchsorted(so_far, end)
        if len(so_far) and so_far[-1] == end[-1] and np.array_equal(so_far[last], end):
            return ids, np.diff(last, prepend=-1)
        # the vocabulary leaves some bytes out
        alone = [np.array(e.ids, "<u4") for e in self.lib.encode_batch_fast(text.split("\n"), add_special_tokens=False)]
        return np.concatenate(alone), np.array(list(map(len, alone)), np.int64)


_tokenizers: dict[str, Known] = {}


def _pieces(path: str) -> Known:
    """This process's ids of pieces."""
    if path not in _tokenizers:
        _tokenizers[path] = Known(path)
    return _tokenizers[path]


class Added:
    """Tokens that stand beside the merges: wherever a text holds one's string, the library cuts there and gives its id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            found = json.load(f).get("added_tokens") or []
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in found):
            raise ValueError(f"{path}: an added token with conditions of its own")
        self.tokens = sorted((x["content"] for x in found), key=len, reverse=True)
        self.any = re.compile(b"|".join(re.escape(t.encode()) for t in self.tokens)) if found else None

    def within(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where tokens begin and end, a row each; texts begin and end `at`."""
        if not self.any or not self.any.search(data):
            return np.zeros((0, 2), np.int64)
        return np.array([(i + m.start(), i + m.end()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for m in self.any.finditer(data[i:j])], np.int64).reshape(-1, 2)


def encoded(column: pa.Array, cache: Known, added: Added, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after another, and how many each has; with `end`, END follows each."""
    at, data = buffers(column)
    data, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
    tokens = added.within(data, at)
    begin = np.unique(np.append(at[:-1], tokens))
    cut = starts(data, begin[begin < len(data)])
    if len(tokens):
        inside = np.zeros(len(cut) + 1, np.int64)
        np.add.at(inside, np.searchsorted(cut, tokens[:, 0], side="right"), 1)
        np.add.at(inside, np.searchsorted(cut, tokens[:, 1]), -1)
        cut = cut[np.cumsum(inside[:-1]) == 0]
    cache.trim()
    of, places = np.searchsorted(cut, at), [np.zeros(0, np.int64)]
    offsets, whole = np.append(cut, len(data)).astype(np.int32), pa.py_buffer(data)
    for i in range(0, len(cut), CHUNK):
        n = min(CHUNK, len(cut) - i)
        part = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets[i : i + n + 1]), whole]).dictionary_encode()
        places.append(cache.places(part.dictionary)[part.indices.to_numpy()])
    place = np.concatenate(places)
    if end:
        place, of = np.insert(place, of[1:], 0), of + np.arange(len(of))
    size = cache.size[place]
    so_far = np.append(0, np.cumsum(size))
    ids = cache.ids[np.repeat(cache.first[place] - so_far[:-1], size) + np.arange(so_far[-1])]
    return ids, np.diff(so_far[of])


def tokenise(text_list: list[str], cache: Known, added: Added) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    ids, sizes = encoded(pa.array(text_list, pa.large_string()), cache, added)
    return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if text_list else []


#: What a head has for a number of ids.
HEAD = -1
BLOCKS = "part int, block long, n int, crc long, payload binary, ids array<struct<doc_id: {}, n: long>>"


def write(docs: DataFrame, where: str, path: str | None = None, parts: int | None = None) -> None:
    """Encode every text (null: empty), append END, write blocks under `where`; rows without an id come last."""
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, cache = TaskContext.get().partitionId(), 0, _pieces(path)
        added, id_type = Added(path), pa.int64()
        held, size, own = [], 0, []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, block, own  # id_type too is that of the last batch
            flat = np.concatenate([np.zeros(0, "<u4"), *held])
            n = len(flat) if last else len(flat) // BLOCK * BLOCK
            cut = [flat[i : min(i + BLOCK, n)] for i in range(0, n, BLOCK)]
            held, size = [flat[n:].copy()], len(flat) - n
            for i in range(0, len(cut), LANES):
                group = cut[i : i + LANES]
                shares = Shares.of(flat[i * BLOCK : min((i + LANES) * BLOCK, n)])
                rows = [shares.dump(), *pack(group, shares)]
                docs_ = [own] + [[]] * len(group)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.int32()), pa.array(range(block, block + len(rows)), pa.int64()), pa.array([HEAD, *map(len, group)], pa.int32()),
                     pa.array([zlib.crc32(rows[0]), *(zlib.crc32(c.tobytes()) for c in group)], pa.int64()), pa.array(rows, pa.binary()),
                     pa.array([[{"doc_id": a, "n": b} for a, b in d] for d in docs_], pa.list_(pa.struct([("doc_id", id_type), ("n", pa.int64())])))],
                    names=["part", "block", "n", "crc", "payload", "ids"],
                )
                block, own = block + len(rows), []

        for batch in batches:
            column, id_type = batch.column(1), batch.column(0).type
            doc_ids = batch.column(0).to_pylist()
            for i, j in chunks(column, TEXTS):
                ids, sizes = encoded(column.slice(i, j - i), cache, added, end=True)
                held.append(ids)
                own.extend(zip(doc_ids[i:j], sizes.tolist(), strict=True))
                size += len(ids)
                if size >= LANES * BLOCK:
                    yield from blocks(False)
        yield from blocks(True)

    rows = slim(docs, "doc_id", "text")
    spread = rows.repartitionByRange(*([parts] if parts else []), F.asc_nulls_last("doc_id")).sortWithinPartitions(F.asc_nulls_last("doc_id"))
    arrow_map(spread, run, BLOCKS.format(kind)).write.parquet(where)


def read(spark: SparkSession, where: str) -> DataFrame:
    """Documents of a store: part, doc_id, first (ids of the part before it), n_tokens, ids_crc32.  Checks every block.

    Blocks of a part go through one task in order; parts are as many as the writer dealt.
    """
    rows = spark.read.parquet(where)
    kind = rows.schema["ids"].dataType.elementType["doc_id"].dataType
    schema = f"part int, doc_id {kind.simpleString()}, first long, n_tokens long, ids_crc32 long"

    def checked(row: tuple, data: bytes) -> bytes:
        if zlib.crc32(data) != row[3]:
            raise ValueError(f"part {row[0]}, block {row[1]}: its checksum does not fit")
        return data

    def decoded(rows: list[tuple]) -> Iterator[tuple]:
        """Of a group: its head, then its blocks."""
        if not rows:
            return
        head, *blocks = rows
        if head[2] != HEAD:
            raise ValueError(f"part {head[0]}, block {head[1]}: the head of its group is missing")
        shares = Shares.load(checked(head, head[4]))
        yield head, b""
        for r, ids in zip(blocks, unpack([r[4] for r in blocks], [r[2] for r in blocks], shares), strict=True):
            yield r, checked(r, ids.astype("<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, queue, out = None, 0, [], []
        want: deque[tuple] = deque()
        got = crc = 0

        def flush(full: bool) -> Iterator[pa.RecordBatch]:
            nonlocal part, first, got, crc, queue, out
            for r, data in decoded(queue):
                if r[0] != part:
                    part, first, got, crc = r[0], 0, 0, 0
                    want.clear()
                want.extend((d["doc_id"], d["n"]) for d in r[5])
                at, data = 0, memoryview(data)
                while want:
                    doc_id, n = want[0]
                    end = min(len(data), at + 4 * (n - got))
                    crc, got, at = zlib.crc32(data[at:end], crc), got + (end - at) // 4, end
                    if got < n:
                        break
                    out.append((part, doc_id, first, n, crc))
                    want.popleft()
                    first, got, crc = first + n, 0, 0
            queue = []
            if out and (full or len(out) > 5000):
                kinds = (pa.int32(), to_arrow_type(kind), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "doc_id", "first", "n_tokens", "ids_crc32"])
                out = []

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[2] == HEAD:
                    yield from flush(False)
                queue.append(row)
        yield from flush(True)

    parts = max(1, rows.select("part").distinct().count())
    return rows.repartitionByRange(parts, "part").sortWithinPartitions("part", "block").mapInArrow(run, schema)


def store_and_read(docs: DataFrame, where: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from the store written to `where` (a new shared folder, if not given).

    Rows that repeat an id follow each other; a row without an id stands last.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    where = where or scratch(spark, "tokens")
    write(docs, where)
    found = read(spark, where)
    # one row a part, of which there are as many as the writer's partitions
    sums = [(r["part"], r["n"]) for r in spark.read.parquet(where).where(F.col("n") != HEAD).groupBy("part").agg(F.sum("n").alias("n")).collect()]
    before, rows = 0, []
    for part, n in sorted(sums):
        rows.append((part, before))
        before += n
    offsets = spark.createDataFrame(rows, "part int, before long")
    return found.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
