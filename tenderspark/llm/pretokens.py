"""Splitting text before byte-level merges, and a bounded cache of what each piece becomes."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable

import numpy as np
import public_tokenizers
import regex

_SPACE = r"\t-\r \x85\xa0"
_LETTER = "A-Za-z" + "".join(chr(c) for c in range(128, 256) if regex.match(r"\p{L}", chr(c)))
_NUMBER = "0-9" + "".join(chr(c) for c in range(128, 256) if regex.match(r"\p{N}", chr(c)))
_ANY = regex.compile(public_tokenizers.PATTERN)
#: The same pattern for texts below U+0100, where its classes can be written out for the faster engine.
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def split(text: str) -> list[str]:
    """All matches of the public pattern; they cover the text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ANY.findall(text)
    return _LATIN.findall(text)


@functools.cache
def _kinds() -> np.ndarray:
    """Of every code point: 0 for a space, 1 for a letter, 2 for a number, 3 for others."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = np.full(0x110000, 3, np.uint8)
    for k, of in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for m in regex.finditer(of, every):
            out[m.start() : m.end()] = k
    return out


def starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the matches of the public pattern begin in texts that stand end to end, all at once.

    `data`: their UTF-8 bytes; `texts`: where each begins, from 0; none is empty.  A match begins where the kind of
    character changes, but for a blank, which goes with what follows, and at the last of several spaces before something else."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kinds = _kinds()
    kind = np.frombuffer(bytearray(data).translate(kinds[:256].tobytes()), np.uint8)
    lead = np.flatnonzero(data >= 0x80)
    if lead.size:
        str(data, "utf-8")  # an error, if they are not
        lead = lead[data[lead] >= 0xC0]
        first = data[lead]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = (first & (0x7F >> size)).astype(np.int32)
        tails = [(more, lead[more] + k) for k in (1, 2, 3) if (more := np.flatnonzero(size > k)).size]
        for more, at in tails:
            point[more] = point[more] << 6 | data[at] & 0x3F
        own = kinds[point]
        kind[lead] = own
        for more, at in tails:
            kind[at] = own[more]
    change = kind[1:] != kind[:-1]
    change[texts[1:] - 1] = False
    cut = np.ones(n, bool)
    np.greater(change, data[:-1] == 0x20, out=cut[1:])
    last = change & (kind[:-1] == 0)
    cut[:-1] |= last
    if lead.size and (wide := np.flatnonzero(own == 0)).size:  # these begin at their first byte
        wide, end = lead[wide], lead[wide] + size[wide] - 1
        wide, end = wide[end < n - 1], end[end < n - 1]
        wide, end = wide[last[end]], end[last[end]]
        cut[end], cut[wide] = False, True
    cut[texts] = True
    short = np.flatnonzero(data == 0x27)
    short = short[cut[short]]
    if short.size:  # 's and the like, where a match begins
        end = np.append(texts, n)[np.searchsorted(texts, short, side="right")]
        a, b = data[np.minimum(short + 1, n - 1)], data[np.minimum(short + 2, n - 1)]
        one = (short + 1 < end) & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (short + 2 < end) & np.isin(a.astype(np.uint16) << 8 | b, np.frombuffer(b"revell", ">u2"))
        cut[short[one | two] + 1] = False
        after = np.append(short[one] + 2, short[two] + 3)
        cut[after[after < n]] = True
    return np.flatnonzero(cut)


#: Characters of a piece that is remembered; longer ones are encoded each time.
LONG = 64


class Pieces(dict):
    """piece -> what `encode` makes of it, for whole batches of pieces at a time; emptied when over `most` are held."""

    def __init__(self, encode: Callable[[list[str]], Iterable], most: int = 700_000):
        super().__init__()
        self.encode, self.most = encode, most

    def of(self, pieces: list[str]) -> list:
        return self.each([pieces])[0]

    def each(self, lists: list[list[str]]) -> list[list]:
        """For each list of pieces what they become; pieces not known yet go to `encode` all at once."""
        if len(self) > self.most:
            self.clear()
        out = [list(map(self.get, pieces)) for pieces in lists]
        open_ = [(pieces, got, at) for pieces, got in zip(lists, out, strict=True) if (at := [i for i, x in enumerate(got) if x is None])]
        if open_:
            asked = list({pieces[i] for pieces, _, at in open_ for i in at})
            self.update(zip(asked, self.encode(asked), strict=True))
            for pieces, got, at in open_:
                for i in at:
                    got[i] = self[pieces[i]]
            for p in asked:
                if len(p) > LONG:
                    del self[p]
        return out
