"""License scan with a generalised suffix automaton over the words of license texts and phrases.

The automaton of all templates is built once (its size is bounded by the templates).  A text streams through it word by
word; state and length are its matching statistics: the longest run of words ending here that stands in some template.
Runs of LONG words or more are chained by template, in order of both text and template, into covered spans; a template
covered to LEAST or more gives its label, unless a longer template covers that stretch and more.  The phrases of the base are templates themselves: one stands where the
state's link path reaches the phrase's own state at its full length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, buffers, slim
from .license_texts import TEXTS

#: Phrases and labels of the base.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of well-known licenses, as their stewards ask to have them put into files.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache": "Licensed under the Apache License, Version 2.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit-notice": "Released under the MIT License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-licensed": "This work is licensed under the GNU General Public License, version 3.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
#: Words a match needs to count for a template, and the share of a template's words that gives its label.
LONG, LEAST = 3, 0.75
#: Bytes of a text taken at a time.
CHUNK = 1 << 22
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """Generalised suffix automaton.  Of each state: next states by word, link, greatest length; where templates put it."""

    def __init__(self, templates: dict[str, list[bytes]]):
        self.names = list(templates)
        self.sizes = [len(t) for t in templates.values()]
        self.ids: dict[bytes, int] = {}
        self.next, self.link, self.len = [{}], [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # template -> end positions
        for k, text in enumerate(templates.values()):
            last = 0
            for i, w in enumerate(text):
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                self.ends[last].setdefault(k, []).append(i + 1)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            for k, at in self.ends[v].items():
                self.ends[self.link[v]][k] = sorted({*self.ends[self.link[v]].get(k, []), *at})

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        self.ends.append({})
        return len(self.len) - 1

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.len[last] + 1), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        twin = self._state(self.len[p] + 1)
        self.next[twin], self.link[twin] = dict(self.next[q]), self.link[q]
        self.link[q] = twin
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def step(self, v: int, n: int, c: int) -> tuple[int, int]:
        while v and c not in self.next[v]:
            v = self.link[v]
            n = self.len[v]
        v = self.next[v].get(c, -1)
        return (v, n + 1) if v >= 0 else (0, 0)

    def suffix(self, v: int, n: int) -> Iterator[tuple[int, int]]:
        """States of the match's suffixes, longest first, each with the length it stands for here."""
        while v > 0:
            yield v, n
            v = self.link[v]
            n = self.len[v]


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] | None = None):
        notices = {**NOTICES, **TEXTS} if notices is None else notices
        phrases = {p: words(p.encode()) for p in base}
        self.labels = [*base.values(), *notices]
        self.nbase = len(base)
        self.sam = Automaton({**phrases, **{f"notice {k}": words(v.encode()) for k, v in notices.items()}})
        sam, self.hits = self.sam, {}
        for k, phrase in enumerate(phrases.values()):
            v = 0
            for w in phrase:
                v = sam.next[v][sam.ids[w]]
            self.hits.setdefault(v, []).append((k, len(phrase)))
        #: For each state the phrases that end every match of it, or that end it at their length.
        self.ending = {v: [(k, n) for u, _ in sam.suffix(v, sam.len[v]) for k, n in self.hits.get(u, ())] for v in range(1, len(sam.len))}

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first, last, base labels, labels, score, covered spans (label, first word, last word)."""
        sam, get = self.sam, self.sam.ids.get
        total, places, runs = 0, [], []
        v = n = 0
        rest, at, raw = b"", 0, text.translate(_WORDS)
        while at < len(raw) or rest:
            part = rest + raw[at : at + CHUNK]
            at += CHUNK
            rest = b""
            if at < len(raw) and (end := part.rfind(b" ")) >= 0:
                part, rest = part[:end], part[end:]
            elif at < len(raw):
                rest = part
                continue
            found = part.split()
            ids = np.fromiter((-1 if (x := get(w)) is None else x for w in found), np.int32, len(found))
            known = np.flatnonzero(ids >= 0)
            if len(found) and (not len(known) or known[0]):  # a match that the last chunk left open ends there
                if n >= LONG:
                    runs.append((total - 1, v, n))
                v = n = 0
            before = -1
            for i in known.tolist():
                if i != before + 1:
                    if n >= LONG:
                        runs.append((total + before, v, n))
                    v = n = 0
                before = i
                u, m = sam.step(v, n, int(ids[i]))
                if n >= LONG and m <= n:
                    runs.append((total + i - 1, v, n))
                v, n = u, m
                for k, size in self.ending.get(v, ()):
                    if n >= size:
                        places.append((total + i - size + 1, k))
            if len(known) and known[-1] != len(found) - 1:
                if n >= LONG:
                    runs.append((total + before, v, n))
                v = n = 0
            total += len(found)
        if n >= LONG:
            runs.append((total - 1, v, n))
        spans = self._chain(runs)
        base = {self.labels[k] for _, k in places}
        starts = [p for p, _ in places]
        score = 1.0 if places else max((s[3] for s in spans), default=0.0)
        own = self._outer([s for s in spans if s[3] >= LEAST])
        return total, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in own})), score, own

    def _chain(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Matches in order of text and template, gaps of at most the template's size, joined to spans by template."""
        sam, out = self.sam, []
        open_: dict[int, list[list[int]]] = {}  # template -> [text first, text end, template end, words covered]
        over: dict[int, list[list[int]]] = {}  # chains that lie too far back to be joined any more
        for end, v, n in runs:
            for k, ends in sam.ends[v].items():
                if k < self.nbase:
                    continue
                far = end - n - sam.sizes[k]
                chains = [c for c in open_.get(k, ()) if c[1] >= far]
                over.setdefault(k, []).extend(c for c in open_.get(k, ()) if c[1] < far)
                for e in ends:
                    fit = [c for c in chains if end - n + 1 > c[1] and e - n >= c[2]]
                    best = max(fit, key=lambda c: c[3], default=None)
                    chains.append([best[0], end, e, best[3] + n] if best else [end - n + 1, end, e, n])
                open_[k] = chains
        for k, chains in open_.items():
            out += self._best(k, over[k] + chains)
        return out

    def _best(self, k: int, chains: list[list[int]]) -> list[tuple[str, int, int, float]]:
        """The chains that no better one overlaps: by words covered, then by place."""
        firsts: list[int] = []
        lasts: list[int] = []
        out: list[tuple[str, int, int, float]] = []
        for a, b, _, n in sorted(chains, key=lambda c: (-c[3], c[0], c[1])):
            at = bisect_left(lasts, a)  # those kept so far stand in order and apart
            if at == len(firsts) or firsts[at] > b:
                firsts.insert(at, a)
                lasts.insert(at, b)
                out.append((self.labels[k], a, b, min(1.0, n / self.sam.sizes[k])))
        return out

    @staticmethod
    def _outer(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
        """Spans in order of place, without those that lie within a longer one."""
        out: list[tuple[str, int, int]] = []
        for label, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
            if not out or b > out[-1][2] or (a, b) == out[-1][1:]:
                out.append((label, a, b))
        return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id (of its own type) and SCHEMA for each row of `docs`; null texts count as empty, repeated rows stay, no rows in, none out."""
    names = ["doc_id", *[x.split()[0] for x in SCHEMA.split(", spans")[0].split(", ")], "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            at, data = buffers(batch.column(1))
            rows = [scanner.scan(bytes(data[at[i] : at[i + 1]])) for i in range(batch.num_rows)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            spans = pa.array([[{"label": a, "first": b, "last": c} for a, b, c in s] for s in cols[7]], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], spans], names=names)

    return arrow_map(slim(docs, "doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
