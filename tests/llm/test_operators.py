"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from tenderspark.llm import bpe_codec, common, components, language_id, license_scan, line_dedup, mixing, pivot_dedup, pretokens, quality, simhash, threshold_topk, token_store
from tenderspark.llm.pretokens import split

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, h long, fp string, k string, d string"
EN = ["the cat and the dog went to the house of the king", "all of the people in this town are with them and they know that it is so"]
FR = ["le chat et le chien sont dans la maison du roi avec les enfants", "tous les gens de cette ville sont avec eux et ils savent que cela est vrai"]
SHARED = "a passage of far more than ten words that stands in more than one of these documents today"


def rows():
    rng = random.Random(1)
    out = []
    for i in range(60):
        base = (EN if i % 2 else FR)[i % 4 // 2].split()
        text = "\n".join(" ".join(rng.choices(base, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 6)))
        out.append((i, text, "en" if i % 2 else "fr", f"s{i % 3}" if i % 7 else None))
    out += [(100, None, "en", "s0"), (101, "", None, "s1"), (102, "123 \n\n 456", "fr", None), (103, SHARED, "en", "s2"), (104, f"x\n{SHARED}\n\ny", "en", "s0"), (105, SHARED, "en", "s2"), (None, "no id here at all", "en", "s0"), (None, None, None, None)]
    out += [(106, "ab\ncd ef gh\nij kl mn op\nq r s t\nu", "en", "s0"), (107, "zz\ncd ef gh\nij kl mn op\nq r s t\nyy", "en", "s0"), (108, "日本語 テスト 🎉 ß\x1c\x85 x", "en", "s1"), (109, "word " * 40_000, "en", "s1")]
    out += [(1, out[1][1], "en", "s1"), (111, "an <|endoftext|> in the text", "en", "s1"), (110, "GENERAL Public-License, all rights reserved. CC BY 4.0\nReleased under the MIT License.", "en", "s1")]
    return [(a, b, c, d, len(b or ""), 7, 8, "x", "y", "z") for a, b, c, d in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    rng, parent = random.Random(3), {}
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(999, 400 + i) for i in range(50)] + [(600 + i, 601 + i) for i in range(30)]

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent}


def test_language_code_lengths_are_a_code():
    model = language_id.train({"en": [t.encode() for t in EN], "fr": [t.encode() for t in FR]})
    sizes = np.bincount(model.classes, minlength=model.cost.shape[2])
    assert np.allclose((np.exp2(-model.cost.astype(float)) * sizes).sum(2), 1, atol=1e-5)
    alone = model.bits([b"the king"])
    assert np.allclose(model.bits([b"", b"the king", b"x"])[1], alone[0])
    assert model.bits([b"", b""]).sum() == 0


def ppm_bits(samples, lang, text):
    """PPM-C with exclusion and frozen counts, straight from its definition, over dictionaries."""
    counts, held = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for own, parts in samples.items():
        for t in parts:
            for i, b in enumerate(t):
                for k in range(language_id.ORDER + 1):
                    ctx = (b"\n" * language_id.ORDER + t)[i + language_id.ORDER - k : i + language_id.ORDER]
                    held[ctx] += 1
                    if own == lang:
                        counts[ctx][b] += 1

    def cost(ctx, byte, out):
        here = {b: n for b, n in counts[ctx].items() if b not in out} if ctx in counts else {}
        n, d = sum(here.values()), len(here)
        if ctx and not here:
            return cost(ctx[1:], byte, out)
        if byte in here:
            return -np.log2(here[byte] / (n + d if ctx or d < 256 else n))
        escape = -np.log2(d / (n + d)) if d else 0.0
        return escape + (cost(ctx[1:], byte, out | set(here)) if ctx else np.log2(max(1, 256 - len(counts[b""]))))

    total = 0.0
    for i, b in enumerate(text):
        padded = b"\n" * language_id.ORDER + text[:i]
        k = next(k for k in range(language_id.ORDER, -1, -1) if not k or held[padded[len(padded) - k :]] >= 2)
        total += cost(padded[len(padded) - k :], b, set())
    return total


def test_language_against_dictionaries(monkeypatch):
    samples = {"en": [t.encode() for t in EN], "fr": [t.encode() for t in FR], "de": ["das ist die größe der straße".encode()]}
    model = language_id.train(samples)
    texts = [b"the king of the dog", "la maison était là".encode(), b"straat 77 zz", b"q", bytes(range(32, 127))]
    got = model.bits(texts)
    for i, t in enumerate(texts):
        for k, lang in enumerate(model.langs):
            assert abs(got[i, k] - ppm_bits(samples, lang, t)) < 1e-3
    monkeypatch.setattr(language_id, "CHUNK", 7)  # a long text goes slice by slice
    for i, t in enumerate(texts):
        assert np.allclose(model.bits([t])[0], got[i], atol=1e-6)


def test_language_model_is_bounded(monkeypatch):
    samples = {f"l{i}": [bytes([97 + (i + j * j) % 26 for j in range(400)])] for i in range(100)}
    monkeypatch.setattr(language_id, "MODEL_BYTES", 1 << 20)
    model = language_id.train(samples)
    assert model.cost.nbytes <= 1 << 20 and len(model.langs) == 100
    sizes = np.bincount(model.classes, minlength=model.cost.shape[2])
    assert np.allclose((np.exp2(-model.cost.astype(float)) * sizes).sum(2), 1, atol=1e-4)


def test_language_long_texts_train(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TEXT_BYTES", 400)
    data = [(i, " ".join([(EN, FR)[i % 2][i // 2 % 2]] * 50), ("en", "fr")[i % 2]) for i in range(12)]
    got = language_id.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("en", "fr")[r.doc_id % 2] for r in got)


def test_language(docs, none):
    got = language_id.identify(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for a, b, lang, *_ in rows()[:60]:
        assert by[a].held_out == (zlib.crc32(str(a).encode()) % 4 == 2)
        if len(b.split()) > 6:
            assert by[a].lang_pred == lang
    assert {by[i].lang_pred for i in (100, 101, 102)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    kept = language_id.stage(docs)
    assert kept.columns == docs.columns and {100, 101, 102}.isdisjoint(r.doc_id for r in kept.collect())
    assert language_id.identify(none).count() == 0 and language_id.stage(none).count() == 0


def test_quality(spark, docs, none):
    texts = [(i, ("good words stand here " if i % 2 else "bad spam spam %%% ") + EN[i % 2] + f" {i}", None, None, 0, 0, 0, "", "", "") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)] + [(None, 1, 0), (61, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.rate(spark.createDataFrame(texts, DOCS), labels).collect()}
    assert all(got[i].expected_grade > 1.5 and got[i].kept for i in range(61, 80, 2)) and all(got[i].expected_grade < 0.5 and not got[i].kept for i in range(62, 80, 2))
    same = quality.rate(docs, labels.limit(0)).collect()  # no ratings: all grades alike, all kept; nulls and repeated rows too
    assert len(same) == docs.count() and len({(r.expected_grade, r.kept) for r in same}) == 1 and quality.rate(none, labels).count() == 0


def test_quality_repeated_ratings(spark):
    data = [(i, t + f" {i}") for i in range(60) for t in ("some good words", "spam spam %%%")]
    marks = [(i, q, 1 - q) for i in range(60) for q in (0, 1)]
    docs_ = spark.createDataFrame(data, "doc_id long, text string")
    runs = [quality.sample(docs_.repartition(n), spark.createDataFrame(marks[::step], "doc_id long, quality int, toxic int").repartition(n)) for n, step in ((1, 1), (5, -1))]
    assert runs[0][0] == runs[1][0] and (runs[0][1] == runs[1][1]).all() and (runs[0][1] == 0).all() and len(runs[0][0]) == 60


def test_ordinal_loss_against_differences(monkeypatch):
    monkeypatch.setattr(quality, "BITS", 4)
    rng = np.random.default_rng(2)
    data = [(np.arange(8)[rng.random(8) < 0.7], None, rng.random(3)) for _ in range(60)]
    data = [(a, rng.random(len(a)), s) for a, _, s in data]
    grades = rng.integers(0, 3, 60)
    matrix = quality.Data.of(data, grades)
    p = np.zeros((1 << quality.BITS) + 5)
    p[:8], p[-5:-2], p[-2:] = rng.normal(size=8), rng.normal(size=3), (-0.5, 0.3)
    value, g = quality.loss(p, matrix)
    scores = [sum(p[a] * v) + p[-5:-2] @ s for a, v, s in data]
    cuts = [p[-2], p[-2] + np.exp(p[-1])]
    tails = [[1, *[1 / (1 + np.exp(c - x)) for c in cuts], 0] for x in scores]
    plain = -sum(np.log(t[k] - t[k + 1]) for t, k in zip(tails, grades, strict=True)) / 60 + (quality.SHRINK * (p[:8] @ p[:8]) + 0.1 * (p[-5:-2] @ p[-5:-2])) / 120
    assert abs(value - plain) < 1e-9
    for k in [*range(8), *range(len(p) - 5, len(p))]:
        step = np.zeros_like(p)
        step[k] = 1e-5
        assert abs((quality.loss(p + step, matrix)[0] - quality.loss(p - step, matrix)[0]) / 2e-5 - g[k]) < 1e-6
    # the fit is near the least loss that plain descent finds without the sparse step
    monkeypatch.setattr(quality, "SPARSE", 0.0)
    fitted = quality.fit(data, grades, steps=600)
    q = np.zeros_like(p)
    for _ in range(6000):
        q = q - 0.5 * quality.loss(q, matrix)[1]
    end = np.concatenate([fitted.weights, fitted.shares, [fitted.cuts[0], np.log(fitted.cuts[1] - fitted.cuts[0])]])
    assert abs(quality.loss(end, matrix)[0] - quality.loss(q, matrix)[0]) < 1e-3


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    data = [(np.array([i % 5]), np.array([1.0]), rng.random(3)) for i in range(50)]
    model = quality.fit(data, np.array([i % 3 for i in range(50)]), steps=50)
    tails = model.tails(data)
    assert model.cuts[0] < model.cuts[1] and (tails[:, 0] >= tails[:, 1]).all()


def test_bpe(docs, none):
    import tiktoken

    codec = bpe_codec.Codec(public_tokenizers.path(bpe_codec.RANKS))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={})
    rng = random.Random(5)
    odd = ["".join(rng.choice("ab c'd\n\t\xa0é½1ßſ日🎉,.<|\x1f\x85▁") for _ in range(40)) for _ in range(500)]
    for t in odd + ["a" * 3000, "<|endoftext|>"]:
        assert [i for p in codec.ids(split(t)) for i in p] == lib.encode_ordinary(t)
    got = bpe_codec.roundtrip(docs).collect()
    want = sorted((a is None, a or 0, len(e := lib.encode_ordinary(b or "")), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((b or "").encode()).hexdigest()) for a, b, *_ in rows())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe_codec.decode(bpe_codec.encode(docs)).collect()
    assert sorted(r.text for r in back) == sorted(b or "" for _, b, *_ in rows())
    assert bpe_codec.roundtrip(none).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, row int, v string"


def vectors():
    rng = np.random.default_rng(2)
    base = [rng.normal(size=16).round(2).tolist() for _ in range(70)]
    out = [(i, v) for i, v in enumerate(base)] + [(200 + i, base[5]) for i in range(12)] + [(300, (np.array(base[6]) * 1.001 + 0.001).tolist()), (20, base[9])]
    out += [(400, None), (420, []), (440, [None] * 16), (460, [float("nan")] * 16), (480, [0.0] * 16), (None, base[1]), (500, [float("inf")] + [0.0] * 15)]
    return [(a, b, 1, 2, "x") for a, b in out]


def test_topk(spark):
    df = spark.createDataFrame(vectors(), VECTORS).repartition(2)
    good = [(i, a, np.floor(64 * np.array(np.float32(b), float)).astype(int)) for i, (a, b, *_) in enumerate(vectors()) if a is not None and b and all(x is not None and np.isfinite(x) for x in b)]
    want = []
    for i, a, q in good:
        if a % 20 == 0:
            best = sorted((-int(q @ v), b) for j, b, v in good if j != i)[:20]
            want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in threshold_topk.top_k(df).collect())
    assert got == sorted(want)
    assert threshold_topk.top_k(df.limit(0)).count() == 0


def test_topk_stops_early_and_exact():
    rng = np.random.default_rng(1)
    v = np.zeros((3000, 8), np.int64)
    v[np.arange(3000), rng.integers(0, 8, 3000)] = rng.integers(1, 3000, 3000)
    for i, ids, scores, read in threshold_topk.search(v[:5], np.arange(5), np.arange(3000), np.arange(3000), v, 4):
        assert read < 600  # of 3000
        s = v @ v[i]
        s[i] = -1
        best = np.lexsort((np.arange(3000), -s))[:4]
        assert ids.tolist() == best.tolist() and scores.tolist() == s[best].tolist()


def test_topk_wide_components(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-1000, 1000, (80, 4)).astype(float)
    v[:, 0] = 2.0**25 + rng.integers(0, 4000, 80) / 64
    v[[0, 20], 0], v[60], v[70, 0] = 0, [0, 2.0**30, 3, -4], -(2.0**29)
    q = [[int(np.floor(64 * x)) for x in r] for r in v]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in threshold_topk.top_k(spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], "vec_id long, embedding array<double>")).collect())
    want = []
    for a in range(0, 80, 20):
        best = sorted((-sum(x * y for x, y in zip(q[a], q[j], strict=True)), j) for j in range(80) if j != a)[:20]
        want += [(a, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want) and max(s for *_, s in got) > 2**62
    with pytest.raises(OverflowError):
        list(threshold_topk.search(np.array([[2**40]], object), np.array([0]), np.array([7]), np.array([1]), np.array([[2**40]], object)))


def test_pivots(spark, monkeypatch):
    monkeypatch.setattr(pivot_dedup, "CHUNK", 8)
    df = spark.createDataFrame(vectors(), VECTORS).repartition(2)
    good = [(a, np.array(np.float32(b), float)) for a, b, *_ in vectors() if a is not None and b and all(x is not None and np.isfinite(x) for x in b) and any(b)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    ids = np.array([a for a, _ in good])
    group = ids.copy()
    while True:
        new = np.array([min(group[i], group[link[i]].min(initial=10**9)) for i in range(len(ids))])
        if (new == group).all():
            break
        group = new
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivot_dedup.near_duplicates(df).collect() if r.vec_id is not None)
    alone = [(a, 0, a, True) for a, b, *_ in vectors() if a is not None and a not in set(ids.tolist())]
    assert got == sorted([(int(a), int(n), int(g), bool(a == g)) for a, n, g in zip(ids, link.sum(1), group, strict=True)] + alone)
    assert pivot_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pivot_recall():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    noise = rng.normal(size=u.shape)
    noise -= (noise * u).sum(1, keepdims=True) * u
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    pivots = rng.normal(size=(pivot_dedup.PIVOTS, 64))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    for c, least in ((0.9, 0.93), (0.95, 0.99)):
        v = c * u + np.sqrt(1 - c * c) * noise
        a, b = pivot_dedup.describe(u, pivots), pivot_dedup.describe(v, pivots)
        assert ((a[:, :, None] == b[:, None, :]).any(2).sum(1) >= 2).mean() >= least


def test_pivots_in_dense_groups(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    group = lambda n, c: unit(np.sqrt(c) * unit(rng.normal(size=(1, 64))) + np.sqrt(1 - c) * unit(rng.normal(size=(n, 64))))
    third = np.concatenate([group(1000, 0.93), unit(rng.normal(size=(2000, 64)))])
    four = np.concatenate([*(group(250, 0.91) for _ in range(4)), unit(rng.normal(size=(2000, 64)))])
    cone = unit(np.sqrt(0.5) * unit(rng.normal(size=(1, 64))) + np.sqrt(0.5) * unit(rng.normal(size=(600, 64))))
    near = np.concatenate([cone, unit(cone + 0.42 * unit(rng.normal(size=cone.shape)))])
    for v in (third, four, group(1200, 0.92), near):
        v = rng.permutation(v)
        link = v @ v.T >= 0.9
        np.fill_diagonal(link, False)
        df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
        got = {r.vec_id: r.n_links for r in pivot_dedup.near_duplicates(df).collect()}
        assert all(got[i] <= n for i, n in enumerate(link.sum(1).tolist())) and sum(got.values()) >= 0.95 * link.sum() > 0


def test_mixing(docs, none):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, b, _, s, *_ in rows():
        sizes[s] += size(b)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        each = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if each[s] >= 2 * sizes[s]}
        if not full:
            target |= each
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    got = mixing.mix(docs).collect()
    texts = sorted((a is None, a or 0, size(b)) for a, b, *_ in rows())
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == texts
    for s in order:
        assert any(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == sizes[s] for r in got)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.source_size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    words = sum(size(r.text) for r in mixing.stage(docs).collect())
    assert words == sum(r.taken for r in got) and mixing.stage(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0 and mixing.stage(none).count() == 0


def test_mixing_comes_near(spark):
    many = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 40 AS int)) AS text", "concat('s', id % 4) AS source", "1 AS size")
    by = defaultdict(list)
    for r in mixing.mix(many).collect():
        by[(r.target, r.source_size)].append(r.taken)
    for (target, _), taken in by.items():
        assert abs(sum(taken) - target) <= 40 * 4


def test_licenses(docs, none, monkeypatch):
    def brute(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for p, label in license_scan.BASE.items() for q in [p.split()] for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
        return len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({b for _, b in at}))

    got = license_scan.scan(docs).collect()
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in x)
    assert sorted(key((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(key((a, *brute(b))) for a, b, *_ in rows())
    assert "mit-notice" in next(r for r in got if r.doc_id == 110).labels
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    scanner, rng = license_scan.Scanner(), random.Random(4)
    words = [x for t in [*license_scan.BASE, *license_scan.NOTICES.values()] for x in t.split()]
    for _ in range(400):
        t = " ".join(rng.choice([*words, "zz", *license_scan.BASE]) for _ in range(rng.randint(0, 30)))
        monkeypatch.setattr(license_scan, "CHUNK", rng.choice([1 << 22, 13, 40]))
        assert scanner.scan(t.encode())[:5] == brute(t)
    assert license_scan.scan(none).count() == 0


def matching(templates, w):
    """For each word the longest run ending there that stands in some template, by comparison."""
    grams = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(w[i - n + 1 : i + 1]) in grams), default=0) for i in range(len(w))]


def test_license_matching_statistics_and_chains(monkeypatch):
    notices = {"a": "one two three four five six", "b": "three four five nine ten", "c": "one two one two one two three"}
    scanner, rng = license_scan.Scanner({"cc by": "cc-by"}, notices), random.Random(3)
    templates = [["cc", "by"], *(t.split() for t in notices.values())]
    for _ in range(300):
        w = rng.choices("one two three four five six nine ten cc by zz".split(), k=rng.randint(0, 25))
        v = n = 0
        lengths = []
        for x in w:
            c = scanner.sam.ids.get(x.encode())
            v, n = (0, 0) if c is None else scanner.sam.step(v, n, c)
            lengths.append(n)
        assert lengths == matching(templates, w)
        # chains: of each template the most words that matches of LONG words or more cover in order, gaps within its size
        *_, score, spans = scanner.scan(" ".join(w).encode())
        ends = [i for i, n in enumerate(lengths) if n >= license_scan.LONG and (i + 1 == len(w) or lengths[i + 1] <= n)]
        best = 0.0
        for t in templates[1:]:
            places = [(i - lengths[i] + 1, i, e - lengths[i], e) for i in ends for e in range(lengths[i], len(t) + 1) if t[e - lengths[i] : e] == w[i - lengths[i] + 1 : i + 1]]
            cover = {}
            for p in sorted(places, key=lambda p: p[1]):
                before = [cover[q] for q in cover if p[0] > q[1] and p[2] >= q[3] and p[0] - q[1] - 1 <= len(t)]
                cover[p] = p[3] - p[2] + max(before, default=0)
            best = max([best, *(min(1.0, n / len(t)) for n in cover.values())])
        assert score == (1.0 if ("cc", "by") in zip(w, w[1:]) else best)
        assert all(a <= b for _, a, b in spans) and (spans or score < license_scan.LEAST or score == 1.0)


def test_license_many_chains_and_texts():
    scanner = license_scan.Scanner()
    part = " ".join(license_scan.TEXTS["bsd-3-clause"].split()[:40])
    text = f"{(part + ' zzz ') * 100} {license_scan.TEXTS['bsd-3-clause']} zzz"
    labels = scanner.scan(text.encode())[5].split(",")
    assert "bsd-3-clause" in labels and "bsd-2-clause" not in labels
    for name, t in license_scan.TEXTS.items():
        assert name in scanner.scan(f"zzz {t} zzz".encode())[5].split(",")


def test_license_spans():
    text = "x y z " + license_scan.NOTICES["bsd"] + " tail"
    *_, labels, score, spans = license_scan.Scanner().scan(text.encode())
    assert "bsd" in labels and score == 1.0 and ("bsd", 3, 2 + len(license_scan.words(license_scan.NOTICES["bsd"].encode()))) in spans


def test_license_spans_in_chunks(monkeypatch):
    scanner, rng = license_scan.Scanner(), random.Random(9)
    notices = list(license_scan.NOTICES.values())
    for _ in range(60):
        text = " ".join(f"{' '.join(rng.choices(['zzz', 'qqq'], k=rng.randint(0, 9)))} {rng.choice(notices)}" for _ in range(2)) + " zzz qqq zzz"
        monkeypatch.setattr(license_scan, "CHUNK", 1 << 22)
        whole = scanner.scan(text.encode())
        for size in rng.choices(range(20, len(text)), k=20):
            monkeypatch.setattr(license_scan, "CHUNK", size)
            assert scanner.scan(text.encode()) == whole


def test_coder_round_trip():
    rng = np.random.default_rng(0)
    for high in (1, 2, 300, 65536):
        blocks = [rng.integers(0, high, n) for n in (0, 1, 7, 1500, 4096)]
        got = token_store.unpack(token_store.pack(blocks), [len(b) for b in blocks])
        assert all(np.array_equal(a, b) for a, b in zip(blocks, got, strict=True))
    same = token_store.pack([np.full(4096, 777)])
    assert len(same[0]) < 200
    alone, together = token_store.pack([blocks[3]])[0], token_store.pack(blocks)[3]
    assert alone == together


def test_blocks_share_their_groups_counts():
    """Ids without order take little more than their entropy, in blocks of any length; carries run through whole words."""
    rng = np.random.default_rng(4)
    p = 1 / np.arange(1, 3001)
    blocks = [rng.choice(3000, n, p=p / p.sum()) for n in [4096] * 20 + [700, 1, 0]]
    every = np.concatenate(blocks)
    c = np.bincount(every) / len(every)
    bits = -(c[c > 0] * np.log2(c[c > 0])).sum()
    shares = token_store.Shares.load(token_store.Shares.of(every).dump())
    packed = token_store.pack(blocks, shares)
    assert 8 * sum(map(len, packed)) < 1.08 * bits * len(every)
    got = token_store.unpack(packed, [len(b) for b in blocks], shares)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, got, strict=True))
    with pytest.raises(ValueError, match="share"):
        token_store.pack([np.array([60_000])], shares)
    for ids in (np.full(9, 65_535), np.arange(65_536), np.zeros(0, np.int64)):
        assert token_store.Shares.of(ids).size.sum() == 65_536
    out = token_store._Out(2)
    out._write(np.array([0, 1, 0, 0]), np.array([7, 5, 0xFFFFFFFF, 0x100000000], np.uint64))
    assert np.frombuffer(out.ends()[0], "<u4")[:3].tolist() == [8, 0, 0]


def test_guesses_of_a_group():
    """What most often follows each id and pair, by a dictionary; they go through a head, and let blocks of a text with order take less."""
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 40, 6000) ** 2
    ids[1::3] = ids[::3] + 1
    shares, after = token_store.Shares.of(ids), defaultdict(lambda: defaultdict(int))
    for a, b, c in zip([None, *ids.tolist()], ids.tolist(), ids[1:].tolist()):
        after[b][c] += 1
        if a is not None:
            after[65_536 + int(token_store._slots(np.array([b], np.uint32), np.array([a], np.uint32))[0])][c] += 1
    for at in range(131_072):
        n = sum((found := after.get(at, {})).values())
        if n < token_store.OFTEN:
            assert shares.guess[at] == (at * 4 if at < 65_536 else 0)
        else:
            part = found[int(shares.guess[at]) >> 2] / n
            assert part == max(found.values()) / n and shares.guess[at] & 3 == (part >= 1 / 8) + (part >= 1 / 4) + (part >= 1 / 2)
    again = token_store.Shares.load(shares.dump())
    assert np.array_equal(again.guess, shares.guess) and np.array_equal(again.size, shares.size)
    with pytest.raises(ValueError, match="length"):
        token_store.Shares.load(zlib.compress(bytes(9)))
    blocks = [ids[i : i + 1000] for i in range(0, 6000, 1000)]
    packed = token_store.pack(blocks, shares)
    assert sum(map(len, packed)) < 0.8 * sum(map(len, token_store.pack(blocks, token_store.Shares(shares.size))))
    got = token_store.unpack(packed, [1000] * 6, again)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, got, strict=True))


def test_store_of_several_groups(spark, docs, tmp_path, monkeypatch):
    """Groups of two blocks of 64 ids: documents run over blocks and groups, and come back whole."""
    monkeypatch.setattr(token_store, "LANES", 2)
    monkeypatch.setattr(token_store, "BLOCK", 64)
    where = f"file://{tmp_path}/groups"
    run = {}
    frame = pa.record_batch({"doc_id": pa.array(range(5), pa.int64()), "text": pa.array(["a b c " * k for k in (0, 90, 1, 300, 7)])})
    monkeypatch.setattr(token_store, "arrow_map", lambda df, f, schema: run.setdefault("f", f) and df)
    monkeypatch.setattr("pyspark.TaskContext.get", classmethod(lambda cls: type("T", (), {"partitionId": staticmethod(lambda: 3)})))
    token_store.write(docs, where)
    out = pa.Table.from_batches(list(run["f"](iter([frame]))))
    n = out.column("n").to_pylist()
    assert n.count(token_store.HEAD) > 2 and max(n) == 64 and out.column("block").to_pylist() == list(range(len(n)))
    rows = out.to_pylist()
    heads = [k for k, r in enumerate(rows) if r["n"] == token_store.HEAD]
    ids = []
    for k, end in zip(heads, [*heads[1:], len(rows)], strict=True):
        own = rows[k + 1 : end]
        ids += [x for b in token_store.unpack([r["payload"] for r in own], [r["n"] for r in own], token_store.Shares.load(rows[k]["payload"])) for x in b.tolist()]
    assert sum(d["n"] for r in rows for d in r["ids"]) == len(ids) and [d["doc_id"] for r in rows for d in r["ids"]] == list(range(5)) and ids.count(token_store.END) == 5


def test_only_unknown_pieces_are_looked_up_again():
    class Counted(pretokens.Pieces):
        seen = 0

        def __getitem__(self, p):
            self.seen += 1
            return super().__getitem__(p)

    cache = Counted(lambda pieces: [p.upper() for p in pieces])
    assert cache.each([["a", "b", "a"], [], ["b", "c" * 99]]) == [["A", "B", "A"], [], ["B", "C" * 99]] and set(cache) == {"a", "b"}
    cache.seen = 0
    assert cache.of(["a", "b", "d"]) == ["A", "B", "D"] and cache.seen == 1


def test_joined_pieces_encode_as_the_library_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_store.VOCABULARY)
    lib, cache, rng = Tokenizer.from_file(path), token_store._pieces(path), random.Random(8)
    added = token_store.Added(path)
    odd = ["".join(rng.choices("abc d'stre\n\t\r\xa0é½1ßſ日🎉,.<|\x1c\x1f\x85\u2028\u3000▁", k=rng.randint(0, 60))) for _ in range(3000)] + ["", "\n", "<|endoftext|>", "x <|endoftext|> y", "<|endoftext|><|endoftext|>\n", "<|endoftext|", "a" * 3000]
    want = [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    for _ in range(2):  # the second time from the cache
        assert token_store.tokenise(odd, cache, added) == want


def test_matches_are_cut_all_at_once():
    """As the pattern cuts each text alone, wherever the texts around it begin and end."""
    rng, some = random.Random(3), "abz d's're'v'e'll'm't \n\t\r\xa0é½1\u00b2ßſ日🎉,.<|\x1c\x1f\x85\u2028\u3000▁٣\u0301\U0001d7d8"
    for _ in range(300):
        texts = ["".join(rng.choices(some, k=rng.randint(1, 20))) for _ in range(rng.randint(1, 30))]
        raw = [t.encode() for t in texts]
        at = np.cumsum([0, *map(len, raw)])
        data = b"".join(raw)
        cut = [*pretokens.starts(np.frombuffer(data, np.uint8), at[:-1]).tolist(), len(data)]
        assert [data[i:j].decode() for i, j in zip(cut, cut[1:])] == [p for t in texts for p in split(t)]
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for text in (every[:256], every):
        data = np.frombuffer(text.encode(), np.uint8)
        cut = [*pretokens.starts(data, np.zeros(1, np.int64)).tolist(), len(data)]
        assert [data[i:j].tobytes().decode() for i, j in zip(cut, cut[1:])] == split(text)


def test_known_pieces_are_bounded_and_whole(tmp_path):
    """After forgetting, long pieces and with a vocabulary that leaves bytes out, ids stay those of the library."""
    import json

    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_store.VOCABULARY)
    held = json.load(open(path))
    held["model"]["vocab"].pop("z"), held["model"].update(merges=[])
    held["model"]["vocab"] = {k: v for k, v in held["model"]["vocab"].items() if len(k) == 1}
    less = f"{tmp_path}/less.json"
    json.dump(held, open(less, "w"))
    texts = ["zz az z\n", None, "", "b" * 5000 + " <|endoftext|>z", "<|endoftext|", "|>", "l'été 'll"]
    for at in (path, less):
        lib, added = Tokenizer.from_file(at), token_store.Added(at)
        want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
        cache = token_store.Known(at, most=3)
        for _ in range(3):
            ids, sizes = token_store.encoded(pa.array(texts), cache, added, end=True)
            assert ids.tolist() == [x for w in want for x in [*w, token_store.END]] and sizes.tolist() == [len(w) + 1 for w in want]
            assert len(cache.at) < 20
    cache, texts = token_store.Known(path, most=60), ["all of these words stay, as they come again"]
    want = Tokenizer.from_file(path).encode(texts[0], add_special_tokens=False).ids
    added = token_store.Added(path)
    for k in range(40):
        assert token_store.encoded(pa.array(texts), cache, added)[0].tolist() == want
        token_store.encoded(pa.array([" ".join(f"n{chr(97 + k % 26)}{chr(97 + i)}{'q' * (k // 26)}" for i in range(20))]), cache, added)
        assert b" again" in cache.at and b"<|endoftext|>" in cache.at and len(cache.at) < 100 and cache.met.shape == cache.size.shape == (len(cache.at) + 1,)


def test_store(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(token_store.VOCABULARY))
    got = token_store.store_and_read(docs).collect()
    want = []
    for a, b, *_ in rows():
        ids = np.array([*lib.encode(b or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((a is None, a or 0, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    placed = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    ids = [i for i in placed if i is not None]
    assert ids == sorted(ids) and placed[: len(ids)] == ids
    assert token_store.store_and_read(none).count() == 0
    where = f"file://{tmp_path}/store"
    token_store.write(docs.limit(3), where)
    broken = spark.read.parquet(where).selectExpr("part", "block", "n", "crc + 1 AS crc", "payload", "ids")
    broken.write.parquet(f"{where}-broken")
    with pytest.raises(Exception, match="checksum"):
        token_store.read(spark, f"{where}-broken").collect()


def simple(text):
    w = [x.decode() for x in re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def grouped(prints, ids):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[top(i)] = top(j)
    least = defaultdict(list)
    for i, a in enumerate(ids):
        least[top(i)].append(a)
    return [min((x for x in least[top(i)] if x is not None), default=None) for i in range(len(ids))]


def test_simhash(docs, none):
    prints = [simple(b) for _, b, *_ in rows()]
    want = grouped(prints, [a for a, *_ in rows()])
    key = lambda a, f, c: (a is None, a or 0, f, -1 if c is None else c)
    got = simhash.groups(docs).select("doc_id", simhash.hexed().alias("f"), "component_id").collect()
    assert sorted(key(r.doc_id, r.f, r.component_id) for r in got) == sorted(key(a, f"{f:016x}", c) for (a, *_), f, c in zip(rows(), prints, want, strict=True))
    kept = simhash.stage(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and set(ids) == set(want)
    assert simhash.groups(none).count() == 0 and simhash.stage(none).count() == 0


def test_simhash_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 3)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(6)
    prints = list({(0x1234567890ABCDEF ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & 0xF0F)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = components.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")))
    roots = {r.node: r.root for r in found.collect()}
    want = grouped(prints, signed)
    assert [roots.get(s, s) for s in signed] == want


def removed(docs, least):
    seen, out = set(), {}
    unique = sorted({(a is None, a or 0, b) for a, b in docs if b is not None}, key=lambda x: (x[0], x[1], line_order[x]))
    for key in unique:
        lines = [(i, t, len(re.findall(line_dedup.WORD, t))) for i, t in enumerate(key[2].split("\n")) if re.search(line_dedup.WORD, t)]
        gone = set()
        for n in range(1, least + 1):
            for i in range(len(lines) - n + 1):
                if sum(w for *_, w in lines[i : i + n]) >= least:
                    run = tuple(t for _, t, _ in lines[i : i + n])
                    if run in seen:
                        gone |= {k for k, *_ in lines[i : i + n]}
                    seen.add(run)
        out[key] = gone
    return out


line_order: dict = {}


@pytest.mark.parametrize("least", [10, 3, 7])
def test_lines(spark, docs, least):
    for r in docs.selectExpr("doc_id IS NULL AS n", "coalesce(doc_id, 0) AS i", "text", "xxhash64(text) AS h").collect():
        line_order[(r.n, r.i, r.text)] = r.h
    gone = removed([(a, b) for a, b, *_ in rows()], least)

    def left(a, b):
        if b is None or not (drop := gone[(a is None, a or 0, b)]):
            return b, 0
        kept = [t for i, t in enumerate(b.split("\n")) if i not in drop]
        return ("\n".join(kept) if any(re.search(line_dedup.WORD, t) for t in kept) else ""), len(drop)

    out = line_dedup.dedup(docs, least)
    key = lambda a, t, n: (a is None, a or 0, t is None, t or "", n)
    assert sorted(key(r.doc_id, r.text, r.n_removed) for r in out.collect()) == sorted(key(a, *left(a, b)) for a, b, *_ in rows())


def test_lines_repeated_rows(spark):
    short = "cd ef gh\nij kl mn op\nq r s t"
    rows_ = [(1, f"ab\n{short}\nu"), (2, f"zz\n{short}\nyy"), (2, f"zz\n{short}\nyy"), (2, f"zz\n{short}\nyy")]
    got = line_dedup.dedup(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == [(1, rows_[0][1], 0)] + [(2, "zz\nyy", 3)] * 3


def test_stages_leave_other_columns_alone(spark):
    """Columns named as helpers are keep their values, in any case."""
    names = ["n", "ID", "th", "k", "none", "times", "theta", "edge", "copy", "lang_pred", "score", "bits_per_byte", "letters", "n_lines", "n_removed", "spans", "h", "size", "__k", "__th", "__id", "__keep", "__lang", "place", "words"]
    data = [(r[0], r[1], r[2], r[3], *[f"{c}-{i}" for c in names]) for i, r in enumerate(rows())]
    wide = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in names))
    held = {(r[0], *r[4:]) for r in data}
    for stage in (language_id.stage, line_dedup.stage, simhash.stage, mixing.stage):
        out = stage(wide)
        assert out.columns == wide.columns
        got = {(r[0], *r[4:]) for r in out.collect()}
        assert got and got <= held


def test_text_ids(spark):
    """Ids need not be numbers."""
    data = spark.createDataFrame([("b", "all rights reserved"), ("a", "x y z"), (None, "x y z"), ("c", None)], "doc_id string, text string")
    assert {r.doc_id: r.n_words for r in license_scan.scan(data).collect()} == {"b": 3, "a": 3, None: 3, "c": 0}
    assert [r.doc_id for r in token_store.store_and_read(data).orderBy("start").collect()] == ["a", "b", "c", None]
    assert {r.doc_id: r.component_id for r in simhash.groups(data).collect()} == {"a": "a", "b": "b", "c": "c", None: "a"}


def test_long_texts(spark, docs, monkeypatch):
    """The paths that only long texts take, by bounds of a few words."""
    texts = ["", "a", "w " * 7, SHARED, " ".join(f"w{i}" for i in range(50))]
    want = [simhash.fingerprint(t.encode()) for t in texts]
    monkeypatch.setattr(simhash, "HELD", 4)
    assert [simhash.fingerprint(t.encode()) for t in texts] == want == [simple(t) for t in texts]
    path = public_tokenizers.path(token_store.VOCABULARY)
    cache, added = token_store._pieces(path), token_store.Added(path)
    want = token_store.tokenise(texts, cache, added)
    monkeypatch.setattr(token_store, "CHUNK", 3)
    assert [token_store.tokenise([t], cache, added)[0] for t in texts] == want
    codec, pieces = bpe_codec._codec(public_tokenizers.path(bpe_codec.RANKS))
    want = [bpe_codec._digest(t, pieces) for t in texts]
    monkeypatch.setattr(bpe_codec, "CHUNK", 3)
    assert [bpe_codec._digest(t, pieces) for t in texts] == want
    assert [w[1] for w in want] == [hashlib.sha256(",".join(str(i) for p in codec.ids(split(t)) for i in p).encode()).hexdigest() for t in texts]


def test_lines_stage(docs, none):
    out = line_dedup.stage(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert 105 not in got and got[103] == SHARED and SHARED not in got[104] and got[104].startswith("x\n")
    assert {100, 101, 102} <= set(got) and line_dedup.stage(none).count() == 0


def test_training_lays_out_one_language_at_a_time():
    draw = random.Random(7)
    samples = {f"l{k}": [bytes(draw.choices(range(97 + k, 113 + k), k=60_000)) for _ in range(3)] for k in range(8)}
    tracemalloc.start()
    try:
        language_id.train(samples)
        assert tracemalloc.get_traced_memory()[1] < 35 << 20  # all at once took 52 MB
    finally:
        tracemalloc.stop()


def test_driver_collects_once_half_of_its_heap_is_taken(spark, monkeypatch):
    """A table or a checkpoint of an iteration leads to a collection if the heap has grown, and to none otherwise."""
    calls = []

    class Session:
        class _jvm:
            class java:
                class lang:
                    class Runtime:
                        getRuntime = staticmethod(lambda: type("R", (), {"totalMemory": lambda self: taken, "maxMemory": lambda self: 100})())

                    class System:
                        gc = staticmethod(lambda: calls.append(taken))

    for taken in (50, 51):
        common.collected(Session)
    assert calls == [51]
    monkeypatch.setattr(common, "collected", lambda session: calls.append("here"))
    assert common.stored(spark.range(3)).count() == 3 and common.cut(spark.range(3)).count() == 3 and calls[1:] == ["here"] * 2
