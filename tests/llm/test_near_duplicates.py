"""Operators 7 and 10, and the search for components."""

import random

import numpy as np
import pytest

from granary.llm import embedding_dup, near_dup
from granary.llm.align import _band, alike, similarity_bound, within
from granary.llm.graph import components
from granary.llm.words import split_words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, words, share, vocabulary):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [rng.choice(vocabulary)] if x < share * 2 / 3 else [w, rng.choice(vocabulary)] if x < share else [w]
    return out


def test_alignment_is_exact_within_the_band():
    rng = random.Random(1)
    for _ in range(4000):
        a = [rng.randrange(rng.choice([2, 4, 9])) for _ in range(rng.randint(0, 13))]
        b = edited(rng, a, 0.3, range(9))
        most = rng.randint(0, 6)
        assert within(a, b, most) == alike(np.array(a, int), np.array(b, int), most) == (distance(a, b) <= most)
    long = [rng.randrange(5000) for _ in range(30_000)]
    other = list(long)
    for k in rng.sample(range(30_000), 500):
        other[k] = -1
    assert within(long, other, 500) and not within(long, other, 499) and _band([1, 2, 3], [1, 3], 1)


def groups(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 2), (2, 5), (5, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(99 - k, 98 - k) for k in range(0, 60, 2)] + [(1, 50), (3, 90)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == groups([e for e in edges if e[0] != e[1]])


def test_random_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == groups([e for e in edges if e[0] != e[1]])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(3000)] + ["the", "of", "and"] * 300
    rows, k = [], 0
    passage = rng.choices(vocabulary, k=55)
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.choice([12, 60, 200, 700]))
        rows.append((k, " ".join(base)))
        k += 1
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            rows.append((k, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.04]), vocabulary))))
            k += 1
    for _ in range(40):  # a common passage in otherwise different texts
        rows.append((k, " ".join(rng.choices(vocabulary, k=90) + passage + rng.choices(vocabulary, k=90))))
        k += 1
    hot = rng.choices(vocabulary, k=150)
    for _ in range(120):  # a large group of near copies
        rows.append((k, " ".join(edited(rng, hot, 0.03, vocabulary))))
        k += 1
    return rows


def brute(rows):
    import re

    words = {d: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for d, t in rows}
    ids = sorted(words)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if words[a] and words[b] and within(words[a], words[b], similarity_bound(len(words[a]), len(words[b]), 0.8))]
    root = groups(edges)
    return {d: root.get(d, d) for d in ids}


def test_near_duplicates(spark, corpus, monkeypatch):
    extra = [(5000, None), (5001, ""), (5002, "..."), (5003, "one two"), (5004, "One, TWO"), (5005, "one three"), (6000, "é " * 5000), (6001, "é " * 4990)]
    rows = corpus + extra
    want = brute(rows)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, bucket string, rep int").repartition(5)
    for block in (near_dup.BLOCK, 16):  # groups in one block, and dealt over many
        monkeypatch.setattr(near_dup, "BLOCK", block)
        got = {r.doc_id: (r.class_id, r.kept) for r in near_dup.classes(docs).collect()}
        assert {d: c for d, (c, _) in got.items()} == want
        assert all(kept == (d == c) for d, (c, kept) in got.items())


@pytest.mark.parametrize("share", [10, 15, 20])
def test_scattered_edits_are_found(spark, share):
    rng = random.Random(share)
    rows = []
    for k in range(200):  # pairs without a closer copy between them, up to the very bound
        base = [f"w{rng.randrange(20_000)}" for _ in range(rng.choice([70, 300, 900]))]
        other = list(base)
        for at in rng.sample(range(len(base)), len(base) * share // 100):
            other[at] = f"x{rng.randrange(20_000)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    held = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(held[2 * k + 1] == 2 * k for k in range(200)) / 200
    assert found >= 0.99 and all(held[2 * k] == 2 * k for k in range(200))


def test_the_filter_passes_what_the_bound_allows():
    rng = np.random.default_rng(5)
    for n in (65, 300, 3000):  # every fifth word replaced: no k-mer of five words survives
        a = rng.integers(0, 1 << 60, (300, n)).astype(np.uint64)
        b = a.copy()
        b[:, 2::5] ^= np.uint64(1)
        bins = [np.stack([near_dup.bin_minima(near_dup.windows(row, near_dup.K)) for row in x]) for x in (a, b)]
        assert near_dup.likely(*bins).all()


def test_all_likely_pairs_are_tried(spark, monkeypatch):
    rng = random.Random(3)
    line = ["is", "onhe"] * 45
    rows = []  # texts of a repeated line and some words of their own: pairs below, at and above the bound in one bucket
    for k in range(150):
        own = [f"w{rng.randrange(9000)}" for _ in range(rng.choice([8, 14, 22, 23, 30, 40]))]
        at = rng.randrange(len(own))
        rows.append((k, " ".join(own[:at] + line + own[at:])))
    rows += [(200, rows[3][1] + " more"), (201, rows[90][1] + " more words")]
    want = brute(rows)
    assert 20 < len(set(want.values())) < 150
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for first, block, words in ((8, 2048, 1 << 20), (0, 2048, 1 << 20), (1, 16, 500)):  # by first partners, without, and in many cells
        monkeypatch.setattr(near_dup, "FIRST_SAMPLES", first)
        monkeypatch.setattr(near_dup, "BLOCK", block)
        monkeypatch.setattr(near_dup, "BLOCK_WORDS", words)
        assert {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()} == want


def test_the_kmer_bound_passes_what_the_alignment_does():
    rng = random.Random(9)
    for _ in range(300):
        a = [rng.randrange(rng.choice([3, 50])) for _ in range(rng.randint(1, 40))]
        b = edited(rng, a, 0.3, range(50)) or [1]
        x, y = (np.sort(near_dup.labelled(near_dup.windows(np.array(w, np.uint64), near_dup.K))) for w in (a, b))
        assert near_dup.common(x, y) >= max(len(a), len(b)) - near_dup.K + 1 - near_dup.K * distance(a, b)


def test_near_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.classes(empty).count() == 0 and near_dup.deduplicate(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g", 0), (1, "a b c d e f g", 0), (2, "a b c d e f g", 1), (None, "a b c", 2), (3, None, 3)], "doc_id long, text string, _row int")
    assert {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()} == {1: 1, 2: 1, 3: 3}
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r._row) for r in kept.collect()) == [(0, 2), (1, 0), (3, 3)]


def test_order_matters_to_the_samples():
    import pyarrow as pa

    words = [f"w{k}" for k in range(400)]
    a, b, c = " ".join(words), " ".join(words[200:] + words[:200]), " ".join(words[:390])
    held = split_words(pa.array([a, b, c]))
    sample = [near_dup.order_samples(near_dup.windows(held.hashes[x:y], 5), 200, 2) for x, y in zip(held.offsets, held.offsets[1:])]
    assert (sample[0] == sample[2]).mean() > 0.85 and 0.2 < (sample[0] == sample[1]).mean() < 0.8


def test_words_do_not_depend_on_batches():
    import pyarrow as pa

    texts = ["A b", None, "é漢 x9", "", "a" * 100, "z " * 700_000 + "end"]
    whole = split_words(pa.array(texts))
    for k, t in enumerate(texts):
        alone = split_words(pa.array([t], pa.string()))
        assert (whole.hashes[whole.offsets[k] : whole.offsets[k + 1]] == alone.hashes).all()
    assert whole.words(0) == [b"a", b"b"] and whole.words(2) == ["é漢".encode(), b"x9"]
    sliced = pa.array(["skip", *texts])[1:]
    assert (split_words(sliced).hashes == whole.hashes).all()


def vectors(rng):
    out = []
    for label in range(3):
        for _ in range(40):
            base = rng.standard_normal(24)
            out.append((label, base))
            for spread in rng.choice([0.02, 0.1, 0.2, 0.3], rng.integers(0, 4)):
                out.append((label, base + spread * rng.standard_normal(24) * np.linalg.norm(base) / np.sqrt(24)))
    hot = rng.standard_normal(24)
    out += [(1, hot)] * 30 + [(1, hot + 0.05 * rng.standard_normal(24)) for _ in range(80)] + [(None, hot), (2, hot * 3.0), (1, np.zeros(24))]
    return out


def test_embedding_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, label, [float(x) for x in np.float32(v)]) for k, (label, v) in enumerate(vectors(rng))]
    n = len(rows)
    rows += [(n, 1, None), (n + 1, 1, []), (n + 2, 1, [1.0, None]), (n + 3, 1, [float("nan")] * 24), (n + 4, 1, [float("inf")] * 24), (n + 5, 1, [1.0, 2.0]), (n + 6, 1, [2.0, 4.0])]
    unit = {k: np.array(v) / np.linalg.norm(v) for k, label, v in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {k: (x, len(v or [])) for k, x, v in rows}
    edges = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.98]
    links, root = {k: 0 for k, *_ in rows}, groups(edges)
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    df = spark.createDataFrame([(k, v, x, "c") for k, x, v in rows], "vec_id long, embedding array<double>, label int, digest string").repartition(4)
    for block, bucket in ((embedding_dup.BLOCK, embedding_dup.BUCKET), (16, 8)):
        monkeypatch.setattr(embedding_dup, "BLOCK", block)
        monkeypatch.setattr(embedding_dup, "BUCKET", bucket)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dup.link(df).collect()}
        assert got == {k: (links[k], root.get(k, k), root.get(k, k) == k) for k, *_ in rows}
    assert embedding_dup.link(df.limit(0)).count() == 0


def test_single_precision_loses_no_link(spark):
    rng = np.random.default_rng(5)
    rows = [(k, label, [float(x) for x in np.float32(v)]) for k, (label, v) in enumerate(vectors(rng))]
    double = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    single = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert sorted(embedding_dup.link(single).collect()) == sorted(embedding_dup.link(double).collect())


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    a, b = embedding_dup.unit(rng.standard_normal((300, 64))), embedding_dup.unit(rng.standard_normal((300, 64)))
    rotate = embedding_dup.code_rotation(64)
    code, factor = embedding_dup.codes(b @ rotate)
    inner, bound = embedding_dup.estimate(a @ rotate, code, factor)
    error = inner - a @ b.T
    assert abs(error.mean()) < 0.002 and (np.abs(error) <= bound).all() and np.abs(error).std() < bound.mean() / 3


def test_deduplicate_with_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", 1, 2), (1, "a b c", "x", "y", 1, 2), (2, "a b c", "x", "y", 1, 2), (None, "a b c", "x", "y", 1, 2)], "doc_id long, text string, __dedup_row string, __dedup_gone string, id int, place int").selectExpr("*", "1 as gone", "2 as hash", "3 as row")
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r["__dedup_row"]) for r in kept.collect()) == [(0, "x"), (1, "x")]
