"""The pipeline's near-duplicate stage against Jaccard similarity by brute force."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
from tillage.llm import near_copies

from .test_brute_force import BLANK, docs_of


def shingles(text):
    w = [w for w in BLANK.split(re.sub("[A-Z]", lambda c: c[0].lower(), text or "")) if w]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def least_ids(docs):
    """The least id of each component over pairs of similarity 0.8 or more."""
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in docs]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in root if find(i) == i)


def edited():
    """Texts with some words changed, from none to too many, a common passage, chains of copies, and short texts."""
    rng = random.Random(7)
    passage = [f"common{k}" for k in range(30)]
    out, n = [], 0
    for length in (20, 40, 100, 101, 250, 400):
        for _ in range(4):
            words = [f"w{rng.randrange(5000)}" for _ in range(length)] + passage * rng.randrange(2)
            for changes in (0, 0, 1, 2, 3, 4, 6, 8, 10, 12):
                copy = list(words)
                for _ in range(changes):
                    copy[rng.randrange(length)] = f"x{rng.randrange(5000)}"
                out.append((n := n + 1, " ".join(copy)))
            for _ in range(5):
                words[rng.randrange(length)] = f"y{rng.randrange(5000)}"
                out.append((n := n + 1, "  ".join(words).title()))
    out += [(n + 1, "four words are here"), (n + 2, "Four words are\nhere"), (n + 3, "four"), (n + 4, ""), (n + 5, None), (n + 6, "four words are there")]
    rng.shuffle(out)
    return out


def test_edited_texts(spark, monkeypatch):
    docs = edited()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = least_ids(docs)
    assert len(expected) < len(docs) - 100
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == expected
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_tables(spark, sf_dir):
    docs = [(i, t) for i, t in docs_of(spark, sf_dir) if i is not None]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == least_ids(docs)


def test_no_rows(spark):
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string"), "").collect() == []


def test_repeated_ids(spark):
    """Rows that share an id but not the text are documents of their own; which of several copies stays is fixed."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, "p"), (1, b, "q"), (2, a, "r"), (3, b, "s"), (4, c, "t"), (5, c, "u"), (5, a, "v"), (6, f"{c} end", "w"), (4, c, "a"), (None, c, "x")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, source string").repartition(3)
        got = {tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
        assert got == {(1, a, "p"), (1, b, "q"), (4, c, "a"), (None, c, "x")}


def of_blocks(n, chosen=8, blocks=40, seed=3):
    """Texts of some out of few blocks, with now and then a word changed: every shingle is frequent, few texts are alike."""
    rng = random.Random(seed)
    words = [[f"b{k}w{rng.randrange(400)}" for _ in range(40)] for k in range(blocks)]
    out = []
    for i in range(n):
        own = [w for k in rng.sample(range(blocks), chosen) for w in words[k]]
        for _ in range(rng.choice((0, 0, 3, 8))):
            own[rng.randrange(len(own))] = f"z{rng.randrange(9)}"
        out.append((i, " ".join(own)))
        if i % 20 == 0:
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"y{rng.randrange(9)}"
            out.append((n + i, " ".join(own)))
    return out


def test_patterns():
    """Sets that are similar enough share a pattern, at every size and however their sizes differ."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 100, 333, 1000, 4000]:
        for _ in range(20):
            own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            most = (len(own) - 4 * len(own) // 5) if rng.random() < 0.5 else int(rng.integers(0, len(own) // 5 + 1))
            drop = int(rng.integers(0, most + 1))
            keep = rng.permutation(own)[drop:]
            # |a & b| = n - drop; add what the similarity still allows.
            room = max((len(keep) * 5) // 4 - len(own), 0)
            other = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, room + 1))).astype(np.uint64)]))
            shared = len(np.intersect1d(own, other))
            if 5 * shared >= 4 * (len(own) + len(other) - shared):
                assert np.intersect1d(near_copies.patterns(own), near_copies.patterns(other)).size, (n, drop)
    assert not near_copies.patterns(np.zeros(0, np.uint64)).size


def test_texts_of_blocks(spark):
    """Equal to brute force, where most texts share their shingles with many others."""
    docs = of_blocks(700) + [(5000 + i, t) for i, t in of_blocks(150, 5, 8, 4)] + [(9000 + i, t) for i, t in edited()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == least_ids(docs)


def test_candidates_of_blocks(spark, monkeypatch):
    """Pairs that are looked at grow with the number of such texts, not with its square."""
    counts = []

    def counted(pairs, nodes):
        out = bounded(pairs, nodes)
        counts[-1] += out.count()
        return out

    bounded = near_copies._bounded
    monkeypatch.setattr(near_copies, "_bounded", counted)
    for n in (1000, 4000):
        counts.append(0)
        near_copies.deduplicate(spark.createDataFrame(of_blocks(n), "doc_id long, text string")).count()
    assert counts[1] <= 6 * counts[0] + 1000, counts


def test_hot_shingles(spark, monkeypatch):
    """Shingles that are dealt with apart give the same."""
    docs = edited() + [(20_000 + i, t) for i, t in of_blocks(150, 5, 8, 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = least_ids(docs)
    for name, value in (("HOT", 100), ("HOT_SAMPLE", 1), ("FREQUENT", 0), ("CROWD", 3)):
        monkeypatch.setattr(near_copies, name, value)
    assert sorted(r["doc_id"] for r in near_copies.deduplicate(df).collect()) == expected


def test_fingerprints_find_near_copies(spark, monkeypatch):
    """SimHash alone connects what is at most two bits apart, and whole sets decide; where no prefix is looked at, near copies of long
    texts are still found by it."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    rng = random.Random(5)
    texts = []
    for base in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(["another", *words[1:]])]
    texts += ["", None, "one two three", "One two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = near_copies.prefixes(docs).groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp")).collect()
    sets = list(near_copies.shingle_sets(pa.array(texts, pa.string())))
    plain = lambda own: sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in near_copies._mixed(own)) > len(own))
    assert all(r["fp"] % (1 << 64) == plain(sets[r["rep"]]) for r in nodes)
    fp = {r["node"]: r["fp"] % (1 << 64) for r in nodes}
    pairs = {(r["node"], r["node2"]) for r in near_copies.by_fingerprints(spark.createDataFrame(nodes)).collect()}
    assert all((fp[a] ^ fp[b]).bit_count() <= 2 and a > b for a, b in pairs)
    root = {n: n for n in fp}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[top(a)] = top(b)
    near = [(a, b) for a in fp for b in fp if a > b and (fp[a] ^ fp[b]).bit_count() <= 2]
    assert len(near) > 6 and all(top(a) == top(b) for a, b in near)
    met = near_copies._met
    monkeypatch.setattr(near_copies, "_met", lambda nodes: met(nodes).limit(0))
    found = {r["doc_id"]: r["component"] for r in near_copies.near_copies(docs).collect()}
    rep = {r["node"]: r["rep"] for r in nodes}
    assert all(found[rep[a]] == found[rep[b]] for a, b in near)
