"""The mix and the two audits against plain versions, over the small tables, odd rows and empty tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillage.llm import divergence, mixing, queries

WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, None, None, None),
    (4, "Straße straße STRASSE ÀB àb \U0001f600 x-y_z 1a2", "de", None),
    (4, "Straße straße STRASSE ÀB àb \U0001f600 x-y_z 1a2", "de", None),
    (4, "another text of one id", "fr", "b"),
    (None, "no id here", "de", "b"),
    (None, "no id here", "de", "b"),
    (6, "no id here", "en", ""),
    (7, "\x0b \t\n", "only", "one"),
    (8, "common word 50% off & more | less", "en", "z"),
    (8, "common word 50% off & more | less", "fr", "z"),
    (9, "UP CASE " * 120, "en", "é"),
    (10, "UP CASE " * 120, "de", "\U0001f600"),
    (11, " ".join(f"w{k % 5003}" for k in range(90_000)), "en", "long"),
    *[(20 + k, f"shared terms of all {'abc'[k % 3] * 3} rows {'pq'[k % 2]}", "en", f"s{k % 7}") for k in range(40)],
    *[(70 + k, f"shared terms of all {'abc'[k % 3] * 3} rows {'pq'[k % 2]}", "es", f"s{k % 3}") for k in range(25)],
    *[(100, "one text with one id", "en", "hot") for _ in range(60)],
]


@pytest.fixture(scope="module", params=["sf", "odd", "none"])
def folder(request, spark, sf_dir, tmp_path_factory):
    if request.param == "sf":
        return sf_dir
    at = str(tmp_path_factory.mktemp(request.param))
    docs = spark.createDataFrame(ODD if request.param == "odd" else [], "doc_id long, text string, lang string, source string")
    for name in ("size", "target", "row", "range", "part", "mask", "n", "term", "p"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, 1), (8, 0, 1), (20, 1, None), (21, None, 1), (None, 1, 1), (999, 1, 1), (100, 1, 0)] if request.param == "odd" else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def docs_of(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """The excess is shared again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not above:
            return out | share
        out |= {s: most * sizes[s] for s in above}
        open_ -= above
        left -= sum(out[s] for s in above)
    return out


def test_mixing(spark, folder):
    docs, got = docs_of(spark, folder), queries.op11_mixing(spark, folder).collect()
    size = [len(WORD.findall(t or "")) for _, t, _, _ in docs]
    of = Counter()
    for (_, _, _, s), n in zip(docs, size):
        of[s] += n
    goal = plain_targets(of)
    expected = sorted(((i, n, of[s], round(goal[s], 3)) for (i, _, _, s), n in zip(docs, size)), key=repr)
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 3)) for r in got), key=repr) == expected
    assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    mixed = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet").withColumn("size", F.lit("x")).repartition(5), ["doc_id", "source", "text", "size"])
    assert mixed.columns == ["doc_id", "source", "text", "size", "source_size", "target", "copies", "taken"]
    # Another partitioning, the same mix.
    mixed = mixed.collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken, r.target)
    assert sorted(map(key, mixed)) == sorted(map(key, got))
    taken = Counter()
    for r in mixed:
        taken[r.source] += r.taken
    for s in of:
        sizes = [n for (_, _, _, x), n in zip(docs, size) if x == s and n]
        # Within half a word, unless the source's copies can't be summed so.
        if sum(sizes) < 3000:
            assert abs(taken[s] - goal[s]) == pytest.approx(min(abs(x - goal[s]) for x in reachable(sizes)), abs=1e-6)
        else:
            assert abs(taken[s] - goal[s]) <= 0.5 + 1e-6 or len(set(sizes)) < 3


def reachable(sizes, most=3):
    sums = {0}
    for n in sizes:
        sums = {x + k * n for x in sums for k in range(most + 1)}
    return sums


def test_fit():
    dice = random.Random(5)
    for _ in range(300):
        sizes = dice.sample(range(1, 60), dice.randint(1, 6))
        copies = [dice.randint(1, 4) for _ in sizes]
        goal = dice.uniform(0, 1.2) * sum(a * b for a, b in zip(sizes, copies))
        sums = reachable([], 0)
        for n, c in zip(sizes, copies):
            sums = {x + k * n for x in sums for k in range(c + 1)}
        found = mixing.knapsack(sizes, copies, goal)
        assert all(0 <= f <= c for f, c in zip(found, copies))
        total = sum(n * f for n, f in zip(sizes, found))
        assert abs(total - goal) == min(abs(x - goal) for x in sums), (sizes, copies, goal, total)
    # Large sources: a share of each size first, then the rest exactly; sizes longer than the sums that are held.
    sizes, counts = list(range(1, 4000)), [dice.randint(1, 5000) for _ in range(3999)]
    whole = sum(a * b for a, b in zip(sizes, counts))
    for goal in (0.1 * whole, 0.77 * whole, 2.5 * whole, 3.0 * whole):
        found = mixing.fit(sizes, counts, goal)
        assert abs(sum(a * b for a, b in zip(sizes, found)) - goal) <= 0.5 and all(0 <= f <= 3 * c for f, c in zip(found, counts))
        assert np.mean(np.abs(np.array(found) / np.array(counts) - goal / whole) < 0.2) > 0.9
    found = mixing.fit([50_000_000, 10], [3, 2], 120_000_000.0)
    assert found == [2, 6]
    assert mixing.fit([0, 0], [5, 5], 0.0) == [0, 0] and mixing.fit([], [], 0.0) == []


def test_targets_of_many_sources(spark):
    dice = random.Random(3)
    sizes = {f"s{k:04d}": int(10 ** dice.uniform(0, 6)) for k in range(700)} | {None: 17, "": 0}
    counts = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long")
    got = {r.source: r.target for r in mixing.targets(counts, (5, 1, 2, 8)).collect()}
    assert got == pytest.approx(plain_targets(sizes, (5, 1, 2, 8)))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def lower(t):
    return re.sub("[A-Z]", lambda c: c[0].lower(), t)


def plain_divergence(docs):
    by, frequency, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall(lower(t or ""))
        by[lang, source].update(terms)
        frequency[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in frequency[lang].items() if n >= 10]
        whole = Counter()
        for s in sources:
            whole.update({t: by[lang, s][t] for t in kept})

        def p(counter):
            n = sum(counter[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (counter[t] + 2) // n for t in kept}

        far = lambda x, y: (x - y) ** 2 // (x + y)
        q, own = p(whole), {s: p(by[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(far(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(far(own[s][t], q[t]), t) for t in kept if by[lang, s][t] and own[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:top]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


def test_divergence(spark, folder, monkeypatch):
    expected = plain_divergence(docs_of(spark, folder))
    found = queries.op12_source_divergence(spark, folder)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(found) == expected


def test_divergence_in_small_pieces(spark, monkeypatch):
    """The task functions with little room give the same sums."""
    dice = random.Random(9)
    docs = [(k, " ".join(dice.choice("abcdefghijkl") * dice.randint(1, 3) for _ in range(dice.randint(0, 30))), dice.choice(["x", "y"]), dice.choice("pqrstu")) for k in range(300)]
    rows = pa.table({"lang": [d[2] for d in docs], "source": [d[3] for d in docs], "text": [d[1] for d in docs]})
    monkeypatch.setattr(divergence, "SLICE", 200)
    monkeypatch.setattr(divergence, "HELD", 40)
    monkeypatch.setattr(divergence, "PAIRS", 5)
    partial = pa.Table.from_batches(list(divergence._partial_runs(iter(rows.to_batches(max_chunksize=17)))))
    assert partial.num_rows > 200
    ordered = partial.sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")])
    kept = pa.Table.from_batches(list(divergence._kept_runs(10)(iter(ordered.to_batches(max_chunksize=7)))))
    count, frequency = Counter(), Counter()
    for _, t, lang, s in docs:
        count.update((lang, w, s) for w in t.split())
        frequency.update((lang, w) for w in set(t.split()))
    assert {(r["lang"], r["term"], r["source"]): r["n"] for r in kept.to_pylist()} == {k: n for k, n in count.items() if frequency[k[:2]] >= 10}
    assert sum(r["run"] for r in kept.to_pylist()) == sum(n >= 10 for n in frequency.values())
    p = kept.append_column("p", pa.array([7 * n + 3 for n in kept["n"].to_pylist()])).append_column("zero", pa.array([ord(s) for s in kept["source"].to_pylist()]))
    got = Counter()
    for b in divergence._shared_terms(iter(p.to_batches(max_chunksize=11))):
        for r in b.to_pylist():
            got[r["lang"], r["source"], r["item"]] += r["value"]
    runs, far, expected = defaultdict(list), lambda x, y: (x - y) ** 2 // (x + y), Counter()
    for r in p.to_pylist():
        runs[r["lang"], r["term"]].append(r)
    for rs in runs.values():
        for a, b in combinations(rs, 2):
            expected[a["lang"], a["source"], b["source"]] += far(a["p"], b["p"]) - far(a["p"], b["zero"]) - far(a["zero"], b["p"]) + far(a["zero"], b["zero"])
    assert got == expected


def test_interaction(spark, folder):
    docs = docs_of(spark, folder)
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failed = []
    for i, t, lang, _ in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = ("A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and i > least[t]))
        failed.append((lang or "", fails, i in good, i in toxic))
    expected, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for step, f in enumerate(order, 1):
            for part in {x[0] for x in failed}:
                expected[part, order, step] = [0] * 6
        for part, fails, is_good, is_toxic in failed:
            gone = False
            for step, f in enumerate(order, 1):
                row = expected[part, order, step]
                here = f in fails and not gone
                row[1] += here
                row[2] += f in fails and gone
                row[3] += fails == f
                row[4] += here and is_good
                row[5] += here and is_toxic
                shapley[part, f] += here
                gone |= here
                row[0] += not gone
    out = sorted(((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in expected.items()), key=repr)
    found = queries.op13_filter_interaction(spark, folder)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert rows_of(found) == out
