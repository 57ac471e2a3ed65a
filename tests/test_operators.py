"""Operators on small tables with nulls, ties and odd rows, where the driver's tables have none."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillage.operators import chunking as C
from tillage.operators import extraction as X
from tillage.operators import lookups as L
from tillage.operators import programme as P
from tillage.operators import relational as R
from tillage.operators import retrieval as V
from tillage.operators import seasons as S
from tillage.sources.tables import evaluation_rows, replace_partitions
from tillage.streaming.slots import event_counts, settled


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, data, kind):
    return spark.createDataFrame(data, kind)


def test_pieces_keep_every_word():
    text = "One two. " * 300 + "\n\n" + "x" * 2000 + "\n" + "end of it"
    for split in (C.split_recursive, C.split_overlapping):
        pieces = split(text)
        assert max(map(len, pieces)) <= 800
        assert set(text.split()) - {"x" * 2000} <= set(" ".join(pieces).split()) | {"x" * 800, "x" * 400}
    assert C.split_recursive("") == [] and C.split_recursive("  \n ") == []


def test_recursive_neighbours_overlap():
    pieces = C.split_recursive("".join(f"w{i} " for i in range(400)), most=100, overlap=20)
    assert all(a.split()[-1] in b.split() for a, b in zip(pieces, pieces[1:]))


def test_split_table():
    body = [f"| {i} | v |" for i in range(9)]
    headed = C.split_table("\n".join(["| a | b |", "| --- | :-: |", *body]))
    assert [t.count("\n") - 1 for t in headed] == [4, 4, 1] and all(t.startswith("| a | b |\n| --- | :-: |\n") for t in headed)
    assert C.split_table("\n".join(body[:1])) == ["| c1 | c2 |\n| --- | --- |\n| 0 | v |"]
    assert C.split_table("no table") == ["no table"] and C.split_table("") == []
    assert all(len(t) <= 60 for t in C.split_table("\n".join(body), most=60))


def test_pack_blocks_and_merge_context():
    assert list(C.pack_blocks(iter([("a", "1"), ("a", "2"), ("b", "3"), ("b", " ")]))) == ["1\n2", "3"]
    assert list(C.pack_blocks(iter([("a", "x" * 500), ("a", "y" * 500)]))) == ["x" * 500, "y" * 500]
    assert list(C.merge_context(iter([("A", "1"), ("A > B", "2"), ("AB", "3"), ("AB", "z" * 779)]))) == ["1\n\n2", "3", "z" * 779]


def test_likeness():
    assert X.likeness("a b", "ab") == 1.0 and X.likeness("", "x") == 0.0 and X.likeness(None, "x") == 0.0
    assert X.likeness("iron rod", "iron rods") == pytest.approx(0.72 * 14 / 15 + 0.28 / 3 + 0.12) and X.likeness("iron rod", "qqq") == 0.0


def test_best_match(spark):
    got = rows(X.best_match(frame(spark, [("iron rods",), ("zzz",), (None,)], "n string"), "n", ["iron rod", "ring"]))
    assert [(g[0], g[1]) for g in got] == [("iron rods", "iron rod"), ("zzz", None), (None, None)]


def test_heading_path(spark):
    h = frame(spark, [(1, 0, None, "x"), (1, 1, 1, "A"), (1, 2, 2, "B"), (1, 3, None, "x"), (1, 4, 1, "C"), (1, 5, 3, "D"), (2, 0, 2, "E")], "doc int, at int, depth int, title string")
    got = X.with_heading_path(h, ["doc"], "at", "depth", "title", 3)
    assert [r[-1] for r in rows(got)] == ["", "A", "A > B", "A > B", "C", "C > D", "E"]


def test_captions_and_echo(spark):
    c = frame(spark, [(1, 0, "t", "cap"), (1, 1, "t", None), (1, 2, "p", None), (1, 3, "t", None)], "doc int, at int, kind string, caption string")
    assert [r[3] for r in rows(X.with_captions(c, ["doc"], "at", "kind", "caption"))] == ["cap", "cap", None, None]
    e = frame(spark, [(1, 0, "paragraph", "a  b"), (1, 1, "table", "a b"), (1, 2, "paragraph", "c"), (1, 3, "paragraph", None)], "doc int, at int, kind string, text string")
    assert [r[1] for r in rows(X.without_echo(e, ["doc"], "at", "kind", "text"))] == [1, 2, 3]


def test_alias(spark):
    t = frame(spark, [(0, "a rice field"), (1, "rice excluded"), (2, "ri ce"), (3, "r"), (4, "rr"), (5, None)], "i int, t string")
    no = [r"{}\s*excluded"]
    got = rows(t.select("i", X.has_alias(F.col("t"), "rice", no), X.has_alias(F.col("t"), "r", no)))
    assert got == [(0, True, False), (1, False, False), (2, True, False), (3, False, True), (4, False, False), (5, None, None)]


def test_lookups(spark):
    a = frame(spark, [(1, " "), (2, "b"), (None, "n")], "id int, name string")
    b = frame(spark, [(1, "first"), (2, "late"), (3, None)], "id int, name string")
    assert rows(L.first_named([a, b], "id", "name")) == [(1, "first"), (2, "b"), (3, None), (None, "n")]
    base, new = frame(spark, [(1, "x"), (2, "y")], "k int, v string"), frame(spark, [(2, None), (3, "z")], "k int, v string")
    assert rows(L.merged(base, new, ["k"])) == [(1, "x", "kept"), (2, None, "updated"), (3, "z", "inserted")]
    assert rows(L.merged(base.limit(0), new.limit(0), ["k"])) == []


def test_capped_end(spark):
    d = dt.date
    t = frame(spark, [(0, d(2024, 1, 1), d(2024, 2, 1), 5), (1, d(2024, 1, 1), None, 5), (2, None, d(2024, 2, 1), 5), (3, d(2024, 1, 1), d(2024, 1, 3), None)], "i int, a date, b date, n int")
    got = rows(t.select("i", X.capped_end(F.col("a"), F.col("b"), F.col("n"))))
    assert [g[1] for g in got] == [d(2024, 1, 6), d(2024, 1, 6), d(2024, 2, 1), d(2024, 1, 3)]


def test_release(spark):
    ts = [dt.datetime(2024, 1, 2, 2, 14), dt.datetime(2024, 1, 2, 2, 15), dt.datetime(2024, 1, 2, 23, 59), dt.datetime(2024, 1, 2, 0, 0)]
    got = frame(spark, [(t,) for t in ts], "t timestamp").select(F.date_format(S.release(F.col("t"), 2, 3, 15), "dd HH")).collect()
    assert [r[0] for r in got] == ["01 23", "02 02", "02 23", "01 23"]


def test_rollup_of_nothing_and_null_states(spark):
    jobs = frame(spark, [(1, "done", dt.date(2024, 1, 1)), (1, None, None), (2, "done", dt.date(2024, 1, 2))], "k int, s string, e date")
    got = {r["k"]: (r["n"], r["n_done"], r["status"], r["rate"]) for r in R.status_rollup(jobs, ["k"], "s", "e").collect()}
    assert got == {1: (2, 1, "doing", 50.0), 2: (1, 1, "done", 100.0)}
    assert R.status_rollup(jobs.limit(0), ["k"], "s", "e").count() == 0


def test_laggards_and_missing(spark):
    d = dt.date
    todo = frame(spark, [(1, "a", d(2024, 1, 8), None), (2, "a", d(2024, 1, 9), "no"), (3, "a", None, None), (4, "b", d(2024, 1, 1), "yes"), (5, None, None, None)], "id int, who string, due date, state string")
    late = P.laggards(todo, "who", "due", F.col("state") == "yes", F.lit("2024-01-01").cast("date"), 7)
    assert rows(late) == [("a", 2, [1, 3]), (None, 1, [5])]
    many = frame(spark, [(i, "a", None, None) for i in range(500, 0, -1)], "id int, who string, due date, state string")
    assert rows(P.laggards(many, "who", "due", F.col("state") == "yes", F.lit("2024-01-01").cast("date"), 7)) == [("a", 500, [1, 2, 3])]
    sets = frame(spark, [(0, ["x", "y"], []), (1, ["x", "y"], ["y"]), (2, ["x"], ["x", "x"]), (3, [], [])], "i int, need array<string>, got array<string>")
    parts = P.completeness(F.col("need"), F.col("got"))
    assert [r[2] for r in rows(sets.select("i", parts["missing"], parts["state"]))] == ["pending", "in_progress", "completed", "completed"]


@pytest.mark.parametrize("cells", [0.01, 4, 1000])
def test_nearest_place(spark, cells):
    """Against all pairs: near and far places, over the date line and at a pole, ties, groups without places."""
    import math

    rng = random.Random(3)
    at = lambda: (rng.choice((rng.uniform(-89, 89), 37.0 + rng.random(), 89.5)), rng.choice((rng.uniform(-180, 180), 179.9, -179.9, 127.0 + rng.random())))
    points = [(rng.choice("ab"), i, *at()) for i in range(60)] + [("c", 60, 1.0, 1.0)]
    places = [(rng.choice("ab"), i, *at()) for i in range(40)]
    places += [(k, i + 100, la, lo) for k, i, la, lo in places[:5]]
    got = S.nearest_place(frame(spark, points, "k string, i int, lat double, lon double"), frame(spark, places, "k string, j int, lat double, lon double"), ["k"], "i", "j", cells)

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return round(2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h))), 1)

    want = {i: min((metres(la, lo, c, d), j) for g, j, c, d in places if g == k) for k, i, la, lo in points if k != "c"}
    found = {r["i"]: r for r in got.collect()}
    assert found.keys() == want.keys()
    for i, (m, _) in want.items():
        assert abs(found[i]["metres"] - m) < 0.2


def test_nearest_place_in_piles(spark):
    """Many points and places in a few spots: no join makes more rows than spots ask for, and the least id of a pile counts."""
    n = 3000
    points = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("i"), (37.0 + F.col("id") % 3).alias("lat"), F.lit(127.0).alias("lon"))
    points = points.union(spark.createDataFrame([("b", n, 1.0, 1.0)], "k string, i long, lat double, lon double"))
    places = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("j"), (37.0 + F.col("id") % 2).alias("lat"), F.lit(127.0).alias("lon"))
    got = S.nearest_place(points, places, ["k"], "i", "j")
    found = {r["i"]: (r["nearest"], r["metres"]) for r in got.collect()}
    assert found == {i: ((0, 0.0), (1, 0.0), (1, 111194.9))[i % 3] for i in range(n)}

    def rows(node):
        """The most rows that a join of the plan that ran has made."""
        own = node.metrics().get("numOutputRows").get().value() if "Join" in node.nodeName() and node.metrics().contains("numOutputRows") else 0
        children = [node.children().apply(k) for k in range(node.children().size())]
        children += [node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else []
        children += [node.plan()] if "QueryStage" in node.nodeName() else []
        return max([own, *map(rows, children)])

    assert rows(got._jdf.queryExecution().executedPlan()) <= 2 * n


def vectors(n, width=12, groups=9, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(groups)]
    return [(i, [c + rng.gauss(0, 0.4) for c in centres[i % groups]]) for i in range(n)]


def test_index(spark, tmp_path):
    """Every row with a direction is in the index; recall against all rows; exact with all cells."""
    own = vectors(3000) + [(9001, None), (9002, [0.0] * 12), (9003, [1.0]), (9004, [])]
    df, path = frame(spark, own, "id long, e array<double>"), str(tmp_path / "index")
    V.build_index(df, path, "id", "e")
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/rows").collect()) == list(range(3000))
    asked = df.filter("id % 100 = 0")
    exact = {(r["query_id"], r["id"]): r["distance"] for r in V.nearest(asked, df, 10, "id", "id", "e").collect()}
    few = {(r["query_id"], r["id"]): r["distance"] for r in V.probe_index(asked, path, 10, "id", "e", probes=10).collect()}
    assert len(exact) == 300 and len(few) == 300 and all(few[k] == exact[k] for k in few if k in exact)
    assert len(few.keys() & exact.keys()) >= 0.9 * len(exact)
    every = V.probe_index(asked, path, 10, "id", "e", probes=10_000, most=7).collect()
    assert {(r["query_id"], r["id"]): r["distance"] for r in every} == exact
    told = spark.read.parquet(f"{path}/probes").first()
    by_itself = {(r["query_id"], r["id"]) for r in V.probe_index(asked, path, 10, "id", "e").collect()}
    assert told["recall"] >= 0.95 and told["probes"] < 54 and len(by_itself & exact.keys()) >= 0.9 * len(exact)
    V.build_index(df.limit(0), path, "id", "e")
    assert V.probe_index(asked, path, 10, "id", "e").count() == 0


def test_index_recall(spark, sf_dir):
    from tillage.plans import documents

    exact = {(r["query_id"], r["id"]) for r in documents.v1_knn(spark, sf_dir).collect()}
    found = {(r["query_id"], r["id"]) for r in documents.v1_indexed(spark, sf_dir).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_cascade(spark):
    """Later backends get what is open only, and aren't started when nothing is."""
    asked = frame(spark, [(k,) for k in range(6)], "q int")
    seen = []

    def backend(some):
        def run(left):
            seen.append(sorted(r["q"] for r in left.collect()))
            return left.filter(F.col("q").isin(some)).select("q", F.lit(7).alias("id"))

        return run

    def never(left):
        raise AssertionError

    assert rows(V.answered(asked, "q", [backend([1, 2]), backend([]), backend([0, 1, 4])])) == [(0, 7, 3), (1, 7, 1), (2, 7, 1), (4, 7, 3)]
    assert seen == [[0, 1, 2, 3, 4, 5], [0, 3, 4, 5], [0, 3, 4, 5]]
    assert len(rows(V.answered(asked, "q", [backend(list(range(6))), never]))) == 6


def test_lexical_hits(spark):
    texts = [(1, "The rice field", "a"), (2, "rice", "b"), (3, "prices of rice fields", "a"), (4, None, "p"), (5, "field of hay", "p"), (6, "nothing", "p"), (7, "rice rice", None), (8, "rice field", "a")]
    asked = frame(spark, [(1, ["rice", "field"]), (2, ["hay"]), (3, []), (4, None), (5, ["x", ""])], "query_id int, words array<string>")
    df = frame(spark, texts, "id int, text string, source string")
    got = rows(V.lexical_hits(asked, df, 3, F.col("source") == "p", most=2))
    # 1 and 8 have both words, 3 one word and the other within a word; the preferred one takes the last place.
    assert got == [(1, 1, 8, 1), (1, 5, 4, 3), (1, 8, 8, 2), (2, 5, 4, 1)]
    assert rows(V.lexical_hits(asked, df.limit(0), 3, F.col("source") == "p")) == []


def test_nearest_holds_little(spark):
    """A block of many queries against many vectors, in one worker."""
    import resource

    import numpy as np
    import pyarrow as pa

    dice = np.random.default_rng(2)
    wanted, rows_ = dice.normal(size=(2000, 32)), dice.normal(size=(6000, 32))
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    sent = pa.table({"query_id": pa.array(range(2000)), "v": lists(wanted)})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    [out] = V._search(iter([pa.record_batch([pa.array(range(6000)), lists(rows_)], names=["id", "v"])]), sent, 10, False)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 300
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    best = np.argsort(1 - unit(wanted) @ unit(rows_).T, axis=1)[:, :10]
    got = {}
    for q, i in zip(out["query_id"].to_pylist(), out["id"].to_pylist()):
        got.setdefault(q, set()).add(i)
    assert got == {q: set(b.tolist()) for q, b in enumerate(best)}


@pytest.mark.parametrize("most", [1, 3, 100])
def test_nearest_in_blocks(spark, most):
    rng = random.Random(5)
    v = [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in range(40)]
    df = frame(spark, v, "id long, e array<float>")
    got = rows(V.nearest(df.filter("id % 8 = 0"), df, 3, "id", "id", "e", most=most).select("query_id", "rank", "id"))
    want = []
    for q, a in v[::8]:
        na = np.linalg.norm(a)
        d = sorted((round(1 - float(np.dot(a, b)) / (na * np.linalg.norm(b)), 6) + 0.0, i) for i, b in v if na * np.linalg.norm(b) > 0)
        want += [(q, r + 1, i) for r, (_, i) in enumerate(d[:3])]
    assert got == sorted(want, key=repr)


def test_csv_and_partitions(spark, tmp_path):
    (tmp_path / "runs.csv").write_text("﻿model,file,expected,status,latency_ms,prompt_tokens,completion_tokens,error\nm,f,OK,OK,12,,3,\n", "utf-8")
    r = evaluation_rows(spark, str(tmp_path / "runs.csv")).collect()
    assert [(x["model"], x["latency_ms"], x["prompt_tokens"], x["error"]) for x in r] == [("m", 12, None, None)]
    path = str(tmp_path / "t")
    replace_partitions(frame(spark, [(1, "a"), (2, "b")], "v int, k string"), path, ["k"])
    replace_partitions(frame(spark, [(3, "b")], "v int, k string"), path, ["k"])
    assert rows(spark.read.parquet(path).select("v", "k")) == [(1, "a"), (3, "b")]


def test_windowed_counts_of_a_stream(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    kind = "ts timestamp, event_type string, value double"
    query = None
    for batch in ([(at(1), "a", 1.0), (at(1, 30), "a", 2.0), (at(2), "b", None)], [(at(5), "a", 4.0)], [(at(1, 5), "a", 100.0), (at(9), "a", 1.0)]):
        frame(spark, batch, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = event_counts(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")).select(F.hour("start"), "event_type", "n", "total"))
    # The late row of the third batch came after the watermark had passed its window.
    assert got[:2] == [(1, "a", 2, 3.0), (2, "b", 1, None)] and all(g[3] != 103.0 for g in got)


def test_settled(spark):
    asked = frame(spark, [(1, 1), (1, 5), (2, 1)], "k int, at int")
    assert rows(settled(asked, frame(spark, [(1, 3), (None, 9)], "k int, at int"), ["k"], "at")) == [(1, 1)]


def test_diary_with_conflicts(spark, tmp_path):
    """Numbers that others take in between are given out again, alone; journal and bridge agree; a second conflict is an error."""
    from tillage.operators import records as D

    journal, bridge = str(tmp_path / "j"), str(tmp_path / "b")
    kind = "who string, id int, no int"
    frame(spark, [("a", 1, 1), ("a", 2, 2)], kind).write.parquet(journal)
    frame(spark, [], f"{kind}, prj int").write.parquet(bridge)
    new = frame(spark, [("a", 10, 7), ("a", 11, None), ("a", 12, 8), ("b", 13, 9)], "who string, id int, prj int")
    calls = []

    def others(every_time):
        def write():
            if every_time or not calls:
                there = max(r["no"] for r in spark.read.parquet(journal).collect())
                frame(spark, [("a", 100 + len(calls), there + 1)], kind).write.mode("append").parquet(journal)
            calls.append(1)

        return write

    given = D.write_diary(new, journal, bridge, ["who"], "no", "prj", F.asc("id"), meanwhile=others(False))
    want = {("a", 10, 6), ("a", 11, 4), ("a", 12, 5), ("b", 13, 1)}
    assert {(r["who"], r["id"], r["no"]) for r in given.collect()} == want and len(calls) == 2
    assert {tuple(r) for r in spark.read.parquet(journal).collect()} == {("a", 1, 1), ("a", 2, 2), ("a", 100, 3)} | want
    assert {tuple(r) for r in spark.read.parquet(bridge).collect()} == {("a", 10, 6, 7), ("a", 12, 5, 8), ("b", 13, 1, 9)}
    with pytest.raises(D.NumbersTaken):
        D.write_diary(new.filter("id = 10"), journal, bridge, ["who"], "no", "prj", F.asc("id"), meanwhile=others(True))


def test_suggestions(spark):
    """Against all pairs of rows and names."""
    from tillage.operators import records as D

    rng = random.Random(5)
    names = ["sow", "mow", "dig", "hay", ""]
    data = [(i, i, rng.choice("pqrst"), rng.random() < 0.2, rng.randrange(9), rng.choices(names, k=rng.randrange(3)), f"row {i}", rng.choice([None, i * 10])) for i in range(60)]
    got = rows(D.suggestions(frame(spark, data, "id int, at int, heading string, is_header boolean, score int, names array<string>, content string, price int"), 9))
    want = []
    for name in names[:-1]:
        seeds = [r for r in data if name in r[5]]
        if not seeds:
            continue
        near = [r for r in data if any(r[2] == s[2] or abs(r[1] - s[1]) <= 2 for s in seeds)]
        best = max(near, key=lambda r: (r[4], -r[0]))
        prices = [s[7] for s in seeds if s[7] is not None]
        own = best[7] if name in best[5] else None
        heads = sum(r[3] for r in near)
        want.append((name, len(seeds), heads, sum(s[4] for s in seeds) + 5 * heads, best[0], best[6], own if own is not None else max(prices, default=None)))
    assert got == sorted(want)


def test_evidence_rules(spark):
    from tillage.operators import records as D

    data = [
        (1, '{"count": "0", "method": " photo ", "basis": "b"}', None),
        (2, '{"method": ""}', "(증빙방법) : a report"),
        (3, '{"count": "x", "method": "m", "basis": "b"}', "line"),
        (4, '{"count": "3"}', " "),
        (5, "{}", ""),
        (6, "no json", None),
        (7, None, "증빙방법 photos"),
    ]
    got = D.normal_evidence(frame(spark, data, "i int, rule string, line string"), "rule", "line").select("i", "evidence_count", "evidence_method", "evidence_basis")
    assert rows(got) == [(1, 1, "photo", "b"), (2, 1, "a report", "(증빙방법) : a report"), (3, 1, "m", "line"), (4, 3, "", ""), (5, None, None, None), (6, None, None, None), (7, 1, "photos", "증빙방법 photos")]


def test_encodings(spark):
    from tillage.operators import extraction as X

    good = ["논물 관리", "plain", "", None, "caf\u00e9", "벼"]
    texts = good + [t.encode(page).decode("latin-1") for t in ("논물 관리", "벼") for page in ("utf-8", "cp949")]
    got = X.encoding_repaired(frame(spark, list(enumerate(texts)), "i int, t string"), "t")
    assert [r["t"] for r in got.orderBy("i").collect()] == [*good, "논물 관리", "논물 관리", "벼", "벼"]
    kana = X.encoding_repaired(frame(spark, [(1, "かな".encode("shift_jis").decode("latin-1"))], "i int, t string"), "t", ("shift_jis",), "[\u3040-\u30ff]")
    assert [r["t"] for r in kana.collect()] == ["かな"]


def test_aliases(spark):
    from tillage.operators import extraction as X

    places = frame(spark, [("p2", "Field", 2), ("p1", "rice field", 1), ("p3", "hay", 2), ("p4", "", 0)], "place string, alias string, prio int")
    texts = frame(spark, [(1, "The Rice FIELD"), (2, "a field of hay"), (3, "hay"), (4, "none"), (5, None)], "i int, t string")
    assert rows(texts.select("i", X.first_alias(texts, "t", places).alias("p"))) == [(1, "p1"), (2, "p2"), (3, "p3"), (4, None), (5, None)]
    with pytest.raises(ValueError):
        X.first_alias(texts, "t", places, most=2)
