"""The packers, splitters, matches and the diversity ranking against plain versions, over the tables."""

from __future__ import annotations

import difflib
import re

import pytest

from pyspark.sql import functions as F

from tillage.operators import chunking as C
from tillage.operators import retrieval as V
from tillage.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def turns(spark, sf_dir):
    out = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        out.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    return {k: sorted(v) for k, v in out.items()}


def chunks(spark, sf_dir, name):
    out = {}
    for r in sorted(QUERIES[name](spark, sf_dir).collect(), key=lambda r: (r["doc_id"], r["chunk"])):
        assert r["chunk"] == len(out.setdefault(r["doc_id"], []))
        out[r["doc_id"]].append(r["content"])
    return out


def test_packed(spark, sf_dir, documents):
    want = {}
    for i, text in documents.items():
        groups = [[]]
        for block in re.split(r"\n", text):
            block = block.strip()
            pieces = [block[k : k + 700] for k in range(0, len(block), 700)]
            for n, piece in enumerate(pieces):
                # A block joins the open chunk if all of it fits; of one that is cut only the last piece stays open.
                room = sum(map(len, groups[-1])) + len(groups[-1]) + len(block if n == 0 else piece)
                if groups[-1] and (n > 0 or room > 700):
                    groups.append([])
                groups[-1].append(piece)
        if own := [c for c in ("\n".join(g) for g in groups) if len(c) >= 20]:
            want[i] = own
    assert chunks(spark, sf_dir, "d5_pack") == want


def test_blocks(spark, sf_dir, turns):
    want = {}
    for i, rows in turns.items():
        groups = []
        for _, role, text in rows:
            if not text.strip():
                continue
            if not groups or groups[-1][0] != role or sum(len(t) + 1 for t in groups[-1][1]) + len(role) + len(text) + 3 > 800:
                groups.append((role, []))
            groups[-1][1].append(text)
        if groups:
            want[i] = ["\n".join(t.strip() for t in own) for _, own in groups]
    assert chunks(spark, sf_dir, "d6_blocks") == want


def test_merged(spark, sf_dir, turns):
    want = {}
    for i, rows in turns.items():
        out = []
        for turn, _, text in rows:
            head, text = ("A", "A > B", "C")[turn % 3], text.strip()
            if not text:
                continue
            if out and (head == out[-1][0] or head.startswith(out[-1][0] + " > ")) and len(out[-1][1]) + 2 + len(text) <= 780:
                out[-1] = (out[-1][0], out[-1][1] + "\n\n" + text)
            else:
                out.append((head, text))
        if out:
            want[i] = [t for _, t in out]
    assert chunks(spark, sf_dir, "d7_merge") == want


def test_absorbed(spark, sf_dir, turns):
    want = {}
    for i, rows in turns.items():
        texts = [t for *_, t in rows]
        short = [len(t) <= 40 for t in texts]
        leads = [k + 1 < len(texts) and short[k] and not short[k + 1] for k in range(len(texts))]
        want[i] = [f"{texts[k - 1]}\n{t}" if k and leads[k - 1] else t for k, t in enumerate(texts) if not leads[k]]
    assert chunks(spark, sf_dir, "n6_absorb") == want


@pytest.mark.parametrize(("name", "most", "overlap"), [("d9_split", 800, 40), ("d10_recursive", 800, 120)])
def test_split(spark, sf_dir, documents, name, most, overlap):
    """Pieces stand in the text, in order, no longer than they may be, share no more than they may, and leave only blanks out."""
    got = chunks(spark, sf_dir, name)
    for i, text in documents.items():
        end, at = 0, 0
        for piece in got.get(i, []):
            assert 0 < len(piece) <= most
            at = text.find(piece, max(at, end - overlap - 1))
            assert at >= 0 and not text[end:at].strip()
            end = max(end, at + len(piece))
        assert not text[end:].strip()


def test_streams_of_odd_rows(spark):
    rows = [(2, 1, "a", None), (1, 2, None, "z" * 900), (1, 1, "a", "x"), (3, 1, "a", " "), (1, 1, "a", "x"), (2, 2, "a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, at long, title string, content string")
    assert sorted(tuple(r) for r in C.packed_blocks(df).collect()) == [(1, 0, "x\nx"), (1, 1, "z" * 900), (2, 0, "y")]
    assert C.packed_blocks(df.limit(0)).count() == 0
    assert sum(r["content"].count("x") for r in C.packed_blocks(spark.createDataFrame([(1, k, "t", "x") for k in range(5000)], df.schema)).collect()) == 5000


def test_best_match(spark, sf_dir):
    choices = ["small ring", "widgets", "iron rod"]
    names = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}

    def like(a, b):
        x, y = a.lower().replace(" ", ""), b.lower().replace(" ", "")
        u, v = set(a.lower().split()), set(b.lower().split())
        return 1.0 if x == y else min(1.0, 0.72 * difflib.SequenceMatcher(None, x, y).ratio() + 0.28 * len(u & v) / len(u | v) + 0.12 * (x in y or y in x))

    for r in QUERIES["e5_best_match"](spark, sf_dir).collect():
        best = max(choices, key=lambda c: like(names[r["p_partkey"]], c))
        score = like(names[r["p_partkey"]], best)
        assert (r["choice"], r["score"]) == ((best, round(score, 6)) if score >= 0.46 else (None, None))


def test_diverse(spark):
    import random

    rng = random.Random(4)
    rows = [(q, i, rng.randrange(5), [rng.choice("abcdef") for _ in range(rng.randrange(6))]) for q in range(6) for i in range(rng.randrange(1, 9))]
    got = {}
    for r in sorted(V.diverse(spark.createDataFrame(rows, "query_id long, id long, score int, tokens array<string>"), 4).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    for q in range(6):
        own = {i: (s, set(t)) for k, i, s, t in rows if k == q}
        low, high = min(s for s, _ in own.values()), max(s for s, _ in own.values())
        chosen = []
        while len(chosen) < min(4, len(own)):
            gain = {}
            for i, (s, t) in own.items():
                if i not in chosen:
                    near = [len(t & own[c][1]) / len(t | own[c][1]) if t | own[c][1] else 0.0 for c in chosen]
                    gain[i] = 0.7 * ((s - low) / (high - low) if high > low else 1.0) - (1 - 0.7) * max(near, default=0.0)
            chosen.append(min(i for i in gain if gain[i] == max(gain.values())))
        assert got[q] == chosen


def test_tokens(spark):
    """The words and bigrams of a text against a plain version; a long text takes no longer for each of its characters than a short one."""
    import time

    long = " ".join(f"Word{k} and\n{k * 7919 % 1000}" for k in range(16_000))
    texts = ["", "a", " ab ", "Ab c\tD", "x 😀y\n😀", "née_1, NÉE_1", None, long]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    begun = time.monotonic()
    got = {r["id"]: r["tokens"] for r in df.select("id", V.tokens(F.col("text")).alias("tokens")).collect()}
    took = time.monotonic() - begun
    for i, text in enumerate(texts):
        if text is None:
            assert got[i] is None
            continue
        flat = re.sub(r"\s+", "", text.lower())
        assert len(got[i]) == len(set(got[i]))
        assert set(got[i]) == set(re.findall(r"\w+", text.lower())) | {flat[k : k + 2] for k in range(len(flat) - 1)}
    assert took < 20


def test_diverse_without_text(spark, sf_dir, tmp_path):
    """A document without text is a candidate like any other."""
    for name in ("embeddings", "documents"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df = df.withColumn("text", F.lit(None).cast("string")) if name == "documents" else df
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = QUERIES["v6_diverse"](spark, str(tmp_path)).collect()
    assert got and {r["rank"] for r in got} == {1, 2, 3, 4, 5}


def test_texts_in_small_pieces():
    """A task takes a few texts apart at a time, however many a batch holds; a long one alone, nulls and empty ones as they come."""
    import pyarrow as pa

    class Docs:
        """Stands for a DataFrame, to get at the function that a task runs."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    line = "né one line of a text of some length " * 4
    texts = ["\n".join([line] * 150)] * 300 + [None, "", "\n".join([line] * 20_000)] + [line] * 5
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    out = list(C.packed(Docs())([batch, batch.slice(0, 0)]))
    assert len(out) > 5 and all(b.nbytes < 1.5 * C.AT_ONCE or len(set(b["doc_id"].to_pylist())) == 1 for b in out)
    got = [tuple(r) for b in out for r in zip(*(c.to_pylist() for c in b.columns))]
    assert got == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(C.pack_paragraphs(t or ""))]
