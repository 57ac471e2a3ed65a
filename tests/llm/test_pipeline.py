"""The corpus pipeline against plain versions of its stages, one after the other."""

from __future__ import annotations

import base64
import re

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tillage.llm import pii, quality_rules

from .test_brute_force import docs_of, folder, plain_contamination, plain_words, table  # noqa: F401
from .test_near_copies import least_ids


def plain_kept(text):
    t = text or ""
    w = plain_words(t)
    n = len(w)
    windows = {}
    for k in range(n - 7):
        windows.setdefault(tuple(w[k : k + 8]), []).append(k)
    hit = {x for own in windows.values() if len(own) > 1 for k in own for x in range(k, k + 8)}
    lines = [x for x in t.split("\n") if plain_words(x)]
    if n < 20 or 100 * len(hit) > 30 * n or n > 1_000_000:
        return False
    chars, stops = sum(map(len, w)), sum(x.lower() in quality_rules.STOP_WORDS for x in w)
    symbols, twins = len(re.findall(r"[#*$%&|<>]", t)), sum(a == b for a, b in zip(w, w[1:]))
    bullets = sum(bool(re.match(r"[\x20\x09]*[-*•]", x)) for x in lines)
    dots = sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)
    return (
        200 * n <= 100 * chars <= 1500 * n
        and 100 * symbols <= 10 * n
        and 100 * stops >= 5 * n
        and 100 * twins <= 20 * n
        and 100 * (len(lines) - len(set(lines))) <= 60 * len(lines)
        and 100 * bullets <= 90 * len(lines)
        and 100 * dots <= 30 * len(lines)
    )


def test_quality_verdicts(spark, folder):  # noqa: F811
    """The method's own rules, too."""
    from tillage.llm import queries

    expected = sorted(((i, plain_kept(t)) for i, t in docs_of(spark, folder)), key=repr)
    assert sorted((tuple(r) for r in queries.op4_quality_rules(spark, folder).select("doc_id", "kept").collect()), key=repr) == expected


def expected_of(spark, at):
    import tiktoken

    docs = [(i, t) for i, t in dict.fromkeys(docs_of(spark, at)) if plain_kept(t)]
    staying = set(least_ids([(i, t) for i, t in docs if i is not None]))
    docs = [(i, t) for i, t in docs if i is None or i in staying]
    hit = {r[0] for r in plain_contamination(docs, table(spark, at, "benchmark", "item_id", "text")) if r[5]}
    docs = [(i, t) for i, t in docs if i not in hit]
    model, limits = pii.trained()
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for i, t in docs:
        base = pii.base_spans(t)
        clean = pii.redacted(t, base + pii.added_spans([t], [base], model, limits)[0])
        expected[i] = own.encode_ordinary(clean)
    return expected


def test_pipeline(spark, folder):  # noqa: F811
    """Over the small tables, odd rows with columns that clash, and empty tables."""
    expected = expected_of(spark, folder)
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: [int.from_bytes(r["ids"][k : k + 4], "little") for k in range(0, len(r["ids"]), 4)] for r in got} == expected
    assert len(got) == len(expected)


def test_columns(spark, tmp_path):
    """Whatever the other columns are called, the stages don't change what they hold; n_chars follows the text, where there is one."""
    good = " ".join(f"the word{k} of my text is here" for k in range(30)) + " mail me at some.one@example.org"
    names = ["n_words", "kept", "base_failed", "_text", "_words", "_row", "row", "id", "text2", "node", "component", "nth", "_id", "_nth", "doc_id2", "c0", "word_chars", "hits", "spans", "block", "point", "rep", "fp", "n", "label", "_n", "_key"]
    docs = spark.createDataFrame([(1, good, *["mine"] * len(names)), (2, good, *["other"] * len(names)), (None, f"{good} once more", *["third"] * len(names))], ", ".join(["doc_id long, text string", *[f"{c} string" for c in names]]))
    bench = tmp_path / "benchmark.parquet"
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(str(bench))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = sorted(out.collect(), key=repr)
        assert {tuple(set(r[2:])) for r in rows} == {("mine",), ("third",)} if stage is not corpus_pipeline.quality else {("mine",), ("other",), ("third",)}
        docs = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert [c for c in last.columns if c not in ("n_tokens", "ids", "token_bytes")] == [c for c in docs.columns if c != "text"]
    assert {r["_text"] for r in last.collect()} == {"mine", "third"}
    clean = corpus_pipeline.personal_data(spark, docs.withColumn("n_chars", F.lit(7).cast("long")), "").collect()
    assert all(r["n_chars"] == len(r["text"]) and "<EMAIL>" in r["text"] for r in clean)
