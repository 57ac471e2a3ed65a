"""Added spans: recall and precision on labelled text made from the corpus, long texts, and odd rows."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest

from tillage.llm import pii

CUES = {"email": ("mail ", "contact: "), "ip": ("server ", "ip "), "card": ("card ", "Visa: "), "phone": ("call ", "tel: ")}


def planted(rng):
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind, name = rng.choice(pii.KINDS), "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    if kind == "email":
        return kind, rng.choice((f"{name} [at] {name}x [dot] com", f"{name}(at){name}x.org", f"{name} at {name}x dot net", f"{name}.{name} @ {name}x . de", f"{name} dot {name} [at] {name}x.com", f"{'a' * 90}{name} [at] {name}x.com"))
    if kind == "ip":
        return kind, rng.choice(("[.]", " . ", "[dot]", " dot ")).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        digits = rng.choice("3456") + number(14)
        digits += next(str(c) for c in range(10) if pii.luhn(digits + str(c)))
        return kind, rng.choice((".", "/", "_", " - ")).join(digits[k : k + 4] for k in range(0, 16, 4))
    return kind, rng.choice((f"({number(3)}) {number(3)}-{number(4)}", f"0{number(3)} {number(6)}", f"00{rng.randint(1, 9)}{number(1)} {number(3)} {number(7)}", f"0{number(3)}/{number(6)}"))


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("text").collect()
    return [r["text"] for r in rows if r["text"]]


def test_recall_and_precision(corpus):
    """Spaced, dotted and bracketed forms at random places of documents without personal data, three in five after a word for them."""
    rng = random.Random(11)
    texts, truth = [], []
    for text in [t for t in corpus if len(t) > 300 and not pii.base_spans(t)]:
        words = text.split(" ")
        at = rng.randrange(1, len(words))
        kind, form = planted(rng)
        head = f"{' '.join(words[:at])} {rng.choice(CUES[kind]) if rng.random() < 0.6 else ''}"
        texts.append(f"{head}{form} {' '.join(words[at:])}")
        truth.append((kind, len(head), len(head) + len(form)))
    model, limits = pii.trained()
    base = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(texts, base, model, limits)
    total, proposed, found, wrong = Counter(), Counter(), Counter(), 0
    for text, own, b, more in zip(texts, truth, base, added):
        total[own[0]] += 1
        proposed[own[0]] += own in pii.candidates(text) or own in b
        found[own[0]] += own in more or own in b
        wrong += sum(m != own for m in more)
    assert min(total.values()) > 50
    for kind in pii.KINDS:
        assert proposed[kind] >= 0.98 * total[kind], kind
        assert found[kind] >= 0.85 * total[kind], kind
    assert sum(found.values()) >= 0.97 * (sum(found.values()) + wrong)


def test_thresholds_are_calibrated():
    _, limits = pii.trained()
    assert all(0 < limits[k] < 1 for k in pii.KINDS) and len(set(limits.values())) == 4


def test_clean_documents_are_left_alone(corpus):
    model, limits = pii.trained()
    base = [pii.base_spans(t) for t in corpus]
    clean = [t for t, b in zip(corpus, base) if not b]
    assert sum(map(bool, pii.added_spans(clean, [[] for _ in clean], model, limits))) <= 0.01 * len(clean)


def test_long_texts():
    """Many spans in one text, and long runs of what spans are made of, in time about in proportion."""
    model, limits = pii.trained()
    many = " ".join(f"a{i}@b.com 10.0.0.{i % 255}, mail me{i} [at] host dot com" for i in range(4000))
    for text in (many, "1" * 200_000, "a." * 100_000 + " at b.c", "a dot " * 30_000 + "a at b dot c", "a at " * 50_000, "0170 " * 40_000, "::" * 50_000):
        began = time.process_time()
        base = pii.base_spans(text)
        added = pii.added_spans([text], [base], model, limits)[0]
        assert time.process_time() - began < 20
        spans = sorted(added, key=lambda s: s[1])
        assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    base = pii.base_spans(many)
    assert len(base) == 8000 and len(pii.added_spans([many], [base], model, limits)[0]) >= 3900


def test_base_spans_stay(spark):
    """Added spans are neither within nor across the edge of a base span; redacted texts hold none of either."""
    rows = [(1, "card 4111 1111 1111 1111 2024, call 0170 5551234", "x"), (2, "+1 (826) 555-4081 190.137.223.204", "y"), (3, None, "z"), (3, "", "z"), (None, "mail: joe [at] host dot com joe@host.com", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = {r["doc_id"]: r for r in pii.find(df.filter("text <> ''")).collect()}
    assert set(found[2]["spans"].split(",")) == {"ip:18:33", "phone:0:17"}
    assert "email:6:27" in found[None]["spans"] and found[None]["n_email"] == 1
    out = pii.redact(df)
    assert out.columns == df.columns
    got = {(r["doc_id"], r["spans"]): r["text"] for r in out.filter("text IS NULL OR text <> ''").collect()}
    assert got[2, "y"] == "<PHONE> <IP>" and got[3, "z"] is None and got[None, "w"] == "mail: <EMAIL> <EMAIL>"
    assert pii.find(df.limit(0)).count() == 0
