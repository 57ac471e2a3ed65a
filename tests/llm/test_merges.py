"""Merging of many pieces at once against merging by its definition."""

from __future__ import annotations

import random

from tillage.llm.bpe import LONG_PIECE, Merger


def by_definition(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while piece not in ranks:
        least = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if least is None:
            return [ranks[p] for p in parts]
        i = least[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[piece]]


def vocabulary(rng, n, every=True):
    """Single bytes, and tokens put together from earlier ones; also some that no merge leads to."""
    tokens = [bytes([b]) for b in range(256) if every or b < 250]
    letters = tokens[97:101]
    while len(tokens) < n:
        t = rng.choice(letters + tokens[256:]) + rng.choice(letters + tokens[256:])
        tokens += [t] if t not in tokens and len(t) < 20 else []
        odd = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(2, 7)))
        tokens += [odd] if rng.random() < 0.1 and odd not in tokens else []
    return {t: k for k, t in enumerate(tokens)}


def test_lots():
    """Ties within a piece, pieces of one byte, of one letter, longer than LONG_PIECE, repeated, none at all, and in several lots."""
    rng = random.Random(11)
    for n, every in ((256, True), (300, True), (700, True), (600, False)):
        ranks = vocabulary(rng, n, every)
        lot = [bytes(rng.choice(b"abcdz") for _ in range(rng.randrange(1, 70))) for _ in range(1500)]
        lot += [b"a" * k for k in range(1, LONG_PIECE + 10)] + [b"ab" * k for k in range(1, 40)] + [b"a", b"a", b"z"]
        ids, counts = Merger(ranks)._resolve(lot)
        want = [by_definition(p, ranks) for p in lot]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
        none = Merger(ranks)._resolve([])
        assert len(none[0]) == len(none[1]) == 0


def test_pieces_of_a_text():
    """Pieces that come again have the ids of the first, also past the cache's size; ids decode to the text."""
    rng = random.Random(5)
    merger = Merger(vocabulary(rng, 500), most=20)
    for _ in range(5):
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(400)]
        cuts = [0]
        for p in pieces:
            cuts.append(cuts[-1] + len(p))
        ids, counts = merger.encode(b"".join(pieces), cuts)
        want = [by_definition(p, merger.ranks) for p in pieces]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
        assert merger.decode(ids) == b"".join(pieces)
    ids, counts = merger.encode(b"", [0])
    assert len(ids) == len(counts) == 0 and merger.decode(ids) == b""
