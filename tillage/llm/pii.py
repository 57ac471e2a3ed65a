"""PII: high-recall generators propose overlapping spans, boosted trees score them by format and context, and calibrated
thresholds select those to redact.

The base spans of each kind (a pattern, leftmost and not overlapping, then a validity test) always stay. The generators
propose looser forms, which overlap each other and base spans: addresses with "at" and "dot" in words or brackets, phone
numbers without a plus or in longer runs of numbers, cards with other separators, in longer runs or with a digit wrong,
internet addresses with spaced or bracketed dots, and those of version 6. What lies within a base span adds nothing;
nor what crosses the edge of one; everything else is scored by the trees, and of overlapping candidates at or over their kind's threshold the best stays.

The trees are trained on the driver from EXAMPLES generated texts with a fixed seed, so the same model arises everywhere;
it is a few kilobytes. Personal and other examples share their formats and, in part, their contexts, as they do in real
texts; each kind's threshold is the least that reaches PRECISION on examples that the trees have not seen.

Positions are code points, ends exclusive. Null and empty texts have no spans. Rows are judged one by one, without a
shuffle; repeated rows give repeated results, and an empty table none. Whole texts are searched, in time about in
proportion to their length. Only the id and the text are read, so other columns can't clash. Of candidates with equal
scores the first in the text stays.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .texts import tidy

KINDS = ("email", "ip", "card", "phone")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits does, since what follows the run decides; so each run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Generators of further candidates.
_DOT = r"(?:\s?[\[({<]\s?(?:dot|punkt|punto|point|\.)\s?[\])}>]\s?|\s(?:dot|punkt|punto|point)\s|\s\.\s|\.)"
_AT = re.compile(r"[\[({<]\s?(?:at|@|a)\s?[\])}>]\s?|\sat\s|\s?@\s?", re.IGNORECASE)
_AT_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
_DOT_BEFORE = re.compile(rf"{_DOT}\Z", re.IGNORECASE)
#: Runs of groups of digits with what may stand between them in a number.
_RUN = re.compile(r"(?<![0-9A-Za-z])(?:\+|\()?[0-9]+(?:[\x20._/()-]{1,3}[0-9]+)*(?![0-9A-Za-z])")
_GROUP = re.compile(r"[0-9]+")
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\s?\.\s?|\sdot\s)[0-9]{1,3}){3}(?![0-9A-Za-z])", re.IGNORECASE)
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:|:)(?:[0-9A-Fa-f]{0,4}:)+[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
#: How the digits of cards are grouped.
CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))
PHONE_DIGITS, CARD_DIGITS = (7, 15), (12, 19)

#: Words before a span that speak for its kind, and words that speak against any.
FOR_KIND = {
    "email": ("mail", "contact", "kontakt", "write to", "correo", "courriel", "reach"),
    "ip": ("ip", "server", "host", "address", "login", "from"),
    "card": ("card", "visa", "master", "credit", "karte", "carte", "tarjeta", "pan"),
    "phone": ("phone", "tel", "call", "fax", "mobil", "whatsapp", "anruf", "appel", "llama", "handy"),
}
AGAINST = ("isbn", "order", "invoice", "token", "version", "ref", "serial", "code", "page", "sku", "hash", "ticket", "id ", "id:", "#", "year", "date")
CONTEXT = 28


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @ in turn, so that a long run without one costs nothing: the run of local characters before it,
    after the last match, and the domain behind it."""
    over, at = 0, text.find("@")
    while at >= 0:
        head = text[over:at]
        start = len(head.rstrip(LOCAL)) + over
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            over = m.end()
        else:
            over = at + 1
        at = text.find("@", over)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by start, then kind as listed."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _loose_emails(text: str) -> Iterator[tuple[int, int]]:
    """At each mark for "at" with a domain behind it: from the run of local characters before it, and from as far as such runs
    go on with marks for dots between them."""
    over = 0
    for m in _AT.finditer(text):
        if not (d := _AT_DOMAIN.match(text, m.end())):
            continue
        start = m.start() - (m.start() > over and text[m.start() - 1].isspace())

        def run(end: int) -> int:
            while end > over and text[end - 1] in LOCAL:  # noqa: B023
                end -= 1
            return end

        first = begin = run(start)
        if first == start:
            continue
        while (dot := _DOT_BEFORE.search(text, max(over, begin - 12), begin)) and (further := run(dot.start())) < dot.start():
            begin = further
        yield first, d.end()
        if begin < first:
            yield begin, d.end()
        over = m.end()


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """Phones and cards in runs of groups of digits: the whole run, and what begins within it as one may."""
    for run in _RUN.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, run.start(), run.end())]
        sizes = [b - a for a, b in groups]
        total = sum(sizes)
        if total < PHONE_DIGITS[0]:
            continue
        if CARD_DIGITS[0] <= total <= CARD_DIGITS[1]:
            yield "card", groups[0][0], groups[-1][1]
        for k, (a, b) in enumerate(groups):
            begin = a - (a > run.start() and text[a - 1] in "(+")
            if CARD_DIGITS[0] <= sizes[k] <= CARD_DIGITS[1]:
                yield "card", a, b
            for shape in CARD_GROUPS:
                if tuple(sizes[k : k + len(shape)]) == shape:
                    yield "card", a, groups[k + len(shape) - 1][1]
            if k == 0 or begin < a or text[a] == "0":
                begin = run.start() if k == 0 else begin
                n = 0
                for j in range(k, len(groups)):
                    n += sizes[j]
                    if n > PHONE_DIGITS[1]:
                        break
                    # A number ends before one that begins like another, or where the run does.
                    after = groups[j + 1][0] if j + 1 < len(groups) else None
                    if n >= PHONE_DIGITS[0] and (after is None or text[after] == "0" or text[after - 1] in "(+" or n >= 9):
                        yield "phone", begin, groups[j][1]


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Overlapping proposals, with high recall."""
    for a, b in _loose_emails(text):
        yield "email", a, b
    if _DIGIT.search(text):
        yield from _numbers(text)
        for m in _LOOSE_IP.finditer(text):
            yield "ip", *m.span()
    if text.count(":") > 1:
        for m in _IP6.finditer(text):
            yield "ip", *m.span()


def _valid_ip(own: str) -> bool:
    try:
        ipaddress.ip_address(re.sub(r"[\s\[\](){}]", "", own.lower().replace("dot", ".")))
        return True
    except ValueError:
        return False


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    own = text[start:end]
    small = own.lower()
    before = text[max(0, start - CONTEXT) : start].lower()
    digits = _digits(own)
    groups = [b - a for a, b in (m.span() for m in _GROUP.finditer(own))]
    joints = set(re.findall(r"[^0-9A-Za-z]+", own))
    tail = re.findall(r"[A-Za-z]+", own[-8:])
    for_kind = max((before.rfind(w) for w in FOR_KIND[kind]), default=-1)
    against = max((before.rfind(w) for w in AGAINST), default=-1)
    return [
        *(float(kind == k) for k in KINDS),
        float(len(own)),
        float(len(digits)),
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(len(joints)),
        float(len(set(digits))),
        float(kind == "card" and luhn(digits)),
        float(kind == "ip" and _valid_ip(own)),
        float(own[:1] in "(0+"),
        float(digits[:1] in ("3", "4", "5", "6")),
        float(any(c in own for c in "[{<")),
        float(kind == "email" and ("(at)" in small or "(@)" in small or "[at]" in small or "@" in small)),
        float(kind == "email" and any(w in small for w in ("dot", "punkt", "punto", "point"))),
        float(kind == "email" and " at " in small),
        # How near the last word for the kind and the last word against any stand; 0 for none.
        float(for_kind + 1 and CONTEXT + 1 + for_kind - len(before)),
        float(against + 1 and CONTEXT + 1 + against - len(before)),
        float(for_kind > against),
        float(text[start - 1 : start].isalnum() if start else 0),
        float(text[end : end + 1].isalnum()),
        float(text[start - 1 : start] in ("#", "$", "/", "=", "_", "-") if start else 0),
        float(len(tail[-1]) if tail and kind == "email" else 0),
    ]


def _example(rng: random.Random) -> tuple[str, str, int, int, int]:
    """A generated text with one candidate: text, kind, span, whether it is personal. Formats and cues are shared."""
    word = lambda: "".join(rng.choice(("th", "er", "an", "on", "re", "in", "de", "la", "ch", "ou", "es", "ti")) for _ in range(rng.randint(1, 4)))
    number = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    kind = rng.choice(("email", "phone", "card", "ip"))
    good = rng.random() < 0.5
    spoken = 0.5  # how often a personal example has a word for its kind before it
    if kind == "email":
        local = rng.choice((f"{word()}{number(rng.randint(0, 2))}", f"{word()}.{word()}", f"{word()}_{word()}", f"{word()} dot {word()}", f"{word()}[.]{word()}"))
        if good:
            at = rng.choice((" [at] ", "[at]", " (at) ", "(at)", " at ", " {at} ", "[@]", " @ ", "@ ", " <at> "))
            dot = rng.choice((" [dot] ", "[dot]", " (dot) ", "(dot)", " dot ", ".", "[.]", " . "))
            if at == " at " and dot == ".":
                spoken = 0.95  # "name at host.com" is an address only where something says so
            own = f"{local}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk'))}"
        elif rng.random() < 0.15:
            own = f"{local}{rng.choice((' [at] ', '(at)', ' at '))}{word()}{rng.choice((' [dot] ', '(dot)', ' dot '))}{rng.choice(('com', 'org'))}"  # a placeholder
        else:
            own = rng.choice((f"{word()} at {word()}.{word()}", f"{word()} at {word()}.{rng.choice(('com', 'org', 'net'))}", f"{word()} at {number(2)}.{number(2)}", f"{word()} at {word()} dot {word()}{word()}", f"{word()} at {word()} . {word()}", f"{word()} @ {number(1)}.{number(2)}"))
    elif kind == "phone":
        shared = (f"0{number(3)} {number(6)}", f"{rng.randint(2, 9)}{number(2)}-{number(3)}-{number(4)}", f"{rng.randint(1, 9)}{number(2)} {number(4)}", f"0{number(2)}.{number(3)}.{number(4)}")
        own = rng.choice((f"({number(3)}) {number(3)}-{number(4)}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", f"00{rng.randint(1, 9)}{number(1)} {number(3)} {number(7)}", f"+{rng.randint(1, 9)}{number(1)} {number(3)} {number(7)}", f"0{number(3)}/{number(6)}", *shared)) if good else rng.choice((f"{number(4)}-{number(2)}-{number(2)}", f"{rng.randint(1, 9)}{number(1)}.{number(2)}.{number(4)}", f"{rng.randint(1, 9)}{number(3)}-{number(4)}", f"{rng.randint(1, 9)} {number(3)} {number(3)}", f"{rng.randint(1, 9)}{number(2)} {number(5)} {number(4)}", number(rng.randint(7, 12)), *shared))
        if good and own[0] not in "(+0":
            spoken = 0.9
    elif kind == "card":
        n = rng.choice((13, 15, 16, 16, 16, 19))
        digits = rng.choice("3456") + number(n - 2) if good or rng.random() < 0.5 else number(n - 1)
        passing = next(str(c) for c in range(10) if luhn(digits + str(c)))
        wrong = rng.random() < (0.3 if good else 0.9)
        digits += str((int(passing) + rng.randint(1, 9)) % 10) if wrong else passing
        mark = rng.choice((".", "/", "_", " - ", "  ", "-", " ", ""))
        own = mark.join(digits[k : k + 4] for k in range(0, n, 4)) if n in (16, 19) else digits
        if good and wrong:
            spoken = 0.95  # without a right check digit only the context speaks for a card
    else:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        if good:
            own = rng.choice(("[.]", " . ", "(.)", "[dot]", " dot ", ". ")).join(parts) if rng.random() < 0.7 else ":".join(f"{rng.getrandbits(16):x}" for _ in range(8)) if rng.random() < 0.5 else f"2001:{rng.getrandbits(16):x}::{rng.getrandbits(16):x}:{rng.randint(1, 9)}"
        elif rng.random() < 0.15:
            own = rng.choice((" . ", "[.]", ". ")).join(parts)  # a version or a section
        else:
            own = rng.choice((". ".join(str(rng.randint(1, 40)) for _ in range(4)), " . ".join(number(3) for _ in range(4)), f"{number(2)}:{number(2)}:{number(2)}", f"{number(2)}:{number(2)}:{number(2)}:{number(2)}", f"{rng.getrandbits(8):x}:{rng.getrandbits(8):x}:{rng.getrandbits(8):x}"))
    draw = rng.random()
    if good:
        cue = "for" if draw < spoken else "none" if draw < spoken + 0.9 * (1 - spoken) else "against"
    else:
        cue = "for" if draw < 0.04 else "none" if draw < 0.5 else "against"
    lead = {"for": f"{rng.choice(FOR_KIND[kind])}{rng.choice((': ', ' ', ' no '))}", "none": f"{word()} ", "against": f"{rng.choice(AGAINST)}{rng.choice((' ', ': '))}"}[cue]
    head = f"{' '.join(word() for _ in range(rng.randint(0, 3)))} {lead}"
    return head + own + rng.choice((".", " ", ", ", "", "!!")) + " " + word(), kind, len(head), len(head) + len(own), int(good)


#: Generated examples, two thirds of them for the trees; and what each kind's threshold must reach on the others.
EXAMPLES, PRECISION = 8000, 0.9


@lru_cache(2)
def trained(examples: int = EXAMPLES, seed: int = 7, precision: float = PRECISION) -> tuple[boosting.Trees, dict[str, float]]:
    """Trees on two thirds of the generated examples, and for each kind the threshold that the rest calibrates."""
    rng = random.Random(seed)
    rows = [_example(rng) for _ in range(examples)]
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows])
    y = np.array([r[4] for r in rows], float)
    cut = examples * 2 // 3
    model = boosting.fit(x[:cut], y[:cut], trees=60, depth=4)
    p = model.probability(x[cut:])
    of = np.array([r[1] for r in rows[cut:]])
    return model, {k: boosting.threshold(p[of == k], y[cut:][of == k], precision) if (of == k).any() else 1.1 for k in KINDS}


#: Candidates that are scored at once.
_AT_ONCE = 4096


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model: boosting.Trees, limits: dict[str, float]) -> list[list[tuple[str, int, int]]]:
    """For each text the candidates that the trees select, best first; none within or across the edge of a base span, none over
    a better one. One that holds whole base spans and more may be added."""
    flat: list[tuple[int, tuple[str, int, int]]] = []
    for i, (text, own) in enumerate(zip(texts, base)):
        starts, reach, most = [a for _, a, _ in own], [], 0
        for _, _, b in own:
            reach.append(most := max(most, b))
        for c in dict.fromkeys(candidates(text)):
            # Base spans that begin before its start must end there, those that begin within it must end within it.
            before, within = bisect_left(starts, c[1]), bisect_left(starts, c[2])
            if (not before or reach[before - 1] <= c[1]) and (before == within or reach[within - 1] <= c[2]) and (c[1], c[2]) not in ((a, b) for _, a, b in own[before:within]):
                flat.append((i, c))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    scores = [model.probability(np.array([features(texts[i], *c) for i, c in flat[k : k + _AT_ONCE]])) for k in range(0, len(flat), _AT_ONCE)]
    if not scores:
        return out
    p = np.concatenate(scores)
    # Addresses that end alike differ in how far their local part goes back: they count alike, and the longer stays.
    alike: dict[tuple[int, int], float] = {}
    for (i, (kind, _, b)), q in zip(flat, p.tolist()):
        if kind == "email":
            alike[i, b] = max(q, alike.get((i, b), 0.0))
    p = np.array([alike[i, b] if kind == "email" else q for (i, (kind, _, b)), q in zip(flat, p.tolist())])
    taken: list[list[tuple[int, int]]] = [[] for _ in texts]
    for k in np.lexsort([[-(b - a) for _, (_, a, b) in flat], -p]).tolist():
        i, (kind, a, b) = flat[k]
        if p[k] < limits[kind]:
            continue
        at = bisect_left(taken[i], (a, b))
        if (at and taken[i][at - 1][1] > a) or (at < len(taken[i]) and taken[i][at][0] < b):
            continue
        taken[i].insert(at, (a, b))
        out[i].append((kind, a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first, in angle brackets."""
    parts, over = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= over:
            parts += [text[over:a], f"<{kind.upper()}>"]
        over = max(over, b)
    return "".join([*parts, text[over:]])


def _texts(column: pa.Array) -> list[str]:
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id, the base spans' counts by kind, the digest of the base spans, all spans, the number added."""
    model, limits = trained()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    head = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, model, limits)
            counts = [pa.array([sum(k == kind for k, _, _ in own) for own in base], pa.int64()) for kind in KINDS]
            digests = [hashlib.sha256(joined(own).encode()).hexdigest() for own in base]
            spans = [joined(own + extra) for own, extra in zip(base, more)]
            yield pa.record_batch(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(map(len, more), pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return source.mapInArrow(tidy(run), f"doc_id {head}, {FOUND}")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced; a null text stays null, other columns stay as they are."""
    model, limits = trained()
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(at))
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, model, limits)
            missing = batch.column(at).is_null().to_pylist()
            new = [None if gone else redacted(t, own + extra) if own or extra else t for t, own, extra, gone in zip(texts, base, more, missing)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)
