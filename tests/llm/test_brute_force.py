"""Each operator against a plain version of it, over the small tables and over a fixture of odd rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tillage.llm import decontamination, queries, substring_dedup, url_filter

BLANK = re.compile(r"[\x20\x09-\x0D]+")
PASSAGE = " ".join(f"word{i}" for i in range(60))


def plain_words(text):
    return [w for w in BLANK.split(text or "") if w]


def thue_morse(letters, n=1024):
    return "".join(letters[k.bit_count() % 2] for k in range(n))


ODD = [
    (1, None),
    (2, ""),
    (3, "  \n\t "),
    (4, "one two three"),
    (5, "one two three"),
    (6, f"start {PASSAGE} end"),
    (7, f"Other beginning, {PASSAGE}\nother end it's 'Re I'VE we'll  \n x"),
    (7, f"Other beginning, {PASSAGE}\nother end it's 'Re I'VE we'll  \n x"),
    (8, "a b c d e f g h " * 40),
    (9, "mail me: a.b+c@mail.example.com, +49 170 1234567 or 192.168.0.255 and 4111 1111 1111 1111 x@y@z.de 1.2.3.4.5 999.1.1.1"),
    (10, "été 논물 ﬁ \u00a0\u2003x 12３4 \U0001f600\U0001f600 don't\u2028stop " * 7),
    (11, "x" * 5000 + " 1" * 300),
    (12, "phone 0170 555 1234 and user [at] host [dot] com"),
    (None, "no id here but some words to count and to keep, the and of it"),
    (13, "- bullet\n- bullet\n\n#tag $x &amp; <b>...\nline…\n"),
    (14, PASSAGE.upper()),
    (15, " ".join(["same"] * 120)),
    (16, "hello <|endoftext|> world<|startoftext|>x <|ENDOFTEXT|> <|endoftext|<|endoftext|><|startoftext"),
    (17, "|> <|endof"),
    (18, "text|> <|endoftext|>"),
    # One word and its complement, which collide in polynomials modulo a power of two, and the same as words of texts.
    (19, f"{thue_morse('ab')} " + " ".join(f"k{i}" for i in range(34))),
    (20, f"{thue_morse('ba')} " + " ".join(f"k{i}" for i in range(34))),
    (21, " ".join(thue_morse("ab"))),
    (22, " ".join(thue_morse("ba"))),
    # Longer than a slice.
    (23, " ".join(f"w{k * k % 5003} is the t{k % 77}" for k in range(90_000))),
]


@pytest.fixture(scope="module", params=["sf", "odd", "none"])
def folder(request, spark, sf_dir, tmp_path_factory):
    """The small tables; the odd rows with extra columns that clash; empty tables."""
    if request.param == "sf":
        return sf_dir
    at = str(tmp_path_factory.mktemp(request.param))
    rows = ODD if request.param == "odd" else []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("lang", "source", "ids", "row", "block", "spans", "kept", "fp", "_text"):
        docs = docs.withColumn(name, F.lit("de"))
    docs.withColumn("n_chars", F.length("text").cast("long")).repartition(3).write.parquet(f"{at}/documents.parquet")
    bench = [(1, PASSAGE.title()), (2, "one, TWO; three"), (3, ""), (4, None), (5, "not there at all " * 9), (6, PASSAGE), (7, f"{thue_morse('ba')} " + " ".join(f"k{i}" for i in range(9))), (8, "same " * 50)] if rows else []
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    long_page = "<p>" + "0123456789" * 9000
    pages = [
        (1, "http://EXAMPLE.net/en/x?q", long_page),
        (2, "https://a.Example.net/en/", long_page),
        (3, None, None),
        (4, "no mark", ""),
        (5, "http://www.example.com/de/x#y", "short"),
        (6, "ftp://fr.org/fr/", "short"),
        (7, "http://org/fr", "é" * 600),
        (7, "http://org/fr", "é" * 600),
        (None, "x://badexample.com/de/", "é" * 600),
        (9, "http://net", "a\r\n0\r\n\r\n" * 300),
        (10, "http://xnet/", "a\r\n0\r\n\r\n" * 300),
    ] if rows else []
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("h")).write.parquet(f"{at}/pages.parquet")
    labels = [(i, i % 2, 0) for i in range(1, 14)] + [(99, 1, 0), (None, 1, 0), (6, None, 0)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, folder, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


def docs_of(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_bpe(spark, folder):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t in docs_of(spark, folder):
        ids = own.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(t or "")))
    assert rows_of(queries.op1_byte_bpe(spark, folder)) == sorted(expected, key=repr)


def test_url_filter(spark, folder):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    expected = []
    for i, u in table(spark, folder, "pages", "page_id", "url"):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1], m[2]) if m else ("", "")
        host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
        fits = []
        for r in rules:
            h, _, p = r.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append(r)
        best = max(fits, key=len, default=None)
        expected.append((i, host, path, best, rules.get(best, "allow")))
    got = queries.op2_url_filter(spark, folder).select("page_id", "host", "path", "rule", "verdict")
    assert rows_of(got) == sorted(expected, key=repr)


def test_bpe_offsets(spark, folder):
    """The byte lengths kept with the ids cut each text into its tokens, and the ids decode to the text."""
    import numpy as np

    from tillage.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = {rank: token for token, rank in bpe.read_ranks(path).items()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.col("text").alias("kept"))
    for r in bpe.decode(bpe.encode(docs, path), path).collect():
        data = (r["kept"] or "").encode()
        ids, ends = np.frombuffer(r["ids"], "<u4").tolist(), np.cumsum(np.frombuffer(r["token_bytes"], "<u4")).tolist()
        assert bytes(r["decoded"]) == data and len(ids) == r["n_tokens"] == len(ends)
        assert all(data[a:b] == tokens[i] for i, a, b in zip(ids, [0, *ends], ends))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("b.org", "/fr/x", "block"), ("", "/x", "block")]


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_url_filter_both_ways(spark, most_bytes):
    """The array and, for rule tables beyond the bound, the join: the same rows, with columns that clash and odd urls."""
    urls = ["http://EXAMPLE.net/en/x?q", "https://a.Example.net/fr", None, "", "no mark", "http://", "://net/", "a://b://net/x", "http://b.org/fr/xy#z", "http://a.b.org/fr/x/", "http://org/fr", "http://x.example.com/de/?/", "http://ne\nt/", "http://net./", "http://..net/a" + "/b" * 300, "HTTP://É.NET/"]
    df = spark.createDataFrame([(k, u, "u", "r", "c", "row") for k, u in enumerate([*urls, urls[0]])], "id long, url string, _u string, _r string, host string, row string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    expected = []
    for k, u in enumerate([*urls, urls[0]]):
        _, mark, rest = (u or "").partition("://")
        rest = re.split("[?#]", rest)[0] if mark else ""
        host, slash, path = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), host), slash + path
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        expected.append((k, "u", "row", host, path, best[1], best[2]))
    got = url_filter.judge(df, rules, ["id", "_u", "host", "row"], most_bytes=most_bytes)
    assert got.columns == ["id", "_u", "row", "host", "path", "rule", "verdict"]
    assert rows_of(got) == sorted(expected, key=repr)
    none = url_filter.judge(df, rules.limit(0), ["id"], most_bytes=most_bytes - 1)
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == len(expected)
    kept = url_filter.keep_allowed(df, rules)
    assert kept.columns == df.columns and sorted(r["id"] for r in kept.collect()) == [r[0] for r in expected if r[-1] == "allow"]
    assert {r["host"] for r in kept.collect()} == {"c"}
    with pytest.raises(ValueError, match="different verdicts"):
        url_filter.judge(df, rules.union(rules.selectExpr("host", "path", "'allow'")), ["id"])


def test_digest_collisions(tmp_path):
    """Rules whose digests are the same are told apart by their texts."""
    import numpy as np

    from tillage.llm.url_filter import DigestArray, build

    path = tmp_path / "rules.bin"
    data = bytearray(build([(f"h{k}", "/", "block" if k % 2 else "allow") for k in range(6)]))
    data[24 + 8 : 24 + 8 + 48] = np.full(6, np.array(7, np.uint64)).tobytes()
    path.write_bytes(bytes(data))
    array = DigestArray(str(path))
    import unittest.mock

    with unittest.mock.patch("xxhash.xxh64_intdigest", lambda _: 7):
        found = array.find(["h3/", "h9/", "h0/"])
    assert [array.rule(k)[0] if k >= 0 else None for k in found.tolist()] == ["h3/", None, "h0/"]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark, folder):
    kinds = ("email", "ip", "card", "phone")
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    got = {}
    for r in queries.op3_pii(spark, folder).collect():
        got.setdefault(r["doc_id"], []).append(r)
    n = 0
    for i, t in docs_of(spark, folder):
        t = t or ""
        if len(t) > 4000 and "@" not in t:  # the plain pattern takes too long on a run of letters
            found = [m for k, p in zip(kinds[1:], patterns[1:]) for m in ((k, x) for x in re.finditer(p, t))]
        else:
            found = [m for k, p in zip(kinds, patterns) for m in ((k, x) for x in re.finditer(p, t))]
        spans = []
        for k, m in found:
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if fine:
                spans.append((m.start(), kinds.index(k), m.end()))
        spans.sort()
        text = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        counts = Counter(k for _, k, _ in spans)
        r = got[i][0]
        assert [r[f"n_{k}"] for k in kinds] == [counts[j] for j in range(4)], i
        assert r["base_sha256"] == sha(text), i
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(",")), i
        n += 1
    assert n == sum(map(len, got.values()))


def test_quality_rules(spark, folder):
    expected = []
    for i, t in docs_of(spark, folder):
        t = t or ""
        w = plain_words(t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        many = Counter(windows)
        hit = set()
        for k, x in enumerate(windows):
            if many[x] > 1:
                hit |= set(range(k, k + 8))
        lines = [x for x in t.split("\n") if plain_words(x)]
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed))
    got = queries.op4_quality_rules(spark, folder)
    assert rows_of(got.drop("kept")) == sorted(expected, key=repr)
    assert got.filter("base_failed and kept").count() == 0


def test_token_files(spark, folder):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    each = []
    for i, t in docs_of(spark, folder):
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        each.append((i, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
    got = queries.op5_token_files(spark, folder).collect()
    assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == sorted(each, key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert ids == sorted(ids)


def plain_fingerprint(text):
    words = [w for w in BLANK.split(re.sub("[A-Z]", lambda c: c[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """By id: repeated ids count as one document."""
    ids = [i for i, _ in prints if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    own = [(i, f) for i, f in prints if i is not None]
    for a, (i, f) in enumerate(own):
        for j, g in own[:a]:
            if (f ^ g).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return find


def test_simhash(spark, folder):
    prints = [(i, plain_fingerprint(t)) for i, t in docs_of(spark, folder)]
    find = plain_components(prints)
    expected = [(i, f"{f:016x}", None if i is None else find(i)) for i, f in prints]
    assert rows_of(queries.op6_simhash(spark, folder)) == sorted(expected, key=repr)


def test_warc(spark, folder):
    pages = [(i, (h or "").encode()) for i, h in table(spark, folder, "pages", "page_id", "html")]
    most = {}
    for i, p in pages:
        if len(p) >= 1000 and i is not None:
            most[p] = max(most.get(p, i), i)
    expected = []
    for i, p in pages:
        to = most.get(p)
        again = to is not None and to != i
        expected.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", to if again else None))
    assert rows_of(queries.op7_warc(spark, folder)) == sorted(expected, key=repr)


@pytest.mark.parametrize("dense", [1, 3])
def test_simhash_dense_points(spark, dense):
    """Points that are dense at every width of the grid, with clusters of a few bits, rows without words and repeated ids."""
    import random

    from tillage.llm import simhash

    rng = random.Random(dense)
    prints = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            prints.append((len(prints), centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6)))))
    prints = [(i, f & (1 << 64) - 1) for i, f in prints]
    rows = [(i, f - (1 << 64) * (f >> 63)) for i, f in prints]
    nodes = spark.createDataFrame(rows, "rep long, fp long").groupBy("fp").agg(F.min("rep").alias("rep"))
    from tillage.llm.components import components

    found = dict(components(simhash.links(nodes, dense)).collect())
    find = plain_components(prints)
    least = {r["fp"]: r["rep"] for r in nodes.collect()}
    assert {i: found.get(least[f], least[f]) for i, f in rows} == {i: find(i) for i, _ in rows}


def test_substring_dedup(spark, folder):
    docs = [(i, plain_words(t)) for i, t in docs_of(spark, folder)]
    many = Counter(tuple(w[k : k + 35]) for _, w in docs for k in range(len(w) - 34))
    expected = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - 34):
            if many[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        expected.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert rows_of(queries.op8_substring_dedup(spark, folder)) == sorted(expected, key=repr)


def test_repeats_removed(spark, folder):
    """remove_repeats gives the rows with their own columns; texts that lose nothing stay as they are."""
    df = spark.read.parquet(f"{folder}/documents.parquet")
    docs = [(i, t, plain_words(t)) for i, t in docs_of(spark, folder)]
    many = Counter(tuple(w[k : k + 35]) for *_, w in docs for k in range(len(w) - 34))
    expected = []
    for i, t, w in docs:
        gone = {x for k in range(len(w) - 34) if many[tuple(w[k : k + 35])] > 1 for x in range(k, k + 35)}
        expected.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    out = substring_dedup.remove_repeats(df)
    assert out.columns == df.columns
    assert rows_of(out.select("doc_id", "text")) == sorted(expected, key=repr)


def test_quality_classifier(spark, folder):
    docs = docs_of(spark, folder)
    got = {}
    for r in queries.op9_quality_classifier(spark, folder).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(docs)
    for i, _ in docs:
        for r in got[i]:
            assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_quality_classifier_accuracy(spark, sf_dir):
    labels = dict(table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels", "doc_id", "quality"))
    got = [r for r in queries.op9_quality_classifier(spark, sf_dir.replace("sf0.001", "sf0.01")).collect() if r["held_out"] and r["doc_id"] in labels]
    good = [r["score"] for r in got if labels[r["doc_id"]] == 1]
    bad = [r["score"] for r in got if labels[r["doc_id"]] == 0]
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.9
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in got) > 0.85 * len(got)


def test_quality_classifier_learns_from_labels_only(spark, sf_dir):
    """With labels that say nothing about the texts there is nothing to learn; repeated ids don't change what is learned."""
    from tillage.llm import classifier

    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{name}.parquet") for name in ("documents", "labels"))
    shuffled = labels.withColumn("quality", (F.crc32(F.concat(F.lit("x"), F.col("doc_id").cast("string")).cast("binary")) % 2).cast("int"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = [r for r in classifier.classify(docs, shuffled).collect() if r["held_out"] and r["doc_id"] in truth]
    good, bad = ([r["score"] for r in got if truth[r["doc_id"]] == y] for y in (1, 0))
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert 0.15 < above < 0.85
    once, twice = classifier.train(docs, labels), classifier.train(docs.union(docs), labels)
    assert (once.weights == twice.weights).all() and once.bias == twice.bias


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def plain_contamination(docs, items):
    windows = {}
    for i, t in items:
        w = item_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add((i, k))
    lengths = {len(w) for w in windows}
    texts = {i: item_words(t) for i, t in items}
    for i, t in docs:
        w, hit, found, best = item_words(t), set(), set(), None
        for n in lengths:
            for k in range(len(w) - n + 1):
                for item, at in windows.get(tuple(w[k : k + n]), ()):
                    hit |= set(range(k, k + n))
                    found.add(item)
                    own, m = texts[item], n
                    while k + m < len(w) and at + m < len(own) and w[k + m] == own[at + m]:
                        m += 1
                    best = min(best or (0,), (-m, k, str(item), at))
        best = best or (0, None, None, None)
        yield i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit), -best[0], best[2], best[3], best[1]


def test_decontamination(spark, folder):
    expected = sorted(plain_contamination(docs_of(spark, folder), table(spark, folder, "benchmark", "item_id", "text")), key=repr)
    assert rows_of(queries.op10_benchmark_decontamination(spark, folder)) == expected
    # Blocks of few items, more of them than a worker holds.
    docs, benchmark = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    assert rows_of(decontamination.contamination(docs, benchmark, block_bytes=300)) == expected
    clean = [r[0] for r in expected if not r[5]]
    left = decontamination.remove_contaminated(docs, benchmark, block_bytes=300)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted(clean, key=repr)


def test_decontamination_of_one_word(spark):
    """An item and a document of one repeated word cost their lengths, not their product; null and repeated item ids."""
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, "other"), (None, "word " * 12)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "word " * 20_000), (None, "word " * 11), (1, "word " * 30)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, benchmark).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["longest_words"], got[1]["longest_item"], got[1]["longest_doc_word"]) == (400_000, 2, 20_000, "1", 0)
    assert got[1]["items_sha256"] == sha("1,None")
    assert (got[None]["n_hit"], got[None]["longest_words"], got[None]["longest_item"]) == (12, 12, "1")
    assert (got[2]["n_hit"], got[2]["longest_words"], got[2]["longest_item"]) == (0, 0, None)


def test_bit_packing():
    import numpy as np

    from tillage.llm.token_files import TokenFile, pack, to_file, unpack

    rng = np.random.default_rng(3)
    for bits in range(1, 33):
        ids = rng.integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
        whole = sum(int(x) << (bits * k) for k, x in enumerate(ids)).to_bytes(-(-1000 * bits // 8), "little")
        assert pack(ids, bits) == whole
        assert (unpack(whole, 1000, bits) == ids).all()
        docs = [ids[:0], ids[:7], ids[7:900], ids[900:]]
        file = TokenFile(to_file([3, 1, 2, 9], docs, bits, block=64))
        assert all((file.document(k) == d).all() for k, d in enumerate(docs)) and file.doc_ids.tolist() == [3, 1, 2, 9]


def test_warc_records(spark, tmp_path):
    """Revisits name their response by its record id, address and date; equal long rows come back as often as written; an archive with
    a segment missing is an error."""
    import gzip

    from tillage.llm import warc

    long, odd = "0123456789" * 20_000, "x" * 70_000
    rows = [(1, "http://a/", long), (2, "http://b/", long), (2, "http://b/", long), (3, "http://c/", "short"), (4, "http://d/", odd), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = warc.write(df, folder=f"file://{tmp_path}/w")
    got = rows_of(warc.read(spark, files).select("page_id", "url", "payload_bytes", "record_type", "refers_to"))
    assert got == sorted([(1, "http://a/", 200_000, "revisit", 2), (2, "http://b/", 200_000, "response", None), (2, "http://b/", 200_000, "response", None), (3, "http://c/", 5, "response", None), (4, "http://d/", 70_000, "response", None), (None, "", 0, "response", None)], key=repr)
    found = []
    for path in (tmp_path / "w").glob("*.warc.gz"):
        with gzip.open(path) as f:
            found += list(warc.parse(f))
    ids = {h["x-page-id"]: h["warc-record-id"] for h, _ in found if "x-page-id" in h}
    revisit = next(h for h, _ in found if h["warc-type"] == "revisit")
    assert revisit["warc-refers-to"] == ids["2"] and revisit["warc-refers-to-target-uri"] == "http://b/" and revisit["warc-refers-to-date"] == revisit["warc-date"]
    again = warc.write(df, folder=f"file://{tmp_path}/v")
    assert again.count() and {h["warc-record-id"] for p in (tmp_path / "v").glob("*.warc.gz") for h, _ in warc.parse(gzip.open(p))} == {h["warc-record-id"] for h, _ in found}
    broken = tmp_path / "broken.warc"
    broken.write_bytes(b"".join(warc.record([(k.title() if k != "warc-type" else "WARC-Type", v) for k, v in h.items() if k != "content-length"], block) for h, block in found if h.get("warc-segment-number") != "2"))
    with pytest.raises(Exception, match="segments are missing"):
        warc.read(spark, spark.createDataFrame([(f"file://{broken}",)], "path string")).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_warc_framing(seed):
    import random

    from tillage.llm import warc

    rng = random.Random(seed)
    for _ in range(200):
        payload = bytes(rng.choices(b"\r\n0aF;", k=rng.randrange(50)))
        assert warc.unchunked(warc.chunked(payload, rng.randrange(1, 9))) == payload
        parts = [{"segment": k + 1, "block": payload[i : i + 7]} for k, i in enumerate(range(0, len(payload), 7))]
        rng.shuffle(parts)
        if parts:
            assert warc.joined(parts * 2, len(payload), "x") == (payload, 2)
            with pytest.raises(ValueError, match="segments"):
                warc.joined(parts, len(payload) + 1, "x")


def test_warc_equal_rows(spark, tmp_path):
    """Many equal long rows, with an id and without one: hardly any record shares its id with another, and all come back."""
    from tillage.llm import warc

    long_page = "<p>" + "0123456789" * 9000
    rows = [(None, "u", long_page)] * 150 + [(3, "u", long_page)] * 100 + [(4, "v", "short")] * 20
    files = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    found = warc.records(spark, files).filter("segment = 1 or segment is null").groupBy("record_id").count()
    assert found.count() > 200 and found.agg(F.max("count")).first()[0] <= 4
    back = warc.read(spark, files, with_payload=False).groupBy("page_id", "record_type", "refers_to").count().collect()
    assert {tuple(r) for r in back} == {(None, "revisit", 3, 150), (3, "response", None, 100), (4, "response", None, 20)}


def test_warc_hot_payloads(spark, folder, monkeypatch):
    """Payloads that are dealt with apart give the same."""
    from tillage.llm import warc

    expected = rows_of(queries.op7_warc(spark, folder))
    monkeypatch.setattr(warc, "HOT", 20)
    assert rows_of(queries.op7_warc(spark, folder)) == expected


def test_ids_of_other_types(spark):
    """Decontamination takes ids of any type; where ids are compared, another id than a whole number is an error."""
    docs = spark.createDataFrame([("a", PASSAGE), ("b", "clean words")], "doc_id string, text string")
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert sorted((r["doc_id"], r["contaminated"]) for r in decontamination.contamination(docs, bench).collect()) == [("a", True), ("b", False)]
    from tillage.llm import near_copies

    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        near_copies.deduplicate(docs).collect()


def test_sample_bytes(spark, sf_dir):
    """A bound on the bytes of the sample gives a smaller sample, not a failure."""
    from tillage.llm import classifier

    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    assert classifier.train(docs, labels, sample_bytes=60_000) is not None


def test_quality_scores(spark, folder):
    """Every score by a plain forward pass: the mean weight of the buckets of all words and their n-grams, and the bias."""
    import math

    import numpy as np

    from tillage.llm import classifier, texts

    m64 = (1 << 64) - 1

    def bucket(s):
        raw, power = 0, 1
        for c in s:
            raw, power = (raw + (ord(c) + 1) * power) & m64, power * texts.MULTIPLIERS[0] & m64
        x = (raw + len(s) * texts.MIXERS[0]) & m64
        for m in texts.MIXERS:
            x = (x ^ (x >> 33)) * m & m64
        return (x ^ (x >> 33)) % classifier.BUCKETS

    weights = np.random.default_rng(3).normal(size=classifier.BUCKETS)
    known = {}

    def sums(word):
        if word not in known:
            marked = f"<{word}>"
            parts = [marked, *(marked[k : k + n] for n in classifier.GRAMS if len(marked) > n for k in range(len(marked) - n + 1))]
            known[word] = sum(weights[bucket(p)] for p in parts), len(parts)
        return known[word]

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted(((r["doc_id"], round(r["score"], 9), r["predicted"]) for r in classifier.score(docs, classifier.Model(weights, 0.25)).collect()), key=repr)
    expected = []
    for i, t in docs_of(spark, folder):
        parts = [sums(w) for w in plain_words(t)]
        z = sum(a for a, _ in parts) / max(1, sum(n for _, n in parts)) + 0.25
        p = 1 / (1 + math.exp(-z))
        expected.append((i, round(p, 9), int(p >= 0.5)))
    assert got == sorted(expected, key=repr)
