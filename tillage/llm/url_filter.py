"""URL filters: a sorted, memory-mapped array of 64-bit digests of the rules, probed by binary search and confirmed
against the stored strings.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or the end. A
null url, or one without "://", has an empty host and path. A rule fits its host and all subdomains where the url's
path starts with the rule's; the longest rule wins. Two rules of one host and path with different verdicts are an error,
so there are no ties. Where none fits, the verdict is the default. Every row gives one row; repeated urls give repeated
results; an empty rule table gives the default for all, an empty url table no rows. A very long url costs its parts
times the lengths of paths that rules have. The results take the place of columns that bear their names; other columns
that are kept stay, whatever they are called.

The array is written to the shared folder and goes from there to each executor, where the workers of all tasks map one
copy; a lost executor's successor gets it again. It is bounded: rule tables of over MOST_BYTES of text go another way, a
join of each url's candidates (its host's suffixes with its path's prefixes) with the rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder, written

MOST_BYTES = 64 << 20
KINDS = ("allow", "block")

#: The rules of the contract as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def split_url(url: str | None) -> tuple[str, str]:
    """The host and the path of a url."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for c in "?#" if (i := rest.find(c)) >= 0]
    rest = rest[: min(ends, default=len(rest))]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def build(rules: list[tuple[str, str, str]]) -> bytes:
    """The digest file: count, number of path lengths and of text bytes; then the path lengths, the sorted digests, the
    text offsets and verdicts in their order, and the texts (host and path of each rule)."""
    own = sorted((xxhash.xxh64_intdigest(h + p), (h + p).encode(), KINDS.index(v)) for h, p, v in dict.fromkeys(rules))
    texts = [t for _, t, _ in own]
    lengths = sorted({len(p) for _, p, _ in rules})
    parts = (
        np.array([len(own), len(lengths), sum(map(len, texts))], "<i8"),
        np.array(lengths, "<i8"),
        np.array([d for d, _, _ in own], "<u8"),
        np.cumsum([0] + [len(t) for t in texts]).astype("<i8"),
        np.array([k for _, _, k in own], "<i8"),
    )
    return b"".join(x.tobytes() for x in parts) + b"".join(texts)


class DigestArray:
    """A digest file, mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, m, _ = (int(x) for x in data[:24].view("<i8"))
        cuts = np.cumsum([24, 8 * m, 8 * n, 8 * (n + 1), 8 * n])
        part = lambda k, kind: data[cuts[k] : cuts[k + 1]].view(kind)
        self.lengths, self.digests, self.offsets, self.kinds = part(0, "<i8").tolist(), part(1, "<u8"), part(2, "<i8"), part(3, "<i8")
        self.texts = data[cuts[4] :]

    def find(self, keys: list[str]) -> np.ndarray:
        """The place of each key, or -1: binary search for the digest, then the stored text decides, along equal digests."""
        digest = xxhash.xxh64_intdigest
        asked = np.array([digest(k) for k in keys], np.uint64)
        out = np.full(len(keys), -1)
        at = np.searchsorted(self.digests, asked)
        live = np.arange(len(keys))
        while True:
            live = live[at[live] < len(self.digests)]
            live = live[self.digests[at[live]] == asked[live]]
            if not live.size:
                return out
            wrong = []
            for i in live.tolist():
                k = int(at[i])
                if self.texts[self.offsets[k] : self.offsets[k + 1]].tobytes() == keys[i].encode():
                    out[i] = k
                else:
                    wrong.append(i)
            live = np.array(wrong, np.int64)
            at[live] += 1

    def rule(self, k: int) -> tuple[str, str]:
        return self.texts[self.offsets[k] : self.offsets[k + 1]].tobytes().decode(), KINDS[int(self.kinds[k])]


def suffixes(host: str) -> list[str]:
    """The host, and what follows each of its dots."""
    out = [host]
    while "." in host:
        host = host.partition(".")[2]
        out.append(host)
    return out


@lru_cache(4)
def _mapped(path: str) -> DigestArray:
    return DigestArray(path)


OUT = "host string, path string, rule string, verdict string"


def _probe(urls: DataFrame, rules: list[tuple[str, str, str]], keep: list[str], url: str, default: str) -> DataFrame:
    data = build(rules)
    name = f"rules-{xxhash.xxh64_hexdigest(data)}.bin"
    context = urls.sparkSession.sparkContext
    if not any(x.endswith(f"/{name}") for x in context.listFiles):
        folder = new_folder(urls.sparkSession, "rules")
        files, where = fs.FileSystem.from_uri(folder)
        files.create_dir(where, recursive=True)
        with files.open_output_stream(f"{where}/{name}") as f:
            f.write(data)
        context.addFile(f"{folder}/{name}")
    source = urls.select(F.col(url).cast("string").alias("url"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)])
    out = urls.select(*keep).schema
    for column in OUT.split(", "):
        out = out.add(*column.split(" "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _mapped(SparkFiles.get(name))
        for batch in batches:
            parts = [split_url(u) for u in batch.column(0).to_pylist()]
            keys, rows = [], []
            for i, (host, path) in enumerate(parts):
                own = [s + path[:n] for s in suffixes(host) if s for n in array.lengths if n <= len(path)]
                keys += own
                rows += [i] * len(own)
            found = array.find(keys)
            best: list[tuple[str, str] | None] = [None] * len(parts)
            for j in np.flatnonzero(found >= 0).tolist():
                rule = array.rule(int(found[j]))
                if best[rows[j]] is None or len(rule[0]) > len(best[rows[j]][0]):
                    best[rows[j]] = rule
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([b and b[0] for b in best], pa.string()),
                    pa.array([b[1] if b else default for b in best], pa.string()),
                ],
                names=out.names,
            )

    return source.mapInArrow(run, out)


def _join(urls: DataFrame, rules: DataFrame, keep: list[str], url: str, default: str) -> DataFrame:
    """The same for rule tables of any size: each url's candidates meet the rules in a join, the longest comes back."""
    lengths = sorted(r["n"] for r in rules.select(F.char_length("path").alias("n")).distinct().collect())  # the longest path at most
    whole = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.substring_index(whole, "://", 1)).otherwise(whole)
    rest = F.when(F.instr(whole, "://") > 0, F.substring(whole, F.char_length(rest) + 4, F.char_length(whole))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = urls.select(F.struct(*keep).alias("row"), host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"), F.monotonically_increasing_id().alias("id"))
    own = written(own, "url-filter")
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = own.select("id", "path", F.explode(names).alias("h")).filter("h != ''")
    asked = asked.select("id", "path", "h", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n")).filter(F.col("n") <= F.char_length("path"))
    asked = asked.select("id", F.concat("h", F.substring("path", F.lit(1), F.col("n"))).alias("rule"))
    best = (
        asked.join(rules.select(F.concat("host", "path").alias("rule"), "verdict").distinct(), "rule")
        .groupBy("id")
        .agg(F.max_by(F.struct("rule", "verdict"), F.char_length("rule")).alias("b"))
    )
    out = own.join(best, "id", "left")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def judge(urls: DataFrame, rules: DataFrame, keep: list[str], url: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The columns `keep` of urls with host, path, rule (null where none fits) and verdict. rules: host, path, verdict."""
    keep = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    unlike = rules.groupBy("host", "path").agg(F.min("verdict").alias("a"), F.max("verdict").alias("b")).filter("a != b").first()
    if unlike is not None:
        raise ValueError(f"rules with different verdicts for {unlike['host']}{unlike['path']}")
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 40), F.lit(0))).first()[0]
    if size > most_bytes:
        return _join(urls, rules, keep, url, default)
    return _probe(urls, [tuple(r) for r in rules.select("host", "path", "verdict").collect()], keep, url, default)


def keep_allowed(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows of urls whose verdict is allow, with the columns of urls."""
    boxed = urls.select(F.struct("*").alias("row"), F.col(url).alias("address"))
    return judge(boxed, rules, ["row"], "address", default).filter("verdict = 'allow'").select("row.*")
