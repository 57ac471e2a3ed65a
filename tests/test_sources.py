"""Readers of document files and of chunk files, and the keyed upsert of a stream."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tillage.sources.documents import segments
from tillage.operators import structure
from tillage.operators.records import conflicts, save_vectors
from tillage.operators.structure import Heading
from tillage.sources import documents, tables
from tillage.sources.tables import chunk_files
from tillage.streaming.slots import current, rescheduled, settled, settled_stream, upsert_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# One\ntext\n## Two\nmore \xff\n# Three\nlast\n")
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p>'
    row = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}{row}</w:body></w:document>")
    got = sorted((r["path"][-6:], r["source_order"], r["heading_path"], r["content"]) for r in segments(spark, str(tmp_path)).collect())
    assert [g[1:] for g in got if g[0].endswith(".md")] == [(0, "One", "text"), (1, "One > Two", "more \ufffd"), (2, "Three", "last")]
    assert [g[1:] for g in got if g[0] == "b.docx"] == [(0, "Top", "body"), (1, "Top", "a | b")]


def test_documents_that_cannot_be_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "MOST_BYTES", 1000)
    (tmp_path / "large.md").write_text("x" * 2000)
    (tmp_path / "other.xyz").write_text("x")
    (tmp_path / "broken.docx").write_text("no zip")
    (tmp_path / "korean.txt").write_bytes("1. 제목\n논물".encode("cp949"))
    (tmp_path / "bad.md").write_bytes(b"a\xff\xffb")
    got = {r["path"].rpartition("/")[2]: (r["source_order"], r["heading_path"], r["content"], r["problem"]) for r in segments(spark, str(tmp_path), [Heading("numeric_dot", 1, notation="1.")]).collect()}
    assert got["large.md"] == (-1, None, None, "too large") and got["other.xyz"] == (-1, None, None, "another kind of file")
    assert got["broken.docx"][3].startswith("broken") and got["bad.md"][3] == "bytes that are no text"
    assert got["korean.txt"] == (0, "1. 제목", "논물", None)


def hwpx(path, *sections, colours=("2", "#DDEEFF")):
    """An archive of sections, with one border that is filled."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("Contents/header.xml", f'<hh:head xmlns:hh="h"><hh:borderFill id="1"><hh:winBrush faceColor="none"/></hh:borderFill><hh:borderFill id="{colours[0]}"><hh:winBrush faceColor="{colours[1]}"/></hh:borderFill></hh:head>')
        for n, body in sections:
            z.writestr(f"Contents/section{n}.xml", f'<hs:sec xmlns:hs="s" xmlns:hp="p">{body}</hs:sec>')


def _t(x):
    return f"<hp:p><hp:run><hp:t>{x}</hp:t></hp:run></hp:p>"


def _cell(x, w=1, h=1, fill="1", inner=""):
    return f'<hp:tc borderFillIDRef="{fill}">{_t(x)}{inner}<hp:cellSpan colSpan="{w}" rowSpan="{h}"/></hp:tc>'


def _table(*rows):
    return "<hp:tbl>" + "".join(f"<hp:tr>{''.join(r)}</hp:tr>" for r in rows) + "</hp:tbl>"


def test_hwpx_spans(spark, tmp_path):
    """Sections in the order of their numbers; a cell that spans rows stands in each of them; values under their headers."""
    table = _table([_cell("kind", fill="2"), _cell("a", fill="2"), _cell("b", fill="2")], [_cell("k", 1, 2), _cell("1"), _cell("2")], [_cell("c", 2)])
    hwpx(tmp_path / "a.hwpx", (10, _t("last")), (0, f"{_t('first')}<hp:p><hp:run>{table}</hp:run></hp:p>"))
    assert [r["content"] for r in segments(spark, str(tmp_path)).orderBy("source_order").collect()] == ["first", "kind: k\na: 1\nb: 2", "kind: k\na: c", "last"]


def test_hwpx_tables(spark, tmp_path):
    """Text beside a table stays, in order; a table within a cell comes once; pairs by their colours; boxes in their line."""
    inner = f"<hp:p><hp:run>{_table([_cell('in 1'), _cell('in 2')], [_cell('in 3'), _cell('in 4')])}</hp:run></hp:p>"
    pairs = _table([_cell("name", fill="2"), _cell("Kim"), _cell("age", fill="2"), _cell("44")], [_cell("town", fill="2"), _cell("here", inner=inner), _cell("job", fill="2"), _cell("none")])
    box = _table([_cell("new")])
    groups = _table([_cell("rates", fill="2"), _cell("rice", fill="2"), _cell("5"), _cell("hay", fill="2"), _cell("3")], [_cell("x", fill="2"), _cell("y")])
    body = f"<hp:p><hp:run><hp:t>before</hp:t></hp:run><hp:run>{pairs}</hp:run><hp:run><hp:t>after</hp:t></hp:run></hp:p>"
    hwpx(tmp_path / "a.hwpx", (0, f"{body}<hp:p><hp:run><hp:t>line</hp:t>{box}</hp:run></hp:p>{_t('신청 가능')}<hp:p><hp:run>{groups}</hp:run></hp:p>"))
    got = [r["content"] for r in segments(spark, str(tmp_path)).orderBy("source_order").collect()]
    assert got == ["before", "name: Kim\nage: 44", "town: here\nin 1 | in 2\nin 3 | in 4\njob: none", "after", "line (new)", "rates: rice : 5, hay : 3", "x: y"]


def test_docx_tables(spark, tmp_path):
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    inner = f"<w:tbl><w:tr>{cell('i')}</w:tr></w:tbl>"
    body = f"<w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p>{inner}</w:tc>{cell('b')}</w:tr></w:tbl><w:p><w:r><w:t>two</w:t></w:r><w:r>{inner}</w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    assert [r["content"] for r in segments(spark, str(tmp_path)).orderBy("source_order").collect()] == ["one", "a i | b", "two (i)"]


def test_docx_merged_cells(spark, tmp_path):
    """A cell merged over columns and rows stands in all of them, also below a row that begins later; empty cells and rows don't show, nor does what a merged
    cell has below its first row.
    A table is one segment of a whole document, and one of a single row may be a heading."""
    cell = lambda x, *props: f"<w:tc><w:tcPr>{''.join(props)}</w:tcPr><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    wide, top, on = '<w:gridSpan w:val="2"/>', '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    rows = [
        [cell("area", top), cell("rates", wide)],
        [cell("", on), cell("rice"), cell("hay")],
        [cell("north", top), cell("5"), cell("3")],
        [cell("lost", on), cell("6"), cell("")],
        [cell(""), cell(""), cell("")],
        [cell("", on), cell("7"), cell("8", on)],
    ]
    late = f'<w:tr><w:trPr><w:gridBefore w:val="1"/></w:trPr>{cell("x", top)}</w:tr><w:tr>{cell("a")}{cell("", on)}</w:tr>'
    made = "<w:tbl>" + "".join(f"<w:tr>{''.join(r)}</w:tr>" for r in rows) + "</w:tbl>"
    line = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    body = f"{line('one')}{made}<w:tbl><w:tr>{cell('Annex 1')}{cell('Forms')}</w:tr></w:tbl>{line('two')}<w:tbl>{late}</w:tbl>"
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    want = ["area | rates | rates", "area | rice | hay", "north | 5 | 3", "north | 6", "7"]
    got = [r["content"] for r in segments(spark, str(tmp_path)).orderBy("source_order").collect()]
    assert got == ["one", *want, "Annex 1 | Forms", "two", "x", "a | x"]
    rules = structure.rules_of({"levels": [{"depth": 1, "rule_type": "appendix_title_table", "location": "table", "rule_options": {"keywords": ["Annex"]}}]})
    found = documents.document_segments(documents.lines(spark, str(tmp_path)), rules).orderBy("at").collect()
    assert [(r["block"], r["content"], r["path"]) for r in found] == [
        ("paragraph", "one", ""),
        ("table", "\n".join(want), ""),
        ("paragraph", "Annex 1 Forms\ntwo", "Annex 1 Forms"),
        ("table", "x\na | x", "Annex 1 Forms"),
    ]


def test_documents_to_chunks(spark, tmp_path):
    """From the stored schema and the archive to chunks: sectors, paths, tables with captions, titles once."""
    schema = {"levels": [{"depth": 1, "rule_type": "roman", "notation": "Ⅰ."}, {"depth": 2, "rule_type": "korean_letter_dot", "notation": "가.", "rule_options": {"letter_range": "가나다"}}, {"rule_type": "unknown"}, {"depth": 3, "rule_type": "x", "pattern": "^case [0-9]+"}]}
    extra = json.dumps({"levels": [{"depth": 1, "rule_type": "appendix_title_table", "location": "table", "rule_options": {"keywords": ["Annex"]}}]})
    head, rows = [_cell("crop", fill="2"), _cell("rate", fill="2")], [[_cell("rice"), _cell("5")], [_cell("hay"), _cell("3")]]
    long = " ".join(f"Sentence {k} has some words." for k in range(80))
    body = _t("Ⅰ. Rules") + _t("가. Rates") + _t("라. no heading") + _t("&lt;Rates of crops&gt;") + f"<hp:p><hp:run>{_table(head, *rows)}</hp:run></hp:p>" + _t("case 7 x") + _t(long) + f"<hp:p><hp:run>{_table([_cell('Annex 1'), _cell('Forms')])}</hp:run></hp:p>" + _t("to fill in") + _t("Ⅱ. Ends") + _t("done")
    hwpx(tmp_path / "a.hwpx", (0, body))
    (tmp_path / "b.md").write_text("# Top\n## Sub\nbody\n")
    main, appendix = structure.rules_of(schema), structure.rules_of(extra, "appendix")
    assert [(r.kind, r.depth, r.options.get("letters")) for r in main] == [("roman", 1, None), ("korean_letter_dot", 2, "가나다"), ("pattern", 3, None)]
    found = documents.document_chunks(spark, str(tmp_path), main, appendix).orderBy("doc_id", "chunk").collect()
    md = [r for r in found if r["doc_id"].endswith("md")]
    assert [(r["path"], r["content"], r["block"]) for r in md] == [("Top > Sub", "Top\nSub\nbody", "paragraph")]
    own = [r for r in found if r["doc_id"].endswith("hwpx")]
    assert [(r["sector"], r["block"], r["path"]) for r in own if r["part"] == 0] == [
        ("main", "heading-line", "Ⅰ. Rules"),
        ("main", "paragraph", "Ⅰ. Rules > 가. Rates"),
        ("main", "table-row", "Ⅰ. Rules > 가. Rates > 📋 <Rates of crops>"),
        ("main", "paragraph", "Ⅰ. Rules > 가. Rates > case 7 x"),
        ("appendix", "heading-line", "Annex 1 Forms"),
        ("appendix", "paragraph", "Annex 1 Forms"),
        ("main", "heading-line", "Ⅱ. Ends"),
        ("main", "paragraph", "Ⅱ. Ends"),
    ]
    assert own[1]["content"] == "가. Rates\n라. no heading" and own[2]["content"] == "<Rates of crops>\ncrop: rice\nrate: 5\n---\ncrop: hay\nrate: 3"
    parts = [r for r in own if r["path"].endswith("case 7 x")]
    assert len(parts) == 3 and all(r["parts"] == 3 and len(r["content"]) <= 1000 + 30 for r in parts) and parts[0]["content"].startswith("case 7 x\nSentence 0 ")


def test_tables_written(spark, tmp_path):
    kind = "k int, v string"
    (tmp_path / "in").mkdir()
    for n, text in enumerate(('{"k": 1, "v": "a"}', '{"k": 2, "v": "b"}', "{ no json")):
        (tmp_path / "in" / f"{n}.json").write_text(text)
    assert [(r["file"].rpartition("/")[2], r["problem"]) for r in tables.rejected_files(spark, str(tmp_path / "in"), kind).collect()] == [("2.json", "{ no json")]
    tables.json_upsert(spark.createDataFrame([(2, "c"), (3, "d")], kind), str(tmp_path / "in"), kind, ["k"], str(tmp_path / "out"))
    assert sorted(tuple(r) for r in spark.read.schema(kind).json(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    at = str(tmp_path / "vectors")
    rows = spark.createDataFrame([(1, [0.5], (3, ["x"], None))], "id int, v array<double>, m struct<a:int,b:array<string>,c:string>")
    for reset in (True, False, True):
        save_vectors(rows, at, "m", reset)
    assert [r["m"] for r in spark.read.parquet(at).collect()] == ['{"a":"3","b":"[\\"x\\"]"}']
    assert tables.emptied(spark, at) == 1 and spark.read.parquet(at).count() == 0
    parts = str(tmp_path / "parts")
    tables.replace_partitions(spark.createDataFrame([(1, "a"), (2, "a")], kind), parts, ["k"])
    tables.replace_partitions(spark.createDataFrame([(2, "b")], kind), parts, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(parts).collect()) == [(1, "a"), (2, "b")]
    log = spark.createDataFrame([("m", "f", "x", "OK", 1, 2, 3, None)], "model string, file string, expected string, status string, latency_ms int, prompt_tokens int, completion_tokens int, error string")
    for _ in range(2):
        tables.append_evaluations(log, str(tmp_path / "log"))
    assert [r["status"] for r in tables.evaluation_rows(spark, str(tmp_path / "log")).collect()] == ["OK", "OK"]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], kind), spark.createDataFrame([(2, "z")], kind)
    assert [tuple(r) for r in conflicts(a, b, ["k"]).collect()] == [(2, "y")]


def test_chunk_files(spark, tmp_path):
    chunk = lambda i, t: {"chunk_id": i, "title": "t", "section": "s", "text": t}
    (tmp_path / "a.json").write_text(json.dumps({"source_file": "x", "chunks": [chunk("1", "long enough to be kept"), chunk("2", "short")]}))
    (tmp_path / "b.json").write_text("{ no json")
    assert [(r["source_file"], r["chunk_id"]) for r in chunk_files(spark, str(tmp_path)).collect()] == [("x", "1")]


def test_upsert_stream(spark, tmp_path):
    kind = "k long, at long, v string"
    for rows in ([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], [(2, 3, "d")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        upsert_stream(stream, str(tmp_path / "out"), ["k"], "at", str(tmp_path / "check")).awaitTermination()
    assert sorted(tuple(r) for r in current(spark, str(tmp_path / "out")).collect()) == [(1, 2, "c"), (2, 3, "d")]


def test_upsert_stream_rewrites_what_it_touches(spark, tmp_path):
    """Only buckets with new rows are written again, and of each the newest two versions stay; buckets grow with the table."""
    kind, out = "k long, at long, v string", tmp_path / "out"
    for n, rows in enumerate(([(k, 1, "a") for k in range(100)], [(5, 2, "b")], [(5, 3, "c")], [(5, 4, "d")], [], [(6, 5, "e")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        upsert_stream(stream, str(out), ["k"], "at", str(tmp_path / "check"), bucket_bytes=100).awaitTermination()
        written = {p.parent.name for p in out.glob("v=*/bucket=*")}
        if n == 1:  # outgrown the one bucket of the first batch: all is written in more
            count = int(max(written).partition(".")[2])
            assert written == {"v=0.1", f"v=1.{count}"} and count >= 8 and len(list((out / f"v=1.{count}").glob("bucket=*"))) > 1
        if n == 3:  # as many buckets as before, or more; a touched one alone if as many
            assert len({w.partition(".")[2] for w in written}) <= 3
        got = {r["k"]: r["v"] for r in current(spark, str(out)).collect()}
        assert len(got) == 100 and got[5] == "abcdd"[min(n, 3)] if n < 5 else got[6] == "e"
    assert sorted(tuple(r) for r in current(spark, str(out)).collect()) == [(k, 4, "d") if k == 5 else (k, 5, "e") if k == 6 else (k, 1, "a") for k in range(100)]


def test_upsert_stream_keeps_other_buckets(spark, tmp_path):
    """A batch that the table hasn't outgrown its buckets with writes the touched one only."""
    kind, out = "k long, at long, v string", tmp_path / "out"
    spark.createDataFrame([(k, 1, "a") for k in range(40)], kind).write.parquet(str(tmp_path / "first"))
    base = spark.read.parquet(str(tmp_path / "first")).withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(4)).cast("int"))
    base.repartition("bucket").write.partitionBy("bucket").parquet(str(out / "v=-1.4"))
    spark.createDataFrame([(5, 2, "b")], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    upsert_stream(stream, str(out), ["k"], "at", str(tmp_path / "check")).awaitTermination()
    assert len(list((out / "v=0.4").glob("bucket=*"))) == 1
    assert sorted(tuple(r) for r in current(spark, str(out)).collect()) == [(k, 2, "b") if k == 5 else (k, 1, "a") for k in range(40)]


def test_settled_stream(spark, tmp_path):
    """A late request and a late piece of evidence over several micro-batches and restarts: what a batch over all gives."""
    kind = "owner string, parcel int, request long, at long"
    batches = [
        [("a", 1, 10, 5), ("a", 1, 11, 9), ("a", 2, 12, 5), ("b", 1, 13, 5), (None, 1, 20, 1)],
        [("a", 1, None, 7), ("b", 1, None, 5)],
        [("a", 1, 14, 6), ("a", 1, 15, 8), ("a", 2, None, 4)],
        [("a", 1, None, 3), ("b", 1, None, 6), ("b", 1, None, 9), (None, 1, None, 2)],
        [("a", 1, None, 10), ("b", 1, 13, 5), ("c", 1, None, 1), ("c", 1, 16, 1), ("c", 1, 17, 0), ("c", 1, 17, 0)],
    ]
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in batches:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            events = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
            found = settled_stream(events, ["owner", "parcel"], "at", "request")
            found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.set(store, before)
    every = spark.createDataFrame([r for b in batches for r in b], kind)
    want = settled(every.filter("request is not null"), every.filter("request is null").select("owner", "parcel", "at"), ["owner", "parcel"], "at").select("owner", "parcel", "request", "at")
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    # A batch join doesn't meet null owners; the stream's state is by key, null as well.
    assert [g for g in got if g[0] is not None] == sorted((tuple(r) for r in want.collect()), key=repr) and [g for g in got if g[0] is None] == [(None, 1, 20, 1)]


def test_settled_stream_shares_states(spark, tmp_path):
    """Thousands of keys take a bounded number of states, one of them in pieces; ids beyond 2^53, null and NaN, times and bytes as keys
    stay what they are, rows without a time settle nothing."""
    key, most = "CAST(id % 3000 AS double) k, timestamp_micros(1700000000000001 + id % 3000) day, CAST('x' AS binary) b", 1 << 60
    odd = "CAST({k} AS double) k, CAST(null AS timestamp) day, unhex('00FF') b, CAST({request} AS long) request, CAST({at} AS long) at"
    batches = [
        [f"SELECT {key}, {most} + id AS request, id AS at FROM range(9000)", f"SELECT {odd.format(k=0, request=f'{most} + id', at='id')} FROM range(12001)",
         f"SELECT {odd.format(k="'NaN'", request=7, at=1)}", f"SELECT {odd.format(k='null', request=8, at=1)}", f"SELECT {odd.format(k='null', request=9, at='null')}"],
        [f"SELECT {key}, CAST(null AS long) request, 3000 + id AS at FROM range(3000)", f"SELECT {odd.format(k="'-0.0'", request='null', at=12000)}", f"SELECT {odd.format(k="'NaN'", request='null', at=2)}",
         f"SELECT {odd.format(k='null', request='null', at=2)}", f"SELECT {odd.format(k='null', request='null', at='null')}"],
    ]
    store, kind = "spark.sql.streaming.stateStore.providerClass", "k double, day timestamp, b binary, request long, at long"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for parts in batches:
            spark.sql(" UNION ALL ".join(parts)).write.mode("append").parquet(str(tmp_path / "in"))
            found = settled_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), ["k", "day", "b"], "at", "request")
            run = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
            run.awaitTermination()
            assert max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]) <= 2 * 1024 + 2
    finally:
        spark.conf.set(store, before)
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("CAST(k AS string)", "unix_micros(day) - 1700000000000001", "hex(b)", f"request - {most}", "at").collect()
    plain = [(f"{i % 3000}.0", i % 3000, "78", i, i) for i in range(3000 + 3000)]  # evidence is 3000 after the first of a key
    plain = [p for p in plain if p[4] < 3000 + p[1]]
    want = plain + [("0.0", None, "00FF", i, i) for i in range(12000)] + [("NaN", None, "00FF", 7 - most, 1), (None, None, "00FF", 8 - most, 1)]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        settled_stream(spark.readStream.schema("k int, request long, at timestamp").parquet(str(tmp_path / "in")), ["k"], "at", "request")


def test_statements(spark, tmp_path):
    """Each statement sees what the one before left; the table changes once, and counts are by what was there before."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1.0), (2, "a", 50.0), (3, "b", None), (4, "b", 99.0)], "k int, g string, v double").write.parquet(path)
    v = F.col("v")
    counts = tables.execute(spark, path, [tables.Statement(v < 10, {"v": v + 90, "g": F.lit("c")}), tables.Statement(v > 90)], ["g"])
    assert sorted(tuple(r) for r in counts.collect()) == [("a", 1, 1, 2), ("b", 0, 1, 2)]
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(2, "a", 50.0), (3, "b", None)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    assert sorted(tuple(r) for r in tables.execute(spark, path, [], ["g"]).collect()) == [("a", 1), ("b", 1)]


def test_statement_with_many_parameters(spark, tmp_path):
    """Parameters count one by one; the last stays; nulls in keys meet nothing, null values are set; added rows are counted apart."""
    path, kind = str(tmp_path / "t"), "k int, g string, v int"
    there = [(1, "a", 1), (2, "a", 2), (2, "b", 3), (None, "b", 4)]
    given = spark.createDataFrame([(1, 1, 10), (1, 3, None), (1, 2, 12), (2, 1, 20), (7, 1, 70), (7, 2, 71), (None, 1, 9)], "k int, nth int, v int")
    read = lambda: sorted((tuple(r) for r in spark.read.parquet(path).collect()), key=repr)
    run = lambda p, action: sorted((tuple(r) for r in tables.execute_many(spark, path, p, ["k"], ["nth"], ["g"], action).collect()), key=repr)
    for action, counts, rows in (
        ("update", [("a", 4, 0, 2), ("b", 1, 0, 2)], [(1, "a", None), (2, "a", 20), (2, "b", 20), (None, "b", 4)]),
        ("upsert", [("a", 4, 0, 2), ("b", 1, 0, 2), (None, 0, 1, 0)], [(1, "a", None), (2, "a", 20), (2, "b", 20), (7, None, 71), (None, "b", 4)]),
        ("delete", [("a", 2, 0, 2), ("b", 1, 0, 2)], [(None, "b", 4)]),
    ):
        spark.createDataFrame(there, kind).write.mode("overwrite").parquet(path)
        assert run(given, action) == counts and read() == rows and [p.name for p in tmp_path.iterdir()] == ["t"]
    before = read()
    assert run(given.filter("false"), "upsert") == [("b", 0, 0, 1)] and read() == before


def test_json_upsert_in_place(spark, tmp_path):
    kind, at = "k int, v string", str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], kind).write.json(at)
    for new in ([(2, "c"), (3, "d")], [(3, "e")]):
        tables.json_upsert(spark.createDataFrame(new, kind), at, kind, ["k"])
    assert sorted(tuple(r) for r in spark.read.schema(kind).json(at).collect()) == [(1, "a"), (2, "c"), (3, "e")]
    assert [p.name for p in tmp_path.iterdir()] == ["in"]


def test_reschedule_stream(spark, tmp_path):
    import datetime as dt

    kind, day = "owner int, job string, at long, done_day date", dt.date
    rules = spark.createDataFrame([("sow", "water", 2, 4), ("sow", "weed", 10, 20)], "ref_job string, job string, days_min int, days_max int")
    for rows in ([(1, "sow", 1, day(2024, 2, 27)), (1, "weed", 2, day(2024, 3, 1))], [(1, "sow", 5, day(2024, 3, 1)), (1, "sow", 3, day(2024, 2, 1))]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        new = rescheduled(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), rules)
        upsert_stream(new, str(tmp_path / "out"), ["owner", "job"], "at", str(tmp_path / "check")).awaitTermination()
    got = sorted(tuple(r) for r in current(spark, str(tmp_path / "out")).collect())
    assert got == [(1, "water", 5, day(2024, 3, 3), day(2024, 3, 5)), (1, "weed", 5, day(2024, 3, 11), day(2024, 3, 21))]
