"""Files, messages and streams; documents are built by hand."""

from __future__ import annotations

import io
import json
import random
import zipfile
import zlib
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from tallymark.plans.engine import Engine
from tallymark.plans.queries import feedback_rows
from tallymark.functions import text
from tallymark.sources import corpus, named, ooxml, personas, scan
from tallymark.sources.pdf import pdf
from tallymark.streaming import inbox


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def docx(*blocks):
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = "".join(f"<w:p><w:r><w:t xml:space='preserve'>{b}</w:t></w:r></w:p>" if isinstance(b, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in b) + "</w:tbl>" for b in blocks)
    return zipped(**{"word__document.xml": f"<w:document xmlns:w='{ooxml.W[1:-1]}'><w:body>{body}</w:body></w:document>"})


def xlsx(rows, merged=()):
    ns, rel = ooxml.S[1:-1], ooxml.REL[1:-3]
    shared = sorted({v for r in rows for v in r if isinstance(v, str) and v})
    cell = lambda r, c, v: "" if v in ("", None) else f"<c r='{chr(65 + c)}{r + 1}'" + (f" t='s'><v>{shared.index(v)}</v></c>" if isinstance(v, str) else f"><v>{v}</v></c>")
    data = "".join(f"<row r='{i + 1}'>" + "".join(cell(i, j, v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    return zipped(**{
        "xl__workbook.xml": f"<workbook xmlns='{ns}' xmlns:r='{rel}'><sheets><sheet name='Invoice' sheetId='1' r:id='rId1'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships xmlns='x'><Relationship Id='rId1' Target='worksheets/sheet1.xml'/></Relationships>",
        "xl__sharedStrings.xml": f"<sst xmlns='{ns}'>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>",
        "xl__worksheets__sheet1.xml": f"<worksheet xmlns='{ns}'><sheetData>{data}</sheetData><mergeCells>" + "".join(f"<mergeCell ref='{m}'/>" for m in merged) + "</mergeCells></worksheet>",
    })


def pdf_file(*lines, deflate=True):
    body = b"BT /F1 12 Tf 72 720 Td " + b" T* ".join(b"(" + x.encode("latin-1").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for x in lines) + b" ET"
    data = zlib.compress(body) if deflate else body
    return b"%%PDF-1.4\n1 0 obj\n<< /Length %d %s >>\nstream\n" % (len(data), b"/Filter /FlateDecode" if deflate else b"") + data + b"\nendstream\nendobj\n%%EOF"


INVOICE = [["Order No", "ORD-1"], ["Currency", "EUR"], ["", ""], ["Description", "Cartons", "Net Weight (kg)"], ["Pasta", 3, 4.5], ["Total", 3, 4.5]]


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "docs"
    base.mkdir()
    (base / "S01_bl.docx").write_bytes(docx("BILL OF LADING", [["Order No", "ORD-1"], ["B/L No", "BL1"]], "end"))
    (base / "S01_invoice.XLSX").write_bytes(xlsx([["COMMERCIAL INVOICE", ""], *INVOICE], ["A1:B1"]))
    (base / "S02_note.pdf").write_bytes(pdf_file("SHIPMENT CONFIRMATION", "We confirm order ORD-1 (reference R1)."))
    (base / "broken.docx").write_bytes(b"PK no zip")
    (base / "empty.xlsx").write_bytes(b"")
    (base / "notes.txt").write_text("ignored")
    (base / "below").mkdir()
    (base / "below" / "x.docx").write_bytes(docx("hidden"))
    return str(base)


def test_parsers():
    text, tables = ooxml.docx(docx("A  b", [["x", "y"], ["1", ""]], "c"))
    assert text == "A  b\nx\ty\n1\t\nc" and tables == [[["x", "y"], ["1", ""]]]
    text, tables = ooxml.xlsx(xlsx([["T", ""], ["Order No", "7"], ["", ""], ["a", 2.0, 1.25]], ["A1:B1"]))
    assert text == "[Sheet: Invoice]\nT: T\nOrder No: 7\na\t2\t1.25" and tables == [[["T", "T", ""], ["Order No", "7", ""], ["a", "2", "1.25"]]]
    assert pdf(pdf_file("one (1)", "two"))[0] == "one (1)\ntwo" == pdf(pdf_file("one (1)", "two", deflate=False))[0]
    assert pdf(b"%PDF-1.4\n%%EOF") == ("", [])
    for bad in (("x.txt", b"a"), ("x.docx", b""), ("x.pdf", b"hello")):
        with pytest.raises(ValueError):
            scan.parse(*bad)


def test_scan(spark, folder):
    raw, errors = scan.scan(spark, folder)
    rows = raw.orderBy("doc_ord").collect()
    assert [r["source_path"].rpartition("/")[2] for r in rows] == ["S01_bl.docx", "S01_invoice.XLSX", "S02_note.pdf"] and [r["doc_ord"] for r in rows] == [0, 1, 2]
    assert {r["source_path"].rpartition("/")[2] for r in errors.collect()} == {"broken.docx", "empty.xlsx"}
    assert scan.scan(spark, folder + "/nowhere")[0].count() == 0
    assert scan.scan(spark, folder, logical="mail:/")[0].where("source_path = 'mail:/S01_bl.docx'").count() == 1
    assert {r["name"] for r in scan.catalogue(spark, folder).collect()} >= {"S01_bl.docx", "S02_note.pdf", "empty.xlsx"}
    assert {r["name"]: r["length"] for r in scan.listed(spark, folder).collect()}["empty.xlsx"] == 0 and scan.listed(spark, folder + "/nowhere").count() == 0
    assert scan.document(spark, folder, "S01_bl.docx").first()["text"].startswith("BILL OF LADING")
    for name in ("../x.docx", "a/b.docx", "", "*"):
        with pytest.raises(ValueError):
            scan.document(spark, folder, name)


def test_engine(spark, folder, tmp_path):
    engine = Engine.corpus(spark, folder)
    assert [r["verdict"] for r in engine.verdicts.collect()] == ["PASS"] and engine.members.count() == 3
    engine.write(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/summary")).first()["passed"] == 1
    assert engine.group(engine.groups.first()["group_id"]).count() == 1
    with pytest.raises(ValueError):
        Engine(engine.raw, tolerance=float("nan"))


def test_inbox(spark, tmp_path):
    box, out, mark = (str(tmp_path / x) for x in ("box", "out", "mark"))
    (tmp_path / "box").mkdir()

    def drop(name, *files):
        message = EmailMessage()
        message["Subject"] = "x"
        message.set_content("see attached")
        for file, content in files:
            message.add_attachment(content, maintype="application", subtype="octet-stream", filename=file)
        (tmp_path / "box" / name).write_bytes(bytes(message))

    drop("a.eml", ("../../S01_bl.docx", docx("BILL OF LADING", [["Order No", "ORD-1"]])), ("x.exe", b"no"))
    inbox.ingest(spark, box, out, mark).awaitTermination()
    seen = []
    drop("b.eml", ("Rechnung é.docx", docx("Commercial Invoice")))
    (tmp_path / "box" / "c.eml").write_bytes(b"\xff\xfe broken")
    inbox.ingest(spark, box, out, mark, handle=lambda docs, n: seen.append(docs.count())).awaitTermination()
    rows = spark.read.parquet(out)
    assert {r["source_path"] for r in rows.collect()} == {"email://S01_bl.docx", "email://Rechnung é.docx"} and seen[-1] == 2
    assert rows.where("doc_type = 'bill_of_lading'").first()["identifiers"]["order_no"] == "ORD-1"
    assert inbox.decoded("=?utf-8?q?=C3=A9?=") == "é" and inbox.decoded(None) == ""


def test_review_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    reviews = feedback_rows(events).withColumn("ts", F.to_timestamp("timestamp"))
    reviews.select("ts", "verdict").write.parquet(str(tmp_path / "in"))
    stream = inbox.review_metrics(spark.readStream.schema("ts timestamp, verdict string").parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("reviews").trigger(availableNow=True).start()
    query.awaitTermination()
    table = inbox.review_metrics(reviews)
    assert sorted(map(tuple, spark.sql("select * from reviews").collect())) == sorted(map(tuple, table.collect()))


def test_corpus_and_personas(spark):
    docs = corpus.canonical(spark, "/root/testdata/sf0.001")
    errors = corpus.with_error(docs).where("injected is not null")
    assert {r["injected"] for r in errors.select("injected").distinct().collect()} == {0, 1, 2, 3}
    corpus.check(corpus.raw(spark, "/root/testdata/sf0.001"))
    with pytest.raises(ValueError):
        corpus.check(docs)
    mail = personas.planned(docs.select(F.floor(F.col("doc_ord") / 4).alias("shipment"), "identifiers.order_no", "source_path"))
    rows = mail.limit(50).collect()
    assert {r["status"] for r in rows} == {"dry_run"} and all(len(r["attachments"]) >= 3 for r in rows) and personas.personas(spark).count() == len(personas.PERSONAS)


def test_dates_and_cells_that_go_on_below():
    from tallymark.sources import render

    text, tables = ooxml.xlsx(render.xlsx("Ship Date: 2026-01-01", [[["Lot", "Net", "X"], ["L1", "4.5", "x"]]]))
    assert text == "[Sheet: Invoice]\nShip Date: 2026-01-01 00:00:00\nLot\tNet\tX\nL1\t4.5\tx" and tables == [[["Ship Date", "2026-01-01 00:00:00", ""], ["Lot", "Net", "X"], ["L1", "4.5", "x"]]]
    styles = f"<styleSheet xmlns='{ooxml.S[1:-1]}'><numFmts><numFmt numFmtId='164' formatCode='[Red]0.00'/><numFmt numFmtId='165' formatCode='dd&quot;.&quot;mm'/></numFmts><cellXfs><xf numFmtId='164'/><xf numFmtId='165'/><xf numFmtId='20'/></cellXfs></styleSheet>"
    import io as _io

    assert ooxml._dated(zipfile.ZipFile(_io.BytesIO(zipped(**{"xl__styles.xml": styles})))) == {1, 2}
    assert (ooxml._date("0.5", False), ooxml._date("1", True), ooxml._date("45306.25", False)) == ("12:00:00", "1904-01-02 00:00:00", "2024-01-15 06:00:00")
    cell = lambda t, down="": f"<w:tc><w:tcPr>{down}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = f"<w:tbl><w:tr>{cell('Port', '<w:vMerge w:val=' + chr(39) + 'restart' + chr(39) + '/>')}{cell('Genoa')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('Jeddah')}</w:tr></w:tbl>"
    content = zipped(**{"word__document.xml": f"<w:document xmlns:w='{ooxml.W[1:-1]}'><w:body>{table}</w:body></w:document>"})
    assert ooxml.docx(content) == ("Port\tGenoa\nPort\tJeddah", [[["Port", "Genoa"], ["Port", "Jeddah"]]])


def test_tables_of_pdf_files():
    from tallymark.sources import render

    table = [["Lot", "Cartons"], ["L1", "5"], ["L2", "(7)"]]
    text, tables = pdf(render.pdf("PACKING LIST\nOrder No: 1", [table]))
    assert tables == [table] and text.startswith("PACKING LIST\nOrder No: 1\n") and text.endswith("L1\t5\nL2\t(7)")
    assert pdf(render.pdf("no table\nhere", []))[1] == []


def test_what_a_run_cannot_mean():
    from tallymark.plans.engine import check_options, read_stage

    check_options(0.0, 1, inbox=True)
    for options in ({"tolerance": float("nan")}, {"tolerance": -1.0}, {"messages": 0}, {"inbox": True, "simulate": True}):
        with pytest.raises(ValueError):
            check_options(**options)
    with pytest.raises(ValueError):
        read_stage(None, "x", "nonsense")


def test_stage_files_with_one_array(spark, tmp_path):
    from tallymark.plans.engine import read_stage

    (tmp_path / "v.json").write_text('[{"group_id": "G01", "verdict": "PASS", "suspect_doc_ids": []},\n {"group_id": "G02", "verdict": "FAIL", "suspect_doc_ids": ["a"]}]')
    assert [r["verdict"] for r in read_stage(spark, str(tmp_path / "v.json"), "verdicts", "array").orderBy("group_id").collect()] == ["PASS", "FAIL"]


def test_messages_that_cannot_be_read_are_rows(spark, tmp_path):
    from tallymark.sources import render

    good = render.mail("x", [("a.docx", render.docx("Order No: 1", [])), ("b.pdf", b"no PDF")])
    arrived = spark.createDataFrame([("m1.eml", bytearray(good)), ("m2.eml", bytearray(b"no mail"))], "path string, content binary")
    rows = {r["source_path"]: r["error"] for r in inbox.unpacked(arrived).collect()}
    assert rows["email://a.docx"] is None and "not a PDF" in rows["email://b.pdf"] and len(rows) == 2


def test_named_files(spark, tmp_path):
    folder = tmp_path / "named"
    folder.mkdir()
    (folder / "other.md").write_text("stays")
    (folder / "a.md").write_text("old")
    rows = spark.createDataFrame([("a.md", 2, "two"), ("b é+.md", 1, "ü"), ("a.md", 1, "one\n"), ("c.md", 1, None)], "n string, k int, t string").repartition(3)
    named.write(rows, str(folder), "n", "t", ("k",))
    assert {f.name: f.read_text() for f in folder.iterdir() if f.is_file() and not f.name.startswith((".", "_"))} == {"a.md": "one\ntwo", "b é+.md": "ü", "c.md": "", "other.md": "stays"}
    assert {r["name"]: r["value"] for r in named.read(spark, str(folder)).collect() if r["value"]} == {"a.md": "one\ntwo", "b é+.md": "ü", "other.md": "stays"}
    for bad in ("../x", "a/b", "", None, "_x"):
        with pytest.raises(Exception, match="not a file name"):
            named.write(spark.createDataFrame([("fine.md", "1"), (bad, "2")], "n string, t string").coalesce(1), str(folder), "n", "t")
    assert not (folder / "fine.md").exists() and not list((folder / "_attempts").iterdir())


def test_named_files_of_repeated_tasks(tmp_path):
    writer = named.NamedWriter(str(tmp_path))
    writer.write(iter([("a", "first attempt"), ("b", "x")]))  # its executor is lost before it reports
    done = [writer.write(iter([("a", "second"), ("a", " attempt")])), writer.write(iter([])), writer.write(iter([("b", "y")]))]
    assert not [f for f in tmp_path.iterdir() if f.is_file()]
    writer.commit(done)
    assert {f.name: f.read_text() for f in tmp_path.iterdir() if f.is_file()} == {"a": "second attempt", "b": "y", "_SUCCESS": ""}
    with pytest.raises(ValueError, match="not together"):
        writer.write(iter([("a", "1"), ("b", "2"), ("a", "3")]))
    writer.abort([None])
    assert (tmp_path / "a").read_text() == "second attempt" and not list((tmp_path / "_attempts").iterdir())


def test_items_are_collected_as_they_stand(spark):
    """The shuffle of items carries the table's columns, the answer key only keys, and collected items are not sorted for a join."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    key, orders = plan(corpus.answer_key(spark, "/root/testdata/sf0.001")), plan(corpus.shipments(spark, "/root/testdata/sf0.001"))
    assert "l_orderkey" in key and "l_partkey" not in key and "collect_list" not in key
    assert "ShuffledHashJoin" in orders and "SortMergeJoin" not in orders
    partial = next(line for line in orders.splitlines() if "partial_collect_list" in line)
    assert "Part " not in partial


def test_packed_files(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a.md", 2, "two"), ("b é+.md", 1, "ü"), ("a.md", 1, "one\n"), ("c.md", 1, None)], "n string, k int, t string").repartition(3)
    folder = str(tmp_path / "packed")
    named.write_packed(rows, folder, "n", "t", ("k",))
    assert {r["name"]: r["value"] for r in named.read_packed(spark, folder).collect()} == {"a.md": "one\ntwo", "b é+.md": "ü", "c.md": ""}
    with pytest.raises(ValueError, match="already"):
        named.write_packed(rows, folder, "n", "t", ("k",))
    with pytest.raises(Exception, match="not a file name"):
        named.write_packed(spark.createDataFrame([("fine.md", "1"), ("../x", "2")], "n string, t string").coalesce(1), str(tmp_path / "bad"), "n", "t")
    assert not list((tmp_path / "bad").glob("*.tar.gz"))
    # 20,000 reports in a few files, however many names there are
    many = spark.range(20_000).select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("n"), F.concat(F.lit("# Report "), F.col("id").cast("string")).alias("t"))
    monkeypatch.setattr(named, "PACKED", 1 << 20)
    writer = named.PackedWriter(str(tmp_path / "cut"))
    writer.commit([writer.write(iter([(f"{i:05}", "x" * 1000) for i in range(3000)]))])
    assert len(list((tmp_path / "cut").glob("*.tar.gz"))) == 5 and named.read_packed(spark, str(tmp_path / "cut")).where("length(value) = 1000").count() == 3000
    named.write_packed(many, str(tmp_path / "many"), "n", "t")
    assert len(list((tmp_path / "many").iterdir())) < 40
    assert named.read_packed(spark, str(tmp_path / "many")).exceptAll(many).count() == 0 and named.read_packed(spark, str(tmp_path / "many")).count() == 20_000


def test_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f'say "{i}"\n') for i in range(50)], "i int, s string").repartition(3)
    named.write_arrays(rows.where("i < 40").repartition(4, "i"), str(tmp_path))
    parts = sorted(tmp_path.glob("part-*.json"))
    assert all(isinstance(json.loads(p.read_text()), list) for p in parts)
    got = spark.read.schema("i int, s string").option("multiLine", True).json(str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.where("i < 40").collect()), key=str)
    assert '"s":null' in "".join(p.read_text() for p in parts)


def test_rounding_equals_python(spark):
    rng = random.Random(1)
    values = [2.675, 0.125, 0.375, 1.005, -2.675, -0.125, 0.0, 0.5, 1.5, 2.5, 1e300, 4.5e15, 9.3e13 + 3 / 64, 5e-324, 45035996273704.955, 4503599627370495.5]
    values += [rng.uniform(-1e4, 1e4) for _ in range(40_000)] + [round(rng.uniform(0, 1e6), 3) for _ in range(40_000)] + [rng.randrange(10**6) / 8 for _ in range(10_000)] + [10 ** rng.uniform(-12, 17) for _ in range(10_000)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for digits in (0, 1, 2, 3):
        for i, got in frame.select("i", text.rounded(F.col("v"), digits)).collect():
            assert got == round(values[i], digits), (values[i], digits)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(text.rounded(F.col("v"), 2)).collect()
    assert str(odd[0][0]) == "nan" and odd[1][0] == float("inf") and odd[2][0] is None


def test_mailbox_stream(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()

    def drop(*uids):
        for u in uids:
            (box / f"{u}.eml").write_bytes(f"message {u}".encode())

    marked = lambda: sorted(int(p.stem) for p in box.glob("*.seen"))
    stored, fail = [], [True]

    def store(batch, number):
        rows = sorted(((r["path"], bytes(r["content"])) for r in batch.collect()), key=lambda x: int(x[0].rpartition("/")[2]))
        if fail[0]:
            raise RuntimeError("the sink is down")
        stored.extend(rows)

    def run():
        query = inbox.mailbox(spark, path=str(box), share="2").writeStream.foreachBatch(store).option("checkpointLocation", str(tmp_path / "seen")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    drop(3, 5, 6, 9, 10)
    with pytest.raises(Exception, match="sink is down"):
        run()
    assert not stored and not marked()
    drop(11)  # arrives before the batch is tried again and is not part of it
    fail[0] = False
    run()
    run()
    drop(20, 12)
    (box / "4.eml").write_bytes(b"late, with a number below")
    run()
    assert stored == [(f"mail://{u}", f"message {u}".encode()) for u in (3, 5, 6, 9, 10)] + [("mail://11", b"message 11")] + [("mail://12", b"message 12"), ("mail://20", b"message 20")]
    assert set(marked()) >= {3, 5, 6, 9, 10}
