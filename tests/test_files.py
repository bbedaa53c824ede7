"""The document source: planning, pushed filters, commits and aborts; PDF and Word files."""

import io
import os
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.sources import files, pdf, word


def names(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)


@pytest.fixture
def documents(spark, tmp_path):
    files.register(spark)
    rows = [(f"{i}.{k}", f"Text {i}\nof kind {k} Jan 2020 - Mar 2021") for i, k in enumerate(["txt", "docx", "dat", "txt", "pdf"])] + [("empty.txt", ""), ("none.txt", None)]
    folder = str(tmp_path / "out")
    spark.createDataFrame(rows, "name string, text string").repartition(3).write.format("documents").mode("append").save(folder)
    return folder


def test_round_trip(spark, documents):
    got = {os.path.basename(r.path): (r.suffix, r.text) for r in spark.read.format("documents").load(documents).collect()}
    assert got == {
        "0.txt": ("txt", "Text 0\nof kind txt Jan 2020 - Mar 2021"), "1.docx": ("docx", "Text 1\nof kind docx Jan 2020 - Mar 2021"),
        "2.dat": ("dat", ""), "3.txt": ("txt", "Text 3\nof kind txt Jan 2020 - Mar 2021"), "4.pdf": ("pdf", ""), "empty.txt": ("txt", ""), "none.txt": ("txt", "")}
    assert not any("_staged" in n for n in names(documents))


def test_filters_are_pushed_and_files_left_closed(spark, documents):
    for path in names(documents):  # a file that is opened all the same would fail
        if path.endswith(".docx"):
            with open(os.path.join(documents, path), "wb") as f:
                f.write(b"no package")
    got = spark.read.format("documents").load(documents).where((F.col("suffix") == "txt") & (F.col("length") > 0) & F.col("text").contains("3"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    (left,) = [x for x in plan.splitlines() if " Filter " in x]
    assert "BatchScan documents" in plan and "text#" in left and "suffix#" not in left and "length#" not in left  # Spark applies the rest alone
    assert [os.path.basename(r.path) for r in got.collect()] == ["3.txt"]


def test_reader_takes_what_it_can(tmp_path):
    for n, size in (("a.txt", 10), ("b.TXT", 20), ("c.docx", 30), ("_hidden.txt", 5)):
        (tmp_path / n).write_bytes(b"x" * size)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringContains

    reader = files.Reader({"path": str(tmp_path), "partitionbytes": "25"})
    other = StringContains(("text",), "x")
    left = list(reader.pushFilters([In(("suffix",), ("txt", "docx")), EqualTo(("suffix",), "txt"), GreaterThan(("length",), 9), LessThanOrEqual(("length",), 20), IsNotNull(("suffix",)), other]))
    assert left == [other]
    assert [[os.path.basename(p) for p, _ in part.files] for part in reader.partitions()] == [["a.txt"], ["b.TXT"]]
    everything = files.Reader({"path": str(tmp_path), "partitionbytes": "45"}).partitions()
    assert [len(p.files) for p in everything] == [2, 1]
    assert files.Reader({"path": str(tmp_path / "none")}).uri and [p.files for p in files.Reader({"path": str(tmp_path), "partitionbytes": "1"}).partitions()][0][0][1] == 10


def test_a_failed_task_leaves_nothing(spark, documents):
    before = names(documents)
    bad = spark.createDataFrame([("ok.txt", "fine"), ("../up.txt", "not allowed")], "name string, text string").repartition(2)
    with pytest.raises(Exception, match="not a file's name"):
        bad.write.format("documents").mode("append").save(documents)
    assert names(documents) == before and not os.path.exists(os.path.join(os.path.dirname(documents), "up.txt"))


def test_append_and_overwrite(spark, documents):
    more = spark.createDataFrame([("more.txt", "more")], "name string, text string")
    more.write.format("documents").mode("append").save(documents)
    assert spark.read.format("documents").load(documents).count() == 8
    more.write.format("documents").mode("overwrite").save(documents)
    assert [r.text for r in spark.read.format("documents").load(documents).collect()] == ["more"]
    with pytest.raises(Exception, match="missing"):
        more.drop("text").write.format("documents").mode("append").save(documents)


def test_skeleton_keeps_styles_headers_and_page(spark, tmp_path):
    files.register(spark)
    plain = word.write_docx(["to be replaced"])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as old, zipfile.ZipFile(out, "w") as new:
        for part in old.infolist():
            data = old.read(part)
            if part.filename == "word/document.xml":
                data = data.replace(b"</w:body>", b'<w:sectPr><w:headerReference w:type="default"/><w:pgSz w:w="12240"/></w:sectPr></w:body>')
            new.writestr(part.filename, data)
        new.writestr("word/styles.xml", "<styles/>")
        new.writestr("word/header1.xml", "<header>Client</header>")
    skeleton = tmp_path / "skeleton.docx"
    skeleton.write_bytes(out.getvalue())
    folder = str(tmp_path / "filled")
    lines = "Firm, Austin June 2013 to September 2014\n\nDid & < things\nFirm (2019 - Present)"
    spark.createDataFrame([("a.docx", lines)], "name string, text string").write.format("documents").option("skeleton", str(skeleton)).mode("append").save(folder)
    (path,) = names(folder)
    with zipfile.ZipFile(os.path.join(folder, path)) as z:
        body = z.read("word/document.xml").decode()
        assert z.read("word/header1.xml") == b"<header>Client</header>" and z.read("word/styles.xml") == b"<styles/>"
    assert body.count("<w:sectPr>") == 1 and body.index("<w:sectPr>") > body.index("things") and "to be replaced" not in body and body.count('w:val="right"') == 2
    assert spark.read.format("documents").load(folder).first().text == "Firm, Austin\tJune 2013 to September 2014\nDid & < things\nFirm\t2019 - Present"


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_round_trip(compress):
    rng = random.Random(1)
    for _ in range(20):
        pages = [[f"line {i} " + "".join(rng.choice("abc ()\\é%<>[]/'\"") for _ in range(rng.randint(1, 30))) + "." for i in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 3))]
        data = pdf.write_pdf([[f"page {j} {x}" for x in p] for j, p in enumerate(pages)], compress)
        assert pdf.read_pdf(data) == "\n\n".join("\n".join(f"page {j} {x}".strip() for x in p) for j, p in enumerate(pages))


def test_pdf_operators_arrays_and_moves():
    assert pdf.page_text(b"BT /F1 9 Tf 1 0 0 1 72 700 Tm [(Hel) -20 (lo) -300 (there)] TJ 0 -14 Td (next) Tj 40 0 Td (same) Tj T* <4869> Tj ET") == "Hello there\nnext same\nHi"
    assert pdf.page_text(b"BT (a \\(b\\) \\101\\n) Tj (c) ' ET % note (x) Tj\nBT 5 5 Td (d) Tj ET") == "a (b) A\nc\nd"
    assert pdf.page_text(b"q 1 0 0 1 0 0 cm /Im1 Do Q") == ""


def test_pdf_running_heads_go():
    pages = [["Jane Roe", f"body {i}", "more", "text", f"tail {i}", "confidential"] for i in range(4)]
    text = pdf.read_pdf(pdf.write_pdf(pages))
    assert "Jane Roe" not in text and "confidential" not in text and all(f"body {i}" in text and f"tail {i}" in text for i in range(4))
    assert "Jane Roe" in pdf.read_pdf(pdf.write_pdf(pages[:1]))


def test_damaged_pdfs():
    good = pdf.write_pdf([["some text"], ["other text"]])
    assert pdf.read_pdf(b"") == pdf.read_pdf(b"no pdf") == pdf.read_pdf(good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")) == ""
    assert "some text" in pdf.read_pdf(good[: good.index(b"trailer")])  # no trailer
    tree = good.replace(b"/Type /Pages", b"/Type /Other").replace(b"/Type /Page ", b"/Type /Leaf ")
    assert pdf.read_pdf(tree) == "some text\n\nother text"  # no page tree: every stream
    for i in range(0, len(good), 7):  # never an error
        pdf.read_pdf(good[:i] + b"\xff\x00" + good[i + 2 :])
    cut = zlib.compress(b"BT 1 1 Td (kept) Tj ET" + b" " * 5000)
    assert pdf.inflate(cut[:-6]).startswith(b"BT 1 1 Td (kept)")


def test_object_streams():
    page = b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>"
    inner = b"4 0 " + page
    objects = b"%PDF-1.5\n2 0 obj\n<< /Type /Pages /Kids [4 0 R] >>\nendobj\n5 0 obj\n<< /Type /ObjStm /N 1 /First 4 /Length " + str(len(inner)).encode() + b" >>\nstream\n" + inner + b"\nendstream\nendobj\n"
    content = b"BT 9 9 Td (packed) Tj ET"
    assert pdf.read_pdf(objects + b"6 0 obj\n<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream\nendobj\n") == "packed"
