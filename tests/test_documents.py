"""Documents and patients' files: what is read, what is reported."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from tidemark.sources import documents, ingest, readers, writers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
LONG = "Kontrol gula darah " * 10


def docx(path, *paragraphs):
    body = "".join(f"<w:p><w:pPr/>{''.join(f'<w:r><w:t>{escape(t)}</w:t></w:r>' for t in p)}</w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {W}><w:body>{body}{table}<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r></w:p></w:body></w:document>')


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "docs"
    (at / "deep").mkdir(parents=True)
    docx(at / "Panduan_Gula-darah.docx", ["Kontrol ", "gula & insulin"], [LONG])
    (at / "b.TXT").write_bytes(b"caf\xc3\xa9 \xff" + LONG.encode())
    (at / "c.md").write_text(f"# T\n```\ncode\n```\n{LONG}")
    (at / "c copy.md").write_text(f"# T\n{LONG}")
    (at / "short.txt").write_text("short")
    (at / "bad.docx").write_bytes(b"no zip")
    (at / "x.pdf").write_bytes(b"%PDF")
    (at / "other.csv").write_text("1,2")
    (at / "deep" / "d.txt").write_text(LONG + "deep")
    return str(at)


def test_reading_kinds(spark, folder):
    got = {r.source: r for r in documents.read_documents(spark, folder).collect()}
    assert sorted(got) == ["Panduan_Gula-darah.docx", "b.TXT", "bad.docx", "c copy.md", "c.md", "short.txt", "x.pdf"]
    assert got["Panduan_Gula-darah.docx"].text == f"Kontrol gula & insulin\n{LONG}\na\tb\n"
    assert got["b.TXT"].text == "café " + LONG and "code" not in got["c.md"].text
    assert "BadZipFile" in got["bad.docx"].error and "PDF" in got["x.pdf"].error and got["x.pdf"].text is None
    assert {r.source for r in documents.read_documents(spark, folder, ["TXT"], recursive=True).collect()} == {"b.TXT", "short.txt", "d.txt"}
    with pytest.raises(ValueError, match="Unsupported extension: .csv"):
        documents.read_documents(spark, folder, ["txt", "csv"])
    with pytest.raises(ValueError, match="rtf"):
        documents.document_text("rtf", b"")


def test_import(spark, folder, tmp_path):
    base = str(tmp_path / "kb")
    counts, skipped = documents.import_documents(spark, folder, base, dry_run=True)
    assert counts == {"found": 7, "imported": 4, "skipped": 3} and not (tmp_path / "kb").exists()
    counts, skipped = documents.import_documents(spark, folder, base)
    assert counts["imported"] == 4
    reasons = {r.source: r.status for r in skipped.collect()}
    assert reasons["short.txt"] == "too short" and "zip" in reasons["bad.docx"].lower() and set(reasons) == {"short.txt", "bad.docx", "x.pdf"}
    kb = {r.source: r for r in spark.read.json(base).collect()}
    assert kb["Panduan_Gula-darah.docx"].topic == "Panduan Gula Darah" and kb["Panduan_Gula-darah.docx"].doc_id.startswith("ext_panduan_gula_darah_")
    counts, skipped = documents.import_documents(spark, folder, base, recursive=True)  # a rerun adds what is new
    assert counts == {"found": 8, "imported": 1, "skipped": 7}
    assert sum(r.status == "duplicate" for r in skipped.collect()) == 4 and spark.read.json(base).count() == 5


def xml(patient, glucose=100, extra=""):
    return f'<?xml version="1.0"?><patient id="{patient}"><glucose_level><event ts="01-01-2024 00:00:00" value="{glucose}"/><event ts="01-01-2024 00:05:00" value="110"/></glucose_level><finger_stick><event ts="01-01-2024 00:01:00" value="0"/></finger_stick><meal><event ts="01-01-2024 00:01:00" carbs="30"/></meal>{extra}</patient>'


def test_ingest_with_broken_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("559-ws-training.xml", xml(559)), ("563-ws-testing.xml", xml(563)), ("570-ws-training.xml", xml(570)[:150]), ("575-ws-training.xml", '<patient id="575"></patient>'), ("588-ws-training.xml", "<x/>"), ("notes.xml", xml(1))):
        (tmp_path / "in" / name).write_text(content)
    got = ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert got["smbg"] is None and not (tmp_path / "out" / "smbg").exists()  # a finger stick of 0 is no reading
    assert {k: got["cgm"][k] for k in ("rows", "patients", "carbs_share", "stress_share")} == {"rows": 4, "patients": 2, "carbs_share": 50.0, "stress_share": 0.0}
    assert spark.read.parquet(str(tmp_path / "out" / "cgm")).count() == 4
    errors = {r.file.rsplit("/", 1)[1]: r.error for r in got["errors"].collect()}
    assert errors == {"570-ws-training.xml": "XML is not closed", "575-ws-training.xml": "no event that can be read", "588-ws-training.xml": "no patient"}


def test_sources_and_sinks_of_files(spark, tmp_path):
    """The small readers and writers that no query uses."""
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("x,y\n1,2\n3,4\n")
    assert [r.rows for r in readers.list_datasets(spark, str(tmp_path / "csv")).collect()] == [2]
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "one.txt").write_text("text of one")
    (tmp_path / "txt" / "blank.txt").write_text(" \n")
    (tmp_path / "txt" / "two.md").write_text("a ```x``` b")
    assert [(r.doc_id, r.text) for r in readers.load_documents(spark, str(tmp_path / "txt")).collect()] == [("txt_one", "text of one")]
    assert [r.text for r in readers.load_markdown(spark, str(tmp_path / "txt")).collect()] == ["a  b"]
    log = str(tmp_path / "log")
    assert readers.load_logbook(spark, log, "timestamp string, note string").count() == 0
    for t in ("2024-01-01", "2024-01-02"):
        writers.append_entry(spark.createDataFrame([(t, "n")], "timestamp string, note string"), log)
    assert [r.timestamp for r in readers.load_logbook(spark, log, "timestamp string, note string").collect()] == ["2024-01-02", "2024-01-01"]
    states = str(tmp_path / "states")
    writers.write_states(spark.createDataFrame([("p", 1.5)], "patient_id string, g double"), states)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(states)
    good, bad = readers.read_states(spark, states, "patient_id string, g double")
    assert [tuple(r) for r in good.collect()] == [("p", 1.5)] and [r.value for r in bad.collect()] == ["{broken"]
    writers.write_readings(spark.createDataFrame([("p", 1.0), ("q", 2.0)], "patient_id string, glucose double"), str(tmp_path / "readings"))
    assert spark.read.parquet(str(tmp_path / "readings")).count() == 2
