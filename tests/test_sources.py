import zipfile

from pyspark.sql import functions as F

from velar.sources import ooxml
from velar.streaming.detection import open_documents, redacted_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("DOT", "."), text)


def test_word_and_excel_blocks(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    package(
        tmp_path / "a.docx",
        word__document_xml=f"<w:document {W}><w:body>{p('Body')}<w:tbl><w:tr><w:tc>{p('Cell a@b.org')}</w:tc></w:tr></w:tbl>{p('')}</w:body></w:document>",
        word__header1_xml=f"<w:hdr {W}>{p('Head')}</w:hdr>",
    )
    package(
        tmp_path / "b.xlsx",
        xl__workbook_xml=f'<workbook {S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        xl___rels__workbook_xmlDOTrels='<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        xl__sharedStrings_xml=f"<sst {S}><si><t>Name</t></si><si><r><t>Ann </t></r><r><t>Lee</t></r></si></sst>",
        xl__worksheets__s_xml=f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="AB2"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
    )
    (tmp_path / "c.docx").write_bytes(b"not a package")
    rows = ooxml.blocks(ooxml.files(spark, str(tmp_path))).collect()
    got = sorted((r.path[-6:], r.block_id, r.origin, r.row, r.col, r.is_formula, r.text) for r in rows if not r.error)
    assert got == [
        ("a.docx", 0, "body", None, None, None, "Body"), ("a.docx", 1, "body", None, None, None, "Cell a@b.org"), ("a.docx", 2, "header", None, None, None, "Head"),
        ("b.xlsx", 0, "title", 0, 0, False, "One"), ("b.xlsx", 1, "cell", 1, 1, False, "Name"), ("b.xlsx", 2, "cell", 2, 1, False, "Ann Lee"), ("b.xlsx", 3, "cell", 2, 28, True, "2"),
    ]
    assert [(r.path[-6:], r.error) for r in rows if r.error] == [("c.docx", "unreadable: BadZipFile")]
    assert ooxml.blocks(ooxml.files(spark, str(tmp_path), most_bytes=1)).where("error = 'too large'").count() == 3


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "mail a@b.org now"), (2, None)], "doc_id long, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").json(str(tmp_path / "in"))
    done = redacted_stream(stream, ["email"]).select("doc_id", "redacted")
    q = done.writeStream.format("memory").queryName("done").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r.doc_id, r.redacted) for r in spark.table("done").collect()} == {(1, "mail ███████ now"), (2, None)}
    touches = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:20:00"), (1, "2024-01-01 12:00:00")], "doc_id long, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted((r.touches, str(r.closes)[11:16]) for r in open_documents(touches, "doc_id", "t").collect()) == [(1, "12:30"), (2, "10:50")]
