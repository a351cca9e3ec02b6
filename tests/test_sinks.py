import io
import random
import zipfile

from pyspark.sql import functions as F

from velar.operators import detect, redact, search
from velar.sinks import ooxml as sink
from velar.sources import markup, ooxml
from velar.streaming import detection  # noqa: F401
from .test_sources import S, W, package

R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def members(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert all(i.date_time == (1980, 1, 1, 0, 0, 0) for i in z.infolist())
        return {n: z.read(n).decode() for n in z.namelist()}


def test_pieces_hold_the_whole_edit():
    rng = random.Random(3)
    for _ in range(500):
        pieces = ["".join(rng.choices("abc ", k=rng.randint(0, 6))) for _ in range(rng.randint(1, 5))]
        spans = [(a, a + rng.randint(0, 9), rng.choice([None, "", "NEW"])) for a in rng.choices(range(15), k=rng.randint(0, 4))]
        whole, out, at = "".join(pieces), "", 0
        for a, b, new in sorted(spans, key=lambda s: (s[0], s[1])):
            a, b = max(a, at), min(b, len(whole))
            if a < b:
                out += whole[at:a] + ("█" * max(4, b - a) if new is None else new)
                at = b
        got = markup.spliced(pieces, spans, "█", 4)
        assert len(got) == len(pieces) and "".join(got) == out + whole[at:]


def test_word_file_is_redacted_and_sanitised(spark, tmp_path):
    body = (
        f'<w:document {W} {R}><w:body><w:p w:rsidR="00A1"><w:r><w:t>Write to an</w:t></w:r><w:r><w:t>n@b.org &amp; Co</w:t></w:r></w:p>'
        '<w:p><w:hyperlink r:id="rId9"><w:r><w:t>joe@c.org</w:t></w:r></w:hyperlink></w:p>'
        '<w:p><w:del w:author="Eve"><w:r><w:delText>old secret</w:delText></w:r></w:del><w:ins w:author="Eve" w:date="2024"><w:r><w:t>kept > text</w:t></w:r></w:ins></w:p>'
        '<w:p><w:commentRangeStart w:id="1"/><w:r><w:t xml:space="preserve"> plain </w:t></w:r></w:p></w:body></w:document>'
    )
    package(
        tmp_path / "a.docx", word__document_xml=body, word__header1_xml=f"<w:hdr {W}><w:p><w:r><w:t>head x@y.org</w:t></w:r></w:p></w:hdr>", word__comments_xml="<c>secret</c>",
        docProps__core_xml="<p>Eve</p>",
        word___rels__document_xmlDOTrels='<Relationships xmlns="x"><Relationship Id="rId9" Target="mailto:joe@c.org" TargetMode="External"/><Relationship Id="rId2" Target="comments.xml"/><Relationship Id="rId3" Target="header1.xml"/></Relationships>',
    )
    (tmp_path / "bad.docx").write_bytes(b"no package")
    (tmp_path / "old.doc").write_bytes(b"x")
    (tmp_path / "scan.pdf").write_bytes(b"x")
    files = ooxml.files(spark, str(tmp_path))
    assert sorted((r.path[-8:], r.reason) for r in ooxml.rejects(spark, str(tmp_path)).collect()) == [("/old.doc", "save as a newer kind than doc"), ("scan.pdf", "unknown kind pdf")]
    found = detect.with_spans(ooxml.blocks(files).where("error is null"), categories=["email"])
    edits = found.select("path", "block_id", redact.edits_of(F.col("spans"), F.col("text"), F.col("language"), F.lit(0)).alias("edits"))
    rows = {r.path[-8:]: r for r in sink.redacted_files(files, edits).collect()}
    assert rows["bad.docx"].error == "unreadable: BadZipFile" and rows["bad.docx"].content is None
    got = members(next(r for k, r in rows.items() if k.endswith("a.docx")).content)
    assert set(got) == {"word/document.xml", "word/header1.xml", "word/_rels/document.xml.rels"}
    doc = got["word/document.xml"]
    assert "<w:t>Write to ████" in doc and "█</w:t></w:r><w:r><w:t> &amp; Co</w:t>" in doc and "@" not in doc and "rId9" not in doc
    assert "old secret" not in doc and "kept > text" in doc and "w:ins" not in doc and "Eve" not in doc and "rsid" not in doc and "commentRange" not in doc
    assert "x@y" not in got["word/header1.xml"] and "rId3" in got["word/_rels/document.xml.rels"] and "joe" not in got["word/_rels/document.xml.rels"]
    one = next(r for k, r in rows.items() if k.endswith("a.docx"))
    assert one.name == f"redacted-{one.sha256[:16]}.docx"
    texts = spark.createDataFrame([(one.path, "kept > text"), (one.path, "JOE@c.org"), (one.path, "Co")], "path string, text string")
    left = sink.package_leftovers(sink.redacted_files(files, edits), texts)
    assert {r.text for r in left.collect()} == {"kept > text", "Co"}


def test_excel_file_is_redacted(spark, tmp_path):
    sheet = (
        f'<worksheet {S}><cols><col min="2" max="2" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>2</v></c></row>'
        '<row r="2" hidden="1"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45366.5</v></c><c r="C2" s="2"><v>42</v></c><c r="D2" t="str"><f>A2</f><v>ann@b.org</v></c></row></sheetData>'
        '<hyperlinks><hyperlink ref="A2" r:id="r1"/></hyperlinks><headerFooter><oddHeader>&amp;Lby ann@b.org&amp;Rpage</oddHeader></headerFooter></worksheet>'
    )
    package(
        tmp_path / "b.xlsx",
        xl__workbook_xml=f'<workbook {S}><sheets><sheet name="ann@b.org" r:id="r1"/><sheet name="██████████" r:id="r2" state="hidden"/></sheets></workbook>',
        xl___rels__workbook_xmlDOTrels='<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/><Relationship Id="r2" Target="/xl/worksheets/t.xml"/></Relationships>',
        xl__sharedStrings_xml=f"<sst {S}><si><t>Mail</t></si><si><r><t>to ann</t></r><r><t>@b.org!</t></r></si><si><t>When</t></si></sst>",
        xl__styles_xml=f'<styleSheet {S}><numFmts><numFmt numFmtId="170" formatCode="00000"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        xl__worksheets__s_xml=sheet,
        xl__worksheets__t_xml=f'<worksheet {S}><sheetData/></worksheet>',
    )
    files = ooxml.files(spark, str(tmp_path))
    blocks = ooxml.blocks(files).withColumn("text", search.visible_value(F.col("kind"), F.col("text"), F.col("number_format")))
    rows = {r.block_id: (r.origin, r.row, r.col, r.text, r.hidden) for r in blocks.collect()}
    assert rows[0] == ("title", 0, 0, "ann@b.org", False) and rows[1] == ("cell", 1, 1, "Mail", False) and rows[2] == ("cell", 1, 2, "When", True)
    assert rows[3] == ("cell", 2, 1, "to ann@b.org!", True) and rows[4] == ("cell", 2, 2, "15/03/2024 12:00:00", True) and rows[5][3] == "00042"
    assert rows[6][3] == "ann@b.org" and rows[7] == ("header", 0, 0, "by ann@b.org", False) and rows[8][3] == "page" and rows[9][3] == "█" * 10
    found = detect.with_spans(blocks, categories=["email"])
    edits = found.select("path", "block_id", redact.edits_of(F.col("spans"), F.col("text"), F.col("language"), F.lit(0)).alias("edits"))
    extra = spark.createDataFrame([(blocks.first().path, 4, [(0, 3, "shifted")]), (blocks.first().path, 99, [(0, 3, None)])], f"path string, block_id int, edits array<{redact.EDIT}>")
    done = sink.redacted_files(files, edits.where("block_id != 4").unionByName(extra)).first()
    got = members(done.content)
    assert not any("ann@b" in x or "@b.org" in x for x in got.values())
    assert "to █████████!</t>" in got["xl/worksheets/s.xml"] and ">shifted</t>" in got["xl/worksheets/s.xml"] and "<v>42</v>" in got["xl/worksheets/s.xml"] and "hyperlink" not in got["xl/worksheets/s.xml"]
    assert '<c r="D2" t="inlineStr">' in got["xl/worksheets/s.xml"] and "&amp;Lby █████████&amp;Rpage" in got["xl/worksheets/s.xml"]
    assert "<t>Mail</t>" in got["xl/sharedStrings.xml"] and "to ann" not in got["xl/sharedStrings.xml"]
    assert 'name="█████████"' in got["xl/workbook.xml"]
    again = spark.createDataFrame([("x.xlsx", bytearray(done.content), None)], "path string, content binary, error string")
    shown = {r.text for r in ooxml.blocks(again).collect()}
    assert {"to █████████!", "shifted", "Mail", "by █████████"} <= shown
