import re

from velar.functions.formulas import quoted_sheet, renamed, sheets_named
from velar.sinks import ooxml as sink
from velar.sources.markup import elements
from .test_sources import S

NAMES = {"juan": "Anon", "mi hoja": "New 1", "o'neil": "Plain"}
CASES = {
    "SUM(Juan!A1:B2)+1": "SUM(Anon!A1:B2)+1",
    "JUAN!A1&\"Juan!A1\"": "Anon!A1&\"Juan!A1\"",
    "'Mi Hoja'!$A$1*'mi hoja'!B2": "'New 1'!$A$1*'New 1'!B2",
    "'O''Neil'!A1": "Plain!A1",
    "SUM(Juan:Otro!A1)": "SUM(Anon:Otro!A1)",
    "SUM('Otro:Mi Hoja'!A1)": "SUM('Otro:New 1'!A1)",
    "[1]Juan!A1+'[Libro.xlsx]Mi Hoja'!A1": "[1]Juan!A1+'[Libro.xlsx]Mi Hoja'!A1",
    "Juana!A1+MiJuan!A1+Juan": "Juana!A1+MiJuan!A1+Juan",
    "\"say \"\"Juan!\"\" \"&Juan!A1": "\"say \"\"Juan!\"\" \"&Anon!A1",
    "#REF!+Juan!A1": "#REF!+Anon!A1",
    "": "",
}


def test_formulas_by_hand():
    for old, new in CASES.items():
        assert renamed(old, NAMES) == new and renamed(old, {}) == old, old
    assert quoted_sheet(["A1"]) == "'A1'!" and quoted_sheet(["a b"]) == "'a b'!" and quoted_sheet(["ok", "Ok2x"]) == "ok:Ok2x!"
    assert sheets_named("SUM('a b:c'!A1)+D!A1+\"E!\"+[1]F!A1") == ["a b", "c", "D"]


def test_no_formula_keeps_an_old_title():
    sheet = (
        f'<worksheet {S}><sheetData><row r="1"><c r="A1"><f>Juan!A2+\'Otra\'!A1</f><v>1</v></c><c r="B1" t="inlineStr"><is><t>x</t></is></c></row></sheetData>'
        "<conditionalFormatting><cfRule><formula>Juan!A1&gt;1</formula></cfRule></conditionalFormatting>"
        "<dataValidations><dataValidation><formula1>'Juan'!$A$1:$A$9</formula1><formula2>9</formula2></dataValidation></dataValidations></worksheet>"
    )
    members = {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Juan" r:id="r1"/><sheet name="Otra" r:id="r2"/></sheets><definedNames><definedName name="n">Juan!$A$1</definedName></definedNames></workbook>'.encode(),
        "xl/_rels/workbook.xml.rels": b'<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>',
        "xl/worksheets/s1.xml": sheet.encode(),
        "xl/worksheets/s2.xml": sheet.encode(),
        "xl/charts/chart1.xml": b'<c:chart xmlns:c="c"><c:f>Juan!$A$1:$A$3</c:f></c:chart>',
        "xl/pivotCache/pivotCacheDefinition1.xml": b'<d xmlns="x"><worksheetSource ref="A1" sheet="Juan"/></d>',
        "xl/media/image1.xml.bin": b"\0Juan!A1",
    }
    done = sink.excel_redacted(members, {0: [(0, 4, "Hoja uno")]})
    for name, data in done.items():
        if name.endswith(".xml"):
            texts = [e.text for e in elements(data)] + [v for e in elements(data) for v in e.attributes.values()]
            assert not any(re.search(r"\bJuan\b", t) for t in texts), name
    assert b"'Hoja uno'!A2+'Otra'!A1" in done["xl/worksheets/s2.xml"] and b"'Hoja uno'!$A$1:$A$9" in done["xl/worksheets/s1.xml"]
    assert b"'Hoja uno'!$A$1:$A$3" in done["xl/charts/chart1.xml"] and b'sheet="Hoja uno"' in done["xl/pivotCache/pivotCacheDefinition1.xml"]
    assert done["xl/media/image1.xml.bin"] == b"\0Juan!A1" and sink.excel_redacted(members, {})["xl/charts/chart1.xml"] == members["xl/charts/chart1.xml"]
