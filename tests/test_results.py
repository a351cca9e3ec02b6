import json
import os

import pytest
from pyspark.sql import functions as F

from velar.sinks import ooxml as sink
from velar.sinks import results
from velar.sources import ooxml
from .test_sources import S, package


def tree(top):
    return sorted(os.path.relpath(os.path.join(d, f), top) for d, _, names in os.walk(top) for f in names if not f.startswith("."))


def rows(spark):
    made = [("/in/Juan Pérez.docx", b"one", None), ("/in/b.XLSX", b"two", None), ("/in/c.docx", b"one", None), ("/in/bad.docx", None, "too large"), ("/in/bad2.docx", None, "too large"), ("/in/x.docx", None, None)]
    return spark.createDataFrame(made, "path string, content binary, error string").repartition(3)


def test_documents_audits_and_rejects_under_generic_names(spark, tmp_path):
    audits = spark.createDataFrame([("/in/b.XLSX", 3, {"email": 2}), ("/in/none.docx", 1, None)], "path string, total int, `by.kind` map<string,int>")
    results.write_results(rows(spark), str(tmp_path / "out"), audits)
    found = tree(tmp_path / "out")
    folders = {f.split("/")[0] for f in found if "/" in f}
    assert len(folders) == 3 and "_SUCCESS" in found and "rejects.json" in found and not any("Juan" in f or "in" == f for f in found)
    docs = {f: (tmp_path / "out" / f).read_bytes() for f in found if "redacted." in f}
    assert sorted((f.rsplit(".")[-1], c) for f, c in docs.items()) == [("docx", b"one"), ("docx", b"one"), ("xlsx", b"two")]
    kept = [json.loads((tmp_path / "out" / f).read_text()) for f in found if f.endswith("audit.json")]
    assert sorted(map(str, kept)) == sorted(map(str, [{}, {}, {"total": 3, "by.kind": {"email": 2}}]))
    assert json.loads((tmp_path / "out/rejects.json").read_text()) == [{"reason": "too large", "files": 2}, {"reason": "unknown", "files": 1}]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    broken = rows(spark).withColumn("content", F.when(F.col("path") == "/in/c.docx", F.raise_error(F.lit("no more")).cast("binary")).otherwise(F.col("content")))
    spark.dataSource.register(results.Files)
    out = tmp_path / "out"
    with pytest.raises(Exception):
        broken.where("content is not null").select(F.sha2("path", 256).alias("name"), "content").write.format(results.FORMAT).mode("append").option("path", str(out)).save()
    assert not out.exists() or tree(out) == []


def test_overwriting_and_bad_names(spark, tmp_path):
    spark.dataSource.register(results.Files)
    out = str(tmp_path / "out")
    save = lambda data, mode: spark.createDataFrame(data, "name string, content binary").write.format(results.FORMAT).mode(mode).option("path", out).save()
    save([("a/1.txt", b"1"), ("2.txt", None)], "append")
    assert tree(out) == ["2.txt", "_SUCCESS", "a/1.txt"]
    save([("3.txt", b"3")], "overwrite")
    assert tree(out) == ["3.txt", "_SUCCESS"]
    for bad in ([("../x", b"1")], [("/etc/x", b"1")], [("_unfinished/x", b"1")], [("same", b"1"), ("same", b"2")]):
        with pytest.raises(Exception):
            save(bad, "append")
        assert tree(out) == ["3.txt", "_SUCCESS"]
    save([], "append")


def test_workbooks_of_any_size(spark, tmp_path):
    cells = "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c></row>' for k in range(1, 25_001))
    rels = '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'
    book = f'<workbook {S}><sheets><sheet name="A" sheetId="1" r:id="rId1"/></sheets></workbook>'
    package(tmp_path / "big.xlsx", xl__workbook_xml=book, xl___rels__workbook_xmlDOTrels=rels, xl__worksheets__sheet1_xml=f"<worksheet {S}><sheetData>{cells}</sheetData></worksheet>")
    files = ooxml.files(spark, str(tmp_path))
    found = ooxml.blocks(files)
    assert found.count() == 25_001 and found.where("text = '25000'").count() == 1 and found.where("error is not null").count() == 0
    refused = ooxml.blocks(files, most_cells=100).collect()
    assert [r.error for r in refused] == ["too many cells"]


def test_search_across_pieces(monkeypatch):
    monkeypatch.setattr(sink, "PIECE", 50)
    for at in range(30, 60):
        data = b"x" * at + "José &amp; García".encode() + b"y" * 200
        assert sink.found_in_package({"a.xml": data}, ["josé & garcía", "nobody"]) == ["josé & garcía"]
        raw = b"\0" * at + "Ana López".encode("utf-16le") + b"\0" * 90
        assert sink.found_in_package({"b.bin": raw}, ["Ana López", "ana"]) == ["Ana López"]


def test_the_driver_gets_no_names_and_stored_files_are_read_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(results, "MOST_NAMES", 7)
    out, writer = tmp_path / "out", results.FilesWriter(str(tmp_path / "out"), False)
    task = lambda names: writer.write(iter([{"name": n, "content": n.encode()} for n in names]))
    many = [task([f"{t}/{k}.txt" for k in range(100)] + [f"{t}/a\nb \u2028é.txt"]) for t in range(3)]
    assert all(len(str(vars(m))) < 300 and m.n == 101 for m in many)
    writer.commit([*many, None, task([])])
    assert len(tree(out)) == 304 and not (out / "_unfinished" / writer.job).exists()
    got = {r.name: bytes(r.content) for r in results.stored(spark, str(out)).collect()}
    assert len(got) == 303 and all(c == n.encode() for n, c in got.items())
    again = results.FilesWriter(str(tmp_path / "twice"), False)
    two = [again.write(iter([{"name": f"{k + t * 49}", "content": b""} for k in range(50)])) for t in range(2)]  # 49 is in both
    with pytest.raises(ValueError):
        again.commit(two)
    assert tree(tmp_path / "twice") == [] and results.stored(spark, str(tmp_path / "twice")).count() == 0
