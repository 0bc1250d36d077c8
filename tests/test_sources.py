from __future__ import annotations

import gzip
import hashlib
import io
import random
import tarfile
import zipfile

import pytest

from tablewright.errors import DatasetSchemaError, TableError
from tablewright.operators.convert import convert_strict
from tablewright.operators.profiling import column_profile
from tablewright.sources import archives, datasets, delimited, files, workbooks


def test_headers():
    assert delimited.normalise_headers([" a ", None, "a", "", "b"]) == ["a", "未命名字段_2", "a_2", "未命名字段_4", "b"]
    assert delimited.normalise_headers(["a", "a", "a_2", "a", "\ufeffb"]) == ["a", "a_3", "a_2", "a_4", "b"]


@pytest.mark.parametrize("encoding, name", [("utf-8-sig", "UTF-8"), ("gb18030", "GB18030"), ("utf-16", "UTF-16LE")])
def test_charsets_and_cells(spark, tmp_path, encoding, name):
    text = "城市;销量;备注\n上海;12;\n北京;7;好\n"
    (tmp_path / "t.csv").write_bytes(text.encode(encoding))
    assert files.charsets(spark, str(tmp_path)).first()["charset"] == name
    table = delimited.read_delimited(spark, str(tmp_path))
    assert [tuple(r) for r in table.orderBy("城市").collect()] == [("上海", "12", None), ("北京", "7", "好")]
    profile = {r["column"]: r for r in column_profile(table).collect()}
    assert profile["销量"]["inferred_type"] == "integer" and profile["备注"]["null_count"] == 1


def test_quoted_line_breaks_and_crlf(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,text\r\n1,"two\nlines, one cell"\r\n2,plain\r\n'.encode())
    rows = delimited.read_delimited(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "two\nlines, one cell"), ("2", "plain")]


def test_typed_versions(spark, tmp_path):
    raw = spark.createDataFrame([("上海", "12", "3.5", "是"), ("北京", " 7 ", "1e2", "否"), ("广州", "", "", "")], ["城市", "销量", "销售额", "是否促销"])
    types = {"城市": "text", "销量": "integer", "销售额": "number", "是否促销": "boolean"}
    typed = convert_strict(raw, types)
    assert [tuple(r) for r in typed.collect()] == [("上海", 12, 3.5, True), ("北京", 7, 100.0, False), ("广州", None, None, None)]
    store = datasets.DatasetStore(spark, str(tmp_path / "store"))
    assert [store.write(typed, "sales"), store.write(typed, "sales")] == [1, 2]
    assert [r["version"] for r in store.history("sales").collect()] == [2, 1]
    assert store.load("sales", 1).count() == 3
    with pytest.raises(TableError):
        store.load("sales", 9)


def test_conversion_errors_name_the_cell(spark):
    raw = spark.createDataFrame([(0, "1"), (1, "18.0"), (2, "x")], "position int, n string")
    with pytest.raises(DatasetSchemaError) as error:
        convert_strict(raw, {"n": "integer"}, row="position")
    assert error.value.details == {"row": 3, "column": "n", "data_type": "integer", "value": "18.0"}
    with pytest.raises(DatasetSchemaError):
        convert_strict(raw, {"other": "integer"}, row="position")


def zipped(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return buffer.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "good.zip").write_bytes(zipped({"区域.csv": "区域,金额\n东,1\n".encode("gb18030"), "sub/b.txt": b"x"}))
    (tmp_path / "bad.zip").write_bytes(zipped({"../outside.csv": b"a"}))
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    (tmp_path / "one.csv.gz").write_bytes(gzip.compress(b"a,b\n"))
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("inner.csv")
        info.size = 4
        t.addfile(info, io.BytesIO(b"q,w\n"))
        link = tarfile.TarInfo("link")
        link.type = tarfile.SYMTYPE
    rows = archives.expand_archives(spark, str(tmp_path)).collect()
    by_archive = {}
    for r in rows:
        by_archive.setdefault(r["archive"].split("/")[-1], []).append(r)
    assert sorted(r["member"] for r in by_archive["good.zip"]) == ["sub/b.txt", "区域.csv"]
    assert by_archive["bad.zip"][0]["member"] is None and "illegal" in by_archive["bad.zip"][0]["error"]
    assert by_archive["broken.zip"][0]["error"]
    assert by_archive["one.csv.gz"][0]["member"] == "one.csv" and bytes(by_archive["one.csv.gz"][0]["content"]) == b"a,b\n"
    assert by_archive["t.tar.gz"][0]["member"] == "inner.csv" and by_archive["t.tar.gz"][0]["size"] == 4


SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>flag</t></is></c></row>
<row r="2"><c r="A2" s="1"><v>46023</v></c><c r="B2"><v>12</v></c><c r="C2" t="b"><v>1</v></c></row>
<row r="3"><c r="A3" s="1"><v>46024</v></c><c r="C3" t="b"><v>0</v></c></row></sheetData></worksheet>"""


def test_workbooks(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = zipped(
        {
            "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="销售数据" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {main}><si><t>日期</t></si><si><t>销量</t></si></sst>",
            "xl/styles.xml": f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": SHEET,
        }
    )
    (tmp_path / "b.xlsx").write_bytes(book)
    table = workbooks.read_workbook(spark, str(tmp_path))
    assert table.columns == ["日期", "销量", "flag"]
    assert sorted(tuple(r) for r in table.collect()) == [("2026-01-01T00:00:00", "12", "True"), ("2026-01-02T00:00:00", None, "False")]


def test_files_beyond_one_task_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    """Hashes equal hashlib's for any bytes, line ends and names, though no file may be read whole."""
    noise, mark = random.Random(7).randbytes(300_000), b"\xef\xbb\xbf"
    contents = {
        "a.parquet": noise, "b [x] 50%20.csv": mark + noise + b"\n", "c.txt": mark + noise[:-1] + b"x", "d.txt": b"a\r\n" * 90_000, "e.txt": b"\n" * 200_000,
        "f.bin": bytes(250_000), "g.bin": noise[:65_536], "h.bin": noise[:65_537], "i.txt": mark * 70_000, "j.txt": b"short", "k.gz": gzip.compress(noise[:90_000]),
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(files, "WHOLE_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(files, "PACK_BYTES", 1 << 12, raising=False)
    limits = {"spark.sql.sources.binaryFile.maxLength": "100000", "spark.sql.files.maxPartitionBytes": "50000"}
    try:
        for key, value in limits.items():
            spark.conf.set(key, value)
        # one file is named twice
        rows = files.fingerprints(spark, [str(tmp_path), str(tmp_path / "a.parquet")]).collect()
    finally:
        for key in limits:
            spark.conf.unset(key)
    wanted = [(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()]
    assert sorted((r["name"], r["size"], r["sha256"]) for r in rows) == sorted([*wanted, wanted[0]])
