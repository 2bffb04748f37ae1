"""Sources: CSV text reader, JSON shapes, workbook reader, SQL source."""

import io
import json
import os
import tempfile
import zipfile

import pytest

from quarry.sources.catalog import sql_source
from quarry.sources.records import flatten_json, read_json_records
from quarry.sources.text import pandas_header_names, read_csv_text
from quarry.sources.workbook import parse_first_sheet, read_workbooks


def _tmp():
    return tempfile.mkdtemp(prefix="quarry-test-")


def test_header_names():
    assert pandas_header_names(["a", "", "a", None, "a"]) == ["a", "Unnamed: 1", "a.1", "Unnamed: 3", "a.2"]


def test_csv_text(spark):
    d = _tmp()
    with open(os.path.join(d, "x.csv"), "w") as f:
        f.write('id,,qty,note\n1,z," 5 ","a, ""quoted""\nline"\n2,z,NA,#N/A\n')
    df = read_csv_text(spark, d)
    assert df.columns == ["id", "Unnamed: 1", "qty", "note"]
    rows = df.orderBy("id").collect()
    assert rows[0]["note"] == 'a, "quoted"\nline' and rows[0]["qty"] == " 5 "
    assert rows[1]["qty"] is None and rows[1]["note"] is None
    assert dict(df.dtypes)["id"] == "string"


def _write(d, name, payload):
    with open(os.path.join(d, name), "w") as f:
        f.write(json.dumps(payload))


@pytest.mark.parametrize("payload, expect_cols, expect_rows", [
    ([{"a": 1}, {"b": 2}], ["a", "b"], 2),
    ({"data": [{"a": 1}, {"a": 2}], "items": [{"z": 1}]}, ["a"], 2),
    ({"results": [{"r": 1}]}, ["r"], 1),
    ({"data": {"x": 1}, "items": [{"i": 1}, {"i": 2}]}, ["i"], 2),
    ({"a": {"b": 1, "c": {"d": 2}}, "l": [1, 2]}, ["a.b", "a.c.d", "l"], 1),
])
def test_json_shapes(spark, payload, expect_cols, expect_rows):
    d = _tmp()
    _write(d, "p.json", payload)
    df = read_json_records(spark, d, multi_line=True)
    assert sorted(df.columns) == sorted(expect_cols)
    assert df.count() == expect_rows


def test_json_scalar_is_error(spark):
    d = _tmp()
    _write(d, "p.json", 5)
    with pytest.raises(Exception, match="not an object or a list of objects"):
        read_json_records(spark, d, multi_line=True)


def test_json_documents_of_all_shapes(spark):
    d = _tmp()
    docs = [{"data": [{"a": 1}, {"a": 2}]}, {"data": {"x": 1}, "items": [{"a": 3}]}, {"a": 4, "n": {"k.z": [1, 2], "it's ?": "q"}},
            [{"a": 5, "n": {"deep": {"er": 1.25}}}], {"results": []}, {"data": 7, "results": [{"a": 6, "e": {}}]},
            {"a": 12345678901234567890123, "l": [1, "x", {"y": 1}], "o": [{"p": 1}, {"p q": None}], "m": 1}, {"m": "text", "u": None},
            {"m": {"z": 1}, "f": 0.1, "g": 1e300}, ["plain", 2, None, {"a": 8}]]
    for i, payload in enumerate(docs):
        _write(d, f"p{i}.json", payload)
    df = read_json_records(spark, d, multi_line=True)
    assert set(df.columns) == {"a", "n.k.z", "n.it's ?", "n.deep.er", "e", "l", "o", "m", "u", "f", "g", "0"}
    rows = [r.asDict(recursive=True) for r in df.collect()]
    assert len(rows) == 13
    by_a = {int(r["a"]): r for r in rows if r["a"] is not None}
    assert sorted(by_a) == [1, 2, 3, 4, 5, 6, 8, 12345678901234567890123]
    assert (by_a[4]["n.k.z"], by_a[4]["n.it's ?"], by_a[5]["n.deep.er"], by_a[6]["e"]) == ([1, 2], "q", 1.25, "{}")
    big = by_a[12345678901234567890123]
    assert (big["l"], [x["p"] for x in big["o"]]) == (["1", "x", '{"y":1}'], [1, None])
    assert {r["m"] for r in rows} == {None, "1", "text", '{"z":1}'}
    assert {(r["f"], r["g"]) for r in rows} == {(None, None), (0.1, 1e300)}
    assert {r["0"] for r in rows} == {None, "plain", "2"}


def test_json_lines_of_all_shapes(spark):
    d = _tmp()
    with open(os.path.join(d, "x.json"), "w") as f:
        f.write('[{"a": 1}, {"b": 2}]\n{"a": 3}\n\n{"items": [{"b": 4}]}\n')
    assert sorted((r["a"] or 0, r["b"] or 0) for r in read_json_records(spark, d).collect()) == [(0, 2), (0, 4), (1, 0), (3, 0)]
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write('{"a": \n')
    with pytest.raises(Exception, match="not an object or a list of objects"):
        read_json_records(spark, d)


def _xlsx(rows):
    shared, idx = [], {}
    def s(v):
        if v not in idx:
            idx[v] = len(shared)
            shared.append(v)
        return idx[v]
    cells = []
    for r, row in enumerate(rows, 1):
        cs = []
        for c, v in enumerate(row):
            ref = chr(65 + c) + str(r)
            if v is None:
                continue
            if isinstance(v, str):
                cs.append(f'<c r="{ref}" t="s"><v>{s(v)}</v></c>')
            else:
                cs.append(f'<c r="{ref}"><v>{v}</v></c>')
        cells.append(f'<row r="{r}">{"".join(cs)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{"".join(cells)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>' + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
    return buf.getvalue()


def test_workbook_reader(spark):
    d = _tmp()
    for i in range(3):
        with open(os.path.join(d, f"b{i}.xlsx"), "wb") as f:
            f.write(_xlsx([["id", "name", "score"], [i, f"n{i}", 1.5], [i + 10, None, 2]]))
    assert parse_first_sheet(_xlsx([["a"], [1]])) == [["a"], ["1"]]
    df = read_workbooks(spark, d)
    assert sorted(df.columns) == ["id", "name", "path", "row_no", "score"]
    assert df.count() == 6
    assert sorted(r["id"] for r in df.collect()) == ["0", "1", "10", "11", "12", "2"]


def test_sql_source_empty_is_error(spark):
    df = spark.range(3)
    assert sql_source(spark, "SELECT * FROM t WHERE id > 0", {"t": df}).count() == 2
    with pytest.raises(ValueError):
        sql_source(spark, "SELECT * FROM t WHERE id > 10", {"t": df})


def test_flatten_keeps_arrays(spark):
    df = spark.createDataFrame([((1, (2,)), [1, 2])], "a struct<b:int, c:struct<d:int>>, l array<int>")
    assert flatten_json(df).columns == ["a.b", "a.c.d", "l"]
