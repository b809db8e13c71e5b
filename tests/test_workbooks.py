"""Receipts in workbooks that the test writes, and tables in two encodings."""

from __future__ import annotations

import datetime as dt
import zipfile

from basketry.sources import files, workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets: dict[str, str], active: int = 0, shared: tuple = ()) -> None:
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i == 2 else ""}worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00 &quot;rub d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")


HEADER = "".join(f'<c r="{c}2" t="inlineStr"><is><t>{h}</t></is></c>' for c, h in zip("ABCDF", ["Дата покупки", "Магазин", "Наименование товара", "Кол-во", "Цена, руб"], strict=True))


def test_a_workbook_reads_back(spark, tmp_path):
    shared = ("<r><t>Сыр </t></r><r><t>мягкий</t></r><rPh><t>x</t></rPh>", "<t>Лавка</t>")
    rows = f'<row r="1"/><row r="2">{HEADER}</row><row r="3"><c r="A3" s="1"><v>45413</v></c><c r="B3" t="s"><v>1</v></c><c r="C3" t="s"><v>0</v></c><c r="D3"><v>2</v></c><c r="F3" s="3"><v>10.5</v></c></row>'
    rows += '<row r="4"><c r="A4" s="2"><v>45414.75</v></c><c r="C4" t="str"><f>1</f><v>Чай</v></c><c r="F4"><v>7</v></c></row><row r="5"><c r="D5"><v>3</v></c></row>'
    workbook(tmp_path / "a.xlsx", {"other": "<row><c><v>1</v></c></row>", "receipt": rows}, 1, shared)
    workbook(tmp_path / "b.xlsx", {"receipt": f'<row>{HEADER.replace("2", "1")}</row><row><c t="inlineStr"><is><t>02.05.2024</t></is></c><c/><c t="inlineStr"><is><t>Хлеб</t></is></c><c/><c/><c><v>30</v></c></row>'})
    workbook(tmp_path / "c.xlsx", {"empty": ""})
    (tmp_path / "d.xlsx").write_bytes(b"no workbook")
    got = [tuple(r)[1:] for r in workbooks.receipt_workbook(spark, str(tmp_path / "*.xlsx")).collect()]
    want = [(dt.date(2024, 5, 1), "Лавка", "Сыр мягкий", 2.0, 10.5, 21.0), (dt.date(2024, 5, 2), None, "Чай", 1.0, 7.0, 7.0), (dt.date(2024, 5, 2), None, "Хлеб", 1.0, 30.0, 30.0)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_tables_in_two_encodings(spark, tmp_path):
    text = "Дата;Магазин;Товар;Количество;Цена;Сумма\n01.05.2024;Лавка;{};2;;10,00\n"
    (tmp_path / "a.csv").write_text(text.format("Сыр"), encoding="utf-8")
    (tmp_path / "b.csv").write_text(text.format("Чай"), encoding="cp1251")
    got = files.receipt_table(spark, str(tmp_path / "*.csv")).collect()
    assert sorted(r["name"] for r in got) == ["Сыр", "Чай"] and {r.store for r in got} == {"Лавка"} and {r.price for r in got} == {5.0}
