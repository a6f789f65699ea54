"""Workbooks against their own rows, and against a file as other programs write it."""

import io
import zipfile

from satchel.sources import workbooks as W


def test_round_trip(spark):
    rows = [(i, i % 3, f"name {i} <&> \x0b _x0041_ é\n2", i / 4 if i % 5 else None) for i in range(25)]
    table = spark.createDataFrame(rows, "id long, account_id long, description string, amount double").coalesce(1)
    made = W.workbooks(table, per_file=10)
    assert sorted(r.n for r in made.collect()) == [5, 10, 10]
    got = sorted((r.id, r.account_id, r.description, None if r.amount is None else float(r.amount)) for r in W.import_workbooks(made, "finance_transactions").collect())
    assert got == rows
    assert W.workbooks(table.where("id < 0")).count() == 0


def test_shared_strings_gaps_and_broken_files(spark):
    sheet = f'<worksheet xmlns="{W.MAIN}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="C2"><v>1.5</v></c></row><row r="3"><c r="C3" t="inlineStr"><is><t>no number</t></is></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{W.MAIN}"><si><t>nr</t></si><si><r><t>am</t></r><r><t>ount</t></r></si></sst>')
    files = spark.createDataFrame([(bytearray(out.getvalue()),), (bytearray(b"no workbook"),), (None,)], "content binary")
    got = sorted(((r.id, r.amount and float(r.amount)) for r in W.import_workbooks(files, "finance_transactions", {"nr": "id"}).collect()), key=str)
    assert got == [(7, 1.5), (None, None)]
