import zipfile

import pytest

from axiomloom.sources import owl, rdf, tables, writers

HEADER = ["ID ", "Name", "note"]
BODY = [["1", " alpha α", ""], ["", "", ""], ["2", "beta", "x"]]


def csv_file(folder):
    path = folder / "t.csv"
    path.write_text("\n".join(",".join(r) for r in [HEADER, *BODY]) + "\n", encoding="utf-8")
    return str(path)


def fods_file(folder):
    cells = "".join("<table:table-row>" + "".join(f"<table:table-cell><text:p>{v}</text:p></table:table-cell>" if v else "<table:table-cell/>" for v in r) + "</table:table-row>" for r in [HEADER, *BODY])
    path = folder / "t.fods"
    path.write_text(f'<office:document xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><office:body><office:spreadsheet><table:table table:name="table">{cells}<table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="1000"/></table:table-row></table:table></office:spreadsheet></office:body></office:document>', encoding="utf-8")
    return str(path)


def xlsx_file(folder):
    path = folder / "t.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = ""
    for k, r in enumerate([HEADER, *BODY], 1):
        rows += f'<row r="{k}">' + "".join(f'<c r="{chr(65 + j)}{k}" ' + (f"><v>{v}</v></c>" if v.isdigit() else f't="inlineStr"><is><t>{v}</t></is></c>') for j, v in enumerate(r) if v) + "</row>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="table" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    return str(path)


@pytest.mark.parametrize("make", [csv_file, fods_file, xlsx_file])
def test_tables(spark, tmp_path, make):
    t = tables.table(make(tmp_path))
    assert t.name == "table" and t.columns == ["id", "name", "note"]
    rows = list(t)
    assert [(r.number, r["NAME"], r["note"]) for r in rows] == [(2, "alpha α", ""), (4, "beta", "x")]
    assert rows[0]["absent"] == "" and "Name" in rows[0]
    with pytest.raises(tables.TableError):
        t.need("Missing")
    assert tables.frame(spark, t).where("id = '2'").first()["_row_num"] == 4
    with pytest.raises(KeyError):
        tables.table(t.file, "other")
    assert "beta" in tables.text_of(t.file)


def test_table_errors(tmp_path):
    for text in ("a,b\n1\n", "a,A\n1,2\n"):
        (tmp_path / "x.csv").write_text(text)
        with pytest.raises(tables.TableError):
            tables.read_tables(str(tmp_path / "x.csv"))
    for name in ("x.xls", "x.txt", "x.CSV"):
        with pytest.raises(tables.TableError):
            tables.read_tables(str(tmp_path / name))


def test_parallel_csv(spark, tmp_path):
    got = tables.read_csv(spark, csv_file(tmp_path))
    assert sorted((r["id"], r["name"], r["note"]) for r in got.collect()) == [("1", "alpha α", ""), ("2", "beta", "x")]


def document(name):
    return owl.from_triples(*rdf.parse_document(open(f"{__file__.rpartition('/')[0]}/fixtures/{name}", "rb").read()))


@pytest.mark.parametrize("form", ["RDF/XML", "turtle", "N-Triples"])
def test_round_trip(form):
    doc = document("zoo.ttl")
    again = owl.from_triples(*rdf.parse_document(writers.write(doc, form)))
    assert set(again.axioms) == set(doc.axioms) and set(again.expressions) == set(doc.expressions)
    assert (again.iri, again.imports) == (doc.iri, doc.imports)


def test_other_formats():
    doc = document("zoo.ttl")
    text = writers.write(doc, "Manchester")
    assert "EquivalentTo: " in text and "some obo:ZOO_0011" in text and "Facts: " in text
    assert writers.write(doc, "owl/xml").count("<Declaration>") == 10
    with pytest.raises(ValueError):
        writers.write(doc, "json")


def test_ntriples(spark, tmp_path):
    doc = document("zoo.ttl")
    (tmp_path / "z.nt").write_text(writers.write(doc, "N-Triples") + "not a triple\n", encoding="utf-8")
    got = rdf.read_ntriples(spark, str(tmp_path / "z.nt"), strict=False)
    want = set(owl.to_triples(doc))
    assert {(r.s, r.p, r.o, r.datatype, r.lang) for r in got.collect() if not r.s.startswith("_:") and not r.o.startswith("_:")} == {(s, p, o, dt, lang) for s, p, o, _, dt, lang in want if not s.startswith("_:") and not o.startswith("_:")}


def test_load(spark, tmp_path):
    doc = document("zoo.ttl")
    (tmp_path / "z.ttl").write_text(writers.write(doc, "turtle"), encoding="utf-8")
    axioms, expressions = owl.load(spark, str(tmp_path / "z.ttl"))
    assert {r.axiom_id for r in axioms.collect()} == set(doc.axioms) and expressions.count() == len(doc.expressions)
    with pytest.raises(rdf.RDFError):
        rdf.parse_turtle("x:y a z:w .")


class Answer:
    def __init__(self, status, location=None):
        self.status, self.headers = status, {"Location": location} if location else {}


def test_redirects():
    from axiomloom.sources import net

    pages = {"/a": Answer(302, "/b"), "/b": Answer(301, "https://other.example/c"), "/c": Answer(200), "/x": Answer(302, "/x"), "/gone": Answer(404)}

    class Fake:
        def __init__(self, scheme, host):
            self.path = None

        def request(self, method, path):
            assert method == "HEAD"
            self.path = path

        def getresponse(self):
            return pages[self.path]

    assert net.final_url("http://one.example/a", Fake) == "https://other.example/c"
    with pytest.raises(net.ConnectionFailError):
        net.final_url("http://one.example/x", Fake)
    with pytest.raises(net.NotFoundError):
        net.final_url("http://one.example/gone", Fake)
    with pytest.raises(net.ConnectionFailError):
        net.head("ftp://one.example/a")


def test_shown_numbers():
    from datetime import datetime

    from axiomloom.sources.tables import _shown

    epoch = datetime(1899, 12, 30)
    cases = [
        (1234.5, "#,##0.00", "1,234.50"), (0.5, "0%", "50%"), (0.256, "0.0%", "25.6%"), (-3.0, "0;(0)", "(3)"), (5.0, "000", "005"), (12345.678, "0.00E+00", "1.23E+04"), (3.0, "", "3"), (3.25, "General", "3.25"), (2.5, "0", "3"), (0.5, "#.##", ".5"),
        (45292.0, "yyyy-mm-dd", "2024-01-01"), (45292.75, "d mmm yyyy h:mm AM/PM", "1 Jan 2024 6:00 PM"), (0.5, "h:mm:ss", "12:00:00"), (1.25, "[h]:mm", "30:00"), (45292.0, "m/d/yy", "1/1/24"), (7.0, '0 "kg"', "7 kg"),
    ]
    assert [(n, f, _shown(n, f, epoch)) for n, f, _ in cases] == cases


def test_bad_triples(spark, tmp_path):
    import pytest

    from axiomloom.sources import rdf

    (tmp_path / "a.nt").write_text('<a:s> <a:p> "x\\\\new" .\n\n# c\n<a:s> <a:p> oops .\n')
    assert [r.o for r in rdf.read_ntriples(spark, str(tmp_path), strict=False).collect()] == ["x\\new"]
    with pytest.raises(Exception, match="Not a triple: <a:s> <a:p> oops"):
        rdf.read_ntriples(spark, str(tmp_path)).collect()


def test_sheets_with_gaps(tmp_path):
    """A workbook's rows go on after any number of blank ones."""
    import zipfile

    from axiomloom.catalogue_sources import _xlsx
    from axiomloom.sources import tables

    data = _xlsx({"s": [[("text", "A", 0)], [("text", "first", 0)]]}, [])
    path = tmp_path / "gap.xlsx"
    path.write_bytes(data)
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/worksheets/s1.xml"] = parts["xl/worksheets/s1.xml"].replace(b"</sheetData>", b'<row r="5000"><c t="inlineStr"><is><t>last</t></is></c></row></sheetData>')
    with zipfile.ZipFile(path, "w") as z:
        for n, d in parts.items():
            z.writestr(n, d)
    assert [(r.number, r["a"]) for r in tables.read_tables(str(path))[0]] == [(2, "first"), (5000, "last")]


def test_cells_after_wide_gaps(tmp_path):
    """Empty cells before a filled one keep it in its column, however many there are."""
    columns = [f"c{k}" for k in range(1500)]
    cell = lambda text, times=1: f'<table:table-cell table:number-columns-repeated="{times}">' + (f"<text:p>{text}</text:p>" if text else "") + "</table:table-cell>"
    rows = ["".join(cell(c) for c in columns), cell("", 1400) + cell("far") + cell("", 14_000), cell("near") + cell("", 16_000)]
    path = tmp_path / "wide.fods"
    path.write_text('<office:document xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><table:table table:name="t">' + "".join(f"<table:table-row>{r}</table:table-row>" for r in rows) + "</table:table></office:document>")
    (table,) = tables.read_odf_tables(str(path))
    assert [(n, [(k, v) for k, v in enumerate(values) if v]) for n, values in table.rows] == [(2, [(1400, "far")]), (3, [(0, "near")])]


def test_formula_without_a_value(tmp_path):
    import io
    import zipfile

    from axiomloom.catalogue_sources import _xlsx

    data, out = _xlsx({"s": [[("text", "A", 0)], [("text", "first", 0)]]}, []), io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            content = old.read(name)
            if "sheet" in name and b"<sheetData>" in content:
                content = content.replace(b"</sheetData>", b'<row r="3"><c r="A3"><f>1+1</f></c></row></sheetData>')
            new.writestr(name, content)
    path = tmp_path / "formula.xlsx"
    path.write_bytes(out.getvalue())
    with pytest.raises(tables.TableError, match="formula"):
        tables.read_xlsx_tables(str(path))
