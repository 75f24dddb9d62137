"""Registered queries over files: tables and documents written from the star schema and read again, ontologies built and rendered; each with its SQL."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import Tables, query
from .functions import manchester
from .ontology import Ontology
from .operators import documents
from .plans.builder import Builder, ignored
from .plans.checkpoints import own_folder
from .schema import LABEL, OBO_BASE
from .sources import rdf, stanzas, tables


def _shared(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    return f"{own_folder(spark)}/files-{uuid.uuid4().hex}"


@query("""SELECT p_partkey::VARCHAR AS id, p_name || ', "' || p_type || '"' AS "full label", coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_brand END, '') AS brand FROM part""")
def csv_scan(spark, sf_dir):
    """A large CSV file with quoted cells, missing values and padding."""
    p, at = Tables(spark, sf_dir).part, _shared(spark)
    rows = p.select(F.col("p_partkey").alias(" ID"), F.concat(F.lit("  "), "p_name", F.lit(', "'), "p_type", F.lit('" ')).alias("Full Label "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("brand"))
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)
    return tables.read_csv(spark, at, multiline=False)


def _nations(spark, sf_dir) -> list:
    """The nations with their regions, in order: a table of fixed size."""
    t = Tables(spark, sf_dir)
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()


def _read(data: bytes, ext: str) -> list[tables.Table]:
    """The tables of a term file, which the driver reads."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "terms" + ext)
        with open(path, "wb") as f:
            f.write(data)
        return tables.read_tables(path)


def _frame(spark, found: list[tables.Table]) -> DataFrame:
    """Cells of all tables: where each is and what it holds."""
    rows = [(t.name, number, column, value) for t in found for number, values in t.rows for column, value in zip(t.columns, values, strict=True)]
    return spark.createDataFrame(rows, "sheet string, row long, name string, value string")


@query("""WITH n AS (SELECT n_nationkey + 2 + CASE WHEN n_nationkey > 9 THEN 1 ELSE 0 END AS row, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'table' AS sheet, row, 'nation' AS name, n_name AS value FROM n UNION ALL SELECT 'table', row, 'region, part', r_name || ', "x"' FROM n""")
def csv_term_table(spark, sf_dir):
    """A term table from CSV, with the numbers of its rows; the blank row counts and is left out."""
    lines = ['Nation ,"REGION, part"']
    for k, r in enumerate(_nations(spark, sf_dir)):
        lines += [" , "] if k == 10 else []
        lines.append(f'{r["n_name"]}," {r["r_name"]}, ""x"" "')
    return _frame(spark, _read("\ufeff".encode() + "\r\n".join(lines).encode(), ".csv"))


def _xlsx(sheets: dict[str, list[list[tuple[str, str, int]]]], formats: list[str]) -> bytes:
    """A workbook; a cell is (type, value, style)."""
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    cell = lambda kind, v, s: f'<c t="inlineStr"><is><t>{v}</t></is></c>' if kind == "text" else f'<c t="{kind}" s="{s}"><v>{v}</v></c>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><numFmts>' + "".join(f'<numFmt numFmtId="{200 + k}" formatCode="{f}"/>' for k, f in enumerate(formats)) + '</numFmts><cellXfs><xf numFmtId="0"/>' + "".join(f'<xf numFmtId="{200 + k}"/>' for k in range(len(formats))) + "</cellXfs></styleSheet>")
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{ns}"><sheetData>' + "".join("<row>" + "".join(cell(*c) for c in row) + "</row>" for row in rows) + "</sheetData></worksheet>")
    return out.getvalue()


@query("""WITH n AS (SELECT n_nationkey AS k, n_nationkey + 2 AS row, n_name FROM nation)
SELECT 'nations' AS sheet, row, 'name' AS name, n_name AS value FROM n UNION ALL SELECT 'nations', row, 'since', strftime(DATE '1899-12-30' + (40000 + 31 * k)::INT, '%Y-%m-%d') FROM n UNION ALL SELECT 'nations', row, 'size', CASE WHEN k = 0 THEN '0' ELSE k || ',000' END || '.50' FROM n
UNION ALL SELECT 'nations', row, 'plain', CASE WHEN k % 2 = 0 THEN (k // 2)::VARCHAR ELSE (k // 2) || '.5' END FROM n UNION ALL SELECT 'regions', r_regionkey + 2, 'region', r_name FROM region UNION ALL SELECT 'regions', r_regionkey + 2, 'eu', CASE WHEN r_regionkey = 3 THEN 'TRUE' ELSE 'FALSE' END FROM region""")
def excel_scan(spark, sf_dir):
    """Sheets of a workbook as they are shown: dates, decimals, thousands, truth values."""
    nations = _nations(spark, sf_dir)
    regions = sorted({(r["r_regionkey"], r["r_name"]) for r in nations})
    head = lambda *names: [("text", n, 0) for n in names]
    sheets = {
        "nations": [head("Name", " Since", "Size", "PLAIN")] + [[("text", r["n_name"], 0), ("n", str(40000 + 31 * r["n_nationkey"]), 1), ("n", str(1000 * r["n_nationkey"] + 0.5), 2), ("n", str(r["n_nationkey"] / 2), 0)] for r in nations],
        "regions": [head("Region", "EU")] + [[("text", name, 0), ("b", str(int(k == 3)), 0)] for k, name in regions],
    }
    return _frame(spark, _read(_xlsx(sheets, ["yyyy-mm-dd", "#,##0.00"]), ".xlsx"))


@query("""SELECT 'nations' AS sheet, n_nationkey + 2 AS row, 'name' AS name, n_name AS value FROM nation UNION ALL SELECT 'nations', n_nationkey + 2, 'same', 'x' FROM nation UNION ALL SELECT 'nations', n_nationkey + 2, 'again', 'x' FROM nation
UNION ALL SELECT 'regions', r_regionkey + 2, 'region', r_name FROM region""")
def opendocument_scan(spark, sf_dir):
    """Sheets of a flat OpenDocument file, with repeated cells and padding at the edges."""
    nations = _nations(spark, sf_dir)
    uri = "urn:oasis:names:tc:opendocument:xmlns:"
    cell = lambda v, times=1: f'<t:table-cell t:number-columns-repeated="{times}"><x:p>{v}</x:p></t:table-cell>'
    row = lambda *cells: f'<t:table-row>{"".join(cells)}<t:table-cell t:number-columns-repeated="16000"/></t:table-row>'
    sheet = lambda name, rows: f'<t:table t:name="{name}">{"".join(rows)}<t:table-row t:number-rows-repeated="1000000"><t:table-cell/></t:table-row></t:table>'
    regions = [name for _, name in sorted({(r["r_regionkey"], r["r_name"]) for r in nations})]
    body = sheet("nations", [row(cell("Name"), cell("Same"), cell("again ")), *(row(cell(r["n_name"]), cell("x", 2)) for r in nations)]) + sheet("regions", [row(cell("Region")), *(row(cell(n)) for n in regions)])
    return _frame(spark, _read(f'<o:document xmlns:o="{uri}office:1.0" xmlns:t="{uri}table:1.0" xmlns:x="{uri}text:1.0"><o:body>{body}</o:body></o:document>'.encode(), ".fods"))


@query(r"""SELECT 'http://x.org/part/' || p_partkey AS s, 'http://x.org/name' AS p, 'C:\new "' || p_name || '"' || chr(10) || 'été ' || chr(128512) AS o, 'literal' AS kind, '' AS datatype, 'en' AS lang FROM part
UNION ALL SELECT 'http://x.org/part/' || p_partkey, 'http://x.org/brand', 'http://x.org/é/' || p_brand, 'iri', '', '' FROM part UNION ALL SELECT '_:b' || p_partkey, 'http://x.org/size', p_size::VARCHAR, 'literal', 'http://www.w3.org/2001/XMLSchema#int', '' FROM part""")
def ntriples_scan(spark, sf_dir):
    """Lines of N-Triples with all kinds of escapes, comments and blank lines."""
    p, at = Tables(spark, sf_dir).part, _shared(spark)
    key = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("<http://x.org/part/"), key, F.lit('> <http://x.org/name> "C:\\\\new \\"'), "p_name", F.lit('\\"\\n\\u00E9t\\u00e9 \\U0001F600"@en .'))
    brand = F.concat(F.lit("<http://x.org/part/"), key, F.lit("> <http://x.org/brand> <http://x.org/\\u00E9/"), "p_brand", F.lit("> . # a comment"))
    size = F.concat(F.lit("_:b"), key, F.lit(' <http://x.org/size> "'), F.col("p_size").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#int> .'))
    p.select(F.explode(F.array(F.lit("# parts"), name, F.lit(""), brand, size)).alias("value")).write.text(at)
    return rdf.read_ntriples(spark, at)


@query("""SELECT 'http://x.org/s' || s_suppkey AS s, 'http://x.org/in' AS p, 'http://x.org/n' || s_nationkey AS o, 'iri' AS kind FROM supplier UNION ALL SELECT 'http://x.org/s' || s_suppkey, 'http://x.org/name', s_name, 'literal' FROM supplier""")
def document_scan(spark, sf_dir):
    """Turtle documents, read whole, one for each partition that wrote them."""
    s, at = Tables(spark, sf_dir).supplier.repartition(4), _shared(spark)
    key = F.col("s_suppkey").cast("string")
    line = F.concat(F.lit("<http://x.org/s"), key, F.lit("> <http://x.org/in> <http://x.org/n"), F.col("s_nationkey").cast("string"), F.lit("> ; <http://x.org/name> '''"), "s_name", F.lit("''' ."))
    s.select(line.alias("value")).write.text(at)
    return rdf.read_documents(spark, f"{at}/part-*").select("s", "p", "o", "kind")


def _table(spark, sf_dir) -> tables.Table:
    nations = _nations(spark, sf_dir)
    columns = ["id", "type", "label", "parent", "text definition", "comments", "ignore"]
    regions = [[f"REGION:{k}", "Class", name, "", "", "", ""] for k, name in sorted({(r["r_regionkey"], r["r_name"]) for r in nations})]
    rows = [[f"NATION:{r['n_nationkey']}", "Class", r["n_name"], f"'{r['r_name']}'", f"A nation of {{{r['r_name']}}}.", f'{r["n_name"]};"of; {r["r_name"]}"', "yes" if r["n_nationkey"] % 5 == 0 else ""] for r in nations]
    return tables.Table("nations.csv", "table", columns, list(enumerate(rows + regions, 2))).need("ID", "Type")


def _built(spark, sf_dir) -> Ontology:
    """The ontology that a term table of nations and regions describes."""
    out = Ontology(spark)
    out.set_id("http://x.org/nations.owl")
    builder = Builder(out)
    for row in _table(spark, sf_dir):
        if not ignored(row):
            builder.add(row)
    builder.finish()
    return out


BUILT = f"""n AS (SELECT '{OBO_BASE}NATION_' || n_nationkey AS i, n_name, '{OBO_BASE}REGION_' || r_regionkey AS up, r_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0),
 b AS (SELECT 'Declaration' AS axiom_type, i AS a1, 'class' AS a2, CAST(NULL AS VARCHAR) AS a3 FROM n UNION SELECT 'Declaration', '{OBO_BASE}REGION_' || r_regionkey, 'class', NULL FROM region UNION SELECT 'AnnotationAssertion', i, '{LABEL}', n_name FROM n
 UNION SELECT 'AnnotationAssertion', '{OBO_BASE}REGION_' || r_regionkey, '{LABEL}', r_name FROM region UNION SELECT 'SubClassOf', i, up, NULL FROM n UNION SELECT 'AnnotationAssertion', i, '{OBO_BASE}IAO_0000115', 'A nation of ''' || r_name || ''' (REGION:' || r_regionkey || ').' FROM n
 UNION SELECT 'AnnotationAssertion', i, 'http://www.w3.org/2000/01/rdf-schema#comment', n_name FROM n UNION SELECT 'AnnotationAssertion', i, 'http://www.w3.org/2000/01/rdf-schema#comment', 'of; ' || r_name FROM n)"""


@query(f"WITH {BUILT} SELECT axiom_type, a1, a2, a3 FROM b")
def built_ontology(spark, sf_dir):
    """A term table compiled in two passes: entities are made, then described by labels of later rows."""
    return _built(spark, sf_dir).axioms().select("axiom_type", "a1", "a2", "a3")


@query(f"WITH {BUILT} SELECT form, axiom_type, a1, a2, a3 FROM b, (VALUES ('RDF/XML'), ('Turtle')) v(form)")
def ontology_round_trip(spark, sf_dir):
    """An ontology saved in a format and loaded again says the same."""
    built, out = _built(spark, sf_dir), None
    for form in ("RDF/XML", "Turtle"):
        again = Ontology(spark, built.text(form).encode()).axioms().select(F.lit(form).alias("form"), "axiom_type", "a1", "a2", "a3")
        out = again if out is None else out.unionByName(again)
    return out


@query("""WITH n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0), l AS (SELECT 'Entities:' AS line UNION ALL
 SELECT unnest(['    IRI: http://purl.obolibrary.org/obo/REGION_' || r_regionkey, '    OBO ID: REGION:' || r_regionkey, '    Label: ' || r_name]) FROM region UNION ALL SELECT '    Children:' FROM (SELECT DISTINCT r_regionkey FROM n) UNION ALL
 SELECT unnest(['        IRI: http://purl.obolibrary.org/obo/NATION_' || n_nationkey, '        OBO ID: NATION:' || n_nationkey, '        Label: ' || n_name]) FROM n) SELECT line FROM l""")
def documentation_text(spark, sf_dir):
    """The documentation of all regions with what is below them, line by line."""
    regions = sorted({r["r_regionkey"] for r in _nations(spark, sf_dir)})
    spec = "".join(f"- ID: REGION:{k}\n  descendants: all\n" for k in regions)
    shown = documents.document(_built(spark, sf_dir), spec, "text")
    return spark.createDataFrame([(x,) for x in shown.splitlines() if x.strip()], "line string")


@query("""SELECT n_nationkey, 'and' AS op, '' AS prop, '' AS filler FROM nation UNION ALL SELECT n_nationkey, 'some', 'near', 'N' || n_regionkey FROM nation UNION ALL SELECT n_nationkey, 'min', 'has', 'city' FROM nation UNION ALL SELECT n_nationkey, 'not', '', 'N' || n_nationkey FROM nation""")
def manchester_expressions(spark, sf_dir):
    """Class expressions in Manchester syntax, one for each nation, as rows of their parts."""
    rows = []
    for r in _nations(spark, sf_dir):
        _, parts = manchester.flatten(manchester.parse_class(f"place and (near some N{r['n_regionkey']}) and has min 2 city and not N{r['n_nationkey']}"))
        rows += [(r["n_nationkey"], p["op"], p["prop"] or "", p["filler"] or "") for p in parts]
    return spark.createDataFrame(rows, "n_nationkey int, op string, prop string, filler string")


def _joined(axioms: DataFrame, expressions: DataFrame) -> DataFrame:
    """Axioms with the parts of the restriction that they end in."""
    parts = expressions.select(F.col("expr_id").alias("a2"), "prop", "filler")
    return axioms.join(parts, "a2", "left").select("axiom_type", "a1", F.when(F.startswith("a2", F.lit("_:")), F.lit("")).otherwise(F.col("a2")).alias("a2"), F.coalesce("a3", F.lit("")).alias("a3"), F.coalesce("prop", F.lit("")).alias("prop"), F.coalesce("filler", F.lit("")).alias("filler"))


@query(f"""WITH s AS (SELECT '{OBO_BASE}SUP_' || s_suppkey AS i, * FROM supplier)
SELECT 'Declaration' AS axiom_type, i AS a1, 'class' AS a2, '' AS a3, '' AS prop, '' AS filler FROM s UNION ALL SELECT 'AnnotationAssertion', i, '{LABEL}', s_name || ' "x" ! y', '', '' FROM s
UNION ALL SELECT 'SubClassOf', i, '{OBO_BASE}NAT_' || s_nationkey, '', '', '' FROM s UNION ALL SELECT 'SubClassOf', i, '', '', '{OBO_BASE}unnamed#within', '{OBO_BASE}NAT_' || s_nationkey FROM s WHERE s_suppkey % 2 = 0""")
def obo_scan(spark, sf_dir):
    """Stanzas of OBO documents, with escapes, comments and qualifiers."""
    s, at = Tables(spark, sf_dir).supplier, _shared(spark)
    nation = F.concat(F.lit("NAT:"), F.col("s_nationkey").cast("string"))
    lines = F.array(F.lit("[Term]"), F.concat(F.lit("id: SUP:"), F.col("s_suppkey").cast("string")), F.concat(F.lit("name: "), "s_name", F.lit(' "x" \\! y ! a remark')), F.concat(F.lit("is_a: "), nation, F.lit(' {source="a ! b"} ! a nation')), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("relationship: within "), nation)).otherwise(F.lit("! nothing")), F.lit(""))
    s.repartition(4).select(F.array_join(lines, "\n").alias("value")).write.text(at)
    return _joined(*stanzas.read_obo(spark, at))


@query("""SELECT 'SubClassOf' AS axiom_type, 'http://x/s' || s_suppkey AS a1, '' AS a2, '' AS a3, 'http://x/in' AS prop, 'http://x/n' || s_nationkey AS filler FROM supplier
UNION ALL SELECT 'ClassAssertion', 'http://x/n' || n_nationkey, 'http://x/Nation', '', '', '' FROM nation UNION ALL SELECT 'AnnotationAssertion', 'http://x/s' || s_suppkey, 'http://www.w3.org/2000/01/rdf-schema#label', s_name || ' ("x")', '', '' FROM supplier""")
def functional_scan(spark, sf_dir):
    """Lines of functional syntax, with brackets and quotes in literals."""
    t, at = Tables(spark, sf_dir), _shared(spark)
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    lines = t.supplier.select(F.explode(F.array(F.concat(F.lit("SubClassOf(<http://x/s"), key, F.lit("> ObjectSomeValuesFrom(<http://x/in> <http://x/n"), nation, F.lit(">))")), F.concat(F.lit("  AnnotationAssertion(rdfs:label <http://x/s"), key, F.lit('> "'), "s_name", F.lit(' (\\"x\\")")')))).alias("value"))
    lines = lines.union(t.nation.select(F.concat(F.lit("ClassAssertion(<http://x/Nation> <http://x/n"), F.col("n_nationkey").cast("string"), F.lit(">)"))))
    lines.repartition(4).write.text(at)
    return _joined(*stanzas.read_functional(spark, at))
