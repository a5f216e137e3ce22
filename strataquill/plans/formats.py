"""Files of other formats, made from the test tables and read back."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from strataquill.plans.registry import Registry
from strataquill.session import table
from strataquill.sources import files, packages, readers

R = Registry()
t = table


def q(name, sql=None, **types):
    return R.query(name, sql, **types)


def packed(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def xlsx(sheets: dict[str, list[list[str]]], merged: str = "") -> bytes:
    """A workbook of inline strings."""
    rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets)))
    members = {
        "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets>' + "".join(f'<sheet name="{escape(n)}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f"<Relationships>{rels}</Relationships>",
    }
    for i, rows in enumerate(sheets.values()):
        cells = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows))
        members[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet><sheetData>{cells}</sheetData>" + (f'<mergeCells><mergeCell ref="{merged}"/></mergeCells>' if merged and not i else "") + "</worksheet>"
    return packed(**members)


def pdf(pages: list[list[tuple[int, int, str]]]) -> bytes:
    """Lines ``(size, y, text)`` of each page, one font, Flate streams."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    kids = []
    for lines in pages:
        drawn = "".join(f"BT /F1 {size} Tf 50 {y} Td ({text.translate({40: '\\(', 41: '\\)', 92: '\\\\'})}) Tj ET\n" for size, y, text in lines)
        data, n = zlib.compress(drawn.encode("cp1252", "replace")), 4 + 2 * len(kids)
        objects[n] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data)
        objects[n + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % n
        kids.append(n + 1)
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in sorted(objects.items())) + b"trailer << /Root 1 0 R >>\n%%EOF\n"


@q("src08", "SELECT n_regionkey AS r_regionkey, 'nations' AS sheet, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS row, n_name AS text FROM nation UNION ALL SELECT r_regionkey, 'region', 0, r_name FROM region UNION ALL SELECT r_regionkey, 'nations', 0, 'name' FROM region")
def src08(s, d):
    """A workbook of two sheets for each region, read back by sheet."""

    @F.pandas_udf("binary")
    def book(region: pd.Series, nations: pd.Series) -> pd.Series:
        return pd.Series([xlsx({"region": [[r]], "nations": [["name"], *([x] for x in n)]}) for r, n in zip(region, nations, strict=True)])

    names = t(s, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("nations"))
    books = t(s, d, "region").join(names, "r_regionkey").select("r_regionkey", book("r_name", "nations").alias("file"))
    return packages.as_cells(books, "r_regionkey", "file").select("r_regionkey", "sheet", "row", "text")


def supplier_pdf(names: pd.Series, nations: pd.Series) -> pd.Series:
    return pd.Series([pdf([[(20, 700, n), (10, 660, f"nation {k}"), (10, 648, "second line"), (10, 600, "apart (a)")], [(10, 700, "last page")]]) for n, k in zip(names, nations, strict=True)])


def supplier_pdfs(s, d):
    return t(s, d, "supplier").select("s_suppkey", F.lit("pdf").alias("kind"), F.pandas_udf(supplier_pdf, "binary")("s_name", "s_nationkey").alias("file"))


@q("src10", "SELECT kind, n * (SELECT count(*) FROM supplier) AS n FROM (VALUES ('page', 2), ('heading', 1), ('paragraph', 3)) AS v(kind, n)", n="BIGINT")
def src10(s, d):
    """Typed elements of PDF files, counted by type."""
    return readers.converted(supplier_pdfs(s, d), "s_suppkey", "kind", "file").groupBy("kind").agg(F.count("*").alias("n"))


FORMAT_ROWS = ", ".join(f"('{e}', '{f}')" for e, f in files.FORMATS.items())


@q("src17", f"WITH f AS (SELECT * FROM (VALUES {FORMAT_ROWS}) AS v(extension, format)), m AS (SELECT DISTINCT id, lower(regexp_extract(local_path, '\\.([A-Za-z0-9]+)$', 1)) AS extension FROM manifest) SELECT format, count(id) AS documents FROM f LEFT JOIN m USING (extension) GROUP BY 1")
def src17(s, d):
    """The declared formats and how many manifest rows have each."""
    declared = s.createDataFrame(list(files.FORMATS.items()), "extension string, format string")
    found = t(s, d, "manifest").select("id", F.lower(F.regexp_extract("local_path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension")).distinct()
    return declared.join(found, "extension", "left").groupBy("format").agg(F.count("id").alias("documents"))


def epub(names: pd.Series) -> pd.Series:
    def one(name: str) -> bytes:
        return packed(**{
            "META-INF/container.xml": '<container><rootfiles><rootfile full-path="book/content.opf"/></rootfiles></container>',
            "book/content.opf": '<package><metadata><title>Book</title></metadata><manifest><item id="b" href="two.xhtml"/><item id="a" href="one.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
            "book/one.xhtml": f"<html><body><h1>{escape(name)}</h1></body></html>",
            "book/two.xhtml": "<html><body><p>end</p></body></html>",
        })

    return pd.Series([one(n) for n in names])


OTHER_TEXTS = {
    "webvtt": ("WEBVTT\n\n1\n00:01:01.500 --> 00:01:02.000\n<v Ann>@ done</v>\n", [("cue", 61_500, "@ done")]),
    "asciidoc": ("= @\n\ntext of\n@\n\n* one\n** two\n", [("heading", 1, "@"), ("paragraph", 0, "text of @"), ("list_item", 1, "one"), ("list_item", 2, "two")]),
    "email": ("Subject: @\n\nfirst\n\nsecond\n", [("heading", 1, "@"), ("paragraph", 0, "first"), ("paragraph", 0, "second")]),
    "latex": ("\\begin{document}\n\\section{@}\ntext \\emph{of} it\n\\begin{itemize}\\item one\\end{itemize}\n\\[ a^2 \\]\n\\end{document}", [("heading", 1, "@"), ("paragraph", 0, "text of it"), ("list_item", 1, "one"), ("formula", 0, "a^2")]),
    "boxnote": ('{"doc":{"type":"doc","content":[{"type":"heading","attrs":{"level":2},"content":[{"type":"text","text":"@"}]},{"type":"bullet_list","content":[{"type":"list_item","content":[{"type":"paragraph","content":[{"type":"text","text":"one"}]}]}]}]}}', [("heading", 2, "@"), ("list_item", 1, "one")]),
}
DOMAIN_XML = {
    "jats": ("<article><front><article-meta><title-group><article-title>@</article-title></title-group></article-meta></front><body><sec><title>Place</title><p>In it<list><list-item><p>one</p></list-item></list></p><table-wrap><table><tr><td>a</td><td>b</td></tr></table></table-wrap></sec></body></article>", [("heading", 1, "@"), ("heading", 2, "Place"), ("paragraph", 0, "In it"), ("list_item", 1, "one"), ("table_row", 0, "a | b")]),
    "uspto": ("<us-patent-grant><us-bibliographic-data-grant><invention-title>@</invention-title></us-bibliographic-data-grant><abstract><p>short</p></abstract><description><heading level=\"1\">Field</heading><p>long</p></description><claims><claim><claim-text>1. A @.</claim-text></claim></claims></us-patent-grant>", [("heading", 1, "@"), ("abstract", 0, "short"), ("heading", 2, "Field"), ("paragraph", 0, "long"), ("claim", 0, "1. A @.")]),
    "xbrl": ("<xbrl xmlns:a=\"urn:a\"><context id=\"c\"><period><instant>2024-01-01</instant></period></context><unit id=\"u\"><measure>iso4217:EUR</measure></unit><a:Name contextRef=\"c\">@</a:Name><a:Assets contextRef=\"c\" unitRef=\"u\">5</a:Assets></xbrl>", [("fact", 0, "Name = @ (2024-01-01)"), ("fact", 0, "Assets = 5 EUR (2024-01-01)")]),
    "doclang": ("<doclang><title>@</title><heading level=\"1\">Part</heading><list><list_item>one</list_item></list><otsl><ched/>x<ched/>y<nl/><fcel/>1<fcel/>2<nl/></otsl></doclang>", [("heading", 1, "@"), ("heading", 2, "Part"), ("list_item", 1, "one"), ("table_row", 0, "x | y"), ("table_row", 1, "1 | 2")]),
}


def made(s, d, texts):
    """A file of each format for every supplier, its name in place of the mark."""
    rows = t(s, d, "supplier").select("s_suppkey", "s_name", F.explode(F.create_map(*(F.lit(x) for k, v in texts.items() for x in (k, v[0])))).alias("kind", "form"))
    return rows.select("s_suppkey", "kind", F.encode(F.replace("form", F.lit("@"), "s_name"), "UTF-8").alias("file"))


def made_sql(texts, extra=""):
    rows = ", ".join(f"('{f}', {i}, '{k}', {level}, '{text}')" for f, (_, blocks) in texts.items() for i, (k, level, text) in enumerate(blocks))
    return f"SELECT s_suppkey, format, block_no, kind, level, replace(text, '@', s_name) AS text FROM supplier, (VALUES {rows}{extra}) AS v(format, block_no, kind, level, text)"


@q("src23", made_sql(OTHER_TEXTS, ", ('epub', 0, 'title', 1, 'Book'), ('epub', 1, 'heading', 1, '@'), ('epub', 2, 'paragraph', 0, 'end')"))
def src23(s, d):
    """WebVTT, AsciiDoc, e-mail, LaTeX, Box Notes and EPUB."""
    books = t(s, d, "supplier").select("s_suppkey", F.lit("epub").alias("kind"), F.pandas_udf(epub, "binary")("s_name").alias("file"))
    return readers.converted(made(s, d, OTHER_TEXTS).unionByName(books), "s_suppkey", "kind", "file")


@q("src25", made_sql(DOMAIN_XML))
def src25(s, d):
    """JATS, patents, XBRL and DocLang."""
    return readers.converted(made(s, d, DOMAIN_XML), "s_suppkey", "kind", "file")


def docx(names: pd.Series, nations: pd.Series) -> pd.Series:
    def one(name: str, nation: int) -> bytes:
        p = lambda text, style="": f"<w:p>{style}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"
        head = p(name, '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>')
        item = p("inner", '<w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr>')
        grid = f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("wide")}</w:tc></w:tr><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl>'
        return packed(**{"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{head}{p(f"nation {nation}")}{item}{grid}</w:body></w:document>'})

    return pd.Series([one(*x) for x in zip(names, nations, strict=True)])


@q("src24", "SELECT s_suppkey, block_no, kind, level, replace(replace(text, '#', s_nationkey::VARCHAR), '@', s_name) AS text FROM supplier, (VALUES (0, 'heading', 1, '@'), (1, 'paragraph', 0, 'nation #'), (2, 'list_item', 2, 'inner'), (3, 'table_row', 0, 'wide | '), (4, 'table_row', 1, 'a | b')) AS v(block_no, kind, level, text)")
def src24(s, d):
    """A DOCX file for each supplier, with a list and a table."""
    rows = t(s, d, "supplier").select("s_suppkey", F.lit("docx").alias("kind"), F.pandas_udf(docx, "binary")("s_name", "s_nationkey").alias("file"))
    return readers.converted(rows, "s_suppkey", "kind", "file").drop("format")


@q("src27", "SELECT s_suppkey, page, count(*) AS lines FROM supplier, (VALUES (1), (1), (1), (1), (2)) AS v(page) GROUP BY 1, 2")
def src27(s, d):
    """Pages of the PDF page provider with their text lines."""

    @F.pandas_udf("array<int>")
    def pages(content: pd.Series) -> pd.Series:
        return content.map(lambda c: [p for p, *_ in packages.pdf_lines(c)])

    rows = supplier_pdfs(s, d).select("s_suppkey", F.explode(pages("file")).alias("page"))
    return rows.groupBy("s_suppkey", "page").agg(F.count("*").alias("lines"))
