import pytest

from strataquill.plans.formats import DOMAIN_XML, OTHER_TEXTS, packed, pdf, xlsx
from strataquill.sources import markup_readers as M
from strataquill.sources import packages as P
from strataquill.sources import readers


@pytest.mark.parametrize("name", [*OTHER_TEXTS, *DOMAIN_XML])
def test_texts(name):
    text, blocks = (OTHER_TEXTS | DOMAIN_XML)[name]
    assert readers.blocks_of(name, text.replace("@", "N").encode()) == [(k, n, x.replace("@", "N")) for k, n, x in blocks]


@pytest.mark.parametrize("name", [*readers.TEXT_READERS, *readers.BYTE_READERS])
def test_broken_files_give_no_error(name):
    for content in (None, b"", b"\xff\xfe\x00<", b"<a><b>", b"PK\x03\x04", b"%PDF-1.7 1 0 obj << /Type /Catalog", b"{\"doc\": 3}", b"\\begin{tabular}{"):
        assert isinstance(readers.blocks_of(name, content), list)
    assert readers.blocks_of(None, b"x") == [] and readers.blocks_of("image", b"x") == []


def test_latex():
    text = "\\documentclass{book}\\title{The \\emph{T}}\n\\begin{document}\\maketitle\nIn % note\ntro 5\\% \\href{u}{lab}.\n\n\\chapter{One}\\label{s}\n\\begin{itemize}\\item a $x$ \\item b \\begin{enumerate}\\item c\\end{enumerate}\\end{itemize}\n\\begin{verbatim}\n\\emph{x}\n\\end{verbatim}\n\\section*{Two} tail \\[ a^2 \\] more\n\\begin{tabular}{lr} a & b \\\\ \\hline c \\& d & e \\\\ \\end{tabular}\n\\end{document}\nafter"
    assert M.latex_blocks(text) == [
        ("heading", 1, "The T"), ("paragraph", 0, "In tro 5% lab."), ("heading", 2, "One"), ("list_item", 1, "a $x$"), ("list_item", 1, "b"), ("list_item", 2, "c"), ("code", 0, "\\emph{x}"),
        ("heading", 3, "Two"), ("paragraph", 0, "tail"), ("formula", 0, "a^2"), ("paragraph", 0, "more"), ("table_row", 0, "a | b"), ("table_row", 1, "c & d | e"),
    ]


def test_patents_of_older_forms():
    tagged = "PATN\nWKU  123\nTTL  A pump\n      of steel\nABST\nPAL  It pumps.\nBSUM\nPAC  FIELD\nPAR  Text\n      more\nCLMS\nNUM  1.\nPAR  1. A pump.\n"
    assert M.patent_blocks(tagged) == [("heading", 1, "A pump of steel"), ("abstract", 0, "It pumps."), ("heading", 2, "FIELD"), ("paragraph", 0, "Text more"), ("claim", 0, "1. A pump.")]
    grant = "<!DOCTYPE PATDOC [<!ENTITY x 'y'>]><PATDOC><SDOBI><B500><B540><STEXT><PDAT>T</PDAT></STEXT></B540></B500></SDOBI><SDOAB><PARA><PTEXT><PDAT>A &x;</PDAT></PTEXT></PARA></SDOAB><SDODE><H LVL=\"2\"><STEXT><PDAT>H</PDAT></STEXT></H><PARA><PTEXT><PDAT>x</PDAT></PTEXT></PARA></SDODE><SDOCL><CL><CLM><PARA><PTEXT><PDAT>1. A</PDAT></PTEXT></PARA></CLM></CL></SDOCL></PATDOC>"
    assert M.patent_blocks(grant) == [("heading", 1, "T"), ("abstract", 0, "A"), ("heading", 3, "H"), ("paragraph", 0, "x"), ("claim", 0, "1. A")]
    application = "<patent-application-publication><subdoc-bibliographic-information><title-of-invention>T</title-of-invention></subdoc-bibliographic-information><subdoc-abstract><paragraph>A</paragraph></subdoc-abstract><subdoc-description><section><heading lvl=\"1\">H</heading><paragraph>x</paragraph></section></subdoc-description><subdoc-claims><claim><claim-text>1. A</claim-text></claim></subdoc-claims></patent-application-publication>"
    assert M.patent_blocks(application) == [("heading", 1, "T"), ("abstract", 0, "A"), ("heading", 2, "H"), ("paragraph", 0, "x"), ("claim", 0, "1. A")]


def test_workbooks():
    book = xlsx({"one": [["a", "", "b"], ["", "c & d"]], "two": [["x"]]}, "A1:B1")
    assert P.xlsx_cells(book) == [("one", 0, 0, 1, 2, "a"), ("one", 0, 2, 1, 1, "b"), ("one", 1, 1, 1, 1, "c & d"), ("two", 0, 0, 1, 1, "x")]
    assert P.package_blocks(book) == [("table_row", 0, "a | b"), ("table_row", 1, "c & d"), ("table_row", 0, "x")]
    assert P.place("AB12") == (11, 27) and P.xlsx_cells(b"x") == []


def test_slides_and_open_documents():
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>Head</a:t></a:r></a:p></p:sp><p:sp><a:p><a:pPr lvl="1"><a:buChar char="-"/></a:pPr><a:r><a:t>item</a:t></a:r></a:p><a:p><a:r><a:t>text</a:t></a:r></a:p></p:sp><p:graphicFrame><a:tbl><a:tr><a:tc gridSpan="2"><a:t>w</a:t></a:tc><a:tc hMerge="1"/></a:tr></a:tbl></p:graphicFrame></p:sld>'
    assert P.package_blocks(packed(**{"ppt/slides/slide10.xml": slide.replace("Head", "Last"), "ppt/slides/slide2.xml": slide})) == [
        *[("heading", 1, "Head"), ("list_item", 2, "item"), ("paragraph", 0, "text"), ("table_row", 0, "w | ")], *[("heading", 1, "Last"), ("list_item", 2, "item"), ("paragraph", 0, "text"), ("table_row", 0, "w | ")],
    ]
    odt = '<o:document-content xmlns:o="o" xmlns:t="t"><o:body><t:h t:outline-level="2">H</t:h><t:p>x <t:span>y</t:span></t:p><t:list><t:list-item><t:p>i</t:p><t:list><t:list-item><t:p>j</t:p></t:list-item></t:list></t:list-item></t:list><t:table><t:table-row><t:table-cell t:number-columns-spanned="2"><t:p>w</t:p></t:table-cell></t:table-row></t:table></o:body></o:document-content>'
    assert P.package_blocks(packed(**{"content.xml": odt})) == [("heading", 2, "H"), ("paragraph", 0, "x y"), ("list_item", 1, "i"), ("list_item", 2, "j"), ("table_row", 0, "w | ")]


def test_pdf_text():
    made = pdf([[(20, 700, "Title"), (10, 660, "One (a) \\ of"), (10, 648, "a para-"), (10, 636, "graph"), (10, 600, "next")], [], [(10, 700, "end")]])
    assert P.pdf_lines(made)[1] == (1, 50.0, 660.0, 10.0, "One (a) \\ of")
    assert P.pdf_blocks(made) == [("page", 1, "page 1"), ("heading", 1, "Title"), ("paragraph", 0, "One (a) \\ of a paragraph"), ("paragraph", 0, "next"), ("page", 3, "page 3"), ("paragraph", 0, "end")]
    table = b"1 beginbfchar <0003> <00E4> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange"
    font = b"%%PDF-1.7\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [4 0 R] >> endobj 3 0 obj << /Type /Font /ToUnicode 6 0 R >> endobj 4 0 obj << /Type /Page /Contents [5 0 R] /Resources << /Font << /F0 3 0 R >> >> >> endobj 5 0 obj << /Length 62 >>\nstream\nBT /F0 9 Tf 1 0 0 1 5 9 Tm [<0003> -300 <00100012>] TJ ET   \nendstream endobj 6 0 obj << /Length %d >>\nstream\n%s\nendstream endobj" % (len(table), table)
    assert P.pdf_lines(font) == [(1, 5.0, 9.0, 9.0, "ä AC")]
    assert P.pdf_lines(made.replace(b"trailer", b"/Encrypt trailer")) == []
