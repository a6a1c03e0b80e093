"""From PDF bytes to elements."""

import zlib

import pytest
from pdf_maker import box, image, pdf, stream, text

from quillon.operators import pages
from quillon.sources import extract
from quillon.sources import pdf as reader

CHART = image(60, 100, 260, 240) + text(60, 262, "Figure 1. Yield by year")
TABLE = text(320, 100, "Table 2. Rates of wear") + text(320, 120, "year rate") + text(320, 140, "2019 1.5") + text(320, 160, "2020 2.5")
LEFT = b"".join(text(50, 300 + 40 * k, f"Left column paragraph {k} speaks of alpha.") for k in range(4))
RIGHT = b"".join(text(330, 300 + 40 * k, f"Right column paragraph {k} speaks of beta.") for k in range(4))


def test_blocks_and_primitives():
    for packed in (True, False):
        (page,) = reader.read(pdf(text(50, 100, "First line (a)", "second \\ line") + text(50, 300, "apart") + box(10, 20, 110, 60) + image(200, 200, 300, 250), packed=packed))
        assert [b[4] for b in page.blocks] == ["First line (a)\nsecond \\ line", "apart"] and (page.width, page.height) == (600, 800)
        x0, y0, x1, y1, _ = page.blocks[0]
        assert x0 == 50 and 85 < y0 < 95 and x1 > 100 and 110 < y1 < 120
        assert page.primitives == [(200, 200, 300, 250, True), (10, 20, 110, 60, False)]


def test_what_cannot_be_read():
    for data in (b"PK", b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog", b"%PDF-1.4\n(((((", pdf(b"", encrypted=True)):
        with pytest.raises(reader.PdfError):
            reader.read(data)
    good, broken = reader.read(pdf(text(50, 50, "fine"), None))
    assert good.error is None and good.blocks[0][4] == "fine" and broken.error and broken.page_number == 2
    noise = bytes(k * 37 % 256 for k in range(3000))
    try:
        reader.read(b"%PDF-1.7\n" + noise)
    except reader.PdfError:
        pass


def test_object_streams_forms_and_maps():
    """Objects packed into a stream, text in a form, two-byte codes with a ToUnicode map, arrays and hex strings."""
    held = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /MediaBox [0 0 200 100] /Contents [7 0 R 8 0 R] /Resources << /Font << /F1 5 0 R >> /XObject << /Fm 6 0 R >> >> >>", b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>"]
    at, index = 0, []
    for number, o in zip((1, 2, 3, 5), held, strict=True):
        index.append(b"%d %d" % (number, at))
        at += len(o) + 1
    head = b" ".join(index) + b" "
    packed = stream(head + b"\n".join(held), b"/Type /ObjStm /N 4 /First %d " % len(head))
    form = stream(b"BT /F1 10 Tf 1 0 0 1 0 0 Tm [<0001> -2000 <0002>] TJ ET", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 20 50] ")
    cmap = stream(b"beginbfchar <0001> <0048> endbfchar beginbfrange <0002> <0005> <0069> endbfrange")
    objects = {4: packed, 6: form, 7: stream(b"/Fm Do "), 8: stream(b"0 0 m 50 0 l 50 20 l S BT /F1 10 Tf 10 10 Td <00020003> Tj ET"), 9: cmap, 10: stream(b"", b"/Type /XRef /Root 1 0 R ")}
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items())
    (page,) = reader.read(data)
    assert "".join(b[4] for b in page.blocks).replace(" ", "") == "Hiij"
    assert page.primitives == [(0, 80, 50, 100, False)] and page.width == 200


def parsed(spark, **contents):
    rows = [(k, bytearray(v)) for k, v in contents.items()]
    return extract.extracted(spark.createDataFrame(rows, "document_id string, content binary"), reader.read).persist()


def test_elements_of_pages(spark):
    """A captioned picture, a table that only its caption shows, two columns, a page that can't be read."""
    found = parsed(spark, d1=pdf(CHART + TABLE + LEFT + RIGHT, None, text(50, 100, "The last page says very little, but enough for a chunk.")), d2=pdf(b""), d3=b"nothing")
    assert {r.document_id: r.error for r in found.collect()} == {"d1": None, "d2": None, "d3": "not a PDF"}
    assert [r.document_id for r in extract.warnings_of(found).collect()] == ["d1"] and extract.warnings_of(found).first().warnings[0].startswith("page 2: ")
    rows = pages.elements(extract.pages_of(found).filter("error is null"), extract.blocks_of(found), extract.primitives_of(found), size=200, overlap=40).orderBy("element_id").collect()
    visual = [r for r in rows if r.kind != "text"]
    assert [(r.element_id, r.caption, r.crop) for r in visual] == [("d1:p1:figure:1", "Figure 1. Yield by year", "p0001_01_figure.png"), ("d1:p1:table:0", "Table 2. Rates of wear", "p0001_00_table.png")]
    table = next(r for r in visual if r.kind == "table")
    assert table.text.splitlines() == ["Table 2. Rates of wear", "year rate", "2019 1.5", "2020 2.5"]
    body = "\n".join(r.text for r in rows if r.kind == "text")
    assert "Table 2" not in body and "Figure 1" not in body and "2019" not in body
    assert body.index("Left column paragraph 3") < body.index("Right column paragraph 0")
    assert [r.page_number for r in rows if "last page" in r.text] == [3] and all(len(r.text) <= 200 for r in rows)


def test_whole_elements(spark):
    backend = extract.layout(lambda content: [{"category": "Table", "text": "t", "metadata": {"page_number": 1}}, {"category": "Title", "text": "head", "metadata": {"page_number": 1}}])
    df = spark.createDataFrame([("d", bytearray(b"x"))], "document_id string, content binary")
    rows = pages.whole(extract.whole_elements_of(extract.extracted(df, backend))).orderBy("element_id").collect()
    assert [(r.element_id, r.text) for r in rows] == [("d:table:0", "t"), ("d:text:1", "head")]


def test_streams_of_other_kinds_are_told():
    data = pdf(b"").replace(b"/FlateDecode", b"/LZWDecode", 2)
    assert reader.read(data)[0].error == "streams of LZWDecode aren't read"
    assert zlib.decompress(zlib.compress(b"x")) == b"x"
