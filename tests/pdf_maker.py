"""Writes small PDFs: pages of text lines, rectangles and an image, with what readers have to cope with."""

import zlib


def stream(data: bytes, extra: bytes = b"", packed: bool = True) -> bytes:
    body = zlib.compress(data) if packed else data
    return b"<< /Length %d %s%s>>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if packed else b"", extra, body)


def text(x: float, y: float, *lines: str, size: float = 10) -> bytes:
    """Lines from (x, y) on, y from the top of a page 800 high."""
    shown = [b"(%s) Tj T*" % line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252") for line in lines]
    return b"BT /F1 %g Tf %g TL %g %g Td %s ET\n" % (size, size * 1.2, x, 800 - y, b"\n".join(shown))


def box(x0: float, y0: float, x1: float, y1: float) -> bytes:
    return b"%g %g %g %g re f\n" % (x0, 800 - y1, x1 - x0, y1 - y0)


def image(x0: float, y0: float, x1: float, y1: float) -> bytes:
    return b"q %g 0 0 %g %g %g cm /Im1 Do Q\n" % (x1 - x0, y1 - y0, x0, 800 - y1)


def pdf(*pages: bytes, packed: bool = True, encrypted: bool = False) -> bytes:
    """A page for each content stream; None is a page whose stream is broken."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> /XObject << /Im1 4 0 R >> >> >>" % (b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages))), len(pages)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", stream(b"\0\0\0", b"/Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceRGB /BitsPerComponent 8 ")]
    for k, content in enumerate(pages):
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (6 + 2 * k))
        objects.append(b"<< /Length 4 /Filter /FlateDecode >>\nstream\nabcd\nendstream" if content is None else stream(content, packed=packed))
    body = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1))
    return body + b"trailer << /Root 1 0 R %s>>\nstartxref\n0\n%%%%EOF\n" % (b"/Encrypt 99 0 R " if encrypted else b"")
