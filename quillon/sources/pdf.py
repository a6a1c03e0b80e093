"""A small PDF reader: pages with their text blocks, drawings and images, in points from the top left.

It reads objects wherever they stand in the file, also in object streams, follows the page tree, and interprets content
streams: text (simple fonts, ToUnicode maps), paths, images and forms. Streams may be plain or Flate-compressed.
Encrypted files are refused. Glyph widths come from the font, else half an em is taken; so boxes are close, not exact."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field


class PdfError(ValueError):
    pass


class Name(str):
    pass


@dataclass
class Ref:
    number: int


@dataclass
class Stream:
    info: dict
    data: bytes


@dataclass
class Page:
    page_number: int
    width: float = 0.0
    height: float = 0.0
    error: str | None = None
    blocks: list = field(default_factory=list)
    primitives: list = field(default_factory=list)


WHITE, DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*")
_REFERENCE = re.compile(rb"(\d+)\s+(\d+)\s+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_ESCAPES = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}


class Parser:
    """Reads objects and operators from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> bool:
        self.at = _SKIP.match(self.data, self.at).end()
        return self.at < len(self.data)

    def string(self) -> bytes:
        out, depth, data = bytearray(), 1, self.data
        self.at += 1
        while self.at < len(data):
            c = data[self.at]
            self.at += 1
            if c == 92 and self.at < len(data):
                octal = re.compile(rb"[0-7]{1,3}").match(data, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                    continue
                c = data[self.at]
                self.at += 1
                if c == 13 and data[self.at : self.at + 1] == b"\n":
                    self.at += 1
                if c not in (10, 13):
                    out.append(_ESCAPES.get(c, c))
                continue
            depth += (c == 40) - (c == 41)
            if not depth:
                break
            out.append(c)
        return bytes(out)

    def value(self):
        """The next object; a bare word, as an operator, is bytes in a tuple of one. StopIteration at the end."""
        if not self.skip():
            raise StopIteration
        data, at = self.data, self.at
        c = data[at : at + 1]
        if c == b"(":
            return self.string()
        if data[at : at + 2] == b"<<":
            self.at += 2
            out = {}
            while self.skip() and data[self.at : self.at + 2] != b">>":
                key = self.value()
                out[str(key)] = self.value()
            self.at += 2
            return out
        if c == b"<":
            end = data.find(b">", at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while self.skip() and data[self.at : self.at + 1] != b"]":
                out.append(self.value())
            self.at += 1
            return out
        if c == b"/":
            found = _REGULAR.match(data, at + 1)
            self.at = found.end() if found else at + 1
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), found[0] if found else b"")
            return Name(raw.decode("latin-1"))
        reference = _REFERENCE.match(data, at)
        if reference:
            self.at = reference.end()
            return Ref(int(reference[1]))
        found = _REGULAR.match(data, at)
        if not found:  # a stray delimiter
            self.at += 1
            return (c,)
        self.at = found.end()
        word = found[0]
        if _NUMBER.match(word):
            return float(word) if b"." in word else int(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, (word,))


class Document:
    def __init__(self, data: bytes):
        if data[:5] != b"%PDF-":
            raise PdfError("not a PDF")
        self.objects: dict[int, object] = {}
        trailers = []
        for found in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b|\btrailer\b", data):
            parser = Parser(data, found.end())
            try:
                value = parser.value()
            except (StopIteration, ValueError, IndexError):
                continue
            if not found[1]:
                trailers.append(value)
                continue
            if isinstance(value, dict) and parser.skip() and data.startswith(b"stream", parser.at):
                begin = parser.at + 6
                begin += 2 if data[begin : begin + 2] == b"\r\n" else 1
                size = value.get("Length")
                size = size if isinstance(size, int) and data[begin + size : begin + size + 12].lstrip().startswith(b"endstream") else None
                end = begin + size if size is not None else data.find(b"endstream", begin)
                value = Stream(value, data[begin : end if end >= 0 else len(data)])
            self.objects[int(found[1])] = value
        heads = [t for t in trailers if isinstance(t, dict)] + [o.info for o in self.objects.values() if isinstance(o, Stream) and o.info.get("Type") == "XRef"]
        if any("Encrypt" in t for t in heads):
            raise PdfError("the PDF is password protected")
        for packed in [o for o in self.objects.values() if isinstance(o, Stream) and o.info.get("Type") == "ObjStm"]:
            body = self.decoded(packed)
            head = Parser(body)
            index = [(head.value(), head.value()) for _ in range(self.get(packed.info["N"]))]
            for number, offset in index:
                self.objects.setdefault(number, Parser(body, self.get(packed.info["First"]) + offset).value())
        roots = [self.get(t["Root"]) for t in reversed(heads) if "Root" in t]
        roots += [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"]
        self.root = next((r for r in roots if isinstance(r, dict) and "Pages" in r), None)
        if self.root is None:
            raise PdfError("the PDF has no pages")

    def get(self, value):
        for _ in range(50):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def decoded(self, stream: Stream) -> bytes:
        filters = self.get(stream.info.get("Filter")) or []
        data = stream.data
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) not in ("FlateDecode", "Fl"):
                raise PdfError(f"streams of {self.get(f)} aren't read")
            engine = zlib.decompressobj()
            data = engine.decompress(data)
        hint = self.get(stream.info.get("DecodeParms"))
        if isinstance(hint, dict) and (self.get(hint.get("Predictor")) or 1) > 1:
            raise PdfError("predicted streams aren't read")
        return data

    def leaves(self, node=None, inherited: dict | None = None, seen: frozenset = frozenset()):
        """Page dictionaries in order, with what they inherit."""
        node = self.get(self.root["Pages"]) if node is None else node
        if not isinstance(node, dict) or id(node) in seen:
            return
        here = {**(inherited or {}), **{k: node[k] for k in ("MediaBox", "Resources") if k in node}}
        if "Kids" in node:
            for kid in self.get(node["Kids"]) or []:
                yield from self.leaves(self.get(kid), here, seen | {id(node)})
        else:
            yield {**here, **node}


class Font:
    """Decodes the strings of a font, with the width of each character in thousandths of an em."""

    def __init__(self, doc: Document, info: dict):
        self.two = info.get("Subtype") == "Type0"
        self.first = doc.get(info.get("FirstChar")) or 0
        self.widths = [doc.get(w) for w in doc.get(info.get("Widths")) or []]
        self.map: dict[int, str] = {}
        mapped = doc.get(info.get("ToUnicode"))
        if isinstance(mapped, Stream):
            self._read(doc.decoded(mapped))

    def _read(self, cmap: bytes) -> None:
        text = lambda b: b.decode("utf-16-be", "replace")
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                self.map[int(a, 16)] = text(bytes.fromhex(b.decode()))
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                low = text(bytes.fromhex(c.decode()))
                for k in range(min(int(b, 16) - int(a, 16) + 1, 1 << 16)):
                    self.map[int(a, 16) + k] = low[:-1] + chr(ord(low[-1]) + k)

    def read(self, raw: bytes) -> tuple[str, float]:
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if self.two else list(raw)
        out, width = [], 0.0
        for c in codes:
            out.append(self.map.get(c) or ("" if self.two else bytes([c]).decode("cp1252", "replace")))
            known = self.widths[c - self.first] if 0 <= c - self.first < len(self.widths) else None
            width += known if isinstance(known, (int, float)) else 500
        return "".join(out), width / 1000


Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1, 0, 0, 1, 0, 0)


def times(m: Matrix, n: Matrix) -> Matrix:
    (a, b, c, d, e, f), (g, h, i, j, k, o) = m, n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o)


def corners(m: Matrix, x: float, y: float, w: float, h: float) -> tuple[float, float, float, float]:
    points = [(m[0] * p + m[2] * q + m[4], m[1] * p + m[3] * q + m[5]) for p in (x, x + w) for q in (y, y + h)]
    return min(p for p, _ in points), min(q for _, q in points), max(p for p, _ in points), max(q for _, q in points)


class Content:
    """Interprets content streams; collects spans of text (box, size, text), drawings and images in PDF coordinates."""

    def __init__(self, doc: Document):
        self.doc, self.spans, self.drawings, self.images, self.fonts = doc, [], [], [], {}

    def run(self, data: bytes, resources: dict, ctm: Matrix, depth: int = 0) -> None:
        doc, stack, saved = self.doc, [], []
        parser, font, size, lead, text, line = Parser(data), None, 1.0, 0.0, UNIT, UNIT
        path: list[tuple[float, float, float, float]] = []
        fonts, forms = (doc.get(resources.get(k)) or {} for k in ("Font", "XObject"))

        def show(raw: bytes) -> None:
            nonlocal text
            words, width = font.read(raw) if font else (raw.decode("cp1252", "replace"), len(raw) * 0.5)
            at = times(text, ctm)
            if words.strip():
                self.spans.append((corners(at, 0, -0.2 * size, width * size, size), abs(size * (at[3] or at[1])), words))
            text = times((1, 0, 0, 1, width * size, 0), text)

        def drop(x: float, y: float) -> None:
            nonlocal text, line
            line = times((1, 0, 0, 1, x, y), line)
            text = line

        while True:
            try:
                value = parser.value()
            except StopIteration:
                return
            if not isinstance(value, tuple):
                stack.append(value)
                continue
            op, args = value[0], stack
            stack = []
            try:
                if op == b"q":
                    saved.append((ctm, font, size, lead))
                elif op == b"Q" and saved:
                    ctm, font, size, lead = saved.pop()
                elif op == b"cm":
                    ctm = times(tuple(args[-6:]), ctm)
                elif op == b"BT":
                    text = line = UNIT
                elif op == b"Tf":
                    name, size = args[-2], args[-1]
                    info = doc.get(fonts.get(name))
                    if name not in self.fonts or self.fonts[name][0] is not info:
                        self.fonts[name] = info, Font(doc, info) if isinstance(info, dict) else None
                    font = self.fonts[name][1]
                elif op == b"TL":
                    lead = args[-1]
                elif op in (b"Td", b"TD"):
                    lead = -args[-1] if op == b"TD" else lead
                    drop(args[-2], args[-1])
                elif op == b"Tm":
                    text = line = tuple(args[-6:])
                elif op == b"T*":
                    drop(0, -lead)
                elif op in (b"Tj", b"'", b'"'):
                    if op != b"Tj":
                        drop(0, -lead)
                    show(args[-1])
                elif op == b"TJ":
                    for x in args[-1]:
                        if isinstance(x, bytes):
                            show(x)
                        else:
                            text = times((1, 0, 0, 1, -x / 1000 * size, 0), text)
                elif op == b"re":
                    path.append(corners(ctm, *args[-4:]))
                elif op in (b"m", b"l", b"c", b"v", b"y"):
                    path += [corners(ctm, args[k], args[k + 1], 0, 0) for k in range(0, len(args) - 1, 2)]
                elif op in (b"f", b"F", b"f*", b"S", b"s", b"B", b"B*", b"b", b"b*"):
                    if path:
                        self.drawings.append((min(p[0] for p in path), min(p[1] for p in path), max(p[2] for p in path), max(p[3] for p in path)))
                    path = []
                elif op == b"n":
                    path = []
                elif op == b"BI":
                    parser.at = max(parser.at, data.find(b"EI", parser.at) + 2)
                    self.images.append(corners(ctm, 0, 0, 1, 1))
                elif op == b"Do":
                    form = doc.get(forms.get(args[-1]))
                    if isinstance(form, Stream) and form.info.get("Subtype") == "Image":
                        self.images.append(corners(ctm, 0, 0, 1, 1))
                    elif isinstance(form, Stream) and depth < 20:
                        own = doc.get(form.info.get("Matrix")) or UNIT
                        self.run(doc.decoded(form), doc.get(form.info.get("Resources")) or resources, times(tuple(own), ctm), depth + 1)
            except (IndexError, TypeError):
                continue  # an operator without its operands does nothing


def lines_of(spans: list) -> list[list]:
    """[box, size, text] of lines: spans on one baseline that stand close together."""
    out: list[list] = []
    for box, size, text in spans:
        last = out[-1] if out else None
        gap = box[0] - last[0][2] if last else 0
        if last and abs(box[1] - last[0][1]) < 0.5 * size and -0.5 * size < gap < 1.5 * size:
            space = " " if gap > 0.15 * size and not last[2].endswith(" ") and not text.startswith(" ") else ""
            last[0] = (min(last[0][0], box[0]), min(last[0][1], box[1]), max(last[0][2], box[2]), max(last[0][3], box[3]))
            last[2] += space + text
        else:
            out.append([box, size, text])
    return out


def blocks_of(lines: list[list]) -> list[tuple]:
    """(box, text) of blocks: lines that follow each other closely, one under the other."""
    out: list[list] = []
    for box, size, text in lines:
        last = out[-1] if out else None
        if last and -0.5 * size <= last[0][1] - box[3] <= 0.6 * size and box[0] < last[0][2] and last[0][0] < box[2] and abs(size - last[1]) < 0.2 * size:
            last[0] = (min(last[0][0], box[0]), min(last[0][1], box[1]), max(last[0][2], box[2]), max(last[0][3], box[3]))
            last[2] += "\n" + text
        else:
            out.append([box, size, text])
    return [(b, t) for b, _, t in out]


def read(data: bytes) -> list[Page]:
    """The pages of a PDF; a page that can't be read has an error and the others stay. PdfError if none can be."""
    doc = Document(data)
    out = []
    for number, leaf in enumerate(doc.leaves(), 1):
        page = Page(number)
        out.append(page)
        try:
            x0, y0, x1, y1 = (float(doc.get(v)) for v in doc.get(leaf.get("MediaBox")) or (0, 0, 612, 792))
            page.width, page.height = abs(x1 - x0), abs(y1 - y0)
            left, top = min(x0, x1), max(y0, y1)
            parts = doc.get(leaf.get("Contents"))
            parts = [doc.get(p) for p in parts] if isinstance(parts, list) else [parts]
            content = Content(doc)
            content.run(b"\n".join(doc.decoded(p) for p in parts if isinstance(p, Stream)), doc.get(leaf.get("Resources")) or {}, UNIT)
            turned = lambda b: (b[0] - left, top - b[3], b[2] - left, top - b[1])  # noqa: E731, B023
            page.blocks = [(*turned(b), t) for b, t in blocks_of(lines_of(content.spans)) if t.strip()]
            page.primitives = [(*turned(b), True) for b in content.images] + [(*turned(b), False) for b in content.drawings]
        except (PdfError, zlib.error, ValueError, TypeError, AttributeError) as error:
            page.error = str(error) or type(error).__name__
    if not out:
        raise PdfError("the PDF has no pages")
    return out
