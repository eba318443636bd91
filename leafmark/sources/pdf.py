"""Reading and writing forms in PDF.

Files come through Spark's binaryFile source, so any store will do, and are parsed a
batch at a time: a file that cannot be read becomes a row with an error. The parser
scans for objects, so it needs no cross-reference table and reads damaged files too;
of several versions of an object the last one counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafmark.functions import pdftext
from leafmark.sources import codecs

# objects -----------------------------------------------------------------------------


class Name(str):
    __slots__ = ()


class Ref(int):
    __slots__ = ()


class Stream(dict):
    raw: bytes = b""


_SPACE = re.compile(rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+)*+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z])")
_OBJECT = re.compile(rb"(?<![0-9])(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj\b")
_PLAIN = re.compile(rb"\(([^()\\]*)\)")
_HEX = re.compile(r"#([0-9A-Fa-f]{2})")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_TRAILER = re.compile(rb"trailer|" + _OBJECT.pattern)
_WORDS = {b"true": True, b"false": False, b"null": None}
#: What most values are, after blanks: a name, a reference, a number or a word. Each is tried as ``Reader.value`` tries them.
_TOKEN = re.compile(_SPACE.pattern + rb"(?:/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(" + _REF.pattern.replace(b"(", b"(?:").replace(b"(?:?", b"(?") + rb")|(" + _NUMBER.pattern + rb")|([^\x00\t\n\x0c\r ()<>\[\]{}/%]+))")
_KEY = re.compile(_SPACE.pattern + rb"/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]*+)(?!#)")
_ROW = re.compile(rb"(\d{10}) (\d{5}) ([nf])[\r\n ]{1,2}")
_NUMBERS = (int, float)
_ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}


class Reader:
    """Values one after another from bytes; operators come as plain bytes."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def value(self) -> Any:
        d = self.data
        if m := _TOKEN.match(d, self.at):
            self.at = m.end()
            kind, found = m.lastindex, m[m.lastindex]
            if kind == 3:
                return float(found) if b"." in found else int(found)
            if kind == 4:
                return _WORDS.get(found, found)
            if kind == 2:
                return Ref(int(_REF.match(found)[1]))
            text = found.decode("latin-1")
            return Name(_HEX.sub(lambda x: chr(int(x[1], 16)), text) if "#" in text else text)
        self.at = _SPACE.match(d, self.at).end()
        if self.at >= len(d):
            raise EOFError
        c = d[self.at : self.at + 1]
        if d.startswith(b"<<", self.at):
            self.at += 2
            return self._dict()
        if c == b"(":
            return self._string()
        if c == b"<":
            end = d.find(b">", self.at)
            end = len(d) if end < 0 else end
            out = codecs.hex_decode(d[self.at + 1 : end])
            self.at = end + 1
            return ("text", out)
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.at = _SPACE.match(d, self.at).end()
                if self.at >= len(d):
                    return out
                if d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.value())
        self.at += 1
        return c

    def _dict(self) -> dict:
        out: dict = {}
        while True:
            if m := _KEY.match(self.data, self.at):
                self.at = m.end()
                out[m[1].decode("latin-1")] = self.value()
                continue
            self.at = _SPACE.match(self.data, self.at).end()
            if self.at >= len(self.data):
                return out
            if self.data.startswith(b">>", self.at):
                self.at += 2
                return out
            key = self.value()
            out[str(key) if isinstance(key, Name) else repr(key)] = self.value()

    def _string(self) -> tuple[str, bytes]:
        d, out, depth = self.data, bytearray(), 1
        if m := _PLAIN.match(d, self.at):
            self.at = m.end()
            return ("text", m[1])
        i = self.at + 1
        while i < len(d):
            c = d[i]
            if c == 0x5C:
                i += 1
                nxt = d[i] if i < len(d) else 0
                if nxt in _ESCAPES:
                    out += _ESCAPES[nxt]
                elif m := _OCTAL.match(d, i):
                    out.append(int(m[0], 8) & 255)
                    i = m.end() - 1
                elif nxt not in (10, 13):
                    out.append(nxt)
            elif c == 0x28:
                depth += 1
                out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
                out.append(c)
            else:
                out.append(c)
            i += 1
        self.at = i + 1
        return ("text", bytes(out))


def shown(v: Any) -> str | None:
    """The text of a string value, by its mark or in the document encoding."""
    if isinstance(v, tuple):
        return pdftext.decode(v[1])
    return None if v is None else str(v)


class Document:
    """The objects of a file by its cross-reference, newest revision first; raises ValueError if there is none.

    A file whose cross-reference is missing or wrong is read from front to back instead
    (``rebuilt``): a later object takes the place of an earlier one, and what stands within a
    stream is no object.
    """

    def __init__(self, data: bytes) -> None:
        self.data, self.rebuilt = data, False
        self.objects: dict[int, Any] = {}
        self.trailer: dict = {}
        #: Where each object stands: a place in the file, or (number of the stream that packs it, its place there); None if it is free.
        self.places: dict[int, int | tuple[int, int] | None] = {}
        try:
            self._follow()
            self._load()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise ValueError("no catalog")
        except (EOFError, ValueError, IndexError, TypeError, KeyError):
            self._rebuild()
        if not self.objects:
            raise ValueError("no object found")

    # by the cross-reference ------------------------------------------------------

    def _follow(self) -> None:
        """Reads all sections from the last one back; entries and trailer keys of newer ones stand."""
        starts = re.findall(rb"startxref[\x00\t\n\x0c\r ]+(\d+)", self.data)
        if not starts:
            raise ValueError("no startxref")
        todo, seen = [int(starts[-1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            at = _SPACE.match(self.data, at).end()
            trailer = self._table(at) if self.data.startswith(b"xref", at) else self._section(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            todo += [int(trailer[k]) for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)]

    def _table(self, at: int) -> dict:
        r = Reader(self.data, at + 4)
        while True:
            first = r.value()
            if first == b"trailer":
                found = r.value()
                if not isinstance(found, dict):
                    raise ValueError("no trailer")
                return found
            count = r.value()
            r.at = _SPACE.match(self.data, r.at).end()
            for number in range(int(first), int(first) + int(count)):
                if m := _ROW.match(self.data, r.at):
                    r.at, place, kind = m.end(), int(m[1]), m[3]
                else:
                    place, _, kind = r.value(), r.value(), r.value()
                self.places.setdefault(number, int(place) if kind == b"n" and place else None)

    def _section(self, at: int) -> dict:
        head = _OBJECT.match(self.data, at)
        stream = self._value_at(head.end()) if head else None
        if not isinstance(stream, Stream) or stream.get("Type") != "XRef":
            raise ValueError("no cross-reference")
        body, widths = self.decoded(stream), [int(w) for w in stream["W"]]
        index = stream.get("Index") or [0, stream["Size"]]
        at = 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for number in range(int(first), int(first) + int(count)):
                row = []
                for w in widths:
                    row.append(int.from_bytes(body[at : at + w], "big"))
                    at += w
                kind = row[0] if widths[0] else 1
                self.places.setdefault(number, row[1] if kind == 1 else (row[1], row[2]) if kind == 2 else None)
        return dict(stream)

    def _load(self) -> None:
        packed: dict[int, list[int]] = {}
        for number, place in sorted(self.places.items()):
            if isinstance(place, tuple):
                packed.setdefault(place[0], []).append(number)
            elif place is not None:
                head = _OBJECT.match(self.data, _SPACE.match(self.data, place).end())
                if not head or int(head[1]) != number:
                    raise ValueError("an object is not where it should be")
                self.objects[number] = self._value_at(head.end())
        for holder, numbers in packed.items():
            stream = self.objects.get(holder)
            if not isinstance(stream, Stream):
                raise ValueError("no stream of objects")
            found = self._packed(stream)
            self.objects |= {n: found[n] for n in numbers if n in found}

    def _value_at(self, at: int) -> Any:
        """The value that begins at a place, with its bytes if it is a stream."""
        return self._value_and_end(at)[0]

    def _value_and_end(self, at: int) -> tuple[Any, int]:
        data, r = self.data, Reader(self.data, at)
        value = r.value()
        if not (isinstance(value, dict) and data.startswith(b"stream", at := _SPACE.match(data, r.at).end())):
            return value, r.at
        at += 8 if data.startswith(b"\r\n", at + 6) else 7
        size = value.get("Length")
        if isinstance(size, Ref) and isinstance(place := self.places.get(int(size)), int):
            head = _OBJECT.match(data, _SPACE.match(data, place).end())
            size = Reader(data, head.end()).value() if head else None
        sized = isinstance(size, int) and not isinstance(size, Ref) and data[at + size : at + size + 12].lstrip().startswith(b"endstream")
        end = at + size if sized else data.find(b"endstream", at)
        end = end if end >= 0 else len(data)
        stream = Stream(value)
        stream.raw = data[at:end]
        return stream, end

    # from front to back ------------------------------------------------------------

    def _rebuild(self) -> None:
        self.rebuilt, self.objects, self.trailer, self.places = True, {}, {}, {}
        at = 0
        while m := _TRAILER.search(self.data, at):
            at = m.end()
            try:
                value, at = self._value_and_end(at)
                if m[0] == b"trailer":
                    self.trailer |= value if isinstance(value, dict) else {}
                    continue
                self.objects[int(m[1])] = value
                if isinstance(value, Stream) and value.get("Type") == "ObjStm":
                    self.objects |= self._packed(value)
                elif isinstance(value, Stream) and value.get("Type") == "XRef":
                    self.trailer |= {k: v for k, v in value.items() if k in ("Root", "Encrypt", "ID")}
            except (EOFError, ValueError, IndexError, TypeError):
                at = max(at, m.end())

    def _packed(self, stream: Stream) -> dict[int, Any]:
        """The objects in a stream of objects."""
        body = self.decoded(stream)
        r, heads, out = Reader(body), [], {}
        for _ in range(int(stream.get("N", 0))):
            heads.append((int(r.value()), int(r.value())))
        for number, offset in heads:
            out[number] = Reader(body, int(stream.get("First", 0)) + offset).value()
        return out

    def get(self, v: Any) -> Any:
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            v = self.objects.get(int(v))
        return None

    def decoded(self, stream: Stream) -> bytes:
        as_list = lambda v: [] if v is None else v if isinstance(v, list) else [v]
        filters = [str(self.get(f)) for f in as_list(self.get(stream.get("Filter")))]
        parms = [self.get(p) for p in as_list(self.get(stream.get("DecodeParms")))]
        return codecs.decode(stream.raw, filters, [{k: self.get(v) for k, v in (p or {}).items()} for p in parms])

    @property
    def root(self) -> dict:
        found = self.get(self.trailer.get("Root"))
        return found if isinstance(found, dict) else next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), {})

    def pages(self) -> list[dict]:
        out: list[dict] = []

        def walk(node: Any, inherited: dict, depth: int = 0) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > 64:
                return
            own = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, own, depth + 1)
            else:
                out.append(own | node)

        walk(self.root.get("Pages"), {})
        return out

    def fonts(self, page: dict) -> dict[str, tuple[dict[bytes, str], list[int]]]:
        """The maps of codes to texts of a page's fonts that have one, by name."""
        out = {}
        own = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        for name, ref in own.items():
            found = self.get((self.get(ref) or {}).get("ToUnicode"))
            if isinstance(found, Stream):
                out[name] = pdftext.to_unicode(self.decoded(found))
        return out

    def content(self, page: dict) -> bytes:
        found = self.get(page.get("Contents"))
        parts = [self.get(c) for c in found] if isinstance(found, list) else [found]
        return b"\n".join(self.decoded(p) for p in parts if isinstance(p, Stream))


# contents ----------------------------------------------------------------------------


def _times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


def _moved(x: float, y: float, m: tuple) -> tuple:
    """A point under a matrix."""
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def interpret(content: bytes, advance: float = 0.5, fonts: dict[str, tuple[dict[bytes, str], list[int]]] | None = None) -> tuple[list[tuple], list[tuple]]:
    """Text spans (text, x0, y0, x1, y1, size) and drawn shapes (kind, x0, y0, x1, y1, thickness) of a page.

    fonts: by resource name, the texts of codes and their lengths, for fonts that say so.
    """
    font: str | None = None

    def read(v: Any) -> str:
        if isinstance(v, tuple) and fonts and font in fonts:
            return "".join(t for _, t in pdftext.decode_codes(v[1], *fonts[font]))
        return shown(v) or ""

    spans, shapes, stack = [], [], []
    ctm, pen = (1, 0, 0, 1, 0, 0), 1.0
    tm = line = (1, 0, 0, 1, 0, 0)
    size, lead, path, boxes, curves = 12.0, 0.0, [], [], 0
    args: list = []
    r = Reader(content)

    def show(text: str) -> None:
        nonlocal tm
        x, y = _times(tm, ctm)[4:]
        scale = abs(_times(tm, ctm)[3]) or 1.0
        wide = len(text) * size * advance
        if text.strip():
            spans.append((text, x, y - 0.2 * size * scale, x + wide * scale, y + 0.8 * size * scale, size * scale))
        tm = _times((1, 0, 0, 1, wide, 0), tm)

    while True:
        try:
            v = r.value()
        except EOFError:
            break
        if not isinstance(v, bytes):
            args.append(v)
            continue
        n = [a for a in args if isinstance(a, _NUMBERS)]
        if v == b"q":
            stack.append((ctm, pen))
        elif v == b"Q" and stack:
            ctm, pen = stack.pop()
        elif v == b"cm" and len(n) == 6:
            ctm = _times(tuple(n), ctm)
        elif v == b"w" and n:
            pen = float(n[0])
        elif v == b"BT":
            tm = line = (1, 0, 0, 1, 0, 0)
        elif v == b"Tf" and n:
            size, font = float(n[-1]), str(args[0])
        elif v == b"TL" and n:
            lead = float(n[0])
        elif v in (b"Td", b"TD") and len(n) == 2:
            line = tm = _times((1, 0, 0, 1, n[0], n[1]), line)
            lead = -n[1] if v == b"TD" else lead
        elif v == b"Tm" and len(n) == 6:
            tm = line = tuple(n)
        elif v == b"T*":
            line = tm = _times((1, 0, 0, 1, 0, -lead), line)
        elif v in (b"Tj", b"'", b'"') and args:
            if v != b"Tj":
                line = tm = _times((1, 0, 0, 1, 0, -lead), line)
            show(read(args[-1]))
        elif v == b"TJ" and args and isinstance(args[-1], list):
            show("".join(read(a) if isinstance(a, tuple) else " " if isinstance(a, int | float) and a < -180 else "" for a in args[-1]))
        elif v == b"m" and len(n) == 2:
            path = [_moved(*n, ctm)]
        elif v == b"l" and len(n) == 2:
            path.append(_moved(*n, ctm))
        elif v in (b"c", b"v", b"y") and len(n) >= 4 and path:
            curves += 1
            path.append(_moved(*n[-2:], ctm))
        elif v == b"h" and path:
            path.append(path[0])
        elif v == b"re" and len(n) == 4:
            a, b = _moved(n[0], n[1], ctm), _moved(n[0] + n[2], n[1] + n[3], ctm)
            boxes.append((min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])))
        elif v in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"n"):
            if v != b"n":
                shapes += [("line" if min(x1 - x0, y1 - y0) <= 3 else "rect", x0, y0, x1, y1, pen) for x0, y0, x1, y1 in boxes]
                if curves >= 4:
                    shapes.append(("circle", min(x for x, _ in path), min(y for _, y in path), max(x for x, _ in path), max(y for _, y in path), pen))
                elif not curves:
                    for (x0, y0), (x1, y1) in zip(path, path[1:], strict=False):
                        shapes.append(("line", min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1), pen))
            path, boxes, curves = [], [], 0
        args = []
    return spans, shapes


#: Contents kept as read, and the longest of them: pages of one printed form share theirs.
KEPT, KEPT_BYTES = 128, 16_384
_read_before = lru_cache(KEPT)(interpret)


def shown_on(doc: Document, page: dict) -> tuple[list[tuple], list[tuple]]:
    """``interpret`` of a page; contents met before in this process are not read again."""
    content, fonts = doc.content(page), doc.fonts(page)
    return interpret(content, fonts=fonts) if fonts or len(content) > KEPT_BYTES else _read_before(content)


def widgets(doc: Document, pages: list[dict] | None = None) -> list[tuple]:
    """Form fields (name, type, value, page, x0, y0, x1, y1)."""
    on_page = {}
    for i, page in enumerate(doc.pages() if pages is None else pages):
        for a in doc.get(page.get("Annots")) or []:
            on_page[int(a) if isinstance(a, Ref) else id(a)] = i
    out: list[tuple] = []

    def walk(ref: Any, prefix: str, inherited: dict, depth: int = 0) -> None:
        node = doc.get(ref)
        if not isinstance(node, dict) or depth > 32:
            return
        own = inherited | {k: node[k] for k in ("FT", "V") if k in node}
        part = shown(doc.get(node.get("T")))
        name = ".".join(x for x in (prefix, part) if x)
        if "Kids" in node:
            for kid in doc.get(node["Kids"]) or []:
                walk(kid, name, own, depth + 1)
        elif "Rect" in node:
            rect = [float(doc.get(x)) for x in doc.get(node["Rect"])]
            out.append((name, str(doc.get(own.get("FT")) or ""), shown(doc.get(own.get("V"))), on_page.get(int(ref) if isinstance(ref, Ref) else -1, 0), *rect))

    for f in doc.get((doc.get(doc.root.get("AcroForm")) or {}).get("Fields")) or []:
        walk(f, "", {})
    return out


# Spark -------------------------------------------------------------------------------

#: Rows to an Arrow batch, before the last file's.
BATCH = 4000
EVIDENCE = "path string, page int, kind string, text string, x0 double, y0 double, x1 double, y1 double, size double, error string"


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """Everything on the pages of PDF files: spans, lines, rects and widgets, a row each.

    A file that cannot be parsed gives one row with its error.
    """
    return evidence(spark.read.format("binaryFile").load(path).select("path", "content"))


def contents(data: bytes) -> list[tuple]:
    """What stands in a file, a row each: page, kind, text, x0, y0, x1, y1, size."""
    doc = Document(data)
    rows: list[tuple] = []
    pages = doc.pages()
    for i, page in enumerate(pages):
        spans, shapes = shown_on(doc, page)
        rows += [(i, "span", t, x0, y0, x1, y1, s) for t, x0, y0, x1, y1, s in spans]
        rows += [(i, k, None, x0, y0, x1, y1, p) for k, x0, y0, x1, y1, p in shapes]
    rows += [(p, "widget", f"{n}={v or ''}", x0, y0, x1, y1, None) for n, _, v, p, x0, y0, x1, y1 in widgets(doc, pages)]
    return rows


def each_file(files: DataFrame, make: Callable[[], Callable[[str, bytes], list[tuple]]], schema: str) -> DataFrame:
    """The rows for each file (path, content), many files to an Arrow batch; make gives the function of a task."""
    arrow = to_arrow_schema(kind := StructType.fromDDL(schema))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        f = make()
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                held += f(path.as_py(), content.as_py() or b"")
                if len(held) >= BATCH:
                    yield made(held)
                    held = []
        if held:
            yield made(held)

    return files.select("path", "content").mapInArrow(run, kind)


def evidence(files: DataFrame) -> DataFrame:
    """read_forms for a table of (path, content)."""

    def parse(path: str, content: bytes) -> list[tuple]:
        try:
            return [(path, *r, None) for r in contents(content)]
        except Exception as e:  # a bad file must not end the scan
            return [(path, None, "error", None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]

    return each_file(files, lambda: parse, EVIDENCE)


def detect_fields(found: DataFrame) -> DataFrame:
    """Candidate fields of a table of evidence: path, page, kind, r.

    A rule of 24 points or more gives an entry above it, a box of 40 by 9 or more an
    entry within it, and a near-square box of 5 to 22 points a check box. A rule that
    is a box's edge gives none.
    """
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rule = (F.col("kind") == "line") & (high <= 3) & (wide >= 24)
    near_square = (F.abs(wide - high) <= 0.35 * F.greatest(wide, high)) & wide.between(5, 22) & high.between(5, 22)
    mark = (F.col("kind") == "rect") & near_square
    entry = (F.col("kind") == "rect") & ~near_square & (wide >= 40) & (high >= 9)
    box = F.struct("x0", F.when(rule, F.col("y1")).otherwise(F.col("y0")).alias("y0"), "x1", F.when(rule, F.col("y1") + 12).otherwise(F.col("y1")).alias("y1"))
    return found.where(rule | mark | entry).select("path", "page", F.when(mark, "checkbox").otherwise("text").alias("type"), box.alias("r"))


# writing -------------------------------------------------------------------------------


def _text(s: str) -> bytes:
    return b"(" + re.sub(rb"([\\()])", rb"\\\1", s.encode("latin-1", "replace")) + b")"


def _value(s: str) -> bytes:
    """A string of a field, whatever its characters."""
    return b"(" + re.sub(rb"([\\()\r])", lambda m: b"\\r" if m[0] == b"\r" else b"\\" + m[0], pdftext.encode(s)) + b")"


def _drawn(item: tuple) -> bytes:
    """Operators that draw one item: text, line, rect or circle."""
    kind, *v = item
    if kind == "text":
        x, y, size, s = v
        return b"BT /F1 %g Tf %g %g Td %s Tj ET" % (size, x, y, _text(s))
    if kind == "line":
        return b"%g %g m %g %g l S" % tuple(v)
    if kind == "rect":
        return b"%g %g %g %g re S" % tuple(v)
    x, y, r = v
    c = 0.5523 * r  # control points of a quarter circle
    turns = ((x + r, y + c, x + c, y + r, x, y + r), (x - c, y + r, x - r, y + c, x - r, y), (x - r, y - c, x - c, y - r, x, y - r), (x + c, y - r, x + r, y - c, x + r, y))
    return b"\n".join([b"%g %g m" % (x + r, y), *(b"%g %g %g %g %g %g c" % t for t in turns), b"h S"])


def write_drawing(items: list[tuple], width: float = 612, height: float = 792) -> bytes:
    """A page with what is drawn on it: ("text", x, y, size, s), ("line", x0, y0, x1, y1), ("rect", x, y, w, h), ("circle", x, y, r)."""
    return _file([b"0.6 w", *map(_drawn, items)], [], width, height)


def write_form(labels: list[tuple[str, str, str | None]], width: float = 612, height: float = 792) -> bytes:
    """A one-page form: for each (label, kind, value) a printed label and a rule, box or check box; a value makes it a live field.

    kind is underline, boxed or checkbox. A label without a value stays a drawn blank.
    """
    ops, fields = [b"0.6 w"], []
    for i, (label, kind, value) in enumerate(labels):
        y = height - 72 - 36 * i
        ops.append(b"BT /F1 10 Tf 72 %d Td %s Tj ET" % (y, _text(label)))
        rect = (220, y - 3, 420, y + 13) if kind != "checkbox" else (220, y - 2, 232, y + 10)
        if kind == "underline":
            ops.append(b"220 %d m 420 %d l S" % (y - 3, y - 3))
        else:
            ops.append(b"%d %d %d %d re S" % (rect[0], rect[1], rect[2] - rect[0], rect[3] - rect[1]))
        if value is not None:
            fields.append((label, kind, value, rect))
    return _file(ops, fields, width, height)


def _file(ops: list[bytes], fields: list[tuple], width: float, height: float) -> bytes:
    content = codecs.flate_encode(b"\n".join(ops))
    first = 6
    refs = b" ".join(b"%d 0 R" % (first + i) for i in range(len(fields)))
    body = [
        b"<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [%s] /NeedAppearances true >> >>" % refs,
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> /Annots [%s] >>" % (width, height, refs),
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(content), content),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    for label, kind, value, r in fields:
        body.append(b"<< /Type /Annot /Subtype /Widget /FT /%s /T %s /V %s /Rect [%d %d %d %d] /P 3 0 R >>" % (b"Btn" if kind == "checkbox" else b"Tx", _value(label), _value(value), *r))
    out, places = bytearray(b"%PDF-1.7\n"), []
    for i, b in enumerate(body, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, b)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(body) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(body) + 1, table)
    return bytes(out)


def append_objects(original: bytes, objects: dict[int, bytes]) -> bytes:
    """The file with new versions of objects appended; the original stays a prefix."""
    doc = Document(original)
    out, places = bytearray(original), {}
    for number, b in sorted(objects.items()):
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, b)
    table = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in places.items())
    prev = re.findall(rb"startxref\s+(\d+)", original)
    out += b"trailer\n<< /Size %d /Root %d 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (max([*doc.objects, *objects]) + 1, int(doc.trailer.get("Root", 1)), b" /Prev " + prev[-1] if prev else b"", table)
    return bytes(out)
