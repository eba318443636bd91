"""Writing form fields into PDF files: new fields, values and flat pages, as a revision behind the old bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions import pdftext
from leafmark.functions.layout import FLAGS
from leafmark.sources import pdf
from leafmark.sources.pdf import Document, Name, Ref, Stream

#: Kinds of fields by type (fixed values).
KIND = {"checkbox": "Btn", "radio": "Btn", "button": "Btn", "choice": "Ch", "listbox": "Ch", "signature": "Sig"}
#: Points of padding within a field, the mean advance of its font, and sizes that text may take (fixed values).
PADDING, ADVANCE, LEAST, MOST = 2.0, 0.5, 4.0, 12.0


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    page: int
    box: tuple[float, float, float, float]
    value: str | None = None
    max_length: int | None = None
    cells: int | None = None
    choices: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    export: str = "Yes"


def number(x: float) -> bytes:
    """A number in as few characters as a hundred-thousandth needs."""
    text = f"{x:.5f}".rstrip("0").rstrip(".")
    return (text if text not in ("-0", "") else "0").encode()


def serialize(v: Any) -> bytes:
    """A value as it stands in a file."""
    if v is None or isinstance(v, bool):
        return {None: b"null", True: b"true", False: b"false"}[v]
    if isinstance(v, Ref):
        return b"%d 0 R" % v
    if isinstance(v, Name):
        return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02X" % m[0][0], v.encode("latin-1", "replace"))
    if isinstance(v, int | float):
        return number(v)
    if isinstance(v, str):
        v = ("text", pdftext.encode(v))
    if isinstance(v, tuple):
        return b"(" + re.sub(rb"[\\()\r]", lambda m: b"\\r" if m[0] == b"\r" else b"\\" + m[0], v[1]) + b")"
    if isinstance(v, list):
        return b"[" + b" ".join(map(serialize, v)) + b"]"
    if isinstance(v, bytes):
        return v
    body = b"<< " + b" ".join(serialize(Name(k)) + b" " + serialize(x) for k, x in v.items()) + b" >>"
    if isinstance(v, Stream):
        return body + b"\nstream\n" + v.raw + b"\nendstream"
    return body


def sanitized(segment: str) -> str:
    return re.sub(r"[\s./()<>\[\]{}%#]", "_", segment)


def unique(names: list[str]) -> list[str]:
    """The names, second and later ones of a kind with _1, _2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, -1) + 1
        out.append(n if not seen[n] else f"{n}_{seen[n]}")
    return out


# appearances -------------------------------------------------------------------------


def fitted(value: str, width: float, height: float) -> float:
    """The largest size at which a line fits a box."""
    room = (width - 2 * PADDING) / max(1e-6, ADVANCE * len(value)) if value else MOST
    return round(min(MOST, max(LEAST, min(room, height - 2 * PADDING))), 2)


def wrapped(value: str, width: float, size: float) -> list[str]:
    """Lines of words that fit a width; a longer word is cut."""
    most, out = max(1, int((width - 2 * PADDING) / (ADVANCE * size))), []
    for paragraph in value.split("\n"):
        line = ""
        for word in paragraph.split(" "):
            while len(word) > most:
                room = most - len(line) - bool(line)
                if line and room < 1:
                    out.append(line)
                    line = ""
                    continue
                line, word = f"{line} {word[:room]}" if line else word[:most], word[room if line else most :]
                out.append(line)
                line = ""
            if line and len(line) + 1 + len(word) > most:
                out.append(line)
                line = word
            else:
                line = f"{line} {word}" if line else word
        out.append(line)
    return out


def _shown(x: float, y: float, size: float, text: str) -> bytes:
    return b"BT /Helv %s Tf %s %s Td %s Tj ET" % (number(size), number(x), number(y), serialize(("text", text.encode("latin-1", "replace"))))


def appearance(f: Field, value: str | None) -> bytes:
    """What a field draws for a value, from its own lower corner."""
    w, h = f.box[2] - f.box[0], f.box[3] - f.box[1]
    if f.kind in ("checkbox", "radio"):
        if not value or value == "Off":
            return b""
        if f.kind == "radio":
            return pdf._drawn(("circle", w / 2, h / 2, 0.3 * min(w, h))).replace(b"h S", b"h f")
        a, b = 0.2 * w, 0.8 * w
        return b"1 w %s %s m %s %s l S %s %s m %s %s l S" % tuple(map(number, (a, 0.2 * h, b, 0.8 * h, a, 0.8 * h, b, 0.2 * h)))
    if not value:
        return b""
    if f.cells:
        size, step = fitted("0", w / f.cells, h), w / f.cells
        return b"\n".join(_shown(step * (i + 0.5) - ADVANCE * size / 2, (h - size) / 2 + 0.2 * size, size, c) for i, c in enumerate(value[: f.cells]))
    if f.kind == "multiline_text":
        size = next((s for s in (10.0, 9.0, 8.0, 7.0, 6.0, 5.0) if len(wrapped(value, w, s)) * 1.2 * s <= h - 2 * PADDING), LEAST)
        return b"\n".join(_shown(PADDING, h - PADDING - size * (1 + 1.2 * i), size, line) for i, line in enumerate(wrapped(value, w, size)))
    size = fitted(value, w, h)
    return _shown(PADDING, (h - size) / 2 + 0.2 * size, size, value)


def _form(f: Field, value: str | None) -> Stream:
    out = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, f.box[2] - f.box[0], f.box[3] - f.box[1]], "Resources": {"Font": {"Helv": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}}}})
    out.raw = b"q\n" + appearance(f, value) + b"\nQ"
    out["Length"] = len(out.raw)
    return out


# files ---------------------------------------------------------------------------------


def _page_numbers(doc: Document) -> list[int]:
    """The objects that are a file's pages, in order."""
    out: list[int] = []

    def walk(ref: Any, depth: int = 0) -> None:
        node = doc.get(ref)
        if isinstance(node, dict) and depth < 64:
            if "Kids" in node:
                for kid in doc.get(node["Kids"]) or []:
                    walk(kid, depth + 1)
            elif isinstance(ref, Ref):
                out.append(int(ref))

    walk(doc.root.get("Pages"))
    return out


def add_fields(data: bytes, fields: list[Field]) -> bytes:
    """The file with live fields; names that repeat, here or in the file, are made unique."""
    doc = Document(data)
    pages = _page_numbers(doc)
    root = doc.trailer.get("Root")
    if not isinstance(root, Ref) or not pages:
        raise ValueError("no catalog or page that can be changed")
    form = dict(doc.get(doc.root.get("AcroForm")) or {})
    old = [w[0] for w in pdf.widgets(doc)]
    names = unique([*old, *(".".join(map(sanitized, f.name.split("."))) for f in fields)])[len(old) :]
    nxt = max(doc.objects) + 1
    new: dict[int, Any] = {}
    notes: dict[int, list] = {}
    for f, name in zip(fields, names, strict=True):
        page, kind = pages[f.page], KIND.get(f.kind, "Tx")
        flags = sum(1 << FLAGS[x] for x in {*f.flags, *(["multiline"] if f.kind == "multiline_text" else []), *(["comb"] if f.cells else []), *(["combo"] if f.kind == "choice" else []), *(["radio"] if f.kind == "radio" else [])})
        node: dict = {"Type": Name("Annot"), "Subtype": Name("Widget"), "FT": Name(kind), "T": name, "Rect": list(f.box), "P": Ref(page), "F": 4, "Ff": flags}
        node |= {"MaxLen": f.cells or f.max_length} if f.cells or f.max_length else {}
        node |= {"Opt": list(f.choices)} if f.choices else {}
        if kind == "Btn":
            on, off = nxt + 1, nxt + 2
            state = Name(f.export if f.value and f.value != "Off" else "Off")
            new[on], new[off] = _form(f, f.export), _form(f, None)
            node |= {"V": state, "AS": state, "AP": {"N": {f.export: Ref(on), "Off": Ref(off)}}}
        elif kind != "Sig":
            new[nxt + 1] = _form(f, f.value)
            node |= {"AP": {"N": Ref(nxt + 1)}, "DA": "/Helv 0 Tf 0 g"} | ({"V": f.value} if f.value is not None else {})
        new[nxt] = node
        notes.setdefault(page, []).append(Ref(nxt))
        form["Fields"] = [*(doc.get(form.get("Fields")) or []), Ref(nxt)]
        nxt = max(new) + 1
    for page, own in notes.items():
        node = dict(doc.objects[page])
        new[page] = node | {"Annots": [*(doc.get(node.get("Annots")) or []), *own]}
    new[int(root)] = dict(doc.root) | {"AcroForm": form}
    return pdf.append_objects(data, {n: serialize(v) for n, v in new.items()})


def _widget_objects(doc: Document) -> dict[str, tuple[int, dict, str]]:
    """Each field's object, its dictionary and its kind, by full name."""
    out: dict[str, tuple[int, dict, str]] = {}

    def walk(ref: Any, prefix: str, kind: str, depth: int = 0) -> None:
        node = doc.get(ref)
        if not isinstance(node, dict) or depth > 32:
            return
        name = ".".join(x for x in (prefix, pdf.shown(doc.get(node.get("T")))) if x)
        kind = str(doc.get(node.get("FT")) or kind)
        if "Kids" in node:
            for kid in doc.get(node["Kids"]) or []:
                walk(kid, name, kind, depth + 1)
        elif isinstance(ref, Ref) and "Rect" in node:
            out[name] = int(ref), node, kind

    for f in doc.get((doc.get(doc.root.get("AcroForm")) or {}).get("Fields")) or []:
        walk(f, "", "")
    return out


def _field_of(doc: Document, name: str, node: dict, kind: str) -> Field:
    box = tuple(float(doc.get(x)) for x in doc.get(node["Rect"]))
    flags = int(doc.get(node.get("Ff")) or 0)
    on = next((k for k in (doc.get((doc.get(node.get("AP")) or {}).get("N")) or {}) if k != "Off"), "Yes") if kind == "Btn" else "Yes"
    cells = int(doc.get(node.get("MaxLen")) or 0) if flags >> FLAGS["comb"] & 1 else None
    form = "radio" if kind == "Btn" and flags >> FLAGS["radio"] & 1 else "checkbox" if kind == "Btn" else "multiline_text" if flags >> FLAGS["multiline"] & 1 else "text"
    return Field(name, form, 0, box, cells=cells or None, export=on)


def set_values(data: bytes, values: dict[str, str | None]) -> bytes:
    """The file with values of fields, a new look for each; names that it does not have are left out."""
    doc = Document(data)
    new: dict[int, Any] = {}
    nxt = max(doc.objects) + 1
    for name, (place, node, kind) in _widget_objects(doc).items():
        if name not in values:
            continue
        value, f = values[name], _field_of(doc, name, node, kind)
        if kind == "Btn":
            state = Name(f.export if value and value != "Off" else "Off")
            new[place] = dict(node) | {"V": state, "AS": state}
        else:
            new[nxt] = _form(f, value)
            new[place] = {k: v for k, v in node.items() if k != "V"} | ({"V": value} if value is not None else {}) | {"AP": {"N": Ref(nxt)}}
            nxt += 1
    return pdf.append_objects(data, {n: serialize(v) for n, v in new.items()}) if new else data


def flatten(data: bytes) -> bytes:
    """The file with its fields' looks drawn on the pages and no field left."""
    doc = Document(data)
    drawn: dict[int, list[bytes]] = {}
    for name, (_, node, kind) in _widget_objects(doc).items():
        f = _field_of(doc, name, node, kind)
        value = pdf.shown(doc.get(node.get("V")))
        page = node.get("P")
        if isinstance(page, Ref):
            drawn.setdefault(int(page), []).append(b"q 1 0 0 1 %s %s cm\n%s\nQ" % (number(f.box[0]), number(f.box[1]), appearance(f, value)))
    new: dict[int, Any] = {}
    nxt = max(doc.objects) + 1
    font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}
    inherited = dict(zip(_page_numbers(doc), doc.pages(), strict=False))
    for page, parts in drawn.items():
        node, stream = dict(doc.objects[page]), Stream({})
        stream.raw = b"\n".join(parts)
        stream["Length"] = len(stream.raw)
        new[nxt] = stream
        old = node.get("Contents")
        now = doc.get(old)
        kept = now if isinstance(now, list) else [old] if old is not None else []
        resources = dict(doc.get(inherited.get(page, {}).get("Resources")) or {})
        resources["Font"] = dict(doc.get(resources.get("Font")) or {}) | {"Helv": font}
        new[page] = {k: v for k, v in node.items() if k != "Annots"} | {"Contents": [*kept, Ref(nxt)], "Resources": resources}
        nxt += 1
    root = doc.trailer.get("Root")
    if isinstance(root, Ref):
        new[int(root)] = {k: v for k, v in doc.root.items() if k != "AcroForm"}
    return pdf.append_objects(data, {n: serialize(v) for n, v in new.items()})


def fill_files(files: DataFrame, values: DataFrame) -> DataFrame:
    """path, content and error of each file with its values set. files: path, content. values: path, name, value.

    A file without values stays as it is; one that cannot be read keeps its bytes beside the error.
    """
    own = values.groupBy("path").agg(F.collect_list(F.struct("name", "value")).alias("given"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, given in zip(b["path"], b["content"], b["given"], strict=True):
                try:
                    done, error = set_values(bytes(content), {g["name"]: g["value"] for g in (given if given is not None else [])}), None
                except Exception as e:  # a bad file must not end the job
                    done, error = bytes(content or b""), f"{type(e).__name__}: {e}"[:200]
                rows.append((path, done, error))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return files.select("path", "content").join(own, "path", "left").mapInPandas(fill, "path string, content binary, error string")
