"""Codecs round trip; forms written here are read back, whole or damaged."""

import random

import pytest

from leafmark.sources import codecs, pdf


@pytest.mark.parametrize("name", sorted(codecs.ENCODERS))
@pytest.mark.parametrize("seed", range(3))
def test_codecs_round_trip(name, seed):
    r = random.Random(seed)
    for n in (0, 1, 5, 300, 20_000):
        data = bytes(r.choice(b"aaaab\x00\xff" if seed else range(256)) for _ in range(n))
        assert codecs.decode(codecs.ENCODERS[name](data), [name]) == data


def test_damaged_flate_gives_what_it_can():
    data = codecs.flate_encode(b"hello " * 1000)
    assert codecs.flate_decode(data[:-8]).startswith(b"hello hello")


def test_png_predictor():
    assert codecs.predict(bytes([1, 5, 1, 1, 2, 1, 1, 1]), 12, 1, 8, 3) == bytes([5, 6, 7, 6, 7, 8])


LABELS = [("Full name (a)", "underline", "Ann"), ("City", "boxed", None), ("Agree", "checkbox", "Yes")]


def test_forms_read_back(spark, tmp_path):
    data = pdf.write_form(LABELS)
    (tmp_path / "a.pdf").write_bytes(data)
    (tmp_path / "b.pdf").write_bytes(data[: data.index(b"xref")])
    (tmp_path / "c.pdf").write_bytes(b"not a form")
    found = pdf.read_forms(spark, f"{tmp_path}/*.pdf").cache()
    rows = {p: [r for r in found.collect() if r["path"].endswith(p)] for p in ("a.pdf", "b.pdf", "c.pdf")}
    for p in ("a.pdf", "b.pdf"):
        assert [r["text"] for r in rows[p] if r["kind"] == "span"] == [x[0] for x in LABELS]
        assert {r["text"] for r in rows[p] if r["kind"] == "widget"} == {"Full name (a)=Ann", "Agree=Yes"}
    assert [r["kind"] for r in rows["c.pdf"]] == ["error"]
    fields = [(r["type"], r["r"]["x0"]) for r in pdf.detect_fields(found).where("path LIKE '%a.pdf'").collect()]
    assert sorted(fields) == [("checkbox", 220.0), ("text", 220.0), ("text", 220.0)]


def test_appending_keeps_the_prefix():
    data = pdf.write_form(LABELS)
    new = pdf.append_objects(data, {6: b"<< /Type /Annot /Subtype /Widget /FT /Tx /T (Full name \\(a\\)) /V (Bob) /Rect [220 717 420 733] /P 3 0 R >>"})
    assert new.startswith(data) and ("Full name (a)", "Tx", "Bob") in [w[:3] for w in pdf.widgets(pdf.Document(new))]


def small_file(objects, trailer, tables=True):
    """A file of numbered objects with a cross-reference of 20-byte rows."""
    out, places = bytearray(b"%PDF-1.7\n"), {}
    for n, body in objects:
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    if tables:
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in places.items())
        out += b"trailer\n<< %s >>\nstartxref\n%d\n%%%%EOF\n" % (trailer, at)
    return bytes(out), places


CATALOG = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>")]


def test_what_looks_like_an_object_in_a_stream_is_none():
    trap = b"1 0 obj << /Type /Other >> endobj"
    data, _ = small_file([*CATALOG, (4, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(trap), trap))], b"/Root 1 0 R /Size 5")
    for own in (data, data[: data.rindex(b"xref\n0 1")], data.replace(b"startxref\n", b"startxref\n9")):
        doc = pdf.Document(own)
        assert doc.root["Type"] == "Catalog" and len(doc.pages()) == 1 and doc.rebuilt == (own is not data)


def test_the_newest_revision_stands():
    old, _ = small_file([*CATALOG, (4, b"(old)"), (5, b"(kept)")], b"/Root 1 0 R /Size 6 /Info 5 0 R")
    prev = int(old.split(b"startxref\n")[1].split()[0])
    place = len(old)
    new = old + b"4 0 obj\n(new)\nendobj\n"
    table = len(new)
    new += b"xref\n4 2\n%010d 00000 n \n0000000000 00001 f \ntrailer\n<< /Size 6 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (place, prev, table)
    doc = pdf.Document(new)
    assert not doc.rebuilt and pdf.shown(doc.objects[4]) == "new" and 5 not in doc.objects and int(doc.trailer["Info"]) == 5


@pytest.mark.parametrize("whole", [True, False])
def test_cross_reference_streams_and_packed_objects(whole):
    inner = b"1 0 2 33 << /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [] /Count 0 >>"
    first = inner.index(b"<<")
    packed = codecs.flate_encode(inner)
    out = bytearray(b"%PDF-1.7\n")
    stale = len(out)
    out += b"1 0 obj\n<< /Type /Catalog /Old true >>\nendobj\n"
    holder = len(out)
    out += b"7 0 obj\n<< /Type /ObjStm /N 2 /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (first, len(packed), packed)
    at = len(out)
    rows = [(0, 0, 255), (2, 7, 0), (2, 7, 1), (1, holder, 0), (1, at, 0)]
    body = codecs.flate_encode(b"".join(bytes([a]) + b.to_bytes(2, "big") + bytes([c]) for a, b, c in rows))
    out += b"8 0 obj\n<< /Type /XRef /Size 9 /Index [0 3 7 2] /W [1 2 1] /Root 1 0 R /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (len(body), body)
    out += b"startxref\n%d\n%%%%EOF\n" % at if whole else b""
    doc = pdf.Document(bytes(out))
    assert stale and doc.rebuilt is not whole and doc.root["Type"] == "Catalog" and "Old" not in doc.root and doc.get(doc.root["Pages"])["Count"] == 0


def test_codes_are_read_by_their_font_and_values_in_any_script():
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <00410042> endbfchar"
    content = b"BT /F1 10 Tf 10 10 Td <0102> Tj ET"
    objects = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>")]
    objects += [(4, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content)), (5, b"<< /Type /Font /ToUnicode 6 0 R >>"), (6, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap))]
    doc = pdf.Document(small_file(objects, b"/Root 1 0 R /Size 7")[0])
    [page] = doc.pages()
    assert interpret_text(doc, page) == ["AB\x02"]
    data = pdf.write_form([("Имя (a)\\", "boxed", "Żółć 漢\r字")])
    assert [w[:3] for w in pdf.widgets(pdf.Document(data))] == [("Имя (a)\\", "Tx", "Żółć 漢\r字")]


def interpret_text(doc, page):
    return [s[0] for s in pdf.interpret(doc.content(page), fonts=doc.fonts(page))[0]]
