"""Fields written into files are read back; the old bytes stay a prefix."""

import pytest

from leafmark.sources import acroform, pdf
from leafmark.sources.acroform import Field

PAGE = pdf.write_drawing([("text", 72, 700, 10, "Name:")])
FIELDS = [
    Field("a.name", "text", 0, (100, 690, 300, 706), "Ann (é)", 30), Field("notes", "multiline_text", 0, (100, 600, 300, 680), "one two three " * 8), Field("agree", "checkbox", 0, (72, 560, 84, 572), "Yes"),
    Field("code", "text", 0, (100, 520, 200, 536), "1234", cells=5), Field("a.name", "text", 0, (100, 490, 300, 506), "漢字"), Field("pick", "choice", 0, (100, 460, 200, 476), "b", choices=("a", "b")),
]


def read(data):
    return {w[0]: w[2] for w in pdf.widgets(pdf.Document(data))}


def test_fields_are_added_filled_and_flattened():
    new = acroform.add_fields(PAGE, FIELDS)
    assert new.startswith(PAGE) and not pdf.Document(new).rebuilt
    assert read(new) == {"a.name": "Ann (é)", "notes": FIELDS[1].value, "agree": "Yes", "code": "1234", "a.name_1": "漢字", "pick": "b"}
    filled = acroform.set_values(new, {"a.name": "Bob\r\\", "agree": None, "code": None, "nosuch": "x"})
    assert filled.startswith(new) and read(filled) == {"a.name": "Bob\r\\", "notes": FIELDS[1].value, "agree": "Off", "code": None, "a.name_1": "漢字", "pick": "b"}
    assert acroform.set_values(new, {}) == new
    flat = acroform.flatten(new)
    doc = pdf.Document(flat)
    [page] = doc.pages()
    texts = [s[0] for s in pdf.interpret(doc.content(page), fonts=doc.fonts(page))[0]]
    assert read(flat) == {} and flat.startswith(new) and texts[:2] == ["Name:", "Ann (é)"] and [t for t in texts if t in "1234"] == list("1234")


@pytest.mark.parametrize("value", [None, True, 3, -2.50001, 0.000001, "text (a)\\", [1, [None]], {"A B": pdf.Name("x/y"), "R": pdf.Ref(7)}])
def test_values_are_written_as_they_are_read(value):
    got = pdf.Reader(acroform.serialize(value)).value()
    plain = lambda v: pdf.shown(v) if isinstance(v, tuple) else [plain(x) for x in v] if isinstance(v, list) else v
    assert plain(got) == (0 if value == 0.000001 else value)


@pytest.mark.parametrize("width", [20.0, 60.0, 200.0])
def test_lines_fit_and_lose_nothing(width):
    text = "a few words and averyveryverylongwordthatdoesnotfit\nnext paragraph"
    lines = acroform.wrapped(text, width, 8.0)
    most = max(1, int((width - 4) / 4))
    assert all(len(x) <= most for x in lines) and "".join("".join(lines).split()) == "".join(text.split())


def test_files_are_filled_in_a_job(spark):
    new = acroform.add_fields(PAGE, FIELDS[:1])
    files = spark.createDataFrame([("a", new), ("b", new), ("c", b"none")], "path string, content binary")
    values = spark.createDataFrame([("a", "a.name", "Eve"), ("c", "a.name", "x")], "path string, name string, value string")
    got = {r["path"]: r for r in acroform.fill_files(files, values).collect()}
    assert read(bytes(got["a"]["content"])) == {"a.name": "Eve"} and bytes(got["b"]["content"]) == new and got["c"]["error"] and bytes(got["c"]["content"]) == b"none"
