"""Language ID of texts without spaces."""

import random

import pytest

from leafmark.llm import langid


def test_all_characters_of_a_long_word_are_read():
    word = "".join(chr(0x4E00 + i) for i in range(1000))
    assert "".join(langid.words_of(f"a {word} b")) == f"a{word}b"
    assert max(map(len, langid.words_of(word))) == langid.WIDTH - 2
    assert langid.words_of("short words (internationalizing), stay") == "short words (internationalizing), stay".split()
    assert langid.words_of(None) == []


@pytest.mark.parametrize("ends", [0, 9])
def test_the_middle_of_a_text_without_spaces_decides(spark, ends):
    r = random.Random(3)
    letters = {"aa": "".join(chr(0x4E00 + i) for i in range(60)), "bb": "".join(chr(0x5E00 + i) for i in range(60))}
    make = lambda y, n: "".join(r.choice(letters[y]) for _ in range(n))
    model = langid.learn([(make(y, 300), y) for y in letters for _ in range(60)])
    rows = [(i, make(x, ends) + make(y, 300) + make(x, ends)) for i, (x, y) in enumerate([("aa", "bb"), ("bb", "aa")] * 5)]
    got = {x["doc_id"]: x["lang_pred"] for x in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {i: ["bb", "aa"][i % 2] for i, _ in rows}
