"""Op 2: license scans.

An Aho-Corasick automaton over the words of a text finds notice phrases and the
words of identifier tags in one pass. The expression after a tag is parsed by the
shunting-yard algorithm (WITH binds tightest, then AND, then OR) and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.arrow import map_rows
from leafmark.storage import table

#: Base phrases and their labels (fixed values).
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases and labels.
PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "mit license": "mit",
    "apache license 2 0": "apache-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl-2",
    "eclipse public license": "epl",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: How freely text under a label may be used, from 0 to 1; labels not listed count as UNKNOWN.
FREEDOM = {"mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "cc-by": 0.9, "mpl-2": 0.7, "lgpl": 0.6, "epl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "gpl-2": 0.4, "gpl-3": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "proprietary": 0.0}
UNKNOWN = 0.5
PRECEDENCE = {"WITH": 3, "AND": 2, "OR": 1}
#: Identifiers without a digit or hyphen that are told from prose by being listed.
PLAIN_IDS = frozenset("0bsd aal adsl afmparse beerware bsl curl eurosym fair ftl imatix info-zip intel json libpng libtiff naumen ncsa ngpl nokia ntp openssl plexus postgresql ppl psutils qhull ruby sendmail sleepycat unlicense vim vsl w3c wtfpl x11 xerox xnet zed zlib".split())
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_TAGGED = re.compile(r"SPDX-License-Identifier[^\S\n]*:[^\S\n]*([^\n]*)", re.I)
_KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def to_rpn(expression: str) -> list[str] | None:
    """A license expression in postfix order; None if it is malformed.

    It ends where prose begins: at a word that cannot be an identifier, and at an
    operator in small letters that no identifier follows.
    """
    out, stack, operand = [], [], True
    tokens = _TOKEN.findall(expression)
    for i, token in enumerate(tokens):
        op = token.upper()
        if op in PRECEDENCE:
            if token != op and not operand and not (i + 1 < len(tokens) and (tokens[i + 1] == "(" or is_identifier(tokens[i + 1]))):
                break
            if operand:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[op]:
                out.append(stack.pop())
            stack.append(op)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand or not is_identifier(token):
                if operand and stack and stack[-1] != "(":
                    stack.pop()  # an operator with prose behind it
                    operand = False
                break  # the expression is over; prose follows
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def is_identifier(token: str) -> bool:
    """Known by its label, or of the form of identifiers: a listed word, or letters with a digit or hyphen."""
    low = token.lower()
    return label_of(token) in FREEDOM or low in PLAIN_IDS or (low[0].isalnum() and any(c.isalpha() for c in low) and any(c.isdigit() or c == "-" for c in low.strip("-.+:")))


def label_of(identifier: str) -> str:
    """The label of an identifier, e.g. Apache-2.0 is apache-2 and GPL-3.0-or-later gpl-3."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    name = re.sub(r"\.0\b", "", name)
    if name in FREEDOM:
        return name
    shorter = re.sub(r"-\d[\d.]*$", "", name)
    return shorter if shorter in FREEDOM else name


def evaluate(rpn: list[str]) -> tuple[set[str], float]:
    """Labels of an expression and its freedom: OR is a choice, AND binds to both, WITH adds an exception."""
    stack: list[tuple[set[str], float]] = []
    for token in rpn:
        if token in PRECEDENCE:
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a, min(1.0, x + 0.1)) if token == "WITH" else (a | b, min(x, y) if token == "AND" else max(x, y)))
        else:
            label = label_of(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
    return stack.pop()


_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for phrase in {**PHRASES, **BASE, TAG: ""}:
            automaton.add_word(f" {phrase} ", phrase)
        automaton.make_automaton()
        _AUTOMATON.append(automaton)
    return _AUTOMATON[0]


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of a whole text."""
    words = (text or "").encode().lower().translate(_KEEP).split()
    stream = b"".join([b" ", b" ".join(words), b" "])
    starts, base, own, tagged = [], set(), set(), False
    for end, phrase in _automaton().iter(stream.decode("latin-1")):
        if phrase in BASE:
            starts.append(end - len(phrase))
            base.add(BASE[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            own.add(PHRASES[phrase])
    # The word that begins at a byte: the blanks before it, counted once along the text.
    places, at, blanks = [], 0, -1
    for start in sorted(starts):
        blanks += stream.count(b" ", at, start)
        at = start
        places.append(blanks)
    freedom = [FREEDOM[x] for x in base | own]
    for expression in _TAGGED.findall(text) if tagged else ():
        if rpn := to_rpn(expression):
            labels, x = evaluate(rpn)
            own |= labels
            freedom.append(x)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), min(freedom, default=0.0)


def scan_documents(docs: DataFrame) -> DataFrame:
    """License places and labels of every row of docs (doc_id, text).

    score is the freedom of the strictest terms found, 0 where there are none. A
    null text counts as empty: no words, no places, empty labels. Equal rows get
    equal results; other columns are ignored.
    """

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in each:
            yield doc_id, *scan(text)

    out = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: license places and labels of all documents."""
    return scan_documents(table(spark, sf_dir, "documents"))
