"""Token ids of whole texts with a public tokenizer file, at a bounded memory cost.

The library's result for a text is the concatenation of its results for the
pieces that the tokenizer's own pattern cuts out: the pattern never matches across
white space, its normaliser maps each run of it to one space, and no character
composes with a space. So each word is encoded once and kept in a bounded cache,
and a text becomes a join of cached byte strings.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np

from leafmark.llm.caches import held

TOKENIZER = "word_bpe_49k.json"
#: Characters of words (and of pieces of words) of Latin-1, and of words of other characters, that a
#: worker keeps the ids of; the older half goes when there are more.
CACHE_PLAIN, CACHE_OTHER = 11_000_000, 1_000_000
#: Characters that an entry counts as, beside its own.
ENTRY = 4
#: Characters of a text that are looked up at a time, and the rest of the last word.
STRETCH = 1 << 16
#: Letters and numbers of Latin-1 (fixed values), for the tokenizer's pattern on words of Latin-1.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache(dict):
    """A dict that computes what it lacks, and forgets its oldest half when its keys add up to more than ``most``."""

    def __init__(self, most: int, compute: Callable) -> None:
        super().__init__()
        self.most, self.compute, self.size = most, compute, 0

    def __missing__(self, key):
        value = self.compute(key)
        cost = len(key) + ENTRY
        if cost <= self.most // 2:
            self.size += cost
            if self.size > self.most:
                for k in list(itertools.islice(self, len(self) // 2)):
                    del self[k]
                    self.size -= len(k) + ENTRY
            self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte value."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """``encode(text)`` gives the ids as bytes of little-endian unsigned 16-bit integers.

    Words of Latin-1 characters are cut by the tokenizer file's own pattern and
    their pieces encoded through its BPE model; any other word goes through the
    whole tokenizer. Null texts count as empty.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, models

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer do not fit 16 bits")
        model, self.cut = spec["model"], None
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model["type"] == "BPE" and steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in split] == ["Split", "ByteLevel"]:
            merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
            self.tokenize = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0).tokenize
            pattern = split[0]["pattern"]["Regex"]
            for name, own in ((r"\p{L}", LETTERS), (r"\p{N}", NUMBERS)):
                pattern = pattern.replace(name, own)
            self.cut = re.compile(pattern).findall
        self.letters = _byte_letters()
        # Latin-1 without "<", which begins special tokens, and what is not printable.
        self.odd = re.compile(r"[^ !-;=-~¡-ÿ]").search
        self.plain = _Cache(CACHE_PLAIN, self._plain_ids).__getitem__
        self.other = _Cache(CACHE_OTHER, self._other_ids).__getitem__

    def _plain_ids(self, word: str) -> bytes:
        """The ids of a word or piece in small letters."""
        if not word.isalpha():
            pieces = self.cut(word)
            if pieces != [word]:
                return b"".join(map(self.plain, pieces))
        written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.tokenize(written)]).tobytes()

    def _other_ids(self, word: str) -> bytes:
        return array("H", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        for space in "\t\n\v\f\r":
            text = text.replace(space, " ")
        if self.cut is None:
            return b"".join(map(self.other, filter(None, text.split(" "))))
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + STRETCH)
            stretch = text[at:end] if end >= 0 else text[at:]
            at = end + 1 if end >= 0 else len(text)
            out.append(self._stretch(stretch))
        return out[0] if len(out) == 1 else b"".join(out)

    def _stretch(self, text: str) -> bytes:
        """The ids of whole words with blanks between them."""
        out, at = [], 0
        while odd := self.odd(text, at):
            start, end = text.rfind(" ", at, odd.start()) + 1 or at, text.find(" ", odd.start())
            end = len(text) if end < 0 else end
            out += map(self.plain, text[at:start].lower().split())
            out.append(self.other(text[start:end]))
            at = end
        out += map(self.plain, text[at:].lower().split())
        return b"".join(out)


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a file; its cache lasts until another operator needs one."""
    return held(("tokens", path), lambda: WordEncoder(path))


def crc_u32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
