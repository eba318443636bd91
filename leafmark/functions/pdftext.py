"""Bytes of PDF strings as text: document encoding, glyph names and ToUnicode maps."""

from __future__ import annotations

import re
import unicodedata

#: Characters of the document encoding that Latin-1 has elsewhere (fixed values).
DOC = dict(zip(range(0x18, 0x20), "˘ˇˆ˙˝˛˚˜", strict=True)) | dict(zip(range(0x80, 0x9F), "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž", strict=True)) | {0xA0: "€"}
_BYTES = {c: b for b, c in DOC.items()}
#: Names of glyphs that are no Unicode names of theirs (fixed values).
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "bullet": "•", "endash": "–", "emdash": "—",
    "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "fi": "fi", "fl": "fl", "Euro": "€", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oslash": "ø", "Oslash": "Ø",
}
_DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_MARKS = {"acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "cedilla": "CEDILLA", "caron": "CARON", "ring": "RING ABOVE"}


def decode(data: bytes) -> str:
    """A text string: UTF-16 or UTF-8 after their marks, else the document encoding."""
    if data[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return data.decode("utf-16", "replace")
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace")
    return "".join(DOC.get(b) or chr(b) for b in data)


def encode(text: str) -> bytes:
    """The text in the document encoding if it fits, else in UTF-16 after its mark."""
    out = bytearray()
    for c in text:
        b = _BYTES.get(c, ord(c))
        if b > 255 or (b in DOC and DOC[b] != c):
            return b"\xfe\xff" + text.encode("utf-16-be")
        out.append(b)
    return bytes(out)


def glyph(name: str) -> str:
    """The text of a glyph by its name: listed names, letters with marks, digits, uniXXXX and uXXXX; nothing for others."""
    base = name.split(".")[0]
    if "_" in base and base not in GLYPHS:
        return "".join(map(glyph, base.split("_")))
    if base in GLYPHS:
        return GLYPHS[base]
    if len(base) == 1:
        return base
    if base in _DIGITS:
        return str(_DIGITS.index(base))
    if m := re.fullmatch("uni((?:[0-9A-F]{4})+)", base):
        return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4))
    if m := re.fullmatch("u([0-9A-F]{4,6})", base):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else ""
    if base[1:] in _MARKS:
        case = "CAPITAL" if base[0].isupper() else "SMALL"
        try:
            return unicodedata.lookup(f"LATIN {case} LETTER {base[0].upper()} WITH {_MARKS[base[1:]]}")
        except KeyError:
            return ""
    return ""


def _utf16(digits: bytes) -> str:
    return bytes.fromhex(digits.decode()).decode("utf-16-be", "replace")


def to_unicode(data: bytes) -> tuple[dict[bytes, str], list[int]]:
    """The text of each code of a ToUnicode map, and the lengths of codes in bytes, longest first."""
    out: dict[bytes, str] = {}
    lengths = {len(a) // 2 for block in re.findall(rb"begincodespacerange(.*?)endcodespacerange", data, re.S) for a in re.findall(rb"<([0-9A-Fa-f]+)>", block)}
    clean = re.sub(rb"(?<=[0-9A-Fa-f])\s+(?=[0-9A-Fa-f]*>)", b"", data)
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", clean, re.S):
        for code, text in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", block):
            out[bytes.fromhex(code.decode())] = _utf16(text)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", clean, re.S):
        for low, high, text, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            first, last, size = int(low, 16), int(high, 16), len(low) // 2
            each = re.findall(rb"<([0-9A-Fa-f]+)>", listed)
            for i, code in enumerate(range(first, min(last, first + 0xFFFF) + 1)):
                if each:
                    if i < len(each):
                        out[code.to_bytes(size, "big")] = _utf16(each[i])
                elif text:
                    start = _utf16(text)
                    out[code.to_bytes(size, "big")] = start[:-1] + chr(ord(start[-1]) + i)
    return out, sorted(lengths or {len(c) for c in out} or {1}, reverse=True)


def decode_codes(raw: bytes, table: dict[bytes, str], lengths: list[int]) -> list[tuple[bytes, str]]:
    """The codes of a shown string and their texts; a byte that no code begins with stands for itself."""
    out, at = [], 0
    while at < len(raw):
        size = next((n for n in lengths if raw[at : at + n] in table), None)
        code = raw[at : at + (size or min(lengths))]
        out.append((code, table[code] if size else (chr(code[0]) if len(code) == 1 else "�")))
        at += len(code)
    return out
