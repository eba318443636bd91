"""Ciphers against published vectors; PDF texts there and back."""

import pytest

from leafmark.functions import aes, pdftext

H = bytes.fromhex


@pytest.mark.parametrize(
    ("key", "out"),
    [
        ("000102030405060708090a0b0c0d0e0f", "69c4e0d86a7b0430d8cdb78070b4c55a"), ("000102030405060708090a0b0c0d0e0f1011121314151617", "dda97ca4864cdfe06eaf70a0ec0d7191"),
        ("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f", "8ea2b7ca516745bfeafc49904b496089"),
    ],
)
def test_blocks_of_fips_197(key, out):
    plain = H("00112233445566778899aabbccddeeff")
    assert aes.encrypt_block(H(key), plain) == H(out) and aes.decrypt_block(H(key), H(out)) == plain
    assert aes.ecb_decrypt(H(key), aes.ecb_encrypt(H(key), plain * 3)) == plain * 3


def test_chained_and_counter_modes():
    key, iv = H("2b7e151628aed2a6abf7158809cf4f3c"), H("000102030405060708090a0b0c0d0e0f")
    plain = H("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    assert aes.cbc_encrypt(key, plain, iv, pad=False)[16:] == H("7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2")
    for n in range(40):
        assert aes.cbc_decrypt(key, aes.cbc_encrypt(key, bytes(n))) == bytes(n)
    with pytest.raises(ValueError):
        aes.cbc_decrypt(key, aes.cbc_encrypt(key, b"\0" * 16, iv, pad=False))
    start = H("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff")
    assert aes.ctr(key, start[:8], plain, int.from_bytes(start[8:], "big")) == H("874d6191b620e3261bef6864990db6ce9806f66b7970fdff8617187bb9fffdff")


def test_rc4_vectors():
    assert aes.rc4(b"Key", b"Plaintext") == H("BBF316E8D940AF0AD3") and aes.rc4(b"Wiki", b"pedia") == H("1021BF0420")


@pytest.mark.parametrize(("revision", "size"), [(2, 5), (3, 16), (4, 16)])
def test_passwords_open_a_file(revision, size):
    doc_id, permissions = b"0123456789abcdef", -3904
    owner = aes.owner_entry(b"owner", b"user", revision, size)
    user = aes.user_entry(aes.file_key(b"user", owner, permissions, doc_id, revision, size), doc_id, revision)
    keys = {aes.authenticate(p, owner, user, permissions, doc_id, revision, size) for p in (b"user", b"owner")}
    assert len(keys) == 1 and None not in keys and aes.authenticate(b"other", owner, user, permissions, doc_id, revision, size) is None
    assert len(aes.object_key(keys.pop(), 7, 0, revision == 4)) == min(16, size + 5)


def test_hardened_hash_hangs_on_all_its_parts():
    a = aes.hash_r6(b"pass", b"saltsalt")
    assert len(a) == 32 and a == aes.hash_r6(b"pass", b"saltsalt") and len({a, aes.hash_r6(b"past", b"saltsalt"), aes.hash_r6(b"pass", b"saltsalu"), aes.hash_r6(b"pass", b"saltsalt", b"x")}) == 4


@pytest.mark.parametrize("text", ["plain", "Zürich • € “x”", "żółw 漢字", "", "tab\tnew\nline"])
def test_text_strings_there_and_back(text):
    assert pdftext.decode(pdftext.encode(text)) == text


def test_glyph_names_and_maps():
    names = {"A": "A", "eacute": "é", "Udieresis": "Ü", "five": "5", "uni00E9": "é", "u1F600": "😀", "f_i": "fi", "a.alt": "a", "germandbls": "ß", "nosuch": "", "zcaron": "ž"}
    assert {n: pdftext.glyph(n) for n in names} == names
    table, lengths = pdftext.to_unicode(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0058> <0059>] endbfrange")
    assert lengths == [2] and "".join(t for _, t in pdftext.decode_codes(H("000100020010001200210099"), table, lengths)) == "AfiacY�"
