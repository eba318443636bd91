"""AES block cipher modes and RC4 on bytes, and the keys of a PDF's standard security handler.

For values that come from files; columns of an application's own go through Spark's
``aes_encrypt``. The block cipher is written from FIPS 197, RC4 and the key derivations from
the file format's public description (revisions 2 to 4, and 6).
"""

from __future__ import annotations

import hashlib
import hmac
import os
from functools import lru_cache

from leafmark.functions.crypt import rc4

BLOCK = 16
#: The padding that fills passwords up to 32 bytes (fixed value).
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _double(x: int) -> int:
    return x << 1 ^ (0x11B if x & 0x80 else 0)


def _product(x: int, y: int) -> int:
    out = 0
    while y:
        out ^= x if y & 1 else 0
        x, y = _double(x), y >> 1
    return out


def _boxes() -> tuple[bytes, bytes]:
    """The substitution box and its inverse: an inverse in the field, then an affine map."""
    box = bytearray(256)
    for x in range(256):
        inverse = next((y for y in range(256) if _product(x, y) == 1), 0)
        turned = [((inverse << n | inverse >> 8 - n) & 255) for n in range(5)]
        box[x] = turned[0] ^ turned[1] ^ turned[2] ^ turned[3] ^ turned[4] ^ 0x63
    back = bytearray(256)
    for x, y in enumerate(box):
        back[y] = x
    return bytes(box), bytes(back)


_BOX, _BACK = _boxes()
_TIMES = {n: bytes(_product(x, n) for x in range(256)) for n in (2, 3, 9, 11, 13, 14)}
#: Where each byte of a state comes from when its rows are shifted, and back.
_SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
_UNSHIFT = [(i - 4 * (i % 4)) % 16 for i in range(16)]


@lru_cache(64)
def _round_keys(key: bytes) -> list[bytes]:
    if len(key) not in (16, 24, 32):
        raise ValueError("a key has 16, 24 or 32 bytes")
    n, rcon = len(key) // 4, 1
    words = [key[i : i + 4] for i in range(0, len(key), 4)]
    for i in range(n, 4 * (n + 7)):
        last = words[-1]
        if i % n == 0:
            last = bytes(_BOX[b] for b in last[1:] + last[:1])
            last = bytes([last[0] ^ rcon]) + last[1:]
            rcon = _double(rcon)
        elif n > 6 and i % n == 4:
            last = bytes(_BOX[b] for b in last)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], last, strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b, strict=False))


def _mixed(s: bytes, by: tuple[int, int, int, int]) -> bytes:
    out = bytearray(16)
    for c in range(0, 16, 4):
        for r in range(4):
            x = 0
            for k in range(4):
                n, b = by[(k - r) % 4], s[c + k]
                x ^= b if n == 1 else _TIMES[n][b]
            out[c + r] = x
    return bytes(out)


def encrypt_block(key: bytes, block: bytes) -> bytes:
    keys = _round_keys(key)
    s = _xor(block, keys[0])
    for i, k in enumerate(keys[1:], 1):
        s = bytes(_BOX[s[j]] for j in _SHIFT)
        s = _xor(s if i == len(keys) - 1 else _mixed(s, (2, 3, 1, 1)), k)
    return s


def decrypt_block(key: bytes, block: bytes) -> bytes:
    keys = _round_keys(key)
    s = _xor(block, keys[-1])
    for i in range(len(keys) - 2, -1, -1):
        s = _xor(bytes(_BACK[s[j]] for j in _UNSHIFT), keys[i])
        s = _mixed(s, (14, 11, 13, 9)) if i else s
    return s


def _blocks(data: bytes) -> list[bytes]:
    if len(data) % BLOCK:
        raise ValueError("data is no whole number of blocks")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def ecb_encrypt(key: bytes, data: bytes) -> bytes:
    return b"".join(encrypt_block(key, b) for b in _blocks(data))


def ecb_decrypt(key: bytes, data: bytes) -> bytes:
    return b"".join(decrypt_block(key, b) for b in _blocks(data))


def cbc_encrypt(key: bytes, data: bytes, iv: bytes | None = None, pad: bool = True) -> bytes:
    """The vector, then the blocks chained to it; padded to whole blocks unless told not to."""
    now = os.urandom(BLOCK) if iv is None else iv
    fill = BLOCK - len(data) % BLOCK
    out = [now]
    for b in _blocks(data + bytes([fill]) * fill if pad else data):
        now = encrypt_block(key, _xor(b, now))
        out.append(now)
    return b"".join(out)


def cbc_decrypt(key: bytes, data: bytes, pad: bool = True) -> bytes:
    """What a vector and chained blocks hold; padding that is wrong is an error."""
    blocks = _blocks(data)
    out = b"".join(_xor(decrypt_block(key, b), before) for before, b in zip(blocks, blocks[1:], strict=False))
    if not pad or not out:
        return out
    n = out[-1]
    if not 1 <= n <= BLOCK or out[-n:] != bytes([n]) * n:
        raise ValueError("wrong padding")
    return out[:-n]


def ctr(key: bytes, nonce: bytes, data: bytes, counter: int = 0) -> bytes:
    """Data under a stream of encrypted counters; the same call reads it back."""
    size = BLOCK - len(nonce)
    stream = b"".join(encrypt_block(key, nonce + ((counter + i) % (1 << 8 * size)).to_bytes(size, "big")) for i in range(-(-len(data) // BLOCK)))
    return _xor(data, stream)


# the standard security handler -----------------------------------------------------------


def padded(password: bytes) -> bytes:
    return (password + PAD)[:32]


def file_key(password: bytes, owner: bytes, permissions: int, doc_id: bytes, revision: int, size: int, metadata: bool = True) -> bytes:
    """The key of a file of revisions 2 to 4."""
    h = hashlib.md5(padded(password) + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + doc_id + (b"" if metadata or revision < 4 else b"\xff" * 4)).digest()
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h[:size]).digest()
    return h[:size]


def _rounds(key: bytes, data: bytes, order: range) -> bytes:
    for i in order:
        data = rc4(bytes(b ^ i for b in key), data)
    return data


def user_entry(key: bytes, doc_id: bytes, revision: int) -> bytes:
    """What a file stores to tell that a user's password is right."""
    if revision < 3:
        return rc4(key, PAD)
    return _rounds(key, hashlib.md5(PAD + doc_id).digest(), range(20)).ljust(32, b"\0")


def owner_key(password: bytes, revision: int, size: int) -> bytes:
    h = hashlib.md5(padded(password)).digest()
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h).digest()
    return h[:size]


def owner_entry(owner: bytes, user: bytes, revision: int, size: int) -> bytes:
    """The user's password under a key from the owner's."""
    return _rounds(owner_key(owner, revision, size), padded(user), range(20 if revision >= 3 else 1))


def user_password(entry: bytes, key: bytes, revision: int) -> bytes:
    """The user's (padded) password from the owner's entry and key."""
    return _rounds(key, entry, range(19 if revision >= 3 else 0, -1, -1))


def authenticate(password: bytes, owner: bytes, user: bytes, permissions: int, doc_id: bytes, revision: int, size: int) -> bytes | None:
    """The file's key if a password is the user's or the owner's, else None."""
    for own in (password, user_password(owner, owner_key(password, revision, size), revision)):
        key = file_key(own, owner, permissions, doc_id, revision, size)
        if hmac.compare_digest(user_entry(key, doc_id, revision)[:16], user[:16]):
            return key
    return None


def object_key(key: bytes, number: int, generation: int, aes: bool = False) -> bytes:
    """The key of one object of a file of revisions 2 to 4."""
    h = hashlib.md5(key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + (b"sAlT" if aes else b"")).digest()
    return h[: min(16, len(key) + 5)]


def hash_r6(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    """The hardened hash of revision 6: rounds of AES over the password and hashes that its own output chooses."""
    k, i, last = hashlib.sha256(password + salt + extra).digest(), 0, 0
    while i < 64 or last > i - 32:
        e = cbc_encrypt(k[:16], (password + k + extra) * 64, k[16:32], pad=False)[16:]
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        last, i = e[-1], i + 1
    return k[:32]
