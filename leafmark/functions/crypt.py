"""Ciphers for stored profiles that Spark's own functions lack (RFC 8439, RC4), as functions on bytes.

AES is left to Spark: ``aes_encrypt`` and ``aes_decrypt``.
"""

from __future__ import annotations

import hashlib
import hmac
import struct

import numpy as np


def derive_key(password: bytes, salt: bytes, n: int = 2**14, r: int = 8, p: int = 1, length: int = 32) -> bytes:
    return hashlib.scrypt(password, salt=salt, n=n, r=r, p=p, dklen=length, maxmem=64 * 1024 * 1024)


def _quarter(s: np.ndarray, a: int, b: int, c: int, d: int) -> None:
    for x, y, z, turn in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
        s[x] += s[y]
        s[z] ^= s[x]
        s[z] = s[z] << np.uint32(turn) | s[z] >> np.uint32(32 - turn)


def chacha20(key: bytes, nonce: bytes, data: bytes, counter: int = 1) -> bytes:
    """The keystream of all blocks at once, over the data."""
    blocks = -(-len(data) // 64)
    head = np.array(struct.unpack("<4I", b"expand 32-byte k") + struct.unpack("<8I", key), np.uint32)
    start = np.empty((16, blocks), np.uint32)
    start[:12] = head[:, None]
    start[12] = (counter + np.arange(blocks)) & 0xFFFFFFFF
    start[13:] = np.array(struct.unpack("<3I", nonce), np.uint32)[:, None]
    s = start.copy()
    for _ in range(10):
        for a, b, c, d in ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)):
            _quarter(s, a, b, c, d)
    stream = (s + start).T.astype("<u4").tobytes()[: len(data)]
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(stream, np.uint8)).tobytes()


def poly1305(key: bytes, message: bytes) -> bytes:
    r = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
    total = 0
    for i in range(0, len(message), 16):
        total = (total + int.from_bytes(message[i : i + 16] + b"\x01", "little")) * r % ((1 << 130) - 5)
    return ((total + int.from_bytes(key[16:], "little")) & ((1 << 128) - 1)).to_bytes(16, "little")


def _tag(key: bytes, nonce: bytes, sealed: bytes, aad: bytes) -> bytes:
    pad = lambda b: b + bytes(-len(b) % 16)
    return poly1305(chacha20(key, nonce, bytes(32), 0), pad(aad) + pad(sealed) + struct.pack("<QQ", len(aad), len(sealed)))


def seal(key: bytes, nonce: bytes, plain: bytes, aad: bytes = b"") -> bytes:
    """ChaCha20-Poly1305: the ciphertext and its 16-byte tag."""
    sealed = chacha20(key, nonce, plain)
    return sealed + _tag(key, nonce, sealed, aad)


def unseal(key: bytes, nonce: bytes, data: bytes, aad: bytes = b"") -> bytes:
    """The plaintext; ValueError if the tag is wrong."""
    sealed, tag = data[:-16], data[-16:]
    if not hmac.compare_digest(tag, _tag(key, nonce, sealed, aad)):
        raise ValueError("wrong key or altered data")
    return chacha20(key, nonce, sealed)


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)
