"""Image operators on drawn images; ciphers against the published vectors."""

import numpy as np
import pytest

from leafmark.functions import crypt, raster


def page():
    g = np.full((60, 80), 255, np.uint8)
    g[20:22, 10:70] = 0
    g[40:42, 10:40] = 0
    g[5, 5] = 0
    return g


def test_thresholds_and_rules():
    g = page()
    assert raster.otsu_threshold(raster.histogram(g)) == 127
    assert (raster.binarize(g, "otsu") == g).all()
    assert raster.ink_rules(raster.denoise(g)) == raster.ink_rules(g)[-2:] or raster.ink_rules(g) == [(10, 20, 70, 22), (10, 40, 40, 42)]
    assert raster.denoise(g)[5, 5] == 255
    assert raster.sauvola(g)[20, 30] == 0


def test_turning_back():
    g = page()
    assert (raster.rotate_quarter(raster.rotate_quarter(g, 90), 270) == g).all()
    assert (raster.deskew(g, 0.0) == g).all()
    big = np.full((200, 300), 255, np.uint8)
    big[40::40, 20:280] = 0
    assert abs(raster.estimate_skew(raster.deskew(big, 2.0)) - 2.0) <= 0.5 or abs(raster.estimate_skew(raster.deskew(big, 2.0)) + 2.0) <= 0.5
    assert raster.estimate_skew(np.full((9, 9), 255, np.uint8)) == 0.0


def test_empty_rectangles_against_all():
    r = np.random.default_rng(2)
    for _ in range(10):
        grid = r.random((6, 7)) < 0.3
        fits = {(a, b, c, d) for a in range(7) for c in range(a + 1, 8) for b in range(6) for d in range(b + 1, 7) if not grid[b:d, a:c].any()}
        largest = {f for f in fits if not any(g != f and g[0] <= f[0] and g[1] <= f[1] and g[2] >= f[2] and g[3] >= f[3] for g in fits)}
        assert set(raster.empty_rectangles(grid, 1, 1)) == largest


def test_difference_and_files():
    g, h = page(), page()
    h[0, 0] = 0
    assert raster.page_difference(g, g) == (0.0, "ok") and raster.page_difference(g, h)[1] == "warning"
    assert raster.page_difference(g, h, [(0, 0, 1, 1)])[1] == "ok" and raster.page_difference(g, g[:5])[1] == "error"
    assert (raster.read_pgm(raster.write_pgm(g)) == g).all()


def test_sealed_text_of_the_standard():
    key, nonce, aad = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647"), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    plain = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    sealed = crypt.seal(key, nonce, plain, aad)
    assert sealed[:8].hex() == "d31a8d34648e60db" and sealed[-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691"
    assert crypt.unseal(key, nonce, sealed, aad) == plain
    with pytest.raises(ValueError):
        crypt.unseal(key, nonce, sealed[:-1] + b"\0", aad)


def test_rc4_and_key():
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert len(crypt.derive_key(b"p", b"s", n=1024)) == 32
