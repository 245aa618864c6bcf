import numpy as np
import pytest

from tramline.llm import webp as W

rng = np.random.default_rng(5)


def image(h, w, colours=256):
    return rng.integers(0, colours, (h, w, 4)).astype(np.uint8)


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (17, 9), (8, 33)])
@pytest.mark.parametrize("cache_bits", [0, 1, 6])
@pytest.mark.parametrize("references", [False, True])
def test_round_trip_of_codes_cache_and_references(shape, cache_bits, references):
    for colours in (1, 2, 3, 200):
        x = image(*shape, colours)
        assert (W.decode(W.encode(x, (), cache_bits, references)) == x).all()


def test_references_and_cache_are_used():
    x = np.tile(image(1, 8), (90, 1, 1))
    plain, short = W.encode(x), W.encode(x, references=True)
    assert len(short) < len(plain) / 3 and (W.decode(short) == x).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor_modes(mode):
    x = image(11, 13)
    modes = np.full((3, 4), mode)
    assert (W.decode(W.encode(x, (("predictor", 2, modes),))) == x).all()


def test_transforms_together():
    x = image(10, 21)
    every = (("predictor", 3, rng.integers(0, 14, (2, 3))), ("cross", 2, image(3, 6)), ("subtract",))
    for n in range(4):
        assert (W.decode(W.encode(x, every[:n], 4, True)) == x).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 16, 17, 256])
def test_palettes(colours):
    table = image(1, colours)[0]
    x = table[rng.integers(0, colours, (7, 19))]
    for arrays in (False, True):
        assert (W.decode(W.encode(x, (("palette",),), arrays=arrays)) == x).all()


def test_known_prediction_by_hand():
    # one block, mode 12 (left + top - corner, cut to 0..255) on a 2 x 2 image
    x = np.array([[[10, 20, 30, 255], [200, 0, 5, 255]], [[100, 250, 7, 255], [1, 2, 3, 255]]], np.uint8)
    left = W.predictions(x, np.array([[12]]), 2, False)
    assert left[0, 0].tolist() == [10, 20, 30, 0]
    assert left[0, 1].tolist() == [190, (0 - 20) & 255, (5 - 30) & 255, 0]
    assert left[1, 0].tolist() == [90, 230, (7 - 30) & 255, 0]
    assert left[1, 1].tolist() == [(1 - 255) & 255, (2 - 230) & 255, (3 - 0) & 255, 0]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 5000, 64 * 16384 + 1])
def test_payload_round_trip(n):
    text = bytes(rng.integers(97, 123, n).astype(np.uint8))
    p = W.payload_of(text)
    assert len(p) % 64 == 0 and len(p) >= 64 and p.rstrip(b"\0") == text
    assert W.decode(W.stored(p)).tobytes()[: len(p)] == p


def test_repetitive_payload_makes_a_small_palette_image():
    p = W.payload_of(b"La La La La " * 3000)
    s = W.stored(p)
    assert len(s) < len(p) / 8 and W.decode(s).tobytes()[: len(p)] == p


BUILD = W.Code.__init__


def plain_only(self, lengths):
    BUILD(self, lengths)
    self.fixed = None


def test_array_and_plain_decoders_agree(monkeypatch):
    x = image(40, 16, 30)
    data = W.encode(x, arrays=True)
    one = W.decode(data)
    monkeypatch.setattr(W.Code, "__init__", plain_only)
    assert (W.decode(data) == x).all()
    assert (one == x).all()


def test_no_image():
    for bad in (b"", b"RIFF", b"x" * 40, W.encode(image(4, 4))[:30]):
        with pytest.raises((ValueError, IndexError)):
            W.decode(bad)
