import random

import pytest

from stowage.functions import bitknit
from stowage.sources import formats


def samples():
    rng = random.Random(1)
    yield b"a"
    yield b"abcd" * 30
    yield bytes(rng.randrange(256) for _ in range(5000))
    yield bytes(rng.choice(b"abcde ") for _ in range(70_000))
    yield b"".join(rng.choice([b"vertex", b"normal", b"\0\0\0\0", bytes([rng.randrange(256)])]) for _ in range(30_000))
    yield bytes(200_000)
    yield bytes(k * k >> 7 & 255 for k in range(66_000))


def test_round_trip():
    coded = 0
    for data in samples():
        packed = bitknit.encode(data)
        coded += len(packed) < 0.8 * len(data)  # the coded form, not plain quanta
        assert bitknit.decode(packed, len(data)) == data
    assert coded >= 3  # short and random samples stay plain


def test_plain_quantum_and_damage():
    data = bytes(range(256)) * 3
    assert bitknit.decode(b"\xb1\x75\0\0" + data, len(data)) == data
    for bad in (b"", b"\0\0", b"\xb1\x75", b"\xb1\x75\0\0" + data[:-1]):
        with pytest.raises(formats.Malformed):
            bitknit.decode(bad, len(data))
    rng = random.Random(2)
    good = bitknit.encode(b"some text that repeats, some text that repeats " * 100)
    for _ in range(200):
        broken = bytearray(good)
        broken[rng.randrange(len(broken))] ^= 1 << rng.randrange(8)
        bitknit.check(bytes(broken), 4700)


def test_models_stay_whole():
    rng = random.Random(3)
    for size, rare in (bitknit.COMMANDS, bitknit.RECENT, bitknit.LENGTHS):
        m = bitknit.Model(size, rare)
        for _ in range(20_000):
            m.observe(min(size - 1, int(rng.expovariate(0.3))))
        assert m.sums[0] == 0 and m.sums[-1] == 1 << 15 and all(a < b for a, b in zip(m.sums, m.sums[1:], strict=False))
        assert all(m.symbol(c) == next(k for k in range(size) if c < m.sums[k + 1]) for c in range(0, 1 << 15, 97))
