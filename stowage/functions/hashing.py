"""Name hashes and the stream cipher, vectorised over Arrow batches with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_U32 = np.uint32
#: Fixed values of the published lookup3 hash: rotations of its mixing and its final step.
MIX, FINAL, SEED = (4, 6, 8, 16, 19, 4), (14, 11, 25, 16, 4, 14, 24), 0xDEADBEEF
#: Places of the matrix that make up its four columns, and its four rows, each from the diagonal on.
_COLUMNS = [[(5 * i + 4 * j) % 16 for i in range(4)] for j in range(4)]
_ROWS = [[4 * i + (i + j) % 4 for i in range(4)] for j in range(4)]


def _rot(x: np.ndarray, k: int) -> np.ndarray:
    return (x << _U32(k)) | (x >> _U32(32 - k))


def name_hashes(names: list[bytes]) -> np.ndarray:
    """The 64-bit hash of every name: slashes back, ASCII letters upper-case, lookup3 over 12-byte blocks, (c << 32) | b.

    Names of as many blocks are hashed together, block by block.
    """
    out = np.zeros(len(names), np.uint64)
    names = [n.replace(b"/", b"\\").upper() for n in names]
    blocks = np.array([-(-len(n) // 12) for n in names], np.int64)
    for count in np.unique(blocks):
        rows = np.flatnonzero(blocks == count)
        start = np.array([(SEED + len(names[r])) & 0xFFFFFFFF for r in rows], _U32)
        state = [start.copy(), start.copy(), start.copy()]  # a, b, c
        if count:
            data = np.frombuffer(b"".join(names[r].ljust(12 * count, b"\0") for r in rows), "<u4").reshape(len(rows), count, 3)
            for k in range(count):
                for j in range(3):
                    state[j] += data[:, k, j]
                if k < count - 1:
                    # each step: x -= z; x ^= rot(z); z += y, going round (a, c, b)
                    for step, turn in enumerate(MIX):
                        x, z, y = (step) % 3, (step + 2) % 3, (step + 1) % 3
                        state[x] -= state[z]
                        state[x] ^= _rot(state[z], turn)
                        state[z] += state[y]
                else:
                    # each step: x ^= y; x -= rot(y), going round (c, b), (a, c), (b, a)
                    for step, turn in enumerate(FINAL):
                        x, y = (step + 2) % 3, (step + 1) % 3
                        state[x] ^= state[y]
                        state[x] -= _rot(state[y], turn)
        out[rows] = state[2].astype(np.uint64) << np.uint64(32) | state[1].astype(np.uint64)
    return out


def name_hash_py(name: str) -> int:
    """One name's hash as the signed 64-bit integer that tables hold."""
    return int(name_hashes([name.encode()]).view(np.int64)[0])


def name_hash(path: Column) -> Column:
    """The name hash of a string column as a signed 64-bit integer; null stays null."""

    @F.pandas_udf("bigint")
    def hashed(names: pd.Series) -> pd.Series:
        known = names.notna()
        out = pd.Series([None] * len(names), dtype="Int64")
        out[known.to_numpy()] = name_hashes([n.encode() for n in names[known]]).view(np.int64)
        return out

    return hashed(path)


def salsa20(key: bytes, nonce: bytes, data: bytes) -> bytes:
    """data under Salsa20/20's key stream (16- or 32-byte key, 8-byte nonce, counter from 0), all blocks at once."""
    if len(key) not in (16, 32) or len(nonce) != 8:
        raise ValueError("a key of 16 or 32 bytes and a nonce of 8 are needed")
    constants = np.frombuffer(b"expand 32-byte k" if len(key) == 32 else b"expand 16-byte k", "<u4")
    k0, k1, n = np.frombuffer(key[:16], "<u4"), np.frombuffer(key[-16:], "<u4"), np.frombuffer(nonce, "<u4")
    blocks = -(-len(data) // 64)
    counter = np.arange(blocks, dtype=np.uint64)
    first = np.empty((16, blocks), _U32)
    for at, words in ((0, constants[:1]), (1, k0), (5, constants[1:2]), (6, n), (10, constants[2:3]), (11, k1), (15, constants[3:])):
        first[at : at + len(words)] = words[:, None]
    first[8], first[9] = counter.astype(_U32), (counter >> np.uint64(32)).astype(_U32)
    x = first.copy()
    for _ in range(10):
        for a, b, c, d in (_COLUMNS, _ROWS):  # four quarter rounds at once
            own = [x[k] for k in (a, b, c, d)]
            for step, turn in enumerate((7, 9, 13, 18), 1):
                own[step % 4] ^= _rot(own[step - 1] + own[step - 2], turn)
            for k, v in zip((a, b, c, d), own, strict=True):
                x[k] = v
    stream = (x + first).T.astype("<u4").tobytes()
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(stream[: len(data)], np.uint8)).tobytes()
