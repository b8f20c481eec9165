"""Shingle sets of whole texts: their similarity, a lower bound on how much two differ, and prefixes that must meet."""

from __future__ import annotations

import numpy as np

#: Words per shingle, least similarity, and the hash's seed.
SHINGLE, LEAST, SEED = 5, 0.8, 42
#: Fewest and most bits of a set's parities.
FEWEST, MOST = 512, 1 << 16


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased, parted by ASCII white space: exactly bytes.split() and bytes.lower()."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of a text, in their order."""
    from xxhash import xxh64_intdigest as hashed

    words = words_of(text) if text else []
    return np.fromiter((hashed(w, SEED) for w in words), np.uint64, len(words))


def in_order(own: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """The hash of the shingle at each place of a text whose words have these hashes."""
    n = max(1, len(own) - width + 1) if len(own) else 0
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(own))):
        h = (h ^ own[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; a text of fewer words is one shingle, one without words has none."""
    return np.unique(in_order(word_hashes(text), width))


def looked_up(own: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The numbers of hashes in a table (sorted hashes, numbers); 0 for those that it hasn't."""
    if not len(known[0]):
        return np.zeros(len(own), np.int64)
    at = np.searchsorted(known[0], own)
    at[at == len(known[0])] = 0
    return np.where(known[0][at] == own, known[1][at], 0)


def among(own: np.ndarray, known: np.ndarray) -> np.ndarray:
    """np.isin() of sorted `known`, which a few hashes at a time needn't sort again."""
    return looked_up(own, (known, np.ones(len(known), np.int64))) > 0


def weighed_set(text: str | None, words: tuple[np.ndarray, np.ndarray], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """shingle_set(), and for each shingle the sum of its words' weights, which words (sorted hashes, whole numbers) gives."""
    own = word_hashes(text)
    s, at = np.unique(in_order(own, width), return_index=True)
    sums = np.append(0, np.cumsum(looked_up(own, words)))
    return s, sums[np.minimum(at + width, len(own))] - sums[at]


def similar(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard similarity of two shingle sets; that of two empty ones is 1."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def prefix(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float = LEAST, weights: np.ndarray | int = 0) -> np.ndarray:
    """The first shingles of a set in one order of all shingles, uncommon ones first: two sets of n and m shingles whose
    similarity is at least `least` share least * n, so among the first n - ceil(least * n) + 1 of each is a shared one.
    The order is by count in common, then by weight, then by hash; all three must follow from the shingle alone."""
    n = len(own)
    return own[np.lexsort((own, np.broadcast_to(weights, n), looked_up(own, common)))][: n - int(np.ceil(least * n - 1e-9)) + 1]


def parities(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles fall on each of 2 to 4 times as many bits, as 64-bit words: two sets
    differ in at least as many shingles as these bits, and in few more if they are similar."""
    size = min(MOST, max(FEWEST, 1 << (2 * len(own) - 1).bit_length())) if len(own) else FEWEST
    odd = np.bincount((own % np.uint64(size)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities over fewer bits: halves (of the last axis) laid on each other until there are `words` words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For parities in rows of x and of y: a matrix of how many bits differ, over the fewer bits of both."""
    words = min(x.shape[-1], y.shape[-1])
    return np.bitwise_count(folded(x, words)[:, None] ^ folded(y, words)[None]).sum(axis=2, dtype=np.int64)


def may_be(n, m, differ, least: float = LEAST):
    """Whether sets of n and m shingles, which differ in `differ` at least, can be similar enough."""
    return (differ <= (n + m) * ((1 - least) / (1 + least)) + 1e-6) & (n >= least * m - 1e-6) & (m >= least * n - 1e-6)


def partners(out: dict[str, np.ndarray], held: dict[str, np.ndarray], bits: list[np.ndarray], others: list[np.ndarray], lo: int, hi: int, least: float = LEAST, most: int = 16 << 20) -> tuple[list[tuple[int, int]], bool]:
    """Pairs (of out, of held) that may be similar and have different roots, and whether any are left for later.

    For each of out, those of held that may be similar are ranked by how many bits differ (then by their place); ranks
    from lo up to hi, exclusive, are given. Both have h, n and root; bits and others are their parities. A pair whose
    held side has `out` set is seen from both sides: it counts where its first is the smaller.
    """
    found, more = [], False
    lengths, sizes = np.array([len(x) for x in others]), np.array([len(x) for x in bits])
    stacked = {int(w): (np.flatnonzero(lengths == w), np.stack([x for x in others if len(x) == w])) for w in np.unique(lengths)}
    for own in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == own)
        step = max(1, most // (8 * own * max(1, len(others))))
        for a in range(0, len(mine), step):
            rows = mine[a : a + step]
            x = np.stack([bits[k] for k in rows])
            differ = np.full((len(rows), len(others)), 1 << 40, np.int64)
            for w, (at, y) in stacked.items():
                if own // 2 <= w <= own * 2:
                    differ[:, at] = differing(x, y)
            fits = may_be(out["n"][rows][:, None], held["n"][None], differ, least)
            fits &= ~held["out"][None] | (out["h"][rows][:, None] < held["h"][None])
            new = out["root"][rows][:, None] != held["root"][None]
            for r in np.flatnonzero((fits & new).any(axis=1)):
                at = np.flatnonzero(fits[r])
                at = at[np.argsort(differ[r, at], kind="stable")]
                now, later = at[lo:hi], at[hi:]
                more |= bool(new[r, later].any())
                found += [(int(rows[r]), int(k)) for k in now[new[r, now]]]
    return found, more
