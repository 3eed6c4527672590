"""Word shingles as hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bits of a SimHash, and shingle hashes whose bits are counted at a time.
BITS, CHUNK = 64, 1 << 16


def normal_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(found: list[bytes], words: int) -> np.ndarray:
    """XXH64 values (seed 42) of all shingles in turn; fewer words than a shingle takes give one, none give none."""
    if not found:
        return np.zeros(0, "<u8")
    flat, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(flat, 42)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1]
    return np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)), "<u8", len(starts))


def majority(hashes: np.ndarray) -> int:
    """SimHash: the bits set in over half of the hashes; one hash is its own, none give 0."""
    if len(hashes) <= 1:
        return int(hashes.sum())
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])
