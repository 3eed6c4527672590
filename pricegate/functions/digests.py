"""MD5 of many texts at once: the first four bytes, in NumPy, where a digest has to be worked out for every row and draw."""

from __future__ import annotations

import math

import numpy as np

#: MD5 as RFC 1321 has it: the state it starts from, and each step's constant, left shift and word.
START = [np.full((1, 1), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
SHIFTS = [np.uint32(x) for turn in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in turn * 4]
WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
ZERO = np.zeros((1, 1), np.uint32)
#: Numbers of an array that steps work on; fewer cost calls, more leave the caches.
AT_ONCE = 49_152


def _steps(state: list[np.ndarray], words: list[np.ndarray], shape: tuple[int, int], steps: int) -> list[np.ndarray]:
    """A block's first steps. Words are arrays that broadcast to ``shape``; until the first that differs by column, steps are worked out by row only."""
    a, b, c, d = state
    first = 0 if b.shape == shape else next((k for k in range(16) if words[k].shape[1] > 1), steps)
    for i in range(first):
        f = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
        t = f + a + (words[WORDS[i]] + SINES[i])
        a, d, c, b = d, c, b, b + ((t << SHIFTS[i]) | (t >> (32 - SHIFTS[i])))
    if first == steps:
        return [a, b, c, d]
    a, b, c, d = (np.broadcast_to(x, shape).copy() for x in (a, b, c, d))
    t, u = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(first, steps):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i >= 48:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i % 2 == 0:
            np.bitwise_xor(b, c, out=u)
            np.bitwise_xor(u, d, out=t)
        else:
            np.bitwise_xor(b, u, out=t)  # u is this step's c ^ d
        np.add(t, a, out=t)
        word = words[WORDS[i]]
        if word.shape == shape:
            np.add(t, word, out=t)
            np.add(t, SINES[i], out=t)
        else:
            np.add(t, word + SINES[i], out=t)
        np.left_shift(t, SHIFTS[i], out=a)
        np.right_shift(t, 32 - SHIFTS[i], out=t)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, d, c, b = d, c, b, a
    return [a, b, c, d]


def _digests(prefixes: np.ndarray, suffixes: np.ndarray, filled: int) -> np.ndarray:
    """The digests' first words, from the words of both parts, of which prefixes fill the first ``filled`` ones."""
    shape, state, used = (len(prefixes), suffixes.shape[1]), START, suffixes.any(axis=1)
    words = []
    for k in range(len(suffixes)):
        mine, other = prefixes[:, k : k + 1], suffixes[k][None, :]
        words.append(mine | other if k < filled and used[k] else mine if k < filled else other if used[k] else ZERO)
    for k in range(0, len(words) - 16, 16):
        state = [x + y for x, y in zip(state, _steps(state, words[k : k + 16], shape, 64), strict=True)]
    return state[0] + _steps(state, words[-16:], shape, 61)[1]  # the last three steps change the other words only


def first_words(prefixes: list[bytes], suffixes: list[bytes]) -> np.ndarray:
    """The first eight hexadecimal digits of MD5, as a number, of every prefix followed by every suffix."""
    out = np.empty((len(prefixes), len(suffixes)), np.uint32)
    before, after = np.array([len(x) for x in prefixes], np.int64), np.array([len(x) for x in suffixes], np.int64)
    longest = int(after.max(initial=0)) + 1
    marked = np.frombuffer(b"".join((x + b"\x80").ljust(longest, b"\0") for x in suffixes), np.uint8).reshape(-1, longest)
    for n in np.unique(before).tolist():
        rows, blocks = np.flatnonzero(before == n), (n + after + 8) // 64 + 1
        for size in np.unique(blocks).tolist():
            columns = np.flatnonzero(blocks == size)
            head = np.frombuffer(b"".join(prefixes[r].ljust(64 * size, b"\0") for r in rows), "<u4").reshape(len(rows), -1)
            tail, used = np.zeros((len(columns), 64 * size), np.uint8), int(after[columns].max()) + 1
            tail[:, n : n + used] = marked[columns, :used]
            tail[:, -8:] = (8 * (n + after[columns])).astype("<u8").view(np.uint8).reshape(-1, 8)
            tail = np.ascontiguousarray(tail.view("<u4").T)
            step = max(1, AT_ONCE // len(columns))
            for k in range(0, len(rows), step):
                found = _digests(head[k : k + step], tail, -(-n // 4)).byteswap()
                if len(columns) == len(suffixes):
                    out[rows[k : k + step]] = found
                else:
                    out[rows[k : k + step, None], columns] = found
    return out
