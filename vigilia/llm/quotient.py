"""Counting quotient filters over packed n-grams of 64-bit word ids.

A key is two or three words of 64 bits. An invertible permutation spreads keys
evenly; its top bits are the quotient, the rest is kept as the remainder in full,
so nothing is lost and the n-gram can be read back. A filter holds, in key order,
a bit for every quotient that occurs, a bit for the end of every run of
remainders of one quotient, the remainders, and counters of one byte with an
escape for larger ones. Filters are sorted, so they are merged by one pass.
"""

from __future__ import annotations

import numpy as np

from vigilia.llm.arrays import U, mix

_ROUNDS = 4
_KEYS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)]


def _round(others: list[np.ndarray], r: int) -> np.ndarray:
    out = mix(others[0] + _KEYS[r])
    for x in others[1:]:
        out = mix(out ^ x)
    return out


def permute(lanes: list[np.ndarray]) -> list[np.ndarray]:
    """The lanes after rounds that change one lane by the others."""
    lanes = list(lanes)
    for r in range(_ROUNDS):
        i = (r + 1) % len(lanes)
        lanes[i] = lanes[i] ^ _round(lanes[:i] + lanes[i + 1:], r)
    return lanes


def restore(lanes: list[np.ndarray]) -> list[np.ndarray]:
    """What `permute` was given."""
    lanes = list(lanes)
    for r in range(_ROUNDS - 1, -1, -1):
        i = (r + 1) % len(lanes)
        lanes[i] = lanes[i] ^ _round(lanes[:i] + lanes[i + 1:], r)
    return lanes


def counted(lanes: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys sorted, each once, with its count."""
    n = len(lanes[0])
    counts = np.ones(n, np.int64) if counts is None else counts
    if not n:
        return lanes, counts
    order = np.argsort(lanes[0], kind="stable")
    sorted_ = [x[order] for x in lanes]
    same = sorted_[0][1:] == sorted_[0][:-1]
    differs = np.zeros(n - 1, dtype=bool)
    for x in sorted_[1:]:
        differs |= x[1:] != x[:-1]
    if (same & differs).any():  # first lanes that agree by chance
        order = np.lexsort(lanes[::-1])
        sorted_ = [x[order] for x in lanes]
        same = sorted_[0][1:] == sorted_[0][:-1]
        differs = np.zeros(n - 1, dtype=bool)
        for x in sorted_[1:]:
            differs |= x[1:] != x[:-1]
    first = np.flatnonzero(np.concatenate(([True], ~same | differs)))
    return [x[first] for x in sorted_], np.add.reduceat(counts[order], first)


def merged(parts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Filters' keys in one order, counts of equal keys added."""
    if len(parts) == 1:
        return parts[0]
    return counted([np.concatenate(x) for x in zip(*(p[0] for p in parts))], np.concatenate([p[1] for p in parts]))


def packed(lanes: list[np.ndarray], counts: np.ndarray, shared: int) -> bytes:
    """The filter of sorted distinct keys whose first ``shared`` bits agree."""
    n = len(counts)
    q = min(max(n.bit_length() - 1, 1), 24, 63 - shared)
    body = lanes[0] << U(shared) if shared else lanes[0]
    quotient = (body >> U(64 - q)).astype(np.int64)
    rest = (body << U(q)) >> U(q + shared)  # the low bits, unmoved
    width = -(-(64 - q - shared) // 8)
    ends = np.append(quotient[1:] != quotient[:-1], True)
    occupied = np.zeros(1 << q, dtype=bool)
    occupied[quotient] = True
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255]
    head = np.array([n, q, len(large)], "<i8").tobytes()
    low = np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width])
    return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), low.tobytes(),
                     *[x.astype("<u8").tobytes() for x in lanes[1:]], small.tobytes(), large.astype("<i8").tobytes()])


def unpacked(blob: bytes, words: int, prefix: int, shared: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted keys and counts of a filter; ``prefix`` is the keys' first ``shared`` bits."""
    n, q, escapes = (int(x) for x in np.frombuffer(blob, "<i8", 3))
    at = 24

    def take(size: int, kind) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, size, at)
        at += out.nbytes
        return out

    occupied = np.unpackbits(take(-(-(1 << q) // 8), np.uint8), count=1 << q)
    ends = np.unpackbits(take(-(-n // 8), np.uint8), count=n)
    width = -(-(64 - q - shared) // 8)
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = take(n * width, np.uint8).reshape(n, width)
    quotient = np.flatnonzero(occupied)[np.cumsum(ends) - ends]
    first = low.view("<u8").ravel().astype(U) | (quotient.astype(U) << U(64 - q - shared))
    if shared:
        first |= U(prefix) << U(64 - shared)
    others = [take(n, "<u8").astype(U) for _ in range(words - 1)]
    counts = take(n, np.uint8).astype(np.int64)
    counts[counts == 255] = take(escapes, "<i8")
    return [first, *others], counts
