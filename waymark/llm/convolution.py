"""Where blocks of integers occur again, by exact transforms modulo primes.

A block agrees with a stretch of its window if the sum of squared differences is
zero. The sums come from one product of number-theoretic transforms. They are
taken modulo primes whose product exceeds the largest possible sum, so a sum is
zero exactly if it is zero modulo each of them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Primes with a power of two in p - 1, and a generator of each.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
#: Cells of one batch of blocks.
BATCH_CELLS = 1 << 18


@lru_cache(maxsize=None)
def _roots(prime: int, generator: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a root of unity of order ``size`` and of its inverse."""
    root = pow(generator, (prime - 1) // size, prime)
    powers = np.ones((2, size // 2), np.uint64)
    for row, base in zip(powers, (root, pow(root, -1, prime))):
        done = 1
        while done < len(row):
            step = np.uint64(pow(base, done, prime))
            row[done : 2 * done] = row[: min(done, len(row) - done)] * step % np.uint64(prime)
            done *= 2
    return powers[0], powers[1]


def transform(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Each row's transform, in bit-reversed order; rows are powers of two long."""
    p, (count, size) = np.uint64(prime), rows.shape
    powers, _ = _roots(prime, generator, size) if size > 1 else (None, None)
    half = size // 2
    while half:
        pairs = rows.reshape(count, -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        out = np.empty_like(pairs)
        out[:, :, 0] = (low + high) % p
        out[:, :, 1] = (low + p - high) * powers[:: size // (2 * half)] % p
        rows, half = out, half // 2
    return rows.reshape(count, size)


def restored(rows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The rows whose transforms, in bit-reversed order, are given."""
    p, (count, size) = np.uint64(prime), rows.shape
    _, powers = _roots(prime, generator, size) if size > 1 else (None, None)
    half = 1
    while half < size:
        pairs = rows.reshape(count, -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1] * powers[:: size // (2 * half)] % p
        out = np.empty_like(pairs)
        out[:, :, 0] = (low + high) % p
        out[:, :, 1] = (low + p - high) % p
        rows, half = out, half * 2
    return rows.reshape(count, size) * np.uint64(pow(size, -1, prime)) % p


def agreeing(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether block ``k`` equals its window from each of its first positions.

    ``blocks`` has b columns, ``windows`` 2b; the answer has b, one for each
    shift below b. Values must not be negative.
    """
    b = blocks.shape[1]
    most = b * int(max(blocks.max(), windows.max())) ** 2
    squares = np.cumsum(windows.astype(object if most >= 1 << 62 else np.int64) ** 2, axis=1)
    squares = np.concatenate([np.zeros_like(squares[:, :1]), squares], axis=1)
    total = squares[:, b : 2 * b] - squares[:, :b]
    total = total + (blocks.astype(total.dtype) ** 2).sum(axis=1, keepdims=True)
    zero, product = np.ones((len(blocks), b), bool), 1
    reversed_ = np.zeros_like(windows, dtype=np.uint64)
    reversed_[:, :b] = blocks[:, ::-1]
    for prime, generator in PRIMES:
        p = np.uint64(prime)
        cross = restored(
            transform(reversed_ % p, prime, generator)
            * transform(windows.astype(np.uint64) % p, prime, generator)
            % p,
            prime,
            generator,
        )[:, b - 1 : 2 * b - 1]
        zero &= (total % prime).astype(np.uint64) == cross * np.uint64(2) % p
        product *= prime
        if product > most:
            return zero
    raise ValueError("The values are too large for the primes.")


def recurrences(values: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and distances, from b to 2b - 1, at which aligned blocks recur.

    ``values`` are integers of 1 or more.
    """
    n = len(values)
    count = n // b
    padded = np.zeros((count + 2) * b, np.int64)
    padded[: min(n, len(padded))] = values[: len(padded)]
    cells = np.lib.stride_tricks.sliding_window_view(padded, 3 * b)[::b]
    starts, distances = [], []
    step = max(1, BATCH_CELLS // (2 * b))
    for at in range(0, count, step):
        part = cells[at : min(at + step, count)]
        block, shift = np.nonzero(agreeing(part[:, :b], part[:, b:]))
        starts.append((block + at) * b)
        distances.append(shift + b)
    return np.concatenate(starts), np.concatenate(distances)
