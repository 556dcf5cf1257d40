"""Arithmetic modulo 2^255 - 19 and sums of points of Ed25519 for many rows at once, with NumPy.

A number is ten limbs of 26 bits in int64; arrays are (10, ...) with a column for each row.
Limbs may be negative or a little over 26 bits: sums and differences of two numbers, and of twice
one and another, may be multiplied without a carry, as ten products of them stay below 2^60.
"""

from __future__ import annotations

import numpy as np

P = 2**255 - 19
LIMBS, BITS = 10, 26
MASK = (1 << BITS) - 1
#: What 2^260 is modulo P.
WRAP = 19 << 5
#: Rows that are summed together, in some 5 MB.
ROWS = 2048


def limbs(values: list[int]) -> np.ndarray:
    """(10, n) of numbers below 2^256."""
    raw = np.frombuffer(b"".join(v.to_bytes(33, "little") for v in values), np.uint8).reshape(-1, 33)
    bits = np.unpackbits(raw, axis=1, count=LIMBS * BITS, bitorder="little").reshape(-1, LIMBS, BITS)
    return np.ascontiguousarray((bits @ (1 << np.arange(BITS))).T)


def room(*shape: int) -> tuple[np.ndarray, np.ndarray]:
    """What a product of numbers of a shape is made in. Arrays that are made anew for each product cost more than the product."""
    return np.empty((2 * LIMBS, *shape), np.int64), np.empty((LIMBS, *shape), np.int64)


def product(a: np.ndarray, b: np.ndarray, made_in: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """a b. With ``made_in`` (``room``) it stays there until the next product in it."""
    out, part = made_in or room(*b.shape[1:])
    low, high = out[:LIMBS], out[LIMBS:]
    np.multiply(a[0], b, out=low)
    high[:] = 0
    for i in range(1, LIMBS):
        np.multiply(a[i], b, out=part)
        out[i : i + LIMBS] += part
    # else what wraps would pass 63 bits; the last limb has room for its carries
    over = np.right_shift(high[:-1], BITS, out=part[:-1])
    high[:-1] &= MASK
    high[1:] += over
    high *= WRAP
    low += high
    for _ in range(2):
        over = np.right_shift(low, BITS, out=part)
        low &= MASK
        low[1:] += over[:-1]
        over[-1] *= WRAP
        low[0] += over[-1]
    return low


def inverses(z: np.ndarray) -> np.ndarray:
    """1 / z for (10, n), none of them 0; all take one power."""
    n = z.shape[1]
    if n == 1:
        return limbs([pow(number(z[:, 0]), P - 2, P)])
    half = n // 2
    left, right = z[:, :half], z[:, half : 2 * half]
    below = inverses(np.concatenate([product(left, right), z[:, 2 * half :]], axis=1))
    both = below[:, :half]
    return np.concatenate([product(both, right), product(both, left), below[:, half:]], axis=1)


def number(x: np.ndarray) -> int:
    """The least number that ten limbs stand for."""
    return sum(int(v) << (BITS * i) for i, v in enumerate(x)) % P


def _least(x: np.ndarray) -> np.ndarray:
    """(10, n) with limbs of 26 bits, 255 bits in all, below P."""
    x = x.copy()

    def settle() -> None:
        for i in range(LIMBS - 1):
            x[i + 1] += x[i] >> BITS
            x[i] &= MASK

    for _ in range(3):
        settle()
        x[0] += 19 * (x[-1] >> 21)
        x[-1] &= (1 << 21) - 1
    settle()
    # from P on a number and 19 reach 2^255
    x[0] += 19
    settle()
    reached = x[-1] >> 21
    x[-1] &= (1 << 21) - 1
    x[0] -= 19 * (1 - reached)
    settle()
    return x


def encoded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(n, 32) bytes of points with these coordinates."""
    odd = (_least(x)[0] & 1).astype(np.uint64)
    v = _least(y).astype(np.uint64)
    up, down = (lambda i, k: v[i] << np.uint64(k)), (lambda i, k: v[i] >> np.uint64(k))
    words = [v[0] | up(1, 26) | up(2, 52), down(2, 12) | up(3, 14) | up(4, 40), down(4, 24) | up(5, 2) | up(6, 28) | up(7, 54), down(7, 10) | up(8, 16) | up(9, 42) | (odd << np.uint64(63))]
    return np.ascontiguousarray(np.stack(words, axis=1).astype("<u8")).view(np.uint8).reshape(-1, 32)


def table_of(multiples: list) -> np.ndarray:
    """(32, 10, 3, 256) of the 32 rows of a table of multiples: for each digit (y - x, y + x, 2 d x y) of its point, of the neutral one for 0."""
    rows = [[(1, 1, 0), *((minus % P, plus % P, twist) for plus, minus, twist in row[1:])] for row in multiples]
    flat = limbs([v for row in rows for entry in row for v in entry]).reshape(LIMBS, len(rows), 256, 3)
    return np.ascontiguousarray(flat.transpose(1, 0, 3, 2))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(n, 32): the encoded sums of multiples of points, for each row; parts are (table, (n, 32) digits of the scalars)."""
    n = parts[0][1].shape[0]
    done = [_summed([(table, digits[at : at + ROWS]) for table, digits in parts]) for at in range(0, n, ROWS)]
    return np.concatenate(done) if done else np.empty((0, 32), np.uint8)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    n = parts[0][1].shape[0]
    point = np.zeros((LIMBS, 4, n), np.int64)  # x, y, z, t: the neutral point
    point[0, 1:3] = 1
    one, other, three, entry = (np.empty((LIMBS, k, n), np.int64) for k in (4, 4, 3, 3))
    of_three, of_four = room(3, n), room(4, n)
    for table, digits in parts:
        for row, digit in zip(table, np.ascontiguousarray(digits.T), strict=True):
            x, y, z, t = (point[:, k] for k in range(4))
            np.subtract(y, x, out=three[:, 0])
            np.add(y, x, out=three[:, 1])
            three[:, 2] = t
            np.take(row, digit, axis=2, out=entry, mode="clip")  # another mode would copy
            a, b, c = product(three, entry, of_three).transpose(1, 0, 2)
            z += z
            np.subtract(b, a, out=one[:, 0])  # e f, g h, f g, e h
            one[:, 3] = one[:, 0]
            np.subtract(z, c, out=other[:, 0])
            one[:, 2] = other[:, 0]
            np.add(z, c, out=one[:, 1])
            other[:, 2] = one[:, 1]
            np.add(b, a, out=other[:, 1])
            other[:, 3] = other[:, 1]
            point = product(one, other, of_four)
    inverse = inverses(point[:, 2])
    return encoded(product(point[:, 0], inverse), product(point[:, 1], inverse))
