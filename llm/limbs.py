"""Exact integer dot products by float64 matrix products of limbs.

Integers are split into signed limbs of so few bits that a product of two limb matrices sums to
less than 2^53, where float64 still holds every integer. The limb products are shifted and added
in int64; sums that leave its range on the way come back, as the result itself is inside.
"""

from __future__ import annotations

import numpy as np

EXACT_BITS = 52  # of a float64 sum, below 2^53


def limb_bits(width: int) -> int:
    """Bits of a signed limb so that ``width`` products of limbs stay below 2^53."""
    bits = (EXACT_BITS + 2 - max(width - 1, 0).bit_length()) // 2
    if bits < 2:
        raise ValueError(f"{width} components are too many for exact products")
    return bits


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as float64 limbs between -2^(bits-1) and 2^(bits-1) - 1, lowest first; as many as ``x`` needs."""
    half, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    while True:
        low = ((x + half) & mask) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> bits
        if not x.any():
            return out


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


class Split:
    """An int64 matrix as limb matrices; ``take`` picks rows."""

    def __init__(self, x: np.ndarray, bits: int | None = None):
        self.width = x.shape[1]
        self.bits = bits or limb_bits(self.width)
        self.most = largest(x)
        self.parts = limbs(x, self.bits)

    def take(self, at) -> Split:
        out = object.__new__(Split)
        out.width, out.bits, out.most, out.parts = self.width, self.bits, self.most, [p[at] for p in self.parts]
        return out

    def __matmul__(self, other: Split) -> np.ndarray:
        """Dot products of all rows with all rows of ``other``, in int64."""
        if self.width * self.most * other.most >= 1 << 63:
            raise OverflowError("components too large for 64-bit dot products")
        out = None
        for i, left in enumerate(self.parts):
            for j, right in enumerate(other.parts):
                shift = self.bits * (i + j)
                if shift < 64:
                    term = (left @ right.T).astype(np.int64) << shift
                    out = term if out is None else out + term
        return out


def exact_products(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """``a @ b.T`` of int64 matrices in int64; an OverflowError where a result could leave int64."""
    return Split(a, bits) @ Split(b, bits)
