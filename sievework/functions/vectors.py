"""Vectors and 64-bit hashes as Column expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0).cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def unit(a: Column) -> Column:
    """a over its norm; a zero vector as it is."""
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))


def hex_halves(phash: Column) -> tuple[Column, Column]:
    """Upper and lower 32 bits of a 16-digit hex hash."""
    return tuple(F.conv(F.substring(phash, at, 8), 16, 10).cast("long") for at in (1, 9))


def hamming(high_a: Column, low_a: Column, high_b: Column, low_b: Column) -> Column:
    return F.bit_count(high_a.bitwiseXOR(high_b)) + F.bit_count(low_a.bitwiseXOR(low_b))


def band_cuts(count: int) -> list[int]:
    return [round(i * 64 / count) for i in range(count + 1)]


def bands(high: Column, low: Column, count: int) -> list[Column]:
    """The 64 bits in `count` bands, as numbers: hashes within distance d have one with d // count differences at most."""
    cuts = band_cuts(count)

    def bits(word: Column, first: int, last: int) -> Column:  # of the 32 bits, the first the highest
        return F.shiftright(word, 32 - last).bitwiseAND(F.lit((1 << (last - first)) - 1).cast("long"))

    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b <= 32:
            out.append(bits(high, a, b))
        elif a >= 32:
            out.append(bits(low, a - 32, b - 32))
        else:
            out.append(F.shiftleft(bits(high, a, 32), b - 32).bitwiseOR(bits(low, 0, b - 32)))
    return out


def flips(width: int, most: int) -> list[int]:
    """All numbers of `width` bits with at most `most` ones."""
    return [sum(1 << i for i in ones) for n in range(most + 1) for ones in itertools.combinations(range(width), n)]
