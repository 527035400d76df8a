"""Pairs of 64-bit hashes within a Hamming distance: rows meet in cells of one band, and are compared there.

Of more bands than the limit, hashes within it have one in common (pigeonhole), so a row goes to limit + 1 cells, packed by
column. A pair is found in the first cell that both are in: all bands before differ, which leaves fewer differences for the
rest. In a cell the rest is cut in groups, one more than what is left, and rows of one group are compared by bit counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors

#: Rows of a cell that one task compares; a larger cell is cut in blocks, and each two blocks are a task's.
CELL_ROWS = 250_000
#: Rows that are packed at once, and of a pack at most.
PACK_ROWS, BLOB_ROWS = 1 << 19, 1 << 15
#: Rows compared without groups, rows of a side of a comparison, and pairs of a batch.
FEW, SIDE, OUT_ROWS = 2000, 64, 1 << 16

ROWS = "ord long, hi long, lo long, folder string"
PACKED = "band int, value long, name string, one int, two int, side int, n int, names array<string>, pack binary"
COUNTED = "band int, value long, name string, n long"
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32())])
KEY = ["band", "value", "name", "one", "two"]


def _bits(hashes: np.ndarray, first: int, last: int) -> np.ndarray:
    """Bits first to last of the hashes, the highest is bit 0; in the smallest type."""
    width = last - first
    out = (hashes >> np.uint64(64 - last)) & np.uint64((1 << width) - 1)
    return out.astype(np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32 if width <= 32 else np.uint64)


def _pack(hashes: np.ndarray, ords: np.ndarray, codes: np.ndarray) -> bytes:
    """Sorted hashes with their rows, byte planes compressed."""
    planes = [np.diff(hashes, prepend=np.uint64(0)), ords, codes.astype(np.int32)]
    return pa.Codec("zstd").compress(b"".join(p.view(np.uint8).reshape(len(p), -1).T.tobytes() for p in planes), asbytes=True)


def _unpack(pack: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(pack, n * 20, asbytes=True), np.uint8)
    plane = lambda at, size, kind: np.ascontiguousarray(raw[at * n : (at + size) * n].reshape(size, n).T).view(kind).ravel()
    return np.cumsum(plane(0, 8, np.uint64), dtype=np.uint64), plane(8, 8, np.int64), plane(16, 4, np.int32)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """hashes, ords, codes (-1: no folder) in order of the hashes, and the folders of the codes."""
    held: list[pa.RecordBatch] = []

    def chunk():
        table = pa.Table.from_batches(held).combine_chunks()
        ords, high, low = (table.column(i).to_numpy() for i in range(3))
        folders = table.column(3).cast(pa.string()).combine_chunks().dictionary_encode()
        folders = folders.combine_chunks() if isinstance(folders, pa.ChunkedArray) else folders
        hashes = (high.astype(np.uint64) << np.uint64(32)) | (low.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        codes = folders.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        order = np.argsort(hashes)
        return hashes[order], ords[order].astype(np.int64), codes[order], folders.dictionary.to_pylist()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACK_ROWS:
            yield chunk()
            held = []
    if sum(b.num_rows for b in held):
        yield chunk()


def _cells(hashes: np.ndarray, codes: np.ndarray, cuts: list[int], band: int, inside: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """value, code (-1: of all folders), rows of each cell of a band; the rows in order of the hashes."""
    value = _bits(hashes, cuts[band], cuts[band + 1])
    order = np.lexsort((value, codes)) if inside else np.argsort(value, kind="stable")
    order = order[codes[order] >= 0] if inside else order  # rows without a folder are like none
    value, code = value[order], codes[order] if inside else np.full(len(order), -1)
    starts = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (code[1:] != code[:-1])]) if len(order) else np.zeros(0, int)
    for s, e in zip(starts, [*starts[1:], len(order)], strict=True):
        yield int(value[s]), int(code[s]), order[s:e]


def _counter(cuts: list[int], limit: int, inside: bool, least: int) -> Callable:
    def count(batches):
        for hashes, _, codes, names in _chunks(batches):
            rows = [(band, value, names[code] if code >= 0 else None, len(at)) for band in range(limit + 1) for value, code, at in _cells(hashes, codes, cuts, band, inside) if len(at) >= least]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["band", "value", "name", "n"])

    return count


def _packer(cuts: list[int], limit: int, inside: bool, blocks: dict[tuple, int]) -> Callable:
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.binary()]
    columns = ["band", "value", "name", "one", "two", "side", "n", "names", "pack"]

    def pack(batches):
        for hashes, ords, codes, names in _chunks(batches):
            for band in range(limit + 1):
                rows, held = [], 0
                for value, code, at in _cells(hashes, codes, cuts, band, inside):
                    name = names[code] if code >= 0 else None
                    n_blocks = blocks.get((band, value, name), 1)
                    parts = max(n_blocks > 1 and min(n_blocks, len(at)), -(-len(at) // BLOB_ROWS))
                    for part in range(parts):
                        own = at[part::parts]
                        used, local = np.unique(codes[own], return_inverse=True)
                        data = _pack(hashes[own], ords[own], local - int(used[0] < 0))  # a missing folder stays -1
                        block = (int(ords[at[0]]) + part) % n_blocks
                        for other in range(n_blocks):
                            one, two = min(block, other), max(block, other)
                            rows.append((band, value, name, one, two, int(block == two and one < two), len(own), [names[c] for c in used if c >= 0], data))
                            held += len(data)
                        if held >= 1 << 22 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], columns)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

    return pack


def _compare(hashes: np.ndarray, limit: int, order: np.ndarray, runs: np.ndarray, differ: list[np.ndarray]) -> Iterator[tuple]:
    """p, q, distance of rows of one run (runs: the starts in `order`, and its end) that differ in every array of `differ`.

    Rows of a run are in order of the first such array: blocks of one value are not compared with that value.
    """
    hashes, differ = hashes[order], [d[order] for d in differ]
    upper = np.triu(np.ones((SIDE, SIDE), bool), 1)
    for start, end in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
        for s in range(start, end - 1, SIDE):
            e = min(s + SIDE, end)
            at = s
            if differ and differ[0][s] == differ[0][e - 1]:
                at = start + int(np.searchsorted(differ[0][start:end], differ[0][s], "right"))
            for f in range(at, end, 1 << 14):
                t = min(end, f + (1 << 14))
                count = np.bitwise_count(hashes[s:e, None] ^ hashes[None, f:t])
                ok = count <= limit
                if f == s:
                    m = min(SIDE, t - f)
                    ok[:, :m] &= upper[: e - s, :m]
                for d in differ:
                    ok &= d[s:e, None] != d[None, f:t]
                flat = np.flatnonzero(ok)
                if len(flat):
                    p, q = np.divmod(flat, t - f)
                    yield order[s + p], order[f + q], count.ravel()[flat]


def _near(hashes: np.ndarray, limit: int, cuts: list[int], band: int) -> Iterator[tuple]:
    """p, q, distance (up to limit) of all pairs of rows of a cell whose bands before this one all differ, each once."""
    n = len(hashes)
    if band > limit or n < 2:
        return
    differ = [_bits(hashes, cuts[b], cuts[b + 1]) for b in range(band)]
    if n <= FEW:
        order = np.argsort(differ[0], kind="stable") if differ else np.arange(n)
        yield from _compare(hashes, limit, order, np.array([0, n]), differ)
        return
    count = limit - band + 1  # groups: one has no difference
    first = cuts[band + 1]
    ends = [first + round(i * (64 - first) / count) for i in range(count + 1)]
    for a, b in zip(ends, ends[1:], strict=False):
        group = _bits(hashes, a, min(b, a + 32))
        order = np.lexsort((differ[0], group)) if differ else np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
        sizes = np.diff(np.r_[starts, n])
        # short runs go without the others: their rows are moved together
        keep = np.repeat(sizes > 1, sizes)
        sizes = sizes[sizes > 1]
        yield from _compare(hashes, limit, order[keep], np.r_[0, np.cumsum(sizes)], differ)
        differ.append(group)


def _gathered(found: Iterator[tuple]) -> Iterator[tuple]:
    """The same rows in fewer parts."""
    held, n = [], 0
    for part in found:
        held.append(part)
        n += len(part[0])
        if n >= OUT_ROWS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


class _Cell:
    """The rows of a cell: hashes, ords, codes (-1: no folder), sides (1: of the second block)."""

    def __init__(self, hashes, ords, codes, sides, cuts, band, two_blocks):
        self.hashes, self.ords, self.codes, self.sides = hashes, ords, codes, sides
        self.cuts, self.band, self.two_blocks = cuts, band, two_blocks

    def units(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows `at` in order of hash and side; the start of each such unit, and its size."""
        at = at[np.lexsort((self.sides[at], self.hashes[at]))]
        h, s = self.hashes[at], self.sides[at]
        starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
        return at, starts, np.diff(np.r_[starts, len(at)])

    def pairs(self, at: np.ndarray, limit: int) -> Iterator[tuple]:
        """Rows x, y, distance of all pairs of rows `at` within the limit that are this cell's."""
        if len(at) < 2 or self.band > limit:
            return
        at, starts, sizes = self.units(at)
        if self.band == 0 and not self.two_blocks:
            many = np.flatnonzero(sizes > 1)
            yield from self.within(at, starts[many], sizes[many])
        hashes, sides = self.hashes[at[starts]], self.sides[at[starts]]
        for p, q, distance in _gathered(_near(hashes, limit, self.cuts, self.band)):
            if self.two_blocks:
                across = sides[p] != sides[q]
                p, q, distance = p[across], q[across], distance[across]
            yield from self.expand(at, starts, sizes, p, q, distance)

    def within(self, at, starts, sizes) -> Iterator[tuple]:
        """Pairs of members of one unit: of small units those at one offset at a time, of others by blocks."""
        small = sizes <= SIDE
        first, last = starts[small], (starts + sizes)[small]
        place = np.arange(int((last - first).sum())) + np.repeat(first - np.r_[0, np.cumsum(last - first)[:-1]], last - first)
        last = np.repeat(last, sizes[small])
        for offset in range(1, SIDE):
            keep = place + offset < last
            place, last = place[keep], last[keep]
            if not len(place):
                break
            yield at[place], at[place + offset], np.zeros(len(place), np.uint8)
        for s, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
            for x in range(s, s + n - 1, SIDE):
                e = min(x + SIDE, s + n)
                for y in range(x, s + n, 1 << 14):
                    p, q = np.divmod(np.arange((e - x) * (t := min(1 << 14, s + n - y))), t)
                    later = y + q > x + p
                    yield at[x + p[later]], at[y + q[later]], np.zeros(int(later.sum()), np.uint8)

    def expand(self, at, starts, sizes, p, q, distance) -> Iterator[tuple]:
        """Pairs of members of the units p and q."""
        one = (sizes[p] == 1) & (sizes[q] == 1)
        if one.any():
            yield at[starts[p[one]]], at[starts[q[one]]], distance[one]
        p, q, distance = p[~one], q[~one], distance[~one]
        if not len(p):
            return
        ends = np.cumsum(sizes[p] * sizes[q])
        for first in range(0, int(ends[-1]), OUT_ROWS):
            last = min(first + OUT_ROWS, int(ends[-1]))
            f, t = np.searchsorted(ends, [first, last - 1], "right")
            begins = np.r_[ends[f - 1] if f else 0, ends[f : t + 1]]
            k = np.repeat(np.arange(f, t + 1), np.diff(np.clip(begins, first, last)))
            place = np.arange(first, last) - begins[k - f]
            m, r = np.divmod(place, sizes[q[k]])
            yield at[starts[p[k]] + m], at[starts[q[k]] + r], distance[k]

    def result(self, same: int, cross: int | None) -> Iterator[tuple]:
        """Rows x, y, distance: within `same` in one folder, within `cross` in different ones or without."""
        order = np.argsort(self.codes, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(self.codes[order]) != 0])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            if self.codes[order[s]] >= 0:
                yield from self.pairs(order[s:e], same)
        if cross is not None and (len(starts) > 1 or self.codes[order[0]] < 0):
            for x, y, distance in self.pairs(order, cross):
                apart = (self.codes[x] != self.codes[y]) | (self.codes[x] < 0)
                yield x[apart], y[apart], distance[apart]


def _joiner(cuts: list[int], same: int, cross: int | None) -> Callable:
    def cell(key, packs) -> Iterator[tuple]:
        if sum(n for _, n, _, _ in packs) < 2:
            return
        every: dict[str, int] = {}
        columns = []
        for side, n, names, data in packs:
            hashes, ords, codes = _unpack(data, n)
            codes = np.array([*(every.setdefault(x, len(every)) for x in names), -1], np.int32)[codes]
            columns.append((hashes, ords, codes, np.full(n, side, np.uint8)))
        found = _Cell(*(np.concatenate(c) for c in zip(*columns, strict=True)), cuts, key[0], key[3] < key[4])
        for x, y, distance in found.result(same, cross):
            x, y = found.ords[x], found.ords[y]
            yield np.minimum(x, y), np.maximum(x, y), distance.astype(np.int32)

    def cells(batches):
        key, packs = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True))
            for i, now in enumerate(keys):
                if now != key:
                    if packs:
                        yield key, packs
                    key, packs = now, []
                packs.append((batch.column("side")[i].as_py(), batch.column("n")[i].as_py(), batch.column("names")[i].as_py(), batch.column("pack")[i].as_py()))
        if packs:
            yield key, packs

    def join(batches):
        for a, b, distance in _gathered(pairs for key, packs in cells(batches) for pairs in cell(key, packs)):
            keep = a != b
            a, b, distance = (a, b, distance) if keep.all() else (a[keep], b[keep], distance[keep])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, distance)], schema=PAIRS)

    return join


def near_pairs(rows: DataFrame, same: int, cross: int | None, count: int, cell_rows: int | None = None) -> DataFrame:
    """a, b, distance (a < b) of staged rows (ord, hi, lo, folder), with `count` bands (over the limits): see hamming_pairs."""
    spark, inside, limit = rows.sparkSession, cross is None, max(same, -1 if cross is None else cross)
    cell_rows = cell_rows or CELL_ROWS
    cuts = vectors.band_cuts(count)
    n = rows.count()
    blocks: dict[tuple, int] = {}
    if n > cell_rows:  # a few rows of a cell less, or blocks a bit larger, are no matter: small parts are not counted
        sizes = rows.mapInArrow(_counter(cuts, limit, inside, -(-cell_rows // 1000)), COUNTED).groupBy("band", "value", "name").agg(F.sum("n").alias("n"))
        blocks = {(r.band, r.value, r.name): -(-r.n // cell_rows) for r in sizes.where(F.col("n") > cell_rows).collect()}
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-n * (limit + 1) // PACK_ROWS))
    packed = rows.mapInArrow(_packer(cuts, limit, inside, blocks), PACKED)
    return packed.repartition(tasks, *KEY).sortWithinPartitions(*KEY).mapInArrow(_joiner(cuts, same, cross), "a long, b long, distance int")
