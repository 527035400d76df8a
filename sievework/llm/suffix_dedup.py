"""Removal of repeated WINDOW-byte strings through suffix arrays, linear grouping construction.

Anchors. Each window of WINDOW bytes has an anchor: its leftmost K-gram of the least hash. Equal windows have equal
anchors at equal places, so all that equal windows can share lies in the segments around equal anchors. Segments whose
anchor occurs once in the corpus are dropped before any text moves; equal texts are one class throughout.

Suffix arrays. Of an anchor's segments, equal ones are one. The others are aligned at the anchor, cut back to the
longest match that any other has on either side, and written as short strings of 64-bit block identifiers, the blocks
ending where matches end. The strings of many anchors form one string whose suffix array is built by processing groups
of suffixes of equal Lyndon prefix in descending order, moving the suffixes that previous-smaller pointers lead to
behind their groups, and then emitting each group in order through the same pointers: linear, without recursion. A
suffix's longest match with an earlier occurrence is with its nearest neighbours of earlier place in the array; where it
has WINDOW bytes, its bytes are repeated.

An anchor with more than HOT segments is not sent to one task: its windows are dealt anew by a longer anchor, the bytes
before or behind it included, and where that still has more than HOT segments, by their own content, reduced to the
earliest within each task and then over all.

Order is by (doc_id, text digest), null ids last. Defined cases: null is the empty text; texts under WINDOW bytes lose
nothing; of equal texts all but the earliest lose all (from WINDOW bytes on); rows equal in id and text fare alike; an
empty table gives no rows; further columns are ignored; texts of any length are read whole. Bytes are removed even
inside a character, so the kept bytes need not be UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialise, sliced, small_batches
from .line_dedup import LAST_ID
from .textvec import U, mix, pieces

WINDOW, K = 100, 28
SPAN = WINDOW - K + 1  # K-grams of a window
SIDE = (WINDOW - K) // 2 + 1  # bytes that a longer anchor has more
LEFT, RIGHT = WINDOW - K, WINDOW  # bytes of a segment before its anchor, and from there on, at most
HOT = 20_000
#: Occurrences in one batch from which on a gram is known to be shared and its rows need not meet.
FREQUENT = 256
BATCH = 8192
PLACE = 22  # bits of a place in a piece; longer texts are one piece cut into overlapping stretches
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's first n powers at least, and those of its inverse; kept for the next call."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        up, down = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


# --- suffix array -------------------------------------------------------------------------------------------------


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of text, whose last symbol is smaller than all others.

    First the suffixes are grouped by their longest Lyndon prefix. Groups start as the first symbols; the greatest
    group not yet done is final, and each suffix that its members' previous smaller suffixes lead to has a Lyndon
    prefix extended by the group's: these move behind the group they were in, those reached most often last. Then the
    suffixes are emitted from the least on: behind a suffix that has its final place, the suffix before it is the
    next of its group, and so on along the pointers.
    """
    n = len(text)
    array = np.argsort(np.array(text), kind="stable")
    place = [0] * n
    group = [0] * n  # start of a suffix's group
    size = [0] * n  # of the group that starts here
    array = array.tolist()
    start = 0
    for i, s in enumerate(array):
        if i and text[s] != text[array[i - 1]]:
            start = i
        place[s], group[s] = i, start
        size[start] += 1
    smaller = [-1] * n
    end = n
    while end:
        low = group[array[end - 1]]
        reached: dict[int, int] = {}
        for s in sorted(array[low:end]) if end - low > 1 else array[low:end]:
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        if reached:
            by_count: dict[int, list[int]] = {}
            for p, count in reached.items():
                by_count.setdefault(count, []).append(p)
            for count in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                for p in by_count[count]:
                    g = group[p]
                    k = moved[g] = moved.get(g, 0) + 1
                    to, at = g + size[g] - k, place[p]
                    other = array[to]
                    array[at], place[other] = other, at
                    array[to], place[p] = p, to
                for g, k in moved.items():
                    left = size[g] - k
                    if left:
                        size[g], size[g + left] = left, k
                        for i in range(g + left, g + left + k):
                            group[array[i]] = g + left
        end = low
    out, done = [-1] * n, [False] * n
    following = list(range(n))
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[following[g]] = p
            following[g] += 1
            done[p] = True
            p = smaller[p]
    return out


def common_prefixes(text: list[int], array: list[int]) -> list[int]:
    """lcp[i]: symbols that the suffixes at i - 1 and i of the array share."""
    n = len(text)
    place, lcp, h = [0] * n, [0] * n, 0
    for i, s in enumerate(array):
        place[s] = i
    for s in range(n):
        if place[s]:
            q = array[place[s] - 1]
            while s + h < n and q + h < n and text[s + h] == text[q + h]:
                h += 1
            lcp[place[s]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return lcp


def earlier_matches(array: list[int], match: np.ndarray, time: list[int], least: int) -> Iterator[tuple[int, int]]:
    """(suffix, bytes) of the longest match of at least `least` bytes with a suffix of an earlier time.

    match[i] has the bytes that the suffixes at i - 1 and i share.
    """
    n = len(array)
    linked = match >= least
    runs = np.flatnonzero(linked & ~np.r_[False, linked[:-1]])
    for first in runs.tolist():
        last = first
        while last + 1 < n and linked[last + 1]:
            last += 1
        members = array[first - 1 : last + 1]
        shared = match[first : last + 1].tolist()
        best = [0] * len(members)
        for order in (range(len(members)), range(len(members) - 1, -1, -1)):
            stack: list[list[int]] = []  # index, match with the element pushed after it
            before = None
            for i in order:
                link = 1 << 60 if before is None else shared[min(i, before)]
                while stack and time[members[stack[-1][0]]] >= time[members[i]]:
                    link = min(link, stack.pop()[1])
                if stack:
                    best[i] = max(best[i], min(link, 1 << 59))
                # the match of i with its nearest earlier one is the least link on the way
                stack.append([i, link])
                before = i
        for i, s in enumerate(members):
            if best[i] >= least:
                yield s, best[i]


# --- anchors ------------------------------------------------------------------------------------------------------


def _anchor_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece: row, anchor's hash, its place in the row, and the first and last start of windows that have it."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none.astype(np.uint64), none, none, none
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    grams = mix((total[K:] - total[:-K]) * down[: len(data) - K + 1])
    key = (grams & ~U((1 << PLACE) - 1)) | np.arange(len(grams), dtype=np.uint64)
    width, least = 1, key
    while width < SPAN:  # least over the next `width`, doubled
        step = min(width, SPAN - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    anchor = (least & U((1 << PLACE) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(anchor)]
    valid = np.arange(len(anchor)) + WINDOW <= off[row + 1]
    starts = np.flatnonzero(valid & np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    change = np.r_[(anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~valid[1:], True]
    ends = np.flatnonzero(valid & change)
    row, anchor = row[starts], anchor[starts]
    return row, grams[anchor], anchor - off[row], starts - off[row], ends - off[row]


def _stretches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, shift, bytes, offsets): pieces; a text too long for a piece comes in overlapping stretches."""
    most = 1 << (PLACE - 1)
    for a, b, data, off in pieces(column):
        if len(data) <= most:
            yield a, 0, data, off
            continue
        assert b == a + 1
        step = most - WINDOW + 1
        for at in range(0, len(data) - WINDOW + 1, step):
            part = data[at : at + most]
            yield a, at, part, np.array([0, len(part)], np.int64)


def anchors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the column, hashes, anchor places, first and last window starts."""
    for first, shift, data, off in _stretches(column):
        row, gram, anchor, start, last = _anchor_runs(data, off)
        yield row + first, gram, anchor + shift, start + shift, last + shift


def class_number(digest: bytes) -> int:
    """Half of a class's 128 bits: enough to find a text's bytes, which decide what is removed from it. A text whose half
    is that of an earlier, different one keeps its repeats; only the whole 128 bits have a copy removed as a whole."""
    return int.from_bytes(digest[:8], "big", signed=True)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, class, spot, known): spot packs the anchor's place, its distance to the first window and the run of windows.

    known: the gram is frequent in this batch. Two of its rows are given a second time as not known, for other tasks.
    """
    seen: set[int] = set()
    for batch in sliced(batches, 2048):
        column = batch.column(0).fill_null("")
        numbers, fresh = [], []
        for text in column.to_pylist():
            number = class_number(hashlib.sha256(text.encode()).digest())
            fresh.append(number not in seen and len(text) * 4 >= WINDOW)
            seen.add(number)
            numbers.append(number)
        column = column.filter(pa.array(fresh, pa.bool_()))
        numbers = np.array(numbers, np.int64)[np.array(fresh, bool)]
        parts = [(gram.view(np.int64), numbers[row], anchor << 14 | (anchor - start) << 7 | (last - start)) for row, gram, anchor, start, last in anchors_of(column)]
        if not parts:
            continue
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        _, first, place, count = np.unique(columns[0], return_index=True, return_inverse=True, return_counts=True)
        known = count[place] >= FREQUENT
        often = count >= FREQUENT
        rest = np.flatnonzero(known)
        rest = rest[~np.isin(rest, first[often])]
        _, second = np.unique(columns[0][rest], return_index=True)
        again = np.concatenate([first[often], rest[second]])
        columns = [np.concatenate([c, c[again]]) for c in columns]
        known = np.concatenate([known, np.zeros(len(again), bool)])
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.array(known)], ["gram", "class", "spot", "known"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (gram, class, spot): each distinct one whose gram is known or has two or more."""
    names = ["gram", "class", "spot"]
    last: tuple | None = None
    joined = False
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if last is not None:
            columns = [np.r_[x, c] for x, c in zip(last, columns, strict=True)]
        if not len(columns[0]):
            continue
        gram, number, spot, known = columns
        new = np.r_[True, (gram[1:] != gram[:-1]) | (number[1:] != number[:-1]) | (spot[1:] != spot[:-1])]
        known = np.logical_or.reduceat(known.astype(bool), np.flatnonzero(new))
        gram, number, spot = gram[new], number[new], spot[new]
        same = gram[1:] == gram[:-1]
        keep = known | np.r_[joined if last is not None else False, same] | np.r_[same, False]
        joined = bool(same[-1]) if len(same) else joined and last is not None
        last = gram[-1], number[-1], spot[-1], known[-1]
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (gram, number, spot)], names)
    if last is not None and (joined or last[3]):
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in last[:3]], names)


SEGMENT = "gram long, ord long, class long, start long, lead int, bytes binary"


def _cuts(data: bytes, gram: int, start: int, lead: int, run: int, longer: bool) -> Iterator[tuple[int, int, int, int]]:
    """(key, start, lead, run) of an anchor's windows; longer: by the bytes before or behind the anchor as well.

    A window that begins SIDE bytes before the anchor or earlier has these bytes; any other has as many behind it.
    """
    if not longer:
        yield gram, start, lead, run
        return
    anchor = start + lead
    before = min(run + 1, max(0, lead - SIDE + 1))  # windows that begin early enough
    for first, count, a, b in ((0, before, anchor - SIDE, anchor + K), (before, run + 1 - before, anchor, anchor + K + SIDE - 1)):
        if count:
            key = hashlib.blake2b(data[a:b], digest_size=8, person=b"left" if first == 0 and before else b"right").digest()
            yield int.from_bytes(key, "big", signed=True), start + first, lead - first, count - 1


def _segments(longer: bool) -> Callable:
    """From (ord, class, packed text, size, spots): the bytes of all windows of each anchor."""
    names = ["gram", "ord", "class", "start", "lead", "bytes"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns: list[list] = [[] for _ in names]
            for ord_, number, packed, size, spots in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                data = pa.decompress(packed, size, codec="zstd", asbytes=True) if size else b""
                for s in spots:
                    spot = s["spot"]
                    lead, run = spot >> 7 & 127, spot & 127
                    for key, start, ahead, more in _cuts(data, s["gram"], (spot >> 14) - lead, lead, run, longer):
                        for column, value in zip(columns, (key, ord_, number, start, ahead, data[start : start + more + WINDOW]), strict=True):
                            column.append(value)
                if len(columns[0]) >= BATCH:
                    yield _segment_batch(columns, names)
                    columns = [[] for _ in names]
            yield _segment_batch(columns, names)

    return rows


def _segment_batch(columns: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


# --- repeats of aligned segments ----------------------------------------------------------------------------------


def _reach(cells: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of cells sorted by group and content: order, match with the row before (0 for a group's first), greatest match."""
    keys = np.ascontiguousarray(np.hstack([group.astype(">u4")[:, None].view(np.uint8).reshape(len(group), 4), cells.astype(">u2").view(np.uint8).reshape(len(cells), -1)]))
    order = np.argsort(keys.view(f"V{keys.shape[1]}").ravel(), kind="stable")
    c, g = cells[order], group[order]
    if len(order) > 1:
        differ = c[1:] != c[:-1]
        match = np.where(differ.any(1), differ.argmax(1), c.shape[1])
        match = np.r_[0, np.where(g[1:] == g[:-1], match, 0)]
    else:
        match = np.zeros(len(order), np.int64)
    most = np.zeros(len(order), np.int64)
    most[order] = np.maximum(match, np.r_[match[1:], 0])
    return order, match, most


def repeats(gram: np.ndarray, time: np.ndarray, start: np.ndarray, lead: np.ndarray, segments: list[bytes]) -> list[tuple[int, int, int]]:
    """(segment, from, to) of bytes in windows that also are in a segment of an earlier time. Rows of one gram are together."""
    out: list[tuple[int, int, int]] = []
    order = np.lexsort((start, time))
    first_of: dict[tuple, int] = {}
    chosen = []
    for i in order.tolist():  # equal segments: the earliest stands for all
        key = (gram[i], lead[i], segments[i])
        if key in first_of:
            j = first_of[key]
            if (time[i], start[i]) != (time[j], start[j]):
                out.append((i, 0, len(segments[i])))
        else:
            first_of[key] = i
            chosen.append(i)
    chosen = np.array(chosen)
    _, group, members = np.unique(gram[chosen], return_inverse=True, return_counts=True)
    chosen, group = chosen[members[group] > 1], group[members[group] > 1]
    if not len(chosen):
        return out
    # aligned at the anchor; a cell outside the segment equals none: it has a number of its own
    size = np.array([len(segments[i]) for i in chosen])
    ahead = lead[chosen].astype(np.int64)
    cells = np.zeros((len(chosen), LEFT + RIGHT), np.uint16)
    flat = np.frombuffer(b"".join(segments[i] for i in chosen), np.uint8)
    rows = np.repeat(np.arange(len(chosen)), size)
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    cells[rows, LEFT - ahead[rows] + inner] = flat.astype(np.uint16) + 1
    while True:
        _, _, right = _reach(cells[:, LEFT:], group)
        _, _, left = _reach(cells[:, :LEFT][:, ::-1], group)
        # cells outside both segments are equal as 0: matches end at the segments' own ends
        right, left = np.minimum(right, size - ahead), np.minimum(left, ahead)
        fit = left + right >= WINDOW
        if fit.all() or not fit.any():
            break
        chosen, group, cells, size, ahead = chosen[fit], group[fit], cells[fit], size[fit], ahead[fit]
    if not fit.any():
        return out
    # blocks end where some match of the group ends
    marks = np.zeros((int(group.max()) + 1, LEFT + RIGHT + 1), bool)
    for part, sign in ((cells[:, LEFT:], 1), (cells[:, :LEFT][:, ::-1], -1)):
        order, match, _ = _reach(part, group)
        marks[group[order], LEFT + sign * match] = True
    marks[group, LEFT + right] = True
    marks[group, LEFT - left] = True
    cut_row, cut_col = np.nonzero(marks[group] & (np.arange(LEFT + RIGHT + 1) >= LEFT - left[:, None]) & (np.arange(LEFT + RIGHT + 1) <= LEFT + right[:, None]))
    last = np.r_[cut_row[1:] != cut_row[:-1], True]
    begin, stop, owner = cut_col[~last], cut_col[1:][~last[:-1]], cut_row[~last]
    up, down = powers(LEFT + RIGHT + 1)
    total = np.zeros((len(cells), LEFT + RIGHT + 1), np.uint64)
    np.cumsum(mix(cells.astype(np.uint64)) * up[: LEFT + RIGHT], axis=1, out=total[:, 1:])
    symbol = mix((total[owner, stop] - total[owner, begin]) * down[begin] + (stop - begin).astype(np.uint64)) ^ mix(group[owner].astype(np.uint64) << U(8) | begin.astype(np.uint64))
    _, code = np.unique(symbol, return_inverse=True)
    # string by string, each closed by a separator of its own
    first = np.r_[True, owner[1:] != owner[:-1]]
    string = np.cumsum(first) - 1
    n = int(string[-1]) + 1
    where = np.arange(len(code)) + string
    text = np.zeros(len(code) + n, np.int64)
    width = np.zeros(len(code) + n + 1, np.int64)
    ends = np.flatnonzero(np.r_[first[1:], True]) + string[np.flatnonzero(np.r_[first[1:], True])] + 1
    text[where] = code + n + 1
    text[ends] = n - np.arange(n)  # the last one is 1, the least
    width[where] = stop - begin
    reach = np.r_[0, np.cumsum(width)]
    symbols = text.tolist()
    array = suffix_array(symbols)
    lcp = np.array(common_prefixes(symbols, array))
    sa = np.array(array)
    match = reach[sa + lcp] - reach[sa]
    row_of, col_of = np.full(len(text), -1), np.zeros(len(text), np.int64)
    row_of[where], col_of[where] = owner, begin
    # earlier: by document, then by place
    absolute = start[chosen] - (LEFT - ahead)
    when = np.zeros(len(text), np.int64)
    t = np.lexsort((absolute[owner] + begin, time[chosen][owner]))
    rank = np.zeros(len(t), np.int64)
    pairs = np.c_[time[chosen][owner][t], (absolute[owner] + begin)[t]]
    rank[t] = np.cumsum(np.r_[True, (pairs[1:] != pairs[:-1]).any(1)])
    when[where] = rank
    for s, length in earlier_matches(array, match, when.tolist(), WINDOW):
        r, c = int(row_of[s]), int(col_of[s])
        begin_at = c - LEFT + int(ahead[r])
        out.append((int(chosen[r]), begin_at, begin_at + length))
    return out


RANGE = "ord long, class long, start long, stop long"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by gram -> repeated ranges, whole grams at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def solve(table: pa.Table) -> pa.RecordBatch:
        gram, ord_, number, start = (table.column(i).to_numpy() for i in range(4))
        lead = table.column(4).to_numpy()
        segments = table.column(5).to_pylist()
        _, number_rank = np.unique(number, return_inverse=True)
        _, time = np.unique(np.c_[ord_, number_rank], axis=0, return_inverse=True)
        found = np.array(repeats(gram, time.ravel(), start, lead, segments), np.int64).reshape(-1, 3)
        i = found[:, 0]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (ord_[i], number[i], start[i] + found[:, 1], start[i] + found[:, 2])], ["ord", "class", "start", "stop"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < BATCH:
            continue
        table = pa.Table.from_batches(held)
        gram = table.column(0).to_numpy()
        whole = int(np.searchsorted(gram, gram[-1]))
        if whole:
            yield solve(table.slice(0, whole))
        held = table.slice(whole).combine_chunks().to_batches()
        rows = len(gram) - whole
    if rows:
        yield solve(pa.Table.from_batches(held))


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of hot anchors' segments by content: of each, this task's earliest, and the others as ranges (key null)."""
    first: dict[bytes, tuple] = {}
    names, kinds = ["key", "ord", "class", "start"], [pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names)

    for batch in sliced(batches):
        out: list[tuple] = []
        for ord_, number, start, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 5)), strict=True):
            for i in range(len(data) - WINDOW + 1):
                key, own = hashlib.blake2b(data[i : i + WINDOW], digest_size=16).digest(), (ord_, number, start + i)
                other = first.setdefault(key, own)
                if own < other:
                    first[key] = own
                    out.append((None, *other))
                elif own > other:
                    out.append((None, *own))
        yield rows(out)
        if len(first) > 200_000:
            yield rows([(k, *v) for k, v in first.items()])
            first.clear()
    yield rows([(k, *v) for k, v in first.items()])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = [t.encode() for t in batch.column(2).to_pylist()]
        packed = pa.array([pa.compress(t, codec="zstd", asbytes=True) if t else b"" for t in texts], pa.binary())
        names = ["ord", "class", "packed", "size", *batch.schema.names[3:]]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array([len(t) for t in texts], pa.int64()), *batch.columns[3:]], names)


def _named(docs: DataFrame, *more: str) -> DataFrame:
    """ord, class, text of each row; `strong` on demand: the other half of the class's 128 bits."""
    text = F.coalesce("text", F.lit(""))
    half = lambda at: F.conv(F.substring(F.sha2(text.cast("binary"), 256), at, 16), 16, -10).cast("long")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("ord"), half(1).alias("class"), half(17).alias("strong"), text.alias("text"))
    return rows.select("ord", "class", "text", *more)


def repeated_ranges(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """ord, class, start, stop: bytes of the first row of each class that lie in windows with an earlier occurrence."""
    grams = docs.select("text").mapInArrow(_anchors, "gram long, class long, spot long, known boolean")
    deal = F.when(F.col("known"), F.xxhash64("class", "spot")).otherwise(F.col("gram"))
    shared = materialise(grams.repartition(deal).sortWithinPartitions("gram", "class", "spot").mapInArrow(_shared, "gram long, class long, spot long"), "shared")
    named = _named(docs)
    firsts = named.groupBy("class").agg(F.min("ord").alias("ord"))

    def segments(spots: DataFrame, longer: bool) -> DataFrame:
        lists = spots.groupBy("class").agg(F.collect_list(F.struct("spot", "gram")).alias("spots")).join(firsts, "class")
        if longer:  # few, as a rule: then the texts need not move
            lists = materialise(lists, "lists")
            lists = F.broadcast(lists) if spots.count() * 64 <= BROADCAST_BYTES // 2 else lists
        texts = named.where(F.octet_length("text") >= WINDOW).mapInArrow(_pack, "ord long, class long, packed binary, size long")
        return texts.join(lists, ["ord", "class"]).select("ord", "class", "packed", "size", "spots").mapInArrow(_segments(longer), SEGMENT)

    def busy(rows: DataFrame) -> DataFrame:
        return materialise(rows.groupBy("gram").count().where(F.col("count") > hot).select("gram"), "busy")

    frequent = busy(shared)
    if frequent.isEmpty():
        return segments(shared, False).repartition("gram").sortWithinPartitions("gram").mapInArrow(_ranges, RANGE)
    longer = materialise(segments(materialise(shared.join(frequent, "gram", "left_semi"), "frequent"), True), "longer")
    still = busy(longer)
    calm = segments(shared.join(frequent, "gram", "left_anti"), False).unionByName(longer.join(still, "gram", "left_anti"))
    out = calm.repartition("gram").sortWithinPartitions("gram").mapInArrow(_ranges, RANGE)
    windows = materialise(longer.join(still, "gram", "left_semi").select(*longer.columns).mapInArrow(_hot_windows, "key binary, ord long, class long, start long"), "windows")
    keyed = windows.where("key IS NOT NULL")
    first = materialise(keyed.groupBy("key").agg(F.min(F.struct("ord", "class", "start")).alias("first")), "first")
    later = keyed.join(first, "key").where(F.struct("ord", "class", "start") != F.col("first")).select("ord", "class", "start")
    later = later.unionByName(windows.where("key IS NULL").select("ord", "class", "start"))
    return out.unionByName(later.select("ord", "class", "start", (F.col("start") + WINDOW).alias("stop")))


def merge_ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.r_[True, starts[1:] > stops[:-1]]
    return starts[new], stops[np.r_[np.flatnonzero(new)[1:] - 1, len(stops) - 1]]


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of one row's list merged: (ord, class, starts, stops)."""
    for batch in sliced(batches):
        starts, stops = [], []
        for spans in batch.column(2):
            a, b = merge_ranges(*(spans.values.field(i).to_numpy() for i in (0, 1)))
            starts.append(a), stops.append(b)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, kind), pa.array(stops, kind)], ["ord", "class", "starts", "stops"])


def remove_repeats(docs: DataFrame, hot: int = HOT, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (starts, stops of removed runs), kept (bytes), kept_sha256.

    Without keep_bytes, `kept` is left out.
    """
    small_batches(docs.sparkSession)
    ranges = repeated_ranges(docs, hot).groupBy("ord", "class").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = materialise(ranges.mapInArrow(_merge_task, "ord long, class long, starts array<long>, stops array<long>"), "spans")
    firsts = _named(docs, "strong").groupBy("class", "strong").agg(F.min("ord").alias("first"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = _named(docs, "strong").mapInArrow(_pack, "ord long, class long, packed binary, size long, strong long")
    known = firsts.join(spans.withColumnRenamed("ord", "first"), ["class", "first"], "left").where("first IS NOT NULL")
    joined = packed.join(known, ["class", "strong"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[tuple] = []
            for ord_, first, packed, size, starts, stops in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                data = pa.decompress(packed, size, codec="zstd", asbytes=True) if size else b""
                if ord_ > first and size >= WINDOW:
                    starts, stops = [0], [size]
                starts, stops = starts or [], stops or []
                kept = b"".join(data[a:b] for a, b in zip([0, *stops], [*starts, size], strict=True))
                out.append((None if ord_ == LAST_ID else ord_, size, size - len(kept), len(starts), starts, stops, kept if keep_bytes else None, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary(), pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "starts", "stops", "kept", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names)

    joined = joined.select("ord", "first", "packed", "size", "starts", "stops")
    out = joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, stops array<long>, kept binary, kept_sha256 string")
    out = out.withColumn("doc_id", F.col("doc_id").cast(kind))
    return out if keep_bytes else out.drop("kept")
