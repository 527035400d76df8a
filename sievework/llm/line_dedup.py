"""Line deduplication by pairwise alignment.

Equal texts are one class; its smallest id keeps the text, the others lose every line. Among classes, a line of
MIN_CHARS characters or more is an anchor, and so is a window: from any shorter line on, forwards or backwards, the
fewest consecutive lines that have MIN_CHARS characters together. Documents overlap if they share an anchor. A later
document is aligned with the earlier ones that it overlaps with by patience diff: common ends, then lines unique in both
by their longest increasing run, then the gaps between these; gaps without such lines by a longest common subsequence.
A maximal run of aligned lines settles the anchors that lie in it whole. In the later document every place of a settled
anchor is deleted, and blank lines between deleted lines.

The result is that of aligning all overlapping pairs, but a pair can only matter while it shares an anchor that is not
settled yet. So the first round pairs a document with the earliest owner of each of its anchors, the rarest anchor's
owner first: as many pairs as anchors at most, however common a line is. Of what that leaves open, each next round meets
BRANCH times as many earlier documents of each anchor, the earliest of each hash bucket, and the last one meets all: when
there are no more, or when all pairs that are left are at most LAST_PAIRS.

Lines end at LF and are compared without white space at their ends, by 126 bits of BLAKE2b. Earlier is by (doc_id, text
digest), null ids last.

Defined cases: null texts stay null, with no lines; empty texts and blank lines are never anchors and an empty text is
never deleted; rows equal in id and text are one document and fare alike; an empty table gives no rows; further columns
are kept whatever their names (one named n_lines or n_removed gets `_in` behind it); lines and texts of any length are
read whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free_names, if_small, materialise, small_batches
from .textvec import U, mix, pieces, word_spans

MIN_CHARS = 20
BLANK, SHORT, LONG, WINDOW = 0, 1, 2, 3  # the two low bits of a line's or a window's hash
WIDTH = 16  # bytes of a line's hash
#: How many times more earlier documents of an anchor each further round meets, and pairs that are few enough for the last.
BRANCH, LAST_PAIRS = 8, 200_000
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
LCS_BITS = 1 << 28  # rows kept at once to trace a common subsequence back
LAST_ID = (1 << 63) - 1


def digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def line_hashes(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[bytes, np.ndarray]]:
    """For each row, WIDTH bytes for each line, whose two low bits tell blank, short and long lines, and its characters up
    to MIN_CHARS."""
    starts, ends, _ = word_spans(data, off)
    raw = data.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        cuts = np.flatnonzero(data[a:b] == 10) + a
        begin, stop = np.r_[a, cuts + 1], np.r_[cuts, b]
        first, last = np.searchsorted(starts, begin), np.searchsorted(ends, stop, "right") - 1
        full = (first <= last) & (first < len(starts))
        s, e = starts[first[full]], ends[last[full]]
        chars = np.cumsum(np.r_[0, (data[a:b] & 0xC0) != 0x80])
        size = np.zeros(len(begin), np.uint8)
        size[full] = np.minimum(chars[e - a] - chars[s - a], MIN_CHARS)
        found = b"".join([hashlib.blake2b(raw[i:j], digest_size=WIDTH).digest() for i, j in zip(s.tolist(), e.tolist(), strict=True)])
        out = np.zeros((len(begin), 2), np.uint64)
        out[full] = np.frombuffer(found, "<u8").reshape(-1, 2)
        out[full, 0] = out[full, 0] & ~U(3) | np.where(size[full] == MIN_CHARS, U(LONG), U(SHORT))
        yield out.tobytes(), size


NONE = np.zeros(0, np.int64)


def windows(lines: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first line and end of each window; lines: (n, 2) hashes."""
    n = len(lines)
    short = np.flatnonzero(lines[:, 0] & U(3) == U(SHORT))
    if not len(short):
        return NONE.view(np.uint64), NONE, NONE
    total = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=total[1:])
    upto = total[short + 1]
    end = total.searchsorted(total[short] + MIN_CHARS)  # the least end with so many characters
    begin = total.searchsorted(upto - MIN_CHARS, "right") - 1  # the greatest such begin
    ahead, behind = end <= n, upto >= MIN_CHARS
    spans = np.unique(np.concatenate([short[ahead] * (n + 1) + end[ahead], begin[behind] * (n + 1) + short[behind] + 1]))
    if not len(spans):
        return NONE.view(np.uint64), NONE, NONE
    first, end = np.divmod(spans, n + 1)
    power, back = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(lines[:, 0] + mix(lines[:, 1])) * power[:n], out=prefix[1:])
    found = mix((prefix[end] - prefix[first]) * back[first] + (end - first).astype(np.uint64))
    return found & ~U(3) | U(WINDOW), first, end


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of BASE modulo 2^64, and of its inverse; kept for the next call."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        both = [(x, n.tobytes()) for _, _, data, off in pieces(texts) for x, n in line_hashes(data, off)]
        digests = [hashlib.sha256(t.as_py().encode()).digest()[:16] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), *(pa.array([x[i] for x in both], pa.binary()) for i in range(2))], ["ord", "digest", "lines", "size"])


class Anchors:
    """A document's lines (as bytes), their characters, and its anchors with their places."""

    def __init__(self, raw: bytes, size: bytes):
        self.hashes = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        self.lines = [raw[i : i + WIDTH] for i in range(0, len(raw), WIDTH)]
        self.size = np.frombuffer(size, np.uint8)
        kind = self.hashes[:, 0] & U(3)
        self.blank = kind == U(BLANK)
        long = np.flatnonzero(kind == U(LONG))
        key, first, end = windows(self.hashes, self.size)
        self.key = np.concatenate([self.hashes[long, 0], key]).view(np.int64)
        self.first, self.end = np.concatenate([long, first]), np.concatenate([long + 1, end])

    def inside(self, blocks: list[list[int]]) -> np.ndarray:
        """Anchors with a place that lies in one of the blocks of lines whole."""
        number = np.full(len(self.lines), -1)
        for i, block in enumerate(blocks):
            number[block] = i
        return np.unique(self.key[(number[self.first] >= 0) & (number[self.first] == number[self.end - 1])])

    def cover(self, keys: np.ndarray) -> np.ndarray:
        """Flags of the lines of all places of these anchors."""
        at = np.isin(self.key, keys)
        step = np.zeros(len(self.lines) + 1, np.int64)
        np.add.at(step, self.first[at], 1)
        np.add.at(step, self.end[at], -1)
        return np.cumsum(step[:-1]) > 0

    def closed(self, gone: np.ndarray) -> np.ndarray:
        """gone, and the runs of blank lines between such lines or an end of the text."""
        kept = ~gone & ~self.blank
        if not gone.any() or not (self.blank & ~gone).any():
            return gone
        n = len(gone)
        before = np.maximum.accumulate(np.where(kept, np.arange(n), -1))
        lost = np.maximum.accumulate(np.where(gone, np.arange(n), -1))
        after = np.minimum.accumulate(np.where(kept, np.arange(n), n)[::-1])[::-1]
        next_lost = np.minimum.accumulate(np.where(gone, np.arange(n), n)[::-1])[::-1]
        left, right = (lost > before) | (before < 0), (next_lost < after) | (after == n)
        return gone | (self.blank & left & right)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ords, digests, found = [], [], []
        for ord_, dig, raw, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            keys = np.unique(Anchors(raw, size).key)
            found.append(keys), ords.append(np.full(len(keys), ord_)), digests.extend([dig] * len(keys))
        if digests:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(ords).astype(np.int64)), pa.array(digests, pa.binary())], ["line", "ord", "digest"])


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs sorted by their first, the longest run whose second increases (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    back = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j), piles.append(k)
        else:
            tops[at], piles[at] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _lcs_rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each item of a, an integer whose bit j is 0 where the longest common subsequence with b[: j + 1] grows."""
    masks: dict[int, int] = {}
    for x, bits in _places(b).items():
        row = np.zeros(len(b), np.uint8)
        row[bits] = 1
        masks[x] = int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")
    full = (1 << len(b)) - 1
    now = full
    for x in a:
        hit = now & masks.get(x, 0)
        now = ((now + hit) | (now - hit)) & full
        yield now


def _places(b: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        out.setdefault(x, []).append(j)
    return out


def common_subsequence(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence as aligned places, by bit vectors; a is halved until the kept rows are few."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        here, there = set(a[i:m]), set(b[j:n])
        p, q = [k for k in range(i, m) if a[k] in there], [k for k in range(j, n) if b[k] in here]
        x, y = [a[k] for k in p], [b[k] for k in q]
        if not x:
            continue
        if len(x) > 1 and len(x) * len(y) > LCS_BITS:
            mid = len(x) // 2
            grown = []
            for part, other in ((x[:mid], y), (x[mid:][::-1], y[::-1])):
                for row in _lcs_rows(part, other):
                    last = row
                bits = np.unpackbits(np.frombuffer(last.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
                grown.append(np.r_[0, np.cumsum(bits == 0)])
            cut = int(np.argmax(grown[0] + grown[1][::-1]))
            at = q[cut] if cut < len(q) else n
            todo += [(i, p[mid], j, at), (p[mid], m, at, n)]
            continue
        rows = [r.to_bytes(len(y) // 8 + 1, "little") for r in _lcs_rows(x, y)]
        r, c = len(x), len(y)
        while r and c:
            if rows[r - 1][(c - 1) >> 3] >> ((c - 1) & 7) & 1:
                c -= 1
                continue
            r -= 1
            if r == 0 or rows[r - 1][(c - 1) >> 3] >> ((c - 1) & 7) & 1:
                c -= 1
                out.append((p[r], q[c]))
    return sorted(out)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned line numbers of two documents, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        place: dict[int, int] = {}
        for k in range(j, n):
            place[b[k]] = -1 if b[k] in place else k
        once: dict[int, int] = {}
        for k in range(i, m):
            if place.get(a[k], -1) >= 0:
                once[a[k]] = -1 if a[k] in once else k
        chain = _longest_increasing([(k, place[x]) for x, k in once.items() if k >= 0])
        for k, p in chain:
            todo.append((i, k, j, p))
            out.append((k, p))
            i, j = k + 1, p + 1
        if chain:
            todo.append((i, m, j, n))
        else:
            out += [(i + k, j + p) for k, p in common_subsequence(a[i:m], b[j:n])]
    return sorted(out)


def aligned_blocks(pairs: list[tuple[int, int]]) -> list[list[int]]:
    """The first document's lines of each maximal run of aligned lines."""
    out: list[list[int]] = []
    before = None
    for pair in pairs:
        if before is None or pair != (before[0] + 1, before[1] + 1):
            out.append([])
        out[-1].append(pair[0])
        before = pair
    return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (later, df, later_lines, later_size, earlier_lines, shared) sorted by later and df -> (digest, gone, open):
    a flag for each line, and the shared anchors that no alignment has settled."""
    now, own = None, None
    settled, shared = np.zeros(0, np.int64), set()
    todo: set[bytes] = set()
    rows: list[tuple] = []

    def left() -> set[bytes]:
        """Lines of anchors that are not settled."""
        at = ~np.isin(own.key, settled)
        whole = own.cover(own.key[at]) if at.any() else np.zeros(len(own.lines), bool)
        return {own.lines[i] for i in np.flatnonzero(whole & ~own.blank).tolist()}

    def done() -> None:
        if now is not None:
            rows.append((now, own.cover(settled).tolist(), sorted(shared.difference(settled.tolist()))))

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.list_(pa.bool_()), pa.list_(pa.int64())))], ["digest", "gone", "open"])
        rows.clear()
        return out

    for batch in batches:
        for at in range(batch.num_rows):
            later, _, raw, size, other, keys = (batch.column(i)[at].as_py() for i in range(6))
            if later != now:
                done()
                now, own = later, Anchors(raw, size)
                settled, shared, todo = np.zeros(0, np.int64), set(), left_of_all(own)
            shared.update(keys)
            b = [other[i : i + WIDTH] for i in range(0, len(other), WIDTH)]
            if todo.isdisjoint(b):
                continue  # rarer anchors' owners have settled all
            found = own.inside(aligned_blocks(patience(own.lines, b)))
            if len(found):
                settled = np.union1d(settled, found)
                todo = left()
        yield given()
    done()
    yield given()


def left_of_all(own: Anchors) -> set[bytes]:
    return {x for x, blank in zip(own.lines, own.blank.tolist(), strict=True) if not blank}


def _aligned(pairs: DataFrame, classes: DataFrame, tag: str) -> DataFrame:
    """digest, gone, open of the later documents of pairs (later, earlier, df, shared), written out."""
    lines = classes.select("digest", "lines", "size")
    both = pairs.join(lines.select(F.col("digest").alias("earlier"), F.col("lines").alias("earlier_lines")), "earlier")
    both = both.join(lines.select(F.col("digest").alias("later"), F.col("lines").alias("later_lines"), F.col("size").alias("later_size")), "later")
    both = both.select("later", "df", "later_lines", "later_size", "earlier_lines", "shared").repartition("later").sortWithinPartitions("later", "df", "earlier_lines")
    return materialise(both.mapInArrow(_align, "digest binary, gone array<boolean>, open array<long>"), tag)


def _settled(anchors: DataFrame, classes: DataFrame) -> DataFrame:
    """digest, gone of documents that lose lines to others."""
    owner = anchors.groupBy("line").agg(F.min(F.struct("ord", "digest")).alias("o"), F.count("*").alias("df")).where("df > 1")
    # written out, so that the join deals both sides anew and can split a very common line
    owner = materialise(owner.select("line", F.col("o.digest").alias("owner"), "df"), "owners")
    more = F.collect_list(F.when(F.col("df") > 2, F.col("line"))).alias("shared")  # others than the owner may have it too
    pairs = anchors.join(owner, "line").where("digest <> owner").groupBy(F.col("digest").alias("later"), F.col("owner").alias("earlier")).agg(F.min("df").alias("df"), more)
    rounds = [_aligned(pairs, classes, "round")]
    buckets = BRANCH
    while True:
        still = rounds[-1].select("digest", F.explode("open").alias("line"))
        still = materialise(still.join(classes.select("digest", "ord"), "digest"), "open")
        if still.isEmpty():
            break
        lines = materialise(still.groupBy("line").agg(F.count("*").alias("n")).join(owner, "line"), "lines")
        most, total = lines.agg(F.max("df"), F.sum(F.col("n") * F.col("df"))).first()
        last = buckets >= most or total <= LAST_PAIRS
        rest = anchors.join(if_small(lines.select("line", "owner", "df"), 48), "line").where("digest <> owner")
        if last:
            met = rest.select("line", F.struct("ord", "digest").alias("e"), "df")
        else:
            bucket = F.pmod(F.xxhash64("digest", F.lit(buckets)), F.lit(buckets)).alias("bucket")
            met = rest.groupBy("line", bucket).agg(F.min(F.struct("ord", "digest")).alias("e"), F.max("df").alias("df"))
        pairs = still.withColumnRenamed("digest", "later").join(materialise(met, "met"), "line").where(F.col("e") < F.struct(F.col("ord"), F.col("later").alias("digest")))
        pairs = pairs.groupBy("later", F.col("e.digest").alias("earlier")).agg(F.min("df").alias("df"), F.collect_list("line").alias("shared"))
        rounds.append(_aligned(pairs, classes, "round"))
        if last:
            break
        buckets *= BRANCH
    gone = [r.where(F.exists("gone", lambda g: g)).select("digest", "gone") for r in rounds]
    if len(gone) == 1:
        return gone[0]
    both = gone[0]
    for other in gone[1:]:
        both = both.unionByName(other)
    either = F.reduce("all", F.get("all", F.lit(0)), lambda x, y: F.zip_with(x, y, lambda p, q: p | q))
    return both.groupBy("digest").agg(F.collect_list("gone").alias("all")).select("digest", either.alias("gone"))


def _with_blanks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, lines, size, gone) -> (digest, gone) with the blank lines that go."""
    for batch in batches:
        digests, lines, size, flags = (batch.column(i).to_pylist() for i in range(4))
        out = [Anchors(x, n).closed(np.array(g, bool)).tolist() for x, n, g in zip(lines, size, flags, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(out, pa.list_(pa.bool_()))], ["digest", "gone"])


def removals(docs: DataFrame) -> DataFrame:
    """digest, first_ord, gone (flags by line of the first copy, null: none) of classes that lose lines or have copies."""
    small_batches(docs.sparkSession)
    rows = docs.where("text <> ''").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("ord"), "text")
    rows = rows.mapInArrow(_lines, "ord long, digest binary, lines binary, size binary")
    classes = rows.groupBy("digest").agg(F.min("ord").alias("ord"), F.max("lines").alias("lines"), F.max("size").alias("size"), F.max("ord").alias("last"))
    classes = materialise(classes, "classes")
    anchors = materialise(classes.select("ord", "digest", "lines", "size").mapInArrow(_anchors, "line long, ord long, digest binary"), "anchors")
    gone = classes.select("digest", "lines", "size").join(_settled(anchors, classes), "digest").mapInArrow(_with_blanks, "digest binary, gone array<boolean>")
    return classes.select("digest", F.col("ord").alias("first_ord"), "last").join(gone, "digest", "left").where("gone IS NOT NULL OR last > first_ord").drop("last")


def line_dedup(docs: DataFrame) -> DataFrame:
    """The columns of docs with the kept text (n_chars with its length), and n_lines, n_removed as last columns."""
    names, given = docs.columns, ("n_lines", "n_removed")
    own = [c.lower() if c.lower() in ("doc_id", "text", "n_chars") else f"c{i}" for i, c in enumerate(names)]
    docs = docs.select(*[column(c).alias(n) for c, n in zip(names, own, strict=True)])
    found = removals(docs).select(F.col("digest").alias("__digest"), "first_ord", "gone")
    # written out, so that the join can split a text with very many copies
    found = materialise(found.select("__digest", F.struct("first_ord", "gone").alias("__found")), "found")
    rows = docs.withColumn("__digest", digest(F.col("text"))).join(found, "__digest", "left")
    ord_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    lines = F.split("text", "\n")
    copy = F.coalesce(ord_ > F.col("__found.first_ord"), F.lit(False))
    gone = F.col("__found.gone")
    kept = F.when(copy, F.array().cast("array<string>")).when(gone.isNull(), lines).otherwise(F.filter(lines, lambda x, i: ~F.get(F.col("__found.gone"), i)))
    rows = rows.withColumn("__kept", kept).withColumn("__lines", F.coalesce(F.size(lines), F.lit(0)))
    values = {"text": F.array_join("__kept", "\n")}
    if "n_chars" in own:
        values["n_chars"] = F.when(F.size("__kept") == F.col("__lines"), F.col("n_chars")).otherwise(F.char_length(F.array_join("__kept", "\n"))).cast(docs.schema["n_chars"].dataType)
    same = [values.get(n, F.col(n)).alias(c) for n, c in zip(own, free_names(names, given), strict=True)]
    count = F.when(F.col("text").isNull(), 0).otherwise(F.col("__lines")).alias("n_lines")
    lost = F.when(F.col("text").isNull(), 0).otherwise(F.col("__lines") - F.size("__kept")).alias("n_removed")
    return rows.select(*same, count, lost)


def keep_remaining(docs: DataFrame) -> DataFrame:
    """The rows of docs with the kept text; rows that lost every line go."""
    out = line_dedup(docs).where("n_removed = 0 OR n_removed < n_lines").drop("n_lines", "n_removed")
    return out.toDF(*docs.columns)
