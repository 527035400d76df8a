"""Exact Jaccard join of word-shingle sets with signature trees.

Equal sets are one class (128-bit key of the sorted shingles). Blocks of classes that may link share a token of their
rare-first prefixes: a pair of Jaccard >= t has a common token among the first n - ceil(t n) + 1 of either set, in any
common order. Within a block, a signature tree over the members (leaves by size; nodes with OR-combined bitmaps, size
ranges and the greatest number of tokens that share a bit) is traversed against itself. A node pair is dropped when the
greatest possible overlap is too small or when all its members already are in one component; leaves are verified on
whole token sets. Links found are a spanning forest of each block's links, so no group emits all its pairs.

Two rounds keep this linear for large groups of near copies. Round 1 sends each class to one block, the smallest hash
of its shared prefix tokens, cut into chunks; some members of the components that this leaves in a block meet again. Round 2 takes every block that still spans two components; cells pair its
largest component's chunks with the rest's, and the rest's with each other, so no link between components is missed.
Round 2's first trees hold signatures alone: only members that they leave in a pair between components, in the first
block that the pair shares, bring their whole sets to a second tree.

Defined cases: A-Z are lowered; texts of fewer words than a shingle are one sequence; null and wordless texts have the
empty set and link with nothing, not even each other; repeated rows are copies; component_id is the smallest non-null
id, null ids keep their row; an empty table gives no rows; further columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, column, connected_components, if_small, materialise, sliced, small_batches
from .textvec import U, mix, pieces, shingle_rows

#: Sketch of token frequencies; a byte for each bucket is broadcast.
SKETCH = 1 << 20
#: Tokens that a task counts at a time; of these, the ones in two sets or more go to the sketch.
COUNTED = 2 << 20
#: Members of one tree at most, and fan-out of its nodes.
CHUNK, FAN = 256, 8
#: Members of a component that meet those of others in a large block, and how often at most.
SPEAKERS, MEETINGS = 8, 8
MAX_BITS = 1 << 14
LAST_ID = (1 << 63) - 1


def set_key(tokens: np.ndarray) -> bytes:
    """128-bit key of a sorted set of tokens."""
    a = mix(tokens).sum(dtype=np.uint64)
    b = mix(tokens ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


def short_key(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, off in pieces(column):
        for tokens in shingle_rows(data, off):
            yield np.unique(tokens)


def _pack(index: np.ndarray, count: np.ndarray) -> bytes:
    return np.stack([index.astype(np.uint32), np.minimum(count, 2**32 - 1).astype(np.uint32)]).tobytes()


FEATURES = "doc_id {id}, mark long, n_shingles long, key binary, short long, sketch binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; sketch rows with the frequencies of tokens that this task saw in several sets."""
    seen: set[bytes] = set()
    pending: list[np.ndarray] = []
    held = 0
    total = np.zeros(SKETCH, np.int64)

    def flush() -> None:
        nonlocal held
        if pending:
            tokens, counts = np.unique(np.concatenate(pending), return_counts=True)
            np.add.at(total, (tokens[counts > 1] & U(SKETCH - 1)).astype(np.int64), counts[counts > 1])
        pending.clear()
        held = 0

    names, id_type = ["doc_id", "mark", "n_shingles", "key", "short", "sketch"], pa.int64()
    for batch in batches:
        id_type, sizes, keys = batch.column(0).type, [], []
        for tokens in _sets(batch.column(2)):
            key = set_key(tokens)
            sizes.append(len(tokens)), keys.append(key)
            if key not in seen:
                seen.add(key)
                pending.append(tokens)
                held += len(tokens)
                if held >= COUNTED:
                    flush()
        short = pa.array([short_key(k) for k in keys], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), short, pa.nulls(len(keys), pa.binary())], names)
    flush()
    index = np.flatnonzero(total)
    none = [pa.nulls(1, t) for t in (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64())]
    yield pa.RecordBatch.from_arrays([*none, pa.array([_pack(index, total[index])], pa.binary())], names)


def _add_sketches(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for x in batch.column("sketch"):
            index, count = np.frombuffer(x.as_buffer(), np.uint32).reshape(2, -1)
            total[index] += count
    index = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([_pack(index, total[index])], pa.binary())], ["salt", "sketch"])


def frequency_levels(features: DataFrame) -> np.ndarray:
    """For each bucket, a byte that grows with the logarithm of its tokens' frequency; fixed size."""
    part = features.where("sketch IS NOT NULL").select(F.pmod(F.xxhash64("sketch"), F.lit(64)).cast("int").alias("salt"), "sketch")
    for _ in range(2):
        part = part.groupBy("salt").applyInArrow(_add_sketches, "salt int, sketch binary")
    total = np.zeros(SKETCH, np.int64)
    for row in part.toLocalIterator():
        index, count = np.frombuffer(row.sketch, np.uint32).reshape(2, -1)
        total[index] += count
    return np.minimum(255, np.round(6 * np.log2(total + 1.0))).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _postings(held, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = held.value, set()
        for batch in batches:
            tokens_out, keys_out, sizes_out = [], [], []
            for tokens in _sets(batch.column(0)):
                if not len(tokens) or (key := set_key(tokens)) in seen:
                    continue
                seen.add(key)
                rank = level[(tokens & U(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << U(56) | mix(tokens) >> U(8)
                want = prefix_length(len(tokens), percent)
                tokens_out.append(tokens[np.argpartition(rank, want - 1)[:want]] if want < len(tokens) else tokens)
                keys_out.append(np.full(want, short_key(key)))
                sizes_out.append(np.full(want, len(tokens)))
            if tokens_out:
                columns = [np.concatenate(tokens_out).view(np.int64), np.concatenate(sizes_out), np.concatenate(keys_out).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "n", "short"])

    return run


def _shared(percent: int) -> Callable:
    """Of rows sorted by (token, n, short): each distinct one with a neighbour of its token of a size that may link.

    In order of size, whatever may link has a next neighbour that may.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # not yet given out
        joined = False  # it may link with the one before
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            if last is not None:
                columns = [np.r_[x, c] for x, c in zip(last, columns, strict=True)]
            if not len(columns[0]):
                continue
            token, n, short = columns
            new = np.r_[True, (token[1:] != token[:-1]) | (short[1:] != short[:-1])]
            token, n, short = token[new], n[new], short[new]
            near = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
            keep = np.r_[joined if last is not None else False, near] | np.r_[near, False]
            joined = bool(near[-1]) if len(near) else joined and last is not None
            last = token[-1], n[-1], short[-1]
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(short[keep])], ["token", "short"])
        if last is not None and joined:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[2]], pa.int64())], ["token", "short"])

    return run


def _class_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (wanted key, text): the token set where the text has that key."""
    for batch in batches:
        keys, sets = [], []
        for want, tokens in zip(batch.column(0).to_pylist(), _sets(batch.column(1)), strict=True):
            if set_key(tokens) == want:
                keys.append(want), sets.append(tokens)
        columns = [pa.array([short_key(k) for k in keys], pa.int64()), pa.array(keys, pa.binary()), pa.array([len(t) for t in sets], pa.int64())]
        columns += [pa.array([signature(t) for t in sets], pa.binary()), pa.array([t.tobytes() for t in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["short", "key", "n", "signature", "tokens"])


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, groups: np.ndarray):
        _, first, inverse = np.unique(groups, return_index=True, return_inverse=True)
        self.parent = first[inverse]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j

    def one(self, a: slice, b: slice) -> bool:
        """Whether all members of both ranges are in one component."""
        root = self.find(a.start)
        return all(self.find(i) == root for i in range(a.start, a.stop)) and (a == b or all(self.find(i) == root for i in range(b.start, b.stop)))


def signature(tokens: np.ndarray) -> bytes:
    """Bitmap of a set, two to four bits for each token within bounds; halves OR-combined give the smaller bitmap."""
    bits = min(MAX_BITS, 1 << max(6, int(2 * len(tokens)).bit_length()))
    out = np.zeros(bits, bool)
    out[(mix(tokens) & U(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def traverse(sizes: list[int], signatures: list[bytes], percent: int, settled: Callable, visit: Callable) -> None:
    """Dual traversal of a signature tree over sets in order of size: visit(a, b), arrays of pairs of sets that may link.

    settled(a, b) tells that no pair of the ranges a and b of sets is of interest.
    """
    size = np.array(sizes)
    widths = np.array([len(s) for s in signatures])
    bits = int(widths.max())
    # a smaller bitmap is repeated: that can only add common bits
    maps = np.frombuffer(b"".join(s * (bits // len(s)) for s in signatures), np.uint64).reshape(len(signatures), -1)
    times = bits // widths
    own = np.bitwise_count(maps).sum(1) // times
    # levels from the leaves up: bitmap, least and greatest size, most tokens that share bits, members below
    levels = [(maps, size, size, size - own, [slice(i, i + 1) for i in range(len(size))])]
    while len(levels[-1][1]) > 1:
        m, low, high, spare, spans = levels[-1]
        at = np.arange(0, len(low), FAN)
        up = [slice(spans[a].start, spans[min(a + FAN, len(low)) - 1].stop) for a in at]
        levels.append((np.bitwise_or.reduceat(m, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at), up))

    def possible(depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m, low, high, spare, _ = levels[depth]
        fits = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        if depth:
            most = np.bitwise_count(m[a] & m[b]).sum(1) + np.minimum(spare[a], spare[b])
            return fits & ((100 + percent) * most >= percent * (low[a] + low[b]))
        # each bit of one set that the other, in a bitmap no finer, lacks is a token that it lacks
        lacks_a = np.where(times[a] <= times[b], np.bitwise_count(m[a] & ~m[b]).sum(1) // times[a], 0)
        lacks_b = np.where(times[b] <= times[a], np.bitwise_count(m[b] & ~m[a]).sum(1) // times[b], 0)
        return fits & ((100 + percent) * np.minimum(size[a] - lacks_a, size[b] - lacks_b) >= percent * (size[a] + size[b]))

    stack = [(len(levels) - 1, 0, 0)] if len(size) > 1 else []
    while stack:
        depth, i, j = stack.pop()
        spans = levels[depth][4]
        if settled(spans[i], spans[j]):
            continue
        n = len(levels[depth - 1][1])
        left, right = np.arange(i * FAN, min(n, i * FAN + FAN)), np.arange(j * FAN, min(n, j * FAN + FAN))
        a, b = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        ok = (a < b) | ((a == b) & (depth > 1))
        a, b = a[ok], b[ok]
        ok = possible(depth - 1, a, b)
        if depth == 1:
            visit(a[ok], b[ok])
        else:
            stack += [(depth - 1, int(x), int(y)) for x, y in zip(a[ok], b[ok], strict=True)]


def is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def tree_links(sets: list[np.ndarray], groups: list, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; those of one group are already joined."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][0]))
    sets, forest, links = [sets[i] for i in order], Forest(np.array([groups[i] for i in order])), []

    def visit(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if forest.find(i) != forest.find(j) and is_link(sets[i], sets[j], percent):
                forest.join(i, j)
                links.append((order[i], order[j]))

    traverse([len(s) for s in sets], [signature(s) for s in sets], percent, forest.one, visit)
    return links


def tree_candidates(sizes: list[int], signatures: list[bytes], groups: list[int], percent: int, wanted: Callable) -> set[int]:
    """Sets that may link with one of another group, of the pairs for which wanted(i, j)."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], groups[i]))
    group, found = np.array([groups[i] for i in order]), set()

    def settled(a: slice, b: slice) -> bool:
        return bool((group[a] == group[a.start]).all() and (group[b] == group[a.start]).all())

    def visit(a: np.ndarray, b: np.ndarray) -> None:
        other = group[a] != group[b]
        for i, j in zip(a[other].tolist(), b[other].tolist(), strict=True):
            x, y = order[i], order[j]
            if not (x in found and y in found) and wanted(x, y):
                found.update((x, y))

    traverse([sizes[i] for i in order], [signatures[i] for i in order], percent, settled, visit)
    return found


def _by_block(width: int, solve: Callable, give: Callable) -> Callable:
    """mapInArrow function over rows sorted by their first two columns: give(solve(rows)) of each run, rows as tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in sliced(batches, CHUNK):
            out: list[tuple] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True):
                if row[:2] != now:
                    out += solve(rows)
                    now, rows = row[:2], []
                rows.append(row)
            yield give(out)
        yield give(solve(rows))

    return run


def _rows_of(schema: pa.Schema) -> Callable:
    return lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_LINK = _rows_of(pa.schema([("a", pa.binary()), ("b", pa.binary())]))
_MEMBER = _rows_of(pa.schema([("block", pa.int64()), ("cell", pa.int64()), ("short", pa.int64()), ("comp", pa.int64())]))


def _forest_of(percent: int) -> Callable:
    """Rows (block, cell, key, comp, tokens); a null comp is a group of its own."""

    def solve(rows: list[tuple]) -> list[tuple]:
        rows = list({r[2]: r for r in rows}.values())  # repeated rows give a class twice
        if len(rows) < 2:
            return []
        groups: dict = {}
        numbers = [groups.setdefault(r[2] if r[3] is None else r[3], len(groups)) for r in rows]
        found = tree_links([np.frombuffer(r[4], np.uint64) for r in rows], numbers, percent)
        return [(rows[a][2], rows[b][2]) for a, b in found]

    return solve


def _candidates_of(percent: int) -> Callable:
    """Rows (block, cell, short, comp, n, signature, blocks) -> those in pairs whose first common block this is."""

    def solve(rows: list[tuple]) -> list[tuple]:
        rows = list({(r[2], r[4]): r for r in rows}.values())
        if len(rows) < 2:
            return []
        blocks = [frozenset(r[6]) for r in rows]
        first = lambda i, j: min(blocks[i] & blocks[j]) == rows[0][0]
        found = tree_candidates([r[4] for r in rows], [r[5] for r in rows], [r[3] for r in rows], percent, first)
        return [rows[i][:4] for i in found]

    return solve


def _cell_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between keys: a spanning forest of each cell of members (block, cell, short, comp), a written table."""
    rows = sets.join(if_small(members, 40), "short").select("block", "cell", "key", "comp", "tokens")
    rows = rows.repartition("block", "cell").sortWithinPartitions("block", "cell")
    return rows.mapInArrow(_by_block(5, _forest_of(percent), _LINK), "a binary, b binary")


def _groups(comps: DataFrame, classes: DataFrame) -> DataFrame:
    """short, comp: the component of each class in one, as a number."""
    return comps.join(classes, comps["node"] == classes["key"]).groupBy("short").agg(F.min(F.xxhash64("comp")).alias("comp"))


def _stars(comps: DataFrame) -> DataFrame:
    return comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).where("a <> b")


def _round_one(shared: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Components (node, comp) by the links of each class's one block.

    A block of over CHUNK members is several cells. While these leave components apart, some members of each component
    meet in cells again; whether they link or not, round 2 sees every pair of components that is left.
    """
    home = shared.groupBy("short").agg(F.min(F.struct(F.xxhash64("token").alias("h"), "token")).alias("m")).select("short", F.col("m.token").alias("block"))
    count = materialise(home.groupBy("block").agg(F.count("*").alias("n")).where("n > 1"), "count")
    cell = F.pmod(F.xxhash64("short"), F.ceil(F.col("n") / CHUNK)).cast("long")
    alone = F.lit(None).cast("long").alias("comp")
    members = materialise(home.join(count, "block").select("block", cell.alias("cell"), "short", alone, "n"), "members")
    comps = connected_components(materialise(_cell_links(members, sets, percent), "links"))
    large = members.where(F.col("n") > CHUNK).select("block", "short")
    if large.isEmpty():
        return comps
    large = materialise(large, "large")
    sets = materialise(sets.join(if_small(large.select("short"), 24), "short", "left_semi"), "large")
    for again in range(MEETINGS):
        rows = large.join(_groups(comps, classes), "short")
        few = rows.withColumn("at", F.row_number().over(Window.partitionBy("block", "comp").orderBy(F.xxhash64("short", F.lit(again))))).where(F.col("at") <= SPEAKERS)
        few = materialise(few.select("block", "comp", "short"), "speakers")
        apart = few.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low <> high").select("block", "n")
        met = few.join(if_small(materialise(apart, "apart"), 32), "block").select("block", F.pmod(F.xxhash64("comp", F.lit(again)), F.ceil(F.col("n") / CHUNK)).cast("long").alias("cell"), "short", "comp")
        found = materialise(_cell_links(materialise(met, "met"), sets, percent), "links")
        before = comps.select("comp").distinct().count()
        comps = connected_components(_stars(comps).unionByName(found))
        if comps.select("comp").distinct().count() == before:
            break
    return comps


def _round_two(shared: DataFrame, sets: DataFrame, classes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    rows = shared.join(_groups(comps, classes), "short", "left").select("token", "short", F.coalesce("comp", "short").alias("comp"))
    rows = materialise(rows, "spanning")
    each = rows.groupBy("token", "comp").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("short")).alias("x"), F.bit_xor(F.xxhash64("short", F.lit(1))).alias("y"))
    block = each.groupBy("token").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("n", "comp")).alias("most")).where("comps > 1")
    # blocks with the same members need one look
    block = block.groupBy("n", "x", "y").agg(F.min(F.struct("token", "most")).alias("t")).select("n", F.col("t.token").alias("token"), F.col("t.most.comp").alias("main"), F.col("t.most.n").alias("n_main"))
    size = F.lit(CHUNK)
    m = rows.join(block, "token").withColumn("rest", F.ceil((F.col("n") - F.col("n_main")) / size)).withColumn("mains", F.ceil(F.col("n_main") / size))
    hash_ = F.xxhash64("short")
    own = F.when(F.col("comp") == F.col("main"), F.col("rest") + F.pmod(hash_, F.col("mains"))).otherwise(F.pmod(hash_, F.col("rest"))).cast("long")
    m = m.withColumn("own", own)
    all_cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rest") + F.col("mains") - 1), lambda j: F.least(j, "own") * (F.col("rest") + F.col("mains")) + F.greatest(j, "own"))
    main_cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1), lambda i: i * (F.col("rest") + F.col("mains")) + F.col("own"))
    cells = F.when(F.col("n") <= 2 * CHUNK, F.array(F.lit(-1).cast("long"))).when(F.col("comp") == F.col("main"), main_cells).otherwise(all_cells)
    m = materialise(m.select(F.col("token").alias("block"), "short", "comp", cells.alias("cells")), "blocks")
    listed = m.groupBy("short").agg(F.collect_list("block").alias("blocks"))  # at most a set's prefix
    known = sets.select("short", "n", "signature").join(listed, "short")
    members = m.select("block", F.explode("cells").alias("cell"), "short", "comp")
    rows = members.join(known, "short").select("block", "cell", "short", "comp", "n", "signature", "blocks")
    rows = rows.repartition("block", "cell").sortWithinPartitions("block", "cell")
    active = rows.mapInArrow(_by_block(7, _candidates_of(percent), _MEMBER), "block long, cell long, short long, comp long")
    return _cell_links(materialise(active, "active"), sets, percent)


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component), class_key, mark (hash of the text): one row per
    document."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    features = materialise(pairs.mapInArrow(_features, FEATURES.format(id=kind)), "features")
    rows = features.where("sketch IS NULL").select("doc_id", "mark", "n_shingles", "key", "short")
    levels = frequency_levels(features)
    held = checked_broadcast(docs.sparkSession, levels, levels.nbytes, "the token sketch")

    postings = docs.select("text").mapInArrow(_postings(held, percent), "token long, n long, short long")
    shared = materialise(postings.repartition("token").sortWithinPartitions("token", "n", "short").mapInArrow(_shared(percent), "token long, short long"), "shared")

    classes = rows.where("n_shingles > 0").groupBy("key", "short").agg(F.min("doc_id").alias("first_id"), F.min_by("mark", F.coalesce("doc_id", F.lit(LAST_ID))).alias("mark"))
    classes = materialise(classes, "classes")
    # one row of each class, by its id and its text's hash: ids may be missing or shared
    wanted = classes.join(shared.select("short").distinct(), "short").select(F.coalesce("first_id", F.lit(LAST_ID)).alias("id"), "mark", "key")
    texts = pairs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "mark", "text").join(wanted.hint("shuffle_hash"), ["id", "mark"]).select("key", "text")
    sets = materialise(texts.mapInArrow(_class_sets, "short long, key binary, n long, signature binary, tokens binary"), "sets")

    comps = _round_one(shared, sets, classes, percent)
    second = materialise(_round_two(shared, sets, classes, comps, percent), "links")
    comps = connected_components(_stars(comps).unionByName(second))

    named = classes.join(comps, classes["key"] == comps["node"], "left").select("key", "first_id", F.coalesce("comp", "key").alias("comp"))
    named = materialise(named, "named")
    lowest = materialise(named.groupBy("comp").agg(F.min("first_id").alias("component_id")), "lowest")
    by_class = named.join(lowest, "comp").select("key", "component_id")
    full = rows.where("n_shingles > 0").join(by_class, "key").select("doc_id", "n_shingles", "component_id", F.hex("key").alias("class_key"), "mark")
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("string").alias("class_key"), "mark")
    return full.unionByName(empty)


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The whole rows of docs whose doc_id is the smallest of its component; rows that share id and text count once.

    Rows without an id stay: they can't be told apart by one. Columns are kept whatever their names.
    """
    own = [c.lower() if c.lower() in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)]
    rows = docs.select(*[column(c).alias(n) for c, n in zip(docs.columns, own, strict=True)])
    found = jaccard_components(rows.select("doc_id", "text"), percent).where("doc_id = component_id")
    found = materialise(found.groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("m")).agg(F.count("*").alias("n")), "kept")
    met = lambda some: (F.col("doc_id") == some["id"]) & F.xxhash64("text").eqNullSafe(some["m"])
    one, more = found.where("n = 1"), found.where("n > 1")
    once = rows.join(one, met(one), "left_semi")
    if not more.isEmpty():  # only rows that share id and text are ordered
        again = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
        once = once.unionByName(rows.join(more, met(more), "left_semi").withColumn("__again", again).where("__again = 1").drop("__again"))
    return once.unionByName(rows.where("doc_id IS NULL")).toDF(*docs.columns)
