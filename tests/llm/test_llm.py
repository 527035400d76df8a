"""The training-data operators against brute force, on rows with every odd case."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from sievework.llm import common, decontaminate, exact_dedup, jaccard_join, language_id, license_scan, line_dedup, mixing, quality, suffix_dedup, textvec, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, hits string, lines string, block int, comp long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{min(int(rng.paretovariate(0.6)), vocabulary)}" for _ in range(n))


def texts():
    rng = random.Random(11)
    base = [prose(rng, rng.choice([3, 8, 30, 90, 200])) for _ in range(60)]
    out = list(base)
    for t in base[:20]:  # near copies of growing distance
        w = t.split(" ")
        for k in (1, 2, 4):
            copy = list(w)
            for _ in range(min(k, len(w))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            out.append(" ".join(copy))
    long = prose(rng, 30_000)
    passage = prose(rng, 60)
    out += [long, long + " end", passage, f"before {passage} after {prose(rng, 40)}", base[25] + " " + passage, base[3] + "  ", base[3].replace(" ", "\t\n"), base[4].upper()]
    out += [None, None, "", "", " \n\t ", "one", "ONE", "a b c d", "é à ñ ß", "日本語 テキスト", "1234 5678", "aaaa" * 100, "🙂" * 120, "x" * 350]
    return out


def rows():
    out = [(i * 3 % 400 if i % 50 else None, t, ["en", "fr", None][i % 3], [f"s{i % 4}", "s0", None][i % 3], len(t or ""), "k", i, "h", "l", i, i) for i, t in enumerate(texts())]
    out += [out[5], out[5], (out[5][0], "another text under the same id", *out[5][2:]), (None, out[7][1], *out[7][2:])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(found):
    return Counter(found)


# --- shared pieces ----------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    import pyarrow as pa

    column = pa.array([None, "", "A b\x0bc", "a  B", "é x y", "b c"])
    data, off = textvec.text_bytes(column)
    starts, ends, first = textvec.word_spans(data, off)
    got = [[bytes(data[s:e]).lower() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [words(t) for t in column.to_pylist()]
    h = textvec.span_hashes(data, starts, ends)
    flat = [w for ws in got for w in ws]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    parent = list(range(300))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    for most in (0, 10**6):  # by rounds, in one task
        got = {r.node: r.comp for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), one_task=most).collect()}
        assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


# --- 1 ------------------------------------------------------------------------------------------------------------------


def components(pairs):
    """(doc_id, text) rows -> bag of (doc_id, set size, component) by comparing all sets."""
    sets = [shingles(t) for _, t in pairs]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(i)].append(d)
    return bag((d, len(s), (min(low[find(i)]) if low[find(i)] else None) if s else d) for i, ((d, _), s) in enumerate(zip(pairs, sets, strict=True)))


def test_jaccard_components(docs):
    got = bag((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == components([r[:2] for r in rows()])


def test_jaccard_large_group_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 4)
    monkeypatch.setattr(jaccard_join, "SPEAKERS", 2)
    rng = random.Random(5)
    base = prose(rng, 100, 100_000).split(" ")
    pairs = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            w[rng.randrange(100)] = f"z{rng.randrange(10**6)}"
        pairs.append((i, " ".join(w)))
    pairs += [(100 + i, prose(rng, 80)) for i in range(10)]
    frame = spark.createDataFrame(pairs, "doc_id long, text string")
    for rounds in (8, 0):  # without meetings round 2 joins the cells
        monkeypatch.setattr(jaccard_join, "MEETINGS", rounds)
        got = bag((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame).collect())
        assert got == components(pairs)


def test_signature_tree_finds_all_links():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) < p], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for p in (1, 0.95, 0.9, 0.8)]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard_join.is_link(sets[i], sets[j], 80)}
    seen = set()
    jaccard_join.tree_candidates([len(s) for s in sets], [jaccard_join.signature(s) for s in sets], list(range(len(sets))), 80, lambda i, j: bool(seen.add(tuple(sorted((i, j))))))
    assert want and want <= seen and len(seen) < 3 * len(want)
    links = jaccard_join.tree_links(sets, list(range(len(sets))), 80)
    assert {tuple(sorted(p)) for p in links} <= want


def test_keep_one_of_each(docs):
    left = jaccard_join.keep_one_of_each(docs)
    assert left.columns == docs.columns
    got = [r for r in left.collect() if r.doc_id is not None]
    own = {d for d, _, c in components([r[:2] for r in rows()]) if d is not None and d == c}
    assert {r.doc_id for r in got} == own
    assert max(Counter((r.doc_id, r.text) for r in got).values()) == 1


# --- 2 ------------------------------------------------------------------------------------------------------------------


def test_exact_dedup(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d, t, *_ in rows():
        groups[norm(t)].append(d)
    keep = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = bag((d, keep[norm(t)], len(groups[norm(t)]), d == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, *_ in rows())
    assert bag((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()) == want


def test_chunks_cover_the_text(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("ab. !?é🙂") for _ in range(20_000)) + "c" * 9000
    frame = spark.createDataFrame([(text,)], "t string").selectExpr(f"regexp_extract_all(t, '{exact_dedup.CHUNK.replace(chr(92), chr(92) * 2)}', 0) AS c")
    chunks = frame.first().c
    assert "".join(chunks) == text and max(map(len, chunks)) <= exact_dedup.MAX_CHUNK and len(chunks) > 5


# --- 3 ------------------------------------------------------------------------------------------------------------------


def line_rows():
    rng = random.Random(8)
    line = lambda n=8: prose(rng, n, 100_000)
    shared = [line() for _ in range(6)]
    common_line = "this very common line is in most documents"
    out = [(1, "\n".join([line(), *shared, line()])), (2, "\n".join([line(), *shared[1:4], "ok", line()])), (3, "\n".join([line(), "ok", line()]))]
    out += [(10 + i, "\n".join([line(), common_line, line()])) for i in range(6)]
    out += [(30, out[0][1]), (30, out[0][1]), (31, None), (32, ""), (33, "\n\n"), (None, line()), (34, out[1][1] + "  "), (35, "\n".join([shared[0], line(), shared[5], shared[2]]))]
    return out


def plain_alignment(a, b):
    """Patience diff by tables: common ends, the longest increasing run of lines unique in both (its last members as late
    as possible), the gaps; without such lines a longest common subsequence."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in plain_alignment(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return plain_alignment(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    unique = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == b.count(x) == 1]
    if unique:
        best = []
        for k, (_, j) in enumerate(unique):
            best.append(1 + max([best[m] for m in range(k) if unique[m][1] < j], default=0))
        chain, want, before = [], max(best), len(b)
        for k in range(len(unique) - 1, -1, -1):
            if best[k] == want and unique[k][1] < before:
                chain.insert(0, unique[k])
                want, before = want - 1, unique[k][1]
        out, i, j = [], 0, 0
        for k, p in [*chain, (len(a), len(b))]:
            out += [(i + x, j + y) for x, y in plain_alignment(a[i:k], b[j:p])] + ([(k, p)] if k < len(a) else [])
            i, j = k + 1, p + 1
        return out
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if table[i][j] == table[i][j - 1]:
            j -= 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def plain_places(lines):
    """Anchor (a tuple of lines) -> its places (first, end)."""
    out = defaultdict(set)
    size = [min(20, len(x)) for x in lines]
    for i, x in enumerate(lines):
        if len(x) >= 20:
            out[x,].add((i, i + 1))
        elif x:
            ahead = next((j for j in range(i + 1, len(lines) + 1) if sum(size[i:j]) >= 20), None)
            behind = next((j for j in range(i, -1, -1) if sum(size[j : i + 1]) >= 20), None)
            out[tuple(lines[i:ahead])] |= {(i, ahead)} if ahead else set()
            if behind is not None:
                out[tuple(lines[behind : i + 1])].add((behind, i + 1))
    return {k: v for k, v in out.items() if v}


def plain_line_dedup(pairs):
    """The rule by loops over all pairs of documents."""
    order = sorted({(d if d is not None else 2**63 - 1, hashlib.sha256(t.encode()).digest()[:16], t) for d, t in pairs if t}, key=lambda x: x[:2])
    first_of, texts_ = {}, []
    for d, h, t in order:
        if h not in first_of:
            first_of[h] = d
            texts_.append((h, [x.strip(" \t\x0b\x0c\r") for x in t.split("\n")]))
    places = [plain_places(lines) for _, lines in texts_]
    gone = {}
    for k, (h, own) in enumerate(texts_):
        settled = set()
        for e in range(k):
            if places[k].keys() & places[e].keys():
                run, blocks = [], []
                for pair in [*plain_alignment(own, texts_[e][1]), None]:
                    if run and pair != (run[-1][0] + 1, run[-1][1] + 1):
                        blocks.append((run[0][0], run[-1][0] + 1))
                        run = []
                    run.append(pair)
                settled |= {x for x, where in places[k].items() if any(a <= i and j <= b for i, j in where for a, b in blocks)}
        flags = [any(i <= n < j for x in settled for i, j in places[k][x]) for n in range(len(own))]
        full = list(flags)
        for n, x in enumerate(own):
            if not x and any(flags):
                before = next((flags[i] for i in range(n, -1, -1) if own[i] or flags[i]), True)
                after = next((flags[i] for i in range(n, len(own)) if own[i] or flags[i]), True)
                full[n] = flags[n] or before and after
        gone[h] = full
    out = []
    for d, t in pairs:
        if not t:
            out.append((d, t))
            continue
        h, ord_ = hashlib.sha256(t.encode()).digest()[:16], d if d is not None else 2**63 - 1
        out.append((d, "" if ord_ > first_of[h] else "\n".join(x for x, g in zip(t.split("\n"), gone[h], strict=True) if not g)))
    return bag(out)


def test_line_dedup_meets_all_overlapping_documents(spark):
    """Documents that draw few lines in any order: pairs beyond each line's owner matter."""
    x, y, z = (prose(random.Random(i), 8, 100_000) for i in range(3))
    own = lambda i: f"a line of document {i} alone"
    cases = [(1, [x, own(1), y]), (2, [y, own(2), x]), (3, [y, own(3), x])]
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame([(d, "\n".join(t)) for d, t in cases], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    rng = random.Random(21)
    pool = [prose(rng, 7, 100_000) for _ in range(12)] + [f"short {i}" for i in range(8)] + ["", "ok", "a longer short line"]
    pairs = []
    for i in range(120):
        lines = rng.sample(pool, rng.randint(2, 9)) if i % 3 else [rng.choice(pool) for _ in range(rng.randint(2, 12))]
        pairs.append((i, "\n".join(lines[: len(lines) // 2] + [own(i)] * (i % 2) + lines[len(lines) // 2 :])))
    frame = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    assert bag((r.doc_id, r.text) for r in line_dedup.line_dedup(frame).collect()) == plain_line_dedup(pairs)


def test_line_dedup_of_lines_beyond_the_hash_weakness(spark):
    """Thue-Morse words, equal under polynomial hashes modulo a power of two, are different lines and different sets."""
    signs = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = "".join("ab"[i] for i in signs), "".join("ba"[i] for i in signs)
    frame = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {r.n_removed for r in line_dedup.line_dedup(frame).collect()} == {0}
    assert {r.component_id for r in jaccard_join.jaccard_components(frame).collect()} == {1, 2}
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert {r.doc_id: r.n_hits for r in decontaminate.contamination(frame, items).collect()} == {1: 1, 2: 0}


def test_clashing_column_names(spark):
    """Columns that have the names of outputs or of inner columns."""
    names = "__digest __found __kept __lines __again __text n_lines n_removed n_lines_in size size_in source_size target taken copies draws draws_in first_ord gone mark key comp token shard place hits block"
    values = [(i, prose(random.Random(i % 3), 30), "s", *[f"v{i}"] * len(names.split())) for i in range(5)]
    frame = spark.createDataFrame(values, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names.split()))
    bench = spark.createDataFrame([(1, "no such words here at all")], "item_id long, text string")
    out = line_dedup.line_dedup(frame)
    assert len(set(out.columns)) == len(out.columns) == len(frame.columns) + 2 and out.count() == 5
    for kept in (line_dedup.keep_remaining(frame), jaccard_join.keep_one_of_each(frame), decontaminate.keep_clean(frame, bench)):
        assert kept.columns == frame.columns
        assert all(r["__again"] == r["size_in"] == f"v{r.doc_id}" for r in kept.collect()) and kept.count() >= 3
    mixed = mixing.mix(frame)
    assert len(set(mixed.columns)) == len(mixed.columns) and mixed.count() == 5
    rows_ = mixing.mixed_rows(mixed)
    assert len(set(rows_.columns)) == len(rows_.columns) and rows_.count() == mixed.selectExpr("sum(copies)").first()[0]


def test_line_dedup(spark):
    frame = spark.createDataFrame(line_rows(), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(frame).collect() if r.doc_id not in (30, None)}
    assert bag((r.doc_id, r.text) for r in line_dedup.line_dedup(frame).collect()) == plain_line_dedup(line_rows())
    assert got[31] is None and got[32] == "" and got[33] == "\n\n"
    assert "common line" in got[10] and all("common line" not in got[10 + i] for i in range(1, 6))


def test_line_dedup_of_odd_rows(docs):
    got = line_dedup.keep_remaining(docs)
    assert got.columns == docs.columns
    want = plain_line_dedup([r[:2] for r in rows()])
    assert bag((r.doc_id, r.text) for r in line_dedup.line_dedup(docs.select("doc_id", "text")).collect()) == want
    lost = sum(n for (d, t), n in want.items() if t == "") - sum(1 for r in rows() if r[1] == "")
    assert got.count() == len(rows()) - lost


def test_patience_is_increasing_and_equal():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(20))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]


def test_lines_that_repeat_or_are_short(spark):
    rng = random.Random(5)
    line = lambda: prose(rng, 8, 100_000)
    frame_line, passage = "the same long line at both ends", [line() for _ in range(4)]
    verse = [f"{rng.randrange(10**6)} short {i}" for i in range(30)]
    cases = [(10 + i, [frame_line, line(), line(), frame_line], 2 if i else 0) for i in range(5)]
    cases += [(20, [line(), *passage, line()], 0), (21, [line(), *passage, line(), *passage, line()], 8)]
    cases += [(30, [line(), *verse, line()], 0), (31, ["a", *verse, "b"], 30), (32, ["c", *verse, "d", *verse], 60)]
    cases += [(40, [x for p in passage[:2] for x in ("q", p + "!", p + "!")], 0), (41, [*[passage[0] + "!"] * 3, "z", *[passage[1] + "!"] * 3], 6)]
    cases += [(50, ["x1", "y1", "z1"], 0), (51, ["x1", "y1", "w1"], 0)]
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame([(d, "\n".join(x)) for d, x, _ in cases], "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: n for d, _, n in cases}


def test_common_subsequence_is_longest(monkeypatch):
    rng = random.Random(9)
    for bits in (1 << 28, 8):
        monkeypatch.setattr(line_dedup, "LCS_BITS", bits)
        for _ in range(200):
            a, b = ([rng.randrange(4) for _ in range(rng.randrange(20))] for _ in range(2))
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            pairs = line_dedup.common_subsequence(a, b)
            assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


# --- 4 ------------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.95


def plain_statistics(text):
    """The statistics of a text, counted word by word."""
    raw = (text or "").encode()
    found = WORD.findall(raw)
    if not found:
        return [0.0] * quality.FEATURES
    k = len(found)
    turn = lambda a, b: math.asin(math.sqrt(min(1.0, a / max(b, 1.0))))
    of = lambda chars: sum(raw.count(bytes([c])) for c in set(chars))
    upper, digits, marks, signs = of(range(65, 91)), of(range(48, 58)), of(b".,;:?!'\"-"), of(b"#$%&()*+/<=>@[\\]^_`{|}~")
    size = [len(w) for w in found]
    low = Counter(w.lower() for w in found)
    runs = [tuple(w.lower() for w in found[i : i + 3]) for i in range(max(1, k - 2))]
    odd = set(b"#$%&()*+/<=>@[\\]^_`{|}~")
    return [
        math.log(1 + k),
        math.log(sum(size) / k),
        math.log(1 + float(np.std(size))),
        turn(upper, upper + of(range(97, 123))),
        turn(digits, sum(size)),
        turn(marks, sum(size)),
        turn(signs, sum(size)),
        turn(sum(c >= 128 for c in raw), sum(size)),
        math.log(len(low)) / math.log(k + 1),
        turn(max(low.values()), k),
        turn(sum(n <= 3 for n in size), k),
        turn(sum(65 <= w[0] <= 90 for w in found), k),
        turn(sum(w[0] in odd or w[-1] in odd for w in found), k),
        math.log(1 + 100 * raw.count(b"\n") / k),
        turn(len(runs) - len(set(runs)), len(runs)),
    ]


def test_quality_against_plain_densities(spark):
    """Scores by textbook formulas, with a matrix inverse and determinant, from statistics counted in loops."""
    rng = random.Random(17)
    texts_ = [prose(rng, rng.randint(5, 120)).title() + ".\n" * (i % 4) if i % 2 else prose(rng, rng.randint(5, 120), 20) + " #$ 12" * (i % 5) for i in range(150)] + ["", None, "One"]
    label = {i: i % 2 for i in range(150)}
    x = np.array([plain_statistics(t) for t in texts_])
    learned = [i for i in label if zlib.crc32(str(i).encode()) % 3 != 1]
    center = x[learned].mean(0)
    weight = np.array([len(WORD.findall((t or "").encode())) for t in texts_])[:, None]
    x = center + (x - center) * (weight / (weight + quality.RELIABLE))
    own = [x[[i for i in learned if label[i] == c]] for c in (0, 1)]
    pooled = sum(np.cov(o.T, bias=True) * len(o) for o in own) / len(learned)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    both = np.outer(scale, scale)
    density = []
    for o in own:
        cov = (1 - quality.SHRINK_POOLED - quality.SHRINK_ROUND) * np.cov(o.T, bias=True) / both + quality.SHRINK_POOLED * pooled / both + (quality.SHRINK_ROUND * np.trace(pooled / both) / len(scale) + 1e-9) * np.eye(len(scale))
        away = x / scale - o.mean(0) / scale
        density.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) - 0.5 * np.linalg.slogdet(cov)[1] + math.log(len(o)))
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))
    frame = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, c, 0) for i, c in label.items()], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.classify(frame, labels).collect()}
    assert [got[i] for i in range(len(texts_))] == pytest.approx(want.tolist(), abs=1e-6)


def test_quality_of_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows())] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == len(rows())
    assert {r.score for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


# --- 5 ------------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    weights, cap = [(5, 2, 1)[i % 3] for i in range(len(sizes))], [2 * s for s in sizes]
    fixed, out = set(), [0.0] * len(sizes)
    while len(fixed) < len(sizes):
        left = 1.5 * sum(sizes) - sum(cap[i] for i in fixed)
        total = sum(w for i, w in enumerate(weights) if i not in fixed)
        for i in range(len(sizes)):
            out[i] = cap[i] if i in fixed else left * weights[i] / total
        above = {i for i in range(len(sizes)) if out[i] > cap[i]}
        if not above:
            break
        fixed |= above
    return [min(o, c) for o, c in zip(out, cap, strict=True)]


def test_targets_and_quotas():
    rng = random.Random(9)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 10, 1000]) * rng.randint(1, 9) for _ in range(rng.randint(1, 12))]
        assert mixing.targets(sizes) == pytest.approx(plain_targets(sizes))
    draws = np.array([0, 5, 100, 33, 1])
    for shards in (1, 6, 200):
        got = np.zeros((5, shards), int)
        for shard, source, quota in mixing.split_quotas(draws, shards, np.random.default_rng(1)):
            assert (quota > 0).all()
            got[source, shard] = quota
        assert got.sum(1).tolist() == draws.tolist() and np.ptp(got.sum(0)) <= 1


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 400)
    rng = random.Random(10)
    pairs = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["a", "b", "c", "Z", None, "a", "a"])) for i in range(1500)]
    frame = spark.createDataFrame(pairs, "doc_id long, text string, source string")
    mixed = mixing.mix(frame, shards=5)
    got = mixed.collect()
    again = {r.doc_id: (r.copies, r.draws) for r in mixing.mix(frame.repartition(7), shards=5).collect()}
    assert {r.doc_id: (r.copies, r.draws) for r in got} == again and len(got) == 1500
    sizes = {s: sum(len(words(t)) for _, t, x in pairs if x == s) for s in {x for *_, x in pairs}}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, plain_targets([sizes[s] for s in order]), strict=True))
    taken = Counter()
    for r in got:
        assert r.size == len(words(r.text)) and r.taken == r.size * r.copies <= 2 * r.size and len(r.draws) == r.copies
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 60 for s in goal)
    shard = Counter(d.shard for r in got for d in r.draws)
    assert sorted(shard) == [0, 1, 2, 3, 4]
    rows_ = mixing.mixed_rows(mixed).collect()
    assert bag((r.doc_id, r.shard, r.place) for r in rows_) == bag((r.doc_id, d.shard, d.place) for r in got for d in r.draws)
    assert [(r.shard, r.place) for r in rows_] == sorted((r.shard, r.place) for r in rows_)


def test_shards_draw_their_quotas(spark, monkeypatch):
    """Draws by shard and source are the tree's quotas, disjoint within a pass, and make up what is taken."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 200)
    rng = random.Random(13)
    pairs = [(i, prose(rng, rng.randint(1, 40)), rng.choice("aaab") if i % 7 else None) for i in range(1200)]
    frame = spark.createDataFrame(pairs, "doc_id long, text string, source string")
    given = []
    split = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda *a: given.extend(split(*a)) or given)
    sized = mixing._sized(frame)
    sources, plan = mixing._plan(sized.selectExpr("source", "__size AS size", "__hash AS hash"), 7)
    want = Counter({(int(i), shard): int(q) for shard, source, quota in given for i, q in zip(source, quota, strict=True)})
    drawn = [(r.number, r.block, d) for r in plan.collect() for d in r.drawn]
    assert Counter((n, d.shard) for n, _, d in drawn) == want
    assert max(Counter((n, b, d["pass"]) for n, b, d in drawn).values()) == 1
    assert sum(d.part for *_, d in drawn) <= sources.count()
    number = {r.source: r for r in sources.collect()}
    blocks = {(n, b): [d for m, c, d in drawn if (m, c) == (n, b)] for n, b, _ in drawn}
    monkeypatch.setattr(mixing, "split_quotas", split)
    for r in mixing.mix(frame, 7).join(sized.select("doc_id", "__hash"), "doc_id").collect():
        own = number[r.source]
        assert {d.shard for d in r.draws} <= {d.shard for d in blocks.get((own.number, r["__hash"] % own.blocks), [])}
        whole = sum(not d.part for d in blocks.get((own.number, r["__hash"] % own.blocks), []))
        assert whole <= r.copies <= whole + 1


def test_mixing_of_odd_rows(docs, none):
    got = mixing.mix(docs)
    assert got.count() == len(rows()) and "size_in" in got.columns
    assert mixing.mix(none).count() == 0


# --- 6 ------------------------------------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in language_id.identify(docs).collect() if r.held_out]
    assert len(held) > 200 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 for r in held)


def plain_shares(text, tables, total):
    """Shares by expectation-maximisation over the text's trigrams, gram by gram, for the set of the best penalised likelihood
    that leaving out the weakest language reaches."""
    low = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    letter = [97 <= b <= 122 or b >= 128 for b in low]
    low = [b if ok else 32 for b, ok in zip(low, letter, strict=True)]
    grams = [tuple(low[i - 1 : i + 2]) for i in range(1, len(low) - 1) if letter[i]]
    p = {lang: [(t[g] + language_id.SMOOTH) / (total[lang] + language_id.SMOOTH * language_id.BUCKETS) for g in grams] for lang, t in tables.items()}

    def fit(langs):
        share = dict.fromkeys(langs, 1 / len(langs))
        for _ in range(language_id.EM_ROUNDS if len(langs) > 1 else 0):
            mass = [sum(share[x] * p[x][i] for x in langs) for i in range(len(grams))]
            share = {x: share[x] * sum(p[x][i] / mass[i] for i in range(len(grams))) / len(grams) for x in langs}
        return share, sum(math.log(sum(share[x] * p[x][i] for x in langs)) for i in range(len(grams)))

    share, like = fit(sorted(tables))
    while len(share) > 1:
        fewer, other = fit([x for x in share if x != min(share, key=share.get)])
        if other < like - 0.5 * math.log(max(len(grams), 2)):
            break
        share, like = fewer, other
    return {x: v / sum(share.values()) for x, v in share.items()}


def test_language_against_plain_mixtures(spark):
    rng = random.Random(19)
    letters = {"aa": "abc ", "bb": "cde ", "cc": "efg "}
    write = lambda lang, n: "".join(rng.choice(letters[lang]) for _ in range(n))
    values = [(i, write(lang, rng.randint(20, 200)), lang) for i in range(60) for lang in [rng.choice(list(letters))]]
    values += [(100, write("aa", 150) + write("cc", 90), None), (101, "abc", None)]
    tables, total = defaultdict(Counter), Counter()
    for d, text, lang in values:
        if lang and zlib.crc32(str(d).encode()) % 3 != 1:
            padded = [b if 97 <= b <= 122 else 32 for b in text.encode()]
            for i in range(1, len(padded) - 1):
                if padded[i] != 32:
                    tables[lang][tuple(padded[i - 1 : i + 2])] += 1
                    total[lang] += 1
    frame = spark.createDataFrame(values, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: dict(zip(r.langs, r.shares, strict=True)) for r in language_id.identify(frame).collect()}
    for d, text, _ in values:
        assert got[d] == pytest.approx(plain_shares(text, tables, total), abs=1e-4), d
    assert set(got[100]) == {"aa", "cc"}


def test_language_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    en, fr = (next(r.text for r in docs.where(f"lang = '{x}' AND n_chars > 3000").limit(1).collect()) for x in ("en", "fr"))
    langs, log_p = language_id.learn(docs)
    import pyarrow as pa

    best, score, sets, shares = language_id._predict(pa.array([en[:2500] + "\n" + fr[:1200]]), langs, log_p)
    assert best == ["en"] and set(sets[0]) == {"en", "fr"} and 0.5 < score[0] < 0.85


def test_language_of_odd_rows(docs, none):
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows())
    lettered = Counter((r[0], any(c.isalpha() for c in r[1] or "")) for r in rows())
    assert Counter((r.doc_id, r.lang_pred != "und") for r in got) == lettered
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == sum(n for (_, ok), n in lettered.items() if ok)
    assert language_id.identify(none).count() == 0 and language_id.keep_identified(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang IS NULL")).collect()} == {"und"}


# --- 7 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_and_cache(spark, docs, none, tmp_path, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=str(path))
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(str(path))
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    want = bag((r[0], len((r[1] or "").encode()), n := count(r[1] or ""), n > 4096) for r in rows())
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = token_counts.count_tokens(docs, path, cache).collect()
        assert bag((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    special = spark.createDataFrame([(1, "a <|endoftext|> b <s> </s> <unk> [PAD]")], "doc_id long, text string")
    assert token_counts.count_tokens(special, path).first().n_tokens == count("a <|endoftext|> b <s> </s> <unk> [PAD]")
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in rows()})
    assert token_counts.count_tokens(none, path).count() == 0


def test_token_cache_is_found_again(spark, monkeypatch):
    """Without a folder of its own the cache lies in the shared one: a second call encodes only what is new."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    folder = f"{common.shared_dir(spark)}/{token_counts.CACHE}"
    frame = spark.createDataFrame([(i, f"words of text {i} for the cache") for i in range(5)], "doc_id long, text string")
    first = token_counts.count_tokens(frame, path).collect()
    rows_of = lambda: spark.read.parquet(folder).count()
    before = rows_of()
    assert bag(token_counts.count_tokens(frame, path).collect()) == bag(first) and rows_of() == before
    more = frame.unionByName(spark.createDataFrame([(9, "one more text for the cache")], "doc_id long, text string"))
    assert token_counts.count_tokens(more, path).count() == 6 and rows_of() == before + 1


# --- 8 ------------------------------------------------------------------------------------------------------------------


def plain_repeats(pairs):
    """Bag of (doc_id, bytes, removed, runs, digest of the rest) by a table of all windows."""
    order = sorted({(d if d is not None else 2**63 - 1, suffix_dedup.class_number(hashlib.sha256((t or "").encode()).digest()), t or "") for d, t in pairs})
    seen, result = set(), {}
    for d, _, t in order:
        data = t.encode()
        spans = []
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 100
                else:
                    spans.append([i, i + 100])
            seen.add(w)
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + data[at:a], b
        kept += data[at:]
        result[d, t] = (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    return bag((d, *result[d if d is not None else 2**63 - 1, t or ""]) for d, t in pairs)


def overlapping(rng):
    """Texts over few letters and with shifted, nested and periodic repeats."""
    base = "".join(rng.choice("abcd ") for _ in range(1500))
    out = [base, base[300:900], base[:150] + base[140:500], base[200:420] + "#" + base[380:600], "ab" * 400, "ab" * 90 + base[:99], base[:99] + "!" + base[99:198]]
    for _ in range(25):
        parts = [base[a : a + rng.randint(20, 400)] for a in (rng.randrange(1400) for _ in range(rng.randint(1, 4)))]
        out.append("".join(p if rng.random() < 0.8 else p[: len(p) // 2] + "?" + p[len(p) // 2 :] for p in parts))
    return out


def remaining(frame, hot=suffix_dedup.HOT):
    return bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame, hot).collect())


def test_repeats_of_odd_rows(docs, none):
    assert remaining(docs) == plain_repeats([r[:2] for r in rows()])
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [2, 5, 10_000])
def test_overlapping_repeats(spark, hot):
    pairs = list(enumerate(overlapping(random.Random(hot))))
    assert remaining(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3), hot) == plain_repeats(pairs)


def test_a_text_longer_than_a_piece(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(5000))
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.anchors_of(pa.array([text])), strict=True)]
    monkeypatch.setattr(suffix_dedup, "PLACE", 11)
    parts = [np.concatenate(x) for x in zip(*suffix_dedup.anchors_of(pa.array([text])), strict=True)]
    starts = {s for a, b in zip(parts[3], parts[4], strict=True) for s in range(a, b + 1)}
    assert starts == set(range(len(text) - 99)) == {s for a, b in zip(whole[3], whole[4], strict=True) for s in range(a, b + 1)}


def test_suffix_array():
    rng = random.Random(7)
    for _ in range(1500):
        text = [rng.randint(2, 2 + rng.randint(0, 5)) for _ in range(rng.randint(0, 40))] + [1]
        array = suffix_dedup.suffix_array(text)
        assert array == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = suffix_dedup.common_prefixes(text, array)
        for i in range(1, len(text)):
            a, b = text[array[i - 1] :], text[array[i] :]
            assert lcp[i] == next((k for k in range(len(a) + 1) if a[: k + 1] != b[: k + 1]), 0)


# --- 9 ------------------------------------------------------------------------------------------------------------------


def plain_hit(item, text):
    """THRESHOLD of the item's shingles, half the distinct words of its question and of its answer (five at least each)."""
    w, t = words(item), set(words(text))
    if not w:
        return False
    need = shingles(item, min(5, len(w)))
    body = item.rstrip()
    split = len(words(body[: body.rindex("\n")])) if "\n" in body else len(w)
    question, answer = set(w[: max(split, 5)]), set(w[min(split, max(0, len(w) - 5)) :]) if "\n" in body else set()
    near = len(need & shingles(text, len(next(iter(need))))) >= 0.8 * len(need)
    return near and all(not part or len(part & t) >= len(part) / 2 for part in (question, answer))


def test_decontamination_verifies_question_and_answer(spark):
    rng = random.Random(31)
    word = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    question, answer = word(60), word(6)
    long = word(70)
    items = [(7, " ".join(question) + "\n" + " ".join(answer)), (7, " ".join(long)), (None, " ".join(word(20))), (None, " ".join(word(20)))]
    texts_ = [
        " ".join(question + answer),
        " ".join(question + word(6)),  # another answer
        " ".join(question + answer[:3] + word(3)),
        " ".join(question + answer + word(10) + long),
        items[2][1] + " " + items[3][1],
        " ".join(word(500) + long[:35] + word(30) + long[35:] + word(100)),  # words inserted in the middle
        " ".join(word(7)),
    ]
    texts_ += [" ".join(word(k) + question[:33] + word(30) + question[33:] + answer + word(80)) for k in range(0, 140, 9)]
    frame = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    found = {r.doc_id: [h.item_id for h in r.hits] for r in decontaminate.contamination(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {d: [i for i, item in sorted(items, key=lambda x: (x[0] is not None, x)) if plain_hit(item, t)] for d, t in enumerate(texts_)}
    assert found[1] == [] and found[3] == [7, 7] and found[4] == [None, None] and found[5] == [7] and all(found[k] == [7] for k in range(7, len(texts_)))


def test_decontamination(spark, monkeypatch, docs, none):
    rng = random.Random(12)
    items = [(i, "\n".join(prose(rng, n, 500) for n in parts)) for i, parts in enumerate([(30,), (20, 12), (6,), (3,), (40, 2), (9, 9, 9)] * 4)]
    items += [(90, None), (91, ""), (None, prose(rng, 25))]
    texts_ = [prose(rng, rng.choice([5, 60, 400]), 500) for _ in range(80)]
    for _, t in items * 2:
        if t:
            w = t.replace("\n", " ").split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "changed"
            cut = rng.choice([0, 200])
            texts_.append(prose(rng, cut, 500) + " " + " ".join(w).upper() + "\n" + prose(rng, 300, 500))
    pairs = list(enumerate(texts_)) + [(500, None), (501, ""), (None, texts_[-1]), (3, texts_[3])]
    want = []
    for d, t in pairs:
        own = [i for i, item in items if plain_hit(item, t)]
        want.append((d, tuple(sorted(own, key=lambda x: (x is None, x)))))
    frame = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 20_000):  # one group of items, several
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", most)
        assert (len(list(decontaminate.indexes(bench))) > 1) == (most == 20_000)
        found = decontaminate.contamination(frame, bench).collect()
        got = bag((r.doc_id, tuple(sorted((h.item_id for h in r.hits), key=lambda x: (x is None, x)))) for r in found)
        assert got == bag(want)
    clean = decontaminate.keep_clean(frame, bench)
    assert clean.columns == frame.columns and clean.count() == sum(not own for _, own in want)
    assert decontaminate.contamination(docs, bench.limit(0)).count() == len(rows())
    assert decontaminate.keep_clean(docs, bench).columns == docs.columns
    assert decontaminate.contamination(none, bench).count() == 0


# --- 10 -----------------------------------------------------------------------------------------------------------------


def test_licences(spark, docs, none):
    s = license_scan.SENTENCES
    cases = [
        (1, "Text.\nReleased under the MIT License.", {"MIT"}),
        (2, "x y\n" + s["mit_grant"] + "\n\n" + s["mit_notice"] + "\nA sentence between.\n" + s["as_is"], {"MIT"}),
        (3, s["as_is"] + " " + s["mit_grant"] + " " + s["mit_notice"], set()),
        (4, s["apache_header"].replace(" ", "\n") + "\n" + s["apache_comply"], {"Apache-2.0"}),
        (5, "LICENSED   under CC by-nc 4.0. Licensed under the Apache License, Version 2.0.", {"Apache-2.0", "CC-BY-NC-4.0"}),
        (6, s["gpl_free"] + " " + s["gpl3_later"], {"GPL-3.0-or-later"}),
        (7, "released under the MIT licence of thumb", set()),
        (8, None, set()),
        (9, "", set()),
    ]
    frame = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")
    got = {r.doc_id: set(r.licences) for r in license_scan.scan_licences(frame).collect()}
    assert got == {c[0]: c[2] for c in cases}
    assert license_scan.scan_licences(docs).count() == len(rows()) and license_scan.scan_licences(none).count() == 0


def wrapped(name, width=72):
    return "\n".join(textwrap.wrap(license_scan.SENTENCES[name], width))


MIT_FILE = f"""MIT License

Copyright (c) 2020 Foo

{wrapped("mit_grant")}

{wrapped("mit_notice")}

{wrapped("as_is")} IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
ISC_FILE = f"""ISC License

Copyright (c) 2020, Foo

{wrapped("isc_grant")}
"""
BSD_FILE = f"""Copyright (c) 2020, Foo
All rights reserved

{wrapped("bsd_grant")}

1. {wrapped("bsd_source")}

2. {wrapped("bsd_binary")}
"""
GPL_FILE = """    foo - does what it is named for
    Copyright (C) 2020  Foo

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""


def test_wrapped_licences_below_a_copyright_line(spark):
    cases = [("MIT", MIT_FILE), ("ISC", ISC_FILE), ("BSD-2-Clause", BSD_FILE), ("GPL-3.0-or-later", GPL_FILE)]
    cases += [(name, text.replace("\n", "\r\n")) for name, text in cases]
    cases += [(name, "\n".join("# " + x for x in text.split("\n"))) for name, text in cases[:4]]
    cases += [("MIT", "Copyright (c) 2020 Foo\n" + MIT_FILE.split("\n\n", 2)[2]), ("ISC", ISC_FILE.replace("\n\n", "\n"))]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in license_scan.scan_licences(frame).collect()}
    assert got == {i: [name] for i, (name, _) in enumerate(cases)}


def test_every_rule_finds_its_own_text(spark):
    known = license_scan.SENTENCES | license_scan.MORE_SENTENCES
    rules = license_scan.RULES + license_scan.MORE_RULES
    texts = [(name, sep.join(known[s] for s in rule)) for name, rule in rules for sep in (" ", "\n", "\n\n")]
    texts += [(name, "A heading\n\n" + "\n\n".join("\n".join(textwrap.wrap(known[s], 72)) for s in rule)) for name, rule in rules]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in license_scan.scan_licences(frame).collect()}
    assert got == {i: [name] for i, (name, _) in enumerate(texts)}


def test_licences_of_parts_and_longer_rules(spark):
    third = "3. Neither the name of Foo, Inc. nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one.\n"
    cases = [(BSD_FILE, ["BSD-2-Clause"]), (BSD_FILE + "\n" + third, ["BSD-3-Clause"]), (BSD_FILE + "\n" + third + "\n" + BSD_FILE, ["BSD-2-Clause", "BSD-3-Clause"])]
    cases += [(mpl, ["MPL-2.0"]), ("2.0.\nThis Source Code Form is subject to the terms of the Mozilla Public License, v.", [])]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in license_scan.scan_licences(frame).collect()} == {i: names for i, (_, names) in enumerate(cases)}


def test_empty_table(none):
    assert jaccard_join.jaccard_components(none).count() == 0 and jaccard_join.keep_one_of_each(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert line_dedup.keep_remaining(none).count() == 0


def test_numbers_are_finite(spark, docs):
    assert all(math.isfinite(r.score) for r in language_id.identify(docs).collect())
