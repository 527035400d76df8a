"""Operators against brute force on small rows."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from sievework.operators import components, dedup, review, scoring, select, sessions
from sievework.params import DEFAULT


def roots_of(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_hamming_bands_find_all_pairs(spark):
    rng = random.Random(1)
    hashes = []
    while len(hashes) < 120:
        base = rng.getrandbits(64)
        for _ in range(6):
            h = base
            for bit in rng.sample(range(64), rng.choice([0, 1, 4, 5, 8, 9])):
                h ^= 1 << bit
            hashes.append(h)
    folders = [rng.choice("ab") for _ in hashes]
    frame = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF, f) for i, (h, f) in enumerate(zip(hashes, folders, strict=True))], "ord long, hi long, lo long, folder string")
    limit = lambda i, j: 8 if folders[i] == folders[j] else 4
    want = {(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= limit(i, j)}
    assert {tuple(r) for r in dedup.hamming_pairs(frame, 8, 4).collect()} == want
    assert {(a, b) for a, b, _ in dedup.hamming_pairs(frame, 8).collect()} == {(a, b) for a, b, _ in want if folders[a] == folders[b]}
    links = dedup.hamming_links(frame, 8, 4)
    clustered = dedup.clusters(frame, links)
    root = roots_of(len(hashes), [(a, b) for a, b, _ in want])
    firsts = sorted({r for r in root if root.count(r) > 1})
    got = {r.ord: (r.cluster_id, r.is_best) for r in clustered.collect()}
    assert got == {i: (firsts.index(r) + 1, i == r) if root.count(r) > 1 else (None, True) for i, r in enumerate(root)}


def test_pairs_and_members_make_all_links(spark):
    rng = random.Random(6)
    hashes = [rng.getrandbits(64) for _ in range(4)]
    hashes += [hashes[0] ^ 0b111, hashes[0] ^ 0b111111]
    rows = [(i, h >> 32, h & 0xFFFFFFFF, f"f{rng.randrange(2)}") for i, h in enumerate(rng.choice(hashes) for _ in range(60))]
    frame = spark.createDataFrame(rows, "ord long, hi long, lo long, folder string")
    distance = lambda x, y: (x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count()
    want = {(x[0], y[0], distance(x, y)) for x in rows for y in rows if x[0] < y[0] and distance(x, y) <= (8 if x[3] == y[3] else 4)}
    first = {r.ord: r.first for r in dedup.members(frame).collect()}
    assert set(first) == {r[0] for r in rows}
    near = {(a, b): d for a, b, d in dedup.hamming_pairs(dedup.representatives(frame), 8, 4).collect()}
    near |= {(f, f): 0 for f in first.values()}
    got = {(a, b, near[min(p), max(p)]) for a in first for b in first if a < b and (min(p := (first[a], first[b])), max(p)) in near}
    assert got == want and len(want) > len(near)


def test_components_of_a_chain(spark):
    frame = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in components.connected_components(frame).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_moments_at_the_gap(spark):
    start = datetime(2024, 1, 1, 23, 40)
    steps = [0, 30 * 60, 30 * 60 + 1, 5, 3 * 3600, 60]
    times, at = [], start
    for s in steps:
        at += timedelta(seconds=s)
        times.append(at)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "ord long, ts timestamp_ntz")
    got = [r.moment_id for r in sessions.moments(frame, "ts", "ord").orderBy("ord").collect()]
    assert got == [1, 1, 2, 2, 3, 3]


def test_moments_over_buckets(spark):
    rng = random.Random(5)
    at, rows = datetime(2024, 3, 1), []
    for i in range(500):
        at += timedelta(minutes=rng.choice([1, 5, 20, 30, 31, 200]))
        rows.append((i, at))
    want, number = [], 1
    for (_, a), (_, b) in zip(rows, rows[1:], strict=False):
        want.append(number)
        number += b - a > timedelta(minutes=30)
    want.append(number)
    frame = spark.createDataFrame(rows, "ord long, ts timestamp_ntz")
    assert [r.moment_id for r in sessions.moments(frame, "ts", "ord").orderBy("ord").collect()] == want


def keepers(group, k):
    """The rule as a loop: the best, then the next of another kind, then what follows; passed-over ones last."""
    ordered = sorted(group, key=lambda r: (-r[1], r[0]))
    if len(ordered) <= k:
        return {r[0] for r in ordered}
    kept, passed, rest = [ordered[0]], [], list(ordered[1:])
    while rest and rest[0][2] == kept[0][2]:
        passed.append(rest.pop(0))
    order = kept + rest + passed if rest else ordered
    return {r[0] for r in order[:k]}


def test_burst_keepers(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(60):
        group = [(i, float(rng.randint(0, 5)), rng.choice("xy")) for i in range(1, rng.randint(2, 9))]
        rows += [(g, i, s, t) for i, s, t in group]
        want[g] = keepers(group, DEFAULT.burst_keep)
    frame = spark.createDataFrame(rows, "g int, burst_pos int, blur_score double, kind string").withColumn("none", F.lit(None).cast("double"))
    got = {}
    for r in sessions.burst_keepers(frame, ["g"], "kind", "blur_score", "none").where("kept").collect():
        got.setdefault(r.g, set()).add(r.burst_pos)
    assert got == want


def greedy_fold(rows, n, moment_cap, shot_cap):
    used, out = {}, []
    for t, m, s, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        keys = [("m", m, moment_cap)] * (m not in (None, "unknown")) + [("s", s, shot_cap)] * (s not in (None, "unknown"))
        if len(out) < n and all(used.get(k[:2], 0) < k[2] for k in keys):
            out.append(t)
            for k in keys:
                used[k[:2]] = used.get(k[:2], 0) + 1
    return out


def test_greedy_under_two_quotas(spark):
    rng = random.Random(3)
    for moments, n, cap, shot_cap in [(4, 30, 3, 12), (200, 40, 2, 16), (10, 25, 1, 25)]:
        rows = [(i, rng.choice([f"m{rng.randint(1, moments)}", "unknown", None]), rng.choice(["a", "b", "c", "unknown"]), rng.randint(0, 50) / 50) for i in range(700)]
        frame = spark.createDataFrame(rows, "ord long, m string, s string, score double")
        got = [r.ord for r in select.greedy(frame, n, "m", cap, "s", shot_cap, "score", "ord").orderBy("selection_rank").collect()]
        assert got == greedy_fold(rows, n, cap, shot_cap)


def test_mmr_matches_the_plain_loop(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(80, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    score = rng.integers(0, 40, 80) / 40
    rows = [(i, float(score[i]), vectors[i].tolist() if i % 7 else None, f"m{i % 5}", f"s{i % 3}") for i in range(80)]
    frame = spark.createDataFrame(rows, "ord long, score double, e array<double>, m string, s string")

    def plain(n, weight, caps):
        order = sorted(range(80), key=lambda i: (-score[i], i))
        picked, used = [], {}
        while len(picked) < n:
            best, at = -1e9, None
            for i in order:
                if i in picked or (caps and (used.get(rows[i][3], 0) >= caps[0] or used.get(rows[i][4], 0) >= caps[1])):
                    continue
                having = [j for j in picked if rows[j][2] is not None]
                near = max(vectors[i] @ vectors[j] for j in having) if having and rows[i][2] is not None else 0.0
                value = weight * score[i] - (1 - weight) * near
                if value > best + 1e-12:
                    best, at = value, i
            if at is None:
                break
            picked.append(at)
            for k in rows[at][3:]:
                used[k] = used.get(k, 0) + 1
        return picked

    got = select.diverse(frame, 20, "score", "e", "ord").orderBy("selection_rank").collect()
    assert [r.ord for r in got] == plain(20, 0.7, None)
    got = select.diverse(frame, 20, "score", "e", "ord", moment="m", moment_cap=3, shot="s", shot_cap=5).orderBy("selection_rank").collect()
    assert [r.ord for r in got] == plain(20, 0.7, (3, 5))
    got = select.diverse(frame, 20, "score", "e", "ord", weight=1.0).orderBy("selection_rank").collect()
    assert [r.ord for r in got] == sorted(range(80), key=lambda i: (-score[i], i))[:20]


def test_mmr_in_rounds_is_exact(spark):
    """Few rows in a round, vectors of any length and sign, quotas: the picks are those of one pass over all rows."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(300, 5)) * rng.uniform(0.2, 3, (300, 1))
    score = rng.integers(0, 25, 300) / 25
    rows = [(i, float(score[i]), vectors[i].tolist() if i % 11 else None, f"m{i % 30}" if i % 13 else None, f"s{i % 4}") for i in range(300)]
    frame = spark.createDataFrame(rows, "ord long, score double, e array<double>, m string, s string")
    quotas = {"moment": "m", "moment_cap": 4, "shot": "s", "shot_cap": 18}
    for given in ({}, quotas):
        whole = select.diverse(frame, 60, "score", "e", "ord", batch=300, **given).collect()
        assert len(whole) == 60
        for batch in (1, 7, 90):
            got = select.diverse(frame, 60, "score", "e", "ord", batch=batch, **given).collect()
            assert [(r.ord, r.selection_rank, r.mmr_score) for r in got] == [(r.ord, r.selection_rank, r.mmr_score) for r in whole]


def test_hamming_candidates_stay_near_linear(spark):
    """Unlike hashes seldom meet: candidates per row hardly grow with the rows."""
    from sievework.functions import vectors as v

    rng = random.Random(3)
    for limit, most in ((8, 1), (4, 1)):
        assert limit // dedup.band_count(limit) == most
        cuts = v.band_cuts(dedup.band_count(limit))
        near = sum(len(v.flips(b - a, most)) for a, b in zip(cuts, cuts[1:], strict=False))
        expected = sum(len(v.flips(b - a, most)) / 2 ** (b - a) for a, b in zip(cuts, cuts[1:], strict=False))
        assert near < 100 and expected < 0.011  # of all pairs
    hashes = [rng.getrandbits(64) for _ in range(3000)]
    hashes[7] = hashes[2999] ^ 0b10110101
    frame = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF, None if i == 7 else "f") for i, h in enumerate(hashes)], "ord long, hi long, lo long, folder string")
    assert {tuple(r) for r in dedup.hamming_pairs(frame.fillna("f"), 8).collect()} == {(7, 2999, 5)}
    assert dedup.hamming_pairs(frame, 8, 4).collect() == []
    assert {tuple(r) for r in dedup.hamming_pairs(frame, 8, 5).collect()} == {(7, 2999, 5)}


def test_statistics_over_many_values(spark, monkeypatch):
    from sievework.operators import report

    monkeypatch.setattr(report, "BUCKETS", 4)
    monkeypatch.setattr(report, "MIDDLE_ROWS", 3)
    rng = random.Random(2)
    for values in ([], [0.5], [1.0, 2.0], [rng.choice([0.0, rng.random(), 7.0]) for _ in range(501)], [rng.random() for _ in range(200)], [3.0] * 50):
        frame = spark.createDataFrame([(v,) for v in [*values, None]], "score double")
        got = report.statistics(frame, "score").first()
        assert (got.n, got.middle) == (len(values), float(np.median(values)) if values else 0.0)


def test_compared_bursts(spark):
    rows = [(i, f"p{i}", g, "surviving" if i != 3 else "rejected_burst", 0.4 if i % 2 else 0.0, None) for i, g in enumerate([1, 1, 1, 1, 1, 1, 2, 2, 3, None, 4, 4])]
    frame = spark.createDataFrame(rows, "ord long, path string, burst_group_id int, status string, emotion_score double, burst_llm_rank int")
    subsets = {(r.burst_group_id, r.place): (r.ord, r.n) for r in scoring.burst_subsets(frame).collect()}
    assert subsets == {(1, 1): (0, 4), (1, 2): (1, 4), (1, 3): (2, 4), (1, 4): (4, 4), (2, 1): (6, 2), (2, 2): (7, 2), (4, 1): (10, 2), (4, 2): (11, 2)}
    ranks = spark.createDataFrame([(1, "```json\n[4, 1, 2, 3]\n```"), (2, "[2, 2]"), (4, "no list")], "burst_group_id int, reply string")
    got = {r.ord: (r.burst_llm_rank, round(r.burst_emotion_score, 6)) for r in scoring.compared_bursts(frame, ranks).collect()}
    assert [got[i] for i in (4, 0, 1, 2)] == [(1, 0.575), (2, 0.525), (3, 0.38), (4, 0.475)]
    assert got[7] == (2, round(0.4 * 1.15 * 1.05, 6)) and got[6] == (None, 0.0) and got[10] == (None, 0.0) and got[3] == (None, 0.4)


def test_aesthetic_models_fall_back(spark):
    frame = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"22"))], "path string, content binary")
    broken, fails = scoring.Scorer("x", lambda: 1 / 0), scoring.Scorer("x", lambda: lambda content: 1 / (len(content) - 1))
    fixed = lambda v: scoring.Scorer("x", lambda: lambda content: v)
    got = lambda *models: [tuple(r)[1:] for r in scoring.aesthetics(frame, *models).orderBy("path").collect()]
    assert got() == [(0.5, 0.5, "brisque", 0.5, "brisque", None)] * 2
    assert got(fixed(0.2), broken, fixed(0.3), broken) == [(0.2, 0.3, "nima", 0.3, "nima", None)] * 2
    assert got(fails, fails, fixed(0.3), fails) == [(0.5, 0.5, "brisque", 0.5, "brisque", None), (1.0, 1.0, "laion", 1.0, "laion", 1.0)]
    assert got(fixed(0.2), scoring.Scorer("x", fails.load, 0.5))[0][:3] == (0.2, 0.5, "laion")


def test_model_calls_stop_after_many_failures(spark):
    frame = spark.createDataFrame([(f"p{i:02}", bytearray(b"x" * i)) for i in range(20)], "path string, content binary").coalesce(1)

    def ask(content):
        if len(content) >= 3:
            raise ConnectionError
        return '{"emotion": 8, "memorability": 5}' if len(content) else "nothing to read"

    got = {r.path: (r.emotion_score, r.llava_fallback) for r in scoring.with_ratings(scoring.call_model(frame, ask, breaker=4)).collect()}
    assert got["p00"] == (0.5, True) and got["p01"] == got["p02"] == (0.8, False)
    assert all(got[f"p{i:02}"] == (0.5, True) for i in range(3, 7)) and all(got[f"p{i:02}"] == (None, None) for i in range(7, 20))


def test_review_progress(spark, tmp_path):
    path = str(tmp_path / "progress.json")
    assert review.read_progress(spark, path) is None
    people = [{"letter": "B", "name": "Bo", "color": "#fff"}]
    rows = spark.createDataFrame([("a", "approved", ["Bo"]), ("b", "unreviewed", []), ("c", "rejected", None)], "path string, status string, person_tags array<string>")
    for _ in range(2):
        review.save_progress(rows, people, path)
    found, reviews = review.read_progress(spark, path)
    assert found == people and {r.path: (r.status, r.person_tags) for r in reviews.collect()} == {"a": ("approved", ["Bo"]), "b": ("unreviewed", []), "c": ("rejected", [])}
    assert review.resume_counts(spark.range(5), reviews).first() == (2, 3)
    (tmp_path / ".progress.json.crc").unlink(missing_ok=True)
    (tmp_path / "progress.json").write_text("{broken")
    assert review.read_progress(spark, path) is None


def test_review_fold(spark):
    rng = random.Random(6)
    events, state = [], {}
    for seq in range(300):
        path, action = f"p{rng.randint(0, 9)}", rng.choice(["status", "cycle", "toggle"])
        arg = rng.choice(["approved", "rejected", "unreviewed"]) if action == "status" else rng.choice("xyz") if action == "toggle" else None
        events.append((seq, path, action, arg))
        status, tags = state.get(path, ("unreviewed", []))
        if action == "status":
            status = arg
        elif action == "cycle":
            status = "unreviewed" if status == "approved" else "approved"
        else:
            tags = [t for t in tags if t != arg] if arg in tags else [*tags, arg]
        state[path] = (status, tags)
    frame = spark.createDataFrame(events, "seq long, path string, action string, arg string")
    assert {r.path: (r.status, r.person_tags) for r in review.fold(frame).collect()} == state


def test_people_letters():
    people = review.People()
    people.add("b", "Bo")
    for letter, name in [("a", "x"), ("B", "x"), ("C", " "), ("12", "x")]:
        try:
            people.add(letter, name)
        except ValueError:
            continue
        raise AssertionError(letter)


def test_scorers_and_reweight(spark):
    frame = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "path string, content binary")
    broken = scoring.Scorer("x", lambda: lambda content: 1 / 0, 0.5)
    assert [r.s for r in scoring.run_scorer(frame, broken, "s").collect()] == [0.5, 0.5]
    once = scoring.run_scorer(frame, scoring.stub("x"), "s")
    assert {r.path: r.s for r in once.collect()} == {r.path: r.s for r in scoring.run_scorer(frame, scoring.stub("x"), "s").collect()}


def test_global_index(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = dedup.global_index(frame, "i", "x").collect()
    assert all(r.i == r.x for r in got) and len(got) == 1000


def test_enrichment(spark):
    from sievework.operators import enrich

    records = spark.createDataFrame([("a", "pass", "surviving", 60, 40), ("b", "soft_blur", "soft_blur_surviving", 60, 40), ("c", "pass", "rejected_duplicate", 60, 40), ("d", "pass", "surviving", 40, 40)], "path string, blur_tier string, status string, width int, height int")
    persons = spark.createDataFrame([("ann", [1.0, 0.0], ["s"]), ("bob", [0.9, 0.1], ["s"])], "name string, embedding array<double>, sources array<string>")
    face = lambda e, smile=0.2, eyes=2: {"x": 1, "y": 2, "w": 3, "h": 4, "embedding": e, "smile": smile, "eyes": eyes}
    known = {b"a": [face([1.0, 0.0], 0.9), face([0.0, 1.0], 0.1, 1)], b"b": [], b"c": [face([1.0, 0.0])]}
    content = spark.createDataFrame([(x, bytearray(x.encode())) for x in "abcd"], "path string, content binary")
    faces = enrich.detect(content, lambda: lambda data: known[data])
    rows = {r.path: r for r in enrich.enriched(records, faces, persons, [("ann", "bob")], ["ann"]).collect()}
    a = rows["a"]
    assert (a.faces_detected, a.persons_matched, a.confusion_warning, a.shot_type, a.max_smile_score, a.has_closed_eyes, a.has_ann) == (2, ["ann"], True, ["couple"], 0.9, True, True)
    assert (rows["b"].faces_detected, rows["b"].shot_type, rows["b"].primary_shot_type) == (0, ["candid", "venue"], "candid")
    assert (rows["c"].faces_detected, rows["c"].persons_matched, rows["c"].face_bboxes) == (0, [], None)
    assert rows["d"].faces_detected is None and rows["d"].shot_type == ["unknown"]
    again = enrich.resumed(content, faces, lambda: lambda data: [])
    assert {r.path: len(r.faces) for r in again.where("NOT failed").collect()} == {"a": 2, "b": 0, "c": 1, "d": 0}
    assert not enrich.matching_enabled(["me"], "me") and enrich.matching_enabled(["me", "x"], "me")
    prompts = spark.createDataFrame([(0, "Birthday Party", [1.0, 0.0]), (1, "beach", [0.0, 1.0]), (2, "x", [-1.0, 0.0])], "idx int, label string, embedding array<float>")
    pictures = spark.createDataFrame([("a", [3.0, 1.0])], "path string, embedding array<float>")
    tags = {r.path: r.clip_event_tags for r in enrich.with_event_tags(records, pictures, prompts).collect()}
    assert tags == {"a": ["birthday_party", "beach"], "b": [], "c": [], "d": []}
    assert [r.match for r in enrich.verify(pictures, persons, "ann").collect()] == [True]


def test_moments_by_time_or_folder(spark):
    from dataclasses import replace

    rows = [(0, "/p/Day One/a.jpg", "surviving", None), (1, "/p/x/b.jpg", "surviving", datetime(2024, 1, 1)), (2, "/p/x/c.jpg", "rejected_dark", datetime(2024, 1, 1)), (3, "/p/Z/d.jpg", "soft_blur_surviving", None), (4, "/p/day one/e.jpg", "surviving", None)]
    frame = spark.createDataFrame(rows, "ord long, path string, status string, capture_time timestamp_ntz")
    got = {r.ord: (r.moment_id, r.moment_label) for r in sessions.with_moments(frame).collect()}
    assert got == {0: (10001, "day_one"), 1: (1, "moment_01"), 2: (None, "unknown"), 3: (10002, "z"), 4: (10001, "day_one")}
    got = {r.ord: r.moment_label for r in sessions.with_moments(frame, replace(DEFAULT, folder_fallback=False)).collect()}
    assert got == {0: "unknown", 1: "moment_01", 2: "unknown", 3: "unknown", 4: "unknown"}


def near_copies(rng, n, flips):
    """ord, hi, lo, folder of n rows: copies and near copies of a few hashes, some without a folder."""
    bases = [rng.getrandbits(64) for _ in range(6)]
    hashes = []
    for _ in range(n):
        h = rng.choice(bases)
        for bit in rng.sample(range(64), rng.choice(flips)):
            h ^= 1 << bit
        hashes.append(h if rng.random() < 0.7 or not hashes else rng.choice(hashes))
    return [(i, h >> 32, h & 0xFFFFFFFF, rng.choice(["a", "b", "c", None])) for i, h in enumerate(hashes)]


def near_rows(rows, same, cross):
    distance = lambda x, y: (x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count()
    limit = lambda x, y: same if x[3] is not None and x[3] == y[3] else -1 if cross is None else cross
    return sorted((x[0], y[0], distance(x, y)) for i, x in enumerate(rows) for y in rows[i + 1 :] if distance(x, y) <= limit(x, y))


def test_hamming_cells_against_all_pairs(monkeypatch):
    """In groups and without, in one block or several, packed in parts: each pair is found once."""
    import pyarrow as pa

    from sievework.functions import vectors as v
    from sievework.operators import near

    rng = random.Random(11)
    monkeypatch.setattr(near, "PACK_ROWS", 150)
    monkeypatch.setattr(near, "BLOB_ROWS", 7)
    monkeypatch.setattr(near, "OUT_ROWS", 50)
    rows = near_copies(rng, 400, [0, 1, 2, 4, 5])
    schema = pa.schema([("ord", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("folder", pa.string())])
    given = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 90], strict=True), schema.types, strict=True)], schema=schema) for at in range(0, 400, 90)]
    for few, many, (same, cross) in ((0, 1, (8, 4)), (20, 60, (8, 4)), (2000, 400, (8, 3)), (0, 40, (8, None)), (0, 1, (0, None)), (0, 30, (3, 5)), (5, 50, (4, 0))):
        monkeypatch.setattr(near, "FEW", few)
        limit = max(same, cross or 0)
        cuts = v.band_cuts(2 * dedup.band_count(limit + 1))
        sizes = {}
        for batch in near._counter(cuts, limit, cross is None, 1)(iter(given)):
            for r in batch.to_pylist():
                key = r["band"], r["value"], r["name"]
                sizes[key] = sizes.get(key, 0) + r["n"]
        assert sum(sizes.values()) == (limit + 1) * (len(rows) if cross is not None else sum(r[3] is not None for r in rows))
        blocks = {key: -(-n // many) for key, n in sizes.items() if 1 < many < n}
        packs = [r for batch in near._packer(cuts, limit, cross is None, blocks)(iter(given)) for r in batch.to_pylist()]
        packs.sort(key=lambda r: tuple(r[c] or 0 if c != "name" else r[c] or "" for c in near.KEY))
        packed = pa.RecordBatch.from_pylist(packs)
        got = [tuple(r.values()) for batch in near._joiner(cuts, same, cross)(iter([packed.slice(0, 30), packed.slice(30)])) for r in batch.to_pylist()]
        assert sorted(got) == near_rows(rows, same, cross), (few, many, same, cross)


def test_hamming_join_writes_little(spark, monkeypatch):
    """The join shuffled 137 rows for each row, over 1 KB; packed cells take a few bytes each. Large cells are cut in blocks."""
    from sievework.operators import near

    rng = random.Random(12)
    rows = near_copies(rng, 1500, [1, 2, 2, 4])
    frame = spark.createDataFrame(rows, "ord long, hi long, lo long, folder string").repartition(2)
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    written = lambda: sum(stages.apply(i).shuffleWriteBytes() for stages in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())] for i in range(stages.size()))
    monkeypatch.setattr(near, "CELL_ROWS", 200_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written()
        got = sorted(tuple(r) for r in dedup.hamming_pairs(frame, 8, 3).collect())
        assert 0 < written() - before < 600 * len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == near_rows(rows, 8, 3)
    monkeypatch.setattr(near, "CELL_ROWS", 100)
    assert sorted(tuple(r) for r in dedup.hamming_pairs(frame, 8, 3).collect()) == got
