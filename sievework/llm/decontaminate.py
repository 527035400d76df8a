"""Benchmark decontamination: BM25 inverted index of test items, block-max pruned, every passage a query.

Items are documents of a BM25 index and are grouped in blocks that keep each term's greatest impact. Each training text
is cut into passages of three segments of the longest item's words, each a segment behind the one before, so an item
copied anywhere lies in one passage whole, even if its words are twice as far apart there. A passage is a query of its distinct words. An item's retrieval threshold is the least score a passage
can have that holds THRESHOLD of the item's five-word shingles, so retrieval loses none. As in WAND, only a passage
with a term whose absence would rule the item out is looked at; then blocks whose summed maxima stay below the
threshold are skipped; the rest is scored in full. What is above its threshold is verified: THRESHOLD of the item's
distinct shingles lie in the passage, and PART of the question's distinct words and of the answer's (the item's last
line, if it has several lines); each part is taken as five words at least.

Defined cases: A-Z are lowered; null, empty and wordless texts have no hits; items without words are ignored; an item
of fewer words than a shingle is one sequence; repeated rows are each returned; ties keep all items; null ids are kept;
items that share an id or have none are told apart; empty tables give no rows or no hits; further columns are ignored or
kept as they are; texts are read whole. A benchmark of any size is searched in one pass over the texts: it is cut in
groups of INDEX_BYTES, and of several groups' indexes a task holds one at a time, for a batch of texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, column, small_batches
from .textvec import SHINGLE, pieces, shingle_hashes, span_hashes, text_bytes, word_spans

K1, B = 1.2, 0.75
THRESHOLD, PART = 0.8, 0.5
BLOCK = 4
#: Bytes of a group's index by estimate, WORD_BYTES for each word of its items; the broadcast bound holds for what it has.
INDEX_BYTES, WORD_BYTES = 32 << 20, 96
#: Segments of a passage, and sums of impacts that are held at a time.
SEGMENTS, SUMS = 3, 4 << 20
HIT = "struct<item_id:{id},score:double,overlap:double,question:double,answer:double,first_word:long,last_word:long>"


@dataclass
class Item:
    item_id: object
    shingles: np.ndarray  # distinct, sorted
    width: int
    question: np.ndarray  # distinct words
    answer: np.ndarray


@dataclass
class Block:
    terms: np.ndarray  # sorted term numbers
    impact: np.ndarray  # (terms, items) over the item's threshold
    first: int  # number of the first item


@dataclass
class Index:
    words: np.ndarray  # sorted hashes; a term's number is its place
    essential: np.ndarray  # of terms
    at: np.ndarray  # a term's first block in `block` and `most`, and behind the last term their end
    block: np.ndarray
    most: np.ndarray  # greatest impact of the term in the block
    blocks: list[Block]
    items: list[Item]
    span: int  # words of the longest item


def build_index(rows: list[tuple]) -> Index | None:
    """Index of (item_id, text) rows; None without any word."""
    items, words_of = [], []
    for item_id, text in rows:
        data, off = text_bytes(pa.array([text], pa.string()))
        starts, ends, _ = word_spans(data, off)
        if not len(starts):
            continue
        words = span_hashes(data, starts, ends)
        body = (text or "").rstrip().encode()
        cut = body.rfind(b"\n")
        split = int(np.searchsorted(starts, cut)) if cut >= 0 else len(words)
        first_answer, end_question = min(split, max(0, len(words) - SHINGLE)), max(split, SHINGLE)
        width = min(SHINGLE, len(words))
        runs = shingle_hashes(words)
        distinct = np.unique(runs)
        items.append(Item(item_id, distinct, width, np.unique(words[:end_question]), np.unique(words[first_answer:] if cut >= 0 else words[:0])))
        words_of.append(words)
    if not items:
        return None
    vocabulary = np.unique(np.concatenate(words_of))
    n, length = len(items), np.array([len(w) for w in words_of])
    df = np.zeros(len(vocabulary))
    counts = []
    for words in words_of:
        term, tf = np.unique(np.searchsorted(vocabulary, words), return_counts=True)
        df[term] += 1
        counts.append((term, tf))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    essential = np.zeros(len(vocabulary), bool)
    blocks: list[Block] = []
    for first in range(0, n, BLOCK):
        chosen = range(first, min(n, first + BLOCK))
        terms = np.unique(np.concatenate([counts[i][0] for i in chosen]))
        impact = np.zeros((len(terms), len(chosen)), np.float32)
        for i in chosen:
            term, tf = counts[i]
            value = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[i] / length.mean()))
            missing = len(items[i].shingles) - int(np.ceil(THRESHOLD * len(items[i].shingles)))
            lost = missing + SHINGLE - 1 if missing else 0  # words that may be absent
            if len(items[i].shingles) < max(1, length[i] - SHINGLE + 1):
                lost = len(term)  # repeated shingles: no bound but one common word
            ordered = np.sort(value)
            least = max(float(ordered[: max(0, len(ordered) - lost)].sum()), float(ordered[0])) * (1 - 1e-5)
            impact[np.searchsorted(terms, term), i - first] = value / least
            # the weakest terms that together stay below the threshold need not be looked for
            weak = np.argsort(value, kind="stable")
            essential[term[weak[np.cumsum(value[weak]) >= least]]] = True
        blocks.append(Block(terms, impact, first))
    term = np.concatenate([b.terms for b in blocks])
    order = np.argsort(term, kind="stable")
    number = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(b.terms) for b in blocks])[order]
    most = np.concatenate([b.impact.max(1) for b in blocks])[order]
    return Index(vocabulary, essential, np.searchsorted(term[order], np.arange(len(vocabulary) + 1)), number, most, blocks, items, int(length.max()))


@dataclass
class Words:
    """Words of a piece: their hashes, each row's first one (rows + 1), each word's row."""

    hashes: np.ndarray
    first: np.ndarray
    row: np.ndarray


def read_words(data: np.ndarray, off: np.ndarray) -> Words:
    starts, ends, first = word_spans(data, off)
    return Words(span_hashes(data, starts, ends), first, np.repeat(np.arange(len(off) - 1), np.diff(first)))


def _passages(index: Index, text: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (passage, term) pairs of passages worth a look, and each row's first passage number."""
    words, first, row = text.hashes, text.first, text.row
    place = np.searchsorted(index.words, words)
    place[place == len(index.words)] = 0
    known = index.words[place] == words
    segments = np.maximum(1, -(-np.diff(first) // index.span))
    base = np.concatenate([[0], np.cumsum(segments + SEGMENTS - 1)])  # numbers behind a row's last segment stay free
    last = base[:-1] + np.maximum(0, segments - SEGMENTS)  # the passage that reaches the row's end
    segment = base[row] + (np.arange(len(words)) - first[row]) // index.span
    wanted = np.zeros(base[-1] + SEGMENTS, bool)
    hot = np.flatnonzero(known & index.essential[place])
    for shift in range(SEGMENTS):
        wanted[np.clip(segment[hot] - shift, base[row[hot]], last[row[hot]])] = True
    use = np.flatnonzero(known)
    pairs = []
    for shift in range(SEGMENTS):
        number = segment[use] - shift
        inside = (number >= base[row[use]]) & wanted[number]
        pairs.append(number[inside] * len(index.words) + place[use[inside]])
    passage, term = np.divmod(np.unique(np.concatenate(pairs)), len(index.words))
    return passage, term, base


def find(index: Index, text: Words) -> list[tuple[int, int, tuple]]:
    """(row, item number, hit) for each item that a passage of the piece holds."""
    if not len(text.hashes):
        return []
    passage, term, base = _passages(index, text)
    at = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, np.int64)
    ends_at = np.r_[at[1:], len(passage)]
    many = np.r_[0, np.cumsum(index.at[term + 1] - index.at[term])]
    hits, lo = [], 0
    while lo < len(at):  # as many passages as keep the sums within bounds
        hi = int(np.searchsorted(many[ends_at], many[at[lo]] + SUMS, "right"))
        hi = min(max(hi, lo + 1), lo + max(1, SUMS // len(index.blocks)), len(at))
        a, z = at[lo], ends_at[hi - 1]
        count = index.at[term[a:z] + 1] - index.at[term[a:z]]
        where = np.repeat(index.at[term[a:z]] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        owner = np.repeat(np.repeat(np.arange(hi - lo), ends_at[lo:hi] - at[lo:hi]), count)
        bound = np.bincount(owner * len(index.blocks) + index.block[where], index.most[where], (hi - lo) * len(index.blocks))
        for k in np.flatnonzero(bound >= 1).tolist():
            p, b = divmod(k, len(index.blocks))
            hits += _scored(index, text, index.blocks[b], int(passage[at[lo + p]]), term[at[lo + p] : ends_at[lo + p]], base)
        lo = hi
    return hits


def _scored(index: Index, text: Words, block: Block, number: int, terms: np.ndarray, base: np.ndarray) -> list[tuple[int, int, tuple]]:
    """Full scores of a passage with a block's items, and verified hits."""
    mine = np.searchsorted(block.terms, terms)
    mine[mine == len(block.terms)] = 0
    score = block.impact[mine[block.terms[mine] == terms]].sum(0)
    r = int(np.searchsorted(base, number, "right") - 1)
    start = int(text.first[r])
    a = start + (number - int(base[r])) * index.span
    words = text.hashes[a : min(int(text.first[r + 1]), a + SEGMENTS * index.span)]
    hits = []
    for i in np.flatnonzero(score >= 1).tolist():
        item = index.items[block.first + i]
        runs = shingle_hashes(words, item.width) if len(words) >= item.width else words[:0]
        part_of = lambda part: float(np.isin(part, words).mean()) if len(part) else 1.0
        overlap, question, answer = float(np.isin(item.shingles, runs).mean()), part_of(item.question), part_of(item.answer)
        if overlap >= THRESHOLD and question >= PART and answer >= PART:
            where = np.flatnonzero(np.isin(runs, item.shingles))
            span = a - start + int(where[0]), a - start + int(where[-1]) + item.width - 1
            hits.append((r, block.first + i, (item.item_id, float(score[i]), overlap, question, answer, *span)))
    return hits


def _best(hits: list[tuple[int, tuple]]) -> list[tuple]:
    """Of an item's hits in overlapping passages, the one of the greatest overlap; items in their order."""
    best: dict[int, tuple] = {}
    for number, hit in hits:
        if number not in best or (hit[2], hit[1]) > (best[number][2], best[number][1]):
            best[number] = hit
    return [best[k] for k in sorted(best)]


def _search(texts: list[tuple[int, Words]], rows: int, index: Index) -> list[list[tuple]]:
    """For each row of a batch, its hits of one index's items."""
    out: list[list[tuple]] = [[] for _ in range(rows)]
    for first, text in texts:
        for row, number, hit in find(index, text):
            out[first + row].append((number, hit))
    return [_best(hits) for hits in out]


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The indexes of groups of items, in the order of item_id and text."""
    group, size = [], 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        group.append(tuple(row))
        size += WORD_BYTES * (len(row.text.split()) + 1)
        if size >= INDEX_BYTES:
            if index := build_index(group):
                yield index
            group, size = [], 0
    if index := build_index(group):
        yield index


def _with_hits(rows: DataFrame, benchmark: DataFrame, text: str, hits: str) -> DataFrame:
    """rows with the array of structs `hits`, from the column `text`."""
    small_batches(rows.sparkSession)
    held = []
    for index in indexes(benchmark):
        packed = pickle.dumps(index)
        held.append(checked_broadcast(rows.sparkSession, packed, len(packed), "the index of a group of items"))
    kind = HIT.format(id=benchmark.schema["item_id"].dataType.simpleString())
    names = [x.split(":")[0] for x in HIT[7:-1].split(",")]
    at = rows.columns.index(text)
    rows = rows.withColumn(hits, F.array().cast(f"array<{kind}>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = pickle.loads(held[0].value) if len(held) == 1 else None
        for batch in batches:
            texts = [(a, read_words(data, off)) for a, _, data, off in pieces(batch.column(at))] if held else []
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for part in held:
                for own, new in zip(found, _search(texts, batch.num_rows, only or pickle.loads(part.value)), strict=True):
                    own += [dict(zip(names, hit, strict=True)) for hit in new]
            arrays = [*batch.columns[:-1], pa.array(found, batch.columns[-1].type)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, row_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row_columns, n_hits and hits (item_id, score, overlap, question, answer, first_word, last_word) of each row."""
    found = _with_hits(docs.select(*row_columns, "text"), benchmark, "text", "hits")
    return found.select(*row_columns, F.size("hits").alias("n_hits"), "hits")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The whole rows of docs without any hit; columns are kept whatever their names."""
    own = ["text" if c.lower() == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    rows = docs.select(*[column(c).alias(n) for c, n in zip(docs.columns, own, strict=True)])
    return _with_hits(rows, benchmark, "text", "hits").where(F.size("hits") == 0).drop("hits").toDF(*docs.columns)
