"""Benchmark decontamination by a block-max BM25 index (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .texts import NO_ID, dealt, id_of, numbers, slices, texts_of
from .toxicity import PLAIN

K1, B = 1.2, 0.75
SHINGLE = 5
BLOCK = 64
SHARD_ITEMS, SHARD_BYTES = 20_000, 64 << 20


@dataclass
class Index:
    """Inverted index of test items. Impacts are BM25 parts over the item's own score, so a copy of an item scores 1.

    Common terms are not essential: no item gets more than half the threshold from all of its own together, so an item
    over the threshold is found by its other terms alone. `rest` bounds the common part for each block of items.
    """

    vocabulary: dict[bytes, int]
    start: np.ndarray  # postings of term t are start[t]:start[t + 1], items ascending
    items: np.ndarray
    impact: np.ndarray
    essential: np.ndarray  # of each term
    rest: np.ndarray  # of each block of BLOCK items
    ids: list[int]
    words: list[list[bytes]]
    own: list[tuple[np.ndarray, np.ndarray]]  # terms and impacts of each item
    half: int  # words in half a passage; a passage holds any item of up to this many words


def build_index(rows: list[tuple[int, str]], least: float = 0.5) -> Index:
    words = [(t or "").encode().translate(PLAIN).split() for _, t in rows]
    vocabulary: dict[bytes, int] = {}
    for w in chain.from_iterable(words):
        vocabulary.setdefault(w, len(vocabulary))
    n, mean = len(rows), max(1.0, sum(map(len, words)) / max(1, sum(1 for w in words if w)))
    term, item, tf = [], [], []
    for i, w in enumerate(words):
        t, c = np.unique(np.fromiter(map(vocabulary.get, w), np.int64, len(w)), return_counts=True)
        term.append(t)
        item.append(np.full(len(t), i, np.int64))
        tf.append(c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)))
    term, item, tf = (np.concatenate(x) if x else np.zeros(0) for x in (term, item, tf))
    term, item = term.astype(np.int64), item.astype(np.int64)
    df = np.bincount(term, minlength=len(vocabulary))
    weight = np.log1p((n - df + 0.5) / (df + 0.5))[term] * tf
    own = np.bincount(item, weights=weight, minlength=n)
    weight = weight / own[item]
    by = np.lexsort((item, term))
    term, item, weight = term[by], item[by], weight[by]
    start = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    essential = np.ones(len(vocabulary), bool)
    common = np.zeros(n)
    for t in np.argsort(-df, kind="stable").tolist():  # commonest first, until an item would depend on them
        z = slice(start[t], start[t + 1])
        if (common[item[z]] + weight[z] > least / 2).any():
            break
        common[item[z]] += weight[z]
        essential[t] = False
    rest = np.array([common[b: b + BLOCK].max() for b in range(0, n, BLOCK)])
    by_item = np.lexsort((term, item))
    cut = np.searchsorted(item[by_item], np.arange(n + 1))
    own_terms = [(term[by_item[a:b]], weight[by_item[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
    half = max(64, max(map(len, words), default=0))
    return Index(vocabulary, start, item, weight, essential, rest, [i for i, _ in rows], words, own_terms, half)


def _candidates(index: Index, at: np.ndarray, term: np.ndarray, last: np.ndarray, least: float):
    """(half, item) pairs whose bound over the passage of that half and the next reaches `least`.

    at, term: the distinct terms of each half. The postings of the essential terms are summed for each passage and
    item; with the block's bound for the rest they bound the score from above.
    """
    z = index.essential[term]
    at, term = at[z], term[z]
    size = index.start[term + 1] - index.start[term]
    post = np.repeat(index.start[term] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    half, item, impact = np.repeat(at, size), index.items[post], index.impact[post]
    back = (half > 0) & ~last[half - 1]  # the passage that begins one half before
    n = np.int64(len(index.ids))
    key = np.concatenate((half * n + item, (half[back] - 1) * n + item[back]))
    impact = np.concatenate((impact, impact[back]))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return first, first
    bound = np.add.reduceat(impact[order], first) + index.rest[(key[first] % n) // BLOCK]
    hit = key[first][bound >= least - 1e-9]
    return hit // n, hit % n


def _shingles(words: list[bytes]) -> list[tuple]:
    return [tuple(words[i: i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


def overlap(passage: list[bytes], words: list[bytes]) -> tuple[float, float, float]:
    """Shares of the shingles of an item, of its question (first three quarters) and answer (the rest) in a passage."""
    there: dict[int, set] = {}

    def share(part):
        want = _shingles(part)
        if not want:
            return 0.0
        size = len(want[0])
        if size not in there:
            there[size] = {tuple(passage[i: i + size]) for i in range(len(passage) - size + 1)}
        return sum(s in there[size] for s in want) / len(want)

    cut = max(1, len(words) * 3 // 4)
    return share(words), share(words[:cut]), share(words[cut:] or words)


def _scan(docs: DataFrame, index: Index, least: float, similarity: float) -> DataFrame:
    vocabulary, half = index.vocabulary, index.half

    def run(batches):
        get = vocabulary.get
        for part in slices(batches):
            k, texts = numbers(part, "k"), texts_of(part)
            words = [t.translate(PLAIN).split() for t in texts]
            count = np.fromiter(map(len, words), np.int64, len(words))
            ids = np.fromiter(map(get, chain.from_iterable(words), repeat(-1)), np.int64, int(count.sum()))
            halves = np.maximum((count + half - 1) // half, 1)  # of each text
            first = np.concatenate(([0], np.cumsum(halves)))
            base = np.concatenate(([0], np.cumsum(count)))
            doc = np.repeat(np.arange(len(words)), count)
            block = first[doc] + (np.arange(len(ids)) - base[doc]) // half
            known = ids >= 0
            pair = np.unique(block[known] * np.int64(len(vocabulary) + 1) + ids[known])
            at, term = pair // (len(vocabulary) + 1), pair % (len(vocabulary) + 1)
            owner = np.repeat(np.arange(len(words)), halves)
            last = np.zeros(first[-1], bool)  # the last half of a text
            last[first[1:] - 1] = True
            found = {}
            for h, i in zip(*(x.tolist() for x in _candidates(index, at, term, last, least))):
                d = int(owner[h])
                if last[h] and h != first[d]:
                    continue  # the passage before it holds it
                a, b = np.searchsorted(at, [h, h + 1 if last[h] else h + 2])
                terms, weights = index.own[i]
                score = float(weights[np.isin(terms, term[a:b])].sum())
                if score < least - 1e-9:
                    continue
                s = (h - first[d]) * half
                whole, question, answer = overlap(words[d][s: s + 2 * half], index.words[i])
                if whole >= similarity and question >= 0.5 and answer >= 0.5:
                    key = (int(k[d]), index.ids[i])
                    row = (round(whole, 6), round(score, 6), -int(s), round(question, 6), round(answer, 6))
                    if row > found.get(key, ()):
                        found[key] = row
            if found:
                rows = [(*key, -v[2], v[1], v[0], v[3], v[4]) for key, v in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4))], names=["k", "item_id", "word_start", "score", "overlap", "question_overlap", "answer_overlap"])

    return docs.mapInArrow(run, "k bigint, item_id bigint, word_start bigint, score double, overlap double, question_overlap double, answer_overlap double")


def leaks(docs: DataFrame, items: DataFrame, least: float = 0.5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, word_start, score, overlap, question_overlap, answer_overlap): test items held by documents.

    Every text is cut into half-overlapping passages long enough for any item. Each passage is a query: items whose
    BM25 score is at least `least` of what the item's own text scores are all retrieved, and kept if `similarity` of
    their five-word shingles stand in the passage and question and answer do for half at least. One row for a document
    and item, the best passage.

    The index is sent to tasks in shards of bounded size (items and bytes); a larger test set takes one pass for each
    shard. Null and empty texts and items match nothing; null ids take part and come back null. Rows that repeat an id
    are one document. Other columns are ignored.
    """
    known = items.select(F.coalesce(F.col("item_id").cast("bigint"), F.lit(NO_ID)).alias("i"), F.col("text").cast("string").alias("t")).filter("t IS NOT NULL").distinct()
    n, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    shards = max(1, -(-n // (SHARD_ITEMS // 2)), -(-size // (SHARD_BYTES // 2)))
    rows = dealt(docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    out = None
    for s in range(shards):
        part = known.filter(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == s).orderBy("i", "t").toArrow().to_pydict()
        found = _scan(rows, build_index(list(zip(part["i"], part["t"])), least), least, similarity)
        out = found if out is None else out.unionByName(found)
    order = [F.desc("overlap"), F.desc("score"), "word_start"]
    best = out.withColumn("rn", F.row_number().over(Window.partitionBy("k", "item_id").orderBy(*order))).filter("rn = 1")
    return best.select(id_of("k").alias("doc_id"), id_of("item_id").alias("item_id"), "word_start", "score", "overlap", "question_overlap", "answer_overlap")


def keep_unleaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold a test item."""
    gone = leaks(docs, items).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__gone")).distinct()
    return docs.join(gone, F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)) == gone["__gone"], "left_anti")
