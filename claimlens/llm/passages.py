"""Repeated passages of 20 words by super-k-mer partitioning (operator 3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .texts import Words, covered, id_of, keyed, minimiser_places, numbers, partitions, run_hash, runs, slices, span_lists, texts_of, true_runs

WINDOW = 20
GRAM = 3
SPANS = "k bigint, th bigint, start int, n int"


def _windows(w: Words, window: int, gram: int):
    """Start words of all windows, their hash, and the hash and place of their smallest gram."""
    h = w.hashes()
    w.words = []  # what follows reads the joined text only
    whole = run_hash(h, window)
    at = np.flatnonzero(w.doc[: len(whole)] == w.doc[window - 1:]) if len(whole) else np.zeros(0, np.int64)
    g = run_hash(h, gram)
    place = minimiser_places(g, window - gram + 1)
    return at, whole, g, place


def _spans(k, th, start, n):
    arrays = [pa.array(np.asarray(k, np.int64)), pa.array(np.asarray(th, np.int64)), pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(n, np.int32))]
    return arrays


def _same(w: Words, i: int, j: int, window: int) -> bool:
    return w.bytes_of(i, i + window) == w.bytes_of(j, j + window)


def later_copies(w: Words, at: np.ndarray, whole: np.ndarray, window: int, differ=None) -> np.ndarray:
    """Flags of the windows in `at` whose words also start at an earlier one; equal hashes are checked word for word.

    differ(i, j) tells whether places i and j are different places (the same place can be listed twice).
    """
    later = np.zeros(len(at), bool)
    if len(at) < 2:
        return later
    order = np.argsort(whole[at], kind="stable")
    h = whole[at][order]
    start, size = runs(h)
    for s, n in zip(start[size > 1].tolist(), size[size > 1].tolist()):
        members = order[s: s + n]
        first = int(at[members[0]])
        head = w.bytes_of(first, first + window)
        odd = []
        for m in members[1:].tolist():
            i = int(at[m])
            if w.bytes_of(i, i + window) == head:
                later[m] = differ is None or differ(first, i)
            else:
                odd.append(m)
        if odd:  # different words under one hash
            seen = {}
            for m in odd:
                i = int(at[m])
                f = seen.setdefault(w.bytes_of(i, i + window), i)
                later[m] = f != i and (differ is None or differ(f, i))
    return later


def super_kmers(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: np.ndarray | None = None) -> DataFrame:
    """(p, size, blob, k, th, start, n): packed strings for bucket group p, and windows already found to be repeats.

    Consecutive windows that share a minimiser are one packed string. All strings of a slice of documents that go to
    one bucket group travel in one compressed blob. A window whose words start earlier in the slice is a repeat and is
    reported at once (null blob), so copies in one slice leave it once. Windows of the minimisers in `hot` go by the
    hash of the whole window instead, which spreads what would meet in one bucket.
    """
    groups = np.uint64(8 * partitions(docs.sparkSession))

    def pack(part):
        k, th = numbers(part, "k"), numbers(part, "th")
        texts = texts_of(part)
        order = np.lexsort((th, k))  # earlier documents first
        k, th = k[order], th[order]
        w = Words([texts[i] for i in order])
        del texts
        at, whole, g, place = _windows(w, window, gram)
        if not len(at):
            return
        local = at - w.first[w.doc[at]]
        differ = lambda i, j: (w.doc[i] == w.doc[j]) or k[w.doc[i]] != k[w.doc[j]] or th[w.doc[i]] != th[w.doc[j]]
        later = later_copies(w, at, whole, window, differ)
        s, e = true_runs(later)
        # a run of flags ends where the document does
        s, e = _cut(s, e, w.doc[at])
        d = w.doc[at[s]]
        if len(s):
            none = pa.nulls(len(s), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((_mix(k[d].astype(np.uint64) + local[s].astype(np.uint64)) % groups).astype(np.int32)), pa.nulls(len(s), pa.int32()), none, *_spans(k[d], th[d], local[s], e - s)], names=NAMES)
        # what is left goes to its bucket
        keep = ~later
        own = g[place[at]]
        bucket = np.where(np.isin(own, hot), whole[at] | np.uint64(1), own & ~np.uint64(1)) if hot is not None and len(hot) else own
        mark = np.zeros(len(at), np.int64)
        mark[1:] = np.cumsum((bucket[1:] != bucket[:-1]) | (place[at][1:] != place[at][:-1]) | (keep[1:] != keep[:-1]) | (at[1:] != at[:-1] + 1))
        s, n = runs(mark)
        ok = keep[s]
        s, n = s[ok], n[ok]
        p = (_mix(bucket[s]) % groups).astype(np.int64)
        by = np.argsort(p, kind="stable")
        s, n, p = s[by], n[by], p[by]
        word = at[s]
        a, b = w.start[word], w.start[word + n + window - 1]
        d = w.doc[word]
        gs, gn = runs(p)
        out_p, out_size, out_blob = [], [], []
        mv = w.joined
        for x, c in zip(gs.tolist(), gn.tolist()):
            z = slice(x, x + c)
            text = b"".join([mv[i:j] for i, j in zip(a[z].tolist(), b[z].tolist())])
            step = np.diff(k[d[z]].astype(np.int64), prepend=np.int64(0))  # ids rise in a slice, so the steps pack well
            head = np.array([c], np.int64).tobytes() + step.tobytes() + th[d[z]].astype(np.uint32).tobytes() + local[s[z]].astype(np.int32).tobytes() + n[z].astype(np.int32).tobytes()
            raw = head + text
            out_p.append(p[x])
            out_size.append(len(raw))
            out_blob.append(pa.compress(raw, codec="zstd", asbytes=True))
        m = len(out_p)
        if m:
            nothing = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(out_p, np.int32)), pa.array(np.array(out_size, np.int32)), pa.array(out_blob, pa.binary()), *nothing], names=NAMES)

    def run(batches):
        for part in slices(batches, limit=8 << 20):
            yield from pack(part)  # its arrays go before the next slice comes

    return keyed(docs).mapInArrow(run, "p int, size int, blob binary, " + SPANS)


NAMES = ["p", "size", "blob", "k", "th", "start", "n"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)


def _cut(start: np.ndarray, end: np.ndarray, doc: np.ndarray):
    """Cut runs [start, end) at document changes."""
    if not len(start):
        return start, end
    change = np.flatnonzero(np.diff(doc)) + 1
    inside = covered(len(doc), start, end)
    change = change[inside[change] & inside[change - 1]]
    s = np.unique(np.concatenate((start, change)))
    e = np.unique(np.concatenate((end, change)))
    return s, e


def bucket_repeats(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k, th, start, n): runs of windows whose words also start earlier, found by sorting each bucket group's windows."""

    def decide(blobs):
        k, th, start, n, texts = [], [], [], [], []
        for raw in blobs:
            c = int(np.frombuffer(raw, np.int64, 1)[0])
            pos = 8
            for dtype, out in ((np.int64, k), (np.uint32, th), (np.int32, start), (np.int32, n)):
                out.append(np.frombuffer(raw, dtype, c, pos))
                pos += c * np.dtype(dtype).itemsize
            k[-1] = np.cumsum(k[-1])
            texts.append(raw[pos:])
        k, th, start, n = (np.concatenate(x) for x in (k, th, start, n))
        w = Words(texts)
        del texts
        hashes = w.hashes()
        w.words = []
        own = np.repeat(np.arange(len(n)), n.astype(np.int64) + window - 1)  # string of each word
        base = np.concatenate(([0], np.cumsum(n.astype(np.int64) + window - 1)))
        whole = run_hash(hashes, window)
        del hashes
        at = np.flatnonzero(own[: len(whole)] == own[window - 1:])
        place = start[own[at]] + (at - base[own[at]])
        order = np.lexsort((place, th[own[at]], k[own[at]]))
        at = at[order]
        o = own[at]
        differ = lambda i, j: k[own[i]] != k[own[j]] or th[own[i]] != th[own[j]] or start[own[i]] + i - base[own[i]] != start[own[j]] + j - base[own[j]]
        later = later_copies(w, at, whole, window, differ)
        hit = np.sort(at[later])
        if not len(hit):
            return None
        new = np.concatenate(([True], (np.diff(hit) != 1) | (own[hit[1:]] != own[hit[:-1]])))
        s = np.flatnonzero(new)
        size = np.diff(np.concatenate((s, [len(hit)])))
        f = hit[s]
        return pa.RecordBatch.from_arrays(_spans(k[own[f]], th[own[f]], start[own[f]] + f - base[own[f]], size), names=["k", "th", "start", "n"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            found = np.flatnonzero(np.asarray(batch.column(2).is_null()))
            if len(found):
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(found)) for i in (3, 4, 5, 6)], names=["k", "th", "start", "n"])
            p, size, blob = numbers(batch, "p"), batch.column(1).to_pylist(), batch.column(2)
            for i in range(len(p)):
                if size[i] is None:
                    continue
                if p[i] != key:
                    out = decide(held) if held else None
                    if out is not None:
                        yield out
                    held, key = [], p[i]
                held.append(pa.decompress(blob[i].as_buffer(), decompressed_size=size[i], codec="zstd", asbytes=True))
        out = decide(held) if held else None
        if out is not None:
            yield out

    spark = packed.sparkSession
    return packed.repartition(partitions(spark), "p").sortWithinPartitions("p").mapInArrow(run, SPANS)


def hot_minimisers(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, least: int = 2000, most: int = 200_000) -> np.ndarray:
    """Minimisers with so many packed strings that their bucket is split: over `least`, and over a `most`-th of all.

    The second bound keeps the list under `most` entries at any size. Which way a window goes changes no result.
    """

    def count(part):
        w = Words(texts_of(part))
        at, whole, g, place = _windows(w, window, gram)
        if not len(at):
            return
        seen = np.unique(whole[at], return_index=True)[1]  # copies in a slice leave it once
        seen.sort()
        at = at[seen]
        new = np.concatenate(([True], (place[at][1:] != place[at][:-1]) | (np.diff(at) != 1)))
        value, n = np.unique(g[place[at[new]]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["m", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([int(n[n == 1].sum())], pa.int64())], names=["m", "n"])

    def run(batches):
        for part in slices(batches):
            yield from count(part)

    counts = keyed(docs).mapInArrow(run, "m bigint, n bigint").groupBy("m").agg(F.sum("n").alias("n")).cache()
    try:
        total = counts.agg(F.sum("n")).first()[0] or 0
        rows = counts.filter((F.col("n") > max(least, total // most)) & (F.col("m") != 0)).select("m").toArrow()
    finally:
        counts.unpersist()
    return np.sort(rows.column(0).to_numpy().astype(np.int64)).view(np.uint64) if rows.num_rows else np.zeros(0, np.uint64)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), a row for each row of docs.

    A word goes when a window of `window` words that covers it also starts earlier: in a smaller doc_id, or earlier in
    the same document. Null text has no words; a text shorter than a window keeps all. Null doc_id is the smallest.
    Rows that share doc_id and text are one place, so neither is earlier. Other columns are ignored.
    """
    hot = hot_minimisers(docs, window, gram)
    spans = bucket_repeats(super_kmers(docs, window, gram, hot), window)
    per_doc = spans.groupBy("k", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    rows = keyed(docs, spread=False).join(per_doc, ["k", "th"], "left").select("k", "text", "spans")

    def run(batches):
        for part in slices(batches):
            w = Words(texts_of(part))
            row, start, n = span_lists(part, "spans", ("start", "n"))
            a = w.first[row] + start
            gone = covered(w.n, a, a + n + window - 1)
            kept = []
            for d in range(len(w.count)):
                words, g = w.words[w.first[d]: w.first[d + 1]], gone[w.first[d]: w.first[d + 1]]
                kept.append(b" ".join([x for x, y in zip(words, g) if not y] if g.any() else words))
            removed = np.bincount(w.doc[gone], minlength=len(w.count)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(numbers(part, "k")), pa.array(w.count), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=["k", "n_words", "n_removed", "kept_text"])

    out = rows.mapInArrow(run, "k bigint, n_words bigint, n_removed bigint, kept_text string")
    return out.select(id_of("k").alias("doc_id"), "n_words", "n_removed", "kept_text")
