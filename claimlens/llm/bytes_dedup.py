"""Repeated byte strings by column-wise suffix insertion (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.lineage import materialize
from .texts import covered, id_of, keyed, minimiser_places, numbers, partitions, run_hash, runs, slices, span_lists, texts_of

WIDTH = 400
GRAM = 200
PIECE = 4 << 20


def _pieces(texts: list[bytes], width: int):
    """(text index, offset, bytes): documents joined up to about PIECE bytes, a longer one in overlapping pieces."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < width:
            continue
        if len(t) > PIECE:
            step = PIECE - width + 1
            for a in range(0, len(t) - width + 1, step):
                yield [(i, a, t[a: a + PIECE])]
            continue
        if size + len(t) > PIECE:
            yield group
            group, size = [], 0
        group.append((i, 0, t))
        size += len(t)
    if group:
        yield group


def anchors(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(h, sh, left, k, th, start, n): runs of `n` windows from byte `start` whose smallest gram is the same one.

    Equal windows have equal smallest grams at equal offsets, so windows need comparing only under one h (hash of the
    gram). sh is the hash of the run's whole string, left the offset of the gram in it.
    """

    def run(batches):
        for part in slices(batches, limit=PIECE):
            k, th, texts = numbers(part, "k"), numbers(part, "th"), texts_of(part)
            for group in _pieces(texts, width):
                buf = b"".join(t for _, _, t in group)
                size = np.array([len(t) for _, _, t in group], np.int64)
                base = np.concatenate(([0], np.cumsum(size)))
                g = run_hash(np.frombuffer(buf, np.uint8), gram)
                place = minimiser_places(g, width - gram + 1)
                whole = np.ones(len(place), bool)
                for b in base[1:-1].tolist():  # windows that run over the end of a text
                    whole[max(0, b - width + 1): b] = False
                own = np.where(whole, place, -1)
                s, n = runs(own)
                ok = whole[s]
                s, n = s[ok], n[ok]
                if not len(s):
                    continue
                d = np.searchsorted(base, s, "right") - 1
                row = np.array([x for x, _, _ in group])[d]
                off = np.array([x for _, x, _ in group])[d]
                digest = xxhash.xxh3_64_intdigest
                sh = np.fromiter((digest(buf[a: a + c + width - 1]) for a, c in zip(s.tolist(), n.tolist())), np.uint64, len(s))
                yield pa.RecordBatch.from_arrays([
                    pa.array(g[place[s]].view(np.int64)), pa.array(sh.view(np.int64)), pa.array((place[s] - s).astype(np.int32)), pa.array(k[row]), pa.array(th[row]),
                    pa.array((s - base[d] + off).astype(np.int32)), pa.array(n.astype(np.int32)),
                ], names=["h", "sh", "left", "k", "th", "start", "n"])

    return keyed(docs).mapInArrow(run, "h bigint, sh bigint, left int, k bigint, th bigint, start int, n int")


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a:b]) for many ranges, all of length at least 1."""
    out = x[a].copy()
    span = b - a
    level, size = x, 1
    while True:
        wide = span >= size
        if not wide.any():
            return out
        fits = wide & (span < 2 * size)
        if fits.any():
            out[fits] = np.minimum(level[a[fits]], level[b[fits] - size])
        if len(level) <= size:
            return out
        level = np.minimum(level[:-size], level[size:])
        size *= 2


def column_insert(bucket: np.ndarray, texts: list[bytes], left: np.ndarray, width: int, gram: int):
    """(string, column) pairs: the windows that start `column` bytes before the gram and occur in two strings.

    The strings of a bucket share a gram and are aligned at it. Each round inserts one symbol of every string, from the
    last column to the first: the order of the suffixes is the old order, stably sorted by the new symbol (the step of
    the last-to-first map), and the common prefix of new neighbours is one more than the least between their old places.
    A window occurs twice where a suffix and a neighbour share `width` symbols.
    """
    m = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate(([0], np.cumsum(size)))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    order = np.argsort(bucket, kind="stable")
    lcp = np.zeros(m, np.int64)  # with the suffix before it; 0 where a bucket begins
    b = bucket[order].astype(np.int64)
    new_bucket = np.concatenate(([True], b[1:] != b[:-1]))
    lcp[~new_bucket] = 0

    def insert(column, order, lcp):
        at = left[order] + column  # offset in the string; columns count from the gram's first byte
        there = (at >= 0) & (at < size[order])
        symbol = np.where(there, buf[np.clip(base[order] + at, 0, len(buf) - 1)], 256).astype(np.int64)
        key = bucket[order].astype(np.int64) * 257 + symbol
        move = np.argsort(key, kind="stable")
        key = key[move]
        out = np.zeros(m, np.int64)
        same = np.flatnonzero((key[1:] == key[:-1]) & there[move[1:]])
        if len(same):
            out[same + 1] = 1 + _range_min(lcp, move[same] + 1, move[same + 1] + 1)
        return order[move], out

    for column in range(width - 1, gram - 1, -1):
        order, lcp = insert(column, order, lcp)
    b = bucket[order]
    lcp[np.concatenate(([False], b[1:] == b[:-1]))] += gram  # the gram itself is the same in the whole bucket
    found_s, found_c = [], []

    def collect(column):
        eq = lcp >= width
        hit = eq.copy()
        hit[:-1] |= eq[1:]
        found_s.append(order[hit])
        found_c.append(np.full(int(hit.sum()), column, np.int64))

    collect(0)
    for column in range(1, width - gram + 1):
        order, lcp = insert(-column, order, lcp)
        collect(column)
    return np.concatenate(found_s), np.concatenate(found_c)


def bucket_windows(strings: DataFrame, width: int, gram: int, batch_rows: int = 20_000) -> DataFrame:
    """(k, th, start, n): windows of once-seen strings that also occur in another string of their bucket."""

    def decide(h, left, k, th, start, cnt, texts):
        bucket = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
        s, c = column_insert(bucket, texts, left.astype(np.int64), width, gram)
        once = cnt[s] == 1
        s, at = s[once], (left[s] - c)[once]
        by = np.lexsort((at, s))
        s, at = s[by], at[by]
        if not len(s):
            return None
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (np.diff(at) != 1)))
        f = np.flatnonzero(new)
        n = np.diff(np.concatenate((f, [len(s)])))
        return pa.RecordBatch.from_arrays([pa.array(k[s[f]]), pa.array(th[s[f]]), pa.array((start[s[f]] + at[f]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["k", "th", "start", "n"])

    names = ("h", "left", "k", "th", "start", "cnt")

    def run(batches):
        kept, texts = None, []
        for batch in batches:
            cols = [numbers(batch, n) for n in names]
            texts += batch.column(batch.schema.get_field_index("string")).to_pylist()
            kept = cols if kept is None else [np.concatenate(p) for p in zip(kept, cols)]
            if len(texts) < batch_rows:
                continue
            cut = int(np.searchsorted(kept[0], kept[0][-1]))
            if cut:
                out = decide(*[c[:cut] for c in kept], texts[:cut])
                if out is not None:
                    yield out
                kept, texts = [c[cut:] for c in kept], texts[cut:]
        if texts:
            out = decide(*kept, texts)
            if out is not None:
                yield out

    spark = strings.sparkSession
    return strings.repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(run, "k bigint, th bigint, start int, n int")


def _strings(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The strings of chosen runs, cut from their documents."""
    lists = wanted.groupBy("k", "th").agg(F.collect_list(F.struct("h", "left", "start", "n", "cnt")).alias("w"))
    rows = keyed(docs, spread=False).join(lists, ["k", "th"])

    def run(batches):
        for part in slices(batches):
            k, th, texts = numbers(part, "k"), numbers(part, "th"), texts_of(part)
            row, h, left, start, n, cnt = span_lists(part, "w", ("h", "left", "start", "n", "cnt"))
            for a in range(0, len(row), 20_000):
                z = slice(a, a + 20_000)
                cut = [texts[r][s: s + c + width - 1] for r, s, c in zip(row[z].tolist(), start[z].tolist(), n[z].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h[z]), pa.array(left[z]), pa.array(k[row[z]]), pa.array(th[row[z]]), pa.array(start[z]), pa.array(n[z]), pa.array(cnt[z]), pa.array(cut, pa.binary())], names=["h", "left", "k", "th", "start", "n", "cnt", "string"])

    return rows.mapInArrow(run, "h bigint, left int, k bigint, th bigint, start int, n int, cnt bigint, string binary")


def _hot_windows(strings: DataFrame, width: int) -> DataFrame:
    """(k, th, start, n = 1): repeated windows of the strings of large buckets, counted by digest, one row a window."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            k, th, start, n, cnt = (numbers(batch, c) for c in ("k", "th", "start", "n", "cnt"))
            for i, t in enumerate(batch.column(batch.schema.get_field_index("string")).to_pylist()):
                m = int(n[i])
                d = np.frombuffer(b"".join([digest(t[j: j + width]) for j in range(m)]), np.int64).reshape(m, 2)
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.full(m, k[i])), pa.array(np.full(m, th[i])), pa.array(np.arange(start[i], start[i] + m, dtype=np.int32)), pa.array(np.full(m, cnt[i]))], names=["d1", "d2", "k", "th", "start", "cnt"])

    rows = strings.mapInArrow(run, "d1 bigint, d2 bigint, k bigint, th bigint, start int, cnt bigint")
    rows = materialize(rows, "hot-windows")
    twice = rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("d1", "d2")
    return rows.filter("cnt = 1").join(twice, ["d1", "d2"]).select("k", "th", "start", F.lit(1).alias("n"))


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = 5_000) -> DataFrame:
    """(k, th, start, n): runs of windows of `width` bytes that occur at least twice."""
    runs_ = materialize(anchors(docs, width, gram), "anchors")
    kinds = runs_.groupBy("h", "sh").agg(F.count(F.lit(1)).alias("cnt"), *[F.first(c).alias(c) for c in ("left", "k", "th", "start", "n")])
    kinds = materialize(kinds, "kinds")
    buckets = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("strings")).filter("strings > 1")
    mixed = kinds.join(buckets, "h")
    twice = kinds.filter("cnt > 1").select("h", "sh")
    whole = runs_.join(twice, ["h", "sh"]).select("k", "th", "start", "n")
    strings = materialize(_strings(docs, mixed.filter(F.col("strings") <= hot), width), "strings")
    parts = [whole, bucket_windows(strings, width, gram)]
    large = mixed.filter(F.col("strings") > hot)
    if not large.isEmpty():
        parts.append(_hot_windows(_strings(docs, large, width), width))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary), a row for each row of docs.

    A byte goes when a string of `width` bytes that covers it starts anywhere else too, in the same document or
    another; n_spans counts the maximal removed runs. Null text is empty; a text under `width` bytes keeps all. Rows
    that repeat id and text are different places. Null doc_id comes back null. Other columns are ignored.
    """
    spans = repeated_windows(docs, width, gram)
    per_doc = spans.groupBy("k", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    rows = keyed(docs, spread=False).join(per_doc, ["k", "th"], "left").select("k", "text", "spans")

    def run(batches):
        for part in slices(batches):
            texts = texts_of(part)
            row, start, n = span_lists(part, "spans", ("start", "n"))
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            kept, removed, count = [], [], []
            for d, t in enumerate(texts):
                a, b = bounds[d], bounds[d + 1]
                if a == b:
                    kept.append(t)
                    removed.append(0)
                    count.append(0)
                    continue
                gone = covered(len(t), start[a:b], start[a:b] + n[a:b] + width - 1)
                removed.append(int(gone.sum()))
                count.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(numbers(part, "k")), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["k", "n_bytes", "n_removed", "n_spans", "kept"])

    out = rows.mapInArrow(run, "k bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.select(id_of("k").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
