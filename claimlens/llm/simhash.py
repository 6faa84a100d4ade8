"""Near duplicates by SimHash and segment popcounts (operator 10)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.graph import connected_components
from ..operators.lineage import materialize
from .texts import NO_ID, id_of, keyed, numbers, partitions, runs, slices, texts_of

BITS = 64
SEED = 42
SMALL_CELL = 16  # cells up to this size are compared all at once, larger ones one by one
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, width: int = 4) -> int:
    """Majority bit of the XXH64 of each shingle of `width` words, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(width, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):  # a bounded bit matrix, however long the text
        ones += np.unpackbits(h[at: at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(k, th, fp): fp is the fingerprint as a signed bigint."""

    def run(batches):
        for part in slices(batches):
            fp = np.array([fingerprint(t, width) for t in texts_of(part)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(numbers(part, "k")), pa.array(numbers(part, "th")), pa.array(fp)], names=["k", "th", "fp"])

    return keyed(docs).mapInArrow(run, "k bigint, th bigint, fp bigint")


def embedding(fp: np.ndarray, segment: int) -> np.ndarray:
    """Bit counts of the segments of `segment` bits, one row for each fingerprint."""
    bits = np.unpackbits(fp.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.reshape(len(fp), BITS // segment, segment).sum(axis=2, dtype=np.uint8)


def grid_cells(fps: DataFrame, distance: int, segment: int = 2) -> DataFrame:
    """(cell, fp): the grid cells in which a fingerprint is looked for.

    Bit counts differ by at most the bits that differ, so Manhattan distance of the embeddings is a lower bound. The
    axes are cut into parts; of `distance` differing bits, one part has at most r = distance // parts. Two points
    that close in a part share a lattice point within r - r//2 and r//2 of them, so each point enters every cell
    within (r + 1) // 2 of its own.
    """
    parts = 2
    reach = (distance // parts + 1) // 2
    axes = BITS // segment // parts

    def run(batches):
        moves = [()]
        for r in range(1, reach + 1):
            moves += list(combinations(range(axes), r))
        for batch in batches:
            fp = numbers(batch, "fp")
            if not len(fp):
                continue
            emb = embedding(fp, segment).astype(np.int64)
            weight = (np.int64(segment + 1) ** np.arange(axes, dtype=np.int64))
            for part in range(parts):
                e = emb[:, part * axes: (part + 1) * axes]
                base = e @ weight
                cells, owner = [base], [np.arange(len(fp))]
                frontier = [(base, np.arange(len(fp)), e)]
                for _ in range(reach):
                    grown = []
                    for b, own, at in frontier:
                        for axis in range(axes):
                            for step in (-1, 1):
                                ok = (at[:, axis] + step >= 0) & (at[:, axis] + step <= segment)
                                moved = at[ok].copy()
                                moved[:, axis] += step
                                grown.append((b[ok] + step * weight[axis], own[ok], moved))
                    frontier = grown
                    cells += [g[0] for g in grown]
                    owner += [g[1] for g in grown]
                cell = np.concatenate(cells) * parts + part
                own = np.concatenate(owner)
                if reach > 1:  # the same cell can be reached by several ways
                    pair = np.unique(np.stack([cell, own]), axis=1)
                    cell, own = pair[0], pair[1]
                for a in range(0, len(cell), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(cell[a: a + (1 << 18)]), pa.array(fp[own[a: a + (1 << 18)]])], names=["cell", "fp"])

    return fps.select("fp").mapInArrow(run, "cell bigint, fp bigint")


def forest(fp: np.ndarray, distance: int, split: int = 0) -> list[tuple[int, int]]:
    """Links that join what pairs within `distance` join; no pair inside one component is listed twice over.

    With split > 0 only pairs with one end before and one end after that place count.
    """
    n = len(fp)
    u = fp.view(np.uint64)
    root = np.arange(n)
    links = []
    for i in range(split or n - 1):
        rest = slice(split, n) if split else slice(i + 1, n)
        near = np.flatnonzero(np.bitwise_count(u[rest] ^ u[i]) <= distance) + rest.start
        for r in np.unique(root[near]):
            if r != root[i]:
                j = near[np.argmax(root[near] == r)]
                links.append((int(fp[i]), int(fp[j])))
                root[root == r] = root[i]
    return links


def links(fps: DataFrame, distance: int = 4, block: int = 4096) -> DataFrame:
    """(a, b): fingerprints within `distance` bits, enough of them to join every component.

    Cells are found on the popcount grid, and in each cell all pairs are checked on the full bits; only links between
    parts not yet joined in that cell come out. A cell over `block` fingerprints is cut into blocks by hash, and every
    pair of its blocks is a task of its own, so no cell is one task and no pair is skipped.
    """
    spark = fps.sparkSession
    cells = materialize(grid_cells(fps, distance), "grid")
    big = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    big = big.select("cell", F.ceil(F.col("n") / F.lit(block // 2)).cast("int").alias("blocks"))
    rows = cells.join(big, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).select(
        "cell", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("cell", "fp", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).alias("second"))

    def work(group, fp, second, crossing):
        """group: number of each row's group, ascending."""
        start, size = runs(group)
        a, b = [], []
        few = np.repeat(size <= SMALL_CELL, size) & ~crossing
        u = fp.view(np.uint64)
        for step in range(1, SMALL_CELL):
            if len(fp) <= step:
                break
            near = (group[step:] == group[:-step]) & few[step:] & (np.bitwise_count(u[step:] ^ u[:-step]) <= distance)
            a.append(fp[:-step][near])
            b.append(fp[step:][near])
        for s, n in zip(start.tolist(), size.tolist()):
            if n > 1 and not few[s]:
                order = np.argsort(second[s: s + n], kind="stable")
                cut = int(n - second[s: s + n].sum())
                if crossing[s] and cut in (0, n):
                    continue
                out = forest(fp[s: s + n][order], distance, cut if crossing[s] else 0)
                a.append(np.array([x for x, _ in out], np.int64))
                b.append(np.array([y for _, y in out], np.int64))
        a, b = np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        names = ("cell", "x", "y", "fp", "second")
        kept = None  # rows of the last group, which the next batch may continue
        for batch in batches:
            cols = [numbers(batch, n) for n in names]
            if kept is not None:
                cols = [np.concatenate(p) for p in zip(kept, cols)]
            if not len(cols[0]):
                continue
            new = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)
            group = np.concatenate(([0], np.cumsum(new)))
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield work(group[:cut], cols[3][:cut], cols[4][:cut].astype(bool), (cols[1] != cols[2])[:cut])
            kept = [c[cut:].copy() for c in cols]
        if kept is not None and len(kept[0]):
            yield work(np.zeros(len(kept[0]), np.int64), kept[3], kept[4].astype(bool), kept[1] != kept[2])

    grouped = rows.repartition(partitions(spark), "cell", "x", "y").sortWithinPartitions("cell", "x", "y")
    return grouped.mapInArrow(run, "a bigint, b bigint").distinct()


def _labelled(docs: DataFrame, width: int, distance: int) -> DataFrame:
    """(k, th, fp, first): first (k, th) is the smallest row of the row's component."""
    fps = materialize(fingerprints(docs, width), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min(F.struct("k", "th")).alias("first")), "nodes")
    pairs = materialize(links(nodes, distance), "links")
    part = connected_components(pairs.select(F.lit(0).alias("g"), "a", "b")).select(F.col("node").alias("fp"), "component")
    named = nodes.join(part, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("first"))
    label = named.select("fp", "component").join(least, "component").select("fp", "first")
    return fps.join(label, "fp")


def near_groups(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    Rows with equal fingerprints are one node from the start, so a large group of copies costs one node. Texts
    without words have fingerprint zero and link like others; null text is empty. A null doc_id takes part as the
    smallest id and comes back null. Other columns are ignored.
    """
    return _labelled(docs, width, distance).select(
        id_of("k").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), id_of("first.k").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """docs with one row of each near-duplicate group, the one with the smallest doc_id."""
    cols = docs.columns
    stay = _labelled(docs, width, distance).select(F.col("first.k").alias("__k"), F.col("first.th").alias("__th")).distinct()
    rows = docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), "__th": F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(2**32))})
    first = F.row_number().over(Window.partitionBy("__k", "__th").orderBy(F.lit(1)))
    return rows.join(stay, ["__k", "__th"], "left_semi").withColumn("__rn", first).filter("__rn = 1").select(*cols)
