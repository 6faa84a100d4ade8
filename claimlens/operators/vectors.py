"""Similarity joins over unit vectors (cosine = dot product).

`top_k` finds the k best right rows of every left row: the right side is sent to the tasks as one
matrix while it is small, and is cut into blocks joined by key beyond that. `pairs_above` finds all
pairs of one table above a threshold by an index with true bounds: cells with their radius, and
leading rotated dimensions with the length of the rest. Only result rows leave a task, never all pairs.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import materialize

SMALL_SIDE_BYTES = 64 << 20  # of the matrix sent to every task: rows x dimension x 8
BLOCK_ROWS = 2_048
DIGITS = 9  # similarities are compared after rounding, so that ties go to the smaller id everywhere


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_vectors(df: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Attach the vector named by vec_id; rows without one keep NULL."""
    return df.join(embeddings.select("vec_id", "embedding"), "vec_id", "left")


def unit_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.withColumn("_n", norm).withColumn(
        vector, F.when(F.col("_n") > 0, F.transform(vector, lambda x: x.cast("double") / F.col("_n"))).otherwise(F.col(vector).cast("array<double>"))
    ).drop("_n")


def centroids(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean per key, scaled to length 1; a zero mean stays zero."""
    mean = (
        df.filter(F.col(vector).isNotNull())
        .select(key, F.posexplode(vector).alias("pos", "x"))
        .groupBy(key, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("parts"))
        .select(key, F.transform("parts", lambda p: p["m"]).alias(vector))
    )
    return unit_vectors(mean, vector)


def _matrix(column) -> np.ndarray:
    return np.asarray(np.stack(column.to_numpy()), dtype=np.float64)


def _best(left: np.ndarray, right: np.ndarray, k: int):
    """Row-wise k best columns of left·rightᵀ, by similarity then by column order."""
    n = left.shape[0]
    best_s = np.full((n, 0), -np.inf)
    best_i = np.zeros((n, 0), dtype=np.int64)
    for start in range(0, right.shape[0], BLOCK_ROWS):
        sims = np.round(left @ right[start:start + BLOCK_ROWS].T, DIGITS)
        idx = np.broadcast_to(np.arange(start, start + sims.shape[1]), sims.shape)
        s = np.concatenate([best_s, sims], axis=1)
        i = np.concatenate([best_i, idx], axis=1)
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    return best_s, best_i


def _emit(left_ids, best_s, best_i, right_ids, threshold, names) -> pd.DataFrame:
    k = best_s.shape[1]
    sims, idx = best_s.ravel(), best_i.ravel()
    keep = sims >= threshold
    return pd.DataFrame({
        names[0]: np.repeat(np.asarray(left_ids), k)[keep],
        names[1]: np.asarray(right_ids)[idx[keep]],
        "similarity": sims[keep],
    })


def _matches(left_ids, left, right_ids, right, k, threshold, names) -> pd.DataFrame:
    """The k best right rows of each left row, or all at or above the threshold if k is None."""
    if k is not None:
        s, i = _best(left, right, k)
        return _emit(left_ids, s, i, right_ids, threshold, names)
    parts = []
    for start in range(0, right.shape[0], BLOCK_ROWS):
        sims = np.round(left @ right[start:start + BLOCK_ROWS].T, DIGITS)
        i, j = np.nonzero(sims >= threshold)
        parts.append(pd.DataFrame({names[0]: np.asarray(left_ids)[i], names[1]: np.asarray(right_ids)[start + j], "similarity": sims[i, j]}))
    return pd.concat(parts)


def top_k(left: DataFrame, left_id: str, right: DataFrame, right_id: str, k: int | None = 1,
          threshold: float = -2.0, vector: str = "embedding", small_side_rows: int | None = None) -> DataFrame:
    """(left_id, right_id, similarity) of the k most similar right rows at or above the threshold; k None: all of them."""
    spark = left.sparkSession
    l = left.filter(F.col(vector).isNotNull()).select(left_id, F.col(vector).alias("v"))
    r = right.filter(F.col(vector).isNotNull()).select(right_id, F.col(vector).alias("v"))
    types = {f.name: f.dataType.simpleString() for f in l.schema.fields + r.schema.fields}
    schema = f"{left_id} {types[left_id]}, {right_id} {types[right_id]}, similarity double"
    names = (left_id, right_id)
    if small_side_rows is None:
        one = r.select(F.size("v").alias("d")).first()
        small_side_rows = max(1, SMALL_SIDE_BYTES // (8 * max(1, one["d"]))) if one else 1
    head = r.limit(small_side_rows + 1).toPandas()  # size check and transfer in one job
    if len(head) <= small_side_rows:
        if not len(head):
            return spark.createDataFrame([], schema)
        head = head.sort_values(right_id)
        side = spark.sparkContext.broadcast((head[right_id].to_numpy(), _matrix(head["v"])))

        def scan(batches):
            ids, matrix = side.value
            for pdf in batches:
                for start in range(0, len(pdf), BLOCK_ROWS):
                    part = pdf.iloc[start:start + BLOCK_ROWS]
                    yield _matches(part[left_id].to_numpy(), _matrix(part["v"]), ids, matrix, k, threshold, names)

        return l.mapInPandas(scan, schema)

    n_left, n_right = l.count(), r.count()
    blocks, chunks = math.ceil(n_right / small_side_rows), max(1, math.ceil(n_left / small_side_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lc = l.withColumn("chunk", F.pmod(F.xxhash64(left_id), F.lit(chunks)).cast("int")).withColumn("block", every(blocks))
    rb = r.withColumn("block", F.pmod(F.xxhash64(right_id), F.lit(blocks)).cast("int")).withColumn("chunk", every(chunks))

    def join_blocks(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(lp) or not len(rp):
            return pd.DataFrame({left_id: [], right_id: [], "similarity": []})
        rp = rp.sort_values(right_id)
        matrix, ids = _matrix(rp["v"]), rp[right_id].to_numpy()
        out = []
        for start in range(0, len(lp), BLOCK_ROWS):
            part = lp.iloc[start:start + BLOCK_ROWS]
            out.append(_matches(part[left_id].to_numpy(), _matrix(part["v"]), ids, matrix, k, threshold, names))
        return pd.concat(out)

    found = lc.groupBy("block", "chunk").cogroup(rb.groupBy("block", "chunk")).applyInPandas(join_blocks, schema)
    if k is None:
        return found
    w = Window.partitionBy(left_id).orderBy(F.col("similarity").desc(), F.col(right_id))
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def best_match(left: DataFrame, left_id: str, right: DataFrame, right_id: str, threshold: float = -2.0, **kw) -> DataFrame:
    return top_k(left, left_id, right, right_id, 1, threshold, **kw)


def vector_classes(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, rep): rows with the very same vector share the smallest key as representative."""
    v = df.filter(F.col(vector).isNotNull()).select(key, F.col(vector).alias("v"))
    reps = v.groupBy("v").agg(F.min(key).alias("rep"))
    return v.join(reps, "v").select(key, "rep")


SAMPLE_ROWS = 4_096  # rows that fit the rotation and the cell centres
LEAD = 16            # leading dimensions compared before whole vectors
MOST_BLOCK_BYTES = 16 << 20  # of a block of vectors in pairs_above: rows x dimension x 8
FEW_BLOCKS = 12      # blocks of a table too small for whole ones, so that all cores have pairs of blocks


def place(centres: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, angle to every centre) of rows."""
    angle = np.arccos(np.clip(v @ centres.T, -1.0, 1.0))
    return angle.argmin(axis=1), angle


def lead(rotation: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated dimensions and the length of the others: dot(x, y) <= dot(leads) + product of lengths."""
    r = v @ rotation
    m = min(LEAD, r.shape[1])
    return r[:, :m], np.sqrt(np.maximum((r[:, m:] ** 2).sum(axis=1), 0.0))


def fit_index(v: DataFrame, n: int, max_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres (cells, d) of unit length, rotation (d, d) with the directions of most spread first) for rows (id, v).

    Fitted on a hash sample of about SAMPLE_ROWS rows. Any centres and any rotation give exact results: they only
    decide how much a bound rules out.
    """
    step = max(1, n // SAMPLE_ROWS)
    part = v.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).limit(4 * SAMPLE_ROWS).toPandas() if step > 1 else v.toPandas()
    part = part if len(part) else v.limit(1).toPandas()
    x = _matrix(part.sort_values("id")["v"])
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]  # of the small matrix: the others of a decomposition of x have rows x rows numbers
    cells = max(1, min(max_cells, math.isqrt(n) // 2 + 1, len(x)))
    centres = [x[0]]
    nearest = x @ x[0]
    for _ in range(cells - 1):  # the row farthest from all centres is the next one
        far = int(nearest.argmin())
        centres.append(x[far])
        nearest = np.maximum(nearest, x @ x[far])
    c = np.stack(centres)
    for _ in range(4):
        home = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            mean = x[home == j].sum(axis=0)
            if len(x[home == j]) and np.linalg.norm(mean) > 0:
                c[j] = mean / np.linalg.norm(mean)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12), axes


def _above(left, right, left_lead, right_lead, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, column, similarity) of pairs at or above the threshold, and how many whole products that took."""
    (la, lr), (ra, rr) = left_lead, right_lead
    maybe = la @ ra.T + np.outer(lr, rr) >= threshold - 1e-6
    full = int(maybe.sum())
    if full > maybe.size // 16:  # one matrix product is faster than many single ones; the count stays what the bound left
        maybe &= left @ right.T >= threshold - 1e-6
    i, j = np.nonzero(maybe)
    sims = np.zeros(len(i))
    for k in range(0, len(i), 16 * BLOCK_ROWS):
        part = slice(k, k + 16 * BLOCK_ROWS)
        sims[part] = np.round(np.einsum("ij,ij->i", left[i[part]], right[j[part]]), DIGITS)
    hit = sims >= threshold
    return i[hit], j[hit], sims[hit], full


def block_cells(homes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell from its number of rows: small cells share a block, large ones are cut."""
    first, pieces = np.zeros(len(homes), dtype=np.int64), np.maximum(1, -(-homes // block_rows))
    block, rows = 0, 0
    for c, n in enumerate(homes.tolist()):
        if rows and rows + n > block_rows:
            block, rows = block + 1, 0
        first[c] = block
        block, rows = (block + int(pieces[c]), 0) if pieces[c] > 1 else (block, rows + n)
    return first, pieces


def strongest_forest(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Places of the edges of the spanning forest of greatest s; ties go to the smaller (a, b). At most one edge less than nodes."""
    order = np.lexsort((b, a, -s))
    nodes, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    at, taken = np.arange(len(a)), []  # places in `order`: the smaller, the stronger
    while len(at):
        best = np.full(len(nodes), len(at))
        np.minimum.at(best, x, np.arange(len(at)))
        np.minimum.at(best, y, np.arange(len(at)))
        own = np.nonzero(best < len(at))[0]
        edge = best[own]
        taken.append(np.unique(at[edge]))
        up = np.arange(len(nodes))
        up[own] = np.where(x[edge] == own, y[edge], x[edge])
        loop = (up[up] == np.arange(len(nodes))) & (np.arange(len(nodes)) < up)  # two that took the same edge
        up[loop] = np.nonzero(loop)[0]
        while (up[up] != up).any():
            up = up[up]
        x, y = up[x], up[y]
        live = x != y
        x, y, at = x[live], y[live], at[live]
    return order[np.concatenate(taken)] if taken else order[:0]


def pairs_above(df: DataFrame, key: str, threshold: float, vector: str = "embedding", max_cells: int = 1024,
                block_rows: int | None = None, report: dict | None = None, forest: bool = False) -> DataFrame:
    """All (a, b, similarity) with a < b and similarity >= threshold of unit vectors; exact, no pair found twice.

    Every vector has a home cell, and every cell its radius, the largest angle of its members to the centre. Cells are
    gathered into blocks (large cells are cut), and a vector visits the earlier blocks with a cell whose centre lies
    within radius + angle of the threshold, since the triangle inequality on angles leaves no partner in others. So a
    vector is sent once for a block, however many cells there are. In a cell, leading dimensions and residual lengths
    rule out most pairs before whole vectors are multiplied. `report` takes the number of vectors, of pairs that met in
    cells, and of whole products (counted as results are first read). With `forest`, each pair of blocks gives only its
    own strongest spanning forest: the spanning forest and the components of all pairs stay the same.
    """
    spark = df.sparkSession
    v = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    id_type, v_type = v.schema["id"].dataType.simpleString(), v.schema["v"].dataType.simpleString()
    n = v.count()
    schema = f"a {id_type}, b {id_type}, similarity double"
    if n < 2:
        return spark.createDataFrame([], schema)
    centres, rotation = fit_index(v, n, max_cells)
    along = np.argsort(centres @ rotation[:, 0], kind="stable")  # neighbours tend to share a block
    side = spark.sparkContext.broadcast((centres[along], rotation))
    met, products = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def homes(batches):
        for pdf in batches:
            for start in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[start:start + BLOCK_ROWS]
                home, angle = place(side.value[0], _matrix(part["v"]))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "v": part["v"].to_numpy(), "home": home.astype("int32"), "angle": angle[np.arange(len(home)), home]})

    housed = materialize(v.mapInPandas(homes, f"id {id_type}, v {v_type}, home int, angle double"), "cells")
    radius, rows = np.full(len(centres), -np.inf), np.zeros(len(centres), dtype=np.int64)
    for r in housed.groupBy("home").agg(F.max("angle").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # at most max_cells rows
        radius[r["home"]], rows[r["home"]] = r["r"], r["n"]
    if block_rows is None:
        block_rows = min(max(BLOCK_ROWS, MOST_BLOCK_BYTES // (8 * centres.shape[1])), max(BLOCK_ROWS, n // FEW_BLOCKS + 1))
    first, pieces = block_cells(rows, block_rows)
    blocks = int((first + pieces).max())
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def visit(batches):
        for pdf in batches:
            for start in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[start:start + BLOCK_ROWS]
                near = place(side.value[0], _matrix(part["v"]))[1] <= radius[None, :] + reach
                seen = np.zeros((len(part), blocks), dtype=bool)
                for c in range(len(radius)):
                    seen[:, first[c]:first[c] + pieces[c]] |= near[:, c:c + 1]
                own = part["block"].to_numpy()
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "v": part["v"].to_numpy(), "home": part["home"].to_numpy(), "block": own,
                    "visits": [np.nonzero(row[:b])[0].astype("int32") for row, b in zip(seen, own)]})

    first_of, pieces_of = (F.array(*[F.lit(int(x)) for x in xs]) for xs in (first, pieces))
    block = F.get(first_of, F.col("home")) + F.pmod(F.xxhash64("id"), F.get(pieces_of, F.col("home")))
    placed = housed.select("id", "v", "home", block.cast("int").alias("block"))
    placed = materialize(placed.mapInPandas(visit, f"id {id_type}, v {v_type}, home int, block int, visits array<int>"), "blocks")
    left = placed.select("id", "v", "home", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("j"), F.lit(True).alias("is_left"))
    right = placed.select("id", "v", "home", F.explode("visits").alias("i"), F.col("block").alias("j"), F.lit(False).alias("is_left"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        inside = pdf["i"].iat[0] == pdf["j"].iat[0]
        l = pdf[pdf["is_left"]]
        r = l if inside else pdf[~pdf["is_left"]]
        parts = [(np.zeros(0, dtype=pdf["id"].dtype),) * 2 + (np.zeros(0),)]
        if len(l) and len(r):
            lv, rv = _matrix(l["v"]), _matrix(r["v"])
            (la, lr), (ra, rr) = lead(side.value[1], lv), lead(side.value[1], rv)
            l_id, r_id, l_home, r_home = l["id"].to_numpy(), r["id"].to_numpy(), l["home"].to_numpy(), r["home"].to_numpy()
            for cell in np.unique(l_home):
                here = np.nonzero(l_home == cell)[0]
                near = np.arccos(np.clip(rv @ side.value[0][cell], -1.0, 1.0)) <= radius[cell] + reach
                others = np.nonzero(near & (r_home >= cell) if inside else near)[0]
                for x in (here[k:k + BLOCK_ROWS] for k in range(0, len(here), BLOCK_ROWS)):
                    for y in (others[k:k + BLOCK_ROWS] for k in range(0, len(others), BLOCK_ROWS)):
                        i, j, sims, full = _above(lv[x], rv[y], (la[x], lr[x]), (ra[y], rr[y]), threshold)
                        met.add(len(x) * len(y))
                        products.add(full)
                        i, j = x[i], y[j]
                        keep = (r_home[j] != cell) | (l_id[i] < r_id[j]) if inside else slice(None)
                        parts.append((l_id[i][keep], r_id[j][keep], sims[keep]))
        li, rj, s = (np.concatenate(c) for c in zip(*parts))
        a, b = np.where(li > rj, rj, li), np.where(li > rj, li, rj)
        kept = strongest_forest(a, b, s) if forest else slice(None)
        return pd.DataFrame({"a": a[kept], "b": b[kept], "similarity": s[kept]})

    sent = left.unionByName(right).repartition(max(1, blocks * (blocks + 1) // 2), "i", "j")
    out = sent.groupBy("i", "j").applyInPandas(match, schema)
    if report is not None:
        out = materialize(out, "pairs")
        report.update(vectors=n, met=met.value, products=products.value, wanted=out.count())
    return out


def mean_of(columns: list[Column]) -> Column:
    """Mean of the columns that are not NULL; NULL when all are."""
    present = [F.when(c.isNotNull(), 1).otherwise(0) for c in columns]
    n = reduce(lambda a, b: a + b, present)
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])
    return F.when(n > 0, total / n)
