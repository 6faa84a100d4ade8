"""Threshold pair join: the pairs of a group whose shared features weigh enough, without listing the others.

For rows (g, e, f, w, k) a pair weighs the sum over shared features of k * w_a * w_b (k, w > 0), and is wanted if
that reaches the smaller of the two entities' needs. Features are ordered from rare to common. Behind each place of
an entity's list lies the mass that its later features can add with anybody (k * w * the largest w of the feature), so

* only the head of a list, where the mass still reaches the need, is compared: a pair that meets in no head is too light;
* heads of one class of needs meet heads cut for that class, so common features of large entities meet few;
* a pair that met is dropped when what it has so far and the mass behind the earlier end stay under the need;
* the others are summed over whole lists, unless nothing lies behind.

Every rule is a true bound, so no wanted pair is lost and every weight is exact. A caller that wants only some of the pairs
gives a rule over traits of the two entities; it is asked in the task that meets the pair, so others never leave it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .lineage import materialize

EPS = 1e-9
BLOCK_ENTITIES = 2048        # heads of one side in a task, as long as these make few blocks
BLOCKS = 8                   # of a side; beyond as many, a block holds as many times more, as each row goes to each block of the other side
PRODUCTS_AT_ONCE = 1 << 20   # of a step of the sums
PAIRS_JUDGED = 1 << 16       # of a step of a caller's rule


def _blocks_of(n):
    """Number of blocks for n entities."""
    size = F.ceil(n / BLOCK_ENTITIES)
    return F.least(size, F.greatest(F.lit(BLOCKS), F.ceil(n / (BLOCKS * BLOCK_ENTITIES)))).cast("int")


def pair_sums(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Given pairs (g, a, b, ...) with their `total` over rows (g, e, f, w, k); pairs without shared features give no row.

    Entities lie in blocks; a pair of blocks takes the lists its pairs name, so no list is repeated for every pair.
    """
    one = rows.groupBy("g", "e").agg(F.collect_list(F.struct("f", "w", F.expr("k * w").alias("kw"))).alias("l"))
    lists = materialize(one.select("g", "e", F.col("l.f").alias("fs"), F.col("l.w").alias("ws"), F.col("l.kw").alias("kws")), "lists")
    blocks = lists.groupBy("g").agg(_blocks_of(F.count(F.lit(1))).alias("n"))
    at = lambda c: F.pmod(F.xxhash64(c), "n").cast("int")
    placed = materialize(pairs.join(blocks, "g").select(*pairs.columns, at("a").alias("i"), at("b").alias("j")), "placed")
    own = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  columns of their own, as both sides of the match come from `placed`
    named = lambda c, vs: placed.select(*own("g", "i", "j"), F.col(c).alias("e")).distinct().join(
        lists.select("g", "e", "fs", F.col(vs).alias("ws")), ["g", "e"]).withColumn("is_a", F.lit(c == "a"))
    key = ["g", "i", "j"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", total double"

    def total(given: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        given = given.drop(columns=["i", "j"])
        if not len(given) or not len(sides):
            return given.iloc[:0].assign(total=[])
        given = given.assign(total=_sums_of(given["a"], given["b"], sides[sides["is_a"]], sides[~sides["is_a"]]))
        return given[given["total"] > 0]

    return placed.groupBy(*key).cogroup(named("a", "kws").unionByName(named("b", "ws")).groupBy(*key)).applyInPandas(total, schema)


def _sums_of(a: pd.Series, b: pd.Series, x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
    """Sum over shared features of the lists (e, fs, ws) that each pair names; 0 for a pair with an unknown end."""
    i, j = pd.Index(x["e"]).get_indexer(a), pd.Index(y["e"]).get_indexer(b)
    out = np.zeros(len(a))
    if not len(x) or not len(y):
        return out
    nx, ny = (np.array([len(f) for f in side["fs"]]) for side in (x, y))
    feats, code = np.unique(np.concatenate([*x["fs"], *y["fs"]]), return_inverse=True)
    fx, fy = np.split(code.ravel().astype(np.int64), [nx.sum()])
    wx, wy = np.concatenate(list(x["ws"])), np.concatenate(list(y["ws"]))
    cell = np.repeat(np.arange(len(y)), ny) * len(feats) + fy
    by = np.argsort(cell)
    cell, wy = cell[by], wy[by]
    start = np.cumsum(nx) - nx
    known = np.flatnonzero((i >= 0) & (j >= 0))
    known = known[np.argsort(j[known], kind="stable")]  # neighbours look in the same lists
    upto, at = np.cumsum(nx[i[known]]), 0
    while at < len(known):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PRODUCTS_AT_ONCE, side="right")))
        p = known[at:to]
        n = nx[i[p]]
        own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[i[p]], n)
        want = np.repeat(j[p], n) * len(feats) + fx[own]
        found = np.minimum(np.searchsorted(cell, want), len(cell) - 1)
        out[p] = np.bincount(np.repeat(np.arange(len(p)), n), np.where(cell[found] == want, wx[own] * wy[found], 0.0), minlength=len(p))
        at = to
    return out


def listed(rows: DataFrame, unit: bool = False) -> DataFrame:
    """rows (g, e, f, w, k, need) with the place of each feature, (rare to common), and `tail`, the mass from there on.

    unit: the rows of an entity have length 1 and k is 1 / need, so the length of a tail bounds its mass, too.
    """
    facts = rows.groupBy("g", "f").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("top")).filter("df > 1")
    back = Window.partitionBy("g", "e").orderBy(F.col("df").desc(), F.col("f").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tail = F.sum(F.expr("k * w * top")).over(back)
    if unit:
        tail = F.least(tail, F.col("k") * F.sqrt(F.sum(F.expr("w * w")).over(back)))
    return rows.join(facts, ["g", "f"]).withColumn("tail", tail).withColumn("place", F.struct("df", "f"))


def _heads(rows: DataFrame, floor, *key: str) -> DataFrame:
    """The rows whose tail reaches `floor`, with the end of that head and the mass behind it."""
    w = Window.partitionBy("g", "e", *key)
    inside = F.col("tail") >= floor - EPS
    return (
        rows.withColumn("behind", F.coalesce(F.max(F.when(~inside, F.col("tail"))).over(w), F.lit(0.0)))
        .withColumn("end", F.max(F.when(inside, F.col("place"))).over(w)).filter(inside))


def _blocked(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the pair of blocks (i, j) they meet in: every row goes once to each block of the other side."""
    size = lambda df, n: df.groupBy("g", "cls").agg(_blocks_of(F.count(F.lit(1))).alias(n))
    grid = size(a, "ni").join(size(b, "nj"), ["g", "cls"])
    own = lambda n: F.pmod(F.xxhash64("e"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    return (a.join(grid, ["g", "cls"]).select(*a.columns, own("ni").alias("i"), each("nj").alias("j")),
            b.join(grid, ["g", "cls"]).select(*b.columns, own("nj").alias("j"), each("ni").alias("i")))


def _shared(x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sum) of the rows of x and y that share a feature. Rows of x go in steps of a bounded number of products; room
    is taken for every pair of a step only where many of them meet."""
    nx, ny = (np.array([len(f) for f in side["fs"]]) for side in (x, y))
    code = np.unique(np.concatenate([*x["fs"], *y["fs"]]), return_inverse=True)[1].ravel()
    fx, fy = np.split(code, [nx.sum()])
    by = np.argsort(fy, kind="stable")
    fy, row_y, wy = fy[by], np.repeat(np.arange(len(y)), ny)[by], np.concatenate(list(y["ws"]))[by]
    row_x, wx = np.repeat(np.arange(len(x)), nx), np.concatenate(list(x["ws"]))
    first = np.searchsorted(fy, fx)
    partners = np.searchsorted(fy, fx, side="right") - first
    end = np.cumsum(nx)
    upto = np.cumsum(partners)[end - 1]  # products up to the end of each row
    out, row = [], 0
    while row < len(x):
        to = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + PRODUCTS_AT_ONCE, side="right")))
        at, upper = end[row] - nx[row], end[to - 1]
        n = partners[at:upper]
        own = np.repeat(np.arange(at, upper), n)
        other = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[own]
        cell, product = (row_x[own] - row) * len(y) + row_y[other], wx[own] * wy[other]
        if (to - row) * len(y) <= 8 * len(cell):
            sums = np.bincount(cell, product, minlength=(to - row) * len(y))
            cell = np.flatnonzero(sums)
            sums = sums[cell]
        else:
            cell, place = np.unique(cell, return_inverse=True)
            sums = np.bincount(place.ravel(), product, minlength=len(cell))
        out.append((cell // len(y) + row, cell % len(y), sums))
        row = to
    return tuple(np.concatenate(part) for part in zip(*out))


def _earlier(x: pd.DataFrame, y: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the end of x is not behind that of y."""
    code = np.unique(np.concatenate([x["end_f"].to_numpy(), y["end_f"].to_numpy()]), return_inverse=True)[1].ravel()
    ex, ey = np.split(code, [len(x)])
    dx, dy = x["end_df"].to_numpy()[i], y["end_df"].to_numpy()[j]
    return (dx < dy) | ((dx == dy) & (ex[i] <= ey[j]))


def _block_sums(x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sums and _earlier of all rows of x with all rows of y."""
    i, j, sums = _shared(x, y)
    out = np.zeros((len(x), len(y)))
    out[i, j] = sums
    return out, _earlier(x, y, *np.indices(out.shape).reshape(2, -1)).reshape(out.shape)


Rule = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], np.ndarray]  # traits of both ends, bound of the total -> wanted
HEAD = ["g", "cls", "i", "j", "e", "need", "behind", "end_df", "end_f", "fs", "ws"]


def _meet(x: pd.DataFrame, y: pd.DataFrame, wanted: Rule | None = None) -> pd.DataFrame:
    """The pairs of two blocks that may still reach the need of the first."""
    if not len(x) or not len(y):  # columns of the right kinds, as an empty list would be numbers
        none, some = np.zeros(0), x if len(x) else y
        return pd.DataFrame({"g": some["g"].iloc[:0], "a": some["e"].iloc[:0], "b": some["e"].iloc[:0], "need": none, "part": none, "more": none})
    i, j, part = _shared(x, y)
    ex, ey = x["e"].to_numpy(), y["e"].to_numpy()
    more = np.where(_earlier(x, y, i, j), x["behind"].to_numpy()[i], y["behind"].to_numpy()[j])
    need, need_b = x["need"].to_numpy()[i], y["need"].to_numpy()[j]
    keep = (part + more >= need - EPS) & (need <= need_b)
    i, j, part, need, need_b, more = (v[keep] for v in (i, j, part, need, need_b, more))
    keep = (need < need_b) | (ex[i] < ey[j])
    i, j, part, need, more = (v[keep] for v in (i, j, part, need, more))
    if wanted is not None:
        tx, ty = x.drop(columns=HEAD, errors="ignore"), y.drop(columns=HEAD, errors="ignore")
        steps = [slice(at, at + PAIRS_JUDGED) for at in range(0, len(i), PAIRS_JUDGED)]
        keep = np.concatenate([np.zeros(0, bool), *[wanted(tx.iloc[i[s]], ty.iloc[j[s]], (part + more)[s]) for s in steps]])
        i, j, part, need, more = (v[keep] for v in (i, j, part, need, more))
    return pd.DataFrame({"g": x["g"].iloc[0], "a": ex[i], "b": ey[j], "need": need, "part": part, "more": more})


def met(rows: DataFrame, traits: DataFrame | None = None, wanted: Rule | None = None) -> DataFrame:
    """(g, a, b, need, part, more): pairs that share a feature of their heads and may still reach their need.

    part is what they share inside both heads, more a bound for what they share behind the earlier end. `a` is the one
    with the smaller need (of equal needs, the smaller entity).

    A head is one row with its list. Blocks of heads meet block by block, so the sums of a pair are made in one task
    and only pairs that are kept leave it; a row is sent once to each block of the other side.
    """
    cls = F.greatest(F.floor(F.log2(F.col("need") + EPS)), F.lit(0)).cast("int")
    rows = rows.withColumn("cls", cls)

    def lists(heads, w):
        first = lambda c: F.max(c).alias(c)  # noqa: E731  the same in all rows of a head
        one = heads.groupBy("g", "e", "cls").agg(F.collect_list(F.struct("f", w.alias("w"))).alias("l"), first("need"), first("behind"), first("end"))
        return one.select("g", "e", "cls", "need", "behind", F.col("end.df").alias("end_df"), F.col("end.f").alias("end_f"), F.col("l.f").alias("fs"), F.col("l.w").alias("ws"))

    known = lambda heads: heads if traits is None else heads.join(traits, ["g", "e"])
    a = materialize(known(lists(_heads(rows, F.col("need")), F.expr("k * w"))), "heads")
    each = rows.withColumn("cls", F.explode(F.sequence(F.lit(0), F.col("cls"))))
    floor = F.when(F.col("cls") == 0, F.least(F.lit(1.0), F.col("need"))).otherwise(F.pow(F.lit(2.0), F.col("cls")))
    b = materialize(known(lists(_heads(each, floor, "cls"), F.col("w"))), "heads")
    left, right = _blocked(a, b)
    key = ["g", "cls", "i", "j"]
    schema = f"g {rows.schema['g'].dataType.simpleString()}, a string, b string, need double, part double, more double"
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda x, y: _meet(x, y, wanted), schema)


def heavy_pairs(rows: DataFrame, unit: bool = False, report: dict | None = None, traits: DataFrame | None = None, wanted: Rule | None = None) -> DataFrame:
    """(g, a, b, total): all pairs a < b whose total reaches the smaller need of the two (and which `wanted` keeps, see met).

    rows: (g, e, f, w, k, need), unique per (g, e, f), e a string, w and k above 0, need at least 1 (scale k and need
    together). `report` takes the numbers of pairs that met and were kept by the bounds, summed anew, and wanted.
    """
    rows = materialize(listed(rows, unit), "pair-rows")  # a feature of one entity adds nothing
    found = materialize(met(rows, traits, wanted), "met")
    sure = found.filter("more = 0").select("g", "a", "b", "need", F.col("part").alias("total"))
    open_ = found.filter("more > 0")
    summed = pair_sums(open_.select("g", "a", "b", "need"), rows)
    out = sure.unionByName(summed).filter(F.col("total") >= F.col("need") - EPS).select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total")
    if report is not None:
        out = materialize(out, "heavy")
        report.update(met=found.count(), summed=open_.count(), wanted=out.count())
    return out
