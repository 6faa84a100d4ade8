"""Merkle manifest of a document table, with proofs by checkpoint and recomputation (operator 12).

Every source has a tree over its leaves in doc_id order, and one more tree stands over the subroots of all sources.
Only every third level of a tree is written (a node of one is the digest of up to 27 nodes of the level below). A proof
needs the siblings on every level: those between two written levels are worked out anew from the written nodes of the
aligned subtree they stand in, given out as siblings, and forgotten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.lineage import materialize
from .places import group_key, ranked

FAN = 3
STRIDE = 3  # every third level is written
SUBTREE = FAN**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def digest(*values):
    """H of the given columns: each is `-` if null, else its UTF-8 length, a colon and the value."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[part(v) for v in values]), 256)


def leaves(docs: DataFrame, tampered=None) -> DataFrame:
    """(doc_id, g, leaf, found): the leaf of every row, and the leaf its text gives after `tampered` (a function of the
    text column, by default none). Texts are read here only; all that follows moves digests."""
    value = {c: F.col(c).cast("string") for c in FIELDS}
    other = value["text"] if tampered is None else tampered(value["text"])
    rows = docs.select("doc_id", group_key("source").alias("g"), digest(*value.values()).alias("leaf"), digest(*[value[c] for c in FIELDS[:-1]], other).alias("found"))
    return materialize(rows, "leaves")


def _above(level: str) -> str:
    """The digests over every FAN digests of an array."""
    return f"transform(sequence(0, cast((size({level}) - 1) div {FAN} as int)), i -> sha2(array_join(slice({level}, {FAN} * i + 1, {FAN}), ''), 256))"


def _subtrees(nodes: DataFrame, *more: str) -> DataFrame:
    """(g, block, n, members, l0 .. l3): the nodes of each aligned subtree in order, and its interior levels."""
    fields = ("pos", "digest", *more)
    out = nodes.groupBy("g", F.expr(f"pos div {SUBTREE}").alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("members"))
    out = out.withColumn("l0", F.expr("transform(members, m -> m.digest)"))
    for i in range(STRIDE):
        out = out.withColumn(f"l{i + 1}", F.expr(_above(f"l{i}")))
    return out


def _height(n: str = "n") -> str:
    """Levels from n nodes to one, STRIDE at most."""
    return "CASE " + " ".join(f"WHEN {n} <= {FAN**i} THEN {i}" for i in range(STRIDE)) + f" ELSE {STRIDE} END"


def written_levels(nodes: DataFrame) -> list[DataFrame]:
    """The written levels over (g, pos, digest, n), from the lowest to the one where every group has one node."""
    levels = [nodes.select("g", "pos", "digest", "n")]
    while True:
        most = levels[-1].agg(F.max("n")).first()[0]
        if most is None or most <= 1:
            return levels
        top = F.expr("element_at(CASE " + _height() + " " + " ".join(f"WHEN {i} THEN l{i}" for i in range(1, STRIDE + 1)) + " END, 1)")
        up = _subtrees(levels[-1].filter("n > 1")).select("g", F.col("block").alias("pos"), top.alias("digest"), F.expr(f"(n + {SUBTREE - 1}) div {SUBTREE}").alias("n"))
        levels.append(materialize(up, "level"))


def roots(levels: list[DataFrame]) -> DataFrame:
    """(g, digest): the one node that each group ends in."""
    return reduce(DataFrame.unionByName, [level.filter("n = 1").select("g", "digest") for level in levels])


def _siblings(k: str) -> str:
    """For place k of a subtree: (left, right) siblings on each of its levels, ready to be put round the folded digest."""
    steps = []
    for i in range(STRIDE):
        at = f"cast({k} div {FAN**i} as int)"
        steps.append(
            f"CASE WHEN {_height()} > {i} THEN named_struct("
            f"'left', array_join(slice(l{i}, {at} - {at} % {FAN} + 1, {at} % {FAN}), ''), "
            f"'right', array_join(slice(l{i}, {at} + 2, {FAN - 1} - {at} % {FAN}), '')) END")
    return f"array_compact(array({', '.join(steps)}))"


def paths(nodes: DataFrame, levels: list[DataFrame], ends: DataFrame, *more: str) -> DataFrame:
    """nodes (g, pos, digest, n, *more) with `path`, the siblings from a node to the end of all, and the columns of `ends`.

    ends has one row for each group: g, path from the group's root on, and columns to hand down. The walk goes from the
    highest written level to the lowest; a subtree regenerates its interior and meets the path of its own top node.
    """
    handed = [c for c in ends.columns if c not in ("g", "path")]
    known = None
    for i in range(len(levels) - 1, -1, -1):
        level, extra = (nodes, more) if i == 0 else (levels[i], ())
        keep = ["g", "pos", "n", "digest", *extra]
        parts = [level.filter("n = 1").select(*keep).join(ends, "g").select(*keep, "path", *handed)]
        if known is not None:
            sub = _subtrees(level.filter("n > 1"), *extra)
            upper = known.select("g", F.col("pos").alias("block"), "path", *handed)
            each = sub.join(upper, ["g", "block"]).select("g", "n", "l0", "l1", "l2", "path", *handed, F.posexplode("members").alias("k", "m"))
            parts.append(each.select("g", "m.pos", "n", "m.digest", *[f"m.{c}" for c in extra], F.concat(F.expr(_siblings("k")), "path").alias("path"), *handed))
        known = reduce(DataFrame.unionByName, parts)
        if i:
            known = materialize(known, "paths")
    return known


def folded(leaf, path):
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def manifest(docs: DataFrame, tampered=None) -> DataFrame:
    """(doc_id, leaf, found, subroot, root, path), a row for each row of docs; `path` lists (left, right) siblings from
    the leaf by its subroot to the root, and `found` is the leaf of the text as `tampered` left it.

    Null values have their own mark in a leaf, so null and empty differ; rows without a source have a tree of their
    own, the first. Null doc_ids are the first leaves of a tree. Rows that repeat a doc_id are leaves each, in the
    order of their digests; rows alike in everything may swap places. A table without rows has no root and gives no
    row. Other columns are ignored. No group is ever held whole: rows are dealt by range, and a subtree has 27 nodes.
    """
    spark = docs.sparkSession
    rows = leaves(docs, tampered)
    nodes = ranked(rows, "g", ["doc_id", "leaf", "found"], "placed", totals=True).withColumn("digest", F.col("leaf"))
    nodes = materialize(nodes, "nodes")
    levels = written_levels(nodes)
    subroots = materialize(roots(levels).select(F.lit("0").alias("g"), F.col("g").alias("tree"), "digest"), "subroots")
    tops = materialize(ranked(subroots, "g", ["tree"], "trees", totals=True), "tops")
    upper = written_levels(tops)
    end = roots(upper).select("g", F.col("digest").alias("root"), F.array().cast(STEPS).alias("path"))
    ends = paths(tops, upper, end, "tree").select(F.col("tree").alias("g"), F.col("digest").alias("subroot"), "root", "path")
    ends = materialize(ends, "ends")
    out = paths(nodes, levels, ends, "doc_id", "leaf", "found")
    return out.select("doc_id", "leaf", "found", "subroot", "root", "path")


def proofs(docs: DataFrame, tampered=None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): manifest() with its digests."""
    joined = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = manifest(docs, tampered).withColumn("folded_root", folded(F.col("found"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def no_line_ends(text):
    """The tampering of the query: where 2 divides the crc32 of the decimal doc_id, the text loses its line ends."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
