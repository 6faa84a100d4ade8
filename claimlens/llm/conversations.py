"""Repair of conversation structure: cost DP, then prefix-doubling ranks over the optimal arcs (operator 11).

The repaired roles of a conversation have to read `(s?(ua)+)?`. Nodes are (rows used, state); states are none, system,
user and assistant. Arcs are the edits, with the initials D, I, K, R. A conversation is cut into chunks of bounded
length. What a chunk does to the costs is a 4 x 4 matrix (least sums), and matrices multiply, so the costs behind every
chunk are found by combining chunks over a few levels; what a chunk does to the state along the least path is a map of
four states, and maps compose, which gives the state in front of every chunk. No task holds more than some chunks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.lineage import materialize
from .places import group_key, of_key, ranked
from .texts import numbers, partitions

CHUNK = 256
FAN = 64
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES = "-sua"
LETTERS = "DIKR"  # in ASCII order, so a smaller code is a smaller audit
D, I, K, R = range(4)
FAR = 1 << 40
#: costs of edits, fixed by the contract
COST = {D: 2, I: 5, K: 0, R: 1}
UNFINISHED = 5
#: behind the last row: what a state still has to pay, and the edits that pay it
END = np.array([0, 2 * COST[I], COST[I], 0], np.int64)
END_EDITS = ("", "II", "I", "")
NEXT = np.array([USER, USER, ASSISTANT, USER])  # where an inserted or rerolled message leads from a state
#: where a kept row leads: by initial (other, s, u, a) and state; -1 is not allowed
KEEP = np.array([[-1, -1, -1, -1], [SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1]])
BLANK = r"[^\x20\x09-\x0D]"


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after the damage of the query: by crc32(`conv_id:turn`) % 20, 0 drops a row, 1 empties its text, 2 takes
    its `[.!?]`, 3 repeats it, 4 makes it the user's. Nulls in any of it are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).alias("kind")
    base = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), word("role").alias("role"), word("text").alias("text"), kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def placed_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, marks) of rows (conv_id, turn, role, text): (g, pos, role, text) and (g, pos, turn, code, fault).

    Places go by turn, null first, then role, then the SHA-256 of the text. `fault` is the first fault of a row. code
    packs the initial (0 other, 1 s, 2 u, 3 a), 4 if the row must go (blank or duplicate) and 8 if its text does not end.
    """
    word = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    last = F.regexp_extract("text", rf"({BLANK})[\x20\x09-\x0D]*\z", 1)
    keyed = rows.select(group_key("conv_id").alias("g"), "turn", word("role"), word("text")).select(
        "*", F.sha2("text", 256).alias("sha"), F.when(~F.col("text").rlike(BLANK), F.lit("blank")).when(~last.isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit("none")).alias("own"))
    placed = ranked(keyed, "g", ["turn", "role", "sha"], "turns")
    # the first of equal rows, by a minimum with map-side sums: a message that is repeated without end is no hot group
    firsts = placed.groupBy("g", "role", "sha").agg(F.min("pos").alias("pos")).select("g", "pos", F.lit(True).alias("first"))
    fault = F.when((F.col("own") != "blank") & F.col("first").isNull(), F.lit("duplicate")).otherwise(F.col("own"))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0) + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(F.col("fault") == "truncated", 8).otherwise(0)
    short = placed.select("g", "pos", "turn", "role", "own").join(firsts, ["g", "pos"], "left").withColumn("fault", fault)
    return placed.select("g", "pos", "role", "text"), materialize(short.select("g", "pos", "turn", code.cast("int").alias("code"), "fault"), "marks")


def chunked(marks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(g, chunk, before, codes): the codes of up to `size` rows in order, and that of the row before them (-1: none)."""
    own = marks.select("g", F.expr(f"pos div {size}").alias("chunk"), "pos", "code")
    border = marks.filter(f"pos % {size} = {size - 1}").select("g", F.expr(f"pos div {size} + 1").alias("chunk"), "pos", "code")
    rows = own.unionByName(border).groupBy("g", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    led = F.col("rows")[0]["pos"] < F.col("chunk") * size
    out = rows.select("g", "chunk", F.when(led, F.col("rows")[0]["code"]).otherwise(F.lit(-1)).alias("before"),
                      F.transform(F.when(led, F.slice("rows", 2, size)).otherwise(F.col("rows")), lambda r: r["code"]).alias("codes"))
    return out.filter("size(codes) > 0")  # a border row behind the end of a conversation leads nothing


def _grid(codes: list) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(c) for c in codes], np.int64)
    grid = np.full((len(codes), int(size.max())), -1, np.int64)
    for i, c in enumerate(codes):
        grid[i, : len(c)] = c
    return grid, size


def _step(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(arc costs, targets) of rows: arrays (row, state, letter); `after` has the costs behind the row, (row, state)."""
    m = len(code)
    initial, gone, open_ = code & 3, (code & 4) > 0, np.where(code & 8, UNFINISHED, 0)
    cost, to = np.full((m, 4, 4), FAR, np.int64), np.zeros((m, 4, 4), np.int64)
    row = np.arange(m)
    for q in range(4):
        to[:, q, D], cost[:, q, D] = q, COST[D] + after[:, q]
        k = KEEP[initial, q]
        to[:, q, K] = np.maximum(k, 0)
        cost[:, q, K] = np.where((k < 0) | gone, FAR, COST[K] + open_ + after[row, np.maximum(k, 0)])
        to[:, q, R] = NEXT[q]
        cost[:, q, R] = np.where(gone, FAR, COST[R] + open_ + after[:, NEXT[q]])
    # an inserted message stays at the row and moves on to another state
    best = cost.min(axis=2)
    user = np.minimum(best[:, USER], COST[I] + best[:, ASSISTANT])
    assistant = np.minimum(best[:, ASSISTANT], COST[I] + best[:, USER])
    for q, over in ((NONE, user), (SYSTEM, user), (USER, assistant), (ASSISTANT, user)):
        to[:, q, I], cost[:, q, I] = NEXT[q], COST[I] + over
    return np.minimum(cost, FAR), to


def costs(codes: list, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs from each node to the end of its chunk: (chunk, rows + 1, state), with the optimal arcs and their targets.

    ends (chunk, state): what is still to pay behind the chunk. Optimal arcs are (chunk, row, state, letter) flags.
    """
    grid, size = _grid(codes)
    n, width = grid.shape
    best = np.zeros((n, width + 1, 4), np.int64)
    best[np.arange(n), size] = ends
    arcs, target = np.zeros((n, width, 4, 4), bool), np.zeros((n, width, 4, 4), np.int64)
    for i in range(width - 1, -1, -1):
        on = np.flatnonzero(size > i)
        cost, to = _step(grid[on, i], best[on, i + 1])
        least = cost.min(axis=2)
        best[on, i] = least
        arcs[on, i] = (cost == least[:, :, None]) & (least[:, :, None] < FAR)
        target[on, i] = to
    return best, arcs, target


def matrices(codes: list) -> np.ndarray:
    """(chunk, state in front, state behind): the least cost of a chunk between two states."""
    out = np.zeros((len(codes), 4, 4), np.int64)
    for q in range(4):
        end = np.full((len(codes), 4), FAR, np.int64)
        end[:, q] = 0
        out[:, :, q] = costs(codes, end)[0][:, 0]
    return out


def ranks(arcs: np.ndarray, target: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(rank, pointers, letter) of the nodes by their least audit.

    Ranks of round r order nodes by the first 2^r edits of their least audit: in round 0 by the least letter of their
    optimal arcs, then by the pair (own rank, rank of the node 2^r edits on), with pointers doubled along. The arcs of
    a node bear different letters, so round 0 settles which arc goes on; nodes behind the last row end an audit.
    """
    n, width = arcs.shape[:2]
    stride = (width + 1) * 4
    node = lambda c, i, q: c * stride + i * 4 + q
    c, i, q = np.meshgrid(np.arange(n), np.arange(width), np.arange(4), indexing="ij")
    letter = np.where(arcs.any(axis=3), arcs.argmax(axis=3), -1)
    over = np.take_along_axis(target, np.maximum(letter, 0)[..., None], axis=3)[..., 0]
    pointer = np.arange(n * stride)
    ahead = np.where(letter == I, i, i + 1)
    inside = (letter >= 0) & (i < size[:, None, None])
    pointer[node(c, i, q)[inside]] = node(c, ahead, over)[inside]
    first = np.full(n * stride, -1, np.int64)
    first[node(c, i, q)[inside]] = letter[inside]
    rank, pointers = first + 1, [pointer]
    for _ in range(max(1, int(2 * width + 2).bit_length())):
        _, rank = np.unique(rank * (rank.max() + 2) + rank[pointers[-1]], return_inverse=True)
        pointers.append(pointers[-1][pointers[-1]])
    return rank, pointers, first


def least_paths(codes: list, ends: np.ndarray) -> list[list[tuple[int, int, str, str]]]:
    """For each chunk and each state in front of it: (cost to the end, state behind, audit, states after each edit).

    The way of a node is laid out by its doubled pointers: 1, 2, 4 ... edits known give the next as many.
    """
    best, arcs, target = costs(codes, ends)
    size = np.array([len(c) for c in codes], np.int64)
    _, pointers, letter = ranks(arcs, target, size)
    n, width = arcs.shape[:2]
    stride = (width + 1) * 4
    start = (np.arange(n)[:, None] * stride + np.arange(4)).ravel()
    way = start[:, None]
    for p in pointers:
        if (letter[way[:, -1]] < 0).all():
            break
        way = np.concatenate((way, p[way]), axis=1)
    text = letter[way]
    out = []
    for j in range(n):
        four = []
        for q in range(4):
            row, t = way[j * 4 + q], text[j * 4 + q]
            m = int((t >= 0).sum())
            states = (row[1: m + 1] % 4) if m < len(row) else row[1:] % 4
            exit_ = int(row[m] % 4) if m < len(row) else int(row[-1] % 4)
            four.append((int(best[j, 0, q]), exit_, "".join(LETTERS[x] for x in t[:m]), "".join("-" if x == D else STATES[s] for x, s in zip(t[:m], states))))
        out.append(four)
    return out


def illegal(codes: np.ndarray, before: int) -> int:
    """Neighbouring rows whose initials are not su, ua or au."""
    x = (codes if before < 0 else np.concatenate(([before], codes))) & 3
    a, b = x[:-1], x[1:]
    return int((~(((a == 1) & (b == 2)) | ((a == 2) & (b == 3)) | ((a == 3) & (b == 2)))).sum())


def _lists(batch, column):
    return [np.asarray(x, np.int64) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def _by_length(codes: list, step: int = 1 << 16):
    """Groups of chunk numbers of like length, of bounded size together."""
    order = np.argsort([len(c) for c in codes], kind="stable")
    group, longest = [], 0
    for i in order.tolist():
        longest = max(longest, len(codes[i]))
        if group and (len(group) + 1) * longest > step:
            yield group
            group, longest = [], len(codes[i])
        group.append(i)
    if group:
        yield group


def costs_behind(chunks: DataFrame, fan: int = FAN) -> DataFrame:
    """(g, chunk, ends): what each state has to pay behind a chunk, for all chunks of conversations of several."""

    def run(batches):
        for batch in batches:
            codes = _lists(batch, "codes")
            out = np.zeros((len(codes), 4, 4), np.int64)
            for group in _by_length(codes):
                out[group] = matrices([codes[i] for i in group])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.reshape(len(codes), 16).tolist(), pa.list_(pa.int64()))], names=["g", "chunk", "matrix"])

    return _behind(materialize(chunks.select("g", "chunk", "codes").mapInArrow(run, "g string, chunk bigint, matrix array<bigint>"), "matrices"), fan)


def _grouped(rows: DataFrame, fan: int, *cols: str) -> DataFrame:
    """Up to `fan` neighbouring rows of a conversation as one."""
    return rows.groupBy("g", F.expr(f"chunk div {fan}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("chunk", *cols))).alias("rows"))


def _behind(rows: DataFrame, fan: int) -> DataFrame:
    most = rows.agg(F.max("chunk")).first()[0]
    if not most:
        return rows.select("g", "chunk", F.array(*[F.lit(int(x)) for x in END]).cast("array<bigint>").alias("ends"))
    groups = materialize(_grouped(rows, fan, "matrix"), "matrix-groups")

    def join(batches):
        for batch in batches:
            out = []
            for members in batch.column(2).to_pylist():
                m = np.array(members[0]["matrix"]).reshape(4, 4)
                for x in members[1:]:
                    m = np.minimum((m[:, :, None] + np.array(x["matrix"]).reshape(1, 4, 4)).min(axis=1), FAR)
                out.append(m.ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["g", "chunk", "matrix"])

    upper = _behind(materialize(groups.select("g", "up", "rows").mapInArrow(join, "g string, chunk bigint, matrix array<bigint>"), "matrices"), fan)

    def spread(batches):
        for batch in batches:
            g, chunk, ends = [], [], []
            for key, members, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                end = np.array(end)
                for x in reversed(members):
                    g.append(key)
                    chunk.append(x["chunk"])
                    ends.append(end.tolist())
                    end = np.minimum((np.array(x["matrix"]).reshape(4, 4) + end).min(axis=1), FAR)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(chunk, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["g", "chunk", "ends"])

    pairs = groups.join(upper.withColumnRenamed("chunk", "up"), ["g", "up"]).select("g", "rows", "ends")
    return pairs.mapInArrow(spread, "g string, chunk bigint, ends array<bigint>")


def states_before(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """(g, chunk, state) from the maps (g, chunk, exits) of chunks: the state in front of each along the least path."""
    most = rows.agg(F.max("chunk")).first()[0]
    if not most:
        return rows.select("g", "chunk", F.lit(NONE).alias("state"))
    groups = materialize(_grouped(rows, fan, "exits"), "map-groups")
    over = F.aggregate("rows", F.array(*map(F.lit, range(4))), lambda m, r: F.transform(m, lambda q: F.get(r["exits"], q)))
    upper = states_before(materialize(groups.select("g", F.col("up").alias("chunk"), over.alias("exits")), "maps"), fan)
    way = F.aggregate(
        "rows", F.struct(F.col("state").alias("state"), F.array().cast("array<int>").alias("seen")),
        lambda acc, r: F.struct(F.get(r["exits"], acc["state"]).alias("state"), F.concat(acc["seen"], F.array(acc["state"])).alias("seen")))["seen"]
    each = groups.join(upper.withColumnRenamed("chunk", "up"), ["g", "up"]).select("g", F.explode(F.arrays_zip(F.col("rows.chunk").alias("chunk"), way.alias("state"))).alias("r"))
    return each.select("g", "r.chunk", "r.state")


def chosen_edits(chunks: DataFrame, fan: int = FAN) -> DataFrame:
    """(g, chunk, cost, illegal, audit, states): the edits of the least path in each chunk, and what it costs from there."""
    several = chunks.filter("chunk > 0").select("g").distinct()
    behind = costs_behind(chunks.join(several, "g", "left_semi"), fan)
    plain = F.array(*[F.lit(int(x)) for x in END]).cast("array<bigint>")
    rows = chunks.join(behind, ["g", "chunk"], "left").withColumn("ends", F.coalesce("ends", plain))

    def run(batches):
        for batch in batches:
            codes, ends = _lists(batch, "codes"), np.array(batch.column(4).to_pylist(), np.int64).reshape(-1, 4)
            before = numbers(batch, "before")
            out = [None] * len(codes)
            for group in _by_length(codes):
                for i, four in zip(group, least_paths([codes[i] for i in group], ends[group])):
                    out[i] = four
            field = lambda j, kind: pa.array([[x[j] for x in four] for four in out], pa.list_(kind))
            bad = pa.array([illegal(c, int(b)) for c, b in zip(codes, before)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bad, field(0, pa.int64()), field(1, pa.int32()), field(2, pa.string()), field(3, pa.string())],
                                             names=["g", "chunk", "illegal", "costs", "exits", "audits", "ways"])

    found = rows.select("g", "chunk", "before", "codes", "ends").mapInArrow(run, "g string, chunk bigint, illegal bigint, costs array<bigint>, exits array<int>, audits array<string>, ways array<string>")
    found = materialize(found, "edits")
    many = found.join(several, "g", "left_semi").select("g", "chunk", "exits")
    state = F.coalesce("state", F.lit(NONE))
    pick = found.join(states_before(many, fan), ["g", "chunk"], "left")
    at = lambda c: F.get(F.col(c), state)
    return pick.select("g", "chunk", "illegal", at("costs").alias("cost"), at("audits").alias("audit"), at("ways").alias("states"), at("exits").alias("exit"))


def repaired_digests(texts: DataFrame, edits: DataFrame, size: int = CHUNK) -> DataFrame:
    """(g, repaired_sha256): the SHA-256 over the repaired messages of a conversation in order.

    A digest over a sequence is one stream, so a conversation passes through one task, row by row: the task holds the
    state of the hash and the edits of a chunk, never the conversation.
    """
    text = texts.select("g", "pos", F.lit(1).alias("tag"), "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("states"))
    lead = edits.select("g", (F.col("chunk") * size).alias("pos"), F.lit(0).alias("tag"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit", "states")
    rows = text.unionByName(lead).repartition(partitions(texts.sparkSession), "g").sortWithinPartitions("g", "pos", "tag")
    name = {"s": b"system", "u": b"user", "a": b"assistant"}

    def run(batches):
        key, hash_, any_, audit, states, at = None, None, False, "", "", 0

        def say(role, text):
            nonlocal any_
            hash_.update((b"\n" if any_ else b"") + role + b":")
            hash_.update(text)
            any_ = True

        def inserts():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                say(name[states[at]], b"")
                at += 1

        for batch in batches:
            ends, shas = [], []
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("g", "role", "text", "audit", "states")]
            for g, role, text, edits_, ways in zip(*cols):
                if g != key:
                    if key is not None:
                        inserts()
                        ends.append(key)
                        shas.append(hash_.hexdigest())
                    key, hash_, any_, audit, states, at = g, hashlib.sha256(), False, "", "", 0
                if edits_ is not None:
                    inserts()
                    audit, states, at = edits_, ways, 0
                    continue
                inserts()
                if audit[at] != "D":
                    say(role.encode() if audit[at] == "K" else name[states[at]], text.encode())
                at += 1
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array(ends, pa.string()), pa.array(shas, pa.string())], names=["g", "repaired_sha256"])
        if key is not None:
            inserts()
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([hash_.hexdigest()], pa.string())], names=["g", "repaired_sha256"])

    return rows.select("g", "role", "text", "audit", "states").mapInArrow(run, "g string, repaired_sha256 string")


def with_ends(edits: DataFrame) -> DataFrame:
    """edits whose last chunk of a conversation also has the messages to insert behind its last row."""
    last = edits.groupBy("g").agg(F.max("chunk").alias("chunk")).withColumn("last", F.lit(True))
    tail = F.when(F.col("last") & (F.col("exit") == USER), F.array(F.lit(END_EDITS[USER]), F.lit("a"))).when(
        F.col("last") & (F.col("exit") == SYSTEM), F.array(F.lit(END_EDITS[SYSTEM]), F.lit("ua"))).otherwise(F.array(F.lit(""), F.lit("")))
    rows = edits.join(last, ["g", "chunk"], "left").withColumn("tail", tail)
    return rows.select("g", "chunk", "illegal", "cost", F.concat("audit", F.col("tail")[0]).alias("audit"), F.concat("states", F.col("tail")[1]).alias("states"))


def repair(rows: DataFrame, size: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(summary, edits) of conversations (conv_id, turn, role, text).

    summary: g, conv_id's key, and gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, a row for
    each conversation that has rows. edits: the chosen edits by chunk (g, chunk, audit, states), one letter an edit.
    The audit of a conversation is one string by contract, so it is as long as the conversation has edits.
    """
    texts, marks = placed_rows(rows)
    chunks = materialize(chunked(marks, size), "chunks")
    edits = materialize(with_ends(chosen_edits(chunks, fan)), "chosen")
    one = lambda f: F.sum((F.col("fault") == f).cast("bigint")).alias(f)
    faults = marks.groupBy("g").agg(*[one(f) for f in ("blank", "duplicate", "truncated")])
    turns = marks.filter("turn IS NOT NULL").groupBy("g", "turn").agg(F.lit(1)).groupBy("g").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    whole = edits.groupBy("g").agg(
        F.sum("illegal").alias("illegal"), F.min_by("cost", "chunk").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda r: r["audit"]), "").alias("audit"))
    out = faults.join(turns, "g", "left").join(whole, "g").join(repaired_digests(texts, edits, size), "g")
    return out.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("bigint"))), edits


def audits(original: DataFrame, rows: DataFrame, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """A row for each conv_id of `original` with the repair of its `rows`; without rows: zeros, no edits, an empty text.

    Null conv_ids are one conversation. Null roles and texts are one space, so such a text is blank and such a role has
    to be changed. Null turns come first and count neither for gaps nor for their ends. Rows of one turn go by role,
    then by the SHA-256 of their text; rows alike in all of it are the same to the result. Texts of any length pass
    whole. Other columns are ignored. A conversation of any length is cut into chunks of `size` rows.
    """
    found, _ = repair(rows, size, fan)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    kind = original.schema["conv_id"].dataType.simpleString()
    return original.select(group_key("conv_id").alias("g")).distinct().join(found, "g", "left").select(
        of_key("g", kind).alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
