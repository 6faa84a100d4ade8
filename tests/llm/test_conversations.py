import random

import brute
import numpy as np
import pytest

from claimlens.llm import conversations as C

NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos int, g string, code int"


def made(seed, conversations, most):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "upper", "Bot", "", None])
            text = rng.choice([f"Say {rng.randrange(9)}.", "no end", " \n", "", None, "Ja! ", "é?\t", "..", "long " * 200 + "."])
            rows.append((c if c else None, None if rng.random() < 0.1 else t + rng.randrange(2), role, text, 1, "x", 2))
    return rows


@pytest.mark.parametrize("size,fan", [(256, 64), (3, 2)])
def test_repairs_match_brute_force(spark, size, fan):
    rows = made(5, 40, 11)
    frame = spark.createDataFrame(rows, SCHEMA)  # nulls everywhere, ties of turns, repeated rows, clashing columns
    got = {r.conv_id: tuple(r[c] for c in NAMES) for r in C.audits(frame, C.damaged(frame), size, fan).collect()}
    assert got == brute.repairs([r[:4] for r in rows])


def test_a_long_conversation_is_cut_without_a_trace(spark):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Well.", "open", f"{t}!", ""]), 1, "x", 2) for t in range(700)] + made(8, 5, 6)
    frame = spark.createDataFrame(rows, SCHEMA)
    one, cut = ({r.conv_id: tuple(r[c] for c in NAMES) for r in C.audits(frame, frame.select("conv_id", "turn", "role", "text"), *k).collect()} for k in ((4096, 64), (8, 3)))
    assert one == cut and len(one[1][6]) > 600


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.audits(empty, C.damaged(empty)).count() == 0
    frame = spark.createDataFrame(made(9, 3, 4), SCHEMA)
    for r in C.audits(frame, C.damaged(empty)).collect():
        assert tuple(r[c] for c in NAMES[:7]) == (0, 0, 0, 0, 0, 0, "") and r.repaired_sha256 == C.hashlib.sha256().hexdigest()


def test_ranks_order_nodes_by_their_least_audits():
    rng = np.random.default_rng(1)
    codes = [np.array([rng.integers(0, 16) for _ in range(m)]) for m in (1, 5, 9)]
    _, arcs, target = C.costs(codes, np.tile(C.END, (3, 1)))
    size = np.array([1, 5, 9])
    rank, pointers, letter = C.ranks(arcs, target, size)

    def audit(v):
        out = ""
        while letter[v] >= 0:
            out, v = out + C.LETTERS[letter[v]], pointers[0][v]
        return out

    nodes = [j * 40 + i * 4 + q for j in range(3) for i in range(size[j]) for q in range(4)]
    assert sorted(nodes, key=lambda v: rank[v]) == sorted(nodes, key=lambda v: (audit(v), rank[v]))
    assert all((rank[v] == rank[w]) == (audit(v) == audit(w)) for v in nodes for w in nodes)
