"""Plain forms of the operators, for small inputs."""

import hashlib
from collections import defaultdict

import xxhash

BLANK = b" \t\n\x0b\f\r"


def passages(rows, window=20):
    """{doc_id: (n_words, n_removed, sha)} of (doc_id, text) rows with distinct ids."""
    first, words = {}, {}
    for d, t in sorted(rows):
        w = (t or "").encode().split()
        words[d] = w
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i: i + window]), (d, i))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i: i + window])] != (d, i):
                gone[i: i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def byte_runs(rows, width=400):
    count = defaultdict(int)
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            count[hash(b[i: i + width])] += 1
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        end = 0
        for i in range(len(b) - width + 1):
            if count[hash(b[i: i + width])] > 1:
                s = max(i, end)
                gone[s: i + width] = b"\1" * (i + width - s)
                end = i + width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def simhash(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not low:
        return 0
    sh = [b" ".join(low[i: i + width]) for i in range(max(1, len(low) - width + 1))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash_groups(rows, distance=4):
    fp = {d: simhash(t) for d, t in rows}
    ids = sorted(fp)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (fp[a] ^ fp[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (f"{fp[d]:016x}", find(d)) for d in ids}


def merkle(rows, fan=3):
    """{doc_id: (leaf, subroot, root, proof, folded, verified)} of (doc_id, source, lang, n_chars, text) with distinct ids."""
    import zlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(part, r)))

    def tree(nodes):
        """(root, siblings (left, right) of each node up to it)."""
        way, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, p in enumerate(at):
                run = level[p - p % fan: p - p % fan + fan]
                way[i].append(("".join(run[: p % fan]), "".join(run[p % fan + 1:])))
            at = [p // fan for p in at]
            level = [sha("".join(level[i: i + fan])) for i in range(0, len(level), fan)]
        return level[0], way

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    low = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0))
        low[s] = tree([leaf(r) for r in by[s]])
    root, high = tree([low[s][0] for s in names]) if names else (None, [])
    out = {}
    for s, up in zip(names, high):
        for r, way in zip(by[s], low[s][1]):
            found = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                found = (*r[:4], r[4].replace("\n", ""))
            d = leaf(found)
            for a, b in way + up:
                d = sha(a + d + b)
            out[r[0]] = (leaf(r), low[s][0], root, sha("".join(a + b for a, b in way + up)), d, d == root)
    return out


def damage(rows):
    """Rows (conv_id, turn, role, text) after the damage of operator 11."""
    import zlib

    word = lambda v: " " if v is None else str(v)
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        role, text = word(role), word(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(c, t, role, text)] * (2 if kind == 3 else 1)
    return out


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's rows (turn, role, text)."""
    blanks = " \t\n\x0b\f\r"
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(blanks)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    # prefixes do not decide ties (a longer prefix may win later), so states keep every audit of least cost
    def closed(sets):
        todo = list(sets.items())
        for _ in range(2):
            fresh = []
            for q, (c, found) in todo:
                role = "assistant" if q == "u" else "user"
                fresh.append((role[0], (c + 5, {(a + "I", m + (f"{role}:",)) for a, m in found})))
            for q, v in fresh:
                merge(sets, q, v)
            todo = fresh
        return sets

    def merge(sets, q, v):
        old = sets.get(q)
        if old is None or v[0] < old[0]:
            sets[q] = (v[0], set(v[1]))
        elif v[0] == old[0]:
            old[1].update(v[1])

    sets = closed({"": (0, {("", ())})})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for q, (c, found) in sets.items():
            merge(after, q, (c + 2, {(a + "D", m) for a, m in found}))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            k = role[:1]
            if (k == "s" and q == "") or (k == "u" and q in ("", "s", "a")) or (k == "a" and q == "u"):
                merge(after, k, (c + more, {(a + "K", m + (f"{role}:{text}",)) for a, m in found}))
            new = "assistant" if q == "u" else "user"
            merge(after, new[0], (c + more + 1, {(a + "R", m + (f"{new}:{text}",)) for a, m in found}))
        sets = closed(after)
    cost = min(sets[q][0] for q in ("", "a") if q in sets)
    audit, messages = min(x for q in ("", "a") if q in sets and sets[q][0] == cost for x in sets[q][1])
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[1][:1] for r in rows]
    bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            bad, cost, audit, hashlib.sha256("\n".join(messages).encode()).hexdigest())


def repairs(rows):
    by = {c: [] for c, *_ in rows}
    for c, *r in damage(rows):
        by[c].append(tuple(r))
    return {c: repair(r) for c, r in by.items()}
