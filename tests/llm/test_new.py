"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lanternflow.llm import embedding_dedup, prefix_trie, structure_repair

VECTORS = "vec_id long, embedding array<float>, label int, node long, rank long, digest string"
TURNS = "conv_id long, turn long, role string, text string, i long, key string, place int, conv string"


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def links_of(rows):
    """n_links, component_id and kept of rows of vec_id and embedding."""
    good = [(k, np.array(v, dtype=float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(good, 2):
        if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
            degree[a] += 1
            degree[b] += 1
            parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        own = min((x for x in least[find(k)] if x is not None), default=None)
        out.append((i, degree[k], own, i == own))
    return sorted(out, key=repr)


def vectors(seed, n=400, dim=24):
    """Spread vectors, pairs near the threshold, a large tight group, copies and what links with nothing."""
    rng = np.random.default_rng(seed)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.standard_normal(dim))
    rows = [(k, unit()) for k in range(n)]
    for k in range(120):
        a, b = rows[k][1], unit()
        b -= (a @ b) * a
        c = rng.choice([0.94, 0.955, 0.97, 0.999])
        rows.append((1000 + k, c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)))
    centre = unit()
    rows += [(2000 + k, centre + 0.028 * rng.standard_normal(dim)) for k in range(300)]
    rows += [(3000 + k, 3.0 * rows[7][1]) for k in range(90)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in rows]
    rows += [(5000, None), (5001, []), (5002, [0.0] * dim), (5003, [None] + [1.0] * (dim - 1)), (5004, [float("nan")] * dim), (5005, [float("inf")] + [1.0] * (dim - 1))]
    rows += [(5006, rows[3][1][:5]), (5007, rows[3][1][:5]), (None, rows[9][1]), (None, [0.0] * dim), (None, [5.0] + [0.0] * (dim - 1)), rows[11], rows[12], (12, rows[20][1])]
    return rows


def test_embedding_classes(spark):
    rows = vectors(1)
    table = spark.createDataFrame([(i, v, 0, 1, 2, "x") for i, v in rows], VECTORS)
    want = links_of(rows)
    got = by_row(embedding_dedup.near_duplicates(table), "vec_id", "n_links", "component_id", "kept")
    assert got == want
    # Small windows, blocks and tiles give the same classes: what is beyond a window is compared in tiles.
    small = embedding_dedup.near_duplicates(table, window=4, block_rows=32, tile_rows=16)
    got = by_row(small, "vec_id", "n_links", "component_id", "kept")
    links = sum(n for _, n, _, _ in want)
    assert links >= sum(n for _, n, _, _ in got) >= 0.99 * links


def test_embedding_doubles_and_empty(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1.1e-300]), (3, [1.0, -1.0]), (4, [float("nan"), 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert by_row(embedding_dedup.near_duplicates(table), "vec_id", "n_links", "component_id", "kept") == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_long_vectors_are_compared_whole(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal(3000)
    b = a.copy()
    b[2000:] = rng.standard_normal(1000)
    rows = [(1, a.tolist()), (2, (a + 0.1 * rng.standard_normal(3000)).tolist()), (3, b.tolist())]
    got = by_row(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id", "n_links", "component_id")
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def conversations(seed, n=260):
    rng = random.Random(seed)
    said = ["a.", "b", "", None, "Hello there!", "x\ny"]
    rows = []
    for c in [*range(n), 1000, 1050, 70_001]:
        for t in range(rng.choice([1, 2, 3, 3, 4, 5, 6, 9, 14])):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", "tool", None, ""]) if rng.random() < 0.3 else ["user", "assistant"][t % 2], rng.choice(said)))
    rows += [(5, 0, "user", "again."), (5, 0, "user", "again."), (9, 10**12, "user", "far"), (None, 1, "user", "nobody's"), (2**62, 0, "user", "x" * 3_000_000), (-3, 0, "user", "minus.")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], TURNS)


def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = int(c / 100) * 100 if abs(c) < 10**15 else c // 100 * 100
        full[c] = own.get(family, [])[:h] + said[h:]
    members = defaultdict(list)
    for c, said in full.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    below = defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)

    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in below[p]) or 1
        saved[p] = sum(saved[q] for q in below[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, inside in members.items():
        ends = ",".join(map(str, sorted(c for c in inside if len(full[c]) == len(p))))
        out.append((min(inside), len(p), min(members[p[:-1]]) if p else None, len(inside), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_prefix_trie(spark):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = conversations(3)
    assert by_row(prefix_trie.prefix_trie(frame(spark, rows)), *columns) == trie(rows)
    # Conversations of one content.
    alike = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)] + conversations(4, 40)[:80]
    assert by_row(prefix_trie.prefix_trie(frame(spark, alike)), *columns) == trie(alike)
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0


def damaged(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        out[c]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            new = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            for again in range(2 if kind == 3 else 1):
                out[c].append(((turn is not None, turn or 0, role, text, again), turn, "user" if kind == 4 else role, new))
    return {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in out.items()}


def cheapest(initials, faults):
    """(cost, audit) by trying all edits with up to two inserts between rows."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    state = {"": [(0, "")]}

    def inserted(state):
        for _ in range(2):
            new = {q: list(v) for q, v in state.items()}
            for q, v in state.items():
                for r in "ua":
                    if (q, r) in step:
                        new.setdefault(step[q, r], []).extend((c + 3, a + "I") for c, a in v)
            state = {q: [min(v)] for q, v in new.items()}
        return state

    for initial, fault in zip(initials, faults):
        new = defaultdict(list)
        for q, v in inserted(state).items():
            for c, a in v:
                new[q].append((c + 4, a + "D"))
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    if (q, initial) in step:
                        new[step[q, initial]].append((c + more, a + "K"))
                    for r in "ua":
                        if (q, r) in step:
                            new[step[q, r]].append((c + 3 + more, a + "R"))
        state = {q: [min(v)] for q, v in new.items()}
    return min(x for q, v in inserted(state).items() if q in ("", "a") for x in v)


def repaired(rows):
    out = []
    for c, own in damaged(rows).items():
        seen, faults = set(), []
        for _, role, text in own:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        initials = [role[:1] for _, role, _ in own]
        cost, audit = cheapest(initials, faults)
        said, state, at = [], "", 0
        for edit in audit:
            due = "assistant" if state == "u" else "user"
            if edit == "I":
                said.append(f"{due}:")
                state = due[0]
                continue
            _, role, text = own[at]
            at += 1
            if edit != "D":
                said.append(f"{role if edit == 'K' else due}:{text}")
                state = role[0] if edit == "K" else due[0]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((c, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_structure_repair(spark):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = conversations(8) + [(80_000, t, "user", f"{t}.") for t in range(400)]
    assert by_row(structure_repair.repair_conversations(frame(spark, rows)), *columns) == repaired(rows)
    assert structure_repair.repair_conversations(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_lightest_derivation_is_the_cheapest(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suaax"), rng.choice([None, None, "truncated", "blank"])) for _ in range(rng.randrange(0, 60))]
    codes = "".join("-" if f == "blank" else r.upper() if f else r for r, f in rows)
    assert structure_repair.repair(codes) == cheapest([r for r, _ in rows], [f for _, f in rows])


def test_long_conversations_take_memory_by_their_rows():
    cost, audit = structure_repair.repair("ua" * 20_000 + "u")
    assert (cost, audit) == (3, "K" * 40_001 + "I")
