import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternflow.llm import chat_format, decontamination, exact_dedup, html_extract, ngram_join, packing, suffix_dedup, toxicity, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, key long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], DOCS)


def sample(seed=0, n=60):
    """Texts with copies, near copies, shared passages, nulls, empty, short and very long ones, and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(40)
    rows = [(k, text(rng.randrange(1, 120))) for k in range(n)]
    for k in range(n, n + 40):
        base = rng.choice(rows)[1].split()
        for _ in range(rng.randrange(0, 3)):
            base[rng.randrange(len(base))] = "edited"
        rows.append((k, " ".join(base)))
    rows += [(n + 40 + k, text(30) + " " + passage + "\n" + text(k)) for k in range(6)]
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "one"), (1004, "One"), (1005, text(9000)), (None, rows[0][1])]
    return [*rows, rows[3], rows[5]]


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_exact_dedup(spark):
    rows = sample()
    rows += [(2000 + k, "a b" if k % 2 else "ab") for k in range(50)]
    got = by_row(exact_dedup.exact_dedup(frame(spark, rows), runs=4), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    want = []
    for norm, own in groups.items():
        best = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        want += [(i, best[0], len(own), i == best[0] and len(t) == len(best[1]), hashlib.sha256(norm.encode()).hexdigest()) for i, t in own]
    assert got == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(frame(spark, rows[:0])).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def classes(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_jaccard_classes(spark):
    rows = sample(1)
    base = rows[10][1].split() * 3
    rows += [(3000 + k, " ".join([*base[: len(base) - k], *(f"w{j}" for j in range(k))])) for k in range(0, 30)]
    got = ngram_join.jaccard_classes(frame(spark, rows)).collect()
    comp, size = classes(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"]) == (comp[r["doc_id"]], size[r["doc_id"]]), r
        else:
            assert r["component_id"] == comp[0]
    jaccard = ngram_join.jaccard_classes(frame(spark, [(7, "a b c d e f"), (7, "g h i j k"), (None, "x y"), (None, "X  y"), (9, "A b c d e f")]), carry={"own": F.col("key")})
    assert by_row(jaccard, "doc_id", "component_id", "own") == sorted([(7, 7, 1), (7, 7, 1), (None, None, 1), (None, None, 1), (9, 7, 1)], key=repr)
    assert jaccard.select("class").distinct().count() == 3
    assert ngram_join.jaccard_classes(frame(spark, rows[:0])).count() == 0


def test_recall_near_the_threshold(spark):
    """Pairs of a similarity of 0.80 to 0.85, the hardest ones, against brute force."""
    rng = random.Random(13)
    rows = []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 400))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.018, 0.024)))):
            other[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    sets = {i: shingles(t) for i, t in rows}
    hard = [k for k in range(150) if 0.8 <= len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) <= 0.85]
    assert len(hard) >= 40
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_classes(frame(spark, rows)).collect()}
    comp, _ = classes(rows)
    assert got == comp and all(got[2 * k + 1] == 2 * k for k in hard)


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, rng.integers(0, 300), dtype=np.uint64)]))
        if len(b):
            bound = (len(a) + len(b) - ngram_join._differing(ngram_join.bitmap(a), ngram_join.bitmap(b))) // 2
            assert bound >= len(np.intersect1d(a, b))


def test_cut_tiles_find_what_whole_tiles_find(spark, monkeypatch):
    rows = sample(2, 30)
    base = [f"v{k}" for k in range(60)]
    rows += [(4000 + k, " ".join([*base[:-12], *(f"u{k}_{j}" for j in range(k % 13))])) for k in range(60)]
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_classes(frame(spark, rows)).collect()}
    comp, _ = classes(rows)
    assert {i: got[i] for i in comp} == comp


def test_sets_of_a_small_key_travel_once(spark, monkeypatch):
    import pandas as pd

    members = spark.createDataFrame([(1, k, 20) for k in range(10)], "key long, node long, band int")
    sets = spark.createDataFrame([(k, 100, bytes(64)) for k in range(10)], "node long, n long, sig binary")
    classes = spark.createDataFrame([], "id long, comp long")
    monkeypatch.setattr(ngram_join, "_full_tiles", lambda frames, spanning: (pd.DataFrame({"a": f["node"], "b": range(len(f))}) for f in frames))
    assert ngram_join._stray_pairs(members, classes, sets, False).count() == 10


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (3, 9), (30, 20), (20, 25)] + [(100 + k, 101 + k) for k in range(20)]
    got = dict(by_row(ngram_join.components(spark.createDataFrame(links, "a long, b long")), "id", "comp"))
    assert {i: c for i, c in got.items() if i != c} == {2: 1, 3: 1, 9: 1, 11: 10, 30: 20, 25: 20, **{101 + k: 100 for k in range(20)}}


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 6, 12, 30, 60])))) for k in range(30)] + [(90, None), (91, "")]
    rows = [(k, " ".join(word() for _ in range(rng.randrange(1, 300)))) for k in range(40)]
    for k in range(40, 70):
        inside = items[k - 40][1].split()
        if k % 3 == 0 and len(inside) > 25:
            inside[len(inside) // 2] = "changed"
        rows.append((k, " ".join([*(word() for _ in range(rng.choice([0, 50, 4000]))), *inside, word()]).upper() + "!"))
    rows += [(500, None), (501, ""), rows[41]]

    def words(t):
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())

    want = set()
    for i, t in rows:
        own = words(t)
        for j, q in items:
            q = words(q)
            n = min(5, len(q))
            if n:
                wanted = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)}
                has = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
                if len(wanted & has) >= 0.8 * len(wanted):
                    want.add((i, j))
    assert len(want) >= 25
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 7):
        got = decontamination.contaminated_pairs(frame(spark, rows), table, items_per_block=block)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
        left = decontamination.decontaminate(frame(spark, rows), table, items_per_block=block)
        assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _ in rows if i not in {d for d, _ in want})
    assert decontamination.contaminated_pairs(frame(spark, rows), table.limit(0)).count() == 0
    assert decontamination.contaminated_pairs(frame(spark, rows[:0]), table).count() == 0


def test_scattered_and_repetitive_items_are_found():
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for pieces in (1, 3, 8, 0):
        found = 0
        for _ in range(40):
            item = words(60) if pieces else (words(1) + words(5)) * 10
            step = 60 // max(1, pieces)
            doc = [w for p in range(max(1, pieces)) for w in [*words(5000 // max(1, pieces)), *item[max(0, p * step - 4) : (p + 1) * step]]]
            found += bool(list(decontamination._Finder([(1, " ".join(item))], 0.8)([" ".join(doc)])))
        assert found >= 39, pieces


def test_toxicity(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "the", "er", "on", "ti", "st", "re"]) for _ in range(rng.randrange(1, 4)))
    bad = ["idiot", "moron", "scumbag"]
    rows, labels = [], []
    for k in range(400):
        text = [word() for _ in range(30)]
        if k % 4 == 0:
            text[5], text[20] = rng.choice(bad), rng.choice(bad).capitalize() + "!"
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(k % 4 == 0)))
    rows += [(900, None), (901, ""), (902, "on i d i o t er"), (903, "the w.o.r.d m.o.r.o.n"), (904, "x" * 100_000), (None, rows[0][1])]
    docs = frame(spark, rows)
    truth = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, truth)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    held = [got[i] for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r["held_out"] for r in held) and len(held) > 80
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.98 * len(held)
    assert got[902]["predicted"] == 1 and got[903]["predicted"] == 1
    assert got[900]["score"] == got[901]["score"] < 0.7 and not got[None]["held_out"]
    left = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    assert left == {i for i, r in got.items() if r["predicted"] == 0}
    none = toxicity.train(docs, truth.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_trains_on_what_scoring_reads(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.update(zip(map(frozenset, texts), toxic)))
    texts = ["er a on i d i o t the", "the m o r o n, er\x0bti", None, "a  an\u2003a"]
    rows = [(k, texts[k % 4]) for k in range(40)]
    toxicity.train(frame(spark, rows), spark.createDataFrame([(k, 1, int(k % 4 < 2)) for k in range(40)], "doc_id long, quality int, toxic int"))
    assert seen == {frozenset(toxicity.tokens(t or "")): k < 2 for k, t in enumerate(texts)}
    assert any("idiot" in words for words in seen)


def naive_features(word):
    """All subsequences of two to four letters of ^word$ within eight characters, by listing every choice of places."""
    from itertools import combinations

    text, out = f"^{word}$", {}
    for n, weight in ((2, 0.1), (3, 0.5), (4, 1.0)):
        for places in combinations(range(len(text)), n):
            if places[-1] - places[0] < 8:
                u = tuple(text[p] for p in places)
                out[u] = out.get(u, 0.0) + weight * 0.7 ** (places[-1] - places[0] + 1 - n)
    return out


def naive_kernel(a, b):
    x, y = naive_features(a), naive_features(b)
    dot = lambda p, q: sum(v * q.get(u, 0.0) for u, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_against_listing():
    words = ["banana", "aaaaaaa", "idiot", "idxiot", "on", "a", "worthless", "wourthless", "mississippi" * 2]
    got = toxicity.landmark_kernel(words, words)
    want = np.array([[naive_kernel(a, b) for b in words] for a in words])
    assert np.abs(got - want).max() < 1e-5 and np.abs(np.diag(got) - 1).max() < 1e-5
    model = toxicity.Model(np.zeros(toxicity._TABLE, np.float32), -0.3, 1.0, 0.0, [])
    for w, alpha in (("idiot", 1.5), ("banana", -0.7)):
        for codes, weights in toxicity.features([w]):
            model.table[codes] += alpha * weights
    value = [max(toxicity.FLOOR, 1.5 * naive_kernel(w, "idiot") - 0.7 * naive_kernel(w, "banana") - 0.3) for w in words]
    assert np.abs(model.values(words) - value).max() < 1e-4


def test_toxicity_tolerates_inserted_letters():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "the", "er", "on", "ti", "st", "re", "or"]) for _ in range(rng.randrange(1, 4)))
    bad = ["idiot", "worthless", "pathetic", "moron"]
    texts, labels = [], []
    for k in range(600):
        text = [word() for _ in range(30)]
        if k % 3 == 0:
            text[rng.randrange(30)] = rng.choice(bad)
        texts.append(toxicity.tokens(" ".join(text)))
        labels.append(k % 3 == 0)
    scorer = toxicity.Scorer(toxicity.fit(texts, labels))
    plain = scorer([f"you are a {w} man" for w in bad])
    inserted = scorer([f"you are a {w[:k]}{c}{w[k:]} man" for w in bad for k in range(1, len(w)) for c in "xqkzaeu"])
    spelled = scorer([f"you are {sep.join(w)} now" for w in bad for sep in (" ", ".", "-")])
    clean = scorer([" ".join(word() for _ in range(50)) for _ in range(300)])
    assert (plain >= 0.7).all() and (spelled >= 0.7).all() and (inserted >= 0.7).mean() >= 0.9 and (clean >= 0.7).mean() <= 0.01


def test_suffix_dedup(spark):
    rows = [r for r in sample(5) if r[0] is not None][:-2]
    rows += [(2000, "ab" * 300), (2001, "x" * 99), (2002, "x" * 100), (2003, "x" * 101), (2004, "é" * 120)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    seen: set[bytes] = set()
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(data[k : k + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        assert got[i] == (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.suffix_dedup(frame(spark, rows[:0])).count() == 0
    again = suffix_dedup.suffix_dedup(frame(spark, [(None, "q" * 150), (1, "q" * 50 + "z" * 120), (1, "q" * 50 + "z" * 120)])).collect()
    assert sorted(r["n_removed"] for r in again) == [119, 119, 149]


def test_suffix_dedup_of_frequent_anchors(spark):
    rng = random.Random(11)
    line, passage = "".join(rng.choice("abcdefgh ") for _ in range(75)), "".join(rng.choice("stuvwxyz ") for _ in range(400))
    noise = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    rows = [(k, noise(70) + line + noise(70)) for k in range(60)]  # distinct segments with one anchor
    rows += [(100 + k, noise(70) + line + "=" * (k % 2 * 40) + noise(70)) for k in range(60)]
    rows += [(200 + k, (passage if k % 3 else noise(90) + passage + noise(50))) for k in range(60)] + [(400, passage * 2), (100, rows[60][1])]
    want = {}
    seen: dict[bytes, tuple] = {}
    places = sorted((i, k, t.encode()[k : k + 100]) for i, t in set(rows) for k in range(len(t) - 99))
    for i, k, x in places:
        if seen.setdefault(x, (i, k)) != (i, k):
            want.setdefault(i, set()).update(range(k, k + 100))
    docs = spark.createDataFrame(rows, "doc long, text string").select("doc", F.xxhash64("text").alias("row"), "text")
    for frequent, split in ((2, 3), (2, 1000), (10**6, 10**6)):
        got: dict[int, set] = {}
        for r in suffix_dedup.repeated_ranges(docs, frequent, split).collect():
            got.setdefault(r["doc"], set()).update(range(r["lo"], r["hi"]))
        assert got == want, (frequent, split)


def test_segments_of_a_frequent_anchor_are_not_cut_into_strings(spark, monkeypatch):
    rng = random.Random(12)
    line = "".join(rng.choice("abcdefgh ") for _ in range(60))
    noise = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    shared = noise(40)
    rows = [(k, noise(70) + line + (shared + noise(20) if k % 10 == 0 else noise(60))) for k in range(200)]
    dealt, real = [], suffix_dedup._dealt
    monkeypatch.setattr(suffix_dedup, "_dealt", lambda df: dealt.append(df.count()) or real(df))
    docs = spark.createDataFrame(rows, "doc long, text string").select("doc", F.xxhash64("text").alias("row"), "text")
    got: dict[int, set] = {}
    for r in suffix_dedup.repeated_ranges(docs, 20, 30).collect():
        got.setdefault(r["doc"], set()).update(range(r["lo"], r["hi"]))
    seen: set[str] = set()
    want: dict[int, set] = {}
    for doc, text in rows:
        for k in range(len(text) - 99):
            if text[k : k + 100] in seen:
                want.setdefault(doc, set()).update(range(k, k + 100))
            seen.add(text[k : k + 100])
    assert got == want and len(want) == 19
    assert max(dealt) <= 6 * dealt[0], dealt


def test_copies_of_a_frequent_segment_are_not_held(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "_marked", lambda t: pytest.fail("segments of a frequent anchor were sorted in one batch"))
    names = ["key", "h", "salt", "doc", "row", "start", "segment"]
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, ([5] * 1000, [9] * 1000, [0] * 1000, range(k, k + 1000), [1] * 1000, [7] * 1000, [b"x" * 120] * 1000)))) for k in range(0, 50_000, 1000)]
    read = 0

    def source():
        nonlocal read
        for b in batches:
            read += 1
            yield b

    found = suffix_dedup._sorted_groups(source())
    head = next(found)
    assert read == 1 and head.num_rows == 1000  # each batch is answered before the next is read
    rows = [r for b in [head, *found] for r in b.to_pylist()]
    assert [r["doc"] for r in rows if r["segment"]] == [0]
    assert [(r["doc"], r["lo"], r["hi"]) for r in rows[1:]] == [(k, 7, 127) for k in range(1, 50_000)]


def test_suffix_order():
    rng = random.Random(6)
    for letters, n in (("ab", 400), ("abcdefgh", 300), ("a", 250)):
        base = bytes(map(ord, (rng.choice(letters) for _ in range(n))))
        data = base + base[50:200] + base[:180]
        places = np.array([rng.randrange(len(data) - 99) for _ in range(700)])
        group = np.array([rng.randrange(3) for _ in places])
        order, new = suffix_dedup.suffix_order(group, places, data)
        strings = [(int(g), data[p : p + 100]) for g, p in zip(group, places)]
        assert order.tolist() == sorted(range(len(places)), key=lambda k: (strings[k], k))
        assert new.tolist() == [k == 0 or strings[order[k]] != strings[order[k - 1]] for k in range(len(order))]
    assert suffix_dedup.suffix_order(np.zeros(0, int), np.zeros(0, int), b"")[0].tolist() == []


def test_anchors_of_a_long_text_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 8_000_000, dtype=np.uint8)
    tracemalloc.start()
    covered = 0
    for _, first, last, _ in suffix_dedup._anchors(data, np.array([0, len(data)])):
        covered += int((last - first + 1).sum())
    assert covered == len(data) - 99 and tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_packing(spark):
    rows = [(i, t) for i, t in sample(7)] + [(5000 + k, "word " * (k * 37 % 900)) for k in range(120)]
    got = packing.pack(frame(spark, rows), capacity=256, bucket_rows=5).toPandas()
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        start, size = 0, (len(ids) - 1) % 256 + 1
        for piece in range(-(-len(ids) // 256)):
            want.append((-1 if i is None else i, piece, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())))
            start, size = start + size, 256
    own = got.assign(doc_id=got["doc_id"].fillna(-1).astype(int))
    assert sorted(map(tuple, own[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 256
    assert got["sequence_id"].nunique() <= 1.03 * -(-got["length"].sum() // 256) + 1
    assert packing.pack(frame(spark, rows[:0])).count() == 0


def test_packing_configurations(monkeypatch):
    rng = random.Random(9)
    histogram = {n: rng.randrange(1, 40) for n in rng.sample(range(1, 2048), 900)} | {2048: 500}
    intervals, sequences = packing.plan(histogram)
    large = 2048 // packing.SMALL_SHARE
    held, ranks = {}, {}
    for length, lo, hi, base, each, offset in intervals:
        for rank in range(lo, hi):
            ranks.setdefault(length, []).append(rank)
            held.setdefault(base + (rank - lo) // each, []).append((offset + (rank - lo) % each * length, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    assert sorted(held) == list(range(sequences))
    for own in held.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    many = [own for own in held.values() if sum(length > large for _, length in own) >= 2]
    assert len(many) > sequences // 4 and any(len({length for _, length in own if length > large}) >= 2 for own in many)
    monkeypatch.setattr(packing, "SMALL_SHARE", 1)  # nothing is large: best-fit decreasing
    assert sequences <= 1.002 * packing.plan(histogram)[1]


def test_packing_column_generation():
    # 60 + 40 and 50 + 30 + 20 fill a sequence; first fit downwards would do no worse, but 60 + 30 would.
    sizes, demand = np.array([60, 50, 40, 30, 20]), np.array([10, 10, 10, 10, 10])
    found = packing._configurations(sizes, demand, 100)
    assert sum(times for _, times in found) <= 20 and all(sum(config) <= 100 for config, _ in found)
    used = sum(np.array([config.count(n) for n in sizes]) * times for config, times in found)
    assert (used <= demand).all() and demand.sum() - used.sum() <= 5  # less than a sequence a size is left by rounding down
    worth, counts = packing._dearest(sizes, np.array([0.6, 0.1, 0.5, 0.1, 0.1]), 100)
    assert abs(worth - 1.1) < 1e-9 and counts.tolist() == [1, 0, 1, 0, 0]
    # A large random histogram against the bound of linear programming's dual: prices of at most one a sequence.
    rng = random.Random(3)
    histogram = {n: rng.randrange(50, 90) for n in range(1, 2049)}
    intervals, sequences = packing.plan(histogram)
    most = max(-(-sum(n * c for n, c in histogram.items()) // 2048), sum(c for n, c in histogram.items() if n > 1024))
    assert most <= sequences <= 1.005 * most


def test_packing_places():
    left = {900: 1, 800: 2, 300: 1, 200: 5}
    assert packing._documents([1000, 250], [200, 300, 800, 900], left, 1100) == [900, 200]
    assert packing._documents([1000, 250], [200, 300, 800, 900], left, 1600) == [800, 800]
    assert packing._documents([800], [200, 300], {200: 1, 300: 1}, 1000) == [300]
    assert packing._documents([800, 150], [900], {900: 1}, 1000) in ([900], [])  # a place that nothing fits stays free


def test_token_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    tokenizer, ids = Tokenizer.from_file(public.path("byte_bpe_50k.json")), packing.TokenIds(None)
    rng = random.Random(8)
    texts = ["", "  ", "a  b\n\n c", " <|endoftext|> x<|endoftext|>y", "don't I'LL we've", "日本 テスト 12.5", "\x1c\x85\u2028 z\r\n", "é" * 300]
    texts += ["".join(rng.choice([" ", "\n", "\t", "a", "Z", "9", "é", "'s", "…", "<|"]) for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert ids.encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def test_warc(spark):
    same, odd = "x" * 150, "WARC/1.1\r\n\r\n\r\n" + "é" * 80
    rows = [(1, "http://a/ b", same), (2, "http://a", same), (3, None, odd), (4, "u", odd), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (2, "http://a", same), (None, "n", same)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, head string")
    got = by_row(warc.round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "has_request", "has_metadata")
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        own = [j for j, _, x in rows if j is not None and (x or "").encode() == data]
        again = len(data) >= 100 and i != min(own)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(own) if again else None, True, True))
    assert got == sorted(want, key=repr)
    path = warc.scratch_path(spark, "full")
    warc.write_warc(pages, path)
    kept = {bytes(r["payload"]) for r in warc.read_warc(spark, path).filter("payload is not null and warc_type = 'response'").collect()}
    assert kept == {(h or "").encode() for _, _, h in rows}
    assert warc.round_trip(pages.limit(0)).count() == 0
    import gzip
    import pathlib

    for file in pathlib.Path(path.removeprefix("file://")).glob("part-*"):  # any reader of gzip can read the files
        assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1\r\n")
    ids = {r["record_id"]: r["page_id"] for r in warc.read_warc(spark, path, False).collect()}
    again = warc.read_warc(spark, path, False).filter("warc_type = 'revisit'").collect()
    assert again and all(ids[r["refers_to"]] == r["refers_to_page"] for r in again)


def test_warc_of_any_length(spark):
    rows = [(1, "u", "é" * 9_000_000), (2, "u", "é" * 9_000_000), (3, "v", "x" * 3_000_000), (4, None, "a b\n" * 50)]
    got = by_row(warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "payload_bytes", "record_type", "refers_to")
    assert got == [(1, 18_000_000, "response", None), (2, 18_000_000, "revisit", 1), (3, 3_000_000, "response", None), (4, 200, "response", None)]


def test_archives_of_others(spark, tmp_path):
    import gzip

    def record(kind, name, block, *headers, length=None):
        lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + name, *headers, b"Content-Length: %d" % (len(block) if length is None else length)]
        return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n"
    a, b, c = (b"<urn:uuid:%d>" % k for k in (1, 2, 3))
    records = [
        record(b"warcinfo", b"<urn:uuid:0>", b"software: x\r\n"),
        record(b"request", b"<urn:uuid:9>", b"GET / HTTP/1.1\r\n\r\n", b"WARC-Concurrent-To: <urn:uuid:77>", b"WARC-Concurrent-To: " + a),
        record(b"response", a, http + b"hello", b"WARC-Target-URI: http://a/"),
        record(b"revisit", b, http, b"WARC-Refers-To: " + a, b"WARC-Concurrent-To: <urn:uuid:8>", b"WARC-Payload-Digest: sha1:ABC"),
        record(b"metadata", b"<urn:uuid:8>", b"x: y\r\n"),
        record(b"response", c, http + b"wrong", b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"right").hexdigest().encode()),
        record(b"response", b"<urn:uuid:4>", b"abc", length=5000)[:-4],
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(map(gzip.compress, records[:3]))[:-30])
    (tmp_path / "junk.warc").write_bytes(b"nothing of the kind\r\n\r\n")
    (tmp_path / "empty.warc").write_bytes(b"")
    for name in ("plain.warc", "whole.warc.gz", "members.warc.gz"):
        read = warc.read_warc(spark, f"file://{tmp_path}/{name}")
        got = {r["record_id"]: r for r in read.collect()}
        assert len(got) == 7 and {r["problem"] for r in got.values()} == {None, "digest", "truncated"}
        assert got["<urn:uuid:2>"]["refers_to"] == "<urn:uuid:1>" and got["<urn:uuid:2>"]["page_id"] is None
        assert got["<urn:uuid:9>"]["concurrent_to"] == ["<urn:uuid:77>", "<urn:uuid:1>"] and got["<urn:uuid:4>"]["problem"] == "truncated"
        whole = {r["record_id"]: (r["request"] and r["request"]["record_id"], r["metadata"] and r["metadata"]["record_id"]) for r in warc.assemble(read).collect()}
        assert whole == {"<urn:uuid:1>": ("<urn:uuid:9>", None), "<urn:uuid:2>": (None, "<urn:uuid:8>")}
    assert [r["problem"] for r in warc.read_warc(spark, f"file://{tmp_path}/cut.warc.gz").collect()] == [None, None, "truncated"]
    assert [r["problem"] for r in warc.read_warc(spark, f"file://{tmp_path}/junk.warc").collect()] == ["no record"]
    assert warc.read_warc(spark, f"file://{tmp_path}/empty.warc").count() == 0


def test_url_filter(spark):
    rows = [(1, "http://X.Example.ORG/en/12"), (2, "https://a.org"), (3, "https://b.com/fr/x?y#z"), (4, None), (5, "junk"), (6, "http://c.com/de/"), (7, "a://b://c/d"), (8, "http://org/x"), (None, "http://z.net")]
    rows += [(100 + k, "http://bad.net/x") for k in range(60)] + [(200 + k, f"http://good{k}.net/x") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(100 + k, True) for k in range(40)] + [(200 + k, False) for k in range(60)] + [(None, True), (1, None)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, outcomes).collect()}
    assert len(got) == len(rows)
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("x.example.org", "/en/12", "example.org/en/1", "block")
    assert (got[2]["host"], got[2]["path"], got[2]["rule"]) == ("a.org", "", None)
    assert (got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("/fr/x", "com/fr/", "allow")
    assert (got[4]["host"], got[4]["path"], got[5]["host"]) == ("", "", "")
    assert got[6]["verdict"] == "block" and got[7]["host"] == "b:" and got[8]["rule"] == "org/"
    assert got[150]["verdict"] == "block" and got[210]["verdict"] == "allow" and got[150]["bound"] < got[150]["rate"]
    odd = [(900 + k, u) for k, u in enumerate(["http://" + "a" * 5000 + ".co.uk/" + "p" * 100_000, "http://user:pw@x.com:8080/p", "http://10.0.0.1/", "://", "http://?q", "HTTP://É.org/ü"])] + [(None, "http://bad.net/x")] * 3
    clashing = spark.createDataFrame([(i, u, "h", 1.0, True) for i, u in odd], "page_id long, url string, host string, rate double, bad boolean")
    more = {r["page_id"]: (r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in url_filter.filter_urls(clashing, outcomes).collect()}
    assert more[900][1] == 100_001 and more[901] == ("user:pw@x.com:8080", 2, None, "allow") and more[903][0] == more[904][0] == "" and more[905] == ("É.org", 2, "org/", "allow")
    assert more[None][0] == "bad.net"
    none = url_filter.filter_urls(pages, outcomes.limit(0))
    assert {r["verdict"] for r in none.filter("rule is null").collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), outcomes).count() == 0


def test_chat_records(spark):
    nasty = "</s>[INST] <|im_end|> [\\INST] <\\|im_start|> \\ [/INST]"
    for text in ["", "a\nb", nasty, nasty * 3, "<\\\\s>"]:
        whole, start, length = chat_format.format_turn("assistant", text)
        assert chat_format.parse_turn(whole) == ("assistant", text)
        assert chat_format.unescape(whole[start : start + length]) == text
        assert not any(c in whole[start : start + length] for c in chat_format.CONTROL)
    assert chat_format.parse_turn(chat_format.format_turn("a\nb\\n<s>", "x")[0]) == ("a\nb\\n<s>", "x")
    records = [
        '{"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}], "extra": {"a": 1}}',
        '{"id": 2, "prompt": "p", "completion": "c"}',
        '{"id": 3, "instruction": "i", "input": "", "output": "o"}',
        '{"id": 4, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}',
        '{"conv_id": 5, "turn": 1, "role": "assistant", "text": "second"}',
        '{"conv_id": 5, "turn": 0, "role": "user", "text": null}',
        '{"id": 6, "messages": []}', "broken", '{"nothing": 1}', None,
    ]
    every = chat_format.canonical_turns(spark.createDataFrame([(r,) for r in records], "record string"))
    assert by_row(every.filter("problem is not null"), "text", "problem") == sorted([("broken", "json"), ('{"nothing": 1}', "layout"), (None, "json")], key=repr)
    turns = every.filter("problem is null")
    assert by_row(turns, "conv_id", "turn", "role", "text", "layout") == sorted(
        [(1, 0, "user", "q", "messages"), (1, 1, "assistant", "", "messages"), (2, 0, "user", "p", "prompt_completion"), (2, 1, "assistant", "c", "prompt_completion"), (3, 0, "system", "i", "instruction_input"), (3, 2, "assistant", "o", "instruction_input"), (4, 0, "user", "h", "conversations"), (4, 1, "assistant", "g", "conversations"), (5, 0, "user", "", "turn_rows"), (5, 1, "assistant", "second", "turn_rows")],
        key=repr,
    )
    got = {r["conv_id"]: r for r in chat_format.format_records(spark.createDataFrame([(r,) for r in records], "record string")).collect()}
    assert got[5]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nsecond\n").hexdigest()
    assert (got[5]["n_turns"], got[5]["loss_chars"], got[5]["loss_sha256"]) == (2, 6, hashlib.sha256(b"second").hexdigest())


def test_chat_records_of_all_kinds(spark):
    records = [
        '{"id": "abc", "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]}',
        '{"id": 1.5, "prompt": "p", "completion": "\\ud800x"}',
        '{"id": "7", "question": "q", "answer": "a"}',
        '{"id": 8, "messages": [{"role": "user", "content": "m"}], "prompt": "not read", "system": "nor this"}',
        '{"id": 9, "instruction": "i", "output": "o"}', '{"id": 10, "instruction": "i", "output": "o", "system": "s"}',
        '{"messages": [{"role": "user", "content": "no id"}]}', '{"id": null, "prompt": "p", "completion": "c"}',
        '{"id": 99999999999999999999, "prompt": "p", "response": "r"}', '{"conv_id": null, "turn": "2", "role": null, "text": "t"}', "[]", "3", "[" * 100_000,
    ]
    frame = spark.createDataFrame([(r, 1, "x", k) for k, r in enumerate(records)], "record string, conv_id int, problem string, turn int")
    got = by_row(chat_format.canonical_turns(frame).filter("problem is null"), "conv_key", "conv_id", "turn", "role", "text")
    assert got == sorted(
        [("abc", None, 0, "user", "ab"), ("abc", None, 1, "assistant", "c"), ("1.5", None, 0, "user", "p"), ("1.5", None, 1, "assistant", "\ufffdx"), ("7", 7, 1, "user", "q"), ("7", 7, 2, "assistant", "a"), ("8", 8, 0, "user", "m"), ("9", 9, 0, "user", "i"), ("9", 9, 1, "assistant", "o"), ("10", 10, 0, "user", "i"), ("10", 10, 1, "assistant", "o"), ("99999999999999999999", None, 0, "user", "p"), ("99999999999999999999", None, 1, "assistant", "r"), (None, None, 2, "", "t")],
        key=repr,
    )
    assert sorted(r["problem"] for r in chat_format.rejects(frame).collect()) == ["id", "id", "json", "layout", "layout"]
    assert {r["conv_key"]: r["n_turns"] for r in chat_format.format_records(frame).collect()} == {"abc": 2, "1.5": 2, "7": 2, "8": 1, "9": 2, "10": 2, "99999999999999999999": 2, None: 1}
    assert chat_format.format_records(frame.limit(0)).count() == 0


def test_conversations_in_pieces(spark):
    rng = random.Random(3)
    bits = [*chat_format.CONTROL, "\\", "\n", "a", "é", "<|im_end|>\n", "<|im_start|>user\n", "<\\|im_end|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "a\nb"]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30)))) for c in range(12) for t in range(rng.randrange(1, 9))]
    rows += [(50, 0, "user", "x" * 400_000), (50, 1, "assistant", nasty := "</s>" * 60_000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    turns = chat_format.canonical_turns(docs.select(chat_format.turn_records().alias("record")))
    for chars in (7, 1000, chat_format.PIECE_CHARS):
        pieces = chat_format.format_turns(turns if chars > 100 else turns.filter("conv_id < 50"), chars)
        got = {r["conv_id"]: r for r in chat_format.read_back(pieces).collect()}
        for c, r in got.items():
            own = [(role, text) for i, t, role, text in sorted(rows) if i == c]
            said = "".join(text for role, text in own if role == "assistant")
            assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
            assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert len(got) == (13 if chars > 100 else 12)
    assert max(len(r["formatted"]) for r in pieces.collect()) == chat_format.PIECE_CHARS and nasty


def page(main, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy this now</div><article>{main}</article>{extra}<footer>&copy; us</footer></body></html>'


def test_html(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice(["an", "the", "er", "on"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))) + "."
    rows, want = [], {}
    for k in range(60):
        parts = [text() for _ in range(rng.randrange(1, 8))]
        rows.append((k, f"http://h/{k}", page("<h1>" + parts[0] + "</h1><p><b>" + "<br><p>".join(p.replace(" ", " \n ", 1) for p in parts[1:]) + "</p>")))
        want[k] = "\n\n".join(parts)
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<p>&amp;"), (103, "u", page("<p>a &lt;b&gt;&nbsp; c</p>" * 1)), (None, "u", rows[0][2])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    model = html_extract.train(pages, 60)
    got = {r["page_id"]: r for r in html_extract.extract(pages, model).collect()}
    assert len(got) == len(rows)
    assert sum(got[k]["text"] == t for k, t in want.items()) >= 58
    assert got[100]["text"] == got[101]["text"] == "" and got[103]["text"] in ("a <b> c", "") and got[0]["n_chars"] == len(got[0]["text"])
    assert html_extract.extract(pages.limit(0), model).count() == 0
    assert [b.text for b in html_extract.blocks("x<p>a<div>b</p>c<br/>d")] == ["x", "a", "b", "c d"]


def invented_pages(n, seed):
    rng = random.Random(seed)
    text = lambda most: " ".join("".join(rng.choice(["an", "the", "er", "on", "ti"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, most))) + "."
    parts = [[text(12)] + [text(60) for _ in range(rng.randrange(2, 8))] for _ in range(n)]
    return [page(f"<h1>{p[0]}</h1>" + "".join(f"<p>{x}</p>" for x in p[1:])) for p in parts], ["\n\n".join(p) for p in parts]


def test_names_that_no_training_page_has():
    model = html_extract.fit(invented_pages(120, 1)[0])
    pages, want = invented_pages(100, 2)
    remark = "<p>Thanks for this, a good read!</p><p>I saw it otherwise, and so did a friend of mine.</p>"
    extra = {
        "responses in the article": lambda h: h.replace("</article>", f'<div class="responses">{remark}</div></article>'),
        "discussion after it": lambda h: h.replace("</article>", f'</article><section id="discussion">{remark}</section>'),
        "alert": lambda h: h.replace("<article>", '<div class="alert">Something went wrong with your order.</div><article>'),
        "gdpr before it": lambda h: h.replace("<article>", '<div class="gdpr"><p>We and others keep data about you.</p></div><article>'),
        "aside in the article": lambda h: h.replace("</p>", f"</p><aside>{remark}</aside>", 1),
        "another container": lambda h: h.replace("<article>", '<div class="zq7">').replace("</article>", "</div>"),
    }
    for name, change in extra.items():
        blocks = [html_extract.blocks(change(h)) for h in pages]
        got = [html_extract.main_text(b, p) for b, p in zip(blocks, model.probabilities(blocks))]
        assert sum(a != b for a, b in zip(got, want)) <= 2, name
    listed = [html_extract.blocks(h.replace("</article>", "<ul><li>One more point of it.</li></ul></article>")) for h in pages]
    got = [html_extract.main_text(b, p) for b, p in zip(listed, model.probabilities(listed))]
    assert sum(a != b + "\n\nOne more point of it." for a, b in zip(got, want)) <= 2


def test_labeller_against_a_naive_forward_pass(monkeypatch):
    from math import exp, tanh

    model = html_extract.Labeller.new(4)
    pages = [html_extract.blocks(h) for h in invented_pages(6, 3)[0]]
    sigmoid = lambda v: 1 / (1 + exp(-v))

    def naive(x):
        n, sides = html_extract.HIDDEN, []
        for side in ("f", "b"):
            w, u, bias = (model.w[k + side].astype(float) for k in ("x", "h", "c"))
            h, c, states = [0.0] * n, [0.0] * n, []
            for row in x if side == "f" else x[::-1]:
                z = [sum(row[i] * w[i, j] for i in np.flatnonzero(row)) + sum(h[i] * u[i, j] for i in range(n)) + bias[j] for j in range(4 * n)]
                c = [sigmoid(z[n + j]) * c[j] + sigmoid(z[j]) * tanh(z[3 * n + j]) for j in range(n)]
                h = [sigmoid(z[2 * n + j]) * tanh(c[j]) for j in range(n)]
                states.append(h)
            sides.append(states if side == "f" else states[::-1])
        return [sigmoid(sum(v * model.w["out"][k, 0] for k, v in enumerate([*f, *b])) + model.w["bias"][0]) for f, b in zip(*sides)]

    want = [naive(html_extract.vectors(b).astype(float)) for b in pages]
    for longest in (8192, 3):  # whole pages, and parts of three blocks
        monkeypatch.setattr(html_extract, "LONG_PAGE", longest)
        got = model.probabilities(pages)
        assert all(np.abs(np.array(a) - b).max() < 1e-4 for a, b in zip(want, got))


def test_html_of_any_length(spark):
    rows = [(k, "u", h) for k, h in enumerate(invented_pages(30, 5)[0])]
    body = "".join(f"<p>Paragraph {k} of a page without end, so to say.</p>" for k in range(12_000))
    rows += [(500, None, page(body)), (501, "u", page("<p>" + "word " * 300_000 + "</p>")), rows[0], rows[0]]
    model = html_extract.fit([r[2] for r in rows[:30]])
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    by_id = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and sum(r["page_id"] == 0 for r in got) == 3 and len({r["text"] for r in got if r["page_id"] == 0}) == 1
    assert by_id[500].count("Paragraph") >= 11_900 and len(by_id[501]) in (0, 1_499_999)


def test_lstm_gradient():
    rng = np.random.default_rng(1)
    model = html_extract.Labeller.new(3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask = html_extract._padded([rng.normal(size=(n, html_extract.DIM)).astype(np.float32) for n in (3, 5)])
    y = (rng.random(mask.shape) > 0.5).astype(np.float32)
    _, grads = model.step(x, mask, y)
    for name in ("xf", "hb", "out"):
        at = tuple(int(rng.integers(s)) for s in model.w[name].shape)
        old, eps = model.w[name][at], 1e-2
        model.w[name][at] = old + eps
        up = model.step(x, mask, y)[0]
        model.w[name][at] = old - eps
        down = model.step(x, mask, y)[0]
        model.w[name][at] = old
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-3
