"""Ids of 64 bits in archives, very long texts, and many test items."""

import random
import time

from lanternflow.llm import chat_format, decontamination, exact_dedup, ngram_join, packing, warc

from test_llm import frame


def test_ids_of_64_bits(spark):
    assert [warc.whole_number(x) for x in ("9223372036854775807", "-9223372036854775808", "9223372036854775808", "1" * 25, "x", "", None)] == [2**63 - 1, -(2**63), None, None, None, None, None]
    html = "<p>" + "page " * 40 + "</p>"
    ids = [-(2**63), 1234567890123456789, 2**63 - 1]
    pages = spark.createDataFrame([(i, f"http://a/{i}", html) for i in ids], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {ids[0]: ("response", None), ids[1]: ("revisit", ids[0]), ids[2]: ("revisit", ids[0])}


def test_reading_back_is_linear_in_a_turn():
    def read(n):
        text = f"{chat_format.START}user\n" + "word " * (n // 5) + chat_format.END + "\n"
        reader = chat_format._Reader()
        began = time.time()
        for at in range(0, len(text), 20_000):
            reader.add(text[at : at + 20_000], [])
        return time.time() - began, reader.done()

    read(1_000_000)
    short, one = read(4_000_000)
    long, two = read(16_000_000)
    assert one[0] == two[0] == 1 and long < 12 * max(short, 0.05)
    # A mark that two pieces share is found.
    reader = chat_format._Reader()
    whole = f"{chat_format.START}user\nhi{chat_format.END}\n{chat_format.START}assistant\nyo{chat_format.END}\n"
    for c in whole:
        reader.add(c, [])
    assert reader.done()[0] == 2


def test_many_items_take_one_drop(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = [(k, text(20)) for k in range(30)]
    rows = [(k, text(30) + " " + items[k][1] + " " + text(30) if k % 3 == 0 else text(60)) for k in range(30)] + [(100, None), (101, ""), (3, text(40))]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(k for k, t in rows if k >= 30 or k % 3 or (k == 3 and items[3][1] not in t))
    for block in (20_000, 7):
        left = decontamination.decontaminate(frame(spark, rows + rows[4:5]), table, items_per_block=block)
        assert left.columns == frame(spark, []).columns
        assert sorted(r["doc_id"] for r in left.collect()) == sorted([*want, 4])


def test_texts_of_many_megabytes(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(700_000))
    item = " ".join(f"item{k}" for k in range(40))
    near = long.replace("w1 ", "v1 ", 20)
    rows = [(1, long), (2, near), (3, long.replace(" ", "\n")), (4, long[: len(long) // 2] + " " + item + " " + long[len(long) // 2 :]), (5, "short")]
    docs = frame(spark, rows)
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs).select("doc_id", "keep_id").collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_classes(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    benchmark = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated_pairs(docs, benchmark).collect()] == [(4, 9)]
    one = packing.pack(docs.filter("doc_id in (1, 5)")).collect()
    assert all(r["length"] <= 2048 for r in one) and sum(r["length"] == 2048 for r in one if r["doc_id"] == 1) > 500


def test_components_end_with_stars(spark, monkeypatch):
    """Links that are stars take one round, and ids of classes so far are not shuffled through more of them."""
    written = []
    monkeypatch.setattr(ngram_join, "materialise", lambda df, name, real=ngram_join.materialise: (written.append(name), real(df, name))[1])
    got = ngram_join.components(spark.createDataFrame([(1, k) for k in range(2, 30)] + [(k, 40) for k in range(41, 50)], "a long, b long"))
    assert {r["id"]: r["comp"] for r in got.collect()} == {k: 1 for k in range(1, 30)} | {k: 40 for k in range(40, 50)}
    assert written == ["edges", "edges"]
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0
