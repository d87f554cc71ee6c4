import pytest
from pyspark.sql import functions as F

from lanternflow.operators import chats as C
from lanternflow.operators import ingest as I
from lanternflow.operators import parsing as P
from lanternflow.operators import retrieval as R
from lanternflow.operators import tables as B
from lanternflow.sources import schemas as S
from lanternflow.streaming import streams as W


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    data = [(1, 0, "u1", "red apple pie", [1.0, 0.0]), (2, 0, "u1", "green apple", [0.0, 1.0]), (3, 1, "u2", "blue sky", [0.7, 0.7]), (4, 2, "u3", None, [0.0, 0.0])]
    return spark.createDataFrame(data, "chunk_id long, extract_id long, url string, text string, embedding array<float>")


def test_hybrid(spark, corpus):
    queries = spark.createDataFrame([(1, "apple pie"), (2, "nothing known")], "query_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<float>")
    found = R.hybrid_search(corpus, queries, vectors, 3)
    out = {(r["query_id"], r["rank"]): r for r in found.collect()}
    assert [out[1, k]["chunk_id"] for k in (1, 2, 3)] == [1, 3, 2]
    assert out[1, 1]["score"] == 1.0 and out[1, 1]["from_vector"] and out[1, 1]["from_bm25"]
    assert out[2, 1]["chunk_id"] == 2 and out[2, 1]["bm25"] == 0.0
    assert R.hybrid_search(corpus, queries, vectors, 0).count() == 0
    assert R.hybrid_search(corpus.limit(0), queries, vectors, 3).count() == 0
    with pytest.raises(ValueError):
        R.hybrid_search(corpus, queries, vectors, -1)
    extracts = spark.createDataFrame([(0, " e0 "), (1, "e1"), (2, "e2")], "extract_id long, text string")
    parents = R.parent_extracts(found, extracts, 0)
    assert rows(parents, "query_id", "extract_id") == [(1, 0), (2, 0)]
    context = R.build_context(R.parent_extracts(found, extracts, 2), ["note"]).filter("query_id = 1").first()["context"]
    assert context.startswith("[glossary]\nnote\n\n---\n\n[extract_id=0 score=1.0000]\ne0\n\n---\n\n[extract_id=1")
    assert len(R.source_links(found, 1).collect()) == 2
    prompts = R.rag_prompts(queries, R.build_context(parents).filter("query_id = 1"), "s").orderBy("query_id").collect()
    assert [p["has_context"] for p in prompts] == [True, False] and prompts[1]["prompt"].endswith("Context:\n")


def test_vector_blocks(spark, corpus):
    vectors = spark.createDataFrame([(q, [float(q % 3), 1.0]) for q in range(9)], "query_id long, vector array<float>")
    assert rows(R.vector_top_k(corpus, vectors, 2)) == rows(R.vector_top_k(corpus, vectors, 2, block=2))


def test_bm25_top_k(spark, tmp_path):
    import random

    rng = random.Random(4)
    words = ["the"] * 20 + [f"w{k}" for k in range(40)]
    data = [(k, k, "u", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))), [1.0]) for k in range(200)] + [(500, 1, "u", None, None)]
    rows_ = spark.createDataFrame(data, "chunk_id long, extract_id long, url string, text string, embedding array<float>")
    queries = spark.createDataFrame([(q, f"the w{q} w{q + 1} unknown") for q in range(20)] + [(99, "nowhere")], "query_id long, text string")
    index = R.Index(rows_, f"file://{tmp_path}/index")
    want = rows(R.top_k(R.bm25(index, queries), "bm25", 7))
    for block in (4096, 6):
        assert rows(R.bm25_top_k(index, queries, 7, block)) == want
    assert len(want) == 140 and R.bm25_top_k(index, queries, 0).count() == 0
    assert R.bm25_top_k(R.Index(rows_.limit(0)), queries, 3).count() == 0
    pairs = R.bm25(index, queries).select("query_id", "chunk_id").filter("chunk_id % 3 = 0")
    assert rows(R.bm25_of(index, queries, pairs)) == rows(R.bm25(index, queries).filter("chunk_id % 3 = 0"))


def test_bm25_by_hand(spark, corpus):
    import math

    got = R.bm25(corpus, spark.createDataFrame([(1, "pie pie apple")], "query_id long, text string")).filter("chunk_id = 1").first()["bm25"]
    avg = 7 / 4
    weight = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert got == round(weight(1) + weight(2), 6)


def test_messages(spark):
    m = spark.createDataFrame([(1, 1, "user", "a", 10), (2, 1, "user", "b", 10), (3, 1, "assistant", "c", 10), (4, 1, "assistant", "d", 5), (5, 2, "assistant", "e", 1)], "id long, chat_id long, role string, content string, created_at long")
    assert {(r["id"], r["question_id"]) for r in C.previous_question(m).collect()} == {(3, 1), (4, None), (5, None)}
    last = C.last_messages(m.filter("chat_id = 1"), 2).orderBy("position").collect()
    assert [r["id"] for r in last] == [2, 1]
    chats = spark.createDataFrame([(1, 7, "New chat"), (2, 8, None)], "id long, user_id long, title string")
    assert {r["id"] for r in C.owned(m, chats, spark.createDataFrame([(8,)], "user_id long")).collect()} == {5}
    assert rows(C.derived_titles(chats, m), "id", "title")[0] == (1, "a")
    assert [r["id"] for r in C.search_titles(chats, " CHAT 2 ").collect()] == [2]
    assert C.search_titles(chats, "  ").count() == 2
    changed = C.rename(chats, spark.createDataFrame([(1, 7, " x  y "), (2, 7, "no"), (2, 8, "  ")], "id long, user_id long, new_title string"))
    assert {(r["id"], r["title"]) for r in changed.collect()} == {(1, "x y"), (2, None)}


def test_feedback(spark):
    e = [(1, "Q ", "a1", -1, 1), (2, "q", "a2", 1, 2), (3, " q", "a3", -1, 3), (4, "q", "a4", 1, 4), (5, "z", "b", -1, 5), (6, "y", "c", 1, 6), (7, "y", "d", 0, 7)]
    events = spark.createDataFrame(e, "event_id long, question string, answer string, rating int, ts long")
    cache = C.feedback_cache(events)
    assert rows(cache, "question_norm", "good_count", "bad_count", "answer_text") == [("q", 2, 1, "a4"), ("y", 1, 0, "c")]
    asked = spark.createDataFrame([(1, " Y "), (2, "q")], "query_id long, text string")
    assert rows(C.cache_lookup(asked, cache), "query_id", "answer_text") == [(1, "c")]
    assert rows(C.cache_routing(asked, cache), "query_id", "route") == [(1, "cache"), (2, "retrieval")]
    users = C.resolve_users(spark.createDataFrame([("b", 2, 1), ("a", 1, 2), ("b", 0, 3)], "address string, ts long, id long"))
    assert rows(users, "address", "user_id") == [("a", 2), ("b", 1)]


def test_users_are_numbered_over_ranges(spark):
    visits = spark.createDataFrame([(f"a{k % 97}", (k * 31) % 500, k) for k in range(1000)], "address string, ts long, id long")
    for parts in (1, 7):
        users = sorted((r["first_seen"], r["user_id"]) for r in C.resolve_users(visits, parts).collect())
        assert [n for _, n in users] == list(range(1, 98))
    assert C.resolve_users(visits.limit(0)).count() == 0


def test_one_message_an_id(spark):
    """Long chats give the same ids to messages of several chats: each id is one message and one rating."""
    m = [(198, 1, "user", "late", 900), (199, 1, "assistant", "B", 910), (198, 2, "user", "early", 100), (199, 2, "assistant", "A", 110), (200, 2, "user", "u", 120), (200, 3, "assistant", "none", 10)]
    messages = spark.createDataFrame([(*x, None) for x in m], "id long, chat_id long, role string, content string, created_at long, sources_json string")
    for parts in (1, 3):
        assert rows(C.previous_question(messages, parts), "id", "chat_id", "question_id", "question") == [(199, 2, 198, "late"), (200, 3, None, None)]
    chats = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "id long, user_id long")
    messages = messages.union(spark.createDataFrame([(299, 1, "assistant", "C", 920, None), (299, 2, "assistant", "D", 130, None), (301, 1, "assistant", "E", 930, None), (301, 2, "user", "v", 140, None)], messages.schema))
    # The first rating of 299 is by another user; that of 301 is older than what an assistant said under this id.
    more = [(299, 299, 8, 1, 925), (299, 299, 7, 1, 135), (301, 301, 7, 1, 935), (301, 301, 8, 1, 145)]
    ratings = spark.createDataFrame([*more, (199, 199, 7, 1, 915), (199, 199, 8, 1, 115), (200, 200, 9, 1, 15)], "id long, message_id long, user_id long, rating int, created_at long")
    assert rows(C.feedback_events(ratings, messages, chats), "event_id", "question", "answer", "ts") == [(199, "late", "A", 115), (301, "late", "E", 935)]


def test_sources_stay_where_an_answer_has_none(spark):
    kind = "question string, answer string, sources_json string, rating int, ts long, event_id long"
    data = [("q", "A", "[1]", 1, 1, 1), ("q", "B", None, 1, 2, 2), ("q", "C", "[3]", -1, 3, 3)]
    events = spark.createDataFrame(data, kind)
    whole = C.feedback_cache(events)
    parts = C.feedback_cache(events.filter("ts > 1"), C.feedback_cache(events.filter("ts = 1")))
    assert rows(whole, "answer_text", "sources_json", "good_count", "bad_count") == rows(parts, "answer_text", "sources_json", "good_count", "bad_count") == [("B", "[1]", 2, 1)]


def test_ratings_of_messages(spark):
    m = [(1, 1, "user", "Q", 10, None, None), (2, 1, "assistant", "A", 11, '[{"url": "u"}]', "{}"), (3, 2, "assistant", "alone", 5, "broken", ""), (4, 1, "user", "never rated", 12, None, None), (5, 1, "assistant", "B", 13, None, None)]
    messages = spark.createDataFrame(m, "id long, chat_id long, role string, content string, created_at long, sources_json string, debug_json string")
    chats = spark.createDataFrame([(1, 7), (2, 7)], "id long, user_id long")
    r = [(1, 2, 7, 1, 20), (2, 2, 8, -1, 21), (3, 3, 7, 1, 22), (4, 1, 7, -1, 23), (5, 99, 7, 1, 24), (6, 2, 7, -1, 25), (7, 5, 7, -1, 26)]
    ratings = spark.createDataFrame(r, "id long, message_id long, user_id long, rating int, created_at long")
    events = C.feedback_events(ratings, messages, chats)
    assert rows(events, "event_id", "question", "answer", "rating") == [(1, "Q", "A", 1), (6, "Q", "A", -1), (7, "never rated", "B", -1)]
    cache = C.feedback_cache(events)
    assert rows(cache, "question_norm", "good_count", "bad_count", "answer_text", "sources_json", "last_used_at") == [("q", 1, 1, "A", '[{"url": "u"}]', 20)]
    view = {r["id"]: (r["sources"], r["has_debug"]) for r in C.message_view(messages).collect()}
    assert view[2] == ([{"url": "u"}], True) and view[3] == ([], False) and view[1] == ([], False)
    asked = spark.createDataFrame([("q ", 99), ("Q", 50)], "text string, asked_at long")
    good = C.feedback_cache(events.filter("event_id = 1"))
    assert rows(C.touched(good, asked), "question_norm", "last_used_at") == [("q", 99)] and rows(C.touched(cache, asked), "last_used_at") == [(20,)]
    questions = spark.createDataFrame([(1, " q"), (2, "else"), (3, "nothing known")], "query_id long, text string")
    seen = []

    def retrieve(misses):
        seen.extend(r["query_id"] for r in misses.collect())
        return misses.select("query_id", F.lit("p").alias("prompt"), (F.col("query_id") == 2).alias("has_context"))

    assert rows(C.answered(questions, good, retrieve), "query_id", "route", "text") == [(1, "cache", "A"), (2, "retrieval", "p"), (3, "none", C.NO_CONTEXT)]
    assert sorted(seen) == [2, 3]


def test_duplicates_over_batches(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"html {k % 4}") for k in range(12)], "page_id long, html string")
    path = f"file://{tmp_path}/out"
    for k in range(3):
        pages.filter(F.floor(F.col("page_id") / 4) == k).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(pages.schema).parquet(f"{tmp_path}/in")
        W.run_to_table(stream.dropDuplicates(["html"]), path)
    assert rows(spark.read.parquet(f"{path}/table"), "page_id") == [(0,), (1,), (2,), (3,)]


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 8)], "k long, v string, w long")
    assert B.upsert(B.add_missing_columns(old, {"w": "long"}), new, ["k"]).orderBy("k").collect() == [(1, "a", None), (2, "c", 9), (3, "d", 8)]
    assert rows(B.partial_update(old, spark.createDataFrame([(1, None), (2, "z"), (5, "n")], "k long, v string"), ["k"])) == [(1, "a"), (2, "z")]
    assert rows(B.unique_violations(old.union(old.filter("k = 1")), ["k"])) == [(1, 2)]
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(10, 1), (20, 2)], "id long, parent_id long")
    grand = spark.createDataFrame([(100, 10), (200, 20)], "id long, parent_id long")
    assert [x.count() for x in B.cascade_delete(ids, child, grand, ids.filter("id = 1"))] == [1, 1, 1]


def test_ingest(spark):
    pages = spark.createDataFrame([("https://www.a.com/p", '<a href="/q">1</a><a href="https://a.com/r#x">2</a><a href="https://b.com/">3</a><a href="/i.png">4</a><a href="mailto:m">5</a>')], "url string, html string")
    assert rows(I.internal_links(pages, F.lit("https://www.a.com")), "url") == [("https://www.a.com/q",), ("https://www.a.com/r#x",)]
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("x", "y")], "src string, dst string")
    assert rows(I.link_frontier(links, "a", 10)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(I.link_frontier(links, "a", 2)) == [("a", 0), ("b", 1)]
    line = spark.createDataFrame([(str(k), str(k + 1)) for k in range(12)], "src string, dst string")
    assert I.link_frontier(line, "0", 100).count() == 13 and I.link_frontier(line, "none", 5).count() == 1
    copies = spark.createDataFrame([(k, "u", "same" if k < 5 else None if k < 7 else str(k)) for k in range(9)], "id long, url string, html string")
    assert rows(I.duplicate_content(copies), "id", "canonical_id", "is_duplicate") == [(k, 0 if k < 5 else 5 if k < 7 else k, k in (1, 2, 3, 4, 6)) for k in range(9)]
    old = spark.createDataFrame([("u", "html", 1)], "url string, kind string, discovered_at long")
    found = spark.createDataFrame([("u", "pdf", 5), ("v", "html", 6)], "url string, kind string, discovered_at long")
    assert rows(I.discovered_upsert(old, found)) == [("u", "pdf", 1), ("v", "html", 6)]


def test_parsing(spark):
    html = "<nav><li>A</li><li>B</li></nav><article><h2>One</h2><p>" + "x" * 1500 + "</p></article>"
    pages = spark.createDataFrame([(1, 1, html), (2, 9, html), (3, 1, "<p>none</p>"), (4, 1, None)], "page_id long, site_id long, html string")
    rules = spark.createDataFrame([(1, "r", "n", "article", "nav", "sections", False)], P.SITE_RULES)
    out = P.pages_to_chunks(pages, rules).orderBy("chunk_index").collect()
    assert {r["page_id"] for r in out} == {1} and len(out) == 2 and all(r["text"].startswith("Context: A > B\n\n") for r in out)
    short = pages.filter("page_id = 1").withColumn("html", F.lit("<article>short</article>"))
    left = P.pages_to_chunks(short, rules, P.pages_to_chunks(pages, rules)).collect()
    assert [r["text"] for r in left] == ["short"]
    seeds = rules.withColumn("rule", F.lit("whole")).unionByName(rules.withColumn("site_id", F.lit(5).cast("long")))
    assert rows(P.seed_rules(rules, seeds), "site_id", "rule") == [(1, "whole"), (5, "sections")]


def test_rules_of_sites(spark):
    item = lambda n: f"<details><p>Accordion Item</p><p>Closed Title: {n}</p><div class='collapse'><p>Accordion Item inside {n}</p></div></details>"
    html = {
        1: f"<div id=side><div><div class='box cf'>{item('a')}<h2>Head</h2><p>Text</p><div class=accordion>plain</div>{item('b')}</div></div></div><nav id=n>Home &gt; Rates</nav>",
        2: "<nav id=n><ul><li> Home </li><li></li><li>A &amp; <b>B</b></li></ul></nav><div id=side><p>not the container</p></div>",
        3: "<div id=post><div class='scroll content'><div class=doc-content-wrap><p>Intro <i>text</i></p><p>rest</p></div><ul class=kt-tabs-title-list><li>T</li></ul>"
        "<div class=kt-tabs-content-wrap><div class='x kt-inner-tab-1'><p>one</p></div><div class='kt-inner-tab-2'>two<br>lines</div><div class='kt-inner-tab-3'> </div></div><h2>After</h2><p>end</p></div></div><nav id=n>no items</nav>",
        4: "<main><p>all &lt;of&gt; it</p></main>",
    }
    pages = spark.createDataFrame([(k, k, h) for k, h in html.items()] + [(5, 9, "<main>unknown site</main>"), (6, 4, None), (7, 4, "")], "page_id long, site_id long, html string")
    box = "#side > div > div.box.cf"
    rules = [(1, "", "", box, "#n", "sections", True), (2, "", "", box, "#n", "sections", True), (3, "", "", "#post div.scroll.content", "nav", "tabs", False), (4, "", "", "main", None, "whole", False)]
    rules = spark.createDataFrame(rules, P.SITE_RULES)
    got = {r["page_id"]: r["text"] for r in P.extracts(pages, rules).collect()}
    part = lambda n: f"Accordion Item\n\nClosed Title: {n}\n\nAccordion Item inside {n}"
    assert got == {
        1: f"Context: Home > Rates\n\n{part('a')}\n\n{part('b')}\n\n## Head\n\nText\n\nplain",
        3: "Intro text\n\nStep 1: one\n\nStep 2: two\nlines\n\nrest\n\n## After\n\nend",
        4: "all <of> it",
    }
    parts = P.page_parts(pages, rules.withColumn("container", F.lit("nav, div")).withColumn("container", F.lit("div")))
    assert {r["page_id"]: r["crumbs"] for r in parts.collect()} == {1: ["Home", "Rates"], 2: ["Home", "A &B"], 3: []}
    long_tabs = pages.filter("page_id = 3").withColumn("html", F.replace("html", F.lit("<p>one</p>"), F.lit("<p>" + "word " * 30 + "</p><p>" + "more " * 250 + "</p>")))
    out = [r["text"] for r in P.tab_split(long_tabs, rules).orderBy("part").collect()]
    assert out[0].startswith("Intro text") and all(len(t) <= 1300 for t in out) and len(out) == 3


def test_declared_tables(spark, tmp_path):
    empty = S.empty(spark, "pages")
    assert empty.count() == 0 and not S.differences(empty, "pages")
    path = f"file://{tmp_path}/pages"
    good = spark.createDataFrame([(1, "u", "h")], S.schema("pages"))
    S.append(good, path, "pages")
    S.append(good.withColumn("page_id", F.lit(2).cast("int")), path, "pages")
    assert rows(S.read(spark, path, "pages"), "page_id") == [(1,), (2,)]
    with pytest.raises(ValueError):
        S.append(good.drop("html"), path, "pages")
    with pytest.raises(ValueError):
        S.append(good.withColumn("more", F.lit(1)), path, "pages")
    assert S.read(spark, path, "pages").count() == 2


def test_schemas(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0, 3.0])], "vec_id long, embedding array<float>")
    assert S.differences(df, "embeddings") == [("label", "int", None)]
    back = df.select(S.decode_vector(S.encode_vector("embedding")).alias("v")).first()["v"]
    assert back == [0.5, -1.0, 3.0]
    pending = W.embed_pending(spark.createDataFrame([(1, "a b"), (2, None)], "chunk_id long, text string"), spark.createDataFrame([(9,)], "chunk_id long"))
    assert {r["chunk_id"]: round(sum(x * x for x in r["embedding"]), 3) for r in pending.collect()} == {1: 1.0, 2: 0.0}
