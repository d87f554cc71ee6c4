"""Streams that keep state by key: replays, late events, replacement."""

import datetime
import random

from pyspark.sql import functions as F

from lanternflow.operators import chats as C
from lanternflow.operators import ingest as I
from lanternflow.operators import parsing as P
from lanternflow.streaming import streams as W

from test_keyed import files
from test_operators import rows

COLUMNS = ("question_norm", "good_count", "bad_count", "answer_text", "created_at", "updated_at", "last_used_at")
EVENTS = "event_id long, question string, answer string, rating int, ts long"


def ratings(seed, n, questions):
    rng = random.Random(seed)
    return [(k, f"q{rng.randrange(questions)}", f"a{k}", rng.choice([1, 1, -1, 0]), k) for k in range(n)]


def test_feedback_counts_once_and_in_its_place(spark, tmp_path):
    """Ratings come late, out of order and again; the cache after each batch is that of all ratings so far, in order of time."""
    e = ratings(3, 240, 9)
    rng = random.Random(4)
    due = {r: min(3, r[0] // 60 + (rng.random() < 0.3)) for r in e}
    state = W.FeedbackState(spark, f"file://{tmp_path}/s", late_by=130, time_type="bigint", buckets=4)
    sent = []
    for k in range(4):
        own = [r for r in e if due[r] == k]
        again = rng.sample(sent, min(len(sent), 20)) + own[:5]
        sent += own
        state.fold(spark.createDataFrame(own + again, EVENTS), k)
        assert rows(state.read(), *COLUMNS) == rows(C.feedback_cache(spark.createDataFrame(sent, EVENTS)), *COLUMNS), k
    state.fold(spark.createDataFrame(own + again, EVENTS), 3)  # the batch runs again
    assert rows(state.read(), *COLUMNS) == rows(C.feedback_cache(spark.createDataFrame(sent, EVENTS)), *COLUMNS)
    log = state.table.read().filter("kind = 'log'")
    assert log.agg(F.min("ts")).first()[0] >= 179 - 130  # what is older is held as counts alone
    before = rows(state.read(), *COLUMNS)
    state.fold(spark.createDataFrame([(9999, "q1", "too late", 1, 5)], EVENTS), 4)
    assert rows(state.read(), *COLUMNS) == before


def test_a_batch_writes_the_parts_of_its_questions(spark, tmp_path):
    state = W.FeedbackState(spark, f"file://{tmp_path}/s", late_by=10_000, time_type="bigint", buckets=16)
    state.fold(spark.createDataFrame(ratings(1, 2000, 500), EVENTS), 0)
    before = files(f"{tmp_path}/s/feedback")
    assert len(state.fold(spark.createDataFrame([(5000, "q7", "new", 1, 5000)], EVENTS), 1)) == 1
    after = files(f"{tmp_path}/s/feedback")
    changed = {f.split("bucket=")[1].split("/")[0] for f in before.keys() ^ after.keys()}
    assert len(changed) == 1
    assert rows(state.read().filter("question_norm = 'q7'"), "answer_text") == [("new",)]


def test_feedback_stream_from_checkpoints(spark, tmp_path):
    e = ratings(8, 200, 7)
    events = spark.createDataFrame(e, EVENTS)
    path = f"file://{tmp_path}/out"
    for k in range(3):
        events.filter(F.col("ts").between(k * 70, k * 70 + 69)).write.mode("append").parquet(f"{tmp_path}/in")
        W.fold_feedback(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), path, 60)
    assert rows(W.last_state(spark, path, "bigint"), *COLUMNS) == rows(C.feedback_cache(events), *COLUMNS)


def at(day):
    return datetime.datetime(2024, 1, day)


def test_captures_replace_chunks(spark, tmp_path):
    long = "<article>" + "".join(f"<h2>H{k}</h2><p>{'w ' * 300}</p>" for k in range(4)) + "</article>"
    parts = [
        [(1, 1, long, at(1)), (2, 1, "<article>two</article>", at(1)), (3, 1, long, at(1))],
        [(1, 1, "<article>short</article>", at(3)), (2, 1, "<article>older</article>", at(0 + 1)), (3, 1, "<p>none</p>", at(2)), (3, 1, "<article>skipped</article>", at(1))],
        [(1, 1, long, at(2)), (2, 1, "<article>two</article>", at(4)), (4, 1, None, at(1))],
    ]
    rules = spark.createDataFrame([(1, "r", "n", "article", None, "whole", False)], P.SITE_RULES)
    path, schema = f"file://{tmp_path}/out", "page_id long, site_id long, html string, captured_at timestamp"
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        W.ingest_pages(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), path, rules)
        if part is parts[0]:
            assert {r[0]: r[1] for r in W.current_chunks(spark, path).groupBy("page_id").count().collect()} == {1: 4, 2: 1, 3: 4}
    out = W.current_chunks(spark, path)
    assert rows(out, "page_id", "extract_index", "chunk_index", "text") == [(1, 0, 0, "short"), (2, 0, 0, "two")]
    assert all(len(r["embedding"]) == 64 for r in out.collect())
    marks = W.chunks_table(spark, path).read().filter("extract_index < 0")
    assert {r["page_id"]: r["captured_at"] for r in marks.collect()} == {1: at(3), 2: at(4), 3: at(2), 4: at(1)}


def test_discovered_urls_and_captures_by_streams(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    found = [[("u", "html", 1), ("v", "html", 2)], [("u", "pdf", 5), ("w", "html", 6)], [("u", "pdf", 9)]]
    for part in found:
        spark.createDataFrame(part, "url string, kind string, discovered_at long").write.mode("append").parquet(f"{tmp_path}/in")
        W.keep_discovered(spark.readStream.schema("url string, kind string, discovered_at long").parquet(f"{tmp_path}/in"), path)
    assert rows(W.discovered_table(spark, path).read()) == [("u", "pdf", 1), ("v", "html", 2), ("w", "html", 6)]
    schema = "url string, html string, captured_at timestamp"
    for part in ([("u", "a", at(1)), ("v", None, at(1))], [("u", "b", at(3)), ("u", "x", at(2))], [("u", "old", at(2)), ("v", None, at(4))]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/captures")
        W.keep_captures(spark.readStream.schema(schema).parquet(f"{tmp_path}/captures"), path)
    got = W.captures_table(spark, path).read().orderBy("url").select("url", "html", "last_scraped", "last_changed").collect()
    assert [tuple(r) for r in got] == [("u", "b", at(3), at(3)), ("v", None, at(4), at(1))]


def test_frontier_reads_only_its_parts(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(700)] + [("n0", "n0"), (None, "n1"), ("n2", None)]
    links = spark.createDataFrame(edges, "src string, dst string")
    depth, front = {"n0": 0}, ["n0"]
    while front:
        front = sorted({d for s, d in edges if s in front and d is not None and d not in depth})
        depth |= {n: max(depth.values()) + 1 for n in front}
    assert rows(I.link_frontier(links, "n0", 10_000)) == sorted(depth.items())
    assert I.link_frontier(links, "n0", 7).count() == 7


def test_pending_of_a_site(spark):
    found = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "url string, site_id long")
    assert rows(I.pending(found, found.filter("url = 'a'"), None, 1)) == [("b", 1)]


def test_users_over_runs(spark, tmp_path):
    visits = [(f"a{k % 37}", (k * 31) % 500, k) for k in range(400)]
    table = lambda v: spark.createDataFrame(v, "address string, ts long, id long")
    users = C.Users(spark, f"file://{tmp_path}/u", "bigint", 4)
    early = [v for v in visits if v[1] < 20]
    first = {r["address"]: r["user_id"] for r in users.resolve(table(early)).collect()}
    assert sorted(first.values()) == list(range(1, len(first) + 1))
    assert users.resolve(table(early)).count() == len(first) and users.read().count() == len(first)
    every = {r["address"]: r["user_id"] for r in C.Users(spark, f"file://{tmp_path}/u", "bigint", 4).resolve(table(visits)).collect()}
    assert first.items() <= every.items()
    assert every == {r["address"]: r["user_id"] for r in C.resolve_users(table(visits)).collect()}
    assert users.resolve(table([])).count() == 0


def test_previous_question_over_ranges(spark):
    rng = random.Random(5)
    m = [(k, 1 if k < 200 else rng.randrange(2, 9), rng.choice(["user", "assistant", "assistant"]) if k > 60 else rng.choice(["assistant"] * 9 + ["user"]), f"t{k}", k // 3 if k < 200 else rng.randrange(50)) for k in range(600)]
    table = spark.createDataFrame(m, "id long, chat_id long, role string, content string, created_at long")
    want = []
    for i, chat, role, _, t in m:
        if role == "assistant":
            before = [(u, -j, s) for j, c, r, s, u in m if c == chat and r == "user" and u <= t]
            best = max(before, default=None)
            want.append((i, -best[1] if best else None, best[2] if best else None))
    for parts in (1, 5, 40):
        got = [tuple(r) for r in C.previous_question(table, parts).select("id", "question_id", "question").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert C.previous_question(table.limit(0)).count() == 0


def test_a_batch_normalises_its_questions_once(spark, tmp_path, monkeypatch):
    calls, real = [], W.T.normalize_question
    monkeypatch.setattr(W.T, "normalize_question", lambda c: calls.append(1) or real(c))
    state = W.FeedbackState(spark, f"file://{tmp_path}/s", late_by=10, time_type="bigint", buckets=1)
    state.fold(spark.createDataFrame([(1, "Q  a", "x", 1, 5), (2, "q A", "y", -1, 6)], EVENTS), 0)
    assert len(calls) == 1
    assert [(r["question_norm"], r["good_count"], r["bad_count"], r["answer_text"]) for r in state.read().collect()] == [("q a", 1, 1, "x")]
