"""Stored tables, their streams, and what broken files leave."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lessonlake.operators import activity as G
from lessonlake.operators import ledger as L
from lessonlake.operators import ocr as O
from lessonlake.sources import readers, store, tables
from lessonlake.streaming import activity as S
from lessonlake.streaming import pages as P
from lessonlake.streaming.sink import UpsertSink


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def new_lines(spark, *rows):
    raw = spark.createDataFrame([(t, p, i, x) for t, p, i, x in rows], "title string, page_no int, pos int, text string")
    box = F.struct(*[F.lit(1.0).alias(c) for c in ("x", "y", "width", "height")]).alias("bbox")
    return O.normalize_import_lines(raw.select("*", F.lit("9").alias("confidence"), F.lit(None).cast("boolean").alias("ai_ready"), *[F.lit(None).cast("double").alias(c) for c in ("x", "y", "width", "height")], box, F.lit(None).cast("int").alias("line_number")))


def page_files(spark, *rows):
    return spark.createDataFrame([(t, p, f"page-{p}-lines.json") for t, p in rows], "title string, page_no int, file_name string")


def stored(spark, path, name, *columns):
    return sorted(tuple(r) for r in spark.read.parquet(f"{path}/{name}").select(*columns).collect())


def test_import_into_stored_books(spark, tmp_path):
    path = str(tmp_path)
    first = new_lines(spark, ("A", 1, 0, "one"), ("A", 1, 1, "two"), ("A", 70, 0, "far"), ("B", 1, 0, "other"))
    files = page_files(spark, ("A", 1), ("A", 70), ("B", 1), ("B", 2))
    counts, totals = store.import_books(spark, path, first, files)
    assert sorted((r.page_no, r.line_count) for r in counts.collect()) == [(1, 1), (1, 2), (2, 0), (70, 1)]
    assert sorted((r.book_title, r.imported_pages, r.imported_lines) for r in totals.collect()) == [("A", 2, 3), ("B", 2, 1)]
    before = [stored(spark, path, n, *c) for n, c in (("books", ["book_id", "title"]), ("book_pages", ["book_id", "page_no", "raw_text"]), ("book_lines", ["book_id", "page_no", "line_number", "text"]))]
    store.import_books(spark, path, first, files)
    assert before == [stored(spark, path, n, *c) for n, c in (("books", ["book_id", "title"]), ("book_pages", ["book_id", "page_no", "raw_text"]), ("book_lines", ["book_id", "page_no", "line_number", "text"]))]
    was = files_of(f"{path}/book_lines")
    # page 1 is replaced, page 70 is now without lines, book B isn't touched
    store.import_books(spark, path, new_lines(spark, ("A", 1, 0, "new")), page_files(spark, ("A", 1), ("A", 70)))
    assert stored(spark, path, "book_lines", "page_no", "text") == [(1, "new"), (1, "other")]
    assert [r[1:] for r in stored(spark, path, "book_pages", "book_id", "page_no", "raw_text") if r[0] == before[0][0][0]] in ([(1, "new"), (70, "")], [(1, "other"), (2, "")])
    now, ids = files_of(f"{path}/book_lines"), {t: b for b, t in before[0]}
    same = {f for f in was if f"book_id={ids['B']}" in f}
    assert same and all(now.get(f) == was[f] for f in same)


def test_upsert_replaces_by_key(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "p string, k int, v string")
    path = str(tmp_path / "t")
    store.upsert(rows(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")), path, ["k"], ["p"])
    store.upsert(rows(("a", 2, "new"), ("c", 9, "w")), path, ["k"], ["p"])
    got = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("p", "k", "v").collect())
    assert got() == [("a", 1, "x"), ("a", 2, "new"), ("b", 1, "z"), ("c", 9, "w")]
    store.upsert(rows(), path, ["k"], ["p"], replaced=rows(("b", 1, None), ("a", 1, None)))
    assert got() == [("a", 2, "new"), ("c", 9, "w")]


def events(spark, *rows):
    return spark.createDataFrame([(k, n, dt.datetime(2024, 1, 1, h), h) for k, n, h in rows], "student_key string, name string, ts timestamp, event_id long")


def test_students_are_made_once(spark, tmp_path):
    path = str(tmp_path)
    for _ in range(2):
        store.ensure_students(spark, path, events(spark, ("a", "Ann", 1), ("a", None, 2), ("b", None, 3)))
    assert stored(spark, path, "students", "student_key", "name", F.hour("created_at")) == [("a", "Ann", 1), ("b", "b", 3)]
    store.ensure_students(spark, path, events(spark, ("a", "Anna", 8), ("b", None, 9), ("c", "Cy", 9)))
    assert stored(spark, path, "students", "student_key", "name", F.hour("created_at")) == [("a", "Anna", 1), ("b", "b", 3), ("c", "Cy", 9)]
    assert stored(spark, path, "student_memory", "student_key", F.hour("created_at")) == [("a", 1), ("b", 3), ("c", 9)]


@pytest.mark.parametrize("every", [1, 3, 100])
def test_sink_of_updates(spark, tmp_path, every):
    sink = UpsertSink(str(tmp_path / "s"), ["k"], "k string, v long", every)
    want = {}
    for n in range(8):
        rows = [(f"k{i}", 10 * n + i) for i in range(n % 4 + 1)]
        want |= dict(rows)
        for _ in range(2):  # each batch is repeated
            sink.put(spark.createDataFrame(rows, "k string, v long"), n)
        assert {r.k: r.v for r in sink.read(spark).collect()} == want
    assert len(store.names(spark, sink.path)) <= every + 4
    # a merge that broke off has no mark of success and doesn't count
    spark.createDataFrame([("k0", -1)], "k string, v long").write.parquet(f"{sink.path}/base=99")
    store.delete(spark, f"{sink.path}/base=99/_SUCCESS")
    assert {r.k: r.v for r in sink.read(spark).collect()} == want


def intents(spark, rows):
    made = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, k, None if a is None else float(a), "explain" if k == "use" else None, i) for i, (s, k, a) in enumerate(rows)]
    return spark.createDataFrame(made, "student_key string, ts timestamp, event_id long, kind string, amount double, tool_used string, lesson_no int")


ROWS = [("s", "use", 0), ("t", "award", 40), ("s", "award", 40), ("t", "admin", None), ("s", "redeem", 3), ("u", "admin", 5), ("t", "use", 0), ("s", "admin", 2), ("s", "award", None), ("u", "use", 0), ("s", "redeem", 9), ("t", "odd", 1)]


@pytest.mark.parametrize("cuts", [(12,), (1, 5, 12), (6, 7, 12)])
def test_wallet_tables_of_a_stream(spark, tmp_path, cuts):
    every = intents(spark, ROWS)
    students = spark.createDataFrame([("s",), ("t",)], "student_key string")
    had = spark.createDataFrame([("t", 1, 7, 30, 4)], "student_key string, credits long, points long, lifetime long, used long")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        begin = 0
        for end in cuts:
            every.where(f"event_id >= {begin} AND event_id < {end}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            begin = end
            stream = spark.readStream.schema(every.schema).parquet(str(tmp_path / "in"))
            S.wallet_tables(S.wallet_stream(stream, students, had), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    steps = L.wallet_steps(every, students, had).persist()
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    out = str(tmp_path / "out")
    for name, want in (("ledger", L.ledger_rows(steps)), ("usage", L.usage_rows(steps))):
        assert rows(spark.read.parquet(f"{out}/{name}").select(*want.columns)) == rows(want)
    want = L.run_wallets(steps).select("student_key", *L.BALANCES)
    assert rows(S.wallet_sink(f"{out}/wallets").read(spark).select(*want.columns)) == rows(want)
    assert tuple(want.where("student_key = 't'").first())[1:] == (50, 47, 70, 5)  # 1 credit and 7 points before


def test_merge_of_students_keeps_what_is_stored(spark):
    students = spark.createDataFrame([("a", "Old", "a@x", dt.datetime(2020, 1, 1))], "student_key string, name string, email string, created_at timestamp")
    memories = spark.createDataFrame([("a", "[1]", dt.datetime(2020, 1, 1))], "student_key string, opened_lessons_json string, created_at timestamp")
    s, m = G.merge_students(events(spark, ("a", None, 1), ("b", "Bo", 2)), students, memories)
    assert sorted((r.student_key, r.name, r.email) for r in s.collect()) == [("a", "Old", "a@x"), ("b", "Bo", None)]
    assert sorted((r.student_key, r.opened_lessons_json) for r in m.collect()) == [("a", "[1]"), ("b", None)]


def test_folds_need_no_copy_of_the_package_on_executors(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from lessonlake.operators import ledger as L
rows = spark.sql("SELECT 's' AS student_key, timestamp'2024-01-01' AS ts, 1L AS event_id, 'use' AS kind, 0D AS amount")
print("CREDITS", L.run_wallets(L.wallet_steps(rows)).first().credits)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "CREDITS 4" in done.stdout, done.stderr[-1500:]


def test_page_files_are_read_once(spark, tmp_path):
    for folder in ("lines", "words"):
        (tmp_path / folder).mkdir()
    put = lambda name, body: (tmp_path / name).write_text(body)
    put("lines/page-1-lines.json", '[{"text": "First line", "lineNumber": 1, "bbox": {"x": 1, "y": 1, "width": 5, "height": 5}}]')
    put("lines/page-2-lines.json", "{}")
    put("words/page-1.json", '[{"text": "Two", "x": 9, "y": 1, "width": 5, "height": 5}, {"text": "One", "x": 1, "y": 3, "width": 5, "height": 5}]')
    out = str(tmp_path / "out")

    def run():
        seen = []
        for s in (P.import_stream(spark, str(tmp_path / "lines"), out, "A book", str(tmp_path / "c1")), P.word_stream(spark, str(tmp_path / "words"), f"{out}/words", str(tmp_path / "c2"))):
            q = s.trigger(availableNow=True).start()
            q.awaitTermination()
            seen.append(sum(p.numInputRows for p in q.recentProgress))
        return seen

    assert run() == [2, 1]
    assert stored(spark, out, "book_lines", "page_no", "text") == [(1, "First line")]
    assert stored(spark, out, "rejects", "page_no", "error") == [(2, "not a JSON array")]
    assert stored(spark, out, "words/page_lines", "page_no", "text") == [(1, "One Two")]
    put("lines/page-3-lines.json", '[{"text": "Third page"}]')
    assert run() == [1, 0]
    assert stored(spark, out, "book_lines", "page_no", "text") == [(1, "First line"), (3, "Third page")]
    assert len(stored(spark, out, "books", "book_id")) == 1


def test_page_documents_replace_their_pages(spark, tmp_path):
    page = lambda *r: spark.createDataFrame([(b, n, [{"id": x}] if x else []) for b, n, x in r], "bookId string, pageNumber int, lines array<struct<id:string>>")
    path = str(tmp_path / "pages")
    readers.write_ocr_pages(page(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")), path)
    readers.write_ocr_pages(page(("a", 2, "new"), ("a", 2, ""), ("a", 3, "w")), path)
    rows = spark.read.json(path).select("bookId", "pageNumber", F.col("lines")[0]["id"]).collect()
    assert sorted(map(tuple, rows)) == [("a", 1, "x"), ("a", 2, "new"), ("a", 3, "w"), ("b", 1, "z")]


def test_clustered_tables_need_no_shuffle_by_student(spark, tmp_path):
    kinds = ("lesson_opened", "line_selected", "ai_interaction", "quiz_submitted", "game_finished")
    rows = spark.range(4000).select(
        F.concat(F.lit("s"), F.col("id") % 37).alias("student_key"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % 5 + 1).cast("int")).alias("activity_type"), F.timestamp_seconds(F.col("id") * 5000).alias("ts"),
        F.col("id").alias("event_id"), F.col("id").cast("int").alias("k"), (F.col("id") % 33 + 1).cast("int").alias("lesson_no"), (F.col("id") % 11).alias("score"), F.lit(10).alias("total"), F.lit(2).alias("minutes"),
    ).withColumn("date_key", F.date_format("ts", "yyyy-MM-dd"))
    areas = rows.where("activity_type = 'quiz_submitted'").select("student_key", "event_id", "ts", F.when(F.col("k") % 2 == 0, "Grammar").otherwise("General").alias("area"))
    tables.save_clustered(rows, "clustered_activity", "student_key", 4)
    tables.save_clustered(areas, "clustered_areas", "student_key", 4)
    try:
        def both(a, r):
            daily = G.daily_study(G.activity_counters(a))
            return G.student_summary(a.select("student_key").distinct(), daily, a), G.research_summary(a, r)

        for plain, near in zip(both(rows, areas), both(spark.table("clustered_activity"), spark.table("clustered_areas"))):
            plan = near._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
            assert sorted(map(str, near.collect())) == sorted(map(str, plain.collect()))
    finally:
        for t in ("clustered_activity", "clustered_areas"):
            spark.sql(f"DROP TABLE {t}")
