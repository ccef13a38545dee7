"""Edge rows on invented data."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lessonlake.functions import text as T
from lessonlake.operators import activity as G
from lessonlake.operators import context as C
from lessonlake.operators import grading as R
from lessonlake.operators import items as I
from lessonlake.operators import ledger as L
from lessonlake.operators import ocr as O
from lessonlake.operators import turns as U
from lessonlake.sources import readers, tables
from lessonlake.streaming import activity as S


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


def test_clean_line_strips_one_label_a_call(spark):
    assert one(spark, T.clean_line, "1. A. Hello") == "A. Hello"
    assert one(spark, lambda c: T.clean_line(T.clean_line(c)), "1. A. Hello") == "Hello"
    assert one(spark, T.clean_line, "3.5 kg") == "5 kg"
    assert one(spark, T.clean_line, "four ...") == "four..."


def test_book_text_and_day_key(spark):
    assert one(spark, T.clean_book_text, "12\nA. One line.\n• Two\n") == "One line. Two"
    keys = spark.createDataFrame([(dt.datetime(2024, 1, 1, 17, 59, 59),), (dt.datetime(2024, 1, 1, 18, 0),)], "t timestamp").select(T.day_key(F.col("t"))).collect()
    assert [r[0] for r in keys] == ["2024-01-01", "2024-01-02"]


def test_fixed_anchor(spark):
    rows = [(1, i, f"word{i}", i, y, 5, 5) for i, y in enumerate((1, 5, 30, 33, 49, 52))]
    got = O.cluster_lines_by_y(spark.createDataFrame(rows, "page_no long, pos int, text string, x int, y int, width int, height int")).orderBy("line_number").collect()
    assert [r.text for r in got] == ["word0 word1", "word2 word3 word4", "word5"]


def test_overlaps_are_judged_against_kept_lines(spark):
    rows = [(1, 0, "a long line of text and more", 0, 0, 20), (1, 1, "a long line of text", 0, 5, 20), (1, 2, "long line of text", 0, 24, 5), (1, 3, "a long line of text", 0, 400, 20)]
    got = O.drop_overlaps(spark.createDataFrame(rows, "page_no int, pos int, text string, x int, y int, height int"))
    assert sorted(r.pos for r in got.collect()) == [0, 2, 3]


def test_quiz_options_keep_first_place_and_last_spelling(spark):
    q = {"question": "Which animal says meow?", "options": ["Cat one", "cat one", "Dog", "Pen", "Sun"], "correctIndex": "7", "answer": "dog"}
    got = I.validate_quiz(spark.createDataFrame([("r", "```json\n" + json.dumps([q, {**q, "options": ["Dog", "Pen", "Sun"]}]) + "\n```")], "request_id string, body string")).collect()
    assert [(r.options, r.correct_index) for r in got] == [(["cat one", "Dog", "Pen", "Sun"], 1)]


def test_pairs_are_greedy(spark):
    pairs = [("left one", "right one"), ("left two", "right one"), ("left two", "right two")]
    body = json.dumps({"pairs": [{"left": a, "right": b} for a, b in pairs]})
    got = I.validate_pairs(spark.createDataFrame([("r", body)], "request_id string, body string")).orderBy("position").collect()
    assert [r.left for r in got] == ["left one", "left two"] and [r.right for r in got] == ["right one", "right two"]


def intents(spark, *rows):
    return spark.createDataFrame([("s", dt.datetime(2024, 1, 1), i, k, None if a is None else float(a)) for i, (k, a) in enumerate(rows)], "student_key string, ts timestamp, event_id long, kind string, amount double")


def test_wallets(spark):
    wallet = lambda *rows, **more: L.run_wallets(L.wallet_steps(intents(spark, *rows), **more)).first()
    w = wallet(*[("use", 0)] * 6)
    assert (w.credits, w.used, w.rejected) == (0, 5, 1)
    w = wallet(("award", 2.9), ("award", -3), ("award", 25), ("redeem", 2), ("redeem", 0))
    assert (w.credits, w.points, w.lifetime, w.rejected) == (7, 7, 27, 1)
    assert wallet(("admin", 50)).credits == 50 and wallet(("admin", None), ("use", None), ("award", None)).credits == 49
    steps = L.wallet_steps(intents(spark, ("use", 0), ("award", 40), ("redeem", 3), ("admin", 2), ("use", 0), ("odd", 1)))
    w = L.run_wallets(steps)
    sums = L.wallet_from_ledger(L.ledger_rows(steps), w.select("student_key", "opened_with")).first()
    assert (sums.credits, sums.points, sums.lifetime, sums.used) == tuple(w.select("credits", "points", "lifetime", "used").first())
    assert L.reconciled(steps).first().equal and steps.where("reason = 'unknown kind'").count() == 1
    nobody = spark.createDataFrame([("t",)], "student_key string")
    assert wallet(("admin", 9), ("use", 0), students=nobody).rejected == 1 and wallet(("admin", 9), students=nobody.union(spark.sql("SELECT 's'"))).credits == 9
    view = L.wallet_view(L.ledger_rows(steps)).orderBy("rank").collect()
    assert [r.type for r in view][:2] == ["USE_AI_CREDIT", "ADMIN_ADD_CREDITS"] and [r.reason for r in view][1:3] == ["Added 2 AI Teacher credits manually for demo.", "Redeemed 30 learning points for 3 AI credit(s)."] and view[0].point_rules.points_per_credit == 10


def test_wallets_as_a_stream(spark, tmp_path):
    rows = [("use", 0), ("award", 40), ("redeem", 3), ("use", 0), ("admin", 2), ("award", None), ("use", 0), ("redeem", 9)]
    every = intents(spark, *rows).unionByName(intents(spark, *rows[::-1]).withColumn("student_key", F.lit("t"))).withColumn("ts", F.timestamp_seconds("event_id"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for half in ("event_id < 4", "event_id >= 4"):
            every.where(half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            found = []
            S.wallet_stream(spark.readStream.schema(every.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n: found.extend(L.run_wallets(b).collect())).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = L.run_wallets(L.wallet_steps(every)).collect()
    got = {r.student_key: r for r in found}
    assert {r.student_key: tuple(r[c] for c in L.BALANCES) for r in want} == {k: tuple(r[c] for c in L.BALANCES) for k, r in got.items()} and len(got) == 2


def test_match_replay(spark):
    # the skip comes on the last pair, so it does nothing and the streak goes on
    moves = ["wrong", "hint", "hint", "correct", "skip", "correct"]
    rows = [("s", i, k, "easy", 119, 2) for i, k in enumerate(moves)]
    got = R.replay_match(spark.createDataFrame(rows, "session_id string, seq int, kind string, difficulty string, seconds int, n_pairs int"), ["seq"]).first()
    assert (got.score, got.hints, got.skips, got.mistakes, got.done, got.progress) == (75 + 100 + 1, 1, 0, 1, 2, 100)


def test_summary_takes_thirty_days(spark):
    rows = [("s", f"2024-01-{i:02d}", i, "lesson_opened", 0, 0, 1) for i in range(1, 32)]
    a = spark.createDataFrame(rows, "student_key string, date_key string, event_id long, activity_type string, score int, total int, minutes int").withColumn("ts", F.current_timestamp())
    s = G.student_summary(a.select("student_key").distinct(), G.daily_study(G.activity_counters(a)), a).first()
    assert (s.days, s.lessons_opened, s.minutes) == (30, 30, 30)


def test_readers_and_streams(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "page-3-lines.json").write_text('﻿[{"text":"b"},{"text":"a"}]', encoding="utf-8")
    (tmp_path / "pages" / "page-4-lines.json").write_text('{"no":"array"}')
    (tmp_path / "pages" / "other.json").write_text("[]")
    lines, bad = readers.read_line_files(spark, str(tmp_path / "pages"))
    assert [(r.page_no, r.pos, r.text) for r in lines.orderBy("pos").collect()] == [(3, 0, "b"), (3, 1, "a")]
    assert [r.file_name for r in bad.collect()] == ["page-4-lines.json"]
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text('{"activityType":"quiz_submitted","score":"7","total":10,"ts":"2024-01-01T00:00:00Z","event_id":%d}\n{"studentId":" x ","activityType":"odd","ts":"2024-01-01T20:00:00Z","event_id":9}\n' % i)
    stream = readers.read_activity(spark, str(tmp_path / "in"), stream=True)
    S.daily_study_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = S.daily_sink(str(tmp_path / "out")).read(spark).select("student_key", "date_key", *G.COUNTERS).orderBy("student_key").collect()
    want = G.daily_study(G.activity_counters(readers.read_activity(spark, str(tmp_path / "in")))).orderBy("student_key").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[0].student_key == "demo-student" and got[0].quiz_score == 14


def test_page_files(spark, tmp_path):
    """Pages, word boxes and lessons of both variants, written and read again."""
    folder = tmp_path / "pages"
    folder.mkdir()
    page = {"bookId": "b", "pageNumber": 6, "source": "tesseract", "lines": [{"id": "page-006-line-001", "lineNumber": 1, "text": "Grüße", "bbox": {"x": 1, "y": 2, "width": 3, "height": 4}, "aiReady": True}], "aiReadyLines": [], "rawText": "Grüße"}
    (folder / "page-006.json").write_text("\ufeff" + json.dumps(page), encoding="utf-8")
    (folder / "page-000.json").write_text(json.dumps({**page, "pageNumber": 0}))
    pages = readers.read_ocr_pages(spark, str(folder))
    assert [(r.pageNumber, r.lines[0].text, r.lines[0].bbox.height) for r in pages.collect()] == [(6, "Grüße", 4)]
    readers.write_ocr_pages(pages.union(pages.withColumn("lines", F.slice("lines", 1, 0))), str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out" / "bookId=b").iterdir() if p.suffix == ".json"]
    assert [json.loads(x)["lines"][0]["text"] for p in files for x in p.read_text(encoding="utf-8").splitlines()] == ["Grüße"]
    (tmp_path / "words").mkdir()
    (tmp_path / "words" / "page-18.json").write_text(json.dumps([{"text": w, "x": 9 - i, "y": 1, "width": 5, "height": 5, "confidence": c} for i, (w, c) in enumerate((("b", 91), ("a", "n/a"), ("c", -1)))]))
    assert [(r.pos, r.text, r.confidence) for r in readers.read_word_boxes(spark, str(tmp_path / "words")).orderBy("pos").collect()] == [(0, "b", "91"), (1, "a", "n/a"), (2, "c", "-1")]
    (tmp_path / "lessons").mkdir()
    (tmp_path / "lessons" / "lesson-01.json").write_text(json.dumps({"lessonNo": 1, "title": "One", "lessonTitle": "One", "lines": [{"id": "x", "lineNumber": 1, "text": "t"}], "rawText": "t"}))
    (tmp_path / "lessons" / "lesson-07.json").write_text(json.dumps({"lessonNo": 7, "title": "Seven", "pages": [{"pdfPage": 24, "rawLines": ["r"]}], "aiReadyLines": [{"id": "a", "text": "r"}]}))
    (tmp_path / "lessons" / "lesson-99.json").write_text(json.dumps({"lessonNo": 99}))
    got = {r.lessonNo: r for r in readers.read_lessons(spark, str(tmp_path / "lessons")).collect()}
    assert set(got) == {1, 7} and got[7].lessonTitle == "Seven" and got[7].lines == [] and got[7].rawText == "" and got[1].pages == [] and got[7].pages[0].rawLines == ["r"]


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("s", 3, "opened", 1)], "student_key string, lesson_no int, event_type string, other int")
    tables.save_table(rows, str(tmp_path), "research_events")
    tables.save_table(rows.withColumn("score", F.lit(4)), str(tmp_path), "research_events", "append")
    got = tables.load_table(spark, str(tmp_path), "research_events")
    assert got.columns == [f.split()[0] for f in tables.SCHEMAS["research_events"].split(", ")] and sorted(map(str, (r.score for r in got.collect()))) == ["4", "None"]
    rows.write.parquet(str(tmp_path / "games" / "game_attempts"))
    assert tables.load_table(spark, str(tmp_path / "games"), "game_attempts").first().game_type is None and len(tables.SCHEMAS) == 13


def test_prompt_temperatures(spark):
    rows = [(f"{k}-{v}", k, v) for k in ("tutor", "help", "quiz", "match") for v in ("easy", "medium", "hard")]
    asked = spark.createDataFrame(rows, "request_id string, kind string, level string").select("*", *[F.lit(None).cast("string").alias(c) for c in ("title", "line", "context", "tool", "question")], F.lit(None).cast("struct<a:int>").alias("memory"))
    got = {r.request_id: r for r in C.build_prompts(asked).collect()}
    warmth = {k: [got[f"{k}-{v}"].temperature for v in ("easy", "medium", "hard")] for k in ("tutor", "help", "quiz", "match")}
    assert warmth == {"tutor": [0.3] * 3, "help": [0.2] * 3, "quiz": [0.35, 0.35, 0.55], "match": [0.3, 0.3, 0.5]}
    assert "null" not in got["tutor-easy"].prompt and "Memory: {}" in got["tutor-easy"].prompt


def test_top_up_of_quiz_and_pairs(spark):
    valid = spark.createDataFrame([("r", 1, "One?")], "request_id string, position int, item string")
    spare = spark.createDataFrame([("r", i, x) for i, x in enumerate(("one?", "Two?", "two?", "Three?"))] + [("s", 0, "x"), ("s", 1, "x")], "request_id string, position int, item string")
    items = lambda **more: [(r.request_id, r.item) for r in I.top_up(valid, spare, "item", 3, 5, **more).orderBy("request_id", "position").collect()]
    assert items() == [("r", "One?"), ("r", "Two?"), ("r", "two?"), ("r", "Three?"), ("s", "x"), ("s", "x")]
    assert items(distinct=True, need=2) == [("r", "One?"), ("r", "Two?"), ("r", "Three?")]


def test_shuffles_are_permutations(spark):
    rows = spark.range(200).select("id", F.transform(F.sequence(F.lit(1), (F.col("id") % 9 + 1).cast("int")), lambda x: x % 4).alias("a"))
    for r in rows.select("a", T.seeded_shuffle(F.col("a"), F.col("id")).alias("s"), T.pick(F.col("a"), 3, F.col("id")).alias("p"), T.seeded_shuffle(F.col("a"), F.col("id")).alias("again")).collect():
        assert sorted(r.s) == sorted(r.a) and r.again == r.s and r.p == r.s[:3]
    orders = {tuple(r[0]) for r in spark.range(300).select(T.seeded_shuffle(F.array(*map(F.lit, range(3))), F.col("id"))).collect()}
    assert len(orders) == 6


def test_shuffled_items(spark):
    text = "\n".join(f"This is the long line number {i} of the lesson text." for i in range(7)) + "\nshort"
    quiz = I.lesson_quiz(spark.createDataFrame([(1, text), (2, "one line that is longer than twenty-five")], "lesson_no int, text string")).collect()
    assert len(quiz) == 5 and len({r.right for r in quiz}) == 5 and all(len(set(r.options)) == 4 and r.right in r.options and r.area == "Grammar" for r in quiz)
    pairs = spark.createDataFrame([("r", i, f"l{i}", f"r{i}") for i in range(6)] + [("one", 1, "l", "r")], "request_id string, position int, left string, right string")
    for r in I.match_choices(pairs).collect():
        assert f"r{r.left[1:]}" in r.choices and len(set(r.choices)) == len(r.choices) == (1 if r.request_id == "one" else 4)
    assert sorted(one(spark, lambda c: I.word_bank(c, F.lit(3)), 'He said, "go on".')) == ["He", "go", "on", "said"]


def test_coerced_items(spark):
    bodies = [("a", '{"quiz": [{"options": ["x", "y"], "correctAns": "x"}, {"options": [], "correctAnswer": "x"}, {"id": 7, "question": "Q", "options": ["z"], "correctAnswer": "z", "correctAns": "no"}]}'), ("b", '{"questions": []}'), ("c", "no"), ("d", None)]
    got = I.coerce_quiz_items(spark.createDataFrame(bodies, "request_id string, body string")).orderBy("position").collect()
    assert [(r.request_id, r.item_id, r.question, r.correct_answer) for r in got] == [("a", "1", "Choose the best answer.", "x"), ("a", "7", "Q", "z")]


def test_answer_key_is_bounded(spark):
    key = spark.range(R.MAX_QUESTIONS + 1).select(F.col("id").cast("string"), F.lit("a").alias("answer"), F.lit(1).alias("mark"))
    with pytest.raises(ValueError):
        R.grade_answer_key(spark.createDataFrame([("s", {"0": "a"})], "submission_id string, answers map<string,string>"), key)
    row = R.grade_answer_key(spark.createDataFrame([("s", {"0": "a", "1": "b"})], "submission_id string, answers map<string,string>"), key.where("id < 4")).first()
    assert (row.score, row.total, row.accuracy) == (1, 4, 25)


def test_tutor_turns(spark):
    """A request without a key, lesson or tool is rejected; the sixth has no credit left; the memory has the request itself in it."""
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    asked = [(f"q{i}", i, "s", None, i % 2 + 1, f"line {i}", "explain", None, at(10 + i)) for i in range(7)] + [("k", 20, " ", None, 1, "l", "explain", None, at(1)), ("z", 21, "s", None, 0, "l", "explain", None, at(1)), ("t", 22, None, "u", 1, "Line A", "grammar", "Why?", at(1))]
    requests = spark.createDataFrame(asked, "request_id string, event_id long, student_key string, student_id string, lesson_no int, line string, tool string, question string, ts timestamp")
    intents = spark.createDataFrame([("s", at(12), 100, "award", 10.0), ("s", at(14), 101, "redeem", 1.0)], "student_key string, ts timestamp, event_id long, kind string, amount double")
    lessons = spark.createDataFrame([(1, "First", ["line a", "line 0", "line b"])], "lesson_no int, title string, lines array<string>")
    quizzes = spark.createDataFrame([("s", 200 + i, at(5 + i)) for i in range(7)], "student_key string, event_id long, ts timestamp")
    body = json.dumps({"candidates": [{"content": {"parts": [{"text": " yes "}]}}]})
    out = U.learning_turns(requests, intents, lessons, quizzes, spark.createDataFrame([("q0", body, True), ("q1", body, False)], "request_id string, body string, ok boolean"))
    got = {r.request_id: r for r in out.collect()}
    assert len(got) == 10 and {k: r.error for k, r in got.items() if r.error} == {"k": "missing field", "z": "missing field", "q6": "no credits"}
    assert [got[f"q{i}"].credits_left for i in range(6)] == [4, 3, 2, 1, 0, 0] and got["q6"].answer is None
    assert (got["q0"].answer, got["q0"].source, got["q1"].source, got["q2"].answer) == ("yes", "model", "fallback", C.NO_TUTOR)
    assert got["q0"].context == "line a\nline 0\nline b" and got["q1"].title == "Unknown lesson" and got["t"].student_key == "u"
    m = got["q5"].memory
    assert (m.lessons, m.n_lines, m.last_lines, len(m.last_tools), m.quizzes) == ([1, 2], 6, [f"line {i}" for i in range(1, 6)], 6, [206, 205, 204, 203, 202])
    assert got["q0"].memory.quizzes == [204, 203, 202, 201, 200] and got["t"].memory.quizzes == []
    assert U.turn_chats(out).count() == U.turn_events(out).count() == 7
    assert U.turn_usage(out).count() == 7 and {r.type for r in U.turn_ledger(out).collect()} == {"USE_AI_CREDIT"} and got["q5"].memory.weak_areas == []
    areas = spark.createDataFrame([("s", 1, at(3), "Grammar"), ("s", 2, at(15), "Vocabulary"), ("s", 3, at(15), "Grammar"), ("s", 4, at(15), None)], "student_key string, event_id long, ts timestamp, area string")
    twice = intents.union(spark.createDataFrame([("s", at(50), 0, "use", 0.0)], intents.schema))  # an event_id of a request
    again = {r.request_id: r for r in U.learning_turns(requests, twice, lessons, quizzes, spark.createDataFrame([], "request_id string, body string, ok boolean"), areas).collect()}
    assert len(again) == 10 and again["q4"].memory.weak_areas == ["Grammar"] and again["q5"].memory.weak_areas == ["Grammar", "Vocabulary"] and again["t"].memory.weak_areas == []
    assert json.loads(U.turn_events(out).where("student_key = 'u'").first().metadata_json) == {"studentQuestion": "Why?", "aiCreditUsed": True}


def test_import_of_pages(spark):
    old = spark.createDataFrame([("b", 1, 1, "old"), ("b", 2, 1, "stays"), ("c", 1, 1, "other")], "book_id string, page_no int, line_number int, text string")
    new = spark.createDataFrame([(1, 0, "1.", None, None, None), (1, 1, "raw", "• Clean text", "x", False), (3, 0, "Ready here", None, "88", None), (4, 0, "gone", None, None, None)], "page_no int, pos int, text string, clean_text string, confidence string, ai_ready boolean")
    box = F.struct(*[F.when((F.col("page_no") == 4), -1.0).otherwise(2.5).alias(c) for c in ("x", "y", "width", "height")])
    lines = O.normalize_import_lines(new.select("*", *[F.lit(None).cast("double").alias(c) for c in ("x", "y", "width", "height")], box.alias("bbox"), F.lit(None).cast("int").alias("line_number")))
    pages, kept, counts = O.import_ocr(old.select("book_id", "page_no"), old, lines, "b")
    assert sorted((r.book_id, r.page_no, r.raw_text, r.ai_ready_text) for r in pages.collect() if r.raw_text) == [("b", 1, "Clean text", ""), ("b", 3, "Ready here", "Ready here")]
    assert sorted((r.book_id, r.page_no, r.line_number, r.text) for r in kept.collect()) == [("b", 1, 2, "Clean text"), ("b", 2, 1, "stays"), ("b", 3, 1, "Ready here"), ("c", 1, 1, "other")]
    assert sorted((r.page_no, r.n_lines, r.updated) for r in counts.collect()) == [(1, 1, True), (3, 1, False)]
    books = spark.createDataFrame([("x", "Known")], "book_id string, title string")
    assert O.find_or_create_book(books, "Known").count() == 1 and O.find_or_create_book(O.find_or_create_book(books, "New"), "New").count() == 2


def test_broken_files_are_error_rows(spark, tmp_path):
    page = {"bookId": "b", "pageNumber": 6, "lines": [], "aiReadyLines": []}
    for name, body in (("page-006.json", json.dumps(page)), ("page-007.json", '{"pageNumber": 7, '), ("page-008.json", "[1]"), ("page-009.json", json.dumps({**page, "pageNumber": 0})), ("page-010.json", " "), ("note.json", "x")):
        (tmp_path / name).write_text(body)
    path = str(tmp_path)
    assert [r.pageNumber for r in readers.read_ocr_pages(spark, path).collect()] == [6]
    failed = readers.unreadable_pages(spark, path)
    assert sorted((r.page_no, r.error) for r in failed.collect()) == [(7, "not a JSON object"), (8, "not a JSON object"), (9, "no page number from 1 on"), (10, "not a JSON object")]
    docs = readers.read_ocr_pages(spark, path).select(F.col("pageNumber").alias("page_no"), "lines", F.col("aiReadyLines").alias("ai_ready_lines"), "source")
    index = O.book_index(docs, "b", failed)
    assert sorted((r.page_no, r.n_lines, r.error is None) for r in index.collect()) == [(6, 0, True), (7, None, False), (8, None, False), (9, None, False), (10, None, False)]
    assert O.book_header(index, "b", "B", 1, 0, 10).first().n_failed == 4
    words = tmp_path / "words"
    words.mkdir()
    for name, body in (("page-1.json", '[{"text": "a"}]'), ("page-2.json", '{"text": "a"}'), ("page-3.json", '[{"text": '), ("page-4.json", "[]")):
        (words / name).write_text(body)
    assert [r.text for r in readers.read_word_boxes(spark, str(words)).collect()] == ["a"]
    assert sorted(r.page_no for r in readers.unreadable_word_boxes(spark, str(words)).collect()) == [2, 3]
    lessons = tmp_path / "lessons"
    lessons.mkdir()
    for name, body in (("lesson-01.json", '{"lessonNo": 1}'), ("lesson-02.json", '{"lessonNo": 34}'), ("lesson-03.json", '{"lessonNo"')):
        (lessons / name).write_text(body)
    assert [r.lessonNo for r in readers.read_lessons(spark, str(lessons)).collect()] == [1]
    assert sorted((r.lesson_no, r.error) for r in readers.unreadable_lessons(spark, str(lessons)).collect()) == [(2, "no lesson number from 1 to 33"), (3, "not a JSON object")]


def test_indexes_of_all_kinds(spark):
    options = ["alpha one", "beta two", "gamma three", "delta four"]
    kinds = [{"correctAnswerIndex": ""}, {"correctAnswerIndex": True}, {"correctAnswerIndex": 1.0}, {"correctAnswerIndex": "2"}, {"correctAnswerIndex": None, "answerIndex": 3}, {"correctAnswerIndex": "true", "answer": "gamma three"}, {"correctIndex": 1.5, "answer": "BETA two"}, {"correctIndex": {}}, {}]
    body = json.dumps([{"question": "Which one is the right answer?", "options": options, **k} for k in kinds])
    got = I.validate_quiz(spark.createDataFrame([("r", body), ("n", None), ("x", "no")], "request_id string, body string"), 20).orderBy("position").collect()
    assert [r.correct_index for r in got] == [0, 1, 1, 2, 3, 2, 1]


def test_keys_of_students_with_one_name(spark):
    rows = [(1, "Ann Lee", "a@x", 6), (2, "ann  lee!", "b@x", 6), (3, "Ann Lee", " A@X ", 6), (4, "", "c@x", 6)]
    got = G.register_students(spark.createDataFrame([(*r, None, r[0]) for r in rows], "signup_id int, name string, email string, password_length int, class_level int, ts int")).orderBy("signup_id").collect()
    assert got[0].student_key.startswith("ann-lee-") and got[1].student_key.startswith("ann-lee-") and got[0].student_key != got[1].student_key
    assert [r.reason for r in got] == [None, None, "email taken", "missing"] and got[2].student_key is None and got[0].section == ""
