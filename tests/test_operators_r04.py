"""Page and item operators: steps that must not be computed again, or moved, for each row."""

import json
import random
import re

from pyspark.sql import functions as F

from lessonlake.functions import text as T
from lessonlake.operators import context as C
from lessonlake.operators import items as I
from lessonlake.operators import ocr as O
from lessonlake.plans import adapters as A


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_are_judged_once_and_until_enough_are_valid(spark):
    """The plan of a filter over inlined options had their cleaning chain some twenty times."""
    q = lambda i, **more: {"question": f"Which animal is number {i}?", "options": ["Cat", "Dog", "Pen", "Sun"], "correctIndex": i % 4} | more
    body = json.dumps([q(0), q(1, options=["Cat"]), None, q(2, correctIndex=9), q(3, question="Why?"), q(4, correctIndex=9, answer="sun"), *map(q, range(5, 9))])
    df = I.validate_quiz(spark.createDataFrame([("r", body), ("s", None), ("t", "{")], "request_id string, body string"))
    assert [(r.request_id, r.position, r.question[-2:], r.correct_index) for r in df.orderBy("position").collect()] == [("r", 1, "0?", 0), ("r", 2, "4?", 3), ("r", 3, "5?", 1), ("r", 4, "6?", 2), ("r", 5, "7?", 3)]
    assert plan_of(df).count("get_json_object") <= 6


def test_widest_json(spark):
    texts = ["a [1] b [2] c", "{x} ] [ {y}", "][", "no", None, "```JSON\n[1]```", "}{", "é [ü] é ]é"]
    rows = [tuple(r) for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, c string").orderBy("i").select(T.extract_json(F.col("c")), T.extract_json(F.col("c"), "object")).collect()]
    assert [a for a, _ in rows] == ["[1] b [2]", "{x} ] [ {y}", "][", "no", "", "[1]", "}{", "[ü] é ]"]
    assert [b for _, b in rows] == ["[1] b [2]", "{x} ] [ {y}", "][", "no", "", "[1]", "}{", "[ü] é ]"]


def test_lines_of_page_rows_need_no_shuffle_and_equal_those_of_word_rows(spark):
    row = lambda p, i, text: (p, i, text, i % 4 * 50, i // 4 * 32, 40 + i, 20, 30 + i * 7 % 70, i // 8, 0, i // 4)
    texts = ["Some", "**words**", "of the", " page ", "", None, "•", "and", "more", "of", "them", "here"]
    rows = [row(p, i, x) for p in (1, 2) for i, x in enumerate(texts)] + [row(3, i, "seven") for i in range(7)]
    words = spark.createDataFrame(rows, "page_no long, pos int, text string, x int, y int, width int, height int, confidence int, block_no int, par_no int, line_no int")
    pages = words.groupBy("page_no").agg(F.collect_list(F.struct(*words.columns[1:])).alias("words")).unionByName(spark.createDataFrame([(4, [])], f"page_no long, words {dict(words.groupBy('page_no').agg(F.collect_list(F.struct(*words.columns[1:])).alias('w')).dtypes)['w']}")).localCheckpoint()
    for make in (lambda w: O.lines_from_native(w, 1200, 1600), lambda w: O.lines_from_tokens(w, 1200, 1600), O.cluster_lines_by_y):
        got = make(pages)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, make(words).collect()), key=str) != []
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert 3 not in {r.page_no for r in O.lines_from_native(pages, 1200, 1600).collect()}


def test_source_is_chosen_in_one_pass(spark):
    lines = lambda pages, n: spark.createDataFrame([(p, i) for p in pages for i in range(n)], "page_no long, pos int")
    native = lines([1], 5).union(lines([2], 4))
    got = O.choose_source(native, lines([1, 2, 3], 2))
    assert {tuple(r) for r in got.groupBy("page_no", "source").count().collect()} == {(1, "native", 5), (2, "tesseract", 2), (3, "tesseract", 2)}
    assert "Join" not in plan_of(got)


def test_lines_of_a_lesson_are_cleaned_once_and_not_for_each_request(spark):
    """The plan trimmed and lower-cased all lines of the lesson in four places for each joined row."""
    lines = {1: ["\u2003One ", "two", None, "ONE\u00a0", "\u0085İstanbul\u200b", "", "six", "seven"], 2: [], 3: None, 4: [f"line {i}" for i in range(40)]}
    asked = [(1, "one"), (1, "\tTWO\u3000"), (1, None), (1, "İSTANBUL\u200b\n"), (1, " "), (1, "seven"), (1, "no such line"), (2, "one"), (3, " one "), (4, "LINE 39"), (4, "line 4"), (5, " one "), (None, "one"), (5, None)]
    requests = spark.createDataFrame([(i, *r, "k") for i, r in enumerate(asked)], "request_id int, lesson_no int, line string, more string")
    lessons = spark.createDataFrame([(n, f"L{n}", x) for n, x in lines.items()], "lesson_no int, title string, lines array<string>")
    df = C.lesson_context(requests, lessons, ["more"])
    got = {r.request_id: (r.more, r.title, r.context, r.preview) for r in df.collect()}
    joined = lambda x: "\n".join(y for y in x if y is not None)
    key = lambda x: None if x is None else x.strip("\t\n \u0085\u00a0\u2003\u3000").lower()
    for i, (n, line) in enumerate(asked):
        if (of := lines.get(n)) is None:
            assert got[i] == ("k", "Unknown lesson", line, "")
            continue
        at = next((j for j, x in enumerate(of) if line is not None and key(x) == key(line)), None)
        assert got[i] == ("k", f"L{n}", joined(of[:5] if at is None else of[max(at - 2, 0) : at + 3]), joined(of[:25])), (n, line)
    above = plan_of(df).split("Join LeftOuter")[0]
    assert above.count("array_position(") == 1 and "transform(" not in above and "regexp_replace(" not in above


WHITE = "\\t-\\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def ocr_text(x):
    x = re.sub(f"^[•●▪◦][{WHITE}]*", "", (x or "").replace("**", ""))
    x = re.sub(rf"^[{WHITE}]*(?:\d+|[A-Da-d])[.)][{WHITE}]*\Z", "", x)
    return re.sub(f"[{WHITE}]+", " ", x).strip(" ")


def import_ready(x):
    return len(x) >= 4 and bool(re.search("[A-Za-z]", x)) and not re.search(rf"^[A-Da-d\d{WHITE}.()]+\Z", x)


def test_imported_texts_are_cleaned_once(spark):
    """The plan had the chain twice, for a filter on the text, each time with four patterns and an uncompiled function."""
    deal = random.Random(3)
    parts = ["•", "◦", "**", "*", " ", "  ", "\t", "\n", "\u00a0", "\u2003", "\u3000", "\x1f", "\u200b", "1", "12", "٣", "A", "d", "e", "E", "é", "😀", ".", ")", "(", "word"]
    texts = ["", None, "• 1.", "•• 1.", "**1**.", " \u2003٣) \n", "*** a", "a.\n", "• •", "A. b", "abcd", "abce", "(a) 1.", "1234", *("".join(deal.choices(parts, k=deal.randint(1, 7))) for _ in range(3000))]
    row = lambda i, x: (1, i, x, "9", None, 1.0, 2.0, -0.6 if i % 11 == 5 else 3.0, 4.0, None, None, "• c" if i % 5 == 4 else None)
    schema = "page_no int, pos int, text string, confidence string, ai_ready boolean, x double, y double, width double, height double, bbox struct<x: double, y: double, width: double, height: double>, line_number int, clean_text string"
    lines = spark.createDataFrame([row(i, x) for i, x in enumerate(texts)], schema)
    alone = {r.pos: (r.t, r.ready) for r in lines.select("pos", T.clean_ocr_text(F.col("text")).alias("t")).select("pos", "t", T.is_import_ai_ready(F.col("t")).alias("ready")).collect()}
    wanted = {i: (y, import_ready(y)) for i, y in enumerate(map(ocr_text, texts))}
    assert alone == wanted
    df = O.normalize_import_lines(lines)
    cleaned = {i: ("c", False) if i % 5 == 4 else wanted[i] for i in wanted if i % 11 != 5}
    assert {r.pos: (r.text, r.ai_ready) for r in df.collect()} == {i: y for i, y in cleaned.items() if y[0]}
    plan = plan_of(df)
    assert plan.count("replace(coalesce(") == 1 and plan.count("transform(") == 0


def test_words_of_a_text_are_split_once(spark, tmp_path):
    """A filter on the size of the list split the text a second time."""
    spark.createDataFrame([(1, " a \t b\u00a0c\n"), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = A.words(spark, str(tmp_path))
    assert [(r.page_no, r.pos, r.text) for r in words.orderBy("page_no", "pos").collect()] == [(1, 0, "a"), (1, 1, "b\u00a0c")]
    assert plan_of(words).count("split(") == 1
