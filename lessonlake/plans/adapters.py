"""The given tables as inputs of the operators, each in Spark and as a DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonlake.functions import text as T

KINDS = {"view": "lesson_opened", "click": "line_selected", "signup": "ai_interaction", "purchase": "quiz_submitted", "error": "game_finished"}
INTENTS = {"purchase": "award", "view": "use", "click": "redeem", "signup": "admin", "error": "use"}
MOVES = {"view": "correct", "click": "wrong", "signup": "hint", "purchase": "skip", "error": "correct"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(values: dict[str, str]):
    out = None
    for k, v in values.items():
        out = F.when(F.col("event_type") == k, v) if out is None else out.when(F.col("event_type") == k, v)
    return out


def mapped_events(spark: SparkSession, sf_dir: str, values: dict[str, str]) -> DataFrame:
    """events with what its kind stands for, its student and the number in its properties."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", F.concat(F.lit("student-"), F.col("user_id")).alias("student_key"), _mapped(values).alias("kind"), k.alias("k"), T.day_key(F.col("ts")).alias("date_key"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return mapped_events(spark, sf_dir, KINDS).select(
        "student_key", F.col("kind").alias("activity_type"), "ts", "event_id", "k",
        (k % 33 + 1).alias("lesson_no"), (k % 11).alias("score"), F.lit(10).alias("total"), (F.floor("value") % 60).cast("long").alias("minutes"), "date_key",
    )


def _case(values: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


ACTIVITY = f"""activity AS (SELECT 'student-' || user_id AS student_key, {_case(KINDS)} AS activity_type, ts, event_id, k, k % 33 + 1 AS lesson_no, k % 11 AS score, 10 AS total,
  CAST(floor(value) AS BIGINT) % 60 AS minutes, strftime(ts + INTERVAL 6 HOUR, '%Y-%m-%d') AS date_key
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An admin's amount is missing now and then; uses say what they are for."""
    kind, k = F.col("kind"), F.col("k")
    amount = F.when(kind == "award", k % 20).when(kind == "redeem", k % 3).when((kind == "admin") & (k % 7 != 0), k % 5)
    text = lambda x: F.concat(F.lit(x), k.cast("string"))
    return mapped_events(spark, sf_dir, INTENTS).select(
        "student_key", "event_id", "ts", "kind", amount.cast("double").alias("amount"), F.when(kind == "award", text("Quiz ")).alias("note"), (k % 33 + 1).cast("int").alias("lesson_no"),
        F.when((kind == "use") & (k % 3 != 0), text("Line ")).alias("selected_line"), F.when((kind == "use") & (k % 2 == 0), text("Why ")).alias("question"), F.when((kind == "use") & (k % 5 != 0), "explain").alias("tool_used"),
    )


INTENT_ROWS = f"""intents AS (SELECT 'student-' || user_id AS student_key, event_id, ts, kind, CASE kind WHEN 'award' THEN k % 20 WHEN 'redeem' THEN k % 3 WHEN 'admin' THEN CASE WHEN k % 7 <> 0 THEN k % 5 END END AS amount, CASE WHEN kind = 'award' THEN 'Quiz ' || k END AS note, k % 33 + 1 AS lesson_no,
  CASE WHEN kind = 'use' AND k % 3 <> 0 THEN 'Line ' || k END AS selected_line, CASE WHEN kind = 'use' AND k % 2 = 0 THEN 'Why ' || k END AS question, CASE WHEN kind = 'use' AND k % 5 <> 0 THEN 'explain' END AS tool_used
  FROM (SELECT *, {_case(INTENTS)} AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))


DOC_LINES = """doc_lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)"""


def _split() -> Column:
    return F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " ")


def _word(page: Column, i: Column, text: Column) -> list[Column]:
    n = F.length(text)
    return [
        i.alias("pos"), text.alias("text"), (i % 12 * 90).alias("x"), (F.floor(i / 12) * 32 + (i * 7) % 9).cast("int").alias("y"), (n * 8).alias("width"), (n % 5 + 18).alias("height"),
        (F.lit(30) + (i * 37 + page * 13) % 70).cast("int").alias("confidence"), F.floor(i / 120).cast("int").alias("block_no"), F.floor(i / 60).cast("int").alias("par_no"), F.floor(i / 12).cast("int").alias("line_no"),
    ]


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of recognised words for each document, a row a word."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(_split()).alias("i", "text")).where("text <> ''")  # a column of words would be split once more, for a filter on its size
    return w.select(F.col("doc_id").alias("page_no"), *_word(F.col("doc_id"), F.col("i"), F.col("text")))


def word_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words, a row a page."""
    word = lambda text, i: F.struct(*_word(F.col("doc_id"), i, text))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_no"), F.transform(F.filter(_split(), lambda x: x != ""), word).alias("words"))


WORDS = r"""split_docs AS (SELECT doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') AS w FROM documents),
exploded AS (SELECT doc_id, unnest(w) AS text, unnest(range(len(w))) AS i FROM split_docs),
words AS (SELECT doc_id AS page_no, i AS pos, text, i % 12 * 90 AS x, i // 12 * 32 + (i * 7) % 9 AS y, length(text) * 8 AS width, 18 + length(text) % 5 AS height,
  30 + (i * 37 + doc_id * 13) % 70 AS confidence, i // 120 AS block_no, i // 60 AS par_no, i // 12 AS line_no FROM exploded WHERE text <> '')"""
PAGE_WIDTH, PAGE_HEIGHT = 1200, 1600
