"""Grading of submissions, quizzes and games."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonlake.functions import text as T
from lessonlake.operators.ordered import fold

MAX_QUESTIONS = 1000
#: Points of a right match by difficulty (fixed values).
BASE = {"easy": 80, "medium": 100, "hard": 130}


def grade_answer_key(submissions: DataFrame, key: DataFrame) -> DataFrame:
    """submissions(submission_id, answers map), key(id, answer, mark): a missing answer is ''. The key is one exam's, of at most
    MAX_QUESTIONS, and goes to every submission as an array; a longer one is an error."""
    questions = [(r.id, r.answer, r.mark) for r in key.select("id", "answer", "mark").limit(MAX_QUESTIONS + 1).collect()]
    if len(questions) > MAX_QUESTIONS:
        raise ValueError(f"an answer key of more than {MAX_QUESTIONS} questions")
    exam = F.from_json(F.lit(json.dumps([{"id": i, "answer": a, "mark": m} for i, a, m in questions])), "array<struct<id:string,answer:string,mark:bigint>>")
    right = F.filter("exam", lambda q: F.coalesce(F.try_element_at("answers", q["id"]), F.lit("")) == q["answer"])
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, q: t + q["mark"])
    out = submissions.withColumn("exam", exam).select("submission_id", total(right).alias("score"), total(F.col("exam")).alias("total"))
    return out.withColumn("accuracy", T.percent(F.col("score"), F.col("total")))


def public_questions(key: DataFrame) -> DataFrame:
    """key(id, type, question, options, answer, mark) -> the questions without their answers, each with the number and marks of all."""
    totals = key.agg(F.count("*").alias("total_questions"), F.coalesce(F.sum("mark"), F.lit(0)).cast("long").alias("total_marks"))
    return key.select("id", "type", "question", "options", "mark").join(F.broadcast(totals))  # totals is one row


def grade_by_index(items: DataFrame) -> DataFrame:
    """items(attempt_id, chosen, correct_index)"""
    out = items.groupBy("attempt_id").agg(F.count_if(F.coalesce(F.col("chosen") == F.col("correct_index"), F.lit(False))).alias("score"), F.count("*").alias("total"))
    return out.withColumn("pct", T.percent(F.col("score"), F.col("total")))


def attempt_detail(items: DataFrame) -> DataFrame:
    """items(attempt_id, pos, chosen, answer, area): wrong positions and the areas of wrong answers in first-seen order."""
    wrong = ~F.coalesce(F.col("chosen") == F.col("answer"), F.lit(False))
    found = F.array_sort(F.collect_list(F.when(wrong, F.struct("pos", F.coalesce("area", F.lit("General")).alias("area")))))
    return items.groupBy("attempt_id").agg(found.alias("w")).select("attempt_id", F.transform("w", lambda s: s["pos"]).alias("wrong"), F.array_distinct(F.transform("w", lambda s: s["area"])).alias("areas"))


def grade_sentence(given: Column, right: Column) -> Column:
    return F.when(T.normalize_sentence(given) == T.normalize_sentence(right), 10).otherwise(0)


def grade_detective(given: Column, right: Column) -> Column:
    return F.when(given == right, 10).otherwise(0)


def replay_match(moves: DataFrame, order: list[str]) -> DataFrame:
    """moves(session_id, kind, difficulty, seconds, n_pairs, and the columns of order): a fold, as scores stop at 0.

    right: base + min(10 a streak, 50) - 15 after a hint on this pair; wrong -10; hint -5, once a pair; skip -5, not on the
    last pair; the last right match adds 120 - seconds, if positive, and ends the game.
    """
    fields = ("score", "streak", "best", "moves", "mistakes", "hints", "skips", "done")

    def step(g: dict, row: tuple) -> list[tuple]:
        _, kind, base, seconds, g["n_pairs"] = row
        if g["done"] >= g["n_pairs"]:
            return []
        if kind == "correct":
            g["streak"] += 1
            gain = base + min(10 * g["streak"], 50) - 15 * g["hinted"]
            g["done"] += 1
            g["moves"] += 1
            g["hinted"] = 0
        elif kind == "wrong":
            g["streak"], gain = 0, -10
            g["moves"] += 1
            g["mistakes"] += 1
        elif kind == "hint" and not g["hinted"]:
            gain = -5
            g["hints"] += 1
            g["hinted"] = 1
        elif kind == "skip" and g["n_pairs"] - g["done"] > 1:
            g["streak"], gain, g["hinted"] = 0, -5, 0
            g["skips"] += 1
        else:
            return []
        g["best"] = max(g["best"], g["streak"])
        g["score"] = max(g["score"] + gain, 0)
        if g["done"] == g["n_pairs"]:
            g["score"] += max(120 - (seconds or 0), 0)
        return []

    base = F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv])[T.known_difficulty(F.col("difficulty"))]
    start = lambda: dict.fromkeys((*fields, "hinted", "n_pairs"), 0)
    schema = "session_id string, n_pairs int, " + ", ".join(f"{f} long" for f in fields)
    last = fold(moves.withColumn("base", base), "session_id", order, ["kind", "base", "seconds", "n_pairs"], start, step, schema, lambda g, key: [(key, g["n_pairs"], *(g[f] for f in fields))])
    return last.select("session_id", *fields, T.percent(F.col("done"), F.col("n_pairs")).alias("progress"))
