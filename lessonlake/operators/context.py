"""Contexts, prompts and the reading of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonlake.functions import text as T

#: What a tool asks for; our own wording.
TOOLS = {"explain": "Explain the line in easy words.", "translate": "Say the line in Bangla.", "grammar": "Show the grammar of the line."}
DIFFICULTY = {"easy": "Ask about direct meaning.", "medium": "Ask about context and actions.", "hard": "Ask for inference with close answers."}


def lesson_context(requests: DataFrame, lessons: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """requests(request_id, lesson_no, line), lessons(lesson_no, title, lines array): 2 lines on each side of the first match,
    else the first 5; an unknown lesson gives the line itself. keep: other columns of requests that stay."""
    key = lambda x: F.lower(F.trim(x, F.lit(T.SPACES)))  # noqa: E731  # compiled, so that the lines of a joined row aren't copied
    known = lessons.withColumn("_keys", F.transform("lines", key))  # once a lesson, which may have many requests
    joined = requests.join(known, "lesson_no", "left").withColumn("_at", F.array_position("_keys", key(F.col("line"))))
    at = F.col("_at")
    low = F.greatest(at - 2, F.lit(1))
    near = F.when(at > 0, F.slice("lines", low.cast("int"), (at + 2 - low + 1).cast("int"))).otherwise(F.slice("lines", 1, 5))
    unknown = F.col("lines").isNull()
    return joined.select(
        "request_id", *(keep or []), F.when(unknown, "Unknown lesson").otherwise(F.col("title")).alias("title"), F.when(unknown, F.col("line")).otherwise(F.array_join(near, "\n")).alias("context"),
        F.when(unknown, "").otherwise(F.array_join(F.slice("lines", 1, 25), "\n")).alias("preview"),
    )


def page_context(ready_text: Column, ready_lines: Column, lines: Column, min_length: int = 2, max_chars: int = 7000) -> Column:
    """The first that isn't null of the ready text (an empty one counts), the ready lines and all lines, cleaned."""
    return T.clean_context(F.coalesce(ready_text, F.array_join(ready_lines, "\n"), F.array_join(lines, "\n")), min_length, max_chars)


def combined_context(selected: Column, page: Column, min_length: int = 2, max_chars: int = 7000) -> Column:
    """Null where the result is under 20 characters."""
    parts = F.filter(F.array(T.clean_context(selected, min_length, max_chars), T.clean_context(page, min_length, max_chars)), lambda x: x != "")
    return T.let(T.clean_context(F.array_join(parts, "\n"), min_length, max_chars, before=True), lambda x: F.when(F.length(x) >= 20, x))


def line_help(requests: DataFrame, helpers: DataFrame) -> DataFrame:
    """requests(request_id, line_id), helpers(line_id, helper): a missing helper is a row that says so."""
    return requests.join(helpers.withColumn("found", F.lit(True)), "line_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def build_prompts(requests: DataFrame) -> DataFrame:
    """requests(request_id, kind, title, line, context, memory, tool, question, level) -> prompt and temperature. Nothing is sent anywhere.

    A null title, line or context is empty, a null memory {}. kind: tutor, help, quiz or match.
    """
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    level = T.known_difficulty(F.col("level"))
    memory = F.coalesce(F.to_json("memory", {"ignoreNullFields": "false"}), F.lit("{}"))
    said = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("")))
    tutor = F.concat_ws("\n", said("Lesson", "title"), said("Line", "line"), said("Context", "context"), F.concat(F.lit("Memory: "), memory), F.coalesce(F.try_element_at(lookup(TOOLS), F.col("tool")), F.lit("Help with the line.")), F.concat(F.lit("Question: "), F.coalesce("question", F.lit("No extra question"))))
    items = F.concat_ws("\n", F.concat(F.lit("Write "), F.coalesce("kind", F.lit("quiz")), F.lit(" items as JSON from this text.")), lookup(DIFFICULTY)[level], F.coalesce("context", F.lit("")))
    warmth = F.when(F.col("kind") == "tutor", 0.3).when(F.col("kind") == "help", 0.2).when(F.col("kind") == "match", F.when(level == "hard", 0.5).otherwise(0.3)).otherwise(F.when(level == "hard", 0.55).otherwise(0.35))
    return requests.select("request_id", "kind", F.when(F.col("kind").isin("tutor", "help"), tutor).otherwise(items).alias("prompt"), warmth.alias("temperature"))


#: Said where a model call failed; our own wording.
NO_TUTOR = "The tutor can't be reached just now."


def parse_help(body: Column) -> Column:
    """struct(simple, bangla, grammar, error): an empty response falls back, bad JSON is an error."""
    text = T.strip_fence(body)
    parsed = F.from_json(text, "simple string, bangla string, grammar string")
    empty = F.coalesce(body, F.lit("")) == ""
    ok = parsed["simple"].isNotNull() | parsed["bangla"].isNotNull() | parsed["grammar"].isNotNull()
    return F.struct(F.when(empty, "No help yet.").otherwise(parsed["simple"]).alias("simple"), F.when(empty, "").otherwise(parsed["bangla"]).alias("bangla"), F.when(empty, "").otherwise(parsed["grammar"]).alias("grammar"), F.when(~empty & ~F.coalesce(ok, F.lit(False)), "bad JSON").alias("error"))


def assemble_answer(body: Column, ok: Column) -> Column:
    """struct(answer, source) of a raw model response."""
    parts = F.from_json(body, "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>")["candidates"]
    text = T.trim(F.array_join(F.transform(F.get(parts, F.lit(0))["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    said = F.when(F.coalesce(text, F.lit("")) == "", "No response generated.").otherwise(text)
    return F.struct(F.when(ok, said).otherwise(NO_TUTOR).alias("answer"), F.when(ok, "model").otherwise("fallback").alias("source"))
