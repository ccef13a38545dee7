"""Learning activity: daily records, summaries, memories, integrity. Students are keyed by student_key.

Sums are partially aggregated before their shuffle, so one student with most of the rows is no bottleneck; "latest N" is a
row number per student, which Spark limits per task before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lessonlake.functions import text as T

DEMO = "demo-student"
COUNTERS = ("lessons_opened", "lines_selected", "ai_interactions", "quiz_attempts", "quiz_score", "quiz_total", "games_played", "game_score", "minutes")


def student_key(first: Column, second: Column | None = None) -> Column:
    key = T.trim(F.coalesce(first, second, F.lit("")) if second is not None else F.coalesce(first, F.lit("")))
    return F.when(key == "", DEMO).otherwise(key)


def activity_counters(activity: DataFrame) -> DataFrame:
    """The nine counters of each activity row. Minutes count for any kind; rows without a kind are left out (rejected_activity has them)."""
    kind = F.col("activity_type")
    one = lambda k: F.when(kind == k, 1).otherwise(0).cast("long")
    of = lambda k, c: F.when(kind == k, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return activity.where(kind.isNotNull()).select(
        "student_key", "date_key", "event_id", one("lesson_opened").alias("lessons_opened"), one("line_selected").alias("lines_selected"), one("ai_interaction").alias("ai_interactions"),
        one("quiz_submitted").alias("quiz_attempts"), of("quiz_submitted", F.col("score")).alias("quiz_score"), of("quiz_submitted", F.col("total")).alias("quiz_total"),
        one("game_finished").alias("games_played"), of("game_finished", F.col("score")).alias("game_score"), F.coalesce("minutes", F.lit(0)).cast("long").alias("minutes"),
    )


def rejected_activity(activity: DataFrame) -> DataFrame:
    return activity.where(F.col("activity_type").isNull()).withColumn("error", F.lit("activityType is required"))


def daily_study(counters: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Sums by student and day; with the current table given, its rows are added to (an incremental run)."""
    rows = counters.select("student_key", "date_key", *COUNTERS)
    if current is not None:
        rows = rows.unionByName(current.select("student_key", "date_key", *COUNTERS))
    return rows.groupBy("student_key", "date_key").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def latest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The latest n rows of each student."""
    w = Window.partitionBy("student_key").orderBy(*[c.desc() for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)


def recent(activity: DataFrame, lists: dict[str, tuple[str, str, int]]) -> DataFrame:
    """lists: name -> (activity type, column, n): the column's values in the latest n rows of that type, newest first. One shuffle by student
    and type for all lists; a student's row holds n values a list at most."""
    most = max(n for _, _, n in lists.values())
    w = Window.partitionBy("student_key", "activity_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    kinds = sorted({k for k, _, _ in lists.values()})
    top = activity.where(F.col("activity_type").isin(*kinds)).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most)

    def listed(kind: str, value: str, n: int) -> Column:
        found = F.collect_list(F.when((F.col("activity_type") == kind) & (F.col("_rank") <= n), F.struct("_rank", F.col(value).alias("v"))))
        return F.transform(F.array_sort(found), lambda s: s["v"])

    return top.groupBy("student_key").agg(*[listed(*of).alias(name) for name, of in lists.items()])


RECENTS = {"quizzes": ("quiz_submitted", "event_id", 10), "games": ("game_finished", "event_id", 10), "chats": ("ai_interaction", "event_id", 10)}


def student_summary(students: DataFrame, daily: DataFrame, activity: DataFrame) -> DataFrame:
    """Totals over the latest 30 daily rows, and the latest 10 quizzes, games and tutor turns; a student without any has zeros and empty lists."""
    totals = latest(daily, 30, F.col("date_key")).groupBy("student_key").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.count("*").alias("days"))
    out = students.select("student_key").join(totals, "student_key", "left").join(recent(activity, RECENTS), "student_key", "left")
    return out.select("student_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*COUNTERS, "days")], *[F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in RECENTS])


def progress_report(summary: DataFrame) -> DataFrame:
    return summary.select("student_key", T.percent(F.col("quiz_score"), F.col("quiz_total")).alias("accuracy"), *COUNTERS, "days", *[F.size(c).alias(f"recent_{c}") for c in ("quizzes", "games", "chats")])


def upsert_students(events: DataFrame) -> DataFrame:
    """events(student_key, name, ts, event_id): created once; the latest given name counts, else the key."""
    latest_name = F.max_by("name", F.when(F.col("name").isNotNull(), F.struct("ts", "event_id")))
    return events.groupBy("student_key").agg(F.min("ts").alias("created_at"), F.coalesce(latest_name, F.first("student_key")).alias("name"))


def merge_students(events: DataFrame, students: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events as upsert_students takes them, the stored students and memories -> both after them.

    A stored student keeps all but the name, which the latest given one replaces; a new one is made with its first event. A student of
    events without a memory gets an empty one, once.
    """
    new = upsert_students(events).select("student_key", F.col("created_at").alias("_made"), F.col("name").alias("_name"))
    given = events.where("name IS NOT NULL").groupBy("student_key").agg(F.max_by("name", F.struct("ts", "event_id")).alias("_given"))
    both = students.withColumn("_known", F.lit(True)).join(new, "student_key", "full").join(given, "student_key", "left")
    name = F.when(F.col("_known"), F.coalesce("_given", "name")).otherwise(F.col("_name"))
    made = F.coalesce("created_at", F.col("_made").cast(students.schema["created_at"].dataType))
    merged = both.withColumn("name", name).withColumn("created_at", made).select(*students.columns)
    lacking = new.join(memories.select("student_key"), "student_key", "left_anti").select("student_key", F.col("_made").cast(memories.schema["created_at"].dataType).alias("created_at"))
    return merged, memories.unionByName(lacking, allowMissingColumns=True)


def memory_entries(activity: DataFrame) -> DataFrame:
    """What is remembered of each student, a row an entry: student_key, list, position, value. list: lessons (opened ones, once each in
    first-seen order), lines and tools (in order, repeats kept). A list of any length is rows, never one array."""
    kind = F.col("activity_type")
    opened = activity.where(kind == "lesson_opened").groupBy("student_key", F.col("lesson_no").cast("long").alias("value")).agg(F.min(F.struct("ts", "event_id")).alias("at"))
    said = activity.where(kind.isin("line_selected", "ai_interaction")).select("student_key", F.when(kind == "line_selected", "lines").otherwise("tools").alias("list"), F.struct("ts", "event_id").alias("at"), F.col("k").cast("long").alias("value"))
    rows = opened.select("student_key", F.lit("lessons").alias("list"), "at", "value").unionByName(said)
    return rows.select("student_key", "list", F.row_number().over(Window.partitionBy("student_key", "list").orderBy("at")).alias("position"), "value")


def opened_lessons(activity: DataFrame) -> DataFrame:
    """Each student's opened lessons in first-seen order, an array of as many as there are lessons at most."""
    first = activity.where(F.col("activity_type") == "lesson_opened").groupBy("student_key", "lesson_no").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.groupBy("student_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "lesson_no"))), lambda s: s["lesson_no"]).alias("lessons"))


def with_weak_areas(rows: DataFrame, attempts: DataFrame | None) -> DataFrame:
    """rows with weak_areas, those of weak_areas(attempts), empty for a student without any."""
    if attempts is None:
        return rows.withColumn("weak_areas", F.array().cast("array<string>"))
    areas = weak_areas(attempts).select("student_key", F.col("areas").alias("weak_areas"))
    return rows.join(areas, "student_key", "left").withColumn("weak_areas", F.coalesce("weak_areas", F.array().cast("array<string>")))


def agent_memory(activity: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """What a tutor prompt sees: lessons, number of lines, last 5 lines, last 10 tools (oldest first), weak areas of attempts (as weak_areas takes
    them), latest 5 quizzes (newest first)."""
    lists = recent(activity, {"last_lines": ("line_selected", "k", 5), "last_tools": ("ai_interaction", "k", 10), "quizzes": ("quiz_submitted", "event_id", 5)})
    counts = activity.groupBy("student_key").agg(F.count_if(F.col("activity_type") == "line_selected").alias("n_lines"))
    out = with_weak_areas(counts.join(lists, "student_key", "left").join(opened_lessons(activity), "student_key", "left"), attempts)
    listed = lambda c: F.coalesce(c, F.array()).alias(c)
    return out.select("student_key", listed("lessons"), "n_lines", *[F.reverse(F.coalesce(c, F.array())).alias(c) for c in ("last_lines", "last_tools")], "weak_areas", listed("quizzes"))


def research_summary(activity: DataFrame, attempts: DataFrame | None = None, students: DataFrame | None = None) -> DataFrame:
    """Name (of students(student_key, name)), lessons, number of lines, last 10 tools, weak areas of attempts, and the latest 20 events, 10
    chats and 10 quizzes of each student, newest first.

    The full lists of lines and tools are memory_entries' rows.
    """
    lists = recent(activity, {"tools": ("ai_interaction", "k", 10), "chats": ("ai_interaction", "event_id", 10), "quizzes": ("quiz_submitted", "event_id", 10)})
    events = latest(activity, 20, F.col("ts"), F.col("event_id")).groupBy("student_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "event_id"))), lambda s: s["event_id"]).alias("events"))
    counts = activity.groupBy("student_key").agg(F.count_if(F.col("activity_type") == "line_selected").alias("n_lines"))
    out = with_weak_areas(counts.join(events, "student_key").join(lists, "student_key", "left").join(opened_lessons(activity), "student_key", "left"), attempts)
    out = out.withColumn("name", F.lit(None).cast("string")) if students is None else out.join(students.select("student_key", "name"), "student_key", "left")
    return out.select("student_key", "name", "n_lines", "events", "weak_areas", *[F.coalesce(c, F.array()).alias(c) for c in ("lessons", "tools", "chats", "quizzes")])


def _said(rows: DataFrame, name: str, default: str, as_json: bool = False) -> Column:
    """A column of the attempt, the default where it is null or missing; arrays and structs as JSON."""
    if name not in rows.columns:
        return F.lit(default)
    nested = as_json and not isinstance(rows.schema[name].dataType, StringType)
    return F.coalesce(F.to_json(name) if nested else F.col(name).cast("string"), F.lit(default))


def record_quiz(activity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attempt rows, their counters for daily_study): an attempt a submission, lesson 1 where none is given. activity may have lesson_title,
    wrong_answers, weak_areas and submitted_answers, the latter three as arrays or as JSON text."""
    rows = activity.where(F.col("activity_type") == "quiz_submitted")
    lists = [_said(rows, c, "[]", True).alias(f"{c}_json") for c in ("wrong_answers", "weak_areas", "submitted_answers")]
    attempts = rows.select("student_key", "event_id", "ts", F.coalesce("lesson_no", F.lit(1)).alias("lesson_no"), _said(rows, "lesson_title", "").alias("lesson_title"), "score", "total", T.percent(F.col("score"), F.col("total")).alias("pct"), *lists)
    return attempts, activity_counters(rows.withColumn("minutes", F.lit(0)))


def record_game(activity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attempt rows, their counters for daily_study): the type defaults to grammar_game, the lesson stays null. activity may have result,
    sentence and details, the last as a struct or as JSON text."""
    rows = activity.where(F.col("activity_type") == "game_finished")
    more = [_said(rows, "result", "").alias("result"), _said(rows, "sentence", "").alias("sentence"), _said(rows, "details", "{}", True).alias("details_json")]
    attempts = rows.select("student_key", "event_id", "ts", "lesson_no", F.coalesce("game_type", F.lit("grammar_game")).alias("game_type"), "score", F.coalesce("total", F.lit(0)).alias("total"), *more)
    return attempts, activity_counters(rows.withColumn("minutes", F.lit(0)))


def weak_areas(attempts: DataFrame) -> DataFrame:
    """attempts(student_key, event_id, ts, area) -> areas, once each in first-seen order (as many as there are areas at most), and the number of attempts."""
    first = attempts.groupBy("student_key", "area").agg(F.min(F.struct("ts", "event_id")).alias("at"), F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("area").isNotNull(), F.struct("at", "area")))), lambda s: s["area"])
    return first.groupBy("student_key").agg(listed.alias("areas"), F.sum("n").alias("n_history"))


def log_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new rows: new(student_key, lesson_no, event_type, ts, metadata struct or null) gets the metadata as JSON."""
    rows = new.withColumn("metadata_json", F.to_json("metadata", {"ignoreNullFields": "false"})).drop("metadata") if "metadata" in new.columns else new
    return old.unionByName(rows, allowMissingColumns=True)


def events_by_student(events: DataFrame, key: str) -> DataFrame:
    return events.where(F.col("student_key") == F.trim(F.lit(key)))


def events_by_lesson(events: DataFrame, lesson_no: int) -> DataFrame:
    return events.where(F.col("lesson_no") == lesson_no)


def delete_students(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given students."""
    return {name: t.join(keys.select("student_key"), "student_key", "left_anti") for name, t in tables.items()}


def delete_books(books: DataFrame, pages: DataFrame, lines: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, pages, lines) without the books of keys(book_id), their pages and these pages' lines."""
    kept = pages.join(keys.select("book_id"), "book_id", "left_anti")
    return books.join(keys.select("book_id"), "book_id", "left_anti"), kept, lines.join(kept.select("page_id"), "page_id", "left_semi")


#: Unique keys and parents of the stored tables (fixed values): table -> (unique keys, key of the parent, parent table).
KEYS = {
    "students": ([["student_key"], ["email"]], None, None), "student_memory": ([["student_key"]], "student_key", "students"), "daily_study": ([["student_key", "date_key"]], "student_key", "students"),
    "game_attempts": ([], "student_key", "students"), "research_events": ([], "student_key", "students"), "quiz_attempts": ([], "student_key", "students"), "chat_messages": ([], "student_key", "students"),
    "wallets": ([["student_key"]], "student_key", "students"), "reward_tx": ([], "student_key", "students"), "ai_usage": ([], "student_key", "students"), "books": ([], None, None),
    "book_pages": ([["book_id", "page_no"]], "book_id", "books"), "book_lines": ([["page_id", "line_number"]], "page_id", "book_pages"),
}


def check_all_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of KEYS in the tables that are given. A null key violates nothing."""
    found = []
    for name, table in tables.items():
        unique, key, parent = KEYS[name]
        for columns in unique:
            found.append(check_keys(table.dropna(subset=columns), name, columns))
        if parent in tables:
            orphans = table.where(F.col(key).isNotNull()).join(tables[parent].select(key).distinct(), key, "left_anti").groupBy(key).count()
            found.append(orphans.select(F.lit(name).alias("table_name"), F.lit("orphan").alias("rule"), F.col(key).cast("string").alias("key_text"), F.col("count").alias("n")))
    return reduce(DataFrame.union, found)


def check_keys(table: DataFrame, name: str, unique: list[str], parent: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Violations: (table, rule, key, n)."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in unique])
    out = table.groupBy(*unique).count().where("count > 1").select(F.lit(name).alias("table_name"), F.lit("unique").alias("rule"), text.alias("key_text"), F.col("count").alias("n"))
    if parent is not None:
        orphans = table.join(parent.select(key).distinct(), key, "left_anti").groupBy(key).count()
        out = out.union(orphans.select(F.lit(name), F.lit("orphan"), F.col(key).cast("string"), F.col("count")))
    return out


#: Fields of a signup that may be blank.
SIGNUP_TEXTS = ("section", "roll_number", "school_name", "guardian_name", "guardian_phone")


def register_students(signups: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """signups(signup_id, name, email, password_length, class_level, ts[, SIGNUP_TEXTS]): each as the student that is made, or with the reason of
    its rejection and without a key.

    A key is the name's slug and twelve digits of a hash of the email, which is unique, so students of one name have keys of their own.
    """
    text = lambda c: (T.trim(F.coalesce(F.col(c), F.lit(""))) if c in signups.columns else F.lit("")).alias(c)
    clean = signups.withColumn("email", F.lower(T.trim(F.coalesce("email", F.lit(""))))).withColumn("name", T.trim(F.coalesce("name", F.lit(""))))
    missing = (F.col("name") == "") | (F.col("email") == "") | F.col("password_length").isNull() | (F.col("password_length") == 0)
    reason = F.when(missing, "missing").when(F.col("password_length") < 6, "short password")
    judged = clean.withColumn("reason", reason)
    first = F.row_number().over(Window.partitionBy("email", F.col("reason").isNull()).orderBy("ts", "signup_id"))
    ranked = judged.withColumn("n", first)
    if existing is not None:
        ranked = ranked.join(existing.select("email").distinct().withColumn("known", F.lit(True)), "email", "left")
    else:
        ranked = ranked.withColumn("known", F.lit(None).cast("boolean"))
    reason = F.coalesce("reason", F.when((F.col("n") > 1) | F.col("known"), "email taken"))
    key = F.concat(T.slugify(F.col("name")), F.lit("-"), F.substring(F.sha2("email", 256), 1, 12))
    return ranked.select("signup_id", "email", "name", F.coalesce("class_level", F.lit(6)).alias("class_level"), *map(text, SIGNUP_TEXTS), reason.alias("reason"), F.when(reason.isNull(), key).alias("student_key"), F.col("ts").alias("created_at"))


def lesson_catalogue(lessons: DataFrame, book: dict[str, str] | None = None) -> DataFrame:
    """lessons(lesson_no, text[, title, lesson_title, name]) -> title (the first alias that is given), texts and characters of each, with the
    book's metadata as columns."""
    names = [F.max(c) for c in ("lesson_title", "title", "name") if c in lessons.columns]
    title = F.coalesce(*names, F.concat(F.lit("Lesson "), F.col("lesson_no").cast("string")))
    out = lessons.groupBy("lesson_no").agg(title.alias("title"), F.count("*").alias("n_texts"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))
    return out.withColumns({k: F.lit(v) for k, v in (book or {}).items()})
