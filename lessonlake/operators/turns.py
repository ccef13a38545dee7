"""Tutor turns: a request's way through credit, context, memory, event, answer and chat, for all requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonlake.functions import text as T
from lessonlake.operators import context as C
from lessonlake.operators import ledger as L
from lessonlake.operators.ordered import fold


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): the student's key, a lesson other than 0, a line and a tool are required."""
    key = T.trim(F.coalesce("student_key", "student_id", F.lit("")))
    rows = requests.withColumn("student_key", key)
    missing = (F.col("student_key") == "") | (F.coalesce("lesson_no", F.lit(0)) == 0) | (F.coalesce("line", F.lit("")) == "") | (F.coalesce("tool", F.lit("")) == "")
    return rows.where(~missing), rows.where(missing).select("request_id", F.lit("missing field").alias("error"))


#: What lies at one place of a student's order, and in which order at one time.
INTENT, QUIZ, AREA, REQUEST = range(4)
MEMORY = "lessons array<int>, n_lines int, last_lines array<string>, last_tools array<string>, weak_areas array<string>, quizzes array<long>"


class Learner:
    """A student's state: wallet and memory. Its lists hold as many values as there are lessons or areas, or as a prompt shows."""

    def __init__(self) -> None:
        self.wallet = L.new_wallet()
        self.lessons, self.areas, self.lines, self.tools, self.quizzes, self.n_lines = [], [], [], [], [], 0

    def ask(self, lesson: int, line: str, tool: str) -> tuple[str | None, int, dict | None]:
        """A request: (reason of its rejection, credits left, the memory that its answer sees)."""
        reason, *_ = L.wallet_step(self.wallet, "use", None)
        if reason:
            return reason, self.wallet[0], None
        if lesson not in self.lessons:
            self.lessons = [*self.lessons, lesson]
        self.n_lines += 1
        self.lines, self.tools = [*self.lines, line][-5:], [*self.tools, tool][-10:]
        return None, self.wallet[0], {"lessons": self.lessons, "n_lines": self.n_lines, "last_lines": self.lines, "last_tools": self.tools, "weak_areas": self.areas, "quizzes": self.quizzes}


def learning_turns(requests: DataFrame, intents: DataFrame, lessons: DataFrame, quizzes: DataFrame, responses: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """requests(request_id, event_id, student_key, student_id, lesson_no, line, tool, question, ts), intents as wallet_steps takes them (what
    students earned and spent elsewhere), lessons as lesson_context takes them, quizzes(student_key, event_id, ts), responses(request_id,
    body, ok), attempts(student_key, event_id, ts, area) as weak_areas takes them -> a row a request, with error where it was rejected.

    A credit is used first; without one there is no further effect. The memory that the answer sees has this request in it, and
    counts accepted requests alone. A failed or missing response still costs the credit, and falls back.

    A student's intents, quizzes, attempts and requests pass once, in order, after one shuffle by student; at one time quizzes and attempts
    come before requests.
    """
    good, bad = split_requests(requests)
    kinds = dict(good.dtypes)
    own = ("request_id", "lesson_no", "line", "tool", "question")
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("at_micros")

    def placed(rows: DataFrame, what: int, **said: str) -> DataFrame:
        more = {"kind": "string", "amount": "double", "area": "string"} | {c: kinds[c] for c in own}
        return rows.select("student_key", micros, F.col("event_id").cast("long").alias("event_id"), F.lit(what).alias("what"), *[(F.col(said[c]) if c in said else F.lit(None)).cast(t).alias(c) for c, t in more.items()])

    every = placed(intents, INTENT, kind="kind", amount="amount").unionByName(placed(quizzes, QUIZ)).unionByName(placed(good, REQUEST, **{c: c for c in own}))
    if attempts is not None:
        every = every.unionByName(placed(attempts.where("area IS NOT NULL"), AREA, area="area"))

    def step(state: Learner, row: tuple) -> list[tuple]:
        key, at, event, what, kind, amount, area, *asked = row
        if what == INTENT:
            L.wallet_step(state.wallet, kind, amount)
        elif what == QUIZ:
            state.quizzes = [event, *state.quizzes][:5]
        elif what == AREA:
            if area not in state.areas:
                state.areas = [*state.areas, area]
        else:
            request, lesson, line, tool, question = asked
            return [(key, at, event, *asked, *state.ask(lesson, line, tool))]
        return []

    columns = ["at_micros", "event_id", "what", "kind", "amount", "area", *own]
    schema = "student_key string, at_micros long, event_id long, " + ", ".join(f"{c} {kinds[c]}" for c in own) + f", error string, credits_left long, memory struct<{', '.join(x.replace(' ', ':', 1) for x in MEMORY.split(', '))}>"
    done = fold(every, "student_key", ["at_micros", "event_id", "what"], columns, Learner, step, schema)
    done = done.withColumn("ts", F.timestamp_micros("at_micros").cast(good.schema["ts"].dataType)).drop("at_micros")
    paid = done.where("error IS NULL")
    around = C.lesson_context(paid, lessons, [c for c in paid.columns if c != "request_id"]).drop("preview")
    said = responses.select("request_id", C.assemble_answer(F.col("body"), F.coalesce("ok", F.lit(False))).alias("a")).select("request_id", "a.*")
    out = around.join(said, "request_id", "left").withColumn("answer", F.coalesce("answer", F.lit(C.NO_TUTOR))).withColumn("source", F.coalesce("source", F.lit("fallback")))
    unpaid = done.where("error IS NOT NULL").select("request_id", "error", "credits_left")
    return out.unionByName(unpaid, allowMissingColumns=True).unionByName(bad, allowMissingColumns=True)


def turn_events(turns: DataFrame) -> DataFrame:
    """The log rows of the turns that were answered."""
    meta = F.to_json(F.struct(F.col("question").alias("studentQuestion"), F.lit(True).alias("aiCreditUsed")), {"ignoreNullFields": "false"})
    return turns.where("error IS NULL").select("student_key", "lesson_no", F.lit("agent_tool_request").alias("event_type"), F.col("line").alias("selected_line"), F.col("tool").alias("tool_used"), meta.alias("metadata_json"), "ts")


def turn_chats(turns: DataFrame) -> DataFrame:
    return turns.where("error IS NULL").select("student_key", "lesson_no", F.col("line").alias("selected_line"), F.col("tool").alias("tool_used"), "question", "answer", "source", "ts")


def _uses(turns: DataFrame) -> DataFrame:
    """The turns that were answered, as wallet_steps has the credit that each used."""
    said = {"kind": F.lit("use"), "reason": F.lit(None).cast("string"), "points_change": F.lit(0).cast("long"), "credits_change": F.lit(-1).cast("long"), "selected_line": F.col("line"), "tool_used": F.col("tool"), "note": F.lit(None).cast("string")}
    return turns.where("error IS NULL").withColumns(said)


def turn_usage(turns: DataFrame) -> DataFrame:
    """A usage row for each answered turn."""
    return L.usage_rows(_uses(turns))


def turn_ledger(turns: DataFrame) -> DataFrame:
    """The ledger row of each answered turn."""
    return L.ledger_rows(_uses(turns))
