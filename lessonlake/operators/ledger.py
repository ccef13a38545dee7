"""The reward ledger: each student's intents one after the other, and the same balances as sums of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lessonlake.operators.ordered import fold

#: Opening credits, points a credit costs, credits that an admin adds where none are named, and the points of each event.
OPENING, POINTS_PER_CREDIT, ADMIN_DEFAULT = 5, 10, 50
POINT_RULES = {"points_per_credit": POINTS_PER_CREDIT, "right_answer": 2, "perfect_bonus": 5, "game": 10, "practice": 1}
#: The type of a ledger row.
TYPES = {"award": "EARN_POINTS", "redeem": "REDEEM_POINTS", "use": "USE_AI_CREDIT", "admin": "ADMIN_ADD_CREDITS"}
#: What an intent may say beside its amount.
DETAILS = {"note": "string", "lesson_no": "int", "selected_line": "string", "question": "string", "tool_used": "string"}
BALANCES = ("credits", "points", "lifetime", "used")
CHANGES = "reason string, opened int, points_change long, credits_change long, credits long, points long, lifetime long, used long"
STEP = f"student_key string, at_micros long, event_id long, kind string, {CHANGES}, " + ", ".join(f"{c} {t}" for c, t in DETAILS.items())


def new_wallet() -> list:
    """credits, points, lifetime points, credits used, and whether the wallet is open."""
    return [0, 0, 0, 0, False]


def wallet_step(state: list, kind: str | None, amount: float | None, known: bool = True) -> tuple[str | None, int, int, int]:
    """Changes a wallet's state by one intent -> (reason of a rejection, credits it opened with, points and credits changed)."""
    whole = int((amount or 0) // 1)
    if kind not in TYPES:
        return "unknown kind", 0, 0, 0
    if kind == "admin" and not known:
        return "unknown student", 0, 0, 0
    opened = 0 if state[4] or kind == "admin" else OPENING
    state[0] += opened
    state[4] = True
    points = credits = 0
    reason = None
    if kind == "award":
        points = max(whole, 0)
        state[2] += points
    elif kind == "redeem":
        n = max(whole, 1)
        if state[1] >= n * POINTS_PER_CREDIT:
            points, credits = -n * POINTS_PER_CREDIT, n
        else:
            reason = "too few points"
    elif kind == "use":
        if state[0] > 0:
            credits = -1
            state[3] += 1
        else:
            reason = "no credits"
    else:
        credits = ADMIN_DEFAULT if amount is None else whole
    state[0] += credits
    state[1] += points
    return reason, opened, points, credits


def detailed(intents: DataFrame) -> DataFrame:
    """intents with all DETAILS, null where they say nothing."""
    have = {c.lower() for c in intents.columns}
    return intents.withColumns({c: F.lit(None).cast(t) for c, t in DETAILS.items() if c not in have})


def known_students(intents: DataFrame, students: DataFrame | None) -> DataFrame:
    """intents with known: whether their student is in students(student_key), true without such a table."""
    if students is None:
        return intents.withColumn("known", F.lit(True))
    return intents.join(students.select("student_key").distinct().withColumn("known", F.lit(True)), "student_key", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def wallet_steps(intents: DataFrame, students: DataFrame | None = None, wallets: DataFrame | None = None) -> DataFrame:
    """intents(student_key, ts, event_id, kind, amount[, DETAILS]) -> a row an intent, in time order: what it changed, the balances after
    it, and the reason where it was rejected.

    A null amount counts as 0, or as ADMIN_DEFAULT credits of an admin. With students(student_key) given, credits are not added for others. A
    rejected intent of an unknown student or kind opens no wallet. wallets(student_key, *BALANCES): what students have before.
    """
    rows = known_students(detailed(intents).withColumn("at_micros", F.unix_micros(F.col("ts").cast("timestamp"))), students)
    stored = [f"stored_{c}" for c in BALANCES]
    if wallets is None:
        rows = rows.withColumns({c: F.lit(None).cast("long") for c in stored})
    else:
        rows = rows.join(wallets.select("student_key", *[F.col(c).cast("long").alias(f"stored_{c}") for c in BALANCES]), "student_key", "left")

    def step(state: list, row: tuple) -> list[tuple]:
        key, at, event, kind, amount, known, *more = row
        details, had = more[: len(DETAILS)], more[len(DETAILS) :]
        if not state:
            state += new_wallet() if had[0] is None else [*had, True]
        change = wallet_step(state, kind, amount, known)
        return [(key, at, event, kind, *change, *state[:4], *details)]

    done = fold(rows, "student_key", ["at_micros", "event_id"], ["at_micros", "event_id", "kind", "amount", "known", *DETAILS, *stored], list, step, STEP)
    return done.withColumn("ts", F.timestamp_micros("at_micros").cast(intents.schema["ts"].dataType)).drop("at_micros")


def run_wallets(steps: DataFrame) -> DataFrame:
    """wallet_steps -> each student's balances after the last intent; students without an accepted or opening one have none."""
    latest = F.max_by(F.struct(*BALANCES), F.struct("ts", "event_id"))
    ok = F.col("reason").isNull()
    out = steps.groupBy("student_key").agg(latest.alias("w"), F.sum("opened").alias("opened_with"), F.count_if(~ok).alias("rejected"), F.count_if(ok).alias("n_rows"))
    return out.select("student_key", "w.*", "opened_with", "rejected", "n_rows")


def ledger_rows(steps: DataFrame) -> DataFrame:
    """The accepted intents as ledger rows, each with its reason; a use of a credit also says what it was for."""
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    reason = (
        F.when(F.col("kind") == "award", F.col("note")).when(F.col("kind") == "redeem", text("Redeemed ", -F.col("points_change"), " learning points for ", F.col("credits_change"), " AI credit(s)."))
        .when(F.col("kind") == "use", text("Used 1 AI Teacher credit for ", F.coalesce("tool_used", F.lit("AI Teacher")), ".")).otherwise(text("Added ", F.col("credits_change"), " AI Teacher credits manually for demo."))
    )
    about = F.to_json(F.struct(F.col("lesson_no").alias("lessonNo"), F.col("selected_line").alias("selectedLine"), "question", F.col("tool_used").alias("toolUsed")))
    return steps.where("reason IS NULL").select(
        "student_key", "ts", "event_id", kind[F.col("kind")].alias("type"), "points_change", "credits_change", reason.alias("reason"), F.when(F.col("kind") == "use", about).alias("metadata_json"),
    )


def usage_rows(steps: DataFrame) -> DataFrame:
    """A usage row for each credit that was used."""
    return steps.where("reason IS NULL AND kind = 'use'").select("student_key", "ts", "event_id", "lesson_no", "selected_line", "question", "tool_used", F.lit(1).alias("credits_used"))


def wallet_from_ledger(ledger: DataFrame, openings: DataFrame) -> DataFrame:
    """openings(student_key, opened_with): balances as sums of the ledger's rows. Must equal run_wallets."""
    sums = ledger.groupBy("student_key").agg(
        F.sum("credits_change").alias("c"), F.sum("points_change").alias("p"), F.sum(F.when(F.col("type") == "EARN_POINTS", F.col("points_change")).otherwise(0)).alias("lifetime"),
        (-F.sum(F.when(F.col("type") == "USE_AI_CREDIT", F.col("credits_change")).otherwise(0))).alias("used"),
    )
    return openings.join(sums, "student_key", "left").select("student_key", (F.col("opened_with") + F.coalesce("c", F.lit(0))).alias("credits"), *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("p", "points"), ("lifetime", "lifetime"), ("used", "used"))])


def reconciled(steps: DataFrame) -> DataFrame:
    """Both balances of each student in one aggregation, and whether they are equal."""
    last = F.max_by(F.struct("credits", "points"), F.struct("ts", "event_id"))
    sums = steps.groupBy("student_key").agg(
        last.alias("w"), (F.sum("opened") + F.sum("credits_change")).alias("credits"), F.sum("points_change").alias("points"),
        F.sum(F.when(F.col("kind") == "award", F.col("points_change")).otherwise(0)).alias("lifetime"), (-F.sum(F.when(F.col("kind") == "use", F.col("credits_change")).otherwise(0))).alias("used"),
    )
    return sums.select("student_key", "credits", "points", "lifetime", "used", ((F.col("credits") == F.col("w.credits")) & (F.col("points") == F.col("w.points"))).alias("equal"))


def wallet_view(ledger: DataFrame, n: int = 10) -> DataFrame:
    """The latest n ledger rows of each student, newest first, with the point rules."""
    w = Window.partitionBy("student_key").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    rules = F.struct(*[F.lit(v).alias(k) for k, v in POINT_RULES.items()]).alias("point_rules")
    return ledger.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("*", rules)
