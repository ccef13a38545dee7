"""Queries over activity, ledger and grading, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonlake.functions import text as T
from lessonlake.operators import activity as G
from lessonlake.operators import grading as R
from lessonlake.operators import ledger as L
from lessonlake.operators import turns as U
from lessonlake.plans import adapters as A
from lessonlake.plans import sql_text as S
from lessonlake.sources import readers, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


_ONE = {"lessons_opened": "lesson_opened", "lines_selected": "line_selected", "ai_interactions": "ai_interaction", "quiz_attempts": "quiz_submitted", "games_played": "game_finished"}
_OF = {"quiz_score": ("quiz_submitted", "score"), "quiz_total": ("quiz_submitted", "total"), "game_score": ("game_finished", "score")}
_COUNTS = {c: f"CASE WHEN activity_type = '{_ONE[c]}' THEN 1 ELSE 0 END" if c in _ONE else f"CASE WHEN activity_type = '{_OF[c][0]}' THEN {_OF[c][1]} ELSE 0 END" if c in _OF else "minutes" for c in G.COUNTERS}
COUNTED = f"{A.ACTIVITY}, counted AS (SELECT student_key, date_key, event_id, {', '.join(f'{e} AS {c}' for c, e in _COUNTS.items())} FROM activity)"
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in G.COUNTERS)
DAILY = f"{COUNTED}, daily AS (SELECT student_key, date_key, {SUMS} FROM counted GROUP BY ALL)"


def _recent(kind: str, n: int, name: str) -> str:
    return f"{name} AS (SELECT student_key, list(event_id ORDER BY k) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY student_key ORDER BY ts DESC, event_id DESC) AS k FROM (SELECT * EXCLUDE (k) FROM activity) WHERE activity_type = '{kind}') WHERE k <= {n} GROUP BY student_key)"


SUMMARY = f"""{DAILY}, totals AS (SELECT student_key, {SUMS}, count(*) AS days FROM (SELECT *, row_number() OVER (PARTITION BY student_key ORDER BY date_key DESC) AS k FROM daily) WHERE k <= 30 GROUP BY student_key),
{_recent('quiz_submitted', 10, 'quizzes')}, {_recent('game_finished', 10, 'games')}, {_recent('ai_interaction', 10, 'chats')},
summary AS (SELECT totals.*, quizzes, games, chats FROM totals LEFT JOIN quizzes USING (student_key) LEFT JOIN games USING (student_key) LEFT JOIN chats USING (student_key))"""


def _counters(spark, d):
    return G.activity_counters(A.activity(spark, d))


def _daily(spark, d):
    return G.daily_study(_counters(spark, d))


def _summary(spark, d):
    a = A.activity(spark, d)
    return G.student_summary(a.select("student_key").distinct(), _daily(spark, d), a)


@query
def a6_read_activity(spark, d):
    a, e = A.activity(spark, d), F.col("event_id")
    text = lambda c: F.col(c).cast("string")
    raw = a.select(
        F.when(e % 3 == 0, F.concat(F.lit(" "), "student_key")).when(e % 3 == 1, "  ").alias("studentKey"), F.col("student_key").alias("studentId"), F.col("activity_type").alias("activityType"),
        F.when(e % 4 == 0, "n/a").when(e % 4 != 1, text("minutes")).alias("minutesStudied"), F.when(e % 5 == 0, "").when(e % 5 != 1, text("lesson_no")).alias("lessonNo"),
        F.when(e % 7 != 0, text("score")).alias("score"), text("total").alias("total"), F.lit(None).cast("string").alias("gameType"), "ts", "event_id",
    )
    return readers.activity_rows(raw).drop("game_type")


SQL["a6_read_activity"] = f"""WITH {A.ACTIVITY}, r AS (SELECT *, CASE WHEN event_id % 5 < 2 THEN NULL ELSE lesson_no END AS l FROM activity)
SELECT CASE WHEN event_id % 3 = 1 THEN 'demo-student' ELSE student_key END AS student_key, activity_type, ts, event_id, date_key, CASE WHEN activity_type = 'game_finished' THEN l ELSE coalesce(l, 1) END AS lesson_no,
CASE WHEN event_id % 7 = 0 THEN 0 ELSE score END AS score, total, CASE WHEN event_id % 4 < 2 THEN 0 ELSE minutes END AS minutes FROM r"""


@query
def a7_load_table(spark, d):
    a = A.activity(spark, d)
    return tables.conform(a.withColumnsRenamed({"activity_type": "event_type", "ts": "created_at"}), "research_events")


SQL["a7_load_table"] = f"""WITH {A.ACTIVITY} SELECT student_key, lesson_no, activity_type AS event_type, CAST(NULL AS VARCHAR) AS selected_line, CAST(NULL AS VARCHAR) AS tool_used, score, total, CAST(NULL AS VARCHAR) AS metadata_json, ts AS created_at FROM activity"""


@query
def g1_upsert_students(spark, d):
    """The customers are the stored students, every second one with a memory; the events name or make students."""
    c, key = A.table(spark, d, "customer"), F.col("c_custkey")
    named = A.activity(spark, d).withColumn("name", F.when(F.col("k") % 4 == 0, F.concat(F.lit("Name "), F.col("k").cast("string"))))
    stored = c.select(F.concat(F.lit("student-"), key * 2).alias("student_key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("guardian_phone"), F.lit("2020-01-01").cast("timestamp_ntz").alias("created_at"))
    memories = c.where(key % 2 == 0).select(F.concat(F.lit("student-"), key * 2).alias("student_key"), F.lit("[1]").alias("opened_lessons_json"), F.lit("2020-01-02").cast("timestamp_ntz").alias("created_at"))
    students, memories = G.merge_students(named, stored, memories)
    return students.join(memories.select("student_key", "opened_lessons_json", F.col("created_at").alias("memory_at")), "student_key", "left")


SQL["g1_upsert_students"] = f"""WITH {A.ACTIVITY}, e AS (SELECT student_key, min(ts) AS made, arg_max('Name ' || k, (ts, event_id)) FILTER (WHERE k % 4 = 0) AS given FROM activity GROUP BY student_key),
s AS (SELECT 'student-' || (c_custkey * 2) AS student_key, c_name, c_mktsegment, c_custkey FROM customer)
SELECT student_key, CASE WHEN c_custkey IS NULL THEN coalesce(given, student_key) ELSE coalesce(given, c_name) END AS name, c_mktsegment AS guardian_phone, CASE WHEN c_custkey IS NULL THEN CAST(made AS TIMESTAMP) ELSE TIMESTAMP '2020-01-01' END AS created_at,
CASE WHEN c_custkey % 2 = 0 THEN '[1]' END AS opened_lessons_json, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2020-01-02' ELSE CAST(made AS TIMESTAMP) END AS memory_at FROM s FULL JOIN e USING (student_key)"""


@query
def g2_daily_study(spark, d):
    c = _counters(spark, d)
    return G.daily_study(c.where("event_id % 2 = 0"), G.daily_study(c.where("event_id % 2 = 1")))


SQL["g2_daily_study"] = f"WITH {DAILY} SELECT * FROM daily"


@query
def g3_activity_counters(spark, d):
    return _counters(spark, d)


SQL["g3_activity_counters"] = f"WITH {COUNTED} SELECT * FROM counted"


@query
def g4_record_quiz(spark, d):
    k, text = F.col("k"), lambda *xs: F.array(*map(F.lit, xs))
    a = A.activity(spark, d).withColumns({
        "lesson_title": F.when(k % 3 != 0, F.concat(F.lit("Lesson "), F.col("lesson_no").cast("string"))), "wrong_answers": F.when(k % 4 != 0, F.array(F.concat(F.lit("q"), k.cast("string")), F.lit('"said"'))),
        "weak_areas": F.when(k % 2 == 0, text("Grammar")), "submitted_answers": F.when(k % 5 != 0, F.concat(F.lit("[{\"id\":"), k.cast("string"), F.lit("}]"))),
    })
    attempts, counters = G.record_quiz(a)
    daily = G.daily_study(counters).select("student_key", "date_key", "quiz_attempts", "quiz_score", "quiz_total")
    return attempts.withColumn("date_key", T.day_key(F.col("ts"))).join(daily, ["student_key", "date_key"]).drop("ts")


SQL["g4_record_quiz"] = f"""WITH {A.ACTIVITY}, q AS (SELECT * FROM activity WHERE activity_type = 'quiz_submitted'), t AS (SELECT student_key, date_key, count(*) AS quiz_attempts, CAST(sum(score) AS BIGINT) AS quiz_score, CAST(sum(total) AS BIGINT) AS quiz_total FROM q GROUP BY ALL)
SELECT student_key, date_key, event_id, lesson_no, CASE WHEN k % 3 <> 0 THEN 'Lesson ' || lesson_no ELSE '' END AS lesson_title, CASE WHEN k % 4 <> 0 THEN '["q' || k || '","\\"said\\""]' ELSE '[]' END AS wrong_answers_json, CASE WHEN k % 2 = 0 THEN '["Grammar"]' ELSE '[]' END AS weak_areas_json,
CASE WHEN k % 5 <> 0 THEN '[{{"id":' || k || '}}]' ELSE '[]' END AS submitted_answers_json, score, total, {S.percent('score', 'total')} AS pct, quiz_attempts, quiz_score, quiz_total FROM q JOIN t USING (student_key, date_key)"""


@query
def g5_record_game(spark, d):
    k = F.col("k")
    a = A.activity(spark, d).withColumns({"game_type": F.when(k % 2 == 0, "match"), "result": F.when(k % 3 == 0, "won"), "sentence": F.when(k % 3 == 1, "A sentence."), "details": F.when(k % 4 != 0, F.struct("k", F.lit("x").alias("kind")))})
    attempts, counters = G.record_game(a)
    daily = G.daily_study(counters).select("student_key", "date_key", "games_played", "game_score")
    return attempts.withColumn("date_key", T.day_key(F.col("ts"))).join(daily, ["student_key", "date_key"]).drop("ts")


SQL["g5_record_game"] = f"""WITH {A.ACTIVITY}, q AS (SELECT * FROM activity WHERE activity_type = 'game_finished'), t AS (SELECT student_key, date_key, count(*) AS games_played, CAST(sum(score) AS BIGINT) AS game_score FROM q GROUP BY ALL)
SELECT student_key, date_key, event_id, lesson_no, CASE WHEN k % 2 = 0 THEN 'match' ELSE 'grammar_game' END AS game_type, score, total, CASE WHEN k % 3 = 0 THEN 'won' ELSE '' END AS result, CASE WHEN k % 3 = 1 THEN 'A sentence.' ELSE '' END AS sentence,
CASE WHEN k % 4 <> 0 THEN '{{"k":' || k || ',"kind":"x"}}' ELSE '{{}}' END AS details_json, games_played, game_score FROM q JOIN t USING (student_key, date_key)"""


@query
def g6_student_summary(spark, d):
    return _summary(spark, d).withColumns({c: F.array_join(c, ",") for c in ("quizzes", "games", "chats")})


SQL["g6_student_summary"] = f"WITH {SUMMARY} SELECT * REPLACE (coalesce(array_to_string(quizzes, ','), '') AS quizzes, coalesce(array_to_string(games, ','), '') AS games, coalesce(array_to_string(chats, ','), '') AS chats) FROM summary"


@query
def g7_progress_report(spark, d):
    return G.progress_report(_summary(spark, d))


SQL["g7_progress_report"] = f"WITH {SUMMARY} SELECT student_key, {S.percent('quiz_score', 'quiz_total')} AS accuracy, {', '.join(G.COUNTERS)}, days, coalesce(len(quizzes), 0) AS recent_quizzes, coalesce(len(games), 0) AS recent_games, coalesce(len(chats), 0) AS recent_chats FROM summary"


@query
def g8_events_by_lesson(spark, d):
    a = A.activity(spark, d).select("student_key", "lesson_no", F.col("activity_type").alias("event_type"), "ts", "event_id", "k")
    old = a.where("k % 2 = 0").withColumn("metadata_json", F.lit(None).cast("string")).drop("k")
    log = G.log_events(old, a.where("k % 2 = 1").withColumn("metadata", F.struct("k", F.lit(None).cast("string").alias("note"))).drop("k"))
    return G.events_by_lesson(log, 7).withColumn("by", F.lit("lesson")).unionByName(G.events_by_student(log, " student-3 ").withColumn("by", F.lit("student")))


SQL["g8_events_by_lesson"] = f"""WITH {A.ACTIVITY}, log AS (SELECT student_key, lesson_no, activity_type AS event_type, ts, event_id, CASE WHEN k % 2 = 1 THEN to_json({{'k': k, 'note': NULL}}) END AS metadata_json FROM activity)
SELECT *, 'lesson' AS by FROM log WHERE lesson_no = 7 UNION ALL SELECT *, 'student' FROM log WHERE student_key = 'student-3'"""
FIRSTS = f"""firsts AS (SELECT student_key, string_agg(CAST(lesson_no AS VARCHAR), ',' ORDER BY t) AS lessons FROM (SELECT student_key, lesson_no, min((ts, event_id)) AS t FROM activity WHERE activity_type = 'lesson_opened' GROUP BY ALL) GROUP BY student_key)"""
COUNTS = "counts AS (SELECT student_key, count(*) FILTER (WHERE activity_type = 'line_selected') AS n_lines FROM activity GROUP BY 1)"


def _last(kind: str, value: str, n: int, name: str, newest_first: bool = True) -> str:
    return f"{name} AS (SELECT student_key, string_agg(CAST({value} AS VARCHAR), ',' ORDER BY n {'' if newest_first else 'DESC'}) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY student_key ORDER BY ts DESC, event_id DESC) AS n FROM activity WHERE {f"activity_type = '{kind}'" if kind else 'true'}) WHERE n <= {n} GROUP BY 1)"


def _areas(spark, d):
    """A weak area of each attempt at a quiz; one in five names none."""
    area = F.when(F.col("k") % 5 == 0, None).when(F.col("score") < 4, "Grammar").when(F.col("score") < 7, "Vocabulary").otherwise("General")
    return A.activity(spark, d).where("activity_type = 'quiz_submitted'").select("student_key", "event_id", "ts", area.alias("area"))


AREAS = """areas AS (SELECT student_key, string_agg(area, ',' ORDER BY t) AS weak_areas FROM (SELECT student_key, CASE WHEN score < 4 THEN 'Grammar' WHEN score < 7 THEN 'Vocabulary' ELSE 'General' END AS area, min((ts, event_id)) AS t FROM activity
WHERE activity_type = 'quiz_submitted' AND k % 5 <> 0 GROUP BY ALL) GROUP BY student_key)"""


@query
def g9_research_summary(spark, d):
    names = A.table(spark, d, "customer").select(F.concat(F.lit("student-"), "c_custkey").alias("student_key"), F.col("c_name").alias("name"))
    return G.research_summary(A.activity(spark, d), _areas(spark, d), names).withColumns({c: F.array_join(c, ",") for c in ("events", "lessons", "tools", "chats", "quizzes", "weak_areas")})


SQL["g9_research_summary"] = f"""WITH {A.ACTIVITY}, {AREAS}, {FIRSTS}, {COUNTS}, {_last('', 'event_id', 20, 'events')}, {_last('ai_interaction', 'k', 10, 'tools')}, {_last('ai_interaction', 'event_id', 10, 'chats')}, {_last('quiz_submitted', 'event_id', 10, 'quizzes')}
SELECT student_key, c_name AS name, n_lines, events, coalesce(weak_areas, '') AS weak_areas, coalesce(lessons, '') AS lessons, coalesce(tools, '') AS tools, coalesce(chats, '') AS chats, coalesce(quizzes, '') AS quizzes
FROM counts LEFT JOIN events USING (student_key) LEFT JOIN firsts USING (student_key) LEFT JOIN tools USING (student_key) LEFT JOIN chats USING (student_key) LEFT JOIN quizzes USING (student_key) LEFT JOIN areas USING (student_key) LEFT JOIN customer ON student_key = 'student-' || c_custkey"""


@query
def g10_student_memory(spark, d):
    return G.memory_entries(A.activity(spark, d))


SQL["g10_student_memory"] = f"""WITH {A.ACTIVITY}, r AS (SELECT student_key, 'lessons' AS list, lesson_no AS value, min((ts, event_id)) AS t FROM activity WHERE activity_type = 'lesson_opened' GROUP BY ALL
UNION ALL SELECT student_key, CASE activity_type WHEN 'line_selected' THEN 'lines' ELSE 'tools' END, k, (ts, event_id) FROM activity WHERE activity_type IN ('line_selected', 'ai_interaction'))
SELECT student_key, list, row_number() OVER (PARTITION BY student_key, list ORDER BY t) AS position, value FROM r"""


@query
def d4_agent_memory(spark, d):
    return G.agent_memory(A.activity(spark, d), _areas(spark, d)).select("student_key", "n_lines", *[F.array_join(c, ",").alias(c) for c in ("lessons", "last_lines", "last_tools", "weak_areas", "quizzes")])


SQL["d4_agent_memory"] = f"""WITH {A.ACTIVITY}, {AREAS}, {FIRSTS}, {COUNTS}, {_last('line_selected', 'k', 5, 'last_lines', False)}, {_last('ai_interaction', 'k', 10, 'last_tools', False)}, {_last('quiz_submitted', 'event_id', 5, 'quizzes')}
SELECT student_key, n_lines, coalesce(lessons, '') AS lessons, coalesce(last_lines, '') AS last_lines, coalesce(last_tools, '') AS last_tools, coalesce(weak_areas, '') AS weak_areas, coalesce(quizzes, '') AS quizzes
FROM counts LEFT JOIN areas USING (student_key) LEFT JOIN firsts USING (student_key) LEFT JOIN last_lines USING (student_key) LEFT JOIN last_tools USING (student_key) LEFT JOIN quizzes USING (student_key)"""


@query
def g11_weak_areas(spark, d):
    area = F.when(F.col("score") < 4, "Grammar").when(F.col("score") < 7, "Vocabulary").otherwise("General")
    rows = A.activity(spark, d).where("activity_type = 'quiz_submitted'").select("student_key", "event_id", "ts", area.alias("area"))
    return G.weak_areas(rows).withColumn("areas", F.array_join("areas", ","))


SQL["g11_weak_areas"] = f"""WITH {A.ACTIVITY}, a AS (SELECT student_key, ts, event_id, CASE WHEN score < 4 THEN 'Grammar' WHEN score < 7 THEN 'Vocabulary' ELSE 'General' END AS area FROM activity WHERE activity_type = 'quiz_submitted'),
f AS (SELECT student_key, area, min((ts, event_id)) AS t, count(*) AS n FROM a GROUP BY ALL) SELECT student_key, string_agg(area, ',' ORDER BY t) AS areas, CAST(sum(n) AS BIGINT) AS n_history FROM f GROUP BY student_key"""


@query
def g12_run_wallets(spark, d):
    return L.run_wallets(L.wallet_steps(A.intents(spark, d)))


_CREDITS = "(acc.credits + CASE WHEN acc.open OR x.kind = 'admin' THEN 0 ELSE 5 END)"
_WHOLE, _N = "CAST(floor(coalesce(x.amount, 0)) AS BIGINT)", "greatest(CAST(floor(coalesce(x.amount, 0)) AS BIGINT), 1)"
_REDEEM, _USE = f"(x.kind = 'redeem' AND acc.points >= 10 * {_N})", f"(x.kind = 'use' AND {_CREDITS} > 0)"
_DC = f"(CASE WHEN {_REDEEM} THEN {_N} WHEN {_USE} THEN -1 WHEN x.kind = 'admin' THEN CAST(floor(coalesce(x.amount, 50)) AS BIGINT) ELSE 0 END)"
_DP = f"(CASE WHEN x.kind = 'award' THEN greatest({_WHOLE}, 0) WHEN {_REDEEM} THEN -10 * {_N} ELSE 0 END)"
_OK = f"({_REDEEM} OR {_USE} OR x.kind IN ('award', 'admin'))"
_ROW = "STRUCT(ts TIMESTAMP, event_id BIGINT, kind VARCHAR, dp BIGINT, dc BIGINT)"
WALLETS = f"""{A.INTENT_ROWS}, lists AS (SELECT student_key, list({{'ts': ts, 'event_id': event_id, 'kind': kind, 'amount': amount}} ORDER BY ts, event_id) AS i FROM intents GROUP BY 1),
folded AS (SELECT student_key, list_reduce(i, lambda acc, x: {{'credits': {_CREDITS} + {_DC}, 'points': acc.points + {_DP}, 'lifetime': acc.lifetime + CASE WHEN x.kind = 'award' THEN {_DP} ELSE 0 END, 'used': acc.used + CASE WHEN {_USE} THEN 1 ELSE 0 END,
  'open': true, 'opened_with': acc.opened_with + {_CREDITS} - acc.credits, 'rejected': acc.rejected + CASE WHEN {_OK} THEN 0 ELSE 1 END,
  'rows': CASE WHEN {_OK} THEN list_append(acc.rows, {{'ts': x.ts, 'event_id': x.event_id, 'kind': x.kind, 'dp': {_DP}, 'dc': {_DC}}}) ELSE acc.rows END}},
  {{'credits': 0::BIGINT, 'points': 0::BIGINT, 'lifetime': 0::BIGINT, 'used': 0::BIGINT, 'open': false, 'opened_with': 0::BIGINT, 'rejected': 0::BIGINT, 'rows': []::{_ROW}[]}}) AS w FROM lists)"""
SQL["g12_run_wallets"] = f"WITH {WALLETS} SELECT student_key, w.credits, w.points, w.lifetime, w.used, w.opened_with, w.rejected, len(w.rows) AS n_rows FROM folded"


@query
def g13_wallet_from_ledger(spark, d):
    return L.reconciled(L.wallet_steps(A.intents(spark, d)))


SQL["g13_wallet_from_ledger"] = f"WITH {WALLETS} SELECT student_key, w.credits, w.points, w.lifetime, w.used, true AS equal FROM folded"


@query
def g12_usage_rows(spark, d):
    return L.usage_rows(L.wallet_steps(A.intents(spark, d)))


SQL["g12_usage_rows"] = f"""WITH {WALLETS}, r AS (SELECT unnest(w.rows) AS r FROM folded)
SELECT student_key, i.ts, event_id, lesson_no, selected_line, question, tool_used, 1 AS credits_used FROM r JOIN intents i ON event_id = r.event_id WHERE r.kind = 'use'"""


@query
def g14_ledger_rows(spark, d):
    """Whole ledger rows, of a ledger that goes on from stored wallets; credits are added for students that are known."""
    known = A.table(spark, d, "customer").select(F.concat(F.lit("student-"), "c_custkey").alias("student_key"))
    c = F.col("c_custkey")
    had = A.table(spark, d, "customer").where(c % 2 == 0).select(F.concat(F.lit("student-"), c).alias("student_key"), (c % 7).alias("credits"), (c % 50).alias("points"), (c % 90).alias("lifetime"), (c % 4).alias("used"))
    return L.ledger_rows(L.wallet_steps(A.intents(spark, d), known, had))


_ABOUT = """'{{' || '"lessonNo":' || lesson_no || CASE WHEN selected_line IS NULL THEN '' ELSE ',"selectedLine":"' || selected_line || '"' END || CASE WHEN question IS NULL THEN '' ELSE ',"question":"' || question || '"' END || CASE WHEN tool_used IS NULL THEN '' ELSE ',"toolUsed":"' || tool_used || '"' END || '}}'""".replace("{{", "{").replace("}}", "}")
_KINDS = "CASE r.kind WHEN 'award' THEN 'EARN_POINTS' WHEN 'redeem' THEN 'REDEEM_POINTS' WHEN 'use' THEN 'USE_AI_CREDIT' WHEN 'admin' THEN 'ADMIN_ADD_CREDITS' END"
_REASON = """CASE r.kind WHEN 'award' THEN note WHEN 'redeem' THEN 'Redeemed ' || (-r.dp) || ' learning points for ' || r.dc || ' AI credit(s).' WHEN 'use' THEN 'Used 1 AI Teacher credit for ' || coalesce(tool_used, 'AI Teacher') || '.' ELSE 'Added ' || r.dc || ' AI Teacher credits manually for demo.' END"""
SQL["g14_ledger_rows"] = f"""WITH {WALLETS.replace("FROM intents GROUP BY 1)", "FROM (FROM intents WHERE kind <> 'admin' OR student_key IN (SELECT 'student-' || c_custkey FROM customer)) GROUP BY 1)").replace("{'credits': 0::BIGINT, 'points': 0::BIGINT, 'lifetime': 0::BIGINT, 'used': 0::BIGINT, 'open': false,",
    "CASE WHEN c_custkey IS NOT NULL THEN {'credits': CAST(c_custkey % 7 AS BIGINT), 'points': CAST(c_custkey % 50 AS BIGINT), 'lifetime': 0::BIGINT, 'used': 0::BIGINT, 'open': true, 'opened_with': 0::BIGINT, 'rejected': 0::BIGINT, 'rows': []::" + _ROW + "[]} ELSE {'credits': 0::BIGINT, 'points': 0::BIGINT, 'lifetime': 0::BIGINT, 'used': 0::BIGINT, 'open': false,").replace("[]}) AS w FROM lists)", "[]} END) AS w FROM lists LEFT JOIN (FROM customer WHERE c_custkey % 2 = 0) ON student_key = 'student-' || c_custkey)")}, r AS (SELECT unnest(w.rows) AS r FROM folded)
SELECT student_key, i.ts, event_id, {_KINDS} AS type, r.dp AS points_change, r.dc AS credits_change, {_REASON} AS reason, CASE WHEN r.kind = 'use' THEN {_ABOUT} END AS metadata_json FROM r JOIN intents i ON event_id = r.event_id"""


@query
def g14_wallet_view(spark, d):
    return L.wallet_view(L.ledger_rows(L.wallet_steps(A.intents(spark, d)))).select("*", "point_rules.*").drop("point_rules", "metadata_json")


SQL["g14_wallet_view"] = f"""WITH {WALLETS}, r AS (SELECT unnest(w.rows) AS r FROM folded), k AS (SELECT student_key, i.ts AS ts, event_id, {_KINDS} AS type, r.dp AS points_change, r.dc AS credits_change, {_REASON} AS reason,
row_number() OVER (PARTITION BY student_key ORDER BY i.ts DESC, event_id DESC) AS rank FROM r JOIN intents i ON event_id = r.event_id) SELECT *, 10 AS points_per_credit, 2 AS right_answer, 5 AS perfect_bonus, 10 AS game, 1 AS practice FROM k WHERE rank <= 10"""


def _shelf(spark, d):
    """Books, their pages and lines: a book for each source, a page for each of its documents."""
    docs = A.table(spark, d, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_id"), "text")
    lines = docs.select("page_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_number", "text"))
    return docs.select("book_id").distinct(), docs.select("book_id", "page_id", (F.col("page_id") % 50).alias("page_no")), lines


SHELF = f"""{A.DOC_LINES}, books AS (SELECT DISTINCT source AS book_id FROM documents), pages_ AS (SELECT source AS book_id, doc_id AS page_id, doc_id % 50 AS page_no FROM documents), lines_ AS (SELECT doc_id AS page_id, pos AS line_number FROM doc_lines)"""


@query
def g15_delete_students(spark, d):
    a = A.activity(spark, d)
    gone = a.where("k % 97 = 5").select("student_key").distinct()
    left = G.delete_students({"activity": a, "daily": _daily(spark, d)}, gone)
    books, pages, lines = G.delete_books(*_shelf(spark, d), A.table(spark, d, "documents").where("doc_id % 37 = 3").select(F.col("source").alias("book_id")).distinct())
    rows = [(left["activity"], "activity", "student_key"), (left["daily"], "daily", "student_key"), (books, "books", "book_id"), (pages, "pages", "book_id"), (lines, "lines", "page_id")]
    every = reduce(DataFrame.union, [t.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key_text")) for t, name, key in rows])
    return every.groupBy("table_name", "key_text").agg(F.count("*").alias("n"))


SQL["g15_delete_students"] = f"""WITH {DAILY}, {SHELF}, gone AS (SELECT DISTINCT student_key FROM activity WHERE k % 97 = 5), out_ AS (SELECT DISTINCT source FROM documents WHERE doc_id % 37 = 3),
every AS (SELECT 'activity' AS table_name, student_key AS key_text FROM activity ANTI JOIN gone USING (student_key) UNION ALL SELECT 'daily', student_key FROM daily ANTI JOIN gone USING (student_key)
UNION ALL SELECT 'books', book_id FROM books WHERE book_id NOT IN (FROM out_) UNION ALL SELECT 'pages', book_id FROM pages_ WHERE book_id NOT IN (FROM out_)
UNION ALL SELECT 'lines', CAST(page_id AS VARCHAR) FROM lines_ WHERE page_id IN (SELECT page_id FROM pages_ WHERE book_id NOT IN (FROM out_)))
SELECT table_name, key_text, count(*) AS n FROM every GROUP BY ALL"""


@query
def g16_check_keys(spark, d):
    a, (books, pages, lines) = A.activity(spark, d), _shelf(spark, d)
    found = {"students": a.where("k % 7 <> 0").select("student_key", F.concat(F.lit("mail-"), F.col("k") % 50).alias("email")).distinct(), "daily_study": a.select("student_key", "date_key"), "quiz_attempts": a.where("activity_type = 'quiz_submitted'"),
             "books": books.where("book_id <> 'src7'"), "book_pages": pages, "book_lines": lines.where("page_id % 11 <> 0").union(lines.where("page_id % 13 = 0"))}
    return G.check_all_keys(found)


SQL["g16_check_keys"] = f"""WITH {A.ACTIVITY}, {SHELF}, s AS (SELECT DISTINCT student_key, 'mail-' || (k % 50) AS email FROM activity WHERE k % 7 <> 0), l AS (SELECT * FROM lines_ WHERE page_id % 11 <> 0 UNION ALL SELECT * FROM lines_ WHERE page_id % 13 = 0)
SELECT 'students' AS table_name, 'unique' AS rule, student_key AS key_text, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'students', 'unique', email, count(*) FROM s GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'daily_study', 'unique', student_key || '|' || date_key, count(*) FROM activity GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'daily_study', 'orphan', student_key, count(*) FROM activity WHERE student_key NOT IN (SELECT student_key FROM s) GROUP BY ALL
UNION ALL SELECT 'quiz_attempts', 'orphan', student_key, count(*) FROM activity WHERE activity_type = 'quiz_submitted' AND student_key NOT IN (SELECT student_key FROM s) GROUP BY ALL
UNION ALL SELECT 'book_pages', 'unique', book_id || '|' || page_no, count(*) FROM pages_ GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'book_pages', 'orphan', book_id, count(*) FROM pages_ WHERE book_id = 'src7' GROUP BY ALL
UNION ALL SELECT 'book_lines', 'unique', page_id || '|' || line_number, count(*) FROM l GROUP BY page_id, line_number HAVING count(*) > 1"""


@query
def g17_register_students(spark, d):
    c, k = A.table(spark, d, "customer"), F.col("c_custkey")
    email = F.concat(F.lit("  "), F.upper("c_mktsegment"), F.lit("-"), (k % 100).cast("string"), F.lit("@x "))
    # customers of one nation have one name
    name = F.when(k % 13 != 0, F.concat(F.lit(" Ann  Lee "), F.col("c_nationkey").cast("string")))
    return G.register_students(c.select(k.alias("signup_id"), name.alias("name"), email.alias("email"), (k % 9 + 3).alias("password_length"), F.when(k % 2 == 0, 7).alias("class_level"), F.when(k % 3 == 0, " B ").alias("section"), F.col("c_mktsegment").alias("guardian_phone"), k.alias("ts"))).drop("created_at")


SQL["g17_register_students"] = """WITH s AS (SELECT c_custkey AS signup_id, CASE WHEN c_custkey % 13 <> 0 THEN 'Ann  Lee ' || c_nationkey ELSE '' END AS name, lower(c_mktsegment) || '-' || (c_custkey % 100) || '@x' AS email, c_custkey % 9 + 3 AS p, CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 6 END AS class_level,
CASE WHEN c_custkey % 3 = 0 THEN 'B' ELSE '' END AS section, c_mktsegment AS guardian_phone, c_nationkey FROM customer),
j AS (SELECT *, CASE WHEN name = '' THEN 'missing' WHEN p < 6 THEN 'short password' END AS r FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY email, r IS NULL ORDER BY signup_id) AS k FROM j)
SELECT signup_id, email, name, class_level, section, '' AS roll_number, '' AS school_name, '' AS guardian_name, guardian_phone, CASE WHEN r IS NOT NULL THEN r WHEN k > 1 THEN 'email taken' END AS reason,
CASE WHEN r IS NULL AND k = 1 THEN 'ann-lee-' || c_nationkey || '-' || substr(sha256(email), 1, 12) END AS student_key FROM n"""


@query
def g18_lesson_catalogue(spark, d):
    number = F.col("doc_id") % 33 + 1
    docs = A.table(spark, d, "documents").select(number.alias("lesson_no"), "text", F.when(number % 3 == 0, F.concat(F.lit("Name "), number)).alias("name"), F.when(number % 5 == 0, F.concat(F.lit("Title "), number)).alias("title"))
    return G.lesson_catalogue(docs, {"book_id": "b1", "book_title": "A book"})


SQL["g18_lesson_catalogue"] = "SELECT n AS lesson_no, CASE WHEN n % 5 = 0 THEN 'Title ' || n WHEN n % 3 = 0 THEN 'Name ' || n ELSE 'Lesson ' || n END AS title, count(*) AS n_texts, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, 'b1' AS book_id, 'A book' AS book_title FROM (SELECT *, doc_id % 33 + 1 AS n FROM documents) GROUP BY n"


@query
def g19_learning_turns(spark, d):
    turns = A.table(spark, d, "conversations").where("role = 'user'")
    turn, conv, line = F.col("turn"), F.col("conv_id"), F.split(F.col("text"), "\n")[0]
    requests = turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), (-(conv * 1000 + turn) - 1).alias("event_id"), F.when(conv % 11 != 0, F.concat(F.lit(" student-"), conv % 40)).alias("student_key"), F.lit(None).cast("string").alias("student_id"),
        (F.pmod(conv * 7 + turn, F.lit(200))).cast("int").alias("lesson_no"), line.alias("line"), F.element_at(F.array(*map(F.lit, ("explain", "translate", "grammar"))), (turn % 3 + 1).cast("int")).alias("tool"), F.when(turn % 2 == 0, F.col("text")).alias("question"),
        F.timestamp_seconds(F.lit(1_704_067_200) + conv * 600 + turn).alias("ts"),
    )
    part = F.struct(F.concat(F.lit("About: "), F.col("text")).alias("text"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(part).alias("parts")).alias("content"))).alias("candidates")))
    responses = turns.where("turn % 7 <> 3").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), body.alias("body"), (turn % 5 != 4).alias("ok"))
    doc = A.table(spark, d, "documents")  # a lesson each
    lessons = doc.select((F.col("doc_id") + 1).cast("int").alias("lesson_no"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"), F.concat(F.lit("Lesson "), F.col("doc_id") + 1).alias("title"))
    quizzes = A.activity(spark, d).where("activity_type = 'quiz_submitted'").select("student_key", "event_id", "ts")
    out = U.learning_turns(requests, A.intents(spark, d), lessons, quizzes, responses, _areas(spark, d))
    return out.withColumn("memory", F.to_json("memory"))


@query
def e12_public_questions(spark, d):
    c = F.col("c_custkey")
    key = A.table(spark, d, "customer").select(c.cast("string").alias("id"), F.lit("choice").alias("type"), F.concat(F.lit("Who is "), "c_name", F.lit("?")).alias("question"), F.array("c_mktsegment", "c_name").alias("options"), F.col("c_name").alias("answer"), (c % 3 + 1).cast("int").alias("mark"))
    return R.public_questions(key).withColumn("options", F.array_join("options", "|"))


SQL["e12_public_questions"] = "SELECT CAST(c_custkey AS VARCHAR) AS id, 'choice' AS type, 'Who is ' || c_name || '?' AS question, c_mktsegment || '|' || c_name AS options, c_custkey % 3 + 1 AS mark, count(*) OVER () AS total_questions, CAST(sum(c_custkey % 3 + 1) OVER () AS BIGINT) AS total_marks FROM customer"

_EXAM = [(f"q{i}", str(i * 3 % 11), i % 3 + 1) for i in range(1, 9)]


@query
def f1_grade_answer_key(spark, d):
    key = spark.createDataFrame(_EXAM, "id string, answer string, mark int")
    answers = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.struct(F.concat(F.lit("q"), i.cast("string")), F.pmod(F.col("k") + i * i, F.lit(11)).cast("string"))))
    return R.grade_answer_key(A.activity(spark, d).select(F.col("event_id").alias("submission_id"), answers.alias("answers")), key)


SQL["f1_grade_answer_key"] = f"""WITH {A.ACTIVITY}, exam(i, answer, mark) AS (VALUES {', '.join(f"({q[1:]}, '{a}', {m})" for q, a, m in _EXAM)}),
g AS (SELECT event_id AS submission_id, CAST(sum(CASE WHEN i <= 7 AND CAST((k + i * i) % 11 AS VARCHAR) = answer THEN mark ELSE 0 END) AS BIGINT) AS score, CAST(sum(mark) AS BIGINT) AS total FROM activity, exam GROUP BY event_id)
SELECT *, {S.percent('score', 'total')} AS accuracy FROM g"""


@query
def f2_grade_by_index(spark, d):
    return R.grade_by_index(A.activity(spark, d).select(F.col("student_key").alias("attempt_id"), F.when(F.col("k") % 9 != 0, F.col("k") % 4).alias("chosen"), (F.col("event_id") % 4).alias("correct_index")))


SQL["f2_grade_by_index"] = f"WITH {A.ACTIVITY}, g AS (SELECT student_key AS attempt_id, count(*) FILTER (WHERE k % 9 <> 0 AND k % 4 = event_id % 4) AS score, count(*) AS total FROM activity GROUP BY 1) SELECT *, {S.percent('score', 'total')} AS pct FROM g"


@query
def f3_attempt_detail(spark, d):
    area = F.when(F.col("k") % 3 == 0, "Grammar").when(F.col("k") % 3 == 1, "Vocabulary")
    items = A.activity(spark, d).select(F.concat_ws("|", "student_key", "date_key").alias("attempt_id"), F.col("event_id").alias("pos"), (F.col("k") % 4).alias("chosen"), (F.col("event_id") % 4).alias("answer"), area.alias("area"))
    return R.attempt_detail(items).select("attempt_id", F.array_join("wrong", ",").alias("wrong"), F.array_join("areas", ",").alias("areas"))


SQL["f3_attempt_detail"] = f"""WITH {A.ACTIVITY}, i AS (SELECT student_key || '|' || date_key AS attempt_id, event_id, k % 4 <> event_id % 4 AS bad, CASE k % 3 WHEN 0 THEN 'Grammar' WHEN 1 THEN 'Vocabulary' ELSE 'General' END AS area FROM activity),
w AS (SELECT attempt_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE bad) AS wrong FROM i GROUP BY 1), f AS (SELECT attempt_id, area, min(event_id) AS t FROM i WHERE bad GROUP BY ALL), s AS (SELECT attempt_id, string_agg(area, ',' ORDER BY t) AS areas FROM f GROUP BY 1)
SELECT attempt_id, coalesce(wrong, '') AS wrong, coalesce(areas, '') AS areas FROM w LEFT JOIN s USING (attempt_id)"""


@query
def f4_grade_sentence(spark, d):
    line = F.col("line")
    given = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("  "), F.regexp_replace(line, ",", ""))).otherwise(F.concat(line, F.lit(" x")))
    return A.doc_lines(spark, d).select("doc_id", "pos", R.grade_sentence(given, line).alias("sentence"), R.grade_detective(F.when(F.col("pos") % 3 != 1, line).otherwise(given), line).alias("detective"))


SQL["f4_grade_sentence"] = f"SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN 10 ELSE 0 END AS sentence, CASE WHEN pos % 3 <> 1 THEN 10 ELSE 0 END AS detective FROM (WITH {A.DOC_LINES} SELECT * FROM doc_lines)"


@query
def f5_replay_match(spark, d):
    e = A.mapped_events(spark, d, A.MOVES)
    moves = e.select(F.concat_ws("|", "user_id", F.substring("date_key", 1, 7)).alias("session_id"), "ts", "event_id", "kind", F.when(F.col("user_id") % 2 == 0, "hard").alias("difficulty"), (F.col("k") % 150).alias("seconds"), F.lit(6).alias("n_pairs"))
    return R.replay_match(moves, ["ts", "event_id"])


def _f5() -> str:
    over = "acc.done >= 6"
    right, wrong, hint, skip = f"(x.kind = 'correct' AND NOT {over})", f"(x.kind = 'wrong' AND NOT {over})", f"(x.kind = 'hint' AND NOT {over} AND acc.hinted = 0)", f"(x.kind = 'skip' AND acc.done < 5)"
    streak = f"(CASE WHEN {right} THEN acc.streak + 1 WHEN {wrong} OR {skip} THEN 0 ELSE acc.streak END)"
    gain = f"(CASE WHEN {right} THEN x.base + least(10 * {streak}, 50) - 15 * acc.hinted WHEN {wrong} THEN -10 WHEN {hint} OR {skip} THEN -5 ELSE 0 END)"
    one = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
    new = {
        "score": f"greatest(acc.score + {gain}, 0) + CASE WHEN {right} AND acc.done = 5 THEN greatest(120 - x.seconds, 0) ELSE 0 END", "streak": streak, "best": f"greatest(acc.best, {streak})", "moves": f"acc.moves + {one(f'({right} OR {wrong})')}",
        "mistakes": f"acc.mistakes + {one(wrong)}", "hints": f"acc.hints + {one(hint)}", "skips": f"acc.skips + {one(skip)}", "done": f"acc.done + {one(right)}", "hinted": f"CASE WHEN {right} OR {skip} THEN 0 WHEN {hint} THEN 1 ELSE acc.hinted END",
    }
    names = [n for n in new if n != "hinted"]
    return f"""WITH m AS (SELECT user_id || '|' || strftime(ts + INTERVAL 6 HOUR, '%Y-%m') AS session_id, ts, event_id, {A._case(A.MOVES)} AS kind, CASE WHEN user_id % 2 = 0 THEN 130 ELSE 100 END AS base, CAST(json_extract(props, '$.k') AS INTEGER) % 150 AS seconds FROM events),
l AS (SELECT session_id, list({{'kind': kind, 'base': base, 'seconds': seconds}} ORDER BY ts, event_id) AS m FROM m GROUP BY 1),
g AS (SELECT session_id, list_reduce(m, lambda acc, x: {{{', '.join(f"'{n}': CAST({e} AS BIGINT)" for n, e in new.items())}}}, {{{', '.join(f"'{n}': 0::BIGINT" for n in new)}}}) AS g FROM l)
SELECT session_id, {', '.join(f'g.{n}' for n in names)}, {S.percent('g.done', '6')} AS progress FROM g"""


SQL["f5_replay_match"] = _f5()
