"""Quiz and matching items: validation of generated ones, local fallbacks, top-ups.

A context is what context.combined_context gives, at most 8000 characters, so its sentences are one array and each item set one
fold over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lessonlake.functions import text as T

#: Words that are no answers or distractors (fixed values).
POOL_STOP = ("this", "that", "with", "from", "have", "were", "they", "their", "there", "about", "after", "before", "would", "could", "should", "which", "where")
ANSWER_STOP = ("there", "their", "about", "after", "before", "which", "where", "would", "could", "should")
#: Words that grammar questions ask for (fixed values).
BE = ("am", "is", "are", "was", "were")
PREPOSITIONS = ("in", "on", "at", "from", "to", "with", "for", "of", "by")
CONJUNCTIONS = ("and", "but", "or", "because")
#: Texts of items (fixed values).
EXPLANATION = "The answer is supported by the textbook context."
LEAD, COMPLETES = "Choose the correct word to complete the sentence: ", '" correctly completes the sentence from the textbook.'
UNTITLED = "Choose the best answer."
_STRINGS = "question string, prompt string, questionText string, options array<string>, choices array<string>, answers array<string>, correctAnswerIndex string, answerIndex string, correctIndex string, correctAnswer string, answer string, explanation string, reason string"
_PAIR = "left string, prompt string, term string, first string, right string, match string, meaning string, second string, explanation string"


def _first(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def _rows(body: Column, fields: str, name: str) -> Column:
    """The items of a JSON array, or of the named array of a JSON object; none for anything else."""
    j = T.let(T.extract_json(body, "array" if name == "questions" else "object"), lambda x: F.when(x.startswith("["), F.from_json(x, f"array<struct<{fields.replace(' ', ':')}>>".replace(",:", ","))).otherwise(F.from_json(x, f"struct<{name}:array<struct<{fields.replace(' ', ':')}>>>".replace(",:", ","))[name]))
    return F.coalesce(j, F.array())


def _values(body: Column, name: str) -> Column:
    """The same items as JSON values, whose kinds can be told."""
    j = F.try_parse_json(T.extract_json(body, "array" if name == "questions" else "object"))
    return T.let(j, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, f"$.{name}", "array<variant>")))


def _index(item: Column) -> Column:
    """The first index field of an item that isn't null or missing, as a number."""
    found = [F.try_variant_get(item, f"$.{c}", "variant") for c in ("correctAnswerIndex", "answerIndex", "correctIndex")]
    real = [F.when(F.schema_of_variant(v) != "VOID", v) for v in found]
    return T.js_number_of(F.coalesce(*real))


def validate_quiz(responses: DataFrame, n: int = 5) -> DataFrame:
    """responses(request_id, body) -> request_id, position, question, options, correct_index, explanation.

    Options that are equal but for case count once: at the first one's place, in the last one's spelling.
    """
    rows, values = _rows(F.col("body"), _STRINGS, "questions").alias("q"), _values(F.col("body"), "questions").alias("value")
    said = responses.select("request_id", rows, values).select("request_id", F.transform(F.arrays_zip("q", "value"), lambda x, at: F.struct(at.alias("at"), x["q"].alias("q"), x["value"].alias("value"))).alias("items"))
    option = lambda o: T.clean_line(F.when(o.startswith("{"), F.coalesce(F.get_json_object(o, "$.text"), F.get_json_object(o, "$.value"), F.get_json_object(o, "$.label"))).otherwise(o))
    last = lambda o: F.transform(F.array_distinct(F.transform(o, F.lower)), lambda k: F.element_at(F.filter(o, lambda x: F.lower(x) == k), -1))
    kind = "array<struct<at:int,question:string,options:array<string>,correct_index:int,explanation:string>>"

    def add(acc: Column, x: Column) -> Column:
        """acc with x, if x is valid; x is not looked at where acc is full. Inlined columns would be computed again at each use."""
        q = x["q"]
        options = F.filter(F.transform(F.coalesce(q["options"], q["choices"], q["answers"]), option), lambda o: ~T.is_clean_junk(o))

        def indexed(u: Column) -> Column:
            place = F.array_position(F.transform(u, F.lower), F.lower(T.clean_line(F.coalesce(q["correctAnswer"], q["answer"])))).cast("int") - 1
            index = T.let(_index(x["value"]), lambda i: F.when((i == F.floor(i)) & i.between(0, 3), i.cast("int")).otherwise(place))
            return T.let(F.struct(T.clean_line(F.coalesce(q["question"], q["prompt"], q["questionText"])).alias("question"), index.alias("index")), lambda c: judged(u, c["question"], c["index"]))

        def judged(u: Column, question: Column, index: Column) -> Column:
            item = F.struct(x["at"].alias("at"), question.alias("question"), u.alias("options"), index.alias("correct_index"), F.coalesce(q["explanation"], q["reason"], F.lit(EXPLANATION)).alias("explanation"))
            return F.when((F.length(question) >= 10) & index.between(0, 3) & ~T.is_clean_junk(question), F.concat(acc, F.array(item)).cast(kind)).otherwise(acc)

        tried = T.let(options, lambda o: T.let(last(o), lambda u: F.when(F.size(u) == 4, indexed(u)).otherwise(acc)))
        return F.when((F.size(acc) >= n) | q.isNull(), acc).otherwise(tried).cast(kind)

    good = said.select("request_id", F.inline(F.aggregate("items", F.array().cast(kind), add)))
    position = F.row_number().over(Window.partitionBy("request_id").orderBy("at"))
    said = T.clean_line(F.col("explanation"))
    return good.withColumn("position", position).where(F.col("position") <= n).select("request_id", "position", "question", "options", "correct_index", F.when(said == "", EXPLANATION).otherwise(said).alias("explanation"))


def fallback_quiz(contexts: DataFrame, n: int = 5) -> DataFrame:
    """contexts(request_id, context) -> as validate_quiz. The distractors' slice moves on with each question made."""
    prepared = contexts.select("request_id", T.split_sentences(F.col("context")).alias("s"))
    pool = F.array_distinct(F.filter(F.transform(F.flatten(F.transform("s", lambda x: F.regexp_extract_all(x, F.lit("[A-Za-z]{4,}"), F.lit(0)))), F.lower), lambda w: ~w.isin(*POOL_STOP)))
    answer = lambda x: _first(F.regexp_extract_all(x, F.lit("[A-Za-z]{5,}"), F.lit(0)), lambda w: ~F.lower(w).isin(*ANSWER_STOP))
    rows = prepared.select("request_id", pool.alias("pool"), F.transform("s", lambda x: F.struct(x.alias("s"), answer(x).alias("a"))).alias("s"))
    kind = "array<struct<question:string,options:array<string>,answer:string>>"

    def add(acc: Column, x: Column) -> Column:
        near = F.filter("pool", lambda w: (w != F.lower(x["a"])) & (F.abs(F.length(w) - F.length(x["a"])) <= 4))
        d = F.slice(near, F.size(acc) + 1, 3)
        # the first whole-word hit, in ASCII terms, whatever its case
        blank = F.regexp_replace(x["s"], F.concat(F.lit(r"(?is)^(.*?)(?<![A-Za-z0-9_])"), x["a"], F.lit(r"(?![A-Za-z0-9_])")), F.lit("$1_____"))
        item = F.struct(F.concat(F.lit(LEAD), blank).alias("question"), F.array(F.initcap(F.get(d, F.lit(0))), x["a"], F.initcap(F.get(d, F.lit(1))), F.initcap(F.get(d, F.lit(2)))).alias("options"), x["a"].alias("answer"))
        return F.when((F.size(acc) >= n) | x["a"].isNull(), acc).when(F.size(d) < 3, acc).otherwise(F.concat(acc, F.array(item))).cast(kind)

    made = rows.select("request_id", F.posexplode(F.aggregate("s", F.array().cast(kind), add)).alias("at", "q"))
    return made.select("request_id", (F.col("at") + 1).alias("position"), "q.question", "q.options", F.lit(1).alias("correct_index"), F.concat(F.lit('"'), "q.answer", F.lit(COMPLETES)).alias("explanation"))


def top_up(valid: DataFrame, fallback: DataFrame, key: str, least: int, n: int, need: int = 1, distinct: bool = False) -> DataFrame:
    """Requests with fewer than least valid items get fallback ones whose key no valid one has, up to n; under need, none at all.

    distinct: nor one that a fallback item before it has, as in pairs; in a quiz equal fallback questions all stay.
    """
    count = valid.groupBy("request_id").count()
    short = fallback.join(count, "request_id", "left").where(F.coalesce("count", F.lit(0)) < least).drop("count")
    every = valid.withColumn("part", F.lit(0)).unionByName(short.withColumn("part", F.lit(1))).withColumn("k", F.lower(key))
    same = Window.partitionBy("request_id", "k")
    ranked = every.withColumn("first", F.min("part").over(same)).withColumn("seen", F.row_number().over(same.orderBy("part", "position")))
    kept = ranked.where("part = 0 OR seen = 1" if distinct else "part = 0 OR first = 1")
    w = Window.partitionBy("request_id")
    placed = kept.withColumn("at", F.row_number().over(w.orderBy("part", "position"))).where(F.col("at") <= n).withColumn("total", F.count("*").over(w))
    return placed.where(F.col("total") >= need).drop("k", "first", "seen", "total", "position").withColumnRenamed("at", "position")


def validate_pairs(responses: DataFrame, n: int = 6) -> DataFrame:
    """responses(request_id, body) -> request_id, position, left, right. Greedy: a side used by a kept pair isn't used again."""
    raw = F.transform(_rows(F.col("body"), _PAIR, "pairs"), lambda p: F.struct(T.clean_line(F.coalesce(p["left"], p["prompt"], p["term"], p["first"])).alias("left"), T.clean_line(F.coalesce(p["right"], p["match"], p["meaning"], p["second"])).alias("right")))
    good = F.filter(raw, lambda p: ~T.is_clean_junk(p["left"], 3) & ~T.is_clean_junk(p["right"], 3) & (F.length(p["left"]) >= 4) & (F.length(p["right"]) >= 4) & (F.lower(p["left"]) != F.lower(p["right"])))

    def add(acc: Column, p: Column) -> Column:
        used = F.exists(acc, lambda k: (F.lower(k["left"]) == F.lower(p["left"])) | (F.lower(k["right"]) == F.lower(p["right"])))
        return F.when((F.size(acc) >= n) | used, acc).otherwise(F.concat(acc, F.array(p)))

    made = responses.select("request_id", good.alias("p")).select("request_id", F.posexplode(F.aggregate("p", F.slice("p", 1, 0), add)).alias("at", "p"))
    return made.select("request_id", (F.col("at") + 1).alias("position"), "p.left", "p.right")


def fallback_pairs(contexts: DataFrame, n: int = 6) -> DataFrame:
    """contexts(request_id, context): sentences of 8 words or more, cut in the middle; the first n whose halves aren't junk."""

    def pair(s: Column) -> Column:
        def cut(w: Column) -> Column:
            half = F.ceil(F.size(w) / 2).cast("int")
            left, right = F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " ")
            return F.when(F.size(w) >= 8, F.struct(T.clean_line(F.concat(left, F.lit(" ..."))).alias("left"), T.clean_line(F.concat(F.lit("... "), right)).alias("right"), s.alias("explanation")))

        return T.let(F.split(s, rf"{T.WS}+"), cut)

    def add(acc: Column, s: Column) -> Column:  # sentences beyond the first n pairs aren't cut
        ok = lambda p: p.isNotNull() & ~T.is_clean_junk(p["left"], 3) & ~T.is_clean_junk(p["right"], 3)
        return F.when(F.size(acc) >= n, acc).otherwise(T.let(pair(s), lambda p: F.when(ok(p), F.concat(acc, F.array(p))).otherwise(acc))).cast(kind)

    kind = "array<struct<left:string,right:string,explanation:string>>"
    good = F.aggregate(T.split_sentences(F.col("context"), 22, 3), F.array().cast(kind), add)
    return contexts.select("request_id", F.posexplode(good).alias("at", "p")).select("request_id", "p.*", (F.col("at") + 1).alias("position"))


def coerce_quiz_items(responses: DataFrame) -> DataFrame:
    """responses(request_id, body), a JSON object with questions or quiz -> request_id, position, item_id, question, context, options,
    correct_answer, explanation, weak_area. An item without options or answer goes; its place in the list stays the default id."""
    fields = "id:string,question:string,context:string,options:array<string>,correctAnswer:string,correctAns:string,explanation:string,weakArea:string"
    parsed = F.from_json("body", f"questions array<struct<{fields}>>, quiz array<struct<{fields}>>")
    rows = responses.select("request_id", F.posexplode(T.let(parsed, lambda p: F.coalesce(p["questions"], p["quiz"]))).alias("at", "q"))
    out = rows.select(
        "request_id", (F.col("at") + 1).alias("position"), F.coalesce("q.id", (F.col("at") + 1).cast("string")).alias("item_id"), F.coalesce("q.question", F.lit(UNTITLED)).alias("question"), "q.context",
        F.coalesce("q.options", F.array().cast("array<string>")).alias("options"), F.coalesce("q.correctAnswer", "q.correctAns", F.lit("")).alias("correct_answer"), "q.explanation", F.col("q.weakArea").alias("weak_area"),
    )
    return out.where((F.size("options") > 0) & (F.col("correct_answer") != ""))


def lesson_quiz(lessons: DataFrame) -> DataFrame:
    """lessons(lesson_no, text): up to 5 lines, each with 3 other lines as wrong options; lessons of under 4 lines give none."""
    rows = lessons.select("lesson_no", T.lesson_quiz_lines(F.col("text")).alias("lines")).where(F.size("lines") >= 4)
    asked = rows.select("lesson_no", "lines", F.posexplode(T.pick(F.col("lines"), 5, F.col("lesson_no"))).alias("at", "right"))
    seed = F.xxhash64("lesson_no", "at")
    wrong = T.pick(F.filter("lines", lambda x: x != F.col("right")), 3, seed)
    return asked.select("lesson_no", "at", "right", T.seeded_shuffle(F.concat(F.array("right"), wrong), seed).alias("options"), T.weak_area(F.col("right")).alias("area"))


def grammar_question(line: Column) -> Column:
    """struct(kind, answer, options) of the first rule that fires; options are unshuffled and may repeat."""
    words = T.split_words(line)
    among = lambda w, values: _first(w, lambda x: F.lower(x).isin(*values))

    def built(w: Column) -> Column:
        past = F.regexp_extract(line, r"(?i)(?<![A-Za-z0-9_])(?:was|were)\s+[A-Za-z0-9_]+ing(?![A-Za-z0-9_])", 0)
        be, prep, conj, first = among(w, BE), among(w, PREPOSITIONS), among(w, CONJUNCTIONS), F.get(w, F.lit(0))
        last = F.get(w, F.size(w) - 1)
        row = lambda kind, answer, *o: F.struct(F.lit(kind).alias("kind"), answer.alias("answer"), F.array(*o).alias("options"))
        of = lambda c, default: F.coalesce(c, F.lit(default))
        return (
            F.when(past != "", row("past continuous", past, past, of(first, "The"), of(prep, "at"), of(last, "station")))
            .when(be.isNotNull(), row("be-verb", be, be, of(first, "The"), of(prep, "in"), of(conj, "and")))
            .when(prep.isNotNull(), row("preposition", prep, prep, of(first, "The"), of(last, "school"), of(conj, "and")))
            .when(conj.isNotNull(), row("conjunction", conj, conj, of(first, "The"), of(last, "school"), of(prep, "in")))
            .otherwise(row("word", F.coalesce(first, line), F.coalesce(first, line), F.lit("computer"), F.lit("mountain"), F.lit("airport")))
        )

    return T.let(words, built)


def word_bank(line: Column, seed: Column) -> Column:
    return T.seeded_shuffle(T.split_words(line), seed)


def match_choices(pairs: DataFrame) -> DataFrame:
    """pairs(request_id, position, left, right) -> each pair with its right side and up to 3 of the set's others, shuffled. A set has 8 pairs at most."""
    sets = pairs.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", "right"))).alias("set"))
    joined = pairs.join(sets, "request_id")
    seed = F.xxhash64("request_id", "position")
    others = T.pick(F.transform(F.filter("set", lambda x: x["position"] != F.col("position")), lambda x: x["right"]), 3, seed)
    return joined.select("request_id", "position", "left", T.seeded_shuffle(F.concat(F.array("right"), others), seed).alias("choices"))
