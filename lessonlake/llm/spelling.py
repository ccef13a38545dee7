"""Spelling variants: words one edit apart, each with the far commoner word that it probably stands for.

A word's frequency vector holds how many of its letters fall in each of GROUPS letter groups. The words form a trie by successive
counts. One inserted, deleted or replaced code point adds at most one to one count and takes at most one from one count, so a word's
near words are found by a walk down the trie that has a surplus of one and a deficit of one to spend; the words at the leaves
reached are verified letter by letter. Of two words only the one whose vector comes first walks, so each pair is met once: its
first difference is a surplus.

1. The top levels of the trie are walked as joins with the nodes that exist, DEPTH groups a step: a subtree of at most
   SUBTREE_WORDS words is one task's; a larger one is opened by the next groups. Nodes are counted before they travel.
2. A task holds one subtree and walks it depth first, with all askers of a batch at once; a subtree with many askers stands in several
   parts. Only at full depth (words of one vector) may a subtree be larger than SUBTREE_WORDS.
3. Forms are aggregated pair by pair, and roots found by pointer jumping: each form is five times as frequent, so chains are short.

Defined results: null and empty texts have no words; rows with a null doc_id count, and their runs lose no letter; rows that
share a doc_id count each time; a run of any length is one word; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonlake.llm.common import Tables, materialise

#: A word's letters, lower-cased: ASCII letters and U+00C0 to U+00FF.
LETTERS = "a-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent as its variant.
TIMES = 5
#: One in so many runs of a text loses a letter, as its checksum says.
ONE_IN = 199
#: Words that a task counts before it passes them on.
HELD_WORDS = 1 << 18
GROUPS = 16
#: Letter groups that one join opens.
DEPTH = 4
SUBTREE_WORDS = 20_000
#: Askers of a subtree in one task.
ASK_ROWS = 200_000
#: Pairs that are compared by their vectors without going deeper.
GRID = 4096
#: Leaves that are verified at once.
CHECKED = 1 << 17
PAIRS = "a string, na long, b string, nb long"
RESULT = "word string, form string, root string, n long, n_near long, form_n long"


def word_counts(documents: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """documents(doc_id, text) -> word, n: the distinct words of at least LEAST_LETTERS code points, with at least so many occurrences.

    A task adds up what it has read before anything travels, HELD_WORDS words at a time.
    """
    runs_of = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                runs = Counter(runs_of.findall((text or "").encode("utf-8", "replace").lower().decode()))
                start = zlib.crc32(b"%d:" % doc) if doc is not None else None
                for run, n in runs.items():
                    if start is not None and (h := zlib.crc32(run.encode(), start)) % ONE_IN == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LETTERS:
                            continue
                    held[run] += n
            if len(held) > HELD_WORDS:
                yield batch()
        yield batch()

    counted = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_groups(words: DataFrame) -> list[str]:
    """The letters of all words dealt to GROUPS groups of about the same frequency; there are some ninety letters at most."""
    found = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c").collect()
    dealt = [[] for _ in range(GROUPS)]
    for i, r in enumerate(found):
        turn, at = divmod(i, GROUPS)
        dealt[GROUPS - 1 - at if turn % 2 else at].append(r.c)
    return ["".join(g) for g in dealt]


def counts_of(word: Column, groups: list[str]) -> Column:
    return F.array(*[F.length(word) - F.length(F.translate(word, g, "")) if g else F.lit(0) for g in groups]).cast("array<int>")


def steps(n: int) -> list[tuple[list[int], int, int]]:
    """The ways to spend on n counts: (changes, surplus, deficit), the first change being a surplus unless one was spent before."""
    flat = [0] * n

    def changed(*at: tuple[int, int]) -> list[int]:
        return [dict(at).get(i, 0) for i in range(n)]

    out = [(flat, 0, 0)]
    out += [(changed((i, 1)), 1, 0) for i in range(n)]
    out += [(changed((i, -1)), 0, 1) for i in range(n)]
    return out + [(changed((i, 1), (j, -1)), 1, 1) for i in range(n) for j in range(n) if i != j]


class Letters:
    """Words as rows of code points, from the left and from the right. PAD ends the longer of two words where they are compared."""

    PAD = 0

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.width = int(self.size.max(initial=1))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint16)
        row, begin = np.repeat(np.arange(len(words)), self.size), np.cumsum(self.size) - self.size
        at = np.arange(len(points)) - begin[row]
        self.left, self.right = (np.full((len(words), self.width), self.PAD, np.uint16) for _ in range(2))
        self.left[row, at] = points
        self.right[row, self.size[row] - 1 - at] = points


def one_edit(a: Letters, x: np.ndarray, b: Letters, y: np.ndarray) -> np.ndarray:
    """Whether word x of a and word y of b differ by exactly one inserted, deleted or replaced code point: all but one letter of the
    longer lie in a common beginning and a common end."""
    long, short = np.maximum(a.size[x], b.size[y]), np.minimum(a.size[x], b.size[y])
    width = min(a.width, b.width)
    head, tail = (np.where((apart := p[x, :width] != q[y, :width]).any(1), apart.argmax(1), width) for p, q in ((a.left, b.left), (a.right, b.right)))
    head, tail = np.minimum(head, short), np.minimum(tail, short)
    return (long - short <= 1) & (head + tail >= long - 1) & ~((long == short) & (head == long))


class Trie:
    """Words in the order of their vectors; a node is a range of them."""

    def __init__(self, words: list[str], n: list[int], vectors: np.ndarray):
        order = np.lexsort(vectors.T[::-1])
        self.vectors, self.words, self.n = vectors[order], [words[i] for i in order], np.array(n, np.int64)[order]
        self.letters = Letters(self.words)

    def walk(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asker, word) of the leaves that askers reach, about CHECKED pairs at a time. Nodes of few words are compared as a whole."""
        stack = [(0, 0, len(self.words), np.arange(len(vectors)), np.zeros(len(vectors), np.int16), np.zeros(len(vectors), np.int16))]
        reached, n = [], 0
        while stack:
            level, lo, hi, q, more, less = stack.pop()
            if level == vectors.shape[1] or (hi - lo) * len(q) <= GRID:
                size = max(1, CHECKED // (hi - lo))
                for part in (slice(i, i + size) for i in range(0, len(q), size)):
                    apart = self.vectors[None, lo:hi, level:] - vectors[q[part], None, level:]
                    up = more[part, None] + np.maximum(apart, 0).sum(2)
                    down = less[part, None] - np.minimum(apart, 0).sum(2)
                    x, y = np.nonzero((up <= 1) & (down <= up))
                    both = np.flatnonzero((down[x, y] == 1) & (more[part][x] == 0))  # is the surplus first?
                    late = (apart[x[both], y[both]] > 0).argmax(1) > (apart[x[both], y[both]] < 0).argmax(1) if len(both) else both
                    ok = np.ones(len(x), bool)
                    ok[both[late.astype(bool)]] = False
                    reached.append((q[part][x[ok]], lo + y[ok]))
                    n += int(ok.sum())
                    if n > CHECKED:
                        yield tuple(map(np.concatenate, zip(*reached)))
                        reached, n = [], 0
                continue
            column, own = self.vectors[lo:hi, level], vectors[q, level]
            start = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
            for i, j in zip(start.tolist(), [*start[1:].tolist(), hi - lo]):
                apart = column[i] - own
                up, down = more + np.maximum(apart, 0), less + np.maximum(-apart, 0)
                ok = (up <= 1) & (down <= up)  # a deficit comes after the surplus
                if ok.any():
                    stack.append((level + 1, lo + i, lo + j, q[ok], up[ok], down[ok]))
        if reached:
            yield tuple(map(np.concatenate, zip(*reached)))

    def pairs(self, words: list[str], n: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The verified pairs of these askers with the trie's words. Of one vector, the smaller word asks."""
        asking = Letters(words)
        for x, y in self.walk(vectors):
            ok = one_edit(asking, x, self.letters, y)
            x, y = x[ok], y[ok]
            same = (vectors[x] == self.vectors[y]).all(1)
            found = [(i, j) for i, j, s in zip(x.tolist(), y.tolist(), same.tolist()) if not s or words[i] < self.words[j]]
            i, j = (np.array(c, np.int64) for c in (zip(*found) if found else ((), ())))
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in i], pa.string()), pa.array(n[i]), pa.array([self.words[k] for k in j], pa.string()), pa.array(self.n[j])], ["a", "na", "b", "nb"])


def walk_subtrees(rows: DataFrame) -> DataFrame:
    """rows(node, part, ask, word, n, v), sorted within partitions by node, part and ask -> PAIRS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, trie, held = None, None, ([], [], [])
        for b in batches:
            node = list(zip(b.column("node").to_pylist(), b.column("part").to_pylist()))
            ask, words, n = b.column("ask").to_pylist(), b.column("word").to_pylist(), b.column("n").to_numpy()
            v = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1).astype(np.int16)
            i = 0
            while i < b.num_rows:
                j = i
                while j < b.num_rows and node[j] == node[i] and ask[j] == ask[i]:
                    j += 1
                if node[i] != last:
                    last, trie, held = node[i], None, ([], [], [])
                if not ask[i]:
                    held[0].extend(words[i:j])
                    held[1].extend(n[i:j].tolist())
                    held[2].append(v[i:j])
                elif held[0]:
                    trie = trie or Trie(held[0], held[1], np.concatenate(held[2]))
                    yield from trie.pairs(words[i:j], n[i:j], v[i:j])
                i = j

    return rows.select("node", "part", "ask", "word", "n", "v").mapInArrow(run, PAIRS)


def subtrees(words: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """words(word, n, v) -> (homes, asks): node, word, n, v. A word is at home in one subtree and asks in each that its budget allows."""
    homes, asks = [], []
    own = words
    open_ = words.select("*", F.lit(0).alias("up"), F.lit(0).alias("down"), F.array().cast("array<int>").alias("path"))
    for depth in range(DEPTH, GROUPS + 1, DEPTH):
        node = F.concat_ws(",", F.slice("v", 1, depth).cast("array<string>"))
        own = own.withColumn("node", node)
        nodes = tables.write(own.groupBy("node").count().select("node", (F.lit(depth == GROUPS) | (F.col("count") <= SUBTREE_WORDS)).alias("light")))
        own = own.join(nodes, "node")
        homes.append(own.where("light").select("node", "word", "n", "v"))
        ways = F.array(*[F.struct(F.array(*map(F.lit, d)).cast("array<int>").alias("d"), F.lit(u).alias("u"), F.lit(w).alias("w"), F.lit(next((x for x in d if x), 1) > 0).alias("first")) for d, u, w in steps(DEPTH)])
        # a deficit before any surplus is another word's to ask
        walked = open_.select("*", F.explode(F.filter(ways, lambda x: (F.col("up") + x["u"] <= 1) & (F.col("down") + x["w"] <= 1) & (x["first"] | (F.col("up") == 1)))).alias("way"))
        walked = walked.select("word", "n", "v", (F.col("up") + F.col("way.u")).alias("up"), (F.col("down") + F.col("way.w")).alias("down"), F.concat("path", F.zip_with(F.slice("v", depth - DEPTH + 1, DEPTH), "way.d", lambda a, b: a + b)).alias("path"))
        walked = walked.withColumn("node", F.concat_ws(",", F.col("path").cast("array<string>"))).join(nodes, "node")
        asks.append(walked.where("light").select("node", "word", "n", "v"))
        if nodes.where("NOT light").isEmpty():
            break
        own, open_ = tables.write(own.where("NOT light").select("word", "n", "v")), tables.write(walked.where("NOT light").select("word", "n", "v", "up", "down", "path"))
    return reduce(DataFrame.union, homes), reduce(DataFrame.union, asks)


def near_pairs(words: DataFrame, tables: Tables) -> DataFrame:
    """words(word, n) -> PAIRS: each pair of words one edit apart, once."""
    groups = letter_groups(words)
    homes, asks = subtrees(tables.write(words.select("word", "n", counts_of(F.col("word"), groups).alias("v"))), tables)
    asks = tables.write(asks)
    wide = tables.write(asks.groupBy("node").count().where(F.col("count") > ASK_ROWS).select("node", F.ceil(F.col("count") / ASK_ROWS).cast("int").alias("parts")))
    if wide.isEmpty():
        homes, asks = homes.withColumn("part", F.lit(0)), asks.withColumn("part", F.lit(0))
    else:
        parts = F.coalesce("parts", F.lit(1))
        homes = homes.join(wide, "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        asks = asks.join(wide, "node", "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int")).drop("parts")
    rows = homes.withColumn("ask", F.lit(False)).unionByName(asks.withColumn("ask", F.lit(True)))
    return walk_subtrees(rows.repartition("node", "part").sortWithinPartitions("node", "part", "ask"))


def roots(forms: DataFrame, tables: Tables) -> DataFrame:
    """forms(word, form), no form null -> word, root: the last form of each word's chain, by pointer jumping."""
    hops = tables.write(forms.select("word", F.col("form").alias("root")))
    while True:
        up = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = tables.write(hops.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        tables.drop(hops)
        hops = jumped
        if jumped.where("moved").isEmpty():
            return jumped.select("word", "root")


def spelling_variants(documents: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """documents(doc_id, text) -> RESULT: a row a word."""
    with Tables(documents.sparkSession) as tables:
        words = tables.write(word_counts(documents, least))
        pairs = tables.write(near_pairs(words, tables))
        both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("k")).union(pairs.select("b", "a", "na"))
        best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("k")).alias("k"), "other")).alias("best"))
        fits = -F.col("best.k") >= TIMES * F.col("n")
        named = tables.write(
            words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.k")).alias("form_n"))
        )
        last = roots(named.where("form IS NOT NULL").select("word", "form"), tables)
        return materialise(named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
