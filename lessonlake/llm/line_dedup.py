"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words, A-Z lower-cased. A line is removed if the input has an earlier one
(smaller doc_id, or same document and smaller line number) with a Jaccard similarity of 0.8 or more.

1. Token counts of all documents, summed in hashed cells (2^18, or as many as there are rows, up to 2^22), give one total
   order by rarity.
2. Lines of equal token sets form a class, whose first line stands for it; the others go at once. Repeats within a text
   are seen as it is read; only lines whose set other documents may have meet in a join.
3. Similar sets share a token among their first n - ceil(0.8 n) + 1 by rarity, and two among one more. Lines meet at a
   token; at one that more than GROUP_ROWS lines have there (a hot token), they meet at it and a second one. Length,
   position and a 128-bit parity map of the tokens rule out pairs, all without loss. A pair of tokens that is hot again
   (a form that many lines repeat) is dealt to several groups.
4. A line needs just one earlier match, so at most NEAREST candidates of a line and group go on to verification on the
   words. Lines with more candidates, or in a group that was dealt, and without a match yet meet all lines of their
   tokens in a second join, where each goes to all parts of a dealt group; so nothing is capped, no task holds more than
   GROUP_ROWS lines of a group, and a group of copies makes no quadratic number of pairs.

Defined results: lines without words are kept and match nothing; null and empty texts have none; rows with
a null doc_id are kept as they are; rows that share a doc_id are read as one document given twice, and
lose the same lines; an empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonlake.llm.common import FEW_KEYS, Tables, WordHashes, dealt_join, fresh, groups, joined_texts, materialise, mixed, only_keys, split_by_keys
from lessonlake.llm.url_filter import bloom, may_hold

#: Bits of the number of cells: at least, at most.
CELL_BITS = (18, 22)
#: Cells whose counts travel together.
CELL_BLOCK = 4096
NEAREST = 4
#: Lines that may meet in one group.
GROUP_ROWS = 10_000
CHUNK_ROWS = 100_000
LINES = "s1 long, s2 long, doc_id long, line int, again boolean, n int, bits long, bits2 long, cold int, prefix array<long>"
CLASS = ("doc_id", "line", "n", "bits", "bits2", "cold", "prefix")
RESULT = "doc_id long, n_lines long, n_removed long, removed array<int>"
#: Tokens of n that a similar set must share one of, in order of rarity.
PREFIX = "CAST(n - (4 * n + 4) div 5 + 1 AS INT)"


def tokens(line: str) -> list[bytes]:
    return line.encode("utf-8", "replace").lower().split()


def words_of_texts() -> Callable[[pa.Array], np.ndarray]:
    hashes = WordHashes(fold=True)
    return lambda texts: hashes(joined_texts(texts))[0]


def token_counts(documents: DataFrame, counter: Callable[[], Callable[[pa.Array], np.ndarray]] = words_of_texts) -> np.ndarray:
    """How many tokens fall in each cell, over all documents. At most 2^22 cells, whatever the input. counter() gives what hashes a batch of
    texts in a task."""
    low, high = CELL_BITS
    cells = 1 << min(high, max(low, documents.count().bit_length()))
    size = min(cells, CELL_BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashed = np.zeros(cells, np.int64), counter()
        for b in batches:
            h = hashed(b.column(0))
            total += np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        if total.any():
            blocks = total.reshape(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], ["block", "counts"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # a task has its share of the blocks
        for b in parts:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    out = np.zeros((cells // size, size), np.int64)
    found = documents.select("text").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary")
    for r in found.collect():
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def line_order(line: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by line, then by token. One word of both sorts fastest; where its bits don't tell two tokens, both are sorted."""
    width = np.uint64(max(1, int(line[-1]).bit_length()))
    key = line.astype(np.uint64) << (np.uint64(64) - width) | h >> width
    order = np.argsort(key)
    key, x = key[order], h[order]
    return np.lexsort((h, line)) if ((key[1:] == key[:-1]) & (x[1:] != x[:-1])).any() else order


def line_sets(documents: DataFrame, counts: np.ndarray) -> DataFrame:
    """LINES: for each line with a word, a hash of its set, whether its text has that set before, its size, parity map and rarest tokens.

    A token is its word's hash with the cell replaced by the cell's rank in rarity, so its order is that of the join. The first
    cold ones of prefix are in no more than GROUP_ROWS lines; where others follow, prefix has one token more, if the line has it.
    """
    width = len(counts).bit_length() - 1
    rank = np.empty(len(counts), np.uint32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint32)
    hot_from = np.uint64(int((counts <= GROUP_ROWS).sum()))
    shared = documents.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hashes = shared.value, WordHashes(fold=True)
        for b in batches:
            data = joined_texts(b.column("text"))
            h, place = hashes(data)
            if not len(h):
                continue
            # the words' lines, counted over the batch, then only those with a word
            buffer = np.frombuffer(data, np.uint8)
            texts = np.flatnonzero(buffer == 255)
            breaks = np.flatnonzero((buffer == 10) | (buffer == 255))
            line = np.searchsorted(breaks, place)
            new = np.flatnonzero(np.diff(line, prepend=-1))
            rows = np.searchsorted(texts, place[new])
            before = np.concatenate([[0], np.searchsorted(breaks, texts)[:-1] + 1])  # lines of the texts before
            numbers = line[new] - before[rows]
            docs = b.column("doc_id").to_numpy()[rows]
            sizes = np.diff(np.append(new, len(h)))
            h = rank[(h & np.uint64(len(rank) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(64 - width) | h >> np.uint64(width)
            line = np.repeat(np.arange(len(sizes)), sizes)
            order = line_order(line, h)
            h, line = h[order], line[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
            h, line = h[first], line[first]
            start = np.flatnonzero(np.diff(line, prepend=-1))
            n = np.diff(np.append(start, len(h)))
            m = mixed(h)
            s1, s2 = np.add.reduceat(m, start), np.add.reduceat(mixed(m + np.uint64(1)), start)
            at, text = np.lexsort((s2, s1, rows)), rows
            again = np.zeros(len(at), bool)
            again[at[1:]] = (s1[at[1:]] == s1[at[:-1]]) & (s2[at[1:]] == s2[at[:-1]]) & (text[at[1:]] == text[at[:-1]])
            bit, low = np.uint64(1) << ((m >> np.uint64(57)) & np.uint64(63)), m >> np.uint64(63) == 0
            bits, bits2 = (np.bitwise_xor.reduceat(np.where(at, bit, np.uint64(0)), start) for at in (low, ~low))
            length = n - (4 * n + 4) // 5 + 1
            hot = h >> np.uint64(64 - width) >= hot_from  # the tail of each line
            cold = np.minimum(length, n - np.add.reduceat(hot, start, dtype=np.int64))
            length = np.minimum(n, length + (cold < length))
            offsets = np.concatenate([[0], np.cumsum(length)])
            at = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
            prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(again), pa.array(n, pa.int32()), pa.array(bits.view(np.int64)), pa.array(bits2.view(np.int64)), pa.array(cold, pa.int32()), prefix],
                ["s1", "s2", "doc_id", "line", "again", "n", "bits", "bits2", "cold", "prefix"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").mapInArrow(run, LINES)


def near_candidates(records: DataFrame) -> DataFrame:
    """records(key, place, bits, bits2, doc_id, line), sorted within partitions by key -> pairs of a line with at
    most NEAREST earlier ones of its key that pass the filters; more: there may be others. place: n, position and, in the
    lowest bit, whether the key is one part of a group."""

    def pairs(b: pa.RecordBatch) -> pa.RecordBatch:
        order = np.lexsort([b.column(c).to_numpy() for c in ("line", "doc_id", "key")])
        key, place, bits, bits2, doc, line = (b.column(c).to_numpy()[order] for c in ("key", "place", "bits", "bits2", "doc_id", "line"))
        end = len(key)
        n, pos, split = place >> 32, (place & 0xFFFFFFFF) >> 1, (place & 1).astype(bool)
        bits, bits2 = bits.view(np.uint64), bits2.view(np.uint64)

        def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (n5[i] >= n4[j]) & (n5[j] >= n4[i])

        def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return 9 * (np.bitwise_count(bits[i] ^ bits[j]).astype(np.int64) + np.bitwise_count(bits2[i] ^ bits2[j])) <= n[i] + n[j]

        def placed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return np.minimum(n[i] - pos[i], n[j] - pos[j]) >= (4 * (n[i] + n[j]) + 8) // 9

        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank = np.arange(end) - np.repeat(start, np.diff(np.append(start, end)))
        found = np.zeros(end, np.int64)
        ys, xs, d, active = [], [], 1, np.flatnonzero(rank >= 1)
        n4, n5 = 4 * n, 5 * n
        while len(active):
            i, j = active - d, active
            for test in (fits, alike, placed):  # the cheapest first
                ok = test(i, j)
                i, j = i[ok], j[ok]
            ys.append(j)
            xs.append(i)
            found[j] += 1
            d += 1
            active = active[(rank[active] >= d) & (found[active] < NEAREST)]
        y, x = np.concatenate(ys or [np.zeros(0, int)]), np.concatenate(xs or [np.zeros(0, int)])
        alone = np.flatnonzero(split & (found == 0))  # matches may be in another part of the group
        y, x = np.concatenate([y, alone]), np.concatenate([x, alone])
        more = (found[y] >= NEAREST) & (rank[y] > 1) | split[y]
        return pa.RecordBatch.from_arrays([pa.array(doc[y]), pa.array(line[y]), pa.array(doc[x]), pa.array(line[x]), pa.array(more)], ["y_doc", "y_line", "x_doc", "x_line", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(pairs, groups(batches, CHUNK_ROWS))

    return records.mapInArrow(run, "y_doc long, y_line int, x_doc long, x_line int, more boolean")


def line_keys(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mixed(doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64))


def verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(y_doc, y_line, x_doc, x_line), a written table -> the distinct (doc_id, line) of y with a similarity of 0.8 or more to its x.

    Only lines that a Bloom filter of the pairs' lines holds leave their text; where that would be too large, all lines do.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [line_keys(b.column(d).to_numpy(), b.column(i).to_numpy()) for d, i in ((0, 1), (2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], ["h"])

    words = bloom(pairs.select("y_doc", "y_line", "x_doc", "x_line").mapInArrow(hashed, "h long"), 2 * pairs.count())
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            texts, docs = [x or "" for x in b.column("text").to_pylist()], b.column("doc_id").to_numpy()
            n = np.array([x.count("\n") + 1 for x in texts], np.int64)
            row = np.repeat(np.arange(len(n)), n)
            line = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(may_hold(words, line_keys(docs[row], line).view(np.int64))) if words is not None else np.arange(len(row))
            row, line, out, last, parts = row[hit], line[hit], [], -1, []
            for r, i in zip(row.tolist(), line.tolist()):
                if r != last:
                    last, parts = r, texts[r].split("\n")
                out.append(parts[i])
            yield pa.RecordBatch.from_arrays([pa.array(docs[row]), pa.array(line, pa.int32()), pa.array(out, pa.string())], ["doc_id", "line", "text"])

    lines = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").mapInArrow(cut, "doc_id long, line int, text string")
    lines = lines.groupBy("doc_id", "line").agg(F.min("text").alias("text"))  # of documents given twice

    def side(name: str) -> DataFrame:
        return lines.select(F.col("doc_id").alias(f"{name}_doc"), F.col("line").alias(f"{name}_line"), F.col("text").alias(f"{name}_text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x_text").to_pylist(), b.column("y_text").to_pylist()):
                a, c = set(tokens(x)), set(tokens(y))
                both = len(a & c)
                keep.append(100 * both >= 80 * (len(a) + len(c) - both) > 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("line")], ["doc_id", "line"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("x"), ["x_doc", "x_line"]).join(side("y"), ["y_doc", "y_line"])
    return both.select(F.col("y_doc").alias("doc_id"), F.col("y_line").alias("line"), "x_text", "y_text").mapInArrow(compare, "doc_id long, line int").distinct()


class Groups:
    """Where lines meet: at a token, at two where that is hot, in one of the parts where these are hot again."""

    def __init__(self, classes: DataFrame, tables: Tables):
        hot = classes.where(f"cold < {PREFIX}").select(F.explode(F.expr(f"slice(prefix, cold + 1, {PREFIX} - cold)")).alias("token"))
        self.hot = tables.write(hot.groupBy("token").count().where(F.col("count") > GROUP_ROWS).select("token"))
        self.n_hot, self.n_parts = self.hot.count(), 0
        if self.n_hot:
            self.parts = tables.write(self._pairs(classes).groupBy("key").count().where(F.col("count") > GROUP_ROWS).select("key", F.ceil(F.col("count") / GROUP_ROWS).cast("int").alias("parts")))
            self.n_parts = self.parts.count()

    @staticmethod
    def _small(table: DataFrame, n: int) -> DataFrame:
        return F.broadcast(table) if n <= FEW_KEYS else table

    def _pairs(self, lines: DataFrame) -> DataFrame:
        """The rows of lines at hot tokens, one for each later token of their prefix, with the key of both."""
        at = lines.where(f"cold < {PREFIX}").select("*", F.explode(F.expr(f"sequence(cold, {PREFIX} - 1)")).alias("pos")).withColumn("token", F.get("prefix", F.col("pos")))
        at = at.join(self._small(self.hot, self.n_hot), "token", "left_semi")
        return at.select("*", F.explode(F.expr("slice(prefix, pos + 2, size(prefix))")).alias("second")).select(*lines.columns, "pos", F.xxhash64("token", "second").alias("key"))

    def records(self, lines: DataFrame, everywhere: bool = False) -> DataFrame:
        """lines, with a row a key: key, pos, split. A line is in one part of a split group, or in all of them."""
        single = lines.select("*", F.posexplode(F.expr(f"slice(prefix, 1, {PREFIX})")).alias("pos", "token"))
        if not self.n_hot:
            return single.withColumnRenamed("token", "key").withColumn("split", F.lit(False))
        # a row that can't be at a hot token has no part in the join
        maybe = single.where("pos >= cold").join(self._small(self.hot, self.n_hot), "token", "left_anti")
        out = single.where("pos < cold").unionByName(maybe).select(*lines.columns, "pos", F.col("token").alias("key"))
        pairs = self._pairs(lines)
        if not self.n_parts:
            return out.unionByName(pairs).withColumn("split", F.lit(False))
        pairs = pairs.join(self._small(self.parts, self.n_parts), "key", "left")
        part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if everywhere else F.pmod(F.xxhash64("doc_id", "line"), F.col("parts"))
        dealt = pairs.where("parts IS NOT NULL").select(*lines.columns, "pos", "key", part.alias("part")).select(*lines.columns, "pos", F.xxhash64("key", F.col("part").cast("long")).alias("key"), F.lit(True).alias("split"))
        return out.unionByName(pairs.where("parts IS NULL").drop("parts")).withColumn("split", F.lit(False)).unionByName(dealt)


def repeated_lines(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> the (doc_id, line) of lines that repeat an earlier one, each once; a written table."""
    with Tables(documents.sparkSession) as tables:
        write, drop = tables.write, tables.drop
        lines = write(line_sets(documents, token_counts(documents)))
        apart = lines.where("NOT again").drop("again")
        firsts = write(apart.groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).where("k > 1"))
        may, rest = split_by_keys(apart, "s1", firsts.select("s1"))
        named = dealt_join(may, firsts.drop("k"), ["s1", "s2"], firsts, ["doc_id", "line"], "left")
        classes = named.where("first IS NULL OR doc_id = first").select(*CLASS)
        classes = write(classes if rest is None else classes.union(rest.select(*CLASS)))
        copies = write(lines.where("again").select("doc_id", "line").union(named.where("doc_id <> first").select("doc_id", "line")))
        drop(lines, firsts)

        meeting = Groups(classes, tables)
        place = F.expr("shiftleft(CAST(n AS BIGINT), 32) + 2 * pos + CAST(split AS INT)").alias("place")
        dealt = meeting.records(classes).select("key", place, "bits", "bits2", "doc_id", "line").repartition("key").sortWithinPartitions("key")  # one long: a radix sort
        found = write(near_candidates(dealt).groupBy("y_doc", "y_line", "x_doc", "x_line").agg(F.max("more").alias("more")))
        drop()
        met = write(found.where("y_doc <> x_doc OR y_line <> x_line").drop("more"))
        near = write(verified(documents, met))
        drop(met)
        open_ = write(found.where("more").select(F.col("y_doc").alias("doc_id"), F.col("y_line").alias("line")).distinct().join(near, ["doc_id", "line"], "left_anti"))
        drop(found)
        if not open_.isEmpty():
            at = F.xxhash64("doc_id", "line").alias("at")
            asking = only_keys(classes.select("*", at), "at", open_.select(at)).join(open_, ["doc_id", "line"], "left_semi").select(*CLASS)
            ask = meeting.records(asking, everywhere=True)
            ask = write(ask.select("key", *[F.col(c).alias(f"y_{c}") for c in ("n", "pos", "bits", "bits2")], F.col("doc_id").alias("y_doc"), F.col("line").alias("y_line")))
            least = F.expr("(4 * (n + y_n) + 8) div 9")
            rest = only_keys(meeting.records(classes).select("key", "n", "pos", "bits", "bits2", "doc_id", "line"), "key", ask.select("key")).join(ask, "key").where(
                (F.struct("doc_id", "line") < F.struct("y_doc", "y_line"))
                & (5 * F.least("n", "y_n") >= 4 * F.greatest("n", "y_n")) & (F.least(F.expr("n - pos"), F.expr("y_n - y_pos")) >= least)
                & F.expr("9 * (bit_count(bits ^ y_bits) + bit_count(bits2 ^ y_bits2)) <= n + y_n")
            ).select("y_doc", "y_line", F.col("doc_id").alias("x_doc"), F.col("line").alias("x_line")).distinct()
            near = near.union(verified(documents, write(rest)))
        return materialise(copies.union(near).distinct())


def dedup_report(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> RESULT: a row for each doc_id, with the numbers of its removed lines, from 0."""
    gone = repeated_lines(documents).groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    lines: Column = F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    return (
        documents.select(F.col("doc_id").cast("long"), lines.cast("long").alias("n_lines")).join(gone, "doc_id", "left")
        .select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    )


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The documents, all columns, without repeated lines. A document that loses its last line with a word goes."""
    doc, removed = fresh(documents, "doc"), fresh(documents, "removed")
    gone = materialise(repeated_lines(documents).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list("line").alias(removed)))
    names = documents.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lost = names.index("text"), b.column(b.num_columns - 1).to_pylist()
            texts, keep = [], []
            for text, lines in zip(b.column(at).to_pylist(), lost):
                if lines:
                    drop = set(lines)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                texts.append(text)
                keep.append(not lines or bool(tokens(text)))
            cols = b.columns[:-1]
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))

    may, rest = split_by_keys(documents, "doc_id", gone.select(doc))
    # a merge at any size: else small inputs broadcast this side, and what is moved grows by more than the input
    cleaned = may.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col(doc), "left").drop(doc).mapInArrow(cut, documents.schema)
    return cleaned if rest is None else cleaned.union(rest)
