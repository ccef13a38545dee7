"""Substring dedup by super-k-mers.

A window is 20 consecutive words. The minimiser of a window is its 5-word gram of least hash; consecutive windows with the
same one form a super-k-mer. Equal windows have equal minimisers, so

1. only super-k-mers whose minimiser occurs more than once can hold a repeated window; the others don't travel;
2. those travel as one packed string, equal strings once, to the bucket of their minimiser, where the windows are sorted and the
   first start (doc_id, position) of each distinct one is found on the words themselves;
3. the firsts go back to all occurrences: a window that isn't its first start covers its words, which are removed.

Documents of equal words are found first by a 128-bit cryptographic hash of them; all but the smallest doc_id are copies from end to end.
A super-k-mer of more than RUN windows is cut between two of them. A bucket with more than BUCKET_WINDOWS windows in its distinct
strings is split: its strings are cut to single windows, whose first starts are aggregated before they travel and joined back.

Defined results: null and empty texts have no words; texts of under 20 words keep all; rows with a null doc_id keep all;
rows that share a doc_id are read as one document given twice; an empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonlake.llm.common import Tables, WordHashes, dealt_join, joined_texts, materialise, mixed, only_keys, split_by_keys

WINDOW = 20
GRAM = 5
RUN = 1024
#: Windows that a task holds of one bucket: some 150 MB of Python objects.
BUCKET_WINDOWS = 500_000
SKETCH = "doc_id long, t1 long, t2 long, n_words long, minis array<long>, twice array<boolean>"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def super_kmers(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """h: the words' hashes of texts that end before the words of ends -> (text, minimiser, first window, number of windows, whether
    the string holds its minimiser twice) of each super-k-mer, the windows numbered within their text.

    A run of windows goes on as long as the minimiser's value is the same. Two equal windows of one run have their leftmost
    minimiser at different places, so such a string is told by a change of place.
    """
    begins = np.concatenate([[0], ends[:-1]])
    n, most = len(h) - WINDOW + 1, 1 << 23
    if n < 1:
        return tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.int64, np.int64, bool))
    if n > most:  # places have 24 bits; a cut between two windows changes no window
        left = super_kmers(h[: most + WINDOW - 1], np.minimum(ends, most + WINDOW - 1))
        right = super_kmers(h[most:], np.maximum(ends - most, 0))
        moved = np.maximum(most - begins[right[0]], 0)
        return tuple(np.append(x, y) for x, y in zip(left, (right[0], right[1], right[2] + moved, *right[3:])))
    g = h[: len(h) - GRAM + 1].copy()
    for i in range(1, GRAM):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : len(g) + i]
    g = mixed(g)
    span, mask = WINDOW - GRAM + 1, np.uint64((1 << 24) - 1)
    low, width = (g & ~mask) | np.arange(len(g), dtype=np.uint64), 1
    while 2 * width <= span:  # the least of 2, 4, 8, ... grams, the leftmost of equal ones
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    place = (np.minimum(low[:n], low[span - width : span - width + n]) & mask).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), ends - begins)
    whole = np.flatnonzero(text[:n] == text[WINDOW - 1 :])  # windows of one text
    if not len(whole):
        return tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.int64, np.int64, bool))
    place, text = place[whole], text[whole]
    value = g[place]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
    start = np.flatnonzero(new)
    pieces = -(-np.diff(np.append(start, len(whole))) // RUN)
    start = np.repeat(start, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    moved = np.concatenate([[False], place[1:] != place[:-1]]) & ~new
    return text[start], value[start], whole[start] - begins[text[start]], np.diff(np.append(start, len(whole))), np.logical_or.reduceat(moved, start)


def sketches(documents: DataFrame) -> DataFrame:
    """SKETCH: a row a document, with a hash of its words and the minimisers of its super-k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(fold=False)
        for b in batches:
            data = joined_texts(b.column("text"))
            h, at = hashes(data)
            marks = np.flatnonzero(np.frombuffer(data, np.uint8) == 255).tolist()
            ends = np.searchsorted(at, marks)
            begins = np.concatenate([[0], ends[:-1]])
            whole = [hashlib.blake2b(b" ".join(data[i:j].split()), digest_size=16).digest() for i, j in zip([0, *(k + 1 for k in marks)], marks)]
            pair = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
            text, low, _, _, again = super_kmers(h, ends)
            offsets = np.searchsorted(text, np.arange(b.num_rows + 1))
            minis, twice = (pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (low.view(np.int64), again))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(ends - begins, pa.int64()), minis, twice], ["doc_id", "t1", "t2", "n_words", "minis", "twice"])

    return documents.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").mapInArrow(run, SKETCH)


def travelling(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen(doc_id, ks) -> the packed strings of these super-k-mers: mini, p1, p2 (a hash of the string), doc_id, start, n (windows), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(fold=False)
        for b in batches:
            data = joined_texts(b.column("text"))
            h, at = hashes(data)
            marks = np.flatnonzero(np.frombuffer(data, np.uint8) == 255)
            ends = np.searchsorted(at, marks)
            begins = np.concatenate([[0], ends[:-1]])
            text, low, start, size, _ = super_kmers(h, ends)
            first, last = np.searchsorted(text, np.arange(b.num_rows)), np.searchsorted(text, np.arange(b.num_rows), side="right")
            ks = b.column("ks")
            row = np.repeat(np.arange(b.num_rows), np.diff(ks.offsets.to_numpy()))
            k = ks.flatten().to_numpy()
            known = first[row] + k < last[row]  # of documents given twice, another may have more
            row, k = row[known], (first[row] + k)[known]
            word = begins[row] + start[k]
            stop = word + size[k] + WINDOW - 1
            to = np.where(stop < ends[row], at[np.minimum(stop, len(at) - 1)] if len(at) else 0, marks[row])
            packed = [b" ".join(data[i:j].split()) for i, j in zip(at[word].tolist(), to.tolist())]
            pair = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in packed]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(low[k].view(np.int64)), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(b.column("doc_id").to_numpy()[row]), pa.array(start[k], pa.int32()), pa.array(size[k], pa.int32()), pa.array(packed, pa.binary())],
                ["mini", "p1", "p2", "doc_id", "start", "n", "packed"],
            )

    docs = only_keys(documents.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL"), "doc_id", chosen.select("doc_id"))
    return docs.join(chosen, "doc_id").select("doc_id", "text", "ks").mapInArrow(run, "mini long, p1 long, p2 long, doc_id long, start int, n int, packed binary")


def windows_of(packed: bytes) -> list[bytes]:
    """The windows of words that one space joins."""
    cut = [0, *(np.flatnonzero(np.frombuffer(packed, np.uint8) == 32) + 1).tolist(), len(packed) + 1]
    return [packed[i : j - 1] for i, j in zip(cut, cut[WINDOW:])]


def bucket_firsts(strings: DataFrame) -> DataFrame:
    """strings(mini, p1, p2, off, doc_id, start, packed), sorted within partitions by mini -> for each string, the first
    start of each of its windows: p1, p2, off, docs, starts."""

    def firsts(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) == 1:
            *key, doc, start, packed = rows[0]
            windows = windows_of(packed)
            if len(set(windows)) == len(windows):
                yield *key, [doc] * len(windows), list(range(start, start + len(windows)))
                return
        every = []
        for r, (*_, doc, start, packed) in enumerate(rows):
            every += [(w, doc, start + i, r, i) for i, w in enumerate(windows_of(packed))]
        sizes = Counter(x[3] for x in every)
        every.sort()
        out = [([0] * sizes[r], [0] * sizes[r]) for r in range(len(rows))]
        last = None
        for w, doc, at, r, i in every:
            if w != last:
                last, first_doc, first_at = w, doc, at
            out[r][0][i], out[r][1][i] = first_doc, first_at
        for row, found in zip(rows, out):
            yield *row[:3], *found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, done = None, [], []

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], ["p1", "p2", "off", "docs", "starts"])
            done.clear()
            return out

        for b in batches:
            for mini, *row in zip(*(b.column(c).to_pylist() for c in ("mini", "p1", "p2", "off", "doc_id", "start", "packed"))):
                if mini != last and held:
                    done += firsts(held)
                    held = []
                last = mini
                held.append(tuple(row))
            if done:
                yield batch()
        if held:
            done += firsts(held)
            yield batch()

    return strings.mapInArrow(run, "p1 long, p2 long, off int, docs array<long>, starts array<int>")


def single_windows(strings: DataFrame) -> DataFrame:
    """Each string cut to its windows: w (the words), p1, p2, off, doc_id, start."""

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["w", "p1", "p2", "off", "doc_id", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for p1, p2, doc, start, packed in zip(*(b.column(c).to_pylist() for c in ("p1", "p2", "doc_id", "start", "packed"))):
                out += [(w, p1, p2, i, doc, start + i) for i, w in enumerate(windows_of(packed))]
                if len(out) >= 5000:
                    yield batch(out)
                    out = []
        yield batch(out)

    return strings.mapInArrow(run, "w binary, p1 long, p2 long, off int, doc_id long, start int")


def window_firsts(strings: DataFrame, tables: Tables) -> DataFrame:
    """What bucket_firsts gives, a row a window, for strings of any number that share a window: no task holds a window's rows."""
    cut = single_windows(strings)
    firsts = tables.write(cut.groupBy("w").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("k")).where("k > 1"))
    named = dealt_join(cut, firsts.drop("k"), ["w"], firsts, ["p1", "p2", "off"], "left")
    return named.select("p1", "p2", "off", F.array(F.coalesce("first.doc_id", "doc_id")).alias("docs"), F.array(F.coalesce("first.start", "start")).alias("starts"))


def repeated_spans(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, spans): for each document that loses words, their [first, end) ranges, which
    may overlap; a whole copy has the one range [0, -1)."""
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, start, off, docs, starts in zip(*(c.to_pylist() for c in b.columns)):
                begin = None
                for i, where in enumerate(zip(docs, starts)):
                    at = start + off + i
                    if where != (doc, at):
                        begin = at if begin is None else begin
                    elif begin is not None:
                        out.append((doc, begin, at - 1 + WINDOW))
                        begin = None
                if begin is not None:
                    out.append((doc, begin, start + off + len(docs) - 1 + WINDOW))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "a", "b"])

    with Tables(documents.sparkSession) as tables:
        write, drop = tables.write, tables.drop
        sketch = write(sketches(documents))
        texts = sketch.where(f"n_words >= {WINDOW}")
        firsts = write(texts.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).where("k > 1"))
        copies = write(dealt_join(texts.select("doc_id", "t1", "t2"), firsts.drop("k"), ["t1", "t2"], firsts, ["doc_id"]).where("doc_id <> first").select("doc_id").distinct())
        drop(firsts)
        own = (
            texts.select("doc_id", F.arrays_zip("minis", "twice").alias("x")).join(copies, "doc_id", "left_anti")
            .select("doc_id", F.posexplode("x").alias("k", "x")).select("doc_id", "k", F.col("x.minis").alias("mini"), F.col("x.twice").alias("twice"))
        )
        again = write(own.groupBy("mini").agg((F.count("*") + F.count_if("twice")).alias("k")).where("k > 1"))
        chosen = dealt_join(only_keys(own.drop("twice"), "mini", again.select("mini")), again.select("mini"), ["mini"], again, ["doc_id", "k"]).groupBy("doc_id").agg(F.collect_set("k").alias("ks"))
        moved = write(travelling(documents, chosen))
        drop(sketch, again)
        first = F.struct("doc_id", "start")
        strings = write(moved.groupBy("mini", "p1", "p2", "n", "packed").agg(F.min(first).alias("first"), F.count("*").alias("k")).select("mini", "p1", "p2", "n", "k", F.lit(0).alias("off"), "first.doc_id", "first.start", "packed"))
        wide = write(strings.groupBy("mini").agg(F.sum("n").alias("n")).where(F.col("n") > BUCKET_WINDOWS).select("mini"))
        known = bucket_firsts(strings.join(wide, "mini", "left_anti").repartition("mini").sortWithinPartitions("mini"))
        if not wide.isEmpty():
            known = known.unionByName(window_firsts(strings.join(wide, "mini", "left_semi"), tables))
        places = moved.select("p1", "p2", "doc_id", "start")
        spans = dealt_join(places, known, ["p1", "p2"], strings.select("p1", "p2", "k"), ["doc_id", "start"]).select("doc_id", "start", "off", "docs", "starts").mapInArrow(ranges, "doc_id long, a int, b int")
        whole = copies.select("doc_id", F.lit(0).alias("a"), F.lit(-1).alias("b"))
        return materialise(spans.union(whole).groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("spans")))


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    edge = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        if a < len(words):
            edge[a] += 1
            edge[len(words) if b < 0 else min(b, len(words))] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> RESULT and text: the kept words joined by one space."""
    spans = repeated_spans(documents).withColumnRenamed("doc_id", "_doc")
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    hit, rest = split_by_keys(docs, "doc_id", spans.select("_doc"))
    rows = hit.join(spans, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "spans")
    if rest is not None:
        rows = rows.union(rest.select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, texts = [], [], [], []
            for text, cut in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                words = words_of(text)
                kept = kept_words(words, [(x["a"], x["b"]) for x in cut]) if cut else words
                joined = b" ".join(kept)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    return rows.mapInArrow(run, RESULT + ", text string")
