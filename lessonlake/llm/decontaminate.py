"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by training windows.

Windows of 13 benchmark words (an item of fewer words is one window of that length) are hashed; each
document's windows are looked up, every hit is verified on the words themselves, and the words inside hit
windows are marked. Documents or just the marked spans can be removed.

The set is broadcast once, while the benchmark's texts take at most BLOCK_BYTES; each Python worker builds it once. Beyond
that, windows meet by hash: documents give those that a bounded Bloom filter of the benchmark's may hold, with their words, to a
join that is exact; a window or a text that many documents have is dealt to parts. Both ways give the same rows.

Defined results: null or empty texts have no words and are never contaminated; an item without words has no
window; repeated items count once in n_items; repeated documents are scanned one by one; an empty
benchmark contaminates nothing. Only doc_id and text (item_id and text) are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lessonlake.llm.common import Tables, dealt_join, fresh, materialise, mixed, split_by_keys
from lessonlake.llm.url_filter import bloom, may_hold

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: The set that this process has built last, by name and window.
_built: dict[tuple, NgramSet] = {}
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Bytes of words: digits, letters and everything beyond ASCII. A-Z become a-z, all others a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


class NgramSet:
    """The windows of a block of items, by length: exact word-id tuples behind a table of hashed bits."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, set[str]]] = {}
        rng = np.random.default_rng(13)
        self.mix = rng.integers(0, 1 << 63, window, dtype=np.uint64) | np.uint64(1)
        for item, text in items:
            words = normal_words(text)
            if not words:
                continue
            x = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.int32)
            n = min(window, len(words))
            for i in range(len(words) - n + 1):
                self.windows.setdefault(n, {}).setdefault(x[i : i + n].tobytes(), set()).add(item)
        self.bits = {}
        for n, found in self.windows.items():
            rows = np.frombuffer(b"".join(found), np.int32).reshape(-1, n).astype(np.uint64)
            table = np.zeros(1 << 20, bool)
            table[self.slot((rows * self.mix[:n]).sum(1, dtype=np.uint64))] = True
            self.bits[n] = table

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h >> np.uint64(44)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, length) of each occurrence of a window, and the items that the windows are from."""
        n_words, at, items = len(words), [], set()
        if not n_words or not self.windows:
            return at, items
        get = self.ids.get
        x = np.array([get(w, 0) for w in words], np.int32)
        wide = x.astype(np.uint64)
        for n, found in self.windows.items():
            m = n_words - n + 1
            if m < 1:
                continue
            h = wide[:m] * self.mix[0]
            for i in range(1, n):
                h += wide[i : i + m] * self.mix[i]
            for i in np.flatnonzero(self.bits[n][self.slot(h)]).tolist():
                if (who := found.get(x[i : i + n].tobytes())) is not None:
                    at.append((i, n))
                    items |= who
        return at, items


def ngram_set(name: str, texts: list[tuple[str, str]], window: int) -> NgramSet:
    """The set of these texts, which their name stands for."""
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = NgramSet(texts, window)
    return _built[name, window]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item IS NOT NULL AND text IS NOT NULL")


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with two more columns at their end, of names that they have not: the hits array<long> (start * 64 + length) and their items array<string>.

    Windows are of less than 64 words.
    """
    if not 0 < window < 64:
        raise ValueError("window must be 1 to 63 words")
    items = _items(benchmark)
    if items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] > block_bytes:
        return _joined_hits(documents, items, window)
    shared = documents.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in items.sort("item", "text").collect()]))
    at, who = fresh(documents, "hits"), fresh(documents, "hit_items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = ngram_set(*shared.value, window)
        for b in batches:
            found = [grams.hits(normal_words(text)) for text in b.column(b.schema.names.index("text")).to_pylist()]
            spans = pa.array([sorted(i * 64 + n for i, n in x[0]) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, spans, pa.array([sorted(x[1]) for x in found], pa.list_(pa.string()))], [*b.schema.names, at, who])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField(at, ArrayType(LongType())), StructField(who, ArrayType(StringType()))]))


def _window_hashes(words: list[bytes], n: int, mix: np.ndarray) -> np.ndarray:
    """Of each run of n words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = h[: len(h) - n + 1] * mix[0]
    for i in range(1, n):
        out += h[i : len(h) - n + 1 + i] * mix[i]
    return mixed(out)


def _joined_hits(documents: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """scan() for a benchmark of any size. Equal texts have equal hits, so a text is known by its SHA-256."""
    with Tables(documents.sparkSession) as tables:
        return _hits_by_join(documents, items, window, tables)


def _hits_by_join(documents: DataFrame, items: DataFrame, window: int, tables: Tables) -> DataFrame:
    mix = np.random.default_rng(13).integers(0, 1 << 63, window, dtype=np.uint64) | np.uint64(1)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, text in zip(*(c.to_pylist() for c in b.columns)):
                words = normal_words(text)
                if words:
                    n = min(window, len(words))
                    out += [(h, n, b" ".join(words[i : i + n]), item) for i, h in enumerate(_window_hashes(words, n, mix).view(np.int64).tolist())]
            yield _batch(out, ("h", "n", "w", "item"), (pa.int64(), pa.int32(), pa.binary(), pa.string()))

    wanted = tables.write(items.mapInArrow(windows, "h long, n int, w binary, item string").distinct())
    sizes = [r.n for r in wanted.select("n").distinct().collect()]  # at most window numbers
    bits = bloom(wanted.select("h").distinct(), wanted.count())
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, text in zip(*(c.to_pylist() for c in b.columns)):
                words = normal_words(text)
                for n in sizes:
                    if len(words) >= n:
                        h = _window_hashes(words, n, mix).view(np.int64)
                        maybe = np.arange(len(h)) if shared.value is None else np.flatnonzero(may_hold(shared.value, h))
                        out += [(key, h[i], n, i, b" ".join(words[i : i + n])) for i in maybe.tolist()]
            yield _batch(out, ("key", "h", "n", "at", "w"), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))

    at, who, key, short = (fresh(documents, c) for c in ("hits", "hit_items", "text_key", "text_hash"))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    found = documents.select(sha.alias("key"), "text").mapInArrow(probe, "key string, h long, n int, at int, w binary")
    found = tables.write(found.distinct())
    sizes = tables.write(found.groupBy("h", "n", "w").agg(F.count("*").alias("k")).where("k > 1"))
    hits = dealt_join(found, wanted, ["h", "n", "w"], sizes, ["key", "at"])
    hits = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.expr("CAST(at AS BIGINT) * 64 + n"))).alias(at), F.sort_array(F.collect_set("item")).alias(who))
    hits = materialise(hits.withColumnRenamed("key", key).withColumn(short, F.xxhash64(key)))
    # texts without hits, empty ones among them, don't travel
    may, rest = split_by_keys(documents.withColumns({key: sha, short: F.xxhash64(sha)}), short, hits.select(short))
    sizes = materialise(may.groupBy(key).agg(F.count("*").alias("k")).where("k > 1"))
    out = dealt_join(may.drop(short), hits.drop(short), [key], sizes, ["doc_id"], "left")
    if rest is not None:
        out = out.unionByName(rest.drop(short).withColumns({at: F.lit(None).cast("array<long>"), who: F.lit(None).cast("array<string>")}))
    none = {at: F.coalesce(at, F.array().cast("array<long>")), who: F.coalesce(who, F.array().cast("array<string>"))}
    return out.withColumns(none).select(*documents.columns, at, who)


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def covered(n_words: int, hit_at: list[int]) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int32)
    for x in hit_at:
        edge[x // 64] += 1
        edge[x // 64 + x % 64] -= 1
    return np.cumsum(edge[:-1]) > 0


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def decontaminate_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> RESULT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, at, items in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                n = len(normal_words(text))
                hit = int(covered(n, at).sum()) if at else 0
                out.append((n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), is_contaminated(hit, n)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    found = scan(documents.select(F.col("doc_id").cast("long"), "text"), benchmark)
    return found.mapInArrow(run, RESULT)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, spans_only: bool = False) -> DataFrame:
    """The documents (all columns) without contaminated ones; or, with spans_only, with the hit words cut out of all texts.

    The cut leaves what stands between two words of one hit span out as well, and every other character as it is.
    """
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = names.index("text")
            keep, texts = [], []
            for text, at in zip(b.column(col).to_pylist(), b.column(len(names)).to_pylist()):
                n = len(normal_words(text))
                hit = covered(n, at) if at else np.zeros(0, bool)
                keep.append(spans_only or not is_contaminated(int(hit.sum()), n))
                if spans_only and hit.any():
                    out, last = [], 0
                    spots = [m.span() for m in word.finditer(text)]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()
                    for first, end in zip(edges[::2], edges[1::2]):
                        out.append(text[last : spots[first][0]])
                        last = spots[end - 1][1]
                    text = "".join([*out, text[last:]])
                texts.append(text)
            cols = b.columns[: len(names)]
            cols[col] = pa.array(texts, b.schema.field(col).type)
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))

    return scan(documents, benchmark).mapInArrow(run, documents.schema)
