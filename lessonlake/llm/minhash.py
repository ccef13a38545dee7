"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set are the distinct shingles of its words (A-Z lower-cased). One permutation (sigma, a 64-bit mix cut to
2^20 places) places a shingle, a second (pi, a table) is read from that place on: coordinate k of the
signature is the least pi[(sigma + k) mod 2^20], so two permutations give all coordinates, each a circular shift of the other.
40 bands of 6 coordinates are candidates' keys: a pair at 0.8 is missed with a chance of 5e-6, a better one with less.

Documents of equal words, by a 128-bit cryptographic hash of them, form a class, stood for by its smallest doc_id. In each bucket a class is first paired with its NEAREST earlier ones of
fitting size (at most LOOK_BACK rows before it); pairs are verified on the words of both texts, and verified links joined to components. Buckets that then still
hold several components have all pairs across components verified, but for those that a 1024-bit parity map of the shingles
rules out: the maps of two sets differ in no more bits than the sets differ in shingles. So no link between different components
is lost, and a bucket of thousands of copies makes a number of pairs in proportion to its size.

Defined results: null and empty texts, or ones without words, have 0 shingles and are linked with nothing; fewer words than a
shingle are one shingle; rows with a null doc_id have a null component and are kept; rows that share a doc_id share its result.
Other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonlake.llm.common import FEW_KEYS, Hashes, Tables, dealt_join, fresh, groups, materialise, mixed, only_keys, split_by_keys
from lessonlake.llm.components import components

PLACES = 1 << 20
BANDS, ROWS = 40, 6
NEAREST = 2
#: How far back the nearest are looked for.
LOOK_BACK = 256
CHUNK_ROWS = 100_000
#: Rows of a bucket and size class that one task joins with the others.
PART_ROWS = 2000
SEED = 5
PARITY_BITS = 1024
SETS = "doc_id long, n_shingles long, t1 long, t2 long, bands array<long>, parity array<long>"
RESULT = "doc_id long, n_shingles long, component_id long, kept boolean"


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of the k-word shingles, from the words' hashes."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i])
    return np.unique(out)


class Circulant:
    """Signatures and band keys."""

    def __init__(self) -> None:
        size = BANDS * ROWS
        pi = np.random.default_rng(SEED).permutation(PLACES).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:size]]), size)
        self.mult = mixed(np.arange(1, size + 1, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = (shingles >> np.uint64(44)).astype(np.int64)
        out = None
        for i in range(0, len(at), 1024):
            least = self.shifted[at[i : i + 1024]].min(0)
            out = least if out is None else np.minimum(out, least)
        return out

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        rows = self.signature(shingles).reshape(BANDS, ROWS).astype(np.uint64)
        return mixed((rows * self.mult).sum(1, dtype=np.uint64) + self.mult[:, 0]).view(np.int64)


def document_sets(documents: DataFrame, shingle: int) -> DataFrame:
    """SETS. t1, t2 stand for the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, lsh = Hashes(), Circulant()
        for b in batches:
            n, same, bands, parity = [], [], [], []
            for text in b.column("text").to_pylist():
                words = (text or "").encode("utf-8", "replace").lower().split()
                x = shingle_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), shingle)
                n.append(len(x))
                same.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                bands.append(lsh.keys(x) if len(x) else np.zeros(0, np.int64))
                odd = np.bincount((x & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            pairs = np.frombuffer(b"".join(same), np.int64).reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])])
            keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), keys, pa.array(parity, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "t1", "t2", "bands", "parity"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SETS)


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """rows(key, n, doc_id), sorted within partitions by key and doc_id -> (a, b, key, more): each row with at most NEAREST
    earlier ones of its key whose sizes allow a similarity of 0.8; more: the bucket has pairs that aren't among these."""

    def pairs(b: pa.RecordBatch) -> pa.RecordBatch:
        key, n, doc = (b.column(c).to_numpy() for c in ("key", "n", "doc_id"))
        end = len(key)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank = np.arange(end) - np.repeat(start, np.diff(np.append(start, end)))
        found = np.zeros(end, np.int64)
        ys, xs, d, active = [np.zeros(0, int)], [np.zeros(0, int)], 1, np.flatnonzero(rank >= 1)
        while len(active) and d <= LOOK_BACK:
            x = active - d
            ok = 5 * np.minimum(n[x], n[active]) >= 4 * np.maximum(n[x], n[active])
            ys.append(active[ok])
            xs.append(x[ok])
            found[active[ok]] += 1
            d += 1
            active = active[(rank[active] >= d) & (found[active] < NEAREST)]
        # a row alone says that its bucket has more
        y, x = np.concatenate([*ys, active]), np.concatenate([*xs, active])
        return pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array(doc[y]), pa.array(key[y]), pa.array((rank[y] > NEAREST) | (x == y))], ["a", "b", "key", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(pairs, groups(batches, CHUNK_ROWS))

    return rows.select("key", "n", "doc_id").mapInArrow(run, "a long, b long, key long, more boolean")


def across(named: DataFrame, tables: Tables) -> DataFrame:
    """named(key, doc_id, n, root, parity): rows of buckets -> the pairs (a, b) of a bucket in different components that sizes and
    parity maps allow.

    A row meets those of its own and the two neighbouring size classes (powers of 1.25). Where more than PART_ROWS rows are in a class,
    one side is dealt to parts and the other goes to each of them.
    """
    size_class = F.floor(F.log("n") / math.log(1.25)).cast("int")
    left = named.withColumn("c", size_class)
    wide = tables.write(left.groupBy("key", "c").count().where(F.col("count") > PART_ROWS).select("key", "c", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts")))
    small = wide.count() <= FEW_KEYS

    def in_parts(rows: DataFrame, part: Column) -> DataFrame:
        return rows.join(F.broadcast(wide) if small else wide, ["key", "c"], "left").withColumn("part", part).drop("parts")

    a = in_parts(left, F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int"))
    b = named.select("key", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("parity").alias("pb"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: size_class + d)).alias("c"))
    b = in_parts(b, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    apart = reduce(add, [F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("pb", F.lit(i)))) for i in range(PARITY_BITS // 64)])
    fit = (F.col("doc_id") < F.col("b")) & (F.col("root") != F.col("rb")) & (5 * F.least("n", "nb") >= 4 * F.greatest("n", "nb")) & (9 * apart <= F.col("n") + F.col("nb"))
    return a.join(b, ["key", "c", "part"]).where(fit).select(F.col("doc_id").alias("a"), "b").distinct()


def verified(documents: DataFrame, pairs: DataFrame, shingle: int, tables: Tables) -> DataFrame:
    """The pairs (a, b) whose texts have 100 * intersection >= 80 * union, on the shingles' words."""
    wanted = pairs.select(F.col("a").alias("_doc")).union(pairs.select("b")).distinct()
    docs = only_keys(documents.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL"), "doc_id", wanted)
    texts = tables.write(docs.join(wanted, F.col("doc_id") == F.col("_doc")).groupBy("doc_id").agg(F.min("text").alias("text")))

    def grams(text: str) -> set:
        words = text.encode("utf-8", "replace").lower().split()
        k = min(shingle, len(words))
        return set(zip(*[words[i : len(words) - k + 1 + i] for i in range(k)]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for b in batches:
            keep = []
            for who, x, y in zip(b.column("a").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist()):
                if who != last:
                    last, left = who, grams(x)
                right = grams(y)
                both = len(left & right)
                keep.append(100 * both >= 80 * (len(left) + len(right) - both) > 0)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = (
        pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    )
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame, shingle: int = 5, kept: Tables | None = None) -> DataFrame:
    """documents(doc_id, text) -> RESULT: a row for each row of documents. The result is a table of kept, if that is given."""
    with Tables(documents.sparkSession) as tables:
        write, drop = tables.write, tables.drop
        sets = write(document_sets(documents, shingle))
        used = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = used.groupBy("t1", "t2").agg(F.min_by(F.struct("doc_id", F.col("n_shingles").alias("n"), "bands", "parity"), "doc_id").alias("c")).select("c.*")
        buckets = classes.select("doc_id", "n", F.explode("bands").alias("key"))
        found = write(bucket_pairs(buckets.repartition("key").sortWithinPartitions("key", "doc_id")))
        met = write(found.where("a <> b").select("a", "b").distinct())
        links = write(verified(documents, met, shingle, tables))
        roots = components(links, tables)
        wide = write(found.where("more").select("key").distinct())
        drop(found)
        if not wide.isEmpty():
            named = write(
                only_keys(buckets, "key", wide).join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                .join(classes.select("doc_id", "parity"), "doc_id").select("key", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"), "parity")
            )
            several = write(named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"))
            more = write(across(only_keys(named, "key", several), tables).join(met, ["a", "b"], "left_anti"))
            drop(named)
            if not more.isEmpty():
                roots = components(links.union(verified(documents, more, shingle, tables)), tables)
        members = write(
            used.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("k"))
            .join(roots.withColumnRenamed("node", "first"), "first", "left").select("t1", "t2", "k", F.coalesce("root", "first").alias("root"))
        )
        named = dealt_join(used.select("doc_id", "t1", "t2").distinct(), members.drop("k"), ["t1", "t2"], members, ["doc_id"]).groupBy("doc_id").agg(F.min("root").alias("component_id"))
        last = kept.write if kept else materialise
        return last(
            sets.select("doc_id", "n_shingles").join(named, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
        )


def dedup_documents(documents: DataFrame, shingle: int = 5) -> DataFrame:
    """The documents, all columns, of which one stays for each group of near copies: the one of smallest doc_id."""
    gone = fresh(documents, "gone")
    with Tables(documents.sparkSession) as tables:
        lost = materialise(near_duplicates(documents, shingle, tables).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct())
    may, rest = split_by_keys(documents, "doc_id", lost)
    kept = may.join(lost, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    return kept if rest is None else kept.union(rest)
