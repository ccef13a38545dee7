"""N-gram Jaccard join of documents by grouped prefixes.

A document's set are the distinct shingles of its words (A-Z lower-cased). Two documents link when
100 * intersection >= PERCENT * union, and linked ones form components.

1. Shingle counts of all documents, summed in hashed cells, give one total order by rarity. Similar sets share a token among
   their first n - ceil(PERCENT n / 100) + 1, their prefix.
2. Documents of equal words form a class, which its first one stands for. Classes of equal size and prefix are collapsed into one group;
   only its first member goes to the buckets of its tokens.
3. In a bucket each group is paired with the first one and the nearest earlier one that sizes and positions allow, and each member of a
   group with the same two of its group. Pairs that a 1024-bit parity map of the shingles allows are verified on the words
   of both texts, and links joined to components.
4. A bucket may have other pairs. Where it still holds several components, its groups are expanded to their members, and all pairs
   across components that sizes, positions and maps allow are verified. No link between components is lost, and a bucket of
   thousands of copies makes pairs in proportion to its size.

Defined results: null and empty texts, or ones without words, have 0 shingles and are linked with nothing; fewer words than a
shingle are one shingle; texts of any length are read as a whole; rows with a null doc_id have a null component; rows that share a doc_id
are read as one document given twice; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonlake.llm.common import FEW_KEYS, Hashes, Tables, groups, materialise, mixed, only_keys, split_by_keys
from lessonlake.llm.components import components
from lessonlake.llm.line_dedup import token_counts
from lessonlake.llm.minhash import PARITY_BITS, shingle_hashes

PERCENT = 85
#: How far back the nearest fitting one is looked for.
LOOK_BACK = 64
CHUNK_ROWS = 100_000
#: Rows of a bucket and size class that one task joins with the others.
PART_ROWS = 2000
SETS = "doc_id long, n_shingles long, t1 long, t2 long, g1 long, g2 long, prefix array<long>, parity array<long>"
RESULT = "doc_id long, n_shingles long, component_id long"
ROWS = ("key", "n", "pos", "doc_id")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def hashed_words(hashes: Hashes, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def all_shingles(shingle: int) -> Callable[[], Callable[[pa.Array], np.ndarray]]:
    """What token_counts counts: the distinct shingles of each text."""

    def counter() -> Callable[[pa.Array], np.ndarray]:
        hashes = Hashes()
        return lambda texts: np.concatenate([np.zeros(0, np.uint64), *[shingle_hashes(hashed_words(hashes, words_of(x)), shingle) for x in texts.to_pylist()]])

    return counter


def document_sets(documents: DataFrame, shingle: int, counts: np.ndarray) -> DataFrame:
    """SETS: t1, t2 stand for the words, g1, g2 for size and prefix. A token is its shingle's hash with the cell replaced by the cell's
    rank in rarity, so its order is that of the join."""
    width = len(counts).bit_length() - 1
    rank = np.empty(len(counts), np.uint32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint32)
    shared = documents.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hashes = shared.value, Hashes()
        for b in batches:
            n, same, prefixes, parity = [], [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                x = shingle_hashes(hashed_words(hashes, words), shingle)
                token = np.sort(rank[(x & np.uint64(len(rank) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(64 - width) | x >> np.uint64(width))
                prefix = token[: len(x) - -(-PERCENT * len(x) // 100) + 1]
                n.append(len(x))
                same.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() + hashlib.blake2b(prefix.tobytes(), digest_size=16, salt=len(x).to_bytes(8, "little")).digest())
                prefixes.append(prefix)
                odd = np.bincount((x & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            pairs = np.frombuffer(b"".join(same), np.int64).reshape(-1, 4)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *prefixes]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *[pa.array(pairs[:, i].copy()) for i in range(4)], lists, pa.array(parity, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "t1", "t2", "g1", "g2", "prefix", "parity"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SETS)


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """rows(key, n, pos, doc_id), sorted within partitions by key -> (a, b, key, more): each row with the first and with the nearest
    earlier one of its key whose sizes and positions allow a link; more: the bucket may have other pairs."""

    def fits(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        both = n[i] + n[j]
        return (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & ((100 + PERCENT) * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= PERCENT * both)

    def pairs(b: pa.RecordBatch) -> pa.RecordBatch:
        order = np.lexsort((b.column("doc_id").to_numpy(), b.column("key").to_numpy()))
        key, n, pos, doc = (b.column(c).to_numpy()[order] for c in ROWS)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        rank = np.arange(len(key)) - np.repeat(start, size)
        later = np.flatnonzero(rank >= 1)
        first = later - rank[later]
        ok = fits(n, pos, first, later)
        xs, ys, d, active = [first[ok]], [later[ok]], 1, later[rank[later] >= 2]
        while len(active) and d <= LOOK_BACK:
            ok = fits(n, pos, active - d, active)
            xs.append(active[ok] - d)
            ys.append(active[ok])
            active = active[~ok]
            d += 1
            active = active[rank[active] > d]
        x, y = np.concatenate(xs), np.concatenate(ys)
        # where three or more meet, a row alone says so
        alone = start[size > 2]
        return pa.RecordBatch.from_arrays([pa.array(doc[np.append(x, alone)]), pa.array(doc[np.append(y, alone)]), pa.array(key[np.append(y, alone)]), pa.array(np.arange(len(y) + len(alone)) >= len(y))], ["a", "b", "key", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(pairs, groups(batches, CHUNK_ROWS))

    placed = rows.select(*ROWS).repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(run, "a long, b long, key long, more boolean")


def parity_allows(left: str, right: str, n: Column) -> Column:
    """The maps of two sets differ in no more bits than the sets in shingles. n: both sizes together."""
    apart = reduce(add, [F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))) for i in range(PARITY_BITS // 64)])
    return (100 + PERCENT) * apart <= (100 - PERCENT) * n


def allowed(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parity maps allow."""
    side = lambda c: units.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.where(parity_allows("pa", "pb", F.col("na") + F.col("nb"))).select("a", "b")


def verified(documents: DataFrame, pairs: DataFrame, shingle: int, tables: Tables) -> DataFrame:
    """The pairs (a, b) that link, on the words of both texts."""
    wanted = pairs.select(F.col("a").alias("_doc")).union(pairs.select("b")).distinct()
    docs = only_keys(documents.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL"), "doc_id", wanted)
    texts = tables.write(docs.join(wanted, F.col("doc_id") == F.col("_doc")).groupBy("doc_id").agg(F.min("text").alias("text")))

    def grams(text: str) -> set:
        words = words_of(text)
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
                keep.append(100 * both >= PERCENT * (len(left) + len(right) - both) > 0)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, name: texts.select(F.col("doc_id").alias(c), F.col("text").alias(name))
    return pairs.select("a", "b").join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def across(rows: DataFrame, tables: Tables) -> DataFrame:
    """rows(key, n, pos, doc_id, root, parity) -> the pairs (a, b) of a bucket in different components that may link.

    A row meets those of its own and the two neighbouring size classes (powers of 1.25). Where more than PART_ROWS rows are in a class,
    one side is dealt to parts and the other goes to each of them.
    """
    size_class = F.floor(F.log("n") / math.log(1.25)).cast("int")
    left = rows.withColumn("c", size_class)
    wide = tables.write(left.groupBy("key", "c").count().where(F.col("count") > PART_ROWS).select("key", "c", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts")))
    small = wide.count() <= FEW_KEYS

    def in_parts(rows: DataFrame, part: Column) -> DataFrame:
        return rows.join(F.broadcast(wide) if small else wide, ["key", "c"], "left").withColumn("part", part).drop("parts")

    a = in_parts(left, F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int"))
    b = rows.select("key", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("posb"), F.col("root").alias("rb"), F.col("parity").alias("pb"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: size_class + d)).alias("c"))
    b = in_parts(b, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    both = F.col("n") + F.col("nb")
    fit = (
        (F.col("doc_id") < F.col("b")) & (F.col("root") != F.col("rb")) & (100 * F.least("n", "nb") >= PERCENT * F.greatest("n", "nb"))
        & ((100 + PERCENT) * F.least(F.expr("n - pos"), F.expr("nb - posb")) >= PERCENT * both) & parity_allows("parity", "pb", both)
    )
    return a.join(b, ["key", "c", "part"]).where(fit).select(F.col("doc_id").alias("a"), "b").distinct()


def only_firsts(rows: DataFrame, of: list[str], firsts: DataFrame) -> DataFrame:
    """The rows without those whose columns of are in firsts(*of, first) and whose doc_id isn't first. Only rows that may be there travel."""
    may, rest = split_by_keys(rows, of[0], firsts.select(of[0]))
    left = may.join(firsts, of, "left").where("first IS NULL OR doc_id = first").select(*rows.columns)
    return left if rest is None else left.union(rest)


def ngram_join(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """documents(doc_id, text) -> RESULT: a row for each row of documents."""
    with Tables(documents.sparkSession) as tables:
        write, drop = tables.write, tables.drop
        sets = write(document_sets(documents, shingle, token_counts(documents, all_shingles(shingle))))
        used = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").withColumnRenamed("n_shingles", "n")
        classes = write(used.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"))
        units = write(only_firsts(used, ["t1", "t2"], classes).select("doc_id", "n", "g1", "g2", "prefix", "parity"))
        several = write(units.groupBy("g1", "g2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
        reps = only_firsts(units.drop("parity"), ["g1", "g2"], several)
        members = write(only_keys(units, "g1", several.select("g1")).join(several, ["g1", "g2"]).select(F.col("first").alias("rep"), "doc_id", "n", F.xxhash64("g1", "g2").alias("key")).distinct())
        at_tokens = reps.select("n", "doc_id", F.posexplode("prefix").alias("pos", "key"))
        in_groups = members.select("key", "n", F.lit(0).alias("pos"), "doc_id")
        found = write(bucket_pairs(at_tokens.select(*ROWS).union(in_groups.select(*ROWS))))
        met = write(found.where("NOT more AND a <> b").select("a", "b").distinct())
        links = write(verified(documents, write(allowed(met, units)), shingle, tables))
        roots = components(links, tables)

        # buckets that may have other pairs: of three or more, or of a group that has other members
        wide = found.where("more").select("key")
        if not members.isEmpty():
            ends = found.where("NOT more").select("key", F.explode(F.array("a", "b")).alias("rep"))
            wide = wide.union(ends.join(members.select("rep").distinct(), "rep", "left_semi").select("key"))
        wide = write(wide.distinct())
        drop(found)
        if not wide.isEmpty():
            rows = only_keys(at_tokens, "key", wide).select(*ROWS)
            expanded = rows.join(members.select(F.col("rep").alias("_rep"), F.col("doc_id").alias("member")), F.col("doc_id") == F.col("_rep"), "left").select("key", "n", "pos", F.coalesce("member", "doc_id").alias("doc_id"))
            rows = expanded.union(only_keys(in_groups, "key", wide).select(*ROWS))
            named = write(rows.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(*ROWS, F.coalesce("root", "doc_id").alias("root")))
            mixed_keys = write(named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"))
            if not mixed_keys.isEmpty():
                open_rows = only_keys(named, "key", mixed_keys).join(units.select("doc_id", "parity"), "doc_id").select(*ROWS, "root", "parity")
                more = write(across(write(open_rows), tables).join(met, ["a", "b"], "left_anti"))
                if not more.isEmpty():
                    roots = components(links.union(verified(documents, more, shingle, tables)), tables)
        copies = only_keys(used, "t1", classes.select("t1")).join(classes, ["t1", "t2"]).where("doc_id <> first").select("doc_id", "first")
        last = roots.withColumnRenamed("node", "first")
        by_copy = copies.join(last, "first", "left").select("doc_id", F.coalesce("root", "first").alias("root"))
        named = by_copy.union(roots.select(F.col("node").alias("doc_id"), "root")).groupBy("doc_id").agg(F.min("root").alias("root"))
        return materialise(sets.select("doc_id", "n_shingles").join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")))
