"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: The word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch, beside Spark's limit of 10,000 rows. A longer text is a batch of its own.
BATCH_BYTES = 2 << 20
#: Keys that are broadcast themselves; for more, a Bloom filter is.
FEW_KEYS = 20_000
#: Rows that a join's key may have before they are dealt to parts.
HOT_ROWS = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Sets the session's batch size, which bounds what a task holds of any text column."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, name: str, *others: DataFrame) -> str:
    """name, or a longer one that none of the columns of df and others has (in any case)."""
    taken = {c.lower() for t in (df, *others) for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Only where that is unset and all tasks run on this machine, as in tests, a local one serves."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Tables written on the way to a result. Each is deleted when it has been read for the last time, the rest at the end of the block."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.written: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*[t for t, _ in self.written])

    def write(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.written.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes these tables, and lets the shuffle files of finished steps go, which Spark keeps until its driver collects garbage."""
        jvm, left = self.spark._jvm, []
        for t, path in self.written:
            if any(t is x for x in tables):
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
            else:
                left.append((t, path))
        self.written = left
        jvm.System.gc()


class Hashes(dict):
    """64-bit hashes of words, kept for the next time. ``list(map(hashes.__getitem__, words))`` is the fast use."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h):
    """A bijection of 64-bit words (a multiply-xorshift finaliser)."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, a long -> batches of about so many rows that hold whole groups of it.

    A group of more than twice as many rows comes in pieces, each with the last two rows of the piece before it.
    """
    import numpy as np
    import pyarrow as pa

    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        return t.to_batches(max_chunksize=max(1, t.num_rows))[0]

    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # where the last group begins in this batch
        goes_on = not cut and bool(held) and held[-1].column(0)[-1].as_py() == key[-1]
        if n + cut >= rows and not goes_on and n + cut:
            held.append(b.slice(0, cut))
            yield joined()
            held, n, b = [], 0, b.slice(cut)
        held.append(b)
        n += b.num_rows
        if n >= 2 * rows and held[0].column(0)[0].as_py() == key[-1]:
            whole = joined()
            yield whole
            held, n = [whole.slice(whole.num_rows - 2)], 2
    if held:
        yield joined()


class WordHashes:
    """64-bit hashes of all words of a byte string, by array operations: the sum of a random number a byte times a power of an
    odd number, which is taken from running sums, and then mixed. fold: A-Z count as a-z.

    Modulo 2^64 such sums are equal by construction for some long strings of a pattern, so words over LONG bytes are hashed one by one.
    The byte END, which no UTF-8 text has, ends a text. Long strings are taken in pieces, so memory is bounded but for one word.
    """

    END = b"\xff"
    PIECE = 1 << 21
    LONG = 24

    def __init__(self, fold: bool):
        import numpy as np

        self.fold = fold
        self.value = np.random.default_rng(29).integers(1, 1 << 63, 256, dtype=np.uint64)
        if fold:
            self.value[65:91] = self.value[97:123]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32, 255]] = True
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        import numpy as np

        def powers(k: int) -> np.ndarray:
            factors = np.full(n, k, np.uint64)
            factors[0] = 1
            return np.multiply.accumulate(factors)

        base = 0x9E3779B97F4A7C15
        self.power, self.inverse = powers(base), powers(pow(base, -1, 1 << 64))

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place of the first byte) of each word."""
        import numpy as np

        b = np.frombuffer(data, np.uint8)
        out, at = [], 0
        while at < len(b):
            end = at + self.PIECE
            while end < len(b) and not self.space[b[end]]:
                rest = np.flatnonzero(self.space[b[end : end + self.PIECE]])
                end += int(rest[0]) if len(rest) else self.PIECE
            out.append(self._piece(b[at:end], at))
            at = end
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return tuple(map(np.concatenate, zip(*out)))

    def _piece(self, b: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        import numpy as np

        if len(b) >= len(self.power):
            self._powers(2 * len(b))
        edge = np.diff(self.space[b].view(np.int8), prepend=np.int8(1), append=np.int8(1))
        start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.value[b] * self.power[: len(b)], out=total[1:])
        h = mixed((total[end] - total[start]) * self.inverse[start])
        long = np.flatnonzero(end - start > self.LONG)
        if len(long):
            import xxhash

            words = [b[i:j].tobytes() for i, j in zip(start[long].tolist(), end[long].tolist())]
            h[long] = [xxhash.xxh3_64_intdigest(w.lower() if self.fold else w) for w in words]
        return h, start + at


def joined_texts(column: pa.Array) -> bytes:
    """The texts as bytes, each with the end mark behind it."""
    import pyarrow as pa

    return WordHashes.END.join([x or b"" for x in column.cast(pa.binary()).to_pylist()]) + WordHashes.END


def split_by_keys(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key may be among keys, rows whose key isn't). keys: one column of longs. Few keys are broadcast, then a filter of bounded size.

    A blocked Bloom filter spares the second part the shuffle of the join that must follow for the first. With too many keys for
    a bounded filter, all rows are in the first part and the second is None. Rows without a key are in the second.
    """
    from lessonlake.llm.url_filter import bloom, may_hold

    hashed = keys.select(F.xxhash64(F.col(keys.columns[0]).cast("long")).alias("h")).distinct()
    n = hashed.count()
    if n <= FEW_KEYS:
        name = fresh(rows, "h")
        few, same = F.broadcast(hashed.withColumnRenamed("h", name)), F.xxhash64(F.col(key).cast("long")) == F.col(name)
        return rows.join(few, same, "left_semi"), rows.join(few, same, "left_anti")
    words = bloom(hashed, n)
    if words is None:
        return rows, None
    shared = rows.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def probe(h):
        import pandas as pd

        return pd.Series(may_hold(shared.value, h.to_numpy()))

    may = probe(F.xxhash64(F.col(key).cast("long")))
    return rows.where(may), rows.where(~may)


def only_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return split_by_keys(rows, key, keys)[0]


def dealt_join(rows: DataFrame, others: DataFrame, on: list[str], sizes: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """rows.join(others, on, how), how being inner or left, where one key may hold a third of rows. sizes(*on, k), a written table: at least
    how many rows a key has; keys that it leaves out have few.

    Keys with more than a share of all rows are dealt to parts by the columns by: a row goes to one part, those of others to each of them.
    No more than FEW_KEYS keys can have so many, so the table of these is broadcast, and they have at most 2 * FEW_KEYS parts together.
    """
    total = sizes.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    limit = max(HOT_ROWS, -(-total // FEW_KEYS))
    at, parts, part = (fresh(rows, c, others) for c in ("hot_key", "parts", "part"))
    hot = sizes.where(F.col("k") > limit).groupBy(F.xxhash64(*on).alias(at)).agg(F.max(F.ceil(F.col("k") / limit)).cast("int").alias(parts))
    if hot.isEmpty():
        return rows.join(others, on, how)

    def placed(side: DataFrame, place: Column) -> DataFrame:
        return side.withColumn(at, F.xxhash64(*on)).join(F.broadcast(hot), at, "left").withColumn(part, place).drop(at, parts)

    one = placed(rows, F.coalesce(F.pmod(F.xxhash64(*by), F.col(parts)), F.lit(0)).cast("int"))
    every = placed(others, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1)))
    return one.join(every, [*on, part], how).drop(part)
