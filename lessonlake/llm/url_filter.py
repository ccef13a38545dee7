"""URL filters: a blocked Bloom filter of the listed canonical keys passes possible hits to an exact hash join.

A listed key is host + path. A URL can only meet keys made of a suffix of its host (at a dot) and a
prefix of its path of a length that the list has, so these are probed in the filter; what passes is
joined with the list itself, which removes false positives, and the longest rule wins.

The filter has a block of eight 32-bit words a key group, one bit in each word, and is built by Spark.
It is broadcast only while it is at most MAX_FILTER_BYTES; a larger list goes straight to the join,
which gives the same rows.

Defined results: a null url or one without "://" has an empty host and path and no rule; rules with a null host
or path are left out; repeated rules count once (block wins over allow); repeated pages are judged one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonlake.llm.common import FEW_KEYS, ascii_lower, materialise

BITS_PER_KEY = 16
MAX_FILTER_BYTES = 16 << 20
#: Odd multipliers below 2^31 that choose the bit in each word of a block.
SALT = tuple((0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 31)) | 1 for i in range(8))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("\t"), path)


def bloom(rules: DataFrame, n_keys: int) -> np.ndarray | None:
    """The filter's words, or None beyond MAX_FILTER_BYTES. rules has a column h."""
    blocks = 1 << max(4, (max(n_keys, 1) * BITS_PER_KEY // 256).bit_length())
    if blocks * 32 > MAX_FILTER_BYTES:
        return None
    word = F.explode(F.array(*[F.struct(F.lit(i).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned((h & 4294967295) * {s}L & 4294967295L, 27) as int))").alias("bit")) for i, s in enumerate(SALT)]))
    rows = (
        rules.select(F.expr(f"cast(shiftrightunsigned(h, 32) & {blocks - 1} as int)").alias("block"), "h").select("block", word.alias("x"))
        .groupBy("block", "x.w").agg(F.bit_or("x.bit").alias("bits")).toArrow()
    )
    out = np.zeros((blocks, 8), np.uint32)
    out[rows["block"].to_numpy(), rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return out


def may_hold(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h.astype(np.int64).view(np.uint64)
    block = words[(h >> np.uint64(32)) & np.uint64(len(words) - 1)]
    low = h & np.uint64(0xFFFFFFFF)
    hit = np.ones(len(h), bool)
    for i, s in enumerate(SALT):
        bit = ((low * np.uint64(s)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        hit &= (block[:, i] >> bit.astype(np.uint32)) & 1 == 1
    return hit


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages(page_id, url), rules(host, path, verdict) -> page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    listed = (
        rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select("host", "path", "verdict", key_hash(F.col("host"), F.col("path")).alias("h"))
    )
    # the lengths that the listed paths have: at most one number a possible length of a path
    shape = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    judged = pages.select("page_id", "url", host_col := host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shape.n:
        return judged.select(F.col("page_id").cast("long"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = F.array(*[F.lit(x) for x in shape.lengths])
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = (
        judged.where("host <> ''").select("host", "path").distinct()
        .withColumn("key_host", F.explode(suffixes))
        .withColumn("n", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))))
        .withColumn("key_path", F.col("path").substr(F.lit(1), F.col("n")))
        .withColumn("h", key_hash(F.col("key_host"), F.col("key_path")))
    )
    words = bloom(listed, shape.n)
    if words is not None:
        shared = spark.sparkContext.broadcast(words)

        @F.pandas_udf("boolean")
        def probe(h: pd.Series) -> pd.Series:
            return pd.Series(may_hold(shared.value, h.to_numpy()))

        keys = keys.where(probe("h"))
    exact = listed.select("h", F.col("host").alias("key_host"), F.col("path").alias("key_path"), F.col("verdict").alias("found"))
    hits = (
        keys.join(exact, ["h", "key_host", "key_path"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("key_host", "key_path").alias("rule"), F.col("found")), F.struct(F.length("key_host") + F.length("key_path"), F.length("key_host"))).alias("hit"))
    )
    hits = materialise(hits)
    if hits.count() <= FEW_KEYS:
        out = judged.join(F.broadcast(hits), ["host", "path"], "left")
    else:  # pages without a host can't be hit, and don't meet at one key
        out = judged.where("host <> ''").join(hits, ["host", "path"], "left").unionByName(judged.where("host = ''"), allowMissingColumns=True)
    return out.select(F.col("page_id").cast("long"), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.found", F.lit(default)).alias("verdict"))
