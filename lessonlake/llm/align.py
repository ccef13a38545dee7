"""Cross-tokenizer alignment: where two tokenizers cut a text at the same bytes, by pointer jumping.

Every token points to its farthest-right overlapping token of the other tokenizer; a token that ends where its partner ends is a
group's last. Doubling the successors of all tokens of a batch at once leads each to the last token of its group, which labels it.
All pairs of a group's tokens are linked, and a pair of ids is counted in the documents that hold it.

Texts are cut into segments where both tokenizers must end a token: before a single space or line break between two other characters.
Both vocabularies are examined for this; where it doesn't hold, a text is one segment. Segments are aligned once and kept in a
bounded cache.

The counts of the commonest pairs are broadcast, MOST_PAIRS at most, and added up where the documents lie. Rarer pairs, if there are
more, meet their counts in a join, in which no key has more rows than a common pair has documents.

Defined results: null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens: zeros and an
empty string. Each row is a document, also with a null doc_id or one that it shares. Texts and words of any length are
aligned as a whole. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonlake.llm.common import Tables, materialise

#: Segments and their characters that a task keeps from batch to batch.
CACHE_SEGMENTS, CACHE_CHARS = 1 << 18, 1 << 23
#: Pairs whose counts are broadcast: 16 MB.
MOST_PAIRS = 1 << 20
#: A pair of ids is a * 2^SHIFT + b.
SHIFT = 24
#: Segments that are encoded together.
CHUNK = 32
#: How byte-level tokenizers split a text before they merge (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COUNTS = "n_a long, n_b long, n_groups long, n_links long"
ALIGNED = f"doc_id long, {COUNTS}, groups_sha256 string, pairs array<long>, times array<long>"
RESULT = f"doc_id long, {COUNTS}, n_best long, count_sum long, groups_sha256 string"


def byte_values() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level vocabularies means."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {chr(b) if b in visible else chr(next(spare)): b for b in range(256)}


class Tokenizers:
    """A byte-level tokenizer A (a tokenizers file) and a sentencepiece model B; bytes_a and bytes_b are what each id stands for.

    Where A numbers its merges in their order, as byte-level vocabularies do, its ids are ranks, and the faster tiktoken reads them.
    """

    def __init__(self, a: str, b: bytes):
        import sentencepiece

        form = json.loads(a)
        value, vocabulary = byte_values(), form["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(value[c] for c in token)
        plain = form["pre_tokenizer"] | {"trim_offsets": True} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not form["normalizer"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in form["model"]["merges"]]
        ranked = plain and all(vocabulary[m] == 256 + i for i, m in enumerate(merges)) and len(vocabulary) == 256 + len(merges)
        self._a = self._ranks() if ranked else self._file(a)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        whole = not any("▁" in p.lstrip("▁") or "\n" in p for i, p in enumerate(pieces) if not self.b.is_byte(i))
        # with whole pieces and this cut, no token of either goes on beyond it
        self.cut = re.compile(r"(?<=\S)(?=[ \n]\S)" if plain and whole else r"(?!)")

    def _ranks(self) -> Callable[[list[str]], list[list[int]]]:
        import tiktoken

        ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.bytes_a)}, special_tokens={})
        return lambda texts: list(map(ranks.encode_ordinary, texts))

    @staticmethod
    def _file(a: str) -> Callable[[list[str]], list[list[int]]]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(a)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True
        return lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def segments(self, text: str) -> list[str]:
        return self.cut.split(" " + text)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The tokens of texts that begin with a space or line break. B puts a space before what it reads: the text's own, or one that goes again."""
        b = self.b.encode([s[1:] if s[0] == " " else s for s in texts], num_threads=1)
        return self._a(texts), [y if s[0] == " " else y[1:] if y[0] == self.space else [0] for s, y in zip(texts, b)]


def last_tokens(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' ends, ascending, of two tokenizers over the same bytes -> the last B token of each A and each B token's group."""
    n = len(end_a)
    to_b, to_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    last = end_a[to_a] == end_b
    to = np.concatenate([n + to_b, np.where(last, n + np.arange(len(end_b)), to_a)])
    while True:
        onward = to[to]
        if (onward == to).all():
            return to[:n] - n, to[n:] - n
        to = onward


class Numbers(dict):
    """The number of each segment; new ones get the next and wait."""

    def __init__(self) -> None:
        self.waiting: list[str] = []

    def __missing__(self, segment: str) -> int:
        n = self[segment] = len(self)
        self.waiting.append(segment)
        return n


class Aligned:
    """What segments give, by number: tokens of A and B, groups and links (sizes), the text of the groups, the linked pairs."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.len_a, self.len_b = (np.array([len(x) for x in b], np.int64) for b in (tokenizers.bytes_a, tokenizers.bytes_b))
        # a group's tokens as text, with what stands behind each: another of its side, the other side, the next group
        self.text_a, self.text_b = ([f"{i}{end}" for i in range(n) for end in ends] for n, ends in ((len(self.len_a), ",|"), (len(self.len_b), ",;")))
        self.clear()

    def clear(self) -> None:
        self.number, self.chars = Numbers(), 0
        self.sizes, self.bad, self.groups = np.zeros((0, 4), np.int64), np.zeros(0, bool), []
        self.pairs = np.zeros(0, np.int64)

    def tokens(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """The ids of A and B, how many each segment has, and whether it is given back byte by byte. Segments that may follow one another are
        encoded CHUNK at a time."""
        t, chunks, size = self.tokenizers, [], CHUNK
        for s in segments:
            if size < CHUNK and not last and s[0] in " \n" and not s[1:2].isspace() and len(s) > 1:
                chunks[-1].append(s)
                size += 1
            else:
                chunks.append([s])
                size = 1
            last = s[-1].isspace()
        raw = [s.encode("utf-8", "replace") for s in segments]
        ends = np.cumsum([len(r) for r in raw])
        out = []
        for of, ids, size in zip((t.bytes_a, t.bytes_b), t.encode(["".join(c) for c in chunks]), (self.len_a, self.len_b)):
            ids = np.fromiter(chain.from_iterable(ids), np.int64)
            end = np.cumsum(size[ids])
            upto = np.minimum(np.searchsorted(end, ends), max(len(ids) - 1, 0))
            if not len(ids) or (end[upto] != ends).any() or b"".join(map(of.__getitem__, ids.tolist())) != b"".join(raw):
                return self._one_by_one(segments, raw)
            out += [ids, np.diff(upto + 1, prepend=0)]
        return *out, np.ones(len(segments), bool)

    def _one_by_one(self, segments: list[str], raw: list[bytes]) -> tuple[np.ndarray, ...]:
        t = self.tokenizers
        a, b = t.encode(segments)
        ok = [b"".join(map(t.bytes_a.__getitem__, x)) == r == b"".join(map(t.bytes_b.__getitem__, y)) for x, y, r in zip(a, b, raw)]
        sides = [[x if k else [] for x, k in zip(side, ok)] for side in (a, b)]
        return *chain.from_iterable((np.fromiter(chain.from_iterable(side), np.int64), np.array([len(x) for x in side])) for side in sides), np.array(ok)

    def add(self, segments: list[str]) -> None:
        """Aligns these, all at once."""
        ia, na, ib, nb, ok = self.tokens(segments)
        last_a, last_b = last_tokens(np.cumsum(self.len_a[ia]), np.cumsum(self.len_b[ib]))
        begin_a, begin_b = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (last_a, last_b))
        ga, gb = np.diff(np.append(begin_a, len(ia))), np.diff(np.append(begin_b, len(ib)))
        segment = np.repeat(np.arange(len(segments)), nb)[begin_b]
        sizes = np.stack([na, nb, np.bincount(segment, minlength=len(segments)), np.bincount(segment, ga * gb, len(segments)).astype(np.int64)], 1)
        each = np.repeat(gb, ga)  # an A token's links
        right = np.repeat(np.repeat(begin_b, ga) - (np.cumsum(each) - each), each) + np.arange(each.sum())
        end_a, end_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
        end_a[begin_a + ga - 1] = end_b[begin_b + gb - 1] = 1
        place = np.concatenate([np.arange(len(ia)) + np.repeat(begin_b, ga), np.arange(len(ib)) + np.repeat(begin_a + ga, gb)])
        texts = np.empty(len(place), object)
        texts[place] = [*map(self.text_a.__getitem__, (2 * ia + end_a).tolist()), *map(self.text_b.__getitem__, (2 * ib + end_b).tolist())]
        texts, stop = texts.tolist(), np.cumsum(na + nb).tolist()
        self.groups += ["".join(texts[i:j]) for i, j in zip([0, *stop], stop)]
        self.sizes, self.bad = np.concatenate([self.sizes, sizes]), np.concatenate([self.bad, ~ok])
        self.pairs = np.concatenate([self.pairs, np.repeat(ia, each) << SHIFT | ib[right]])
        self.first = np.cumsum(self.sizes[:, 3]) - self.sizes[:, 3]
        self.chars += sum(map(len, segments))

    def texts(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's segments; none where it has no tokens."""
        if len(self.number) > CACHE_SEGMENTS or self.chars > CACHE_CHARS:
            self.clear()
        out = [list(map(self.number.__getitem__, self.tokenizers.segments(x))) if x else [] for x in texts]
        self._add_waiting()
        if self.bad.any():  # a segment isn't given back: the whole text decides
            for i, row in enumerate(out):
                if row and self.bad[row].any():
                    k = self.number[" " + texts[i]]
                    self._add_waiting()
                    out[i] = [] if self.bad[k] else [k]
        return out

    def _add_waiting(self) -> None:
        new, self.number.waiting = self.number.waiting, []
        if new:
            self.add(new)

    def linked(self, segment: np.ndarray) -> np.ndarray:
        """The pairs of these segments, one after the other."""
        n = self.sizes[segment, 3]
        return self.pairs[np.repeat(self.first[segment] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def aligned(documents: DataFrame, a: str, b: bytes) -> DataFrame:
    """documents(doc_id, text) -> ALIGNED: each document's counts and its distinct linked pairs, with how many links each has."""
    shared = documents.sparkSession.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Aligned(Tokenizers(*shared.value))
        for b in batches:
            rows = known.texts(b.column("text").to_pylist())
            segment = np.fromiter(chain.from_iterable(rows), np.int64)
            row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            totals, pairs, of = [np.zeros(len(rows), np.int64)] * 4, np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(segment):
                sizes = known.sizes[segment]
                totals = [np.bincount(row, sizes[:, i], len(rows)).astype(np.int64) for i in range(4)]
                pairs, of = known.linked(segment), np.repeat(row, sizes[:, 3])
                order = np.lexsort((pairs, of))
                pairs, of = pairs[order], of[order]
            sha = [hashlib.sha256("".join(map(known.groups.__getitem__, r))[:-1].encode()).hexdigest() if r else "" for r in rows]
            new = np.flatnonzero((np.diff(pairs, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
            offsets = np.searchsorted(of[new], np.arange(len(rows) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (pairs[new], np.diff(np.append(new, len(pairs))))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, totals), pa.array(sha, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED)


def common_from(counts: DataFrame) -> int:
    """The least count from which on at most MOST_PAIRS pairs are, as a power of two."""
    sizes = {r.k: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}  # 64 rows at most
    total, least = 0, max(sizes, default=0) + 1
    while least > 0 and total + sizes.get(least - 1, 0) <= MOST_PAIRS:
        least -= 1
        total += sizes.get(least, 0)
    return 1 << least


def align(documents: DataFrame, a: str, b: bytes) -> DataFrame:
    """documents(doc_id, text), the tokenizers' files -> RESULT: a row for each row of documents."""
    with Tables(documents.sparkSession) as tables:
        rows = tables.write(aligned(documents, a, b).withColumn("row", F.monotonically_increasing_id()))
        counts = tables.write(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
        id_a = F.shiftright("pair", SHIFT)
        most = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("most"))  # a row an id of A
        judged = counts.join(F.broadcast(most), id_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
        least = common_from(counts)
        common = judged.where(F.col("n") >= least).sort("pair").toArrow()
        shared = documents.sparkSession.sparkContext.broadcast(tuple(common.column(i).to_numpy() for i in range(3)))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, n, best = shared.value
            for b in batches:
                pairs, times = b.column("pairs"), b.column("times").flatten().to_numpy()
                every, offsets = pairs.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
                at = np.minimum(np.searchsorted(keys, every), max(len(keys) - 1, 0))
                known = keys[at] == every if len(keys) else np.zeros(len(every), bool)
                at = at[known]

                def summed(values: np.ndarray) -> pa.Array:
                    total = np.zeros(len(every) + 1, np.int64)
                    total[1:][known] = values
                    total = np.cumsum(total)
                    return pa.array(total[offsets[1:]] - total[offsets[:-1]])

                rest = np.flatnonzero(~known)
                left = pa.array(np.searchsorted(rest, offsets), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row")], summed(times[known] * best[at]), summed(times[known] * n[at]), pa.ListArray.from_arrays(left, pa.array(every[rest])), pa.ListArray.from_arrays(left, pa.array(times[rest]))],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row", "n_best", "count_sum", "pairs", "times"],
                )

        out = rows.mapInArrow(add, f"doc_id long, {COUNTS}, groups_sha256 string, row long, n_best long, count_sum long, pairs array<long>, times array<long>")
        if least > 1:
            part = tables.write(out)
            rare = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
            more = rare.join(judged.where(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
            out = part.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("s", F.lit(0)))
        return materialise(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))


def load_tokenizers(a: str | None = None, b: str | None = None) -> tuple[str, bytes]:
    """The contents of two tokenizers' files, by default of the installed public ones. Tasks need no file."""
    if a is None or b is None:
        import public_tokenizers

        a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    with open(a, encoding="utf-8") as left, open(b, "rb") as right:
        return left.read(), right.read()
