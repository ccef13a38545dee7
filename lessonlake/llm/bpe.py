"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The root of the tree yields the leftmost pair of lowest rank; a merge updates at most three leaves, each in
logarithmic time, until no pair can be merged. Words are cached per task in a bounded cache.

Defined results: a null text counts as empty; an empty text has no tokens, the digest of the empty string
and decodes to it; a word of any length takes n log n time; repeated rows are encoded one by one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 1 << 18
CACHE_CHARS = 64
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where visible, else the next free code point from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def merge_word(ids: list[int], pairs: dict[int, int], made: list[int]) -> list[int]:
    """Merges until no pair has a rank. pairs: the rank of a pair a * 2^20 + b; made: what the merge of each rank gives.

    Leaf i of the tree is the rank of the pair that starts at symbol i, with i in its low bits, so the root is the leftmost
    pair of lowest rank.
    """
    n = len(ids)
    if n < 2:
        return ids
    get, shift = pairs.get, max(20, n.bit_length())
    none = (len(made) + 1) << shift
    size = 1 << (n - 2).bit_length()
    tree = [none] * (2 * size)
    a = ids[0]
    for i in range(1, n):
        b = ids[i]
        if (rank := get(a << 20 | b)) is not None:
            tree[size + i - 1] = rank << shift | i - 1
        a = b
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            low = value if value < other else other
            i >>= 1
            if tree[i] == low:
                break
            tree[i] = value = low

    while (best := tree[1]) != none:
        i = best & (1 << shift) - 1
        j = after[i]
        a = ids[i] = made[best >> shift]
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if tree[size + j] != none:
                put(j, none)
            rank = get(a << 20 | ids[k])
        else:
            rank = None
        put(i, none if rank is None else rank << shift | i)
        if (h := before[i]) >= 0:
            rank = get(ids[h] << 20 | a)
            value = none if rank is None else rank << shift | h
            if tree[size + h] != value:
                put(h, value)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class WordBpe:
    """Encoder and decoder of one vocabulary file whose words end in a suffix (as word_bpe_49k.json)."""

    def __init__(self, vocabulary: str):
        import regex

        spec = json.loads(vocabulary)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        if max(self.vocab.values()) >= 1 << 20:
            raise ValueError("a vocabulary of 2^20 tokens or more")
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.pairs = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split).findall
        chars = byte_chars()
        self.inner = [self.vocab.get(c) for c in chars]
        self.end = [self.vocab.get(c + self.suffix) for c in chars]
        self.names: list[str | None] = [None] * (1 + max(*self.vocab.values(), *self.added.values(), 0))
        for s, i in (self.vocab | self.added).items():
            self.names[i] = s
        self.cache: dict[str, tuple[int, ...]] = {}

    def encoded(self, word: str) -> tuple[int, ...]:
        """The tokens of one pre-token. A symbol outside the vocabulary is dropped, as there is no unknown token."""
        found = self.cache.get(word)
        if found is None:
            b = word.encode("utf-8", "replace")
            ids = [self.inner[x] for x in b[:-1]]
            ids.append(self.end[b[-1]])
            found = tuple(merge_word([i for i in ids if i is not None], self.pairs, self.made))
            if len(word) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        import unicodedata

        out: list[int] = []
        at, get, encoded = 0, self.cache.get, self.encoded
        for m in [*(self.special.finditer(text) if any(t in text for t in self.added) else ()), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                # lower-casing is per code point: no final sigma
                part = unicodedata.normalize("NFC", part)
                part = part.lower() if "Σ" not in part else "".join(map(str.lower, part))
                out += chain.from_iterable([get(w) or encoded(w) for w in self.find(part)])
            if m:
                out.append(self.added[m[0]])
                at = m.end()
        return out

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by one space; unknown ids are left out."""
        return " ".join([x for i in ids if 0 <= i < len(self.names) and (x := self.names[i]) is not None])


def bpe_digests(documents: DataFrame, vocabulary: str) -> DataFrame:
    """documents(doc_id, text) -> RESULT. vocabulary: the content of the vocabulary file (bounded: a file of a few MB)."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(shared.value)
        sha, written = hashlib.sha256, list(map(str, range(len(bpe.names))))
        for b in batches:
            n, ids, texts = [], [], []
            for text in b.column("text").to_pylist():
                x = bpe.encode(text or "")
                n.append(len(x))
                ids.append(sha(" ".join([written[i] for i in x]).encode()).hexdigest())
                texts.append(sha(bpe.decode(x).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def load_vocabulary(path: str | None = None) -> str:
    """Read on the driver, which has the tokenizers' package; tasks get the content. path: a parameter, the public file by default."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()
