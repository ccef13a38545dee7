"""Quality rules: base counts of a text, then a linear-chain CRF over its lines.

Viterbi decoding marks every line as content or boilerplate; the share of words in content lines
decides retention. The CRF is trained here by maximum likelihood on a bounded sample of labelled
documents (SAMPLE_DOCS) and of runs of RUN_LINES consecutive lines from anywhere in them (SAMPLE_RUNS).

Labels are of documents, but lines of both kinds stand in one document, so the lines' labels are found in steps:
emission weights alone are fitted with every line taking its document's label; each line is labelled by them; a document
labelled good keeps content for more than half of its words and one labelled bad boilerplate, else its lines stay as they
were; then the chain is fitted on these mixed paths, the lines are decoded with it, and it is fitted once more.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged
one by one; an empty table gives an empty result; without labelled rows of both kinds nothing but the
base rule rejects. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 2000
RUN_LINES = 256
SAMPLE_RUNS = 4000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MIN_CONTENT_SHARE = 0.5
#: Upper bin edges of each line feature.
EDGES = (
    ("symbols per word", (0.05, 0.2, 0.5)),
    ("upper-case share", (0.1, 0.3, 0.6)),
    ("digit share", (0.02, 0.1, 0.3)),
    ("exclamation marks per word", (0.05, 0.3, 0.7)),
    ("distinct word share", (0.2, 0.4, 0.7)),
    ("words", (2, 8, 30)),
    ("mean word bytes", (2.5, 9.0, 14.0)),
    ("repeats an earlier line", (0.5,)),
    ("ends a sentence", (0.5,)),
)
BINS = 4
SPACE = " \t\n\r\x0b\x0c"
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
_MIX = (np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def repeat_words(words: list[bytes]) -> int:
    """Words inside any window of eight that occurs twice or more. Equal hashes are confirmed on the words."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        x = h[i : i + n] * _MIX[i]
        w += x ^ (x >> np.uint64(29))
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    both = np.zeros(n, bool)
    both[order[1:][same]] = both[order[:-1][same]] = True
    found: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(both).tolist():
        found.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for at in found.values():
        if len(at) > 1:
            np.add.at(edge, at, 1)
            np.add.at(edge, np.asarray(at) + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def line_features(text: str) -> tuple[list[tuple], list[int], int]:
    """A row of raw features and a word count for each line that has a word; the repeated lines' number."""
    rows, sizes, seen, repeats = [], [], set(), 0
    for line in text.split("\n"):
        b = line.encode("utf-8", "replace")
        words = b.split()
        if not words:
            continue
        n, chars = len(words), len(b)
        again = line in seen
        repeats += again
        seen.add(line)
        rows.append((
            (chars - len(b.translate(None, b"#*$%&|<>"))) / n,
            (chars - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / chars,
            (chars - len(b.translate(None, b"0123456789"))) / chars,
            b.count(b"!") / n,
            len(set(words)) / n,
            n,
            chars / n - 1,
            again,
            words[-1][-1:] in b".?!:",
        ))
        sizes.append(n)
    return rows, sizes, repeats


def binned(rows: np.ndarray) -> np.ndarray:
    """For each row, the index of each feature's weight."""
    out = np.empty(rows.shape, np.int64)
    for j, (_, edges) in enumerate(EDGES):
        out[:, j] = j * BINS + np.searchsorted(edges, rows[:, j], side="right")
    return out


def viterbi(emit: list[float], start: float, trans: list[list[float]]) -> list[int]:
    """The best path of states 0 (boilerplate) and 1 (content). emit: how much better 1 is than 0."""
    (t00, t01), (t10, t11) = trans
    a, b, back = 0.0, emit[0] + start, []
    for e in emit[1:]:
        f0, f1 = b + t10 > a + t00, b + t11 > a + t01
        a, b = (b + t10 if f0 else a + t00), (b + t11 if f1 else a + t01) + e
        back.append((f0, f1))
    path = [int(b > a)]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


class Lattice:
    """Sequences of binned lines, laid out by step: all first lines, then all second ones, ..., longer sequences first."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        sizes = np.array([len(sequences[i]) for i in self.order])
        self.width = [int((sizes > t).sum()) for t in range(sizes[0])]
        self.begin = np.concatenate([[0], np.cumsum(self.width)])
        self.sequence = np.concatenate([np.arange(k) for k in self.width])
        step = np.repeat(np.arange(len(self.width)), self.width)
        self.feats = np.concatenate([sequences[i] for i in self.order])[np.concatenate([[0], np.cumsum(sizes)[:-1]])[self.sequence] + step]
        self.last = self.begin[sizes - 1] + np.arange(len(sizes))
        self.next = np.arange(self.width[0], len(step))  # lines that have one before them
        self.before = self.begin[step[self.next] - 1] + self.sequence[self.next]

    def marginals(self, e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the emission scores of content: its probability in each line, and the joint ones of neighbours."""
        at, k = self.begin, self.width
        e = np.stack([np.zeros_like(e), e], 1)
        fwd, bwd = e.copy(), np.zeros_like(e)
        for t in range(1, len(k)):
            p = fwd[at[t - 1] : at[t - 1] + k[t]]
            fwd[at[t] : at[t + 1]] += np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1])
        for t in range(len(k) - 1, 0, -1):
            n = bwd[at[t] : at[t + 1]] + e[at[t] : at[t + 1]]
            bwd[at[t - 1] : at[t - 1] + k[t]] = np.logaddexp(trans[:, 0] + n[:, :1], trans[:, 1] + n[:, 1:])
        z = np.logaddexp(fwd[self.last, 0], fwd[self.last, 1])[self.sequence]
        joint = fwd[self.before][:, :, None] + trans + (e + bwd)[self.next][:, None, :] - z[self.next][:, None, None]
        return np.exp(fwd[:, 1] + bwd[:, 1] - z), np.exp(np.minimum(joint, 0.0))


def fit_chain(lattice: Lattice, y: np.ndarray, weight: np.ndarray, chained: bool, steps: int = 120, rate: float = 1.0, ridge: float = 1e-3) -> dict:
    """Weights by gradient ascent on the conditional likelihood of the labels y; without the chain, of each line for itself."""
    size = len(EDGES) * BINS
    w, start, trans = np.zeros(size), 0.0, np.zeros((2, 2))
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[lattice.before], y[lattice.next]), weight[lattice.next])
    moment = [np.zeros(size), 0.0, np.zeros((2, 2))]
    first = lattice.width[0]
    for _ in range(steps):
        e = w[lattice.feats].sum(1)
        if chained:
            e[:first] += start
            p, joint = lattice.marginals(e, trans)
            gt = gold - (joint * weight[lattice.next][:, None, None]).sum(0) - ridge * trans
        else:
            p, gt = 1 / (1 + np.exp(-np.clip(e, -30, 30))), np.zeros((2, 2))
        diff = (y - p) * weight
        gw = np.bincount(lattice.feats.ravel(), np.repeat(diff, lattice.feats.shape[1]), size) - ridge * w
        for k, g in enumerate((gw, diff[:first].sum() if chained else 0.0, gt)):
            moment[k] = 0.9 * moment[k] + g
        w, start, trans = w + rate * moment[0], start + rate * moment[1], trans + rate * moment[2]
    return {"w": w, "start": float(start), "trans": trans.tolist()}


def fit_crf(docs: list[tuple[int, np.ndarray, np.ndarray]]) -> dict | None:
    """docs: label, binned lines and their word counts of each sequence."""
    docs = [d for d in docs if len(d[1])]
    if len({d[0] for d in docs}) < 2:
        return None
    lattice = Lattice([x for _, x, _ in docs])
    label = np.array([docs[i][0] for i in lattice.order])
    rank = np.argsort(lattice.sequence, kind="stable")  # from one sequence after the other to steps
    words = np.empty(len(rank))
    words[rank] = np.concatenate([docs[i][2] for i in lattice.order])
    given = label[lattice.sequence]
    # both kinds of documents weigh the same, as labels are mostly of one kind
    of_kind = np.bincount(given, minlength=2)
    weight = (0.5 / of_kind)[given]

    def mixed(path: np.ndarray) -> np.ndarray:
        """The path where more than half of the words of a sequence have its label, else the label."""
        agree = np.bincount(lattice.sequence, words * (path == given)) > 0.5 * np.bincount(lattice.sequence, words)
        return np.where(agree[lattice.sequence], path, given)

    crf = fit_chain(lattice, given, weight, chained=False)
    y = mixed((crf["w"][lattice.feats].sum(1) > 0).astype(int))
    crf = fit_chain(lattice, y, weight, chained=True)
    emit, path = crf["w"][lattice.feats].sum(1), np.empty(len(rank), int)
    path[rank] = [s for i in np.split(emit[rank], np.cumsum([len(docs[i][1]) for i in lattice.order])[:-1]) for s in viterbi(i.tolist(), crf["start"], crf["trans"])]
    return fit_chain(lattice, mixed(path), weight, chained=True)


def train(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_runs: int = SAMPLE_RUNS) -> dict | None:
    """Fits the CRF on the sample_docs labelled documents of least hash, and of their runs of lines on the sample_runs of least
    hash; only the bins of their lines (a number a line) reach the driver."""
    picked = (
        labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    )
    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    place = BINS ** np.arange(len(EDGES))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, label, text in zip(*(c.to_pylist() for c in b.columns)):
                rows, sizes, _ = line_features(text)
                code = ((binned(np.array(rows, float)) % BINS) * place).sum(1).tolist() if rows else []
                out += [(doc, i, label, code[i : i + RUN_LINES], sizes[i : i + RUN_LINES]) for i in range(0, len(code), RUN_LINES)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "at", "label", "lines", "words"])

    runs = (
        texts.join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(features, "doc_id long, at int, label int, lines array<int>, words array<int>")
        .orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "lines").limit(sample_runs).collect()
    )
    offset = np.arange(len(EDGES)) * BINS
    return fit_crf([(r.label, np.array(r.lines, np.int64)[:, None] // place % BINS + offset, np.array(r.words)) for r in runs])


def verdicts(texts: list[str | None], crf: dict | None, min_content_share: float) -> list[tuple]:
    """The columns of RESULT after doc_id, for each text."""
    out, lines = [], []
    for text in texts:
        text = text or ""
        words = text.encode("utf-8", "replace").split()
        rows, sizes, again = line_features(text)
        n, rep = len(words), repeat_words(words)
        failed = n < MIN_WORDS or 100 * rep > MAX_REPEAT_PERCENT * n
        out.append(((n, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, "#*$%&|<>")), again, rep, failed), sizes))
        lines += rows
    emit = crf["w"][binned(np.array(lines, float).reshape(-1, len(EDGES)))].sum(1).tolist() if crf else []
    at, done = 0, []
    for row, sizes in out:
        share = 1.0 if sizes else 0.0
        if crf and sizes:
            path = viterbi(emit[at : at + len(sizes)], crf["start"], crf["trans"])
            share = sum(s for s, p in zip(sizes, path) if p) / sum(sizes)
        at += len(sizes)
        done.append((*row, not row[-1] and share >= min_content_share, share))
    return done


def quality_rules(documents: DataFrame, crf: dict | None, min_content_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """documents(doc_id, text) -> RESULT. One pass, no shuffle."""
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
    names = [c.split()[0] for c in RESULT.split(", ")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = verdicts(b.column("text").to_pylist(), crf, min_content_share)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, RESULT)


def keep_documents(documents: DataFrame, crf: dict | None, min_content_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The documents, all columns, that the rules keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = verdicts(b.column(b.schema.get_field_index("text")).to_pylist(), crf, min_content_share)
            yield b.filter(pa.array([r[6] for r in rows], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
