"""Alignment, n-gram join and spelling variants: against brute force and on odd rows."""

import hashlib
import os
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lessonlake.llm import align, common, line_dedup, minhash, ngram_join, quality_gam, spelling
from lessonlake.llm import queries as Q
from tests.llm.test_llm import SF, empty, needs_tables, odd

tokenizers_there = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no tokenizers")
ODD_TEXTS = [None, "", " ", "\n\n x\ny <|endoftext|> </s> ▁q", "a\nb  c\t d e <|endoftext|></s> ok \x1c z\x00 'll don't it's\n\nfoo \n bar\r\n baz ﬁ 漢字 emoji 😀 é́", "x" * 300 + " " + "\n".join("abc"), "a b"]


def align_by_hand(rows):
    """(doc_id, text) -> the rows of op11's contract, from whole texts, with the library that each file is for."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = align.load_tokenizers()
    left, right, t = Tokenizer.from_str(a), sentencepiece.SentencePieceProcessor(model_proto=b), align.Tokenizers(a, b)
    left.encode_special_tokens = True
    found, docs = [], Counter()
    for doc, text in rows:
        ia = left.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = right.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(t.bytes_a[i] for i in ia) != raw or b"".join(t.bytes_b[i] for i in ib) != raw:
            ia, ib = [], []
        groups, x, y, i, j = [], 0, 0, 0, 0
        while i < len(ia):
            ga, gb = [], []
            while not gb or x != y:
                if not ga or x < y:
                    ga.append(ia[i])
                    x, i = x + len(t.bytes_a[ia[i]]), i + 1
                else:
                    gb.append(ib[j])
                    y, j = y + len(t.bytes_b[ib[j]]), j + 1
            groups.append((ga, gb))
        links = Counter((p, q) for u, v in groups for p in u for q in v)
        docs.update(links.keys())
        found.append((doc, len(ia), len(ib), groups, links))
    most = {}
    for (p, _), n in docs.items():
        most[p, "a"] = max(most.get((p, "a"), 0), n)
    out = []
    for doc, na, nb, groups, links in found:
        text = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        best = sum(k for pair, k in links.items() if docs[pair] == most[pair[0], "a"])
        out.append((doc, na, nb, len(groups), sum(links.values()), best, sum(k * docs[p] for p, k in links.items()), hashlib.sha256(text.encode()).hexdigest() if na else ""))
    return sorted(out, key=str)


@needs_tables
@tokenizers_there
@pytest.mark.parametrize("limits", [{}, {"MOST_PAIRS": 300}, {"MOST_PAIRS": 0, "CACHE_SEGMENTS": 50}])
def test_alignment_against_whole_texts(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(align, name, value)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-i, t) for i, t in enumerate(ODD_TEXTS, 1)] + [(None, "a b"), (-7, "a b")], "doc_id long, text string"))
    got = align.align(docs, *align.load_tokenizers()).collect()
    assert sorted((tuple(r) for r in got), key=str) == align_by_hand([tuple(r) for r in docs.collect()])


@tokenizers_there
def test_both_readers_of_the_first_tokenizer_agree():
    a, b = align.load_tokenizers()
    ranks, file = align.Tokenizers(a, b), align.Tokenizers._file(a)
    own = [x.decode("utf-8", "ignore") for x in ranks.bytes_a]
    texts = [x for x in own if x] + [" " + x for x in ODD_TEXTS if x]
    assert ranks._a(texts) == file(texts)


def test_groups_end_where_both_end():
    r = random.Random(1)
    for _ in range(50):
        n = r.randrange(1, 60)
        ends = [np.array(sorted({n, *r.sample(range(1, n + 1), r.randrange(n))})) for _ in range(2)]
        both = sorted(set(ends[0]) & set(ends[1]))
        for side, last in zip(ends, align.last_tokens(*ends)):
            assert [int(ends[1][k]) for k in last] == [next(int(e) for e in both if e >= x) for x in side]


def linked_by_hand(docs, shingle, percent):
    sets = {}
    for d, t in docs:
        words = ngram_join.words_of(t)
        k = min(shingle, len(words))
        if words and d is not None:
            sets[d] = set(zip(*[words[i : len(words) - k + 1 + i] for i in range(k)]))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(sets.get(d, ())), find(d) if d in sets else d) for d, _ in docs), key=str)


def families(seed):
    """Copies of some texts, each with a few words changed; also many short ones that begin with one rare word."""
    r, docs = random.Random(seed), []
    for _ in range(45):
        base = [r.choice("abcdefghijklmnop") + str(r.randrange(40)) for _ in range(r.choice([3, 4, 5, 8, 12, 30, 80, 200]))]
        for _ in range(r.choice([1, 2, 5, 20])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                p, kind = r.randrange(len(w)), r.randrange(3)
                w[p : p + (kind != 2)] = [] if kind == 1 and len(w) > 1 else ["z" + str(r.randrange(5))]
            docs.append(" ".join(w[len(w) // 2 :] + w[: len(w) // 2] if r.random() < 0.2 else w))
    common = " ".join(f"c{i}" for i in range(30))
    docs += [f"rare {common} {'end ' * (i % 3)}{i % 4}" for i in range(24)]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("limits", [{}, {"PART_ROWS": 3, "CHUNK_ROWS": 7, "LOOK_BACK": 1}])
def test_ngram_join_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    docs = families(3)
    got = ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == linked_by_hand(docs, 4, ngram_join.PERCENT)


def test_members_of_groups_are_expanded(spark):
    """Texts of one size and prefix are one group, though some are not alike; each of them finds its own near ones."""
    tail = [f"t{i}" for i in range(60)]
    other = [f"u{i}" for i in range(60)]
    docs = [(1, " ".join(tail)), (2, " ".join(tail + ["x"])), (3, " ".join(other)), (4, " ".join(["y", *other])), (5, " ".join(tail)), (6, "t1 t2 t3 t4"), (7, "T1 t2\nt3 t4")]
    got = ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 1, 6: 6, 7: 6}


def variants_by_hand(docs, least):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{d}:{run}".encode()) if d is not None else 1
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= least}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        a, b = sorted((a, b), key=len)
        return any((a[:i] + a[i + 1 :] if len(a) == len(b) else a) == b[:i] + b[i + 1 :] and (len(a) < len(b) or a[:i] == b[:i]) for i in range(len(b)))

    close = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(c, key=lambda x: (-n[x], x)) for w, c in close.items() if c}
    form = {w: x for w, x in best.items() if n[x] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(close[w]), n[form[w]] if w in form else None) for w in n), key=str)


@pytest.mark.parametrize("limits", [{}, {"SUBTREE_WORDS": 3, "ASK_ROWS": 4, "GRID": 1, "CHECKED": 5, "HELD_WORDS": 10}])
def test_variants_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(spelling, name, value)
    r = random.Random(7)
    base = ["".join(r.choice("abcdeÉñß") for _ in range(r.randrange(5, 9))) for _ in range(40)] + ["listen", "silent", "tinsel", "ABCDEF", "ÀÿÀÿÀÿ"]
    words = []
    for w in base:
        words += [w] * r.choice([1, 30, 150])
        for _ in range(4):
            p = r.randrange(len(w))
            words += [r.choice([w[:p] + w[p + 1 :], w[:p] + "x" + w[p:], w[:p] + "y" + w[p + 1 :]])] * r.choice([1, 2, 6])
    r.shuffle(words)
    docs = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)] + [(None, " ".join(words[:50])), (3, "")]
    got = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), least=2).collect()
    assert sorted((tuple(x) for x in got), key=str) == variants_by_hand(docs, 2)


def test_odd_rows_of_the_new_operators(spark):
    rows = odd(spark)
    joined = ngram_join.ngram_join(rows).collect()
    assert len(joined) == rows.count() and {r.doc_id: r.component_id for r in joined}[6] == 5 and {r.doc_id: r.n_shingles for r in joined}[7] == 30_000 - 3 - (30_000 - 3 - 997)
    assert ngram_join.ngram_join(empty(spark)).count() == spelling.spelling_variants(rows).count() == spelling.spelling_variants(empty(spark)).count() == 0
    long = spark.createDataFrame([(i, "q" * 50_000 + " " + "q" * 50_000 + "z") for i in range(5)], "doc_id long, text string")
    assert sorted((len(r.word), r.n, r.n_near) for r in spelling.spelling_variants(long).collect()) in ([(50_000, 5, 1), (50_001, 5, 1)],)
    if os.path.isdir("/opt/tokenizers"):
        files = align.load_tokenizers()
        got = align.align(rows, *files).collect()
        assert len(got) == rows.count() and {r.doc_id: r.n_a for r in got}[1] == 0 and {r.doc_id: r.n_groups for r in got}[4] == 1
        assert align.align(empty(spark), *files).count() == 0


@needs_tables
def test_new_operators_are_registered():
    assert {"op11_align", "op12_ngram_join", "op13_spelling"} <= set(Q.queries())


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_copies_are_found(spark, shingle):
    """Near-dedup of the pipeline and of op9: every link between families of copies, by brute force."""
    docs = families(11)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle).collect()
    want = {d: root for d, _, root in linked_by_hand(docs, shingle, 80)}
    merged = [d for d, root in want.items() if d != root]
    assert len(merged) > 60 and sum(not r.kept for r in got if r.doc_id in merged) >= 0.9 * len(merged)
    assert {r.doc_id: r.component_id for r in got} == want
    kept = minhash.dedup_documents(spark.createDataFrame(docs, "doc_id long, text string"), shingle)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, root in want.items() if d == root)


def test_tables_on_the_way_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/{uuid.uuid4().hex}")
    docs = spark.createDataFrame(families(2)[:60], "doc_id long, text string")
    for f in (ngram_join.ngram_join, minhash.near_duplicates, spelling.spelling_variants, minhash.dedup_documents):
        before = len(os.listdir(tmp_path))
        f(docs).count()
        assert len(os.listdir(tmp_path)) == before + 1, f  # the result itself


@needs_tables
def test_scores_against_a_plain_additive_scorer(spark):
    """Row by row: bins by counting the edges below, entries added one by one."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_gam.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(-1, None), (-2, ""), (None, "a b c")]
    got = quality_gam.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows)
    want = []
    for doc, text in rows:
        x = quality_gam.text_features(text)
        bins = [sum(edge < value for edge in edges) for value, edges in zip(x, model.edges)]
        total = model.bias + sum(table[b] for b, table in zip(bins, model.main))
        for i, j, table in model.pairs:
            cell = [bins[k] * quality_gam.PAIR_BINS // len(model.main[k]) for k in (i, j)]
            total += table[cell[0] * quality_gam.PAIR_BINS + cell[1]]
        want.append((doc, doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1, 1 / (1 + np.exp(-min(max(total, -30), 30)))))
    key = lambda r: (str(r[0]), r[2])
    for a, b in zip(sorted(((r.doc_id, r.held_out, r.score) for r in got), key=key), sorted(want, key=key)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9
    assert all(r.predicted == (r.score >= 0.5) for r in got) and model.pairs and any(t.any() for t in model.main)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt(spark, monkeypatch, how):
    """The rows of a plain join; a key with most rows is in several parts, each with few."""
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}", i % 5) for i in range(300)] + [(300, None, 1), (301, "alone", 1)], "doc_id long, key string, part int")
    others = spark.createDataFrame([("hot", 1.0), ("hot", 2.0), ("k1", 3.0), ("none", 4.0)], "key string, hot_key double")
    sizes = rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    got, want = common.dealt_join(rows, others, ["key"], sizes, ["doc_id"], how), rows.join(others, "key", how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert "ceil" in got._jdf.queryExecution().optimizedPlan().toString().lower()  # parts, not the plain join
    assert common.dealt_join(rows, others, ["key"], sizes.where("false"), ["doc_id"], how).count() == want.count()


def test_copies_and_sets_of_many_documents(spark, monkeypatch):
    """Copies of one text are named in parts; texts of other words with the same set are linked by the comparison of their words."""
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    text = "a b c a d e f g h i j k l m n o p q r s t"
    same = "c a b c a d e f g h i j k l m n o p q r s t"  # c a stands twice
    sets = [set(zip(x.split(), x.split()[1:])) for x in (text, same)]
    assert sets[0] == sets[1]
    rows = [(i, text.upper() if i % 2 else text) for i in range(5, 40)] + [(3, same), (50, same), (1, "alone in the world")] + [(i, None) for i in range(60, 70)]
    for shuffled in (rows, rows[::-1]):
        got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(shuffled, "doc_id long, text string"), 2).collect()}
        assert got == {d: (3, d == 3) if t and d != 1 else (d, True) for d, t in rows}


def test_lines_that_many_documents_repeat(spark, monkeypatch):
    """The first of them stays, whatever the number of parts that the others are in."""
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    line = "one two three four five six"
    docs = spark.createDataFrame([(i, f"w{i} x{i}\n{line.upper() if i % 2 else line}") for i in range(60)], "doc_id long, text string")
    got = {r.doc_id: r.removed for r in line_dedup.dedup_report(docs).collect()}
    assert got == {i: [1] if i else [] for i in range(60)}
