"""The training-data operators on small tables: against SQL, against brute force, and on odd rows."""

import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lessonlake.llm import bpe, common, components, decontaminate, html_extract, line_dedup, minhash, pii, quality_gam, quality_rules, substring_dedup, url_filter
from lessonlake.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, key string, n long"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with the names that operators use."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "a b c d e f g h i j k l m n o p q r s t u"), (5, "a b c d e f g h i j k l m n o p q r s t u"), (6, "a b c d e f g h i j k l m n o p q r s t u"), (None, "a b c d e f g h i j k l m n o p q r s t u"), (7, long)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@needs_tables
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql_twin(spark, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    other = con.sql(Q.SQL[name])
    assert sorted(other.columns) == cols
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(other.select(*cols).fetchall(), key=str)


def texts(seed=0, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        lines = [" ".join(rng.choices(vocab, k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5))]
        if i and rng.random() < 0.5:
            copy = rng.choice(out).split("\n")
            words = copy[0].split()
            words[rng.randrange(len(words))] = rng.choice(vocab)
            lines.append(" ".join(words))
            lines += copy[1:]
        out.append("\n".join(lines))
    return out


def test_lines_against_brute_force(spark):
    docs = texts()
    seen, want = [], {}
    for i, t in enumerate(docs):
        want[i] = []
        for j, line in enumerate(t.split("\n")):
            s = set(line.split())
            if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                want[i].append(j)
            seen.append(s)
    rows = line_dedup.dedup_report(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in rows} == want and any(want.values())


@pytest.mark.parametrize("limits", [(3, 18), (1, 4)])
def test_lines_at_hot_tokens(spark, monkeypatch, limits):
    """Every token, pair of tokens and cell over its bound: nothing is lost."""
    monkeypatch.setattr(line_dedup, "GROUP_ROWS", limits[0])
    monkeypatch.setattr(line_dedup, "CELL_BITS", (limits[1], limits[1]))
    rng = random.Random(7)
    form = [f"f{i}" for i in range(18)]
    docs = texts(5, 80) + [" ".join(rng.sample(form, len(form)) + [f"g{rng.randrange(6)}" for _ in range(rng.randrange(5))]) for _ in range(60)] + ["a", "b a", "a b c d", "a b c d e", "a b c d e f"] * 2
    seen, want = [], {}
    for i, t in enumerate(docs):
        want[i] = []
        for j, line in enumerate(t.split("\n")):
            s = set(line.split())
            if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                want[i].append(j)
            seen.append(s)
    rows = line_dedup.dedup_report(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in rows} == want and any(want.values())


def test_line_candidates_beyond_the_nearest(spark):
    """A line whose nearest candidates all fail must still meet the rest."""
    base = [f"t{i}" for i in range(20)]
    near = [" ".join(base[:17] + [f"x{k}a", f"x{k}b", f"x{k}c"]) for k in range(12)]
    docs = [" ".join(base), *near, " ".join(base[:19] + ["zz"])]
    rows = line_dedup.dedup_report(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    sets = [set(t.split()) for t in docs]
    want = {i: [0] if any(100 * len(s & o) >= 80 * len(s | o) for o in sets[:i]) else [] for i, s in enumerate(sets)}
    assert {r.doc_id: r.removed for r in rows} == want


def test_order_of_tokens_that_differ_in_low_bits_only():
    line, h = np.repeat(np.arange(3), 4), np.array([9, 8, 1 << 63, 8, 3, 2, 1, 0, 5, 5, 4, 6], np.uint64)
    for x in (h, h << np.uint64(40)):
        order = line_dedup.line_order(line, x)
        assert (line[order] == line).all() and (x[order] == x[np.lexsort((x, line))]).all()
    assert line_dedup.line_order(np.zeros(1, int), h[:1]).tolist() == [0]


@pytest.mark.parametrize("part_rows, chunk_rows", [(3, 4), (2000, 100_000)])
def test_copies_beyond_the_nearest(spark, monkeypatch, part_rows, chunk_rows):
    """Many texts near one original, most of them under 0.8 like each other, of several lengths: each link is found, by brute force."""
    for name, value in (("PART_ROWS", part_rows), ("CHUNK_ROWS", chunk_rows), ("LOOK_BACK", 3)):
        monkeypatch.setattr(minhash, name, value)
    rng, docs = random.Random(9), []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(60)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            docs.append(words + [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 12))])
    sets = [set(zip(x, x[1:])) for x in docs]
    root = list(range(len(docs)))
    find = lambda i: i if root[i] == i else find(root[i])
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    rows = minhash.near_duplicates(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string"), 2).collect()
    want = {i: find(i) for i in range(len(docs))}
    assert {r.doc_id: r.component_id for r in rows} == want and 3 < len(set(want.values())) < len(docs)


def test_wide_buckets_of_substrings(spark, monkeypatch):
    """A passage in many documents with other neighbours: no bucket that a task holds is wider than the bound, and results stay."""
    monkeypatch.setattr(substring_dedup, "BUCKET_WINDOWS", 60)
    monkeypatch.setattr(substring_dedup, "RUN", 16)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    held, inner = [], substring_dedup.bucket_firsts
    monkeypatch.setattr(substring_dedup, "bucket_firsts", lambda strings: held.append(strings.groupBy("mini").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]) or inner(strings))
    rng = random.Random(3)
    other = lambda: [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 25))]
    passage, small = [f"p{i}" for i in range(40)], [f"q{i}" for i in range(25)]
    docs = [other() + (passage[k % 3 :] + passage[:30] if k % 4 == 0 else passage) + other() + (small if k < 3 else []) for k in range(40)]
    seen, want = set(), {}
    for d, words in enumerate(docs):
        gone = set()
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            gone |= set(range(i, i + 20)) if w in seen else set()
            seen.add(w)
        want[d] = " ".join(x for i, x in enumerate(words) if i not in gone)
    rows = substring_dedup.dedup_substrings(spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert held and (held[0] or 0) <= 60


def test_benchmark_windows_by_broadcast_and_by_join(spark, monkeypatch):
    rng = random.Random(2)
    words = lambda n: [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)]
    items = [words(n) for n in (0, 1, 5, 13, 20, 40)]
    docs = [words(n) for n in (0, 3, 30)] + [words(7) + x + words(5) for x in items] + [items[5][10:30] + words(300)]
    benchmark = spark.createDataFrame([(f"i{i}", " ".join(x).upper()) for i, x in enumerate(items)] + [("i9", None), (None, "ax")], "item_id string, text string")
    table = spark.createDataFrame([(d, " ".join(x), 1, "x") for d, x in enumerate(docs)] * 2, "doc_id long, text string, hits int, text_key string")
    want = []
    for d, x in enumerate(docs):
        hit, who = set(), set()
        for i, y in enumerate(items):
            n = min(13, len(y))
            for a in range(len(y) - n + 1):
                for at in range(len(x) - n + 1) if n else ():
                    if x[at : at + n] == y[a : a + n]:
                        hit |= set(range(at, at + n))
                        who.add(f"i{i}")
        want += [(d, len(x), len(hit), sorted(who), bool(hit) and 20 * len(hit) >= len(x))] * 2
    for bound, hot in ((decontaminate.BLOCK_BYTES, 10), (10, 10_000), (10, 1)):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        found = decontaminate.scan(table, benchmark, block_bytes=bound)
        assert found.columns[:4] == table.columns
        got = sorted((r.doc_id, len(docs[r.doc_id]), int(decontaminate.covered(len(docs[r.doc_id]), r[4]).sum()), r[5]) for r in found.collect())
        assert got == [w[:4] for w in want]
    rows = decontaminate.decontaminate_report(table, benchmark).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows] == [(*w[:3], len(w[3]), w[4]) for w in want]


def test_bpe_round_trip(spark):
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t, own = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json")), bpe.WordBpe(bpe.load_vocabulary())
    rng = random.Random(1)
    cases = ["", "a" * 3000, "It's <|endoftext|> ok", "ΣΑΣ İß", *["".join(rng.choice("abcΣİé́st 0١<|>\n 😀ßẞK'") for _ in range(40)) for _ in range(200)]]
    for x in cases:
        ids = t.encode(x, add_special_tokens=False).ids
        assert own.encode(x) == ids
        assert own.decode(ids) == t.decode(ids, skip_special_tokens=False)
    assert own.decode([-1, 10**9]) == ""
    row = bpe.bpe_digests(spark.createDataFrame([(1, "the end")], "doc_id long, text string"), bpe.load_vocabulary()).first()
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, t.encode("the end", add_special_tokens=False).ids)).encode()).hexdigest()


def test_extraction():
    page = """<html><head><title>t</title><script>var a="</p>"</script></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy, now, this, fine, thing, today.</div>
    <article><h1>A &amp; B</h1><p>First paragraph, with some text, and   more.<p>Second<br>one, &lt;ok&gt;.</p><div class="comments"><p>Nice, post, really, thanks, for, it, all.</p></div></article><form><p>Name, please.</p></form><footer>foot</footer>"""
    assert html_extract.main_text(page) == "A & B\nFirst paragraph, with some text, and more.\nSecond one, <ok>."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""


def test_attributes_are_read_by_name():
    """What stands in another attribute's name or value neither hides an element nor makes it furniture."""
    said = "A paragraph, with words, that stays where it is, and is long enough."
    for a in ('style="overflow:hidden"', "title='hidden id=search'", "href=/hidden-x?id=search", 'data-id="comments"', 'data-role = "navigation"', "aria-hidden=false", 'href="?id=search"', "data-hidden", 'style="a" title="b hidden c"'):
        assert html_extract.main_text(f"<article><p>{said}</p><div {a}><p>{said}</p></div></article>") == f"{said}\n{said}", a
    for a in ("hidden", "HIDDEN=''", 'aria-hidden="true"', "class=comments", "id = 'search'", 'style="x" role="navigation"', "data-x hidden", 'title="a"hidden'):
        assert html_extract.main_text(f"<article><p>{said}</p><div {a}><p>{said}</p></div></article>") == said, a


def test_optional_ends_labels_and_what_stands_above(spark):
    said = "A paragraph, with words, that stays where it is, and is long enough."
    for list_ in ("<datalist><option value=a>one<option value=b>two</datalist>", "<select><option>one<option>two</select>", "<datalist><option value=a>one<option>two", "<select><optgroup label=x><option>one"):
        assert html_extract.main_text(f"<body>{list_}<article><p>{said}</p></article></body>") == said, list_
    assert html_extract.main_text(f"<article><p>The <label>word</label> stays. {said}</p></article>") == f"The word stays. {said}"
    body = f"<div class=entry-content><p>{said}</p><p>{said}</p></div>"
    for wrap in ("<article>%s</article>", "<main>%s</main>", "<div class=post>%s</div>"):
        page = wrap % f"<h1>T</h1><div>Lead in short.</div>{body}<ul><li><a href=x>other</a><li><a href=y>pages</a></ul><pre>x = 1</pre>"
        assert html_extract.main_text(f"<body><div>Site</div>{page}<div>end</div>") == f"T\nLead in short.\n{said}\n{said}\nx = 1", wrap
    assert html_extract.main_text(f"<body><h1>T</h1><div id=content><p>{said}</p></div><p>&copy; me</p>") == f"T\n{said}"


def test_extraction_of_built_pages(spark):
    """Pages built of known blocks among furniture give these blocks again, and nothing else."""
    rng, rows, want = random.Random(4), [], {}
    prose = lambda n: " ".join(rng.choice(["lorem", "ipsum,", "dolor", "&amp;", "sit"]) for _ in range(n)) + "."
    furniture = ["<nav><a href=x>Menu</a></nav>", "<div class='ad banner'>Buy, this, now, please, do, it, today.</div>", "<aside><p>Other, things, to, read.</p></aside>", "<form><label>Name</label><input></form>", "<script>if (a < b) c('</p>')</script>", "<!-- <p>no</p> -->", "<div id=comments><p>Well, said, all of it, I say.</p></div>", "<div role=navigation>Up</div>", "<style>p{}</style>"]
    for page in range(200):
        inner, text = [f"<h1>Title {page}</h1>"], [f"Title {page}"]
        for _ in range(rng.randrange(1, 9)):
            body = prose(rng.randrange(3, 60))
            kind = rng.choice(["p", "p", "p", "h2", "li", "blockquote", "pre", "open"])
            cut = body.replace(" ", rng.choice([" ", "\n ", "  "]))
            inner.append({"li": f"<ul><li>{cut}</ul>", "open": f"<p><b>{cut}</b>"}.get(kind, f"<{kind}>{cut}</{kind}>"))
            text.append(body.replace("&amp;", "&"))
            if rng.random() < 0.4:
                inner.append(rng.choice(furniture))
        around = [rng.choice(furniture) for _ in range(4)]
        rows.append((page, "u", f"<!DOCTYPE html><html><head><title>no</title></head><body>{''.join(around[:2])}<article>{''.join(inner)}</article>{''.join(around[2:])}<footer>foot</footer></body></html>"))
        want[page] = "\n".join(text)
    got = html_extract.extract(spark.createDataFrame(rows + [(900, None, None), (901, "u", ""), (900, None, None)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want | {900: "", 901: ""} and all(r.n_chars == len(r.text) for r in got) and len(got) == 203
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).collect() == []


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    words = url_filter.bloom(keys, 5000)
    assert url_filter.may_hold(words, keys.toPandas()["h"].to_numpy()).all()
    assert url_filter.may_hold(words, spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy()).mean() < 0.02
    assert url_filter.bloom(keys, 1 << 40) is None


@needs_tables
def test_models(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_gam.score(docs, quality_gam.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.95 * len(scored)
    rows = quality_rules.quality_rules(docs, quality_rules.train(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.kept or r.base_failed for r in rows if r.quality == 1)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in rows)


def base_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside), failed


def test_base_columns_against_brute_force(spark):
    rng = random.Random(6)
    texts_ = [None, "", " \n", "a\n\n \na\na", *[" ".join(rng.choices(["a", "b", "é#", "<|>", "\n", "x\ty\x0b"], k=rng.randrange(60))) for _ in range(60)], "one two three four five six seven eight " * 5]
    rows = quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string"), None).orderBy("doc_id").collect()
    assert [tuple(r)[1:7] for r in rows] == [base_counts(t) for t in texts_]
    assert all(r.kept == (not r.base_failed) for r in rows if r.n_words)


def test_viterbi_is_the_best_of_all_paths():
    rng = random.Random(2)
    for _ in range(200):
        emit, start = [rng.gauss(0, 2) for _ in range(rng.randrange(1, 8))], rng.gauss(0, 1)
        trans = [[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)]
        worth = lambda p: sum(e for e, s in zip(emit, p) if s) + start * p[0] + sum(trans[a][b] for a, b in zip(p, p[1:]))
        best = max(itertools.product((0, 1), repeat=len(emit)), key=worth)
        assert abs(worth(quality_rules.viterbi(emit, start, trans)) - worth(best)) < 1e-9


def test_chain_marginals_against_all_paths():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 4, (n, 2)) for n in (3, 1, 5)]
    lattice = quality_rules.Lattice(sequences)
    w, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    p, joint = lattice.marginals(w[lattice.feats].sum(1), trans)
    for i, sequence in enumerate(lattice.order):
        e, at = w[sequences[sequence]].sum(1), np.flatnonzero(lattice.sequence == i)
        paths = list(itertools.product((0, 1), repeat=len(e)))
        score = np.exp([sum(e[t] for t, s in enumerate(q) if s) + sum(trans[a, b] for a, b in zip(q, q[1:])) for q in paths])
        for t in range(len(e)):
            assert abs(p[at[t]] - sum(x for x, q in zip(score, paths) if q[t]) / score.sum()) < 1e-9
    assert abs(joint.sum(axis=(1, 2)) - 1).max() < 1e-9


def test_lines_of_one_document_differ(spark):
    """Documents that mix prose and junk have lines of both kinds, and the words of the content lines decide."""
    rng = random.Random(5)
    prose = lambda: " ".join(rng.choice(["the", "river", "runs", "quietly", "under", "old", "bridges"]) for _ in range(12)) + "."
    junk = lambda: " ".join(rng.choice(["$$$", "BUY!!", "###", "WIN|", "&&&"]) for _ in range(12))
    docs, labels, want = [], [], {}
    for i in range(300):
        good = i % 2
        lines = [prose() if rng.random() < (0.85 if good else 0.2) else junk() for _ in range(10)]
        if (sum(x[0].islower() for x in lines) > 5) != bool(good):
            continue
        docs.append((i, "\n".join(lines)))
        labels.append((i, good))
        want[i] = sum(x[0].islower() for x in lines) / 10
    table = spark.createDataFrame(docs, "doc_id long, text string")
    crf = quality_rules.train(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = quality_rules.quality_rules(table, crf).collect()
    mixed = [r for r in rows if 0 < r.content_share < 1]
    assert len(mixed) >= 0.9 * sum(0 < x < 1 for x in want.values()) and all(abs(r.content_share - want[r.doc_id]) < 0.11 for r in rows)
    assert all(r.kept == (want[r.doc_id] >= 0.5) for r in rows if not r.base_failed)
    assert quality_rules.train(table, spark.createDataFrame([(0, 1)], "doc_id long, quality int")) is None and quality_rules.train(empty(spark), spark.createDataFrame([], "doc_id long, quality int")) is None


def test_models_of_odd_rows(spark):
    """Null and empty texts get a score; without rows, or labels of both kinds, the share of label 1."""
    o, e = odd(spark), empty(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    crf = {"w": np.zeros(len(quality_rules.EDGES) * quality_rules.BINS), "start": 1.0, "trans": [[0.0, 0.0], [0.0, 0.0]]}
    assert quality_gam.score(e, quality_gam.train(e, none)).collect() == [] == quality_rules.quality_rules(e, crf).collect()
    assert {r.score for r in quality_gam.score(o, quality_gam.train(o, none)).collect()} == {0.5}
    assert len(quality_rules.quality_rules(o, crf).collect()) == 9 and quality_rules.keep_documents(o, crf).columns == o.columns
    assert {r.doc_id for r in quality_rules.keep_documents(o, None).collect()} == {5, 6, None}  # 7 repeats itself
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "http://a.com/en/", "y"), (2, "", "z"), (3, "http://", "z")], "page_id long, url string, host string")
    rules = spark.createDataFrame([("com", "/en/", "block"), (None, "/", "block"), ("com", "/en/", "block")], "host string, path string, verdict string")
    assert sorted((str(r.page_id), r.host, r.verdict) for r in url_filter.url_filter(pages, rules).collect()) == [("1", "", "allow"), ("1", "", "allow"), ("2", "", "allow"), ("3", "", "allow"), ("None", "a.com", "block")]
    assert url_filter.url_filter(pages.limit(0), rules).collect() == [] and url_filter.url_filter(pages, rules.limit(0)).count() == 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1002), (1001, 1002)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(401)) and {got[1000], got[1001], got[1002]} == {1000}


def test_surrogates(spark):
    said = "Mrs. Anna Smith and Mr Peter Smith wrote to Anna.Smith@mail.example.com from 10.20.130.7, card 4111 1111 1111 1111, +1 (663) 555-6869 or +1 663 555 6869, password=abc123XYZ. Госпожа Анна Петрова."
    rows = spark.createDataFrame([(1, said), (2, "Write anna.smith@MAIL.example.com or Herr Smith."), (3, None), (4, "")], "doc_id long, text string")
    a, b, c, d = (r for r in pii.replace_pii(rows, "k").orderBy("doc_id").collect())
    assert (c.text, d.text, c.n_entities) == (None, "", 0)
    for gone in ("Anna Smith", "Anna.Smith", "10.20.130.7", "4111 1111", "555-6869", "abc123XYZ", "Петрова"):
        assert gone not in a.text
    assert "Mrs. " in a.text and "Mr " in a.text and "password=" in a.text
    mail = [w for w in a.text.split() if "@" in w][0]
    assert b.text.split()[1].lower() == mail.lower() and mail.endswith(".com")
    assert a.text.split()[2] == a.text.split()[6] == b.text.split()[-1].rstrip(".")  # one surname
    again = pii.replace_pii(rows, "k").orderBy("doc_id").first()
    assert again.text == a.text != pii.replace_pii(rows, "other").orderBy("doc_id").first().text
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.format_string("at %d.%d.0.1", F.col("id") % 10, (F.col("id") / 10).cast("int")).alias("text"))
    out = [r.text for r in pii.replace_pii(many, "k").collect()]
    assert len(set(out)) == 300 and not set(out) & {r.text for r in many.collect()}


def test_surrogates_keep_entities_apart_and_together(spark):
    """By brute force over all mentions: one surrogate an entity, one entity a surrogate, none that is a real one; parts that are shared stay so."""
    rng = random.Random(8)
    names, domains = [f"{a}{b}" for a in "abc" for b in "xyz"], [f"{a}{t}" for a in ("m", "n", "mail.a", "mail.b", "q1") for t in (".com", ".net", ".org")]
    mails = sorted({f"{rng.choice(names)}@{rng.choice(domains)}" for _ in range(80)})
    people = [f"{t} {g} {s}" for t in ("Dr", "Herr", "Mrs.") for g in ("Anna", "Bo", "Олег") for s in ("Smith", "Ito", "Petrov")]
    phones = [f"+1 555 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}" for _ in range(40)]
    mentions = [*mails, *people, *sorted(set(phones))]
    rows = [(i, f"so {m} there") for i, m in enumerate(mentions)] + [(1000 + i, f"and {m.upper()} again") for i, m in enumerate(mails)]
    out = {r.doc_id: r.text for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string").withColumn("mentions", F.lit(1)).withColumn("n_entities", F.lit(2)), "k").collect()}
    new = {m: out[i][3:-6] for i, m in enumerate(mentions)}
    assert all(out[1000 + i][4:-6].lower() == new[m].lower() for i, m in enumerate(mails))
    assert len(set(new.values())) == len(mentions) and not set(new.values()) & set(mentions)
    domain = {}
    for m in mails:
        assert domain.setdefault(m.split("@")[1], new[m].split("@")[1]) == new[m].split("@")[1]
    assert len(set(domain.values())) == len(domain) and not set(domain.values()) & set(domain) and all(a[-4:] == b[-4:] for a, b in domain.items())
    surname = {}
    for m in people:
        assert new[m].split()[0] == m.split()[0] and surname.setdefault(m.split()[-1], new[m].split()[-1]) == new[m].split()[-1]
        assert bool(re.match("[А-Я]", new[m].split()[1])) == ("Олег" in m)
    assert all(re.fullmatch(r"\+1 \d{3} \d{3} \d{4}", new[p]) for p in phones)
    said = "Password: correcthorse1 and API_KEY = abcdefgh2, Dr. Anna Smith"
    row = pii.replace_pii(spark.createDataFrame([(1, said)], "doc_id long, text string"), "k").first()
    assert row.n_entities == 3 and row.text.startswith("Password: ") and not [x for x in ("correcthorse1", "abcdefgh2", "Anna", "Smith") if x in row.text]


def test_keys_in_all_three_ways(spark, monkeypatch):
    """A broadcast, a filter and a plain join give the same rows."""
    rows = spark.range(500).select((F.col("id") % 90).alias("k"), "id").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, -1L AS id"))
    keys = spark.range(60, 120).select(F.col("id").alias("k"))
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.com/en/1", None, "x", "https://b.com/", "http://a.com/en/1"] * 3)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    found = []
    for few, size in ((20_000, 1 << 24), (0, 1 << 24), (0, 0)):
        monkeypatch.setattr(common, "FEW_KEYS", few)
        monkeypatch.setattr(url_filter, "FEW_KEYS", few)
        monkeypatch.setattr(url_filter, "MAX_FILTER_BYTES", size)
        may, rest = common.split_by_keys(rows, "k", keys)
        assert may.count() + (rest.count() if rest is not None else 0) == 501 and (rest is None) == (size == 0)
        found.append((sorted(r.id for r in may.join(keys, "k").collect()), sorted(url_filter.url_filter(pages, rules).collect(), key=str)))
    assert found[0] == found[1] == found[2] and len(found[0][0]) == sum(i % 90 >= 60 for i in range(500)) and [r.verdict for r in found[0][1]].count("block") == 6


def test_secrets_without_digits(spark):
    """Each alone in its text, with no digit, @ or title beside it."""
    secrets = ["correcthorse", "abcDEFgh", "AKIA" + "QWERTYUIOPASDFGH", "ghp_" + "abcdefghijklmnopqr" * 2, "sk-" + "abcdefghijklmnopqrstu", "abcdef" * 6, "ABCDEF" * 6]
    said = [f"the password={secrets[0]} here", f"token: {secrets[1]}", *[f"use {s} now" for s in secrets[2:]]]
    rows = pii.replace_pii(spark.createDataFrame([*enumerate(said), (99, "a plain text")], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [r.n_entities for r in rows] == [1] * 7 + [0] and rows[7].text == "a plain text"
    assert not [s for s, r in zip(secrets, rows) if s in r.text]


def test_surrogates_where_a_format_is_used_up(spark):
    """All quads of single digits, all two-letter surnames of one initial set, and secrets and names that no shift changes."""
    quads = [f"{i // 1000}.{i // 100 % 10}.{i // 10 % 10}.{i % 10}" for i in range(10_000)]
    names = [f"Mr {a}{b}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]
    rest = ["Mr Աբ", "Mr Աբ Աբբ", "token=------", "token=-------", *[f"{c}@x.com" for c in "0123456789"]]
    said = [*quads, *names, *rest]
    rows = pii.replace_pii(spark.createDataFrame([*enumerate(said)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    out = [r.text for r in rows]
    assert all(r.n_entities == 1 for r in rows) and len(set(out)) == len(said) and not set(out) & set(said)
    assert all(re.fullmatch(pii.PATTERNS["ip"], x) for x in out[:10_000])
    assert all(re.fullmatch(r"Mr [A-Z][a-z]+", x) for x in out[10_000:10_676])
    assert not [x for x in out if "Աբ" in x] and all(x.startswith("token=---") for x in out[10_678:10_680])


def test_odd_rows(spark):
    o, e = odd(spark), empty(spark)
    bench = spark.createDataFrame([("b", "a b c d e f g h i j k l m n"), ("n", None), ("z", "")], "item_id string, text string")
    vocabulary = bpe.load_vocabulary()
    for f in (lambda d: quality_rules.quality_rules(d, None), line_dedup.dedup_report, lambda d: bpe.bpe_digests(d, vocabulary), lambda d: decontaminate.decontaminate_report(d, bench), minhash.near_duplicates, substring_dedup.dedup_substrings, lambda d: pii.replace_pii(d, "k")):
        assert len(f(o).collect()) == 9 and f(e).collect() == []
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(o).collect()}
    assert got[6].n_removed == 21 and got[5].n_removed == 0 and got[None].n_removed == 0 and got[7].n_removed == 30_000 - 997 - 0
    near = {r.doc_id: r for r in minhash.near_duplicates(o).collect()}
    assert near[6].component_id == 5 and near[None].kept and near[1].n_shingles == 0 and near[2].kept
    assert sorted(r.doc_id for r in decontaminate.decontaminate_report(o, bench).where("contaminated").collect() if r.doc_id) == [5, 5, 6]
    assert decontaminate.remove_contaminated(o, bench).columns == o.columns
    cut = {r.doc_id: r.text for r in decontaminate.remove_contaminated(o, bench, spans_only=True).collect()}
    assert cut[6] == " o p q r s t u"
    assert line_dedup.dedup_lines(o).columns == o.columns and minhash.dedup_documents(o).columns == o.columns


def test_pipeline_against_brute_force(spark):
    """Line dedup, near-dedup and decontamination of the pipeline, each on all that the one before kept; odd rows go through."""
    import corpus_pipeline as C

    rng = random.Random(11)
    words = lambda n: [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(n)]
    shared, item = words(30), words(16)
    base = [words(60) for _ in range(3)]
    texts_ = ["\n".join([" ".join(words(25)), " ".join(shared), " ".join(words(25))]) for _ in range(8)]
    texts_ += [" ".join(b[:i] + ["zz"] + b[i + 1 :]) for b in base for i in (0, 59)] + [" ".join(words(20) + item + words(20)), " ".join(item[:12] + words(40)), None, "", "one\n\none"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts_)] + [(None, "null id", "en", "s", 7)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    out = C.materialise(C.lines(spark, table, None))
    seen, want = [], {None: "null id"}
    for i, t in enumerate(texts_):
        kept, lost = [], False
        for line in (t or "").split("\n"):
            s = set(line.split())
            gone = bool(s) and any(100 * len(s & o) >= 80 * len(s | o) for o in seen)
            kept, lost = kept + ([] if gone else [line]), lost or gone
            seen += [s] * bool(s)
        if not lost or any(x.split() for x in kept):
            want[i] = None if t is None else "\n".join(kept)
    assert {r.doc_id: r.text for r in out.collect()} == want and out.columns == table.columns
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    near = C.near_duplicates(spark, table, None)
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in enumerate(texts_) if (w := (t or "").split())}
    first = {j: min([i for i in grams if i < j and 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j])], default=j) for j in grams}
    assert {r.doc_id for r in near.collect()} == {None} | {i for i in range(len(texts_)) if first.get(i, i) == i} and any(first[j] != j for j in grams)
    benchmark = spark.createDataFrame([("i", " ".join(item))], "item_id string, text string")
    assert {r.doc_id for r in decontaminate.remove_contaminated(table, benchmark).collect()} == {None, *range(len(texts_))} - {14}


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out = C.materialise(out)
        assert 0 < out.count() <= docs.count()
        docs = out
    assert C.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_of_a_pattern_are_not_taken_for_each_other(spark):
    left, right = thue_morse(1024), thue_morse(1024, True)
    lines = spark.createDataFrame([(1, left), (2, right), (3, left + " x"), (4, "short " * 3)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_report(lines).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    texts = [" ".join(f"{w}{i}" if i % 2 else w for i in range(25)) for w in (thue_morse(2048), thue_morse(2048, True))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0}
    folded = common.WordHashes(fold=True)(b"AB" * 40 + b" " + b"ab" * 40)[0]
    assert folded[0] == folded[1]


PROSE = "<p>This is the first paragraph of the article, with some words, and commas.</p><p>And a second one that goes on for a while, so that it scores.</p>"


@pytest.mark.parametrize("name", ["no-sidebar", "content-with-sidebar", "post hentry comments-open", "site has-sidebar", "page-with-ads", "legal", "layout sidebar-right"])
def test_a_wrapper_does_not_empty_a_page(name):
    want = "This is the first paragraph of the article, with some words, and commas.\nAnd a second one that goes on for a while, so that it scores."
    assert html_extract.main_text(f'<html><body><div class="{name}">{PROSE}</div></body></html>') == want
    assert html_extract.main_text(f'<div class="{name}"><article>{PROSE}</article><div class="sidebar">More to read here, all of it good.</div></div>') == want


def test_furniture_goes_beside_an_article():
    main = "<p>Main text of this page, which stays as it is, and is long enough.</p>"
    for name in ("sidebar", "comments", "post-comments", "widget area", "ads", "legal"):
        assert html_extract.main_text(f'<body><div>{main}</div><div class="{name}">{PROSE}</div></body>').startswith("Main text") and "second" not in html_extract.main_text(f'<body><div>{main}</div><div class="{name}">{PROSE}</div></body>')
    assert html_extract.main_text(f'<body><div class="comments">{PROSE}</div></body>') == ""


def test_siblings_and_boxes_of_an_article():
    html = f"<body><div><div>{PROSE}</div><div><p>Short end.</p></div><ul><li>one</li><li>two</li></ul><ul><li><a>more</a></li></ul><div>Copyright 2020 Inc.</div></div></body>"
    assert html_extract.main_text(html).split("\n")[2:] == ["Short end.", "one", "two"]
    assert html_extract.main_text(f"<article>{PROSE}<fieldset><p>Inside a fieldset.</p></fieldset><form><fieldset>Name</fieldset></form><dialog>Log in</dialog></article>").split("\n")[2:] == ["Inside a fieldset."]
    long = "".join(f"<p>Paragraph {i} of the lower part, which is much longer than the part above it, and goes on.</p>" for i in range(30))
    assert html_extract.main_text(f'<body><div class="story"><div>{PROSE}</div><div>{long}</div></div></body>').startswith("This is the first paragraph")


def test_long_pages_take_time_in_proportion():
    import time

    n = 60_000
    for page in ("<b>" * n + "<p>x" * n, "<b>" * n + "</i>" * n, "<i><p>" + "<b>" * n + "</i>" * n, "<ul><li><ul>" + "<div>" * n + "<li>x</li>" * n, "<div>" * n + "</p>" * n, "<table>" + "<tr><td>x" * n, "<select>" * n + "<p>x" * n):
        began = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - began < 15


def test_names_of_many_forms(spark):
    said = ["Frau Prof. Müller", "Dr. med. Anna Weber", "Sr. García", "Mr SMITH", "Señora Ana María de la Cruz", "Mrs Jones-Lee", "Herr Dr. von der Heide", "Frau Müller", "Mr Van", "Herr Müller came"]
    out = [r.text for r in pii.replace_pii(spark.createDataFrame([*enumerate(said)], "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    for word in ("Müller", "Weber", "Anna", "García", "SMITH", "Ana", "María", "Cruz", "Jones", "Lee", "Heide"):
        assert not any(re.search(rf"\\b{word}\\b", x) for x in out), (word, out)
    assert [re.match(r"(Frau Prof\. |Dr\. med\. |Sr\. |Mr |Señora |Mrs |Herr Dr\. |Frau |Herr )", x)[0] for x in out] == ["Frau Prof. ", "Dr. med. ", "Sr. ", "Mr ", "Señora ", "Mrs ", "Herr Dr. ", "Frau ", "Mr ", "Herr "]
    assert re.fullmatch(r"Mr [A-Z]{5}", out[3]) and re.fullmatch(r"Señora \S+ \S+ de la \S+", out[4]) and re.fullmatch(r"Mrs [A-Z][a-z]{4}-[A-Z][a-z]{2}", out[5]) and " von der " in out[6]
    assert out[0].split()[-1] == out[7].split()[-1] == out[9].split()[1]  # one surname


def test_a_session_without_a_key_gets_a_random_one(spark):
    spark.conf.unset(Q.PII_KEY)
    first = Q.pii_key(spark)
    assert len(first) == 64 and Q.pii_key(spark) == first
    spark.conf.unset(Q.PII_KEY)
    assert Q.pii_key(spark) != first
    spark.conf.unset(Q.PII_KEY)
