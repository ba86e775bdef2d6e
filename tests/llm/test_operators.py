import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, rank double, bin int, k int, rep long, size string, t int, copy string"


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def words(r, n, vocab=400):
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


def corpus(seed=3, n=120):
    """Random texts, exact and near copies, shared passages, and the odd rows."""
    r = random.Random(seed)
    rows, passage = [], words(r, 60)
    base = words(r, 160)
    for i in range(n):
        w = words(r, r.choice([12, 40, 90, 200]))
        if i % 10 == 3:
            w = w[:30] + passage + w[30:]
        if i % 4 == 1:  # near copies with one to four changed words
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append([i, " ".join(w)])
    for i in (5, 20, 40):
        rows.append([1000 + i, rows[i][1]])
    rows += [[2000, None], [2001, ""], [2002, " \t\n "], [2003, "one two"], [2004, "One  TWO"], [2005, "a " * 3000], [2006, "Ünï çødé " * 30]]
    return [(i, t, "en", f"s{(i or 0) % 4}" if (i or 0) % 7 else None, len(t or ""), 1, 0.5, 2, 3, 4, "z", 5, "c") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "d.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


TEXTS = {r[0]: r[1] for r in corpus()}


# near-duplicates

def shingles(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("options", [{}, {"effort": 0, "max_hub_rounds": 2}, {"max_hub_rounds": 0}])
def test_near_duplicates_are_the_components(docs, options):
    from wayloom.llm.oddsketch import near_duplicates

    comp, sizes = brute_components(TEXTS)
    got = near_duplicates(docs, **options).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.component_id, r.n_shingles, r.kept) == (comp[r.doc_id], sizes[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_near_duplicates_of_odd_tables(spark, empty):
    from wayloom.llm.oddsketch import near_duplicates, one_of_each

    assert near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, "q r s t u v w")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(rows).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (7, 7, True)]
    assert sorted((r.doc_id or -1) for r in one_of_each(rows).collect()) == [-1, 1, 7]


def test_odd_sketches_estimate_high_similarity():
    import numpy as np

    from wayloom.llm.oddsketch import BITS, odd_sketch, samples, sketch_limit

    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 2000).astype(np.uint64)
    apart = []
    for share in (1.0, 0.95, 0.85, 0.5, 0.0):
        other = base.copy()
        n = int(2000 * (1 - share) / (1 + share))
        other[:n] = r.integers(0, 1 << 63, n).astype(np.uint64)
        apart.append(int(np.bitwise_count(odd_sketch(samples(base)) ^ odd_sketch(samples(other))).sum()))
    assert apart == sorted(apart) and apart[0] == 0
    assert apart[2] <= sketch_limit() < apart[4] and sketch_limit() < BITS / 4


# substring dedup

def brute_removed(texts):
    first, out = {}, {}
    ws = {i: WORD.findall(t or "") for i, t in texts.items()}
    for i in sorted(ws):
        for k in range(len(ws[i]) - 49):
            first.setdefault(tuple(ws[i][k : k + 50]), i)
    for i, w in ws.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("group_size", [20_000, 12, 1])
def test_repeated_windows_go(docs, group_size):
    from wayloom.llm.suffixes import drop_repeats

    want = brute_removed(TEXTS)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in drop_repeats(docs, group_size=group_size).collect()}
    assert got == want and sum(v[1] > 0 for v in want.values()) > 20


def test_repeats_of_odd_tables(spark, empty):
    from wayloom.llm.suffixes import drop_repeats

    assert drop_repeats(empty).count() == 0
    long = " ".join(f"v{i}" for i in range(70))
    rows = spark.createDataFrame([(2, long), (2, long), (5, "pre " + long), (None, long)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in drop_repeats(rows).collect())
    assert got == [(-1, 70, 0), (2, 70, 0), (2, 70, 0), (5, 71, 70)]


# quality rules

def brute_base(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    cover = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_quality_rules(spark, docs, empty):
    from wayloom.llm.fertility import fertility_rules, passing

    lines = [(1, "a b\na b\n\nc d e\na b", "en"), (2, "x\nx \nx", None), (3, "%%% *** a|b <c> &", "xx"), (4, "é ñ ü " * 5, "fr"), (5, None, None)]
    rows = spark.createDataFrame([(*x, 1) for x in lines], "doc_id long, text string, lang string, n_words int")
    texts = TEXTS | {-x[0]: x[1] for x in lines}
    both = docs.select("doc_id", "text", "lang").union(rows.select(-F.col("doc_id"), "text", "lang"))
    for r in fertility_rules(both).collect():
        b = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0]) and not (r.base_failed and r.kept)
    assert fertility_rules(empty).count() == 0 and passing(empty).count() == 0
    assert passing(rows).columns == rows.columns


def test_fertility_of_prose_and_junk(spark):
    from wayloom.llm.fertility import fertility_rules

    prose = ("The road crosses the old bridge near the mill, and every spring the river floods the lower meadow so that walkers "
             "must take the longer path behind the church, where the hedges are high and blackbirds sing until the evening comes. ")
    more = "Nobody in the village remembers who planted the great lime trees along that path or why their branches lean towards the water."
    got = {r.doc_id: r.kept for r in fertility_rules(spark.createDataFrame([(1, prose + more, "en"), (2, "%$#@ " * 40, "en"), (3, "\u4e2d\u6587" * 40, None)], "doc_id long, text string, lang string")).collect()}
    assert got[1] and not got[2]


# mixing

def test_mix_meets_targets_and_reruns_agree(docs, empty):
    from wayloom.llm.mixing import pareto_mix

    got = pareto_mix(docs).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in pareto_mix(docs).collect()}
    sizes = {i: len(WORD.findall(t or "")) for i, t in TEXTS.items()}
    by = collections.defaultdict(list)
    for r in got:
        assert r["size"] == sizes[r.doc_id] and r.taken <= 3 * r["size"] and r.taken % max(r["size"], 1) == 0
        by[r.source].append(r)
    total = sum(sizes.values())
    names = sorted((s for s in by if s is not None)) + [None]
    weight = dict(zip(names, (5, 2, 1, 5, 2, 1)))
    target, capped = {}, set()
    while True:
        left = total - sum(3 * by[s][0].source_size for s in capped)
        target = {s: 3 * by[s][0].source_size if s in capped else weight[s] * left / sum(weight[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * by[s][0].source_size}
        if not over:
            break
        capped |= over
    for s in names:
        assert by[s][0].source_size == sum(r["size"] for r in by[s])
        assert by[s][0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= max(r["size"] for r in by[s])
    assert pareto_mix(empty).count() == 0


def test_inclusion_falls_with_size(spark):
    from wayloom.llm.mixing import pareto_mix

    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.expr("repeat('w ', if(id % 4 < 2, 10, 200))").alias("text"))
    got = pareto_mix(rows).where("source = 'b'").groupBy("size").agg(F.avg(F.col("copies")).alias("c")).collect()
    c = {r["size"]: r.c for r in got}
    assert c[10] > c[200]


# toxicity and quality classifiers

def test_restored_words():
    import numpy as np

    from wayloom.llm.toxicity import N, _kind, restore_word

    count = np.full((N, N, N), 0.05)
    for w in ("idiot", "moron", "stupid", "worthless", "the", "letter", "loss", "is", "all"):
        for a, b, c in zip("  " + w, " " + w + " ", w + "  "):
            count[_kind(a), _kind(b), _kind(c)] += 1
    cost = -np.log(count / count.sum(axis=2, keepdims=True))
    for raw, want in (("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid"), ("w0rthle55", "worthless"), ("letter", "letter"), ("idiot", "idiot")):
        assert restore_word(raw, cost) == want


def labelled(spark, n=600, seed=5):
    r = random.Random(seed)
    bad, rows, labels = ["idiot", "moron", "stupid", "worthless"], [], []
    for i in range(n):
        w = words(r, 60, 300)
        toxic = i % 5 == 2
        if toxic:
            for b in r.sample(bad, 2):
                w[r.randrange(60)] = b if i % 2 else b.replace("i", "1").replace("o", "0")
        rows.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(toxic)))
    r2 = [(n, None, None), (n + 1, "", "x"), (n + 2, "y o u w 1 d i o t i d i o t", None), (None, "i", "n")]
    return spark.createDataFrame(rows + r2, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int"), labels


def test_toxicity_held_out(spark, empty):
    from wayloom.llm.toxicity import toxicity

    docs, labels, truth = labelled(spark)
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    for i, _, toxic in truth:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.5)
    test = [(got[i].predicted, t) for i, _, t in truth if got[i].held_out]
    assert sum(p == t for p, t in test) / len(test) > 0.97 and len(got) == 604
    assert got[600].predicted == 0 and got[601].predicted == 0 and got[602].predicted == 1
    assert toxicity(empty, labels).count() == 0
    assert {r.predicted for r in toxicity(docs, labels.limit(0)).collect()} == {0}


def test_ordinal_grades(spark, empty):
    from wayloom.llm.ordinal import graded, ordinal_quality

    r = random.Random(2)
    rows, rate = [], []
    for i in range(600):
        g = i % 3
        w = [x + ("%%%" if g == 0 and r.random() < 0.8 else "") for x in words(r, 50)] + (["awful"] * 3 if g == 1 else [])
        rows.append((i, " ".join(w)))
        rate.append((i, int(g > 0), int(g == 1)))
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("grade", F.lit("x"))
    ratings = graded(spark.createDataFrame(rate[:400], "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x for x in ordinal_quality(docs, ratings).collect()}
    test = range(400, 600)
    assert sum(round(got[i].expected_grade) == i % 3 for i in test) > 180
    assert all(x.tail_1 >= x.tail_2 and abs(x.tail_1 + x.tail_2 - x.expected_grade) < 1e-9 for x in got.values())
    assert not got[900].kept and not got[901].kept and sum(got[i].kept == (i % 3 > 0) for i in test) > 190
    assert ordinal_quality(empty, ratings).count() == 0
    assert ordinal_quality(docs, ratings.limit(0)).count() == 602


# language model

def test_ngram_scores(docs, empty):
    import numpy as np

    from wayloom.llm.eliasfano import quantise, restore
    from wayloom.llm.ngramlm import PRIOR, ngram_scores

    tokens = {i: WORD.findall(lower(t)) + [None] for i, t in TEXTS.items()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c, c2, c3, starts = collections.Counter(), collections.Counter(), collections.Counter(), 0
    for i, w in tokens.items():
        if not held(i):
            c.update(w)
            starts += 1
            c2.update(zip(["<s>", *w], w))
            c3.update(zip(["<s>", *w], w, w[1:]))
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    ctx = lambda w: starts if w == "<s>" else c[w]
    got = {r.doc_id: r for r in ngram_scores(docs, shard_chars=5000).collect()}
    assert len(got) == len(TEXTS)
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10(p1(x)) for x in w), rel=1e-9)
        held_as = lambda x: float(restore(quantise(np.array([x])))[0])
        p2 = lambda a, b: (min(held_as(c2[a, b]), ctx(a)) + PRIOR * p1(b)) / (ctx(a) + PRIOR)
        p3 = lambda a, b, d: (min(held_as(c3[a, b, d]), held_as(c2[a, b])) + PRIOR * p2(b, d)) / (held_as(c2[a, b]) + PRIOR)
        full = math.log10(p2("<s>", w[0])) + sum(math.log10(p3(*x)) for x in zip(["<s>", *w], w, w[1:]))
        assert r.score == pytest.approx(full, rel=1e-9)
    assert ngram_scores(empty).count() == 0


def test_ngram_rows_that_repeat(spark, tmp_path):
    from wayloom.llm.ngramlm import ngram_scores

    rows = [(3, "a b c"), (3, "a b c"), (None, "a b"), (4, None)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = ngram_scores(spark.read.parquet(path)).collect()
    assert len(got) == 4 and len({r.train_tokens for r in got}) == 1


# decontamination

def test_leaks_are_found_and_clean_texts_left(spark, empty):
    from wayloom.llm.leaks import leaked_passages, without_leaks

    r = random.Random(8)
    items = [(k, " ".join(words(r, 30, 3000))) for k in range(20)]
    rows = []
    for i in range(200):
        w = words(r, 150, 3000)
        if i % 10 == 0:
            q = items[(i // 10) % 20][1].split()
            if i % 20 == 0:  # an edited copy: words changed, dropped and put in
                q[5], q[12] = "edited", "other"
                del q[20]
                q.insert(25, "extra")
            w = w[:70] + [x.upper() + "," for x in q] + w[70:]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (0, rows[0][1])], "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "zq xq")], "item_id long, text string").withColumn("score", F.lit("s"))
    got = leaked_passages(docs, bench).collect()
    assert sorted({(r.doc_id, r.item_id) for r in got}) == [(i, (i // 10) % 20) for i in range(0, 200, 10)]
    blocks = leaked_passages(docs, bench, block_items=7)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == {(r.doc_id, r.item_id) for r in got}
    assert without_leaks(docs, bench).count() == 203 - 21
    assert leaked_passages(empty, bench).count() == 0 and leaked_passages(docs, bench.limit(0)).count() == 0


def test_alignment_scores_like_the_textbook():
    import numpy as np

    from wayloom.llm.leaks import align

    r = random.Random(4)
    for _ in range(200):
        a, b = [r.randrange(5) for _ in range(r.randrange(1, 9))], [r.randrange(5) for _ in range(r.randrange(1, 12))]
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert align(np.array(a), np.array(b))[0] == max(map(max, h))


# pseudonyms

def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark, empty):
    from wayloom.llm.pseudonyms import pseudonymise

    a = "pay 4111 1111 1111 1111 or 4111111111111111, from 10.2.3.255 on 2021-02-28 or 28.02.2021 or 02/28/2021 call +1 (212) 555-0100 ssn 123-45-6789 mail Jo.Doe@x.example.com."
    rows = [(1, a), (2, a), (3, "no 4111111111111112 and 999.1.1.1 and 2021-02-30 and 666-12-3456 v1.2.3"), (4, None), (5, ""), (6, "x" * 200_000 + "9" * 50_000), (7, "plain text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_found", F.lit("x"))
    got = {r.doc_id: r for r in pseudonymise(docs).collect()}
    t = got[1].text
    assert t == got[2].text and got[1].n_found == got[1].n_changed == 9
    for old in ("4111", "10.2.3.255", "2021-02-28", "28.02.2021", "02/28/2021", "(212)", "123-45-6789", "Jo.Doe"):
        assert old not in t
    m = re.match(r"pay (\d{4} \d{4} \d{4} \d{4}) or (\d{16}), from (\d+)\.(\d+)\.(\d+)\.(\d+) on (\d{4})-(\d\d)-(\d\d) or (\d\d)\.(\d\d)\.(\d{4}) or (\d\d)/(\d\d)/(\d{4}) call \+1 \(\d{3}\) \d{3}-\d{4} ssn (\d{3})-(\d\d)-(\d{4}) mail id\d{16}@x\.example\.com\.$", t)
    assert m and m[1].replace(" ", "") == m[2] and luhn(m[2]) and all(int(m[k]) < 256 for k in (3, 4, 5, 6))
    assert (m[7], m[8], m[9]) == (m[12], m[11], m[10]) == (m[15], m[13], m[14])
    assert got[3].text == rows[2][1] and got[3].n_changed == 0
    assert got[4].text is None and got[5].text == "" and got[6].text == rows[5][1] and got[7].n_found == 0
    assert pseudonymise(docs, key="other").where("doc_id = 1").first().text != t
    assert pseudonymise(empty).count() == 0


def test_feistel_is_a_permutation(spark):
    from wayloom.llm.pseudonyms import feistel

    f = feistel("k", "t", F.floor(F.col("id") / 37), F.col("id") % 37, F.lit(27), F.lit(37))
    got = spark.range(27 * 37).select(f.alias("f")).select("f.l", "f.r").distinct()
    assert got.count() == 27 * 37 and got.where("l < 0 or l >= 27 or r < 0 or r >= 37").count() == 0


# urls

def test_urls(spark):
    from wayloom.llm.urls import judge_urls, split_url

    cases = [("http://A.Example.com/en/x?q=1#f", "a.example.com", "/en/x", "example.com/en/", "block"), ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
             ("http://x.com", "x.com", "", None, None), ("http://x.com/", "x.com", "/", "com/", "allow"), ("http://b.net/es/1", "b.net", "/es/1", "net/es/", "block"), ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
             ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://?a/b://c", "", "", None, None), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
             ("x://É.Com/a\nb", "É.com", "/a\nb", "com/", "allow"), ("http://spam-farm.example.org/en/2", "spam-farm.example.org", "/en/2", None, "block"), ("http://news.example.org/en/2", "news.example.org", "/en/2", None, "allow")]
    pages = spark.createDataFrame([(k, c[0], "h") for k, c in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: r for r in judge_urls(pages).collect()}
    for k, (url, host, path, rule, verdict) in enumerate(cases):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule) and split_url(url) == (host, path)
        assert verdict is None or got[k].verdict == verdict
    assert judge_urls(pages.limit(0)).count() == 0
