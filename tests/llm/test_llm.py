"""The corpus operators against brute force, on small fixtures with every odd case, and on the smallest tables."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lakeweave.llm import brown_lm, common, decontaminate, hashing, langid, minhash, pu_quality, queries, sentencepiece_bpe, sharding, simhash, substring_dedup, warc

#: Names that operators use inside; here they are columns of the input too.
CLASH = ["id", "th", "at", "fp", "word", "component", "rest", "bucket", "score", "kind", "n", "row", "tail", "w1", "shard", "copies", "fingerprint", "ids", "kept"]
rng = random.Random(3)


def words(n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


PASSAGE = words(40)
TEXTS = [
    None, "", "   \n\t", "A", "A.", "one two three four", "ONE two\tthree  four", words(60), PASSAGE, f"{words(30)} {PASSAGE} {words(20)}", f"x {PASSAGE}", words(34), words(35), "a b c d e " * 20, words(3000), "é" * 70_000 + " \U0001f600 " + "ñ " * 3000,
    "line one\nline two\n" * 30, "日本語 テキスト ▁ \x00 ﻿", "1234 5678 !!!", words(200),
]
TEXTS += [TEXTS[7], TEXTS[7], TEXTS[-1].replace("w1 ", "w2 ", 1)]


def documents(spark, texts=TEXTS, clash=True):
    langs = ["en", None, "fr"]
    rows = [(i, t, langs[i % 3], None if i % 4 == 0 else f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "src", 3), (5, texts[5], "en", "src", 3), (None, texts[7] if len(texts) > 7 else "x", None, None, None), (None, None, "en", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}) if clash else df


def listed(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark).limit(0)


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def multiset(rows):
    return collections.Counter(rows)


# ---------------------------------------------------------------- kernels


def test_rolling_hashes():
    x = np.arange(200, dtype=np.uint64) * np.uint64(7_777_777_777)
    for n in (1, 2, 3, 7, 16, 35):
        want = [sum(int(x[i + j]) * pow(hashing._STEP, n - 1 - j, 1 << 64) for j in range(n)) % (1 << 64) for i in range(len(x) - n + 1)]
        assert (hashing.grams(x, n) == hashing.mix(np.array(want, np.uint64))).all()
    y = np.random.default_rng(1).integers(0, 9, 100, dtype=np.uint64)
    for w in (1, 2, 5, 20):
        least, place = hashing.sliding_min(y, w)
        for i in range(100 - w + 1):
            assert least[i] == y[i : i + w].min() and place[i] == i + int(y[i : i + w].argmin())


def test_word_hashes(monkeypatch):
    texts = [(t or "").encode() for t in TEXTS]
    h, o = hashing.word_hashes(texts)
    flat = [w for t in texts for w in t.split()]
    assert np.diff(o).tolist() == [len(t.split()) for t in texts]
    names = {}
    assert all(names.setdefault(int(x), w) == w for x, w in zip(h, flat, strict=True)) and len(names) == len(set(flat))
    monkeypatch.setattr(hashing, "CHUNK", 100)
    monkeypatch.setattr(hashing, "_LONG", 1000)
    assert (hashing.word_hashes(texts)[0] == h).all()


def test_components(spark):
    pairs = [(a, a + 1) for a in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 9)]
    got = common.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    want = {i: 0 for i in range(1, 31)} | {101: 100} | {200 + i: 200 for i in range(1, 9)}
    assert {r.node: r.component for r in got.collect()} == want
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 language ID


def test_added_up(spark):
    """Sums of all rows, and no group of more than 32 of them, from far more tasks than that."""
    import pyarrow as pa

    def add(t):
        assert len(t) <= 32
        return pa.table({"at": t["at"][:1], "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "part": t["part"][:1]})

    tasks = spark.range(5000).select(F.expr("cast(id % 2 as int) as at"), F.col("id").alias("n"), F.expr("cast(shiftright(id, 5) as int) as part"))
    got = common.added_up(tasks, ("at",), add, "at int, n long, part int")
    assert {r.at: r.n for r in got.collect()} == {k: sum(range(k, 5000, 2)) for k in (0, 1)}


def test_langid(spark, odd, nothing, small):
    model = langid.fit(small.where(F.pmod("doc_id", F.lit(4)) != 2))
    got = langid.predict(small, model).join(small, "doc_id").where(F.pmod("doc_id", F.lit(4)) == 2)
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right / n > 0.95
    out = langid.predict(odd, model)
    assert out.columns == ["doc_id", "lang_pred", "score"] and out.count() == odd.count()
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert [by[i].lang_pred for i in (0, 1, 2, 18)] == ["und"] * 4 and by[0].score == 0
    assert all(0 <= r.score <= 1 for r in by.values())
    assert langid.predict(nothing, model).count() == 0
    blank = langid.fit(nothing)
    assert {r.lang_pred for r in langid.predict(odd, blank).collect()} == {"und"}
    kept = langid.keep_known(odd, model, 0.0)
    want = brute_langid([(r.text, r.lang) for r in small.where(F.pmod("doc_id", F.lit(4)) != 2).collect()], [t for _, t in listed(odd)])
    assert kept.columns == odd.columns and kept.count() == sum(seen for _, _, seen in want)


def test_langid_rejects_unlearned_scripts(spark, small):
    """Grams that no training text has are less likely than evenly drawn ones, whatever the posterior says."""
    texts = ["Ελληνικό κείμενο που δεν έμαθε κανείς", "текст на языке которого нет", "日本語のテキスト", *[r.text for r in small.limit(20).collect()]]
    model = langid.fit(small)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert sorted(r.doc_id for r in langid.keep_known(docs, model, 0.3).collect()) == list(range(3, len(texts)))


def brute_langid(train, texts):
    """Naive Bayes from counts of each text's own grams, added up one by one; whether evenly drawn grams are unlikelier."""
    grams = lambda t: [int(b) for bucket, _ in langid.gram_buckets([t])[0] for b in bucket]
    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for t, lang in train:
        counts[lang].update(grams(t))
        docs[lang] += 1
    out, size = [], 1 << langid.BUCKET_BITS
    for t in texts:
        if not any(c.isalpha() for c in t or "") or not docs:
            out.append(("und", 0.0, False))
            continue
        like = {}
        for lang in docs:
            total = sum(counts[lang].values()) + 0.5 * size
            like[lang] = sum(math.log((counts[lang][b] + 0.5) / total) for b in grams(t)) / 3 + math.log(docs[lang] / sum(docs.values()))
        best = min(like, key=lambda x: (-like[x], x))
        even = -len(grams(t)) * math.log(size) / 3 + math.log(min(docs.values()) / sum(docs.values()))
        out.append((best, 1 / sum(math.exp(v - like[best]) for v in like.values()), like[best] >= even))
    return out


@pytest.mark.parametrize("block", [256, 3, 1])
def test_langid_by_brute_force(odd, small, monkeypatch, block):
    """All languages in one block, or in several."""
    monkeypatch.setattr(langid, "MOST_LANGUAGES", block)
    rows = small.where("doc_id < 80").select("doc_id", "text", "lang").union(odd.select("doc_id", "text", F.concat("lang", F.lit("2"))))
    train = [(r.text, r.lang) for r in rows.collect() if r.text is not None and r.lang is not None]
    got = [(r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.predict(odd, langid.fit(rows)).collect()]
    want = brute_langid(train, [t for _, t in listed(odd)])
    assert len({x for _, x in train}) > 3 and multiset(got) == multiset((i, x, round(v, 6)) for (i, _), (x, v, _) in zip(listed(odd), want, strict=True))
    kept = langid.keep_known(odd, langid.fit(rows), 0.3)
    assert multiset((r.doc_id, r.lang) for r in kept.collect()) == multiset((i, x) for (i, _), (x, v, seen) in zip(listed(odd), want, strict=True) if v >= 0.3 and seen)


def test_langid_counts_match_brute_force():
    parts, some = langid.gram_buckets(["aB c", "abc", "Ab"])
    assert some.all() and [np.bincount(t, minlength=3).tolist() for _, t in parts] == [[3, 3, 2], [5, 4, 3], [5, 4, 3]]
    one, two = langid.gram_buckets(["abc"])[0], langid.gram_buckets(["zz", "abc", "q"])[0]
    for (b1, _), (b2, t2) in zip(one, two, strict=True):
        assert sorted(b1) == sorted(b2[t2 == 1])  # a text's grams don't depend on its neighbours


# ---------------------------------------------------------------- 2 SimHash


def brute_simhash(text, n=4):
    import xxhash

    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, budget=4):
    values = sorted({f for _, f in pairs})
    root = {f: f for f in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                root[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f, least.get(find(f))) for i, f in pairs]


@pytest.mark.parametrize("which", ["odd", "small"])
def test_simhash(spark, which, request):
    df = request.getfixturevalue(which)
    want = brute_components([(i, brute_simhash(t)) for i, t in listed(df)])
    got = [(r.doc_id, r.fingerprint % (1 << 64), r.component) for r in simhash.near_duplicates(df).collect()]
    assert multiset(got) == multiset(want)


def test_simhash_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("budget", [0, 2, 4])
def test_trie_join(spark, budget):
    r = np.random.default_rng(budget)
    centre = r.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    v = [centre]
    for _ in range(20):
        x = centre.copy()
        for _ in range(r.integers(1, 7)):
            x ^= np.uint64(1) << r.integers(0, 64, len(x)).astype(np.uint64)
        v.append(x)
    v = np.unique(np.concatenate(v))
    want = brute_components([(int(x.view(np.int64)), int(x)) for x in v], budget)
    for front in (None, 2, 3):
        links = simhash.links(spark.createDataFrame([(int(x.view(np.int64)),) for x in v], "fingerprint long"), budget, front=front).collect()
        assert all(((e.a ^ e.b) % (1 << 64)).bit_count() <= budget for e in links)
        comp = {r.node: r.component for r in common.connected_components(spark.createDataFrame([(e.a, e.b) for e in links], "a long, b long")).collect()}
        assert all(comp.get(i, i) == c for i, _, c in want)


@pytest.mark.parametrize("budget, front", [(4, 1), (4, 2), (4, 3), (2, 1), (0, 1)])
def test_turnings(budget, front):
    """Turned back a value is itself; values within the budget share the front of at least one turning."""
    r = np.random.default_rng(5)
    v = r.integers(0, 1 << 63, 500, dtype=np.uint64) << np.uint64(1)
    w = v.copy()
    for _ in range(budget):
        w ^= np.uint64(1) << r.integers(0, 64, len(w)).astype(np.uint64)
    ways, bits = simhash.turnings(budget, front)
    assert all((simhash.turned_back(simhash.turned(v, x), x) == v).all() for x in ways)
    same = np.array([(simhash.turned(v, x) ^ simhash.turned(w, x)) >> np.uint64(64 - n) == 0 if n < 64 else v == w for x, n in zip(ways, bits, strict=True)])
    assert same.any(axis=0).all()
    assert [simhash.blocks_in_front(n, 4) for n in (1000, 10**8, 10**9, 10**11)] == [1, 1, 2, 3]


def test_similar_groups(spark, odd, nothing):
    base = [[f"d{d}w{k}" for k in range(120)] for d in range(12)]
    texts = [" ".join(x) for x in base]
    for x in base:  # one word changed: similarity 0.92; every eighth: far below 0.8
        texts += [" ".join([*x[:60], "other", *x[61:]]), " ".join("other" if k % 8 == 0 else w for k, w in enumerate(x))]
    got = {r.doc_id: r.component for r in simhash.similar_groups(documents(spark, texts)).collect()}
    assert got == {12 + 2 * d: d for d in range(12)}
    assert simhash.similar_groups(nothing).count() == 0
    assert {r.doc_id for r in simhash.similar_groups(odd).collect()} <= {r.doc_id for r in odd.collect()}


def test_similar_groups_find_cut_and_extended_texts(spark):
    texts, want = [], {}
    for d in range(150):
        n = (12, 40, 120, 400)[d % 4]
        base = [f"d{d}w{k}" for k in range(n)]
        m = n - 4  # shingles; five-word similarity of 0.8 or a little more
        cut, more = m - math.ceil(0.8 * m), math.floor(m / 0.8) - m
        texts += [" ".join(base), " ".join(base[: n - cut]), " ".join([*base, *(f"d{d}more{k}" for k in range(more))])]
        assert min(jaccard(texts[-3], texts[-2]), jaccard(texts[-3], texts[-1])) >= 0.8
        want |= {3 * d + 1: 3 * d, 3 * d + 2: 3 * d}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component for r in simhash.similar_groups(df).collect()} == want


def test_similar_groups_are_exact_about_0_8(spark):
    texts = {}
    for d in range(60):
        base, m = [f"d{d}w{k}" for k in range(204)], 200
        texts[2 * d], texts[2 * d + 1] = " ".join(base), " ".join(base[: 4 + (160 if d % 2 else 159)])  # 0.8, 0.795
    got = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {2 * d + 1: 2 * d for d in range(60) if d % 2}


def test_small_sketches_rule_out_no_pair():
    """Of pairs of a similarity of 0.8 none is ruled out; of unlike texts nearly all are. Rows of one group don't count."""
    texts = []
    for d in range(300):
        base = [f"d{d}w{k}" for k in range(104 + d)]
        m = len(base) - 4
        texts += [" ".join(base), " ".join(base[: 4 + math.ceil(0.8 * m)])]
    values, _ = minhash.bin_values([t.encode() for t in texts], simhash.SKETCH, 5)
    small, n = simhash.small_sketch(values), len(texts)
    one = lambda key, group, **x: simhash.hopeful(key, group, small, x.get("short", np.zeros(n, bool)), 0.8)
    assert one(np.arange(n) // 2, np.arange(n)).all()
    assert not one(np.arange(n) // 2, np.arange(n) // 2).any()
    assert one(np.arange(1, n + 1) // 2, np.arange(n)).mean() < 0.02
    assert one(np.zeros(n, int), np.arange(n)).all()
    assert one(np.arange(1, n + 1) // 2, np.arange(n), short=np.ones(n, bool))[1:-1].all()


def test_similar_groups_go_on_past_a_failed_link():
    # three texts of one key: the first is like neither of the others, which are alike
    r = np.random.default_rng(1)
    one, two = r.integers(0, 256, (2, simhash.SKETCH // 2), np.uint8)
    a, b, doubt = simhash.compare(np.zeros(3, int), np.arange(3), np.arange(3), simhash.by_sketch(np.stack((one, two, two)), 0.8))
    assert [set(x) for x in zip(a.tolist(), b.tolist(), strict=True)] == [{1, 2}] and not len(doubt)


def test_near_dedup_chains_through_removed_documents(spark, sf_dir):
    words = [f"w{k}" for k in range(400)]
    texts = {1: words, 2: words[:340], 3: words[:290]}  # 1 ~ 2 and 2 ~ 3 are alike, 1 and 3 are not
    texts = {i: " ".join(t) for i, t in texts.items()}
    assert jaccard(texts[1], texts[2]) >= 0.8 and jaccard(texts[2], texts[3]) >= 0.8 > jaccard(texts[1], texts[3])
    rows = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, sf_dir).collect()] == [1]
    # 1 and 2 are linked by fingerprint; 3 is like 2 alone, which goes
    known = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "doc_id long, component long")
    other = rows.where("doc_id > 1").union(rows.where("doc_id = 1").withColumn("text", F.lit(" ".join(f"v{k}" for k in range(400)))))
    assert {r.doc_id: r.component for r in simhash.similar_groups(other, known=known).collect()} == {2: 1, 3: 1}


def test_near_dedup_by_row(spark, sf_dir):
    """Distinct texts of one id both stay; of equal rows one stays; ids that are null go after others."""
    long = [" ".join(f"t{d}w{k}" for k in range(60)) for d in range(3)]
    rows = [(1, long[0]), (2, long[0]), (2, long[1]), (9, long[2]), (9, long[2]), (None, long[1]), (None, None), (3, None), (3, "")]
    df = spark.createDataFrame([(i, t, "en", None, len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    got = corpus_pipeline.near_dedup(spark, df, sf_dir)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text or "") for r in got.collect()]
    assert multiset(kept) == multiset([(1, long[0]), (2, long[1]), (9, long[2]), (3, "")])
    assert corpus_pipeline.near_dedup(spark, df.limit(0), sf_dir).count() == 0


def test_trie_links_are_of_least_distance():
    centre = 0x0123456789ABCDEF
    v = np.sort(np.array([centre] + [centre ^ (1 << b) ^ (1 << c) for b, c in ((0, 1), (2, 3), (4, 5), (6, 7), (8, 9))], np.uint64))
    a, b = simhash.trie_join(v, np.zeros(len(v), int), 4)
    assert len(a) == 5 and all(np.bitwise_count(v[a] ^ v[b]) == 2)


# ---------------------------------------------------------------- 3 class-based LM


def brute_base(df, train):
    tok = [(i, (t or "").encode().lower().split() + [None]) for i, t in listed(df)]
    c = collections.Counter(w for _, t in [(i, (t or "").encode().lower().split() + [None]) for i, t in listed(train)] for w in t)
    n, v = sum(c.values()), len(c)
    return [(i, len(t), sum(w in c for w in t), n, round(sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in t), 6)) for i, t in tok]


@pytest.mark.parametrize("head", [8, 200_000])
def test_lm_base(odd, head):
    train = odd.where("doc_id % 3 <> 1 or doc_id is null")
    model = brown_lm.fit(train, core=5, classes=3, head=head)
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in brown_lm.score(odd, model).collect()]
    assert multiset(got) == multiset(brute_base(odd, train))


def test_lm_head_changes_no_score(odd):
    a, b = ({(r.doc_id, r.n_tokens, round(r.score, 6)) for r in brown_lm.score(odd, brown_lm.fit(odd, core=5, classes=3, head=h)).collect()} for h in (30, 200_000))
    assert a == b


def brute_lm(model, train, texts):
    """Scores by the formulas alone, word by word, from counts of its own; only the words' classes are the model's."""
    split = lambda t: (t or "").encode().lower().split()
    core, k = {w for w, i in model.head.items() if i < model.core}, model.classes

    def cls(w):
        if w in core:
            return int(model.head_class[model.head[w]])
        got = int(model.buckets[brown_lm.bucket(w, model.bits)])
        return int(model.shapes[brown_lm.shape(w)]) if got == brown_lm.BY_SHAPE else got

    steps, count = np.zeros((k + 1, k + 1)), collections.Counter()
    for t in train:
        seq = [k, *map(cls, split(t)), k]
        count.update(split(t))
        for x, y in zip(seq, seq[1:], strict=False):
            steps[x, y] += 1
    total = steps.sum(axis=0)
    share = (total + 0.5) / (total.sum() + 0.5 * (k + 1))
    move = (steps + 5 * share) / (steps.sum(axis=1, keepdims=True) + 5)
    tokens, types = collections.Counter(), collections.Counter()
    for w, n in count.items():
        tokens[cls(w)] += n
        types[cls(w)] += 1
    ones, twos = (sum(n == x for n in count.values()) for x in (1, 2))
    d = min(0.95, max(0.1, ones / (ones + 2 * twos)))
    out = []
    for t in texts:
        words = split(t)
        seq = [k, *map(cls, words), k]
        p = sum(math.log10(move[x, y]) for x, y in zip(seq, seq[1:], strict=False))
        out.append(p + sum(math.log10((count[w] - d if count[w] else d * max(types[cls(w)], 1)) / max(tokens[cls(w)], 1)) for w in words))
    return out, move


@pytest.mark.parametrize("core, classes, head", [(5, 3, 12), (40, 6, 200_000), (300, 20, 350)])
def test_lm_score(odd, core, classes, head):
    train = odd.where("doc_id % 3 <> 1 or doc_id is null")
    model = brown_lm.fit(train, core=core, classes=classes, head=head)
    want, move = brute_lm(model, [t for _, t in listed(train)], [t for _, t in listed(odd)])
    assert np.allclose(10**model.transition, move)
    got = multiset((r.doc_id, r.n_tokens, round(r.score, 5)) for r in brown_lm.score(odd, model).collect())
    assert got == multiset((i, len((t or "").encode().split()) + 1, round(s, 5)) for (i, t), s in zip(listed(odd), want, strict=True))


def test_lm_classes_by_context(odd):
    """Each bucket has the class of the greatest gain over all its words' contexts next to the core."""
    m = brown_lm.fit(odd, core=30, classes=5)
    core = {w: int(m.head_class[i]) for w, i in m.head.items() if i < m.core}
    near, table = collections.defaultdict(lambda: np.zeros((2, m.classes + 1))), np.zeros((m.classes + 1, m.classes + 1))
    for _, t in listed(odd):
        seq = [None, *(t or "").encode().lower().split(), None]
        for x, y in zip(seq, seq[1:], strict=False):
            a, b = (m.classes if w is None else core.get(w) for w in (x, y))
            if a is not None and b is not None:
                table[a, b] += 1
            elif b is not None:
                near[brown_lm.bucket(x, m.bits)][0, b] += 1
            elif a is not None:
                near[brown_lm.bucket(y, m.bits)][1, a] += 1
    for k, (after, before) in near.items():
        gain = [sum(after[c] * math.log((table[x, c] + 0.5) / (table[x] + 0.5).sum()) + before[c] * math.log((table[c, x] + 0.5) / (table[:, x] + 0.5).sum()) for c in range(m.classes + 1)) for x in range(m.classes)]
        assert gain[m.buckets[k]] == pytest.approx(max(gain))
    assert near and {k for k in range(1 << m.bits) if m.buckets[k] != brown_lm.BY_SHAPE} == set(near)


def test_lm_is_a_distribution(odd):
    """Transitions sum to one; emissions of a class to one with the unseen word's share."""
    m = brown_lm.fit(odd, core=6, classes=3)
    assert np.allclose((10**m.transition).sum(axis=1), 1)
    p = np.bincount(m.head_class, 10 ** m.emission(m.head_count, m.head_class), m.classes)
    some = m.class_tokens > 0
    assert np.allclose((p + m.discount * m.class_types / np.maximum(m.class_tokens, 1))[some], 1)


def test_lm_rows_without_ids(spark):
    """Texts of one 32-bit hash, without ids, and ids that repeat: each row has its own result."""
    rows = spark.createDataFrame([(None, "a b c d"), (None, "a b"), (7, "a b c d e f"), (7, "a"), (7, "a"), (None, None)], "doc_id long, text string")
    got = brown_lm.score(rows, brown_lm.fit(rows, core=3, classes=2)).collect()
    assert multiset((r.doc_id, r.n_tokens) for r in got) == multiset([(None, 5), (None, 3), (7, 7), (7, 2), (7, 2), (None, 1)])


def test_lm_head_of_ties(spark):
    rows = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(500)))], "doc_id long, text string")
    m = brown_lm.fit(rows, core=100, classes=4, head=200)
    assert 100 < len(m.head) <= 200 and m.core == 100


def test_lm_beats_unigrams_on_held_out(small):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    s = brown_lm.score(small.where(held), brown_lm.fit(small.where(~held))).agg(F.sum("score"), F.sum("base_score"), F.max("score")).first()
    assert s[0] > s[1] and s[2] < 0


def test_exchange_raises_likelihood():
    r = np.random.default_rng(2)
    kind = np.array([0, 1] * 10)
    p = r.integers(0, 3, (21, 21))
    p[:20, :20] += 40 * (kind[:, None] != kind[None, :])
    of = brown_lm.exchange(p, 20, 2)[:20]
    assert len(set(of[kind == 0])) == 1 and len(set(of[kind == 1])) == 1 and of[0] != of[1]


def test_lm_empty(odd, nothing):
    assert brown_lm.score(nothing, brown_lm.fit(odd)).count() == 0
    rows = brown_lm.score(odd, brown_lm.fit(nothing)).collect()
    assert len(rows) == odd.count() and all(r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in rows)


# ---------------------------------------------------------------- 4 SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_file(queries.MODEL))


def test_sentencepiece_exact(library):
    mine = sentencepiece_bpe.load(common.tokenizer_file(queries.MODEL))
    r = random.Random(5)
    some = [p for p in mine.pieces if len(p) > 1]
    texts = [t or "" for t in TEXTS] + ["<s> <0x41> </s> <unk>", " " * 40, "x" + " " * 17 + "y", "aaaaaaa" * 300, "▁ ▁▁x"]
    texts += ["".join(r.choice("abcdeéñ  ▁\t\n日😀\0!%<>0x") for _ in range(r.randrange(40))) for _ in range(800)]
    texts += ["".join(r.choice(some) for _ in range(r.randrange(12))) for _ in range(4000)]
    for t in texts:
        ids = library.encode(t)
        assert mine.encode(t) == ids and mine.decode(ids) == library.decode(ids), t
    broken = [mine.bytes[0xE6], mine.bytes[0x97], mine.ids["▁the"], mine.bytes[0xFF], 1, 2]
    assert mine.decode(broken) == library.decode(broken)


def test_sentencepiece_table(odd, nothing, library):
    path = common.tokenizer_file(queries.MODEL)
    got = [(r.doc_id, tuple(r.ids), r.decoded) for r in sentencepiece_bpe.encode(odd, path).collect()]
    assert multiset(got) == multiset((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in listed(odd))
    assert sentencepiece_bpe.encode(nothing, path).count() == 0


# ---------------------------------------------------------------- 5 MinHash


def jaccard(a, b, n=5):
    def s(t):
        w = t.encode().split()
        return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    a, b = s(a), s(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_minhash_edited(spark, small, odd, nothing):
    rows = sorted((r.doc_id, r.text) for r in small.collect())
    got = {r.doc_id: r for r in minhash.edited_texts(small).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        r, half = got[i], len(t) // 2
        assert r.n_chars == len(t) and r.edited == t[: len(t) - half] + nxt[:half]
        assert abs(r.near_edited - jaccard(t, r.edited)) < 0.12 and abs(r.near_next - jaccard(t, nxt)) < 0.12
    out = minhash.edited_texts(odd)
    assert out.count() == odd.count()
    prints = {(r.text or "", r.fingerprint) for r in minhash.fingerprints(odd).join(odd.select("doc_id", "text"), "doc_id").collect()}
    assert len(prints) == len({t for t, _ in prints}) and ("", "") in prints  # equal texts, equal fingerprints
    assert minhash.edited_texts(nothing).count() == 0
    one = minhash.edited_texts(small.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_minhash_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "c d e f"), (1, "x y z w"), (None, "a b"), (3, None)], "doc_id long, text string")
    got = minhash.edited_texts(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "3", "None", "None"]
    assert next(r.edited for r in got if r.doc_id == 1) in ("x y c d", "x y ")


def test_minhash_unbiased():
    r = np.random.default_rng(4)
    err = []
    for _ in range(60):
        base = [f"a{x}" for x in r.integers(0, 10**6, 300)]
        other = base[:150] + [f"b{x}" for x in r.integers(0, 10**6, 150)]
        texts = [" ".join(base), " ".join(other)]
        low, some = minhash.signatures([t.encode() for t in texts])
        err.append(minhash.likeness(low[:1], low[1:], some[:1], some[1:])[0] - jaccard(*texts))
    assert abs(np.mean(err)) < 0.01 and np.std(err) < 0.05


# ---------------------------------------------------------------- 6 sharding


@pytest.mark.parametrize("which", ["odd", "small"])
def test_sharding(which, request):
    df = request.getfixturevalue(which)
    got = sharding.shard_documents(df).collect()
    assert multiset((r.doc_id, r["size"], r.text_crc32) for r in got) == multiset((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in listed(df))
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})


def test_sharding_weights(spark, nothing):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    key = F.col("doc_id")
    flat = sharding.placed(df, key, sharding.tree(24)).groupBy("shard").count().collect()
    assert len(flat) == 24 and max(abs(r["count"] - 20_000 / 24) for r in flat) < 150
    heavy = sharding.placed(sharding.placed(df, key, sharding.tree(24)), key, sharding.tree(24, {0: 3.0}), "new_")
    moved = heavy.where("shard <> new_shard")
    assert moved.where("new_region <> 0").count() == 0  # rows move within or into the region whose weight has changed
    assert abs(heavy.where("new_shard = 0").count() / 20_000 - 3 / 26) < 0.01
    assert sharding.placed(df, key, sharding.tree(24, {5: 0.0})).where("shard = 5").count() == 0
    assert sharding.shard_documents(nothing).count() == 0


def test_sharding_is_native(small):
    plan = sharding.shard_documents(small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_hash_tree_by_brute_force(spark):
    """Every row's descent by draws of its own, for 24 shards and for one more, with weights as well."""
    import xxhash

    def hashed(key, path):
        first = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        return xxhash.xxh64_intdigest(path.encode(), first)

    def least(key, nodes):
        live = [n for n in nodes if n.weight > 0]
        return min(live, key=lambda n: (-math.log(((hashed(key, n.path) >> 11) + 0.5) / 2**53) / n.weight, n.number))

    def shard(key, nodes):
        while True:
            node = least(key, nodes)
            if not node.children:
                return node.number
            nodes = node.children

    keys = [*range(0, 3000, 7), -1, 2**62]
    df = spark.createDataFrame([(k, f"t{k % 11}") for k in keys], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(df).collect()}
    assert got == {k: (shard(k, sharding.tree(24)), shard(k, sharding.tree(25))) for k in keys}
    heavy = sharding.tree(24, {3: 5.0, 7: 0.0})
    assert {r.doc_id: r.shard for r in sharding.placed(df, F.col("doc_id"), heavy).collect()} == {k: shard(k, heavy) for k in keys}


# ---------------------------------------------------------------- 7 quality


def test_pu_quality(spark, sf_dir, odd, nothing):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = pu_quality.fit(docs.where(~held), labels.where(~held & (F.col("quality") == 1)).select("doc_id"))
    rows = pu_quality.score(docs.where(held), model).join(labels, "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert np.mean([(r.score >= 0.3) == r.quality for r in rows]) > 0.85
    out = pu_quality.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert pu_quality.score(nothing, model).count() == 0
    blank = pu_quality.fit(odd, odd.limit(0).select("doc_id"))
    assert {r.score for r in pu_quality.score(odd, blank).collect()} == {0.5}


def test_quality_sums_by_brute_force(odd):
    """Moments and histograms over all texts, and the scores that follow from them, against plain matrices."""
    texts, trusty = [(t or "").encode() for _, t in listed(odd)], (4, 5, 7, 8, 9, 10, 11, 12, 14, 15)
    x = np.concatenate((pu_quality.features(texts).astype(float), np.ones((len(texts), 1))), axis=1)
    yes, use = np.array([i in trusty for i, _ in listed(odd)]), np.array([zlib.crc32(t) & 1 for t in texts])
    rows = odd.select("text", F.coalesce(F.col("doc_id").isin(*trusty), F.lit(False)).alias("trusted"))
    got, first = pu_quality.moments(rows), use == 0
    assert (yes & first).any() and (yes & ~first).any()
    assert np.allclose(got[0], x[first].T @ x[first], rtol=1e-4, atol=1e-4) and np.allclose(got[1], x[yes & first].T @ x[yes & first], rtol=1e-4, atol=1e-4)
    model = pu_quality.fit(odd, odd.where(F.col("doc_id").isin(*trusty)).select("doc_id"))
    every, some = pu_quality.histograms(rows, model)
    at = np.clip((model.raw(x[:, :-1]) + pu_quality.REACH) / (2 * pu_quality.REACH) * pu_quality.BINS, 0, pu_quality.BINS - 1).astype(int)
    assert some.sum() == (yes & ~first).sum() and np.abs(np.cumsum(every) - np.cumsum(np.bincount(at[~first], minlength=pu_quality.BINS))).max() <= 1
    assert (np.diff(model.curve) >= 0).all()
    want = model.score(x[:, :-1])
    assert multiset((r.doc_id, round(r.score, 3)) for r in pu_quality.score(odd, model).collect()) == multiset((i, round(v, 3)) for (i, _), v in zip(listed(odd), want, strict=True))


def test_prior_estimate():
    r = np.random.default_rng(1)
    pos = r.normal(1.5, 1, 15_000)
    unl = np.concatenate([r.normal(1.5, 1, 21_000), r.normal(-1.5, 1, 9000)])
    bins = np.linspace(-8, 8, 513)
    assert abs(pu_quality.prior_of(np.histogram(unl, bins)[0], np.histogram(pos, bins)[0]) - 0.7) < 0.08


def test_risk_is_held_at_zero():
    """The risk of negatives doesn't fall below zero, and no other weights near by have less risk."""
    r = np.random.default_rng(4)
    pos, unl = r.normal(0.7, 1, (12, 6)), np.concatenate([r.normal(0.7, 1, (20, 6)), r.normal(-0.7, 1, (10, 6))])
    pos, unl = (np.concatenate((x, np.ones((len(x), 1))), axis=1) for x in (pos, unl))
    p, u, prior, ridge = pos.T @ pos / len(pos), unl.T @ unl / len(unl), 0.9, 1e-3

    def risks(w):
        return prior * ((1 - pos @ w) ** 2).mean() / 4, ((1 + unl @ w) ** 2).mean() / 4 - prior * ((1 + pos @ w) ** 2).mean() / 4

    def risk(w):
        yes, no = risks(w)
        return yes + max(0, no) + ridge * (w[:-1] @ w[:-1]) / 4

    free = np.linalg.solve(u + np.diag([ridge] * 6 + [0]), 2 * prior * p[-1] - u[-1])
    assert risks(free)[1] < 0
    w = pu_quality.least_risk(u, p, prior, ridge)
    assert risks(w)[1] > -1e-6
    assert all(risk(w) <= risk(w + r.normal(0, s, 7)) + 1e-6 for s in (0.003, 0.03, 0.3) for _ in range(200))


def test_quality_features_do_not_depend_on_neighbours():
    texts = [(t or "").encode() for t in TEXTS]
    alone = np.concatenate([pu_quality.features([t]) for t in texts])
    assert alone.shape[1] == pu_quality.WIDTH and np.allclose(alone, pu_quality.features(texts), atol=1e-5) and np.isfinite(alone).all()


# ---------------------------------------------------------------- 8 substring dedup


def brute_repeats(docs, window=35):
    c = collections.Counter()
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for _, w in split:
        c.update(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if c[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("window", [3, 35])
@pytest.mark.parametrize("batches", [1, 3])
def test_substring(odd, window, batches):
    got = [tuple(r) for r in substring_dedup.remove_repeats(odd, window, batches).collect()]
    assert multiset(got) == multiset(brute_repeats(listed(odd), window))


def test_substring_periods(spark):
    """Repeats that overlap themselves, with periods around the gram's and the window's length."""
    texts = [" ".join(f"p{k % p}" for k in range(n)) for p, n in ((1, 35), (1, 36), (5, 39), (5, 40), (16, 50), (16, 51), (34, 68), (34, 69), (35, 69), (35, 70), (40, 74), (40, 75), (17, 200))]
    for i, t in enumerate(texts):
        df = spark.createDataFrame([(i, t.replace("p", f"q{i}_"))], "doc_id long, text string")
        assert [tuple(r) for r in substring_dedup.remove_repeats(df).collect()] == brute_repeats(listed(df))


def test_substring_tables(spark, small, nothing):
    got = [tuple(r) for r in substring_dedup.remove_repeats(small).collect()]
    assert multiset(got) == multiset(brute_repeats(listed(small)))
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_substring_sound(spark):
    """Words that a polynomial hash modulo 2^64 can't tell apart; equal 32-bit hashes of texts without an id; very many copies."""
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{k}" for k in range(34))
    texts = [f"{thue} {tail}", f"{thue.translate(str.maketrans('ab', 'ba'))} {tail}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(df).collect()] == [0, 0]
    long = " ".join(f"z{k % 45}" for k in range(90))
    many = spark.range(500_000).select(F.concat("id", F.lit(" "), F.when(F.col("id") % 2 == 0, long).otherwise(tail)).alias("text"))
    same = many.groupBy(F.hash("text")).agg(F.min_by("text", F.length("text")).alias("a"), F.max_by("text", F.length("text")).alias("b")).where("length(b) > length(a) + 50").first()
    rows = spark.createDataFrame([(None, same.a), (None, same.b), (None, long), (None, tail), (None, None)], "doc_id long, text string")
    assert multiset(tuple(r) for r in substring_dedup.remove_repeats(rows).collect()) == multiset(brute_repeats(listed(rows)))


def test_substring_copies(spark):
    text, other = words(60), words(50)
    df = spark.range(0, 100_000, 1, 16).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 99, F.concat(F.lit(other + " only"), "id")).otherwise(text).alias("text"))
    got = substring_dedup.remove_repeats(df).groupBy("n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(60, 60, 99_000), (51, 50, 1000)}
    spans = substring_dedup.FingerprintIndex(spark)
    spans.add(df)
    flags = substring_dedup.repeated_windows(df, 35, spark.sparkContext.broadcast(spans.filter()))
    assert flags.agg(F.max(F.size("spans"))).first()[0] < 500


def test_index_runs_and_compaction(spark, small):
    index = substring_dedup.FingerprintIndex(spark)
    for k in range(3):
        index.add(small.where(F.pmod("doc_id", F.lit(3)) == k))
    assert [level for level, _ in index.runs] == [1, 0]
    whole = substring_dedup.FingerprintIndex(spark)
    whole.add(small)
    fps = lambda x: {r.fp for r in x.repeated().collect()}
    assert fps(index) == fps(whole)
    again = substring_dedup.FingerprintIndex(spark, index.path)
    assert again.runs == index.runs and fps(again) == fps(whole)
    again.compact()
    assert len(again.runs) == 1 and fps(again) == fps(whole)
    first = again.read(again.runs[0][1])
    assert first.count() == first.select("fp").distinct().count()


def test_index_joins_runs_as_they_are(spark, small):
    """Runs are read by bucket and in order: neither a shuffle nor a sort of one."""
    index = substring_dedup.FingerprintIndex(spark, fanout=3)
    index.add(small.where("doc_id % 2 = 0"))
    index.add(small.where("doc_id % 2 = 1"))
    (_, a), (_, b) = index.runs
    with index._settings():
        plan = index.merged(a, b)._jdf.queryExecution().executedPlan().toString()
        batch = index.joined(substring_dedup._counted(small, "text", 35))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert batch.count("SortMergeJoin") == 2 and batch.count("Exchange hashpartitioning") == 1 and batch.count("Sort [") == 1


def test_incremental_dedup(spark, small):
    """Each batch judged on itself and history, the index opened anew in between, against brute force over both."""
    parts = [small.where(F.pmod("doc_id", F.lit(3)) == k) for k in range(3)]
    index, history = substring_dedup.FingerprintIndex(spark), None
    for part in parts:
        index = substring_dedup.FingerprintIndex(spark, index.path)
        got = substring_dedup.remove_repeats(part, batches=1, index=index, history=history)
        seen = listed(part) + (listed(history) if history is not None else [])
        assert multiset(tuple(r) for r in got.collect()) == multiset(brute_repeats(seen)[: part.count()])
        history = part if history is None else history.union(part)


# ---------------------------------------------------------------- 9 WARC


def test_warc(spark, nothing):
    pages = [(1, "http://a.example/x?q=1", "same"), (2, "HTTP://www.A.example/x", "same"), (5, "http://b.example/\r\nX: y", "same"), (3, None, None), (4, "no url at all", ""), (7, "http://[bad", "ünï \r\n\r\nWARC/1.1\r\n"), (None, "http://c.example", "same"), (9, "x", "twice"), (9, "y", "twice"), (None, None, "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("sha", "size", "s", "z", "latest", "file", "part")})
    got = warc.round_trip(spark, df).orderBy("position").collect()
    most = {}
    for p, _, h in pages:
        if p is not None:
            most[h or ""] = max(p, most.get(h or "", p))

    def want(p, h):
        b = (h or "").encode()
        refers = most.get(h or "")
        return p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if refers == p else "revisit", None if refers == p else refers

    assert multiset((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == multiset(want(p, h) for p, _, h in pages)
    assert [r.position for r in got] == list(range(len(pages)))
    keys = [(r.urlkey.encode(), r.ts) for r in got]
    assert keys == sorted(keys)
    assert warc.url_key("http://www.Example.org/A?b") == "org,example)/a?b"
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_files(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 7)
    files = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert files.agg(F.sum("records")).first()[0] == 50
    at = files.first().file
    store, path = warc._store(at)
    import gzip

    data = gzip.decompress(store.open_input_stream(path, compression=None).read())
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_loser_tree():
    r = random.Random(8)
    for k in (0, 1, 2, 3, 7, 8):
        rows = [(f"u{r.randrange(5)}", f"t{r.randrange(3)}", i, "", None, 0, "", "f", i, 0) for i in range(60)]
        runs = [sorted(rows[j::k], key=warc._order) for j in range(k)] + ([[]] if k else [])
        assert list(warc.merged(runs)) == (sorted(rows, key=warc._order) if k else [])


# ---------------------------------------------------------------- 10 decontamination


def brute_tiles(a, b, least):
    """Greedy string tiling as defined: mark the longest unmarked matches, over and over."""
    ma, mb, out = set(), set(), []
    while True:
        best = []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in ma and j + k not in mb:
                    k += 1
                best.append((k, i, j))
        most = max((k for k, _, _ in best), default=0)
        if most < least:
            return out
        for k, i, j in best:
            if k == most and not ma & set(range(i, i + k)) and not mb & set(range(j, j + k)):
                ma |= set(range(i, i + k))
                mb |= set(range(j, j + k))
                out.append(k)


def test_tiles():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 30))] for _ in range(2))
        got = decontaminate.tiles(a, b, 2)
        assert all(a[i : i + k] == b[j : j + k] for i, j, k in got)
        used = [x for _, j, k in got for x in range(j, j + k)]
        assert len(used) == len(set(used)) and len(used) >= 0.75 * sum(brute_tiles(a, b, 2)) - 2
    a = list(range(30))
    assert sorted(k for _, _, k in decontaminate.tiles(a[15:] + a[:15], a, 5)) == [15, 15]


def test_leaks(spark, odd, nothing):
    item = words(30)
    parts = item.split()
    texts = [f"{words(50)} {item} {words(50)}", f"{words(9)} {' '.join(parts[15:])} {words(9)} {' '.join(parts[:15])}".upper(), f"{words(50)} {' '.join(parts[:12])}", item[:-1], None, "", "short one here", words(500)]
    bench = spark.createDataFrame([(1, item), (2, "Short ONE"), (3, None), (None, item), (4, "  "), (1, item)], "item_id long, text string")
    df = documents(spark, texts)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(0, 1), (1, 1), (3, 1), (6, 2)}
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {2, 4, 5, 7, None}
    assert decontaminate.leaks(nothing, bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.clean(df, bench.limit(0)).count() == df.count()


def test_leaks_in_blocks(spark, small, sf_dir, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = multiset((r.doc_id, r.item_id, r.covered) for r in decontaminate.leaks(small, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert whole and multiset((r.doc_id, r.item_id, r.covered) for r in decontaminate.leaks(small, bench).collect()) == whole
    inside = {(i, r.item_id) for i, t in listed(small) for r in bench.collect() if " ".join(r.text.lower().split()) in " ".join((t or "").lower().split())}
    assert inside <= {(i, k) for i, k, _ in whole}


# ---------------------------------------------------------------- queries and pipeline


def test_queries_over_tables(spark, sf_dir):
    for name, f in queries.queries().items():
        assert f(spark, sf_dir).count() > 0, name


def test_pipeline(spark, sf_dir, small, library):
    docs = small
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, docs, sf_dir), name)
        assert after.schema.simpleString() == docs.schema.simpleString()
        before, now = dict(listed(docs)), dict(listed(after))
        if name == "language":
            assert set(now) == {i for i, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "near_dedup":
            first = {i for i, _, c in brute_components([(i, brute_simhash(t)) for i, t in before.items()]) if i == c}
            assert set(now) <= first
            like = {(a, b): jaccard(before[a], before[b]) for a in first for b in first if a < b}
            assert not [p for p, j in like.items() if j >= 0.84 and set(p) <= set(now)]
            near = collections.defaultdict(float)
            for (a, b), j in like.items():
                near[a], near[b] = max(near[a], j), max(near[b], j)
            assert all(near[i] > 0.74 for i in first - set(now))
        elif name == "passages":
            for i, _, gone, kept in brute_repeats(list(before.items())):
                assert now[i] == (kept if gone else before[i])
        elif name == "decontaminated":
            items = [r.text.encode().lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            for i, t in before.items():
                w = t.encode().lower().split()
                cover = max((sum(brute_tiles(w, x, 5)) / len(x) for x in items if {tuple(x[k : k + 5]) for k in range(len(x) - 4)} & {tuple(w[k : k + 5]) for k in range(len(w) - 4)}), default=0)
                assert (i in now) == (cover < 0.5), i
        docs = after
    want = {i: tuple(library.encode(t)) for i, t in listed(docs)}
    assert {r.doc_id: tuple(r.ids) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()} == want
    assert {r.doc_id: tuple(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


def test_pipeline_odd_cases(spark, odd, nothing, sf_dir):
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES:
            out = common.written(stage(spark, docs, sf_dir), "odd")
            docs = out
        assert docs.count() <= odd.count()
