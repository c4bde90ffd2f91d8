"""Rules, models, language and the pipeline: brute force on counts, held-out accuracy on labels."""

import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from filmweave.llm import language_id as L, quality_model as Q, textstats as S, toxicity as T, weak_rules as R
from filmweave.llm.common import in_fold, sample_labels, word_count

TEXTS = [None, "", " \n ", "a", "a a a a", "x y z x y z\nx y z\n\nx y z\n \n", "#*$%&|<> É é!", "one two three one two three " * 40, "w%d " * 60 % tuple(range(60)), "the same line\n" * 5, "\x0b\x0ca b c"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", None, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, score double")


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, seen = Counter(windows), Counter(lines)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(n - 1 for n in seen.values()), len(covered)


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert S.text_stats(text)[:5] == brute(text)


def test_counts_of_documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 6000").limit(80).collect()
    assert all(S.text_stats(r["text"])[:5] == brute(r["text"]) for r in rows)


def test_word_count(spark):
    got = {r["doc_id"]: r["n"] for r in docs(spark).select("doc_id", word_count("text").alias("n")).collect()}
    assert got == {i: brute(t)[0] for i, t in enumerate(TEXTS)}


def test_rules(spark):
    got = {r["doc_id"]: r for r in R.judge(docs(spark)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        n, _, _, _, repeats = brute(t)
        assert got[i]["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (got[i]["base_failed"] and got[i]["kept"])
    assert R.judge(docs(spark, [])).count() == 0


@pytest.mark.parametrize("truth", [0.8, 0.5, 0.2])
def test_em_finds_planted_accuracies(truth):
    """With the shipped settings, for corpora that are mostly good, half and half, and mostly junk."""
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < truth
    right = [0.95, 0.9, 0.8, 0.7, 0.6]
    v = np.stack([np.where(rng.random(len(good)) < 0.2, R.ABSTAIN, np.where(rng.random(len(good)) < a, good, ~good)) for a in right], 1)
    patterns = {}
    for row in v:
        key = "".join(map(str, row))
        patterns[key] = patterns.get(key, 0) + 1
    kinds = R.fit(patterns)
    assert abs(kinds.good_share - good.mean()) < 0.05
    assert ((kinds.posterior(v) > 0.5) == good).mean() > 0.93
    for junk, vote in ((False, R.GOOD), (True, R.BAD)):
        said = kinds.behaviour(junk)
        assert np.abs(said[:, vote] / (said[:, R.GOOD] + said[:, R.BAD]) - right).max() < 0.06
    assert R.fit({}) is None


def test_em_finds_junk_that_one_rule_sees():
    """Kinds of junk that trip one or two rules each, while the other rules call them good."""
    rng = np.random.default_rng(5)
    kind = rng.choice(4, 5000, p=[0.9, 0.04, 0.03, 0.03])
    v = np.full((len(kind), 6), R.GOOD)
    v[rng.random(v.shape) < 0.02] = R.ABSTAIN
    v[rng.random(v.shape) < 0.003] = R.BAD
    for k, (a, b, to) in enumerate(((0, 1, R.BAD), (2, 3, R.BAD), (4, 5, R.ABSTAIN)), 1):
        v[kind == k, a], v[kind == k, b] = R.BAD, to
    patterns = {}
    for row in v:
        key = "".join(map(str, row))
        patterns[key] = patterns.get(key, 0) + 1
    kept = R.fit(patterns).posterior(v) >= 0.5
    assert kept[kind == 0].mean() > 0.98 and not kept[kind > 0].any()


def test_rules_query_against_counts_by_hand(spark):
    """op5 itself: every contract column by the regular expressions of its definition, and kept only through the EM's verdict."""
    folder = "/root/testdata/sf0.001"
    rows = R.op5_weak_rules(spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_rules_keep_good_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = R.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_additive_model():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair explains it
    model = Q.AdditiveModel.fit(x[:3000], y[:3000], rounds=60, pairs=2)
    assert (1, 0) in model.pairs and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert Q.AdditiveModel.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert Q.AdditiveModel.fit(x[:5], np.ones(5)).score(x[:1])[0] > 0.9


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize(("query", "label", "folds", "held", "least"), [(Q.op4_quality, "quality", 5, 0, 0.95), (T.op3_toxicity, "toxic", 4, 2, 0.85)])
def test_models_on_held_out_labels(spark, query, label, folds, held, least):
    folder = "/root/testdata/sf0.1" if label == "toxic" else "/root/testdata/sf0.01"
    rows = query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (in_fold(r["doc_id"], folds) == held) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert auc(np.array([r[label] for r in out]), np.array([r["score"] for r in out])) > least


def test_labels_are_sampled_without_the_held_out_fold(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (1, None), (3, 0)], "doc_id long, toxic int")
    picked = sample_labels(labels, "toxic", 4, 2, 30)
    assert len(picked) == 60 and all(in_fold(i, 4) != 2 and y == i % 2 for i, y in picked) and picked == sample_labels(labels.repartition(5), "toxic", 4, 2, 30)
    assert sample_labels(labels.limit(0), "toxic", 4, 2, 30) == []


def test_models_score_odd_texts(spark):
    for score, model in ((Q.score, Q.train(docs(spark), [])), (T.score, T.train(docs(spark), []))):
        got = {r["doc_id"]: r["score"] for r in score(docs(spark), model).collect()}
        assert set(got) == set(range(len(TEXTS))) and set(got.values()) == {0.5}
        assert score(docs(spark, []), model).count() == 0


def test_misspellings_share_grams():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60)]
    text = lambda bad: " ".join(rng.permutation([*rng.choice(words, 30), *["worthless"] * bad]))
    y = np.arange(200) % 2
    model = T.SubwordModel.fit(T.bags(pa.array([text(2 * k) for k in y])), y)
    close, far, own = model.pulls(pa.array(["worthles"]))[0], model.pulls(pa.array(["wurthless"]))[0], model.pulls(pa.array(words))
    assert close > 5 * abs(np.mean(own)) and far > np.max(own)


def plain_trigrams(word):
    """Bucket of every three characters of a word between blanks, spelled out in integers."""
    mask, w = (1 << 64) - 1, f" {''.join(c for c in word if ord(c) not in set(L.EDGES.tolist()))} "
    found = []
    for i in range(len(w) - 2):
        h = 3
        for k, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
            h = (h ^ ord(w[i + k])) * m & mask
            h ^= h >> 29
        for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            h = (h ^ h >> 30) * m & mask
        found.append((h ^ h >> 31) % L.BUCKETS)
    return found


def test_language_model_against_plain_counts(spark):
    """Table and likelihoods of every text, trigram by trigram."""
    said = {"a": ["the cat sat", "on the mat"], "b": ["le chat est", "sur le tapis \U0001f600é"]}
    rows = [(i, t, v) for v, ts in said.items() for i, t in enumerate(ts)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = np.zeros((L.BUCKETS, 2))
    for k, v in enumerate(sorted(said)):
        for t in said[v]:
            for w in t.split():
                for g in plain_trigrams(w):
                    counts[g, k] += 1
    smooth = counts + 0.05
    assert model.languages == ["a", "b"] and np.allclose(model.table, np.log(smooth / smooth.sum(0) * L.BUCKETS), atol=1e-5)
    texts = ["the cat", "le TAPIS", "... 12", "", None, "the the é", "\u3000x\u2003y z.", "w" * 5000, "a b " * 4000]
    ll, n = model(pa.array(texts))
    for t, got, size in zip(texts, ll, n, strict=True):
        grams = [g for w in (t or "").lower().split() for g in plain_trigrams(w)]
        assert size == len(grams) and np.allclose(got, model.table[grams].sum(0), rtol=1e-4, atol=1e-3)


def test_fusion_against_plain_bayes(spark):
    rows = [(i, t, d, s, h) for i, (t, d, s, h) in enumerate([("aa ab aa", "x", "q", "h1"), ("bb ba bb", "y", None, "h1"), ("aa ab", None, "q", None), ("bb bb", "y", "r", "h2"), ("ab ab ba", "z", "r", None), ("", "x", "q", "h1"), (None, None, None, None)] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")
    model = L.train(spark.createDataFrame([(1, "aa ab aa", "x"), (2, "bb ba bb", "y")], "doc_id long, text string, lang string"))
    ll, n = model(pa.array([r[1] for r in rows]))
    top = [int(x.argmax()) if k else None for x, k in zip(ll, n, strict=True)]
    corpus = np.array([1.0 + top.count(k) for k in (0, 1)])
    prior = corpus / corpus.sum()
    count = lambda column, v: np.array([sum(r[column] == v and t == k for r, t in zip(rows, top, strict=True)) for k in (0, 1)], float)
    values = len({r[2] for r, t in zip(rows, top, strict=True) if r[2] and t is not None})
    got = {r["doc_id"]: r for r in L.identify(df, model).collect()}
    for (i, _, d, s, h), x, k in zip(rows, ll, n, strict=True):
        ends, at = count(3, s) if s else np.zeros(2), count(4, h) if h else np.zeros(2)
        wide = (ends + L.SUFFIX_WEIGHT * prior) / (ends.sum() + L.SUFFIX_WEIGHT)
        z = np.log((at + L.HOST_WEIGHT * wide) / (at.sum() + L.HOST_WEIGHT)) + (np.log((count(2, d) + 1) / (corpus + values + 1)) if d else 0)
        mean = x / max(k, 1)
        z = z + mean * min(k, L.EVIDENCE)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = int(p.argmax())
        assert abs(got[i]["posterior"] - p[best]) < 1e-6 and got[i]["kept"] == bool(k and p[best] >= 0.5 and mean[best] > 0)
        assert got[i]["language"] == (L.OTHER if k and mean.max() <= 0 else "xy"[best])


def test_more_languages_than_any_fixed_number(spark):
    """Ninety languages of their own letters: each is learned and told apart."""
    letters = [chr(0x4E00 + k) for k in range(90)]
    rows = [(9 * k + j, " ".join([c * 3, c * 2] * 20), f"l{k:02}", None, None) for k, c in enumerate(letters) for j in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")
    got = L.identify(df, L.train(df, "declared")).collect()
    assert len(got) == len(rows) and all(r["language"] == r["declared"] and r["kept"] for r in got)
    foreign = spark.createDataFrame([(1, "hello there world", None, None, None)], df.schema)
    assert [(r["language"], r["kept"]) for r in L.identify(foreign, L.train(df, "declared")).collect()] == [(L.OTHER, False)]


def test_toxicity_scores_against_plain_sums(spark):
    rng = np.random.default_rng(4)
    model = T.SubwordModel(rng.normal(size=T.BUCKETS).astype(np.float32), 0.3)
    texts = ["a bb ccc", "Idiot idiot", "", None, " \t", "é\U0001f600x", "w" * 3000, "one two " * 5000]

    @functools.cache
    def buckets(word):
        mask, w, found = (1 << 64) - 1, f"<{word}>", []
        for size in T.GRAMS:
            for i in range(len(w) - size + 1):
                h = size
                for k in range(size):
                    h = (h ^ ord(w[i + k])) * (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[k % 3] & mask
                    h ^= h >> 29
                for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
                    h = (h ^ h >> 30) * m & mask
                found.append((h ^ h >> 31) % T.BUCKETS)
        return found

    want, bags = [], []
    for t in texts:
        words = (t or "").lower().split()
        pulls = {w: model.pull[buckets(w)].mean() for w in set(words)}
        want.append(1 / (1 + np.exp(-(model.bias + (np.mean([pulls[w] for w in words]) if words else 0)))))
        bag = {}
        for w in words:
            for g in buckets(w):
                bag[g] = bag.get(g, 0) + 1 / len(words) / len(buckets(w))
        bags.append(bag)
    assert np.allclose(model.score(pa.array(texts)), want, atol=1e-4)
    for (ids, weights), bag in zip(T.bags(pa.array(texts)), bags, strict=True):
        assert ids.tolist() == sorted(bag) and np.allclose(weights, [bag[i] for i in sorted(bag)], atol=1e-5)


def test_rare_languages_are_found_or_kept(spark):
    """Two of 3,002 documents declare a language of their own: no share is too small, and without a model the declaration stands."""
    rows = [(k, "the cat and the dog sat there on that mat " * 3, "en" if k % 2 else "es", "h") for k in range(3000)]
    rare = [(9000 + k, "жъ щюя эжъ ыщ юяэ жъщ ыюя " * 4, "zz", "h") for k in range(2)]
    df = spark.createDataFrame(rows + rare, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["language"], r["kept"]) for r in L.identify(L.evidence_of_documents(df), L.train(df)).where("doc_id >= 9000").collect()}
    assert got == {9000: ("zz", True), 9001: ("zz", True)}
    found = {r["doc_id"]: (r["language"], r["kept"]) for r in L.identify(L.evidence_of_documents(df), L.train(df, least_texts=3)).where("doc_id >= 9000").collect()}
    assert found == got


def test_rows_of_one_hash_are_not_lost(spark, monkeypatch):
    """A hash of two bits makes unequal rows share it: the mix takes each for itself, near duplicates lose none that differ."""
    import corpus_pipeline as cp
    from filmweave.llm import common, mixing

    monkeypatch.setattr(common, "ROW_BITS", 2)
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 10_000, 30)) for _ in range(40)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(0, texts[0], "en", "s", len(texts[0]))], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"] for x in mixing.mix(df).collect()} == set(range(40))
    kept = [x["doc_id"] for x in cp.near_duplicates(spark, df, SMALL).collect()]
    assert sorted(kept) == list(range(40))


def test_language_of_documents(spark):
    rows = L.op9_language_id(spark, SMALL).collect()
    assert len(rows) == 200 and np.mean([r["kept"] for r in rows]) > 0.98 and np.mean([r["language"] == r["declared"] for r in rows]) > 0.98
    pages = L.page_language(spark, SMALL).collect()
    assert len(pages) == 50 and np.mean([r["language"] == r["declared"] for r in pages]) > 0.95


def test_language_evidence(spark):
    docs_ = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = L.train(docs_)
    rows = [(1, "und", "de", "de", "h"), (2, None, "de", None, None), (3, "1 2 3", None, None, "h"), (4, "the and that with for", None, "zz", "new"), (5, "the and that with for", "de", None, None)]
    got = {r["doc_id"]: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string"), model).collect()}
    assert len(got) == 5 and not got[2]["kept"] and not got[3]["kept"] and got[2]["text_language"] is None
    assert got[4]["language"] == got[5]["language"] == "en" and got[4]["kept"]
    none = L.identify(spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string"), L.train(docs_.limit(0)))
    assert not any(r["kept"] for r in none.collect())


ODD = [
    (None, "no id " * 3, "en", "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0), (3, "\n", "en", "s", 0),
]


def odd(spark, start):
    """Documents beside rows with null and repeated ids, equal rows, a long text, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    long = start.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.array_join(F.array_repeat("text", 40), " ").alias("text"), "lang", "source", "n_chars")
    unnamed = start.orderBy("doc_id").limit(20).withColumn("doc_id", F.lit(None).cast("long"))
    repeated = start.orderBy("doc_id").limit(30).withColumn("doc_id", F.lit(7).cast("long"))
    both = start.unionByName(start.orderBy("doc_id").limit(5)).unionByName(unnamed).unionByName(repeated).unionByName(long).unionByName(spark.createDataFrame(ODD, start.schema))
    return both.selectExpr("*", "n_chars as row", "text as doc", "source as size", "lang as kept", "doc_id as same", "map(1, lang) as cell")


def counted(df):
    return Counter(tuple(str(x) for x in r) for r in df.collect())


def test_pipeline_stages_against_plain_versions(spark):
    """Each stage on its own input, row by row; only the learned judgements themselves are taken from the operators."""
    import corpus_pipeline as cp
    from test_pairs import brute as components

    start = odd(spark, spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 3000").limit(120)).cache()
    rules = cp.quality_rules(spark, start, SMALL)
    assert rules.columns == start.columns
    rows = start.collect()
    judged = {r["doc_id"]: r["kept"] for r in R.judge(spark.createDataFrame([(i, r["text"]) for i, r in enumerate(rows)], "doc_id long, text string")).collect()}
    want = Counter(tuple(str(x) for x in r) for i, r in enumerate(rows) if judged[i])
    assert counted(rules) == want and None in [r["doc_id"] for r in rules.collect()]

    spoken = cp.language(spark, start, SMALL)
    same = L.evidence_of_documents(spark.createDataFrame([(i, r["text"], r["lang"], r["source"]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string"))
    told = {r["doc_id"]: r["kept"] for r in L.identify(same, L.train(start)).collect()}
    assert spoken.columns == start.columns and sum(told.values()) > 100
    assert abs(sum(counted(spoken).values()) - sum(told.values())) <= 2  # samples by another hash

    dup = cp.near_duplicates(spark, start, SMALL)
    of = {i: c for i, _, c in components([(i, r["text"]) for i, r in enumerate(rows)], 5, 80)}
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(of[i] if (r["text"] or "").split() else ("blank", tuple(str(x) for x in r)), []).append(r)
    least = lambda g: min((r["doc_id"] is None, r["doc_id"] or 0) for r in g)
    assert dup.columns == start.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in dup.collect()) == sorted(map(least, groups.values()))

    mixed = cp.mix_sources(spark, start, SMALL)
    assert mixed.columns == start.columns and set(counted(mixed)) <= set(counted(start))
    packed = cp.pack_sequences(spark, start, SMALL).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in rows)
    filled = {}
    for r in packed:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        assert [a for a, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048


def test_pipeline(spark):
    import corpus_pipeline as cp

    start = spark.read.parquet(f"{SMALL}/documents.parquet")
    now, seen = start, []
    for k, (_, step) in enumerate(cp.STAGES):
        out = step(spark, now, SMALL)
        if k < 4:
            assert out.columns == start.columns
            seen.append(out.count())
        now = out
    assert start.count() >= seen[0] >= seen[1] >= seen[2] > 100
    whole = cp.run(spark, SMALL)
    assert counted(whole.select("doc_id", "piece", "start", "length", "ids_crc32")) == counted(now.select("doc_id", "piece", "start", "length", "ids_crc32"))
    for _, step in cp.STAGES:
        assert step(spark, start.limit(0), SMALL).count() == 0
