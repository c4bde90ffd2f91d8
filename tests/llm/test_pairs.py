"""Jaccard join, components and neighbour search against brute force."""

import random
import re

import numpy as np
import pytest
from conftest import SMALL

from filmweave.llm import jaccard_join as J, neighbours as N, regions as R
from filmweave.llm.components import connected_components


def shingles(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words=4, percent=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, words))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if s and i is not None]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[k + 1 :]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(shingles(t, words)), find(i)) for i, t in rows), key=str)


def near_copies(seed, groups=12, size=8):
    """Groups around a base text, edits of every strength, so that many pairs sit near the threshold."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(30)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(6, 120))]
        for _ in range(size):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 20))):
                text[r.randrange(len(text))] = word()
            out.append(" ".join(text + common * r.choice([0, 0, 1])))
    return list(enumerate(out))


CASES = [(900, None), (901, ""), (902, " \n"), (903, "Just three words"), (904, "just three WORDS"), (905, "x " * 3000), (906, "X\t" * 3000), (907, "É a b c"), (908, "é a b c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed):
    rows = near_copies(seed) + CASES + [(5, near_copies(seed)[5][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, print string")
    got = sorted((tuple(r) for r in J.join(df).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_join_divides_large_regions(spark, monkeypatch, seed):
    """Limits so small that pivots divide regions on the cluster, and what they can't divide meets block by block."""
    monkeypatch.setattr(J, "CELL_ROWS", 6)
    monkeypatch.setattr(J, "REGION_SHINGLES", 400)
    rows = near_copies(seed, groups=4, size=14)
    assert sorted((tuple(r) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute(rows)


@pytest.mark.parametrize(("few", "words", "percent"), [(8, 4, 85), (10**9, 4, 85), (10**9, 5, 80), (10**9, 4, 50)])
def test_jaccard_join_divides_by_second_shingle(spark, monkeypatch, few, words, percent):
    """Regions of a few members divided by size and second shingle (at 50 percent by pivots alone), no shingle known as frequent."""
    monkeypatch.setattr(J, "REGION_ROWS", 3)
    monkeypatch.setattr(J, "FEW_REGIONS", few)
    monkeypatch.setattr(J, "FREQUENT", 10**9)
    r = random.Random(few + words)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    short = [(2000 + k, " ".join(["same passage in all of them", *(word() for _ in range(r.randint(0, 6)))])) for k in range(60)]
    rows = near_copies(7, groups=6, size=9) + CASES + short
    got = sorted((tuple(x) for x in J.join(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()), key=str)
    assert got == brute(rows, words, percent)


def test_unrelated_texts_under_one_shingle_leave_nothing(spark):
    """20,000 texts of one size that share one rare shingle: no cell; a pair that shares a second one too is all that meets."""
    rows = [(i, 20, [7, *range(100 + 10 * i, 104 + 10 * i)]) for i in range(20000)] + [(20000, 21, [7, 100, 5, 6])]
    nodes = spark.createDataFrame(rows, "doc_id long, n long, prefix array<long>")
    assert sorted(r["doc_id"] for r in J.cells(nodes, 85).collect()) == [0, 20000]


def test_known_shingles_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(J, "KNOWN", 2)
    texts = ["a b c d"] * 9 + ["b c d e"] * 7 + ["c d e f"] * 5
    found, counts = J.frequent_shingles(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4)
    assert sorted(counts.tolist()) == [7, 9] and sorted(found.tolist()) == found.tolist()


def hub(seed, size, words=100, edits=3):
    """Copies of one text that all link to it and hardly to each other, the text itself among them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(size - 1):
        text = list(base)
        for at in r.sample(range(2, words - 3), edits):
            text[at] = word()
        out.append(" ".join(text))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("edits", [2, 4, 6])
def test_one_large_group_of_near_copies(spark, edits):
    rows = hub(edits, 300, edits=edits)
    pairs = []
    joined = J.region_links

    def counted(*args):
        pairs.append(joined(*args))
        return pairs[-1]

    J.region_links = counted
    try:
        got = sorted((tuple(r) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    finally:
        J.region_links = joined
    assert got == brute(rows)
    assert sum(x.count() for x in pairs[1:]) < len(rows)  # a forest, not all pairs


@pytest.mark.parametrize("leaf", [4, 64])
def test_regions_join_like_all_pairs(monkeypatch, leaf):
    monkeypatch.setattr(R, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    for spread in (0, 6, 12, 30):
        sets = []
        for _ in range(25):
            base = rng.integers(1, 2**63, rng.integers(20, 90)).astype(np.uint64) << np.uint64(16)
            for _ in range(12):
                s = base.copy()
                s[: rng.integers(0, spread + 1)] = rng.integers(1, 2**47, 1).astype(np.uint64) << np.uint64(16)
                sets.append(np.unique(s))
        n = np.array([len(s) for s in sets])
        linked = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
        exact = R.join_region(R.Sets(n, [R.Sets.of(s) for s in sets], 85), len(sets))
        assert {(max(x), min(x)) for x in exact} <= linked and len(exact) < len(sets)
        loose = R.join_region(R.Sketches(n, [R.Sketches.of(s) for s in sets], 85), len(sets))

        def groups(edges):
            label = list(range(len(sets)))
            for a, b in edges:
                x, y = label[a], label[b]
                label = [x if v == y else v for v in label]
            return label

        want, got, open_ = groups(linked), groups(exact), groups(loose)
        assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))
        assert all(open_[a] == open_[b] for a, b in linked)


def test_jaccard_join_of_nothing(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = J.join(spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(1, 2, 1), (None, 2, 1)]


def test_sketch_never_rules_out_a_link():
    rng = np.random.default_rng(0)
    for n in (5, 40, 400, 5000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        b[: int(n * 0.08)] = rng.integers(0, 2**63, int(n * 0.08)).astype(np.uint64)
        raw = [R.Sketches.of(a), R.Sketches.of(b)]
        assert 8 * len(raw[0]) >= max(n, R.Sketches.BITS)
        narrow = (np.packbits(np.bincount((a >> np.uint64(20) & np.uint64(R.Sketches.BITS - 1)).astype(int), minlength=R.Sketches.BITS) & 1)).view(np.uint64)
        two = R.Sketches(np.array([n, n]), raw, 85)
        assert (two.narrow[0] == narrow).all()
        link = 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
        assert not link or two.links(0, np.array([1])).tolist() == [1]
        assert two.distance(0, np.array([1]))[0] <= len(np.setxor1d(a, b))


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for ab in links for x in ab}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {row["node"]: row["component"] for row in got} == want and len(got) == len(want)


def test_neighbours_recall(spark):
    got = N_query(spark)
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    hits = 0
    for q, rows in got.items():
        d = np.sqrt(((x - vectors[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hits += len(best & {r["vec_id"] for r in rows})
        assert [r["rank"] for r in rows] == list(range(1, 11))
        assert all(abs(d[np.searchsorted(ids, r["vec_id"])] - r["score"]) < 1e-12 for r in rows)
    assert set(got) == {i for i in vectors if i % 100 == 0} and hits >= 0.9 * 10 * len(got)


def N_query(spark):
    found = {}
    for r in sorted(N.op7_nn_descent(spark, SMALL).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r)
    return found


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors, dtype = N.usable(df)
    graph = N.build_graph(vectors, dtype, rounds=1)
    queries = vectors.where("id % 100 = 0").selectExpr("id as query_id", "v as q")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in N.search(queries, graph, vectors, dtype, 10).collect())
    s = round(2**0.5, 9)
    assert got == [(0, 1, 7, 0.0), (0, 2, 8, 0.0), (0, 3, 100, s), (100, 1, 0, s), (100, 2, 7, s), (100, 3, 8, s)]
    empty, dtype = N.usable(df.limit(0))
    assert N.search(empty.selectExpr("id as query_id", "v as q"), N.build_graph(empty, dtype, 1), empty, dtype, 3).count() == 0


def ring(spark, n, offsets):
    """A graph in which i has i + offsets as its list and n - 1 or fewer have it, with random vectors; nothing has met."""
    x = np.random.default_rng(5).normal(size=(n, 8))
    vectors = spark.createDataFrame([(i, v.astype("<f8").tobytes()) for i, v in enumerate(x)], "id long, v binary")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    lists = {i: sorted(offsets(i), key=lambda j: (d[i, j], j)) for i in range(n)}
    rows = [(i, to, [float(d[i, j]) for j in to], [N.AHEAD | N.BACK] * len(to)) for i, to in lists.items()]
    return lists, d, vectors, spark.createDataFrame(rows, N.LISTS)


def test_neighbours_meeting_passes_on_all_that_are_nearer(spark):
    n = 90
    lists, d, vectors, graph = ring(spark, n, lambda i: [(i + s) % n for s in range(1, N.K + 1)])
    want = {i: set(to) for i, to in lists.items()}
    for at in range(n):
        members = set(lists[at]) | {i for i in lists if at in lists[i]}
        for i in members:
            want[i] |= members - {i}
    got = {r["id"]: r["ids"] for r in N.descend(graph, vectors, "<f8", 0).collect()}
    assert got == {i: sorted(to, key=lambda j: (d[i, j], j))[: N.K] for i, to in want.items()}


def test_neighbours_edges_that_were_cut_wait(spark):
    n = 70
    _, _, vectors, graph = ring(spark, n, lambda i: [0] if i else [1])
    after = {r["id"]: dict(zip(r["ids"], r["fresh"], strict=True)) for r in N.descend(graph, vectors, "<f8", 0).collect()}
    waiting = sum(to.get(0) == N.BACK for to in after.values())
    met = sum(to.get(0) == 0 for to in after.values())
    assert met <= N.K and waiting + met + sum(0 not in to for i, to in after.items() if i) == n - 1 and waiting >= n - 1 - 2 * N.K


def test_jaccard_join_of_the_pipeline(spark):
    """Five words and 80 %, as corpus_pipeline.near_duplicates joins."""
    rows = near_copies(6) + [(900, None), (901, "just three words"), (902, "just three words")]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in root):
            break
    got = sorted(tuple(r) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80).collect())
    assert [(i, n) for i, n, _ in got] == [(i, len(sets[i])) for i in sorted(sets)]
    assert {i: c for i, _, c in got} == root


def test_neighbours_recall_with_a_beam_of_few_percent(spark):
    """6,600 vectors in clusters, so that the beam holds less than 5 % of them; repeated ids and extra columns beside."""
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(60, 24))[rng.integers(0, 60, 6600)] + 0.5 * rng.normal(size=(6600, 24))).astype(np.float32)
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)] + [(5, (x[5] + 1).tolist(), 0), (100, [float("nan")] * 24, 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long")
    vectors, dtype = N.usable(df)
    assert vectors.count() == 6600 and N.BEAM < 0.05 * 6600
    x[5] = min(x[5].tolist(), (x[5] + 1).tolist())
    graph = N.build_graph(vectors, dtype)
    queries = vectors.where("id % 100 = 0").selectExpr("id as query_id", "v as q")
    found = {}
    for r in N.search(queries, graph, vectors, dtype, 10).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    y, hits = x.astype(np.float64), 0
    for q in range(0, 6600, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(6600), d))[:10].tolist()) & set(found[q]))
    assert hits >= 0.9 * 10 * 66


def test_op10_as_registered(spark):
    """The query itself: columns, types, and every document of the small table against brute force."""
    got = J.op10_jaccard_join(spark, SMALL)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
