import numpy as np
import pandas as pd
import pytest

from tallyfold.llm import ann, exact_topk, vectors
from tests.llm.conftest import with_clashes

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vecs, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in enumerate(vecs)], SCHEMA)


def arrays(df):
    found = df.collect()
    return np.array([r["vec_id"] for r in found]), np.array([r["embedding"] for r in found], float)


def plain_top(ids, points, own, query, k):
    score = points @ query
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != own][:k]
    return [(rank + 1, int(ids[i]), score[i]) for rank, i in enumerate(order)]


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 16))
    vecs = centres[rng.integers(0, 6, 900)] + 0.7 * rng.normal(size=(900, 16))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    vecs[100:140] = vecs[100]
    vecs[300:320] = np.round(vecs[300:320], 1)
    return table(spark, vecs).repartition(5)


def test_exact_search_against_all_pairs(spark, clusters, monkeypatch):
    monkeypatch.setattr(exact_topk, "LEAF", 16)
    queries = clusters.where("vec_id % 20 = 0")
    ids, vecs = arrays(clusters)
    whole = np.floor(vecs * 1024)
    found = by_query(exact_topk.exact_top_k(clusters, queries, 10))
    expected = {int(q): plain_top(ids, whole, q, whole[ids == q][0], 10) for q in ids[ids % 20 == 0]}
    assert found == expected


def test_trees_prune_and_bound():
    rng = np.random.default_rng(1)
    points = np.floor(rng.normal(size=(2000, 3)) * 1024)
    tree = exact_topk.Tree(np.arange(2000), points)
    query = np.array([1000.0, -500.0, 20.0])
    bounds = tree.bounds(query[None])[0]
    for (start, end), bound in zip(tree.spans, bounds, strict=True):
        assert (tree.points[start:end] @ query).max() <= bound
    assert sorted(tree.ids.tolist()) == list(range(2000))
    opened = []
    tree.spans = [(a, b) if opened.append(i) is None else None for i, (a, b) in enumerate(tree.spans)]
    ids, scores = tree.search(-1, query, bounds, 5, -np.inf, True)
    assert list(zip(ids.tolist(), scores.tolist(), strict=True)) == [(i, s) for _, i, s in plain_top(np.arange(2000), points, -1, query, 5)]


def test_several_blocks_and_shards(clusters, monkeypatch):
    expected = by_query(exact_topk.exact_top_k(clusters, clusters.where("vec_id % 50 = 0"), 3))
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 4)
    assert by_query(exact_topk.exact_top_k(clusters, clusters.where("vec_id % 50 = 0"), 3)) == expected


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = table(spark, [[1, 0], [0, 0], None, [], [nan, 1], [inf, 1], [None, 1], [1, 2, 3], [0.5, 0.5], [-1, 3]])
    df = with_clashes(df.union(spark.createDataFrame([(None, [1.0, 1.0], 0), (8, [0.5, 0.5], 1)], SCHEMA)), "rank", "score", "query_id")
    found = by_query(exact_topk.exact_top_k(df, df, 5))
    assert {q: [v for _, v, _ in x] for q, x in found.items()} == {0: [8, 8, 1, 9], 1: [0, 8, 8, 9], 8: [9, 0, 1], 9: [8, 8, 1, 0]}
    near = by_query(ann.nearest(df, df, 5))
    assert {q: [v for _, v, _ in x] for q, x in near.items()} == {0: [8, 8, 9], 8: [9, 0], 9: [8, 8, 0]}
    none = df.where("false")
    for search in (exact_topk.exact_top_k, ann.nearest):
        assert search(none, df, 5).collect() == search(df, none, 5).collect() == search(none, none, 5).collect() == []


def test_huge_components_don_t_overflow(spark):
    df = table(spark, [[3e38, 1], [-3e38, 1], [1, 1]])
    found = by_query(exact_topk.exact_top_k(df, df.where("vec_id = 2"), 5))
    assert [(r, v) for r, v, _ in found[2]] == [(1, 0), (2, 1)]


def test_recall_and_exact_scores(clusters):
    ids, vecs = arrays(clusters)
    found = by_query(ann.nearest(clusters, clusters.where("vec_id % 10 = 0"), 20, rerank=60))
    hits = total = 0
    for q in ids[ids % 10 == 0]:
        expected = plain_top(ids, vecs, q, vecs[ids == q][0], 20)
        hits += len({v for _, v, _ in found[q]} & {v for _, v, _ in expected})
        total += 20
        for _, v, score in found[q]:
            assert score == pytest.approx(float(vecs[ids == v][0] @ vecs[ids == q][0]), abs=1e-12)
    assert hits / total >= 0.9


def test_recall_on_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ids, vecs = arrays(df)
    found = by_query(ann.nearest(df, df.where("vec_id % 20 = 0"), 20))
    hits = [len({v for _, v, _ in found[q]} & {v for _, v, _ in plain_top(ids, vecs, q, vecs[ids == q][0], 20)}) for q in ids[ids % 20 == 0]]
    assert np.mean(hits) / 20 >= 0.9


def test_beam_search_finds_better_sums():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    books = ann.fit_codebooks(x, books=4, words=16)
    loss = {}
    for beam in (1, 8):
        codes = ann.encode(x, books, beam)
        coded = ann._reconstruct(codes, books)
        loss[beam] = ((x - coded) ** 2).sum()
        greedy, rest = [], x.copy()
        for book in books:
            near = ((rest[:, None] - book) ** 2).sum(2).argmin(1)
            greedy.append(near)
            rest = rest - book[near]
        if beam == 1:
            assert (codes == np.array(greedy).T).mean() > 0.99
    assert loss[8] < loss[1]
    guess = ann.lookup_scores(x[:5], codes, np.ones(400, np.float32), books)
    assert np.allclose(guess, x[:5] @ coded.T, atol=1e-3)


def test_scores_are_whole_numbers_of_any_size(spark):
    """Against Python's integers: sums of terms beyond 2 ** 53, ties there, and scores beyond a long."""
    rng = np.random.default_rng(6)
    for size, dtype in ((1e6, float), (1e9, float), (1e30, float)):
        vecs = rng.integers(-int(min(size, 1e15)), int(min(size, 1e15)), (300, 8)).astype(dtype) * max(1.0, size / 1e15)
        vecs[50:60] = vecs[50]
        vecs[60:90, :7], vecs[60:90, 7] = vecs[60, :7], vecs[60, 7] + np.arange(30)
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int").repartition(3)
        whole = [[int(x) * 1024 for x in v] for v in vecs]
        found = by_query(exact_topk.exact_top_k(df, df.where("vec_id % 30 = 0"), 40))
        assert set(found) == set(range(0, 300, 30))
        for q, rows in found.items():
            score = {i: sum(a * b for a, b in zip(whole[q], w, strict=True)) for i, w in enumerate(whole) if i != q}
            order = sorted(score, key=lambda i: (-score[i], i))[:40]
            assert rows == [(r + 1, i, min(max(score[i], -(2**63)), 2**63 - 1)) for r, i in enumerate(order)], size


def test_vectors_of_each_length_among_their_own(spark):
    df = table(spark, [[1, 0], [0, 1], [2, 2], [1, 0, 0], [1, 1, 0], [5]])
    for search in (exact_topk.exact_top_k, ann.nearest):
        found = by_query(search(df, df.where("vec_id in (0, 1, 2, 3, 5)"), 5))
        assert {q: [v for _, v, _ in x] for q, x in found.items()} == {0: [2, 1], 1: [2, 0], 2: [0, 1], 3: [4]}


def test_equal_vectors_come_in_the_order_of_their_ids(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(1500, 37))
    vecs[300:900] = vecs[300]
    df = table(spark, vecs).repartition(3)
    found = by_query(ann.nearest(df, df.where("vec_id in (300, 650)"), 20))
    assert [v for _, v, _ in found[300]] == list(range(301, 321)) and [v for _, v, _ in found[650]] == list(range(300, 320))
    assert len({s for _, _, s in found[300]}) == 1


@pytest.mark.parametrize(("n", "d", "spread"), [(20_000, 64, 0.5), (8192, 384, None)])
def test_recall_with_default_parameters(spark, n, d, spread):
    """Of clustered vectors and, the hard case, of those without any structure; queries are a fiftieth of the rows."""
    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(n, d)).astype(np.float32)
    if spread:
        vecs = rng.normal(size=(200, d))[rng.integers(0, 200, n)].astype(np.float32) + spread * vecs
    frame = pd.DataFrame({"vec_id": np.arange(n), "embedding": vecs.tolist(), "label": 0})
    df = spark.createDataFrame(frame, "vec_id long, embedding array<float>, label int").repartition(4)
    found = by_query(ann.nearest(df, df.where("vec_id % 50 = 0"), 20))
    wide = vecs.astype(float)
    hits = []
    for q in range(0, n, 50):
        score = wide @ wide[q]
        score[q] = -np.inf
        hits.append(len({v for _, v, _ in found[q]} & set(np.argpartition(-score, 20)[:20].tolist())))
    assert len(found) == len(hits) and np.mean(hits) / 20 >= 0.9
