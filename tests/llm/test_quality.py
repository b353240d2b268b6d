import random

import numpy as np
import pytest

from tallyfold.llm import quality, text
from tests.llm.conftest import prose, with_clashes


@pytest.fixture(scope="module")
def judged(spark, make_docs):
    rnd, docs, labels = random.Random(6), [], []
    for i in range(240):
        good = i % 4 != 0
        words = prose(i, rnd.randint(8, 120)).split()
        text = " ".join(w.capitalize() if j % 9 == 0 else w for j, w in enumerate(words)) + "."
        docs.append((i, text if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good)))
    return make_docs(*docs), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_labels(judged):
    found = quality.quality(*judged).collect()
    assert len(found) == 240 and any(r["held_out"] for r in found)
    assert all(r["predicted"] == (r["doc_id"] % 4 != 0) == (r["score"] >= 0.3) for r in found)


def test_held_out_accuracy_on_the_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) >= 0.8 * len(found)  # 68 labels to learn from


def test_moments_are_those_of_all_labelled_rows(spark, judged):
    docs, labels = judged
    x = np.array([quality.statistics(r["text"]) for r in docs.orderBy("doc_id").collect()])
    y = np.array([r["quality"] for r in labels.orderBy("doc_id").collect()])
    features = docs.select("doc_id", "text").mapInArrow(quality._features, "doc_id long, features array<double>")
    model = quality.train(features, labels.withColumnRenamed("quality", "label"))
    counts = np.array([(y == c).sum() for c in (0, 1)], float)
    whole = quality.fit(counts, np.array([x[y == c].sum(0) for c in (0, 1)]), np.array([x[y == c].T @ x[y == c] for c in (0, 1)]))
    assert np.allclose(model.means, whole.means) and np.allclose(model.scores(x), whole.scores(x), atol=1e-6)


def test_scores_are_the_log_density_difference():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 4)), rng.integers(0, 2, 300)
    x[y == 1] = x[y == 1] * 0.5 + 1
    model = quality.fit(
        np.array([(y == c).sum() for c in (0, 1)], float), np.array([x[y == c].sum(0) for c in (0, 1)]),
        np.array([x[y == c].T @ x[y == c] for c in (0, 1)]),
    )
    logs = []
    for c in (0, 1):
        cov = np.linalg.inv(model.inverse[c].T @ model.inverse[c])
        z = x - model.means[c]
        logs.append(model.log_prior[c] - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (8, None), (9, 7), (4, 1), (99, 0)], "doc_id long, quality int")
    found = quality.quality(with_clashes(odd_docs, "score", "features"), with_clashes(labels, "text", "label")).collect()
    assert len(found) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in found)
    assert quality.quality(no_docs, labels).collect() == []
    assert {r["score"] for r in quality.quality(odd_docs, labels.where("false")).collect()} == {0.5}
    one = quality.quality(odd_docs, labels.where("quality = 1")).collect()
    assert all(r["score"] > 0.5 for r in one)


def test_statistics_of_blocks(monkeypatch):
    from tallyfold.llm import text

    value = "Some Words! here here\nand there 12 | x\n" * 30
    whole = quality.statistics(value)
    monkeypatch.setattr(text.blocks, "__defaults__", (64,))
    parts = dict(zip(quality.FEATURES, np.abs(np.array(quality.statistics(value)) - whole), strict=True))
    assert all(d < 1e-9 for k, d in parts.items() if k not in ("variety", "repeated_lines"))
    assert len(whole) == len(quality.FEATURES)


def test_the_query_against_a_plain_version(spark, sf_dir):
    """Features, moments and scores of every document in a plain loop."""
    import zlib

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    learnt = [(x[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    score = {}
    means = {c: np.mean([v for v, k in learnt if k == c], axis=0) for c in (0, 1)}
    spread = {c: np.cov(np.array([v for v, k in learnt if k == c]).T, bias=True) for c in (0, 1)}
    share = {c: sum(k == c for _, k in learnt) for c in (0, 1)}
    pooled = sum(spread[c] * share[c] for c in (0, 1)) / len(learnt)
    for i, v in x.items():
        logs = []
        for c in (0, 1):
            cov = (1 - quality.POOLED) * spread[c] + quality.POOLED * pooled
            cov = (1 - quality.DIAGONAL) * cov + quality.DIAGONAL * np.diag(np.diag(cov)) + quality.FLOOR * np.eye(len(v))
            z = v - means[c]
            logs.append(np.log((share[c] + 0.5) / (len(learnt) + 1)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * z @ np.linalg.solve(cov, z))
        score[i] = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    found = quality.quality(docs, labels).collect()
    assert len(found) == len(score) and all(r["score"] == pytest.approx(score[r["doc_id"]], abs=1e-6) for r in found)


def test_features_are_those_of_the_whole_text(monkeypatch):
    """Words and lines that repeat far apart count as repeated, whatever the blocks."""
    half = "\n".join(prose(i, 12) for i in range(40)) + "\n"
    values = [half + half, prose(1, 300), "a\nb c\n\nd", "one " * 50, "x", ""]
    whole = [quality.statistics(v) for v in values]
    for size in (7, 64):
        monkeypatch.setattr(quality, "blocks", lambda t, size=size: text.blocks(t, size))
        assert [quality.statistics(v) for v in values] == whole
    assert whole[0][quality.FEATURES.index("repeated_lines")] > 0.6
