from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallyfold.llm import langid, mixing, passages
from tallyfold.llm.queries import tokenizer_path
from tests.llm import test_mixing, test_near_copies
from tests.llm.conftest import rows

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    """documents, and what each stage makes of it, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(staged):
    assert all(df.columns == staged[0].columns and df.dtypes == staged[0].dtypes for df in staged[1:-1])


def test_languages_that_can_t_be_told_go(staged):
    judge = langid.Classifier(langid.learn(staged[0]))
    kept = []
    for r in staged[0].collect():
        language, _, margin = judge.classify(r["text"])
        if language != langid.UNDETERMINED and margin >= langid.MARGIN:
            kept.append(tuple(r))
    assert rows(staged[1]) == sorted(kept, key=repr) and len(kept) > 0.95 * staged[0].count()


def test_one_of_each_group_of_near_copies_stays(staged):
    """Near copies have 0.8 of their five-word shingles in common; nothing else goes, and few of them stay."""
    before = {r["doc_id"]: r for r in staged[1].collect()}
    kept = {r["doc_id"]: r for r in staged[2].collect()}
    assert all(tuple(r) == tuple(before[i]) for i, r in kept.items())
    of = test_near_copies.classes({i: r["text"] for i, r in before.items()})
    for i in before.keys() - kept.keys():
        assert any(j in kept and j < i for j in of[i])
    surplus = len(before) - len({id(g) for g in of.values()})
    assert surplus and len(before) - len(kept) >= 0.8 * surplus


def test_shared_passages_stay_once(staged):
    before = {r["doc_id"]: r for r in staged[2].collect()}
    after = {r["doc_id"]: r for r in staged[3].collect()}
    spans = {}
    for doc, start, end, *_ in passages.shared_passages(staged[2]).collect():
        spans.setdefault(doc, []).append((start, end))
    for doc, r in before.items():
        words = r["text"].split()
        left = [w for i, w in enumerate(words) if not any(a <= i < b for a, b in spans.get(doc, ()))]
        assert (after[doc]["text"].split() if doc in after else []) == left
        if doc in after:
            assert after[doc]["n_chars"] == len(after[doc]["text"]) and after[doc]["lang"] == r["lang"]
        if doc not in spans:
            assert after[doc]["text"] == r["text"]
    seen = Counter()
    for r in after.values():
        words = r["text"].lower().split()
        seen.update({tuple(words[i : i + passages.MIN_WORDS]) for i in range(len(words) - passages.MIN_WORDS + 1)})
    assert max(seen.values(), default=1) == 1


def test_sources_are_drawn_by_weight(staged):
    expected = test_mixing.plain(staged[3].collect(), mixing.Target(repeats=2.0))
    drawn = Counter(r["doc_id"] for r in staged[4].collect())
    assert drawn == Counter({i: copies for i, _, _, copies, _ in expected}) and set(drawn.values()) <= {1, 2}


def test_ids_are_those_of_the_library(staged):
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    expected = []
    for r in staged[4].collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        expected.append((r["doc_id"], len(ids), np.array(ids, "<u4").tobytes()))
    found = [(r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in staged[5].collect()]
    assert sorted(found) == sorted(expected)


def test_run_is_all_stages(spark, sf_dir, staged):
    assert rows(corpus_pipeline.run(spark, sf_dir), "doc_id", "n_tokens") == rows(staged[-1], "doc_id", "n_tokens")


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    for docs, name in ((odd_docs, "odd"), (no_docs, "none")):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r["doc_id"] for r in found} <= {None, 4, 6, 8, 9, 10}
        assert (not found) == (name == "none")


def test_further_columns_stay(spark, odd_docs, sf_dir):
    from tests.llm.conftest import with_clashes

    names = ("score", "margin", "rejected", "copies", "weight", "n_tokens", "tid", "fp", "key", "a.b", "shard")
    docs = with_clashes(odd_docs, *names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns, name
        kept = found.collect()
        assert kept and all(tuple(r)[5:] == ("clash",) * len(names) for r in kept)
