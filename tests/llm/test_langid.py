import random
import zlib

import pytest
import zstandard

from tallyfold.llm import langid
from tests.llm.conftest import prose, rows, with_clashes

LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}


def speech(seed, n, letters):
    """n words from the thirty that a language of these letters has."""
    words, rnd = prose(99, 30, letters).split(), random.Random(seed)
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(make_docs):
    docs = []
    for language, letters in LETTERS.items():
        for i in range(60):
            wrong = language == "aa" and i % 12 == 0
            docs.append((len(docs), speech(len(docs), 5 + i, LETTERS["bb"] if wrong else letters), language, "s"))
    return make_docs(*docs)


def test_languages(labelled):
    found = langid.languages(labelled).collect()
    lang = {r["doc_id"]: r for r in labelled.collect()}
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        letters = set(lang[r["doc_id"]]["text"].replace(" ", ""))
        assert letters <= set(LETTERS[r["lang_pred"]]) and not r["rejected"]


def test_held_out_accuracy_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.9 * len(found)


def test_wrong_labels_are_left_out_of_dictionaries():
    samples = {k: [speech(i, 60, v) for i in range(20)] for k, v in LETTERS.items()}
    samples["aa"][3] = speech(50, 60, LETTERS["bb"])
    assert not set("fghij") & set(langid.build_dictionaries(samples)["aa"].decode())


def test_labels_and_ids_aren_t_inputs(labelled):
    learned = langid.learn(labelled)
    plain = rows(langid.identify(labelled, learned), "doc_id", "lang_pred", "score")
    from pyspark.sql import functions as F

    hidden = labelled.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x"))
    assert rows(langid.identify(hidden, learned), "doc_id", "lang_pred", "score") == plain


def test_odd_rows(odd_docs, no_docs, make_docs):
    found = {r["doc_id"]: r for r in langid.languages(with_clashes(odd_docs, "score", "margin", "lang_pred")).collect()}
    for i in (1, 2, 3, 7):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert {found[i]["lang_pred"] for i in (4, 6, 8, 9, 10)} <= {"en", "de", "fr"}
    assert langid.languages(odd_docs).count() == odd_docs.count()
    assert langid.languages(no_docs).collect() == []
    alone = langid.languages(make_docs((1, "some words", None), (2, "more", None))).collect()
    assert {r["lang_pred"] for r in alone} == {"und"}


def test_ties_are_rejected():
    judge = langid.Classifier({"a": b"same words here", "b": b"same words here"})
    assert judge.classify("same words")[0::2] == ("a", 0.0)


def test_kept_columns(odd_docs):
    found = langid.identify(with_clashes(odd_docs, "margin", "extra"), {"x": b"text"})
    assert found.columns == [*odd_docs.columns, "extra", "lang_pred", "score", "margin", "rejected"]


def test_against_a_plain_loop(spark, sf_dir):
    """Every block of every text compressed anew with every dictionary."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = langid.learn(docs)
    assert all(len(d) <= langid.DICTIONARY_BYTES for d in dictionaries.values())

    def size(data, content):
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        plain = zstandard.ZstdCompressor(dict_data=made, level=6, write_content_size=False, write_checksum=False, write_dict_id=False)
        start = content[: langid.CARRIER_BYTES] + b" "
        blocks = [data[i : i + langid.BLOCK_BYTES] for i in range(0, len(data), langid.BLOCK_BYTES)]
        return sum(len(plain.compress(start + b)) - len(plain.compress(start)) for b in blocks)

    found = {r["doc_id"]: r for r in langid.languages(docs).collect()}
    for r in docs.where("doc_id % 4 = 0").collect():
        sizes = {name: size(r["text"].lower().encode(), content) for name, content in sorted(dictionaries.items())}
        least, second = sorted(sizes.values())[:2]
        got = found[r["doc_id"]]
        assert got["lang_pred"] == min(sizes, key=sizes.get)
        assert got["rejected"] == ((second - least) / max(1, second) < langid.MARGIN)
