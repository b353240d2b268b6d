import random
from itertools import combinations

import pytest
import xxhash

from tallyfold.llm import simhash, text
from tests.llm.conftest import prose, rows, with_clashes


def plain_fingerprint(value):
    words = (value or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints):
    least = {}
    for a, b in combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= 2:
            least.setdefault(a, set()).add(b)
            least.setdefault(b, set()).add(a)
    seen, groups = set(), []
    for p in set(prints):
        todo, group = [p], set()
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += least.get(x, ())
        if p not in seen:
            groups.append(group)
            seen |= group
    return groups


def check(docs):
    source = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in source]
    of = {}
    for group in plain_groups(prints):
        ids = [r["doc_id"] for r, p in zip(source, prints, strict=True) if p in group and r["doc_id"] is not None]
        of |= dict.fromkeys(group, min(ids, default=None))
    expected = sorted(((r["doc_id"], f"{p:016x}", of[p]) for r, p in zip(source, prints, strict=True)), key=repr)
    assert rows(simhash.near_duplicates(docs)) == expected


def test_spark_s_hash_is_the_same(spark):
    found = spark.sql("SELECT xxhash64('one two three') AS h").first()["h"]
    assert found % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_against_all_pairs(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_near_copies(make_docs):
    rnd, docs = random.Random(5), []
    for g in range(12):
        words = prose(g, 300).split()
        for _ in range(6):
            words = list(words)
            words[rnd.randrange(300)] = "new"
            docs.append((len(docs), " ".join(words)))
    df = make_docs(*docs)
    check(df)
    assert len({r["component_id"] for r in simhash.near_duplicates(df).collect()}) < 60


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    check(with_clashes(odd_docs, "fp", "component", "code", "component_id"))
    assert simhash.near_duplicates(no_docs).collect() == []


def test_links_of_distance_two_and_no_more(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 1 << 3, base ^ 1 << 3 ^ 1 << 60, base ^ 7 << 20, base ^ (1 << 5) ^ (1 << 6)]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    linked = {frozenset((r["a"], r["b"])) for r in simhash.links(df).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, linked))
    assert not any(prints[3] in pair for pair in linked)


def test_long_texts_go_by_in_blocks(monkeypatch):
    value = prose(9, 500)
    whole = simhash.fingerprint(value)
    monkeypatch.setattr(text, "BLOCK", 7)
    monkeypatch.setattr(text.blocks, "__defaults__", (7,))
    assert list(text.blocks("ab cd  efghijklmn o", 3)) and "".join(text.blocks(value, 7)) == value
    assert simhash.fingerprint(value) == whole


def test_one_of_each_group_stays(make_docs, odd_docs):
    same = prose(1, 100)
    df = make_docs((3, same), (1, same), (2, prose(2, 100)), (None, same), (1, same), (None, prose(3, 50)), (None, prose(3, 50)))
    kept = [tuple(r)[:2] for r in simhash.keep_one(df).collect()]
    assert sorted(kept, key=repr) == sorted([(1, same), (2, prose(2, 100)), (None, prose(3, 50))], key=repr)
    assert simhash.keep_one(odd_docs).columns == odd_docs.columns


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
@pytest.mark.parametrize("hot", [64, 1])
def test_links_against_all_pairs(spark, radius, hot):
    """Connected as over all pairs, with every link in reach; hot=1 searches all shared words in the rest."""
    rnd, prints = random.Random(radius), set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(12):
            prints.add(base)
            for bit in rnd.sample(range(64), rnd.randint(1, 5)):
                base ^= 1 << bit
    prints |= {0, 1 << 63, (1 << 64) - 1, 0xFFFFFFFF, 0xFFFFFFFF << 32}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius, hot).collect()
    assert all(r["a"] < r["b"] and ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= radius for r in found)
    assert classes(signed, [(r["a"], r["b"]) for r in found]) == classes(
        signed, [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    )


def classes(nodes, pairs):
    of = {n: {n} for n in nodes}
    for a, b in pairs:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for n in of[b]:
                of[n] = of[a]
    return {frozenset(x) for x in of.values()}


def test_what_the_tables_hold_is_verified(spark):
    """Fingerprints that agree in half of their bits meet in a table and are told apart by the complete distance."""
    prints = [0x11223344_00000000 + x for x in (0, 0xFF, 0xFFFF, 3)]
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 2).collect()
    assert [(r["a"], r["b"]) for r in found] == [(prints[0], prints[3])]


@pytest.mark.parametrize("radius", range(9))
def test_segments_cover_every_distance(radius):
    cut = simhash.segments(radius)
    assert sum(w for _, w, _ in cut) == 64 and sum(r + 1 for *_, r in cut) == radius + 1


def test_a_word_of_very_many_fingerprints_gives_as_many_links(spark):
    prints = [0x11223344_00000000 + (i * 2654435761) % 2**32 for i in range(3000)]
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 2)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and found.count() < 3000
