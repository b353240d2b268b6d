"""SimHash near-duplicates: multi-index hashing over distinct fingerprints.

A fingerprint is cut into segments, and each segment has a table of all fingerprints by their word there. Two
fingerprints at a few differing bits agree in one segment or differ there in very few bits; so every fingerprint
enumerates the small Hamming ball about its word in each segment, fetches what the tables have there, and verifies
the complete distance. Copies are one fingerprint, and words that very many fingerprints have are searched further
in the other segments, so work doesn't grow with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.components import components
from tallyfold.llm.session import bounded_batches, dealt_join, materialise, small
from tallyfold.llm.text import word_blocks

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 2

#: Distinct fingerprints that have one word of a segment up to which each of them fetches all the others.
HOT = 64


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the least significant one."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text, unsigned; zero if it has no word.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Long texts go by in blocks, so
    memory doesn't grow with them.
    """
    votes, total, last = np.zeros(BITS, np.int64), 0, []
    for block in word_blocks(text or ""):
        words = last + block
        n = len(words) - SHINGLE + 1
        if n > 0:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
            votes += _votes(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))
            total += n
        last = words[max(0, n) :]
    if not total and last:
        votes, total = _votes(np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], np.uint64)), 1
    return sum(1 << i for i in np.nonzero(2 * votes > total)[0].tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        columns = [batch.column("doc_id"), batch.column("tid"), pa.array(found.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tid", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tid (a hash of the text) and fp (the fingerprint as a signed long) of every row."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tid"))
    return narrow.mapInArrow(_fingerprints, "doc_id long, tid long, fp long")


def segments(radius: int) -> list[tuple[int, int, int]]:
    """Start, width and ball radius of each segment of a fingerprint.

    The radii of m segments add up to radius - m + 1. So of two fingerprints at most radius bits apart one segment
    at least differs in no more bits than its own radius: else they were m bits more apart than that sum.
    """
    m = min(max(2, (radius + 2) // 2), radius + 1)
    cuts = [BITS * i // m for i in range(m + 1)]
    more = radius - m + 1
    return [(cuts[i], cuts[i + 1] - cuts[i], more // m + (i < more % m)) for i in range(m)]


def ball(bits: list[int], radius: int) -> list[int]:
    """Masks, as signed longs, that flip at most radius of some bits (by their places)."""
    masks = [sum(1 << b for b in flipped) for n in range(radius + 1) for flipped in combinations(bits, n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _mask(start: int, width: int) -> int:
    """The bits of a segment, as a signed long."""
    mask = (1 << width) - 1 << start
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _flipped(rows: DataFrame, column: str, masks: list[int], to: str) -> DataFrame:
    """rows without column, once for each mask, with ``to``, the column flipped by it, and ``off``, how many bits that are."""
    each = rows.select("*", F.explode(_longs(masks)).alias("_mask"))
    flipped = F.col(column).bitwiseXOR(F.col("_mask"))
    return each.select(*[c for c in rows.columns if c != column], flipped.alias(to), F.bit_count("_mask").alias("off"))


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (fp) at most radius bits apart, directly or in steps.

    Each segment has a table of words; every fingerprint looks up the small ball about its own word, and what it
    fetches is held against its complete distance. A word that more than hot fingerprints have would be fetched
    hot times over by each of them; there the search goes on in the rest of the fingerprint, and those that meet
    are linked with the least of them, which is in reach of all: work grows with their number, not its square.
    Balls are never broadcast: Spark, which doesn't count what explode() makes, would take them for as few rows as there
    are fingerprints.
    """
    tables, probes = [], []
    for i, (start, width, reach) in enumerate(segments(radius)):
        own = F.col("fp").bitwiseAND(F.lit(_mask(start, width)))
        tables.append(distinct.select(F.lit(i).alias("segment"), own.alias("word"), "fp"))
        masks = ball(list(range(start, start + width)), reach)
        probes.append(_flipped(distinct.select(F.lit(i).alias("segment"), "fp", own.alias("own")), "own", masks, "word"))
    keys = ["segment", "word"]
    table, probe = reduce(DataFrame.unionByName, tables), reduce(DataFrame.unionByName, probes)
    often = materialise(table.groupBy(*keys).count().where(F.col("count") > hot).select(*keys), "words")
    if often.isEmpty():
        cold_table, cold_probe = table, probe
    else:
        many = small(often)
        cold_table, cold_probe = (t.join(many, keys, "left_anti") for t in (table, probe))
    fetched = cold_probe.hint("merge").join(cold_table.withColumnRenamed("fp", "other"), keys)
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    found = fetched.where(near & (F.col("fp") != F.col("other")))
    found = found.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    if not often.isEmpty():
        found = found.unionByName(_hot_links(table.join(many, keys), probe.join(many, keys), radius))
    return found.distinct()


def _hot_links(table: DataFrame, probe: DataFrame, radius: int) -> DataFrame:
    """Links of fingerprints under very common words, found in the rest of the fingerprint.

    Members of a word are entered under all codes of a ball about their rest, a fingerprint that looks the word up
    looks for a ball as wide as its distance from the word leaves, and both meet at a code.
    """
    wide, found = radius // 2, []
    for i, (start, width, reach) in enumerate(segments(radius)):
        rest = [b for b in range(BITS) if not start <= b < start + width]
        own = F.col("fp").bitwiseAND(F.lit(~_mask(start, width)))
        entered = table.where(F.col("segment") == i).select("word", "fp", own.alias("rest"))
        entered = _flipped(entered, "rest", ball(rest, wide), "code")
        least = entered.groupBy("word", "code").agg(F.min("fp").alias("other"))
        for off in range(reach + 1):
            left = radius - off - wide
            if left < 0:
                continue
            asked = probe.where((F.col("segment") == i) & (F.col("off") == off)).select("word", "fp", own.alias("rest"))
            asked = _flipped(asked, "rest", ball(rest, left), "code")
            found.append(asked.hint("merge").join(least, ["word", "code"]).where("fp <> other").select("fp", "other"))
    met = reduce(DataFrame.unionByName, found)
    return met.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, tid, fp and component_id of every row of docs (doc_id, text)."""
    prints = materialise(fingerprints(docs), "fingerprints")
    size = prints.count()
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(groups.select("fp")), size)
    nodes = materialise(
        groups.hint("merge").join(found.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("component")),
        "groups",
        size,
    )
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = dealt_join(nodes, least, "component").select("fp", "component_id")
    return dealt_join(prints, ids, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links of fingerprints reach. Null and empty texts have
    fingerprint zero and are linked like any other. Repeated rows are returned each; a null doc_id takes
    its group's component_id (null if the whole group has none). Extra columns are ignored.
    """
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return grouped(docs).select("doc_id", shown, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) without the rows that near_duplicates() puts behind another one, as one_of_each()."""
    return one_of_each(docs, grouped(docs))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with one row of each group; groups has doc_id, tid and component_id (the group's least doc_id) of each row.

    Of each group the row with the least doc_id stays, once if it is repeated; of a group with no id, one
    row for each text. Rows are told apart by doc_id and a hash of the text.
    """
    groups = materialise(groups.select("doc_id", "tid", "component_id"), "components")
    size = groups.count()
    keys = (F.col("doc_id").alias("_tf_id"), F.col("tid").alias("_tf_tid"))
    behind = groups.where("not doc_id <=> component_id").select(*keys).distinct()
    often = groups.groupBy(*keys).count().where("count > 1").select("_tf_id", "_tf_tid")
    behind, often = (small(materialise(t, "ids", size)) for t in (behind, often))
    same = F.col("doc_id").eqNullSafe(F.col("_tf_id")) & (F.xxhash64("text") == F.col("_tf_tid"))
    rest = docs.join(behind, same, "left_anti")
    once = rest.join(often, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(often, same, "left_anti").unionByName(once)
