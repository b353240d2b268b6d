"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one from each codebook. Codebooks are fitted one
after the other to the residuals of a bounded sample; every row is then coded by a beam search over all of
them. A query's inner products with all codewords make lookup tables, from which every coded row is scored,
corrected by the stored norms of the row and of its code; each shard's best are scored again exactly.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.session import materialise
from tallyfold.llm.vectors import SHARD_ROWS, best, by_length, search_blocks, shards, usable

#: Codebooks at least and at most (one for each 16 dimensions between), codewords in each, and partial codes that
#: the beam search keeps.
BOOKS, MOST_BOOKS, WORDS, BEAM = 8, 16, 256, 4

#: Codebooks are fitted to at most so many rows, those whose hashed ids are least.
SAMPLE_ROWS, FIT_ROUNDS, SEED = 8192, 6, 7

#: Rows of each shard (of vectors.SHARD_ROWS at most) that are scored exactly for every query, at least. Codes tell
#: little of vectors without structure, so how many they must be is measured on a quarter of the sample that the
#: codebooks aren't fitted to: as many as have this share of the nearest among them.
RERANK, RERANK_SHARE, TRIALS, NEAREST = 256, 0.95, 96, 5

_RESULT = "query_id long, rank int, vec_id long, score double"
_FOUND = "query int, query_id long, vec_id long, score double"


def fit_codebooks(sample: np.ndarray, books: int = BOOKS, words: int = WORDS) -> np.ndarray:
    """Codebooks (books, words, dimension), each by k-means over what the ones before leave of the sample."""
    rng, rest, found = np.random.default_rng(SEED), sample.astype(np.float32), []
    for _ in range(books):
        centres = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(FIT_ROUNDS):
            near = np.argmin((centres**2).sum(1) - 2 * rest @ centres.T, axis=1)
            count = np.bincount(near, minlength=words)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rest)
            full = count > 0
            centres[full] = sums[full] / count[full, None]
            centres[~full] = rest[rng.choice(len(rest), int((~full).sum()))]
        near = np.argmin((centres**2).sum(1) - 2 * rest @ centres.T, axis=1)
        rest = rest - centres[near]
        found.append(centres)
    return np.array(found)


def n_books(d: int) -> int:
    return min(MOST_BOOKS, max(BOOKS, d // 16))


def encode(vectors: np.ndarray, books: np.ndarray, beam: int = BEAM, block: int = 512) -> np.ndarray:
    """Codes (rows, books) of the nearest sums of codewords that a beam search finds.

    Keeps the beam's best partial sums; their distances follow from products of codewords with the vector
    and with each other, so residuals are never formed.
    """
    m, words, d = books.shape
    flat = books.reshape(m * words, d)
    among = flat @ flat.T
    squares = np.diag(among)
    out = np.empty((len(vectors), m), np.uint16)
    for at in range(0, len(vectors), block):
        x = vectors[at : at + block].astype(np.float32)
        with_words = x @ flat.T
        n = len(x)
        cost = np.zeros((n, 1), np.float32)
        cross = np.zeros((n, 1, m * words), np.float32)  # products of the partial sum with every codeword
        codes = np.zeros((n, 1, 0), np.int64)
        for i in range(m):
            own = slice(i * words, (i + 1) * words)
            step = squares[own] - 2 * with_words[:, None, own] + 2 * cross[:, :, own]
            total = (cost[:, :, None] + step).reshape(n, -1)
            keep = min(beam, total.shape[1])
            top = np.argpartition(total, keep - 1, axis=1)[:, :keep]
            cost = np.take_along_axis(total, top, 1)
            parent, word = top // words, top % words
            rows = np.arange(n)[:, None]
            codes = np.concatenate((codes[rows, parent], word[:, :, None]), axis=2)
            if i + 1 < m:
                cross = cross[rows, parent] + among[i * words + word]
        out[at : at + block] = codes[np.arange(n), np.argmin(cost, axis=1)]
    return out


def _reconstruct(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[i][codes[:, i]] for i in range(len(books)))


def lookup_scores(queries: np.ndarray, codes: np.ndarray, scale: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Estimated inner products (queries, rows) from lookup tables; scale is norm over norm of the code."""
    total = np.zeros((len(queries), len(codes)), np.float32)
    for i, book in enumerate(books):
        total += np.take(queries @ book.T, codes[:, i], axis=1)
    return total * scale


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products with a query, each summed in one order whatever the row's place: equal rows score alike."""
    return np.multiply(rows, query, order="C").sum(axis=1)


def calibrate(rest: np.ndarray, books: np.ndarray) -> int:
    """How many rows of a full shard are to be scored exactly, from rows that books weren't fitted to.

    Of trial queries among them, how far down the estimates the nearest rows stand, as a share of all rows.
    """
    if len(rest) < 4 * NEAREST:
        return RERANK
    codes = encode(rest, books)
    scale = np.linalg.norm(rest, axis=1) / np.maximum(np.linalg.norm(_reconstruct(codes, books), axis=1), 1e-12)
    depths = []
    for q in range(0, len(rest), max(1, len(rest) // TRIALS)):
        guess = lookup_scores(rest[q : q + 1].astype(np.float32), codes, scale.astype(np.float32), books)[0]
        score = rest @ rest[q]
        guess[q] = score[q] = -np.inf
        place = np.empty(len(rest), int)
        place[np.argsort(-guess, kind="stable")] = np.arange(len(rest))
        depths += place[np.argsort(-score, kind="stable")[:NEAREST]].tolist()
    share = (np.quantile(depths, RERANK_SHARE) + 1) / len(rest)
    return max(RERANK, math.ceil(1.1 * share * SHARD_ROWS))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, vectors in shards(batches, SAMPLE_ROWS):
        held = len(vectors) // 4 if len(vectors) >= SAMPLE_ROWS // 2 else 0  # a smaller table is hardly more than RERANK
        books = fit_codebooks(vectors[held:], n_books(vectors.shape[1]))
        fitted = pickle.dumps((books, calibrate(vectors[:held], books)))
        yield pa.RecordBatch.from_arrays([pa.array([fitted], pa.binary())], ["books"])


def codebooks(rows: DataFrame) -> tuple[np.ndarray, int] | None:
    """Codebooks fitted in one task to at most SAMPLE_ROWS of rows, and calibrate()'s figure; None if there are no rows."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE_ROWS)
    fitted = sample.repartition(1).mapInArrow(_fit, "books binary").collect()
    return pickle.loads(fitted[0]["books"]) if fitted else None


def build_index(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """One row per shard: ids, codes, norms of rows and codes, and the original vectors, in ``shard``."""
    sent = rows.sparkSession.sparkContext.broadcast(books)  # a fixed number of codewords

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in shards(batches):
            codes = encode(vectors, sent.value)
            coded = np.linalg.norm(_reconstruct(codes, sent.value), axis=1)
            norms = np.linalg.norm(vectors, axis=1)
            shard = {"ids": ids, "codes": codes, "norms": norms, "coded": coded, "vectors": vectors}
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(shard, protocol=5)], pa.binary())], ["shard"])

    return materialise(rows.mapInArrow(run, "shard binary"), "index")


def _search_shard(shard: dict, state: dict[int, tuple], sent: dict, k: int, rerank: int) -> None:
    ids, queries = shard["ids"], sent["queries"]
    scale = (shard["norms"] / np.maximum(shard["coded"], 1e-12)).astype(np.float32)
    keep, largest = min(len(ids), rerank + 1), float(shard["norms"].max())
    for at in range(0, len(queries), 32):
        block = queries[at : at + 32]
        guess = lookup_scores(block.astype(np.float32), shard["codes"], scale, sent["books"])
        top = np.argpartition(-guess, keep - 1, axis=1)[:, :keep]
        for i, rows in enumerate(top):
            q = at + i
            rows = rows[ids[rows] != sent["ids"][q]]
            had = state.get(q, (np.empty(0, np.int64), np.empty(0)))
            rough = shard["vectors"][rows] @ block[i]
            if len(rows) > k:  # whatever rounding may bring among the k best stays
                slack = 1e-9 * float(np.linalg.norm(block[i])) * largest
                rows = rows[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack]
            exact = exact_scores(shard["vectors"][rows], block[i])
            both = np.concatenate((had[0], ids[rows])), np.concatenate((had[1], exact))
            first = best(*both, k)
            state[q] = both[0][first], both[1][first]


def _found_batch(state: dict[int, tuple], ids: np.ndarray) -> pa.RecordBatch:
    places = sorted(state)
    lengths = [len(state[q][0]) for q in places]
    none = np.empty(0)
    columns = [
        np.repeat(np.array(places, np.int32), lengths), np.repeat(ids[places].astype(np.int64), lengths),
        np.concatenate([none.astype(np.int64), *(state[q][0] for q in places)]), np.concatenate([none, *(state[q][1] for q in places)]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in _FOUND.split(", ")])


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, rerank: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: about the k largest inner products of each query in table.

    score is exact, in doubles over the original vectors and summed in one order, so equal vectors score alike; ties
    go to the smaller vec_id; rows with the query's own vec_id are no candidates; fewer candidates than k are all
    returned. Null, zero and non-finite vectors take no part; vectors of each length are searched among their own.
    Repeated query rows count once. An empty table or query set gives an empty result. Every row is coded and
    searched. rerank: rows of each shard that are scored exactly; as calibrate() finds, if it isn't given.
    """
    return by_length(
        usable(table, zero=False), usable(queries, zero=False), partial(_one_length, k=k, rerank=rerank), _RESULT
    )


def _one_length(rows: DataFrame, queries: DataFrame, k: int, rerank: int | None) -> DataFrame:
    fitted = codebooks(rows)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], _RESULT)
    books, found = fitted
    index, rerank = build_index(rows, books), max(k, rerank or found)

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict[int, tuple] = {}
            for batch in batches:
                for shard in batch.column("shard"):
                    _search_shard(pickle.loads(shard.as_py()), state, sent.value, k, rerank)
            yield _found_batch(state, sent.value["ids"])

        return run

    wanted = queries.distinct().withColumn("floor", F.lit(0.0))
    return search_blocks(index, wanted, k, search, _FOUND, [F.desc("score"), F.asc("vec_id")], {"books": books})
