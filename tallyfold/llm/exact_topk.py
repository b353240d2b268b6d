"""Exact top-k search by inner product with a KD-tree per shard.

Trees are split at medians of the widest dimension and keep the tight box of every node. A box bounds the
inner product of a query with any of its points, so nodes are opened best bound first, and a search ends
when no open bound reaches the kth score. That kth score starts at what a first shard gave and goes on from
tree to tree within a task.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.session import materialise
from tallyfold.llm.vectors import as_matrix, best, by_length, search_blocks, shards, usable

SCALE, LEAF = 1024, 128

#: Queries whose bounds are held at a time.
BOUNDED = 4096

Found = tuple[np.ndarray, np.ndarray]

#: Products of vectors whose terms add up to less than this are exact in doubles. Where they may not be, scores are
#: Python's whole numbers; both ways give the same.
EXACT = 1 << 53

#: A score that a long can't hold is kept apart, raised by this and written as so many bytes, which sort as it does.
RAISED, BYTES = 1 << 2175, 273

#: Components of this size and more have no double 1024 times as large.
MOST = "1.7e305D"


class Tree:
    """A KD-tree over the rows of an integer-valued matrix."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        low, high, spans, children = [], [], [], []
        stack = [(0, len(ids), -1)]
        while stack:
            start, end, parent = stack.pop()
            node, part = len(spans), points[order[start:end]]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            spans.append((start, end))
            children.append([])
            if parent >= 0:
                children[parent].append(node)
            widest = int(np.argmax(high[-1] - low[-1]))
            if end - start > LEAF and high[-1][widest] > low[-1][widest]:
                middle = (end - start) // 2
                split = np.argpartition(part[:, widest], middle)
                order[start:end] = order[start:end][split]
                stack += [(start, start + middle, node), (start + middle, end, node)]
        self.ids, self.points = ids[order], points[order]
        self.low, self.high, self.spans, self.children = np.array(low), np.array(high), spans, children
        self.largest = float(np.abs(points).max(initial=0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, no point of the node has a larger inner product."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: Any, exact: bool) -> Found:
        """ids and scores (whole numbers) of the k best rows but those with id own, of those that reach floor.

        Bounds are doubles, off by some last places of the largest sum of terms there can be; so much is added.
        """
        whole = query if exact else _whole(query)
        terms = float(np.abs(query).max(initial=0)) * self.largest * len(query)
        slack = 0.0 if exact else terms * len(query) * 2.0**-50
        ids, scores = np.empty(0, np.int64), np.empty(0, float if exact else object)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound + slack < floor:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] + slack >= floor:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            start, end = self.spans[node]
            points = self.points[start:end] if exact else _whole(self.points[start:end])
            got = points @ whole
            keep = (got >= floor).astype(bool) & (self.ids[start:end] != own)
            if keep.any():
                ids, scores = np.concatenate((ids, self.ids[start:end][keep])), np.concatenate((scores, got[keep]))
                if len(ids) >= k:
                    ids, scores = _top(ids, scores, k)
                    floor = max(floor, scores[-1])
        return ids, scores


_whole = np.frompyfunc(int, 1, 1)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> Found:
    """The k highest scores, ties to the smaller id, best first."""
    if scores.dtype == object:
        first = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)
    else:
        first = best(ids, scores, k)
    return ids[first], scores[first]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, vectors in shards(batches):
        tree = pickle.dumps(Tree(ids, np.floor(vectors * SCALE)), protocol=5)
        yield pa.RecordBatch.from_arrays([pa.array([tree], pa.binary())], ["tree"])


def _search(tree: Tree, state: dict[int, Found], sent: dict, k: int) -> None:
    """Search one tree for all queries of a block; state has what each query has found so far."""
    queries, ids = sent["queries"], sent["ids"]
    for at in range(0, len(ids), BOUNDED):
        block = queries[at : at + BOUNDED]
        bounds = np.nan_to_num(tree.bounds(block), nan=np.inf, posinf=np.inf, neginf=-np.inf)
        terms = np.abs(block).sum(axis=1) * tree.largest
        for i in range(len(block)):
            q = at + i
            had, floor = state.get(q), sent["floor"][q]
            if had and len(had[0]) >= k:
                floor = max(floor, had[1][-1])
            got = tree.search(ids[q], block[i], bounds[i], k, floor, bool(terms[i] < EXACT))
            if len(got[0]) and had:
                if got[1].dtype != had[1].dtype:  # doubles that are whole numbers
                    got, had = ((x[0], x[1] if x[1].dtype == object else _whole(x[1])) for x in (got, had))
                got = _top(np.concatenate((had[0], got[0])), np.concatenate((had[1], got[1])), k)
            if len(got[0]):
                state[q] = got


_FOUND = "query int, query_id long, vec_id long, score long, beyond binary"


def _found_batch(state: dict[int, Found], ids: np.ndarray) -> pa.RecordBatch:
    """Rows of _FOUND; beyond orders the scores at the ends of a long."""
    places = sorted(state)
    lengths = [len(state[q][0]) for q in places]
    scores, beyond = [], []
    for q in places:
        for x in map(int, state[q][1]):
            scores.append(min(max(x, -(2**63)), 2**63 - 1))
            beyond.append((x + RAISED).to_bytes(BYTES, "big") if x != scores[-1] or x in (-(2**63), 2**63 - 1) else None)
    columns = [
        pa.array(np.repeat(np.array(places, np.int32), lengths)), pa.array(np.repeat(ids[places], lengths) if places else [], pa.int64()),
        pa.array(np.concatenate([state[q][0] for q in places]) if places else [], pa.int64()), pa.array(scores, pa.int64()),
        pa.array(beyond, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _FOUND.split(", ")])


def _with_floors(queries: DataFrame, pilot: bytes, k: int) -> DataFrame:
    """queries with floor: the kth score that each has in a first tree, from which all the others go on.

    Searched in the tasks that hold the queries; the tree has vectors.SHARD_ROWS rows at most.
    """
    sent = queries.sparkSession.sparkContext.broadcast(pilot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = pickle.loads(sent.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, points = batch.column("vec_id").to_numpy(zero_copy_only=False), np.floor(as_matrix(batch.column("embedding")) * SCALE)
            state: dict[int, Found] = {}
            _search(tree, state, {"ids": ids, "queries": points, "floor": np.full(len(ids), -np.inf)}, k)
            floor = np.full(len(ids), -np.inf)
            for q, (_, scores) in state.items():
                if len(scores) >= k and abs(scores[-1]) < EXACT:
                    floor[q] = float(scores[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], ["vec_id", "embedding", "floor"])

    return queries.mapInArrow(run, "vec_id long, embedding array<double>, floor double")


def exact_top_k(table: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): each query's k highest inner products in table.

    Components x of table (vec_id, embedding) and queries (the same columns) are taken as floor(1024 * x);
    products are whole numbers from end to end, and a score that a long can't hold is ranked as it is and returned
    as the end of a long. Ties go to the smaller vec_id; rows with the query's own vec_id are no candidates; fewer
    candidates than k are all returned. Rows that usable() leaves out take no part (nor do components from 1.7e305
    on); vectors of each length are searched among their own. Rows with one vec_id and different vectors are
    candidates and queries each; repeated query rows count once. An empty table or query set gives an empty result.
    """
    return by_length(
        usable(table, most=MOST), usable(queries, most=MOST), partial(_one_length, k=k),
        "query_id long, rank int, vec_id long, score long",
    )


def _one_length(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    index = materialise(rows.mapInArrow(_trees, "tree binary"), "trees")
    pilot = index.limit(1).collect()[0]["tree"]

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value | {"queries": np.floor(sent.value["queries"] * SCALE)}
            state: dict[int, Found] = {}
            for batch in batches:
                for tree in batch.column("tree"):
                    _search(pickle.loads(tree.as_py()), state, block, k)
            yield _found_batch(state, block["ids"])

        return run

    wanted = _with_floors(queries.distinct(), bytes(pilot), k)
    order = [F.desc("score"), F.desc_nulls_last("beyond"), F.asc("vec_id")]
    return search_blocks(index, wanted, k, search, _FOUND, order)
