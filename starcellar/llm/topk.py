"""Exact top-k by inner product: a cover tree over queries and one over candidates, searched together."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BLOCK = 4096  # candidates of a tree
QUERY_BLOCK = 4096  # queries of a tree
LEAF = 64
SHRINK = 1.3  # a level's covering radius by the next one's
EXACT = 2.0**53  # integers up to here are exact as doubles
NONE = np.iinfo(np.int64).min


class Node:
    """Points within ``radius`` of ``center``; either children or the members themselves."""

    __slots__ = ("center", "children", "length", "members", "radius")

    def __init__(self, points: np.ndarray, members: np.ndarray, center: int, children: list[Node]):
        self.center = points[center]
        self.length = float(np.sqrt(self.center @ self.center))
        self.radius = float(np.sqrt(_squares(points[members], self.center).max()))
        self.members = members
        self.children = children


def _squares(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    away = points - center
    return np.einsum("ij,ij->i", away, away)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree by levels: centers of a level lie further apart than its radius, which covers all members."""

    def build(members: np.ndarray, center: int, reach: float) -> Node:
        if len(members) <= leaf or reach == 0:
            return Node(points, members, center, [])
        away = np.sqrt(_squares(points[members], points[center]))
        if away.max() == 0:
            return Node(points, members, center, [])
        while reach >= away.max():  # levels with this center alone are one node
            reach /= SHRINK
        parts, rest, at = [], members, center
        while len(rest):
            near = np.sqrt(_squares(points[rest], points[at])) <= reach
            parts.append((rest[near], at))
            rest = rest[~near]
            at = rest[0] if len(rest) else at
        small = [p for p in parts if len(p[0]) <= leaf // 8]
        children = [build(part, at, reach / SHRINK) for part, at in parts if len(part) > leaf // 8]
        gathered: list[np.ndarray] = []
        for part, _ in small:  # points without near neighbours share leaves; the radius is taken from the members
            gathered.append(part)
            if sum(map(len, gathered)) >= leaf:
                children.append(Node(points, np.concatenate(gathered), gathered[0][0], []))
                gathered = []
        if gathered:
            children.append(Node(points, np.concatenate(gathered), gathered[0][0], []))
        return Node(points, members, center, children)

    every = np.arange(len(points))
    away = np.sqrt(_squares(points, points[0]))
    return build(every, 0, float(away.max()) * SHRINK)


def dual_search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray,
                k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (both queries x k, best first, ``NONE`` where fewer) of points with another id than the query."""
    exact = _exact_form(queries, points)
    best = np.full((len(queries), k), NONE, dtype=exact if exact is object else np.int64)
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max, dtype=np.int64)
    q_exact, p_exact = queries.astype(exact), points.astype(exact)
    q_tree, p_tree = cover_tree(queries.astype(np.float64)), cover_tree(points.astype(np.float64))

    def bound(q: Node, p: Node) -> float:
        top = float(q.center @ p.center) + q.length * p.radius + p.length * q.radius + q.radius * p.radius
        return top + abs(top) * 1e-9 + 1e-3  # covers the rounding of radii and lengths

    def leaves(q: Node, p: Node) -> None:
        scores = q_exact[q.members] @ p_exact[p.members].T
        scores = scores if exact is object else scores.astype(np.int64)
        own = query_ids[q.members][:, None] == ids[p.members][None, :]
        scores[own] = NONE
        all_scores = np.hstack([best[q.members], scores])
        all_ids = np.hstack([best_ids[q.members], np.where(own, np.iinfo(np.int64).max, ids[p.members][None, :])])
        falling = -(all_scores + 1) if exact is not object else -all_scores  # + 1: the smallest integer has no negative
        order = np.lexsort((all_ids, falling), axis=1)[:, :k] if exact is not object else np.array(
            [sorted(range(all_ids.shape[1]), key=lambda j, i=i: (falling[i, j], all_ids[i, j]))[:k]
             for i in range(len(all_ids))])
        best[q.members] = np.take_along_axis(all_scores, order, axis=1)
        best_ids[q.members] = np.take_along_axis(all_ids, order, axis=1)

    todo, serial = [(-bound(q_tree, p_tree), 0, q_tree, p_tree)], 1
    while todo:  # the pair with the highest bound first, so that the kth scores rise early
        negative, _, q, p = heapq.heappop(todo)
        if -negative < best[q.members, k - 1].min():
            continue
        if not q.children and not p.children:
            leaves(q, p)
            continue
        split_q = bool(q.children) and (not p.children or q.radius >= p.radius)
        for pair in ([(c, p) for c in q.children] if split_q else [(q, c) for c in p.children]):
            top = bound(*pair)
            if top >= best[pair[0].members, k - 1].min():
                heapq.heappush(todo, (-top, serial, *pair))
                serial += 1
    return best, best_ids


def _exact_form(queries: np.ndarray, points: np.ndarray) -> type:
    """Doubles while every product sum is exact in them, else integers of any size."""
    high = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(points.astype(np.float64)).max(initial=0))
    return np.float64 if high * max(1, points.shape[1]) < EXACT else object


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each id divisible by ``every`` the ``k`` highest inner products.

    Components become floor(scale * x).  Candidates are all rows with another id; equal scores go by the smaller id;
    with fewer candidates all are returned.  The search is exact: candidates and queries are dealt into blocks, each
    pair of blocks is one task with a cover tree on either side, and a pair of nodes is dropped when the inner
    product of their centers, raised by both covering radii, stays below the lowest kth score of the query node.  The
    results of the blocks meet in a ranking that keeps k rows of each query and task.

    Rows with a missing id or vector, or with a missing or non-finite component, take no part.  Vectors meet only
    vectors of their own length.  Rows repeated in id and vector count once; different vectors of one id are rows of
    their own and never meet each other.  Scores outside the range of long are clipped to it.  Other columns are not
    looked at.
    """
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
        .select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(embedding), scale).alias("vector")).distinct()
        .withColumns({"width": F.size("vector"), "query": F.xxhash64("vector")})
    )
    queries = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-rows.count() // BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    deal = lambda df, n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")
    candidates = rows.withColumn("block", deal(rows, blocks)).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = queries.withColumn("query_block", deal(queries, query_blocks)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["width", "block", "query_block"]

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        parts: Iterable[pd.DataFrame] = ()
        if len(q) and len(p):
            asked_vectors, vectors = (np.array(x["vector"].tolist(), dtype=np.int64).reshape(len(x), -1) for x in (q, p))
            scores, ids = dual_search(asked_vectors, q["id"].to_numpy(), vectors, p["id"].to_numpy(), k)
            hits = ids != np.iinfo(np.int64).max
            low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            parts = [pd.DataFrame({
                "query_id": q["id"].iloc[i], "query": q["query"].iloc[i],
                "vec_id": ids[i][hits[i]], "score": [max(low, min(high, int(s))) for s in scores[i][hits[i]]],
            }) for i in range(len(q)) if hits[i].any()]
        return pd.concat(parts) if parts else pd.DataFrame(
            {"query_id": [], "query": [], "vec_id": [], "score": []})

    found = asked.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(
        search, "query_id long, query long, vec_id long, score long")
    ranked = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
