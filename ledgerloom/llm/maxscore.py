"""Exact top-k search by inner product with MaxScore.

A vector's dimensions are the terms of a query. Over a shard of candidates each term has a bound: the most that it
can add to a score. Terms are ordered by bound; the essential ones are those without which a candidate can't reach
the floor, the k-th score known so far: the others' bounds sum to less than it. Essential postings are traversed, by
which the floor rises and further terms stop being essential; the other terms are probed for candidates that can still
compete, and the shards' results are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Terms that are taken together.
STEP = 8


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, q (array of long): floor(scale * x). Rows null or with null or non-finite components are left out.

    A component that is no long after scaling is an error.
    """
    x = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    x = x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    whole = lambda v: F.when(F.abs(v * scale) < float(2**63), F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component is too large for a long")).cast("long"))
    return x.select("vec_id", F.transform("x", whole).alias("q"))


def _exact(*parts: np.ndarray) -> type:
    """The fastest type in which every partial sum is exact; object: Python's integers."""
    worst = float(parts[0].shape[1]) * float(np.prod([float(max(-int(p.min(initial=0)), int(p.max(initial=0)))) for p in parts]))
    return np.float32 if worst < 2**24 else np.float64 if worst < 2**53 else np.int64 if worst < 2**62 else object


def best_of_shard(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query within a shard; ties to the smaller id."""
    order = np.argsort(x_ids, kind="stable")
    kind = _exact(q, x)
    x, x_ids = x[order].astype(kind), x_ids[order]
    postings = np.ascontiguousarray(x.T)
    most, least = postings.max(axis=1), postings.min(axis=1)
    out = []
    for query, own in zip(q.astype(kind), q_ids, strict=True):
        alive = np.flatnonzero(x_ids != own)
        if not len(alive):
            continue
        bounds = np.maximum(query * most, query * least)
        terms = np.argsort(-bounds, kind="stable")
        rest = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0 * bounds[0])  # what the terms from here on can add at most

        def floor_of(lead: np.ndarray, known: object = None, query: np.ndarray = query) -> object:
            """The k-th score so far, from the full scores of ``lead``; None: fewer candidates than k are known."""
            if len(lead) < k:
                return known
            full = np.sort(x[lead] @ query)[len(lead) - k]
            return full if known is None else max(known, full)

        floor_ = floor_of(alive[: 4 * k])
        essential = len(terms) if floor_ is None else int(np.argmax(rest < floor_)) if (rest < floor_).any() else len(terms)
        score, at = np.zeros(len(x_ids), kind), 0
        while at < essential:  # traverse the postings of essential terms
            some = terms[at : min(at + STEP, essential)]
            score += query[some] @ postings[some]
            at += len(some)
            alive = alive if floor_ is None else alive[score[alive] + rest[at] >= floor_]
            lead = alive if len(alive) <= 4 * k else alive[np.argpartition(-score[alive], 4 * k)[: 4 * k]]
            floor_ = floor_of(lead, floor_)
            if floor_ is not None and (rest < floor_).any():
                essential = min(essential, max(at, int(np.argmax(rest < floor_))))
        while at < len(terms):  # probe the others for candidates that can still compete
            if floor_ is not None:
                alive = alive[score[alive] + rest[at] >= floor_]
            some = terms[at : at + STEP]
            score[alive] += query[some] @ postings[np.ix_(some, alive)]
            at += len(some)
        top = np.lexsort((alive, -score[alive]))[:k]  # places follow ids
        out.extend((int(own), int(x_ids[i]), int(score[i])) for i in alive[top])
    return out


def grid(candidates: int, queries: int, shard_rows: int, block_rows: int, cells: int = 32) -> tuple[int, int]:
    """Shards of candidates and blocks of queries: as few as the rows allow, but enough cells to keep a cluster busy."""
    shards, blocks = -(-candidates // shard_rows) or 1, -(-queries // block_rows) or 1
    while shards * blocks < cells and candidates > 2048 * shards:
        shards *= 2
    return shards, blocks


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, shard_rows: int = 32_768, block_rows: int = 8192) -> DataFrame:
    """query_id, rank (int from 1), vec_id, score: the k best of ``vectors`` for each query, but for its own id.

    Both: vec_id, q of one length (others take no part with each other). Every candidate shard meets every block of
    queries; both are dealt by a hash of the row, so only rows that are equal in id and vector go to one task together. A row is copied once for each shard or
    block it meets, which is what comparing a share of all rows with all rows needs. Repeated candidates each count;
    repeated queries count once; queries of one id share a list. Fewer candidates than k give shorter lists; empty
    tables give no rows. A score that is no long is an error: of one row with huge finite components, too. Vectors of any
    length are whole; a shard's memory grows with their length times ``shard_rows``, which long ones want smaller.
    """
    shards, blocks = grid(vectors.count(), queries.count(), shard_rows, block_rows)
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "q"), F.lit(n)).cast("int")
    left = queries.dropDuplicates(["vec_id", "q"]).select("vec_id", "q", spread(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("q").alias("width"))
    right = vectors.select("vec_id", "q", spread(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.size("q").alias("width"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = best_of_shard(np.stack(a.q.to_numpy()), a.vec_id.to_numpy(), np.stack(b.q.to_numpy()), b.vec_id.to_numpy(), k) if len(a) and len(b) and a.width.iat[0] else []
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")  # OverflowError beyond a long

    cell = ["shard", "block", "width"]
    found = left.groupBy(cell).cogroup(right.groupBy(cell)).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
