"""Approximate nearest neighbours by inner product through a permutation index.

Vectors are indexed in shards of bounded size: rows of one vector length and one range of lengths |x| (powers of 4),
dealt by hash. A shard takes every EACHth of its vectors (by hash, at most PIVOTS) as pivots. So that nearness orders by
inner product, vectors carry one more component that makes all of a shard's equally long. Every vector is represented by
its POSTED nearest pivots in order and is posted, with the place, in those pivots' inverted files. A query reads the
files of its own nearest pivots only, ranks what they hold by footrule distance, and reranks the shard's part of the
SHORT best by exact inner product in double precision. With a pivot for every EACH vectors, a query reads as many
postings in a shard of any size. Queries are a stated set and meet all shards; they stream past a shard's files, so a
task holds one shard and a batch of queries.

Of equal vectors, the TOP + 1 smallest vec_ids are indexed: no query can have others among its nearest, so a vector
that a third of all rows repeat makes no large group and none is lost.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of another
length are searched among their own kind; a query with fewer candidates gets all; equal scores go to the smaller vec_id,
equal vectors have equal scores; a query's own row (its vec_id) is never its neighbour; a vec_id of several vectors is
searched and found once for each; rows that agree in vec_id and vector are one; a null vec_id takes no part; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import join_sized, shared_table

TOP, EVERY = 20, 20
#: Vectors in a shard; a pivot for so many of them, at most PIVOTS; pivots that a vector is posted to; vectors reranked
#: for a query in all shards of a range of lengths together.
SHARD, EACH, PIVOTS, POSTED, SHORT = 16_384, 8, 4_096, 96, 4_000
#: Rows whose distances to all pivots are held at once.
ROWS = 1_024


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, size, span): the rows that take part, their number of components and range of lengths."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "float" else "array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(finite & F.exists(v, lambda x: x != 0))
    most = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    rows = rows.select("vec_id", "v", F.size(v).alias("size"), most.alias("most"))
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most")))
    return rows.select("vec_id", "v", "size", F.floor(F.log2("most") / 2 + F.log2(squares) / 4 + 0.5).cast("int").alias("span"))


def indexed(rows: DataFrame) -> DataFrame:
    """Of equal vectors, the rows that can be found. Each task keeps its own first ones before the shuffle."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.distinct().withColumn("place", place).filter(F.col("place") <= TOP + 1).drop("place")


def nearest_pivots(x: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each row, nearest first."""
    out = np.empty((len(x), n), np.int16)
    for a in range(0, len(x), ROWS):
        near = x[a : a + ROWS] @ p.T
        some = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(p) else np.broadcast_to(np.arange(n), near.shape)
        order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
        out[a : a + ROWS] = np.take_along_axis(some, order, 1)
    return out


class Files:
    """The inverted files of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        scaled = self.x / np.abs(self.x).max()
        length = np.linalg.norm(scaled, axis=1)
        level = np.c_[scaled / length.max(), np.sqrt(np.maximum(0, 1 - (length / length.max()) ** 2))]
        n = int(np.clip(len(ids) // EACH, min(len(ids), 2 * POSTED), PIVOTS))
        self.pivots = level[np.random.default_rng(11).permutation(len(ids))[:n]]
        self.n = min(POSTED, n)
        posts = nearest_pivots(level, self.pivots, self.n).ravel()
        by = np.argsort(posts, kind="stable")
        self.rows, self.left = (by // self.n).astype(np.int32), (self.n - by % self.n).astype(np.int16)
        self.starts = np.searchsorted(posts[by], np.arange(n + 1))

    def permutations(self, queries: np.ndarray) -> np.ndarray:
        q = queries / np.abs(queries).max(axis=1, keepdims=True)
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        return nearest_pivots(np.c_[q, np.zeros(len(q))], self.pivots, self.n)

    def search(self, query: np.ndarray, perm: np.ndarray, own: int, short: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the best of the shard's candidates."""
        # Over posted pivots, with those that only one of both posts at place n, footrule is a constant less twice the
        # sum of n less the later of both places.
        at, size = self.starts[perm], self.starts[perm + 1] - self.starts[perm]
        read = np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())
        shared = np.minimum(self.left[read], np.repeat(self.n - np.arange(self.n), size))
        near = np.bincount(self.rows[read], weights=shared, minlength=len(self.ids))
        near = np.argpartition(-near, short)[:short] if short < len(near) else np.arange(len(near))
        near = np.sort(near[self.ids[near] != own])
        dots = np.einsum("ij,j->i", self.x[near], query)
        best = np.lexsort((self.ids[near], -dots))[:TOP]
        return self.ids[near][best], dots[best]


def shard_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("vec_id", "v"), blocks)


def search(vectors: DataFrame, every: int = EVERY, shard: int = SHARD, short: int = SHORT) -> DataFrame:
    """query_id, rank, vec_id, score of the TOP nearest found, for queries with vec_id divisible by every."""
    rows = shared_table(valid(vectors), "ann-vectors")
    held = shared_table(indexed(rows), "ann-indexed")
    groups = held.groupBy("size", "span").agg(F.count("*").alias("n")).select("size", "span", F.expr(f"1 + n div {shard}").alias("blocks"))
    groups = shared_table(groups, "ann-groups")
    key = ["size", "span", "shard"]
    index = join_sized(held, groups, ["size", "span"]).withColumn("shard", shard_of(F.col("blocks")))
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).distinct().drop("span")
    asked = join_sized(asked, groups, ["size"]).withColumn("shard", F.explode(F.expr("sequence(0, blocks - 1)")))
    columns = [*key, "asks", "blocks", "vec_id", "v"]
    both = index.withColumn("asks", F.lit(False)).select(columns).union(asked.withColumn("asks", F.lit(True)).select(columns))
    # One task for a shard: its vectors first, then the queries.
    n = groups.agg(F.sum("blocks")).first()[0] or 1
    both = both.repartition(min(int(n), 100_000), *key).sortWithinPartitions(*key, "asks", "vec_id")

    def run(batches):
        name, ids, xs, files = None, [], [], None
        for batch in batches:
            width = batch.column(0).to_numpy()
            keys = np.stack([width, batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1)
            asks, blocks, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
            flat, ends = batch.column(6).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(width)
            new = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1) | (asks[1:] != asks[:-1])) + 1
            out = []
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(keys)], strict=True):
                if a == b:
                    continue
                x = flat[ends[a] - width[a] : ends[b - 1]].reshape(b - a, -1)
                if name != tuple(keys[a]):
                    name, ids, xs, files = tuple(keys[a]), [], [], None
                if not asks[a]:
                    ids.append(own[a:b])
                    xs.append(x)
                elif ids:
                    if files is None:
                        files, xs = Files(np.concatenate(ids), np.concatenate(xs)), []
                    part = int(np.ceil(1.1 * short / blocks[a])) + TOP
                    for q, perm, k in zip(x, files.permutations(x), own[a:b].tolist(), strict=True):
                        out.append((k, *files.search(q, perm, k, part)))
            if out:
                query = np.repeat([k for k, _, _ in out], [len(f) for _, f, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(np.concatenate([f for _, f, _ in out]), pa.int64()), pa.array(np.concatenate([s for _, _, s in out]), pa.float64())], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(f"rank <= {TOP}").select("query_id", "rank", "vec_id", "score")


def query(spark, vectors: DataFrame) -> DataFrame:
    return search(vectors)
