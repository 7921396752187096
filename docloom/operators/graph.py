"""A proximity graph over vectors: shards of bounded size, each one row of a table, searched by a widening frontier.

A shard holds so many vectors that its graph can be made exactly: each vector's nearest ones are found in blocks of a
matrix product, thinned so that no kept neighbour is nearer to another kept one than ``ALPHA`` allows, filled up to DEGREE
with the nearest left out, and linked back. Equal vectors are one node. A search starts at the shard's pivots, vectors
chosen one after the other as far as can be from those before, and follows links from the best nodes seen, as many as the
shard's ``width``, until none of them has a link left to follow. The width is measured when the shard is built: the least
one that finds RECALL of the nearest ones of some of its vectors, and of mixtures of them. Nodes that no path from a pivot reaches become pivots,
so that every vector can be found.

Shards are dealt by hash, so each has a sample of everything; all of them take part in a search, in parallel, and give
their best. Nothing is shuffled to search but those; ids that are softly deleted are left out before the best are taken,
while their nodes still lead on. Vectors that are null, hold nulls or are zero have no direction and are left out, as
are rows without id; an id may have several vectors. An empty table makes an empty index. All vectors must be of one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.index import unit, usable

#: Bytes of vectors and links in a shard, and its vectors at most.
SHARD_BYTES, SHARD_ROWS = 16 << 20, 32_768
DEGREE, ALPHA, CANDIDATES = 24, 1.2, 96
#: Share of the nearest ones to find, how many are looked for, and of how many vectors, when a width is measured.
RECALL, NEAREST, ASKED = 0.955, 20, 48
PIVOTS = 64
#: Part of its width that a query follows at once; queries that walk together, and are sent together; pairs scored at once.
STEP, WALKERS, QUERIES, SCORED = 1 / 16, 64, 20_000, 1 << 15
SHARD = "shard long, width int, dim int, ids binary, nodes binary, vectors binary, links binary, pivots binary"
FOUND = "query_id long, doc_id long, score double, scored long"


def dots(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of the rows ``a`` of x and ``b`` of y, pair by pair; few rows are copied at once."""
    out = np.zeros(len(a), np.result_type(x, y))
    for lo in range(0, len(a), SCORED):
        out[lo : lo + SCORED] = np.einsum("ij,ij->i", x[a[lo : lo + SCORED]], y[b[lo : lo + SCORED]])
    return out


def nearest(x: np.ndarray, n: int) -> np.ndarray:
    """Row by row, the ``n`` others nearest to a row of unit vectors, nearest first."""
    n, out = min(n, len(x) - 1), []
    for lo in range(0, len(x), 128):
        score = x[lo : lo + 128] @ x.T
        score[np.arange(len(score)), np.arange(lo, lo + len(score))] = -np.inf
        best = np.argpartition(-score, n - 1, axis=1)[:, :n] if n else np.zeros((len(score), 0), np.int64)
        out.append(np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def thinned(x: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates, nearest first, those that no kept one is nearer to than to the row, by ``alpha``; then
    the nearest left out, up to ``degree``."""
    out = np.zeros((len(x), min(degree, near.shape[1])), np.int64)
    for lo in range(0, len(x), 128):
        own = near[lo : lo + 128]
        c = x[own]
        far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bd,bcd->bc", x[lo : lo + 128], c)))
        between = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.transpose(0, 2, 1))))
        alive, kept = np.ones(own.shape, bool), np.zeros(own.shape, bool)
        for j in range(own.shape[1]):
            take = alive[:, j] & (kept.sum(axis=1) < degree)
            kept[:, j] = take
            alive &= ~(take[:, None] & (alpha * between[:, j] <= far))
        order = np.argsort(~kept, axis=1, kind="stable")[:, : out.shape[1]]
        out[lo : lo + 128] = np.take_along_axis(own, order, 1)
    return out


def linked(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Links of each row, up to twice ``degree``, filled with -1: its own and the nearest of those that link to it."""
    own = thinned(x, nearest(x, CANDIDATES), degree, alpha)
    back = pd.DataFrame({"u": np.repeat(np.arange(len(x)), own.shape[1]), "v": own.ravel()})
    pairs = pd.concat([back.assign(first=0), back.rename(columns={"u": "v", "v": "u"}).assign(first=1)]).drop_duplicates(["u", "v"])
    pairs["far"] = -dots(x, pairs["u"].to_numpy(), x, pairs["v"].to_numpy())
    pairs = pairs.sort_values(["u", "first", "far", "v"])
    place = pairs.groupby("u").cumcount()
    pairs, place = pairs[place < 2 * degree], place[place < 2 * degree]
    out = np.full((len(x), 2 * degree), -1, np.int32)
    out[pairs["u"], place] = pairs["v"]
    return out


def pivots_of(x: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Rows to start from: each as far as can be from those before, then one of whatever they don't lead to."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(PIVOTS, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    chosen = list(dict.fromkeys(chosen))
    reached, edge = np.zeros(len(x), bool), np.array(chosen)
    while True:
        while len(edge):
            reached[edge] = True
            edge = np.unique(links[edge])
            edge = edge[(edge >= 0) & ~reached[edge]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return np.array(chosen, np.int32)
        chosen.append(int(lost[0]))
        edge = lost[:1]


def walked(x: np.ndarray, links: np.ndarray, pivots: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(query, node, score) of the ``width`` best nodes that each row of ``q`` sees, best first, and how many it scored."""
    seen, scored = np.zeros((len(q), len(x)), bool), np.full(len(q), len(pivots))
    seen[:, pivots] = True
    who, node = np.repeat(np.arange(len(q)), len(pivots)), np.tile(pivots, len(q)).astype(np.int64)
    score, done = (q @ x[pivots].T).ravel(), np.zeros(len(who), bool)
    while True:
        order = np.lexsort((node, -score, who))
        who, node, score, done = who[order], node[order], score[order], done[order]
        start = np.searchsorted(who, np.arange(len(q)))
        keep = np.arange(len(who)) - start[who] < width
        who, node, score, done = who[keep], node[keep], score[keep], done[keep]
        open_ = np.flatnonzero(~done)
        if not len(open_):
            return who, node, score, scored
        first = np.searchsorted(who[open_], np.arange(len(q)))
        open_ = open_[np.arange(len(open_)) - first[who[open_]] < max(2, STEP * width)]
        done[open_] = True
        to, by = links[node[open_]].astype(np.int64), np.repeat(who[open_], links.shape[1])
        key = np.unique((by * len(x) + to.ravel())[to.ravel() >= 0])
        key = key[~seen.ravel()[key]]
        seen.ravel()[key] = True
        new_who, new = np.divmod(key, len(x))
        scored += np.bincount(new_who, minlength=len(q))
        made = dots(x, new, q, new_who)
        who, node, score, done = np.concatenate([who, new_who]), np.concatenate([node, new]), np.concatenate([score, made]), np.concatenate([done, np.zeros(len(new), bool)])


def width_for(x: np.ndarray, links: np.ndarray, pivots: np.ndarray, near: int) -> int:
    """The least width, in steps of a third, that finds RECALL of the ``near`` nearest ones, both of ASKED rows, not counting a row
    itself, and of as many random mixtures of rows, which lie where no row does."""
    rng = np.random.default_rng(5)
    rows = rng.permutation(len(x))[:ASKED]
    mixed = unit(np.einsum("ab,abd->ad", rng.normal(size=(ASKED, 8)), x[rng.integers(0, len(x), (ASKED, 8))])).astype(np.float32)
    k, asked = min(near, len(x) - 1), np.concatenate([x[rows], mixed])
    score = asked @ x.T
    score[np.arange(len(rows)), rows] = -2
    want = np.argpartition(-score, max(0, k - 1), axis=1)[:, :k]
    key, half, width = (np.arange(len(asked))[:, None] * len(x) + want), len(rows) * k, k + 1
    while width < len(x):
        who, node, _, _ = walked(x, links, pivots, asked, width)
        found = np.isin(key.ravel(), who * len(x) + node)
        if min(found[:half].mean(), found[half:].mean()) >= RECALL:
            return width
        width += 1 + width // 3
    return len(x)


def shard_of(pdf: pd.DataFrame, near: int) -> pd.DataFrame:
    """One row for the vectors of a shard, of whose best ``near`` are wanted."""
    pdf = pdf.sort_values("doc_id", kind="stable")
    x, node = np.unique(unit(np.array(pdf["embedding"].tolist(), np.float64)).astype(np.float32), axis=0, return_inverse=True)
    links = linked(x)
    pivots = pivots_of(x, links)
    width = width_for(x, links, pivots, near)
    return pd.DataFrame([(int(pdf["shard"].iloc[0]), width, x.shape[1], pdf["doc_id"].to_numpy("<i8").tobytes(), node.ravel().astype("<i4").tobytes(), x.astype("<f4").tobytes(), links.astype("<i4").tobytes(), pivots.astype("<i4").tobytes())], columns=[c.split()[0] for c in SHARD.split(", ")])


def searched(row, gone: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, width: int | None) -> Iterator[pd.DataFrame]:
    """The best k live vectors of one shard for each query, and how many nodes it scored."""
    x = np.frombuffer(row.vectors, "<f4").reshape(-1, row.dim)
    links = np.frombuffer(row.links, "<i4").reshape(len(x), -1)
    docs, node = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.nodes, "<i4")
    live = ~np.isin(docs, gone)
    docs, node = docs[live], node[live]
    order = np.lexsort((docs, node))
    docs, first = docs[order], np.searchsorted(node[order], np.arange(len(x) + 1))
    # Dead nodes take places among the best.
    width = max(width or row.width, k)
    width = min(len(x), math.ceil(width * len(x) / max(1, (first[1:] > first[:-1]).sum())))
    for lo in range(0, len(q), WALKERS):
        who, at, score, scored = walked(x, links, np.frombuffer(row.pivots, "<i4"), q[lo : lo + WALKERS].astype(np.float32), width)
        many = np.minimum(first[at + 1] - first[at], k)
        own = np.repeat(np.arange(len(who)), many)
        doc = docs[np.repeat(first[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        # Scored anew, so that a score does not depend on how it was found.
        exact = np.round((1 + np.einsum("ij,ij->i", x[at].astype(float), q[lo + who])) / 2, 6)[own]
        asked = who[own]
        order = np.lexsort((doc, -exact, asked))
        asked, doc, exact = asked[order], doc[order], exact[order]
        keep = np.arange(len(asked)) - np.searchsorted(asked, np.arange(scored.size))[asked] < k if len(asked) else np.zeros(0, bool)
        yield pd.DataFrame({"query_id": np.concatenate([ids[lo + asked[keep]], ids[lo : lo + WALKERS]]), "doc_id": pd.array([*doc[keep], *[None] * scored.size], "Int64"), "score": np.concatenate([exact[keep], np.full(scored.size, np.nan)]), "scored": np.concatenate([np.zeros(keep.sum(), np.int64), scored])})


@dataclass
class GraphIndex:
    """``path``: a table with a row per shard; ``shards``: their number."""

    path: str
    shards: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str, shard_rows: int | None = None) -> GraphIndex:
        """Index all of ``vectors`` (doc_id, embedding)."""
        rows = usable(vectors, "doc_id")
        n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        most = shard_rows or max(64, min(SHARD_ROWS, SHARD_BYTES // (4 * (dim or 1) + 8 * DEGREE + 12)))
        shards = max(1, math.ceil(n / most))
        dealt = rows.select("doc_id", "embedding", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
        near = min(NEAREST, math.ceil(1.2 * NEAREST / shards))  # a shard's part of the best, and some more
        dealt.groupBy("shard").applyInPandas(lambda pdf: shard_of(pdf, near), SHARD).write.mode("overwrite").parquet(path)
        return cls(path, shards)

    def walk(self, spark: SparkSession, queries: DataFrame, k: int, deleted: DataFrame | None = None, width: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, scored): each shard's best for each query, and a row without doc_id that tells how many
        nodes were scored. Queries (query_id, embedding) go in blocks that are read and sent one by one."""
        index = spark.read.schema(SHARD).parquet(self.path)
        if deleted is None:
            index = index.withColumn("gone", F.array().cast("array<bigint>"))
        else:
            lists = deleted.filter("doc_id is not null").select("doc_id").distinct().groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(self.shards)).alias("shard")).agg(F.collect_list("doc_id").alias("gone"))
            index = index.join(lists, "shard", "left")
        asked = usable(queries, "query_id")
        blocks, parts = max(1, math.ceil(asked.count() / QUERIES)), []
        for block in range(blocks):
            own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
            rows = np.array(own["embedding"].tolist(), float).reshape(len(own), -1) if len(own) else np.zeros((0, 0))
            sent = spark.sparkContext.broadcast((own["query_id"].to_numpy(np.int64), unit(rows)))

            def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                ids, q = sent.value
                for b in batches:
                    for row in b.itertuples(index=False):
                        if len(ids):
                            yield from searched(row, np.array([] if row.gone is None else row.gone, np.int64), ids, q, k, width)

            parts.append(index.mapInPandas(run, FOUND))
        return reduce(DataFrame.union, parts)

    def search(self, spark: SparkSession, queries: DataFrame, k: int, threshold: float = 0.5, deleted: DataFrame | None = None, width: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) of the k best found at or above the threshold."""
        best = self.walk(spark, queries, k, deleted, width).filter(F.col("doc_id").isNotNull() & (F.col("score") >= threshold))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        return best.select("query_id", "doc_id", "score").withColumn("rank", rank).filter(F.col("rank") <= k)
