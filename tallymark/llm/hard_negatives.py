"""Hard negatives: bounds of inner products from segment summaries, refined level by level, exact scores for what is left.

Every vector is cut into segments; of each its mean and its deviation, the length of what remains of the segment without
its mean, are stored. The product of two segments of n components is n m m' plus a product of the remainders, which is
within d d' of zero; summed over segments this bounds the score from both sides. Coarse segments come first, the finer
ones only where the coarse bound leaves a pair open, exact whole-number products only for pairs that no bound excludes.

Anchors are a stated query set against all rows: rows stay in blocks of bounded size that one task holds, anchors stream
past every block. A block returns its first few rows for each anchor, and windows over those give the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.llm.common import cut, map_arrow, shuffle_width

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256.0
BLOCK, LEAST_BLOCK = 1 << 16, 1 << 12  # rows of a block: at most, and down to this few so that all tasks have some
SEGMENTS = (4, 16)  # of a vector, coarse and fine
_EXACT = 1 << 53  # doubles hold whole numbers up to here
_CELLS = 1 << 21
_LONG = np.iinfo(np.int64)


@dataclass
class Vectors:
    """Whole-number vectors with the means and deviations of their segments, one level after another."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, segments: Sequence[int] = SEGMENTS) -> Vectors:
        levels = []
        for n in segments:
            parts = np.array_split(x, min(n, max(1, x.shape[1])), axis=1)
            mean = np.stack([p.mean(axis=1) if p.shape[1] else np.zeros(len(x)) for p in parts], axis=1)
            rest = np.stack([np.sqrt(((p - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(parts, mean.T, strict=True)], axis=1)
            levels.append((mean * np.sqrt([p.shape[1] for p in parts]), rest))
        return cls(ids, labels, x, levels)

    def __len__(self) -> int:
        return len(self.ids)

    def some(self, at) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.x[at], [(m[at], d[at]) for m, d in self.levels])

    def norms(self) -> np.ndarray:
        mean, rest = self.levels[-1]
        return np.sqrt((mean**2).sum(axis=1) + (rest**2).sum(axis=1))

    def top(self) -> float:
        return float(np.abs(self.x).max(initial=0))


def products(a: Vectors, b: Vectors) -> np.ndarray:
    """Whole-number inner products of all rows of a with all rows of b."""
    if a.top() * b.top() * max(1, a.x.shape[1]) < _EXACT:
        return a.x @ b.x.T  # every partial sum is a whole number that a double holds
    left, right = ([[int(v) for v in row] for row in x] for x in (a.x, b.x))
    return np.array([[min(max(sum(map(int.__mul__, u, v)), _LONG.min), _LONG.max) for v in right] for u in left], np.int64)


def open_pairs(a: Vectors, b: Vectors, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of b, and which of their pairs with the rows of a, whose score may lie in [low, high] of the row of a.

    Each level of segments works on what the one before leaves open.
    """
    rows, still = np.arange(len(b)), None
    # far above the rounding of the sums, which is relative to the norms
    slack = (1e-6 + 1e-9 * a.norms() * b.norms().max(initial=0))[:, None]
    low, high = low[:, None] - slack, high[:, None] + slack
    for (ma, da), (mb, db) in zip(a.levels, b.levels, strict=True):
        middle, radius = ma @ mb[rows].T, da @ db[rows].T
        fits = middle + radius >= low
        fits &= middle - radius <= high
        if still is not None:
            fits &= still
        some = fits.any(axis=0)
        rows, still = rows[some], fits[:, some]
    return rows, still


def _first(owner: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each owner, by score (highest first), then id, owners in order."""
    order = np.lexsort((ids, ~scores, owner))
    held = owner[order]
    new = np.concatenate([[True], held[1:] != held[:-1]]) if len(held) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(held)), 0))
    return order[np.arange(len(held)) - begin < n]


def nearest(a: Vectors, b: Vectors, n: int, same: bool, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row of a, window, row of b, score): the first n rows of b for each row of a and each of its windows.

    low and high have a column for each window; a row of b counts where its label is the same (or differs), its id differs
    and its score is within. Once a window has n rows, bounds below the last of their scores close a pair.
    """
    windows = low.shape[1]
    owner, other, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor = low.copy()
    step = max(64, _CELLS // max(1, len(a)))
    for k in range(0, len(b), step):
        part = b.some(slice(k, k + step))
        rows, still = open_pairs(a, part, floor.min(axis=1).astype(np.float64), high.max(axis=1).astype(np.float64))
        if not len(rows):
            continue
        part = part.some(rows)
        s = products(a, part)
        still &= (a.labels[:, None] == part.labels) == same
        still &= a.ids[:, None] != part.ids
        found = [(owner, other, score)]
        for w in range(windows):
            fits = still & (s >= floor[:, w, None]) & (s <= high[:, w, None])
            many = np.flatnonzero(np.count_nonzero(fits, axis=1) > n)
            if len(many):  # only scores from the n-th on
                held = np.where(fits[many], s[many], _LONG.min)
                fits[many] &= s[many] >= np.partition(held, -n, axis=1)[:, -n, None]
            i, j = np.nonzero(fits)
            found.append((i * windows + w, rows[j] + k, s[i, j].astype(np.int64)))
        owner, other, score = (np.concatenate(c) for c in zip(*found, strict=True))
        best = _first(owner, score, b.ids[other], n)
        owner, other, score = owner[best], other[best], score[best]
        count = np.bincount(owner, minlength=windows * len(a))
        full = np.flatnonzero(count >= n)
        last = score[np.cumsum(count)[full] - 1]
        floor.flat[full] = np.maximum(floor.flat[full], last)
    return owner // windows, owner % windows, other, score


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as whole numbers floor(SCALE x), in doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat.reshape(len(column), dim))


def _vectors(batch: pa.RecordBatch) -> Vectors:
    """Rows (vec_id, label number, vector) of one length; rows that are equal throughout count once."""
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "class"))
    dim = len(batch.column("embedding")[0]) if len(batch) else 0
    x = _matrix(batch.column("embedding"), dim) + 0.0
    order = np.lexsort((labels, ids))
    ids, labels, x = ids[order], labels[order], x[order]
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (labels[1:] == labels[:-1])
    if again.any():  # the same id and label: compare the vectors of each such group
        seen, keep = {}, np.ones(len(ids), bool)
        for k in np.flatnonzero(again | np.append(again[1:], False)):
            keep[k] = seen.setdefault((ids[k], labels[k], x[k].tobytes()), k) == k
        ids, labels, x = ids[keep], labels[keep], x[keep]
    return Vectors.of(ids, labels, x)


_FOUND = "anchor long, anchor_id long, p int, positive_id long, positive_score long, found_id long, found_score long"


def _meet(rows: DataFrame, anchors: DataFrame, by: Sequence[str], work: Callable[[Vectors, Vectors, list, list], Iterator[tuple]]) -> DataFrame:
    """Let every anchor meet all rows with its values of `by`: rows in blocks, anchors streamed past each block of theirs."""
    spark = rows.sparkSession
    width = shuffle_width(spark)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    few = F.ceil(F.col("_n") / LEAST_BLOCK)
    sizes = sizes.withColumn("_parts", F.greatest(F.ceil(F.col("_n") / BLOCK), F.least(few, F.lit(2 * width))).cast("int")).drop("_n")
    key = F.concat_ws(",", *by, "_part").alias("key")
    held = rows.join(sizes, list(by)).withColumn("_part", F.pmod(F.xxhash64("vec_id"), "_parts").cast("int"))
    past = anchors.join(sizes, list(by)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    columns = ["vec_id", "class", "embedding"]
    none = F.lit(None)
    # rows without anchors (or the reverse) cost one row each and give nothing
    met = (
        held.select(key, F.lit(0).alias("kind"), *columns, none.cast("long").alias("anchor"), none.cast(anchors.schema["positives"].dataType).alias("positives"))
        .unionByName(past.select(key, F.lit(1).alias("kind"), *columns, "anchor", "positives"))
        .repartition(width, "key")
        .sortWithinPartitions("key", "kind")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, block = None, [], None
        for batch in batches:
            keys = batch.column("key").to_pylist()
            kinds = batch.column("kind").to_numpy()
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1] or kinds[k] != kinds[k - 1]), len(keys)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if keys[lo] != at:
                    at, waiting, block = keys[lo], [], None
                if kinds[lo] == 0:
                    waiting.append(part)
                    continue
                if block is None:
                    if not waiting:
                        continue
                    block = _vectors(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
                    waiting = []
                dim = block.x.shape[1]
                mine = Vectors.of(part.column("vec_id").to_numpy(), part.column("class").to_numpy(), _matrix(part.column("embedding"), dim))
                out = list(work(mine, block, part.column("anchor").to_pylist(), part.column("positives").to_pylist()))
                if out:
                    names = [c.split()[0] for c in _FOUND.split(", ")]
                    types = [pa.int32() if c.endswith(" int") else pa.int64() for c in _FOUND.split(", ")]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return map_arrow(met, run, _FOUND)


def _positives(n: int) -> Callable:
    def work(a: Vectors, b: Vectors, anchors: list, _: list) -> Iterator[tuple]:
        low, high = np.full((len(a), 1), _LONG.min), np.full((len(a), 1), _LONG.max)
        for i, _, j, s in zip(*(c.tolist() for c in nearest(a, b, n, True, low, high)), strict=True):
            yield anchors[i], int(a.ids[i]), None, None, None, int(b.ids[j]), s

    return work


def _negatives(n: int, low: int, high: int) -> Callable:
    def work(a: Vectors, b: Vectors, anchors: list, positives: list) -> Iterator[tuple]:
        # one window for each positive; Python's whole numbers do not overflow
        windows = max(map(len, positives))
        lo, hi = np.full((len(a), windows), _LONG.max), np.full((len(a), windows), _LONG.min)
        for i, listed in enumerate(positives):
            for p, one in enumerate(listed):
                least, most = -(-low * one["score"] // 100), high * one["score"] // 100
                if least <= most:
                    lo[i, p], hi[i, p] = least, most
        for i, p, j, s in zip(*(c.tolist() for c in nearest(a, b, n, False, lo, hi)), strict=True):
            one = positives[i][p]
            yield anchors[i], int(a.ids[i]), p, one["id"], one["score"], int(b.ids[j]), s

    return work


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """Hard negatives of the rows of `vectors` (vec_id, embedding, label) that `is_anchor` names: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.

    Components become floor(256 x); a score is the whole-number inner product with the anchor, higher ones first, ties by
    smaller vec_id. An anchor's positives are its first `positives` rows of the same label; for each of them the first
    `negatives` rows of other labels follow whose score is within `low` to `high` hundredths of the positive's. `label`
    replaces the column of that name. No row is returned for a positive without such negatives.

    Rows with a NULL vec_id, label or vector, an empty vector, or a NULL or non-finite component take no part. Rows that
    are equal throughout count once; rows that share an id but differ otherwise are rows (and anchors) of their own, but no
    partners of each other. Vectors of different length never meet. Scores beyond a long are held at its ends. Other
    columns are ignored; an empty table gives an empty result.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    label = F.col("label") if label is None else label
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast(f"array<{kind}>").alias("embedding"),
        label.alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("embedding") > 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound)
    # labels of any type meet as the hash of their text; equal hashes of different labels are beyond chance
    rows = cut(rows.select("vec_id", F.xxhash64(F.col("label").cast("string")).alias("class"), "embedding", F.size("embedding").alias("dim"), "is_anchor"), "mining-rows")
    none = F.lit(None).cast("array<struct<id:long,score:long>>").alias("positives")
    anchors = rows.where("is_anchor").drop("is_anchor").dropDuplicates(["vec_id", "class", "embedding"])
    anchors = cut(anchors.withColumn("anchor", F.xxhash64("vec_id", "class", "embedding")), "mining-anchors")
    rows = rows.drop("is_anchor")

    near = _meet(rows, anchors.withColumn("positives", none), ["class", "dim"], _positives(positives))
    best = W.partitionBy("anchor").orderBy(F.desc("found_score"), "found_id")
    near = near.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= positives)
    listed = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("_rank", "found_id", "found_score"))).alias("_near"))
    listed = listed.select("anchor", F.transform("_near", lambda r: F.struct(r["found_id"].alias("id"), r["found_score"].alias("score"))).alias("positives"))
    asked = cut(anchors.join(listed, "anchor"), "mining-positives")

    hard = _meet(rows, asked, ["dim"], _negatives(negatives, low, high))
    best = W.partitionBy("anchor", "p").orderBy(F.desc("found_score"), "found_id")
    return hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("found_score").alias("negative_score")
    )


#: DuckDB SQL for the registered query: all scores of the anchors, ranked.
ORACLE = f"""
WITH sound AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
