"""Near-duplicate embeddings: int8 tile products with an error bound per vector, exact cosines only where needed.

Vectors are compared within a label. Equal vectors are merged first and counted. Each label's distinct vectors are
dealt into blocks of bounded size; every pair of blocks of a label is one tile product. A unit vector x is stored as
x = s q + e with q in -127..127; for two of them the product of the int8 parts errs by at most
|e_x| + |e_y| + |e_x| |e_y|, so pairs whose quantised cosine plus that bound stays below the threshold cannot link, and
all others are computed again in double precision from the given components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import Forest, components, cut, map_arrow, shuffle_width

THRESHOLD, BLOCK = 0.93, 2048
_SLACK = 1e-6  # rounding of norms and scales, far above double rounding
_CELLS = 1 << 22


class Tile:
    """Vectors of one block: exact components, norms, int8 parts with scale and norm of the error."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, flat: np.ndarray):
        self.ids, self.copies = ids, copies
        self.x = flat.reshape(len(ids), -1).astype(np.float64)
        # scaled by the largest component first, so that squares neither overflow nor vanish
        self.x /= np.abs(self.x).max(axis=1, keepdims=True)
        self.x /= np.sqrt(np.einsum("ij,ij->i", self.x, self.x))[:, None]
        top = np.abs(self.x).max(axis=1, keepdims=True)
        self.scale = (top / 127)[:, 0]
        q = np.rint(self.x * (127 / top))
        error = self.x - q * self.scale[:, None]
        self.error = np.sqrt(np.einsum("ij,ij->i", error, error))
        self.q = q.astype(np.int8)

    def products(self, rows: slice, other: Tile) -> np.ndarray:
        # sums of int8 products are whole numbers; float32 holds them exactly up to 2**24
        kind = np.float32 if self.q.shape[1] * 127 * 127 < 1 << 24 else np.float64
        return self.q[rows].astype(kind) @ other.q.astype(kind).T


def compare(a: Tile, b: Tile | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of linked vectors (copies counted) for the rows of a and then b; edges with the tile's components."""
    other, shift = (a, 0) if b is None else (b, len(a.ids))
    ids = a.ids if b is None else np.concatenate([a.ids, b.ids])
    n_links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
    step = max(1, _CELLS // max(1, len(other.ids)))
    for k in range(0, len(a.ids), step):
        rows = slice(k, k + step)
        near = a.products(rows, other) * (a.scale[rows, None] * other.scale[None, :])
        ea, eb = a.error[rows, None], other.error[None, :]
        i, j = np.nonzero(near + (ea + eb + ea * eb) >= threshold - _SLACK)
        i += k
        if b is None:
            i, j = i[i < j], j[i < j]
        part = max(1, _CELLS // a.x.shape[1])
        for p in range(0, len(i), part):
            u, v = i[p : p + part], j[p : p + part]
            linked = np.einsum("ij,ij->i", a.x[u], other.x[v]) >= threshold
            u, v = u[linked], v[linked]
            np.add.at(n_links, u, other.copies[v])
            np.add.at(n_links, v + shift, a.copies[u])
            forest.link(u, v + shift)
    u, v = forest.edges()
    return ids, n_links, ids[u], ids[v], forest.label


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and their cosine is at least `threshold`. n_links counts the other rows a
    row links to, equal vectors included; component_id is the smallest vec_id reachable; kept is vec_id = component_id.
    A NULL, empty or zero vector, one with a NULL or non-finite component, a NULL label or a NULL vec_id links with
    nothing: n_links 0, component its own vec_id (kept is false for a NULL vec_id). Vectors of different length never
    link. Labels may be numbers, texts or dates; components wider than float are compared as doubles. Repeated rows count as vectors of their own. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    given = vectors.schema["embedding"].dataType.simpleString()
    kind = given if given == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind), "label")
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    sound = F.coalesce(sound, F.lit(False))
    distinct = cut(
        rows.where(sound)
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("dim", F.size("embedding")),
        "vectors",
    )
    sizes = distinct.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    one = F.struct("rep", "copies", "embedding")
    blocks = (
        distinct.join(sizes, ["label", "dim"])
        .groupBy("label", "dim", "parts", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list(one).alias("rows"))
    )
    met = (
        blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.concat_ws(",", "dim", F.least("part", "other"), F.greatest("part", "other"), F.col("label").cast("string")).alias("pair"),
            (F.col("part") == F.col("other")).alias("same"),
            F.col("rows.rep").alias("ids"),
            F.col("rows.copies").alias("copies"),
            F.flatten("rows.embedding").alias("flat"),
        )
        .repartition(shuffle_width(spark), "pair")
        .sortWithinPartitions("pair")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, Tile] = {}
        for batch in batches:
            for pair, same, *arrays in zip(*(batch.column(k) for k in range(5)), strict=True):
                mine = Tile(*(x.values.to_numpy(zero_copy_only=False) for x in arrays))
                if same.as_py():
                    first, second = mine, None
                elif (first := waiting.pop(pair.as_py(), None)) is not None:
                    second = mine
                else:
                    waiting = {pair.as_py(): mine}
                    continue
                ids, n, a, b, _ = compare(first, second, threshold)
                some = n > 0
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([ids[some], a])),
                        pa.array(np.concatenate([n[some], np.zeros(len(a), np.int64)])),
                        pa.array(np.concatenate([ids[some], b])),
                    ],
                    ["a", "n", "b"],
                )

    found = cut(map_arrow(met, run, "a long, n long, b long"), "tile-links")
    degree = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    rooted = components(found.select("a", "b"))
    known = (
        distinct.join(degree.withColumnRenamed("a", "rep"), "rep", "left")
        .join(rooted.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label",
            "embedding",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )
    linked = rows.where(sound).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
