"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly, tile by tile.

Equal fingerprints are merged first, so a group of copies of any size is one fingerprint. Fingerprints then lie in
cells by the population counts of their two halves. Two fingerprints within the radius have counts that differ by the
radius at most in sum over the halves, so only neighbouring cells meet; inside a task tiles are parted again by the
counts of the four quarters. What is left is compared in full with exclusive-or and bit counts: no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import Forest, components, cut, fresh, map_arrow, quoted, shuffle_width

SHINGLE_WORDS, SEED, RADIUS, TILE = 4, 42, 4, 16384
_CELLS = 1 << 22  # compared at once in a task


def fingerprint(text: str | None, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bit b is set if it is set in over half of the shingles' hashes; 0 without words or for None."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate(([0], np.cumsum(size)))
    first, last = start[: -width].tolist(), (start[width:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, seed: int = SEED, also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp, *also): a narrow map over whole texts; fp is the fingerprint as a signed long, `also` are long columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *also])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *also)
    return map_arrow(texts, run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((fp >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (48, 32, 16, 0)], 1).astype(np.int64)


def _parts(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by quarter counts; bounds of the runs of equal counts and the counts of each."""
    q = _quarters(fp)
    key = ((q[:, 0] * 17 + q[:, 1]) * 17 + q[:, 2]) * 17 + q[:, 3]
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.diff(key[order], prepend=-1))
    return order, np.append(at, len(fp)), q[order[at]]


def compare_tiles(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as two arrays of fingerprints, with the components of all links within a tile or between two."""
    both = a if b is None else np.concatenate([a, b])
    forest = Forest(len(both))
    other, shift = (a, 0) if b is None else (b, len(a))
    if len(a) * len(other) <= _CELLS:  # small tiles are compared at once
        i, j = np.nonzero(np.bitwise_count(a[:, None] ^ other[None, :]) <= radius)
        forest.link(i, j + shift)
        u, v = forest.edges()
        return both[u], both[v]
    order_a, at_a, q_a = _parts(a)
    order_b, at_b, q_b = _parts(other)
    near = np.abs(q_a[:, None, :] - q_b[None, :, :]).sum(axis=2) <= radius
    for x, y in zip(*np.nonzero(near), strict=True):
        if b is None and y < x:
            continue
        ia, ib = order_a[at_a[x] : at_a[x + 1]], order_b[at_b[y] : at_b[y + 1]]
        step = max(1, _CELLS // len(ib))
        for k in range(0, len(ia), step):
            rows = ia[k : k + step]
            i, j = np.nonzero(np.bitwise_count(a[rows][:, None] ^ other[ib][None, :]) <= radius)
            if len(i):
                forest.link(rows[i], ib[j] + shift)
    u, v = forest.edges()
    return both[u], both[v]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) among distinct fingerprints `fp` with the components of all pairs within `radius` bits."""
    spark = distinct.sparkSession
    high = F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int")
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")
    placed = distinct.select("fp", high.alias("c1"), low.alias("c2"))
    # at most 33 x 33 cells, whatever the input
    cells = placed.groupBy("c1", "c2").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    cells = F.broadcast(spark.createDataFrame(cells.collect(), "c1 int, c2 int, parts int"))
    blocks = (
        placed.join(cells, ["c1", "c2"])
        .groupBy("c1", "c2", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    steps = [(x, y) for x in range(-radius, radius + 1) for y in range(-radius, radius + 1) if abs(x) + abs(y) <= radius]
    near = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps]))
    own = F.struct("c1", "c2", "part")
    other = F.struct("d1", "d2", "dpart")
    met = (
        blocks.withColumn("near", near)
        .withColumns({"d1": F.col("c1") + F.col("near.x"), "d2": F.col("c2") + F.col("near.y")})
        .join(cells.select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.col("parts").alias("dparts")), ["d1", "d2"])
        .withColumn("dpart", F.explode(F.sequence(F.lit(0), F.col("dparts") - 1)))
        .select(
            F.least(own, other.cast("struct<c1:int,c2:int,part:int>")).alias("a"),
            F.greatest(own, other.cast("struct<c1:int,c2:int,part:int>")).alias("b"),
            "fps",
        )
        .select(F.concat_ws(",", "a.c1", "a.c2", "a.part", "b.c1", "b.c2", "b.part").alias("pair"), (F.col("a") == F.col("b")).alias("same"), "fps")
        .repartition(shuffle_width(spark), "pair")
        .sortWithinPartitions("pair")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, np.ndarray] = {}
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for pair, same, fps in zip(*(batch.column(k) for k in range(3)), strict=True):
                mine = fps.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if same.as_py():
                    a, b = compare_tiles(mine, None, radius)
                elif (first := waiting.pop(pair.as_py(), None)) is not None:
                    a, b = compare_tiles(first, mine, radius)
                else:  # a cell that meets an empty one is dropped by the join, so the partner follows at once
                    waiting = {pair.as_py(): mine}
                    continue
                found.append((a, b))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)], ["a", "b"])

    return map_arrow(met, run, "a long, b long")


def rooted(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """`distinct` fingerprints with `root`, the fingerprint that stands for their component."""
    found = components(links(distinct, radius, tile))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE_WORDS, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits. NULL and empty texts
    have fingerprint zero and link like any other. A row with a NULL doc_id belongs to its fingerprint's component but
    never names it (component_id is NULL where no member has an id). Repeated rows are returned as often as they come.
    Texts of any length are hashed whole; other columns are ignored; an empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, width, seed), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    known = rooted(distinct, radius, tile)
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut(known.join(named, "root").select("fp", "component_id"), "components")
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE_WORDS, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """One row of `docs` for each component (see `near_duplicates`), with all its columns: the least by doc_id, NULL
    last, then by hashes of the text and of the whole row.

    Ids need not be unique: texts that are no near-duplicates all stay, whatever their ids, and rows with a NULL doc_id
    are deduplicated like others. Rows are told apart by two 64-bit hashes.
    """
    text_key, row_key = fresh("text_key", docs.columns), fresh("row_key", docs.columns)
    # maps have no hash: their text stands for them
    plain = [F.to_json(F.struct(quoted(f.name))) if "map<" in f.dataType.simpleString() else quoted(f.name) for f in docs.schema.fields]
    keyed = docs.withColumns({text_key: F.xxhash64("text"), row_key: F.xxhash64(*plain, *[quoted(c).isNull() for c in docs.columns])})
    marked = cut(fingerprints(keyed, width, seed, (text_key, row_key)), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", text_key, row_key)
    distinct = marked.groupBy("fp").agg(F.min(rank).alias("least"))
    least = rooted(distinct, radius, tile).groupBy("root").agg(F.min("least").alias("least"))
    # repeated rows are merged before the shuffle already
    chosen = least.select(f"least.{text_key}", f"least.{row_key}")
    return keyed.dropDuplicates([text_key, row_key]).join(chosen, [text_key, row_key], "left_semi").drop(text_key, row_key)
