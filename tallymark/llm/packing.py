"""Best-fit packing with large-item matching: pieces above a third of the capacity pair up, smaller ones fill the gaps.

Lengths are whole numbers up to the capacity, so the plan is made from their histogram, whose size the capacity bounds,
not from documents: it says which ranks of which length go to which sequences. Spark counts, ranks and places pieces.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallymark.llm.common import cut, map_arrow

CAPACITY, END_ID, BUCKETS = 4096, 1, 64

#: Bytes of words with their ids that a task keeps, and bytes of text that it encodes at once.
CACHE, STEP = 32 << 20, 8 << 20


class Merges:
    """Byte-pair merges of many words at once: every round merges the pair of least rank, the leftmost, in all words.

    For words of letters that the tokenizer treats as one pre-token; ids are those of its vocabulary.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in own]
        shown = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}  # byte-level alphabet
        self.inner = np.array([ids[shown[b]] for b in range(256)], np.int64)
        self.final = np.array([ids[shown[b] + model["end_of_word_suffix"]] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([(ids[x] << 16) | ids[y] for x, y in pairs], np.int64)
        made = np.array([ids[x + y] for x, y in pairs], np.int64)
        self.slots = np.full(1 << 19, -1, np.int64)
        self.rank, self.made = np.zeros(1 << 19, np.int64), np.zeros(1 << 19, np.int64)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):  # pairs take the next free slot, one pair per slot and round
            free = self.slots[at] < 0
            _, first = np.unique(at, return_index=True)
            placed = np.zeros(len(left), bool)
            placed[first] = free[first]
            self.slots[at[placed]] = keys[left[placed]]
            self.rank[at[placed]], self.made[at[placed]] = left[placed], made[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & (len(self.slots) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of pairs, -1 where they do not merge."""
        keys = (a << 16) | b
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        while len(todo):
            there = self.slots[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (there >= 0)]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
        return out

    def ids(self, words: pa.Array) -> pa.ListArray:
        """Ids of words (binary), one list each."""
        data, ends = _content(words)
        size = np.diff(ends)
        order = np.argsort(size, kind="stable")
        found = [self._some(data, ends[:-1], size, order[k : k + 4096]) for k in range(0, len(order), 4096)]
        symbols, counts = (np.concatenate(c) for c in zip(*found, strict=True))
        return _lists(symbols, counts).take(pa.array(np.argsort(order)))

    def _some(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = size[rows], int(size[rows].max()) + 1
        owner = np.repeat(np.arange(len(rows)), n)
        column = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        byte = data[np.repeat(start[rows], n) + column]
        symbols = np.full((len(rows), width), -1, np.int64)
        symbols[owner, column] = np.where(column == n[owner] - 1, self.final[byte], self.inner[byte])
        slots = self._find(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(rows), width - 1)
        none = np.iinfo(np.int64).max
        rank = np.where(slots >= 0, self.rank[slots], none)
        live = np.arange(len(rows))
        columns = np.arange(width)
        while True:
            best = rank[live].argmin(axis=1)
            going = rank[live, best] < none
            live, best = live[going], best[going]
            if not len(live):
                break
            made = self.made[slots[live, best]]
            moved = np.minimum(columns[None, :] + (columns[None, :] > best[:, None]), width - 1)
            s = np.take_along_axis(symbols[live], moved, axis=1)
            s[np.arange(len(live)), best] = made
            symbols[live] = s
            moved = moved[:, :-1]
            moved = np.minimum(moved, width - 2)
            slots[live] = np.take_along_axis(slots[live], moved, axis=1)
            for place in (best - 1, best):  # the pairs beside the new symbol
                ok = place >= 0
                r, p = live[ok], place[ok]
                slots[r, p] = self._find(symbols[r, p], symbols[r, p + 1])
            rank[live] = np.where(slots[live] >= 0, self.rank[slots[live]], none)
        real = symbols >= 0
        return symbols[real].astype(np.uint32), real.sum(axis=1)


def _content(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words (binary) and where each begins, with the end of the last."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(_ends(counts)), pa.py_buffer(data)])


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_ends(counts)), pa.array(values, pa.uint32()))


class Kept:
    """Ids of distinct words: what was encoded before is looked up, up to a bound in bytes."""

    def __init__(self, encode: Callable[[pa.Array], pa.ListArray]):
        self._encode = encode
        self._words, self._ids = pa.array([], pa.binary()), pa.array([], pa.list_(pa.uint32()))

    def ids(self, words: pa.Array) -> pa.ListArray:
        at = pc.index_in(words, value_set=self._words)
        new = words.filter(at.is_null())
        if len(new):
            place = np.array(at.fill_null(-1))
            place[place < 0] = len(self._words) + np.arange(len(new))
            at = pa.array(place)
            self._words = pa.concat_arrays([self._words, new])
            self._ids = pa.concat_arrays([self._ids, self._encode(new)])
        ids = self._ids.take(at)
        if self._words.nbytes + self._ids.nbytes > CACHE:  # the words at hand stay
            self._words, self._ids = words, ids
        return ids


class WordIds:
    """Ids of texts by a tokenizer that lower-cases and drops white space: words are encoded once and kept, up to a bound.

    Pre-tokens never cross white space, and letters and marks are pre-tokens of their own. Words of Latin letters, with up
    to four ASCII marks behind, but no apostrophe, take their letters' ids from the merges directly and the marks' from the
    tokenizer; all other words go to the tokenizer whole.
    """

    #: what a byte of UTF-8 may be in such a word: 1 in a letter (ASCII, and À to ÿ without the signs × and ÷), 2 a mark
    KIND = np.zeros(256, np.uint8)
    KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = 1
    KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
    LOWER = np.arange(256, dtype=np.uint8)
    LOWER[[*range(65, 91), *range(0x80, 0x9F)]] += 32

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self._cores, self._known = Kept(Merges(path).ids), Kept(self._encode)

    def _whole(self, words: pa.Array) -> pa.ListArray:
        words = words.cast(pa.string()).to_pylist()
        found: list[list[int]] = []
        for k in range(0, len(words), 4096):
            found += [e.ids for e in self.tokenizer.encode_batch(words[k : k + 4096], add_special_tokens=False)]
        return pa.array(found, pa.list_(pa.uint32()))

    def _encode(self, words: pa.Array) -> pa.ListArray:
        data, ends = _content(words)
        start, size = ends[:-1], np.diff(ends)
        kind = self.KIND[data]
        before = [np.concatenate([[0], np.cumsum(kind == k)]) for k in (1, 2)]
        letters, marks = (b[ends[1:]] - b[start] for b in before)
        plain = (letters + marks == size) & (letters > 0) & (letters <= 64) & (marks <= 4)
        plain &= before[0][np.minimum(start + letters, ends[1:])] - before[0][start] == letters  # letters come first
        inside = np.repeat(plain, size)
        cores = _binary(self.LOWER[data[inside & (kind == 1)]], letters[plain]).dictionary_encode()
        behind = _binary(data[inside & (kind == 2)], marks[plain]).dictionary_encode()
        parts = pa.concat_arrays([self._cores.ids(cores.dictionary), self._whole(behind.dictionary)])
        pairs = np.column_stack([cores.indices.to_numpy(), behind.indices.to_numpy() + len(cores.dictionary)])
        ids = parts.take(pa.array(pairs.ravel()))
        ids = pa.ListArray.from_arrays(ids.offsets[::2], ids.values)
        ids = pa.concat_arrays([ids, self._whole(words.filter(pa.array(~plain)))])
        return ids.take(pa.array(np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (strings without NULL), one after another, and where each text's begin, with the last's end."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().cast(pa.binary()).dictionary_encode()
        ids = self._known.ids(words.dictionary).take(words.indices)
        ends = split.offsets.to_numpy().astype(np.int64)
        return ids.flatten().to_numpy(), ids.offsets.to_numpy()[ends - ends[0]]

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts."""
        ids, ends = self.texts(pa.array(texts, pa.string()))
        for a, b in pairwise(ends.tolist()):
            yield ids[a:b].astype("<u4").tobytes()


def _steps(batches: Iterator[pa.RecordBatch], most: int = STEP) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The (doc_id, text) of batches anew in parts of about `most` bytes of text, whole texts each; NULL texts are empty."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> tuple[pa.Array, pa.Array]:
        doc_id, text = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
        held.clear()
        text.validate(full=True)  # no broken UTF-8
        return doc_id, text.fill_null("").cast(pa.string())

    for batch in batches:
        if not batch.num_rows:
            continue
        filled = size + np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64))
        cuts = np.flatnonzero(np.diff(filled // most, prepend=0)).tolist()
        for k, (a, b) in enumerate(pairwise([0, *cuts, batch.num_rows])):
            if k and held:
                yield joined()
            if b > a:
                held.append(batch.slice(a, b - a))
        size = int(filled[-1]) % most
    if held:
        yield joined()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text's ids and the end id, cut every `capacity` tokens."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for doc_ids, texts in _steps(batches):
            rows = []
            found, ends = words.texts(texts)
            for doc_id, (a, b) in zip(doc_ids.to_pylist(), pairwise(ends.tolist()), strict=True):
                ids = found[a:b].astype("<u4").tobytes() + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(texts, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first sequence, pieces per sequence, offset) of the whole packing.

    Pieces of rank r of a row go to sequence `first + (r - first rank) // per`, at `offset + (r - first rank) % per *
    length`. Runs of sequences with equal gaps are treated at once, so the work follows the capacity, not the counts.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, number)
    order: list[int] = []  # gaps that have runs, sorted
    sequences = 0

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def place(size: int, n: int, first: int, per: int, offset: int) -> None:
        rows.append((size, used[size], used[size] + n, first, per, offset))
        used[size] += n

    # large items: from the largest down, each with the largest other large item that fits beside it
    large = sorted(s for s in counts if 3 * s > capacity and counts[s])
    left = {s: counts[s] for s in large}
    while large:
        size = large[-1]
        k = bisect_left(large, capacity - size + 1) - 1
        partner = large[k] if k >= 0 else None
        if partner is None:
            n = left[size]
            place(size, n, sequences, 1, 0)
            free(capacity - size, sequences, n)
            sequences += n
            left[size] = 0
        elif partner == size:
            n = left[size] // 2
            if n:
                place(size, 2 * n, sequences, 2, 0)
                free(capacity - 2 * size, sequences, n)
                sequences += n
                left[size] -= 2 * n
            if left[size]:
                large.pop()
                k = bisect_left(large, capacity - size + 1) - 1
                n = 1
                place(size, 1, sequences, 1, 0)
                if k >= 0:
                    other = large[k]
                    place(other, 1, sequences, 1, size)
                    left[other] -= 1
                    free(capacity - size - other, sequences, 1)
                else:
                    free(capacity - size, sequences, 1)
                sequences += 1
                left[size] = 0
                large.append(size)
        else:
            n = min(left[size], left[partner])
            place(size, n, sequences, 1, 0)
            place(partner, n, sequences, 1, size)
            free(capacity - size - partner, sequences, n)
            sequences += n
            left[size] -= n
            left[partner] -= n
        large = [s for s in large if left[s]]
    # small items, largest first: the smallest gap that holds one takes as many as fit, then the next larger gap
    for size in sorted((s for s in counts if 3 * s <= capacity and counts[s]), reverse=True):
        n = counts[size]
        while n:
            k = bisect_left(order, size)
            if k == len(order):
                per = capacity // size
                full, rest = divmod(n, per)
                if full:
                    place(size, full * per, sequences, per, 0)
                    free(capacity - per * size, sequences, full)
                    sequences += full
                if rest:
                    place(size, rest, sequences, rest, 0)
                    free(capacity - rest * size, sequences, 1)
                    sequences += 1
                break
            gap = order[k]
            first, m = gaps[gap].pop()
            per = gap // size
            full, rest = divmod(n, per)
            take = min(m, full)
            if take:
                place(size, take * per, first, per, capacity - gap)
                free(gap - per * size, first, take)
                n -= take * per
            if take < m and n and n < per:
                place(size, n, first + take, n, capacity - gap)
                free(gap - n * size, first + take, 1)
                take, n = take + 1, 0
            if take < m:
                gaps[gap].append((first + take, m - take))
            if not gaps[gap]:
                del gaps[gap]
                order.pop(bisect_left(order, gap))
    return rows


def _ranked(found: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Pieces with their rank among equals of length inside a bucket, and the counts of (length, bucket)."""
    by_bucket = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = by_bucket.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    return by_bucket.withColumn("rank", F.row_number().over(w) - 1), counts


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, buckets: int = BUCKETS) -> DataFrame:
    """Per piece of every row of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A NULL or empty text has the end id only. Texts of more than `capacity` tokens are cut there, no others. Ties among
    pieces of a length are broken by doc_id and piece (NULL first); repeated rows are packed each. Other columns are
    ignored; an empty table gives an empty result. A full piece is a sequence of its own and takes its number from its place
    in the table of pieces, after those of the plan; of the others, a length shared by very many is ranked in `buckets` parts.
    """
    spark = docs.sparkSession
    found = cut(pieces(docs, tokenizer, capacity, end_id), "pieces")
    ranked, counts = _ranked(found.where(F.col("length") < capacity), buckets)
    counts = counts.collect()  # at most capacity x buckets rows of three numbers
    total: dict[int, int] = {}
    offsets = []
    for r in sorted(counts):
        offsets.append((r.length, r.bucket, total.get(r.length, 0)))
        total[r.length] = total.get(r.length, 0) + r.n
    rows = np.array(plan(total, capacity), np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    reach = int(max(total.values(), default=0)) + 1
    first = rows[:, 0] * reach + rows[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            row = rows[np.searchsorted(first, length * reach + rank, side="right") - 1]
            within = rank - row[:, 1]
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(row[:, 3] + within // row[:, 4]), pa.array(row[:, 5] + within % row[:, 4] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = T.StructType.fromDDL("length long, bucket int, before long")
    offsets = F.broadcast(_frame(spark, offsets, schema))
    placed = ranked.join(offsets, ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )
    planned = map_arrow(placed, assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    after = int((rows[:, 3] - (rows[:, 1] - rows[:, 2]) // rows[:, 4]).max(initial=0))  # sequences of the plan
    number = F.monotonically_increasing_id() + F.lit(after)
    full = found.where(F.col("length") == capacity).withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("long"))
    return planned.unionByName(full.select(planned.columns))


def _frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    arrow = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], schema.names)
    return spark.createDataFrame(arrow, schema)
