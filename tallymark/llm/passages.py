"""Removal of repeated passages: every byte of a 200-byte string that also starts elsewhere goes, in all its places.

Equal 200-byte strings have equal minimisers (the least hash of the 32-byte strings in them), so only places with the
same minimiser need meeting. A first pass over the texts emits one row for each run of starts with one minimiser; rows
whose minimiser occurs once are done. The others' bytes go, equal ones merged, to the shard of their minimiser, where
external induced sorting orders all suffixes and their common prefixes tell which starts repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.llm import induced
from tallymark.llm.common import cut, map_arrow, quoted, shuffle_width

LENGTH, GRAM = induced.LIMIT, 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_PART = 1 << 20  # starts of a text done at once
_PLACE = np.uint64((1 << 21) - 1)
_HELD = 1 << 25  # bytes of distinct pieces a task holds to merge equal ones


def _grams(raw: bytes) -> np.ndarray:
    """Hashes of all GRAM-byte strings; they depend on content only."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    h = (x + np.uint64(1)) * _ODD[0]
    h ^= h >> np.uint64(29)
    span = 1
    for odd in _ODD[1:]:  # pairs of 1, 2, 4, 8 and 16 bytes make up 32
        h = h[:-span] * odd + h[span:]
        h ^= h >> np.uint64(31)
        span *= 2
    h *= _ODD[0]
    h ^= h >> np.uint64(32)
    return h


def runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of starts with one minimiser: the minimiser, first start, number of starts, and whether the
    minimiser lies at several places of the run, so that the run may repeat itself.

    Within a window the leftmost place of the least hash counts (of its upper bits, then of its place), which is the
    same place in equal strings. A long text is done in parts; a run at a cut becomes two.
    """
    out: list[tuple[np.ndarray, ...]] = []
    window = LENGTH - GRAM + 1
    for begin in range(0, len(raw) - LENGTH + 1, _PART):
        gram = _grams(raw[begin : begin + _PART + LENGTH - 1])
        low = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
        span = 1
        while 2 * span <= window:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if rest := window - span:
            low = np.minimum(low[:-rest], low[rest:])
        place = low & _PLACE
        value = gram[place]
        at = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        end = np.append(at[1:], len(value))
        out.append((value[at].view(np.int64), (at + begin).astype(np.int32), (end - at).astype(np.int32), place[at] != place[end - 1]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _keyed(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The text, a never-NULL key of id and hash of the text, and a struct of the carried columns.

    Repeated rows share a key, and so their spans.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    d = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 62)))
    return docs.select(d.alias("d"), F.xxhash64(text).alias("t"), text.alias("text"), F.struct(*[quoted(c).alias(c) for c in carried]).alias("row"))


def _all_runs(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first, n, again, size = [], [], [], [], []
            for text in batch.column(2):
                found = runs(text.as_py().encode())
                for into, values in zip((h, first, n, again), found, strict=True):
                    into.append(values)
                size.append(len(found[0]))
            if not sum(size):
                continue
            owner = np.repeat(np.arange(len(size)), size)
            keys = [pa.array(batch.column(k).to_numpy()[owner]) for k in (0, 1)]
            yield pa.record_batch([*keys, *(pa.array(np.concatenate(c)) for c in (h, first, n, again))], ["d", "t", "h", "first", "n", "again"])

    return map_arrow(keyed.select("d", "t", "text"), run, "d long, t long, h long, first int, n int, again boolean")


def _spans(marked: np.ndarray) -> list[int]:
    """Begin, end, begin, end .. of the runs of marked starts."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return edge.tolist()


def _place_spans(pieces: DataFrame) -> DataFrame:
    """(h, piece_key, spans) of the distinct pieces with a repeated start; `pieces` has a row per piece and sending task."""
    spark = pieces.sparkSession
    # wide enough that a shard, with its arrays of some 60 bytes a byte, is small
    sharded = pieces.repartition(2 * shuffle_width(spark), "h").sortWithinPartitions("h", "piece_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()))
        told: list[tuple[int, bytes, list[int]]] = []
        listed: list[tuple[int, bytes, int, int]] = []  # of the pieces in the spool: minimiser, key, bytes, count

        def told_so_far() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*told, strict=True), kinds, strict=True)], ["h", "piece_key", "spans"])
            told.clear()
            return batch

        with induced.Scratch() as scratch:
            spool = induced.Spool(scratch)
            last: list | None = None  # minimiser, key, piece, count
            several = False

            def put() -> None:
                h, key, piece, count = last
                spool.add(np.append(np.frombuffer(piece, np.uint8) + np.uint8(1), np.uint8(255)))  # no byte of UTF-8 becomes 255
                listed.append((h, key, len(piece), count))

            def close() -> None:
                if last is None:
                    return
                if not several and last[3] > 1:  # the only piece of its minimiser, found in several places
                    told.append((last[0], last[1], [0, len(last[2]) - LENGTH + 1]))
                else:
                    put()

            for batch in batches:
                for h, key, piece, count in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3)), strict=True):
                    key, count = key.as_py(), count.as_py()
                    if last is not None and last[0] == h:
                        if last[1] == key:
                            last[3] += count
                            continue
                        put()
                        several = True
                    else:
                        close()
                        several = False
                    last = [h, key, piece.as_py(), count]
                if told:
                    yield told_so_far()
            close()
            if listed:
                spool.add(np.zeros(1, np.uint8))
                marks = induced.repeated(spool.text(), scratch)
                begin = 0
                for h, key, size, count in listed:
                    n = size - LENGTH + 1
                    if spans := [0, n] if count > 1 else _spans(marks[begin : begin + n]):
                        told.append((h, key, spans))
                    begin += size + 1
                    if len(told) == 4096:
                        yield told_so_far()
            if told:
                yield told_so_far()

    return map_arrow(sharded, run, "h long, piece_key binary, spans array<int>")


def _flagged_runs(keyed: DataFrame) -> DataFrame:
    """(d, t, runs): per text the runs whose minimiser occurs more than once."""
    found = cut(_all_runs(keyed), "minimisers")
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.max("again").alias("again"))
    often = often.where("times > 1 OR again").select("h")
    return found.join(often, "h").groupBy("d", "t").agg(F.collect_set(F.struct("first", "n", "h")).alias("runs"))


def _with_pieces(texts: DataFrame, flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pieces with their bytes (per task), and where each piece lies."""
    # the carried columns go along so that this and the last join read the texts from one shuffle
    joined = texts.join(flagged, ["d", "t"]).select("d", "t", "text", "runs.first", "runs.n", "runs.h", "row")

    def cut_out(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, int, bytes]]:
        unpack = zstandard.ZstdDecompressor().decompress
        for d, t, text, first, n, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(k) for k in (2, 3, 4, 5)), strict=True):
            raw = unpack(text.as_py())
            for f, m, x in zip(first.as_py(), n.as_py(), h.as_py(), strict=True):
                yield d, t, x, f, m, raw[f : f + m + LENGTH - 1]

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(h, key, piece, count) for key, (h, piece, count) in held.items()]
            for k in range(0, len(rows), 4096):
                part = list(zip(*rows[k : k + 4096], strict=True))
                types = (pa.int64(), pa.binary(), pa.binary(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(part, types, strict=True)], ["h", "piece_key", "piece", "count"])
            held.clear()

        for batch in batches:
            for _, _, h, _, _, piece in cut_out(batch):
                key = hashlib.blake2b(piece, digest_size=16).digest()
                if key in held:
                    held[key][2] += 1
                else:
                    held[key] = [h, piece, 1]
                    size += len(piece)
            if size > _HELD:
                yield from flush()
                size = 0
        yield from flush()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, t, h, hashlib.blake2b(p, digest_size=16).digest(), f) for d, t, h, f, _, p in cut_out(batch)]
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["d", "t", "h", "piece_key", "first"])

    return (
        map_arrow(joined, distinct, "h long, piece_key binary, piece binary, count long"),
        map_arrow(joined, places, "d long, t long, h long, piece_key binary, first int"),
    )


def removed_spans(size: int, starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes from runs of repeated starts."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        end = min(size, b - 1 + LENGTH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((a, end))
    return out


def repeated_starts(docs: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """Texts with their keys, dealt by key, and per key the runs of starts (begin, end) that repeat."""
    spark = docs.sparkSession
    keyed = _keyed(docs, carried)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            small = pa.array([pack(text.as_py().encode()) for text in batch.column(2)], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), small, batch.column(3)], ["d", "t", "text", "row"])

    # texts are most of what is dealt out, so they travel compressed
    kinds = T.StructType([keyed.schema["d"], keyed.schema["t"], T.StructField("text", T.BinaryType()), keyed.schema["row"]])
    texts = map_arrow(keyed, squeeze, kinds).repartition(shuffle_width(spark), "d", "t")
    pieces, places = _with_pieces(texts, _flagged_runs(keyed))
    spans = _place_spans(pieces)
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("spans") - 1, F.lit(2)),
        lambda k: F.struct((F.col("first") + F.get("spans", k)).alias("a"), (F.col("first") + F.get("spans", k + 1)).alias("b")),
    )
    starts = (
        places.join(spans, ["h", "piece_key"])
        .select("d", "t", pairs.alias("pairs"))
        .groupBy("d", "t")
        .agg(F.flatten(F.collect_set("pairs")).alias("pairs"))
        .select("d", "t", F.col("pairs.a").alias("begins"), F.col("pairs.b").alias("ends"))
    )
    return texts, starts


def _kept(packed: bytes, begins, ends) -> tuple[int, list[tuple[int, int]], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    spans = removed_spans(len(raw), list(zip(begins or (), ends or (), strict=True)))
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return len(raw), spans, b"".join([*out, raw[at:]])


def strip(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    A NULL text is empty; texts under 200 bytes lose nothing. Repeated rows are copies of each other, as are equal texts
    of other ids: all their bytes go if they have 200. A NULL doc_id is kept. Removal goes by bytes, so `kept` may hold
    parts of characters. Whole texts are read; other columns are ignored; an empty table gives an empty result.
    """
    texts, starts = repeated_starts(docs, ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            rows = []
            for doc_id, text, begins, ends in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3)), strict=True):
                n, spans, kept = _kept(text.as_py(), begins.as_py(), ends.as_py())
                rows.append((doc_id, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    joined = texts.join(starts, ["d", "t"], "left").select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "begins", "ends")
    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def strip_texts(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with all their columns, repeated passages taken out of `text` and `n_chars` (if there) set anew.

    Rows and NULL texts are handled as by `strip`; halves of characters at a cut go too. Rows whose whole text goes stay,
    with an empty text.
    """
    texts, starts = repeated_starts(docs, [c for c in docs.columns if c != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                _kept(text.as_py(), begins.as_py(), ends.as_py())[2].decode(errors="ignore")
                for text, begins, ends in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True)
            ]
            yield pa.record_batch([batch.column(0), pa.array(kept, pa.string())], ["row", "text"])

    joined = texts.join(starts, ["d", "t"], "left").select("row", "text", "begins", "ends")
    done = map_arrow(joined, run, T.StructType([texts.schema["row"], T.StructField("text", T.StringType())]))
    columns = {c: F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return done.select(*columns.values())
