"""Byte-level BPE encoding and decoding of texts of any length by overlapping chunks.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. The pattern looks ahead but never behind,
so two pre-tokenisations that share a boundary agree from there on: neighbouring chunks are stitched at a boundary both
have in their overlap, and the pieces between stitches are encoded pre-token by pre-token. Decoding concatenates the
tokens' raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import map_arrow, shuffle_width

CHUNK, OVERLAP = 16384, 512
#: Boundaries this close to a chunk's cut may look different with the text that follows: the longest fixed alternative
#: of the pattern has three characters, and one more is looked at.
MARGIN = 4
CACHE = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """Pattern, ranks and the ids of pre-tokens already met (as little-endian bytes), up to a bound."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self._known: dict[str, bytes] = {}

    def pretokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, pretokens: list[str]) -> bytes:
        """Ids of the pre-tokens as little-endian unsigned 32-bit integers."""
        known = self._known
        try:
            return b"".join(map(known.__getitem__, pretokens))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for p in set(pretokens).difference(known):
                known[p] = np.array(self._merge(p.encode()), "<u4").tobytes()
            return b"".join(map(known.__getitem__, pretokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Digest:
    """Counts and digests of a text's ids and of the bytes they decode to, piece by piece."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.n = encoder, 0
        self.ids, self.decoded = hashlib.sha256(), hashlib.sha256()

    def add(self, pretokens: list[str]) -> None:
        for k in range(0, len(pretokens), 1 << 16):
            ids = self.encoder.encode(pretokens[k : k + (1 << 16)])
            self.n += len(ids) // 4
            self.ids.update(ids)
            self.decoded.update(self.encoder.decode(ids))

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


def chunk_starts(length: int, chunk: int, overlap: int) -> list[int]:
    return list(range(0, max(1, length - overlap), chunk - overlap))


def boundaries(text: str, pretokens: list[str], last: bool) -> np.ndarray:
    """Ends of pre-tokens that the text behind the chunk cannot change."""
    ends = np.cumsum(np.fromiter(map(len, pretokens), np.int64, len(pretokens)))
    return ends if last else ends[ends <= len(text) - MARGIN]


class Stitcher:
    """Takes a text's chunks in order and passes on pre-tokens that are those of the whole text."""

    def __init__(self, encoder: Encoder, take):
        self.encoder, self.take = encoder, take
        self.text, self.start, self.ends, self.more = "", 0, np.zeros(0, np.int64), ""

    def _emit(self, upto: int | None) -> None:
        """Pre-tokens of the present text up to an absolute position, or all."""
        ends = self.ends if upto is None else self.ends[self.ends <= upto - self.start]
        begin = np.concatenate(([0], ends)).astype(np.int64)[: len(ends)]
        self.take([self.text[a:b] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)])

    def add(self, start: int, text: str, ends: np.ndarray, last: bool) -> None:
        if not self.text:
            self.text, self.start, self.ends = text, start, ends
        else:
            end = self.start + len(self.text) + len(self.more)
            common = np.intersect1d(self.ends + self.start, np.append(ends, 0) + start) if not self.more else ends[:0]
            if not len(common):
                # no boundary in common: the chunks become one longer text, pre-tokenised again once it has doubled
                self.more += text[end - start :]
                if not last and len(self.more) < len(self.text):
                    return
                self.text, self.more = self.text + self.more, ""
                self.ends = boundaries(self.text, self.encoder.pretokens(self.text), last)
            else:
                at = int(common[-1])
                self._emit(at)
                cut = at - start
                self.text, self.start, self.ends = text[cut:], at, ends[ends > cut] - cut
        if last:
            self._emit(None)
            self.text, self.start, self.ends = "", 0, np.zeros(0, np.int64)


def encode_digests(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    A NULL text is empty and has no tokens. Texts of up to `chunk` characters are one chunk and are encoded where they
    are read; longer ones are cut, pre-tokenised in parallel and gathered chunk after chunk by one task per text, which
    holds two chunks at a time (or one pre-token longer than those). Repeated rows are encoded each; a NULL doc_id is
    kept; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                digest = Digest(encoder)
                digest.add(encoder.pretokens(text.as_py()))
                rows.append((doc_id, *digest.row()))
            if rows:
                yield batch_of(rows)

    chunk_names = ["doc_id", "text_hash", "part", "parts", "start", "text"]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                key = hashlib.sha256(text.encode()).hexdigest()
                starts = chunk_starts(len(text), chunk, overlap)
                for k in range(0, len(starts), 64):
                    some = starts[k : k + 64]
                    n = len(some)
                    columns = [
                        pa.array([doc_id] * n, pa.int64()),
                        pa.array([key] * n),
                        pa.array(range(k, k + n), pa.int32()),
                        pa.array([len(starts)] * n, pa.int32()),
                        pa.array(some, pa.int64()),
                        pa.array([text[s : s + chunk] for s in some]),
                    ]
                    yield pa.record_batch(columns, chunk_names)

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for batch in batches:
            ends = []
            for part, parts, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(5), strict=True):
                text = text.as_py()
                ends.append(boundaries(text, encoder.pretokens(text), part + 1 == parts).astype(np.int32))
            yield pa.record_batch([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], [*chunk_names, "ends"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        digest = stitcher = None
        done, copies = -1, 1
        for batch in batches:
            rows = []
            for doc_id, _, part, parts, start, text, ends in zip(*(c if k > 4 else c.to_pylist() for k, c in enumerate(batch.columns)), strict=True):
                if part == done and part + 1 < parts:
                    continue  # the same chunk of an equal row
                if part == done:  # the last chunk of an equal row: one more result
                    rows.append((doc_id, *digest.row()))
                    continue
                if part == 0:
                    digest = Digest(encoder)
                    stitcher = Stitcher(encoder, digest.add)
                stitcher.add(start, text.as_py(), ends.values.to_numpy().astype(np.int64), part + 1 == parts)
                done = part
                if part + 1 == parts:
                    rows.append((doc_id, *digest.row()))
            if rows:
                yield batch_of(rows)

    chunk_schema = "doc_id long, text_hash string, part int, parts int, start long, text string"
    chunks = map_arrow(texts.where(is_long), cut_up, chunk_schema).repartition(shuffle_width(spark), "text_hash", "part")
    marked = (
        map_arrow(chunks, pretokenise, chunk_schema + ", ends array<int>")
        .repartition(shuffle_width(spark), "doc_id", "text_hash")
        .sortWithinPartitions("doc_id", "text_hash", "part")
    )
    return map_arrow(texts.where(~is_long), short, schema).union(map_arrow(marked, stitch, schema))
