"""Quality classifier: boosted trees over statistics of whole texts, learned from a bounded sample of labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm import boost
from tallymark.llm.common import held_out, keep_rows, map_arrow, one_each

#: Most labelled rows the trees learn from; they are picked by a hash of the id.
TRAIN_ROWS, KEEP_FROM = 8000, 0.7
_CLASS = np.zeros((256, 4), np.int64)  # symbols, digits, capitals, punctuation
for _k, _chars in enumerate((b"#*$%&|<>{}[]\\~^_=+@", b"0123456789", bytes(range(65, 91)), b",;:.!?")):
    _CLASS[np.frombuffer(_chars, np.uint8), _k] = 1
_END = np.isin(np.arange(256), list(b".!?"))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
_LONE = frozenset(bytes([c]) for c in b"|*-#>=+~")


def statistics(text: str | None) -> list[float]:
    """Numbers about a whole text; all zero for NULL and for texts without a word."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    known = {w: k for k, w in enumerate(dict.fromkeys(words))}
    code = np.fromiter(map(known.__getitem__, words), np.int64, n)
    size = np.fromiter(map(len, known), np.int64, len(known))
    lone = np.fromiter(map(_LONE.__contains__, known), bool, len(known))
    counts = np.bincount(code)
    same = code[1:] == code[:-1]
    pairs = np.sort(code[1:] * len(known) + code[:-1])
    at = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if n > 1 else np.zeros(0, np.int64)
    pairs = np.diff(at, append=len(pairs))
    share = counts / n
    mean = (size * share).sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    byte = np.frombuffer(raw, np.uint8)
    symbols, digits, capitals, marks = np.bincount(byte, minlength=256) @ _CLASS
    ends = (_END[byte[:-1]] & _SPACE[byte[1:]]).sum() + _END[byte[-1]]
    return [
        float(n),
        float(mean),
        float(np.sqrt(max(0.0, (size * size * share).sum() - mean * mean))),
        float(size.max()),
        len(raw) / n,
        len(known) / n,
        float(share.max()),
        float(-(share * np.log(share)).sum() / np.log(n + 1)),
        float(same.mean()) if n > 1 else 0.0,
        float(pairs[pairs > 1].sum() / (n - 1)) if n > 1 else 0.0,
        float(pairs.max() / (n - 1)) if n > 1 else 0.0,
        float(len(lines)),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        symbols / len(raw),
        digits / len(raw),
        capitals / len(raw),
        ends / n,
        marks / n,
        float(share[lone].sum()),
        float(share[size <= 3].sum()),
        float(share[size >= 12].sum()),
    ]


NAMES = (
    "words word_mean word_std word_max bytes_per_word distinct top_word entropy same_as_last repeated_pairs top_pair lines words_per_line "
    "equal_lines symbols digits capitals sentence_ends punctuation lone_symbols short_words long_words"
).split()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in column], np.float64).reshape(len(column), len(NAMES))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> boost.Trees:
    """Trees from at most about `rows` labelled documents outside the held-out fold, the ids of least hash.

    Rows of `labels` with a NULL id or quality, and ids labelled both ways, teach nothing. The sample is joined by a
    broadcast of ids, whose number `rows` bounds; its statistics, not its texts, reach the driver, one row for each id.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            stats = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(NAMES), np.int32), pa.array(x.ravel()))
            yield pa.record_batch([batch.column(0), batch.column(1), stats], ["doc_id", "quality", "stats"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = texts.join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")
    got = sorted(one_each(map_arrow(sample, run, "doc_id long, quality int, stats array<double>"), "doc_id").collect())
    x = np.array([r.stats for r in got], np.float64).reshape(len(got), len(NAMES))
    return boost.train(x, np.array([r.quality for r in got], np.float64))


def score(docs: DataFrame, model: boost.Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, score, predicted (1 if score >= keep_from).

    NULL, empty and word-free texts share one vector of zeros and get its score; texts are read whole. A NULL doc_id is
    not held out. Repeated rows are scored each; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = map_arrow(texts, run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= keep_from).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: boost.Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of `docs` whose score reaches `keep_from`, with all their columns.

    NULL texts are scored as empty ones; repeated rows are judged alike, NULL ids do not matter, and an empty table gives an
    empty result.
    """
    return keep_rows(docs, "text", lambda: lambda texts: pa.array(model.score(_matrix(texts)) >= keep_from))
