"""Quality rules: a conditional random field labels every line content or boilerplate; the content share decides.

Lines of a whole text form one sequence; Viterbi decoding labels them together, so a doubtful line follows its
neighbours. A text is kept if the base rules pass and enough of its characters lie in content lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm import crf
from tallymark.llm.common import held_out, map_arrow, one_each, sample_runs

#: Most labelled documents, and lines of each, that the field learns from; documents are picked by a hash of the id.
TRAIN_DOCS, TRAIN_LINES, TRAIN_RUN = 3000, 200, 50
RUN_LINES = 8  # of one label in a row, on average, in the sequences that teach switches
KEEP_SHARE, MIN_WORDS, MAX_REPEAT = 0.5, 50, 50
_SYMBOLS = b"#*$%&|<>"
_CLASS = np.zeros((256, 5))  # symbols, digits, capitals, other marks, sentence ends
for _k, _chars in enumerate((b"#*$%&|<>{}[]\\^_=+~@", b"0123456789", bytes(range(65, 91)), b",;:()\"'-/", b".!?")):
    _CLASS[np.frombuffer(_chars, np.uint8), _k] = 1
FEATURES = 14


@dataclass
class Base:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    def failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT * self.n_words


def base(text: str, raw: bytes) -> Base:
    words = raw.split()  # bytes: parted by the six ASCII white spaces only
    n = len(words)
    dup = 0
    if b"\n" in raw:
        seen: set[bytes] = set()
        for line in raw.split(b"\n"):
            if line in seen:
                dup += bool(line.strip())
            else:
                seen.add(line)
    repeat = 0
    if n > 3:
        known = {w: k for k, w in enumerate(dict.fromkeys(words))}
        code = np.fromiter(map(known.__getitem__, words), np.int64, n)
        two = code[:-1] * len(known) + code[1:]
        if len(known) < 1 << 20:
            three = two[:-1] * len(known) + code[2:]
        else:  # renumbered pairs, so that triples fit 64 bits
            three = np.unique(two, return_inverse=True)[1][:-1] * len(known) + code[2:]
        order = np.argsort(three, kind="stable")
        s = three[order]
        equal = s[1:] == s[:-1]
        again = np.zeros(n - 2, bool)
        again[order[1:][equal]] = True
        again[order[:-1][equal]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeat = int(covered.sum())
    spaces = sum(text.count(c) for c in " \t\n\r\v\f")
    return Base(n, len(text) - spaces, sum(raw.count(c) for c in _SYMBOLS), dup, repeat)


def line_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of the lines that hold a word, in order."""
    lines = [(x, w) for x in raw.split(b"\n") if (w := x.split())]
    if not lines:
        return np.zeros((0, FEATURES)), np.zeros(0)
    size = np.array([len(x) for x, _ in lines])
    n = np.array([len(w) for _, w in lines])
    distinct = np.array([len(set(w)) for _, w in lines])
    byte = np.frombuffer(b"".join(x for x, _ in lines), np.uint8)
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    kinds = np.stack([np.add.reduceat(_CLASS[:, k][byte], at) for k in range(_CLASS.shape[1])], axis=1)
    first: dict[bytes, int] = {}
    dup = np.array([first.setdefault(x, k) != k for k, (x, _) in enumerate(lines)])
    out = np.empty((len(lines), FEATURES))
    out[:, 0] = 1
    out[:, 1] = np.log1p(n) / 4
    out[:, 2:4] = np.minimum(kinds[:, :2] / n[:, None], 4)
    out[:, 4] = kinds[:, 2] / size
    out[:, 5:7] = np.minimum(kinds[:, 3:] / n[:, None], 2)
    out[:, 7] = (1 - distinct / n) * np.minimum(n, 20) / 20
    out[:, 8] = np.minimum(size / n, 40) / 10
    out[:, 9] = dup
    out[:, 10] = n <= 2
    out[:, 11] = kinds[:, 0] > 0
    out[:, 12] = distinct * 2 < n
    out[:, 13] = [x.rstrip().endswith((b".", b"!", b"?")) for x, _ in lines]
    return out, size.astype(float)


@dataclass
class Field:
    """Weights (feature, label) and moves (label, label); label 1 is content, 0 boilerplate."""

    weight: np.ndarray
    move: np.ndarray

    def content_shares(self, raws: list[bytes]) -> np.ndarray:
        """Share of each text's line bytes that Viterbi decoding labels content; 0 without a line that holds a word."""
        parts = [line_features(r) for r in raws]
        lengths = np.array([len(s) for _, s in parts], np.int64)
        if not lengths.sum():
            return np.zeros(len(raws))
        score = np.concatenate([f for f, _ in parts]) @ self.weight
        size = np.concatenate([s for _, s in parts])
        start = np.cumsum(lengths) - lengths
        content = np.zeros(len(size))
        for group in crf.batches(lengths):
            at, real = crf.padded(start, lengths, group)
            content[at[real]] = crf.viterbi(score[at], real, self.move)[real]
        owner = np.repeat(np.arange(len(raws)), lengths)
        total = np.bincount(owner, size, len(raws))
        return np.bincount(owner, size * content, len(raws)) / np.maximum(total, 1)


def mixed(sequences: list[np.ndarray], labels: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sequences that switch: runs of lines of a boilerplate and of a content text in turn, with a label for each line.

    Every text is met once, texts of the smaller class as often as it takes; every second sequence begins with content.
    Lengths of runs are drawn (`RUN_LINES` on average), the same on every call.
    """
    rng = np.random.default_rng(0)
    bad, good = ([k for k in range(len(sequences)) if labels[k] == c and len(sequences[k])] for c in (0, 1))
    lines, gold = [], []
    for k in range(max(len(bad), len(good)) if bad and good else 0):
        pair = [sequences[bad[k % len(bad)]], sequences[good[k % len(good)]]]
        at, side, parts, marks = [0, 0], k % 2, [], []
        while at[0] < len(pair[0]) or at[1] < len(pair[1]):
            run = pair[side][at[side] : at[side] + rng.geometric(1 / RUN_LINES)]
            at[side] += len(run)
            parts.append(run)
            marks.append(np.full(len(run), side))
            side = 1 - side
        lines.append(np.concatenate(parts))
        gold.append(np.concatenate(marks))
    return lines, gold


def fit(sequences: list[np.ndarray], labels: np.ndarray, rounds: int = 150, l2: float = 1e-3, rate: float = 0.1) -> Field:
    """Maximum likelihood. Lines of a text are labelled as the text, classes weigh the same; texts of one label alone would
    teach that labels never change, so sequences that switch (`mixed`) teach too. No rows: all content."""
    field = Field(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    sizes = np.array([len(s) for s in sequences], np.int64)
    if len(set(labels[sizes > 0].tolist())) < 2:
        field.weight[0, 1] = 1.0
        return field
    weigh = len(labels) / (2 * np.maximum(np.bincount(labels, minlength=2), 1))
    lines, gold = mixed(sequences, labels)
    kind = np.concatenate([labels, np.full(len(lines), 2)])
    weigh = np.append(weigh, 1.0)
    y = np.concatenate([np.repeat(labels, sizes), *gold])
    sequences = [*sequences, *lines]
    lengths = np.array([len(s) for s in sequences], np.int64)
    x = np.concatenate(sequences)
    start = np.cumsum(lengths) - lengths
    groups = []
    for g in crf.batches(lengths):
        for k in range(3):
            if len(part := g[kind[g] == k]):
                groups.append((*crf.padded(start, lengths, part), weigh[k]))
    adam = crf.Adam(field.weight.shape, field.move.shape, rate=rate)
    for _ in range(rounds):
        gw, gm = l2 * len(y) * field.weight, l2 * len(y) * field.move
        score = x @ field.weight
        for at, real, w in groups:
            post, pair, _ = crf.forward_backward(score[at], real, field.move)
            rows = at[real]
            diff = post[real]
            diff[np.arange(len(rows)), y[rows]] -= 1
            gw += w * (x[rows].T @ diff)
            both = real[:-1] & real[1:]
            np.subtract.at(pair, (y[at[:-1][both]], y[at[1:][both]]), 1)
            gm += w * pair
        adam.step([field.weight, field.move], [gw / len(y), gm / len(y)])
    return field


def train(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS, n_lines: int = TRAIN_LINES) -> Field:
    """Field from a bounded sample of labelled documents outside the held-out fold (see `fit`).

    Half of the sample is of either class where there are enough. At most `n_lines` lines of a sampled document teach,
    in runs spread over the whole text; the limit is for learning only. A document that is there several times teaches
    once. Ids labelled both ways and NULL ids or labels teach nothing.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .select("doc_id", "quality")
    )
    picked = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs // 2) for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (line_features((t.as_py() or "").encode())[0] for t in batch.column(2))
            rows = [np.concatenate([x[r.start : r.stop] for r in sample_runs(len(x), n_lines, TRAIN_RUN)]).ravel().tolist() for x in found]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "quality", "lines"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("doc_id", "quality", "text")
    got = sorted(one_each(map_arrow(sample, run, "doc_id long, quality int, lines array<double>"), "doc_id").collect())
    return fit([np.array(r.lines).reshape(-1, FEATURES) for r in got], np.array([r.quality for r in got], np.int64))


def judge(docs: DataFrame, field: Field, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, content_share, kept.

    NULL and empty texts have no words and fail the base rules; a text of one line is a sequence of one. Whole texts are
    read. Repeated rows and NULL ids are judged like others; other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            raws = [t.encode() for t in texts]
            found = [base(t, r) for t, r in zip(texts, raws, strict=True)]
            failed = np.array([b.failed() for b in found])
            share = field.content_shares(raws)
            columns = [pa.array([getattr(b, k) for b in found], pa.int64()) for k in Base.__dataclass_fields__]
            yield pa.record_batch(
                [batch.column(0), *columns, pa.array(failed), pa.array(share), pa.array(~failed & (share >= keep_share))],
                ["doc_id", *Base.__dataclass_fields__, "base_failed", "content_share", "kept"],
            )

    longs = ", ".join(f"{k} long" for k in Base.__dataclass_fields__)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(texts, run, f"doc_id long, {longs}, base_failed boolean, content_share double, kept boolean")
