"""Periodic runs of words: an online sparse dynamic program over diagonals, dropping the repeats of each run.

A diagonal is a lag q; its match length at word i is the number of consecutive words, up to i, that equal the word q
places before. Only diagonals that an earlier occurrence touches are active, so the program is sparse; a diagonal that
ends long enough emits its run at once. Frequent words would touch nearly every diagonal, so occurrences of grams stand
for those of words: a run of smallest period q with at least 4 q words holds, for a gram of g words with q <= g < 2 q, at
each gram end from its word q + g - 1 on an earlier occurrence at lag q, and none at a smaller lag (two occurrences
closer than q would give the run a smaller period, by the theorem on two periods). So on the level of g = 1, 2, 4, ...
the latest earlier occurrence of a gram increments the diagonals of the lags in (g / 2, g], which is every lag once, one
increment for each word and level. Conversely such a stretch of increments over 4 q words or more is a run with smallest
period q, for the same reason. Nothing is approximate: gram numbers are exact ranks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import map_arrow

LEAST_WORDS, PERIODS = 6, 4  # a run has at least max(LEAST_WORDS, PERIODS * period) words
STEP_WORDS = 1 << 18  # short texts are worked on together, up to so many words

RESULT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _numbers(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers of all words, text after text: equal in one text for equal words, different in different texts."""
    out, used = [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        out.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + used)
        used += len(seen)
    return np.concatenate(out)


def find_runs(words: np.ndarray, longest: int | None = None) -> np.ndarray:
    """(start, length, period) of every run in the numbers of consecutive words, by start, then period.

    `words` may be several texts one after another whose numbers differ, since then no diagonal crosses a border;
    `longest` is the size of the longest of them.
    """
    found, g, n = [], 1, len(words)
    longest = n if longest is None else longest
    gram = words  # gram[k] >= 0 numbers words k .. k + g - 1 among those that may occur twice
    while 2 * g <= longest:  # a lag of this level is above g / 2, its run at least four times as long
        at = np.flatnonzero(gram >= 0)
        order = at[np.argsort(gram[at], kind="stable")]
        same = gram[order[1:]] == gram[order[:-1]]
        earlier, later = order[:-1][same], order[1:][same]
        if not len(later):
            break
        lag = later - earlier
        q_at = np.zeros(len(gram), np.int64)
        fits = (2 * lag > g) & (lag <= g)
        q_at[later[fits]] = lag[fits]
        starts = np.concatenate([[0], np.flatnonzero(q_at[1:] != q_at[:-1]) + 1])
        counts = np.diff(np.concatenate([starts, [len(q_at)]]))
        q = q_at[starts]
        first, count, q = starts[q > 0], counts[q > 0], q[q > 0]
        length = count + q + g - 1
        enough = length >= np.maximum(LEAST_WORDS, PERIODS * q)
        found.append(np.stack([first - q, length, q], axis=1)[enough])
        # a gram of twice the size occurs twice only where both its halves do
        twice = np.zeros(len(gram), bool)
        twice[earlier] = twice[later] = True
        both = np.flatnonzero(twice[:-g] & twice[g:])
        if not len(both):
            break
        codes = gram[both] * (int(gram.max()) + 1) + gram[both + g]
        gram = np.full(len(gram) - g, -1)
        gram[both] = np.unique(codes, return_inverse=True)[1]
        g *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each of n places, where the id's crc32 ends in 0 as a decimal; else None."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _digests(words: list[bytes], runs: np.ndarray) -> tuple:
    """The result columns of one text after doc_id."""
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(drop[:-1]) > 0
    kept = [words[k] for k in np.flatnonzero(~dropped)] if len(runs) else words
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    longest = (None,) * 4
    if len(runs):
        s, n, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        longest = (s, n, q, 1000 * n // q)
    return (len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _together(ids: list, texts: list[list[bytes]]) -> Iterator[tuple]:
    """Result rows of several texts, whose words are numbered as one sequence that differs between texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if sizes.sum() == 0:
        for i, words in zip(ids, texts, strict=True):
            yield (i, *_digests(words, np.zeros((0, 3), np.int64)))
        return
    text_no = np.repeat(np.arange(len(texts)), sizes)
    runs = find_runs(_numbers(texts), int(sizes.max()))
    begin = np.cumsum(sizes) - sizes
    of = text_no[runs[:, 0]]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    runs[:, 0] -= begin[of]
    for k, (i, words) in enumerate(zip(ids, texts, strict=True)):
        yield (i, *_digests(words, runs[cuts[k] : cuts[k + 1]]))


def detect(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_runs, the longest run, digests of all runs and of the collapsed text.

    Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch of words with smallest period q and at least max(6, 4 q) words that
    cannot be extended; its words after the first q are dropped from the collapsed text. The longest run is null in four
    columns where there is none; ties go to the smallest start, then period. NULL and empty texts have no words and no
    runs, and digests of nothing. Every row is judged by itself, repeated rows and NULL ids included (with `plant`, a NULL
    id's words stay as they are); other columns are ignored; an empty table gives an empty result. One text is worked on
    by one task, in memory in proportion to its words.

    With `plant`, the words of every text whose crc32 of the id (as text) ends in 0 are first made periodic from a place on
    that the same number gives, so that long periods occur at every scale.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64())]
            + [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
            + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
        )

        def out(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            columns = zip(*_together(ids, texts), strict=True)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            ids, texts, n = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                words = text.split() if text else []  # bytes: splits at exactly the six ASCII white space characters
                if plant and (at := planted(doc_id, len(words))) is not None:
                    words = [words[k] for k in at]
                ids.append(doc_id)
                texts.append(words)
                n += len(words)
                if n >= STEP_WORDS:
                    yield out(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield out(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, run, RESULT)
