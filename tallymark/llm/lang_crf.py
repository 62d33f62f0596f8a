"""Language ID: a conditional random field labels every word of code-switched text, forward-backward gives posteriors.

The words of a line are a sequence; a word's evidence is a sum of learned weights of its affixes, character n-grams and,
for frequent words, a lexicon entry; learned transitions say how often languages switch between neighbours. A text's
language is the label with the largest sum of word posteriors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.llm import crf
from tallymark.llm.common import held_out, keep_rows, map_arrow, one_each, sample_runs

#: Most documents per language, and words of each, that the field learns from; documents are picked by a hash of the id.
TRAIN_DOCS, TRAIN_WORDS, TRAIN_RUN = 200, 150, 25
LEXICON, BITS, MAX_LANGS, CACHE = 400, 16, 500, 200_000
UNKNOWN, KEEP_FROM = "und", 0.4
_TOKEN = re.compile(r"[^\W\d_]+|\n")
_FIRST, _LAST = "\x02", "\x03"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _hashed(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p, m in zip(parts, _MIX, strict=False):
        h = (h ^ p) * m
        h ^= h >> np.uint64(29)
    return ((h * _MIX[0]) >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the word each belongs to: affixes of one to three letters, n-grams of two and three, lexicon."""
    low = [w.lower() for w in words]
    code = np.frombuffer("".join(_FIRST + w + _LAST for w in low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, low), np.int64, len(low)) + 2
    owner = np.repeat(np.arange(len(low)), size)
    last = np.repeat(np.cumsum(size), size) - np.arange(len(code)) - 1  # characters that follow within the word
    found, of = [], []
    for n in (2, 3):
        at = np.flatnonzero(last >= n - 1)
        found.append(_hashed([code[at + k] for k in range(n)]))
        of.append(owner[at])
    four = np.flatnonzero(last >= 3)
    four = four[(code[four] == ord(_FIRST)) | (code[four + 3] == ord(_LAST))]
    found.append(_hashed([code[four + k] for k in range(4)]))
    of.append(owner[four])
    entry = np.fromiter((lexicon.get(w, -1) for w in low), np.int64, len(low))
    known = np.flatnonzero(entry >= 0)
    found.append(entry[known] + (1 << BITS))
    of.append(known)
    return np.concatenate(found), np.concatenate(of)


@dataclass
class Field:
    langs: list[str]
    lexicon: dict[str, int]
    weight: np.ndarray
    move: np.ndarray

    def evidence(self, words: list[str]) -> np.ndarray:
        feature, owner = word_features(words, self.lexicon)
        return np.stack([np.bincount(owner, self.weight[feature, k], len(words)) for k in range(len(self.langs))], axis=1)


class Labeller:
    """Applies a field to texts; the evidence of words already met is kept, up to a bound."""

    def __init__(self, field: Field):
        self.field = field
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {"\n": 0}
        self.rows = np.zeros((1 << 14, len(self.field.langs)), np.float32)
        self.counts = np.zeros(1 << 14, bool)  # whether a token has a letter

    def _learn(self, tokens: set[str]) -> None:
        new = [w for w in tokens if w not in self.known]
        if not new:
            return
        at, end = len(self.known), len(self.known) + len(new)
        while end > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.rows[at:end] = self.field.evidence(new)
        self.counts[at:end] = [any(map(str.isalpha, w)) for w in new]
        self.known.update(zip(new, range(at, end), strict=True))

    def posteriors(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Tokens (words and line ends) of each text with the label posteriors of each; rows of line ends are zero."""
        if not texts:
            return
        tokens = [_TOKEN.findall(t) for t in texts]
        if not self.field.langs:
            yield from ((t, np.zeros((len(t), 0))) for t in tokens)
            return
        if len(self.known) > CACHE:
            self._clear()
        self._learn(set().union(*tokens))
        ids = np.concatenate([np.fromiter(map(self.known.__getitem__, t), np.int64, len(t)) for t in tokens])
        ends = np.cumsum([len(t) for t in tokens])
        breaks = ids == 0
        after = np.zeros(len(ids) + 1, bool)  # a sequence starts after a line end and at a text's start
        after[0] = True
        after[1:] |= breaks
        after[ends] = True
        number = np.cumsum(after[:-1]) - 1
        lengths = np.bincount(number[~breaks], minlength=int(number[-1]) + 1 if len(number) else 0)
        start = np.flatnonzero(after[:-1])
        post = np.zeros((len(ids), len(self.field.langs)))
        for group in crf.batches(lengths):
            at, real = crf.padded(start, lengths, group)
            p, _, _ = crf.forward_backward(self.rows[ids[at]].astype(np.float64), real, self.field.move)
            post[at[real]] = p[real]
        post[~self.counts[ids]] = 0
        for k, t in enumerate(tokens):
            yield t, post[ends[k] - len(t) : ends[k]]

    def languages(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its share of the posteriors per text; ties go to the language first in order."""
        langs, score = [], np.zeros(len(texts))
        for k, (_, post) in enumerate(self.posteriors(texts)):
            total = post.sum(axis=0)
            if len(total) == 0 or not total.sum() > 0:
                langs.append(UNKNOWN)
                continue
            best = int(total.argmax())
            langs.append(self.field.langs[best])
            score[k] = min(1.0, total[best] / total.sum())
        return langs, score


def fit(samples: list[tuple[str, list[str]]], rounds: int = 25, rate: float = 0.15, l2: float = 1e-6, lexicon_size: int = LEXICON) -> Field:
    """Field from (language, tokens with line ends) samples.

    Every word of a sample carries its document's language. Those documents hardly switch, so every fourth line is
    joined to the next line of another language: transitions are learned from both kinds.
    """
    langs = sorted({lang for lang, _ in samples})
    number = {lang: k for k, lang in enumerate(langs)}
    counts = [Counter() for _ in langs]
    lines: list[tuple[int, list[str]]] = []
    for lang, tokens in samples:
        counts[number[lang]].update(w.lower() for w in tokens if w != "\n")
        for line in "\x00".join(tokens).split("\x00\n"):
            if words := [w for w in line.split("\x00") if w and w != "\n"]:
                lines.append((number[lang], words))
    lexicon: dict[str, int] = {}
    for c in counts:
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]:
            lexicon.setdefault(w, len(lexicon))
    field = Field(langs, lexicon, np.zeros(((1 << BITS) + len(lexicon), len(langs))), np.zeros((len(langs), len(langs))))
    lines = [lines[k] for k in np.random.default_rng(7).permutation(len(lines))]
    sequences: list[tuple[list[str], list[int]]] = []
    k = 0
    while k < len(lines):
        label, words = lines[k]
        if k % 4 == 0 and k + 1 < len(lines) and lines[k + 1][0] != label:
            sequences.append((words + lines[k + 1][1], [label] * len(words) + [lines[k + 1][0]] * len(lines[k + 1][1])))
            k += 2
        else:
            sequences.append((words, [label] * len(words)))
            k += 1
    if len(langs) < 2:
        return field
    vocabulary = {w: n for n, w in enumerate(sorted({w for s, _ in sequences for w in s}))}
    feature, owner = word_features(list(vocabulary), lexicon)
    ids = np.array([vocabulary[w] for s, _ in sequences for w in s])
    gold = np.array([y for _, ys in sequences for y in ys])
    lengths = np.array([len(s) for s, _ in sequences])
    start = np.cumsum(lengths) - lengths
    groups = [crf.padded(start, lengths, g) for g in crf.batches(lengths)]
    observed = np.zeros_like(field.move)
    within = np.ones(len(ids), bool)
    within[start] = False
    np.add.at(observed, (gold[:-1][within[1:]], gold[1:][within[1:]]), 1)
    adam = crf.Adam(field.weight.shape, field.move.shape, rate=rate)
    for _ in range(rounds):
        rows = np.stack([np.bincount(owner, field.weight[feature, k], len(vocabulary)) for k in range(len(langs))], axis=1)
        diff, gm = np.zeros((len(ids), len(langs))), 1.0 * field.move - observed
        for at, real in groups:
            post, pair, _ = crf.forward_backward(rows[ids[at]], real, field.move)
            diff[at[real]] = post[real]
            gm += pair
        diff[np.arange(len(ids)), gold] -= 1
        gw = l2 * len(ids) * field.weight
        for k in range(len(langs)):
            per_word = np.bincount(ids, diff[:, k], len(vocabulary))
            gw[:, k] += np.bincount(feature, per_word[owner], len(gw))
        adam.step([field.weight, field.move], [gw / len(ids), gm / len(ids)])
    return field


def train(docs: DataFrame, n_docs: int = TRAIN_DOCS, n_words: int = TRAIN_WORDS) -> Field:
    """Field from `n_docs` documents of every language outside the held-out fold (all if there are fewer), `n_words`
    tokens of each.

    The tokens of a longer text are runs spread over all of it. A document that is there several times teaches once, an
    id with several languages once in each. Only text and lang teach; rows without a letter, a language or an id do not.
    Of more than MAX_LANGS languages those with most ids teach (ties by name); documents in others get one of these.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    # distinct ids, so that repeated rows take no one's place
    ids = rows.select("lang", "doc_id").distinct()
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    # a hash leaves four times as many candidates as are drawn, whatever the number of partitions; only those are ranked
    hashed = F.xxhash64("doc_id")
    share = F.pmod(F.xxhash64(F.lit("teacher"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    few = ids.join(F.broadcast(sizes), "lang").where(share * F.col("n") < 4 * n_docs + 64)
    drawn = F.row_number().over(W.partitionBy("lang").orderBy(hashed, "doc_id"))
    picked = few.withColumn("place", drawn).where(F.col("place") <= n_docs).select("lang", "doc_id")
    sample = rows.join(F.broadcast(picked), ["lang", "doc_id"], "left_semi").select("doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = []
            for words in (_TOKEN.findall(t.as_py() or "") for t in batch.column(1)):
                runs = [words[r.start : r.stop] for r in sample_runs(len(words), n_words, TRAIN_RUN)]
                tokens.append([w for k, r in enumerate(runs) for w in (["\n", *r] if k else r)])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(tokens, pa.list_(pa.string()))], ["doc_id", "lang", "tokens"])

    got = sorted(one_each(map_arrow(sample, run, "doc_id long, lang string, tokens array<string>"), "doc_id", "lang").collect())
    return fit([(r.lang, r.tokens) for r in got])


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, lang_pred, score (share of the posteriors, 0 to 1).

    A NULL text or one without letters is `und` with score 0, and so is every text if nothing could be learned. Whole
    texts are read; repeated rows and NULL ids (not held out) are labelled like others; other columns are ignored; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(field)
        for batch in batches:
            langs, score = labeller.languages([t.as_py() or "" for t in batch.column(1)])
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = map_arrow(texts, run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, position, word, lang, score): the best label of every word that has a letter, for code-switched text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(field)
        for batch in batches:
            for doc_id, (tokens, post) in zip(batch.column(0), labeller.posteriors([t.as_py() or "" for t in batch.column(1)]), strict=True):
                at = np.flatnonzero(post.sum(axis=1) > 0) if post.size else np.zeros(0, np.int64)
                best = post[at].argmax(axis=1) if len(at) else at
                yield pa.record_batch(
                    [
                        pa.array([doc_id.as_py()] * len(at), pa.int64()),
                        pa.array(np.searchsorted(np.flatnonzero([w != "\n" for w in tokens]), at), pa.int64()),
                        pa.array([tokens[k] for k in at], pa.string()),
                        pa.array([field.langs[b] for b in best], pa.string()),
                        pa.array(post[at, best] if len(at) else np.zeros(0)),
                    ],
                    ["doc_id", "position", "word", "lang", "score"],
                )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(texts, run, "doc_id long, position long, word string, lang string, score double")


def keep_known(docs: DataFrame, field: Field, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of `docs` with a recognised language whose share reaches `keep_from`, with all their columns.

    NULL texts and texts without a letter have no language and go; repeated rows are judged alike, NULL ids do not matter, and
    an empty table gives an empty result.
    """

    def keep() -> Callable[[pa.Array], pa.Array]:
        labeller = Labeller(field)

        def known(texts: pa.Array) -> pa.Array:
            langs, score = labeller.languages([t.as_py() or "" for t in texts])
            return pa.array([lang != UNKNOWN and s >= keep_from for lang, s in zip(langs, score, strict=True)], pa.bool_())

        return known

    return keep_rows(docs, "text", keep)
