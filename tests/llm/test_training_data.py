"""Training-data operators against brute force, round trips and held-out rows, with untidy rows."""

import collections
import hashlib
import random
import re
import sys
import zlib
from itertools import batched

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallymark.llm import bpe, chat_tree, induced, int8_tiles, lang_crf, line_crf, packing, passages, quality_trees, simhash, url_filter
from tallymark.llm.common import one_each, sample_runs
from tallymark.llm.queries import QUERIES, RANKS, WORD_TOKENIZER, oracles
from tests.oracle import connect, spark_rows, sql_rows

DOCS = "doc_id long, text string, lang string, source string, h string, d long"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", "x", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma,", "delta.", "é́t", "x|y", "#$%", "'re", "<|endoftext|>"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 50)) for _ in range(9000))
    rows = [(None, None), (1, ""), (2, " \n\t"), (3, "one two three"), (4, long), (5, long), (5, long), (6, "y" * 40_000), (7, None)]
    rows += [(k, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 30)))) for k in range(10, 40)]
    return rows


def test_line_base_counts(spark, texts):
    def brute(x):
        x = x or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cov = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = x.split("\n")
        dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", y)) and y in lines[:k] for k, y in enumerate(lines))
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cov)

    field = line_crf.fit([], np.zeros(0, np.int64))
    got = line_crf.judge(docs(spark, texts), field).collect()
    want = sorted(((i, *brute(t)) for i, t in texts), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.content_share >= line_crf.KEEP_SHARE)
    assert line_crf.judge(docs(spark, []), field).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    from itertools import product

    from tallymark.llm import crf

    score, move = rng.normal(size=(4, 2, 2)), rng.normal(size=(2, 2))
    real = np.array([[True, True], [True, True], [True, True], [True, False]])
    got = crf.viterbi(score, real, move)
    post, _, _ = crf.forward_backward(score, real, move)
    for s, n in ((0, 4), (1, 3)):
        value = {p: sum(score[t, s, p[t]] for t in range(n)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in product((0, 1), repeat=n)}
        assert tuple(got[:n, s]) == max(value, key=value.get)
        total = sum(np.exp(v) for v in value.values())
        for t in range(n):
            assert np.isclose(post[t, s, 1], sum(np.exp(v) for p, v in value.items() if p[t]) / total)


def test_line_field_keeps_good_and_drops_bad(spark, sf_dir):
    got = QUERIES["op1_line_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    judged = [r for r in got if not r.base_failed]
    assert np.mean([r.kept for r in judged if r.quality == 1]) > 0.95
    assert np.mean([r.kept for r in judged if r.quality == 0] or [0]) < 0.3


@pytest.mark.parametrize("block", [5, 2048])
def test_int8_tiles(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(k, (base[k % 12] + rng.normal(size=16) * rng.choice([0, 0.05, 0.3])).astype(np.float32).tolist(), int(k % 3)) for k in range(90)]
    rows += [(100, rows[0][1], 0), (101, rows[0][1], None), (102, None, 0), (103, [], 0), (104, [0.0] * 16, 0), (105, [float("nan")] * 16, 0)]
    rows += [(106, [None] * 16, 0), (107, [1.0] * 3, 0), (108, [2.0] * 3, 0), (109, [1e30] * 3, 0), (None, rows[0][1], 0)]
    got = {r.vec_id: r for r in int8_tiles.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=block).collect()}
    assert len(got) == len(rows)

    def linked(a, b):
        ok = all(x[0] is not None and x[2] is not None and x[1] and all(v is not None and np.isfinite(v) for v in x[1]) and any(x[1]) for x in (a, b))
        if not ok or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        u, v = (np.array(x[1], np.float64) for x in (a, b))
        return u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93

    links = {a[0]: [b[0] for b in rows if b is not a and linked(a, b)] for a in rows}
    root = {a[0]: a[0] for a in rows}
    for _ in rows:
        root = {k: min([r, *(root[x] for x in links[k])]) if k is not None else None for k, r in root.items()}
    for k, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (len(links[k]), root[k], k is not None and root[k] == k)


def test_int8_tiles_keep_types_of_labels_and_components(spark):
    near, far = [1e300, 2e300, 3e300], [3e300, -2e300, 1e300]
    rows = [(1, near, "a,1"), (2, [1.0, 2.0, 3.001], "a,1"), (3, near, "a"), (4, [1e-300, 2e-300, 3e-300], "1,a"), (5, far, "a,1"), (6, near, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("rep", F.lit(5)).withColumn("ids", F.lit("x"))
    got = {r.vec_id: tuple(r)[1:] for r in int8_tiles.near_duplicates(table, block=1).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), **{k: (0, k, True) for k in (3, 4, 5, 6)}}


def test_url_filter_matches_sql_and_rules(spark, sf_dir):
    names, got = spark_rows(QUERIES["op3_url_filter"](spark, sf_dir))
    assert (names, got) == sql_rows(connect(sf_dir), oracles()["op3_url_filter"])
    rows = [(1, None), (2, "no"), (3, "HTTP://WWW.Example.COM/en/a?b#c"), (4, "x://m.b.net/fr/"), (None, "x://"), (6, "x://a.example.com/en/")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.train()).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == ("", "", None)
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert (got[4].rule, got[4].verdict) == ("net/fr/", "block")
    assert (got[6].rule, got[6].verdict) == ("example.com/en/", "block")
    model = url_filter.train()
    held = [("https://free-casino-bets.org/x", "block"), ("https://www.library-history.org/en/5", "allow")]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(held)], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages, model, rules=()).orderBy("page_id").collect()] == [v for _, v in held]


def test_quality_trees(spark, sf_dir, texts):
    table, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_trees.train(table, labels)
    got = quality_trees.score(table, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == r.quality for r in got if r.held_out]) > 0.85
    untidy = quality_trees.score(docs(spark, texts), model).collect()
    assert len(untidy) == len(texts) and len({r.score for r in untidy if r.doc_id in (1, 2, 7)}) == 1
    nothing = quality_trees.train(docs(spark, []), labels)
    assert quality_trees.score(docs(spark, [(1, None)]), nothing).first().score == 0.5


def test_trees_walk_like_their_training():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_trees.boost.train(x, y)
    assert np.mean((model.score(x) > 0.5) == y) > 0.97


def test_bpe_matches_library_and_decodes(spark, texts):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})

    def want(i, t):
        ids = known.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    for chunk, overlap in ((16384, 512), (700, 20)):
        got = bpe.encode_digests(docs(spark, texts), RANKS, public_tokenizers.PATTERN, chunk, overlap).collect()
        assert sorted(map(tuple, got), key=str) == sorted((want(i, t) for i, t in texts), key=str)
    assert bpe.encode_digests(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_stitching():
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(800):
        s = "".join(rng.choice(["'re", "'", "r", "e", " ", "  ", "\n", "1", "é", "!!", "xxxxxxxxxxxx"]) for _ in range(rng.randint(0, 60)))
        chunk, overlap, out = rng.randint(12, 30), rng.randint(5, 11), []
        stitcher, starts = bpe.Stitcher(encoder, out.extend), bpe.chunk_starts(len(s), chunk, overlap)
        for k, a in enumerate(starts):
            part, last = s[a : a + chunk], k + 1 == len(starts)
            stitcher.add(a, part, bpe.boundaries(part, encoder.pretokens(part), last), last)
        assert out == encoder.pretokens(s)


def test_language_field(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = lang_crf.train(table)
    got = lang_crf.identify(table, field).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) > 0.9
    rows = [(1, None), (2, ""), (3, "12 ²½ !"), (4, "the and of with\nles avec une pour"), (None, "der die und")]
    untidy = {r.doc_id: r for r in lang_crf.identify(docs(spark, rows), field).collect()}
    assert all(untidy[k].lang_pred == "und" and untidy[k].score == 0 for k in (1, 2, 3))
    words = lang_crf.label_words(docs(spark, rows[3:4]), field).orderBy("position").collect()
    assert [r.lang for r in words] == ["en"] * 4 + ["fr"] * 4
    assert lang_crf.identify(docs(spark, rows), lang_crf.train(docs(spark, []))).where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("tile", [7, 16384])
def test_simhash(spark, sf_dir, tile, texts, monkeypatch):
    monkeypatch.setattr(simhash, "_CELLS", 16 if tile == 7 else 1 << 22)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(i + 1000 if i is not None else None, t) for i, t in texts]
    got = simhash.near_duplicates(docs(spark, rows), tile=tile).collect()
    prints = [(i, simhash.fingerprint(t)) for i, t in rows]
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=str) == sorted(((i, f"{fp:016x}") for i, fp in prints), key=str)
    component = {r.fingerprint: r.component_id for r in got}
    values = np.array([fp for _, fp in prints], np.uint64)
    least = {}
    for i, fp in prints:
        least[fp] = min(least.get(fp, 10**9), i if i is not None else 10**9)
    while True:
        new = {fp: min(least[int(o)] for o in values[np.bitwise_count(values ^ np.uint64(fp)) <= 4]) for fp in least}
        if new == least:
            break
        least = new
    assert component == {f"{fp:016x}": v for fp, v in least.items()}


def test_fingerprint_definition():
    import xxhash

    text = "The the cat\x0bsat É on a mat the cat sat"
    words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(len(words) - 3)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_chat_tree_round_trip(spark, block, monkeypatch):
    monkeypatch.setattr(chat_tree, "_BLOCK", block)
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (None, 0, None, None), (-9, 1, "a:b\\", "é###</turn>\n"), (-9, 0, "assistant", "")]
    rows += [(k, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {k % 3 if t > 1 else 0}") for k in range(12) for t in range(4)]
    rows += [(3, 1, "assistant", "tie")] * 2
    rows += [(20 + n, t, "user", f"long {t if t < n else -t}") for n in (150, 151, 7, 400) for t in range(150)]  # shared starts
    rows += [(600 + n, t, "user", f"long {t}") for n in (0, 1, 7, 7, 30, 149) for t in range(n)]  # starts of others, in whole
    table = spark.createDataFrame([(*r, r[0], "x") for r in rows], "conv_id long, turn long, role string, text string, key long, path string")
    nodes, members = chat_tree.format_tree(table, RANKS, public_tokenizers.PATTERN)
    got = chat_tree.read_back(nodes, members, RANKS, public_tokenizers.PATTERN).collect()
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        w = want.setdefault(c, [0, "", ""])
        w[0], w[1] = w[0] + 1, w[1] + f"{role or ''}\n{text or ''}\n"
        w[2] += text if role == "assistant" else ""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == {c: (n, sha(a), len(b), sha(b)) for c, (n, a, b) in want.items()}
    tree = sorted(nodes.collect(), key=lambda r: r.offset)
    assert len({bytes(r.key) for r in tree}) == len(tree) < len(rows)
    by, end, before = {bytes(r.key): r for r in tree}, 0, []
    for r in tree:
        assert r.offset == end
        end += r.n_tokens
        chain = [r]
        while len(chain[-1].parent):
            chain.append(by[bytes(chain[-1].parent)])
        seen = [x for c in chain[::-1] for x in range(c.offset, c.offset + c.n_tokens)]
        assert [x for s in r.attends for x in range(s.start, s.end)] == seen
        assert r.position == len(seen) - r.n_tokens
        path = [bytes(c.key) for c in chain[::-1]]
        assert path[:-1] == before[: len(path) - 1]  # depth first
        before = path


def test_induced_order_and_prefixes(monkeypatch):
    rng = random.Random(5)
    for _ in range(250):
        monkeypatch.setattr(induced, "BLOCK", rng.choice([2, 7, 1000]))
        part = bytes(rng.randint(1, rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(0, 120)))
        t = part * rng.randint(1, 3) + b"\0"
        with induced.Scratch(rng.choice([4, 50, 10**6])) as scratch:
            (large, l_lcp), (small, s_lcp) = induced.Level(np.frombuffer(t, np.uint8), scratch).suffixes(True)
            order = sorted(range(len(t)), key=lambda i: t[i:])
            is_small = [i == len(t) - 1 or t[i:] < t[i + 1 :] for i in range(len(t))]
            for got, lcp, kind in ((large, l_lcp, False), (small, s_lcp, True)):
                want = [i for i in order if is_small[i] == kind]
                assert got.tolist() == want
                for k in range(1, len(want)):
                    a, b = t[want[k - 1] :], t[want[k] :]
                    n = next((x for x, (u, v) in enumerate(zip(a, b, strict=False)) if u != v), min(len(a), len(b)))
                    assert lcp[k] == min(n, induced.LIMIT)


@pytest.mark.parametrize("part", [97, 1 << 20])
def test_repeated_passages(spark, part, monkeypatch):
    monkeypatch.setattr(passages, "_PART", part)
    rng = random.Random(6)
    shared = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (199, 200, 201, 420, 900)]
    rows = [(None, None), (1, ""), (2, "x" * 201), (3, "y" * 200), (4, "ab" * 300), (5, "z" * 199)]
    for i in range(10, 50):
        noise = lambda: "".join(rng.choice("qrstuv\n") for _ in range(rng.randint(0, 150)))
        rows.append((i, noise() + "".join(rng.choice(shared) + noise() for _ in range(rng.randint(0, 3)))))
    rows += [(60, rows[-1][1]), (60, rows[-1][1]), (None, rows[-1][1])]
    raws = [(t or "").encode() for _, t in rows]
    times = collections.Counter(r[k : k + 200] for r in raws for k in range(len(r) - 199))
    want = []
    for (i, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r) + 200, bool)
        for k in range(len(r) - 199):
            if times[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        gone = gone[: len(r)]
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        want.append((i, len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    got = [(*r[:5], bytes(r[5])) for r in map(tuple, passages.strip(docs(spark, rows)).collect())]
    assert sorted(got, key=str) == sorted(want, key=str)
    stripped = passages.strip_texts(docs(spark, rows))
    assert stripped.columns == docs(spark, []).columns
    assert sorted((r.doc_id, r.text) for r in stripped.where("doc_id IS NOT NULL").collect()) == sorted(
        (w[0], w[5].decode(errors="ignore")) for w in want if w[0] is not None
    )


def test_plan_of_packing():
    rng = random.Random(7)
    for _ in range(400):
        capacity, counts = rng.choice([7, 12, 30]), collections.Counter()
        for _ in range(rng.randint(0, 30)):
            counts[rng.randint(1, capacity)] += rng.choice([1, 1, 2, 7])
        placed, sequences = collections.Counter(), collections.defaultdict(list)
        for size, a, b, first, per, offset in packing.plan(dict(counts), capacity):
            assert placed[size] == a
            placed[size] += b - a
            for r in range(b - a):
                sequences[first + r // per].append((offset + r % per * size, size))
        assert placed == counts
        for parts in sequences.values():
            ends = np.cumsum([s for _, s in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity


def test_packing(spark, texts):
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    got = packing.pack(docs(spark, texts), WORD_TOKENIZER, buckets=3).collect()
    want = []
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k // 4096, k, len(p := ids[k : k + 4096]), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 4096) + 2
    assert [len(parts) for parts in sequences.values() if (0, 4096) in parts] == [1] * sum(r.length == 4096 for r in got) != []
    assert packing.pack(docs(spark, []), WORD_TOKENIZER).count() == 0


def test_word_ids_equal_the_tokenizers():
    words, tokenizer, rng = packing.WordIds(WORD_TOKENIZER), Tokenizer.from_file(WORD_TOKENIZER), random.Random(8)
    pool = [chr(c) for c in [*range(33, 127), *range(0xA1, 0x180), 0x301, 0x130, 0x3A3]]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcDEÉß") for _ in range(rng.randint(1, 70))) + rng.choice(["", ".", ',"', "..."]) for _ in range(1000)]
    for text, ids in zip(texts, words.batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_are_encoded_many_at_once():
    rng, calls = random.Random(9), 0
    letters = "abcdeé"
    texts = [" ".join("".join(rng.choices(letters, k=9)) + rng.choice(["", ",", "."]) for _ in range(200)) for _ in range(100)]

    def count(frame, event, arg):
        nonlocal calls
        calls += event.endswith("call")

    words = packing.WordIds(WORD_TOKENIZER)
    sys.setprofile(count)
    try:
        got = list(words.batch(texts))
    finally:
        sys.setprofile(None)
    assert calls < 10_000  # of 20,000 words, nearly all distinct: no Python call for each
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoded_words_are_kept_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3000)
    words, tokenizer, rng = packing.WordIds(WORD_TOKENIZER), Tokenizer.from_file(WORD_TOKENIZER), random.Random(10)
    sizes = []
    for _ in range(30):
        texts = [" ".join(rng.choice(["it's", "Été,", "x" * 70, "", "\u4e2d"]) + rng.choice("abcdefgh") * 3 for _ in range(20)) for _ in range(3)]
        for text, ids in zip(texts, words.batch(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        kept = words._known
        sizes.append(kept._words.nbytes + kept._ids.nbytes)
    assert 0 < max(sizes) <= 3 * 3000 and len(set(sizes)) > 1


def test_texts_are_encoded_in_steps_of_bytes():
    rng = random.Random(11)
    rows = [(k, rng.choice([None, "", "é" * rng.randint(1, 30), "x" * 250])) for k in range(200)]
    for width in (1, 7, 200):
        columns = [zip(*part, strict=True) for part in batched(rows, width)]
        batches = [pa.record_batch([pa.array(i, pa.int64()), pa.array(t, pa.string())], ["doc_id", "text"]) for i, t in columns]
        steps = [(i.to_pylist(), t.to_pylist()) for i, t in packing._steps(iter([batches[0].slice(0, 0), *batches]), most=100)]
        assert [r for i, t in steps for r in zip(i, t, strict=True)] == [(k, t or "") for k, t in rows]
        assert all(t and sum(len(x.encode()) for x in t[1:]) < 100 for _, t in steps) and len(steps) > 20
    assert list(packing._steps(iter([]))) == []


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = raw
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id: r for r in done.collect()}
        done = spark.createDataFrame(stage(spark, done, sf_dir).collect(), raw.schema)
        after = {r.doc_id: r for r in done.collect()}
        assert set(after) <= set(before) and done.columns == raw.columns and len(after) == done.count()
        if name.startswith("SimHash"):
            prints = {i: simhash.fingerprint(r.text) for i, r in after.items()}
            values = np.array(list(prints.values()), np.uint64)
            assert all((np.bitwise_count(values ^ np.uint64(v)) <= 4).sum() == 1 for v in values.tolist())
        if name.startswith("suffix"):
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in after.values())
    assert sum(r.piece == 0 for r in p.STAGES[-1][1](spark, done, sf_dir).collect()) == done.count()


def test_sample_runs_cover_the_whole():
    assert sample_runs(0, 200, 50) == [range(0)]
    assert sample_runs(200, 200, 50) == [range(200)]
    runs = sample_runs(1001, 200, 50)
    assert [len(r) for r in runs] == [50] * 4
    assert runs[0].start == 0 and runs[-1].stop == 1001
    assert all(a.stop <= b.start for a, b in zip(runs, runs[1:], strict=False))
    assert sample_runs(10, 4, 25) == [range(4)]


def test_repeated_rows_teach_once(spark):
    rows = [(1, [2.0, 3.0])] * 5 + [(2, [1.0])] + [(1, [2.0, 1.0])]
    got = one_each(spark.createDataFrame(rows, "doc_id long, x array<double>"), "doc_id").collect()
    assert sorted((r.doc_id, r.x) for r in got) == [(1, [2.0, 1.0]), (2, [1.0])]


def test_one_row_of_each_component_whatever_the_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    # two texts with one id; a group named by a clashing id; copies without ids, alone and beside one with an id
    rows = [(1, a), (1, b), (1, b), (2, b), (None, c), (None, c), (None, None), (3, d), (None, d), (4, "")]
    for k in (1, 5):
        kept = simhash.keep_one(docs(spark, rows).repartition(k)).collect()
        assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, a), (1, b), (None, c), (3, d), (4, "")], key=str)
    other = spark.createDataFrame([(1, a, "en", s, "x", 1) for s in "tsu"], DOCS)
    assert len({tuple(simhash.keep_one(other.repartition(k, "source")).first()) for k in (1, 2, 3)}) == 1
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_every_language_with_a_usable_document_teaches(spark):
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, f"the house of number {'abcdef'[i % 6]}", "en") for i in ids[:40]]
    rows += [(i, "das ist ein haus", "de") for i in ids[40:45]] * 60  # five ids, repeated
    rows += [(i, "une maison", "fr") for i in ids[:2]]  # ids that English has too
    rows += [(i, t, "es") for i in ids[50:80] for t in (None, "", "12 !")] + [(ids[80], "la casa", "es")]  # one usable text
    table = spark.createDataFrame([(i, t, lang, "s", "x", 1) for i, t, lang in rows], DOCS)
    assert lang_crf.train(table, n_docs=2).langs == ["de", "en", "es", "fr"]


def test_lines_of_both_kinds_are_told_apart_in_either_order(spark):
    sf_dir = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    field = line_crf.train(table, labels)
    rows = table.join(labels.select("doc_id", "quality"), "doc_id").where("length(text) > 400 AND quality IS NOT NULL").orderBy("doc_id").collect()
    good, bad = ([r.text for r in rows if r.quality == q and r.text.count("\n") >= 3][:12] for q in (1, 0))
    size = lambda t: sum(len(x.encode()) for x in t.split("\n") if x.split())
    assert len(good) > 5 and len(bad) > 2
    for k, g in enumerate(good):
        b = bad[k % len(bad)]
        want = size(g) / (size(g) + size(b))
        for text in (g + "\n" + b, b + "\n" + g):
            assert abs(field.content_shares([text.encode()])[0] - want) < 0.1


def test_switching_sequences_hold_every_line_once():
    rng = np.random.default_rng(3)
    texts = [rng.normal(size=(n, line_crf.FEATURES)) for n in (5, 0, 30, 7)]
    lines, gold = line_crf.mixed(texts, np.array([1, 0, 1, 0]))
    assert [len(x) for x in lines] == [12, 37] and [g.sum() for g in gold] == [5, 30]
    assert np.array_equal(lines[1][gold[1] == 1], texts[2]) and np.array_equal(lines[1][gold[1] == 0], texts[3])
    assert line_crf.mixed(texts[:1], np.array([1])) == ([], [])


def test_url_regression_blocks_hosts_it_has_not_seen(spark):
    listed = {h for url, _ in url_filter.LABELLED for h in url.split("/")[2].split(".")}
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = {p for r in rows.select(url_filter.host_and_path(F.col("url"))[0].alias("h")).distinct().collect() for p in r.h.split(".")}
    assert not {h for h in hosts & listed if len(h) > 4 and h != "example"}
    urls = ["http://casino-win.example/", "https://x.free-bets.test/a", "http://adult-x.example.net/en/1", "http://cheap-pills.test", None, "nothing", "",
            "https://museum-of-nature.test/a?b", "http://citylibrary.example/c", "http://" + "a" * 50_000 + "/" + "b" * 50_000]
    table = spark.createDataFrame([(k, u, "h", "p", 1) for k, u in enumerate(urls)] + [(0, urls[0], "h", "p", 1)], "page_id long, url string, host string, path string, grams int")
    got = [(r.page_id, r.verdict) for r in url_filter.judge(table, url_filter.train()).collect()]
    assert sorted(got)[:5] == [(0, "block"), (0, "block"), (1, "block"), (2, "block"), (3, "block")]
    assert {v for k, v in got if k in (4, 5, 6, 7, 8)} == {"allow"}
    assert url_filter.judge(table.where("false"), url_filter.train()).count() == 0


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(lang_crf, "MAX_LANGS", 3)
    ids = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(ids[8 * k + j], f"word{k} text{k} of{k}", f"l{k}") for k in range(6) for j in range(3 + k)]
    table = spark.createDataFrame([(i, t, lang, "s", "x", 1) for i, t, lang in rows], DOCS)
    assert lang_crf.train(table, n_docs=2).langs == ["l3", "l4", "l5"]


def untidy(spark, sf_dir):
    """Documents with NULLs, empty and repeated rows, clashing ids, and columns that are hard to carry along."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    more = raw.withColumns({"_text": F.lit("mine"), "_row": F.lit(7), "text_key": F.lit(1), "a.b": F.lit("dot"), "m": F.create_map(F.lit("k"), F.col("doc_id"))})
    nulls = more.limit(3).withColumns({c: F.lit(None).cast(more.schema[c].dataType) for c in ("doc_id", "text", "lang", "source", "n_chars", "_text")})
    empty = more.limit(1).withColumn("text", F.lit(""))
    return more.unionByName(nulls).unionByName(empty).unionByName(more.limit(5)).unionByName(more.limit(5).withColumn("doc_id", F.lit(1).cast("long")))


def test_stages_carry_any_columns(spark, sf_dir):
    table = untidy(spark, sf_dir)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert {(r["_text"], r["_row"], r["a.b"]) for r in kept.collect()} <= {("mine", 7, "dot"), (None, 7, "dot")}
    done = passages.strip_texts(kept)
    assert done.columns == table.columns and done.count() == kept.count()
    assert {r["a.b"] for r in done.collect()} == {"dot"} and all(r.m for r in done.collect())


def test_pipeline_runs_on_untidy_and_on_empty_documents(spark, sf_dir, tmp_path):
    import corpus_pipeline as p

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, table in (("untidy", untidy(spark, sf_dir)), ("empty", untidy(spark, sf_dir).where("false"))):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = p.run(spark, folder)
        assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
        assert (out.count() > 0) == (name == "untidy")


def test_empty_tables_give_empty_results(spark, sf_dir):
    none = docs(spark, [])
    full, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert quality_trees.score(none, quality_trees.train(full, labels)).count() == 0
    assert lang_crf.identify(none, lang_crf.train(full)).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert passages.strip(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, rows int, pair string")
    assert int8_tiles.near_duplicates(vectors).count() == 0
    said = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_tree.read_back(*chat_tree.format_tree(said, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0
