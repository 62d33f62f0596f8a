"""Secret scans: fixed patterns, and two character Markov models of random strings and of ordinary identifiers.

Everything that runs over documents is a native column expression. A candidate is a run of at least 16 characters of
keys and names; each model gives its first character and every following one, by the one before, a probability, and the
sum of the differences of logarithms (in whole millionths, so that sums are exact in any engine) decides. Both models
learn from labelled samples that rules in this module make, not from the documents.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with one start are listed; the last one is found by the models.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a shorter run fails as a whole, and so does what is left of it
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
LEAST_VALUE = 6  # characters of an assigned value
KINDS = ("assign", "access", "hex", "markov")

FIRST, WIDTH, SCALE = 42, 81, 1_000_000  # state 0 is the start, the characters from 43 (+) to 122 (z) follow
MARGIN = 8 * SCALE  # evidence a candidate needs, in millionths of a natural logarithm
BLOCK = 256

#: Words of ordinary identifiers and texts, in several languages.
_WORDS = (
    "user name value index count total order item list page table column field group class method test build main config "
    "system service client server request response message session account address payment customer product category report "
    "update delete create insert select window button header footer content image video document folder string number integer "
    "buffer stream socket thread process memory network handler manager factory provider controller component template version "
    "the and that with from this have which their there would about other these people should through between different "
    "information development international communication government university understanding responsibility something "
    "hashing nothing meeting reading station nation action question creation condition attention relation "
    "der die und das nicht eine sich auch nach werden schon zwischen gesellschaft entwicklung verantwortung wirtschaft "
    "freiheit einheit sicherheit schule sprache deutsch geschichte herzlich freundlich wissenschaft beispiel "
    "para como pero este esta entre cuando muy sobre tambien hasta desde donde quien durante siempre trabajo gobierno ciudad "
    "nacional desarrollo importante informacion comunicacion "
    "dans pour avec cette mais leur etre ainsi toujours quelque developpement gouvernement maintenant heureusement naturellement"
).split()


def samples() -> tuple[list[str], list[str]]:
    """Labelled samples: random strings as key generators write them, and ordinary identifiers, words and numbers."""

    def digest(kind: str, k: int) -> bytes:
        return hashlib.sha512(f"{kind}{k}".encode()).digest()

    random, ordinary, words = [], [], _WORDS
    for k in range(400):
        raw = digest("random", k)
        random += [raw.hex()[:48], base64.b64encode(raw).decode().rstrip("=")[:48], base64.urlsafe_b64encode(raw[20:]).decode().rstrip("=")[:48]]
        random += [base64.b32encode(raw).decode().rstrip("=")[:40], base64.b64encode(raw[9:]).decode().translate(str.maketrans("", "", "+/="))[:40]]
        pick = digest("ordinary", k)
        some = [words[int.from_bytes(pick[p : p + 2], "big") % len(words)] for p in range(0, 16, 2)]
        number = str(int.from_bytes(pick[20:28], "big"))[:16]
        ordinary += ["_".join(some[:4]), "-".join(some[2:5]), "/".join(some[3:7]), "".join(w.title() for w in some[:4]), "".join(some[4:8])]
        ordinary += ["_".join(some[:3]).upper(), some[0].upper() + some[1].upper(), some[5] + number[:3], f"{some[1]}-{number[:4]}-{number[4:6]}-{number[6:8]}"]
        ordinary += [number, "".join(some[:3]) + some[3].title(), "+".join(some[5:8]), "".join(w.title() for w in some[5:7]) + number[:2]]
    return random, ordinary


def train(random: list[str] | None = None, ordinary: list[str] | None = None, smoothing: float = 0.25) -> list[int]:
    """Log-likelihood ratio of every move, state after state, in millionths; above 0 speaks for a random string."""
    if random is None or ordinary is None:
        random, ordinary = samples()
    logs = []
    for texts in (random, ordinary):
        moves = [[smoothing] * WIDTH for _ in range(WIDTH)]
        for text in texts:
            at = 0
            for c in text:
                then = ord(c) - FIRST
                if 0 < then < WIDTH:
                    moves[at][then] += 1
                    at = then
        logs.append([[math.log(n / sum(row)) for n in row] for row in moves])
    return [round((r - o) * SCALE) for row_r, row_o in zip(*logs, strict=True) for r, o in zip(row_r, row_o, strict=True)]


def _ends(steps: Column) -> Column:
    """Running sums of an array of whole numbers, in blocks, so that an array of n takes far fewer than n^2 steps."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))

    def sums(parts: Column) -> Column:
        totals = F.transform(parts, total)
        return F.transform(parts, lambda part, b: F.struct(part.alias("part"), total(F.slice(totals, 1, b)).alias("before")))

    inside = F.transform(sums(blocks), lambda s: F.transform(s["part"], lambda _, k: s["before"] + total(F.slice(s["part"], 1, k + 1))))
    return F.when(F.size(steps) > 0, F.flatten(inside)).otherwise(F.array().cast("array<bigint>"))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, text) of all matches, in characters; pieces between the matches tell where they are."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")

    def located(all_found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(all_found))
        steps = F.zip_with(gaps, all_found, lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
        return F.zip_with(all_found, _let(steps, _ends), lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("text")))

    return F.when(text.rlike(pattern), _let(found, located)).otherwise(empty)


def likelihood_ratio(token: Column, weights: list[int]) -> Column:
    """Log-likelihood ratio of a candidate, in millionths."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<bigint>")
    states = F.concat(F.array(F.lit(0)), F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST))
    moves = lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: a * WIDTH + b)
    return F.aggregate(_let(states, moves), F.lit(0).cast("long"), lambda total, move: total + F.get(table, move))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    texts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(texts, ",")


def scan(docs: DataFrame, weights: list[int], margin: int = MARGIN) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Base matches of each kind are leftmost and do not overlap; an assignment whose value has fewer than 6 characters is
    dropped. A candidate whose log-likelihood ratio reaches `margin` adds a span, unless one base span covers it whole.
    spans lists `kind:start:end` by start, then kind (assign, access, hex, markov), then end; places count characters,
    ends are exclusive; base_sha256 digests the same list of the base spans. NULL and empty texts have no spans, an empty
    list and its digest. Repeated rows and NULL ids are scanned like others; other columns are ignored; an empty table
    gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def spans(found: Column, kind: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    long_value = lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= LEAST_VALUE
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # one generated row per row keeps each scan in one place: what is used below is computed once
    found = F.struct(
        spans(F.filter(_matches(F.col("text"), ASSIGN), long_value), 0).alias("assign"),
        spans(_matches(F.col("text"), ACCESS), 1).alias("access"),
        spans(_matches(F.col("text"), HEX), 2).alias("hex"),
        spans(F.filter(_matches(F.col("text"), CANDIDATE), lambda m: likelihood_ratio(m["text"], weights) >= margin), 3).alias("random"),
    )
    rows = rows.select("doc_id", F.inline_outer(F.array(found)))
    rows = rows.select("doc_id", "assign", "access", "hex", "random", F.inline_outer(F.array(F.struct(F.concat("assign", "access", "hex").alias("base")))))
    covered = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    rows = rows.select("doc_id", "assign", "access", "hex", "base", F.inline_outer(F.array(F.struct(F.filter("random", lambda s: ~covered(s)).alias("added")))))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )


def oracle(weights: list[int], margin: int = MARGIN) -> str:
    """DuckDB SQL with the same columns as `scan` over `documents`."""

    def located(kind: int, pattern: str, keep: str = "TRUE") -> str:
        quoted = pattern.replace("'", "''")
        return f"""
        SELECT row_no, {kind} AS kind, place AS start, place + length(m) AS stop, m FROM (
            SELECT row_no, m, sum(length(gap) + length(m)) OVER (PARTITION BY row_no ORDER BY k ROWS UNBOUNDED PRECEDING) - length(m) AS place
            FROM (SELECT row_no, unnest(gaps[:len(found)]) AS gap, unnest(found) AS m, unnest(range(len(found))) AS k
                  FROM (SELECT row_no, regexp_extract_all(text, '{quoted}') AS found, string_split_regex(text, '{quoted}') AS gaps FROM texts)))
        WHERE {keep}"""

    assign = ASSIGN.replace("'", "''")
    chars = f"list_transform(string_split(m, ''), lambda c: ascii(c) - {FIRST})"
    score = f"list_sum(list_transform(range(1, len(s)), lambda k: weights[s[k] * {WIDTH} + s[k + 1] + 1]))"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    listed = f"coalesce(string_agg({names}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind, stop) FILTER ({{}}), '')"
    return f"""
    WITH texts AS (
        SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents
    ), base AS (
        {located(0, ASSIGN, f"length(regexp_extract(m, '{assign}', 2)) >= {LEAST_VALUE}")}
        UNION ALL {located(1, ACCESS)}
        UNION ALL {located(2, HEX)}
    ), candidates AS (
        SELECT *, {score.replace("weights", f"({json.dumps(weights)}::BIGINT[])")} AS score
        FROM (SELECT *, [0] || {chars} AS s FROM ({located(3, CANDIDATE)}))
    ), added AS (
        SELECT row_no, kind, start, stop, m FROM candidates c
        WHERE score >= {margin} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row_no = c.row_no AND b.start <= c.start AND b.stop >= c.stop)
    ), spans AS (
        SELECT row_no, kind, start, stop FROM base UNION ALL SELECT row_no, kind, start, stop FROM added
    )
    SELECT doc_id, count(kind) FILTER (kind = 0) AS n_assign, count(kind) FILTER (kind = 1) AS n_access, count(kind) FILTER (kind = 2) AS n_hex,
           sha256({listed.format("kind < 3")}) AS base_sha256, {listed.format("kind IS NOT NULL")} AS spans, count(kind) FILTER (kind = 3) AS n_markov
    FROM texts LEFT JOIN spans USING (row_no)
    GROUP BY row_no, doc_id
    """
