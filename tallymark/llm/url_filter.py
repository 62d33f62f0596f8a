"""URL filters: allow and block rules by host and path, and a logistic regression on hashed n-grams for the rest.

Everything that runs over pages is a native column expression. The regression learns from a small labelled table of
URLs, given as a list, whose size is checked; weights are kept as whole millionths, so sums are exact in any engine.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES, SCALE, MAX_LABELLED, MAX_RULES = (3, 4), 1_000_000, 10_000, 1_000
BUCKETS = 4096  # three hex digits of md5
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The labelled table: host names by kind, each met in the forms below; no host of any given page is among them.
_BLOCKED = (
    "casinoroyal grandcasino lucky-casino casino-slots poker-online bet-now sportbets free-spins bets4you spamhub mail-spam spam-list junkfarm "
    "link-farm clickfarm pills-online buy-pills diet-pills cheapmeds cheap-watches adtracker track-clicks ads-server banner-ads ad-clicks "
    "adult-cams adultvideo xxx-adult porn-tube sexy-chat lottery-win win-prizes big-win free-money cash-win replica-watches"
).split()
_ALLOWED = (
    "library museum school university citynews daily-times gardening weather recipes history physics chemistry openbooks travelguide football "
    "orchestra painting railway biology mountain village harbour publisher encyclopedia handbook teacher student research journal community "
    "trade-union cycling free-software winter adulthood thoughts another nation internet thunder harvest clothes churches beaches coaches "
    "hat-shop habitat chat-history theatre athens health northern thesis earth methods ethics weather-watch table cable noble stable"
).split()
_SHAPES = ("{}.com/", "www.{}.net/index.html", "{}.info/page/2", "shop.{}.org/item?id=7", "news.{}.example.org/a/b")
LABELLED = tuple(
    (f"https://{shape.format(host)}", verdict)
    for hosts, verdict in ((_BLOCKED, "block"), (_ALLOWED, "allow"))
    for host in hosts
    for shape in _SHAPES
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL and without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def _split(url: str) -> tuple[str, str]:
    """The same for the labelled table."""
    _, found, rest = url.partition("://")
    rest = rest.split("?")[0].split("#")[0] if found else ""
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def _buckets(host: str, path: str) -> list[int]:
    grams = [f"{kind}{s[k : k + n]}" for kind, s in (("h", f".{host}."), ("p", path)) for n in SIZES for k in range(len(s) - n + 1)]
    return [int(hashlib.md5(g.encode()).hexdigest()[:3], 16) for g in grams]


def train(labelled: list[tuple[str, str]] | tuple = LABELLED, rounds: int = 60, rate: float = 0.5, l2: float = 1e-4) -> tuple[list[int], int]:
    """Weight of every bucket and the intercept, in millionths, for "block"; gradient steps per row in the given order."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    rows = [(_buckets(*_split(url or "")), verdict == "block") for url, verdict in labelled]
    weight, intercept = [0.0] * BUCKETS, 0.0
    for r in range(rounds):
        step = rate / (1 + 0.1 * r)
        for grams, blocked in rows:
            norm = max(1, len(grams))
            z = intercept + sum(weight[g] for g in grams) / norm
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) - blocked
            intercept -= 0.1 * step * error
            for g in grams:
                weight[g] -= step * (error + l2 * weight[g])
    return [round(w * SCALE) for w in weight], round(intercept * SCALE)


def _rule_order(rules) -> list[tuple[str, str, str]]:
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r[2] != "block"))


def judge(pages: DataFrame, model: tuple[list[int], int], rules=RULES) -> DataFrame:
    """Per row of `pages` (page_id, url): page_id, host, path, rule, verdict, block_score.

    The longest rule whose host is the url's or a parent domain of it and whose path begins the url's path decides;
    equally long ones by longer host, then block. Without one, the regression does (block if its score, in millionths
    per n-gram, is above 0). NULL and urls without `://` have empty host and path and get the intercept's verdict. Repeated rows and NULL ids
    are judged like others; other columns are ignored; an empty table gives an empty result.
    """
    weights, intercept = model
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string")).select("page_id", host.alias("host"), path.alias("path"))
    table = F.from_json(F.lit(json.dumps(weights)), "array<bigint>")

    def of_size(text: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.when(F.length(text) >= n, F.transform(starts, lambda k: F.substring(text, k, n))).otherwise(F.array().cast("array<string>"))

    def grams(text: Column, kind: str) -> Column:
        return F.transform(F.concat(*[of_size(text, n) for n in SIZES]), lambda g: F.concat(F.lit(kind), g))

    all_grams = F.concat(grams(F.concat(F.lit("."), "host", F.lit(".")), "h"), grams(F.col("path"), "p"))
    total = F.aggregate(
        "grams",
        F.lit(0).cast("long"),
        lambda acc, g: acc + F.element_at(table, F.conv(F.substring(F.md5(g.cast("binary")), 1, 3), 16, 10).cast("int") + 1),
    )
    score = total + F.lit(intercept).cast("long") * F.greatest(F.size("grams"), F.lit(1))
    rule = verdict = None
    for h, p, v in _rule_order(rules):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    rows = rows.withColumn("rule", none if rule is None else rule).withColumn("ruled", none if verdict is None else verdict)
    scored = rows.withColumn("grams", all_grams).withColumn("block_score", score)
    learned = F.when(F.col("block_score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "block_score")


def oracle(model: tuple[list[int], int], rules=RULES) -> str:
    """DuckDB SQL with the same columns as `judge` over `pages`."""
    weights, intercept = model
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in _rule_order(rules)]
    rule = " ".join(f"{c} '{h}{p}'" for c, (h, p, _) in zip(cases, _rule_order(rules), strict=True))
    verdict = " ".join(f"{c} '{v}'" for c, (_, _, v) in zip(cases, _rule_order(rules), strict=True))

    def grams(text: str, kind: str) -> str:
        return " || ".join(f"list_transform(range(1, length({text}) - {n} + 2), lambda k: '{kind}' || substring({text}, k, {n}))" for n in SIZES)

    digit = "(strpos('0123456789abcdef', substring(md5(g), {}, 1)) - 1)"
    bucket = f"{digit.format(1)} * 256 + {digit.format(2)} * 16 + {digit.format(3)}"
    return f"""
    WITH rests AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
        SELECT page_id,
               translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM rests
    ), listed AS (
        SELECT *, {grams("('.' || host || '.')", "h")} || {grams("path", "p")} AS grams, {json.dumps(weights)} AS weights FROM parts
    ), scored AS (
        SELECT *, coalesce(list_sum(list_transform(grams, lambda g: weights[{bucket} + 1])), 0)::BIGINT
                  + {intercept}::BIGINT * greatest(len(grams), 1) AS block_score
        FROM listed
    )
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {verdict} WHEN block_score > 0 THEN 'block' ELSE 'allow' END AS verdict, block_score::BIGINT AS block_score
    FROM scored
    """
