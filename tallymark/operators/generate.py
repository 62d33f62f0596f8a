"""Generated problems: chained arithmetic word problems, one per (depth, idx) row.

Every choice is a reproducible draw from the problem's own key, so a row yields the same problem whatever the
partitioning. Values are exact fractions (num/den) until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.base import let
from ..functions.stats import draw

_OPERATIONS = 8


def shuffled(key: Column, tag: str, count: Column) -> Column:
    """Numbers 1..count in an order drawn from the key."""
    order = F.transform(
        F.sequence(F.lit(1), count),
        lambda j: F.struct(F.md5(F.concat_ws("|", key, F.lit(tag), j).cast("binary")).alias("h"), j.alias("j")),
    )
    return F.transform(F.sort_array(order), lambda s: s["j"])


def choose(words: list, key: Column, tag: str, step: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), draw(F.lit(len(words)), key, F.lit(tag), step))


def between(low: int, high: int, key: Column, tag: str, step: Column) -> Column:
    return draw(F.lit(high - low + 1), key, F.lit(tag), step) + low


def _divided(pair: Column, f: int) -> Column:
    def by(name: str, p: Column) -> Column:
        return (p[name] / f).cast("bigint").alias(name)

    return let(
        pair,
        lambda p: F.when((p["num"] % f == 0) & (p["den"] % f == 0), F.struct(by("num", p), by("den", p))).otherwise(p),
    )


def _cancelled(num: Column, den: Column) -> Column:
    """Divide out the common factors a single step can bring in."""
    pair = F.struct(num.alias("num"), den.alias("den"))
    for f in (2, 2, 3, 5):
        pair = _divided(pair, f)
    return pair


def _step(actor: Column, key: Column, items: Column, op: Column, acc: Column, i: Column) -> Column:
    """STRUCT<mul, div, less, text, used>: value * mul / div - less."""
    item = F.get(items, acc["used"])
    whole = F.greatest(F.lit(1), F.floor(acc["num"] / acc["den"]).cast("int") - 1)
    n = between(2, 5, key, "count", i)
    price = between(2, 8, key, "price", i)
    afforded = F.when(n * price > whole, F.greatest(F.lit(1), F.floor(whole / n).cast("int"))).otherwise(price)
    bonus = between(5, 15, key, "bonus", i)
    fee = choose(V.FEES, key, "fee", i)
    amount = F.least(between(2, 10, key, "amount", i), whole)
    buys = choose(V.BUY_VERBS, key, "buy", i)
    uses = choose(V.USE_VERBS, key, "use", i)

    def row(mul, div, less, text: Column, used: int) -> Column:
        return F.struct(
            (F.lit(mul) if isinstance(mul, int) else mul).cast("bigint").alias("mul"),
            F.lit(div).cast("bigint").alias("div"),
            (F.lit(less) if isinstance(less, int) else less).cast("bigint").alias("less"),
            text.alias("text"),
            F.lit(used).alias("used"),
        )

    def say(sentence: str, *words: Column) -> Column:
        return F.format_string(sentence, *words)

    return (
        F.when(op == 1, row(1, 2, 0, say(V.HALF_SENTENCE, actor, actor, item), 1))
        .when(op == 2, row(2, 3, 0, say(V.THIRD_SENTENCE, actor, actor, item), 1))
        .when(op == 3, row(3, 4, 0, say(V.QUARTER_SENTENCE, actor, actor, item), 1))
        .when(op == 4, row(1, 1, n * afforded, say(V.BUY_SENTENCE, actor, buys, n, item, afforded), 1))
        .when(op == 5, row(1, 1, -bonus, say(V.BONUS_SENTENCE, actor, bonus), 0))
        .when(op == 6, row(F.lit(100) - fee, 100, 0, say(V.FEE_SENTENCE, fee, actor), 0))
        .when(op == 7, row(2, 1, 0, say(V.DOUBLE_SENTENCE, actor, actor), 0))
        .otherwise(row(1, 1, amount, say(V.USE_SENTENCE, actor, uses, amount, item), 1))
    )


def generate_problems(df: DataFrame, seed: int | None = None, depth: str = "depth", idx: str = "idx") -> DataFrame:
    """Problem table for the given (depth, idx) rows."""
    depth, idx = F.col(depth).cast("int"), F.col(idx).cast("bigint")
    base = depth * F.lit(10000) + idx
    key = (base if seed is None else base + F.lit(seed * 100000)).cast("string")

    def build(head: Column) -> Column:
        key, actor, items, ops = head["key"], head["actor"], head["items"], head["ops"]
        rate = between(10, 30, key, "rate", F.lit(0))
        hours = between(5, 15, key, "hours", F.lit(0))
        earned = (rate * hours).cast("bigint")
        job = choose(V.JOBS, key, "job", F.lit(0))
        opening = F.format_string(V.EARN_SENTENCE, actor, job, rate, hours)
        start = F.struct(
            earned.alias("num"),
            F.lit(1).cast("bigint").alias("den"),
            F.lit(0).alias("used"),
            F.array(opening).alias("sentences"),
            F.array(earned.cast("double")).alias("steps"),
        )

        def advance(acc: Column, i: Column) -> Column:
            op = F.get(ops, (i - 1) % _OPERATIONS)

            def apply(s: Column) -> Column:
                den = acc["den"] * s["div"]
                value = _cancelled(acc["num"] * s["mul"] - s["less"] * den, den)
                return let(
                    value,
                    lambda v: F.struct(
                        v["num"].alias("num"),
                        v["den"].alias("den"),
                        (acc["used"] + s["used"]).alias("used"),
                        F.concat(acc["sentences"], F.array(s["text"])).alias("sentences"),
                        F.concat(acc["steps"], F.array(v["num"] / v["den"])).alias("steps"),
                    ),
                )

            return let(_step(actor, key, items, op, acc, i), apply)

        later = F.when(depth > 1, F.sequence(F.lit(1), depth - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(later, start, advance)

    pool = F.array(*[F.lit(w) for w in V.ITEMS])
    head = F.struct(
        key.alias("key"),
        choose(V.ACTORS, key, "actor", F.lit(0)).alias("actor"),
        F.transform(
            shuffled(key, "item", F.greatest(depth, F.lit(2))), lambda j: F.get(pool, (j - 1) % len(V.ITEMS))
        ).alias("items"),
        shuffled(key, "op", F.lit(_OPERATIONS)).alias("ops"),
    )
    built = df.withColumn("_head", head).withColumn("_built", build(F.col("_head")))
    return built.select(
        F.format_string(V.GENERATED_ID, depth, idx).alias("problem_id"),
        depth.alias("depth"),
        F.concat(
            F.array_join("_built.sentences", " "),
            F.format_string(V.GOAL_SENTENCE, F.col("_head.actor")),
        ).alias("question"),
        F.element_at("_built.steps", -1).alias("ground_truth"),
        F.col("_built.steps").alias("intermediate_values"),
        F.transform(
            F.col("_built.steps"), lambda _, i: F.when(i == 0, "multiply").otherwise("derived")
        ).alias("operations"),
        F.lit(V.MONEY).alias("answer_unit"),
    )


def problem_grid(spark, depths: list[int], per_depth: int) -> DataFrame:
    """(depth, idx) rows for a fresh problem set."""
    return spark.range(per_depth).select(
        F.explode(F.lit(list(depths)).cast("array<int>")).alias("depth"), F.col("id").alias("idx")
    )
