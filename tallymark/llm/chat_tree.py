"""Chat formatting as a prefix tree: turns that conversations share from their start are formatted and emitted once.

A node is a turn after given earlier turns; its key is a hash chained along the conversation. Nodes are laid out depth
first in one token sequence: paths are sorted, a node belongs to the first path it occurs in, and offsets are sums over
that order. A node carries position ids (its place along its own path) and the intervals of the sequence it may attend
to: its ancestors and itself.

A path is kept as rows, one a turn. What sorts it are its choices alone: the keys of its nodes that have siblings. Paths
with equal choices lie on one line, so the shorter goes first. Whoever leaves a path at its k-th choice has k turns or
more, so n rows of conversations give no path more than about sqrt(2 n) choices.

Template of a turn: `### role: text</turn>` and a line end. In texts and roles a backslash goes before every backslash,
`###` and `</turn>` (and before `:` in roles), so no text can look like a mark, and dropping those backslashes restores it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.bpe import Encoder
from tallymark.llm.common import cut, map_arrow, shuffle_width

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
LEARNED_ROLE = "assistant"
_KEY = 16
_BLOCK = 1 << 16  # turns of one conversation that meet in one task of a join
_SALTS = 16  # parts of the children of one node
_MARKS = re.compile(r"\\|###|</turn>")
_ROLE_MARKS = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE_END = re.compile(r"(?:[^\\:]|\\.)*", re.DOTALL)


def escape(text: str, marks: re.Pattern = _MARKS) -> str:
    return marks.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and foot of a turn; only the body holds the text."""
    return OPEN + escape(role, _ROLE_MARKS) + COLON, escape(text), CLOSE


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    end = _ROLE_END.match(formatted, len(OPEN)).end()
    if not formatted.startswith(OPEN) or not formatted.startswith(COLON, end) or not formatted.endswith(CLOSE):
        raise ValueError("not a formatted turn")
    return unescape(formatted[len(OPEN) : end]), unescape(formatted[end + len(COLON) : -len(CLOSE)])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _turns(conversations: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Every turn with its node key, ids and loss span, and whether it is the last of its conversation."""
    spark = conversations.sparkSession
    names = ["conv_id", "k", "key", "parent", "position", "ids", "loss_start", "loss_end", "last"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
    schema = "conv_id long, k long, key binary, parent binary, position long, ids binary, loss_start int, loss_end int, last boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        waiting: tuple | None = None  # the turn before this one, until it is known whether it is a last one

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            out = []
            for conv_id, role, text in _rows(batch.select(["conv_id", "role", "text"])):
                k, parent, position = 0, b"", 0
                if waiting is not None:
                    follows = waiting[0] == conv_id
                    out.append((*waiting, not follows))
                    if follows:
                        k, parent, position = waiting[1] + 1, waiting[2], waiting[4] + len(waiting[5]) // 4
                key = hashlib.blake2b(b"\0".join([parent, str(len(role.encode())).encode(), role.encode(), text.encode()]), digest_size=_KEY).digest()
                head, body, foot = (encoder.encode(encoder.pretokens(x)) for x in format_turn(role, text))
                learned = role == LEARNED_ROLE
                span = (len(head) // 4, (len(head) + len(body)) // 4) if learned else (0, 0)
                waiting = (conv_id, k, key, parent, position, head + body + foot, *span)
            if out:
                yield batch_of(out)
        if waiting is not None:
            yield batch_of([(*waiting, True)])

    ordered = (
        conversations.select(
            F.col("conv_id").cast("long"),
            F.col("turn").cast("long"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
        .repartition(shuffle_width(spark), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return cut(map_arrow(ordered, run, schema), "turns")


def _paths(turns: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rank, depth, key): the nodes of every distinct path, paths ranked so that those with a common start are neighbours."""
    spark = turns.sparkSession
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    block = F.floor(F.col("depth") / _BLOCK)

    def by_block(paths: DataFrame) -> DataFrame:
        return paths.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") / _BLOCK))))

    # copies have equal last keys, so one conversation stands for all
    distinct = turns.where("last").groupBy("key").agg(F.min(conv).alias("conv"), F.max("k").alias("end")).select("conv", "end")
    distinct = cut(distinct, "paths")
    steps = turns.select(conv.alias("conv"), F.col("k").alias("depth"), "key", "parent").withColumn("block", block)
    steps = cut(steps.join(by_block(distinct), ["conv", "block"]).select("conv", "block", "depth", "key", "parent"), "steps")
    forks = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("parent")
    salt = F.pmod(F.xxhash64("conv"), F.lit(_SALTS))
    forks = forks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    choices = (
        steps.withColumn("salt", salt)
        .join(forks, ["parent", "salt"])
        .groupBy("conv")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "key"))).alias("chosen"))
        .select("conv", F.col("chosen.key").alias("choices"))
    )
    ranked = distinct.join(choices, "conv", "left").withColumn("choices", F.coalesce("choices", F.array().cast("array<binary>")))
    ranked = (
        ranked.repartitionByRange(shuffle_width(spark), "choices", "end")
        .sortWithinPartitions("choices", "end")
        .select("conv", "end", F.monotonically_increasing_id().alias("rank"))
    )
    return cut(steps.join(by_block(cut(ranked, "ranks")), ["conv", "block"]).select("rank", "depth", "key"), "ranked-steps")


def format_tree(conversations: DataFrame, ranks: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of `conversations` (conv_id, turn, role, text).

    nodes: key, parent (empty for a first turn), depth, offset (in the depth-first sequence), position (of its first
    token along its path), n_tokens, ids (little-endian unsigned 32-bit), loss_start and loss_end (tokens of the node
    under the loss mask: the escaped texts of the assistant), attends (intervals of the sequence, ancestors and itself).
    members: conv_id, k, key, in the order of the turns.

    Rows are ordered by turn, ties by role and text, NULLs first; repeated rows are turns of their own. NULL role and
    text are empty; rows with a NULL conv_id form one conversation. Other columns are ignored; an empty table gives
    empty results. A conversation of any length is streamed, its path kept as rows; a first turn or conversation of any
    number of copies is one node or path after partial aggregation.
    """
    spark = conversations.sparkSession
    turns = _turns(conversations, ranks, pattern)
    members = turns.select("conv_id", "k", "key")
    content = turns.groupBy("key").agg(*[F.first(c).alias(c) for c in ("parent", "k", "position", "ids", "loss_start", "loss_end")])
    content = cut(content.withColumnRenamed("k", "depth").withColumn("n_tokens", (F.length("ids") / 4).cast("long")), "nodes")
    on_path = _paths(turns, content)
    owner = on_path.groupBy("key").agg(F.min("rank").alias("owner"))
    nodes = cut(content.select("key", "depth", "n_tokens").join(owner, "key"), "owners")
    # offsets: tokens of earlier range partitions, of earlier owners of the partition, of shallower nodes of the owner
    sizes = nodes.groupBy("owner").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.shiftright("owner", 33))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row per range partition
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    within = Window.partitionBy("part").orderBy("owner")
    starts = sizes.withColumn("before", F.sum("n").over(within) - F.col("n")).join(before, "part").select("owner", (F.col("before") + F.col("before_part")).alias("begin"))
    deep = Window.partitionBy("owner").orderBy("depth")
    placed = (
        nodes.withColumn("inside", F.sum("n_tokens").over(deep) - F.col("n_tokens"))
        .join(starts, "owner")
        .select("key", "owner", (F.col("begin") + F.col("inside")).alias("offset"), "n_tokens")
    )
    placed = cut(placed, "offsets")
    walk = (
        on_path.join(placed, "key")
        .repartition(shuffle_width(spark), "rank")
        .sortWithinPartitions("rank", "depth")
        .select("rank", "depth", "key", "owner", "offset", "n_tokens")
    )

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: list[tuple[int, int]] = []
        for batch in batches:
            keys, found = [], []
            for rank, depth, key, own, offset, n in _rows(batch):
                if depth == 0:
                    spans = []
                if spans and spans[-1][1] == offset:
                    spans[-1] = (spans[-1][0], offset + n)
                else:
                    spans.append((offset, offset + n))
                if own == rank:
                    keys.append(key)
                    found.append([{"start": a, "end": b} for a, b in spans])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(found, kind)], ["key", "attends"])

    attends = map_arrow(walk, intervals, "key binary, attends array<struct<start: long, end: long>>")
    nodes = content.withColumn("depth", F.col("depth").cast("int")).join(placed.select("key", "offset"), "key").join(attends, "key")
    return nodes, members


def read_back(nodes: DataFrame, members: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the emitted ids."""
    spark = nodes.sparkSession
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        state: list | None = None

        def row() -> tuple:
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        for batch in batches:
            out = []
            for conv_id, ids, start, end in _rows(batch):
                if state is None or state[0] != conv_id:
                    if state is not None:
                        out.append(row())
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = encoder.decode(ids).decode()
                role, text = parse_turn(formatted)
                learned = unescape(encoder.decode(ids[4 * start : 4 * end]).decode())
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(formatted)
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if state is not None:
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row(), types, strict=True)], names)

    ordered = (
        members.join(nodes.select("key", "ids", "loss_start", "loss_end"), "key")
        .repartition(shuffle_width(spark), "conv_id")
        .sortWithinPartitions("conv_id", "k")
        .select("conv_id", "ids", "loss_start", "loss_end")
    )
    return map_arrow(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
