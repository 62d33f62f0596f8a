"""Readers for problem, result and payload files. All schemas are explicit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import answers as A
from ..functions import clauses as C
from ..functions import fixed as V
from ..functions.base import first_match, let
from ..functions.stats import draw
from ..operators.logs import first_per_group
from ..operators.scoring import keep_complete, step_count
from .manifest import committed
from .rejects import Rejects


def _file_name() -> Column:
    return F.col("_metadata.file_name")


def _file_path() -> Column:
    return F.col("_metadata.file_path")


def read_templates(spark: SparkSession, path: str, files: str = "*.json") -> DataFrame:
    """A record, or an array of records, per file; records without a question or an answer are left out."""
    df = spark.read.schema(S.TEMPLATE).option("multiLine", True).option("pathGlobFilter", files).json(path)
    return keep_complete(df.withColumn("source_file", _file_name()), "question", "answer")


def read_templates_with_pool(spark: SparkSession, path: str, files: str = "*.json", rejects: Rejects | None = None) -> DataFrame:
    """Templates with a non-empty distractor pool; pool elements are kept as JSON text or bare text."""
    df = (
        spark.read.schema(S.TEMPLATE_WITH_RAW_POOL)
        .option("multiLine", True)
        .option("pathGlobFilter", files)
        .json(path)
    )
    df = df.withColumn("source_file", _file_name())
    filled = F.coalesce(F.size("dynamic_distractor_pool") > 0, F.lit(False))
    if rejects is not None:
        df = rejects.watch(df, templates=F.lit(True), empty_pool=~filled)
    return df.filter(filled)


def pick_distractor(df: DataFrame, seed: int = 42, pool: str = "dynamic_distractor_pool", key: str = "source_file") -> DataFrame:
    """Adds distractor and distractor_type: one reproducible element of each row's pool."""
    chosen = F.get(F.col(pool), draw(F.size(pool), F.lit(str(seed)), F.col(key)))
    return (
        df.withColumn("_chosen", chosen)
        .withColumn("_element", C.pool_element(F.col("_chosen")))
        .withColumn("distractor", F.col("_element.text"))
        .withColumn("distractor_type", F.col("_element.type"))
        .drop("_chosen", "_element")
    )


def read_distracted(spark: SparkSession, path: str, seed: int = 42, complete: bool = True) -> DataFrame:
    """Templates with one distractor of their pool put into the question."""
    df = read_templates_with_pool(spark, path)
    if complete:
        df = keep_complete(df, "question", "answer")
    return distract(df, seed)


def distract(df: DataFrame, seed: int = 42, position: str = "mid") -> DataFrame:
    """Distracted problem table from templates with pools."""
    return pick_distractor(df, seed).select(
        C.inject_distractor("question", "distractor", position).alias("question"),
        "answer",
        F.col("question").alias("question_original"),
        "distractor",
        "distractor_type",
        "id_orig",
        "id_shuffled",
        "source_file",
    )


def read_dataset(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array, or JSON lines where the path ends in `.jsonl`."""
    return spark.read.schema(schema).option("multiLine", not path.endswith(".jsonl")).json(path)


def read_depths(spark: SparkSession, path: str, depths: Sequence[int], per_depth: int) -> DataFrame:
    """First rows of each listed depth of a table partitioned by depth; other depths are not read."""
    df = spark.read.schema(S.MATH_PROBLEM).json(path).filter(F.col("depth").isin(list(depths)))
    return first_per_group(df, "depth", ["problem_id"], per_depth)


def _require_rows(df: DataFrame, path: str) -> DataFrame:
    if df.isEmpty():
        raise FileNotFoundError(f"no result records in '{path}'")
    return df


_CORRUPT = "_not_json"
_NUMBERS = (T.IntegerType, T.LongType, T.DoubleType)


def _as_texts(schema: str) -> T.StructType:
    """The schema with numbers and flags as texts, which any JSON value can be read into."""
    texts = (*_NUMBERS, T.BooleanType)
    fields = T.StructType.fromDDL(schema).fields
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, texts) else f.dataType) for f in fields])


def _typed(schema: str, column: Callable[[str], Column] = F.col) -> list[Column]:
    """Columns of texts cast as a reader would: 3, 3.0 and "3" are numbers, 1 and 0 flags; anything else is NULL."""
    out = []
    for f in T.StructType.fromDDL(schema).fields:
        c = column(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = F.when(F.lower(c).isin("true", "false"), F.lower(c) == "true").otherwise(c.try_cast("double") != 0)
        elif isinstance(f.dataType, T.DoubleType):
            c = c.try_cast("double")
        elif isinstance(f.dataType, _NUMBERS):
            c = F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint")).try_cast(f.dataType)
        out.append(c.alias(f.name))
    return out


def folder_value(path: Column, name: str) -> Column:
    """What a `name=value` folder of a file's path says, as text; NULL without one.

    The path is a URI of folder names in which a writer has already escaped special characters.
    """

    def plain(c: Column) -> Column:
        return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))

    value = let(first_match(path, f"/{name}=([^/]*)/"), lambda v: F.coalesce(plain(plain(v)), plain(v), v))
    return F.nullif(value, F.lit("__HIVE_DEFAULT_PARTITION__"))


def parse_lines(text: DataFrame, schema: str, rejects: Rejects | None = None) -> DataFrame:
    """Records of JSON lines read as text, batch or stream, with the file they are from. A line is parsed once and whole:
    whether it is a record does not depend on the columns that are asked for, nor on the types of its values.

    Fields that the record lacks come from `name=value` folders, as text: a log laid out by columns keeps them only there,
    and a model whose name looks like a number stays the model it is. `rejects` counts lines read, blank and not JSON.
    """
    parsed = T.StructType([*_as_texts(schema).fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    lines = text.select(F.from_json("value", parsed, options).alias("r"), F.trim("value").alias("line"), _file_path().alias("_path"))
    if rejects is not None:
        blank = F.col("line") == ""
        lines = rejects.watch(lines, lines=F.lit(True), blank=blank, not_json=~blank & ~F.coalesce(_is_record(), F.lit(False)))
    records = lines.filter(_is_record())
    texts = [f.name for f in T.StructType.fromDDL(schema).fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]

    def field(name: str) -> Column:
        value = F.col("r")[name]
        return F.coalesce(value, folder_value(F.col("_path"), name)) if name in texts else value

    return records.select(*_typed(schema, field), "_path")


def _is_record() -> Column:
    return (F.col("line") != "") & F.col("r").isNotNull() & F.col(f"r.{_CORRUPT}").isNull() & F.col("line").startswith("{")


def _json_lines(spark: SparkSession, path: str, schema: str, rejects: Rejects | None = None) -> DataFrame:
    """Records of JSON lines below `path`; of a folder with a manifest, those of committed batches."""
    # a recursive listing infers no partition columns, whose types would depend on the values
    records = parse_lines(spark.read.option("recursiveFileLookup", True).text(path), schema, rejects)
    done = None if any(c in path for c in "*?[{") else committed(spark, path)
    if done is None:
        return records
    return records.withColumn("batch", folder_value(F.col("_path"), "batch")).join(done, "batch", "left_semi").drop("batch")


def read_log(
    spark: SparkSession, path: str, schema: str = S.DEPTH_RESULT, check: bool = True, rejects: Rejects | None = None
) -> DataFrame:
    """JSON lines; blank lines and lines that are not JSON are skipped, a log without any record is an error.

    With `rejects`, what was skipped is counted and there is no such check, whose short job would end the counting.
    """
    df = _json_lines(spark, path, schema, rejects).drop("_path")
    return _require_rows(df, path) if check and rejects is None else df


def read_log_strict(spark: SparkSession, path: str, schema: str = S.FILTERED_RESULT) -> DataFrame:
    """JSON lines; any malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_method_log(spark: SparkSession, path: str, check: bool = True, rejects: Rejects | None = None) -> DataFrame:
    """Depth log as (model, method, depth, correct); rows without one of these keys are left out."""
    keys = ["model", "regime", "depth", "is_correct"]
    df = read_log(spark, path, S.DEPTH_RESULT, check, rejects)
    if rejects is not None:
        df = rejects.watch(df, lacking_key=reduce(or_, [F.col(k).isNull() for k in keys]))
    return df.dropna(subset=keys).select("model", F.col("regime").alias("method"), "depth", F.col("is_correct").alias("correct"))


def read_qa_log(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """`<model>_cot.jsonl` logs (files or folders); the model is the one in the name."""
    df = (
        _json_lines(spark, f"{path}/{V.QA_FILES}", S.QA_RESULT)
        .withColumn("model", first_match(F.col("_path"), V.QA_FILE_MODEL))
        .dropna(subset=["problem_id", "is_correct"])
    )
    df = _require_rows(df, path) if check else df
    return df.select(
        "model",
        F.lit("cot").alias("method"),
        "problem_id",
        F.coalesce("estimated_steps", F.lit(0)).alias("estimated_steps"),
        F.col("is_correct").alias("correct"),
    )


def model_of_file(path: Column) -> Column:
    """Model in the name of a chunk-result file or folder, without a snapshot suffix."""
    return first_match(path, V.CHUNK_FILE_MODEL)


def read_chunk_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Chunk results (files or folders); model and seed from the path, missing counters 0.

    Intermediate snapshots repeat rows of the final file and are not read.
    """
    df = (
        spark.read.schema(_as_texts(S.CHUNK_RESULT))
        .option("multiLine", multi_line)
        .json(f"{path}/{V.CHUNK_FILES}")
        .select(*_typed(S.CHUNK_RESULT), _file_path().alias("_path"))
        .filter(~F.col("_path").contains(V.SNAPSHOT_MARK))
    )
    counters = ["corrections_applied", "unverified_fallbacks", "extraction_failures", "num_chunks"]
    return df.select(
        seed_of_path(F.col("_path")).alias("seed"),
        model_of_file(F.col("_path")).alias("model"),
        F.lit("chunked").alias("method"),
        F.col("id").cast("string").alias("problem_id"),
        step_count(df, "depth", "estimated_steps").alias("depth"),
        "correct",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counters],
    )


def seed_of_path(path: Column) -> Column:
    """`seed_…` directory a file lies in, else NULL."""
    return first_match(path, V.SEED_DIR)


def read_seed_logs(spark: SparkSession, base: str, glob: str = "*", schema: str = S.DEPTH_RESULT, check: bool = True) -> DataFrame:
    """Logs of all `seed_*` directories as one table with a seed column; no record at all is an error."""
    df = _json_lines(spark, f"{base}/seed_*/{glob}", schema)
    df = df.withColumn("seed", seed_of_path(F.col("_path"))).drop("_path")
    return _require_rows(df, base) if check else df


def read_payload(spark: SparkSession, path: str, blocks: Sequence[str] = ("original", "enhanced")) -> DataFrame:
    """Accuracy per block and model of an evaluation report; a report without one of the blocks is an error."""
    df = spark.read.schema(S.PAYLOAD).option("multiLine", True).json(path)
    return explode_payload(require_blocks(df, blocks), blocks)


def require_blocks(df: DataFrame, blocks: Sequence[str]) -> DataFrame:
    checks = [
        F.when(F.col(b).isNull(), F.raise_error(F.lit(f"report lacks the block '{b}'"))).otherwise(F.col(b)).alias(b)
        for b in blocks
    ]
    return df.select(*checks)


def explode_payload(df: DataFrame, blocks: Sequence[str]) -> DataFrame:
    def entries(block: str) -> Column:
        return F.transform(
            F.map_entries(block),
            lambda e: F.struct(
                F.lit(block).alias("variant"),
                e["key"].alias("model"),
                *[e["value"][c].alias(c) for c in ("accuracy", "n_correct", "n_evaluated", "n_skipped_no_gold")],
            ),
        )

    return df.select(F.inline(F.concat(*[entries(b) for b in blocks])))


def prepare_qa(
    df: DataFrame, idx: str = "idx", min_steps: int | None = V.MIN_STEPS, rejects: Rejects | None = None
) -> DataFrame:
    """Problem table from raw question/answer rows; rows without a gold number or with few steps are left out.

    The row number is an input column: ids have to name the same problem on every run.
    """
    # one generated row per row: a filter on a plain column would be pushed below and parse each answer twice
    parsed = F.struct(A.gold_number("answer").alias("ground_truth"), A.count_steps("answer").alias("estimated_steps"))
    out = df.select(idx, "question", "answer", F.inline_outer(F.array(parsed))).select(
        F.format_string(V.PREPARED_ID, F.col(idx)).alias("problem_id"),
        "question",
        "answer",
        "ground_truth",
        "estimated_steps",
    )
    if rejects is not None:
        few = F.lit(False) if min_steps is None else F.col("estimated_steps") < min_steps
        out = rejects.watch(out, rows=F.lit(True), no_gold=F.col("ground_truth").isNull(), few_steps=F.col("ground_truth").isNotNull() & few)
    out = out.filter(F.col("ground_truth").isNotNull())
    return out if min_steps is None else out.filter(F.col("estimated_steps") >= min_steps)
