"""Hook for a user's own response function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ResponseFn = Callable[[Sequence[str], Sequence[str], float], Sequence[str]]


def respond(
    prompts: DataFrame,
    fn: ResponseFn,
    temperature: float = 0.0,
    user: str = "user_prompt",
    system: str = "system_prompt",
    response: str = "response",
) -> DataFrame:
    """Adds a response column by calling `fn(prompts, systems, temperature)` on Arrow batches.

    Spark decides the partitions and batches. A batch whose call raises, or returns another number of texts, is called
    again row by row; only rows that fail alone are recorded as `[ERROR: …]`.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField(response, T.StringType())])

    def texts_of(batch: pd.DataFrame) -> list[str]:
        texts = list(fn(batch[user].tolist(), batch[system].tolist(), temperature))
        if len(texts) != len(batch):
            raise ValueError(f"{len(texts)} responses to {len(batch)} prompts")
        return texts

    def one_by_one(batch: pd.DataFrame) -> list[str]:
        texts = []
        for k in range(len(batch)):
            try:
                texts += texts_of(batch.iloc[k : k + 1])
            except Exception as error:  # noqa: BLE001 - a failed call is data here
                texts.append(f"[ERROR: {error}]")
        return texts

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                texts = texts_of(batch)
            except Exception:  # noqa: BLE001 - found out row by row
                texts = one_by_one(batch)
            yield batch.assign(**{response: texts})

    return prompts.mapInPandas(call, schema)
