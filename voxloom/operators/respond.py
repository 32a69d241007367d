"""Apply a caller's answering function to a prompt table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def respond(
    prompts: DataFrame,
    make_responder: Callable[[], Callable[[str], str]],
    prompt: str = "prompt",
    attempts: int = 3,
) -> DataFrame:
    """Add ``response``, ``error`` and ``attempts``; a failure is never an answer.

    ``make_responder`` runs once per Python worker. Spark may run a task again
    after a lost executor, so write the result once and parse the written table.
    """
    kept = [f for f in prompts.schema.fields if f.name != prompt]
    schema = T.StructType(
        kept
        + [
            T.StructField("response", T.StringType()),
            T.StructField("error", T.StringType()),
            T.StructField("attempts", T.IntegerType()),
        ]
    )
    names = [f.name for f in kept]

    def answer(responder: Callable[[str], str], text: str) -> tuple[str | None, str | None, int]:
        error = None
        for attempt in range(1, attempts + 1):
            try:
                return responder(text), None, attempt
            except Exception as failure:  # the caller's function may fail in any way
                error = f"{type(failure).__name__}: {failure}"
        return None, error, attempts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        responder = make_responder()
        for batch in batches:
            out = batch[names].copy()
            rows = [answer(responder, text) for text in batch[prompt]]
            out["response"] = [r[0] for r in rows]
            out["error"] = [r[1] for r in rows]
            out["attempts"] = [r[2] for r in rows]
            yield out

    return prompts.mapInPandas(run, schema)


def answered(responses: DataFrame) -> DataFrame:
    return responses.where("response IS NOT NULL AND error IS NULL")
