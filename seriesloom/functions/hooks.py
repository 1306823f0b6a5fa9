"""User hooks over samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_hook(samples: DataFrame, hook: Callable[[dict], str | None], base: str = "caption", least: int = 4) -> DataFrame:
    """Captions by a user function of a sample (a dict of its columns); its text counts if it has at least `least`
    characters, else the base caption stays. An exception in the hook also leaves the base caption."""

    def call(row: dict) -> str | None:
        try:
            return hook(row)
        except Exception:  # a user's function must not end the job
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(_hooked=[call(r) for r in batch.to_dict("records")])

    out = samples.mapInPandas(run, T.StructType([*samples.schema.fields, T.StructField("_hooked", T.StringType())]))
    return out.withColumn(base, F.when(F.length(F.trim("_hooked")) >= least, F.trim("_hooked")).otherwise(F.col(base))).drop("_hooked")
