"""User-function surface.

The built-in paths stay JVM-side; these hooks let a user bring their own
tokenizer, per-batch function or model. All of them are Arrow-batched
(pandas / Arrow UDFs, iterator forms), never row-at-a-time Python UDFs,
and the model/tokenizer is created once per task, not per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


#: Rows whose tokens are Python objects at once; a whole Arrow batch would hold too many.
SLICE = 256


def tokenizer_udf(make_tokenizer: Callable[[], Callable[[str], list]], return_type: str = "array<string>"):
    """Wrap ``make_tokenizer()`` (called once per task) into an
    iterator pandas UDF ``string -> array``."""

    @pandas_udf(return_type)
    def _tok(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = make_tokenizer()
        for s in batches:
            for at in range(0, len(s), SLICE):
                yield s.iloc[at:at + SLICE].map(lambda t: [] if t is None else list(fn(t)))

    return _tok


def tokenise_with(df: DataFrame, text_col: str, make_tokenizer, *, out: str = "tokens",
                  max_len: int | None = None, return_type: str = "array<string>") -> DataFrame:
    """T1 with a pluggable tokenizer."""
    toks = tokenizer_udf(make_tokenizer, return_type)(F.col(text_col))
    if max_len is not None:
        toks = F.slice(toks, 1, max_len)
    return df.withColumn(out, toks)


def apply_per_batch(df: DataFrame, batch_col: str, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """A user collate-like function over each batch as an Arrow table
    (``groupBy(batch).applyInArrow``); a batch is bounded by the batch size."""
    return df.groupBy(batch_col).applyInArrow(fn, schema)


def predict(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
            schema: str) -> DataFrame:
    """U4: batch inference with the user's model, loaded once per task and
    fed Arrow batches (``mapInPandas``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, schema)
