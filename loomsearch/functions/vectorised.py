"""Arrow-batched UDFs that modules can define without a session: the UDF is made where it is called."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf, pandas_udf


#: Rows and bytes that one Arrow batch holds at most; a longer text is a batch of its own.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch, so that a batch of long texts fits a Python worker. Holds for the session."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        number, unit = re.fullmatch(r"(-?\d+)\s*([kmg]?)b?", spark.conf.get(f"spark.sql.execution.arrow.{name}").lower()).groups()
        own = int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
        if own > most or own <= 0:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


#: Bytes of a batch that are taken at once.
PIECE = 1 << 21


def vectorised(returns: str, once: bool = False) -> Callable[[Callable], Callable[..., Column]]:
    """A function of pandas Series as a function of columns. once: no filter on its result is moved below it, which would run it twice."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            tune(SparkSession.active())
            own = pandas_udf(f, returns)
            return (own.asNondeterministic() if once else own)(*columns)

        return call

    return wrap


def arrow_vectorised(returns: str, once: bool = False) -> Callable[[Callable], Callable[..., Column]]:
    """A function of Arrow arrays, row by row, as a function of columns; it gets a batch in pieces. once: as for `vectorised`."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def run(*arrays):
            size = max(1, len(arrays[0]) * PIECE // max(PIECE, sum(x.nbytes for x in arrays)))
            parts = [f(*[x.slice(s, size) for x in arrays]) for s in range(0, len(arrays[0]), size)]
            return pa.concat_arrays(parts) if parts else f(*arrays)

        run.__signature__ = inspect.signature(f)
        run.__annotations__ = f.__annotations__

        @wraps(f)
        def call(*columns: Column | str) -> Column:
            tune(SparkSession.active())
            own = arrow_udf(run, returns)
            return (own.asNondeterministic() if once else own)(*columns)

        return call

    return wrap


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """White-space words of a batch: each word's row, its place in the vocabulary, and the vocabulary. A null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    row = pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    return row[full.to_numpy(zero_copy_only=False)].astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary
