"""Arrow batches of texts in, Arrow results out."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F


def text_udf(returns: str, work: Callable[[list[bytes | None]], pa.Array]):
    """A column function of a text column: ``work`` gets a batch's texts as UTF-8 bytes.

    Marked non-deterministic, so that the optimiser evaluates it once where several fields of its result are used.
    """

    def call(text: pa.Array) -> pa.Array:
        return work(text.cast(pa.binary()).to_pylist())

    call.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(call, returns).asNondeterministic()
