"""What the operators share: tables in the cluster's shared folder, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..cluster import ship
from ..storage import forget, shared_dir, stored

__all__ = ["column", "forget", "pick", "pieces", "shared_dir", "stored"]

#: Texts are worked on in pieces of about so many bytes, whatever the size of an Arrow batch.
PIECE_BYTES = 1 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns, whatever their names, can't clash later."""
    ship(df.sparkSession)
    return df.select(*[df[n] for n in names])


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of about `limit` bytes of text, with the texts as bytes; null is empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        start, size, held = 0, 0, []
        for i, value in enumerate(column):
            data = value.as_py() or b""
            if held and size + len(data) > limit:
                yield batch.slice(start, len(held)), held
                start, size, held = i, 0, []
            held.append(data)
            size += len(data)
        if held:
            yield batch.slice(start, len(held)), held


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
