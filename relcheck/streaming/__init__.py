"""Row checks on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.coerce import names
from ..operators.master import Master, _full, diagnostics, typed


def check_stream(stream: DataFrame, master: Master, path: str, checkpoint: str) -> StreamingQuery:
    """Write the diagnostics of each batch of a typed stream to path/batch=N.

    Keys are compared within a batch, and with those of earlier batches, which are
    kept in path-keys. A batch that is repeated after a failure overwrites its own
    folders and looks at none after it.
    """
    key = [f"`{p}`" for p in master.primary]

    def check(batch: DataFrame, number: int) -> None:
        table = typed(batch, master.fields, master.primary).persist()
        keys = table.filter(" and ".join(f"{k} is not null" for k in key)).select(*key)
        found = diagnostics(table, master)
        if number:
            before = batch.sparkSession.read.schema(keys.schema.add("batch", "long")).parquet(f"{path}-keys")
            before = before.filter(F.col("batch") < number).select(*key).distinct()
            first = table.select(*key, names(master.fields).line).join(before, list(master.primary), "left_semi").dropDuplicates(list(master.primary))
            told = F.concat_ws(", ", *[F.concat(F.lit(f"{p}="), F.col(k).cast("string")) for p, k in zip(master.primary, key, strict=True)])
            found = found.union(_full(first, master.name, "", code=F.lit("duplicate_primary_key"), key=told, row=F.col(names(master.fields).line), detail=F.lit("in an earlier batch")))
        found.write.mode("overwrite").json(f"{path}/batch={number}")
        keys.distinct().write.mode("overwrite").parquet(f"{path}-keys/batch={number}")
        table.unpersist()

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
