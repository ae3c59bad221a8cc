"""Tables as streams: rows in the order of a number, in slices that arrive one after another."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.shared import shared_dir


def arriving(df: DataFrame, seq: str, slices: int, files: int = 4, again: float = 0.0) -> tuple[DataFrame, str]:
    """(a stream of ``df``, the folder of its state): ``slices`` micro-batches in ascending ``seq``.

    Slices are written in turn, each in ``files`` files, which is also what a micro-batch takes; a slice has far more
    rows than files.  ``again`` of the rows before a slice are delivered once more with it.
    """
    root = f"{shared_dir(df.sparkSession)}/arriving-{uuid.uuid4().hex}"
    low, high = df.agg(F.min(seq), F.max(seq)).first()
    span = (high - low + 1) if low is not None else 0
    for k in range(slices):
        begin, end = (low + span * k // slices, low + span * (k + 1) // slices) if span else (0, 0)
        begin = begin - int((begin - low) * again) if span else 0
        own = df.where((F.col(seq) >= begin) & (F.col(seq) < end))
        own.repartition(files).write.mode("append").parquet(f"{root}/slices")
    stream = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/slices")
    return stream, root
