"""The folder that driver and executors share, and tables that are cut from their lineage there."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch: whole texts go to Python, so its memory follows the batch and not the table.
BATCHES = {"maxRecordsPerBatch": ("10000", "512"), "maxBytesPerBatch": (str(2**31 - 1), str(8 << 20))}


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only in local mode, where it is unset, a folder of this machine."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lorespark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions and order, computed once and kept in the shared folder: what follows neither
    plans nor computes their lineage again, and a lost executor takes nothing with it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes, each unless the user has set it."""
    for name, (default, small) in BATCHES.items():
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, default) in (default, f"{default}b"):
            spark.conf.set(key, small)


def frames(rows: Iterable[tuple], columns: list[str], text: int | None = None, most: int = 4 << 20, count: int = 5000) -> Iterator[pd.DataFrame]:
    """Rows in frames of at most ``count``, closed too once column ``text`` has ``most`` characters; no more are held."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[text]) if text is not None else 0
        if len(held) >= count or size >= most:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)
