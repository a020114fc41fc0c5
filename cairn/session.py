"""Session helpers: building a session, reading tables, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session of one process for tests and benches: UTC, AQE, few shuffle partitions, checkpoints in the machine's own folder."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"{tempfile.gettempdir()}/cairn-checkpoints")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's checkpoints, which every node can reach: the one set, or named in ``spark.checkpoint.dir``.

    With neither, a session whose executors run in the driver's process gets a folder beneath its warehouse; on a cluster
    there is no folder of one machine that the others could read, so it is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return sc.getCheckpointDir()


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """What is planned and run herein leaves no shuffle files behind: else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the reliable checkpoint folder and read it back: lineage ends, and a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    with _released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, so that df itself keeps no shuffle that is gone


def written(df: DataFrame) -> DataFrame:
    """Like cut, as a compressed table of columns: for what is read more than once, each time in part.

    Spark takes its size to be that of the compressed files, and of what is made from it no more, however many rows that has.
    A join with either that grows with the data needs the hint "merge", or it is broadcast while it fits no driver.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain(frame: pd.DataFrame, text: Sequence[str] = ()) -> pd.DataFrame:
    """Text as objects with None: an Arrow string of several chunks, or a text column of nothing but NaN, can't be sent back."""
    out = frame.copy()
    for c in {*text, *(c for c, t in frame.dtypes.items() if isinstance(t, pd.StringDtype))}:
        out[c] = frame[c].astype(object).where(frame[c].notna(), None)
    return out


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that every group of equal keys lies in one frame; the last, open group is carried on."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = b[list(keys)].iloc[-1]
        same = (b[list(keys)] == last).all(axis=1).to_numpy()
        start = len(b) - int(same[::-1].cumprod().sum())  # where the last group begins
        if start == 0 and held and (held[-1][list(keys)].iloc[-1] == last).all():
            held.append(b)
            continue
        if start:
            held.append(b.iloc[:start])
        if held:
            yield plain(pd.concat(held, ignore_index=True)) if len(held) > 1 else held[0].reset_index(drop=True)
        held = [b.iloc[start:]]
    if held:
        yield plain(pd.concat(held, ignore_index=True)) if len(held) > 1 else held[0].reset_index(drop=True)
