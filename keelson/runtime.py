"""Session helpers: the shared folder and lineage cuts for iterative operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Rows of the source tables for each shuffle partition; bytes of a scan's task, and of a shuffled one that adaptive execution joins.
ROWS_A_TASK = 200_000
BYTES_A_SCAN = 16 << 20
BYTES_A_SHUFFLE = 4 << 20

_rows: dict[tuple[str, str, str], int] = {}


class QueryError(ValueError):
    """A query, expression or constraint that is not valid."""


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, where all share one disk, else one below /tmp."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: later steps survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fit_tasks(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Deal the work on some tables over as many tasks as their rows ask for, so that no task grows with the tables.

    Raises the session's number of shuffle partitions, which adaptive execution
    joins again where they turn out small, and bounds what a scan's task reads.
    """
    total = 0
    for name in names:
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _rows:
            _rows[key] = table(spark, sf_dir, name).count()  # from the files' footers
        total += _rows[key]
    if total // ROWS_A_TASK > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(total // ROWS_A_TASK))
    if total > 5 * ROWS_A_TASK:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(BYTES_A_SCAN))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(BYTES_A_SHUFFLE))
