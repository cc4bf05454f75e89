"""Written tables in the cluster's shared folder.

A table that several plans start from is written once and read back. That cuts the
lineage in a way that survives the loss of any executor, and later readers get
column pruning and pushed filters.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session uses a folder under its warehouse. On a cluster that could be
    a folder of one machine, so there it is an error.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} has to name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder, and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.conf.get('spark.app.id')}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_by_person(
    df: DataFrame, name: str, key: str = "caseid", order: tuple[str, ...] = ("wave",), buckets: int | None = None
) -> DataFrame:
    """``df`` written under the shared folder in buckets of ``key``, sorted, and read back as a table.

    The one shuffle is paid here: windows, sums and joins by ``key`` on what is read need none. There
    are as many buckets as the session has shuffle partitions, unless given. The table is known to
    this session only; its files stay.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:8]}"
    path = f"{shared_dir(spark)}/{spark.conf.get('spark.app.id')}/{table}"
    writer = df.repartition(count, key).write.format("parquet").bucketBy(count, key).sortBy(key, *order)
    writer.option("path", path).saveAsTable(table)
    return spark.table(table)
