"""The folder that driver and executors share, tables written to it, and ranks without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder of the session's ``spark.checkpoint.dir``.

    Only where that is unset and the whole session runs on one machine, as in tests, a temporary folder is made and set;
    a cluster without it is an error, as a local folder would be another one on each machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='radiolake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/radiolake-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    This cuts the lineage: what follows reads files that outlive any executor and never repeats the work above.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """Adds the 0-based rank in the order given, with no task that holds all rows.

    The rows are dealt by range; each partition numbers its own and adds the size of those before it. Only one row
    for each partition meets in one task. Ties take any order among themselves.
    """
    dealt = staged(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*order)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        dealt.withColumn("__i", F.row_number().over(inside) - 1)
        .join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
        .withColumn(name, (F.col("__i") + F.col("__before")).cast("long"))
        .drop("__part", "__i", "__before")
    )
