"""The shared scratch folder, and small helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir`` of the session.

    Only a session in one process (tests, a laptop) gets a local folder where that is unset;
    elsewhere each machine would write to a disk of its own, so that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        found = sc._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not sc.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to."""
    return f"{scratch_root(spark)}/palimpsest/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables that this process saved in the catalogue, and where their files are.
_TABLES: dict[str, str] = {}


def saved(writer: DataFrameWriter, spark: SparkSession, name: str) -> str:
    """Saves rows as a table of the shared folder, and gives its name."""
    table, path = f"{name}_{uuid.uuid4().hex}", scratch_path(spark, name)
    writer.option("path", path).saveAsTable(table)
    _TABLES[table] = path
    return table


def forget(spark: SparkSession, table: str) -> None:
    """Drops a saved table and deletes its files; what was made of it must have been written."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    _delete(spark, _TABLES.pop(table))


def cleanup(spark: SparkSession) -> None:
    """Drops the tables, and deletes the files, that operators of this application left for their lazy results.

    Results that have not been written yet can't be read after it.
    """
    for table in list(_TABLES):
        forget(spark, table)
    _delete(spark, own_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The rows of df, cut from their lineage by a Parquet table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys of more than one in so many rows are hot: there are fewer of them than this, whatever the table.
SHARE = 4096


def split_join(rows: DataFrame, named: DataFrame, key: list[str], weight: str, share: int = SHARE) -> DataFrame:
    """Inner join of rows with the unique keys of ``named``, whose column ``weight`` says how many rows have the key.

    Hot keys are broadcast, since their number has a bound, and their rows stay where they are.
    The others are shuffled; none has more than one in ``share`` of the rows. Both tables are
    read twice, so they should be written ones.
    """
    most = (named.agg(F.sum(weight)).first()[0] or 0) // share
    hot = F.broadcast(named.filter(F.col(weight) > most))
    often = rows.join(hot, key)
    seldom = rows.join(hot.select(*key), key, "left_anti").join(named.filter(F.col(weight) <= most), key)
    return often.unionByName(seldom)


class SortedBuckets:
    """Tables in the shared folder that are bucketed and sorted by a key, all with one number of buckets.

    Written from rows that a shuffle dealt by that key, each bucket is one sorted file, and joins
    between such tables neither shuffle nor sort them.
    """

    ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"

    def __init__(self, spark: SparkSession, key: list[str]) -> None:
        self.spark, self.key, self.n = spark, key, shuffle_partitions(spark)
        self.made: list[str] = []

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        writer = df.write.bucketBy(self.n, *self.key).sortBy(*self.key)
        before = self.spark.conf.get(self.ORDERED, "false")
        self.spark.conf.set(self.ORDERED, "true")
        try:
            self.made.append(saved(writer.partitionBy(*partition_by) if partition_by else writer, self.spark, name))
        finally:
            self.spark.conf.set(self.ORDERED, before)
        return self.spark.table(self.made[-1])

    def drop(self) -> None:
        """Forgets all tables; what was made of them must have been written."""
        for table in self.made:
            forget(self.spark, table)
        self.made = []


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, cut from their lineage by a checkpoint in the shared folder."""
    scratch_root(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
