"""What the operators of this subpackage share: reading tables, cutting lineage, names and letter case."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where that is unset, as in local tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Written tables of one computation, which cut lineage: a checkpoint computes its frame twice and keeps constraints
    that grow with each round of a loop. What isn't dropped before goes at the end, with the shuffles behind it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame, name: str = "cut") -> DataFrame:
        path = _fresh_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            if id(f) in self.held:
                removed(self.spark, self.held.pop(id(f))[1])

    def __exit__(self, *_) -> None:
        self.drop(*(f for f, _ in list(self.held.values())))
        # Spark removes the files of shuffles that no frame refers to any more once its driver has collected garbage.
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewright-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut, in a written table that stays as long as the frame may be read."""
    return written(df, "cut")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame after it is written to the shared folder and read again; columnar, so smaller than a checkpoint."""
    spark = df.sparkSession
    path = _fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame, in any letter case, doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
