"""Helpers that several corpus operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.session import work_path

#: The six ASCII white-space characters [\x20\x09-\x0D].
WHITE_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of the set that `maybe_among` tests: two megabytes, whatever the number of keys.
MAYBE_BITS = 1 << 24


def maybe_among(keys: DataFrame, *columns: str) -> Column:
    """Whether a row's columns may be one of `keys`: true for all keys, and for a few others by chance.

    The keys' hashes set bits of one value of fixed size, which travels to the tasks in place of the keys. It lets a
    scan leave out work on wide columns that would otherwise have to be shuffled to meet the keys; what must be exact
    is joined afterwards on narrow rows. The more keys there are, the more rows pass by chance.
    """
    spark = keys.sparkSession
    place = F.pmod(F.xxhash64(*columns), F.lit(MAYBE_BITS))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(word.alias("id"), bit.alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = spark.range(MAYBE_BITS >> 6).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda w: w["bits"]).alias("bits")).scalar()
    return F.get(table, word.cast("int")).bitwiseAND(bit) != 0


class Scratch:
    """Tables written to the shared folder for the length of a `with` block.

    For wide intermediate rows that are read more than once. What leaves the block must not read them
    any more: return it through `lumenary.session.cut_lineage`.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.paths = spark, name, []

    def __enter__(self) -> "Scratch":
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.append(path := work_path(self.spark, self.name))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_parts(self, df: DataFrame, column: str, values: tuple) -> list[tuple[DataFrame, str]]:
        """(table, folder) per value of a column, from one pass over `df`; `drop` takes a folder."""
        self.paths.append(path := work_path(self.spark, self.name))
        df.write.partitionBy(column).parquet(path)
        schema = df.drop(column).schema
        parts = [f"{path}/{column}={str(value).lower()}" for value in values]
        for part in parts:  # a value without rows has no folder yet
            self.spark.createDataFrame([], schema).write.mode("append").parquet(part)
        return [(self.spark.read.schema(schema).parquet(part), part) for part in parts]

    def drop(self, folder: str) -> None:
        """Delete a part that is no longer read, before the block ends."""
        remove(self.spark, folder)

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems, wherever the shared folder lies."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(conf).delete(there, True)


def document(id_col: Column, text: Column) -> Column:
    """What tells documents apart: the id, and a hash of the text for rows that repeat an id."""
    return F.struct(id_col.alias("id"), F.xxhash64(text).alias("tag"))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of `docs` whose `document` is a `doc` of `kept`, all columns as they are.

    `kept` has a row per document and `n_tied`, the number of rows that repeat its id and text; of those
    rows one stays.
    """
    packed = docs.select(F.struct("*").alias("full"))
    packed = packed.withColumn("doc", document(F.col(f"full.{id_col}"), F.col(f"full.{text_col}")))
    once = packed.join(kept.filter("n_tied = 1"), "doc", "left_semi")
    repeated = packed.join(kept.filter("n_tied > 1"), "doc", "left_semi").dropDuplicates(["doc"])
    return once.unionByName(repeated).select("full.*")
