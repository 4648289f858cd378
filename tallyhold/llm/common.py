"""Text expressions and shared-storage helpers for the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
#: What separates words of letters, digits and non-ASCII characters, once A-Z are in lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many sets of 4,096 bits, each of 4,096 row numbers, are sent to every task at most (some 70 MB).
BIT_SETS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() does just that where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def white_words(text: Column) -> Column:
    """The runs of characters that aren't ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE, -1), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters; null text has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def others(docs: DataFrame, *own: str) -> list[str]:
    """The columns of docs but for those that an operator makes or replaces (own); names are compared as Spark does, without case."""
    mine = {c.lower() for c in own}
    return [c for c in docs.columns if c.lower() not in mine]


def fresh(docs: DataFrame, name: str) -> str:
    """A name like this one that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ref(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Only a local session may do without the setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and there for any executor that has to start again."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing is going to read again."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()[:1]}:
            remove(t.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of jobs that are done: Spark deletes them once the driver's JVM has collected what refers to them, which may take long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bits(numbers: DataFrame) -> DataFrame:
    """The one column of numbers (not negative) as sets of 4,096 bits, for among(); small enough to go to every task, or else joined as any table."""
    n = F.col(numbers.columns[0])
    each = numbers.select(F.shiftright(n, 12).alias("_set"), F.shiftright(n, 6).bitwiseAND(F.lit(63)).cast("int").alias("_word"), F.expr(f"shiftleft(1L, CAST({numbers.columns[0]} & 63 AS INT))").alias("_bit"))
    words = each.groupBy("_set", "_word").agg(F.bit_or("_bit").alias("_bits")).groupBy("_set").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_bits"))
    sets = written(words.select("_set", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("_bits", i), F.lit(0).cast("long"))).alias("_bits")), "bits")
    return F.broadcast(sets) if sets.count() <= BIT_SETS else sets


def among(df: DataFrame, sets: DataFrame, n: Column, how: str = "left_semi") -> DataFrame:
    """The rows of df whose number n is among those of bits() (left_anti: isn't). Its rows, which may be long, aren't shuffled."""
    there = F.bit_get(F.get("_bits", F.shiftright(n, 6).bitwiseAND(F.lit(63)).cast("int")), n.bitwiseAND(F.lit(63)).cast("int")) == 1
    return df.join(sets, (F.shiftright(n, 12) == F.col("_set")) & there, how)


def running_total(df: DataFrame, group: str, order: list[str], value: str, into: str) -> DataFrame:
    """Adds the sum of value over the group's earlier rows in the given order; rows with equal order count in any sequence.

    Range partitions hold contiguous stretches of a group, so a group of any size is spread over tasks:
    totals by (group, stretch) give each stretch its start, and a window within the stretch the rest.
    """
    from pyspark.sql import Window as W

    ranged = written(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in [group, *order]]).withColumn("_stretch", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(group, "_stretch").agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(group).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col(group).alias("_group"), F.col("_stretch").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = W.partitionBy(group, "_stretch").orderBy(*[F.col(c).asc_nulls_last() for c in order], value).rowsBetween(W.unboundedPreceding, -1)
    inner = ranged.withColumn("_before", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_stretch") == F.col("_at"))).withColumn(into, F.col("_start") + F.col("_before")).drop("_stretch", "_before", "_group", "_at", "_start")
