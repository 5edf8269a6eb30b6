"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that part words: space and the five ASCII control spaces.
SPACES = " \t\n\x0b\x0c\r"

#: A key that this part of all rows or more share is met by broadcast; there are as many such keys at most.
HOT = 2_000

_own_dir: str | None = None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs in one struct, so that an operator's own columns can't clash with them."""
    return F.struct(*[docs["`" + c.replace("`", "``") + "`"] for c in docs.columns])


def field_of(row: str, name: str) -> Column:
    """A field of whole_row()."""
    return F.col(row)[name]


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order, as an array."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * 5), " "), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints. Where none is named, a scratch folder of this process will
    do on a single machine and is an error on a cluster, whose executors wouldn't see it."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-tessera-")
    return _own_dir


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends here, and a lost executor costs a reread.

    The files are removed by drop_table(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = jpath
    return table


def drop_table(table: DataFrame) -> None:
    """Remove the files of a shared_table() that nothing reads any more."""
    path = table._shared_path
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def skew_join(rows: DataFrame, table: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined with table, which holds every key once and, as ``_n``, how many of the rows have it.

    Keys of ``total / HOT`` rows and more, HOT of them at most for each way of forming keys, reach the rows by
    broadcast; the others by a shuffle, where no task can get more of one key than that. Both inputs are read twice.
    """
    least = max(1, -(-total // HOT))
    hot = F.broadcast(table.where(F.col("_n") >= least).drop("_n"))
    cold = table.where(F.col("_n") < least).drop("_n")
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def holdout_col(doc_id: str = "doc_id") -> Column:
    """True for the fold that labels are never learned from; a null id belongs to it."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, chars: int = 200_000_000) -> tuple[list[str], list[int]]:
    """At most ``bound`` labelled training texts of ``chars`` characters together, and their labels.

    They are those of the smallest id hashes, whole, up to the first that would exceed the characters. The bounds keep
    what reaches the driver of one size for every corpus. Ids and labels are reduced first; only the chosen ids meet
    the texts. Rows of the held-out fold and null labels or ids never take part; of several labels of one id the
    largest counts, of several texts that of the smallest hash.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~holdout_col())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    rows = (
        docs.select("doc_id", text_of().alias("_t")).join(F.broadcast(ids), "doc_id")  # at most ``bound`` rows
        .groupBy("doc_id").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"), F.first("_y").alias("_y"))
    )
    # As many rows as the bound at most are in this window.
    upto = F.sum(F.length("_t")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.withColumn("_upto", upto).where(F.col("_upto") <= chars).orderBy("doc_id").select("_t", "_y").collect()
    return [r[0] for r in rows], [int(r[1]) for r in rows]
