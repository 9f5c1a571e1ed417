"""Shared helpers of the corpus operators: reading, words, cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
#: A small table is broadcast only up to this many rows; beyond it joins shuffle.
BROADCAST_ROWS = 50_000

_roots: dict[str, SparkSession] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n), F.lit(0))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), "")


def bounded(rows: DataFrame, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """All labelled rows, or where there are more a sample of about max_rows, chosen by a hash of the id.

    The hash is compared over its full width, so the share may be as small as a table is large.
    """
    n = rows.count()
    return rows if n <= max_rows else rows.where(F.xxhash64(F.col(id_col), F.lit(97)) <= hash_bound(max_rows, n))


def hash_bound(most: int, n: int) -> int:
    """The 64-bit hash up to which about most of n rows lie."""
    return -(1 << 63) + min((1 << 64) - 1, (most << 64) // max(1, n))


def shared_root(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, as in tests, a local one is set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = _roots_local(spark)
    return f"{top.rstrip('/')}/skein-{uuid.uuid4().hex}"


_local: list[str] = []


def _roots_local(spark: SparkSession) -> str:
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="skein-"))
    return _local[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    The lineage ends there: a lost executor costs a reread, not a recompute.
    The folder goes when the driver ends.
    """
    spark = df.sparkSession
    root = shared_root(spark)
    path = f"{root}/{name}"
    df.write.parquet(path)
    _roots[root] = spark
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (out, root)
    return out


_tables: dict[int, tuple[DataFrame, str]] = {}


def _delete(root: str) -> None:
    spark = _roots.pop(root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Parts:
    """A table in the shared folder that several jobs write one after another."""

    def __init__(self, spark: SparkSession, name: str, schema: str) -> None:
        root = shared_root(spark)
        self.spark, self.schema, self.path = spark, schema, f"{root}/{name}"
        _roots[root] = spark
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def release(*tables: DataFrame) -> None:
    """Delete written tables whose last reader has been written."""
    for t in tables:
        if known := _tables.pop(id(t), None):
            _delete(known[1])


@atexit.register
def _sweep() -> None:
    for root in list(_roots):
        try:
            _delete(root)
        except Exception:  # the session is gone already
            return


#: Where a row of a written table lies.
ROW_KEY = ("_row_file", "_row_number")


def row_keys(df: DataFrame) -> DataFrame:
    """The frame with the place of each row in the files it is read from, whatever its ids.

    A frame that is not read from files is written first.
    """
    place = [F.col("_metadata.file_path").alias(ROW_KEY[0]), F.col("_metadata.row_index").alias(ROW_KEY[1])]
    try:
        return df.select("*", *place)
    except AnalysisException:
        return materialize(df, "rows").select("*", *place)


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of row_keys() that gone, a written table of their places, does not name; a short list is broadcast."""
    n = gone.count()
    return df.join(F.broadcast(gone) if n <= 4 * BROADCAST_ROWS else gone, list(ROW_KEY), "left_anti").drop(*ROW_KEY)


def join_hot(df: DataFrame, dim: DataFrame, on: str, n_col: str, n_rows: int) -> DataFrame:
    """Inner join with a table of groups (one row per key, its number of rows in n_col), hot keys apart.

    Keys of so many rows that no more than BROADCAST_ROWS of them can exist are broadcast, so
    their rows stay where they are; the others are shuffled by key.
    """
    hot = F.col(n_col) >= max(1000, n_rows // BROADCAST_ROWS)
    first = df.join(F.broadcast(dim.where(hot).withColumn("_hot", F.lit(True))), on, "left")
    rest = first.where("_hot IS NULL").select(*df.columns).join(dim.where(~hot), on)
    columns = [*df.columns, *[c for c in dim.columns if c != on]]
    return first.where("_hot").select(*columns).unionByName(rest.select(*columns))


def join_dim(df: DataFrame, dim: DataFrame, on: list[str], id_col: str, dim_rows: int, how: str = "left") -> DataFrame:
    """Join a grouped table back to its rows.

    dim has one row per key. It is broadcast while dim_rows (a count the caller
    took) stays within BROADCAST_ROWS; a larger one is copied to 16 salts, so
    that a key holding a third of the rows is dealt over 16 tasks.
    """
    if dim_rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(dim), on, how)
    salts = 16
    salted = dim.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    left = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int"))
    return left.join(salted, [*on, "_salt"], how).drop("_salt")
