"""Helpers shared by the training-data operators: tables, lineage cuts, skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words for most operators: ASCII white space.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none and runs on one machine (tests) a local one is set; a
    cluster without the setting is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.conf.get("spark.sievelight.shared.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="sievelight-")
        spark.conf.set("spark.sievelight.shared.dir", place)
    return place.rstrip("/")


def materialise(df: DataFrame, tag: str, free: bool = False, codec: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    The files go when the driver's JVM ends. With free, the driver's garbage is
    collected, so that Spark drops the shuffle files behind what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievelight/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    jvm, jsc = spark._jvm, spark._jsc
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(place)
    if free:
        jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a slim table that the driver keeps instead of a file.
FEW_ROWS = 1 << 14


def few_rows(df: DataFrame, few: int | None = None) -> list[Row] | None:
    """The rows of a slim table if they are few, else None; the driver gets few + 1 at most."""
    few = FEW_ROWS if few is None else few
    rows = df.limit(few + 1).collect()
    return rows if len(rows) <= few else None


def held(df: DataFrame, tag: str, few: int | None = None) -> DataFrame:
    """A slim table whose lineage is cut: few rows are kept by the driver, more are written."""
    rows = few_rows(df, few)
    return materialise(df, tag) if rows is None else df.sparkSession.createDataFrame(rows, df.schema)


#: Ids whose bits are broadcast at most, bits for each, and keys broadcast at most.
FEW_IDS, ID_BITS, FEW_KEYS = 1 << 22, 8, 1 << 20


def only(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is in ids (distinct), and up to FEW_IDS ids maybe a few more:
    then ids travel as a bit table of at most 2**25 bits, so that rows don't shuffle."""
    n = ids.count()
    if n > FEW_IDS:
        return rows.join(ids, key, "left_semi")
    size = 1 << max(10, (max(1, n) * ID_BITS - 1).bit_length())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    bits = ids.select(place(key).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    at = place(f"probe_{key}")
    probed = rows.withColumn(f"probe_{key}", F.col(key))
    hit = probed.join(F.broadcast(bits), F.shiftright(at, 6) == F.col("word"))
    return hit.where(F.getbit("bits", at.bitwiseAND(63).cast("int")) == 1).select(*rows.columns)


def small(keys: DataFrame, n: int) -> DataFrame:
    """keys, marked for broadcast if n, their number, is small; else Spark's choice."""
    return F.broadcast(keys) if n <= FEW_KEYS else keys


def attach(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Left join of rows with one row of groups per key, safe against hot keys.

    groups.size counts the rows of a key. A key with more than a thousandth of
    all rows is hot; by arithmetic there are fewer than 1000 such keys, so they
    are broadcast and their rows stay where they are. All others shuffle.
    """
    hot = groups.where(F.col(size) * 1000 > total)
    cold = groups.where(~(F.col(size) * 1000 > total))
    here = rows.join(F.broadcast(hot), key)
    keys = [key] if isinstance(key, str) else key
    rest = rows.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(cold, key, "left")
    return here.unionByName(rest)


#: Rows of a scan's column batch, rows and bytes of an Arrow batch: texts are long, and
#: these are what an executor's heap and buffers and a Python worker hold at a time.
BOUNDS = {
    "spark.sql.parquet.columnarReaderBatchSize": 512,
    "spark.sql.execution.arrow.maxRecordsPerBatch": 2000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20,
    "spark.sql.execution.arrow.maxBytesPerOutputBatch": 8 << 20,
}


def bounded(spark: SparkSession) -> None:
    """Set the session's batch sizes for long texts."""
    for name, most in BOUNDS.items():
        spark.conf.set(name, str(most))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a context, and bound batches."""
    bounded(spark)
    context = spark.sparkContext
    if getattr(context, "_sievelight_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    place = Path(tempfile.mkdtemp(prefix="sievelight-code-")) / "sievelight.zip"
    with zipfile.ZipFile(place, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(place))
    context._sievelight_shipped = True


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def sql_text(col: str = "text") -> str:
    return f"coalesce({col}, '')"
