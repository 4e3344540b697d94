"""Tables between the steps of an operator, and a filter of fixed size for join keys."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowmend import parallel, shipping, storage

# Bits of a filter: sixteen per marked row, between 2 and 32 MB.
FILTER_BITS, MOST_FILTER_BITS = 1 << 24, 1 << 28
_BUCKET_BITS = 32_768


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ready(df: DataFrame) -> SparkSession:
    """The session, after the package has been sent to the executors."""
    shipping.ship_package(df.sparkSession)
    return df.sparkSession


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder, read back: survives lost executors, keeps pushdown."""
    return temporary(df, name)[0]


def temporary(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, with the path for ``release``."""
    path = storage.fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Give back the space of written tables that nothing reads any more."""
    for path in paths:
        spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``(whole, row)``: each row as a struct, and what tells it apart from all others, also when a task runs again.

    A table read from files has its file and place in it, so nothing is written. Others
    are written with a number.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole")
    file, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    if "_metadata" not in df.columns:
        # Two hashes of the path, 128 bits, instead of the path itself.
        row = F.struct(F.xxhash64(file).alias("file"), F.xxhash64(F.lit(1), file).alias("again"), place.alias("place"))
        try:
            return df.select(whole, row.alias("row"))
        except AnalysisException:
            pass
    return written(df.select(whole, F.struct(F.monotonically_increasing_id().alias("place")).alias("row")), name)


def without(numbered_rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``numbered`` whose ``row`` is not in the written table ``dropped``, as they were.

    Rows that a bitmap of ``dropped`` rules out go on where they are; only the others,
    about as many as are dropped, are shuffled with their texts.
    """
    key = F.xxhash64("row")
    marked = only_possible(numbered_rows, key, dropped, key, "__perhaps")
    unsure = marked.filter("__perhaps").join(dropped, "row", "left_anti")
    return marked.filter("not __perhaps").select("whole.*").unionByName(unsure.select("whole.*"))


def tasks(spark: SparkSession) -> int:
    return parallel.tasks(spark)


def hash_below(hashed: Column | str, wanted: int, rows: int) -> Column:
    """Whether a 64-bit hash is among the smallest: holds for some ``wanted`` of ``rows`` different hashes, for all if there are fewer."""
    if rows <= wanted:
        return F.lit(True)
    return (F.col(hashed) if isinstance(hashed, str) else hashed) < F.lit(-(1 << 63) + (1 << 64) * wanted // rows)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits)) + F.lit(1)


def only_possible(df: DataFrame, key: Column, marked: DataFrame, marked_key: Column, flag: str) -> DataFrame:
    """Add ``flag``: false only if no row of ``marked`` has this 64-bit key.

    ``marked``, a written table, becomes a bitmap of at most ``MOST_FILTER_BITS`` bits (32 MB
    in 8192 rows), which is why broadcasting it is safe. A few other keys pass too, more
    when the bitmap fills up; the exact join comes after. It saves shuffling the rest.
    """
    bits = min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (16 * marked.count()).bit_length()))
    slot = _slot(marked_key, bits)
    bitmap = marked.select(
        F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit")
    ).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    keyed = df.withColumn("__slot", _slot(key, bits))
    joined = keyed.join(F.broadcast(bitmap), F.bitmap_bucket_number("__slot") == F.col("bucket"), "left")
    position = F.bitmap_bit_position("__slot")
    byte = F.conv(F.hex(F.substring("bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (position % 8).cast("int")) == 1
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__slot", "bucket", "bits")
