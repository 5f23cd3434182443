"""Sources: text files, directories, JSON lines, mappings and request bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_SCHEMA = "id int, text string, expected_pii array<string>, category string, note string"

#: Formats input is read from.
FORMATS = ("json", "text", "parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small input that comes in fewer parts than there are task slots, dealt out to all of them; a larger one as it is.

    For operators whose work per row outweighs moving the row once. A scan makes no parts below the cost of opening a
    file, so by the planner's size of the input it has too few if that many for each slot don't fit in.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        least = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes")))
    except Exception:  # noqa: BLE001  the estimate is an internal of the planner
        return df
    return df.repartition(slots) if size < slots * least else df


def read_stdin(spark: SparkSession, stream=None) -> DataFrame:
    """(text): what stands on standard input as one text; blank input is an error."""
    import sys

    text = (stream or sys.stdin).read()
    if not text.strip():
        raise ValueError("blank input")
    return spark.createDataFrame([(text,)], "text string")


def read_text_files(spark: SparkSession, path: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(path, text): each file whole."""
    return (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def scan_directory(spark: SparkSession, path: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(path, text, error): each file whole; a file that isn't UTF-8 text has its error instead of a text, the others go on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", text.alias("text"), F.when(text.isNull(), F.lit("not valid UTF-8")).alias("error"))


def read_json_lines(spark: SparkSession, path: str, schema: str = SAMPLE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parse_mapping(column):
    """A mapping stored as a JSON object."""
    return F.from_json(column, "map<string,string>")


def require_text(df: DataFrame, column: str) -> DataFrame:
    """Raises on a blank text while the query runs, as a single blank input is an error."""
    return df.withColumn(column, F.when(F.length(F.trim(F.coalesce(column, F.lit("")))) == 0, F.raise_error(F.lit("blank input"))).otherwise(F.col(column)))
