"""Symbol dimensions, fundamentals and analyst files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def numeric(name: str):
    """A text column as a double; blank, 'None' and unreadable text become NULL."""
    text = F.nullif(F.nullif(F.trim(F.col(name).cast("string")), F.lit("")), F.lit("None"))
    return text.try_cast("double")


def clean_numeric(df: DataFrame, columns) -> DataFrame:
    """Numbers read as text, made double; an absent figure is NULL and never 0."""
    columns = set(columns)
    return df.select(*[numeric(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _text_csv(spark, path, names):
    """Named columns as text; a file may hold them in any order."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n)
                       for n in names])


def _or(name, default):
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(default))


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    raw = _text_csv(spark, path, schemas.SYMBOLS.names)
    return raw.withColumn("is_index", F.col("is_index").try_cast("int"))


def shape_universe(raw: DataFrame) -> DataFrame:
    """Blank company number is NULL, blank sector 'Unclassified', blank venue ''."""
    return raw.select("symbol", F.nullif(F.trim("cik"), F.lit("")).try_cast("long").alias("cik"),
                      "name", _or("sector", "Unclassified").alias("sector"),
                      _or("exchange", "").alias("exchange"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return empty(spark, schemas.UNIVERSE)
    return shape_universe(_text_csv(spark, path, schemas.UNIVERSE.names))


def shape_fundamentals(raw: DataFrame) -> DataFrame:
    return (clean_numeric(raw, schemas.FUNDAMENTAL_NUMBERS)
            .withColumn("cik", numeric("cik").cast("long"))
            .withColumn("asof", F.try_to_date(F.col("asof").cast("string")))
            .select(*schemas.FUNDAMENTALS.names))


def read_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return empty(spark, schemas.FUNDAMENTALS)
    return shape_fundamentals(_text_csv(spark, path, schemas.FUNDAMENTALS.names))


def read_analyst(spark: SparkSession, path: str) -> DataFrame:
    """Optional consensus figures; without the file the table exists and is empty."""
    if not path_exists(spark, path):
        return empty(spark, schemas.ANALYST)
    return clean_numeric(_text_csv(spark, path, schemas.ANALYST.names), schemas.ANALYST_NUMBERS)
