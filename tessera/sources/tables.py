"""Reading landed tables and text formats, with schemas asserted rather than inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def landed(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table landed as Parquet; ``columns`` prunes the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` cast to ``schema``; missing columns raise, extra ones are dropped."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A delimited file with a header row, under a declared schema; bad rows fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True)


def read_with_found_header(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A delimited sheet whose header is the first row with ``key`` in column one.

    Rows above it are a preamble. Blank names become ``col_<n>`` and repeated
    ones get ``.1``, ``.2``. Only the header row comes to the driver.
    """
    raw = spark.read.option("maxColumns", 20480).csv(path, header=False)
    raw = raw.withColumn("_at", F.monotonically_increasing_id())
    head = raw.where(F.trim("_c0") == key).orderBy("_at").limit(1).collect()
    if not head:
        raise ValueError(f"no row begins with {key!r}")
    from tessera.functions.labels import unique_names

    given = [head[0][c] for c in raw.columns if c != "_at"]
    names = unique_names([(g or "").strip() or f"col_{k}" for k, g in enumerate(given, 1)])
    body = raw.where(F.col("_at") > head[0]["_at"]).drop("_at")
    return body.toDF(*names)


def read_matrix_text(spark: SparkSession, path: str, id_column: str, begin: str = "^TABLE_BEGIN", sep: str = "\t") -> DataFrame:
    """The long form ``(id, feature, value)`` of a text matrix with a marked table section.

    Lines up to ``begin`` are metadata; the next line names the columns. Values
    that are no numbers are null.
    """
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    start = lines.where(F.trim("value") == begin).agg(F.min("_at").alias("s")).first()["s"]
    if start is None:
        raise ValueError(f"no line {begin!r}")
    body = lines.where(F.col("_at") > start)
    head = body.orderBy("_at").limit(1).collect()[0]
    names = head["value"].split(sep)
    at = names.index(id_column)
    cells = body.where(F.col("_at") > head["_at"]).select(F.split("value", sep).alias("c"))
    features = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(k).alias("k")) for k, n in enumerate(names) if k != at])
    return cells.select(F.col("c")[at].alias("id"), "c", F.explode(features).alias("f")).select(
        "id", "f.feature", F.expr("try_cast(c[f.k] AS DOUBLE)").alias("value")
    )


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, md5, bytes)`` of every file below ``path``, hashed where it is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.md5("content").alias("md5"), F.col("length").alias("bytes"))


def split_missing_code(df: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """A text column with special missing codes as ``<column>`` double and ``<column>_missing`` code."""
    raw = F.trim(F.col(column).cast("string"))
    code = F.when(F.lower(raw).isin([c.lower() for c in codes]), F.lower(raw))
    return df.withColumns({f"{column}_missing": code, column: F.when(code.isNull(), F.expr(f"try_cast(`{column}` AS DOUBLE)"))})


def null_for_nan(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null, so that missing is one thing."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
