"""What a run leaves behind: data sets with a manifest, a history of metrics, a forecast with a digest of its series."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(rows: DataFrame) -> str:
    """A digest of rows that does not depend on their order or partitions."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).alias("s")).first()
    return f"{found['n']}-{found['s'] or 0}"


def write_dataset(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> DataFrame:
    """Each table in a folder of its own, and a manifest of what was written: table, rows, digest and columns."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in sorted(tables.items()):
        df.write.format(form).mode("error").save(f"{folder}/{name}")
        written = spark.read.schema(df.schema).format(form).load(f"{folder}/{name}")
        rows.append((name, written.count(), digest(written), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)))
    manifest = spark.createDataFrame(rows, "table string, rows long, digest string, columns string")
    manifest.coalesce(1).write.mode("error").json(f"{folder}/manifest")
    return manifest


def append_history(spark: SparkSession, folder: str, milestone: str, metrics: str) -> bool:
    """Append a row of metrics to a history, unless it is what the milestone has already; whether it was appended."""
    try:
        seen = spark.read.parquet(folder).where((F.col("milestone") == milestone) & (F.col("metrics") == metrics)).limit(1).count()
    except AnalysisException:  # no history yet
        seen = 0
    if not seen:
        spark.createDataFrame([(milestone, metrics)], "milestone string, metrics string").write.mode("append").parquet(folder)
    return not seen


def write_forecast(report: DataFrame, series: DataFrame, folder: str) -> None:
    """A forecast's report, with the digest of the series that it was made from."""
    report.withColumn("series_digest", F.lit(digest(series))).write.mode("overwrite").parquet(folder)


def is_stale(spark: SparkSession, series: DataFrame, folder: str) -> bool:
    """Whether a report was made from another series than this one."""
    found = spark.read.parquet(folder).select("series_digest").distinct().collect()
    return [r["series_digest"] for r in found] != [digest(series)]
