"""Sinks and the annotation store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANUAL = "device string, t_on_us bigint, t_off_us bigint, source string, house string"
RULE = "device string, t_on_us bigint, t_off_us bigint, dur_s double, energy_wh double, source string"


def write_series(df: DataFrame, path: str, keys: Sequence[str] = ("dataset", "building"), *, sort: Sequence[str] = ("meter", "ts_us"), mode: str = "overwrite") -> None:
    """Zstd parquet, stamp first, partitioned by `keys`, rows sorted so that stamp
    ranges prune row groups. Range partitioning splits a hot meter over files."""
    cols = ["ts_us", *[c for c in df.columns if c != "ts_us"]]
    part = [k for k in keys if k in df.columns]
    order = [*part, *[c for c in sort if c in df.columns]]
    out = df.select(*cols).repartitionByRange(*order).sortWithinPartitions(*order)
    (out.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path))


#: Settings under which the parquet reader answers whole-table aggregates from the files' footers.
FOOTERS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_plan(spark: SparkSession, path: str, ranges: Sequence[str], counted: Sequence[str] = ()) -> DataFrame:
    """One row: rows, min_ and max_ of `ranges`, nulls_ of both; to be run under FOOTERS."""
    both = list(dict.fromkeys([*ranges, *counted]))
    got = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), *[F.min(c).alias(f"min_{c}") for c in ranges], *[F.max(c).alias(f"max_{c}") for c in ranges],
                                       *[F.count(c).alias(f"_n_{c}") for c in both])
    return got.select("rows", *[f"{k}_{c}" for c in ranges for k in ("min", "max")], *[(F.col("rows") - F.col(f"_n_{c}")).alias(f"nulls_{c}") for c in both])


def footer_profile(spark: SparkSession, path: str, ranges: Sequence[str], counted: Sequence[str] = ()) -> DataFrame:
    """A table's row count, value ranges and null counts from parquet footers, without reading a column.

    Ranges are for numbers and dates, whose minima and maxima footers hold. Tasks read the footers; one row is kept.
    """
    old = {k: spark.conf.get(k, None) for k in FOOTERS}
    try:
        for k, v in FOOTERS.items():
            spark.conf.set(k, v)
        plan = footer_plan(spark, path, ranges, counted)
        rows = plan.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.createDataFrame(rows, plan.schema)


def series_profile(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] = ("w",)) -> DataFrame:
    """Rows, stamp range and null counts; without keys and filters the scan answers from file metadata
    where the source supports aggregate pushdown."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("ts_us").alias("ts_min_us"), F.max("ts_us").alias("ts_max_us"),
                                 *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def _csv(spark, path, schema):
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition() or e):
            return None
        raise


def read_marks(spark: SparkSession, manual_path: str, rule_path: str) -> DataFrame:
    """Manual and rule cycles with their provenance; a missing or empty file adds nothing."""
    out = spark.createDataFrame([], MANUAL + ", dur_s double, energy_wh double, provenance string")
    for path, schema, prov in ((manual_path, MANUAL, "manual"), (rule_path, RULE, "rule")):
        df = _csv(spark, path, schema)
        if df is not None:
            out = out.unionByName(df.withColumn("provenance", F.lit(prov)), allowMissingColumns=True)
    return out


def write_table_csv(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").option("header", True).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition) if partition else w).csv(path)


def merge_records(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New records replace old ones of the same key, the rest stays."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def md_table(df: DataFrame, max_rows: int = 200) -> str:
    """Markdown of a small report; refuses anything larger."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"report has more than {max_rows} rows; aggregate first")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *[line(r) for r in rows]])


def report_lines(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Markdown table as rows (pos, line) for a text sink; `order` is a small integer column."""
    spark = df.sparkSession
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    body = df.select((F.col(order) + 2).cast("bigint").alias("pos"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = spark.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "pos bigint, line string")
    return head.unionByName(body)
