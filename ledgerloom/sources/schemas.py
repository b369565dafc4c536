"""The advisor's tables as Spark schemas, and how they are stored.

Time series are partitioned by day, so range scans prune files; logs are append-only. There are no secondary indexes:
files are sorted by the column that lookups filter on, so Parquet statistics skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(spec: str, required: str = "") -> T.StructType:
    need = set(required.split())
    kinds = {
        "long": T.LongType(),
        "int": T.IntegerType(),
        "string": T.StringType(),
        "double": T.DoubleType(),
        "boolean": T.BooleanType(),
        "timestamp": T.TimestampType(),
    }
    return T.StructType([T.StructField(n, kinds[k], n not in need) for n, k in (c.split(":") for c in spec.split())])


SCHEMAS = {
    "ohlcv_data": _schema(
        "ticker:string timestamp:timestamp open:double high:double low:double close:double volume:double",
        "ticker timestamp open high low close volume",
    ),
    "users": _schema("id:long email:string name:string picture:string virtual_balance:double", "id email virtual_balance"),
    "trade_log": _schema(
        (
            "id:long user_id:long ticker:string side:string quantity:double fill_price:double slippage:double timestamp:timestamp "
            "virtual_balance_after:double"
        ),
        "id user_id ticker side quantity fill_price slippage",
    ),
    "portfolios": _schema(
        "id:long user_id:long ticker:string quantity:double avg_cost:double sl_pct:double tg_pct:double",
        "id user_id ticker",
    ),
    "sentiment_scores": _schema(
        "id:long ticker:string timestamp:timestamp score:double source_count:int confidence:double",
        "id ticker score",
    ),
    "alert_log": _schema(
        (
            "id:long user_id:long ticker:string alert_type:string message:string signal:string price_at_alert:double is_read:boolean "
            "created_at:timestamp"
        ),
        "id user_id alert_type",
    ),
    "alert_feedback": _schema("id:long alert_id:long user_id:long is_positive:boolean created_at:timestamp", "id alert_id user_id"),
    "signal_log": _schema(
        (
            "id:long user_id:long ticker:string signal:string price_at_signal:double rationale:string outcome:string outcome_price:double "
            "outcome_checked_at:timestamp created_at:timestamp"
        ),
        "id user_id",
    ),
}
#: The time column that a table is partitioned by day of, and the column that its files are sorted by.
LAYOUT = {
    "ohlcv_data": ("timestamp", "ticker"),
    "trade_log": ("timestamp", "user_id"),
    "sentiment_scores": ("timestamp", "ticker"),
    "alert_log": ("created_at", "user_id"),
    "signal_log": ("created_at", "user_id"),
    "alert_feedback": ("created_at", "alert_id"),
}


def create_tables(spark: SparkSession, root: str) -> None:
    """Empty tables under root; existing ones stay."""
    for name, schema in SCHEMAS.items():
        day = [T.StructField("day", T.DateType())] * (name in LAYOUT)
        spark.createDataFrame([], T.StructType([*schema.fields, *day])).write.mode("ignore").parquet(f"{root}/{name}")


def append(rows: DataFrame, root: str, name: str) -> None:
    """Rows added to a table, cast to its schema."""
    schema = SCHEMAS[name]
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    if name in LAYOUT:
        time, order = LAYOUT[name]
        rows = rows.withColumn("day", F.to_date(time)).repartition("day", order).sortWithinPartitions("day", order)
        rows.write.mode("append").partitionBy("day").parquet(f"{root}/{name}")
    else:
        rows.write.mode("append").parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    extra = [T.StructField("day", T.DateType())] * (name in LAYOUT)
    return spark.read.schema(T.StructType([*SCHEMAS[name].fields, *extra])).parquet(f"{root}/{name}").drop("day")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """token, valence of a sentiment lexicon in its usual form: lines of tab-separated token, mean valence and more."""
    part = F.split("value", "\t")
    return spark.read.text(path).select(part[0].alias("token"), part[1].try_cast("double").alias("valence")).where("token <> '' AND valence IS NOT NULL")
