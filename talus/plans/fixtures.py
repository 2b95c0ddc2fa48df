"""Frames derived from the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = """
  cast(floor(event_id/1000.0e0) as bigint) as scan_id, event_id as point_id,
  (((event_id*7919) % 2003) - 1001.5e0)/25.0e0 as x,
  (((event_id*104729) % 1999) - 999.5e0)/25.0e0 as y,
  -1.73e0 + 0.004e0*((((event_id*7919) % 2003) - 1001.5e0)/25.0e0)
    + case when event_type in ('click','view') then ((event_id*31) % 17)/200.0e0
           when event_type = 'purchase' then 0.3e0 + ((event_id*37) % 101)/100.0e0
           when event_type = 'signup' then 0.5e0 + ((event_id*41) % 307)/100.0e0
           else ((event_id*43) % 211)/50.0e0 end as z,
  cast({k} as double)/100.0e0 as i,
  case event_type when 'click' then 40 when 'view' then 72 when 'purchase' then 10 when 'signup' then 50 else 0 end as label
"""

#: Common table expression `points` for DuckDB; queries append to it.
POINTS = "points as (select" + _COLUMNS.format(k="json_extract(props, '$.k')") + "from events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "props")
    return spark.sql("select" + _COLUMNS.format(k="get_json_object(props, '$.k')") + "from {events}", events=events)


#: Disc points of the embeddings, 25 a tree: interior of the unit disc.
VECTORS = """
vec as (
  select vec_id // 25 as tree_id, vec_id as id, label as cls, embedding[1]::double as e0, embedding[2]::double as e1
  from embeddings
), disc as (
  select tree_id, id, cls, 0.9e0 * e0 / (1e0 + sqrt(e0*e0 + e1*e1)) as x, 0.9e0 * e1 / (1e0 + sqrt(e0*e0 + e1*e1)) as y from vec
)"""


def disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e0, e1 = (F.get("embedding", F.lit(k)).cast("double") for k in (0, 1))
    rows = rows.select(F.floor(F.col("vec_id") / 25).cast("long").alias("tree_id"), F.col("vec_id").alias("id"), F.col("label").alias("cls"), e0.alias("e0"), e1.alias("e1"))
    n = F.lit(1.0) + F.sqrt(F.col("e0") * F.col("e0") + F.col("e1") * F.col("e1"))
    return rows.select("tree_id", "id", "cls", (F.lit(0.9) * F.col("e0") / n).alias("x"), (F.lit(0.9) * F.col("e1") / n).alias("y"))


#: Weighted graph of parts and suppliers with integer weights.
SUPPLY = "supply as (select 0::bigint as scan_id, l_partkey as src, l_suppkey + 1000000 as dst, count(*)::double as w from lineitem group by all)"


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w")).select(
        F.lit(0).cast("long").alias("scan_id"), "src", "dst", "w"
    )


def r6(column) -> F.Column:
    """Rounded to six decimals, without a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6) + F.lit(0.0)
