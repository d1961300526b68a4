"""Row-wise operators on streaming tables.

Curation of single records keeps no state, so the batch expressions run unchanged on a
streaming source; grouping across records stays a batch job over the written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from compoundry.operators.curation import CurationConfig, annotate_activities


def read_activity_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path)


def write_annotated(stream: DataFrame, cfg: CurationConfig, path: str, checkpoint: str, fmt: str = "parquet"):
    """Append annotated records to a table folder; process what is there, then stop."""
    rows = annotate_activities(stream, cfg)
    return rows.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
