"""Properties as a stream: each distinct one mapped once, results in two passes as they complete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from termweave.functions import similarity as sim


def distinct_stream(props: DataFrame, at: str, delay: str) -> DataFrame:
    """Drop a property that was seen within the watermark; state is kept only that long."""
    key = F.concat_ws("|||", F.when(F.col("property_type").isin("", "unspecified"), "").otherwise(F.coalesce("property_type", F.lit(""))), "text")
    return props.withColumn("prop_key", key).withWatermark(at, delay).dropDuplicatesWithinWatermark(["prop_key"])


def label_stream(props: DataFrame, terms: DataFrame) -> DataFrame:
    """A stream joined to the static vocabulary on its labels: stateless, one result per match."""
    labels = terms.filter("label is not null").select(F.lower("label").alias("low"), "iri", "label")
    return props.withColumn("low", F.lower("text")).join(labels, "low").withColumn("similarity", sim.blended(F.col("text"), F.col("label"))).drop("low")


def map_stream(props: DataFrame, shallow: Callable[[DataFrame], tuple[DataFrame, DataFrame]], deep: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, str], None], checkpoint: str) -> StreamingQuery:
    """Per micro-batch: ``shallow`` gives (results, properties left over), which are sunk first; then ``deep`` of the rest. ``sink`` takes rows and the pass."""

    def both(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        done, rest = shallow(batch)
        sink(done, "shallow")
        sink(deep(rest), "deep")

    return props.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).start()
