"""Queries that run as streams over the driver tables, to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergraph.sources.scratch import scratch_dir
from peergraph.streaming import overlay as ov


def _log(spark, sf_dir) -> DataFrame:
    """Users are edges; signups and purchases are versions of the graph, other events are reviews."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("edge_id"), "event_id", "event_type", "value")
    seen = F.concat(F.lit("h"), (F.floor("value") % 3).cast("string")).alias("evidence_hash")
    own = F.col("event_type").isin("signup", "purchase")
    versions = e.where(own).select("edge_id", F.col("event_id").alias("version"), F.when(F.col("value") > 20, "accepted").otherwise("uncertain").alias("decision"), seen)
    reviews = e.where(~own).select("edge_id", F.col("event_id").alias("review_id"), F.when(F.col("event_type") == "click", "accept").otherwise("reject").alias("verdict"), seen)
    return ov.events(reviews, versions)


def review_overlay_stream(spark, sf_dir):
    """The overlay as a stateful stream in several micro-batches, whose rows come in any order."""
    root = f"{scratch_dir(spark)}/overlay-{uuid.uuid4().hex[:12]}"
    _log(spark, sf_dir).repartition(6).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(ov.EVENT).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    key, provider = ov.STORE
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        sink = ov.overlay_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.parquet(f"{root}/out/batch={n}"))
        sink.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    shown = spark.read.schema(ov.SHOWN).option("basePath", f"{root}/out").parquet(f"{root}/out/*")
    return ov.newest(shown).select("edge_id", "version", "review_id", "review_state", "edge_state")


QUERIES = {f.__name__: f for f in (review_overlay_stream,)}

ORACLES = {
    "review_overlay_stream": """
with e as (
  select user_id::varchar as edge_id, event_id, event_type in ('signup', 'purchase') as own, event_type, value, 'h' || (floor(value)::bigint % 3) as seen from events
), v as (
  select edge_id, max(event_id) as version, max_by(case when value > 20 then 'accepted' else 'uncertain' end, event_id) as decision, max_by(seen, event_id) as now from e where own group by edge_id
), r as (
  select edge_id, max(event_id) as review_id, max_by(case when event_type = 'click' then 'accept' else 'reject' end, event_id) as verdict, max_by(seen, event_id) as seen from e where not own group by edge_id
), s as (
  select *, case when verdict is null then null when seen <> now then 'needs_recheck' when verdict = 'accept' then 'accepted' else 'rejected' end as review_state from v left join r using (edge_id)
)
select edge_id, version, review_id, review_state, case review_state when 'rejected' then 'rejected' when 'accepted' then 'confirmed' else decision end as edge_state from s""",
}
