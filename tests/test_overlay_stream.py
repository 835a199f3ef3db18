import random

import pytest

from peergraph.streaming import overlay as ov


def random_log(n, seed):
    rng = random.Random(seed)
    reviews = [(f"e{rng.randrange(12)}", rng.randrange(30), rng.choice(["accept", "reject", None]), rng.choice("xyz")) for _ in range(n)]
    versions = [(f"e{rng.randrange(10)}", rng.randrange(20), rng.choice(["accepted", "uncertain", None]), rng.choice("xyz")) for _ in range(n)]
    reviews += rng.choices(reviews, k=n // 3) + [(None, 1, "accept", "x"), ("e1", None, "accept", "x")]  # repeated rows, and rows without an edge or number
    return reviews, versions + rng.choices(versions, k=n // 3)


def both(spark, reviews, versions):
    return ov.events(
        spark.createDataFrame(reviews, "edge_id string, review_id long, verdict string, evidence_hash string"),
        spark.createDataFrame(versions, "edge_id string, version long, decision string, evidence_hash string"),
    )


@pytest.mark.parametrize("splits", [1, 6])
def test_any_split_into_batches_gives_the_batch_overlay(spark, tmp_path, splits):
    key, provider = ov.STORE
    spark.conf.set(key, provider)
    log = both(spark, *random_log(60, splits))
    want = {tuple(r) for r in ov.overlay(log).collect()}
    assert want and {r[6] for r in want} >= {"needs_recheck", "rejected"}
    rows = [tuple(r) for r in log.collect()]
    random.Random(1).shuffle(rows)  # what comes late and what comes early is left to chance
    for part in range(splits):
        spark.createDataFrame(rows[part::splits], ov.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ov.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = str(tmp_path / "out")
    query = ov.overlay_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(sink)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    shown = spark.read.parquet(sink)
    assert {tuple(r) for r in ov.newest(shown).collect()} == want
    # rows that change nothing send nothing: at most one row for an edge and batch
    assert shown.count() <= splits * len(want)
    # a restart goes on from the state: an old review changes nothing, a version with other evidence asks for another look
    more = [("e1", "review", 0, "accept", None, "x"), ("e2", "version", 99, None, "accepted", "new")]
    spark.createDataFrame(more, ov.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = ov.overlay_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(sink)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    again.awaitTermination()
    after = {r.edge_id: r for r in ov.newest(spark.read.parquet(sink)).collect()}
    every = {r.edge_id: r for r in ov.overlay(log.unionByName(spark.createDataFrame(more, ov.EVENT))).collect()}
    assert {k: tuple(v) for k, v in after.items()} == {k: tuple(v) for k, v in every.items()}
    assert after["e2"].version == 99 and (after["e2"].review_id is None or after["e2"].verdict is None or after["e2"].review_state == "needs_recheck")


def test_states_by_hand(spark):
    log = both(
        spark,
        [("a", 1, "accept", "h1"), ("b", 1, "reject", "h1"), ("c", 1, "accept", "old"), ("lost", 1, "accept", "h"), ("d", 1, "accept", "h"), ("d", 2, "reject", "h")],
        [("a", 1, "uncertain", "h1"), ("b", 1, "accepted", "h1"), ("c", 1, "accepted", "old"), ("c", 2, "accepted", "h2"), ("d", 1, "accepted", "h"), ("g", 1, "accepted", "h"), ("g", 2, None, None)],
    )
    assert {r.edge_id: (r.review_state, r.edge_state) for r in ov.overlay(log).collect()} == {
        "a": ("accepted", "confirmed"), "b": ("rejected", "rejected"), "c": ("needs_recheck", "accepted"), "d": ("rejected", "rejected"), "g": (None, None),
    }
