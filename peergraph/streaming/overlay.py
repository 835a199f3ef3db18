"""Reviews over a changing graph as a stream: the state of every edge, kept as reviews and new versions arrive.

Two logs meet by edge: reviews (a verdict on the evidence that was seen) and versions of the
graph (the model's decision and the hash of the evidence behind it).  For each edge the state
store keeps the newest of both; when either changes what the edge shows, a row goes out.  A
version with other evidence turns a standing review into ``needs_recheck`` at once, and back
when the evidence it was made for returns.  The batch form is :func:`overlay`.

Edge cases: rows may come late, twice and in any order, since the newest is the one of the
greatest number, whatever came last, and of rows of one number the greatest by content; a
review of an edge that no version holds waits for it; a version row without a decision says
that the edge is gone, and its state is then null; rows without an edge or a number are
passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from peergraph.operators import graph as gr

EVENT = "edge_id string, kind string, number long, verdict string, decision string, evidence_hash string"
SHOWN = "edge_id string, version long, decision string, evidence_hash string, review_id long, verdict string, review_state string, edge_state string"
STATE = "version long, decision string, evidence_hash string, review_id long, verdict string, seen_hash string"
#: The state store that keeps many keys off the heap, named as Spark's setting does.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def events(reviews: DataFrame, versions: DataFrame) -> DataFrame:
    """One stream or table of both logs: reviews (edge_id, review_id, verdict, evidence_hash), versions (edge_id, version, decision, evidence_hash)."""
    none = F.lit(None).cast("string")
    a = reviews.select("edge_id", F.lit("review").alias("kind"), F.col("review_id").cast("long").alias("number"), "verdict", none.alias("decision"), "evidence_hash")
    b = versions.select("edge_id", F.lit("version").alias("kind"), F.col("version").cast("long").alias("number"), none.alias("verdict"), "decision", "evidence_hash")
    return a.unionByName(b).where("edge_id is not null and number is not null")


def _later(new: tuple, old: tuple) -> bool:
    """Whether ``new`` (number, texts) stands above ``old``: by number, then by content, null lowest."""
    order = lambda t: tuple((x is not None, x or "") for x in t[1:])
    return old[0] is None or new[0] > old[0] or (new[0] == old[0] and order(new) > order(old))


def shown_state(version: tuple, review: tuple) -> tuple[str | None, str | None]:
    """(review_state, edge_state) of the newest version (number, decision, hash) and review (number, verdict, hash)."""
    _, decision, now = version
    number, verdict, seen = review
    if number is None or verdict is None:
        standing = None
    elif seen != now:
        standing = "needs_recheck"
    else:
        standing = "accepted" if verdict == "accept" else "rejected"
    if decision is None:
        return standing, None
    return standing, {"rejected": "rejected", "accepted": "confirmed"}.get(standing, decision)


class Overlay(StatefulProcessor):
    """State of one edge: its newest version and review."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("edge", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = tuple(self.state.get()) if self.state.exists() else (None,) * 6
        version, review = held[:3], held[3:]
        for r in rows:
            if r["kind"] == "version" and _later(new := (r["number"], r["decision"], r["evidence_hash"]), version):
                version = new
            elif r["kind"] == "review" and _later(new := (r["number"], r["verdict"], r["evidence_hash"]), review):
                review = new
        if version + review == held:
            return
        self.state.update(version + review)
        if version[0] is not None:
            standing, state = shown_state(version, review)
            yield Row(
                edge_id=key[0], version=version[0], decision=version[1], evidence_hash=version[2], review_id=review[0], verdict=review[1], review_state=standing, edge_state=state,
            )

    def close(self) -> None:
        pass


def overlay_stream(log: DataFrame) -> DataFrame:
    """SHOWN rows of a stream of EVENT rows, in update mode: a row for each edge whose newest version or review changed.

    The session needs the setting ``STORE``.
    """
    return log.groupBy("edge_id").transformWithState(statefulProcessor=Overlay(), outputStructType=SHOWN, outputMode="Update", timeMode="None")


def newest(shown: DataFrame) -> DataFrame:
    """The last row of each edge of what the stream sent: both numbers only grow."""
    rest = [c for c in shown.columns if c != "edge_id"]
    order = F.struct("version", F.coalesce("review_id", F.lit(-(2**63))).alias("_n"), "decision", "evidence_hash", "verdict", *[c for c in rest if c not in ("version", "decision", "evidence_hash", "verdict")])
    return shown.groupBy("edge_id").agg(F.max(order).alias("r")).select("edge_id", *[f"r.{c}" for c in rest])


def overlay(log: DataFrame) -> DataFrame:
    """The same of a whole table of EVENT rows."""
    top = lambda kind, *cols: F.max(F.when(F.col("kind") == kind, F.struct("number", *cols)))
    both = log.groupBy("edge_id").agg(top("version", "decision", "evidence_hash").alias("v"), top("review", "verdict", "evidence_hash").alias("r")).where("v is not null")
    standing = gr.review_state(F.col("r.verdict"), F.coalesce("r.evidence_hash", F.lit("")), F.coalesce("v.evidence_hash", F.lit("")))
    return both.select(
        "edge_id", F.col("v.number").alias("version"), "v.decision", "v.evidence_hash", F.col("r.number").alias("review_id"), "r.verdict", standing.alias("review_state"),
        F.when(F.col("v.decision").isNotNull(), gr.edge_state(F.col("v.decision"), standing)).alias("edge_state"),
    )
