"""Company vectors: normalisation, chunk pooling, TF-IDF, and an embedding cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peergraph.sources.scratch import table

#: A term: a letter followed by two or more letters or hyphens.
TERM = r"[a-z][a-z-]{2,}"


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def centered(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``vectors`` less their mean vector, which has as many rows as there are dimensions."""
    dims = vectors.select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"))
    mean = dims.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))
    return vectors.join(F.broadcast(mean)).withColumn(vector, F.zip_with(vector, "mean", lambda x, m: x - m)).drop("mean")


def pool_chunks(chunks: DataFrame, owner: str, vector: str, weight: str) -> DataFrame:
    """(owner, vector): the weighted sum of each owner's chunk vectors, normalised.

    The sum runs by (owner, dimension), so a hot owner is summed map-side.
    """
    sums = chunks.select(owner, F.posexplode(F.transform(vector, lambda x: x * F.col(weight))).alias("d", "x")).groupBy(owner, "d").agg(F.sum("x").alias("x"))
    pooled = sums.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias(vector))
    return pooled.withColumn(vector, l2_normalize(F.col(vector)))


def tfidf(docs: DataFrame, key: str, text: str, min_df: int = 2, max_df: float = 0.25, stop_words: list[str] | None = None) -> DataFrame:
    """(key, term, weight): sublinear term frequency, smooth inverse document frequency, unit length.

    Terms count from ``min_df`` documents up to a share ``max_df`` of them.  Texts are sent to
    where their document is, once to count documents by term and once to weigh; terms are
    counted and made unit length there, so no row of a term is sent while the terms are few.
    The term table is joined by term; a term that survives ``max_df`` is no hot key beyond it.
    """
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    placed = docs.select(key, text).repartition(key)  # texts are shorter than their terms as rows
    terms = placed.select(key, F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    if stop_words:
        terms = terms.where(~F.col("term").isin(stop_words))
    counts = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.select(key).distinct().count()
    df = table(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n)), "df")
    raw = counts.where(F.col(key).isNotNull()).join(df, "term").select(
        key, "term", ((1 + F.log(F.col("tf").cast("double"))) * (F.log((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1)).alias("w")
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def require_terms(weights: DataFrame) -> DataFrame:
    """``weights``, or an error with a hint when the vocabulary is empty."""
    if weights.isEmpty():
        raise ValueError("no term is left: lower min_df or raise max_df")
    return weights


def embed_with_cache(texts: DataFrame, text: str, cache: DataFrame, model: Callable[[list[str]], list[list[float]]]) -> tuple[DataFrame, DataFrame]:
    """(``texts`` with ``text_key`` and ``vector``, the rows to add to the cache).

    Only distinct texts that the cache (text_key, vector) lacks reach the model, in Arrow batches;
    :class:`asking.TokenBatches` makes a service a model.
    """
    keyed = texts.withColumn("text_key", F.sha2(F.col(text).cast("binary"), 256))
    cache = cache.groupBy("text_key").agg(F.min("vector").alias("vector"))  # it is appended to: runs that met may have written a key twice
    todo = keyed.select("text_key", F.col(text).alias("t")).where("t is not null").dropDuplicates(["text_key"]).join(cache, "text_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = model(batch.column(1).to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["text_key", "vector"])

    new = todo.mapInArrow(run, "text_key string, vector array<double>")
    new = new.where("vector is not null").withColumn("vector", l2_normalize(F.col("vector")))  # a text that got no answer is asked again
    return keyed.join(cache.unionByName(new), "text_key", "left"), new
