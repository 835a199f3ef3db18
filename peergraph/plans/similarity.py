"""Similarity queries over the driver's ``embeddings`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peergraph.operators import evaluate as ev
from peergraph.operators import pairs as pr
from peergraph.operators import tiles
from peergraph.operators import vectors as vec
from peergraph.operators.ranking import counted_ranks
from peergraph.sources.scratch import table

COSINE = """
unit as (
  select vec_id as i, label, list_transform(embedding, lambda x: x::double) as v from embeddings
), scored as (
  select a.i, b.i as j, a.label as li, b.label as lj,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))
           / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))) as s
  from unit a join unit b on a.i <> b.i
)"""
CENTRED = COSINE.replace(
    "select vec_id as i, label, list_transform(embedding, lambda x: x::double) as v from embeddings",
    """select i, label, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) as v
  from (select vec_id as i, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
       (select list(m order by d) as m from (
          select d, avg(x) as m from (select unnest(embedding)::double as x, unnest(range(len(embedding))) as d from embeddings) group by d))""",
)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _named(top: DataFrame) -> DataFrame:
    return top.select(F.col("i").alias("vec_id"), "rank", F.col("j").alias("neighbor_id"), F.round("s", 6).alias("score"))


def cosine_topk(spark, sf_dir):
    return _named(pr.cosine_top_k(_vectors(spark, sf_dir), "vec_id", "embedding", 5, digits=6))


def cosine_centered_topk(spark, sf_dir):
    own = _vectors(spark, sf_dir).select("vec_id", vec.as_doubles(F.col("embedding")).alias("embedding"))
    return _named(pr.cosine_top_k(vec.centered(own, "vec_id", "embedding"), "vec_id", "embedding", 5, digits=6))


def topk_outside_label(spark, sf_dir):
    return _named(pr.cosine_top_k(_vectors(spark, sf_dir), "vec_id", "embedding", 5, digits=6, other_label="label"))


def _rounded_pairs(spark, sf_dir, centre=False):
    own = _vectors(spark, sf_dir).select("vec_id", vec.as_doubles(F.col("embedding")).alias("embedding"))
    if centre:
        own = vec.centered(own, "vec_id", "embedding")
    return pr.cosine_pairs(own, "vec_id", "embedding").withColumn("s", F.round("s", 6))


def pair_percentile_avg(spark, sf_dir):
    return tiles.pair_percentiles(tiles.blocks(_vectors(spark, sf_dir), "vec_id", ["embedding"])).select("i", "j", F.round("percentile", 4).alias("percentile"))


def pair_percentile_ordinal(spark, sf_dir):
    from peergraph.operators.ranking import positions

    ranked = positions(_rounded_pairs(spark, sf_dir), [F.col("s"), F.col("i"), F.col("j")])
    n = ranked.count()
    return ranked.select("i", "j", F.round(F.col("position") / F.lit(float(max(n - 1, 1))) * 100, 4).alias("percentile"))


def _percentiles(spark, sf_dir) -> DataFrame:
    """(s, ties, percentile) of every distinct rounded score of the pairs."""
    ranks = counted_ranks(tiles.score_counts(tiles.blocks(_vectors(spark, sf_dir), "vec_id", ["embedding"])).drop("column"), "s")
    n = ranks.agg(F.sum("ties")).first()[0] or 0
    share = (F.col("below") + (F.col("ties") + 1) / F.lit(2.0) - 1) / F.lit(float(max(n - 1, 1))) * 100
    return ranks.select("s", "ties", (share if n > 1 else F.lit(0.0)).alias("percentile"))


def similarity_bins(spark, sf_dir):
    binned = _percentiles(spark, sf_dir).withColumn("edge", pr.similarity_bin(F.col("percentile")))
    return binned.groupBy("edge").agg(F.sum("ties").alias("n_pairs"), F.round(F.sum(F.col("s") * F.col("ties")) / F.sum("ties"), 4).alias("mean_s"))


def _both(spark, sf_dir) -> DataFrame:
    """(vec_id, v, c): the vectors, plain and less their mean."""
    own = _vectors(spark, sf_dir).select("vec_id", vec.as_doubles(F.col("embedding")).alias("v"))
    return vec.centered(own.withColumn("c", F.col("v")), "vec_id", "c")


def ensemble_topk(spark, sf_dir):
    return _named(tiles.ensemble_top_k(tiles.blocks(_both(spark, sf_dir), "vec_id", ["v", "c"]), [3.0, 1.0], 5))


def neighbors_table(spark, sf_dir):
    """Neighbours with their percentiles and labels."""
    top = pr.cosine_top_k(_vectors(spark, sf_dir), "vec_id", "embedding", 3, digits=6).join(_percentiles(spark, sf_dir).drop("ties"), "s")
    names = _vectors(spark, sf_dir).select(F.col("vec_id").alias("j"), F.col("label").alias("neighbor_label"))
    return top.join(names, "j").select(
        F.col("i").alias("vec_id"), "rank", F.col("j").alias("neighbor_id"), "neighbor_label", F.round("s", 6).alias("score"), F.round("percentile", 4).alias("percentile")
    )


def pool_chunks(spark, sf_dir):
    chunks = _vectors(spark, sf_dir).select(
        (F.col("vec_id") % 50).alias("owner"), vec.as_doubles(F.col("embedding")).alias("v"), (1 + F.col("vec_id") % 5).cast("double").alias("n_tokens")
    )
    pooled = vec.pool_chunks(chunks, "owner", "v", "n_tokens")
    return pooled.select("owner", F.posexplode("v").alias("dim", "x")).select("owner", "dim", F.round("x", 6).alias("x"))


def precision_at_k(spark, sf_dir):
    own = _vectors(spark, sf_dir)
    labels = own.where(ev.valid_label(F.col("label")))
    top = pr.cosine_top_k(labels, "vec_id", "embedding", 5, digits=6)
    firms = ev.precision_per_firm(top, labels, "vec_id", "label")
    return firms.agg(F.round(F.avg("precision"), 6).alias("precision"), F.count(F.lit(1)).alias("n_firms")).join(
        F.broadcast(ev.random_precision(own, "label").select(F.round("random", 6).alias("random")))
    )


def precision_by_label(spark, sf_dir):
    own = _vectors(spark, sf_dir)
    top = pr.cosine_top_k(own, "vec_id", "embedding", 5, digits=6)
    firms = ev.precision_per_firm(top, own, "vec_id", "label")
    return firms.join(own.select(F.col("vec_id").alias("i"), "label"), "i").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("precision"), 6).alias("precision")
    )


def pair_auc(spark, sf_dir):
    counts = tiles.label_counts(tiles.blocks(_vectors(spark, sf_dir), "vec_id", ["embedding"], "label"))
    return ev.auc_of_counts(counts).select(F.round("auc", 6).alias("auc"))


def _tops(spark, sf_dir) -> list[DataFrame]:
    both = table(_both(spark, sf_dir), "both")
    return [pr.cosine_top_k(both, "vec_id", c, 5, digits=6) for c in ("v", "c")]


def method_agreement(spark, sf_dir):
    rho = tiles.rank_correlation(tiles.blocks(_both(spark, sf_dir), "vec_id", ["v", "c"]))
    return spark.createDataFrame([(rho,)], "spearman double").select(F.round("spearman", 5).alias("spearman")).join(
        F.broadcast(ev.jaccard_at_k(*_tops(spark, sf_dir)).select(F.round("jaccard", 6).alias("jaccard")))
    )


def neighbour_stability(spark, sf_dir):
    firms = pr.pair_overlap(*_tops(spark, sf_dir), 5)
    return firms.agg(
        F.round(F.percentile("overlap", F.lit(0.25)), 6).alias("q1"), F.round(F.percentile("overlap", F.lit(0.5)), 6).alias("median"),
        F.round(F.percentile("overlap", F.lit(0.75)), 6).alias("q3"), F.round(F.avg(F.col("same_first").cast("double")), 6).alias("top1"),
    )


def similarity_ranks(spark, sf_dir):
    """Every neighbour's rank, no limit."""
    order = Window.partitionBy("i").orderBy(F.desc("s"), "j")
    return pr.symmetrise(_rounded_pairs(spark, sf_dir)).select(F.col("i").alias("vec_id"), F.col("j").alias("neighbor_id"), F.row_number().over(order).alias("rank"))


def _tfidf(spark, sf_dir, max_df):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return vec.tfidf(docs, "doc_id", "text", 2, max_df)


def tfidf_weights(spark, sf_dir):
    return _tfidf(spark, sf_dir, 0.25).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_cosine_pairs(spark, sf_dir):
    pairs = pr.sparse_cosine_pairs(_tfidf(spark, sf_dir, 0.05), "doc_id", 0.25)
    return pairs.select("i", "j", F.round("s", 5).alias("s"))


def tfidf_cosine_all_pairs(spark, sf_dir):
    """The reference's vocabulary and no least score.  Copies do not expand: a pair stands for all members of two classes of equal texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    weights = _tfidf(spark, sf_dir, 0.25)
    keyed = docs.where("doc_id is not null").groupBy("doc_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.sha2(F.col("text").cast("binary"), 256)))), 256).alias("k"))
    first = keyed.groupBy("k").agg(F.min("doc_id").alias("i"))
    copies = keyed.join(first, "k").where("doc_id > i").select("i", F.col("doc_id").alias("j"))
    pairs = pr.sparse_cosine_pairs(weights.join(first.select(F.col("i").alias("doc_id")), "doc_id", "left_semi"), "doc_id")
    inside = copies.join(weights.select(F.col("doc_id").alias("i")).distinct(), "i", "left_semi").withColumn("s", F.lit(1.0))
    return pairs.select(F.lit("pair").alias("kind"), "i", "j", F.round("s", 5).alias("s")).unionByName(inside.select(F.lit("copy").alias("kind"), "i", "j", "s"))


def explain_pair(spark, sf_dir):
    """P10: twelve vectors to an owner; the chunks of owners (2m, 2m + 1) are matched one to one."""
    own = _vectors(spark, sf_dir).select(
        "vec_id", F.floor(F.col("vec_id") / 12).alias("owner"), vec.l2_normalize(vec.as_doubles(F.col("embedding"))).alias("v")
    )
    a = own.where("owner % 2 = 0").select(F.col("owner").alias("pair"), F.col("vec_id").alias("a"), F.col("v").alias("va"))
    b = own.where("owner % 2 = 1").select((F.col("owner") - 1).alias("pair"), F.col("vec_id").alias("b"), F.col("v").alias("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    chunks = a.join(b, "pair").select("pair", "a", "b", F.round(dot, 6).alias("s"))
    return pr.explain_pair(chunks, ["pair"], "a", "b", "s", 3)


def embed_cache(spark, sf_dir):
    """V3: half of the texts are cached; the model is a deterministic stand-in of two numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fake = lambda texts: [[float(len(t)), 1.0] for t in texts]
    cache = docs.where("doc_id % 2 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_key"), F.array(F.lit(0.0), F.lit(1.0)).alias("vector")).dropDuplicates(["text_key"])
    out, _ = vec.embed_with_cache(docs, "text", cache, fake)
    return out.select("doc_id", "text_key", F.round(F.element_at("vector", 1), 6).alias("x"))


QUERIES = {
    f.__name__: f
    for f in (
        cosine_topk, cosine_centered_topk, topk_outside_label, pair_percentile_avg, pair_percentile_ordinal, similarity_bins, ensemble_topk,
        neighbors_table, pool_chunks, precision_at_k, precision_by_label, pair_auc, method_agreement, neighbour_stability, similarity_ranks,
        tfidf_weights, tfidf_cosine_pairs, tfidf_cosine_all_pairs, explain_pair, embed_cache,
    )
}

_TOP = """
select i as vec_id, rank, j as neighbor_id, s as score from (
  select *, row_number() over (partition by i order by s desc, j)::int as rank from (select i, j, li, lj, round(s, 6) as s from scored) {where}
) where rank <= 5"""
_PERCENT = """, pairs as (
  select i, j, round(s, 6) as s from scored where i < j
), pct as (
  select i, j, s, (rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double - 1) / (count(*) over () - 1) * 100 as percentile from pairs
)"""
_BOTH = """
with a as (with {plain} select i, j, li, lj, round(s, 6) as s from scored),
b as (with {centred} select i, j, li, lj, round(s, 6) as s from scored)""".format(plain=COSINE, centred=CENTRED)
_PCT_OF = "(select i, j, s, (rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double - 1) / (count(*) over () - 1) * 100 as p from {} where i < j)"
_RANK_OF = "(select i, j, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as r from {} where i < j)"
_TOP_OF = "(select i, j, rank from (select i, j, row_number() over (partition by i order by s desc, j) as rank from {}) where rank <= 5)"
_EXPLAIN = """
with unit as (
  select vec_id, vec_id // 12 as owner, list_transform(embedding, lambda x: x::double) as w from embeddings
), scaled as (
  select vec_id, owner, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))) as v from unit
), c1 as (
  select a.owner as pair, a.vec_id as a, b.vec_id as b, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 6) as s
  from scaled a join scaled b on b.owner = a.owner + 1 and a.owner % 2 = 0
)""" + "".join(
    f""", m{n} as (select pair, a, b, s, {n} as rank from (select *, row_number() over (partition by pair order by s desc, a, b) as r from c{n}) where r = 1),
c{n + 1} as (select * from c{n} c where not exists (select 1 from m{n} m where m.pair = c.pair and (m.a = c.a or m.b = c.b)))"""
    for n in (1, 2, 3)
) + " select * from m1 union all select * from m2 union all select * from m3"
_TFIDF = """
with docs as (select doc_id, coalesce(text, '') as text from documents),
terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z][a-z-]{{2,}}')) as term from docs
), counts as (select doc_id, term, count(*) as tf from terms group by all),
df as (select term, count(*) as df from counts group by term having count(*) >= 2 and count(*) <= {max_df}::double * (select count(distinct doc_id) from docs)),
raw as (
  select doc_id, term, (1 + ln(tf)) * (ln((1 + (select count(distinct doc_id) from docs))::double / (1 + df)) + 1) as w from counts join df using (term)
), weights as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from raw)"""

ORACLES = {
    "cosine_topk": f"with {COSINE}" + _TOP.format(where=""),
    "cosine_centered_topk": f"with {CENTRED}" + _TOP.format(where=""),
    "topk_outside_label": f"with {COSINE}" + _TOP.format(where="where li <> lj"),
    "pair_percentile_avg": f"with {COSINE}{_PERCENT} select i, j, round(percentile, 4) as percentile from pct",
    "pair_percentile_ordinal": f"""with {COSINE}{_PERCENT}
select i, j, round((row_number() over (order by s, i, j) - 1)::double / (count(*) over () - 1) * 100, 4) as percentile from pairs""",
    "similarity_bins": f"""with {COSINE}{_PERCENT}
select case when percentile >= 99.5 then 99.5 when percentile >= 99 then 99 when percentile >= 98 then 98 when percentile >= 95 then 95
            when percentile >= 90 then 90 when percentile >= 75 then 75 when percentile >= 50 then 50 end::double as edge,
       count(*) as n_pairs, round(avg(s), 4) as mean_s from pct group by 1""",
    "ensemble_topk": f"""{_BOTH}, e as (
  select x.i, x.j, round(0.75::double * x.p + 0.25::double * y.p, 6) as s from {_PCT_OF.format('a')} x join {_PCT_OF.format('b')} y using (i, j)
), both_ways as (select i, j, s from e union all select j, i, s from e)
select i as vec_id, rank, j as neighbor_id, s as score from (
  select *, row_number() over (partition by i order by s desc, j)::int as rank from both_ways) where rank <= 5""",
    "neighbors_table": f"""with {COSINE}{_PERCENT}, both_ways as (
  select i, j, s, percentile from pct union all select j, i, s, percentile from pct
), ranked as (select *, row_number() over (partition by i order by s desc, j)::int as rank from both_ways)
select i as vec_id, rank, j as neighbor_id, label as neighbor_label, s as score, round(percentile, 4) as percentile
from ranked join embeddings on vec_id = j where rank <= 3""",
    "pool_chunks": """
with d as (
  select vec_id % 50 as owner, unnest(range(len(embedding)))::int as dim, unnest(embedding)::double * (1 + vec_id % 5) as x from embeddings
), s as (select owner, dim, sum(x) as x from d group by all)
select owner, dim, round(x / sqrt(sum(x * x) over (partition by owner)), 6) as x from s""",
    "precision_at_k": f"with {COSINE}, top as (select i, li, lj from (select *, row_number() over (partition by i order by round(s, 6) desc, j) as r from scored) where r <= 5),"
    " firms as (select i, avg((li = lj)::int::double) as p from top group by i), sizes as (select label, count(*) as c from embeddings group by label)"
    " select round(avg(p), 6) as precision, count(*) as n_firms, (select round(sum(c * (c - 1))::double / (sum(c)::double * (sum(c)::double - 1)), 6) from sizes) as random from firms",
    "precision_by_label": f"with {COSINE}, top as (select i, li, lj from (select *, row_number() over (partition by i order by round(s, 6) desc, j) as r from scored) where r <= 5),"
    " firms as (select i, li, avg((li = lj)::int::double) as p from top group by i, li) select li as label, count(*) as n, round(avg(p), 6) as precision from firms group by li",
    "pair_auc": f"""with {COSINE}, r as (
  select li = lj as pos, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as r from (select li, lj, round(s, 6) as s from scored where i < j))
select round((sum(case when pos then r end) - count_if(pos)::double * (count_if(pos) + 1) / 2) / (count_if(pos)::double * count_if(not pos)), 6) as auc from r""",
    "method_agreement": f"""{_BOTH}, sets as (
  select x.i, len(list_intersect(x.n, y.n))::double / len(list_distinct(list_concat(x.n, y.n))) as jac
  from (select i, list(j) as n from {_TOP_OF.format('a')} group by i) x join (select i, list(j) as n from {_TOP_OF.format('b')} group by i) y using (i))
select (select round(corr(x.r, y.r), 5) from {_RANK_OF.format('a')} x join {_RANK_OF.format('b')} y using (i, j)) as spearman, (select round(avg(jac), 6) from sets) as jaccard""",
    "neighbour_stability": f"""{_BOTH}, firms as (
  select x.i, count(y.j) / 5.0::double as overlap, bool_or(coalesce(x.rank = 1 and y.rank = 1, false)) as same_first
  from {_TOP_OF.format('a')} x left join {_TOP_OF.format('b')} y using (i, j) group by x.i)
select round(quantile_cont(overlap, 0.25), 6) as q1, round(quantile_cont(overlap, 0.5), 6) as median, round(quantile_cont(overlap, 0.75), 6) as q3,
       round(avg(same_first::int::double), 6) as top1 from firms""",
    "similarity_ranks": f"with {COSINE} select i as vec_id, j as neighbor_id, row_number() over (partition by i order by round(s, 6) desc, j)::int as rank from scored",
    "tfidf_weights": _TFIDF.format(max_df=0.25) + " select doc_id, term, round(weight, 6) as weight from weights",
    "tfidf_cosine_pairs": _TFIDF.format(max_df=0.05) + """ select a.doc_id as i, b.doc_id as j, round(sum(a.weight * b.weight), 5) as s
from weights a join weights b on a.term = b.term and a.doc_id < b.doc_id group by all having sum(a.weight * b.weight) >= 0.25""",
    "tfidf_cosine_all_pairs": _TFIDF.format(max_df=0.25) + """, bags as (
  select doc_id, list_sort(list(text)) as bag from docs where doc_id is not null group by doc_id
), classes as (select doc_id, min(doc_id) over (partition by bag) as i from bags), least as (select * from weights where doc_id in (select i from classes))
select 'pair' as kind, a.doc_id as i, b.doc_id as j, round(sum(a.weight * b.weight), 5) as s
from least a join least b on a.term = b.term and a.doc_id < b.doc_id group by all
union all select 'copy', i, doc_id, 1.0::double from classes where doc_id > i and i in (select doc_id from weights)""",
    "embed_cache": """
with cached as (select distinct sha256(text) as k from documents where doc_id % 2 = 0)
select doc_id, sha256(text) as text_key,
       case when sha256(text) in (select k from cached) then 0.0::double else round(length(text) / sqrt(length(text)::double * length(text) + 1), 6) end as x
from documents""",
    "explain_pair": _EXPLAIN,
}
