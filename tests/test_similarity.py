import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peergraph.operators import evaluate as ev
from peergraph.operators import pairs as pr
from peergraph.operators import ranking, vectors


def test_pair_percentile_and_ties(spark):
    p = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.9), (1, 2, 0.5)], "i long, j long, s double")
    assert {(r.i, r.j): r.percentile for r in pr.pair_percentiles(p).collect()} == {(0, 1): 0.0, (0, 2): 100.0, (1, 2): 50.0}
    tied = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "s double")
    assert sorted(r.rank for r in ranking.average_ranks(tied, "s").collect()) == [1.5, 1.5, 3.0]


def test_positions_span_partitions(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.col("id") * 37, F.lit(1000)))
    got = ranking.positions(df, [F.col("v")]).collect()
    assert all(r.position == r.v for r in got)


def test_cosine_top_k_breaks_ties_by_id_and_blocks_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(60, [1.0, 0.0, 0.0, 0.0]), (61, [2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    a = sorted(map(tuple, pr.cosine_top_k(df, "k", "v", 3, digits=9).collect()))
    b = sorted(map(tuple, pr.cosine_top_k(df, "k", "v", 3, digits=9, block=7).collect()))
    assert a == b and len(a) == 62 * 3
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = np.round(m @ m.T, 9)
    np.fill_diagonal(s, -np.inf)
    assert [x[2] for x in a if x[0] == 5] == sorted(range(62), key=lambda j: (-s[5, j], j))[:3]


def test_pool_chunks(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 3.0), (0, [0.0, 1.0], 1.0), (1, [2.0, 0.0], 5.0)], "o int, v array<double>, w double")
    got = {r.o: r.v for r in vectors.pool_chunks(df, "o", "v", "w").collect()}
    assert got[0] == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and got[1] == pytest.approx([1.0, 0.0])


def test_ensemble_of_opposites_is_even(spark):
    a = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.5), (1, 2, 0.9)], "i long, j long, s double")
    b = a.withColumn("s", -F.col("s"))
    assert {r.s for r in pr.ensemble([(a, 1.0), (b, 1.0)]).collect()} == {50.0}


def test_explain_pair_uses_each_chunk_once(spark):
    rows = [(0, "a0", "b0", 0.9), (0, "a0", "b2", 0.8), (0, "a2", "b0", 0.7), (0, "a2", "b2", 0.6)]
    df = spark.createDataFrame(rows, "p int, a string, b string, s double")
    got = [(r.a, r.b) for r in pr.explain_pair(df, ["p"], "a", "b", "s", 2).orderBy("rank").collect()]
    assert got == [("a0", "b0"), ("a2", "b2")]


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.1, False), (0.5, False), (0.5, True), (0.9, True)], "s double, y boolean")
    assert ev.auc(df, "s", F.col("y")).first().auc == pytest.approx(0.875)


def test_bootstrap_matches_numpy(spark):
    values = [1.0, 2.0, None, 4.0, 8.0]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)], "method string, firm_idx int, value double")
    weights = ev.boot_weights(spark, 5, 200, 3)
    got = ev.bootstrap_mean(df, weights, ["method"]).first()
    picks = [[int(hashlib.md5(f"3:{b}:{s}".encode()).hexdigest()[:13], 16) % 5 for s in range(5)] for b in range(200)]
    assert sorted(map(tuple, weights.collect())) == sorted((b, f, p.count(f)) for b, p in enumerate(picks) for f in set(p))
    draws = [np.nanmean(np.array(values, float)[p]) if {values[i] for i in p} != {None} else np.nan for p in picks]
    lo, hi = np.nanpercentile(draws, [2.5, 97.5])
    assert (got["mean"], got.lo, got.hi) == pytest.approx((3.75, lo, hi))


def test_embed_cache_asks_only_for_new_texts(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, t string")
    cache = spark.createDataFrame([], "text_key string, vector array<double>")
    out, new = vectors.embed_with_cache(texts, "t", cache, lambda ts: [[3.0, 4.0] for _ in ts])
    assert new.count() == 2 and {tuple(r.vector) for r in out.where("t is not null").collect()} == {(0.6, 0.8)}
    _, again = vectors.embed_with_cache(texts, "t", new, lambda ts: [[0.0] for _ in ts])
    assert again.count() == 0


def test_all_tfidf_pairs_keep_common_terms_and_copies(spark, tmp_path):
    from peergraph.plans import similarity

    texts = ["alpha beta gamma"] * 3 + ["alpha delta"] + [f"filler{chr(97 + i)} word{chr(97 + i)}" for i in range(16)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.kind, r.i, r.j): r.s for r in similarity.QUERIES["tfidf_cosine_all_pairs"](spark, str(tmp_path)).collect()}
    assert {k for k in got if k[0] == "copy"} == {("copy", 0, 1), ("copy", 0, 2)}
    assert {k for k in got if k[0] == "pair"} == {("pair", 0, 3)} and 0 < got["pair", 0, 3] < 1


@pytest.mark.parametrize("top", [1, 3, None])
def test_matching_in_rounds_is_the_greedy_rule(spark, top):
    """Many company pairs at once, with ties, against the sequential rule."""
    import random

    rng = random.Random(top or 9)
    rows = [(p, a, b, rng.randrange(6) / 4) for p in range(25) for a in range(rng.randrange(1, 7)) for b in range(rng.randrange(0, 7))] + [(0, 99, 99, None)]
    want = []
    for p in range(25):
        used_a, used_b, rank = set(), set(), 0
        for _, a, b, s in sorted((r for r in rows if r[0] == p and r[3] is not None), key=lambda r: (-r[3], r[1], r[2])):
            if a not in used_a and b not in used_b and (top is None or rank < top):
                used_a.add(a)
                used_b.add(b)
                rank += 1
                want.append((p, a, b, s, rank))
    df = spark.createDataFrame(rows, "p int, a int, b int, s double")
    got = pr.explain_pair(df, ["p"], "a", "b", "s", top)
    assert got.columns == ["p", "a", "b", "s", "rank"] and sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert pr.explain_pair(df.limit(0), ["p"], "a", "b", "s", top).count() == 0
