import math

from peergraph.operators import vectors


def test_rows_of_terms_stay_with_their_document(spark):
    """Neither counts nor norms send a row of a term: only the texts are dealt."""
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (2, "gamma beta"), (3, "delta"), (None, "alpha")], "doc_id long, text string")
    made = vectors.tfidf(docs, "doc_id", "text", 2, 1.0)
    text = made._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Join") == 1
    idf = {"alpha": math.log(5 / 4) + 1, "beta": math.log(5 / 3) + 1}  # four documents, one without a name; gamma and delta are in one
    one = {"alpha": idf["alpha"], "beta": (1 + math.log(2)) * idf["beta"]}
    want = {(1, t): w / math.hypot(*one.values()) for t, w in one.items()} | {(2, t): w / math.hypot(*idf.values()) for t, w in idf.items()}
    got = {(r["doc_id"], r["term"]): r["weight"] for r in made.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
