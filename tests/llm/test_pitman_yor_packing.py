"""op6_pitman_yor: what a chunk costs and what it sends, and that words, tables and packed numbers stay what they are."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from peergraph.llm import pitman_yor


@pytest.fixture
def packed(monkeypatch):
    """Rows of chunks made from batches of texts, outside Spark."""
    import pyspark

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(pyspark, "TaskContext", Task)

    def run(rows, batch=7):
        columns = lambda part: [pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())]
        parts = [rows[k : k + batch] for k in range(0, len(rows), batch)]
        return list(pitman_yor._chunks(pa.RecordBatch.from_arrays(columns(p), names=["doc_id", "text"]) for p in parts))

    return run


def test_no_python_function_runs_word_by_word(packed):
    words = [f"word{k}" for k in range(5_000)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    packed([(1, "warm up")])
    sys.setprofile(count)
    try:
        packed([(i, " ".join(words)) for i in range(3)])
    finally:
        sys.setprofile(None)
    assert calls < 1_000


def test_counts_and_sums_are_sent_as_bytes(packed):
    rng = random.Random(2)
    batches = packed([(i, " ".join(f"w{rng.randrange(300)}" for _ in range(200))) for i in range(60)])
    chunk = pitman_yor.Chunk(batches[0].to_pylist()[0])
    asked = pa.Table.from_batches(pitman_yor._ask_pairs(1)(iter(batches)))
    answers = pitman_yor._count_pairs(asked)
    got = [r for r in answers.to_pylist() if r["kind"] == pitman_yor.PAIRS]
    assert len(got) == 1 and len(got[0]["a"]) < 1.5 * len(chunk.word)
    # the counts are those of the training texts
    _, order = chunk.coded()
    assert pitman_yor._joined(got, "a").tolist() == chunk.train[order].tolist() and chunk.train.max() > 1


def test_packed_words_are_the_tokens_of_each_text(packed, monkeypatch):
    rng = random.Random(1)
    letters = [*" \t\n\x0b\x0c\rabAB\x00\x1c\x1f\x85 é漢😀", " "]
    texts = lambda: rng.choice([None, "", "".join(rng.choice(letters) for _ in range(rng.randrange(30)))])
    for rows in [[(1, ""), (2, None)], [(1, " ")], *([(rng.choice([None, 7]), texts()) for _ in range(rng.randrange(1, 30))] for _ in range(60))]:
        monkeypatch.setattr(pitman_yor, "CHUNK_BYTES", rng.choice([1, 10, 50, 1_000_000]))
        got = []
        for row in (b.to_pylist()[0] for b in packed(rows)):
            special = {pitman_yor._word_hash(w): w for w in (pitman_yor.START, pitman_yor.END)}
            names = [special.get(h, w) for h, w in zip(pitman_yor._from_ascending(row["hashes"]).tolist(), row["spelled"].split(b"\n"))]
            flat, at = pitman_yor._from_planes(row["tokens"]), 0
            for doc, null, n in zip(row["doc_ids"], row["null_id"], pitman_yor._from_planes(row["lengths"])):
                got.append((None if null else doc, [names[k] for k in flat[at : at + n]]))
                at += n
            assert at == row["n_tokens"] and row["n_words"] == len(names)
        assert got == [(i, pitman_yor.tokens_of(t)) for i, t in rows]


def test_numbers_come_back_from_their_packing():
    rng = np.random.default_rng(4)
    for values in ([], [0], [0, 0], [254, 255, 256], [2**32 - 1, 0, 255], rng.integers(0, 300, 1_000), rng.integers(0, 2**32, 50)):
        values = np.array(values, np.int64)
        for pack, unpack in ((pitman_yor._bytes, pitman_yor._from_bytes), (pitman_yor._planes, pitman_yor._from_planes)):
            assert unpack(pack(values)).tolist() == values.tolist() and pitman_yor._length(pack(values)) == len(values)
    codes = np.sort(rng.integers(0, 2**64, 500, np.uint64))
    assert (pitman_yor._from_ascending(pitman_yor._ascending(codes)) == codes).all()


def test_order_of_hashes_that_differ_in_low_bits_only():
    rng = np.random.default_rng(5)
    values = rng.permutation(np.concatenate([np.arange(1_000, dtype=np.uint64) + np.uint64(1 << 60), rng.integers(0, 2**64, 1_000, np.uint64)]))
    for part in (values, values[:1], values[:0], rng.integers(0, 2**64, 5_000, np.uint64)):
        assert (pitman_yor._sorted(part) == np.argsort(part)).all()


def test_tables_do_not_depend_on_the_order_of_dishes():
    rng = np.random.default_rng(6)
    count, weight = rng.integers(0, 90, 30_000), 10.0 ** rng.uniform(-4, 6, 30_000)
    seed, order = np.arange(30_000, dtype=np.uint64), np.argsort(count, kind="stable")
    assert (pitman_yor.seated(count, weight, 0.6, seed, 1)[order] == pitman_yor.seated(count[order], weight[order], 0.6, seed[order], 1)).all()
    # and are the inversion of their distribution, dish by dish
    got = pitman_yor.seated(count, weight, 0.6, seed, 1)
    chance, logs = pitman_yor.uniform(seed, 1, 0), pitman_yor.log_stirling(0.6)
    for k in np.flatnonzero((count > 1) & (count <= pitman_yor.EXACT))[:3_000]:
        c = count[k]
        log_p = logs[c, 1 : c + 1] + np.arange(1, c + 1) * np.log(weight[k])
        p = np.cumsum(np.exp(log_p - log_p.max()))
        assert got[k] == 1 + (p < chance[k] * p[-1]).sum()
