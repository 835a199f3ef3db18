import asyncio
import os
import time

import pytest

from peergraph.operators import asking, judge as jg, vectors as vec


class Service:
    """A slow service that counts what is under way."""

    def __init__(self, delay=0.02, bad=(), flaky=0):
        self.delay, self.bad, self.flaky, self.now, self.most, self.calls = delay, set(bad), flaky, 0, 0, []

    async def __call__(self, payload):
        self.calls.append(payload)
        self.now += 1
        self.most = max(self.most, self.now)
        try:
            await asyncio.sleep(self.delay)
        finally:
            self.now -= 1
        if payload in self.bad:
            raise asking.Permanent("no")
        if self.calls.count(payload) <= self.flaky:
            raise TimeoutError("later")
        return payload.upper()


def asker(service, **k):
    async def call(payload):
        return await service(payload)

    return asking.Asker(call, **{"pause": 0.001, **k})


def test_concurrency_is_bounded_and_used():
    service = Service(delay=0.05)
    began = time.time()
    assert asker(service, concurrency=8)([f"p{i}" for i in range(40)]) == [f"P{i}" for i in range(40)]
    assert service.most == 8 and 0.24 < time.time() - began < 1.0  # five rounds of eight
    # a plain function runs in threads, as many at once
    def plain(payload):
        time.sleep(0.05)
        return len(payload)

    began = time.time()
    assert asking.Asker(plain, concurrency=10)(["x"] * 20) == [1] * 20 and time.time() - began < 0.6
    assert asking.Asker(plain)([]) == []


def test_retries_then_answers_and_permanent_failures_are_not_repeated():
    service = Service(delay=0, flaky=2, bad=["b"])
    own = asker(service, attempts=3)
    assert own(["a", "b", "c"]) == ["A", None, "C"]
    assert service.calls.count("a") == 3 and service.calls.count("b") == 1 and own.failures == ["Permanent: no"]
    assert asker(Service(delay=0, flaky=3), attempts=3)(["a"]) == [None]
    slow = asker(Service(delay=5), attempts=2, timeout=0.02)
    began = time.time()
    assert slow(["a"]) == [None] and time.time() - began < 2

    class Busy(Exception):
        retry_after = 0.15

    seen = []

    async def busy(payload):
        seen.append(time.time())
        if len(seen) == 1:
            raise Busy()
        return 1

    assert asking.Asker(busy)(["a"]) == [1] and seen[1] - seen[0] >= 0.15


def test_the_breaker_stops_asking_and_keeps_what_was_answered():
    service = Service(delay=0.001, bad=[f"p{i}" for i in range(5, 40)])
    own = asker(service, concurrency=1, breaker=3)
    got = own([f"p{i}" for i in range(40)])
    assert got[:5] == [f"P{i}" for i in range(5)] and got[5:] == [None] * 35 and len(service.calls) == 8 and own.open
    assert own(["p0"]) == [None] and own.failures[-1] == "circuit open"  # for as long as the task lasts
    mended = asker(Service(delay=0, bad=["p1", "p3"]), concurrency=1, breaker=2)
    assert mended(["p1", "p2", "p3", "p4"]) == [None, "P2", None, "P4"] and not mended.open


def test_a_token_budget_spreads_requests():
    began = time.time()
    own = asker(Service(delay=0), tokens_per_minute=600, count=len, concurrency=4)
    assert own(["x" * 300, "y" * 300, "z" * 5, "w" * 5]) == ["X" * 300, "Y" * 300, "Z" * 5, "W" * 5]
    assert 0.8 < time.time() - began < 3  # 610 tokens, 10 in a second beyond the first 600


def test_batches_by_tokens():
    sizes = [3, 3, 3, 20, 1, 1, 1]
    assert asking.token_batches(["x" * n for n in sizes], 7, 2, len) == [[0, 1], [2], [3], [4, 5], [6]]
    assert asking.token_batches([], 7, 2) == []
    asked = []

    def model(texts):
        asked.append(texts)
        if "bad" in texts:
            raise RuntimeError("down")
        return [[float(len(t))] for t in texts]

    own = asking.TokenBatches(model, most_tokens=4, most_texts=2, count=len, attempts=2, pause=0.001)
    assert own(["ab", "cd", "bad", "e"]) == [[2.0], [2.0], None, None] and asked.count(["bad", "e"]) == 2
    assert asking.TokenBatches(lambda texts: [], attempts=1)(["a"]) == [None]


def make_call(folder, down):
    """Made inside a function, so that it travels to the workers whole; notes what it was asked."""
    async def call(payload):
        with open(f"{folder}/{payload}", "a") as f:
            f.write("x")
        if down and payload in ("p1", "p4"):
            raise RuntimeError("down")
        return {"competitor": 0.5}

    return call


def test_a_failed_run_keeps_its_answers_and_the_next_asks_the_rest(spark, tmp_path):
    asked = spark.createDataFrame([(f"h{i % 6}", f"p{i % 6}") for i in range(12)], "input_hash string, payload string").repartition(3)
    cache = spark.createDataFrame([("h0", {"competitor": 0.1}), ("h0", {"competitor": 0.1})], "input_hash string, scores map<string,double>")
    count = lambda: {f: os.path.getsize(tmp_path / f) for f in os.listdir(tmp_path)}
    judged, new = jg.judge_cached(asked, cache, asking.Asker(make_call(str(tmp_path), True), attempts=2, pause=0.001))
    kept = spark.createDataFrame(new.collect(), new.schema)
    assert sorted(r.input_hash for r in kept.collect()) == ["h2", "h3", "h5"] and count() == {"p1": 2, "p2": 1, "p3": 1, "p4": 2, "p5": 1}
    judged, new = jg.judge_cached(asked, cache.unionByName(kept), asking.Asker(make_call(str(tmp_path), False)))
    assert sorted(r.input_hash for r in spark.createDataFrame(new.collect(), new.schema).collect()) == ["h1", "h4"] and count() == {"p1": 3, "p2": 1, "p3": 1, "p4": 3, "p5": 1}
    assert judged.count() == 12  # a hash that is twice in the cache does not double its units


def test_embedding_through_token_batches(spark):
    texts = spark.createDataFrame([("aa",), ("bbb",), ("aa",), ("no",)], "t string")
    empty = spark.sql("select cast(null as string) as text_key, cast(null as array<double>) as vector where false")

    def model(batch):
        if "no" in batch:
            raise RuntimeError("down")
        return [[3.0, 4.0] for _ in batch]

    out, new = vec.embed_with_cache(texts, "t", empty, asking.TokenBatches(model, most_texts=1, attempts=1))
    assert new.count() == 2 and {r.t: r.vector for r in out.collect()} == {"aa": pytest.approx([0.6, 0.8]), "bbb": pytest.approx([0.6, 0.8]), "no": None}
