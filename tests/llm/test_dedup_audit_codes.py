import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from peergraph.llm import divergence, quantization, registry, suffixes

# --- suffix-array dedup -------------------------------------------------------


def brute_runs(texts, length):
    """(bytes, removed, spans, digest of the rest) of every text, straight from the definition."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(t, gone) if not x)).hexdigest()))
    return out


@pytest.mark.parametrize("n, letters", [(1, 2), (50, 1), (300, 2), (3000, 3), (5000, 256)])
def test_suffix_array_and_common_prefixes(n, letters):
    rng = random.Random(n)
    data = np.array([rng.randrange(letters) for _ in range(n)], np.uint8)
    raw = data.tobytes()
    sa, rank = suffixes.suffix_array(data)
    want = sorted(range(n), key=lambda i: raw[i:])
    assert sa.tolist() == want and rank[sa].tolist() == list(range(n))

    def shared(a, b):
        k = 0
        while k < 20 and max(a, b) + k < n and raw[a + k] == raw[b + k]:
            k += 1
        return k

    assert suffixes.common_prefixes(data, sa, rank, 20).tolist() == [0] + [shared(a, b) for a, b in zip(want, want[1:])]


def test_equal_strings_have_equal_anchors_and_every_string_has_one(monkeypatch):
    rng = random.Random(3)
    shape = suffixes.Shape.of(24)
    passage = bytes(rng.randrange(97, 100) for _ in range(60))
    texts = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(90))) + passage + bytes(rng.randrange(97, 123) for _ in range(30)) for _ in range(6)]
    texts += [b"", b"z" * 23, b"z" * 400]
    for piece in (1 << 20, 50):
        monkeypatch.setattr(suffixes, "PIECE", piece)
        strings, keys = Counter(), {}
        for raw, ends, ids, base in suffixes.slices(texts, shape):
            found = suffixes.located(raw, ends, shape)
            begins = np.concatenate([[0], ends[:-1]])
            for o, k, off, a, b in zip(*(x.tolist() for x in (found.owner, found.key, found.off, found.first, found.last))):
                for p in range(a, b + 1):
                    strings[ids[o], base + p - int(begins[o])] += 1
                    # equal strings share a key, and stand at the same offset from the anchor
                    assert keys.setdefault(raw[p : p + 24], (k, off - (p - a))) == (k, off - (p - a))
        assert strings == Counter({(i, p): 1 for i, t in enumerate(texts) for p in range(len(t) - 23)})


@pytest.mark.parametrize("length, hot", [(8, 3), (20, 1), (24, 2000)])
def test_removed_runs_equal_the_definition(spark, length, hot):
    rng = random.Random(length)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    common, base = word("xyz", length + 6), [word("ab", rng.randrange(60)) for _ in range(25)]
    texts = base + ["a" * 100, "ab" * 40, "", None] + [word("pqrst", rng.randrange(50)) + common + word("pqrst", rng.randrange(50)) for _ in range(30)]
    texts += base[:3] * 3 + ["é" * rng.randrange(10) + common[:length] for _ in range(5)]
    rows = [(None if i == 7 else i // 2, t, "x", 1) for i, t in enumerate(texts)]  # repeated and null identifiers, clashing names
    docs = spark.createDataFrame(rows, "doc_id long, text string, t1 string, runs int").repartition(3)
    want = brute_runs([(t or "").encode() for t in texts], length)
    got = suffixes.repeated_runs(docs, length=length, hot=hot).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.runs), len(r.runs), r.kept_sha256) for r in got) == Counter((r[0], *w) for r, w in zip(rows, want))
    rest = suffixes.without_repeats(docs, length=length, hot=hot)
    assert rest.columns == docs.columns
    assert Counter((r.doc_id, hashlib.sha256(bytes(r.text)).hexdigest(), r.t1, r.runs) for r in rest.collect()) == Counter((r[0], w[3], "x", 1) for r, w in zip(rows, want))


def test_strings_of_200_bytes(spark):
    """The production length: a passage across documents, a long text over several pieces, copies, and an empty table."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage, long = prose(60), prose(250_000)
    assert len(long) > suffixes.PIECE
    texts = [long, prose(30) + passage + prose(40), prose(50) + passage, prose(80), "short", prose(100)] + [long[suffixes.PIECE - 400 : suffixes.PIECE + 300]] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.runs] for r in suffixes.repeated_runs(docs).collect()}
    at = [t.find(passage) for t in texts[:3]]
    assert got[0] == [(suffixes.PIECE - 400, suffixes.PIECE + 300)] and got[6] == got[7] == [(0, 700)]
    assert got[3] == got[4] == got[5] == []
    assert all(s <= at[i] and e >= at[i] + len(passage) for i in (1, 2) for s, e in got[i]) and len(got[1]) == len(got[2]) == 1
    assert suffixes.repeated_runs(docs.limit(0)).collect() == []


# --- source divergence --------------------------------------------------------


def brute_audit(rows, min_docs=10, top=10):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in held.items() if n >= min_docs]
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        whole = Counter(t for d in mine for t in d[2])
        price = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        prices, q = {s: price(c) for s, c in counts.items()}, price(whole)
        for s, p in prices.items():
            pairs = sorted(((-sum(f(p[t], o[t]) for t in kept), s2) for s2, o in prices.items() if s2 != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(p[t], q[t]), t) for t in kept if counts[s][t] and p[t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, "pair", i, -v, r + 1) for r, (v, i) in enumerate(pairs)] + [(lang, s, "term", i, -v, r + 1) for r, (v, i) in enumerate(terms)]
    return sorted(out)


def audit_rows(n=240):
    rng = random.Random(12)
    vocabulary = ["alpha", "Beta", "gamma-delta", "ÉTÉ", "naïve", "o'clock", "x1y", "日本語"] + [f"w{chr(97 + i)}" for i in range(20)]
    weights = [[rng.random() for _ in vocabulary] for _ in range(5)]
    rows = [(" ".join(rng.choices(vocabulary, weights[s], k=rng.randrange(12))), rng.choice(["en", "de", None]), [None, "a", "b", "É", "z"][s]) for s in rng.choices(range(5), [5, 3, 3, 1, 1], k=n)]
    return rows + [(None, "en", "a"), ("", "en", "silent"), ("only here", "xx", "a"), ("", "xx", "b"), ("alpha " * 3, None, None)] + [("alpha beta", "en", "a")] * 3


@pytest.mark.parametrize("tile", [256, 1])
def test_audit_equals_the_plain_sum(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "text string, lang string, source string, term string, n int")
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows)
    documents = pd.DataFrame(rows, columns=["text", "lang", "source"])  # noqa: F841
    sql = duckdb.sql(registry.ORACLES["op12_source_divergence"]).fetchall()
    assert sorted(sql) == brute_audit(rows)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_prices_are_exact_for_large_counts(spark):
    rows = [(c, w) for w in (3, 10**6 + 7, 2 * 10**14 + 1) for c in (0, 1, w // 3, w - 2)]
    got = spark.createDataFrame(rows, "c long, w long").select("c", "w", divergence.price(divergence.F.col("c"), divergence.F.col("w")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 2) // w for c, w in rows]


def test_words_of_a_long_text_come_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = ("Aé bC-d " * 50).encode()
    assert [w for piece in divergence.words(text) for w in piece] == re.findall(rb"[a-z\x80-\xff]+", text.lower())
    assert list(divergence.words(b"")) == []


# --- vector codes ---------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, tuple(math.floor(256 * x) for x in v), t) for i, v, t in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    d = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = sorted(((i, v + (0,) * (d * parts - len(v)), t) for i, v, t in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v, m: v[m * d : m * d + d]
    books = [[cut(v, m) for _, v, _ in kept[:entries]] for m in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, m: min((far(cut(v, m), e), k) for k, e in enumerate(books[m]))
    for _ in range(rounds):
        new = []
        for m in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(best(v, m)[1], []).append(cut(v, m))
            new.append([tuple(sum(x) // len(own[k]) for x in zip(*own[k])) if k in own else e for k, e in enumerate(books[m])])
        books = new
    coded = [(i, "".join(f"{best(v, m)[1]:02x}" for m in range(parts)), sum(best(v, m)[0] for m in range(parts)), t) for i, v, t in kept]
    whole = Counter()
    for _, _, e, t in coded:
        whole[t] += e
    return [(i, c, e, whole[t]) for i, c, e, t in coded], hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def codes(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    coded, books = quantization.compress(df, **options)
    out = quantization.with_label_error(coded).select("vec_id", "code", "error", "label_error").collect()
    return Counter(tuple(r) for r in out), quantization.books_sha256(books)


def test_codes_equal_the_definition(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist(), int(rng.integers(4)) if i % 5 else None) for i in range(150)]
    rows += rows[:20] + [(7, [0.25] * 32, 1), (None, [-1.5] * 32, None), (500, None, 1), (501, [None] + [1.0] * 31, 1), (502, [math.nan] + [1.0] * 31, 1), (503, [math.inf] * 32, 1)]
    for options in ({}, {"parts": 4, "entries": 5, "rounds": 3}):
        want, digest = brute_codes(rows, **options)
        assert codes(spark, rows, **options) == (Counter(want), digest)


def test_codes_of_odd_tables(spark):
    few = [(1, [0.5, -0.5, 2.0], 1), (2, [0.5], 1), (3, [], None), (3, [], None)]  # lengths that 16 does not divide, and shorter ones
    for rows in (few, [(1, [], 2)]):
        want, digest = brute_codes(rows)
        assert codes(spark, rows) == (Counter(want), digest)
    assert codes(spark, [(1, None, 1)])[0] == Counter()
    with pytest.raises(ValueError, match="limit"):
        codes(spark, [(1, [1e9] * 16, 1)])


def test_codes_equal_their_sql(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(size=16).astype(np.float32).tolist(), int(i) % 3 or None) for i in rng.permutation(120)]
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"label": "Int32"})  # noqa: F841
    sql = duckdb.sql(registry.ORACLES["op13_vector_codes"]).fetchall()
    got, digest = codes(spark, rows)
    assert got == Counter(r[:4] for r in sql) and {r[4] for r in sql} == {digest}
