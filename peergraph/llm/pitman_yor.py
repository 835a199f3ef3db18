"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: one per previous word (and one for the start of a text); all share the
unigram restaurant as their parent, whose base measure is a model of spellings, so an
unknown word has the small chance of its letters and all words together have chance one.

The tables of a dish (a word) in a restaurant are drawn by Gibbs, given all other dishes:
the chance of t tables goes with weight**t and a generalised Stirling number, in which the
sizes of the tables are summed out (exact to 64 customers, moments of a saddle point
beyond).  The totals of the other dishes are those of the sweep before, so all dishes are
seated at once.  Concentrations are sampled each sweep from their auxiliary variables;
discounts are estimated from the counts of ones and twos.  The predictive probabilities are
averaged over the sweeps after the burn-in.  Random numbers are hashes of word or pair,
sweep and step, so a score does not depend on how the rows are dealt.

Flow; tables in the shared folder, arrays packed:

1. *Chunks.*  Each task packs its documents into chunks of about 8 MB of text: distinct
   words, and the texts as numbers of words.  The table is bucketed by chunk, so what
   comes back to a chunk is all that is ever shuffled.
2. *Pairs.*  The hashes of a chunk's distinct pairs (previous word, word) go to ranges of
   the hash, which answer with the customers in the corpus.  Each chunk sends a pair
   once, so a common pair costs one entry per chunk.
3. *Words.*  The same for words, whose owners keep the unigram restaurant.
4. *Sweeps.*  Chunks seat the pairs that have two customers or more and send the tables by
   word and by previous word to the owners of the words; the owners seat the unigram
   restaurant and answer.  Chunks that share a pair draw the same random numbers for it,
   a hash of pair, sweep and step, and so agree; the first of them counts it.
5. *Scores.*  Each chunk scores its documents from the answers.

No table of words, pairs or contexts comes to the driver or to every task; what does is
a handful of sums, and the counts of pairs of bytes for the model of spellings.  Words
and pairs are told apart by 64-bit hashes.

Edge cases: null text is the empty text, one end token; a null identifier is the
empty string for the hold-out rule; identifiers are integers, another type is refused
before anything runs; repeated rows are repeated customers; texts and words of any
length are read whole; an empty table gives an empty result; without training text a
word has the chance of its spelling under a uniform model; extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergraph.llm.common import Scratch, release_shuffles

CHUNK_BYTES = 8 << 20
#: Entries to a range of hashes, about.
RANGE = 400_000
SWEEPS, BURN_IN = 4, 1
END, START = b"\n", b""  # never words
#: The tables of up to so many customers are drawn exactly.
EXACT = 64
#: Dishes of one size that are drawn at a time: what is in use stays near the processor.
BLOCK = 1 << 13
#: Means up to this are drawn from a binomial distribution, others from a normal one.
SMALL = 12
#: What the frequency of a byte alone counts for beside that of a pair of bytes.
SMOOTH = 20.0
#: The log of the base measure is kept to this part of a nat.
COST = 100.0

ENTRY, PAIRS, KNOWN, ASKED, OWNER, SENT, TABLES, ANSWER, SUMS = range(9)
MAIL = "chunk long, bucket int, kind int, a binary, b binary, c binary, d binary, e binary, f binary, s array<double>"
CHUNK = (
    "chunk long, doc_ids array<long>, null_id binary, held binary, lengths binary, hashes binary, spelled binary, tokens binary, n_words long, n_tokens long"
)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# --- packing ------------------------------------------------------------------

def _planes(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers byte plane by byte plane, without high planes of nothing but zeros: how many numbers, how many planes, the planes."""
    values = values.astype(kind)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = [(values >> np.array(8 * k, kind)).astype(np.uint8).tobytes() for k in range(width)]
    return b"".join([len(values).to_bytes(8, "little"), bytes([width]), *planes])


def _length(value: bytes) -> int:
    """How many numbers were packed."""
    return int.from_bytes(value[:8], "little")


def _from_planes(value: bytes, kind: str = "<u4") -> np.ndarray:
    n = _length(value)
    out = np.zeros(n, kind)
    for k in range(value[8]):
        out |= np.frombuffer(value, np.uint8, n, 9 + k * n).astype(kind) << np.array(8 * k, kind)
    return out


def _bytes(values: np.ndarray) -> bytes:
    """Numbers most of which are below 255: a byte each, and those from 255 on in full behind."""
    values = values.astype("<u4")
    low = np.minimum(values, 255).astype(np.uint8)
    return b"".join([len(values).to_bytes(8, "little"), low.tobytes(), _planes(values[low == 255])])


def _from_bytes(value: bytes) -> np.ndarray:
    n = _length(value)
    low = np.frombuffer(value, np.uint8, n, 8)
    out = low.astype("<u4")
    out[low == 255] = _from_planes(value[8 + n :])
    return out


def _ascending(values: np.ndarray, kind: str = "<u8") -> bytes:
    """Ascending numbers as differences."""
    return _planes(np.diff(values.astype(kind), prepend=np.zeros(1, kind)), kind)


def _from_ascending(value: bytes, kind: str = "<u8") -> np.ndarray:
    return np.cumsum(_from_planes(value, kind), dtype=kind)


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def _cuts(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where the ranges begin in ascending hashes, and the end."""
    return np.searchsorted(_range_of(hashes, ranges), np.arange(ranges + 1))


def _mail(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _arrow_schema(MAIL))


#: Arrow types by their names in the schemas above, which workers must read without a session.
TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
TYPES |= {f"array<{k}>": pa.list_(v) for k, v in list(TYPES.items())}


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, TYPES[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time: a row is megabytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _by(rows: list[dict], kind: int, order: str) -> list[dict]:
    return sorted((r for r in rows if r["kind"] == kind), key=lambda r: r[order])


def _joined(rows: list[dict], column: str, unpack: Callable[[bytes], np.ndarray] = _from_bytes) -> np.ndarray:
    return np.concatenate([unpack(r[column]) for r in rows]) if rows else np.zeros(0, "<u4")


def _sorted(values: np.ndarray) -> np.ndarray:
    """The order in which different 64-bit numbers ascend.

    Their high bits and their places are sorted as one number each, which takes a fraction of
    the time of sorting places; where that does not tell two of them apart, the places are.
    """
    bits = max(len(values) - 1, 1).bit_length()
    low = np.uint64((1 << bits) - 1)
    order = (np.sort(values & ~low | np.arange(len(values), dtype=np.uint64)) & low).astype(np.int64)
    ascending = values[order]
    return order if (ascending[1:] > ascending[:-1]).all() else np.argsort(values, kind="stable")


# --- hashes and random numbers --------------------------------------------------

def _word_hash(word: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(word)


def scatter(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return scatter(word + scatter(before ^ np.uint64(0x9E3779B97F4A7C15)))


def uniform(seed: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """Numbers in [0, 1) fixed by the seeds, the sweep and the step."""
    mark = np.uint64(((sweep << 20 | step) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    return (scatter(seed.astype(np.uint64) ^ mark) >> np.uint64(11)) * 2.0**-53


# --- seating --------------------------------------------------------------------

@lru_cache(maxsize=8)
def log_stirling(discount: float) -> np.ndarray:
    """[c, t]: the log of the generalised Stirling number S(c, t), c up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[0, 0] = 0.0
    for c in range(1, EXACT + 1):
        t = np.arange(1, c + 1)
        factor = c - 1 - discount * t
        more = np.where(factor > 0, out[c - 1, t] + np.log(np.maximum(factor, 1e-300)), -np.inf)
        out[c, t] = np.logaddexp(out[c - 1, t - 1], more)
    return out


@lru_cache(maxsize=8)
def stirling_ratios(discount: float) -> np.ndarray:
    """[c, t]: S(c, t + 1) / S(c, t) for t from 1 below c, c up to EXACT."""
    logs = log_stirling(discount)
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(np.exp(logs[:, 1:] - logs[:, :-1]), nan=0.0, posinf=0.0)


def normal(seed: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """Normal numbers from two uniform ones."""
    radius = np.sqrt(-2 * np.log(np.maximum(uniform(seed, sweep, step), 1e-16)))
    return radius * np.cos(2 * np.pi * uniform(seed, sweep, step + 1))


def _many_moments(count: np.ndarray, weight: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables of many customers.

    The number of tables is that of a compound Poisson process given its sum: with
    phi(z) = (1 - (1 - z)**d) / d the tilt z solves weight z phi'(z) = count, and the mean is
    weight phi(z) with a correction of the second order.  Where one table is so large that it
    makes the sum by itself, that correction is one table.
    """
    low, high = np.full(len(count), -700.0), np.zeros(len(count))
    for _ in range(42):
        middle = (low + high) / 2
        over = weight * -np.expm1(middle) * np.exp(middle * (discount - 1)) > count
        low, high = np.where(over, middle, low), np.where(over, high, middle)
    u = np.exp((low + high) / 2)
    z, phi = 1 - u, (1 - u**discount) / discount
    s1 = z * u ** (discount - 1)  # phi times the mean size of a table, of its square and cube
    f2, f3 = (1 - discount) * z**2 * u ** (discount - 2), (1 - discount) * (2 - discount) * z**3 * u ** (discount - 3)
    s2, s3 = s1 + f2, s1 + 3 * f2 + f3
    mean = weight * phi
    second = (s1 * s3 / s2**2 - 1) / 2
    many = -np.expm1(-1.2 * np.sqrt(mean * u**discount))
    return mean + 1 + many * (second - 1), mean * np.maximum(1 - s1**2 / (phi * s2), 0)


def _drawn(c: int, weight: np.ndarray, chance: np.ndarray, discount: float) -> np.ndarray:
    """Tables of dishes of ``c`` customers each, by inversion of weight**t S(c, t)."""
    out = np.ones(len(weight))
    large = weight > 1e3  # a product of so many weights could leave the range of numbers
    if large.any():
        log_p = np.log(weight[large])[:, None] * np.arange(1, c + 1) + log_stirling(discount)[c, 1 : c + 1]
        p = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
        out[large] = 1.0 + (p < (chance[large] * p[:, -1])[:, None]).sum(axis=1)
        small = ~large
        out[small] = _drawn(c, weight[small], chance[small], discount)
        return out
    ratios = stirling_ratios(discount)[c, 1:c].tolist()
    total = np.ones(len(weight))
    step = np.empty(len(weight))
    for r in reversed(ratios):  # the sum of all chances, from the last on
        np.multiply(weight, r, out=step)
        np.multiply(total, step, out=total)
        np.add(total, 1.0, out=total)
    goal, live = chance * total, np.arange(len(weight))
    p, below = np.ones(len(weight)), np.ones(len(weight))
    for r in ratios:
        more = np.flatnonzero(below < goal)
        if not len(more):
            break
        live, weight, goal, p, below = live[more], weight[more], goal[more], p[more], below[more]
        out[live] += 1
        p *= weight * r
        below += p
    return out


def seated(count: np.ndarray, weight: np.ndarray, discount: float, seed: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish, drawn given all other dishes: the chance of t tables goes with weight**t S(count, t).

    This is where a Gibbs sampler that reseats one customer after the other, as long as it
    takes, ends up; the sizes of the tables are summed out.  ``weight`` is (concentration +
    discount * tables of the restaurant) * parent probability.  Exact to EXACT customers;
    beyond, a binomial or normal number of the right mean and variance.
    """
    tables = np.minimum(count, 1).astype(np.float64)
    weight = np.maximum(weight, 1e-300)
    chance = uniform(seed, sweep, 0)
    sizes = np.minimum(count, EXACT + 1).astype(np.uint8)
    order = None if (sizes[1:] >= sizes[:-1]).all() else np.argsort(sizes, kind="stable")  # small integers: counted, not compared
    edges = np.searchsorted(sizes if order is None else sizes[order], np.arange(EXACT + 2, dtype=np.uint8))
    for c in range(2, EXACT + 1):
        for at in range(edges[c], edges[c + 1], BLOCK):
            own = slice(at, min(at + BLOCK, edges[c + 1]))
            own = own if order is None else order[own]
            tables[own] = _drawn(c, weight[own], chance[own], discount)
    many = np.flatnonzero(count > EXACT)
    if len(many):
        c = count[many].astype(np.float64)
        mean, variance = _many_moments(c, weight[many], discount)
        rest = np.maximum(mean - 1, 0)
        drawn = np.floor(mean + np.sqrt(variance) * normal(seed[many], sweep, 1) + 0.5)
        small = np.flatnonzero(rest <= SMALL)
        drawn[small] = 1 + binomial(rest[small], variance[small], chance[many[small]])
        tables[many] = np.clip(drawn, 1, c)
    return tables


def binomial(mean: np.ndarray, variance: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Binomial numbers of the given means, up to SMALL, and variances below them, by inversion."""
    share = np.clip(1 - variance / np.maximum(mean, 1e-300), 1e-6, 0.999)
    trials = np.maximum(np.ceil(mean / share), 1)
    share = np.minimum(mean / trials, 1 - 1e-12)
    out, p = np.zeros(len(mean)), np.exp(trials * np.log1p(-share))
    below = p.copy()
    for k in range(8 * SMALL):
        over = chance >= below
        if not over.any():
            break
        out += over
        p = p * np.maximum(trials - k, 0) / (k + 1) * share / (1 - share)
        below = below + p
    return out


def gammas(shape: np.ndarray, seed: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """Gamma numbers of shapes of 1 or more, fixed by the seeds: Marsaglia and Tsang's rejection."""
    d = shape - 1 / 3
    c, out, live = 1 / np.sqrt(9 * d), d.copy(), np.arange(len(shape))
    for attempt in range(24):
        x = normal(seed[live], sweep, step + 3 * attempt)
        u = np.maximum(uniform(seed[live], sweep, step + 3 * attempt + 2), 1e-16)
        v = (1 + c[live] * x) ** 3
        ok = v > 0
        ok[ok] = np.log(u[ok]) < x[ok] ** 2 / 2 + d[live[ok]] * (1 - v[ok] + np.log(v[ok]))
        out[live[ok]] = d[live[ok]] * v[ok]
        live = live[~ok]
        if not len(live):
            break
    return out


def tables_drawn(tables: np.ndarray, concentration: float, discount: float, seed: np.ndarray, sweep: int) -> float:
    """Sum over restaurants of Bernoulli(concentration / (concentration + discount * i)), i from 1 below the tables.

    Beyond 32 tables the sum of rare events is a rounded normal number.
    """
    total = 0.0
    for i in range(1, 32):
        more = np.flatnonzero(tables > i)
        if not len(more):
            return total
        tables, seed = tables[more], seed[more]
        total += float(np.count_nonzero(uniform(seed, sweep, 1_000 + i) < concentration / (concentration + discount * i)))
    many = tables > 32
    if many.any():
        part = concentration / discount
        mean = part * (np.log(tables[many] + part - 0.5) - np.log(32 + part - 0.5))
        total += float(np.maximum(np.floor(mean + np.sqrt(mean) * normal(seed[many], sweep, 1_100) + 0.5), 0).sum())
    return total


@dataclass
class State:
    """What every task must know of a sweep."""

    sweep: int
    theta: tuple[float, float]  # unigram, words after words
    discount: tuple[float, float]
    words: float = 0.0
    customers: float = 0.0  # of the unigram restaurant
    tables: float = 0.0

    def unigram(self, customers: np.ndarray, tables: np.ndarray, cost: np.ndarray) -> np.ndarray:
        base = np.exp(cost / -COST)
        up = np.maximum(customers - self.discount[0] * tables, 0) + (self.theta[0] + self.discount[0] * self.tables) * base
        return up / (self.theta[0] + self.customers)


# --- chunks ---------------------------------------------------------------------

def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings one after the other, and where each begins and the last ends."""
    _, edges, data = values.buffers()
    edges = np.frombuffer(edges, np.int64, len(values) + 1, 8 * values.offset) if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


class _Builder:
    def __init__(self):
        self.docs, self.texts, self.bytes = [], [], 0

    def add(self, docs: pa.Array, texts: pa.Array) -> None:
        """Rows of identifiers and large strings."""
        self.docs += docs.to_pylist()
        self.texts.append(texts)
        self.bytes += pc.sum(pc.binary_length(texts)).as_py() or 0

    def words(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(tokens of each text, its end included; tokens as numbers of words; words by number), as ``tokens_of`` has them."""
        data, edges = _flat(pc.ascii_lower(pa.concat_arrays(self.texts)))
        inside = ~((data == 32) | (data - np.uint8(9) < 5))  # of a word
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[edges[:-1][edges[1:] > edges[:-1]]] = True  # texts stand one after the other
        begins &= inside
        lengths = np.diff(np.searchsorted(np.flatnonzero(begins), edges)) + 1
        letters = data[inside]  # words one after the other
        cuts = np.append(np.flatnonzero(begins[inside]), len(letters))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(letters)]).dictionary_encode()
        flat = np.ones(int(lengths.sum()), np.int64)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(lengths) - 1] = False
        flat[inner] = found.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2
        spelled, cuts = _flat(found.dictionary)
        spelled, cuts = spelled.tobytes(), cuts.tolist()
        return lengths, flat, [START, END, *[spelled[i:j] for i, j in zip(cuts[:-1], cuts[1:])]]

    def row(self, number: int) -> dict:
        from xxhash import xxh3_64_intdigest  # once, not word by word

        lengths, flat, words = self.words()
        hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        words[1] = START  # spelled by its mark alone
        return {
            "chunk": number, "doc_ids": [d or 0 for d in self.docs], "null_id": np.array([d is None for d in self.docs], np.uint8).tobytes(),
            "held": np.array([held_out(d) for d in self.docs], np.uint8).tobytes(), "lengths": _planes(lengths), "hashes": _ascending(hashes[order]),
            "spelled": END.join([words[i] for i in order.tolist()]) + END, "tokens": _planes(place[flat]), "n_words": len(words),
            "n_tokens": len(flat),
        }


class Chunk:
    """A chunk's documents and words, and with ``pairs`` its distinct pairs (word, word before)."""

    def __init__(self, row: dict, pairs: bool = True):
        self.hashes = _from_ascending(row["hashes"])
        n = len(self.hashes)
        flat, self.lengths = _from_planes(row["tokens"]).astype(np.int64), _from_planes(row["lengths"]).astype(np.int64)
        self.held = np.frombuffer(row["held"], np.uint8)
        training = np.repeat(self.held == 0, self.lengths)
        self.word_train = np.bincount(flat[training], minlength=n)
        if not pairs:
            return
        self.start, self.end = (np.searchsorted(self.hashes, np.uint64(_word_hash(w))) for w in (START, END))
        self.first = np.cumsum(self.lengths) - self.lengths
        key = flat * n
        key[1:] += flat[:-1]
        key[self.first] += self.start - np.where(self.first > 0, flat[self.first - 1], 0)
        bits = max(len(flat) - 1, 1).bit_length()
        if (n * n).bit_length() + bits < 64:  # pairs and places sorted as one number each
            key = np.sort(key << bits | np.arange(len(flat)))
            key, order = key >> bits, key & (1 << bits) - 1
        else:
            order = np.argsort(key)
            key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        self.of = np.empty(len(flat), np.int32)
        self.of[order] = np.cumsum(new) - 1
        self.word, self.before = (x.astype(np.int32) for x in np.divmod(key[new], n))
        self.train = np.bincount(self.of[training], minlength=len(self.word))

    def coded(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the pairs, the order in which they ascend)."""
        code = pair_hash(self.hashes[self.word], self.hashes[self.before])
        return code, _sorted(code)

    def by_customers(self, count: np.ndarray) -> np.ndarray:
        """The pairs of two customers or more by their number, to EXACT, then by word."""
        many = np.flatnonzero(count > 1)
        return many[np.argsort(np.minimum(count[many], EXACT + 1).astype(np.uint8), kind="stable")]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema = _arrow_schema(CHUNK)
    number, chunk = TaskContext.get().partitionId() << 32, _Builder()
    for batch in batches:
        docs, texts = batch.column(0), pc.fill_null(batch.column(1), "").cast(pa.large_string())
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while at < len(docs):
            before = ends[at - 1] if at else 0
            to = min(int(np.searchsorted(ends, before + CHUNK_BYTES - chunk.bytes)) + 1, len(docs))
            chunk.add(docs[at:to], texts[at:to])
            at = to
            if chunk.bytes >= CHUNK_BYTES:
                yield pa.RecordBatch.from_pylist([chunk.row(number)], schema)
                number, chunk = number + 1, _Builder()
    if chunk.docs:
        yield pa.RecordBatch.from_pylist([chunk.row(number)], schema)


# --- spellings ------------------------------------------------------------------

def _byte_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n): how often a byte follows another in the words of training texts, END on either side of a word, each word as often as it occurs."""
    total = np.zeros(1 << 16, np.int64)
    for row in _rows(batches):
        chunk = Chunk(row, pairs=False)
        data = np.frombuffer(row["spelled"], np.uint8)
        ends = np.flatnonzero(data == END[0])
        times = np.repeat(chunk.word_train, np.diff(ends, prepend=-1))
        before = np.concatenate([[END[0]], data[:-1]]).astype(np.int64)
        total += np.bincount(before << 8 | data, times, 1 << 16).astype(np.int64)
    codes = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(total[codes])], names=["code", "n"])


def spelling_costs(counts: dict[int, int]) -> np.ndarray:
    """[byte before, byte]: -log of the chance of a byte after another; END ends a word."""
    n = np.zeros((256, 256))
    for code, k in counts.items():
        n[code >> 8, code & 0xFF] = k
    alone_ = (n.sum(axis=0) + 0.5) / (n.sum() + 128)
    return -np.log((n + SMOOTH * alone_) / (n.sum(axis=1, keepdims=True) + SMOOTH))


def word_costs(spelled: bytes, costs: np.ndarray) -> np.ndarray:
    """-log of the base measure of each word, in parts of a nat."""
    data = np.frombuffer(spelled, np.uint8)
    each = costs[np.concatenate([[END[0]], data[:-1]]), data]
    ends = np.flatnonzero(data == END[0])
    return np.round(np.add.reduceat(each, np.concatenate([[0], ends[:-1] + 1])) * COST).astype(np.int64)


# --- asking ranges --------------------------------------------------------------

def _ask_pairs(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema(MAIL)
        for row in _rows(batches):
            chunk = Chunk(row)
            code, order = chunk.coded()
            code, train = code[order], chunk.train[order]
            cuts = _cuts(code, ranges)
            yield pa.RecordBatch.from_pylist([
                {"chunk": row["chunk"], "bucket": b, "kind": PAIRS, "a": _ascending(code[i:j]), "b": _bytes(train[i:j])}
                for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j
            ], schema)

    return run


def _ones_and_twos(count: np.ndarray) -> list[float]:
    return [float(np.sum(count == 1)), float(np.sum(count == 2)), float(np.sum(count > 0)), float(count.sum())]


def _count_pairs(table: pa.Table) -> pa.Table:
    """To each chunk the customers of its pairs, and which of them it is the first to hold."""
    rows = _by(table.to_pylist(), PAIRS, "chunk")
    codes = [_from_ascending(r["a"]) for r in rows]
    train = _joined(rows, "b").astype(np.int64)
    known, of = np.unique(np.concatenate(codes), return_inverse=True)
    count = np.bincount(of, train, len(known))
    held = np.flatnonzero(train > 0)
    first = np.zeros(len(of), bool)
    first[held[np.unique(of[held], return_index=True)[1]]] = True
    cuts = np.cumsum([len(c) for c in codes])[:-1]
    out = [
        {"chunk": r["chunk"], "bucket": r["bucket"], "kind": PAIRS, "a": _bytes(count[at]), "b": np.packbits(own).tobytes()}
        for r, at, own in zip(rows, np.split(of, cuts), np.split(first, cuts))
    ]
    return _mail([*out, {"chunk": -1, "bucket": rows[0]["bucket"], "kind": SUMS, "s": _ones_and_twos(count)}])


def _ask_words(ranges: int, costs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema(MAIL)
        for row in _rows(batches):
            chunk = Chunk(row, pairs=False)
            cost, cuts = word_costs(row["spelled"], costs), _cuts(chunk.hashes, ranges)
            yield pa.RecordBatch.from_pylist([
                {"chunk": row["chunk"], "bucket": b, "kind": ASKED, "a": _ascending(chunk.hashes[i:j]), "b": _bytes(chunk.word_train[i:j]), "c": _planes(cost[i:j])}
                for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j
            ], schema)

    return run


def _count_words(table: pa.Table) -> pa.Table:
    """The owner's words, where each chunk's are among them, and to each chunk the counts of its words."""
    rows = _by(table.to_pylist(), ASKED, "chunk")
    hashes = [_from_ascending(r["a"]) for r in rows]
    known, first, of = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    count = np.bincount(of, _joined(rows, "b"), len(known))
    cost = _joined(rows, "c", _from_planes)[first]
    out = []
    for r, at in zip(rows, np.split(of, np.cumsum([len(h) for h in hashes])[:-1])):
        base = {"chunk": r["chunk"], "bucket": r["bucket"]}
        out.append(base | {"kind": KNOWN, "a": _bytes(count[at]), "b": _planes(cost[at])})
        out.append(base | {"kind": ASKED, "a": _bytes(np.diff(at, prepend=0))})
    bucket = rows[0]["bucket"]
    out.append({"chunk": -1, "bucket": bucket, "kind": OWNER, "a": _bytes(count), "b": _planes(cost), "c": _ascending(known)})
    return _mail([*out, {"chunk": -1, "bucket": bucket, "kind": SUMS, "s": _ones_and_twos(count)}])


# --- sweeps ---------------------------------------------------------------------

def _sent(chunk: int, known: list[dict], sums: list[np.ndarray]) -> list[dict]:
    """Sums by word and by word before for the owners of the words."""
    cuts = np.cumsum([_length(r["b"]) for r in known])[:-1]
    return [
        {"chunk": chunk, "bucket": r["bucket"], "kind": SENT, "a": _bytes(a), "b": _bytes(b)}
        for r, a, b in zip(known, *(np.split(x, cuts) for x in sums))
    ]


def _prepare(discount: float):
    """A chunk's pairs of two customers or more, its words' costs, what its pairs of one customer add to the tables, and the first tables' sums."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, mail = [], right.to_pylist()
        known, answers = _by(mail, KNOWN, "bucket"), _by(mail, PAIRS, "bucket")
        for row in left.to_pylist():
            chunk = Chunk(row)
            code, order = chunk.coded()
            count, own = np.empty(len(order), np.int64), np.empty(len(order), bool)
            count[order] = _joined(answers, "a")
            own[order] = np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8), count=_length(r["a"])) for r in answers])
            n, single, many = len(chunk.hashes), np.flatnonzero((count == 1) & own), chunk.by_customers(count)
            word, before, count, own = chunk.word[many], chunk.before[many], count[many], own[many]
            fixed = [np.bincount(at[single], minlength=n) for at in (chunk.word, chunk.before)]
            out.append({
                "chunk": row["chunk"], "bucket": 0, "kind": ENTRY, "a": _bytes(np.diff(word.astype("<u4"), prepend=np.zeros(1, "<u4"))),
                "b": _planes(before), "c": _bytes(count), "d": np.packbits(own).tobytes(), "e": _planes(code[many] >> np.uint64(32)),
                "f": _bytes(np.concatenate(fixed)),
            })
            tables = np.maximum(np.floor(count[own] ** discount), 1)
            out += [{"chunk": row["chunk"], "bucket": r["bucket"], "kind": KNOWN, "b": r["b"]} for r in known]
            out += _sent(row["chunk"], known, [f + np.bincount(at[own], tables, n) for f, at in zip(fixed, (word, before))])
        return _mail(out)

    return run


def _seat(state: State, adds: bool):
    """One sweep of a chunk: its new tables, added to those before, and their sums for the owners of the words."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, mail = left.to_pylist(), right.to_pylist()
        known, entry, answers = _by(mine, KNOWN, "bucket"), _by(mine, ENTRY, "bucket")[0], _by(mail, ANSWER, "bucket")
        word, before, count = np.cumsum(_from_bytes(entry["a"]), dtype="<u4"), _from_planes(entry["b"]), _from_bytes(entry["c"])
        own = np.unpackbits(np.frombuffer(entry["d"], np.uint8), count=len(word)).astype(bool)
        up = state.unigram(_joined(answers, "a"), _joined(answers, "b"), _joined(known, "b", _from_planes))
        weight = (state.theta[1] + state.discount[1] * _joined(answers, "c"))[before] * up[word]
        tables = seated(count, weight, state.discount[1], _from_planes(entry["e"]), state.sweep)
        fixed = _from_bytes(entry["f"]).reshape(2, -1)
        out = _sent(entry["chunk"], known, [f + np.bincount(at[own], tables[own], len(f)) for f, at in zip(fixed, (word, before))])
        if adds:
            total = sum((_from_bytes(r["b"]) for r in _by(mail, TABLES, "bucket")), tables)
            out.append({"chunk": entry["chunk"], "bucket": 0, "kind": TABLES, "b": _bytes(total)})
        return _mail(out)

    return run


def _own(state: State):
    """One sweep of the unigram restaurant over the words of a range; the answers to the chunks."""
    def run(table: pa.Table) -> pa.Table:
        mail = table.to_pylist()
        owner, asked, sent = _by(mail, OWNER, "chunk")[0], _by(mail, ASKED, "chunk"), _by(mail, SENT, "chunk")
        places = [np.cumsum(_from_bytes(r["a"]), dtype=np.int64) for r in asked]
        cost, seed = _from_planes(owner["b"]), _from_ascending(owner["c"])
        at = np.concatenate(places)
        customers, restaurant = (np.bincount(at, _joined(sent, c), len(cost)) for c in "ab")
        weight = (state.theta[0] + state.discount[0] * (state.tables or state.words)) * np.exp(cost / -COST)
        tables = seated(customers, weight, state.discount[0], seed, state.sweep + 1000)
        size = _from_bytes(owner["a"]).astype(np.float64)  # customers of a word's own restaurant: the words after it
        drawn = tables_drawn(restaurant, state.theta[1], state.discount[1], seed, state.sweep)
        live = (size > 1) & (restaurant > 0)
        ones, rest = (gammas(np.broadcast_to(shape, int(live.sum())), seed[live], state.sweep, step) for shape, step in ((state.theta[1] + 1, 2_000), (size[live] - 1, 3_000)))
        logs = float(np.log(np.maximum(ones / (ones + rest), 1e-300)).sum())
        bucket = owner["bucket"]
        out = [
            {"chunk": r["chunk"], "bucket": bucket, "kind": ANSWER, "a": _bytes(customers[p]), "b": _bytes(tables[p]), "c": _bytes(restaurant[p])}
            for r, p in zip(asked, places)
        ]
        return _mail([*out, {"chunk": -1, "bucket": bucket, "kind": SUMS, "s": [float(customers.sum()), float(tables.sum()), drawn, logs]}])

    return run


# --- scores ---------------------------------------------------------------------

def _score(states: list[State], words: float, tokens: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, mail = [], right.to_pylist()
        known, pairs = _by(mail, KNOWN, "bucket"), _by(mail, PAIRS, "bucket")
        for row in left.to_pylist():
            chunk = Chunk(row)
            code, order = chunk.coded()
            count = np.empty(len(order))
            count[order] = _joined(pairs, "a")
            tables = np.minimum(count, 1.0)
            tables[chunk.by_customers(count)] = _joined(_by(mail, TABLES, "bucket"), "b") / len(states)
            train, cost = _joined(known, "a").astype(np.float64), _joined(known, "b", _from_planes)
            size = train.copy()
            size[chunk.start], size[chunk.end] = train[chunk.end], 0  # as many starts as ends; nothing follows an end
            chance = np.zeros(len(count))
            for state in states:
                answers = [r for r in _by(mail, ANSWER, "bucket") if r["s"][0] == state.sweep]
                up = state.unigram(_joined(answers, "a"), _joined(answers, "b"), cost)
                theta, d = state.theta[1], state.discount[1]
                u, per = chunk.before, 1 / (theta + size)
                chance += np.maximum(count - d * tables, 0) * per[u] + ((theta + d * _joined(answers, "c")) * per)[u] * up[chunk.word]
            score = np.log10(np.clip(chance / len(states), 1e-300, 1.0))
            base = np.log10((train + 0.1) / (tokens + 0.1 * (words + 1)))
            of = chunk.of
            word = chunk.word[of]
            sums = [np.add.reduceat(x, chunk.first) for x in (score[of], base[word], (train > 0).astype(np.float64)[word])]
            null = np.frombuffer(row["null_id"], np.uint8)
            for i, doc_id in enumerate(row["doc_ids"]):
                out.append({
                    "doc_id": None if null[i] else doc_id, "held_out": bool(chunk.held[i]), "n_tokens": int(chunk.lengths[i]),
                    "n_known": int(round(sums[2][i])), "train_tokens": int(tokens), "base_score": float(sums[1][i]), "score": float(sums[0][i]),
                })
        return pa.Table.from_pylist(out, _arrow_schema(RESULT))

    return run


def _bucketed(df: DataFrame, scratch: Scratch, names: dict[str, str], name: str, buckets: int) -> DataFrame:
    """``df`` as a table bucketed by chunk: what is joined with it by chunk moves, it does not.  Its name is added to ``names``."""
    table = names[name] = f"pitman_yor_{name}_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(buckets, "chunk").option("compression", "zstd").option("path", f"{scratch.root}/{name}").saveAsTable(table)
    return scratch.spark.table(table)


def score_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 5
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    if docs.schema[doc_id].dataType.typeName() not in {"byte", "short", "integer", "long"}:
        raise TypeError(f"identifiers must be integers, {doc_id} is {docs.schema[doc_id].dataType.simpleString()}")
    spark = docs.sparkSession
    scratch, names = Scratch(spark, "pitman-yor"), {}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = _bucketed(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_chunks, CHUNK), scratch, names, "chunks", parts)
    n_words, n_tokens = chunks.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    pair_ranges, word_ranges = (max(8, math.ceil((n or 0) / RANGE)) for n in (n_tokens, n_words))  # a chunk has fewer pairs than tokens
    counts = dict(chunks.mapInArrow(_byte_pairs, "code int, n long").groupBy("code").agg(F.sum("n")).collect())  # 2**16 rows at most
    costs = spelling_costs(counts)
    dealt = lambda df, n: df.repartition(n, "bucket").groupBy("bucket")
    pairs = scratch.table(dealt(chunks.mapInArrow(_ask_pairs(pair_ranges), MAIL), pair_ranges).applyInArrow(_count_pairs, MAIL), "pairs")
    release_shuffles(spark)
    owners = scratch.table(dealt(chunks.mapInArrow(_ask_words(word_ranges, costs), MAIL), word_ranges).applyInArrow(_count_words, MAIL), "words")
    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    sums = lambda df, n: [x or 0.0 for x in of(df, SUMS).agg(*[F.sum(F.col("s")[i]) for i in range(n)]).first()]
    discount = lambda one, two: min(max(one / max(one + 2 * two, 1.0), 0.1), 0.95)
    one, two, words, tokens = sums(owners, 4)
    discounts = discount(one, two), discount(*sums(pairs, 2))

    release_shuffles(spark)
    rng = np.random.default_rng(seed)
    together = lambda l, r: l.groupBy("chunk").cogroup(r.groupBy("chunk"))
    entries = _bucketed(
        together(chunks, of(pairs, PAIRS).unionByName(of(owners, KNOWN))).applyInArrow(_prepare(discounts[1]), MAIL), scratch, names, "entries", parts
    )
    seats, entries = of(entries, SENT), of(entries, ENTRY, KNOWN)
    state, kept = State(0, (1.0, 1.0), discounts, words), []
    for sweep in range(sweeps):
        state = State(sweep, state.theta, discounts, words, state.customers, state.tables)
        mail = of(owners, ASKED, OWNER).unionByName(of(seats, SENT))
        answered = scratch.table(dealt(mail, word_ranges).applyInArrow(_own(state), MAIL), f"answered{sweep}")
        customers, n_tables, drawn, logs = sums(answered, 4)
        drawn0 = tables_drawn(np.array([n_tables]), state.theta[0], discounts[0], np.array([seed], np.uint64), sweep)
        logs0 = math.log(max(rng.beta(state.theta[0] + 1, max(customers - 1, 1)), 1e-300))
        theta = rng.gamma(1 + drawn0, 1 / (1 - logs0)), rng.gamma(1 + drawn, 1 / (1 - logs))
        state = State(sweep, tuple(max(float(t), 1e-3) for t in theta), discounts, words, customers, n_tables)
        seats = scratch.table(
            together(entries, of(answered, ANSWER).unionByName(of(seats, TABLES))).applyInArrow(_seat(state, sweep >= burn_in), MAIL), f"seated{sweep}"
        )
        if sweep:
            scratch.drop(f"seated{sweep - 1}")
        if sweep < burn_in:
            scratch.drop(f"answered{sweep}")
        release_shuffles(spark)
        if sweep >= burn_in:
            kept.append((state, of(answered, ANSWER).withColumn("s", F.array(F.lit(float(sweep))))))
    mail = of(pairs, PAIRS).unionByName(of(owners, KNOWN)).unionByName(of(seats, TABLES))
    for _, answers in kept:
        mail = mail.unionByName(answers)
    spark.sql(f"drop table if exists {names.pop('entries')}")  # scores need the answers only
    scratch.drop("entries")
    scored = scratch.table(together(chunks, mail).applyInArrow(_score([s for s, _ in kept], words, tokens), RESULT), "scored")
    for name, table in names.items():
        spark.sql(f"drop table if exists {table}")
        scratch.drop(name)
    for name in ("pairs", "words", f"seated{sweeps - 1}", *(f"answered{n}" for n in range(burn_in, sweeps))):
        scratch.drop(name)
    return scored
