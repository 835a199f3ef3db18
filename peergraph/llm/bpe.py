"""Byte-level BPE encoding and decoding, in time linear in the text.

A text is split by the tokenizer's pattern; each piece, as bytes mapped to Latin-1,
is run once through an Aho-Corasick automaton of the vocabulary, which gives the
tokens that start at each position.  The encoder takes the longest one that is
compatible with the token before it, and backtracks to shorter ones where the way
ends.  Two adjacent tokens are compatible when merging their joint bytes by rank
gives back exactly these two; the answers are memoised.  Since every prefix of a
piece has one valid last token, a position that was left once is dead and is never
tried again, so the work is linear.

Edge cases: null text is empty; an empty text gives no tokens; a piece may be of
any length; repeated rows give equal results; extra columns pass through; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peergraph.llm.common import fresh, give_back, small_batches

#: Entries after which a memo steps back for a new one; all four together stay below 100 MB in a
#: worker, and are given back when its task ends.
MEMO = 150_000
MEMO_PAIRS = 200_000
#: Longer pieces are encoded but not remembered.
MEMO_PIECE = 48
NO_RANK = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one ``base64(token) rank`` to a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PieceEncoder(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; a dict that fills itself."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        super().__init__()
        self.ranks = ranks
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        self.compatible: dict[int, bool] = {}
        # what was remembered before the last time a memo was full
        self.former: dict[str, bytes] = {}
        self.former_compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.sizes = [len(t or b"") for t in self.tokens]

    def __missing__(self, piece: str) -> bytes:
        packed = self.former.get(piece)
        if packed is None:
            ids = self.encode(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_PIECE:
            if len(self) >= MEMO:  # pieces in use come back from the former memo
                self.former = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def forget(self) -> None:
        """Gives the memos back: a worker that waits for other work keeps the vocabulary alone."""
        self.clear()
        self.former, self.compatible, self.former_compatible = {}, {}, {}
        give_back()

    def merge(self, piece: bytes) -> list[int]:
        """The definition: join the adjacent pair of least rank, leftmost first, as long as there is one."""
        rank_of, none = self.ranks.get, NO_RANK
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank_of(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != none:
            at = pairs.index(best)
            joint = parts[at] + parts[at + 1]
            parts[at : at + 2] = [joint]
            del pairs[at]
            if at:
                pairs[at - 1] = rank_of(parts[at - 1] + joint, none)
            if at < len(pairs):
                pairs[at] = rank_of(joint + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def fits(self, before: int, after: int) -> bool:
        """Whether ``after`` may follow ``before`` (-1: the start of a piece)."""
        key = (before + 1) << 32 | after
        known = self.compatible.get(key)
        if known is None:
            known = self.former_compatible.get(key)
            if known is None:
                head = [] if before < 0 else [before]
                known = self.merge(b"".join(self.tokens[t] for t in (*head, after))) == [*head, after]
            if len(self.compatible) >= MEMO_PAIRS:
                self.former_compatible, self.compatible = self.compatible, {}
            self.compatible[key] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        sizes, n, known, fits = self.sizes, len(piece), self.compatible, self.fits
        starting: list[list[int]] = [[] for _ in piece]
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            starting[end - sizes[rank] + 1].append(rank)  # by growing length
        out: list[int] = []
        at, last, dead = 0, -1, set()
        while at < n:
            options = starting[at]
            while options:
                token = options.pop()
                if at + sizes[token] not in dead:
                    fit = known.get((last + 1) << 32 | token)
                    if fits(last, token) if fit is None else fit:
                        out.append(token)
                        at += sizes[token]
                        last = token
                        break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead.add(at)
                at -= sizes[out.pop()]
                last = out[-1] if out else -1
        return out


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pieces = PieceEncoder(ranks)
        self.split = regex.compile(pattern).findall

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        ids = struct.unpack(f"<{len(packed) // 4}I", packed)
        return b"".join(map(self.pieces.tokens.__getitem__, ids))


#: One codec to a worker process and vocabulary.
_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    key = (ranks.id if hasattr(ranks, "id") else id(ranks), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks.value, pattern)
    return _CODECS[key]


def _sent(docs: DataFrame, ranks_path: str):
    """The vocabulary, a fixed file of a few megabytes at most, read on the driver and broadcast."""
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))


def _without(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(*[c for c in docs.columns if c.lower() not in names])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``token_ids`` (binary: little-endian unsigned 32-bit integers)."""
    ranks = _sent(docs, ranks_path)

    @F.arrow_udf("binary")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(ranks, pattern)
        try:
            for batch in texts:
                yield pa.array([codec.encode(t.as_py() or "") for t in batch], pa.binary())
        finally:
            codec.pieces.forget()

    return _without(docs, "token_ids", "n_tokens").withColumn("token_ids", ids(F.col(text))).withColumn(
        "n_tokens", (F.octet_length("token_ids") / 4).cast("long")
    )


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes that ``token_ids`` stand for."""
    ranks = _sent(encoded, ranks_path)

    @F.arrow_udf("binary")
    def decoded(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(ranks, pattern)
        for batch in ids:
            yield pa.array([codec.decode(x.as_py() or b"") for x in batch], pa.binary())

    return _without(encoded, "decoded").withColumn("decoded", decoded(F.col("token_ids")))


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``, ``n_tokens`` and ``decoded`` in one pass: one worker and one codec to a task."""
    ranks = _sent(docs, ranks_path)

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def coded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(ranks, pattern)
        try:
            for batch in texts:
                ids = [codec.encode(t.as_py() or "") for t in batch]
                yield pa.StructArray.from_arrays(
                    [pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())], names=["ids", "decoded"]
                )
        finally:
            codec.pieces.forget()

    kept = _without(docs, "token_ids", "n_tokens", "decoded")
    both = fresh(kept, "coded")
    marked = kept.withColumn(both, coded(F.col(text)))
    return marked.select(
        *[F.col(c) for c in kept.columns], F.col(both)["ids"].alias("token_ids"),
        (F.octet_length(F.col(both)["ids"]) / 4).cast("long").alias("n_tokens"), F.col(both)["decoded"].alias("decoded"),
    )
