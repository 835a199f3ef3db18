"""Asking a slow service from inside tasks: bounded concurrency, retries, budgets, a circuit breaker.

An :class:`Asker` is a scorer (payloads to answers) for :func:`judge.judge_cached`; a
:class:`TokenBatches` is a model (texts to vectors) for :func:`vectors.embed_with_cache`.
Both travel to the workers and keep their state for as long as a task lasts: the limits are
those of a task, and a job asks with at most tasks x concurrency requests at once.  A request
that fails for good gives None beside the answers of the others, so nothing that was paid for
is lost; what is None is not cached and is asked again by the next run.
"""

from __future__ import annotations

import asyncio
import inspect
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class Permanent(Exception):
    """A failure that asking again does not mend (a bad request, no permission)."""


def rough_tokens(text: str) -> int:
    """A quarter of the characters, one at least."""
    return max(1, len(text) // 4)


@dataclass
class Asker:
    """Answers of ``call``, a plain or ``async`` function of one payload.

    At most ``concurrency`` requests are under way.  A failed one is tried ``attempts`` times
    in all, after pauses that double from ``pause`` up to ``longest`` seconds, each shortened
    by chance to a half at most; an error with ``retry_after`` says itself how long to wait.
    ``tokens_per_minute`` is a budget that refills steadily; a payload larger than the whole
    budget waits for a full one.  After ``breaker`` requests in a row that failed for good
    the task asks no more.
    """

    call: Callable[[str], Any]
    concurrency: int = 6
    attempts: int = 4
    pause: float = 0.5
    longest: float = 30.0
    timeout: float = 60.0
    breaker: int = 10
    tokens_per_minute: float | None = None
    count: Callable[[str], int] = rough_tokens
    failures: list[str] = field(default_factory=list)
    in_a_row: int = 0
    _level: float = 0.0
    _at: float | None = None

    def __call__(self, payloads: list[str]) -> list[Any]:
        return asyncio.run(self._all(list(payloads))) if payloads else []

    @property
    def open(self) -> bool:
        return self.in_a_row >= self.breaker

    async def _all(self, payloads: list[str]) -> list[Any]:
        gate, budget = asyncio.Semaphore(self.concurrency), asyncio.Lock()
        self._at = None if self.tokens_per_minute is None else asyncio.get_running_loop().time()
        self._level = self.tokens_per_minute or 0.0

        async def one(payload: str) -> Any:
            async with gate:
                if self.open:
                    self.failures.append("circuit open")
                    return None
                try:
                    answer = await self._tried(payload, budget)
                except Exception as e:  # an answer that will not come is one row
                    self.in_a_row += 1
                    self.failures.append(f"{type(e).__name__}: {e}")
                    return None
                self.in_a_row = 0
                return answer

        return list(await asyncio.gather(*map(one, payloads)))

    async def _tried(self, payload: str, budget: asyncio.Lock) -> Any:
        for attempt in range(1, self.attempts + 1):
            await self._afford(payload, budget)
            try:
                return await asyncio.wait_for(self._once(payload), self.timeout)
            except Permanent:
                raise
            except Exception as e:
                if attempt == self.attempts or self.open:
                    raise
                told = getattr(e, "retry_after", None)
                wait = min(self.longest, self.pause * 2 ** (attempt - 1)) * (0.5 + random.random() / 2)
                await asyncio.sleep(wait if told is None else float(told))

    async def _once(self, payload: str) -> Any:
        if inspect.iscoroutinefunction(self.call):
            return await self.call(payload)
        return await asyncio.to_thread(self.call, payload)

    async def _afford(self, payload: str, budget: asyncio.Lock) -> None:
        if self.tokens_per_minute is None:
            return
        need = min(float(self.count(payload)), self.tokens_per_minute)
        async with budget:  # in turn, so that a large payload is not overtaken for ever
            clock = asyncio.get_running_loop().time
            while True:
                now = clock()
                self._level = min(self.tokens_per_minute, self._level + (now - self._at) * self.tokens_per_minute / 60)
                self._at = now
                if self._level >= need - 1e-9:
                    self._level -= need
                    return
                await asyncio.sleep((need - self._level) * 60 / self.tokens_per_minute)


def token_batches(texts: list[str], most_tokens: int, most_texts: int, count: Callable[[str], int] = rough_tokens) -> list[list[int]]:
    """Numbers of the texts of each request, in order: as many as the limits allow, one at least."""
    out: list[list[int]] = []
    held = 0
    for n, text in enumerate(texts):
        own = count(text)
        if not out or len(out[-1]) >= most_texts or held + own > most_tokens:
            out.append([])
            held = 0
        out[-1].append(n)
        held += own
    return out


@dataclass
class TokenBatches:
    """A model that takes a list of texts, asked in requests of at most ``most_tokens`` and ``most_texts``.

    Requests run as an :class:`Asker` does; the texts of one that failed have the vector None.
    """

    model: Callable[[list[str]], list[list[float]]]
    most_tokens: int = 200_000
    most_texts: int = 128
    count: Callable[[str], int] = rough_tokens
    concurrency: int = 4
    attempts: int = 4
    pause: float = 0.5
    timeout: float = 120.0

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        groups = token_batches(texts, self.most_tokens, self.most_texts, self.count)

        def call(number: int) -> list[list[float]]:
            vectors = self.model([texts[n] for n in groups[number]])
            if len(vectors) != len(groups[number]):
                raise Permanent(f"{len(vectors)} vectors for {len(groups[number])} texts")
            return vectors

        asker = Asker(call, self.concurrency, self.attempts, self.pause, timeout=self.timeout, breaker=len(groups) + 1)
        out: list[list[float] | None] = [None] * len(texts)
        for group, vectors in zip(groups, asker(list(range(len(groups))))):
            for n, v in zip(group, vectors or []):
                out[n] = v
        return out
