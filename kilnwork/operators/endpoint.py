"""An outside endpoint asked from inside a task: a sliding window of requests with timeouts, retries and a limit on tokens."""

from __future__ import annotations

import heapq
import json
import queue
import threading
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Limits:
    """How a task asks. `tokens_per_minute` holds for all `tasks` together: a table is dealt over so many tasks, and each has its share."""

    in_flight: int = 4
    timeout: float = 120.0
    tries: int = 3
    backoff: float = 1.0
    tokens_per_minute: float | None = None
    tasks: int | None = None
    #: Results that are passed on together, at least; of fast answers those of a second, or MOST.
    every: int = 10
    #: Requests that timed out and still hang, at most; beyond it the task fails, and Spark runs it again.
    hanging: int = 64

    def share(self) -> float | None:
        """Tokens a second of one task."""
        if self.tokens_per_minute is None:
            return None
        if not self.tasks:
            raise ValueError("a limit on tokens needs a number of tasks to be shared by")
        return self.tokens_per_minute / 60 / self.tasks


class TokenBucket:
    """Tokens that come in at a steady rate, a minute's worth at most. What costs more than that waits for a full bucket and leaves a debt."""

    def __init__(self, rate: float, clock: Callable[[], float]):
        self.rate, self.most, self.clock = rate, rate * 60, clock
        self.level, self.at = self.most, clock()

    def wait(self, cost: float) -> float:
        """Seconds until the cost can be met."""
        now = self.clock()
        self.level, self.at = min(self.most, self.level + (now - self.at) * self.rate), now
        return max(0.0, (min(cost, self.most) - self.level) / self.rate)

    def spend(self, cost: float) -> None:
        self.level -= cost


class Clients:
    """Clients of a task, each used by one request at a time; one that still hangs is not used again."""

    def __init__(self, make: Callable[[], Callable[[Any], Any]]):
        self.make, self.free = make, queue.SimpleQueue()

    def __call__(self, request: Any) -> Any:
        try:
            client = self.free.get_nowait()
        except queue.Empty:
            client = self.make()
        try:
            return client(request)
        finally:
            self.free.put(client)


def asked(requests: Iterable[tuple[Any, Any]], ask: Callable[[Any], Any], limits: Limits, *, cost: Callable[[Any], float] = lambda r: 1.0, clock: Callable[[], float] = time.monotonic) -> Iterator[tuple[Any, Any, Exception | None, int]]:
    """(key, answer, error, tries) of every (key, request), as they are done.

    As soon as one is done the next one is asked, so a slow answer holds up nothing else; requests are taken from their source no
    sooner. A request that fails or takes longer than the timeout is asked again after a delay that doubles, up to `tries` times in all;
    meanwhile others take its turn. An answer that comes after its timeout is dropped.
    """
    source, open_ = iter(requests), True
    done: queue.SimpleQueue = queue.SimpleQueue()
    running: dict[int, tuple[float, Any, Any, int]] = {}
    again: list[tuple[float, int, Any, Any, int]] = []
    bucket = TokenBucket(limits.share(), clock) if limits.share() else None
    number, hung, held = 0, set(), None

    jobs: queue.SimpleQueue = queue.SimpleQueue()
    threads = 0

    def work() -> None:
        while (job := jobs.get()) is not None:
            ticket, request = job
            try:
                done.put((ticket, ask(request), None))
            except Exception as e:  # noqa: BLE001  one bad answer must not end the job
                done.put((ticket, None, e))

    def failed(key: Any, request: Any, tries: int, error: Exception) -> Iterator[tuple]:
        if tries >= limits.tries:
            yield key, None, error, tries
        else:
            heapq.heappush(again, (clock() + limits.backoff * 2 ** (tries - 1), number, key, request, tries))

    try:
        while True:
            slow = None
            while len(running) < limits.in_flight:
                if held is None:
                    if again and again[0][0] <= clock():
                        _, _, key, request, tries = heapq.heappop(again)
                        held = key, request, tries
                    elif open_ and (first := next(source, None)) is not None:
                        held = *first, 0
                    else:
                        open_ = False
                        break
                price = cost(held[1]) if bucket else 0
                if bucket and (slow := bucket.wait(price)) > 0:
                    break
                slow = None
                key, request, tries = held
                held, number = None, number + 1
                if bucket:
                    bucket.spend(price)
                running[number] = clock() + limits.timeout, key, request, tries + 1
                jobs.put((number, request))
                if threads < len(running) + len(hung):  # a thread for each request that runs or hangs, used again and again
                    threads += 1
                    threading.Thread(target=work, daemon=True).start()
            if not running and not again and held is None and not open_:
                return
            until = [d for d, *_ in running.values()] + ([again[0][0]] if again and len(running) < limits.in_flight else []) + ([clock() + slow] if slow else [])
            try:
                ticket, answer, error = done.get(timeout=max(0.0, min(until) - clock()) if until else None)
            except queue.Empty:
                for ticket in [t for t, r in running.items() if r[0] <= clock()]:
                    _, key, request, tries = running.pop(ticket)
                    hung.add(ticket)
                    if len(hung) > limits.hanging:
                        raise RuntimeError(f"{len(hung)} requests to the endpoint hang") from None
                    yield from failed(key, request, tries, TimeoutError(f"no answer in {limits.timeout} s"))
                continue
            hung.discard(ticket)
            if ticket in running:
                _, key, request, tries = running.pop(ticket)
                if error is None:
                    yield key, answer, None, tries
                else:
                    yield from failed(key, request, tries, error)
    finally:
        for _ in range(threads):
            jobs.put(None)


def chat_client(url: str, model: str, key: str | None = None, *, temperature: float = 0.0, max_tokens: int = 2048, timeout: float = 120.0) -> Callable[[list[dict]], str]:
    """A client of an endpoint that speaks the common chat-completions form: messages in, the first choice's text out. Anything else is an error."""

    def ask(messages: list[dict]) -> str:
        body = json.dumps({"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(url.rstrip("/") + "/chat/completions", body, headers)
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]

    return ask
