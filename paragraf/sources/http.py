"""Fetching over HTTP: retries with backoff, a rate limit, raw snapshots. Plain Python, made to run inside tasks.

A fetcher is any callable url -> (status, bytes); Client is the one that uses the network. Tests and replays pass
their own (see landing.py).
"""

from __future__ import annotations

import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPACES

Fetcher = Callable[[str], tuple[int, bytes]]
ATTEMPTS, BASE_S, CAP_S, AGENT = 3, 0.25, 5.0, "paragraf"


def should_retry(status: int, error: Exception | None) -> bool:
    return error is not None or status >= 500


def backoff_s(attempt: int, base: float = BASE_S, cap: float = CAP_S) -> float:
    """The pause after that attempt (from 1): base, doubled each time, cap at most."""
    return min(base * 2.0 ** min(max(attempt, 1) - 1, 60), cap)


def retry_column(status: Column, error: Column) -> Column:
    return error.isNotNull() | F.coalesce(status >= 500, F.lit(False))


def backoff_column(attempt: Column, base: float = BASE_S, cap: float = CAP_S) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1), F.lit(cap))


class Exhausted(RuntimeError):
    """The last attempt was answered with a server error."""


@dataclass
class Retry:
    attempts: int = ATTEMPTS
    base_s: float = BASE_S
    cap_s: float = CAP_S
    should: Callable[[int, Exception | None], bool] = should_retry
    sleep: Callable[[float], None] = time.sleep

    def run(self, fetch: Callable[[], tuple[int, bytes]]) -> tuple[int, bytes]:
        """An answer below 500 ends it, whatever should says. One attempt alone returns what it got."""
        attempts = max(1, self.attempts)
        for k in range(1, attempts + 1):
            status, payload, error = 0, b"", None
            try:
                status, payload = fetch()
            except Exception as e:  # whatever a transport raises counts as a failed attempt
                error = e
            if error is None and status < 500:
                return status, payload
            if k == attempts or not self.should(status, error):
                if error is not None:
                    raise error
                if attempts > 1 and k == attempts:
                    raise Exhausted(f"retry attempts exhausted, last status {status}")
                return status, payload
            self.sleep(backoff_s(k, self.base_s, self.cap_s))
        raise AssertionError("unreachable")


@dataclass
class Limiter:
    """At most one call every interval, counted from the first. 0 or less is a millisecond.

    It holds for one task; n tasks at once are n times as fast.
    """

    interval_s: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    stopped: bool = False
    _next: float | None = field(default=None, repr=False)

    def wait(self) -> None:
        if self.stopped:
            raise RuntimeError("the limiter is stopped")
        step, now = max(self.interval_s, 0.001), self.clock()
        due = now + step if self._next is None else max(self._next, now)
        if due > now:
            self.sleep(due - now)
        self._next = due + step

    def stop(self) -> None:
        self.stopped = True


@dataclass
class Client:
    agent: str = AGENT
    retry: Retry = field(default_factory=Retry)
    limiter: Limiter | None = None
    timeout_s: float = 60.0

    def _once(self, url: str) -> tuple[int, bytes]:
        if self.limiter:
            self.limiter.wait()
        asked = urllib.request.Request(url, headers={"User-Agent": self.agent} if self.agent.strip() else {})
        try:
            with urllib.request.urlopen(asked, timeout=self.timeout_s) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    def __call__(self, url: str) -> tuple[int, bytes]:
        return self.retry.run(lambda: self._once(url))


def clean_part(v: str) -> str:
    """As functions.text.path_part: safe as part of a file name."""
    return re.sub(r"[^a-zA-Z0-9._-]+", "_", v.strip(SPACES)).strip("._-") or "unknown"


def save_snapshot(base: str, source: str, doc_id: str, payload: bytes, now: datetime | None = None) -> str:
    """Path of the file written. A number is added where another of the same second is there."""
    where = os.path.join(base.strip() or "snapshots", clean_part(source))
    os.makedirs(where, exist_ok=True)
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")
    stem = stamp + (f"_{clean_part(doc_id)}" if doc_id.strip(SPACES) else "")
    k = 0
    while True:
        path = os.path.join(where, f"{stem}{f'_{k}' if k else ''}.snapshot")
        try:
            with open(path, "xb") as f:
                f.write(payload)
            return path
        except FileExistsError:
            k += 1
