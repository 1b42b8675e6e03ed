"""A managed subscription: replays, poll, serial handling with retries, dead letters and acknowledgement.

One subscriber's events are handled in order, so this is a loop over bounded polls, each a top-k
Spark query; many subscribers run side by side, or as one stream with ``delivery.delivered``. Attempts,
dead letters and cursors are rows of the control log, so a restart resumes the count.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inspect, poll
from ..sources.control_log import ControlLog

SHUTDOWN = "shutdown during backoff"


def parsed(event: dict) -> dict:
    """The event with its payload as JSON, or as text if it is none."""
    try:
        return event | {"payload": json.loads(event["payload"])}
    except (TypeError, ValueError):
        return event


class Subscriber:
    """Delivers a cursor's events to ``handler``, each up to 1 + ``max_retries`` times.

    ``events`` gives the log as it is now. Errors of ``on_error(error, event)``,
    ``on_dead_letter(event, reason)`` and ``on_lag(row)`` are swallowed.
    """

    def __init__(self, control: ControlLog, events: Callable[[], DataFrame], cursor_id: str, handler: Callable[[dict], Any], max_retries: int = 3, backoff_ms: tuple[int, ...] = (1_000, 5_000, 30_000), batch: int = 50, on_error: Callable | None = None, on_dead_letter: Callable | None = None, on_lag: Callable | None = None, clock: Callable[[], int] = lambda: time.time_ns() // 1_000_000):
        self.control, self.events, self.cursor_id, self.handler = control, events, cursor_id, handler
        self.max_retries, self.backoff_ms, self.batch, self.clock = max_retries, backoff_ms, batch, clock
        self.calls = {"error": on_error, "dead_letter": on_dead_letter, "lag": on_lag}
        self.stopping = threading.Event()

    def stop(self) -> None:
        """Ends the loop after the event in work; one that waits for a retry becomes a dead letter."""
        self.stopping.set()

    def _tell(self, which: str, *about) -> None:
        if self.calls[which] is not None:
            with contextlib.suppress(Exception):
                self.calls[which](*about)

    def _ack(self, cursor: dict, event_id: int) -> None:
        cursor |= {"last_event_id": event_id, "acked_at": self.clock()}
        self.control.put_rows("cursors", [cursor])

    def _dead(self, cursor: dict, event: dict, attempts: int, reason: str) -> None:
        top = self.control.read("dead_letters").agg(F.max("dl_id")).first()[0] or 0
        letter = {k: event.get(k) for k in ("event_id", "event_type", "domain", "subdomain", "payload", "emitted_at")}
        self.control.put_rows("dead_letters", [letter | {"dl_id": top + 1, "cursor_id": self.cursor_id, "subscription_id": cursor["subscription_id"], "attempts": attempts, "last_error": reason, "dead_lettered_at": self.clock()}])
        self._tell("dead_letter", parsed(event), reason)

    def _deliver(self, cursor: dict, event: dict, attempts: int) -> None:
        """Handles one event to its end: delivered, or a dead letter; the cursor then passes it."""
        tried = attempts > 0
        while True:
            if self.stopping.is_set() and attempts > 0:
                self._dead(cursor, event, attempts, SHUTDOWN)
                break
            try:
                self.handler(parsed(event))
                break
            except Exception as e:  # the handler is the user's
                attempts += 1
                self._tell("error", e, parsed(event))
                if attempts > self.max_retries:
                    self._dead(cursor, event, attempts, str(e))
                    break
                tried = True
                self.control.put_rows("attempts", [{"cursor_id": self.cursor_id, "event_id": event["event_id"], "attempts": attempts, "last_attempt_at": self.clock(), "last_error": str(e)}])
                wait = self.backoff_ms[min(attempts, len(self.backoff_ms)) - 1] if self.backoff_ms else 0
                self.stopping.wait(wait / 1000)
        if tried:
            self.control.put_rows("attempts", [{"cursor_id": self.cursor_id, "event_id": event["event_id"]}], gone=True)
        self._ack(cursor, event["event_id"])

    def drain(self) -> int:
        """Tries this cursor's letters whose replay is asked for, once each; the first failure ends it."""
        mine = self.control.read("dead_letters").where((F.col("cursor_id") == self.cursor_id) & F.col("replay_requested_at").isNotNull())
        done = 0
        for row in mine.orderBy("dl_id").toLocalIterator():
            if self.stopping.is_set():
                break
            letter = row.asDict()
            try:
                self.handler(parsed(letter))
            except Exception as e:  # the handler is the user's
                self._tell("error", e, parsed(letter))
                self.control.put_rows("dead_letters", [letter | {"attempts": letter["attempts"] + 1, "last_error": str(e), "replay_requested_at": None}])
                break
            self.control.put_rows("dead_letters", [letter], gone=True)
            done += 1
        return done

    def tick(self) -> int:
        """Replays, then one batch; the number of events passed. Errors of the poll go to on_error and wait for the next tick."""
        try:
            self.drain()
            if self.stopping.is_set():
                return 0
            cursors = self.control.read("cursors")
            rows = poll.poll_cursor(self.events(), cursors, self.control.read("subscriptions"), self.cursor_id, self.clock(), self.batch).collect()  # a batch
            cursor = poll.cursor_row(cursors, self.cursor_id)
            tries = {r["event_id"]: r["attempts"] for r in self.control.read("attempts").where(F.col("cursor_id") == self.cursor_id).collect()}  # events in work: one at most, but for a crash
        except Exception as e:
            self._tell("error", e, None)
            return 0
        passed = 0
        for row in rows:
            if self.stopping.is_set():
                break
            self._deliver(cursor, row.asDict(), tries.get(row["event_id"], 0))
            passed += 1
        return passed

    def lag(self) -> dict:
        """The cursor's lag, oldest unseen event's age and dead letters; told to on_lag."""
        mine = self.control.read("cursors").where(F.col("cursor_id") == self.cursor_id)
        row = inspect.cursor_lag(mine, self.events(), self.control.read("dead_letters"), self.clock()).first().asDict()
        self._tell("lag", row)
        return row

    def run(self, interval_ms: int = 15_000, lag_ms: int = 60_000) -> None:
        """Ticks until ``stop``."""
        told = self.clock()
        while not self.stopping.is_set():
            self.tick()
            if self.calls["lag"] is not None and self.clock() - told >= lag_ms:
                told = self.clock()
                self.lag()
            self.stopping.wait(interval_ms / 1000)


def iterate(control: ControlLog, events: Callable[[], DataFrame], cursor_id: str, now: Callable[[], int], batch: int = 100) -> Iterator[dict]:
    """The cursor's events until none is left, batch by batch: catch-up and tail in one. Each is acknowledged before it is handed on."""
    while True:
        cursors = control.read("cursors")
        rows = poll.poll_cursor(events(), cursors, control.read("subscriptions"), cursor_id, now(), batch).collect()  # a batch
        if not rows:
            return
        cursor = poll.cursor_row(cursors, cursor_id)
        for row in rows:
            cursor |= {"last_event_id": row["event_id"], "acked_at": now()}
            control.put_rows("cursors", [cursor])
            yield parsed(row.asDict())
