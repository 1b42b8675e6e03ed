"""The causality context of a process: nested, and passed on in the environment."""

from __future__ import annotations

import contextlib
import contextvars
import os
from collections.abc import Iterator, Mapping

FIELDS = ("correlation_id", "session_id", "producer_id", "parent_event_id")
VARIABLE = "TIDELOG_"
_context: contextvars.ContextVar[Mapping] = contextvars.ContextVar("causality", default={})


def current() -> dict:
    """The innermost context's fields, or those of the environment."""
    found = dict(_context.get())
    for f in FIELDS:
        if f not in found and (v := os.environ.get(VARIABLE + f.upper())):
            found[f] = int(v) if f == "parent_event_id" else v
    return found


@contextlib.contextmanager
def causing(**fields) -> Iterator[dict]:
    """A context whose fields lie over the outer one's; it ends with the block and does not leak."""
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    token = _context.set({**_context.get(), **fields})
    try:
        yield current()
    finally:
        _context.reset(token)


def emitted(event_id: int) -> None:
    """Makes an event the parent of the next one in this context."""
    if _context.get():
        _context.set({**_context.get(), "parent_event_id": event_id})


def environment() -> dict[str, str]:
    """Variables that hand the context to a child process."""
    return {VARIABLE + k.upper(): str(v) for k, v in current().items() if v is not None}


def stamped(event: dict) -> dict:
    """An event with the context's fields where it names none; a null it names stays."""
    return {**current(), **event}
