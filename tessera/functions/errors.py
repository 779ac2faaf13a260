"""What the errors of an embedding service say: that a text is too long, that one should wait, that another try may do."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import TypeVar

from tessera.functions import constants as C

T = TypeVar("T")
#: Seconds to wait where the service limits the rate, and how often; tries of what may pass, each after twice its number of seconds.
WAIT, MOST_WAITS, TRIES = 5.0, 120, 3


def status_of(e: BaseException) -> int | None:
    """The HTTP status that an error, or the response in it, carries."""
    for holder in (e, getattr(e, "response", None)):
        found = getattr(holder, "status_code", None)
        if isinstance(found, int):
            return found
    return None


def _said(value: object) -> list[str]:
    if value is None:
        return []
    if isinstance(value, bytes):
        return [value.decode("utf-8", "replace")]
    if isinstance(value, dict):
        return [s for kv in value.items() for x in kv for s in _said(x)]
    if isinstance(value, (list, tuple, set, frozenset)):
        return [s for x in value for s in _said(x)]
    return [str(value)]


def words_of(e: BaseException) -> str:
    """All that an error says, in lower case: itself, its fields and its response."""
    out = [str(e)]
    for name in ("message", "code", "type", "body"):
        out += _said(getattr(e, name, None))
    answer = getattr(e, "response", None)
    for name in ("text", "content"):
        out += _said(getattr(answer, name, None))
    return " ".join(out).casefold()


def too_long(e: BaseException) -> bool:
    """A text is beyond the model's context. An embedding function without a service says so by a ValueError."""
    if status_of(e) is None:
        return isinstance(e, ValueError)
    said = words_of(e) if status_of(e) == 400 else ""
    return any(m in said for m in C.CONTEXT_MARKERS) or any(re.search(p, said) for p in C.CONTEXT_PATTERNS)


def limited(e: BaseException) -> bool:
    return status_of(e) == 429


def passing(e: BaseException) -> bool:
    """A failure of the service's own, which another try may not meet."""
    status = status_of(e)
    return (status is not None and 500 <= status < 600) or C.CRASH_MARKER in words_of(e)


def with_retries(call: Callable[[], T], sleep: Callable[[float], None] | None = None) -> T:
    """What the call gives: it waits out limits of the rate (for MOST_WAITS times; a task must not hang for ever), and tries
    passing failures again TRIES times; any other error is raised."""
    sleep = sleep or time.sleep
    waits = tries = 0
    while True:
        try:
            return call()
        except Exception as e:
            if limited(e) and waits < MOST_WAITS:
                waits += 1
                sleep(WAIT)
            elif not limited(e) and passing(e) and tries < TRIES:
                tries += 1
                sleep(2.0 * tries)
            else:
                raise
