"""Logging of the engine: five levels, and an optional trace number that marks the lines of one request."""

from __future__ import annotations

import contextvars
import logging
from contextlib import contextmanager

NOTICE = 15
LEVELS = {"data": logging.CRITICAL, "error": logging.ERROR, "info": logging.INFO, "notice": NOTICE, "debug": logging.DEBUG}
logging.addLevelName(NOTICE, "NOTICE")
_trace: contextvars.ContextVar[int] = contextvars.ContextVar("trace", default=0)


class _Trace(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        record.trace = f"{_trace.get():016x}"
        return True


def logger(level: str = "error", handler: logging.Handler | None = None) -> logging.Logger:
    """The engine's logger at a level; handler: where its lines go (standard error by default)."""
    out = logging.getLogger("siltlog")
    out.setLevel(LEVELS[level])
    if handler is not None or not out.handlers:
        handler = handler or logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(trace)s %(levelname)s: %(message)s"))
        handler.addFilter(_Trace())
        out.addHandler(handler)
    return out


@contextmanager
def trace(number: int):
    """Lines logged inside carry this number."""
    token = _trace.set(number)
    try:
        yield
    finally:
        _trace.reset(token)
