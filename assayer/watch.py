"""Repeats a validation whenever its file has changed and stopped changing."""

from __future__ import annotations

import os
import time
from collections.abc import Callable


def state_of(path: str) -> tuple[int, int] | None:
    """Time of change and size; of a folder, of all its files together."""
    try:
        if os.path.isdir(path):
            stats = [e.stat() for e in os.scandir(path) if e.is_file()]
            return max((s.st_mtime_ns for s in stats), default=0), sum(s.st_size for s in stats)
        s = os.stat(path)
        return s.st_mtime_ns, s.st_size
    except FileNotFoundError:
        return None


def watch(path: str, run: Callable[[], None], every: float = 0.5, waiting: Callable[[], None] = lambda: None, stop: Callable[[], bool] = lambda: False) -> None:
    """Calls ``run`` once, then after every change that a further look finds finished."""
    seen = state_of(path)
    run()
    waiting()
    changing = None
    while not stop():
        time.sleep(every)
        now = state_of(path)
        if now is None or now == seen:
            changing = None
        elif now == changing:
            seen, changing = now, None
            run()
            waiting()
        else:
            changing = now
