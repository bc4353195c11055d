"""Budgets, sizes and durations as people write them."""

from __future__ import annotations

_UNITS = (("GB", 1 << 30, 2), ("MB", 1 << 20, 1), ("KB", 1 << 10, 0))


def memory_budget(text: str, size: int) -> int | None:
    """Bytes of an index of ``size`` that may be held; None is no limit."""
    t = text.strip().lower()
    if t in ("unlimited", "100%"):
        return None

    def number(s: str) -> float | None:
        try:
            return float(s.strip())
        except ValueError:
            return None

    if t.endswith("%"):
        share = number(t[:-1])
        share = 100.0 if share is None else share
        return None if share >= 100 else int(size * share / 100)
    for unit, factor, _ in _UNITS:
        if t.endswith(unit.lower()):
            return int((number(t[:-2]) or 0) * factor) or None
    return int(number(t) or 0) or None


def size(n: int, space: str = " ") -> str:
    for unit, factor, digits in _UNITS:
        if n >= factor:
            return f"{n / factor:.{digits}f}{space}{unit}"
    return f"{n}{space}B"


def duration(seconds: int) -> str:
    minutes, s = divmod(seconds, 60)
    hours, m = divmod(minutes, 60)
    days, h = divmod(hours, 24)
    if days >= 60:
        return f"{days // 30}mo" + (f" {days % 30}d" if days % 30 else "")
    if days:
        return f"{days}d {h}h"
    if hours:
        return f"{h}h {m}m {s}s"
    return f"{m}m {s}s" if minutes else f"{s}s"
