"""Durations such as ``1h30m``: parsing to seconds and back."""

from __future__ import annotations

import re

#: Seconds in each unit, longest first.
UNITS = {"w": 604800.0, "d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "μs": 1e-6, "ns": 1e-9}


def parse_duration(text: str) -> float:
    """Seconds of a compound duration; each unit may occur once."""
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*(ns|us|μs|ms|[wdhms])", text.strip().strip("\"'"))
    if not parts or re.sub(r"(\d+(?:\.\d+)?)\s*(ns|us|μs|ms|[wdhms])|\s", "", text.strip().strip("\"'")):
        raise ValueError(f"not a duration: {text!r}")
    units = [u for _, u in parts]
    if len(set(units)) < len(units):
        raise ValueError(f"a unit is given twice: {text!r}")
    return sum(float(n) * UNITS[u] for n, u in parts)


def is_duration(text: str) -> bool:
    try:
        parse_duration(text)
    except ValueError:
        return False
    return True


def format_duration(seconds: float) -> str:
    """The shortest compound of whole units; what is left below a second in milli-, micro- and nanoseconds."""
    left, out = round(seconds * 1e9), []
    for unit in ("w", "d", "h", "m", "s", "ms", "us", "ns"):
        size = round(UNITS[unit] * 1e9)
        n, left = divmod(left, size)
        if n:
            out.append(f"{n}{unit}")
    return "".join(out) or "0s"
