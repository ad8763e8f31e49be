"""ISBN ranges as disjoint sorted intervals of nine-digit numbers, searched by halves."""

from __future__ import annotations

import bisect
from functools import cache
from typing import NamedTuple

DIGITS = 9


class Interval(NamedTuple):
    low: int
    high: int
    group: int  # digits of the group
    prefix: int  # digits of group and registrant
    ord: int  # the range's place in the table


def bounds(begin: str, end: str) -> tuple[int, int]:
    """The first and last nine digits with a prefix from begin to end."""
    return int(begin.replace("-", "").ljust(DIGITS, "0")), int(end.replace("-", "").ljust(DIGITS, "9"))


@cache
def index(ranges: tuple[tuple[str, str], ...]) -> list[Interval]:
    """The ranges cut where they overlap: a number belongs to the first range of the table that holds it."""
    out: list[Interval] = []
    for k, (begin, end) in enumerate(ranges):
        low, high = bounds(begin, end)
        size = (len(begin.split("-")[0]), len(begin.replace("-", "")))
        at = bisect.bisect_left(out, (low,))
        if at and out[at - 1].high >= low:
            at -= 1
        free, j = [], at
        while j < len(out) and out[j].low <= high:
            if low < out[j].low:
                free.append(Interval(low, out[j].low - 1, *size, k))
            low = max(low, out[j].high + 1)
            j += 1
        if low <= high:
            free.append(Interval(low, high, *size, k))
        out[at:j] = sorted([*out[at:j], *free])
    return out


def find(ranges: tuple[tuple[str, str], ...], ten: str) -> Interval | None:
    """The interval of a number's first nine digits."""
    if not ten[:DIGITS].isdigit():
        return None
    found, key = index(ranges), int(ten[:DIGITS].ljust(DIGITS, "0"))
    at = bisect.bisect_right(found, (key, 1 << 60)) - 1
    return found[at] if at >= 0 and key <= found[at].high else None
