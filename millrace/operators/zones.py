"""Versioned zone transition tables, built once on the driver for a bounded list of zones."""

from __future__ import annotations

import zoneinfo
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from importlib import metadata
from pathlib import Path

import numpy as np

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def tz_version() -> str:
    """Name of the time-zone release in use, kept with every table."""
    for root in zoneinfo.TZPATH:
        at = Path(root, "tzdata.zi")
        if at.exists():
            return at.open().readline().split()[-1]
    try:
        return metadata.version("tzdata")
    except metadata.PackageNotFoundError:
        return "unknown"


@dataclass(frozen=True)
class ZoneTable:
    """Local second from which an offset holds, and the offsets (seconds east), one more than the bounds.

    The bounds are in wall time and read every wall time that occurs twice as the earlier
    instant and every skipped one with the offset in force before the change.
    """

    zone: str
    version: str
    bounds: np.ndarray
    offsets: np.ndarray
    standard: int
    summer: int

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        """UTC seconds of wall seconds."""
        return wall - self.offsets[np.searchsorted(self.bounds, wall, side="right")]


def zone_table(name: str, first_year: int = 1900, last_year: int = 2100) -> ZoneTable:
    """Find the changes of offset by daily steps and bisection; any release of the database will do."""
    zone = zoneinfo.ZoneInfo(name)

    def offset(sec: int) -> int:
        return int((EPOCH + timedelta(seconds=sec)).astimezone(zone).utcoffset().total_seconds())

    at = int((datetime(first_year, 1, 2, tzinfo=timezone.utc) - EPOCH).total_seconds())
    end = int((datetime(last_year, 1, 1, tzinfo=timezone.utc) - EPOCH).total_seconds())
    day, now = 86400, offset(at)
    bounds, offsets = [], [now]
    while at < end:
        nxt = at + day
        if (o := offset(nxt)) != now:
            lo, hi = at, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if offset(mid) == now else (lo, mid)
            bounds.append(hi + max(now, o))
            offsets.append(o)
            now = o
        at = nxt
    year = [datetime(2024, m, 15, tzinfo=zone) for m in range(1, 13)]
    std = [int(d.utcoffset().total_seconds()) for d in year if not d.dst()]
    dst = [int(d.utcoffset().total_seconds()) for d in year if d.dst()]
    standard = std[0] if std else now
    return ZoneTable(name, tz_version(), np.array(bounds, np.int64), np.array(offsets, np.int64), standard, dst[0] if dst else standard)
