"""Every valid reading of one written time, as (notation, microseconds since 1970 UTC)."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

_EPOCH = datetime(1970, 1, 1)
_UTC = timezone.utc
_MICRO = timedelta(microseconds=1)

# Minutes east of UTC of the zone abbreviations used by the outlets' zones, and of UTC's own names.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "PST": -480, "PDT": -420,
    "BST": 60, "CET": 60, "CEST": 120, "JST": 540, "IST": 330, "AEST": 600, "AEDT": 660,
}
#: Generic names stand for a wall clock, which may be skipped or repeated.
CLOCKS = {"ET": "America/New_York"}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_TAIL = r"\s*(?P<tail>[A-Za-z+\-\[].*)?"
_DOW = r"(?:[A-Za-z]{3,9}\.?,?\s+)?"
_SHAPES = tuple(
    (name, re.compile(pattern))
    for name, pattern in (
        ("iso", rf"(?P<y>\d{{4}})-(?P<m>\d\d?)-(?P<d>\d\d?)(?:(?:[Tt]|\s+){_TIME})?{_TAIL}"),
        ("basic", rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)[Tt ](?P<h>\d\d)(?P<mi>\d\d)(?:(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?{_TAIL}"),
        ("ymd_slash", rf"(?P<y>\d{{4}})/(?P<m>\d\d?)/(?P<d>\d\d?)(?:,?\s+{_TIME})?{_TAIL}"),
        ("mdy_slash", rf"(?P<m>\d\d?)/(?P<d>\d\d?)/(?P<y>\d{{4}})(?:,?\s+{_TIME})?{_TAIL}"),
        ("dmy_dot", rf"(?P<d>\d\d?)\.(?P<m>\d\d?)\.(?P<y>\d{{4}})(?:,?\s+{_TIME})?{_TAIL}"),
        ("ymd_dot", rf"(?P<y>\d{{4}})\.(?P<m>\d\d?)\.(?P<d>\d\d?)(?:,?\s+{_TIME})?{_TAIL}"),
        ("day_month", rf"{_DOW}(?P<d>\d\d?)[ -](?P<mon>[A-Za-z]{{3,9}})\.?,?[ -](?P<y>\d{{4}})(?:,?\s+(?:at\s+)?{_TIME})?{_TAIL}"),
        ("month_day", rf"{_DOW}(?P<mon>[A-Za-z]{{3,9}})\.?\s+(?P<d>\d\d?)(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:,?\s+(?:at\s+)?{_TIME})?{_TAIL}"),
    )
)
_DAY_FIRST = re.compile(rf"(?P<d>\d\d?)/(?P<m>\d\d?)/(?P<y>\d{{4}})(?:,?\s+{_TIME})?{_TAIL}")
_DIGITS = re.compile(r"(\d+)(?:\.(\d+))?")
_OFFSET = re.compile(r"([+-])(\d\d):?(\d\d)?(?:\s*\[[^\]]*\])?")
_ZONE = re.compile(r"\[?([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+)\]?")
_MONTHS = {name[:n].lower(): i for i, name in enumerate(calendar.month_name) if i for n in range(3, len(name) + 1)} | {"sept": 9}
#: Plain digits count from 1970 only where that gives one of these years.
EPOCH_YEARS = (1990, 2100)
#: Plain digits are a written date only where they start with one of these years.
WRITTEN_YEARS = (1900, 2100)


@lru_cache(512)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _micros(local: datetime) -> int:
    return (local - _EPOCH) // _MICRO


def on_clock(local: datetime, zone: str | None) -> int | None:
    """The instant a wall clock showed this; None where the zone is unknown, or its clock skipped or repeated it."""
    z = _zone(zone) if zone else None
    if z is None:
        return None
    try:
        first = local.replace(tzinfo=z).utcoffset()
        if first != local.replace(tzinfo=z, fold=1).utcoffset():
            return None
        return _micros(local - first)
    except OverflowError:
        return None


def _at(local: datetime, dated: bool, tail: str | None, zone: str | None) -> int | None:
    tail = (tail or "").strip()
    if not tail:
        return _micros(local) if dated else on_clock(local, zone)
    if dated:
        return None
    if m := _OFFSET.fullmatch(tail):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return None if minutes > 18 * 60 or int(m[3] or 0) > 59 else _micros(local) - (minutes if m[1] == "+" else -minutes) * 60_000_000
    name = tail.strip("[]()").upper()
    if name in ABBREVIATIONS:
        return _micros(local) - ABBREVIATIONS[name] * 60_000_000
    if name in CLOCKS:
        return on_clock(local, CLOCKS[name])
    if m := _ZONE.fullmatch(tail):
        return on_clock(local, m[1])
    return None


def _read(g: dict, zone: str | None) -> int | None:
    """One match as an instant; fractions beyond microseconds are dropped."""
    month = _MONTHS.get(g["mon"].lower()) if g.get("mon") else int(g["m"])
    hour, half = int(g.get("h") or 0), (g.get("ap") or "").lower()
    if month is None or half and not 1 <= hour <= 12:
        return None
    if half:
        hour = hour % 12 + 12 * (half == "p")
    try:
        local = datetime(int(g["y"]), month, int(g["d"]), hour, int(g.get("mi") or 0), int(g.get("s") or 0), int(((g.get("f") or "") + "000000")[:6]))
    except ValueError:
        return None
    return _at(local, g.get("h") is None, g.get("tail"), zone)


def _digits(value: str, fraction: str | None, zone: str | None) -> list[tuple[str, int]]:
    out = []
    n = len(value)
    if fraction is None and n in (8, 10, 12, 14):
        parts = dict(zip(("y", "m", "d", "h", "mi", "s"), (value[:4], value[4:6], value[6:8], value[8:10] or None, value[10:12] or None, value[12:14] or None)))
        if WRITTEN_YEARS[0] <= int(value[:4]) < WRITTEN_YEARS[1] and (us := _read(parts, zone)) is not None:
            out.append((f"digits_{n}", us))
    for name, scale in (("epoch_s", 1_000_000), ("epoch_ms", 1_000), ("epoch_us", 1), ("epoch_ns", 0)):
        if n > 20 or fraction and name != "epoch_s":
            continue
        us = int(value) * scale if scale else int(value) // 1000
        if fraction:
            us += int((fraction + "000000")[:6])
        if EPOCH_YEARS[0] <= 1970 + us / 31_556_952_000_000 < EPOCH_YEARS[1]:
            out.append((name, us))
    return out


def interpretations(value: str | None, zone: str | None = None, slashes: str = "mdy") -> list[tuple[str, int]]:
    """All valid readings of a written time.

    A time without zone is read on `zone`'s wall clock and has no reading where that is unknown, or where the clock
    skipped or repeated it. A date alone is 00:00 UTC. `slashes` is "mdy", "dmy" or "both" for dates such as 03/04/2024.
    Null, blank, impossible and relative times have no reading. A date such as 04/04/2024 has both notations and one instant.
    """
    value = (value or "").strip()
    if not value:
        return []
    if m := _DIGITS.fullmatch(value):
        return _digits(m[1], m[2], zone)
    out = []
    for name, shape in _SHAPES:
        if m := shape.fullmatch(value):
            if name != "mdy_slash" or slashes != "dmy":
                if (us := _read(m.groupdict(), zone)) is not None:
                    out.append((name, us))
            if name == "mdy_slash" and slashes != "mdy":
                m = _DAY_FIRST.fullmatch(value)
                if m and (us := _read(m.groupdict(), zone)) is not None:
                    out.append(("dmy_slash", us))
            break
    return out


def iso(us: int) -> str:
    """`YYYY-MM-DDThh:mm:ss.ffffffZ`."""
    t = _EPOCH + timedelta(microseconds=us)
    return t.isoformat(timespec="microseconds") + "Z"
