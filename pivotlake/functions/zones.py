"""UTC timestamps in a configured zone, as ISO text and as readable text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The default zone, its offset, and the name shown for it.
DEFAULT_ZONE = "Asia/Kolkata"
DEFAULT_OFFSET = "+05:30"
DEFAULT_LABEL = "IST"

_OFFSET = re.compile(r"^(?:UTC)?\s*([+-]?)(\d{1,2})(?::?(\d{2}))?$", re.IGNORECASE)


def parse_zone(name: str | None) -> tuple[str, str]:
    """(offset, label) of a zone setting; unknown names fall back to the default."""
    text = (name or "").strip()
    if text.upper() in ("UTC", "GMT", "Z"):
        return "+00:00", "UTC"
    if not text or text == DEFAULT_ZONE or text.upper() == DEFAULT_LABEL:
        return DEFAULT_OFFSET, DEFAULT_LABEL
    found = _OFFSET.match(text)
    if not found or int(found[2]) >= 24 or int(found[3] or 0) >= 60:
        return DEFAULT_OFFSET, DEFAULT_LABEL
    offset = f"{found[1] or '+'}{int(found[2]):02d}:{int(found[3] or 0):02d}"
    if offset[1:] == "00:00":
        return "+00:00", "UTC"
    return offset, "UTC" + offset


def local_time(col: Column, zone: str | None = None) -> Column:
    """A zone-free UTC timestamp moved to the zone."""
    offset, _ = parse_zone(zone)
    return F.convert_timezone(F.lit("UTC"), F.lit(offset), col.cast("timestamp_ntz"))


def iso_text(col: Column, zone: str | None = None) -> Column:
    """ISO text with the offset; fractions only where there are any; null is empty."""
    offset, _ = parse_zone(zone)
    local = local_time(col, zone)
    whole = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(local, ".SSSSSS")
    text = F.concat(whole, F.when(fraction == ".000000", F.lit("")).otherwise(fraction), F.lit(offset))
    return F.coalesce(text, F.lit(""))


def readable_text(col: Column, zone: str | None = None) -> Column:
    """Text such as ``05 Jan 2024, 13:45:00 IST``; null is empty."""
    _, label = parse_zone(zone)
    text = F.concat(F.date_format(local_time(col, zone), "dd MMM yyyy, HH:mm:ss"), F.lit(f" {label}"))
    return F.coalesce(text, F.lit(""))
