"""Human-readable sizes."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# SI units count in thousands, IEC units in 1024ths; a bare letter is an SI unit.
SI = {"": 1, "b": 1, "k": 10**3, "kb": 10**3, "m": 10**6, "mb": 10**6, "g": 10**9, "gb": 10**9, "t": 10**12, "tb": 10**12, "p": 10**15, "pb": 10**15, "e": 10**18, "eb": 10**18}
IEC = {"ki": 1 << 10, "kib": 1 << 10, "mi": 1 << 20, "mib": 1 << 20, "gi": 1 << 30, "gib": 1 << 30, "ti": 1 << 40, "tib": 1 << 40, "pi": 1 << 50, "pib": 1 << 50, "ei": 1 << 60, "eib": 1 << 60}
IEC_NAMES = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
_SIZE = re.compile(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+) ?([A-Za-z]*)")


def parse_size(text: str) -> int:
    """Bytes of a size such as 100, 1.5M or 2GiB; a ValueError for anything else or beyond 2**63 - 1."""
    match = _SIZE.fullmatch(text.strip())
    unit = match and (SI | IEC).get(match[2].lower())
    if not unit:
        raise ValueError(f"invalid size {text!r}")
    size = int(Decimal(match[1]) * unit)
    if size >= 1 << 63:
        raise ValueError(f"size {text!r} is too large")
    return size


def format_bytes(n: Column) -> Column:
    """IEC text of a count: one decimal below ten, none above (halves to even)."""
    power = F.lit(0)
    for k in range(1, len(IEC_NAMES)):
        power = F.when(n >= F.lit(1 << 10 * k), k).otherwise(power)
    value = F.floor(n.cast("double") / F.pow(F.lit(1024.0), power) * 10 + 0.5) / 10
    name = F.element_at(F.array(*map(F.lit, IEC_NAMES)), power + 1)
    return F.when(n < 10, F.concat(n.cast("string"), F.lit(" B"))).when(value < 10, F.format_string("%.1f %s", value, name)).otherwise(F.format_string("%.0f %s", F.rint(value), name))


def format_bytes_py(n: int) -> str:
    if n < 10:
        return f"{n} B"
    power = min((n.bit_length() - 1) // 10, len(IEC_NAMES) - 1)
    value = int(n / 1024**power * 10 + 0.5) / 10
    return f"{value:.1f} {IEC_NAMES[power]}" if value < 10 else f"{value:.0f} {IEC_NAMES[power]}"
