"""Canonical JSON, digests and ids, for provenance records on the driver."""

from __future__ import annotations

import hashlib
import json
import math
import secrets
import time
from pathlib import Path

# The alphabet of ULIDs, and how many digits numbered ids have at least.
_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
ID_DIGITS = 3


class HashingError(ValueError):
    """An object without one canonical form."""


def _check(x: object) -> None:
    if isinstance(x, float) and not math.isfinite(x):
        raise HashingError("NaN and infinities have no JSON form")
    if isinstance(x, dict):
        for k, v in x.items():
            if not isinstance(k, str):
                raise HashingError(f"key {k!r} is not a string")
            _check(v)
    elif isinstance(x, (list, tuple)):
        for v in x:
            _check(v)
    elif x is not None and not isinstance(x, (str, int, float, bool)):
        raise HashingError(f"{type(x).__name__} has no canonical form")


def canonical_json(x: object) -> str:
    """Sorted keys, no spaces, all characters as they are; the same object gives the same text."""
    _check(x)
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def sha256_canonical(x: object) -> str:
    return hashlib.sha256(canonical_json(x).encode()).hexdigest()


def sha256_bytes(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def new_ulid(at_ms: int | None = None) -> str:
    """26 characters that sort by time: 48 bits of milliseconds, 80 random ones."""
    value = (at_ms if at_ms is not None else time.time_ns() // 10**6) << 80 | secrets.randbits(80)
    return "".join(_CROCKFORD[value >> 5 * k & 31] for k in range(25, -1, -1))


def new_id(prefix: str) -> str:
    """prefix-ULID: ids of one prefix sort by the time they were made."""
    return f"{prefix}-{new_ulid()}"


def sequential_id(prefix: str, taken: list[str], width: int = ID_DIGITS) -> str:
    """The next of prefix-001, prefix-002, ...; ids of another form are refused."""
    numbers = []
    for x in taken:
        head, _, tail = x.rpartition("-")
        if head != prefix or not tail.isdigit():
            raise ValueError(f"{x!r} is not an id of {prefix!r}")
        numbers.append(int(tail))
    return f"{prefix}-{max(numbers, default=0) + 1:0{width}d}"
