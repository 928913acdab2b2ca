"""Canonical JSON, digests and Ed25519 signatures (RFC 8032) in plain Python.

Keys stay on the driver. Signatures of many records are verified on executors by
verify_column(), one to three milliseconds each, as tables of the few keys are kept; a batch's distinct triples are checked once.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.canonical import canonical_column  # noqa: F401

# The curve of RFC 8032.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)


def sha256(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def canonical(value: Any) -> str:
    """Sorted keys, no spaces, ASCII only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def canonical_hash(value: Any) -> str:
    return sha256(canonical(value))


def _add(p: tuple, q: tuple) -> tuple:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p = _add(p, p)
        n >>= 1
    return out


@functools.lru_cache(maxsize=16)
def _table(p: tuple) -> list[list[tuple]]:
    """p times each digit of each hexadecimal place."""
    rows = []
    for _ in range(64):
        row = [(0, 1, 1, 0)]
        for _ in range(15):
            row.append(_add(row[-1], p))
        rows.append(row)
        p = _add(row[-1], p)
    return rows


def _times_known(n: int, p: tuple) -> tuple:
    """As _times() for a point that comes again and again, by its table: 64 additions."""
    out = (0, 1, 1, 0)
    for row in _table(p):
        out = _add(out, row[n & 15])
        n >>= 4
    return out


def _x(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    if not square:
        return None if sign else 0
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P:
        return None
    return P - x if x & 1 != sign else x


_BY = 4 * pow(5, P - 2, P) % P
_BX = _x(_BY, 0)
BASE = (_BX, _BY, 1, _BX * _BY % P)


def _pack(p: tuple) -> bytes:
    z = pow(p[2], P - 2, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(s: bytes) -> tuple | None:
    y = int.from_bytes(s, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    x = _x(y, sign)
    return None if x is None else (x, y, 1, x * y % P)


def _mod(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


@dataclass(frozen=True)
class KeyPair:
    secret: bytes

    @classmethod
    def new(cls) -> KeyPair:
        return cls(os.urandom(32))

    def _expanded(self) -> tuple[int, bytes]:
        h = hashlib.sha512(self.secret).digest()
        a = int.from_bytes(h[:32], "little")
        return a & (1 << 254) - 8 | 1 << 254, h[32:]

    @property
    def public(self) -> bytes:
        return _pack(_times(self._expanded()[0], BASE))

    def sign(self, message: bytes) -> bytes:
        a, prefix = self._expanded()
        r = _mod(prefix, message)
        point = _pack(_times(r, BASE))
        return point + ((r + _mod(point, self.public, message) * a) % ORDER).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    # keys are few and their signatures many
    left, right = _times_known(s, BASE), _add(r, _times_known(_mod(signature[:32], public, message), a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


def verify_hex(public: str, message: bytes, signature: str) -> bool:
    try:
        return verify(bytes.fromhex(public), message, bytes.fromhex(signature))
    except (ValueError, TypeError):
        return False


def verify_column(public: Column | str, message: Column | str, signature: Column | str) -> Column:
    """Whether each signature (hex) of a text is valid."""

    @F.pandas_udf("boolean")
    def check(k: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        seen: dict[tuple, bool] = {}
        out = []
        for t in zip(k, m, s):
            if t not in seen:
                seen[t] = None not in t and verify_hex(t[0], t[1].encode(), t[2])
            out.append(seen[t])
        return pd.Series(out, dtype=bool)

    return check(public, message, signature)
