"""Ed25519 signatures (RFC 8032) for checkpoints: a handful of signatures on the driver."""

from __future__ import annotations

import hashlib

P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
_ROOT = pow(2, (P - 1) // 4, P)


def _recover(y: int, sign: int) -> int | None:
    x2 = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(x2, (P + 3) // 8, P)
    if (x * x - x2) % P:
        x = x * _ROOT % P
    if (x * x - x2) % P or (x == 0 and sign):
        return None
    return P - x if x & 1 != sign else x


_BY = 4 * pow(5, P - 2, P) % P
_BX = _recover(_BY, 0)
BASE = (_BX, _BY, 1, _BX * _BY % P)


def _add(a, b):
    e, f = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    c, d = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    h, g, j, k = f - e, d - c, d + c, f + e
    return (h * g % P, j * k % P, g * j % P, h * k % P)


def _times(n: int, point):
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, point)
        point = _add(point, point)
        n >>= 1
    return out


def _pack(point) -> bytes:
    z = pow(point[2], P - 2, P)
    return (point[1] * z % P | (point[0] * z % P & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes):
    n = int.from_bytes(data, "little")
    y = n & (1 << 255) - 1
    x = _recover(y, n >> 255) if y < P else None
    return None if x is None else (x, y, 1, x * y % P)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % L


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    key = _pack(_times(a, BASE))
    r = _hash(prefix, message)
    point = _pack(_times(r, BASE))
    return point + ((r + _hash(point, key, message) * a) % L).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(key), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    left, right = _times(s, BASE), _add(r, _times(_hash(signature[:32], key, message), a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0
