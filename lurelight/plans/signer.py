"""Signed notes for the queries and tests: keys and signatures by rule, not secret."""

from __future__ import annotations

import base64
import hashlib

from ..functions import signing
from ..sources.checkpoints import tree_head


def _tlv(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x81" + bytes([len(body)])) + body


def _int(x: int) -> bytes:
    return _tlv(2, x.to_bytes(x.bit_length() // 8 + 1, "big"))


def secret(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest(), "big") % (signing.N - 1) + 1


def spki(name: str) -> bytes:
    x, y = signing.combined(secret(name), 0, signing.G)
    point = b"\0\4" + x.to_bytes(32, "big") + y.to_bytes(32, "big")
    return _tlv(0x30, _tlv(0x30, _tlv(6, signing.EC_KEY), _tlv(6, signing.P_256)), _tlv(3, point))


def pair(message: bytes, name: str) -> tuple[int, int]:
    d, h = secret(name), hashlib.sha256(message).digest()
    k = int.from_bytes(hashlib.sha256(d.to_bytes(32, "big") + h).digest(), "big") % (signing.N - 1) + 1
    r = signing.combined(k, 0, signing.G)[0] % signing.N
    return r, pow(k, -1, signing.N) * (int.from_bytes(h, "big") + r * d) % signing.N


def note(name: str, size: int, form: str = "der", stamp: int = 1_700_000_000_000) -> str:
    """A note of a tree, signed by the key of the name in one of the three forms."""
    root = hashlib.sha256(f"{name}:{size}".encode()).digest()
    body = f"{name}\n{size}\n{base64.b64encode(root).decode()}\n\n"
    signed = tree_head(stamp, size, root) if form == "head" else body.encode()
    r, s = pair(signed, name)
    der = _tlv(0x30, _int(r), _int(s))
    given = {"der": der, "raw": r.to_bytes(32, "big") + s.to_bytes(32, "big"), "head": stamp.to_bytes(8, "big") + b"\4\3" + len(der).to_bytes(2, "big") + der}[form]
    return f"{body}— {name} {base64.b64encode(b'hint' + given).decode()}\n"
