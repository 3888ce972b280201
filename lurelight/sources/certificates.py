"""Names of DER certificates and entries of log tiles, in Arrow batches.

Spark has no expression for DER. The reader follows tags and lengths only as far
as subject, validity and alternative names; what it cannot read is null. Columns
are read as a whole by ``columnar``; ``certificate`` and ``tile_records`` read
single rows, those that the former leaves, and are what the tests hold it to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar

FIELDS = "dns_names array<string>, common_name string, not_before string, issuer_aggregated string, cert_fingerprint string, cert_serial string, cert_issuer_dn_sha256 string"
#: What is read from the bytes; the two digests are computed from columns.
READ = ["dns_names", "common_name", "not_before", "issuer_aggregated", "cert_serial"]
_NAMES = {b"\x55\x04\x03": "CN", b"\x55\x04\x06": "C", b"\x55\x04\x07": "L", b"\x55\x04\x08": "ST", b"\x55\x04\x0a": "O", b"\x55\x04\x0b": "OU"}
_ALT_NAMES = b"\x55\x1d\x11"


def _read(b: bytes, at: int) -> tuple[int, int, int]:
    """(tag, start, end) of the element at ``at``."""
    tag, n, start = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        n, start = int.from_bytes(b[start : start + k], "big"), start + k
    if start + n > len(b):
        raise ValueError("cut short")
    return tag, start, start + n


def _children(b: bytes, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    while start < end:
        tag, s, e = _read(b, start)
        yield tag, s, e, start
        start = e


def _name(b: bytes, start: int, end: int) -> list[tuple[str, str]]:
    out = []
    for _, s, e, _ in _children(b, start, end):
        for _, s2, e2, _ in _children(b, s, e):
            (_, a, z, _), (_, v, w, _) = list(_children(b, s2, e2))[:2]
            out.append((_NAMES.get(b[a:z], b[a:z].hex()), b[v:w].decode("utf-8", "replace")))
    return out


def _host(raw: str) -> str:
    host = raw.strip().lower()
    host = host[2:] if host.startswith("*.") else host
    return host[:-1] if host.endswith(".") else host


def certificate(der: bytes | None) -> dict | None:
    """The fields above, or null where the bytes are no certificate with names."""
    try:
        _, s, e = _read(der, 0)
        _, s, e = _read(der, s)
        parts = list(_children(der, s, e))
        i = 1 if parts[0][0] == 0xA0 else 0
        serial, issuer, validity, subject = parts[i], parts[i + 2], parts[i + 3], parts[i + 4]
        names: list[str] = []
        for tag, a, z, _ in parts[i + 6 :]:
            if tag != 0xA3:
                continue
            _, a, z = _read(der, a)
            for _, x, y, _ in _children(der, a, z):
                inner = list(_children(der, x, y))
                if der[inner[0][1] : inner[0][2]] == _ALT_NAMES:
                    _, g, h = _read(der, inner[-1][1])
                    names += [der[p:q].decode("latin-1") for t, p, q, _ in _children(der, g, h) if t == 0x82]
        cn = next((v for k, v in _name(der, subject[1], subject[2]) if k == "CN"), None)
        cn = _host(cn) if cn else None
        hosts = list(dict.fromkeys(h for h in [*(x for x in map(_host, names) if "." in x), cn] if h))
        if not hosts:
            return None
        tag, a, z, _ = next(_children(der, validity[1], validity[2]))
        at = datetime.strptime(der[a:z].decode(), "%y%m%d%H%M%SZ" if tag == 0x17 else "%Y%m%d%H%M%SZ").replace(tzinfo=UTC)
        said = "\n".join(f"{k}={v}" for k, v in _name(der, issuer[1], issuer[2]))
        return {
            "dns_names": hosts,
            "common_name": cn or hosts[0],
            "not_before": at.strftime("%Y-%m-%dT%H:%M:%S.000Z"),
            "issuer_aggregated": said,
            "cert_fingerprint": hashlib.sha256(der).hexdigest(),
            "cert_serial": der[serial[1] : serial[2]].hex().upper().removeprefix("00") or "00",
            "cert_issuer_dn_sha256": hashlib.sha256(said.encode()).hexdigest(),
        }
    except (ValueError, IndexError, TypeError, StopIteration):
        return None


def _issuer(name: bytes) -> str | None:
    try:
        return "\n".join(f"{k}={v}" for k, v in _name(name, 0, len(name)))
    except (ValueError, IndexError):
        return None


def read_column(column: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """(rows with names, the columns ``READ`` of these): most rows together, those
    that the columnar reader leaves one by one."""
    rows, left, fields = columnar.certificates(column, _issuer)
    one = [(i, c) for i in left.tolist() if column[i].is_valid and (c := certificate(column[i].as_py()))]
    if not one:
        return rows, [fields[n] for n in READ]
    rows = np.concatenate([rows, [i for i, _ in one]])
    order = pa.array(np.argsort(rows))
    more = {n: pa.array([c[n] for _, c in one], fields[n].type) for n in READ}
    return np.sort(rows), [pa.concat_arrays([fields[n], more[n]]).take(order) for n in READ]


def with_names(rows: DataFrame, der: str = "der") -> DataFrame:
    """``rows`` with the certificates' fields; those without names are left out.
    The digests are the JVM's."""
    i, kept = rows.columns.index(der), rows.columns

    def run(batches):
        for whole in batches:
            for lo, hi in columnar.slices(whole.column(i)):
                b = whole.slice(lo, hi - lo)
                found, fields = read_column(b.column(i))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(found)).columns, *fields], names=[*kept, *READ])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    got = rows.mapInArrow(run, f"{ddl}, " + ", ".join(f for f in FIELDS.split(", ") if f.split()[0] in READ))
    got = got.withColumns({"cert_fingerprint": F.sha2(F.col(f"`{der}`"), 256), "cert_issuer_dn_sha256": F.sha2("issuer_aggregated", 256)})
    return got.select(*(f"`{c}`" for c in kept), *(c.split()[0] for c in FIELDS.split(", ")))


def tile_records(tile: bytes) -> Iterator[tuple[int, int, str, bytes | None]]:
    """(place, timestamp_ms, entry type, DER) of a data tile's records; a cut or
    unknown record ends the tile."""
    at, place, n = 0, 0, len(tile)
    u = lambda i, k: int.from_bytes(tile[i : i + k], "big")

    def skip(i: int, width: int) -> int:
        return i + width + u(i, width) if i + width <= n else i

    while at + 10 <= n:
        stamp, kind, at = int.from_bytes(tile[at : at + 8], "big", signed=True), u(at + 8, 2), at + 10
        if kind not in (0, 1):
            return
        if kind == 1:
            at += 32
        if at + 3 > n or at + 3 + u(at, 3) > n:
            return
        body = tile[at + 3 : at + 3 + u(at, 3)]
        at = skip(at + 3 + len(body), 2)  # extensions
        der = body if kind == 0 else None
        if kind == 1 and at + 3 <= n:  # the whole precertificate
            size, at = u(at, 3), at + 3
            if at + size <= n:
                der, at = tile[at : at + size], at + size
        at = skip(at, 2)  # chain
        yield place, stamp, "x509" if kind == 0 else "precert", der or _wrapped(body)
        place += 1


def _wrapped(tbs: bytes) -> bytes:
    rest = tbs + bytes.fromhex("300d06092a864886f70d01010b05000303000000")
    n = len(rest)
    return (b"\x30" + (bytes([n]) if n < 128 else b"\x81" + n.to_bytes(1, "big") if n < 256 else b"\x82" + n.to_bytes(2, "big") if n < 65536 else b"\x83" + n.to_bytes(3, "big"))) + rest


#: Tiles from which on a step over all of them costs less than a loop over their
#: records (16 tiles of 256 records: half as fast as the loop; 4,000 of one or two: 7 times).
TOGETHER = 64


def _records(tiles: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(tile, place, timestamp, entry type, DER) of the records of a few long or
    many short tiles."""
    if len(tiles) < TOGETHER:
        rows = [(i, *r) for i, t in enumerate(tiles.to_pylist()) for r in tile_records(t or b"")]
        of, place, stamp, kind, der = zip(*rows) if rows else ((),) * 5
        return np.array(of, np.int64), np.array(place, np.int64), np.array(stamp, np.int64), np.array(kind, object), list(der)
    data, offsets = columnar.buffers(tiles)
    r, raw = columnar.tile_records(data, offsets), data.tobytes()
    der = [raw[s:e] if e > s else _wrapped(raw[p:q]) for s, e, p, q in zip(*(x.tolist() for x in r[4:]))]
    return r.tile, r.place, r.stamp, np.where(r.precert, "precert", "x509").astype(object), der


def explode_tiles(tiles: DataFrame, tile: str = "tile", base: str = "base_index") -> DataFrame:
    """A row for each record of each tile, with its index in the log."""
    kept = [f for f in tiles.schema if f.name != tile]
    names = [f.name for f in kept]
    i = tiles.columns.index(tile)

    def run(batches):
        for whole in batches:
            for lo, hi in columnar.slices(whole.column(i)):
                b = whole.slice(lo, hi - lo)
                of, place, stamp, kind, der = _records(b.column(i))
                own = [b.column(n).take(pa.array(of)) for n in names]
                index = pc.add(own[names.index(base)].cast(pa.int64()), pa.array(place))
                yield pa.RecordBatch.from_arrays([*own, index, pa.array(stamp), pa.array(kind, pa.string()), pa.array(der, pa.binary())], names=[*names, "cert_index", "timestamp_ms", "entry_type", "der"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return tiles.mapInArrow(run, f"{ddl}, cert_index bigint, timestamp_ms bigint, entry_type string, der binary")
