"""The columnar reader against the reader of single rows."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lurelight.sources import certificates

from .test_operators import cert, tlv, u


def some(n, seed):
    """Certificates of many shapes; a third are damaged."""
    r = random.Random(seed)
    label = lambda: "".join(r.choice("abcXYZ019-") for _ in range(r.randint(1, 9)))
    out = []
    for _ in range(n):
        host = lambda: r.choice(["", "", "*."]) + ".".join(label() for _ in range(r.randint(1, 4))) + r.choice(["", "", "."])
        names = [host() for _ in range(r.choice([0, 1, 2, 5, 40]))]
        names += names[:2] + (["bü.de"] if r.random() < 0.1 else [])
        der = cert(r.choice([host(), host(), "*.", "", "Müller GmbH", " a.com "]), names, bytes(r.randrange(256) for _ in range(r.randint(0, 20))))
        der = der.replace(b"260801000000Z", r.choice([b"260801000000Z", b"260801000000Z", b"690228235959Z", b"680131000000Z", b"240229000000Z", b"230229000000Z", b"261301000000Z", b"26080100000xZ"]))
        if r.random() < 0.33:
            at = r.randrange(len(der))
            der = r.choice([der[:at], der[:at] + bytes([r.randrange(256)]) + der[at + 1 :], der[:at] + der[at + 1 :], b"", b"\x30"])
        out.append(der)
    return out


def rowwise(ders):
    return [(i, *(c[n] for n in certificates.READ)) for i, d in enumerate(ders) if (c := certificates.certificate(d))]


def test_certificates_of_a_column():
    for seed in range(6):
        ders = [*some(700, seed), None, b"\x30\x80", b"\x30\x85\0\0\0\0\x01\x30", b"\x30\x84\xff\xff\xff\xff"]
        column = pa.array(ders, pa.binary())
        for c, want in ((column, rowwise(ders)), (column.slice(5, 90), rowwise(ders[5:95])), (column.slice(0, 0), []), (pa.array([None, b""], pa.binary()), [])):
            rows, fields = certificates.read_column(c)
            assert list(zip(rows.tolist(), *(f.to_pylist() for f in fields))) == want


def test_times_of_both_kinds():
    """Long times, first versions without a version's field, several issuers."""
    pair = lambda kind, v: tlv(0x31, tlv(0x30, tlv(0x06, kind), tlv(0x0C, v)))
    name = lambda v: tlv(0x30, pair(b"\x55\x04\x06", b"SG"), pair(b"\x55\x04\x0a", v), pair(b"\x55\x04\x03", v))
    times = [(0x18, b"20260801000000Z"), (0x18, b"20240229000000Z"), (0x18, b"19991231235959Z"), (0x18, b"0000"), (0x17, b"491231235959Z"), (0x17, b"701231235960Z"), (0x17, b"260431000000Z"), (0x18, b"00000101000000Z")]
    ders = []
    for i, (tag, t) in enumerate(times * 3):
        tbs = tlv(0x30, tlv(2, bytes([0, i])), tlv(0x30), name(b"CA%d" % (i % 4)), tlv(0x30, tlv(tag, t)), name(b"h%d.com" % i), tlv(0x30))
        ders.append(tlv(0x30, tbs))
    rows, fields = certificates.read_column(pa.array(ders, pa.binary()))
    want = rowwise(ders)
    assert len(want) == 12 and list(zip(rows.tolist(), *(f.to_pylist() for f in fields))) == want
    assert want[0][3] == "2026-08-01T00:00:00.000Z" and want[0][4] == "C=SG\nO=CA0\nCN=CA0" and want[1][5] == "01"


@pytest.mark.parametrize("together", [0, 64, 10**6])
def test_tiles_of_a_column(spark, monkeypatch, together):
    for few in (certificates._records(pa.array(t, pa.binary())) for t in ([], [None, b""])):
        assert [len(x) for x in few] == [0] * 5
    monkeypatch.setattr(certificates, "TOGETHER", together)
    r = random.Random(3)
    tiles = []
    for _ in range(120):
        tile = b""
        for _ in range(r.randint(0, 9)):
            body = bytes(r.randrange(256) for _ in range(r.choice([0, 3, 200])))
            kind = r.choice([0, 0, 1, 1, 7]) if r.random() < 0.2 else r.randint(0, 1)
            tile += u(r.randrange(1 << 64), 8) + u(kind, 2) + (b"k" * 32 if kind == 1 else b"") + u(len(body), 3) + body + u(2, 2) + b"xx"
            tile += (u(4, 3) + b"full" if kind == 1 else b"") + u(1, 2) + b"c"
        tiles.append(tile[: r.randint(0, len(tile))] if r.random() < 0.3 else tile)
    tiles += [None, b""]
    want = sorted((i * 1000 + p, t, k, d) for i, tile in enumerate(tiles) for p, t, k, d in certificates.tile_records(tile or b""))
    of, place, stamp, kind, der = certificates._records(pa.array(tiles, pa.binary()))
    assert list(zip((of * 1000 + place).tolist(), stamp.tolist(), kind.tolist(), der)) == want
    d = spark.createDataFrame(list(enumerate(tiles)), "i long, tile binary").select("tile", (F.col("i") * 1000).alias("base_index"), "i")
    got = certificates.explode_tiles(d)
    assert got.columns == ["base_index", "i", "cert_index", "timestamp_ms", "entry_type", "der"]
    assert sorted((x.cert_index, x.timestamp_ms, x.entry_type, bytes(x.der)) for x in got.collect()) == want


def test_faster_than_row_by_row():
    ders = [cert(f"login-{i}.example.com", [f"login-{i}.example.com", f"*.w{i}.example.org"], u(i, 8)) for i in range(5000)]
    column = pa.array(ders, pa.binary())
    certificates.read_column(column)
    a = time.process_time()
    certificates.read_column(column)
    b = time.process_time()
    rowwise(ders)
    assert 3 * (b - a) < time.process_time() - b
