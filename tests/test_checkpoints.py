import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from lurelight.functions import signing
from lurelight.plans import signer
from lurelight.sources import checkpoints

from .test_operators import cert, u


def key(name):
    return base64.b64encode(signer.spki(name)).decode()


def test_known_signature():
    """A published example of the curve with SHA-256 (message "sample")."""
    x, y = 0x60FED4BA255A9D31C961EB74C6356D68C049B8923B61FA6CE669622E60F29FB6, 0x7903FE1008B8BC99A41AE9E95628BC64F2F1B20C2D7E9F5177A3C294D4462299
    r, s = 0xEFD48B2AACB6A8FD1140DD9CD45E81D69D2C877B56AAF991C34D0EA84EAF3716, 0xF7CB1C942D657C41D436C7A1B6E29F65F3E900DBB9AFF4064DC4AB2F843ACDA8
    given = r.to_bytes(32, "big") + s.to_bytes(32, "big")
    assert signing.verify(b"sample", given, ("ec", (x, y)), raw=True)
    assert not signing.verify(b"simple", given, ("ec", (x, y)), raw=True) and not signing.verify(b"sample", given[::-1], ("ec", (x, y)), raw=True)
    assert not signing.verify(b"sample", bytes(64), ("ec", (x, y)), raw=True) and not signing.verify(b"sample", b"\x30\x00", ("ec", (x, y)))


def test_rsa():
    p, q, e = (1 << 521) - 1, (1 << 607) - 1, 65537  # two known primes
    n, d = p * q, pow(e, -1, (p - 1) * (q - 1))
    size = (n.bit_length() + 7) // 8
    padded = b"\0\1" + b"\xff" * (size - 3 - 19 - 32) + b"\0" + signing.SHA256_INFO + hashlib.sha256(b"m").digest()
    given = pow(int.from_bytes(padded, "big"), d, n).to_bytes(size, "big")
    tlv = lambda tag, *x: (b := b"".join(x)) and bytes([tag]) + (bytes([len(b)]) if len(b) < 128 else b"\x82" + len(b).to_bytes(2, "big")) + b
    big = lambda v: tlv(2, v.to_bytes(v.bit_length() // 8 + 1, "big"))
    spki = tlv(0x30, tlv(0x30, tlv(6, signing.RSA_KEY), b"\5\0"), tlv(3, b"\0", tlv(0x30, big(n), big(e))))
    assert signing.public_key(spki) == ("rsa", (n, e))
    assert signing.verify(b"m", given, ("rsa", (n, e))) and not signing.verify(b"n", given, ("rsa", (n, e))) and not signing.verify(b"m", given[1:], ("rsa", (n, e)))


def test_keys():
    assert signing.public_key(signer.spki("a"))[0] == "ec"
    wrong = bytearray(signer.spki("a"))
    wrong[-1] ^= 1
    for bad in (b"", b"\x30", bytes(wrong), signer.spki("a")[:-3], b"\x30\x00"):
        with pytest.raises(ValueError):
            signing.public_key(bad)


def test_outcomes(spark):
    a, n = key("a"), signer.note
    rows = [
        ("der", n("a", 9), a, None), ("raw", n("a", 9, "raw"), a, None), ("head", n("a", 9, "head"), a, None), ("crlf", n("a", 9).replace("\n", "\r\n"), a, None),
        ("second", n("a", 9).replace("—", "— other aGludHh4\n—"), a, None), ("tampered", n("a", 9).replace("\n9\n", "\n90\n"), a, "signature_mismatch"), ("head tampered", n("a", 9, "head").replace("\n9\n", "\n8\n"), a, "signature_mismatch"),
        ("foreign", n("b", 9), a, "signature_mismatch"), ("noise", n("a", 9)[:-30] + "!!\n", a, "signature_mismatch"), ("no key", n("a", 9), None, "missing_public_key"), ("empty key", n("a", 9), "", "missing_public_key"),
        ("bad key", n("a", 9), "AAAA", "verification_error"), ("unsigned", n("a", 9).split("—")[0], a, "missing_signatures"), ("null", None, a, "malformed"), ("short", "x\n\n", a, "malformed"), ("no size", n("a", 9).replace("\n9\n", "\nmany\n"), a, "malformed"),
    ]
    d = spark.createDataFrame([r[:3] for r in rows], "kind string, note string, public_key_der string").withColumn("ok", F.lit("clash")).repartition(2)
    got = {r.kind: (r.ok, r.reason) for r in checkpoints.verified(d).collect()}
    assert got == {kind: (reason is None, reason) for kind, _, _, reason in rows}
    first = checkpoints.verified(d).filter("kind = 'der'").first()
    assert (first.origin, first.tree_size) == ("a", 9) and len(base64.b64decode(first.root_hash)) == 32
    assert checkpoints.verified(d.limit(0)).count() == 0


def test_static_poll(spark):
    whole = cert("posb-login.top", ["posb-login.top"])
    record = u(1_700_000_000_000, 8) + u(0, 2) + u(len(whole), 3) + whole + u(0, 2) + u(0, 2)
    names = ["new", "kept", "gap", "broken", "silent", "done"]
    logs = spark.createDataFrame([(x, f"Log {x}", "Op", None, f"https://{x}/", key(x)) for x in names], "log string, description string, operator string, submission_url string, monitoring_url string, public_key_der string")
    notes = spark.createDataFrame([(x, signer.note("other" if x == "broken" else x, 258)) for x in names if x != "silent"], "log string, note string")
    cursors = spark.createDataFrame([("kept", 255), ("gap", 200), ("broken", 7), ("done", 9000)], "log string, next_index long")
    tiles = [(x, 0, record * 256) for x in ("kept", "new", "gap", "broken")] + [(x, 1, record * 2) for x in ("kept", "new", "broken")]
    got = checkpoints.static_poll(logs, notes, cursors, spark.createDataFrame(tiles, "log string, tile_index long, tile binary"))
    assert {r.log: (r.next_index, r.tree_size, r.lag) for r in got["cursors"].collect()} == {"new": (258, 258, 0), "kept": (258, 258, 0), "gap": (256, 258, 2), "done": (258, 258, 0)}
    assert {r.log: r.message for r in got["errors"].collect()} == {"broken": "checkpoint_signature_invalid: signature_mismatch", "silent": "checkpoint_signature_invalid: malformed"}
    found = {}
    for r in got["entries"].collect():
        found.setdefault(r.log_name, []).append(r.cert_index)
    assert {k: (min(v), max(v), len(v)) for k, v in found.items()} == {"Log new": (0, 257, 258), "Log kept": (255, 257, 3), "Log gap": (200, 255, 56)}


def test_sums_of_multiples():
    """Table and digits against one chain of doublings and additions."""

    def plain(u, q):
        at = (0, 1, 0)
        for bit in bin(u)[2:]:
            at = signing._double(at)
            at = signing._add(at, (*q, 1)) if bit == "1" else at
        return at

    q = signing.combined(977, 0, signing.G)
    for u, v in [(0, 0), (1, 0), (0, 1), (signing.N, 0), (signing.N - 977, 1), (signing.N - 1, signing.N - 1), (255 << 248, 31), ((1 << 256) - 1, 0xABCDEF << 200)]:
        want = signing._add(plain(u, signing.G), plain(v, q))
        assert signing.combined(u, v, q) == (signing._affine([want])[0] if want[2] else None)


def test_notes_are_spread(spark):
    """Short rows of one file go to all cores, by the number of rows in each."""
    d = spark.range(400).coalesce(1).select(F.lit(None).cast("string").alias("note"), F.lit("k").alias("public_key_der"))
    sizes = checkpoints.verified(d).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 100


def test_static_cursors_of_large_keys(spark, tmp_path):
    """The tiles of a log grow with its key; a poll asks for three of them at most."""
    from lurelight.plans import catalog

    keys = [1, 8, 42, 3 * 10**12 + 1, 3 * 10**12 + 2, 7 * 10**12]
    spark.createDataFrame([(k,) for k in [*keys, 3 * 10**12 + 4]], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    want = {}
    for k in keys:
        if k % 8 < 3:
            size = k * 600
            at = k * 100 if k % 5 else max(0, size - 512)
            last = at // 256 if k % 7 == 0 else min(at // 256 + 2, (size - 1) // 256)
            end = min(size, (last + 1) * 256)
            want[f"log/{k}"] = (end, size, size - end)
    assert {r.log: tuple(r)[1:] for r in catalog.static_cursors(spark, str(tmp_path)).collect()} == want and len(want) == 6
