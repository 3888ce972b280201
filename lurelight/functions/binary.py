"""Binary records of certificate logs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big_endian(b: Column, at: Column | int, size: int) -> Column:
    """Unsigned integer of ``size`` bytes from offset ``at`` (from 0); null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(b, at + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("decimal(20,0)")).cast("long")


def uint24(b: Column, at: Column | int) -> Column:
    return big_endian(b, at, 3)


# Signature algorithm (sha256WithRSA) and an empty signature
_ALGORITHM, _SIGNATURE = "300D06092A864886F70D01010B0500", "0303000000"


def wrap_tbs(tbs: Column) -> Column:
    """A to-be-signed certificate as the sequence of a certificate, so that
    parsers take it."""
    rest = F.concat(tbs, F.unhex(F.lit(_ALGORITHM)), F.unhex(F.lit(_SIGNATURE)))
    n = F.octet_length(rest)
    hexed = lambda width: F.lpad(F.hex(n), width, "0")
    head = F.when(n < 128, F.concat(F.lit("30"), hexed(2))).when(n < 256, F.concat(F.lit("3081"), hexed(2))).when(n < 65536, F.concat(F.lit("3082"), hexed(4))).otherwise(F.concat(F.lit("3083"), hexed(6)))
    return F.concat(F.unhex(head), rest)


def leaf(leaf_input: Column) -> Column:
    """struct(timestamp_ms, entry_type, der) of a Merkle leaf; null where the
    frame is cut short or of an unknown type."""
    n, kind = F.octet_length(leaf_input), big_endian(leaf_input, 10, 2)
    plain, pre = uint24(leaf_input, 12), uint24(leaf_input, 44)
    der = F.when((kind == 0) & (n >= 15 + plain), F.substring(leaf_input, F.lit(16), plain.cast("int"))).when((kind == 1) & (n >= 47 + pre), wrap_tbs(F.substring(leaf_input, F.lit(48), pre.cast("int"))))
    made = F.struct(big_endian(leaf_input, 2, 8).alias("timestamp_ms"), F.when(kind == 0, "x509").otherwise("precert").alias("entry_type"), der.alias("der"))
    return F.when(der.isNotNull(), made)


def tile_path(index: Column) -> Column:
    """Three digits a folder, all but the last with an x: 1234067 is x001/x234/067."""
    s = index.cast("string")
    padded = F.lpad(s, (F.ceil(F.length(s) / 3) * 3).cast("int"), F.lit("0"))
    return F.regexp_replace(padded, "(\\d{3})(?=\\d)", "x$1/")


def log_id_of_key(key: Column) -> Column:
    """Base64 of the SHA-256 of the decoded key; empty without a key."""
    return F.when(F.coalesce(key, F.lit("")) == "", "").otherwise(F.base64(F.unhex(F.sha2(F.unbase64(key), 256))))


DNS_NAMES = "DNS:([^,\\n]+)"


def dns_names(subject_alt_name: Column) -> Column:
    """Dotted names of a subject-alternative-name text, wildcards stripped."""
    from .text import ingest_host, is_dotted

    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(subject_alt_name, F.lit("")), F.lit(DNS_NAMES), F.lit(1)), ingest_host), is_dotted)


def common_name(subject: Column) -> Column:
    from .text import ingest_host

    return F.when(subject.rlike("CN\\s*=\\s*[^\\n,]+"), ingest_host(F.regexp_extract(subject, "CN\\s*=\\s*([^\\n,]+)", 1)))


def checkpoint(note: Column) -> Column:
    """struct(origin, tree_size, root_hash, body, signatures) of a signed note;
    null where it has no blank line, fewer than three lines or no size."""
    text = F.replace(note, F.lit("\r\n"), F.lit("\n"))
    cut = F.instr(text, "\n\n")
    body = F.left(text, cut)
    lines = F.split(body, "\n")
    size = F.get(lines, F.lit(1)).try_cast("bigint")
    signed = F.filter(F.split(F.substr(text, cut + 2), "\n"), lambda x: F.startswith(x, F.lit("— ")))
    parts = F.transform(signed, lambda x: F.struct(F.get(F.split(x, " "), F.lit(1)).alias("name"), F.get(F.split(x, " "), F.lit(2)).alias("signature")))
    made = F.struct(F.get(lines, F.lit(0)).alias("origin"), size.alias("tree_size"), F.get(lines, F.lit(2)).alias("root_hash"), body.alias("body"), parts.alias("signatures"))
    return F.when((cut > 0) & (F.size(lines) >= 4) & (size >= 0), made)
