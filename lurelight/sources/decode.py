"""Records of the four kinds of sources as entries (schemas.ENTRY)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import binary, text
from .certificates import explode_tiles, with_names


def as_entries(rows: DataFrame, fields: dict[str, Column], extra: list[str] | None = None) -> DataFrame:
    """The superset record; fields that a source lacks are null."""
    made = [(fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ENTRY]
    return rows.select(*made, *(extra or []))


def stream_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages of the live stream: full updates and lists of names; other
    messages, and those without a dotted name, give nothing."""
    full, plain = F.from_json(column, schemas.STREAM_MESSAGE), F.from_json(column, schemas.NAMES_MESSAGE)
    d = raw.select("*", full.alias("_m"), plain.alias("_n"))
    leaf = F.col("_m.data.leaf_cert")
    listed = F.col("_n.message_type") == "dns_entries"
    names = F.when(listed, F.col("_n.data")).when(F.col("_m.message_type") == "certificate_update", leaf["all_domains"])
    names = F.filter(F.transform(text.distinct_truthy(names), text.ingest_host), text.is_dotted)
    d = d.withColumn("_names", names).filter(F.size("_names") > 0)
    out = {
        "dns_names": F.col("_names"),
        "common_name": F.coalesce(text.truthy(leaf["subject"]["CN"]), F.col("_names")[0]),
        "not_before": text.iso_time(leaf["not_before"].cast("string")),
        "issuer_aggregated": leaf["issuer"]["aggregated"],
        "issuer_cn": leaf["issuer"]["CN"],
        "cert_index": F.col("_m.data.cert_index"),
        "cert_link": F.col("_m.data.cert_link"),
        "cert_fingerprint": text.first_truthy(leaf["sha256"], leaf["fingerprint"]),
        "cert_serial": leaf["serial_number"],
        "seen": F.col("_m.data.seen"),
        "source": F.lit("certstream"),
        "source_label": F.lit("CertStream"),
        "protocol": F.lit("websocket"),
    }
    return as_entries(d, out)


def search_rows(rows: DataFrame) -> DataFrame:
    """Rows of the identity search (schemas.SEARCH_ROW)."""
    raw = F.filter(F.split(F.lower(F.coalesce("name_value", F.lit(""))), "\\s+"), lambda x: x != "")
    wild = F.exists(raw, lambda x: F.instr(x, "*") > 0)
    names = F.array_distinct(F.filter(F.transform(raw, lambda x: F.regexp_replace(x, "^\\*\\.", "")), text.is_dotted))
    d = rows.withColumns({"_names": names, "_wild": wild}).filter(F.size("_names") > 0)
    out = {
        "entry_id": F.col("id"),
        "dns_names": F.col("_names"),
        "common_name": F.coalesce(text.truthy(F.col("common_name")), F.col("_names")[0]),
        "not_before": text.iso_time(F.col("not_before")),
        "issuer_aggregated": F.col("issuer_name"),
        "cert_index": F.col("id"),
        "cert_link": F.concat(F.lit("https://crt.sh/?id="), F.col("id").cast("string")),
        "cert_serial": F.coalesce(text.truthy(F.col("serial_number")), F.col("id").cast("string")),
        "cert_issuer_dn_sha256": F.when(F.col("issuer_name") != "", F.sha2("issuer_name", 256)),
        "entry_types": F.array(F.lit("x509")),
        "san_count": F.size("_names"),
        "is_wildcard": F.col("_wild"),
        "seen": F.unix_millis(F.try_to_timestamp("entry_timestamp")) / 1000,
        "source": F.lit("crtsh"),
        "source_label": F.lit("crt.sh"),
        "source_ref": F.concat(F.lit("crtsh:"), F.col("id").cast("string")),
        "protocol": F.lit("http"),
    }
    return as_entries(d, out)


def _logged(d: DataFrame, source: str, label: Column, protocol: str) -> DataFrame:
    out = {c: F.col(c) for c in ("dns_names", "common_name", "not_before", "issuer_aggregated", "cert_index", "cert_fingerprint", "cert_serial", "cert_issuer_dn_sha256")}
    out |= {
        "entry_types": F.array("entry_type"),
        "san_count": F.size("dns_names"),
        "is_wildcard": F.exists("dns_names", lambda x: F.instr(x, "*") > 0),
        "seen": F.col("timestamp_ms") / 1000,
        "source": F.lit(source),
        "source_label": label,
        "source_ref": F.concat_ws(":", F.coalesce(text.truthy(F.col("monitoring_url")), F.col("submission_url")), F.col("cert_index").cast("string")),
        "log_name": F.col("description"),
        "log_operator": F.col("operator"),
        "protocol": F.lit(protocol),
    }
    return as_entries(d, out)


def log_leaves(rows: DataFrame) -> DataFrame:
    """Indexed log entries: (leaf_input binary, cert_index, description, operator,
    submission_url, monitoring_url). Frames are cut natively, names by Arrow."""
    d = rows.withColumn("_leaf", binary.leaf(F.col("leaf_input"))).filter("_leaf is not null").drop("leaf_input").select("*", "_leaf.*").drop("_leaf")
    return _logged(with_names(d), "direct_ct", F.lit("Direct CT"), "rfc6962")


def log_tiles(tiles: DataFrame) -> DataFrame:
    """Data tiles: (tile binary, base_index, cursor, description, operator,
    submission_url, monitoring_url). Entries before the cursor are left out."""
    d = explode_tiles(tiles).filter("cert_index >= cursor")
    label = F.when(F.col("entry_type") == "precert", "Static CT (Precert)").otherwise("Static CT")
    return _logged(with_names(d), "static_ct", label, "static-ct-api")


def union_sources(*entries: DataFrame) -> DataFrame:
    """All sources' entries with the rank of their arrival."""
    from ..operators.findings import source_rank

    out = entries[0]
    for e in entries[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    return out.withColumn("source_rank", source_rank(F.col("source")))
