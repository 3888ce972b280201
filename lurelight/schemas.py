"""Schemas of all records; nothing is inferred.

``schemas.FINDING`` and its like are StructTypes, made from the text below when
they are first read, for which Spark wants a session.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql.types import StructType

_BRAND = "id string, display string, category string, tokens array<string>, max_edit_distance int, require_context boolean, allow_affix boolean, context_tokens array<string>, known_tlds array<string>"
_KEYWORD = "token string, category string, affix boolean"
_SCHEME = "id string, display string, tokens array<string>, max_edit_distance int, official_registrable string, active_window struct<start:string,end:string>"
_ALLOWED = "registrable string, brand string, verified boolean"
_BRANDS_FILE = f"brands array<struct<{_BRAND}>>"
_KEYWORDS_FILE = f"keywords array<struct<{_KEYWORD}>>"
_SCHEMES_FILE = f"schemes array<struct<{_SCHEME}>>"
_ALLOWLIST_FILE = f"entries array<struct<{_ALLOWED}>>"
_SCORING_FILE = "version int, thresholds struct<dashboard_min:int,digest_min:int,alert_min:int>, weights map<string,int>, caps struct<total:int>"

_SIGNAL = "type string, brand string, scheme string, display string, token string, category string, expected array<string>, actual string, registrable string, points int, domain string"

#: One sighting of a certificate, whatever source it came from.
_ENTRY = (
    "entry_id long, dns_names array<string>, domains array<string>, name_value string, domain string, common_name string, not_before string,"
    " issuer_aggregated string, issuer_cn string, cert_index long, cert_link string, cert_fingerprint string, cert_serial string,"
    " cert_issuer_dn_sha256 string, entry_types array<string>, san_count int, is_wildcard boolean, seen double, source string, source_label string,"
    " source_ref string, log_name string, log_operator string, protocol string"
)
_SOURCE = "name string, label string, cert_index long, cert_link string, source_ref string, fingerprint string, log_name string, log_operator string"
_FINDING = (
    "id string, scoring_version int, observed_at timestamp, certificate_not_before string, registrable string, domains array<string>, score int,"
    f" severity string, signals array<struct<{_SIGNAL}>>, matched_brands array<string>, matched_schemes array<string>, issuer string,"
    f" suppressed boolean, cert_serial string, cert_issuer_dn_sha256 string, entry_types array<string>, san_count int, is_wildcard boolean, source struct<{_SOURCE}>"
)
_FINDING_SOURCE = (
    "finding_id string, source string, source_ref string, observed_at timestamp, details struct<domains:array<string>,registrable:string,severity:string,"
    "score:int,cert_serial:string,entry_types:array<string>,san_count:int,cert_index:bigint,cert_link:string,fingerprint:string,log_name:string,log_operator:string>"
)
_SOURCE_RUN = (
    "source string, label string, checked_at timestamp, ok boolean, scanned_entries int, matched int, persisted int, duration_ms int,"
    " errors array<struct<message:string>>, details string"
)
_LOG = (
    "log_id string, operator string, description string, protocol string, submission_url string, monitoring_url string, public_key_der string, state string,"
    " not_after_start string, not_after_limit string, refreshed_at timestamp"
)
_CURSOR = "key string, tree_size long, next_index long, checked_at timestamp, last_error string"
_STATE = "key string, value string, updated_at timestamp"
_CORPUS = (
    "id string, domain string, expected string, label string, source string, source_ref string, labelled_at string, brand string, category string,"
    " adversarial boolean, constructed boolean, mined_band boolean, registrable string, log_id string, tree_index long, cert_sha256 string, observed_at string, notes string"
)
_STREAM_MESSAGE = (
    "message_type string, data struct<cert_index:bigint,cert_link:string,seen:double,leaf_cert:struct<subject:struct<CN:string>,issuer:struct<CN:string,aggregated:string>,"
    "not_before:bigint,sha256:string,fingerprint:string,serial_number:string,all_domains:array<string>>>"
)
_NAMES_MESSAGE = "message_type string, data array<string>"
_SEARCH_ROW = "id long, name_value string, common_name string, issuer_name string, entry_timestamp string, not_before string, serial_number string, min_cert_id long"


@cache
def __getattr__(name: str) -> StructType:
    text = globals().get(f"_{name}")
    if not isinstance(text, str):
        raise AttributeError(name)
    return StructType.fromDDL(text)
