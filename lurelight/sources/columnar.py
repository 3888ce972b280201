"""DER certificates and log tiles by numpy over the bytes of an Arrow column.

One step reads the tags and lengths of many rows at once; a loop counts the
children of a value, not the rows. A row whose bytes take an unusual way (long
form lengths of over four bytes, names beyond plain ASCII, dates that may not
exist, damage) is not decided here but given to the reader of single rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
HEX = np.frombuffer(b"0123456789ABCDEF", np.uint8)
_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])  # a 29th of February is read by itself


class Spans(NamedTuple):
    """Values inside others: which one they are in, the place among its children,
    tag, and where the content lies."""

    of: np.ndarray
    nth: np.ndarray
    tag: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def where(self, keep: np.ndarray) -> Spans:
        return Spans(*(x[keep] for x in self))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column; null counts as empty. There is one
    byte more, so that places at the end can be looked up."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(1, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.append(data, np.uint8(0)), offsets - offsets[0]


def number(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out, last = np.zeros(len(at), np.int64), len(data) - 1
    for k in range(width):
        out = (out << 8) | data[np.minimum(at + k, last)]
    return out


def head(data: np.ndarray, at: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tag, start, end, whether a value lies at ``at`` and ends by ``limit``)."""
    last = len(data) - 1
    tag, n = data[np.minimum(at, last)], data[np.minimum(at + 1, last)].astype(np.int64)
    more = np.where(n & 0x80, n & 0x7F, 0)
    size = np.where(n & 0x80, 0, n)
    for k in range(min(4, int(more.max(initial=0)))):
        size = np.where(k < more, (size << 8) | data[np.minimum(at + 2 + k, last)], size)
    start = at + 2 + more
    return tag, start, start + size, (more <= 4) & (start + size <= limit)


def children(data: np.ndarray, start: np.ndarray, end: np.ndarray, limit: np.ndarray) -> tuple[Spans, np.ndarray]:
    """All children of the values, in their order, and the values that cannot be read."""
    at, bad, got = start.copy(), np.zeros(len(start), bool), []
    live, nth = np.flatnonzero(at < end), 0
    while len(live):
        tag, s, e, ok = head(data, at[live], limit[live])
        bad[live[~ok]] = True
        live, tag, s, e = live[ok], tag[ok], s[ok], e[ok]
        got.append((live, np.full(len(live), nth), tag, s, e))
        at[live] = e
        live, nth = live[e < end[live]], nth + 1
    if not got:
        none = np.zeros(0, np.int64)
        return Spans(none, none, none.astype(np.uint8), none, none), bad
    spans = Spans(*(np.concatenate(x) for x in zip(*got)))
    return spans.where(np.argsort(spans.of, kind="stable")), bad


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, and their offsets."""
    size = np.maximum(end - start, 0)
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)], offsets


def _strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _is(data: np.ndarray, spans: Spans, content: bytes) -> np.ndarray:
    return (spans.end - spans.start == len(content)) & (number(data, spans.start, len(content)) == int.from_bytes(content, "big"))


def _hosts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lower-case names without leading ``*.`` and trailing dot, whether each has
    a dot, whether each is plain)."""
    raw, offsets = gathered(data, start, end)
    odd = np.concatenate([[0], np.cumsum((raw <= 0x20) | (raw >= 0x7F))])
    plain = odd[offsets[1:]] == odd[offsets[:-1]]
    low, last = np.append(LOWER[raw], np.uint8(0)), len(raw)
    a = offsets[:-1].copy()
    z = np.where(plain, offsets[1:], a)
    a = np.where((z - a >= 2) & (low[np.minimum(a, last)] == 42) & (low[np.minimum(a + 1, last)] == 46), a + 2, a)
    z = np.where((z > a) & (low[np.maximum(z - 1, 0)] == 46), z - 1, z)
    dots = np.concatenate([[0], np.cumsum(low == 46)])
    return _strings(*gathered(low, a, z), pa.string()), dots[z] > dots[a], plain


def _times(data: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(ISO texts, whether the time is one that surely exists)."""
    short = tag == 0x17
    ok = (end - start) == np.where(short, 13, 15)
    at = (start[:, None] - np.where(short, 2, 0)[:, None]) + np.arange(15)
    d = data[np.clip(at, 0, len(data) - 1)]
    old = short & (d[:, 2] >= ord("7")) | (short & (d[:, 2] == ord("6")) & (d[:, 3] == ord("9")))
    d[short, :2] = np.where(old[short, None], np.frombuffer(b"19", np.uint8), np.frombuffer(b"20", np.uint8))
    v = d[:, :14].astype(np.int64) - 48
    ok &= ((v >= 0) & (v <= 9)).all(1) & (d[:, 14] == ord("Z"))
    two = v[:, 0::2] * 10 + v[:, 1::2]  # century, year, month, day, hour, minute, second
    month = np.clip(two[:, 2], 0, 12)
    ok &= (two[:, 0] > 0) & (two[:, 2] == month) & (month > 0) & (two[:, 3] > 0) & (two[:, 3] <= _DAYS[month]) & (two[:, 4] < 24) & (two[:, 5] < 60) & (two[:, 6] < 60)
    out = np.tile(np.frombuffer(b"0000-00-00T00:00:00.000Z", np.uint8), (len(d), 1))
    for to, source in ((0, 0), (2, 2), (5, 4), (8, 6), (11, 8), (14, 10), (17, 12)):
        out[:, to : to + 2] = d[:, source : source + 2]
    return _strings(out.ravel(), np.arange(len(d) + 1) * 24, pa.string()), ok


def _serials(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Upper-case hex digits without the first byte where that is zero; "00" for none."""
    lead = (end > start) & (data[np.minimum(start, len(data) - 1)] == 0)
    raw, offsets = gathered(data, start + lead, end)
    digits = np.empty(2 * len(raw), np.uint8)
    digits[0::2], digits[1::2] = HEX[raw >> 4], HEX[raw & 15]
    out = _strings(digits, offsets * 2, pa.string())
    return pc.if_else(pc.equal(pc.binary_length(out), 0), "00", out)


def certificates(column: pa.Array, issuer_text) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """(rows with names, rows that this reader does not decide, fields of the
    first). ``issuer_text`` reads the bytes of a name, once for each that occurs."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    begin, limit = offsets[:-1], offsets[1:]
    bad = np.zeros(n, bool)

    def checked(ok: np.ndarray, of: np.ndarray | None = None) -> None:
        bad[np.flatnonzero(~ok) if of is None else of[~ok]] = True

    def inside(spans: Spans, rows: np.ndarray) -> tuple[Spans, np.ndarray]:
        """Children of spans, and the row of each."""
        kids, cut = children(data, spans.start, spans.end, limit[rows])
        bad[rows[cut]] = True
        return kids, rows[kids.of]

    _, s, _, ok = head(data, begin, limit)
    checked(ok)
    _, s, e, ok = head(data, s, limit)
    checked(ok)
    every = np.arange(n)
    parts, of = inside(Spans(every, every, np.zeros(n, np.uint8), s, np.where(bad, s, e)), every)
    versioned = np.zeros(n, np.int64)
    versioned[of[(parts.nth == 0) & (parts.tag == 0xA0)]] = 1
    place = parts.nth - versioned[of]

    def field(k: int) -> Spans:
        """The k-th part of each row; rows without it are not decided here."""
        at = np.full(n, -1)
        hit = place == k
        at[of[hit]] = np.flatnonzero(hit)
        checked(at >= 0)
        if not len(place):
            z = np.zeros(n, np.int64)
            return Spans(every, z, z.astype(np.uint8), z, z)
        return parts.where(at)._replace(of=every)

    serial, issuer, validity, subject = (field(k) for k in (0, 2, 3, 4))

    # names of the subject: sets of pairs of a kind and a text
    sets, rows = inside(subject.where(~bad), every[~bad])
    pairs, rows = inside(sets, rows)
    owners = len(pairs.of)
    halves, half_rows = inside(pairs, rows)
    kind_at, text_at = np.full(owners, -1), np.full(owners, -1)
    kind_at[halves.of[halves.nth == 0]], text_at[halves.of[halves.nth == 1]] = np.flatnonzero(halves.nth == 0), np.flatnonzero(halves.nth == 1)
    checked((kind_at >= 0) & (text_at >= 0), rows)
    whole = (kind_at >= 0) & (text_at >= 0)
    named = np.flatnonzero(whole)[_is(data, halves.where(kind_at[whole]), b"\x55\x04\x03")] if whole.any() else np.zeros(0, np.int64)
    first = named[np.unique(rows[named], return_index=True)[1]]  # the first common name of a row
    cn, cn_rows = halves.where(text_at[first]), rows[first]

    # alternative names: extensions, of which those of that kind hold a list
    lists, rows = parts.where((parts.tag == 0xA3) & (place >= 6)), of[(parts.tag == 0xA3) & (place >= 6)]
    _, s, e, ok = head(data, lists.start, limit[rows])
    checked(ok, rows)
    extensions, rows = inside(Spans(lists.of, lists.nth, lists.tag, s, np.where(ok, e, s)), rows)
    inner, _ = inside(extensions, rows)
    count = np.bincount(inner.of, minlength=len(rows))
    checked(count > 0, rows)
    if len(inner.of):
        edge = np.cumsum(count)
        have = np.flatnonzero(count)
        chosen = have[_is(data, inner.where((edge - count)[have]), b"\x55\x1d\x11")]
        lastly, rows = inner.where(edge[chosen] - 1), rows[chosen]
        _, s, e, ok = head(data, lastly.start, limit[rows])
        checked(ok, rows)
        alt, alt_rows = inside(Spans(lastly.of, lastly.nth, lastly.tag, s, np.where(ok, e, s)), rows)
        alt, alt_rows = alt.where(alt.tag == 0x82), alt_rows[alt.tag == 0x82]
    else:
        alt, alt_rows = inner, np.zeros(0, np.int64)

    names, dotted, plain = _hosts(data, np.concatenate([alt.start, cn.start]), np.concatenate([alt.end, cn.end]))
    rows = np.concatenate([alt_rows, cn_rows])
    checked(plain, rows)
    common = np.arange(len(rows)) >= len(alt_rows)
    filled = pc.binary_length(names).to_numpy(zero_copy_only=False) > 0
    table = pd.DataFrame({"row": rows, "name": names.to_pandas(), "common": common})[filled & (dotted | common)]
    only = table.drop_duplicates(["row", "name"])
    only = only.iloc[np.argsort(only["row"].to_numpy(), kind="stable")]  # in their order, the common name last

    tag, s, e, ok = head(data, validity.start, limit)
    checked(ok & (validity.start < validity.end))
    at, ok = _times(data, tag, s, e)
    checked(ok)

    held = np.bincount(only["row"], minlength=n)
    good = np.flatnonzero(~bad & (held > 0))
    only = only[~bad[only["row"].to_numpy()]]
    dns = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held[good])]), pa.int32()), pa.array(only["name"], pa.string()))
    said = table[table["common"]].set_index("row")["name"].reindex(good)
    common_name = pc.coalesce(pa.array(said, pa.string(), from_pandas=True), pc.list_element(dns, 0) if len(good) else pa.array([], pa.string()))
    issuers = _strings(*gathered(data, issuer.start[good], issuer.end[good]), pa.binary()).dictionary_encode()
    texts = [issuer_text(x) for x in issuers.dictionary.to_pylist()]
    read = np.array([t is not None for t in texts], bool)
    which = issuers.indices.to_numpy(zero_copy_only=False)
    fields = {
        "dns_names": dns,
        "common_name": common_name,
        "not_before": at.take(pa.array(good)),
        "issuer_aggregated": pa.array(texts, pa.string()).take(issuers.indices),
        "cert_serial": _serials(data, serial.start[good], serial.end[good]),
    }
    if len(good) and not read.all():
        keep = read[which]
        bad[good[~keep]] = True
        good, fields = good[keep], {k: v.filter(pa.array(keep)) for k, v in fields.items()}
    return good, np.flatnonzero(bad), fields


class Records(NamedTuple):
    tile: np.ndarray
    place: np.ndarray
    stamp: np.ndarray
    precert: np.ndarray
    start: np.ndarray  # of the certificate; end = start where there is none
    end: np.ndarray
    body: np.ndarray  # of the record's own part
    body_end: np.ndarray


def tile_records(data: np.ndarray, offsets: np.ndarray) -> Records:
    """The records of all tiles in their order; a cut or unknown one ends its tile."""
    at, live, place, got = offsets[:-1].copy(), np.arange(len(offsets) - 1), 0, []

    def skip(a: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return np.where(a + 2 <= limit, a + 2 + number(data, a, 2), a)

    while len(live):
        live = live[at[live] + 10 <= offsets[live + 1]]
        a, limit = at[live], offsets[live + 1]
        stamp, kind = number(data, a, 8), number(data, a + 8, 2)
        a = a + 10 + np.where(kind == 1, 32, 0)
        size = number(data, a, 3)
        ok = (kind <= 1) & (a + 3 + size <= limit)
        live, a, limit, stamp, kind, size = (x[ok] for x in (live, a, limit, stamp, kind, size))
        body, body_end = a + 3, a + 3 + size
        a = skip(body_end, limit)  # extensions
        start, end = body, np.where(kind == 0, body_end, body)
        sized = (kind == 1) & (a + 3 <= limit)
        length = number(data, a, 3)
        a = np.where(sized, a + 3, a)
        whole = sized & (a + length <= limit)
        start, end = np.where(whole, a, start), np.where(whole, a + length, end)
        at[live] = skip(np.where(whole, a + length, a), limit)  # chain
        got.append((live, np.full(len(live), place), stamp, kind == 1, start, end, body, body_end))
        place += 1
    if not got:
        none = np.zeros(0, np.int64)
        return Records(none, none, none, none.astype(bool), none, none, none, none)
    out = [np.concatenate(x) for x in zip(*got)]
    order = np.argsort(out[0], kind="stable")
    return Records(*(x[order] for x in out))


def slices(column: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` bytes, or of one longer row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(sizes, dtype=np.int64), 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lo, hi
        lo = hi
