"""The same results in DuckDB's SQL, where that can express them."""

from __future__ import annotations

from . import chat
from .mixing import LEVELS


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _longer(column: str) -> str:
    """Characters that escaping adds to a text."""
    backslashes = f"(length({column}) - length(replace({column}, chr(92), '')))"
    return " + ".join([backslashes, *(f"(length({column}) - length(replace({column}, {_quote(c)}, ''))) // {len(c)}" for c in chat.CONTROL)])


CHAT = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, {len(chat.START + chat.MIDDLE + chat.END)} + length(role) + length(text) + {_longer("role")} + {_longer("text")} AS chars FROM rows
), one AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(chars)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM one
"""


# links by shared shingles, components by reach
NEARDUP = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON e.a = reach.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""

# windows by their words; the words that a recurring one covers go
REPEATS = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least_id AS (SELECT h, min(doc_id) AS lo FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN least_id USING (h), range(50) r(k) WHERE lo < doc_id),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def _mixing(share: float, epochs: int, seed: int, default: float, weights: dict[str, dict[str, float]]) -> str:
    """The budgets level by level, then prefixes by running sums."""
    parts, family, before = [], [], "(SELECT sum(tokens) * %r AS share FROM leaves)" % share
    for n, level in enumerate(LEVELS):
        key = ", ".join([*family, level])
        over = f"PARTITION BY {', '.join(family)}" if family else ""
        case = "".join(f" WHEN {level} = {_quote(k)} THEN {w!r}" for k, w in weights.get(level, {}).items())
        weight = f"CASE{case} ELSE {default!r} END" if case else f"{default!r}"
        join = f"JOIN {before} USING ({', '.join(family)})" if family else f"CROSS JOIN {before}"
        ahead = f"({over} ORDER BY zero, CASE WHEN NOT zero THEN cap / w END, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        parts.append(
            f"""
n{n} AS (SELECT {key}, (sum(tokens) * {epochs})::DOUBLE AS cap, ({weight})::DOUBLE AS w0 FROM leaves GROUP BY {key}),
w{n} AS (SELECT *, CASE WHEN max(w0) OVER ({over}) > 0 THEN w0 ELSE 1.0::DOUBLE END AS w, w <= 0 AS zero FROM n{n} {join}),
a{n} AS (SELECT *, (share - coalesce(sum(cap) OVER {ahead}, 0)) / nullif(sum(w) OVER ({over}) - coalesce(sum(w) OVER {ahead}, 0), 0) AS unit FROM w{n}),
f{n} AS (SELECT *, NOT zero AND coalesce(cap <= unit * w, false) AS whole FROM a{n}),
l{n} AS (SELECT *, max(CASE WHEN NOT whole AND NOT zero THEN unit END) OVER ({over}) AS lev,
    coalesce(greatest(share - sum(CASE WHEN zero THEN 0 ELSE cap END) OVER ({over}), 0) / nullif(sum(CASE WHEN zero THEN cap ELSE 0 END) OVER ({over}), 0), 0) AS spare FROM f{n}),
g{n} AS (SELECT {key}, CASE WHEN zero THEN least(1.0, spare) * cap WHEN whole THEN cap ELSE least(cap, greatest(lev, 0) * w) END AS share FROM l{n})"""
        )
        family, before = [*family, level], f"g{n}"
    order = f"('0x' || substr(md5('{seed}:' || epoch || ':' || doc_id), 1, 15))::BIGINT"
    leaf = ", ".join(LEVELS)
    return f"""
WITH sized AS (
    SELECT doc_id, 'd' || (('0x' || substr(md5(coalesce(source, '')), 1, 2))::BIGINT % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens
    FROM documents
), leaves AS (SELECT {leaf}, sum(tokens)::BIGINT AS tokens FROM sized GROUP BY {leaf}),{",".join(parts)},
plan AS (SELECT {leaf}, leaves.tokens AS all_tokens, least(ceil(share), leaves.tokens * {epochs})::BIGINT AS budget FROM leaves JOIN g{len(LEVELS) - 1} USING ({leaf})),
epochs AS (SELECT * FROM plan, range({epochs}) AS e(epoch) WHERE (all_tokens = 0 AND epoch = 0) OR budget - epoch * all_tokens > 0),
ordered AS (
    SELECT *, budget - epoch * all_tokens AS left_tokens,
        coalesce(sum(tokens) OVER (PARTITION BY {leaf}, epoch ORDER BY {order}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
    FROM sized JOIN epochs USING ({leaf})
)
SELECT doc_id, domain AS mix_domain, lang AS mix_lang, source AS mix_source, epoch AS mix_epoch, tokens AS mix_tokens
FROM ordered WHERE left_tokens >= all_tokens OR so_far < left_tokens
"""


def mixing(mix) -> str:
    return _mixing(mix.share, mix.epochs, mix.seed, mix.default, mix.weights)


_LENGTH, _PARTS, _ENTRIES, _ROUNDS = "(SELECT len(v) FROM ints ORDER BY vec_id, v LIMIT 1)", 4, 256, 4


def vector_codes() -> str:
    """Rounds unrolled: every part against every entry, then floored means."""
    steps = [
        f"""
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id, v) - 1 AS entry, x AS e FROM parts
    WHERE row IN (SELECT row FROM kept ORDER BY vec_id, v LIMIT {_ENTRIES}))"""
    ]
    nearest = "min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i]))) * 1000 + entry)::BIGINT"
    for n in range(_ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT row, part, any_value(x) AS x, {nearest} AS best FROM parts JOIN c{n} USING (part) GROUP BY row, part)")
        if n < _ROUNDS:
            steps.append(
                f"""
m{n} AS (SELECT part, best % 1000 AS entry, pos, floor(sum(value) / count(*))::BIGINT AS value FROM (SELECT part, best, unnest(range(len(x))) AS pos, unnest(x) AS value FROM a{n}) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(new, e) AS e FROM c{n} LEFT JOIN (SELECT part, entry, list(value ORDER BY pos) AS new FROM m{n} GROUP BY ALL) USING (part, entry))"""
            )
    return f"""
WITH ints AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {_PARTS} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
kept AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS row FROM ints WHERE len(v) = {_LENGTH}),
parts AS MATERIALIZED (SELECT row, vec_id, v, part, v[part * len(v) // {_PARTS} + 1:(part + 1) * len(v) // {_PARTS}] AS x FROM kept, range({_PARTS}) p(part)),{",".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{_ROUNDS}),
codes AS (SELECT row, string_agg(printf('%02x', best % 1000), '' ORDER BY part) AS code, sum(best // 1000)::BIGINT AS error FROM a{_ROUNDS} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (row), books
"""


_CRC = "list_reduce(list_transform(range(len(hex(encode({0}))) // 2), lambda i: ('0x' || substr(hex(encode({0})), 2 * i::INT + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)"
_HALVE = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


def _bits(n: int) -> str:
    """A byte's remainder, bit by bit."""
    out = "(SELECT i, i::BIGINT AS c0 FROM range(256) r(i))"
    for k in range(n):
        out = f"(SELECT i, {_HALVE.format(f'c{k}')} AS c{k + 1} FROM {out})"
    return out


RESAMPLE = f"""
WITH steps AS (SELECT list(c8 ORDER BY i) AS crcs FROM {_bits(8)}),
texts AS (SELECT 0 AS which, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT which, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
    SELECT which, id, unnest(w) AS run FROM w
    UNION ALL SELECT which, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
),
hashed AS MATERIALIZED (SELECT run, xor({_CRC.format("run")}, 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT run FROM runs), steps),
each AS MATERIALIZED (SELECT which, id, bucket, count(*) AS n FROM runs JOIN hashed USING (run) GROUP BY ALL),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE which = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE which = 1), 0)::DOUBLE AS t FROM each GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM each JOIN gains USING (bucket) WHERE which = 0 GROUP BY id),
scored AS (
    SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM w LEFT JOIN weights ON doc_id = id WHERE which = 0 AND id IS NOT NULL
),
able AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS all_able FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * all_able // 100 THEN rank END AS rank FROM able
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE words < 20
"""
