"""Reference tables: watched brands, keywords, lures, allowlist, scoring.

The tables are small by nature (hundreds of rows) and resolved at plan time, so
scoring is a projection: tokens become literals and no row moves. ``load`` reads
other tables from JSON documents of the same shape; ``Reference`` checks that
what becomes literals stays small.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from . import fixed_values as fixed
from . import schemas

#: Rows of a table that may become literals of a plan; ``operators.large`` scores
#: against larger ones by joins.
MOST_ROWS = 5_000


def compact(token: str) -> str:
    return re.sub("[^a-z0-9]", "", token.lower())


@dataclass(frozen=True)
class Brand:
    id: str
    display: str
    category: str
    tokens: tuple[str, ...]
    max_edit_distance: int | None = None
    require_context: bool = False
    allow_affix: bool = False
    context_tokens: tuple[str, ...] = ()
    known_tlds: tuple[str, ...] = ()

    def distance(self, token: str) -> int:
        """Edits allowed for a compact token: none up to two characters, one up to five."""
        n = len(token)
        if n <= 2:
            return 0
        return min(1 if self.max_edit_distance is None else self.max_edit_distance, 1) if n <= 5 else (2 if self.max_edit_distance is None else self.max_edit_distance)


@dataclass(frozen=True)
class Keyword:
    token: str
    category: str
    affix: bool = False


@dataclass(frozen=True)
class Scheme:
    id: str
    display: str
    tokens: tuple[str, ...]
    max_edit_distance: int = 0
    official_registrable: str = ""
    start: str | None = None
    end: str | None = None


@dataclass(frozen=True)
class Allowed:
    registrable: str
    brand: str
    verified: bool = True


@dataclass(frozen=True)
class Scoring:
    version: int = fixed.VERSION
    medium: int = fixed.MEDIUM
    high: int = fixed.HIGH
    critical: int = fixed.CRITICAL
    cap: int = fixed.TOTAL_CAP
    weights: dict[str, int] = field(default_factory=lambda: dict(fixed.WEIGHTS))


@dataclass(frozen=True)
class Reference:
    brands: tuple[Brand, ...]
    keywords: tuple[Keyword, ...]
    schemes: tuple[Scheme, ...]
    allowlist: tuple[Allowed, ...]
    scoring: Scoring = field(default_factory=Scoring)
    suffixes: tuple[str, ...] = tuple(fixed.SUFFIXES.split())

    def __post_init__(self):
        for name in ("brands", "keywords", "schemes", "allowlist"):
            if len(getattr(self, name)) > MOST_ROWS:
                raise ValueError(f"{name}: more than {MOST_ROWS} rows do not belong into a plan; operators.large takes tables of any size")

    def with_(self, **changes) -> Reference:
        return replace(self, **changes)

    def verified(self, brand: str | None = None) -> list[str]:
        return [a.registrable for a in self.allowlist if a.verified and brand in (None, a.brand)]


def _rows(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.splitlines() if line]


def default() -> Reference:
    yes = "true"
    return Reference(
        tuple(Brand(i, d, c, tuple(t.split()), int(m) if m else None, r == yes, a == yes, tuple(x.split()), tuple(k.split())) for i, d, c, t, m, r, a, x, k in _rows(fixed.BRANDS)),
        tuple(Keyword(t, c, a == yes) for t, c, a in _rows(fixed.KEYWORDS)),
        tuple(Scheme(i, d, tuple(t.split()), int(m), o, s or None, e or None) for i, d, t, m, o, s, e in _rows(fixed.SCHEMES)),
        tuple(Allowed(r, b, v == yes) for r, b, v in _rows(fixed.ALLOWLIST)),
    )


def load(spark: SparkSession, brands: str, keywords: str, schemes: str, allowlist: str, scoring: str) -> Reference:
    """From five JSON documents, given by path, in any store that Spark reads."""

    def one(path: str, schema):
        return spark.read.schema(schema).json(path, multiLine=True).first()

    watched = one(brands, schemas.BRANDS_FILE).brands or []
    words = one(keywords, schemas.KEYWORDS_FILE).keywords or []
    lures = one(schemes, schemas.SCHEMES_FILE).schemes or []
    allowed = one(allowlist, schemas.ALLOWLIST_FILE).entries or []
    s = one(scoring, schemas.SCORING_FILE)
    weights = {**fixed.WEIGHTS, **{k: v for k, v in (s.weights or {}).items() if v is not None}}
    return Reference(
        tuple(Brand(b.id, b.display, b.category, tuple(b.tokens or ()), b.max_edit_distance, bool(b.require_context), bool(b.allow_affix), tuple(b.context_tokens or ()), tuple(b.known_tlds or ())) for b in watched),
        tuple(Keyword(k.token, k.category, bool(k.affix)) for k in words),
        tuple(Scheme(x.id, x.display, tuple(x.tokens or ()), x.max_edit_distance or 0, x.official_registrable or "", x.active_window.start if x.active_window else None, x.active_window.end if x.active_window else None) for x in lures),
        tuple(Allowed(a.registrable, a.brand, bool(a.verified)) for a in allowed),
        Scoring(s.version, s.thresholds.dashboard_min, s.thresholds.digest_min, s.thresholds.alert_min, s.caps.total if s.caps and s.caps.total is not None else 100, weights),
    )


def frames(spark: SparkSession, ref: Reference) -> dict[str, DataFrame]:
    """The tables as DataFrames, for the dataset explorer and the validation."""
    return {
        "brands": spark.createDataFrame([(b.id, b.display, b.category, list(b.tokens), b.max_edit_distance, b.require_context, b.allow_affix, list(b.context_tokens), list(b.known_tlds)) for b in ref.brands], schemas.BRAND),
        "keywords": spark.createDataFrame([(k.token, k.category, k.affix) for k in ref.keywords], schemas.KEYWORD),
        "schemes": spark.createDataFrame([(x.id, x.display, list(x.tokens), x.max_edit_distance, x.official_registrable, (x.start, x.end) if x.start else None) for x in ref.schemes], schemas.SCHEME),
        "allowlist": spark.createDataFrame([(a.registrable, a.brand, a.verified) for a in ref.allowlist], schemas.ALLOWED),
        "weights": spark.createDataFrame(sorted(ref.scoring.weights.items()), "name string, points int"),
        "thresholds": spark.createDataFrame([(ref.scoring.medium, ref.scoring.high, ref.scoring.critical, ref.scoring.cap)], "medium int, high int, critical int, cap int"),
    }
