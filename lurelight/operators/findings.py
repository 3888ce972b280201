"""Findings: merging arrivals, sightings, run summaries, feeds, keyed tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text

#: Order in which sources arrive within a run.
SOURCES = ["certstream", "direct_ct", "static_ct", "crtsh"]


def source_rank(source: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SOURCES)), source), F.lit(0)).cast("int")


def arrival(entries: DataFrame) -> Column:
    """The order in which a run's entries arrive, told by the entries alone, so that
    a replay gives the same: by source, index in it, and a digest of the record."""
    index = F.coalesce(F.col("cert_index"), F.col("entry_id"))
    return F.struct(source_rank(F.col("source")), index, F.xxhash64(*[F.col(f.name) for f in schemas.ENTRY]))


def first_by(value: Column, order: Column) -> Column:
    """The first non-null value in the order; an aggregate with partial sums."""
    return F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), order))


def union_in_order(rows: DataFrame, arrays: str, order: str) -> DataFrame:
    """id and the distinct elements of the arrays of its rows, first appearance
    first. Elements are reduced to one row each before they meet, so an id that
    arrives very often is no large group."""
    each = rows.select("id", F.col(order).alias("_o"), F.posexplode(arrays).alias("_p", "_v")).groupBy("id", "_v").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    return each.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(arrays))


def unique_findings(findings: DataFrame, order: str = "arrival") -> DataFrame:
    """One row for each id: the first arrival's fields, but entry types and
    domains in union, the earliest time, the first serial and issuer hash that are
    there, and after a merge as many names as domains. All aggregates are partial,
    so no id's rows are gathered."""
    o = F.col(order)
    kept = [c for c in findings.columns if c not in ("id", order, "entry_types", "domains", "observed_at", "san_count", "cert_serial", "cert_issuer_dn_sha256")]
    out = findings.groupBy("id").agg(
        F.min_by(F.struct(*kept, "san_count"), o).alias("_first"),
        F.min("observed_at").alias("observed_at"),
        first_by(text.truthy(F.col("cert_serial")), o).alias("cert_serial"),
        first_by(text.truthy(F.col("cert_issuer_dn_sha256")), o).alias("cert_issuer_dn_sha256"),
        F.count("*").alias("_n"),
    )
    none = F.array().cast("array<string>")
    for c in ("entry_types", "domains"):
        out = out.join(union_in_order(findings, c, order), "id", "left").withColumn(c, F.coalesce(c, none))
    many = F.when(F.col("_n") > 1, F.size("domains")).otherwise(F.col("_first.san_count"))
    made = {c: F.col(f"_first.{c}") for c in kept} | {"san_count": many.cast("int")}
    return out.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in findings.columns if c != order])


def source_ref(source: Column, run_source: Column, finding_id: Column) -> Column:
    return F.coalesce(text.truthy(source["source_ref"]), text.truthy(source["fingerprint"]), text.truthy(source["cert_link"]), F.concat(run_source, F.lit(":"), finding_id))


def sightings(findings: DataFrame, run_source: str = "run_source", order: str = "arrival") -> DataFrame:
    """A row for each (finding, source, reference); the last arrival wins."""
    details = F.struct(
        "domains", "registrable", "severity", "score", text.truthy(F.col("cert_serial")).alias("cert_serial"), F.coalesce("entry_types", F.array().cast("array<string>")).alias("entry_types"),
        F.coalesce(F.when(F.col("san_count") != 0, F.col("san_count")), F.size("domains"), F.lit(0)).alias("san_count"), F.col("source.cert_index").alias("cert_index"), F.col("source.cert_link").alias("cert_link"),
        F.col("source.fingerprint").alias("fingerprint"), F.col("source.log_name").alias("log_name"), F.col("source.log_operator").alias("log_operator"),
    )
    rows = findings.select(
        F.col("id").alias("finding_id"),
        F.col(run_source).alias("source"),
        source_ref(F.col("source"), F.col(run_source), F.col("id")).alias("source_ref"),
        F.struct("observed_at", details.alias("details")).alias("rest"),
        F.col(order).alias("o"),
    )
    return rows.groupBy("finding_id", "source", "source_ref").agg(F.max_by("rest", "o").alias("rest")).select("finding_id", "source", "source_ref", "rest.*")


def summarize_runs(runs: DataFrame, matched: DataFrame, rows: DataFrame) -> DataFrame:
    """``runs`` (source, ...) with matched and persisted counts of their source, 0
    where there is nothing. The counts are a row for each source."""
    m = matched.groupBy("source").agg(F.count("*").cast("int").alias("matched"))
    p = rows.groupBy("source").agg(F.count("*").cast("int").alias("persisted"))
    keep = [c for c in runs.columns if c not in ("matched", "persisted")]
    return runs.select(keep).join(m, "source", "left").join(p, "source", "left").fillna(0, ["matched", "persisted"])


def poll_status(runs: DataFrame) -> DataFrame:
    """One row: healthy if all runs are ok, partial if some, else down. Errors are
    counted from ``n_errors`` where there is such a column, else from ``errors``."""
    n_errors = F.col("n_errors") if "n_errors" in runs.columns else F.size(F.coalesce("errors", F.array().cast("array<struct<message:string>>")))
    return runs.agg(
        F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok"),
        F.when(F.coalesce(F.bool_and("ok"), F.lit(True)), "healthy").when(F.bool_or("ok"), "partial").otherwise("down").alias("health"),
        F.coalesce(F.sum("scanned_entries"), F.lit(0)).cast("long").alias("scanned_entries"),
        F.count("*").alias("sources"),
        F.sum(n_errors).cast("long").alias("errors"),
    )


def run_errors(runs: DataFrame) -> DataFrame:
    return runs.select("source", F.explode("errors").alias("error")).select("source", "error.*")


def clamp_limit(limit, default: int, most: int = 100) -> int:
    """A page size: not a number or 0 gives the default, else 1 to ``most``."""
    try:
        n = int(float(limit))
    except (TypeError, ValueError):
        n = 0
    return max(1, min(most, n or default))


def feed(findings: DataFrame, limit=None) -> DataFrame:
    """The newest findings that are not suppressed: a top-k, no sort of all."""
    return findings.filter(~F.col("suppressed")).orderBy(F.desc("observed_at"), "id").limit(clamp_limit(limit, 50))


def annotated(findings: DataFrame) -> DataFrame:
    """With the names of their sources."""
    name = text.source_of_link(F.col("source.name"), F.col("source.cert_link"))
    return findings.withColumn("sources", F.when(name.isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>"))).withColumn("source_count", F.size("sources"))


def recent_runs(runs: DataFrame, limit=None) -> DataFrame:
    return runs.orderBy(F.desc("checked_at"), "source").limit(clamp_limit(limit, 24))


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key, without sorting keys' rows."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("r")).select(key, "r.*")


class Batches:
    """Named batches of rows as Parquet folders side by side.

    A batch counts once its job is complete; of a job that broke nothing is read. A
    batch whose name is known already is not written again, so a replay leaves the
    table as it was, whatever became of the first attempt's successors. One writer at
    a time; readers need no lock."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _found(self, pattern: str) -> list[tuple[str, int]]:
        """(first folder below the table, time in ms) of the files of a pattern."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p) or []
        up = pattern.count("/")

        def folder(path):
            for _ in range(up):
                path = path.getParent()
            return path.getName()

        return [(folder(f.getPath()), f.getModificationTime()) for f in found]

    def _batches(self) -> list[tuple[int, str]]:
        """(place, folder) of the complete batches; of a name the first one."""
        first: dict[str, tuple[int, str]] = {}
        for folder, _ in self._found("batch=*/_SUCCESS"):
            place, name, _ = folder.removeprefix("batch=").split("-")
            first[name] = min(first.get(name, (int(place), folder)), (int(place), folder))
        return sorted(first.values())

    def has(self, name: str) -> bool:
        return any(folder.split("-")[1] == name for _, folder in self._batches())

    def _next(self) -> int:
        return 1 + max((place for place, _ in self._batches()), default=0)

    def add(self, rows: DataFrame, name: str | None = None) -> bool:
        """Writes the rows as a batch; false where its name is known. ``name``
        (letters, digits, dots and underscores) tells a batch that may come again."""
        name = name or uuid.uuid4().hex
        if self.has(name):
            return False
        out = rows.select([f.name for f in self.schema])
        # a folder of its own for each attempt: a complete batch is never touched
        out.write.parquet(f"{self.path}/batch={self._next():012d}-{name}-{uuid.uuid4().hex}")
        return True

    def read(self) -> DataFrame:
        """The rows of all batches."""
        paths = [f"{self.path}/{folder}" for _, folder in self._batches()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


class KeyedTable(Batches):
    """Rows by key: of a key's rows the one of the latest batch counts. In a batch
    keys are unique.

    ``compact`` writes the rows that count as a new base, with the names of the batches
    that it holds, and marks it last; readers take the latest marked base and the
    batches behind it. What a base replaces stays for ``grace`` seconds, so that
    whoever listed it can read it to the end, and goes with a later compaction.
    ``merge`` compacts by itself when ``most`` batches stand behind the base."""

    def __init__(self, spark: SparkSession, path: str, schema, key: list[str], most: int = 64, grace: float = 86_400):
        super().__init__(spark, path, schema)
        self.key, self.most, self.grace = key, most, grace

    def _base(self) -> tuple[int, str] | None:
        """(place, folder) of the latest marked base."""
        return max(((int(folder.split("-")[1]), folder) for folder, _ in self._found("base-*/done")), default=None)

    def _behind(self, base: tuple[int, str] | None) -> list[tuple[int, str]]:
        return [b for b in self._batches() if base is None or b[0] > base[0]]

    def _next(self) -> int:
        base = self._base()
        return max(super()._next(), 1 + base[0] if base else 0)

    def has(self, name: str) -> bool:
        if super().has(name):
            return True
        base = self._base()
        return base is not None and not self.spark.read.schema("name string").parquet(f"{self.path}/{base[1]}/names").filter(F.col("name") == name).isEmpty()

    def _rows(self, base: tuple[int, str] | None, behind: list[tuple[int, str]]) -> DataFrame:
        """The rows that count; a base alone is read as it is."""
        read, names = self.spark.read.schema(self.schema), [f.name for f in self.schema]
        first = read.parquet(f"{self.path}/{base[1]}/rows") if base else None
        if not behind:
            return first if first is not None else self.spark.createDataFrame([], self.schema)
        # the place is in the folder's name
        place = F.regexp_extract(F.col("_metadata.file_path"), "/batch(?:=|%3D)(\\d+)-[^/]*/[^/]*$", 1).cast("long")
        every = read.parquet(*[f"{self.path}/{folder}" for _, folder in behind]).select(*names, place.alias("_place"))
        if first is not None:
            every = first.withColumn("_place", F.lit(0).cast("long")).unionByName(every)
        rest = [c for c in every.columns if c not in self.key]
        return every.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "_place").alias("r")).select(*self.key, "r.*").select(names)

    def read(self) -> DataFrame:
        base = self._base()
        return self._rows(base, self._behind(base))

    def get(self, **key) -> DataFrame:
        """The rows of these key values; they reach the files as filters."""
        d = self.read()
        for column, value in key.items():
            d = d.filter(F.col(column) == F.lit(value))
        return d

    def merge(self, batch: DataFrame, name: str | None = None) -> None:
        """Rows of the batch replace those of equal key."""
        if self.add(batch, name) and len(self._behind(self._base())) >= self.most:
            self.compact()

    def compact(self) -> None:
        base = self._base()
        behind = self._behind(base)
        if behind:
            new = f"{self.path}/base-{behind[-1][0]:012d}-{uuid.uuid4().hex}"
            self._rows(base, behind).write.parquet(f"{new}/rows")
            names = self.spark.createDataFrame([(folder.split("-")[1],) for _, folder in behind], "name string")
            if base:
                names = names.unionByName(self.spark.read.schema("name string").parquet(f"{self.path}/{base[1]}/names"))
            names.coalesce(1).write.parquet(f"{new}/names")
            done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{new}/done")
            done.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(done).close()
        self.clean()

    def clean(self) -> None:
        """Removes what a base has replaced for longer than the grace."""
        marked = sorted((int(folder.split("-")[1]), at, folder) for folder, at in self._found("base-*/done"))
        old = [m for m in marked if m[1] <= 1000 * (time.time() - self.grace)]
        if not old:
            return
        keep, fs = old[-1], self.spark._jvm.org.apache.hadoop.fs
        gone = [folder for _, _, folder in marked if folder < keep[2]] + [folder for folder, _ in self._found("batch=*/_SUCCESS") if int(folder[6:].split("-")[0]) <= keep[0]]
        for folder in gone:
            p = fs.Path(f"{self.path}/{folder}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
