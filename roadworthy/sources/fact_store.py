"""The fact as a table that is refreshed prefix by prefix.

The reduced inputs (one row per vehicle and day, one per vehicle, one fuel
class per vehicle) and the fact itself are kept as tables partitioned by the
plate's prefix shard and bucketed by plate, all with the same number of
buckets.  A bucket holds the same plates in every table, so the joins of
the fact (J1-J3) read their sides bucket by bucket, without an exchange.

Beside the tables lies a manifest: the fingerprint of every prefix of every
raw table (over the columns the build reads).  A refresh compares it with the
inputs as they are now, reduces only the prefixes that differ, joins only those, and overwrites
only their partitions (dynamic partition overwrite); a prefix whose rows are gone is
dropped.  The manifest is written last: a refresh that ended early is done again.

Only the manifest (at most 37 prefixes of four tables) reaches the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roadworthy import params as P
from roadworthy.operators import facts
from roadworthy.session import path_exists, remove_path, session_setting
from roadworthy.sources.bindings import Sources
from roadworthy.sources.ingest import OTHER_SHARD, fingerprints, shard_of

SHARD = "shard"
#: Columns of each stored table, in order; ``shard`` follows as partition.
TABLES: dict[str, str] = {
    "reports": f"{P.KENTEKEN} string, {P.MELD_DATUM} string, {P.MELD_TIJD} string, defect_count bigint, insp_year int",
    "vehicles": f"{P.KENTEKEN} string, {P.MERK} string, {P.HANDELSBENAMING} string, {P.DATUM_EERSTE_TOELATING} string, "
                f"{P.CATALOGUSPRIJS} double, vehicle_type_group string",
    "fuel": f"{P.KENTEKEN} string, primary_fuel string",
    "fact": f"{P.KENTEKEN} string, {P.MELD_DATUM} string, {P.MELD_TIJD} string, {P.MERK} string, {P.HANDELSBENAMING} string, "
            f"{P.CATALOGUSPRIJS} double, vehicle_type_group string, primary_fuel string, insp_year int, age_at_inspection int, defect_count bigint",
}
#: The raw columns each stored table is built from.
READS: dict[str, dict[str, list[str]]] = {
    "reports": {"inspections": [P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.SOORT_MELDING],
                "defects": [P.KENTEKEN, P.MELD_DATUM, P.MELD_TIJD, P.AANTAL_GEBREKEN]},
    "vehicles": {"vehicles": [P.KENTEKEN, P.VOERTUIGSOORT, P.MERK, P.HANDELSBENAMING, P.DATUM_EERSTE_TOELATING, P.CATALOGUSPRIJS]},
    "fuel": {"fuel": [P.KENTEKEN, P.BRANDSTOF]},
}


def with_shard(df: DataFrame) -> DataFrame:
    """Rows with the prefix shard of their plate; plates that no prefix fits share one."""
    return df.withColumn(SHARD, F.coalesce(shard_of(F.col(P.KENTEKEN)), F.lit(OTHER_SHARD)))


@dataclass
class Refresh:
    """What a refresh rewrote: the prefixes of each stored table."""

    rewritten: dict[str, list[str]] = field(default_factory=dict)
    dropped: dict[str, list[str]] = field(default_factory=dict)


class FactStore:
    """The stored tables below ``base``; ``buckets`` is fixed when a store is made."""

    def __init__(self, spark: SparkSession, base: str, buckets: int | None = None):
        self.spark, self.base = spark, base.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self.names = {t: f"roadworthy_{hashlib.md5(self.base.encode()).hexdigest()[:12]}_{t}" for t in TABLES}
        for table, columns in TABLES.items():
            if not spark.catalog.tableExists(self.names[table]):
                spark.sql(f"""CREATE TABLE {self.names[table]} ({columns}, {SHARD} string) USING parquet OPTIONS (compression 'zstd')
                    PARTITIONED BY ({SHARD}) CLUSTERED BY ({P.KENTEKEN}) SORTED BY ({P.KENTEKEN}) INTO {self.buckets} BUCKETS
                    LOCATION '{self._folder(table)}'""")
                if path_exists(spark, self._folder(table)):
                    spark.sql(f"ALTER TABLE {self.names[table]} RECOVER PARTITIONS")

    def _folder(self, table: str) -> str:
        return f"{self.base}/{table}"

    def table(self, name: str, shards: list[str] | None = None) -> DataFrame:
        """A stored table, or some of its prefixes (partitions are pruned)."""
        df = self.spark.table(self.names[name])
        return df.where(F.col(SHARD).isin(*shards)) if shards is not None else df

    def fact(self) -> DataFrame:
        """The fact as last refreshed."""
        return self.table("fact").drop(SHARD)

    def forget(self) -> None:
        """Take the tables out of the catalog; the files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    # -- manifest -------------------------------------------------------------

    def _manifest(self) -> dict[tuple[str, str], tuple]:
        path = f"{self.base}/manifest"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            return {}
        return {(r["table"], r[SHARD]): (r["rows"], r["digest_high"], r["digest_low"]) for r in self.spark.read.parquet(path).collect()}

    def _save_manifest(self, now: dict[tuple[str, str], tuple]) -> None:
        rows = [(t, s, *d) for (t, s), d in sorted(now.items())]
        df = self.spark.createDataFrame(rows, f"table string, {SHARD} string, rows bigint, digest_high string, digest_low string")
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifest")

    def _inputs(self, src: Sources) -> dict[tuple[str, str], tuple]:
        """The fingerprint of every prefix of every raw table."""
        per_table = [
            fingerprints(with_shard(getattr(src, raw).select(*columns)), [SHARD], columns).withColumn("table", F.lit(raw))
            for reads in READS.values() for raw, columns in reads.items()
        ]
        return {(r["table"], r[SHARD]): (r["rows"], r["digest_high"], r["digest_low"])
                for r in reduce(DataFrame.unionByName, per_table).collect()}

    # -- refresh --------------------------------------------------------------

    def _overwrite(self, table: str, rows: DataFrame, shards: list[str], done: Refresh) -> None:
        """Replace the partitions of ``shards`` by ``rows``, which hold no others."""
        columns = [f.name for f in self.spark.table(self.names[table]).schema.fields]
        seen = Observation(f"{table}-{len(done.rewritten)}")
        # The metrics come with the write, so the prefixes that still have rows cost no second look.
        observed = with_shard(rows).select(*columns).observe(seen, F.collect_set(SHARD).alias("shards"), F.count(F.lit(1)).alias("rows"))
        with session_setting(self.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            observed.write.insertInto(self.names[table], overwrite=True)
        left = set(seen.get["shards"] or [])
        gone = sorted(set(shards) - left)
        for shard in gone:
            self.spark.sql(f"ALTER TABLE {self.names[table]} DROP IF EXISTS PARTITION ({SHARD}='{shard}')")
            remove_path(self.spark, f"{self._folder(table)}/{SHARD}={shard}")
        done.rewritten[table], done.dropped[table] = sorted(left), gone

    def refresh(self, src: Sources, on_bad: str = "raise") -> Refresh:
        """Bring the store up to the inputs; prefixes whose input did not change are not touched."""
        before, now, done = self._manifest(), self._inputs(src), Refresh()
        changed = {key for key in before.keys() | now.keys() if before.get(key) != now.get(key)}
        everything: set[str] = set()
        for table, reads in READS.items():
            shards = sorted({s for raw, s in changed if raw in reads})
            if not shards:
                continue
            everything |= set(shards)
            raw = {name: with_shard(getattr(src, name)).where(F.col(SHARD).isin(*shards)).drop(SHARD) for name in reads}
            if table == "reports":
                rows = facts.primary_reports_with_counts(raw["inspections"], raw["defects"], on_bad)
            elif table == "vehicles":
                rows = facts.vehicle_attributes(raw["vehicles"], on_bad)
            else:
                rows = facts.primary_fuel(raw["fuel"])
            # A plate that is null matches no other in the joins, so it need not be stored.
            rows = rows.where(F.col(P.KENTEKEN).isNotNull()).repartition(self.buckets, P.KENTEKEN)
            self._overwrite(table, rows, shards, done)
        if everything:
            shards = sorted(everything)
            self._overwrite("fact", self.joined(shards, on_bad), shards, done)
            self._save_manifest(now)
        return done

    def joined(self, shards: list[str] | None = None, on_bad: str = "raise") -> DataFrame:
        """J1-J3 over the stored reduced inputs (of some prefixes): no exchange, as all share their buckets."""
        side = lambda t: self.table(t, shards).drop(SHARD)
        return facts.join_reports(side("reports"), side("vehicles"), side("fuel"), on_bad)
