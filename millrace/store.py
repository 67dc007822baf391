"""Parquet store: builds, metrics, runs, results, ingests.

Data lie in folders that are written once.  What a table consists of is named by a manifest, one small file a version,
and a change - rows of several tables, or a run in place of its older self - is there when the next version's manifest
is: it is written aside and moved to its name last, which fails if another writer was faster, and the change is then made
again on what that one left.  A failure before that leaves folders that no manifest names; `vacuum` deletes them.

Builds are partitioned by a hash of the id, so an ingest reads the buckets of its batch only; runs and their results are
folders of their own, so one run is read, or replaced, without the others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.metrics import DEFAULTS, Metric, definitions_hash
from .operators.prepare import RAW_COLUMNS, blank_to_null
from .session import cut

#: Why a row whose id stands earlier in its batch is rejected.
TWIN = "build_id repeats"
REQUIRED = ("ts", "first_commit_ts", "loc_added", "loc_removed")
_BUILDS = ", ".join(f"`{c}` string" for c in RAW_COLUMNS) + ", source string, ingested_at timestamp"
SCHEMAS = {
    "builds": _BUILDS,
    "metrics": "name string, version int, role string, direction string, expression string, notes string, defined_at timestamp",
    "runs": "run_id string, ts timestamp, objectives string, roles_hash string, metric_versions string, params string, analysis string",
    "results": "run_id string, grp string, win string, n_builds long, layer long, p_on_front double, objectives string, descriptors string, impact_mix string",
    "ingests": "ingest_id string, ts timestamp, source string, accepted long, duplicate long, conflict long, rejected long",
    "issues": "ingest_id string, build_id string, status string, field string",
    "warnings": "run_id string, code string, row string, message string",
    "meta": "key string, value string",
}
SCHEMA_VERSION = "2"


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")).select(*keys, "_r.*")


def differs(a: Column, b: Column) -> Column:
    """As numbers if both are, to 1e-9; else as text.  Two blanks agree."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(a.isNull() & b.isNull(), False).when(a.isNull() | b.isNull(), True).when(x.isNotNull() & y.isNotNull(), F.abs(x - y) > 1e-9).otherwise(a != b)


def classify_ingest(batch: DataFrame, stored: DataFrame, order: str | None = None) -> DataFrame:
    """batch with status (accepted, duplicate, conflict, rejected) and field (all that are missing, or the first that differs).

    The first row of an id in input order stands for it, even if it is then rejected; later ones are rejected as TWIN.
    A column that the batch lacks counts as null throughout.  Nothing stored is ever changed.
    """
    given = batch.columns
    for c in RAW_COLUMNS:
        if c not in batch.columns:
            batch = batch.withColumn(c, F.lit(None).cast("string"))
    have = list(RAW_COLUMNS)
    text = batch.withColumns({c: blank_to_null(F.col(f"`{c}`").cast("string")) for c in have}).withColumn("build_id", blank_to_null(F.trim("build_id")))
    place = F.col(order) if order else F.monotonically_increasing_id()
    text = text.withColumn("_place", place)
    # rows without an id are nobody's twin, and must not meet in one task
    first = Window.partitionBy(F.coalesce("build_id", F.concat(F.lit("\0"), F.col("_place").cast("string")))).orderBy("_place")
    rows = text.withColumn("_k", F.row_number().over(first))
    old = stored.select(F.trim("build_id").alias("_id"), *[(blank_to_null(F.col(f"`{c}`").cast("string")) if c in stored.columns else F.lit(None).cast("string")).alias(f"_old_{c}") for c in have if c != "build_id"], F.lit(True).alias("_known"))
    rows = rows.join(old, F.col("build_id") == F.col("_id"), "left")
    none = [F.when(F.col(f"`{c}`").isNull(), c) for c in REQUIRED]
    missing = F.when(F.col("build_id").isNull(), "build_id").otherwise(F.nullif(F.concat_ws(", ", *none), F.lit("")))
    other = F.lit(None).cast("string")
    for c in reversed([c for c in have if c != "build_id"]):
        other = F.when(differs(F.col(f"`{c}`"), F.col(f"_old_{c}")), c).otherwise(other)
    rows = rows.withColumn("_missing", missing).withColumn("_other", other)
    repeat = F.col("build_id").isNotNull() & (F.col("_k") > 1)
    status = F.when(repeat | F.col("_missing").isNotNull(), "rejected").when(F.col("_known").isNull(), "accepted").when(F.col("_other").isNull(), "duplicate").otherwise("conflict")
    field = F.when(repeat, TWIN).when(F.col("_missing").isNotNull(), F.col("_missing")).when(F.col("_known").isNotNull(), F.col("_other"))
    out = rows.withColumn("status", status).withColumn("field", field)
    return out.select(*[F.col(f"`{c}`") for c in given], "status", "field")


class StoreChanged(RuntimeError):
    """Other writers were faster every time."""


#: Parts of the builds table by a hash of the id; attempts of a change; manifests that stay.
BUCKETS, ATTEMPTS, KEPT_VERSIONS = 64, 8, 20
Tables = dict[str, list[dict]]


def bucket_of(build_id: Column) -> Column:
    return F.pmod(F.xxhash64(build_id), F.lit(BUCKETS)).cast("int")


class Store:
    """Datasets under one folder, in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        if not self._versions():
            # folders of a store without manifests are its first version
            tables: Tables = {n: [{"path": n}] for n in SCHEMAS if self._fs.exists(self._at(n))}
            if "meta" not in tables:
                tables["meta"] = [self._written("meta", spark.createDataFrame([("schema_version", SCHEMA_VERSION)], SCHEMAS["meta"]))]
            self._publish(1, tables)

    # -- versions -----------------------------------------------------------

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self) -> list[int]:
        folder = self._at("_versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self) -> tuple[int, Tables]:
        """The newest version and the folders of its tables."""
        version = self._versions()[-1]
        with_ = self._fs.open(self._at(f"_versions/{version:012d}.json"))
        try:
            return version, json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8"))
        finally:
            with_.close()

    def _publish(self, version: int, tables: Tables) -> bool:
        """Make `tables` the given version; False if there is one already."""
        aside = self._at(f"_versions/_{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._at(f"_versions/{version:012d}.json")), self.spark.sparkContext._gateway.new_array(rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        for old in self._versions()[:-KEPT_VERSIONS]:
            self._fs.delete(self._at(f"_versions/{old:012d}.json"), False)
        return True

    def _change(self, make: Callable[[Tables], tuple[Tables, object]]):
        """Publish make(tables)'s new tables, made again if another change came first; what it returned beside them."""
        for _ in range(ATTEMPTS):
            version, tables = self.snapshot()
            changed, result = make({n: list(parts) for n, parts in tables.items()})
            if self._publish(version + 1, changed):
                return result
        raise StoreChanged(f"{ATTEMPTS} attempts at {self.path}")

    def vacuum(self) -> int:
        """Delete folders of data that no kept version names, such as failed changes leave; no writer may be at work."""
        named = set()
        for version in self._versions():
            with_ = self._fs.open(self._at(f"_versions/{version:012d}.json"))
            named |= {part["path"] for parts in json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")).values() for part in parts}
            with_.close()
        gone = 0
        for name in SCHEMAS:
            folder = self._at(f"data/{name}")
            for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f"data/{name}/{f.getPath().getName()}" not in named:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        return gone

    def _written(self, name: str, df: DataFrame, **tags) -> dict:
        """A new folder of the table with these rows; it counts once a version names it."""
        path = f"data/{name}/part={uuid.uuid4().hex}"
        if name == "builds":
            rows = df.withColumn("bucket", bucket_of(F.col("build_id")))
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{path}")
        else:
            df.write.parquet(f"{self.path}/{path}")
        return {"path": path, **tags}

    def read(self, name: str, tables: Tables | None = None, buckets: list[int] | None = None, **tags) -> DataFrame:
        """A table, or its builds of some buckets, or its folders with the given tags."""
        parts = (self.snapshot()[1] if tables is None else tables).get(name, [])
        parts = [p for p in parts if all(p.get(k, v) == v for k, v in tags.items())]
        cut_ = [f"{self.path}/{p['path']}" for p in parts if p["path"].startswith("data/builds/")]
        whole = [f"{self.path}/{p['path']}" for p in parts if not p["path"].startswith("data/builds/")]
        out = []
        if cut_:
            rows = self.spark.read.option("basePath", f"{self.path}/data/builds").schema(f"{SCHEMAS[name]}, part string, bucket int").parquet(*cut_)
            out.append((rows.filter(F.col("bucket").isin(buckets)) if buckets is not None else rows).drop("part", "bucket"))
        if whole:
            out.append(self.spark.read.schema(SCHEMAS[name]).parquet(*whole))
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], SCHEMAS[name])

    def _append(self, name: str, df: DataFrame) -> None:
        part = self._written(name, df)
        self._change(lambda tables: (tables | {name: [*tables.get(name, []), part]}, None))

    # -- builds -------------------------------------------------------------

    def ingest(self, batch: DataFrame, source: str, order: str | None = None) -> dict:
        """Append what is new; report counts and, of each kind, the first rows.  The table `issues` has every conflict and rejection.

        Builds, report and issues appear together.
        """
        if order is None:  # the order of the input, kept for every attempt
            batch, order = cut(batch.withColumn("_input", F.monotonically_increasing_id())), "_input"

        def make(tables: Tables) -> tuple[Tables, dict]:
            ids = blank_to_null(F.trim(F.col("build_id").cast("string"))) if "build_id" in batch.columns else F.lit(None).cast("string")
            buckets = [r[0] for r in batch.select(bucket_of(ids)).distinct().collect()]  # BUCKETS at most
            marked = cut(classify_ingest(batch, self.read("builds", tables, buckets), order))
            return self._with_classified(tables, marked, source, {})

        return self._change(make)

    def commit_classified(self, marked: DataFrame, batch: str) -> dict | None:
        """Append the accepted of rows that have status and field already, with report and issues; None if this batch was committed before."""
        marked = cut(marked)

        def make(tables: Tables) -> tuple[Tables, dict | None]:
            if any(part.get("batch") == batch for part in tables.get("ingests", [])):
                return tables, None
            return self._with_classified(tables, marked, batch, {"batch": batch})

        return self._change(make)

    def _with_classified(self, tables: Tables, marked: DataFrame, source: str, tags: dict) -> tuple[Tables, dict]:
        rows = marked.filter("status = 'accepted'").select(*[(F.col(f"`{c}`") if c in marked.columns else F.lit(None)).cast("string").alias(c) for c in RAW_COLUMNS], F.lit(source).alias("source"), F.current_timestamp().alias("ingested_at"))
        rows = rows.withColumns({c: blank_to_null(F.trim(F.col(f"`{c}`")) if c == "build_id" else F.col(f"`{c}`")) for c in RAW_COLUMNS})
        counts = {r["status"]: r["n"] for r in marked.groupBy("status").agg(F.count("*").alias("n")).collect()}
        sizes = {s: counts.get(s, 0) for s in ("accepted", "duplicate", "conflict", "rejected")}
        ident = f"i-{len(tables.get('ingests', [])) + 1:05d}"  # a folder an ingest
        report = self.spark.createDataFrame([(ident, datetime.now(timezone.utc), source, *sizes.values())], SCHEMAS["ingests"])
        new = {"ingests": self._written("ingests", report, **tags)}
        if sizes["accepted"]:
            new["builds"] = self._written("builds", rows)
        if sizes["conflict"] or sizes["rejected"]:
            new["issues"] = self._written("issues", marked.filter(F.col("status").isin("conflict", "rejected")).select(F.lit(ident).alias("ingest_id"), "build_id", "status", "field"))
        some = lambda s: [(r["build_id"], r["field"]) for r in marked.filter(F.col("status") == s).select("build_id", "field").limit(50).collect()]
        done = {"ingest_id": ident, **sizes, "conflicts": some("conflict"), "rejections": some("rejected"), "accepted_ids": [b for b, _ in some("accepted")]}
        return tables | {n: [*tables.get(n, []), part] for n, part in new.items()}, done

    def builds(self, groups: list[str] | None = None) -> DataFrame:
        """In order of time, then id, as the texts were given."""
        rows = self.read("builds")
        rows = rows.filter(F.coalesce("group", F.lit("all")).isin(*groups)) if groups else rows
        return rows.orderBy("ts", "build_id")

    def groups(self) -> list[str]:
        return sorted(r[0] for r in self.read("builds").select(F.coalesce("group", F.lit("all"))).distinct().collect())

    def build_count(self) -> int:
        return self.read("builds").count()

    # -- metrics ------------------------------------------------------------

    def latest_metrics(self) -> list[Metric]:
        rows = latest(self.read("metrics"), ["name"], "version").orderBy("name").collect()
        return [Metric(r["name"], r["role"], r["direction"], r["expression"], r["version"], r["notes"] or "") for r in rows]

    def metric_history(self, name: str) -> list[dict]:
        return [r.asDict() for r in self.read("metrics").filter(F.col("name") == name).orderBy("version").collect()]

    def metric_at(self, name: str, version: int) -> dict | None:
        r = self.read("metrics").filter((F.col("name") == name) & (F.col("version") == version)).first()
        return r.asDict() if r else None

    def define(self, name: str, role: str, direction: str, expression: str, notes: str = "", version: int | None = None) -> Metric:
        """A new version unless expression, role and direction are what the latest one has; notes do not count."""
        new = Metric(name, role, direction, expression, version or 1, notes)
        old = {m.name: m for m in self.latest_metrics()}.get(name)
        if old and (old.expression, old.role, old.direction) == (expression, role, direction):
            return old
        new = Metric(name, role, direction, expression, version or (old.version + 1 if old else 1), notes)
        self._append("metrics", self.spark.createDataFrame([(new.name, new.version, role, direction, expression, notes, datetime.now(timezone.utc))], SCHEMAS["metrics"]))
        return new

    def seed(self) -> None:
        """Shipped definitions that are not there; an untouched first version of `cost` moves on to its second."""
        have = {m.name: m for m in self.latest_metrics()}
        for m in DEFAULTS:
            old = have.get(m.name)
            if old is None or (m.name == "cost" and old.version == 1 and m.version == 2):
                self.define(m.name, m.role, m.direction, m.expression, m.notes, m.version)

    def metrics(self, csv: list[Metric] | None = None) -> list[Metric]:
        """CSV over store over shipped definitions."""
        chosen = {m.name: m for m in DEFAULTS} | {m.name: m for m in self.latest_metrics()} | {m.name: m for m in csv or []}
        return list(chosen.values())

    # -- runs ---------------------------------------------------------------

    def next_run_id(self, day: datetime) -> str:
        stem = f"r-{day:%Y%m%d}-"
        return f"{stem}{self.read('runs').filter(F.col('run_id').startswith(stem)).count() + 1:03d}"

    def save_run(self, analysis: dict, warnings: DataFrame | None = None) -> str:
        """The run's document, a row for each of its cells, and every warning(code, row, message) about its input."""
        run = analysis["run"]
        metrics = run["metrics"]
        row = (run["run_id"], datetime.now(timezone.utc), json.dumps(run["objectives"]), run["roles_hash"], json.dumps({m["name"]: m["version"] for m in metrics}), json.dumps(run["params"], default=str), json.dumps(analysis, default=str))
        cells = [(run["run_id"], c["group"], c["window"], c["n_builds"], c["layer"], c["p_on_front"], json.dumps(c["objectives"]), json.dumps(c["descriptors"]), json.dumps(c["impact_mix"])) for c in analysis["cells"]]
        new = {"runs": self._written("runs", self.spark.createDataFrame([row], SCHEMAS["runs"]), run_id=run["run_id"])}
        if cells:
            new["results"] = self._written("results", self.spark.createDataFrame(cells, SCHEMAS["results"]), run_id=run["run_id"])
        if warnings is not None:
            new["warnings"] = self._written("warnings", warnings.select(F.lit(run["run_id"]).alias("run_id"), "code", "row", "message"), run_id=run["run_id"])

        def make(tables: Tables) -> tuple[Tables, None]:
            """A run saved again replaces what it was, in all tables at once."""
            for name in ("runs", "results", "warnings"):
                kept = []
                for part in tables.get(name, []):
                    if "run_id" not in part and self.read(name, {name: [part]}).filter(F.col("run_id") == run["run_id"]).limit(1).count():
                        part = self._written(name, self.read(name, {name: [part]}).filter(F.col("run_id") != run["run_id"]))  # a folder of several runs
                    if part.get("run_id") != run["run_id"]:
                        kept.append(part)
                tables[name] = [*kept, *([new[name]] if name in new else [])]
            return tables, None

        self._change(make)
        return run["run_id"]

    def load_run(self, run_id: str | None = None) -> dict:
        rows = self.read("runs", **({"run_id": run_id} if run_id else {}))
        r = (rows.filter(F.col("run_id") == run_id) if run_id else rows).orderBy(F.desc("ts"), F.desc("run_id")).first()
        if r is None:
            raise KeyError(f"no such run: {run_id or 'none stored'}")
        return json.loads(r["analysis"])

    def list_runs(self, limit: int = 20) -> list[dict]:
        return [r.asDict() for r in self.read("runs").select("run_id", "ts", "objectives", "roles_hash").orderBy(F.desc("ts"), F.desc("run_id")).limit(limit).collect()]


def roles_hash(metrics: list[Metric]) -> str:
    return definitions_hash(metrics)
