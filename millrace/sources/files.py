"""File sources: CSV, JSON lines, JSON documents and git history, read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import Metric
from ..operators.prepare import blank_to_null, parse_timestamp
from .gitlog import GitSource, git

# Fixed names under which tools write the same thing.
COST_FIELDS, TOKEN_FIELDS, COMMIT_FIELDS = ("cost_usd", "usd", "cost"), ("tokens", "total_tokens", "token_count"), ("produced_commits", "commits", "commit_count")
ARCHIVE_TOKEN_FIELDS = ("tokens", "total_tokens", "token_count", "tokens_total")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, blank as null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    return df.select(*[blank_to_null(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns])


def read_builds_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path)


def read_cells_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path)


def read_metrics_csv(spark: SparkSession, path: str) -> list[Metric]:
    """Definitions, a handful; rows without a name or with `#` are left out."""
    out = []
    for r in _csv(spark, path).collect():
        d = r.asDict()
        if d.get("name") and not d["name"].startswith("#"):
            out.append(Metric(d["name"].strip(), (d.get("role") or "descriptor").strip(), (d.get("direction") or "min").strip(), d["expression"], int(d.get("version") or 1), (d.get("notes") or "").strip()))
    return out


def _plain_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Headerless CSV with `#` comments; short rows are padded with nulls."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).option("comment", "#").option("mode", "PERMISSIVE").csv(path)
    return df.select(*[F.trim(c).alias(c) for c in names]).filter(F.col(names[0]).isNotNull() & (F.col(names[0]) != "") & ~F.col(names[0]).startswith("#"))


def read_deploys(spark: SparkSession, path: str) -> DataFrame:
    """at, hint of each ship event; a time without an offset is UTC."""
    df = _plain_csv(spark, path, ["at", "hint"])
    return df.select(parse_timestamp(F.col("at")).getField("at").alias("at"), F.lower(F.coalesce("hint", F.lit(""))).alias("hint"))


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    df = _plain_csv(spark, path, ["label", "dollars", "engineer_months"]).filter("label <> 'label' AND engineer_months IS NOT NULL")
    return df.select("label", F.col("dollars").cast("double").alias("dollars"), F.col("engineer_months").cast("double").alias("engineer_months"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    df = _plain_csv(spark, path, ["model", "usd_per_million_tokens"]).filter("model <> 'model' AND usd_per_million_tokens IS NOT NULL")
    return df.select("model", F.col("usd_per_million_tokens").cast("double").alias("usd_per_million_tokens"))


def _first_number(v, names: tuple[str, ...]):
    """The first of the fields that holds a number or (as 1 and 0) a boolean."""
    out = []
    for n in names:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant"))
        number = F.when(kind == "BOOLEAN", F.try_variant_get(v, f"$.{n}", "boolean").cast("double")).when(kind != "STRING", F.try_variant_get(v, f"$.{n}", "double"))
        out.append(number)
    return F.coalesce(*out)


def read_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(sid, parent, effort, commits, repo of each line; the unit of effort).  Commits that nothing tells are null, not 0."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' AND NOT startswith(value, '#')")
    v = F.parse_json("value")
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    truthy = lambda n: F.coalesce(text(n), F.lit("")).isin("", "false", "0", "null") == False  # noqa: E712, E731
    some = lambda *names: F.coalesce(*[F.when(text(n) != "", text(n)) for n in names])
    cost, tokens, commits = _first_number(v, COST_FIELDS), _first_number(v, TOKEN_FIELDS), _first_number(v, COMMIT_FIELDS)
    commits = F.coalesce(commits, F.when(truthy("produced_pr") | truthy("produced_branch"), 1.0))
    df = lines.select(
        some("session_id", "id").alias("sid"), some("parent_session_id", "parent").alias("parent"), F.coalesce(cost, tokens, F.lit(0.0)).alias("effort"), commits.cast("long").alias("commits"), text("repo").alias("repo"),
        (cost.isNull() & tokens.isNotNull()).alias("_t"),
    ).filter("sid IS NOT NULL")
    unit = "tokens" if df.filter("_t").limit(1).count() else "usd"
    return df.drop("_t"), unit


def read_archive(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """tokens(archive, model, tokens), archetypes(archive, archetype, n), outcomes(archive, outcome, n) of session archives.

    `model_mix` may map models to numbers or to records, or list records; anything else is left out, never guessed.
    """
    docs = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("archive"), F.parse_json("value").alias("v"))

    def pairs(path: str) -> DataFrame:
        maps = docs.select("archive", F.try_variant_get("v", path, "map<string,variant>").alias("m")).filter("m IS NOT NULL")
        return maps.select("archive", F.explode("m").alias("key", "item"))

    def number(item, names: tuple[str, ...] = ()):
        return F.coalesce(F.try_variant_get(item, "$", "double"), *[F.try_variant_get(item, f"$.{n}", "double") for n in names])

    mapped = pairs("$.model_mix").select("archive", F.col("key").alias("model"), number("item", ARCHIVE_TOKEN_FIELDS).cast("long").alias("tokens"))
    listed = docs.select("archive", F.explode(F.try_variant_get("v", "$.model_mix", "array<variant>")).alias("item"))
    listed = listed.select("archive", F.coalesce(F.try_variant_get("item", "$.model", "string"), F.try_variant_get("item", "$.name", "string")).alias("model"), F.coalesce(*[F.try_variant_get("item", f"$.{n}", "double") for n in ARCHIVE_TOKEN_FIELDS]).cast("long").alias("tokens"))
    tokens = mapped.unionByName(listed).filter("model IS NOT NULL AND tokens IS NOT NULL")

    def first_of(names: tuple[str, ...], key: str, value: str) -> DataFrame:
        every = [pairs(f"$.{n}").select("archive", F.col("key").alias(key), number("item").alias(value), F.lit(i).alias("_i")) for i, n in enumerate(names)]
        got = every[0]
        for x in every[1:]:
            got = got.unionByName(x)
        got = got.filter(f"{value} IS NOT NULL")
        best = got.groupBy("archive").agg(F.min("_i").alias("_i"))
        return got.join(best, ["archive", "_i"]).drop("_i")

    return {
        "tokens": tokens,
        "archetypes": first_of(("session_archetypes", "archetypes"), "archetype", "n"),
        "outcomes": first_of(("outcomes.buckets", "outcome_stats.buckets", "outcomes", "outcome_stats"), "outcome", "n"),
    }


def read_runs(spark: SparkSession, paths: list[str]) -> list[dict]:
    """Earlier runs' documents with their labels: the workflow unless unknown, else the file's name; a clash gets a suffix."""
    import json

    out: dict[str, dict] = {}
    for path in paths:
        body = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))  # one document
        stem = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".json")
        label = body.get("workflow") or ""
        if not label or label.startswith("unknown"):
            label = stem
        if label in out:
            label = f"{label} [{stem}]"
        out[label] = body
    return [{"label": k, **v} for k, v in out.items()]


def parse_git_log(text: DataFrame) -> DataFrame:
    """sha, at, author, subject, files, insertions, deletions from rows `value` of `git log --numstat` records, as a dump has them.

    Fields are parted by 0x1f, records by 0x1e; a binary file has no line counts but is a file.
    """
    record = F.regexp_replace("value", "^\\s+", "")
    parts = F.split(record, "\x1f")
    stat = F.filter(F.split(F.element_at(parts, 5), "\n"), lambda x: F.trim(x) != "")
    cols = F.transform(stat, lambda x: F.split(F.trim(x), "\t"))
    cols = F.filter(cols, lambda c: F.size(c) >= 3)
    add = lambda i: F.aggregate(cols, F.lit(0).cast("long"), lambda a, c: a + F.coalesce(F.element_at(c, i).try_cast("long"), F.lit(0)))
    rows = text.filter(F.trim("value") != "").select(F.element_at(parts, 1).alias("sha"), parse_timestamp(F.element_at(parts, 2)).getField("at").alias("at"), F.element_at(parts, 3).alias("author"), F.element_at(parts, 4).alias("subject"), F.transform(cols, lambda c: F.element_at(c, 3)).alias("files"), add(1).alias("insertions"), add(2).alias("deletions"))
    return rows


def read_git_log(spark: SparkSession, repo: str | list[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """Commits without merges of repositories that every executor reaches; see `gitlog`."""
    spark.dataSource.register(GitSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses readers that take filters without it
    reader = spark.read.format(GitSource.name()).option("path", repo if isinstance(repo, str) else "\n".join(repo))
    for k, v in (("since", since), ("until", until)):
        reader = reader.option(k, v) if v else reader
    for one in [repo] if isinstance(repo, str) else repo:
        git(one, "rev-parse", "--git-dir")  # before anything is planned
    return reader.load()
