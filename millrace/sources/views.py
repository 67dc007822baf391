"""Builds, commits, deploy events and sessions as views over star-schema tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import derive

AS_OF = datetime(2001, 8, 15, tzinfo=timezone.utc)
END = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plus_days(c: str, days: str) -> str:
    return f"{c} + make_dt_interval(cast({days} as int))"


def raw_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One build an order: its lines are the work, its customer's segment the group."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit(END).cast("timestamp_ntz"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    b = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    deployed = f"case when o_orderstatus <> 'P' then {_plus_days('o_orderdate', '1 + o_orderkey % 5')} end"
    usage = "case when o_orderstatus = 'P' or o_orderkey % 7 = 0 then null when o_orderkey % 5 = 0 then 0D else q end"
    b = b.selectExpr(
        "concat('b-', o_orderkey) as build_id", "o_orderkey", "c_mktsegment as grp", f"{_plus_days('o_orderdate', '-(1 + o_orderkey % 14)')} as first_commit", "o_orderdate as ts", f"{deployed} as deployed", f"{usage} as usage",
        "cast(cast(q as bigint) as double) as loc_added", "cast(n * 3 as double) as loc_removed", "cast(case when o_orderkey % 13 <> 0 then r end as double) as bugs", "case when o_orderkey % 17 <> 0 then o_totalprice / 100 end as cost_usd",
        "case o_orderpriority when '1-URGENT' then 'correctness' when '2-HIGH' then 'performance' when '3-MEDIUM' then 'features' when '5-LOW' then 'economics' else 'unspecified' end as question",
        "case when o_orderstatus = 'P' and o_orderkey % 2 = 0 then concat('b-', o_orderkey + 1) end as carried_into",
    )
    return b.withColumn("served", F.expr(f"case when usage > 0 and o_orderkey % 11 <> 0 then {_plus_days('deployed', 'o_orderkey % 9')} end")).drop("o_orderkey")


def builds(spark: SparkSession, sf_dir: str, window_spec: str = "month") -> DataFrame:
    """Typed and derived builds; those without lines lack a required field and are left out."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    b = raw_builds(spark, sf_dir).filter("loc_added IS NOT NULL AND loc_removed IS NOT NULL")
    b = b.select(
        "build_id", "grp", F.col("ts").cast("timestamp").alias("ts_at"), F.col("first_commit").cast("timestamp").alias("first_commit_at"), F.col("deployed").cast("timestamp").alias("deployed_at"), F.col("served").cast("timestamp").alias("served_at"), F.col("ts").alias("ts_wall"),
        *[F.concat(F.date_format(c, iso), F.lit("+00:00")).alias(f"{c}_text") for c in ("ts", "first_commit", "deployed", "served")],
        "usage", "loc_added", "loc_removed", "bugs", "cost_usd", "question", "carried_into",
    )
    return derive(b, window_spec)


def written_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The builds as text, as a CSV may have them: five ways of writing a time, blanks, and values that are none."""
    b = raw_builds(spark, sf_dir).withColumn("n", F.expr("cast(substr(build_id, 3) as bigint)"))
    iso = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    day = "date_format(ts, 'yyyy-MM-dd')"
    stamp = (
        f"case when n % 29 = 0 then 'not a date' when n % 31 = 0 then '   ' when n % 7 = 0 then date_format(ts, 'dd/MM/yyyy') when n % 7 = 1 then date_format(ts, 'yyyy/MM/dd') when n % 7 = 2 then concat({day}, 'T23:30:00-05:30') "
        f"when n % 7 = 3 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') when n % 7 = 4 then concat({iso.format('ts')}, 'Z') else {day} end"
    )
    return b.selectExpr(
        "build_id", "case when n % 53 = 0 then ' ' else grp end as `group`", "date_format(first_commit, 'yyyy-MM-dd') as first_commit_ts", f"{stamp} as ts", f"case when n % 37 = 0 and deployed is not null then '2001-13-45' else {iso.format('deployed')} end as deployed_at", f"{iso.format('served')} as served_at",
        "case when n % 43 = 0 then 'nan' else cast(usage as string) end as usage", "case when n % 41 = 0 then 'many' else cast(loc_added as string) end as loc_added", "cast(loc_removed as string) as loc_removed", "case when n % 3 = 0 then concat(cast(bugs as bigint), '.5') else cast(cast(bugs as bigint) as string) end as bugs",
        "cast(cost_usd as string) as cost_usd", "case when n % 47 = 0 then 'whim' when question = 'unspecified' then null else question end as question", "carried_into",
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, at, author, subject, files, insertions, deletions of one commit an event."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    sixth = e.agg(F.greatest(F.lit(1).cast("long"), F.expr("count(*) div 6")).alias("sixth"))
    e = e.crossJoin(F.broadcast(sixth)).withColumn("tick", F.col("event_id") % F.col("sixth"))  # one row
    subject = F.expr(
        "case when event_id % 10 <= 5 then concat('PROJ-', tick, ': ', event_type) when event_id % 10 = 6 then concat('enable flag: feat-', tick % 50) "
        "when event_id % 10 = 7 then concat('feat(mod', tick % 40, '): ', event_type) when event_id % 10 = 8 then concat('Revert \"', event_type, ' change ', tick % 60, '\"') "
        "else concat(event_type, ' tweak area', k % 12) end"
    )
    files = F.expr("case when event_id % 25 = 0 then array('.github/workflows/ci.yml') else array(concat('src/mod', user_id % 8, '/f', k, '.ts')) end")
    return e.select(F.format_string("%08d", "event_id").alias("sha"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("author"), subject.alias("subject"), files.alias("files"), F.floor("value").cast("long").alias("insertions"), (F.col("k") % 20).alias("deletions"), "tick")


def deploy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """at, hint: three days after the first commit of two tickets in three."""
    tickets = commits(spark, sf_dir).filter(F.col("subject").startswith("PROJ-") & (F.col("tick") % 3 != 0))
    return tickets.groupBy("tick").agg((F.min("at") + F.expr("interval 3 days")).alias("at")).select("at", F.concat(F.lit("proj-"), F.col("tick").cast("string")).alias("hint"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, parent, effort, commits (null: not known)."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('s-', event_id) as sid",
        "case when event_id % 6 = 0 or event_id % 30 in (7, 11) then null else concat('s-', event_id - event_id % 6 + (event_id % 6 - 1) div 2) end as parent",
        "value as effort", "cast(case event_type when 'error' then null when 'view' then 0 when 'purchase' then 2 else event_id % 2 end as bigint) as commits",
    )
