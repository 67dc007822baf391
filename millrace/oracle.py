"""DuckDB SQL for the registered queries: the same results by an independent engine."""

from __future__ import annotations

from .constants import ATTAINMENT_REPLICATES, BOOTSTRAP, IMPACT_CLASSES, PERMUTATIONS, QUESTION_CLASSES, SEED, SWEEP, UTILITY_SAMPLES

FORMULAS = {
    "bool_nulls": "share(not (bugs > 0 and usage > 25)) + count(bugs == 0 or cost_usd > 900)",
    "clip_pow": "sum(clip(bugs, 0, median(bugs))) + mean(loc_total) ** 0.5",
    "z": "z(mean(cost_usd))",
    "zero_division": "count(impact == bogus) + sum(cost_usd) / (count() - count())",
    "abs_sqrt_log": "abs(mean(bugs) - 2) + sqrt(mean(loc_total)) + log(+count()) - -mean(usage)",
    "elementwise": "sum(sqrt(bugs - 1)) + sum(log(usage)) + sum(abs(loc_added - loc_removed)) + p10(-loc_total)",
    "outside_domain": "sqrt(0 - count()) + count()",
}
#: Formulas that have something to say beside their value.
NOTED = {
    "divided": "sum(cost_usd) / (count() - count())",
    "inside": "sum(loc_total / bugs)",
    "power": "(0 - count()) ** 0.5",
    "level": "minmax(count() - count())",
    "flat": "z(count() * 0) + 1",
    "huge": "sum(cost_usd) * 10 ** 308 * 10 ** 5",
    "beyond": "minmax(sum(cost_usd) * 10 ** 308 * 10 ** 5)",
    "bounded": "sum(clip(bugs, 0, sum(bugs) / (count() - count())))",
    "plain": "count()",
}

_WRITTEN = """
w0 as (select *, date_trunc('day', ts) as day, case when o_orderkey % 47 = 0 then 'whim' when question = 'unspecified' then null else question end as asked,
  case when o_orderkey % 29 = 0 or (o_orderkey % 37 = 0 and deployed_at is not null) then 'BAD_TIMESTAMP' when o_orderkey % 31 = 0 or loc_added is null or o_orderkey % 41 = 0 or loc_removed is null then 'MISSING_REQUIRED' when o_orderkey % 47 = 0 then 'UNKNOWN_QUESTION' end as code from b1),
w1 as (select * replace (case when o_orderkey % 43 = 0 then null else usage end as usage, case when o_orderkey % 3 = 0 then round_even(bugs + 0.5, 0) else bugs end as bugs, date_trunc('day', first_commit) as first_commit),
  case when o_orderkey % 7 = 2 then day + interval 29 hours when o_orderkey % 7 in (3, 4) then date_trunc('second', ts) else day end as moment from w0 where code is null or code = 'UNKNOWN_QUESTION'),
w2 as (select *, case when served_at is not null then 'SERVED' when deployed_at is not null and (usage is null or usage > 0) then 'DEPLOYED' end as src from w1)"""

BUILDS = """li as (select l_orderkey, sum(l_quantity) q, count(*) n, count(*) filter (where l_returnflag = 'R') r from lineitem group by 1),
b0 as (select 'b-' || o_orderkey as build_id, o_orderkey, c_mktsegment as grp, o_orderdate - to_days(cast(1 + o_orderkey % 14 as int)) as first_commit, o_orderdate as ts,
  case when o_orderstatus <> 'P' then o_orderdate + to_days(cast(1 + o_orderkey % 5 as int)) end as deployed_at,
  case when o_orderstatus = 'P' or o_orderkey % 7 = 0 then null when o_orderkey % 5 = 0 then 0.0 else q end as usage,
  cast(cast(q as bigint) as double) as loc_added, cast(n * 3 as double) as loc_removed, cast(case when o_orderkey % 13 <> 0 then r end as double) as bugs,
  case when o_orderkey % 17 <> 0 then o_totalprice / 100 end as cost_usd,
  case o_orderpriority when '1-URGENT' then 'correctness' when '2-HIGH' then 'performance' when '3-MEDIUM' then 'features' when '5-LOW' then 'economics' else 'unspecified' end as question,
  case when o_orderstatus = 'P' and o_orderkey % 2 = 0 then 'b-' || (o_orderkey + 1) end as carried_into
  from orders join customer on c_custkey = o_custkey left join li on l_orderkey = o_orderkey where o_orderdate < timestamp '2001-08-01'),
b1 as (select *, case when usage > 0 and o_orderkey % 11 <> 0 then deployed_at + to_days(cast(o_orderkey % 9 as int)) end as served_at from b0)"""

PREPARED = (
    BUILDS
    + """,
b2 as (select *, loc_added + loc_removed as loc_total, deployed_at is not null as deployed, served_at is not null as served, strftime(ts, '%Y-%m') as win,
  case when served_at is not null then 'SERVED' when deployed_at is not null and (usage is null or usage > 0) then 'DEPLOYED' end as lead_time_source,
  date_diff('microsecond', first_commit, case when served_at is not null then served_at when deployed_at is not null and (usage is null or usage > 0) then deployed_at end) / 86400000000.0 as lead_time_days
  from b1 where loc_added is not null and loc_removed is not null),
wins as (select distinct win from b2 order by win desc limit 6),
b3 as (select * from b2 where win in (select win from wins)),
gate as (select quantile_cont(usage, 0.5) as u from b3 where served and usage is not null),
prep as (select b3.*, u, date_diff('microsecond', ts, timestamp '2001-08-15') / 86400000000.0 as age_days,
  case when date_diff('microsecond', ts, timestamp '2001-08-15') / 86400000000.0 < 30 then 'unresolved' when not deployed then case when carried_into is not null then 'carried' else 'sunk' end
    when usage is null or u is null then 'impactful' when usage >= u then 'impactful' when usage > 0 then 'low_impact' else 'liability' end as impact,
  deployed and (usage is null or u is null) as gate_unavailable from b3, gate)"""
)


def _share(name: str, column: str) -> str:
    return f"count(*) filter (where {column} = '{name}') / cast(count(*) as double) as share_{name}"


SHARES = ", ".join([*(_share(c, "impact") for c in IMPACT_CLASSES), *(_share(c, "question") for c in QUESTION_CLASSES)])
CELLS = (
    PREPARED
    + f""",
c0 as (select grp, win, count(*) as n_builds, avg(cost_usd) as cost, quantile_cont(lead_time_days, 0.5) as lead_time, sum(bugs) / nullif(sum(loc_total) / 1000, 0) as density,
  count(distinct lead_time_source) as n_sources, count(*) filter (where lead_time_source = 'DEPLOYED') / nullif(cast(count(lead_time_source) as double), 0) as fallback_share, {SHARES} from prep group by grp, win),
c1 as (select *, case when max(density) over () = min(density) over () then 0.5 + (density - min(density) over ()) / greatest(1.0, abs(min(density) over ())) else (density - min(density) over ()) / (max(density) over () - min(density) over ()) end as debt_defect from c0),
"""
    + "cells as (select *, "
    + ", ".join(f"case when {x} is null then null when max({x}) over () = min({x}) over () then 0.5 else ({x} - min({x}) over ()) / (max({x}) over () - min({x}) over ()) end as {n}" for x, n in (("cost", "a"), ("lead_time", "b"), ("debt_defect", "c")))
    + ", "
    + ", ".join(f"case when {x} is not null then (rank() over (partition by {x} is null order by {x}) - 1 + (count({x}) over (partition by {x}) - 1) / 2.0) / greatest(1, count({x}) over () - 1) end as {n}" for x, n in (("cost", "ra"), ("lead_time", "rb"), ("debt_defect", "rc")))
    + " from c1),\nlive as (select * from cells where a is not null and b is not null and c is not null)"
)


def beats(q: str, p: str, cols: tuple[str, ...] = ("a", "b", "c")) -> str:
    return "(" + " and ".join(f"{q}.{c} <= {p}.{c}" for c in cols) + " and (" + " or ".join(f"{q}.{c} < {p}.{c}" for c in cols) + "))"


def draw(rep: str, cell: str, i: str) -> str:
    m = 2147483647
    x = f"((cast({rep} as bigint) * 7919 + cast({cell} as bigint) * 104729 + cast({i} as bigint) * 1299709 + {SEED}) % {m})"
    y = f"(({x} * 48271) % {m})"
    return f"(({y} * {y} + {x} * 69621) % {m})"


BOOT = (
    CELLS
    + f""",
cellno as (select grp, win, n_builds, row_number() over (order by grp, win) as no from cells),
num as (select prep.*, no, n_builds, row_number() over (partition by prep.grp, prep.win order by build_id) - 1 as idx from prep join cellno using (grp, win)),
picks as (select rep, grp, win, {draw('rep', 'no', 'idx')} % n_builds as pick from num, (select unnest(range(1, {BOOTSTRAP + 1})) as rep)),
drawn as (select picks.rep, num.* from picks join num on num.grp = picks.grp and num.win = picks.win and num.idx = picks.pick),
dens as (select min(density) dlo, max(density) dhi from c0),
bnd as (select min(cost) clo, max(cost) chi, min(lead_time) llo, max(lead_time) lhi, min(debt_defect) flo, max(debt_defect) fhi from cells),
raw as (select rep, grp, win, avg(cost_usd) cost, quantile_cont(lead_time_days, 0.5) lead_time, (sum(bugs) / nullif(sum(loc_total) / 1000, 0) - min(dlo)) / (min(dhi) - min(dlo)) debt from drawn, dens group by rep, grp, win),
reps as (select rep, grp, win, (cost - clo) / (chi - clo) a, (lead_time - llo) / (lhi - llo) b, (debt - flo) / (fhi - flo) c from raw, bnd),
rlive as (select * from reps where a is not null and b is not null and c is not null)"""
)

COMMITS = """ev as (select *, cast(json_extract(props, '$.k') as bigint) as k, event_id % greatest(1, (select count(*) // 6 from events)) as tick from events),
commits as (select event_id, ts as tm, tick, case when event_id % 10 <= 5 then 'PROJ-' || tick || ': ' || event_type when event_id % 10 = 6 then 'enable flag: feat-' || (tick % 50) when event_id % 10 = 7 then 'feat(mod' || (tick % 40) || '): ' || event_type
  when event_id % 10 = 8 then 'Revert "' || event_type || ' change ' || (tick % 60) || '"' else event_type || ' tweak area' || (k % 12) end as subject, event_id % 25 = 0 as infra,
  cast(floor(value) as bigint) + k % 20 as churn, lpad(cast(event_id as varchar), 8, '0') as sha from ev),
keyed as (select *, case when event_id % 10 <= 5 then 'ticket:proj-' || tick when event_id % 10 = 6 then 'flag:feat-' || (tick % 50) when event_id % 10 = 7 then 'conventional-scope:mod' || (tick % 40)
  when event_id % 10 = 8 then 'revert:' || lower(substr(subject, 9, length(subject) - 9)) end as key from commits),
deploys as (select min(tm) + interval 3 days as tm, 'proj-' || tick as hint from commits where subject like 'PROJ-%' and tick % 3 <> 0 group by tick)"""

TICKETS = (
    COMMITS
    + """,
feature as (select * from keyed where key is not null and not infra),
firsts as (select key, min(tm) as first_at, string_agg(distinct lower(subject), ' ' order by lower(subject)) as subj from feature group by key),
moments as (select key, first_at, (select min(d.tm) from deploys d where d.tm >= first_at and contains(lower(key) || ' ' || subj, hint)) as t0 from firsts),
post as (select feature.*, t0, tm >= t0 and t0 is not null as after from feature join moments using (key)),
seq as (select *, lead(tm) over (partition by key, after order by tm, sha) as nxt, row_number() over (partition by key, after order by tm, sha) as i from post),
split as (select key, any_value(t0) as t0, count(*) as commits, cast(coalesce(sum(churn) filter (where t0 is not null and not after), 0) as bigint) as pre_churn, cast(coalesce(sum(churn) filter (where after), 0) as bigint) as post_churn,
  coalesce(min(i) filter (where after and (nxt is null or nxt - tm >= interval 7 days)), 0) as dts, count(*) filter (where after) as n_post, max(tm) filter (where after) as last_at from seq group by key),
tickets as (select *, coalesce(n_post > 0 and (select max(ts) from events) - last_at < interval 7 days and dts = n_post, false) as censored, t0 is not null as resolved,
  case when pre_churn <> 0 then post_churn / cast(pre_churn as double) end as rework_ratio, post_churn / nullif(cast(pre_churn + post_churn as double), 0) as tail_mass from split),
risk as (select dts as t, count(*) as n, count(*) filter (where not censored) as e from tickets where resolved group by dts),
curve0 as (select t, e, 1 - e / cast(sum(n) over (order by t desc rows between unbounded preceding and current row) as double) as f from risk),
curve as (select t, s as survival from (select t, e, product(f) over (order by t rows between unbounded preceding and current row) as s from curve0) where e > 0 union all select 0, 1.0 where exists (select 1 from risk))"""
)

SESSIONS = """ses as (select 's-' || event_id as sid, event_id, case when event_id % 6 = 0 or event_id % 30 in (7, 11) then null else event_id - event_id % 6 + (event_id % 6 - 1) // 2 end as up, value as effort,
  case event_type when 'error' then null when 'view' then 0 when 'purchase' then 2 else event_id % 2 end as commits from events),
walk as (select sid, event_id as node, case when up in (select event_id from ses) then up end as up from ses union all select walk.sid, s.event_id, case when s.up in (select event_id from ses) then s.up end from walk join ses s on s.event_id = walk.up),
roots as (select sid, 's-' || node as root from walk where up is null)"""


def statements() -> dict[str, str]:
    out: dict[str, str] = {}

    def add(name: str, ctes: str, body: str) -> None:
        out[name] = f"with {'recursive ' if ctes.startswith('ses') else ''}{ctes}\n{body}"

    metric = lambda expr, nulls: f"select grp, win, count(*) as n_builds, round({expr}, 6) as value, {nulls} as nulls_skipped from prep group by grp, win"
    nul = lambda *c: "cast(" + " + ".join(f"count(*) filter (where {x} is null)" for x in c) + " as bigint)"
    add("builds_prepared", PREPARED, "select build_id, grp, win, round(lead_time_days, 6) as lead_time_days, lead_time_source, round(age_days, 6) as age_days, impact, gate_unavailable, deployed, served, loc_total from prep")
    add("coerced_builds", BUILDS + "," + _WRITTEN, "select build_id, case when o_orderkey % 53 = 0 then 'all' else grp end as grp, strftime(day, '%Y-%m') as win, epoch_us(moment) as ts_us, src as lead_time_source, round(date_diff('microsecond', first_commit, date_trunc('second', case src when 'SERVED' then served_at when 'DEPLOYED' then deployed_at end)) / 86400000000.0, 6) as lead_time_days, usage, loc_added + loc_removed as loc_total, bugs, round(cost_usd, 6) as cost_usd, asked as question, deployed_at is not null as deployed from w2")
    add("coerce_warnings", BUILDS + "," + _WRITTEN, "select code, build_id as row, case code when 'BAD_TIMESTAMP' then 'cannot parse a timestamp' when 'UNKNOWN_QUESTION' then 'question ''whim'' is unclassified' else case when o_orderkey % 31 = 0 then 'ts and first_commit_ts are required' else 'loc_added and loc_removed are required' end end as message from w0 where code is not null")
    add("lead_time_source", PREPARED, "select grp, lead_time_source, count(*) as n, round(avg(lead_time_days), 6) as mean_days from prep group by grp, lead_time_source")
    for spec, label in (("week", "strftime(ts, '%G-W%V')"), ("quarter", "year(ts) || '-Q' || quarter(ts)")):
        add(f"window_{spec}", BUILDS, f"select {label} as win, count(*) as n_builds from b1 where loc_added is not null group by 1")
    add("impact_gate", PREPARED, "select grp, impact, count(*) as n_builds from prep group by grp, impact")
    add("derive_u", PREPARED, "select (select u from gate) as u, min(win) as first_win, max(win) as last_win, count(*) as n_windows from wins")
    for name, classes in (("impact_mix", IMPACT_CLASSES), ("question_mix", QUESTION_CLASSES)):
        add(name, CELLS, "select grp, win, n_builds, " + ", ".join(f"round(share_{c}, 6) as share_{c}" for c in classes) + " from cells")
    add("unclassified_share", PREPARED, "select grp, win, round(count(*) filter (where question not in ('features', 'correctness', 'performance', 'economics') or question is null) / cast(count(*) as double), 6) as unclassified_share from prep group by grp, win")
    add("fallback_share", CELLS, "select grp, win, round(fallback_share, 6) as fallback_share from cells")
    add("gate_unavailable_share", PREPARED, "select grp, win, round(avg(case when gate_unavailable then 1.0 else 0.0 end), 6) as gate_unavailable_share from prep group by grp, win")
    add("metric_cost", PREPARED, metric("avg(cost_usd)", nul("cost_usd")))
    add("metric_cost_kloc", PREPARED, metric("sum(cost_usd) / nullif(sum(loc_total) / 1000, 0)", nul("cost_usd", "loc_total")))
    add("metric_cost_impact", PREPARED, metric("sum(cost_usd) / nullif(cast(count(*) filter (where impact = 'impactful') as double), 0)", nul("cost_usd")))
    add("metric_lead_time", PREPARED, metric("quantile_cont(lead_time_days, 0.5)", nul("lead_time_days")))
    add("metric_lead_time_p90", PREPARED, metric("quantile_cont(lead_time_days, 0.9)", nul("lead_time_days")))
    add("metric_throughput", PREPARED, metric("cast(count(*) as double)", "cast(0 as bigint)"))
    two = "cast((select count(*) from prep p where p.grp = {t}.grp and p.win = {t}.win and p.bugs is null) as bigint)"
    add("metric_debt_defect", CELLS, f"select grp, win, n_builds, round(debt_defect, 6) as value, {two.format(t='cells')} as nulls_skipped from cells")
    add("metric_debt_composite", CELLS, f"select grp, win, n_builds, round(0.5 * debt_defect + 0.5 * (share_liability + share_sunk), 6) as value, {two.format(t='cells')} as nulls_skipped from cells")
    add("formula_bool_nulls", PREPARED, """select grp, win, round(count(*) filter (where bugs is not null and usage is not null and not (bugs > 0 and usage > 25)) / cast(count(*) as double)
  + count(*) filter (where bugs is not null and cost_usd is not null and (bugs = 0 or cost_usd > 900)), 6) as value from prep group by grp, win""")
    add("formula_clip_pow", PREPARED + ", med as (select grp, win, quantile_cont(bugs, 0.5) m from prep group by grp, win)", "select grp, win, round(sum(case when bugs is not null and m is not null then greatest(0.0, least(m, bugs)) end) + pow(avg(loc_total), 0.5), 6) as value from prep join med using (grp, win) group by grp, win")
    add("formula_z", CELLS, "select grp, win, round(case when coalesce(stddev_samp(cost) over (), 0) = 0 then (cost - avg(cost) over ()) / greatest(1.0, abs(avg(cost) over ())) else (cost - avg(cost) over ()) / stddev_samp(cost) over () end, 6) as value from cells")
    add("formula_zero_division", CELLS, "select grp, win, cast(null as double) as value from cells")
    add("formula_abs_sqrt_log", PREPARED, "select grp, win, round(abs(avg(bugs) - 2) + sqrt(avg(loc_total)) + ln(count(*)) + avg(usage), 6) as value from prep group by grp, win")
    add("formula_elementwise", PREPARED, "select grp, win, round(sum(case when bugs >= 1 then sqrt(bugs - 1) end) + sum(case when usage > 0 then ln(usage) end) + sum(abs(loc_added - loc_removed)) + quantile_cont(-loc_total, 0.1), 6) as value from prep group by grp, win")
    add("formula_outside_domain", PREPARED, "select distinct grp, win, cast(null as double) as value from prep")
    add("formula_notes", PREPARED + ", ce as (select grp, win, sum(cost_usd) as cost, count(*) filter (where bugs = 0 and loc_total is not null) as none from prep group by grp, win)", " union all ".join(
        f"select grp, win, '{m}' as metric, '{m}: {text}' as note from ce where {when}" for m, text, when in (
            ("divided", "division by zero -> null", "cost is not null"), ("inside", "division by zero -> null", "none > 0"), ("power", "power outside finite real numbers -> null", "true"), ("level", "minmax of a constant -> 0.5", "true"), ("flat", "z of a constant -> 0.0", "true"),
            ("huge", "the result is not finite -> null", "cost > 0"), ("beyond", "minmax of a number that is not finite -> null", "cost > 0"), ("bounded", "division by zero -> null", "(select count(bugs) from prep p where p.grp = ce.grp and p.win = ce.win) > 0"))))
    add("objective_minmax", CELLS, "select grp, win, round(a, 6) as cost_norm, round(b, 6) as lead_time_norm, round(c, 6) as debt_defect_norm from cells")
    add("objective_rank", CELLS, "select grp, win, round(ra, 6) as cost_rank, round(rb, 6) as lead_time_rank, round(rc, 6) as debt_defect_rank from cells")
    series = [("cost", "ra"), ("lead_time", "rb"), ("debt_defect", "rc")]
    every = series + [(f"share({c})", f"share_{c}") for c in (*IMPACT_CLASSES, *QUESTION_CLASSES)]
    left = " union all ".join(f"select '{n}' as a, grp, win, cast({c} as double) as x from cells" for n, c in series)
    right = " union all ".join(f"select '{n}' as b, grp, win, cast({c} as double) as y from cells" for n, c in every)
    add("kendall_tau", CELLS + f", l as ({left}), r as ({right}), s as (select a, b, grp, win, x, y from l join r using (grp, win) where a <> b and x is not null and y is not null)," + """
pr as (select s.a, s.b, sign(s.x - t.x) dx, sign(s.y - t.y) dy from s join s t on s.a = t.a and s.b = t.b and (s.grp, s.win) < (t.grp, t.win)),
k as (select a, b, count(*) np, sum(dx * dy) sm, cast(count(*) filter (where dx <> 0) as double) nx, cast(count(*) filter (where dy <> 0) as double) ny from pr group by a, b),
f as (select a, b, cast(round((1 + sqrt(1 + 8 * np)) / 2) as bigint) n, case when nx * ny > 0 and np >= 3 then sm / sqrt(nx * ny) end tau from k)""", "select a, b, n, round(tau, 6) as tau, case when tau is null then null when abs(tau) >= 0.8 then 'redundant' when tau <= -0.4 then 'conflicting' else 'independent' end as verdict from f")
    axes = [("cost", "ra"), ("lead_time", "rb"), ("debt_defect", "rc"), ("share_sunk", "share_sunk"), ("share_impactful", "share_impactful")]
    long = " union all ".join(f"select {k} as i, '{n}' as name, grp, win, cast({c} as double) as x from cells" for k, (n, c) in enumerate(axes))
    within = f""", ax as ({long}), aj as (select p.win, p.i, q.i as j, p.grp, p.x, q.x as y from ax p join ax q on p.win = q.win and p.grp = q.grp and p.i < q.i where p.x is not null and q.x is not null),
aq as (select s.win, s.i, s.j, sign(s.x - t.x) dx, sign(s.y - t.y) dy from aj s join aj t on s.win = t.win and s.i = t.i and s.j = t.j and s.grp < t.grp),
ak as (select win, i, j, count(*) np, sum(dx * dy) sm, cast(count(*) filter (where dx <> 0) as double) nx, cast(count(*) filter (where dy <> 0) as double) ny from aq group by win, i, j),
tau1 as (select win, i, j, case when nx * ny > 0 and np >= 3 then sm / sqrt(nx * ny) end as tau from ak),
tau as (select * from tau1 where tau is not null union all select win, j, i, tau from tau1 where tau is not null), names as (select distinct i, name from ax)"""
    chain = within + """, ch as (select win, [i, j] as o from (select win, i, j, row_number() over (partition by win order by tau, i, j) as k from tau where i < j) where k = 1
union all select win, list_append(o, nxt) from (select ch.win, ch.o, n.i as nxt, row_number() over (partition by ch.win order by coalesce(tau.tau, 1.0), n.i) as k from ch join names n on not list_contains(ch.o, n.i) left join tau on tau.win = ch.win and tau.i = ch.o[len(ch.o)] and tau.j = n.i) where k = 1),
full_ as (select w.win, coalesce((select any_value(o) from ch where ch.win = w.win and len(o) = 5), [0, 1, 2, 3, 4]) as o from (select distinct win from tau1) w)"""
    out["axis_order"] = f"with recursive {CELLS}{chain}\nselect win, cast(p as int) as position, name as axis from (select win, unnest(o) as i, generate_subscripts(o, 1) - 1 as p from full_) join names using (i)"
    out["greedy_reduction"] = f"with recursive {CELLS}{within}, rc_ as (select w.win, n.i, n.i as j from (select distinct win from tau1) w, names n union select rc_.win, rc_.i, tau.j from rc_ join tau on tau.win = rc_.win and tau.i = rc_.j and abs(tau.tau) >= 0.8)\nselect win, a.name as objective, min(b.name) as representative, min(b.name) = a.name as kept from rc_ join names a on a.i = rc_.i join names b on b.i = rc_.j group by win, a.name"
    for on in ("win", "grp"):
        add(f"pareto_front_{'across' if on == 'win' else 'within'}", CELLS, f"select grp, win, n_builds, round(cost, 6) as cost, round(lead_time, 6) as lead_time, round(debt_defect, 6) as debt_defect from live p where not exists (select 1 from live q where q.{on} = p.{on} and {beats('q', 'p')})")
    out["pareto_layers"] = f"with recursive {CELLS}, e as (select p.win, q.grp as src, p.grp as dst from live p join live q on p.win = q.win and {beats('q', 'p')}), ch as (select win, grp, 1 as d from live union select e.win, e.dst, ch.d + 1 from ch join e on e.win = ch.win and e.src = ch.grp)\nselect grp, win, cast(max(d) as bigint) as layer from ch group by grp, win union all select grp, win, null from cells where a is null or b is null or c is null"
    add("epsilon_front", CELLS + ", bx as (select grp, win, floor(a / 0.15) a, floor(b / 0.15) b, floor(c / 0.15) c from live)", f"select grp, win from bx p where not exists (select 1 from bx q where q.win = p.win and {beats('q', 'p')})")
    kd = lambda q, p, k: f"(cast({q}.a <= {p}.a as int) + cast({q}.b <= {p}.b as int) + cast({q}.c <= {p}.c as int) >= {k} and ({q}.a < {p}.a or {q}.b < {p}.b or {q}.c < {p}.c))"
    add("k_dominance", CELLS, " union all ".join(f"select cast({k} as bigint) as k, grp, win from live p where not exists (select 1 from live q where q.win = p.win and {kd('q', 'p', k)})" for k in (3, 2)))
    out["k_cycles"] = f"with recursive {CELLS}, e as (select q.win, q.grp as src, p.grp as dst from live p join live q on p.win = q.win and p.grp <> q.grp and {kd('q', 'p', 2)}), reach as (select win, src, dst from e union select reach.win, reach.src, e.dst from reach join e on e.win = reach.win and e.src = reach.dst)\nselect r.win, min(r.dst) as cycle, r.src as member from reach r join reach back on back.win = r.win and back.src = r.dst and back.dst = r.src group by r.win, r.src"
    masks = "mk as (select unnest(range(1, 8)) as mask)"
    bit = [f"(mask // {1 << j}) % 2 = 1" for j in range(3)]
    under = "(" + " and ".join(f"(not ({u}) or q.{c} <= p.{c})" for u, c in zip(bit, "abc")) + " and (" + " or ".join(f"({u} and q.{c} < p.{c})" for u, c in zip(bit, "abc")) + "))"
    add("skyline_frequency", CELLS + f", {masks}, best as (select p.grp, p.win, mask from live p, mk where not exists (select 1 from live q where q.win = p.win and {under}))", "select win, grp, (select count(*) from best where best.grp = live.grp and best.win = live.win) as frequency from live")
    add("delta_moss_subsets", CELLS + f", {masks}", f"select p.win, cast(mask as bigint) as mask, round(greatest(0.0, coalesce(max(case when {under} then greatest(q.a - p.a, q.b - p.b, q.c - p.c) end), 0.0)), 6) as delta from live p join live q on p.win = q.win and p.grp <> q.grp, mk group by p.win, mask")
    rung = lambda k: f"s{k} as (select * from (select s.win, {k} as size, b.added, sub.mask, sub.delta, row_number() over (partition by s.win order by sub.delta, b.j) as k from {'(select distinct win, 0 as mask from sub)' if k == 1 else f's{k - 1}'} s join bits b on s.mask & b.bit = 0 join sub on sub.win = s.win and sub.mask = s.mask | b.bit) where k = 1)"
    add("delta_moss_ladder", CELLS + f", {masks}, sub as (select p.win, mask, greatest(0.0, coalesce(max(case when {under} then greatest(q.a - p.a, q.b - p.b, q.c - p.c) end), 0.0)) as delta from live p join live q on p.win = q.win and p.grp <> q.grp, mk group by p.win, mask), bits as (select * from (values (0, 1, 'cost'), (1, 2, 'lead_time'), (2, 4, 'debt_defect')) t(j, bit, added)), {rung(1)}, {rung(2)}, {rung(3)}, st as (select * from s1 union all select * from s2 union all select * from s3)",
        "select win, size, added, cast(mask as bigint) as mask, round(delta, 6) as delta, coalesce(size = min(case when delta <= 1e-9 then size end) over (partition by win), false) as smallest_exact from st")
    front = f"fr as (select distinct win, a, b, c from live p where not exists (select 1 from live q where q.win = p.win and {beats('q', 'p')}) and a < 1.1 and b < 1.1 and c < 1.1)"
    add("hypervolume_exact", CELLS + f", {front}, nf as (select *, row_number() over (partition by win order by a, b, c) - 1 as i, count(*) over (partition by win) as n from fr), ms as (select win, any_value(n) n, unnest(range(1, cast(pow(2, any_value(n)) as int))) as mask from nf group by win), " + """
cr as (select ms.win, mask, count(*) bits, max(a) a, max(b) b, max(c) c from ms join nf on nf.win = ms.win and (mask >> nf.i) % 2 = 1 group by ms.win, mask)""", "select w.win, round(coalesce(sum(case when bits % 2 = 1 then 1 else -1 end * (1.1 - a) * (1.1 - b) * (1.1 - c)), 0.0), 6) as hypervolume, coalesce((select count(*) from fr where fr.win = w.win), 0) as points from (select distinct win from cells) w left join cr on cr.win = w.win group by w.win")
    add("distance_to_ideal", CELLS + ", g as (select grp, win, a - min(a) over (partition by win) x, b - min(b) over (partition by win) y, c - min(c) over (partition by win) z from live)", "select grp, win, round(x + y + z, 6) as l1, round(sqrt(x * x + y * y + z * z), 6) as l2, round(greatest(x, y, z), 6) as linf from g")
    add("weighted_sum", CELLS, "select grp, win, round(a / 3 + b / 3 + c / 3, 6) as weighted_sum, round((coalesce(ra, 0) + coalesce(rb, 0) + coalesce(rc, 0)) / nullif(cast((ra is not null)::int + (rb is not null)::int + (rc is not null)::int as double), 0), 6) as average_rank from cells")
    add("staircase_2d", CELLS + ", sx as (select win, a as x, min(b) as y from cells where a is not null and b is not null group by win, a)", "select win, round(x, 6) as x, round(min(y) over (partition by win order by x), 6) as least from sx")
    add("mix_levels", PREPARED, "select grp, win, count(*) as n_builds, " + ", ".join(f"round(count(*) filter (where impact = '{c}') / cast(count(*) as double), 6) as share_{c}" for c in IMPACT_CLASSES) + " from prep group by grouping sets ((grp, win), ())")
    two_d = f"f2 as (select grp, win, a, b, count(*) over (partition by win) n from live p where not exists (select 1 from live q where q.win = p.win and {beats('q', 'p', ('a', 'b'))})), s2 as (select *, lag(a) over w - a ax, lag(b) over w - b ay, lead(a) over w - a bx, lead(b) over w - b by_ from f2 window w as (partition by win order by a, grp))"
    add("knee_2d", CELLS + ", " + two_d, "select grp, win, round(case when sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_) > 0 then pi() - acos(greatest(-1.0, least(1.0, (ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_))))) else 0.0 end, 6) as bend from s2 where n >= 3")
    out["expected_maxima"] = "with d1 as (select unnest(range(1, 31)) as n, 1.0::double as a), d2 as (select n, sum(a / n) over (order by n) as a from d1), d3 as (select n, sum(a / n) over (order by n) as a from d2), d4 as (select n, sum(a / n) over (order by n) as a from d3) " + " union all ".join(f"select n, cast({d} as bigint) as d, round(a, 6) as a from d{d}" for d in (1, 2, 3, 4))
    long = " union all ".join(f"select rep, rows_.win, no, i, {j} as j, {c} as v from rows_, (select unnest(range(1, {PERMUTATIONS + 1})) as rep)" for j, c in enumerate("abc"))
    add("permutation_null", CELLS + f", wn as (select win, dense_rank() over (order by win) as no from (select distinct win from live)), rows_ as (select live.win, no, a, b, c, row_number() over (partition by live.win order by grp) as i from live join wn using (win)), lg as ({long})," + f"""
dl as (select rep, win, j, v, row_number() over (partition by win, rep, j order by {draw('rep', '(no * 8 + j)', 'i')}, i) as pos from lg),
wide as (select rep, win, pos, max(v) filter (where j = 0) a, max(v) filter (where j = 1) b, max(v) filter (where j = 2) c from dl group by rep, win, pos union all select 0, win, i, a, b, c from rows_),
sz as (select rep, win, count(*) as size from wide p where not exists (select 1 from wide q where q.win = p.win and q.rep = p.rep and {beats('q', 'p')}) group by rep, win),
ob as (select win, size as observed from sz where rep = 0), n_ as (select win, count(*) as n from live group by win having count(*) >= 3),
st as (select sz.win, observed, avg(size) m, list_sort(list(size)) l, (count(*) filter (where size < observed) + 0.5 * count(*) filter (where size = observed)) / count(*) p from sz join ob using (win) where rep > 0 group by sz.win, observed),
h as (select k as n, sum(1.0 / k) over (order by k) as h from (select unnest(range(1, 101)) as k)), cf as (select n, sum(h / n) over (order by n) as closed from h)""", "select st.win, n_.n, observed, round(m, 6) as mean, l[cast(floor(0.05 * (len(l) - 1)) as int) + 1] as p05, l[cast(floor(0.95 * (len(l) - 1)) as int) + 1] as p95, round(p, 6) as percentile, case when p > 0.95 then 'CONFLICTING' when p < 0.05 then 'AGREEING' else 'NOT INFORMATIVE' end as verdict, round(closed, 6) as closed_form from st join n_ using (win) join cf on cf.n = n_.n")
    rfront = f"(select win, grp, count(*) as w from rlive p where not exists (select 1 from rlive q where q.win = p.win and q.rep = p.rep and {beats('q', 'p')}) group by win, grp)"
    add("bootstrap_p_on_front", BOOT, f"select r.grp, r.win, count(*) filter (where a is not null and b is not null and c is not null) as usable, coalesce(any_value(w), 0) as wins, round(coalesce(any_value(w), 0) / nullif(cast(count(*) filter (where a is not null and b is not null and c is not null) as double), 0), 6) as p_on_front from reps r left join {rfront} f on f.win = r.win and f.grp = r.grp group by r.grp, r.win")
    add("prob_dominance", BOOT, f"select q.win, q.grp as a, p.grp as b, count(*) as comparable, round(avg(case when {beats('q', 'p')} then 1.0 else 0.0 end), 6) as rate from rlive q join rlive p on q.win = p.win and q.rep = p.rep and q.grp <> p.grp group by q.win, q.grp, p.grp")
    lists = ", ".join(f"list_sort(list({c})) as l{c}" for c in "abc")
    half = lambda c: f"(l{c}[cast(floor(0.975 * (n - 1)) as int) + 1] - l{c}[cast(floor(0.025 * (n - 1)) as int) + 1]) / 2"
    add("bootstrap_epsilon", BOOT + f", dr as (select win, grp, count(*) as n, {lists} from rlive group by win, grp having count(*) >= 10)", "select win, " + ", ".join(f"round(greatest(1e-9, quantile_cont({half(c)}, 0.5)), 6) as eps_{m}" for c, m in zip("abc", ("cost", "lead_time", "debt_defect"))) + " from dr group by win")
    add("attainment_bands", BOOT.replace(f"range(1, {BOOTSTRAP + 1})", f"range(1, {ATTAINMENT_REPLICATES + 1})") + """, pt as (select win, rep, round(a, 2) x, round(b, 2) y from reps where a is not null and b is not null), xs as (select win, x, row_number() over (partition by win order by x) - 1 as i, count(*) over (partition by win) as n from (select distinct win, x from pt)),
gx as (select win, x from xs where n <= 40 or i in (select least(xs.n - 1, cast(floor(k * (xs.n / 40.0::double)) as bigint)) from (select unnest(range(0, 40)) as k))),
lst as (select r.win, r.rep, gx.x, coalesce(min(pt.y), 'inf'::double) as y from (select distinct win, rep from reps) r join gx on gx.win = r.win left join pt on pt.win = r.win and pt.rep = r.rep and pt.x <= gx.x group by r.win, r.rep, gx.x),
sl as (select win, x, list_sort(list(y)) as l from lst group by win, x)""", "select win, round(x, 6) as x, " + ", ".join(f"round(nullif(l[greatest(1, cast(ceil({q} * len(l)) as int))], 'inf'::double), 6) as {n}" for q, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))) + " from sl")
    u = lambda j: f"(-ln(({draw('s', str(j), '0')} + 0.5) / 2147483647.0::double))"
    add("marginal_utility", CELLS + f", fr as (select *, count(*) over (partition by win) as n from live p where not exists (select 1 from live q where q.win = p.win and {beats('q', 'p')})), dw as (select grp, win, s, {u(0)} * a + {u(1)} * b + {u(2)} * c as sc from fr, (select unnest(range(1, {UTILITY_SAMPLES + 1})) as s) where n >= 3), wn as (select win, s, arg_min(grp, (sc, grp)) as grp from dw group by win, s)", f"select grp, win, round((select count(*) from wn where wn.win = fr.win and wn.grp = fr.grp) / {UTILITY_SAMPLES}.0::double, 6) as utility from fr where n >= 3")
    g = lambda j: f"(sqrt(-2.0::double * ln(({draw('rep', 'no', str(2 * j))} + 0.5) / 2147483647.0::double)) * cos(2 * pi() * (({draw('rep', 'no', str(2 * j + 1))} + 0.5) / 2147483647.0::double)))"
    add("parametric_replicates", CELLS + """, pc as (select grp, win, row_number() over (order by grp, win) as no, cost, lead_time, cost / 20 as cse, case when grp <> 'BUILDING' then 0.5 else 0.0 end as lse from cells), bd as (select min(cost) clo, max(cost) chi, min(lead_time) llo, max(lead_time) lhi from cells)""", f"select rep, grp, win, round((case when cost is null then null when cse = 0 then cost else greatest(clo - 3 * cse, least(chi + 3 * cse, cost + cse * {g(0)})) end - clo) / (chi - clo), 5) as cost, round((case when lead_time is null then null when lse = 0 then lead_time else greatest(llo - 3 * lse, least(lhi + 3 * lse, lead_time + lse * {g(1)})) end - llo) / (lhi - llo), 5) as lead_time from pc, bd, (select unnest(range(1, 21))::int as rep)")
    parts = [f"share_{c}" for c in IMPACT_CLASSES]
    zeros = " + ".join(f"(case when {p} <= 0 then 1 else 0 end)" for p in parts)
    fill = lambda p: f"ln(case when z = 0 then {p} when {p} <= 0 then dl else {p} * (1 - dl * z) / ({' + '.join(parts)}) end)"
    clr = f"cz as (select *, {zeros} as z from cells), cd as (select *, least(0.5 / n_builds, 0.5 / greatest(1, z)) as dl from cz), cl as (select grp, win, dl, " + ", ".join(f"{fill(p)} as l{i}" for i, p in enumerate(parts)) + " from cd), cc as (select grp, win, dl, " + ", ".join(f"l{i} - (l0 + l1 + l2 + l3 + l4 + l5) / 6 as k{i}" for i in range(6)) + " from cl)"
    add("clr", CELLS + ", " + clr, "select grp, win, " + ", ".join(f"round(k{i}, 6) as clr_{c}" for i, c in enumerate(IMPACT_CLASSES)) + ", round(dl, 6) as clr_delta from cc")
    terms = [f"pow((a{i} - a{j}) - (k{i} - k{j}), 2)" for i in range(6) for j in range(i + 1, 6)]
    add("aitchison_movement", CELLS + ", " + clr + ", mv as (select *, lag(win) over w as from_win, " + ", ".join(f"lag(k{i}) over w as a{i}" for i in range(6)) + " from cc window w as (partition by grp order by win))", f"select grp, from_win, win as to_win, true as available, round(sqrt(({' + '.join(terms)}) / 6), 6) as distance, round(greatest({', '.join(terms)}), 6) as top_contribution from mv where from_win is not null")
    tr = "tr as (select grp, win, lag(win) over w as from_win, " + ", ".join(f"lag({c}) over w as p{c}, {c}" for c in "abc") + " from cells window w as (partition by grp order by win)), ts_ as (select *, pa is not null and pb is not null and pc is not null and a is not null and b is not null and c is not null as ok, sqrt(pow(a - pa, 2) + pow(b - pb, 2) + pow(c - pc, 2)) as mg, sqrt(pa * pa + pb * pb + pc * pc) as tn, -((a - pa) * pa + (b - pb) * pb + (c - pc) * pc) as dt from tr where from_win is not null), an as (select *, case when ok and mg > 0 and tn > 0 then degrees(acos(greatest(-1.0, least(1.0, dt / (mg * tn))))) end as ang from ts_)"
    add("direction_of_travel", CELLS + ", " + tr, "select grp, from_win, win as to_win, ok as available, case when ok then round(mg, 6) end as magnitude, round(ang, 4) as angle, case when not ok then 'unavailable' when ang is null then 'no movement' when ang < 45 then 'improving on the objectives together' when ang < 90 then 'improving on balance, with a trade' when ang < 135 then 'trading one objective against another' else 'worse on the objectives together' end as reading from an")
    add("persistence", CELLS, f"select grp, count(*) filter (where not exists (select 1 from live q where q.win = p.win and {beats('q', 'p')})) as windows_on_front, count(*) as windows_considered from live p group by grp")
    sens = PREPARED + ", lv as (select * from (values ('0.5u', 0.5), ('u', 1.0), ('2u', 2.0)) t(level, factor)), sp as (select prep.* exclude (impact), level, case when age_days < 30 then 'unresolved' when not deployed then case when carried_into is not null then 'carried' else 'sunk' end when usage is null then 'impactful' when usage >= u * factor then 'impactful' when usage > 0 then 'low_impact' else 'liability' end as impact from prep, lv)"
    add("threshold_sensitivity", sens, "select level, grp, win, count(*) as n_builds, " + ", ".join(f"round(count(*) filter (where impact = '{c}') / cast(count(*) as double), 6) as share_{c}" for c in IMPACT_CLASSES) + " from sp group by level, grp, win")
    add("lead_time_divergence", CELLS, "select win, count(*) filter (where n_sources > 1) as mixed_cells, round(max(fallback_share) - min(fallback_share), 6) as spread, coalesce(max(fallback_share) - min(fallback_share) > 0.20, false) as divergent from cells group by win")
    ex = f"dm as (select p.win, p.grp, q.grp as by_, p.a - q.a ga, p.b - q.b gb, p.c - q.c gc from live p join live q on p.win = q.win and {beats('q', 'p')}), ag as (select win, grp, count(*) n, max(ga) ma, max(gb) mb, max(gc) mc, arg_min(by_, (greatest(ga, gb, gc), by_)) cb, min(greatest(ga, gb, gc)) lg from dm group by win, grp)"
    add("explain_dominators", CELLS + ", " + ex, "select live.win, live.grp, coalesce(n, 0) as dominators, case when n is null then null when ma >= mb and ma >= mc then 'cost' when mb >= mc then 'lead_time' else 'debt_defect' end as binding_objective, cb as closest_dominator, round(lg, 6) as largest_gap from live left join ag on ag.win = live.win and ag.grp = live.grp")
    base = BUILDS + """, base as (select build_id, cast(substr(build_id, 3) as bigint) as n, grp, strftime(ts, '%Y-%m-%d') as ts, strftime(first_commit, '%Y-%m-%d') as fc, loc_added, loc_removed, round(cost_usd, 2) as cost from b1),
inc as (select build_id, n, n * 2 as ord, grp, case when n % 14 = 0 then null else ts end as ts, fc, loc_added, loc_removed, case when n % 10 = 0 then 1.0 else cost end as cost from base where n % 2 = 0 union all select build_id, n, n * 2 + 1, grp, ts, fc, loc_added, loc_removed, cost from base where n % 8 = 0),
nn as (select *, row_number() over (partition by build_id order by ord) as k from inc), st as (select * from base where n % 3 <> 0),
lk as (select nn.*, nullif(concat_ws(', ', case when nn.ts is null then 'ts' end, case when nn.fc is null then 'first_commit_ts' end, case when nn.loc_added is null then 'loc_added' end, case when nn.loc_removed is null then 'loc_removed' end), '') as lacks from nn),
cl as (select case when k > 1 or lacks is not null then 'rejected' when st.build_id is null then 'accepted' when lk.ts is distinct from st.ts then 'conflict' when lk.cost is not distinct from st.cost then 'duplicate' else 'conflict' end as status,
  case when k > 1 then 'build_id repeats' when lacks is not null then lacks when st.build_id is null then null when lk.ts is distinct from st.ts then 'ts' when lk.cost is not distinct from st.cost then null else 'cost_usd' end as field from lk left join st using (build_id))"""
    add("ingest_classify", base, "select status, field, count(*) as n from cl group by status, field")
    out["registry_latest"] = "with t as (select p_brand as name, cast(p_size as bigint) as version, min(p_partkey) as defined from part group by 1, 2) select name, version, defined from t qualify row_number() over (partition by name order by version desc) = 1"
    diff = "w as (select min(win) lo, max(win) hi from cells), x as (select grp, win, cost, lead_time, debt_defect from cells, w where win <> hi), y as (select grp, win, cost * 1.1 as cost, lead_time, debt_defect from cells, w where win <> lo)"
    add("run_diff", CELLS + ", " + diff, "select coalesce(x.grp, y.grp) as grp, coalesce(x.win, y.win) as win, case when x.grp is null then 'added' when y.grp is null then 'removed' when coalesce(y.cost - x.cost, 0) = 0 and coalesce(y.lead_time - x.lead_time, 0) = 0 and coalesce(y.debt_defect - x.debt_defect, 0) = 0 then 'same' else 'changed' end as status, round(y.cost - x.cost, 6) as delta_cost, round(y.lead_time - x.lead_time, 6) as delta_lead_time, round(y.debt_defect - x.debt_defect, 6) as delta_debt_defect from x full join y on x.grp = y.grp and x.win = y.win")
    add("aggregate_cells", CELLS + ", kw as (select distinct win from cells order by win desc limit 4)", "select grp, win, n_builds, round(cost, 6) as cost, round(lead_time, 6) as lead_time, round(debt_defect, 6) as debt_defect from cells where win in (select win from kw)")
    add("anchor_clusters", COMMITS, "select key, count(*) as commits, cast(sum(churn) as bigint) as churn, count(*) filter (where infra) as infra from keyed where key is not null group by key")
    add("t0_resolve", TICKETS, "select key, epoch_us(first_at) as first_us, epoch_us(t0) as t0_us from moments")
    add("quiet_split", TICKETS, "select key, commits, pre_churn, post_churn, cast(dts as bigint) as deploys_to_stability, censored, resolved, round(rework_ratio, 6) as rework_ratio, round(tail_mass, 6) as tail_mass from tickets")
    add("km_survival", TICKETS, "select cast(t as bigint) as t, round(survival, 6) as survival from curve")
    upper = lambda c: f"round(list_sort(list({c}) filter (where resolved and {c} is not null))[(count(*) filter (where resolved and {c} is not null)) // 2 + 1], 3)"
    add("tail_summary", TICKETS, f"select count(*) as clusters_total, count(*) filter (where resolved) as clusters_resolved, cast(sum(pre_churn + post_churn) as bigint) as churn_total, round(count(*) filter (where not resolved) / cast(count(*) as double), 3) as unattributed_share, {upper('tail_mass')} as tail_mass_median, {upper('rework_ratio')} as rework_ratio_median, round(count(*) filter (where resolved and censored) / cast(count(*) filter (where resolved) as double), 3) as never_stabilises_share, (select round(min(survival), 3) from curve) as survival_plateau from tickets")
    lv = ", ".join(f"({t})" for t in SWEEP)
    ff = BUILDS + f", th as (select * from (values {lv}) t(threshold)), rn as (select grp as label, threshold, count(*) filter (where served_at is not null) as delivered, round(count(*) filter (where bugs > 1) / cast(count(*) as double), 3) as never, sum(loc_added + loc_removed) as churn, min(ts) as f, max(ts) as l from b1, th where loc_added is not null and loc_added >= threshold * 20 group by 1, 2)," + """
cst as (select * replace (case when label <> 'FURNITURE' or threshold < """ + str(max(SWEEP)) + """ then never end as never), label in ('BUILDING', 'MACHINERY') as costed from rn), sh as (select threshold from rn group by threshold having count(distinct label) = (select count(distinct label) from rn)),
fp as (select label, threshold, -(case when costed then delivered / (delivered * 25.0 / 10000) else delivered / (churn / 1000) end) as a, -(case when costed then delivered / 24.0 else delivered / (greatest(floor(date_diff('microsecond', f, l) / 86400000000), 1) / 30.44) end) as b, -(1 - never) as c from cst join sh using (threshold) where delivered > 0 and never is not null and (costed or churn > 0))"""
    add("flow_frontier", ff, f"""select label, bit_count(won) as wins, thresholds, won, used, case when bit_count(won) = thresholds then 'always' when bit_count(won) > 0 then 'sometimes' else 'never' end as standing, bit_count(used) < thresholds as skipped, case when bit_count(used) < thresholds then why end as why
from (select b.label, coalesce(bit_or(1::bigint << no) filter (where p.label is not null and not exists (select 1 from fp q where q.threshold = p.threshold and {beats('q', 'p')})), 0) as won, coalesce(bit_or(1::bigint << no) filter (where p.label is not null), 0) as used,
  any_value((select count(*) from sh)) as thresholds, string_agg(distinct case when b.delivered = 0 then 'nothing delivered' when b.never is null then 'no share that settles' when p.label is null then 'nothing spent' end, ', ') as why
  from cst b join (select threshold, cast(row_number() over (order by threshold) - 1 as int) as no from sh) using (threshold) left join fp p on p.label = b.label and p.threshold = b.threshold group by b.label)""")
    add("session_roots", SESSIONS, "select sid, root from roots")
    loops = """ses as (select event_id as id, event_id - event_id % 12 + case event_id % 12 when 0 then 3 when 1 then 0 when 2 then 1 when 3 then 2 when 4 then 0 when 5 then 4 when 6 then 5 when 7 then 7 when 8 then 7 when 10 then 9 when 11 then 18 end as up from events),
known as (select id, case when up in (select id from ses) then up end as up from ses),
walk as (select id, id as node, 0 as steps, cast([] as bigint[]) as seen from known union all select walk.id, known.up, steps + 1, list_append(seen, node) from walk join known on known.id = node where known.up is not null and not list_contains(seen, node))"""
    add("session_loops", loops, "select 's-' || id as sid, 's-' || arg_max(node, steps) as root from walk group by id")
    fan = SESSIONS + """, rr as (select root, count(*) n, sum(effort) effort, count(commits) rated, coalesce(sum(effort) filter (where commits = 0), 0) blind, count(*) filter (where commits <> 0) landed, coalesce(sum(effort) filter (where commits is not null), 0) known from ses join roots using (sid) group by root),
tt as (select *, rated > 0 and effort <> 0 as seen from rr), sl as (select list_sort(list(blind / effort) filter (where seen)) as l from tt)"""
    pick = lambda q: f"(select round(l[least(cast(floor({q} * len(l)) as int), len(l) - 1) + 1], 3) from sl)"
    add("session_fanout", fan, f"select cast(sum(n) as bigint) as sessions, count(*) as runs, round(sum(effort), 2) as effort_total, round(count(*) filter (where n > 1) / cast(count(*) as double), 3) as multi_session_run_share, round(coalesce(sum(effort) filter (where n > 1), 0) / sum(effort), 3) as multi_session_effort_share, {pick(0.5)} as invisible_effort_share_median, {pick(0.9)} as invisible_effort_share_p90, round(coalesce(sum(effort) filter (where seen and landed = 0), 0) / sum(effort), 3) as no_artifact_effort_share, round((sum(effort) - sum(known)) / sum(effort), 3) as unrated_effort_share from tt")
    arch = "ar as (select user_id % 7 as archive, event_type as label, count(*) as n, sum(cast(floor(value) as bigint)) as tokens from events group by 1, 2)"
    add("agent_spend", arch + ", pr as (select * from (values ('view', 3.0::double), ('click', 0.25), ('purchase', 15.0)) t(label, usd))", "select archive, cast(sum(tokens * 1000) as bigint) as tokens_total, round(coalesce(sum(tokens * 1000 / 1000000.0::double * usd), 0), 2) as usd_estimate, round(coalesce(sum(tokens * 1000) filter (where usd is not null), 0) / cast(sum(tokens * 1000) as double), 3) as priced_share, coalesce(string_agg(label, ',' order by label) filter (where usd is null), '') as unpriced_models from ar left join pr using (label) group by archive")
    add("never_landed", arch, "select archive, cast(sum(n) filter (where label in ('view', 'error', 'signup')) as bigint) as sessions, round(coalesce(sum(n) filter (where label = 'error'), 0) / cast(sum(n) filter (where label in ('view', 'error', 'signup')) as double), 3) as failure_share, round(coalesce(sum(n) filter (where label = 'signup'), 0) / cast(sum(n) filter (where label in ('view', 'error', 'signup')) as double), 3) as unknown_share from ar where label in ('view', 'error', 'signup') group by archive")
    out["workflow_label"] = "with s as (select user_id % 29 as archive, cast(sum(event_id % 5) as double) t, coalesce(sum(event_id % 5) filter (where event_type in ('view', 'click')), 0) q, coalesce(sum(event_id % 5) filter (where event_type = 'error'), 0) e, coalesce(sum(event_id % 5) filter (where event_type in ('purchase', 'signup')), 0) m from events group by 1) select archive, case when e / coalesce(nullif(t, 0), 1) > 0.5 then 'automation-heavy' when m / coalesce(nullif(t, 0), 1) > 0.4 then 'prompt-and-iterate' when q / coalesce(nullif(t, 0), 1) > 0.5 then 'spec-first' else 'mixed' end as workflow from s"
    return out
