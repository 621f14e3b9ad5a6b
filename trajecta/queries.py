"""The registered queries over the driver's tables, and the SQL that gives the same rows.

Each is declared by its key columns, its floating-point columns (rounded on both sides) and how to make them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.operators import features as P
from trajecta.operators import fixations, kernels, maps, measures, paths, preprocess, reports, tables
from trajecta.operators.grouped import Kernel
from trajecta.plans import batteries
from trajecta.plans.extractor import Extractor
from trajecta.registry import QUERIES, R, SQL, U, W, add, over_events
from trajecta.sources.tables import EVENTS_SQL

AREAS = ("click", "error", "purchase", "signup", "view")
STEPS = f"""with f as ({EVENTS_SQL}), s1 as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy, t - lag(t + duration / 1000) over w as dt, lag(aoi) over w as aoi0 from f {W}),
s2 as (select *, sqrt(dx*dx + dy*dy) as length, case when dx is null or dy is null then null when dx = 0 then case when dy > 0 then 90.0::double when dy < 0 then -90.0::double else 0.0::double end
 when dx < 0 then degrees(atan(dy/dx)) + 180 when degrees(atan(dy/dx)) < 0 then degrees(atan(dy/dx)) + 360 else degrees(atan(dy/dx)) end as direction_angle from s1),
s as (select *, length / (dt + 1e-20) as speed, length / (dt*dt + 1e-20) / 2 as acceleration, abs(direction_angle - lag(direction_angle) over w) as rotation_angle from s2 {W})"""
#: Statistics as DuckDB writes them; sum and count are null where no row is chosen.
AGG = {
    "min": "min({v})", "max": "max({v})", "mean": "avg({v})", "std": "stddev_samp({v})", "var": "var_samp({v})", "median": "median({v})", "count": "case when count_if({c}) > 0 then count({v}) end", "sum": "case when count_if({c}) > 0 then coalesce(sum({v}), 0) end",
    "skew": "case when count({v}) >= 3 and var_pop({v}) = 0 then 0 when count({v}) >= 3 then skewness({v}) end", "kurtosis": "case when count({v}) >= 4 and var_pop({v}) = 0 then 0 when count({v}) >= 4 then kurtosis({v}) end",
}


def stats_sql(prefix: str, spec: dict[str, Sequence[str]], chosen: str = "true", column: Callable[[str], str] = str, areas: bool = False) -> str:
    out = []
    for f, names in spec.items():
        for a in AREAS if areas else (None,):
            c = chosen if a is None else f"({chosen}) and aoi = '{a}' and aoi0 = aoi"
            v = f"case when {c} then {column(f)} end"
            out += [f'{AGG[n].format(v=v, c=c)} as "{prefix}_{f}{"" if a is None else f"_aoi[{a}]"}_{n}"' for n in names]
    return f"{STEPS} select user_id, {', '.join(out)} from s group by user_id"


def add_stats(name: str, part: P.StatsPart, chosen: str = "true", column: Callable[[str], str] = str, digits: int = 8) -> None:
    spec = part.stats
    names = [f"{part.prefix}_{f}{'' if a is None else f'_aoi[{a}]'}_{n}" for f, ns in spec.items() for a in (part.areas or (None,)) for n in ns]
    add(name, U, names, over_events(lambda df: Extractor([part], R).transform(df)), stats_sql(part.prefix, spec, chosen, column, bool(part.areas)), digits)


BASIC = ("min", "max", "mean", "std")
BACK = "direction_angle is not null and (direction_angle - 360 * floor(direction_angle / 360)) between 135 and 225"
SMALL = "coalesce(length < 0.5 and dispersion > 1, false)"
add_stats("sac_length", P.SaccadeFeatures({"length": BASIC}))
add_stats("sac_speed", P.SaccadeFeatures({"speed": BASIC}), digits=12)
add_stats("sac_acceleration", P.SaccadeFeatures({"acceleration": BASIC}), digits=14)
add_stats("sac_direction", P.SaccadeFeatures({"direction_angle": BASIC}), digits=6)
add_stats("sac_rotation", P.SaccadeFeatures({"rotation_angle": BASIC}), digits=6)
add_stats("sac_moments", P.SaccadeFeatures({"length": ("sum", "count", "median", "var", "skew", "kurtosis")}), digits=6)
add_stats("sac_aoi", P.SaccadeFeatures({"length": ("mean", "std", "sum", "count")}, areas=AREAS, without_areas=False))
add_stats("reg_length", P.RegressionFeatures({"length": (*BASIC, "count", "sum")}), BACK)
add_stats("reg_mask", P.RegressionFeatures({"mask": ("sum", "mean")}), "true", lambda f: f"case when {BACK} then 1.0 else 0.0 end")
add_stats("microsac", P.MicroSaccadeFeatures({"length": (*BASIC, "count")}, max_speed=0.5), SMALL)
add_stats("fix_stats", P.FixationFeatures({"duration": (*BASIC, "median"), "vad": BASIC}), "true", lambda f: "duration" if f == "duration" else "dispersion")
add_stats("fix_vad_aoi", P.FixationFeatures({"vad": ("mean", "count"), "duration": ("max",)}, areas=AREAS, without_areas=False), "true", lambda f: "duration" if f == "duration" else "dispersion")

# --- measures
add("saccade_nll", U, ["saccade_nll"], over_events(lambda df: Extractor([P.SaccadeUnlikelihood(psi=0.8)], R).transform(df)), f"""{STEPS}, z as (select user_id, 0.8 * exp(-((length-1)*(length-1)) / (2 * case when length < 1 then 0.25 else 1.0 end)) * 2 / (sqrt(2*pi()) * 1.5) + 0.2 * exp(-((length-1)*(length-1)) / (2 * case when length < 1 then 0.3::double*0.3 else 0.7::double*0.7 end)) * 2 / (sqrt(2*pi()) * 1.0) as p from s)
select user_id, sum(case when p is null then 0 when p > 1e-15 then -ln(p) else 30 end) as saccade_nll from z group by user_id""", 6)  # fmt: skip
add("spectral_entropy", U, ["spectral_entropy"], over_events(lambda df: Extractor([P.SpectralEntropy()], R).transform(df)), f"with f as ({EVENTS_SQL}), r as (select user_id, x*x + y*y as r from f) select user_id, ln(sum(r)) - sum(case when r > 0 then r * ln(r) else 0 end) / sum(r) as spectral_entropy from r group by user_id")
add("shannon_entropy", U, ["entropy"], over_events(lambda df: measures.shannon_entropy(df, R)), f"with f as ({EVENTS_SQL}), c as (select user_id, aoi, count(*) as k from f group by all), p as (select user_id, k / sum(k) over (partition by user_id) as p from c) select user_id, sum(-p * log2(p)) as entropy from p group by user_id")
add("gridded_entropy", U, ["gridded_entropy_grid_size_10"], over_events(lambda df: measures.gridded_entropy(df, R)), f"""with f as ({EVENTS_SQL}), m as (select user_id, x, y, min(x) over p as x0, max(x) over p as x1, min(y) over p as y0, max(y) over p as y1 from f window p as (partition by user_id)),
b as (select user_id, least(floor((x-x0)/(x1-x0)*10), 9) as i, least(floor((y-y0)/(y1-y0)*10), 9) as j from m), c as (select user_id, i, j, count(*) as k from b group by all), p as (select user_id, k / sum(k) over (partition by user_id) as p from c)
select user_id, sum(-p * ln(p)) as gridded_entropy_grid_size_10 from p group by user_id""")  # fmt: skip
RQA = f"""with f as ({EVENTS_SQL}), q as (select user_id, x, y, row_number() over (partition by user_id order by t, event_id) - 1 as seq from f), n as (select user_id, count(*)::double as n from f group by 1),
c as (select a.user_id, a.seq as i, b.seq as j from q a join q b on a.user_id = b.user_id and a.seq < b.seq and sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 0.1)"""
add("rqa_rec_corm", U, ["rec_metric_euclidean_length_1_rho_0.1", "corm_euclidean_length_1_rho_0.1"], over_events(lambda df: measures.rqa_measures(df, R, measures=("rec", "corm"))), f"""{RQA}, m as (select user_id, count(*) as m, sum(j-i) as far from c group by 1)
select n.user_id, 200 * (coalesce(m,0) + 1e-7) / (n*(n-1)) as "rec_metric_euclidean_length_1_rho_0.1", 100 * coalesce(far,0) / ((n-1) * (coalesce(m,0) + 1e-7)) as "corm_euclidean_length_1_rho_0.1" from n left join m on n.user_id = m.user_id""", 6)  # fmt: skip
add("rqa_det", U, ["det_euclidean_length_2_rho_0.1"], over_events(lambda df: measures.rqa_measures(df, R, min_length=2, measures=("det",))), f"""{RQA}, l as (select user_id, count(*) over (partition by user_id, j-i order by i rows between current row and unbounded following) as rest, lead(i) over (partition by user_id, j-i order by i) = i + 1 as run from c),
d as (select user_id, sum(case when run then rest else 0 end) as d, count(*) as m from l group by 1) select n.user_id, 100 * coalesce(d,0) / (coalesce(m,0) + 1e-7) as "det_euclidean_length_2_rho_0.1" from n left join d on n.user_id = d.user_id""", 4)  # fmt: skip
add("rqa_lam", U, ["lam_euclidean_length_2_rho_0.1"], over_events(lambda df: measures.rqa_measures(df, R, min_length=2, measures=("lam",))), f"""{RQA}, b as (select * from c union all select user_id, j, i from c), l as (select user_id, count(*) over (partition by user_id, i order by j rows between current row and unbounded following) as rest, lead(j) over (partition by user_id, i order by j) = j + 1 as run from b),
d as (select user_id, sum(case when run then rest else 0 end) as d, count(*) / 2 as m from l group by 1) select n.user_id, 200 * coalesce(d,0) / (2 * (coalesce(m,0) + 1e-7)) as "lam_euclidean_length_2_rho_0.1" from n left join d on n.user_id = d.user_id""", 4)  # fmt: skip
add("rqa_matrix", ["user_id", "i", "j"], [], over_events(lambda df: maps.recurrence_matrix(df, R, 0.1)), f"{RQA} select user_id, i, j from c union all select user_id, j, i from c")
INTER = f"with f as ({EVENTS_SQL}), q as (select user_id, x, y, row_number() over (partition by user_id order by t, event_id) - 1 as seq from f), e as (select user_id, 2*seq as k, x as v from q union all select user_id, 2*seq+1, y from q)"
add("corr_dim", U, ["corr_dim_m_2_tau_1_r_0.1"], over_events(lambda df: measures.correlation_dimension(df, R, r=0.1)), f"""{INTER}, d as (select user_id, k, v as v0, lead(v) over (partition by user_id order by k) as v1 from e), g as (select * from d where v1 is not null), n as (select user_id, count(*) as n from g group by 1),
c as (select a.user_id, count(*) as c from g a join g b on a.user_id = b.user_id and a.k <> b.k and sqrt((a.v0-b.v0)*(a.v0-b.v0) + (a.v1-b.v1)*(a.v1-b.v1)) < 0.1 group by 1)
select n.user_id, ln(1e-7 + coalesce(c,0) / n) / ln(0.1::double) as "corr_dim_m_2_tau_1_r_0.1" from n left join c on n.user_id = c.user_id""", 6)  # fmt: skip
SAMPLE = ", ".join(f"g{m} as (select * from (select user_id, k, {', '.join(f'lead(v, {d}) over o as v{d}' for d in range(m))} from e window o as (partition by user_id order by k)) where v{m - 1} is not null), c{m} as (select a.user_id, count(*) as c from g{m} a join g{m} b on a.user_id = b.user_id and a.k <> b.k and {' and '.join(f'abs(a.v{d}-b.v{d}) < 0.2' for d in range(m))} group by 1)" for m in (2, 3))
add("sample_entropy", U, ["sample_entropy_m=2_r=0.2"], over_events(lambda df: Extractor([], R, [Kernel(["sample_entropy_m=2_r=0.2"], lambda x, y, t, p: [kernels.sample_entropy(x, y)])]).transform(df)), f"""{INTER}, {SAMPLE} select c2.user_id, -ln(coalesce(c3.c, 0) / (c2.c + 1e-6) + 1e-100) as "sample_entropy_m=2_r=0.2" from c2 left join c3 on c2.user_id = c3.user_id""", 6)

# --- batteries
_fix, _sac = ([f"{p}_{f}_{n}" for n in batteries.BASIC] for p, f in (("fix", "duration"), ("sac", "length")))
add("battery_simple", U, [*_fix, *_sac], over_events(lambda df: batteries.simple_battery(R).transform(df)), f"""{STEPS} select user_id, {", ".join(f'{AGG[n].format(v=c, c="true")} as "{p}_{c}_{n}"' for p, c in (("fix", "duration"), ("sac", "length")) for n in batteries.BASIC)} from s group by user_id""")
add("battery_recurrence", U, ["rec_metric_euclidean_length_1_rho_0.1", "corm_euclidean_length_1_rho_0.1"], over_events(lambda df: Extractor([], R, [batteries.recurrence(measures=("rec", "corm"))]).transform(df)), f"""{RQA}, m as (select user_id, count(*) as m, sum(j-i) as far from c group by 1)
select n.user_id, 200 * (coalesce(m,0) + 1e-7) / (n*(n-1)) as "rec_metric_euclidean_length_1_rho_0.1", 100 * coalesce(far,0) / ((n-1) * (coalesce(m,0) + 1e-7)) as "corm_euclidean_length_1_rho_0.1" from n left join m on n.user_id = m.user_id""", 6)  # fmt: skip
add("length_report", ["trajectories", "rows_min", "rows_max"], ["rows_mean", "rows_std"], over_events(lambda df: reports.length_report(df, R)), f"with f as ({EVENTS_SQL}), n as (select user_id, count(*) as k from f group by 1) select count(*) as trajectories, min(k) as rows_min, max(k) as rows_max, avg(k) as rows_mean, stddev_pop(k) as rows_std from n")

# --- fixations, blinks, areas
IVT = f"""with f as ({EVENTS_SQL}), v as (select *, sqrt(pow(lead(x) over w - x, 2) + pow(lead(y) over w - y, 2)) as step, lead(t) over w - t as dt from f {W}), g as (select *, step / (dt + 1e-10) <= 5e-6 as fl from v where dt is not null),
h as (select *, case when fl and not coalesce(lag(fl) over w, false) then 1 else 0 end as st from g {W}), i as (select *, sum(st) over (partition by user_id order by t, event_id rows unbounded preceding) as fixation_id from h),
r as (select user_id, fixation_id, avg(x) as x, avg(y) as y, min(t) as start_time, max(t) as end_time, min(step) as distance_min, max(step) as distance_max from i where fl group by 1, 2)"""
NEAR = f"""{IVT}, l as (select *, x - lag(x) over o as dx, y - lag(y) over o as dy, start_time - lag(end_time) over o as gap from r window o as (partition by user_id order by start_time)),
z as (select user_id, fixation_id, x, y, start_time, end_time, distance_min, distance_max, end_time - start_time as duration, coalesce(gap, 0) as saccade_duration, coalesce(sqrt(dx*dx+dy*dy), 0) as saccade_length from l)"""
ROLL = ["x", "y", "start_time", "end_time", "distance_min", "distance_max"]
add("ivt_fixations", ["user_id", "fixation_id"], ROLL, over_events(lambda df: fixations.roll_up(fixations.ivt_runs(df, R, 5e-6), R.but(dispersion=None))), f"{IVT} select * from r", 6)
add("ivt_features", ["user_id", "fixation_id"], [*ROLL, "duration", "saccade_duration", "saccade_length"], over_events(lambda df: fixations.ivt(df, R.but(dispersion=None), 5e-6, 1.0)), f"{NEAR} select * from z where duration >= 1", 6)
add("ihmm_fixations", ["user_id", "fixation_id"], ["x", "y", "duration", "diameters"], over_events(lambda df: preprocess.ihmm_fixations(df, R, fixation=(2e-6, 1e-6), saccade=(3e-5, 1e-5), viterbi=True)), None, 6)


def pupil(df: DataFrame) -> DataFrame:
    return df.withColumn("pupil", F.when(F.col("aoi") != "error", F.col("x") * 4)).withColumn("t", F.col("t") / 1000)


PUPIL = f"with f as (select * replace (t / 1000 as t), case when aoi <> 'error' then x * 4 end as pupil from ({EVENTS_SQL}))"
GAPS = f"""{PUPIL}, g as (select *, pupil is null as fl, row_number() over w - 1 as seq from f {W}), h as (select *, case when fl and not coalesce(lag(fl) over w, false) then 1 else 0 end as st from g {W}), i as (select *, sum(st) over (partition by user_id order by t, event_id rows unbounded preceding) as run from h)"""
add("blink_merge", U, ["onset", "offset", "duration"], over_events(lambda df: fixations.pupil_blinks(pupil(df), R, "pupil", gap=0.0, min_duration=1.0, min_separation=20.0)), f"""{GAPS}, b as (select user_id, run, min(t) as onset, max(t) as "offset" from i where fl group by 1, 2), k as (select * from b where "offset" - onset > 0),
m as (select *, case when coalesce(onset - lag("offset") over (partition by user_id order by onset, "offset") >= 20, true) then 1 else 0 end as nw from k), n as (select *, sum(nw) over (partition by user_id order by onset, "offset" rows unbounded preceding) as span from m),
o as (select user_id, span, min(onset) as onset, max("offset") as "offset" from n group by 1, 2) select user_id, onset, "offset", "offset" - onset as duration from o where "offset" - onset >= 1""", 6)  # fmt: skip
add("interp_gaps", ["user_id", "event_id"], ["pupil"], over_events(lambda df: fixations.interpolate_gaps(pupil(df), R, "pupil", 30.0)), f"""{GAPS}, z as (select *, case when fl then max(t) over (partition by user_id, run, fl) - min(t) over (partition by user_id, run, fl) end as len,
 last_value(case when not fl then seq end ignore nulls) over (partition by user_id order by t, event_id rows between unbounded preceding and current row) as s0, last_value(pupil ignore nulls) over (partition by user_id order by t, event_id rows between unbounded preceding and current row) as v0,
 first_value(case when not fl then seq end ignore nulls) over (partition by user_id order by t, event_id rows between current row and unbounded following) as s1, first_value(pupil ignore nulls) over (partition by user_id order by t, event_id rows between current row and unbounded following) as v1 from i)
select user_id, event_id, case when pupil is not null then pupil when len <= 30 then coalesce(v0 + (v1 - v0) * (seq - s0) / nullif(s1 - s0, 0), v0, v1) end as pupil from z""", 6)  # fmt: skip
SHAPES = (("r", (0.1, 0.1), (0.4, 0.5)), ("c", (0.6, 0.6), 0.2), ("e", (0.3, 0.7), (0.3, 0.2), 30.0))
add("shape_aoi", ["user_id", "event_id", "AOI"], [], over_events(lambda df: fixations.shape_areas(df, R, SHAPES)), f"""with f as ({EVENTS_SQL}) select user_id, event_id, case
 when pow((x-0.3)*cos(radians(30.0)) + (y-0.7)*sin(radians(30.0)), 2) / pow(0.3::double, 2) + ((x-0.3)*sin(radians(30.0)) - (y-0.7)*cos(radians(30.0))) / pow(0.2::double, 2) <= 1 then 'aoi_2'
 when sqrt(pow(x-0.6,2) + pow(y-0.6,2)) <= 0.2 then 'aoi_1' when x between 0.1 and 0.4 and y between 0.1 and 0.5 then 'aoi_0' end as "AOI" from f""")  # fmt: skip
add("aoi_extract", ["cohort", "user_id", "event_id", "AOI", "best_method"], [], over_events(lambda df: preprocess.extract_areas(df, R, {"threshold": preprocess.threshold_method(11, 0.4), "gradient": preprocess.gradient_method(21, 0.4)}, ["cohort"], centre=False)))
add("aoi_match", ["cohort", "user_id", "event_id", "AOI"], [], over_events(lambda df: preprocess.match_areas(fixations.shape_areas(df, R, SHAPES), R, ["cohort"])))

# --- maps, sequences, graphs
SCALED = f"""with f as ({EVENTS_SQL}), q as (select *, row_number() over w - 1 as seq from f {W}), m as (select user_id, seq, t, x, y, (x - min(x) over p) / (max(x) over p - min(x) over p) as sx, (y - min(y) over p) / (max(y) over p - min(y) over p) as sy from q window p as (partition by user_id))"""


def hilbert_sql(p: int) -> str:
    out, u, v, h = [], "u", "v", "0"
    n = 1 << p
    out.append(f"h0 as (select user_id, seq, cast(round_even(sx * {n}, 0) as bigint) as u, cast(round_even(sy * {n}, 0) as bigint) as v, 0::bigint as h from m)")
    for k, level in enumerate(range(p - 1, -1, -1)):
        s = 1 << level
        rx, ry = f"(case when (u & {s}) > 0 then 1 else 0 end)", f"(case when (v & {s}) > 0 then 1 else 0 end)"
        turn = f"{ry} = 0 and {rx} = 1"
        fx, fy = f"(case when {turn} then {n - 1} - u else u end)", f"(case when {turn} then {n - 1} - v else v end)"
        out.append(f"h{k + 1} as (select user_id, seq, case when {ry} = 0 then {fy} else {fx} end as u, case when {ry} = 0 then {fx} else {fy} end as v, h + {s * s} * xor(3 * {rx}, {ry}) as h from h{k})")
    return f"{SCALED}, {', '.join(out)} select user_id, seq, h from h{p}"


add("hilbert", ["user_id", "seq", "h"], [], over_events(lambda df: maps.hilbert(df, R)), hilbert_sql(4))
add("hilbert_encoding", ["user_id", "ones", "size"], [], over_events(lambda df: maps.hilbert_encoding(df, R).select("user_id", F.aggregate("code", F.lit(0), lambda a, b: a + b).cast("long").alias("ones"), F.size("code").alias("size"))), f"select user_id, count(distinct h) as ones, 256::int as size from ({hilbert_sql(4)}) where h < 256 group by user_id")
add("gaf", ["user_id", "i", "j"], ["v"], over_events(lambda df: maps.gramian_field(df, R, "x")), f"{SCALED}, a as (select user_id, seq, acos(greatest(-1, least(1, sx * 2 - 1))) as a from m) select p.user_id, p.seq as i, q.seq as j, sin(p.a - q.a) as v from a p join a q on p.user_id = q.user_id", 6)
MTM = f"""with f as ({EVENTS_SQL}), q as (select *, row_number() over w - 1 as seq from f {W}), e as (select user_id, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) as edges from f group by 1), b as (select q.user_id, seq, len(list_filter(edges, lambda z: z < x)) as st from q join e on q.user_id = e.user_id),
mv as (select user_id, st as a, lead(st) over (partition by user_id order by seq) as b from b), k as (select user_id, a, b, count(*) as k from mv where b is not null group by all), tm as (select user_id, a, b, k / sum(k) over (partition by user_id, a) as p from k)"""
add("mtm", ["user_id", "a", "b"], ["share"], over_events(lambda df: maps.transition_matrix(df, R, "x", 5)), f"{MTM} select user_id, a::int as a, b::int as b, p as share from tm")
add("mtf", ["user_id", "i", "j"], ["share"], over_events(lambda df: maps.transition_field(df, R, "x", 5)), f"{MTM} select g.user_id, g.seq as i, h.seq as j, coalesce(p, 0) as share from b g join b h on g.user_id = h.user_id left join tm on tm.user_id = g.user_id and tm.a = g.st and tm.b = h.st")
add("sequences", ["user_id", "length"], ["first_x", "last_y"], over_events(lambda df: maps.sequences(df, R, ["x", "y"], 60).select("user_id", F.col("length").cast("int").alias("length"), F.col("rows")[0][0].alias("first_x"), F.col("rows")[59][1].alias("last_y"))), f"with f as ({EVENTS_SQL}), q as (select user_id, x, y, row_number() over w - 1 as seq from f {W}) select user_id, least(count(*), 60)::int as length, max(case when seq = 0 then x end) as first_x, coalesce(max(case when seq = 59 then y end), 0) as last_y from q group by 1")
CELLS = f"""with f as ({EVENTS_SQL}), q as (select *, row_number() over w - 1 as seq, trunc(x * 10)::int as ci, trunc(y * 10)::int as cj from f {W}), c as (select *, ci * 10 + cj as cell from q), g as (select *, lead(cell) over o as nx, sqrt(pow(lead(x) over o - x, 2) + pow(lead(y) over o - y, 2)) as step from c window o as (partition by user_id order by seq))"""
add("graph_edges", ["user_id", "src", "dst", "times"], ["weight"], over_events(lambda df: maps.graph_edges(df, R)), f"{CELLS}, e as (select user_id, cell as src, nx as dst, count(*) as times, sum(step) as s from g where nx <> cell group by all) select user_id, src, dst, times, s / max(s) over (partition by user_id) as weight from e")
add("graph_nodes", ["user_id", "cell"], ["duration", "length_to", "length_from", "center_x", "center_y"], over_events(lambda df: maps.graph_nodes(df, R)), f"""{CELLS}, o as (select user_id, cell, coalesce(sum(case when nx = cell then duration end), 0) as d, coalesce(sum(case when nx <> cell then step end), 0) as o, max(case when nx <> cell then ci end) as i, max(case when nx <> cell then cj end) as j from g group by 1, 2),
n as (select user_id, nx as cell, sum(step) as t from g where nx <> cell group by 1, 2), z as (select o.user_id, o.cell, d, o, i, j, coalesce(t, 0) as t from o left join n on o.user_id = n.user_id and o.cell = n.cell)
select user_id, cell, case when max(d) over p > 0 then d / max(d) over p else d end as duration, case when max(t) over p > 0 then t / max(t) over p else t end as length_to, case when max(o) over p > 0 then o / max(o) over p else o end as length_from, coalesce((i + 0.5) / 10, 0) as center_x, coalesce((j + 0.5) / 10, 0) as center_y from z window p as (partition by user_id)""")  # fmt: skip
add("kde_heatmap", ["user_id", "i", "j"], ["v"], over_events(lambda df: maps.kde_heatmap(df, R, 6)), f"""with f as ({EVENTS_SQL}), c0 as (select user_id, count(*)::double as n, var_samp(x) as a, covar_samp(x, y) as b, var_samp(y) as c from f group by 1), c as (select user_id, n, a*pow(n,-1.0/3) as a, b*pow(n,-1.0/3) as b, c*pow(n,-1.0/3) as c from c0),
k as (select *, a*c - b*b as det from c), g as (select f.user_id, i, j, i / 5.0::double - x as u, j / 5.0::double - y as v, n, a, b, c, det from f join k on f.user_id = k.user_id and n > 2 and det > 1e-14*(a+c)*(a+c), range(6) r(i), range(6) s(j))
select user_id, i::int as i, j::int as j, sum(exp(-((c*u*u - 2*b*u*v + a*v*v) / det) / 2)) / any_value(n) / (2*pi()*sqrt(any_value(det))) as v from g group by 1, 2, 3""", 6)  # fmt: skip
add("lower_star", ["user_id", "dim"], ["birth", "death"], over_events(lambda df: maps.lower_star(df, R, "x")), f"with f as ({EVENTS_SQL}) select user_id, 0::int as dim, x as birth, null::double as death from f")
add("persistence_curve", U, ["time", "value"], over_events(lambda df: maps.persistence_curve(df.select("user_id", F.col("x").alias("birth"), (F.col("x") + F.col("y")).alias("death")), U, (0.0, 0.25, 0.5, 0.75, 1.0))), f"with f as ({EVENTS_SQL}) select user_id, tm as time, coalesce(sum(case when x <= tm and tm < x + y then (x + y) - x end), 0) as value from f, (values (0.0::double), (0.25), (0.5), (0.75), (1.0)) v(tm) group by 1, 2")
add("rips_diagram", ["user_id", "dim"], ["birth", "death"], over_events(lambda df: maps.rips_diagram(df, R, 0.8)), None, 6)

# --- expected paths and distances
EXPECT = f"""with f as ({EVENTS_SQL}), q as (select *, row_number() over w - 1 as step from f {W}), np as (select cohort, count(distinct user_id) as paths from f group by 1),
ex as (select q.cohort, step, sum(x) / any_value(paths) as x_est, sum(y) / any_value(paths) as y_est, sum(duration) / any_value(paths) as duration_est from q join np on q.cohort = np.cohort group by 1, 2)"""
add("expected_path", ["cohort", "step"], ["x_est", "y_est", "duration_est"], over_events(lambda df: paths.expected_paths(df, R)), f"{EXPECT} select * from ex")
add("fill_path", ["step"], ["x_est", "y_est", "duration_est"], over_events(lambda df: paths.fill_path(paths.expected_paths(df, R), R)), f"{EXPECT}, n as (select count(distinct cohort) as n from ex) select step, sum(x_est) / any_value(n) as x_est, sum(y_est) / any_value(n) as y_est, sum(duration_est) / any_value(n) as duration_est from ex, n group by step")
add("euc_dist", U, ["euc_dist"], over_events(lambda df: paths.step_distances(df, R, paths.expected_paths(df, R))), f"{EXPECT} select user_id, sum(pow(x - x_est, 2) + pow(y - y_est, 2)) as euc_dist from q join ex on q.cohort = ex.cohort and q.step = ex.step group by 1")
PAIRS = f"""{EXPECT}, d as (select q.user_id, q.step as i, ex.step as j, pow(x - x_est, 2) + pow(y - y_est, 2) as d from q join ex on q.cohort = ex.cohort), a as (select user_id, max(m) as pmax, sum(m) as psum, count(*) as n, sum(s) as tot from (select user_id, i, min(d) as m, sum(d) as s from d group by 1, 2) group by 1),
b as (select user_id, max(m) as qmax, sum(m) as qsum, count(*) as m from (select user_id, j, min(d) as m from d group by 1, 2) group by 1)"""
for _n, _e in (("hau_dist", "sqrt(greatest(pmax, qmax))"), ("man_dist", "(m * psum + n * qsum) / (4.0::double * n * m)"), ("eye_dist", "(psum + qsum) / greatest(n, m)"), ("tde_dist", "tot / (n * m)")):
    add(_n, U, [_n], over_events(lambda df, n=_n: paths.pair_distances(df, R, paths.expected_paths(df, R)).select("user_id", n)), f"{PAIRS} select a.user_id, {_e} as {_n} from a join b on a.user_id = b.user_id")
ALL = ("euc", "hau", "dtw", "dfr", "man", "eye", "tde", "scan_match", "multi_match")
add("distance_kernels", U, [n for m in ALL for n in ([f"mm_{x}" for x in kernels.MULTI_MATCH] if m == "multi_match" else [f"{m}_dist"])], over_events(lambda df: paths.path_distances(df, R, ALL)), None, 6)
add("hau_dist_kernel", U, ["hau_dist"], over_events(lambda df: paths.path_distances(df, R, ("hau",))), f"{PAIRS} select a.user_id, sqrt(greatest(pmax, qmax)) as hau_dist from a join b on a.user_id = b.user_id")

# --- normalisation, splits, labels, matrices
add("normalize_window", ["user_id", "event_id"], ["x_norm", "y_norm"], over_events(lambda df: tables.normalize(df, ["cohort"], ["x", "y"])), f"with f as ({EVENTS_SQL}) select user_id, event_id, (x - avg(x) over p) / stddev_samp(x) over p as x_norm, (y - avg(y) over p) / stddev_samp(y) over p as y_norm from f window p as (partition by cohort)", 6)
add("normalize_fit", ["user_id", "event_id"], ["x_norm"], over_events(lambda df: tables.apply_normalization(df, tables.fit_normalization(df.where("cohort < 5"), ["cohort"], ["x"]), ["cohort"], ["x"])), f"with f as ({EVENTS_SQL}) select user_id, event_id, (x - avg(x) over p) / stddev_samp(x) over p as x_norm from f window p as (partition by cohort)", 6)
add("max_normalize", ["user_id", "event_id"], ["norm_pos_x"], over_events(lambda df: tables.scale_by_max(df, "x", "norm_pos_x")), f"with f as ({EVENTS_SQL}) select user_id, event_id, x / (select max(x) from f) as norm_pos_x from f")
add("split_semi", ["user_id", "n"], [], over_events(lambda df: tables.of_fold(df, df.select("user_id").distinct().withColumn("fold", F.when(F.col("user_id") % 5 < 3, "train").otherwise("test")), ["user_id"], "train").groupBy("user_id").agg(F.count("*").alias("n"))), f"with f as ({EVENTS_SQL}) select user_id, count(*) as n from f where user_id % 5 < 3 group by 1")
add("label_join", ["doc_id", "quality", "toxic"], [], lambda s, d: tables.with_labels(s.read.parquet(f"{d}/documents.parquet").select("doc_id"), s.read.parquet(f"{d}/labels.parquet"), ["doc_id"]), "select d.doc_id, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id")
add("group_labels", ["cohort", "aoi"], [], over_events(lambda df: tables.group_labels(df, ["cohort"], ["aoi"], ["t", "event_id"])), f"with f as ({EVENTS_SQL}) select cohort, arg_min(aoi, (t, event_id)) as aoi from f group by 1")
add("impute", ["user_id", "event_id"], ["pupil"], over_events(lambda df: tables.impute(pupil(df), pupil(df).where("cohort < 6"), ["pupil"])), f"{PUPIL} select user_id, event_id, coalesce(pupil, (select avg(pupil) from f where cohort < 6)) as pupil from f", 6)
add("regression_metrics", [], ["mse", "rmse", "mae", "r2"], over_events(lambda df: tables.regression_metrics(df, "x", "y")), f"with f as ({EVENTS_SQL}) select avg((y-x)*(y-x)) as mse, sqrt(avg((y-x)*(y-x))) as rmse, avg(abs(y-x)) as mae, 1 - avg((y-x)*(y-x)) / var_pop(x) as r2 from f", 6)
add("classification_metrics", [], ["accuracy", "precision", "recall", "f1"], over_events(lambda df: tables.classification_metrics(df.withColumn("a", F.col("user_id") % 3).withColumn("b", F.col("event_id") % 3), "a", "b")), f"""with f as (select user_id % 3 as a, event_id % 3 as b from ({EVENTS_SQL})), c as (select a as c, count(*) as n_real, count_if(a = b) as hit from f group by 1), d as (select b as c, count(*) as said from f group by 1),
p as (select hit / said as p, hit / n_real as r, hit, n_real from c join d using (c)) select sum(hit) / sum(n_real) as accuracy, avg(p) as "precision", avg(r) as recall, avg(2*p*r/(p+r)) as f1 from p""")  # fmt: skip


PM = f"""with f as ({EVENTS_SQL}), q as (select user_id, x, y, row_number() over w - 1 as step from f {W}), ids as (select distinct user_id from q),
m as (select cast(a.user_id as varchar) as p, cast(b.user_id as varchar) as q, sum(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as value from q a join q b on a.step = b.step group by 1, 2)"""
add("pairwise_matrix", ["p", "q"], ["value"], over_events(lambda df: tables.pairwise(df, R, lambda a, b: kernels.path_distance("euc", a, b), table=kernels.step_table)), f"{PM} select p, q, value from m", 9)
add("double_center", ["p", "q"], ["value"], over_events(lambda df: tables.pairwise(df, R, lambda a, b: kernels.path_distance("euc", a, b), table=kernels.step_table, centred=True)), f"{PM} select p, q, -0.5 * (value - avg(value) over (partition by p) - avg(value) over (partition by q) + avg(value) over ()) as value from m", 6)
ENTRY = "sac_length"

from trajecta import kernel_queries  # noqa: E402, F401  it declares more

# --- many kernels in one pass; what they give is also registered one by one
MEASURES = {"hurst_x_n10_fill_last": "hurst_x_n10_fill_last", "fuzzy_m_2_r_0.2": "fuzzy", "incremental_entropy": "incremental_entropy", "phase_entropy_m_2_tau_1": "phase_entropy", "lyapunov_exponent_m_2_tau_1_T_1": "lyapunov_exponent", "fractal_dim_m_2_tau_1": "fractal_dim"}
COMPUTE = (
    lambda x, y: kernels.hurst(x), kernels.fuzzy_entropy, kernels.incremental_entropy, kernels.phase_entropy, kernels.lyapunov, lambda x, y: kernels.fractal_dimension(10 * x, 10 * y)
)


def scalar_kernels() -> list[Kernel]:
    return [Kernel([n], lambda x, y, t, p, f=f: [f(x, y)]) for n, f in zip(MEASURES, COMPUTE, strict=True)]


_one = next(iter(MEASURES.values()))
_joined = f"({SQL[_one]}) {_one}" + "".join(f" join ({SQL[m]}) {m} using (user_id)" for m in MEASURES.values() if m != _one)
add("measure_kernels", U, list(MEASURES), over_events(lambda df: Extractor([], R, scalar_kernels()).transform(df)), f"select * from {_joined}", 6)
add("all_features", [*U, "id"], ["sac_length_mean", "reg_mask_sum", "fix_duration_mean", "saccade_nll", "spectral_entropy", *MEASURES], over_events(lambda df: Extractor([P.SaccadeFeatures(), P.RegressionFeatures({"length": BASIC, "mask": ("sum",)}), P.MicroSaccadeFeatures(max_speed=0.5), P.FixationFeatures(), P.SaccadeUnlikelihood(), P.SpectralEntropy()], R, scalar_kernels(), {"cohort": "max"}).transform(df)), f"""{STEPS},
z as (select *, 0.9 * exp(-((length-1)*(length-1)) / (2 * case when length < 1 then 0.25 else 1.0 end)) * 2 / (sqrt(2*pi()) * 1.5) + 0.1 * exp(-((length-1)*(length-1)) / (2 * case when length < 1 then 0.3::double*0.3 else 0.7::double*0.7 end)) * 2 / (sqrt(2*pi()) * 1.0) as p, x*x + y*y as r from s),
b as (select user_id, cast(user_id as varchar) as id, avg(length) as sac_length_mean, sum(case when {BACK} then 1.0 else 0.0 end) as reg_mask_sum, avg(duration) as fix_duration_mean, sum(case when p is null then 0 when p > 1e-15 then -ln(p) else 30 end) as saccade_nll, ln(sum(r)) - sum(case when r > 0 then r * ln(r) else 0 end) / sum(r) as spectral_entropy from z group by user_id)
select * from b join {_joined} using (user_id)""", 6)  # fmt: skip
add("imf", U, ["imf0_mean", "imf0_std"], over_events(lambda df: Extractor([], R, [Kernel(["imf0_mean", "imf0_std"], lambda x, y, t, p: kernels.hht_statistics(kernels.modes(np.column_stack([x, y]), 1)[0], ("mean", "std")))]).transform(df)), None, 6)
