"""Queries of operators that are kernels or sequential, with SQL written from their definitions."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.operators import features as P
from trajecta.operators import fixations, kernels, maps, paths, preprocess, reports, tables
from trajecta.operators.grouped import Kernel
from trajecta.operators.measures import numbered
from trajecta.plans import batteries
from trajecta.plans.extractor import Extractor
from trajecta.registry import NUMBERED, R, U, W, add, over_events
from trajecta.sources.tables import EVENTS_SQL
from trajecta.streaming import steps


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"{v!r}::double" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


def signal(f) -> object:
    return over_events(lambda df: preprocess.smooth(df.select("user_id", "event_id", "t", "x", "y"), R, f))


# --- smoothing
_w = [(k, j, float(c)) for k in range(11) for j, c in enumerate(kernels.savgol_weights(11, 2, at=k))]
add("smooth_savgol", ["user_id", "event_id"], ["x", "y"], signal(preprocess.savgol_filter()), f"""with {NUMBERED}, w(k, j, c) as (values {values(_w)}), p as (select *, greatest(0, least(seq - 5, n - 11)) as s from q where n >= 11)
select p.user_id, p.event_id, sum(c * o.x) as x, sum(c * o.y) as y from p join w on k = p.seq - p.s join q o on o.user_id = p.user_id and o.seq = p.s + j group by 1, 2 union all select user_id, event_id, x, y from q where n < 11""", 6)  # fmt: skip
_w = [(k, float(c)) for k, c in enumerate(kernels.fir_taps(21, 50, 250))]
add("smooth_fir", ["user_id", "event_id"], ["x", "y"], signal(preprocess.fir_filter(21, 250, 50)), f"""with {NUMBERED}, w(k, c) as (values {values(_w)})
select p.user_id, p.event_id, sum(c * o.x) as x, sum(c * o.y) as y from q p join w on true join q o on o.user_id = p.user_id and o.seq = p.seq + 10 - k where p.n > 21 and p.seq between 10 and p.n - 11 group by 1, 2 union all select user_id, event_id, x, y from q where n <= 21""", 6)  # fmt: skip
_b, _a = (list(map(float, v)) for v in kernels.butterworth(3, 0.4))


def _recursive(v: str) -> str:
    before = "".join(f" + ({_b[k]!r}::double) * coalesce(lag({v}, {k}) over w, 0)" for k in (1, 2, 3))
    return f"({_b[0]!r}::double) * {v}{before}"


_next = ", ".join(f"d.i{v}" + "".join(f" - ({_a[k]!r}::double) * r.{v}{k}" for k in (1, 2, 3)) + f", r.{v}1, r.{v}2" for v in "xy")
add("smooth_iir", ["user_id", "event_id"], ["x", "y"], signal(preprocess.iir_filter(3, 0.4)), f"""with recursive {NUMBERED}, d as (select user_id, seq, {_recursive("x")} as ix, {_recursive("y")} as iy from q {W}),
r(user_id, seq, x1, x2, x3, y1, y2, y3) as (select user_id, seq, ix, 0.0::double, 0.0::double, iy, 0.0::double, 0.0::double from d where seq = 0 union all select d.user_id, d.seq, {_next} from r join d on d.user_id = r.user_id and d.seq = r.seq + 1)
select q.user_id, q.event_id, r.x1 as x, r.y1 as y from q join r on r.user_id = q.user_id and r.seq = q.seq + 1 where q.n > 3 and q.seq between 2 and q.n - 2""", 6)  # fmt: skip
_blur = [(m, float(v)) for m, v in enumerate(math.exp(-((m - 5) ** 2) / 0.08) for m in range(11))]
add("smooth_wiener", ["user_id", "event_id"], ["x", "y"], signal(preprocess.wiener_filter()), f"""with {NUMBERED}, b(m, g) as (values {values(_blur)}), s as (select distinct n from q where n > 11),
h as (select n, k, sum(g * cos(2 * pi() * k * (m - 5 + (n - 11) // 2 + 5 - n // 2) / n)) / (select sum(g) from b) as re, -sum(g * sin(2 * pi() * k * (m - 5 + (n - 11) // 2 + 5 - n // 2) / n)) / (select sum(g) from b) as im from s, range(n) t(k), b group by 1, 2),
v as (select user_id, any_value(q.n) as n, k, sum(x * cos(2 * pi() * k * seq / q.n)) as xr, -sum(x * sin(2 * pi() * k * seq / q.n)) as xi, sum(y * cos(2 * pi() * k * seq / q.n)) as yr, -sum(y * sin(2 * pi() * k * seq / q.n)) as yi from q, range(q.n) t(k) where q.n > 11 group by 1, 3),
z as (select user_id, v.n, v.k, (re*xr + im*xi) / (re*re + im*im + 4.3e-5) as xr, (re*xi - im*xr) / (re*re + im*im + 4.3e-5) as xi, (re*yr + im*yi) / (re*re + im*im + 4.3e-5) as yr, (re*yi - im*yr) / (re*re + im*im + 4.3e-5) as yi from v join h on h.n = v.n and h.k = v.k),
o as (select user_id, s as seq, any_value(n) as n, sum(xr * cos(2 * pi() * k * s / n) - xi * sin(2 * pi() * k * s / n)) as xr, sum(xr * sin(2 * pi() * k * s / n) + xi * cos(2 * pi() * k * s / n)) as xi, sum(yr * cos(2 * pi() * k * s / n) - yi * sin(2 * pi() * k * s / n)) as yr, sum(yr * sin(2 * pi() * k * s / n) + yi * cos(2 * pi() * k * s / n)) as yi from z, range(z.n) t(s) group by 1, 2)
select q.user_id, q.event_id, sqrt(xr*xr + xi*xi) / q.n as x, sqrt(yr*yr + yi*yi) / q.n as y from q join o on o.user_id = q.user_id and o.seq = q.seq union all select user_id, event_id, x, y from q where n <= 11""", 6)  # fmt: skip

# --- fixations and circles
add("idt_fixations", ["user_id", "fixation_id"], ["x", "y", "start_time", "end_time", "duration", "saccade_length"], over_events(lambda df: preprocess.idt_fixations(df, R, 10_000.0, 4_000_000.0, 0.6)), f"""with recursive {NUMBERED},
e as (select l.user_id, l.seq as a, l.t as ta, max(r.seq) as b from q l join q r on r.user_id = l.user_id and r.seq >= l.seq and r.t < l.t + 4000000 group by all),
m as (select e.user_id, a, ta, b, r.seq as i, r.t, max(r.x) over g - min(r.x) over g as w, max(r.y) over g - min(r.y) over g as h from e join q r on r.user_id = e.user_id and r.seq between a and b window g as (partition by e.user_id, a order by r.seq rows unbounded preceding)),
c as (select user_id, a, max(case when i = b then t end) - any_value(ta) < 10000 as over, max(case when sqrt(w*w + h*h) <= 0.6 then i end) as last, max(case when sqrt(w*w + h*h) <= 0.6 then t end) - any_value(ta) >= 10000 as fits from m group by 1, 2),
s(user_id, a, last, fits, number) as (select user_id, a, last, fits, fits::int from c where a = 0 and not over union all select c.user_id, c.a, c.last, c.fits, s.number + c.fits::int from s join c on c.user_id = s.user_id and c.a = case when s.fits then s.last + 1 else s.a + 1 end where not c.over),
r as (select q.user_id, s.number as fixation_id, avg(x) as x, avg(y) as y, min(t) as start_time, max(t) as end_time from s join q on q.user_id = s.user_id and q.seq >= s.a and q.seq < s.last where s.fits group by 1, 2),
k as (select *, x - lag(x) over o as dx, y - lag(y) over o as dy from r window o as (partition by user_id order by start_time))
select user_id, fixation_id, x, y, start_time, end_time, end_time - start_time as duration, coalesce(sqrt(dx*dx + dy*dy), 0) as saccade_length from k""", 8)  # fmt: skip
_ivt = f"""{NUMBERED}, v as (select *, sqrt(pow(lead(x) over w - x, 2) + pow(lead(y) over w - y, 2)) as step, lead(t) over w - t as dt from q {W}), g as (select *, step / (dt + 1e-10) <= 5e-6 as fl from v where dt is not null),
h as (select *, case when fl and not coalesce(lag(fl) over w, false) then 1 else 0 end as st from g {W}), i as (select *, sum(st) over (partition by user_id order by t, event_id rows unbounded preceding) as fixation_id from h)"""
add("enclosing_circles", ["user_id", "fixation_id"], ["diameters", "center_x", "center_y"], over_events(lambda df: preprocess.enclosing_circles(fixations.ivt_runs(df, R, 5e-6).where("fixation_id is not null"), R)), f"""with {_ivt}, p as (select distinct user_id, fixation_id, x, y from i where fl),
c as (select user_id, fixation_id, x as cx, y as cy, 0.0::double as r from p union all
 select a.user_id, a.fixation_id, (a.x + b.x) / 2, (a.y + b.y) / 2, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 2 from p a join p b on a.user_id = b.user_id and a.fixation_id = b.fixation_id and (a.x, a.y) < (b.x, b.y) union all
 select user_id, fixation_id, ux + ax, uy + ay, sqrt(ux*ux + uy*uy) from (select a.user_id, a.fixation_id, a.x as ax, a.y as ay, ((c.y - a.y) * (pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) - (b.y - a.y) * (pow(c.x - a.x, 2) + pow(c.y - a.y, 2))) / d as ux, ((b.x - a.x) * (pow(c.x - a.x, 2) + pow(c.y - a.y, 2)) - (c.x - a.x) * (pow(b.x - a.x, 2) + pow(b.y - a.y, 2))) / d as uy
  from p a join p b on a.user_id = b.user_id and a.fixation_id = b.fixation_id and (a.x, a.y) < (b.x, b.y) join p c on a.user_id = c.user_id and a.fixation_id = c.fixation_id and (b.x, b.y) < (c.x, c.y), lateral (select 2 * ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) as d) where abs(d) > 1e-12)),
z as (select c.*, max(pow(p.x - cx, 2) + pow(p.y - cy, 2)) as far from c join p on p.user_id = c.user_id and p.fixation_id = c.fixation_id group by all)
select user_id, fixation_id, 2 * min(r) as diameters, arg_min(cx, r) as center_x, arg_min(cy, r) as center_y from z where far <= r * r * (1 + 1e-9) + 1e-12 group by 1, 2""", 6)  # fmt: skip


# --- blinks
def pupil(df: DataFrame) -> DataFrame:
    return df.withColumn("pupil", F.when(F.col("aoi") != "error", F.col("x") * 4)).withColumn("t", F.col("t") / 1000)


_pupil = f"f as (select * replace (t / 1000 as t), case when aoi <> 'error' then x * 4 end as pupil from ({EVENTS_SQL})), q as (select *, row_number() over w - 1 as seq, count(*) over (partition by user_id) as n from f {W})"
add("missing_pupil_blinks", U, ["onset", "offset", "duration"], over_events(lambda df: preprocess.missing_pupil_blinks(pupil(df), R, "pupil", separation=20.0, min_duration=1.0, window=60.0)), f"""with {_pupil},
g as (select *, pupil is null as gone, lag(t) over w as t0, first_value(case when pupil is null then seq end ignore nulls) over (partition by user_id order by t, event_id rows between current row and unbounded following) as stop from q where n > 10 {W}),
z as (select a.user_id, a.seq, case when a.seq = 0 then any_value(a.pupil) else avg(b.pupil) end as size from g a join g b on b.user_id = a.user_id and b.seq >= a.seq and (b.seq = a.seq or (b.t <= a.t0 + 60 and b.seq < coalesce(a.stop, a.n))) where not a.gone group by 1, 2),
c as (select g.user_id, g.seq, g.t, g.event_id, g.n, gone, case when g.seq = 0 then 0 when not gone and lag(gone) over v then size else size - lag(size) over v end as change from g left join z on z.user_id = g.user_id and z.seq = g.seq window v as (partition by g.user_id order by g.seq)),
d as (select *, first_value(case when not coalesce(change < 0, false) then seq end ignore nulls) over (partition by user_id order by seq rows between current row and unbounded following) as falls_to, last_value(case when not coalesce(change > 0, false) then seq end ignore nulls) over (partition by user_id order by seq rows between unbounded preceding and current row) as rises_from from c),
e as (select d.*, d.gone or coalesce(u.gone and u.seq >= 2, false) or coalesce(l.gone and l.seq <= d.n - 3, false) as fl from d left join c u on u.user_id = d.user_id and u.seq = d.falls_to left join c l on l.user_id = d.user_id and l.seq = d.rises_from),
h as (select *, case when fl and not coalesce(lag(fl) over (partition by user_id order by seq), false) then 1 else 0 end as st from e), i as (select *, sum(st) over (partition by user_id order by seq rows unbounded preceding) as run from h where user_id in (select user_id from g where gone)),
b as (select user_id, run, min(t) as onset, max(t) as "offset" from i where fl group by 1, 2), m as (select *, case when coalesce(onset - lag("offset") over (partition by user_id order by onset) >= 20, true) then 1 else 0 end as nw from b),
o as (select *, sum(nw) over (partition by user_id order by onset rows unbounded preceding) as span from m), k as (select user_id, span, min(onset) as onset, max("offset") as "offset" from o group by 1, 2)
select user_id, onset, "offset", "offset" - onset as duration from k where "offset" - onset >= 1""", 6)  # fmt: skip
add("pupil_outliers", ["user_id", "event_id"], ["pupil"], over_events(lambda df: preprocess.without_outliers(pupil(df).select("user_id", "event_id", "t", "pupil"), R, "pupil", 9, 0.5)), f"""with {_pupil}, p as (select *, least(seq, n - 9) as k from q)
select p.user_id, p.event_id, case when any_value(p.n) < 9 then case when any_value(p.pupil) >= 0.5 then any_value(p.pupil) end when abs(any_value(p.pupil) - avg(o.pupil)) > 3 * stddev_pop(o.pupil) then null else any_value(p.pupil) end as pupil from p left join q o on o.user_id = p.user_id and o.seq between p.k and p.k + 8 group by 1, 2""", 6)  # fmt: skip

# --- measures
_inter = f"{NUMBERED}, e as (select user_id, n, 2 * seq as k, x as v from q union all select user_id, n, 2 * seq + 1, y from q)"


def _measure(name: str, compute, sql: str, digits: int = 6) -> None:
    add(name.split("_m_")[0] if "_m_" in name else name, U, [name], over_events(lambda df: Extractor([], R, [Kernel([name], lambda x, y, t, p: [compute(x, y)])]).transform(df)), sql, digits)


_measure("hurst_x_n10_fill_last", lambda x, y: kernels.hurst(x), f"""with {NUMBERED}, s as (select user_id, n, (2 << floor(log2(n))::int) as size from (select distinct user_id, n from q)), b as (select user_id, n, size, i, size >> h as len from s, range(size) t(i), range(10) u(h) where size >> h > 2),
v as (select b.user_id, len, i // len as blk, i, q.x as v from b join q on q.user_id = b.user_id and q.seq = least(b.i, b.n - 1)), m as (select *, v - avg(v) over (partition by user_id, len, blk) as c from v), w as (select user_id, len, blk, c, v, sum(c) over (partition by user_id, len, blk order by i rows unbounded preceding) as walk from m),
r as (select user_id, len, blk, case when max(v) = min(v) then 0 else (max(walk) - min(walk)) / (sqrt(avg(c * c)) + 1e-22) end as r from w group by 1, 2, 3), z as (select user_id, len, avg(r) as r from r group by 1, 2) select user_id, regr_slope(ln(r), ln(len)) as hurst_x_n10_fill_last from z group by 1""")  # fmt: skip
_fuzzy = ", ".join(f"g{m} as (select * from (select user_id, k, n, {', '.join(f'lead(v, {d}) over o as v{d}' for d in range(m))} from e window o as (partition by user_id order by k)) where k < 2 * n - {m}), p{m} as (select a.user_id, sum(exp(-pow(greatest({', '.join(f'abs(a.v{d} - b.v{d})' for d in range(m))}), 2) / 0.08)) / (2 * any_value(a.n) - {m}) as p from g{m} a join g{m} b on a.user_id = b.user_id group by 1)" for m in (2, 3))
_measure("fuzzy_m_2_r_0.2", lambda x, y: kernels.fuzzy_entropy(x, y), f'with {_inter}, {_fuzzy} select p2.user_id, ln(p2.p / (p3.p + 1e-7)) as "fuzzy_m_2_r_0.2" from p2 join p3 on p2.user_id = p3.user_id')
_two = f"{_inter}, d as (select * from (select user_id, k, v as v0, lead(v) over (partition by user_id order by k) as v1 from e) where v1 is not null)"
_measure("lyapunov_exponent_m_2_tau_1_T_1", lambda x, y: kernels.lyapunov(x, y), f"""with {_two}, a as (select a.user_id, a.k, arg_min(b.k, (sqrt(pow(a.v0 - b.v0, 2) + pow(a.v1 - b.v1, 2)), b.k)) as near from d a join d b on a.user_id = b.user_id and a.k <> b.k group by 1, 2),
g as (select a.user_id, sqrt(pow(p.v0 - r.v0, 2) + pow(p.v1 - r.v1, 2)) as gap from a join d p on p.user_id = a.user_id and p.k = a.k + 1 join d r on r.user_id = a.user_id and r.k = a.near + 1) select user_id, avg(case when gap > 0 then ln(gap) end) as lyapunov_exponent_m_2_tau_1_T_1 from g group by 1""")  # fmt: skip
_measure("fractal_dim_m_2_tau_1", lambda x, y: kernels.fractal_dimension(10 * x, 10 * y), f"""with {_two}, m as (select user_id, least(min(v0), min(v1)) * 10 as lo from d group by 1), p as (select d.user_id, 10 * v0 - lo as a, 10 * v1 - lo as b from d join m on m.user_id = d.user_id), t as (select user_id, greatest(max(a), max(b)) as top from p group by 1),
s as (select user_id, h, case h when 0 then 1 when 19 then top else exp(ln(top) * h / 19) end as size from t, range(20) r(h)), c as (select p.user_id, h, any_value(size) as size, count(distinct (floor(a / size), floor(b / size))) as boxes from p join s on s.user_id = p.user_id group by 1, 2) select user_id, -regr_slope(ln(boxes), ln(size)) as fractal_dim_m_2_tau_1 from c group by 1""")  # fmt: skip


def _density(rows: str, key: str) -> str:
    """Entropy of the densities of a histogram with automatic bins, for each key of rows (key, v)."""
    return f"""b as (select {key}, count(*) as m, min(v) as lo, max(v) as hi, 2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) * pow(count(*), -1.0::double / 3) as fd from {rows} group by {key}),
w as (select *, case when hi = lo then 1 else ceil((hi - lo) / least(greatest(fd, (hi - lo) / sqrt(m) / 2), (hi - lo) / (log2(m) + 1)))::int end as bins, case when hi = lo then lo - 0.5 else lo end as a, case when hi = lo then hi + 0.5 else hi end as z from b),
i as (select r.*, m, bins, a, z, (z - a) / bins as step, least(floor((v - a) / (z - a) * bins), bins - 1)::int as j from {rows} r join w using ({key})),
c as (select {key}, any_value(m) as m, any_value(step) as step, j - (v < a + j * step)::int + (v >= a + (j + 1) * step and j <> bins - 1)::int as cell, count(*) as k from i group by {key}, cell)"""


_measure("incremental_entropy", lambda x, y: kernels.incremental_entropy(x, y), f"""with {_inter}, s as (select o.user_id, o.k as upto, e.v from e o join e on e.user_id = o.user_id and e.k <= o.k where o.k between 1 and o.n - 1), {_density("s", "user_id, upto")},
h as (select user_id, upto, -sum(k / (m * step) * ln(k / (m * step))) as h from c group by 1, 2) select user_id, sum(h) / (count(*) + 1) as incremental_entropy from h group by 1""")  # fmt: skip
_measure("phase_entropy_m_2_tau_1", lambda x, y: kernels.phase_entropy(x, y), f"""with {_two}, s as (select a.user_id, sqrt(pow(a.v0 - b.v0, 2) + pow(a.v1 - b.v1, 2)) as v from d a join d b on a.user_id = b.user_id), {_density("s", "user_id")} select user_id, -sum(k / (m * step) * ln(k / (m * step))) as phase_entropy_m_2_tau_1 from c group by 1""")

# --- paths
_expect = f"""{NUMBERED}, np as (select cohort, count(distinct user_id) as paths from f group by 1), ex as (select q.cohort, seq as step, sum(x) / any_value(paths) as x_est, sum(y) / any_value(paths) as y_est from q join np on q.cohort = np.cohort group by 1, 2),
pt as (select cohort, list({{'a': x_est, 'b': y_est}} order by step) as path from ex group by 1)"""


def _path_sql(name: str, start: str, border: str, join: str) -> str:
    """A table of costs row by row: row holds a border and the values along the expected path."""
    return f"""with recursive {_expect}, d(user_id, seq, row) as (select u.user_id, -1::bigint, [{start}] || list_transform(path, lambda p: 'inf'::double) from (select distinct user_id, cohort from q) u join pt on pt.cohort = u.cohort union all
 select q.user_id, q.seq, list_reduce(range(1, len(c) + 1), lambda acc, j: acc || [{join}], [{border}]) from d join q on q.user_id = d.user_id and q.seq = d.seq + 1 join pt on pt.cohort = q.cohort, lateral (select list_transform(path, lambda p: pow(q.x - p.a, 2) + pow(q.y - p.b, 2)) as c))
select q.user_id, row[-1] as {name} from d join q on q.user_id = d.user_id and q.seq = d.seq where q.seq = q.n - 1"""


add("dtw_dist", U, ["dtw_dist"], over_events(lambda df: paths.path_distances(df, R, ("dtw",))), _path_sql("dtw_dist", "0.0::double", "c[-1]", "c[j] + least(row[j + 1], acc[-1], row[j])"), 6)
add("dtw_textbook_dist", U, ["dtw_textbook_dist"], over_events(lambda df: paths.path_distances(df, R, ("dtw_textbook",))), _path_sql("dtw_textbook_dist", "0.0::double", "'inf'::double", "c[j] + least(row[j + 1], acc[-1], row[j])"), 6)
add("dfr_dist", U, ["dfr_dist"], over_events(lambda df: paths.path_distances(df, R, ("dfr",))), _path_sql("dfr_dist", "'-inf'::double", "'inf'::double", "greatest(c[j], least(row[j + 1], acc[-1], row[j]))"), 6)
add("expected_path_fwp", ["cohort", "step"], ["x_est", "y_est", "duration_est"], over_events(lambda df: paths.expected_paths(df, R, "fwp")), f"""with recursive {NUMBERED}, it(cohort, step, k, mx, my) as (select cohort, seq, 0, avg(x), avg(y) from q group by 1, 2 union all
 select it.cohort, it.step, it.k + 1, sum(x / d) / sum(1 / d), sum(y / d) / sum(1 / d) from it join q on q.cohort = it.cohort and q.seq = it.step, lateral (select greatest(sqrt(pow(q.x - mx, 2) + pow(q.y - my, 2)), 1e-12) as d) where it.k < 200 group by it.cohort, it.step, it.k)
select q.cohort, q.seq as step, any_value(mx) as x_est, any_value(my) as y_est, avg(duration) as duration_est from q join it on it.cohort = q.cohort and it.step = q.seq and it.k = 200 group by 1, 2""", 7)  # fmt: skip

# --- maps

def image_totals(df: DataFrame) -> DataFrame:
    made = maps.images(df, R, ("heatmap", "gaf", "mtf", "rqa"), (16, 16))
    moment = F.aggregate(F.zip_with("data", F.sequence(F.lit(0), F.lit(255)), lambda v, k: v * k), F.lit(0.0), lambda a, b: a + b)
    return made.select("user_id", "channel", "h", "w", F.aggregate("data", F.lit(0.0), lambda a, b: a + b).alias("total"), moment.alias("moment"))


_fields = " union all ".join(f"select user_id, '{channel}' as channel, a.seq as i, b.seq as j, ({value})::double as v from s a join s b using (user_id)" for channel, value in (("gaf_x", "sin(a.px - b.px)"), ("gaf_y", "sin(a.py - b.py)"), ("rqa", "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.1")))
_fields += "".join(f" union all select a.user_id, 'mtf_{v}', a.seq, b.seq, coalesce(p, 0) from s a join s b using (user_id) left join t{v} on t{v}.user_id = a.user_id and t{v}.a = a.s{v} and t{v}.b = b.s{v}" for v in "xy")
_moves = ", ".join(f"m{v} as (select user_id, s{v} as a, lead(s{v}) over (partition by user_id order by seq) as b from s), t{v} as (select user_id, a, b, count(*) / sum(count(*)) over (partition by user_id, a) as p from m{v} where b is not null group by 1, 2, 3)" for v in "xy")
_edges = ", ".join(f"quantile_cont({v}, [{', '.join(str(k / 10) for k in range(1, 10))}]) as e{v}" for v in "xy")
add("images", ["user_id", "channel", "h", "w"], ["total", "moment"], over_events(image_totals), f"""with {NUMBERED}, u as (select user_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, {_edges} from q group by 1),
s as (select q.user_id, seq, n, x, y, acos(greatest(-1, least(1, 2 * (x - x0) / (x1 - x0) - 1))) as px, acos(greatest(-1, least(1, 2 * (y - y0) / (y1 - y0) - 1))) as py, len(list_filter(ex, lambda z: z < x)) as sx, len(list_filter(ey, lambda z: z < y)) as sy from q join u on u.user_id = q.user_id),
{_moves}, z as (select n, k, least(floor(k * (n - 1) / 15.0::double), n - 2) as lo, k * (n - 1) / 15.0::double as pos from (select distinct n from q), range(16) r(k)), g as (select n, i, sum(w) as w, sum(k * w) as m from (select n, k, lo as i, 1 - (pos - lo) as w from z union all select n, k, lo + 1, pos - lo from z) group by 1, 2),
v as ({_fields}), o as (select v.user_id, channel, sum(v * a.w * b.w) as total, sum(v * (16 * a.m * b.w + a.w * b.m)) as moment from v join (select distinct user_id, n from q) c on c.user_id = v.user_id join g a on a.n = c.n and a.i = v.i join g b on b.n = c.n and b.i = v.j group by 1, 2),
k0 as (select user_id, n::double as n, var_samp(x) * pow(n, -1.0::double / 3) as a, covar_samp(x, y) * pow(n, -1.0::double / 3) as b, var_samp(y) * pow(n, -1.0::double / 3) as c from q group by user_id, n), k1 as (select *, a*c - b*b as det from k0),
hm as (select q.user_id, 'heatmap' as channel, sum(e) as total, sum(e * (16 * i + j)) as moment from q join k1 on k1.user_id = q.user_id, range(16) r(i), range(16) s(j), lateral (select i / 15.0::double - q.x as p, j / 15.0::double - q.y as o), lateral (select exp(-((c*p*p - 2*b*p*o + a*o*o) / det) / 2) / (k1.n * 2 * pi() * sqrt(det)) as e) group by 1)
select user_id, channel, 16::int as h, 16::int as w, total, moment from (select * from o union all select * from hm)""", 3)  # fmt: skip
_angle = "case when dx = 0 then case when dy > 0 then 90 when dy < 0 then -90 else 0 end when dx < 0 then degrees(atan(dy/dx)) + 180 when degrees(atan(dy/dx)) < 0 then degrees(atan(dy/dx)) + 360 else degrees(atan(dy/dx)) end"
add("marks", ["user_id", "layer", "seq", "bin", "backward"], ["x0", "y0", "x1", "y1"], over_events(lambda df: maps.marks(df, R)), f"""with {NUMBERED}, m as (select *, max(duration) over (partition by user_id) as top, lead(x) over w as nx, lead(y) over w as ny from q {W}), s as (select *, {_angle} as turn from (select *, nx - x as dx, ny - y as dy from m where nx is not null))
select user_id, 'point' as layer, seq, case when duration < top then floor(duration / top * 5)::int end as bin, false as backward, x as x0, y as y0, x as x1, y as y1 from m union all select user_id, 'step', seq, null, turn - 360 * floor(turn / 360) between 135 and 225, x, y, nx, ny from s""")  # fmt: skip

# --- splits and matrices
add("splits", ["user_id", "fold"], [], over_events(lambda df: tables.folds(df.select("user_id").distinct(), ["user_id"])), f"with f as ({EVENTS_SQL}), h as (select distinct user_id, cast('0x' || substr(md5('42_' || user_id), 1, 8) as bigint) % 100 as h from f) select user_id, case when h < 60 then 'train' when h < 80 then 'val' else 'test' end as fold from h")
add("similarity_matrix", ["p", "q"], ["value"], over_events(lambda df: tables.pairwise(df, R, lambda a, b: 1 / (1 + kernels.path_distance("euc", a, b)), similarity=True, table=lambda a, b: 1 / (1 + kernels.step_table(a, b)))), f"""with {NUMBERED}, m as (select cast(a.user_id as varchar) as p, cast(b.user_id as varchar) as q, case when a.user_id = b.user_id then 1 else 1 / (1 + sum(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) end as value from q a join q b on a.seq = b.seq group by a.user_id, b.user_id) select p, q, (value + 1) / (max(value) over () + 1) as value from m""", 6)

# --- statistics, tables, batteries
_length = f"{NUMBERED}, s as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as length from q {W})"
add("sac_more_moments", U, [f"sac_length_{n}" for n in ("sem", "prod", "first", "last", "nunique", "quantile", "mad")], over_events(lambda df: Extractor([P.SaccadeFeatures({"length": ("sem", "prod", "first", "last", "nunique", "quantile", "mad")})], R).transform(df)), f"""with {_length}, m as (select user_id, avg(length) as m from s group by 1)
select s.user_id, stddev_samp(length) / sqrt(count(length)) as sac_length_sem, product(length) as sac_length_prod, arg_min(length, (t, event_id)) filter (length is not null) as sac_length_first, arg_max(length, (t, event_id)) filter (length is not null) as sac_length_last,
 count(distinct length) as sac_length_nunique, median(length) as sac_length_quantile, avg(abs(length - m)) as sac_length_mad from s join m on m.user_id = s.user_id group by 1""", 6)  # fmt: skip
add("auc", [], ["auc"], over_events(lambda df: tables.auc(df.withColumn("truth", (F.col("event_id") % 3 == 0).cast("int")).withColumn("score", F.floor(F.col("x") * 100)), "truth", "score")), f"""with f as (select event_id % 3 = 0 as truth, floor(x * 100) as s from ({EVENTS_SQL})), c as (select s, count_if(truth) as p, count_if(not truth) as n from f group by 1), r as (select p, n, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from c)
select sum(p * (below + n / 2.0::double)) / (sum(p) * sum(n)) as auc from r""")  # fmt: skip
_areas = ("click", "error", "purchase", "signup", "view")
add("pivot", ["cohort", *_areas], [], over_events(lambda df: tables.pivoted(df, ["cohort"], "aoi", F.count("event_id"))), f"with f as ({EVENTS_SQL}) select cohort, {', '.join(f"""nullif(count_if(aoi = '{a}'), 0) as {a}""" for a in _areas)} from f group by 1")
_names = [f"simple_{c}" for c in ("fix_duration_mean", "fix_duration_sum", "sac_length_mean")] + ["spectral_spectral_entropy"]
add("merge_batteries", U, _names, over_events(lambda df: batteries.merge_batteries({"simple": batteries.simple_battery(R).transform(df), "spectral": Extractor([P.SpectralEntropy()], R).transform(df.where("cohort < 5"))}, ["user_id"])), f"""with {_length}, a as (select user_id, avg(duration) as d, sum(duration) as ds, avg(length) as l from s group by 1), e as (select user_id, x*x + y*y as r from q where cohort < 5), b as (select user_id, ln(sum(r)) - sum(case when r > 0 then r * ln(r) else 0 end) / sum(r) as h from e group by 1)
select a.user_id, d as simple_fix_duration_mean, ds as simple_fix_duration_sum, l as simple_sac_length_mean, h as spectral_spectral_entropy from a left join b on a.user_id = b.user_id""")  # fmt: skip
_distances = [f"{m}_dist_{h}" for h in ("mean", "fwp") for m in ("euc", "dtw", "hau")]
add("distance_battery", U, _distances, over_events(lambda df: batteries.distance_battery(df, df.where("user_id % 2 = 0"), R, ("euc", "dtw", "hau"))), None, 5)
add("extended_battery", U, ["sac_length_median", "reg_mask_sum", "fix_duration_kurtosis"], over_events(lambda df: batteries.extended_battery(R).transform(df)), f"""with {_length}, a as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy from s {W}), b as (select *, {_angle} as turn from a)
select user_id, median(length) as sac_length_median, sum(coalesce((turn - 360 * floor(turn / 360)) between 135 and 225 and dx is not null, false)::int)::double as reg_mask_sum, case when count(duration) >= 4 then kurtosis(duration) end as fix_duration_kurtosis from b group by 1""", 6)  # fmt: skip


def _eyes(df: DataFrame) -> DataFrame:
    """An openness signal of 100 samples a second: an eye that closes every 0.4 s, each time deeper."""
    rows = numbered(df, R).withColumn("at", (F.col("seq") % 40 - 20) / 4.0)
    return rows.select("user_id", "event_id", (F.col("seq") * 10.0).alias("t"), (1 - (0.6 + 0.01 * F.floor(F.col("seq") / 40)) * F.exp(-F.col("at") * F.col("at"))).alias("eo"))


add("topological_features", U, ["time", "curve", "entropy"], over_events(lambda df: reports.topological_features(df, R, 0.6, 0.5, 6)), None, 6)
add("openness_blinks", U, ["onset", "offset", "duration", "openness_at_peak"], over_events(lambda df: preprocess.openness_blinks(_eyes(df), R, "eo", 100.0)), None, 6)
add("overlap_aoi", ["user_id", "event_id", "AOI"], [], over_events(lambda df: preprocess.extract_areas(df.withColumn("diameters", F.col("dispersion") / 100), R, {"overlap": preprocess.overlap_method("diameters", ("x", "y"))}, ["user_id"], columns=["diameters"])))

# fixations by a hidden Markov model; the two distributions have closed forms
_cost = f"""{NUMBERED}, v as (select *, sqrt(pow(lead(x) over w - x, 2) + pow(lead(y) over w - y, 2)) / (lead(t) over w - t + 1e-10) as speed from q {W}),
z as (select *, (speed - 2e-6) / 1e-6 as a, (speed - 3e-5) / 1e-5 as b from v where seq < n - 1),
c as (select user_id, seq, n, -ln(greatest(1 - case when a < 0 then 0.5 * exp(least(a, 0)) else 1 - 0.5 * exp(-greatest(a, 0)) end, 1e-10)) as c0, -ln(greatest(1 / (1 + exp(-b)), 1e-10)) as c1 from z)"""
_stay, _move = f"({-math.log(0.95)!r}::double)", f"({-math.log(0.05)!r}::double)"
_runs = """h as (select *, case when fix and not coalesce(lag(fix) over o, false) then 1 else 0 end as st from g window o as (partition by user_id order by seq)), i as (select *, cast(sum(st) over (partition by user_id order by seq rows unbounded preceding) as integer) as fixation_id from h)
select i.user_id, fixation_id, avg(x) as x, avg(y) as y, max(t) - min(t) as duration from i join q on q.user_id = i.user_id and q.seq = i.seq where fix group by 1, 2"""


def _ihmm(viterbi: bool) -> object:
    return over_events(lambda df: preprocess.ihmm_fixations(df, R, fixation=(2e-6, 1e-6), saccade=(3e-5, 1e-5), viterbi=viterbi, distributions=("laplace", "logistic")))


add("ihmm_laplace", ["user_id", "fixation_id"], ["x", "y", "duration"], _ihmm(False), f"""with recursive {_cost}, r(user_id, seq, n0, n1) as (select user_id, seq, c0 - ln(0.5::double), c1 - ln(0.5::double) from c where seq = 0 union all
 select c.user_id, c.seq, c0 + greatest(n0 + {_stay}, n1 + {_move}), c1 + greatest(n0 + {_move}, n1 + {_stay}) from r join c on c.user_id = r.user_id and c.seq = r.seq + 1), g as (select user_id, seq, not n1 > n0 as fix from r), {_runs}""", 8)  # fmt: skip
add("ihmm_viterbi", ["user_id", "fixation_id"], ["x", "y", "duration"], _ihmm(True), f"""with recursive {_cost}, r(user_id, seq, n0, n1, b0, b1) as (select user_id, seq, c0 - ln(0.5::double), c1 - ln(0.5::double), 0, 0 from c where seq = 0 union all
 select c.user_id, c.seq, c0 + least(n0 + {_stay}, n1 + {_move}), c1 + least(n0 + {_move}, n1 + {_stay}), (n1 + {_move} < n0 + {_stay})::int, (n1 + {_stay} < n0 + {_move})::int from r join c on c.user_id = r.user_id and c.seq = r.seq + 1),
p(user_id, seq, state) as (select r.user_id, r.seq, (n1 < n0)::int from r join c on c.user_id = r.user_id and c.seq = r.seq where r.seq = c.n - 2 union all select r.user_id, r.seq - 1, case when p.state = 1 then b1 else b0 end from p join r on r.user_id = p.user_id and r.seq = p.seq where r.seq > 0),
g as (select user_id, seq, state = 0 as fix from p), {_runs}""", 8)  # fmt: skip
add("aoi_match_joined", ["cohort", "user_id", "event_id", "AOI"], [], over_events(lambda df: preprocess.match_areas(fixations.shape_areas(df, R, (("r", (0.1, 0.1), (0.4, 0.5)), ("c", (0.6, 0.6), 0.2), ("e", (0.3, 0.7), (0.3, 0.2), 30.0))), R, ["cohort"], n_aoi=2, centre=True)))
add("drawings", ["user_id", "channel"], ["total"], over_events(lambda df: maps.images(df, R, ("heatmap_zoomed", "baseline", "aoi_zoomed", "saccade", "gaf_sum"), (16, 16)).select("user_id", "channel", F.aggregate("data", F.lit(0.0), lambda a, b: a + b).alias("total"))), None, 4)
add("images_and_sequences", ["user_id", "channels", "length"], ["last_y"], over_events(lambda df: maps.images_and_sequences(df, R, ("heatmap", "rqa"), ["x", "y"], (8, 8), 60).select("user_id", F.size("channels").alias("channels"), F.col("length").cast("int").alias("length"), F.col("rows")[59][1].alias("last_y"))), f"with {NUMBERED} select user_id, 2::int as channels, least(count(*), 60)::int as length, coalesce(max(case when seq = 59 then y end), 0) as last_y from q group by 1")


# --- matrices between trajectories
for _how in ("hierarchical", "optimal", "mds", "spectral"):
    add(f"order_{_how}", ["place", "p"], [], over_events(lambda df, how=_how: (lambda names: df.sparkSession.createDataFrame(list(enumerate(names)), "place int, p string"))(tables.order_of(*tables.collect_pairs(df, R, lambda a, b: 1 / (1 + kernels.path_distance("euc", a, b)), table=lambda a, b: 1 / (1 + kernels.step_table(a, b))), how))))
add("rv", [], ["rv"], over_events(lambda df: df.sparkSession.createDataFrame([(tables.rv_of(df, R, (kernels.step_factors, kernels.mean_factors)),)], "rv double")), f"""with {NUMBERED}, a as (select a.user_id as p, b.user_id as q, sum(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as v from q a join q b on a.seq = b.seq group by 1, 2), b as (select a.user_id as p, b.user_id as q, avg(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as v from q a join q b on true group by 1, 2),
c as (select p, q, v - avg(v) over (partition by p) - avg(v) over (partition by q) + avg(v) over () as v from a), d as (select p, q, v - avg(v) over (partition by p) - avg(v) over (partition by q) + avg(v) over () as v from b)
select sum(c.v * d.v) / sqrt(sum(c.v * c.v) * sum(d.v * d.v)) as rv from c join d on c.p = d.p and c.q = d.q""", 6)  # fmt: skip


# --- streams
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return steps.drained(stream, f"{shared or tempfile.mkdtemp(prefix='stream-')}/stream-{uuid.uuid4().hex}")


add("stream_windows", ["user_id", "start_s", "n"], ["mean", "std"], lambda s, d: _drained(s, steps.windowed_statistics(_stream(s, d), "user_id", "ts", "value", "1 day", "1 hour")).select("user_id", F.unix_timestamp("start").alias("start_s"), "n", "mean", "std"), "select user_id, (epoch_us(ts) // 86400000000) * 86400 as start_s, count(*) as n, avg(value) as mean, stddev_samp(value) as std from events group by 1, 2", 6)
add("stream_sessions", ["user_id", "n"], ["onset", "offset"], lambda s, d: _drained(s, steps.sessions(_stream(s, d), "user_id", "ts", "6 hours", "1 hour")).select("user_id", "n", (F.unix_micros("onset") / 1000000).alias("onset"), (F.unix_micros("offset") / 1000000).alias("offset")), """with e as (select user_id, epoch_us(ts) as t, case when epoch_us(ts) - lag(epoch_us(ts)) over w < 21600000000 then 0 else 1 end as nw from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(nw) over (partition by user_id order by t rows unbounded preceding) as span from e) select user_id, count(*) as n, min(t) / 1000000.0::double as onset, max(t) / 1000000.0::double as "offset" from g group by user_id, span""", 6)  # fmt: skip
