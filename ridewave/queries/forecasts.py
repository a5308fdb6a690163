"""Closed-form forecasts, blends, sweeps, shift detectors and the switch guard."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ridewave.operators import shifts as H
from ridewave.operators.evaluate import score
from ridewave.operators.profiles import feature_frame, history_before
from ridewave.plans import backtest as B
from ridewave.plans import forecast as M
from ridewave.queries.base import EVENT_ORIGIN, ORDER_ORIGIN, query, rnd
from ridewave.queries.profiles import EO, EVENT_CAL, EVENT_CALENDAR
from ridewave.queries.scoring import AXES_SQL, SLICE_SCORES, rounded_all

c = F.col
SCALE = 0.25
FEAT_SQL = f"""{EVENT_CALENDAR}, past AS (SELECT * FROM ec WHERE date < {EO}),
 sdh AS (SELECT route, dow, hour, avg(boardings) AS v, count(*) AS n FROM past GROUP BY ALL),
 dth AS (SELECT route, day_type, hour, avg(boardings) AS v, count(*) AS n FROM past GROUP BY ALL),
 f0 AS (SELECT ec.*, date_diff('day', {EO}, date)+1 AS lead_day, coalesce(sdh.v,0) AS sdh, coalesce(sdh.n,0) AS sn, coalesce(dth.v,0) AS dth, coalesce(dth.n,0) AS dn
   FROM ec LEFT JOIN sdh USING (route,dow,hour) LEFT JOIN dth USING (route,day_type,hour) WHERE date >= {EO}),
 f1 AS (SELECT *, sdh AS profile, CASE WHEN exception>0 AND dn>0 THEN dth ELSE sdh END AS calendar FROM f0),
 feat AS (SELECT *, CASE WHEN exception=0 AND dn>0 THEN 0.5*calendar+0.5*dth ELSE calendar END AS blend FROM f1)"""


def future(t):
    return t.hourly_kept.where(c("date") >= F.lit(EVENT_ORIGIN)).select("route", "date", "hour")


def features(t):
    return feature_frame(t.hourly_kept, future(t), EVENT_ORIGIN, EVENT_CAL, SCALE)


def closed_form(name: str, ids: str, column: str, expr) -> None:
    @query(name, ids, f"WITH {FEAT_SQL} SELECT route, date, hour, round({column},6) AS prediction FROM feat", "hourly_dense")
    def _(t):
        return features(t).select("route", "date", "hour", rnd(expr()).alias("prediction"))


closed_form("seasonal_profile_forecast", "M2", "profile", M.profile_forecast)
closed_form("calendar_profile_forecast", "M3", "calendar", M.calendar_profile)
closed_form("weekday_blend_forecast", "M4", "blend", M.weekday_blend)


@query("flagship_forecast_score", "A1 J2 A5 M2 M4 A13", f"""WITH {FEAT_SQL}
SELECT route, sum(boardings)::DOUBLE AS actual, round(greatest(0,1-sum(abs(boardings-round_even(profile,0)))/sum(boardings)),6) AS profile_score,
 round(greatest(0,1-sum(abs(boardings-round_even(blend,0)))/sum(boardings)),6) AS blend_score FROM feat GROUP BY ALL""", "hourly_dense")
def _(t):
    rows = features(t).withColumn("profile", M.profile_forecast()).withColumn("blend", M.weekday_blend())
    truth = t.hourly_dense.where(c("date") >= F.lit(EVENT_ORIGIN))
    scored = rows.select("route", "date", "hour", "profile", "blend").join(truth, ["route", "date", "hour"])
    a = score(scored, ["route"], predicted="profile").select("route", "actual", rnd("score").alias("profile_score"))
    return a.join(score(scored, ["route"], predicted="blend").select("route", rnd("score").alias("blend_score")), "route")


def robust_sql(name: str, window: int, hl: int, weight: float) -> str:
    return f"""tr_{name} AS (SELECT route, day_type, least(greatest(coalesce(a/nullif(b,0),1),0.75),1.25) AS ratio FROM (SELECT route, day_type, avg(boardings) FILTER (date >= {EO}-{window}) AS a,
   avg(boardings) FILTER (date < {EO}-{window} AND date >= {EO}-{3 * window}) AS b FROM past GROUP BY ALL) WHERE a IS NOT NULL),
 rb_{name} AS (SELECT f.*, greatest(0, blend*(1+0.3::DOUBLE*pow(2.0::DOUBLE,-(lead_day-1)/{hl}.0::DOUBLE)*(coalesce(t.ratio,1)-1)) + {weight}::DOUBLE*(coalesce(CASE WHEN exception>0 THEN mt.v ELSE 0.5*mw.v+0.5*mt.v END, blend)-blend)) AS p
   FROM feat f LEFT JOIN tr_{name} t USING (route, day_type) LEFT JOIN mw USING (route,dow,hour) LEFT JOIN mt USING (route,day_type,hour))"""


MED_SQL = """mw AS (SELECT route, dow, hour, median(boardings) AS v FROM past GROUP BY ALL), mt AS (SELECT route, day_type, hour, median(boardings) AS v FROM past GROUP BY ALL)"""
ROBUST_SQL = f"{FEAT_SQL}, {MED_SQL}, {robust_sql('short', 3, 42, 0.25)}, {robust_sql('long', 7, 84, 0.5)}"
SHAPE_SQL = f"""{ROBUST_SQL}, sh AS (SELECT route, hour, least(greatest((n.h/nn.t)/nullif(o.h/nullif(oo.t,0),0),0.75),1.25) AS r FROM
  (SELECT route, hour, sum(boardings) AS h FROM past WHERE date >= {EO}-7 GROUP BY ALL) n JOIN (SELECT route, sum(boardings) AS t FROM past WHERE date >= {EO}-7 GROUP BY ALL) nn USING (route)
  JOIN (SELECT route, hour, sum(boardings) AS h FROM past WHERE date < {EO}-7 AND date >= {EO}-21 GROUP BY ALL) o USING (route,hour) JOIN (SELECT route, sum(boardings) AS t FROM past WHERE date < {EO}-7 AND date >= {EO}-21 GROUP BY ALL) oo USING (route)),
 sf AS (SELECT b.*, p*(1+0.2::DOUBLE*(coalesce(r,1)-1)) AS s FROM rb_long b LEFT JOIN sh USING (route,hour)),
 shaped AS (SELECT *, CASE WHEN sum(s) OVER w > 0 THEN s*sum(p) OVER w/sum(s) OVER w ELSE p END AS prediction FROM sf WINDOW w AS (PARTITION BY route, date))"""


def robust(t, variant):
    return M.robust_profile(history_before(t.hourly_dense, EVENT_ORIGIN), features(t), EVENT_ORIGIN, variant, EVENT_CAL, SCALE)


def shaped(t):
    past = history_before(t.hourly_dense, EVENT_ORIGIN)
    return M.hour_shape(past, robust(t, "long"), EVENT_ORIGIN, ["route"], EVENT_CAL, SCALE)


@query("robust_profile_long", "M5", f"WITH {ROBUST_SQL} SELECT route, date, hour, round(p,6) AS prediction FROM rb_long", "hourly_dense")
def _(t):
    return robust(t, "long").select("route", "date", "hour", rnd("prediction").alias("prediction"))


@query("robust_profile_blend", "M5", f"WITH {ROBUST_SQL} SELECT a.route, a.date, a.hour, round(0.5*a.p+0.5*b.p,6) AS prediction FROM rb_short a JOIN rb_long b USING (route,date,hour)", "hourly_dense")
def _(t):
    return robust(t, "blend").select("route", "date", "hour", rnd("prediction").alias("prediction"))


@query("hour_shape_forecast", "M6", f"WITH {SHAPE_SQL} SELECT route, date, hour, round(prediction,6) AS prediction FROM shaped", "hourly_dense")
def _(t):
    return shaped(t).select("route", "date", "hour", rnd("prediction").alias("prediction"))


@query("convex_blend", "M13", f"WITH {SHAPE_SQL} SELECT route, date, hour, round(0.7::DOUBLE*prediction+0.1::DOUBLE*profile+0.2::DOUBLE*blend,6) AS prediction FROM shaped", "hourly_dense")
def _(t):
    f = features(t)
    frames = {"base": shaped(t), "profile": f.withColumn("prediction", M.profile_forecast()),
              "weekday": f.withColumn("prediction", M.weekday_blend())}
    out = M.blend(frames, {"profile": 0.1, "weekday": 0.2}, "base")
    return out.select("route", "date", "hour", rnd("prediction").alias("prediction"))


def calibration(t):
    """Three simple forecasts of the same cells: base, a level branch and a lag branch."""
    rows = shaped(t).withColumn("level", M.weekday_blend()).withColumnRenamed("prediction", "base")
    lag = t.hourly_dense.select("route", F.date_add("date", 7).alias("date"), "hour", c("boardings").cast("double").alias("lag"))
    truth = t.hourly_dense.select("route", "date", "hour", "boardings")
    return rows.select("route", "date", "hour", "base", "level").join(lag, ["route", "date", "hour"]).join(truth, ["route", "date", "hour"])


CALIB_SQL = f"""{SHAPE_SQL}, cal AS (SELECT s.route, s.date, s.hour, s.boardings, s.prediction AS base, s.blend AS level, h.boardings::DOUBLE AS lag FROM shaped s JOIN hourly_dense h ON h.route=s.route AND h.date=s.date-7 AND h.hour=s.hour)"""


@query("blend_weight_search", "M14", f"""WITH {CALIB_SQL}, g AS (SELECT a.w AS level, b.w AS lag FROM (SELECT unnest([0.0,0.05,0.1,0.15])::DOUBLE AS w) a, (SELECT unnest([0.0,0.05,0.1,0.15])::DOUBLE AS w) b WHERE a.w+b.w <= 0.3+1e-12),
 r AS (SELECT g.level, g.lag, CAST((CASE WHEN g.level>0 THEN 1 ELSE 0 END)+(CASE WHEN g.lag>0 THEN 1 ELSE 0 END) AS INT) AS used, round(g.level+g.lag,6) AS mass,
   round(1-sum(abs(boardings-round_even(greatest(base*(1-g.level-g.lag)+cal.level*g.level+cal.lag*g.lag,0),0)))/sum(boardings),12) AS score FROM cal, g GROUP BY g.level, g.lag)
SELECT level, lag, used, mass, round(score,6) AS score FROM r ORDER BY r.score DESC, used, mass, level, lag LIMIT 1""", "hourly_dense")
def _(t):
    return rounded_all(M.choose_weights(calibration(t), ["level", "lag"]), skip=("level", "lag", "mass"))


@query("blend_acceptance", "M15", f"""WITH {CALIB_SQL}, b AS (SELECT *, CASE WHEN date < DATE '2024-01-26' THEN DATE '2024-01-22' ELSE DATE '2024-01-26' END AS origin, round_even(base,0) AS p0, round_even(0.7::DOUBLE*base+0.3::DOUBLE*lag,0) AS p1 FROM cal),
 ax AS (SELECT *, 'overall' AS axis, '' AS member FROM b UNION ALL SELECT *, 'route', route FROM b UNION ALL SELECT *, 'hours', lpad(CAST(hour//6*6 AS VARCHAR),2,'0') FROM b),
 g AS (SELECT origin, axis, member, greatest(0,1-sum(abs(boardings-p1))/sum(boardings))-greatest(0,1-sum(abs(boardings-p0))/sum(boardings)) AS ch FROM ax GROUP BY ALL HAVING sum(boardings)>0)
SELECT origin, round(max(ch) FILTER (axis='overall'),6) AS gain, round(min(ch) FILTER (axis<>'overall'),6) AS worst_segment, max(ch) FILTER (axis='overall') >= 0.0005 AND min(ch) FILTER (axis<>'overall') >= -0.01 AS accepted FROM g GROUP BY ALL""", "hourly_dense")
def _(t):
    rows = calibration(t).withColumn("origin", F.when(c("date") < F.lit(date(2024, 1, 26)), F.lit(date(2024, 1, 22))).otherwise(F.lit(date(2024, 1, 26))))
    return rounded_all(M.accept_weights(rows.withColumn("before", c("base")).withColumn("after", c("base") * 0.7 + c("lag") * 0.3), 0.0005, 0.01))


CONFIGS = [M.Config("mean_w14", "mean", 14), M.Config("mean_all_type", "mean", 0, day_type_weight=0.5),
           M.Config("median_w21", "median", 21, day_type_weight=1.0), M.Config("exp_h7", "exp", half_life=7, correction=0.5),
           M.Config("trim10_type", "trim10", day_type_weight=1.0), M.Config("q60_type", "q60", day_type_weight=1.0)]
SWEEP_ORIGINS = [date(2024, 1, 16), date(2024, 1, 23)]
SWEEP_SQL = f"""{EVENT_CALENDAR}, o AS (SELECT unnest([DATE '2024-01-16', DATE '2024-01-23']) AS origin), h AS (SELECT o.origin, ec.*, date_diff('day', date, origin) AS age FROM ec, o WHERE date < origin),
 tg AS (SELECT o.origin, ec.* FROM ec, o WHERE date >= origin AND date < origin + 7),
 d AS (SELECT origin, route, dow, hour, avg(boardings) FILTER (age<=14) AS m14, avg(boardings) AS mall, sum(pow(2.0::DOUBLE,-age/7.0::DOUBLE)*boardings)/sum(pow(2.0::DOUBLE,-age/7.0::DOUBLE)) AS e7 FROM h GROUP BY ALL),
 ty AS (SELECT origin, route, day_type, hour, avg(boardings) FILTER (age<=14) AS m14, avg(boardings) AS mall, median(boardings) FILTER (age<=21) AS med21, quantile_cont(boardings,0.6) AS q60, sum(pow(2.0::DOUBLE,-age/7.0::DOUBLE)*boardings)/sum(pow(2.0::DOUBLE,-age/7.0::DOUBLE)) AS e7 FROM h GROUP BY ALL),
 tm AS (SELECT origin, route, day_type, hour, avg(boardings) AS trim10 FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY origin, route, day_type, hour) AS n FROM h WINDOW w AS (PARTITION BY origin, route, day_type, hour ORDER BY boardings, date)) WHERE r > floor(n*0.1) AND r <= n-floor(n*0.1) GROUP BY ALL),
 lv AS (SELECT origin, route, avg(boardings) FILTER (age<=14) AS a, avg(boardings) FILTER (age>14 AND age<=42) AS b FROM h GROUP BY ALL),
 j AS (SELECT tg.*, d.m14 AS d14, d.mall AS dall, d.e7 AS de7, ty.m14 AS t14, ty.mall AS tall, ty.med21, ty.q60, ty.e7 AS te7, tm.trim10, 1+0.5*(least(greatest(CASE WHEN lv.b>0 THEN lv.a/lv.b ELSE 1 END,0.8),1.2)-1) AS f
   FROM tg LEFT JOIN d USING (origin,route,dow,hour) LEFT JOIN ty USING (origin,route,day_type,hour) LEFT JOIN tm USING (origin,route,day_type,hour) LEFT JOIN lv USING (origin,route)),
 sw AS (SELECT 'mean_w14' AS model, origin, route, date, hour, boardings, CASE WHEN exception>0 THEN t14 ELSE d14 END AS prediction FROM j
  UNION ALL SELECT 'mean_all_type', origin, route, date, hour, boardings, CASE WHEN exception>0 THEN tall ELSE 0.5*dall+0.5*tall END FROM j
  UNION ALL SELECT 'median_w21', origin, route, date, hour, boardings, med21 FROM j UNION ALL SELECT 'exp_h7', origin, route, date, hour, boardings, (CASE WHEN exception>0 THEN te7 ELSE de7 END)*f FROM j
  UNION ALL SELECT 'trim10_type', origin, route, date, hour, boardings, trim10 FROM j UNION ALL SELECT 'q60_type', origin, route, date, hour, boardings, q60 FROM j)"""


def swept(t):
    return M.sweep(t.hourly_dense, SWEEP_ORIGINS, CONFIGS, 7, EVENT_CAL)


@query("statistical_sweep", "M16 A10", f"WITH {SWEEP_SQL} SELECT model, origin, route, date, hour, boardings, round(prediction,6) AS prediction FROM sw", "hourly_dense")
def _(t):
    return rounded_all(swept(t))


@query("sweep_ranking", "M16 A70", f"""WITH {SWEEP_SQL}, s AS (SELECT model, origin, greatest(0,1-sum(abs(boardings-round_even(prediction,0)))/sum(boardings)) AS score FROM sw GROUP BY ALL)
SELECT model, round(min(score),6) AS worst, round(avg(score),6) AS mean, round(max(score),6) AS best, CAST(row_number() OVER (ORDER BY min(score) DESC, avg(score) DESC, model) AS INT) AS rank FROM s GROUP BY model""", "hourly_dense")
def _(t):
    return rounded_all(M.sweep_ranking(swept(t)))


@query("candidate_comparison", "M18", f"""WITH {SWEEP_SQL}, pred AS (SELECT model, origin, route, date, hour, boardings, prediction, date_diff('day', origin, date)+1 AS lead_day FROM sw), {AXES_SQL}
SELECT model, origin, {SLICE_SCORES[7:]}""", "hourly_dense")
def _(t):
    return rounded_all(B.compare_models(swept(t).withColumn("lead_day", F.datediff("date", "origin") + 1)))


class MeanModel:
    """Mean of the last days per route and hour: the smallest fold model."""

    version = "1"

    def __init__(self, days: int):
        self.name, self.days = f"mean_{days}", days

    def predict(self, history, future, origin):
        recent = history.where(c("date") >= F.date_sub(F.lit(origin), self.days))
        level = recent.groupBy("route", "hour").agg(F.avg("boardings").alias("prediction"))
        return future.join(level, ["route", "hour"])


@query("fold_model_protocol", "E1 M26", """WITH o AS (SELECT unnest([DATE '2024-01-16', DATE '2024-01-23']) AS origin), m AS (SELECT unnest([7,14]) AS w)
SELECT 'mean_' || w AS model, o.origin, t.route, t.date, t.hour, t.boardings, round((SELECT avg(h.boardings) FROM hourly_dense h WHERE h.route=t.route AND h.hour=t.hour AND h.date < o.origin AND h.date >= o.origin - w),6) AS prediction, CAST(date_diff('day', o.origin, t.date)+1 AS INT) AS lead_day
FROM hourly_dense t, o, m WHERE t.date >= o.origin AND t.date < o.origin + 7""", "hourly_dense")
def _(t):
    return rounded_all(B.run_models(t.hourly_dense, [MeanModel(7), MeanModel(14)], SWEEP_ORIGINS, 7))


LEVEL = H.LevelPolicy(recent_days=14, reference_days=14, ratio=1.001, min_reference_daily=1.0, min_reference_days=10)
LEVEL_ORIGINS = [date(2024, 1, 29), date(2024, 1, 30), date(2024, 1, 31)]


def level_sql(table: str, origins: str, ref: int, ratio: float, minimum: float, min_days: int, off: str = "false") -> str:
    return f"""o AS (SELECT unnest([{origins}]) AS origin), dd AS (SELECT origin, route, date, sum(boardings)::DOUBLE AS total, count(DISTINCT hour) AS hrs, date_diff('day', date, origin) AS age, isodow(date) AS wd FROM {table}, o WHERE date < origin AND date >= origin - {14 + ref} GROUP BY ALL),
 ok AS (SELECT origin, route FROM dd GROUP BY ALL HAVING count(*)={14 + ref} AND min(hrs)=24), nd AS (SELECT * FROM dd SEMI JOIN ok USING (origin, route) WHERE NOT ({off})),
 ex AS (SELECT origin, route, wd, avg(total) AS expected FROM nd WHERE age>14 GROUP BY ALL), sp AS (SELECT origin, route, count(*) AS nref FROM nd WHERE age>14 GROUP BY ALL),
 lg AS (SELECT origin, route, nref, count(*) FILTER (expected IS NULL) AS um, count(*) FILTER (age>7) AS n1, count(*) FILTER (age<=7) AS n2, avg(expected) AS reference, avg(total) AS recent,
   sum(total) FILTER (age>7)/sum(expected) FILTER (age>7) AS r1, sum(total) FILTER (age<=7)/sum(expected) FILTER (age<=7) AS r2, sum(total)/sum(expected) AS value FROM nd LEFT JOIN ex USING (origin,route,wd) JOIN sp USING (origin,route) WHERE age<=14 GROUP BY ALL),
 signals AS (SELECT origin, route, 'demand_level' AS kind, CASE WHEN least(r1,r2,value) >= {ratio} THEN 'up' ELSE 'down' END AS direction, value, recent, reference FROM lg
   WHERE nref>={min_days} AND um=0 AND n1>=5 AND n2>=5 AND reference>={minimum} AND (least(r1,r2,value) >= {ratio} OR greatest(r1,r2,value) <= 1/{ratio}::DOUBLE))"""


SIGNAL_SQL = level_sql("hourly_dense", "DATE '2024-01-29', DATE '2024-01-30', DATE '2024-01-31'", 14, 1.001, 1.0, 10, "date IN (DATE '2024-01-08')")


@query("level_shifts", "W21 E3", f"WITH {SIGNAL_SQL} SELECT origin, route, kind, direction, round(value,6) AS value, round(recent,6) AS recent, round(reference,6) AS reference FROM signals", "hourly_dense")
def _(t):
    return rounded_all(H.level_shifts(t.hourly_dense, LEVEL_ORIGINS, LEVEL, [date(2024, 1, 8)]))


@query("hour_shape_shifts", "W22", """WITH o AS (SELECT unnest([DATE '2024-01-29', DATE '2024-01-30', DATE '2024-01-31']) AS origin), r AS (SELECT origin, h.*, date_diff('day', date, origin) AS age FROM hourly_dense h, o WHERE date < origin AND date >= origin - 28),
 p AS (SELECT *, CASE WHEN age>14 THEN 'ref' WHEN age>7 THEN 'a' ELSE 'b' END AS part FROM r),
 hh AS (SELECT origin, route, hour, sum(boardings) FILTER (part='ref') AS ref, sum(boardings) FILTER (part='a') AS a, sum(boardings) FILTER (part='b') AS b FROM p GROUP BY ALL),
 sh AS (SELECT *, ref/sum(ref) OVER w AS sr, a/sum(a) OVER w AS sa, b/sum(b) OVER w AS sb, (a+b)/(sum(a) OVER w+sum(b) OVER w) AS sc, sum(a) OVER w AS ta, sum(b) OVER w AS tb, sum(ref) OVER w AS tr FROM hh WINDOW w AS (PARTITION BY origin, route)),
 g AS (SELECT origin, route, max(ta) AS ta, max(tb) AS tb, max(tr) AS tr, sum(abs(sa-sr))/2 AS tva, sum(abs(sb-sr))/2 AS tvb, sum(abs(sc-sr))/2 AS dist, sum((sa-sr)*(sb-sr))/(sqrt(sum((sa-sr)*(sa-sr)))*sqrt(sum((sb-sr)*(sb-sr)))) AS al FROM sh GROUP BY ALL)
SELECT origin, route, 'hour_shape' AS kind, 'changed' AS direction, round(dist,6) AS value, round((ta+tb)/14,6) AS recent, round(tr/14,6) AS reference FROM g WHERE least(tva,tvb,dist)>=0.02 AND al>=0.05""", "hourly_dense")
def _(t):
    policy = H.ShapePolicy(recent_days=14, reference_days=14, min_reference_days=10, min_half_days=5, min_reference_daily=1.0,
                           total_variation=0.02, min_alignment=0.05)
    return rounded_all(H.shape_shifts(t.hourly_dense, LEVEL_ORIGINS, policy))


@query("limit_flags", "A72", f"""WITH {SIGNAL_SQL}, months AS (SELECT unnest([1,2,3]) AS m)
SELECT 'unseen_target_month' AS flag, CAST(m AS VARCHAR) AS entity, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS bound FROM months WHERE m NOT IN (SELECT month(date) FROM hourly_dense)
UNION ALL SELECT 'no_observed_route_demand', route, NULL, NULL FROM hourly_dense GROUP BY route HAVING sum(boardings)=0
UNION ALL SELECT 'trend_input_clipped', route, round(value,6), CASE WHEN direction='up' THEN 1.01::DOUBLE ELSE 0.99::DOUBLE END FROM signals WHERE value>1.01 OR value<0.99
UNION ALL SELECT 'ml_bound_below_observed_change', route, round(abs(value-1),6), 0.015::DOUBLE FROM signals WHERE abs(value-1)>0.015""", "hourly_dense")
def _(t):
    signals = H.level_shifts(t.hourly_dense, LEVEL_ORIGINS, LEVEL, [date(2024, 1, 8)])
    return rounded_all(H.assess_limits(t.hourly_dense, date(2024, 1, 31), 61, signals, (0.99, 1.01), 0.015))


GUARD_ORIGINS = [date(2001, 6, 1), date(2001, 4, 1), date(2001, 1, 30), date(2000, 11, 30), date(2000, 9, 30)]
GUARD_LIST = ", ".join(f"DATE '{o}'" for o in GUARD_ORIGINS)
GUARD_SQL = f"""{level_sql('order_dense', GUARD_LIST, 28, 1.0001, 1.0, 20)}, ms AS (SELECT unnest([28,112]) AS w), oo AS (SELECT origin FROM o WHERE origin < DATE '2001-06-01'),
 lev AS (SELECT origin, w, route, hour, avg(boardings) AS p FROM order_dense, oo, ms WHERE date < origin AND date >= origin - w GROUP BY ALL),
 cell AS (SELECT 'mean_' || w AS model, origin, route, boardings, round_even(p*1.9::DOUBLE,0) AS p FROM order_dense t JOIN oo ON t.date >= origin AND t.date < origin+61 JOIN lev USING (origin, route, hour)),
 sc AS (SELECT model, origin, route, greatest(0,1-sum(abs(boardings-p))/sum(boardings)) AS score FROM cell GROUP BY model, origin, route UNION ALL SELECT model, origin, NULL, greatest(0,1-sum(abs(boardings-p))/sum(boardings)) FROM cell GROUP BY model, origin),
 now AS (SELECT route, direction FROM signals WHERE origin=DATE '2001-06-01'), pr AS (SELECT DISTINCT s.origin, s.route FROM signals s JOIN now USING (route, direction) WHERE s.origin < DATE '2001-06-01'),
 ga AS (SELECT a.origin, a.score-b.score AS gain, EXISTS (SELECT 1 FROM pr WHERE pr.origin=a.origin) AS mt FROM sc a JOIN sc b ON a.origin=b.origin AND b.route IS NULL AND b.model='mean_28' WHERE a.route IS NULL AND a.model='mean_112'),
 en AS (SELECT count(*) FILTER (a.score IS NULL OR b.score IS NULL) AS inc, min(a.score-b.score) AS we FROM sc a JOIN pr ON pr.origin=a.origin AND pr.route=a.route LEFT JOIN sc b ON b.origin=a.origin AND b.route=a.route AND b.model='mean_28' WHERE a.model='mean_112')"""


@query("switch_guard", "M27", f"""WITH {GUARD_SQL}, r AS (SELECT 'mean_112' AS model, min(gain) AS wg, min(gain) FILTER (mt) AS wm, count(*) FILTER (mt) AS co FROM ga), q AS (SELECT *, coalesce(co>=2 AND wg>=0 AND wm>=0.002 AND inc=0 AND we>0, false) AS el, (SELECT count(*)>0 FROM now) AS hs FROM r, en)
SELECT model, round(wg,6) AS worst_gain, round(wm,6) AS worst_matching_gain, co AS comparable_origins, round(we,6) AS worst_entity_gain, el AS eligible, CASE WHEN NOT hs THEN 'no_shift' WHEN el THEN 'switch_supported' WHEN co>=2 THEN 'candidate_rejected' ELSE 'insufficient_evidence' END AS status FROM q""", "order_dense")
def _(t):
    signals = H.level_shifts(t.order_dense, GUARD_ORIGINS, H.LevelPolicy(ratio=1.0001, min_reference_daily=1.0))
    runs = M.window_means(t.order_dense, GUARD_ORIGINS[1:], [28, 112], 61, 1.9)
    per = score(runs, ["model", "origin", "route"]).select("model", "origin", "route", "score")
    overall = score(runs, ["model", "origin"]).select("model", "origin", F.lit(None).cast("string").alias("route"), "score")
    out = M.review_switch(per.unionByName(overall), signals, ORDER_ORIGIN, "mean_28")
    return rounded_all(out.select("model", "worst_gain", "worst_matching_gain", "comparable_origins", "worst_entity_gain", "eligible", "status"))
