"""Scores, slices, gates and backtests."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ridewave.operators import evaluate as V
from ridewave.operators.counts import forecast_buckets
from ridewave.plans import backtest as B
from ridewave.queries.base import query, rnd

c = F.col


def rounded_all(df, skip=()):
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*[rnd(x).alias(x) if kinds[x] == "double" and x not in skip else c(x) for x in df.columns])


@query("fold_error_metrics", "A12", """SELECT route, fold, count(*) AS scored, round(sum(actual),6) AS actual_total, round(sum(abs(actual-predicted)),6) AS error_total,
 round(sum(abs(actual-predicted))/count(*),6) AS mae, round(sum(abs(actual-predicted))/nullif(sum(actual),0),6) AS wape FROM scored GROUP BY ALL""", "scored")
def _(t):
    return rounded_all(V.error_metrics(t.scored, ["route", "fold"]))


@query("pooled_error_metrics", "A12", """SELECT route, count(*) AS scored, round(sum(actual),6) AS actual_total, round(sum(abs(actual-predicted)),6) AS error_total,
 round(sum(abs(actual-predicted))/count(*),6) AS mae, round(sum(abs(actual-predicted))/nullif(sum(actual),0),6) AS wape FROM scored GROUP BY ALL""", "scored")
def _(t):
    return rounded_all(V.pool(V.error_metrics(t.scored, ["route", "fold"]), ["route"]))


# A half-integer forecast, so rounding half to even matters.
PRED_SQL = """pred AS (SELECT route, date, hour, boardings, boardings * 0.5::DOUBLE + (hour % 3) AS prediction, CAST(date_diff('day', DATE '2024-01-01', date)*2+1 AS INT) AS lead_day FROM hourly_dense)"""


def pred(t):
    return t.hourly_dense.select("route", "date", "hour", "boardings", (c("boardings") * 0.5 + c("hour") % 3).alias("prediction"),
                                 (F.datediff("date", F.lit(date(2024, 1, 1))) * 2 + 1).alias("lead_day"))


@query("score_by_route", "A13", f"""WITH {PRED_SQL} SELECT route, sum(boardings)::DOUBLE AS actual, sum(abs(boardings-round_even(greatest(prediction,0),0)))::DOUBLE AS absolute_error,
 round(greatest(0, 1-sum(abs(boardings-round_even(greatest(prediction,0),0)))/sum(boardings)),6) AS score FROM pred GROUP BY ALL""", "hourly_dense")
def _(t):
    return rounded_all(V.score(pred(t), ["route"]))


SLICE_SCORES = """SELECT dimension, member, count(*) AS rows, sum(boardings)::DOUBLE AS actual, sum(abs(boardings-p))::DOUBLE AS absolute_error,
 CASE WHEN sum(boardings)>0 THEN round(greatest(0, 1-sum(abs(boardings-p))/sum(boardings)),6) END AS score FROM axes GROUP BY ALL"""
AXES_SQL = """p AS (SELECT *, round_even(greatest(prediction,0),0) AS p FROM pred),
 axes AS (SELECT *, 'overall' AS dimension, '' AS member FROM p UNION ALL SELECT *, 'route', route FROM p UNION ALL SELECT *, 'hours', lpad(CAST(hour//6*6 AS VARCHAR),2,'0') FROM p
  UNION ALL SELECT *, 'lead', 'day1' FROM p WHERE lead_day=1 UNION ALL SELECT *, 'lead', CASE WHEN lead_day<=31 THEN 'days1_31' ELSE 'days32_61' END FROM p
  UNION ALL SELECT *, 'peak', '' FROM p WHERE hour IN (7,8,9,16,17,18,19))"""


@query("score_slices", "A13", f"WITH {PRED_SQL}, {AXES_SQL} {SLICE_SCORES}", "hourly_dense")
def _(t):
    return rounded_all(V.score_slices(pred(t)))


@query("array_case_evaluation", "A14", """WITH s AS (SELECT *, CASE day(date) % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'year' END AS hz, coalesce(baseline,0) AS bl FROM scored),
 g AS (SELECT coalesce(hz,'overall') AS slice, count(*) AS observations, sum(abs(actual-predicted))/count(*) AS mae, sum(abs(actual-predicted))/sum(actual) AS wape, sum(abs(actual-bl))/sum(actual) AS baseline_wape,
  count(*) FILTER (actual BETWEEN predicted-1 AND predicted+1)/count(*) AS interval_coverage FROM s GROUP BY ROLLUP(hz))
SELECT slice, observations, round(mae,6) AS mae, round(wape,6) AS wape, round(baseline_wape,6) AS baseline_wape, round(interval_coverage,6) AS interval_coverage,
 (SELECT bool_and(wape <= baseline_wape AND interval_coverage >= 0.8) FROM g) AS passed FROM g""", "scored")
def _(t):
    hz = F.when(F.dayofmonth("date") % 3 == 0, "day").when(F.dayofmonth("date") % 3 == 1, "month").otherwise("year")
    order = F.array_sort(F.collect_list(F.struct("hour", "direction", "stop", "actual", "predicted", F.coalesce("baseline", F.lit(0.0)).alias("b"))))
    cases = t.scored.groupBy(hz.alias("horizon"), "route", "date").agg(order.alias("x")).select(
        "horizon", F.transform("x", lambda v: v["actual"]).alias("actual"), F.transform("x", lambda v: v["predicted"]).alias("prediction"),
        F.transform("x", lambda v: v["b"]).alias("baseline_prediction"), F.transform("x", lambda v: v["predicted"] - 1).alias("lower_bound"),
        F.transform("x", lambda v: v["predicted"] + 1).alias("upper_bound"))
    return rounded_all(V.evaluate_cases(cases))


SLICE_SQL = """pts AS (SELECT *, CASE WHEN hour IN (7,8,9) THEN 'morning_peak' WHEN hour IN (17,18,19) THEN 'evening_peak' ELSE 'offpeak' END AS daypart,
  CASE WHEN lower IS NOT NULL THEN upper-lower + 2/(1-level)*(greatest(lower-actual,0)+greatest(actual-upper,0)) END AS wk FROM scored),
 ax AS (SELECT *, 'overall' AS axis, 'all' AS value FROM pts UNION ALL SELECT *, 'horizon', horizon FROM pts UNION ALL SELECT *, 'fold', fold FROM pts UNION ALL SELECT *, 'event', event FROM pts WHERE event IS NOT NULL
  UNION ALL SELECT *, 'daypart', daypart FROM pts UNION ALL SELECT *, 'route', route FROM pts UNION ALL SELECT *, 'direction', route||'|'||direction FROM pts UNION ALL SELECT *, 'stop', CAST(stop AS VARCHAR) FROM pts
  UNION ALL SELECT *, 'entity', route||'|'||direction||'|'||stop FROM pts UNION ALL SELECT *, 'route_daypart', route||'|'||daypart FROM pts UNION ALL SELECT *, 'entity_daypart', route||'|'||direction||'|'||stop||'|'||daypart FROM pts),
 m AS (SELECT axis, value, count(*) AS samples, count(DISTINCT fold) AS folds, round(sum(actual),6) AS actual_total, round(sum(abs(actual-predicted)),6) AS error_total, sum(abs(actual-predicted))/count(*) AS mae,
  sum(abs(actual-predicted))/nullif(sum(actual),0) AS wape, CASE WHEN count(baseline)=count(*) THEN sum(abs(actual-baseline))/nullif(sum(actual),0) END AS baseline_wape,
  CASE WHEN count(lower)=count(*) THEN min(level) END AS interval_level, CASE WHEN count(lower)=count(*) THEN count(*) FILTER (actual BETWEEN lower AND upper)/count(*) END AS interval_coverage,
  CASE WHEN count(lower)=count(*) THEN sum(upper-lower)/count(*) END AS mean_width, CASE WHEN count(lower)=count(*) THEN sum(wk)/count(*) END AS mean_interval_score,
  CASE WHEN count(capacity) FILTER (target='onboard_load')=count(*) THEN count(*) FILTER (actual>capacity) END AS actual_overloaded,
  CASE WHEN count(capacity) FILTER (target='onboard_load')=count(*) THEN count(*) FILTER (predicted>capacity) END AS predicted_overloaded FROM ax GROUP BY ALL),
 st AS (SELECT *, CASE WHEN folds<2 AND axis<>'fold' THEN 'insufficient_history' WHEN samples<12 THEN 'insufficient_samples' WHEN wape IS NULL THEN 'insufficient_signal' ELSE 'evaluated' END AS status FROM m)"""


@query("slice_metrics", "A15 A16 A17 A18", f"""WITH {SLICE_SQL} SELECT axis, value, samples, folds, actual_total, error_total, round(mae,6) AS mae, round(wape,6) AS wape, round(baseline_wape,6) AS baseline_wape,
 interval_level, round(interval_coverage,6) AS interval_coverage, round(mean_width,6) AS mean_width, round(mean_interval_score,6) AS mean_interval_score, actual_overloaded, predicted_overloaded FROM m""", "scored")
def _(t):
    return rounded_all(V.slice_metrics(t.scored))


@query("interval_quality", "A16 F13", """SELECT stop, CASE WHEN count(lower)=0 THEN 'no point carries an interval' WHEN count(lower)<count(*) THEN 'only some points carry an interval' END AS reason,
 CASE WHEN count(lower)=count(*) THEN round(count(*) FILTER (actual BETWEEN lower AND upper)/count(*),6) END AS coverage, CASE WHEN count(lower)=count(*) THEN round(avg(upper-lower),6) END AS mean_width,
 CASE WHEN count(lower)=count(*) THEN round(avg(upper-lower+10.0*(greatest(lower-actual,0)+greatest(actual-upper,0))),6) END AS mean_score FROM scored WHERE route<>'view' OR stop<5 GROUP BY ALL""", "scored")
def _(t):
    return rounded_all(V.interval_quality(t.scored.where("route <> 'view' OR stop < 5"), ["stop"]))


@query("overload_quality", "A17", """SELECT route, CASE WHEN count(*) FILTER (target<>'onboard_load')>0 THEN 'target is not an occupancy' WHEN count(capacity)<count(*) THEN 'capacity is unknown' END AS reason,
 CASE WHEN route='click' THEN count(*) FILTER (actual>capacity) END AS actual_overloaded, CASE WHEN route='click' THEN count(*) FILTER (predicted>capacity) END AS predicted_overloaded, count(*) AS samples FROM scored GROUP BY route""", "scored")
def _(t):
    return V.overload_quality(t.scored, ["route"])


@query("baseline_totals", "A18", """SELECT stop, CASE WHEN count(baseline)=0 THEN 'no point carries a baseline' WHEN count(baseline)<count(*) THEN 'only some points carry a baseline' END AS reason,
 CASE WHEN count(baseline)=count(*) THEN round(sum(abs(actual-baseline))/sum(actual),6) END AS baseline_wape FROM scored GROUP BY ALL""", "scored")
def _(t):
    return rounded_all(V.baseline_totals(t.scored, ["stop"]))


@query("slice_status", "A19", f"WITH {SLICE_SQL} SELECT axis, value, status FROM st", "scored")
def _(t):
    return V.slice_status(V.slice_metrics(t.scored)).select("axis", "value", "status")


FAIL_SQL = SLICE_SQL + """, fails AS (SELECT axis, value, 'interval_level' AS metric, interval_level AS observed, 0.8::DOUBLE AS "limit" FROM st WHERE status='evaluated' AND interval_level < 0.8
 UNION ALL SELECT axis, value, 'interval_coverage', interval_coverage, interval_level-0.1::DOUBLE FROM st WHERE status='evaluated' AND interval_level>=0.8 AND interval_coverage < interval_level-0.1::DOUBLE
 UNION ALL SELECT axis, value, 'mean_interval_score', mean_interval_score, greatest(actual_total/samples*2,8) FROM st WHERE status='evaluated' AND mean_interval_score > greatest(actual_total/samples*2,8)
 UNION ALL SELECT axis, value, 'wape', wape, 0.4::DOUBLE FROM st WHERE status='evaluated' AND wape>0.4
 UNION ALL SELECT axis, value, 'wape_vs_baseline', wape, baseline_wape FROM st WHERE status='evaluated' AND wape>baseline_wape)"""


@query("gate_failures", "A19", f'WITH {FAIL_SQL} SELECT axis, value, metric, round(observed,6) AS observed, round("limit",6) AS "limit" FROM fails', "scored")
def _(t):
    return rounded_all(V.gate_failures(V.slice_metrics(t.scored)))


@query("gate_verdict", "A19", f"""WITH {FAIL_SQL}, req AS (SELECT DISTINCT 'route' AS axis, route AS value FROM scored UNION ALL SELECT 'overall','all' UNION ALL SELECT 'stop','99')
SELECT (SELECT count(*) FROM fails) AS failures, (SELECT count(*) FROM req LEFT JOIN st USING (axis,value) WHERE coalesce(status,'missing')<>'evaluated') AS unproven,
 count(*) AS ungated, count(*) FILTER (status='insufficient_samples') AS below_samples, count(*) FILTER (status='insufficient_history') AS below_folds, count(*) FILTER (status='insufficient_signal') AS without_signal,
 round(max(wape),6) AS worst_wape, false AS passed FROM st WHERE status<>'evaluated'""", "scored")
def _(t):
    routes = t.scored.select(F.lit("route").alias("axis"), c("route").alias("value")).distinct()
    fixed = t.spark.range(1).select(F.explode(F.array(F.struct(F.lit("overall").alias("axis"), F.lit("all").alias("value")),
                                                      F.struct(F.lit("stop").alias("axis"), F.lit("99").alias("value")))).alias("r")).select("r.*")
    return rounded_all(V.gate(V.slice_metrics(t.scored), routes.unionByName(fixed)))


@query("model_ranking", "A70", """WITH s AS (SELECT 'm' || (stop % 4) AS model, fold AS origin, greatest(0,1-sum(abs(actual-predicted))/sum(actual)) AS score FROM scored GROUP BY ALL)
SELECT model, round(worst,6) AS worst, round(mean,6) AS mean, round(best,6) AS best, CAST(row_number() OVER (ORDER BY worst DESC, mean DESC, model) AS INT) AS rank FROM (SELECT model, min(score) AS worst, avg(score) AS mean, max(score) AS best FROM s GROUP BY ALL)""", "scored")
def _(t):
    rows = t.scored.withColumn("model", F.concat(F.lit("m"), (c("stop") % 4).cast("string")))
    return rounded_all(V.rank_models(V.score(rows, ["model", "fold"], "actual", "predicted")))


@query("blend_ranking", "A71", """WITH w AS (SELECT unnest([0.0,0.25,0.5,0.75])::DOUBLE AS weight) SELECT weight, round(1-sum(abs(actual-round_even(greatest((1-weight)*predicted+weight*coalesce(baseline,predicted),0),0)))/sum(actual),6) AS score FROM scored, w GROUP BY ALL""", "scored")
def _(t):
    rows = t.scored.withColumn("other", F.coalesce("baseline", "predicted"))
    return rounded_all(V.rank_blends(rows, [0.0, 0.25, 0.5, 0.75], "predicted", "other", "actual"))


@query("canonical_points", "T7", "SELECT route, direction, stop, date, hour, actual FROM scored", "scored")
def _(t):
    return V.canonical(t.scored.select("route", "direction", "stop", "date", "hour", "actual"), ["route", "direction", "stop", "date", "hour"])


@query("forecast_artifact_check", "P14", """WITH o AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders), h AS (SELECT DISTINCT b AS bucket FROM (SELECT CAST(unnest(generate_series(CAST(m AS TIMESTAMP), CAST(last_day(m) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS b FROM o)),
 p AS (SELECT route_id, stop_id, date, count(*) AS n, bool_or(h.bucket IS NULL) AS off_grid, bool_or((capacity IS NULL) OR false) AS half, bool_or(capacity IS NOT NULL AND NOT predicted BETWEEN lower AND capacity-9) AS outside, bool_or(capacity IS NULL) AS meta FROM points LEFT JOIN h ON h.bucket=points.date GROUP BY ALL)
SELECT route_id, stop_id, count(*) FILTER (n>1) AS repeated, count(*) FILTER (off_grid) AS misaligned, count(*) FILTER (half) AS half_bounds, count(*) FILTER (outside) AS outside_bounds, count(*) FILTER (meta) AS bounds_disagree,
 (SELECT count(*) FROM h) - count(*) FILTER (NOT off_grid) AS missing_buckets FROM p GROUP BY ALL""", "points")
def _(t):
    months = t.orders.select(F.trunc(F.to_date("o_orderdate"), "month").cast("timestamp_ntz").alias("origin")).distinct()
    horizon = forecast_buckets(months, "month").select(F.to_date("bucket_start").alias("bucket"))
    pts = t.points.select("route_id", "stop_id", c("date").alias("bucket"), "predicted", "lower", (c("capacity") - 9).alias("upper"))
    pts = t.spread(pts, "lineitem", "route_id", "stop_id", "bucket")
    return V.validate_forecast(pts, horizon, ["route_id", "stop_id"], True)


@query("scored_run_completeness", "P15", """WITH r AS (SELECT DISTINCT 'r' || (p_partkey % 9) AS route_id FROM part), e AS (SELECT run_id, CAST(max(n) AS BIGINT) AS per_route FROM (SELECT run_id, route_id, count(*) AS n FROM points GROUP BY ALL) GROUP BY ALL),
 g AS (SELECT p.run_id, p.route_id, count(*) AS n, count(*) FILTER (r.route_id IS NULL OR p.date < DATE '1995-06-01' OR p.date >= DATE '2001-06-01') AS bad FROM points p LEFT JOIN r ON r.route_id=p.route_id GROUP BY ALL)
SELECT run_id, CAST(sum(n) AS BIGINT) AS points, CAST(sum(bad) AS BIGINT) AS invalid, count(*) FILTER (n=per_route) AS complete_routes, false AS complete FROM g JOIN e USING (run_id) GROUP BY ALL""", "points")
def _(t):
    pts = t.points.select("run_id", "route_id", c("date").alias("bucket"))
    routes = t.part.select(F.concat(F.lit("r"), c("p_partkey") % 9).alias("route_id")).distinct()
    need = pts.groupBy("run_id", "route_id").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(F.max("n").alias("per_route"))
    return V.scored_run_complete(pts, need, routes, date(1995, 6, 1), date(2001, 6, 1))


@query("report_quality_gate", "P16", """WITH o AS (SELECT o_orderpriority AS candidate, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS origin, avg(o_totalprice)/500000 AS b, median(o_totalprice)/490000 AS k FROM orders GROUP BY ALL),
 g AS (SELECT candidate, count(*) AS origins, min(gap) AS closest, bool_and(origin+60 <= DATE '2001-12-31') AS inside, count(*) FILTER (k>b) AS gains, count(*) FILTER (k<b) AS losses FROM (SELECT *, date_diff('day', lag(origin) OVER (PARTITION BY candidate ORDER BY origin), origin) AS gap FROM o) GROUP BY ALL)
SELECT candidate, origins, CAST(closest AS INT) AS closest, inside, gains, losses, CASE WHEN origins<3 THEN 'needs three origins' WHEN closest<45 OR NOT inside THEN 'origins must be separated history' WHEN gains<2 OR losses>0 THEN 'gate failed on temporal slices' END AS reason,
 NOT (origins<3 OR closest<45 OR NOT inside OR gains<2 OR losses>0) AS passed FROM g""")
def _(t):
    quarter = F.to_date(F.date_trunc("quarter", F.to_date("o_orderdate")))
    rows = t.orders.groupBy(c("o_orderpriority").alias("candidate"), quarter.alias("origin")).agg(
        (F.avg("o_totalprice") / 500000).alias("baseline_score"), (F.median("o_totalprice") / 490000).alias("candidate_score"))
    return V.quality_gate(rows, ["candidate"], date(2001, 12, 31))


FOLD_SQL = """cov AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderdate <> TIMESTAMP '1997-05-10'), sp AS (SELECT min(date) AS f, max(date) AS l FROM cov),
 o AS (SELECT f, l+1 AS lim, CAST(unnest(generate_series(CASE WHEN day(f)=1 THEN f ELSE CAST(date_trunc('month', f) + INTERVAL 1 MONTH AS DATE) END, l, INTERVAL 1 MONTH)) AS DATE) AS origin FROM sp),
 w AS (SELECT *, CAST(origin + INTERVAL 1 MONTH AS DATE) AS test_end, CAST(origin - INTERVAL 1 MONTH AS DATE) AS validation_start, CAST(origin - INTERVAL 1 MONTH AS DATE) - 2 AS train_end FROM o),
 q AS (SELECT w.*, (SELECT count(*) FROM cov WHERE date>=origin AND date<test_end) AS labels, (SELECT count(*) FROM cov WHERE date < train_end) AS tc, greatest(date_diff('day', f, train_end),0) AS td FROM w),
 folds AS (SELECT 'month@' || origin AS fold_id, origin, validation_start, train_end, test_end, CAST(td AS INT) AS train_buckets, CAST(tc AS BIGINT) AS train_covered_buckets,
  CASE WHEN test_end > lim THEN 'horizon_beyond_data' WHEN labels < date_diff('day', origin, test_end) THEN 'incomplete_labels' WHEN validation_start < f OR td < 364 OR tc < 364 THEN 'insufficient_train_history' END AS refusal FROM q)"""


def folds(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("date")).where(c("date") != F.lit(date(1997, 5, 10))).distinct()
    return B.build_folds(days, 364, embargo=2)


@query("fold_construction", "M25", f"WITH {FOLD_SQL} SELECT * FROM folds")
def _(t):
    return folds(t)


MODEL_SQL = f"""{FOLD_SQL}, lab AS (SELECT o_orderpriority AS route, CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS actual FROM orders GROUP BY ALL),
 tgt AS (SELECT fold_id, origin, route, date, actual FROM folds JOIN lab ON date>=origin AND date<test_end WHERE refusal IS NULL),
 preds AS (SELECT 'last_month' AS model, fold_id, origin, t.route, t.date, t.actual, p.v AS predicted FROM tgt t JOIN (SELECT route, CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS m, avg(actual) AS v FROM lab GROUP BY ALL) p ON p.route=t.route AND p.m=t.origin
  UNION ALL SELECT 'flat', fold_id, origin, route, date, actual, 1.0 FROM tgt)"""


def fold_predictions(t):
    labels = t.orders.groupBy(c("o_orderpriority").alias("route"), F.to_date("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("actual"))
    targets = B.fold_targets(labels, folds(t))
    before = labels.groupBy("route", F.add_months(F.trunc("date", "month"), 1).alias("origin")).agg(F.avg("actual").alias("predicted"))
    a = targets.join(before, ["route", "origin"]).withColumn("model", F.lit("last_month"))
    b = targets.withColumn("predicted", F.lit(1.0)).withColumn("model", F.lit("flat"))
    return a.unionByName(b)


@query("rolling_backtest", "M26 E1", f"""WITH {MODEL_SQL}, pf AS (SELECT model, fold_id, count(*) AS scored, sum(actual) AS a, sum(abs(actual-predicted)) AS e FROM preds GROUP BY ALL)
SELECT model, CAST(sum(scored) AS BIGINT) AS scored, round(sum(a),6) AS actual_total, round(sum(e),6) AS error_total, round(sum(e)/sum(scored),6) AS mae, round(sum(e)/sum(a),6) AS wape,
 count(*) FILTER (a>0) AS origins_with_demand, (SELECT count(*) FROM folds WHERE refusal IS NULL) AS eligible_origins, 'evaluated' AS status FROM pf GROUP BY ALL""")
def _(t):
    return rounded_all(B.backtest(fold_predictions(t), folds(t), 3, 3))


@query("fold_targets", "M28", f"WITH {MODEL_SQL} SELECT fold_id, origin, route, date, actual FROM tgt")
def _(t):
    labels = t.orders.groupBy(c("o_orderpriority").alias("route"), F.to_date("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("actual"))
    return B.fold_targets(labels, folds(t))
