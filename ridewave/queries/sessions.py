"""Sessions, bursts and onset detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridewave.operators import sessions as S
from ridewave.queries.base import query, rnd
from ridewave.queries.scoring import rounded_all

c = F.col
RK = ["route"]
# Events folded onto two-hour sessions, dense enough for second-level detectors.
FOLD_SQL = """folded AS (SELECT event_id, route, event_id % 4 AS lane, sec % 7200 AS sec, device % 5 AS device, success FROM validations),
 ft AS (SELECT route, lane, sec, count(*) AS n, count(*) FILTER (success) AS successful FROM folded GROUP BY ALL)"""
FK = ["route", "lane"]


def folded(t):
    return t.validations.select("event_id", "route", (c("event_id") % 4).alias("lane"), (c("sec") % 7200).alias("sec"),
                                (c("device") % 5).alias("device"), "success")


def ft(t):
    return S.seconds_table(folded(t), FK)


GAP_SQL = """st AS (SELECT route, sec, count(*) AS n, count(*) FILTER (success) AS successful FROM validations GROUP BY ALL),
 lg AS (SELECT *, lag(sec) OVER (PARTITION BY route ORDER BY sec) AS p FROM st),
 gb AS (SELECT *, max(CASE WHEN p IS NULL OR sec-p>900 THEN sec END) OVER (PARTITION BY route ORDER BY sec) AS burst FROM lg)"""
CAP_SQL = f"""{GAP_SQL}, cx AS (SELECT route, sec, n, successful, p, burst AS session, min(sec) OVER (PARTITION BY route, burst ORDER BY sec RANGE BETWEEN 3601 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM gb),
 rs AS (SELECT route, session, sec AS s, nxt FROM cx WHERE sec=session UNION ALL SELECT x.route, x.session, x.sec, x.nxt FROM rs JOIN cx x ON x.route=rs.route AND x.session=rs.session AND x.sec=rs.nxt),
 cb AS (SELECT cx.*, (SELECT max(s) FROM rs WHERE rs.route=cx.route AND rs.session=cx.session AND rs.s <= cx.sec) AS burst FROM cx)"""


@query("gap_bursts", "W6", f"WITH {GAP_SQL} SELECT route, sec, n, burst FROM gb", "validations")
def _(t):
    return S.gap_bursts(S.seconds_table(t.validations, RK), RK, 900).select("route", "sec", "n", "burst")


@query("capped_bursts", "W7", f"WITH RECURSIVE {CAP_SQL} SELECT route, sec, burst, sec=burst AND sec<>session AS forced FROM cb", "validations")
def _(t):
    return S.capped_bursts(S.seconds_table(t.validations, RK), RK, 900, 3600).select("route", "sec", "burst", "forced")


@query("burst_summary", "W8", f"WITH RECURSIVE {CAP_SQL} SELECT route, burst AS first, max(sec) AS last, CAST(sum(n) AS BIGINT) AS events, CAST(sum(successful) AS BIGINT) AS successful, CAST(sum(n)-sum(successful) AS BIGINT) AS rejected, coalesce(max(CASE WHEN sec>burst THEN sec-p END),0) AS max_gap, 'device_only_unverified' AS identity_status FROM cb GROUP BY ALL", "validations")
def _(t):
    bursts = S.capped_bursts(S.seconds_table(t.validations, RK), RK, 900, 3600)
    return S.burst_summary(bursts, RK)


@query("sentinel_bursts", "W6", f"""WITH d AS (SELECT event_id, sec, CASE WHEN device % 13 = 0 THEN '' ELSE CAST(device % 9 AS VARCHAR) END AS device FROM validations), st AS (SELECT device, sec FROM d GROUP BY ALL),
 lg AS (SELECT *, lag(sec) OVER (PARTITION BY device ORDER BY sec) AS p FROM st), gb AS (SELECT *, max(CASE WHEN p IS NULL OR sec-p>1200 THEN sec END) OVER (PARTITION BY device ORDER BY sec) AS burst FROM lg)
SELECT event_id, CASE WHEN device='' THEN 'single@' || event_id ELSE device || '@' || burst END AS burst_id FROM d JOIN gb USING (device, sec)""", "validations")
def _(t):
    rows = t.validations.select("event_id", "sec", "success", F.when(c("device") % 13 == 0, "").otherwise(
        (c("device") % 9).cast("string")).alias("device"))
    bursts = S.gap_bursts(S.seconds_table(rows, ["device"]), ["device"], 1200)
    return S.label_events(rows, bursts, ["device"], sentinel=c("device") == "").select("event_id", "burst_id")


@query("session_keys", "W9", """WITH e AS (SELECT event_id, date, hour, route, CAST(direction AS VARCHAR) AS exit, CASE WHEN device % 11=0 THEN '' ELSE CAST(device AS VARCHAR) END AS device, CASE WHEN device % 22=0 THEN '' WHEN k % 9=0 THEN CAST(k % 5 AS VARCHAR) ELSE CAST(vehicle AS VARCHAR) END AS vehicle FROM validations),
 dc AS (SELECT date, hour, device FROM e WHERE device<>'' AND vehicle<>'' GROUP BY ALL HAVING count(DISTINCT vehicle)>1), vc AS (SELECT date, hour, vehicle FROM e WHERE vehicle<>'' GROUP BY ALL HAVING count(DISTINCT route||':'||exit)>1),
 j AS (SELECT e.*, dc.device IS NOT NULL OR vc.vehicle IS NOT NULL AS identity_conflict FROM e LEFT JOIN dc USING (date,hour,device) LEFT JOIN vc USING (date,hour,vehicle))
SELECT event_id, identity_conflict, CASE WHEN device='' AND vehicle='' THEN 'identity_missing' WHEN vehicle<>'' AND NOT identity_conflict THEN 'inferred_vehicle_pool' ELSE 'device_only' END AS identity_kind,
 route || ':' || exit || ':' || CASE WHEN device='' AND vehicle='' THEN 'unknown:' || event_id WHEN vehicle<>'' AND NOT identity_conflict THEN 'v:' || vehicle ELSE 'd:' || device || ':' || vehicle END AS "group" FROM j""", "validations")
def _(t):
    rows = t.validations.select(
        "event_id", "date", "hour", "route", c("direction").cast("string").alias("exit"),
        F.when(c("device") % 11 == 0, "").otherwise(c("device").cast("string")).alias("device"),
        F.when(c("device") % 22 == 0, "").when(c("k") % 9 == 0, (c("k") % 5).cast("string")).otherwise(c("vehicle").cast("string")).alias("vehicle"))
    return S.session_keys(rows).select("event_id", "identity_conflict", "identity_kind", "group")


@query("causal_onsets", "W10", """WITH st AS (SELECT DISTINCT route, sec FROM validations) SELECT route, sec AS onset FROM (SELECT *, lag(sec) OVER (PARTITION BY route ORDER BY sec) AS p FROM st) WHERE sec-p>=1800""", "validations")
def _(t):
    return S.causal_onsets(S.seconds_table(t.validations, RK), RK, 1800)


FB_SQL = f"""{FOLD_SQL}, fl AS (SELECT *, lag(sec) OVER (PARTITION BY route, lane ORDER BY sec) AS p FROM ft), fg AS (SELECT *, max(CASE WHEN p IS NULL OR sec-p>15 THEN sec END) OVER (PARTITION BY route, lane ORDER BY sec) AS burst FROM fl),
 fb AS (SELECT route, lane, burst AS first, max(sec) AS last, sum(n) AS events FROM fg GROUP BY ALL)"""


@query("dense_window", "W11", f"""WITH {FB_SQL}, w AS (SELECT route, lane, first, count(*) OVER a AS k, sum(events) OVER a AS m, sum(CASE WHEN events>=2 THEN 1 ELSE 0 END) OVER a AS d, max(step) OVER s AS hi, min(step) OVER s AS lo, max(last-first) OVER a AS du FROM (SELECT *, lead(first) OVER (PARTITION BY route, lane ORDER BY first)-first AS step FROM fb)
 WINDOW a AS (PARTITION BY route, lane ORDER BY first ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING), s AS (PARTITION BY route, lane ORDER BY first ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING))
SELECT route, lane, first, CAST(m AS BIGINT) AS window_mass FROM (SELECT *, row_number() OVER (PARTITION BY route, lane ORDER BY m DESC, first) AS r FROM w WHERE k=12 AND d>=6 AND hi<=600 AND lo>=15 AND du<=180) WHERE r=1""", "validations")
def _(t):
    bursts = S.gap_bursts(ft(t), FK, 15)
    return S.dense_window(S.burst_summary(bursts, FK), FK, dense=6, mass=2)


BINS_SQL = f"""{FOLD_SQL}, b AS (SELECT route, lane, sec//5 AS b, sum(n) AS count FROM ft GROUP BY ALL), e AS (SELECT route, lane, min(b) AS b0, max(b) AS b1 FROM b GROUP BY ALL),
 u AS (SELECT route, lane, b-b0 AS bin, count, b0*5 AS origin, greatest(b1-b0+1,61) AS bins FROM b JOIN e USING (route,lane)),
 dz AS (SELECT e2.route, e2.lane, i AS bin, e2.origin, e2.bins, coalesce(u.count,0) AS count FROM (SELECT DISTINCT route, lane, origin, bins FROM u) e2 JOIN range(1500) r(i) ON i < e2.bins LEFT JOIN u ON u.route=e2.route AND u.lane=e2.lane AND u.bin=i),
 dn AS (SELECT *, greatest(avg(count) OVER (PARTITION BY route, lane ORDER BY bin ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING),0.1) AS rate FROM dz)"""


@query("burst_intensity", "W12", f"WITH {BINS_SQL} SELECT route, lane, bin, CAST(count AS BIGINT) AS count, round(rate,6) AS rate FROM dn WHERE count>0", "validations")
def _(t):
    return S.intensity(ft(t), FK).where("count > 0").select(*FK, "bin", "count", rnd("rate").alias("rate"))


ONSET_SQL = f"""{BINS_SQL}, sc AS (SELECT route, lane, bin, origin, bins, list(count) OVER w AS cs, list(rate) OVER w AS rs, avg(count) OVER pv AS bf FROM dn
  WINDOW w AS (PARTITION BY route, lane ORDER BY bin ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING), pv AS (PARTITION BY route, lane ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
 os AS (SELECT route, lane, bin, origin+bin*5 AS sec, list_sum([(cs[j+1]-rs[j+1])*exp(-j*5/15.0::DOUBLE) for j in range(12)])/sqrt(list_sum([rs[j+1]*exp(-j*5/15.0::DOUBLE)*exp(-j*5/15.0::DOUBLE) for j in range(12)])) AS score FROM sc
  WHERE bin>=4 AND bin<bins-12 AND cs[1]+cs[2]>=3 AND cs[1]+cs[2]+cs[3]>=cs[4]+cs[5]+cs[6] AND (cs[1]+cs[2]+cs[3])/3 > 1.5*greatest(0.1,bf))"""


@query("decay_onset_scores", "W13", f"WITH {ONSET_SQL} SELECT route, lane, bin, CAST(sec AS BIGINT) AS sec, round(score,6) AS score FROM os", "validations")
def _(t):
    return rounded_all(S.decay_onset_scores(S.intensity(ft(t), FK), FK))


DB_SQL = f"""{FOLD_SQL}, co AS (SELECT *, sum(n) OVER (PARTITION BY route, lane ORDER BY sec RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING) >= 4 AS core FROM ft),
 cl AS (SELECT route, lane, sec, max(CASE WHEN p IS NULL OR sec-p>8 THEN sec END) OVER (PARTITION BY route, lane ORDER BY sec) AS cluster FROM (SELECT route, lane, sec, lag(sec) OVER (PARTITION BY route, lane ORDER BY sec) AS p FROM co WHERE core)),
 db AS (SELECT co.route, co.lane, co.sec, co.n, co.core, coalesce(own.cluster, (SELECT min(cl.cluster) FROM cl WHERE cl.route=co.route AND cl.lane=co.lane AND cl.sec BETWEEN co.sec-8 AND co.sec+8)) AS cluster FROM co LEFT JOIN cl own USING (route,lane,sec))"""


@query("density_clusters", "W14", f"WITH {DB_SQL} SELECT * FROM db", "validations")
def _(t):
    return S.dbscan_1d(ft(t), FK, 8, 4)


@query("cluster_onsets", "W14", f"WITH {DB_SQL} SELECT route, lane, start, events, duration FROM (SELECT route, lane, cluster, min(sec) AS start, CAST(sum(n) AS BIGINT) AS events, max(sec)-min(sec) AS duration FROM db WHERE cluster IS NOT NULL GROUP BY ALL) WHERE duration<=180", "validations")
def _(t):
    return S.clusters(S.dbscan_1d(ft(t), FK, 8, 4), FK)


RATE_SQL = f"""{FOLD_SQL}, lr AS (SELECT *, greatest((coalesce(sum(n) OVER (PARTITION BY route, lane ORDER BY sec RANGE BETWEEN 300 PRECEDING AND 81 PRECEDING),0)+coalesce(sum(n) OVER (PARTITION BY route, lane ORDER BY sec RANGE BETWEEN 80 FOLLOWING AND 299 FOLLOWING),0))
  /greatest(greatest(least(300,sec-min(sec) OVER z)-80,0)+greatest(least(300,max(sec) OVER z-sec)-80,0),1), 1/600.0::DOUBLE) AS rate FROM ft WINDOW z AS (PARTITION BY route, lane))"""


@query("local_background_rate", "W15", f"WITH {RATE_SQL} SELECT route, lane, sec, n, round(rate,6) AS rate FROM lr", "validations")
def _(t):
    return S.local_rate(ft(t), FK).select(*FK, "sec", "n", rnd("rate").alias("rate"))


def scan_sql(w: int) -> str:
    k = f"sum(n) OVER (PARTITION BY route, lane ORDER BY sec RANGE BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"
    return f"round(sign({k}-rate*{w})*sqrt(greatest(2*({k}*ln(greatest({k},1)/(rate*{w}))-{k}+rate*{w}),0)),6) AS scan{w}"


@query("scan_deviance", "W16", f"WITH {RATE_SQL} SELECT route, lane, sec, {', '.join(scan_sql(w) for w in S.SCALES)} FROM lr", "validations")
def _(t):
    return S.scan_scores(ft(t), FK).select(*FK, "sec", *[rnd(f"scan{w}").alias(f"scan{w}") for w in S.SCALES])


@query("device_synchrony", "W16", f"""WITH {FOLD_SQL}, ds AS (SELECT route, lane, device, sec AS s, count(*) AS n FROM folded GROUP BY ALL), sp AS (SELECT route, lane, device, min(s) AS t0, max(s) AS t1 FROM ds GROUP BY ALL),
 pr AS (SELECT a.route, a.lane, a.sec, d.device, greatest(coalesce((SELECT sum(n) FROM ds WHERE ds.route=a.route AND ds.lane=a.lane AND ds.device=d.device AND ((s>=a.sec-300 AND s<a.sec-80) OR (s>=a.sec+80 AND s<a.sec+300))),0)
   /greatest(greatest(least(300,a.sec-d.t0)-80,0)+greatest(least(300,d.t1-a.sec)-80,0),1),1/600.0::DOUBLE) AS rate,
   (SELECT count(*) FROM ds WHERE ds.route=a.route AND ds.lane=a.lane AND ds.device=d.device AND s>=a.sec AND s<a.sec+10)>0 AS has FROM ft a JOIN sp d ON d.route=a.route AND d.lane=a.lane)
SELECT route, lane, sec, count(*) FILTER (has) AS devices10, CASE WHEN count(*) FILTER (has)<2 THEN -100.0::DOUBLE ELSE round((count(*) FILTER (has)-sum(1-exp(-rate*10)))/sqrt(greatest(sum((1-exp(-rate*10))*exp(-rate*10)),0.1)),6) END AS sync10 FROM pr GROUP BY ALL""", "validations")
def _(t):
    rows = folded(t).groupBy(*FK, "device", "sec").agg(F.count(F.lit(1)).alias("n"))
    return rounded_all(S.synchrony(rows, FK, [10])).withColumn("devices10", c("devices10").cast("bigint"))


@query("device_synchrony_days", "W16", """WITH ds AS (SELECT route, date, device, sec AS s, count(*) AS n FROM validations GROUP BY ALL), sp AS (SELECT route, date, device, min(s) AS t0, max(s) AS t1 FROM ds GROUP BY ALL),
 pr AS (SELECT a.route, a.date, a.sec, d.device, greatest(coalesce(sum(n) FILTER (s < a.sec-80 OR s >= a.sec+80), 0)/greatest(greatest(least(300,a.sec-any_value(t0))-80,0)+greatest(least(300,any_value(t1)-a.sec)-80,0),1),1/600.0::DOUBLE) AS rate,
   coalesce(bool_or(s>=a.sec AND s<a.sec+80), false) AS has FROM (SELECT DISTINCT route, date, sec FROM validations) a JOIN sp d ON d.route=a.route AND d.date=a.date LEFT JOIN ds ON ds.route=a.route AND ds.date=a.date AND ds.device=d.device AND s>=a.sec-300 AND s<a.sec+300 GROUP BY a.route, a.date, a.sec, d.device)
SELECT route, date, sec, count(*) FILTER (has) AS devices80, CASE WHEN count(*) FILTER (has)<2 THEN -100.0::DOUBLE ELSE round((count(*) FILTER (has)-sum(1-exp(-rate*80)))/sqrt(greatest(sum((1-exp(-rate*80))*exp(-rate*80)),0.1)),6) END AS sync80 FROM pr GROUP BY ALL""", "validations")
def _(t):
    rows = t.validations.groupBy("route", "date", "device", "sec").agg(F.count(F.lit(1)).alias("n"))
    return rounded_all(S.synchrony(rows, ["route", "date"], [80])).withColumn("devices80", c("devices80").cast("bigint"))


@query("greedy_peaks", "W17")
def _(t):
    scored = S.scan_scores(ft(t), FK).withColumn("w", F.lit(10))
    return S.peaks(scored, FK, "scan10", "w", 1.0)


@query("coalesced_waves", "W17")
def _(t):
    table = ft(t)
    supports = S.adaptive_supports(table, FK, 1.5)
    onsets = S.peaks(S.scan_scores(table, FK).withColumn("w", F.lit(5)), FK, "scan5", "w", 1.0).select(*FK, c("sec").alias("onset"))
    return S.coalesce_waves(table, onsets, supports, FK)


def families(t):
    table = ft(t)
    a = S.gap_bursts(table, FK, 15).select(*FK, c("burst").alias("sec")).distinct().withColumn("family", F.lit("gap15"))
    b = S.clusters(S.dbscan_1d(table, FK, 8, 4), FK).select(*FK, c("start").alias("sec")).withColumn("family", F.lit("density"))
    d = S.decay_onset_scores(S.intensity(table, FK), FK).where("score >= 2.0").select(*FK, "sec").withColumn("family", F.lit("decay"))
    return a.unionByName(b).unionByName(d)


@query("detector_consensus", "W18")
def _(t):
    return S.consensus(families(t), FK, 5, 2)


@query("onset_matching", "W19")
def _(t):
    found = families(t)
    return S.match_onsets(found.where("family = 'gap15'"), found.where("family = 'density'"), FK, 15)


@query("onset_shape", "W20", f"""WITH {FB_SQL}, en AS (SELECT route, lane, min(sec) AS t0, max(sec) AS t1 FROM ft GROUP BY ALL), o AS (SELECT route, lane, first AS onset FROM fb JOIN en USING (route,lane) WHERE first>=t0+90 AND first<=t1-90)
SELECT route, lane, count(DISTINCT onset) AS onsets, {', '.join(f"CAST(coalesce(sum(n) FILTER (sec>=onset+{a} AND sec<onset+{b}),0) AS BIGINT) AS {k}" for k, (a, b) in S.BANDS.items())} FROM o LEFT JOIN ft USING (route,lane) GROUP BY ALL""", "validations")
def _(t):
    onsets = S.gap_bursts(ft(t), FK, 15).select(*FK, c("burst").alias("onset")).distinct()
    return S.onset_shape(onsets, ft(t), FK)


@query("busiest_half_hour", "W31", f"""WITH {FOLD_SQL}, b AS (SELECT route, lane, sec//300 AS bin, sum(n) AS n FROM ft GROUP BY ALL), e AS (SELECT route, lane, min(bin) AS b0, max(bin) AS b1 FROM b GROUP BY ALL),
 s AS (SELECT route, lane, i AS start, sum(n) AS events FROM e JOIN range(40) r(i) ON i BETWEEN b0 AND b1 JOIN b USING (route, lane) WHERE bin BETWEEN i AND i+5 GROUP BY ALL)
SELECT route, lane, start*300 AS begin, CAST(events AS BIGINT) AS events FROM (SELECT *, row_number() OVER (PARTITION BY route, lane ORDER BY events DESC, start) AS r FROM s) WHERE r=1""", "validations")
def _(t):
    return S.busiest_half_hour(ft(t), FK)


def sens_sql(gap: int) -> str:
    return f"""SELECT {gap} AS gap, {86400 * 40} AS span, count(*) AS bursts, CAST(sum(sc) AS BIGINT) AS successful, round(count(*) FILTER (size=1)/count(*),6) AS singleton_share, round(median(size),6) AS size_p50, round(quantile_cont(size,0.9),6) AS size_p90
 FROM (SELECT route, b, sum(n) AS size, sum(successful) AS sc FROM (SELECT *, max(CASE WHEN p IS NULL OR sec-p>{gap} THEN sec END) OVER (PARTITION BY route ORDER BY sec) AS b FROM lg) GROUP BY ALL)"""


@query("burst_sensitivity", "A77", f"WITH {GAP_SQL} {sens_sql(600)} UNION ALL {sens_sql(1800)}", "validations")
def _(t):
    return rounded_all(S.burst_sensitivity(t.validations, RK, [(600, 86400 * 40), (1800, 86400 * 40)]))


UNIF = "(('0x' || substr(md5('{seed}:' || {parts}),1,8))::BIGINT/4294967296.0::DOUBLE)"


@query("perturbed_events", "F21", f"""SELECT event_id, 'thin' AS scenario, sec FROM validations WHERE {UNIF.format(seed='s1', parts='event_id')} >= 0.2
UNION ALL SELECT event_id, 'jitter', sec + CAST(floor({UNIF.format(seed='s1', parts='event_id')}*11) AS BIGINT) - 5 FROM validations
UNION ALL SELECT event_id, 'uniform', sec//300*300 + CAST(floor({UNIF.format(seed='s1', parts='event_id')}*300) AS BIGINT) FROM validations
UNION ALL SELECT event_id, 'rotate', sec//300*300 + (sec%300 + CAST(floor({UNIF.format(seed='s1', parts="device || ':' || (sec//300*300)")}*300) AS BIGINT)) % 300 FROM validations""", "validations")
def _(t):
    names = {"thin": "thin20pct", "jitter": "jitter5seconds", "uniform": "uniform", "rotate": "device_shift"}
    out = None
    for label, scenario in names.items():
        part = S.perturb(t.validations, scenario, "s1").select("event_id", F.lit(label).alias("scenario"), "sec")
        out = part if out is None else out.unionByName(part)
    return out


@query("shuffled_gaps", "F21", f"""WITH {FOLD_SQL}, g AS (SELECT route, lane, sec, min(sec) OVER (PARTITION BY route, lane) AS t0, sec-lag(sec) OVER (PARTITION BY route, lane ORDER BY sec) AS gap FROM ft)
SELECT route, lane, CAST(t0+coalesce(sum(gap) OVER (PARTITION BY route, lane ORDER BY CASE WHEN gap IS NULL THEN -1 ELSE {UNIF.format(seed='s2', parts="route || ':' || lane || ':' || sec")} END, sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),0) AS BIGINT) AS sec FROM g""", "validations")
def _(t):
    return S.shuffle_gaps(ft(t), FK, "s2")


STAB_SQL = f"""thin AS (SELECT * FROM validations WHERE {UNIF.format(seed='s3', parts='event_id')} >= 0.2),
 b1 AS (SELECT route, sec, max(CASE WHEN p IS NULL OR sec-p>900 THEN sec END) OVER (PARTITION BY route ORDER BY sec) AS a FROM (SELECT *, lag(sec) OVER (PARTITION BY route ORDER BY sec) AS p FROM (SELECT DISTINCT route, sec FROM validations))),
 b2 AS (SELECT route, sec, max(CASE WHEN p IS NULL OR sec-p>900 THEN sec END) OVER (PARTITION BY route ORDER BY sec) AS b FROM (SELECT *, lag(sec) OVER (PARTITION BY route ORDER BY sec) AS p FROM (SELECT DISTINCT route, sec FROM thin))),
 pe AS (SELECT a, b, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM thin JOIN b1 USING (route,sec) JOIN b2 USING (route,sec) WINDOW w AS (PARTITION BY route ORDER BY sec, event_id))"""


@query("burst_edge_stability", "A68 U3", f"""WITH {STAB_SQL}, k AS (SELECT count(*) AS pairs, count(*) FILTER (a=pa) AS baseline_edges, count(*) FILTER (b=pb) AS changed_edges, count(*) FILTER (a=pa AND b=pb) AS preserved_edges, count(*) FILTER (a=pa OR b=pb) AS edge_union, count(*) FILTER ((a=pa)<>(b=pb)) AS edge_difference FROM pe WHERE pa IS NOT NULL)
SELECT *, round(preserved_edges/baseline_edges,6) AS retention, round(preserved_edges/edge_union,6) AS jaccard, round((pairs-edge_difference)/pairs,6) AS agreement FROM k""", "validations")
def _(t):
    thin = S.perturb(t.validations, "thin20pct", "s3")
    return rounded_all(S.burst_stability(t.validations, thin, RK, 900, 86400 * 40))


@query("picked_sessions", "T5", """WITH s AS (SELECT route, device AS "group", count(*) AS events FROM validations GROUP BY ALL HAVING count(*)>=10), r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY events, "group")-1 AS i, count(*) OVER (PARTITION BY route) AS n FROM s)
SELECT route, 'low' AS rank, "group", events FROM r WHERE i=0 AND n>=3 UNION ALL SELECT route, 'median', "group", events FROM r WHERE i=(n-1)//2 AND n>=3 UNION ALL SELECT route, 'high', "group", events FROM r WHERE i=n-1 AND n>=3""", "validations")
def _(t):
    rows = t.validations.groupBy("route", c("device").alias("group")).agg(F.count(F.lit(1)).alias("events"))
    return S.pick_sessions(rows, ["route"], 10)


@query("detector_benchmark", "A80")
def _(t):
    found = families(t)
    control = S.perturb(folded(t), "uniform", "s4")
    null = S.gap_bursts(S.seconds_table(control, FK), FK, 15).groupBy(*FK).agg(F.count_distinct("burst").alias("control"))
    out = None
    for method in ("gap15", "decay"):
        m = S.match_onsets(found.where("family = 'density'"), found.where(c("family") == method), FK).withColumn("method", F.lit(method))
        out = m if out is None else out.unionByName(m)
    return rounded_all(S.detector_summary(out.join(null, FK, "left").fillna(0, ["control"])))
