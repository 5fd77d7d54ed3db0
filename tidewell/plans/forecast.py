"""Queries of the time-series forecast."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidewell.operators import forecast as fc
from tidewell.operators import intel, outlook
from tidewell.plans.registry import EV, half_up, query
from tidewell.sources import adapters as src

AT, WHAT = "coalesce(published_at, fetched_at)", "coalesce(canonical_url, event_id)"


def daily_sql(name: str = "daily", now: str = "now", days: int = 30) -> str:
    return f""", {name} AS (SELECT topic, CAST({AT} AS DATE) AS day, count(DISTINCT {WHAT}) AS volume, count(DISTINCT source) AS sources FROM te, {now} WHERE {AT} >= t - INTERVAL {days} DAY GROUP BY 1, 2)"""


def _volumes_sql() -> str:
    parts = []
    for d in fc.WINDOWS:
        parts.append(f"count(DISTINCT CASE WHEN a >= t - INTERVAL {d} DAY THEN w END) AS v{d}, count(DISTINCT CASE WHEN a >= t - INTERVAL {2 * d} DAY AND a < t - INTERVAL {d} DAY THEN w END) AS p{d}")
    acc = ", ".join(f"CASE WHEN v{d} = 0 THEN 0.0 WHEN p{d} > 0 THEN {half_up(f'(v{d} - p{d}) / CAST(p{d} AS DOUBLE)', 2)} ELSE 1.0 END AS a{d}" for d in fc.WINDOWS)
    names = ", ".join(f"v{d}" for d in fc.WINDOWS)
    return f""", raw_vols AS (SELECT topic, {', '.join(parts)} FROM (SELECT topic, {AT} AS a, {WHAT} AS w FROM te), now WHERE a >= t - INTERVAL 180 DAY GROUP BY topic),
vols AS (SELECT topic, {names}, {acc} FROM raw_vols WHERE greatest({names}) > 0)"""


VOLS = EV + _volumes_sql()
RULE = """, med AS (SELECT list_sort(list(v30))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS med FROM vols),
ruled AS (SELECT vols.*, CASE WHEN a1 > .5 AND a7 > 0 AND v30 < med THEN 'emerging' WHEN a1 > 0 AND a7 > 0 AND a30 > 0 THEN 'accelerating' WHEN a1 < 0 AND a7 > 0 THEN 'peaking' WHEN a1 < 0 AND a7 < 0 THEN 'decaying'
  WHEN abs(a1) < .2 AND abs(a7) < .2 AND abs(a30) < .2 THEN 'stable' WHEN abs(a1) < .1 AND a7 > 1 AND a30 > 0 AND v30 < med THEN 'emerging' WHEN abs(a1) < .1 AND a7 > .2 AND a30 > 0 THEN 'accelerating'
  WHEN abs(a1) < .1 AND a7 < -.1 AND a30 > .2 THEN 'peaking' WHEN abs(a1) < .1 AND a7 < -.1 AND a30 < -.1 THEN 'decaying' ELSE 'stable' END AS rule_phase,
  floor(greatest(up, down, 4 - up - down) / 4.0 * 100 + 0.5) / 100.0 AS rule_confidence
 FROM (SELECT *, (CASE WHEN a1 > .2 THEN 1 ELSE 0 END) + (CASE WHEN a7 > .2 THEN 1 ELSE 0 END) + (CASE WHEN a30 > .2 THEN 1 ELSE 0 END) + (CASE WHEN a90 > .2 THEN 1 ELSE 0 END) AS up,
  (CASE WHEN a1 < -.2 THEN 1 ELSE 0 END) + (CASE WHEN a7 < -.2 THEN 1 ELSE 0 END) + (CASE WHEN a30 < -.2 THEN 1 ELSE 0 END) + (CASE WHEN a90 < -.2 THEN 1 ELSE 0 END) AS down FROM vols) vols, med)"""


def _posterior_sql() -> str:
    terms = []
    for phase, (means, sd) in fc.EMISSIONS.items():
        terms.append(" + ".join(f"(-0.5 * ln(2 * pi()) - ln({sd}) - 0.5 * pow((a{d} - ({m})) / {sd}, 2))" for d, m in zip(fc.WINDOWS, means, strict=True)) + f" AS l_{phase}")
    names = list(fc.EMISSIONS)
    top = "greatest(" + ", ".join(f"l_{p}" for p in names) + ")"
    total = " + ".join(f"exp(l_{p} - top)" for p in names)
    ps = ", ".join(f"{half_up(f'exp(l_{p} - top) / ({total})', 3)} AS p_{p}" for p in names)
    best = "greatest(" + ", ".join(f"p_{p}" for p in names) + ")"
    case = " ".join(f"WHEN p_{p} = {best} THEN '{p}'" for p in names)
    return f""", lik AS (SELECT *, {', '.join(terms)} FROM ruled), lik2 AS (SELECT *, {top} AS top FROM lik), post0 AS (SELECT topic, rule_phase, rule_confidence, {ps} FROM lik2),
post AS (SELECT *, CASE {case} END AS hmm_phase, {best} AS hmm_confidence FROM post0),
life AS (SELECT topic, CASE WHEN hmm_confidence > rule_confidence + 0.15 THEN hmm_phase ELSE rule_phase END AS phase, CASE WHEN hmm_confidence > rule_confidence + 0.15 THEN hmm_confidence ELSE rule_confidence END AS phase_confidence FROM post)"""


LIFE = VOLS + RULE + _posterior_sql()


class Inputs:
    """What the forecast queries share."""

    def __init__(self, spark, sf, back: int = 0, topics: int = 10) -> None:
        self.te = src.topic_events(spark, sf, topics)
        self.now = src.latest(self.te) - timedelta(days=back)
        if back:
            self.te = self.te.where(F.col("fetched_at") <= fc.moment(self.now))
        self.daily = fc.daily_volume(self.te, self.now)
        self.volumes = fc.lifecycle_volumes(self.te, self.now)
        self.counts = self.te.groupBy("topic").agg(F.count("*").alias("events"))

    def chains(self):
        return fc.chains(self.daily, self.te, self.volumes, self.now)

    def scenarios(self):
        return fc.scenarios(fc.tiers(self.chains(), self.counts), fc.base_rates(self.daily), fc.cusum(self.daily, self.now), fc.entropy(self.daily))


@query("lifecycle_volumes", VOLS + "SELECT * FROM vols")
def lifecycle_volumes(spark, sf):
    return Inputs(spark, sf).volumes


@query("lifecycle_phase", LIFE + "SELECT topic, rule_phase, rule_confidence FROM post")
def lifecycle_phase(spark, sf):
    return fc.rule_phase(Inputs(spark, sf).volumes).select("topic", "rule_phase", "rule_confidence")


@query("phase_posterior", LIFE + "SELECT topic, p_emerging, p_accelerating, p_peaking, p_decaying, p_stable, hmm_phase, hmm_confidence FROM post")
def phase_posterior(spark, sf):
    return fc.phase_posterior(Inputs(spark, sf).volumes).select("topic", *[f"p_{p}" for p in fc.EMISSIONS], "hmm_phase", "hmm_confidence")


@query("lifecycles", LIFE + "SELECT * FROM life")
def lifecycles(spark, sf):
    return fc.lifecycles(Inputs(spark, sf).volumes).select("topic", "phase", "phase_confidence")


@query("cold_start", LIFE + ", cnt AS (SELECT topic, count(*) AS n FROM te WHERE source = 's0' GROUP BY topic) SELECT topic, CASE WHEN coalesce(n, 0) < 50 THEN 'insufficient_data' ELSE phase END AS phase, least(phase_confidence, floor((0.3 + 0.7 * 29 / 90) * 100 + 0.5) / 100.0) AS phase_confidence FROM life LEFT JOIN cnt USING (topic)")
def cold_start(spark, sf):
    x = Inputs(spark, sf)
    counts = x.te.where("source = 's0'").groupBy("topic").agg(F.count("*").alias("events"))
    return fc.lifecycles(x.volumes, counts, data_days=29).select("topic", "phase", "phase_confidence")


@query("daily_spikes", EV + daily_sql() + "SELECT topic, CAST(day AS VARCHAR) AS day, volume, sources FROM daily WHERE volume >= 3")
def daily_spikes(spark, sf):
    return fc.spikes(Inputs(spark, sf).daily).withColumn("day", F.col("day").cast("string"))


@query("entropy", EV + daily_sql() + """, q AS (SELECT topic, volume / CAST(sum(volume) OVER (PARTITION BY topic) AS DOUBLE) AS p FROM daily), e AS (SELECT topic, sum(-p * log2(p)) AS h, count(*) AS active_days FROM q GROUP BY topic)
SELECT topic, floor(h * 1000.0 + 0.5) / 1000.0 AS entropy, floor(h / CASE WHEN active_days > 1 THEN log2(active_days) ELSE 1.0 END * 100.0 + 0.5) / 100.0 AS normalized_entropy, active_days FROM e""")
def entropy(spark, sf):
    return fc.entropy(Inputs(spark, sf).daily)


@query("multiscale", VOLS + """SELECT topic, s AS short, a7 AS medium, g AS long, CASE WHEN s > 0 AND a7 > 0 AND g > 0 THEN 'aligned_up' WHEN s < 0 AND a7 < 0 AND g < 0 THEN 'aligned_down' WHEN s * g < 0 THEN 'diverging' WHEN s * a7 < 0 THEN 'transitioning' ELSE 'aligned_down' END AS alignment
FROM (SELECT *, CASE WHEN abs(a1) < .1 THEN a7 ELSE a1 END AS s, CASE WHEN abs(a90) >= .05 THEN a90 ELSE a30 END AS g FROM vols)""")
def multiscale(spark, sf):
    return fc.multiscale(Inputs(spark, sf).volumes)


CHAINS = VOLS + daily_sql() + f""", sp AS (SELECT * FROM daily WHERE volume >= 3), per AS (SELECT topic, count(*) AS s FROM sp GROUP BY topic), dd AS (SELECT count(DISTINCT day) AS D FROM sp),
cp AS (SELECT a.topic AS from_topic, b.topic AS to_topic, count(*) AS support, avg(b.day - a.day) AS lag, stddev_pop(b.day - a.day) AS sd, avg(least(a.sources, b.sources)) AS ms, max(b.day) AS last_day,
  avg(CASE WHEN isodow(a.day) < 6 THEN 1.0 ELSE 0.0 END) AS wa, avg(CASE WHEN isodow(b.day) < 6 THEN 1.0 ELSE 0.0 END) AS wb
  FROM sp a JOIN sp b ON b.day > a.day AND b.day - a.day <= 7 AND a.topic <> b.topic GROUP BY 1, 2 HAVING count(*) >= 2),
cl AS (SELECT cp.*, x.s AS sa, D, support * D / CAST(x.s * y.s AS DOUBLE) AS lift0 FROM cp JOIN per x ON x.topic = from_topic JOIN per y ON y.topic = to_topic, dd ORDER BY lift0 DESC, support DESC, from_topic, to_topic LIMIT 500),
act AS (SELECT topic FROM te, now WHERE {AT} >= t - INTERVAL 1 DAY GROUP BY topic HAVING count(DISTINCT {WHAT}) >= 3 UNION SELECT topic FROM vols WHERE a7 > 1),
c0 AS (SELECT from_topic, to_topic, support, {half_up('lag', 1)} AS avg_lag_days, {half_up('sd', 2)} AS lag_stddev, {half_up('ms / max(ms) OVER ()', 2)} AS source_diversity, from_topic IN (SELECT topic FROM act) AS active,
  {half_up('lift0', 2)} AS lift, {half_up('least(1.0, support / CAST(sa AS DOUBLE))', 2)} AS confidence,
  {half_up("support * exp(-ln(2) / 14 * greatest(0.0, (epoch_us(t) / 1000000.0 - epoch(last_day)) / 86400.0))", 2)} AS decay_weighted_support,
  {half_up('sa / CAST(D AS DOUBLE)', 2)} AS trigger_base_rate, {half_up('(wa + wb) / 2', 2)} AS weekday_ratio, wa > .75 AND wb > .75 AS weekday_correlated FROM cl, now),
ch AS (SELECT c0.*, CASE WHEN r.support IS NULL THEN 1.0 ELSE {half_up('c0.support / CAST(c0.support + r.support AS DOUBLE)', 2)} END AS directionality FROM c0 LEFT JOIN c0 r ON r.from_topic = c0.to_topic AND r.to_topic = c0.from_topic),
cnt AS (SELECT topic, count(*) AS n FROM te GROUP BY topic),
tr AS (SELECT ch.*, CASE WHEN least(x.n, y.n) < 50 THEN 'spurious' WHEN least(x.n, y.n) >= 500 AND source_diversity >= .6 AND support >= 30 THEN 'high' WHEN least(x.n, y.n) >= 100 AND source_diversity >= .5 AND support >= 10 THEN 'moderate' ELSE 'low' END AS confidence_tier
  FROM ch JOIN cnt x ON x.topic = from_topic JOIN cnt y ON y.topic = to_topic)"""


@query("chains", CHAINS + "SELECT * FROM ch")
def chains(spark, sf):
    return Inputs(spark, sf).chains()


@query("chain_directionality", CHAINS + "SELECT from_topic, to_topic, directionality FROM ch WHERE directionality < 1")
def chain_directionality(spark, sf):
    return Inputs(spark, sf).chains().where("directionality < 1").select("from_topic", "to_topic", "directionality")


@query("chain_tiers", CHAINS + "SELECT confidence_tier, count(*) AS chains FROM tr GROUP BY 1")
def chain_tiers(spark, sf):
    x = Inputs(spark, sf)
    return fc.tiers(x.chains(), x.counts).groupBy("confidence_tier").agg(F.count("*").alias("chains"))


@query("transitive_chains", CHAINS + f""", tc AS (SELECT x.from_topic AS a, x.to_topic AS b, y.to_topic AS c, {half_up('x.avg_lag_days + y.avg_lag_days', 1)} AS total_lag_days, least(x.support, y.support) AS min_support, {half_up('x.lift * y.lift', 2)} AS combined_lift,
 split_part(x.from_topic, '.', 1) <> split_part(y.to_topic, '.', 1) AS cross_domain, {half_up('sqrt(x.confidence * y.confidence)', 2)} AS normalized_confidence FROM ch x JOIN ch y ON x.to_topic = y.from_topic AND y.to_topic <> x.from_topic)
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY combined_lift DESC, c) AS rn FROM tc) WHERE rn <= 3 ORDER BY combined_lift DESC, a, b, c LIMIT 100""")
def transitive_chains(spark, sf):
    return fc.transitive_chains(Inputs(spark, sf).chains())


@query("ranked_chains", CHAINS + f""", rk AS (SELECT from_topic, to_topic, {half_up('support * source_diversity * lift * confidence * (1 + greatest(0.0, CASE WHEN abs(a1) >= .1 THEN a1 ELSE a7 END)) / (1 + 3 * greatest(0.0, trigger_base_rate - .5))', 2)} AS score,
 split_part(from_topic, '.', 1) <> split_part(to_topic, '.', 1) AS cross_domain FROM ch JOIN vols ON topic = from_topic WHERE active)
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY from_topic ORDER BY cross_domain DESC, score DESC, to_topic) AS rn FROM rk) WHERE rn <= 3 ORDER BY cross_domain DESC, score DESC, from_topic, to_topic LIMIT 50""")
def ranked_chains(spark, sf):
    x = Inputs(spark, sf)
    return fc.ranked_chains(x.chains(), x.volumes)


@query("base_rates", EV + daily_sql() + "SELECT topic, count(*) / CAST((SELECT count(DISTINCT day) FROM daily) AS DOUBLE) AS base_rate FROM daily WHERE volume >= 3 GROUP BY topic")
def base_rates(spark, sf):
    return fc.base_rates(Inputs(spark, sf).daily)


CUSUM = """, st AS (SELECT topic, avg(volume) AS mu, stddev_pop(volume) AS sd FROM daily GROUP BY topic HAVING count(*) >= 3 AND stddev_pop(volume) >= 0.01),
sr AS (SELECT topic, day, volume, mu, sd, row_number() OVER (PARTITION BY topic ORDER BY day) AS rn FROM daily JOIN st USING (topic)),
fold AS (SELECT topic, CAST(NULL AS DATE) AS day, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, false AS hit FROM st UNION ALL
 SELECT topic, day, rn, CASE WHEN u > 4 * sd OR d > 4 * sd THEN 0.0 ELSE u END, CASE WHEN u > 4 * sd OR d > 4 * sd THEN 0.0 ELSE d END, u > 4 * sd OR d > 4 * sd FROM (
  SELECT sr.topic, sr.day, sr.rn, sr.sd, greatest(0.0, fold.up + (volume - mu) - sd * 0.5) AS u, greatest(0.0, fold.dn - (volume - mu) - sd * 0.5) AS d FROM fold JOIN sr ON sr.topic = fold.topic AND sr.rn = fold.rn + 1)),
cus AS (SELECT topic, day, CAST(floor((epoch_us(t) / 1000000.0 / 86400.0 - epoch(day) / 86400.0) + 0.5) AS BIGINT) AS days_ago FROM fold, now WHERE hit)"""


@query("cusum_change_points", (EV + daily_sql() + CUSUM + "SELECT topic, CAST(day AS VARCHAR) AS day, days_ago FROM cus").replace("WITH ev", "WITH RECURSIVE ev", 1))
def cusum_change_points(spark, sf):
    x = Inputs(spark, sf)
    return fc.cusum(x.daily, x.now).withColumn("day", F.col("day").cast("string"))


SCEN = (CHAINS + CUSUM + f""", ac AS (SELECT * FROM tr WHERE active AND lift >= 1.0), fan AS (SELECT from_topic, count(*) AS fan FROM ac GROUP BY 1), lst AS (SELECT topic, min(days_ago) AS cp FROM cus GROUP BY 1),
sg AS (SELECT ac.*, greatest(0.0, avg_lag_days - 2 * lag_stddev) AS lo, avg_lag_days + 2 * lag_stddev AS hi, lift * (decay_weighted_support / support) * CASE WHEN least(x.cp, y.cp) < 7 THEN .5 + .5 * (least(x.cp, y.cp) / 7.0) ELSE 1.0 END * sqrt(greatest(confidence, .01)) * sqrt(greatest(source_diversity, .01)) / log2(1.0 + fan) AS signal
 FROM ac JOIN fan USING (from_topic) LEFT JOIN lst x ON x.topic = from_topic LEFT JOIN lst y ON y.topic = to_topic),
tp AS (SELECT *, CASE confidence_tier WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS code FROM (SELECT *, row_number() OVER (PARTITION BY to_topic ORDER BY signal DESC, from_topic) AS rn FROM sg) WHERE rn <= 5),
br AS (SELECT topic, count(*) / CAST((SELECT count(DISTINCT day) FROM daily) AS DOUBLE) AS base FROM daily WHERE volume >= 3 GROUP BY topic),
eq AS (SELECT topic, floor(sum(-p * log2(p)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1.0 END * 100.0 + 0.5) / 100.0 AS ne FROM (SELECT topic, volume / CAST(sum(volume) OVER (PARTITION BY topic) AS DOUBLE) AS p FROM daily) GROUP BY topic),
tg AS (SELECT to_topic AS topic, sum(ln(greatest(signal, 1.01))) AS gain, count(*) AS chains, min(lo) AS lo, max(hi) AS hi, min(code) AS worst, max(code) AS best FROM tp GROUP BY 1),
sc AS (SELECT tg.*, coalesce(base, .05) AS b, coalesce(ne, 0.0) AS ne, (ln(coalesce(base, .05)) + gain) / .5 AS lp FROM tg LEFT JOIN br USING (topic) LEFT JOIN eq USING (topic)),
se AS (SELECT *, exp(lp - max(lp) OVER ()) AS e FROM sc), sf AS (SELECT *, {half_up('e / sum(e) OVER ()', 3)} AS score FROM se),
scen AS (SELECT topic, score, chains, {half_up('greatest(0.0, (hi + lo) / 2 - (hi - lo) / 2 * (1 + ne))', 1)} AS from_days, {half_up('(hi + lo) / 2 + (hi - lo) / 2 * (1 + ne)', 1)} AS to_days, {half_up('b', 3)} AS base_rate, worst FROM sf WHERE best > 1 AND NOT (b > .8 AND best < 3))""").replace("lift >= 1.0", "lift >= 1.5").replace("WITH ev", "WITH RECURSIVE ev", 1)


@query("scenarios", SCEN + "SELECT * FROM scen")
def scenarios(spark, sf):
    return Inputs(spark, sf).scenarios()


@query("dynamics_loops", CHAINS + f"""SELECT x.from_topic AS topic_a, x.to_topic AS topic_b, x.directionality, {half_up('least(x.lift, y.lift)', 2)} AS mutual_lift FROM ch x JOIN ch y ON x.from_topic = y.to_topic AND x.to_topic = y.from_topic AND x.from_topic < x.to_topic
WHERE x.directionality BETWEEN .3 AND .7 AND x.lift > 1 AND y.lift > 1 ORDER BY mutual_lift DESC, topic_a, topic_b LIMIT 10""")
def dynamics_loops(spark, sf):
    return fc.reinforcing_loops(Inputs(spark, sf).chains())


@query("dynamics_delays", CHAINS + "SELECT from_topic, to_topic, avg_lag_days, lag_stddev FROM ch WHERE active AND avg_lag_days >= .5 ORDER BY lag_stddev, from_topic, to_topic LIMIT 10")
def dynamics_delays(spark, sf):
    return fc.delays(Inputs(spark, sf).chains())


FRESH = f", fresh AS (SELECT DISTINCT topic FROM te, now WHERE published_at >= t - INTERVAL 30 DAY)"


@query("dynamics_accumulation", LIFE + daily_sql() + FRESH + """, e AS (SELECT topic, floor(sum(-p * log2(p)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1.0 END * 100.0 + 0.5) / 100.0 AS normalized_entropy FROM (SELECT topic, volume / CAST(sum(volume) OVER (PARTITION BY topic) AS DOUBLE) AS p FROM daily) GROUP BY topic)
SELECT topic, phase, normalized_entropy FROM life JOIN fresh USING (topic) JOIN e USING (topic) JOIN vols USING (topic) WHERE phase IN ('emerging', 'accelerating') AND normalized_entropy > .5 AND CASE WHEN abs(a1) < .1 THEN a7 ELSE a1 END > 0 AND a7 > 0 AND CASE WHEN abs(a90) >= .05 THEN a90 ELSE a30 END > 0 ORDER BY 3 DESC, 1 LIMIT 10""")
def dynamics_accumulation(spark, sf):
    x = Inputs(spark, sf)
    return fc.accumulations(fc.lifecycles(x.volumes), fc.multiscale(x.volumes), fc.entropy(x.daily), fc.fresh_topics(x.te, x.now))


@query("dynamics_dampening", (LIFE + daily_sql() + CUSUM + "SELECT topic, min(days_ago) AS days_ago FROM life JOIN cus USING (topic) WHERE phase = 'decaying' AND days_ago <= 14 GROUP BY topic ORDER BY 2, 1 LIMIT 10").replace("WITH ev", "WITH RECURSIVE ev", 1))
def dynamics_dampening(spark, sf):
    x = Inputs(spark, sf)
    return fc.dampening(fc.lifecycles(x.volumes), fc.cusum(x.daily, x.now))


@query("freshness_gate", EV + FRESH + "SELECT topic FROM fresh")
def freshness_gate(spark, sf):
    x = Inputs(spark, sf)
    return fc.fresh_topics(x.te, x.now)


QUALITY = EV + """, w AS (SELECT * FROM ev, now WHERE fetched_at >= t - INTERVAL 30 DAY), c AS (SELECT source, count(*) AS c FROM w GROUP BY source ORDER BY c DESC, source LIMIT 1)
SELECT (SELECT count(*) FROM w) AS events_analyzed, floor((SELECT count(*) FROM w ANTI JOIN (SELECT * FROM et WHERE topic NOT LIKE 'view.%') USING (event_id)) / CAST((SELECT count(*) FROM w) AS DOUBLE) * 100 * 10.0 + 0.5) / 10.0 AS unclassified_pct,
 source AS top_source, floor(c / CAST((SELECT count(*) FROM w) AS DOUBLE) * 100 * 10.0 + 0.5) / 10.0 AS top_source_pct FROM c"""


@query("data_quality", QUALITY)
def data_quality(spark, sf):
    ev = src.events(spark, sf)
    return fc.data_quality(ev, src.event_topics(spark, sf).where(~F.col("topic").startswith("view.")), src.latest(ev))


def _best(name: str, source: str) -> str:
    return f"{name} AS (SELECT topic, list_sort(list(title)) AS titles FROM (SELECT x.topic, title, row_number() OVER (PARTITION BY x.topic ORDER BY score DESC, fetched_at DESC, event_id) AS rn FROM {source}) WHERE rn <= 3 GROUP BY topic)"


CONTEXT = (EV + daily_sql() + CUSUM + f""", dt AS (SELECT DISTINCT topic FROM daily), lc AS (SELECT topic, max(day) AS cp FROM cus GROUP BY topic HAVING min(days_ago) > 3),
{_best("tn", f"te x SEMI JOIN dt USING (topic), now WHERE {AT} >= t - INTERVAL 1 DAY")}, {_best("ta", f"te x JOIN lc ON lc.topic = x.topic SEMI JOIN dt ON dt.topic = x.topic WHERE abs(CAST({AT} AS DATE) - cp) <= 2")}
SELECT topic, coalesce(array_to_string(tn.titles, '|'), '') AS titles, coalesce(array_to_string(list_sort(list_distinct(list_filter(ta.titles, lambda y: NOT coalesce(list_contains(tn.titles, y), false)))), '|'), '') AS break_titles FROM tn FULL JOIN ta USING (topic)""").replace("WITH ev", "WITH RECURSIVE ev", 1)


@query("context_titles", CONTEXT)
def context_titles(spark, sf):
    x = Inputs(spark, sf)
    found = fc.context_titles(x.te, x.daily.select("topic").distinct(), fc.cusum(x.daily, x.now), x.now)
    return found.select("topic", F.array_join("titles", "|").alias("titles"), F.array_join("break_titles", "|").alias("break_titles"))


def _outcomes(spark, sf):
    """Snapshots of days 20 to 23 of the month, evaluated at its end."""
    now = Inputs(spark, sf)
    saved = None
    for k, back in enumerate((10, 9, 8, 7)):
        then = Inputs(spark, sf, back)
        one = fc.snapshot(fc.base_rates(then.daily).withColumns({"score": fc.half_up(F.col("base_rate"), 3), "from_days": F.lit(1.0), "to_days": F.lit(2.0 + k % 2), "base_rate": fc.half_up(F.col("base_rate"), 3)}), k, then.now, top=20)
        saved = one if saved is None else saved.unionByName(one)
    return fc.evaluate(saved, now.te, now.now)


def _outcomes_sql() -> str:
    parts, sql = [], EV
    for k, back in enumerate((10, 9, 8, 7)):
        sql += f", now{k} AS (SELECT max(ts) - INTERVAL {back} DAY AS t FROM events), te{k} AS (SELECT te.* FROM te, now{k} WHERE fetched_at <= t)"
        sql += daily_sql(f"daily{k}", f"now{k}").replace("FROM te,", f"FROM te{k},")
        sql += f", rate{k} AS (SELECT topic, {half_up(f'count(*) / CAST((SELECT count(DISTINCT day) FROM daily{k}) AS DOUBLE)', 3)} AS p FROM daily{k} WHERE volume >= 3 GROUP BY topic ORDER BY p DESC, topic LIMIT 20)"
        parts.append(f"SELECT CAST({k} AS BIGINT) AS snapshot_id, topic, p, CAST(t AS DATE) AS d, {2 + k % 2} AS to_days FROM rate{k}, now{k}")
    return sql + f""", saved AS ({' UNION ALL '.join(parts)}), hot AS (SELECT topic, CAST({AT} AS DATE) AS day FROM te GROUP BY 1, 2 HAVING count(*) >= 3),
 o AS (SELECT snapshot_id, topic, p AS predicted_probability, CASE WHEN EXISTS (SELECT 1 FROM hot WHERE hot.topic = saved.topic AND day >= d + 1 AND day <= d + to_days) THEN 1 ELSE 0 END AS outcome FROM saved),
 outcomes AS (SELECT *, {half_up('(predicted_probability - outcome) * (predicted_probability - outcome)', 6)} AS brier_score, {half_up('predicted_probability * (1 - predicted_probability) * (1 - predicted_probability) + (1 - predicted_probability) * predicted_probability * predicted_probability', 6)} AS brier_ref FROM o)"""


@query("snapshot_outcomes", _outcomes_sql() + "SELECT * FROM outcomes")
def snapshot_outcomes(spark, sf):
    return _outcomes(spark, sf)


@query("topic_weights", _outcomes_sql() + """, k AS (SELECT topic, count(*) AS n, avg(CASE WHEN brier_ref > 0 THEN 1 - brier_score / brier_ref END) AS s, avg(brier_score) AS b, CAST(sum(outcome) AS BIGINT) AS true_positives, CAST(sum(1 - outcome) AS BIGINT) AS false_positives FROM outcomes GROUP BY topic)
SELECT topic, floor(CASE WHEN s IS NOT NULL THEN .5 + .5 * greatest(0.0, s) ELSE .5 + .5 * (1 - b) END * 1000.0 + 0.5) / 1000.0 AS weight, true_positives, false_positives FROM k WHERE n >= 2""")
def topic_weights(spark, sf):
    return fc.learned_weights(_outcomes(spark, sf), least=2)


@query("audit_flags")
def audit_flags(spark, sf):
    x = Inputs(spark, sf)
    found = x.chains()
    cross = found.where(F.split_part("from_topic", F.lit("."), F.lit(1)) != F.split_part("to_topic", F.lit("."), F.lit(1))).groupBy(F.col("from_topic").alias("topic")).agg(F.count("*").alias("cross_domain"))
    weights = fc.learned_weights(_outcomes(spark, sf), least=2).select("topic", "weight")
    return intel.audit_flags(intel.audit_volume(x.te, x.now), intel.audit_overlap(src.event_topics(spark, sf)), weights, cross)


#: With twenty topics of a kind many are too small for a spike on most days, so tiers differ and scenarios have rows.
FINE = 20


def fine(sql: str) -> str:
    return sql.replace("% 10 AS VARCHAR", f"% {FINE} AS VARCHAR")


@query("chain_tiers_fine", fine(CHAINS) + "SELECT from_topic, to_topic, confidence_tier FROM tr")
def chain_tiers_fine(spark, sf):
    x = Inputs(spark, sf, topics=FINE)
    return fc.tiers(x.chains(), x.counts).select("from_topic", "to_topic", "confidence_tier")


@query("scenarios_fine", fine(SCEN) + "SELECT * FROM scen")
def scenarios_fine(spark, sf):
    return Inputs(spark, sf, topics=FINE).scenarios()


@query("change_points_summary", fine(EV + daily_sql() + CUSUM).replace("WITH ev", "WITH RECURSIVE ev", 1) + "SELECT topic, days_ago FROM cus")
def change_points_summary(spark, sf):
    x = Inputs(spark, sf, topics=FINE)
    return fc.cusum(x.daily, x.now).select("topic", "days_ago")


@query("scenario_evidence", fine(SCEN) + """, tn AS (SELECT event_id, count(*) AS topic_count FROM te GROUP BY 1), wn AS (SELECT te.topic, event_id, title, CAST(row_number() OVER (PARTITION BY te.topic ORDER BY te.score DESC, coalesce(published_at, fetched_at) DESC, event_id) AS INTEGER) AS rn
 FROM te JOIN scen ON scen.topic = te.topic, now WHERE coalesce(published_at, fetched_at) >= t - INTERVAL 30 DAY)
SELECT topic, rn, title, topic_count, CASE WHEN topic_count <= 4 THEN 'high' ELSE 'medium' END AS relevance FROM wn JOIN tn USING (event_id) WHERE rn <= 5 AND trim(title) <> ''""")
def scenario_evidence(spark, sf):
    x = Inputs(spark, sf, topics=FINE)
    return outlook.evidence(x.te, x.scenarios(), fc.moment(x.now - timedelta(days=30)))


def _sections(spark, sf):
    x = Inputs(spark, sf, topics=FINE)
    return outlook.sections(x.te, x.daily, x.volumes, x.counts, x.now)


def _outlook_sql(lifecycles: int, chains: int, scenarios: int, entropy: int, where: tuple[str, str] = ("", "")) -> str:
    one, two = where
    return fine(SCEN + RULE + _posterior_sql()) + f"""(SELECT 'lifecycles' AS section, topic AS topics FROM life {one} ORDER BY topic LIMIT {lifecycles}) UNION ALL
(SELECT 'chains', from_topic || '>' || to_topic FROM ch {two} ORDER BY lift DESC, support DESC, from_topic, to_topic LIMIT {chains}) UNION ALL
(SELECT 'scenarios', topic FROM scen {one} ORDER BY score DESC, topic LIMIT {scenarios}) UNION ALL (SELECT 'entropy', topic FROM eq {one} ORDER BY topic LIMIT {entropy})"""


SHOWN = ["lifecycles", "chains", "scenarios", "entropy"]


@query("outlook_compact", _outlook_sql(15, 15, 10, 15))
def outlook_compact(spark, sf):
    return outlook.listed(outlook.outlook(_sections(spark, sf), "compact", only=SHOWN))


@query("outlook_topics", _outlook_sql(10**9, 10**9, 10**9, 10**9, ("WHERE topic IN ('click.t3', 'view.t7')", "WHERE from_topic IN ('click.t3', 'view.t7') OR to_topic IN ('click.t3', 'view.t7')")))
def outlook_topics(spark, sf):
    return outlook.listed(outlook.outlook(_sections(spark, sf), topics=["click.t3", "view.t7"], only=SHOWN))


@query("outlook_summary", fine(SCEN) + """SELECT 'ranked_chains' AS section, from_topic || '>' || to_topic AS topics FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_topic ORDER BY cross_domain DESC, score DESC, to_topic) AS rn FROM (
 SELECT from_topic, to_topic, """ + half_up("support * source_diversity * lift * confidence * (1 + greatest(0.0, CASE WHEN abs(a1) >= .1 THEN a1 ELSE a7 END)) / (1 + 3 * greatest(0.0, trigger_base_rate - .5))", 2) + """ AS score, split_part(from_topic, '.', 1) <> split_part(to_topic, '.', 1) AS cross_domain
 FROM ch JOIN vols ON topic = from_topic WHERE active)) WHERE rn <= 3 ORDER BY cross_domain DESC, score DESC, from_topic, to_topic LIMIT 50) ORDER BY cross_domain DESC, score DESC, from_topic, to_topic LIMIT (SELECT CASE WHEN count(*) < 3 THEN 10 ELSE 5 END FROM scen)""")
def outlook_summary(spark, sf):
    return outlook.listed(outlook.outlook(_sections(spark, sf), "summary", only=["ranked_chains"]))


@query("outlook_data_quality", QUALITY)
def outlook_data_quality(spark, sf):
    """The section stays whole, though one topic's scenarios alone are asked for."""
    x, ev = Inputs(spark, sf), src.events(spark, sf)
    every = outlook.sections(x.te, x.daily, x.volumes, x.counts, x.now, ev, src.event_topics(spark, sf).where(~F.col("topic").startswith("view.")))
    return outlook.outlook(every, topics=["click.t3"], only=["scenarios"])["data_quality"].rows
