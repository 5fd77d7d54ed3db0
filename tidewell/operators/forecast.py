"""Time-series forecast: lifecycles, chains of spikes, entropy, change points, scenarios and their evaluation.

``te`` is events joined with their topics; ``daily`` is (topic, day, volume, sources), made once by
``daily_volume`` and shared. Per-topic tables are small beside the events; everything before them is one
grouping with partial aggregation.
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions.scalar import acceleration, domain, event_time, half_up, moment, ratio, story
from tidewell.operators.relational import capped_scan, top_n_per_group, upper_median

WINDOWS = (1, 7, 14, 30, 90)
SPIKE = 3

# Mean acceleration per window (1, 7, 14, 30, 90 days) and deviation of each phase.
EMISSIONS = {
    "emerging": ((1.0, 0.5, 0.2, 0.0, -0.1), 0.5),
    "accelerating": ((0.5, 0.5, 0.3, 0.3, 0.2), 0.4),
    "peaking": ((-0.3, 0.3, 0.2, 0.1, 0.1), 0.4),
    "decaying": ((-0.5, -0.3, -0.2, -0.1, 0.0), 0.4),
    "stable": ((0.0, 0.0, 0.0, 0.0, 0.0), 0.15),
}


def daily_volume(te: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Stories and sources per topic and day of event time."""
    rows = te.withColumn("at", event_time()).where(F.col("at") >= moment(as_of - timedelta(days=days)))
    return rows.groupBy("topic", F.to_date("at").alias("day")).agg(F.count_distinct(story()).alias("volume"), F.count_distinct("source").alias("sources"))


def spikes(daily: DataFrame) -> DataFrame:
    return daily.where(F.col("volume") >= SPIKE)


def lifecycle_volumes(te: DataFrame, as_of: datetime) -> DataFrame:
    """Volume and acceleration of each topic over every window, from one scan with conditional counts."""
    rows = te.select("topic", event_time().alias("at"), story().alias("what"))
    since = lambda d: moment(as_of - timedelta(days=d))
    counts = []
    for d in WINDOWS:
        counts += [
            F.count_distinct(F.when(F.col("at") >= since(d), F.col("what"))).alias(f"v{d}"),
            F.count_distinct(F.when((F.col("at") >= since(2 * d)) & (F.col("at") < since(d)), F.col("what"))).alias(f"p{d}"),
        ]
    by = rows.where(F.col("at") >= since(2 * WINDOWS[-1])).groupBy("topic").agg(*counts).where(F.greatest(*[f"v{d}" for d in WINDOWS]) > 0)
    a = [F.when(F.col(f"v{d}") > 0, half_up(acceleration(F.col(f"v{d}"), F.col(f"p{d}")), 2)).otherwise(0.0).alias(f"a{d}") for d in WINDOWS]
    return by.select("topic", *[f"v{d}" for d in WINDOWS], *a)


def rule_phase(volumes: DataFrame) -> DataFrame:
    """Phase by ordered rules, and how far the windows agree in direction."""
    median = volumes.agg(upper_median(volumes, "v30").alias("med"))  # one number a topic
    d1, d7, d30, d90, v30, med = (F.col(c) for c in ("a1", "a7", "a30", "a90", "v30", "med"))
    flat = F.abs(d1) < 0.1
    phase = (
        F.when((d1 > 0.5) & (d7 > 0) & (v30 < med), "emerging").when((d1 > 0) & (d7 > 0) & (d30 > 0), "accelerating")
        .when((d1 < 0) & (d7 > 0), "peaking").when((d1 < 0) & (d7 < 0), "decaying")
        .when((F.abs(d1) < 0.2) & (F.abs(d7) < 0.2) & (F.abs(d30) < 0.2), "stable")
        .when(flat & (d7 > 1) & (d30 > 0) & (v30 < med), "emerging").when(flat & (d7 > 0.2) & (d30 > 0), "accelerating")
        .when(flat & (d7 < -0.1) & (d30 > 0.2), "peaking").when(flat & (d7 < -0.1) & (d30 < -0.1), "decaying").otherwise("stable")
    )
    signs = F.array(d1, d7, d30, d90)
    up, down = F.size(F.filter(signs, lambda x: x > 0.2)), F.size(F.filter(signs, lambda x: x < -0.2))
    sure = half_up(F.greatest(up, down, 4 - up - down) / 4.0, 2)
    return volumes.crossJoin(F.broadcast(median)).withColumn("rule_phase", phase).withColumn("rule_confidence", sure).drop("med")


def phase_posterior(volumes: DataFrame) -> DataFrame:
    """Posterior of each phase under Gaussian emissions and an even prior: columns p_<phase>, hmm_phase, hmm_confidence."""
    x = [F.col(f"a{d}") for d in WINDOWS]
    for phase, (means, sd) in EMISSIONS.items():
        terms = [F.lit(-0.5 * math.log(2 * math.pi) - math.log(sd)) - F.lit(0.5) * F.pow((v - F.lit(m)) / F.lit(sd), F.lit(2.0)) for v, m in zip(x, means, strict=True)]
        volumes = volumes.withColumn(f"l_{phase}", sum(terms[1:], terms[0]))
    names = list(EMISSIONS)
    top = F.greatest(*[f"l_{p}" for p in names])
    total = sum((F.exp(F.col(f"l_{p}") - top) for p in names), F.lit(0.0))
    volumes = volumes.withColumns({f"p_{p}": half_up(F.exp(F.col(f"l_{p}") - top) / total, 3) for p in names})
    best = F.greatest(*[f"p_{p}" for p in names])
    named = F.coalesce(*[F.when(F.col(f"p_{p}") == best, p) for p in names])
    return volumes.withColumn("hmm_phase", named).withColumn("hmm_confidence", best).drop(*[f"l_{p}" for p in names])


def lifecycles(volumes: DataFrame, counts: DataFrame | None = None, data_days: int | None = None) -> DataFrame:
    """Phase of each topic: the posterior's where it is surer by 0.15, else the rules'; guarded while data is young or scarce."""
    rows = phase_posterior(rule_phase(volumes))
    use = F.col("hmm_confidence") > F.col("rule_confidence") + 0.15
    rows = rows.withColumn("phase", F.when(use, F.col("hmm_phase")).otherwise(F.col("rule_phase"))).withColumn("phase_confidence", F.when(use, F.col("hmm_confidence")).otherwise(F.col("rule_confidence")))
    if data_days is not None and data_days < 90:
        rows = rows.withColumn("phase_confidence", F.least("phase_confidence", half_up(F.lit(0.3 + 0.7 * data_days / 90), 2)))
    if counts is not None:
        rows = rows.join(counts.select("topic", F.col("events").alias("_n")), "topic", "left")
        rows = rows.withColumn("phase", F.when(F.coalesce("_n", F.lit(0)) < 50, "insufficient_data").otherwise(F.col("phase"))).drop("_n")
    return rows


def chains(daily: DataFrame, te: DataFrame, volumes: DataFrame, as_of: datetime, lag: int = 7, support: int = 2, cap: int = 500) -> DataFrame:
    """Pairs of topics whose spikes follow each other within ``lag`` days: an equi-join on each lag, not a nested loop."""
    sp = spikes(daily)
    per = sp.groupBy("topic").agg(F.count("*").alias("s"))
    days = sp.agg(F.count_distinct("day").alias("D"))
    shifted = sp.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lag)))).withColumn("to_day", F.date_add("day", F.col("lag")))
    a, b = shifted.alias("a"), sp.alias("b")
    pairs = a.join(b, (F.col("a.to_day") == F.col("b.day")) & (F.col("a.topic") != F.col("b.topic")))
    week = lambda c: F.avg(F.when(F.weekday(c) < 5, 1.0).otherwise(0.0))
    rows = pairs.groupBy(F.col("a.topic").alias("from_topic"), F.col("b.topic").alias("to_topic")).agg(
        F.count("*").alias("support"), F.avg("a.lag").alias("avg_lag"), F.sum("a.lag").alias("lag_1"), F.sum(F.col("a.lag") * F.col("a.lag")).alias("lag_2"),
        F.avg(F.least("a.sources", "b.sources")).alias("min_sources"), F.max("b.day").alias("last_day"), week("a.day").alias("wa"), week("b.day").alias("wb"),
    ).where(F.col("support") >= support)
    sa, sb = per.select(F.col("topic").alias("from_topic"), F.col("s").alias("sa")), per.select(F.col("topic").alias("to_topic"), F.col("s").alias("sb"))
    rows = rows.join(sa, "from_topic").join(sb, "to_topic").crossJoin(F.broadcast(days))
    n = F.col("support")
    rows = rows.withColumn("lift", n * F.col("D") / (F.col("sa") * F.col("sb")))
    rows = rows.orderBy(F.desc("lift"), F.desc("support"), "from_topic", "to_topic").limit(cap)
    now = active_topics(te, volumes, as_of)
    rows = rows.join(now.select(F.col("topic").alias("from_topic"), F.lit(True).alias("active")), "from_topic", "left")
    age = F.greatest(F.lit(0.0), (F.lit((as_of - datetime(1970, 1, 1)).total_seconds()) - F.unix_date("last_day") * 86400.0) / 86400.0)
    spread = F.greatest(F.lit(0.0), F.col("lag_2") / n - F.pow(F.col("lag_1") / n, F.lit(2.0)))
    rows = rows.select(
        "from_topic", "to_topic", "support", half_up(F.col("avg_lag"), 1).alias("avg_lag_days"), half_up(F.sqrt(spread), 2).alias("lag_stddev"),
        half_up(ratio(F.col("min_sources"), F.max("min_sources").over(Window.partitionBy())), 2).alias("source_diversity"), F.coalesce("active", F.lit(False)).alias("active"),
        half_up(F.col("lift"), 2).alias("lift"), half_up(F.least(F.lit(1.0), n / F.col("sa")), 2).alias("confidence"), half_up(n * F.exp(F.lit(-math.log(2) / 14) * age), 2).alias("decay_weighted_support"),
        half_up(F.col("sa") / F.col("D"), 2).alias("trigger_base_rate"), half_up((F.col("wa") + F.col("wb")) / 2, 2).alias("weekday_ratio"), ((F.col("wa") > 0.75) & (F.col("wb") > 0.75)).alias("weekday_correlated"),
    )
    back = rows.select(F.col("to_topic").alias("from_topic"), F.col("from_topic").alias("to_topic"), F.col("support").alias("reverse"))
    rows = rows.join(back, ["from_topic", "to_topic"], "left")
    return rows.withColumn("directionality", F.when(F.col("reverse").isNull(), 1.0).otherwise(half_up(n / (n + F.col("reverse")), 2))).drop("reverse")


def active_topics(te: DataFrame, volumes: DataFrame, as_of: datetime) -> DataFrame:
    recent = te.where(event_time() >= moment(as_of - timedelta(days=1))).groupBy("topic").agg(F.count_distinct(story()).alias("v")).where(F.col("v") >= SPIKE).select("topic")
    return recent.union(volumes.where("a7 > 1").select("topic")).distinct()


def tiers(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Confidence tier of each chain by the smaller topic's volume, diversity and support."""
    a, b = counts.select(F.col("topic").alias("from_topic"), F.col("events").alias("_a")), counts.select(F.col("topic").alias("to_topic"), F.col("events").alias("_b"))
    rows = found.join(a, "from_topic", "left").join(b, "to_topic", "left")
    least = F.least(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0)))
    d, s = F.col("source_diversity"), F.col("support")
    tier = F.when(least < 50, "spurious").when((least >= 500) & (d >= 0.6) & (s >= 30), "high").when((least >= 100) & (d >= 0.5) & (s >= 10), "moderate").otherwise("low")
    return rows.withColumn("confidence_tier", tier).drop("_a", "_b")


def transitive_chains(found: DataFrame, per_prefix: int = 3, total: int = 100) -> DataFrame:
    """A to B to C from two chains; no way back to A."""
    x, y = found.alias("x"), found.alias("y")
    rows = x.join(y, (F.col("x.to_topic") == F.col("y.from_topic")) & (F.col("y.to_topic") != F.col("x.from_topic")))
    rows = rows.select(
        F.col("x.from_topic").alias("a"), F.col("x.to_topic").alias("b"), F.col("y.to_topic").alias("c"), half_up(F.col("x.avg_lag_days") + F.col("y.avg_lag_days"), 1).alias("total_lag_days"),
        F.least("x.support", "y.support").alias("min_support"), half_up(F.col("x.lift") * F.col("y.lift"), 2).alias("combined_lift"),
        (domain(F.col("x.from_topic")) != domain(F.col("y.to_topic"))).alias("cross_domain"), half_up(F.sqrt(F.col("x.confidence") * F.col("y.confidence")), 2).alias("normalized_confidence"),
    )
    return capped_scan(rows, ["a", "b"], [F.desc("combined_lift"), F.asc("a"), F.asc("b"), F.asc("c")], per_prefix, total)


def multiscale(volumes: DataFrame) -> DataFrame:
    short = F.when(F.abs("a1") < 0.1, F.col("a7")).otherwise(F.col("a1"))
    long = F.when(F.abs("a90") >= 0.05, F.col("a90")).otherwise(F.col("a30"))
    s, m, g = F.col("short"), F.col("a7"), F.col("long")
    kind = (
        F.when((s > 0) & (m > 0) & (g > 0), "aligned_up").when((s < 0) & (m < 0) & (g < 0), "aligned_down")
        .when(s * g < 0, "diverging").when(s * m < 0, "transitioning").otherwise("aligned_down")
    )
    return volumes.select("topic", short.alias("short"), "a7", long.alias("long")).select("topic", "short", F.col("a7").alias("medium"), "long", kind.alias("alignment"))


def ranked_chains(found: DataFrame, volumes: DataFrame, per_trigger: int = 3, total: int = 50) -> DataFrame:
    """Active chains by strength and the trigger's growth; those across domains first."""
    grow = volumes.select(F.col("topic").alias("from_topic"), F.when(F.abs("a1") >= 0.1, F.col("a1")).otherwise(F.col("a7")).alias("_acc"))
    rows = found.where("active").join(grow, "from_topic", "left")
    score = F.col("support") * F.col("source_diversity") * F.col("lift") * F.col("confidence") * (1 + F.greatest(F.lit(0.0), F.coalesce("_acc", F.lit(0.0))))
    score = score / (1 + 3 * F.greatest(F.lit(0.0), F.col("trigger_base_rate") - 0.5))
    cross = domain(F.col("from_topic")) != domain(F.col("to_topic"))
    rows = rows.select("from_topic", "to_topic", half_up(score, 2).alias("score"), cross.alias("cross_domain"))
    return capped_scan(rows, ["from_topic"], [F.desc("cross_domain"), F.desc("score"), F.asc("from_topic"), F.asc("to_topic")], per_trigger, total)


def entropy(daily: DataFrame) -> DataFrame:
    """Evenness of a topic's volume over its active days."""
    p = F.col("volume") / F.sum("volume").over(Window.partitionBy("topic"))
    by = daily.select("topic", (-p * F.log2(p)).alias("h")).groupBy("topic").agg(F.sum("h").alias("h"), F.count("*").alias("active_days"))
    most = F.when(F.col("active_days") > 1, F.log2(F.col("active_days").cast("double"))).otherwise(1.0)
    return by.select("topic", half_up(F.col("h"), 3).alias("entropy"), half_up(F.col("h") / most, 2).alias("normalized_entropy"), "active_days")


def cusum(daily: DataFrame, as_of: datetime) -> DataFrame:
    """Change points of each topic: a two-sided cumulative sum over active days, folded inside one array per topic."""
    by = daily.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("day", F.col("volume").cast("double").alias("v")))).alias("xs"), F.avg("volume").alias("mu"), F.stddev_pop("volume").alias("sd"), F.count("*").alias("n"))
    by = by.where((F.col("n") >= 3) & (F.col("sd") >= 0.01))
    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("dn"), F.array().cast("array<date>").alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        up = F.greatest(F.lit(0.0), acc["up"] + (x["v"] - F.col("mu")) - F.col("sd") * 0.5)
        dn = F.greatest(F.lit(0.0), acc["dn"] - (x["v"] - F.col("mu")) - F.col("sd") * 0.5)
        hit = (up > F.col("sd") * 4.0) | (dn > F.col("sd") * 4.0)
        return F.struct(F.when(hit, 0.0).otherwise(up).alias("up"), F.when(hit, 0.0).otherwise(dn).alias("dn"), F.when(hit, F.concat(acc["hits"], F.array(x["day"]))).otherwise(acc["hits"]).alias("hits"))

    now = (as_of - datetime(1970, 1, 1)).total_seconds() / 86400.0
    rows = by.select("topic", F.explode(F.aggregate("xs", zero, step)["hits"]).alias("day"))
    return rows.select("topic", "day", half_up(F.lit(now) - F.unix_date("day"), 0).cast("long").alias("days_ago"))


def base_rates(daily: DataFrame) -> DataFrame:
    """Share of days with any event on which a topic spiked."""
    days = daily.agg(F.count_distinct("day").alias("D"))
    by = spikes(daily).groupBy("topic").agg(F.count("*").alias("s"))
    return by.crossJoin(F.broadcast(days)).select("topic", (F.col("s") / F.col("D")).alias("base_rate"))


def scenarios(found: DataFrame, rates: DataFrame, changes: DataFrame, evenness: DataFrame, temperature: float = 0.5, per_target: int = 5) -> DataFrame:
    """Topics likely to spike next: each target's prior times the signals of its active chains, softened over all targets. ``found`` has tiers."""
    act = found.where(F.col("active") & (F.col("lift") >= 1.5))
    fan = act.groupBy("from_topic").agg(F.count("*").alias("fan"))
    last = changes.groupBy("topic").agg(F.min("days_ago").alias("cp"))
    rows = act.join(fan, "from_topic").join(last.select(F.col("topic").alias("from_topic"), F.col("cp").alias("cpa")), "from_topic", "left").join(last.select(F.col("topic").alias("to_topic"), F.col("cp").alias("cpb")), "to_topic", "left")
    cp = F.least("cpa", "cpb")
    discount = F.when(cp < 7, 0.5 + 0.5 * (cp / 7.0)).otherwise(1.0)
    signal = F.col("lift") * (F.col("decay_weighted_support") / F.col("support")) * discount * F.sqrt(F.greatest("confidence", F.lit(0.01))) * F.sqrt(F.greatest("source_diversity", F.lit(0.01))) / F.log2(1.0 + F.col("fan"))
    sd, lag = F.col("lag_stddev"), F.col("avg_lag_days")
    rows = rows.select("to_topic", "from_topic", signal.alias("signal"), F.greatest(F.lit(0.0), lag - 2 * sd).alias("lo"), (lag + 2 * sd).alias("hi"), "confidence_tier")
    rows = top_n_per_group(rows, ["to_topic"], [F.desc("signal"), F.asc("from_topic")], per_target)
    code = F.when(F.col("confidence_tier") == "high", 3).when(F.col("confidence_tier") == "moderate", 2).when(F.col("confidence_tier") == "low", 1).otherwise(0)
    by = rows.groupBy(F.col("to_topic").alias("topic")).agg(F.sum(F.log(F.greatest("signal", F.lit(1.01)))).alias("gain"), F.count("*").alias("chains"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(code).alias("worst"), F.max(code).alias("best"))
    by = by.join(rates, "topic", "left").join(evenness.select("topic", "normalized_entropy"), "topic", "left")
    by = by.withColumn("lp", (F.log(F.coalesce("base_rate", F.lit(0.05))) + F.col("gain")) / temperature)
    all_ = Window.partitionBy()  # one row a target
    by = by.withColumn("e", F.exp(F.col("lp") - F.max("lp").over(all_)))
    by = by.withColumn("score", half_up(F.col("e") / F.sum("e").over(all_), 3))
    half = (F.col("hi") - F.col("lo")) / 2 * (1 + F.coalesce("normalized_entropy", F.lit(0.0)))
    middle = (F.col("hi") + F.col("lo")) / 2
    kept = by.where((F.col("best") > 1) & ~((F.coalesce("base_rate", F.lit(0.05)) > 0.8) & (F.col("best") < 3)))
    return kept.select("topic", "score", "chains", half_up(F.greatest(F.lit(0.0), middle - half), 1).alias("from_days"), half_up(middle + half, 1).alias("to_days"), half_up(F.coalesce("base_rate", F.lit(0.05)), 3).alias("base_rate"), "worst")


def reinforcing_loops(found: DataFrame, cap: int = 10) -> DataFrame:
    x, y = found.alias("x"), found.alias("y")
    rows = x.join(y, (F.col("x.from_topic") == F.col("y.to_topic")) & (F.col("x.to_topic") == F.col("y.from_topic")) & (F.col("x.from_topic") < F.col("x.to_topic")))
    rows = rows.where(F.col("x.directionality").between(0.3, 0.7) & (F.col("x.lift") > 1) & (F.col("y.lift") > 1))
    rows = rows.select(F.col("x.from_topic").alias("topic_a"), F.col("x.to_topic").alias("topic_b"), F.col("x.directionality").alias("directionality"), half_up(F.least("x.lift", "y.lift"), 2).alias("mutual_lift"))
    return rows.orderBy(F.desc("mutual_lift"), "topic_a", "topic_b").limit(cap)


def delays(found: DataFrame, cap: int = 10) -> DataFrame:
    rows = found.where(F.col("active") & (F.col("avg_lag_days") >= 0.5)).select("from_topic", "to_topic", "avg_lag_days", "lag_stddev")
    return rows.orderBy("lag_stddev", "from_topic", "to_topic").limit(cap)


def accumulations(life: DataFrame, scales: DataFrame, evenness: DataFrame, fresh: DataFrame, cap: int = 10) -> DataFrame:
    rows = life.where(F.col("phase").isin("emerging", "accelerating")).join(fresh, "topic", "left_semi").join(scales.where("alignment = 'aligned_up'").select("topic"), "topic").join(evenness.where("normalized_entropy > 0.5"), "topic")
    return rows.select("topic", "phase", "normalized_entropy").orderBy(F.desc("normalized_entropy"), "topic").limit(cap)


def dampening(life: DataFrame, changes: DataFrame, within: int = 14, cap: int = 10) -> DataFrame:
    last = changes.where(F.col("days_ago") <= within).groupBy("topic").agg(F.min("days_ago").alias("days_ago"))
    return life.where("phase = 'decaying'").join(last, "topic").select("topic", "days_ago").orderBy("days_ago", "topic").limit(cap)


def fresh_topics(te: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return te.where(F.col("published_at") >= moment(as_of - timedelta(days=days))).select("topic").distinct()


def data_quality(ev: DataFrame, et: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    inside = ev.where(F.col("fetched_at") >= moment(as_of - timedelta(days=days)))
    none = inside.join(et, "event_id", "left_anti").agg(F.count("*").alias("none"))
    top = inside.groupBy("source").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "source").limit(1)
    total = inside.agg(F.count("*").alias("events_analyzed"))
    return total.crossJoin(none).crossJoin(top).select("events_analyzed", half_up(ratio(F.col("none"), F.col("events_analyzed")) * 100, 1).alias("unclassified_pct"), F.col("source").alias("top_source"), half_up(ratio(F.col("c"), F.col("events_analyzed")) * 100, 1).alias("top_source_pct"))


def context_titles(te: DataFrame, found: DataFrame, changes: DataFrame, as_of: datetime, n: int = 3) -> DataFrame:
    """Best titles of each topic in the last day, and around its last change point where that is over three days old, without repeating any."""
    best = [F.desc("score"), F.desc("fetched_at"), F.asc("event_id")]
    at = event_time()
    now = top_n_per_group(te.join(found, "topic", "left_semi").where(at >= moment(as_of - timedelta(days=1))), ["topic"], best, n).groupBy("topic").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    last = changes.groupBy("topic").agg(F.max("day").alias("cp"), F.min("days_ago").alias("age")).where("age > 3")
    near = te.join(found, "topic", "left_semi").join(last, "topic").where(F.abs(F.datediff(F.to_date(at), "cp")) <= 2)
    then = top_n_per_group(near, ["topic"], best, n).groupBy("topic").agg(F.array_sort(F.collect_list("title")).alias("around"))
    rows = now.join(then, "topic", "full")
    empty = F.array().cast("array<string>")
    return rows.select("topic", F.coalesce("titles", empty).alias("titles"), F.array_except(F.coalesce("around", empty), F.coalesce("titles", empty)).alias("break_titles"))


def snapshot(found: DataFrame, snapshot_id: int, created_at: datetime, top: int = 10) -> DataFrame:
    """Scenarios as saved for later evaluation."""
    best = found.orderBy(F.desc("score"), "topic").limit(top)
    return best.select(F.lit(snapshot_id).cast("long").alias("snapshot_id"), moment(created_at).alias("created_at"), "topic", F.col("score").alias("predicted_probability"), "from_days", "to_days", "base_rate")


def evaluate(saved: DataFrame, te: DataFrame, as_of: datetime) -> DataFrame:
    """Outcome and Brier score of each due prediction: did the topic spike on any day of its window?"""
    due = saved.where(F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("to_days") * 86400) <= moment(as_of))
    first, last = F.date_add(F.to_date("created_at"), F.floor("from_days").cast("int")), F.date_add(F.to_date("created_at"), F.ceil("to_days").cast("int"))
    daily = te.groupBy("topic", F.to_date(event_time()).alias("day")).agg(F.count("*").alias("n")).where(F.col("n") >= SPIKE)
    hit = due.withColumn("day", F.explode(F.sequence(first, last))).join(daily, ["topic", "day"], "left_semi").select("snapshot_id", "topic").distinct().withColumn("hit", F.lit(1))
    rows = due.join(hit, ["snapshot_id", "topic"], "left")
    o = F.coalesce("hit", F.lit(0))
    p, b = F.col("predicted_probability"), F.col("base_rate")
    return rows.select("snapshot_id", "topic", "predicted_probability", o.alias("outcome"), half_up((p - o) * (p - o), 6).alias("brier_score"), half_up(b * (1 - b) * (1 - b) + (1 - b) * b * b, 6).alias("brier_ref"))


def learned_weights(outcomes: DataFrame, least: int = 5) -> DataFrame:
    """Weight of a topic by its mean skill over five outcomes or more."""
    skill = F.when(F.col("brier_ref") > 0, 1 - F.col("brier_score") / F.col("brier_ref"))
    by = outcomes.groupBy("topic").agg(F.count("*").alias("n"), F.avg(skill).alias("skill"), F.avg("brier_score").alias("brier"), F.sum(F.when(F.col("outcome") == 1, 1).otherwise(0)).alias("true_positives"), F.sum(F.when(F.col("outcome") == 0, 1).otherwise(0)).alias("false_positives"))
    weight = F.when(F.col("skill").isNotNull(), 0.5 + 0.5 * F.greatest(F.lit(0.0), F.col("skill"))).otherwise(0.5 + 0.5 * (1 - F.col("brier")))
    return by.where(F.col("n") >= least).select("topic", half_up(weight, 3).alias("weight"), "true_positives", "false_positives")
