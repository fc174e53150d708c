"""Bursts, time groups, dense days, events, nearest neighbours, blur bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.functions import labels
from lumenloom.operators import events, quantiles, sessions
from lumenloom.plans import fixtures as fx

#: Seconds between the captures of one folder that still make a burst on these tables.
BURST = 3600


def burst_groups(spark, sf_dir):
    return sessions.group_spans(sessions.bursts(fx.captures(spark, sf_dir), BURST))


def burst_analysis(spark, sf_dir):
    return sessions.rank_burst(sessions.bursts(fx.captures(spark, sf_dir), BURST)).select("event_id", "dir", "group_id", "n", "rank", "is_best", "is_worst", "deletable")


def burst_folder_summary(spark, sf_dir):
    return sessions.folder_summary(fx.captures(spark, sf_dir), BURST).orderBy(F.desc("burst_deletable"), F.desc("very_blurry"), "dir")


def time_groups(spark, sf_dir):
    return sessions.group_spans(sessions.gap_groups(fx.captures(spark, sf_dir), 300))


def _days(spark, sf_dir):
    return fx.captures(spark, sf_dir).withColumn("day", F.to_date("ts"))


def dense_day_spans(spark, sf_dir):
    return sessions.dense_day_spans(_days(spark, sf_dir), 4)


def _orders(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dir"), F.to_date("o_orderdate").alias("day"))


def event_window_membership(spark, sf_dir):
    calendar = events.holidays(events.calendar_years(spark, 1990, 2030))
    return events.first_event(_orders(spark, sf_dir), calendar, "id").select("id", "day", "name", "start_date")


def event_plan(spark, sf_dir):
    """Holidays claim first; what they leave is clustered into dense-day events (25 a day, all customers of one nation group together)."""
    rows = _orders(spark, sf_dir).withColumn("dir", F.year("day"))
    calendar = events.holidays(events.calendar_years(spark, 1990, 2030))
    claimed = events.first_event(rows, calendar, "id").groupBy("dir", F.col("name").alias("label")).agg(F.count("*").alias("photos")).withColumn("kind", F.lit("holiday"))
    rest = rows.join(events.membership(rows, calendar).select("id").distinct(), "id", "left_anti")
    spans = sessions.dense_day_spans(rest, 10).select("dir", "label", "photos", F.lit("cluster").alias("kind"))
    return claimed.unionByName(spans)


def context_neighbors(spark, sf_dir):
    rows = fx.captures(spark, sf_dir)
    return sessions.context(rows, labels.is_blurry(F.col("blur"), F.col("edge_density")), 3600).withColumn("interpretation", labels.blur_label(F.col("neighbor_blur"))).drop("neighbor_blur")


def blurry_with_context(spark, sf_dir):
    return sessions.blurry_with_context(fx.captures(spark, sf_dir), 3600, 3600).select("event_id", "dir", "neighbors", "has_sharp_neighbor", "safe_to_delete")


def blur_bands(spark, sf_dir):
    return fx.captures(spark, sf_dir).groupBy(labels.blur_label(F.col("blur")).alias("label")).agg(F.count("*").alias("n"), F.min("blur").alias("least"), F.max("blur").alias("largest"))


def blur_distribution(spark, sf_dir):
    rows = fx.captures(spark, sf_dir)
    found = quantiles.exact_quantiles(rows, "blur", [0.1, 0.25, 0.5, 0.75, 0.9])
    return rows.agg(F.count("blur").alias("n"), F.max("blur").alias("largest")).select("n", *(F.round(F.lit(q).cast("double"), 6).alias(f"p{p}") for q, p in zip(found, (10, 25, 50, 75, 90), strict=True)), "largest")


def threshold_impact(spark, sf_dir):
    marks = (20, 30, 40, 80)
    one = fx.captures(spark, sf_dir).agg(F.count("blur").alias("total"), *(F.count_if(F.col("blur") < m).alias(f"c{m}") for m in marks))
    rows = one.select("total", F.explode(F.array(*(F.struct(F.lit(m).alias("threshold"), F.col(f"c{m}").alias("flagged")) for m in marks))).alias("r"))
    return rows.select("r.threshold", "r.flagged", F.round(F.col("r.flagged") * 100.0 / F.col("total"), 4).alias("percent"))


def texture_filter(spark, sf_dir):
    rows = fx.captures(spark, sf_dir)
    return rows.groupBy("dir").agg(
        F.count_if(labels.is_blurry(F.col("blur"), F.col("edge_density"))).alias("blurry"),
        F.count_if(F.coalesce((F.col("blur") < 40) & labels.low_texture(F.col("edge_density")), F.lit(False))).alias("exempt"),
    )


def streaming_bursts(spark, sf_dir):
    """The bursts of burst_groups as session windows over a stream, run until the files there are read."""
    from lumenloom.streaming import bursts

    return bursts.drain(bursts.sessions(bursts.read_events(spark, sf_dir), BURST), "streaming_bursts")


GROUPS = fx.CAPTURES + """, marked AS (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= {gap}::BIGINT * 1000000 THEN 0 ELSE 1 END AS opens FROM captures WINDOW w AS (PARTITION BY dir ORDER BY ts, event_id)
), numbered AS (SELECT *, sum(opens) OVER (PARTITION BY dir ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS group_id FROM marked
), grouped AS (SELECT *, count(*) OVER (PARTITION BY dir, group_id) AS n FROM numbered
), ranked AS (SELECT *, row_number() OVER (PARTITION BY dir, group_id ORDER BY coalesce(blur, 0) DESC, ts, event_id) AS rank, max(coalesce(blur, 0)) OVER (PARTITION BY dir, group_id) AS best FROM grouped
), decided AS (SELECT *, rank > 1 AND best >= 40 AND coalesce(blur > 0 AND blur < 30, false) AS deletable FROM ranked)"""
_BURSTS = "WITH " + GROUPS.format(gap=BURST)

HOLIDAYS = """years AS (SELECT unnest(range(1990, 2031)) AS y),
thanks AS (SELECT y, make_date(y, 11, 1) + ((4 - isodow(make_date(y, 11, 1)) + 7) % 7 + 21)::INTEGER AS t FROM years),
calendar AS (
  SELECT 'Fourth of July' AS name, 0 AS place, make_date(y, 7, 4) AS a, make_date(y, 7, 4) AS b FROM years UNION ALL
  SELECT 'Halloween', 1, make_date(y, 10, 31), make_date(y, 10, 31) FROM years UNION ALL
  SELECT 'Thanksgiving', 2, t - 2, t + 1 FROM thanks UNION ALL
  SELECT 'Christmas', 3, make_date(y, 12, 24), make_date(y, 12, 25) FROM years),
claimed AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderdate::DATE AS day, name, a AS start_date, place FROM orders JOIN calendar ON o_orderdate::DATE BETWEEN a AND b)"""

SPANS = """dense AS (SELECT dir, day, count(*) AS n FROM {rows} GROUP BY dir, day HAVING count(*) >= {least}),
islands AS (SELECT *, day - (row_number() OVER (PARTITION BY dir ORDER BY day))::INTEGER AS island FROM dense),
spans AS (SELECT dir, min(day) AS start_day, max(day) AS end_day, count(*) AS days, sum(n)::BIGINT AS photos FROM islands GROUP BY dir, island),
named AS (SELECT *, CASE WHEN days = 1 THEN strftime(start_day, '%m-%d') ELSE strftime(start_day, '%m-%d') || '–' || strftime(end_day, '%m-%d') END || ' Event' AS label FROM spans)"""

NEAR = fx.CAPTURES + """, pairs AS (
  SELECT a.event_id, b.event_id AS neighbor_id, b.blur AS neighbor_blur, epoch_us(b.ts) - epoch_us(a.ts) AS us
  FROM captures a JOIN captures b ON a.dir = b.dir AND a.event_id <> b.event_id AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 3600000000::BIGINT
  WHERE a.blur < 40 AND a.edge_density >= 0.02
), nearest AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(us), neighbor_id) AS nearness FROM pairs QUALIFY nearness <= 6)"""

_LABEL = "CASE WHEN {0} >= 150 THEN 'Fully sharp' WHEN {0} >= 80 THEN 'Sharp' WHEN {0} >= 40 THEN 'Decent' WHEN {0} >= 20 THEN 'Soft' WHEN {0} IS NULL THEN 'Unknown' ELSE 'Blurry' END"

QUERIES = {f.__name__: f for f in (burst_groups, burst_analysis, burst_folder_summary, time_groups, dense_day_spans, event_window_membership, event_plan, context_neighbors, blurry_with_context, blur_bands, blur_distribution, threshold_impact, texture_filter, streaming_bursts)}

ORACLES = {
    "burst_groups": _BURSTS + " SELECT dir, group_id, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts FROM grouped WHERE n > 1 GROUP BY dir, group_id",
    "burst_analysis": _BURSTS + " SELECT event_id, dir, group_id, n, rank, rank = 1 AS is_best, rank = n AS is_worst, deletable FROM decided WHERE n > 1",
    "burst_folder_summary": _BURSTS + """ SELECT dir, count(*) AS total, count_if(blur >= 30 AND blur < 40)::BIGINT AS blurry, count_if(blur < 30)::BIGINT AS very_blurry,
      count_if(rank = 1 AND n > 1)::BIGINT AS bursts, count_if(deletable AND n > 1)::BIGINT AS burst_deletable FROM decided GROUP BY dir""",
    "time_groups": "WITH " + GROUPS.format(gap=300) + " SELECT dir, group_id, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts FROM grouped GROUP BY dir, group_id",
    "dense_day_spans": "WITH " + fx.CAPTURES + ", days AS (SELECT *, ts::DATE AS day FROM captures), " + SPANS.format(rows="days", least=4) + " SELECT dir, start_day, end_day, days, photos, label FROM named",
    "event_window_membership": "WITH " + HOLIDAYS + " SELECT id, day, name, start_date FROM claimed QUALIFY row_number() OVER (PARTITION BY id ORDER BY start_date, place, name) = 1",
    "event_plan": "WITH " + HOLIDAYS + """, firsts AS (SELECT * FROM claimed QUALIFY row_number() OVER (PARTITION BY id ORDER BY start_date, place, name) = 1),
      rest AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, year(o_orderdate) AS dir FROM orders WHERE o_orderkey NOT IN (SELECT id FROM claimed)), """ + SPANS.format(rows="rest", least=10) + """
      SELECT year(day)::INTEGER AS dir, name AS label, count(*) AS photos, 'holiday' AS kind FROM firsts GROUP BY ALL UNION ALL SELECT dir::INTEGER, label, photos, 'cluster' FROM named""",
    "context_neighbors": "WITH " + NEAR + " SELECT event_id, neighbor_id, abs(us) / 1000000.0::DOUBLE AS diff_seconds, CASE WHEN us < 0 THEN 'before'"
        " ELSE 'after' END AS position, nearness::INTEGER AS nearness, " + _LABEL.format("neighbor_blur") + " AS interpretation FROM nearest",
    "blurry_with_context": "WITH " + NEAR + """, found AS (SELECT event_id, count(*) AS neighbors, bool_or(coalesce(neighbor_blur >= 40, false)) AS sharp FROM nearest GROUP BY event_id)
      SELECT event_id, dir, coalesce(neighbors, 0) AS neighbors, coalesce(sharp, false) AS has_sharp_neighbor, blur < 30 AND coalesce(sharp, false) AS safe_to_delete
      FROM captures LEFT JOIN found USING (event_id) WHERE blur < 40 AND edge_density >= 0.02""",
    "blur_bands": "WITH " + fx.CAPTURES + " SELECT " + _LABEL.format("blur") + " AS label, count(*) AS n, min(blur) AS least, max(blur) AS largest FROM captures GROUP BY label",
    "blur_distribution": "SELECT count(value) AS n, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{p}" for q, p in ((0.1, 10), (0.25, 25), (0.5, 50), (0.75, 75), (0.9, 90))) + ", max(value) AS largest FROM events",
    "threshold_impact": "SELECT t::INTEGER AS threshold, count_if(value < t)::BIGINT AS flagged, round(count_if(value < t) * 100.0::DOUBLE / count(value), 4) AS percent"
        " FROM events, (VALUES (20), (30), (40), (80)) v(t) GROUP BY t",
    "texture_filter": "WITH " + fx.CAPTURES + " SELECT dir, count_if(blur < 40 AND edge_density >= 0.02)::BIGINT AS blurry, count_if(blur < 40 AND edge_density < 0.02)::BIGINT AS exempt"
        " FROM captures GROUP BY dir",
    "streaming_bursts": _BURSTS + " SELECT dir, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts FROM grouped WHERE n > 1 GROUP BY dir, group_id",
}
