"""Queries of the series and event operators over the domain tables, with SQL for those it can state.

Floating-point results are rounded on both sides, since engines add in different orders. Values of coarse
resolution often lie exactly between two rounded ones, where the last bit decides; a small shift, the same
on both sides, moves them off.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom import workflow
from eventloom.operators import aggregates as ag
from eventloom.operators import detection, events, features, joins, merge, metrics, series
from eventloom.runtime import Stages, table
from eventloom.sources import synthetic
from eventloom.sources import text as text_source
from eventloom.streaming import events as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CLIP = 10
WITH = {
    "series": "series AS (SELECT DISTINCT recording_id, channel, t, value FROM timeseries WHERE value IS NOT NULL AND isfinite(value))",
    "size": "size AS (SELECT recording_id, max(t) + 1 AS n FROM series GROUP BY recording_id)",
    "fire": "fire AS (SELECT DISTINCT event_id, recording_id, channel, time, coalesce(label, 0) AS label, coalesce(amplitude, 0.0) AS amplitude, coalesce(outlier_score, 0.0) AS outlier_score, coalesce(detectability_score, 0.0) AS detectability_score FROM firings WHERE time IS NOT NULL)",
    "fire2": "fire2 AS (SELECT DISTINCT event_id, recording_id, channel, time, coalesce(label, 0) AS label, coalesce(amplitude, 0.0) AS amplitude FROM detail_firings WHERE time IS NOT NULL)",
    "clips": f"""clips0 AS (SELECT f.event_id, f.recording_id, c.channel, d.dt, CAST(trunc(f.time) AS BIGINT) - 4 + d.dt AS t, CAST(trunc(f.time) AS BIGINT) >= 4 AND CAST(trunc(f.time) AS BIGINT) - 4 + {CLIP} <= s.n AS inside
      FROM fire f JOIN size s USING (recording_id) JOIN (SELECT DISTINCT recording_id, channel FROM series) c USING (recording_id) CROSS JOIN (SELECT CAST(unnest(range({CLIP})) AS INTEGER) AS dt) d),
    clip AS (SELECT k.recording_id, k.event_id, k.channel, k.dt, CASE WHEN k.inside THEN coalesce(s.value, 0.0) ELSE 0.0 END AS value FROM clips0 k LEFT JOIN series s ON s.recording_id = k.recording_id AND s.channel = k.channel AND s.t = k.t)""",
    "templates": f"""places AS (SELECT f.recording_id, f.label, d.dt, CAST(floor(f.time + 0.5) AS BIGINT) - 4 + d.dt AS t FROM fire f CROSS JOIN (SELECT CAST(unnest(range({CLIP})) AS INTEGER) AS dt) d WHERE f.label > 0),
    sums AS (SELECT p.recording_id, p.label, s.channel, p.dt, sum(s.value) AS s, sum(s.value * s.value) AS ss FROM places p JOIN series s USING (recording_id, t) GROUP BY ALL),
    grid AS (SELECT n.recording_id, n.label, c.channel, d.dt, n.n FROM (SELECT recording_id, label, count(*) AS n FROM fire WHERE label > 0 GROUP BY ALL) n JOIN (SELECT DISTINCT recording_id, channel FROM series) c USING (recording_id) CROSS JOIN (SELECT CAST(unnest(range({CLIP})) AS INTEGER) AS dt) d),
    templates AS (SELECT g.recording_id, g.label, g.channel, g.dt, g.n, coalesce(u.s, 0.0) / g.n AS mean, CASE WHEN g.n >= 2 THEN sqrt(greatest(coalesce(u.ss, 0.0) / g.n - (coalesce(u.s, 0.0) / g.n) * (coalesce(u.s, 0.0) / g.n), 0.0)) ELSE 0.0 END AS stdev
      FROM grid g LEFT JOIN sums u USING (recording_id, label, channel, dt))""",
    "tallies": "t1 AS (SELECT recording_id, label, CAST(trunc(time) AS BIGINT) AS t, count(*) AS c FROM fire WHERE label > 0 GROUP BY ALL)",
    "lags": "lags AS (SELECT recording_id, label1, label2, dt, CAST(sum(n) AS BIGINT) AS n FROM (SELECT a.recording_id, a.label AS label1, b.label AS label2, a.t - b.t AS dt, a.c * (b.c - CASE WHEN a.label = b.label AND a.t = b.t THEN 1 ELSE 0 END) AS n FROM t1 a JOIN t1 b ON a.recording_id = b.recording_id AND abs(a.t - b.t) <= 10) GROUP BY ALL HAVING sum(n) > 0)",
}


def query(*needs: str, sql: str | None = None):
    """Registers a query; its SQL follows the named common table expressions."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {', '.join(WITH[n] for n in needs)} " if needs else "") + sql
        return f

    return add


def shift(digits: int) -> float:
    return 0.33172843 * 10**-digits


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + F.lit(shift(digits)), digits) for n in names})


def shifted(sql: str) -> str:
    """SQL with the shift inside every outermost ``round(..., d) + 0.0``."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner, _, digits = sql[at + 6 : end - 1].rpartition(", ")
        if sql[end:].startswith(" + 0.0"):
            new = f"round(({inner}) + {shift(int(digits)):.17g}, {digits})"
            sql = sql[:at] + new + sql[end + 6 :]
            at += len(new)
        else:
            at += 6
    return sql


def load(spark: SparkSession, folder: str) -> DataFrame:
    return series.readings(table(spark, folder, "timeseries"))


def fire(spark: SparkSession, folder: str, name: str = "firings") -> DataFrame:
    return events.firings_view(table(spark, folder, name))


def templates(spark: SparkSession, folder: str) -> DataFrame:
    return ag.compute_templates(load(spark, folder), fire(spark, folder), CLIP)


def clips(spark: SparkSession, folder: str) -> DataFrame:
    return joins.extract_clips(load(spark, folder), fire(spark, folder), CLIP)


def as_long(c: str) -> Column:
    return F.col(c).cast("bigint")


# --- series ------------------------------------------------------------------------------------------------


@query("series", sql="SELECT s.recording_id, p.pos AS channel, s.t - 99 AS t, s.value FROM series s JOIN (VALUES (1, 2), (2, 1), (3, 2)) p(pos, ch) ON s.channel = p.ch WHERE s.t BETWEEN 99 AND 599")
def extract_raw(spark, folder):
    return series.extract_raw(load(spark, folder), 100, 600, [2, 1, 2])


@query("series", sql="SELECT c.recording_id, c.channel, g.t, coalesce(s.value, 0.0) AS value FROM (SELECT DISTINCT recording_id, channel FROM series) c CROSS JOIN (SELECT unnest(range(990, 1090)) AS t) g LEFT JOIN series s ON s.recording_id = c.recording_id AND s.channel = c.channel AND s.t = g.t")
def read_chunk(spark, folder):
    return series.read_chunk(load(spark, folder), 990, 100)


@query("series", sql="SELECT recording_id, CAST(t + 1 AS INTEGER) AS channel, CAST(channel - 1 AS BIGINT) AS t, value FROM series")
def transpose(spark, folder):
    return series.transpose(load(spark, folder))


@query("series", sql="SELECT recording_id, CAST((channel - 1 + t * 4) % 2 + 1 AS INTEGER) AS channel, (channel - 1 + t * 4) // 2 AS t, value FROM series")
def reshape(spark, folder):
    return series.reshape(load(spark, folder), 4, 2)


@query("series", sql="SELECT recording_id, min(value) AS vmin, max(value) AS vmax FROM series GROUP BY recording_id")
def value_range(spark, folder):
    return series.value_range(load(spark, folder))


@query("series", sql="SELECT s.recording_id, s.channel, s.t, round(s.value / d.d, 6) + 0.0 AS value FROM series s JOIN (SELECT recording_id, channel, CASE WHEN count(*) < 2 OR sum(value * value) = 0 THEN 1.0 ELSE sqrt(sum(value * value) / (count(*) - 1)) END AS d FROM series GROUP BY ALL) d USING (recording_id, channel)")
def normalize_channels(spark, folder):
    return rounded(series.normalize_channels(load(spark, folder)), 6, "value")


@query("series", sql="SELECT s.recording_id, s.channel, s.t, round(s.value / CASE WHEN d.d = 0 THEN 1.0 ELSE d.d END, 6) + 0.0 AS value FROM series s JOIN (SELECT recording_id, channel, stddev_pop(value) AS d FROM series GROUP BY ALL) d USING (recording_id, channel)")
def normalize_channels_std(spark, folder):
    return rounded(series.normalize_channels_std(load(spark, folder)), 6, "value")


@query("series", sql="""SELECT c.recording_id, c.channel, c.t, round(c.value / CASE WHEN coalesce(e.d, 0) = 0 THEN 1.0 ELSE e.d END, 6) + 0.0 AS value FROM once c JOIN (SELECT recording_id, channel, stddev_samp(value) AS d FROM once GROUP BY ALL) e USING (recording_id, channel)""")
def normalize_channels_clamped(spark, folder):
    return rounded(series.normalize_channels_clamped(load(spark, folder)), 6, "value")


SQL["normalize_channels_clamped"] = SQL["normalize_channels_clamped"].replace(" SELECT c.recording_id", ", once AS (SELECT s.recording_id, s.channel, s.t, greatest(least(s.value / CASE WHEN coalesce(d.d, 0) = 0 THEN 1.0 ELSE d.d END, 20.0), -20.0) AS value FROM series s JOIN (SELECT recording_id, channel, stddev_samp(value) AS d FROM series GROUP BY ALL) d USING (recording_id, channel)) SELECT c.recording_id", 1)


@query("series", sql="SELECT a.recording_id, a.channel AS channel1, b.channel AS channel2, round(sum(a.value * b.value) / greatest(count(*) - 1, 1), 3) + 0.0 AS value FROM series a JOIN series b USING (recording_id, t) GROUP BY a.recording_id, a.channel, b.channel")
def channel_covariance(spark, folder):
    return rounded(series.covariance(load(spark, folder)), 3, "value")


@query(
    "series", "size",
    sql="""SELECT s.recording_id, s.channel, s.t, CASE WHEN coalesce(b.bad, TRUE) THEN 0.0 ELSE s.value END AS value FROM series s LEFT JOIN bad b ON b.recording_id = s.recording_id AND b.channel = s.channel AND b.interval = s.t // 50""",
)
def mask_out_artifacts(spark, folder):
    return series.mask_out_artifacts(load(spark, folder), 2.5, 50)


SQL["mask_out_artifacts"] = SQL["mask_out_artifacts"].replace(
    " SELECT s.recording_id, s.channel",
    """, norm AS (SELECT s.recording_id, s.channel, s.t // 50 AS interval, sqrt(sum(s.value * s.value)) AS norm FROM series s JOIN size z USING (recording_id) WHERE s.t // 50 < z.n // 50 GROUP BY ALL),
    high AS (SELECT n.*, n.norm > a.m * (1 + 1e-9) + 2.5 * a.sd AS high FROM norm n JOIN (SELECT recording_id, channel, avg(norm) AS m, coalesce(stddev_samp(norm), 0) AS sd FROM norm GROUP BY ALL) a USING (recording_id, channel)),
    bad AS (SELECT h.recording_id, h.channel, h.interval, h.high OR EXISTS (SELECT 1 FROM high o WHERE o.recording_id = h.recording_id AND o.channel = h.channel AND abs(o.interval - h.interval) = 1 AND o.high) AS bad FROM high h)
    SELECT s.recording_id, s.channel""", 1,
)


@query("series", sql="SELECT s.recording_id, s.channel, s.t, CAST(trunc(s.value * (32767.0 / CASE WHEN m.m = 0 THEN 1.0 ELSE m.m END)) AS BIGINT) AS value FROM series s JOIN (SELECT recording_id, max(abs(value)) AS m FROM series GROUP BY ALL) m USING (recording_id)")
def quantize_int16(spark, folder):
    return series.quantize(load(spark, folder), "int16")


@query("series", sql="SELECT s.recording_id, s.channel, s.t, CAST(trunc(greatest(s.value * (255.0 / CASE WHEN m.m = 0 THEN 1.0 ELSE m.m END), 0.0)) AS BIGINT) AS value FROM series s JOIN (SELECT recording_id, max(abs(value)) AS m FROM series GROUP BY ALL) m USING (recording_id)")
def quantize_uint8(spark, folder):
    return series.quantize(load(spark, folder), "uint8")


@query("series", sql="SELECT s.recording_id, s.channel, s.t, round(m.a + CASE WHEN m.b = m.a THEN 0 ELSE floor((s.value - m.a) / (m.b - m.a) * 255) END / 255.0 * (m.b - m.a), 6) + 0.0 AS value FROM series s JOIN (SELECT recording_id, min(value) AS a, max(value) AS b FROM series GROUP BY ALL) m USING (recording_id)")
def quantize8_roundtrip(spark, folder):
    return rounded(series.unquantize8(series.quantize8(load(spark, folder))), 6, "value")


@query(
    "series", "size",
    sql="""SELECT CAST(l.f AS BIGINT) AS ds_factor, b.recording_id, b.channel, b.bin, b.vmin, b.vmax FROM levels l JOIN blocks b ON b.f = l.f AND b.recording_id = l.recording_id""",
)
def create_multiscale(spark, folder):
    return series.multiscale(load(spark, folder))


SQL["create_multiscale"] = SQL["create_multiscale"].replace(
    " SELECT CAST(l.f AS BIGINT)",
    """, powers AS (SELECT CAST(pow(3, unnest(range(1, 20))) AS BIGINT) AS f), levels AS (SELECT z.recording_id, p.f FROM size z JOIN powers p ON p.f = 3 OR p.f < z.n * 3),
    blocks AS (SELECT p.f, s.recording_id, s.channel, s.t // p.f AS bin, CASE WHEN count(*) < p.f THEN least(min(s.value), 0.0) ELSE min(s.value) END AS vmin, CASE WHEN count(*) < p.f THEN greatest(max(s.value), 0.0) ELSE max(s.value) END AS vmax FROM series s CROSS JOIN powers p GROUP BY p.f, s.recording_id, s.channel, s.t // p.f) SELECT CAST(l.f AS BIGINT)""", 1,
)


@query("series", "size", sql="SELECT c.recording_id, c.channel, g.bin, CASE WHEN g.bin >= 0 AND g.bin < z.n // 9 THEN coalesce(b.vmin, 0.0) ELSE 0.0 END AS vmin, CASE WHEN g.bin >= 0 AND g.bin < z.n // 9 THEN coalesce(b.vmax, 0.0) ELSE 0.0 END AS vmax FROM (SELECT DISTINCT recording_id, channel FROM series) c JOIN size z USING (recording_id) CROSS JOIN (SELECT unnest(range(-5, 2001)) AS bin) g LEFT JOIN (SELECT recording_id, channel, t // 9 AS bin, CASE WHEN count(*) < 9 THEN least(min(value), 0.0) ELSE min(value) END AS vmin, CASE WHEN count(*) < 9 THEN greatest(max(value), 0.0) ELSE max(value) END AS vmax FROM series GROUP BY ALL) b ON b.recording_id = c.recording_id AND b.channel = c.channel AND b.bin = g.bin")
def read_multiscale(spark, folder):
    s = load(spark, folder)
    return series.read_multiscale(series.multiscale(s), s, -5, 2000, 9)


@query("series", sql="SELECT recording_id, channel, t, value FROM series WHERE NOT EXISTS (SELECT 1 FROM series p WHERE p.recording_id = series.recording_id AND p.channel = series.channel AND p.t = series.t - 500 AND p.t < 100) UNION ALL SELECT recording_id, channel, t + 500 AS t, value FROM series WHERE t < 100")
def write_chunk(spark, folder):
    s = load(spark, folder)
    return series.write_chunk(s, s.where("t < 100"), 500)


@query("fire", sql="SELECT event_id, CASE WHEN amplitude = 0 THEN 0.0 ELSE round(round(amplitude / pow(10.0, floor(log10(abs(amplitude))) - 1)) * pow(10.0, floor(log10(abs(amplitude))) - 1), 9) END AS label_text FROM fire WHERE amplitude = 0 OR abs(abs(amplitude / pow(10.0, floor(log10(abs(amplitude))) - 1)) % 1 - 0.5) > 1e-9")
def significant_figures(spark, folder):
    """Amplitudes at two significant figures; those exactly between two are left out on both sides."""
    a = F.col("amplitude")
    part = F.abs(a / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.nullif(a, F.lit(0.0))))) - 1)) % 1
    return fire(spark, folder).where((a == 0) | (F.abs(part - 0.5) > 1e-9)).select("event_id", F.round(series.significant(a), 9).alias("label_text"))


@query("fire", sql="SELECT event_id, round(CASE WHEN abs(amplitude) > 2 THEN sign(amplitude) * (1 + ln(abs(amplitude) / 2)) * 2 ELSE amplitude END, 6) + 0.0 AS log_axis, round(sign(amplitude) * pow(abs(amplitude) / 2, 1.0 / 3), 6) + 0.0 AS cubic_axis FROM fire")
def axis_transforms(spark, folder):
    a = F.col("amplitude")
    f = fire(spark, folder).select("event_id", series.axis_transform(a, "log", 2.0).alias("log_axis"), series.axis_transform(a, "cubic", 2.0).alias("cubic_axis"))
    return rounded(f, 6, "log_axis", "cubic_axis")


@query()
def whiten(spark, folder):
    return series.whiten(load(spark, folder))


@query()
def bandpass_filter(spark, folder):
    return series.bandpass_filter(load(spark, folder), 20_000.0, 300.0, 6000.0)


@query()
def exponential_filter(spark, folder):
    return series.exponential_filter(load(spark, folder), 20.0, high_pass=True)


@query()
def add_noise(spark, folder):
    return series.add_noise(load(spark, folder), 1.0)


@query()
def quantile_codec(spark, folder):
    return series.quantile_codec(load(spark, folder))


# --- events ------------------------------------------------------------------------------------------------


@query("fire", sql="SELECT event_id, label FROM fire WHERE detectability_score >= 4.0 AND outlier_score <= 2.0")
def filter_events(spark, folder):
    return events.filter_events(fire(spark, folder), 4.0, 2.0).select("event_id", "label")


@query("fire", sql="SELECT event_id, label FROM fire WHERE label IN (1, 3, 4)")
def firings_subset(spark, folder):
    return events.firings_subset(fire(spark, folder), [1, 3, 4]).select("event_id", "label")


@query("fire", sql="SELECT event_id, label FROM (SELECT event_id, label, row_number() OVER (PARTITION BY recording_id, label ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY recording_id, label) AS n FROM fire WHERE label IN (1, 2, 3, 4, 5)) WHERE n <= 7 OR ((r * 7 + n - 1) // n) * n < (r + 1) * 7")
def mv_subfirings(spark, folder):
    return events.subfirings(fire(spark, folder), [1, 2, 3, 4, 5], 7).select("event_id", "label")


@query("fire", sql="SELECT event_id, label FROM fire WHERE abs(amplitude) >= 5.0 AND outlier_score <= 2.5 AND abs(detectability_score) >= 3.0")
def firings_event_filter(spark, folder):
    return events.event_filter(fire(spark, folder), 5.0, 2.5, 3.0).select("event_id", "label")


@query("fire", sql="SELECT event_id, row_number() OVER (ORDER BY recording_id, time, event_id) AS position FROM fire")
def sort_firings(spark, folder):
    return events.sort_firings(fire(spark, folder)).select("event_id", as_long("position").alias("position"))


@query("fire", sql="SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY recording_id, label ORDER BY round(sin(12.0 * r + r * r), 9), r) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, label ORDER BY event_id) - 1 AS r FROM fire)) WHERE rn <= 20")
def spread_sample(spark, folder):
    return events.spread_sample(fire(spark, folder), 20).select("event_id")


@query("fire", sql="SELECT event_id FROM (SELECT event_id, sin(r + cos(r)) + 5 AS x FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY recording_id, label ORDER BY event_id) - 1 AS DOUBLE) AS r FROM fire)) WHERE x - floor(x) <= 0.25")
def thin(spark, folder):
    return events.thin(fire(spark, folder), 4.0).select("event_id")


def _tagged(spark, folder):
    """Tags by a rule on labels, in place of a curator's."""
    labels = fire(spark, folder).select("label").where("label > 0").distinct()
    return labels.select("label", F.expr("filter(array(if(label % 5 = 0, 'rejected', null), if(label % 3 = 0, 'good', null)), x -> x is not null)").alias("tags"))


@query("fire", sql="SELECT DISTINCT label FROM fire WHERE label > 0 AND label % 5 <> 0 AND label % 3 = 0")
def visibility_rule(spark, folder):
    return events.visible(_tagged(spark, folder), tags=["good"]).select("label")


@query("fire", sql="SELECT event_id, CASE WHEN label % 2 = 0 AND label % 4 <> 0 THEN label - 1 ELSE label END AS label FROM fire WHERE NOT (label > 0 AND label % 5 = 0)")
def curated_export(spark, folder):
    merges = _tagged(spark, folder).where("label % 2 = 0 and label % 4 <> 0").select("label", (F.col("label") - 1).alias("representative"))
    return events.curated_export(fire(spark, folder), _tagged(spark, folder), merges).select("event_id", "label")


@query("fire", sql="SELECT f.event_id, coalesce(d.new, 0) AS label FROM fire f LEFT JOIN (SELECT recording_id, label, row_number() OVER (PARTITION BY recording_id ORDER BY label) AS new FROM (SELECT DISTINCT recording_id, label FROM fire WHERE label > 0)) d USING (recording_id, label)")
def relabel_dense(spark, folder):
    return events.relabel_dense(fire(spark, folder)).select("event_id", as_long("label").alias("label"))


@query("fire", sql="SELECT event_id, CASE WHEN amplitude < 0 THEN 'negative' ELSE 'positive' END AS side FROM fire")
def sign_split(spark, folder):
    return events.sign_split(fire(spark, folder)).select("event_id", "side")


@query("fire", sql="SELECT event_id, label FROM (SELECT event_id, label, time, lag(time) OVER (PARTITION BY recording_id, label ORDER BY time, event_id) AS before FROM fire) WHERE before IS NULL OR time - before > 5")
def remove_redundant_events(spark, folder):
    return events.remove_redundant(fire(spark, folder)).select("event_id", "label")


@query("fire", sql="SELECT a.event_id FROM fire a WHERE a.detectability_score > 0 AND NOT EXISTS (SELECT 1 FROM fire b WHERE b.recording_id = a.recording_id AND b.event_id <> a.event_id AND b.detectability_score > 0 AND abs(a.time - b.time) <= 30 AND (b.detectability_score > a.detectability_score OR (b.detectability_score = a.detectability_score AND (b.time < a.time OR (b.time = a.time AND b.event_id < a.event_id)))))")
def find_events_to_use(spark, folder):
    return events.events_to_use(fire(spark, folder), "detectability_score", 30.0).select("event_id")


@query("fire", sql="SELECT event_id, label FROM kept")
def refractory_filter(spark, folder):
    return events.refractory(fire(spark, folder), 50.0).select("event_id", "label")


SQL["refractory_filter"] = "WITH RECURSIVE " + SQL["refractory_filter"].removeprefix("WITH ").replace(
    " SELECT event_id, label FROM kept",
    """, kept AS (SELECT recording_id, label, p.time AS time, p.event_id AS event_id FROM (SELECT recording_id, label, min({'time': time, 'event_id': event_id}) AS p FROM fire GROUP BY ALL)
    UNION ALL SELECT recording_id, label, p.time, p.event_id FROM (SELECT k.recording_id, k.label, min({'time': f.time, 'event_id': f.event_id}) AS p FROM kept k JOIN fire f ON f.recording_id = k.recording_id AND f.label = k.label AND f.time >= k.time + 50 GROUP BY ALL))
    SELECT event_id, label FROM kept""", 1,
)


@query("fire", sql="SELECT f.event_id, e.name FROM fire f JOIN recordings r USING (recording_id) JOIN (VALUES ('early', 0.0, 0.02), ('late', 0.015, 0.1)) e(name, a, b) ON f.time / r.samplerate >= e.a AND f.time / r.samplerate < e.b")
def epochs_join(spark, folder):
    rate = table(spark, folder, "recordings").select("recording_id", "samplerate")
    names = F.inline(F.array(F.struct(F.lit("early").alias("name"), F.lit(0.0).alias("t_begin"), F.lit(0.02).alias("t_end")), F.struct(F.lit("late").alias("name"), F.lit(0.015).alias("t_begin"), F.lit(0.1).alias("t_end"))))
    f = fire(spark, folder).join(rate, "recording_id").withColumn("time", F.col("time") / F.col("samplerate"))
    return events.in_epochs(f, rate.select("recording_id", names))


# --- joins -------------------------------------------------------------------------------------------------


@query("series", "size", "fire", "clips", sql="SELECT event_id, channel, dt, value FROM clip")
def extract_clips(spark, folder):
    return clips(spark, folder).select("event_id", "channel", "dt", "value")


@query("series", "fire", sql="SELECT f.event_id, coalesce(s.value, 0.0) AS value FROM fire f LEFT JOIN series s ON s.recording_id = f.recording_id AND s.channel = f.channel AND s.t = CAST(trunc(f.time) AS BIGINT)")
def extract_channel_values(spark, folder):
    return joins.extract_channel_values(load(spark, folder), fire(spark, folder))


@query(sql="SELECT a.s_suppkey AS ch1, b.s_suppkey AS ch2 FROM supplier a JOIN supplier b ON (a.s_nationkey - b.s_nationkey) * (a.s_nationkey - b.s_nationkey) + (a.s_suppkey - b.s_suppkey) * (a.s_suppkey - b.s_suppkey) <= 16")
def geom2adj(spark, folder):
    s = table(spark, folder, "supplier")
    return joins.geom2adj(s.select(F.col("s_suppkey").alias("channel"), F.col("s_nationkey").cast("double").alias("x"), F.col("s_suppkey").cast("double").alias("y")), 4.0)


@query("series", sql="SELECT a.recording_id, a.channel AS ch1, b.channel AS ch2 FROM (SELECT DISTINCT recording_id, channel FROM series) a JOIN (SELECT DISTINCT recording_id, channel FROM series) b ON a.recording_id = b.recording_id AND abs(a.channel - b.channel) <= 1")
def linear_adjacency_matrix(spark, folder):
    return joins.linear_adjacency(load(spark, folder), 1)


@query("fire", "tallies", "lags", sql="SELECT recording_id, label1, label2, dt, n FROM lags")
def cross_correlogram(spark, folder):
    return joins.cross_correlogram(fire(spark, folder), 10)


@query("fire", "tallies", "lags", sql="SELECT recording_id, label1, label2, dt, n FROM lags WHERE label1 = label2")
def auto_correlogram(spark, folder):
    return joins.auto_correlogram(fire(spark, folder), 10)


def _modes(spark, folder, mode):
    return joins.correlograms(fire(spark, folder), 10, mode, range(1, 11), [2, 1, 3], [(1, 4), (2, 5)])


@query("fire", "tallies", "lags", sql="SELECT recording_id, label1, label2, dt, n FROM lags WHERE label1 = label2 AND label1 <= 3")
def correlograms_selected_auto(spark, folder):
    return _modes(spark, folder, "selected_auto")


@query("fire", "tallies", "lags", sql="SELECT recording_id, label1, label2, dt, n FROM lags WHERE label1 = 2 AND label2 <= 10")
def correlograms_one_vs_all(spark, folder):
    return _modes(spark, folder, "one_vs_all")


@query("fire", "tallies", "lags", sql="SELECT recording_id, label1, label2, dt, n FROM lags WHERE label1 <= 3 AND label2 <= 3")
def correlograms_matrix(spark, folder):
    return _modes(spark, folder, "matrix")


@query("fire", "tallies", "lags", sql="SELECT recording_id, label1, label2, dt, n FROM lags WHERE (label1 = 1 AND label2 = 4) OR (label1 = 2 AND label2 = 5)")
def correlograms_selected_pairs(spark, folder):
    return _modes(spark, folder, "selected_pairs")


@query("fire", "tallies", "lags", sql="SELECT b.recording_id, b.label1, b.label2, round(b.n / c.n1, 6) + 0.0 AS fraction FROM (SELECT recording_id, label1, label2, max(n) AS n FROM (SELECT l.recording_id, l.label1, l.label2, g.at, sum(l.n) AS n FROM lags l JOIN (SELECT unnest(range(-10, 11)) AS at) g ON abs(l.dt - g.at) <= 3 WHERE l.label1 <> l.label2 GROUP BY ALL) GROUP BY ALL) b JOIN (SELECT recording_id, label AS label1, count(*) AS n1 FROM fire WHERE label > 0 GROUP BY ALL) c USING (recording_id, label1)")
def coincidence_fraction(spark, folder):
    return rounded(joins.coincidence_fraction(fire(spark, folder)), 6, "fraction")


@query("fire", "fire2", "tallies", sql="SELECT a.recording_id, a.label AS label1, b.label AS label2, CAST(sum(a.c * b.c) AS BIGINT) AS n FROM t1 a JOIN (SELECT recording_id, label, CAST(trunc(time) AS BIGINT) AS t, count(*) AS c FROM fire2 WHERE label > 0 GROUP BY ALL) b ON a.recording_id = b.recording_id AND abs(a.t - b.t) <= 10 GROUP BY ALL")
def match_pair_counts(spark, folder):
    return joins.match_counts(fire(spark, folder), fire(spark, folder, "detail_firings"), 10)


def _matches(spark, folder):
    return joins.match_events(fire(spark, folder), fire(spark, folder, "detail_firings"), 10)


@query()
def confusion_matrix(spark, folder):
    return joins.confusion_matrix(_matches(spark, folder))


@query()
def event_correspondence(spark, folder):
    return _matches(spark, folder)


@query()
def optimal_assignments(spark, folder):
    return joins.optimal_assignment(joins.confusion_matrix(_matches(spark, folder)))


@query()
def merge_firings(spark, folder):
    return joins.merge_firings(fire(spark, folder), fire(spark, folder, "detail_firings"), 10)


# --- aggregates --------------------------------------------------------------------------------------------

_BASE = ("series", "fire", "templates")


@query(*_BASE, sql="SELECT recording_id, label, channel, dt, round(mean, 5) + 0.0 AS mean, n FROM templates")
def compute_templates(spark, folder):
    return rounded(templates(spark, folder).select("recording_id", "label", "channel", "dt", "mean", "n"), 5, "mean")


@query(*_BASE, sql="SELECT recording_id, label, channel, dt, round(mean * n / (n + label - 1), 5) + 0.0 AS mean FROM templates")
def compute_templates_compat(spark, folder):
    t = ag.compute_templates(load(spark, folder), fire(spark, folder), CLIP, compat=True)
    return rounded(t.select("recording_id", "label", "channel", "dt", "mean"), 5, "mean")


@query(*_BASE, sql="SELECT recording_id, label, channel, dt, round(stdev, 2) + 0.0 AS stdev FROM templates")
def mv_compute_templates(spark, folder):
    return rounded(templates(spark, folder).select("recording_id", "label", "channel", "dt", "stdev"), 2, "stdev")


@query("series", "size", "fire", "templates", sql=f"SELECT f.event_id, CASE WHEN CAST(trunc(f.time) AS BIGINT) >= 4 AND CAST(trunc(f.time) AS BIGINT) - 4 + {CLIP} <= z.n THEN coalesce(s.value, 0.0) ELSE 0.0 END AS amplitude FROM fire f JOIN (SELECT recording_id, label, channel AS home, dt FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, label ORDER BY abs(mean) DESC, dt, channel) AS rn FROM templates) WHERE rn = 1) p USING (recording_id, label) JOIN size z USING (recording_id) LEFT JOIN series s ON s.recording_id = f.recording_id AND s.channel = p.home AND s.t = CAST(trunc(f.time) AS BIGINT) - 4 + p.dt")
def compute_amplitudes(spark, folder):
    return ag.compute_amplitudes(load(spark, folder), fire(spark, folder), CLIP)


@query("series", "size", "fire", sql="SELECT f.recording_id, f.label, count(*) AS num_events, round(count(*) * max(r.samplerate) / max(z.n), 6) + 0.0 AS firing_rate FROM fire f JOIN size z USING (recording_id) JOIN (SELECT recording_id, max(samplerate) AS samplerate FROM recordings GROUP BY ALL) r USING (recording_id) GROUP BY ALL")
def basic_metrics(spark, folder):
    return rounded(ag.basic_metrics(load(spark, folder), fire(spark, folder), table(spark, folder, "recordings")), 6, "firing_rate")


@query(*_BASE, sql="SELECT recording_id, label, round(max(abs(mean)), 5) + 0.0 AS peak_amp, round(max(stdev), 2) + 0.0 AS peak_noise FROM templates GROUP BY ALL")
def peak_amp_noise(spark, folder):
    return rounded(rounded(metrics.peak_metrics(templates(spark, folder)), 5, "peak_amp"), 2, "peak_noise")


@query(*_BASE, sql="SELECT recording_id, label, channel, round(arg_max(mean, abs(mean)), 5) + 0.0 AS peak FROM templates GROUP BY ALL")
def channel_peaks(spark, folder):
    return rounded(ag.channel_peaks(templates(spark, folder)), 5, "peak")


@query(*_BASE, sql="SELECT recording_id, label, channel, round(sqrt(sum(mean * mean)), 5) + 0.0 AS energy FROM templates GROUP BY ALL")
def cluster_channel_matrix(spark, folder):
    return rounded(ag.channel_energy(templates(spark, folder)), 5, "energy")


@query("fire", sql="SELECT label, CAST(greatest(1, least(40, ceil((amplitude + 40.0) / 2.0))) AS INTEGER) AS bin, count(*) AS \"count\", count(*) / 2.0 AS density FROM fire WHERE label > 0 AND amplitude BETWEEN -40 AND 40 GROUP BY ALL")
def amplitude_histogram(spark, folder):
    return ag.histogram(fire(spark, folder).where("label > 0"), "amplitude", -40.0, 40.0, 40, ["label"])


@query("fire", sql="SELECT recording_id, label, round(m, 6) + 0.0 AS median, row_number() OVER (PARTITION BY recording_id ORDER BY abs(m), label) AS position FROM (SELECT recording_id, label, median(amplitude) AS m FROM fire WHERE label > 0 GROUP BY ALL)")
def amplitude_median_order(spark, folder):
    return rounded(ag.amplitude_order(fire(spark, folder)).withColumn("position", as_long("position")), 6, "median")


@query(*_BASE, sql=f"SELECT recording_id, label, round(coalesce(1 - abs((sum(abs(mean) * dt) / nullif(sum(abs(mean)), 0) - {CLIP / 2}) / {CLIP / 2}), 0.0), 5) + 0.0 AS centredness FROM templates GROUP BY ALL")
def centredness(spark, folder):
    return rounded(ag.centredness(templates(spark, folder), CLIP).drop("quality"), 5, "centredness")


@query(*_BASE, sql=f"SELECT recording_id, label, round(coalesce(sqrt(sum(mean * mean)) / nullif(sqrt(sum(stdev * stdev)), 0), 0.0) + coalesce(1 - abs((sum(abs(mean) * dt) / nullif(sum(abs(mean)), 0) - {CLIP / 2}) / {CLIP / 2}), 0.0), 3) + 0.0 AS quality FROM templates GROUP BY ALL HAVING max(stdev) = 0 OR max(stdev) > 1e-3")
def quality_score(spark, folder):
    """Labels whose deviations are rounding errors alone are left out on both sides."""
    t = templates(spark, folder)
    some = t.groupBy("recording_id", "label").agg(F.max("stdev").alias("d")).where("d = 0 or d > 1e-3")
    return rounded(ag.centredness(t.join(some, ["recording_id", "label"], "left_semi"), CLIP).drop("centredness"), 3, "quality")


@query("fire", sql="SELECT recording_id, label, row_number() OVER (PARTITION BY recording_id ORDER BY n, label) AS position FROM (SELECT recording_id, label, count(*) AS n FROM fire WHERE label > 0 GROUP BY ALL)")
def cluster_order(spark, folder):
    n = fire(spark, folder).where("label > 0").groupBy("recording_id", "label").agg(F.count("*").alias("n"))
    return ag.cluster_order(n, "n").withColumn("position", as_long("position"))


@query(*_BASE, sql=f"SELECT recording_id, label, n AS num_events, row_number() OVER (PARTITION BY recording_id, label ORDER BY dt, channel) - 1 AS place, round(mean, 5) + 0.0 AS mean, round(stdev, 2) + 0.0 AS stdev FROM templates")
def cluster_detail(spark, folder):
    d = ag.cluster_detail(templates(spark, folder)).select("recording_id", "label", "num_events", F.posexplode(F.arrays_zip("mean", "stdev")).alias("place", "x"))
    d = d.select("recording_id", "label", "num_events", as_long("place").alias("place"), "x.mean", "x.stdev")
    return rounded(rounded(d, 5, "mean"), 2, "stdev")


@query("fire", sql="SELECT label, CASE WHEN label % 2 = 0 THEN 2.0 * n ELSE 1.0 * n END AS size, CASE WHEN label % 2 = 0 THEN CAST(label AS DOUBLE) END AS extra FROM (SELECT label, count(*) AS n FROM fire WHERE label > 0 GROUP BY ALL)")
def upsert_metrics(spark, folder):
    """Sizes of the clusters, doubled by a second table for even labels, which also adds a metric."""
    n = fire(spark, folder).where("label > 0").groupBy("label").agg(F.count("*").cast("double").alias("n"))
    old = n.select("label", F.create_map(F.lit("size"), F.col("n")).alias("metrics"))
    new = n.where("label % 2 = 0").select("label", (2 * F.col("n")).alias("size"), F.col("label").cast("double").alias("extra"))
    return ag.upsert_metrics(old, new, ["label"]).select("label", F.col("metrics")["size"].alias("size"), F.col("metrics")["extra"].alias("extra"))


@query("fire", "fire2", "tallies", sql="SELECT recording_id, label1, label2, n, round(n / sum(n) OVER (PARTITION BY recording_id, label1), 6) + 0.0 AS row_share, round(n / sum(n) OVER (PARTITION BY recording_id, label2), 6) + 0.0 AS column_share FROM (SELECT a.recording_id, a.label AS label1, b.label AS label2, CAST(sum(a.c * b.c) AS BIGINT) AS n FROM t1 a JOIN (SELECT recording_id, label, CAST(trunc(time) AS BIGINT) AS t, count(*) AS c FROM fire2 WHERE label > 0 GROUP BY ALL) b ON a.recording_id = b.recording_id AND abs(a.t - b.t) <= 10 GROUP BY ALL)")
def confusion_normalize(spark, folder):
    return rounded(ag.confusion_normalized(match_pair_counts(spark, folder)), 6, "row_share", "column_share")


@query("fire", "fire2", "tallies", sql="SELECT recording_id, label1, round(f, 6) + 0.0 AS fraction, row_number() OVER (PARTITION BY recording_id ORDER BY f DESC, label1) AS position FROM (SELECT recording_id, label1, max(n) / sum(n) AS f FROM (SELECT a.recording_id, a.label AS label1, b.label AS label2, CAST(sum(a.c * b.c) AS BIGINT) AS n FROM t1 a JOIN (SELECT recording_id, label, CAST(trunc(time) AS BIGINT) AS t, count(*) AS c FROM fire2 WHERE label > 0 GROUP BY ALL) b ON a.recording_id = b.recording_id AND abs(a.t - b.t) <= 10 GROUP BY ALL) GROUP BY ALL)")
def pair_counts_display_order(spark, folder):
    return rounded(ag.confusion_order(match_pair_counts(spark, folder)).withColumn("position", as_long("position")), 6, "fraction")


@query()
def confusion_display_order(spark, folder):
    return ag.confusion_order(confusion_matrix(spark, folder))


@query()
def accuracy_table(spark, folder):
    c = confusion_matrix(spark, folder)
    return ag.accuracy_table(c, joins.optimal_assignment(c))


@query("fire", sql="SELECT recording_id, min(amplitude) AS vmin, max(amplitude) AS vmax, round(sum(amplitude), 6) + 0.0 AS total, round(avg(amplitude), 6) + 0.0 AS mean, round(median(amplitude), 6) + 0.0 AS median, round(coalesce(stddev_samp(amplitude), 0), 6) + 0.0 AS sd, round(sqrt(sum(amplitude * amplitude)), 6) + 0.0 AS norm, round(sum(amplitude * detectability_score), 5) + 0.0 AS dot, round(coalesce(covar_pop(amplitude, detectability_score) / nullif(stddev_pop(amplitude) * stddev_pop(detectability_score), 0), 0), 6) + 0.0 AS correlation FROM fire GROUP BY recording_id")
def scalar_aggregates(spark, folder):
    s = ag.scalar_aggregates(fire(spark, folder), "amplitude", "detectability_score", ["recording_id"])
    return rounded(rounded(s, 6, "total", "mean", "median", "sd", "norm", "correlation"), 5, "dot")


# --- scores ------------------------------------------------------------------------------------------------

_PAIRS = "pairs AS (SELECT a.recording_id, a.label AS label1, b.label AS label2, sqrt(sum((a.mean - b.mean) * (a.mean - b.mean))) AS distance FROM templates a JOIN templates b USING (recording_id, channel, dt) WHERE a.label <> b.label GROUP BY ALL)"


@query(*_BASE, sql="SELECT recording_id, label1, label2, round(distance, 4) + 0.0 AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, label1 ORDER BY round(distance, 6), label2) AS rank FROM pairs) WHERE rank <= 5")
def template_distance_topk(spark, folder):
    return rounded(metrics.nearest_templates(templates(spark, folder), 5).withColumn("rank", as_long("rank")), 4, "distance")


SQL["template_distance_topk"] = SQL["template_distance_topk"].replace(" SELECT recording_id, label1", f", {_PAIRS} SELECT recording_id, label1", 1)


@query(*_BASE, sql="SELECT recording_id, label1, label2, round(distance, 4) + 0.0 AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, label1 ORDER BY round(distance, 6), label2) AS rank FROM pairs WHERE label1 < label2) WHERE rank <= 10")
def find_pairs_to_compare(spark, folder):
    return rounded(metrics.pairs_to_compare(templates(spark, folder), 10).withColumn("rank", as_long("rank")), 4, "distance")


SQL["find_pairs_to_compare"] = SQL["find_pairs_to_compare"].replace(" SELECT recording_id, label1", f", {_PAIRS} SELECT recording_id, label1", 1)


@query(*_BASE, sql="SELECT recording_id, label1, label2, round(CASE WHEN least(n1, n2) >= 0.8 * greatest(n1, n2) THEN coalesce(r, 0.0) ELSE 0.0 END, 5) + 0.0 AS similarity FROM (SELECT a.recording_id, a.label AS label1, b.label AS label2, sqrt(sum(a.mean * a.mean)) AS n1, sqrt(sum(b.mean * b.mean)) AS n2, covar_pop(a.mean, b.mean) / nullif(stddev_pop(a.mean) * stddev_pop(b.mean), 0) AS r FROM templates a JOIN templates b USING (recording_id, channel, dt) WHERE a.label < b.label GROUP BY ALL)")
def template_similarity(spark, folder):
    return rounded(metrics.template_similarity(templates(spark, folder)), 5, "similarity")


def _some_pairs(spark, folder):
    return fire(spark, folder).where("label > 0").select("recording_id", F.col("label").alias("k1"), (F.col("label") + 1).alias("k2")).distinct()


@query("series", "size", "fire", "clips", sql="SELECT recording_id, k1, k2, k, event_id, round(CASE WHEN dd = 0 THEN 0.0 ELSE s / dd END, 4) + 0.0 AS value FROM (SELECT x.recording_id, x.k1, x.k2, r.label AS k, r.event_id, sum((r.value - x.mid) * x.d) AS s, sum(x.d * x.d) AS dd FROM axis x JOIN lab r ON r.recording_id = x.recording_id AND r.channel = x.channel AND r.dt = x.dt AND (r.label = x.k1 OR r.label = x.k2) GROUP BY ALL)")
def discrimhist_centroid(spark, folder):
    return rounded(metrics.discriminant_values(clips(spark, folder), fire(spark, folder), _some_pairs(spark, folder)), 4, "value")


SQL["discrimhist_centroid"] = SQL["discrimhist_centroid"].replace(
    " SELECT recording_id, k1, k2, k, event_id",
    """, lab AS (SELECT c.*, f.label FROM clip c JOIN fire f USING (event_id) WHERE f.label > 0), centroid AS (SELECT recording_id, label, channel, dt, avg(value) AS m FROM lab GROUP BY ALL),
    axis AS (SELECT a.recording_id, a.label AS k1, b.label AS k2, a.channel, a.dt, b.m - a.m AS d, (a.m + b.m) / 2 AS mid FROM centroid a JOIN centroid b ON b.recording_id = a.recording_id AND b.channel = a.channel AND b.dt = a.dt AND b.label = a.label + 1)
    SELECT recording_id, k1, k2, k, event_id""", 1,
)


@query()
def mv_discrimhist_svm(spark, folder):
    return metrics.svm_values(clips(spark, folder), fire(spark, folder), _some_pairs(spark, folder), most=200)


@query("series", "size", "fire", "clips", sql="SELECT recording_id, k1, k2, round(coalesce(abs(max(CASE WHEN k = k2 THEN m END) - max(CASE WHEN k = k1 THEN m END)) / nullif(stddev_samp(value - m), 0), 0.0), 3) + 0.0 AS score FROM (SELECT *, avg(value) OVER (PARTITION BY recording_id, k1, k2, k) AS m FROM (SELECT recording_id, k1, k2, k, event_id, round(CASE WHEN dd = 0 THEN 0.0 ELSE s / dd END, 9) AS value FROM projected)) GROUP BY ALL")
def separation_score(spark, folder):
    v = metrics.discriminant_values(clips(spark, folder), fire(spark, folder), _some_pairs(spark, folder))
    return rounded(metrics.separation(v.withColumn("value", F.round("value", 9))), 3, "score")


SQL["separation_score"] = SQL["separation_score"].replace(
    " SELECT recording_id, k1, k2, round(coalesce(abs",
    """, lab AS (SELECT c.*, f.label FROM clip c JOIN fire f USING (event_id) WHERE f.label > 0), centroid AS (SELECT recording_id, label, channel, dt, avg(value) AS m FROM lab GROUP BY ALL),
    axis AS (SELECT a.recording_id, a.label AS k1, b.label AS k2, a.channel, a.dt, b.m - a.m AS d, (a.m + b.m) / 2 AS mid FROM centroid a JOIN centroid b ON b.recording_id = a.recording_id AND b.channel = a.channel AND b.dt = a.dt AND b.label = a.label + 1),
    projected AS (SELECT x.recording_id, x.k1, x.k2, r.label AS k, r.event_id, sum((r.value - x.mid) * x.d) AS s, sum(x.d * x.d) AS dd FROM axis x JOIN lab r ON r.recording_id = x.recording_id AND r.channel = x.channel AND r.dt = x.dt AND (r.label = x.k1 OR r.label = x.k2) GROUP BY ALL)
    SELECT recording_id, k1, k2, round(coalesce(abs""", 1,
)


@query()
def mv_discrimhist_guide(spark, folder):
    return metrics.histogram_guide(load(spark, folder), fire(spark, folder), 5, CLIP)


@query()
def noise_overlap(spark, folder):
    return metrics.noise_overlap(load(spark, folder), fire(spark, folder), CLIP)


@query()
def pair_overlap(spark, folder):
    return metrics.pair_overlap(load(spark, folder), fire(spark, folder), CLIP)


@query()
def ms_metrics(spark, folder):
    return metrics.ms_metrics(load(spark, folder), fire(spark, folder), CLIP)[0]


@query()
def ms_metrics_pairs(spark, folder):
    return metrics.ms_metrics(load(spark, folder), fire(spark, folder), CLIP)[1]


@query()
def cluster_pair_scores(spark, folder):
    return metrics.cluster_pair_scores(load(spark, folder), fire(spark, folder), CLIP, most=200)


@query()
def mv_discrimhist_guide2(spark, folder):
    return metrics.histogram_guide2(load(spark, folder), fire(spark, folder), CLIP, most=200)


@query()
def cluster_scores(spark, folder):
    return metrics.cluster_scores(load(spark, folder), fire(spark, folder), CLIP, 20.0)


@query()
def noise_nearest(spark, folder):
    return metrics.noise_nearest(load(spark, folder), fire(spark, folder), CLIP)


@query("fire", sql="SELECT f.event_id, f.recording_id, f.label, CAST(w.shell * f.side AS INTEGER) AS shell FROM stepped f JOIN walk w USING (recording_id, label, side, step)")
def define_shells(spark, folder):
    return metrics.define_shells(fire(spark, folder).where("label > 0"), 2.0, 20)


SQL["define_shells"] = "WITH RECURSIVE " + SQL["define_shells"].removeprefix("WITH ").replace(
    " SELECT f.event_id, f.recording_id, f.label, CAST(w.shell",
    """, stepped AS (SELECT event_id, recording_id, label, CASE WHEN amplitude < 0 THEN -1 ELSE 1 END AS side, CAST(floor(abs(amplitude) / 2.0) AS BIGINT) AS step FROM fire WHERE label > 0),
    steps AS (SELECT *, row_number() OVER (PARTITION BY recording_id, label, side ORDER BY step) AS i, sum(n) OVER (PARTITION BY recording_id, label, side ORDER BY step DESC) - n AS above FROM (SELECT recording_id, label, side, step, count(*) AS n FROM stepped GROUP BY ALL)),
    walk AS (SELECT recording_id, label, side, step, i, 1 AS shell, CASE WHEN n >= 20 AND above >= 20 THEN 0 ELSE n END AS inside, n >= 20 AND above >= 20 AS cut FROM steps WHERE i = 1
    UNION ALL SELECT s.recording_id, s.label, s.side, s.step, s.i, w.shell + CASE WHEN w.cut THEN 1 ELSE 0 END, CASE WHEN w.inside + s.n >= 20 AND s.above >= 20 THEN 0 ELSE w.inside + s.n END, w.inside + s.n >= 20 AND s.above >= 20 FROM walk w JOIN steps s ON s.recording_id = w.recording_id AND s.label = w.label AND s.side = w.side AND s.i = w.i + 1)
    SELECT f.event_id, f.recording_id, f.label, CAST(w.shell""", 1,
)


@query()
def mv_firings_filter(spark, folder):
    split = metrics.split_into_shells(fire(spark, folder), 2.0, 20)
    return events.event_filter(split, 3.0, 3.0).select("event_id", "label", "original_label")


@query()
def compute_outlier_scores(spark, folder):
    return metrics.outlier_scores(load(spark, folder), fire(spark, folder), CLIP, 2.0, 20)


@query()
def compute_detectability_scores(spark, folder):
    return metrics.detectability_scores(load(spark, folder), fire(spark, folder), CLIP, 2.0, 20)


# --- detection, features, clustering -----------------------------------------------------------------------


@query("series", "size", sql="SELECT w.recording_id, w.channel, CAST(w.t + 1 AS DOUBLE) AS time FROM (SELECT *, max(v) OVER (PARTITION BY recording_id, channel ORDER BY t RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING) AS before, max(v) OVER (PARTITION BY recording_id, channel ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS after FROM (SELECT recording_id, channel, t, abs(value) AS v FROM series WHERE abs(value) >= 200)) w JOIN size z USING (recording_id) WHERE (w.before IS NULL OR w.v > w.before) AND (w.after IS NULL OR w.v >= w.after) AND w.t >= 4 AND w.t + 4 < z.n")
def detect_local_max(spark, folder):
    return detection.detect_local_max(load(spark, folder), CLIP, 10, 200.0)


@query()
def detect(spark, folder):
    return detection.detect(load(spark, folder), CLIP, 10, 200.0)


@query()
def fit_stage(spark, folder):
    return detection.fit_stage(load(spark, folder), fire(spark, folder), CLIP).select("event_id", "label")


@query()
def extract_clips_features(spark, folder):
    return features.extract_clips_features(load(spark, folder), fire(spark, folder), CLIP, 3)


@query()
def channel_features(spark, folder):
    return features.channel_features(clips(spark, folder), 2)


@query()
def isosplit2(spark, folder):
    x = table(spark, folder, "embeddings").select(F.col("vec_id").alias("event_id"), F.lit(1).alias("part"), F.col("embedding").cast("array<double>").alias("features"))
    return features.isosplit_clusters(x, ["part"]).select("event_id", "cluster")


@query()
def branch_cluster_v2(spark, folder):
    s = series.finite(table(spark, folder, "timeseries"))
    size = Stages(spark, "branch_cluster").write(series.extent(s))
    near = joins.linear_adjacency(size.select("recording_id", F.explode("channels").alias("channel")), 1)
    return features.cluster_clips(detection.detected_clips(s, CLIP, 10, 200.0), size, near, CLIP, edges=True)


# --- merging -----------------------------------------------------------------------------------------------


@query(*_BASE, sql="SELECT f.event_id, CASE WHEN f.label > 0 THEN d.new ELSE 0 END AS label FROM fire f LEFT JOIN named n USING (recording_id, label) LEFT JOIN dense d ON d.recording_id = f.recording_id AND d.label = coalesce(n.least, f.label)")
def merge_labels(spark, folder):
    return merge.merge_labels(load(spark, folder), fire(spark, folder), 0.9, CLIP).select("event_id", as_long("label").alias("label"))


SQL["merge_labels"] = "WITH RECURSIVE " + SQL["merge_labels"].removeprefix("WITH ").replace(
    " SELECT f.event_id, CASE WHEN f.label > 0",
    """, alike AS (SELECT a.recording_id, a.label AS a, b.label AS b FROM templates a JOIN templates b USING (recording_id, channel, dt) WHERE a.label < b.label GROUP BY ALL
      HAVING least(sqrt(sum(a.mean * a.mean)), sqrt(sum(b.mean * b.mean))) >= 0.8 * greatest(sqrt(sum(a.mean * a.mean)), sqrt(sum(b.mean * b.mean))) AND covar_pop(a.mean, b.mean) / nullif(stddev_pop(a.mean) * stddev_pop(b.mean), 0) > 0.9),
    edges AS (SELECT recording_id, a, b FROM alike UNION SELECT recording_id, b, a FROM alike),
    reach AS (SELECT recording_id, a AS label, b AS least FROM edges UNION SELECT e.recording_id, e.a, r.least FROM reach r JOIN edges e ON e.recording_id = r.recording_id AND e.b = r.label),
    named AS (SELECT recording_id, label, least(min(least), label) AS least FROM reach GROUP BY recording_id, label),
    dense AS (SELECT recording_id, label, row_number() OVER (PARTITION BY recording_id ORDER BY label) AS new FROM (SELECT DISTINCT f.recording_id, coalesce(n.least, f.label) AS label FROM fire f LEFT JOIN named n USING (recording_id, label) WHERE f.label > 0))
    SELECT f.event_id, CASE WHEN f.label > 0""", 1,
)


@query(*_BASE, sql="SELECT f.event_id, d.new AS label FROM fire f JOIN (SELECT recording_id, label, row_number() OVER (PARTITION BY recording_id ORDER BY label) AS new FROM (SELECT recording_id, label, max(abs(mean)) AS p FROM templates GROUP BY ALL) WHERE p >= 30) d USING (recording_id, label)")
def remove_noise_clusters(spark, folder):
    return merge.remove_noise_clusters(load(spark, folder), fire(spark, folder), 30.0, CLIP).select("event_id", as_long("label").alias("label"))


@query()
def merge_across_channels(spark, folder):
    return merge.merge_across_channels(load(spark, folder), fire(spark, folder), CLIP).select("event_id", "time", "label")


@query()
def merge_across_channels_v2(spark, folder):
    return merge.merge_across_channels_v2(load(spark, folder), fire(spark, folder), CLIP).select("event_id", "label")


@query()
def merge_stage(spark, folder):
    return merge.merge_stage(load(spark, folder), fire(spark, folder), CLIP).select("event_id", "label")


@query()
def remove_duplicate_clusters(spark, folder):
    return merge.remove_duplicate_clusters(load(spark, folder), fire(spark, folder), CLIP).select("event_id", "label")


def _pair_tags(spark, folder):
    """Tags by a rule on pairs of labels, in place of a curator's: 1-2, 2-3 and 5-6 of every ten are merged."""
    labels = fire(spark, folder).where("label > 0").select("recording_id", F.col("label").alias("label1")).distinct()
    pairs = labels.select("recording_id", "label1", (F.col("label1") + 1).alias("label2"))
    return pairs.join(labels.select("recording_id", F.col("label1").alias("label2")), ["recording_id", "label2"]).select("recording_id", "label1", "label2", F.when(F.expr("label1 % 10 in (1, 2, 5)"), F.array(F.lit("merged"))).alias("tags"))


_TAGGED = "used AS (SELECT DISTINCT recording_id, label FROM fire WHERE label > 0), linked AS (SELECT a.recording_id, a.label AS a, b.label AS b FROM used a JOIN used b ON b.recording_id = a.recording_id AND b.label = a.label + 1 WHERE a.label % 10 IN (1, 2, 5)), ends AS (SELECT recording_id, a AS label FROM linked UNION SELECT recording_id, b FROM linked), starts AS (SELECT e.recording_id, e.label, (SELECT max(s.label) FROM ends s WHERE s.recording_id = e.recording_id AND s.label <= e.label AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.recording_id = s.recording_id AND l.b = s.label)) AS representative FROM ends e)"


@query("fire", sql="SELECT recording_id, label, representative FROM starts")
def merged_by_tag(spark, folder):
    return merge.tagged_merges(_pair_tags(spark, folder))


@query("fire", sql="SELECT recording_id, label, min(label) OVER (PARTITION BY recording_id, representative) AS representative FROM (SELECT *, count(*) OVER (PARTITION BY recording_id, representative) AS n FROM starts WHERE label % 10 <> 1) WHERE n > 1")
def unmerge(spark, folder):
    merges = merge.tagged_merges(_pair_tags(spark, folder))
    return merge.unmerge(merges, merges.where("label % 10 = 1"))


for _name in ("merged_by_tag", "unmerge"):
    SQL[_name] = SQL[_name].replace(" SELECT recording_id, label,", f", {_TAGGED} SELECT recording_id, label,", 1)


# --- the whole chain ----------------------------------------------------------------------------------------


def _sorted(spark, folder, name, **options):
    """A result of the standard chain, of all recordings; those of one rate are filtered together."""
    s, rates = load(spark, folder), table(spark, folder, "recordings").groupBy("recording_id").agg(F.max("samplerate").alias("samplerate"))
    stages, parts = Stages(spark, "sort"), []
    for (rate,) in sorted(rates.select("samplerate").where("samplerate > 0").distinct().collect()):
        of_rate = s.join(rates.where(F.col("samplerate") == rate), "recording_id", "left_semi")
        chain = workflow.sort_pipeline(spark, of_rate, joins.linear_adjacency(of_rate, 1), rate, cache=f"{stages.root}/{rate:g}", **options)
        parts.append(chain.run()[name])
    return functools.reduce(DataFrame.unionByName, parts)


@query()
def sort_pipeline(spark, folder):
    return _sorted(spark, folder, "firings").select("event_id", "recording_id", "channel", "time", "label")


@query()
def sort_pipeline_noise(spark, folder):
    return _sorted(spark, folder, "firings", noise_level=0.3).select("event_id", "recording_id", "channel", "time", "label")


@query()
def sort_pipeline_metrics(spark, folder):
    return _sorted(spark, folder, "cluster_metrics")


@query()
def sort_pipeline_pair_metrics(spark, folder):
    return _sorted(spark, folder, "cluster_pair_metrics")


# --- sources, streams --------------------------------------------------------------------------------------


_GRID = "SELECT g.recording_id, g.row, string_agg({cell}, '{by}' ORDER BY g.channel) AS line FROM (SELECT z.recording_id, c.channel, unnest(range(z.n)) AS row FROM size z JOIN (SELECT DISTINCT recording_id, channel FROM series) c USING (recording_id)) g LEFT JOIN series s ON s.recording_id = g.recording_id AND s.channel = g.channel AND s.t = g.row GROUP BY ALL"
_THOUSANDTHS = "CASE WHEN s.value IS NULL THEN '0' WHEN s.value = floor(s.value) THEN CAST(CAST(floor(s.value) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(round(s.value * 1000) AS BIGINT) AS VARCHAR) || 'm' END"


def thousandths(v: Column) -> Column:
    """Whole numbers as they are, others in whole thousandths, so that both engines spell them alike."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(F.concat(F.round(v * 1000).cast("bigint").cast("string"), F.lit("m")))


@query("series", "size", sql=_GRID.format(cell=_THOUSANDTHS, by="|"))
def mda2txt(spark, folder):
    """One line per sample."""
    return text_source.as_lines(load(spark, folder), delimiter="|", text=thousandths)


@query("series", "size", sql=_GRID.format(cell="CAST(CAST(trunc(coalesce(s.value, 0.0)) AS BIGINT) AS VARCHAR)", by="\t"))
def as_lines(spark, folder):
    return text_source.as_lines(load(spark, folder).withColumn("value", F.col("value").cast("bigint").cast("double")))


@query()
def synthesize(spark, folder):
    return synthetic.synthesize(spark)[0]


@query()
def synthesize_firings(spark, folder):
    return synthetic.synthesize(spark)[1]


@query(sql="SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, folder):
    e = table(spark, folder, "events")
    out = streaming.windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("series", sql="SELECT recording_id, channel, count(*) AS n, round(sqrt(avg(value * value)), 5) + 0.0 AS rms FROM series GROUP BY ALL")
def running_scale(spark, folder):
    return rounded(streaming.running_scale(load(spark, folder)), 5, "rms")


SQL.update({name: shifted(sql) for name, sql in SQL.items()})
