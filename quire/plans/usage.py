"""Queries on token usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import usage
from quire.session import table
from quire.streaming import events


def _calls(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("v", F.floor("value").cast("long"))
    return e.select(
        "event_id", F.col("event_type").alias("tier"), F.when(F.col("user_id") % 7 > 0, F.concat(F.lit("s"), F.col("user_id") % 7)).alias("stage"), F.col("k").cast("string").alias("prompt"),
        F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("v").cast("string")).alias("completion"), F.when(F.col("k") % 3 == 0, F.lit(0)).otherwise(F.col("k") + F.col("v") + 1).alias("total"),
        (F.col("k") % 11 - 3).alias("cache_hit"), (F.col("k") % 7).alias("cache_miss"),
    )


def usage_rollup(spark, sf_dir):
    return usage.rolled_up(usage.usage_facts(_calls(spark, sf_dir)))


def usage_stages_by_total(spark, sf_dir):
    r = usage.rolled_up(usage.usage_facts(_calls(spark, sf_dir)))
    return r.where("scope = 'stage'").orderBy(F.desc("total"), "slot").select("slot", "calls", "total")


def _summary(spark, sf_dir, part):
    return usage.rolled_up(usage.usage_facts(_calls(spark, sf_dir).where(part)))


def usage_delta(spark, sf_dir):
    now = _summary(spark, sf_dir, F.lit(True))
    before = _summary(spark, sf_dir, F.col("event_id") % 4 > 1)
    return usage.delta(now, before, ["scope", "slot"])


def usage_merge(spark, sf_dir):
    a, b = _summary(spark, sf_dir, F.col("event_id") % 4 == 0), _summary(spark, sf_dir, F.col("event_id") % 4 > 0)
    return usage.merge(a, b, ["scope", "slot"])


def cached_counts(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    c = usage.cached_counts(F.lit(40), F.when(k % 4 > 0, k))
    return table(spark, sf_dir, "events").select("event_id", c["cache_hit"].alias("cache_hit"), c["cache_miss"].alias("cache_miss"))


def tier_fallback(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", usage.tier_for(["cheap", "strong"], F.get(F.array(F.lit("fast"), F.lit("cheap"), F.lit("strong"), F.lit("other")), F.col("n_nationkey") % 4)).alias("tier"))


def event_window_counts(spark, sf_dir):
    """The streaming aggregate on the whole table at once: the same function serves both."""
    out = events.counts(table(spark, sf_dir, "events"), "6 hours")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (usage_rollup, usage_stages_by_total, usage_delta, usage_merge, cached_counts, tier_fallback, event_window_counts)}

_FACTS = """facts AS (SELECT event_id, event_type AS tier, CASE WHEN user_id % 7 > 0 THEN 's' || (user_id % 7) END AS stage, k AS prompt, CASE WHEN event_id % 13 = 0 THEN 0 ELSE v END AS completion,
        CASE WHEN k % 3 = 0 OR k + v + 1 <= 0 THEN k + CASE WHEN event_id % 13 = 0 THEN 0 ELSE v END ELSE k + v + 1 END AS total, greatest(0, k % 11 - 3) AS cache_hit, greatest(0, k % 7) AS cache_miss
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events))"""
_FIELDS = ("prompt", "completion", "total", "cache_hit", "cache_miss")
_SUMS = "count(*) AS calls, " + ", ".join(f"CAST(coalesce(sum({f}), 0) AS BIGINT) AS {f}" for f in _FIELDS)
_RATE = "coalesce(round(CAST(cache_hit AS DOUBLE) / nullif(cache_hit + cache_miss, 0), 4), 0.0) AS cache_hit_rate"


def _roll(where: str = "TRUE") -> str:
    return f"""(SELECT 'tier' AS scope, tier AS slot, {_SUMS} FROM facts WHERE {where} GROUP BY tier UNION ALL SELECT 'stage', stage, {_SUMS} FROM facts WHERE ({where}) AND stage IS NOT NULL GROUP BY stage
        UNION ALL SELECT 'totals', '', {_SUMS} FROM facts WHERE {where})"""


_ALL = ("calls", *_FIELDS)
ORACLE = {
    "event_window_counts": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "usage_rollup": f"WITH {_FACTS} SELECT *, {_RATE} FROM {_roll()}",
    "usage_stages_by_total": f"WITH {_FACTS} SELECT slot, calls, total FROM {_roll()} WHERE scope = 'stage' ORDER BY total DESC, slot",
    "usage_delta": f"""WITH {_FACTS}, a AS {_roll()}, b AS {_roll('event_id % 4 > 1')},
        d AS (SELECT a.scope, a.slot, {', '.join(f'CAST(greatest(0, a.{f} - coalesce(b.{f}, 0)) AS BIGINT) AS {f}' for f in _ALL)} FROM a LEFT JOIN b ON a.scope = b.scope AND a.slot = b.slot)
        SELECT * FROM d WHERE {' OR '.join(f'{f} > 0' for f in _ALL)}""",
    "usage_merge": f"""WITH {_FACTS}, u AS (SELECT * FROM {_roll('event_id % 4 = 0')} UNION ALL SELECT * FROM {_roll('event_id % 4 > 0')}),
        m AS (SELECT scope, slot, {', '.join(f'CAST(sum({f}) AS BIGINT) AS {f}' for f in _ALL)} FROM u GROUP BY scope, slot) SELECT *, {_RATE} FROM m""",
    "cached_counts": """SELECT event_id, CAST(CASE WHEN k % 4 > 0 THEN greatest(0, k) ELSE 0 END AS BIGINT) AS cache_hit, CAST(CASE WHEN k % 4 > 0 THEN greatest(0, 40 - greatest(0, k)) ELSE 0 END AS BIGINT) AS cache_miss
        FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "tier_fallback": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'cheap' WHEN 1 THEN 'cheap' ELSE 'strong' END AS tier FROM nation",
}
