"""Batch runs of the streaming operators over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.sources import tables as t
from lakeline.streaming import jobs

sec = F.unix_timestamp


def events(s, d):
    return t.load(s, d, "events")


QUERIES = {
    "activity_tumbling": lambda s, d: jobs.activity_windows(events(s, d)).select(sec("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")),
    "activity_sliding": lambda s, d: jobs.activity_windows(events(s, d), "2 days", "1 day").select(sec("w.start").alias("start"), "event_type", "n"),
    "activity_sessions": lambda s, d: jobs.session_windows(events(s, d), "6 hours").select("user_id", sec("w.start").alias("start"), sec("w.end").alias("end_s"), "n"),
    "rate_counts": lambda s, d: jobs.rate_counts(events(s, d), 2, "1 hour").select("user_id", sec("w.start").alias("start"), "n", "rejected"),
}
E_ = "e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"
ORACLE_SQL = {
    "activity_tumbling": f"WITH {E_} SELECT sec // 86400 * 86400 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1, 2",
    "activity_sliding": f"WITH {E_} SELECT sec // 86400 * 86400 - k * 86400 AS start, event_type, count(*) AS n FROM e, range(2) AS r(k) GROUP BY 1, 2",
    "activity_sessions": """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS c FROM events),
      s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 6 HOURS)) AS BIGINT) AS end_s, count(*) AS n FROM s GROUP BY user_id, k""",
    "rate_counts": f"WITH {E_} SELECT user_id, sec // 3600 * 3600 AS start, count(*) AS n, greatest(count(*) - 2, 0) AS rejected FROM e GROUP BY 1, 2",
}
