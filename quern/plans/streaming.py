"""Event-time windows, run as batch so that SQL can check them; tests run them as streams."""

from pyspark.sql import functions as F

from quern.plans.registry import frame_query
from quern.session import table
from quern.streaming import windows as W


def _events(s, d):
    return table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(c):
    return F.col(c).cast("timestamp_ntz")


frame_query("stream_tumbling", lambda s, d: W.tumbling(_events(s, d), "1 hour", ["event_type"], n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4)).select(_ntz("window.start").alias("start"), "event_type", "n", "total"),
            "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
frame_query("stream_sliding", lambda s, d: W.sliding(_events(s, d), "1 hour", "30 minutes", [], n=F.count(F.lit(1))).select(_ntz("window.start").alias("start"), "n"),
            "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY ALL")
frame_query("stream_sessions", lambda s, d: W.sessions(_events(s, d), "2 hours", ["user_id"], n=F.count(F.lit(1))).select("user_id", _ntz("session_window.start").alias("start"), "n"),
            """WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS start, count(*) AS n FROM numbered GROUP BY user_id, s""")
