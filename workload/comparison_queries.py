"""Latest values, attempts and provider comparison over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlabel.operators import folds
from twinlabel.operators.timeline import session_timeline as timeline
from twinlabel.plans.comparison import compare_providers as compare

from .bindings import SESSION_EVENTS_SQL, session_events
from .registry import query, table

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"""
  SELECT user_id, {', '.join(
    f"max_by(value, (ts, event_id)) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES)}
  FROM events GROUP BY user_id""")
def compare_providers(spark, sf_dir):
    """Newest value of every event type side by side, one row per user."""
    return compare(
        table(spark, sf_dir, "events"), key="user_id", provider="event_type", value="value",
        order=("ts", "event_id"), providers=EVENT_TYPES,
    )


@query("""
  SELECT user_id, event_type, max(event_id) FILTER (newest) AS event_id,
         max(value) FILTER (newest) AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
                                     ORDER BY ts DESC, event_id DESC) = 1 AS newest FROM events)
  GROUP BY user_id, event_type""")
def latest_result(spark, sf_dir):
    events = table(spark, sf_dir, "events").drop("props")
    return folds.latest_result(events, ("user_id", "event_type"), ("ts", "event_id")).select(
        "user_id", "event_type", "event_id", "value"
    )


@query(f"""
  SELECT session_id, provider, max_by(result, (ts, event_id)) FILTER (kind = 'ok') AS result,
         (max_by(struct_pack(v := CASE WHEN kind = 'error' THEN error END), (ts, event_id))
            FILTER (kind IN ('start', 'error'))).v AS error
  FROM ({SESSION_EVENTS_SQL}) WHERE provider IS NOT NULL GROUP BY session_id, provider""")
def latest_error(spark, sf_dir):
    """An older result stays beside a newer error; a new start clears the error."""
    events = session_events(spark, sf_dir).where(F.col("provider").isNotNull())
    return folds.provider_state(events, ("session_id", "provider"))


@query(f"""
  WITH e AS ({SESSION_EVENTS_SQL}),
  top AS (SELECT session_id, max(image_seq) AS image_seq FROM e GROUP BY session_id)
  SELECT session_id, image_seq, provider,
         max_by(result, (ts, event_id)) FILTER (kind = 'ok') AS result,
         (max_by(struct_pack(v := CASE WHEN kind = 'error' THEN error END), (ts, event_id))
            FILTER (kind IN ('start', 'error'))).v AS error
  FROM e JOIN top USING (session_id, image_seq) WHERE provider IS NOT NULL
  GROUP BY session_id, image_seq, provider""")
def reset_on_new_image(spark, sf_dir):
    """Only what belongs to a session's newest image is shown."""
    return folds.reset_on_new_image(session_events(spark, sf_dir))


SESSION_STATE_SQL = f"""
  WITH e AS ({SESSION_EVENTS_SQL}),
  top AS (SELECT session_id, max(image_seq) AS image FROM e GROUP BY session_id),
  live AS (SELECT * FROM e JOIN top USING (session_id) WHERE image_seq = image)
  SELECT session_id, top.image, {', '.join(
    f"max_by(result, (ts, event_id)) FILTER (kind = 'ok' AND provider = '{p}') AS {p}_result, "
    f"(max_by(struct_pack(v := CASE WHEN kind = 'error' THEN error END), (ts, event_id)) "
    f"FILTER (kind IN ('start', 'error') AND provider = '{p}')).v AS {p}_error"
    for p in ('gemini', 'openai', 'grok'))}
  FROM top LEFT JOIN live USING (session_id) GROUP BY session_id, top.image"""


@query(f"""
  WITH e AS (SELECT *, max(image_seq) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS image
             FROM ({SESSION_EVENTS_SQL}))
  SELECT session_id, event_id, image, {', '.join(
    f"last_value(CASE WHEN image_seq = image AND provider = '{p}' AND kind = 'ok' "
    f"THEN result END IGNORE NULLS) OVER w AS {p}_result, "
    f"(last_value(CASE WHEN image_seq = image AND provider = '{p}' AND kind IN ('start', 'error') "
    f"THEN struct_pack(v := CASE WHEN kind = 'error' THEN error END) END IGNORE NULLS) OVER w).v "
    f"AS {p}_error" for p in ('gemini', 'openai', 'grok'))}
  FROM e WINDOW w AS (PARTITION BY session_id, image ORDER BY ts, event_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def session_timeline(spark, sf_dir):
    """What every session shows after each of its events."""
    return timeline(session_events(spark, sf_dir))


@query("""
  WITH a AS (SELECT user_id, event_type, event_id,
                    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt
             FROM events),
  f AS (SELECT user_id, min(attempt) FILTER (event_type = 'purchase') AS success_attempt,
               max(attempt) AS last_attempt,
               max_by(event_type, attempt) FILTER (event_type <> 'purchase') AS last_error
        FROM a WHERE attempt <= 3 GROUP BY user_id)
  SELECT user_id, success_attempt, coalesce(success_attempt, last_attempt) AS attempts_made,
         CASE WHEN success_attempt IS NULL THEN last_error END AS error,
         coalesce(success_attempt, last_attempt) * (coalesce(success_attempt, last_attempt) - 1)
           AS planned_wait_s
  FROM f""")
def first_success(spark, sf_dir):
    """Up to three tries per user, a purchase being the success."""
    tries = folds.number_attempts(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    log = tries.select(
        "user_id", "attempt", (F.col("event_type") == "purchase").alias("ok"),
        F.col("event_type").alias("error"),
    )
    return folds.first_success_attempt(log, ["user_id"])


@query("""
  SELECT user_id, count(DISTINCT event_type) AS completed, 5 AS expected
  FROM events GROUP BY user_id""")
def provider_progress(spark, sf_dir):
    return folds.completed_count(
        table(spark, sf_dir, "events"), "user_id", "event_type", EVENT_TYPES
    )
