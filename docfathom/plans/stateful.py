"""Queries of conversations, events and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfathom.operators import conversation as C
from docfathom.operators import sketches as K
from docfathom.streaming import memory as M
from docfathom.streaming import state as S

from .base import ORACLES, query, shared_place, table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    """Times without zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query("""WITH k AS (SELECT *, row_number() OVER w AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS size FROM conversations WHERE role IN ('user','assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
f AS (SELECT *, min(CASE WHEN role='user' THEN turn END) OVER (PARTITION BY conv_id) AS first FROM k WHERE n=1 OR (n<=4 AND size<=1500)) SELECT conv_id, turn, role FROM f WHERE turn>=first OR (first IS NULL AND n=1)""")
def trim_conversation(spark: SparkSession, sf: str) -> DataFrame:
    return C.trimmed(table(spark, sf, "conversations"), 4, 1500).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, text FROM conversations WHERE role='assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)=1")
def latest_assistant_context(spark: SparkSession, sf: str) -> DataFrame:
    return C.latest_assistant(table(spark, sf, "conversations")).select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, CASE WHEN role NOT IN ('user','assistant') THEN 'INVALID_ROLE' WHEN trim(text)='' THEN 'EMPTY_MESSAGE' ELSE 'MESSAGE_TOO_LONG' END AS reason FROM conversations WHERE role NOT IN ('user','assistant') OR trim(text)='' OR length(text)>2000")
def invalid_turns(spark: SparkSession, sf: str) -> DataFrame:
    return C.invalid_turns(table(spark, sf, "conversations")).select("conv_id", "turn", "reason")


@query("SELECT user_id, event_type, n AS place FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS k FROM (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY 1,2)) WHERE k<=3)")
def memory_last_n_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return C.remembered(table(spark, sf, "events"), "user_id", "event_type", "ts", 3).select("user_id", "event_type", F.col("place").cast("long").alias("place"))


@query("SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR epoch_us(ts)-epoch_us(p)>=86400000000")
def request_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_requests(_events(spark, sf), "user_id", "event_type", "ts", "event_id").select("event_id")


@query("SELECT event_id FROM events WHERE epoch_us((SELECT max(ts) FROM events))-epoch_us(ts)<86400000000")
def receipt_expiry_filter(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    now = events.agg(F.max("ts").alias("now"))
    return C.valid_receipts(events.crossJoin(F.broadcast(now)), "ts", F.col("now")).select("event_id")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(CASE WHEN event_id%2=0 THEN value/1e6 END),6) AS cost, quantile_disc(value,0.5) AS p50, quantile_disc(value,0.95) AS p95, max(value) AS highest FROM events GROUP BY 1")
def ask_metrics_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return C.ask_summary(table(spark, sf, "events").withColumn("cost", F.when(F.col("event_id") % 2 == 0, F.col("value") / 1e6)))


@query("SELECT quantile_disc(value,0.5) AS p50, quantile_disc(value,0.95) AS p95, max(value) AS highest FROM events")
def latency_p50_p95(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(C.percentile("value", 0.5).alias("p50"), C.percentile("value", 0.95).alias("p95"), F.max("value").alias("highest"))


@query("""WITH c AS (SELECT event_type AS step, count(DISTINCT user_id) AS users, row_number() OVER (ORDER BY event_type) AS i FROM events GROUP BY 1) SELECT a.step, a.users, round(CASE WHEN a.i=1 THEN 1.0 ELSE a.users/b.users END,6) AS rate FROM c a LEFT JOIN c b ON b.i=a.i-1""")
def funnel_rates(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    steps = sorted(r[0] for r in events.select("event_type").distinct().collect())  # a handful of kinds
    return C.funnel(events, steps)


@query("SELECT b AS begins, n, level FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b, count(*) AS n, quantile_disc(value,0.95) AS level FROM events GROUP BY 1) WHERE level>100")
def alert_windows_15m(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(C.alerts(_events(spark, sf), "ts", "value", 15, 100.0))


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts)-epoch_us(lag(ts) OVER w)>7200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS events, min(ts) AS begins, max(ts) AS ends FROM s GROUP BY 1,2""")
def session_window_2h(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(C.sessions(_events(spark, sf), "user_id", "ts", "event_id"))


@query("SELECT event_type, date_trunc('week', ts)::DATE::VARCHAR AS week, count(*) AS n, true AS median_held, true AS tail_held, true AS users_held FROM events GROUP BY 1, 2")
def sketched_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks from sketches of their days, and whether the exact figures lie within the sketches' bounds of them."""
    events, week = table(spark, sf, "events"), F.date_trunc("week", "day").cast("date").cast("string").alias("week")
    place = shared_place(spark, "sketches")
    K.keep(K.daily(events, "ts", "value", "user_id", "event_type"), place)
    said = K.merged(K.kept(spark, place), "event_type", week)
    exact = events.withColumn("week", F.date_trunc("week", "ts").cast("date").cast("string")).join(said, ["event_type", "week"])

    def held(figure: str, rank: float) -> Column:
        return (F.avg((F.col("value") < F.col(figure)).cast("int")) - K.rank_error() <= rank) & (F.avg((F.col("value") <= F.col(figure)).cast("int")) + K.rank_error() >= rank)

    users = F.count_distinct("user_id")
    near = F.abs(F.first("different") - users) <= F.lit(K.count_error()) * users + 0.5
    return exact.groupBy("event_type", "week").agg(F.first("n").alias("n"), held("p50", 0.5).alias("median_held"), held("p95", 0.95).alias("tail_held"), near.alias("users_held"))


@query("SELECT lang, source, grouping(lang, source)::BIGINT AS level, count(*) AS n, sum(length(text))::BIGINT AS chars, max(length(text)) AS longest, count(DISTINCT text) AS texts FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def grouping_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of a corpus by language and source, by each alone, and of all."""
    docs = table(spark, sf, "documents").select("lang", "source", F.length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"))  # rows are copied for each set: without their texts
    sets = [("lang", "source"), ("lang",), ("source",), ()]
    return K.by_grouping_sets(docs, ("lang", "source"), sets, n=F.count("*"), chars=F.sum("size"), longest=F.max("size"), texts=F.count_distinct("hash"))


def _folder(spark: SparkSession) -> str:
    """A place for a stream's result."""
    return shared_place(spark, "stream")


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    rows = spark.readStream.schema(table(spark, sf, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query(ORACLES["request_dedupe"])
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The rule of ``request_dedupe`` on a stream."""
    first = S.idempotent(_stream(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), "ts", "event_id", "user_id", "event_type")
    return S.run_available(first.select("event_id"), _folder(spark))


@query("WITH m AS (SELECT max(ts)-INTERVAL 30 MINUTE AS w FROM events) SELECT b AS begins, n, round(level,6) AS level FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b, count(*) AS n, avg(value) AS level FROM events GROUP BY 1), m WHERE level>60 AND b+INTERVAL 15 MINUTE<=w")
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    out = S.alert_windows(_stream(spark, sf, "events").select("ts", "value"), "ts", "value", 15, 60.0)
    return _plain(S.run_available(out, _folder(spark)).withColumn("level", F.round("level", 6)))


@query("WITH m AS (SELECT max(ts)-INTERVAL 30 MINUTE AS w FROM events), b AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * s.range AS b, value FROM events, range(4) s) SELECT b AS begins, n, round(level,6) AS level FROM (SELECT b, count(*) AS n, avg(value) AS level FROM b GROUP BY 1), m WHERE level>40 AND b+INTERVAL 60 MINUTE<=w")
def stream_alerts_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of an hour that begin every quarter of one."""
    out = S.alert_windows(_stream(spark, sf, "events").select("ts", "value"), "ts", "value", 60, 40.0, slide=15)
    return _plain(S.run_available(out, _folder(spark)).withColumn("level", F.round("level", 6)))


@query("""WITH q AS (SELECT * FROM events WHERE event_type='click'), r AS (SELECT * FROM events WHERE event_type='view'), m AS (SELECT least((SELECT max(ts) FROM q), (SELECT max(ts) FROM r))-INTERVAL 1 HOUR AS w)
SELECT q.user_id, q.event_id AS request_id, r.event_id AS receipt_id FROM q LEFT JOIN r ON r.user_id=q.user_id AND r.ts>=q.ts AND r.ts<=q.ts+INTERVAL 6 HOUR, m WHERE r.event_id IS NOT NULL OR q.ts+INTERVAL 6 HOUR<w""")
def stream_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks with the views of the same user in the six hours after: two streams, rows without match once no view can come."""
    events = _stream(spark, sf, "events")
    asked = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("request_id"), F.col("ts").alias("asked_at"))
    got = _stream(spark, sf, "events").filter("event_type = 'view'").select("user_id", F.col("event_id").alias("receipt_id"), F.col("ts").alias("got_at"))
    return S.run_available(S.answered(asked, got, "user_id", "6 HOURS"), _folder(spark))


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts)-epoch_us(lag(ts) OVER w)>=7200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, ts, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id)=1 THEN new ELSE 0 END AS new FROM g))
SELECT user_id, min(ts) AS begins, max(ts)+INTERVAL 2 HOUR AS ends, count(*) AS events FROM s GROUP BY user_id, session HAVING max(ts)+INTERVAL 2 HOUR<=(SELECT max(ts)-INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(S.run_available(S.session_windows(_stream(spark, sf, "events").select("ts", "user_id"), "ts", "user_id"), _folder(spark)))


#: The fold of ``stream_memory``, one row of each key a step: state, what still lives at the row's time, outcome, new state.
_MEMORY = """WITH RECURSIVE u AS (SELECT user_id::VARCHAR AS key, event_id AS place, epoch_us(ts) AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
 CASE WHEN event_id%16=15 THEN 'delete' WHEN event_id%16=7 THEN 'new_thread' ELSE ['append','append','begin','complete','read','append','begin','complete'][1+event_id%8] END AS action,
 CASE WHEN event_id%8<>0 THEN 'r'||(floor(value)::BIGINT%3) END AS request, props AS message, event_type AS topic, CASE WHEN event_id%5=0 THEN event_id%4 END AS expected, repeat(props, floor(value)::BIGINT) AS response FROM events),
f AS (SELECT DISTINCT key, 0::BIGINT AS n, NULL::BIGINT AS place, '' AS outcome, 0::BIGINT AS version, 0::BIGINT AS expires, []::VARCHAR[] AS messages, []::VARCHAR[] AS topics, '' AS summary, []::STRUCT(id VARCHAR, status VARCHAR, response VARCHAR, expires BIGINT)[] AS requests, NULL::VARCHAR AS answer FROM u
UNION ALL SELECT key, n, place, o, CASE WHEN o='deleted' THEN 0 WHEN o='applied' THEN v+1 ELSE v END, CASE WHEN o IN ('applied','found') THEN now+172800000000 ELSE expires END,
 CASE WHEN o='deleted' OR (o='applied' AND action='new_thread') THEN [] WHEN o='applied' THEN list_append(ms, message)[-4:] ELSE ms END,
 CASE WHEN o='deleted' THEN [] WHEN o='applied' AND action='append' THEN list_append(list_filter(tp, lambda x: x<>topic), topic)[-3:] ELSE tp END,
 CASE WHEN o='deleted' THEN '' WHEN o='applied' AND action='new_thread' THEN right(array_to_string(list_filter(list_concat([sm], ms), lambda x: x<>''), ' '), 2000) ELSE sm END,
 CASE WHEN action='delete' THEN [] WHEN o='started' THEN list_append(others, {'id': request, 'status': 'processing', 'response': NULL::VARCHAR, 'expires': now+86400000000})
 WHEN request IS NOT NULL AND o IN ('finished','finished_without_replay','applied') THEN list_append(others, {'id': request, 'status': 'completed', 'response': CASE WHEN strlen(response)<=1024 THEN response END, 'expires': now+86400000000}) ELSE live END,
 CASE WHEN o IN ('completed','replayed') THEN held.response END
FROM (SELECT *, CASE action WHEN 'delete' THEN CASE WHEN v>0 THEN 'deleted' ELSE 'missing' END WHEN 'read' THEN CASE WHEN v>0 THEN 'found' ELSE 'missing' END
 WHEN 'begin' THEN CASE WHEN v=0 OR request IS NULL THEN 'missing' WHEN held IS NOT NULL THEN held.status ELSE 'started' END
 WHEN 'complete' THEN CASE WHEN held IS NULL THEN 'missing' WHEN held.status='completed' THEN 'completed' WHEN strlen(response)>1024 THEN 'finished_without_replay' ELSE 'finished' END
 ELSE CASE WHEN held.status='completed' THEN 'replayed' WHEN action='new_thread' AND v=0 THEN 'missing' WHEN expected IS NOT NULL AND expected<>v THEN 'conflict' ELSE 'applied' END END AS o
FROM (SELECT *, list_filter(live, lambda x: x.id=request)[1] AS held, CASE WHEN request IS NULL THEN live ELSE list_filter(live, lambda x: x.id<>request) END AS others
FROM (SELECT u.*, f.expires, CASE WHEN f.expires>now THEN version ELSE 0 END AS v, CASE WHEN f.expires>now THEN f.messages ELSE [] END AS ms, CASE WHEN f.expires>now THEN f.topics ELSE [] END AS tp, CASE WHEN f.expires>now THEN f.summary ELSE '' END AS sm,
 list_filter(f.requests, lambda x: x.expires>now) AS live FROM f JOIN u ON u.key=f.key AND u.n=f.n+1))))
SELECT key, place, outcome, version, len(messages)::BIGINT AS messages, array_to_string(topics,',') AS topics, summary, md5(answer) AS response FROM f WHERE n>0"""


@query(_MEMORY)
def stream_memory(spark: SparkSession, sf: str) -> DataFrame:
    """Events as updates of a memory whose records live two days: kinds are topics, requests come again, responses grow with the value."""
    kinds = F.array(*map(F.lit, ("append", "append", "begin", "complete", "read", "append", "begin", "complete")))
    i = F.col("event_id")
    updates = _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), i.alias("place"), F.when(i % 16 == 15, "delete").when(i % 16 == 7, "new_thread").otherwise(F.get(kinds, (i % 8).cast("int"))).alias("action"),
        F.when(i % 8 != 0, F.concat(F.lit("r"), F.floor("value") % 3)).alias("request_id"), F.col("props").alias("message"), F.col("event_type").alias("topic"),
        F.when(i % 5 == 0, i % 4).alias("expected"), F.expr("repeat(props, cast(floor(value) as int))").alias("response"),
    )
    folder = _folder(spark)
    return M.run(M.memory(updates, M.Limits(memory_hours=48, messages=4, topics=3, replay_bytes=1024)), folder).withColumn("response", F.md5(F.col("response").cast("binary")))
