"""Queries that run streams to completion over the given tables and return what they stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchwatch.functions import quantiles
from batchwatch.plans.quality import CONTRACT, KEYS, rules
from batchwatch.plans.registry import query
from batchwatch.plans.sqltext import FLAGGED
from batchwatch.plans.views import base, view, with_views
from batchwatch.sources.storage import fresh_path
from batchwatch.streaming import assemble, feeds, ingest

CLOCK = "2024-01-31 00:00:00"


def _stream(spark, sf_dir, table):
    # A pattern, so that the table may be one file or a folder of files.
    return feeds.file_stream(spark, f"{sf_dir}/{table}.parque[t]", base(spark, sf_dir, table))


@query("stream_ingest", with_views(f"""WITH {FLAGGED.strip()}, one AS (SELECT concat('batch-', CAST(l_linenumber AS STRING)) AS run_id, is_quarantined FROM counted)
  SELECT run_id, count(*) AS rows_in, count(*) FILTER (NOT is_quarantined) AS rows_out, count(*) FILTER (is_quarantined) AS rows_removed,
  CASE WHEN count(*) FILTER (NOT is_quarantined) > 0 THEN 'processed' ELSE 'failed' END AS status FROM one GROUP BY run_id"""))
def stream_ingest(spark, sf_dir):
    """CSV batches (one folder per line number) arrive, are cleaned and stored; the ledger is returned."""
    folder, work = fresh_path(spark, "incoming"), fresh_path(spark, "ingest")
    raw = view(spark, sf_dir, "lineitem_raw").withColumn("b", F.concat(F.lit("batch-"), F.col("l_linenumber").cast("string")))
    columns = [*KEYS, *CONTRACT]
    # Folder names without "key=": the run id comes from the path, as it would for uploaded files.
    tagged = raw.select(F.col("b").alias("batch"), *columns)
    tagged.write.partitionBy("batch").option("header", True).option("quoteAll", True).option("emptyValue", "").csv(folder)
    stream = ingest.incoming(spark, folder, columns, r"batch=([^/]+)/[^/]+$")
    return ingest.ingest(stream, rules(spark, sf_dir), work, keep=KEYS)


@query("stream_runs", with_views(f"""WITH {FLAGGED.strip()}, one AS (SELECT concat('batch-', CAST(l_linenumber AS STRING)) AS run_id, is_quarantined FROM counted),
  r AS (SELECT run_id, count(*) AS total_rows, count(*) FILTER (NOT is_quarantined) AS cleaned_rows FROM one GROUP BY run_id)
  SELECT run_id, total_rows, cleaned_rows, total_rows - cleaned_rows AS rows_removed, CAST(0 AS BIGINT) AS failed_checks, round(cleaned_rows / total_rows, 6) AS clean_row_ratio,
    CASE WHEN cleaned_rows >= 10 AND cleaned_rows / total_rows >= 0.5 THEN 'success' ELSE 'failed' END AS status FROM r"""))
def stream_runs(spark, sf_dir):
    """Batches that arrive in two halves, with columns in another order in each: nothing is done before the manifest has come, then
    every run is processed once, as a whole."""
    folder, work = fresh_path(spark, "arriving"), fresh_path(spark, "assembled")
    raw = view(spark, sf_dir, "lineitem_raw").withColumn("run", F.concat(F.lit("batch-"), F.col("l_linenumber").cast("string")))
    columns = [*KEYS, *CONTRACT]
    early = F.pmod(F.xxhash64(*KEYS), F.lit(2)) == 0

    def deliver(rows, names):
        out = rows.select("run", *names).write.partitionBy("run").option("header", True).option("quoteAll", True)
        out.option("emptyValue", "").mode("append").csv(folder)

    deliver(raw.filter(early), columns)
    assert assemble.ingest_runs(spark, folder, rules(spark, sf_dir), work, KEYS).isEmpty()
    deliver(raw.filter(~early), columns[::-1])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    names = files.select(assemble.run_of("path").alias("run"), F.element_at(F.split("path", "/"), -1).alias("name"))
    names.groupBy("run").agg(F.collect_list("name").alias("files")).repartition("run").write.partitionBy("run").mode("append").json(folder)
    ledger = assemble.ingest_runs(spark, folder, rules(spark, sf_dir), work, KEYS)
    return ledger.select("run_id", "total_rows", "cleaned_rows", "rows_removed", "failed_checks", F.round("clean_row_ratio", 6).alias("clean_row_ratio"), "status")


_RUNS = """o_orderkey AS run_id, o_custkey AS model_id, o_orderdate AS created_at"""


@query("stream_sweep", with_views("""SELECT tenant_id, run_id, model_id, created_at FROM (SELECT r.run_id, r.model_id, r.created_at, m.tenant_id,
    row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, run_id DESC) AS p FROM pipeline_runs r JOIN ml_models m ON r.model_id = m.model_id) WHERE p = 1
  AND run_id NOT IN (SELECT run_id FROM pipeline_runs WHERE model_id % 2 = 0)"""))
def stream_sweep(spark, sf_dir):
    runs = _stream(spark, sf_dir, "orders").selectExpr(*_RUNS.split(", "))
    analysed = view(spark, sf_dir, "pipeline_runs").filter("model_id % 2 = 0")
    return ingest.sweep(runs, view(spark, sf_dir, "ml_models"), analysed, fresh_path(spark, "sweep"))


@query("stream_incidents", """SELECT user_id AS run_id, arg_max(event_type, (ts, event_id)) AS state, max(event_id) FILTER (true) AS last_change FROM events GROUP BY user_id""")
def stream_incidents(spark, sf_dir):
    """Change feed to latest state per run, kept in update mode."""
    changes = _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("state"), F.col("event_id").alias("last_change"), "ts"
    )
    latest = feeds.latest_state(changes, ["run_id"], ["state", "last_change"], ["ts", "last_change"])
    table = feeds.stream_to_table(latest, fresh_path(spark, "incidents"), "update")
    return feeds.newest_epoch(table, ["run_id"])


@query("step_status", with_views("""WITH last AS (SELECT run_id, step_index, arg_max(status, seq) AS status FROM agent_steps GROUP BY run_id, step_index)
  SELECT run_id, step_index, CASE WHEN run_id % 3 = 0 AND status IN ('pending', 'running') THEN 'done' WHEN run_id % 3 = 1 AND status = 'running' THEN 'error' ELSE status END AS status FROM last"""))
def step_status(spark, sf_dir):
    """Step updates as a stream; a third of the runs complete and a third fail."""
    steps = _stream(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), (F.col("turn") % 4).alias("step_index"), F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", "running").otherwise("done").alias("status"),
    )
    latest = feeds.latest_state(steps, ["run_id", "step_index"], ["status", "seq"], ["seq"])
    table = feeds.newest_epoch(feeds.stream_to_table(latest, fresh_path(spark, "steps"), "update"), ["run_id", "step_index"])
    ended = table.select("run_id").distinct().select(
        "run_id", F.when(F.col("run_id") % 3 == 0, "run_complete").when(F.col("run_id") % 3 == 1, "run_failed").alias("event")
    )
    return feeds.close_steps(table.drop("seq"), ended)


@query("dedupe_events", """SELECT event, run_id, message, min(event_id) AS event_id, count(*) AS copies FROM (SELECT CASE WHEN event_type = 'signup' THEN 'ping' ELSE event_type END AS event,
  user_id AS run_id, props AS message, event_id FROM events) WHERE event NOT IN ('ping', 'connected') GROUP BY event, run_id, message""")
def dedupe_events(spark, sf_dir):
    live = base(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "signup", "ping").otherwise(F.col("event_type")).alias("event"),
        F.col("user_id").alias("run_id"), F.col("props").alias("message"), "event_id",
    )
    return feeds.dedupe_batch(live, ["event", "run_id", "message"], "event_id")


@query("heartbeat_age", f"""SELECT user_id, max(ts) AS last_seen, CAST(floor(epoch(TIMESTAMP '{CLOCK}' - max(ts))) AS BIGINT) AS age_seconds,
  floor(epoch(TIMESTAMP '{CLOCK}' - max(ts))) <= 120 AS healthy FROM events GROUP BY user_id""")
def heartbeat_age(spark, sf_dir):
    return feeds.heartbeat_age(base(spark, sf_dir, "events"), "user_id", F.lit(CLOCK).cast("timestamp_ntz"))


@query("event_rate", """SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS events, round(count(*) / 60, 6) AS per_second,
  round(count(*) FILTER (value > 20) / count(*), 6) AS error_rate FROM events GROUP BY ALL""")
def event_rate(spark, sf_dir):
    """Rates from a stream in update mode."""
    rates = feeds.event_rate(_stream(spark, sf_dir, "events"), "event_type", F.col("value") > 20)
    table = feeds.newest_epoch(feeds.stream_to_table(rates, fresh_path(spark, "rates"), "update"), ["minute", "event_type"])
    return table.withColumns({c: F.round(c, 6) for c in ("per_second", "error_rate")})


@query("latency_quantiles", """SELECT date_trunc('minute', ts) AS minute, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99 FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latency_quantiles(spark, sf_dir):
    """Exact quantiles per minute (the stream form uses one sketch per minute)."""
    events = base(spark, sf_dir, "events").withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    long = quantiles.numeric_long(events, ["value"], ["minute"])
    hist = quantiles.value_histogram(long, ["minute"])
    found = quantiles.exact_quantiles(hist, ["minute"], (0.5, 0.95, 0.99))
    return found.select("minute", "n", *[F.round(F.get("q", F.lit(i)), 6).alias(p) for i, p in enumerate(("p50", "p95", "p99"))])
