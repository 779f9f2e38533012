"""Registered queries: run metrics, retention, parity and payload functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluicework.functions.envelopes import canonical_json, from_envelope, to_envelope
from sluicework.functions.texts import mask_text, payload_kind, payload_profile
from sluicework.operators import metrics, parity, retention, shaping
from sluicework.operators.dedup import latest_per_key
from sluicework.plans.fixtures import doubled_events, orders_text, with_views
from sluicework.plans.registry import query, table

TAU = 7_200.0


@query(
    "run_counts",
    with_views("doubled_events")
    + """SELECT count(*) AS rows_read, count(DISTINCT event_id) AS rows_delivered,
         count(*) - count(DISTINCT event_id) AS redelivered FROM doubled_events""",
)
def run_counts(spark, sf):
    return metrics.run_counts(doubled_events(spark, sf), "event_id")


_ELAPSED = "date_diff('microsecond', min(ts), max(ts)) / 1000000.0"


@query(
    "throughput",
    f"""SELECT event_type, count(*) AS rows, {_ELAPSED} AS elapsed_s,
        CAST(round(count(*) / ({_ELAPSED})) AS BIGINT) AS rows_per_second FROM events GROUP BY event_type""",
)
def throughput(spark, sf):
    return metrics.throughput(table(spark, sf, "events"), "ts", ["event_type"])


@query("tick_counts", "SELECT date_trunc('hour', ts) AS tick, event_type, count(*) AS n FROM events GROUP BY ALL")
def tick_counts(spark, sf):
    return metrics.tick_counts(table(spark, sf, "events"), "ts", "1 hour", ["event_type"])


@query(
    "tick_counts_fine",
    """SELECT time_bucket(INTERVAL '200 milliseconds', ts, TIMESTAMP '1970-01-01') AS tick, count(*) AS n
       FROM events GROUP BY ALL""",
)
def tick_counts_fine(spark, sf):
    return metrics.tick_counts(table(spark, sf, "events"), "ts", "200 milliseconds")


def _samples(spark, sf):
    """Cumulative counts per event type and hour."""
    ticks = metrics.tick_counts(table(spark, sf, "events"), "ts", "1 hour", ["event_type"])
    so_far = Window.partitionBy("event_type").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return ticks.select("event_type", "tick", F.sum("n").over(so_far).alias("total"))


_SAMPLES = """ticks AS (SELECT event_type, date_trunc('hour', ts) AS tick, count(*) AS n FROM events GROUP BY ALL),
    samples AS (SELECT event_type, tick, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY tick) AS BIGINT) AS total FROM ticks)"""
_EWMA = f"""WITH RECURSIVE {_SAMPLES},
    linked AS (SELECT *, row_number() OVER w AS rn, date_diff('second', lag(tick) OVER w, tick)::DOUBLE AS dt,
               (total - lag(total) OVER w)::DOUBLE AS grown FROM samples WINDOW w AS (PARTITION BY event_type ORDER BY tick)),
    walk AS (SELECT event_type, tick, total, rn, 0.0::DOUBLE AS rate FROM linked WHERE rn = 1
      UNION ALL
      SELECT l.event_type, l.tick, l.total, l.rn,
        (1 - exp(-l.dt / 7200)) * l.grown / l.dt + exp(-l.dt / 7200) * w.rate
      FROM walk w JOIN linked l ON l.event_type = w.event_type AND l.rn = w.rn + 1) """


@query("ewma_rate", _EWMA + "SELECT event_type, tick, total, round(rate, 9) AS rate FROM walk")
def ewma_rate(spark, sf):
    rates = metrics.ewma_rate(_samples(spark, sf), "event_type", "tick", "total", TAU)
    return rates.withColumn("rate", F.round("rate", 9))


_ELAPSED_SQL = """SELECT event_type, max(total) AS messages,
    date_diff('microsecond', min(tick), max(tick)) / 1000000.0 AS elapsed_s,
    round(max(total) / (date_diff('microsecond', min(tick), max(tick)) / 1000000.0), 9) AS average_per_second
    FROM samples GROUP BY event_type"""


@query("elapsed_and_average", f"WITH {_SAMPLES} {_ELAPSED_SQL}")
def elapsed_and_average(spark, sf):
    done = metrics.elapsed_and_average(_samples(spark, sf), "event_type", "tick", "total")
    return done.withColumn("average_per_second", F.round("average_per_second", 9))


@query(
    "route_status",
    _EWMA + f""", done AS ({_ELAPSED_SQL}),
    now AS (SELECT event_type, round(arg_max(rate, tick), 9) AS messages_per_second FROM walk GROUP BY event_type)
    SELECT done.*, messages_per_second FROM done JOIN now USING (event_type)""",
)
def route_status(spark, sf):
    status = metrics.route_status(_samples(spark, sf), "event_type", "tick", "total", tau=TAU)
    return status.withColumns({c: F.round(c, 9) for c in ("average_per_second", "messages_per_second")})


@query(
    "outcome_class",
    """SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 16 THEN 'failed'
       WHEN count(*) FILTER (WHERE value < 40) < count(*) THEN 'completed_with_drops' ELSE 'completed' END AS outcome
       FROM events GROUP BY user_id""",
)
def outcome_class(spark, sf):
    counted = table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("read"), F.count_if(F.col("value") < 40).alias("delivered"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )
    failed = (F.col("errors") > 16).cast("int")
    return counted.select("user_id", metrics.outcome(F.col("read"), F.col("delivered"), failed).alias("outcome"))


@query(
    "latency_quantiles",
    """SELECT event_type, p, round(v, 9) AS v FROM (
         SELECT event_type, 0.5::DOUBLE AS p, quantile_cont(value, 0.5) AS v FROM events GROUP BY 1 UNION ALL
         SELECT event_type, 0.95::DOUBLE, quantile_cont(value, 0.95) FROM events GROUP BY 1 UNION ALL
         SELECT event_type, 0.99::DOUBLE, quantile_cont(value, 0.99) FROM events GROUP BY 1)""",
)
def latency_quantiles(spark, sf):
    found = metrics.latency_quantiles(table(spark, sf, "events"), "value", ["event_type"])
    return found.withColumn("v", F.round("v", 9))


@query("totals", "SELECT event_type, count(*) AS messages FROM events GROUP BY event_type")
def totals(spark, sf):
    return metrics.totals(table(spark, sf, "events"), "event_type")


@query(
    "rejection_summary",
    with_views("orders_text")
    + """SELECT '$.o_totalprice' AS path, CASE WHEN o_totalprice IS NULL THEN 'missing_required' ELSE 'coercion' END AS code,
         count(*) AS n FROM orders_text WHERE o_totalprice IS NULL OR o_totalprice = 'oops' GROUP BY ALL""",
)
def rejection_summary(spark, sf):
    schema = {"properties": {"o_totalprice": {"type": "number"}}, "required": ["o_totalprice"]}
    _, rejects = shaping.split_by_error(shaping.type_columns(orders_text(spark, sf), schema))
    return metrics.rejection_summary(shaping.error_parts(rejects))


@query(
    "run_stats",
    """SELECT o_orderpriority, round(median(o_totalprice), 4) AS median, round(stddev_pop(o_totalprice), 4) AS stddev,
       count(*) AS runs FROM orders GROUP BY 1""",
)
def run_stats(spark, sf):
    stats = metrics.run_stats(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"])
    return stats.withColumns({c: F.round(c, 4) for c in ("median", "stddev")})


@query(
    "keep_last",
    """SELECT event_type, event_id, rank FROM (SELECT event_type, event_id,
       row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 20""",
)
def keep_last(spark, sf):
    kept = retention.keep_last(table(spark, sf, "events"), 20, "event_type", ["ts", "event_id"])
    return kept.select("event_type", "event_id", "rank")


@query(
    "cap_stream",
    """SELECT event_type, event_id FROM events
       QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1500""",
)
def cap_stream(spark, sf):
    """A cap over the group limit: positions in a range sort."""
    events = table(spark, sf, "events").select("event_type", "event_id", "ts")
    return retention.cap_stream(events, "event_type", 1500, ["ts", "event_id"]).select("event_type", "event_id")


@query(
    "latest_per_key",
    """SELECT user_id, event_id, event_type FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return latest_per_key(events, "user_id", ["ts", "event_id"]).drop("ts")


@query("expire_rows", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 48 HOUR")
def expire_rows(spark, sf):
    now = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return retention.expire_rows(table(spark, sf, "events").select("event_id", "ts"), "ts", 48 * 3600, now)


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query(
    "parity_doctored",
    """SELECT l_orderkey, l_linenumber, side FROM (
         SELECT l_orderkey, l_linenumber, 'left' AS side FROM lineitem WHERE l_orderkey % 50 = 0 OR l_orderkey % 101 = 1
         UNION ALL
         SELECT l_orderkey, l_linenumber, 'right' FROM lineitem WHERE l_orderkey % 50 = 0 AND l_orderkey % 101 <> 1)""",
)
def parity_doctored(spark, sf):
    left = _lines(spark, sf)
    changed = F.when(F.col("l_orderkey") % 50 == 0, F.col("l_quantity") + 1000).otherwise(F.col("l_quantity"))
    right = left.where("l_orderkey % 101 != 1").withColumn("l_quantity", changed)
    found = parity.parity(left, right)
    key = F.from_json("record", "l_orderkey bigint, l_linenumber int")
    copies = F.expr("explode(sequence(1L, abs(left_n - right_n)))")
    side = F.when(F.col("left_n") > F.col("right_n"), "left").otherwise("right")
    return found.select(key.alias("k"), side.alias("side"), copies).select("k.l_orderkey", "k.l_linenumber", "side")


@query("parity_by_value", "SELECT count(*) AS differences FROM lineitem WHERE l_quantity <> l_quantity")
def parity_by_value(spark, sf):
    """Whole quantities as 7.0 on one side and 7 on the other: equal by value."""
    left = _lines(spark, sf)
    right = left.withColumn("l_quantity", F.col("l_quantity").cast("bigint"))
    return parity.parity(left, right, numeric=True).agg(F.count(F.lit(1)).alias("differences"))


@query(
    "parity_by_type",
    "SELECT 2 * count(DISTINCT (l_orderkey, l_linenumber, l_quantity, l_returnflag)) AS differences FROM lineitem",
)
def parity_by_type(spark, sf):
    left = _lines(spark, sf)
    right = left.withColumn("l_quantity", F.col("l_quantity").cast("bigint"))
    return parity.parity(left, right).agg(F.count(F.lit(1)).alias("differences"))


@query(
    "exactly_once",
    """SELECT o_orderkey, CAST(1 AS BIGINT) AS expected_n, CAST(CASE WHEN o_orderkey % 40 = 0 THEN 0 ELSE 2 END AS BIGINT) AS actual_n,
       CASE WHEN o_orderkey % 40 = 0 THEN 'lost' ELSE 'repeated' END AS problem
       FROM orders WHERE o_orderkey % 40 = 0 OR o_orderkey % 40 = 7""",
)
def exactly_once(spark, sf):
    source = table(spark, sf, "orders").select("o_orderkey")
    sink = source.where("o_orderkey % 40 != 0").unionByName(source.where("o_orderkey % 40 = 7"))
    return parity.exactly_once(source, sink, ["o_orderkey"])


@query(
    "branch_accounting",
    """SELECT o_orderkey, CAST(2 AS BIGINT) AS expected_n, CAST(1 AS BIGINT) AS actual_n FROM orders
       WHERE o_orderpriority = '5-LOW'""",
)
def branch_accounting(spark, sf):
    orders = table(spark, sf, "orders")
    routed = orders.where("o_orderpriority != '5-LOW'")
    return parity.branch_accounting(orders, [orders, routed], 2, ["o_orderkey"])


@query(
    "envelope_build",
    """SELECT CAST(c_custkey AS VARCHAR) AS message_id, c_custkey, c_name, c_mktsegment AS segment FROM customer""",
)
def envelope_build(spark, sf):
    customers = table(spark, sf, "customer")
    wrapped = to_envelope(
        customers.select("c_custkey", "c_name", "c_mktsegment"),
        metadata=F.create_map(F.lit("segment"), F.col("c_mktsegment")), message_id=F.col("c_custkey"),
    )
    opened = from_envelope(wrapped)
    return opened.select(
        "message_id", F.variant_get("doc", "$.c_custkey", "bigint").alias("c_custkey"),
        F.variant_get("doc", "$.c_name", "string").alias("c_name"), F.col("metadata")["segment"].alias("segment"),
    )


@query("envelope_text_payload", "SELECT doc_id, md5(text) AS text_md5, true AS is_text FROM documents")
def envelope_text_payload(spark, sf):
    docs = table(spark, sf, "documents")
    wrapped = to_envelope(docs, payload=F.col("text"), message_id=F.col("doc_id"))
    opened = from_envelope(wrapped)
    return opened.select(
        F.col("message_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"),
        F.col("doc").isNull().alias("is_text"),
    )


@query("canonical_json", "SELECT event_id, '{\"a\":' || event_id || ',\"b\":\"' || event_type || '\"}' AS canonical FROM events")
def canonical(spark, sf):
    text = F.concat(F.lit('{ "b" : "'), "event_type", F.lit('", "a":'), F.col("event_id").cast("string"), F.lit(" }"))
    return table(spark, sf, "events").select("event_id", canonical_json(text).alias("canonical"))


def _payloads(spark, sf):
    n = F.col("event_id") % 5
    body = (
        F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("<e>"), "event_type", F.lit("</e>")))
        .when(n == 2, F.concat("event_type", F.lit("\x01"))).when(n == 3, F.concat(F.lit("{"), "event_type"))
        .otherwise(F.lit(' <?xml version="1.0"?><a/> '))
    )
    events = table(spark, sf, "events").select(body.alias("body"))
    pages = table(spark, sf, "pages").select(F.col("html").alias("body"))
    return events.unionByName(pages).unionByName(table(spark, sf, "documents").select(F.col("text").alias("body")))


@query(
    "payload_profile",
    r"""WITH bodies AS (
        SELECT CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '<e>' || event_type || '</e>' WHEN 2 THEN event_type || chr(1)
               WHEN 3 THEN '{' || event_type ELSE ' <?xml version="1.0"?><a/> ' END AS body FROM events
        UNION ALL SELECT html FROM pages UNION ALL SELECT text FROM documents),
      trimmed AS (SELECT body, regexp_replace(body, '^\s+|\s+$', '', 'g') AS b FROM bodies),
      kinds AS (SELECT body, CASE
        WHEN ((starts_with(b, '{') AND ends_with(b, '}')) OR (starts_with(b, '[') AND ends_with(b, ']'))) AND json_valid(b) THEN 'json'
        WHEN (regexp_matches(b, '^<\?xml[\s?>]', 'i') AND ends_with(b, '>'))
          OR regexp_matches(b, '^<[A-Za-z_][\w:.-]*(\s[^>]*)?>.*</[A-Za-z_][\w:.-]*>$', 's')
          OR regexp_matches(b, '^<[A-Za-z_][\w:.-]*(\s[^>]*)?/>$', 's') THEN 'xml'
        WHEN regexp_matches(body, '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]') THEN 'hex' ELSE 'text' END AS kind FROM trimmed)
      SELECT kind, count(*) AS n, CAST(sum(strlen(body)) AS BIGINT) AS bytes FROM kinds GROUP BY kind""",
)
def profile(spark, sf):
    return payload_profile(_payloads(spark, sf), "body")


@query(
    "mask_credentials",
    """SELECT page_id, 'https://svc:***@' || substr(url, strpos(url, '://') + 3) ||
         CASE WHEN contains(url, '?') THEN '&' ELSE '?' END ||
         'Api_Token=***&partition_key=k' || page_id || '|encryption?key=***|dedup?key=id' AS uri FROM pages""",
)
def mask(spark, sf):
    uri = F.concat(
        F.lit("https://svc:p@ss"), F.col("page_id").cast("string"), F.lit("@"),
        F.expr("substr(url, instr(url, '://') + 3)"), F.when(F.col("url").contains("?"), "&").otherwise("?"),
        F.lit("Api_Token=t=1&partition_key=k"), F.col("page_id").cast("string"), F.lit("|encryption?key=abc|dedup?key=id"),
    )
    return table(spark, sf, "pages").select("page_id", mask_text(uri).alias("uri"))


@query("payload_kind_rows", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'json' ELSE 'text' END AS kind FROM events")
def kind_rows(spark, sf):
    body = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", payload_kind(body).alias("kind"))
