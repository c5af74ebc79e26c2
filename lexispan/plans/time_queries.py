"""Timelines, sessions, joins by time and upkeep over the tables. Users are sessions, their events the timed words."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexispan.functions import numeric as N
from lexispan.operators import spans as S
from lexispan.operators import timeline as L
from lexispan.streaming import sessions as X

from .registry import query, table

BY, ORDER = ["user_id"], ["event_id"]
#: Seconds since the first of the year, an end that is sometimes before the start, and values that are sometimes missing.
EV = """(SELECT event_id, user_id, event_type, value, epoch(ts) - 1704067200 AS s, epoch(ts) - 1704067200 + (value % 9) * 3000 - 4000 AS e, CASE WHEN event_id % 3 = 0 THEN value END AS v, CASE WHEN event_id % 4 <> 1 THEN epoch(ts) - 1704067200 END AS ms, CASE WHEN event_id % 5 <> 2 THEN epoch(ts) - 1704067200 + value END AS me FROM events)"""


def events(spark, sf_dir):
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    e = table(spark, sf_dir, "events").withColumn("s", s)
    return e.select("event_id", "user_id", "event_type", "value", "s", (F.col("s") + (F.col("value") % 9) * 3000 - 4000).alias("e"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 4 != 1, F.col("s")).alias("ms"), F.when(F.col("event_id") % 5 != 2, F.col("s") + F.col("value")).alias("me"))


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 3) for n in names})


W = "(PARTITION BY user_id ORDER BY event_id"


@query(f"SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER {W} ROWS UNBOUNDED PRECEDING) AS before, first_value(v IGNORE NULLS) OVER {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM {EV}")
def forward_backward_fill(spark, sf_dir):
    v = F.col("v")
    return events(spark, sf_dir).select("event_id", "user_id", L.forward_fill(v, BY, ORDER).alias("before"), L.backward_fill(v, BY, ORDER).alias("after"))


@query(f"""SELECT event_id, user_id, round(CASE WHEN b THEN greatest(ms, coalesce(p, ms)) ELSE ms END, 3) AS ms, round(CASE WHEN b THEN t ELSE me END, 3) AS me FROM (SELECT *, ms IS NOT NULL AND me IS NOT NULL AS b, max(CASE WHEN ms IS NOT NULL AND me IS NOT NULL THEN greatest(ms, me) END) OVER {W} ROWS UNBOUNDED PRECEDING) AS t,
max(CASE WHEN ms IS NOT NULL AND me IS NOT NULL THEN greatest(ms, me) END) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {EV})""")
def smooth_times(spark, sf_dir):
    return rounded(L.smooth(events(spark, sf_dir), "ms", "me", BY, ORDER).select("event_id", "user_id", "ms", "me"), "ms", "me")


@query(f"SELECT event_id, user_id, round(max(e) OVER {W} ROWS UNBOUNDED PRECEDING), 3) AS e FROM {EV}")
def monotone_clamp(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "user_id", F.round(L.monotone(F.col("e"), BY, ORDER), 3).alias("e"))


@query(f"SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER {W}) AS l FROM events) WHERE l IS DISTINCT FROM event_type")
def run_dedup(spark, sf_dir):
    return L.run_starts(events(spark, sf_dir), "event_type", BY, ORDER).select("event_id", "user_id", "event_type")


@query(f"SELECT event_id, user_id, CAST(sum(n) OVER {W}) AS BIGINT) AS session FROM (SELECT *, CASE WHEN s - lag(e) OVER {W}) > 20000 THEN 1 ELSE 0 END AS n FROM {EV})")
def gap_sessions(spark, sf_dir):
    return L.sessions(events(spark, sf_dir), "s", "e", 20000.0, BY, ORDER).select("event_id", "user_id", "session")


CAPPED = f"""(SELECT *, (row_number() OVER (PARTITION BY user_id, session ORDER BY event_id) - 1) // 4 AS part FROM (SELECT *, sum(n) OVER {W}) AS session FROM (SELECT *, CASE WHEN s - max(e) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 9000 THEN 1 ELSE 0 END AS n FROM {EV})))"""


@query(f"SELECT event_id, user_id, CAST(session AS BIGINT) AS session, CAST(part AS BIGINT) AS part FROM {CAPPED}")
def capped_segments(spark, sf_dir):
    return L.capped_segments(events(spark, sf_dir), "s", "e", 9000.0, 4, BY, ORDER).select("event_id", "user_id", "session", "part")


@query(f"SELECT user_id, CAST(session AS BIGINT) AS session, CAST(part AS BIGINT) AS part, round(min(s), 3) AS start_s, round(max(e), 3) AS end_s, round(avg(value), 6) AS probability, string_agg(event_type, ' ' ORDER BY event_id) AS text FROM {CAPPED} GROUP BY user_id, session, part")
def segment_rollup(spark, sf_dir):
    x = L.capped_segments(events(spark, sf_dir), "s", "e", 9000.0, 4, BY, ORDER)
    words = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda r: r["event_type"])
    return x.groupBy("user_id", "session", "part").agg(F.round(F.min("s"), 3).alias("start_s"), F.round(F.max("e"), 3).alias("end_s"), F.round(F.avg("value"), 6).alias("probability"), F.array_join(words, " ").alias("text"))


@query(f"""SELECT event_id, user_id, ms IS NULL OR me IS NULL AS estimated, round(a, 3) AS ms, round(coalesce(me, n, a), 3) AS me FROM (SELECT *, coalesce(ms, le, n) AS a FROM (SELECT *, last_value(me IGNORE NULLS) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le, first_value(ms IGNORE NULLS) OVER {W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM {EV}))""")
def fill_times(spark, sf_dir):
    return rounded(L.fill_times(events(spark, sf_dir), "ms", "me", BY, ORDER).select("event_id", "user_id", "estimated", "ms", "me"), "ms", "me")


CONV = r"(SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w, turn * 10.0 AS a, turn * 10.0 + length(text) % 4 AS b FROM conversations)"


@query(f"""SELECT conv_id, turn, k, w[k + 1] AS word, round(CASE WHEN b > a THEN a + (b - a) * k / n ELSE a END, 6) AS w_start, round(CASE WHEN b > a THEN a + (b - a) * (k + 1) / n ELSE b END, 6) AS w_end FROM (SELECT *, len(w) AS n, CAST(unnest(range(len(w))) AS INTEGER) AS k FROM {CONV})""")
def interpolate_times(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    x = c.select("conv_id", "turn", (F.col("turn") * 10.0).alias("a"), (F.col("turn") * 10.0 + F.length("text") % 4).alias("b"), F.size(w).alias("n"), F.posexplode(w).alias("k", "word"))
    return L.interpolate(x, "a", "b", "k", "n").select("conv_id", "turn", "k", "word", F.round("w_start", 6).alias("w_start"), F.round("w_end", 6).alias("w_end"))


SEGMENTS = r"""(SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n, length(text) % 5 AS words FROM conversations)"""


@query(f"SELECT conv_id, turn, CAST(n AS INTEGER) AS n, CAST(words AS INTEGER) AS words, (n >= 4 AND words / n < 0.6) OR (n >= 3 AND words = 1) AS broken, n >= 3 AS counted FROM {SEGMENTS}")
def broken_word_timing(spark, sf_dir):
    n = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"), (F.length("text") % 5).alias("words"))
    broken = ((F.col("n") >= 4) & (F.col("words") / F.col("n") < 0.6)) | ((F.col("n") >= 3) & (F.col("words") == 1))
    return x.withColumn("broken", F.coalesce(broken, F.lit(False))).withColumn("counted", F.col("n") >= 3)


@query("""WITH d AS (SELECT user_id, event_type, min(epoch(ts)) - 1704067200 AS a, max(epoch(ts)) - 1704067200 AS b, count(*) AS n, min(CASE WHEN event_id % 2 = 0 THEN epoch(ts) END) - 1704067200 AS ra FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type, CAST(n AS BIGINT) AS n, round(coalesce(ra, a), 3) AS start_s, round(b, 3) AS end_s, ra IS NULL AS estimated FROM d""")
def group_time_rollup(spark, sf_dir):
    """Real times (of even events) before estimated ones."""
    real = F.when(F.col("event_id") % 2 == 0, F.col("s"))
    g = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min(real).alias("ra"), F.min("s").alias("a"), F.max("s").alias("b"))
    return g.select("user_id", "event_type", "n", F.round(F.coalesce("ra", "a"), 3).alias("start_s"), F.round("b", 3).alias("end_s"), F.col("ra").isNull().alias("estimated"))


@query("""WITH slots AS (SELECT l_suppkey AS k, l_linenumber AS slot, max(l_quantity * l_linenumber) AS e FROM lineitem GROUP BY ALL), b AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY k ORDER BY e, slot), -1e308) AS f FROM slots)
SELECT event_id, k, slot, CAST(row_number() OVER (PARTITION BY k, slot ORDER BY value, event_id) - 1 AS INTEGER) AS idx FROM events JOIN b ON user_id = k AND value >= f AND value < e""")
def interval_join_slots(spark, sf_dir):
    ends = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("slot")).agg(F.max(F.col("l_quantity") * F.col("l_linenumber")).alias("e"))
    points = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), "value")
    idx = F.row_number().over(Window.partitionBy("k", "slot").orderBy("value", "event_id")) - 1
    return L.into_slots(points, ends, "k", "value", "slot", "e", 25.0).select("event_id", "k", "slot", idx.alias("idx"))


@query("SELECT e.event_id, e.user_id, o.event_id AS last_error FROM (SELECT event_id, user_id FROM events WHERE event_type <> 'error') e ASOF JOIN (SELECT event_id, user_id FROM events WHERE event_type = 'error') o ON e.user_id = o.user_id AND e.event_id >= o.event_id")
def asof_prev(spark, sf_dir):
    """The last error at or before each other event of its user: one pass over both, in order."""
    last = L.forward_fill(F.when(F.col("event_type") == "error", F.col("event_id")), BY, ORDER)
    return events(spark, sf_dir).withColumn("last_error", last).where("event_type <> 'error' and last_error is not null").select("event_id", "user_id", "last_error")


REPORT = """WITH n AS (SELECT l_orderkey, l_linenumber, avg(epoch(l_shipdate)) / 86400 AS t FROM lineitem GROUP BY ALL), o AS (SELECT o_orderkey, epoch(o_orderdate) / 86400 AS u FROM orders), d AS (SELECT o_orderkey % 100 AS g, t - u AS d, t, u FROM o LEFT JOIN n ON o_orderkey = l_orderkey)"""


@query(f"{REPORT} SELECT g, CAST(count(*) AS BIGINT) AS n, CAST(count(d) AS BIGINT) AS matched, count(d) = count(*) AS complete, round(avg(abs(d)), 6) AS mae, round(max(abs(d)), 6) AS most, round(median(abs(d)), 6) AS middle FROM d GROUP BY g")
def timing_error_report(spark, sf_dir):
    days = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 86400e6
    new = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.avg(days("l_shipdate")).alias("t"))
    old = table(spark, sf_dir, "orders").select("o_orderkey", days("o_orderdate").alias("u"))
    d = old.join(new, F.col("o_orderkey") == F.col("l_orderkey"), "left").select((F.col("o_orderkey") % 100).alias("g"), F.abs(F.col("t") - F.col("u")).alias("d"))
    return d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("matched"), (F.count("d") == F.count(F.lit(1))).alias("complete"), F.round(F.avg("d"), 6).alias("mae"), F.round(F.max("d"), 6).alias("most"), F.round(F.percentile("d", F.lit(0.5)), 6).alias("middle"))


@query(f"""SELECT event_id, user_id, round(c, 3) AS clamped, NOT max(CASE WHEN p IS NULL AND s < c THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) = 1 AS ok FROM (SELECT *, max(coalesce(p, s)) OVER {W} ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT event_id, user_id, s, CASE WHEN event_id % 200 = 0 THEN e END AS p FROM {EV}))""")
def partial_update_repair(spark, sf_dir):
    x = events(spark, sf_dir).select("event_id", "user_id", F.col("s").alias("stored"), F.when(F.col("event_id") % 200 == 0, F.col("e")).alias("proposed"))
    return L.repair_partial(x, BY, ORDER).select("event_id", "user_id", F.round("clamped", 3).alias("clamped"), "ok")


@query("SELECT o_orderkey, coalesce(p, o_totalprice) AS price, p IS NOT NULL AS updated FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def merge_update(spark, sf_dir):
    new = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("p"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return o.join(new, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("p", "o_totalprice").alias("price"), F.col("p").isNotNull().alias("updated"))


@query("""SELECT user_id, w AS window_start, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM (SELECT user_id, value, unnest([time_bucket(INTERVAL 2 HOURS, ts) - INTERVAL (2 * i) HOURS FOR i IN range(10)]) AS w FROM events) GROUP BY user_id, w""")
def hop_window_counts(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "20 hours", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.select("user_id", F.col("w.start").alias("window_start"), "n", "mean")


@query(f"""SELECT user_id, CAST(g AS BIGINT) AS island, round(min(s), 3) AS start_s, round(max(s), 3) AS end_s, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(CASE WHEN quiet AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER {W}) AS g FROM (SELECT *, lag(quiet) OVER {W}) AS p FROM (SELECT *, value < 25 AS quiet FROM {EV}))) WHERE quiet GROUP BY user_id, g HAVING max(s) - min(s) >= 1.2""")
def silence_islands(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = events(spark, sf_dir).withColumn("quiet", F.col("value") < 25)
    x = x.withColumn("new", (F.col("quiet") & ~F.coalesce(F.lag("quiet").over(w), F.lit(False))).cast("int")).withColumn("island", F.sum("new").over(L.upto(BY, ORDER)))
    g = x.where("quiet").groupBy("user_id", "island").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.count(F.lit(1)).alias("n")).where("b - a >= 1.2")
    return g.select("user_id", "island", F.round("a", 3).alias("start_s"), F.round("b", 3).alias("end_s"), "n")


@query("SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events")
def rate_window_count(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.floor("s")).rangeBetween(-43200, 0)
    return events(spark, sf_dir).select("event_id", "user_id", F.count(F.lit(1)).over(w).alias("n"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate <= TIMESTAMP '1995-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 200")
def retention_candidates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderdate") <= F.lit("1995-01-01").cast("timestamp_ntz")))
    return o.orderBy("o_orderdate", "o_orderkey").limit(200).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n, max(o_totalprice) AS most, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS BIGINT) AS urgent FROM orders GROUP BY o_orderstatus")
def job_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("""SELECT event_id, CASE WHEN st AND c >= 0.32 THEN 'tracking' WHEN st THEN 'uncertain' ELSE 'seeking' END AS ux, array_to_string(list_filter([CASE WHEN k > 0 THEN CASE WHEN k >= 20 THEN 'surah_jump' ELSE 'ayah_skip' END END, CASE WHEN event_type = 'error' THEN 'reset_detected' END, CASE WHEN c < 0.25 AND event_id % 11 < 8 THEN 'need_more_audio' END], lambda x: x IS NOT NULL), ',') AS alerts
FROM (SELECT event_id, event_type, value / 100 AS c, user_id % 3 > 0 AS st, event_id % 40 - 10 AS k FROM events)""")
def ux_alerts(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("value") / 100).alias("c"), (F.col("user_id") % 3 > 0).alias("st"), (F.col("event_id") % 40 - 10).alias("k"))
    ux = F.when(F.col("st") & (F.col("c") >= 0.32), "tracking").when(F.col("st"), "uncertain").otherwise("seeking")
    codes = F.array(F.when(F.col("k") > 0, F.when(F.col("k") >= 20, "surah_jump").otherwise("ayah_skip")), F.when(F.col("event_type") == "error", "reset_detected"), F.when((F.col("c") < 0.25) & (F.col("event_id") % 11 < 8), "need_more_audio"))
    return x.select("event_id", ux.alias("ux"), F.array_join(codes, ",").alias("alerts"))


SIL = "(SELECT user_id, event_id, epoch(ts) - 1704067200 AS a, epoch(ts) - 1704067200 + value AS b FROM events WHERE event_type = 'view')"


@query(f"SELECT user_id, event_id, round(least((a + b) / 2, a + 0.6), 6) AS cut FROM {SIL} WHERE least((a + b) / 2, a + 0.6) > 0 AND least((a + b) / 2, a + 0.6) < 1e9")
def silence_cuts(spark, sf_dir):
    x = events(spark, sf_dir).where("event_type = 'view'").select("user_id", "event_id", F.least((F.col("s") + F.col("s") + F.col("value")) / 2, F.col("s") + 0.6).alias("cut"))
    return x.where("cut > 0 and cut < 1e9").withColumn("cut", F.round("cut", 6))


@query(f"""WITH x AS (SELECT *, coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM {SIL}), y AS (SELECT user_id, p AS s, a AS e FROM x UNION ALL SELECT user_id, max(b), 3e6 FROM x GROUP BY user_id)
SELECT user_id, round(greatest(s - 0.15, 0), 6) AS s, round(least(e + 0.15, 3e6), 6) AS e FROM y WHERE e - s >= 0.25""")
def speech_intervals(spark, sf_dir):
    x = events(spark, sf_dir).where("event_type = 'view'").select("user_id", F.col("s").alias("a"), (F.col("s") + F.col("value")).alias("b"))
    return L.speech_intervals(x, "user_id", "a", "b", F.lit(3e6))


@query(f"SELECT event_id, user_id FROM {EV} WHERE e >= 100000 AND s <= 900000")
def interval_overlap(spark, sf_dir):
    return events(spark, sf_dir).where("e >= 100000 and s <= 900000").select("event_id", "user_id")


@query(f"SELECT event_id, user_id, round(s + 12.5, 3) AS s, round(e + 12.5, 3) AS e FROM {EV}")
def time_shift(spark, sf_dir):
    """Times within an array of words, shifted in place and read out again."""
    nested = events(spark, sf_dir).select("user_id", F.array(F.struct("event_id", "s", "e")).alias("words"))
    moved = F.transform("words", lambda w: w.withField("s", w["s"] + 12.5).withField("e", w["e"] + 12.5))
    return nested.select("user_id", F.explode(moved).alias("w")).select("w.event_id", "user_id", F.round("w.s", 3).alias("s"), F.round("w.e", 3).alias("e"))


@query("SELECT user_id, round(coalesce(min(value) FILTER (event_type = 'click'), min(value)), 6) AS first_ref, round(coalesce(max(value) FILTER (event_type = 'click'), max(value)), 6) AS last_ref FROM events GROUP BY user_id")
def matched_range(spark, sf_dir):
    c = F.when(F.col("event_type") == "click", F.col("value"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.coalesce(F.min(c), F.min("value")), 6).alias("first_ref"), F.round(F.coalesce(F.max(c), F.max("value")), 6).alias("last_ref"))


@query("SELECT o_orderkey, o_custkey AS guessed, b AS aligned, CASE WHEN c >= CASE WHEN o_custkey = b THEN 0.35 ELSE 0.5 END AND (q >= 6 OR q - 2 >= 4) THEN b ELSE o_custkey END AS chosen FROM orders JOIN (SELECT l_orderkey, max(l_suppkey) AS b, max(l_discount) * 10 AS c, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def guess_override(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_suppkey").alias("aligned"), (F.max("l_discount") * 10).alias("c"), F.max("l_quantity").alias("q"))
    x = table(spark, sf_dir, "orders").join(a, F.col("o_orderkey") == F.col("l_orderkey"))
    return x.select("o_orderkey", F.col("o_custkey").alias("guessed"), "aligned", S.override(F.col("o_custkey"), F.col("aligned"), F.col("c"), F.col("q"), F.col("q") - 2).alias("chosen"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS d, l_quantity * 0.5 AS m, l_discount * 10 AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) - 1 AS i FROM lineitem)
SELECT a.l_orderkey, CAST(CASE WHEN a.i > 0 AND (a.d < 8 OR a.m < 5) AND (b.d >= 8 AND b.m >= 5) AND a.c < 0.85 THEN a.i - 1 ELSE a.i END AS BIGINT) AS active FROM r a LEFT JOIN r b ON a.l_orderkey = b.l_orderkey AND b.k = 2 WHERE a.k = 1""")
def active_span(spark, sf_dir):
    w = Window.partitionBy("l_orderkey")
    o = w.orderBy(F.desc("l_linenumber"), F.desc("l_quantity"), "l_partkey")
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(o).alias("k"), (F.count(F.lit(1)).over(w) - 1).alias("i"), F.struct(F.col("l_quantity").alias("diagonals"), (F.col("l_quantity") * 0.5).alias("matches"), (F.col("l_discount") * 10).alias("confidence")).alias("a"), F.lead(F.struct(F.col("l_quantity").alias("diagonals"), (F.col("l_quantity") * 0.5).alias("matches"))).over(o).alias("p"))
    pick = lambda c: {n: F.coalesce(F.col(c)[n], F.lit(0.0)) for n in ("diagonals", "matches", *(["confidence"] if c == "a" else []))}
    return x.where("k = 1").select("l_orderkey", S.active_span(pick("a"), pick("p"), F.col("i")).alias("active"))


def observations(spark, sf_dir):
    e = events(spark, sf_dir)
    place = F.floor(F.col("event_id") / 40) + F.col("event_id") % 3
    return e.select(F.concat(F.lit("s"), F.col("user_id") % 50).alias("session"), F.col("event_id").alias("seq"), F.concat(F.lit("k"), place).alias("obs_key"), place.alias("place"), (F.col("value") / 100 % 1.0).alias("confidence"), (F.col("event_id") % 20).cast("int").alias("diagonals"), (F.col("value") % 1.0).alias("ratio"), F.col("event_type").alias("group_id"), F.col("s").alias("at_s"))


@query()
def commit_machine(spark, sf_dir):
    return X.batch(observations(spark, sf_dir))


@query(f"""WITH RECURSIVE o AS (SELECT user_id, s / 1000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY s) AS k FROM {EV}),
r AS (SELECT user_id, s, k, TRUE AS accepted, 0 AS retry_after, s AS a, CAST(NULL AS DOUBLE) AS b FROM o WHERE k = 1
UNION ALL SELECT user_id, s, k, NOT f, CASE WHEN f THEN greatest(60 - CAST(trunc(s - b) AS INTEGER), 1) ELSE 0 END, CASE WHEN f THEN a ELSE s END, CASE WHEN f THEN b ELSE a END
FROM (SELECT o.user_id, o.s, o.k, r.a, r.b, r.b IS NOT NULL AND r.b > o.s - 60 AS f FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1))
SELECT user_id, s, accepted, CAST(retry_after AS INTEGER) AS retry_after FROM r""")
def rate_limiter(spark, sf_dir):
    return X.rate_limited(events(spark, sf_dir).select("user_id", (F.col("s") / 1000).alias("s")), "user_id", "s", 2)


@query(f"""WITH RECURSIVE g AS (SELECT user_id AS file, list(round(s / 20000, 3)) AS cuts, max(s / 20000) AS duration FROM {EV} GROUP BY user_id),
p AS (SELECT file, 0 AS chunk, CAST(0 AS DOUBLE) AS here, CAST(NULL AS DOUBLE) AS before FROM g WHERE duration > 0
UNION ALL SELECT file, chunk + 1, CASE WHEN hard THEN e - 3 ELSE e END, CASE WHEN hard THEN e END FROM (SELECT *, here + 15 < duration AND q IS NULL AS hard, CASE WHEN here + 15 >= duration THEN duration ELSE coalesce(q, here + 15) END AS e
FROM (SELECT p.*, duration, list_max(list_filter(cuts, lambda c: c > here + 1 AND c <= here + 15)) AS q FROM p JOIN g USING (file))) WHERE e <> duration AND CASE WHEN hard THEN e - 3 ELSE e END < duration - 0.05)
SELECT file, CAST(chunk AS INTEGER) AS chunk, here AS start_s, e AS end_s, CASE WHEN before IS NULL THEN here ELSE before - 1.5 END AS keep_from_s, CASE WHEN hard THEN e - 1.5 ELSE e END AS keep_to_s
FROM (SELECT *, here + 15 < duration AND q IS NULL AS hard, CASE WHEN here + 15 >= duration THEN duration ELSE coalesce(q, here + 15) END AS e FROM (SELECT p.*, duration, list_max(list_filter(cuts, lambda c: c > here + 1 AND c <= here + 15)) AS q FROM p JOIN g USING (file)))""")
def chunk_plan(spark, sf_dir):
    g = events(spark, sf_dir).groupBy(F.col("user_id").alias("file")).agg(F.sort_array(F.collect_list(F.round(F.col("s") / 20000, 3))).alias("cuts"), F.max(F.col("s") / 20000).alias("duration"))
    return X.chunk_plans(g)


def near_copies(words, apart):
    """Words (user_id, word, s, e) in time order, each that repeats the last kept one within so many seconds widening it."""
    return f"""WITH RECURSIVE w AS ({words}), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e, word) AS k FROM w),
r AS (SELECT user_id, word, s, e, k FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.word, CASE WHEN o.word = r.word AND abs(o.s - r.s) < {apart} THEN r.s ELSE o.s END, o.e, o.k FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, word, s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY k) AS part FROM (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY user_id ORDER BY k) AND word = lag(word) OVER (PARTITION BY user_id ORDER BY k) THEN 0 ELSE 1 END AS n FROM r)) GROUP BY user_id, part, word, s"""


@query(near_copies(f"SELECT user_id, event_type AS word, s, e FROM {EV}", 30000))
def near_dup_words(spark, sf_dir):
    from lexispan.streaming.machine import drop_near_copies

    def fold(pdf):
        rows = drop_near_copies(list(zip(pdf["event_type"], pdf["s"], pdf["e"], strict=True)), 30_000.0)
        return type(pdf)([(pdf["user_id"].iloc[0], *r) for r in rows], columns=["user_id", "word", "s", "e"])

    return events(spark, sf_dir).select("user_id", "event_type", "s", "e").groupBy("user_id").applyInPandas(fold, "user_id long, word string, s double, e double")


@query(near_copies(f"""SELECT user_id, word, s, e FROM (SELECT *, k > n // 2 AS late, min(CASE WHEN k > n // 2 THEN s END) OVER (PARTITION BY user_id) AS a, max(CASE WHEN k = n THEN e END) OVER (PARTITION BY user_id) AS b, min(s) OVER (PARTITION BY user_id) + 3600 AS oldest
FROM (SELECT user_id, event_type AS word, s, s + 1.0 AS e, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM {EV})) WHERE late OR e >= oldest AND NOT (e >= a - 0.25 AND s <= b + 0.25)""", 0.03))
def rolling_transcript(spark, sf_dir):
    """Each user's words after re-reading the last stretch: what the rolling transcript then holds."""
    from lexispan.streaming.machine import upsert

    def fold(pdf):
        pdf = pdf.sort_values(["s", "event_id"])
        words = list(zip(pdf["event_type"], pdf["s"], pdf["s"] + 1.0, strict=True))
        half = words[len(words) // 2 :]
        rows = upsert(words, half, half[0][1], half[-1][2], words[0][1] + 3600)
        return type(pdf)([(pdf["user_id"].iloc[0], *r) for r in rows], columns=["user_id", "word", "s", "e"])

    return events(spark, sf_dir).select("event_id", "user_id", "event_type", "s").groupBy("user_id").applyInPandas(fold, "user_id long, word string, s double, e double")


@query()
def span_jumps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    x = c.select("conv_id", F.col("turn").alias("seg"), (F.col("turn") * 10.0).alias("start_s"), (F.col("turn") * 10.0 + 8).alias("end_s"), F.when(n % 7 > 0, F.floor(n / 10)).cast("long").alias("place"), F.floor(n / 800).cast("long").alias("group_id"), (n % 100 / 100.0).alias("confidence"))
    return S.find_spans(x, "conv_id")


@query(f"""WITH x AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN CAST(floor(value / 20) AS BIGINT) END AS doc, event_id % 9 = 0 AS estimated, event_id % 5 > 0 AS known, event_id % 2 = 0 AS in_prev, event_id % 3 = 0 AS in_next FROM {EV}),
y AS (SELECT *, last_value(doc IGNORE NULLS) OVER {W} ROWS UNBOUNDED PRECEDING) AS p, first_value(doc IGNORE NULLS) OVER {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n, lead(s) OVER {W}) AS following FROM x)
SELECT event_id, user_id, CASE WHEN doc IS NOT NULL THEN doc WHEN estimated THEN CASE WHEN p = n THEN p END
WHEN p IS NOT NULL AND n IS NOT NULL THEN CASE WHEN p = n THEN p WHEN in_prev AND NOT in_next THEN p WHEN in_next AND NOT in_prev THEN n WHEN following - e > 0.75 THEN n ELSE p END
WHEN p IS NOT NULL THEN CASE WHEN known AND in_prev THEN p END WHEN n IS NOT NULL THEN CASE WHEN known AND in_next THEN n END END AS assigned FROM y""")
def token_assignment(spark, sf_dir):
    e = events(spark, sf_dir)
    x = e.select("event_id", "user_id", F.when(F.col("event_id") % 4 == 0, F.floor(F.col("value") / 20)).alias("doc"), F.col("s").alias("start"), F.col("e").alias("end"), (F.col("event_id") % 9 == 0).alias("estimated"), (F.col("event_id") % 5 > 0).alias("known"), (F.col("event_id") % 2 == 0).alias("in_prev"), (F.col("event_id") % 3 == 0).alias("in_next"))
    return L.assign_tokens(x, BY, ORDER).select("event_id", "user_id", "assigned")
