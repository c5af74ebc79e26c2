"""Text functions over the tables."""

from pyspark.sql import functions as F

from lexispan.functions import numeric as N
from lexispan.functions import text as T

from .registry import query, table

NORM = r"""trim(regexp_replace(regexp_replace(translate(regexp_replace({c}, '[\x{{0610}}-\x{{061A}}\x{{064B}}-\x{{065F}}\x{{0670}}\x{{06D6}}-\x{{06E4}}\x{{06E7}}-\x{{06E8}}\x{{06EA}}-\x{{06ED}}\x{{0640}}]', '', 'g'), 'أإآٱؤئىة', 'ااااوييه'), '[^\p{{L}}\p{{M}}\p{{Nd}}\s\p{{Z}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"""
TOKENS = f"list_filter(string_split({NORM}, ' '), lambda tok: tok <> '')"
GRAMS = "CASE WHEN length({g}) >= 3 THEN list_transform(range(1, length({g}) - 1), lambda i: substr({g}, i, 3)) ELSE [] END"
ARABIC = ["أحمد وٱلكتاب", "رَحْمَة ى ؤئ", "الرحمن والرحمن", "بالكتاب ـ فال", "a - b", '"a,b"', "ab c", "يسسس الله", "ال و", ""]
ARABIC_SQL = ", ".join(f"({i}, '{x}')" for i, x in enumerate(ARABIC))


def arabic(spark):
    return spark.createDataFrame(list(enumerate(ARABIC)), "id int, text string")


@query(f"SELECT doc_id, md5({NORM.format(c='text')}) AS norm_md5, CAST(length({NORM.format(c='text')}) AS BIGINT) AS n_chars FROM documents")
def normalize_text(spark, sf_dir):
    n = T.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", F.md5("n").alias("norm_md5"), F.length("n").cast("long").alias("n_chars"))


@query(rf"SELECT CAST(id AS INTEGER) AS id, translate(regexp_replace(text, '[\x{{0610}}-\x{{061A}}\x{{064B}}-\x{{065F}}\x{{0670}}\x{{06D6}}-\x{{06E4}}\x{{06E7}}-\x{{06E8}}\x{{06EA}}-\x{{06ED}}\x{{0640}}]', '', 'g'), 'أإآٱؤئىة', 'ااااوييه') AS folded, {NORM.format(c='text')} AS norm FROM (VALUES {ARABIC_SQL}) v(id, text)")
def letter_fold(spark, sf_dir):
    return arabic(spark).select("id", T.fold_letters(T.strip_diacritics(F.col("text"))).alias("folded"), T.normalize(F.col("text")).alias("norm"))


CLEAN = r"regexp_replace(w, '^[^\p{L}\p{M}\p{Nd}_]+|[^\p{L}\p{M}\p{Nd}_]+$', '', 'g')"


@query(f"SELECT w AS word, CASE WHEN {CLEAN} = '' THEN w ELSE {CLEAN} END AS cleaned, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations) GROUP BY w")
def clean_token(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return w.select("word", T.clean_token(F.col("word")).alias("cleaned"), "n")


SHORT = "replace({n}, ' ', '')".format(n=NORM.format(c=f"(CASE WHEN {CLEAN.replace('(w,', '(trim(w),')} = '' THEN trim(w) ELSE {CLEAN.replace('(w,', '(trim(w),')} END)"))


@query(f"""WITH s AS (SELECT DISTINCT w, {SHORT} AS x FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations UNION ALL SELECT text AS w FROM (VALUES {ARABIC_SQL}) v(id, text)))
SELECT w AS word, trim(array_to_string(list_transform(list_filter(range(1, length(x) + 1), lambda i: NOT (i > 1 AND x[i] = x[i - 1] AND (i > 2 AND x[i] = x[i - 2] OR x[i] = x[i + 1]))), lambda i: x[i]), '')) AS token FROM s""")
def normalize_token(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("word")).union(arabic(spark).select("text")).distinct()
    return words.select("word", T.normalize_token(F.col("word")).alias("token"))


@query(f"SELECT doc_id, CAST(p AS BIGINT) AS word_pos, t[p] AS token FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS p FROM (SELECT doc_id, {TOKENS.format(c='text')} AS t FROM documents))")
def tokens(spark, sf_dir):
    from lexispan.operators.corpus import tokens as of

    return of(table(spark, sf_dir, "documents")).withColumn("word_pos", F.col("word_pos").cast("long"))


EXPAND = """list_filter(flatten(list_transform({t}, lambda t: [t, CASE WHEN starts_with(t, 'ال') AND length(t) > 2 THEN substr(t, 3) END,
CASE WHEN contains('وفبكلس', t[1]) AND length(t) > 1 THEN substr(t, 2) END,
CASE WHEN contains('وفبكلس', t[1]) AND length(t) > 1 AND starts_with(substr(t, 2), 'ال') AND length(t) > 3 THEN substr(t, 4) END])), lambda x: x IS NOT NULL)"""


@query(f"SELECT CAST(id AS INTEGER) AS id, array_to_string({EXPAND.format(t=TOKENS.format(c='text'))}, ' ') AS terms FROM (VALUES {ARABIC_SQL}) v(id, text)")
def expand_terms(spark, sf_dir):
    return arabic(spark).select("id", F.array_join(T.expand_terms(T.tokenize(F.col("text"))), " ").alias("terms"))


FLAT = f"replace({NORM.format(c='text')}, ' ', '')"


@query(f"SELECT item_id, CAST(p AS BIGINT) AS pos, g[p] AS gram FROM (SELECT item_id, g, unnest(range(1, len(g) + 1)) AS p FROM (SELECT item_id, {GRAMS.format(g=FLAT)} AS g FROM benchmark))")
def char_ngrams(spark, sf_dir):
    g = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.char_ngrams(F.col("text"))).alias("p", "gram"))
    return g.select("item_id", (F.col("p") + 1).cast("long").alias("pos"), "gram")


@query(f"""WITH g AS (SELECT item_id, list_distinct({GRAMS.format(g=FLAT)}) AS g FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS jaccard FROM g a JOIN g b ON a.item_id < b.item_id WHERE len(list_intersect(a.g, b.g)) > 0""")
def ngram_jaccard_pairs(spark, sf_dir):
    """Pairs that share a 3-gram, found through the grams; all others have 0."""
    sets = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.char_ngrams(F.col("text"))).alias("g"))
    flat = sets.select("item_id", F.size("g").alias("n"), F.explode("g").alias("x"))
    a, b = (flat.select("x", F.col("item_id").alias(k), F.col("n").alias(f"n{k}")) for k in "ab")
    both = a.join(b, "x").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    return both.select("a", "b", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("jaccard"))


def sim_sql(table: str, key: str) -> str:
    """key, simhash of a table's texts: a sum a bit over their grams."""
    bits = ", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(60))
    word = " + ".join(f"CASE WHEN 2 * b{b} >= n THEN {1 << b} ELSE 0 END" for b in range(60))
    return f"""SELECT {key}, CASE WHEN n = 0 THEN 0 ELSE CAST({word} AS BIGINT) END AS simhash FROM (SELECT {key}, count(h) AS n, {bits} FROM (SELECT {key}, ('0x' || substr(md5(g), 1, 15))::BIGINT AS h
FROM (SELECT {key}, substr(x, i, 3) AS g FROM (SELECT {key}, x, unnest(CASE WHEN length(x) >= 3 THEN range(1, length(x) - 1) ELSE [NULL] END) AS i FROM (SELECT {key}, {FLAT} AS x FROM {table})))) GROUP BY {key})"""


def _simhash(spark, sf_dir, name, key):
    return T.simhash_md5(table(spark, sf_dir, name), key, T.char_ngrams(F.col("text")))


@query(sim_sql("documents", "doc_id"))
def simhash_md5(spark, sf_dir):
    return _simhash(spark, sf_dir, "documents", "doc_id")


@query()
def simhash_blake2b(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.simhash64(F.col("text")).alias("simhash"))


@query(f"""WITH d AS MATERIALIZED ({sim_sql("documents", "doc_id")}), q AS MATERIALIZED ({sim_sql("benchmark", "item_id")}) SELECT a, b, CAST(d AS INTEGER) AS distance, CAST(k AS INTEGER) AS place FROM (SELECT item_id AS a, doc_id AS b, bit_count(xor(q.simhash, d.simhash)) AS d,
row_number() OVER (PARTITION BY item_id ORDER BY bit_count(xor(q.simhash, d.simhash)), doc_id) AS k FROM q, d) WHERE k <= 80""")
def simhash_knn(spark, sf_dir):
    """The 80 documents of nearest fingerprints of each benchmark item."""
    from lexispan.operators.candidates import near_passages

    q = _simhash(spark, sf_dir, "benchmark", "item_id").select(F.col("item_id").alias("a"), "simhash")
    return near_passages(q, _simhash(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("b"), "simhash"))


@query("""SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS ts, h || ':' || m || ':' || s || '.' || f AS raw, h * 3600.0 + m * 60 + s + f / 1000.0 AS parsed
FROM (SELECT event_id, CAST(round(value * 61.7 * 1000) AS BIGINT) AS ms, event_id % 30 AS h, event_id % 60 AS m, event_id % 59 AS s, event_id % 1000 AS f FROM events)""")
def timestamps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.concat(F.col("event_id") % 30, F.lit(":"), F.col("event_id") % 60, F.lit(":"), F.col("event_id") % 59, F.lit("."), F.col("event_id") % 1000)
    return e.select("event_id", T.format_timestamp(F.col("value") * 61.7).alias("ts"), raw.alias("raw")).withColumn("parsed", T.parse_timestamp(F.col("raw")))


@query(r"""SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace('<|' || role || '|> ' || text || '<|end|>', '<\|[^|]*\|>', '', 'g'), '\s+', ' ', 'g'))) AS plain FROM conversations""")
def strip_special_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(T.strip_special(F.concat(F.lit("<|"), "role", F.lit("|> "), "text", F.lit("<|end|>")))).alias("plain"))


@query(r"""SELECT doc_id, md5(CASE WHEN len(w) <= 600 THEN array_to_string(w, ' ') ELSE array_to_string(list_concat(w[:300], w[len(w) - 299:]), ' ') END) AS cut, md5(right(text, 400)) AS tail FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)""")
def head_tail_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.head_tail(F.col("text"))).alias("cut"), F.md5(T.tail_text(F.col("text"))).alias("tail"))


@query(r"""SELECT page_id, CASE WHEN regexp_extract(url, '([^/\\]*)$', 1) IN ('', '.', '..') THEN 'upload.bin' ELSE regexp_extract(url, '([^/\\]*)$', 1) END AS name, sha256(html) AS digest,
regexp_replace(regexp_replace(url, '^https://', 'wss://'), '^http://', 'ws://') AS ws, md5('"' || replace(html, '"', '""') || '"') AS quoted_md5 FROM pages""")
def page_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    u = F.col("url")
    return p.select("page_id", T.safe_basename(u).alias("name"), T.content_hash(F.col("html")).alias("digest"), T.websocket_url(u).alias("ws"), F.md5(T.fts_quote(F.col("html"))).alias("quoted_md5"))


@query("""SELECT page_id, host, (host = 'example.org' OR host LIKE '%.example.org') OR host = 'tionsh.example.net' AS allowed FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)""")
def host_allow(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return p.withColumn("allowed", T.host_allowed(F.col("host"), ["*.example.org", "tionsh.example.net"]))


@query("""SELECT event_id, ip, (n BETWEEN 167772160 AND 184549375) OR (n BETWEEN 3232235776 AND 3232236031) AS inside FROM (SELECT event_id, '10.' || user_id % 256 || '.1.' || event_id % 256 AS ip, 167772160 + user_id % 256 * 65536 + 256 + event_id % 256 AS n FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, '192.168.' || user_id % 3 || '.' || event_id % 256, 3232235520 + user_id % 3 * 256 + event_id % 256 FROM events WHERE event_id % 2 = 1)""")
def network_members(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    low = F.col("event_id") % 256
    ip = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10."), F.col("user_id") % 256, F.lit(".1."), low)).otherwise(F.concat(F.lit("192.168."), F.col("user_id") % 3, F.lit("."), low))
    return e.select("event_id", ip.alias("ip")).withColumn("inside", T.in_networks(F.col("ip"), ["10.0.0.0/8", "192.168.1.0/24"]))


@query("""SELECT event_id, lower(event_type) AS folded, TRY_CAST(event_type AS DOUBLE) AS number, lower(trim(event_type)) IN ('1', 'true', 'yes', 'y', 'on') AS flag, coalesce(nullif(trim(''), ''), event_type) AS shown, user_id || ':' || event_id AS key FROM events""")
def tolerant_values(spark, sf_dir):
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    return e.select("event_id", T.casefold(t).alias("folded"), T.tolerant_number(t).alias("number"), T.tolerant_bool(t).alias("flag"), T.segment_text(F.lit(""), F.array("event_type")).alias("shown"), T.composite_key(F.col("user_id"), F.col("event_id")).alias("key"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN conf > 0.7 THEN 'good' WHEN conf > 0.4 THEN 'warn' ELSE 'bad' END AS bucket, round(conf, 6) AS confidence,
CAST(least(greatest(round(0.2 * l_partkey) + 60, 120), 700) AS INTEGER) AS band, CAST((l_partkey + l_suppkey) // 2 AS BIGINT) AS centre, greatest(l_tax, l_discount) AS score_default, l_tax + 0.25 * l_discount AS score_hybrid
FROM (SELECT *, CASE WHEN d < 20 THEN raw * least(greatest(d / 12.0, 0), 1) ELSE raw END AS conf FROM (SELECT *, l_quantity AS d, 0.45 * least(greatest((floor(l_quantity * 0.8) / l_quantity - 0.2) / 0.65, 0), 1) + 0.35 * least(l_discount * 10 / 0.35, 1) + 0.2 * least(greatest(l_tax * 10, 0), 1) AS raw FROM lineitem))""")
def confidence_calibration(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    conf = N.confidence(F.floor(F.col("l_quantity") * 0.8), F.col("l_quantity"), F.col("l_discount") * 10, F.col("l_tax") * 10)
    x = x.withColumn("c", conf)
    best, top = F.col("l_tax"), F.col("l_discount")
    return x.select("l_orderkey", "l_linenumber", N.bucket(F.col("c")).alias("bucket"), F.round("c", 6).alias("confidence"), N.band_width(F.col("l_partkey")).alias("band"), N.span_centre(F.col("l_partkey"), F.col("l_suppkey")).alias("centre"), N.rank_score(best, top).alias("score_default"), N.rank_score(best, top, "hybrid").alias("score_hybrid"))


@query("""SELECT user_id, round(CASE WHEN ms > 0 THEN 20 * log10(sqrt(ms) / 32768) ELSE -100 END, 6) AS db, round(least(greatest((CASE WHEN ms > 0 THEN 20 * log10(sqrt(ms) / 32768) ELSE -100 END + 60) / 40, 0), 1), 6) AS level FROM (SELECT user_id, avg((value * 100) * (value * 100)) AS ms FROM events GROUP BY user_id)""")
def rms_dbfs(spark, sf_dir):
    x = F.col("value") * 100
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(x * x).alias("ms")).select("user_id", N.dbfs(F.col("ms")).alias("d"))
    return m.select("user_id", F.round("d", 6).alias("db"), F.round(N.mic_level(F.col("d")), 6).alias("level"))


@query("""SELECT user_id, median(value) AS middle, v[CAST(floor((len(v) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS p90_round, v[CAST(floor((len(v) - 1) * 0.9) AS BIGINT) + 1] AS p90_floor, round(avg(value), 6) AS mean, max(value) AS most, min(value) AS least, CAST(count(*) AS BIGINT) AS n
FROM (SELECT user_id, value, list(value ORDER BY value) OVER (PARTITION BY user_id) AS v FROM events) GROUP BY user_id, v""")
def latency_summary(spark, sf_dir):
    v = F.col("v")
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.percentile("value", F.lit(0.5)).alias("middle"), F.sort_array(F.collect_list("value")).alias("v"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.min("value").alias("least"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", "middle", N.nearest_rank(v, 0.9, True).alias("p90_round"), N.nearest_rank(v, 0.9, False).alias("p90_floor"), "mean", "most", "least", "n")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'broken' ELSE '[[1,' || (1000 + event_id) || '],[2,' || user_id || ']]' END AS raw, CASE WHEN event_id % 7 = 0 THEN 'broken' ELSE '[[1,' || user_id * 10 || '],[2,' || user_id || ']]' END AS edited FROM events""")
def json_array_edit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 7 == 0, "broken").otherwise(F.concat(F.lit("[[1,"), 1000 + F.col("event_id"), F.lit("],[2,"), F.col("user_id"), F.lit("]]")))
    return e.select("event_id", raw.alias("raw"), F.col("user_id")).select("event_id", "raw", N.edit_first_time(F.col("raw"), F.col("user_id") * 10).alias("edited"))


@query("SELECT source, doc_id, score, round(exp(score - max(score) OVER (PARTITION BY source)) / sum(exp(score - m)) OVER (PARTITION BY source), 6) AS share FROM (SELECT source, doc_id, n_chars / 1000.0 AS score, max(n_chars / 1000.0) OVER (PARTITION BY source) AS m FROM documents)")
def softmax_shares(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") / 1000.0).alias("score"))
    return d.withColumn("share", F.round(N.softmax(F.col("score"), "source"), 6))


@query("""SELECT user_id AS token_group, CASE WHEN n = 1 THEN a || '' WHEN n = 2 THEN a || ',' || c ELSE a || ',' || m || ',' || c END AS picks
FROM (SELECT user_id, count(*) AS n, min(event_id) AS a, max(event_id) AS c, list(event_id ORDER BY event_id)[count(*) // 2 + 1] AS m FROM events GROUP BY user_id)""")
def first_middle_last(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("token_group")).agg(F.sort_array(F.collect_list("event_id")).alias("v"))
    return g.select("token_group", F.array_join(N.picks(F.col("v")), ",").alias("picks"))
