"""Corpus, retrieval and candidates over the tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexispan.functions import text as T
from lexispan.operators import candidates as C
from lexispan.operators import corpus as K
from lexispan.operators import locate as P
from lexispan.operators import retrieve as R
from lexispan.operators import spans as S
from lexispan.operators import timeline as L

from .registry import query, table
from .text_queries import EXPAND, TOKENS

DT = f"SELECT doc_id, source, {TOKENS.format(c='text')} AS t FROM documents"
NUM = "SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS doc_num, row_number() OVER (ORDER BY source, doc_id) AS doc_global FROM documents"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark")


@query(f"""WITH n AS ({NUM}) SELECT doc_id, source, CAST(doc_num AS INTEGER) AS doc_num, CAST(doc_global AS BIGINT) AS doc_global, source || ':' || doc_num AS doc_key, CAST(lag(doc_id) OVER (ORDER BY doc_global) AS BIGINT) AS prev_id, CAST(lead(doc_id) OVER (ORDER BY doc_global) AS BIGINT) AS next_id FROM n""")
def doc_lookup_neighbors(spark, sf_dir):
    """Neighbours by number: a join on the number before and after, not a window over the whole table."""
    n = K.numbered(docs(spark, sf_dir)).select("doc_id", "source", "doc_num", F.col("doc_global").cast("long").alias("doc_global"), "doc_key")
    at = n.select(F.col("doc_id").alias("o"), F.col("doc_global").alias("g"))
    before, after = at.select((F.col("g") + 1).alias("doc_global"), F.col("o").alias("prev_id")), at.select((F.col("g") - 1).alias("doc_global"), F.col("o").alias("next_id"))
    return n.join(before, "doc_global", "left").join(after, "doc_global", "left")


@query("""SELECT d.doc_id, d.source, d.n_chars, CAST(g.n AS BIGINT) AS n_docs, CAST(g.chars AS BIGINT) AS source_chars FROM documents d JOIN (SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY source) g USING (source)""")
def group_doc_view(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "source", "n_chars")
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("source_chars"))
    return d.join(g, "source")


VOCAB = f"""SELECT token, df, row_number() OVER (ORDER BY token) AS token_id, ln((n + 1) / (df + 1)) + 1 AS idf, df / n > 0.35 AS is_stop FROM (SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(t)) AS token FROM ({DT})) GROUP BY token), (SELECT count(*) AS n FROM documents)"""


@query(f"SELECT token, CAST(token_id AS INTEGER) AS token_id, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf, is_stop FROM ({VOCAB})")
def vocab_idf(spark, sf_dir):
    return K.vocabulary(docs(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query(f"SELECT *, CAST(coalesce(sum(n_postings) OVER (ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT token, CAST(count(*) AS BIGINT) AS n_postings, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id, unnest(t) AS token FROM ({DT})) GROUP BY token)")
def inverted_index_offsets(spark, sf_dir):
    return K.inverted_index(docs(spark, sf_dir))


@query(f"SELECT token, doc_id, array_to_string(list(p ORDER BY p), ',') AS positions FROM (SELECT doc_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS p FROM ({DT})) GROUP BY token, doc_id")
def posting_positions(spark, sf_dir):
    return K.postings(docs(spark, sf_dir)).withColumn("positions", F.array_join("positions", ","))


@query(f"""WITH n AS ({NUM}), s AS (SELECT source, doc_num, length(text) AS n, source || ':' || doc_num AS k FROM n)
{' UNION ALL '.join(f"SELECT source, CAST(doc_num AS INTEGER) AS start_num, {w} AS width, CAST(c AS BIGINT) AS n_chars, k AS last_key FROM (SELECT source, doc_num, sum(n) OVER v AS c, count(*) OVER v AS m, last_value(k) OVER v AS k FROM s WINDOW v AS (PARTITION BY source ORDER BY doc_num ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)) WHERE m = {w}" for w in range(1, 6))}""")
def passages_1_5(spark, sf_dir):
    return K.passages(docs(spark, sf_dir)).withColumn("n_chars", F.col("n_chars").cast("long"))


QT = f"SELECT item_id, unnest(t) AS token, unnest(range(len(t))) AS q_pos FROM (SELECT item_id, {TOKENS.format(c='text')} AS t FROM benchmark)"


@query(f"SELECT item_id, CAST(q_pos AS INTEGER) AS q_pos, token, CAST(coalesce(token_id, 0) AS INTEGER) AS token_id FROM ({QT}) q LEFT JOIN ({VOCAB}) v USING (token)")
def token_to_id(spark, sf_dir):
    return query_tokens(spark, sf_dir).select("item_id", "q_pos", "token", "token_id")


def query_tokens(spark, sf_dir):
    q = items(spark, sf_dir).select("item_id", F.posexplode(T.tokenize(F.col("text"))).alias("q_pos", "token"))
    v = K.vocabulary(docs(spark, sf_dir))
    return q.join(v, "token", "left").select("item_id", "q_pos", "token", F.coalesce("token_id", F.lit(0)).alias("token_id"), "idf", F.coalesce("is_stop", F.lit(False)).alias("is_stop"))


TERMS = f"""SELECT item_id, term, n, place FROM (SELECT item_id, term, n, row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, n DESC, term) AS place FROM (SELECT item_id, term, n, row_number() OVER (PARTITION BY item_id ORDER BY p) AS k
FROM (SELECT item_id, term, count(*) AS n, min(p) AS p FROM (SELECT item_id, unnest(x) AS term, unnest(range(len(x))) AS p FROM (SELECT item_id, list_filter({EXPAND.format(t=TOKENS.format(c='text'))}, lambda y: length(y) >= 2) AS x FROM benchmark)) GROUP BY item_id, term)) WHERE k <= 200) WHERE place <= 24"""


@query(f"SELECT item_id, term, CAST(n AS BIGINT) AS n, CAST(place AS INTEGER) AS place FROM ({TERMS})")
def fts_query_terms(spark, sf_dir):
    return R.query_terms(items(spark, sf_dir))


HIT = f"SELECT item_id, doc_id, count(*) AS m FROM (SELECT doc_id, unnest(list_distinct(t)) AS term FROM ({DT})) JOIN ({TERMS}) USING (term) GROUP BY item_id, doc_id"
OF = f"(SELECT item_id, count(*) AS k FROM ({TERMS}) GROUP BY item_id)"


@query(f"SELECT item_id, CAST(coalesce(n, 0) AS BIGINT) AS n_docs FROM {OF} LEFT JOIN (SELECT item_id, count(*) AS n FROM ({HIT}) GROUP BY item_id) USING (item_id)")
def fts_match_or(spark, sf_dir):
    return R.matches(docs(spark, sf_dir), items(spark, sf_dir))


@query(f"SELECT item_id, CAST(coalesce(n, 0) AS BIGINT) AS n_docs FROM {OF} LEFT JOIN (SELECT item_id, count(*) AS n FROM ({HIT}) JOIN {OF} USING (item_id) WHERE m = k GROUP BY item_id) USING (item_id)")
def fts_match_and(spark, sf_dir):
    return R.matches(docs(spark, sf_dir), items(spark, sf_dir), every=True)


BM = f"""WITH dt AS MATERIALIZED ({DT}), st AS (SELECT count(*) AS n_docs, avg(len(t)) AS al FROM dt), terms AS MATERIALIZED ({TERMS}),
p AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM dt) WHERE token IN (SELECT term FROM terms) GROUP BY doc_id, token),
f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
h AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM (SELECT item_id, doc_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score FROM p JOIN f USING (token) JOIN terms ON term = token, st GROUP BY item_id, doc_id) QUALIFY place <= 800)"""


@query(f"{BM} SELECT item_id, doc_id, score, CAST(place AS INTEGER) AS place FROM h")
def bm25_hits(spark, sf_dir):
    return R.hits(docs(spark, sf_dir), items(spark, sf_dir))


def guess_sql(score):
    return f"""{BM}, g AS (SELECT item_id, source, max(score) AS best_score, round(sum(CASE WHEN rn <= 3 THEN score END), 6) AS sum_top, count(*) AS n_hits, max(CASE WHEN rn = 1 THEN doc_id END) AS best_doc FROM (SELECT h.*, source, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS rn FROM h JOIN documents USING (doc_id)) GROUP BY item_id, source),
r AS (SELECT *, {score} AS rs, row_number() OVER (PARTITION BY item_id ORDER BY {score} DESC, source) AS place FROM g QUALIFY place <= 5)
SELECT item_id, source, best_score, sum_top, n_hits, best_doc, round(rs, 4) AS rank_score, CAST(place AS INTEGER) AS place, round(exp(rs - max(rs) OVER (PARTITION BY item_id)) / sum(exp(rs - m)) OVER (PARTITION BY item_id), 6) AS probability FROM (SELECT *, max(rs) OVER (PARTITION BY item_id) AS m FROM r)"""


@query(guess_sql("greatest(sum_top, best_score)"))
def guess_source(spark, sf_dir):
    return R.guess(docs(spark, sf_dir), items(spark, sf_dir))


@query(guess_sql("best_score + 0.25 * sum_top"))
def guess_hybrid(spark, sf_dir):
    return R.guess(docs(spark, sf_dir), items(spark, sf_dir), "hybrid")


def corpus_tokens(spark, sf_dir):
    """doc_id, pos, token: places within a document; offsets are per document."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.tokenize(F.col("text"))).alias("pos", "token"))


VOTES = f"""WITH v AS MATERIALIZED ({VOCAB}), q AS (SELECT item_id, token, idf, q_pos FROM ({QT}) JOIN v USING (token) WHERE NOT is_stop),
r AS (SELECT item_id, token, idf, ps FROM (SELECT item_id, token, max(idf) AS idf, list(q_pos ORDER BY q_pos) AS ps, row_number() OVER (PARTITION BY item_id ORDER BY max(idf) DESC, token) AS k FROM q GROUP BY item_id, token) WHERE k <= 28),
rp AS (SELECT item_id, token, idf, unnest(list_distinct(list_filter([ps[1], CASE WHEN len(ps) > 2 THEN ps[len(ps) // 2 + 1] END, CASE WHEN len(ps) > 1 THEN ps[len(ps)] END], lambda y: y IS NOT NULL))) AS q_pos FROM r),
c AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM ({DT})),
cs AS (SELECT token, doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id, pos) - 1 AS k, greatest(count(*) OVER (PARTITION BY token) // 2000, 1) AS step FROM c WHERE token IN (SELECT token FROM rp)) WHERE k % step = 0),
votes AS (SELECT item_id, doc_id, pos - q_pos AS off, round(sum(idf), 6) AS votes FROM rp JOIN cs USING (token) GROUP BY item_id, doc_id, pos - q_pos)"""


def votes(spark, sf_dir):
    return P.votes(docs(spark, sf_dir), items(spark, sf_dir))


@query(f"{VOTES} SELECT item_id, doc_id, off, votes FROM votes")
def anchor_histogram(spark, sf_dir):
    return votes(spark, sf_dir)


@query(f"""WITH RECURSIVE x AS MATERIALIZED ({VOTES} SELECT item_id, doc_id, off, row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, abs(off), off, doc_id) AS k FROM votes QUALIFY k <= 588),
r AS (SELECT item_id, doc_id, off, k, 1 AS place FROM x
UNION ALL SELECT item_id, doc_id, off, k, place + 1 FROM (SELECT *, first_value(doc_id) OVER w AS d, first_value(off) OVER w AS o FROM r WINDOW w AS (PARTITION BY item_id ORDER BY k)) WHERE place < 12 AND NOT (doc_id = d AND abs(off - o) < 25))
SELECT item_id, CAST(place AS INTEGER) AS place, arg_min(doc_id, k) AS doc_id, arg_min(off, k) AS off FROM r GROUP BY item_id, place""")
def nms_peaks(spark, sf_dir):
    p = C.peaks(votes(spark, sf_dir), "doc_id").select("item_id", F.posexplode("peaks").alias("i", "p"))
    return p.select("item_id", (F.col("i") + 1).alias("place"), "p.doc_id", "p.off")


CAND = """WITH a AS (SELECT l_orderkey AS item_id, (l_partkey * 37) % 5000 AS ref_start, (l_partkey * 37) % 5000 + l_linenumber * 100 - 100 AS ref_end, l_suppkey * 11 - 500 AS off, CASE WHEN l_linenumber % 2 = 0 THEN 'anchor' ELSE 'simhash' END AS source, round(1 - l_discount * 5, 6) AS quick, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS id FROM lineitem WHERE l_linenumber * 100 - 100 > 0)"""


def candidate_rows(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") * 37) % 5000
    both = x.select(F.col("l_orderkey").alias("item_id"), start.alias("ref_start"), (start + F.col("l_linenumber") * 100 - 100).alias("ref_end"), (F.col("l_suppkey") * 11 - 500).alias("off"), F.when(F.col("l_linenumber") % 2 == 0, "anchor").otherwise("simhash").alias("source"), F.round(1 - F.col("l_discount") * 5, 6).alias("quick"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("id"))
    return both.where("source = 'anchor'").unionByName(both.where("source = 'simhash'"))


DEDUP = f"{CAND}, d AS (SELECT *, row_number() OVER (PARTITION BY item_id, ref_start // 256, CAST(trunc(off / 256) AS BIGINT) ORDER BY CASE source WHEN 'anchor' THEN 0 ELSE 2 END, ref_start, off, id, quick) AS k FROM a QUALIFY k = 1)"


@query(f"{DEDUP} SELECT item_id, ref_start, ref_end, off, source, quick, id FROM d")
def candidate_union_dedup(spark, sf_dir):
    return C.dedup_windows(candidate_rows(spark, sf_dir), "item_id", ties=("id", "quick"))


@query("SELECT DISTINCT l_partkey % 100 AS ref_start, l_partkey % 100 + l_linenumber AS ref_end, l_suppkey AS off FROM lineitem")
def exact_window_dedup(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    return x.select((F.col("l_partkey") % 100).alias("ref_start"), (F.col("l_partkey") % 100 + F.col("l_linenumber")).alias("ref_end"), F.col("l_suppkey").alias("off")).dropDuplicates()


@query(f"""{CAND}, b AS (SELECT *, ref_end - ref_start AS width, row_number() OVER (PARTITION BY item_id, source ORDER BY quick DESC, ref_end - ref_start, id) = 1 AS f FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CAST(f AS INTEGER) DESC, quick DESC, width, id) AS k FROM b QUALIFY k <= 3)
SELECT item_id, ref_start, ref_end, off, source, quick, id, width, CAST(row_number() OVER (PARTITION BY item_id ORDER BY quick DESC, width, id) AS INTEGER) AS place FROM c""")
def quota_select(spark, sf_dir):
    x = candidate_rows(spark, sf_dir).where("ref_start < ref_end").withColumn("width", F.col("ref_end") - F.col("ref_start"))
    return C.quota(x, 3, "item_id")


@query("""SELECT l_orderkey AS item_id, CAST(best_id AS INTEGER) AS best_id, best, coalesce(two, best + 1) AS second, round(greatest(coalesce(two, best + 1) - best, 0), 6) AS gap FROM (SELECT l_orderkey, max(CASE WHEN k = 1 THEN l_linenumber END) AS best_id, max(CASE WHEN k = 1 THEN l_discount END) AS best, max(CASE WHEN k = 2 THEN l_discount END) AS two
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_quantity DESC, l_linenumber) AS k FROM lineitem) GROUP BY l_orderkey)""")
def best_second_gap(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("id"), F.col("l_discount").alias("cost"), F.col("l_quantity").alias("matches"))
    return C.best_and_second(x, "item_id").withColumn("gap", F.round("gap", 6))


WANT = f"SELECT item_id, token, idf FROM (SELECT item_id, token, max(idf) AS idf, row_number() OVER (PARTITION BY item_id ORDER BY max(idf) DESC, token) AS k FROM ({QT}) JOIN ({VOCAB}) v USING (token) GROUP BY item_id, token) WHERE k <= 64"


@query(f"""WITH w AS MATERIALIZED ({WANT}), c AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(t) AS token FROM ({DT})))
SELECT item_id, doc_id, coverage FROM (SELECT item_id, doc_id, round(CASE WHEN total > 0 THEN part / total ELSE 1 END, 6) AS coverage FROM (SELECT item_id, doc_id, sum(idf) AS part FROM c JOIN w USING (token) GROUP BY item_id, doc_id) JOIN (SELECT item_id, sum(idf) AS total FROM w GROUP BY item_id) USING (item_id))""")
def coverage_score(spark, sf_dir):
    q = query_tokens(spark, sf_dir).where(F.col("idf").isNotNull()).groupBy("item_id", "token").agg(F.max("idf").alias("idf"))
    wanted = q.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("idf"), "token"))).where("k <= 64").drop("k")
    return C.coverage(wanted, corpus_tokens(spark, sf_dir).select("doc_id", "token"))


@query(f"SELECT item_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(*) FILTER (token_id IS NULL) AS BIGINT) AS unknown, CAST(count(*) FILTER (is_stop) AS BIGINT) AS stops, CAST(count(*) FILTER (token_id IS NOT NULL AND NOT is_stop) AS BIGINT) AS effective FROM ({QT}) q LEFT JOIN ({VOCAB}) v USING (token) GROUP BY item_id")
def token_diagnostics(spark, sf_dir):
    q = query_tokens(spark, sf_dir)
    known = F.col("token_id") > 0
    return q.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(~known).alias("unknown"), F.count_if("is_stop").alias("stops"), F.count_if(known & ~F.col("is_stop")).alias("effective"))


@query(f"SELECT item_id, doc_id FROM (SELECT DISTINCT item_id, token FROM ({QT}) ) JOIN (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(t) AS token FROM ({DT}))) USING (token) GROUP BY item_id, doc_id")
def exists_semi(spark, sf_dir):
    """Documents that contain a token of an item."""
    q = items(spark, sf_dir).select("item_id", F.explode(T.tokenize(F.col("text"))).alias("token")).distinct()
    return corpus_tokens(spark, sf_dir).select("doc_id", "token").distinct().join(q, "token").select("item_id", "doc_id").distinct()


@query()
def align_benchmark(spark, sf_dir):
    """Each benchmark item located in the corpus: candidates by votes and fingerprints, alignment, confidence."""
    return P.locate(docs(spark, sf_dir), items(spark, sf_dir)).drop("mapped")


@query()
def candidate_windows(spark, sf_dir):
    """Where each benchmark item could lie: the windows that are aligned."""
    return P.candidates(docs(spark, sf_dir), items(spark, sf_dir)).select("item_id", "doc_id", "off", "ref_start", "ref_end", "source", "quick")


@query()
def segment_spans(spark, sf_dir):
    """Ten transcripts whose segments are benchmark items: each segment located by itself, then the spans between jumps."""
    x = items(spark, sf_dir).select((F.col("item_id") % 10).alias("conv_id"), F.col("item_id").alias("seg"), (F.col("item_id") * 10.0).alias("start_s"), (F.col("item_id") * 10.0 + 8).alias("end_s"), "text")
    return S.find_spans(P.locate_segments(x, docs(spark, sf_dir), "conv_id"), "conv_id")


@query()
def located_times(spark, sf_dir):
    """The located tokens of each benchmark item with the times they would be heard at, half a second a token, then smoothed."""
    q = items(spark, sf_dir)
    heard = q.select("item_id", F.posexplode(T.tokenize(F.col("text"))).alias("k", "w")).select("item_id", "k", (F.col("k") * 0.5).alias("start_s"), (F.col("k") * 0.5 + 0.5).alias("end_s"))
    found = P.token_times(P.locate(docs(spark, sf_dir), q), heard, "item_id")
    return L.smooth(found, "start_s", "end_s", ["item_id"], ["place"]).select("item_id", "doc_id", "place", "start_s", "end_s")


@query(r"""WITH x AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM conversations)
SELECT conv_id, turn AS seg, CAST(k AS INTEGER) AS word_pos, w[k + 1] AS raw, round(CASE WHEN length(text) % 4 > 0 THEN turn * 10.0 + (length(text) % 4) * k / len(w) ELSE turn * 10.0 END, 6) AS start_s FROM (SELECT *, unnest(range(len(w))) AS k FROM x)
WHERE regexp_matches(w[k + 1], '[\p{L}\p{M}\p{Nd}]')""")
def timed_tokens(spark, sf_dir):
    """Turns as segments with one word of their own each, which is too few: the text's words share the time."""
    c = table(spark, sf_dir, "conversations").where("text <> ''")
    word = F.struct(F.lit("x").alias("word"), F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s"))
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    s = c.select("conv_id", F.col("turn").alias("seg"), (F.col("turn") * 10.0).alias("start_s"), (F.col("turn") * 10.0 + F.length("text") % 4).alias("end_s"), "text", F.when(n >= 3, F.array(word)).alias("words"))
    return P.timed_tokens(s, "conv_id").select("conv_id", "seg", "word_pos", "raw", F.round("start_s", 6).alias("start_s"))


@query("""WITH o AS (SELECT user_id % 20 AS grp, event_id AS num, value * 1000 AS ms FROM events), n AS (SELECT user_id % 20 AS grp, event_id AS num, value * 1000 + event_id % 4000 AS ms FROM events WHERE user_id % 20 <> 4 OR event_id % 2 = 0), c AS (SELECT user_id % 20 AS grp, max(value) / 1000 AS conf FROM events GROUP BY ALL),
g AS (SELECT o.grp, count(*) AS n, count(n.ms) AS matched, avg(abs(n.ms - o.ms)) AS mae, max(abs(n.ms - o.ms)) AS most, median(abs(n.ms - o.ms)) AS middle, list(abs(n.ms - o.ms) ORDER BY abs(n.ms - o.ms)) FILTER (n.ms IS NOT NULL) AS a FROM o LEFT JOIN n USING (grp, num) GROUP BY o.grp)
SELECT grp, CAST(n AS BIGINT) AS n, CAST(matched AS BIGINT) AS matched, round(mae, 6) AS mae, round(most, 6) AS most, round(middle, 6) AS middle, round(a[CAST(floor((len(a) - 1) * 0.9 + 0.5) AS BIGINT) + 1], 6) AS p90, n = matched AND grp NOT IN (1, 33) AND conf >= 0.6 AND most >= 1500 AS update FROM g LEFT JOIN c USING (grp)""")
def timing_refresh(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 20)
    old = e.select("grp", F.col("event_id").alias("num"), (F.col("value") * 1000).alias("ms"))
    new = e.where((F.col("grp") != 4) | (F.col("event_id") % 2 == 0)).select("grp", F.col("event_id").alias("num"), (F.col("value") * 1000 + F.col("event_id") % 4000).alias("ms"))
    return P.timing_refresh(new, old, e.groupBy("grp").agg((F.max("value") / 1000).alias("conf")))


@query("SELECT event_id, k AS chunk FROM (SELECT event_id, unnest([event_id % 7, event_id % 7 + 1]) AS k, value AS s FROM events) WHERE s >= k * 20 - 1e-6 AND s < k * 20 + 20 + 1e-6")
def chunk_ownership(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    words = e.select("event_id", F.lit(0).alias("file"), F.col("value").alias("w_start"), F.explode(F.array(F.col("event_id") % 7, F.col("event_id") % 7 + 1)).alias("chunk"))
    k = F.col("id").alias("chunk")
    chunks = spark.range(9).select(F.lit(0).alias("file"), k, (F.col("id") * 20.0).alias("start_s"), (F.col("id") * 20.0 + 20).alias("end_s"), (F.col("id") * 20.0).alias("keep_from_s"), (F.col("id") * 20.0 + 20).alias("keep_to_s"))
    return P.owned_words(words, chunks, "file").select("event_id", "chunk")
