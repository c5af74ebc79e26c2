"""Goldens, brute force and oracles for the engine without its training-data operators."""

import functools
import itertools
import json
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexispan.functions import numeric as N
from lexispan.functions import text as T
from lexispan.operators import align as A
from lexispan.operators import candidates as C
from lexispan.operators import locate
from lexispan.operators import spans as S
from lexispan.operators import timeline as L
from lexispan.plans import ORACLES, QUERIES
from lexispan.sources import audio, bundle, npy, readers
from lexispan.streaming import machine as M
from lexispan.streaming import sessions as X

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize("value, want", [("a - b", "a b"), ('"a,b"', "ab"), ("ab\xa0c", "ab c"), ("", "")])
def test_normalize(spark, value, want):
    assert one(spark, value, T.normalize) == want


def test_text_goldens(spark):
    assert one(spark, "أإآٱؤئىة", T.fold_letters) == "ااااوييه"
    assert [one(spark, x, T.normalize_token) for x in ("يسسس", "الله")] == ["يس", "الله"]
    assert one(spark, "والرحمن", lambda c: F.array_join(T.expand_terms(T.tokenize(c)), " ")) == "والرحمن الرحمن رحمن"
    got = [one(spark, x, T.simhash64) & (2**64 - 1) for x in ("ab", "abc", "thequickbrownfox")]
    assert got == [0, 6455300059550759896, 1428689453668104446]
    assert [one(spark, x, T.format_timestamp, "double") for x in (0.0005, 3661.5)] == ["00:00:00.001", "01:01:01.500"]
    j = spark.createDataFrame([("abcdef", "abcxef"), ("abcdef", "abcdeg"), ("ab", "ab")], "a string, b string").select(T.jaccard(T.char_ngrams(F.col("a")), T.char_ngrams(F.col("b")))).collect()
    assert [r[0] for r in j] == pytest.approx([1 / 7, 3 / 5, 0])


def test_numeric_goldens(spark):
    rows = [(8, 10, 0.35, 0.9), (20, 40, 0.07, 0.5), (1, 1, 1.0, 1.0)]
    c = spark.createDataFrame(rows, "m int, d int, g double, q double").select(N.confidence(F.col("m"), F.col("d"), F.col("g"), F.col("q"))).collect()
    assert [r[0] for r in c] == pytest.approx([0.787821, 0.377692, 0.083333], abs=1e-6)
    assert [one(spark, x, N.dbfs, "double") for x in (16384.0**2, None)] == pytest.approx([-6.0206, -100], abs=1e-4)
    p = spark.createDataFrame([(list(range(6)),)], "v array<int>").select(N.nearest_rank(F.col("v"), 0.9, True), N.nearest_rank(F.col("v"), 0.9, False)).first()
    assert tuple(p) == (5, 4)
    assert one(spark, "[[1,5],[2,9]]", lambda c: N.edit_first_time(c, F.lit(77))) == "[[1,77],[2,9]]"
    assert one(spark, "nonsense", lambda c: N.edit_first_time(c, F.lit(77))) == "nonsense"


def test_peaks(spark):
    votes = spark.createDataFrame([("q", o, float(10 - i)) for i, o in enumerate([100, 110, 130, 75, 76, 300])], "item_id string, off long, votes double")
    assert C.peaks(votes).first()["peaks"] == [100, 130, 75, 300]


def scalar_align(obs, ref, offset, band, co, cr, cs):
    """Every path by plain recursion over cells, as (cost, -matches) with the reference's ends free."""
    m, n = len(obs), len(ref)
    best = {(0, j): (0.0, 0) for j in range(n + 1) if abs(j - offset) <= band}
    for i in range(1, m + 1):
        for j in range(n + 1):
            if abs(j - offset - i) > band:
                continue
            ways = []
            if (i - 1, j - 1) in best:
                c, k = best[i - 1, j - 1]
                same = obs[i - 1] and obs[i - 1] == ref[j - 1]
                ways.append((c + (0 if same else cs), k - bool(same)))
            if (i - 1, j) in best:
                c, k = best[i - 1, j]
                ways.append((c + co, k))
            if (i, j - 1) in best:
                c, k = best[i, j - 1]
                ways.append((c + cr, k))
            if ways:
                best[i, j] = min(ways)
    ends = [best[m, j] for j in range(n + 1) if (m, j) in best]
    return min(ends) if ends else None


def test_alignment_goldens_and_brute_force():
    ref = np.arange(1, 7)
    assert [(r["cost"], r["matches"]) for r in (A.align(np.array(o), ref, 2, 6) for o in ([3, 4, 5], [3, 9, 5]))] == [(0, 3), (1, 2)]
    costs = A.Costs(2.0, 0.75, 2.5)
    assert [(r["cost"], r["matches"]) for r in (A.align(np.array(o), ref[:n], 2, 6, costs) for o, n in (([3, 5], 6), ([3, 8, 4], 5)))] == [(0.75, 2), (2, 2)]
    r = A.align(np.array([0, 0]), np.array([0, 0, 1]), 0, 6)
    assert (r["cost"], r["matches"]) == (2, 0)
    rng = random.Random(0)
    for _ in range(300):
        o, f = ([rng.randrange(4) for _ in range(rng.randrange(1, 7))] for _ in range(2))
        co, cr, cs = (rng.randrange(1, 9) / 4 for _ in range(3))
        offset, band = rng.randrange(-2, 3), rng.randrange(1, 5)
        want = scalar_align(o, f, offset, band, co, cr, cs)
        got = A.align(np.array(o), np.array(f), offset, band, A.Costs(co, cr, cs))
        if want is None:
            assert got["diagonals"] == 0
        else:
            assert (round(got["cost"], 6), -got["matches"]) == (round(want[0], 6), want[1])
            assert got["deletions"] + got["diagonals"] == len(o)


def test_alignment_prices_of_words_and_confusions():
    """Back-off by 3-grams and given pairs against a recursion over words."""
    words = ["", "kitab", "kitabi", "kataba", "rahman", "rahmani", "nas"]
    spell = words.__getitem__

    def price(r, o):
        if r and o and (r, o) == (6, 3):
            return 0.125
        return A.backoff(spell(r), spell(o), 1.0) if r and o else 1.0

    rng = random.Random(2)
    assert A.backoff("kitab", "kitabi", 1.0) < 1.0 == A.backoff("kitab", "nas", 1.0)
    for _ in range(200):
        o, f = ([rng.randrange(len(words)) for _ in range(rng.randrange(1, 6))] for _ in range(2))

        @functools.cache
        def best(i, j):
            """Least cost, then most matches, of o[:i] against what of f ends at j."""
            if i == 0:
                return (0.0, 0)
            ways = [(best(i - 1, j)[0] + 1.0, best(i - 1, j)[1])]
            if j:
                c, k = best(i - 1, j - 1)
                same = o[i - 1] and o[i - 1] == f[j - 1]
                ways.append((c + (0.0 if same else price(f[j - 1], o[i - 1])), k - bool(same)))
                ways.append((best(i, j - 1)[0] + 0.75, best(i, j - 1)[1]))
            return min((round(c, 6), k) for c, k in ways)

        got = A.align(np.array(o), np.array(f), 0, 12, A.Costs(1.0, 0.75, 1.0, ((6, 3, 0.125),)), spell)
        want = min(best(len(o), j) for j in range(len(f) + 1))
        assert (round(got["cost"], 5), -got["matches"]) == (round(want[0], 5), want[1]), (o, f)


def test_smoothing_golden_and_loop(spark):
    def loop(rows):
        out, top = [], None
        for s, e in rows:
            if s is None or e is None:
                out.append((s, e))
                continue
            s2 = s if top is None else max(s, top)
            top = max(s2, e)
            out.append((s2, top))
        return out

    rng = random.Random(1)
    cases = [[(0.0, 2.0), (1.0, 1.5), (None, 9.0), (5.0, 4.0)], *([(rng.choice([None, rng.randrange(20) / 2]), rng.choice([None, rng.randrange(20) / 2])) for _ in range(8)] for _ in range(30))]
    df = spark.createDataFrame([(k, i, s, e) for k, c in enumerate(cases) for i, (s, e) in enumerate(c)], "k int, i int, s double, e double")
    got = L.smooth(df, "s", "e", ["k"], ["i"]).orderBy("k", "i").collect()
    assert [(r["s"], r["e"]) for r in got] == list(itertools.chain(*map(loop, cases)))


def test_chunk_plans():
    assert [c[:2] for c in M.plan_chunks(40, [9.5, 14.2, 26])] == [(0, 14.2), (14.2, 26), (26, 40)]
    assert M.plan_chunks(40, []) == [(0, 15, 0, 13.5), (12, 27, 13.5, 25.5), (24, 39, 25.5, 37.5), (36, 40, 37.5, 40)]


STEPS = [((10, 0.70, 12, 0.60), "commit", 10), ((11, 0.40, 7, 0.50), "hold", 10), ((11, 0.40, 7, 0.50), "commit", 11), ((13, 0.70, 12, 0.60), "commit_skip", 13), ((5, 0.40, 7, 0.50), "ignore_backward", 13), ((12, 0.90, 20, 0.90), "hold", 13), ((30, 0.40, 7, 0.50), "hold", 13), ((30, 0.40, 7, 0.50), "hold", 13), ((5, 0.70, 12, 0.60), "reset_committed", 5)]


def test_commit_machine():
    told = M.replay([M.Observation(str(p), p, c, d, r) for (p, c, d, r), _, _ in STEPS])
    assert [(t["action"], t["committed"]) for t in told] == [(a, p) for _, a, p in STEPS]
    assert told[3]["skipped"] == 1


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(2)
    rows = [(f"s{i % 3}", i, f"k{p}", p, rng.random(), rng.randrange(20), rng.random(), rng.choice("ab"), float(i)) for i in range(60) for p in [i // 5 + rng.randrange(3)]]
    df = spark.createDataFrame(rows, X.IN)
    want = sorted(map(tuple, X.batch(df).collect()), key=str)
    for k in range(3):
        df.where(f"seq >= {k * 20} and seq < {k * 20 + 20}").coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(X.IN).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    q = X.stream(source).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("answers").collect()), key=str) == want


def test_sessions_end_and_start_anew(spark, tmp_path):
    """One file a micro-batch: a falls silent and its timer fires, b has its hour of audio, c sends what can't be read."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    row = lambda session, seq, at, at_s=0.0, confidence=0.9: {"session": session, "seq": seq, "obs_key": f"k{seq}", "place": seq, "confidence": confidence, "diagonals": 20, "ratio": 0.9, "group_id": "g", "at_s": at_s, "at": f"2024-01-01T00:{at // 60:02d}:{at % 60:02d}Z"}
    files = [
        [row("a", 1, 0), row("a", 2, 5), row("b", 1, 5, 3599.0)],
        [row("b", 2, 100, 3600.0), row("c", 1, 100) | {"diagonals": None}, row("c", 2, 101)],
        [row("b", 3, 102, 1.0)],
        [row("a", 7, 103)],
    ]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(files):
        path = tmp_path / "in" / f"{k}.json"
        path.write_text("\n".join(map(json.dumps, rows)))
        os.utime(path, (1000 + k, 1000 + k))
    source = spark.readStream.schema(X.IN + ", at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withWatermark("at", "1 second")
    q = X.stream(source, "at").writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("ended").collect()
    assert {(r["session"], r["seq"], r["ended"]) for r in got if r["ended"]} == {("b", 2, "max_audio"), ("a", None, "no_audio")}
    by = {(r["session"], r["seq"]): r for r in got}
    assert by["c", 1]["action"] == "error" and by["c", 1]["error"] and by["c", 2]["action"] == "commit"
    assert (by["a", 7]["action"], by["a", 7]["skipped"], by["b", 3]["action"]) == ("commit", 0, "commit")


def test_spans():
    def fold(rows):
        f = S.Fold()
        for i, (p, g, c) in enumerate(rows):
            f.step(i, i * 10.0, p, g, c)
        f.finish([i * 10.0 for i in range(len(rows))])
        return f.spans, [(j["segment"], j["distance"]) for j in f.jumps]

    near, far = (100, 5, 0.8), (500, 30, 0.8)
    assert fold([near] * 3) == ([[0, 2]], [])
    assert fold([near, near, far, far, far]) == ([[0, 1], [2, 4]], [(2, 400)])
    assert fold([near, far, near, near]) == ([[0, 3]], [])
    assert fold([near, near, far]) == ([[0, 1], [2, 2]], [(2, 400)])
    assert fold([near, (500, 30, 0.95), near]) == ([[0, 0], [1, 1], [2, 2]], [(1, 400), (2, 400)])
    assert fold([near, (None, None, None), (500, 30, 0.1), near])[0] == [[0, 3]]
    head = [{"first": 0, "last": 0, "start_s": 0.0, "end_s": 4.0, "confidence": 0.4}, {"first": 1, "last": 5, "start_s": 5.0, "end_s": 60.0, "confidence": 0.9}]
    assert S.drop_noise(head, [{"from_span": 0, "to_span": 1}]) == (head[1:], [])


def test_rate_limit_ring_and_limits():
    assert M.limited([0, 10, 20, 59, 61, 75], 2) == [(True, 0), (True, 0), (False, 40), (False, 1), (True, 0), (True, 0)]
    ring = M.Ring(M.Config(window_s=2, hop_s=1, buffer_s=3, least_s=1, rate=10))
    ring.push(bytes(range(80)))
    assert ring.due() and len(ring.data) == 60
    assert ring.slice(0, 1000) == (1.0, 4.0, bytes(range(20, 80)))
    with pytest.raises(ValueError):
        ring.push(b"x")
    assert M.Config(hop_s=50, window_s=20, buffer_s=-1).valid() == M.Config(hop_s=2, window_s=20, buffer_s=90)
    assert M.session_end(31, 0, False, 0, 0, 0, None) == "connect_timeout" and M.session_end(10, 0, True, 0, 5, 0, None) is None
    assert M.upsert([("a", 0.0, 1.0), ("b", 2.0, 3.0)], [("c", 2.1, 2.9), ("c", 2.11, 3.2)], 2.0, 3.0, 0.5) == [("a", 0.0, 1.0), ("c", 2.1, 3.2)]


def test_npy(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([1, 2**63 + 5, 3], "<u8"))
    np.save(tmp_path / "m.npy", np.arange(6, dtype="<f4").reshape(3, 2))
    spark.dataSource.register(npy.NpySource)
    read = lambda p, **o: spark.read.format("npy").options(path=str(tmp_path / p), rowsPerPartition=2, **o).load().orderBy("pos").collect()
    assert [r["value"] & (2**64 - 1) for r in read("a.npy", dtype="<u8")] == [1, 2**63 + 5, 3]
    assert [r["value"] for r in read("m.npy")] == [[0, 1], [2, 3], [4, 5]]
    data = (tmp_path / "a.npy").read_bytes()
    for bad, kw in ((data[:-1], {}), (b"x" + data, {}), (data, {"dtype": "<u4"}), (data, {"ndim": 2})):
        with pytest.raises(ValueError):
            npy.array(bad, **kw)


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": 2, "name": "n", "transliteration": "T", "type": "x", "total_verses": 1, "verses": [{"id": 1, "text": "t"}]}]))
    c = readers.corpus_json(spark, str(tmp_path / "c.json"))
    assert c.first()["doc_key"] == "2:1" and readers.lookup(c, 2, 1).count() == 1 and readers.lookup(c, 2, 9).count() == 0
    (tmp_path / "t.txt").write_text("00:00:00.100 --> 00:00:00.200 lost\n[00:00:00.500 --> 00:00:03.250] two words\n  00:00:00.500 --> 00:00:01.000 two\n  00:00:01.0 --> 00:00:01.500 words\n")
    assert [(r["seg"], r["word_pos"], r["start_s"], r["word"]) for r in readers.transcript_text(spark, str(tmp_path / "t.txt")).orderBy("word_pos").collect()] == [(0, 0, 0.5, "two"), (0, 1, 1.0, "words")]
    (tmp_path / "j.json").write_text(json.dumps({"segments": [{"start_s": 0, "end_s": 1, "text": "a", "words": [{"word": "a", "start_s": 0.0, "end_s": 1.0}]}, {"start_s": 1, "end_s": 2, "text": "b"}]}))
    assert [(r["seg"], r["word"]) for r in readers.transcript_json(spark, str(tmp_path / "j.json")).orderBy("seg").collect()] == [(0, "a"), (1, None)]
    (tmp_path / "p.json").write_text(json.dumps([{"label": "x", "audio": "f"}, {"label": "y", "silence_s": 0.5}]))
    assert [r["kind"] for r in readers.playlist(spark, str(tmp_path / "p.json")).collect()] == ["audio", "silence"]
    (tmp_path / "f.json").write_text(json.dumps({"defaults": {"fallback_sub_cost": 9}, "sub_cost": {"3": [[4, 0.5]]}}))
    defaults, pairs = readers.confusions_json(spark, str(tmp_path / "f.json"))
    assert tuple(defaults.first()) == (2.0, 2.0, 5.0) and tuple(pairs.first()) == (3, 4, 0.5)
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1/meta.json").write_text("{}")
    assert readers.latest_version(spark, str(tmp_path)) == str(tmp_path / "v1")
    assert len(readers.wav(b"\0\0" * 16000)) == 44 + 32000


def test_writers_and_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(2, 1, "b"), (1, 1, "a"), (1, 2, "c")], "group_id int, doc_num int, text string")
    readers.write_corpus(docs, str(tmp_path / "corpus"))
    back = spark.read.parquet(str(tmp_path / "corpus"))
    assert sorted(x.name for x in (tmp_path / "corpus").iterdir() if x.is_dir()) == ["group_id=1", "group_id=2"]
    assert readers.lookup(back, 1, 2).first()["text"] == "c"
    readers.write_json(docs, str(tmp_path / "rows"))
    assert sorted(r["text"] for r in spark.read.json(str(tmp_path / "rows")).collect()) == ["a", "b", "c"]
    readers.write_report(docs, str(tmp_path / "report"), "text")
    (part,) = (tmp_path / "report").glob("part-*")
    assert [r["text"] for r in json.loads(part.read_text())] == ["a", "b", "c"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"a": 1}\n{"a": 2}\n')
    q = readers.event_sink(spark.readStream.schema("a int").json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["a"] for r in spark.read.schema("a int").json(str(tmp_path / "out")).collect()) == [1, 2]
    import base64

    text = spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(readers.embedding_text(F.col("v"))).first()[0]
    assert np.frombuffer(base64.b64decode(text), "<f2").tolist() == pytest.approx([0.6, 0.8], abs=1e-3)


def test_confusions_lower_the_cost(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"id_to_token": ["", "alpha", "beta", "gamma", "zeta"]}))
    (tmp_path / "f.json").write_text(json.dumps({"defaults": {"fallback_sub_cost": 2}, "sub_cost": {"2": [[4, 0.25]]}}))
    _, pairs = readers.confusions_json(spark, str(tmp_path / "f.json"))
    own = readers.confusion_words(pairs, readers.vocabulary_json(spark, str(tmp_path / "v.json")))
    assert own == [("beta", "zeta", 0.25)]
    rows = spark.createDataFrame([(1, ["alpha", "zeta", "gamma"], ["alpha", "beta", "gamma"], 0, 0)], "k int, observed array<string>, reference array<string>, base long, off long")
    cost = lambda c: A.align_pairs(rows, "k int", A.Costs(1.0, 1.0, 2.0), confusions=c).first()
    assert cost(())["cost"] == 2.0 and cost(own)["cost"] == 0.25 and cost(own)["mapped"] == [0, 1, 2]


def test_locate_and_refine(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    docs = [(i, " ".join(word() for _ in range(80))) for i in range(12)]
    cut = lambda i, a, b: " ".join(docs[i][1].split()[a:b])
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, cut(3, 10, 30)), (2, cut(7, 0, 5) + " noise " + cut(7, 5, 25)), (3, "nothing of it")], "item_id long, text string")
    got = {r["item_id"]: r for r in locate.locate(corpus, q).collect()}
    assert got.keys() == {1, 2}
    assert (got[1]["doc_id"], got[1]["ref_start"], got[1]["ref_end"], got[1]["matches"]) == (3, 10, 30, 20) and got[1]["confidence"] > 0.9
    assert (got[2]["doc_id"], got[2]["ref_start"], got[2]["ref_end"], got[2]["matches"]) == (7, 0, 25, 25)
    segments = spark.createDataFrame([(5, 0, cut(2, 0, 10)), (5, 1, cut(2, 10, 22)), (5, 2, cut(9, 40, 60))], "t long, seg int, text string")
    spans = spark.createDataFrame([(5, 0, 0, 1), (5, 1, 2, 2)], "t long, span int, first_segment int, last_segment int")
    refined = {r["span_key"]: (r["doc_id"], r["ref_start"], r["ref_end"]) for r in locate.refine(segments, spans, corpus, "t").collect()}
    assert refined == {"5:0": (2, 0, 22), "5:1": (9, 40, 60)}


def test_spliced_segments_make_spans(spark):
    """Segments of one document, then of a far one: each is located by itself and the jump splits them."""
    rng = random.Random(6)
    docs = [(i, f"s{i // 4}", " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))) for i in range(16)]
    cut = lambda i, a, b: " ".join(docs[i][2].split()[a:b])
    corpus = spark.createDataFrame(docs, "doc_id long, source string, text string")
    parts = [cut(1, 0, 12), cut(1, 12, 24), cut(1, 24, 40), cut(14, 5, 20), cut(14, 20, 35), "x", cut(14, 35, 60)]
    segments = spark.createDataFrame([(9, k, k * 10.0, k * 10.0 + 8, t) for k, t in enumerate(parts)], "t long, seg int, start_s double, end_s double, text string")
    found = locate.locate_segments(segments, corpus, "t")
    places = {r["seg"]: (r["place"], r["group_id"]) for r in found.collect()}
    assert places == {0: (2, 1), 1: (2, 1), 2: (2, 1), 3: (15, 4), 4: (15, 4), 5: (None, None), 6: (15, 4)}
    spans = sorted((r["first_segment"], r["last_segment"]) for r in S.find_spans(found, "t").collect())
    assert spans == [(0, 2), (3, 6)]


def test_points_before_zero(spark):
    points = spark.createDataFrame([(1, -5.0), (1, -1.0), (1, 2.0), (1, 3.0)], "g int, at double")
    ends = spark.createDataFrame([(1, 7, -2.0), (1, 8, 3.0)], "g int, slot int, stop double")
    assert sorted((r["at"], r["slot"]) for r in L.into_slots(points, ends, "g", "at", "slot", "stop", 2.0).collect()) == [(-5.0, 7), (-1.0, 8), (2.0, 8)]


def test_audio_bundle_and_settings(spark, tmp_path):
    x = np.array([0.0, 1.0, 0.0, -1.0])
    assert audio.resampled(x, 8000).tolist() == [0, 0.5, 1, 0.5, 0, -0.5, -1, -1]
    assert np.frombuffer(audio.quantised(np.array([2, 0.5, -1, -0.5])), "<i2").tolist() == [32767, 16383, -32768, -16384]
    df = spark.createDataFrame([([0.5] * 8, 16000)], "s array<double>, r int")
    assert df.select(audio.level(audio.pcm16(F.col("s"), F.col("r")))).first()[0] == pytest.approx(-6.02, abs=0.01)
    v = tmp_path / "2024"
    v.mkdir()
    (v / "meta.json").write_text('{"n": 2}')
    with pytest.raises(FileNotFoundError):
        bundle.load_bundle(spark, str(tmp_path))
    (v / "vocab.json").write_text('{"id_to_token": ["", "a", "b"]}')
    np.save(v / "starts.npy", np.array([0, 0, 5], "<u4"))
    np.save(v / "ends.npy", np.array([0, 5, 9], "<u4"))
    b = bundle.load_bundle(spark, str(tmp_path))
    assert b.meta == {"n": 2} and sorted(map(tuple, b.vocabulary.collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, bundle.ranges_of(b.arrays["starts"], b.arrays["ends"]).collect())) == [(1, 0, 5), (2, 5, 9)]
    s = {"A": "yes", "B": "7", "C": "x", "D": "a, b,", "E": " "}
    assert [bundle.setting(s, *p) for p in (("A", False), ("B", 1), ("C", 3), ("D", []), ("E", 2.5), ("F", None))] == [True, 7, 3, ["a", "b"], 2.5, None]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    """Against DuckDB where there is SQL, else that it runs."""
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    shown = lambda df: sorted(tuple("" if pd.isna(v) else f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert shown(got) == shown(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
