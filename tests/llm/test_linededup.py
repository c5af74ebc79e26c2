"""Line dedup against brute force."""

import random

from lexispan.llm import linededup


def words(line):
    return [w for w in line.translate(str.maketrans("\t\x0b\x0c\r", "    ")).split(" ") if w]


def brute(docs, num=4, den=5):
    """docs: (doc_id, text) in order."""
    before, out = [], []
    for d, t in docs:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        kept = []
        for line in t.split("\n"):
            s = set(words(line))
            if not s:
                kept.append(line)
                continue
            if not any(den * len(s & b) >= num * len(s | b) for b in before):
                kept.append(line)
            before.append(s)
        n = len(t.split("\n"))
        out.append((d, "\n".join(kept), n, n - len(kept)))
    return out


def corpus(seed, n=60, vocabulary=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)] + ["the", "of", "é"] * 30
    base = [rng.choices(vocab, k=rng.randrange(1, 40)) for _ in range(12)]
    texts = [None, "", "\n\n", " \t\n", "the", "the of\nof the the", "the\x85of", "a\xa0b c", "x\r\nx"]
    while len(texts) < n:
        lines = []
        for _ in range(rng.randrange(1, 6)):
            if rng.random() < 0.6:
                line = list(rng.choice(base))
                for _ in range(rng.randrange(4)):
                    line[rng.randrange(len(line))] = rng.choice(vocab)
            else:
                line = rng.choices(vocab, k=rng.randrange(0, 30))
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        texts.append("\n".join(lines))
    return [(i * 5, t) for i, t in enumerate(texts)]


def got(df):
    return sorted((r["row"]["doc_id"], r["text"] or "", r["n_lines"], r["n_removed"]) for r in df.collect())


def test_lines_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, kept int").repartition(5)
        assert got(linededup.dedup_lines(df)) == sorted((d, t or "", a, b) for d, t, a, b in brute(docs))


def test_crowded_words(spark, monkeypatch):
    """Lines that share a rare word but are not alike, before ones that are like a late member of the group."""
    rng = random.Random(5)
    docs = [(i, "rare " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(12))) for i in range(40)]
    docs += [(100 + i, docs[i * 3 + 1][1].rsplit(" ", 1)[0]) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted((d, t, a, b) for d, t, a, b in brute(docs))
    assert got(linededup.dedup_lines(df)) == want
    original = linededup.like_earlier
    monkeypatch.setattr(linededup, "like_earlier", lambda once, like, hot: original(once, like, 3))
    assert got(linededup.dedup_lines(df)) == want and sum(x[3] for x in want) == 12


def test_ids_that_do_not_fit(spark):
    df = spark.createDataFrame([(2**60, "a b\nc"), (-5, "a b"), (7, "c")], "doc_id long, text string")
    assert [x[1] for x in got(linededup.dedup_lines(df))] == ["a b", "c", ""]


def test_repeated_null_and_no_rows(spark):
    kind = "doc_id long, text string, t string"
    assert linededup.dedup_lines(spark.createDataFrame([], kind)).count() == 0
    df = spark.createDataFrame([(None, "a b", "p"), (3, "a b\nc", "q"), (3, "a b\nc", "q"), (1, None, None), (2, "", "r")], kind)
    out = sorted(((r["row"]["doc_id"] or -1), r["text"], r["n_lines"], r["n_removed"], r["row"]["t"]) for r in linededup.dedup_lines(df).collect() if r["text"] is not None)
    assert out == [(-1, "a b", 1, 0, "p"), (2, "", 1, 0, "r"), (3, "", 2, 2, "q"), (3, "c", 2, 1, "q")]


def test_words_of_like_hashes(spark):
    """w254943 and w267111 have the same 32-bit hash; the lines share four words of six."""
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.hash(F.lit("w254943")) == F.hash(F.lit("w267111"))).first()[0]
    docs = [(1, "alpha beta gamma delta w254943"), (2, "alpha beta gamma delta w267111")]
    assert [x[3] for x in got(linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")))] == [0, 0]


def test_a_text_of_very_many_lines(spark):
    """Lines without words before, between and after; the text's places need more bits than the other's ids leave."""
    docs = [(2**40, "a b c\n" + "\n" * 300_000 + "d e f\nd e f"), (2**40 + 1, "d e f\nx y"), (5, "x y")]
    out = {d: (len(t), n, k) for d, t, n, k in got(linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert out == {2**40: (300_011, 300_003, 1), 2**40 + 1: (0, 2, 2), 5: (3, 1, 0)}


def test_one_very_long_line(spark):
    rng = random.Random(9)
    long = [f"v{rng.randrange(10**9)}" for _ in range(60_000)]
    docs = [(1, " ".join(long)), (2, " ".join(long[:50_000])), (3, " ".join(long[:30_000])), (4, "\t".join(reversed(long)))]
    assert [x[3] for x in got(linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")))] == [0, 1, 0, 1]


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", 1, 2, 3, 4), (2, "a b\nc", 5, 6, 7, 8)], "doc_id long, text string, `a.b` int, id int, _n int, `row` int")
    out = sorted((r["row"]["doc_id"], r["row"]["a.b"], r["row"]["_n"], r["text"], r["n_removed"]) for r in linededup.dedup_lines(df).collect())
    assert out == [(1, 1, 3, "a b", 0), (2, 5, 7, "c", 1)]


def test_white_space_does_not_part_lines(spark):
    """Lines of the same words in the same places are one line from the start, whatever white space is between the words."""
    docs = [(1, "a b\tc"), (2, "a\x0bb c\na\x0cb\rc"), (3, "a b c\n\t \n \x0b")]
    rows, stride = linededup.placed(spark.createDataFrame(docs, "doc_id long, text string"))
    assert [r["line"] for r in linededup.distinct_lines(rows, stride, linededup.Threshold(4, 5)).collect()] == ["a b c"]


def test_keys_follow_counts(spark):
    """A key's level is its bucket's count of words in all texts, and no crowded word lies below the least key that is looked at."""
    from collections import Counter

    from pyspark.sql import functions as F

    rng = random.Random(3)
    texts = ["\n".join(rng.choice([" ", "\t"]).join(f"w{int(rng.paretovariate(0.5)) % 5000}" for _ in range(50)) for _ in range(4)) for _ in range(80)]
    rows, _ = linededup.placed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    counts = Counter(w for t in texts for line in t.split("\n") for w in words(line))
    key = linededup.keys(F.array(F.xxhash64("w")), linededup.levels(rows))
    found = spark.createDataFrame(list(counts.items()), "w string, n long").select("w", "n", F.xxhash64("w").alias("h"), key.alias("k"))
    assert not found.schema["k"].dataType.containsNull  # such arrays are sorted faster
    inside = Counter()
    for r in found.collect():
        inside[r["h"] % linededup.BUCKETS] += r["n"]
    whole = spark.createDataFrame(list(inside.items()), "b long, n long").select("b", F.floor(F.log2("n") * 4)).collect()
    level = dict(map(tuple, whole))
    for r in found.collect():
        assert r["k"] == [level[r["h"] % linededup.BUCKETS] << linededup.HASH_BITS | r["h"] & ((1 << linededup.HASH_BITS) - 1)]
        assert all(r["k"][0] >= linededup.least_key(n) for n in range(1, r["n"] + 1))
    assert max(counts.values()) > 100 and min(counts.values()) == 1
