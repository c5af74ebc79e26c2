"""Repeated passages against brute force."""

import random

import numpy as np

from lexispan.llm import common, fmindex, substring

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    out = []
    for c in text or "":
        if c in SPACES:
            out.append("")
        elif out:
            out[-1] += c
        else:
            out.append(c)
    return [w for w in out if w]


def brute(docs, window):
    """docs: (doc_id, text) in order."""
    seen, out = set(), []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((d, " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone)))
    return out


def corpus(seed, n=120, vocabulary=40):
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(vocabulary)]
    shared = [rng.choices(vocab, k=rng.randrange(18, 60)) for _ in range(5)]
    texts = [None, "", " \n", "one", "a\x85b c\xa0d", "same " * 70, "x y " * 40]
    while len(texts) < n:
        w = rng.choices(vocab, k=rng.randrange(0, 90))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a // 2 :]
        if rng.random() < 0.2:
            w = (rng.choice(texts) or "").split() + w[:10]
        texts.append(rng.choice(" \n\t").join(w))
    return [(i * 3, t) for i, t in enumerate(texts)]


def got(df):
    return sorted((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in df.collect())


def test_repeats(spark):
    for seed, args in ((1, {}), (2, {"shard_words": 300}), (3, {"hot": 2}), (4, {"window": 8, "run": 3})):
        docs = corpus(seed)
        df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, start string").repartition(6)
        out = substring.remove_repeats(df, **args)
        assert got(out) == sorted(brute(docs, args.get("window", 20))), (seed, args)
        for r in out.collect():
            assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_removed"]


def test_repeated_null_and_no_rows(spark):
    kind = "doc_id long, text string"
    assert substring.remove_repeats(spark.createDataFrame([], kind)).count() == 0
    long = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(None, long), (4, long), (4, long), (2, None), (9, "z " + long)], kind)
    want = sorted([(-1, 30, 0), (2, 0, 0), (4, 30, 30), (4, 30, 30), (9, 31, 30)])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(df).collect()) == want


def test_backward_search_counts_and_places():
    rng = np.random.default_rng(0)
    text = np.concatenate([[0], rng.integers(1, 5, 400), [0], rng.integers(1, 5, 300), [0]])
    index = fmindex.Index(text, 5, 6)
    ends = np.array([i for i in range(6, len(text)) if (text[i - 5 : i + 1] > 0).all()])
    length, low, high = index.search(text, ends)
    early = index.earliest(low, high)
    for e, n, a, b, first in zip(ends, length, low, high, early, strict=True):
        places = lambda k: [j for j in range(len(text) - k + 1) if (text[j : j + k] == text[e - k + 1 : e + 1]).all()]  # noqa: B023, E731
        assert len(places(int(n))) > 1 and (n == 6 or len(places(int(n) + 1)) == 1)
        assert b - a == len(places(int(n))) and first == min(places(int(n)))


def test_blocks_of_a_very_long_text(monkeypatch):
    rng = np.random.default_rng(1)
    words_ = rng.integers(0, 2**63, 3000).astype(np.uint64)
    of = np.repeat([0, 1], [1000, 2000])
    whole = substring.stretches(words_, of, 20, 6)
    monkeypatch.setattr(substring, "PLACE_BITS", 10)
    cut = substring.stretches(words_, of, 20, 6)
    spread = lambda s: sorted((int(t), int(a) + k) for t, a, n in zip(*s[1:], strict=True) for k in range(n))
    assert spread(whole) == spread(cut) and len(spread(cut)) == 1000 - 19 + 2000 - 19


def test_words_and_passages_that_polynomial_hashes_confuse(spark):
    """Thue-Morse sequences and their complements are alike to any polynomial hash modulo 2**64."""
    morse = [bin(i).count("1") % 2 for i in range(4096)]
    spell = lambda bits, a, b: [b if x else a for x in bits]
    one, two = ("".join(spell([x ^ f for x in morse[:1024]], "a", "b")) for f in (0, 1))
    before, after = [f"p{i}" for i in range(10)], [f"s{i}" for i in range(12)]
    docs = [(1, " ".join([*before, one, *after])), (2, " ".join([*before, two, *after]))]
    docs += [(k, " ".join(spell([x ^ k % 2 for x in morse], "left", "right"))) for k in (3, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(substring.remove_repeats(df)) == brute(docs, 20)


def test_long_texts_and_columns_of_any_name(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(120_000))
    docs = [(1, long), (2, "start " + long[:300_000] + " end"), (3, "the same few words " * 3000)]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in docs], "doc_id long, text string, `a.b` int, h int, start int")
    assert got(substring.remove_repeats(df)) == brute(docs, 20)


def test_texts_are_cut_once(spark, monkeypatch):
    cutting = []

    def written(df, name, **how):
        if "MapInArrow" in df._jdf.queryExecution().toString():
            cutting.append(name)
        return common.written(df, name, **how)

    monkeypatch.setattr(substring, "written", written)
    docs = corpus(5)
    found = substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got(found) == sorted(brute(docs, 20))
    assert cutting == ["cut"]
