"""Decontamination, URL rules, language and quality on small inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispan.llm import decontam, langid, quality, urlfilter
from lexispan.llm.registry import URL_RULES

rng = random.Random(9)
WORDS = [f"w{i}" for i in range(50)]


def words(text):
    out, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c > "\x7f" or c.isdigit() or "a" <= c <= "z":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


def brute(text, items, size=10):
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        for i in range(max(1, len(v) - size + 1) if v else 0):
            p = v[i : i + size]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def test_decontamination(spark):
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 25)))) for i in range(12)] + [(12, None), (13, "!!"), (14, "É-b"), (9, "w1 w2 w3")]
    texts = [None, "", "É b", "é b", " ".join(WORDS)]
    for _ in range(60):
        p = (rng.choice(items)[1] or "").split()
        cut = rng.randrange(len(p) + 1)
        texts.append(rng.choice([" ", ", ", "\n"]).join([*rng.choices(WORDS, k=5), *p[cut // 2 :], *rng.choices(WORDS, k=5)]).upper())
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(str(n), t) for n, t in items]
    for limit in (32_000_000, 400):
        got = {r["row"]["doc_id"]: r for r in decontam.decontaminate(docs, bench, limit_bytes=limit).collect()}
        for i, t in enumerate(texts):
            n, hit, found = brute(t, named)
            r = got[i]
            assert (r["n_words"], sum(h["end"] - h["first"] for h in r["hits"]), r["items"]) == (n, hit, found)
            for h in r["hits"]:
                assert words(t[h["start"] : h["stop"]]) == words(t)[h["first"] : h["end"]]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, none).where(F.size("items") > 0).count() == 0
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0


URLS = [None, "", "no scheme", "http://org/", "http://a.ORG/x", "http://example.org/es/1", "https://b.example.org/en/12?x=/es/", "https://notexample.org/es/", "http://org", "http://x.com/fr/#a", "http://x.com/de/y", "http://com/de/", "ftp://xcom/de/", "http://a.com?/de/", "a://b://c.org/", "http://example.org/en/1"]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    h, p = rest[:cut], rest[cut:]
    p = p[: min([p.find(c) for c in "?#" if c in p], default=len(p))]
    h = "".join(c.lower() if "A" <= c <= "Z" else c for c in h)
    best = None
    for v, r in URL_RULES:
        rh, _, rp = r.partition("/")
        if (h == rh or h.endswith("." + rh)) and p.startswith("/" + rp) and (best is None or len(r) > len(best[1])):
            best = (v, r)
    return h, p, best and best[1], best[0] if best else "allow"


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    for block in (50_000, 2):
        got = {r["row"]["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, URL_RULES, block=block).collect()}
        assert got == {i: judged(u) for i, u in enumerate(URLS)}
    assert urlfilter.judge(pages.limit(0), URL_RULES).count() == 0
    many = [("block", f"h{i}.net/a*b/{i}") for i in range(200)] + [("allow", "net/")]
    two = spark.createDataFrame([(1, "http://x.h7.net/aQb/77"), (2, "http://x.h7.net/ab/8"), (2, "http://h7.net/c")], "page_id long, url string")
    assert sorted(r["rule"] for r in urlfilter.judge(two, many).collect()) == ["h7.net/a*b/7", "net/", "net/"]


SYLLABLES = {"aa": "ba da ga la ma".split(), "bb": "bo do go lo mo".split(), "cc": "schi schu tsche pfe kru".split()}


def gibberish(lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_language(spark):
    langs = [rng.choice(sorted(SYLLABLES)) for _ in range(600)]
    rows = [(i, gibberish(x, rng.randrange(3, 60)), x, "s") for i, x in enumerate(langs)] + [(900, None, "aa", "s"), (901, "123 !!", "bb", "s"), (902, "", None, "s"), (None, "ba da", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(docs, langid.fitted(docs)).collect()
    held = [r for r in got if r["row"]["doc_id"] is not None and r["row"]["doc_id"] < 600 and zlib.crc32(str(r["row"]["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["lang_pred"] == r["row"]["lang"] for r in held]) > 0.97
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in got if r["row"]["doc_id"] in (900, 901, 902)} == {("und", 0.0, True)}
    assert all(0 <= r["score"] <= 1 for r in got) and np.mean([r["rejected"] for r in held]) < 0.05
    empty = docs.limit(0)
    assert langid.identify(empty, langid.fitted(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fitted(empty)).collect()} == {"und"}


def test_scores_are_those_of_whole_texts():
    """Remembered words against the n-grams of each text at once."""
    langs = [rng.choice(sorted(SYLLABLES)) for _ in range(120)]
    texts = [gibberish(x, rng.randrange(1, 300)) for x in langs]
    m = langid.train(texts, langs)
    odd = [*texts[:40], "", "12 3", "é", "Straße  und\u2003mehr\n\tZeilen", "a", "xyzzy " * 50]
    for _ in range(2):
        z, usual, n = m.scores(odd)
        for text, a, b, k in zip(odd, z, usual, n, strict=True):
            bucket = langid.grams([text])[0]
            assert k == len(bucket)
            if len(bucket):
                assert np.allclose(a, m.weights[bucket].mean(axis=0) + m.bias, atol=1e-4)
                assert np.allclose(b, (m.shares[bucket].mean(axis=0) - m.middle) * min(1, len(bucket) / langid.STEADY) ** 0.5, atol=1e-3)


def test_unknown_languages_are_rejected():
    """Each language of the table left out of the training once; calibrated on the others."""
    import pyarrow.parquet as pq

    rows = [r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist() if r["lang"] and r["text"]]
    for out in sorted({r["lang"] for r in rows}):
        known = [r for r in rows if r["lang"] != out]
        fit, held = known[::2], known[1::2]
        m = langid.train([r["text"] for r in fit], [r["lang"] for r in fit])
        best, _, rejected = m.judged([r["text"] for r in held])
        assert np.mean([m.languages[b] == r["lang"] for b, r in zip(best, held, strict=True)]) > 0.97 and rejected.mean() < 0.02
        assert 1 - m.judged([r["text"] for r in rows if r["lang"] == out])[2].mean() < 0.1


def test_long_chains_stay_apart():
    """A text of very many lines is a group of its own, so that no array grows with lines times documents; the marginals are those of each alone."""
    lines = [np.random.default_rng(i).random((n, quality.OWN)).astype(np.float32) for i, n in enumerate((3, 40_000, 2, 90_000, 7, 5))]
    groups = quality.alike(lines, 256, 1 << 17)
    assert all(len(g) == 1 or len(g) * max(len(lines[i]) for i in g) <= 1 << 17 for g in groups) and sorted(i for g in groups for i in g) == list(range(6))
    crf = quality.Field(weights=np.random.default_rng(1).normal(size=(2, 3 * quality.OWN + 1)))
    together = crf.good(lines[:1] + lines[2:3] + lines[4:])
    assert all(np.allclose(a, crf.good([d])[0]) for a, d in zip(together, lines[:1] + lines[2:3] + lines[4:], strict=True))


def test_a_benchmark_in_blocks_scans_alike(spark):
    items = [(i, " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee"], k=rng.randrange(1, 25)))) for i in range(30)]
    docs = [(i, " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "ff"], k=rng.randrange(0, 120))), 1) for i in range(60)] + [(99, None, 1)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, `a.b` int"), spark.createDataFrame(items, "item_id long, text string")
    shown = lambda df: sorted((r["row"]["doc_id"], r["row"]["a.b"], r["n_words"], [tuple(h) for h in r["hits"]], r["items"]) for r in df.collect())
    one = shown(decontam.decontaminate(d, b))
    assert one == shown(decontam.decontaminate(d, b, limit_bytes=3000)) and any(x[4] for x in one)


def brute_marginals(crf, x):
    import itertools

    n = len(x)
    own = np.concatenate([x, np.pad(x, ((1, 0), (0, 0)))[:-1], np.pad(x, ((0, 1), (0, 0)))[1:], np.ones((n, 1))], axis=1) @ crf.weights.T
    total, good = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(own[i, y[i]] for i in range(n)) + sum(crf.moves[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    return good / total


def test_marginals_against_enumeration():
    r = np.random.default_rng(0)
    crf = quality.Field(r.normal(0, 0.5, (2, 3 * quality.OWN + 1)), r.normal(0, 1, (2, 2)))
    docs = [r.normal(0, 1, (n, quality.OWN)) for n in (1, 2, 5, 7)]
    for got, x in zip(crf.good(docs), docs, strict=True):
        assert got == pytest.approx(brute_marginals(crf, x.astype(np.float32)), abs=1e-4)


def test_quality(spark):
    def text(good):
        lines = [gibberish("aa", rng.randrange(4, 20)).capitalize() + "." for _ in range(rng.randrange(1, 6))]
        if not good:
            lines[rng.randrange(len(lines))] = " ".join(["BUY!!"] * 200)
        return "\n".join(lines)

    marks = [int(rng.random() < 0.8) for _ in range(500)]
    docs = spark.createDataFrame([(i, text(q), 1.0) for i, q in enumerate(marks)] + [(900, None, 1.0), (901, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(marks)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r["row"]["doc_id"]: r["score"] for r in quality.scored(docs, quality.fitted(docs, labels)).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == marks[i] for i in held]) > 0.97
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    assert quality.scored(docs.limit(0), quality.Field()).count() == 0
    assert {round(r["score"], 9) for r in quality.scored(docs, quality.fitted(docs, labels.limit(0))).collect()} == {0.5}


def test_language_training_leaves_the_driver_its_memory(spark):
    """The driver's Python shares its memory with the JVM: texts are scored a few at a time, and no words stay remembered."""
    import tracemalloc

    rows = [(i, f"the cat sat on the mat {i}" if i % 2 else f"le chat est sur la table {i}", "en" if i % 2 else "fr") for i in range(200)]
    model = langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "seen" not in vars(model) and model.languages == ["en", "fr"]
    texts = [" ".join(f"word{(i * j) % 997}" for j in range(400)) for i in range(2000)]
    apart = [np.concatenate(x) for x in zip(*(model.scores(texts[i : i + 1]) for i in range(0, 2000, 50)))]
    tracemalloc.start()
    together = model.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6  # all words' rows at once are 2000 * 400 * 5 * 12 bytes
    assert all((a == b[::50]).all() for a, b in zip(apart, together, strict=True))
    assert len(model.scores([])[2]) == 0
