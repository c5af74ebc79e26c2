"""SimHash components and weighted sampling against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash

from lexispan.llm import cws, simhash

rng = random.Random(3)
WORDS = [f"w{i}" for i in range(60)]


def texts(n):
    out = [None, "", "  ", "a", "A", "a b", "a b c", "é É", "x " * 5000]
    while len(out) < n:
        if rng.random() < 0.5 and len(out) > 20:
            w = (rng.choice(out) or "q").split() or ["q"]
            w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choices(WORDS, k=rng.randrange(3, 200))))
    return out


def slow_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, bits):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits and root(i) != root(j):
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, d in enumerate(ids)}


def test_components_over_shards(spark):
    all_ = texts(400)
    docs = spark.createDataFrame([(i * 7 % 1009, t, i) for i, t in enumerate(all_)], "doc_id long, text string, fp long").repartition(5)
    fps = [slow_fingerprint(t) for t in all_]
    want = slow_components([i * 7 % 1009 for i in range(len(all_))], fps, 2)
    for shard_size in (16384, 20):
        got = simhash.near_duplicates(docs, shard_size=shard_size).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got} == {i * 7 % 1009: f for i, f in enumerate(fps)}


def test_simhash_nulls_repeats_and_empty_tables(spark):
    kind = "doc_id long, text string, node string"
    assert simhash.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = spark.createDataFrame([(None, "a b", "x"), (5, "a b", "x"), (5, "a b", "x"), (3, None, None), (4, "", None)], kind)
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(rows).collect())
    assert got == [(-1, 5), (3, 3), (4, 3), (5, 5), (5, 5)]
    kept = simhash.one_of_each(rows)
    assert kept.columns == rows.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3]  # a row without an id comes first, and its copies go


def test_links_in_a_dense_group():
    r = np.random.default_rng(5)
    base = np.uint64(0x0123456789ABCDEF)
    points = np.unique([base ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, 3).astype(np.uint64)) for _ in range(3000)])
    assert len(set(simhash.linked(points, 2).tolist())) == 1
    assert (simhash.linked(points, 0) == np.sort(points)).all()


def test_the_sampler_estimates_generalised_jaccard():
    sampler, errors = cws.Sampler(256), []
    for _ in range(40):
        a = rng.choices(WORDS, k=120)
        b = a[: rng.randrange(120)] + rng.choices(WORDS, k=60)
        x, y = Counter(a), Counter(b)
        true = sum((x & y).values()) / sum((x | y).values())
        codes = sampler.fingerprints([" ".join(a), " ".join(b)])
        errors.append(float(cws.likeness(codes[:1], codes[1:])[0]) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_document_fingerprints(spark):
    all_ = texts(700)
    ids = [i * 11 % 1999 for i in range(len(all_))]
    docs = spark.createDataFrame([(d, t, "s") for d, t in zip(ids, all_, strict=True)], "doc_id long, text string, _shard string").repartition(7)
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    following = {ids[i]: all_[order[(k + 1) % len(order)]] or "" for k, i in enumerate(order)}
    got = {r["doc_id"]: r for r in cws.document_fingerprints(docs).collect()}
    assert len(got) == len(all_)
    sampler = cws.Sampler()
    for d, t in zip(ids, all_, strict=True):
        t, n = t or "", following[d]
        q = len(t) // 4
        changed = t[: len(t) - q] + n[:q]
        f = sampler.fingerprints([t, changed, n])
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert [r["fingerprint"], r["edited_fingerprint"]] == cws.spelt(f[:2])
        assert (r["near_edited"], r["near_next"]) == ((f[0] == f[1]).mean(), (f[0] == f[2]).mean())


def test_document_fingerprints_of_few_rows(spark):
    kind = "doc_id long, text string"
    assert cws.document_fingerprints(spark.createDataFrame([], kind)).count() == 0
    (r,) = cws.document_fingerprints(spark.createDataFrame([(9, "abcd efgh")], kind)).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()
    got = cws.document_fingerprints(spark.createDataFrame([(None, "aaaa"), (None, "bbbb"), (2, "cccc"), (2, "cccc")], kind)).collect()
    assert sorted(r["edited_sha256"] for r in got) == sorted(hashlib.sha256(x.encode()).hexdigest() for x in ("aaab", "bbbc", "cccc", "ccca"))


def test_codes_against_a_scalar_computation():
    """Each draw's sample from the definition, a word at a time, with numpy's scalars."""
    import math

    sampler = cws.Sampler(8)
    text = "one two two three three three FOUR four five " * 3
    bag = Counter(text.lower().split())
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def gamma(i):  # the quantile of gamma(2, 1) at (i + 0.5) / 65536
        low, high = 0.0, 40.0
        for _ in range(60):
            x = (low + high) / 2
            low, high = (x, high) if 1 - (1 + x) * math.exp(-x) < (i + 0.5) / 65536 else (low, x)
        return x

    want = []
    for k in range(8):
        best = None
        for w, n in bag.items():
            h = xxhash.xxh64_intdigest(w.encode())
            u = mix(h ^ mix((k + 1) * 0x9E3779B97F4A7C15 & mask))
            r, beta = np.float32(gamma(u & 0xFFFF)), np.float32((u >> 16 & 0xFFFF) / 65536)
            t = np.floor(np.float32(math.log(n)) / r + beta)
            score = np.float32(math.log(gamma(u >> 32 & 0xFFFF))) - r * (t - beta + np.float32(1))
            code = mix((h + int(t) * 0x9E3779B97F4A7C15) & mask) >> 32
            best = min(x for x in (best, (score, code)) if x)
        want.append(best[1] & 0xFFFF)
    assert sampler.fingerprints([text])[0].tolist() == want


def test_texts_of_very_many_words():
    """Draws that don't fit in one table are reduced bit by bit to the same codes."""
    sampler, r = cws.Sampler(16), random.Random(1)
    some = [" ".join(f"w{r.randrange(5000)}" for _ in range(n)) for n in (3000, 0, 10, 4000)]
    assert (sampler.fingerprints(some) == sampler.fingerprints(some, most=100)).all()


def test_shards_and_next_documents_of_rows_without_ids(spark):
    """Nulls and repeats are numbered, so each row has one next row, over any number of shards."""
    rows = [(None, f"n{i} text") for i in range(500)] + [(i, f"d{i} text") for i in range(700)] + [(3, "d3 text")]
    got = cws.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((d is not None, d or 0, len(t)) for d, t in rows)
