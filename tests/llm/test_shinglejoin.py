"""Near copies by the similarity of their shingles against brute force."""

import random

import numpy as np

from lexispan.llm import shinglejoin, simhash


def brute(rows: list[tuple[int, str]], bits: int = 3) -> set[int]:
    sets = {k: set(shinglejoin.shingles(t, 5).tolist()) for k, t in rows}
    fps = {k: simhash.fingerprint(t, 5) for k, t in rows}
    top = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            like = [b for b in sets if bin(fps[a] ^ fps[b]).count("1") <= bits or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) > 0]
            least = min(top[b] for b in like)
            changed |= least < top[a]
            top[a] = min(top[a], least)
    return set(top.values())


def edited(r: random.Random, words: list[str], every: int, wrap: int = 23) -> str:
    w = [f"new{r.randrange(10**6)}" if i % every == every // 2 else x for i, x in enumerate(words)]
    return "\n".join(" ".join(w[i : i + wrap]) for i in range(0, len(w), wrap))


def test_rewrapped_lightly_edited_copies_go(spark):
    r = random.Random(3)
    rows = []
    for k in range(60):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(150, 400))]
        rows += [(2 * k, "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))), (2 * k + 1, edited(r, words, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    far = [bin(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).count("1") for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert np.mean(np.array(far) > 3) > 0.5
    assert {x["doc_id"] for x in simhash.one_of_each(docs).collect()} == {2 * k for k in range(60)} == brute(rows)


def test_groups_chains_and_shared_passages(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(3000)}" for _ in range(200)]
    passage = [f"p{i}" for i in range(60)]
    texts = [edited(r, base, e) for e in (9, 15, 20, 25, 30, 40, 50, 60, 80, 100) for _ in range(4)]  # about the threshold
    chain = list(base[::-1])
    for i in range(12):  # each is like the next, the ends are not
        texts.append(" ".join(chain))
        chain[i * 12 : i * 12 + 6] = [f"c{i}x{j}" for j in range(6)]
    texts += [" ".join(passage + [f"q{r.randrange(10**6)}" for _ in range(n)]) for n in range(0, 60, 2)]  # the passage is most or half of the text
    texts += ["", "a b", "a b", "A  B", "a b c d e", "a b c d e f"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x["doc_id"] for x in simhash.one_of_each(docs).collect()} == brute(rows)
