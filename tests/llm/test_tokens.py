"""Token file and packing against the library and brute force."""

import zlib
from functools import cache

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexispan.llm import packing, tokenfile
from lexispan.llm.bpe import Encoder

TEXTS = [None, "", " ", "a", "Hello  world\n\n x", "tab\tand nbsp \n", "été naïve Straße", "x<|endoftext|>y", "It's we'lĺ 42 !!", "word " * 3000]
TEXT = st.text(alphabet=st.sampled_from("ab \n\t.,'sé́ 0!\x1c Z"), max_size=40)


@cache
def loaded(name, dropped):
    return Encoder(P.path(name), dropped, 0), Tokenizer.from_file(P.path(name))


@pytest.mark.parametrize("name, dropped", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_chunks_give_the_whole_texts_ids(name, dropped, texts):
    enc, whole = loaded(name, dropped)
    ids, bounds = enc.ids(texts)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 0]


@settings(max_examples=100, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60), min_size=1, max_size=30))
def test_segment_round_trip_and_random_access(docs):
    flat = np.array([x for d in docs for x in d], np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    s = tokenfile.Segment(tokenfile.pack(flat, starts, [None, *range(1, len(docs))]))
    assert s.doc_ids == [None, *range(1, len(docs))]
    assert [s.document(k).tolist() for k in range(len(docs))] == docs
    assert [s.token(i) for i in range(len(flat))] == flat.tolist()


def test_segment_access_over_many_blocks():
    ids = np.random.default_rng(0).integers(0, 70000, 5000).astype(np.uint32)
    s = tokenfile.Segment(tokenfile.pack(ids, np.array([0, 5000]), [1]))
    assert [s.token(i) for i in range(5000)] == ids.tolist()
    assert all(s.tokens(a, b).tolist() == ids[a:b].tolist() for a, b in ((0, 0), (3, 700), (511, 513), (512, 1025), (4999, 5000)))


def rows(spark, texts, first=0):
    return spark.createDataFrame([(first + i * 3, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, start string, shard int").repartition(3)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_file(spark):
    whole, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in tokenfile.token_file(rows(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i * 3]["start"], got[i * 3]["n_tokens"], got[i * 3]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_token_file_empty_null_and_repeated(spark):
    assert tokenfile.token_file(rows(spark, []), ).count() == 0
    two = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a"), (0, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["start"]) for r in tokenfile.token_file(two).orderBy("start").collect()]
    assert got == [(None, 0), (0, 2), (1, 3), (1, 5)]


def test_packing(spark):
    whole = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = TEXTS * 6
    got = packing.pack_documents(rows(spark, texts)).collect()
    seen: dict[int, list] = {}
    for r in got:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seen.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = 0
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i * 3)
        assert own == [(k, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))]
        total += len(ids)
    assert len(seen) <= -(-total // 2048) + 1
    assert packing.pack_documents(rows(spark, [])).count() == 0


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_every_capacity_holds(choose):
    lengths = np.random.default_rng(1).integers(1, 60, 500)
    plain, _ = packing.best_fit(lengths, 100, choose=choose)
    cost = lambda bins: max((lengths[bins == b] ** 2).sum() for b in set(bins.tolist()))
    assert cost(plain) > 4000
    for documents, attention in ((3, 10000), (100, 4000), (3, 4000)):
        bins, _ = packing.best_fit(lengths, 100, documents, attention, choose=choose)
        held = [lengths[bins == b] for b in set(bins.tolist())]
        assert all(x.sum() <= 100 and len(x) <= documents for x in held) and cost(bins) <= attention
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), 100)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([70]), 100, attention=4000)


def test_tokens_at_any_place(spark):
    docs = rows(spark, TEXTS)
    path = tokenfile.scratch(spark, "tokens")
    tokenfile.write_tokens(docs, path, segment_tokens=50)
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [i for t in TEXTS for i in (*whole.encode(t or "", add_special_tokens=False).ids, 0)]
    places = [0, 1, len(ids) - 1, *range(3, len(ids), 17)]
    assert {r["place"]: r["token"] for r in tokenfile.tokens_at(spark, path, [-1, *places, len(ids)]).collect()} == {i: ids[i] for i in places}


def test_packing_spreads_equal_rows(spark):
    got = packing.pack_documents(spark.createDataFrame([(None, None)] * 3000, "doc_id long, text string"), shard_pieces=500).collect()
    shards = {r["sequence_id"] >> 40 for r in got}
    assert len(got) == 3000 and len(shards) == 6
