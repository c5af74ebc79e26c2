"""The pipeline's stages against brute force on a small fixture, and the registered queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexispan.llm import packing, registry
from lexispan.llm.common import by_rows

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and after.keys() <= before.keys() and after
        assert name == "lines" or all(after[k]["text"] == before[k]["text"] for k in after)
        if name == "lines":
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
            seen: list[set] = []
            for k in sorted(before):
                kept = []
                for line in before[k]["text"].split("\n"):
                    s = set(line.split(" ")) - {""}
                    if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                        kept.append(line)
                    if s:
                        seen.append(s)
                assert after[k]["text"] == "\n".join(kept) if k in after else not "".join(kept).strip()
        if name == "near duplicates":
            from test_shinglejoin import brute as groups

            assert after.keys() == groups([(k, r["text"]) for k, r in sorted(before.items())])
        if name == "benchmark":
            from test_models import brute

            items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert after.keys() == {k for k, r in before.items() if brute(r["text"], items)[1] == 0}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == after.keys()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    shown = lambda df: sorted(tuple(str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert columns == sorted(want.columns) and shown(got) == shown(want)


KIND = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, _n int, id int, `row` int"


def odd_rows():
    """Nulls, repeated rows and ids, ties, empty and very long texts."""
    some = [(7, "the cat sat on the mat and then it ran"), (7, "the cat sat on the mat and then it ran"), (7, "quite another text of the same id, not like the first"), (None, "rows without an id are rows too, each its own one"), (None, None), (3, None), (4, ""), (5, "\n \n"), (-9, "!!! 123"), (2**62, "one word\n" * 20_000), (2**62 + 1, "w " * 200_000)]
    return [(d, t, "en" if t else None, "s", len(t) if t else None, 1, 2, 3, 4) for d, t in some]


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    rows = odd_rows()
    docs = spark.createDataFrame(rows, KIND)
    out = stage(spark, docs, SF)
    got = out.collect()
    assert stage(spark, spark.createDataFrame([], KIND), SF).count() == 0
    if name == "packing":
        assert sorted(r["length"] for r in got if r["doc_id"] in (3, 4)) == [1, 1] and sum(r["piece"] == 0 for r in got) == len(rows)
        return
    assert out.columns == docs.columns and all((r["a.b"], r["_n"], r["id"], r["row"]) == (1, 2, 3, 4) for r in got)
    seen = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in got)
    texts = [t for _, t in seen]
    if name == "language":
        assert "" not in texts and "!!! 123" not in texts and "\n \n" not in texts
    if name == "lines":
        assert texts.count(rows[0][1]) == 1 and (2**62, "one word\n") in seen and (3, "") in seen and (4, "") in seen and (2**62 + 1, "w " * 200_000) in seen
    if name == "near duplicates":
        assert texts.count(rows[0][1]) == 1 and rows[2][1] in texts and rows[3][1] in texts
    if name == "benchmark":
        assert len(got) == len(rows)


def test_a_stage_lets_go_of_what_another_kept(spark):
    """Workers are shared by a pipeline's stages, and each stage's memory of words or chunks is large."""
    docs = spark.createDataFrame([(i, f"a few words {i}") for i in range(64)], "doc_id long, text string").repartition(16)
    assert packing.pieces(docs, "word_bpe_49k.json", 0, 2048).count() == 64

    def encoders(texts):
        import gc

        return {"n": [sum(type(x).__name__ == "Encoder" for x in gc.get_objects())] * len(texts)}

    assert by_rows(docs, encoders, "n int").agg({"n": "max"}).first()[0] == 0
