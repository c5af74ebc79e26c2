"""Readers and writers of the engine's files: corpora, transcripts, confusions, playlists, events and reports."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispan.functions import text as T

CORPUS = "id int, name string, transliteration string, type string, total_verses int, verses array<struct<id:int,text:string>>"
WORD = "word string, start_s double, end_s double, start_ts string, end_ts string, probability double, estimated boolean"
TRANSCRIPT = f"language string, language_probability double, duration_s double, segments array<struct<start_s:double,end_s:double,start_ts:string,end_ts:string,text:string,avg_probability:double,words:array<struct<{WORD.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean').replace(', ', ',')}>>>>"
PLAYLIST = "label string, audio string, start_s double, max_s double, silence_s double"


def corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """group_id, group_name, transliteration, type, doc_num, text, doc_key from a JSON list of groups."""
    g = spark.read.schema(CORPUS).json(path, multiLine=True).select("*", F.explode("verses").alias("v"))
    return g.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"), T.casefold(F.col("transliteration")).alias("transliteration"), "type", F.col("v.id").alias("doc_num"), F.col("v.text").alias("text"), T.composite_key(F.col("id"), F.col("v.id")).alias("doc_key"))


def write_corpus(docs: DataFrame, path: str) -> None:
    """Parquet by group, so that a lookup of one group reads its files alone."""
    docs.write.mode("overwrite").partitionBy("group_id").parquet(path)


def lookup(docs: DataFrame, group_id: int, doc_num: int) -> DataFrame:
    return docs.where((F.col("group_id") == group_id) & (F.col("doc_num") == doc_num)).limit(1)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of any store that Spark reads; none if there is no such folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def latest_version(spark: SparkSession, path: str) -> str:
    """path if it holds meta.json, else the last of its folders that does."""
    names = listed(spark, path)
    if "meta.json" in names:
        return path
    found = [d for d in names if "meta.json" in listed(spark, f"{path}/{d}")]
    if not found:
        raise FileNotFoundError(f"no version under {path}")
    return f"{path}/{found[-1]}"


def vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    """token, token_id from {"id_to_token": [...]}; empty tokens go."""
    v = spark.read.schema("id_to_token array<string>").json(path, multiLine=True)
    return v.select(F.posexplode("id_to_token").alias("token_id", "token")).where("token <> ''").select("token", "token_id")


@dataclass(frozen=True)
class Caps:
    skip_reference: float = 0.0
    skip_observed: float = 0.0


def confusions_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(defaults: one row of skip_reference, skip_observed, substitute; pairs: ref_id, obs_id, cost). The substitution is held to 0.25 to 5."""
    kind = "defaults struct<global_ref_del_cost:double,global_obs_ins_cost:double,fallback_sub_cost:double>, sub_cost map<string,array<array<double>>>"
    c = spark.read.schema(kind).json(path, multiLine=True)
    d = lambda name, value: F.coalesce(F.col(f"defaults.{name}"), F.lit(value))
    defaults = c.select(d("global_ref_del_cost", 2.0).alias("skip_reference"), d("global_obs_ins_cost", 2.0).alias("skip_observed"), F.greatest(F.least(d("fallback_sub_cost", 2.5), F.lit(5.0)), F.lit(0.25)).alias("substitute"))
    pairs = c.select(F.explode("sub_cost").alias("ref_id", "rows")).select(F.col("ref_id").cast("int"), F.explode("rows").alias("r"))
    return defaults, pairs.select("ref_id", F.get("r", F.lit(0)).cast("int").alias("obs_id"), F.get("r", F.lit(1)).alias("cost"))


def confusion_words(pairs: DataFrame, vocabulary: DataFrame) -> list[tuple[str, str, float]]:
    """(reference word, observed word, cost) of confusions_json's pairs, as alignment takes them; as many as the file has. vocabulary: token, token_id."""
    name = lambda k, w: vocabulary.select(F.col("token_id").alias(k), F.col("token").alias(w))
    both = pairs.join(name("ref_id", "r"), "ref_id").join(name("obs_id", "o"), "obs_id")
    return [(x["r"], x["o"], x["cost"]) for x in both.select("r", "o", "cost").orderBy("r", "o").collect()]


def capped(cost, cap: float):
    """A cost under a cap, which is at least 0.05 if it is positive at all."""
    return F.least(cost, F.lit(max(cap, 0.05))) if cap > 0 else cost


def transcript_json(spark: SparkSession, path: str) -> DataFrame:
    """file, seg, seg_start, seg_end, text, word_pos, word, start_s, end_s, estimated; a segment without words has one row of nulls."""
    t = spark.read.schema(TRANSCRIPT).json(path, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("segments").alias("seg", "s"))
    w = t.select("file", "seg", "s", F.posexplode_outer("s.words").alias("word_pos", "w"))
    return w.select("file", "seg", F.col("s.start_s").alias("seg_start"), F.col("s.end_s").alias("seg_end"), F.col("s.text").alias("text"), "word_pos", F.col("w.word").alias("word"), F.col("w.start_s").alias("start_s"), F.col("w.end_s").alias("end_s"), F.coalesce("w.estimated", F.lit(False)).alias("estimated"))


def transcript_text(spark: SparkSession, path: str) -> DataFrame:
    """file, seg, word_pos, start_s, end_s, word from lines "[a --> b] text", each followed by its words' "a --> b word"; words before a header go."""
    head, word = r"^\s*\[(\S+)\s*-->\s*(\S+)\]\s*(.*)$", r"^\s*([0-9:.]+)\s*-->\s*([0-9:.]+)\s+(.*)$"
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    is_head = F.regexp_like("line", F.lit(head)).cast("int")
    w = Window.partitionBy("file").orderBy("at")
    rows = lines.withColumn("seg", F.sum(is_head).over(w) - 1).where((F.col("seg") >= 0) & F.regexp_like("line", F.lit(word)))
    pos = F.row_number().over(Window.partitionBy("file", "seg").orderBy("at")) - 1
    get = lambda k: F.regexp_extract("line", word, k)
    return rows.select("file", "seg", pos.alias("word_pos"), T.parse_timestamp(get(1)).alias("start_s"), T.parse_timestamp(get(2)).alias("end_s"), F.trim(get(3)).alias("word"))


def playlist(spark: SparkSession, path: str) -> DataFrame:
    """label, kind (audio, silence), audio, start_s, max_s, silence_s; an entry of neither or both kinds is an error."""
    p = spark.read.schema(PLAYLIST).json(path, multiLine=True)
    kind = F.when(F.col("audio").isNotNull() & F.col("silence_s").isNull(), "audio").when(F.col("silence_s").isNotNull() & F.col("audio").isNull(), "silence")
    return p.withColumn("kind", F.coalesce(kind, F.raise_error(F.concat(F.lit("playlist entry is neither audio nor silence: "), F.coalesce("label", F.lit("?"))))))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, by: str) -> None:
    """One JSON document: a list with an object a row, in the order of by. Reports have a row a group and stand in one task."""
    rows = df.select(F.struct(F.col(by).alias("k"), F.struct("*").alias("row")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("all"))
    rows.select(F.to_json(F.transform("all", lambda r: r["row"])).alias("value")).write.mode("overwrite").text(path)


def event_sink(df: DataFrame, path: str, checkpoint: str):
    """A streaming query that writes each event as a line of JSON."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def wav(samples: bytes, rate: int = 16000) -> bytes:
    """16-bit mono samples with their RIFF header."""
    import struct

    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(samples)) + samples


def wav_seconds(content) -> object:
    """The duration of a column of such files."""
    return (F.octet_length(content) - 44) / 32000


def embedding_text(vector) -> object:
    """A column of unit-length vectors as base64 of 16-bit floats; Arrow-batched, as Spark has no such type."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(v):
            a = np.asarray(v, np.float64)
            return base64.b64encode((a / (np.linalg.norm(a) or 1)).astype("<f2").tobytes()).decode()

        return s.map(one)

    return run(vector)
