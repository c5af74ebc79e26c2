"""URL rules, found by their rarest literal token.

A rule is a host and a path prefix ("*" in the prefix stands for any characters), for the host and its
subdomains. Each rule is filed under that of its whole tokens which is rarest among the URLs' tokens. A
URL's tokens fetch the rules filed under them, and only those rules' regular expressions run.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import ascii_lower, column, whole

TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def pattern(self) -> str:
        path = ".*".join(map(re.escape, self.path.split("*")))
        return rf"(?s:(?:[^/]*\.)?{re.escape(self.host)}{path or '(?:/|$)'})"

    def tokens(self) -> set[str]:
        """Tokens that every fitting URL has whole: not those cut off at the end or beside a wildcard."""
        found = set(TOKEN.findall(self.host))
        for m in TOKEN.finditer(self.path):
            after = self.path[m.end() : m.end() + 1]
            if after and after != "*" and self.path[m.start() - 1 : m.start()] not in ("*", ""):
                found.add(m[0])
        return found


def parsed(rules: Sequence[tuple[str, str]]) -> list[Rule]:
    """(verdict, "host/path") pairs as rules; hosts in lower case."""
    return [Rule(v, *(lambda h, s, p: (h.lower(), s + p))(*x.partition("/"))) for v, x in rules]


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(pages: DataFrame, rules: list[Rule], first: int) -> DataFrame:
    """pages with _rule and _verdict of the longest rule that fits, against what they hold already."""
    wanted = sorted(set().union(*(r.tokens() for r in rules)))
    tokens = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(F.concat("_host", F.lit(" "), "_path"), F.lit(r"([0-9A-Za-z\x{80}-\x{10ffff}]+)"), 1))).alias("t"))
    counts = {r["t"]: r["count"] for r in tokens.join(F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in wanted], "t string")), "t", "left_semi").groupBy("t").count().collect()} if wanted else {}
    filed: dict[str | None, list[tuple[int, int, str, str, str]]] = defaultdict(list)
    for i, r in enumerate(rules):
        key = min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default=None)  # no whole token: tried on every URL
        filed[key].append((-len(r.text), first + i, r.pattern(), r.text, r.verdict))
    held = pages.sparkSession.sparkContext.broadcast(dict(filed))
    rows = pages.select(whole(pages))
    schema = StructType([StructField("row", rows.schema["row"].dataType), *StructType.fromDDL("best struct<order:int,at:int,rule:string,verdict:string>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[str, re.Pattern] = {}
        filed = held.value
        for b in batches:
            rows = b.column(0)
            hosts, paths, were = (pc.struct_field(rows, n).to_pylist() for n in ("_host", "_path", "_best"))
            out = []
            for h, p, w in zip(hosts, paths, were, strict=True):
                url = h + p
                best = (w["order"], w["at"], w["rule"], w["verdict"]) if w else None
                some = [x for t in {None, *TOKEN.findall(h), *TOKEN.findall(p)} for x in filed.get(t, ())]
                for order, at, pattern, text, verdict in sorted(some):
                    if best and (order, at) > best[:2]:
                        break
                    if pattern not in compiled:
                        compiled[pattern] = re.compile(pattern)
                    if compiled[pattern].match(url):
                        best = (order, at, text, verdict)
                        break
                out.append(dict(zip(("order", "at", "rule", "verdict"), best, strict=True)) if best else None)
            yield pa.RecordBatch.from_pydict({"row": rows, "best": pa.array(out, pa.struct({"order": pa.int32(), "at": pa.int32(), "rule": pa.string(), "verdict": pa.string()}))})

    made = rows.mapInArrow(run, schema)
    return made.select(F.struct("row.row", "row._host", "row._path", F.col("best").alias("_best")).alias("x")).select("x.*")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", otherwise: str = "allow", block: int = 50_000) -> DataFrame:
    """All of pages' rows and columns in a struct named row, with host, path, rule and verdict.

    The longest rule that fits wins; of equal ones, the first. A url that is null or has no "://" has an
    empty host and path, fits no rule and gets the verdict `otherwise`, as does any that no rule fits. An
    empty table gives no rows. Rules are taken `block` at a time, so a worker never holds more.
    """
    known = parsed(rules)
    kind = "struct<order:int,at:int,rule:string,verdict:string>"
    u = column(url)
    rows = pages.select(whole(pages), host(u).alias("_host"), path(u).alias("_path"), F.lit(None).cast(kind).alias("_best"))
    for i in range(0, len(known), block):
        rows = _block(rows, known[i : i + block], i)
    return rows.select("row", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict"))
