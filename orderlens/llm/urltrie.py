"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

The trie walks a host from its last label and then the path segment by segment; every node
on the way whose entry fits is a match, and the deepest one decides: most host labels
first, then the longest path. The host part is walked once per distinct host of a batch.

A trie is broadcast only up to :data:`SLICE_BYTES` of rule text. A larger rule table is
dealt into slices by hash; each slice takes a pass of its own over the pages, whose best
match so far is stored in between, so no broadcast grows with the rules.

Defined cases: a null url, or one without ``://``, has an empty host and path; an empty host
or path is a value like any other (only a rule whose path is empty fits an empty path);
rules with a null or empty host or a null verdict are no rules, a null rule path is empty;
of rules that repeat a host and path ``block`` counts; a very long url costs time in
proportion; repeated pages are judged each for itself; input columns pass through inside
``page``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import drop_stored, lower_ascii, store

#: bytes of rule text in one broadcast trie
SLICE_BYTES = 8 << 20
MATCH = "struct<labels:int,length:int,verdict:string,rule:string>"
_ARROW = pa.struct([("labels", pa.int32()), ("length", pa.int32()), ("verdict", pa.string()), ("rule", pa.string())])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/``, ``?`` or ``#`` (A-Z lower-cased), then up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def build_trie(rules: Iterable[tuple[str, str, str]]) -> tuple[dict, dict]:
    """(edges, entries) of (host, path, verdict) rules.

    ``edges`` leads from (node, label or segment) to a node; a step by None goes from a host
    to its paths. ``entries`` holds, by node, the rules that end there: what must still
    begin the next segment, longest first, with the match to return.
    """
    edges: dict[tuple[int, str | None], int] = {}
    entries: dict[int, list] = {}

    def step(node: int, key: str | None) -> int:
        return edges.setdefault((node, key), len(edges) + 1)

    for host, path, verdict in rules:
        node, labels = 0, host.split(".")
        for label in reversed(labels):
            node = step(node, label)
        node = step(node, None)
        *whole, rest = path.split("/")
        for segment in whole:
            node = step(node, segment)
        entries.setdefault(node, []).append((rest, (len(labels), len(path), verdict, host + path)))
    for found in entries.values():
        found.sort(key=lambda e: -len(e[0]))
    return edges, entries


def host_nodes(edges: dict, host: str) -> list[int]:
    """Path roots of the rules' hosts that the host equals or lies under, the longest host first."""
    node, found = 0, []
    for label in reversed(host.split(".")):
        node = edges.get((node, label))
        if node is None:
            break
        if (node, None) in edges:
            found.append(edges[node, None])
    return found[::-1]


def longest_match(edges: dict, entries: dict, roots: list[int], path: str) -> tuple | None:
    """The match of the first root that has one: there, the rule with the longest path that begins ``path``."""
    segments = path.split("/")
    for node in roots:
        best = None
        for segment in segments:
            best = next((match for rest, match in entries.get(node, ()) if segment.startswith(rest)), best)
            node = edges.get((node, segment))
            if node is None:
                break
        if best:
            return best
    return None


def _matcher(rules: list[tuple[str, str, str]], df: DataFrame):
    shared = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.arrow_udf(MATCH)
    def match(host: pa.Array, path: pa.Array) -> pa.Array:
        edges, entries = shared.value
        coded = host.dictionary_encode()
        roots = [host_nodes(edges, h) for h in coded.dictionary.to_pylist()]
        found = [longest_match(edges, entries, roots[h], p) if roots[h] else None
                 for h, p in zip(coded.indices.to_pylist(), path.to_pylist())]
        return pa.array([f and dict(zip(("labels", "length", "verdict", "rule"), f)) for f in found], _ARROW)

    return match


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
               slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``page`` (the row), ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``
    (the rule's, else ``default``). ``rules`` has the columns host, path and verdict."""
    host, path = host_and_path(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")))
    df = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), host.alias("host"),
                      path.alias("path"), F.lit(None).cast(MATCH).alias("best"))
    known = (rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .where("host != '' and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    known = store(known, "rules")
    total = known.agg(F.sum(F.octet_length("host") + F.octet_length("path"))).first()[0] or 0
    slices = max(1, ceil(total / slice_bytes))
    last = None
    for k in range(slices):
        mine = known.where(F.pmod(F.xxhash64("host", "path"), F.lit(slices)) == k).collect()
        match = _matcher([(r.host, r.path, r.verdict) for r in mine], df)
        df = df.select("page", "host", "path", F.greatest(F.col("best"), match("host", "path")).alias("best"))
        if k + 1 < slices:
            df = store(df, "urls")
            if last is not None:
                drop_stored(df.sparkSession, last)
            last = df
    drop_stored(df.sparkSession, known)
    return df.select("page", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
