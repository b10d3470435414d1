"""Operator 7: URL rules and host lists by Bloom filter cascades.

A cascade answers "is this key listed?" without a join and without error for every
key of a known universe.  Level 0 is a Bloom filter of the listed keys, level 1 one
of the unlisted universe keys that level 0 lets through, level 2 one of the listed
keys that level 1 lets through, and so on until no key is let through wrongly.  A
key is looked up level by level; the first filter that misses it decides.

The universe is complete: every candidate key of every url of the corpus (host
suffixes, each alone and with the path prefixes whose lengths occur in rules).
Spark counts and collects it as hash pairs by one aggregation; the filters are made
by ``bit_or`` aggregations, so only finished bits reach the driver.  Filters are
broadcast; the keys are cut by hash into as many cascades as it takes to keep one
below ``max_bits``, and the cascades are applied one after the other.

Rules are (action, host, path); a rule fits its host and all subdomains if the
url's path starts with the rule's path; the longest rule text wins, block before
allow between equals.  Without a fitting rule a url is blocked if its host or a
parent of it is on the host list, else allowed.  A NULL url, or one without
``://``, has empty host and path, no rule and is allowed.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import run_folder, stage

MAX_BITS = 1 << 30             # bits of one cascade level that are broadcast at once
DEEP_RATE = 0.5                # false-positive rate of levels above 0
SALT = 77


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; only A-Z of the host are lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Keys of a url that a list can hold, longest first: host suffixes of ``labels``
    labels, alone and followed by the first ``lengths`` characters of the path."""
    parts = F.split(host, r"\.")
    keys = []
    for n in labels:
        suffix = F.array_join(F.slice(parts, F.size(parts) - n + 1, F.lit(n)), ".")
        fits = (F.size(parts) >= n) & (host != "")
        keys.append(F.when(fits, suffix))
        keys += [F.when(fits & (F.length(path) >= k), F.concat(suffix, path.substr(1, k))) for k in lengths]
    if not keys:
        return F.array().cast("array<string>")
    sized = F.transform(F.array_compact(F.array(*keys)), lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))
    return F.transform(F.sort_array(F.array_distinct(sized), asc=False), lambda x: x["k"])


def hash_pair(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(SALT))


class Cascade:
    """Bloom filter levels; ``contains`` takes the hash pairs of keys."""

    def __init__(self, levels: list[tuple[int, int, np.ndarray]]):
        self.levels = levels

    @staticmethod
    def _in(level: tuple[int, int, np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits, k, words = level
        out = np.ones(len(h1), bool)
        for j in range(k):
            pos = np.mod(np.mod(h1, bits) + j * np.mod(h2, bits), bits)
            out &= (words[pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1) != 0
        return out

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Keys that every level so far lets through."""
        return reduce(np.logical_and, (self._in(x, h1, h2) for x in self.levels), np.ones(len(h1), bool))

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.arange(len(h1))
        for i, level in enumerate(self.levels):
            hit = self._in(level, h1[open_], h2[open_])
            found[open_[~hit]] = i % 2 == 1
            open_ = open_[hit]
        return found


def bloom_level(keys: DataFrame, n: int, rate: float, level: int = 0) -> tuple[int, int, np.ndarray]:
    """(bits, hashes, words) of a Bloom filter of ``keys`` (h1, h2); made by Spark.

    The modulus differs from level to level, so keys that meet in one level part in a
    later one also where filters are tiny."""
    bits = (max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2)) | 1) + 2 * level
    k = max(1, round(-math.log2(rate)))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                               lambda j: F.pmod(F.pmod("h1", F.lit(bits)) + j * F.pmod("h2", F.lit(bits)), F.lit(bits)))).alias("at")
    words = (keys.select(at).select(F.shiftright("at", 6).alias("w"), (F.col("at") % 64).cast("int").alias("b"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")))
    out = np.zeros(bits // 64 + 1, np.uint64)
    got = words.toPandas()             # at most bits / 64 rows
    out[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64).view(np.uint64)
    return bits, k, out


def build_cascade(keys: DataFrame, n_listed: int, n_rest: int) -> Cascade:
    """Cascade of the rows of ``keys`` (h1, h2, listed) that are listed."""
    cascade = Cascade([])
    rate = min(DEEP_RATE, max(1e-6, n_listed * math.sqrt(0.5) / max(1, n_rest)))
    side, n = keys.filter("listed"), n_listed
    while n:
        cascade.levels.append(bloom_level(side, n, rate, len(cascade.levels)))
        other = keys.filter("NOT listed" if len(cascade.levels) % 2 else "listed")
        side = _passing(other, cascade)
        n, rate = side.count(), DEEP_RATE
    return cascade


def _passing(keys: DataFrame, cascade: Cascade) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(list(cascade.levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Cascade(shared.value)
        for b in batches:
            h1, h2 = (np.asarray(b.column(i), dtype=np.int64) for i in (0, 1))
            yield b.filter(pa.array(c.passes(h1, h2)))

    return keys.select("h1", "h2", "listed").mapInArrow(run, "h1 long, h2 long, listed boolean")


def build_cascades(universe: DataFrame, listed: DataFrame, folder: str, name: str,
                   max_bits: int = MAX_BITS) -> list[Cascade]:
    """Cascades of ``listed`` (h1, h2) over ``universe`` (h1, h2); key h1 belongs to
    the one numbered h1 modulo their count."""
    both = universe.select("h1", "h2", F.lit(False).alias("listed"), F.lit(True).alias("there")).union(
        listed.select("h1", "h2", F.lit(True).alias("listed"), F.lit(False).alias("there")))
    keys = stage(both.groupBy("h1", "h2").agg(F.max("listed").alias("listed"), F.max("there").alias("there"))
                 .filter("there").drop("there"), folder, name)
    counts = {r.listed: r.n for r in keys.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = counts.get(True, 0) * 30 + counts.get(False, 0) // 8       # bits of the largest level, at most
    n = max(1, math.ceil(most / max_bits))
    out = []
    for g in range(n):
        part = keys if n == 1 else keys.filter(F.pmod(F.col("h1"), F.lit(n)) == g)
        if n > 1:
            counts = {r.listed: r.n for r in part.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
        out.append(build_cascade(part, counts.get(True, 0), counts.get(False, 0)))
    return out


def first_listed(rows: DataFrame, cascades: list[Cascade], out: str) -> DataFrame:
    """Adds ``out``: the 1-based place of the first listed key in a row's h1/h2 arrays,
    0 if none is listed."""
    n = len(cascades)
    for g, cascade in enumerate(cascades):
        shared = rows.sparkSession.sparkContext.broadcast(cascade.levels)
        schema = rows.drop(out).withColumn(out, F.lit(0)).schema
        names = schema.names

        def run(batches: Iterator[pa.RecordBatch], g=g, shared=shared) -> Iterator[pa.RecordBatch]:
            c = Cascade(shared.value)
            for b in batches:
                col = {x: b.column(i) for i, x in enumerate(b.schema.names)}
                h1, h2 = (np.asarray(col[x].flatten(), dtype=np.int64) for x in ("h1", "h2"))
                mine = np.flatnonzero(np.mod(h1, n) == g)
                hit = mine[c.contains(h1[mine], h2[mine])]
                size = np.array([len(x) for x in col["h1"]], np.int64) if b.num_rows else np.zeros(0, np.int64)
                end = np.cumsum(size)
                row = np.searchsorted(end, hit, side="right")
                place = hit - (end - size)[row] + 1
                best = np.full(b.num_rows, 1 << 30)
                np.minimum.at(best, row, place)
                if out in col:
                    had = np.asarray(col[out])
                    best = np.minimum(best, np.where(had > 0, had, 1 << 30))
                col[out] = pa.array(np.where(best < 1 << 30, best, 0).astype(np.int32))
                yield pa.RecordBatch.from_arrays([col[x] for x in names], names=names)

        rows = rows.mapInArrow(run, schema)
    return rows


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], hosts: DataFrame,
               id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """id, host, path, rule, verdict of every row.

    ``rules``: (allow or block, host, path); ``hosts``: column ``host`` of blocked
    hosts (any number; NULL and repeated ones are ignored)."""
    spark = pages.sparkSession
    folder = run_folder(spark)
    host, path = url_parts(pages[url_col])
    src = pages.select(pages[id_col], host.alias("host"), path.alias("path"))
    on_list = hosts.select(hosts["host"]).filter("host IS NOT NULL AND host <> ''").distinct()
    # one row for each number of labels that occurs on the list
    counts = on_list.select(F.size(F.split("host", r"\.")).alias("n")).distinct().collect()
    labels = sorted({r.n for r in counts} | {h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules if p})
    keyed = src.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    keyed = keyed.withColumn("h1", F.transform("keys", lambda k: hash_pair(k)[0])) \
        .withColumn("h2", F.transform("keys", lambda k: hash_pair(k)[1]))
    universe = stage(keyed.select(F.explode(F.arrays_zip("h1", "h2")).alias("h")).select("h.h1", "h.h2").distinct(),
                     folder, "universe")

    def hashed(df: DataFrame, col: str) -> DataFrame:
        h1, h2 = hash_pair(F.col(col))
        return df.select(h1.alias("h1"), h2.alias("h2"))

    rows = keyed
    for name in ("allow", "block"):
        own = spark.createDataFrame([(h + p,) for a, h, p in rules if a == name], "k string")
        rows = first_listed(rows, build_cascades(universe, hashed(own, "k"), folder, name, max_bits), name)
    rows = first_listed(rows, build_cascades(universe, hashed(on_list, "host"), folder, "hosts", max_bits), "on_list")
    blocked = (F.col("block") > 0) & ((F.col("allow") == 0) | (F.col("block") <= F.col("allow")))
    at = F.when(blocked, F.col("block")).otherwise(F.col("allow"))
    return rows.select(
        id_col, "host", "path",
        F.when(at > 0, F.element_at("keys", F.greatest(at, F.lit(1)))).alias("rule"),
        F.when(blocked | (at == 0) & (F.col("on_list") > 0), "block").otherwise("allow").alias("verdict"))
