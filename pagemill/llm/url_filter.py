"""URL filters: longest-rule verdicts, and a Bloom filter cascade for a list of hosts.

A cascade answers membership exactly over a known universe of keys. Level 0 is a Bloom filter of the
listed keys. Level 1 holds the universe's other keys that level 0 wrongly accepts, level 2 the listed
keys that level 1 wrongly accepts, and so on until nothing is wrong. A key is listed if the first
level that rejects it is an odd one (or, where all accept it, if their number is odd).

The universe is every host of the corpus with all its parent domains, so no row needs a join: the
levels are a few bits a listed key, and a filter over ``max_bytes`` is split by key hash into shards
that are built and applied one after another, so what is broadcast has a bound however long the list.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule and is
allowed; repeated rows and ties repeat; empty tables give empty tables; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the contract, (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The production block list: these names under every top-level domain below. Subdomains are blocked too.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_SUFFIXES = ("example.com", "example.net", "example.org")
LISTED_HOSTS = tuple(f"{n}.{s}" for n in LISTED_NAMES for s in LISTED_SUFFIXES)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parents(host: Column) -> Column:
    """The host and its parent domains: ``a.b.c`` gives ``a.b.c``, ``b.c`` and ``c``."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: np.ndarray  # uint64

    def holds(self, key: str) -> bool:
        return all(int(self.words[p >> 6]) >> (p & 63) & 1 for p in places(key, self.bits, self.hashes, self.seed))


def places(key: str, bits: int, hashes: int, seed: int) -> list[int]:
    """Double hashing: positions h1 + i h2, seeded by level so that the levels err independently."""
    h = xxhash.xxh3_128_intdigest(key.encode(), seed)
    h1, h2 = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(h1 + i * h2) % bits for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    """Levels of every shard; ``shards`` is 1 unless the list outgrows the broadcast bound."""

    levels: list[Level]

    def listed(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if not level.holds(key):
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of ``keys``, built by executors: bit positions, then one OR per 64-bit word."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2) / 64) * 64)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([x for k in batch.column(0).to_pylist() for x in places(k, bits, hashes, seed)], np.int64)
            at, inverse = np.unique(p >> 6, return_inverse=True)
            word = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(word, inverse, np.uint64(1) << (p & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(word.view(np.int64))], names=["at", "word"])

    filled = np.zeros(bits // 64, np.uint64)
    for at, word in keys.select("key").mapInArrow(words, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word")).toLocalIterator():
        filled[at] = np.int64(word).astype(np.uint64)
    return Level(bits, hashes, seed, filled)


def build_cascade(listed: DataFrame, universe: DataFrame, first_rate: float = 0.01, rate: float = 0.5, max_bytes: int = 32 << 20) -> list[Cascade]:
    """Cascades by shard of column ``key``. ``universe`` must hold every key that will be asked.

    Listed keys outside the universe are never asked and are left out. A filter has at most
    ``n log2(1/rate) / ln 2`` bits, which gives the number of shards before any is built.
    """
    inside = listed.select("key").distinct().join(universe.select("key").distinct(), "key", "left_semi").persist()
    others = universe.select("key").distinct().join(inside, "key", "left_anti").persist()
    n = inside.count()
    shards = max(1, math.ceil(n * -math.log2(first_rate) / math.log(2) / 8 / max_bytes))
    out = []
    for s in range(shards):
        own = shard_of(F.col("key"), shards) == s
        yes, no, levels = inside.filter(own), others.filter(own), []
        while (left := yes.count()) > 0:
            level = _level(yes, left, rate if levels else first_rate, len(levels))
            levels.append(level)
            wrong = no.filter(passes(F.col("key"), level)).persist()
            yes, no = wrong, yes
        out.append(Cascade(levels))
    for df in (inside, others):
        df.unpersist()
    return out


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards))


def passes(key: Column, level: Level) -> Column:
    @F.pandas_udf("boolean")
    def held(keys):
        return keys.map(level.holds)

    return held(key)


def listed_in(cascades: list[Cascade], keys: Column) -> Column:
    """Whether any of the keys in an array column is listed. Each shard's cascade answers for its own keys."""
    answer = F.lit(False)
    for s, cascade in enumerate(cascades):
        own = F.filter(keys, lambda k, s=s: shard_of(k, len(cascades)) == s) if len(cascades) > 1 else keys

        @F.pandas_udf("boolean")
        def hit(rows, cascade=cascade):
            known: dict[str, bool] = {}

            def one(k: str) -> bool:
                if k not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[k] = cascade.listed(k)
                return known[k]

            return rows.map(lambda ks: any(one(k) for k in ks))

        answer = answer | hit(own)
    return answer


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every page; ``listed`` has one ``key`` (a host) per row."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = urls.select("host").distinct().select(F.explode(parents(F.col("host"))).alias("key")).distinct()
    cascades = build_cascade(listed, universe)
    judged = urls.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("listed", listed_in(cascades, parents(F.col("host"))))
    return judged.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )
