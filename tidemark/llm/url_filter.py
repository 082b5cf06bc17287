"""URL filter over a Bloom filter cascade, in DataFrame functions only.

A rule is a host and a path prefix, like ``example.net/en/``.  A URL has few candidate keys:
its last labels joined with the first characters of its path, for the label counts and path
lengths that occur in the list.  A cascade tells which of them are listed: level 0 is a Bloom
filter of the listed keys; level 1 holds the keys of the corpus that pass level 0 without
being listed; level 2 the listed keys that pass level 1; and so on until nothing passes
wrongly.  A key is listed if the first level that lacks it is odd, which is exact for
every key the cascade was built over: the complete key universe of the corpus.

Level 0 is sized by the size of the universe, so that about as many false positives as listed
keys remain; the levels after it halve.  All levels together take a few dozen bits a listed
key, whatever the size of the corpus; they are literals in the plan, and judging a URL
needs no join and no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# The default rules (block or allow) and hosts listed as unwanted.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
UNWANTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
UNWANTED_HOSTS = tuple(f"{n}.example.{d}/" for n in UNWANTED_NAMES for d in ("com", "net", "org"))

MAX_LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; both empty if null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def shapes(keys: list[str]) -> list[tuple[int, int]]:
    """Distinct (labels of the host, characters of the path) of the listed keys."""
    cut_at = [(k.split("/", 1)[0], k[len(k.split("/", 1)[0]):]) for k in keys]
    return sorted({(h.count(".") + 1, len(p)) for h, p in cut_at})


def candidate_keys(host: Column, path: Column, of: list[tuple[int, int]]) -> Column:
    """The keys under which a URL could be listed; nulls where host or path is too short."""
    labels = F.size(F.split(host, r"\."))
    return F.array(*[F.when((labels >= n) & (F.length(path) >= m) & (host != ""),
                            F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
                     for n, m in of])


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` positions in 64-bit words, ``hashes`` probes a key."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> Column:
        h1 = F.shiftrightunsigned(F.xxhash64(key, F.lit(self.seed)), 8)
        h2 = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed + 1), key), 24).bitwiseOR(F.lit(1))
        return F.array(*[F.pmod(h1 + h2 * F.lit(i), F.lit(self.bits)) for i in range(self.hashes)])

    def contains(self, key: Column) -> Column:
        table = F.array(*[F.lit(w).cast("bigint") for w in self.words])
        return F.forall(self.positions(key), lambda p: F.getbit(
            F.get(table, (p / 64).cast("int")), (p % 64).cast("int")) == 1)


def build_level(keys: DataFrame, n: int, p: float, seed: int) -> Level:
    """Filter of ``n`` distinct keys (column ``key``) with false positive rate ``p``."""
    bits = max(64, math.ceil(n * math.log2(1 / p) / math.log(2)))
    hashes = max(1, round(math.log2(1 / p)))
    empty = Level((), bits, hashes, seed)
    at = keys.select(F.explode(empty.positions(F.col("key"))).alias("p"))
    words = (at.groupBy((F.col("p") / 64).cast("int").alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("bits")))
    got = {r["w"]: r["bits"] for r in words.collect()}        # a few dozen bits a listed key
    return Level(tuple(got.get(i, 0) for i in range(-(-bits // 64))), bits, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """True for listed keys, false for the other keys of the universe, null for null."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].contains(key), F.lit(i % 2 == 1)).otherwise(out)
        return F.when(key.isNotNull(), out)


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Cascade over two columns ``key``: the listed keys and all keys that will be asked.

    Levels alternate between the two sides; each is built from the keys that pass the level
    before it wrongly.  The universe is read twice, for its size and for level 1.
    """
    inside = listed.where(F.col("key").isNotNull()).distinct()
    n = inside.count()
    if not n:
        return Cascade(())
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    p = min(0.5, max(1e-12, n / max(2 * size, 1)))
    levels = [build_level(inside, n, p, 0)]
    outside = cut(universe.where(F.col("key").isNotNull() & levels[0].contains(F.col("key"))).distinct()
                  .join(inside, "key", "left_anti"))
    wrong = outside
    while (left := wrong.count()) and len(levels) < MAX_LEVELS:
        levels.append(build_level(wrong, left, 0.5, 2 * len(levels)))
        other = inside if len(levels) % 2 == 0 else outside
        inside_pass = other.where(levels[-1].contains(F.col("key")))
        if len(levels) % 2 == 0:
            inside = wrong = cut(inside_pass)
        else:
            outside = wrong = cut(inside_pass)
    if left:
        raise RuntimeError("the cascade did not close; its hash functions collide")
    return Cascade(tuple(levels))


def filter_urls(pages: DataFrame, rules: dict[str, str] | None = None, unwanted: tuple[str, ...] = UNWANTED_HOSTS,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL: the longest fitting rule, else block if a listed host fits, else allow.

    Returns one row per input row: the id column, ``host``, ``path``, ``rule`` (null if none
    fits), ``listed`` (the unwanted key that fits, else null) and ``verdict``.  A rule fits its
    host and all subdomains where the path starts with the rule's path.  Of two rules of
    equal length the later in string order wins.  Null URLs and URLs without ``://`` have
    empty host and path, fit nothing and are allowed; repeated rows are each judged; other
    columns are never read.
    """
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    keys = {"block": [k for k, v in rules.items() if v == "block"],
            "allow": [k for k, v in rules.items() if v == "allow"], "unwanted": list(unwanted)}
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    with_keys = base.withColumn("keys", candidate_keys(F.col("host"), F.col("path"),
                                                       shapes([k for v in keys.values() for k in v])))
    universe = with_keys.select(F.explode("keys").alias("key")).where(F.col("key").isNotNull())
    has = {}
    for name, listed in keys.items():
        frame = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in listed])).alias("key")) if listed \
            else spark.range(0).select(F.lit("").alias("key"))
        has[name] = build_cascade(frame, universe)

    def longest(name: str) -> Column:
        fits = F.filter("keys", has[name].contains)
        return F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))

    found = with_keys.select("_id", "host", "path", longest("block").alias("b"), longest("allow").alias("a"),
                             longest("unwanted")["key"].alias("listed"))
    blocks = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("b") > F.col("a")))
    return found.select(
        F.col("_id").alias(id_col), "host", "path",
        F.when(blocks, F.col("b.key")).otherwise(F.col("a.key")).alias("rule"), "listed",
        F.when(blocks, "block").when(F.col("a").isNotNull(), "allow")
        .when(F.col("listed").isNotNull(), "block").otherwise("allow").alias("verdict"))
