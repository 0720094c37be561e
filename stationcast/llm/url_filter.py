"""URL rules and an exact domain list held in a cascade of Bloom filters, DataFrame operations only.

The cascade: level 1 holds the listed domains. Some domains of the corpus that are not
listed hit it by chance; level 2 holds exactly those, level 3 the listed ones that hit
level 2, and so on with alternating sides until a level has no false hit. Since the
levels are made against every domain that occurs in the corpus, a key of the corpus is
listed if and only if the number of levels that it passes in a row is odd. Membership is
an expression over a few arrays of bits: no join, and no key that is judged wrongly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast.llm.text import lower_ascii
from stationcast.session import stage

#: Share of false hits a level is made for: many at first, as the next level removes them.
RATES = (0.05, 0.5)
#: Bits of one level that may be put into the plan; larger lists use the join below.
MOST_BITS = 1 << 27


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    hashes: int
    salt: int


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + F.lit(3), F.char_length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.char_length(host) + F.lit(1), F.char_length(rest))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    known = F.coalesce(at > 0, F.lit(False))
    return F.when(known, lower_ascii(host)).otherwise(F.lit("")), F.when(known, path).otherwise(F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Verdict and name of the longest rule ``(verdict, host, path)`` that fits, else null."""
    fits = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        own = (host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        here = own & F.startswith(path, F.lit(rule_path))
        fits = F.when(here, found) if fits is None else fits.when(here, found)
    return fits if fits is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def domains(host: Column, most_labels: int) -> Column:
    """The host and the domains above it that have at most ``most_labels`` labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    counts = F.sequence(F.lit(1), F.least(n, F.lit(most_labels)))
    return F.transform(counts, lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def _slot(key: Column, level_salt: int, bits: int, k: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level_salt * 64 + k)), F.lit(bits))


def _hits(key: Column, words: Column, n_words: int, hashes: int, salt: int) -> Column:
    def bit(k: int) -> Column:
        slot = _slot(key, salt, n_words * 64, k)
        word = F.element_at(words.cast("array<bigint>"), (F.shiftright(slot, 6) + 1).cast("int"))
        return F.getbit(word, F.pmod(slot, F.lit(64)).cast("int"))

    out = bit(0) == 1
    for k in range(1, hashes):
        out = out & (bit(k) == 1)
    return out


def _level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """Filter over ``keys`` (column ``key``): bits are set inside tasks and united by word."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    n_words = -(-bits // 64)
    hashes = max(1, round(-math.log2(rate)))
    slots = F.array(*[_slot(F.col("key"), salt, n_words * 64, k) for k in range(hashes)])
    words = (
        keys.select(F.explode(slots).alias("slot"))
        .groupBy(F.shiftright("slot", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("slot", F.lit(64)).cast("int"))).alias("bits"))
    )
    array = [0] * n_words  # at most MOST_BITS, however large the corpus
    for row in words.collect():
        array[row["word"]] = row["bits"]
    return Level(tuple(array), hashes, salt)


class BloomCascade:
    """Exact membership of a corpus's keys in a list."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @staticmethod
    def build(listed: DataFrame, universe: DataFrame, most_levels: int = 64) -> BloomCascade:
        """``listed`` and ``universe`` have a column ``key``; only listed keys that occur matter.

        Both sides are reduced to distinct keys and stored, so each level reads a small
        table. Lists beyond ``MOST_BITS`` are refused: take ``listed_by_join`` for them.
        """
        marked = (
            universe.select("key").distinct().withColumn("side", F.lit(0))
            .unionByName(listed.select("key").distinct().withColumn("side", F.lit(1)))
            .groupBy("key").agg(F.max("side").alias("side"), F.min("side").alias("least"))
            .filter((F.col("least") == 0) & F.col("key").isNotNull())
            .select("key", (F.col("side") == 1).alias("listed"))
        )
        sides = stage(marked, "cascade-keys")
        inside = sides.filter("listed").select("key")
        outside = sides.filter("not listed").select("key")
        levels: list[Level] = []
        while len(levels) < most_levels:
            n = inside.count()
            if n == 0:
                break
            rate = RATES[0] if not levels else RATES[1]
            if n * 12 > MOST_BITS:
                raise ValueError("the list is too long for a filter in the plan; use listed_by_join")
            level = _level(inside, n, rate, len(levels) + 1)
            levels.append(level)
            wrong = outside.filter(_hits(F.col("key"), F.lit(list(level.words)), len(level.words), level.hashes, level.salt))
            inside, outside = stage(wrong, "cascade-level"), inside
        else:
            raise ValueError("the cascade did not end")
        return BloomCascade(levels)

    def contains(self, key: Column) -> Column:
        """True for listed keys of the universe, false for its other keys; null keys are not listed."""
        answer: Column = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            level = self.levels[i - 1]
            hit = _hits(key, F.lit(list(level.words)), len(level.words), level.hashes, level.salt)
            # failing level i means: not on the side that level i holds
            answer = F.when(hit, answer).otherwise(F.lit(i % 2 == 0))
        return F.coalesce(key.isNotNull() & answer, F.lit(False))


def listed_by_join(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """The same answer for lists of any length: distinct keys that are listed, by a semi join."""
    return keys.select("key").distinct().join(listed.select("key").distinct(), "key", "left_semi")


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: tuple[tuple[str, str, str], ...],
    *,
    key: str = "page_id",
    url: str = "url",
    most_labels: int = 8,
) -> DataFrame:
    """``key, host, path, rule, verdict, listed`` for every row of ``pages``.

    ``listed`` has a column ``key`` of blocked domains; a domain covers its subdomains.
    ``most_labels`` is the number of labels of the longest listed domain (longer ones
    raise an error), so the domains above a host are as few. A rule decides where one
    fits; otherwise listed means block and all else allow. A null URL or one without
    ``://`` has empty host and path and is allowed unless a rule fits. Repeated rows are
    judged each, further columns are not read, an empty table gives an empty result.
    """
    longest = listed.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 0
    if longest > most_labels:
        raise ValueError(f"a listed domain has {longest} labels, most_labels is {most_labels}")
    host, path = split_url(F.col(f"`{url}`"))
    parts = pages.select(F.col(f"`{key}`").alias("page"), host.alias("host"), path.alias("path"))
    hosts = parts.select("host").distinct()
    universe = hosts.select(F.explode(domains(F.col("host"), most_labels)).alias("key"))
    cascade = BloomCascade.build(listed, universe)
    found = F.exists(domains(F.col("host"), most_labels), cascade.contains) if cascade.levels else F.lit(False)
    rule = best_rule(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn("found", rule).withColumn("listed", found)
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("page").alias(key),
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), by_list).alias("verdict"),
        "listed",
    )
