"""URL filters: a blocked Bloom filter in front of an exact hash join.

Two lists decide. A list of rules holds (host, path, verdict): a rule fits a URL if the URL's host is the rule's or a
subdomain of it and the URL's path starts with the rule's path; the longest fitting rule decides. URLs that no
rule fits are blocked if their canonical form is that of a listed URL, and get the default verdict otherwise.

Both lists are met in one way. Every rule is a key host + path, and a URL that fits it has that key as (a suffix of its
host, a prefix of its path), so a URL is turned into the few keys that could be rules: those with as many labels
and as long a path as some rule has. Its canonical form is one key more. A blocked Bloom filter of the listed keys (one
64-bit word per key, BITS bits set in it) drops nearly all keys inside the projection, and an exact equi-join on
the keys that remain removes the false positives. The filter has a bounded size, whatever the list: up to
MAX_WORDS words of 8 bytes; a larger list only raises the share of false positives that reach the join.

The canonical form of a URL has no scheme, user, default port, trailing dot of the host or fragment; its scheme and host are in
lower case, an empty path is /, and escapes of letters, digits, - . _ and ~ are resolved, others in capitals.

Defined results: null URLs, and those without `://`, have an empty host and path, no canonical form, and fit no rule. A
rule listed twice counts once; of contradictory twins block wins. Empty tables give empty results. Columns named
host, path, rule or verdict are replaced; all others pass through unchanged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import free_names

BITS = 6
MAX_WORDS = 1 << 18
KEYS_A_WORD = 4
HOST = r"^(?s:.*?)://([^/?#]*)"
PATH = r"^(?s:.*?)://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The host, with A-Z lower-cased; empty for null and where there is no `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def canonical_url(url: Column) -> Column:
    """The canonical form that listed URLs are compared by; null where there is no `://`."""
    parts = F.split(F.regexp_replace(url, "#[\\s\\S]*$", ""), "%")
    code = lambda p: F.upper(F.substring(p, 1, 2))
    plain = lambda p: F.char(F.conv(code(p), 16, 10).cast("long"))
    rest = lambda p: F.substring(p, F.lit(3), F.length(p))
    resolved = lambda p: F.when(~p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), p)).when(plain(p).rlike("^[A-Za-z0-9._~-]$"), F.concat(plain(p), rest(p))).otherwise(F.concat(F.lit("%"), code(p), rest(p)))
    text = F.array_join(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(resolved(p))), "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(text), "^(?s:.*)@", ""), ":(80|443)?$", ""), "\\.$", "")
    tail = F.regexp_extract(text, r"^(?s:.*?)://[^/?#]*((?s:.*))$", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host, F.when(F.startswith(tail, F.lit("/")), tail).otherwise(F.concat(F.lit("/"), tail))))


def _word_of(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _bits_of(key: Column) -> Column:
    """A word with up to BITS bits set, chosen by slices of a second hash."""
    second, one, low = F.xxhash64(key, F.lit("bits")), F.lit(1).cast("long"), F.lit(63).cast("long")
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        at = F.shiftrightunsigned(second, 6 * k).bitwiseAND(low).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, at))
    return mask


def bloom_filter(keys: DataFrame, key: str) -> tuple[Column, int]:
    """The filter of the keys as a literal of big-endian words, MAX_WORDS at most, and the number of words."""
    n, words = keys.count(), 1
    while words * KEYS_A_WORD < n and words < MAX_WORDS:
        words *= 2
    masks = keys.groupBy(_word_of(F.col(key), words).alias("word")).agg(F.bit_or(_bits_of(F.col(key))).alias("mask"))
    dense = np.zeros(words, ">i8")
    for word, mask in masks.collect():
        dense[word] = mask
    return F.lit(bytearray(dense.tobytes())), words


def listed_maybe(key: Column, words: Column, n_words: int) -> Column:
    """Whether the filter has all bits of the key: true for every listed key and few others."""
    word = F.conv(F.hex(F.substring(words, _word_of(key, n_words) * 8 + 1, 8)), 16, -10).cast("long")
    return word.bitwiseAND(_bits_of(key)) == _bits_of(key)


def possible_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The suffixes of the host of as many labels, with the prefixes of the path of such a length, as a rule has."""
    labels = F.split(host, r"\.")
    own = F.array(*[F.struct(F.lit(k).alias("labels"), F.lit(n).alias("length")) for k, n in shapes])
    fits = F.filter(own, lambda s: (s["labels"] <= F.size(labels)) & (s["length"] <= F.length(path)))
    suffix = lambda s: F.array_join(F.slice(labels, F.size(labels) - s["labels"] + 1, s["labels"]), ".")
    return F.transform(fits, lambda s: F.concat(suffix(s), F.substring(path, F.lit(1), s["length"])))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", listed: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule (host + path of the deciding rule, or null) and verdict.

    rules has host, path and verdict; hosts are compared with A-Z lower-cased. The shapes of the rules (numbers of
    labels and lengths of paths that occur together) come to the driver; the rules themselves stay a table.
    listed has a column url, of URLs to block where no rule decides.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    hits, key, at_host, at_path = free_names(pages, "hits", "key", "at_host", "at_path")
    known = rules.select(
        F.concat(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path").alias(key), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"), "verdict"
    ).where(F.col(key).isNotNull())
    shapes = sorted((r[0], r[1]) for r in known.select("labels", "length").distinct().collect())
    known = known.groupBy(key).agg(F.max("verdict").alias("verdict"))
    judged = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if shapes:
        words, n_words = bloom_filter(known, key)
        judged = judged.withColumn(hits, F.filter(possible_keys(F.col("host"), F.col("path"), shapes), lambda k: listed_maybe(k, words, n_words)))
        possible = judged.where(F.size(hits) > 0)
        decided = (
            possible.select(F.col("host").alias(at_host), F.col("path").alias(at_path), hits)
            .distinct()
            .select(at_host, at_path, F.explode(hits).alias(key))
            .join(known, key)
            .groupBy(at_host, at_path)
            .agg(F.max_by(F.struct(F.col(key).alias("rule"), "verdict"), F.struct(F.length(key), F.col(key))).alias("found"))
            .select(at_host, at_path, "found.rule", "found.verdict")
        )
        met = possible.join(decided, (F.col("host") == F.col(at_host)) & (F.col("path") == F.col(at_path)), "left").drop(hits, at_host, at_path)
        judged = judged.where(F.size(hits) == 0).drop(hits).withColumns({c: F.lit(None).cast("string") for c in ("rule", "verdict")}).unionByName(met)
    else:
        judged = judged.withColumns({c: F.lit(None).cast("string") for c in ("rule", "verdict")})
    if listed is not None:
        judged = block_listed(judged, url, listed, key)
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def block_listed(judged: DataFrame, url: str, listed: DataFrame, key: str) -> DataFrame:
    """judged with the verdict block for undecided rows whose canonical URL is that of a listed one."""
    (found,) = free_names(judged.withColumn(key, F.lit(0)), "found")
    known = listed.select(canonical_url(F.col("url")).alias(found)).where(F.col(found).isNotNull()).distinct()
    words, n_words = bloom_filter(known, found)
    keyed = judged.withColumn(key, F.when(F.col("verdict").isNull(), canonical_url(F.col(url))))
    maybe = F.coalesce(listed_maybe(F.col(key), words, n_words), F.lit(False))
    hit = keyed.where(maybe).join(known, F.col(key) == F.col(found), "left").withColumn("verdict", F.when(F.col(found).isNotNull(), "block").otherwise(F.col("verdict")))
    return keyed.where(~maybe).drop(key).unionByName(hit.drop(key, found))
