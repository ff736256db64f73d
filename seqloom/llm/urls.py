"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join. No Python on rows.

Each URL gives one key for every listed entry it could meet: a host suffix with a path prefix, or the
whole canonical URL. The keys go through a Bloom filter whose blocks are rows of four 64-bit
words, and only those that pass are joined with the entries themselves, which removes the filter's
false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import ascii_lower

#: Bits of the filter for each listed entry.
BITS_PER_ENTRY = 32
#: Up to so many blocks (of 32 bytes and a key) the filter is broadcast, beyond it it is shuffled.
MAX_BROADCAST_BLOCKS = 1 << 18
#: Up to so many entries (a URL each) the exact side is broadcast, beyond it it is shuffled.
MAX_BROADCAST_ENTRIES = 20_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path with query under which URLs are listed: the scheme, its default port, the host's
    trailing dot and the fragment are left out, an empty path is ``/``."""
    scheme = ascii_lower(F.coalesce(F.regexp_extract(url, "^([^:/?#]*)://", 1), F.lit("")))
    host = host_of(url)
    default = ((scheme == "http") & host.endswith(":80")) | ((scheme == "https") & host.endswith(":443"))
    host = F.regexp_replace(F.when(default, F.regexp_replace(host, ":[0-9]+$", "")).otherwise(host), ":$", "")
    tail = F.coalesce(F.regexp_extract(url, "://[^/?#]*([^#]*)", 1), F.lit(""))
    return (
        F.regexp_replace(host, "\\.(:[0-9]+)?$", "$1"),
        F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail)),
    )


def _key(kind: Column, host: Column, path: Column) -> Column:
    return F.xxhash64(kind, host, path)


def _bits(key: Column) -> list[Column]:
    """Two bits of each of a block's four words, from a second hash of the key."""
    second = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")

    def bit(shift: int) -> Column:
        return F.call_function(
            "shiftleft", one, F.shiftrightunsigned(second, shift).bitwiseAND(F.lit(63)).cast("int")
        )

    return [bit(12 * i).bitwiseOR(bit(12 * i + 6)) for i in range(4)]


def build_filter(entries: DataFrame, n_entries: int) -> tuple[DataFrame, int]:
    """The blocks of a Bloom filter over ``entries.key`` as rows, and the number of its blocks."""
    n_blocks = 1
    while n_blocks * 256 < n_entries * BITS_PER_ENTRY:
        n_blocks *= 2
    words = _bits(F.col("key"))
    blocks = (
        entries.select(
            F.pmod("key", F.lit(n_blocks)).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)]
        )
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])
    )
    return blocks, n_blocks


def _entries(rules: DataFrame, listed: DataFrame | None) -> DataFrame:
    """Prefix rules (host, path, rule, verdict) and listed URLs as one table of distinct keys."""
    out = rules.select(
        F.lit("prefix").alias("kind"),
        ascii_lower(F.coalesce("host", F.lit(""))).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "rule",
        "verdict",
    ).filter("host <> ''")
    if listed is not None:
        out = out.unionByName(
            listed.select(
                F.lit("listed").alias("kind"),
                canonical(F.col("url"))[0].alias("host"),
                canonical(F.col("url"))[1].alias("path"),
                F.lit(None).cast("string").alias("rule"),
                F.lit("block").alias("verdict"),
            ).filter("host <> ''")
        )
    # Of two rules for one prefix the blocking one holds.
    return (
        out.groupBy("kind", "host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), F.col("verdict") == "block").alias("r"))
        .select("kind", "host", "path", "r.rule", "r.verdict", _key(F.col("kind"), F.col("host"), F.col("path")).alias("key"))
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row for each row of ``pages``: id, ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has host, path, rule and verdict ("allow" or "block"): a rule fits its host and all
    subdomains if the URL's path starts with the rule's. The longest host and path win, among
    equally long ones the longer host. Where no rule fits, a URL of ``listed`` (url; compared in its
    canonical form with the query) is blocked and any other allowed. A null URL, or one without ``://``, has an empty
    host and path, which no entry fits: allowed. Repeated rows each keep their row; ids may be null.

    Equal URLs are judged once. A host that holds a third of the pages therefore spreads over all
    partitions, and the join back to the pages is one that adaptive execution can split.
    """
    entries = _entries(rules, listed)
    shape = entries.filter("kind = 'prefix'").agg(
        F.collect_set(F.length("path")).alias("lengths"),
        F.max(F.size(F.split("host", "\\."))).alias("labels"),
    )
    n_entries = entries.count()
    first = shape.first()
    lengths, labels = sorted(first["lengths"]), first["labels"] or 0
    blocks, n_blocks = build_filter(entries, max(1, n_entries))
    if n_blocks <= MAX_BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)

    rows = pages.select(pages[f"`{id_col}`"].alias("id"), pages[f"`{url_col}`"].cast("string").alias("url")).select(
        "id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        *[
            (F.lit("") if listed is None else part).alias(name)
            for name, part in zip(("listed_host", "listed_path"), canonical(F.col("url")))
        ],
    )
    named = ["host", "path", "listed_host", "listed_path"]
    urls = rows.select(*named).filter("host <> ''").distinct()
    parts = F.split("host", "\\.")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(parts) - labels + 1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.left(F.col("path"), F.lit(n))) for n in lengths]).cast("array<string>"),
        lambda p: p.isNotNull(),
    )

    def keyed(kind: str, host: Column, path: Column) -> Column:
        kind_col = F.lit(kind)
        return F.struct(
            kind_col.alias("kind"), host.alias("host"), path.alias("path"), _key(kind_col, host, path).alias("key")
        )

    exact = F.array(keyed("listed", F.col("listed_host"), F.col("listed_path")))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: keyed("prefix", h, p))))
    tried = F.concat(pairs, exact) if labels else exact
    probes = urls.select(*named, F.explode(tried).alias("c")).select(
        *named,
        F.col("c.kind").alias("kind"),
        F.col("c.host").alias("entry_host"),
        F.col("c.path").alias("entry_path"),
        F.pmod("c.key", F.lit(n_blocks)).alias("block"),
        *[w.alias(f"b{i}") for i, w in enumerate(_bits(F.col("c.key")))],
    )
    passed = probes.join(blocks, "block").filter(
        " AND ".join(f"(w{i} & b{i}) = b{i}" for i in range(4))
    )
    exact_side = entries.select(
        "kind", F.col("host").alias("entry_host"), F.col("path").alias("entry_path"), "rule", "verdict"
    )
    exact_side = F.broadcast(exact_side) if n_entries <= MAX_BROADCAST_ENTRIES else exact_side.hint("shuffle_hash")
    hits = passed.join(exact_side, ["kind", "entry_host", "entry_path"])
    best = hits.groupBy(*named).agg(
        F.max_by(
            F.struct("rule", "verdict"),
            F.struct(
                F.col("kind") == "prefix", F.length("entry_host") + F.length("entry_path"), F.length("entry_host")
            ),
        ).alias("r")
    )
    return rows.join(best, named, "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.lit("allow")).alias("verdict"),
    )
