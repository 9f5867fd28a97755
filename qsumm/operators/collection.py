"""Collection building: joins, first/last-by-position, stable ids, audits
(J1-J3, J10-J12, W1-W4, F1, F5, F6, F14, U2-U4).

"First" and "last" are always by an explicit position column; ties are broken
by key.  All group-wise picks are aggregates (``min_by``/``max_by``) so they
combine map-side and a hot key never gathers its rows in one task.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qsumm.session import cut_lineage


def first_by(df: DataFrame, keys, pos: str, cols=None) -> DataFrame:
    """The row with the smallest ``pos`` per key (``min_by`` over a struct)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = [c for c in (cols or df.columns) if c not in keys]
    packed = F.struct(*[F.col(c) for c in cols])
    agg = df.groupBy(*keys).agg(F.min_by(packed, F.col(pos)).alias("__r"))
    return agg.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in cols])


def last_definition(df: DataFrame, key: str, pos: str, cols=None) -> DataFrame:
    """Duplicate keys -> the last definition wins, placed at the first position."""
    cols = [c for c in (cols or df.columns) if c not in (key, pos)]
    packed = F.struct(*[F.col(c) for c in cols])
    agg = df.groupBy(key).agg(F.min(pos).alias(pos), F.max_by(packed, F.col(pos)).alias("__r"))
    return agg.select(key, pos, *[F.col(f"__r.{c}").alias(c) for c in cols])


def with_article(snippets: DataFrame, articles: DataFrame, key: str = "pmid") -> tuple[DataFrame, DataFrame]:
    """Snippets joined to their article; second frame = snippets whose
    article is unknown (audit side, kept in the raw snippet list)."""
    return snippets.join(articles, key, "inner"), snippets.join(articles, key, "left_anti")


def pages_for_urls(pages: DataFrame, urls: DataFrame, key: str = "url") -> DataFrame:
    """Pages whose url is in the answer url set (semi join)."""
    return pages.join(urls.select(key).where(F.col(key).isNotNull()), key, "left_semi")


def dedup_pages(pages: DataFrame, key: str = "url", order: str = "path") -> DataFrame:
    """Several pages with one url: the last one read (largest ``order``) wins."""
    cols = [c for c in pages.columns if c != key]
    agg = pages.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("__p"))
    return agg.select(key, *[F.col(f"__p.{c}").alias(c) for c in cols])


def answers_with_pages(answers: DataFrame, pages: DataFrame, key: str = "url") -> DataFrame:
    """J2 + F4: answers joined with their (deduplicated) page; rows with a
    missing url keep no page."""
    return answers.join(pages, key, "left")


def dense_ids(df: DataFrame, order_cols, name: str = "ex_id") -> DataFrame:
    """Consecutive ids 0..n-1 in ``order_cols`` order (a unique key), without a
    single-partition window: range-partition + sort, per-partition counts
    (one row per partition), offsets by a prefix sum over those counts."""
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the range partitioner samples its input in a job of its own: keep the input
    # (spillable) between that pass and the checkpoint pass instead of computing it twice
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    ranged = (src.repartitionByRange(n_parts, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__mid", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged)
    src.unpersist()
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__m0"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    out = ranged.join(F.broadcast(offsets.select("__pid", "__off", "__m0")), "__pid")
    return out.withColumn(name, F.col("__off") + F.col("__mid") - F.col("__m0")) \
              .drop("__pid", "__mid", "__off", "__m0")


def split_by_rank(df: DataFrame, key: str, seed: int = 13, train_share: float = 0.8) -> DataFrame:
    """U4 exact: rank by a seeded hash of ``key``; the first ``int(share*n)`` are
    train.  Uses ``dense_ids`` (no single-partition window)."""
    from qsumm.operators.select import shuffle_key
    keyed = df.withColumn("__h", shuffle_key(F.col(key), seed))
    ranked = dense_ids(keyed, ["__h", key], "__rank")
    n = df.count()
    cut = int(train_share * n)
    return ranked.withColumn("split", F.when(F.col("__rank") < cut, "train").otherwise("validation")).drop("__h")


def split_by_bucket(df: DataFrame, key: str, seed: int = 13, train_pct: int = 80) -> DataFrame:
    """U4 scalable variant: ``pmod(hash, 100) < train_pct`` (no count, no sort)."""
    b = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(100))
    return df.withColumn("split", F.when(b < train_pct, "train").otherwise("validation"))


def unmatched(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """keys present on one side only (full outer key join)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    l = left.select(*keys).withColumn("__l", F.lit(True))
    r = right.select(*keys).withColumn("__r", F.lit(True))
    return l.join(r, keys, "full_outer").where(F.col("__l").isNull() | F.col("__r").isNull())


def pair_systems(scores: DataFrame, a: str, b: str, keys, value: str, system_col: str = "system") -> DataFrame:
    """Per-example scores of two systems side by side (conditional aggregate,
    one shuffle on the example key)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (scores.where(F.col(system_col).isin(a, b)).groupBy(*keys)
            .agg(F.max(F.when(F.col(system_col) == a, F.col(value))).alias("x"),
                 F.max(F.when(F.col(system_col) == b, F.col(value))).alias("y"))
            .where(F.col("x").isNotNull() & F.col("y").isNotNull()))


def union_tagged(frames: dict, tag: str = "system") -> DataFrame:
    """Union by name with a literal tag column."""
    out = None
    for name, df in frames.items():
        t = df.withColumn(tag, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def keep_if(cond: Column, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows passing ``cond`` and the rejected rows (side table)."""
    return df.where(cond), df.where(~cond | cond.isNull())


def rank_within(df: DataFrame, key: str, pos: str, name: str = "rank") -> DataFrame:
    """0-based rank of every row inside its key by ``pos`` (unique per key), plus
    ``n_answers`` (rows of the key).  Range partitioning on ``(key, pos)`` splits a
    hot key across tasks; per-key starts come from a small aggregate."""
    from qsumm.operators.stats import running_offsets
    ranked = running_offsets(df, [key, pos], None, "__before")
    starts = ranked.groupBy(key).agg(F.min("__before").alias("__start"), F.count(F.lit(1)).alias("n_answers"))
    out = ranked.join(starts, key)
    return out.withColumn(name, (F.col("__before") - F.col("__start")).cast("long")).drop("__before", "__start")


def summary_fits(summary: str, article: str, slack: int = 10):
    """the summary is at most ``slack`` characters longer than its article."""
    return F.length(summary) <= F.length(article) + slack
