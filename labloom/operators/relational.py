"""Relational operators: latest, first and best per key, islands, as-of look-ups, profiles, set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def holding(inner: DataFrame, i: str, outer: DataFrame, o: str) -> DataFrame:
    """(i, o) of distinct texts of which the outer one holds the inner one: they meet in the inner one's first three characters, nothing is crossed."""
    of_size = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(o) - n + 1, F.lit(1))), lambda at: F.substring(o, at, F.lit(n)))
    pieces = F.array_distinct(F.flatten(F.array(of_size(1), of_size(2), of_size(3))))
    return inner.where(F.length(i) > 0).select(i, F.substring(i, 1, 3).alias("_piece")).join(outer.where(F.length(o) > 0).select(o, F.explode(pieces).alias("_piece")), "_piece").where(F.contains(F.col(o), F.col(i))).select(i, o)


def containing(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """(text, contained array<string>, sorted): the names that a text holds or that hold it, for texts that have any. Both sides must be distinct."""
    pairs = holding(names, name, texts, text).select(text, name).unionByName(holding(texts, text, names, name).select(text, name))
    return pairs.groupBy(text).agg(F.array_sort(F.collect_set(name)).alias("contained"))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order (which should end in a unique column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """The row with the greatest (time, tie) of each key, by aggregation: rows are combined before the shuffle, so a hot key costs little."""
    kept = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(time), F.col(tie))).alias("_row"))
    return kept.select("_row.*")


def best_or_abstain(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The best row of each key by ``order`` (ascending); no row for a key whose best place is shared."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.rank().over(w)).where("_rank = 1")
    return ranked.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_rank", "_n")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[str], name: str = "island", block: Column | None = None) -> DataFrame:
    """Numbers the runs of rows with equal ``same`` columns within each key, in order, from 0.

    ``block``, which must not fall in that order (a month of its first column, say), splits a frequent key: runs are numbered
    within blocks, and what the blocks before hold comes from one row for each block.
    """
    if block is not None:
        t = islands(df.withColumn("_block", block), [*keys, "_block"], order, same, "_inner")
        at = F.struct(*order)
        of = F.struct(*[F.col(c).alias(f"s{i}") for i, c in enumerate(same)])
        blocks = t.groupBy(*keys, "_block").agg(F.min_by(of, at).alias("_first"), F.max_by(of, at).alias("_last"), F.max("_inner").alias("_runs"))
        w = Window.partitionBy(*keys).orderBy("_block")
        parted = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col("_first").eqNullSafe(F.lag("_last").over(w))).cast("int"))
        blocks = blocks.withColumn("_step", parted + F.coalesce(F.lag("_runs").over(w), F.lit(0)))
        blocks = blocks.withColumn("_base", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        b = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_kb"), "_base")
        on = F.col("_block").eqNullSafe(F.col("_kb"))
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return t.join(b, on).withColumn(name, F.col("_base") + F.col("_inner")).drop("_block", "_inner", "_kb", "_base", *[f"_k{i}" for i in range(len(keys))])
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    start = F.when(F.row_number().over(w) == 1, 0).otherwise(changed.cast("int"))
    return df.withColumn("_start", start).withColumn(name, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def latest_of_other_group(df: DataFrame, keys: Sequence[str], group: str, time: str, tie: str, keep: Sequence[str]) -> DataFrame:
    """For each key and group (job) the latest row of the same key in any other group: keys, group, and ``keep`` of that row.

    Keys match null to null. The latest of each group comes first, aggregated before the shuffle; of a key only its two
    latest groups matter, so nothing is compared pairwise.
    """
    picked = F.struct(F.col(time).alias("t"), F.col(tie).alias("i"), *[F.col(c).alias(c) for c in keep])
    per_group = df.groupBy(*keys, group).agg(F.max(picked).alias("best"))
    by_key = Window.partitionBy(*keys).orderBy(F.col("best.t").desc(), F.col("best.i").desc())
    over_key = Window.partitionBy(*keys)
    ranked = per_group.withColumn("_rn", F.row_number().over(by_key))
    first, second = F.max(F.when(F.col("_rn") == 1, F.col("best"))).over(over_key), F.max(F.when(F.col("_rn") == 2, F.col("best"))).over(over_key)
    other = F.when(F.col("_rn") == 1, second).otherwise(first)
    return ranked.select(*keys, group, other.alias("other")).where("other is not null").select(*keys, group, *[F.col(f"other.{c}").alias(f"other_{c}") for c in keep])


def matching_profiles(people: DataFrame, profiles: DataFrame, on: str) -> DataFrame:
    """People with every profile that applies to them: sex in its list, age within its bounds, pregnancy as it says; null means any.

    A bound with an unknown age doesn't apply. ``specificity`` counts the filters that aren't null. The join is on an
    equal key; the rest are conditions on it.
    """
    fits = (
        (F.col("p_sex").isNull() | F.array_contains("p_sex", F.col("sex")))
        & (F.col("p_age_low").isNull() | (F.col("age") >= F.col("p_age_low")))
        & (F.col("p_age_high").isNull() | (F.col("age") <= F.col("p_age_high")))
        & (F.col("p_pregnancy").isNull() | F.col("pregnant").eqNullSafe(F.col("p_pregnancy")))
    )
    filters = sum((F.col(c).isNotNull().cast("int") for c in ("p_sex", "p_age_low", "p_age_high", "p_pregnancy")), F.lit(0))
    return people.join(profiles, on).where(fits).withColumn("specificity", filters)


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other hasn't as often, with the side they are on."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Incoming rows whose key is in no existing row, the first of each key; null keys always go in."""
    fresh = top_per_key(incoming.where(F.col(key).isNotNull()), [key], order)
    return fresh.join(existing.select(key).distinct(), key, "left_anti").unionByName(incoming.where(F.col(key).isNull()))


def last_known(events: DataFrame, key: str, time: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """The state of each key after partial updates: of every column the last value that isn't null."""
    at = F.struct(F.col(time), F.col(tie))
    return events.groupBy(key).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def mode_first_seen(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return top_per_key(counts, keys, [F.col("_n").desc(), F.col("_first"), F.col(value)]).drop("_n", "_first")
