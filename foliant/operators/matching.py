"""Equi-joins by computed keys: exact, unique-key, token, prefix and learned-key matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import stage


def unique_index(df: DataFrame, key: Column, value: str) -> DataFrame:
    """(key, value) for keys that one different value has; keys that several share, null and '' are left out."""
    g = df.select(key.alias("key"), F.col(value).alias("value")).where("key <> ''").groupBy("key").agg(F.min("value").alias("value"), F.max("value").alias("other"))
    return g.where("value = other").select("key", "value")


def conflicting_keys(df: DataFrame, key: Column, value: str) -> DataFrame:
    """(key, n_values) for keys that several values share."""
    g = df.select(key.alias("key"), F.col(value).alias("value")).where("key <> ''").groupBy("key").agg(F.countDistinct("value").alias("n_values"))
    return g.where("n_values > 1")


def match_by_keys(rows: DataFrame, reference: DataFrame, value: str, keys: list[tuple[str, Column, Column]]) -> DataFrame:
    """``rows`` with ``value`` and ``basis``: the first of the keys (basis, of a row, of the reference) under which the reference is unique.

    One left join for each key; nothing is compared pairwise. Rows without a match keep a null value."""
    out, values = rows, []
    for i, (basis, mine, theirs) in enumerate(keys):
        index = unique_index(reference, theirs, value).select(F.col("key").alias(f"_k{i}"), F.col("value").alias(f"_v{i}"))
        out = out.withColumn(f"_m{i}", mine).join(index, F.col(f"_m{i}") == F.col(f"_k{i}"), "left")
        values.append((basis, F.col(f"_v{i}")))
    basis = F.coalesce(*[F.when(v.isNotNull(), F.lit(b)) for b, v in values])
    return out.select(*rows.columns, F.coalesce(*[v for _, v in values]).alias(value), basis.alias("basis"))


def shared_tokens(left: DataFrame, left_id: str, left_tokens: Column, right: DataFrame, right_id: str, right_tokens: Column) -> DataFrame:
    """(left_id, right_id, n_shared) for every pair with a token in common (J09): an equi-join of exploded tokens, never a cross join."""
    a = left.select(left_id, F.explode(F.array_distinct(left_tokens)).alias("token"))
    b = right.select(right_id, F.explode(F.array_distinct(right_tokens)).alias("token"))
    return a.join(b, "token").groupBy(left_id, right_id).agg(F.count("*").alias("n_shared"))


def longest_prefix(df: DataFrame, row_id: str, name: Column) -> DataFrame:
    """(row_id, prefix_of): the row with the longest name that another row's name begins with, word by word.

    Each name is exploded into its proper word prefixes, so the prefix condition becomes an equi-join on a bounded number of keys."""
    words = F.split(name, " ")
    n = F.size(words)
    prefixes = F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("p")))
    a = df.select(F.col(row_id).alias("row_id"), F.explode(prefixes).alias("x")).select("row_id", "x.k", "x.p")
    b = df.select(name.alias("p"), F.col(row_id).alias("other")).where("p <> ''").groupBy("p").agg(F.min("other").alias("other"))
    return a.join(b, "p").groupBy("row_id").agg(F.max_by("other", "k").alias("prefix_of"))


def learned(known: DataFrame, key: str, value: str, order: str, rows: DataFrame, rows_key: str) -> DataFrame:
    """``rows`` with the value of the first known row that has their key."""
    first = known.where(f"{key} is not null and {value} is not null").groupBy(key).agg(F.min_by(value, order).alias(f"learned_{value}"))
    return rows.join(first.withColumnRenamed(key, "_key"), F.col(rows_key) == F.col("_key"), "left").drop("_key")


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def similar_sets(df: DataFrame, row_id: str, group: str, tokens: Column, least: float) -> DataFrame:
    """(group, id_a, id_b, similarity): pairs of one group with a Jaccard similarity of at least ``least``.

    Prefix filter: with tokens in order of rarity, two sets this similar share one of their first size - ceil(least * size) + 1 tokens,
    so only those are joined; each candidate is then measured. No pair is lost and frequent tokens are joined only by sets made of them."""
    sets = df.select(F.col(row_id).alias("id"), F.col(group).alias("grp"), F.array_distinct(tokens).alias("t")).where((F.size("t") > 0) & F.col("grp").isNotNull())
    freq = sets.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked = (
        sets.select("id", "grp", F.explode("t").alias("token")).join(freq, "token").groupBy("id", "grp")
        .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("s")).select("id", "grp", F.transform("s", lambda x: x["token"]).alias("t"))
    )
    ranked = stage(ranked, "ranked")  # read by both sides of the join below
    keep = F.size("t") - F.ceil(F.lit(least) * F.size("t") - 1e-9) + 1
    head = ranked.select("id", "grp", "t", F.explode(F.slice("t", F.lit(1), keep.cast("int"))).alias("token"))
    a, b = head.alias("a"), head.alias("b")
    pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")))
    sim = F.size(F.array_intersect("a.t", "b.t")) / F.size(F.array_union("a.t", "b.t"))
    return pairs.select(F.col("a.grp").alias(group), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), sim.alias("similarity")).where(F.col("similarity") >= least).distinct()


def similar_between(left: DataFrame, right: DataFrame, group: str, key: str, least: float) -> DataFrame:
    """(group, key_a, key_b): keys of ``left`` and ``right``, token sets written with spaces, of one group with a Jaccard similarity of at least ``least``.

    The prefix filter of ``similar_sets``, but only keys of different sides meet. A first shared token must also leave enough tokens behind it on both sides."""
    both = left.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.lit(True).alias("l")).unionByName(right.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.lit(False).alias("l")))
    sets = both.where("key <> '' and grp is not null").groupBy("grp", "key").agg(F.max("l").alias("in_a"), F.max(~F.col("l")).alias("in_b")).withColumn("t", F.array_distinct(F.split("key", " ")))
    freq = sets.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked = (
        sets.select("grp", "key", "in_a", "in_b", F.explode("t").alias("token")).join(freq, "token").groupBy("grp", "key", "in_a", "in_b")
        .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("s")).select("grp", "key", "in_a", "in_b", F.transform("s", lambda x: x["token"]).alias("t"))
    )
    ranked = stage(ranked, "ranked")
    keep = F.size("t") - F.ceil(F.lit(least) * F.size("t") - 1e-9) + 1
    head = ranked.select("grp", "key", "in_a", "in_b", "t", F.posexplode(F.slice("t", F.lit(1), keep.cast("int"))).alias("i", "token"))
    a, b = head.where("in_a").alias("a"), head.where("in_b").alias("b")
    room = F.least(F.size("a.t") - F.col("a.i"), F.size("b.t") - F.col("b.i"))
    enough = room * (1 + least) >= least * (F.size("a.t") + F.size("b.t")) - 1e-9
    pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.token") == F.col("b.token")) & enough)
    sim = F.size(F.array_intersect("a.t", "b.t")) / F.size(F.array_union("a.t", "b.t"))
    return pairs.where(sim >= least).select(F.col("a.grp").alias(group), F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b")).distinct()


def numbered(df: DataFrame, order: list[str], start: int, name: str = "number") -> DataFrame:
    """Rows numbered from ``start`` in the given order (W02), without a single-task window.

    Rows are range-partitioned and numbered within partitions; the only thing gathered is a count for each partition."""
    local = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), "numbered")
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = local.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_first")).withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    return local.join(F.broadcast(base.select("_p", "_before", "_first")), "_p").withColumn(name, F.lit(start) + F.col("_before") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_before", "_first")
