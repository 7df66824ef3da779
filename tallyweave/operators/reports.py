"""Group-by reports of the corpus pipeline: census, percentiles, shares, transitions, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def census(changes: DataFrame, key: Column, repository: str, lines: Column, binary: Column, sample: str) -> DataFrame:
    """key, changes, binary_changes, lines_changed, repositories, sample: one row per key; the sample is the least of `sample`."""
    return changes.groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("changes"),
        F.count_if(binary).alias("binary_changes"),
        F.sum(lines).alias("lines_changed"),
        F.countDistinct(repository).alias("repositories"),
        F.min(sample).alias("sample"),
    )


def merge_counts(parts: Sequence[DataFrame], keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Partial counters of the same columns added up."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by `order` (ascending). The filter lets Spark drop the others before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def measured_or_killed(rows: DataFrame, keys: Sequence[str], status: str, latest: Sequence[Column], killed: str = "killed") -> DataFrame:
    """Union of shards: per key the last measured row; a killed row only where nothing was measured.

    One window does what a union with an anti-join would: measured rows rank before killed ones.
    """
    return last_wins(rows, keys, [F.coalesce(F.col(status) == killed, F.lit(False)).asc(), *latest])


def compare_runs(left: DataFrame, right: DataFrame, keys: Sequence[str], status: str, value: str, latest: Sequence[Column]) -> DataFrame:
    """keys, left_value, right_value of the keys that ended well in both runs; the last row of a key counts on the right."""
    ok = lambda d: d.filter(F.col(status) == "ok").select(*keys, value)
    one = last_wins(right, keys, latest)
    return ok(left).withColumnRenamed(value, "left_value").join(ok(one).withColumnRenamed(value, "right_value"), list(keys))


def status_counts(rows: DataFrame, by: Sequence[str], status: str, known: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(status) == s).alias(s) for s in known), F.count_if(F.col(status).isNull()).alias("no_status"))


def at_ranks(rows: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """`by`, _n and one column per name: the values of each group at the given ranks (from 1; columns over _n, the rows of the group).

    Values are sorted in ranges of the whole order and numbered from the sizes of the ranges before,
    so that no task sees a group whole, nor keeps its distinct values. Null values aren't counted.
    """
    names = [f"_g{i}" for i in range(len(by))]
    known = rows.filter(F.col(value).isNotNull()).select(*(F.col(g).alias(n) for g, n in zip(by, names, strict=True)), F.col(value).alias("_v"))
    ranged = cut_lineage(known.repartitionByRange(*names, "_v").withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part", *names).agg(F.count(F.lit(1)).alias("_in"))  # few rows: ranges and groups
    before = Window.partitionBy(*names).orderBy("_part")
    parts = sizes.select(F.col("_part").alias("_p"), *(F.col(n).alias(f"{n}p") for n in names), (F.sum("_in").over(before) - F.col("_in")).alias("_before"), F.sum("_in").over(Window.partitionBy(*names)).alias("_n"))
    parts = parts.withColumns({f"_r{i}": r for i, r in enumerate(ranks.values())})
    # Equal values are one row with their ranks from and to.
    counted = ranged.groupBy("_part", *names, "_v").agg(F.count(F.lit(1)).alias("_in"))
    upto = F.sum("_in").over(Window.partitionBy("_part", *names).orderBy("_v"))
    placed = counted.withColumn("_upto", upto).join(parts, [F.col("_part") == F.col("_p"), *(F.col(n).eqNullSafe(F.col(f"{n}p")) for n in names)])
    here = lambda i: (F.col(f"_r{i}") > F.col("_before") + F.col("_upto") - F.col("_in")) & (F.col(f"_r{i}") <= F.col("_before") + F.col("_upto"))
    found = placed.groupBy(*names, "_n").agg(*(F.max(F.when(here(i), F.col("_v"))).alias(c) for i, c in enumerate(ranks)))
    return found.select(*(F.col(n).alias(g) for n, g in zip(names, by, strict=True)), "_n", *ranks)


def linear_percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """`by` and one column per name: percentiles by linear interpolation between the two nearest ranks."""
    place = {c: (F.col("_n") - 1) * p for c, p in shares.items()}
    ranks = {f"_{side}{c}": (way(x) + 1).cast("bigint") for c, x in place.items() for side, way in (("low", F.floor), ("high", F.ceil))}
    found = at_ranks(rows.withColumn("_value", F.col(value).cast("double")), by, "_value", ranks)
    between = {c: F.col(f"_low{c}") + (F.col(f"_high{c}") - F.col(f"_low{c}")) * (x - F.floor(x)) for c, x in place.items()}
    return found.select(*by, *(x.alias(c) for c, x in between.items()))


def spread(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, deviation, skewness, percentiles by linear interpolation, largest."""
    v = F.col(value).cast("double")
    moments = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("deviation"), F.skewness(v).alias("skew"), F.max(v).alias("largest"))
    asked = (50, 75, 90, 99)
    found = linear_percentiles(rows, by, value, {f"p{p}": p / 100 for p in asked})
    percentiles = found.select(*(F.col(g).alias(f"_{g}") for g in by), *(f"p{p}" for p in asked))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in by] or [F.lit(True)]
    return moments.join(percentiles, same).select(*by, "n", "mean", "deviation", "skew", *(f"p{p}" for p in asked), "largest")


def nearest_rank(rows: DataFrame, by: Sequence[str], value: str, permilles: Sequence[int]) -> DataFrame:
    """One column per permille: the value of rank ceil(n p / 1000)."""
    ranks = {f"p{p}": F.greatest(F.lit(1), F.ceil(F.col("_n") * p / 1000)).cast("bigint") for p in permilles}
    return at_ranks(rows, by, value, ranks).select(*by, *(F.col(c).cast("double").alias(c) for c in ranks))


def most_by(rows: DataFrame, by: Sequence[str], value: str, label: Sequence[str], tie: str) -> DataFrame:
    """The largest value of each group and the label of its first row by `tie`."""
    best = F.max_by(F.struct(*label, value), F.struct(F.col(value), -F.col(tie)))
    return rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(best.alias("_b")).select(*by, F.col(f"_b.{value}").alias(value), *(F.col(f"_b.{c}").alias(c) for c in label))


def with_empty_cells(rows: DataFrame, a: str, b: str, b_values: Sequence[str]) -> DataFrame:
    """Counts of every value of `a` with each of `b_values`, those without rows too; the second side is a fixed list."""
    counts = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cells = rows.select(a).distinct().withColumn(b, F.explode(F.array(*map(F.lit, b_values))))
    return cells.join(counts, [cells[a].eqNullSafe(counts[a]), cells[b] == counts[b]], "left").select(cells[a], cells[b], F.coalesce("n", F.lit(0)).alias("n"))


def transitions(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """old, new, n: how many rows moved from which category to which."""
    return rows.groupBy(old.alias("old"), new.alias("new")).agg(F.count(F.lit(1)).alias("n"))


def before_and_after(rows: DataFrame, old: Column, new: Column) -> DataFrame:
    """category, before, after, change: both sides counted in one pass."""
    sides = F.explode(F.array(F.struct(old.alias("category"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(new.alias("category"), F.lit(0).alias("b"), F.lit(1).alias("a")))).alias("x")
    out = rows.select(sides).groupBy("x.category").agg(F.sum("x.b").alias("before"), F.sum("x.a").alias("after"))
    return out.withColumn("change", F.col("after") - F.col("before"))


def covered_shares(rows: DataFrame, repository: str, outcome: str, cap: int, missing: str = "missing", binary: str = "binary") -> DataFrame:
    """raw, capped, mean_of_repositories: shares of changes that are diffed as text or content.

    Changes of outcome `missing` don't count; `binary` and outcomes that begin with `:` aren't
    covered. Capped, a repository weighs at most `cap` changes. Per repository first, so that a
    giant repository is one row.
    """
    known = rows.filter(F.col(outcome).isNotNull() & (F.col(outcome) != missing))
    covered = ~((F.col(outcome) == binary) | F.col(outcome).startswith(":"))
    each = known.groupBy(repository).agg(F.count(F.lit(1)).alias("_n"), F.count_if(covered).alias("_c"))
    weight = F.least(F.lit(1.0), F.lit(float(cap)) / F.col("_n"))
    return each.agg(
        F.try_divide(F.sum("_c"), F.sum("_n")).alias("raw"),
        F.try_divide(F.sum(F.col("_c") * weight), F.sum(F.col("_n") * weight)).alias("capped"),
        F.avg(F.col("_c") / F.col("_n")).alias("mean_of_repositories"),
    )


def sample_by_hash(rows: DataFrame, strata: Sequence[str], key: Column, capacity: int) -> DataFrame:
    """`capacity` rows of each stratum by the least hash of their key: uniform, and the same in every run."""
    w = Window.partitionBy(*strata).orderBy(key, *(F.col(c) for c in rows.columns if c not in strata))
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= capacity).drop("_rank")


def recent_single_parent(commits: DataFrame, repository: str, time: str, parents: Column, visited: int, tie: str) -> DataFrame:
    """Of the `visited` latest commits of each repository, those with one parent: the limit counts before the filter."""
    w = Window.partitionBy(repository).orderBy(F.desc_nulls_last(time), F.asc(tie))
    return commits.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= visited).drop("_rank").filter(parents == 1)


def agreement(rows: DataFrame, by: Sequence[str], equal: Column, total: Column) -> DataFrame:
    """perfect, above_99, above_95, below_95: how many rows agree to which share."""
    share = equal / total
    judged = rows.filter(total > 0)
    return judged.groupBy(*by).agg(
        F.count_if(equal == total).alias("perfect"),
        F.count_if((equal < total) & (share >= 0.99)).alias("above_99"),
        F.count_if((share >= 0.95) & (share < 0.99)).alias("above_95"),
        F.count_if(share < 0.95).alias("below_95"),
    )


def verdict_agreement(rows: DataFrame, by: Sequence[str], ours: str, theirs: str) -> DataFrame:
    """perfect and near (within one level) per fixture; a fixture without a judged verdict isn't counted."""
    judged = rows.filter(F.col(ours).isNotNull() & F.col(theirs).isNotNull())
    return judged.groupBy(*by).agg(F.bool_and(F.col(ours) == F.col(theirs)).alias("perfect"), F.bool_and(F.abs(F.col(ours) - F.col(theirs)) <= 1).alias("near"))


def variation(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, n, variation: the deviation over the mean of repeated measures; groups of one have none."""
    v = F.col(value).cast("double")
    return rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.stddev_samp(v), F.avg(v)).alias("variation")).filter("n > 1")


def against_baseline(rows: DataFrame, variant: str, baseline: str, score: str) -> DataFrame:
    """variant, score, change against the baseline, `-` where the variant has no score; the largest change first."""
    base = rows.filter(F.col(variant) == baseline).agg(F.max(score).alias("_base"))
    return (
        rows.filter(F.col(variant) != baseline)
        .join(F.broadcast(base))  # one row
        .select(variant, score, (F.col(score) - F.col("_base")).alias("change"))
        .withColumn("shown", F.coalesce(F.format_string("%.1f", F.col("change").cast("double")), F.lit("-")))
    )


def cumulative_share(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The empirical distribution: per group and distinct value, the share of rows up to it. Counts first, so windows run over distinct values."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    return counts.select(*by, value, (F.sum("_n").over(w.orderBy(value)) / F.sum("_n").over(w)).alias("share"))


def histogram(rows: DataFrame, by: Sequence[str], value: str, bins: int, trim: float, log: bool = False) -> DataFrame:
    """by, bin, n: equal bins (of the logarithm) up to the percentile `trim` of each group; larger values are left out by design."""
    v = F.col(value).cast("double")
    known = rows.filter(v > 0 if log else v.isNotNull()).withColumn("_v", F.log10(v) if log else v)
    edges = linear_percentiles(known, by, "_v", {"_lo": 0.0, "_hi": trim}).withColumnsRenamed({b: f"_{b}" for b in by})
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] or [F.lit(True)]
    joined = known.join(edges, same)
    bin_ = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)))
    return joined.filter("_v <= _hi").groupBy(*by, bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def lognormal(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, n, sigma, scale of the lognormal distribution that starts at 0 and fits best."""
    log = F.ln(F.col(value).cast("double"))
    return rows.filter(F.col(value) > 0).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(log).alias("sigma"), F.exp(F.avg(log)).alias("scale"))


def longest_prefix(rows: DataFrame, path: str, areas: dict[str, str], other: str = "other") -> DataFrame:
    """`rows` and area: the area of the longest prefix of the path; areas are a short fixed list."""
    out = F.lit(other)
    for prefix in sorted(areas, key=len):
        out = F.when(F.col(path).startswith(prefix), areas[prefix]).otherwise(out)
    return rows.withColumn("area", out)


def coverage(rows: DataFrame, by: Sequence[str], covered: str, count: str) -> DataFrame:
    """by, covered, count, share; rows without countable lines are skipped."""
    out = rows.filter(F.col(count) > 0).groupBy(*by).agg(F.sum(covered).alias("covered"), F.sum(count).alias("count"))
    return out.withColumn("share", F.col("covered") / F.col("count"))


def to_retry(rows: DataFrame, listed: DataFrame, keys: Sequence[str], file_key: Sequence[str], status: str, exit_status: str, time: str) -> DataFrame:
    """What runs again: killed by other means than memory (all), out of memory (first commit per file), timed out (all); only listed keys.

    route is `retry` or `memory`.
    """
    known = rows.join(listed.select(*keys).distinct(), list(keys), "left_semi")
    memory = (F.col(status) == "killed") & (F.col(exit_status) == "137")
    again = (F.col(status) == "timed_out") | (F.col(status) == "killed") & ~F.coalesce(F.col(exit_status) == "137", F.lit(False))
    w = Window.partitionBy(*file_key).orderBy(F.asc_nulls_last(time), *keys)
    first = known.filter(memory).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
    return known.filter(again).withColumn("route", F.lit("retry")).unionByName(first.withColumn("route", F.lit("memory")))


def round_robin(rows: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """`rows` and shard: the i-th row of the whole order goes to shard i modulo `shards`.

    The order is global, but no task sees it whole: ranges are sorted separately and numbered from
    the sizes of the ranges before.
    """
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = ranged.withColumn("_i", place).join(F.broadcast(before), "_part")
    return numbered.withColumn("shard", F.pmod(F.col("_before") + F.col("_i"), F.lit(shards)).cast("int")).drop("_i", "_part", "_before")


def line_verdicts(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], verdict: str, absent: str = "unchanged") -> DataFrame:
    """keys, ours, theirs, agree: the verdict of either side per line (keys name side and row too); a line that a side doesn't list has `absent`.

    A line that one side lists several times has its least verdict.
    """
    one = lambda d, name: d.groupBy(*keys).agg(F.min(verdict).alias(name))
    joined = one(ours, "ours").join(one(theirs, "theirs"), list(keys), "full").fillna(absent, ["ours", "theirs"])
    return joined.withColumn("agree", F.col("ours") == F.col("theirs"))


def span_matches(records: DataFrame, nodes: DataFrame, keys: Sequence[str], start: str, end: str, node: str) -> DataFrame:
    """`records` and `node`: the node whose span equals the record's; of several (a node and its only child) the least, null where none does."""
    spans = nodes.groupBy(*keys, start, end).agg(F.min(node).alias(node))
    return records.join(spans, [*keys, start, end], "left")


def capped(rows: DataFrame, repository: str, family: str, order: Sequence[Column], most: int = 4) -> DataFrame:
    """At most `most` rows of each repository and family, the first by `order`; the cap is the feature."""
    w = Window.partitionBy(repository, family).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")


def in_number_order(rows: DataFrame, label: str, keep: Sequence[str]) -> DataFrame:
    """`rows` sorted by text with numbers in it as people read it: runs of digits count as numbers, the rest letter by letter without case."""
    parts = F.regexp_extract_all(F.lower(label), F.lit(r"\d+|\D+"), F.lit(0))
    # Leading zeros go, then the number of digits comes before the digits.
    digits = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    key = F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(digits(x)).cast("string"), 6, "0"), digits(x))).otherwise(F.concat(F.lit("1"), x)))
    return rows.orderBy(key, label, *keep)
