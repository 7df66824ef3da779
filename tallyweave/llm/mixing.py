"""Mixing sources to target shares of the total size by entropy balancing.

All documents start from one rate, that of the whole set. The least change of it (in relative
entropy) that gives each source its tokens tilts the rates exponentially: min(cap, rate exp(b_s x)),
x being a document's size over the mean size of its source. The convex dual, one b_s per source,
is solved by Newton's method on sums over all documents, kept within brackets. Rates are then
rounded to copies such that each source is off its tokens by about one document.

The tilt prefers long documents where a source is raised and short ones where it is lowered. With
`hold_size` the mean document size of each source is a second constraint; the rates are then
exp(a_s + b_s x), whose solution is one rate within a source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import VOCABULARY, with_token_counts

#: The targets are held on the driver, so their number is checked.
MOST_SOURCES = 10_000
#: Documents of one source and size that one task ranks.
CELL_ROWS = 200_000


def _plan_total(wanted: list[dict], sizes: dict) -> tuple[float, dict]:
    """The largest total that the caps allow, and the share of it of each source that has documents."""
    usable = [w for w in wanted if w["source"] in sizes and (w["target_share"] or 0) > 0 and w["max_repeats"] >= 1 and sizes[w["source"]][1] > 0]
    whole = sum(w["target_share"] for w in usable)
    shares = {w["source"]: w["target_share"] / whole for w in usable}
    total = min((w["max_repeats"] * sizes[w["source"]][1] / shares[w["source"]] for w in usable), default=0.0)
    return total, shares


def _newton(spark: SparkSession, cells: DataFrame, goals: dict, tolerance: float = 1e-9, most: int = 60) -> dict:
    """(a, b) per source with the sums of rates and of rates times x at their goals; a source's block of the Hessian is 2 x 2."""
    found = {s: np.zeros(2) for s in goals}
    held: dict = {}
    for _ in range(most):
        state = spark.createDataFrame([(s, float(v[0]), float(v[1])) for s, v in found.items()], "_source string, _a double, _b double")
        rate = F.col("_rows") * F.exp(F.least(F.lit(700.0), F.col("_a") + F.col("_b") * F.col("_x")))
        sums = (
            cells.join(F.broadcast(state), F.col("source") == F.col("_source"))
            .groupBy("source")
            .agg(F.sum(rate).alias("r"), F.sum(rate * F.col("_x")).alias("rx"), F.sum(rate * F.col("_x") * F.col("_x")).alias("rxx"))
            .collect()
        )  # one row per target
        worst = 0.0
        for row in sums:
            s, goal = row["source"], goals[row["source"]]
            gradient = np.array([row["r"] - goal[0], row["rx"] - goal[1]])
            off = float(np.max(np.abs(gradient) / goal))
            dual = row["r"] - found[s] @ goal
            if s in held and dual > held[s][0] + 1e-12 * abs(held[s][0]):  # too far: half of the last step
                held[s] = (held[s][0], held[s][1], held[s][2] / 2)
                found[s] = held[s][1] + held[s][2]
                worst = max(worst, 1.0)
                continue
            worst = max(worst, off)
            hessian = np.array([[row["r"], row["rx"]], [row["rx"], row["rxx"]]]) + np.eye(2) * 1e-12 * row["r"]
            step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]  # a source of equal sizes has one direction only
            held[s] = (dual, found[s].copy(), step)
            if off > tolerance:
                found[s] = found[s] + step
        if worst <= tolerance:
            return {s: (held[s][1] if s in held else v) for s, v in found.items()}
    raise RuntimeError(f"rates are still off their goals by {worst:.2g} after {most} passes")


def _tilts(spark: SparkSession, cells: DataFrame, goals: dict, start: float, tolerance: float = 1e-9, most: int = 200) -> dict:
    """(ln start, b) per source such that the sum of min(cap, start exp(b x)) x is at its goal.

    The sum rises with b, so every pass either takes Newton's step or halves the bracket that the
    passes before have left; a goal that takes all documents at their cap is (ln cap, 0).
    """
    found = dict.fromkeys(goals, 0.0)
    bracket: dict = {s: [None, None] for s in goals}
    done: dict = {}
    for _ in range(most):
        if not found:
            return done
        state = spark.createDataFrame([(s, float(b)) for s, b in found.items()], "_source string, _b double")
        free = F.col("_rows") * F.lit(start) * F.exp(F.least(F.lit(700.0), F.col("_b") * F.col("_x")))
        top = F.col("_rows") * F.col("_cap")
        sums = (
            cells.join(F.broadcast(state), F.col("source") == F.col("_source"))
            .groupBy("source")
            .agg(
                F.sum(F.least(free, top) * F.col("_x")).alias("rx"),
                F.coalesce(F.sum(F.when(free < top, free * F.col("_x") * F.col("_x"))), F.lit(0.0)).alias("rxx"),
                F.sum(top * F.col("_x")).alias("most"),
                F.max("_cap").alias("cap"),
            )
            .collect()
        )  # one row per target
        for row in sums:
            s, b = row["source"], found[row["source"]]
            off = row["rx"] - goals[s]
            if goals[s] >= row["most"] * (1 - tolerance):
                done[s] = np.array([np.log(row["cap"]), 0.0])
            elif abs(off) <= tolerance * goals[s]:
                done[s] = np.array([np.log(start), b])
            if s in done:
                del found[s]
                continue
            bracket[s][int(off > 0)] = b
            low, high = bracket[s]
            step = b - off / row["rxx"] if row["rxx"] > 0 else None
            if step is None or low is not None and step <= low or high is not None and step >= high or abs(step - b) > 1 + 4 * abs(b):
                step = (low + high) / 2 if low is not None and high is not None else b + (1 + 2 * abs(b)) * (-1 if off > 0 else 1)
            found[s] = step
    raise RuntimeError(f"no tilt found after {most} passes for {sorted(found)[:5]}")


def mixture(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "n_tokens", total: float | None = None, seed: int = 11, hold_size: bool = True) -> DataFrame:
    """`doc_id`, source, n_tokens, copies of every document that is in the training set.

    Each source of `targets` (source, target_share, max_repeats) gets its share of the tokens of
    the whole set, whose size is `total` or the largest that the caps allow. No document has more
    than `max_repeats` copies (null: 1). Sources without documents leave their share to the
    others in proportion; documents of no source, of a source without a target or without tokens
    are left out. With `hold_size` a source keeps its mean document size, else rates are tilted by
    size. A target that is given twice counts with its sum and its larger cap. Documents
    with one id are treated as separate documents.
    """
    spark = docs.sparkSession
    wanted = [r.asDict() for r in targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")).limit(MOST_SOURCES + 1).collect()]
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("n_tokens")).filter("n_tokens > 0 and source is not null")
    rows = cut_lineage(rows)  # each text is tokenised once
    cells = cut_lineage(rows.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("_rows")))
    known = spark.createDataFrame([(w["source"],) for w in wanted], "source string")
    facts = cells.join(F.broadcast(known), "source").groupBy("source").agg(F.sum("_rows").alias("n"), F.sum(F.col("_rows") * F.col("n_tokens")).alias("t"), F.max("_rows").alias("top")).collect()
    sizes = {r["source"]: (r["n"], r["t"]) for r in facts}
    largest, shares = _plan_total(wanted, sizes)
    aim = min(largest, total) if total else largest
    schema = f"{doc_id} {dict(docs.dtypes)[doc_id]}, source string, n_tokens bigint, copies bigint"
    if not shares or not aim:
        return spark.createDataFrame([], schema)

    # Sizes are scaled per source, so that x has mean 1 and Newton's steps are well conditioned.
    mean = spark.createDataFrame([(s, sizes[s][1] / sizes[s][0], int(next(w["max_repeats"] for w in wanted if w["source"] == s))) for s in shares], "source string, _mean double, _cap int")
    used = cells.join(F.broadcast(mean), "source").withColumn("_x", F.col("n_tokens") / F.col("_mean"))
    rates = {s: shares[s] * aim / sizes[s][1] for s in shares}
    # The mean of x is 1: a source's tokens over its mean size are its rate times its documents.
    if hold_size:
        solved = _newton(spark, used, {s: np.array([rates[s] * sizes[s][0]] * 2) for s in shares})
    else:
        solved = _tilts(spark, used, {s: rates[s] * sizes[s][0] for s in shares}, aim / sum(sizes[s][1] for s in shares))
    state = spark.createDataFrame([(s, float(v[0]), float(v[1])) for s, v in solved.items()], "source string, _a double, _b double")

    salts = -(-max(r["top"] for r in facts) // CELL_ROWS)
    salt = (lambda: F.pmod(F.xxhash64(F.lit(seed + 1), "_id"), F.lit(salts)).cast("int")) if salts > 1 else (lambda: F.lit(0))
    split = rows.withColumn("_salt", salt()).groupBy("source", "n_tokens", "_salt").agg(F.count(F.lit(1)).alias("_rows")) if salts > 1 else cells.withColumn("_salt", F.lit(0))
    rate = F.round(F.least(F.col("_cap").cast("double"), F.exp(F.col("_a") + F.col("_b") * F.col("n_tokens") / F.col("_mean"))), 7)
    along = Window.partitionBy("source").orderBy("n_tokens", "_salt")  # as many rows as sizes, not as documents
    parts = split.join(F.broadcast(mean), "source").join(F.broadcast(state), "source").withColumn("_rate", rate).withColumn("_whole", F.floor("_rate")).withColumn("_part", F.col("_rate") - F.floor("_rate"))
    parts = parts.withColumn("_upto", F.sum(F.col("_rows") * F.col("_part")).over(along))
    start = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1000)) / F.lit(1000.0)
    counted = parts.withColumn("_extra", F.floor(F.round(F.col("_upto") + start, 6)) - F.floor(F.round(F.col("_upto") - F.col("_rows") * F.col("_part") + start, 6)))
    quota = counted.select(F.col("source").alias("_s"), F.col("n_tokens").alias("_t"), F.col("_salt").alias("_c"), "_whole", "_extra")
    drawn = rows.withColumn("_salt", salt()).withColumn("_rank", F.row_number().over(Window.partitionBy("source", "n_tokens", "_salt").orderBy(F.xxhash64(F.lit(seed), "_id"), "_id")))
    out = drawn.join(quota, [F.col("source") == F.col("_s"), F.col("n_tokens") == F.col("_t"), F.col("_salt") == F.col("_c")])
    copies = F.col("_whole") + (F.col("_rank") <= F.col("_extra")).cast("bigint")
    return out.select(F.col("_id").alias(doc_id), "source", "n_tokens", copies.cast("bigint").alias("copies")).filter("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, documents, copies, tokens, actual_share: one row per target, met or not."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    out = targets.join(got, "source", "left").fillna(0, ["documents", "copies", "tokens", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # targets are few
    return out.select("source", "target_share", "max_repeats", "documents", "copies", "most_copies", "tokens", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("actual_share"))


def token_mixture(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total: float | None = None, seed: int = 11, hold_size: bool = False) -> DataFrame:
    """mixture() of texts, their sizes counted in tokens of the vocabulary file, by token constraints alone unless `hold_size`."""
    return mixture(with_token_counts(docs, "text", ["doc_id", "source"], vocabulary=vocabulary), targets, total=total, seed=seed, hold_size=hold_size)
