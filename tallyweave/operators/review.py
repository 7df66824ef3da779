"""Bookkeeping around a tree diff: statuses, disagreement with people, queues, logs, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def node_status(mapping: DataFrame, key: list[str], side: str) -> DataFrame:
    """key, node_id, status (Matched, Deleted, Inserted, Unknown) of the nodes of one side (`before` or `after`)."""
    me, other = ("before_id", "after_id") if side == "before" else ("after_id", "before_id")
    status = (
        F.when(F.col("operation") == "NotYetSet", "Unknown")
        .when(F.col(other) > 0, "Matched")
        .otherwise("Deleted" if side == "before" else "Inserted")
    )
    return mapping.filter(F.col(me) > 0).select(*key, F.col(me).alias("node_id"), status.alias("status"))


def disagreement(ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """key, before_id, our_partner, their_partner where a marked node of theirs has another partner in ours (0: none).

    A node that they didn't mark never disagrees.
    """
    mine = ours.filter("before_id > 0").select(*key, "before_id", F.col("after_id").alias("our_partner"))
    marked = theirs.filter("before_id > 0").select(*key, "before_id", F.col("after_id").alias("their_partner"))
    return marked.join(mine, [*key, "before_id"], "left").filter(~F.col("our_partner").eqNullSafe(F.col("their_partner")))


def with_inherited_removals(marks: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """Marks of whole-subtree removals spelled out for every node below; own marks of a node come first."""
    sized = marks.filter("operation = 'DeleteWithChildren'").join(nodes.select(*key, F.col("node_id").alias("before_id"), "size"), [*key, "before_id"])
    below = sized.select(*key, F.explode(F.sequence(F.col("before_id"), F.col("before_id") + F.col("size") - 1)).alias("before_id"), F.lit(0).alias("after_id"), F.lit("Delete").alias("operation"), F.lit(1).alias("_rank"))
    own = marks.filter("operation <> 'DeleteWithChildren'").select(*key, "before_id", "after_id", "operation", F.lit(0).alias("_rank"))
    w = Window.partitionBy(*key, "before_id").orderBy("_rank", "after_id")
    return own.unionByName(below).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_rank")


def reason_bucket(reason: Column) -> Column:
    """The reason without its source: `Engine:detail` is in the bucket `Engine`."""
    return F.element_at(F.split(reason, ":"), 1)


def cross_kind_rule(kind_before: Column, kind_after: Column, leaf_before: Column, leaf_after: Column, parents_match: Column, in_error: Column) -> Column:
    """Which rule lets two nodes of different kinds be one: by form, never by the names of the kinds."""
    return (
        F.when(kind_before == kind_after, "same")
        .when(in_error, "error_region")
        .when(leaf_before & leaf_after & parents_match, "leaves_in_place")
        .when(~leaf_before & ~leaf_after & parents_match, "composites_in_place")
        .otherwise("refused")
    )


def next_matches(rows: DataFrame, by: list[str], order: str, label: Column, query: str) -> DataFrame:
    """`by`, order, next: the next row after each whose label holds the query, whatever its case; after the last the search starts over, the row itself comes last.

    An empty query matches nothing.
    """
    hit = (F.instr(F.lower(label), query.lower()) > 0) if query else F.lit(False)
    marked = rows.withColumn("_hit", F.when(hit, F.col(order)))
    # Read downwards, the latest hit so far is the next one; running values only, so no frame is read twice.
    down = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("_hit").over(Window.partitionBy(*by))
    return marked.select(*by, order, F.coalesce(F.last("_hit", ignorenulls=True).over(down), first).alias("next"))


def review_queue(lines: DataFrame, line: str) -> DataFrame:
    """case, sites, note of a tab-separated queue; blank lines, comments and lines with fewer than two fields are skipped."""
    parts = F.split(F.col(line), "\t", 3)
    kept = lines.filter((F.trim(line) != "") & ~F.startswith(F.ltrim(line), F.lit("#")) & (F.size(parts) >= 2))
    return kept.select(parts[0].alias("case"), parts[1].alias("sites"), F.when(F.size(parts) > 2, F.try_element_at(parts, F.lit(3))).alias("note"))


def queue_counts(queue: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """case, waiting: how many entries of review_queue() each case has; with `cases` those without any have 0."""
    counts = queue.groupBy("case").agg(F.count(F.lit(1)).alias("waiting"))
    return counts if cases is None else cases.select("case").distinct().join(counts, "case", "left").fillna(0, ["waiting"])


def without_first(lines: DataFrame, line: str, order: str, gone: str) -> DataFrame:
    """The queue without the first line that equals `gone`."""
    first = lines.filter(F.col(line) == gone).agg(F.min(order).alias("_first"))
    return lines.join(F.broadcast(first)).filter(~F.col(order).eqNullSafe(F.col("_first"))).drop("_first")


def key_log(lines: DataFrame, line: str) -> DataFrame:
    """mode, key, presses, edits, milliseconds of an append-only log of `ms, case, mode, key, edited`."""
    p = F.split(F.col(line), "\t")
    rows = lines.filter(F.size(p) == 5).select(p[0].try_cast("bigint").alias("ms"), p[2].alias("mode"), p[3].alias("key"), (p[4] == "1").alias("edited"))
    return rows.groupBy("mode", "key").agg(F.count(F.lit(1)).alias("presses"), F.count_if("edited").alias("edits"), F.sum("ms").alias("milliseconds"))


def looked_up(rows: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """`rows` and name; a key that has no name is an error, not a null."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    name = F.element_at(known, F.col(key))
    return rows.withColumn("name", F.when(name.isNotNull(), name).otherwise(F.raise_error(F.concat(F.lit("not registered: "), F.coalesce(F.col(key), F.lit("null"))))))


def tree_dump(nodes: DataFrame, key: list[str]) -> DataFrame:
    """key, node_id, line: one indented line per node in preorder."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("kind"), F.when(F.col("text") != "", F.concat(F.lit(" "), F.col("text"))).otherwise(""))
    return nodes.select(*key, "node_id", line.alias("line"))
