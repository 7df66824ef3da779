"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import abuse, handwritten, leaks, mixing, percentiles, reservoir, survivor, syntax

METRICS = ["elapsed_ms", "peak_memory_bytes"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.judged_files(table(spark, sf_dir, "file_contents")).filter("reason is not null").select("file_id")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled files per language and reason, and the median peak memory of their runs."""
    key = ["repository", "commit", "path"]
    files = table(spark, sf_dir, "file_contents")
    judged = files.select("file_id", *key, "language").join(handwritten.judged_files(files), "file_id")
    sampled = table(spark, sf_dir, "candidates").select(*key).distinct()
    peaks = table(spark, sf_dir, "robustness_full").groupBy(*key).agg(F.max("peak_memory_bytes").alias("peak_memory_bytes"))
    joined = judged.join(sampled, key, "left_semi").join(peaks, key, "left")
    return joined.groupBy("language", F.coalesce("reason", F.lit("hand_written")).alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.percentile("peak_memory_bytes", 0.5).alias("median_peak_memory_bytes"))


def p2_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece by piece from the stream of candidates."""
    return reservoir.reservoirs(table(spark, sf_dir, "candidates"), ["language", "size_bucket"], "candidate_id", "piece", capacity=16)


def p2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the reservoirs that the pieces report."""
    return reservoir.merged_reservoirs(table(spark, sf_dir, "reservoir"), ["language", "size_bucket"])


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p2_samples holds per stratum: how many were offered, how many items it has, and how many different ones."""
    return p2_samples(spark, sf_dir).select("language", "size_bucket", "capacity", "seen", F.size("items").alias("items"), F.size(F.array_distinct("items")).alias("distinct_items"))


def p2_merged_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p2_merged holds per stratum."""
    return p2_merged(spark, sf_dir).select("language", "size_bucket", "capacity", "seen", F.size("items").alias("items"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.check_files(table(spark, sf_dir, "file_contents"), ["file_id"]).filter("not _valid").select("file_id")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of invalid files per repository and language."""
    return syntax.invalid_rates(syntax.check_files(table(spark, sf_dir, "file_contents"), ["repository"]), ["repository"])


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles per language and metric, all in the same passes; bytes as doubles, which are exact up to 2^53 (9 PB)."""
    metric = lambda m: F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
    runs = table(spark, sf_dir, "robustness_full").select("language", F.explode(F.array(*map(metric, METRICS))).alias("x")).select("language", "x.*")
    return percentiles.exact_percentiles(runs, ["language", "metric"], "value")


def p4_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles within one per cent from the summaries of the single shards and days."""
    runs = table(spark, sf_dir, "robustness_full").withColumn("day", F.to_date("measured_at"))
    each = [percentiles.combined_percentiles(percentiles.shard_counts(runs, ["language", "shard", "day"], m), ["language"]).withColumn("metric", F.lit(m)) for m in METRICS]
    return reduce(DataFrame.unionByName, each)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each leaked item is in."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document of the training set."""
    return mixing.token_mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.best_of_repeated(table(spark, sf_dir, "robustness_full"))


def p7_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of every pair; times as microseconds."""
    best = survivor.survivors(table(spark, sf_dir, "robustness_full"))
    return best.withColumns({"measured_us": F.unix_micros("measured_at"), "arrived_us": F.unix_micros("arrived_at")}).drop("measured_at", "arrived_at")


#: Score from which a document is abusive.
ABUSIVE = 0.5


def _abuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return abuse.scored(docs, abuse.fit_on(docs, table(spark, sf_dir, "doc_labels")), ["doc_id", "source"])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse_scores(spark, sf_dir).filter(F.col("score") > ABUSIVE).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of abusive documents per source."""
    return (
        _abuse_scores(spark, sf_dir)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") > ABUSIVE).alias("abusive"))
        .withColumn("rate", F.col("abusive") / F.col("documents"))
    )


_P7 = r"""
with clean as (
  select r.*, regexp_replace(regexp_replace(lower(trim(repository)), '^(\./|[/\s])+', ''), '(\.git|[/\s])+$', '') as repo,
    lower(trim("commit")) as hash,
    array_to_string([p for p in string_split(replace(path, '\', '/'), '/') if p not in ('', '.')], '/') as clean_path
  from robustness_full r where "commit" is not null and repository is not null and path is not null
), fulls as (
  select distinct repo, clean_path, hash from clean where length(hash) = 40
), shorts as (
  select s.repo, s.clean_path, s.hash, min(f.hash) as whole
  from (select distinct repo, clean_path, hash from clean where length(hash) between 4 and 39) s
  join fulls f on f.repo = s.repo and f.clean_path = s.clean_path and starts_with(f.hash, s.hash)
  group by 1, 2, 3 having count(*) = 1
), pairs as (
  select c.*, coalesce(s.whole, c.hash) as full_hash
  from clean c left join shorts s on s.repo = c.repo and s.clean_path = c.clean_path and s.hash = c.hash
), ranked as (
  select *, count(*) over w as n_rows, min(run_id) over w as first_run_id,
    row_number() over (partition by repo, full_hash, clean_path order by
      case when status is null or status = 'killed' then 0 else 1 end desc,
      (elapsed_ms is not null)::int + (ast_nodes_before is not null)::int + (ast_nodes_after is not null)::int + (peak_memory_bytes is not null)::int desc,
      measured_at desc nulls last, run_id desc) as rank
  from pairs window w as (partition by repo, full_hash, clean_path)
)
"""

_P4 = """
with long as (
  select language, 'elapsed_ms' as metric, elapsed_ms as v from robustness_full where elapsed_ms is not null
  union all
  select language, 'peak_memory_bytes', cast(peak_memory_bytes as double) from robustness_full where peak_memory_bytes is not null
), ranked as (
  select *, row_number() over (partition by language, metric order by v) as rank, count(*) over (partition by language, metric) as n from long
)
select language, metric, n, permille, v as value
from ranked cross join (select unnest([250, 500, 750, 900, 990]) as permille)
where rank = greatest(1, (n * permille + 999) // 1000)
"""

_COUNTED = """
with runs as (
  select language, shard, metric, v from (
    select language, shard, 'elapsed_ms' as metric, elapsed_ms as v from robustness_full union all select language, shard, 'peak_memory_bytes', cast(peak_memory_bytes as double) from robustness_full)
  where v is not null and not isnan(v)
), steps as (
  select language, metric, sign(v)::int as side, case when v = 0 then 0 else floor(ln(abs(v)) / ln(1.01 / 0.99))::bigint end as step, count(*) as rows from runs group by 1, 2, 3, 4
), summed as (
  select *, sum(rows) over (partition by language, metric order by side, case when side < 0 then -step else step end) as upto, sum(rows) over (partition by language, metric) as n from steps
), ranked as (
  select *, greatest(1, (n * permille + 999) // 1000) as rank from summed cross join (select unnest([250, 500, 750, 900, 990]) as permille)
), cells as (
  select *, pow(1.01 / 0.99, step) as near, pow(1.01 / 0.99, step + 1) as far from ranked where rank <= upto and rank > upto - rows
)
select language, metric, n::bigint as n, permille, case side when 0 then 0 else side * 2 * near * far / (near + far) end as value,
  case side when 0 then 0 when 1 then near else -far end as low, case side when 0 then 0 when 1 then far else -near end as high from cells
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_reasons": p1_reasons,
    "p2_samples": p2_samples,
    "p2_merged": p2_merged,
    "p2_sizes": p2_sizes,
    "p2_merged_sizes": p2_merged_sizes,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_percentiles": p4_percentiles,
    "p4_combined": p4_combined,
    "p7_found": p7_found,
    "p7_survivors": p7_survivors,
    "p8_found": p8_found,
    "p8_per_item": p8_per_item,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}
SQL = {
    "p2_sizes": """select language, size_bucket, 16 as capacity, count(*) as seen, least(16, count(*))::int as items, least(16, count(*))::int as distinct_items
from candidates where language is not null and size_bucket is not null group by 1, 2""",
    "p2_merged_sizes": """with whole as (select * from reservoir where language is not null and size_bucket is not null and seen is not null and items is not null),
one as (select * from whole qualify row_number() over (partition by language, size_bucket, piece order by seen desc, reported_at desc nulls last, items desc) = 1),
size as (select language, size_bucket, min(capacity) as capacity, sum(seen) as seen from one group by 1, 2),
short as (select o.language, o.size_bucket, min(case when len(o.items) < least(o.seen, s.capacity) then len(o.items) end) as held from one o join size s on s.language = o.language and s.size_bucket = o.size_bucket group by 1, 2)
select language, size_bucket, capacity::int as capacity, seen::bigint as seen, least(capacity, seen, coalesce(held, capacity))::int as items from size join short using (language, size_bucket)""",
    "p4_combined": _COUNTED,
    "p4_percentiles": _P4,
    "p7_found": _P7 + "select first_run_id, run_id as best_run_id from ranked where rank = 1 and n_rows > 1",
    "p7_survivors": _P7
    + """select repo as repository, full_hash as "commit", clean_path as path, run_id, language, status, elapsed_ms, ast_nodes_before, ast_nodes_after,
      peak_memory_bytes, exit_status, shard, epoch_us(measured_at) as measured_us, epoch_us(arrived_at) as arrived_us, n_rows from ranked where rank = 1""",
}
