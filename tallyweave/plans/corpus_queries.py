"""Reports over the corpus tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import reports
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_KEY = r"""case when lower(split_part(path, '/', -1)) like '%.min.js' then 'min.js'
  when contains(trim(lower(split_part(path, '/', -1)), '.'), '.') then split_part(trim(lower(split_part(path, '/', -1)), '.'), '.', -1)
  else trim(lower(split_part(path, '/', -1)), '.') end"""
_CATEGORY = "case when key in ('rs','py','go','java','js','ts','c','h','cpp','rb','kt','swift','sh','lua') then 'Code' when key in ('csv','tsv','parquet','sql','xml','json') then 'Data' when key in ('yml','yaml','toml','ini','cfg','conf','lock') then 'Configuration' when key in ('md','rst','txt','adoc','tex') then 'Documentation' else 'Unknown' end"


@query(f"""select key, count(*) as changes, count(*) filter (where change_type = 'D') as binary_changes, sum(length(path))::bigint as lines_changed, count(distinct repository) as repositories, min(path) as sample
  from (select *, {_KEY} as key from commit_files) group by key""")
def census_by_extension(spark, d):
    """Changes per extension key with distinct repositories and a sample."""
    c = table(spark, d, "commit_files")
    return reports.census(c, paths.extension_key(F.col("path")), "repository", F.length("path"), F.col("change_type") == "D", "path")


@query(f"select {_CATEGORY} as category, count(*) as n, count(distinct repository) as repositories from (select *, {_KEY} as key from commit_files) group by 1")
def census_by_category(spark, d):
    c = table(spark, d, "commit_files")
    return c.groupBy(paths.category(F.col("path")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repository").alias("repositories"))


@query("select repository, \"commit\", path, split_part(path, '.', -1) as extension, split_part(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/(\\./)+', '/', 'g'), '/', 1) as folder, count(*) as n from robustness_full group by all")
def path_parts(spark, d):
    """The other extension rule and the first folder of every written path."""
    r = table(spark, d, "robustness_full")
    return r.groupBy("repository", "commit", "path", paths.last_extension(F.col("path")).alias("extension"), paths.top_folder(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query("""with n as (select old_path || ' => ' || path as p, old_path, path, repository from commit_files where old_path is not null)
  select repository, p, array_to_string([x for x in string_split(regexp_replace(p, '^(.*) => (.*)$', '\\1'), '/') if x <> ''], '/') as renamed_from,
    array_to_string([x for x in string_split(regexp_replace(p, '^(.*) => (.*)$', '\\2'), '/') if x <> ''], '/') as renamed_to, count(*) as n from n group by all""")
def rename_paths(spark, d):
    """Renames as the history prints them, taken apart."""
    c = table(spark, d, "commit_files").filter("old_path is not null").withColumn("p", F.concat("old_path", F.lit(" => "), "path"))
    return c.groupBy("repository", "p", paths.renamed_from(F.col("p")).alias("renamed_from"), paths.renamed_to(F.col("p")).alias("renamed_to")).agg(F.count(F.lit(1)).alias("n"))


@query("select repository, count(*) as files, count(distinct \"commit\") as commits, count(*) / count(distinct \"commit\") as files_per_commit from commit_files group by 1")
def files_per_commit(spark, d):
    return table(spark, d, "commit_files").groupBy("repository").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("commit").alias("commits")).withColumn("files_per_commit", F.col("files") / F.col("commits"))


_LINES = "case when content = '' then 0 else len(string_split(content, chr(10))) - (case when ends_with(content, chr(10)) then 1 else 0 end) end"
_BUCKET = "case when {0} is null then null when {0} < 10 then '0-10' when {0} < 30 then '10-30' when {0} < 100 then '30-100' when {0} < 300 then '100-300' when {0} < 1000 then '300-1000' when {0} < 3000 then '1000-3000' else '3000+' end"


@query(f"select file_id, lines, lines_split, {_BUCKET.format('lines')} as bucket, words, bytes from (select file_id, {_LINES} as lines, len(string_split(content, chr(10))) as lines_split, len(list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'))) as words, strlen(content) as bytes from file_contents)")
def text_sizes(spark, d):
    """Both line counts, the size bucket, distinct words and bytes of every file."""
    c = F.col("content")
    f = table(spark, d, "file_contents")
    return f.select("file_id", text.lines_read(c).alias("lines"), text.lines_split(c).alias("lines_split"), text.size_bucket(text.lines_read(c)).alias("bucket"), F.size(text.word_set(c)).alias("words"), F.octet_length(c).alias("bytes")).withColumn("words", F.when(F.col("bytes").isNotNull(), F.col("words")))


@query("select language, count(*) as total, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'timed_out') as timed_out, count(*) filter (where status = 'killed') as killed, count(*) filter (where status = 'unreadable') as unreadable, count(*) filter (where status = 'panicked') as panicked, count(*) filter (where status is null) as no_status from robustness_full group by 1")
def status_by_language(spark, d):
    return reports.status_counts(table(spark, d, "robustness_full"), ["language"], "status", ["ok", "timed_out", "killed", "unreadable", "panicked"])


@query("""select language, count(*) as n, round(avg(elapsed_ms), 2) as mean, round(stddev_samp(elapsed_ms), 2) as deviation,
  round((avg(elapsed_ms*elapsed_ms*elapsed_ms) - 3*avg(elapsed_ms)*avg(elapsed_ms*elapsed_ms) + 2*power(avg(elapsed_ms),3)) / power(stddev_pop(elapsed_ms),3), 2) as skew,
  round(quantile_cont(elapsed_ms, 0.5), 2) as p50, round(quantile_cont(elapsed_ms, 0.75), 2) as p75, round(quantile_cont(elapsed_ms, 0.9), 2) as p90, round(quantile_cont(elapsed_ms, 0.99), 2) as p99, round(max(elapsed_ms), 2) as largest
  from robustness_full where elapsed_ms is not null and language is not null group by 1""")
def elapsed_spread(spark, d):
    """Mean, deviation, skewness and linear percentiles of the run time."""
    out = reports.spread(table(spark, d, "robustness_full").filter("language is not null"), ["language"], "elapsed_ms")
    return out.select("language", "n", *(F.round(c, 2).alias(c) for c in ("mean", "deviation", "skew", "p50", "p75", "p90", "p99", "largest")))


@query("select language, quantile_disc(peak_memory_bytes, 0.5)::double as p500, quantile_disc(peak_memory_bytes, 0.9)::double as p900, quantile_disc(peak_memory_bytes, 0.99)::double as p990 from robustness_full where peak_memory_bytes is not null group by 1")
def peak_nearest_rank(spark, d):
    return reports.nearest_rank(table(spark, d, "robustness_full"), ["language"], "peak_memory_bytes", [500, 900, 990])


@query("""select * exclude (rank) from (select run_id, repository, "commit", path, status, elapsed_ms, row_number() over (partition by repository, "commit", path order by coalesce(status = 'killed', false), measured_at desc nulls last, run_id desc) as rank from robustness_full) where rank = 1""")
def merged_runs(spark, d):
    """The last measured row of every written pair; a killed one only where nothing was measured."""
    r = table(spark, d, "robustness_full").select("run_id", "repository", "commit", "path", "status", "elapsed_ms", "measured_at")
    return reports.measured_or_killed(r, ["repository", "commit", "path"], "status", [F.desc_nulls_last("measured_at"), F.desc("run_id")]).drop("measured_at")


@query("""with one as (select * from (select *, row_number() over (partition by repository, "commit", path order by run_id desc) as rank from robustness_full where shard % 2 = 1) where rank = 1)
  select l.repository, l."commit", l.path, l.elapsed_ms as left_value, r.elapsed_ms as right_value from robustness_full l join one r on l.repository = r.repository and l."commit" = r."commit" and l.path = r.path where l.status = 'ok' and r.status = 'ok' and l.shard % 2 = 0""")
def run_comparison(spark, d):
    """Pairs that ended well in the even and in the odd shards, as two runs."""
    r = table(spark, d, "robustness_full")
    return reports.compare_runs(r.filter("shard % 2 = 0"), r.filter("shard % 2 = 1"), ["repository", "commit", "path"], "status", "elapsed_ms", [F.desc("run_id")])


@query("select language, peak_memory_bytes, repository, path from (select language, peak_memory_bytes, repository, path, row_number() over (partition by language order by peak_memory_bytes desc, run_id) as rank from robustness_full where peak_memory_bytes is not null) where rank = 1")
def largest_heap(spark, d):
    """The run of the largest heap per language; the first of equal ones."""
    return reports.most_by(table(spark, d, "robustness_full"), ["language"], "peak_memory_bytes", ["repository", "path"], "run_id").select("language", "peak_memory_bytes", "repository", "path")


@query("""with l as (select distinct language from candidates), b as (select unnest(['0-10', '10-30', '30-100', '100-300', '300-1000', '1000-3000', '3000+']) as size_bucket), n as (select language, size_bucket, count(*) as n from candidates group by 1, 2)
  select l.language, b.size_bucket, coalesce(n.n, 0) as n from l cross join b left join n on l.language is not distinct from n.language and b.size_bucket = n.size_bucket""")
def sample_cells(spark, d):
    """Sampled pairs per language and size bucket, empty cells too."""
    return reports.with_empty_cells(table(spark, d, "candidates"), "language", "size_bucket", ["0-10", "10-30", "30-100", "100-300", "300-1000", "1000-3000", "3000+"])


@query("select coalesce(lang, 'none') as old, case when contains(lower(text), ' der ') or contains(lower(text), ' die ') then 'de' when contains(lower(text), ' le ') or contains(lower(text), ' la ') then 'fr' else 'en' end as new, count(*) as n from documents group by 1, 2")
def language_transitions(spark, d):
    """Which language labels a rule would change to which."""
    t = F.lower("text")
    rule = F.when(t.contains(" der ") | t.contains(" die "), "de").when(t.contains(" le ") | t.contains(" la "), "fr").otherwise("en")
    return reports.transitions(table(spark, d, "documents"), F.coalesce("lang", F.lit("none")), rule)


@query("""with x as (select coalesce(language, 'none') as category, 1 as b, 0 as a from candidates union all select coalesce(upper(split_part(path, '.', -1)), 'none'), 0, 1 from candidates)
  select category, sum(b)::bigint as before, sum(a)::bigint as after, (sum(a) - sum(b))::bigint as change from x group by 1""")
def categories_before_after(spark, d):
    c = table(spark, d, "candidates")
    return reports.before_and_after(c, F.coalesce("language", F.lit("none")), F.coalesce(F.upper(paths.last_extension(F.col("path"))), F.lit("none")))


@query("""with n as (select repository, count(*) as n, count(*) filter (where not (status = 'killed' or starts_with(status, 'pan'))) as c from (select repository, coalesce(status, 'missing') as status from robustness_full) where status <> 'missing' group by 1)
  select sum(c) / sum(n) as raw, sum(c * least(1.0, 20 / n)) / sum(n * least(1.0, 20 / n)) as capped, avg(c / n) as mean_of_repositories from n""")
def covered_shares(spark, d):
    """Raw, capped and mean share of runs that weren't killed."""
    r = table(spark, d, "robustness_full").select("repository", F.when(F.col("status").startswith("pan"), F.concat(F.lit(":"), "status")).otherwise(F.coalesce("status", F.lit("missing"))).alias("outcome"))
    return reports.covered_shares(r, "repository", "outcome", 20, binary="killed")


_HASH60 = "('0x' || substr(md5({0}), 1, 15))::bigint"


@query(f"select language, size_bucket, candidate_id from (select *, row_number() over (partition by language, size_bucket order by {_HASH60.format('candidate_id::varchar')}, candidate_id) as r from candidates) where r <= 8")
def hash_sample(spark, d):
    """Eight pairs of every cell by the least hash: a uniform sample that is the same everywhere."""
    c = table(spark, d, "candidates").select("language", "size_bucket", "candidate_id")
    return reports.sample_by_hash(c, ["language", "size_bucket"], text.portable_hash(F.col("candidate_id").cast("string")), 8)


@query("""select repository, "commit" from (select *, row_number() over (partition by repository order by committed_at desc nulls last, "commit", loaded_at) as r from commits) where r <= 10 and n_files % 2 = 1""")
def recent_commits(spark, d):
    """Of the ten latest commits of each repository, those that pass a filter afterwards (an odd number of files stands for one parent)."""
    c = table(spark, d, "commits").withColumn("tie", F.concat("commit", F.col("loaded_at").cast("string")))
    return reports.recent_single_parent(c, "repository", "committed_at", F.col("n_files") % 2, 10, "tie").select("repository", "commit")


@query("""select language, count(*) filter (where ast_nodes_before = ast_nodes_after) as perfect, count(*) filter (where ast_nodes_before <> ast_nodes_after and s >= 0.99) as above_99, count(*) filter (where s >= 0.95 and s < 0.99) as above_95, count(*) filter (where s < 0.95) as below_95
  from (select *, least(ast_nodes_before, ast_nodes_after) / greatest(ast_nodes_before, ast_nodes_after) as s from robustness_full where ast_nodes_before is not null and ast_nodes_after is not null and greatest(ast_nodes_before, ast_nodes_after) > 0) group by 1""")
def agreement_buckets(spark, d):
    r = table(spark, d, "robustness_full").filter("ast_nodes_before is not null and ast_nodes_after is not null")
    return reports.agreement(r, ["language"], F.least("ast_nodes_before", "ast_nodes_after"), F.greatest("ast_nodes_before", "ast_nodes_after"))


@query("""select doc_id, bool_and(abusive = guess) as perfect, bool_and(abs(abusive - guess) <= 1) as near from (select l.doc_id, l.abusive, (contains(lower(d.text), 'you'))::int as guess from doc_labels l join documents d using (doc_id)) where abusive is not null group by 1""")
def verdict_agreement(spark, d):
    """How raters agree with a simple rule, per document."""
    l = table(spark, d, "doc_labels").join(table(spark, d, "documents").select("doc_id", F.lower("text").contains("you").cast("int").alias("guess")), "doc_id")
    return reports.verdict_agreement(l, ["doc_id"], "abusive", "guess")


@query("""select repository, path, count(*) as n, stddev_samp(elapsed_ms) / avg(elapsed_ms) as variation from robustness_full where elapsed_ms is not null group by 1, 2 having count(*) > 1""")
def timing_variation(spark, d):
    return reports.variation(table(spark, d, "robustness_full"), ["repository", "path"], "elapsed_ms")


@query("select language as variant, avg(elapsed_ms) as score, avg(elapsed_ms) - (select avg(elapsed_ms) from robustness_full where language = 'C') as change from robustness_full where language <> 'C' group by 1")
def ablation(spark, d):
    """Mean run time per language against one as the baseline."""
    means = table(spark, d, "robustness_full").filter("language is not null").groupBy(F.col("language").alias("variant")).agg(F.avg("elapsed_ms").alias("score"))
    return reports.against_baseline(means, "variant", "C", "score").drop("shown")


@query("select distinct language, ast_nodes_before, cume_dist() over (partition by language order by ast_nodes_before) as share from robustness_full where ast_nodes_before is not null")
def nodes_distribution(spark, d):
    return reports.cumulative_share(table(spark, d, "robustness_full"), ["language"], "ast_nodes_before")


@query("""with v as (select language, log10(peak_memory_bytes::double) as v from robustness_full where peak_memory_bytes > 0), e as (select language, min(v) as lo, quantile_cont(v, 0.99) as hi from v group by 1)
  select v.language, (case when hi = lo then 0 else least(39, floor((v - lo) / (hi - lo) * 40)) end)::int as bin, count(*) as n from v join e on v.language is not distinct from e.language where v <= hi group by 1, 2""")
def memory_histogram(spark, d):
    """Forty logarithmic bins of the peak memory per language, trimmed at its 99th percentile."""
    return reports.histogram(table(spark, d, "robustness_full"), ["language"], "peak_memory_bytes", 40, 0.99, log=True)


@query("select language, count(*) as n, stddev_pop(ln(elapsed_ms)) as sigma, exp(avg(ln(elapsed_ms))) as scale from robustness_full where elapsed_ms > 0 group by 1")
def lognormal_fit(spark, d):
    return reports.lognormal(table(spark, d, "robustness_full"), ["language"], "elapsed_ms")


@query("""select area, sum(ast_nodes_after)::bigint as covered, sum(ast_nodes_before)::bigint as count, sum(ast_nodes_after) / sum(ast_nodes_before) as share from (select *, case when starts_with(path, 'crates/engine/src') then 'engine' when starts_with(path, 'tests') then 'tests' when starts_with(path, 'crates') then 'crates' when starts_with(path, 'src') then 'src' else 'other' end as area from robustness_full) where ast_nodes_before > 0 group by 1""")
def coverage_by_area(spark, d):
    """Coverage per area, the longest prefix deciding (nodes stand for lines)."""
    r = reports.longest_prefix(table(spark, d, "robustness_full"), "path", {"src": "src", "crates": "crates", "crates/engine/src": "engine", "tests": "tests"})
    return reports.coverage(r, ["area"], "ast_nodes_after", "ast_nodes_before")


@query("""with known as (select r.* from robustness_full r where exists (select 1 from candidates c where c.repository = r.repository and c."commit" = r."commit" and c.path = r.path))
  select run_id, 'retry' as route from known where status = 'timed_out' or (status = 'killed' and (exit_status is null or exit_status <> '137'))
  union all select run_id, 'memory' from (select *, row_number() over (partition by repository, path order by measured_at nulls last, repository, "commit", path) as rank from known where status = 'killed' and exit_status = '137') where rank = 1""")
def retry_routes(spark, d):
    """Which runs go again and where."""
    r = table(spark, d, "robustness_full")
    return reports.to_retry(r, table(spark, d, "candidates"), ["repository", "commit", "path"], ["repository", "path"], "status", "exit_status", "measured_at").select("run_id", "route")


@query("""select shard, count(*) as n, sum(run_id)::bigint as ids from (select run_id, (row_number() over (order by run_id) - 1) % 7 as shard from robustness_full) group by 1""")
def round_robin_shards(spark, d):
    r = table(spark, d, "robustness_full").select("run_id")
    return reports.round_robin(r, ["run_id"], 7).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("run_id").alias("ids"))


@query("select key, sum(n)::bigint as n from (select repository as key, count(*) as n from commits group by 1 union all select repository, count(*) from commit_files group by 1) group by 1")
def merged_counts(spark, d):
    """Counters of separate sources added up."""
    count = lambda t: table(spark, d, t).groupBy(F.col("repository").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return reports.merge_counts([count("commits"), count("commit_files")], ["key"], ["n"])


@query("""select source, n from (select coalesce(source, 'none') as source, count(*) as n from documents where source is null or source <> 'chat_log' group by 1) order by n desc, source limit 10""")
def top_sources(spark, d):
    """The ten most frequent sources but one, ties by name."""
    s = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return s.filter("source <> 'chat_log'").orderBy(F.desc("n"), "source").limit(10)


@query("""select exit_status, case exit_status when '137' then 'out of memory' when '134' then 'aborted' when '143' then 'terminated' when '101' then 'panicked' else 'none' end as meaning, count(*) as runs, count(distinct path) as files from robustness_full group by 1, 2""")
def kill_meanings(spark, d):
    """What exit statuses mean, and how many files they hit."""
    r = table(spark, d, "robustness_full")
    meanings = F.create_map(*map(F.lit, ("137", "out of memory", "134", "aborted", "143", "terminated", "101", "panicked")))
    return r.groupBy("exit_status", F.coalesce(F.element_at(meanings, F.col("exit_status")), F.lit("none")).alias("meaning")).agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("path").alias("files"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice * (1 - l_discount)) as sum_disc_price, avg(l_discount) as avg_disc, count(*) as n from lineitem group by 1, 2""")
def line_totals(spark, d):
    """A plain aggregate over the largest star table."""
    l = table(spark, d, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc_price"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""select repository, count(*) as kept from candidates where path is not null and not (contains(path, '/.gitignore') or contains(path, '/.gitkeep') or contains(path, '/.git/') or contains(path, '/.github/') or contains(path, 'third_party') or contains(path, '3rdparty')) group by 1""")
def regular_paths(spark, d):
    """Sampled pairs per repository whose path a corpus scan doesn't skip."""
    c = table(spark, d, "candidates")
    return c.filter(F.col("path").isNotNull() & ~paths.is_anomalous(F.col("path"))).groupBy("repository").agg(F.count(F.lit(1)).alias("kept"))


@query("""select a.repository, a.path, case when b.n is null then 'A' when a.n is null then 'D' else 'M' end as change_type from (select repository, path, count(*) as n from candidates where piece % 2 = 0 and path is not null group by 1, 2) b
  full join (select repository, path, count(*) as n from candidates where piece % 2 = 1 and path is not null group by 1, 2) a on a.repository = b.repository and a.path = b.path where a.n is distinct from b.n and a.repository is not null
  union all select b.repository, b.path, 'D' from (select repository, path from candidates where piece % 2 = 0 and path is not null group by 1, 2) b where not exists (select 1 from candidates a where a.piece % 2 = 1 and a.repository = b.repository and a.path = b.path)""")
def snapshot_changes(spark, d):
    """Added, deleted and changed paths between the pairs of the even and of the odd pieces, as two snapshots."""
    from ..sources.archives import member_diff

    side = lambda odd: table(spark, d, "candidates").filter(f"piece % 2 = {odd} and path is not null").groupBy("repository", "path").agg(F.count(F.lit(1)).alias("n"))
    kind = F.create_map(*map(F.lit, ("added", "A", "removed", "D", "changed", "M")))
    return member_diff(side(0), side(1), ["repository"], "path", "n").filter("change <> 'unchanged'").select("repository", "path", kind[F.col("change")].alias("change_type"))
