"""Queries p5 and p6: rows that fail to parse, references to records that do not exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bad_rows import bad_rows, good_rows, load_records
from ..operators.orphans import orphan_references, orphans_per_period
from ..session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_rows(load_records(table(spark, sf_dir, "robustness_raw"))).select("raw_id")


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows, typed."""
    return good_rows(load_records(table(spark, sf_dir, "robustness_raw"))).withColumn("loaded_us", F.unix_micros("loaded_at")).drop("raw_line", "loaded_at")


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected records per reason."""
    return bad_rows(load_records(table(spark, sf_dir, "robustness_raw"))).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


_REFERENCED = [
    ("repositories", ["repository"], "cloned_at", "removed_at"),
    ("commits", ["repository", "commit"], "loaded_at", "removed_at"),
    ("commit_files", ["repository", "commit", "path"], "loaded_at", None),
]


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "candidates")
    each = [
        orphan_references(candidates, "candidate_id", "sampled_at", table(spark, sf_dir, name), keys, start, end, name)
        for name, keys, start, end in _REFERENCED
    ]
    return reduce(DataFrame.unionByName, each)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("candidate_id", "missing_in")


def p6_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per referenced table and day of sampling."""
    return orphans_per_period(_orphans(spark, sf_dir), "sampled_at", "day")


_P5_SPLIT = r"""
with lines as (
  select raw_id, regexp_replace(raw_line, '\r$', '') as line from robustness_raw where raw_line is not null
), records as (
  select raw_id, line,
    regexp_full_match(line, '(?:[^",\r\n]*|"(?:[^"]|"")*")(?:,(?:[^",\r\n]*|"(?:[^"]|"")*")){8}') as whole,
    [case when f[2:2] = '"' then replace(f[3:-2], '""', '"') else f[2:] end
      for f in regexp_extract_all(',' || line, ',(?:"(?:[^"]|"")*"|[^",\r\n]*)')] as fields
  from lines
  where line <> '' and line <> 'language,repository,commit,path,status,elapsed_ms,ast_nodes_before,ast_nodes_after,peak_memory_bytes'
), judged as (
  select raw_id, fields, coalesce(whole and fields[1] <> '' and fields[2] <> '' and fields[4] <> ''
      and regexp_full_match(fields[3], '[0-9a-f]{40}')
      and fields[5] in ('ok', 'timed_out', 'killed', 'unreadable', 'panicked')
      and (regexp_full_match(fields[6], '[0-9]+(\.[0-9]+)?') or (fields[6] = '' and fields[5] <> 'ok'))
      and ((regexp_full_match(fields[7], '[0-9]+') and try_cast(fields[7] as bigint) is not null) or (fields[7] = '' and fields[5] <> 'ok'))
      and ((regexp_full_match(fields[8], '[0-9]+') and try_cast(fields[8] as bigint) is not null) or (fields[8] = '' and fields[5] <> 'ok'))
      and ((regexp_full_match(fields[9], '[0-9]+') and try_cast(fields[9] as bigint) is not null) or (fields[9] = '' and fields[5] <> 'ok')), false) as good
  from records
)
"""

_P6 = """
with cases as (
  select candidate_id, 'repositories' as missing_in, sampled_at from candidates c
  where repository is not null and sampled_at is not null and not exists (
    select 1 from repositories r where r.repository = c.repository and r.cloned_at <= c.sampled_at and (r.removed_at is null or c.sampled_at < r.removed_at))
  union all
  select candidate_id, 'commits', sampled_at from candidates c
  where repository is not null and "commit" is not null and sampled_at is not null and not exists (
    select 1 from commits r where r.repository = c.repository and r."commit" = c."commit" and r.loaded_at <= c.sampled_at and (r.removed_at is null or c.sampled_at < r.removed_at))
  union all
  select candidate_id, 'commit_files', sampled_at from candidates c
  where repository is not null and "commit" is not null and path is not null and sampled_at is not null and not exists (
    select 1 from commit_files r where r.repository = c.repository and r."commit" = c."commit" and r.path = c.path and r.loaded_at <= c.sampled_at)
)
"""

QUERIES = {"p5_found": p5_found, "p5_loaded": p5_loaded, "p5_reasons": p5_reasons, "p6_found": p6_found, "p6_per_period": p6_per_period}
SQL = {
    "p5_found": _P5_SPLIT + "select raw_id from judged where not good union all select raw_id from robustness_raw where raw_line is null",
    "p5_reasons": _P5_SPLIT
    + r"""
, told as (
  select j.raw_id, r.line, j.fields as fields, j.good, len(j.fields) as n,
    regexp_replace(r.line, '^(?:(?:[^",\r\n]*|"(?:[^"]|"")*"),)*', '') as rest
  from judged j join records r using (raw_id)
), formed as (
  select *, case
      when regexp_full_match(rest, '[^",\r\n]*|"(?:[^"]|"")*"') then null
      when starts_with(rest, '"') then case when regexp_matches(rest, '^"(?:[^"]|"")*"') then 'text_after_quote' else 'quote_not_closed' end
      when contains(string_split(rest, ',')[1], '"') then 'quote_inside_field' else 'line_break_inside_field' end as broken
  from told where not good
), valued as (
  select raw_id, case when broken is not null then broken when n < 9 then 'too_few_fields' when n > 9 then 'too_many_fields'
      when fields[1] = '' then 'empty_language' when fields[2] = '' then 'empty_repository' when fields[4] = '' then 'empty_path'
      when not regexp_full_match(fields[3], '[0-9a-f]{40}') then 'bad_commit'
      when fields[5] not in ('ok', 'timed_out', 'killed', 'unreadable', 'panicked') then 'bad_status'
      when fields[6] = '' and fields[5] = 'ok' then 'missing_elapsed_ms' when fields[6] <> '' and not regexp_full_match(fields[6], '[0-9]+(\.[0-9]+)?') then 'bad_elapsed_ms'
      when fields[7] = '' and fields[5] = 'ok' then 'missing_ast_nodes_before' when fields[7] <> '' and not (regexp_full_match(fields[7], '[0-9]+') and try_cast(fields[7] as bigint) is not null) then 'bad_ast_nodes_before'
      when fields[8] = '' and fields[5] = 'ok' then 'missing_ast_nodes_after' when fields[8] <> '' and not (regexp_full_match(fields[8], '[0-9]+') and try_cast(fields[8] as bigint) is not null) then 'bad_ast_nodes_after'
      when fields[9] = '' and fields[5] = 'ok' then 'missing_peak_memory_bytes' else 'bad_peak_memory_bytes' end as reason
  from formed
)
select reason, count(*) as records from (select reason from valued union all select 'no_text' from robustness_raw where raw_line is null) group by 1
""",
    "p5_loaded": _P5_SPLIT
    + """select j.raw_id, r.shard_file, r.line_no, epoch_us(r.loaded_at) as loaded_us, fields[1] as language, fields[2] as repository, fields[3] as "commit", fields[4] as path, fields[5] as status,
      cast(nullif(fields[6], '') as double) as elapsed_ms, cast(nullif(fields[7], '') as bigint) as ast_nodes_before,
      cast(nullif(fields[8], '') as bigint) as ast_nodes_after, cast(nullif(fields[9], '') as bigint) as peak_memory_bytes
      from judged j join robustness_raw r using (raw_id) where good""",
    "p6_found": _P6 + "select candidate_id, missing_in from cases",
    "p6_per_period": _P6 + "select missing_in, cast(sampled_at as date) as period, count(*) as orphans from cases group by 1, 2",
}
