"""Line, member, tree and sketch queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hunks, schemas, text
from ..operators import conventions, linediff, painting, pairing, review, sketches, treediff, trees
from ..sources.archives import member_diff
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


def document_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every document and the one before it in its repository and source: pair_id, before, after."""
    return pairing.with_previous(table(spark, d, "documents"), ["repository", "source"], ["doc_id"], "doc_id", "text").filter("before is not null")


def version_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every file and the one before it of its repository and language: pair_id, language, before, after."""
    files = table(spark, d, "file_contents")
    return pairing.with_previous(files, ["repository", "language"], ["path", "file_id"], "file_id", "content", ["language"]).filter("before is not null and after is not null")


_PAIRS = "pairs as (select * from (select doc_id as pair_id, lag(text) over (partition by repository, source order by doc_id) as before, text as after from documents) where before is not null)"


@query(f"""with {_PAIRS}, lines as (
  select pair_id, unnest(string_split(regexp_replace(before, '\\n\\z', ''), chr(10))) as line, 1 as b, 0 as a from pairs where before <> ''
  union all select pair_id, unnest(string_split(regexp_replace(after, '\\n\\z', ''), chr(10))), 0, 1 from pairs where after <> ''
), counts as (select pair_id, line, sum(b) as b, sum(a) as a from lines group by 1, 2)
select p.pair_id, coalesce(sum(least(a, b)), 0)::bigint as kept, coalesce(sum(greatest(b - a, 0)), 0)::bigint as deleted, coalesce(sum(greatest(a - b, 0)), 0)::bigint as inserted from pairs p left join counts c using (pair_id) group by 1""")
def line_multiset_diff(spark, d):
    """Kept, deleted and inserted lines of every pair of documents, whatever their order."""
    return linediff.multiset_diff(document_pairs(spark, d), "pair_id", "before", "after")


_VERSIONS = "versions as (select * from (select file_id as pair_id, language, lag(content) over (partition by repository, language order by path nulls first, file_id) as before, content as after from file_contents) where before is not null and after is not null)"


@query(f"""with recursive {_VERSIONS},
a as (select pair_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as i from (select pair_id, string_split(before, chr(10)) as l from versions)),
b as (select pair_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as j from (select pair_id, string_split(after, chr(10)) as l from versions)),
longest(pair_id, i, j, v) as (
  select pair_id, 0::bigint, j, 0::bigint from b union all select pair_id, 0, 0, 0 from versions
  union all
  select pair_id, i + 1, j, max(offered) over (partition by pair_id order by j)::bigint from (
    select l.pair_id, l.i, l.j, case when b.line = a.line then greatest(l.v, lag(l.v) over (partition by l.pair_id order by l.j) + 1) else l.v end as offered
    from longest l join a on a.pair_id = l.pair_id and a.i = l.i + 1 left join b on b.pair_id = l.pair_id and b.j = l.j))
, sizes as (select pair_id, len(string_split(before, chr(10))) as n, len(string_split(after, chr(10))) as m from versions), found as (select pair_id, max(v) as kept from longest group by 1)
select pair_id, kept::int as kept, (n - kept)::int as deleted, (m - kept)::int as inserted, (n + m - 2 * kept)::int as distance from sizes join found using (pair_id)""")
def line_ordered_diff(spark, d):
    """The ordered line diff of every pair of files."""
    return linediff.ordered_diff(version_pairs(spark, d), "pair_id", "before", "after").drop("moved")


@query()
def line_classes(spark, d):
    """Kept, moved, unmatched and blank lines over all pairs of files."""
    return linediff.line_classes(version_pairs(spark, d), "pair_id", "before", "after").groupBy("side", "class").agg(F.count(F.lit(1)).alias("lines"))


@query(f"with {_VERSIONS} select pair_id, cast(null as varchar) as violation from versions")
def diff_documents_json(spark, d):
    """Diffs as JSON, and that each keeps to the schema."""
    diffs = linediff.diffs_as_json(version_pairs(spark, d), "pair_id", "before", "after")
    return schemas.check_json(diffs, "diff", linediff.DIFF_SCHEMA, ["pair_id"])


@query("""with ops as (select p.before, p.after from (select doc_id, lag(text) over (partition by repository, source order by doc_id) as before, text as after from documents) p where before is not null)
select least(3000, greatest(len(before), len(after)) // 100) as size, count(*) as pairs, sum(len(after) - len(before))::bigint as growth from ops group by 1""")
def size_changes(spark, d):
    """Derived differences of size per size class."""
    p = document_pairs(spark, d)
    b, a = F.length("before"), F.length("after")
    return p.groupBy(F.least(F.lit(3000), F.floor(F.greatest(b, a) / 100)).alias("size")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(a - b).alias("growth"))


_EDITED = "select o_orderkey as k, (o_totalprice * case when o_orderkey % 7 = 0 then 2 else 1 end)::double as v from orders where o_orderkey % 11 <> 0 union all select -o_orderkey, o_totalprice from orders where o_orderkey % 13 = 0"


@query(f"""with b as (select o_orderkey as k, o_totalprice::double as v from orders), a as ({_EDITED})
select case when b.k is null then 'added' when a.k is null then 'removed' when a.v = b.v then 'unchanged' else 'changed' end as change, count(*) as n from b full join a on a.k = b.k group by 1""")
def keyed_member_diff(spark, d):
    """Added, removed, changed and unchanged members of two snapshots of a table, one of them edited by rule."""
    o = table(spark, d, "orders")
    before = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    edited = o.filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 7 == 0, 2).otherwise(1)).alias("v"))
    after = edited.unionByName(o.filter("o_orderkey % 13 = 0").select((-F.col("o_orderkey")).alias("k"), F.col("o_totalprice").alias("v")))
    return member_diff(before, after, [], "k", "v").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def _patches(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commits").filter("n_files is not null")
    return c.select("repository", "commit", F.format_string("@@ -%d,%d +%d @@ x\n@@ -%d,0 +%d,2 @@", "n_files", F.col("n_files") % 3, F.col("n_files") + 1, F.col("n_files") + 9, F.col("n_files") + 10).alias("patch"))


@query("""with c as (select repository, "commit", n_files as n from commits where n_files is not null), t as (
  select repository, 'before' as side, unnest(range(n, n + n % 3)) as line from c union all select repository, 'after', n + 1 from c union all select repository, 'after', unnest([n + 10, n + 11]) from c)
select repository, side, count(*) as lines, sum(line)::bigint as total from t group by 1, 2""")
def hunk_lines(spark, d):
    """Lines that hunk headers touch; a count of 0 touches none, a missing one is 1."""
    return hunks.touched_lines(_patches(spark, d), "patch", ["repository"]).groupBy("repository", "side").agg(F.count(F.lit(1)).alias("lines"), F.sum("line").alias("total"))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query(f"""with w as (select doc_id, unnest(list_distinct({_WORDS})) as w from documents), h as (select distinct doc_id, ('0x' || substr(md5(w), 1, 15))::bigint as h from w)
select doc_id, list(h order by h) as sketch from (select *, row_number() over (partition by doc_id order by h) as r from h) where r <= 16 group by 1""")
def text_sketches(spark, d):
    """The sixteen least word hashes of every document."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(text.word_set(F.col("text"))).alias("w"))
    return sketches.sketch_rows(docs, ["doc_id"], text.portable_hash(F.col("w")))


@query(f"""with {_PAIRS}, s as (select pair_id, [('0x' || substr(md5(x), 1, 15))::bigint for x in list_distinct(regexp_extract_all(lower(before), '[\\p{{L}}\\p{{N}}]+'))] as b, [('0x' || substr(md5(x), 1, 15))::bigint for x in list_distinct(regexp_extract_all(lower(after), '[\\p{{L}}\\p{{N}}]+'))] as a from pairs),
 k as (select pair_id, list_sort(list_distinct(b))[1:16] as b, list_sort(list_distinct(a))[1:16] as a from s), u as (select *, list_sort(list_distinct(list_concat(a, b)))[1:16] as u from k)
select pair_id, case when len(u) = 0 then 0.0 else len([x for x in u if list_contains(a, x) and list_contains(b, x)]) / len(u) end as similarity from u""")
def sketch_similarity(spark, d):
    """The estimated similarity of every pair of documents."""
    hashed = lambda c: sketches.sketch_of(F.transform(text.word_set(F.col(c)), text.portable_hash))
    p = document_pairs(spark, d).select("pair_id", hashed("before").alias("b"), hashed("after").alias("a"))
    return p.select("pair_id", sketches.similarity(F.col("a"), F.col("b")).alias("similarity"))


@query("""with w as (select doc_id, source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as w from documents), h as (select distinct source, ('0x' || substr(md5(w), 1, 15))::bigint as h from w)
select source, list(h order by h) as sketch from (select *, row_number() over (partition by source order by h) as r from h) where r <= 16 group by 1""")
def source_sketches(spark, d):
    """Sketches of whole sources, merged from those of their documents."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.explode(text.word_set(F.col("text"))).alias("w"))
    each = sketches.sketch_rows(docs, ["doc_id", "source"], text.portable_hash(F.col("w")))
    return sketches.sketch_rows(each.select("source", F.explode("sketch").alias("h")), ["source"], F.col("h"))


@query("""with e as (select event_id, user_id, event_type, ts, lag(event_type) over (partition by user_id order by ts, event_id) as p from events),
 r as (select *, sum(case when p is null or p <> event_type then 1 else 0 end) over (partition by user_id order by ts, event_id) as run from e)
select user_id, event_type, run::bigint as run, count(*) as n, min(event_id) as first_id from r group by 1, 2, 3""")
def event_runs(spark, d):
    """Runs of one kind in a row (gaps and islands)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("_new", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)) | F.lag("event_type").over(w).isNull()).cast("int"))
    return e.withColumn("run", F.sum("_new").over(w)).groupBy("user_id", "event_type", "run").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def _tree_nodes(spark: SparkSession, d: str, side: str) -> DataFrame:
    return trees.nodes(version_pairs(spark, d), side, "language", ["pair_id"])


@query()
def tree_sizes(spark, d):
    """Nodes per kind and the deepest level over all files."""
    f = table(spark, d, "file_contents")
    return trees.nodes(f, "content", "language", ["file_id"]).groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("deepest"), F.max("size").alias("largest"))


@query()
def tree_hash_matches(spark, d):
    """Outermost equal subtrees of each pair of files, by their hashes."""
    found = trees.outermost_matches(version_pairs(spark, d), "pair_id", "before", "after", "language", 3)
    return found.groupBy("pair_id").agg(F.count(F.lit(1)).alias("subtrees"))


@query()
def tree_reasons(spark, d):
    """Decisions of the tree diff by operation and reason over all pairs of files, and what they cost."""
    m = treediff.tree_mapping(version_pairs(spark, d), "pair_id", "before", "after", "language")
    return m.groupBy("operation", "reason").agg(F.count(F.lit(1)).alias("nodes"), F.sum("cost").alias("cost"))


@query()
def tree_costs(spark, d):
    """The cost of each pair's mapping."""
    m = treediff.tree_mapping(version_pairs(spark, d), "pair_id", "before", "after", "language")
    return m.groupBy("pair_id").agg(F.sum("cost").alias("cost"))


_TOKEN = r"""(?s)\s+|//[^\n]*|#[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|\d[\p{L}\p{N}_.]*|[\p{L}_][\p{L}\p{N}_]*|."""


@query(f"""with {_VERSIONS}, sides as (select pair_id, 0 as side, before as t from versions where language is distinct from 'Json' union all select pair_id, 1, after from versions where language is distinct from 'Json'),
tokens as (select pair_id, side, unnest(regexp_extract_all(t, '{_TOKEN}')) as w from sides), one as (select pair_id, side, w from tokens where regexp_full_match(w, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*') group by 1, 2, 3 having count(*) = 1)
select pair_id, count(*) as names from (select pair_id, w from one group by 1, 2 having count(*) = 2) group by 1""")
def tree_unique_keys(spark, d):
    """Declared names that are alone of their text on both sides of a pair."""
    name = lambda s: _tree_nodes(spark, d, s).filter("kind = 'name'").select("pair_id", "text", "node_id")
    return trees.unique_key_matches(name("before"), name("after"), ["pair_id", "text"], "node_id").groupBy("pair_id").agg(F.count(F.lit(1)).alias("names"))


@query()
def tree_gaps(spark, d):
    """Characters of inner nodes that no child covers. JSON is read as tokens too, as nodes of its own trees have no place in the text."""
    return trees.gaps_of_texts(table(spark, d, "file_contents"), "content")


@query()
def tree_status(spark, d):
    """Matched, deleted and inserted nodes per kind of the side before."""
    return conventions.status_counts(version_pairs(spark, d), "before", "after", "language")


@query()
def tree_ablation(spark, d):
    """What leaving out a pass costs: the summed cost of all pairs without it."""
    passes = ["none", "orphaned_leaves", "residual", "moved_subtrees", "surviving_values", "unique_type", "mutual_ancestors"]
    return conventions.ablation_costs(version_pairs(spark, d), "before", "after", "language", passes)


@query()
def tree_bracket_fates(spark, d):
    """How the brackets of each group are painted."""
    return conventions.bracket_fates(version_pairs(spark, d), "before", "after")


@query()
def tree_leaf_conventions(spark, d):
    """Matched leaves by what happened to their rows, columns and neighbours."""
    return conventions.leaf_conventions(version_pairs(spark, d), "before", "after", "language")


@query()
def tree_node_paths(spark, d):
    """How many distinct paths of kinds every file has; a null language is told by the extension."""
    f = table(spark, d, "file_contents").withColumn("language", F.coalesce("language", F.when(F.lower("path").endswith(".json"), "Json")))
    return trees.paths_of_texts(f, "content", "language", ["file_id"]).groupBy("file_id").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("path").alias("paths"))


@query("""with h as (select repository, doc_id, case when contains(lower(text), 'grammar') then doc_id end as hit from documents)
select repository, doc_id, coalesce(min(hit) over (partition by repository order by doc_id rows between 1 following and unbounded following), min(hit) over (partition by repository)) as next from h""")
def search_matches(spark, d):
    """The next document of a repository that holds a word, from each one."""
    return review.next_matches(table(spark, d, "documents"), ["repository"], "doc_id", F.col("text"), "Grammar")


@query("""select split_part(coalesce(status, 'none') || ':' || coalesce(exit_status, ''), ':', 1) as bucket, coalesce(status, 'none') || ':' || coalesce(exit_status, '') as detail, count(*) as n from robustness_full group by 1, 2""")
def reason_buckets(spark, d):
    """Buckets and details of outcomes."""
    detail = F.concat_ws(":", F.coalesce("status", F.lit("none")), F.coalesce("exit_status", F.lit("")))
    return table(spark, d, "robustness_full").groupBy(review.reason_bucket(detail).alias("bucket"), detail.alias("detail")).agg(F.count(F.lit(1)).alias("n"))


@query()
def painted_ranges(spark, d):
    """Painted ranges of all pairs of files by side and operation."""
    return painting.painted(version_pairs(spark, d), "pair_id", "before", "after").groupBy("side", "operation").agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.col("end") - F.col("start")).alias("characters"))


@query()
def tree_copies(spark, d):
    """Statements that the other file of a pair has several times."""
    return treediff.copied_statements(version_pairs(spark, d), "pair_id", "before", "after", "language")
