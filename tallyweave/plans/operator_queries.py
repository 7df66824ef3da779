"""Tree, text, source and bookkeeping operators on tables that SQL can build too: folder trees, lines of documents, rule-made logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import languages, text
from ..operators import pairing, reports, review, sketches, trees
from ..session import table
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _folders(spark: SparkSession, d: str) -> DataFrame:
    """The folder tree of each repository as a node table: every prefix of a path of its changes, in preorder from 1."""
    paths = table(spark, d, "commit_files").filter("repository is not null and path is not null").select("repository", F.split("path", "/").alias("_p")).distinct()
    parts = paths.select("repository", "_p", F.explode(F.sequence(F.lit(0), F.size("_p"))).alias("_k")).select("repository", F.slice("_p", F.lit(1), F.col("_k")).alias("parts")).distinct()
    above = parts.select("repository", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("_k"), "parts").select("repository", F.slice("parts", F.lit(1), F.col("_k")).alias("parts"))
    sizes = above.groupBy("repository", "parts").agg(F.count(F.lit(1)).cast("int").alias("size"))
    ids = sizes.withColumn("node_id", F.row_number().over(Window.partitionBy("repository").orderBy("parts"))).withColumn("depth", F.size("parts"))
    home = ids.select("repository", F.col("parts").alias("_up"), F.col("node_id").alias("parent_id"))
    tree = ids.withColumn("_up", F.when(F.col("depth") > 0, F.slice("parts", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))))).join(home, ["repository", "_up"], "left")
    child = F.row_number().over(Window.partitionBy("repository", "parent_id").orderBy("parts")) - 1
    name = F.when(F.col("depth") > 0, F.element_at("parts", F.greatest(F.col("depth"), F.lit(1)))).otherwise(F.lit(""))
    return tree.select("repository", "node_id", F.coalesce("parent_id", F.lit(0)).alias("parent_id"), "depth", child.alias("child_idx"), "size", name.alias("text"), F.when(name.contains("."), "file").otherwise("folder").alias("kind"))


_TREE = """paths as (select distinct repository, string_split(path, '/') as p from commit_files where repository is not null and path is not null),
parts as (select distinct repository, p[1:k] as parts from paths, unnest(range(0, len(p) + 1)) as t(k)),
ids as (select repository, parts, len(parts)::int as depth, row_number() over (partition by repository order by parts) as node_id from parts),
sizes as (select a.repository, a.node_id, count(*) as size from ids a join ids b on a.repository = b.repository and b.depth >= a.depth and b.parts[1:a.depth] = a.parts group by 1, 2),
nodes as (select i.repository, i.node_id, coalesce(u.node_id, 0) as parent_id, i.depth, s.size, i.parts, case when i.depth > 0 then i.parts[i.depth] else '' end as text
  from ids i join sizes s using (repository, node_id) left join ids u on u.repository = i.repository and i.depth > 0 and u.parts = i.parts[1:i.depth - 1]),
above as (select d.repository, d.node_id, a.node_id as up, a.depth as up_depth, a.text as up_text, a.size as up_size from nodes d join nodes a on a.repository = d.repository and a.node_id < d.node_id and d.node_id < a.node_id + a.size)"""


@query(f"""with {_TREE} select n.repository, n.node_id, max(a.up) as ancestor_id from nodes n left join above a on a.repository = n.repository and a.node_id = n.node_id and a.up_depth % 2 = 0 group by 1, 2""")
def folder_ancestors(spark, d):
    """The nearest folder of even depth above every entry."""
    return trees.nearest_marked_ancestor(_folders(spark, d).withColumn("marked", F.col("depth") % 2 == 0), ["repository"], "marked")


@query(f"""with {_TREE}, gone as (select distinct repository, node_id from above where up_depth = 2 or starts_with(up_text, 't'))
select repository, node_id, row_number() over (partition by repository order by node_id) - 1 as row from nodes n
where not starts_with(text, 't') and not exists (select 1 from gone g where g.repository = n.repository and g.node_id = n.node_id)""")
def folder_rows(spark, d):
    """Rows of a tree view in which folders of the second level are closed and names with a t are hidden."""
    shown = trees.visible_rows(_folders(spark, d), ["repository"], F.col("depth") == 2, F.startswith(F.col("text"), F.lit("t")))
    return shown.select("repository", "node_id", "row")


@query(f"""with {_TREE}, state as (select *, length(text) % 5 <> 0 as decided from nodes)
select n.repository, n.node_id, bool_and(b.decided) as solved from state n join state b on b.repository = n.repository and b.node_id >= n.node_id and b.node_id < n.node_id + n.size group by 1, 2""")
def folder_solved(spark, d):
    """Whether all below an entry is decided, by a rule on names."""
    return trees.fully_solved(_folders(spark, d).withColumn("decided", F.length("text") % 5 != 0), ["repository"], "decided")


@query(f"""with {_TREE}, numbered as (select *, case when contains(text, '.') then 'file' else 'folder' end as kind from nodes),
steps as (select repository, node_id, depth, kind || ':' || row_number() over (partition by repository, parent_id, kind order by node_id) as step from numbered),
trails as (select repository, node_id, up from above union all select repository, node_id, node_id from nodes)
select t.repository, t.node_id, coalesce(string_agg(case when s.depth > 0 then s.step end, '/' order by s.depth), '') as path from trails t join steps s on s.repository = t.repository and s.node_id = t.up group by 1, 2""")
def folder_paths(spark, d):
    """The way to every entry, by kinds and places among siblings of one kind."""
    return trees.node_paths(_folders(spark, d), ["repository"])


@query(f"""with {_TREE} select repository, node_id, lag(node_id) over w as previous_id, lead(node_id) over w as next_id from nodes window w as (partition by repository, parent_id order by node_id)""")
def folder_neighbours(spark, d):
    """The siblings before and after every entry."""
    return trees.neighbours(_folders(spark, d), ["repository"]).select("repository", "node_id", "previous_id", "next_id")


@query(f"""with {_TREE} select repository, sum(case node_id % 6 when 0 then 1 when 1 then 1 when 2 then 1 when 3 then size when 4 then size else (length(text) > 4)::int end)::bigint as cost from nodes group by 1""")
def folder_costs(spark, d):
    """What a mapping costs that treats every entry by its number."""
    n = _folders(spark, d)
    op = F.element_at(F.array(*map(F.lit, ["Update", "Delete", "Insert", "DeleteWithChildren", "InsertWithChildren", "MatchButNotIdentical"])), F.col("node_id") % 6 + 1)
    after = n.withColumn("text", F.substring("text", 1, 4))
    return trees.mapping_cost(n.select("repository", F.col("node_id").alias("before_id"), F.col("node_id").alias("after_id"), op.alias("operation")), n, after, ["repository"])


@query(f"""with {_TREE}, kids as (select repository, parent_id, node_id * 7 as s, node_id * 7 + length(text) as e, lag(node_id * 7 + length(text)) over (partition by repository, parent_id order by node_id) as before from nodes where parent_id > 0),
gaps as (select repository, parent_id as node_id, sum(greatest(coalesce(s - before, 0), 0)) as gap from kids group by 1, 2)
select case when contains(text, '.') then 'file' else 'folder' end as kind, sum(gap)::bigint as gap_characters from nodes join gaps using (repository, node_id) group by 1""")
def folder_gaps(spark, d):
    """What lies between entries of one folder, if an entry takes as many places as its name is long."""
    n = _folders(spark, d).withColumn("start", F.col("node_id") * 7).withColumn("end", F.col("node_id") * 7 + F.length("text"))
    return trees.owned_gaps(n, ["repository"])


@query(f"""with {_TREE}, records as (select repository, node_id as s, node_id + size - depth % 2 as e from nodes)
select r.repository, r.s, r.e, min(n.node_id) as node_id from records r left join nodes n on n.repository = r.repository and n.node_id = r.s and n.node_id + n.size = r.e group by 1, 2, 3""")
def folder_spans(spark, d):
    """Records that name an entry by its span; every second level is off by one."""
    n = _folders(spark, d)
    records = n.select("repository", F.col("node_id").alias("s"), (F.col("node_id") + F.col("size") - F.col("depth") % 2).alias("e"))
    return reports.span_matches(records, n.select("repository", F.col("node_id").alias("s"), (F.col("node_id") + F.col("size")).alias("e"), "node_id"), ["repository"], "s", "e", "node_id")


_PREVIOUS = "previous as (select doc_id as pair_id, lag(text) over w as before, text as after from documents window w as (partition by repository, source order by doc_id)), pairs as (select * from previous where before is not null and after is not null)"
_LINES = f"""{_PREVIOUS}, sides as (select pair_id, 0 as side, string_split(before, chr(10)) as l from pairs union all select pair_id, 1, string_split(after, chr(10)) from pairs),
lines as (select pair_id, side, unnest(l) as line, unnest(range(1, len(l) + 1)) as node_id from sides)"""


def _lines(spark: SparkSession, d: str, side: str) -> DataFrame:
    pairs = pairing.with_previous(table(spark, d, "documents"), ["repository", "source"], ["doc_id"], "doc_id", "text").filter("before is not null and after is not null")
    return pairs.select("pair_id", F.posexplode(F.split(side, "\n", -1)).alias("_i", "line")).select("pair_id", (F.col("_i") + 1).alias("node_id"), "line", F.length("line").alias("size"))


@query(f"""with {_LINES}, n as (select *, row_number() over (partition by pair_id, side, line order by node_id) as k from lines where length(line) >= 3)
select b.pair_id, b.node_id as before_id, a.node_id as after_id from n b join n a on a.pair_id = b.pair_id and a.line = b.line and a.k = b.k and b.side = 0 and a.side = 1""")
def line_hash_matches(spark, d):
    """Equal lines of two documents, the n-th with the n-th, by their hashes."""
    hashed = lambda s: _lines(spark, d, s).withColumn("h", text.portable_hash(F.col("line")))
    return trees.equal_hash_matches(hashed("before"), hashed("after"), ["pair_id"], "h", 3)


@query(f"""with {_LINES}, one as (select pair_id, side, line, min(node_id) as node_id from lines group by 1, 2, 3 having count(*) = 1)
select b.pair_id, b.line, b.node_id as before_id, a.node_id as after_id from one b join one a on a.pair_id = b.pair_id and a.line = b.line and b.side = 0 and a.side = 1""")
def line_unique_keys(spark, d):
    """Lines that are alone of their text in both documents."""
    return trees.unique_key_matches(_lines(spark, d, "before"), _lines(spark, d, "after"), ["pair_id", "line"], "node_id")


@query(f"""with {_LINES}, n as (select *, row_number() over (partition by pair_id, side, line order by node_id) as k, count(*) over (partition by pair_id, side, line) as c from lines)
select b.pair_id, b.line, b.node_id as before_id, a.node_id as after_id from n b join n a on a.pair_id = b.pair_id and a.line = b.line and a.k = b.k and a.c = b.c and b.side = 0 and a.side = 1""")
def line_equal_counts(spark, d):
    """Equal lines, where both documents have equally many of them."""
    return trees.equal_count_zip(_lines(spark, d, "before"), _lines(spark, d, "after"), ["pair_id", "line"], "node_id", "node_id")


@query(f"""with {_LINES}, o as (select pair_id, side, node_id, 'deleted' as v from lines where length(line) % 3 = 0), t as (select pair_id, side, node_id, 'deleted' as v from lines where length(line) % 2 = 0)
select coalesce(o.v, 'unchanged') as ours, coalesce(t.v, 'unchanged') as theirs, count(*) as lines from o full join t using (pair_id, side, node_id) group by 1, 2""")
def line_verdict_agreement(spark, d):
    """Two tools' verdicts per line, either by a rule on its length."""
    whole = _lines(spark, d, "before").withColumn("side", F.lit(0)).unionByName(_lines(spark, d, "after").withColumn("side", F.lit(1)))
    tool = lambda n: whole.filter(F.col("size") % n == 0).select("pair_id", "side", "node_id", F.lit("deleted").alias("v"))
    return reports.line_verdicts(tool(3), tool(2), ["pair_id", "side", "node_id"], "v").groupBy("ours", "theirs").agg(F.count(F.lit(1)).alias("lines"))


@query(f"""with {_LINES} select sum(length(regexp_extract(line, '^[ \\t]*')))::bigint as leading, sum(length(regexp_extract(line, '[ \\t]*$')))::bigint as trailing, sum(length(replace(line, chr(9), '    ')) +
  length(regexp_replace(line, '[^\\x{{1100}}-\\x{{115F}}\\x{{2E80}}-\\x{{A4CF}}\\x{{AC00}}-\\x{{D7A3}}\\x{{F900}}-\\x{{FAFF}}\\x{{FE30}}-\\x{{FE6F}}\\x{{FF00}}-\\x{{FF60}}\\x{{FFE0}}-\\x{{FFE6}}\\x{{1F300}}-\\x{{1FAFF}}]', '', 'g')))::bigint as width from lines""")
def line_widths(spark, d):
    """Blanks at both ends of lines, and how wide they are with four blanks for a tab."""
    line = F.col("line")
    whole = _lines(spark, d, "before").unionByName(_lines(spark, d, "after"))
    return whole.agg(F.sum(text.leading_blanks(line)).alias("leading"), F.sum(text.trailing_blanks(line)).alias("trailing"), F.sum(text.display_width(F.replace(line, F.lit("\t"), F.lit("    ")))).alias("width"))


@query(f"""with {_PREVIOUS}, c as (select greatest(len(string_split(before, chr(10))), len(string_split(after, chr(10)))) as n from pairs)
select case when n < 10 then '0-10' when n < 30 then '10-30' when n < 100 then '30-100' when n < 300 then '100-300' when n < 1000 then '300-1000' when n < 3000 then '1000-3000' else '3000+' end as bucket, count(*) as pairs from c group by 1""")
def pair_buckets(spark, d):
    """Pairs of documents by the lines of the longer one."""
    pairs = pairing.with_previous(table(spark, d, "documents"), ["repository", "source"], ["doc_id"], "doc_id", "text").filter("before is not null and after is not null")
    return pairs.groupBy(text.pair_bucket(text.lines_split(F.col("before")), text.lines_split(F.col("after"))).alias("bucket")).agg(F.count(F.lit(1)).alias("pairs"))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"


@query(f"""with {_PREVIOUS} select pair_id, not list_has_any({_WORDS.format("before")}, {_WORDS.format("after")}) as apart from pairs""")
def disjoint_pairs(spark, d):
    """Whether a document shares no word with the one before it."""
    pairs = pairing.with_previous(table(spark, d, "documents"), ["repository", "source"], ["doc_id"], "doc_id", "text").filter("before is not null and after is not null")
    return pairs.select("pair_id", text.shares_no_word(F.col("before"), F.col("after")).alias("apart"))


@query("""select file_id, previous_id from (select file_id, lag(file_id) over (partition by repository, language order by path nulls first, file_id) as previous_id from file_contents) where previous_id is not null""")
def previous_files(spark, d):
    """The file before every file in its repository and language."""
    return pairing.previous_ids(table(spark, d, "file_contents"), ["repository", "language"], ["path", "file_id"], "file_id")


@query("""with l as (select repository, "commit" as c, path, old_path, length(path) as n from commit_files where path is not null)
select repository, path, case when old_path is not null and n % 3 <> 0 then old_path else path end as old_path, case when n % 4 <> 0 then n end as added, case when n % 4 <> 0 then n // 2 end as removed, count(*) as n from l group by all""")
def numstat_rows(spark, d):
    """Numstat lines written from the changes of commits and read again: renames, and `-` for binary files."""
    c = table(spark, d, "commit_files").filter("path is not null")
    n = F.length("path")
    count = lambda x: F.when(n % 4 != 0, x.cast("string")).otherwise("-")
    name = F.when(F.col("old_path").isNotNull() & (n % 3 != 0), F.concat("old_path", F.lit(" => "), "path")).otherwise(F.col("path"))
    lines = c.select("repository", F.concat_ws("\t", count(n), count(F.floor(n / 2)), name).alias("line"))
    return files.numstat(lines, "line", ["repository"]).groupBy("repository", "path", F.coalesce("old_path", "path").alias("old_path"), "added", "removed").agg(F.count(F.lit(1)).alias("n"))


@query("""with c as (select repository, "commit", path, length(path) as n, length("commit") % 3 as parents from commit_files where path is not null)
select repository, count(*) as edits, sum(n)::bigint as added from c where n % 4 <> 0 and not exists (select 1 from commits m where m.repository = c.repository and m."commit" = c."commit" and m.n_files = 1)
  and exists (select 1 from commits m where m.repository = c.repository and m."commit" = c."commit" and coalesce(m.n_files, 1) % 3 <= 1) group by 1""")
def commit_edits(spark, d):
    """Numstat rows of commits that merge nothing and aren't at the boundary; parents and boundary by a rule on their numbers of files."""
    c = table(spark, d, "commit_files").filter("path is not null")
    n = F.length("path")
    count = F.when(n % 4 != 0, n.cast("string")).otherwise("-")
    rows = files.numstat(c.select("repository", "commit", F.concat_ws("\t", count, count, "path").alias("line")), "line", ["repository", "commit"])
    commits = table(spark, d, "commits").select("repository", "commit", (F.coalesce("n_files", F.lit(1)) % 3).alias("parents"), "n_files")
    edits = files.code_edits(rows, commits, ["repository", "commit"], "parents", commits.filter("n_files = 1").distinct())
    return edits.groupBy("repository").agg(F.count(F.lit(1)).alias("edits"), F.sum("added").cast("bigint").alias("added"))


@query("""with p as (select distinct path from commit_files where path is not null), b as (select path, 'b' || length(path) || path[1:12] as blob from p where length(path) % 7 <> 0),
a as (select case when length(path) % 5 = 0 then 'moved/' || path else path end as path, 'b' || length(path) || path[1:12] || case when length(path) % 11 = 0 then 'x' else '' end as blob from p where length(path) % 13 <> 0),
s as (select coalesce(a.path, b.path) as path, b.blob as bb, a.blob as ab from b full join a on a.path = b.path where a.blob is distinct from b.blob),
g as (select coalesce(ab, bb) as blob, count_if(bb is null) as new, count_if(ab is null) as old, max(case when bb is null then path end) as path, max(case when ab is null then path end) as old_path from s where bb is null or ab is null group by 1),
r as (select * from g where new = 1 and old = 1)
select 'R' as change_type, path, old_path from r union all
select case when bb is null then 'A' when ab is null then 'D' else 'M' end, path, null from s where (bb is not null and ab is not null) or coalesce(ab, bb) not in (select blob from r)""")
def snapshot_renames(spark, d):
    """Two snapshots of paths, the second one made by rule: added, deleted, changed and renamed ones."""
    p = table(spark, d, "commit_files").filter("path is not null").select("path").distinct()
    n = F.length("path")
    blob = F.concat(F.lit("b"), n.cast("string"), F.substring("path", 1, 12))
    before = p.filter(n % 7 != 0).select("path", blob.alias("blob"))
    after = p.filter(n % 13 != 0).select(F.when(n % 5 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.concat(blob, F.when(n % 11 == 0, "x").otherwise("")).alias("blob"))
    return files.snapshot_delta(before, after, "path", "blob")


@query("""select doc_id, case when doc_id % 4 in (0, 1) then md5(text) end as content, doc_id % 4 = 3 as is_binary from documents where text is not null and text <> ''""")
def decoded_documents(spark, d):
    """Documents as bytes of four kinds, read as text again: UTF-8, UTF-16 with a mark, broken UTF-8, with a zero byte."""
    docs = table(spark, d, "documents").filter("text is not null and text <> ''")
    utf8 = F.encode("text", "UTF-8")
    kind = F.col("doc_id") % 4
    raw = (
        F.when(kind == 0, utf8)
        .when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(kind == 2, F.concat(utf8, F.unhex(F.lit("FC"))))
        .otherwise(F.concat(F.unhex(F.lit("6100")), utf8))
    )
    made = docs.select("doc_id", raw.alias("raw"))
    return made.select("doc_id", F.md5(files.decoded_text(F.col("raw"))).alias("content"), files.is_binary(F.col("raw")).alias("is_binary"))


@query("""select candidate_id, repository, path from candidates qualify row_number() over (partition by repository, language order by candidate_id) <= 4""")
def capped_candidates(spark, d):
    """Four candidates of each repository and language."""
    return reports.capped(table(spark, d, "candidates"), "repository", "language", [F.col("candidate_id")]).select("candidate_id", "repository", "path")


@query("""with o as (select candidate_id, (row_number() over (order by sampled_at nulls first, candidate_id) - 1) % 7 as shard from candidates) select shard::int as shard, count(*) as n, sum(candidate_id)::bigint as total from o group by 1""")
def round_robin_shards(spark, d):
    """Candidates in the order of their time, dealt to seven shards in turn."""
    dealt = reports.round_robin(table(spark, d, "candidates").select("candidate_id", "sampled_at"), ["sampled_at", "candidate_id"], 7)
    return dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("candidate_id").alias("total"))


@query("""with e as (select path, lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) as e, lower(regexp_extract(path, '([^/\\\\]+)$', 1)) as base from candidates), l as (select case
 when base in ('makefile', 'gnumakefile') then 'Make' when base in ('dockerfile', 'containerfile') then 'Docker' when base = 'cmakelists.txt' then 'CMake' when base in ('build', 'build.bazel', 'workspace') then 'Bazel'
 when e = 'rs' then 'Rust' when e in ('py', 'pyi') then 'Python' when e = 'go' then 'Go' when e = 'java' then 'Java' when e in ('js', 'mjs', 'cjs', 'jsx') then 'JavaScript' when e in ('ts', 'mts', 'cts', 'tsx') then 'TypeScript'
 when e in ('c', 'h') then 'C' when e in ('cc', 'cpp', 'cxx', 'hpp', 'hh', 'hxx') then 'Cpp' when e = 'json' then 'Json' when e in ('yaml', 'yml') then 'Yaml' when e = 'toml' then 'Toml' when e in ('md', 'markdown') then 'Markdown'
 when e in ('sh', 'bash') then 'Bash' when e = 'rb' then 'Ruby' when e in ('kt', 'kts') then 'Kotlin' when e = 'swift' then 'Swift' when e in ('html', 'htm') then 'Html' when e = 'css' then 'Css' when e = 'lua' then 'Lua' when e = 'sql' then 'Sql'
 when e = 'php' then 'Php' when e = 'cs' then 'CSharp' when e = 'scala' then 'Scala' when e = 'xml' then 'Xml' when e = 'hs' then 'Haskell' when e in ('ex', 'exs') then 'Elixir' when e = 'zig' then 'Zig' when e = 'dart' then 'Dart' when e = 'r' then 'R'
 when e = 'nix' then 'Nix' when e = 'vim' then 'Vim' end as language from e) select language, count(*) as n from l group by 1""")
def languages_of_paths(spark, d):
    """Candidates by the language that their path tells."""
    return table(spark, d, "candidates").groupBy(languages.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("""with q as (select event_type, user_id % 9 as u from events where event_id % 5 <> 0), c as (select 'case ' || u as c, count(*) as n from q where u < 7 group by 1), k as (select distinct 'case ' || user_id % 9 as c from events)
select k.c as "case", coalesce(n, 0) as waiting from k left join c using (c)""")
def queue_sizes(spark, d):
    """Entries of a review queue per case; comments and lines without sites don't count, cases without entries do."""
    e = table(spark, d, "events")
    name = F.concat(F.lit("case "), (F.col("user_id") % 9).cast("string"))
    lines = e.filter("event_id % 5 <> 0").select(F.when(F.col("user_id") % 9 == 7, F.concat(F.lit("# "), name, F.lit("\tb1"))).when(F.col("user_id") % 9 == 8, name).otherwise(F.concat_ws("\t", name, F.lit("b1 a2"), "event_type")).alias("line"))
    return review.queue_counts(review.review_queue(lines, "line"), e.select(name.alias("case")))


@query("""select 'm' || user_id % 3 as mode, event_type as key, count(*) as presses, count_if(event_id % 2 = 0) as edits, sum(event_id % 1000)::bigint as milliseconds from events group by 1, 2""")
def key_presses(spark, d):
    """A log of key presses, written from events and read again."""
    e = table(spark, d, "events")
    line = F.concat_ws("\t", (F.col("event_id") % 1000).cast("string"), F.lit("c"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")), "event_type", F.when(F.col("event_id") % 2 == 0, "1").otherwise("0"))
    return review.key_log(e.select(line.alias("line")), "line")


@query(f"""with w as (select doc_id, {_WORDS.format("text")} as w from documents where text is not null), k as (select doc_id, list_sort([('0x' || substr(md5(x), 1, 15))::bigint for x in w])[1:16] as s from w),
c as (select s, min(doc_id) as c from k where len(s) > 0 group by 1),
u as (select l.c as left_class, r.c as right_class, list_sort(list_distinct(list_concat(l.s, r.s)))[1:16] as u, l.s as a, r.s as b from c l join c r on l.c < r.c and list_has_any(l.s, r.s)),
e as (select left_class, right_class, len(list_intersect(u, list_intersect(a, b))) / len(u) as similarity from u) select * from e where similarity >= 0.7""")
def near_documents(spark, d):
    """Classes of documents of one sketch whose estimated similarity is 0.7 or more; copies are one class."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", sketches.word_sketch(text.word_set(F.col("text"))).alias("s"))
    return sketches.near_classes(docs, "doc_id", "s", 0.7)
