"""Edit distance with its mapping, repairs of tree diffs, checks of painting, rows before rows, near classes."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.operators import conventions, pairing, reports, review, sketches
from tallyweave.operators import treediff as D
from tallyweave.operators import treedistance as E
from tallyweave.operators import trees as T


def any_tree(rng, n):
    tree = T.Tree()
    tree.add("unit", "", 0, 0, 0)
    while len(tree) < n:
        # preorder: a new node hangs from the last one or one of its ancestors
        home = len(tree)
        for _ in range(rng.randrange(3)):
            home = tree.parent[home] or home
        tree.add(rng.choice("pq"), rng.choice("xy"), home, 0, 0)
    return tree.finish()


def test_exact_mapping_against_the_oracle():
    rng = random.Random(4)
    for _ in range(200):
        a, b = any_tree(rng, rng.randrange(1, 9)), any_tree(rng, rng.randrange(1, 9))
        cost, pairs = E.exact_mapping(a, range(1, len(a) + 1), b, range(1, len(b) + 1))
        # by definition: dropped and new nodes cost 1, renamed ones 1; pairs keep order and ancestors
        paid = len(a) + len(b) - 2 * len(pairs) + sum(E._pair_cost(a, x, b, y) for x, y in pairs)
        assert paid == cost >= D.edit_distance(a, b)
        for x, y in pairs:
            for p, q in pairs:
                assert (x < p) == (y < q) and (p in a.inside(x)) == (q in b.inside(y))


def test_least_cost_by_trying_all_mappings():
    rng = random.Random(7)

    def brute(a, b):
        best = [len(a) + len(b)]

        def go(x, pairs, cost):
            if x > len(a):
                best[0] = min(best[0], cost)
                return
            go(x + 1, pairs, cost)
            for y in range(1, len(b) + 1):
                c = E._pair_cost(a, x, b, y)
                if c < E.APART and all(q < y and (x in a.inside(p)) == (y in b.inside(q)) for p, q in pairs):
                    go(x + 1, [*pairs, (x, y)], cost - 2 + c)

        go(1, [], len(a) + len(b))
        return best[0]

    for _ in range(80):
        a, b = any_tree(rng, rng.randrange(1, 6)), any_tree(rng, rng.randrange(1, 6))
        assert E.exact_mapping(a, range(1, len(a) + 1), b, range(1, len(b) + 1))[0] == brute(a, b)


def test_large_forests_are_cut_but_whole():
    a, b = (T.token_tree("\n".join(f"call_{i % 7}({i}, {k});" for i in range(400))) for k in (1, 2))
    pairs = E.bounded_mapping(a, range(1, len(a) + 1), b, range(1, len(b) + 1))
    assert len(pairs) == len(a) and all(x == y for x, y in pairs)


def solved(before, after):
    d = D.PairDiff(T.token_tree(before), T.token_tree(after))
    for name in D.PairDiff.PASSES:
        getattr(d, name)()
    return d


def test_a_wrapped_body_pairs_with_the_outer_one():
    d = solved("fn run(a) {\n load(a, 1);\n store(a, 2);\n close(a);\n}\n", "fn run(a) {\n try {\n  load(a, 1);\n  store(a, 2);\n  close(a);\n }\n}\n")
    body = next(n for n in range(1, len(d.a) + 1) if d.a.kind[n] == "braces")
    outer = next(n for n in range(1, len(d.b) + 1) if d.b.kind[n] == "braces")
    assert d.to[body] == outer and "WrappedBlock" in d.why.values()
    assert sum(d.b.depth[d.to[x]] - d.a.depth[x] == 2 for x in d.a.children[body]) == 3


def test_collapsed_conditions():
    nested = "if (ready) {\n if (open) {\n  send(queue, 1);\n  note(queue);\n }\n}\n"
    one = "if (ready && open) {\n send(queue, 1);\n note(queue);\n}\n"
    for before, after in ((nested, one), (one, nested)):
        d = solved(before, after)
        first = [n for n in d.a.children[1]][0], [n for n in d.b.children[1]][0]
        assert d.to.get(first[0]) == first[1]
        words = [d.a.text[x] for x in d.to if d.a.text[x] in ("ready", "open")]
        assert sorted(words) == ["open", "ready"]


def test_similar_imports_and_rivals():
    d = D.PairDiff(T.token_tree("import alpha.beta.gamma;\nimport one.two;\n"), T.token_tree("import alpha.beta.delta.gamma;\nimport nine.ten;\n"))
    d.similar_imports()
    assert [d.why[x] for x in d.a.children[1] if x in d.to] == ["SimilarImport"]
    rivals = D.PairDiff(T.token_tree("import a.b.x;\nimport a.b.y;\n"), T.token_tree("import a.b.z;\n"))
    rivals.similar_imports()
    assert not rivals.to


def test_flat_containers_align_their_children():
    items = [f"name_{i} + {i}" for i in range(120)]
    d = D.PairDiff(T.token_tree("x = [" + ", ".join(items) + "]"), T.token_tree("x = [" + ", ".join([*items[:60], "odd - 1", *items[61:]]) + "]"))
    group = next(n for n in range(1, len(d.a) + 1) if d.a.kind[n] == "brackets")
    d.pair(group, group, "given")
    d.flat_containers()
    assert all(d.to[c] == e for c, e in zip(d.a.children[group], d.b.children[group], strict=True))


def test_twins_atoms_and_mutual_ancestors():
    d = D.PairDiff(T.token_tree("f(a);\nf(b);\n"), T.token_tree("g(c);\ng(d);\n"))
    d.pair(1, 1, "given")
    d.renamed_twins()
    assert [d.to[c] for c in d.a.children[1]] == d.b.children[1]
    d = D.PairDiff(T.token_tree("x + old + y;"), T.token_tree("x + new + y;"))
    for n in (1, 2, 3, 4, 6, 7, 8):
        d.pair(n, n, "given")
    d.replaced_atoms()
    assert d.why[5] == "ReplacedAtom"
    d = D.PairDiff(T.token_tree("p(q(a, b));"), T.token_tree("p(q(a, b));"))
    leaves = [n for n in range(1, len(d.a) + 1) if not d.a.children[n]]
    for n in leaves:
        d.pair(n, n, "given")
    d.mutual_ancestors()
    assert all(d.to[n] == n for n in range(1, len(d.a) + 1))


def test_repeated_statements_stay_fast_and_in_order():
    text = "call(a, b);\n" * 4000
    d = D.PairDiff(T.token_tree(text), T.token_tree("first(z);\n" + text))
    d.hash_descent()
    places = [d.to[x] for x in d.a.children[1]]
    assert len(places) == 4000 and places == sorted(places)


def test_greedy_offers_nothing_less_with_words():
    rng = random.Random(3)
    for _ in range(60):
        make = lambda: [(i, frozenset(rng.sample("abcdefgh", rng.randrange(0, 6)))) for i in range(12)]
        left, right = make(), make()
        cost = lambda p, q: 1 - len(p[1] & q[1]) / max(1, len(p[1] | q[1]))
        plain = D.greedy_assignment(left, right, lambda x: 0, cost, 0.6)
        assert D.greedy_assignment(left, right, lambda x: 0, cost, 0.6, words=lambda x: x[1]) == plain


def test_matches_in_place_equal_those_by_joins(spark, sf):
    files = spark.read.parquet(f"{sf}/file_contents.parquet")
    pairs = pairing.with_previous(files, ["repository", "language"], ["path", "file_id"], "file_id", "content", ["language"]).filter("before is not null and after is not null")
    before, after = (T.nodes(pairs, s, "language", ["pair_id"]) for s in ("before", "after"))
    joined = T.outermost(T.equal_hash_matches(before, after, ["pair_id"], "full_hash", 3), before, ["pair_id"])
    assert sorted(map(tuple, T.outermost_matches(pairs, "pair_id", "before", "after", "language", 3).collect())) == sorted(map(tuple, joined.collect()))


def test_gaps_and_paths_in_place_equal_those_of_node_tables(spark, sf):
    files = spark.read.parquet(f"{sf}/file_contents.parquet")
    nodes = T.nodes(files, "content", "language", ["file_id"])
    assert sorted(map(tuple, T.paths_of_texts(files, "content", "language", ["file_id"]).collect())) == sorted(map(tuple, T.node_paths(nodes, ["file_id"]).collect()))
    tokens = T.nodes(files.withColumn("language", F.lit(None).cast("string")), "content", "language", ["file_id"])
    assert sorted(map(tuple, T.gaps_of_texts(files, "content").collect())) == sorted(map(tuple, T.owned_gaps(tokens, ["file_id"]).collect()))
    deep = spark.createDataFrame([(1, "(" * 1500 + ")" * 1500, None)], "file_id int, content string, language string")
    assert T.paths_of_texts(deep, "content", "language", ["file_id"]).agg(F.max(F.length("path"))).first()[0] > 20_000


def test_counts_in_place_equal_those_of_node_tables(spark, sf):
    files = spark.read.parquet(f"{sf}/file_contents.parquet")
    pairs = pairing.with_previous(files, ["repository", "language"], ["path", "file_id"], "file_id", "content", ["language"]).filter("before is not null and after is not null").cache()
    mapping = D.tree_mapping(pairs, "pair_id", "before", "after", "language").cache()
    before, after = (T.nodes(pairs, s, "language", ["pair_id"]).cache() for s in ("before", "after"))
    joined = review.node_status(mapping, ["pair_id"], "before").join(before.select("pair_id", "node_id", "kind"), ["pair_id", "node_id"]).groupBy("kind", "status").count()
    assert sorted(map(tuple, conventions.status_counts(pairs, "before", "after", "language").collect())) == sorted(map(tuple, joined.collect()))
    own = {r.pair_id: r.cost for r in mapping.groupBy("pair_id").agg(F.sum("cost").alias("cost")).collect()}
    assert own == {r.pair_id: r.cost for r in T.mapping_cost(mapping, before, after, ["pair_id"]).collect()}


def test_previous_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", None]), rng.choice(["x", None]), rng.randrange(20)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, g string, h string, o int").repartition(7)
    got = {r.id: r.previous_id for r in pairing.previous_ids(df, ["g", "h"], ["o"], "id").collect()}
    want = {}
    for key in {(g, h) for _, g, h, _ in rows}:
        line = [i for i, g, h, o in sorted(rows, key=lambda r: (r[3], r[0])) if (g, h) == key]
        want |= dict(zip(line[1:], line, strict=False))
    assert got == want
    assert pairing.previous_ids(df.limit(0), ["g"], ["o"], "id").count() == 0


def test_brackets_and_leaves(spark):
    rows = [("f(a);\ng(b);\n", "f(a);\n\ng(c, d);\n"), ("(", "x"), (None, "x")]
    df = spark.createDataFrame([(*r, None) for r in rows], "b string, a string, language string")
    fates = {(r.side, r.open_fate, r.close_fate): r.groups for r in conventions.bracket_fates(df, "b", "a").collect()}
    assert fates[("before", "kept", "kept")] == 2 and sum(n for (side, o, c), n in fates.items() if c == "missing") == 1
    leaves = {tuple(r)[:5]: r.leaves for r in conventions.leaf_conventions(df, "b", "a", "language").collect()}
    assert leaves[(False, False, False, True, False)] >= 3 and any(k[0] for k in leaves)
    costs = {r["without"]: r.cost for r in conventions.ablation_costs(df, "b", "a", "language", ["none", "residual"]).collect()}
    assert 0 < costs["none"] <= costs["residual"]
    with pytest.raises(ValueError):
        conventions.ablation_costs(df, "b", "a", "language", ["nothing"])


def test_ablations_share_what_is_before_the_pass_left_out(sf, monkeypatch):
    files = duckdb.sql(f"select language, lag(content) over (partition by repository, language order by path nulls first, file_id) as b, content as a from '{sf}/file_contents.parquet'").fetchall()
    pairs = [(T.parse(b, lang), T.parse(a, lang)) for lang, b, a in files[:60]] + [(T.token_tree(x), T.token_tree(y)) for x, y in [("f(a);\ng(b);\n", "g(b);\nf(a, c);\n"), ("", "x"), ("(", "")]]
    names = ["none", "hash_descent", "unique_type", "residual", "moved_subtrees", "surviving_values", "mutual_ancestors", "wrap_growth"]
    calls = []
    descent = D.PairDiff.hash_descent
    monkeypatch.setattr(D.PairDiff, "hash_descent", lambda d: calls.append(1) or descent(d))
    for b, a in pairs:
        left, right = b or T.Tree().finish(), a or T.Tree().finish()
        want = {n: sum(r[4] for r in D.diff_trees(b, a, frozenset({n}))) for n in names}
        calls.clear()
        assert D.costs_without(left, right, names) == want
        assert len(calls) <= 1


def test_near_classes_against_all_pairs(spark):
    rng = random.Random(9)
    base = [sorted(rng.sample(range(60), 22)) for _ in range(25)]
    sets = base + [sorted({*rng.sample(s, len(s) - rng.randrange(3)), *rng.sample(range(60), rng.randrange(3))}) for s in base for _ in range(3)] + [[1, 2, 3]] * 6 + [[], [1, 2, 3, 4]]
    rows = [(i, s[:16]) for i, s in enumerate(sets)] + [(999, None)]
    df = spark.createDataFrame(rows, "id bigint, s array<bigint>")
    member = {r.id: r.class_id for r in sketches.sketch_classes(df, "id", "s").collect()}
    assert 999 not in member and len({member[i] for i, s in enumerate(sets) if s == [1, 2, 3]}) == 1
    named = {member[i]: set(s[:16]) for i, s in enumerate(sets)}

    def estimate(a, b):
        union = sorted(a | b)[:16]
        return len([x for x in union if x in a and x in b]) / len(union) if union else 0

    for least in (0.5, 0.8):
        got = {(r.left_class, r.right_class): r.similarity for r in sketches.near_classes(df, "id", "s", least).collect()}
        want = {(p, q): estimate(named[p], named[q]) for p in named for q in named if p < q and named[p] and named[q] and estimate(named[p], named[q]) >= least - 1e-12}
        assert got == pytest.approx(want)


def test_near_classes_write_no_candidates(spark):
    rng = random.Random(4)
    # Nearly every pair shares a rare hash; in every second sketch all hashes fall on one bit.
    sets = [sorted(v * (64 if i % 2 else 1000003) for v in rng.sample(range(30), 16)) for i in range(500)]
    df = spark.createDataFrame([(f"{i:04}", s) for i, s in enumerate(sets)], "id string, s array<bigint>")
    found = sketches.near_classes(df, "id", "s", 0.6)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i, a in enumerate(map(set, sets)):
        for j in range(i + 1, len(sets)):
            n = len(a.intersection(sets[j], sorted(a.union(sets[j]))[:16]))
            if n >= 0.6 * 16 and sets[i] != sets[j]:
                want[f"{i:04}", f"{j:04}"] = n / 16
    got = [tuple(r) for r in found.collect()]
    assert len(want) > 1000 and sorted(got) == sorted((*k, v) for k, v in want.items())


def test_word_sketches(spark):
    df = spark.createDataFrame([(" ".join(f"w{k * i}" for k in range(40)),) for i in range(5)] + [("",), (None,)], "t string")
    words = text.word_set(F.col("t"))
    rows = df.select(sketches.word_sketch(words).alias("a"), sketches.sketch_of(F.transform(words, text.portable_hash)).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and len(rows[1].a) == 16


def test_verdicts_spans_caps_and_numbers(spark):
    ours = spark.createDataFrame([("a", "before", 1, "deleted"), ("a", "after", 2, "inserted")], "k string, side string, row int, v string")
    theirs = spark.createDataFrame([("a", "before", 1, "deleted"), ("a", "before", 3, "moved")], "k string, side string, row int, v string")
    got = {(r.side, r.row): (r.ours, r.theirs, r.agree) for r in reports.line_verdicts(ours, theirs, ["k", "side", "row"], "v").collect()}
    assert got == {("before", 1): ("deleted", "deleted", True), ("after", 2): ("inserted", "unchanged", False), ("before", 3): ("unchanged", "moved", False)}
    nodes = spark.createDataFrame([("a", 0, 9, 1), ("a", 0, 9, 2), ("a", 3, 4, 5)], "k string, s int, e int, n int")
    records = spark.createDataFrame([("a", 0, 9, "x"), ("a", 1, 2, "y")], "k string, s int, e int, label string")
    assert {r.label: r.n for r in reports.span_matches(records, nodes, ["k"], "s", "e", "n").collect()} == {"x": 1, "y": None}
    many = spark.createDataFrame([("r", "f", i) for i in range(9)] + [("q", "f", 1)], "r string, f string, i int")
    assert {(r.r, r.i) for r in reports.capped(many, "r", "f", [F.col("i")]).collect()} == {("r", 0), ("r", 1), ("r", 2), ("r", 3), ("q", 1)}
    names = spark.createDataFrame([(x,) for x in ["v10", "v9", "V1", "a2b10", "a2b9", "a02b1", "9"]], "x string")
    assert [r.x for r in reports.in_number_order(names, "x", []).collect()] == ["9", "a02b1", "a2b9", "a2b10", "V1", "v9", "v10"]
    dealt = reports.round_robin(spark.range(1000).select(F.col("id"), (-F.col("id")).alias("o")), ["o"], 7)
    assert {r.id: r.shard for r in dealt.collect()} == {i: (999 - i) % 7 for i in range(1000)}
