"""Operators on facts: fixtures with known answers, randomised comparison, the store and the feed."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as names
from factloom.operators import dispatch, graph, temporal
from factloom.plans.store import Store
from factloom.sources import readers
from factloom.streaming.feed import follow


def edges(spark, pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


def syms(df):
    return {r.sym for r in df.collect()}


def bfs(pairs, roots):
    seen, todo = set(roots), list(roots)
    while todo:
        a = todo.pop()
        for s, d in pairs:
            if s == a and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        (["mA", "AB", "BA"], ["AB", "BA"], "m"),  # a cycle that keeps itself alive is gone
        ([], [], "m"),
        (["mm"], ["mm"], "m"),
        (["mA", "AA"], ["AA"], "m"),
        (["mA", "AB", "BC"], [], "m"),
        (["mA", "mB", "AC", "BC"], ["mB", "AC", "BC"], "mBC"),
    ],
)
def test_delete_rederive_fixtures(spark, old, new, want):
    roots = spark.createDataFrame([("m",)], "sym string")
    a, b = edges(spark, old), edges(spark, new)
    assert syms(graph.delete_rederive(a, b, roots, graph.reachable(a, roots))) == set(want) == syms(graph.reachable(b, roots))


def test_delete_rederive_random(spark):
    rng = random.Random(9)
    for _ in range(4):
        nodes = [f"n{i}" for i in range(12)]
        make = lambda: {(a, b) for a in nodes for b in nodes if rng.random() < 0.12}  # noqa: B023, E731
        old = make()
        new = {e for e in old if rng.random() < 0.7} | {e for e in make() if rng.random() < 0.2}
        before, after = ["n0", "n1"], ["n1", "n2"]
        link = lambda e, r: edges(spark, [*e, *(("root", x) for x in r)])  # noqa: E731  entries as edges from a root, so they may change
        root = spark.createDataFrame([("root",)], "sym string")
        got = graph.delete_rederive(link(old, before), link(new, after), root, graph.reachable(link(old, before), root))
        assert syms(got) - {"root"} == bfs(new, after)


@pytest.mark.parametrize(
    ("given", "roots", "want"),
    [
        ("AdB BdC CdD", "A", {"B": (1, 1), "C": (2, 1), "D": (3, 1)}),
        ("AdB BiC CdD", "A", {"B": (1, 1), "C": (2, 0), "D": (3, 0)}),
        ("AdA AdB", "A", {"B": (1, 1)}),
        ("AdB BdC CdA", "A", {"B": (1, 1), "C": (2, 1)}),
        ("AdB XiY BdY", "AX", {"B": (1, 1), "Y": (1, 0)}),
        ("AiD AdB BdD", "A", {"D": (1, 0), "B": (1, 1)}),
    ],
)
def test_weakest_link(spark, given, roots, want):
    e = spark.createDataFrame([(x[0], x[2], int(x[1] == "d")) for x in given.split()], "src string, dst string, rnk int")
    out = graph.weakest_link(e, spark.createDataFrame([(r,) for r in roots], "sym string"))
    assert {r.sym: (r.depth, r.rnk) for r in out.collect()} == want


def test_scd2_and_as_of(spark):
    rel = spark.createDataFrame([], "key string, value string, valid_from long, valid_to long")
    for seq, rows in enumerate([[("m", "1")], [("m", "1"), ("n", "9")], [("m", "2")]]):
        rel = temporal.scd2_apply(rel, spark.createDataFrame(rows, "key string, value string"), "key", "value", seq, close_missing=True)
    got = {tuple(r) for r in rel.collect()}
    assert got == {("m", "1", 0, 2), ("m", "2", 2, None), ("n", "9", 1, 2)}
    assert {r.key for r in temporal.as_of(rel, 1).collect()} == {"m", "n"} and {r.value for r in temporal.live(rel).collect()} == {"2"}


def test_store_is_atomic_and_resumes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(1,)], "x int")
    assert store.resume_from() == 0 and store.apply_delta(0, "f0", lambda s: {"t": rows})
    with pytest.raises(ValueError, match="boom"):
        store.apply_delta(1, "f1", lambda s: (_ for _ in ()).throw(ValueError("boom")))
    assert store.resume_from() == 1 and not store.apply_delta(0, "f0", lambda s: {"t": rows.limit(0)})
    assert store.apply_delta(1, "f1", lambda s: {}, skipped="type_errors") and store.manifest["skipped"] == [[1, "type_errors"]]
    assert store.table("t").count() == 1 and store.resume_from() == 2


def test_feed(spark, tmp_path):
    for seq, rows in enumerate([[("a", "1"), ("b", "1")], [("a", "2")], [("a", "2"), ("c", "3")]]):
        spark.createDataFrame([(seq, *r) for r in rows], "seq long, key string, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):  # the second run finds nothing new
        follow(spark, str(tmp_path / "in"), "seq long, key string, value string", store, str(tmp_path / "c"), "key", "value")
    assert {tuple(r) for r in store.table("versions").collect()} == {("a", "1", 0, 1), ("b", "1", 0, 1), ("a", "2", 1, None), ("c", "3", 2, None)}


def test_diff_text_to_symbols(spark):
    patch = "diff --git a/x.go b/x.go\n--- a/x.go\n+++ b/x.go\n@@ -1,2 +31,4 @@ f\n+a\n@@ -9 +56 @@\n@@ -9 +90,0 @@\n@@ bad\n+++ b/README.md\n@@ -1 +1,3 @@\n"
    hunks = readers.diff_hunks(spark.createDataFrame([(1, patch)], "patch_id int, text string"))
    assert {(r.path, r.h_start, r.h_end) for r in hunks.collect()} == {("x.go", 31, 34), ("x.go", 56, 56), ("x.go", 90, 90)}
    symbols = spark.createDataFrame([("x.go", "Debit", 30, 35), ("x.go", "Credit", 37, 40), ("x.go", "Get", 56, 60)], "path string, symbol string, line_start int, line_end int")
    assert {r.symbol for r in dispatch.overlaps(symbols, hunks).collect()} == {"Debit", "Get"}


@pytest.mark.parametrize("lines", [1, 7, 4096])
def test_overlaps_equal_all_pairs(spark, lines):
    """Long and short ranges, ties, repeats, nulls, turned-round ranges, and a path that holds most rows."""
    rng = random.Random(lines)

    def ranges(n, width):
        for k in range(n):
            a = rng.randrange(-5, 120)
            yield rng.choice(["hot", "hot", "b", None]), k, rng.choice([a] * 9 + [None]), rng.choice([a + rng.randrange(-1, width)] * 9 + [None])

    symbols, hunks = [*ranges(150, 12)] * 2, [(p, a, b) for p, _, a, b in ranges(25, 30)]
    got = dispatch.overlaps(
        spark.createDataFrame(symbols, "path string, symbol long, line_start long, line_end long"), spark.createDataFrame(hunks, "path string, h_start long, h_end long"), lines
    ).collect()
    want = {(p, k) for p, k, a, b in symbols for q, c, d in hunks if None not in (p, a, b, c, d) and p == q and c <= b and d >= a}
    assert sorted(map(tuple, got)) == sorted(want) and 20 < len(want) < 130
    none = spark.createDataFrame([], "path string, h_start long, h_end long")
    assert dispatch.overlaps(spark.createDataFrame(symbols, "path string, symbol long, line_start long, line_end long"), none, lines).count() == 0


def test_modules_and_commits(spark):
    text = "module example.com/m\n\nrequire a.org/x v1.2.3\nrequire (\n\tb.org/y v0.1.0 // indirect\n\tc.org/z v2.0.0\n)\n"
    got = readers.required_modules(spark.createDataFrame([(1, text)], "id int, text string")).collect()
    assert {(r.module, r.path, r.version) for r in got} == {("example.com/m", p, v) for p, v in (("a.org/x", "v1.2.3"), ("b.org/y", "v0.1.0"), ("c.org/z", "v2.0.0"))}
    log = readers.linearize(spark.createDataFrame([("r", 5, "a"), ("r", 7, "b")], "repo string, pos int, commit_hash string"))
    assert {tuple(r) for r in log.collect()} == {("r", 0, "a", None), ("r", 1, "b", "a")}


def test_symbol_table_and_names(spark, tmp_path):
    (tmp_path / "t.json").write_text(
        '{"module_path":"m","files":[{"file_path":"a.go","package":"p","import_path":"m/p","defined":[{"name":"F","qualified_name":"m/p.F","kind":"function","package":"p","lines":{"start":1,"end":2}}],'
        '"references":[{"caller":"m/p.F","callee":"m/p.I.Do","kind":"interface_resolved","line":2}]}]}'
    )
    tables = readers.symbol_tables(spark, str(tmp_path / "t.json"))
    assert [r.qualified_name for r in readers.defined_symbols(tables).collect()] == ["m/p.F"]
    iface, method = names.split_callee(F.col("callee"))
    target = names.dispatch_target(F.lit("m/p.T"), method)
    row = readers.call_references(tables).select(iface.alias("i"), method.alias("m"), target.alias("t"), names.exported(F.lit("m/p.F")).alias("e")).first()
    assert tuple(row) == ("m/p.I", "Do", "m/p.(T).Do", True)


def test_set_hash_ignores_order_and_copies(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "a")], "g int, x string")
    h = {r.g: r.h for r in df.groupBy("g").agg(names.set_hash(F.col("x")).alias("h")).collect()}
    assert h[1] == h[2] != h[3]


def test_classify(spark):
    rows = [("a", "s", "s", "h", "h"), ("b", "s", "t", "h", "h"), ("c", "s", "s", "h", "i"), ("d", None, "s", None, "i"), ("e", "s", None, "h", None)]
    out = dispatch.classify(spark.createDataFrame(rows, "symbol string, sig_before string, sig_after string, hash_before string, hash_after string"))
    assert {r.symbol: r.change for r in out.collect()} == {"a": "trivial", "b": "signature_change", "c": "logic_change", "d": "logic_change", "e": "logic_change"}


def test_gate_opens_only_with_the_constructor(spark):
    rng = random.Random(4)
    given = [[("m", "i", "I", "c"), ("m", "d", "c", None), ("I", "d", "x", None)], [("m", "i", "I", "c"), ("I", "d", "c", None)], [("m", "i", "I", None)]]
    nodes = "abcdefghij"
    given += [[("m", "d", "a", None), ("m", "d", "b", None)] + [(a, *rng.choice([("d", b, None), ("i", b, rng.choice(nodes))])) for a in nodes for b in nodes if rng.random() < 0.25] for _ in range(3)]
    for rows in given:
        rows = [(r[0], "direct_call" if r[1] == "d" else "interface_resolved", *r[2:]) for r in rows]
        seen = {"m"}
        while new := {d for s, p, d, g in rows if s in seen and (p == "direct_call" or g in seen)} - seen:
            seen |= new
        df = spark.createDataFrame(rows, "src string, prov string, dst string, gate string")
        assert syms(graph.gated_reachable(df, spark.createDataFrame([("m",)], "sym string"))) == seen


def test_withdrawal_ratios(spark):
    """A caller dispatches through two interfaces, and one of them changes: the rule by caller takes both facts."""
    facts = spark.createDataFrame([("1", "f", "A.X", "I", None), ("2", "f", "B.Y", "J", None)], "fact_id string, src string, dst string, iface string, valid_to long")
    needed = facts.where("iface = 'I'")
    derived = facts.select("fact_id", F.lit("INTERFACE").alias("input_kind"), F.col("iface").alias("input_key"), F.lit("old").alias("input_hash"))
    now = spark.createDataFrame([("INTERFACE", "I", "new"), ("INTERFACE", "J", "old")], "input_kind string, input_key string, input_hash string")
    by_caller = facts.join(needed.select("src"), "src", "left_semi")
    assert tuple(temporal.precision(by_caller, needed, ["fact_id"]).first()) == (2, 1, 0, 2.0)
    assert tuple(temporal.precision(temporal.stale(derived, now, facts), needed, ["fact_id"]).first()) == (1, 1, 0, 1.0)
    assert tuple(temporal.precision(facts.limit(0), needed, ["fact_id"]).first()) == (0, 1, 1, 0.0)


def test_vulnerable_versions(spark):
    modules = spark.createDataFrame([("a", "v1.9.0", 0, 5), ("a", "v1.10.0", 5, None), ("b", "v2.0.0-rc1", 0, None)], "module string, version string, valid_from long, valid_to long")
    rows = [("O1", "a", "v1.2.0", "v1.10.0", "s"), ("O2", "a", "v1.10.0", None, "s"), ("O3", "b", None, "v2.0.0", "s"), ("O4", "b", "v2.0.0", None, "s"), ("O5", "a", None, None, "gone")]
    advisories = spark.createDataFrame(rows, "osv_id string, module string, introduced string, fixed string, sym string")
    reached = spark.createDataFrame([("s",)], "sym string")
    at = lambda seq: {r.osv_id for r in temporal.vulnerable(reached, modules, advisories, seq).collect()}
    assert at(4) == {"O1", "O3"} and at(5) == {"O2", "O3"}


def test_impact_paths(spark):
    given = spark.createDataFrame([("A", "B", 1), ("A", "C", 0), ("B", "D", 1), ("C", "D", 1), ("D", "A", 1), ("A", "E", 1), ("E", "D", 1)], "src string, dst string, rnk int")
    out = graph.impact_paths(given, spark.createDataFrame([("A",)], "sym string"))
    assert {r.sym: (r.depth, r.rnk, "".join(r.path)) for r in out.collect()} == {"B": (1, 1, "AB"), "C": (1, 0, "AC"), "E": (1, 1, "AE"), "D": (2, 1, "ABD")}
