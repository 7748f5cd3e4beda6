"""Symbol tables, snapshots, reports and the analyzer's version."""

import json

import pytest

from factloom.operators import derive, reports
from factloom.plans import version
from factloom.plans.snapshots import Snapshots
from factloom.sources import readers


def symbol(name, kind, receiver=None, methods=None):
    return {"name": name, "qualified_name": f"m/p.{name}", "kind": kind, "package": "p", "receiver_type": receiver, "method_set": methods}


def test_a_broken_table_is_kept_apart(spark, tmp_path):
    defined = [symbol("Shape", "interface", methods=["Area", "Name"]), symbol("Square", "type"), symbol("Area", "method", "*Square"), symbol("Name", "method", "Square"), symbol("Area", "method", "Disc")]
    references = [{"caller": "m/p.F", "callee": "m/p.G", "kind": k, "line": i} for i, k in enumerate(("direct_call", "interface_resolved", "type_use"))]
    files = [{"file_path": "p/a.go", "package": "p", "import_path": "m/p", "defined": defined, "references": references}]
    (tmp_path / "good.json").write_text(json.dumps({"module_path": "m", "files": files}))
    (tmp_path / "bad.json").write_text('{"module_path": "m", "files": [')
    every = readers.parsed_tables(spark, str(tmp_path)).collect()
    assert {r.table_path.rsplit("/", 1)[1]: r.broken is None for r in every} == {"good.json": True, "bad.json": False}
    tables = readers.symbol_tables(spark, str(tmp_path))
    made = readers.defined_symbols(tables)
    types, asked = readers.type_methods(made), readers.interfaces(made)
    assert {r.type: r.methods for r in types.collect()} == {"m/p.Square": ["Area", "Name"], "m/p.Disc": ["Area"]}
    assert [(r.type, r.iface) for r in derive.implementers(types, asked).collect()] == [("m/p.Square", "m/p.Shape")]
    assert sorted(r.line for r in readers.direct_and_dispatched(readers.call_references(tables)).collect()) == [0, 1]


def test_snapshots(spark, tmp_path):
    store, rows = Snapshots(spark, str(tmp_path)), lambda *x: spark.createDataFrame([(i,) for i in x], "v int")
    store.write("edges", "a/b", "c1", rows(1, 2))
    store.write("edges", "other", "c1", rows(9))
    store.write("symbols", "a/b", "c1", rows(3))
    store.copy(["edges", "symbols"], "a/b", "c1", "c2")
    store.write("edges", "a/b", "c1", rows(5))
    got = lambda *x: sorted(r.v for r in store.read(*x).collect())
    assert got("edges", "a/b", "c2") == [1, 2] and got("edges", "a/b", "c1") == [5]
    assert store.delete(["edges", "symbols"], "a/b", "c1") == 2 and store.delete(["edges", "symbols"], "a/b", "c1") == 0
    assert store.read("edges", "a/b", "c1") is None and got("symbols", "a/b", "c2") == [3] and got("edges", "other", "c1") == [9]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "k int, v string")
    assert sorted(r.json for r in reports.as_json(rows, "k", "v").collect()) == ['{"k":1,"v":["a","b"]}', '{"k":2,"v":[]}']
    for pretty in (False, True):
        reports.write_json(rows.where("v = 'a'"), str(tmp_path / str(pretty)), pretty)
        assert json.loads("".join(r.value for r in spark.read.text(str(tmp_path / str(pretty))).collect())) == {"k": 1, "v": "a"}
    commits = spark.createDataFrame([("abc1",), ("abd2",)], "commit_hash string")
    assert reports.resolve_commit(commits, " ABC") == "abc1"
    for prefix, error in (("ab", LookupError), ("ff", LookupError), ("main", ValueError), ("", ValueError)):
        with pytest.raises(error):
            reports.resolve_commit(commits, prefix)
    runs = spark.createDataFrame([(True, 10.0, 2.0), (True, 9.0, 0.0), (False, 8.0, 1.0)], "passed boolean, full_ms double, incremental_ms double")
    assert reports.average_speedup(runs).first().speedup == 5.0 and reports.average_speedup(runs.limit(0)).first().speedup is None


def test_the_analyzer_version_follows_the_sources(tmp_path):
    assert version.digest({"b": b"1", "a": b"2"}) == version.digest({"a": b"2", "b": b"1"}) != version.digest({"a": b"1", "b": b"2"})
    (tmp_path / "operators").mkdir()
    (tmp_path / "operators" / "x.py").write_text("a")
    (tmp_path / "schemas.py").write_text("b")
    before = version.analyzer_version(tmp_path)
    (tmp_path / "other.py").write_text("c")
    assert version.analyzer_version(tmp_path) == before
    (tmp_path / "operators" / "x.py").write_text("aa")
    assert version.analyzer_version(tmp_path) != before and len(version.analyzer_version()) == 64
