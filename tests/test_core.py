import json

import pytest

from lodestone.operators import findings as fi
from lodestone.operators import graph
from lodestone.plans import registry
from lodestone.sources import reports, text
from oracle import differences, oracle_connection


@pytest.fixture(scope="module")
def con(sf):
    return oracle_connection(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, sf, con, name):
    assert differences(spark, con, name, registry.QUERIES[name], registry.ORACLES[name], sf) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["rule_id", "severity", "section", "path", "line", "message", "fingerprint"]


def test_glob():
    import re

    assert re.match(text.glob_to_regex("a/**"), "a/b/c")
    assert not re.match(text.glob_to_regex("a/*"), "a/b/c")
    assert re.match(text.glob_to_regex("?.py"), "x.py")


def test_tree_and_lines(spark, tmp_path):
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist" / "x.py").write_text("no")
    (tmp_path / "a.py").write_text("one\ntwo\n")
    files = text.files_from_tree(spark, str(tmp_path))
    assert [(r.path, r.lang) for r in files.collect()] == [("a.py", "py")]
    assert [(r.line, r.line_text) for r in text.lines(files).orderBy("line").collect()] == [(1, "one"), (2, "two"), (3, "")]


def test_unified_diff(spark):
    diff = ["--- a/x", "+++ b/x", "@@ -1,2 +3,4 @@", "+a", "@@ -9 +10,0 @@", "--- a/y", "+++ b/y"]
    rows = text.unified_diff(spark.createDataFrame(list(enumerate(diff)), "ordinal long, text string")).collect()
    assert {tuple(r) for r in rows} == {("x", False, 3, 6), ("x", False, 10, 10), ("y", True, None, None)}


def test_reports(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"runs": [{"tool": {"driver": {"name": "T"}}, "results": [{"ruleId": "R1", "level": "error", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "f"}, "region": {"startLine": 4}}}]}]}]}))
    assert [tuple(r) for r in reports.sarif(spark, str(p)).collect()] == [("external.t.r1", "fail", "f", 4, None)]
    p.write_text(json.dumps([{"RuleID": "K", "File": "f", "StartLine": 2, "StartColumn": 1, "Secret": "hidden"}]))
    assert "Secret" not in reports.gitleaks(spark, str(p)).columns
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["SF:a", "DA:1,0", "DA:1,2", "SF:b", "DA:3,1"])], "report int, ordinal int, text string")
    assert {tuple(r) for r in reports.lcov(lines).collect()} == {("a", 1, 2), ("b", 3, 1)}
    bench = spark.createDataFrame([("BenchmarkA-8  100  12.5 ns/op",), ("other",)], "text string")
    assert [tuple(r) for r in reports.benchmark_output(bench).collect()] == [("BenchmarkA", 12.5)]


def test_scope_keeps_findings_without_a_path(spark):
    found = spark.createDataFrame([("r", None, None), ("r", "x", 5), ("r", "x", 9)], "rule_id string, path string, line int")
    ranges = spark.createDataFrame([("x", False, 4, 6)], "path string, all_changed boolean, lo int, hi int")
    assert {(r.path, r.line) for r in fi.in_scope(found, ranges).collect()} == {(None, None), ("x", 5)}


def test_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5)], "src int, dst int")
    assert {tuple(r) for r in graph.cycles(graph.closure(e)).collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3)}


def test_closure_never_stops_short(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(6)], "src int, dst int")
    assert graph.closure(e).count() == 21
    assert graph.closure(e, max_rounds=6).count() == 21
    with pytest.raises(RuntimeError):
        graph.closure(e, max_rounds=3)
