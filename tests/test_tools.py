import pytest
from repolith.plans.tools import Workspace


@pytest.fixture(scope="module")
def workspace(spark):
    files = spark.createDataFrame([("src/server.ts", "import './api'\nrun(1)"), ("src/api.ts", "import './user'"), ("src/user.ts", "run(2)"), ("src/lone.py", "x = 1")], "path string, content string")
    edges = spark.createDataFrame([("src/server.ts", "src/api.ts"), ("src/api.ts", "src/user.ts")], "src string, dst string")
    symbols = spark.createDataFrame([("run", "src/user.ts", "function", 1, 80)], "name string, path string, type string, start_line long, end_line long")
    calls = spark.createDataFrame([("src/server.ts", "main", "run")], "caller_file string, caller_symbol string, callee_symbol string")
    commits = spark.createDataFrame([(k, 1, 1000 + k, "fix", False) for k in range(4)], "sha long, author long, ts long, message string, is_merge boolean")
    touched = spark.createDataFrame([(k, p, 1, 1) for k in range(4) for p in ("src/user.ts", "src/lone.py")], "sha long, path string, added long, deleted long")
    vectors = spark.createDataFrame([("src/user.ts", [1.0, 0.0]), ("src/api.ts", [0.0, 1.0])], "path string, vector array<float>")
    return Workspace(files, edges, symbols, calls, commits, touched, vectors, 1003)


def test_blast_radius_joins_all_signals(workspace):
    got = {tuple(r) for r in workspace.blast_radius("src/user.ts").collect()}
    assert got == {("src/api.ts", "direct"), ("src/server.ts", "transitive"), ("src/server.ts", "symbol_caller"), ("src/lone.py", "historical")}


def test_lookups(workspace):
    assert workspace.definition("run").first().path == "src/user.ts"
    assert [r.path for r in workspace.full_text_search("/run\\(\\d/").collect()] == ["src/server.ts", "src/user.ts"]
    assert [r.path for r in workspace.search([1.0, 0.0]).collect()] == ["src/user.ts", "src/api.ts", "src/server.ts"]
    assert workspace.find_large_functions().first().n_lines == 80
    row = workspace.status().first()
    assert (row.n_files, row.n_edges, row.languages) == (4, 2, ["py", "ts"])


def test_refactor_covers_definers_importers_and_callers(workspace):
    assert {r.path for r in workspace.refactor_preview("run", "go").collect()} == {"src/server.ts", "src/user.ts"}


def test_callers_overview_and_owners(workspace):
    assert workspace.find_callers("run", "src/user.ts").count() == 0  # server.ts calls it without importing its file
    assert [r.path for r in workspace.ownership().collect()] == ["src/lone.py", "src/user.ts"]
    parts = workspace.overview()
    assert parts["status"].first().n_files == 4 and parts["hubs"].count() == 1 and parts["levels"].agg({"n": "sum"}).first()[0] == 2
    assert [(r.path, r.matches) for r in workspace.full_text_hybrid("run(", [0.0, 1.0], 3).collect()] == [("src/server.ts", 1), ("src/user.ts", 1), ("src/api.ts", 0)]


def test_responses(spark):
    from repolith.plans import responses

    full, skeleton = "x" * 400, "y" * 40
    modes = [responses.envelope("q", full, skeleton, b)["meta"]["mode"] for b in (None, 100, 99, 10, 9, 0)]
    assert modes == ["full", "full", "skeleton", "skeleton", "truncate", "error"]
    assert responses.envelope("q", full, None, 5)["data"] == "x" * 20 and responses.envelope("q", full, tokens=len)["meta"]["tokens"] == 400
    budget = responses.Budget(100, {"a": 50}, task=70)
    assert (budget.of("a"), budget.of("b"), budget.of("a", 200), responses.Budget().of("a")) == (50, 70, 70, None)
    rows = spark.createDataFrame([("p", 1), ("q", 2)], "path string, n long")
    assert responses.answer("x", rows)["data"] == '{"path": "p", "n": 1}\n{"path": "q", "n": 2}'
    assert responses.answer("x", rows, budget=2)["data"] == "p\nq"
    assert responses.at_detail(rows, "minimal").first().n == 2 and responses.at_detail(rows).count() == 2
    learned = spark.createDataFrame([("search", "definition", 5), ("search", "get_file", 9)], "from_tool string, to_tool string, n long")
    assert responses.suggested_next("search", learned) == ["get_file", "definition", "context_packet"] and responses.suggested_next("nothing") == []
    from repolith.plans.tools import Workspace

    assert all(hasattr(Workspace, name) for table in (responses.ROUTES, responses.NEXT) for names in table.values() for name in names)


def test_command_line_lists_queries(capsys):
    from repolith.__main__ import main

    assert main(["list"]) == 0 and "impact_union" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "nowhere"])


def test_impact_takes_the_first_signal(spark):
    from repolith.operators import graph

    arms = spark.createDataFrame([("a", "semantic"), ("a", "direct"), ("a", "direct"), ("b", "historical")], "path string, signal string")
    assert sorted(tuple(r) for r in graph.impact_union(arms).collect()) == [("a", "direct", "direct,semantic"), ("b", "historical", "historical")]

