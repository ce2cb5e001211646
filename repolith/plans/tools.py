"""One object over an indexed repository with a method for each interactive query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.functions.predicates import ENTRY_POINT, TEST_FILE
from repolith.operators import community, extract, graph, history, risk, search
from repolith.operators.lineage import count


@dataclass(frozen=True)
class Workspace:
    """Tables of a repository: files(path, content), edges(src, dst), symbols, calls, commits, commit_files, vectors(path, vector). now: seconds."""

    files: DataFrame
    edges: DataFrame
    symbols: DataFrame
    calls: DataFrame
    commits: DataFrame
    commit_files: DataFrame
    vectors: DataFrame
    now: int

    def _paths(self, *paths: str) -> DataFrame:
        return self.files.sparkSession.createDataFrame([(p,) for p in paths], "path string")

    def _pairs(self) -> DataFrame:
        return history.cochange_pairs(self.commits, self.commit_files)

    def _calls_with_files(self) -> DataFrame:
        return graph.callee_file(self.calls, self.symbols)

    # Looking things up.

    def get_file(self, path: str) -> DataFrame:
        return self.files.where(F.col("path") == path)

    def definition(self, name: str) -> DataFrame:
        return self.symbols.where(F.col("name") == name).orderBy("path", "start_line")

    def context_packet(self, path: str) -> DataFrame:
        """The file and its direct imports, as skeletons."""
        wanted = self._paths(path).union(self.edges.where(F.col("src") == path).select("dst")).distinct()
        mine = self.files.join(wanted, "path", "left_semi")
        return extract.skeletons(mine, extract.definitions(mine))

    def search(self, q: list[float], limit: int = 10) -> DataFrame:
        query = self.files.sparkSession.createDataFrame([(0, q)], "query long, q array<float>")
        return search.hybrid_search(search.knn(self.vectors, query, limit), self.edges, limit)

    def similar_files(self, path: str, limit: int = 5) -> DataFrame:
        return search.similar_files(self.vectors, path, limit)

    def full_text_search(self, query: str, limit: int = 20) -> DataFrame:
        """A query between slashes is a regular expression."""
        regex = len(query) > 2 and query[0] == query[-1] == "/"
        return search.fulltext(self.files, query[1:-1] if regex else query, limit, regex)

    def call_graph(self, path: str, depth: int = 3, callers: bool = True) -> DataFrame:
        """By imports between files, as importers or imported ones."""
        return graph.bfs(self.edges, self._paths(path), depth, "in" if callers else "out").where("hop > 0")

    # What a change reaches.

    def blast_radius(self, *changed: str, depth: int = 3) -> DataFrame:
        """path, signal (direct, transitive, symbol caller, historical), once a signal."""
        seeds = self._paths(*changed)
        static = graph.impact_radius(self.edges, seeds, depth).select("path", "signal")
        callers = graph.symbol_callers(self.symbols, self.calls, seeds).select(F.col("caller_file").alias("path"), F.lit("symbol_caller").alias("signal"))
        past = history.coupling_arm(self._pairs(), seeds, static.select("path"), self.now).select("path", F.lit("historical").alias("signal"))
        return static.unionByName(callers).unionByName(past).join(seeds, "path", "left_anti").distinct()

    def blast_call_sites(self, *changed: str) -> DataFrame:
        return graph.call_sites(self.symbols, self.calls, self._paths(*changed))

    def detect_changes(self, *changed: str) -> DataFrame:
        return risk.change_risk(self._paths(*changed), self.edges, TEST_FILE)

    def git_coupling(self, path: str, limit: int = 10) -> DataFrame:
        return history.coupling(self._pairs(), self.now, k=limit).where(F.col("path") == path)

    def refactor_preview(self, old: str, new: str, most: int = 50) -> DataFrame:
        wanted = graph.refactor_candidates(old, self.symbols, self.edges, self.calls, most)
        return search.rename_preview(self.files.join(wanted, "path", "left_semi"), old, new)

    def apply_refactor(self, old: str, new: str, most: int = 50) -> DataFrame:
        """The new contents; writing them is up to the caller."""
        wanted = graph.refactor_candidates(old, self.symbols, self.edges, self.calls, most)
        return search.apply_rename(self.files.join(wanted, "path", "left_semi"), old, new)

    def execution_flow(self, file: str, symbol: str, depth: int = 10, steps: int = 50) -> DataFrame:
        entry = self.files.sparkSession.createDataFrame([(file, symbol)], "file string, symbol string")
        return community.flows(self._calls_with_files(), entry, depth, steps)

    def affected_flows(self, *changed: str, most: int | None = None) -> DataFrame:
        return community.affected_flows(self._calls_with_files(), self.symbols, self._paths(*changed), most)

    # The shape of the whole.

    def hub_nodes(self, min_degree: int = 2, limit: int = 20) -> DataFrame:
        return graph.hub_nodes(self.edges, min_degree, limit)

    def bridge_nodes(self, limit: int = 20) -> DataFrame:
        return community.betweenness(self.edges, limit=limit)

    def knowledge_gaps(self) -> DataFrame:
        return graph.knowledge_gaps(self.files.select("path"), self.edges)

    def communities(self) -> DataFrame:
        """path, community, name."""
        found = community.communities(self.edges)
        return found.join(community.community_names(found).select("community", "name"), "community").select("path", "community", "name")

    def community_list(self, least: int = 2, offset: int = 0, limit: int = 50) -> DataFrame:
        return community.community_page(community.community_names(community.communities(self.edges)), least, offset, limit)

    def architecture_overview(self, k: int = 3) -> tuple[DataFrame, DataFrame]:
        """The hubs of each community, and imports between communities."""
        groups = self.communities()
        return graph.group_hubs(self.edges, groups, k), graph.group_coupling(self.edges, groups)

    def surprising_connections(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Import cycles, production code that imports tests, imports between communities."""
        return graph.import_cycles(self.edges), graph.production_imports_test(self.edges), graph.cross_group_imports(self.edges, self.communities())

    def rules_check(self, rules: DataFrame) -> DataFrame:
        return graph.rule_violations(self.edges, rules)

    def find_large_functions(self, least: int = 50, contains: str = "", limit: int = 30) -> DataFrame:
        n = F.col("end_line") - F.col("start_line") + 1
        return self.symbols.where(F.col("type").isin("function", "class") & (n >= least) & F.contains("path", F.lit(contains))).withColumn("n_lines", n).orderBy(F.desc("n_lines"), "path", "name").limit(limit)

    def risk_overlay(self) -> DataFrame:
        owners = history.ownership(self.commits, self.commit_files)
        partners = history.coupling(self._pairs(), self.now, least_confidence=0.2, k=50).groupBy("path").agg(count().alias("coupling"))
        m = history.churn(self.commits, self.commit_files).join(history.bus_factor(owners), "path", "left").join(partners, "path", "left")
        return risk.risk_overlay(m.fillna({"bus_factor": 1, "coupling": 0}))

    def minimal_context(self) -> DataFrame:
        return graph.minimal_context_hubs(self.edges)

    def status(self) -> DataFrame:
        """n_files, n_edges, n_symbols, n_commits, n_vectors, languages: one row."""
        ext = F.regexp_extract("path", r"\.([^./]{1,4})$", 1)
        rows = self.files.agg(count().alias("n_files"), F.array_sort(F.collect_set(F.nullif(ext, F.lit("")))).alias("languages"))
        for name in ("edges", "symbols", "commits", "vectors"):
            rows = rows.crossJoin(getattr(self, name).agg(count().alias(f"n_{name}")))
        return rows

    def suggested_questions(self, k: int = 3) -> DataFrame:
        """question: about hubs, gaps and the direct importers of hubs."""
        hubs = self.hub_nodes(limit=k).select(F.format_string("What depends on %s, which %d files import?", "path", "fan_in").alias("question"))
        gaps = self.knowledge_gaps().where("gap != 'isolated'").orderBy("gap", "path").limit(k)
        return hubs.union(gaps.select(F.when(F.col("gap") == "dead_code", F.format_string("Is %s still used?", "path")).otherwise(F.format_string("Which tests should cover %s?", "path"))))

    def find_callers(self, symbol: str, path: str) -> DataFrame:
        """Calls of a file's symbol in the files that import it."""
        one = self.symbols.where((F.col("name") == symbol) & (F.col("path") == path))
        return graph.callers_in_importers(one, self.edges, self.calls)

    def ownership(self, limit: int = 50) -> DataFrame:
        owners = history.ownership(self.commits, self.commit_files)
        return history.ownership_list(owners, history.bus_factor(owners), limit)

    def overview(self) -> dict[str, DataFrame]:
        """status, communities (largest first), hubs, and the number of files by risk level."""
        levels = self.risk_overlay().groupBy("level").agg(count().alias("n"))
        return {"status": self.status(), "communities": self.community_list(), "hubs": self.hub_nodes(limit=10), "levels": levels}

    def full_text_hybrid(self, text: str, q: list[float], limit: int = 20) -> DataFrame:
        query = self.files.sparkSession.createDataFrame([(0, q)], "query long, q array<float>")
        return search.fulltext_hybrid(self.files, text, self.vectors, query, limit)

    def entry_points(self) -> DataFrame:
        return self.files.where(F.col("path").rlike(ENTRY_POINT)).select("path")
