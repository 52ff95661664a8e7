"""The engine's face: the tools by name, each with keyword arguments, each a DataFrame or a small value."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as ff
from ..functions import text as ft
from ..operators import compile_state as cs
from ..operators import embedding as em
from ..operators import graph as g
from ..operators import quality as q
from ..sources import files as sf
from ..sources import wiki as sw
from ..sources.tables import file_system, load, save, stage


class Engine:
    """A knowledge base: entries and pages as DataFrames; graph, search index, vectors and state kept below `root`, where one is given."""

    def __init__(self, spark: SparkSession, entries: DataFrame, pages: DataFrame | None = None, root: str | None = None):
        self.spark, self.entries, self.pages, self.root = spark, entries, pages, root
        self._edges: DataFrame | None = None

    @classmethod
    def from_wiki(cls, spark: SparkSession, folder: str, root: str | None = None) -> Engine:
        return cls(spark, sf.scan_entries(sf.read_markdown(spark, folder)), root=root)

    def _kept(self, name: str) -> str:
        if not self.root:
            raise ValueError("this knowledge base has no root to keep things below")
        return f"{self.root}/_index/{name}"

    def edges(self) -> DataFrame:
        if self._edges is None:
            build = lambda: g.build_graph(self.entries)
            self._edges = load(self.spark, self._kept("edges"), build, ("src", "dst", "kind")) if self.root else build()
        return self._edges

    def save_graph(self) -> None:
        save(self.edges(), self._kept("edges"))

    def index(self) -> tuple[DataFrame, DataFrame] | None:
        """The saved search index; None if there is none, and searches scan the entries."""
        if not self.root:
            return None
        fs, p = file_system(self.spark, self._kept("search/lengths"))
        return ft.load_index(self.spark, self._kept("search")) if fs.exists(p) else None

    def rebuild_index(self) -> tuple[DataFrame, DataFrame]:
        built = ft.rebuild_index(self.entries)
        if not self.root:
            return built
        ft.save_index(built, self._kept("search"))
        return ft.load_index(self.spark, self._kept("search"))

    def vectors(self) -> tuple[DataFrame, DataFrame]:
        return em.load_vectors(self.spark, self._kept("embeddings"), lambda: em.batch_embed_all(self.entries))

    def embed_entry(self, path: str) -> DataFrame:
        vectors, table = self.vectors()
        vectors, hit = em.embed_entry(self.entries, path, vectors, table)
        hit = stage(hit, "hit")  # what it reads is replaced next
        save(vectors, self._kept("embeddings/vectors"))
        return hit

    def _config_path(self) -> str:
        return f"{self.root}/config.json"

    def tools(self) -> list[str]:
        return sorted(TOOLS)

    def call(self, name: str, **arguments: Any) -> Any:
        if name not in TOOLS:
            raise KeyError(f"no such tool: {name}")
        return TOOLS[name](self, **arguments)


def register_tool(name: str, tool: Callable[..., Any]) -> None:
    """Makes tool(engine, **arguments) callable by name; a name that is taken is replaced."""
    TOOLS[name] = tool


def _now(now: Any) -> Any:
    return F.current_timestamp() if now is None else now


def _recompile(e: Engine, path: str, versions: DataFrame | None = None, now: Any = None, new_hash: str | None = None) -> Any:
    """On the files below root, or without versions' table there on the entries themselves."""
    return sw.recompile_file(e.spark, e.root, path, _now(now)) if versions is None else cs.recompile_entry(e.entries, versions, path, _now(now), new_hash)


def _compiled(e: Engine, files: DataFrame, now: Any = None, domain: str | None = None, extractor: str = "text") -> DataFrame:
    return sw.incremental_compile(files, e.root, _now(now), domain, extractor)


TOOLS: dict[str, Callable[..., Any]] = {
    "extract_text": lambda e, **k: sf.extract_text(k.get("pages", e.pages)),
    "extract_structured": lambda e, files, extractor="text": sf.extract_structured(files, extractor),
    "get_page_count": lambda e, **k: sf.get_page_count(k.get("pages", e.pages)),
    "search_keywords": lambda e, keywords, case_sensitive=False, context=50: ft.search_keywords(e.pages, keywords, case_sensitive, context),
    "extrude_to_server_wiki": lambda e, quality=0.85, now=None: sw.save_raw(sw.texts_of(e.pages), e.root, _now(now), quality),
    "extrude_to_agent_payload": lambda e: sf.agent_payload(sf.extract_text(e.pages)),
    "compile_to_wiki": lambda e, files, domain=None, now=None, extractor="text": sw.compile_to_wiki(files, e.root, domain, _now(now), extractor),
    "incremental_compile": _compiled,
    "micro_compile": lambda e, page_range=None: ff.micro_compile(e.pages, page_range),
    "search_knowledge": lambda e, query, limit=10: ft.search_knowledge(e.entries, query, limit, e.index()),
    "rebuild_index": lambda e: e.rebuild_index(),
    "get_entry_context": lambda e, path, hops=2: g.get_entry_context(e.entries, path, hops, e.edges() if e.root else None),
    "find_orphans": lambda e: g.find_orphans(e.entries),
    "suggest_links": lambda e, path, top_k=5: g.suggest_links(e.entries, path, top_k, edges=e.edges() if e.root else None),
    "export_concept_map": lambda e, path, depth=2: g.export_concept_map(e.entries, e.edges(), path, depth),
    "check_quality": lambda e: q.check_quality(e.entries),
    "aggregate_entries": lambda e: g.aggregate_entries(e.entries, g.detect_communities(e.edges())),
    "hypothesis_test": lambda e: q.hypothesis_test(e.entries),
    "recompile_entry": _recompile,
    "get_config": lambda e, key=None: (lambda c: c if key is None else c.get(key))(sf.read_config(e.spark, e._config_path())),
    "set_config": lambda e, **changes: sf.set_config(e.spark, e._config_path(), changes),
    "get_health_report": lambda e: q.get_health_report(e.entries, e.edges(), q.check_quality(e.entries), g.find_orphans(e.entries), *_measured(e)),
    "trigger_incremental_compile": lambda e, files, **k: cs.incremental_totals(_compiled(e, files, **k)),
    "get_compile_status": lambda e: cs.get_compile_status(e.spark, e.root),
}


def _measured(e: Engine) -> tuple[int, str | None]:
    """Bytes of what is kept below root, and when the last compilation finished."""
    if not e.root:
        return 0, None
    fs, p = file_system(e.spark, f"{e.root}/_index")
    return (int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0), cs.get_compile_status(e.spark, e.root).first()["last_finished"]


__all__ = ["TOOLS", "Engine", "register_tool"]
