"""The engine: what a caller of the search service's tools uses, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline import settings
from fathomline.functions import ids, vectors, versions
from fathomline.functions.text import not_blank, stem_russian, stop_words
from fathomline.operators import catalog as cat
from fathomline.operators import elements as el
from fathomline.operators import inverted, records, render, search
from fathomline.settings import Settings, validated

#: Requests may name what the rules of requests have, and two more.
ACTIONS = (*settings.ACTIONS, "index_all", "delete")
# Other names of actions.
ALIASES = {"default": "default_get", "set_default": "default_set", "clear_default": "default_clear"}


def checked(query: str, limit: int | None = None) -> tuple[str, int]:
    """A search's query and limit as its rules have them; else ValueError."""
    good = validated("search", query=query, limit=limit)
    return good["query"], good["limit"]


@dataclass
class Engine:
    """Search over elements(id, platform_version, element_type, element_name, element_name_en, full_name, parent_type, content, text, embedding ...)."""

    spark: SparkSession
    root: str
    table: str = "elements"
    stops: list[str] | None = None
    busy: set[str] = field(default_factory=set)
    encoder: Callable[[], vectors.Encoder] | None = None
    settings: Settings = field(default_factory=Settings)
    stem: Callable[[str], str] | None = stem_russian
    opened: dict[str, inverted.Inverted] = field(default_factory=dict)

    def __post_init__(self):
        self.catalog = cat.Catalog(self.spark, self.root)
        self.stops = stop_words(self.spark) if self.stops is None else self.stops

    def _limit(self, asked: int | None) -> int:
        limit = self.settings.default_search_limit if asked is None else asked
        if not 1 <= limit <= self.settings.max_search_limit:
            raise ValueError(f"limit is from 1 to {self.settings.max_search_limit}")
        return limit

    def _index_root(self, version: str) -> str:
        return f"{self.root}/_search/{self.table}/{version}"

    def stored_index(self, version: str | None = None) -> inverted.Inverted | None:
        """The version's stored postings, opened once and again when a newer build is there; None where none was built."""
        path = inverted.latest(self.spark, self._index_root(self.version(version)))
        if path and path not in self.opened:
            self.opened = {p: i for p, i in self.opened.items() if p.rsplit("/", 1)[0] != path.rsplit("/", 1)[0]}
            self.opened[path] = inverted.Inverted(self.spark, path, self.stops, self.stem)
        return self.opened.get(path) if path else None

    def elements(self, version: str | None = None) -> DataFrame:
        """One version's rows; other versions' files aren't read."""
        df = self.catalog.read(self.table)
        if df is None:
            raise LookupError("nothing is indexed")
        found = self.version(version)
        return df.filter(F.col(cat.VERSION) == found)

    def version(self, asked: str | None = None, header: str | None = None, environment: str | None = None) -> str:
        """Argument, default, header, environment, latest: the first that is indexed."""
        there = [str(r[0]) for r in self.catalog.info(self.table).select(cat.VERSION).collect()]
        found = versions.resolve(there, asked, self.catalog.default_version(), header, environment or self.settings.default_platform_version)
        if found is None:
            raise LookupError("nothing is indexed")
        return found

    def _asked(self, query: str) -> DataFrame:
        """The query with its vector, as a row that the optimizer knows."""
        vector = vectors.embedded([query], self.encoder() if self.encoder else None)[0]
        return self.spark.sql("SELECT * FROM VALUES (0L) AS t(query_id)").select("query_id", F.lit(query).alias("text"), F.lit(vector).cast("array<double>").alias("query"))

    def search(self, query: str, version: str | None = None, limit: int | None = None, hybrid: bool | None = None) -> DataFrame:
        """Rank-fused hits: rank, id, score, title, content, element_type; dense only where no term is known or hybrid is off. Words are looked up in the
        version's stored postings, which index() writes; without them its texts are read."""
        query = validated("search", query=query, platform_version=_dotted(version))["query"]
        limit = self._limit(limit)
        rows, q = self.elements(version), self._asked(query)
        if self.settings.use_hybrid_search if hybrid is None else hybrid:
            hits = search.hybrid(q, rows, rows, limit, self.settings.sparse_boost, self.stops, "id", self.stem, index=self.stored_index(version), constant=self.settings.rrf_k)
        else:
            hits = search.dense_topk(q.select("query_id", "query"), rows, limit, "id")
        return hits.join(rows, "id").select("rank", "id", "score", F.col("full_name").alias("title"), F.substring("content", 1, 200).alias("description"), "content", "element_type").orderBy("rank")

    def search_elements(self, query: str, element_type: str | None = None, version: str | None = None, limit: int | None = None) -> DataFrame:
        """The cascade of exact names, full names, nearest elements and a scan."""
        query = validated("search_elements", query=query, element_type=element_type, platform_version=_dotted(version))["query"]
        limit = self._limit(limit)
        rows = self.elements(version)
        dense = search.dense_topk(self._asked(query).select("query_id", "query"), el.where(rows, [element_type] if element_type else None), search.fetch_size(query, limit), "id")
        return el.cascade(rows, query, dense.select("id", "score", "rank"), element_type, limit).join(rows, "id")

    def type_members(self, type_name: str, version: str | None = None, member_type: str | None = None, include_constructors: bool = True) -> DataFrame:
        good = validated("type_members", type_name=type_name, member_type=member_type, platform_version=_dotted(version))
        return el.members(self.elements(version), good["type_name"], good["member_type"], include_constructors)

    def type_constructors(self, type_name: str, version: str | None = None) -> DataFrame:
        return self.type_members(type_name, version, "constructor")

    def get_element(self, name: str | None = None, element_type: str | None = None, parent: str | None = None, version: str | None = None, element_id: str | None = None) -> DataFrame:
        validated("get_element", element_name=name, element_type=element_type, parent_type=parent, element_id=element_id, platform_version=_dotted(version))
        return el.element(self.elements(version), name, element_type, parent, element_id)

    def index(self, items: DataFrame, version: str, force: bool = False) -> bool:
        """Put items (element_type, element_name, element_name_en, parent_type, content, path, seq ...) in and store the version's postings; False if the
        version is there and not forced."""
        version = versions.normalize(version)
        if version in self.busy:
            raise RuntimeError(f"{version} is being indexed")
        if not force and self.catalog.exists(self.table, version):
            return False
        self.busy.add(version)
        try:
            full = ids.full_name("element_type", "element_name", "parent_type")
            d = items.withColumn("full_name", full).withColumn(cat.VERSION, F.lit(version))
            d = d.withColumn("id", ids.element_key(ids.original_id(cat.VERSION, "element_type", "full_name")))
            d = el.best_source(d)
            own = [F.transform("parameters", lambda p: p["name"]) if c == "parameters" else c if c in d.columns else None for c in ("signature", "parameters", "return_type")] if "parameters" in d.columns else []
            d = d.withColumn("text", ids.search_text("element_type", "element_name", "element_name_en", "full_name", "content", *own)).filter(not_blank("text"))
            self.catalog.upsert(self.table, d.withColumn("embedding", vectors.encoded("text", encoder=self.encoder)))
            self.store_index(version)
            return True
        finally:
            self.busy.discard(version)

    def store_index(self, version: str) -> None:
        """Build the postings of a version's rows anew, beside those in use; earlier builds but the last are removed."""
        root, rows = self._index_root(version), self.elements(version)
        before = inverted.latest(self.spark, root)
        if not rows.isEmpty():
            inverted.build_next(rows, root, id_col="id", stops=self.stops, stem=self.stem)
            inverted.tidied(self.spark, root, keep={before, inverted.latest(self.spark, root)})

    def index_all(self, items: DataFrame, force: bool = False) -> dict[str, dict]:
        """items with a column version: what became of each version: {"status": indexed, skipped or error, "error": its text}. One that fails doesn't stop others."""
        out: dict[str, dict] = {}
        for v in sorted(r[0] for r in items.select("version").distinct().collect()):
            try:
                done = self.index(items.filter(F.col("version") == v).drop("version"), v, force)
                out[versions.normalize(v)] = {"status": "indexed" if done else "skipped", "error": None}
            except Exception as e:
                out[v] = {"status": "error", "error": str(e)}
        return out

    def page_items(self, pages: DataFrame) -> DataFrame:
        """Items of pages (path, html, seq) for index(): each page's element, the members that types' pages list, and pages without elements."""
        return records.items(pages)

    def member_items(self, pages: DataFrame) -> DataFrame:
        """Those of page_items() that types' pages list; a member's own page, if there is one, is preferred by index()."""
        return records.items(pages, with_own=False)

    def manage(self, action: str, version: str | None = None, items: DataFrame | None = None) -> DataFrame | bool | str | dict | None:
        """The catalogue's actions by name."""
        action = ALIASES.get(action, action)
        if action not in ACTIONS:
            raise ValueError(f"not an action: {action}")
        if action in ("list", "list_versions", "list_indexed", "info", "version_info"):
            found = self.catalog.info(self.table)
            return found.filter(F.col(cat.VERSION) == versions.normalize(version)) if version else found
        if action in ("index", "reindex"):
            return self.index(items, version, action == "reindex")
        if action == "index_all":
            return self.index_all(items)
        if action == "default_get":
            return self.catalog.default_version()
        if action == "default_set":
            return self.catalog.set_default_version(versions.normalize(version))
        if action == "default_clear":
            return self.catalog.set_default_version(None)
        self.catalog.remove(f"_search/{self.table}/{versions.normalize(version)}")
        return self.catalog.remove(self.table, versions.normalize(version))

    def rendered(self, hits: DataFrame) -> DataFrame:
        return render.hits(hits, "title", "content")


def _dotted(version: str | None) -> str | None:
    """A version in the form of requests, where it has one."""
    return None if version is None else version.strip().replace("_", ".")
