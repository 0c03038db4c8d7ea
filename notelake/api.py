"""The engine's calls over one vault; results are DataFrames, ``render`` makes text of them."""

from __future__ import annotations

import json
import uuid

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bases, chunking, index, journal, mutate, search
from .plans import router
from .sources import config, files, ignore, providers, vault
from .streaming import changes


class Vault:
    """Notes of a folder (or any ``(path, content[, mtime, size])`` table), read lazily.

    Changes of a folder's notes are written to its files, and to a journal in its hidden folder ``.notelake`` that all processes share;
    those of a table are kept as a small overlay of changed notes, so that the plan over the table doesn't grow with
    their number. With ``index_root``, searches by meaning and for facts read the index kept there. ``settings`` has the chunk size,
    the undo depth, the pause of the watcher and the model services; a ``chat`` or ``embedder`` given here goes first.
    """

    def __init__(
        self, spark: SparkSession, root: str | None = None, notes: DataFrame | None = None, chat=None, index_root: str | None = None,
        settings: config.Settings | None = None, embedder: providers.Embedder | None = None,
    ):
        self.settings = settings or config.Settings()
        self.spark, self.root = spark, root
        self.chat = chat or self.settings.chat()
        self.embedder = embedder or self.settings.embedder()
        self.table = notes
        self.changed: dict[str, str | None] = {}
        self.indexed = self.index(index_root) if index_root else None
        keep = self.settings.undo.max_operations
        self.journal = journal.MemoryJournal(spark, keep) if notes is not None else journal.Journal(spark, f"{root}/.notelake/journal", keep)

    @classmethod
    def from_settings(cls, spark: SparkSession, path: str) -> Vault:
        """The vault that a settings file describes, with its index."""
        found = config.load(path)
        return cls(spark, found.vault.path, index_root=found.index.db_path, settings=found)

    def start(self, log: DataFrame | None = None, checkpoint: str | None = None):
        """Bring the index up to date, then follow a stream of changes (see ``changes.log_changes``), as the settings say; the stream's query, if any."""
        folder = self.settings.vault
        if folder.index_on_startup:
            self.indexed.update_folder(self.root)
        if folder.watch and log is not None:
            return changes.watch(log, lambda paths: self.indexed.update_folder(self.root, only=paths), checkpoint, f"{folder.debounce_seconds} seconds")
        return None

    @property
    def listed(self) -> DataFrame:
        """Files and folders, without content; of a table, its notes."""
        if self.table is None:
            return files.listing(self.spark, self.root)
        raw = self.raw
        return raw if "size" in raw.columns else raw.withColumn("size", F.octet_length("content").cast("long"))

    @property
    def raw(self) -> DataFrame:
        if self.table is None:
            return vault.scan(self.spark, self.root)
        if not self.changed:
            return self.table
        now = self.spark.createDataFrame([(p, t) for p, t in self.changed.items() if t is not None], "path string, content string")
        return self.table.where(~F.col("path").isin(list(self.changed))).select("path", "content").unionByName(now)

    def parsed(self) -> DataFrame:
        return vault.parse(self.raw)

    # reading
    def ls(self, path: str = "") -> DataFrame:
        return vault.list_dir(self.listed, path)

    def read_raw(self, path: str) -> str:
        """The text of any file of the folder."""
        return vault.read_raw(self.spark, self.root, path)

    def read(self, path: str) -> DataFrame:
        return vault.read_one(self.raw, path) if self.table is not None else vault.read_file(self.spark, self.root, path)

    def exists(self, path: str) -> bool:
        return vault.exists(self.listed, path)

    def tree(self, path: str = "", depth: int = 3) -> DataFrame:
        return vault.tree(self.listed, path, depth)

    def tags(self, tag: str = "") -> DataFrame:
        return search.notes_by_tag(self.parsed(), tag) if tag else search.tag_counts(self.parsed())

    # bases
    def base_list(self) -> DataFrame:
        return bases.summaries(vault.scan(self.spark, self.root, ".base")).orderBy("path")

    def base_read(self, path: str) -> bases.Base:
        """The base of one file; FileNotFoundError without it."""
        return bases.parse_base(self.read_raw(path))

    def _first_base(self) -> str | None:
        """The least path of all bases."""
        if not self.root:
            return None
        return files.with_suffix(files.listing(self.spark, self.root), ".base").agg(F.min("path")).first()[0]

    def base_query(self, base: str | bases.Base, question: str = "") -> DataFrame:
        """Rows of a base; a question lets a chat model pick among the first 50, else all rows stay."""
        parsed = base if isinstance(base, bases.Base) else self.base_read(base)
        rows = bases.resolve(parsed, self.parsed())
        if question and self.chat:
            first = [r.asDict() for r in rows.limit(50).collect()]
            try:
                kept = providers.complete_json(self.chat, "router", [{"role": "user", "content": question + "\n" + json.dumps(first, default=str)}])
                if isinstance(kept, list):
                    return self.spark.createDataFrame([[str(k.get(c)) if k.get(c) is not None else None for c in rows.columns] for k in kept], rows.schema)
            except Exception:  # a failed reply keeps all rows
                return rows
        return rows

    # search
    def _strategy(self, step: router.Step, query: str) -> DataFrame | None:
        p, raw = step.params, self.raw
        notes = vault.parse(raw)
        if step.name == "semantic":
            max_tokens = self.settings.index.chunk_max_tokens
            chunks = self.indexed.table("chunks") if self.indexed else providers.embedded(chunking.chunks(notes, max_tokens, counter=self.settings.counter()), self.embedder)
            return search.semantic_strategy(chunks, self.embedder.embed([query])[0])
        if step.name == "text":
            rules = ignore.read(self.spark, self.root) if self.table is None else []
            return search.text_strategy(ignore.visible(raw, rules), p.get("pattern") or query)
        if step.name == "facts":
            facts = self.indexed.table("facts") if self.indexed else providers.extract_facts(vault.bodies(raw))
            return search.facts_strategy(facts, query, p.get("entity", ""), p.get("key", ""), p.get("value", ""))
        if step.name == "frontmatter" and p.get("field"):
            return search.frontmatter_strategy(notes, p["field"], str(p.get("value", "")), p.get("operator", "=="))
        if step.name == "base":
            name = p.get("base_path") or self._first_base()
            return search.base_strategy(bases.resolve(self.base_read(name), notes)) if name else None
        if step.name == "graph" and p.get("path"):
            return search.graph_strategy(notes, p["path"])
        return None

    def search(self, query: str, strategy: str = "") -> DataFrame:
        """Merged results in the order of strategies; neither sorted nor cut."""
        steps = [router.Step(strategy, {"query": query})] if strategy else router.route(query, self.chat)
        found = []
        for step in steps:
            try:
                rows = self._strategy(step, query)
            except (TypeError, AttributeError, FileNotFoundError, yaml.YAMLError):  # a base that is unreadable or gone contributes nothing
                continue
            if rows is not None:
                found.append(rows)
        if not found:
            found = [search.text_strategy(self.raw.limit(0), "a")]
        return search.merge(found)

    def query(self, query: str) -> tuple[str, DataFrame]:
        """An answer and the best results; without a model the answer quotes the best one."""
        best = search.top_results(self.search(query)).cache()
        top = best.orderBy(F.desc("score"), "strategy_ord", "row_ord").first()
        if top is None:
            return "", best
        context = search.context_of(best).first()["context"]
        try:
            if self.chat is None:
                raise ConnectionError
            answer = self.chat.complete("synthesizer", [{"role": "user", "content": f"{context}\n\n{query}"}])
        except Exception:  # the documented fallback of a failed synthesis
            answer = f"From {top['path']}: {top['content']}"
        return answer, best

    # changes
    def _now(self, path: str) -> str | None:
        """A note's text, or None."""
        if path in self.changed:
            return self.changed[path]
        if self.table is None:
            try:
                return vault.read_raw(self.spark, self.root, path)
            except FileNotFoundError:
                return None
        return (self.table.where(F.col("path") == path).select("content").first() or [None])[0]

    def _put(self, path: str, content: str | None) -> None:
        if self.table is not None:
            self.changed[path] = content
        elif content is None:
            vault.remove_raw(self.spark, self.root, path)
        else:
            vault.write_raw(self.spark, self.root, path, content)

    def _change(self, path: str, action: str, before: str | None, after: str | None) -> None:
        self._put(path, after)
        self.journal.record(uuid.uuid4().hex, path, action, before, after)

    def _need(self, path: str) -> tuple[str, str]:
        where = vault.safe_path(path)
        now = self._now(where)
        if now is None:
            raise FileNotFoundError(path)
        return where, now

    def _one(self, path: str, content: str) -> DataFrame:
        return self.spark.createDataFrame([(path, content)], "path string, content string")

    def create(self, path: str, content: str = "", frontmatter_json: str = "{}") -> str:
        where = vault.safe_path(path)
        if self._now(where) is not None:
            raise FileExistsError(path)
        self._change(where, "create", None, mutate.render(json.loads(frontmatter_json or "{}"), content))
        return render_change("create", path)

    def delete(self, path: str) -> str:
        where, now = self._need(path)
        self._change(where, "delete", now, None)
        return render_change("delete", path, now)

    def patch(self, path: str, operations_json: str) -> str:
        where, now = self._need(path)
        rows = [(where, i, o["action"], int(o["line"]), o.get("content", "")) for i, o in enumerate(json.loads(operations_json))]
        ops = self.spark.createDataFrame(rows, "path string, op_ord int, action string, line int, content string")
        self._change(where, "patch", now, mutate.patch(self._one(where, now), ops).first()["content"])
        return render_change("patch", path, count=len(rows))

    def append(self, path: str, content: str) -> str:
        where, now = self._need(path)
        after = self._one(where, now).select(mutate.append(F.col("content"), F.lit(content)).alias("c")).first()["c"]
        self._change(where, "append", now, after)
        return render_change("append", path)

    def update_frontmatter(self, path: str, updates_json: str) -> str:
        where, now = self._need(path)
        given = {k: None if v is None else str(v) for k, v in json.loads(updates_json).items()}
        fm = mutate.update_properties(F.col("fm"), given)
        text = F.concat(F.when(F.size(fm) > 0, F.concat(mutate.header_text(fm), F.lit("\n"))).otherwise(F.lit("")), F.col("body"))
        self._change(where, "frontmatter", now, vault.parse(self._one(where, now)).select(text.alias("c")).first()["c"])
        return render_change("frontmatter", path, names=list(given))

    def undo(self) -> str:
        """Take back the last message's operations, also those of another process; what was done, a line each."""
        last = mutate.last_message(self.journal.rows).orderBy(F.desc("seq")).collect()  # at most the journal's retained operations
        if not last:
            return "Nothing to undo."
        for r in mutate.restored(self.journal.rows).collect():
            self._put(r["path"], r["content"])
        self.journal.take_back([r["seq"] for r in last])
        return "\n".join(render_undone(r["action"], r["path"]) for r in last)

    # index
    def index(self, root: str) -> index.Index:
        """The index kept below ``root``, which searches read from now on."""
        own = self.settings.index
        self.indexed = index.Index(self.spark, root, own.chunk_max_tokens, embedder=self.embedder, chat=self.chat, facts=own.fact_extraction, counter=self.settings.counter())
        return self.indexed


def render(rows: DataFrame, n: int = 50) -> str:
    """Results as text: a percentage cut (not rounded), the path, and the first 200 characters."""
    shown = F.concat(
        F.lit("["), F.floor(F.col("score") * 100).cast("string"), F.lit("%] "), F.col("path"), F.lit("\n"), F.left("content", F.lit(200))
    )
    return "\n\n".join(r[0] for r in rows.orderBy("strategy_ord", "row_ord").select(shown).limit(n).collect())


def render_size(n_bytes: int) -> str:
    return f"{n_bytes / 1024:.1f} KB"


# Text of the other calls. Rows are listings for people, so they are read to the driver.


def render_listing(rows: DataFrame) -> str:
    """A folder's entries, folders first marked by a slash, files with their size."""
    line = lambda r: f"{r['name']}/" if r["is_dir"] else f"{r['name']} ({render_size(r['size'])})"
    return "\n".join(line(r) for r in rows.orderBy("name").collect()) or "(empty)"


def render_tree(rows: DataFrame) -> str:
    """Folders and files indented by depth."""
    shown = rows.orderBy("path").select(
        F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.element_at(F.split("path", "/"), -1), F.when(F.col("type") == "directory", F.lit("/")).otherwise(F.lit("")))
    )
    return "\n".join(r[0] for r in shown.collect())


def render_tags(rows: DataFrame) -> str:
    """``#tag (n)`` by falling count, or one path a line for the notes of a tag."""
    if "tag" not in rows.columns:
        return "\n".join(r["path"] for r in rows.collect())
    return "\n".join(f"#{r['tag']} ({r['n']})" for r in rows.collect())


def render_note(note: DataFrame) -> str:
    """A parsed note: path, the sections that aren't empty, and its body."""
    r = note.first()
    parts = [
        ("Properties", [f"{e.k}: {e.v.str}" for e in r.fm]),
        ("Tags", [" ".join(f"#{t}" for t in r.tags)] if r.tags else []),
        ("Links", [", ".join(r.wikilinks)] if r.wikilinks else []),
        ("Headers", [f"{'  ' * (h.level - 1)}{h.text} (line {h.line_number})" for h in r.headers]),
    ]
    head = [f"{r.path} ({r.line_count} lines)"]
    return "\n\n".join(head + [name + ":\n" + "\n".join(lines) for name, lines in parts if lines] + [r.body])


def render_rows(rows: DataFrame, n: int = 50) -> str:
    """Rows of a view as ``name: value`` pairs, empty values left out."""
    return "\n".join(" | ".join(f"{k}: {v}" for k, v in r.asDict().items() if v and k != "_path") for r in rows.limit(n).collect())


def render_bases(rows: DataFrame) -> str:
    """Each base with its filters and the columns of its views."""
    out = []
    for r in rows.orderBy("path").collect():
        out.append("\n".join([f"{r['name']} ({r['path']})", f"  filters ({r['logic']}): {', '.join(r['filters'])}", *(f"  view {v['name']}: {', '.join(v['columns'])}" for v in r["views"])]))
    return "\n\n".join(out) or "No bases found."


def render_base(path: str, base: bases.Base) -> str:
    """A base as JSON: its name, path, filters and views with their columns and sort keys."""
    views = [{"name": v.name, "type": v.type, "columns": v.columns, "sort": [{"property": p, "direction": d} for p, d in v.sort]} for v in base.views]
    shown = {"name": path.rsplit("/", 1)[-1].removesuffix(".base"), "path": path, "filter_logic": base.logic, "filters": base.filters, "views": views}
    return json.dumps(shown, indent=2, ensure_ascii=False, default=str)


def render_change(action: str, path: str, before: str | None = None, count: int = 0, names: list[str] | None = None) -> str:
    """What a call that changed a note says."""
    return {
        "create": f"Created: {path}",
        "delete": f"Deleted: {path} ({before.count(chr(10)) + 1 if before else 0} lines)",
        "patch": f"Patched {path}: {count} operation(s) applied.",
        "append": f"Appended to {path}.",
        "frontmatter": f"Updated frontmatter on {path}: {', '.join(names or [])}",
    }[action]


def render_undone(action: str, path: str) -> str:
    """What taking back one operation says."""
    if action == "create":
        return f"Deleted created file: {path}"
    return f"Restored deleted file: {path}" if action == "delete" else f"Reverted {action} on: {path}"
