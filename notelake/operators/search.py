"""Retrieval strategies over notes, and their ordered merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

RESULT = ["source", "path", "title", "content", "score", "strategy_ord", "row_ord"]
TEXT_HITS, FACT_LIMIT, VECTOR_K, FINAL_K = 5, 50, 10, 15


def _result(rows: DataFrame, source: str, content: Column, score: Column | float, order: list[Column]) -> DataFrame:
    score = F.lit(float(score)) if isinstance(score, (int, float)) else score
    return rows.select(
        F.lit(source).alias("source"), "path", "title", content.alias("content"), score.cast("double").alias("score"), F.struct(*order).alias("row_ord")
    )


def text_hits(notes: DataFrame, pattern: str, per_note: int = TEXT_HITS) -> DataFrame:
    """``(path, title, line, text)``: a note's first lines that match, ignoring case.

    Filtering happens inside each row's array of lines, so no shuffle is needed.
    """
    lines = F.transform(F.split(F.col("content"), "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    hits = F.slice(F.filter(lines, lambda x: x["text"].rlike("(?i)" + pattern)), 1, per_note)
    possible = F.col("content").rlike("(?i)" + pattern) if not any(c in pattern for c in "^$\\AzZ") else F.lit(True)
    return notes.where(possible).select("path", X.stem(F.col("path")).alias("title"), F.explode(hits).alias("h")).select("path", "title", "h.line", "h.text")


def text_strategy(notes: DataFrame, pattern: str) -> DataFrame:
    hits = text_hits(notes, pattern)
    shown = F.concat(F.lit("Line "), F.col("line").cast("string"), F.lit(": "), X.strip(F.col("text")))
    return _result(hits, "text", shown, 0.9, [F.col("path").alias("a"), F.col("line").cast("long").alias("b")])


def fact_rows(facts: DataFrame, entity: str = "", key: str = "", value: str = "", limit: int = FACT_LIMIT) -> DataFrame:
    """Facts whose fields contain the given texts, ignoring case; empty ones don't constrain."""
    given = {"entity": entity, "key": key, "value": value}
    tests = [F.contains(F.lower(F.col(c)), F.lit(v.lower())) for c, v in given.items() if v]
    return facts.where(reduce(lambda a, b: a & b, tests, F.lit(True))).orderBy("path", "place").limit(limit)


def facts_strategy(facts: DataFrame, query: str, entity: str = "", key: str = "", value: str = "") -> DataFrame:
    """Without entity and key, the whole query is looked for in both, and value is ignored."""
    hits = fact_rows(facts, entity, key, value) if entity or key else fact_rows(facts, query, query)
    shown = F.concat(F.col("entity"), F.lit(": "), F.col("key"), F.lit(" = "), F.col("value"))
    return _result(hits, "facts", shown, 0.95, [F.col("path").alias("a"), F.col("place").cast("long").alias("b")])


def frontmatter_rows(notes: DataFrame, name: str, value: str, op: str = "==") -> DataFrame:
    """Notes with a non-null property that compares, as text, with ``value``; missing ones never match."""
    v = X.property_of(F.col("fm"), name)
    tests = {"==": v["str"] == value, "!=": v["str"] != value, "contains": F.contains(F.lower(v["str"]), F.lit(value.lower()))}
    present = v.isNotNull() & (v["type"] != "NoneType")
    return notes.where(F.coalesce(present & tests.get(op, F.lit(False)), F.lit(False))).select("path", "title", v["str"].alias("value"))


def frontmatter_strategy(notes: DataFrame, name: str, value: str, op: str = "==") -> DataFrame:
    rows = frontmatter_rows(notes, name, value, op)
    return _result(rows, "frontmatter", F.concat(F.lit(f"{name}: "), F.col("value")), 0.9, [F.col("path").alias("a"), F.lit(0).cast("long").alias("b")])


def base_strategy(rows: DataFrame) -> DataFrame:
    """Rows of a resolved base as ``key: value`` pairs; empty values are left out."""
    columns = [c for c in rows.columns if c != "_path"]
    pairs = F.array(*[F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(f"{c}: "), F.col(c))) for c in columns]) if columns else F.array().cast("array<string>")
    title = F.coalesce(F.col("file_name"), X.stem(F.col("_path"))) if "file_name" in columns else X.stem(F.col("_path"))
    named = rows.withColumns({"path": F.col("_path"), "title": title})
    return _result(named, "base", F.array_join(F.array_compact(pairs), " | "), 0.85, [F.col("path").alias("a"), F.lit(0).cast("long").alias("b")])


def vector_top_k(vectors: DataFrame, query: list[float], k: int = VECTOR_K, key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector by cosine, with ``score``; ties by key.

    The query is a literal, so this is one scan and a bounded top-k per partition.
    """
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", X.cosine(F.col(column), literal)).where(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), key).limit(k)


def semantic_strategy(chunks: DataFrame, query: list[float], k: int = VECTOR_K) -> DataFrame:
    return semantic_rows(vector_top_k(chunks, query, k))


def semantic_rows(hits: DataFrame) -> DataFrame:
    """Scored chunks ``(source_path, note_title, content, score)`` as results, best first."""
    named = hits.withColumns({"path": F.col("source_path"), "title": F.col("note_title")})
    order = [F.lit("").alias("a"), (-F.round(F.col("score") * 1e9)).cast("long").alias("b")]
    return _result(named, "semantic", F.col("content"), F.col("score"), order)


def resolve_links(notes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(src, pos, target, path)``: each link of ``sources`` and the first note, by path, whose stem it names.

    An equi-join on the stem; notes that share one are first reduced to their smallest path.
    """
    links = (sources if sources is not None else notes).select(F.col("path").alias("src"), F.posexplode("wikilinks").alias("pos", "target"))
    named = notes.groupBy(X.stem(F.col("path")).alias("target")).agg(F.min("path").alias("path"))
    return links.join(named, "target").select("src", "pos", "target", "path")


def graph_strategy(notes: DataFrame, path: str) -> DataFrame:
    hop = resolve_links(notes, notes.where(F.col("path") == path))
    rows = hop.join(notes.select("path", "title", "body"), "path")
    return _result(rows, "graph", F.left("body", F.lit(500)), 0.7, [F.lit("").alias("a"), F.col("pos").cast("long").alias("b")])


def merge(strategies: list[DataFrame]) -> DataFrame:
    """All results in the order of strategies and rows, with duplicates removed.

    Results with the same path and first 100 characters are duplicates: the highest score stays
    (the first of equals), at the place of the first one.
    """
    numbered = [s.withColumn("strategy_ord", F.lit(i)) for i, s in enumerate(strategies)]
    every = reduce(lambda a, b: a.unionByName(b), numbered)
    key = Window.partitionBy("path", F.substring("content", 1, 100))
    place = F.struct("strategy_ord", "row_ord")
    best = key.orderBy(F.desc("score"), "strategy_ord", "row_ord")
    ranked = every.withColumns({"first": F.min(place).over(key), "r": F.row_number().over(best)}).where(F.col("r") == 1)
    return ranked.select("source", "path", "title", "content", "score", F.col("first.strategy_ord").alias("strategy_ord"), F.col("first.row_ord").alias("row_ord"))


def top_results(merged: DataFrame, k: int = FINAL_K) -> DataFrame:
    return merged.orderBy(F.desc("score"), "strategy_ord", "row_ord").limit(k)


def sources_of(results: DataFrame) -> DataFrame:
    """Distinct paths in the order they first appear."""
    first = F.struct(-F.col("score"), F.col("strategy_ord"), F.col("row_ord"))
    return results.where("path <> ''").groupBy("path").agg(F.min(first).alias("o")).orderBy("o").select("path")


def context_of(results: DataFrame) -> DataFrame:
    """One row ``context``: ``[path]`` and content of each result, best first, ruled off by dashes."""
    place = F.struct((-F.col("score")).alias("a"), "strategy_ord", "row_ord", F.concat(F.lit("["), "path", F.lit("]\n"), "content").alias("t"))
    return results.agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["t"]), "\n\n---\n\n").alias("context"))


def tag_counts(notes: DataFrame) -> DataFrame:
    """``(tag, n)`` by falling count, ties by first encounter."""
    seen = notes.select("path", F.posexplode("tags").alias("pos", "tag"))
    return seen.groupBy("tag").agg(F.count("*").alias("n"), F.min(F.struct("path", "pos")).alias("o")).orderBy(F.desc("n"), "o").drop("o")


def notes_by_tag(notes: DataFrame, tag: str) -> DataFrame:
    return notes.where(F.array_contains("tags", tag.lstrip("#"))).select("path").orderBy("path")
