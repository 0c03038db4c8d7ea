"""Registered queries of the note operators, with their DuckDB equivalents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import bases, chunking, index, mutate, search
from .plans import router
from .sources import providers, vault
from .streaming import changes

DV = """dv AS (SELECT d.doc_id, lang, source, quality, text, source || '/doc_' || d.doc_id || '.md' AS path, 'doc_' || d.doc_id AS title,
  '---' || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10)
  || CASE WHEN quality IS NULL THEN '' ELSE 'quality: q' || quality || chr(10) END || '---' || chr(10) || chr(10) AS head,
  '# Doc ' || d.doc_id || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Links' || chr(10) || chr(10) || '#' || lang
  || ' [[doc_' || ((d.doc_id * 7 + 1) % n) || ']] [[doc_' || ((d.doc_id * 3) % n) || '|alias]]' AS body
  FROM documents d LEFT JOIN labels USING (doc_id), (SELECT count(*) AS n FROM documents))"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle.replace("{DV}", DV)
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.parse(vault.derived_notes(spark, sf_dir), flat=True)


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that driver and executors share (a temporary one on a single machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="notelake-")
    return f"{root.rstrip('/')}/notelake/{name}-{uuid.uuid4().hex}"


def _base(filters: list[str], logic: str = "and", columns=("file.name", "lang", "quality"), sort=()) -> bases.Base:
    return bases.Base(filters, logic, [bases.View(columns=list(columns), sort=list(sort))])


_BASE_ROW = "path AS _path, title AS file_name, lang, 'q' || quality AS quality"


@registered(f"WITH {{DV}} SELECT {_BASE_ROW} FROM dv WHERE source = 'src0' AND lang = 'en' ORDER BY coalesce('q' || quality, '') DESC, title, path")
def base_filter_sort(spark, sf_dir):
    base = _base(['file.folder == "src0"', 'lang == "en"'], sort=[("quality", "DESC"), ("file.name", "ASC")])
    return bases.resolve(base, _notes(spark, sf_dir))


@registered(f"WITH {{DV}} SELECT {_BASE_ROW} FROM dv WHERE source = 'src1' OR ('q' || quality) = 'q0'")
def base_filter_or(spark, sf_dir):
    return bases.resolve(_base(['file.folder == "src1"', 'quality == "q0"'], "or"), _notes(spark, sf_dir))


@registered(f"WITH {{DV}} SELECT {_BASE_ROW} FROM dv WHERE lang = 'de'")
def base_unparseable_keeps(spark, sf_dir):
    return bases.resolve(_base(['tags.contains("x")', 'lang == "de"']), _notes(spark, sf_dir))


@registered(f"WITH {{DV}} SELECT {_BASE_ROW} FROM dv WHERE lang > '= en'")
def base_ge_unquoted_quirk(spark, sf_dir):
    return bases.resolve(_base(["lang >= en"]), _notes(spark, sf_dir))


@registered(f"WITH {{DV}} SELECT {_BASE_ROW} FROM dv WHERE lang >= 'es' AND NOT coalesce('q' || quality = 'q1', false)")
def base_ordering_and_ne(spark, sf_dir):
    return bases.resolve(_base(['lang >= "es"', 'quality != "q1"']), _notes(spark, sf_dir))


@registered(f"WITH {{DV}} SELECT {_BASE_ROW} FROM dv WHERE contains(lower(title), '_1') AND contains('[''' || lang || ''']', 'fr')")
def base_contains(spark, sf_dir):
    return bases.resolve(_base(["file.name contains _1", "file.tags contains FR"]), _notes(spark, sf_dir))


@registered("""SELECT c_name AS file_name, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer
  ORDER BY c_mktsegment DESC, CAST(c_nationkey AS VARCHAR), c_name""")
def base_multi_key_desc(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    rows = c.select(F.col("c_name").alias("file_name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    keys = bases.sort_keys([("segment", "DESC"), ("nation", "ASC"), ("absent", "ASC")], ["segment", "nation"])
    return rows.orderBy(*keys, "file_name")


def _fm(name, value, op, test):
    @registered(f"WITH {{DV}} SELECT path, title, 'q' || quality AS value FROM dv WHERE quality IS NOT NULL AND {test}")
    def query(spark, sf_dir):
        return search.frontmatter_rows(_notes(spark, sf_dir), "quality", value, op)

    QUERIES[name], ORACLES[name] = QUERIES.pop("query"), ORACLES.pop("query")


_fm("frontmatter_eq", "q1", "==", "'q' || quality = 'q1'")
_fm("frontmatter_ne", "q1", "!=", "'q' || quality <> 'q1'")
_fm("frontmatter_contains", "Q", "contains", "true")


@registered(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
  h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS r FROM l WHERE regexp_matches(text, '(?i)license|the\s+of'))
  SELECT doc_id || '.md' AS path, CAST(doc_id AS VARCHAR) AS title, CAST(line AS INTEGER) AS line, text FROM h WHERE r <= 5""")
def text_search_top5_per_note(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return search.text_hits(docs, r"license|the\s+of")


_FACTS = r"""f AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b([a-z]+)\.([0-9]+)@', 0)) AS context, unnest(regexp_extract_all(text, '\b([a-z]+)\.([0-9]+)@', 1)) AS key,
  unnest(regexp_extract_all(text, '\b([a-z]+)\.([0-9]+)@', 2)) AS value, unnest(range(0, len(regexp_extract_all(text, '\b([a-z]+)\.([0-9]+)@', 0)))) AS place FROM documents)"""


def _facts(spark, sf_dir):
    notes = _read(spark, sf_dir, "documents").select(
        F.concat(F.lit("n/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("doc_id").cast("string").alias("title"), F.col("text").alias("body")
    )
    return providers.extract_facts(notes, r"\b([a-z]+)\.([0-9]+)@")


_FACT_ROW = "substr(sha256('n/' || doc_id || '.md:' || place || ':' || key), 1, 16) AS fact_id, 'n/' || doc_id || '.md' AS path, CAST(doc_id AS VARCHAR) AS title, CAST(doc_id AS VARCHAR) AS entity, key, value, context, CAST(place AS INTEGER) AS place"


@registered(f"WITH {_FACTS} SELECT {_FACT_ROW} FROM f")
def facts_extract(spark, sf_dir):
    return _facts(spark, sf_dir)


@registered(f"WITH {_FACTS}, g AS (SELECT {_FACT_ROW} FROM f) SELECT * FROM g WHERE contains(key, 's') ORDER BY path, place LIMIT 50")
def facts_search(spark, sf_dir):
    return search.fact_rows(_facts(spark, sf_dir), key="S")


def _query_vector(vectors: DataFrame) -> list[float]:
    return list(vectors.where("vec_id = 0").first()["embedding"])


_COS = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"


@registered(f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e, q) SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 10")
def semantic_topk(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings")
    hits = search.vector_top_k(v, _query_vector(v), 10, key="vec_id")
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


@registered(f"""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, q),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) SELECT label, vec_id, CAST(r AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE r <= 3""")
def semantic_topk_all_labels(spark, sf_dir):
    from pyspark.sql import Window

    v = _read(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in _query_vector(v)])
    best = Window.partitionBy("label").orderBy(F.desc("s"), "vec_id")
    ranked = v.withColumn("s", X.cosine(F.col("embedding"), q)).withColumn("rank", F.row_number().over(best)).where("rank <= 3")
    return ranked.select("label", "vec_id", "rank", F.round("s", 6).alias("score"))


@registered("""WITH {DV}, n AS (SELECT count(*) AS n FROM documents),
  t AS (SELECT path AS src, [(doc_id * 7 + 1) % n, (doc_id * 3) % n] AS a FROM dv, n),
  u AS (SELECT src, unnest(CASE WHEN a[1] = a[2] THEN [a[1]] ELSE a END) AS id, unnest(range(0, CASE WHEN a[1] = a[2] THEN 1 ELSE 2 END)) AS pos FROM t)
  SELECT src, CAST(pos AS INTEGER) AS pos, 'doc_' || id AS target, dv.path FROM u JOIN dv ON dv.doc_id = u.id""")
def graph_one_hop(spark, sf_dir):
    return search.resolve_links(_notes(spark, sf_dir))


@registered(r"""SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY href""")
def page_link_extract(spark, sf_dir):
    links = _read(spark, sf_dir, "pages").select("page_id", F.explode(X.all_matches(F.col("html"), r'href="([^"]*)"', 1)).alias("href"))
    return links.groupBy("href").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


_TAGS = r"t AS (SELECT path, unnest(list_distinct(regexp_extract_all(body, '(?m)(?:^|\s)#([a-zA-Z0-9_][a-zA-Z0-9_/\-]*)', 1))) AS tag FROM dv)"


@registered(f"WITH {{DV}}, {_TAGS} SELECT tag, count(*) AS n FROM t GROUP BY tag")
def tag_counts(spark, sf_dir):
    return search.tag_counts(_notes(spark, sf_dir))


@registered(f"WITH {{DV}}, {_TAGS} SELECT path FROM t WHERE tag = 'fr'")
def notes_by_tag(spark, sf_dir):
    return search.notes_by_tag(_notes(spark, sf_dir), "#fr")


@registered("""WITH {DV}, a AS (SELECT path, head || body AS content, doc_id FROM dv)
  SELECT path, 1 AS level, 'Doc ' || doc_id AS text, CAST(len(string_split(substr(content, 1, instr(content, '# Doc ' || doc_id) - 1), chr(10))) AS INTEGER) AS line_number FROM a
  UNION ALL SELECT path, 2, 'Links', CAST(len(string_split(substr(content, 1, instr(content, '## Links') - 1), chr(10))) AS INTEGER) FROM a""")
def note_headers(spark, sf_dir):
    return _notes(spark, sf_dir).select("path", F.explode("headers").alias("h")).select("path", "h.level", "h.text", "h.line_number")


@registered("WITH {DV} SELECT path, CAST(len(string_split(head || body || chr(10), chr(10))) AS INTEGER) AS line_count FROM dv")
def note_line_count(spark, sf_dir):
    return vault.derived_notes(spark, sf_dir).select("path", X.line_count(F.col("content")).alias("line_count"))


@registered("WITH {DV} SELECT path, title, source AS folder, '.md' AS ext FROM dv")
def title_folder_ext(spark, sf_dir):
    p = F.col("path")
    return vault.derived_notes(spark, sf_dir).select("path", X.stem(p).alias("title"), X.folder(p).alias("folder"), X.extension(p).alias("ext"))


_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


@registered(rf"""WITH {{DV}}, p AS (SELECT path, title, lang, quality, source, doc_id, {_TRIM.format('text')} AS t, '#' || lang || ' ' || regexp_extract(body, '\[\[doc_[0-9]+\]\] \[\[doc_[0-9]+\|alias\]\]$') AS l FROM dv),
  c AS (SELECT path, title, '' AS section_header, 'frontmatter' AS chunk_type, 0 AS chunk_index,
          'Note: ' || title || chr(10) || 'Properties:' || chr(10) || '  lang: ' || lang || chr(10) || '  source: ' || source || CASE WHEN quality IS NULL THEN '' ELSE chr(10) || '  quality: q' || quality END AS content,
          NULL AS raw FROM p
        UNION ALL SELECT path, title, 'Doc ' || doc_id, 'section', 1, 'Note: ' || title || chr(10) || 'Section: Doc ' || doc_id || chr(10) || t, t FROM p WHERE t <> ''
        UNION ALL SELECT path, title, 'Links', 'section', CASE WHEN t = '' THEN 1 ELSE 2 END, 'Note: ' || title || chr(10) || 'Section: Links' || chr(10) || l, l FROM p)
  SELECT substr(sha256(path || ':' || chunk_index), 1, 16) AS chunk_id, path AS source_path, title AS note_title, section_header, chunk_type, CAST(chunk_index AS INTEGER) AS chunk_index,
    content, substr(sha256(coalesce(raw, content)), 1, 32) AS content_hash FROM c""")
def chunk_sections(spark, sf_dir):
    return chunking.chunks(_notes(spark, sf_dir), max_tokens=1_000_000).drop("tags", "links")


_PACK = r"""pg AS (SELECT path, row_number() OVER () AS pid, pos, p FROM (
      SELECT path, unnest(a) AS p, unnest(range(1, len(a) + 1)) AS pos FROM (SELECT path, list_filter(list_transform(
        string_split(regexp_replace(t, '\n\s*\n', chr(1), 'g'), chr(1)), lambda x: {TRIM}), lambda x: x <> '') AS a FROM tx))),
  st AS (SELECT pid, list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {TRIM}), lambda x: x <> '') AS s FROM pg),
  fo AS (SELECT pid, 1 AS i, 0 AS batch, s[1] AS now, s FROM st WHERE len(s) > 0
    UNION ALL SELECT pid, i + 1, CASE WHEN ceil(length(now || s[i + 1]) / 4) > {MAX} THEN batch + 1 ELSE batch END,
      CASE WHEN ceil(length(now || s[i + 1]) / 4) > {MAX} THEN s[i + 1] ELSE now || s[i + 1] END, s FROM fo WHERE i < len(s)),
  pk AS (SELECT pid, batch, max_by(now, i) AS text FROM fo GROUP BY pid, batch)"""


def _pack(n: int) -> str:
    return _PACK.replace("{TRIM}", _TRIM.format("x")).replace("{MAX}", str(n))


@registered(rf"""WITH RECURSIVE {{DV}}, p0 AS (SELECT path, title, lang, quality, source, doc_id, {_TRIM.format('text')} AS t, '#' || lang || ' ' || regexp_extract(body, '\[\[doc_[0-9]+\]\] \[\[doc_[0-9]+\|alias\]\]$') AS l FROM dv),
  tx AS (SELECT path, t FROM p0 WHERE ceil(length(t) / 4) > 100), {_pack(100)},
  pc AS (SELECT path, 0 AS a, 0 AS b, 0 AS c, 'frontmatter' AS chunk_type, '' AS section_header,
      'Note: ' || title || chr(10) || 'Properties:' || chr(10) || '  lang: ' || lang || chr(10) || '  source: ' || source || CASE WHEN quality IS NULL THEN '' ELSE chr(10) || '  quality: q' || quality END AS raw FROM p0
    UNION ALL SELECT path, 1, 0, 0, 'section', 'Doc ' || doc_id, t FROM p0 WHERE t <> '' AND ceil(length(t) / 4) <= 100
    UNION ALL SELECT path, 1, pos, 0, 'paragraph', 'Doc ' || doc_id, p FROM pg JOIN p0 USING (path) WHERE ceil(length(p) / 4) <= 100
    UNION ALL SELECT path, 1, pos, batch, 'paragraph', 'Doc ' || doc_id, text FROM pk JOIN pg USING (pid) JOIN p0 USING (path) WHERE ceil(length(p) / 4) > 100
    UNION ALL SELECT path, 2, 0, 0, 'section', 'Links', l FROM p0),
  nu AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY a, b, c) - 1 AS INTEGER) AS chunk_index FROM pc)
  SELECT substr(sha256(path || ':' || chunk_index), 1, 16) AS chunk_id, path AS source_path, title AS note_title, section_header, chunk_type, chunk_index,
    CASE WHEN chunk_type = 'frontmatter' THEN raw ELSE 'Note: ' || title || chr(10) || 'Section: ' || section_header || chr(10) || raw END AS content,
    substr(sha256(raw), 1, 32) AS content_hash FROM nu JOIN p0 USING (path)""")
def chunk_paragraph_sentence_pack(spark, sf_dir):
    return chunking.chunks(_notes(spark, sf_dir), max_tokens=100).drop("tags", "links")


@registered("""WITH {DV} SELECT path, 'Note: ' || title || chr(10) || 'Properties:' || chr(10) || '  lang: ' || lang || chr(10) || '  source: ' || source
  || CASE WHEN quality IS NULL THEN '' ELSE chr(10) || '  quality: q' || quality END AS content FROM dv""")
def frontmatter_chunk_text(spark, sf_dir):
    return _notes(spark, sf_dir).select("path", chunking.frontmatter_text(F.col("title"), F.col("fm")).alias("content"))


_HYBRID = r"""ln AS (SELECT path, title, unnest(string_split(head || body || chr(10), chr(10))) AS x, unnest(range(1, len(string_split(head || body || chr(10), chr(10))) + 1)) AS line FROM dv),
  th AS (SELECT 'text' AS source, path, title, 'Line ' || line || ': ' || regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') AS content, 0.9 AS score, 0 AS so, line AS ro,
           row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM ln WHERE regexp_matches(x, '(?i)license|quality: q0')),
  fr AS (SELECT 'frontmatter' AS source, path, title, 'quality: q0' AS content, 0.9 AS score, 1 AS so, 0 AS ro FROM dv WHERE quality = 0),
  fb AS (SELECT 'base' AS source, path, title, 'file_name: ' || title || ' | lang: ' || lang || CASE WHEN quality IS NULL THEN '' ELSE ' | quality: q' || quality END AS content, 0.85 AS score, 2 AS so, 0 AS ro
         FROM dv WHERE source = 'src0'),
  qv AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
  sv AS (SELECT 'semantic' AS source, path, title, substr(body, 1, 500) AS content, round({COS}, 6) AS score, 3 AS so, e.vec_id AS v FROM embeddings e JOIN dv ON dv.doc_id = e.vec_id, qv q),
  sm AS (SELECT source, path, title, content, score, so, -CAST(round(score * 1e9) AS BIGINT) AS ro FROM sv ORDER BY score DESC, v LIMIT 10),
  fx AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b([a-z]+)\.([0-9]+)@', 1)) AS k, unnest(regexp_extract_all(text, '\b([a-z]+)\.([0-9]+)@', 2)) AS x,
         unnest(range(0, len(regexp_extract_all(text, '\b([a-z]+)\.([0-9]+)@', 0)))) AS place FROM documents),
  fa AS (SELECT 'facts' AS source, path, title, title || ': ' || k || ' = ' || x AS content, 0.95 AS score, 4 AS so, place AS ro FROM fx JOIN dv USING (doc_id) WHERE contains(k, 'th') ORDER BY path, place LIMIT 50),
  al AS (SELECT source, path, title, content, score, so, ro FROM th WHERE r <= 5 UNION ALL SELECT * FROM fr UNION ALL SELECT * FROM fb UNION ALL SELECT * FROM sm UNION ALL SELECT * FROM fa),
  rk AS (SELECT *, row_number() OVER (PARTITION BY path, substr(content, 1, 100) ORDER BY score DESC, so, path, ro) AS k FROM al)""".replace("{COS}", _COS)


def _semantic(spark, sf_dir, notes):
    """The ten notes nearest to a query vector, by the vectors kept for them."""
    v = _read(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in _query_vector(v)])
    kept = v.join(notes.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    scored = kept.withColumn("score", F.round(X.cosine(F.col("embedding"), q), 6)).where("score is not null")
    near = scored.orderBy(F.desc("score"), "vec_id").limit(search.VECTOR_K).select(F.col("vec_id").alias("doc_id"), "score")
    rows = notes.join(F.broadcast(near), "doc_id")
    chunks = rows.select(F.col("path").alias("source_path"), F.col("title").alias("note_title"), F.left("body", F.lit(500)).alias("content"), "score")
    return search.semantic_rows(chunks)


def _strategies(spark, sf_dir):
    """Five strategies over notes that are read and parsed once, into a table of which each reads its own columns."""
    where = _scratch(spark, "parsed")
    _notes(spark, sf_dir).select("path", "doc_id", "title", "content", "body", "fm", "tags").write.parquet(where)
    notes = spark.read.parquet(where)
    base = bases.resolve(_base(['file.folder == "src0"']), notes)
    return [
        search.text_strategy(notes, "license|quality: q0"), search.frontmatter_strategy(notes, "quality", "q0"), search.base_strategy(base),
        _semantic(spark, sf_dir, notes), search.facts_strategy(providers.extract_facts(notes, r"\b([a-z]+)\.([0-9]+)@"), "", key="th"),
    ]


@registered(f"WITH {{DV}}, {_HYBRID} SELECT source, path, title, content, CAST(score AS DOUBLE) AS score FROM rk WHERE k = 1 ORDER BY score DESC, so, path, ro LIMIT 15")
def hybrid_search(spark, sf_dir):
    return search.top_results(search.merge(_strategies(spark, sf_dir))).select("source", "path", "title", "content", "score")


@registered(f"WITH {{DV}}, {_HYBRID} SELECT source, path, title, content, CAST(score AS DOUBLE) AS score FROM rk WHERE k = 1")
def search_unsorted_dedup(spark, sf_dir):
    return search.merge(_strategies(spark, sf_dir)).select("source", "path", "title", "content", "score")


@registered(f"""WITH {{DV}}, {_HYBRID}, tp AS (SELECT * FROM rk WHERE k = 1 ORDER BY score DESC, so, path, ro LIMIT 15)
  SELECT string_agg('[' || path || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY score DESC, so, path, ro) AS context FROM tp""")
def synthesis_context(spark, sf_dir):
    return search.context_of(search.top_results(search.merge(_strategies(spark, sf_dir))))


@registered(f"""WITH {{DV}}, {_HYBRID}, tp AS (SELECT * FROM rk WHERE k = 1 ORDER BY score DESC, so, path, ro LIMIT 15) SELECT DISTINCT path FROM tp""")
def result_sources(spark, sf_dir):
    return search.sources_of(search.top_results(search.merge(_strategies(spark, sf_dir))))


@registered("""WITH {DV} SELECT 'graph' AS source, t.path, t.title, substr(t.body, 1, 500) AS content, CAST(0.7 AS DOUBLE) AS score
  FROM (SELECT DISTINCT unnest([(3 * 7 + 1) % n, (3 * 3) % n]) AS id FROM (SELECT count(*) AS n FROM documents)) l JOIN dv t ON t.doc_id = l.id""")
def graph_results(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    start = notes.where("doc_id = 3").select("path").first()["path"]
    return search.graph_strategy(notes, start).select("source", "path", "title", "content", "score")


@registered(f"""SELECT item_id, CASE WHEN regexp_matches(lower(text), '{'|'.join(router.FACT_WORDS)}') THEN 'semantic,facts,text' ELSE 'semantic' END
  || CASE WHEN regexp_matches(lower(text), '{'|'.join(router.BASE_WORDS)}') THEN ',base' ELSE '' END AS strategies
  FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT 1000000 + doc_id, text FROM documents)""")
def route_fallback(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark").select("item_id", "text")
    d = _read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000000).alias("item_id"), "text")
    return b.unionByName(d).select("item_id", F.array_join(router.routed(F.col("text")), ",").alias("strategies"))


def _file_versions(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("n/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    k = F.pmod("doc_id", F.lit(7))
    files = docs.where(k != 0).select(
        "path",
        F.when(k == 1, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")).alias("content"),
        F.when(k.isin(1, 2), 2.0).otherwise(1.0).alias("mtime"),
        F.octet_length(F.when(k == 1, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))).cast("long").alias("size"),
    )
    meta = docs.where(k != 3).select("path", F.lit(1.0).alias("mtime"), F.octet_length("text").cast("long").alias("size"), X.content_hash(F.col("text")).alias("content_hash"))
    return files, meta


_STATES = "SELECT 'n/' || doc_id || '.md' AS path, CASE doc_id % 7 WHEN 0 THEN 'removed' WHEN 1 THEN 'modified' WHEN 2 THEN 'touched' WHEN 3 THEN 'new' ELSE 'unchanged' END AS state FROM documents"


@registered(_STATES)
def index_change_detection(spark, sf_dir):
    return index.changes(*_file_versions(spark, sf_dir)).select("path", "state")


@registered(f"SELECT count(*) FILTER (state IN ('new', 'modified', 'removed')) AS indexed, count(*) FILTER (state IN ('unchanged', 'touched')) AS skipped, count(*) FILTER (state = 'removed') AS removed FROM ({_STATES})")
def index_stats(spark, sf_dir):
    return index.stats(index.changes(*_file_versions(spark, sf_dir)))


@registered("WITH {DV} SELECT path, doc_id FROM dv WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def index_incremental_remove(spark, sf_dir):
    notes = vault.derived_notes(spark, sf_dir)
    gone = notes.join(_read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return index.without(notes, gone).select("path", "doc_id")


@registered(rf"SELECT doc_id FROM documents WHERE length({_TRIM.format('text')}) >= 10")
def min_body_filter(spark, sf_dir):
    return index.long_enough(_read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))).select("doc_id")


@registered("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
  u AS (SELECT doc_id, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS line, len(a) AS n FROM l),
  k AS (SELECT doc_id, line AS p, 1 AS q, x || CASE WHEN line < n THEN chr(10) ELSE '' END AS x FROM u WHERE line NOT IN (2, 3) AND NOT (line = n AND x = '')
        UNION ALL SELECT doc_id, 1, 0, 'first' || chr(10) FROM l
        UNION ALL SELECT doc_id, 3, 1, 'third' || chr(10) FROM u WHERE line = 3 AND NOT (line = n AND x = ''))
  SELECT doc_id || '.md' AS path, string_agg(x, '' ORDER BY p, q) AS content FROM k GROUP BY doc_id""")
def patch_lines(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    op = lambda i, action, line, text: F.struct(F.lit(i).alias("op_ord"), F.lit(action).alias("action"), F.lit(line).alias("line"), F.lit(text).alias("content"))
    ops = docs.select("path", F.explode(F.array(op(0, "insert", 1, "first"), op(1, "delete", 2, ""), op(2, "replace", 3, "third"))).alias("o")).select("path", "o.*")
    return mutate.patch(docs, ops)


@registered("SELECT doc_id, text || CASE WHEN ends_with(text, chr(10)) THEN '' ELSE chr(10) END || 'more' AS content FROM documents")
def append_note(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", mutate.append(F.col("text"), F.lit("more")).alias("content"))


@registered("WITH {DV} SELECT path, '---' || chr(10) || 'lang: xx' || chr(10) || CASE WHEN quality IS NULL THEN '' ELSE 'quality: q' || quality || chr(10) END || 'status: done' || chr(10) || '---' || chr(10) AS header FROM dv")
def frontmatter_update(spark, sf_dir):
    fm = mutate.update_properties(F.col("fm"), {"lang": "xx", "source": None, "status": "done"})
    return _notes(spark, sf_dir).select("path", mutate.header_text(fm).alias("header"))


def _journal(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.col("conv_id").cast("string").alias("message_id"), F.col("role").alias("path"),
        F.lit("patch").alias("action"), F.when(F.col("turn") > 0, F.col("text")).alias("before_content"), F.col("text").alias("after_content"),
    )


@registered("""WITH j AS (SELECT conv_id * 100 + turn AS seq, conv_id, role AS path, CASE WHEN turn > 0 THEN text END AS b FROM conversations),
  l AS (SELECT * FROM j WHERE conv_id = (SELECT max(conv_id) FROM conversations)), f AS (SELECT path, b, row_number() OVER (PARTITION BY path ORDER BY seq) AS r FROM l),
  n AS (SELECT 'user' AS path, 'now' AS content UNION ALL SELECT 'assistant', 'now' UNION ALL SELECT 'other', 'now')
  SELECT path, content FROM n WHERE path NOT IN (SELECT path FROM f) UNION ALL SELECT path, b FROM f WHERE r = 1 AND b IS NOT NULL""")
def undo_last_message(spark, sf_dir):
    notes = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("user", "assistant", "other")])).alias("path"), F.lit("now").alias("content"))
    return mutate.undo(notes, _journal(spark, sf_dir))[0]


@registered("SELECT conv_id * 100 + turn AS seq, CAST(conv_id AS VARCHAR) AS message_id FROM conversations ORDER BY seq DESC LIMIT 50")
def journal_retention(spark, sf_dir):
    return mutate.retained(_journal(spark, sf_dir)).select("seq", "message_id")


@registered("""WITH {DV} SELECT path, 2 AS depth, source AS parent, 'file' AS type, count(*) AS n_files FROM dv GROUP BY ALL
  UNION ALL SELECT source, 1, '', 'directory', count(*) FROM dv GROUP BY source""")
def tree_rollup(spark, sf_dir):
    return vault.tree(vault.derived_notes(spark, sf_dir), depth=3)


@registered("WITH {DV} SELECT 'doc_' || doc_id || '.md' AS name, path, false AS is_dir, CAST(strlen(head || body || chr(10)) AS BIGINT) AS size, '.md' AS extension FROM dv WHERE source = 'src3'")
def dir_listing(spark, sf_dir):
    notes = vault.derived_notes(spark, sf_dir)
    return vault.list_dir(notes.withColumn("size", F.octet_length("content").cast("long")), "src3")


def _events(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("vault"), F.col("user_id").cast("string").alias("path"), F.col("props").alias("change_type"))


_SESSIONS = """o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) <= INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS sid FROM o)"""


@registered(f"""WITH {_SESSIONS.format(gap="'3 seconds'")} SELECT event_type AS vault, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 3000000 AS end_us, count(*) AS n_changes, count(DISTINCT user_id) AS n_paths FROM s GROUP BY event_type, sid""")
def debounce_sessions(spark, sf_dir):
    got = changes.debounced(_events(spark, sf_dir))
    return got.select("vault", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_changes", "n_paths")


@registered(f"""WITH {_SESSIONS.format(gap="'10 minutes'")}, b AS (SELECT event_type, sid, min(ts) AS start, max(ts) + INTERVAL '10 minutes' AS fin, count(*) AS n FROM s GROUP BY ALL)
  SELECT event_type AS vault, epoch_us(start) AS start_us, n AS n_changes FROM b WHERE fin <= (SELECT max(ts) FROM events) - INTERVAL '1 minute'""")
def stream_debounce(spark, sf_dir):
    """The same batches from a stream with a watermark, read to its end."""
    schema = _read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("vault"), F.col("user_id").cast("string").alias("path"), F.col("props").alias("change_type"))
    out = changes.debounced(rows, gap="10 minutes", watermark="1 minute").select("vault", F.unix_micros("start").alias("start_us"), "n_changes")
    where = _scratch(spark, "debounced")
    q = out.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/rows")


@registered("WITH {DV} SELECT path, title, quality IS NOT NULL AS labelled, CAST(CASE WHEN quality IS NULL THEN 2 ELSE 3 END AS INTEGER) AS n_properties FROM dv")
def note_parse(spark, sf_dir):
    return _notes(spark, sf_dir).select("path", "title", X.property_of(F.col("fm"), "quality").isNotNull().alias("labelled"), F.size("fm").alias("n_properties"))


# -- listings, reading and changes


@registered("WITH {DV} SELECT path FROM dv ORDER BY path")
def note_list(spark, sf_dir):
    return vault.paths(vault.derived_notes(spark, sf_dir))


@registered("WITH {DV} SELECT path, title, body, length(head || body || chr(10)) AS n_chars FROM dv WHERE doc_id = 3")
def note_read(spark, sf_dir):
    notes = vault.derived_notes(spark, sf_dir)
    path = notes.where("doc_id = 3").first()["path"]
    return vault.read_one(notes, path).select("path", "title", "body", F.length("content").cast("long").alias("n_chars"))


@registered(r"WITH {DV} SELECT path, regexp_replace(head || body || chr(10), '\r\n?', chr(10), 'g') AS content, CAST(strlen(head || body || chr(10)) AS BIGINT) AS size FROM dv")
def notes_written_and_scanned(spark, sf_dir):
    """All notes written as files and read back from the folder."""
    root = _scratch(spark, "folder")
    vault.write_notes(vault.derived_notes(spark, sf_dir), root).write.format("noop").mode("overwrite").save()
    return vault.scan(spark, root).select("path", "content", "size")


@registered("SELECT p AS path, p IN ('src0', 'src0/sub/..') OR EXISTS (SELECT 1 FROM documents WHERE source || '/doc_' || doc_id || '.md' = p) AS present "
            "FROM (SELECT unnest(['src0', 'src0/sub/..', 'nosrc', 'nope.md', '../src0', 'src0/doc_0.md', 'src1/doc_1.md', 'src2/doc_2.md']) AS p)")  # fmt: skip
def note_exists(spark, sf_dir):
    asked = ["src0", "src0/sub/..", "nosrc", "nope.md", "../src0", "src0/doc_0.md", "src1/doc_1.md", "src2/doc_2.md"]
    return vault.present(vault.derived_notes(spark, sf_dir).select("path"), spark.createDataFrame([(p,) for p in asked], "path string"))


@registered("SELECT 'v/Good.base' AS path, 'Good' AS name, 2 AS n_views, 'lang == \"en\"|quality != 1' AS filters, 'or' AS logic UNION ALL SELECT 'v/None.base', 'None', 0, '', 'and'")
def base_summary(spark, sf_dir):
    good = 'filters:\n  or:\n    - lang == "en"\n    - quality != 1\nviews:\n  - {name: A, order: [file.name]}\n  - {name: B}\n'
    rows = [("v/Good.base", good), ("v/None.base", "views: []\n"), ("v/Bad.base", "filters: text\n")]
    found = bases.summaries(spark.createDataFrame(rows, "path string, content string"))
    return found.select("path", "name", "n_views", F.array_join("filters", "|").alias("filters"), "logic")


@registered("SELECT doc_id, CAST(ceil(length(text) / 4) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@registered(f"SELECT item_id, {_TRIM.format('text')} AS text FROM benchmark")
def fences_stripped(spark, sf_dir):
    fenced = F.concat(F.lit("\n```json\n"), "text", F.lit("\n```\n"))
    return _read(spark, sf_dir, "benchmark").select("item_id", X.strip_fences(fenced).alias("text"))


def _tagged(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    flow = F.concat(F.lit("tags: ["), "lang", F.lit(", '#"), "source", F.lit("', "), "lang", F.lit("]"))
    text = F.concat(F.lit("tags: '#"), "lang", F.lit(" , "), "source", F.lit("'"))
    front = F.when(F.col("doc_id") % 3 == 0, flow).when(F.col("doc_id") % 3 == 1, text).otherwise(F.lit("other: 1"))
    content = F.concat(F.lit("---\n"), front, F.lit("\n---\nbody #own/"), F.col("doc_id").cast("string"))
    return d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), content.alias("content"))


@registered("""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN ['own/' || doc_id] ELSE [lang, source, 'own/' || doc_id] END AS a FROM documents)
  SELECT doc_id || '.md' AS path, CAST(unnest(range(0, len(a))) AS INTEGER) AS pos, unnest(a) AS tag FROM t""")
def frontmatter_tags(spark, sf_dir):
    return vault.parse(_tagged(spark, sf_dir)).select("path", F.posexplode("tags").alias("pos", "tag"))


@registered(f"WITH {_FACTS}, g AS (SELECT {_FACT_ROW} FROM f) SELECT 'facts' AS source, path, title, entity || ': ' || key || ' = ' || value AS content, CAST(0.95 AS DOUBLE) AS score FROM g WHERE contains(key, 'an') ORDER BY path, place LIMIT 50")
def facts_strategy(spark, sf_dir):
    return search.facts_strategy(_facts(spark, sf_dir), "", key="AN").select("source", "path", "title", "content", "score")


@registered(f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e, q) SELECT 'semantic' AS source, 'v/' || vec_id AS path, 'label ' || label AS content, score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def semantic_rows(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("v/"), F.col("vec_id").cast("string"))
    chunks = v.select(name.alias("source_path"), name.alias("note_title"), F.col("vec_id").alias("chunk_id"), F.concat(F.lit("label "), "label").alias("content"), "embedding")
    return search.semantic_strategy(chunks, _query_vector(v)).select("source", "path", "content", F.round("score", 6).alias("score"))


@registered("""SELECT path FROM (SELECT CASE event_id % 5 WHEN 0 THEN '.trash/' || user_id || '.md' WHEN 1 THEN 'a/' || user_id || '.base' WHEN 2 THEN 'a/.b/' || user_id || '.md'
  WHEN 3 THEN 'a/' || user_id || '.txt' ELSE user_id || '.md' END AS path, event_id FROM events) WHERE event_id % 5 IN (1, 4)""")
def indexable_changes(spark, sf_dir):
    k, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit(".trash/"), u, F.lit(".md"))).when(k == 1, F.concat(F.lit("a/"), u, F.lit(".base"))).when(
        k == 2, F.concat(F.lit("a/.b/"), u, F.lit(".md"))).when(k == 3, F.concat(F.lit("a/"), u, F.lit(".txt"))).otherwise(F.concat(u, F.lit(".md")))
    return changes.indexable(_read(spark, sf_dir, "events").select(path.alias("path")))


@registered(f"WITH RECURSIVE tx AS (SELECT doc_id AS path, text AS t FROM documents), {_pack(100)} SELECT path AS doc_id, CAST(pos - 1 AS INTEGER) AS pos, p AS text FROM pg")
def paragraphs(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"))).alias("pos", "text"))


@registered(f"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS a FROM documents)
  SELECT doc_id, CAST(unnest(range(0, len(a))) AS INTEGER) AS pos, unnest(a) AS text FROM t""".replace("\\\\", "\\"))
def sentences(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("pos", "text"))


@registered(f"WITH RECURSIVE tx AS (SELECT doc_id AS path, text AS t FROM documents), {_pack(60)} SELECT path AS doc_id, CAST(pos - 1 AS INTEGER) AS pos, CAST(batch AS INTEGER) AS batch, text FROM pk JOIN pg USING (pid)")
def sentence_fold(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"))).alias("pos", "p"))
    return rows.select("doc_id", "pos", F.posexplode(chunking.pack_sentences(F.col("p"), 60)).alias("batch", "text"))


@registered("SELECT doc_id || '.md' AS path, text AS content FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'new/' || doc_id || '.md', 'fresh' FROM documents WHERE doc_id % 3 = 1")
def notes_created_and_deleted(spark, sf_dir):
    """Deletes a third of the notes and creates others; a note in the way of a new one stays as it is."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    rest = mutate.delete(d.select("path", "content"), d.where("doc_id % 3 = 0"))
    taken = d.where("doc_id % 3 = 2").select("path", F.lit("not written").alias("content"))
    new = d.where("doc_id % 3 = 1").select(F.concat(F.lit("new/"), "path").alias("path"), F.lit("fresh").alias("content"))
    return mutate.create(rest, new.unionByName(taken))


@registered("""WITH j AS (SELECT conv_id * 100 + turn AS seq, conv_id, role AS path, CASE WHEN turn > 0 THEN text END AS b FROM conversations),
  l AS (SELECT * FROM j WHERE conv_id = (SELECT max(conv_id) FROM conversations)) SELECT path, b AS content FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS r FROM l) WHERE r = 1""")
def undo_restores(spark, sf_dir):
    return mutate.restored(_journal(spark, sf_dir))


@registered("SELECT seq, path, n FROM (SELECT conv_id * 100 + turn AS seq, role AS path, (SELECT count(*) FROM conversations) AS n FROM conversations ORDER BY seq DESC LIMIT 10)")
def journal_recent(spark, sf_dir):
    j = _journal(spark, sf_dir)
    return mutate.retained(j, 10).select("seq", "path", F.lit(j.count()).cast("long").alias("n"))


@registered(f"""WITH {_SESSIONS.format(gap="'3 seconds'")}, b AS (SELECT *, min(ts) OVER (PARTITION BY event_type, sid) AS start FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY event_type, sid, user_id ORDER BY ts DESC, props DESC) AS r FROM b)
  SELECT event_type AS vault, epoch_us(start) AS start_us, CAST(user_id AS VARCHAR) AS path, props AS change_type FROM r WHERE r = 1""")
def last_change_per_path(spark, sf_dir):
    got = changes.last_changes(_events(spark, sf_dir))
    return got.select("vault", F.unix_micros("start").alias("start_us"), "path", "change_type")


def _versioned(spark, sf_dir):
    notes = vault.derived_notes(spark, sf_dir)
    return notes.select("path", "content", F.lit(1.0).alias("mtime"), F.octet_length("content").cast("long").alias("size"), "doc_id")


_CHUNKS = ORACLES["chunk_sections"].rsplit("SELECT substr(", 1)[0]


@registered(_CHUNKS + """, k AS (SELECT path, chunk_index, coalesce(raw, content) AS x, source_doc FROM (SELECT c.*, CAST(regexp_extract(path, '([0-9]+)\\.md$', 1) AS BIGINT) AS source_doc FROM c))
  SELECT path AS source_path, CAST(chunk_index AS INTEGER) AS chunk_index, CASE WHEN source_doc % 5 = 2 AND chunk_index = (SELECT max(z.chunk_index) FROM c z WHERE z.path = k.path)
    THEN substr(sha256(x || chr(10) || 'more'), 1, 32) ELSE substr(sha256(x), 1, 32) END AS content_hash FROM k WHERE source_doc % 5 <> 1""".replace("\\\\", "\\"))
def index_lifecycle(spark, sf_dir):
    """The index after two runs: all notes, then a fifth of them gone, a fifth longer and a fifth touched."""
    ix = index.Index(spark, _scratch(spark, "index"), max_tokens=1_000_000, notes_per_part=64)
    files = _versioned(spark, sf_dir)
    ix.update(files.drop("doc_id"))
    k = F.col("doc_id") % 5
    longer = F.when(k == 2, F.concat("content", F.lit("more"))).otherwise(F.col("content"))
    later = files.where(k != 1).select("path", longer.alias("content"), F.when(k.isin(2, 3), 2.0).otherwise(1.0).alias("mtime"), "size")
    ix.update(later)
    return index.Index(spark, ix.root).table("chunks").select("source_path", "chunk_index", "content_hash")


@registered("SELECT (SELECT count(*) FROM documents) AS notes, (SELECT sum(CASE WHEN regexp_matches(text, '\\S') THEN 3 ELSE 2 END) FROM documents) AS chunks".replace("\\\\", "\\"))
def index_counts(spark, sf_dir):
    ix = index.Index(spark, _scratch(spark, "index"), max_tokens=1_000_000, notes_per_part=64)
    ix.update(_versioned(spark, sf_dir).drop("doc_id"))
    return ix.counts().select("notes", "chunks")


@registered("SELECT source || '/doc_' || doc_id || '.md' AS path FROM documents WHERE doc_id % 2 = 0")
def stream_incremental_index(spark, sf_dir):
    """An index fed by a stream of changed paths: every second note, a hidden and a foreign file."""
    files, root = _versioned(spark, sf_dir), _scratch(spark, "streamed")
    even = files.where("doc_id % 2 = 0").select("path")
    other = spark.createDataFrame([(".x/doc_1.md",), ("src0/doc_1.txt",), ("gone.md",)], "path string")
    even.unionByName(other).coalesce(4).write.parquet(f"{root}/changes")
    ix = index.Index(spark, f"{root}/index", max_tokens=1_000_000, notes_per_part=64)
    stream = spark.readStream.schema("path string").option("maxFilesPerTrigger", "3").parquet(f"{root}/changes")
    changes.index_stream(stream, ix, lambda: files.drop("doc_id"), f"{root}/log").awaitTermination()
    return ix.table("meta").select("path")


@registered("WITH {DV}, s AS (SELECT 'doc_' || doc_id || '.md (' || printf('%.1f', strlen(head || body || chr(10)) / 1024.0) || ' KB)' AS x, 'doc_' || doc_id || '.md' AS n FROM dv WHERE source = 'src3') SELECT string_agg(x, chr(10) ORDER BY n) AS listing FROM s")
def listing_text(spark, sf_dir):
    from . import api

    notes = vault.derived_notes(spark, sf_dir).withColumn("size", F.octet_length("content").cast("long"))
    return spark.createDataFrame([(api.render_listing(vault.list_dir(notes, "src3")),)], "listing string")


from . import folder_queries  # noqa: E402, F401  # registers its own beside these
