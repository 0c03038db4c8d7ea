"""Note operators on a small vault made to show every rule."""

import json

import pytest
from pyspark.sql import functions as F

from notelake import api
from notelake.functions import text as X
from notelake.operators import bases, chunking, index, mutate, search
from notelake.plans import router
from notelake.sources import config, providers, vault

NOTES = {
    "Files/Media/Alpha.md": "---\nstatus: 'To Do'\nrating: 4\nprice: 1.50\ndone: yes\nwhen: 2020-01-02\nlist: [x, y]\nempty:\ntags: ['#one', two]\n---\n\n# Alpha\n\nSee [[Beta]] and [[Gamma|the third]] #two #three/four\n",
    "Files/Media/Beta.md": '---\nstatus: "Done"\nblock:\n  - a b\n  - 7\n---\n# Beta\n#\nfoo\n\n## Beta\ntext here that is long enough\n# Beta\n',
    "Files/Gamma.md": "No frontmatter here. Second sentence! Third? Yes.\n\nSecond paragraph with several words in it.\n",
    "Other/Gamma.md": "---\nnot closed\nGamma two is [[Nowhere]]",
    "Short.md": "tiny",
    "Story.md": "# Title\n\n-----\n\nA line # not a header\n\n-----\n\n## Part\r\nwindows\r\n",
    ".hidden/Secret.md": "hidden",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("vault") / "my vault+"
    for name, text in NOTES.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (top / "View.base").write_text('filters:\n  and:\n    - file.folder == "Files/Media"\nviews:\n  - type: table\n    name: V\n    order: [file.name, status, rating]\n    sort:\n      - {property: status, direction: DESC}\n      - {property: absent, direction: ASC}\n    columnSize: {file.name: 100, x: y}\n')
    (top / "Bad.base").write_text("filters:\nviews: []\n")
    return str(top)


@pytest.fixture(scope="module")
def lake(spark, root):
    return api.Vault(spark, root)


@pytest.fixture(scope="module")
def notes(lake):
    return lake.parsed().cache()


def one(notes, path):
    return notes.where(F.col("path") == path).first()


def test_scan_lists_visible_notes_in_order(lake):
    assert [r.path for r in vault.paths(lake.raw).collect()] == sorted(p for p in NOTES if not p.startswith("."))


def test_frontmatter_types(notes):
    fm = {e.k: (e.v.type, e.v.str) for e in one(notes, "Files/Media/Alpha.md").fm}
    assert fm == {
        "status": ("str", "To Do"), "rating": ("int", "4"), "price": ("float", "1.5"), "done": ("bool", "True"), "when": ("date", "2020-01-02"),
        "list": ("list", "['x', 'y']"), "empty": ("NoneType", "None"), "tags": ("list", "['#one', 'two']"),
    }
    block = {e.k: (e.v.str, e.v["items"]) for e in one(notes, "Files/Media/Beta.md").fm}
    assert block["block"] == ("['a b', 7]", ["a b", "7"]) and block["status"][0] == "Done"


def test_tags_links_headers(notes):
    a = one(notes, "Files/Media/Alpha.md")
    assert a.tags == ["one", "two", "three/four"] and a.wikilinks == ["Beta", "Gamma"] and a.title == "Alpha"
    b = one(notes, "Files/Media/Beta.md")
    assert [(h.level, h.text, h.line_number) for h in b.headers] == [(1, "Beta", 7), (1, "foo", 8), (2, "Beta", 11), (1, "Beta", 7)]
    s = one(notes, "Story.md")
    assert [h.text for h in s.headers] == ["Title", "Part"] and "\r" not in s.content and len(s.fm) == 0
    assert one(notes, "Other/Gamma.md").body.startswith("---")


def test_listing_and_tree(lake):
    own = [("Bad.base", False, ".base"), ("Files", True, ""), ("Other", True, ""), ("Short.md", False, ".md"), ("Story.md", False, ".md"), ("View.base", False, ".base")]
    assert [(r.name, r.is_dir, r.extension) for r in lake.ls().collect()] == own
    assert [r.name for r in lake.ls("Files").collect()] == ["Gamma.md", "Media"]
    rows = {r.path: (r.depth, r.type, r.n_files) for r in lake.tree(depth=2).collect()}
    assert rows["Files"] == (1, "directory", 3) and rows["Files/Media"] == (2, "directory", 2) and "Files/Media/Alpha.md" not in rows


def test_read_errors(lake):
    assert lake.read("./Short.md").first().title == "Short"
    for path, error in (("None.md", FileNotFoundError), ("x.txt", ValueError), ("../up.md", ValueError), ("/etc.md", ValueError)):
        with pytest.raises(error):
            lake.read(path)
    assert vault.exists(lake.raw, "Files/Media") and not vault.exists(lake.raw, "../x")


def test_tag_calls(lake):
    assert [(r.tag, r.n) for r in lake.tags().collect()] == [("one", 1), ("two", 1), ("three/four", 1)]
    assert [r.path for r in lake.tags("##two").collect()] == ["Files/Media/Alpha.md"]


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        ('status == "To Do"', ["Alpha"]), ("rating == 4", []), ("rating != 4", ["Alpha", "Beta"]), ('status >= "E"', ["Alpha"]), ("status >= E", ["Alpha", "Beta"]),
        ("rating contains 4", ["Alpha"]), ("list contains X", ["Alpha"]), ("done contains true", ["Alpha"]), ("empty contains None", []), ("empty != x", ["Alpha", "Beta"]),
        ('tags.contains("x")', ["Alpha", "Beta"]), ("a-b == 1", ["Alpha", "Beta"]), ("file.ext == .md", ["Alpha", "Beta"]), ("file.tags contains THREE", ["Alpha"]),
        ("note.status == Done", []),
    ],
)
def test_base_expressions(notes, expression, expected):
    rows = notes.where((X.folder(F.col("path")) == "Files/Media") & bases.compile_filter(expression))
    assert sorted(r.title for r in rows.collect()) == expected


def test_base_strict_parsing(notes):
    rows = notes.where(bases.compile_filter("status >= E", strict=True))
    assert [r.title for r in rows.collect()] == ["Alpha"]


def test_base_calls(lake):
    assert [(r.name, r.n_views) for r in lake.base_list().collect()] == [("View", 1)]
    base = lake.base_read("View.base")
    assert base.views[0].column_sizes == {"file.name": 100} and base.logic == "and"
    rows = lake.base_query("View.base").collect()
    assert [(r.file_name, r.status, r.rating) for r in rows] == [("Alpha", "To Do", "4"), ("Beta", "Done", None)]
    with pytest.raises(TypeError):
        bases.parse_base("filters: text")


def plain_chunks(body, limit):
    """Greedy packing of sentences, restated."""
    import re

    out, now = [], ""
    for s in [p.strip() for p in re.split(r"(?<=[.!?])\s+", body) if p.strip()]:
        if -(-len(now + s) // 4) > limit and now:
            out.append(now)
            now = s
        else:
            now += s
    return out + [now] * bool(now.strip())


@pytest.mark.parametrize("limit", [2, 5, 9, 30])
def test_sentence_packing(spark, limit):
    text = "No frontmatter here. Second sentence! Third? Yes. " * 3 + "An unfinished last one"
    df = spark.createDataFrame([(text,), ("",), ("One.",)], "t string").select("t", chunking.pack_sentences(F.col("t"), limit).alias("c"))
    for r in df.collect():
        assert r.c == plain_chunks(r.t, limit)


def test_chunks(notes):
    rows = chunking.chunks(notes, max_tokens=12).orderBy("source_path", "chunk_index").collect()
    by = {}
    for r in rows:
        by.setdefault(r.source_path, []).append(r)
    assert [r.chunk_type for r in by["Files/Media/Alpha.md"]] == ["frontmatter", "paragraph"] or by["Files/Media/Alpha.md"][0].chunk_type == "frontmatter"
    gamma = by["Files/Gamma.md"]
    assert [r.chunk_index for r in gamma] == list(range(len(gamma))) and {r.chunk_type for r in gamma} == {"paragraph"}
    beta = by["Files/Media/Beta.md"]
    assert [r.section_header for r in beta] == ["", "Beta"] and beta[1].content == "Note: Beta\nSection: Beta\ntext here that is long enough"
    assert beta[0].content == "Note: Beta\nProperties:\n  status: Done\n  block: a b, 7"


def test_graph_takes_first_path(notes):
    rows = search.resolve_links(notes).orderBy("src", "pos").collect()
    assert [(r.src, r.pos, r.path) for r in rows] == [("Files/Media/Alpha.md", 0, "Files/Media/Beta.md"), ("Files/Media/Alpha.md", 1, "Files/Gamma.md")]


def test_frontmatter_predicate_skips_missing(notes):
    assert [r.title for r in search.frontmatter_rows(notes, "status", "Done", "!=").collect()] == ["Alpha"]
    assert search.frontmatter_rows(notes, "empty", "None").count() == 0
    assert [r.value for r in search.frontmatter_rows(notes, "rating", "4").collect()] == ["4"]
    assert search.frontmatter_rows(notes, "status", "x", ">").count() == 0


def test_text_hits_limit(spark):
    df = spark.createDataFrame([("a.md", "hit\n" * 9 + "HIT"), ("b.md", "none")], "path string, content string")
    assert [r.line for r in search.text_hits(df, "^hit$").collect()] == [1, 2, 3, 4, 5]


def test_merge_keeps_best_at_first_place(spark):
    schema = "source string, path string, title string, content string, score double, row_ord struct<a:string,b:bigint>"
    a = spark.createDataFrame([("x", "p", "p", "c" * 120, 0.5, ("", 0)), ("x", "q", "q", "d", 0.9, ("", 1))], schema)
    b = spark.createDataFrame([("y", "p", "p", "c" * 100 + "other", 0.7, ("", 0)), ("y", "q", "q", "d", 0.9, ("", 1))], schema)
    rows = search.merge([a, b]).orderBy("strategy_ord", "row_ord").collect()
    assert [(r.source, r.path, r.score, r.strategy_ord) for r in rows] == [("y", "p", 0.7, 0), ("x", "q", 0.9, 0)]
    assert [r.path for r in search.sources_of(search.top_results(search.merge([a, b]))).collect()] == ["q", "p"]


def test_search_calls(lake):
    answer, best = lake.query("what is the windows code")
    assert answer.startswith("From ") and best.count() > 0
    assert lake.search("anything", "graph").count() == 0 and lake.search("anything", "nonsense").count() == 0
    assert {r.source for r in lake.search("windows", "text").collect()} == {"text"}
    assert lake.search("x", "base").count() >= 0
    assert "[90%]" in api.render(lake.search("windows", "text")) and api.render_size(1536) == "1.5 KB"


def test_router():
    assert [s.name for s in router.fallback("PIN of my books")] == ["semantic", "facts", "text", "base"]

    class Broken:
        def complete(self, *a, **k):
            return "```json\n{]\n```"

    class Good:
        def complete(self, *a, **k):
            return '```json\n{"classification": "factual", "strategies": [{"name": "text", "params": {"pattern": "x"}}, {"name": "zzz"}]}\n```'

    assert router.route("hello", Broken())[0].name == "semantic"
    assert [(s.name, s.params) for s in router.route("hello", Good())] == [("text", {"pattern": "x"})]


def test_offline_embedding_agrees_with_query_side(spark):
    texts = ["the river and the stone", "Window light", "", "a a a b"]
    got = providers.embedded(spark.createDataFrame([(t,) for t in texts], "content string")).collect()
    for r in got:
        assert r.embedding == pytest.approx(providers.embed_text(r.content), abs=1e-6)


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("KEY_X", "secret")
    (tmp_path / "c.yml").write_text(
        "vault: {path: /v, debounce_seconds: 5, watch: false}\nserver: {port: 1}\nmodels: {api_key: '${KEY_X}', base_url: 'http://x/v1', router: {model: '${NO_SUCH}', max_tokens: null}}\n"
        "embeddings: {batch_size: 8}\nindex: {chunk_max_tokens: 20, fact_extraction: false}\nundo:\n"
    )
    got = config.load(tmp_path / "c.yml")
    assert (got.vault.path, got.models.api_key, got.embeddings.batch_size, got.vault.debounce_seconds, got.models.router.model) == ("/v", "secret", 8, 5.0, "")
    assert (got.vault.watch, got.index.fact_extraction, got.models.router.max_tokens, got.undo.max_operations) == (False, False, 500, 50)
    assert got.chat().api_key == "secret" and got.embedder().batch_size == 8
    plain = config.load(tmp_path / "none.yml")
    assert plain.undo.max_operations == 50 and plain.chat() is None


def plain_patch(text, ops):
    lines = text.splitlines(keepends=True)
    for action, line, content in sorted(ops, key=lambda o: -o[1]):
        at, new = line - 1, content if content.endswith("\n") else content + "\n"
        if action == "insert":
            lines.insert(at, new)
        elif 0 <= at < len(lines):
            lines[at : at + 1] = [new] if action == "replace" else []
    return "".join(lines)


@pytest.mark.parametrize(
    "ops",
    [
        [("insert", 1, "a")], [("insert", 99, "z")], [("insert", 0, "mid")], [("delete", 2, ""), ("delete", 9, "")], [("replace", 3, "r\n"), ("replace", 0, "no")],
        [("insert", 2, "one"), ("insert", 2, "two"), ("delete", 2, "")], [("delete", 1, ""), ("insert", 1, "x"), ("replace", 3, "y")],
    ],
)
def test_patch(spark, ops):
    texts = ["l1\nl2\nl3\n", "l1\nl2\nl3", "", "single"]
    notes = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    rows = [(str(p), i, *o) for p in range(len(texts)) for i, o in enumerate(ops)]
    got = mutate.patch(notes, spark.createDataFrame(rows, "path string, op_ord int, action string, line int, content string"))
    assert {r.path: r.content for r in got.collect()} == {str(i): plain_patch(t, ops) for i, t in enumerate(texts)}


def test_patch_rejects_unknown_action(spark):
    notes = spark.createDataFrame([("p", "x")], "path string, content string")
    ops = spark.createDataFrame([("p", 0, "explode", 1, "")], "path string, op_ord int, action string, line int, content string")
    with pytest.raises(Exception, match="Unknown patch action"):
        mutate.patch(notes, ops).collect()


def test_mutations_and_undo(spark):
    lake = api.Vault(spark, notes=spark.createDataFrame([("a.md", "one\ntwo"), ("b.md", "---\nk: v\n---\n\nbody")], "path string, content string"))
    read = lambda: {r.path: r.content for r in lake.raw.collect()}
    lake.append("a.md", "three")
    assert read()["a.md"] == "one\ntwo\nthree"
    lake.create("c.md", "text", json.dumps({"x": 1}))
    assert read()["c.md"] == "---\nx: 1\n---\n\ntext"
    with pytest.raises(FileExistsError):
        lake.create("c.md")
    lake.update_frontmatter("b.md", json.dumps({"k": None, "n": "new"}))
    assert read()["b.md"] == "---\nn: new\n---\n\nbody"
    lake.delete("a.md")
    assert "a.md" not in read()
    assert [lake.undo() for _ in range(4)] == ["Restored deleted file: a.md", "Reverted frontmatter on: b.md", "Deleted created file: c.md", "Reverted append on: a.md"]
    assert read() == {"a.md": "one\ntwo", "b.md": "---\nk: v\n---\n\nbody"} and lake.undo() == "Nothing to undo."
    with pytest.raises(FileNotFoundError):
        lake.patch("zzz.md", "[]")


def test_changes_reach_the_folder(spark, tmp_path):
    (tmp_path / "v" / "sub").mkdir(parents=True)
    (tmp_path / "v" / "sub" / "a.md").write_text("---\nk: v\n---\n\none\n")
    lake = api.Vault(spark, f"{tmp_path}/v")
    files = lambda: {str(p.relative_to(tmp_path / "v")): p.read_text() for p in (tmp_path / "v").rglob("*.md")}
    lake.create("new/b.md", "text é")
    lake.append("sub/a.md", "two")
    lake.update_frontmatter("sub/a.md", json.dumps({"n": "1: 2", "k": "yes"}))
    assert files() == {"new/b.md": "text é", "sub/a.md": "---\nk: 'yes'\nn: '1: 2'\n---\n\none\ntwo"}
    assert {r.path for r in lake.raw.collect()} == set(files()) and lake.read_raw("new/b.md") == "text é"
    fm = {e.k: (e.v.type, e.v.str) for e in lake.read("sub/a.md").first().fm}
    assert fm == {"k": ("str", "yes"), "n": ("str", "1: 2")}
    lake.delete("new/b.md")
    for _ in range(4):
        lake.undo()
    assert files() == {"sub/a.md": "---\nk: v\n---\n\none\n"} and lake.undo() == "Nothing to undo."
    for path, error in (("../x.md", ValueError), ("none.md", FileNotFoundError)):
        with pytest.raises(error):
            lake.read_raw(path)
    with pytest.raises(NotADirectoryError):
        lake.ls("sub/a.md")


def test_notes_are_written_as_files(spark, tmp_path):
    notes = spark.createDataFrame([("a.md", "x"), ("d/e.md", "y\n"), ("n.md", None)], "path string, content string")
    assert {(r.path, r.size) for r in vault.write_notes(notes, f"file://{tmp_path}/w").collect()} == {("a.md", 1), ("d/e.md", 2), ("n.md", 0)}
    assert {r.path: r.content for r in vault.scan(spark, f"{tmp_path}/w").collect()} == {"a.md": "x", "d/e.md": "y\n", "n.md": ""}
    with pytest.raises(Exception, match="escapes"):
        vault.write_notes(spark.createDataFrame([("../a.md", "x")], "path string, content string"), f"{tmp_path}/w").collect()


def test_search_reads_the_index(spark, tmp_path):
    lake = api.Vault(spark, notes=spark.createDataFrame([("a.md", "garage code: 42\nlong enough", 1.0, 29)], "path string, content string, mtime double, size bigint"))
    ix = lake.index(f"file://{tmp_path}/ix")
    assert lake.search("code", "facts").count() == 0
    ix.update(lake.raw)
    assert lake.search("garage", "semantic").count() == 1


def test_undo_of_a_message_with_several_steps(spark):
    j = spark.createDataFrame([(1, "m1", "a", "create", None, "1"), (2, "m2", "a", "patch", "1", "2"), (3, "m2", "a", "patch", "2", "3"), (4, "m2", "b", "create", None, "n")], "seq long, message_id string, path string, action string, before_content string, after_content string")
    notes = spark.createDataFrame([("a", "3"), ("b", "n")], "path string, content string")
    after, rest = mutate.undo(notes, j)
    assert [tuple(r) for r in after.collect()] == [("a", "1")] and [r.seq for r in rest.collect()] == [1]


def test_index_lifecycle(spark, tmp_path):
    def files(rows):
        return spark.createDataFrame(rows, "path string, content string, mtime double, size bigint")

    ix = index.Index(spark, f"file://{tmp_path}/ix")
    first = [("a.md", "# A\nlong enough text. key: value", 1.0, 30), ("b.md", "color: blue and more words", 1.0, 26), ("c.md", "short", 1.0, 5)]
    assert tuple(ix.update(files(first)).first()) == (2, 1, 0, 2, 1, 0)
    assert {r.source_path for r in ix.table("chunks").collect()} == {"a.md", "b.md"}
    assert [(r.key, r.value) for r in ix.table("facts").collect()] == [("color", "blue and more words")]
    second = [("a.md", "# A\nlong enough text. key: value", 2.0, 30), ("b.md", "now short", 3.0, 9), ("d.md", "a brand new note appears", 1.0, 24)]
    assert tuple(ix.update(files(second)).first()) == (2, 2, 1, 1, 0, 0)
    assert {r.source_path for r in ix.table("chunks").collect()} == {"a.md", "d.md"} and ix.table("facts").count() == 0
    assert {r.path: r.mtime for r in ix.table("meta").collect()} == {"a.md": 2.0, "b.md": 3.0, "d.md": 1.0}
    only = spark.createDataFrame([("d.md",), ("a.md",)], "path string")
    assert tuple(ix.update(files([("a.md", "# A\nchanged text now", 9.0, 20)]), only=only).first())[:3] == (2, 0, 1)
    assert {r.source_path for r in ix.table("chunks").collect()} == {"a.md"}
    again = index.Index(spark, f"file://{tmp_path}/ix")  # as a new process finds it
    assert {r.source_path for r in again.table("chunks").collect()} == {"a.md"} and tuple(again.counts().first()) == (3, 1, 0) or tuple(again.counts().first())[1:] == (1, 0)
    number, held = again.manifest()
    with pytest.raises(RuntimeError):
        again._publish(number, held)
    ix.wipe()
    assert ix.table("chunks").count() == ix.table("meta").count() == 0


def test_streamed_index(spark, tmp_path):
    from notelake.streaming import changes

    log = f"file://{tmp_path}/log"
    schema = "ts timestamp, vault string, path string, change_type string"
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' ts, 'v' vault, explode(array('a.md', '.x/b.md', 'c.txt', 'gone.md')) path, 'modified' change_type")
    rows.write.parquet(log)
    ix = index.Index(spark, f"file://{tmp_path}/ix")
    files = lambda: spark.createDataFrame([("a.md", "some text that is long", 1.0, 22)], "path string, content string, mtime double, size bigint")
    q = changes.index_stream(spark.readStream.schema(schema).parquet(log), ix, files, f"file://{tmp_path}/ck")
    q.awaitTermination()
    assert [r.source_path for r in ix.table("chunks").collect()] == ["a.md"]


def test_debounce(spark):
    from notelake.streaming import changes

    rows = [("2024-01-01 00:00:0%s" % s, "v", p, c) for s, p, c in (("0", "a", "created"), ("1", "b", "modified"), ("2", "a", "deleted"), ("8", "a", "created"))]
    df = spark.createDataFrame(rows, "ts string, vault string, path string, change_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = changes.debounced(df).orderBy("start").collect()
    assert [(r.n_changes, r.n_paths) for r in got] == [(3, 2), (1, 1)]
    last = {(str(r.start)[-2:], r.path): r.change_type for r in changes.last_changes(df).collect()}
    assert last == {("00", "a"): "deleted", ("00", "b"): "modified", ("08", "a"): "created"}


def test_rendering(lake):
    assert api.render_listing(lake.ls("Files")) == f"Gamma.md ({len(NOTES['Files/Gamma.md']) / 1024:.1f} KB)\nMedia/"
    assert api.render_tree(lake.tree("Files")).split("\n") == ["Gamma.md", "Media/", "  Alpha.md", "  Beta.md"]
    assert api.render_tags(lake.tags()).split("\n")[0] == "#one (1)" and api.render_tags(lake.tags("two")) == "Files/Media/Alpha.md"
    assert api.render_note(lake.read("Short.md")) == "Short.md (1 lines)\n\ntiny"
    shown = api.render_note(lake.read("Files/Media/Alpha.md"))
    assert "Tags:\n#one #two #three/four" in shown and "Headers:\nAlpha (line 12)" in shown
    assert api.render_rows(lake.base_query("View.base")).split("\n")[1] == "file_name: Beta | status: Done"
