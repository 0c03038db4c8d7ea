"""Folders, indexes, model services, the journal and the watcher, each against what a plain reading says."""

import datetime as dt
import http.server
import json
import os
import random
import threading
import time

import numpy as np
import pandas as pd
import pytest
import yaml
from pyspark.sql import functions as F

from notelake import api
from notelake.functions import text as X
from notelake.functions import yaml_header as Y
from notelake.operators import index, journal, nearest
from notelake.sources import files, ignore, providers, vault
from notelake.streaming import changes


def put(root, **texts):
    for name, text in texts.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "my notes"
    for name, text in {"a.md": "---\nx: 1\n---\nhello there, reader", "e.md": "", "_u/_x.md": "under\r\nscore", "s p/ü.md": "b", ".h/x.md": "no", "d/.x.md": "no", "bad.md": b"\xff\xfe"}.items():
        put(root, **{name.replace("/", "__"): text})
    (root / "empty" / "inner").mkdir(parents=True)
    return root


# -- listings


def test_listing(spark, folder):
    want = {"a.md": False, "e.md": False, "_u": True, "_u/_x.md": False, "s p": True, "s p/ü.md": False, "bad.md": False, "empty": True, "empty/inner": True, "d": True}
    for root in (str(folder), f"file://{folder}"):
        rows = files.listing(spark, root).collect()
        assert {r.path: r.is_dir for r in rows} == want
        assert {r.path: r.size for r in rows} == {p: 0 if d else (folder / p).stat().st_size for p, d in want.items()}
        assert all(r.mtime == pytest.approx((folder / r.path).stat().st_mtime, abs=1e-3) for r in rows)
    with pytest.raises(Exception, match="nowhere"):
        files.listing(spark, f"{folder}/nowhere").collect()


def test_many_folders_are_dealt_out(tmp_path):
    for i in range(40):
        put(tmp_path, **{f"d{i % 7}__e{i}__f.md": "x"})
    for folders in (1, 5, 30, 500):
        reader = files._Lister(str(tmp_path), folders, frozenset())
        parts = reader.partitions()
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert len(parts) <= folders and len(rows) == len({r["path"] for r in rows}) == 7 + 40 + 40


def test_folders_with_many_files_are_left_to_tasks(tmp_path, monkeypatch):
    for d in range(6):
        for i in range(30):
            put(tmp_path, **{f"d{d}__e__n{i}.md": "x"})
    opened, plain = [], files.entries
    monkeypatch.setattr(files, "entries", lambda store, base, folder, *a: opened.append(folder) or plain(store, base, folder, *a))
    monkeypatch.setattr(files, "BATCH_ROWS", 40)
    reader = files._Lister(str(tmp_path), 256, frozenset())
    parts = reader.partitions()
    assert opened == ["", *(f"d{d}" for d in range(6)), "d0/e"] and len(parts) == 13  # five of the folders with files aren't opened by the driver
    assert sorted(p for part in parts for b in reader.read(part) for p in b["path"].to_pylist() if p.endswith(".md")) == sorted(f"d{d}/e/n{i}.md" for d in range(6) for i in range(30))


def test_empty_notes_and_folders_are_read(spark, folder):
    lake = api.Vault(spark, str(folder))
    assert [(r.name, r.is_dir) for r in lake.ls().collect()] == [("_u", True), ("a.md", False), ("bad.md", False), ("d", True), ("e.md", False), ("empty", True), ("s p", True)]
    assert lake.ls("empty/inner").collect() == [] and api.render_listing(lake.ls("empty/inner")) == "(empty)"
    assert lake.read("e.md").first().body == "" and lake.read("_u/_x.md").first().body == "under\nscore"
    assert {r.path for r in lake.raw.collect()} == {"a.md", "e.md", "_u/_x.md", "s p/ü.md"}
    assert {r.path: r.type for r in lake.tree(depth=2).collect()}["empty/inner"] == "directory"
    assert lake.exists("empty") and lake.exists("a.md") and not lake.exists("empty/none")
    lake.create("new.md")
    assert lake.read("new.md").first().content == ""
    for wrong in ("a.md", "none"):
        with pytest.raises(NotADirectoryError):
            lake.ls(wrong)


def test_only_wanted_files_are_opened(spark, folder):
    rows = files.with_suffix(files.listing(spark, str(folder)), ".md").cache()
    rows.count()
    os.remove(folder / "s p" / "ü.md")
    got = {r.path: (r.content, r.problem) for r in files.contents(rows, str(folder), F.col("path") != "bad.md").collect()}
    assert got["bad.md"] == (None, None) and got["s p/ü.md"] == (None, "missing") and got["e.md"] == ("", None)
    assert files.contents(rows, str(folder)).where("path = 'bad.md'").first().problem == "no UTF-8 text"
    asked = spark.createDataFrame([("a.md",), ("empty",), ("gone.md",), ("a.md",), (None,)], "path string")
    assert [r.path for r in files.stats_of(asked, str(folder)).collect()] == ["a.md"]


# -- headers


HEADS = [
    "a: 1", "a: b c\nt: [x, y]", "t:\n- a\n- b\nz: 'q'", "m:\n  k: 1", "s: |\n  text", "h: 0x1F", "x: [1", "d: 2020-01-02\nf: 1.50\nb: yes\nn:", "a: b: c", "on: 1", "a: 1\na: 2", "- x",
    "just text", "d: 2020-13-45", "t: 12:30:45", "list:\n  - a\n  - b c\nk: v", 'q: "a \\n b"', "x: 1e3", "c: a # b", "u: ünder", "k: - a", "n: 010", "v: .inf", "f: 1_000", "x: !!python/object:os.system 1",
    "{a: 1, b: [2]}", "l: [a, 'b c', \"d\"]", "l: [true, 1, null, 2020-01-01]", "e: []", "k:\n- a\n- 1\n- yes", "x: a, b", "p: A/B (c) + d-e.f", "fl: 0.0005", "x: -1", "k: v\n- a", "k:\n\n- a", "", "\n\n",
    "a: x\n  y", "a:\n  - x\n   - y", "a:\n  - x\n- y", "a:\n- x\n- y z\n- 'q'\nb: 1", "a:\n - x \n - y", "? a\n: b", "a: &x 1\nb: *x", "a: 'it''s'", "a: 'b\\c'", "l: ['x\\y']", "yes", "null: 1", "a : b", "a b: c", "a-b: c", "a:b", "\ta: 1", "a: [x,y]", "a: x ", "a: @x", "a: 1.0", "a: 00",
]


def test_headers_read_as_yaml_does(spark):
    rng = random.Random(4)
    bits = ["a", "b c", ":", ": ", "\n", "- ", "[", "]", "'", '"', "1", "1.5", "#", " ", "yes", "2020-01-02", "k: ", "t:\n", ", ", "x", "~", "{", "}", "\\"]
    heads = HEADS + ["k: " + "".join(rng.choice(bits) for _ in range(rng.randint(1, 7))) for _ in range(1500)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string")
    front, n_flat = F.col("h"), 0
    for r in df.select("i", Y.flat(front).alias("flat"), X.entries(front).alias("e"), Y.whole(front).alias("w")).collect():
        try:
            found = yaml.safe_load(heads[r.i])
            want = [(str(k), type(v).__name__, str(v), [str(x) for x in v] if isinstance(v, list) else None) for k, v in found.items()] if isinstance(found, dict) else []
        except (yaml.YAMLError, ValueError, TypeError):
            want = None
        got = r.e if r.flat else r.w.entries
        assert (None if got is None else [(e.k, e.v.type, e.v.str, e.v["items"]) for e in got]) == want, heads[r.i]
        n_flat += r.flat
    assert n_flat > 50


def test_malformed_notes_are_left_out(spark, tmp_path):
    put(tmp_path, **{"a.md": "---\nm:\n  k: 1\ntags: [x]\n---\nbody", "b.md": "---\nx: [1\n---\nbody #y", "c.md": "no header"})
    lake = api.Vault(spark, str(tmp_path))
    assert {r.path: [(e.k, e.v.str) for e in r.fm] for r in lake.parsed().collect()} == {"a.md": [("m", "{'k': 1}"), ("tags", "['x']")], "c.md": []}
    assert [r.tag for r in lake.tags().collect()] == ["x"]


def test_header_lines(spark):
    text = "intro # A\n# A\n## A\ntext\n#\nB\n\n# C\n# C"
    notes = spark.createDataFrame([("n.md", text)], "path string, content string")
    got = [(h.level, h.text, h.line_number) for h in vault.parse(notes).first().headers]
    assert got == [(1, "A", 1), (2, "A", 3), (1, "B", 5), (1, "C", 8), (1, "C", 8)]


# -- the index


class Fussy:
    """An embedder that fails for texts with a word in it, while told to."""

    def __init__(self, marker):
        self.batch_size, self.marker = 1, marker

    def embed(self, texts):
        if os.path.exists(self.marker) and any("fail" in t for t in texts):
            raise ConnectionError
        return [[1.0, float(len(t))] for t in texts]


def test_unchanged_notes_are_not_read(spark, tmp_path):
    root = tmp_path / "v"
    put(root, **{f"n{i}.md": f"body of the note {i}" for i in range(6)})
    ix = index.Index(spark, f"file://{tmp_path}/ix")
    assert tuple(ix.update_folder(str(root)).first()) == (6, 0, 0, 6, 0, 0)
    for i in range(1, 6):  # other bytes of the same size and time: reading one would show
        path = root / f"n{i}.md"
        was = path.stat()
        path.write_bytes(b"\xff" * was.st_size)
        os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))
    assert tuple(ix.update_folder(str(root)).first()) == (0, 6, 0, 0, 0, 0)
    put(root, **{"n0.md": "the body that has changed"})
    assert tuple(ix.update_folder(str(root)).first()) == (1, 5, 0, 1, 0, 0)
    only = spark.createDataFrame([("n0.md",), ("gone.md",), ("x.txt",)], "path string")
    assert tuple(ix.update_folder(str(root), only=only).first()) == (1, 0, 0, 1, 0, 0)
    os.remove(root / "n0.md")
    assert tuple(ix.update_folder(str(root), only=only).first()) == (1, 0, 1, 0, 0, 0)
    assert ix.table("chunks").count() == 5


def test_errors_stay_and_are_tried_again(spark, tmp_path):
    root, marker = tmp_path / "v", tmp_path / "marker"
    put(root, **{"a.md": "a text that is fine", "b.md": "a text that will fail", "c.md": "---\nx: [1\n---\nlong enough body", "d.md": b"\xff\xfe"})
    marker.touch()
    ix = index.Index(spark, f"file://{tmp_path}/ix", embedder=Fussy(str(marker)))
    assert tuple(ix.update_folder(str(root)).first()) == (1, 0, 0, 1, 0, 3)
    marker.unlink()
    put(root, **{"c.md": "---\nx: [1]\n---\nlong enough body"})
    assert tuple(ix.update_folder(str(root)).first()) == (2, 1, 0, 3, 0, 1)
    marker.touch()
    put(root, **{"a.md": "this must fail now, but stays"})
    assert tuple(ix.update_folder(str(root)).first()) == (0, 2, 0, 0, 0, 2)
    rows = {r.source_path: r.content for r in ix.table("chunks").where("chunk_type <> 'frontmatter'").collect()}
    assert "a text that is fine" in rows["a.md"] and set(rows) == {"a.md", "b.md", "c.md"}


def test_parts_grow_and_vacuum_bounds_the_folder(spark, tmp_path):
    root = tmp_path / "ix"
    rows = lambda n, t: spark.createDataFrame([(f"n{i}.md", f"text of the note {i} at {t if i % 5 == 0 else 0}", float(t if i % 5 == 0 else 0), 9) for i in range(n)], "path string, content string, mtime double, size bigint")
    ix = index.Index(spark, f"file://{root}", notes_per_part=4)
    sizes, before = [], None
    for t in range(1, 8):
        ix.update(rows(3 * t, t))
        held = ix.manifest()[1]
        assert held["notes"] == 3 * t == ix.table("meta").count() == ix.table("chunks").count()
        assert held["bits"] == (3 * t // 4).bit_length()
        if before is not None:  # what a reader took before two runs and a vacuum is still there
            assert before.count() == 3 * (t - 1)
        before = ix.table("chunks")
        ix.vacuum(retain=0)
        sizes.append(sum(f.stat().st_size for f in root.rglob("*.parquet")) / (3 * t))
    assert max(sizes[3:]) < 2.5 * sizes[1] and len(list((root / "manifests").glob("*.json"))) == 2
    ix.update(rows(2, 9))
    assert {r.path for r in ix.table("meta").collect()} == {"n0.md", "n1.md"}
    assert ix.vacuum() == 0  # young files stay
    again = index.Index(spark, f"file://{root}")
    assert again.counts().first().asDict() == {"notes": 2, "chunks": 2, "facts": 0}


def test_parts_share_files(spark, tmp_path):
    """Folders and files don't grow with the parts; rows are the same whichever parts a run touches."""
    ix, want = index.Index(spark, f"file://{tmp_path}/ix", notes_per_part=1), {}
    for t, step in enumerate((1, 3, 50, 2), 1):
        want |= {f"n{i}.md": f"text {t} of the note {i}" for i in range(0, 300, step)}
        rows = [(p, c, float(c[5]), 9) for p, c in want.items()]
        ix.update(spark.createDataFrame(rows, "path string, content string, mtime double, size bigint"))
        table = ix.manifest()[1]["tables"]["chunks"]
        assert len(table["folders"]) <= t and sum(n for _, n in table["current"]) == 1 << index.SLOT_BITS
        assert {r.source_path: r.content.split("\n", 1)[1] for r in ix.table("chunks").collect()} == want
    assert ix.manifest()[1]["bits"] == 9 and len(list((tmp_path / "ix").rglob("*.parquet"))) < 100
    held = ix.manifest()[1]
    some = np.arange(1 << 9) % 3 == 0  # more spans than a condition holds
    got = {r.path for r in ix._read("meta", held, some).collect()}
    slot = {r.path: r.slot for r in spark.createDataFrame([(p,) for p in want], "path string").select("path", index._slot("path").alias("slot")).collect()}
    assert got == {p for p in want if (slot[p] >> (index.SLOT_BITS - 9)) % 3 == 0}


def test_settings_take_effect(spark, tmp_path):
    root = tmp_path / "v"
    put(root, **{"a.md": "First sentence is here now. " * 20 + "\n\nname: value"})
    (tmp_path / "c.yml").write_text(yaml.safe_dump({"vault": {"path": str(root), "watch": False}, "index": {"db_path": f"file://{tmp_path}/ix", "chunk_max_tokens": 20, "fact_extraction": False}, "undo": {"max_operations": 2}}))
    lake = api.Vault.from_settings(spark, str(tmp_path / "c.yml"))
    assert lake.start() is None
    assert lake.indexed.table("chunks").count() > 5 and lake.indexed.table("facts").count() == 0
    for i in range(4):
        lake.append("a.md", f"line {i}")
    assert lake.journal.size() == 2 and [lake.undo() for _ in range(3)] == ["Reverted append on: a.md"] * 2 + ["Nothing to undo."]


# -- model services


class Service(http.server.BaseHTTPRequestHandler):
    seen: list = []
    failing = 0

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.seen.append((self.path, self.headers["Authorization"], body))
        if Service.failing:
            Service.failing -= 1
            self.send_error(503)
            return
        if self.path.endswith("/embeddings"):
            data = [{"index": i, "embedding": [float(len(t)), float(i)]} for i, t in enumerate(body["input"])]
            random.Random(len(data)).shuffle(data)
            reply = {"data": data}
        else:
            reply = {"choices": [{"message": {"content": f"{body['model']}: {body['messages'][-1]['content']}"}}]}
        raw = json.dumps(reply).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.seen, Service.failing = [], 0
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_embedding_service(spark, service):
    texts = [("x" * i,) for i in range(1, 31)] + [("",), (None,)]
    got = providers.embedded(spark.createDataFrame(texts, "content string").coalesce(1), providers.HttpEmbedder(service, "m", "key", 2, batch_size=7)).collect()
    assert [r.embedding for r in got] == [[float(len(t or "")), float(i % 7)] for i, (t,) in enumerate(texts)]
    assert sorted(len(b["input"]) for _, _, b in Service.seen) == [4, 7, 7, 7, 7]
    assert {(p, a, b["model"], b["dimensions"]) for p, a, b in Service.seen} == {("/v1/embeddings", "Bearer key", "m", 2)}


def test_services_are_tried_again(spark, service):
    Service.failing = 2
    chat = providers.HttpChat(service, roles={"router": {"model": "small", "max_tokens": 5}})
    assert chat.complete("router", [{"role": "user", "content": "hi"}], json_mode=True) == "small: hi"
    assert [b["response_format"]["type"] for _, _, b in Service.seen] == ["json_object"] * 3
    Service.failing = 99
    lost = providers.embedded(spark.createDataFrame([("a",)], "content string"), providers.HttpEmbedder(service, "m", tries=1))
    assert lost.first().embedding is None
    with pytest.raises(OSError):
        providers.HttpChat("http://127.0.0.1:9", tries=1, timeout=0.2).complete("router", [])


def test_index_with_services(spark, tmp_path, service):
    class Facts:
        def complete(self, role, messages, json_mode=False):
            assert role == "extractor"
            return '[{"entity": "E", "key": "k", "value": 1}]' if "one" in messages[-1]["content"] else "no"

    put(tmp_path / "v", **{"a.md": "text with one in it", "b.md": "text with two in it"})
    ix = index.Index(spark, f"file://{tmp_path}/ix", embedder=providers.HttpEmbedder(service, "m"), chat=Facts())
    assert tuple(ix.update_folder(f"{tmp_path}/v").first()) == (2, 0, 0, 2, 1, 0)
    assert [(r.path, r.entity, r.value) for r in ix.table("facts").collect()] == [("a.md", "E", "1")]
    assert {r.source_path: r.embedding[0] for r in ix.table("chunks").collect()} == {"a.md": 27.0, "b.md": 27.0}


# -- chunks by a tokenizer


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")
@pytest.mark.parametrize("most", [12, 40, 10_000])
def test_chunks_by_a_tokenizer(spark, most):
    """Pieces by plain code: sections that fit, else paragraphs, else sentences packed while they fit."""
    import base64
    import re

    import tiktoken

    from notelake.functions import tokens
    from notelake.operators import chunking

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    known = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = lambda t: len(known.encode_ordinary(t))
    rng = random.Random(1)
    word = lambda: rng.choice("the river Über stone 12345 snowflake <|endoftext|> antidisestablishmentarianism . ! ? 日本".split())
    say = lambda n: " ".join(word() for _ in range(n)).replace(" .", ".")
    notes = [(f"n{i}.md", "\n\n".join([say(rng.randint(0, 30))] + [f"## H{j}\n\n" + "\n\n".join(say(rng.randint(1, 60)) for _ in range(rng.randint(0, 3))) for j in range(3)])) for i in range(25)]
    notes += [("e.md", ""), ("f.md", "---\nk: v\n---\n"), ("g.md", "---\nk: v\n---\n" + say(100))]
    got = {}
    counter = tokens.TokenCounter.read(TOKENIZER)
    parsed = vault.parse(spark.createDataFrame(notes, "path string, content string"))
    for r in chunking.chunks(parsed, most, counter=counter).collect():
        got.setdefault(r.source_path, []).append((r.chunk_index, r.chunk_type, r.section_header, r.content))
    for r in parsed.select("path", "title", "body", "fm").collect():
        want = [("frontmatter", "", f"Note: {r.title}\nProperties:\n  k: v")] if r.fm else []
        parts = re.split(r"(?m)(?=^## )", r.body) if r.body else []
        for part in parts:
            head, text = ("", part) if not part.startswith("## ") else part.split("\n", 1) if "\n" in part else (part, "")
            head, text = head.removeprefix("## ").strip(), text.strip()
            pieces = []
            if text and size(text) <= most:
                pieces = [("section", text)]
            elif text:
                for p in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
                    if size(p) <= most:
                        pieces.append(("paragraph", p))
                        continue
                    now = ""
                    for x in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", p))):
                        if now and size(now + x) > most:
                            pieces.append(("paragraph", now))
                            now = ""
                        now += x
                    pieces += [("paragraph", now)] if now else []
            want += [(kind, head, f"Note: {r.title}\n" + (f"Section: {head}\n" if head else "") + t) for kind, t in pieces]
        assert [x[1:] for x in sorted(got.get(r.path, []))] == want, r.path
        assert [x[0] for x in sorted(got.get(r.path, []))] == list(range(len(want)))


# -- approximate search


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    v = spark.read.parquet(path)
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    ids, m = np.array([i for i, _ in rows]), np.array([e for _, e in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    planes = nearest.Projections(m.shape[1])
    got = nearest.near_k(v.where(F.col("vec_id") % 50 == 0), v, nearest.buckets(v, planes), planes).collect()
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        score = m @ m[ids == q][0]
        best = set(ids[np.lexsort((ids, -np.round(score, 12)))[:10]].tolist())
        hits += len(best & {r.id for r in got if r.query_id == q})
        total += 10
    assert hits / total >= 0.9
    assert all(r.score == pytest.approx(float(m[ids == r.query_id][0] @ m[ids == r.id][0]), abs=1e-6) for r in got[:200])


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, None]), (8, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    planes = nearest.Projections(2, tables=4, bits=2)
    got = nearest.near_k(v.where("vec_id = 1"), v, nearest.buckets(v, planes), planes, k=3).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in got] == [(1, 1), (8, 2), (2, 3)]


def test_near_pairs_are_no_rows(spark):
    """Copies share every bucket: their pairs meet inside tasks, not in a join, and repeated ids are rows of their own."""
    rows = [(i, [1.0, float(i % 7)]) for i in range(300)] + [(5, [0.5, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    planes = nearest.Projections(2, tables=4, bits=2)
    got = nearest.near_k(v.where("vec_id = 0"), v, nearest.buckets(v, planes), planes, k=3)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.query_id, r.rank, r.id) for r in got.orderBy("rank").collect()] == [(0, 1, 0), (0, 2, 7), (0, 3, 14)]
    twice = nearest.near_k(v.where("vec_id = 0"), v.where("vec_id = 5"), nearest.buckets(v.where("vec_id = 5"), planes), planes, k=9, probes=2)
    assert twice.count() == 2


def test_few_whole_texts_reach_an_embedding_task_at_once(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        got = providers.embedded(spark.range(5000).select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("content")))
        assert int(spark.conf.get(key)) == providers.TEXTS < 5000
        assert got.where(F.size("embedding") == 64).count() == 5000
        assert providers._placed.cache_info().maxsize == providers.WORDS
    finally:
        spark.conf.set(key, before)


# -- ignore files


def test_ignore_rules(spark, tmp_path):
    put(tmp_path, **{".ignore": "*.tmp.md\n!keep.tmp.md\n/top.md\nbuild/\n**/deep/*.md\na/**\n\\#x.md\n[ab]?.md\n  \n# no\n", "sub__.ignore": "x.md\n!b1.md\n/only.md\n", "sub__.rgignore": "!x.md\n", ".gitignore": "git.md\n"})
    cases = {
        "y.tmp.md": True, "sub/y.tmp.md": True, "keep.tmp.md": False, "top.md": True, "sub/top.md": False, "build/x/y.md": True, "sub/build/y.md": True, "build.md": False, "p/deep/q.md": True,
        "p/deep/r/q.md": False, "a/b/c.md": True, "a.md": False, "#x.md": True, "a1.md": True, "c1.md": False, "a11.md": False, "sub/x.md": False, "x.md": False, "sub/b1.md": False, "sub/q/b1.md": False,
        "sub/only.md": True, "sub/q/only.md": False, "only.md": False, "git.md": False,
    }
    notes = spark.createDataFrame([(p,) for p in cases], "path string")
    rules = ignore.read(spark, str(tmp_path))
    got = {r.path: r.x for r in notes.select("path", ignore.ignored(F.col("path"), rules).alias("x")).collect()}
    assert got == cases
    with_git = ignore.read(spark, str(tmp_path), ignore.NAMES)
    assert ignore.visible(notes, with_git).where("path = 'git.md'").count() == 0 and ignore.visible(notes, []).count() == len(cases)
    put(tmp_path, **{"c1.md": "word", "a1.md": "word"})
    assert [r.path for r in api.Vault(spark, str(tmp_path)).search("word", "text").collect()] == ["c1.md"]


# -- the watcher


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


EVENTS = "ts timestamp, vault string, path string, change_type string"


def feed(spark, where, batches):
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(where)
        time.sleep(1.1)  # files are taken by their times


def test_watched_batches(spark, tmp_path):
    """The pause is global, files that are no notes prolong it, late events join batches, and a restart goes on."""
    log, runs = f"{tmp_path}/log", []
    feed(spark, log, [
        [(at(0), "v", "a.md", "created"), (at(2), "v", "a.md", "modified"), (at(4), "v", "x.txt", "modified"), (at(6.5), "v", "b.md", "created")],
        [(at(20), "v", "c.md", "created"), (at(5), "v", "b.md", "deleted"), (at(20), "w", "c.md", "created"), (at(23.5), "v", "d.md", "created")],
    ])
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(log)
    note = lambda paths: runs.append(sorted(r.path for r in paths.collect()))
    changes.watch(stream(), note, f"{tmp_path}/ck", "3 seconds", "5 seconds", available_now=True).awaitTermination()
    assert runs == [["a.md", "b.md"]]
    feed(spark, log, [[(at(21.5), "v", "e.base", "created"), (at(40), "v", "f.md", "created")], [(at(100), "v", "g.md", "created"), (at(100), "w", ".h/e.md", "created"), (at(1), "v", "late.md", "created")]])
    changes.watch(stream(), note, f"{tmp_path}/ck", "3 seconds", "5 seconds", available_now=True).awaitTermination()
    assert runs[1:] == [["c.md", "d.md"], ["c.md"], ["f.md"]]


class Kept(dict):
    """A state variable in memory that counts its calls."""

    calls = 0

    def counted(f):  # noqa: N805
        def call(self, *a):
            Kept.calls += 1
            return f(self, *a)

        return call

    updateValue, getValue = counted(dict.__setitem__), counted(dict.get)
    removeKey, containsKey = counted(dict.pop), counted(dict.__contains__)
    iterator, keys = (lambda self: iter(list(self.items()))), (lambda self: iter(list(dict.keys(self))))
    exists, get, update = (lambda self: 0 in self), (lambda self, *a: dict.get(self, *(a or (0,)))), (lambda self, v: self.__setitem__(0, v))


class Store(dict):
    def getMapState(self, name, *_):
        return self.setdefault(name, Kept())

    getValueState = getMapState
    listTimers = lambda self: ()
    registerTimer = deleteTimer = lambda self, at: self.__setitem__("timer", at)


@pytest.mark.parametrize("most", [1 << 20, 64])
def test_changes_are_held_in_blocks(monkeypatch, most):
    """The watcher's calls of the state store follow the Arrow batches, not the changes; the last changes are a plain reading's."""
    monkeypatch.setattr(changes, "HELD", most, raising=False)
    rng, gap, held, got, want, seen = random.Random(5), 1_000_000, changes.Settling(1_000_000), [], {}, []
    held.init(Store())
    clock = lambda now: type("Timers", (), {"getCurrentWatermarkInMs": lambda self: now // 1000})()
    Kept.calls = 0
    for step in range(4):
        rows = [(step * 40_000_000 + rng.randrange(50) * 900_000, rng.choice([None, *(f"p{i}.md" for i in range(40))]), rng.choice("xyz")) for _ in range(2_000)]
        rows = [r for r in rows if (r[0] // 900_000) % 7] + [(None, "p.md", "x")]
        seen += rows[:-1]
        frames = [pd.DataFrame(rows[i : i + 500], columns=["us", "path", "change_type"]) for i in range(0, len(rows), 500)]
        assert not list(held.handleInputRows(("v",), iter(frames), None))
        got += [f for f in held.handleExpiredTimer(("v",), clock(step * 40_000_000), None)]
    got += list(held.handleExpiredTimer(("v",), clock(10**12), None))
    start = before = None
    ends = {}
    for us, path, change in sorted(seen, key=lambda r: r[0]):
        start = us if before is None or us - before > gap else start
        before = ends[start] = us
        if path:
            want[start, path] = max(want.get((start, path), (us, "")), (us, change))
    rows = [(r.start.value // 1000, r.end.value // 1000, r.path, r.change_type) for f in got for r in f.itertuples()]
    assert len(ends) > 10 and sorted(rows) == sorted((s, ends[s] + gap, p, c) for (s, p), (_, c) in want.items())
    assert not held.blocks and not held.open
    if most > len(seen):
        assert Kept.calls < len(seen) / 10


def test_batches_of_a_table(spark):
    rng, rows = random.Random(2), []
    for key in ("a", "b"):
        now = 0
        for _ in range(400):
            now += rng.choice([0, 0, 1, 2, 3, 4, 500, 4000, 90000])
            rows.append((at(now), key, f"p{rng.randint(0, 5)}", rng.choice("xyz")))
    rows.append((None, "a", "p", "x"))
    table = spark.createDataFrame(rows, EVENTS)
    want, last = [], {}
    for key in ("a", "b"):
        mine = sorted((r for r in rows if r[1] == key and r[0]), key=lambda r: r[0])
        start = before = None
        for ts, _, path, change in mine:
            if before is None or ts - before > dt.timedelta(seconds=3):
                start = ts
                want.append([key, start, ts, 0, set()])
            before = want[-1][2] = ts
            want[-1][3] += 1
            want[-1][4].add(path)
            last[key, start, path] = max(last.get((key, start, path), (ts, "")), (ts, change))
    got = changes.debounced(table).collect()
    assert sorted((r.vault, r.start, r.end, r.n_changes, r.n_paths) for r in got) == sorted((k, s, e + dt.timedelta(seconds=3), n, len(p)) for k, s, e, n, p in want)
    got = {(r.vault, r.start, r.path): r.change_type for r in changes.last_changes(table).collect()}
    assert got == {k: c for k, (_, c) in last.items()}


def test_changes_of_a_folder_are_logged(spark, tmp_path):
    root, log = tmp_path / "v", f"{tmp_path}/log"
    put(root, **{"a.md": "one", "b.md": "two", ".x__c.md": "no"})
    none = spark.createDataFrame([], "path string, size long, mtime double")
    changes.log_changes(spark, str(root), none, log).write.parquet(f"{tmp_path}/seen")
    put(root, **{"a.md": "one more", "d.md": "new"})
    os.remove(root / "b.md")
    changes.log_changes(spark, str(root), spark.read.parquet(f"{tmp_path}/seen"), log).count()
    rows = spark.read.parquet(log).collect()
    assert sorted((r.path, r.change_type) for r in rows) == [("a.md", "created"), ("a.md", "modified"), ("b.md", "created"), ("b.md", "deleted"), ("d.md", "created")]


# -- the journal


def test_journal_is_shared_and_bounded(spark, tmp_path):
    root = f"file://{tmp_path}/j"
    one, two = journal.Journal(spark, root, keep=5, spare=4), journal.Journal(spark, root, keep=5, spare=4)
    assert one.size() == 0 and one.recent().collect() == []
    for i in range(12):
        (one, two)[i % 2].record(f"m{i // 3}", f"p{i}.md", "append", f"before {i}", f"after {i}")
    assert [r.path for r in two.recent(3).collect()] == ["p9.md", "p10.md", "p11.md"] and one.size() == 5
    assert len(list((tmp_path / "j" / "ops").glob("*.json"))) <= 10
    plan = lambda: len(one.rows._jdf.queryExecution().analyzed().toString())
    size = plan()
    one.record("m9", "q.md", "create", None, "x")
    assert plan() == size
    two.take_back([r.seq for r in two.rows.where("message_id = 'm9'").collect()])
    assert [r.path for r in one.recent(1).collect()] == ["p11.md"]
    one.compact()
    assert [r.path for r in two.recent(2).collect()] == ["p10.md", "p11.md"]
    assert one.record("m10", "r.md", "create", None, "x") > 13 and two.recent(1).first().path == "r.md"


def test_undo_in_a_new_process(spark, tmp_path):
    put(tmp_path / "v", **{"a.md": "one\n"})
    first = api.Vault(spark, f"{tmp_path}/v")
    assert first.append("a.md", "two") == "Appended to a.md."
    assert first.create("b.md", "text", '{"k": 1}') == "Created: b.md"
    assert first.patch("b.md", '[{"action": "insert", "line": 1, "content": "x"}]') == "Patched b.md: 1 operation(s) applied."
    assert first.update_frontmatter("a.md", '{"n": 1}') == "Updated frontmatter on a.md: n"
    assert first.delete("a.md") == "Deleted: a.md (6 lines)"
    again = api.Vault(spark, f"{tmp_path}/v")
    assert [r.name for r in again.ls().collect()] == ["b.md"]
    assert again.undo() == "Restored deleted file: a.md" and again.undo() == "Reverted frontmatter on: a.md"
    assert again.undo() == "Reverted patch on: b.md" and again.undo() == "Deleted created file: b.md"
    assert first.undo() == "Reverted append on: a.md" and again.undo() == "Nothing to undo."
    assert (tmp_path / "v" / "a.md").read_text() == "one\n" and not (tmp_path / "v" / "b.md").exists()


def test_texts_of_bases(spark, tmp_path):
    put(tmp_path, **{"x__One.base": "filters:\n  or:\n    - a == 1\nviews:\n  - {name: V, order: [file.name], sort: [{property: file.name, direction: DESC}]}\n", "Bad.base": "filters: x\n", "n.md": "text"})
    lake = api.Vault(spark, str(tmp_path))
    assert api.render_bases(lake.base_list()) == "One (x/One.base)\n  filters (or): a == 1\n  view V: file.name"
    shown = json.loads(api.render_base("x/One.base", lake.base_read("x/One.base")))
    assert shown == {"name": "One", "path": "x/One.base", "filter_logic": "or", "filters": ["a == 1"], "views": [{"name": "V", "type": "table", "columns": ["file.name"], "sort": [{"property": "file.name", "direction": "DESC"}]}]}
    assert lake._first_base() == "Bad.base" and lake.search("x", "base").collect() == []
    with pytest.raises(FileNotFoundError):
        lake.base_read("none.base")
