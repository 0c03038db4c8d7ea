"""Every corpus operator against a plain re-statement, on rows that try to break it."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from notelake.llm import boosting, exact_lsm, jaccard, langid, line_dedup, mixing, pii, quality_crf, sentencepiece_dropout, simhash, suffix_dedup, topk
from notelake.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, k long, t string, token string, rep int, fp int"
WORDS = "the of and river stone window Garden paper light seven north Über café 42 a.b@c.org 10.0.0.1 +49 170 1234567".split()


def rows(seed=1, n=60):
    """Ordinary texts, copies in other case, near copies, and every odd row."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 6))]
        out.append((i, "\n".join(lines), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None])))
    passage = " ".join(rng.choice(WORDS) for _ in range(150))
    out += [(n + i, f"intro {i} {passage} outro {i * 7}\nx\ny\nz\nw{i}", "en", "a") for i in range(6)]
    out += [(n + 10, out[0][1].upper(), "en", "b"), (n + 11, out[0][1], "de", "b"), (n + 12, out[1][1] + " end", None, None)]
    out += [(n + 20, None, None, None), (n + 21, "", "en", "b"), (n + 22, "   \n\t ", "en", ""), (n + 23, "word", "de", "a")]
    out += [(n + 24, "lorem ipsum dolor " * 4000, "en", "a"), (n + 25, "x" * 30000, None, "a"), (n + 26, "\n" * 500, "en", "b"), (None, "no id at all", "en", "b")]
    out += [out[3], out[3], (n + 27, "▁ <s> \x00 日本語 😀 é́", "en", "a")]
    return [(*r, None, "clash", 1, "clash", "clash", 2, 3) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_matches_plain_version(docs):
    got = simhash.near_duplicates(docs).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter((i, plain_fingerprint(t)) for i, t in texts)
    known = [(i, plain_fingerprint(t)) for i, t in texts if i is not None]
    links = [(a, b) for a, x in known for b, y in known if a < b and bin(x ^ y).count("1") <= 2]
    want = components([i for i, _ in known], links)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want


def test_simhash_long_text_is_read_in_blocks(monkeypatch):
    text = "alpha beta gamma delta " * 500 + "tail"
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 100)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("limit", [0, 32])
def test_links_of_a_dense_cluster(spark, limit, monkeypatch):
    """Both ways to link: pairs of small signatures, and shared neighbours of crowded ones."""
    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    reps = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")
    got = connected_components(simhash.link_fingerprints(reps)).collect()
    links = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    want = components(range(len(fps)), links)
    linked = {x for pair in links for x in pair}
    assert {r.v: r.component for r in got} == {i: c for i, c in want.items() if i in linked}


def test_components_of_a_long_path(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 901), (901, 901), (None, 3)], "a long, b long")
    got = {r.v: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {900: 900, 901: 900}


def test_keep_one_keeps_columns(docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 0 in ids and 71 not in ids


def test_exact_duplicates(docs):
    texts = [(r.doc_id, ascii_lower(r.text or "")) for r in docs.select("doc_id", "text").collect()]
    group = defaultdict(list)
    for i, t in texts:
        group[t].append(i)
    want = Counter()
    for i, t in texts:
        keep = max((x for x in group[t] if x is not None), default=None)
        want[(i, keep, len(group[t]), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in exact_lsm.exact_duplicates(docs).collect()) == want


def test_digest_index_compacts_and_finds(spark, docs, tmp_path):
    index = exact_lsm.DigestIndex(spark, f"file://{tmp_path}/lsm")
    rows_ = exact_lsm.digest_rows(docs).select("doc_id", "digest", "n_bytes", "sha")
    for i in range(5):
        index.add(rows_.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(5)) == i))
    assert [len(x) for x in index.levels] == [1, 1]
    total = index.entries().agg(F.sum("members"), F.count_distinct("digest")).first()
    assert total[0] == docs.count() and total[1] == rows_.select("digest").distinct().count()
    one = rows_.where("doc_id = 0").first()
    assert index.lookup([one.digest]).first().members == 2  # "Ü" and "ü" differ


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind != "ip" or all(int(p) < 256 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


ODD = [
    "a@b.co_x@d.e", "x@y.z@w.v", "é😀 a.b@c.d", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "00001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "+1 (988) 555-2485", "+1((((((", "++123456789", "a@@b.c", "1" * 3000, "a" * 20000, "4111111111111111 " * 200, None, "", "a@b.c.", "1 2 3 4 5 6 7 8 9 0 1 2 3",
]


def test_pii_base_spans(spark, docs):
    odd = spark.createDataFrame(list(enumerate(ODD, 1000)), "doc_id long, text string")
    every = docs.select("doc_id", "text").union(odd)
    got = pii.find_pii(every, (boosting.Boosted(), {})).select("doc_id", "t", "n_email", "n_ip", "n_card", "n_phone", "base").collect()
    assert len(got) == every.count()
    for r in got:
        want = plain_pii(r.t)
        assert sorted((s.s, s.k, s.e) for s in r.base) == want, r.t[:60]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
    first = pii.digests(pii.find_pii(odd, (boosting.Boosted(), {}))).where("doc_id = 1002").first()
    assert first.spans == "email:3:10" and first.base_sha256 == hashlib.sha256(b"email:3:10").hexdigest()


def test_pii_redacts(spark):
    texts = [f"call me at {a}-555-{b}" for a, b in zip(range(200, 260), range(1000, 1060), strict=True)] + [f"mail me x{i}@y.org or +1 555 010 {1000 + i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = (boosting.Boosted(base=1.0), {0: float("inf"), 1: float("inf"), 2: float("inf"), 3: 0.0})
    found = pii.find_pii(df, model)
    r = found.where("doc_id = 0").first()
    assert [(s.s, s.k, s.e) for s in r.spans] == [(11, 3, 23)] and r.base == []
    assert pii.redact(found).where("doc_id = 0").first().text == "call me at [phone]"


def card(rng):
    digits = [rng.randint(0, 9) for _ in range(15)]
    total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits))
    return "".join(map(str, digits)) + str(-total % 10)


def private(seed, n, first=0):
    """Texts with data in base forms, as the training rows have them."""
    rng, out = random.Random(seed), []
    for i in range(n):
        word = lambda: " ".join(rng.choice("river stone window paper light seven north".split()) for _ in range(rng.randint(1, 9)))
        ip = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        data = [f"{rng.choice('abc')}.b{i}@mail{i}.example.com", ip, card(rng), f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"]
        out.append((first + i, f"{word()} {rng.choice(data)} {word()}. {word()} {rng.choice(data)}, {word()} {rng.randint(0, 9)}{str(rng.random())[2:17]} {word()}"))
    return out


def test_pii_trees_find_hidden_forms(spark):
    """Trees that were fitted on some documents find other forms of the data in other documents, and leave what is none."""
    schema = "doc_id long, text string"
    model = pii.fit_trees(spark.createDataFrame(private(1, 400), schema))
    assert all(np.isfinite(x) for x in model[1].values())
    rest = spark.createDataFrame(private(2, 200, 1000), schema)
    forms = pii.planted_variants(rest.select("doc_id", F.col("text").alias("t"))).withColumn("id", F.monotonically_increasing_id()).cache()
    found = {r.doc_id: [(s.s, s.e) for s in r.spans] for r in pii.find_pii(forms.select(F.col("id").alias("doc_id"), F.col("t").alias("text")), model).collect()}
    hits = Counter()
    for r in forms.collect():
        hits[r.kind, r.y, (r.s, r.e) in found[r.id]] += 1
    for kind in pii.KINDS:
        good, lost, bad = hits[kind, 1, True], hits[kind, 1, False], hits[kind, 0, True]
        assert good > 20 and good >= 0.95 * (good + lost) and good >= 0.95 * (good + bad), (kind, hits)
    assert pii.fit_trees(rest.limit(0))[1] == {k: float("inf") for k in range(4)}


def plain_features(text, s, e, k):
    """What the trees see of a candidate, by plain code."""
    import regex

    m, before, after = text[s:e], text[max(0, s - pii.CONTEXT) : s], text[e : e + 1]
    kind, digits = pii.LOOSE[k][0], re.sub("[^0-9]", "", m)
    if kind == "email":
        at = regex.sub(r"\s?[\[(]\s?(?i:at|@)\s?[\])]\s?|\s(?i:at)\s", "@", m)
        ok = bool(regex.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", regex.sub(r"\s?[\[(]\s?(?i:dot|\.)\s?[\])]\s?|\s(?i:dot)\s", ".", at)))
    elif kind == "ip":
        ok = all(int(p) <= 255 for p in re.sub(r"[\[\]()]", "", m).split("."))
    elif kind == "card":
        total = sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, digits[::-1])))
        ok = 12 <= len(digits) <= 19 and total % 10 == 0
    else:
        ok = 9 <= len(digits) <= 15
    edge = lambda c: 2 if re.match("[A-Za-z0-9]", c or " ") else 0 if c and c in " \t\n\x0b\f\r" else 1
    return (
        k, min(len(digits), 20), (" " in m) + 2 * bool(re.search(r"[().\[\]-]", m)), int(min(len(m) / 4, 10)), m.startswith("+") + 2 * ("@" in m) + 4 * bool(re.search(r"[\[(]", m)),
        bool(re.search(pii._CUES, before)) + 2 * bool(re.search(r"(?i)\b(?:version|v|release|section|page|no|id|isbn|doi)\W{0,3}$", before)), edge(before[-1:]), edge(after), int(ok),
    )


def test_pii_selection(spark):
    """The spans that are added, against a search with the same trees by plain code."""
    import regex

    base_rows = private(3, 300)
    trees, limits = pii.fit_trees(spark.createDataFrame(base_rows, "doc_id long, text string"))
    forms = pii.planted_variants(spark.createDataFrame(private(4, 60), "doc_id long, t string")).collect()
    texts = [r.t for r in forms] + [t for _, t in private(5, 40)] + ["a at b.com (at) c.org", "1.2.3.4 [.] 1[.]2[.]3[.]4", "4111.1111.1111.1111/4111.1111.1111.1111 00491701234567", "", "555-123-4567 555 123 4567 call 555-123-4567"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (trees, limits)).collect()
    added = 0
    for r in rows:
        base, more = [(s, e) for s, _, e in plain_pii(r.t)], []
        for k, (kind, pattern) in enumerate(pii.LOOSE):
            for m in regex.finditer(pattern, r.t):
                clear = not any(s < m.end() and m.start() < e for s, e in base)
                if clear and trees.margin(plain_features(r.t, m.start(), m.end(), k)) >= limits[k]:
                    more.append((m.start(), -m.end(), pii.KINDS.index(kind), m.end()))
        kept = [x for x in more if not any(o[0] < x[3] and x[0] < o[3] and (o[0], o[1], o[2]) < (x[0], x[1], x[2]) for o in more)]
        want = sorted(plain_pii(r.t)) + sorted((s, k, e) for s, _, k, e in kept)
        assert sorted((s.s, s.k, s.e) for s in r.spans) == sorted(want), r.t
        added += len(kept)
    assert added > 50


def test_boosting_learns():
    cells = [((0, i), 100.0, 95.0 if i > 2 else 5.0) for i in range(6)]
    model = boosting.fit(cells)
    assert model.probability((0, 5)) > 0.85 and model.probability((0, 0)) < 0.15
    assert boosting.fit([]).probability((1, 1)) < 0.01


def plain_lines(texts, run=3, words=50):
    seen, gone = {}, defaultdict(set)
    for key, text in sorted(texts):
        a = text.split("\n")
        for n in range(1, run + 1):
            for s in range(len(a) - n + 1):
                w = tuple(a[s : s + n])
                if n < run and sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in w) < words:
                    continue
                if w in seen and seen[w] != (key, s):
                    gone[key].update(range(s, s + n))
                seen.setdefault(w, (key, s))
    return {key: (len(t.split("\n")), "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[key])) for key, t in texts}


def test_line_dedup(spark, docs):
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.n_lines, r.text) for r in line_dedup.dedup_lines(known).collect()}
    assert got == plain_lines([(r.doc_id, r.text or "") for r in known.select("doc_id", "text").collect()])
    say = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    short = [(1, say(1, 60)), (2, f"a\n{say(1, 60)}\nb"), (3, f"{say(2, 20)}\n{say(3, 40)}"), (4, f"x\n{say(2, 20)}\n{say(3, 40)}"), (5, say(2, 20)), (6, say(1, 60)), (7, say(4, 49)), (8, say(4, 49))]
    few = {r.doc_id: (r.n_lines, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(short, "doc_id long, text string")).collect()}
    assert few == plain_lines(short) and few[2] == (3, "a\nb") and few[4] == (3, "x") and few[6] == (1, "") and few[8][1] == short[7][1]
    every = line_dedup.dedup_lines(docs)
    assert every.columns == ["doc_id", "n_lines", "n_removed", "text"]
    # Rows without an id come first; those of one id go by their text's hash; equal rows are one place.
    place = lambda d, t: (-(1 << 63) if d is None else d, (xxhash.xxh64_intdigest(t, 42) ^ (1 << 63)) - (1 << 63))
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = plain_lines(sorted({(place(d, t), t) for d, t in rows}))
    assert sorted(((r.doc_id, r.n_lines, r.text) for r in every.collect()), key=str) == sorted(((d, *want[place(d, t)]) for d, t in rows), key=str)


def test_sentencepiece_is_lossless_and_seeded(docs):
    import sentencepiece

    a = {r.doc_id: r for r in sentencepiece_dropout.encode(docs, dropout=0.3, seed=1).collect()}
    b = {r.doc_id: r for r in sentencepiece_dropout.encode(docs, dropout=0.3, seed=1).collect()}
    c = {r.doc_id: r for r in sentencepiece_dropout.encode(docs, dropout=0.3, seed=2).collect()}
    assert all(r.lossless for r in a.values()) and a == b
    assert any(a[i].ids != c[i].ids for i in a)
    back = {r.doc_id: r.text for r in sentencepiece_dropout.decode(sentencepiece_dropout.encode(docs)).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert {i: t for i, t in back.items() if texts[i] is not None} == {i: t for i, t in texts.items() if t is not None}
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_dropout.DEFAULT_MODEL)
    plain = {r.doc_id: r.ids for r in sentencepiece_dropout.encode(docs, dropout=0.0).collect()}
    assert all(plain[i] == sp.encode(t) for i, t in texts.items() if t and "▁" not in t)


def plain_dropout(pieces, chunk, dropout, key):
    """The agenda by brute force: the best candidate of all, drawn or dropped, until none is left."""
    symbols, dropped = [(i, i + 1) for i in range(len(chunk))], set()
    while True:
        found = [(-pieces.scores[chunk[a:d]], a, b, d) for (a, b), (_, d) in zip(symbols, symbols[1:], strict=False) if chunk[a:d] in pieces.scores]
        found = [f for f in found if f[1:] not in dropped]
        if not found:
            return [i for a, b in symbols for i in ([pieces.ids[chunk[a:b]]] if chunk[a:b] in pieces.ids else [pieces.byte_ids[x] for x in chunk[a:b].encode()])]
        _, a, b, d = min(found)
        h = ((key ^ ((a * 0x9E3779B97F4A7C15 + d * 0xC2B2AE3D27D4EB4F) % 2**64)) * 0xFF51AFD7ED558CCD) % 2**64
        if (((h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53) % 2**64) ^ (h >> 40) < int(dropout * 2.0**64):
            dropped.add((a, b, d))
        else:
            symbols[symbols.index((a, b))] = (a, d)
            symbols.remove((b, d))


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_sentencepiece_follows_the_agenda(dropout):
    with open(sentencepiece_dropout.DEFAULT_MODEL, "rb") as f:
        enc = sentencepiece_dropout.Encoder(f.read(), dropout, 3)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlué.,xyz日") for _ in range(rng.choice([1, 3, 8, 15, 45])))
    texts = [" ".join(word() for _ in range(30)), "", " ", "▁", "a▁b ▁ c\n\n  d\n e 日本😀 \x00", "the " * 40, "x" * 90]
    keys = [rng.getrandbits(64) for _ in texts]
    ids, counts = enc.encode_many(texts, keys)
    want = []
    for text, key in zip(texts, keys, strict=True):
        chunks = [c for part in (" " + text).split("▁") for c in [*re.findall("\n|▁*[^▁\n]+|▁+", part.replace(" ", "▁")), None]][:-1]
        own = sentencepiece_dropout.chunk_keys(key, len(chunks)).tolist()
        want.append([i for c, k in zip(chunks, own, strict=True) for i in (enc.literal.tolist() if c is None else plain_dropout(enc.pieces, c, dropout, k))])
    assert [len(w) for w in want] == counts.tolist() and ids.tolist() == sum(want, [])
    assert all(enc.lossless(texts, ids, counts))
    if dropout:
        repeated = want[5]
        assert len({tuple(repeated[i : i + 2]) for i in range(0, 40)}) > 2  # a word's occurrences differ


@pytest.mark.parametrize("copies", [1_000, 2])
def test_sentencepiece_uses_depend_on_rows_alone(spark, monkeypatch, copies):
    """Equal rows side by side, apart, and in several parts have the same uses and ids; all uses differ."""
    monkeypatch.setattr(sentencepiece_dropout, "COPIES", copies)
    text = "a window of stone and light"
    rows = [(1, text)] * 5 + [(2, text), (None, None), (None, text), (None, text), (3, None), (3, None), (3, "")]
    schema, seen = "doc_id long, text string", []
    for order in (rows, rows[::-1], rows[::2] + rows[1::2]):
        for parts in (1, 4):
            df = spark.createDataFrame(order, schema).repartition(parts) if parts > 1 else spark.createDataFrame(order, schema).coalesce(1)
            seen.append(sorted(((r.doc_id, r.use, r.ids, r.lossless) for r in sentencepiece_dropout.encode(df, dropout=0.5).collect()), key=str))
    assert all(x == seen[0] for x in seen)
    assert sorted((str(d), u) for d, u, _, _ in seen[0]) == sorted([("1", i) for i in range(5)] + [("2", 0), ("None", 0), ("None", 0), ("None", 1), ("3", 0), ("3", 0), ("3", 1)])
    assert len({tuple(i) for d, _, i, _ in seen[0] if d == 1}) == 5 and all(f for *_, f in seen[0])
    given = spark.createDataFrame([(1, text, 4), (1, text, 0)], schema + ", epoch int")
    got = {r.use: r.ids for r in sentencepiece_dropout.encode(given, dropout=0.5, use="epoch").collect()}
    assert got == {u: i for d, u, i, _ in seen[0] if d == 1 and u in (0, 4)}


def plain_phrases(model, lang, text):
    """Greedy longest matches of the coded text in the coded training text, block by block."""
    train, coded, n = "".join(map(chr, lang)), "".join(map(chr, model.symbols.encode(text))), 0
    for at in range(0, len(coded), langid.BLOCK):
        part, i = coded[at : at + langid.BLOCK], 0
        while i < len(part):
            size = 1
            while i + size <= len(part) and part[i : i + size] in train:
                size += 1
            i += max(1, size - 1)
            n += 1
    return n


def test_langid_predicts():
    rng = random.Random(2)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    en, de = "the and of river stone light window".split(), "der und fluss stein licht fenster schön".split()
    model = langid.Model({"de": [say(de, 300)], "en": [say(en, 300)]})
    names, score = model.predict([say(en, 12), say(de, 12), None, "", "123 !!", "x" * 5000])
    assert names[:2] == ["en", "de"] and names[2:5] == ["und"] * 3 and ((score >= 0) & (score <= 1)).all()


def test_langid_counts_phrases_exactly(monkeypatch):
    text = "abracadabra abacus cabbage 日本語"
    model = langid.Model({"x": [text]})
    train = model.symbols.encode(text)
    for direct in (langid.DIRECT, 0):  # with 0, all but two symbols go by the hash table
        monkeypatch.setattr(langid, "DIRECT", direct)
        model._tables = None
        for t in ("abraabra", "zabz", "cabcabcab", "abracadabra abacus cabbage", "q", "日本語日本", "ab日本x"):
            assert model.phrases([model.symbols.encode(t)])[0, 0] == plain_phrases(model, train, t)


def test_langid_on_rows(docs, empty):
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[80] == by[81] == by[82] == by[86] == "und"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {80, 81, 82}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.identify(empty).count() == 0


def plain_marginals(score, bond):
    n = len(score)
    total = np.zeros(n)
    z = 0.0
    for m in range(1 << n):
        y = [(m >> i) & 1 for i in range(n)]
        w = np.exp(sum(s for s, b in zip(score, y, strict=True) if b) + bond * sum(a == b for a, b in zip(y, y[1:], strict=False)))
        z += w
        total += w * np.array(y)
    return total / z


def test_crf_marginals_are_exact():
    rng = np.random.default_rng(1)
    lines = np.array([1, 5, 3, 8])
    score = rng.normal(size=lines.sum())
    good, _ = quality_crf.marginals(score, 0.8, quality_crf.Layout(lines))
    at = 0
    for n in lines:
        assert np.allclose(good[at : at + n], plain_marginals(score[at : at + n], 0.8))
        at += n


def test_quality_learns_and_scores_odd_rows(spark, docs, empty):
    rng = random.Random(4)
    good = [(i, "\n".join(" ".join(rng.choice(WORDS[:9]) for _ in range(20)) + "." for _ in range(4))) for i in range(200, 300)]
    bad = [(i, "\n".join(" ".join(rng.choice(["BUY!!", "$$$", "###x"]) for _ in range(20)) for _ in range(4))) for i in range(300, 400)]
    df = spark.createDataFrame([(*r, *([None] * 9)) for r in good + bad], SCHEMA).unionByName(docs)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(200, 400)] + [(None, 1, 0), (200, None, 0)], "doc_id long, quality int, toxic int")
    labels = labels.withColumns({c: F.lit("clash") for c in ("text", "t", "lang", "source", "line", "features", "y")})
    got = {r.doc_id: r for r in quality_crf.score_quality(df, labels).collect()}
    held = [r for i, r in got.items() if i is not None and 200 <= i < 400 and r.held_out]
    assert held and np.mean([r.predicted == (r.doc_id < 300) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert quality_crf.score_quality(empty, labels).count() == 0
    assert {r.score for r in quality_crf.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_mixing_budgets(docs, empty):
    used = mixing.mix(docs, repetition=1.5).collect()
    tokens = {}
    for r in mixing.token_counts(docs).collect():
        tokens[r.source] = tokens.get(r.source, 0) + r.tokens
    plan = mixing.solve(list(tokens.values()), repetition=1.5)
    for source, total in tokens.items():
        share = int(total**plan.exponent / plan.normaliser * plan.budget) if total else 0
        got = sum(r.tokens for r in used if r.source == source)
        biggest = max((r.tokens for r in used if r.source == source), default=0)
        assert share <= got + 1e-9 and got < share + max(1, biggest) + 1, source
    assert mixing.mix(empty).count() == 0


def test_mixing_rows(spark, docs, tmp_path):
    """Row by row, null and repeated ids too, as the query's SQL has them."""
    import duckdb

    from notelake.llm.queries import ORACLES

    docs.select("doc_id", "text", "source").coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    cur = con.execute(ORACLES["op8_mixing"])
    names = [d[0] for d in cur.description]
    got = mixing.mix(docs, seed=1, repetition=2.0).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))


@pytest.mark.parametrize("epochs", [1_000, 3])
def test_mixing_to_an_entropy(spark, monkeypatch, epochs):
    """Plain code gives the same uses; a small source has very many epochs."""
    monkeypatch.setattr(mixing, "EPOCHS", epochs)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 5)
    data = [(i, "w " * (i % 4 + 1), "big") for i in range(60)] + [(100, "a b", "tiny"), (None, "c", "small"), (7, "x y z", "small"), (7, "x y z", "small")]
    used = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), seed=3, entropy=1.5).collect()
    sources = defaultdict(list)
    for d, t, s in data:
        sources[s].append((d, len(t.split())))
    plan = mixing.solve([sum(n for _, n in v) for v in sources.values()], entropy=1.5)
    sha = lambda *x: hashlib.sha256(":".join("null" if v is None else str(v) for v in x).encode()).hexdigest()
    want = Counter()
    for source, own in sources.items():
        total = sum(n for _, n in own)
        share = int(total**plan.exponent / plan.normaliser * plan.budget)
        count = -(-len(own) // 5)
        blocks = defaultdict(list)
        for d, n in own:
            h = sha(3, d)
            blocks[int(h[:8], 16) % count].append((h[8:], d if d is not None else -1, n))
        whole, rest = divmod(share, total)
        for epoch in range(1, whole + 2):
            done = 0
            for rank, b in enumerate(sorted(blocks, key=lambda b: sha(3, epoch, source, b)), 1):  # noqa: B023
                before = 0
                for _, d, n in sorted(blocks[b]):
                    if epoch <= whole or before < rest - done:
                        want[None if d == -1 else d, source, n, epoch, b, rank] += 1
                    before += n
                done += before
    assert Counter((r.doc_id, r.source, r.tokens, r.epoch, r.block, r.block_rank) for r in used) == want
    assert max(k[3] for k in want) > 9


def test_mixing_solves():
    even = mixing.solve([100, 900], entropy=1.0)
    assert even.exponent < 0.001
    limit = mixing.solve([100, 900], repetition=2.0)
    weights = [t**limit.exponent / limit.normaliser for t in (100, 900)]
    assert weights[0] * 1000 / 100 <= 2.0 and weights[0] * 1000 / 100 > 1.999
    whole = mixing.solve([100, 900], repetition=2.0, cover=True)
    assert min(t**whole.exponent / whole.normaliser * whole.budget / t for t in (100, 900)) == pytest.approx(1)
    assert mixing.solve([]).budget == 0 and mixing.solve([5], repetition=0.5).exponent == 1


def test_mixed_documents_cover_everything(docs):
    got = mixing.mixed_documents(docs, repetition=2.0, cover=True)
    assert got.columns == docs.columns
    times = Counter(r.doc_id for r in got.collect())
    own = Counter(r.doc_id for r in docs.collect())
    assert set(times) == set(own) and all(own[i] <= times[i] <= 3 * own[i] for i in own)


def plain_repeats(texts, n=400):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                covered[i : i + n] = b"\1" * n
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        spans = sum(c and (not i or not covered[i - 1]) for i, c in enumerate(covered))
        out.append((len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [0, 64])
def test_suffix_dedup(spark, limit, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORT_LIMIT", limit)
    rng = random.Random(8)
    texts = [(r[0], r[1]) for r in rows(seed=3)]
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    texts += [(500 + i, f"{i}" * 90 + passage[i * 20 : 450 + i * 25] + f"-{i}-" * 100) for i in range(9)]
    texts += [(600, passage[:399]), (601, passage[:400] + "é" * 300), (602, "ab" * 700)]
    texts = [x for x in texts if len(x[1] or "") < 20000] + [(603, "lorem ipsum " * 200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df).collect()
    want = plain_repeats([(t or "").encode() for _, t in texts])
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, *w) for (i, _), w in zip(texts, want, strict=True))


def test_suffix_sort_orders_and_survives_collisions(monkeypatch):
    words = [b"banana", b"bandana", b"ban", b"apple", b"banana"]
    items = [suffix_dedup.Suffix({"right": w, "left": b""}) for w in words]
    ordered, lcp = suffix_dedup.sort_suffixes(items)
    assert [s.right for s in ordered] == sorted(words) and lcp == [0, 3, 6, 3]
    same = np.zeros(8, np.uint64)
    assert suffix_dedup.common(b"abcx", same[:5], b"abdx", same[:5]) == 2


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 320)]
    vectors += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (450, [1e12] * 8), (451, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    q = topk.quantized(df)
    got = topk.top_k(q.where("vec_id % 50 = 0"), q, 5).collect()
    ok = {r.vec_id: r.v for r in q.collect()}
    assert {400, 401, 402, 403}.isdisjoint(ok)
    want = []
    for i in (x for x in ok if x % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ok[i], v, strict=True)), j) for j, v in ok.items() if j != i and len(v) == len(ok[i]))[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize(("tile", "shard"), [(1, 2), (2, 3), (512, 4096)])
def test_top_k_with_repeated_ids(spark, tile, shard, monkeypatch):
    monkeypatch.setattr(topk, "TILE_QUERIES", tile)
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    vectors = [(50, [1, 2]), (50, [1, 2]), (50, [2, 1]), (1, [1, 2]), (2, [5, 0]), (100, [1, 0]), (None, [3, 3])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], "vec_id long, embedding array<double>")
    q = topk.quantized(df, scale=1)
    got = topk.top_k(q.where("vec_id % 50 = 0"), q, 3).collect()
    rows, want = [(i, v) for i, v in vectors if i is not None], []
    for n, (i, v) in enumerate(rows):
        if i % 50 == 0:
            best = sorted((-(v[0] * w[0] + v[1] * w[1]), j) for m, (j, w) in enumerate(rows) if m != n)[:3]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize(
    "run",
    [simhash.near_duplicates, exact_lsm.exact_duplicates, exact_lsm.drop_duplicates, pii.find_pii, line_dedup.dedup_lines,
     sentencepiece_dropout.encode, langid.identify, langid.keep_identified, mixing.mix, mixing.mixed_documents, suffix_dedup.remove_repeats],
)
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_empty_vectors(spark):
    none = topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(none, none).count() == 0
