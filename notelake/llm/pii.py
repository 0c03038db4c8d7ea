"""Personal data: base patterns, and further spans chosen by boosted trees (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import discard, materialize, text_of

KINDS = ("email", "ip", "card", "phone")
#: Held-out precision that a generator's threshold must reach, and positives it must be seen on.
PRECISION, SUPPORT = 0.95, 20
#: Characters of context on each side of a candidate.
CONTEXT = 32

# The base patterns, each written so that matching is linear. A run that can't
# match from its start can't match from within, so starts inside a run are skipped, except just
# after the previous match; repeats that can't give back are possessive.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap tests that a text must pass to hold a match at all.
_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# High-recall generators of further candidates, by kind.
LOOSE = (
    ("email", r"[A-Za-z0-9._%+-]{1,64}(?:\s?[\[(]\s?(?i:at|@)\s?[\])]\s?|@|\s(?i:at)\s)[A-Za-z0-9-]{1,63}(?:(?:\s?[\[(]\s?(?i:dot|\.)\s?[\])]\s?|\.|\s(?i:dot)\s)[A-Za-z]{2,24}){1,4}"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9.])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20./-]?[0-9]{4}){2}[\x20./-]?[0-9]{1,7}(?![0-9])"),
    ("phone", r"(?<![0-9])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])"),
)
_CUES = r"(?i)\b(?:e-?mail|mail|contact|call|tel|phone|fax|mobile|card|visa|iban|account|ip|host|server|address)\b"
#: Place, among a candidate's features, of whether it passes its kind's test.
PASSES = 8
_VERSION = r"(?i)\b(?:version|v|release|section|page|no|id|isbn|doi)\W{0,3}$"


def _matched(text: Column, pattern: str, keep, possible: Column | None = None) -> Column:
    """Matches of ``pattern`` as structs ``(s, e, m)`` that ``keep(m)`` accepts, by code points.

    The pieces between the matches give the offsets; sums run over blocks of 64 matches, so a
    text with very many matches costs no square.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    both = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("n"), m.alias("m")))

    add = lambda a, x: a + x

    def sums(width: Column) -> Column:
        """Running sums of ``width`` before each block of 64."""
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(width) - 1) / 64).cast("int")),
            lambda b: F.aggregate(F.slice(width, b * 64 + 1, 64), F.lit(0), add),
        )
        return F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
        )["all"]

    def spans(rows: Column, width: Column, before: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            block = F.floor(i / 64).cast("int")
            s = F.get(before, block) + F.aggregate(F.slice(width, block * 64 + 1, F.pmod(i, F.lit(64))), F.lit(0), add) + r["p"]
            return F.struct(s.alias("s"), (s + r["n"]).alias("e"), r["m"].alias("m"))

        return F.filter(F.transform(rows, one), lambda x: keep(x["m"]))

    def placed(rows: Column) -> Column:
        width = F.transform(rows, lambda r: r["p"] + r["n"])
        return _let(width, lambda w: _let(sums(w), lambda before: spans(rows, w, before)))

    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    out = _let(both, lambda rows: F.when(F.size(rows) > 0, placed(rows)).otherwise(empty))
    return out if possible is None else F.when(possible, out).otherwise(empty)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def weighed(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(F.pmod(i, F.lit(2)) == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), weighed), F.lit(0), lambda a, x: a + x), F.lit(10)) == 0


def _valid(kind: str):
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return lambda m: m.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        return lambda m: F.when(F.length(_digits(m)).between(12, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return lambda m: F.length(_digits(m)).between(9, 15)
    return lambda m: F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """Base spans of each kind: arrays of ``(s, e, m)``."""
    hint = {k: text.contains(h) if h else text.rlike("[0-9]") for k, h in _HINT.items()}
    return {k: _matched(text, BASE[k], _valid(k), hint[k]) for k in KINDS}


def _plain(m: Column, kind: str) -> Column:
    """A candidate written in its kind's base form."""
    if kind == "email":
        at = F.regexp_replace(m, r"\s?[\[(]\s?(?i:at|@)\s?[\])]\s?|\s(?i:at)\s", "@")
        return F.regexp_replace(at, r"\s?[\[(]\s?(?i:dot|\.)\s?[\])]\s?|\s(?i:dot)\s", ".")
    return F.regexp_replace(m, r"[\[\]()]", "") if kind == "ip" else m


def _passes(m: Column, kind: str) -> Column:
    """Whether a candidate, in base form, passes its kind's test: the form of a name, ranges, check digits or counts."""
    plain = _plain(m, kind)
    return plain.rlike(rf"\A{BASE['email']}\z") if kind == "email" else _valid(kind)(plain)


def _features(text: Column, span: Column, generator: int) -> list[Column]:
    """Format and context of a candidate, as small integers."""
    m, s, e = span["m"], span["s"], span["e"]
    before = F.substring(text, F.greatest(F.lit(1), s - CONTEXT + 1), F.least(F.lit(CONTEXT), s))
    after = F.substring(text, e + 1, F.lit(1))
    yes = lambda c: F.when(c, 1).otherwise(0)
    return [
        F.lit(generator),
        F.least(F.length(_digits(m)), F.lit(20)),
        yes(m.rlike(r"[\x20]")) + 2 * yes(m.rlike(r"[().\[\]-]")),
        F.least(F.length(m) / 4, F.lit(10)).cast("int"),
        yes(m.startswith("+")) + 2 * yes(m.contains("@")) + 4 * yes(m.rlike(r"[\[(]")),
        yes(before.rlike(_CUES)) + 2 * yes(before.rlike(_VERSION)),
        F.when(before.rlike(r"[A-Za-z0-9]\z"), 2).when(before.rlike(r"\s\z"), 0).otherwise(1),
        F.when(after.rlike(r"[A-Za-z0-9]"), 2).when(after.rlike(r"\s"), 0).otherwise(1),
        yes(_passes(m, LOOSE[generator][0])),
    ]


def _loose(text: Column, k: int) -> Column:
    kind, pattern = LOOSE[k]
    hint = text.rlike("[0-9]") if kind != "email" else text.rlike(r"@|(?i:[\[(\s]\s?at\s?[\])\s])")
    return _matched(text, pattern, lambda m: F.lit(True), hint)


def _overlaps(spans: Column, x: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))


def _all_base(b: dict[str, Column]) -> Column:
    return F.flatten(F.array(*[F.transform(b[k], lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS]))


def _spoilt(m: Column) -> Column:
    """A number whose last digit is another one."""
    return F.concat(F.left(m, F.length(m) - 1), F.pmod(F.right(m, F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))


def _variants(kind: str, m: Column) -> Column:
    """Other forms of a base span as ``(lead, m, tail, y)``: the same datum as people disguise or join it, or with ``y`` 0 no datum.

    ``lead`` and ``tail`` go around the form ``m``: a neighbouring number that hides it from the base pattern, or a word that
    announces something else.
    """
    form = lambda x, lead="", tail="", y=1: F.struct(
        F.lit(lead).alias("lead"), (F.lit(x) if isinstance(x, str) else x).alias("m"), F.lit(tail).alias("tail"), F.lit(y).alias("y")
    )
    digits = _digits(m)
    if kind == "email":
        at = lambda x, dot: F.concat(F.substring_index(m, "@", 1), F.lit(x), F.replace(F.substring_index(m, "@", -1), F.lit("."), F.lit(dot)))
        good = [form(at(" [at] ", ".")), form(at("(at)", "[dot]")), form(at("[at]", " [dot] ")), form(at(" at ", " dot "))]
        return F.array(*good, form("stayed at home.then", y=0), form("look at page.next", y=0))
    if kind == "ip":
        dotted = lambda dot: F.replace(m, F.lit("."), F.lit(dot))
        bad = [form(F.concat(F.lit("9"), F.lpad(dotted("[.]"), 40, "9")), y=0), form(dotted("[.]"), lead="version ", y=0), form(dotted("(.)"), lead="section ", y=0)]
        return F.array(form(dotted("[.]")), form(dotted("(.)")), form(dotted("[.]"), lead="host "), *bad)
    if kind == "card":
        by = lambda d, sep: F.regexp_replace(d, r"(.{4})(?=.)", f"$1{sep}")
        number = "7536784127813050 "
        good = [form(by(digits, ".")), form(by(digits, "/")), form(digits, lead=number), form(by(digits, "-"), lead=number), form(digits, tail=" 4012 8888 8888 1882")]
        bad = [form(by(_spoilt(digits), ".")), form(by(_spoilt(digits), "/")), form(_spoilt(digits)), form(_spoilt(digits), lead=number), form(by(_spoilt(digits), " "))]
        return F.array(*good, *[x.withField("y", F.lit(0)) for x in bad], form(digits, lead="ISBN 7536784127813050 no. ", y=0))
    local = F.regexp_replace(m, r"\A\+[0-9]{1,3}[\x20.-]?", "")
    foreign = F.regexp_replace(m, r"\A\+", "00")
    by = lambda sep: F.regexp_replace(F.regexp_replace(local, r"[()]", ""), r"[\x20.-]+", sep)
    good = [form(foreign), form(m, tail=" 190.137.223.204"), form(m, tail=" 7536784127813050")]
    good += [form(x, lead=lead) for x, lead in ((local, "call "), (local, "phone: "), (by("-"), "phone "), (by("-"), "fax: "), (by("."), "tel. "), (by(" "), "mobile "))]
    bad = [(local, ""), (by("-"), ""), (by("."), ""), (by(" "), ""), (local, "section "), (by("-"), "version "), (foreign, "id: "), (by("-"), "isbn ")]
    return F.array(*good, *[form(x, lead=lead, y=0) for x, lead in bad])


def planted_variants(docs: DataFrame) -> DataFrame:
    """``(doc_id, kind, t, s, e, y)``: each base span of ``docs(doc_id, t)`` in other forms, within its own surroundings.

    Only forms that the base patterns don't find there. A phone or an email in a form that is no datum by itself may well be one after a word that
    announces it: where the surroundings have such a word, it is left out.
    """
    return _planted(_with_base(docs))


def _with_base(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, t)`` with the base spans of each kind."""
    return docs.select("doc_id", "t", *[c.alias(f"b_{k}") for k, c in base_spans(F.col("t")).items()])


def _planted(found: DataFrame) -> DataFrame:
    """``planted_variants`` of ``_with_base``'s result."""
    rows = []
    for kind in KINDS:
        seen = found.select("doc_id", "t", F.explode(f"b_{kind}").alias("b")).select("doc_id", "t", "b", F.explode(_variants(kind, F.col("b.m"))).alias("v"))
        before = F.substring(F.col("t"), F.greatest(F.lit(1), F.col("b.s") - 2 * CONTEXT + 1), F.least(F.lit(2 * CONTEXT), F.col("b.s")))
        after = F.substring(F.col("t"), F.col("b.e") + 1, F.lit(2 * CONTEXT))
        s = F.length(before) + F.length("v.lead")
        if kind in ("email", "phone"):
            seen = seen.where((F.col("v.y") == 1) | (F.col("v.lead") != "") | ~F.right(before, F.lit(CONTEXT)).rlike(_CUES))
        put = seen.select(
            "doc_id", F.lit(kind).alias("kind"), F.concat(before, "v.lead", "v.m", "v.tail", after).alias("t"), s.alias("s"), (s + F.length("v.m")).alias("e"), F.col("v.y").alias("y")
        )
        rows.append(put)
    every = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    hidden = ~_overlaps(_all_base(base_spans(F.col("t"))), F.struct(F.col("s").alias("s"), F.col("e").alias("e")))
    return every.where(hidden)


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, t, b_<kind>, c_<generator>)`` of every row of ``docs(doc_id, text)``: base spans as ``(s, e, m)``, candidates clear of them as ``(s, e, f)``.

    ``f`` has a candidate's features. All that learning and scoring need of the whole texts, so that each text is searched once.
    """
    found = _with_base(docs.select("doc_id", text_of(docs).alias("t")))
    found = found.withColumn("base", _all_base({k: F.col(f"b_{k}") for k in KINDS}))
    clear = lambda x: ~_overlaps(F.col("base"), x)
    seen = lambda g: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.array(*_features(F.col("t"), x, g)).alias("f"))
    more = [F.transform(F.filter(_loose(F.col("t"), g), clear), seen(g)).alias(f"c_{g}") for g in range(len(LOOSE))]
    return found.select("doc_id", "t", *[f"b_{k}" for k in KINDS], *more)


def _limit(model: boosting.Boosted, cells: list[boosting.Cell]) -> tuple[float, float]:
    """Smallest margin at which the held-out candidates reach PRECISION, and how many positives are there."""
    for m in sorted({model.margin(x) for x, _, _ in cells}):
        n, y = (sum(c[i] for c in cells if model.margin(c[0]) >= m) for i in (1, 2))
        if y and y >= PRECISION * n:
            return m, y
    return math.inf, 0.0


def fit_trees(docs: DataFrame) -> tuple[boosting.Boosted, dict[int, float]]:
    """Trees and a threshold per generator, from all documents with an id.

    Labels come from forms that are put where base spans stand (``planted_variants``): a candidate that is exactly such a
    form of its own kind is positive, one that only touches it, or touches a form that is no datum, is negative,
    and so are candidates of the texts themselves, clear of base spans, that fail their kind's test; those that pass it may be either and
    are left out. Trees fit on one half of the documents, by a hash of
    their ids, thresholds on the other; both see counts of feature combinations alone. A generator with under SUPPORT positives there takes the threshold of all generators together, even odds
    at least; where those have fewer too, it adds nothing.
    """
    found = materialize(candidates(docs), "pii_candidates")
    model = _fitted(found)
    discard(found)
    return model


def _fitted(found: DataFrame) -> tuple[boosting.Boosted, dict[int, float]]:
    """``fit_trees`` of the result of ``candidates``."""
    half = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)) == 0).alias("half")
    known = found.where("doc_id is not null")
    planted = materialize(_planted(known), "pii_forms").select("*", half)
    groups = []
    place = F.struct(F.col("s").alias("s"), F.col("e").alias("e"))
    for k, (kind, _) in enumerate(LOOSE):
        features = _features(F.col("t"), F.col("x"), k)
        names = [c.alias(f"f{i}") for i, c in enumerate(features)]
        real = known.select(half, F.explode(f"c_{k}.f").alias("f")).select("half", *[F.col("f")[i].alias(f"f{i}") for i in range(len(features))])
        groups.append(real.where(F.col(f"f{PASSES}") == 0).withColumn("y", F.lit(False)))
        touched = planted.select("half", "t", "kind", "y", place.alias("p"), F.explode(_loose(F.col("t"), k)).alias("x"))
        touched = touched.where((F.col("p.s") < F.col("x.e")) & (F.col("x.s") < F.col("p.e")))
        same = (F.col("p.s") == F.col("x.s")) & (F.col("p.e") == F.col("x.e")) & (F.col("kind") == kind) & (F.col("y") == 1)
        groups.append(touched.select("half", *names, same.alias("y")))
    table = groups[0]
    for g in groups[1:]:
        table = table.unionByName(g)
    cols = [c for c in table.columns if c.startswith("f")]
    counted = table.groupBy("half", *cols).agg(F.count("*").alias("n"), F.count_if("y").alias("y")).collect()  # a row a combination of features
    cells = {h: sorted((tuple(r[c] for c in cols), float(r["n"]), float(r["y"])) for r in counted if r["half"] == h) for h in (True, False)}
    model = boosting.fit(cells[True])
    own = {k: _limit(model, [c for c in cells[False] if c[0][0] == k]) for k in range(len(LOOSE))}
    pooled, support = _limit(model, cells[False])
    spare = max(pooled, 0.0) if support >= SUPPORT else math.inf
    return model, {k: limit if n >= SUPPORT else spare for k, (limit, n) in own.items()}


def _joined(spans: Column) -> Column:
    """Spans ``(s, k, e)`` sorted by start, then kind, as ``kind:start:end`` joined by commas."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    parts = F.transform(F.array_sort(F.array_distinct(spans)), lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(parts, ",")


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def _scored(trees: boosting.Boosted, limit: float):
    """Whether a candidate scores at or over its threshold."""
    return lambda x: trees.column([x["f"][i] for i in range(PASSES + 1)]) >= limit


def find_pii(docs: DataFrame, model: tuple[boosting.Boosted, dict[int, float]] | None = None) -> DataFrame:
    """Spans of personal data in every row of ``docs(doc_id, text)``, with the text.

    Base spans match a fixed pattern and pass its check (parts of an IP, Luhn, counts of digits);
    failing matches are dropped without a retry. High-recall generators propose further, possibly
    overlapping spans; those clear of base spans stay when the boosted trees score them at or over
    their generator's calibrated threshold, and of overlapping ones the first by start, then the
    longest. Offsets are code points, ends exclusive. Null counts as empty; texts without a match
    give empty arrays; repeated rows give repeated rows; other columns are ignored; an
    empty table gives an empty result.

    Returns ``(doc_id, t, n_email, n_ip, n_card, n_phone, base, spans)``; ``base`` and ``spans``
    are arrays of ``(s, k, e)``, k the kind's place in KINDS.
    """
    every = candidates(docs)
    if model is None:
        every = materialize(every, "pii_candidates")
        model = _fitted(every)
    trees, limits = model
    b = {k: F.col(f"b_{k}") for k in KINDS}
    base = F.flatten(F.array(*[_tagged(b[k], i) for i, k in enumerate(KINDS)])).alias("base")
    more = []
    for g, (kind, _) in enumerate(LOOSE):
        if not math.isfinite(limits.get(g, math.inf)):
            continue
        high = F.filter(f"c_{g}", _scored(trees, limits[g]))
        more.append(_tagged(high, KINDS.index(kind)))
    columns = ["doc_id", "t", *[F.size(b[k]).cast("long").alias(f"n_{k}") for k in KINDS], base]
    if not more:
        return every.select(*columns).withColumn("spans", F.col("base"))
    found = every.select(*columns, F.flatten(F.array(*more)).alias("more"))
    clear = lambda x: ~F.exists(
        F.col("more"),
        lambda o: (o["s"] < x["e"]) & (x["s"] < o["e"]) & ((o["s"] < x["s"]) | ((o["s"] == x["s"]) & ((o["e"] > x["e"]) | ((o["e"] == x["e"]) & (o["k"] < x["k"]))))),
    )
    return found.withColumn("spans", F.concat("base", F.filter("more", clear))).drop("more")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_pii``'s result."""
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def redact(found: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with every span replaced by its kind in brackets; of overlapping spans the first wins.

    A null text has become an empty one; texts without a span stay as they are; a row of ``found`` gives a row.
    """
    spans = F.array_sort("spans")
    label = lambda k: F.concat(F.lit("["), F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1), F.lit("]"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, x: F.when(
        x["s"] >= a["at"],
        F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(F.substring(F.col("t"), a["at"] + 1, x["s"] - a["at"]), label(x["k"]))).alias("out")),
    ).otherwise(a)
    done = F.aggregate(spans, start, step)
    tail = F.substring(F.col("t"), done["at"] + 1, F.length("t"))
    return found.select("doc_id", F.concat(F.array_join(done["out"], ""), tail).alias("text"))
