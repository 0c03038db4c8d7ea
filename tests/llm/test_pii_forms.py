"""fit_trees and find_pii end to end on forms that the base patterns don't take."""

from pathlib import Path

import pytest

from notelake.llm import pii
from notelake.llm.common import shared_dir


def table(spark, n, share):
    """n documents of base forms, of which a share hold other forms, and numbers that are neither."""
    every = round(1 / share)
    out = []
    for i in range(n):
        base = f"mail me x{i}@y.org or server 10.0.{i % 250}.7 or +1 555 010 {1000 + i % 9000} today"
        other = f"contact ann{i} [at] site [dot] com and host 10[.]9[.]{i % 250}[.]3 or phone 030-555-{1000 + i % 9000} now"
        odd = f"part 200-555-{1000 + i % 9000} of 300[.]400[.]{500 + i % 400}[.]999 here"
        out.append((i, other if i % every == 0 else base if i % 4 else odd))
    return spark.createDataFrame(out, "doc_id long, text string"), [i for i in range(n) if i % every == 0], [i for i in range(n) if i % every and not i % 4]


@pytest.mark.parametrize("share", [0.02, 0.5])
def test_other_forms_are_added_at_any_share(spark, share):
    df, other, odd = table(spark, 1500, share)
    found = {r.doc_id: {(r.t[x.s : x.e], pii.KINDS[x.k]) for x in r.spans} for r in pii.find_pii(df).collect()}
    for i in other:
        want = {(f"ann{i} [at] site [dot] com", "email"), (f"10[.]9[.]{i % 250}[.]3", "ip"), (f"030-555-{1000 + i % 9000}", "phone")}
        assert want <= found[i], (i, found[i])
    assert all(k != "phone" for i in odd for _, k in found[i])


def test_all_documents_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(pii, "TRAIN_DOCS", 1, raising=False)
    _, limits = pii.fit_trees(table(spark, 400, 0.02)[0])
    assert all(x < float("inf") for x in limits.values())


def test_texts_are_searched_once(spark):
    df = table(spark, 200, 0.02)[0]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    assert pii.find_pii(df.mapInArrow(counted, df.schema)).count() == 200
    assert read.value == 200


def test_a_fit_leaves_no_copy_of_the_texts(spark):
    root = Path(shared_dir(spark).removeprefix("file://"), "notelake")
    before = set(root.glob("pii_candidates-*"))
    pii.fit_trees(table(spark, 100, 0.02)[0])
    assert root.is_dir() and set(root.glob("pii_candidates-*")) == before
