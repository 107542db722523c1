"""What a first version of the operators left out."""

from __future__ import annotations

import random

from deltaplane.llm import licenses, queries, substring

SCHEMA = "doc_id bigint, text string"


def words(rnd: random.Random, n: int) -> list[str]:
    return [f"w{rnd.randrange(10**9)}" for _ in range(n)]


def passages(spark, docs: dict[int, list[str]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    out = {}
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], SCHEMA)
    for r in substring.shared_passages(rows).collect():
        out.setdefault((r["doc_id"], r["other_id"]), []).append((r["start"], r["end"]))
    return out


def test_partners_beyond_the_first(spark):
    """A passage is found whose parts stand in earlier documents of their own, though both neighbours hold parts as well."""
    rnd = random.Random(1)
    p, q = words(rnd, 50), words(rnd, 60)
    docs = {1: p[:25] + words(rnd, 9), 2: p[25:], 3: words(rnd, 7) + p, 4: words(rnd, 3) + p[:25], 5: p[25:], 6: p + words(rnd, 20)}
    docs |= {11: q[:20], 12: q[20:40], 13: q[40:], 14: [*q[:30], "changed", *q[31:]], 15: words(rnd, 4) + q}
    got = passages(spark, docs)
    assert got[6, 3] == [(0, 50)] and got[15, 14] == [(4, 64)] and set(got) == {(6, 3), (15, 14)}


def test_passages_behind_a_gap(spark):
    """A chain goes on where its first alignment ends."""
    rnd = random.Random(2)
    stray, p, q, r = (words(rnd, n) for n in (5, 500, 60, 70))
    docs = {1: stray + words(rnd, 35) + p, 2: stray + words(rnd, 35) + p, 11: q + words(rnd, 100) + r, 12: q + words(rnd, 100) + r}
    assert {k: sorted(v) for k, v in passages(spark, docs).items()} == {(2, 1): [(40, 540)], (12, 11): [(0, 60), (160, 230)]}


def test_evenly_spaced_changes(spark):
    """Passages of 60 words, every 6th to 10th changed, and one of 50 words with a single run of five, are all found."""
    rnd = random.Random(4)
    docs = {}
    for k in range(40):
        p = words(rnd, 60)
        changed = [f"x{k}" if i % (6 + k % 5) == 5 else w for i, w in enumerate(p)]
        docs |= {2 * k: words(rnd, 20) + p + words(rnd, 20), 2 * k + 1: words(rnd, 10) + changed + words(rnd, 10)}
    p = words(rnd, 50)
    docs |= {100: words(rnd, 9) + p + words(rnd, 9), 101: words(rnd, 9) + [f"y{i}" if i in (4, 9, 14, 19, 24, 29, 34, 39, 45) else w for i, w in enumerate(p)] + words(rnd, 9)}
    assert set(passages(spark, docs)) == {(2 * k + 1, 2 * k) for k in range(40)} | {(101, 100)}


def test_notices_side_by_side(spark):
    """A notice counts though the document is full of rarer words of other notices."""
    gpl, mit = licenses.NOTICES["gpl-notice"][0], licenses.NOTICES["mit-line"][0]
    rare = "redistribution unencumbered foundation documentation compliance mozilla creative attribution international domain"
    every = " . ".join(n for n, _ in licenses.NOTICES.values())
    rows = [(1, f"{gpl} x {mit}"), (2, " x ".join(rare.split()) + " x " + mit), (3, every)] + [(i, mit) for i in range(10, 30)]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.licence_scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {"gpl-notice", "mit-line"} <= got[1] and "mit-line" in got[2] and set(licenses.NOTICES) <= got[3]


def test_training_order_is_a_query(spark, tmp_path):
    """op7's rows come from the training order, whose positions invert the integrated schedules."""
    rnd = random.Random(7)
    rows = [(i, " ".join(words(rnd, rnd.randrange(30))), f"s{i % 4}" if i % 9 else None) for i in range(90)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in queries.queries()["op7_curriculum"](spark, str(tmp_path)).collect()}
    placed = queries.queries()["op7_training_order"](spark, str(tmp_path)).collect()
    sums = dict.fromkeys(range(90), 0)
    for r in placed:
        sums[r["doc_id"]] += r["n_take"]
    assert taken == sums and [r["position"] for r in placed] == sorted(r["position"] for r in placed)
    for k, source in enumerate(["s0", "s1", "s2", "s3", None]):
        own = [r for r in placed if r["source"] == source]
        tape, slope, before = sum(r["n_take"] for r in own), (k % 3 + 1 - 2) / 2, 0
        for r in own:
            assert abs((1 - slope) * r["position"] + slope * r["position"] ** 2 - before / tape) < 1e-9
            before += r["n_take"]
