"""The pipeline's stages against brute force on a small table."""

from __future__ import annotations

import collections

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from deltaplane.llm import queries, simhash, substring
from deltaplane.llm._shared import materialise

FOLDER = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    frames, docs = {}, spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = frames[name] = materialise(stage(spark, docs, FOLDER), name)
    rows = {name: [r.asDict() for r in f.collect()] for name, f in frames.items()}

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    good = {d for d, kept in con.execute(f"SELECT doc_id, kept FROM ({queries.QUALITY_SQL})").fetchall() if kept}
    assert {r["doc_id"] for r in rows["quality_rules"]} == good and len(rows["quality_rules"]) == len(good)

    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in rows["quality_rules"]}
    least = {d: d for d in prints}
    for _ in prints:
        before = dict(least)
        for a in prints:
            least[a] = min(least[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4)
        if least == before:
            break
    assert sorted(r["doc_id"] for r in rows["near_dedup"]) == sorted(set(least.values()))

    was = {r["doc_id"]: r["text"].split() for r in rows["near_dedup"]}
    now = {r["doc_id"]: r["text"].split() for r in rows["substring_dedup"]}
    windows = collections.defaultdict(set)
    for d, w in was.items():
        for i in range(len(w) - 49):
            windows[tuple(x.lower() for x in w[i : i + 50])].add(d)
    held = {k: min(v) for k, v in windows.items()}
    for d, w in now.items():
        assert not collections.Counter(w) - collections.Counter(was[d])
        assert all(held.get(tuple(x.lower() for x in w[i : i + 50]), d) >= d for i in range(len(w) - 49)), d
    fuzzy = {r["doc_id"] for r in substring.shared_passages(frames["near_dedup"]).where("similarity < 1").collect()}
    alone = lambda w: all(len(windows[tuple(x.lower() for x in w[i : i + 50])]) == 1 for i in range(len(w) - 49))
    assert all(now.get(d) == w for d, w in was.items() if d not in fuzzy and alone(w))

    size = {r["doc_id"]: len(r["text"].split()) for r in rows["substring_dedup"]}
    source = {r["doc_id"]: r["source"] for r in rows["substring_dedup"]}
    taken = collections.Counter()
    for r in rows["mixing"]:
        n = len(r["text"].split())
        assert n <= size[r["doc_id"]]
        taken[source[r["doc_id"]]] += n
    whole = collections.Counter()
    for d, n in size.items():
        whole[source[d]] += n
    order = sorted(whole, key=lambda s: (s is None, s))
    weight, stopped = {s: i % 3 + 1 for i, s in enumerate(order)}, {}
    while True:
        rest = [s for s in order if s not in stopped]
        unit = (sum(whole.values()) - sum(stopped.values())) / sum(weight[s] for s in rest) if rest else 0
        more = {s: 3 * whole[s] for s in rest if weight[s] * unit > 3 * whole[s]}
        if not more:
            break
        stopped |= more
    for s in order:
        assert abs(taken[s] - stopped.get(s, weight[s] * unit)) <= 1

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter((r["doc_id"], (*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0)) for r in rows["mixing"])
    pieces, used = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows["packing"]:
        own = tuple(np.frombuffer(r["ids"], "<u4").tolist())
        assert len(own) == r["length"]
        pieces[r["doc_id"], r["start"]].append(own)
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in used.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 1024
    parts = collections.Counter()
    for (d, ids), n in want.items():
        for at in range(0, len(ids), 1024):
            parts[d, at, ids[at : at + 1024]] += n
    assert parts == collections.Counter((d, at, own) for (d, at), v in pieces.items() for own in v)
