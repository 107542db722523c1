"""Cases at the edges: whole chains, repeated ids, long texts, large numbers, lookups over stored files, the pipeline's stages."""

from __future__ import annotations

import collections
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from deltaplane.llm import langid, licenses, mixing, packing, quality, simhash, substring, tokencount, topk, wavelet

SCHEMA = "doc_id bigint, text string"


def words(rnd: random.Random, n: int) -> list[str]:
    return [f"w{rnd.randrange(10**9)}" for _ in range(n)]


def passages(spark, docs) -> dict[tuple[int, int], list[tuple[int, int]]]:
    out = {}
    for r in substring.shared_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], SCHEMA)).collect():
        out.setdefault((r["doc_id"], r["other_id"]), []).append((r["start"], r["end"]))
    return {k: sorted(v) for k, v in out.items()}


def test_passage_behind_a_wide_gap(spark):
    """25 equal words, 20 other ones, 100 equal words: the 100 are a passage."""
    rnd = random.Random(1)
    a, b = words(rnd, 25), words(rnd, 100)
    got = passages(spark, [(1, a + words(rnd, 20) + b), (2, a + words(rnd, 20) + b)])
    assert got[2, 1][-1][1] == 145 and got[2, 1][-1][0] <= 45


def test_pieces_in_earlier_documents(spark):
    """60 words that two documents share, overlapping pieces of which stand in three earlier ones."""
    rnd = random.Random(2)
    q = words(rnd, 60)
    docs = [(1, q[:25]), (2, q[18:43]), (3, q[36:]), (10, words(rnd, 5) + q), (11, words(rnd, 9) + q + words(rnd, 9))]
    assert passages(spark, docs)[11, 10] == [(9, 69)]


def changed(rnd: random.Random, p: list[str], rate: float) -> list[str]:
    out = []
    for w in p:
        if rnd.random() >= rate:
            out.append(w)
        else:
            out += rnd.choice([[f"x{rnd.randrange(10**9)}"], [], [w, f"y{rnd.randrange(10**9)}"]])
    return out


def test_recall(spark):
    """Of passages with random changes, insertions and deletions those 0.8 similar or more are found, nearly all."""
    rnd = random.Random(3)
    docs, wanted = [], set()
    for k in range(160):
        p = words(rnd, rnd.randint(60, 140))
        own = changed(rnd, p, rnd.choice([0.02, 0.05, 0.1, 0.15]))
        if substring.common(p, own) >= 0.8 * max(len(p), len(own)):
            wanted.add((2 * k + 1, 2 * k))
        docs += [(2 * k, words(rnd, 30) + p + words(rnd, 30)), (2 * k + 1, words(rnd, 30) + own + words(rnd, 30))]
    got = set(passages(spark, docs))
    assert len(wanted) > 120 and len(got & wanted) >= 0.97 * len(wanted)
    assert all(a - 1 == b for a, b in got)


def test_substring_edges(spark):
    rnd = random.Random(4)
    p, q = words(rnd, 60), words(rnd, 70)
    docs = [(1, p), (1, q), (2, q), (3, []), (4, ["the"] * 300), (5, ["the"] * 200 + words(rnd, 5)), (6, ["a", "b"] * 100), (7, words(rnd, 8) + ["a", "b"] * 90)]
    got = passages(spark, docs)
    assert got[2, 1] == [(0, 70)] and set(got[5, 4]) == {(0, 200)} and (7, 6) in got and set(got) == {(2, 1), (5, 4), (7, 6)}
    nulls = spark.createDataFrame([(None, " ".join(p)), (1, None), (2, " ".join(p)), (2, " ".join(p))], SCHEMA)
    assert substring.shared_passages(nulls).count() == 0
    odd = spark.createDataFrame([(1, " ".join(p), 5, "x"), (2, " ".join(p), 6, "y")], "doc_id bigint, text string, rep int, bucket string")
    assert substring.shared_passages(odd).count() == 1 and substring.without_passages(odd).columns == odd.columns


def test_long_text(spark):
    """A text of a million words, and a copy of its middle."""
    rnd = random.Random(5)
    long = [f"v{rnd.randrange(10**6)}" for _ in range(1_000_000)]
    frame = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[500_000:500_300]))], SCHEMA)
    r = substring.shared_passages(frame).collect()
    assert [(x["doc_id"], x["start"], x["end"], x["other_start"]) for x in r] == [(2, 0, 300, 500_000)]
    assert {x["doc_id"]: x["n_words"] for x in quality.host_quality(frame.withColumn("source", F.lit("s"))).collect()} == {1: 1_000_000, 2: 300}
    path = public_tokenizers.path("word_bpe_49k.json")
    found = {x["doc_id"]: x["n_tokens"] for x in wavelet.read_documents(wavelet.write_shards(frame, path)).collect()}
    assert found[1] > 1_000_000 and found[2] > 300
    assert tokencount.token_counts(frame, public_tokenizers.path("piece_bpe_32k.model")).where("n_tokens >= 300").count() == 2


def test_large_components(spark):
    rows = [(50, [20000.0, 1.0]), (1, [20000.0, 0.0]), (2, [1.0, 1.0]), (3, [-20000.0, 0.0]), (4, [1e18, 1.0]), (5, [0.5, -3.0]), (6, [3e38, 0.0]), (7, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("score", F.lit("x"))
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(frame, k=5).orderBy("rank").collect()]
    of = {i: [int(np.floor(256 * float(np.float32(x)))) if abs(x) < 2**52 else 256 * int(np.float32(x)) for x in v] for i, v in rows if v}
    exact = sorted((-min(sum(a * b for a, b in zip(of[50], of[i], strict=True)), (1 << 63) - 1), i) for i in of if i != 50)
    assert [(i, -s) for _, i, s in got] == [(i, s) for s, i in exact[:5]]


def test_repeated_vector_ids(spark):
    """Several vectors of one id are one item, so that others aren't crowded out."""
    rnd = np.random.RandomState(6)
    rows = [(50, [1.0, 1.0])] + [(7, [0.9 + i / 1000, 0.9]) for i in range(300)] + [(100 + i, [float(x) for x in rnd.rand(2) / 2]) for i in range(1, 40)]
    got = [r["vec_id"] for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5).where("query_id = 50").collect()]
    assert len(set(got)) == 5 and 7 in got


def test_runs_of_spaces():
    """Pieces of several marks count: the best segmentation of whole texts by plain dynamic programming."""
    pieces = dict(tokencount.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    own, least = tokencount.counter(public_tokenizers.path("piece_bpe_32k.model")), min(pieces.values()) - tokencount.UNKNOWN
    for text in ("a    b", "        return x\n    y", "a  ", "   "):
        s = text.replace(" ", tokencount.MARK)
        s = s if s[0] == tokencount.MARK else tokencount.MARK + s
        best = [(0.0, 0)] + [(-np.inf, 0)] * len(s)
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + 20) + 1):
                if s[i:j] in pieces and best[i][0] + pieces[s[i:j]] > best[j][0]:
                    best[j] = best[i][0] + pieces[s[i:j]], best[i][1] + 1
            if s[i] not in pieces and best[i][0] + least > best[i + 1][0]:
                best[i + 1] = best[i][0] + least, best[i][1] + len(s[i].encode())
        assert own.text(text)[0] == best[-1][1], text


def labelled(text: str) -> dict[str, float]:
    """The licence votes of one text by plain loops, with the rarity that its own words give."""
    own = licenses.words_of(text)
    vocabulary = licenses.index_words(licenses.NOTICES)
    order = sorted(vocabulary, key=lambda w: (w in own, w))
    out = {}
    for label, (notice, key) in licenses.NOTICES.items():
        n, k = notice.split(), key.split()
        rare = [w for w in order if w in n and w in own][:8]
        starts = sorted(p - i for p, w in enumerate(own) if w in rare for i, x in enumerate(n) if x == w)
        shift = next(i for i in range(len(n)) if n[i : i + len(k)] == k)
        keys = {p - shift for p in range(len(own)) if own[p : p + len(k)] == k}
        need = max(2, int(np.ceil(len(rare) * 0.6)))
        votes = [v for o in set(starts) if any(abs(x - o) <= 2 for x in keys) and (v := sum(o <= x <= o + 2 for x in starts)) >= need]
        if votes:
            out[label] = min(1.0, max(votes) / max(1, len(rare)))
    return out


def test_licence_labels(spark):
    """labels and score against plain loops, on notices that are cut, repeated and changed."""
    rnd = random.Random(7)
    notices = [n for n, _ in licenses.NOTICES.values()]
    for _ in range(6):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            own = rnd.choice(notices).split()
            a, b = sorted(rnd.sample(range(len(own) + 1), 2))
            own = own if rnd.random() < 0.6 else own[a:b]
            parts += [w if rnd.random() < 0.95 else "other" for w in own] + words(rnd, rnd.randint(0, 3))
        text = " ".join(parts)
        r = licenses.licence_scan(spark.createDataFrame([(1, text)], SCHEMA)).first()
        want = labelled(text)
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == base | set(want), text
        assert abs(r["score"] - max([*want.values(), 0.5 if base else 0.0])) < 1e-9


def test_repeated_notice(spark):
    """The work on a document grows with its words."""
    mit = licenses.NOTICES["mit-line"][0] + " . "
    began = time.time()
    r = licenses.licence_scan(spark.createDataFrame([(1, mit * 10_000), (2, None), (3, "")], SCHEMA).withColumn("hits", F.lit(1))).orderBy("doc_id").collect()
    assert "mit-line" in r[0]["labels"] and r[0]["n_base"] == 10_000 and (r[1]["n_words"], r[2]["labels"]) == (0, "") and time.time() - began < 60


def test_keep_good_by_row(spark):
    """Rows that share a doc_id are judged each by its own text."""
    rnd = random.Random(8)
    good = " ".join(words(rnd, 60))
    frame = spark.createDataFrame([(1, good, "a", 1), (1, "short", "a", 2), (None, good, None, 3), (None, None, None, 4), (2, good, "a", 5)], "doc_id bigint, text string, source string, n_words int")
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and sorted(r["n_words"] for r in kept.collect()) == [1, 3, 5]


def test_mix_reruns(spark):
    """Repeated and null ids of different sizes: the same rows are taken again, on any partitioning."""
    rnd = random.Random(9)
    rows = [(rnd.choice([None, 1, 2, 3]), " ".join(words(rnd, rnd.randrange(40))), rnd.choice(["a", "b", None])) for _ in range(120)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("x")).withColumn("weight", F.lit(1))
    ways = [sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.taken_in_order(f).collect()) for f in (frame, frame.repartition(7, "text"))]
    assert ways[0] == ways[1] and len(ways[0]) == 120


@pytest.mark.parametrize("sizes", [[10, 1000, 50], [1, 1, 1, 5000], [7], [0, 0], [100, 200, 300, 1, 2, 3, 9000]])
def test_targets(spark, sizes):
    """Targets by running sums are those of sharing the excess round by round."""
    frame = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    weight, stopped = {f"s{i}": i % 3 + 1 for i in range(len(sizes))}, {}
    while True:
        open_ = [s for s in weight if s not in stopped]
        unit = (sum(sizes) - sum(stopped.values())) / sum(weight[s] for s in open_) if open_ else 0
        more = [s for s in open_ if weight[s] * unit > 3 * sizes[int(s[1:])]]
        if not more:
            break
        stopped |= {s: 3 * sizes[int(s[1:])] for s in more}
    for s in weight:
        assert abs(got[s] - stopped.get(s, weight[s] * unit)) < 1e-6


def test_lookup_over_stored_shards(spark):
    """Counting, occurrences and access over the files agree with the decoded ids."""
    rnd = random.Random(10)
    frame = spark.createDataFrame([(i, " ".join(rnd.choice("the of a stone river x1".split()) for _ in range(rnd.randrange(30)))) for i in range(40)] + [(None, "the end"), (41, None)], SCHEMA)
    shards = wavelet.write_shards(frame, public_tokenizers.path("word_bpe_49k.json"), shard_tokens=64)
    ids = {}
    for r in wavelet.read_documents(shards).collect():
        for k, t in enumerate(np.frombuffer(r["ids"], "<u4").tolist()):
            ids[r["start"] + k] = (r["doc_id"], k, t)
    token = collections.Counter(t for _, _, t in ids.values()).most_common(2)[1][0]
    want = sorted((p, str(d), k) for p, (d, k, t) in ids.items() if t == token)
    assert sorted((r["position"], str(r["doc_id"]), r["place"]) for r in wavelet.occurrences(shards, token).collect()) == want
    assert {str(r["doc_id"]): r["n"] for r in wavelet.count_by_document(shards, token).collect()} == collections.Counter(d for _, d, _ in want)
    some = rnd.sample(sorted(ids), 20)
    assert {r["position"]: r["token"] for r in wavelet.tokens_at(shards, some).collect()} == {p: ids[p][2] for p in some}


def test_language_of_held_out_documents(spark):
    """The query's split: right on nearly all labelled documents that aren't learnt from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    got = langid.label(docs, langid.train(docs.where(~held))).join(docs.where(held & F.col("lang").isNotNull()).select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.99 * n


def test_scripts():
    own = langid.Words(["abc Ωmega привет שלום سلام नमस्ते สวัสดี 한국 ひらがな 漢字 é"])
    assert [langid.SCRIPTS[k - 1] for k in own.scripts] == ["latin", "greek", "cyrillic", "hebrew", "arabic", "devanagari", "thai", "hangul", "kana", "han", "latin"]


def test_other_columns(spark):
    """Columns whose names the operators use inside are ignored."""
    rnd = random.Random(11)
    frame = spark.createDataFrame([(i, " ".join(words(rnd, 30)), "s") for i in range(6)], "doc_id bigint, text string, source string")
    odd = frame.select("*", *[F.lit(1).alias(c) for c in ("words", "start", "length", "part", "nth", "ids", "lang", "score", "n_tokens", "fingerprint_bits", "own", "bucket", "before", "size", "__words")])
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack(odd, path).count() == 6 and wavelet.read_documents(wavelet.write_shards(odd, public_tokenizers.path("word_bpe_49k.json"))).count() == 6
    assert simhash.near_duplicates(odd).count() == quality.host_quality(odd).count() == mixing.curriculum(odd).count() == 6
    assert tokencount.token_counts(odd, public_tokenizers.path("piece_bpe_32k.model")).count() == langid.label(odd, langid.train(odd.withColumn("lang", F.lit("en")))).count() == 6
    assert simhash.keep_one(odd).columns == quality.keep_good(odd).columns == mixing.mix(odd).columns == substring.without_passages(odd).columns == odd.columns
