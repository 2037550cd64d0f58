"""The corpus operators on tables with nulls, empty and repeated texts, ties and clashing columns, against plain versions."""

import hashlib
import random
import zlib

import plain
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigscreen.llm import (
    blocks, corpus, count, decontaminate, encode, language, near, neighbors, suffixes, texts, toxicity, windows,
)

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
random.seed(4)
PROSE = " ".join(random.choices("the of and shore river stone Ünder naïve 42 x".split(), k=400))
TEXTS = [(0, PROSE), (1, PROSE), (1, PROSE), (2, PROSE + " tail"), (3, None), (4, ""), (5, "  \n "), (None, "lone words"),
         (6, "İstanbul Σίσυφος 漢字 <|endoftext|> it's"), (7, "a" * 5000), (8, "one"), (None, None), (9, PROSE[:700])]


@pytest.fixture(scope="module")
def docs(spark):
    corpus.reachable(spark)
    rows = [(i, t, "en", 1, 2, 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, did long, fp long, n long")


def test_ids_and_counts_are_those_of_the_library(docs):
    library = Tokenizer.from_file(WORD)
    got = sorted(map(str, ((r.doc_id, r.ids, r.decoded) for r in encode.encode(docs, WORD).collect())))
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in TEXTS]
    want = sorted(map(str, ((i, ids, library.decode(ids, skip_special_tokens=False)) for i, ids in want)))
    assert got == want
    for known in (0, 1 << 30):                                            # words forgotten at each block, or never
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(encode, "KNOWN", known)
            patch.setattr(encode, "BLOCK", 64)
            patch.setattr(count, "KNOWN", known)
            enc = encode.Encoder(open(WORD, encoding="utf-8").read())
            for _, t in TEXTS:
                flat, ends, _ = enc.texts([t or "", PROSE])
                assert flat[:ends[1]].tolist() == library.encode(t or "", add_special_tokens=False).ids
    back = encode.decode(encode.encode(docs, WORD), WORD)
    assert sorted(r.decoded for r in back.collect()) == sorted(r.decoded for r in encode.encode(docs, WORD).collect())
    library = Tokenizer.from_file(BYTE)
    got = sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens) for r in count.token_counts(docs, BYTE).collect())))
    assert got == sorted(map(str, ((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
                                   for i, t in TEXTS)))


def test_blocks_round_trip_and_refuse_damage(docs):
    library = Tokenizer.from_file(WORD)
    rows = sorted(blocks.round_trip(docs, WORD).collect(), key=lambda r: r.start)
    at = 0
    order = sorted(TEXTS, key=lambda x: (-1 if x[0] is None else x[0], x[1] or ""))
    for r, (i, t) in zip(rows, order, strict=True):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    block = blocks.pack([np.arange(500)])[0]
    with pytest.raises(ValueError):
        blocks.unpack([block[:40] + bytes([block[40] ^ 1]) + block[41:]])


@pytest.mark.parametrize("hot", [2, 20_000])
def test_repeated_bytes(docs, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = sorted((bytes(r.kept), r.n_spans) for r in suffixes.repeated_bytes(docs, 40).collect())
    assert got == sorted(plain.repeated_bytes([t for _, t in TEXTS], 40))


def test_repeated_windows(docs):
    size, known = 6, {}
    split = [(2**63 - 1 if i is None else i, (t or "").split()) for i, t in TEXTS]      # ASCII spaces only in these texts
    for i, ws in split:
        for k in range(len(ws) - size + 1):
            w = tuple(ws[k:k + size])
            known[w] = min(known.get(w, i), i)
    want = []
    for i, ws in split:
        gone = {k + j for k in range(len(ws) - size + 1) if known[tuple(ws[k:k + size])] < i for j in range(size)}
        want.append((len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    got = [(r.n_words, r.n_removed, r.kept_text) for r in windows.repeated_windows(docs, size).collect()]
    assert sorted(got) == sorted(want)


def test_near_duplicates_of_odd_rows(docs):
    rows = {(r.doc_id, r.n_shingles): r for r in near.near_duplicates(docs, 2).collect()}
    by_id = {r.doc_id: r for r in rows.values() if r.doc_id is not None}
    assert by_id[1].component_id == by_id[2].component_id == 0 and by_id[0].kept and not by_id[1].kept
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (3, 4, 5))
    assert near.near_duplicates(docs, 2).count() == len(TEXTS)
    assert near.near_duplicates(docs.limit(0), 2).count() == 0


@pytest.mark.parametrize("block", [near.BLOCK, 4])
def test_near_duplicates_in_crowded_lists(spark, monkeypatch, block):
    """Over 128 texts share their rare words; some are near each other in chains, in copies, or not at all."""
    monkeypatch.setattr(near, "BLOCK", block)
    corpus.reachable(spark)
    r = random.Random(12)
    common = [f"q{i}" for i in range(12)]
    texts = []
    for i in range(45):
        own = [f"w{r.randint(0, 30)}" for _ in range(r.choice([6, 30, 60]))]
        for _ in range(3):
            words = common + own
            for _ in range(r.randint(0, max(1, len(words) // 12))):
                words[r.randrange(len(words))] = f"x{r.randint(0, 10**6)}"
            texts.append(" ".join(words))
    texts += [" ".join(common)] * 3 + [texts[0]] * 2
    sets = [{tuple(t.split()[i:i + 2]) for i in range(len(t.split()) - 1)} for t in texts]
    assert sum(("q0", "q1") in s for s in sets) > 110
    least = list(range(len(texts)))
    changed = True
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            if least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                changed = True
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near.near_duplicates(df, 2).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, least))}
    assert 10 < len(set(least)) < 130
    with pytest.raises(ValueError):
        near.near_duplicates(df, 2, percent=60)


def test_contamination_of_odd_rows(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(PROSE.split()[5:25])), (2, "ONE"), (3, None), (4, ""), (None, "lone words")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(docs, bench).collect()}
    by_id = {r.doc_id: r for r in got.values() if r.doc_id is not None}
    assert by_id[0].n_hit >= 20 and by_id[0].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert by_id[8].n_hit == 1 and by_id[8].n_items == 1 and not by_id[3].contaminated
    assert got[(None, 2)].contaminated and got[(None, 2)].n_items == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_language_on_held_out_rows(spark):
    corpus.reachable(spark)
    docs = corpus.table(spark, "/root/testdata/sf0.001", "documents")
    model = language.train(docs)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (None, "漢")], "doc_id long, text string")
    pred = {r.doc_id: r.lang_pred for r in language.identify(odd, model).collect()}
    assert [pred[i] for i in (1, 2, 3)] == ["und"] * 3 and pred[None] != "und"
    wide = odd.select("*", F.lit(1).alias("did"), F.lit("x").alias("_text"))      # columns pass by, rejected rows go
    told = language.identify(wide, model).where("not rejected").count()
    kept = language.recognized(wide, model)
    assert kept.columns == wide.columns and kept.count() == told and kept.where("doc_id in (1, 2, 3)").isEmpty()
    assert language.recognized(wide.limit(0), model).isEmpty()


def test_toxicity_on_held_out_rows(spark):
    corpus.reachable(spark)
    docs, labels = (corpus.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    known = docs.join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id")
    got = toxicity.toxicity(known, labels).join(labels, "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right >= 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "you stupid idiot")], "doc_id long, text string")
    none = toxicity.train(odd, labels.limit(0))
    assert all(r.score < 0.1 for r in toxicity.toxicity(odd, labels, none).collect())


@pytest.mark.parametrize("size, least", [
    ("sf0.001", {"en": 0.8}), ("sf0.01", {"en": 0.9, "es": 0.7}), ("sf0.1", {"en": 0.9, "de": 0.9, "fr": 0.9, "es": 0.9})])
def test_toxic_texts_are_found_in_each_language_and_size(spark, size, least):
    corpus.reachable(spark)
    docs, labels = (corpus.table(spark, f"/root/testdata/{size}", t) for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.groupBy("lang", "toxic").agg(F.avg("predicted").alias("share"), F.count("*").alias("n")).collect()
    print(size, sorted((r.lang, r.toxic, r.n, round(r.share, 3)) for r in rows))
    found = {r.lang: r.share for r in rows if r.toxic == 1}
    assert all(found[k] >= v for k, v in least.items()), found
    clean = [(r.share, r.n) for r in rows if r.toxic == 0]
    assert sum(a * n for a, n in clean) <= 0.03 * sum(n for _, n in clean)


def test_forward_backward_by_blocks_equals_the_plain_recursion():
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(1), 0.0, rng.normal(size=2), rng.normal(size=(2, 2)))
    score, first = rng.normal(0, 3, 700), np.array([0, 1, 1, 300, 700])
    got = field.marginals(score, first)
    for a, b in zip(first[:-1], first[1:]):
        e = np.stack([np.ones(b - a), np.exp(score[a:b])], axis=1)
        if b == a:
            continue
        f, back = [np.exp(field.start) * e[0]], [np.ones(2)]
        for t in range(1, b - a):
            x = (f[-1] @ np.exp(field.step)) * e[t]
            f.append(x / x.sum())
        for t in range(b - a - 1, 0, -1):
            x = np.exp(field.step) @ (e[t] * back[-1])
            back.append(x / x.sum())
        p = np.array(f) * np.array(back[::-1])
        assert np.allclose(got[a:b], p[:, 1] / p.sum(axis=1))


def test_nearest_against_all_pairs(spark):
    corpus.reachable(spark)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[100:160] = v[100]                                           # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in
           neighbors.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()}
    for q in range(0, 300, 20):
        s = [(-sum(float(a) * float(b) for a, b in zip(v[q], x)), i) for i, x in enumerate(v) if i != q]
        for rank, (score, i) in enumerate(sorted(s)[:20], 1):
            assert got[(q, rank)][0] == i and abs(got[(q, rank)][1] + score) < 1e-12
    assert len(got) == 15 * 20


def test_nearest_of_lone_vectors_and_doubles(spark, monkeypatch):
    lone = spark.createDataFrame([(20, [1.0, 2.0]), (40, [3.0])], "vec_id long, embedding array<float>")
    assert neighbors.nearest(lone, lone).count() == 0                     # nothing but the query's own row of its length
    exact = [(0, [1.0, 1.0]), (1, [0.05, 0.0]), (2, [0.05 + 1e-12, 0.0]), (3, [1e200, 0.0]), (4, [-1.0, 0.5])]
    df = spark.createDataFrame(exact, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in neighbors.nearest(df, df.where("vec_id = 0"), k=4).orderBy("rank").collect()]
    assert got == [(3, 1e200), (2, 0.05 + 1e-12), (1, 0.05), (4, -0.5)]
    assert neighbors.nearest(df.limit(0), df).count() == neighbors.nearest(df, df.limit(0)).count() == 0
    rng = np.random.default_rng(7)
    monkeypatch.setattr(neighbors, "SHARD", 10)                           # many shards and waves, one query in a block
    monkeypatch.setattr(neighbors, "BLOCK", 1)
    v = np.round(rng.normal(size=(170, 3)), 1)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbors.nearest(df, df.where("vec_id % 17 = 0"), k=6).collect())
    want = []
    for q in range(0, 170, 17):
        order = sorted((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in enumerate(v) if i != q)
        want += [(q, r, i) for r, (_, i) in enumerate(order[:6], 1)]
    assert got == want


@pytest.mark.parametrize("relax", [1.2, 1.5])
def test_recall_of_a_relaxed_search(spark, relax):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = df.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in neighbors.nearest(df, asked, k=20).collect()}
    found = {(r.query_id, r.vec_id) for r in neighbors.nearest(df, asked, k=20, relax=relax).collect()}
    recall = len(exact & found) / len(exact)
    print(f"recall at relax {relax}: {recall:.3f}")
    assert recall >= 0.9


def test_anchors_are_the_leftmost_least():
    x = np.random.default_rng(3).integers(0, 6, 200, dtype=np.uint64) << np.uint64(40)
    at, first, last = texts.anchors(x, 7)
    found = {s: a for a, b, c in zip(at, first, last) for s in range(b, c + 1)}
    assert found == {s: s + int(np.argmin(x[s:s + 7])) for s in range(194)}
