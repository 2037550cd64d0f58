"""Only texts and suffixes that may repeat are shuffled."""

import random

import numpy as np
import plain
from pyspark.sql import functions as F

import corpus_pipeline
from sigscreen.llm import suffixes
from sigscreen.llm.corpus import maybe_among, reachable


def _text(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n))


def _rows(n):
    shared = _text(99_999)
    return [(i, f"{_text(i)} {shared if i < 2 else ''} {_text(10_000 + i)}", "en") for i in range(n)] + [(n, None, "en"), (None, "", "en")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_suffixes_and_cuts_of_repeats_only(spark, monkeypatch):
    reachable(spark)
    rows = _rows(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plans, made, cut = [], [], []
    make, shorten = suffixes._suffix_rows, suffixes._cut

    def made_rows(docs, *rest):
        plans.append(_plan(docs))
        out = make(docs, *rest)
        made.append(out.select("did").distinct().count())
        return out

    def cut_rows(docs, *rest):
        cut.append(docs.count())
        return shorten(docs, *rest)

    monkeypatch.setattr(suffixes, "_suffix_rows", made_rows)
    monkeypatch.setattr(suffixes, "_cut", cut_rows)
    out = corpus_pipeline.without_repeats(spark, docs, "")
    assert "Join" not in plans[0] and made[0] < 30 and cut == [2]
    got = {r.doc_id: r.text for r in out.collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        assert got[i] == text if i is None or i > 1 else got[i].startswith(_text(i)[:-3]) and len(got[i]) < len(text) - 400


def test_a_full_map_of_runs_changes_nothing(spark, monkeypatch):
    reachable(spark)
    texts = [t for _, t, _ in _rows(20)] + ["x" * 90, "x" * 90]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(suffixes, "_often", lambda docs, length: np.full(suffixes.PAGE_BYTES, 255, np.uint8))
    got = sorted((bytes(r.kept), r.n_spans) for r in suffixes.repeated_bytes(docs, 40).collect())
    assert got == sorted(plain.repeated_bytes(texts, 40))


def test_rows_are_parted_without_loss(spark):
    rows = spark.range(5000).select(F.col("id").alias("did"), (F.col("id") * 7).alias("fp"), F.lit(1).alias("_PAGE"), F.lit("m").alias("_map"))
    wanted = rows.where("did % 100 = 3").select("did", "fp")
    some, others = maybe_among(rows, wanted, ["did", "fp"])
    assert some.columns == others.columns == rows.columns
    assert some.join(wanted, ["did", "fp"], "left_semi").count() == 50 and some.count() < 60
    assert sorted(r.did for r in some.union(others).collect()) == list(range(5000))
    some, others = maybe_among(rows, wanted.limit(0), ["did", "fp"])
    assert some.count() == 0 and others.count() == 5000
