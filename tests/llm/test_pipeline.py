"""Stages of the pipeline on planted documents."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sigscreen.llm import corpus, language

CLASHING = "did long, fp long, n long, kept string, _did long, _fp long, _n long, _kept string, DID_ long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
OTHER = (7, 17, 27, "k", 37, 47, 57, "kk", 67)


def _around(seed):
    r = random.Random(seed)
    return [" ".join("".join(r.choices("bcdfghjk", k=6)) for _ in range(60)) for _ in range(2)]


def test_repeated_passages_of_short_words_go(spark):
    corpus.reachable(spark)
    r = random.Random(1)
    short = ["".join(r.choices("abcdefghi", k=r.randint(1, 3))) for _ in range(51)]
    fifty = ["".join(r.choices("lmnopqrst", k=r.randint(1, 3))) for _ in range(50)]
    least = [r.choice("uvwxyz") for _ in range(51)]                          # 101 bytes
    long = ["".join(r.choices("abcdeuvw", k=9)) for _ in range(30)]          # 299 bytes in 30 words
    planted = [" ".join(p) for p in (short, fifty, least, long)]
    assert all(len(p) < 256 for p in planted[:3]) and len(planted[2]) == 101
    rows, want = [], {}
    for k, p in enumerate(planted):
        for copy in range(2):
            a, b = _around(10 * k + copy)
            a, b = (a + "!", "?" + b) if copy else (a + ".", "," + b)        # nothing but the passage is shared
            at = 2 * k + copy
            rows.append((at, f"{a} {p} {b}", "en", 0, "x"))
            want[at] = f"{a} {p} {b}" if k == 1 else f"{a}{b}"
    rows.append((90, None, "en", 0, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, did string")
    out = corpus_pipeline.without_repeats(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and got[90].text is None
    for i, text in want.items():
        assert got[i].text == text, i
        assert got[i].n_chars == (0 if i in (2, 3) else len(text))


def _words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(n)]


def _shingles(text, size):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _stage_rows():
    base = _words(1, 200)
    near = base[:90] + ["other"] + base[91:]
    far = base[:100] + _words(2, 100)
    rows = [(10, " ".join(base)), (4, " ".join(near)), (11, " ".join(far)), (12, " ".join(base).upper()), (12, " ".join(base).upper()),
            (20, None), (21, ""), (21, ""), (22, " \t"), (None, " ".join(_words(3, 30))), (None, " ".join(_words(3, 30))), (30, "one two"), (31, "One two"),
            (10, " ".join(_words(5, 40)))]                                   # an id that stands with two texts
    return [(i, t, "en", "s", len(t) if t is not None else None, *OTHER) for i, t in rows]


def test_one_of_each_against_plain(spark):
    corpus.reachable(spark)
    rows = _stage_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    last = 2**63 - 1
    sets = [_shingles(r[1], corpus_pipeline.SIZE) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    want = set()
    for g in set(group):
        own = [r for r, x in zip(rows, group) if x == g]
        least = min(last if r[0] is None else r[0] for r in own)
        want |= {r for r in own if (last if r[0] is None else r[0]) == least}
    out = corpus_pipeline.one_of_each(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), "").count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A benchmark with a planted item, and documents in two languages."""
    corpus.reachable(spark)
    at = tmp_path_factory.mktemp("corpus")
    item = " ".join(_words(50, 14))
    items = [(1, item), (2, None), (3, ""), (4, "five words are an item"), (4, item)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), item


def _hit(text, item, size=10):
    words, own = (text or "").lower().split(), item.lower().split()
    m = min(size, len(own))
    wins = {tuple(own[i:i + m]) for i in range(len(own) - m + 1)}
    return any(tuple(words[i:i + m]) in wins for i in range(len(words) - m + 1))


def test_not_in_benchmark_against_plain(spark, folder):
    at, item = folder
    some = item.split()
    texts = [None, "", "a " + " ".join(some[2:12]).upper() + " b", " ".join(some[2:11]), "so five words are an item here", item, item, "plain text"]
    rows = [(i if i else None, t, "en", "s", 1, *OTHER) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = [r for r in rows if not any(_hit(r[1], x) for x in (item, "five words are an item"))]
    out = corpus_pipeline.not_in_benchmark(spark, docs, at)
    assert out.columns == docs.columns and len(want) == 4
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert corpus_pipeline.not_in_benchmark(spark, docs.limit(0), at).count() == 0


def test_known_language_keeps_what_identify_keeps(spark):
    corpus.reachable(spark)
    en, de = "the shore and the river of stone", "der Fluss und das Ufer aus Stein über"
    rows = [(i, " ".join(random.Random(i).choices((en if i % 2 else de).split(), k=30)), "en" if i % 2 else "de", "s", 1, *OTHER) for i in range(80)]
    rows += [(100, None, "en", "s", None, *OTHER), (101, "", "de", "s", 0, *OTHER), (102, "12 34 !", None, "s", 7, *OTHER),
             (None, en, None, "s", 3, *OTHER), (None, en, None, "s", 3, *OTHER)]
    docs = spark.createDataFrame(rows, SCHEMA)
    told = language.identify(docs, language.train(docs)).where("not rejected")
    out = corpus_pipeline.known_language(spark, docs, "")
    assert out.schema == docs.schema
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in told.collect())
    assert {tuple(r) for r in got} <= set(rows) and len(got) > 60
    assert not {r.doc_id for r in got} & {100, 101, 102}
    assert corpus_pipeline.known_language(spark, docs.limit(0), "").count() == 0


def test_tokens_against_the_library(spark):
    corpus.reachable(spark)
    rows = _stage_rows()
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids))
    got = corpus_pipeline.tokens(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_run_applies_the_stages_in_order(spark, folder):
    at, item = folder
    en, de = _words(70, 60), _words(71, 60)
    def text(i):
        r = random.Random(i)
        return " ".join(r.choices(en if i % 2 else de, k=40))
    rows = [(i, text(i), "en" if i % 2 else "de", "s", 1) for i in range(60)]
    rows += [(60, text(3), "en", "s", 1), (61, f"{text(5)[:100]} {item} {text(7)[:100]}", "en", "s", 1), (62, "12 34", "en", "s", 1), (63, None, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    out = corpus_pipeline.run(spark, at)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert {60, 61, 62, 63}.isdisjoint(got) and len(got) > 40
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
    assert sorted(map(str, docs.collect())) == sorted(map(str, got.values()))


def test_language_of_a_last_empty_text(spark):
    corpus.reachable(spark)
    rows = [(i, "the shore of stone" if i % 2 else "der Fluss über Stein", "en" if i % 2 else "de") for i in range(20)]
    docs = spark.createDataFrame([*rows, (21, "ab", "en"), (22, "", None), (23, None, None)], "doc_id long, text string, lang string").coalesce(1)
    got = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert got[22] == got[23] == "und" and len(got) == 23
