"""Alignment of two tokenizers on odd texts, against a plain version on the libraries."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sigscreen.llm import align, corpus
from sigscreen.llm.tokenizer import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PROSE = "the shore of the river, stone by stone; naïve Ünder 42 and 漢字 Σίσυφος 🙂 "
TEXTS = [(0, PROSE), (1, PROSE), (1, PROSE), (2, None), (3, ""), (4, " "), (5, "  two  spaces\n\tand tabs "), (6, "has ▁ in it"),
         (7, "<|endoftext|> <s> </s> <unk> <0x41>"), (None, "no id"), (8, "a" * 3000), (9, "x"), (12, " a  b c   d e\n f "), (13, "two\u00a0kinds\u3000of space"), (10, "null\x00byte \x1c \x85 é́"),
         (11, " ".join(f"{w} {i}" for i, w in enumerate((PROSE * 900).split())))]


@pytest.fixture(scope="module")
def docs(spark):
    corpus.reachable(spark)
    rows = [(i, t, 1, 2, 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, block long, pairs long, n long").repartition(3)


def _plain(texts):
    """(a ids, b ids, groups, links as positions) of each text."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    out = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if text and not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            ids_a, ids_b, raw_a, raw_b = [], [], [], []
        owner_a = [k for k, raw in enumerate(raw_a) for _ in raw]
        owner_b = [k for k, raw in enumerate(raw_b) for _ in raw]
        links = sorted(set(zip(owner_a, owner_b)))
        groups, lo = [], 0
        for at in range(1, len(owner_a) + 1):
            if at == len(owner_a) or (owner_a[at] != owner_a[at - 1] and owner_b[at] != owner_b[at - 1]):
                groups.append((sorted(set(owner_a[lo:at])), sorted(set(owner_b[lo:at]))))
                lo = at
        out.append((ids_a, ids_b, groups, links))
    return out


def test_digests_against_plain(docs):
    plain = _plain([t for _, t in TEXTS])
    held = Counter()
    for a, b, _, links in plain:
        held.update({(a[i], b[j]) for i, j in links})
    most = Counter()
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    want = []
    for (doc_id, _), (a, b, groups, links) in zip(TEXTS, plain):
        counts = [(a[i], held[a[i], b[j]]) for i, j in links]
        shown = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        want.append((doc_id, len(a), len(b), len(groups), len(links), sum(n == most[i] for i, n in counts), sum(n for _, n in counts),
                     hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    got = [tuple(r) for r in align.digests(docs, A, B).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(w[1] == 0 for w in want) == 3


def test_align_against_plain(docs):
    got = []
    for r in align.align(docs, A, B).collect():
        groups = [([], []) for _ in range(max(r.group_a, default=-1) + 1)]
        for side, places in enumerate((r.group_a, r.group_b)):
            for k, g in enumerate(places):
                groups[g][side].append(k)
        got.append(str((r.doc_id, r.ids_a, r.ids_b, groups, list(zip(r.link_a, r.link_b)))))
    want = [str((i, *p)) for (i, _), p in zip(TEXTS, _plain([t for _, t in TEXTS]))]
    assert sorted(got) == sorted(want)


def test_parts_of_the_table_do_not_matter(docs):
    one = sorted(map(str, align.digests(docs.coalesce(1), A, B).collect()))
    assert sorted(map(str, align.digests(docs.repartition(20), A, B).collect())) == one


def test_empty_table(docs):
    assert align.digests(docs.limit(0), A, B).count() == 0
