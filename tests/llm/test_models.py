"""Parts of the trained models against plain loops."""

import numpy as np
import pyarrow as pa
import pytest

from sigscreen.llm import language, texts, toxicity

TEXTS = ["The shore, 42 stones", "", "a", "über naïve Äpfel", "x" * 300, "  two\twords ", "12", "ab"]


def _plain_logits(model, text):
    """The mean of the table's rows over all 3- and 4-grams of the text between two spaces."""
    raw = text.encode()
    seen = [32, *((b | 0x20) if chr(b).isascii() and chr(b).isalpha() else b if b >= 128 else 32 for b in raw), 32]
    total, n = np.zeros(len(model.names)), 0
    for k in language.SIZES:
        for i in range(len(seen) - k + 1):
            code = 0
            for b in seen[i:i + k]:
                code = (code << 8 | b) & 0xFFFFFFFF
            bucket = ((code * 0x9E3779B1 + (k * 0x85EBCA6B & 0xFFFFFFFF)) & 0xFFFFFFFF) >> 17
            total += model.table[bucket]
            n += 1
    return total / max(n, 1) + model.bias


@pytest.mark.parametrize("order", [1, -1])
def test_logits_are_means_over_grams(order):
    rng = np.random.default_rng(1)
    table = rng.normal(size=(language.BUCKETS, 3)).astype(np.float32)
    model = language.Model(["a", "b", "c"], table, rng.normal(size=3).astype(np.float32), 1.5, 0.2)
    own = TEXTS[::order]
    [part] = list(texts.chunks(pa.array(own)))
    got = model.logits(part)
    for text, row in zip(own, got):
        if text:
            assert row == pytest.approx(_plain_logits(model, text), abs=1e-5)
    best, score = model.predict(part)
    p = language.softmax(got / 1.5)
    assert (best == p.argmax(axis=1)).all() and score == pytest.approx(p.max(axis=1))


def test_calibration_fits_a_logistic_curve():
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000) * 2
    toxic = (rng.random(4000) < 1 / (1 + np.exp(-(1.7 * x - 0.8)))).astype(float)
    scale, shift = toxicity._calibrate(x, toxic, np.ones(4000))
    assert scale == pytest.approx(1.7, abs=0.25) and shift == pytest.approx(-0.8, abs=0.2)
    many = toxicity._calibrate(x, toxic, np.full(4000, 3.0))                 # three of each text
    thrice = toxicity._calibrate(np.tile(x, 3), np.tile(toxic, 3), np.ones(12_000))
    assert many == pytest.approx(thrice)


def test_expected_tags_against_a_loop():
    rng = np.random.default_rng(3)
    toxic, clean, base = rng.integers(0, 9, (40, 3)), rng.integers(0, 30, (40, 3)), 0.2
    got = toxicity._expected(toxic, clean, base)
    for i in range(40):
        best = 0.0
        for t, c in zip(toxic[i], clean[i]):
            shares = [base + (1 - base) * k / 65 for k in range(1, 65)]
            ratio = np.mean([(s / base) ** t * ((1 - s) / (1 - base)) ** c for s in shares])
            odds = np.exp(toxicity.PRIOR) * ratio
            chance = (c + 0.5) / (t + 0.5) * base / (1 - base)
            best = max(best, min(max(1 - chance, 0), 1) * odds / (1 + odds))
        assert got[i] == pytest.approx(min(best, 0.999), abs=1e-9)
