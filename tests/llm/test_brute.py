"""Operators beyond SQL against plain loops: log-mel frames and segments, coin tossing and phrases, FTRL step by step."""

import math
import random

import numpy as np
import pytest

from millrace.llm import langid, media, parsing


def test_log_mel_frames_by_sums():
    """Each frame's spectrum as sums of cosines and sines, each band as a triangle between three frequencies."""
    rng = random.Random(3)
    for n in (1, 255, 256, 257, 700):
        x = [rng.uniform(-1, 1) for _ in range(n)]
        rate, frames = media.RATE * media.UP / media.DOWN, max(1, 1 + math.ceil((n - media.FRAME) / media.HOP))
        mel = lambda hz: 2595 * math.log10(1 + hz / 700)
        edges = [700 * (10 ** (mel(rate / 2) * k / (media.MELS + 1) / 2595) - 1) for k in range(media.MELS + 2)]
        want = []
        for f in range(frames):
            part = [x[f * media.HOP + k] if f * media.HOP + k < n else 0.0 for k in range(media.FRAME)]
            part = [v * (0.5 - 0.5 * math.cos(2 * math.pi * k / media.FRAME)) for k, v in enumerate(part)]
            power = []
            for b in range(media.FRAME // 2 + 1):
                turn = [2 * math.pi * b * k / media.FRAME for k in range(media.FRAME)]
                power.append(sum(v * math.cos(t) for v, t in zip(part, turn, strict=True)) ** 2 + sum(v * math.sin(t) for v, t in zip(part, turn, strict=True)) ** 2)
            row = []
            for m in range(media.MELS):
                low, mid, high = edges[m : m + 3]
                hz = [b * rate / media.FRAME for b in range(len(power))]
                row.append(math.log(sum(p * max(0.0, min((h - low) / (mid - low), (high - h) / (high - mid))) for p, h in zip(power, hz, strict=True)) + 1e-6))
            want.append(row)
        assert media.log_mels(np.array(x)).shape == (frames, media.MELS)
        assert np.allclose(media.log_mels(np.array(x)), want, atol=2e-2)


def test_segments_by_a_walk():
    rng = random.Random(4)
    for _ in range(200):
        energy = [rng.gauss(0, 1) + (3 if rng.random() < 0.2 else 0) for _ in range(rng.randrange(1, 60))]
        mean = sum(energy) / len(energy)
        dev = math.sqrt(sum((e - mean) ** 2 for e in energy) / len(energy)) + 1e-9
        level, want, at = [(e - mean) / dev + 1 for e in energy], [], None
        for k, v in enumerate([*level, -math.inf]):
            if v >= media.LOW and at is None:
                at = k
            elif v < media.LOW and at is not None:
                if k - at >= media.MIN_FRAMES and max(level[at:k]) >= media.HIGH:
                    want.append((at, k))
                at = None
        assert media.segments(np.array(energy)) == want


def plain_phrases(names):
    """Starts of phrases, symbol by symbol."""
    heads = [k for k, v in enumerate(names) if k == 0 or v != names[k - 1]]
    single = [(heads[i + 1] if i + 1 < len(heads) else len(names)) - h == 1 for i, h in enumerate(heads)]
    symbols = [names[h] for h in heads]

    def toss(before, own):
        if before == own:
            return 0
        bit = (before ^ own) & -(before ^ own)
        return 2 * (bit.bit_length() - 1) + (own & bit > 0)

    label = [symbols[0] & 1, *(toss(a, b) for a, b in zip(symbols, symbols[1:], strict=False))]
    for _ in range(2):
        label = [symbols[0] & 1, *(toss(a, b) for a, b in zip(label, label[1:], strict=False))]
    begin = {0} | {i + 1 for i in range(1, len(heads) - 1) if label[i] > label[i - 1] and label[i] >= label[i + 1]}
    begin |= {j for i, alone in enumerate(single) if not alone for j in (i, i + 1)}
    return [heads[i] for i in sorted(begin) if i < len(heads)], label


def test_phrases_symbol_by_symbol():
    rng = random.Random(5)
    for _ in range(300):
        alphabet = [rng.getrandbits(64) for _ in range(rng.choice([1, 2, 5, 40]))]
        names = [rng.choice(alphabet) for _ in range(rng.randrange(1, 80))]
        want, label = plain_phrases(names)
        assert parsing.phrases(np.array(names, np.uint64), np.array([0])).tolist() == want
        assert max(label) < 8 and all(b - a <= 16 for a, b in zip(want, want[1:], strict=False) if len(set(names[a:b])) > 1)


def test_ftrl_step_by_step():
    """The sample's documents one after the other, every weight from its own sums, against the arrays."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "and", "of"] if k % 2 else ["der", "und", "von"]) for _ in range(8)) + f" {k}" for k in range(30)]
    labels = ["en" if k % 2 else "de" for k in range(30)]
    alpha, beta, l1, l2, seed = 0.5, 1.0, 0.05, 0.05, 3
    model = langid.train(texts, labels, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=seed)
    order = np.random.default_rng(seed).permutation(30).tolist()
    fit, df = order[6:], {}
    grams = [{int(g): int(c) for g, c in enumerate(langid.gram_counts(t)) if c} for t in texts]
    for i in fit:
        for g in grams[i]:
            df[g] = df.get(g, 0) + 1
    rows = []
    for found in grams:
        row = {g: (1 + math.log(c)) * (math.log((1 + len(fit)) / (1 + df.get(g, 0))) + 1) for g, c in found.items()}
        norm = math.sqrt(sum(v * v for v in row.values()))
        rows.append({g: v / norm for g, v in row.items()} | {-1: 1.0})
    z, n = {}, {}

    def weight(g, k):
        s = z.get((g, k), 0.0)
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n.get((g, k), 0.0))) / alpha + l2)

    for epoch in range(2):
        for i in np.random.default_rng(seed + epoch).permutation(fit).tolist():
            own = {(g, k): weight(g, k) for g in rows[i] for k in (0, 1)}
            score = [sum(x * own[g, k] for g, x in rows[i].items()) for k in (0, 1)]
            top = [math.exp(s - max(score)) for s in score]
            for k in (0, 1):
                error = top[k] / sum(top) - (("de", "en")[k] == labels[i])
                for g, x in rows[i].items():
                    step, before = x * error, n.get((g, k), 0.0)
                    z[g, k] = z.get((g, k), 0.0) + step - (math.sqrt(before + step * step) - math.sqrt(before)) / alpha * own[g, k]
                    n[g, k] = before + step * step
    for k in (0, 1):
        assert model.bias[k] == pytest.approx(weight(-1, k))
        assert all(model.weights[g, k] == pytest.approx(weight(g, k), abs=1e-6) for g in df)
    assert {int(g) for g in model.used} == {g for g in df if weight(g, 0) or weight(g, 1)}
