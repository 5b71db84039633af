"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input joins what is learnt for the word (its log odds over the training documents, and an embedding) with what its
characters say: the log odds of its longest known prefix, and the mean of embeddings of its character trigrams and prefixes, so
that unknown words still have one. Texts are read as windows of 32 words that overlap
by half; every window of every whole text is scored, and a document scores as its most toxic window, through a logistic
calibration. Training sees documents, not windows: each step descends along the window that scores highest.

A run without white space is cut into words of MAX_WORD characters one after the other, so that unspaced text is read to its end too.

It is fitted on the driver on a sample of at most MAX_PER_CLASS ids of each label; a text over MAX_TRAIN_CHARS characters
gives so many, in pieces from all over it. Both are parameters. Scoring takes the same arrays to every task: their size is bounded by MAX_VOCABULARY.

Defined cases: null, empty and blank texts score as a window without words. Labels that are null count as none; of several
labels for one id, the largest counts; of several texts for one id, one is learnt from. With no label of one class, every score is the constant 0.0. Rows repeated keep a row each.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import is_held_out, map_texts, sampled, table

MAX_PER_CLASS, MAX_TRAIN_CHARS, MAX_VOCABULARY = 1500, 12_000, 20_000
WINDOW, STRIDE, HIDDEN = 32, 16, 8
WORD_DIM, CHAR_DIM, CHAR_ROWS = 8, 8, 8192
PREFIXES = (9, 8, 7, 6, 5, 4, 3)
#: Characters of the words that a longer run is cut into.
MAX_WORD = 64
#: Windows that advance together, and words whose inputs a worker keeps.
CHUNK, MAX_CACHE = 4096, 150_000
EDGE = string.punctuation + "«»“”„’…"


def words_of(text: str | None) -> list[str]:
    words = (text or "").lower().split()
    if max(map(len, words), default=0) <= MAX_WORD:
        return words
    return [w[at : at + MAX_WORD] for w in words for at in range(0, len(w), MAX_WORD)]


def char_rows(word: str) -> list[int]:
    """Rows of the word's character trigrams and of its prefixes."""
    padded = f"^{word}$".encode("utf-8", "surrogatepass")
    return [zlib.crc32(padded[i : i + 3]) % CHAR_ROWS for i in range(max(1, len(padded) - 2))] + [zlib.crc32(padded[:k]) % CHAR_ROWS for k in range(4, min(len(padded), 10))]


def prefixes(word: str) -> list[str]:
    return ["^" + word[:k] for k in PREFIXES if len(word) >= k]


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows over n words: every STRIDE words, until a window reaches the end."""
    return np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE) if n > WINDOW else np.zeros(1, dtype=np.int64)


def cut_windows(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts, first, at = [], [0], 0
    for n in lengths:
        starts = window_starts(n)
        padded = np.zeros(starts[-1] + WINDOW, np.int32)
        padded[:n] = ids[at : at + n]
        parts.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts])
        first.append(first[-1] + len(starts))
        at += n
    return np.concatenate(parts), np.array(first[:-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def fast_sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def add_rows(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Adds each row of values to the row of out that `at` names; rows of one name are summed first."""
    if len(at):
        order = np.argsort(at, kind="stable")
        names = at[order]
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        out[names[starts]] += np.add.reduceat(values[order], starts, axis=0)


class ToxicityModel:
    """Parameters as float32 arrays; row 0 of the words' table stands for no known word."""

    def __init__(self, vocabulary: dict[str, int], odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        x, h = 2 + WORD_DIM + CHAR_DIM, HIDDEN
        self.vocabulary, self.odds = vocabulary, odds.astype(np.float32)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"words": draw(len(odds), WORD_DIM, scale=0.01), "chars": draw(CHAR_ROWS, CHAR_DIM, scale=0.05)}
        for way in "fb":
            self.p |= {f"W{way}": draw(x, 3 * h, scale=0.3), f"U{way}": draw(h, 3 * h, scale=0.3), f"c{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"att": draw(2 * h, scale=0.3), "out": draw(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
        self.calibration = (1.0, 0.0)
        self._reset()

    def _reset(self) -> None:
        self._ids: dict[str, int] = {}
        self._inputs = {way: np.zeros((1024, 3 * HIDDEN), np.float32) for way in "fb"}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_ids", "_inputs")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._reset()

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What doesn't change in training: rows of the words' table, rows of the characters' table with -1 after each word's, odds."""
        bare = [w.strip(EDGE) or w for w in words]
        known = self.vocabulary.get
        rows = np.array([known(w, 0) for w in bare], dtype=np.int64)
        stems = np.array([next((k for p in prefixes(w) if (k := known(p))), 0) for w in bare], dtype=np.int64)
        grams = np.fromiter((x for w in bare for x in (*char_rows(w), -1)), np.int64)
        return rows, grams, np.stack([self.odds[rows], self.odds[stems]], axis=1)

    def vectors(self, rows: np.ndarray, grams: np.ndarray, odds: np.ndarray) -> np.ndarray:
        ends = np.flatnonzero(grams < 0)
        starts = np.r_[0, ends[:-1] + 1]
        taken = self.p["chars"][grams]
        taken[ends] = 0
        return np.concatenate([odds, self.p["words"][rows], np.add.reduceat(taken, starts, axis=0) / (ends - starts)[:, None]], axis=1).astype(np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Numbers of the words in the inputs that are kept; new words are added."""
        known = self._ids
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            x, at, end = self.vectors(*self.features(new)), len(known) + 1, len(known) + len(new) + 1
            known.update(zip(new, range(at, end), strict=True))
            for way in "fb":
                if end > len(self._inputs[way]):
                    self._inputs[way] = np.concatenate([self._inputs[way], np.zeros((max(end, len(self._inputs[way])), 3 * HIDDEN), np.float32)])
                self._inputs[way][at:end] = x @ self.p[f"W{way}"] + self.p[f"c{way}"]
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def run(self, ids: np.ndarray, keep: bool = False):
        """Logits of windows of word numbers (0: no word). keep: also what backpropagation needs."""
        n, steps, h = *ids.shape, HIDDEN
        there = ids > 0
        states = np.empty((steps, n, 2 * h), np.float32)
        tape: dict[str, list] = {"f": [], "b": []}
        for way, at in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            inputs, u = self._inputs[way], self.p[f"U{way}"]
            s = np.zeros((n, h), np.float32)
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                x = inputs[ids[:, t]]
                su = s @ u
                gates = fast_sigmoid(x[:, : 2 * h] + su[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * su[:, 2 * h :])
                new = c + z * (s - c)
                new = np.where(there[:, t, None], new, s)
                if keep:
                    tape[way].append((t, s, su, z, r, c))
                s = new
                states[t, :, at] = s
        a = np.where(there.T, states @ self.p["att"], -30.0)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, (there, states, a, pooled, tape)) if keep else logits

    def gradients(self, ids: np.ndarray, dlogit: np.ndarray, tape_) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the parameters, and of the inputs by way and word number."""
        there, states, a, pooled, tape = tape_
        h, g = HIDDEN, {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * self.p["out"]
        da = np.einsum("nh,tnh->tn", dpool, states)
        dscore = a * (da - (a * da).sum(axis=0))
        dscore[~there.T] = 0
        g["att"] = np.einsum("tn,tnh->h", dscore, states)
        dstates = a[:, :, None] * dpool + dscore[:, :, None] * self.p["att"]
        dinputs = {}
        for way, at in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, du, dx = self.p[f"U{way}"], np.zeros_like(self.p[f"U{way}"]), np.zeros_like(self._inputs[way])
            ds, each = np.zeros((len(ids), h), np.float32), np.empty((ids.shape[1], len(ids), 3 * h), np.float32)
            for t, s, su, z, r, c in reversed(tape[way]):
                on = there[:, t, None]
                full = ds + dstates[t, :, at]
                dn = np.where(on, full, 0)
                dz, dc = dn * (s - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
                dr = dc * su[:, 2 * h :] * r * (1 - r)
                dgates = np.concatenate([dz, dr, dc * r], axis=1)
                each[t] = np.concatenate([dz, dr, dc], axis=1)
                du += s.T @ dgates
                ds = np.where(on, dn * z + dgates @ u.T, full)
            add_rows(dx, ids.T.ravel(), each.reshape(-1, 3 * h))
            g[f"U{way}"], dinputs[way] = du, dx
        return g, dinputs

    def windows(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All windows of the texts as word numbers, and each text's first window."""
        split = [words_of(t) for t in texts]
        return cut_windows(self.ids([w for words in split for w in words]), np.array([len(words) for words in split]))

    def logits(self, texts: list) -> np.ndarray:
        """The largest logit of each text's windows."""
        if len(self._ids) > MAX_CACHE:
            self._reset()
        ids, first = self.windows(texts)
        every = np.concatenate([self.run(ids[at : at + CHUNK]) for at in range(0, len(ids), CHUNK)])
        return np.maximum.reduceat(every, first)

    def scores(self, texts: list) -> np.ndarray:
        slope, shift = self.calibration
        return sigmoid(slope * self.logits(texts).astype(np.float64) + shift) if texts else np.zeros(0)


def document_odds(split: list[list[str]], y: np.ndarray, of: dict[int, float], least: int = 4) -> tuple[dict[str, float], dict[str, int]]:
    """Shrunken log odds, and numbers of documents, of the words and prefixes that `least` documents have.

    A word's terms are hashed once; only those that stay get back their strings, so that a large vocabulary costs 8 bytes a term.
    """

    def terms(word: str) -> list[str]:
        bare = word.strip(EDGE) or word
        return [bare, *prefixes(bare)]

    number = {w: k for k, w in enumerate(dict.fromkeys(w for words in split for w in words))}
    names = list(number)
    sizes = np.fromiter((len(terms(w)) for w in names), np.int64, len(names))
    hashes = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for w in names for t in terms(w)), np.uint64, int(sizes.sum()))
    every, where, term = np.unique(hashes, return_index=True, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    n = np.zeros((2, len(every)), np.int64)
    for words, label in zip(split, y, strict=True):
        own = np.fromiter({number[w] for w in words}, np.int64)
        many = sizes[own]
        at = np.repeat(starts[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
        n[int(label), np.unique(term[at])] += 1
    total = n.sum(axis=0)
    values = (np.log((n[1] + 0.5) / (of[1] + 1)) - np.log((n[0] + 0.5) / (of[0] + 1))) * total / (total + 4)
    odds, both = {}, {}
    for k in np.flatnonzero(total >= least).tolist():
        word = int(np.searchsorted(starts, where[k], side="right")) - 1
        t = terms(names[word])[where[k] - starts[word]]
        odds[t], both[t] = float(values[k]), int(total[k])
    return odds, both


def train(texts: list[str], labels: list[int], epochs: int = 8, rate: float = 0.02, batch: int = 256, least_steps: int = 120, seed: int = 7) -> ToxicityModel | None:
    """None where the labels are all alike."""
    y = np.array(labels, dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return None
    split, of = [words_of(t) for t in texts], {k: float((y == k).sum()) for k in (0, 1)}
    odds, both = document_odds(split, y, of)
    kept = sorted(odds, key=lambda w: (-abs(odds[w]) * np.log1p(both[w]), w))[:MAX_VOCABULARY]
    model = ToxicityModel({w: k for k, w in enumerate(kept, 1)}, np.clip(np.array([0.0, *(odds[w] for w in kept)]), -4, 4), seed)
    number = {w: k for k, w in enumerate(dict.fromkeys(w for words in split for w in words))}
    rows, grams, fixed = model.features(list(number))
    ends = np.flatnonzero(grams < 0)
    starts = np.r_[0, ends[:-1] + 1]
    numbers = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in split]
    rng, moments = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    weight = np.where(y == 1, 0.5 / of[1], 0.5 / of[0]).astype(np.float32) * len(y)
    batch, step = min(batch, max(32, len(texts) // 8)), 0
    for _ in range(max(epochs, -(-least_steps // -(-len(texts) // batch)))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            lengths = np.array([len(numbers[i]) for i in chosen])
            used, ids = np.unique(np.concatenate([numbers[i] for i in chosen]), return_inverse=True)
            many = ends[used] - starts[used] + 1
            own = grams[np.repeat(starts[used] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            x = model.vectors(rows[used], own, fixed[used]) if len(used) else np.zeros((0, 2 + WORD_DIM + CHAR_DIM), np.float32)
            model._inputs = {way: np.concatenate([np.zeros((1, 3 * HIDDEN), np.float32), x @ model.p[f"W{way}"] + model.p[f"c{way}"]]) for way in "fb"}
            ids, first = cut_windows(ids + 1, lengths)
            every = np.concatenate([model.run(ids[k : k + CHUNK]) for k in range(0, len(ids), CHUNK)])
            last = np.r_[first[1:], len(ids)]
            best = ids[[a + int(every[a:b].argmax()) for a, b in zip(first, last, strict=True)]]
            logit, tape = model.run(best, keep=True)
            g, dinputs = model.gradients(best, ((sigmoid(logit) - y[chosen]) * weight[chosen] / len(chosen)).astype(np.float32), tape)
            dx = np.zeros_like(x)
            for way in "fb":
                got = dinputs[way][1:]
                g[f"W{way}"], g[f"c{way}"] = x.T @ got, got.sum(axis=0)
                dx += got @ model.p[f"W{way}"].T
            g["words"], g["chars"] = np.zeros_like(model.p["words"]), np.zeros_like(model.p["chars"])
            add_rows(g["words"], rows[used], dx[:, 2 : 2 + WORD_DIM])
            g["words"][0] = 0
            spread = np.repeat(dx[:, 2 + WORD_DIM :] / (many - 1)[:, None], many, axis=0)
            hit = np.flatnonzero((own >= 0) & spread.any(axis=1))
            add_rows(g["chars"], own[hit], spread[hit])
            step += 1
            for k, v in model.p.items():
                m1, m2 = moments[k]
                grad = g[k] + 1e-4 * v
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad * grad - m2)
                v -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model._reset()
    top = np.concatenate([model.logits(texts[i : i + 256]) for i in range(0, len(texts), 256)]).astype(np.float64)
    slope, shift = 1.0, 0.0
    for _ in range(300):  # logistic calibration at the labels' own frequencies
        off = sigmoid(slope * top + shift) - y
        slope, shift = slope - 0.05 * float((off * top).mean()), shift - 0.2 * float(off.mean())
    model.calibration = (max(slope, 1e-3), shift)
    model._reset()
    return model


def training_rows(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_TRAIN_CHARS) -> tuple[list[str], list[int]]:
    """The sample: of each class the labelled ids that come first by hash, of those that have a text; held-out ids left out."""
    known = labels.where(F.col(label).isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.join(documents.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi")
    picked = None
    for value in (0, 1):
        part = known.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class)
        picked = part if picked is None else picked.union(part)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    known = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "y", F.struct(F.xxhash64("text").alias("h"), sampled(F.col("text"), max_chars).alias("text")).alias("t"))
    rows = known.groupBy("doc_id", "y").agg(F.min("t").alias("t")).orderBy("doc_id").collect()  # picked: 2 max_per_class ids at most
    return [r["t"]["text"] for r in rows], [r["y"] for r in rows]


def score_documents(df: DataFrame, model: ToxicityModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, and score: 0 to 1, higher where the text's most toxic window is likelier to be labelled so."""

    def compute(texts: list) -> dict:
        return {"score": pa.array(np.zeros(len(texts)) if model is None else model.scores(texts))}

    return map_texts(df, text, "score double", compute, list(keep))


def fit(spark: SparkSession, sf_dir: str) -> ToxicityModel | None:
    return train(*training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), fit(spark, sf_dir))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
