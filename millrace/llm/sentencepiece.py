"""SentencePiece encoding and decoding in batched numpy.

Words of equal length form a matrix of code points and advance together. Hashes of all their substrings, from prefix sums, are
looked up among the sorted keys of the vocabulary's pieces. For a unigram model a Viterbi pass over the ends of the words
takes the vectorised maximum over pieces and stores backpointers. A BPE model has no scores to add: its encoding is the result of
merges by rank, which the highest-scoring path gives for fewer than half of the words. So BPE models resolve the same table of
pieces by merging, in every word at once the pair of least rank; the maximum is vectorised as well. BPE ids equal the sentencepiece
library's id by id; the path's score equals the best of all segmentations. viterbi=True takes the best path whatever the type.

Characters without a piece become byte pieces. Decoding joins the pieces' bytes; text survives the round trip unless it holds
U+2581, which SentencePiece itself uses for a space, or isn't valid Unicode.

Defined cases: null text gives null ids and decodes to null; '' gives no ids. Words too long for a matrix are merged through a
heap. Rows repeated keep a row each. Empty tables give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import map_texts, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words of up to LONG characters go into matrices of about CELLS cells; a worker keeps the ids of MAX_CACHE words.
LONG, CELLS, MAX_CACHE = 200, 1 << 19, 300_000
UNK_PENALTY = 10.0
BASE = np.uint64(0x9E3779B97F4A7C15)
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k, column in enumerate(mixed(codes.T)):
        out[:, k + 1] = out[:, k] * BASE + column
    return out


class Pieces:
    """A model's pieces, from the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        parsed = proto.ModelProto.FromString(model)
        if parsed.normalizer_spec.name != "identity" or parsed.normalizer_spec.remove_extra_whitespaces or not parsed.normalizer_spec.add_dummy_prefix or not parsed.trainer_spec.byte_fallback:
            raise ValueError("only models with identity normalisation, a dummy prefix and byte fallback are read")
        self.type = parsed.trainer_spec.model_type
        self.texts = [p.piece for p in parsed.pieces]
        kinds = np.array([p.type for p in parsed.pieces])
        usable = np.flatnonzero((kinds == NORMAL) | (kinds == USER))
        self.scores = np.array([p.score for p in parsed.pieces], np.float32).astype(np.float64)
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if kinds[i] == BYTE}
        self.bytes = [bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(SPACE, " ").encode() if k in (NORMAL, USER) else b"" for t, k in zip(self.texts, kinds, strict=True)]
        self.longest = max(len(self.texts[i]) for i in usable)
        self.unknown = float(self.scores[usable].min()) - UNK_PENALTY
        keys = np.array([self._key(self.texts[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], usable[order].astype(np.int32)
        if (np.diff(self.keys.view(np.uint64)) == 0).any():
            raise ValueError("two pieces share a hash")
        self.starts = np.searchsorted(self.keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int64)
        self.starts = np.r_[self.starts, len(self.keys)]
        self.most = int(np.diff(self.starts).max())
        alphabet = {c for i in usable for c in self.texts[i]}
        alone = "" if "\n" in alphabet else "\n"
        self.split = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL).findall

    @staticmethod
    def _key(piece: str) -> np.uint64:
        return mixed(prefix_hashes(points([piece], len(piece)))[:, -1])[0]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these keys, -1 where there is none."""
        flat = hashes.ravel()
        top = (flat >> np.uint64(48)).astype(np.int64)
        at, end = self.starts[top], self.starts[top + 1]
        found, left = np.full(len(flat), -1, np.int32), np.flatnonzero(at < end)
        for _ in range(self.most):
            if not len(left):
                break
            here = at[left]
            hit = self.keys[here] == flat[left]
            found[left[hit]] = self.ids[here[hit]]
            at[left] += 1
            left = left[~hit & (here + 1 < end[left])]
        return found.reshape(hashes.shape)

    def substrings(self, codes: np.ndarray) -> np.ndarray:
        """[word, start, length - 1]: the id of the piece that stands there, or -1."""
        n, length = codes.shape
        most = min(self.longest, length)
        sums, power = prefix_hashes(codes), np.array([BASE])
        out = np.full((n, length, most), -1, np.int32)
        for size in range(1, most + 1):
            out[:, : length - size + 1, size - 1] = self.lookup(mixed(sums[:, size:] - sums[:, : length - size + 1] * power))
            power = power * BASE
        return out

    def viterbi(self, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces on the path with the highest sum of scores: whether one starts at [word, place], and where it ends."""
        n, length, most = table_.shape
        best, back = np.full((n, length + 1), -np.inf), np.zeros((n, length + 1), np.int32)
        best[:, 0] = 0
        for end in range(1, length + 1):
            sizes = np.arange(min(most, end), 0, -1)  # of equal sums the longest last piece wins
            ids = table_[:, end - sizes, sizes - 1]
            scores = np.where(ids >= 0, self.scores[ids], -np.inf)
            scores[:, -1] = np.where(ids[:, -1] >= 0, scores[:, -1], self.unknown)
            total = best[:, end - sizes] + scores
            chosen = total.argmax(axis=1)
            back[:, end] = sizes[chosen]
            best[:, end] = total[np.arange(n), chosen]
        alive, nexts = np.zeros((n, length), bool), np.zeros((n, length), np.int64)
        rows, end = np.arange(n), np.full(n, length)
        while len(rows):
            start = end - back[rows, end]
            alive[rows, start], nexts[rows, start] = True, end
            on = start > 0
            rows, end = rows[on], start[on]
        return alive, nexts

    def merged(self, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What remains, as in viterbi(), when the adjacent pair with the best score is merged, leftmost first, again and again."""
        n, length, most = table_.shape
        scores = np.where(table_ >= 0, self.scores[table_], -np.inf)
        nexts = np.minimum(np.tile(np.arange(1, length + 3), (n, 1)), length)  # of each start the next one; two ends as sentinels
        before = np.tile(np.arange(-1, length + 1), (n, 1))
        alive = np.ones((n, length), bool)
        rows = np.arange(n)
        pair = np.full((n, length), -np.inf)  # score of merging the token at start with the next one
        if length > 1 and most > 1:
            pair[:, : length - 1] = scores[:, : length - 1, 1]
        while len(rows):
            first = pair[rows].argmax(axis=1)
            on = pair[rows, first] > -np.inf
            rows, first = rows[on], first[on]
            second = nexts[rows, first]
            third = nexts[rows, second]
            nexts[rows, first], before[rows, third] = third, first
            alive[rows, second], pair[rows, second] = False, -np.inf
            self._renew(pair, scores, nexts, rows, first, length, most)
            left = before[rows, first]
            has = left >= 0
            self._renew(pair, scores, nexts, rows[has], left[has], length, most)
        return alive, nexts[:, :length]

    @staticmethod
    def _renew(pair, scores, nexts, rows, at, length, most) -> None:
        second = nexts[rows, at]
        size = nexts[rows, second] - at
        fits = (second < length) & (size <= most)
        pair[rows, at] = np.where(fits, scores[rows, at, np.minimum(size, most) - 1], -np.inf)

    def merged_long(self, row: np.ndarray) -> list[tuple[int, int]]:
        """merged() of one long word, with a heap."""
        length, most = row.shape
        nexts, before, alive = [*range(1, length + 1), length], [*range(-1, length)], [True] * length
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = nexts[i]
            if j < length and (size := nexts[j] - i) <= most and (piece := row[i, size - 1]) >= 0:
                heapq.heappush(heap, (-self.scores[piece], i, size))

        for i in range(length):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            if not alive[i] or (j := nexts[i]) >= length or nexts[j] - i != size:
                continue
            alive[j], nexts[i] = False, nexts[j]
            if nexts[i] < length:
                before[nexts[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [(i, nexts[i] - i) for i in range(length) if alive[i]]

    def spelled(self, words: list[str], table_: np.ndarray, alive: np.ndarray, nexts: np.ndarray) -> list[bytes]:
        """The words' ids as little-endian 32-bit integers; a place without a piece gives byte pieces."""
        row, at = np.nonzero(alive)
        ids = table_[row, at, np.minimum(nexts[row, at] - at, table_.shape[2]) - 1].astype("<i4")
        ends = 4 * np.cumsum(alive.sum(axis=1))
        flat, out, start = ids.tobytes(), [], 0
        for end in ends.tolist():
            out.append(flat[start:end])
            start = end
        for k in np.unique(row[ids < 0]).tolist():
            mine = row == k
            parts = [[i] if i >= 0 else [self.byte[b] for b in words[k][p].encode("utf-8", "replace")] for i, p in zip(ids[mine].tolist(), at[mine].tolist(), strict=True)]
            out[k] = np.array([i for p in parts for i in p], "<i4").tobytes()
        return out

    def encode_words(self, words: list[str], modes: tuple[bool, ...]) -> list[dict[str, bytes]]:
        """For each mode (True: the best path, False: merges) the ids of each word. The table of pieces is made once."""
        out, by_length = [{} for _ in modes], {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            step = max(1, CELLS // (length * min(length, self.longest)))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                table_ = self.substrings(points(part, length))
                for mode, found in zip(modes, out, strict=True):
                    if mode or length <= LONG:
                        alive, nexts = self.viterbi(table_) if mode else self.merged(table_)
                    else:
                        alive, nexts = np.zeros((len(part), length), bool), np.zeros((len(part), length), np.int64)
                        for k, row in enumerate(table_):
                            for i, size in self.merged_long(row):
                                alive[k, i], nexts[k, i] = True, i + size
                    found.update(zip(part, self.spelled(part, table_, alive, nexts), strict=True))
        return out


class Codec:
    """Encodes and decodes whole texts; keeps the ids of words that it has met. modes: True for the best path, False for merges; None for what the model's type asks."""

    def __init__(self, model: bytes, viterbi: bool | None = None, modes: tuple[bool, ...] | None = None):
        self.model, self.want = model, modes or (None if viterbi is None else (viterbi,))
        self._load()

    def _load(self) -> None:
        self.pieces = Pieces(self.model)
        self.modes = self.want or (self.pieces.type == UNIGRAM,)
        self.known: list[dict[str, bytes]] = [{} for _ in self.modes]
        self._sizes = np.array([len(x) for x in self.pieces.bytes], np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._pool = np.frombuffer(b"".join(self.pieces.bytes), np.uint8)

    def __getstate__(self) -> dict:
        return {"model": self.model, "want": self.want}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._load()

    def encode_all(self, texts: list[str | None]) -> list[list[bytes | None]]:
        """For each mode the ids of each text as little-endian 32-bit integers."""
        split = [None if t is None else self.pieces.split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known[0]) > MAX_CACHE:
            self.known = [{} for _ in self.modes]
        met = self.known[0]
        new = [w for w in {w for words in split if words for w in words} if w not in met]
        if new:
            for known, found in zip(self.known, self.pieces.encode_words(new, self.modes), strict=True):
                known.update(found)
        return [[None if words is None else b"".join(map(known.__getitem__, words)) for words in split] for known in self.known]

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        return self.encode_all(texts)[0]

    def decode(self, ids: list[bytes | None]) -> list[str | None]:
        return [None if x is None else self._joined(np.frombuffer(x, "<i4")).decode("utf-8", "replace").removeprefix(" ") for x in ids]

    def _joined(self, ids: np.ndarray) -> bytes:
        """The pieces' bytes one after the other, gathered from one pool."""
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        return self._pool[np.repeat(self._starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def read_model(path: str = MODEL) -> bytes:
    """The model file's bytes; they travel to the tasks with the function (half a megabyte)."""
    with open(path, "rb") as file:
        return file.read()


def id_lists(ids: list[bytes | None]) -> pa.Array:
    flat = np.frombuffer(b"".join(x or b"" for x in ids), "<i4")
    offsets = np.r_[0, np.cumsum([len(x or b"") // 4 for x in ids])].astype(np.int32)
    found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in ids]))
    return found


def encode(df: DataFrame, model: bytes | None = None, viterbi: bool | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, and ids: array<int>."""
    codec = Codec(model or read_model(), viterbi)
    return map_texts(df, text, "ids array<int>", lambda texts: {"ids": id_lists(codec.encode(texts))}, list(keep))


def decode(df: DataFrame, model: bytes | None = None, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, and text."""
    codec = Codec(model or read_model())
    return map_texts(df, ids, "text string", lambda rows: {"text": codec.decode([None if x is None else np.array(x, "<i4").tobytes() for x in rows])}, list(keep))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids again and compares; the best path (viterbi_...) is reported beside the model's own encoding."""
    codec = Codec(read_model(), modes=(False, True))

    def compute(texts: list) -> dict:
        ids, best = codec.encode_all(texts)
        digest = lambda rows: [None if x is None else hashlib.sha256(x).hexdigest() for x in rows]
        count = lambda rows: [None if x is None else len(x) // 4 for x in rows]
        same = lambda rows: [None if t is None else t == back for t, back in zip(texts, codec.decode(rows), strict=True)]
        return {"n_ids": count(ids), "ids_sha256": digest(ids), "round_trip": same(ids), "viterbi_n_ids": count(best), "viterbi_sha256": digest(best), "viterbi_round_trip": same(best)}

    schema = "n_ids bigint, ids_sha256 string, round_trip boolean, viterbi_n_ids bigint, viterbi_sha256 string, viterbi_round_trip boolean"
    return map_texts(table(spark, sf_dir, "documents"), "text", schema, compute, ["doc_id"])
