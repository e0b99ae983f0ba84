"""SentencePiece encoding and decoding in numpy, whole batches of words at a time.

A text's spaces become the mark U+2581, and one more leads it. No piece has a mark after another
character, so the text falls into words (marks, then other characters) that are encoded
independently; each distinct word of a batch is encoded once, and remembered. Words of
equal length are one matrix and advance together. A substring's hash is made from prefix
hashes and probes the sorted hashes of the pieces.

Unigram models: Viterbi. For every end position the candidates of all lengths are compared
over all words at once, and the vectorised maxima store back pointers, which are then followed
for all words at once. BPE models: a maximum over sums of scores isn't what such a
model means, so Viterbi would give other ids than the model's; here in each step all words of
the matrix merge their best pair, the leftmost of equals. As every step shortens every word that
still merges by one, the matrix stays rectangular. Words of more than ``LONG`` characters would make it
slow, and go through a heap one by one.

Characters without a piece become their UTF-8 bytes where the model has byte pieces, else the
unknown piece. Decoding is exact: it gives the text back, but for marks that were in the text
(they come back as spaces) and characters that became unknown.

Null and empty texts have no ids. Repeated rows repeat. Very long texts are encoded whole. An
empty table gives an empty result. Only the id and text columns are read. The model's bytes (its
size is bounded by ``MAX_MODEL_BYTES``) are read by the driver and travel with the tasks.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import few_at_a_time, giving_back

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
BASE = np.uint64(0x9E3779B97F4A7C15)
LONG = 64
KNOWN = 250_000
MAX_MODEL_BYTES = 64 << 20
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNKNOWN_PENALTY = 10.0
NEVER = np.iinfo(np.int32).max


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """Pieces, scores and what the normaliser does; only identity normalisation is supported."""

    def __init__(self, data: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                got = dict(_fields(value))
                pieces.append((got[1].decode("utf-8"), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only identity normalisation that keeps white space and leads with a mark is supported")
        self.pieces = [p for p, _, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next(i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN)
        if any(t not in (NORMAL, UNKNOWN, 3, BYTE) for _, _, t in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        usual = [(p, s, i) for i, (p, s, t) in enumerate(pieces) if t == NORMAL]
        if any(MARK in p.lstrip(MARK) for p, _, _ in usual):
            raise ValueError("pieces with a mark after another character are not supported")
        self.by_text = {p: (s, i) for p, s, i in usual}
        self.longest = max(map(len, self.by_text))
        hashes = np.array([hash_of(p) for p, _, _ in usual], np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        self.scores = np.array([s for _, s, _ in usual], np.float64)[order]
        self.ids = np.array([i for _, _, i in usual], np.int32)[order]
        self.lowest = self.scores.min() - UNKNOWN_PENALTY
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == 3 else p.replace(MARK, " ").encode("utf-8") for p, _, t in pieces]
        self.raw[self.unknown] = " ⁇ ".encode()
        if self.kind == BPE:
            self._tabulate()

    def _tabulate(self) -> None:
        """The symbols of single characters, and what pairs of symbols merge to.

        A symbol is a piece's id; characters that only occur within longer pieces get numbers beyond those, and
        characters of no piece negative ones. Ranks follow the scores, the best first."""
        symbol = {p: i for p, (_, i) in self.by_text.items()}
        self.inner = sorted({c for p in self.by_text for c in p} - symbol.keys())
        symbol |= {c: len(self.pieces) + k for k, c in enumerate(self.inner)}
        self.symbols = len(self.pieces) + len(self.inner)
        self.of_char = -1 - np.arange(0x110000)
        for p, i in symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        rank = {score: k for k, score in enumerate(sorted({s for s, _ in self.by_text.values()}, reverse=True))}
        made = [(symbol[p[:k]] * self.symbols + symbol[p[k:]], rank[s], i) for p, (s, i) in self.by_text.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        pairs = np.array(sorted(made), np.int64).reshape(-1, 3)
        # a last key that no pair has
        self.pair_keys = np.append(pairs[:, 0], np.iinfo(np.int64).max)
        self.pair_ranks, self.pair_ids = (np.append(pairs[:, c], -1).astype(np.int32) for c in (1, 2))

    def merges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) of pairs of symbols; NEVER where they don't merge."""
        keys = np.where((left < 0) | (right < 0), -1, left * self.symbols + right)  # -1 is no pair's
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER), self.pair_ids[at]

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of substrings by hash; -inf and -1 where no piece has it."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return np.where(hit, self.scores[at], -np.inf), np.where(hit, self.ids[at], -1)

    def ids_of(self, symbols: list[int]) -> list[int]:
        """Ids of symbols of which some aren't pieces."""
        out: list[int] = []
        for x in symbols:
            out += [x] if 0 <= x < len(self.pieces) else self.spelled(chr(-1 - x) if x < 0 else self.inner[x - len(self.pieces)])
        return _one_unknown(self, out)

    def spelled(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.bytes[b] for b in char.encode("utf-8")] if self.bytes else [self.unknown]


@lru_cache(maxsize=2)
def load(data: bytes) -> Model:
    return Model(data)


def hash_of(text: str) -> int:
    value = 0
    for c in text:
        value = (value * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return value


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, BASE))))


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def _viterbi(model: Model, words: list[str]) -> list[list[int]]:
    codes = _matrix(words)
    n, size = codes.shape
    power = _powers(size)
    prefix = np.zeros((n, size + 1), np.uint64)
    for k in range(size):
        prefix[:, k + 1] = prefix[:, k] * BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back = np.ones((n, size + 1), np.int64)
    piece = np.full((n, size + 1), -1, np.int32)
    for end in range(1, size + 1):
        for length in range(min(model.longest, end), 0, -1):
            start = end - length
            score, ids = model.probe(prefix[:, end] - prefix[:, start] * power[length])
            if length == 1:  # a character without a piece
                score = np.where(ids < 0, model.lowest, score)
            total = best[:, start] + score
            better = total > best[:, end]
            best[better, end] = total[better]
            back[better, end] = length
            piece[better, end] = ids[better]
    out: list[list[int]] = [[] for _ in words]
    at = np.full(n, size)
    rows = np.arange(n)
    while len(rows):
        for row, end, found in zip(rows.tolist(), at.tolist(), piece[rows, at].tolist()):
            out[row].extend([found] if found >= 0 else reversed(model.spelled(words[row][end - 1])))
        at = at - back[rows, at]
        rows, at = rows[at > 0], at[at > 0]
    return [_one_unknown(model, ids[::-1]) for ids in out]


def _one_unknown(model: Model, ids: list[int]) -> list[int]:
    """Unknown pieces that follow each other are one."""
    if model.bytes or model.unknown not in ids:
        return ids
    return [x for k, x in enumerate(ids) if x != model.unknown or not k or ids[k - 1] != x]


def _merge(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in turn, number of each word's ids)."""
    symbols = model.of_char[_matrix(words)]
    scores, to = model.merges(symbols[:, :-1], symbols[:, 1:])
    rows, n_ids = np.arange(len(words)), np.zeros(len(words), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rows):
        width = symbols.shape[1]
        r = np.arange(len(rows))
        j = scores.argmin(axis=1) if width > 1 else r * 0
        going = scores[r, j] < NEVER if width > 1 else np.zeros(len(rows), bool)
        if not going.all():
            done.append((rows[~going], symbols[~going]))
            n_ids[rows[~going]] = width
            rows, symbols, scores, to, j = rows[going], symbols[going], scores[going], to[going], j[going]
            if not len(rows):
                break
            r = np.arange(len(rows))
        symbols[r, j] = to[r, j]
        keep = np.ones(symbols.shape, bool)
        keep[r, j + 1] = False
        symbols = symbols[keep].reshape(len(r), -1)
        keep = np.ones(scores.shape, bool)
        keep[r, j] = False
        scores, to = scores[keep].reshape(len(r), -1), to[keep].reshape(len(r), -1)
        for k, side in ((j - 1, j > 0), (j, j < symbols.shape[1] - 1)):
            x, k = r[side], k[side]
            scores[x, k], to[x, k] = model.merges(symbols[x, k], symbols[x, k + 1])
    odd = {}
    for at, found in done:  # words with characters that no piece is
        places = np.flatnonzero(((found < 0) | (found >= len(model.pieces))).any(axis=1))
        for row, left in zip(at[places].tolist(), found[places].tolist()):
            odd[row] = model.ids_of(left)
            n_ids[row] = len(odd[row])
    start = np.cumsum(n_ids) - n_ids
    out = np.empty(n_ids.sum(), np.int32)
    for at, found in done:
        usual = np.array([row not in odd for row in at.tolist()], bool) if odd else slice(None)
        out[start[at[usual]][:, None] + np.arange(found.shape[1])] = found[usual]
    for row, ids in odd.items():
        out[start[row] : start[row] + len(ids)] = ids
    return out, n_ids


def _merge_long(model: Model, word: str) -> list[int]:
    """The same merges, with a heap of pairs and links between the symbols that are left."""
    text: list[str | None] = list(word)
    after, before = [*range(1, len(text)), -1], [-1, *range(len(text) - 1)]
    heap: list[tuple[float, int, int, str]] = []

    def offer(a: int) -> None:
        if a >= 0 and (b := after[a]) >= 0 and (got := model.by_text.get(both := text[a] + text[b])):
            heapq.heappush(heap, (-got[0], a, b, both))

    for a in range(len(text) - 1):
        offer(a)
    while heap:
        _, a, b, both = heapq.heappop(heap)
        if text[a] is None or after[a] != b or text[a] + text[b] != both:
            continue
        text[a], text[b] = both, None
        after[a] = after[b]
        if after[b] >= 0:
            before[after[b]] = a
        offer(before[a])
        offer(a)
    out: list[int] = []
    for x in text:
        if x is not None:
            out.extend([model.by_text[x][1]] if x in model.by_text else model.spelled(x))
    return _one_unknown(model, out)


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in found], np.int64)
    return np.array([i for x in found for i in x], np.int32), sizes


def encode_words(model: Model, words: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Distinct words in parts: (words, their ids in turn, number of each word's ids)."""
    sized: dict[int, list[str]] = {}
    for w in words:
        sized.setdefault(0 if len(w) > LONG and model.kind == BPE else len(w), []).append(w)
    if long := sized.pop(0, None):
        yield long, *_flat([_merge_long(model, w) for w in long])
    for size, same in sized.items():
        step = max(1, 200_000 // size)  # bounds the matrices
        for lo in range(0, len(same), step):
            part = same[lo : lo + step]
            yield part, *(_flat(_viterbi(model, part)) if model.kind == UNIGRAM else _merge(model, part))


def words_of(text: str) -> list[str]:
    """A text's words, each without its first mark, which all have."""
    if "  " not in text and MARK not in text and text.strip(" ") == text:
        return text.split(" ") if text else []
    return [w[1:] for w in WORD.findall(MARK + text.replace(" ", MARK))]


class Encoder:
    """Encodes texts and remembers up to ``KNOWN`` words, as places in one array of ids."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, words: set[str]) -> None:
        fresh = [MARK + w for w in words if w not in self.place]
        if not fresh:
            return
        ids, sizes = [self.ids], [self.size]
        for part, found, n in encode_words(self.model, fresh):
            self.place |= zip([w[1:] for w in part], range(len(self.place), len(self.place) + len(part)))
            ids.append(found)
            sizes.append(n)
        self.ids, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [words_of(t) for t in texts]
        if len(self.place) > KNOWN:
            self.forget()
        self.learn(set().union(*split))
        out = []
        for words in split:
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            n = self.size[at]
            out.append(self.ids[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = self.model.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def encoder_of(data: bytes) -> Encoder:
    """The worker's encoder: the words that it knows serve all tasks which the worker runs."""
    return Encoder(load(data))


def read_model(path: str) -> bytes:
    """A model file that the driver can open."""
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"a model of more than {MAX_MODEL_BYTES} bytes: {path}")
    return data


def encode(df: DataFrame, model_data: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_tokens, ids, lossless): lossless says whether decoding the ids gives the
    text (with spaces for its marks)."""
    shown = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    held = df.sparkSession.sparkContext.broadcast(model_data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(held.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column(1).to_pylist()
                found = encoder.encode(texts)
                lossless = [encoder.decode(ids) == text.replace(MARK, " ") for ids, text in zip(found, texts)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.diff(offsets).astype(np.int64)), ids, pa.array(lossless)], names=[id_col, "n_chars", "n_tokens", "ids", "lossless"]
                )

    return few_at_a_time(shown).mapInArrow(giving_back(run), f"`{id_col}` {shown.schema[0].dataType.simpleString()}, n_chars long, n_tokens long, ids array<int>, lossless boolean")


def decode(df: DataFrame, model_data: bytes, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids give a null text."""
    shown = df.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("_ids"))
    held = df.sparkSession.sparkContext.broadcast(model_data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(held.value)
        for batch in batches:
            texts = [encoder.decode(np.array(x.as_py(), np.int64)) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return few_at_a_time(shown).mapInArrow(giving_back(run), f"`{id_col}` {shown.schema[0].dataType.simpleString()}, text string")
