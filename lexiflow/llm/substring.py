"""Substring dedup by recompression.

Rule: a window is 13 consecutive words of one document; every word in a window whose words also
start in a document with a smaller id is removed.

Recompression names adjacent tokens so that equal substrings get equal symbols inside. A token's
name is a hash of its bytes. Level 1 names runs (a token that repeats is one symbol; its name
holds the token, not the run's length, which a window may cut) and pairs: single tokens are dealt to a
left and a right class by their name, and a left one followed by a right one becomes a pair.
Level 2 pairs the symbols of level 1 in the same way. Names are hashes of what they stand
for, so all tasks agree on them without a table. Whether a symbol of level 2 begins at a word
depends on the 3 words before it and the 3 from it on (tested), so equal substrings have the same
symbols inside.

A symbol is known by the 8 words around its beginning, 3 before and 5 after, which hold all that
decided it. Every window stands under one name: the smallest of those symbols whose
8 words lie within it; of a window without such a symbol (inside a long run) its own hash. The name
depends on the window's words alone, so equal windows share it. Two Spark rounds follow.

Round 1, naming: each batch of texts sends its distinct names (40 bits and a bucket) to the
name's bucket, where names of several documents come to light. Only these are told back.
Round 2, verification: windows under shared names are compared by a 128-bit hash of all their 13
words, two independent sums of 64 bits over two independent halves of the words' hashes. Nothing is
removed on a shared name alone; that two windows with different words have equal hashes is expected once in 10^12
corpora of 10^13 windows.

Cost: round 1 shuffles 7 bytes for each name, of which there are about 0.3 a word; round 2 only what is under shared
names. Within a batch, and by a bounded memory of the windows that a task has met repeatedly, repeats are
settled on the spot: a passage in a third of all documents is some entries for each task. Buckets and
parts are as many as the session's shuffle partitions and dealt one to a task, so a task's share doesn't
grow with the input if those do. A task holds its bucket's packed names or windows in memory. Answers go back as
positions, packed by part, become one row a document, and meet the text in one join. The texts
are shuffled once: rounds 2 and the last join read the same exchange.

Null texts have no words. Rows with equal ids don't remove words from each other. A null id counts
as larger than any other: such rows lose words and take none. Copies of a row come out as often as
they went in. Very long texts are one row; a batch ends after ``batch_words`` words or the text
that passes it. An empty table gives an empty result. Ids are integers; others are refused. Only the id and
text columns are read. The input has to give the same rows in the same order when a lost task reads it
again, as files do; else write it to a table first.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexiflow.llm.common import few_at_a_time, giving_back, shuffle_partitions

WINDOW = 13
BEFORE, AFTER = 3, 5
PLACES = WINDOW - BEFORE - AFTER + 1  # a symbol may begin at so many places of a window
BATCH_WORDS = 500_000
BATCH_DOCS = 60_000
MEMORY = 200_000  # windows that a task remembers
LAST = np.iinfo(np.int64).max  # a null id
NOBODY = 65_535  # instead of a document that waits for an answer
ANSWER = np.dtype([("doc", "<i8"), ("key", "<u8"), ("at", "<u4"), ("n", "<u4")])  # n windows from at on go
U = np.uint64
NO_NAME = np.iinfo(np.uint64).max
FACTORS = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))  # odd
INVERSES = tuple(U(pow(int(f), -1, 1 << 64)) for f in FACTORS)
CLASSES = (U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25))  # odd, one a level


class _Words(dict):
    """Place of a word's 128-bit hash in two arrays; forgets all when it holds over ``most`` words."""

    most = 400_000

    def __init__(self):
        super().__init__()
        self.halves = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_128_intdigest(word)
        self.halves[0].append(value & 0xFFFFFFFFFFFFFFFF)
        self.halves[1].append(value >> 64)
        self[word] = place = len(self)
        return place

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self, places: np.ndarray, half: int) -> np.ndarray:
        return np.frombuffer(self.halves[half], U).copy()[places]

    def tidy(self) -> None:
        if len(self) > self.most:
            self.clear()
            self.halves = array("Q"), array("Q")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the murmur finaliser)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class _Sums:
    """Hashes of runs of words: differences of running sums, with the powers of an odd factor as weights."""

    def __init__(self, words: np.ndarray, half: int):
        power = lambda base: np.cumprod(np.concatenate(([U(1)], np.full(len(words), base))))
        self.sums = np.concatenate(([U(0)], np.cumsum(words * power(FACTORS[half])[:-1])))
        self.back = power(INVERSES[half])

    def of(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.back[start]


def _paired(names: np.ndarray, may: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols still begin one after left ones are paired with right ones, and the names of those."""
    right = (names * CLASSES[level - 1]) >> U(63) != 0
    first = np.flatnonzero(may[:-1] & may[1:] & ~right[:-1] & right[1:])
    keep, merged = np.ones(len(names), bool), names.copy()
    keep[first + 1] = False
    merged[first] = mix(names[first] * U(3) + mix(names[first + 1]) + U(level))
    return keep, merged[keep]


def symbol_starts(words: np.ndarray) -> np.ndarray:
    """Whether a symbol of level 2 begins at each word.

    Texts that follow each other in ``words`` are parsed as one; symbols are only used where the
    words that decide them are within one text."""
    out = np.zeros(len(words), bool)
    if not len(words):
        return out
    starts = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
    run = np.diff(np.append(starts, len(words))) > 1
    names = words[starts]
    names[run] = mix(names[run] + U(1))
    keep, names = _paired(names, ~run, 1)
    starts = starts[keep]
    keep, _ = _paired(names, np.ones(len(names), bool), 2)
    out[starts[keep]] = True
    return out


def named_windows(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes of texts of the given lengths -> (name, first window's start, number of
    windows that follow each other under the name)."""
    count = len(words) - WINDOW + 1
    if count < 1:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    sums = _Sums(words, 0)
    known = mix(sums.of(slice(None, -(BEFORE + AFTER)), slice(BEFORE + AFTER, None)))
    known[~symbol_starts(words)[BEFORE : BEFORE + len(known)]] = NO_NAME
    name = known[:count].copy()
    for k in range(1, PLACES):
        np.minimum(name, known[k : k + count], out=name)
    bare = np.flatnonzero(name == NO_NAME)
    name[bare] = mix(sums.of(bare, bare + WINDOW))
    whole = np.arange(count) + WINDOW <= np.repeat(np.cumsum(lengths), lengths)[:count]
    at, name = np.flatnonzero(whole), name[whole]
    first = np.flatnonzero(_changes(name) | np.concatenate(([True], at[1:] != at[:-1] + 1))[: len(at)])
    return name[first], at[first], np.diff(np.append(first, len(at)))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def settle(low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a smaller document has an equal window, places of the first windows of each kind that several rows have)."""
    order = np.lexsort((doc, high, low))
    new = _changes(low[order], high[order])
    kinds = np.flatnonzero(new)
    gone = np.empty(len(doc), bool)
    gone[order] = doc[order] > doc[order][kinds][np.cumsum(new) - 1] if len(doc) else False
    return gone, order[kinds][np.diff(np.append(kinds, len(doc))) > 1]


def _expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place within the row of the elements of rows of n elements."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _runs(row: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements that are kept, as runs: (row, first place, length)."""
    row, at = row[keep], at[keep]
    first = np.flatnonzero(_changes(row, at - np.arange(len(at))))
    return row[first], at[first], np.diff(np.append(first, len(row)))


def pack_names(names: np.ndarray) -> bytes:
    """The lower 40 bits of each."""
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack_names(data) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper 24 bits, in the order of the names."""
    return ((names >> U(40)) * U(buckets) >> U(24)).astype(np.int64)


def _slices(sorted_numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each number and where it stands."""
    first = np.flatnonzero(_changes(sorted_numbers)) if len(sorted_numbers) else np.empty(0, np.int64)
    for lo, hi in zip(first.tolist(), np.append(first[1:], len(sorted_numbers)).tolist()):
        yield int(sorted_numbers[lo]), slice(lo, hi)


def _answers(doc: np.ndarray, key: np.ndarray, at: np.ndarray, n: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed ANSWERs) for each part that has some."""
    out = np.empty(len(doc), ANSWER)
    out["doc"], out["key"], out["at"], out["n"] = doc, key, at, n
    to = (mix(doc.astype(np.int64).view(U) ^ key.astype(U)) % U(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    for p, mine in _slices(to[order]):
        yield p, out[order[mine]].tobytes()


ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batches(rows: list[tuple], columns: str, size: int = 2000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, columns.split(", "))])
    for lo in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + size]), schema)], schema=schema)


class _Batch:
    """Different texts of WINDOW words or more, with what else belongs to each."""

    def __init__(self):
        self.words, self.total = _Words(), 0
        self.start()

    def start(self) -> None:
        self.words.tidy()
        self.texts, self.docs, self.keys, self.more, self.seen, self.total = [], [], [], [], set(), 0

    def add(self, doc: int, key: int, text: str, more=None) -> None:
        words = text.encode("utf-8").split()
        if len(words) >= WINDOW and (doc, key) not in self.seen:
            self.seen.add((doc, key))
            self.texts.append(self.words.places(words))
            self.docs.append(doc)
            self.keys.append(key)
            self.more.append(more)
            self.total += len(words)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words' hashes, lengths, documents, keys."""
        return np.concatenate(self.texts), np.array([len(x) for x in self.texts]), np.array(self.docs, np.int64), np.array(self.keys, np.int64).view(U)


NAMES = "bucket int, batch long, names binary, docs binary, ids binary, keys binary"


def send_names(df: DataFrame, buckets: int, batch_words: int) -> DataFrame:
    """df (doc, key, text) -> NAMES: a batch's distinct names by bucket, with the document that each stands in; and
    a row for each batch with its documents, and the names that several of its documents share."""

    def pack(held: _Batch, batch: int) -> Iterator[pa.RecordBatch]:
        places, lengths, doc, key = held.arrays()
        name, start, _ = named_windows(held.words.hashes(places, 0), lengths)
        text = np.searchsorted(np.cumsum(lengths), start, "right")
        order = np.argsort(name, kind="stable")  # documents stay in order
        name, text = name[order], text[order]
        new = _changes(name)
        first = np.flatnonzero(new)
        shared = text[first] != text[np.append(first[1:], len(name)) - 1]
        own = shared[np.cumsum(new) - 1] & _changes(name, text)
        rows = [(batch % buckets, batch, pack_names(name[own]), text[own].astype("<u2").tobytes(), doc.tobytes(), key.tobytes())]
        told, waits = name[first], np.where(shared, NOBODY, text[first]).astype("<u2")
        for b, mine in _slices(bucket_of(told, buckets)):
            rows.append((b, batch, pack_names(told[mine]), waits[mine].tobytes(), None, None))
        yield from _batches(rows, NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = _Batch(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for d, q, text in zip(*batch.columns):
                held.add(d.as_py(), q.as_py(), text.as_py())
                if held.total >= batch_words or len(held.docs) >= BATCH_DOCS:
                    yield from pack(held, number)
                    held.start()
                    number += 1
        if held.docs:
            yield from pack(held, number)

    return few_at_a_time(df).mapInArrow(giving_back(run), NAMES)


def shared_names(sent: DataFrame, buckets: int) -> DataFrame:
    """NAMES, dealt by bucket -> NAMES, with the batch's part as bucket: the names that other batches have, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packets, names = [], []
        for batch in batches:
            of_batch = batch.filter(pa.compute.is_valid(batch["ids"]))
            if of_batch.num_rows:
                yield of_batch
            for bucket, number, found, docs in zip(*batch.filter(pa.compute.is_null(batch["ids"])).columns[:4]):
                packets.append((number.as_py(), np.frombuffer(docs.as_py(), "<u2")))
                names.append(unpack_names(found.as_buffer()) | U(bucket.as_py()) << U(40))
        if not packets:
            return
        every = np.concatenate(names)
        order = np.argsort(every)
        new = _changes(every[order])
        times = np.diff(np.append(np.flatnonzero(new), len(every)))
        shared = np.empty(len(every), bool)
        shared[order] = (times > 1)[np.cumsum(new) - 1]
        rows, at = [], 0
        for (number, docs), held in zip(packets, names):
            tell = shared[at : at + len(docs)] & (docs != NOBODY)
            at += len(docs)
            if tell.any():
                rows.append((number % buckets, number, pack_names(held[tell]), docs[tell].tobytes(), None, None))
        yield from _batches(rows, NAMES)

    return sent.mapInArrow(giving_back(run), NAMES)


def names_by_document(shared: DataFrame) -> DataFrame:
    """NAMES, dealt by part -> (_d, _k, names): the shared names of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of_batch = defaultdict(list), {}
        for batch in batches:
            for _, number, names, docs, ids, keys in zip(*batch.columns):
                n = number.as_py()
                held[n].append((unpack_names(names.as_buffer()), np.frombuffer(docs.as_py(), "<u2")))
                if ids.is_valid:
                    of_batch[n] = np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(keys.as_py(), "<i8")
        for n, (ids, keys) in of_batch.items():
            names, docs = (np.concatenate(c) for c in zip(*held.pop(n)))
            order = np.argsort(docs, kind="stable")
            names = names[order]
            yield from _batches([(int(ids[d]), int(keys[d]), pack_names(names[mine])) for d, mine in _slices(docs[order])], "_d long, _k long, names binary", 5000)

    return shared.mapInArrow(giving_back(run), "_d long, _k long, names binary")


WINDOWS = "bucket int, names binary, windows binary, answer binary"


def send_windows(df: DataFrame, buckets: int, batch_words: int) -> DataFrame:
    """df (_doc, _key, _text, names) -> WINDOWS: the windows under shared names by bucket, and answers that
    a batch settled itself. names and windows are packed by columns: doc, key, at, n, and the two hashes."""

    def pack(held: _Batch, memory: tuple[np.ndarray, ...]) -> tuple[list[tuple], tuple[np.ndarray, ...]]:
        places, lengths, doc, key = held.arrays()
        low = held.words.hashes(places, 0)
        name, start, n = named_windows(low, lengths)
        wanted = np.unique(np.concatenate([unpack_names(x) for x in held.more]))
        short = name & U((1 << 40) - 1)
        live = wanted[np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)] == short
        name, start, n = name[live], start[live], n[live]
        base = np.cumsum(lengths) - lengths
        text = np.searchsorted(base, start, "right") - 1
        row, k = _expand(n)
        at = start[row] + k
        hashes = [_Sums(x, half).of(at, at + WINDOW) for half, x in enumerate((low, held.words.hashes(places, 1)))]
        of = doc[text[row]]
        low, high, of = (np.concatenate(c) for c in zip((*hashes, of), memory))
        gone, repeated = settle(low, high, of)
        memory = tuple(c[repeated[:MEMORY]] for c in (low, high, of))
        gone = gone[: len(row)]
        r, a, m = _runs(row, k, gone)
        rows = [(p, None, None, x) for p, x in _answers(doc[text[r]], key[text[r]], start[r] - base[text[r]] + a, m, buckets)]
        r, a, m = _runs(row, k, ~gone)
        columns = doc[text[r]], key[text[r]], (start[r] - base[text[r]] + a).astype("<u4"), m.astype("<u4")
        low, high = (h[~gone] for h in hashes)
        offset, to = np.cumsum(m) - m, bucket_of(name[r], buckets)
        order = np.argsort(to, kind="stable")
        for b, mine in _slices(to[order]):
            i = order[mine]
            x, j = _expand(m[i])
            i2 = offset[i][x] + j
            rows.append((b, b"".join(c[i].tobytes() for c in columns), low[i2].tobytes() + high[i2].tobytes(), None))
        return rows, memory

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, memory = _Batch(), (np.empty(0, U), np.empty(0, U), np.empty(0, np.int64))
        for batch in batches:
            for d, q, text, names in zip(*(batch[c] for c in ("_doc", "_key", "_text", "names"))):
                held.add(d.as_py(), q.as_py(), text.as_py(), names.as_py())
                if held.total >= batch_words:
                    rows, memory = pack(held, memory)
                    yield from _batches(rows, WINDOWS)
                    held.start()
        if held.docs:
            yield from _batches(pack(held, memory)[0], WINDOWS)

    return few_at_a_time(df).mapInArrow(giving_back(run), WINDOWS)


def verify(sent: DataFrame, parts: int) -> DataFrame:
    """WINDOWS, dealt by bucket -> (part, packed ANSWERs) of the windows that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("answer", pa.binary())])
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for batch in batches:
            settled = batch.filter(pa.compute.is_valid(batch["answer"]))
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays([settled["bucket"], settled["answer"]], schema=schema)
            for names, windows in zip(batch["names"], batch["windows"]):
                if names.is_valid:
                    data, n = names.as_py(), len(names.as_py()) // 24
                    ends = np.cumsum([0, 8 * n, 8 * n, 4 * n, 4 * n])
                    for c, (kind, lo, hi) in enumerate(zip(("<i8", "<u8", "<u4", "<u4"), ends, ends[1:])):
                        columns[c].append(np.frombuffer(data[lo:hi], kind))
                    both = np.frombuffer(windows.as_py(), "<u8").reshape(2, -1)
                    columns[4].append(both[0])
                    columns[5].append(both[1])
        if not columns[0]:
            return
        doc, key, at, n, low, high = (np.concatenate(c) for c in columns)
        columns.clear()
        row, k = _expand(n)
        gone, _ = settle(low, high, doc[row])
        r, first, m = _runs(row, k, gone)
        yield from _batches(list(_answers(doc[r], key[r], at[r] + first, m, parts)), "part int, answer binary")

    return sent.mapInArrow(giving_back(run), "part int, answer binary")


def by_document(answers: DataFrame) -> DataFrame:
    """(part, packed ANSWERs), dealt by part -> (_d, _k, packed (start, windows) pairs), one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_buffer(), ANSWER).copy() for batch in batches for x in batch.column(1)]
        if not held:
            return
        found = np.concatenate(held)
        found = found[np.lexsort((found["key"], found["doc"]))]
        doc, key = found["doc"].copy(), found["key"].copy()
        new = np.flatnonzero(_changes(doc, key))
        pairs = np.stack((found["at"], found["n"]), axis=1)
        packed = [pairs[lo:hi].tobytes() for lo, hi in zip(new, [*new[1:], len(doc)])]
        yield from _batches(list(zip(doc[new].tolist(), key.view(np.int64)[new].tolist(), packed)), "_d long, _k long, pairs binary", 5000)

    return answers.mapInArrow(giving_back(run), "_d long, _k long, pairs binary")


def covered(n_words: int, packed: bytes | None) -> np.ndarray:
    """Whether each of the words is in one of the packed windows."""
    change = np.zeros(n_words + 1, np.int64)
    pairs = np.frombuffer(packed or b"", "<u4").reshape(-1, 2).astype(np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 0] + pairs[:, 1] + WINDOW - 1, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch_words: int = BATCH_WORDS, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept): kept is the text that stays, its words joined
    by one space; it is left out without with_text."""
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} has to be an integer: {df.schema[id_col].dataType.simpleString()}")
    buckets = shuffle_partitions(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col), text.alias("_text"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("_doc"), F.xxhash64(text).alias("_key"))
    same = (F.col("_doc") == F.col("_d")) & (F.col("_key") == F.col("_k"))

    told = shared_names(send_names(docs.select("_doc", "_key", "_text"), buckets, batch_words).repartitionById(buckets, "bucket"), buckets)
    # copies of a row have the same names
    names = names_by_document(told.repartitionById(buckets, "bucket")).groupBy("_d", "_k").agg(F.first("names").alias("names"))
    # all columns of docs, as in the last join, so that both read one exchange
    sent = send_windows(docs.join(names, same).select(id_col, "_text", "_doc", "_key", "names"), buckets, batch_words)
    answers = by_document(verify(sent.repartitionById(buckets, "bucket"), buckets).repartitionById(buckets, "part"))
    both = docs.join(answers, same, "left").select(id_col, "_text", "pairs")
    id_type = docs.schema[0].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for held, packed in zip(batch.column(1), batch.column(2)):
                words = held.as_py().encode("utf-8").split()
                gone = covered(len(words), packed.as_py()) if packed.is_valid else np.zeros(len(words), bool)
                kept = b" ".join(words if not gone.any() else [words[i] for i in np.flatnonzero(~gone)])
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8"))
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = [id_col, "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())] if with_text else arrays, names=[*names, "kept"] if with_text else names)

    return few_at_a_time(both).mapInArrow(giving_back(finish), f"`{id_col}` {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
