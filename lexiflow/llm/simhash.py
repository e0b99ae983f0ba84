"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 bits; a bit is 1 if it is set in more than half of the XXH64 hashes (seed
42) of a text's word shingles. Two fingerprints link if at most ``threshold`` bits differ.

Covering: the 64 bits are three blocks. Of ``threshold`` differing bits at least one block has
``threshold // 3`` or fewer; with 4 that is 1. In each block the anchors are the words of a
covering code: 15 bits in the perfect Hamming [15, 11] code (covering radius 1), the other
bits free (radius 0). Each fingerprint's home is the anchor nearest to it, and it is replicated
to every anchor that can be the home of a fingerprint within one bit of it, all of which lie within
covering radius plus threshold, 1 + 1. So for any linked pair, one of the two meets the
other at its home in some block: per anchor the home members are compared with all members,
and no pair is missed. A fingerprint has about 41 replicas of 17 bytes.

The covering is a parameter: (blocks, picked, radius) cuts the 64 bits into blocks and covers every choice of ``picked`` of
them, in one of which linked fingerprints differ in ``radius`` bits or fewer. The above is (3, 1, 1), with 2^17 anchors in
each choice, so that some 2^17 fingerprints are compared for each fingerprint of 2^34. Beyond ``MANY`` distinct fingerprints (7, 3, 0)
is taken: 35 choices of 27 or 28 bits, of which three blocks have no differing bit at all, so a fingerprint goes to its home
alone, one of 2^23 anchors or more. Both find every link, so the results are the same (tested).

Equal fingerprints are one node, however many documents have them. An anchor with more than
``cell`` members is dealt to a grid of cells, each comparing a part of the home members with a part
of the others, so no task gets an unbounded group. A cell hands on a spanning forest of its
links, not the pairs. The forests' components come from :mod:`lexiflow.llm.components`.

Pairs of a given similarity over their shingles, which differ in more bits than this covers for
certain, are the matter of :mod:`lexiflow.llm.similar`, which meets at the same anchors.

Null and empty texts have no words and the fingerprint zero, which links like any other.
Repeated rows come out repeated. A null id is never a component's id unless all of the
component's ids are null. An empty table gives an empty result. Only the id and text columns
are read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import cut, few_at_a_time
from lexiflow.llm.components import components

SEED = 42
SHINGLE = 4
THRESHOLD = 4
CELL = 20_000
COVERING, WIDER = (3, 1, 1), (7, 3, 0)
MANY = 1 << 22
CODED = 15
CHUNK = 4_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text."""
    return majority(shingle_hashes(text, shingle))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode("utf-8").lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return np.array(hashes, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes; none of no hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, *, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    shown = df.select(F.col(id_col), F.col(text_col).cast("string"))
    return few_at_a_time(shown).mapInArrow(run, f"`{id_col}` {shown.schema[0].dataType.simpleString()}, fp long")


@functools.cache
def _hamming() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word: its nearest codeword, and the seven others at distance 2 (those of a
    codeword, which has none, are itself)."""
    words = np.arange(1 << CODED, dtype=np.int64)
    syndrome = np.zeros_like(words)
    for bit in range(CODED):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    flip = np.concatenate(([0], 1 << np.arange(CODED)))
    home = words ^ flip[syndrome]
    others = np.repeat(home[:, None], 7, axis=1)
    for s in range(1, 16):
        at = syndrome == s
        pairs = [(a, a ^ s) for a in range(1, 16) if a < a ^ s]
        others[at] = words[at][:, None] ^ np.array([flip[a] ^ flip[b] for a, b in pairs])
    return home, others


@functools.cache
def choices(blocks: int, picked: int) -> tuple[tuple[tuple[int, int], ...], ...]:
    """The (shift, width) of the blocks of each choice."""
    edges = [-(-64 * k // blocks) for k in range(blocks + 1)]
    every = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]
    return tuple(itertools.combinations(every, picked))


def check_covering(covering: tuple[int, int, int], threshold: int) -> None:
    """That the emptiest ``picked`` of the blocks differ in at most ``radius`` bits, however the threshold's bits are spread."""
    blocks, picked, radius = covering
    each, rest = divmod(threshold, blocks)
    if radius not in (0, 1) or picked * each + max(0, picked - (blocks - rest)) > radius:
        raise ValueError(f"the covering {covering} isn't complete for {threshold} differing bits")
    if any(sum(w for _, w in c) < CODED for c in choices(blocks, picked)) or any(sum(w for _, w in c) > 32 for c in choices(blocks, picked)):
        raise ValueError(f"a choice has to have {CODED} to 32 bits: {covering}")


def _parts(fps: np.ndarray, covering: tuple[int, int, int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number, width, bits) of each choice of blocks."""
    for number, chosen in enumerate(choices(*covering[:2])):
        bits, width = np.zeros(len(fps), np.int64), 0
        for shift, w in chosen:
            bits |= (fps >> np.uint64(shift) & np.uint64((1 << w) - 1)).astype(np.int64) << width
            width += w
        yield number, width, bits


def homes(fps: np.ndarray, covering: tuple[int, int, int] = COVERING) -> np.ndarray:
    """The home anchors of each fingerprint, a row for each choice of blocks."""
    home, _ = _hamming()
    return np.stack([home[bits & (1 << CODED) - 1] | bits >> CODED << CODED | number << 32 for number, _, bits in _parts(fps, covering)])


def replicas(fps: np.ndarray, covering: tuple[int, int, int] = COVERING) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fps, is home) of every anchor that a fingerprint goes to."""
    home, others = _hamming()
    index = np.arange(len(fps))
    anchors, of, at_home = [], [], []
    for number, width, bits in _parts(fps, covering):
        coded, free = bits & (1 << CODED) - 1, bits >> CODED << CODED
        own = home[coded] | free
        near = [own ^ 1 << b for b in range(CODED, width)] + [np.where(others[coded, j] == home[coded], -1, others[coded, j] | free) for j in range(7)]
        for j, a in enumerate([own, *(near if covering[2] else ())]):
            keep = a >= 0
            anchors.append(a[keep] | number << 32)
            of.append(index[keep])
            at_home.append(np.full(keep.sum(), j == 0))
    return np.concatenate(anchors), np.concatenate(of), np.concatenate(at_home)


def replicate(fps: DataFrame, covering: tuple[int, int, int] = COVERING) -> DataFrame:
    """fps (fp) -> (anchor, fp, home)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(values), 10_000):
                anchor, of, home = replicas(part := values[lo : lo + 10_000], covering)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[of].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def deal(members: DataFrame, cell: int, key: str = "fp") -> DataFrame:
    """Add the cell of each member: 0 for anchors of at most ``cell`` members; larger ones get a
    grid of parts x parts, with home members in their row and the others in their column."""
    hot = cut(members.groupBy("anchor").count().where(F.col("count") > cell).select("anchor", F.ceil(F.col("count") / cell).cast("int").alias("parts")))
    if (n := hot.count()) == 0:
        return members.withColumn("cell", F.lit(0))
    parted = members.join(F.broadcast(hot) if n <= 100_000 else hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64(key), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    row = F.transform(every, lambda j: F.struct((mine * F.col("parts") + j).alias("cell"), F.lit(True).alias("home")))
    column = F.transform(every, lambda i: F.struct((i * F.col("parts") + mine).alias("cell"), F.lit(False).alias("home")))
    # a home member is a member, too: it also stands in its column
    cells = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("cell"), F.col("home")))).when(F.col("home"), F.concat(row, column)).otherwise(column)
    kept = [c for c in members.columns if c != "home"]
    return parted.select(*kept, F.explode(cells).alias("_c")).select(*kept, "_c.home", "_c.cell")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the links a-b, without the roots themselves."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        # also the labels' own labels, so that trees join at their roots
        for to in (x, y, before[x], before[y]):
            np.minimum.at(label, to, low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        if np.array_equal(label, before):
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def meetings(anchor: np.ndarray, home: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, each a home member with a member of the same anchor, in stretches of about ``chunk``."""
    order = np.argsort(anchor, kind="stable")
    anchor = anchor[order]
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    sizes = np.diff(np.append(starts, len(anchor)))
    group = np.repeat(np.arange(len(starts)), sizes)
    rows = np.flatnonzero(home[order])
    rows = rows[sizes[group[rows]] > 1]
    todo, lo = np.cumsum(sizes[group[rows]]), 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(todo, (todo[lo - 1] if lo else 0) + chunk, "right")))
        part = rows[lo:hi]
        n = sizes[group[part]]
        first = np.repeat(starts[group[part]] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        yield order[np.repeat(part, n)], order[first + np.arange(n.sum())]
        lo = hi


def links_in(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links that home members have with members of the same anchor."""
    a, b, held = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], 0
    for i, j in meetings(anchor, home):
        x, y = fp[i], fp[j]
        near = np.bitwise_count(x ^ y) <= threshold
        near &= x != y
        a.append(x[near])
        b.append(y[near])
        held += len(a[-1])
        if held > CHUNK:
            a, b = ([z] for z in forest(np.concatenate(a), np.concatenate(b)))
            held = len(a[0])
    return forest(np.concatenate(a), np.concatenate(b))


def group_keys(got: pa.Table) -> np.ndarray:
    """One number for each (anchor, cell) of the table."""
    anchor, where = (got[c].to_numpy() for c in ("anchor", "cell"))
    return np.unique(np.stack((anchor, where.astype(np.int64))), axis=1, return_inverse=True)[1] if where.any() else anchor


def links(fps: DataFrame, *, threshold: int = THRESHOLD, cell: int = CELL, covering: tuple[int, int, int] | None = None) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) whose components are those of all links. covering: None takes it by the number of rows."""
    n = fps.count()
    covering = covering or (COVERING if n <= MANY or threshold > 4 else WIDER)
    check_covering(covering, threshold)
    # no anchor has more members than there are fingerprints
    members = deal(replicate(fps, covering), cell) if n > cell else replicate(fps, covering).withColumn("cell", F.lit(0))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [x for x in batches if x.num_rows]:
            got = pa.Table.from_batches(held)
            a, b = links_in(group_keys(got), got["fp"].to_numpy().view(np.uint64), got["home"].to_numpy(), threshold)
            for lo in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(z[lo : lo + 100_000].view(np.int64)) for z in (a, b)], names=["a", "b"])

    return members.select("anchor", "fp", "home", "cell").repartition("anchor", "cell").mapInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, cell: int = CELL, covering: tuple[int, int, int] | None = None) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id of its component."""
    docs = cut(fingerprints(df, id_col=id_col, text_col=text_col, shingle=shingle))
    nodes = cut(docs.groupBy("fp").agg(F.min(id_col).alias("_first")))
    roots = components(links(nodes, threshold=threshold, cell=cell, covering=covering))
    member = roots.join(nodes.select(F.col("fp").alias("node"), "_first"), "node")
    least = cut(member.groupBy("root").agg(F.min("_first").alias("component_id")))
    named = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    # after the checkpoint the last join has exchanges of its own and may be split at a hot fingerprint
    of = cut(nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "_first").alias("component_id")))
    return docs.join(of, "fp").select(id_col, "fp", "component_id")


def fingerprint_hex(fp) -> object:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
