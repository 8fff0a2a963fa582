"""SimHash near-duplicates: an embedding of the fingerprints into bit counts of short segments.

The Manhattan distance of two embeddings is a lower bound of the Hamming distance of the fingerprints. A fingerprint has two
faces of 32 bits; two fingerprints at a distance of at most D have a face in which their embeddings are at most D // 2 apart. A
grid range-join finds those: each fingerprint enters its own grid point of each face and the neighbouring points, and two
fingerprints meet in a point halfway between them. What meets is verified on all 64 bits, and of what is near only as many links are kept as connect it: a
group of n near copies gives n - 1 links in a point, not its pairs.

A grid point that holds more than ``cell_cap`` fingerprints goes further. Its fingerprints enter a grid of narrower
segments, which has more points; if points of the finest one are too full as well, another exact way is left: each fingerprint
enters all points of the 64-bit space within D / 2 of it, and everything in a point links to the smallest there. Fingerprints at
most D apart share such a point, those in one are at most D apart, and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, cut_few, fits, stored, text_key

BLOCK = 1 << 16  # shingles whose bits are unpacked at once


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly the six gaps


def _spans(words: list[bytes], shingle_words: int) -> list[tuple[int, int]]:
    """Where the shingles are in the words joined by a space."""
    if len(words) <= shingle_words:
        return [(0, sum(map(len, words)) + len(words) - 1)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return list(zip(starts[: len(words) - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist(), strict=True))


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle_words: int) -> int:
    """The fingerprint as a signed 64-bit number; 0 without words."""
    words = _words(text)
    if not words:
        return 0
    joined, spans = b" ".join(words), _spans(words, shingle_words)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), BLOCK):
        ones += _ones(np.array([digest(joined[a:b], 42) for a, b in spans[at : at + BLOCK]], np.uint64))
    return _majority(ones, len(spans))


def shingles(text: str | None, shingle_words: int) -> np.ndarray:
    """The different hashes of the shingles, signed."""
    words = _words(text)
    joined = b" ".join(words)
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in _spans(words, shingle_words)] if words else [], np.uint64)).view(np.int64)


def fingerprints(docs: DataFrame, *, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id (``id``), ``key`` (a hash of the text) and ``fp`` (the fingerprint, signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle_words) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["id", "key", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, fp long")


SAMPLED, OFTEN = 8, 3  # one text in so many is counted; so many of those make a shingle frequent
SLOTS = 1 << 24  # of the table of frequent shingles: 2 MB, whatever the corpus
CROWD = 32  # texts of a shingle beyond which it makes no pairs
BITS = 2048  # of a sketch


def frequent(docs: DataFrame, *, shingle_words: int, text_col: str = "text") -> np.ndarray:
    """A table of ``SLOTS`` truth values: of shingles (by their hash) that many texts have. It comes from a sample of the texts, and several shingles share a slot; it only decides an order, so no result
    depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), shingle_words))], names=["h"])

    text = F.col(text_col).cast("string")
    rows = docs.where(F.pmod(text_key(F.col(text_col)), F.lit(SAMPLED)) == 0).select(text.alias("text")).mapInArrow(run, "h long")
    slot = F.pmod("h", F.lit(SLOTS))
    many = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).select(slot.alias("slot"))
    blocks = many.groupBy(F.floor(F.col("slot") / 32_768).alias("block")).agg(F.bitmap_construct_agg(F.col("slot") % 32_768).alias("bits"))
    table = np.zeros((SLOTS // 32_768, 32_768), bool)
    for r in blocks.collect():  # at most SLOTS / 32,768 rows of 4 KB
        table[r["block"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    return table.ravel()


def prefix_size(n, similarity: float):
    """So many of the first of n shingles, in any order that all sets share, meet one of the first of every set that is similar enough."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def sketch(hashes: np.ndarray) -> bytes:
    """Of each of ``BITS`` classes of hashes, whether a set has an odd number. Sets differ in at least as many members as their sketches in bits."""
    return np.packbits(np.bincount((hashes >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) % 2 == 1).tobytes()


def sequences(docs: DataFrame, *, shingle_words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``key`` (a hash of the text), ``fp`` (a hash of the word sequence), ``sim`` (the fingerprint of its shingles), ``n`` (its different shingles),
    ``prefix`` (the first of those by ``prefix_size``, rare ones before frequent ones) and ``sketch`` (of all of them)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent(docs, shingle_words=shingle_words, text_col=text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            found = []
            for x in batch.column(2):
                words = _words(x.as_py())
                joined = b" ".join(words)
                hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in _spans(words, shingle_words)] if words else [], np.uint64)
                ones = sum((_ones(hashes[at : at + BLOCK]) for at in range(0, len(hashes), BLOCK)), np.zeros(64, np.int64))
                own = np.unique(hashes)
                order = np.lexsort((own, often[(own % np.uint64(SLOTS)).astype(np.int64)]))[: prefix_size(np.int64(len(own)), similarity) if len(own) else 0]
                key = np.array([xxhash.xxh64_intdigest(joined, 42) if words else 0], np.uint64).view(np.int64)[0]
                found.append((int(key), _majority(ones, len(hashes)), len(own), own[order].view(np.int64), sketch(own)))
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)] + [pa.array([x[3] for x in found], pa.list_(pa.int64())), pa.array([x[4] for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "key", "fp", "sim", "n", "prefix", "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, fp long, sim long, n long, prefix array<long>, sketch binary")


def segment_counts(fps: np.ndarray, segment_bits: int) -> np.ndarray:
    """The bit count of each segment, packed in fields as wide as the segment."""
    counts, width = fps.astype(np.uint64), 1
    while width < segment_bits:
        mask = np.uint64(sum(((1 << width) - 1) << at for at in range(0, 64, 2 * width)))
        counts = (counts & mask) + ((counts >> np.uint64(width)) & mask)
        width *= 2
    return counts


def grid_points(fps: np.ndarray, segment_bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points, places in ``fps``) for both faces: the own grid point and, for radius 1, the neighbouring ones that counts can take."""
    counts, places = segment_counts(fps, segment_bits), np.arange(len(fps))
    one, field = np.uint64(1), np.uint64((1 << segment_bits) - 1)
    for face in (0, 1):
        own = (counts >> np.uint64(32 * face)) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(face << 32)
        yield own | tag, places
        for at in range(0, 32 if radius else 0, segment_bits):
            value = (own >> np.uint64(at)) & field
            up, down = value < segment_bits, value > 0
            yield (own[up] + (one << np.uint64(at))) | tag, places[up]
            yield (own[down] - (one << np.uint64(at))) | tag, places[down]


def ball_points(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points, places in ``fps``) for all points of the 64-bit space within ``radius`` (at most 2) of the fingerprint."""
    bits, own, places = [np.uint64(1 << at) for at in range(64)], fps.astype(np.uint64), np.arange(len(fps))
    yield own, places
    for i in range(64 if radius else 0):
        yield own ^ bits[i], places
        for j in range(i + 1, 64 if radius > 1 else 0):
            yield own ^ bits[i] ^ bits[j], places


def _points(fps: DataFrame, kind, *args) -> DataFrame:
    """Rows (point, fp, node) for all that ``kind`` yields of the columns of ``fps`` but ``node``, which are fingerprints; without a column ``node``, rows (point, fp)."""
    columns = [c for c in fps.columns if c != "node"]
    names = ["point", "fp", "node"][: 3 if "node" in fps.columns else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            held: list[list[np.ndarray]] = []
            for j in range(len(columns)):
                for points, places in kind(own[j].view(np.uint64), *args):
                    held.append([points.view(np.int64) + (j << 34), *(x[places] for x in (own[j], *own[len(columns) :]))])
                    if sum(len(x[0]) for x in held) > 100_000:
                        yield _batch(held)
                        held = []
            if held:
                yield _batch(held)

    def _batch(held):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in held])) for k in range(len(names))], names=names)

    return fps.select(*columns, *names[2:]).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _by_point(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Of a stream sorted by its first column: (columns of whole points, False), and (columns of a piece, True) of points with more than ``cap`` rows."""
    held, full = None, None
    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if full is not None:  # the rest of a point that is too full
            end = int(np.searchsorted(held[0], full, side="right"))
            if end:
                yield [x[:end] for x in held], True
            held = [x[end:] for x in held]
        if not len(held[0]):
            continue
        last = int(np.searchsorted(held[0], held[0][-1]))  # the last point may go on in the next batch
        if last:
            yield from _parted([x[:last] for x in held], cap)
        held, full = [x[last:] for x in held], None
        if len(held[0]) > cap:
            full = int(held[0][0])
            yield held, True
            held = [x[:0] for x in held]
    if held is not None and len(held[0]):
        yield from _parted(held, cap)


def _parted(columns: list[np.ndarray], cap: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    begin = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))
    size = np.diff(begin, append=len(columns[0]))
    for at, n in zip(begin[size > cap].tolist(), size[size > cap].tolist(), strict=True):
        yield [x[at : at + n] for x in columns], True
    if (size > cap).any():
        fits_ = np.repeat(size <= cap, size)
        columns = [x[fits_] for x in columns]
    yield columns, False


def _link_batch(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    low, high = (pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64())) if b is None else (pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)))
    return pa.RecordBatch.from_arrays([low, high], names=["a", "b"])


def _spanning(fps: np.ndarray, max_distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links (one, others) that connect what pairs at up to ``max_distance`` connect, one fewer than a component has members. Each fingerprint that is reached
    is compared once with those that aren't, so a dense group takes few comparisons and none makes pairs."""
    left = fps
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            one = reached.pop()
            near = np.bitwise_count(left ^ one) <= max_distance
            if near.any():
                yield int(one), left[near]
                reached.extend(left[near])
                left = left[~near]


def _linked(cells: DataFrame, max_distance: int, cell_cap: int) -> DataFrame:
    """Links (a, b), a < b, within each point of ``cells`` (point, fp), and (fp, null) for the fingerprints of points that hold more than ``cell_cap``.

    Points pass through the tasks as streams sorted by point, of which a task holds one point at a time, up to the cap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (point, fp), crowded in _by_point(batches, cell_cap):
            yield _link_batch(fp, None) if crowded else _within(point, fp)

    def _within(point: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]])) if len(point) else np.empty(0, np.int64)
        size = np.diff(begin, append=len(point))
        twos = begin[size == 2]
        one, other = fp[twos], fp[twos + 1] if len(twos) else fp[:0]
        near = np.bitwise_count(one.view(np.uint64) ^ other.view(np.uint64)) <= max_distance
        ends = [(one[near], other[near])]
        for at, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = fp[at : at + n].view(np.uint64)
            ends += [(np.full(len(others), one, np.uint64).view(np.int64), others.view(np.int64)) for one, others in _spanning(own, max_distance)]
        return _link_batch(*(np.concatenate([x[k] for x in ends]) for k in (0, 1)))

    return cells.select("point", "fp").repartition("point").sortWithinPartitions("point").mapInArrow(run, "a long, b long").distinct()


def _pairs(of: np.ndarray, n: np.ndarray, group: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs within equal ``of`` (sorted, then by ``n``) that are in different groups and of sizes which the similarity allows."""
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    size = np.diff(begin, append=len(of))
    # a member's partners are those after it in its run, up to a size
    end = np.repeat(begin + size, size)
    for step in range(1, min(64, int(size.max(initial=1)))):
        at = np.arange(len(of) - step)
        at = at[(at + step < end[at]) & (np.repeat(size, size)[at] <= 64)]
        at = at[(n[at] >= similarity * n[at + step] - 1e-9) & (group[at] != group[at + step])]
        yield at, at + step
    for first, m in zip(begin[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        own = slice(first, first + m)
        last = first + np.searchsorted(n[own], n[own] / similarity + 1e-9, side="right")
        for i in range(first, first + m) if (group[own] != group[first]).any() else ():
            other = np.arange(i + 1, last[i - first])
            other = other[group[other] != group[i]]
            yield np.full(len(other), i), other


def _met(rows: DataFrame, similarity: float, cap: int) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (token, node, n, grp): a row (a, b, na, nb), a < b, for each token that two nodes of different groups share, and the tokens of more than ``cap`` nodes, which give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "na", "nb", "token"]
        for (token, n, node, group), crowded in _by_point(batches, cap):
            if crowded:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array(token[:1])], names=names)
                continue
            held, count = [], 0
            for i, j in _pairs(token, n, group, similarity):
                low, high = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
                held.append((node[low], node[high], n[low], n[high]))
                count += len(i)
                if count > 500_000:
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in zip(*held)), pa.nulls(count, pa.int64())], names=names)
                    held, count = [], 0
            if count:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in zip(*held)), pa.nulls(count, pa.int64())], names=names)

    met = stored(rows.select("token", "n", "node", "grp").repartition("token").sortWithinPartitions("token", "n").mapInArrow(run, "a long, b long, na long, nb long, token long"))
    return met.where("token IS NULL").drop("token"), met.where("token IS NOT NULL").select("token").distinct()


def _joined(rows: DataFrame, crowds: DataFrame, similarity: float) -> DataFrame:
    """The same rows for tokens of more nodes than a task holds: a join, which adaptive execution splits."""
    x, y = (rows.join(crowds, "token").select("token", F.col("node").alias(a), F.col("n").alias(f"n{a}"), F.col("grp").alias(f"g{a}")) for a in "ab")
    sizes = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-9
    return x.join(y.hint("merge"), "token").where((F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & sizes).select("a", "b", "na", "nb")


def _meeting(rows: DataFrame, similarity: float, cap: int) -> DataFrame:
    """Rows (a, b, na, nb, both) of nodes of different groups that share ``both`` of the tokens of ``rows`` (token, node, n, grp), a < b."""
    found, crowds = _met(rows, similarity, cap)
    if not crowds.isEmpty():
        found = found.unionByName(_joined(rows, crowds, similarity))
    return found.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))


def _near(i: int, others: np.ndarray, sketches: np.ndarray, n: np.ndarray, group: np.ndarray, similarity: float) -> np.ndarray:
    """Those of ``others`` (places) in other groups that may be similar to ``i`` by their sizes and sketches."""
    sizes = (np.minimum(n[others], n[i]) >= similarity * np.maximum(n[others], n[i]) - 1e-9) & (group[others] != group[i])
    others = others[sizes]
    most = (1 - similarity) / (1 + similarity) * (n[others] + n[i]) + 1e-9  # members in which similar sets may differ
    return others[np.bitwise_count(sketches[others] ^ sketches[i]).sum(1, dtype=np.int64) <= most]


def _forest(sketches: np.ndarray, n: np.ndarray, group: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Links (one, others) that connect all members which sketches and groups connect, fewer than there are members."""
    left = np.arange(len(n))
    while len(left):
        own = group[left] == group[left[0]]
        reached, left = left[own].tolist(), left[~own]
        while reached and len(left):
            one = reached.pop()
            near = _near(one, left, sketches, n, group, similarity)
            if len(near):
                yield one, near
                there = np.isin(group[left], group[near])
                reached.extend(left[there].tolist())
                left = left[~there]


def _all_near(sketches: np.ndarray, n: np.ndarray, group: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """All links (one, others) that sketches allow. The largest group's members are met by the others only."""
    names, at, size = np.unique(group, return_inverse=True, return_counts=True)
    order = np.argsort(at == np.argmax(size), kind="stable")
    for k in range(len(n) - int(size.max())):
        near = _near(int(order[k]), order[k + 1 :], sketches, n, group, similarity)
        if len(near):
            yield int(order[k]), near


def _alike(rows: DataFrame, similarity: float, cap: int, links_of) -> tuple[DataFrame, DataFrame]:
    """Distinct links (a, b), a < b, that ``links_of`` finds among the nodes of each token of ``rows`` (token, node, n, grp, sketch); and the tokens of more than ``cap`` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, n, node, group, sketches), crowded in _by_point(batches, cap):
            if crowded:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array(token[:1])], names=["a", "b", "token"])
                continue
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
            for at, m in zip(begin.tolist(), np.diff(begin, append=len(token)).tolist(), strict=True):
                of = slice(at, at + m)
                if (group[of] == group[at]).all():
                    continue
                matrix = np.frombuffer(b"".join(sketches[of]), np.uint64).reshape(m, -1)
                for one, others in links_of(matrix, n[of], group[of], similarity):
                    x, y = node[at + one], node[at + others]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(y), pa.int64())], names=["a", "b", "token"])

    met = cut_few(rows.select("token", "n", "node", "grp", "sketch").repartition("token").sortWithinPartitions("token").mapInArrow(run, "a long, b long, token long").distinct())
    return met.where("token IS NULL").select("a", "b"), met.where("token IS NOT NULL").select("token")


def similar_links(docs: DataFrame, by_doc: DataFrame, *, shingle_words: int, similarity: float, cell_cap: int = 1_000_000, most_broadcast: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b), a < b, that connect exactly what pairs of word sequences connect whose sets of shingles have a Jaccard similarity of ``similarity`` or more. ``by_doc`` are ``sequences``.

    First, what fingerprints link in their grids, and equal fingerprints, are verified by their shingles: that unites most of a group of near copies by few links. Fingerprints of
    sets at 0.8 are often too far apart, so all other pairs that may be similar are then met by an exact rule: of similar sets the first shingles, in an order common to all, share one. Rare shingles are
    first, so what many texts share brings few together. Pairs whose first shingles share too few, or that are of one group already, aren't compared; the others are verified.
    A shingle of more than ``CROWD`` texts makes no pairs: its texts are compared by their sketches, which rule out no similar pair, in the task that holds them. First come as many links as connect what sketches
    connect; they are verified and unite groups. Then all links between different groups that sketches still allow, which are those of the few that failed and of what they had connected.
    """
    nodes = cut(by_doc.groupBy("fp").agg(F.first("sim").alias("sim"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("one")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x.as_py(), shingle_words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "s"])

    def verified(met: DataFrame) -> DataFrame:
        """Of candidate links those of similar sets. Texts are read again for nodes with a candidate only."""
        asked = cut_few(nodes.join(met.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp").select(F.col("fp").alias("_node"), F.col("one.id").alias("_own_id"), F.col("one.key").alias("_own_key")))
        rows = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"), F.col(text_col).cast("string").alias("_text"))
        rows = rows.join(F.broadcast(asked) if fits(asked, most_broadcast, "_own_id") else asked, (F.col("_key") == F.col("_own_key")) & F.col("_id").eqNullSafe(F.col("_own_id")))
        sets = cut(rows.select("_node", "_text").mapInArrow(run, "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s")))
        first, second = sets.select(F.col("node").alias("a"), F.col("s").alias("s1")), sets.select(F.col("node").alias("b"), F.col("s").alias("s2"))
        pairs = met.join(first, "a").join(second, "b").where(F.least(F.size("s1"), F.size("s2")) >= similarity * F.greatest(F.size("s1"), F.size("s2")) - 1e-9)
        pairs = pairs.select("a", "b", F.size(F.array_intersect("s1", "s2")).alias("both"), (F.size("s1") + F.size("s2")).alias("all"))
        return cut_few(pairs.where(F.col("both") >= F.lit(similarity) * (F.col("all") - F.col("both")) - 1e-9).select("a", "b"))

    sims = cut_few(nodes.groupBy("sim").agg(F.min("fp").alias("least")), 10_000)
    equal = nodes.join(sims, "sim").where("fp > least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    near = links(sims.select(F.col("sim").alias("fp"))).select(F.col("a").alias("sim_a"), F.col("b").alias("sim_b"))
    for end in "ab":
        near = near.join(sims.select(F.col("sim").alias(f"sim_{end}"), F.col("least").alias(end)), f"sim_{end}")
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    close = verified(cut_few(near.unionByName(equal).distinct()))

    def rows(more: str = "n") -> DataFrame:
        """A row for each of the first shingles, with the group that the links known so far make."""
        groups = components(close).withColumnRenamed("node", "fp")
        return nodes.join(groups, "fp", "left").select(F.col("fp").alias("node"), *dict.fromkeys(("n", more)), F.coalesce("root", "fp").alias("grp"), F.explode("prefix").alias("token"))

    found, crowds = _met(rows(), similarity, CROWD)
    met = found.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    rest = lambda n: F.ceil(F.col(n) * similarity - 1e-9) - 1  # noqa: E731  shingles after the first ones
    # pairs that share a crowded shingle may be dropped here: those meet below
    may = F.col("both") + F.greatest(rest("na"), rest("nb")) >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9
    close = cut_few(close.unionByName(verified(cut_few(met.where(may).select("a", "b")))).distinct())
    crowds = cut_few(crowds)
    if crowds.isEmpty():
        return close
    few, tried = F.broadcast(crowds) if fits(crowds, most_broadcast) else crowds, None
    for links_of in (_forest, _all_near):
        own = rows("sketch").join(few, "token")
        met, over = _alike(own, similarity, cell_cap, links_of)
        if tried is not None:
            if not over.isEmpty():
                met = met.unionByName(_joined(own, over, similarity).select("a", "b")).distinct()
            met = met.join(tried, ["a", "b"], "left_anti")
        tried = met
        close = cut_few(close.unionByName(verified(cut_few(met))).distinct())
    return close


def links(fps: DataFrame, *, max_distance: int = 4, segment_bits: tuple[int, ...] | None = None, cell_cap: int = 10_000) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints ``fp`` that connect exactly those which pairs at up to ``max_distance`` connect.

    Grids of the widths in ``segment_bits`` (1, 2, 4 or 8, falling) are used in turn: the next one for the fingerprints of points
    that hold more than ``cell_cap``, and the balls for those of the last one's. In a point each fingerprint gives as many links as connect it. Widths only
    decide what meets by chance, not the result; by default they are 2 and 1, but 1 alone for so many fingerprints that most points of width 2 hold some.
    """
    widths = segment_bits or ((2, 1) if fits(fps, 4_000_000) else (1,))
    if max_distance not in (0, 2, 4) or not {*widths} <= {1, 2, 4, 8}:
        raise ValueError("max_distance must be 0, 2 or 4, and segment_bits of 1, 2, 4 and 8")
    found, crowd = None, fps.select("fp")
    for width in widths:
        met = cut_few(_linked(_points(crowd, grid_points, width, max_distance // 2 and 1), max_distance, cell_cap))
        near = met.where("b IS NOT NULL")
        found = near if found is None else found.union(near)
        crowd = met.where("b IS NULL").select(F.col("a").alias("fp"))
        if crowd.isEmpty():
            return found.distinct()
    ball = _points(crowd, ball_points, max_distance // 2)
    least = ball.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return found.union(ball.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b"))).distinct()


LINKS = 100_000  # that a task of ``components`` holds


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, root) for each node with a link; the root is the smallest node.

    Large stars and small stars in turn, until neither changes a link: each round is two grouped minima and joins, and a checkpoint cuts the lineage. The number
    of rounds grows with the logarithm of the longest path. Up to ``LINKS`` links are one task's work, without a shuffle, whose tasks and files would be as many as it has partitions however few the links are;
    more are shuffled.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut_few(edges.select("a", "b"), LINKS)
    before = None
    while (now := state(edges)) != before:
        before, few = now, now[0] <= LINKS
        edges = edges.coalesce(1) if few else edges
        sized = F.broadcast if few else lambda df: df
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(sized(least), "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        up = large.groupBy("b").agg(F.min("a").alias("m"))
        met = large.join(sized(up), "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        edges = cut_few(met.select("e.a", "e.b").where("a < b").distinct(), LINKS)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, shingle_words: int = 4, max_distance: int = 4, similarity: float | None = None, segment_bits: tuple[int, ...] | None = None, cell_cap: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``key`` (hash of its text), ``fp``, ``root`` (an fp that names the component) and ``component_id``.

    Texts are linked whose fingerprints (``fp``, signed) differ in at most ``max_distance`` bits; or, given a ``similarity``, whose sets of shingles have that Jaccard similarity or
    more, ``fp`` then being a hash of the word sequence.

    The component is the smallest id that links reach; a null id never is, unless a component has no other. A document without
    words, or a null text, has the fingerprint 0, which links like any other; by similarity, all such documents are alike. Fewer words than a shingle make one shingle.
    Very long texts are read whole, in blocks. Of fingerprint bits that half the shingles have, none is set. Repeated rows have the same fingerprint and component. An empty table
    gives an empty result. Other columns aren't read, so their names can't clash.
    """
    if similarity is None:
        by_doc = cut(fingerprints(docs, shingle_words=shingle_words, id_col=id_col, text_col=text_col))
    else:
        by_doc = cut(sequences(docs, shingle_words=shingle_words, similarity=similarity, id_col=id_col, text_col=text_col))
    fps = cut_few(by_doc.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), 10_000)
    if similarity is None:
        found = links(fps, max_distance=max_distance, segment_bits=segment_bits, cell_cap=cell_cap)
    else:
        found = similar_links(docs, by_doc, shingle_words=shingle_words, similarity=similarity, id_col=id_col, text_col=text_col)
    linked = components(found)
    linked = cut_few(linked.join(fps, linked["node"] == fps["fp"]).select("fp", "root", "least"))
    roots = cut_few(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    far = linked.join(roots, "root").select("fp", "root", "component_id")
    alone = fps.where("n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    labels = cut_few(far.union(alone)).withColumnRenamed("fp", "label_fp")
    labelled = by_doc.join(labels, F.col("fp") == F.col("label_fp"), "left")
    return labelled.select("id", "key", "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 200_000, **how) -> DataFrame:
    """The rows of ``docs``, all columns, but of each near-duplicate component only the document with the smallest id.

    Of repeated rows of that document one stays; if it comes with several texts in one component, that of the smallest hash. Null and empty texts, very long ones and empty
    tables are as in ``near_duplicates``. Rows travel as one struct, so that columns may have any names. What goes is joined with the
    documents: up to ``most_broadcast`` of them are broadcast, so that texts aren't shuffled.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    own = found.groupBy("id", "key").agg(F.first("root").alias("root"), F.first("component_id").alias("component_id"), F.count("*").alias("n"))
    first = F.min(F.struct(F.when(F.col("id").eqNullSafe(F.col("component_id")), 0).otherwise(1), "id", "key"))
    stay = found.groupBy("root").agg(first.alias("one")).select(F.col("one.id").alias("_q_id"), F.col("one.key").alias("_q_key"))
    same = F.col("id").eqNullSafe(F.col("_q_id")) & (F.col("key") == F.col("_q_key"))
    gone = cut_few(own.join(stay, same, "left_anti").select(F.col("id").alias("_q_id"), F.col("key").alias("_q_key")))
    again = cut_few(own.where("n > 1").join(stay, same, "left_semi").select(F.col("id").alias("_q_id"), F.col("key").alias("_q_key")))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"))
    match = F.col("id").eqNullSafe(F.col("_q_id")) & (F.col("key") == F.col("_q_key"))
    sized = lambda df: F.broadcast(df) if fits(df, most_broadcast, "_q_id") else df
    kept = rows.join(sized(gone), match, "left_anti")
    if not again.isEmpty():  # rows that stay, but repeat
        once = sized(again)
        kept = kept.join(once, match, "left_anti").unionByName(kept.join(once, match, "left_semi").dropDuplicates(["id", "key"]))
    return kept.select("row.*")
