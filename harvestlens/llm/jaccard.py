"""N-gram Jaccard join by parity sketches.

Every shingle flips one bit of a sketch, so two sketches differ in at most as many bits as
the sets differ in shingles. Three kinds of sketch are made of a set:

* a wide one, cut into bands. A band stands for the odd positions of its part, folded by
  XOR into 48 bits. Sets of a size class that are similar enough differ in at most ``d``
  shingles, so of ``d + 1`` bands one at least agrees (pigeonhole): equal bands are the
  candidates, without loss. Sizes are classed by powers of ``CLASS_RATIO``; a set also
  emits the bands of the class below if partners may be there. Empty bands say little:
  ``SPARE`` more bands let a set leave out that many of them.
* a dense one of 512 bits, whose Hamming distance sorts out candidates inside the join.
* a longer one of two bits a shingle or more, that does so again before sets are compared.

Sets that are equal are one class from the start, so copies, however many, are one node.
Bands that only one class has, by far the most, meet nothing and aren't moved: a table of
bits of fixed size, made in one pass over the lists, says which bands may occur twice.
Candidates are compared in steps, each leaving less to the next:

1. Each class with the smallest class of its band: linear in the members.
2. In bands whose members are not in one component yet: each member with the next two in an
   order of the band's own, cut in pieces; again linear. It joins most of a group whose texts
   link with many others but not with its first.
3. Members of one band that are in different components, pairs far apart by the dense
   sketch being dropped inside the join.

In step 3, bands with more than ``CROWDED`` members (of a large group of texts that resemble
one another but mostly don't link) are left out, and all members of such bands are cut into
``FINER * (d + 1)`` finer bands. No pair is lost, whatever ``CROWDED`` is: two linked sets differ in at
most ``d`` of these ``2 (d + 1)`` bands and share ``d + 2`` or more. Put the bands in any one order
for all sets. The first band in this order that two linked sets share has at least ``d + 1`` shared
ones behind it, in either set, so it is among the first ``2 (d + 1) - (d + 1) = d + 1`` of each set:
it is enough that sets meet in these (prefix filter). The order is by rarity, so that few
sets meet. A pair of which one set isn't in a crowded band has only uncrowded bands in common
and meets in those; a pair with both in crowded bands meets in the finer ones.

Every pair is exactly compared unless it cannot link or its ends are in one component
already, so components are exact. A class is named by 128 bits of its set.

Rows: a null or blank text has an empty set and links with nothing; with fewer words than
``shingle`` the whole sequence is one shingle. A component's id is its smallest non-null
``doc_id``. Repeated rows and ids are fine; texts count whole, however long. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestlens.llm.common import components, discard, free_names, in_parts, may_hold, pick, stored, table
from harvestlens.llm.registry import query

CLASS_RATIO = 1.6
SPARE = 4
CROWDED = 16  # members of a band above which it is cut finer
FINER = 2
PIECE = 1024  # members of a piece of a band's chain
SKETCH_WORDS = 8  # 512 bits
FILTER_BITS = 1 << 24  # of the table that finds the rows whose sets are needed: 2 MB
MARK_BITS = 1 << 28  # of the table that finds bands that may occur twice: 32 MB at most
_U = np.uint64
_WIDTH = 6  # bytes of a stored band
_SEGMENTS = 128  # parts of the table, however large it is
_PLACE = 3  # bytes of a place inside a segment of the table
# Odd multipliers for the positions of a shingle and for mixing.
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(_MIX[1])
    x = (x ^ (x >> _U(27))) * _U(_MIX[2])
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str | None, shingle: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased."""
    if not text:
        return np.zeros(0, dtype=_U)
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return np.zeros(0, dtype=_U)
    h = np.array([hashes[w] for w in found], dtype=_U)
    # a rolling polynomial of the word hashes; its length is mixed in, so that a short text's
    # one shingle is no prefix of others
    k = min(shingle, len(h))
    out = np.full(len(h) - k + 1, k, dtype=_U)
    for j in range(k):
        out = out * _U(_MIX[0]) + h[j : len(h) - k + 1 + j]
    return np.unique(_mixed(out))


def row_key() -> Column:
    """Names a row by its id and text; equal rows are equal here."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def set_name(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def size_classes(percent: int, up_to: int) -> list[tuple[int, int, int]]:
    """(first size, last size, bands) of each size class.

    If the smaller set of a linked pair has a size of the class, the two differ in at most
    ``d`` shingles; bands = d + 1 + SPARE.
    """
    found, first = [], 1
    ratio = max(CLASS_RATIO, 100 / percent)  # a set's partners are of its class or one next to it
    while first <= up_to:
        last = max(first, int(first * ratio))
        larger = last * 100 // percent
        d = (100 - percent) * (last + larger) // (100 + percent)
        found.append((first, last, d + 1 + SPARE))
        first = last + 1
    return found


def _folded_parts(s: np.ndarray, bands: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """XOR of the shingles of each of ``bands`` parts, and which parts have any."""
    place = ((s >> _U(shift)) % _U(bands)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    sorted_ = place[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    fold, filled = np.zeros(bands, dtype=_U), np.zeros(bands, dtype=bool)
    at = sorted_[starts]
    fold[at] = np.bitwise_xor.reduceat(s[order], starts)
    filled[at] = True
    return fold, filled


def _bands(s: np.ndarray, number: int, bands: int) -> np.ndarray:
    """Hashes of the bands of a set in size class ``number``."""
    fold, filled = _folded_parts(s, bands, 33)
    name = _mixed(fold + _U(_MIX[0]) * (np.arange(bands, dtype=_U) + _U(number * 0x10001 + 1)))
    return name[filled] if bands - filled.sum() <= SPARE else name


def _all_bands(s: np.ndarray, number: int, bands: int) -> np.ndarray:
    """All finer bands of a set in size class ``number``, empty ones included."""
    fold, _ = _folded_parts(s, bands, 29)
    return _mixed(fold + _U(_MIX[2]) * (np.arange(bands, dtype=_U) + _U(number * 0x10001 + 7)))


def _narrow(bands: np.ndarray) -> bytes:
    """The upper 48 bits of each band."""
    return (bands >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH].tobytes()


def _wide(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // _WIDTH, 8), dtype=np.uint8)
    out[:, :_WIDTH] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, _WIDTH)
    return out.reshape(-1).view("<u8")


def _sketch(s: np.ndarray, bits: int = 64 * SKETCH_WORDS) -> np.ndarray:
    """Parity of the shingles at each of ``bits`` (a power of two) positions; halves fold by XOR."""
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _long_sketch(s: np.ndarray) -> np.ndarray:
    """Two to four bits a shingle: the distance of two such is close to the true difference."""
    return _sketch(s, max(64 * SKETCH_WORDS, 1 << int(2 * len(s) - 1).bit_length()))


SIGNED = "doc_id {kind}, row_key long, n int, class binary, sketch array<long>, long array<long>, bands binary"


def sign(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """One row per document: set size, class (name of the set), dense and long sketch, bands."""
    source = pick(docs, "doc_id", "text").select("doc_id", row_key().alias("row_key"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, classes = _WordHashes(), size_classes(percent, 64)
        for batch in in_parts(batches):
            sizes, names, sketches, longs, bands = [], [], [], [], []
            for text in batch.column(2):
                s = shingle_hashes(text.as_py(), shingle, hashes)
                while len(s) and classes[-1][1] < len(s):
                    classes = size_classes(percent, 4 * len(s))
                sizes.append(len(s))
                names.append(set_name(s))
                longs.append(_long_sketch(s))
                sketches.append(_sketch(s))
                mine = []
                for i, (first, last, n) in enumerate(classes):
                    # this class, or the one below if a partner of 'percent' of the size is there
                    if first <= len(s) <= last or (last < len(s) and len(s) * percent <= 100 * last):
                        if n > 1 + SPARE:  # else only equal sets link, and those are one class already
                            mine.append(_bands(s, i, n))
                bands.append(_narrow(np.concatenate(mine)) if mine else b"")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int32()),
                    pa.array(names, pa.binary()),
                    _lists(sketches),
                    _lists(longs),
                    pa.array(bands, pa.binary()),
                ],
                names=["doc_id", "row_key", "n", "class", "sketch", "long", "bands"],
            )

    return source.mapInArrow(run, SIGNED.format(kind=kind))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def twice_marks(lists: DataFrame, column: str, expected: int) -> tuple[bytes, int]:
    """A table of bits that are set where two or more of the bands in ``column`` fall, and its size.

    Every batch of lists sends the places of its bands, sorted, by segment of the table: one row a
    segment at most, and the number of segments is fixed, so that the rows follow the lists.
    Segments are merged apart and only the finished table, of a fixed size, is put together.
    With very many bands it fills up and marks more, never fewer.
    """
    bits = min(MARK_BITS, max(1 << 20, 1 << int(8 * max(expected, 1) - 1).bit_length()))
    width = bits // _SEGMENTS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            found = _wide(b"".join(x for x in batch.column(0).to_pylist() if x)) & _U(bits - 1)
            if not len(found):
                continue
            found.sort()
            starts = np.searchsorted(found, np.arange(_SEGMENTS + 1, dtype=_U) * _U(width))
            inside = (found & _U(width - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :_PLACE]
            full = np.flatnonzero(starts[1:] > starts[:-1])
            parts = [inside[starts[i] : starts[i + 1]].tobytes() for i in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(parts, pa.binary())], names=["segment", "places"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if segment not in held:
                    held[segment] = np.zeros(width, dtype=np.uint8)
                counts, at = held[segment], np.zeros((len(packed) // _PLACE, 4), dtype=np.uint8)
                at[:, :_PLACE] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, _PLACE)
                at = at.reshape(-1).view("<u4")
                again = np.flatnonzero(at[1:] == at[:-1])
                counts[at] = np.minimum(2, counts[at] + 1)  # a place that is here several times counts once,
                counts[at[again]] = 2  # and then as what it is
        full = [(s, np.packbits(c > 1, bitorder="little").tobytes()) for s, c in held.items() if (c > 1).any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in full], pa.int64()), pa.array([m for _, m in full], pa.binary())], names=["segment", "marks"]
        )

    dealt = lists.select(column).mapInArrow(places, "segment long, places binary").repartition("segment")
    rows = stored(dealt.mapInArrow(merged, "segment long, marks binary"), "band-marks").toArrow()  # bits / 8 bytes at most
    size = width // 8
    out = bytearray(bits // 8)
    for segment, marks in zip(rows["segment"].to_pylist(), rows["marks"].to_pylist()):
        out[segment * size : (segment + 1) * size] = marks
    return bytes(out), bits


def _marked(marks: np.ndarray, bits: int, bands: np.ndarray) -> np.ndarray:
    at = (bands & _U(bits - 1)).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def shared_bands(lists: DataFrame, expected: int) -> DataFrame:
    """``class, band`` of the bands in ``class, bands`` that may occur in another row too, stored."""
    table_, bits = twice_marks(lists, "bands", expected)
    sent = lists.sparkSession.sparkContext.broadcast(table_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(sent.value, dtype=np.uint8)
        for batch in in_parts(batches):
            packed = [x or b"" for x in batch.column(1).to_pylist()]
            bands = _wide(b"".join(packed))
            rows = np.repeat(np.arange(batch.num_rows), [len(x) // _WIDTH for x in packed])
            hit = _marked(marks, bits, bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[hit])), pa.array(bands[hit].view(np.int64))], names=["class", "band"]
            )

    found = stored(lists.select("class", "bands").mapInArrow(run, "class binary, band long"), "bands")
    sent.destroy()
    return found


def _of_sets(docs: DataFrame, wanted: DataFrame, shingle: int, make: Callable, fields: dict[str, pa.DataType], kinds: str) -> DataFrame:
    """``class`` and the columns that ``make(set)`` gives for the wanted (class, row_key) rows and a few others.

    The texts stay where they are: rows that may be wanted are found by a table of bits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in in_parts(batches):
            sets = [shingle_hashes(t.as_py(), shingle, hashes) for t in batch.column(0)]
            made = [make(s) for s in sets]
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(fields.values())]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in sets], pa.binary()), *columns], names=["class", *fields])

    texts = docs.withColumn("row_key", row_key()).filter(may_hold(wanted, "row_key", FILTER_BITS)).select("text")
    return texts.mapInArrow(run, f"class binary, {kinds}")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``class, set`` of the wanted (class, row_key) rows, one row a class."""
    made = _of_sets(docs, wanted, shingle, lambda s: (s.view(np.int64),), {"set": pa.list_(pa.int64())}, "set array<long>")
    return made.join(wanted.select("class"), "class").dropDuplicates(["class"])


def rare_bands(docs: DataFrame, wanted: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``class, band``: of the finer bands of each wanted class the rarest, as many as can differ and one.

    The order is: bands that no other set can have, then by how often a band occurs. A set
    with so many of the first kind emits nothing.
    """
    def make(s: np.ndarray) -> tuple[bytes, bytes]:
        found = []
        for i, (first, last, n) in enumerate(size_classes(percent, 2 * len(s))):
            if first <= len(s) <= last or (last < len(s) and len(s) * percent <= 100 * last):
                found.append(_narrow(_all_bands(s, i, FINER * (n - SPARE))))
        # those of the class below, if any, and those of the set's own class
        return (b"", b"", *found)[-2:]

    kinds = {"lower": pa.binary(), "own": pa.binary()}
    lists = stored(_of_sets(docs, wanted, shingle, make, kinds, "lower binary, own binary"), "finer-bands")
    every = lists.select(F.explode(F.array("lower", "own")).alias("bands"))
    total = every.agg(F.sum(F.octet_length("bands"))).first()[0] or 0
    table_, bits = twice_marks(every, "bands", total // _WIDTH)
    sent = lists.sparkSession.sparkContext.broadcast(table_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(sent.value, dtype=np.uint8)
        for batch in in_parts(batches):
            rows, parts, needs, bands = [], [], [], []
            for column, part in ((1, 0), (2, 1)):
                for row, packed in enumerate(batch.column(column).to_pylist()):
                    b = _wide(packed or b"")
                    hit = b[_marked(marks, bits, b)]
                    need = len(b) // FINER
                    if len(hit) and len(b) - len(hit) < need:
                        rows.append(np.full(len(hit), row))
                        parts.append(np.full(len(hit), part, dtype=np.int32))
                        needs.append(np.full(len(hit), need, dtype=np.int32))
                        bands.append(hit.view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.concatenate(rows))), *[pa.array(np.concatenate(x)) for x in (parts, needs, bands)]],
                    names=["class", "part", "need", "band"],
                )

    rows = lists.mapInArrow(run, "class binary, part int, need int, band long").dropDuplicates(["class", "part", "band"])
    rows = stored(rows, "finer-members")
    often = rows.groupBy("band").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = rows.join(stored(often, "finer-counts"), "band")
    whole = Window.partitionBy("class", "part")
    alone = FINER * F.col("need") - F.count(F.lit(1)).over(whole)
    place = alone + F.row_number().over(whole.orderBy("often", "band"))
    found = stored(shared.withColumn("place", place).filter("place <= need").select("class", "band"), "rare-bands")
    sent.destroy()
    discard(lists, rows)
    return found


def _far(percent: int) -> str:
    """SQL: the dense sketches of ``x`` and ``y`` prove that the pair doesn't link."""
    distance = " + ".join(f"bit_count(x.sketch[{i}] ^ y.sketch[{i}])" for i in range(SKETCH_WORDS))
    apart = f"({distance}) * {100 + percent} > {100 - percent} * (x.n + y.n)"
    return f"{apart} OR 100 * least(x.n, y.n) < {percent} * greatest(x.n, y.n)"


def _folded(x: str, y: str) -> str:
    """SQL: sketch ``x`` folded to the length of ``y`` if it is longer (twice as long at most)."""
    half = f"zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q)"
    return f"if(size({x}) > size({y}), {half}, {x})"


def _linked(pairs: DataFrame, docs: DataFrame, heads: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough, stored.

    The long sketches, a small part of the sets' size, are compared first and leave few
    pairs that don't link; the sets of those are then made and compared exactly.
    """
    def end(df: DataFrame, name: str, *what: str) -> DataFrame:
        return df.select(F.col("class").alias(name), *[F.col(w).alias(f"{w}_{name}") for w in what])

    pairs = stored(pairs, "candidate-pairs")
    if pairs.isEmpty():
        return pairs
    differ = f"zip_with({_folded('long_a', 'long_b')}, {_folded('long_b', 'long_a')}, (p, q) -> bit_count(p ^ q))"
    apart = f"aggregate({differ}, 0, (s, x) -> s + x) * {100 + percent} > {100 - percent} * (n_a + n_b)"
    near = pairs.join(end(heads, "a", "long", "n"), "a").join(end(heads, "b", "long", "n"), "b")
    near = stored(near.filter(f"NOT ({apart})").select("a", "b"), "near-pairs")
    ends = near.select(F.col("a").alias("class")).union(near.select(F.col("b").alias("class"))).distinct()
    wanted = stored(heads.select("class", "row_key").join(ends, "class"), "near-classes")
    sets = stored(sets_of(docs, wanted, shingle), "shingle-sets")
    both = F.size(F.array_intersect("set_a", "set_b"))
    united = F.size("set_a") + F.size("set_b") - both
    found = near.join(end(sets, "a", "set"), "a").join(end(sets, "b", "set"), "b").filter(100 * both >= percent * united)
    found = stored(found.select("a", "b"), "links")
    discard(pairs, near, wanted, sets)
    return found


def similarity_classes(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, part, component_id.

    Documents link when 100 * intersection >= ``percent`` * union of their shingle sets;
    ``row_key`` is a hash of id and text, ``part`` names the component (null for an empty set),
    ``component_id`` is the smallest doc_id reachable.
    """
    docs = pick(docs, "doc_id", "text")
    raw = stored(sign(docs, shingle, percent), "signed")
    ids = stored(raw.select("class", "doc_id", "row_key", F.col("n").cast("long").alias("n_shingles")), "signed-rows")
    some = raw.filter("n > 0").groupBy("class")
    first = [F.first(c).alias(c) for c in ("n", "sketch", "long")]
    heads = stored(some.agg(*first, F.min("row_key").alias("row_key"), F.min("doc_id").alias("low")), "classes")
    # the lists of one row a class, found by a table of bits; a few more do no harm
    lists = raw.filter(may_hold(heads, "row_key", FILTER_BITS)).select("class", "bands")
    total = lists.agg(F.sum(F.octet_length("bands"))).first()[0] or 0
    found = shared_bands(lists, total // _WIDTH)
    discard(raw)
    # counts and firsts apart from the rows: a join back with them can be split among tasks
    spans = found.groupBy("band").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count(F.lit(1)).alias("members"))
    spans = stored(spans.filter("least < most").select("band", "least", "members"), "shared-bands")
    members = stored(found.join(spans, "band"), "band-members")
    discard(found, spans)
    facts = heads.select("class", "n", "sketch")
    far = _far(percent)

    def end(name: str, side: str) -> DataFrame:
        return facts.select(F.col("class").alias(name), F.struct("n", "sketch").alias(side))

    stars = members.filter("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b")).distinct()
    stars = stars.join(end("a", "x"), "a").join(end("b", "y"), "b").filter(f"NOT ({far})").select("a", "b")
    links = _linked(stars, docs, heads, shingle, percent)
    joined = components(links)

    def still_open(members: DataFrame) -> DataFrame:
        """Members of bands that reach over several components, with their component."""
        named = members.select("class", "band", "members").join(joined, members["class"] == joined["node"], "left").select(
            "class", "band", "members", F.coalesce("component", "class").alias("part")
        )
        named = stored(named, "named-members")
        wide = named.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi")
        open_ = stored(named.join(stored(wide.select("band"), "open-bands"), "band"), "open-members")
        discard(named)
        return open_

    # neighbours in an order of each band's own: still linear in the members, and enough to
    # join most of a group whose texts link with many others but not with its first
    open_ = still_open(members)
    discard(members)
    if not open_.isEmpty():
        turn = F.xxhash64("class", "band")
        piece = F.pmod(F.xxhash64("class", "band", F.lit(1)), F.ceil(F.col("members") / PIECE))
        order = Window.partitionBy("band", "piece").orderBy("turn", "class")
        nexts = open_.withColumn("piece", piece).withColumn("turn", turn)
        own = F.struct("class", "part")
        nexts = nexts.select(own.alias("x"), *[F.lead(own, i).over(order).alias(f"y{i}") for i in (1, 2)])
        pairs = nexts.select("x", F.explode(F.array("y1", "y2")).alias("y")).filter("y IS NOT NULL AND x.part <> y.part")
        pairs = pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
        pairs = pairs.join(end("a", "x"), "a").join(end("b", "y"), "b").filter(f"NOT ({far})").select("a", "b")
        links = links.union(_linked(pairs, docs, heads, shingle, percent))
        joined = components(links)

    # what is left: every pair of members of one band in different components
    left = still_open(open_)
    discard(open_)
    if not left.isEmpty():
        crowded = left.filter(F.col("members") > CROWDED).select("class", "part").distinct()
        crowded = stored(crowded.join(heads.select("class", "row_key"), "class"), "crowded-classes")
        meeting = left.filter(F.col("members") <= CROWDED).select("class", "band", "part")
        if not crowded.isEmpty():
            rare = rare_bands(docs, crowded.select("class", "row_key"), shingle, percent)
            meeting = meeting.union(rare.join(crowded.select("class", "part"), "class").select("class", "band", "part"))
        meeting = stored(meeting.join(facts, "class"), "meeting-members")

        def side(name: str, part: str, facts_: str) -> DataFrame:
            return meeting.select("band", F.col("class").alias(name), F.col("part").alias(part), F.struct("n", "sketch").alias(facts_))

        x, y = side("a", "pa", "x"), side("b", "pb", "y")
        rest = x.join(y, (x["band"] == y["band"]) & F.expr(f"a < b AND pa <> pb AND NOT ({far})"))
        links = links.union(_linked(rest.select("a", "b").distinct(), docs, heads, shingle, percent))
        discard(meeting)
        joined = components(links)
    discard(left)

    lowest = heads.select("class", "low").join(joined, heads["class"] == joined["node"], "left")
    lowest = lowest.withColumn("part", F.coalesce("component", "class"))
    part_low = lowest.groupBy("part").agg(F.min("low").alias("component_id"))
    answer = lowest.join(part_low, "part").select("class", "part", "component_id")
    return ids.join(answer, "class", "left").select(
        "doc_id",
        "row_key",
        "n_shingles",
        "part",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id.

    Ids that are null come last; rows that share the smallest id are ordered by a hash of
    the text. Documents with an empty set stay. Rows equal in id and text are one document
    and stay or go together as one row: which of them, if other columns differ, is not fixed.
    """
    found = stored(similarity_classes(docs, shingle, percent).filter("n_shingles > 0"), "near-copies")
    rank = F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("d"), F.col("row_key").alias("k"))
    first = found.groupBy("part").agg(F.min(rank).alias("first"))
    gone_id, gone_key, own_key = free_names(docs, "gone_id", "gone_key", "own_key")
    gone = found.join(first, "part").filter(~rank.eqNullSafe(F.col("first"))).select(
        F.col("doc_id").alias(gone_id), F.col("row_key").alias(gone_key)
    )
    keyed = docs.withColumn(own_key, row_key())
    left = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone[gone_id]) & (keyed[own_key] == gone[gone_key]), "left_anti")
    return left.dropDuplicates(["doc_id", own_key]).select(*[F.col(f"`{c}`") for c in docs.columns])


@query(
    "op3_ngram_jaccard",
    oracle=r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
            lambda x: x <> '') AS w
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
    ), n AS (
        SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), p AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
    ), e AS (
        SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
    ), r(root, node) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT r.root, e.b FROM r JOIN e ON r.node = e.a
    )
    SELECT root AS doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(node) AS component_id
    FROM r LEFT JOIN n ON n.doc_id = root GROUP BY root
    """,
)
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return similarity_classes(docs, shingle=4, percent=85).select("doc_id", "n_shingles", "component_id")
