"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of that length and a rest.
Pieces of one size are interchangeable, so the packing is planned on the counts of sizes,
a table no longer than the largest permitted length whatever the data: sizes descending,
each piece goes to the open bin with the least room that holds it; where none does, a bin
of the permitted length with the least cost per word is opened, the words that smaller
pieces can still add being counted in; in the end each bin shrinks to the shortest length
that holds its contents. Bins with equal contents are planned as one group. The plan says,
for each size and range of ranks, the bins and offsets; pieces are ranked within their
size (by id, in sorted pieces) and look their place up.

A null or blank text has no words: its row comes back with null bin. Rows with equal ids
are pieces of their own. Texts count whole, however long; an empty table has an empty plan. Extra
columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.llm.common import free_names, may_hold, pick, stored, table, word_count, words
from harvestlens.llm.registry import query
from harvestlens.operators.ordering import global_positions

LENGTHS = (512, 1024, 2048)
OVERHEAD = 16  # cost of a sequence beside its words, in words
ATTENTION = 16384  # length at which attention costs as much as the words themselves


@dataclass
class Group:
    """Bins with the same contents: numbers first_bin to first_bin + bins - 1."""

    first_bin: int
    bins: int
    length: int
    used: int


@dataclass
class Plan:
    """Rows (size, first rank, pieces, first bin, pieces per bin, offset) and the bins' ranges."""

    steps: list[tuple[int, int, int, int, int, int]]
    groups: list[tuple[int, int, int, int]]  # first bin, bins, length after shrinking, words


def default_costs(lengths: Sequence[int]) -> dict[int, float]:
    """Cost of computing a sequence of each length, filled or not: linear, plus attention."""
    return {c: c + OVERHEAD + c * c / ATTENTION for c in lengths}


def plan_bins(counts: Mapping[int, int], lengths: Sequence[int], costs: Mapping[int, float]) -> Plan:
    """Pack ``counts[size]`` pieces of each size; sizes are from 1 to the largest length."""
    lengths = sorted(lengths)
    if any(not 1 <= s <= lengths[-1] for s in counts):
        raise ValueError("a piece is longer than the longest permitted length")
    left = {s: n for s, n in counts.items() if n > 0}
    rooms: list[int] = []  # rooms of open groups, sorted
    open_: dict[int, list[Group]] = {}
    steps, closed, next_bin = [], [], 0

    def put(group: Group) -> None:
        room = group.length - group.used
        if not room:
            closed.append(group)
            return
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append(group)

    def fill(group: Group, size: int, done: int, n: int) -> int:
        """Put up to n pieces into the bins of a group, which isn't among the open ones."""
        per = (group.length - group.used) // size
        whole = min(group.bins, n // per)
        if whole:
            steps.append((size, done, whole * per, group.first_bin, per, group.used))
            put(Group(group.first_bin, whole, group.length, group.used + per * size))
        used, rest = whole * per, 0
        if whole < group.bins and n > used:
            rest = n - used  # fewer than fill a bin
            steps.append((size, done + used, rest, group.first_bin + whole, rest, group.used))
            put(Group(group.first_bin + whole, 1, group.length, group.used + rest * size))
        spare = group.bins - whole - (1 if rest else 0)
        if spare:
            put(replace(group, first_bin=group.first_bin + group.bins - spare, bins=spare))
        return used + rest

    for size in sorted(left, reverse=True):
        n, done = left.pop(size), 0
        while done < n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                length = _cheapest(size, n - done, left, lengths, costs)
                bins = -(-(n - done) // (length // size))
                done += fill(Group(next_bin, bins, length, 0), size, done, n - done)
                next_bin += bins
                continue
            room = rooms[at]
            group = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            done += fill(group, size, done, n - done)
    closed += [g for groups in open_.values() for g in groups]
    shrunk = [(g.first_bin, g.bins, lengths[bisect.bisect_left(lengths, g.used)], g.used) for g in closed if g.used]
    return Plan(sorted(steps), sorted(shrunk))


def _cheapest(size: int, n: int, left: Mapping[int, int], lengths: Sequence[int], costs: Mapping[int, float]) -> int:
    """The permitted length with the least cost per word that its bins are likely to hold."""
    smaller = sorted(left)
    best = None
    for length in lengths:
        if length < size:
            continue
        own = min(length // size, n)
        room = length - own * size
        bins = max(1, n // own)
        taken: dict[int, int] = {}
        filled = own * size
        while room:  # best fit of what is left, as if every new bin took the same
            at = bisect.bisect_right(smaller, room) - 1
            while at >= 0 and left[smaller[at]] - taken.get(smaller[at], 0) < bins:
                at -= 1
            if at < 0:
                break
            s = smaller[at]
            k = max(1, min(room // s, (left[s] - taken.get(s, 0)) // bins))
            taken[s] = taken.get(s, 0) + k * bins
            room -= k * s
            filled += k * s
        target = lengths[bisect.bisect_left(lengths, filled)]  # it will shrink to this
        cost = costs[target] / filled
        if best is None or cost < best[0] - 1e-12:
            best = (cost, length)
    return best[1]


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """doc_id, tie (a hash of the text), piece, first_word, n_words."""
    sized = pick(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), word_count(F.col("text")).alias("_size")
    )
    last = F.greatest(F.lit(0), F.ceil(F.col("_size") / longest) - 1)
    rows = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return rows.withColumn("first_word", F.col("piece") * longest).withColumn(
        "n_words", F.least(F.lit(longest), F.col("_size") - F.col("first_word"))
    ).drop("_size")


def piece_texts(text: Column, longest: int) -> Column:
    """The words of each piece of a text, joined by blanks; null if it has none."""
    def cut(found: Column) -> Column:
        last = F.floor((F.size(found) - 1) / longest).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(found, i * longest + 1, F.lit(longest)), " "))
        return F.when(F.size(found) > 0, parts)

    return F.transform(F.array(words(text)), cut)[0]  # so that the words are found once


def once_each(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row of each ``key``; only rows whose key may be there again are moved for it. ``df`` is read three times."""
    (name,) = free_names(df, "key_hash")
    named = df.withColumn(name, F.xxhash64(*key))
    again = named.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first(name).alias(name)).filter("n > 1").select(name)
    several = may_hold(stored(again, "repeated-keys"), name)
    apart = named.filter(~several).union(named.filter(several).dropDuplicates(key))
    return apart.drop(name)


def pack(
    docs: DataFrame, lengths: Sequence[int] = LENGTHS, costs: Mapping[int, float] | None = None
) -> DataFrame:
    """One row per piece: doc_id, tie, piece, first_word, n_words, bin_id, bin_offset, length, bin_words."""
    lengths = sorted(lengths)
    cut = stored(pieces(docs, lengths[-1]), "pieces")
    # at most as many rows as the longest permitted length
    counts = {r["n_words"]: r["n"] for r in cut.filter("n_words > 0").groupBy("n_words").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_bins(counts, lengths, costs or default_costs(lengths))
    order = [F.col("doc_id"), F.col("tie"), F.col("piece")]
    ranked = global_positions(cut.filter("n_words > 0"), ["n_words"], order, "_nth")
    columns = ["doc_id", "tie", "piece", "first_word", "n_words"]
    step = np.array(plan.steps, dtype=np.int64).reshape(-1, 6)
    group = np.array(plan.groups, dtype=np.int64).reshape(-1, 4)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = step[:, 0] * (1 << 40) + step[:, 1]
        for batch in batches:
            size = batch.column(4).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False) - 1
            at = step[np.searchsorted(keys, size * (1 << 40) + rank, side="right") - 1]
            inside = rank - at[:, 1]
            bin_id = at[:, 3] + inside // at[:, 4]
            offset = at[:, 5] + inside % at[:, 4] * size
            mine = group[np.searchsorted(group[:, 0], bin_id, side="right") - 1]
            added = [pa.array(x, pa.int64()) for x in (bin_id, offset, mine[:, 2], mine[:, 3])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *added], names=[*columns, "bin_id", "bin_offset", "length", "bin_words"]
            )

    kind = cut.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, tie long, piece long, first_word long, n_words long, bin_id long, bin_offset long, length long, bin_words long"
    placed = ranked.select(*columns, "_nth").mapInArrow(place, out)
    none = [F.lit(None).cast("long").alias(c) for c in ("bin_id", "bin_offset", "length", "bin_words")]
    return placed.union(cut.filter("n_words = 0").select(*columns, *none))


def sequences(docs: DataFrame, lengths: Sequence[int] = LENGTHS, costs: Mapping[int, float] | None = None) -> DataFrame:
    """The packed sequences: bin_id, length, n_words, doc_ids, offsets and the text, words joined by blanks.

    A sequence has at most ``max(lengths)`` words, so gathering one is bounded.
    """
    longest = max(lengths)
    placed = pack(docs, lengths, costs).filter("bin_id IS NOT NULL")
    keyed = pick(docs, "doc_id", "text").filter("text IS NOT NULL").withColumn("tie", F.xxhash64("text"))
    texts = once_each(keyed, ["doc_id", "tie"])  # rows equal in id and text have the same words: one copy serves all their pieces
    # texts are cut before they meet their places: a list of words takes twice the room of its text, and every
    # piece would take along the whole of it
    texts = texts.select(
        F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), F.posexplode(piece_texts(F.col("text"), longest)).alias("_p", "words")
    )
    joined = placed.join(
        texts, placed["doc_id"].eqNullSafe(texts["_d"]) & (placed["tie"] == texts["_t"]) & (placed["piece"] == texts["_p"])
    )
    part = F.struct(F.col("bin_offset").alias("offset"), "doc_id", "words")
    bins = joined.select("bin_id", "length", "bin_words", part.alias("p")).groupBy("bin_id").agg(
        F.first("length").alias("length"),
        F.first("bin_words").alias("n_words"),
        F.array_sort(F.collect_list("p")).alias("p"),
    )
    return bins.select(
        "bin_id",
        "length",
        "n_words",
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.offset").alias("offsets"),
        F.array_join("p.words", " ").alias("text"),
    )


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("tie")
