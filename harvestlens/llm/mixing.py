"""Mixing sources to target weights, in DataFrame functions only.

1. The words of a source form one stream, its documents in the order of a hash of doc_id and
   text, then (doc_id, size, text hash); the stream is cut into blocks of ``block`` words, the last one shorter.
2. Each source has a quota of output blocks (slots), its target over its mean block. All
   slots together pass through one pseudorandom permutation and are cut into shards of
   ``shard`` slots: the source counts of a shard are a multinomial draw given the totals.
   (Independent draws would miss a target by about the square root of its slots, and take
   a source at its cap over it.)
3. The r-th slot of a source takes block ``permuted(r mod n)`` of its n blocks in epoch
   ``r div n``: a pass over the source in pseudorandom order, another one for each epoch.
4. Slots and blocks meet in an equi-join on (source, block index).

A target is at most ``max_repeats`` times its source's size, so a block, and with it a
document, is taken at most that often. Everything is a hash of ids and ``seed``: reruns
agree whatever the partitioning. A null text has no words, is never taken and stays in the
report; a null source is a source of its own; repeated rows are documents of their own
(which of two equal rows gets which piece is immaterial). No words at all: targets 0,
nothing taken. Texts count whole, however long. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestlens.llm.common import free_names, pick, stored, table, word_count, words
from harvestlens.llm.registry import query
from harvestlens.operators.ordering import global_positions

BLOCK = 64
SHARD = 1024


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash of the text that orders rows with equal ids."""
    return pick(docs, "doc_id", "source", "text").select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
    )


def source_targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """One row per source: its size, weight and target words.

    Sources in code point order, null last, take the weights in turn and share the total
    size by them. A target stops at ``max_repeats`` sizes; what is over goes to the other
    sources by weight until none is above. In closed form: with sources sorted by cap per
    weight, the full ones are a prefix, found by running sums.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn("_i", F.row_number().over(order) - 1).withColumn(
        "weight", F.get(cycle, F.col("_i") % len(weights))
    )
    whole = Window.partitionBy()
    fill = Window.orderBy("_r", "_i").rowsBetween(Window.unboundedPreceding, 0)
    cap = (max_repeats * F.col("source_size")).cast("double")
    levels = (
        ranked.withColumn("_cap", cap)
        .withColumn("_r", F.col("_cap") / F.col("weight"))
        .withColumn("_caps", F.sum("_cap").over(fill) - F.col("_cap"))
        .withColumn("_rest", F.sum("weight").over(whole) - F.sum("weight").over(fill) + F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(whole))
        # the level if this source and all after it were not full
        .withColumn("_level", (F.col("_total") - F.col("_caps")) / F.col("_rest"))
    )
    # the first source, in this order, that isn't full at its level sets the level of all
    level = F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "_i", "_level"))).over(whole)["_level"]
    return levels.withColumn("_set", level).select(
        "source",
        "_i",
        "source_size",
        "weight",
        F.when(F.col("_set").isNull(), F.col("_cap"))
        .otherwise(F.least(F.col("_cap"), F.col("weight") * F.col("_set")))
        .alias("target"),
    )


def stream_positions(sized: DataFrame, seed: int) -> DataFrame:
    """Add ``_start``: words of the source's stream before the document."""
    order = [F.xxhash64("doc_id", "tie", F.lit(seed)), F.col("doc_id"), F.col("size"), F.col("tie")]
    return global_positions(sized, ["_i"], order, "_nth", running={"_start": "size"}).drop("_nth")


def permuted(index: Column, n: Column, *salt: Column, rounds: int = 6, walks: int = 64) -> Column:
    """Pseudorandom permutation of 0..n-1 for any n: a Feistel network on two digits.

    With ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``, x is the pair (x div b, x mod b). A round adds
    a hash of the second digit to the first (mod a), then one of the first to the second (mod b):
    each step can be undone, so all of them are a permutation of the a * b pairs. A result of n or
    more, of which there are fewer than ``a``, goes through again until it falls below n
    (cycle walking), which leaves a permutation of 0..n-1; of ``walks`` turns nearly always the
    first or second is the last.
    """
    root = F.ceil(F.sqrt(n.cast("double")))
    state = F.struct(
        index.cast("long").alias("x"), n.cast("long").alias("n"), root.cast("long").alias("a"), F.ceil(n / root).cast("long").alias("b"),
        F.xxhash64(*salt).alias("s"),
    )

    def turn(v: Column) -> Column:
        pair = F.struct(F.floor(v["x"] / v["b"]).cast("long").alias("l"), F.pmod(v["x"], v["b"]).alias("r"))

        def step(acc: Column, r: Column) -> Column:
            left = F.pmod(acc["l"] + F.pmod(F.xxhash64(v["s"], r, acc["r"]), v["a"]), v["a"])
            half = F.struct(left.alias("l"), acc["r"].alias("r"))
            return _with(half, lambda h: F.struct(
                h["l"].alias("l"), F.pmod(h["r"] + F.pmod(F.xxhash64(v["s"], r, h["l"], F.lit(1)), v["b"]), v["b"]).alias("r")
            ))

        return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), pair, step, lambda p: p["l"] * v["b"] + p["r"])

    def walk(v: Column, i: Column) -> Column:
        x = F.when((i == 0) | (v["x"] >= v["n"]), turn(v)).otherwise(v["x"])
        return F.struct(x.alias("x"), v["n"].alias("n"), v["a"].alias("a"), v["b"].alias("b"), v["s"].alias("s"))

    unsettled = F.raise_error(F.lit("permutation left its range")).cast("long")
    # most are settled after one turn: the others' turns are an array that is mostly empty
    first = _with(state, lambda v: walk(v, F.lit(0)))
    rest = lambda v: F.aggregate(
        F.when(v["x"] < v["n"], F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(walks))), v, walk,
        lambda w: F.when(w["x"] < w["n"], w["x"]).otherwise(unsettled),
    )
    return _with(first, rest)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _counted(df: DataFrame, n: Column, name: str, total: int, chunk: int = 8192) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``name``.

    Dealt out in chunks over as many partitions as ``total`` rows need: the numbers of one
    row are no single task's work, and a small number of rows isn't taken for a small result.
    """
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))
    chunks = df.withColumn("_n", n.cast("long")).filter("_n > 0").withColumn("_chunk", F.explode(numbers))
    dealt = chunks.repartition(max(1, -(-total // (16 * chunk))), "_i", "_chunk")
    first = F.col("_chunk") * chunk
    last = F.least(first + (chunk - 1), F.col("_n") - 1)
    return dealt.withColumn(name, F.explode(F.sequence(first, last))).drop("_n", "_chunk")


def slots(targets: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """The mix as rows (shard, position, _i, epoch, block): one per output block."""
    blocks = F.ceil(F.col("source_size") / block)
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0)
    sized = targets.select("_i", blocks.alias("_blocks"), quota.cast("long").alias("_quota"))
    earlier = Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    sized = sized.withColumn("_first", F.sum("_quota").over(earlier) - F.col("_quota")).withColumn(
        "_all", F.sum("_quota").over(Window.partitionBy())
    )
    total = targets.agg(F.sum("target")).first()[0] or 0
    rows = _counted(sized, F.col("_quota"), "_r", int(total) // block)
    at = permuted(F.col("_first") + F.col("_r"), F.col("_all"), F.lit(seed), F.lit(-1))
    epoch = F.floor(F.col("_r") / F.col("_blocks"))
    index = permuted(F.col("_r") % F.col("_blocks"), F.col("_blocks"), F.lit(seed), F.col("_i"), epoch)
    return rows.select(
        F.floor(at / shard).alias("shard"), at.alias("position"), "_i", epoch.alias("epoch"), index.alias("_block")
    )


def pieces(placed: DataFrame, block: int) -> DataFrame:
    """Parts of documents by block: ``_from`` and ``_to`` count words of the document."""
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block)
    rows = placed.filter("size > 0").withColumn("_block", F.explode(F.sequence(first, last)))
    return rows.withColumn("_from", F.greatest(F.lit(0), F.col("_block") * block - F.col("_start"))).withColumn(
        "_to", F.least(F.col("size"), (F.col("_block") + 1) * block - F.col("_start"))
    )


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    max_repeats: int = 3,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(documents, mix).

    documents: doc_id, source, size, tie, _i, _start, source_size, target. mix: one row per
    output block and the part of a document in it: shard, position, epoch, doc_id, source,
    tie, size, _i, _start and the words ``_from`` to ``_to`` of the document.
    """
    sized = stored(sizes(docs), "mix-sizes")
    targets = stored(source_targets(sized, weights, max_repeats), "mix-targets")
    named = stored(sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(
        sized["doc_id"], sized["source"], "size", "tie", "_i", "source_size", "target"
    ), "mix-named")
    placed = stored(stream_positions(named, seed), "mix-streams")
    # a merge join: both sides are unfolded from few rows, so their sizes can't be foreseen
    drawn = slots(targets, block, shard, seed).hint("merge").join(pieces(placed, block), ["_i", "_block"])
    return placed, drawn


def taken_words(placed: DataFrame, drawn: DataFrame) -> DataFrame:
    """The documents with ``taken``, the words that the mix takes from each, repeats counted."""
    got = drawn.groupBy("_i", "_start").agg(F.sum(F.col("_to") - F.col("_from")).alias("_taken"))
    return placed.join(got, ["_i", "_start"], "left").withColumn(
        "taken", F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(0).cast("long")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row per document and epoch in which words of it are taken.

    A document taken whole keeps its text; of one taken in part, the words in the mix stay
    in order, joined by blanks. Columns are those of ``docs``; ``n_chars``, if there, is
    the new length.
    """
    _, drawn = plan_mix(docs, **options)
    key = ["doc_id", "source", "tie"]
    spans = drawn.groupBy("_i", "_start", "epoch", *key, "size").agg(
        F.sum(F.col("_to") - F.col("_from")).alias("_n"),
        F.array_sort(F.collect_list(F.struct(F.col("_from").cast("int").alias("f"), F.col("_to").cast("int").alias("t")))).alias("_spans"),
    )
    mix_id, mix_source, mix_tie, own_tie, size, taken, parts = free_names(
        docs, "mix_id", "mix_source", "mix_tie", "own_tie", "mix_size", "mix_taken", "mix_parts"
    )
    full = docs.withColumn(own_tie, F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "source", own_tie])
    renamed = {"doc_id": mix_id, "source": mix_source, "tie": mix_tie, "size": size, "_n": taken, "_spans": parts}
    spans = spans.select(*[F.col(old).alias(new) for old, new in renamed.items()])
    joined = full.join(
        spans,
        full["doc_id"].eqNullSafe(spans[mix_id]) & full["source"].eqNullSafe(spans[mix_source]) & (full[own_tie] == spans[mix_tie]),
    )
    cut = F.array_join(
        F.flatten(F.transform(parts, lambda s: F.slice(words(F.col("text")), s["f"] + 1, s["t"] - s["f"]))), " "
    )
    text = F.when(F.col(taken) == F.col(size), F.col("text")).otherwise(cut)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op5_mix_sources")
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, drawn = plan_mix(table(spark, sf_dir, "documents"))
    return taken_words(placed, drawn).select("doc_id", "size", "source_size", "target", "taken")
