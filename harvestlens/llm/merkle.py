"""Merkle manifest of a table: leaf, subtree and root digests with a proof for every row.

Time-forward processing. Nodes are labelled (level, tree, place), so that every digest is
needed by a node with a later label. A step takes all messages due at the next level from
the queue, computes the nodes that they meet in, and sends these nodes' digests on. The queue
is the stored table of messages; a shuffle by label delivers them, at most ``FAN`` to a node.
A source whose tree is complete leaves its subroot waiting in the queue for the top tree.
The reversed sweep goes from the root down through the same stored nodes: each node gets
the rest of the proof from its parent, puts its own siblings before it, and sends it to its
children, until the rest reaches the runs of leaves. A step's work shrinks by ``FAN`` from
level to level; the driver only learns how many levels there are.

Leaves of a source ascend by doc_id, nulls first, then by digest (rows that share an id; equal
rows are equal leaves). A null source is a source of its own, the first one. A null in any of
the five fields is ``-``; a missing field counts as null, other columns are ignored. A lone
leaf is its source's subroot, a lone subroot the root, and both have an empty rest of the
proof. A null doc_id is never tampered with. Texts count whole, up to the 2 GB of a value.
An empty table has no leaf and no root: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.llm.common import CRC32_OF_ID, CRC32_SQL, pick, stored, table
from harvestlens.llm.registry import query
from harvestlens.operators.ordering import global_positions

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<before: string, after: string>>"


def sized(value: Column) -> Column:
    """A value with its length in front, so that no two lists of values read alike."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, changed: Column | None = None, change=None) -> DataFrame:
    """``doc_id, tree, leaf`` and ``other``: the leaf of the row with ``change(text)`` where ``changed``, else null."""
    rows = pick(docs, *FIELDS)
    plain = [sized(F.col(f)) for f in FIELDS]
    other = F.lit(None).cast("string")
    if changed is not None:
        other = F.when(changed, digest(*plain[:-1], sized(change(F.col("text")))))
    # a name that is never null and sorts like the sources, null first
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return rows.select("doc_id", tree.alias("tree"), digest(*plain).alias("leaf"), other.alias("other"))


def _above(n: Column) -> Column:
    """Nodes on the level above ``n`` nodes."""
    return F.floor((n + (FAN - 1)) / FAN).cast("long")


def _height(most: int) -> int:
    """Levels of runs above ``most`` leaves."""
    levels = 0
    while most > 1:
        most, levels = -(-most // FAN), levels + 1
    return levels


def sweep_up(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every level, and the last node of each tree.

    ``nodes`` are the messages due first: ``tree, at`` (place from 0), ``n`` (nodes of the tree
    on the level), ``digest``. A level's runs are ``tree, at, n`` (of the level) and ``kids``.
    """
    runs, waiting = [], nodes.filter("n = 1").select("tree", "digest")
    due = nodes.filter("n > 1")
    for level in range(levels):
        kids = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        met = due.groupBy("tree", F.floor(F.col("at") / FAN).cast("long").alias("run")).agg(kids.alias("kids"), F.max("n").alias("n"))
        met = stored(met.select("tree", F.col("run").alias("at"), "n", "kids"), f"merkle-level-{level}")
        runs.append(met)
        sent = met.select("tree", "at", _above(F.col("n")).alias("n"), digest(F.array_join("kids", "")).alias("digest"))
        waiting = waiting.union(sent.filter("n = 1").select("tree", "digest"))
        due = sent.filter("n > 1")
    return runs, waiting


def _siblings(place: Column) -> Column:
    """The proof step of the kid at ``place``: the digests left and right of it."""
    before = F.array_join(F.slice("kids", F.lit(1), place), "")
    after = F.array_join(F.slice("kids", place + 2, F.lit(FAN)), "")
    return F.struct(before.alias("before"), after.alias("after"))


def sweep_down(runs: list[DataFrame], rest: DataFrame, facts: list[str]) -> DataFrame:
    """``tree, run, kids, steps`` of each run of the lowest level: its kids and the proof above it.

    ``rest`` has ``tree, height, steps`` and ``facts`` for the top of each tree; a tree of one
    node has no run and passes its steps on, without kids. A proof stays with its run of up
    to ``FAN`` nodes: it isn't copied to each before rows of that size have to move.
    """
    carried = [F.col(f) for f in facts]
    lone = rest.filter("height = 0").select("tree", F.lit(0).cast("long").alias("run"), F.lit(None).cast("array<string>").alias("kids"), "steps", *carried)
    message = None
    for level in range(len(runs) - 1, -1, -1):
        entering = rest.filter(F.col("height") == level + 1).select("tree", F.lit(0).cast("long").alias("at"), "steps", *carried)
        message = entering if message is None else message.union(entering)
        met = runs[level].join(message, ["tree", "at"])
        if not level:
            return met.select("tree", F.col("at").alias("run"), "kids", "steps", *carried).union(lone)
        kid = met.select("tree", "at", "steps", *carried, "kids", F.explode(F.sequence(F.lit(0), F.size("kids") - 1)).alias("place"))
        message = kid.select("tree", (F.col("at") * FAN + F.col("place")).alias("at"), _proof(F.col("place")).alias("steps"), *carried)
        message = stored(message, f"merkle-rest-{level}")
    return lone


def _proof(place: Column) -> Column:
    """The steps of the kid at ``place``: its siblings, then those of the run."""
    return F.when(F.col("kids").isNull(), F.col("steps")).otherwise(F.concat(F.array(_siblings(place)), F.col("steps"))).cast(_STEP)


def _delivered(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """The nodes of the lowest level with their ``steps`` and the facts of their run."""
    named = nodes.withColumn("run", F.floor(F.col("at") / FAN).cast("long"))
    met = named.join(runs, ["tree", "run"])
    return met.withColumn("steps", _proof((F.col("at") % FAN).cast("int"))).drop("run", "kids")


def manifest(docs: DataFrame, changed: Column | None = None, change=None) -> DataFrame:
    """``doc_id, source_tree, leaf, other, subroot, root, steps`` of every row.

    ``steps`` is the proof: pairs of the digests left and right of the path, leaf to root.
    """
    every = stored(leaves(docs, changed, change), "merkle-leaves")
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    placed = global_positions(every, ["tree"], order, "at", total="n").withColumn("at", F.col("at") - 1)
    placed = stored(placed, "merkle-placed")
    levels = _height(placed.agg(F.max("n")).first()[0] or 0)
    runs, waiting = sweep_up(placed.select("tree", "at", "n", F.col("leaf").alias("digest")), levels)
    subroots = stored(waiting, "merkle-subroots")
    # the top tree: its leaves are the subroots in the order of their sources
    ranked = global_positions(subroots, [], [F.col("tree")], "at", total="n")
    ranked = stored(ranked.withColumn("at", F.col("at") - 1), "merkle-sources")
    heights = _height(ranked.agg(F.max("n")).first()[0] or 0)
    top = ranked.select(F.lit("").alias("tree"), "at", "n", "digest")
    top_runs, root = sweep_up(top, heights)
    start = root.select("tree", F.lit(heights).alias("height"), F.array().cast(_STEP).alias("steps"), F.col("digest").alias("root"))
    down = _delivered(top, sweep_down(top_runs, start, ["root"])).select("at", "steps", "root")
    height = F.lit(0)
    for i in range(1, levels + 1):
        height = F.when(F.col("rows") > FAN ** (i - 1), i).otherwise(height)
    sizes = placed.filter("at = 0").select("tree", F.col("n").alias("rows"))
    rest = ranked.select("tree", "at", F.col("digest").alias("subroot")).join(down, "at").join(sizes, "tree")
    rest = stored(rest.select("tree", height.alias("height"), "steps", "subroot", "root"), "merkle-rest")
    found = _delivered(placed.drop("n"), sweep_down(runs, rest, ["subroot", "root"]))
    return found.select("doc_id", F.col("tree").alias("source_tree"), "leaf", "other", "subroot", "root", "steps")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(s["before"], acc, s["after"]))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _oracle(levels: int = 7, top_levels: int = 4) -> str:
    """SQL for up to ``FAN ** levels`` rows a source and ``FAN ** top_levels`` sources."""
    sized_ = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    first = " || ".join(sized_(c) for c in FIELDS[:-1])
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, depth: int) -> str:
        parts = []
        for k in range(depth):
            run = f"PARTITION BY source, i // {FAN} ORDER BY i ROWS BETWEEN"
            parts.append(f"""{name}s{k} AS (SELECT source, i, n,
                coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k})""")
            parts.append(f"""{name}{k + 1} AS (
                SELECT source, i // {FAN} AS i, any_value((n + {FAN - 1}) // {FAN}) AS n, sha256(string_agg(d, '' ORDER BY i)) AS d
                FROM {name}{k} WHERE n > 1 GROUP BY source, i // {FAN}
                UNION ALL SELECT source, i, n, d FROM {name}{k} WHERE n = 1)""")
        return ", ".join(parts)

    def path(name: str, depth: int, at: str, key: str) -> tuple[str, str]:
        proof = " || ".join(f"{name}s{k}.before || {name}s{k}.after" for k in range(depth))
        on = lambda s, k: f"{s}.source IS NOT DISTINCT FROM {key} AND {s}.i = {at} // {FAN**k}"
        return proof, " ".join(f"JOIN {name}s{k} ON {on(f'{name}s{k}', k)}" for k in range(depth))

    low_proof, low_joins = path("l", levels, "l0.i", "l0.source")
    top_proof, top_joins = path("t", top_levels, "t0.i", "''")
    folds, before = [], "p"
    for k in range(levels + top_levels):
        s = f"ls{k}" if k < levels else f"ts{k - levels}"
        folds.append(f"f{k} AS (SELECT * REPLACE (CASE WHEN {s}_n > 1 THEN sha256({s}_before || x || {s}_after) ELSE x END AS x) FROM {before})")
        before = f"f{k}"
    low_columns = ", ".join(f"ls{k}.n AS ls{k}_n, ls{k}.before AS ls{k}_before, ls{k}.after AS ls{k}_after" for k in range(levels))
    top_columns = ", ".join(f"ts{k}.n AS ts{k}_n, ts{k}.before AS ts{k}_before, ts{k}.after AS ts{k}_after" for k in range(top_levels))
    return f"""
    WITH RECURSIVE {CRC32_SQL}, h AS (
        SELECT doc_id, source, sha256({first} || {sized_("text")}) AS leaf,
            CASE WHEN {CRC32_OF_ID} % 5 = 0 THEN sha256({first} || {sized_(lower)}) END AS other
        FROM documents, crc_table
    ), l0 AS (
        SELECT source, doc_id, leaf AS d, coalesce(other, leaf) AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
            count(*) OVER (PARTITION BY source) AS n FROM h
    ), {tree("l", levels)}, t0 AS (
        SELECT '' AS source, source AS of_source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM l{levels}
    ), {tree("t", top_levels)}, top AS (
        SELECT t0.of_source, t0.d AS subroot, (SELECT d FROM t{top_levels}) AS root, {top_proof} AS top_proof, {top_columns}
        FROM t0 {top_joins}
    ), p AS (
        SELECT l0.doc_id, l0.d AS leaf, top.subroot, top.root, sha256({low_proof} || top_proof) AS proof_sha256, l0.x, {low_columns},
            top.* EXCLUDE (of_source, subroot, root, top_proof)
        FROM l0 {low_joins} JOIN top ON top.of_source IS NOT DISTINCT FROM l0.source
    ), {", ".join(folds)}
    SELECT doc_id, leaf, subroot, root, proof_sha256, x AS folded_root, x = root AS verified FROM {before}
    """


@query("op13_merkle_manifest", oracle=_oracle())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = manifest(docs, changed, lambda text: F.translate(text, upper, lower))
    folded = fold(F.coalesce("other", "leaf"), F.col("steps"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
