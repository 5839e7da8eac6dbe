"""WARC archives: written by Spark's text writer, read back in parallel splits.

Reading. A split reader cuts the files at every ``CRLF CRLF WARC/1.`` and so meets each
record boundary, but also each place in a payload that looks like one. Every piece is a
candidate: its header gives a content length, and so the offset where its successor must
begin. Which candidates are records is settled by the chain from the start of the file:
pieces that follow one another without a break form runs, a run points at the successor of
its last piece, and pointer jumping over the runs (doubling the step each round) finds all
that the file start reaches. A candidate inside a payload is never reached, and its bytes
go back into the record that holds it.

Offsets follow from one pass, whose pieces are stored without their payloads under the SHA-1
of their bytes. Payloads come from a second pass by that name, never by a place in a plan, so
splits may be dealt otherwise the second time. A payload whose digest isn't the one in its
header raises an error.

Writing. A record's block is the payload itself. Of pages with equal payloads (by SHA-1) of
at least ``revisit_from`` bytes the smallest page_id is written as response, the others as
revisit records without a block; shorter ones are all responses.

A null html is an empty payload, a null url leaves its header out, a null page_id gives an
empty record id, read back as null. Rows with the same smallest id and payload are all
responses. Line ends in a url become blanks. Empty input: an archive without records, from
which no row is read. A file that doesn't start with a record, or a chain that ends inside
a file, raises an error naming it (``strict=False`` keeps what was reached, and digests that
differ). A payload is one value, so it may have up to 2 GB; a longer content length breaks the chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestlens.llm.common import may_hold, pick, stored, table
from harvestlens.llm.registry import query
from harvestlens.session import shared_folder

# Fixed values of the file format.
VERSION = "WARC/1."
BLANK = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CUT = BLANK + VERSION


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 5 hex digits are 4 base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``record``, the text of each page's record without the blank lines that end it."""
    rows = pick(pages, "page_id", "url", "html").withColumn("_body", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("_digest", base32_sha1(F.col("_body").cast("binary")))
    length = F.octet_length("_body")
    # payloads that occur again, by a hash of the digest: small rows, combined before they
    # are shuffled. Only pages that may have one of them are joined with the first of each
    named = rows.select("page_id", "_digest").groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = stored(named.filter("_n > 1").select("_digest", "_first", F.xxhash64("_digest").alias("_key")), "warc-repeats")
    maybe = may_hold(first, "_key")
    keyed = rows.withColumn("_key", F.xxhash64("_digest")).withColumn("_maybe", maybe)
    known = keyed.filter("_maybe").join(first.select("_digest", "_first"), "_digest", "left")
    once = keyed.filter("NOT _maybe").withColumn("_first", F.lit(None).cast(rows.schema["page_id"].dataType))
    rows = once.unionByName(known)
    again = (length >= revisit_from) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"\r\n{key}: "), value)
    return rows.select(
        F.concat(
            F.lit(VERSION + "1"),
            line("WARC-Type", F.when(again, "revisit").otherwise("response")),
            line("WARC-Record-ID", name(F.col("page_id"))),
            line("WARC-Date", F.lit(date)),
            F.coalesce(line("WARC-Target-URI", F.translate("url", "\r\n", "  ")), F.lit("")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
            F.when(again, F.concat(line("WARC-Refers-To", name(F.col("_first"))), line("WARC-Profile", F.lit(REVISIT)))).otherwise(""),
            line("Content-Type", F.lit("text/html;charset=utf-8")),
            line("Content-Length", F.when(again, F.lit(0)).otherwise(length).cast("string")),
            F.lit(BLANK),
            F.when(again, "").otherwise(F.col("_body")),
        ).alias("record")
    )


def write_warc(pages: DataFrame, path: str, revisit_from: int = 0, records_per_file: int = 20_000) -> None:
    """Write the pages' records below ``path``, uncompressed, so that readers can split the files."""
    out = records(pages, revisit_from).write.option("lineSep", BLANK).option("maxRecordsPerFile", records_per_file)
    out.option("compression", "none").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces between cuts with the split they come from and their order in it."""
    return spark.read.option("lineSep", _CUT).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),  # order inside one pass; not the same in another
        F.unhex(F.sha1(F.col("value").cast("binary"))).alias("name"),
        F.col("value").cast("binary").alias("piece"),
    )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records with ``start``, ``block_start`` and ``successor`` offsets, without payloads.

    ``digest`` is that of the payload if the piece holds it whole.
    """
    text = F.col("piece").cast("string")
    header = F.substring_index(text, BLANK, 1)
    value = lambda key: F.regexp_extract(F.col("header"), rf"(?i)\r\n{key}:[ \t]*([^\r\n]*)", 1)
    parsed = _pieces(spark, path).select(
        "file", "file_size", "split", "id", "name", F.octet_length("piece").alias("n"), header.alias("header"), "piece"
    )
    length = F.regexp_extract("header", r"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*(?:\r\n|$)", 1).try_cast("long")
    valid = F.col("header").rlike(r"^(?:WARC/1\.)?[01]\r\n")
    parsed = parsed.withColumn("skip", F.octet_length("header") + 4).withColumn("content_length", F.when(valid, length))
    narrow = parsed.select(
        "file",
        "file_size",
        "split",
        "id",
        "name",
        "n",
        "skip",
        "content_length",
        value("WARC-Type").alias("type"),
        value("WARC-Record-ID").alias("record_id"),
        value("WARC-Target-URI").alias("uri"),
        value("WARC-Payload-Digest").alias("digest_header"),
        value("WARC-Refers-To").alias("refers_to"),
        F.when(
            F.col("skip") + F.col("content_length") <= F.col("n"),
            base32_sha1(F.expr("substring(piece, cast(skip + 1 AS int), cast(content_length AS int))")),
        ).alias("digest"),
    )
    narrow = stored(narrow, "warc-candidates")
    order = Window.partitionBy("file").orderBy("split", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cut = len(_CUT)
    # a piece follows its cut; the first one of a file has none and still holds the version's start
    placed = narrow.withColumn("at", F.sum(F.col("n") + cut).over(before)).withColumn(
        "start", F.when(F.col("at").isNull(), 0).otherwise(F.col("at") - len(VERSION))
    )
    body = F.coalesce(F.col("at"), F.lit(0)) + F.col("skip")
    return placed.withColumn("block_start", body).withColumn(
        "successor", body + F.col("content_length") + len(BLANK)
    )


def reachable(found: DataFrame) -> DataFrame:
    """``file, start`` of the candidates that the chain from the file's start reaches."""
    order = Window.partitionBy("file").orderBy("start")
    follows = F.lead("start").over(order)
    rows = found.select("file", "start", "successor", follows.alias("next"))
    # a run ends where the successor isn't the next candidate
    broken = F.when(F.col("successor").eqNullSafe(F.col("next")), 0).otherwise(1)
    rows = rows.withColumn("broken", broken).withColumn(
        "run", F.coalesce(F.sum("broken").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    rows = stored(rows.select("file", "start", "successor", "run", "broken"), "warc-runs")
    exits = rows.filter("broken = 1").select("file", "run", F.col("successor").alias("to"))
    # where the exit of a run lands: a candidate of another run, or no candidate at all
    lands = exits.filter("to IS NOT NULL").join(
        rows.select("file", F.col("start").alias("to"), F.col("run").alias("next_run")), ["file", "to"]
    )
    lands = stored(lands.select("file", "run", F.col("next_run").alias("jump"), F.col("to").alias("entry")), "warc-jumps")
    jumps, known = lands.select("file", "run", "jump"), None
    reached = stored(rows.filter("start = 0").select("file", "run"), "warc-reached")
    while True:
        count = reached.count()
        if count == known:
            break
        known = count
        further = reached.join(jumps, ["file", "run"]).select("file", F.col("jump").alias("run"))
        reached = stored(reached.union(further).distinct(), "warc-reached")
        twice = jumps.select("file", "run", F.col("jump").alias("mid")).join(
            jumps.select("file", F.col("run").alias("mid"), "jump"), ["file", "mid"]
        )
        jumps = stored(twice.select("file", "run", "jump"), "warc-jumps")
    # a run is entered at offset 0 or where a reached run lands
    entries = reached.join(lands, ["file", "run"]).select("file", F.col("jump").alias("run"), "entry")
    entries = entries.union(rows.filter("start = 0").select("file", "run", F.col("start").alias("entry")))
    entries = entries.groupBy("file", "run").agg(F.min("entry").alias("entry"))
    return rows.join(entries, ["file", "run"]).filter("start >= entry").select("file", "start")


def read_warc(spark: SparkSession, path: str, payload: bool = True, strict: bool = True) -> DataFrame:
    """Records of all files below ``path``.

    file, start, type, record_id, uri, refers_to, digest_header, content_length, digest
    (bare base32 SHA-1 of the payload as read) and, if asked, payload.
    """
    found = candidates(spark, path)
    chain = stored(reachable(found), "warc-chain")
    marks = found.join(chain.withColumn("real", F.lit(True)), ["file", "start"], "left")
    order = Window.partitionBy("file").orderBy("start")
    owner = F.last(F.when(F.col("real"), F.col("start")), ignorenulls=True).over(order)
    marks = stored(marks.withColumn("owner", owner), "warc-marks")
    names = ["file", "start", "type", "record_id", "uri", "refers_to", "digest_header", "content_length"]
    real = marks.filter("real").withColumn("whole", F.col("skip") + F.col("content_length") <= F.col("n"))
    if strict:
        lost = marks.filter("owner IS NULL").select("file").limit(1).collect()
        last = real.groupBy("file").agg(F.max("successor").alias("s"), F.max("file_size").alias("z"))
        lost = lost or last.filter("s <> z").select("file").limit(1).collect()
        if lost:
            raise ValueError(f"broken chain of records in {lost[0]['file']}")
        wrong = real.filter((F.col("type") == "response") & (F.col("digest_header") != F.concat(F.lit("sha1:"), F.col("digest"))))
        wrong = wrong.filter(F.col("digest_header").startswith("sha1:")).select("file", "start").limit(1).collect()
        if wrong:
            raise ValueError(f"digest of the payload differs at {wrong[0]['start']} in {wrong[0]['file']}")
    split_records = real.filter("NOT whole").select(F.col("file"), F.col("start").alias("owner"))
    parts_of = marks.join(split_records, ["file", "owner"]).select("file", "owner", "name", "start", "skip", "content_length")
    out = [*names, "digest", *(["payload"] if payload else [])]
    # equal pieces are equal bytes, so any of them will do
    bytes_ = _pieces(spark, path).select("name", "piece").dropDuplicates(["name"])
    simple = real.filter("whole")
    if payload:
        simple = simple.join(bytes_, "name").withColumn(
            "payload", F.expr("substring(piece, cast(skip + 1 AS int), cast(content_length AS int))")
        )
    simple = simple.select(*out)
    if split_records.limit(1).count() == 0:
        return simple
    # records that hold cuts: their pieces, in order, with the cuts between them
    gathered = parts_of.join(bytes_, "name").groupBy("file", F.col("owner").alias("start")).agg(
        F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p"), F.max(F.when(F.col("start") == F.col("owner"), F.col("skip"))).alias("skip")
    )
    joint = F.aggregate(
        F.slice("p", 2, F.size("p")), F.col("p")[0]["piece"], lambda acc, x: F.concat(acc, F.lit(_CUT).cast("binary"), x["piece"])
    )
    gathered = gathered.select("file", "start", joint.alias("whole_record"), F.col("skip").alias("gap"))
    rest = real.filter("NOT whole").join(gathered, ["file", "start"]).withColumn(
        "payload", F.expr("substring(whole_record, cast(gap + 1 AS int), cast(content_length AS int))")
    )
    rest = rest.withColumn(
        "digest",
        F.when(F.octet_length("payload") == F.col("content_length"), base32_sha1(F.col("payload"))).otherwise(
            F.raise_error(F.concat(F.lit("record cut short in "), F.col("file"))).cast("string")
        ),
    )
    return simple.union(rest.select(*out))


def page_number(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


@query(
    "op6_warc",
    oracle="""
    WITH h AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
    ), d AS (
        SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr(
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + (('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) % 32, 1)), 'string_agg', '') AS payload_digest
        FROM h
    ), f AS (
        SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest
    )
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM d JOIN f USING (payload_digest)
    """,
)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "archive")
    write_warc(table(spark, sf_dir, "pages"), path)
    read = stored(read_warc(spark, path, payload=False), "warc-records").select(
        page_number(F.col("record_id")).alias("page_id"),
        F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", page_number(F.col("refers_to"))).alias("refers_to"),
        F.col("content_length").alias("own_bytes"),
        F.when(F.col("type") == "revisit", F.regexp_replace("digest_header", "^sha1:", "")).otherwise(F.col("digest")).alias("payload_digest"),
    )
    responses = read.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to")).agg(
        F.max("own_bytes").alias("first_bytes")
    )
    return read.join(responses, "refers_to", "left").select(
        "page_id",
        F.when(F.col("record_type") == "revisit", F.col("first_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )
