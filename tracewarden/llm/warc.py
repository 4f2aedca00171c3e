"""WARC archives: written as text records, read back by a verified chain.

Reading.  The archives are split at every line that begins with the magic
``WARC/``: a piece is what lies between two of them.  Each task emits its
pieces' lengths and, where a piece starts with a well-formed header, the offset
at which the record would end.  Prefix sums over the splits
of a file and within a split give absolute offsets.  The candidates are then a
table of links from offset to successor, and pointer jumping from offset 0
finds the records: in each round every link doubles its length and every
record reached marks the one its link leads to.  Magic inside a payload starts
a candidate that nothing leads to, so its piece is joined to the record around
it.

Every step is a Column; a record's payload is only read where it is asked for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.llm.steps import tidy
from tracewarden.session import freeze, shared_dir

MAGIC, VERSION, END = "WARC/", "1.1", "\r\n\r\n"
#: Where archives are split.  No header line can hold it, and no end of it is
#: also its beginning.
CUT = "\n" + MAGIC
_PIECE = ["file", "split", "place"]
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1: 20 bits of the hex at a time."""
    text = F.sha1(data)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(text, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _header_value(text: Column) -> Column:
    """A value that ends no header line: control characters are percent-encoded."""
    out = text
    for code in (*range(0x20), 0x7F):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``payload``, ``payload_bytes``, ``payload_digest`` and
    ``first``, the id of the page that holds the payload (null: this one).

    Only digests that repeat are joined back, and each is one row.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    firsts = (
        rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "first")
    )
    rows = rows.join(freeze(firsts), "payload_digest", "left")
    return rows.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each row of ``pages(page_id, url, html)`` to ``path``.

    The payload is ``html`` in UTF-8 (null: empty) below an HTTP header.  Of
    records with equal payloads of at least ``min_bytes`` the one of smallest
    ``page_id`` is a response and the others are revisits of it, without a
    payload but with its length and digest; rows of the smallest id are all
    responses, and so are rows without id where no other has one.  Control
    characters of a url are percent-encoded; a null url has no header line.
    Each task writes one file through Spark, so failed tasks leave nothing.
    """
    tidy(pages.sparkSession)
    rows = with_roles(pages, min_bytes)
    revisit = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    body = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    rows = rows.withColumn("body", body)
    optional = lambda there, text: F.when(there, text).otherwise(F.lit(""))
    record = F.concat(
        F.lit(f"{MAGIC}{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        optional(F.col("url").isNotNull(), line("WARC-Target-URI", _header_value(F.col("url")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        optional(revisit, line("WARC-Refers-To", name("first"))),
        optional(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"),
        F.col("body"),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with ``start``, the offset of the magic before them, ``stop``,
    the offset at which they end, and ``next``, where their record would."""
    within = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("bytes") + len(CUT)
    splits = pieces.groupBy("file", "split").agg(F.sum(step).alias("all"))
    splits = splits.withColumn("base", F.coalesce(F.sum("all").over(over), F.lit(0))).drop("all")
    rows = pieces.withColumn("before", F.coalesce(F.sum(step).over(within), F.lit(0)))
    at = F.col("base") + F.col("before")
    rows = rows.join(splits, ["file", "split"]).withColumns(
        {"start": at - len(MAGIC) + F.col("lead"), "stop": at + F.col("bytes")}
    )
    length = len(MAGIC) + F.col("head") + F.col("content") + 2 * len(END)
    return rows.withColumn("next", F.col("start") + length).drop("base", "before", "lead", "bytes")


def _reached(links: DataFrame) -> DataFrame:
    """``(file, start)`` of the links' rows that a chain from offset 0 meets."""
    state = freeze(links.select("file", "start", "next", (F.col("start") == 0).alias("met")))
    seen = -1
    while True:
        now = state.filter("met").count()
        if now == seen:
            return state.filter("met").select("file", "start")
        seen = now
        hops = state.select("file", F.col("start").alias("next"), F.col("next").alias("far"))
        led = state.filter("met").select("file", F.col("next").alias("start"), F.lit(True).alias("led"))
        state = freeze(
            state.join(hops, ["file", "next"], "left").join(led, ["file", "start"], "left")
            .select("file", "start", F.col("far").alias("next"), (F.col("met") | F.coalesce("led", F.lit(False))).alias("met"))
        )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(file, record_type, record_id, uri, refers_to, header_digest,
    payload_digest, payload_bytes, payload)`` of each record under ``path``.

    ``payload`` is what follows the HTTP header of a record's block.  A
    revisit's digest and size are those its headers name.  An archive whose
    chain breaks off before its end raises an error when the rows are read; an
    empty file has no records.  Uncompressed archives of any version 1 are
    read.  Runs jobs and writes tables to the shared folder while it is built.
    """
    tidy(spark)
    scan = spark.read.option("lineSep", CUT).text(path)
    split = F.col("_metadata.file_block_start")
    scan = scan.select(
        F.col("_metadata.file_path").alias("file"), split.alias("split"), F.monotonically_increasing_id().alias("place"), "value"
    )
    # A file's first piece still has its magic.
    lead = F.when(F.col("value").startswith(MAGIC), len(MAGIC)).otherwise(0)
    scan = scan.withColumns({"lead": lead, "bytes": F.octet_length("value").cast("long")})
    scan = scan.withColumn("body", F.when(F.col("lead") > 0, F.substring("value", len(MAGIC) + 1, 2**31 - 1)).otherwise(F.col("value")))
    # A payload may begin with the magic, which takes the header's last byte.
    end = F.instr(F.concat("body", F.lit("\n")), END)
    sound = F.col("body").rlike(r"^1\.[01]\r\n") & (end > 0)
    scan = scan.withColumn("header", F.when(sound, F.substring("body", F.lit(1), end - 1)))
    content = F.when(F.col("header").isNotNull(), _field(F.col("header"), "Content-Length").try_cast("long"))
    scan = scan.withColumns({"head": F.octet_length("header").cast("long"), "content": content})
    pieces = freeze(scan.drop("value", "header"), codec="zstd")
    narrow = freeze(_placed(pieces.select("file", "split", "place", "lead", "bytes", "head", "content")))
    met = _reached(narrow.filter("next is not null").select("file", "start", "next"))
    heads = freeze(narrow.join(met, ["file", "start"]))

    # A chain is whole where its records fill the file.
    sizes = narrow.groupBy("file").agg(F.max("stop").alias("size"))
    filled = heads.groupBy("file").agg(F.max("next").alias("until"))
    broken = sizes.join(filled, "file", "left").filter("size > 0 and (until is null or until <> size)").select("file")

    # The only piece of most records; a piece ends before a line's last byte.
    # All pieces but those of other kinds, which are few: magic inside payloads.
    pure = heads.filter("stop + 1 >= next").select(*_PIECE)
    others = freeze(narrow.join(pure, _PIECE, "left_anti").select(*_PIECE))
    one = pieces.join(others, _PIECE, "left_anti").select("file", "content", "head", F.col("body").alias("block"))
    cut = freeze(heads.filter("stop + 1 < next").select("file", F.col("start").alias("offset"), F.col("next").alias("until")))
    records = one if cut.isEmpty() else one.unionByName(_rejoined(pieces, narrow, cut))
    return _parsed(records, freeze(broken))


def _rejoined(pieces: DataFrame, narrow: DataFrame, cut: DataFrame) -> DataFrame:
    """Records in several pieces, put together again from these.

    The range join of pieces with records runs over blocks of the file, so
    that it is an equality on (file, block).
    """
    block = 1 << 20
    spans = cut.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("until") - 1) / block)))
    )
    inside = narrow.select("file", "split", "place", "start", F.floor(F.col("start") / block).alias("block"))
    owned = inside.join(spans, ["file", "block"]).filter("start >= offset and start < until")
    parts = pieces.join(freeze(owned.select(*_PIECE, "start", "offset")), _PIECE)
    # Of later pieces also the magic that a line may have twice.
    again = F.when((F.col("lead") > 0) & (F.col("start") > F.col("offset")), F.lit(MAGIC)).otherwise(F.lit(""))
    parts = parts.withColumn("part", F.struct("start", F.concat(again, "body").alias("text")))
    grouped = parts.groupBy("file", "offset").agg(
        F.array_sort(F.collect_list("part")).alias("parts"),
        F.min_by(F.struct("content", "head"), "start").alias("h"),
    )
    whole = F.array_join(F.transform("parts", lambda p: p["text"]), CUT)
    return grouped.select("file", "h.content", "h.head", whole.alias("block"))


def _field(text: Column, key: str) -> Column:
    return F.regexp_extract(text, rf"(?im)^{key}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)


def _parsed(records: DataFrame, broken: DataFrame) -> DataFrame:
    there = lambda c: F.when(c != "", c)
    cut = lambda start, n: F.substring(F.col("block").cast("binary"), start, n.cast("int"))
    body = cut(F.col("head").cast("int") + len(END) + 1, F.col("content"))
    rows = records.select("file", cut(F.lit(1), F.col("head")).cast("string").alias("header"), body.alias("block"))
    header = F.col("header")
    text = F.col("block").cast("string")
    http = _field(header, "Content-Type").startswith("application/http")
    top = F.when(http, F.substring_index(text, END, 1))
    skip = F.when(http, F.octet_length(top) + len(END)).otherwise(F.lit(0))
    payload = F.substring(F.col("block"), skip.cast("int") + 1, F.octet_length("block"))
    kind = _field(header, "WARC-Type")
    digest = F.regexp_replace(_field(header, "WARC-Payload-Digest"), "(?i)^sha1:", "")
    revisit = kind == "revisit"
    rows = rows.select(
        "file",
        kind.alias("record_type"),
        _field(header, "WARC-Record-ID").alias("record_id"),
        there(_field(header, "WARC-Target-URI")).alias("uri"),
        there(_field(header, "WARC-Refers-To")).alias("refers_to"),
        there(digest).alias("header_digest"),
        F.when(revisit, digest).otherwise(base32_sha1(payload)).alias("payload_digest"),
        F.when(revisit, _field(top, "Content-Length").cast("long")).otherwise(F.octet_length(payload).cast("long")).alias("payload_bytes"),
        payload.alias("payload"),
    )
    # One row per broken archive, which stops the read.
    error = F.raise_error(F.concat(F.lit("the record chain ends early in "), F.col("file")))
    stops = broken.select("file", *[error.cast(rows.schema[c].dataType).alias(c) for c in rows.columns[1:]])
    return rows.unionByName(stops)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archives back, see
    :func:`write_warc` and :func:`read_warc`."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.warc"
    write_warc(pages, path, min_bytes)
    return read_warc(spark, path)
