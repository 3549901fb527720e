"""Merkle fixity audit of WARC archives.

Pages become WARC records, records are dealt to archives and to slots of an archive by a hash
of their key and stand there in the order of slots and keys, each with its range of byte
offsets.  Leaves hash a record with its range's length, slots their records in offset order;
inner nodes hash ``fanout`` nodes in order and span their ranges; an archive's root hashes its
last level, and a replica's root the archives'.  Two replicas are compared from their roots
downwards: only children of nodes that differ are looked at, down to the records.  A slot
follows from the key, so a record that is missing opens its own branch and no other.

Archives are written with a gzip member for each record, the format's usual form: behind a
damaged member reading goes on at the next one.  A file is inflated member by member and its
records leave in batches; the compressed file itself is held by one task (2 GB at most, which
is what Spark's binary files hold).

Defined results: null urls and bodies count as empty; pages without an id have the empty
id.  Rows equal in id, url and body are one record with a number of copies, which its leaf
and its range hold.  Other columns are ignored.  An empty table has no archive, and an
empty replica root.  Files that are cut off or damaged are read all the same: a record that
isn't whole has a fault and hashes the bytes that are there, and bytes that can't be inflated
are a row with the fault ``compressed``.  Versions 1.0 and 1.1 are read, and header names of
any case.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: The time in every record's header, so that replicas of the same pages are equal.
DATE = "2024-01-01T00:00:00Z"
#: What follows a record (fixed value of the format).
RECORD_END = "\r\n\r\n"
#: How a record begins (fixed value of the format); damaged files are read on from the next one.
RECORD_BEGIN = re.compile(rb"WARC/1\.[01]\r\n")
#: How a gzip member with deflated bytes begins (fixed value of the format).
MEMBER_BEGIN = b"\x1f\x8b\x08"
#: Bytes of a gzip member before compression at most: the last byte of its size is 0 then.
MEMBER_BYTES = (1 << 24) - 1
#: Records and bytes of a batch that a reader hands on.
BATCH_RECORDS, BATCH_BYTES = 1000, 4 << 20


def header(page_id: Column, url: Column, body: Column) -> Column:
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), page_id, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")
    )


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, record) of each page; page_id as text, record without what follows it."""
    page, link, body = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (page_id, url, html))
    return pages.select(page.alias("page_id"), link.alias("url"), F.concat(header(page, link, body), body).alias("record"))


def archive_of(archives: int) -> Column:
    """The archive of a record: 32 bits of a digest of its key, modulo the number of archives."""
    return _key_digits(1) % archives


def slot_of(slots: int) -> Column:
    """The place of a record among the slots of its archive: 32 other bits of that digest."""
    return _key_digits(9) % slots


def _key_digits(first: int) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("\n", "page_id", "url"), 256), first, 8), 16, 10).cast("long")


@dataclass
class Tree:
    """One replica: levels[0] holds the leaves, levels[1] the slots, levels[-1] one node for each archive, root the replica's hash.

    Each node names its parent among the nodes of the next level.
    """

    levels: list[DataFrame]
    root: str
    fanout: int


def _parents(nodes: DataFrame) -> DataFrame:
    """Nodes over their children: ``fanout`` for each, or a slot's records."""
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    grouped = nodes.groupBy("archive", "parent").agg(children.alias("c"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    return grouped.select("archive", F.col("parent").alias("node"), F.sha2(F.array_join(F.transform("c", lambda x: x["hash"]), ""), 256).alias("hash"), "begin", "end")


def build(pages: DataFrame, archives: int, fanout: int = 8, levels: int = 3, page_id: str = "page_id", url: str = "url", html: str = "html") -> Tree:
    """The tree of the records that pages become.

    Each record is hashed once where it lies; only keys, lengths and digests are shuffled.
    """
    hashed = records(pages, page_id, url, html).select("page_id", "url", F.sha2("record", 256).alias("digest"), (F.octet_length("record") + len(RECORD_END)).cast("long").alias("length"))
    return _tree(hashed.withColumn("archive", archive_of(archives)), fanout, levels)


def build_from_files(spark: SparkSession, path: str, fanout: int = 8, levels: int = 3) -> Tree:
    """The tree of the bytes that stand in written archives, damaged records included."""
    return _tree(read(spark, path, bodies=False).select("page_id", "url", "digest", (F.col("end") - F.col("begin")).alias("length"), "archive"), fanout, levels)


def _tree(hashed: DataFrame, fanout: int, levels: int) -> Tree:
    slots = fanout**levels
    hashed = hashed.groupBy("archive", "page_id", "url", "digest", "length").agg(F.count("*").alias("copies")).withColumn("parent", slot_of(slots))
    order = Window.partitionBy("archive").orderBy("parent", "page_id", "url", "digest")
    size = F.col("length") * F.col("copies")
    end = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    leaf = F.sha2(F.concat_ws(":", "digest", "copies", "length"), 256)
    leaves = hashed.select("archive", "parent", (F.row_number().over(order) - 1).cast("long").alias("node"), leaf.alias("hash"), (end - size).alias("begin"), end.alias("end"), "page_id", "url", "digest", "copies")
    found = [materialise(leaves, "warc-leaves")]
    for _ in range(levels):
        found.append(materialise(_parents(found[-1]).withColumn("parent", F.floor(F.col("node") / fanout)), "warc-nodes"))
    found.append(materialise(_parents(found[-1]), "warc-roots"))
    # the replica's root: over archives, ``fanout`` at a time
    top = found[-1].select(F.lit(0).cast("long").alias("archive"), F.col("archive").alias("node"), "hash", "begin", "end")
    last = found[-1].agg(F.max("archive")).first()[0]
    for _ in range(max(1, math.ceil(math.log(max(2, (last or 0) + 1), fanout)))):
        top = _parents(top.withColumn("parent", F.floor(F.col("node") / fanout)))
    roots = top.collect()  # one row
    return Tree(found, roots[0]["hash"] if roots else "", fanout)


def _compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(archive, parent) for the nodes at which two levels differ, or of which one has none, as parents of the next."""
    b = b.select("archive", "node", F.col("hash").alias("other"))
    differ = a.select("archive", "node", "hash").join(b, ["archive", "node"], "full_outer").where(~F.col("hash").eqNullSafe(F.col("other")))
    return differ.select("archive", F.col("node").alias("parent"))


def descend(a: Tree, b: Tree) -> list[tuple[DataFrame, DataFrame]]:
    """The nodes of both trees that are looked at, level by level from the roots to the records; below nodes that agree there are none."""
    opened = [(a.levels[-1], b.levels[-1])]
    for depth in range(len(a.levels) - 2, -1, -1):
        differ = materialise(_compare(*opened[-1]), "warc-differ")
        opened.append(tuple(t.levels[depth].join(differ, ["archive", "parent"], "left_semi") for t in (a, b)))
    return opened


def damage(a: Tree, b: Tree) -> DataFrame:
    """One row for each record that differs: archive, page_id, url, kind (altered, missing, extra), both ranges.

    begin and end are the offsets in ``a``, other_begin and other_end those in ``b``.
    """
    spark = a.levels[0].sparkSession
    empty = "archive long, page_id string, url string, kind string, begin long, end long, other_begin long, other_end long"
    if a.root == b.root:
        return spark.createDataFrame([], empty)
    below = descend(a, b)[-1]
    # records of the slots that differ, by key
    mine, other = (x.groupBy("archive", "page_id", "url").agg(F.array_sort(F.collect_list(F.struct("digest", "copies"))).alias(f"c{i}"), F.min("begin").alias(f"b{i}"), F.max("end").alias(f"e{i}")) for i, x in enumerate(below))
    kind = F.when(F.col("c1").isNull(), "missing").when(F.col("c0").isNull(), "extra").otherwise("altered")
    return (
        mine.join(other, ["archive", "page_id", "url"], "full_outer")
        .where(~F.col("c0").eqNullSafe(F.col("c1")))
        .select("archive", "page_id", "url", kind.alias("kind"), F.col("b0").alias("begin"), F.col("e0").alias("end"), F.col("b1").alias("other_begin"), F.col("e1").alias("other_end"))
    )


def audit(a: Tree, b: Tree) -> DataFrame:
    """One row for each archive of either replica: its size in ``a``, both roots, whether they match, and the damage.

    damaged: "page_id:kind" of each record that differs, sorted, comma-joined.
    """
    size = a.levels[0].groupBy("archive").agg(F.sum("copies").alias("n_records"), F.max("end").alias("n_bytes"))
    roots = a.levels[-1].select("archive", F.col("hash").alias("root")).join(b.levels[-1].select("archive", F.col("hash").alias("replica_root")), "archive", "full_outer")
    hurt = damage(a, b).groupBy("archive").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "page_id", "kind"))), ",").alias("damaged"))
    return roots.join(size, "archive", "left").join(hurt, "archive", "left").select(
        "archive", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), "root", "replica_root", F.col("root").eqNullSafe(F.col("replica_root")).alias("intact"), F.coalesce("damaged", F.lit("")).alias("damaged")
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as gzip members less their last byte, which the line separator writes."""
    end = RECORD_END.encode()
    for batch in batches:
        values = []
        for record in batch.column(1).cast(pa.large_binary()).to_pylist():
            record += end
            parts = [gzip.compress(record[at : at + MEMBER_BYTES], mtime=0) for at in range(0, len(record), MEMBER_BYTES)]
            values.append(b"".join(parts)[:-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], ["archive", "value"])


def write(pages: DataFrame, path: str, archives: int, compression: str = "gzip", page_id: str = "page_id", url: str = "url", html: str = "html", slots: int = 512) -> None:
    """Write WARC files, one folder for each archive, records in the order of the tree; compression is gzip or none."""
    rows = records(pages, page_id, url, html).withColumn("archive", archive_of(archives)).repartition("archive")
    rows = rows.sortWithinPartitions("archive", slot_of(slots), "page_id", "url", F.sha2("record", 256)).select("archive", F.col("record").alias("value"))
    if compression == "gzip":
        # a member's size is below 16 MB, so its last byte is 0
        packed = small_batches(rows).mapInArrow(_members, "archive long, value binary").select("archive", F.col("value").cast("string").alias("value"))
        packed.write.partitionBy("archive").option("lineSep", "\0").text(path)
    else:
        rows.write.partitionBy("archive").option("lineSep", RECORD_END).text(path)


def inflated(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """The bytes of a file in pieces, each with a fault or None; plain ones in one piece.

    Where a gzip member is damaged, what it still gives is a piece with the fault
    ``compressed``, and reading goes on at the next place where a member begins and inflates.
    """
    if RECORD_BEGIN.match(data) or _next_member(data, 0) < 0:
        yield data, None
        return
    at = 0
    while at < len(data):
        part, out, place = zlib.decompressobj(31), bytearray(), at
        try:
            while not part.eof and place < len(data):
                out += part.decompress(data[place : place + (1 << 16)])
                place += 1 << 16
                if len(out) > BATCH_BYTES and not part.eof:
                    yield bytes(out), None
                    out.clear()
        except zlib.error:
            pass  # not at its end: damaged
        if part.eof:
            yield bytes(out), None
            at = min(place, len(data)) - len(part.unused_data)
            if not data[at : at + 512].strip(b"\0") and not data[at:].strip(b"\0"):
                return  # padding
        else:  # damaged, or cut off
            yield bytes(out), "compressed"
            following = _next_member(data, at + 1)
            at = following if following >= 0 else len(data)


def plain_bytes(data: bytes) -> bytes:
    """All that can be inflated of a file."""
    return b"".join(piece for piece, _ in inflated(data))


def _next_member(data: bytes, at: int) -> int:
    """Where the next gzip member begins, -1 if none does."""
    while (at := data.find(MEMBER_BEGIN, at)) >= 0 and not _begins(data, at):
        at += 1
    return at


def _begins(data: bytes, at: int) -> bool:
    """Whether a gzip member inflates from here, so far as its first bytes tell."""
    try:
        return bool(zlib.decompressobj(31).decompress(data[at : at + 4096])) or len(data) - at <= 32
    except zlib.error:
        return False


def records_of(data: bytes) -> Iterator[tuple[int, int, int, str, str, str | None]]:
    """(begin, start of the body, end, page_id, url, fault) of the records of one piece, whatever state it is in.

    A record with a fault goes up to where the next one begins: ``truncated`` (the piece ends
    inside it), ``length`` (its body isn't as long as it says), ``header`` (none can be read).
    """
    at = 0
    while at < len(data):
        next_one = RECORD_BEGIN.search(data, at + 1)
        following = next_one.start() if next_one else len(data)
        middle = data.find(b"\r\n\r\n", at, following) + 4
        if middle < 4 or not RECORD_BEGIN.match(data, at):
            yield at, following, following, "", "", "header"
            at = following
            continue
        lines = (line.partition(b":")[::2] for line in data[at : middle - 4].split(b"\r\n")[1:])
        fields = {name.strip().lower(): value.strip() for name, value in lines}
        page, url = (fields.get(name, b"").decode(errors="replace") for name in (b"warc-record-id", b"warc-target-uri"))
        if page.startswith("<urn:page:"):
            page = page[len("<urn:page:") :].removesuffix(">")
        size = fields.get(b"content-length", b"")
        stop = middle + int(size) if size.isdigit() else -1
        end = stop + len(RECORD_END)
        if stop >= 0 and data[stop:end] == RECORD_END.encode():
            yield at, middle, end, page, url, None
            at = end
        else:
            yield at, middle, following, page, url, "header" if stop < 0 else "truncated" if end > len(data) else "length"
            at = following


def records_in(pieces: Iterator[tuple[bytes, str | None]]) -> Iterator[tuple[int, int, int, str, str, str | None, bytes]]:
    """``records_of`` over pieces, with each record's bytes; offsets are those in all inflated bytes.

    A record may go on over pieces; whole ones leave as soon as they are there.  What a damaged
    piece cuts off, or can't give at all, has the fault ``compressed``.
    """
    held, base, waits = b"", 0, 0

    def ready(whole: bool, fault: str | None) -> Iterator[tuple]:
        nonlocal held, base, waits
        done = 0
        for begin, middle, end, page, url, found in records_of(held):
            if found and not whole:
                break  # the rest of it may come
            hurt = fault if found and end == len(held) and fault else found
            yield base + begin, base + middle, base + end, page, url, hurt, held[begin:end]
            done = end
        held, base = held[done:], base + done
        waits = 2 * len(held)

    for piece, fault in pieces:
        held += piece
        if fault:
            told = False
            for row in ready(True, fault):
                told = told or row[5] == fault
                yield row
            if not told:  # nothing of a record is left, or no more than the check sum is wrong
                yield base, base, base, "", "", fault, b""
        elif len(held) >= waits:
            yield from ready(False, None)
    yield from ready(True, None)


def read(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """(archive, path, begin, end, page_id, url, digest, fault, html) of the records of WARC files; one file is one task's at most.

    digest: SHA-256 of the record's bytes.  html is null without ``bodies``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
        names = ["path", "begin", "end", "page_id", "url", "digest", "fault", "html"]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for begin, middle, end, page, url, fault, held in records_in(inflated(data)):
                    record = held if fault else held[: -len(RECORD_END)]
                    rows.append((name, begin, end, page, url, hashlib.sha256(record).hexdigest(), fault, record[middle - begin :].decode(errors="replace") if bodies else None))
                    size += len(held)
                    if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,txt.gz,warc,warc.gz}").load(path)
    found = files.select("path", "content").mapInArrow(run, "path string, begin long, end long, page_id string, url string, digest string, fault string, html string")
    return found.select(F.regexp_extract("path", r"archive=(\d+)/", 1).cast("long").alias("archive"), *found.columns)
