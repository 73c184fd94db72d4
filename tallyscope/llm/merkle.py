"""Fixity audit of archives by Merkle trees over byte ranges.

A record's leaf is the SHA-256 of its bytes. Leaves are hashed, in the order of their offsets, into ranges of 1 MiB of
their file, and 16 neighbouring ranges into one range of the next level, up to a root per file. Two replicas compare their
roots; only below roots that differ are children compared, level by level, and only in ranges that differ are
records. Nodes are keyed by file and offset, so a file of any size is built by many tasks, and a group holds at most
the records of 1 MiB or 16 children. Copies of a record at one place are counted into one leaf first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyscope.session import settle

#: Bits of an offset below the lowest range, and bits that each further level drops.
RANGE_BITS, FAN_BITS = 20, 4


def warc_record(uri: Column, record_id: Column, payload: Column) -> Column:
    """The bytes of a WARC response record; null parts are empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


#: Bytes that a gzip member is given at once.
_FED_BYTES = 1 << 14
_RECORDS = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record", pa.binary())])


def _members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the gzip members of a file, or of its WARC records if it is not compressed."""
    at = 0
    if content[:2] == b"\x1f\x8b":
        view = memoryview(content)
        while at < len(content):
            member, data, fed = zlib.decompressobj(31), [], at
            try:
                # Fed in small pieces, a member leaves little behind its end to be copied.
                while not member.eof and fed < len(content):
                    data.append(member.decompress(view[fed : fed + _FED_BYTES]))
                    fed = min(fed + _FED_BYTES, len(content))
            except zlib.error:
                member = None
            if member is None or not member.eof:
                # Where a member is damaged the next one cannot be found: the rest is one record as it stands.
                yield at, content[at:]
                return
            yield at, b"".join(data)
            at = fed - len(member.unused_data)
        return
    while at < len(content):
        head_end = content.find(b"\r\n\r\n", at)
        length = None
        for line in content[at : max(head_end, at)].split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                length = int(value)
        # A damaged head leaves the rest of the file as one record, which then differs from its replica.
        end = head_end + 4 + length + 4 if head_end >= 0 and length is not None else len(content)
        yield at, content[at:end]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, record`` of the WARC files below ``path``, compressed by record or plain; one task per file."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"file": name, "offset": at, "record": data} for at, data in _members(content)]
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), "content").mapInArrow(split, "file string, offset long, record binary")


def record_hash(record: Column) -> Column:
    """The leaf of one record; a null record counts as empty."""
    return F.sha2(F.coalesce(record.cast("binary"), F.lit(b"")), 256)


def leaves(records: DataFrame, file_col: str = "file", offset_col: str = "offset", record_col: str = "record") -> DataFrame:
    """``file, offset, leaf``: one leaf per place. Records are hashed where they are read; only hashes move.

    Rows without a file or offset, or with a negative offset, have no place and are left out.
    """
    own = records.select(
        F.col(f"`{file_col}`").cast("string").alias("file"),
        F.col(f"`{offset_col}`").cast("long").alias("offset"),
        record_hash(F.col(f"`{record_col}`")).alias("leaf"),
    )
    return merged_leaves(own.filter("file is not null and offset >= 0"))


def merged_leaves(hashed: DataFrame) -> DataFrame:
    """Copies at one place (``file, offset, leaf``) as one leaf from their distinct hashes and the number of each."""
    counted = hashed.groupBy("file", "offset", "leaf").agg(F.count("*").alias("n"))
    placed = counted.groupBy("file", "offset").agg(
        F.sum("n").alias("n"), F.min("leaf").alias("low"), F.array_sort(F.collect_list(F.struct("leaf", "n"))).alias("hashes")
    )
    text = F.array_join(F.transform("hashes", lambda c: F.concat_ws(":", c["leaf"], c["n"])), ",")
    several = F.sha2(F.concat(F.lit("copies:"), text).cast("binary"), 256)
    return placed.select("file", "offset", F.when(F.col("n") == 1, F.col("low")).otherwise(several).alias("leaf"))


def _folded(nodes: DataFrame, bits: int, place: str, value: str) -> DataFrame:
    """The next level: hashes of the children of each parent, in order of their places."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(value).alias("value"))))
    text = F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", c["place"], c["value"])), ",")
    return nodes.groupBy("file", F.expr(f"shiftright({place}, {bits})").alias("node")).agg(
        F.sha2(F.concat(F.lit("node:"), text).cast("binary"), 256).alias("hash")
    )


def trees(leaf_rows: DataFrame, levels: int) -> DataFrame:
    """``level, file, node, hash`` of all levels; level 0 has the ranges of 1 MiB, the last one a root per file."""
    level = settle(_folded(leaf_rows, RANGE_BITS, "offset", "leaf"))
    out = level.withColumn("level", F.lit(0))
    for k in range(1, levels):
        level = settle(_folded(level, FAN_BITS, "node", "hash"))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out


def levels_for(greatest_offset: int) -> int:
    """Levels after which every offset lies in node 0."""
    levels, nodes = 1, greatest_offset >> RANGE_BITS
    while nodes:
        nodes >>= FAN_BITS
        levels += 1
    return levels


def _differing(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    a = left.select(*keys, F.col(value).alias("left_hash"))
    b = right.select(*keys, F.col(value).alias("right_hash"))
    return a.join(b, keys, "full").filter(~F.col("left_hash").eqNullSafe(F.col("right_hash")))


def audit(left: DataFrame, right: DataFrame, **columns: str) -> DataFrame:
    """Places at which two replicas differ: ``file, offset, status, left_hash, right_hash``.

    ``status`` is ``changed``, ``missing`` (only on the left) or ``extra`` (only on the right). Equal replicas, empty
    ones included, give no rows. ``columns`` names the file, offset and record columns of both tables as in ``leaves``.
    """
    return compare(leaves(left, **columns), leaves(right, **columns))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """The audit of two leaf tables."""
    sides = [settle(side) for side in (left, right)]
    greatest = [side.agg(F.max("offset")).first()[0] or 0 for side in sides]
    levels = levels_for(max(greatest))
    built = [trees(side, levels) for side in sides]
    top = [tree.filter(F.col("level") == levels - 1) for tree in built]
    open_nodes = _differing(*top, ["file", "node"], "hash").select("file", "node")
    for level in range(levels - 2, -1, -1):
        parent = F.expr(f"shiftright(node, {FAN_BITS})")
        below = [
            tree.filter(F.col("level") == level).withColumn("parent", parent).join(
                open_nodes.select("file", F.col("node").alias("parent")), ["file", "parent"], "left_semi"
            )
            for tree in built
        ]
        open_nodes = settle(_differing(*below, ["file", "node"], "hash").select("file", "node"))
    ranged = [
        side.withColumn("node", F.expr(f"shiftright(offset, {RANGE_BITS})")).join(open_nodes, ["file", "node"], "left_semi")
        for side in sides
    ]
    status = (
        F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "extra").otherwise("changed")
    )
    return _differing(*ranged, ["file", "offset"], "leaf").select("file", "offset", status.alias("status"), "left_hash", "right_hash")


def laid_out(records: DataFrame, file: Column, order: Column, size: Column) -> DataFrame:
    """The rows with ``file`` and ``offset`` as records of these sizes would lie one after the other in files.

    For files of a bounded number of records: offsets are running sums within a file.
    """
    before = Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("file", file).withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))
