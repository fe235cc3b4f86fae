"""Merkle fixity audit of replicas of WARC files.

Pages are written as WARC/1.1 resource records, each its own gzip member, in order of page_id and content, to files of about FILE_BYTES of
records through Spark's text sink, so any file system will do and a lost attempt is never seen.  A replica is a folder of such files.  Reading one
walks each file member by member; where a member does not hold a record, what goes up to the next one that does counts as one damaged record.

A leaf hashes a record's place (offset, length) and its stored bytes; an inner node hashes the offset range and the hashes of up to FANOUT
children in order; the top of a file is a child in the tree over files.  Two replicas are compared from the root, and
each level reads only the children of nodes that differ.  Records under leaves that differ are aligned within their file, by
record id and content, then by id, then by place, so that a record that is missing in the middle does not make those after it corrupt.

Defined cases: null url or html count as empty, line breaks in a url are percent-encoded; null page_ids come first and are spread over files like
others; repeated rows are records of their own; a file that one replica lacks has all its records missing or added; empty
tables have no root and give no row; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acctframe.llm import _io

FILE_BYTES, FANOUT = 16 << 20, 16
ARCHIVE = -(1 << 62)
BEGIN, END = b"WARC/1.1\r\n", b"\r\n\r\n"
MEMBER, GZIP = b"\x1f\x8b\x08", 31
#: The query's second replica has the middle byte of each stored record with page_id % DAMAGE == DAMAGE_AT changed.
DAMAGE, DAMAGE_AT = 50, 7


def records(pages: DataFrame) -> DataFrame:
    """page_id and record: the bytes of each page's WARC record."""
    url = F.replace(F.replace(F.coalesce(F.col("url").cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    html, page_id = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("page_id").cast("long")
    name = F.concat(F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource"), name, F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(page_id.alias("page_id"), F.encode(F.concat(head, html, F.lit("\r\n\r\n")), "UTF-8").alias("record"))


def member(record: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, GZIP)
    return z.compress(record) + z.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their record, the second column, as a gzip member."""
    for batch in batches:
        packed = pa.array([member(r.as_buffer()) for r in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed, *batch.columns[2:]], names=batch.schema.names)


def _join(batches: Iterator[pa.RecordBatch], replicas: list[str]) -> Iterator[pa.RecordBatch]:
    """The content of a file, for each replica; a record with a true value in a replica's column is stored with its middle byte changed."""
    files: dict[str, list[bytes]] = {r: [] for r in replicas}
    for batch in batches:
        stored = batch.column(0).to_pylist()
        for k, r in enumerate(replicas):
            files[r] += [m[: len(m) // 2] + bytes([m[len(m) // 2] ^ 0xFF]) + m[len(m) // 2 + 1 :] if harm else m for m, harm in zip(stored, batch.column(k + 1).to_pylist(), strict=True)]
    if any(files.values()):
        yield pa.record_batch({"content": pa.array([b"".join(f) for f in files.values()], pa.binary()), "replica": pa.array(list(files), pa.string())})


def write_replicas(recs: DataFrame, out: str, replicas: dict[str, object]) -> dict[str, str]:
    """Writes records (page_id, record) as the same WARC files once for each replica, and gives the replicas' folders.

    replicas: name, and a condition for the records that are to be stored damaged there (or None), as a fixity drill wants them."""
    total = recs.agg(F.coalesce(F.sum(F.octet_length("record")), F.lit(0))).first()[0]
    order = [F.col("page_id").asc_nulls_first(), "sha", "row"]  # the row's place parts equal rows over files
    harm = {f"harm{k}": F.lit(False) if c is None else F.coalesce(c, F.lit(False)) for k, c in enumerate(replicas.values())}
    rows = recs.select("page_id", "record", F.sha2("record", 256).alias("sha"), *[c.alias(n) for n, c in harm.items()])
    rows = rows.mapInArrow(_members, "page_id long, record binary, sha string, " + ", ".join(f"{n} boolean" for n in harm)).withColumn("row", F.monotonically_increasing_id())
    files = rows.repartitionByRange(max(1, -(-total // FILE_BYTES)), *order).sortWithinPartitions(*order).select("record", *harm).mapInArrow(partial(_join, replicas=list(replicas)), "content binary, replica string")
    files.select(F.col("content").cast("string").alias("value"), "replica").write.partitionBy("replica").option("lineSep", "\n").option("compression", "none").text(out)
    return {r: f"{out}/replica={r}" for r in replicas}


_LENGTH, _PAGE = re.compile(rb"\r\nContent-Length: (\d+)\r\n"), re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d+|none)>\r\n")
CHUNK = 1 << 14


def _member_at(content: memoryview, at: int, size: int) -> tuple[int, bytes] | None:
    """(where the member ends, what it holds), or None if there is no whole one here."""
    z, out, place = zlib.decompressobj(GZIP), [], at
    try:
        while not z.eof and place < size:
            out.append(z.decompress(content[place : min(place + CHUNK, size)]))
            place = min(place + CHUNK, size)
    except zlib.error:
        return None
    return (place - len(z.unused_data), b"".join(out)) if z.eof else None


def _record_id(record: bytes) -> bytes | None:
    """The id of a record, or None where the bytes are none."""
    head = record.find(END) if record.startswith(BEGIN) else -1
    length, page = (p.search(record, 0, head + 2) for p in (_LENGTH, _PAGE)) if head >= 0 else (None, None)
    return page[1] if length and page and len(record) == head + 2 * len(END) + int(length[1]) and record.endswith(END) else None


def _starts(content: memoryview, at: int, size: int) -> bool:
    try:
        return zlib.decompressobj(GZIP).decompress(content[at : min(at + 512, size)], len(BEGIN)) == BEGIN
    except zlib.error:
        return False


def walk(content: bytes) -> Iterator[tuple[int, int, bytes | None, bytes | None]]:
    """(offset, length, record id, record) of what a file stores; the last two are None where it is damaged."""
    size, at, view = len(content) - content.endswith(b"\n"), 0, memoryview(content)  # the sink's line end
    while at < size:
        found = _member_at(view, at, size)
        name = _record_id(found[1]) if found else None
        if name is not None:
            yield at, found[0] - at, name, found[1]
            at = found[0]
            continue
        end = content.find(MEMBER, at + 1, size)
        while end >= 0 and not _starts(view, end, size):
            end = content.find(MEMBER, end + 1, size)
        end = size if end < 0 else end
        yield at, end - at, None, None
        at = end


LEAVES = "file_id long, idx long, offset long, length long, record_id string, content string, size long, record_sha256 string"


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            file, rows = int(re.search(r"part-(\d+)", path)[1]), []
            for i, (at, n, name, record) in enumerate(walk(content)):
                whole = (None, None, None) if name is None else (name.decode(), len(record), hashlib.sha256(record).hexdigest())
                rows.append((file, i, at, n, whole[0], hashlib.sha256(memoryview(content)[at : at + n]).hexdigest(), *whole[1:]))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in LEAVES.split(", ")])


def read_replica(spark: SparkSession, path: str) -> DataFrame:
    """The leaves of a replica's files: place, record id and content hash of each record, and the leaf's hash; written once."""
    if not _io.exists(spark, path):  # no record was written
        return spark.createDataFrame([], f"{LEAVES}, hash string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    leaf = files.mapInArrow(_leaves, LEAVES)
    return _io.stored(leaf.withColumn("hash", F.sha2(F.concat_ws("|", F.lit("record"), "offset", "length", "content").cast("binary"), 256)), "warc-leaves")


def levels(leaf: DataFrame, in_file: int, over_files: int) -> list[DataFrame]:
    """Nodes from the records to the root: file_id, idx, offset, length, hash and the parent's key (up_file, up_idx).

    Nodes over files have ARCHIVE as their file_id, and idx counts files, then groups of files.
    """
    out, now = [], leaf.select("file_id", "idx", "offset", "length", "hash")
    for k in range(in_file + over_files + 1):
        root, top = k == in_file + over_files, k == in_file
        place = F.col("file_id") if top else F.col("idx")
        up_file = F.col("file_id") if k < in_file else F.lit(ARCHIVE)
        up_idx = F.lit(0) if k == in_file + over_files - 1 else F.floor(place / FANOUT)
        now = now.withColumn("place", place).withColumn("up_file", up_file.cast("long")).withColumn("up_idx", up_idx.cast("long"))
        out.append(_io.stored(now, "merkle") if k else now)
        if not root:
            kids = F.array_sort(F.collect_list(F.struct("place", "hash")))  # FANOUT of them at most
            up = out[-1].groupBy("up_file", "up_idx").agg(kids.alias("kids"), F.min("offset").alias("offset"), F.sum("length").alias("length"))
            now = up.select(F.col("up_file").alias("file_id"), F.col("up_idx").alias("idx"), "offset", "length", F.sha2(F.concat_ws("|", F.lit("node"), "offset", "length", F.array_join("kids.hash", "")).cast("binary"), 256).alias("hash"))
    return out


def height(count: int) -> int:
    """Levels of FANOUT children that join `count` nodes in one."""
    n = 1
    while FANOUT**n < count:
        n += 1
    return n


def differing_leaves(first: DataFrame, second: DataFrame) -> DataFrame:
    """Keys (file_id, idx) of the leaves that differ or that one replica lacks, found from the root down."""
    spans = [x.agg(F.max("idx"), F.max("file_id")).first() for x in (first, second)]
    in_file, over_files = (height(1 + max(s[i] or 0 for s in spans)) for i in (0, 1))
    trees, suspects = [levels(first, in_file, over_files), levels(second, in_file, over_files)], None
    for left, right in zip(*(reversed(t) for t in trees), strict=True):
        if suspects is not None:
            above = suspects.select(F.col("file_id").alias("up_file"), F.col("idx").alias("up_idx"))
            left, right = (x.join(above, ["up_file", "up_idx"], "left_semi") for x in (left, right))
        key = ["file_id", "idx"]
        both = left.select(*key, F.col("hash").alias("h1")).join(right.select(*key, F.col("hash").alias("h2")), key, "full_outer")
        new = _io.stored(both.where(~F.col("h1").eqNullSafe(F.col("h2"))).select(*key), "suspects")
        if suspects is not None:
            _io.drop_stored(suspects)
        suspects = new
    for x in (n for t in trees for n in t[1:]):
        _io.drop_stored(x)
    return suspects


def _paired(left: DataFrame, right: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, rest of left, rest of right): the n-th rows of both sides with the same values, which are not null, go together."""
    w = Window.partitionBy("file_id", *by).orderBy("idx")  # within a file, which is of bounded size
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])
    numbered = [x.withColumn("nth", F.when(whole, F.row_number().over(w))) for x in (left, right)]
    key = ["file_id", *by, "nth"]
    pairs = numbered[0].join(numbered[1].select(*key, F.col("idx").alias("idx2")), key)
    rest = [a.join(b.where("nth is not null").select(*key), key, "left_anti").drop("nth") for a, b in (numbered, numbered[::-1])]
    return pairs.drop("nth"), *rest


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """file_id, idx, offset, length (as stored), record_id, content and state ('corrupt', 'missing' or 'added' in second) of records that are not the
    same in two replicas' leaves; of added ones the place is that in second."""
    suspects = differing_leaves(first, second)
    left, right = (_io.stored(x.drop("hash").join(suspects, ["file_id", "idx"], "left_semi"), "suspects") for x in (first, second))
    _, left, right = _paired(left, right, ["record_id", "content"])
    left, right = _io.stored(left, "suspects"), _io.stored(right, "suspects")
    same_id, left, right = _paired(left, right, ["record_id"])
    same_place, left, right = _paired(left, right, ["offset", "length"])
    columns = ["file_id", "idx", "offset", "length", "record_id", "content"]
    parts = [(same_id, "corrupt"), (same_place, "corrupt"), (left, "missing"), (right, "added")]
    return reduce(DataFrame.unionByName, [x.select(*columns).withColumn("state", F.lit(s)) for x, s in parts])


def in_one_line(leaf: DataFrame) -> DataFrame:
    """Leaves with record_index and start: a record's number and place among all records, unpacked, one after the other.  One row a file
    meets in the window over files."""
    files = leaf.groupBy("file_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    w, mine = (x.rowsBetween(Window.unboundedPreceding, -1) for x in (Window.orderBy("file_id"), Window.partitionBy("file_id").orderBy("idx")))
    base = files.select("file_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_before"), F.coalesce(F.sum("bytes").over(w), F.lit(0)).alias("before"))
    inside = leaf.withColumn("inside", F.coalesce(F.sum("size").over(mine), F.lit(0)))
    return inside.join(base, "file_id").withColumn("record_index", F.col("n_before") + F.col("idx")).withColumn("start", F.col("before") + F.col("inside"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes and reads two replicas, in the second of which one stored record in DAMAGE has a byte changed, and audits them; one row a page."""
    path = _io.new_path(spark, "warc")
    folders = write_replicas(records(_io.table(spark, sf_dir, "pages")), path, {"first": None, "second": F.col("page_id") % DAMAGE == DAMAGE_AT})
    _io.release(spark)
    leaves = [read_replica(spark, f) for f in folders.values()]
    _io.delete_path(spark, path)
    found = audit(*leaves)
    state = in_one_line(leaves[0]).join(found.select("file_id", "idx", "state").where("state <> 'added'"), ["file_id", "idx"], "left")
    page = F.when(F.col("record_id") != "none", F.col("record_id").cast("long"))
    return state.select(page.alias("page_id"), "record_index", F.col("start").alias("offset"), F.col("size").alias("length"), "record_sha256", F.coalesce("state", F.lit("ok")).alias("state"))


SQL = f"""
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') || '>'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM pages),
l AS (SELECT page_id, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS record_sha256 FROM r)
SELECT page_id, CAST(row_number() OVER w - 1 AS BIGINT) AS record_index,
  CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length, record_sha256,
  CASE WHEN page_id % {DAMAGE} = {DAMAGE_AT} THEN 'corrupt' ELSE 'ok' END AS state
FROM l WINDOW w AS (ORDER BY page_id NULLS FIRST, record_sha256)
"""
