"""WARC archives: writing with deduplicated payloads, and reading by boundary-chain verification.

Writing: one record a page, the first page of equal payloads as a response and the others as
revisits of it. Spark's text writer with the record end as its line separator writes the files, so
any file system and its commit protocol serve.

Reading: files are split among tasks at every occurrence of the version line. Each piece is a
candidate record and says where its successor would start. A version line inside a payload makes
false candidates, so a record counts only if it can be reached from the start of its file; pointer
jumping over the offsets alone finds those. Payloads that hold version lines are put together from
their pieces."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelvault.llm.common import shared_folder, stored

VERSION = "WARC/1.1"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Up to so many revisits they are broadcast to the pages; beyond, both are shuffled.
BROADCAST_REVISITS = 200_000
#: Up to so many pieces of records that were split are broadcast to the archives; beyond, both are shuffled.
BROADCAST_PIECES = 200_000

PIECES = "file string, block long, piece int, size long, successor long, page_id long, type string, refers_to long, payload_bytes long, digest string, whole boolean, raw binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text's UTF-8 bytes."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.lower(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, per_file: int = 50_000, version: str = VERSION) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) into WARC files at ``path``.

    Of records with equal payloads of at least ``least_bytes`` the one with the smallest page_id is
    a response and the others are revisits that name it. A null html is an empty payload; a null
    page_id is written as empty and never chosen as the first, so equal payloads that have only
    null ids are all responses; rows that repeat the smallest id are all responses. Control
    characters in a url are dropped. An empty table writes no record."""
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"))
    digests = stored(keyed.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes), "digests")
    firsts = digests.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").drop("copies")
    firsts = stored(firsts, "firsts")  # so that the join is one that Spark can split where a payload is frequent
    revisits = digests.join(firsts, "sha").where("page_id > first OR page_id IS NULL")
    revisits = stored(revisits.groupBy(F.col("page_id").alias("_kv_page"), F.col("sha").alias("_kv_sha")).agg(F.min("first").alias("first")), "revisits")
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    own = F.sha1(F.col("html").cast("binary"))
    rows = keyed.join(revisits, F.col("page_id").eqNullSafe(F.col("_kv_page")) & (own == F.col("_kv_sha")), "left")
    again = F.col("first").isNotNull()
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "html"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    header = F.concat(
        F.lit(f"{version}\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: <urn:x-page:"), name,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x1F\x7F]", ""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("html")),
        F.lit("\r\nX-Payload-Length: "), F.octet_length("html").cast("string"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:x-page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    rows.select(F.concat(header, block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def read_pieces(spark: SparkSession, path: str, raw_of: DataFrame | None = None, version: str = VERSION) -> DataFrame:
    """The candidates of all files at ``path``: one row for what follows each version line.

    Rows are numbered within a block (a split of a file) in their order. With ``raw_of`` (file,
    block, piece) the bytes of those pieces are returned, and of no others."""
    line = f"{version}\r\n"
    source = spark.read.option("lineSep", line).text(path)
    rows = source.select(F.col("value").cast("binary").alias("value"), "_metadata.file_path", "_metadata.file_block_start")
    with_raw = raw_of is not None
    magic, end, http = line.encode(), END.encode(), HTTP.encode()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = re.compile(rb"^([A-Za-z-]+): *(.*?) *\r?$", re.M)
        page = re.compile(rb"<urn:x-page:(-?\d+)>")
        at, number = None, 0
        for batch in batches:
            out = []
            for value, file, start in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                piece, here = value.as_py(), (file.as_py(), start.as_py())
                number = number + 1 if here == at else 0
                at = here
                cut = piece.find(end)
                head = {k.lower(): v for k, v in field.findall(piece[: cut + 2])} if cut >= 0 else {}
                length = head.get(b"content-length", b"")
                successor = None
                whole = False
                if length.isdigit():
                    successor = len(magic) + cut + len(end) + int(length) + len(end)
                    whole = successor == len(magic) + len(piece)
                ids = [page.search(head.get(k, b"")) for k in (b"warc-record-id", b"warc-refers-to")]
                kind = head.get(b"warc-type", b"").decode("latin-1")
                n, digest = None, None
                if kind == "revisit":
                    told = head.get(b"x-payload-length", b"")
                    n = int(told) if told.isdigit() else None
                    digest = head.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
                elif whole:
                    body = piece[cut + len(end) : -len(end)]
                    body = body[len(http) :] if body.startswith(http) else body.partition(end)[2]
                    n, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                out.append((*here, number, len(piece), successor, *[int(m[1]) if m else None for m in ids[:1]], kind, *[int(m[1]) if m else None for m in ids[1:]], n, digest, whole, piece if with_raw else None))
            frame = list(zip(*out, strict=True)) if out else [[]] * 12
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(frame, kinds, strict=True)], names=names)

    pieces = rows.mapInArrow(parse, PIECES)
    return pieces.join(raw_of, ["file", "block", "piece"], "left_semi") if with_raw else pieces


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which of the sorted ``offsets`` the chain of ``successors`` from offset 0 passes, by pointer jumping."""
    n = len(offsets)
    place = np.searchsorted(offsets, successors)
    known = (place < n) & (offsets[np.minimum(place, n - 1)] == successors)
    jump = np.where(known, place, np.arange(n))
    seen = offsets == 0
    while True:  # each round doubles the length of the jumps
        grown = seen.copy()
        grown[jump[seen]] = True
        if (grown == seen).all() and (jump[jump] == jump).all():
            return seen
        seen, jump = grown, jump[jump]


def chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Offsets of one file's pieces from their sizes, and for each the piece its record starts with.

    A file's table has a few numbers for each record, whatever the payloads' sizes."""
    pdf = pdf.sort_values(["block", "piece"], ignore_index=True)
    step = len(VERSION) + 2  # all versions are as long
    sizes = pdf["size"].to_numpy() + step
    offsets = np.cumsum(sizes) - sizes - step  # of the version line before each piece
    claims = pdf["successor"].to_numpy(dtype="float64", na_value=np.nan)
    successors = np.where(np.isnan(claims) | (offsets < 0), -1, offsets + np.nan_to_num(claims)).astype("int64")
    real = reachable(offsets, successors)
    # A broken record claims bytes that the file doesn't have or an end where no record starts.
    last = offsets[-1] + sizes[-1]
    good = real & (np.isin(successors, offsets[real]) | (successors == last))
    record = np.maximum.accumulate(np.where(real, np.arange(len(pdf)), -1))
    head = np.maximum(record, 0)
    return pd.DataFrame({
        "file": pdf["file"], "block": pdf["block"], "piece": pdf["piece"],
        "start": offsets[head], "part": np.arange(len(pdf)) - record, "head": real, "good": good[head] & (record >= 0),
    })


def read_archives(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for each true record of a
    version (``WARC/1.0`` or ``WARC/1.1``). Records with ids of another form have a null page_id.

    Digests and sizes of responses are those of the payload as read; a revisit has those that its
    header states. Records whose successor is not a record nor the file's end are left out, and so
    is all that the chain from the file's start does not reach. Folders without records give an
    empty table."""
    pieces = stored(read_pieces(spark, path, version=version).drop("raw"), "pieces")
    links = "file string, block long, piece int, start long, part long, head boolean, good boolean"
    placed = stored(pieces.select("file", "block", "piece", "size", "successor").groupBy("file").applyInPandas(chain, links), "chain").where("good")
    # The type of whole records is known; the others have more than one piece.
    several = placed.where("part > 0").select("file", "start").distinct()
    records = pieces.join(placed.where("head").select("file", "block", "piece", "start"), ["file", "block", "piece"])
    simple = records.where("whole OR type = 'revisit'")
    columns = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"]
    out = simple.join(several, ["file", "start"], "left_anti").select(*columns)
    parts = placed.join(several, ["file", "start"], "left_semi").select("file", "block", "piece", "start", "part")
    parts = stored(parts, "parts")
    n = parts.count()
    if not n:
        return out
    if n <= BROADCAST_PIECES:
        parts = F.broadcast(parts)
    magic = f"{version}\r\n".encode()

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        body = magic.join(group.sort_values("part")["raw"])
        block = body.partition(END.encode())[2][: -len(END)]
        payload = block.partition(END.encode())[2]
        return pd.DataFrame({"file": group["file"][:1].tolist(), "start": group["start"][:1].tolist(), "n": [len(payload)], "d": [base64.b32encode(hashlib.sha1(payload).digest()).decode()]})

    raw = read_pieces(spark, path, parts.select("file", "block", "piece"), version).select("file", "block", "piece", "raw")
    # A group is the pieces of one record.
    united = raw.join(parts, ["file", "block", "piece"]).groupBy("file", "start").applyInPandas(unite, "file string, start long, n long, d string")
    more = records.join(united, ["file", "start"]).select("page_id", F.when(F.col("type") == "revisit", F.col("payload_bytes")).otherwise(F.col("n")).alias("payload_bytes"), F.when(F.col("type") == "revisit", F.col("digest")).otherwise(F.col("d")).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    return out.unionByName(more)


def op8_warc_chain(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/archives"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path)


ORACLE_OP8 = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first,
    translate(array_to_string(list_transform(range(8), lambda i: to_base(('0x' || substr(h, CAST(1 + 5 * i AS BIGINT), 5))::BIGINT, 32, 4)), ''),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM d
"""
