"""WARC archives in Zstandard: one frame a record, behind a skippable frame with the dictionary.

The writer makes archives of bounded size in a shared folder; the first record of a payload is a response, those with the
same payload are revisits that refer to it. The reader takes any such archives, loads each one's dictionary, decodes frame
by frame, and checks headers, lengths and digests.

A null payload is empty. Repeated rows (same id, same payload) are records of their own: one of them is the response, the
others revisit it. Rows without an id are never the response if a row with one has their payload. No rows: no archives,
no records. What is wrong with a record is said in `error`; such records are kept. A payload of any length is one record, larger than an
archive's size if need be. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

#: Fixed values of the formats.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def b32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- one record


def record(rid: str, kind: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    uri = "".join(ch if ch > " " and ch != "\x7f" else f"%{ord(ch):02X}" for ch in url or "urn:x-none")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{b32_sha1(payload)}", f"WARC-Block-Digest: sha1:{b32_sha1(block)}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.decode("latin-1").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in (x.partition(b":") for x in lines)}


def parse(raw: bytes) -> dict:
    """A record's fields; error: what does not hold, else null."""
    out = dict.fromkeys(("record_id", "record_type", "url", "payload_digest", "refers_to", "payload_bytes", "payload", "error"))
    head, sep, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    h = _headers(lines)
    out |= {"record_id": h.get("warc-record-id", "").strip("<>"), "record_type": h.get("warc-type"), "url": h.get("warc-target-uri"), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": h.get("warc-refers-to", "").strip("<>") or None}
    length = h.get("content-length", "")
    if not first.startswith(b"WARC/1.") or not sep:
        return out | {"error": "no WARC header"}
    if missing := [x for x in REQUIRED if not h.get(x)]:
        return out | {"error": f"no {missing[0]}"}
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "the content length is not the block's"}
    block = rest[:-4]
    http, sep, payload = block.partition(b"\r\n\r\n")
    said = _headers(http.split(b"\r\n")[1:]).get("content-length", "")
    if not http.startswith(b"HTTP/1.") or not sep or not said.isdigit():
        return out | {"error": "no HTTP header"}
    out |= {"payload_bytes": int(said), "payload": payload if h["warc-type"] == "response" else None}
    if (b := h.get("warc-block-digest")) and b != f"sha1:{b32_sha1(block)}":
        return out | {"error": "the block digest differs"}
    if h["warc-type"] == "response":
        if len(payload) != int(said):
            return out | {"error": "the payload length differs"}
        if b32_sha1(payload) != out["payload_digest"]:
            return out | {"error": "the payload digest differs"}
    elif h["warc-type"] == "revisit" and (payload or not out["refers_to"]):
        return out | {"error": "a revisit has a payload or no target"}
    return out


# ---------------------------------------------------------------- one archive


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICT_MAGIC, len(packed)) + packed


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends: past its header, blocks and checksum."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise ValueError("no frame")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if at > len(data):
            raise ValueError("a frame is cut off")
        if block & 1:
            return at + 4 * (flags >> 2 & 1)


def records(archive: bytes):
    """Each record of an archive, as parse() has it. A frame that can't be read gives an error; the next frame follows, or, where its end is not known, what next looks like a frame's start."""
    data, at, given = memoryview(archive), 0, None
    if len(data) >= 8 and (head := struct.unpack_from("<II", data))[0] == DICT_MAGIC:
        at = 8 + head[1]
        raw = bytes(data[8:at])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        given = zstandard.ZstdCompressionDict(raw)
    z = zstandard.ZstdDecompressor(dict_data=given) if given else zstandard.ZstdDecompressor()
    while at < len(data):
        end = None
        try:
            end = frame_end(data, at)
            raw = z.decompressobj().decompress(data[at:end])
        except (ValueError, zstandard.ZstdError) as e:
            yield dict.fromkeys(("record_id", "record_type", "url", "payload_digest", "refers_to", "payload_bytes", "payload")) | {"error": str(e)}
            start = struct.pack("<I", FRAME_MAGIC)
            if end is None or end < len(data) and data[end : end + 4] != start:
                end = archive.find(start, at + 4)
                end = len(data) if end < 0 else end
        else:
            yield parse(raw)
        at = end


# ---------------------------------------------------------------- writing and reading with Spark


def train_dictionary(pages: DataFrame, payload_col: str, sample: int = 400, size: int = 16_384, most: int = 32_768) -> bytes:
    """A dictionary from at most `sample` payloads (first `most` bytes each): those with the smallest hash."""
    one_in = max(1, pages.count() // (4 * sample))  # about four times the sample is sorted, not all payloads
    rows = pages.select(F.encode(F.substring(F.col(payload_col), 1, most), "UTF-8").alias("p")).where("length(p) > 0").where(F.pmod(F.xxhash64("p", F.lit(1)), F.lit(one_in)) == 0).orderBy(F.xxhash64("p")).limit(sample).collect()
    parts = [bytes(r["p"]) for r in rows]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on: the payloads themselves serve
        return b"".join(parts)[:size]


def with_record_types(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 0) -> DataFrame:
    """rid, url, payload, kind, refers_to: which pages are responses, and what the others revisit."""
    keyed = pages.select(F.col(id_col).cast("long").alias("rid"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    # a key without nulls, so that join and window share one shuffle of the payloads
    keyed = keyed.withColumn("rk", F.coalesce(F.col("rid").cast("string"), F.lit("")))
    light = keyed.where(F.length("payload") >= least_bytes).select("rid", "rk", "digest")
    first = light.groupBy("digest").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    marks = light.join(first, "digest").groupBy(F.col("rk").alias("rk_m"), F.col("digest").alias("digest_m")).agg(F.first("first").alias("first"))
    joined = keyed.join(marks, (F.col("digest") == F.col("digest_m")) & (F.col("rk") == F.col("rk_m")), "left")
    copy = F.row_number().over(Window.partitionBy("digest", "rk").orderBy("digest", "rk"))
    alone = F.col("digest_m").isNull() | (F.col("rid").eqNullSafe(F.col("first")) & (F.col("copy") == 1))
    return joined.withColumn("copy", copy).select("rid", "copy", "url", "payload", F.when(alone, "response").otherwise("revisit").alias("kind"), F.when(~alone, F.col("first")).alias("refers_to"))


def write_archives(typed: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = 8 << 20, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the rows of with_record_types(); returns the archives: path, records, bytes. Nothing is written before it is run."""

    def run(batches):
        from pyspark import TaskContext

        part, k, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0
        z = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
        head = dictionary_frame(dictionary)

        def out():
            path = f"{folder}/part-{part:06d}-{k:05d}.warc.zst"
            c.write_bytes(path, head, *held)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size + len(head)], pa.int64())], names=["path", "records", "bytes"])

        for b in batches:
            for i in range(b.num_rows):
                rid, copy, url, payload, kind, refers_to = (b.column(j)[i].as_py() for j in range(6))
                name = f"urn:x-page:{rid}" + (f":{copy}" if copy > 1 else "")
                frame = z.compress(record(name, kind, url, payload, f"urn:x-page:{refers_to}" if kind == "revisit" else None, date))
                if held and size + len(frame) > archive_bytes:
                    yield out()
                    k, held, size, n = k + 1, [], 0, 0
                held.append(frame)
                size, n = size + len(frame), n + 1
        if held:
            yield out()

    return typed.mapInArrow(run, "path string, records long, bytes long")


READ = "record_id string, record_type string, url string, payload_digest string, refers_to string, payload_bytes long, payload binary, error string"


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of every *.warc.zst in a folder; READ. payloads: whether to return them too."""
    names = [f.split()[0] for f in READ.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string()]

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for r in records(content.as_py()):
                    size += len(r["payload"] or b"") if payloads else 0
                    rows.append(r if payloads else r | {"payload": None})
                    if size > c.SLICE_BYTES or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array([x[f] for x in rows], k) for f, k in zip(names, kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[f] for x in rows], k) for f, k in zip(names, kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content").mapInArrow(run, READ)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 0) -> DataFrame:
    """Pages to archives in the shared folder, and their records read back; page_id and refers_to are ids again."""
    spark = pages.sparkSession
    folder = c.new_path(spark, "warc")
    store, path = c.filesystem(folder)
    store.create_dir(path, recursive=True)
    dictionary = train_dictionary(pages, payload_col)
    write_archives(with_record_types(pages, id_col, payload_col, url_col, least_bytes), folder, dictionary).agg(F.sum("records")).collect()
    number = lambda name: F.expr(f"try_cast(split({name}, ':')[2] as bigint)")
    return read_archives(spark, folder, payloads=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "error")
