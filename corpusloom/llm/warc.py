"""WARC archives in Zstandard: a dictionary in a leading skippable frame, one frame per record."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, staged

#: Fixed values of the formats: skippable frame of a WARC dictionary, Zstandard frame, Zstandard dictionary.
SKIPPABLE_DICT, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: A record may be so long, written or read, unless a caller says otherwise: Spark holds no longer value. A frame that goes on is an error, whatever it says of itself.
RECORD_BYTES = (1 << 31) - 1
#: Digests that can be checked, by the names that records give them.
ALGORITHMS = {"sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "sha512": hashlib.sha512, "sha-512": hashlib.sha512, "md5": hashlib.md5}
#: An archive is closed at so many payload bytes, and so are the samples that train its dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES = 16 << 20, 1 << 20, 16 << 10
LEVEL = 3
#: Records with equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
LINE_BREAKS = {0x0A: "%0A", 0x0D: "%0D"}
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ARCHIVE_SCHEMA = "archive string, content binary"
RECORD_SCHEMA = "archive string, record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, stated_digest string, digest_checked boolean, payload binary, error string"


class ArchiveError(ValueError):
    """A damaged archive or record."""


def record_bytes(record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head only, and its payload's length in a header."""
    kind = "revisit" if refers_to else "response"
    block = HTTP_HEAD if refers_to else HTTP_HEAD + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to:
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(block))))
    # A line break would end the header; anything else in a value is kept.
    text = "".join(f"{k}: {v.translate(LINE_BREAKS)}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + text.encode() + b"\r\n" + block + b"\r\n\r\n"


def trained_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of DICT_BYTES at most; none where the samples are too few or too alike to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8, steps=1).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def archive_bytes(records: list[bytes]) -> bytes:
    """The skippable frame with the (compressed) dictionary, then a frame for each record."""
    samples, room = [], SAMPLE_BYTES
    for r in records:
        if room <= 0:
            break
        samples.append(r[:room])
        room -= len(samples[-1])
    trained = trained_dictionary(samples)
    made, lead = zstandard.ZstdCompressionDict(trained) if trained else None, b""
    if made:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
        lead = struct.pack("<II", SKIPPABLE_DICT, len(packed)) + packed
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=True, write_checksum=True)
    return lead + b"".join(map(compressor.compress, records))


def skippable_end(data: memoryview, at: int) -> int | None:
    """Where a skippable frame that starts at ``at`` ends; None if another frame does."""
    if len(data) - at < 8 or struct.unpack_from("<I", data, at)[0] not in SKIPPABLE:
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        raise ArchiveError(f"cut skippable frame at byte {at}")
    return end


def unpacked_frame(frame: memoryview, reader: zstandard.ZstdDecompressor, most: int = RECORD_BYTES) -> bytes:
    """One frame's content, with or without its size in the header, and never more than ``most`` bytes of it."""
    with reader.stream_reader(frame) as stream:
        parts, size = [], 0
        while part := stream.read(1 << 20):
            parts.append(part)
            size += len(part)
            if size > most:
                raise ArchiveError(f"a record of more than {most} bytes")
    return b"".join(parts)


def number(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise ArchiveError(f"{text[:40]!r} is no length")
    return int(text)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, from its block headers."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ArchiveError(f"no frame at byte {at}")
    try:
        checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
        end = at + zstandard.frame_header_size(data[at : at + 18])
    except zstandard.ZstdError as e:
        raise ArchiveError(f"bad frame header at byte {at}") from e
    last = False
    while not last:
        if end + 3 > len(data):
            raise ArchiveError(f"cut frame at byte {at}")
        head = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        end += 3 + (1 if kind == 1 else size)
    end += 4 * checksum
    if end > len(data):
        raise ArchiveError(f"cut frame at byte {at}")
    return end


def load_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE_DICT:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise ArchiveError("cut dictionary frame")
    raw = bytes(data[8 : 8 + size])
    if raw[:4] == struct.pack("<I", FRAME):
        raw = unpacked_frame(memoryview(raw), zstandard.ZstdDecompressor())
    if raw[:4] != struct.pack("<I", DICTIONARY):
        raise ArchiveError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(raw), 8 + size


def stated_digest(value: str) -> tuple[str, str, bytes | None]:
    """Algorithm, comparable notation and bytes of a digest header: hex in either case or Base32, with or without padding.

    Of an unknown algorithm, or in another notation, the value stays as it is and the bytes are None.
    """
    name, colon, told = value.partition(":")
    name = name.strip().lower()
    if colon and name in ALGORITHMS:
        size, told, name = ALGORITHMS[name]().digest_size, told.strip(), name.replace("-", "")
        if re.fullmatch(f"[0-9A-Fa-f]{{{2 * size}}}", told):
            return name, f"{name}:{told.lower()}", bytes.fromhex(told)
        bare32 = told.rstrip("=").upper()
        try:
            raw = base64.b32decode(bare32 + "=" * (-len(bare32) % 8))
        except binascii.Error:
            raw = b""
        if len(raw) == size:
            return name, f"{name}:{raw.hex()}", raw
    return name, value.strip(), None


def parse_record(raw: bytes) -> dict:
    """Headers, lengths and digest of one record, validated.

    ``stated_digest`` is what the record says, ``algorithm:hex`` where that is known;
    ``digest_checked`` tells whether the payload was held against it. ``payload_digest`` is
    the SHA-256 of the payload, of a revisit the one it states, else null; a revisit's
    ``payload_bytes`` is null unless it states a length.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    # A line that begins with white space goes on with the one before.
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            raise ArchiveError("header line without a name or colon")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "content-length"):
        if name not in fields:
            raise ArchiveError(f"no {name}")
    if len(rest) != number(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ArchiveError("the block is not as long as stated")
    block = rest[:-4]
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    said = fields.get("warc-payload-digest")
    algorithm, stated, told = stated_digest(said) if said else (None, None, None)
    checked = False
    if fields["warc-type"] == "revisit":
        payload, length = b"", number(fields["x-payload-length"]) if "x-payload-length" in fields else None
        digest = told.hex() if told and algorithm == "sha256" else None
    else:
        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if told is not None:
            checked = True
            if told != ALGORITHMS[algorithm](payload).digest():
                raise ArchiveError("the payload does not agree with its digest")
    strip = lambda x: x.removeprefix("<").removesuffix(">") if x else None
    return {"record_id": strip(fields["warc-record-id"]), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "refers_to": strip(fields.get("warc-refers-to")), "payload_bytes": length, "payload_digest": digest, "stated_digest": stated, "digest_checked": checked, "payload": payload, "error": None}


def read_records(content: bytes, most: int = RECORD_BYTES) -> Iterator[dict]:
    """Every record of an archive. A bad record gives a row with ``error``; where frames can't be told apart any more, the rest is one."""
    data = memoryview(content)
    none = dict.fromkeys(("record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "stated_digest", "digest_checked", "payload"))
    try:
        made, at = load_dictionary(data)
    except (ArchiveError, zstandard.ZstdError) as e:
        yield none | {"error": str(e)}
        return
    reader = zstandard.ZstdDecompressor(dict_data=made) if made else zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            if (end := skippable_end(data, at)) is not None:
                at = end
                continue
            end = frame_end(data, at)
        except ArchiveError as e:
            yield none | {"error": str(e)}
            return
        try:
            yield parse_record(unpacked_frame(data[at:end], reader, most))
        except (ArchiveError, zstandard.ZstdError) as e:
            yield none | {"error": f"record at byte {at}: {e}"}
        at = end


def write_archives(records: DataFrame, most: int = RECORD_BYTES) -> DataFrame:
    """(archive, content) from (record_id, uri, payload binary, digest, refers_to).

    A task closes an archive at ARCHIVE_BYTES, so it holds one archive at a time. The
    dictionary is trained on the first SAMPLE_BYTES of the archive's records. Null
    payloads are empty. A record of more than ``most`` bytes ends the job with its name.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending, size, first = [], 0, None

        def closed() -> pd.DataFrame:
            return pd.DataFrame({"archive": [f"{hashlib.sha256(first.encode()).hexdigest()[:16]}.warc.zst"], "content": [archive_bytes(pending)]})

        for batch in batches:
            for rid, uri, payload, digest, refers in batch[["record_id", "uri", "payload", "digest", "refers_to"]].itertuples(index=False):
                first = first or rid
                pending.append(record_bytes(rid, uri or "", payload or b"", digest, refers if isinstance(refers, str) else None))
                if len(pending[-1]) > most:
                    raise ArchiveError(f"{rid} is a record of more than {most} bytes")
                size += len(pending[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    pending, size, first = [], 0, None
        if pending:
            yield closed()

    return records.mapInPandas(write, ARCHIVE_SCHEMA)


def read_archives(archives: DataFrame, payloads: bool = True, most: int = RECORD_BYTES) -> DataFrame:
    """One row per record of (archive, content), such as spark.read.format("binaryFile") gives; ``error`` is null for good ones.

    A record of more than ``most`` bytes is an error row.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for archive, content in zip(batch["archive"], batch["content"], strict=True):
                rows, size = [], 0
                for record in read_records(content or b"", most):
                    size += len(record["payload"] or b"")
                    rows.append(record | {"archive": archive} | ({} if payloads else {"payload": None}))
                    if size > ARCHIVE_BYTES // 2:
                        yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})

    return archives.mapInPandas(read, RECORD_SCHEMA)


def checked_revisits(records: DataFrame) -> DataFrame:
    """``records`` of read_archives; a revisit that no good response bears out gets an ``error``.

    The response named must exist, in whatever archive, with the length and digest that the
    revisit states, as far as it states them; a digest is compared in the notation of the response
    or in SHA-256. A revisit that names no response is borne out by any with its
    digest, and one that states neither is left as it is. Records of one id are told apart
    by what they state, so one of them is enough.
    """
    good = F.col("error").isNull()
    digests = F.array_compact(F.array(F.concat(F.lit("sha256:"), "payload_digest"), F.col("stated_digest")))
    responses = records.filter(good & (F.col("record_type") == "response")).select(F.col("record_id").alias("r_id"), F.col("payload_bytes").alias("r_bytes"), F.explode(F.array_distinct(digests)).alias("r_digest"))
    names = ["refers_to", "payload_bytes", "stated_digest"]
    # Many revisits refer to one response: they meet it by what they state, once for each different statement.
    stated = records.filter(good & (F.col("record_type") == "revisit")).select(*names).distinct()
    long_enough = F.col("payload_bytes").isNull() | (F.col("payload_bytes") == F.col("r_bytes"))
    named = stated.filter("refers_to is not null").join(responses, (F.col("refers_to") == F.col("r_id")) & long_enough & (F.col("stated_digest").isNull() | (F.col("stated_digest") == F.col("r_digest"))), "left_semi")
    alike = responses.select("r_digest", "r_bytes").distinct()
    unnamed = stated.filter("refers_to is null and stated_digest is not null").join(alike, (F.col("stated_digest") == F.col("r_digest")) & long_enough, "left_semi")
    borne = staged(named.unionByName(unnamed), "warc-borne")
    told = stated.filter("refers_to is not null or stated_digest is not null")
    unborne = told.join(borne, [told[c].eqNullSafe(borne[c]) for c in names], "left_anti")
    wrong = staged(unborne.select(*[F.col(c).alias(f"w_{c}") for c in names]), "warc-unborne")
    if wrong.isEmpty():
        return records
    same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in names]
    marked = records.join(wrong.withColumn("w", F.lit(True)), [*same, good, F.col("record_type") == "revisit"], "left")
    error = F.when(F.col("w"), F.lit("no response has the payload of this revisit")).otherwise(F.col("error"))
    return marked.select(*[error.alias(c) if c == "error" else F.col(c) for c in records.columns])


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Records for write_archives: of equal payloads of revisit_bytes or more, all but the smallest id refer to that one.

    Null payloads are empty. Rows that repeat an id together with its payload are all
    responses if that id is the smallest.
    """
    payload = F.encode(F.coalesce(bare(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(bare(id_col).alias("id"), bare(url_col).alias("uri"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long_enough = F.octet_length("payload") >= revisit_bytes
    groups = rows.filter(long_enough).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("g_digest"), "first")
    groups = staged(groups, "warc-groups")
    small = F.broadcast(groups) if groups.count() <= 100_000 else groups
    joined = rows.join(small, (F.col("digest") == F.col("g_digest")) & long_enough, "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return joined.select(F.coalesce(urn(F.col("id")), F.lit("urn:page:")).alias("record_id"), "uri", "payload", "digest", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), urn(F.col("first"))).alias("refers_to"))
