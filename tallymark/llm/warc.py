"""WARC archives: written with an index, read back by coalesced byte ranges of the index.

Every record is a gzip member of its own, so its offset and length are enough to read it alone. The
index has a row per record: file, offset, length, URL, digest and kind. A reader sorts the wanted rows
by place, joins ranges that lie near each other into one read, and cuts the records out of it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import map_columns, stored
from tallymark.sources.scratch import scratch_folder

#: Payloads of fewer bytes are always stored whole.
LEAST_REVISIT = 1000
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: Wanted records at most so far apart are read together, in reads of at most so many bytes.
GAP_BYTES, READ_BYTES = 1 << 16, 8 << 20
#: Bytes of an archive that lie in one block; about as much is read by a task, up to so many tasks.
BLOCK_BYTES, READ_TASKS = 32 << 20, 20_000
#: Payloads that occur more than once are sent to all tasks up to so many bytes of table.
BROADCAST_BYTES = 16 << 20
#: Parts into which the pages of a payload are dealt where they are not.
SALTS = 64

INDEX = (
    "page_id bigint, url string, digest string, payload_bytes bigint, record_type string, "
    "file string, offset bigint, length bigint"
)
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\U0010ffff]")


def _safe_url(url: str | None) -> str:
    """A URL that fits a header line; a missing one has the name of an unknown resource."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url or "") or "urn:unknown"


def _record_id(page_id: int | None, url: str | None, sha1: bytes) -> str:
    identity = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{_safe_url(url)}/{sha1.hex()}")
    return f"<urn:uuid:{identity}>"


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None,
    refers_url: str | None = None,
) -> bytes:
    """One record as a gzip member: a response, or a revisit without the payload.

    A revisit names the record of page ``refers_to`` at ``refers_url`` that holds the payload.
    """
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (b"" if revisit else payload)
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page_id, url, sha1),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": _safe_url(url),
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = _record_id(refers_to, refers_url, sha1)
        fields["WARC-Refers-To-Target-URI"] = _safe_url(refers_url)
        fields["X-Refers-To-Page-Id"] = str(refers_to)
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, with those of the HTTP part as http:name, and the payload held in the record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    for line in http.decode().split("\r\n")[1:]:
        name, value = line.split(": ", 1)
        fields[f"http:{name}"] = value
    return fields, payload


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_revisit: int = LEAST_REVISIT,
) -> DataFrame:
    """Write a record per page into archives below ``folder``; returns the stored index.

    Of pages with equal payloads of at least ``least_revisit`` bytes, the one with the largest id is a
    response and the others are revisits of it; all others are responses. A null html is an empty
    payload, a null URL an unknown resource. Rows that repeat an id and payload are all responses if
    they have the largest id; a null id is below all others. ``folder`` must be one that all executors
    share. An archive has a name of its own per attempt of a task, and the index holds only those of
    successful attempts, so lost executors leave nothing but unused files.

    The payloads that occur more than once are found from ids, URLs and digests alone and written
    down. Where they take at most 16 MB, every task gets them and no page is shuffled; beyond that they
    are joined by digest, with the pages of a digest dealt among 64 tasks.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least_revisit
    repeated = (
        rows.where(large)
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("response"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and response.page_id is not null")
        .select(
            "digest",
            F.col("response.page_id").alias("response_id"),
            F.col("response.url").alias("response_url"),
        )
    )
    kept = stored(repeated, "warc-repeated")
    weight = F.sum(F.coalesce(F.octet_length("response_url"), F.lit(0)) + F.lit(100))
    if (kept.agg(weight).first()[0] or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(kept), "digest", "left")
    else:
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(
            kept.withColumn("salt", F.explode(salts)), ["digest", "salt"], "left"
        )
    revisit = ~F.col("page_id").eqNullSafe(F.col("response_id")) & F.col("response_id").isNotNull()
    decided = joined.select(
        "page_id", "url", "html", "digest",
        F.when(revisit, F.col("response_id")).alias("refers_to"),
        F.when(revisit, F.col("response_url")).alias("refers_url"),
    )

    def write(batches: Iterator[dict]) -> Iterator[dict]:
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
        out = name = None
        at = 0
        for batch in batches:
            index: dict[str, list] = {part.split()[0]: [] for part in INDEX.split(", ")}
            columns = (batch[n] for n in ("page_id", "url", "html", "digest", "refers_to", "refers_url"))
            for page_id, url, html, digest, refers_to, refers_url in zip(*columns):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                payload = html.encode()
                member = record_bytes(
                    page_id, url, payload, bytes.fromhex(digest), refers_to, refers_url
                )
                out.write(member)
                values = (
                    page_id, url, digest, len(payload), "response" if refers_to is None else "revisit",
                    name, at, len(member),
                )
                for column, value in zip(index.values(), values):
                    column.append(value)
                at += len(member)
            yield index
        if out is not None:
            out.close()

    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return stored(map_columns(decided, write, INDEX), "warc-index")


def _ranges(wanted: Iterator[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of (file, offset, length) in order that one read covers."""
    run: list[tuple[str, int, int]] = []
    for file, offset, length in wanted:
        if run and (
            file != run[0][0]
            or offset - run[-1][1] - run[-1][2] > GAP_BYTES
            or offset + length - run[0][1] > READ_BYTES
        ):
            yield run
            run = []
        run.append((file, offset, length))
    if run:
        yield run


def read_archives(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the rows of ``index``, read from the archives below ``folder``.

    Returns page_id, url, payload_bytes, payload_digest (lower-case hex SHA-1 of the full payload),
    record_type, refers_to and, with ``payloads``, payload (null for revisits). A payload held in a
    record that does not fit its digest raises an error. The number of tasks follows the bytes to read,
    which one small action over the index sums up.
    """
    wanted_bytes = index.agg(F.sum("length")).first()[0] or 0
    tasks = min(max(-(-wanted_bytes // BLOCK_BYTES), 1), READ_TASKS)
    places = index.select("file", "offset", "length").withColumn(
        "block", F.expr(f"offset div {BLOCK_BYTES}")
    )

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
        opened = handle = None
        for batch in batches:
            wanted = zip(batch["file"], batch["offset"], batch["length"])
            for run in _ranges(wanted):
                file, start = run[0][:2]
                if file != opened:
                    if handle is not None:
                        handle.close()
                    opened, handle = file, system.open_input_file(f"{path}/{file}")
                data = handle.read_at(run[-1][1] + run[-1][2] - start, start)
                out: dict[str, list] = {n: [] for n in names}
                for _, offset, length in run:
                    fields, payload = parse_record(data[offset - start : offset - start + length])
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                    kind = fields["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).digest() != digest:
                        raise ValueError(f"damaged record in {file} at {offset}")
                    page_id, refers_to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    out["page_id"].append(None if page_id is None else int(page_id))
                    out["url"].append(fields["WARC-Target-URI"])
                    out["payload_bytes"].append(int(fields["http:Content-Length"]))
                    out["payload_digest"].append(digest.hex())
                    out["record_type"].append(kind)
                    out["refers_to"].append(None if refers_to is None else int(refers_to))
                    if payloads:
                        out["payload"].append(payload if kind == "response" else None)
                yield out
        if handle is not None:
            handle.close()

    schema = (
        "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint" + (", payload binary" if payloads else "")
    )
    names = [part.split()[0] for part in schema.split(", ")]
    # Without a number, adaptive execution would merge tasks by the size of the index rows.
    ordered = places.repartition(tasks, "file", "block").sortWithinPartitions("file", "offset").drop("block")
    return map_columns(ordered, read, schema)


def archive_and_read(pages: DataFrame, **columns: str) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back; see both parts."""
    folder = scratch_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **columns), folder)
