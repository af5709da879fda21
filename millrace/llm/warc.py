"""WARC archives: writing, and normalising whole-file gzip streams to one member for each record with an offset index.

``write_monolithic`` writes records through Spark's own text writer (any file system, task commits): each file is one
gzip stream of whole records. ``normalise`` inflates each such file once as a stream, rewrites every record as a gzip
member of its own and writes a sidecar index (offset, length, identifier, type, digest) beside the archive. Files go to
a folder that all machines share, under a name of the attempt, and get their last name by a rename, so a task that runs
again leaves the same files. ``read_records`` opens members by the index alone.

Records with equal payloads (SHA-1 and length) of at least ``least_bytes``: that with the largest identifier is the
response and the others are revisits that name it. Smaller payloads are all responses.

Defined cases: a null payload is empty; a null identifier sorts below all others and is kept as null; of rows that
repeat identifier and payload one is the response and names of records stay unique; null addresses are empty and control characters in them are
percent-encoded; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, is_plain_scan, shared_dir, table
from millrace.llm.store import located, publish, saved

#: Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
#: Date of every record that this operator writes: runs of the same input give the same files.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Rows of an index that a task holds before it writes them.
INDEX_ROWS = 8192
INDEX = "record_id string, offset long, size long, record_type string, payload_bytes long, payload_digest string, refers_to string, archive string"


def base32(sha_hex: Column) -> Column:
    """The base32 spelling of 20 bytes that are given in hex: eight letters for each five bytes."""
    letters = []
    for k in range(4):
        number = F.conv(F.substring(sha_hex, 10 * k + 1, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, 35 - 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1)) for j in range(8)]
    return F.concat(*letters)


def assign(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """Rows (row, id, url, payload, n_bytes, sha, refers_id, refers_row): the last two of revisits only."""
    # hashes first and without the payload, so that the rows which meet are small
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    base = base.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    # row numbers are read twice: a plain scan gives the same ones again, those of other frames are kept with their rows
    if not is_plain_scan(pages):
        base = saved(base, f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-rows-{uuid.uuid4().hex}")
    slim = cut(base.select("row", "id", "n_bytes", "sha"))
    first = slim.groupBy("sha", "n_bytes").agg(F.max(F.struct("id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = slim.where(F.col("n_bytes") >= least_bytes).join(first, ["sha", "n_bytes"]).where(F.col("row") != F.col("first.row"))
    again = again.select("row", F.col("first.id").alias("refers_id"), F.col("first.row").alias("refers_row"))
    return base.join(again, "row", "left")


def record_id(identifier: Column, row: Column) -> Column:
    """Unique for each record, also where identifiers repeat or are null."""
    return F.concat(F.lit("<urn:millrace:page:"), F.coalesce(identifier.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, least_bytes: int = 0) -> DataFrame:
    """One text row for each record, without the end that the writer adds."""
    rows = assign(pages, id_col, url_col, payload_col, least_bytes)
    again = F.col("refers_row").isNotNull()
    url = F.coalesce("url", F.lit(""))
    for bad in ("\r", "\n", "\0"):
        url = F.replace(url, F.lit(bad), F.lit(f"%{ord(bad):02X}"))
    header = F.concat_ws(
        "\r\n", F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("id"), F.col("row"))), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.hex("sha"))), F.concat(F.lit("X-Payload-Length: "), F.col("n_bytes")),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_id"), F.col("refers_row")))),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit(0).cast("long")).otherwise(F.col("n_bytes"))),
    )
    return rows.select(F.concat(header, F.lit("\r\n\r\n"), F.when(again, "").otherwise(F.col("payload"))).alias("value"))


def write_monolithic(rows: DataFrame, path: str, most_records: int = 4000) -> None:
    rows.write.mode("overwrite").option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", most_records).text(path)


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.split(b"\r\n")
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}


def split_stream(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header, payload, raw record) of each record of an inflated stream, holding one record at a time."""
    held, chunks = bytearray(), iter(chunks)

    def more(least: int) -> bool:
        while len(held) < least:
            try:
                held.extend(next(chunks))
            except StopIteration:
                return False
        return True

    while more(1):
        searched = 0
        while (at := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not more(len(held) + 1):
                raise ValueError("a record's header is cut off")
        header = parse_header(bytes(held[:at]))
        size = at + 4 + int(header["content-length"])
        if not more(size + 4):
            raise ValueError("a record is cut off")
        raw = bytes(held[: size + 4])
        del held[: size + 4]
        yield header, raw[at + 4 : size], raw


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file (any number of members), a step at a time; a file that ends within a member is an error."""
    import zlib

    d, inside = zlib.decompressobj(31), False
    for data in chunks:
        while data:
            inside = True
            yield d.decompress(data, 1 << 22)
            while d.unconsumed_tail:
                yield d.decompress(d.unconsumed_tail, 1 << 22)
            data = d.unused_data
            if d.eof:
                d, inside = zlib.decompressobj(31), False
    if inside:
        raise ValueError("a gzip member is cut off")


def digest_of(header: dict[str, str], payload: bytes, whole: bool) -> str:
    """The record's SHA-1 in base32, computed where the record holds its whole payload, else as its header has it."""
    import base64
    import hashlib

    said = header.get("warc-payload-digest", "").partition(":")[2].upper()
    if not whole and said:
        return said
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if whole and said and said != found and "x-payload-length" in header:  # others may hash another part of the block
        raise ValueError(f"the payload of {header.get('warc-record-id')} doesn't match its digest")
    return found


def described(header: dict[str, str], payload: bytes) -> tuple:
    """(record_type, payload_bytes, payload_digest, refers_to) of a record."""
    kind = header.get("warc-type", "")
    again = kind == "revisit"
    size = int(header["x-payload-length"]) if again and "x-payload-length" in header else len(payload)
    return kind, size, digest_of(header, payload, not again), header.get("warc-refers-to") if again else None


def member(raw: bytes, level: int) -> bytes:
    import zlib

    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _normalise(out: str, level: int):
    def run(batches: Iterator) -> Iterator:
        import hashlib
        import posixpath

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        store, root = located(out)
        store.create_dir(root, recursive=True)
        names = [f.split()[0] for f in INDEX.split(", ")]
        index_schema, n = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in INDEX.split(", ")]), 0
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            # names of different paths never meet
            name = posixpath.basename(path)
            for end in (".gz", ".txt", ".warc"):
                name = name.removesuffix(end)
            name = f"{name}-{hashlib.md5(path.encode()).hexdigest()[:12]}"
            attempt = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}.{uuid.uuid4().hex[:8]}"
            rows, offset = [], 0
            source, place = located(path)

            def listed(rows):
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, index_schema.types, strict=True)], schema=index_schema)

            with source.open_input_stream(place, compression=None) as file, store.open_output_stream(f"{attempt}.warc.gz", compression=None) as f, store.open_output_stream(f"{attempt}.index", compression=None) as g, pq.ParquetWriter(g, index_schema) as index:
                for header, payload, raw in split_stream(inflate(iter(lambda file=file: file.read(1 << 20), b""))):
                    data = member(raw, level)
                    f.write(data)
                    kind, n_bytes, digest, refers = described(header, payload)
                    rows.append((header.get("warc-record-id"), offset, len(data), kind, n_bytes, digest, refers, f"{root}/{name}.warc.gz"))
                    offset += len(data)
                    if len(rows) == INDEX_ROWS:
                        index.write_batch(listed(rows))
                        n, rows = n + len(rows), []
                index.write_batch(listed(rows))
                n += len(rows)
            for end, last in ((".warc.gz", ".warc.gz"), (".index", ".index.parquet")):
                publish(store, f"{attempt}{end}", f"{root}/{name}{last}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def normalise(spark: SparkSession, monolithic: str, out: str, level: int = 4) -> DataFrame:
    """Writes archives and sidecar indexes into out and returns the indexes' rows, read back from there.

    Tasks get paths only and read each file as a stream, so a task holds one record, one step of a file and ``INDEX_ROWS`` rows of its index.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(monolithic).select("path")
    written = files.mapInArrow(_normalise(out, level), "n long").agg(F.sum("n").alias("n")).first()["n"]
    if not written:
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.index.parquet").parquet(out)


def _members(out: str):
    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        store = located(out)[0]
        names = ["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        name, f = None, None
        for b in batches:
            rows, held = [], 0
            for r in b.to_pylist():
                if r["archive"] != name:
                    if f:
                        f.close()
                    name, f = r["archive"], store.open_input_file(r["archive"])
                f.seek(r["offset"])
                header, payload, _ = next(split_stream(iter([zlib.decompress(f.read(r["size"]), 31)])))
                rows.append((header.get("warc-record-id"), *described(header, payload), payload))
                held += len(payload)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if f:
            f.close()

    return run


def read_records(index: DataFrame, out: str) -> DataFrame:
    """Every indexed record, each read from its own member: record_id, record_type, payload_bytes, payload_digest, refers_to, payload."""
    rows = index.select("archive", "offset", "size")
    return rows.mapInArrow(_members(out), "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def page_of(record: Column) -> Column:
    """The page's identifier in the name of a record that this module wrote; null where the page had none."""
    return F.nullif(F.regexp_extract(record, r":page:(-?[0-9]+):[0-9]+>$", 1), F.lit("")).cast("long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_monolithic(records(table(spark, sf_dir, "pages")), f"{root}/monolithic")
    index = normalise(spark, f"{root}/monolithic", f"{root}/archives")
    return read_records(index, f"{root}/archives").select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
