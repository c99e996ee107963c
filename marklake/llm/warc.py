"""Deterministic sharded WARC writer, and a reader.

Records are sorted by id and digest of their payload, and shards are cut where the
running sum of bytes in that order fills them.  The sum is exact (sizes are ranged and
summed without payloads), so shards depend on the rows alone: not on a sample, not on
how ids are spread, and not on the order of the input.  Records of one key that fill
several shards are dealt over all of them, in the order of the input.  Within a shard records are sorted; a file is closed
once its compressed size passes ``roll_bytes``.  Every record is a gzip member of its
own, with headers and digests made anew.

A task writes under a temporary name that holds a random part, and reports what it
wrote.  Only the names reported by tasks that Spark counts as done reach the
manifest; then each is moved to its final name, and a written manifest commits
the archive.  Files of lost or repeated attempts are never named by it.

Files are reached through ``pyarrow.fs`` by the scheme of their address, on executors
as on the driver; the address must lie in a store that all of them share.

Defined results: a null payload is written as an empty one, a null id is written
without the id header and sorts first; ids may be any long; records equal in id and
payload are both written, and both are responses if theirs is the largest id; a very
long payload is a record, and if it fills one a shard, of its own; an empty table writes no
file; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import Workspace

SHARD_BYTES = 16 << 20  # payload bytes of a shard; more where there would be over MOST_SHARDS of them
MOST_SHARDS = 1 << 18  # what is known of each shard travels to the tasks: its first key
ROLL = 8  # without roll_bytes, a file is closed at this part of a shard's bytes
MIN_REVISIT = 1000  # shorter payloads are always written whole
DATE = "1970-01-01T00:00:00Z"  # a fixed date keeps reruns equal; a parameter
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "name string, temp string, shard int, part int, records long, bytes long, sha1 string"


def filesystem(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it."""
    if "://" not in address:
        address = "file://" + address.removeprefix("file:")
    return pafs.FileSystem.from_uri(address)


def _member(head: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(lines.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _base32(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def record_id(page_id, url, digest: bytes, again: str = "") -> str:
    """Id of a record by what it holds; ``again`` tells repeated rows apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{url}\n{digest.hex()}' + (f'\n{again}' if again else ''))}>"


def _uri(url: str) -> str:
    return quote(url, safe=":/?#[]@!$&'()*+,;=%~")


def record(page_id, url, payload: bytes, digest: bytes, size: int, refers_to, date: str, level: int, refers_url=None, again: str = "") -> bytes:
    """One gzip member: a response, or a revisit that leaves the payload out and names the response with it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, url, digest, again)),
        ("WARC-Date", date),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", _base32(digest)),
        ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())),
        ("X-Payload-Length", str(size)),
    ]
    if url is not None:
        head += [("WARC-Target-URI", _uri(url)), ("X-Page-Url", quote(url, safe=":/"))]  # the second one gives the url back as it was
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, refers_url, digest)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", str(refers_to))]
        if refers_url is not None:
            head.append(("WARC-Refers-To-Target-URI", _uri(refers_url)))
    return _member(head, block, level)


def _keys(ids: pa.Array, digests: pa.Array) -> np.ndarray:
    """Byte strings that sort as (id, nulls first; digest) does."""
    n = len(ids)
    out = np.zeros((n, 29), np.uint8)
    out[:, 0] = ids.is_valid().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    out[:, 1:9] = np.where(out[:, 0] > 0, number ^ np.uint64(1 << 63), np.uint64(0)).byteswap().view(np.uint8).reshape(n, 8)
    out[:, 9:] = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(n, 20)
    return out.view("S29").ravel()


class Shards:
    """First key of every shard, and the keys that fill several."""

    def __init__(self, cuts: list, heavy: list):
        self.first = _keys(pa.array([r["id"] for r in cuts], pa.int64()), pa.array([bytes(r["digest"]) for r in cuts], pa.binary()))
        self.number = np.array([r["shard"] for r in cuts], np.int64)
        keys = _keys(pa.array([r["id"] for r in heavy], pa.int64()), pa.array([bytes(r["digest"]) for r in heavy], pa.binary()))
        self.heavy = {k: (r["shard"], r["last"]) for k, r in zip(keys.tolist(), heavy)}

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.number[np.searchsorted(self.first, keys, "right") - 1]


def _shards(ws: Workspace, facts: DataFrame, shard_bytes: int) -> tuple[Shards, int]:
    """Shards of all keys, by the running sum of bytes over the sorted keys, and their number.

    The keys are ranged anyhow; each range's sum and the sum inside it give the exact
    place of a key, whatever the ranges were.
    """
    sized = facts.groupBy("id", "digest").agg(F.sum("n").alias("n"), F.count("*").alias("times"))
    ranged = ws.save(sized.repartitionByRange(F.col("id").asc_nulls_first(), "digest").withColumn("range", F.spark_partition_id()), "ranged")
    sums = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect())  # a row for each range
    total = sum(n for _, n in sums)
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    before, at = [], 0
    for number, n in sums:
        before.append((number, at))
        at += n
    bases = ws.spark.createDataFrame(before, "range int, base long")
    run = F.sum("n").over(Window.partitionBy("range").orderBy(F.col("id").asc_nulls_first(), "digest"))
    placed = ranged.join(F.broadcast(bases), "range").withColumn("end", F.col("base") + run)
    placed = placed.select("id", "digest", F.floor((F.col("end") - F.col("n")) / shard_bytes).cast("int").alias("shard"), F.floor(F.greatest(F.col("end") - 1, F.lit(0)) / shard_bytes).cast("int").alias("last"), "n", "times")
    placed = ws.save(placed, "placed")
    cuts = placed.groupBy("shard").agg(F.min(F.struct("id", "digest")).alias("k")).select("shard", "k.id", "k.digest").orderBy("shard").collect()  # at most MOST_SHARDS
    heavy = placed.where((F.col("n") > shard_bytes) & (F.col("times") > 1)).select("id", "digest", "shard", "last").collect()  # fewer than shards
    return Shards(cuts, heavy), max([r["shard"] for r in cuts] + [r["last"] for r in heavy], default=0) + 1


def write(spark: SparkSession, pages: DataFrame, out: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", prefix: str = "pages", shard_bytes: int = SHARD_BYTES, roll_bytes: int | None = None, min_revisit: int = MIN_REVISIT, date: str = DATE, level: int = 6) -> DataFrame:
    """Write the archive under the address ``out`` and return its manifest."""
    ws = Workspace(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("n", F.octet_length("payload").cast("long"))
    facts = ws.save(rows.select("id", "digest", "n", "url"), "facts")
    large = facts.where(F.col("n") >= min_revisit)
    # nulls sort first: a payload that only rows without an id hold has no keeper
    keepers = large.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("keeper"), F.min(F.struct("id")).alias("least")).where("keeper.id IS NOT NULL AND NOT (keeper.id <=> least.id)").select("digest", "keeper")
    # id and digest name a record; the row that bears its reference sorts just before it
    refers = large.select("id", "digest").join(keepers, "digest").where("NOT (id <=> keeper.id)").select("id", "digest", F.col("keeper.id").alias("refers_to"), F.col("keeper.url").alias("refers_url")).distinct()

    found, shards = _shards(ws, facts, shard_bytes)
    sharding = spark.sparkContext.broadcast(found)
    if roll_bytes is None:
        roll_bytes = max(1, shard_bytes // ROLL)
    a = rows.select("id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to"), F.monotonically_increasing_id().alias("row"))
    b = refers.select("id", "digest", F.lit(0).alias("kind"), F.col("refers_url").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to", F.lit(0).cast("long").alias("row"))

    def place(batches):
        shards = sharding.value
        for batch in batches:
            names = batch.schema.names
            keys = _keys(batch.column(0), batch.column(1))
            number = shards.of(keys) if len(keys) else np.zeros(0, np.int64)
            take = np.arange(len(keys))
            if shards.heavy:
                # a record of a heavy key goes to one of its shards, a reference to all of them
                kind, row = (batch.column(names.index(c)).to_numpy() for c in ("kind", "row"))
                more_rows, more_numbers = [], []
                for i, k in enumerate(keys.tolist()):
                    if k in shards.heavy:
                        first, last = shards.heavy[k]
                        if kind[i]:
                            number[i] = first + int(row[i]) % (last - first + 1)
                        else:
                            number[i] = first
                            more_rows += [i] * (last - first)
                            more_numbers += range(first + 1, last + 1)
                take, number = np.append(take, np.array(more_rows, np.int64)), np.append(number, np.array(more_numbers, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)).take(pa.array(take)) if len(take) > len(keys) else batch.column(names.index(c)) for c in ("id", "digest", "kind", "url", "payload", "refers_to")), pa.array(number.astype(np.int32))], ["id", "digest", "kind", "url", "payload", "refers_to", "shard"])

    placed = a.unionAll(b).mapInArrow(place, "id long, digest binary, kind int, url string, payload binary, refers_to long, shard int")
    # more partitions than shards, so that few tasks get two
    ranged = placed.repartition(min(3 * shards, MOST_SHARDS), "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "digest", "kind", F.col("url").asc_nulls_first())

    def write_files(batches):
        store, base = filesystem(out)
        store.create_dir(f"{base}/_temporary", recursive=True)
        sink, info, current, refers = None, None, None, None

        def close():
            sink.close()
            info["sha1"] = info.pop("hash").hexdigest()
            return pa.RecordBatch.from_pylist([info], pa.schema([("name", pa.string()), ("temp", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

        def put(member):
            sink.write(member)
            info["hash"].update(member)
            info["bytes"] += len(member)

        part, last, times = 0, None, 0
        heavy = sharding.value.heavy
        for batch in batches:
            names = batch.schema.names
            keys = _keys(batch.column(names.index("id")), batch.column(names.index("digest"))).tolist() if heavy else []
            cols = {c: batch.column(names.index(c)) for c in names}
            for i in range(batch.num_rows):
                digest = cols["digest"][i].as_py()
                page_id = cols["id"][i].as_py()
                if cols["kind"][i].as_py() == 0:
                    refers = (page_id, digest, cols["refers_to"][i].as_py(), cols["url"][i].as_py())
                    continue
                number = cols["shard"][i].as_py()
                if sink is not None and (number != current or info["bytes"] >= roll_bytes):
                    yield close()
                    part, sink = (part + 1 if number == current else 0), None
                if sink is None:
                    if number != current:
                        part = 0
                    current, name = number, f"{prefix}-{number:05d}-{part:04d}.warc.gz"
                    temp = f"_temporary/{name}.{uuid.uuid4().hex}"
                    sink = store.open_output_stream(f"{base}/{temp}", compression=None)
                    info = {"name": name, "temp": temp, "shard": number, "part": part, "records": 0, "bytes": 0, "hash": hashlib.sha1()}
                    put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))
                payload = cols["payload"][i].as_buffer().to_pybytes()
                target, its_url = refers[2:] if refers is not None and refers[:2] == (page_id, digest) else (None, None)
                url = cols["url"][i].as_py()
                times = times + 1 if last == (number, page_id, digest, url) else 0
                last = (number, page_id, digest, url)
                first = heavy.get(keys[i], (number,))[0] if heavy else number
                again = f"{number}.{times}" if times or number != first else ""  # repeated rows follow each other, those of a heavy key in several shards
                put(record(page_id, url, payload, digest, len(payload), target, date, level, its_url, again))
                info["records"] += 1
        if sink is not None:
            yield close()

    pending = ws.save(ranged.mapInArrow(write_files, MANIFEST), "pending")

    def move(batches):
        store, base = filesystem(out)
        for batch in batches:
            for name, temp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if store.get_file_info(f"{base}/{temp}").type != pafs.FileType.NotFound:
                    store.move(f"{base}/{temp}", f"{base}/{name}")
                elif store.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"neither {temp} nor {name}")
            yield batch

    pending.mapInArrow(move, MANIFEST).orderBy("name").drop("temp").write.mode("overwrite").parquet(f"{out}/manifest")
    store, base = filesystem(out)
    if store.get_file_info(f"{base}/_temporary").type != pafs.FileType.NotFound:
        store.delete_dir(f"{base}/_temporary")
    ws.drop()
    return spark.read.parquet(f"{out}/manifest")


def members(stream, chunk: int = 1 << 20):
    """The decompressed gzip members of a stream, one at a time."""
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not rest:
                rest = stream.read(chunk)
                if not rest:
                    raise EOFError("a gzip member is cut short")
            parts.append(z.decompress(rest))
            rest = z.unused_data if z.eof else b""
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; the length and the block's digest must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if (d := fields.get("WARC-Block-Digest")) and d != _base32(hashlib.sha1(block).digest()):
        raise ValueError("a block's digest is wrong")
    return fields, block


def read(spark: SparkSession, out: str, *, payloads: bool = False) -> DataFrame:
    """Every response and revisit of a committed archive: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` (and ``payload``)."""
    manifest = spark.read.parquet(f"{out}/manifest").select("name")
    files = max(1, manifest.count())
    kind = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def load(batches):
        store, base = filesystem(out)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        fields, block = parse(raw)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        body = block.partition(b"\r\n\r\n")[2]
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                        if fields["WARC-Type"] == "response" and hashlib.sha1(body).digest() != digest:
                            raise ValueError("a payload's digest is wrong")
                        number = lambda key: int(fields[key]) if key in fields else None  # noqa: B023,E731
                        rows.append({"page_id": number("X-Page-Id"), "url": unquote(fields["X-Page-Url"]) if "X-Page-Url" in fields else fields.get("WARC-Target-URI"), "payload_bytes": number("X-Payload-Length"), "payload_digest": digest.hex(), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id")} | ({"payload": body} if payloads else {}))
                        held += len(body) if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(kind))
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(kind))

    return manifest.repartition(min(files, 10_000)).mapInArrow(load, schema)
