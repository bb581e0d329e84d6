"""Records out of binary files: EDF recordings, fixed-stride records, zip containers, and the file listing itself."""

from __future__ import annotations

import gzip
import io
import math
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noonday.functions.dates import edf_datetime
from noonday.operators.catalogue import base_name, extension, record_date
from noonday.sources.sinks import keep

# --- listing ---------------------------------------------------------------------------------------------------


#: Schemes that Arrow can list and read inside a task; other ones are listed by Spark's own file index.
ARROW_SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")
FOUND = "root int, uri string, folder boolean, size long, modified_at timestamp"


def located(uri: str) -> tuple[str, str]:
    """Where a file lies (scheme and authority) and its path there; a path without a scheme is local."""
    scheme, rest = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", uri, re.S).groups()
    authority, path = re.match(r"//([^/]*)(.*)", rest, re.S).groups() if rest.startswith("//") else ("", rest)
    return f"{scheme or 'file'}://{authority}", path


class Places:
    """File systems by scheme and authority, each opened once by a task."""

    def __init__(self):
        self.opened: dict[str, tuple[pafs.FileSystem, str]] = {}

    def __call__(self, uri: str) -> tuple[pafs.FileSystem, str]:
        place, path = located(uri)
        if place not in self.opened:
            scheme, _, authority = place.partition("://")
            plain = {"s3a": "s3", "gcs": "gs"}.get(scheme, scheme)
            self.opened[place] = pafs.FileSystem.from_uri(f"{plain}://{authority}/")
        system, base = self.opened[place]
        return system, f"{base.rstrip('/')}/{path.lstrip('/')}"


def _list_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files and folders right inside each folder."""
    places, schema = Places(), pa.schema([("root", pa.int32()), ("uri", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("modified_at", pa.timestamp("us", "UTC"))])
    for batch in batches:
        for root, uri in zip(batch.column("root").to_pylist(), batch.column("uri").to_pylist(), strict=True):
            system, path = places(uri)
            inside = system.get_file_info(pafs.FileSelector(path, allow_not_found=True))
            if inside:
                rows = [(root, f"{uri.rstrip('/')}/{i.base_name}", i.type == pafs.FileType.Directory, i.size, i.mtime) for i in inside if not i.base_name.startswith((".", "_"))]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _tree(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Files under the roots: the folders found so far are a table, and tasks list them, one level of the tree a round.

    Each round's table is kept, so the driver sees no names, only whether folders are left, and a lost task lists again
    the folders it was given.
    """
    frontier, levels = spark.createDataFrame(list(enumerate(roots)), "root int, uri string"), []
    while True:
        # dealt anew in every round: a card with most folders is spread over all tasks
        level = keep(frontier.repartition("uri").mapInArrow(_list_each, FOUND), "listing")
        levels.append(level.where("NOT folder"))
        frontier = level.where("folder").select("root", "uri")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def _indexed(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    found = [
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(F.lit(n).alias("root"), F.col("path").alias("uri"), F.lit(False).alias("folder"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
        for n, root in enumerate(roots)
    ]
    return reduce(DataFrame.unionByName, found)


def list_files(spark: SparkSession, *roots: str) -> DataFrame:
    """Files under folders, one card per first-level folder of a root, without their contents.

    Folders are listed by tasks, level by level; only where Arrow does not know the scheme, Spark's index lists them on the
    driver.  Names that begin with a dot or an underscore are left out, as Spark does.
    """
    places = [located(r) for r in roots]
    known = all(place.partition("://")[0] in ARROW_SCHEMES for place, _ in places)
    found = (_tree if known else _indexed)(spark, [r.rstrip("/") for r in roots])
    # the path inside its root, whatever way the scheme and the empty authority are written
    bare = F.element_at(F.array(*[F.lit(path.strip("/")) for _, path in places]), F.col("root") + 1)
    path = F.regexp_replace("uri", r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    inside = F.expr("substring(trim(LEADING '/' FROM __path), length(__bare) + 2)")
    named = found.withColumns({"__path": path, "__bare": bare}).withColumn("__inside", F.when(F.length("__bare") > 0, inside).otherwise(F.expr("trim(LEADING '/' FROM __path)")))
    return named.select(
        F.regexp_extract("__inside", "^([^/]+)/", 1).alias("card_id"),
        F.regexp_replace("__inside", "^[^/]+/", "").alias("path"),
        "uri", "size", "modified_at",
    ).withColumns({"base_name": base_name("path"), "ext": extension("path"), "record_date": record_date("path")})


def _read_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = Places()
    for batch in batches:
        for i in range(batch.num_rows):
            content, reason = None, None
            try:
                system, path = places(batch.column("uri")[i].as_py())
                with system.open_input_stream(path, compression=None) as file:
                    content = file.read()
            except (OSError, ValueError) as error:
                reason = type(error).__name__
            extra = [pa.array([content], pa.binary()), pa.array([reason], pa.string())]
            yield pa.record_batch([*batch.slice(i, 1).columns, *extra], names=[*batch.schema.names, "content", "reason"])


def with_content(wanted: DataFrame) -> DataFrame:
    """The wanted files with their ``content``, or without it and with a ``reason``; no other file is opened.

    The pruned listing is dealt out over the cluster by file, and each task reads its own files one at a time, through
    Arrow's file systems.
    """
    extra = wanted.schema.add("content", "binary").add("reason", "string")
    return wanted.repartition("uri").mapInArrow(_read_each, extra)


# --- EDF -------------------------------------------------------------------------------------------------------

# Widths of the per-signal header fields of the European Data Format, in file order.
EDF_SIGNAL_FIELDS = (
    ("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8),
    ("digital_max", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32),
)
EDF_HEADER = 256
SAMPLES_PER_ROW = 65_536
SAMPLES_PER_BATCH = 1_048_576
EDF_COLUMNS = (
    "channel string, unit string, start_date string, start_time string, record_seconds double, "
    "samples_per_record int, first_seq bigint, data array<double>"
)


def _ascii(data: bytes, start: int, width: int) -> str:
    return data[start : start + width].decode("latin-1").replace("\0", "").strip()


def _number(text: str) -> float | None:
    try:
        value = float(text)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


class Damaged(ValueError):
    """A file that can't be read, with the reason as its text."""


def edf_signals(data: bytes) -> Iterator[tuple]:
    """Signals of one recording as rows of at most 65,536 samples; :class:`Damaged` for a file that can't be read."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error) as error:
            raise Damaged("gzip stream is truncated or corrupt") from error
    if len(data) < EDF_HEADER:
        raise Damaged("shorter than a header")
    header, records, seconds, count = (
        _number(_ascii(data, at, width)) for at, width in ((184, 8), (236, 8), (244, 8), (252, 4))
    )
    if not header or not records or not count or min(header, records, count) <= 0:
        raise Damaged("header numbers are missing or not positive")
    if header > len(data) or EDF_HEADER * (count + 1) > header:
        raise Damaged("header does not fit the file")
    header, records, count = int(header), int(records), int(count)
    fields, at = {}, EDF_HEADER
    for name, width in EDF_SIGNAL_FIELDS:
        fields[name] = [_ascii(data, at + i * width, width) for i in range(count)]
        at += width * count
    sizes = [max(0, int(_number(n) or 0)) for n in fields["samples"]]
    row = sum(sizes)
    if row <= 0:
        raise Damaged("no signal has samples")
    if header + row * 2 * records > len(data):
        raise Damaged("data ends before the last record")
    grid = np.frombuffer(data, "<i2", count=row * records, offset=header).reshape(records, row)
    begin = 0
    for i, size in enumerate(sizes):
        if size and fields["label"][i]:
            low, high, dlow, dhigh = (
                _number(fields[k][i]) for k in ("physical_min", "physical_max", "digital_min", "digital_max")
            )
            low, high = low or 0.0, high or 0.0
            dlow, dhigh = -32768.0 if dlow is None else dlow, 32767.0 if dhigh is None else dhigh
            raw = grid[:, begin : begin + size].reshape(-1)
            gain = (high - low) / (dhigh - dlow) if dhigh != dlow else 1.0
            shift = low - dlow * gain if dhigh != dlow else 0.0
            for first in range(0, raw.size, SAMPLES_PER_ROW):
                part = raw[first : first + SAMPLES_PER_ROW] * gain + shift
                yield (
                    fields["label"][i], fields["unit"][i], _ascii(data, 168, 8), _ascii(data, 176, 8), seconds or 0.0,
                    size, first, part,
                )
        begin += size


def _each_file(batches: Iterator[pa.RecordBatch], keys: Sequence[str], content: str) -> Iterator[tuple[pa.RecordBatch, bytes]]:
    """One file at a time: its keys as a batch of one row, and its bytes.  A batch of files is never copied as a whole."""
    for batch in batches:
        own, data = batch.select(list(keys)), batch.column(content)
        for i in range(batch.num_rows):
            yield own.slice(i, 1), data[i].as_py() or b""


def _portions(signals: Iterator[tuple]) -> Iterator[list[tuple]]:
    rows, samples = [], 0
    for signal in signals:
        rows.append(signal)
        samples += len(signal[-1])
        if samples >= SAMPLES_PER_BATCH:
            yield rows
            rows, samples = [], 0
    if rows:
        yield rows


def _beside(own: pa.RecordBatch, n: int, columns: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """The keys of one file, repeated, beside ``n`` rows of ``columns``."""
    repeated = own.take(pa.array([0] * n, pa.int32()))
    arrays = [*repeated.columns, *[pa.array(v, types[k]) for k, v in columns.items()]]
    return pa.record_batch(arrays, names=[*own.schema.names, *columns])


EDF_TYPES = {
    "channel": pa.string(), "unit": pa.string(), "start_date": pa.string(), "start_time": pa.string(), "record_seconds": pa.float64(),
    "samples_per_record": pa.int32(), "first_seq": pa.int64(), "data": pa.list_(pa.float64()),
}


def rejected_edf(files: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """Files that :func:`read_edf` leaves out: keys and ``reason``."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, data in _each_file(batches, keys, content):
            try:
                for _ in edf_signals(data):
                    pass
            except Damaged as reason:
                yield _beside(own, 1, {"reason": [str(reason)]}, {"reason": pa.string()})

    source = files.select(*keys, content)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in keys)
    return source.mapInArrow(test, f"{key_schema}, reason string")


def read_edf(files: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """Long samples of EDF recordings: keys, channel, seq, ts, value, sample_seconds.

    Only the byte work runs in Python, one file at a time; rows are exploded and timed in the JVM.
    """
    names = [c.split()[0] for c in EDF_COLUMNS.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, data in _each_file(batches, keys, content):
            try:
                for some in _portions(edf_signals(data)):
                    yield _beside(own, len(some), dict(zip(names, zip(*some, strict=True), strict=True)), EDF_TYPES)
            except Damaged:
                continue

    source = files.select(*keys, content)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in keys)
    signals = source.mapInArrow(decode, f"{key_schema}, {EDF_COLUMNS}")
    step = F.col("record_seconds") / F.col("samples_per_record")
    start = edf_datetime("start_date", "start_time")
    return (
        signals.withColumn("start_ts", start)
        .where("start_ts IS NOT NULL")
        .select(*keys, "channel", "unit", "start_ts", step.alias("sample_seconds"), "first_seq", F.posexplode("data").alias("i", "value"))
        .select(
            *keys, "channel", "unit", "start_ts", (F.col("first_seq") + F.col("i")).alias("seq"),
            F.timestamp_micros(
                F.unix_micros("start_ts") + F.round((F.col("first_seq") + F.col("i")) * F.col("sample_seconds") * 1e6).cast("bigint")
            ).alias("ts"),
            "value", "sample_seconds",
        )
    )


# --- fixed-stride records --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """One number of a fixed-stride record: ``null`` is the raw value that stands for "missing"."""

    name: str
    offset: int
    width: int
    little: bool = True
    scale: float = 1.0
    null: int | None = None


def _unsigned(block: Column, f: Field) -> Column:
    hexed = F.hex(F.substring(block, f.offset + 1, f.width))
    if f.little:
        hexed = F.concat(*[F.substring(hexed, 2 * i + 1, 2) for i in reversed(range(f.width))])
    return F.conv(hexed, 16, 10).cast("bigint")


def fixed_records(
    files: DataFrame, keys: Sequence[str], stride: int, fields: Sequence[Field], sentinel: bytes = b"", offset: int = 0,
    content: str = "content",
) -> DataFrame:
    """Fixed-stride records as rows: records without the sentinel drop out, null markers become NULL.

    The layout is the caller's; the records are exploded by position inside the JVM.
    """
    last = F.length(content) - stride
    starts = F.when(last >= offset, F.sequence(F.lit(offset), last.cast("int"), F.lit(stride)))
    blocks = files.select(*keys, content, F.explode(starts).alias("at")).select(
        *keys, F.floor((F.col("at") - offset) / stride).alias("record"),
        F.col(content).substr(F.col("at") + 1, F.lit(stride)).alias("__block"),
    )
    if sentinel:
        blocks = blocks.where(F.hex(F.substring("__block", 1, len(sentinel))) == sentinel.hex().upper())
    out = []
    for f in fields:
        raw = _unsigned(F.col("__block"), f)
        value = raw if f.null is None else F.when(raw != f.null, raw)
        out.append((value if f.scale == 1.0 else value * f.scale).alias(f.name))
    return blocks.select(*keys, "record", *out)


# --- zip containers --------------------------------------------------------------------------------------------

BYTES_PER_BATCH = 16 * 1024 * 1024
# Members that hold a session, by the six digits of their name.
MEMBER = re.compile(r"^(event|signal)_(\d{6})\.(?:xml|wmedf)$", re.IGNORECASE)


def zip_members(files: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """Session members of zip containers: keys, place, session, kind, member, reason.

    A container or member that can't be read is a row without ``member`` that tells the ``reason``.
    """
    source = files.select(*keys, content)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in keys)
    types = {"place": pa.int32(), "session": pa.string(), "kind": pa.string(), "member": pa.binary(), "reason": pa.string()}

    def members(data: bytes) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, OSError, ValueError):
            yield None, None, None, None, "not a readable container"
            return
        for place, info in enumerate(archive.infolist()):
            if hit := MEMBER.match(info.filename.rsplit("/", 1)[-1]):
                try:
                    yield place, hit[2], hit[1].lower(), archive.read(info), None
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError):
                    yield place, hit[2], hit[1].lower(), None, "member is damaged, encrypted or packed in an unknown way"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, data in _each_file(batches, keys, content):
            rows, held = [], 0
            for row in members(data):
                rows.append(row)
                held += len(row[3] or b"")
                if held >= BYTES_PER_BATCH:
                    yield _beside(own, len(rows), dict(zip(types, zip(*rows, strict=True), strict=True)), types)
                    rows, held = [], 0
            if rows:
                yield _beside(own, len(rows), dict(zip(types, zip(*rows, strict=True), strict=True)), types)

    return source.mapInArrow(unpack, f"{key_schema}, place int, session string, kind string, member binary, reason string")


def pair_members(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Event text and signal bytes of one session side by side; the first member of a kind is used."""

    def pick(kind: str) -> Column:
        return F.min_by("member", F.when(F.col("kind") == kind, F.col("place")))

    return members.where("reason IS NULL").groupBy(*keys, "session").agg(
        pick("event").cast("string").alias("event_text"), pick("signal").alias("signal_bytes")
    )
