"""OpenStreetMap extracts as three DataFrames: nodes, ways and relations (see schema.OSM_*).

XML goes through Spark's own reader. PBF has a Python data source: the driver lists the blobs by their headers, and every
partition inflates and decodes a run of blobs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import OSM_NODE, OSM_RELATION, OSM_WAY, TAGS

SCHEMAS = {"node": OSM_NODE, "way": OSM_WAY, "relation": OSM_RELATION}
_XML_TAGS = "tag array<struct<_k:string,_v:string>>"
_XML = {
    "node": f"_id bigint, _lat double, _lon double, {_XML_TAGS}",
    "way": f"_id bigint, nd array<struct<_ref:bigint>>, {_XML_TAGS}",
    "relation": f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {_XML_TAGS}",
}


def read_osm_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """{"node", "way", "relation"}: elements without children have empty arrays."""
    rows = {k: spark.read.format("xml").option("rowTag", k).schema(s).load(path) for k, s in _XML.items()}
    tags = F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast(TAGS)).alias("tags")
    refs = F.coalesce(F.transform("nd", lambda n: n["_ref"]), F.array().cast("array<bigint>")).alias("refs")
    member = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    members = F.coalesce(member, F.array().cast("array<struct<type:string,ref:bigint,role:string>>")).alias("members")
    return {
        "node": rows["node"].select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags),
        "way": rows["way"].select(F.col("_id").alias("id"), refs, tags),
        "relation": rows["relation"].select(F.col("_id").alias("id"), members, tags),
    }


# ---------------------------------------------------------------- protobuf wire format


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _signed(value: int) -> int:
    return value >> 1 ^ -(value & 1)


def _int64(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message; length-delimited values are bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def packed(data: bytes, zigzag: bool = False) -> np.ndarray:
    """The varints of a packed field, all at once."""
    raw = np.frombuffer(data, np.uint8)
    stops = np.flatnonzero(raw < 128)
    starts = np.r_[0, stops[:-1] + 1][: len(stops)]
    out = np.zeros(len(stops), np.uint64)
    for k in range(int((stops - starts).max(initial=-1)) + 1):
        more = starts + k <= stops
        out[more] |= (raw[starts[more] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return ((out >> np.uint64(1)) ^ (~(out & np.uint64(1)) + np.uint64(1))).view(np.int64) if zigzag else out.view(np.int64)


def decode_block(data: bytes, element: str) -> Iterator[pa.RecordBatch]:
    """One kind of element of a primitive block, a batch for each group that has it."""
    strings, groups, granularity, lat_offset, lon_offset = pa.array([], pa.string()), [], 100, 0, 0
    for number, value in fields(data):
        if number == 1:
            strings = pa.array([v for n, v in fields(value) if n == 1], pa.binary()).cast(pa.string())
        elif number == 2:
            groups.append(value)
        elif number == 17:
            granularity = value
        elif number == 19:
            lat_offset = _int64(value)
        elif number == 20:
            lon_offset = _int64(value)
    degrees = lambda v, offset: (offset + granularity * np.asarray(v, np.int64)) * 1e-9
    for group in groups:
        messages = [dict(fields(value)) for number, value in fields(group) if number == {"node": 1, "way": 3, "relation": 4}[element]]
        if element == "node":
            if messages:
                ids, lats, lons = ([_signed(m[k]) for m in messages] for k in (1, 8, 9))
                yield _batch("node", pa.array(ids), pa.array(degrees(lats, lat_offset)), pa.array(degrees(lons, lon_offset)), _tags(messages, strings))
            for number, value in fields(group):
                if number == 2:
                    m = dict(fields(value))
                    ids, lats, lons = (np.cumsum(packed(m.get(k, b""), True)) for k in (1, 8, 9))
                    yield _batch("node", pa.array(ids), pa.array(degrees(lats, lat_offset)), pa.array(degrees(lons, lon_offset)), _dense_tags(packed(m.get(10, b"")), len(ids), strings))
        elif messages and element == "way":
            refs = [np.cumsum(packed(m.get(8, b""), True)) for m in messages]
            yield _batch("way", pa.array([_int64(m[1]) for m in messages], pa.int64()), _lists(refs, pa.array(np.concatenate(refs))), _tags(messages, strings))
        elif messages:
            kinds, roles = ([packed(m.get(k, b"")) for m in messages] for k in (10, 8))
            refs = [np.cumsum(packed(m.get(9, b""), True)) for m in messages]
            names = pa.array(["node", "way", "relation"]).take(pa.array(np.concatenate(kinds)))
            members = pa.StructArray.from_arrays([names, pa.array(np.concatenate(refs)), strings.take(pa.array(np.concatenate(roles)))], ["type", "ref", "role"])
            yield _batch("relation", pa.array([_int64(m[1]) for m in messages], pa.int64()), _lists(refs, members), _tags(messages, strings))


ARROW_TAGS = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))
ARROW = {
    "node": pa.schema([("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", ARROW_TAGS)]),
    "way": pa.schema([("id", pa.int64()), ("refs", pa.list_(pa.int64())), ("tags", ARROW_TAGS)]),
    "relation": pa.schema([("id", pa.int64()), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))), ("tags", ARROW_TAGS)]),
}


def _batch(element: str, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, ARROW[element])], schema=ARROW[element])


def _lists(parts: list[np.ndarray], values: pa.Array) -> pa.ListArray:
    """``values`` cut into lists as long as the parts."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), values)


def _pairs(keys: np.ndarray, values: np.ndarray, strings: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays([strings.take(pa.array(keys)), strings.take(pa.array(values))], ["k", "v"])


def _tags(messages: list[dict], strings: pa.Array) -> pa.ListArray:
    keys, values = ([packed(m.get(k, b"")) for m in messages] for k in (2, 3))
    return _lists(keys, _pairs(np.concatenate(keys), np.concatenate(values), strings))


def _dense_tags(flat: np.ndarray, n: int, strings: pa.Array) -> pa.ListArray:
    """Tags of dense nodes: key, value, key, value ..., a zero after each node; nothing at all where no node has any."""
    if not len(flat):
        counts, pairs = np.zeros(n, np.int64), np.zeros((0, 2), np.int64)
    else:
        ends = np.flatnonzero(flat == 0)
        sizes = np.diff(np.r_[-1, ends]) - 1
        if (sizes % 2).any():  # a zero that is a value, the string at place 0, follows its key and makes a size odd
            ends, at = [], 0
            for _ in range(n):
                while flat[at]:
                    at += 2
                ends.append(at)
                at += 1
            ends = np.array(ends)
        counts = (np.diff(np.r_[-1, ends[:n]]) - 1) // 2
        pairs = np.delete(flat[: ends[n - 1]], ends[: n - 1]).reshape(-1, 2) if n else np.zeros((0, 2), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), _pairs(pairs[:, 0], pairs[:, 1], strings))


def _open(path: str):
    """A readable, seekable file on a local disk or in any store that pyarrow knows."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(inner)


def blobs(file) -> Iterator[tuple[str, int, int]]:
    """(type, offset, size) of the blobs of a file, read from their headers."""
    at = 0
    while True:
        file.seek(at)
        head = file.read(4)
        if len(head) < 4:
            return
        size = struct.unpack(">I", head)[0]
        header = dict(fields(file.read(size)))
        yield header[1].decode(), at + 4 + size, header[3]
        at += 4 + size + header[3]


def inflate(blob: bytes) -> bytes:
    m = dict(fields(blob))
    if 1 in m:
        return m[1]
    if 3 in m:
        return zlib.decompress(m[3])
    raise ValueError("only raw and zlib blobs are supported")


@dataclass
class BlobRun(InputPartition):
    places: list[tuple[int, int]]


class PbfReader(DataSourceReader):
    def __init__(self, path: str, element: str, run_bytes: int):
        self.path, self.element, self.run_bytes = path, element, run_bytes

    def partitions(self) -> list[BlobRun]:
        runs, size = [BlobRun([])], 0
        with _open(self.path) as file:
            for kind, at, length in blobs(file):
                if kind == "OSMData":
                    if size and size + length > self.run_bytes:
                        runs.append(BlobRun([]))
                        size = 0
                    runs[-1].places.append((at, length))
                    size += length
        return runs

    def read(self, partition: BlobRun) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as file:
            for at, length in partition.places:
                file.seek(at)
                yield from decode_block(inflate(file.read(length)), self.element)


class PbfSource(DataSource):
    """``spark.read.format("osm_pbf").option("element", "node" | "way" | "relation").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("element", "node")]

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"], self.options.get("element", "node"), int(self.options.get("run_bytes", 16 << 20)))


def read_osm_pbf(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    spark.dataSource.register(PbfSource)
    return {k: spark.read.format("osm_pbf").option("element", k).load(path) for k in SCHEMAS}


# ---------------------------------------------------------------- writing, for round trips and small extracts


def _encode(number: int, value) -> bytes:
    def varint(v: int) -> bytes:
        v &= (1 << 64) - 1
        out = bytearray()
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        return bytes([*out, v])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, list):
        value = b"".join(map(varint, value))
    return varint(number << 3 | 2) + varint(len(value)) + value


def _zigzag(values: list[int], delta: bool = True) -> list[int]:
    steps = [b - a for a, b in zip([0, *values], values)] if delta else values
    return [(v << 1) ^ (v >> 63) for v in steps]


def encode_pbf(nodes: list[tuple], ways: list[tuple], relations: list[tuple], block: int = 1000) -> bytes:
    """A small PBF file: rows as in the schemas, nodes as dense nodes."""

    def blob(kind: bytes, data: bytes) -> bytes:
        body = _encode(2, len(data)) + _encode(3, zlib.compress(data))
        header = _encode(1, kind) + _encode(3, len(body))
        return struct.pack(">I", len(header)) + header + body

    def primitive(make, rows: list) -> bytes:
        strings = {"": 0}
        index = lambda s: strings.setdefault(s, len(strings))
        group = make(rows, index)
        table = b"".join(_encode(1, s.encode()) for s in strings)
        return blob(b"OSMData", _encode(1, table) + _encode(2, group))

    def dense(rows, index) -> bytes:
        tags = [x for r in rows for x in [*(index(s) for t in r[3] for s in t), 0]]
        cell = lambda i: [round(r[i] * 1e7) for r in rows]
        return _encode(2, _encode(1, _zigzag([r[0] for r in rows])) + _encode(8, _zigzag(cell(1))) + _encode(9, _zigzag(cell(2))) + _encode(10, tags))

    tags_of = lambda tags, index: _encode(2, [index(k) for k, _ in tags]) + _encode(3, [index(v) for _, v in tags])
    way = lambda rows, index: b"".join(_encode(3, _encode(1, r[0]) + tags_of(r[2], index) + _encode(8, _zigzag(r[1]))) for r in rows)
    kinds = {"node": 0, "way": 1, "relation": 2}
    relation = lambda rows, index: b"".join(
        _encode(4, _encode(1, r[0]) + tags_of(r[2], index) + _encode(8, [index(m[2]) for m in r[1]]) + _encode(9, _zigzag([m[1] for m in r[1]])) + _encode(10, [kinds[m[0]] for m in r[1]])) for r in rows)
    out = blob(b"OSMHeader", _encode(4, b"OsmSchema-V0.6") + _encode(4, b"DenseNodes"))
    for rows, make in ((nodes, dense), (ways, way), (relations, relation)):
        for at in range(0, len(rows), block):
            out += primitive(make, rows[at : at + block])
    return out
