"""Packet tables and capture files <-> packet rows.

``read_packets`` reads packets in the fixed schema, as a table or as a stream, from
Parquet or from classic libpcap files.  Capture files come in through Spark's own ``binaryFile`` source, so any
path that Spark can open will do, and are decoded in Arrow batches; a file is one task's work and is
held by it, so captures are expected to be rolled (``write_captures`` rolls by rows and bytes).

``df.write.format("pcap").save(path)`` writes capture files of raw IP frames, each first under ``_staged`` and
moved into place when the whole write commits: what a failed or repeated task left is never read.  Its ``path``
must be a folder that all executors mount.  ``decode_frames`` decodes a ``BINARY`` frame column.

Decoding (S4): the length is that of the whole frame; IPv4 header length = IHL*4, IPv6 = 40; TCP adds data offset*4
(20 when 0), UDP/ICMP add 8; ICMP puts its type in ``dst_port`` and 0 in
``src_port``; the window is -1 unless TCP.  Non-IP frames are dropped.
"""
from __future__ import annotations

import ipaddress
import os
import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PACKET_SCHEMA = T.StructType([
    T.StructField("ts_us", T.LongType()), T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()), T.StructField("protocol", T.IntegerType()),
    T.StructField("length", T.IntegerType()), T.StructField("header_length", T.IntegerType()),
    T.StructField("window_size", T.IntegerType()), T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("ip_version", T.IntegerType())])

PCAP_MAGIC = 0xA1B2C3D4
LINKTYPE_ETHERNET, LINKTYPE_RAW = 1, 101
ROWS_A_BATCH = 10_000
BYTES_A_FILE = 32 << 20
#: What Spark's binary file source yields.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


# ---------------------------------------------------------------- S4 decode
def decode_frame(frame: bytes, ts_us: int, link: int = LINKTYPE_ETHERNET) -> tuple | None:
    """One Ethernet (or raw IP) frame -> packet tuple (PACKET_SCHEMA order), or None if not IP."""
    if link == LINKTYPE_RAW:
        ip = frame
        etype = {4: 0x0800, 6: 0x86DD}.get(frame[0] >> 4) if frame else None
    else:
        if len(frame) < 14:
            return None
        etype = struct.unpack("!H", frame[12:14])[0]
        off = 14
        if etype == 0x8100 and len(frame) >= 18:          # one VLAN tag
            etype = struct.unpack("!H", frame[16:18])[0]
            off = 18
        ip = frame[off:]
    length = len(frame)
    if etype == 0x0800 and len(ip) >= 20:
        ihl = (ip[0] & 0x0F) * 4
        proto = ip[9]
        src, dst = str(ipaddress.IPv4Address(ip[12:16])), str(ipaddress.IPv4Address(ip[16:20]))
        l4, hdr, ver = ip[ihl:], ihl, 4
    elif etype == 0x86DD and len(ip) >= 40:
        proto = ip[6]
        src, dst = str(ipaddress.IPv6Address(ip[8:24])), str(ipaddress.IPv6Address(ip[24:40]))
        l4, hdr, ver = ip[40:], 40, 6
    else:
        return None
    sport = dport = 0
    window, flags = -1, 0
    if ver == 4 and struct.unpack("!H", ip[6:8])[0] & 0x1FFF:  # a later fragment: its payload is no header
        return (ts_us, src, dst, sport, dport, proto, length, hdr, window, flags, ver)
    if proto == 6 and len(l4) >= 20:
        sport, dport = struct.unpack("!HH", l4[0:4])
        doff = (l4[12] >> 4) * 4 or 20
        flags = l4[13]
        window = struct.unpack("!H", l4[14:16])[0]
        hdr += doff
    elif proto == 17 and len(l4) >= 8:
        sport, dport = struct.unpack("!HH", l4[0:4])
        hdr += 8
    elif proto == 1 and ver == 4 and len(l4) >= 1:
        dport = l4[0]
        hdr += 8
    return (ts_us, src, dst, sport, dport, proto, length, hdr, window, flags, ver)


def parse_capture(content: bytes):
    """Packet tuples of one capture file; a record cut off at the end is left out."""
    if len(content) < 24:
        return
    magic = struct.unpack("<I", content[:4])[0]
    endian = "<" if magic in (0xA1B2C3D4, 0xA1B23C4D) else ">"
    nano = magic in (0xA1B23C4D, 0x4D3CB2A1)
    link = struct.unpack(endian + "I", content[20:24])[0]
    at, view = 24, memoryview(content)
    while at + 16 <= len(content):
        sec, frac, incl, _ = struct.unpack_from(endian + "IIII", content, at)
        at += 16
        if at + incl > len(content):
            return
        row = decode_frame(bytes(view[at : at + incl]), sec * 1_000_000 + (frac // 1000 if nano else frac), link)
        at += incl
        if row is not None:
            yield row


# ---------------------------------------------------------------- S3 encode
def _ip_bytes(ip: str) -> tuple[int, bytes]:
    a = ipaddress.ip_address(ip)
    return a.version, a.packed


def encode_packet(r) -> bytes:
    """Packet row -> raw IP frame carrying the same fields (payload zero-filled to ``length``)."""
    ver, src = _ip_bytes(r["src_ip"])
    _, dst = _ip_bytes(r["dst_ip"])
    proto = int(r["protocol"])
    if proto == 6:
        win = max(int(r["window_size"]), 0) if r["window_size"] is not None else 0
        l4 = struct.pack("!HHIIBBHHH", int(r["src_port"]), int(r["dst_port"]), 0, 0, 5 << 4,
                         int(r["tcp_flags"] or 0), win, 0, 0)
    elif proto in (1, 58):
        l4 = struct.pack("!BBHI", int(r["dst_port"]), 0, 0, 0)
    else:
        l4 = struct.pack("!HHHH", int(r["src_port"]), int(r["dst_port"]), 8, 0)
    if ver == 4:
        payload = b"\x00" * max(int(r["length"]) - 20 - len(l4), 0)
        ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(l4) + len(payload), 0, 0, 64, proto, 0, src, dst)
    else:
        payload = b"\x00" * max(int(r["length"]) - 40 - len(l4), 0)
        ip = struct.pack("!IHBB16s16s", 6 << 28, len(l4) + len(payload), proto, 64, src, dst)
    return ip + l4 + payload


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Writer(DataSourceWriter):
    """Each task writes files of its own name under ``_staged``; only a commit of the whole write moves them into place."""

    def __init__(self, path: str, rows: int, size: int = BYTES_A_FILE):
        self.path, self.rows, self.size, self.run = path.removeprefix("file://"), rows, size, uuid.uuid4().hex
        self.staged = os.path.join(self.path, "_staged", self.run)

    def write(self, iterator):
        os.makedirs(self.staged, exist_ok=True)
        names, fh, n = [], None, 0
        try:
            for row in iterator:
                if fh is None or n == self.rows or fh.tell() >= self.size:
                    if fh:
                        fh.close()
                    names.append(f"part-{uuid.uuid4().hex}.pcap")
                    fh, n = open(os.path.join(self.staged, names[-1]), "wb"), 0
                    fh.write(struct.pack("<IHHiIII", PCAP_MAGIC, 2, 4, 0, 0, 65535, LINKTYPE_RAW))
                frame, ts = encode_packet(row.asDict()), int(row["ts_us"])
                fh.write(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(frame), len(frame)) + frame)
                n += 1
        finally:
            if fh:
                fh.close()
        return _Written(names)

    def commit(self, messages):
        for m in messages:
            for name in m.names if m else ():
                os.replace(os.path.join(self.staged, name), os.path.join(self.path, name))
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        if os.path.isdir(self.staged):
            for name in os.listdir(self.staged):
                os.remove(os.path.join(self.staged, name))
            os.rmdir(self.staged)


class PcapDataSource(DataSource):
    """``format("pcap")``: write capture files of at most ``rows_per_file`` packets; one of ``bytes_per_file`` is not added to, as a reader holds a whole file."""

    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return PACKET_SCHEMA

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options.get("rows_per_file", 1_000_000)), int(self.options.get("bytes_per_file", BYTES_A_FILE)))


def register_capture_source(spark: SparkSession) -> None:
    spark.dataSource.register(PcapDataSource)


def write_captures(packets: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """S3 sink: capture files, time-sorted within each; the partitions of ``packets`` are written side by side."""
    register_capture_source(packets.sparkSession)
    packets.sortWithinPartitions("ts_us").write.format("pcap").option("rows_per_file", rows_per_file).mode("append").save(path)


def _parsed(batches):
    names = [f.name for f in PACKET_SCHEMA.fields]
    for pdf in batches:
        for content in pdf["content"]:
            rows = []
            for row in parse_capture(bytes(content)):
                rows.append(row)
                if len(rows) == ROWS_A_BATCH:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_packets(spark: SparkSession, path: str, kind: str = "pcap", streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Packets in ``PACKET_SCHEMA`` from capture files (``pcap``) or Parquet below ``path``, as a table or a stream.

    A Parquet packet table may have more columns; missing ones read as null.  An empty folder gives no packets.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if kind == "parquet":
        return reader.schema(PACKET_SCHEMA).parquet(path)
    if kind != "pcap":
        raise ValueError(f"unknown kind of packets: {kind}")
    files = reader.schema(FILE_SCHEMA).format("binaryFile").option("pathGlobFilter", "*.pcap").load(path)
    return files.select("content").mapInPandas(_parsed, PACKET_SCHEMA)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """S3 source: every capture file under ``path`` as packet rows."""
    return read_packets(spark, path)


def decode_frames(frames: DataFrame, frame_col: str = "frame", ts_col: str = "ts_us", link: int = LINKTYPE_ETHERNET) -> DataFrame:
    """Decode a BINARY frame column (Arrow batches through mapInPandas)."""
    def dec(batches):
        for pdf in batches:
            rows = [decode_frame(bytes(f), int(t), link) for f, t in zip(pdf[frame_col], pdf[ts_col])]
            rows = [r for r in rows if r is not None]
            yield pd.DataFrame(rows, columns=[f.name for f in PACKET_SCHEMA.fields])
    return frames.select(frame_col, ts_col).mapInPandas(dec, PACKET_SCHEMA)
