"""Capture files: staged writes, rolled files, hand-made frames with known answers, damaged files."""
import os
import struct

from netlake.sources import capture as cap

ETH = bytes(12)


def v4(proto, l4, total=None, ihl=5, frag=0):
    total = total or ihl * 4 + len(l4)
    return struct.pack("!BBHHHBBH4s4s", 0x40 | ihl, 0, total, 0, frag, 64, proto, 0, bytes([192, 0, 2, 1]), bytes([192, 0, 2, 9])) + bytes(ihl * 4 - 20) + l4


def test_frames_with_known_answers():
    tcp = struct.pack("!HHIIBBHHH", 1234, 80, 0, 0, 6 << 4, 0x12, 500, 0, 0) + bytes(4)
    # 14 + 20 + 24 bytes on the wire, then padded to the least Ethernet size
    got = cap.decode_frame(ETH + b"\x08\x00" + v4(6, tcp) + bytes(2), 7)
    assert got == (7, "192.0.2.1", "192.0.2.9", 1234, 80, 6, 60, 44, 500, 0x12, 4)
    udp = struct.pack("!HHHH", 53, 5353, 8, 0)
    assert cap.decode_frame(ETH + b"\x81\x00\x00\x05\x08\x00" + v4(17, udp, ihl=6), 8) == (8, "192.0.2.1", "192.0.2.9", 53, 5353, 17, 50, 32, -1, 0, 4)
    assert cap.decode_frame(ETH + b"\x08\x00" + v4(17, udp, frag=3), 9)[3:8] == (0, 0, 17, 42, 20)
    six = struct.pack("!IHBB", 6 << 28, 8, 17, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02"
    assert cap.decode_frame(ETH + b"\x86\xdd" + six + udp, 1) == (1, "::1", "::2", 53, 5353, 17, 62, 48, -1, 0, 6)
    assert cap.decode_frame(six + udp, 1, cap.LINKTYPE_RAW)[6] == 48
    assert cap.decode_frame(ETH + b"\x08\x06" + bytes(28), 1) is None and cap.decode_frame(b"", 1) is None and cap.decode_frame(b"", 1, cap.LINKTYPE_RAW) is None


def test_cut_off_and_foreign_files():
    frame = ETH + b"\x08\x00" + v4(1, b"\x08" + bytes(7))
    head = struct.pack(">IHHiIII", cap.PCAP_MAGIC, 2, 4, 0, 0, 65535, 1)
    one = struct.pack(">IIII", 5, 6, len(frame), len(frame)) + frame
    assert [r[0] for r in cap.parse_capture(head + one + one)] == [5_000_006] * 2
    assert len(list(cap.parse_capture(head + one + one[:-1]))) == 1 and not list(cap.parse_capture(b"")) and not list(cap.parse_capture(head))
    nano = struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 5, 6_000, len(frame), len(frame)) + frame
    assert [r[0] for r in cap.parse_capture(nano)] == [5_000_006]


def test_staged_write_and_read(spark, tmp_path):
    rows = [(k * 1000, "10.0.0.1", "10.0.0.2", k, 80, 6, 60, 40, 5, 2, 4) for k in range(95)]
    df = spark.createDataFrame(rows, cap.PACKET_SCHEMA).repartition(2)
    path = str(tmp_path / "cap")
    cap.write_captures(df, path, rows_per_file=20)
    names = [n for n in os.listdir(path) if n.endswith(".pcap")]
    assert len(names) >= 5 and not os.listdir(os.path.join(path, "_staged"))
    # what a task that never committed left behind is not read
    left = os.path.join(path, "_staged", "dead")
    os.makedirs(left)
    with open(os.path.join(path, names[0]), "rb") as a, open(os.path.join(left, "part-x.pcap"), "wb") as b:
        b.write(a.read())
    assert sorted(tuple(r) for r in cap.read_packets(spark, path).collect()) == rows
    empty = str(tmp_path / "none")
    os.makedirs(empty)
    assert cap.read_packets(spark, empty).count() == 0
    df.write.parquet(str(tmp_path / "table"))
    assert sorted(tuple(r) for r in cap.read_packets(spark, str(tmp_path / "table"), "parquet").collect()) == rows


def test_abort_clears_its_own_files(tmp_path):
    w = cap._Writer(str(tmp_path), 10)
    w.write(iter([]))
    assert os.path.isdir(w.staged)
    w.abort([])
    assert not os.path.isdir(w.staged)


def test_files_are_rolled_by_bytes(spark, tmp_path, monkeypatch):
    rows = [(k * 1000, "10.0.0.1", "10.0.0.2", k, 80, 6, 1400, 40, 5, 2, 4) for k in range(60)]
    monkeypatch.setattr(cap, "BYTES_A_FILE", 20_000)
    got = []

    class Row(tuple):
        def asDict(self):
            return dict(zip((f.name for f in cap.PACKET_SCHEMA.fields), self))

        def __getitem__(self, name):
            return self.asDict()[name]
    writer = cap.PcapDataSource({"path": str(tmp_path)}).writer(cap.PACKET_SCHEMA, False)
    writer.commit([writer.write(iter(map(Row, rows)))])
    for name in (n for n in os.listdir(tmp_path) if n.endswith(".pcap")):
        content = (tmp_path / name).read_bytes()
        assert len(content) < 20_000 + 1500
        got += cap.parse_capture(content)
    assert sorted(got) == rows
