import os
import shutil
import subprocess

import pytest

from quarrybed import __main__ as cli
from quarrybed.operators.artifacts import registry_leads
from quarrybed.operators.usage import usage_records
from quarrybed.sources import decoders as D
from quarrybed.sources import extfs, hives


def u(n, size):
    return n.to_bytes(size, "little")


class Hive:
    """A hive laid out cell by cell."""

    def __init__(self):
        self.body = bytearray(32)

    def cell(self, content: bytes) -> int:
        at, size = len(self.body), -(-(len(content) + 4) // 8) * 8
        self.body += (-size).to_bytes(4, "little", signed=True) + content.ljust(size - 4, b"\0")
        return at

    def value(self, name, kind, raw):
        where, size = (int.from_bytes(raw.ljust(4, b"\0"), "little"), len(raw) | 0x80000000) if len(raw) <= 4 else (self.cell(raw), len(raw))
        return self.cell(b"vk" + u(len(name), 2) + u(size, 4) + u(where, 4) + u(kind, 4) + u(1, 2) + bytes(2) + name.encode())

    def key(self, name, values=(), below=()):
        vs = self.cell(b"".join(u(v, 4) for v in values)) if values else 0xFFFFFFFF
        ks = self.cell(b"lh" + u(len(below), 2) + b"".join(u(k, 4) + bytes(4) for k in below)) if below else 0xFFFFFFFF
        nk = bytearray(76)
        nk[:4], nk[4:12], nk[20:24], nk[28:32], nk[36:40], nk[40:44], nk[72:74] = b"nk\x20\0", u(131_321_134_820_000_000, 8), u(len(below), 4), u(ks, 4), u(len(values), 4), u(vs, 4), u(len(name), 2)
        return self.cell(bytes(nk) + name.encode())

    def bytes(self, root):
        return (b"regf".ljust(36, b"\0") + u(root, 4)).ljust(4096, b"\0") + bytes(self.body)


def test_registry_hive(spark):
    h = Hive()
    host = h.value("Hostname", 1, "box\0".encode("utf-16-le"))
    number = h.value("N", 4, u(77, 4))
    many = h.value("M", 7, "a\0b\0\0".encode("utf-16-le"))
    params = h.key("Parameters", [host, number, many])
    tcp = h.key("Tcpip", (), [params])
    root = h.key("ROOT", (), [h.key("Services", (), [tcp])])
    data = h.bytes(root)
    rows = list(hives.registry_hive(data))
    assert [(r["key_path"], r["value_name"], r["value_data"]) for r in rows] == [("ROOT\\Services\\Tcpip\\Parameters", "Hostname", "box"), ("ROOT\\Services\\Tcpip\\Parameters", "N", "77"), ("ROOT\\Services\\Tcpip\\Parameters", "M", "a; b")]
    assert next(hives.registry_hive(b"none"))["status"] == "failed" and list(hives.registry_hive(data[:4200])) == []
    df = D.decode(spark.createDataFrame([(1, data)], "id bigint, b binary"), "registry_hive", "id", "b")
    obs = df.selectExpr("'SYSTEM' as hive", "1 as ordinal", "key_path", "value_name", "value_data", "'' as last_write_utc")
    assert [r.value for r in registry_leads(obs).collect()] == ["box"]


def volume():
    block = bytearray(40 * 1024)

    def put(at, b):
        block[at : at + len(b)] = b

    put(1024, u(32, 4) + u(40, 4))
    put(1024 + 20, u(1, 4) + u(0, 4))
    put(1024 + 40, u(32, 4))
    put(1024 + 56, u(0xEF53, 2))
    put(1024 + 76, u(1, 4))
    put(1024 + 88, u(128, 2))
    put(2 * 1024 + 8, u(5, 4))  # inode table at block 5

    def inode(n, mode, size, first, extent):
        body = bytearray(128)
        body[0:2], body[4:8], body[16:20] = u(mode, 2), u(size, 4), u(1_600_000_000, 4)
        if extent:
            body[32:36] = u(0x80000, 4)
            body[40:64] = u(0xF30A, 2) + u(1, 2) + u(4, 2) + u(0, 2) + u(0, 4) + u(0, 4) + u(-(-size // 1024), 2) + u(0, 2) + u(first, 4)
        else:
            for i in range(-(-size // 1024)):
                body[40 + 4 * i : 44 + 4 * i] = u(first + i, 4)
        put(5 * 1024 + (n - 1) * 128, bytes(body))

    def entry(n, name, last=0):
        raw = name.encode()
        return (u(n, 4) + u(last or 8 + -(-len(raw) // 4) * 4, 2) + u(len(raw), 1) + b"\0" + raw).ljust(8 + -(-len(raw) // 4) * 4, b"\0")

    inode(2, 0x41ED, 1024, 20, True)
    inode(12, 0x41ED, 1024, 21, False)
    inode(13, 0x81A4, 1500, 22, True)
    inode(14, 0x81A4, 2000, 25, False)
    put(20 * 1024, entry(2, ".") + entry(2, "..") + entry(12, "sub") + entry(13, "a.txt", 1024 - 36))
    put(21 * 1024, entry(12, ".") + entry(2, "loop") + entry(14, "b", 1024 - 24))
    put(22 * 1024, b"A" * 1500)
    put(25 * 1024, b"B" * 2000)
    return bytes(block)


def test_ext_volume():
    rows = {r["path"]: r for r in extfs.ext_volume(volume())}
    assert {p: (r["kind"], r["size_bytes"]) for p, r in rows.items()} == {"/sub": ("directory", 1024), "/a.txt": ("file", 1500), "/sub/loop": ("directory", 1024), "/sub/b": ("file", 2000)}
    v = extfs.Volume(volume())
    assert v.read(v.inode(13)) == b"A" * 1500 and v.read(v.inode(14)) == b"B" * 2000 and rows["/a.txt"]["extents"] == [[0, 22, 2]]
    assert rows["/a.txt"]["modified_micros"] == 1_600_000_000_000_000
    assert next(extfs.ext_volume(b"x" * 5000))["status"] == "failed"


@pytest.mark.skipif(not shutil.which("mke2fs"), reason="no tool to make a volume")
@pytest.mark.parametrize("kind", ["ext2", "ext4"])
def test_made_volume(tmp_path, kind):
    src = tmp_path / "src"
    (src / "d" / "e").mkdir(parents=True)
    (src / "d" / "big.bin").write_bytes(os.urandom(700_000))
    (src / "d" / "e" / "ö.txt").write_text("hello")
    image = tmp_path / "v.img"
    subprocess.run(["mke2fs", "-q", "-t", kind, "-b", "1024", "-d", str(src), str(image), "8M"], check=True, timeout=60)
    data = image.read_bytes()
    rows = {r["path"]: r for r in extfs.ext_volume(data)}
    v = extfs.Volume(data)
    for name in ("d/big.bin", "d/e/ö.txt"):
        assert v.read(v.inode(rows["/" + name]["inode"])) == (src / name).read_bytes()
    assert rows["/d/e"]["kind"] == "directory" and "/lost+found" in rows


def test_usage(spark):
    net = spark.createDataFrame([(1, 5, 7, "2020-01-01", 10)], "record_id bigint, app_id bigint, user_id bigint, timestamp string, bytes_sent bigint")
    app = spark.createDataFrame([(2, 6, 5, "1601-01-01 00:00"), (3, 9, None, "")], "record_id bigint, app_id bigint, user_id bigint, timestamp string")
    ids = spark.createDataFrame([(5, "\\Device\\HarddiskVolume3\\a.exe"), (6, "!!svc.exe!2020!1[Dns]"), (7, "S-1-5-18")], "id bigint, name string")
    got = {r.record_id: (r.provider, r.app_name, r.user_sid, r.timestamp) for r in usage_records({"network": net, "app": app}, ids).collect()}
    assert got == {1: ("network", "C:\\a.exe", "S-1-5-18", "2020-01-01"), 2: ("app", "svc.exe [Dns]", None, None), 3: ("app", "ID #9", None, None)}


def test_command_line(tmp_path, capsys, spark):
    assert cli.main(["queries"]) == 0 and "p5_found" in capsys.readouterr().out
    assert cli.main(["decoders"]) == 0 and "registry_hive" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "x", "y"]) == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "v.img").write_bytes(volume())
    assert cli.main(["decode", "ext_volume", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert cli.main(["search-raw", str(tmp_path / "in" / "v.img"), "a.TXT", str(tmp_path / "hits")]) == 0
    assert [r.offset for r in spark.read.parquet(str(tmp_path / "hits")).collect()] == [volume().index(b"a.txt")]


@pytest.mark.parametrize("decoder", [hives.registry_hive, extfs.ext_volume])
def test_damage_never_raises(decoder):
    import random

    rng = random.Random(10)
    for whole in (volume(), Hive().bytes(32)):
        for _ in range(60):
            b = bytearray(whole)
            for _ in range(30):
                b[rng.randrange(len(b))] = rng.randrange(256)
            assert len(list(decoder(bytes(b[: rng.randrange(len(b))])))) >= 0
