import io
import sqlite3
import struct
import zipfile
import zlib

import pytest

from quarrybed.operators import artifacts, browser
from quarrybed.sources import decoders as D
from quarrybed.sources import sqlite as S

T0 = 131_321_134_820_000_000
US0 = (T0 - D.FILETIME_1970) // 10


def u(n, size):
    return n.to_bytes(size, "little")


def usn2(name, usn, major=2):
    raw = name.encode("utf-16-le")
    ids = u((3 << 48) | 7, 8) + u((1 << 48) | 5, 8) if major == 2 else u(7, 8) + u(1, 8) + u(5, 8) + u(1, 8)
    head = 60 if major == 2 else 76
    body = u(major, 2) + u(0, 2) + ids + u(usn, 8) + u(T0, 8) + u(0x80000002, 4) + bytes(8) + u(32, 4) + u(len(raw), 2) + u(head, 2) + raw
    size = -(-(4 + len(body)) // 8) * 8
    return (u(size, 4) + body).ljust(size, b"\0")


def test_usn_journal_skips_gaps_and_damage():
    data = bytes(64) + usn2("a.txt", 1) + u(9999999, 4) + b"\2\0\0\0" + usn2("ö", 2, 3) + bytes(8) + usn2("cut", 3)[:-16]
    rows = list(D.usn_journal(data))
    assert [(r["usn"], r["file_name"], r["file_ref"], r["parent_ref"], r["time_micros"], r["reason"]) for r in rows] == [(1, "a.txt", "7-3", "5-1", US0, 0x80000002), (2, "ö", "1:7", "1:5", US0, 0x80000002)]


def test_recycle_bin_versions_and_failures():
    path = "C:\\x\\é.txt"
    v1 = u(1, 8) + u(9, 8) + u(T0, 8) + path.encode("utf-16-le").ljust(520, b"\0")
    v2 = u(2, 8) + u(9, 8) + u(T0, 8) + u(len(path) + 1, 4) + (path + "\0").encode("utf-16-le")
    for data in (v1, v2):
        (r,) = D.recycle_bin(data)
        assert (r["status"], r["original_path"], r["original_size"], r["deleted_micros"]) == ("recognized", path, 9, US0)
    assert next(D.recycle_bin(b"short"))["status"] == "failed" and next(D.recycle_bin(u(7, 8) + bytes(99)))["status"] == "failed"


def test_shimcache_layouts():
    p = "C:\\a.exe".encode("utf-16-le")
    win7 = (u(0xBADC0FEE, 4) + u(1, 4)).ljust(128, b"\0") + u(len(p), 2) + bytes(2) + u(160, 4) + u(0, 0) + u(T0, 8) + u(2, 4) + u(5, 8) + bytes(4) + p
    (r,) = D.shimcache(win7)
    assert (r["file_path"], r["modified_micros"], r["executed"]) == ("C:\\a.exe", US0, True)
    entry = b"10ts" + bytes(4) + u(2 + len(p) + 8, 4) + u(len(p), 2) + p + u(T0, 8)
    assert [r["file_path"] for r in D.shimcache(bytes(48) + entry + entry)] == ["C:\\a.exe"] * 2


def link(target=b"C:\\t.txt"):
    info_body = u(28, 4) + u(1, 4) + u(0, 4) + u(28, 4) + u(0, 4) + u(28 + len(target) + 1, 4) + target + b"\0\0"
    info = u(4 + len(info_body), 4) + info_body
    return (u(76, 4) + D.LINK_CLASS + u(2 | 8 | 128, 4) + u(32, 4) + u(T0, 8) * 3 + u(77, 4)).ljust(76, b"\0") + info + u(5, 2) + "..\\t.".encode("utf-16-le") + bytes(4)


def test_shell_link_and_custom_list():
    (r,) = D.shell_link(link())
    assert (r["status"], r["target"], r["relative_path"], r["created_micros"], r["target_size"]) == ("recognized", "C:\\t.txt", "..\\t.", US0, 77)
    assert next(D.shell_link(b"x" * 80))["status"] == "failed"
    rows = list(D.custom_destinations(b"head" + link() + b"mid!" + link(b"D:\\u")))
    assert [(r["ordinal"], r["target"]) for r in rows] == [(0, "C:\\t.txt"), (1, "D:\\u")]


def test_prefetch_plain_and_unknown():
    names = "\\A.DLL\0\\B.DLL\0".encode("utf-16-le")
    head = (u(30, 4) + b"SCCA").ljust(16, b"\0") + "APP.EXE".encode("utf-16-le").ljust(60, b"\0") + u(0xABCD, 4)
    data = bytearray(head.ljust(304, b"\0"))
    data[84:88], data[100:104], data[104:108], data[128:136], data[208:212] = u(304, 4), u(304, 4), u(len(names), 4), u(T0, 8), u(4, 4)
    (r,) = D.prefetch(bytes(data) + names)
    assert (r["executable"], r["run_count"], r["run_micros"], r["referenced_files"], r["path_hash"]) == ("APP.EXE", 4, [US0], ["\\A.DLL", "\\B.DLL"], "0x0000ABCD")
    assert next(D.prefetch(b"\x63\0\0\0SCCA" + bytes(200)))["status"] == "failed"


def test_compression():
    # two literals, then a reference 2 back of length 6: "abababab"
    chunk = bytes([0b100]) + b"ab" + u((1 << 12) | 3, 2)
    assert D.lznt1(u(0x8000 | 0x3000 | (len(chunk) - 1), 2) + chunk + u(0, 2)) == b"abababab"
    assert D.lznt1(u(0x3000 | 3, 2) + b"wxyz") == b"wxyz" and D.lznt1(b"") == b""
    lengths = [0] * 512
    lengths[ord("a")], lengths[ord("b")] = 1, 1
    table = bytes(lengths[2 * i] | lengths[2 * i + 1] << 4 for i in range(256))
    assert D.xpress_huffman(table + u(0b0101_0000_0000_0000, 2) + bytes(2), 4) == b"abab"


def test_compound_file_with_a_cycle():
    fat = [0xFFFFFFFD, 0xFFFFFFFE, 3, 2] + [0xFFFFFFFF] * 124
    entry = lambda name, kind, first, size: name.encode("utf-16-le").ljust(64, b"\0") + u(2 * len(name) + 2, 2) + bytes([kind, 0]) + bytes(48) + u(first, 4) + u(size, 8)
    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("big", 2, 2, 900) + bytes(256)
    head = bytearray(512)
    head[:8], head[30:34], head[48:52], head[56:60], head[60:64], head[68:72] = bytes.fromhex("d0cf11e0a1b11ae1"), u(9, 2) + u(6, 2), u(1, 4), u(100, 4), u(0xFFFFFFFE, 4), u(0xFFFFFFFE, 4)
    head[76:80], head[80:512] = u(0, 4), b"\xff" * 432
    data = bytes(head) + b"".join(u(x, 4) for x in fat) + directory + b"x" * 512 + b"y" * 512
    assert D.compound_streams(data)["big"] == b"x" * 512 + b"y" * 388
    assert next(D.automatic_destinations(b"no"))["status"] == "failed"


def test_xml_zip_word_mail():
    task = b'<?xml version="1.0"?><Task xmlns="u"><Principals><Principal><UserId>S-1-5-18</UserId></Principal></Principals><Triggers><BootTrigger/></Triggers><Actions><Exec><Command>c.exe</Command><Arguments>-x</Arguments></Exec></Actions></Task>'
    (r,) = D.scheduled_task(task)
    assert (r["principals"], r["triggers"], r["actions"]) == (["S-1-5-18"], ["BootTrigger"], ["c.exe -x"])
    assert next(D.scheduled_task(b"<!DOCTYPE x [<!ENTITY a 'b'>]><Task/>"))["status"] == "failed"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>there</w:t></w:r></w:p><w:p><w:t>End</w:t></w:p></w:document>')
        z.writestr("docProps/core.xml", "<c><title>T</title></c>")
        z.writestr("a.txt", "é" * 40_000)
    rows = list(D.word_document(buf.getvalue()))
    assert [(r["part_name"], r["text"]) for r in rows] == [("word/document.xml", "Hello\tthere\nEnd"), ("docProps/core.xml", "title: T")]
    members = [r for r in D.zip_members(buf.getvalue()) if r["member"] == "a.txt"]
    assert [r["segment_index"] for r in members] == [0, 1] and sum(len(r["text"].encode()) for r in members) >= 80_000
    assert next(D.zip_members(b"junk"))["status"] == "failed" and next(D.word_document(b"junk"))["status"] == "failed"
    (m,) = D.mail_message(b"From: A\r\n B <a@x.test>\r\nSubject: =?utf-8?q?caf=C3=A9?=\r\nContent-Transfer-Encoding: quoted-printable\r\nContent-Type: text/plain; charset=utf-8\r\n\r\none=20\r\n\r\ntwo\r\n" + b"x" * 2000)
    assert (m["from_header"], m["subject"], m["body_preview"][:7], m["body_truncated"]) == ("A B <a@x.test>", "café", "one\ntwo", True)


def test_image_segment_chunks():
    parts = [b"a" * 1024, b"b" * 1024]
    packed = [zlib.compress(parts[0]), parts[1] + u(zlib.adler32(parts[1]), 4)]
    section = lambda kind, nxt, body: kind.ljust(16, b"\0") + u(nxt, 8) + u(76 + len(body), 8) + bytes(44) + body
    at = 13
    volume = u(1, 4) + u(2, 4) + u(2, 4) + u(512, 4) + bytes(80)
    out = b"EVF\x09\x0d\x0a\xff\0".ljust(13, b"\0") + section(b"volume", at + 76 + len(volume), volume)
    start = len(out) + 76
    sectors = b"".join(packed)
    out += section(b"sectors", len(out) + 76 + len(sectors), sectors)
    table = u(2, 4) + bytes(4) + u(start, 8) + bytes(8) + u(1 << 31, 4) + u(len(packed[0]), 4)
    out += section(b"table", len(out) + 76 + len(table), table)
    out += section(b"done", len(out), b"")
    assert [(r["media_offset"], r["bytes"]) for r in D.image_chunks(out)] == [(0, parts[0]), (1024, parts[1])]


def test_small_decoders():
    assert D.mru_order(struct.pack("<4I", 2, 0, 0xFFFFFFFF, 5)) == [2, 0]
    assert D.sid(bytes([1, 2, 0, 0, 0, 0, 0, 5]) + u(21, 4) + u(500, 4)) == "S-1-5-21-500" and D.sid(b"") is None
    assert D.crc32c(b"123456789") ^ 0xFFFFFFFF == 0xE3069283
    assert next(D.user_assist(bytes(4) + u(3, 4) + bytes(52) + u(T0, 8) + bytes(4)))["last_run_micros"] == US0
    assert D.mixed_guid(bytes(range(16))) == "03020100-0504-0706-0809-0a0b0c0d0e0f"


@pytest.mark.parametrize("name", sorted(D.DECODERS))
def test_decoders_never_raise_and_run_on_frames(spark, name):
    import random

    rng = random.Random(5)
    decoder = D.DECODERS[name][0]
    seeds = [link(), usn2("a", 1), b"EVF\x09\x0d\x0a\xff\0" + bytes(90), bytes.fromhex("d0cf11e0a1b11ae1") + bytes(600), b"MAM\x04" + u(900, 4) + bytes(rng.randrange(256) for _ in range(900)), b"\x1e\0\0\0SCCA" + bytes(400), b"10ts" + bytes(40), b"<Task><x></Task>", b"PK\3\4junk"]
    blobs = [b"", b"\0", *seeds] + [bytes(rng.randrange(256) for _ in range(rng.randrange(600))) for _ in range(60)] + [s[: rng.randrange(len(s))] for s in seeds]
    for b in blobs:
        assert all(r.get("status") in ("recognized", "partial", "failed") for r in decoder(b))
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs[:12])] + [(99, None)], "id bigint, b binary")
    assert D.decode(df, name, "id", "b").where("source_id = 99").count() == 0


def test_sqlite_source_and_browser(spark, tmp_path):
    path = str(tmp_path / "History")
    db = sqlite3.connect(path)
    db.executescript("create table urls(id integer primary key, url text, title text, visit_count int, last_visit_time int); create table visits(id integer primary key, url int, visit_time int, from_visit int, transition int); create table keyword_search_terms(keyword_id int, url_id int, term text);")
    chrome = 11_644_473_600_000_000 + 1_600_000_000_000_000
    db.executemany("insert into urls values (?,?,?,?,?)", [(1, "https://a.test/x/f.pdf", " T ", 3, chrome), (2, "https://b.test/", None, 1, 0)])
    db.executemany("insert into visits values (?,?,?,?,?)", [(1, 1, chrome, 0, 1 | 0x20000000), (2, 2, chrome + 5, 1, 0), (3, 1, 0, 9, 8)])
    db.executemany("insert into keyword_search_terms values (?,?,?)", [(1, 1, "q"), (2, 1, "q")])
    db.commit()
    db.close()
    before = open(path, "rb").read()
    assert S.browser_family(path) == "chromium" and S.browser_family(__file__) is None
    visits = S.read_table(spark, path, "visits", partitions=2)
    urls = S.read_table(spark, path, "urls", "id bigint, url string, title string, typed_count bigint, last_visit_time bigint")
    assert urls.where("typed_count is null").count() == 2  # a column that the file lacks
    assert S.read_table(spark, path, "nothing", "id bigint").count() == 0
    got = {r.visit_id: r for r in browser.chromium_visits(visits, urls).collect()}
    assert got[2].referrer_url == "https://a.test/x/f.pdf" and got[1].visit_micros == 1_600_000_000_000_000 and got[3].visit_micros is None
    assert got[1].transition_type == "typed" and got[1].qualifiers == ["chain_end"] and got[2].display_name == "https://b.test/" and got[1].display_name == "T" and got[1].visit_source == "local"
    terms = S.read_table(spark, path, "keyword_search_terms", "rowid bigint, term string, url_id bigint")
    assert sorted(r.ordinal for r in browser.chromium_searches(terms, urls).collect()) == [1, 2]
    assert open(path, "rb").read() == before


def test_browser_other_kinds(spark):
    down = spark.createDataFrame([(1, "C:\\d\\f.zip", 1_600_000_000, 1_600_000_090, 50, 200, 4, 0, 20), (2, "x", 0, 5, 7, 7, 1, 99, 0)], "id bigint, target_path string, start_time bigint, end_time bigint, received_bytes bigint, total_bytes bigint, state bigint, danger_type bigint, interrupt_reason bigint")
    chains = spark.createDataFrame([(1, i, f"u{i}") for i in (2, 0, 1)] + [(1, 3, None)], "id bigint, chain_index int, url string")
    a, b = browser.chromium_downloads(down, chains, 2).orderBy("id").collect()
    assert (a.url_chain, a.original_url, a.final_url, a.chain_omitted) == (["u0", "u1"], "u0", "u2", 1)
    assert a.outcome == "interrupted at 50 of 200 bytes (25%) after 1m 30.0s - network_failed" and b.outcome == "complete - 7 bytes" and b.danger == "unknown (99)" and a.file_name == "f.zip"
    fill = spark.createDataFrame([("n", "v", 1)], "name string, value string, pair_id bigint")
    dates = spark.createDataFrame([(1, 0), (1, 5), (1, 3)], "pair_id bigint, date_created bigint")
    assert tuple(browser.chromium_autofill(fill, dates).first()) == ("n", "v", 2, 3, 5)
    login = spark.createDataFrame([("o", b"\1\2")], "origin_url string, password_value binary")
    assert browser.chromium_logins(login).select("ciphertext_hex", "ciphertext_bytes", "username").first() == ("0102", 2, None)
    nodes = spark.createDataFrame([(1, None, "Bar"), (2, 1, "F"), (3, 2, "P"), (4, 5, "l"), (5, 4, "m")], "node_id bigint, parent_id bigint, name string")
    assert {r.node_id: (r.depth, r.path) for r in browser.bookmark_paths(nodes).collect()} == {"1": (0, ""), "2": (1, "F"), "3": (2, "F/P"), "4": (-1, ""), "5": (-1, "")}
    safari = browser.safari_visits(spark.createDataFrame([(1, 7, "t", 0.5), (2, 7, "t", float("nan"))], "id bigint, history_item bigint, title string, visit_time double"), spark.createDataFrame([(7, "u")], "id bigint, url string"))
    assert [r.visit_micros for r in safari.orderBy("visit_id").collect()] == [978_307_200_500_000, None]
    stream = browser.activity_stream({"safari": safari, "download": browser.chromium_downloads(down)})
    assert {r.record_kind: r.records for r in browser.record_counts(stream).collect()} == {"safari": 2, "download": 2}


def test_artifact_rules(spark):
    obs = spark.createDataFrame(
        [("SOFTWARE", 1, "R\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon", "DefaultUserName", "Ann", None), ("SOFTWARE", 2, "R\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon", "DefaultDomainName", "CORP", None), ("SOFTWARE", 3, "R\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon", "AltDefaultUserName", "ann", None), ("SOFTWARE", 4, "R\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon", "AltDefaultDomainName", "corp", None), ("SYSTEM", 5, "C\\Services\\Tcpip\\Parameters", "Hostname", " box ", None), ("SYSTEM", 6, "D\\Services\\Tcpip\\Parameters", "HostName", "BOX", None), ("SYSTEM", 7, "D\\Services\\Tcpip\\Parameters", "Domain", "  ", None), (None, 8, None, None, None, None)],
        "hive string, ordinal int, key_path string, value_name string, value_data string, last_write_utc string",
    )
    assert [tuple(r) for r in artifacts.domain_accounts(obs).collect()] == [("Ann", "CORP", "CORP\\Ann")]
    assert [(r.lead_type, r.value, r.ordinal) for r in artifacts.registry_leads(obs).collect()] == [("host_or_domain_name", "box", 5)]
    assert list(artifacts.secrets_in('{"a": [{"db_password": "x"}], "b": {"TOKEN": 5}}')) and list(artifacts.secrets_in("export API_KEY=1\n# token=2\nmy.secret: 'v'\npassword=")) == [("my.secret", "v", "line 3")]
    assert list(artifacts.secrets_in("https://ann:pw%21@git.example/x\nhttps://git.example\n", "C:\\u\\.git-credentials")) == [("ann@git.example/x", "pw%21", "line 1")]
    assert list(artifacts.secrets_in("machine a.test login ann\n password p1 # note\ndefault login anonymous password p2", "/u/.netrc")) == [("ann@a.test", "p1", "line 2"), ("anonymous@default", "p2", "line 3")]
    assert list(artifacts.secrets_in("machine a.test password p1")) == [] and list(artifacts.secrets_in("password", "/u/.netrc")) == []
    assert list(artifacts.secrets_in('{"a": ' * 20_000 + '{"token": "t"}' + "}" * 20_000))[0][:2] == ("token", "t")
    assert list(artifacts.secrets_in("<a><Password>p</Password></a>")) == [("Password", "p", "Password")]
    df = spark.createDataFrame([("/home/u/.ssh", "id_rsa"), ("C:\\x", "Login Data"), ("/p/.aws", "credentials"), ("/p", "a.txt")], "p string, n string")
    got = df.select(artifacts.credential_store(df.p, df.n).alias("s"), artifacts.plaintext_secret_source(df.p, df.n).alias("b")).collect()
    assert [tuple(r) for r in got] == [("SSH private key", False), ("Browser saved-login store", False), ("AWS credential configuration", True), (None, False)]
