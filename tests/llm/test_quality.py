import random

import pytest

from quarrybed.llm.quality import STATS, describe, gibberish, quality_stats

COMMON = frozenset("the and of in is are it to was we not by der die das und ist wir nicht".split())
PROSE = "The drive was sealed in the lab and it is not clear who opened it. We found two copies of the report in the archive."
rng = random.Random(9)
CASES = [
    (PROSE, "prose"), (PROSE.lower().replace(".", ""), "prose"), ("Ann: the drive is in the lab\nBo: it was not sealed by the team\nAnn: we are to open it and look", "prose"),
    (PROSE + "\n- one item\n- two items\n", "prose"), ("[10:12] Ann: the drive is in the lab\n[10:13] Bo: it was not sealed by us", "prose"), (PROSE.replace("o", "0").replace("t", "1"), "prose"),
    ("- draft contract\n- payroll sheet\n    - chat backup\n- source tree", "list"), ("\n".join(f"{i}. We found the report in the archive and it is here." for i in range(1, 9)), "list"),
    ("memory card\nbackup drive\nlab tower (older)\nphone image\nfile server", "list"), ("C:\\a\\b\\dump_1.txt\n/home/x/list_2.pdf\n\\Volume\\tmp\\c.log", "list"), ("[x] older mail store\n[ ] draft contract", "list"),
    ("id\tsize\tname\n1\t22\ta.txt\n2\t33\tb.txt", "table"), ("a,b,c,d\n1,2,3,x.txt\n4,5,6,y.txt", "table"), ("1 | 2 | ok\n3 | 4 | no", "table"), ("time=1 size=2 name=a.b\ntime=3 size=4 name=c.d", "table"),
    ("2021-01-01T10:00:00Z INFO  [x] opened id=1\n2021-01-01T10:00:01Z WARN  [y] closed id=2", "table"), ("a.txt       123  01.02.2020 10:00  ok\nb.txt      4567  01.02.2020 10:01  no", "table"),
    ("", "junk"), (" \n\t ", "junk"), (None, "junk"), ("open " * 200, "junk"), ("null\n" * 90, "junk"), ("=" * 30 + "\n" + "=" * 30, "junk"), ("loading...\n" * 40, "junk"),
    ("\n".join("".join(rng.choice("ABCDEFabcdefXYZxyz0123456789+/") for _ in range(76)) for _ in range(12)), "junk"),
    (" ".join("".join(rng.choice("bcdfghjklm%$#@!~^&*") for _ in range(7)) for _ in range(60)), "junk"),
    (" ".join(rng.choice(["stife", "vosli", "pramo", "karen", "delcho", "wino", "tagu"]) + rng.choice(["ta", "mo", "bre", "zan", "lo"]) for _ in range(90)), "junk"),
    ("哰嚬廩唕哰厣廩典嚬勅勅" * 20, "junk"),
]


@pytest.mark.parametrize("text, want", CASES, ids=range(len(CASES)))
def test_classes(text, want):
    assert describe(text, COMMON)[-1] == want


def test_statistics():
    s = dict(zip(("n", "mean", "sym", "ends", "common", "dup_line", "dup_par", "boilerplate", "top", "distinct"), describe("The lab.\nThe lab.\n\nIt is it", COMMON)))
    assert (s["n"], s["mean"], s["dup_line"], s["ends"]) == (7, round(18 / 7, 6), round(1 / 3, 6), round(2 / 3, 6))
    assert s["common"] == round(5 / 7, 6) and s["distinct"] == round(4 / 7, 6) and s["sym"] == round(2 / 20, 6)
    assert gibberish("xKq7Pz9") and not gibberish("memo_1160.lnk") and not gibberish("Report")


def test_frames(spark):
    df = spark.createDataFrame([(1, PROSE, "x"), (2, None, "x"), (None, "", "x"), (4, "word and the text of it. " * 20_000, "x")], "doc_id bigint, text string, text_class string")
    got = {r.record_id: (r.n_words, r.text_class) for r in quality_stats(df, ["the", "and", "of", "is", "it", None, "a"]).collect()}
    assert got[2] == (0, "junk") and got[None] == (0, "junk") and got[4][0] == 120_000 and got[1][1] == "prose"
    assert quality_stats(df.where("false"), []).count() == 0


def test_the_class_needs_no_other_column():
    texts = ["The cat sat on the mat. " * k for k in (1, 3, 40)] + ["a b c d e f g h", "ab ab ab ab ab ab ab x", "qzxkjw vbnmtrp xcvbnmk wrtpsdf " * 9, "- one\n- two\n- three", "a | b | c\n1 | 2 | 3", "", " ", "word", "one two three one two three one two three four"]
    common = frozenset({"the", "on", "one", "two"})
    assert [describe(t, common)[-1] for t in texts] == [describe(t, common, False)[-1] for t in texts]
    stats = dict(zip((n for n, _ in STATS), describe("plain words and zzkqjwx bcdfghj here", common)))
    assert stats["noise_share"] > 0.2
