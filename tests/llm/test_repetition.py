import random

import pytest

from quarrybed.llm.quality import describe, looped

COMMON = frozenset("the and of in is are it to was we not by".split())
ONE = "The drive was sealed in the lab and it is not clear who opened the archive by then."
LINES = ["We found two copies of the report in the lab.", "It is not clear who sealed the drive.", "The archive was opened by the examiner and it was copied."]
PARAGRAPH = "\n".join(LINES)
rng = random.Random(5)
ITEMS = ["chat backup", "draft contract", "payroll sheet", "photo archive", "source tree", "travel invoice", "mail store"]


def prose(n):
    """Sentences that are drawn from a stock in any order, as chats and templates do."""
    return " ".join(f"The {rng.choice(ITEMS)} was {rng.choice(('copied', 'sealed', 'opened', 'moved'))} by the {rng.choice(('lab', 'team', 'owner', 'clerk'))} and it is {rng.choice(('late', 'clear', 'open', 'done'))}." for _ in range(n))


@pytest.mark.parametrize("text", [
    " ".join([ONE] * 50), " ".join([ONE] * 4), "\n".join([ONE] * 5), "\n".join(LINES * 300), "\n".join(LINES * 4), "\n\n".join([PARAGRAPH] * 6),
    "\n".join(rng.choice(LINES) for _ in range(90)), "\n\n".join(rng.choice(LINES) for _ in range(60)), "\n".join(["memory card"] * 5),
    "1 | a disk | in the lab | of the team | sealed | not copied | by whom\n" * 60, "\n".join([ONE] * 20 + [PARAGRAPH]), "- " + "\n- ".join(ITEMS[:4] * 80), prose(1) * 200,
])
def test_repetition_is_junk(text):
    assert describe(text, COMMON)[-1] == "junk"


@pytest.mark.parametrize("text, want", [
    (ONE, "prose"), (ONE + " " + ONE, "prose"), ("\n".join(LINES * 2), "prose"), (prose(300), "prose"), ("\n--\n".join([ONE, *LINES, prose(9)] + [prose(2) for _ in range(9)]) + "\n--" * 60, "prose"),
    ("\n".join(f"{i}. {ONE}" for i in range(40)), "list"), ("\n".join("- " + rng.choice(ITEMS) for _ in range(600)), "list"),
    ("\n".join(f"2021-01-01T10:00:{i:02}Z INFO [x] the disk was opened id={i * 7919} rc=1" for i in range(60)), "table"), ("\n".join(f"Ann: {x}\nBo: it was not so" for x in prose(30).split(". ")), "prose"),
])
def test_other_texts_keep_their_class(text, want):
    assert describe(text, COMMON)[-1] == want


def test_share_of_loops():
    words = [f"w{i:02}" for i in range(40)]
    assert looped(" ".join(words * 10)) == 0.9 and looped(" ".join(words * 3)) == 0.0 and looped("") == 0.0
