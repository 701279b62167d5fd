"""Per-document text statistics, and from them whether a text is natural prose, a list, a table or junk.

One pass over each text gives word, line, paragraph and repetition statistics; the characters of each line are counted
as list item, record, prose or noise. The class follows from combined rules on these shares; repeated lines, paragraphs and
runs of words (boilerplate) make junk. Every text is judged on its
own and read whole, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import nlargest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ITEM = re.compile(r"\s*(?:(?:--|[-*•–—·‣◦▪+o→»])\s+|\[[ xX✓]?\]\s+|\(?(?:\d{1,4}(?:\.\d{1,3})*|[A-Za-z]|[ivxIVX]{1,5})[.)]\s+)\S")
_LOG = re.compile(r"\s*\[?(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?|\d\d/\w{3}/\d{4}:\d\d:\d\d:\d\d|[A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d)")
_CHAT = re.compile(r"\s*(?:\[?\d{1,2}:\d\d(?::\d\d)?\]?\s*)?<?[A-ZÀ-Þ][\w'’.-]{0,24}>?: \S")
_PAIR = re.compile(r"(?:^|[\s;,|])[A-Za-z_]\w*=[^\s=]*(?=\s|$|[;,|])")
_COLUMNS = re.compile(r"\S {2,}\S.*\S {2,}\S|\S {6,}\d")
_RULES = re.compile(r"[\s|+:=-]+$")
_FIELDS = re.compile(r"[\w.\-]+$")
_STRUCTURE = re.compile(r"[/\\]|\.\w{2,4}$")
_ASCII = re.compile(r"[\x00-\x7f]+")
_SPLIT = re.compile(r"[\s|;,=/\\]+")
_NOT_ALNUM = re.compile(r"[\W_]+")
_END = (".", "!", "?", "…", ":", ";", '"', "”", "»", ")")

STATS = (
    ("n_words", "bigint"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("terminal_line_share", "double"), ("common_word_share", "double"), ("duplicate_line_share", "double"), ("duplicate_paragraph_share", "double"), ("boilerplate_share", "double"), ("top_ngram_coverage", "double"), ("distinct_word_share", "double"), ("list_share", "double"), ("table_share", "double"), ("noise_share", "double"), ("text_class", "string"),
)


def _is_record(line: str) -> bool:
    bars = line.count("|")
    if line.count("\t") >= 2 or line.count(" | ") >= 2 or bars >= 3 and line.count(" ") <= 2 * bars:
        return True
    for sep in (";", ","):
        n = line.count(sep)
        # separators of records are not followed by blanks
        if n >= 3 and line.count(sep + " ") * 2 < n and line.count(" ") <= 2 * n:
            return True
    return bool(_LOG.match(line)) or len(_PAIR.findall(line)) >= 2 or bool(_COLUMNS.search(line.strip()))


_PARTS = re.compile(r"[^\W\d_]+")
_VOWEL = re.compile(r"[aeiouyà-ÿ]")
_RUN = re.compile(r"[bcdfghjklmnpqrstvwxz]{6,}")
_PLAIN = re.compile(r"[A-Za-z]?[a-z]{1,31}")
_DIGITS = re.compile(r"[\W\d_]+")


@lru_cache(maxsize=262_144)
def gibberish(token: str) -> bool:
    """Whether a token is no word and no name made of words: most of its letters and digits stand in no plausible part.

    A plausible part has one case (or a leading capital), vowels unless it is very short, and no run of six consonants.
    """
    if _PLAIN.fullmatch(token):
        return len(token) > 4 and not _VOWEL.search(token.lower()) or bool(_RUN.search(token))
    alpha = good = 0
    total = len(_NOT_ALNUM.sub("", token))
    for part in _PARTS.findall(token):
        alpha += len(part)
        low = part.lower()
        if len(part) < 3 and len(part) < total or len(part) > 32 or not part.isascii() and max(part) > "ɏ":
            continue
        if (part == low or part.isupper() or part[1:] == low[1:]) and (len(part) < 5 or _VOWEL.search(low)) and not _RUN.search(low):
            good += len(part)
    return total > 0 and good < 0.4 * alpha + 0.1 * total


def _line_kind(line: str, common: frozenset[str]) -> str:
    if line.count("\t") >= 2:
        return "table"
    if _ITEM.match(line):
        return "list"
    if _CHAT.match(line):
        return "prose"
    if _is_record(line):
        return "table"
    s = line.strip()
    if _RULES.fullmatch(s):
        return "noise"
    if len(s) <= 90 and not s.endswith(_END[:6]):
        parts = len(s.split())
        words = WORD.findall(s.lower()) if parts <= 7 else ()
        if words and parts <= 4 and _STRUCTURE.search(s):
            return "list"
        if words:
            known = sum(w in common for w in words)
            if known == 0 or (len(words) >= 4 and known / len(words) <= 0.25 and len(s) < 50):
                return "bare"
    return "prose"


#: Share of the characters from which on repetition makes a text junk: as if all of it stood there four times.
REPEATED = 0.75


def _again(weights: dict[str, int]) -> float:
    """Share of the characters in lines or paragraphs that stood before in the text: its boilerplate."""
    return 1 - sum(map(len, weights)) / max(1, sum(len(x) * k for x, k in weights.items()))


def looped(text: str) -> float:
    """Share of the characters in runs of tokens that stood before, or 0 where it lies below ``REPEATED``.

    A run has 24 tokens, fewer in short texts: a text in a loop is one long repeat, while lists, chats and phrases drawn
    again and again from the same stock seldom come in the same order for so long. Tokens hold digits and marks, so records
    and numbered items that differ in a number are different.
    """
    tokens = text.lower().split()
    size = sum(map(len, tokens))
    if len(tokens) < 8 or sum(map(len, set(tokens))) > (1 - REPEATED) * size:
        return 0.0
    n = min(24, max(5, len(tokens) // 3))
    seen, covered, upto = set(), 0, 0
    for i, gram in enumerate(zip(*(tokens[k:] for k in range(n)))):
        if gram in seen:
            covered += sum(map(len, tokens[max(i, upto) : i + n]))
            upto = i + n
        else:
            seen.add(gram)
    return covered / size if covered >= REPEATED * size else 0.0


def _noise(text: str) -> float:
    """Share of the characters in tokens that are no words."""
    weights = Counter(t for t in _SPLIT.split(text) if t)
    judged = [(len(t) * k, t) for t, k in weights.items() if t.isalpha() or len(_DIGITS.sub("", t)) >= 0.3 * len(t)]
    return sum(k for k, t in judged if gibberish(t)) / max(1, sum(k for k, _ in judged))


def describe(text: str | None, common: frozenset[str], every: bool = True) -> tuple:
    """The values of ``STATS`` for one text, each of them measured; without ``every`` only the class is meant, and the n-gram
    coverage and the noise share are measured only where a rule reads them and could hold, which gives the same class. Null, empty and blank texts have no words, zero shares and
    class junk.

    ``noise_share`` is the share of the characters in tokens that are no words; what it says counts where common words are
    few or, among records, where symbols or letters are strange."""
    if not text or not text.strip():
        return (0, *[0.0] * (len(STATS) - 2), "junk")
    words = WORD.findall(text.lower())
    n = len(words)
    counts = Counter(words)
    chars = sum(len(w) * k for w, k in counts.items())
    lines = [x for x in text.split("\n") if x.strip()]
    repeated_lines = Counter(x.strip() for x in lines)
    paragraphs = Counter(p.strip() for p in re.split(r"\n\s*\n", text) if p.strip())
    size = len(text) - sum(map(text.count, " \n\t\r"))
    alnum = len(_NOT_ALNUM.sub("", text))
    symbols = (size - alnum) / max(1, size)
    longer = {w: k for w, k in counts.items() if len(w) > 1}
    known = sum(k for w, k in longer.items() if w in common) / max(1, sum(longer.values()))
    top = 0.0
    # an n-gram covers no more than its words do
    if n >= 6 and (every or sum(nlargest(3, (len(w) * k for w, k in counts.items()))) >= 0.5 * chars):
        gram, k = Counter(zip(words, words[1:], words[2:])).most_common(1)[0]
        top = min(1.0, k * sum(map(len, gram)) / max(1, chars)) if k > 1 else 0.0
    # lines, each different one judged once
    shares: Counter[str] = Counter()
    marks = 0
    for line, k in repeated_lines.items():
        what = _line_kind(line, common)
        shares[what] += k * len(line)
        if what == "list" and _ITEM.match(line):
            marks += k
    total = max(1, sum(shares.values()))
    if len(lines) < 3 and shares["bare"] * 2 > total:  # one or two bare lines make no list
        shares["prose"] += shares.pop("bare")
    listed, table = (shares["list"] + shares["bare"]) / total, shares["table"] / total
    strange = symbols > 0.3 or not text.isascii() and len(_ASCII.sub("", text)) > 0.1 * size
    read = strange if table > 0.5 else known < 0.3
    noise = _noise(text) if every or read else 0.0
    gib = noise if read else 0.0
    ends = sum(x.rstrip().endswith(_END) for x in lines) / len(lines)
    distinct = len(counts) / max(1, n)
    few = n >= 8 and (len(counts) <= 3 or sum(k for _, k in counts.most_common(4)) >= 0.9 * n)
    marked = shares["list"] / total > 0.5 and bool(marks * 2 > len(lines))
    dup_lines, dup_paragraphs = 1 - len(repeated_lines) / len(lines), 1 - len(paragraphs) / max(1, sum(paragraphs.values()))
    # items of lists repeat in any order, records only in their words
    again = looped(text) >= REPEATED
    by_lines, by_paragraphs = _again(repeated_lines), _again(paragraphs)
    boilerplate = max(by_lines, by_paragraphs)
    if not marked and listed <= 0.5 and boilerplate >= REPEATED:
        again |= dup_lines >= 0.5 and by_lines >= REPEATED or dup_paragraphs >= 0.5 and by_paragraphs >= REPEATED
    if not marked and listed <= 0.5:
        again |= table <= 0.5 and top >= 0.5
    if table > 0.5 and strange and known < 0.2 and (gib > 0.5 or symbols > 0.45):
        kind = "junk"
    elif again:
        kind = "junk"
    elif table > 0.5 and n and not few:
        kind = "table"
    elif not marked and (few or n < size / 60 or (len(repeated_lines) <= 2 and len(lines) >= 6)):
        kind = "junk"
    elif marked:
        kind = "list"
    elif known < 0.2 and (gib > 0.5 or symbols > 0.3) or known < 0.3 and gib > 0.6:
        kind = "junk"
    elif listed > 0.5:
        kind = "list"
    elif listed + table > 0.6:
        kind = "list" if listed >= table else "table"
    elif known < (0.22 if n >= 12 else 0.05) and n >= 3:
        kind = "junk"
    else:
        kind = "prose"
    round_ = lambda x: round(float(x), 6)
    return (n, round_(chars / n if n else 0), round_(symbols), round_(ends), round_(known), round_(dup_lines), round_(dup_paragraphs), round_(boilerplate), round_(top), round_(distinct), round_(listed), round_(table), round_(noise), kind)


def quality_stats(df: DataFrame, common_words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``record_id`` and the columns of ``STATS`` for every row.

    ``common_words`` is a small fixed list. Defined results: null, empty and blank texts have no words, shares of 0 and
    class junk; a null id stays null; repeated rows give repeated results; very long texts are read whole; other columns
    are not read.
    """
    return _described(df, common_words, id_col, text_col, [n for n, _ in STATS])


def text_classes(df: DataFrame, common_words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``record_id, text_class`` of every row: the class that ``quality_stats`` gives, without the other columns."""
    return _described(df, common_words, id_col, text_col, ["text_class"])


def _described(df: DataFrame, common_words: list[str], id_col: str, text_col: str, wanted: list[str]) -> DataFrame:
    common = frozenset(w.lower() for w in common_words if w and len(w) > 1)
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    kinds = dict(STATS)
    at = [k for k, (n, _) in enumerate(STATS) if n in wanted]
    names = ["record_id", *(STATS[k][0] for k in at)]
    types = [pa.int64(), *(arrow[STATS[k][1]] for k in at)]
    every = len(at) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [describe(t.as_py(), common, every) for t in batch.column(1)]
            columns = [ids, *([r[k] for r in rows] for k in at)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, ", ".join(["record_id bigint", *(f"{n} {kinds[n]}" for n in names[1:])]))
