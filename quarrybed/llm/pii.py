"""Personal information inside free text: find it, and replace it with typed placeholders.

Regular expressions propose spans; validators (Luhn, mod 97, mod 23, weights 7-3-1, number ranges, digit counts) confirm
them: a strong one that holds suffices by itself, one that fails takes from the score, and account and card numbers
without it are none. Words nearby raise or lower the score; spans at or above the threshold are kept, the stronger type
first where they overlap. Each text is judged on its own, so nothing is shuffled and a text of any length is read whole.
"""

from __future__ import annotations

import calendar
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "bank_account", "payment_card", "id_number", "phone", "street_address", "person_name")
THRESHOLD = 3.0
SCHEMA = "record_id bigint, field_name string, pii_type string, span_start int, span_end int, pii_value string, score double"


# Validators ---------------------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return len(digits) > 1 and total % 10 == 0


def mod97(text: str) -> bool:
    """ISO 7064: an account number with its country letters moved to the end leaves 1."""
    t = re.sub(r"\W", "", text).upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", t):
        return False
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def mod23(text: str) -> bool:
    """The letter of a Spanish identity number."""
    t = re.sub(r"\W", "", text).upper()
    if not re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", t):
        return False
    n = int(t[:-1].replace("X", "0", 1).replace("Y", "1", 1).replace("Z", "2", 1))
    return "TRWAGMYFPDXBNJZSQVHLCKE"[n % 23] == t[-1]


def nino(text: str) -> bool:
    return bool(re.fullmatch(r"[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]", re.sub(r"\W", "", text).upper()))


def check731(text: str) -> bool:
    """Machine-readable documents: weights 7, 3, 1, last digit the check."""
    t = re.sub(r"\W", "", text).upper()
    return t[-1:].isdigit() and sum(int(c, 36) * (7, 3, 1)[i % 3] for i, c in enumerate(t[:-1])) % 10 == int(t[-1])


def cpf(text: str) -> bool:
    """Eleven digits whose last two are weighted sums of those before."""
    d = [int(c) for c in re.sub(r"\D", "", text)]
    return len(d) == 11 and len(set(d)) > 1 and all(sum(x * (n + 1 - i) for i, x in enumerate(d[:n])) * 10 % 11 % 10 == d[n] for n in (9, 10))


# Patterns -----------------------------------------------------------------------------------------------------------

_AT = r"(?:@|\s?[(\[{]\s?(?:at|@|arroba|chez)\s?[)\]}]\s?)"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punkt|point|punto|\.)\s?[)\]}]\s?)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"(?<![\w.+%-])([A-Za-z0-9_%+'-]+(?:{_DOT}[A-Za-z0-9_%+'-]+)*){_AT}({_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}})(?![\w@])")
EMAIL_WORDS = re.compile(rf"(?<![\w.+%-])([A-Za-z0-9_%+-]+(?:(?:\.| dot )[A-Za-z0-9_%+-]+)*) at ({_LABEL}(?:(?: dot |\.){_LABEL})* dot [A-Za-z]{{2,24}})\b", re.I)
MESSAGE_ID = re.compile(r"^[0-9a-f]{6,}[.$][0-9a-z.$]+$", re.I)

_EXT = r"(?:,?\s?(?:ext\.?|extension|x|Durchwahl|DW|App\.|poste|extensi[oó]n)\s?\.?\s?\d{1,6})?"
PHONES = [
    re.compile(p + _EXT + r"(?![\w@]|[.,/-]\d)")
    for p in (
        r"(?<![\w+.])\+\d{1,3}(?:[ .\-/]?\(\d{1,4}\)|[ .\-/]?\d{2,12}){1,6}",
        r"(?<![\w.])\(\+?\d{2,5}\)[ .\-/]?\d{3,5}(?:[ .\-]?\d{2,5}){0,3}",
        r"(?<![\w+.\-/,:])0\d{1,4}[/ \-]\d{3,6}(?:[ \-]\d{2,6}){0,3}",
        r"(?<![\w+.\-/,:])0\d(?:[ .\-]\d\d){4}",
        r"(?<![\w+.\-/,:])[2-9]\d\d([.\-])\d{3}\1\d{4}",
    )
]

def french_key(text: str) -> bool:
    """The last two of fifteen digits: 97 less the rest of the others."""
    d = re.sub(r"\D", "", text)
    return len(d) == 15 and 97 - int(d[:13]) % 97 == int(d[13:])


#: What a validator adds to a shape's score if it holds and if it fails: strong ones (a chance value passes in one of 23 or
#: 97 cases) confirm alone, weak ones (one of ten) and ranges of numbers need a label too.
STRONG, WEAK, RANGE = (3.0, -0.5), (1.0, 0.0), (1.0, 0.0)
_IDS = (
    # name, pattern, validator, score of the shape alone, what the validator adds
    ("social", r"\d{3}(?P<s>[- ])\d{2}(?P=s)\d{4}", lambda t: t[0] not in "9" and t[:3] not in ("000", "666"), 1.5, RANGE),
    ("insurance", r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", nino, 1.5, RANGE),
    ("national", r"\d{3}\.\d{3}\.\d{3}-\d{2}", lambda t: cpf(t), 1.5, STRONG),
    ("dni", r"[XYZ]?\d{7,8}-?[A-Z]", mod23, 1.0, STRONG),
    ("card", r"[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{7}\d\d?", check731, 0.5, WEAK),
    ("passport", r"[A-Z]{1,2}\d{6,8}[A-Z]?", check731, 0.5, WEAK),
    ("french", r"[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?", french_key, 0.5, STRONG),
    ("digits", r"\d{8,12}", luhn, 0.0, WEAK),
)
IDS = [(n, re.compile(rf"(?<![\w.+\-/@]){p}(?![\w@]|[.\-/]\w)"), v, s, w) for n, p, v, s, w in _IDS]
IBAN = re.compile(r"(?<![\w.])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\w.+\-/])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w]|[.\-/]\w)")
_ID_LABEL = re.compile(
    r"\b(?:ssn|social\s+security(?:\s+(?:number|no\.?))?|sozialversicherungs\w*|ni(?:\s+(?:number|no\.?))|nino|national\s+insurance(?:\s+(?:number|no\.?))?"
    r"|national\s+id(?:entity)?(?:\s+(?:number|card|no\.?))?|identity\s+(?:card|number)(?:\s+(?:number|no\.?))?|id\s+card(?:\s+(?:number|no\.?))?|passport(?:\s+(?:number|no\.?))?|passeport|pasaporte|reisepass\w*"
    r"|ausweis\w*|personalausweis\w*|dni|nie|nif|carte\s+d['’]identit[ée]|cni|c[ée]dula|s[ée]curit[ée]\s+sociale|seguridad\s+social|cpf|nir)\b",
    re.I,
)
_ID_OTHER = re.compile(r"\b(?:case|exhibit|ticket|version|build|device|serial|volume|invoice|order|register(?:ed)?|hrb|fall|akte|section|hash|sector|cluster|offset|number\s+hg)\b", re.I)

_HOUSE = r"\d{1,4}(?: ?[-–/] ?\d{1,4})? ?[A-Za-z]?"
_UP = r"[A-ZÀ-Þ][\w'’À-ÿ-]*"
STREETS = [
    re.compile(p)
    for p in (
        rf"(?<![\w.,:/-])\d{{1,5}}(?:[-–/]\d{{1,5}})?[A-Za-z]?(?: bis| ter)?,? (?:{_UP} ){{1,4}}(?:Street|St|Lane|Ln|Road|Rd|Drive|Dr|Avenue|Ave|Court|Ct|Boulevard|Blvd|Way|Close|Terrace|Place|Square|Crescent|Row|Hill|Gardens|Parkway|Mews|Walk)\b",
        r"(?<![\w.,:/-])\d{1,4}(?: ?(?:bis|ter|quater|[A-Z]))?,? (?:rue|avenue|boulevard|place|quai|chemin|allée|impasse|route|cours|passage|square|villa)(?: (?:de la|de l['’]|du|des|de|d['’]|la|le|les))?[ ]?" + rf"{_UP}(?:[ -](?:(?:de la|du|des|de|la|le|les) )?{_UP})*",
        rf"(?<![\w-])(?:{_UP} ){{0,3}}[A-ZÀ-Þ]?[a-zà-ÿ-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm|ring|steig|graben|markt|chaussee|stieg|Straße|Allee|Platz|Weg|Gasse) \d{{1,4}}(?: ?[-–/] ?\d{{1,4}})?(?: ?[a-z])?\b",
        rf"(?<![\w-])(?:Am|An der|An den|Im|In der|In den|Zum|Zur|Auf dem|Auf der|Unter den|Hinter dem|Vor dem|Beim) (?:{_UP} )*{_UP} \d{{1,4}}(?: ?[a-z])?\b",
        rf"(?<![\w-])(?:Calle|C/|Avenida|Avda\.|Paseo|Plaza|Camino|Ronda|Carrera|Travesía|Carretera|Rambla)(?: (?:de los|de las|de la|del|de|la|los|las|el))? {_UP}(?: (?:de los |de las |de la |del |de )?{_UP})*,? (?:n\.?º ?)?\d{{1,4}}(?: ?[A-Za-z])?\b",
    )
]
_STREET_NOT = re.compile(r"^(?:Straße|Weg|Platz)")

_PARTICLE = r"(?:van der|van den|van de|van|von der|von|zu|de la|de los|del|della|di|da|dos|du|le|la|de|ten|ter)"
_NAMEWORD = r"(?:O['’]|D['’]|Mc|Mac)?[A-ZÀ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’]+(?:-[A-ZÀ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’]+)*"
_INITIAL = r"[A-ZÀ-Þ]\."
_GAP = r"[ \t]+"
WORDS = re.compile(rf"(?<![\w@.+'’-])(?:{_NAMEWORD}|{_INITIAL}|{_PARTICLE})(?![\w@+])")
#: Words that end or begin a capitalised pair without being a name (fixed list: greetings, roles, months, firms' kinds).
NOT_NAME = frozenset(
    "the a an and or of in on at to for from by with is are was it this that we you not no our your please thanks thank dear hi hello all good morning afternoon evening best kind regards yours sincerely cheers sent subject date cc bcc re mail phone tel email original message notice case section clerk officer engineer coordinator counsel analyst manager director security partner partners services ltd inc office registered address file apt street st lane road drive avenue ave court mr mrs ms dr prof herr frau mme der die das ein eine und oder nicht bitte guten tag hallo zusammen liebe kollegen viele grüße beste mit freundlichen mfg von betreff gesendet am im la bonjour chers collègues cordialement bien vous de à objet envoyé el los buenos días hola saludos saludo para asunto enviado según queda new contact according after before there".split()
) | {x.lower() for names in (calendar.month_name, calendar.month_abbr, calendar.day_name, calendar.day_abbr) for x in names if x}
#: Ordinary words that are names too: two of them together are no name without other evidence.
ORDINARY = frozenset("will mark grace rose may april june august hope faith joy dawn iris ivy lily daisy ruby pearl amber art bill bob rob jack pat sue frank ernest day long field marsh brook hill wood lake stone rich young short white black brown green gray king bishop page carter cook baker mason".split())
_TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|M|Mme|Mlle|Sr|Sra|Don|Doña)\.?)\s+$")
_BEFORE = re.compile(r"(?:\b(?:call|contact|spoke to|speak to|signed for by|an|von|from|cc|bcc|to|de|von|para|an|by|ging an|schrieb|at \d{1,2}:\d{2}|à \d{1,2}:\d{2},|las \d{1,2}:\d{2},|we read:|\d{1,2}:\d{2},?|regards,?|sich an)|[:;/*–-]|^|\()\s*$", re.I)
_AFTER = re.compile(r"^\s*(?:<[^>\s]+@|\[mailto:|\[\d{4}-|said on|wrote|writes|schrieb|escribió|a écrit|\(mailto:|,\s*(?:SSN|DNI|NI|national|passport|social|Ausweis|Durchwahl)|:|at\s+[+(\d]|\.?$|,?\s*$|:\s*$|\s+[+(0]\d)")
_MAILED = re.compile(r"^\s*(?:<[^>\s]+@|\[mailto:)")


@lru_cache(maxsize=65_536)
def fold(word: str) -> str:
    """Plain lower-case letters of a word, umlauts spelled out as in addresses."""
    w = word.lower().replace("ß", "ss").replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ø", "o")
    return re.sub(r"[^a-z]", "", "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)))


@dataclass
class Lexicon:
    """Known parts of names. Endings that several known family names share mark unknown family names."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    endings: frozenset[str] = field(init=False)

    def __post_init__(self):
        counts: dict[str, int] = {}
        for f in self.family:
            for n in (4, 5):
                if len(f) > n + 1:
                    counts[f[-n:]] = counts.get(f[-n:], 0) + 1
        self.endings = frozenset(e for e, n in counts.items() if n >= 4)

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> Lexicon:
        return cls(frozenset(p.lower() for p, k in rows if p and k == "given"), frozenset(p.lower() for p, k in rows if p and k == "family"))

    def is_given(self, w: str) -> bool:
        return all(p in self.given for p in w.lower().split("-")) or any(p in self.given for p in w.lower().split("-")) and "-" in w

    def is_family(self, w: str) -> bool:
        w = w.lower()
        return w in self.family or any(len(w) > len(e) + 1 and w.endswith(e) for e in self.endings) or ("-" in w and all(self.is_family(p) for p in w.split("-")))


def _emails(text: str) -> Iterator[tuple[int, int, float]]:
    for pattern in (EMAIL, EMAIL_WORDS) if " dot " in text.lower() else (EMAIL,):
        for m in pattern.finditer(text):
            score = 4.0
            start = m.start()
            for lead in ("mailto:",):
                if m[0].lower().startswith(lead):
                    start += len(lead)
            before = text[max(0, start - 24) : start].lower()
            if MESSAGE_ID.match(m[1]) and text[start - 1 : start] == "<":
                score -= 3
            if re.search(r"\b(?:message-?id|id|references|in-reply-to)\b:?\s*(?:[>|: ]*)<$", before):
                score -= 3
            yield start, m.end(), score


def _phones(text: str) -> Iterator[tuple[int, int, float]]:
    for k, pattern in enumerate(PHONES):
        for m in pattern.finditer(text):
            main = re.split(r"(?i)ext|durch|dw|app|poste|x", m[0])[0]
            digits = re.sub(r"\D", "", main)
            if not 7 <= len(digits) <= 15:
                continue
            score = (4.0, 3.5, 3.0, 3.5, 3.0)[k] - 2 * (k == 2 and len(digits) < 9)
            score -= 3 * bool(re.fullmatch(r"\d{1,2}[./-]\d{1,2}[./-](?:19|20)?\d{2}", main.strip()))
            before = text[max(0, m.start() - 24) : m.start()].lower()
            score += bool(re.search(r"(?:tel|phone|call|mobile|fax|number is|\bm|\bt:?|telefon\w*|\bat|unter)\.?:?\s*$", before))
            score -= 2 * bool(re.search(r"(?:ticket|exhibit|case|build|version|serial|offset|iban|invoice|order|section)\W*$", before))
            yield m.start(), m.end(), score


def _ids(text: str) -> Iterator[tuple[int, int, float]]:
    if not re.search(r"\d", text):
        return
    labels = [(m.start(), m.end()) for m in _ID_LABEL.finditer(text)]
    for name, pattern, valid, shape, (holds, fails) in IDS:
        for m in pattern.finditer(text):
            sure = bool(valid(m[0]))
            score = shape + (holds if sure else fails)
            near = [e for s, e in labels if s < m.start() and m.start() - e <= 30]
            if near:
                between = text[near[-1] : m.start()]
                if not re.search(r"\d{4,}", between) and between.count("\n") < 2:
                    score += 3.0 if name != "digits" else 2.5
            elif name in ("digits", "card", "passport") or not sure and name in ("french", "dni"):
                score -= 1
            if _ID_OTHER.search(text[max(0, m.start() - 24) : m.start()]) and not near:
                score -= 2
            yield m.start(), m.end(), score


def _accounts(text: str) -> Iterator[tuple[int, int, float]]:
    """Account numbers: only what leaves 1 by mod 97."""
    for m in IBAN.finditer(text):
        words = [x.end() for x in re.finditer(r"\w+", m[0])]
        # letters after the number may look like a part of it
        end = next((e for e in reversed(words) if mod97(m[0][:e])), None)
        if end:
            yield m.start(), m.start() + end, 4.0


def _cards(text: str) -> Iterator[tuple[int, int, float]]:
    """Payment cards: 13 to 19 digits that pass Luhn; words for other numbers before them speak against it."""
    for m in CARD.finditer(text):
        if luhn(re.sub(r"\D", "", m[0])):
            yield m.start(), m.end(), 3.5 - 2 * bool(_ID_OTHER.search(text[max(0, m.start() - 24) : m.start()]))


def _streets(text: str) -> Iterator[tuple[int, int, float]]:
    for pattern in STREETS:
        for m in pattern.finditer(text):
            yield m.start(), m.end(), 3.5


def _names(text: str, lex: Lexicon, known: str) -> Iterator[tuple[int, int, float]]:
    """``known`` holds the folded local parts of the addresses around the text."""
    for line_m in re.finditer(r"[^\n]+", text):
        line, base = line_m[0], line_m.start()
        tokens = [(m.start(), m.end(), m[0]) for m in WORDS.finditer(line)]
        n = len(tokens)
        i = 0
        while i < n:
            best = None
            for j in range(i + 1, min(n, i + 5)):
                part = tokens[i : j + 1]
                seps = [line[a[1] : b[0]] for a, b in zip(part, part[1:])]
                if any(not re.fullmatch(r"[ \t]+|,[ \t]+", s) for s in seps) or sum("," in s for s in seps) > 1:
                    break
                score = _name_score(line, part, seps, lex, known)
                if score >= THRESHOLD and (best is None or score >= best[0]):
                    best = (score, j)
            if best:
                yield base + tokens[i][0], base + tokens[best[1]][1], best[0]
                i = best[1] + 1
            else:
                i += 1


def _name_score(line: str, part: list, seps: list[str], lex: Lexicon, known: str) -> float:
    words = [w for _, _, w in part]
    comma = next((k for k, s in enumerate(seps) if "," in s), None)
    if comma is None:
        *given, family = words
        if re.fullmatch(_INITIAL, family) or not family[0].isupper():
            return 0
        particles = [w for w in given if not w[0].isupper()]
        if particles and given[-len(particles) :] != particles:
            return 0
        given = [w for w in given if w[0].isupper()]
    else:  # family, given names
        *lead, family = words[: comma + 1]
        given = words[comma + 1 :]
        if any(w[0].isupper() for w in lead) or not family[0].isupper():
            return 0
        if re.fullmatch(_INITIAL, family) or any(not w[0].isupper() for w in given):
            return 0
    if not given:
        return 0
    firsts = [w for w in given if not re.fullmatch(_INITIAL, w)]
    if len(firsts) > 2 or any(w.lower().rstrip(".") in NOT_NAME and not lex.is_given(w) for w in [*firsts, family]):
        return 0
    score, known_given, known_family = 0.0, bool(firsts) and lex.is_given(firsts[0]), lex.is_family(family)
    if len(firsts) == 2 and not lex.is_given(firsts[1]):
        return 0
    score += 1.5 * known_given + 1.5 * known_family
    mine = fold(family)
    proof = len(mine) >= 3 and mine in known
    start, end = part[0][0], part[-1][1]
    before, after = line[:start], line[end:]
    plain = re.sub(r"^[>|:\s]+", "", before)
    alone = not plain.strip() and not re.sub(r"=20$", "", after).strip(" ,")
    titled = bool(_TITLE.search(before))
    mailed = bool(_MAILED.match(after))
    placed = bool(_BEFORE.search(plain)) and bool(_AFTER.match(re.sub(r"=20$", "", after)))
    if not firsts:  # initials only
        score += 1.0
        if not (known_family or proof):
            return 0
    score += 1.5 * proof + 1.5 * titled + 2.0 * mailed + 1.0 * placed + 0.5 * alone
    if known_family and family.lower() not in ORDINARY and firsts:
        score += 1.5
    if firsts and len(given) > len(firsts):  # a middle initial
        score += 1.0
    if known_given and firsts and firsts[0].lower() not in ORDINARY:
        score += 0.5
    if family.lower() in ORDINARY and (not firsts or firsts[0].lower() in ORDINARY or not known_given) and not (proof or titled or mailed or alone or len(given) > len(firsts)):
        score -= 2.5 if firsts and firsts[0].lower() in ORDINARY else 0.5
    if family.isupper() and firsts and firsts[0].isupper() and not (known_given or known_family or proof):
        return 0
    if comma is not None and not (known_family or proof) and not known_given:
        return 0
    if comma is not None and not lex.is_given(given[0]) and not proof and not re.fullmatch(_INITIAL, given[0]):
        score -= 1.0
    return score


def find_pii(text: str | None, lex: Lexicon, around: str = "", cut: bool = False) -> list[tuple[int, int, str, float]]:
    """(start, end, type, score) of each span, in order, without overlaps.

    ``around`` is further text whose addresses say who takes part (headers). ``cut`` says that the text was cut off at
    its end: a value that reaches the end may be incomplete and does not count. Null and blank texts have no spans.
    """
    if not text or not text.strip():
        return []
    kept: list[tuple[int, int, str, float]] = []
    taken = bytearray(len(text) + 1)
    known = " ".join(fold(m[1]) for m in EMAIL.finditer(f"{text}\n{around}"))
    finders = (("email", _emails(text)), ("bank_account", _accounts(text)), ("payment_card", _cards(text)), ("id_number", _ids(text)), ("phone", _phones(text)), ("street_address", _streets(text)), ("person_name", _names(text, lex, known)))
    for kind, spans in finders:
        for s, e, score in sorted(spans, key=lambda x: (-x[2], x[0] - x[1])):
            if not any(taken[s:e]):
                if score >= THRESHOLD or kind == "email":
                    taken[s:e] = b"\1" * (e - s)
                if score >= THRESHOLD and not (cut and e >= len(text.rstrip())):
                    kept.append((s, e, kind, score))
    return sorted(kept)


def redact(text: str | None, spans: list[tuple[int, int, str, float]]) -> str | None:
    """The text with ``[EMAIL]``, ``[PHONE]`` and so on in place of each span."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, kind, _ in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def _frame(df: DataFrame, id_col: str, fields: list[str], around: list[str], cut_col: str | None) -> DataFrame:
    head = F.concat_ws("\n", *[F.col(c).cast("string") for c in around]) if around else F.lit("")
    cut = F.coalesce(F.col(cut_col).cast("boolean"), F.lit(False)) if cut_col else F.lit(False)
    return df.select(F.col(id_col).cast("bigint"), head, cut, *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)])


def detect_pii(df: DataFrame, id_col: str, fields: list[str], lexicon: list[tuple[str, str]], around: list[str] = [], cut_col: str | None = None, cut_field: str | None = None) -> DataFrame:  # noqa: B006
    """One row per span of each field: ``record_id, field_name, pii_type, span_start, span_end, pii_value, score``.

    ``lexicon`` is a small fixed list of (name part, 'given' or 'family'). ``cut_col`` is a boolean column that says
    whether ``cut_field`` was cut off.

    Defined results: null, empty and blank texts give no rows; repeated rows give repeated spans; a null id stays null;
    overlapping spans are settled by type (in the order of ``TYPES``), then by score, then by length; texts
    are read whole at any length; columns that are not named are not read, so clashing names do no harm.
    """
    lex = Lexicon.of(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            cols = [c.to_pylist() for c in batch.columns]
            for rid, head, cut, *texts in zip(*cols):
                for name, text in zip(fields, texts):
                    for s, e, kind, score in find_pii(text, lex, head or "", bool(cut) and name == cut_field):
                        rows.append((rid, name, kind, s, e, text[s:e], float(score)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64()))], ["record_id", "field_name", "pii_type", "span_start", "span_end", "pii_value", "score"])

    return _frame(df, id_col, fields, around, cut_col).mapInArrow(run, SCHEMA)


def redact_pii(df: DataFrame, id_col: str, fields: list[str], lexicon: list[tuple[str, str]], around: list[str] = [], suffix: str = "_redacted") -> DataFrame:  # noqa: B006
    """``id_col`` and each field with typed placeholders, one row per input row. Null stays null, blank stays blank; a
    value at a cut end is replaced too."""
    lex = Lexicon.of(lexicon)
    names = [id_col, *(f + suffix for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            out = [cols[0], *[[redact(t, find_pii(t, lex, h or "")) for h, t in zip(cols[1], texts)] for texts in cols[3:]]]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(o, pa.string()) for o in out[1:]]], names)

    return _frame(df, id_col, fields, around, None).mapInArrow(run, ", ".join([f"`{names[0]}` bigint", *[f"`{n}` string" for n in names[1:]]]))
