"""Emails reduced to what their sender newly wrote.

A linear-chain model labels the lines of a message. Its states are new text, closing or signature, disclaimer, header or
introduction of a quotation, marked quotation, unmarked quotation and the ending of a quoted message. Each line has
features of position, punctuation, prefix and neighbouring lines, and whether its words stand in the message it answers;
each feature has a weight per state, and pairs of states have weights that say which parts follow which. The best labelling
of the whole message is found by dynamic programming. The weights are fitted (``fit_mail``) and kept in ``mail_weights.json``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrybed.llm.pii import EMAIL, PHONES, STREETS, fold

STATES = ("new", "signature", "disclaimer", "intro", "quoted", "unmarked", "quoted_end")
NEW, SIGN, DISC, INTRO, QUOTE, BARE, ENDING = range(7)
_PREFIX = re.compile(r"^\s*((?:[>|:]\s?)+)")
_CLOSING = re.compile(
    r"^(?:(?:with )?(?:best|kind|kindest|warm|many)?\s?(?:regards|wishes)|yours(?: sincerely| faithfully| truly)?|sincerely(?: yours)?|cheers|thanks(?: again| in advance)?|many thanks|thank you|br|kr|best|rgds|all the best|take care"
    r"|mit (?:freundlichen|besten|herzlichen) gr(?:ü|ue)(?:ß|ss)en|(?:beste|viele|liebe|herzliche|freundliche) gr(?:ü|ue)(?:ß|ss)e|gr(?:ü|ue)(?:ß|ss)e|mfg|lg|vg|danke|vielen dank"
    r"|(?:bien )?cordialement|bien à vous|cdlt|amicalement|salutations(?: distinguées)?|merci|sincères salutations|meilleures salutations"
    r"|(?:un )?(?:cordial )?saludos?(?: cordiales)?|atentamente|atte|un abrazo|gracias|muchas gracias)\s*[,.!;]?$",
    re.I,
)
_DEVICE = re.compile(r"^(?:sent from my|sent via|get the .{1,40} app|get outlook|von meinem .{1,40} gesendet|gesendet (?:von|mit) mein|envoyé (?:de|depuis) mon|enviado desde mi|enviado con)\b", re.I)
_RULE = re.compile(r"^(?:--|__|---|—|–{1,2}|_{2,4}|-{2,4}|={2,4}|\*{2,4}) ?$")
_LONG_RULE = re.compile(r"^[_=*-]{8,}$")
_LIST = re.compile(r"mailing list|to leave, write to|unsubscribe|list-?info|se désabonner|abmelden|darse de baja", re.I)
#: Words of legal notices in general, by language; a line is judged by how many it has and by those of the lines beside it.
_LEGAL = re.compile(
    r"\b(?:confidential\w*|privileged|intended|addressee|recipients?|received|error|notify|delete|unauthori[sz]ed|disclos\w+|copying|prohibited|liab\w+|virus\w*|registered|environment|printing|views|disclaimer"
    r"|vertraulich\w*|empfänger\w*|adressat\w*|irrtümlich|unbefugt\w*|weitergabe|untersagt|haftung|löschen|umwelt|ausdrucken|inhalt"
    r"|confidentiel\w*|destinataire\w*|réservé\w*|erreur|détruire|divulgation|interdit\w*|imprimer"
    r"|confidencial\w*|destinatario\w*|dirigido|recib\w+|elimin\w+|bórr\w+|divulgación|prohibid\w+|imprimir)\b",
    re.I,
)
_DATE = r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}"
_INTRO = (
    re.compile(r"^[^\n]{2,80} said on " + _DATE + r":?$", re.I),
    re.compile(r"^[^\n]{2,80}<[^>\s]+@[^>\s]+> (?:writes|wrote|schrieb|escribió|a écrit) ?:$", re.I),
    re.compile(r"^On (?:\w{3},? )?(?:\w{3} \d{1,2},? \d{4}|\d{1,2} \w{3,9} \d{4}|" + _DATE + r").{0,120}?(?:wrote ?:)?$"),
    re.compile(r"^Am " + _DATE + r"[^\n]{0,20} schrieb [^\n]+:$"),
    re.compile(r"^Le " + _DATE + r"[^\n]{0,120} a écrit ?:$"),
    re.compile(r"^El " + _DATE + r"[^\n]{0,120} escribió ?:$"),
    re.compile(r"^(?:Am|Le|El) " + _DATE + r"(?: (?:um|à|a las))? ?,? ?\d{1,2}:\d{2}"),
    re.compile(r"^\* [^\n\[]{2,60} \[" + _DATE + r"[^\]]*\]:$"),
    re.compile(r"^<[^>\s]+@[^>\s]+>(?: \w+)? (?:wrote|writes|schrieb|escribió|a écrit) ?:$", re.I),
    re.compile(r"^(?:wrote|schrieb|a écrit|escribió) ?:$"),
    re.compile(r"^\s*-{2,}\s?(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|original-nachricht|message d['’]origine|message original|message transféré|message transmis|mensaje original|mensaje reenviado|forwarded by [^-]*)\s?-{2,}\s*$", re.I),
    re.compile(r"^(?:begin forwarded message|anfang der weitergeleiteten nachricht|début du message (?:transféré|réexpédié)|inicio del mensaje reenviado)\s?:$", re.I),
)
_HEAD = re.compile(r"^(?:From|Sent|To|Cc|Subject|Date|Von|Gesendet|An|Betreff|Datum|De|Envoyé|À|Objet|Enviado(?: el)?|Para|Asunto|Fecha)\s?: ?(.*)$")
_HEAD_SURE = re.compile(r"@|^\d{1,2}\.? \w{3,10} \d{4}|^\w{3,9},? |\d{1,2}:\d{2}")
_GREETING = re.compile(r"^(?:hi|hello|dear|team|good (?:morning|afternoon|evening)|hallo|guten (?:tag|morgen|abend)|liebe[rs]?|sehr geehrte[rs]?|moin|bonjour|bonsoir|chers?|chères?|madame|salut|hola|buen[oa]s (?:días|tardes|noches)|estimad[oa]s?|querid[oa]s?)\b.{0,30}$", re.I)
_LABELLED = re.compile(r"^(?:mail|e-?mail|e|phone|tel|telefon|t|m|mob|mobile|fax|web|www|tél)\.?:?\s", re.I)
_NAME = re.compile(r"^(?:[A-ZÀ-Þ][\w'’.À-ÿ-]*|van|von|de|del|der)(?: (?:[A-ZÀ-Þ][\w'’.À-ÿ-]*|van|von|de|del|der)){1,3}$")
_ROLE = re.compile(r"^(?:[A-ZÀ-Þ][\w'’&À-ÿ-]+)(?: (?:[A-ZÀ-Þ][\w'’&À-ÿ-]+|of|and|für|de|et|y)){0,3}(?:, [A-ZÀ-Þ][\w'’&À-ÿ-]+(?: [A-ZÀ-Þ][\w'’&À-ÿ-]+){0,3})?$")
_OWN = re.compile(r"[^\W\d_]{3,}")
_END = re.compile(r"[.!?:…»\"”)]$")


def normal(text: str) -> str:
    """Words only, for comparing lines that were wrapped anew."""
    return " ".join(re.findall(r"\w+", text.lower()))


def clean(line: str) -> str:
    return re.sub(r"=(?:20)?$", "", line.rstrip("\r")).rstrip()


@lru_cache(maxsize=256)
def answered(text: str | None) -> str:
    """The message answered, as one run of words, without quotation marks at its line starts."""
    return "" if not text else " " + normal("\n".join(_PREFIX.sub("", clean(x)) for x in text.split("\n"))) + " "


def _contact(line: str) -> bool:
    rest = _LABELLED.sub("", line + " ").strip()
    for p in (EMAIL, *PHONES, *STREETS):
        m = p.match(rest)
        if m and re.fullmatch(r"(?:\s*[|,]\s*(?:\d{4,5} )?[A-ZÀ-Þ][\w-]+)?[.,]?", rest[m.end() :]):
            return True
    return False


def features(lines: list[str], parent: str, parent_whole: bool, sender: str = "") -> list[list[tuple[str, float]]]:
    """For each line its features and their values. ``parent`` is the result of ``answered``; ``parent_whole`` says that it
    was not cut, so that a line it lacks is none of its own. ``sender`` is the sender's header: a name or address that it
    holds too signs the sender's own text, not a quoted one."""
    sender = fold(sender)
    bare = [clean(x) for x in lines]
    marks = [m[1].replace(" ", "") if (m := _PREFIX.match(x)) else "" for x in bare]
    text = [_PREFIX.sub("", x) for x in bare]
    n = len(lines)
    marked = " " + normal("\n".join(t for t, m in zip(text, marks) if m)) + " "
    legal = [len(_LEGAL.findall(t)) for t in text]

    def intro(i: int) -> str:
        line = bare[i].strip()
        for k, p in enumerate(_INTRO):
            if p.match(line):
                if k == 2 and not line.endswith(":"):  # the introduction goes on in the next line
                    return "broken" if i + 1 < n and re.match(r"^\S*.{0,60}(?:wrote|writes) ?:$", bare[i + 1].strip()) else "maybe"
                if k == 6 and not line.endswith(":"):
                    return "broken" if i + 1 < n and bare[i + 1].strip().endswith(":") else "maybe"
                return "said"
        if i and re.match(r"^.{0,80}(?:wrote|schrieb|escribió|a écrit) ?:$", line) and re.match(r"^(?:On|Am|Le|El) .*\d", bare[i - 1]) and not bare[i - 1].rstrip().endswith((".", ":")):
            return "said"
        m = _HEAD.match(line)
        if m:
            near = sum(bool(_HEAD.match(bare[j].strip())) for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < n)
            sure = bool(_HEAD_SURE.search(m[1])) and not m[1].endswith(".")
            return "header" if near >= 1 and (sure or near >= 2 or not m[1].endswith(".")) else "lone" if sure and "@" in m[1] else "none"
        return "none"

    intros = [intro(i) for i in range(n)]
    certain = {"said", "header", "broken"}
    out = []
    for i in range(n):
        f: list[tuple[str, float]] = []
        line = text[i].strip()
        words = normal(line)
        size = len(words)
        goes_on = i > 0 and len(bare[i - 1]) > 38 and not _END.search(bare[i - 1]) and not marks[i - 1]
        # quotation marks: one kind of mark in a block, or after an introduction; a lone one may be the sender's own
        mark = marks[i]
        around = sum(1 for j in (i - 1, i + 1) if 0 <= j < n and marks[j][:1] == mark[:1]) if mark else 0
        led = any(x in certain for x in intros[max(0, i - 2) : i]) if mark else False
        if mark:
            f.append(("mark", 1.0))
            f.append(("mark:block" if around else "mark:led" if led else "mark:lone>" if mark[0] == ">" else "mark:lone", 1.0))
            if len(mark) > 1:
                f.append(("mark:deep", 1.0))
            if not around and not led and (re.match(r"^\d+ ?%", line) or "|" in line):
                f.append(("mark:cells", 1.0))
        else:
            f.append(("plain", 1.0))
            f.append((f"intro:{intros[i]}", 1.0))
            if 0 < i < n - 1 and marks[i - 1] and marks[i + 1] and size < 40 and bare[i - 1] and not _END.search(bare[i - 1]):
                f.append(("rest of a marked line", 1.0))
        # closings, signatures
        kind = "none"
        if _CLOSING.match(line):
            kind = "closing"
        elif _DEVICE.match(line):
            kind = "device"
        elif _RULE.match(bare[i].strip()):
            kind = "rule"
        elif _LONG_RULE.match(line):
            kind = "long rule"
        elif _LIST.search(line):
            kind = "list"
        elif _contact(line) and not goes_on:
            kind = "contact"
        elif _LABELLED.match(line) and re.search(r"[@\d]", line):
            kind = "labelled"
        elif _NAME.match(line) and not goes_on and not _GREETING.match(line):
            kind = "name"
        elif _ROLE.match(line) and not goes_on and size < 60 and not _GREETING.match(line):
            kind = "role"
        f.append((f"sign:{kind}" if not mark else f"marked sign:{kind != 'none'}", 1.0))
        # legal notices: words in the line and beside it
        if not mark:
            own = legal[i]
            beside = max(legal[i - 1] if i and not marks[i - 1] else 0, legal[i + 1] if i + 1 < n and not marks[i + 1] else 0)
            f.append((f"legal:{min(own, 3)},{min(beside, 2)}", 1.0))
            if goes_on and legal[i - 1]:
                f.append(("legal goes on", 1.0))
        if sender and kind in ("closing", "device", "rule", "long rule", "contact", "labelled", "name") and not mark and (own_ := _OWN.findall(line)):
            # the last word of a name, any word of an address before its @
            words_ = _OWN.findall(line.split("@")[0]) if "@" in line else own_[-1:]
            if any(len(w_ := fold(w)) >= 4 and w_ in sender for w in words_):
                f.append(("sender's name", 1.0))
        # running text, the sender's or another's
        if not mark:
            if re.search(r"[a-zà-ÿ]{3,} [a-zà-ÿ]{2,}", line):
                f.append(("running", 1.0))
            if _GREETING.match(line):
                f.append(("greeting", 1.0))
        if _GREETING.match(line) and i == 0:
            f.append(("greeting first", 1.0))
        if not line:
            f.append(("blank", 1.0))
        # unmarked quotation: words of the message answered
        if parent and size >= 12:
            weight = min(3.0, size / 14)
            if f" {words} " in parent:
                # what is quoted with marks already explains why the answered message has these words
                f.append(("answered", weight * (0.1 if not mark and f" {words} " in marked else 1.0)))
                if size > 40 and mark:
                    f.append(("answered, marked", 1.0))
            elif parent_whole and size >= 20 and not mark:
                f.append(("not answered", weight))
        out.append(f)
    return out


def conditions(line: str) -> tuple[bool, bool]:
    """Whether a line greets, and whether it is the header of a forwarded message: what transitions depend on."""
    bare = clean(line).strip()
    return bool(_GREETING.match(bare)), bool(_HEAD.match(bare) or _INTRO[-2].match(bare) or _INTRO[-1].match(bare))


class Model:
    """Weights of features per state, of pairs of states, of the first state, and of new text that begins again."""

    def __init__(self, weights: dict):
        width = len(STATES)
        self.emission = {k: np.array([w.get(s, 0.0) for s in STATES]) for k, w in weights["features"].items()}
        pairs = lambda key: np.array([[weights[key].get(a, {}).get(b, 0.0) for b in STATES] for a in STATES])
        self.transitions = pairs("transitions")
        self.start = np.array([weights["start"].get(s, 0.0) for s in STATES])
        self.greeted = np.array([weights["greeted"].get(s, 0.0) for s in STATES])
        self.reopened = float(weights["reopened"])
        self.steps = {(g, h): self._steps(g, h) for g in (False, True) for h in (False, True)}
        self.all = np.arange(3 * width)
        self.zero = np.zeros(width)

    def _steps(self, greeted: bool, header: bool) -> np.ndarray:
        """Scores of steps between (mode, state) pairs. Beside its state a line has a mode: 0 before any new text, 1 in it, 2
        after the sender closed it by signing, a disclaimer or a forwarded message's header."""
        width = len(STATES)
        out = np.full((3 * width, 3 * width), -np.inf)
        for mode in range(3):
            for j in range(width):
                for k in range(width):
                    value, then = self.transitions[j][k], mode
                    if k == NEW:
                        value += (self.greeted[j] if greeted else 0.0) + (self.reopened if mode == 2 else 0.0)
                        then = mode or 1
                    elif mode == 1 and (k in (SIGN, DISC) or header and k == INTRO):
                        then = 2
                    out[mode * width + j, then * width + k] = value
        return out

    def line(self, found: list[tuple[str, float]]) -> np.ndarray:
        s = self.zero.copy()
        for name, value in found:
            w = self.emission.get(name)
            if w is not None:
                s += w * value
        # the ending of a quoted message looks like a signature or a disclaimer
        s[ENDING] += max(s[SIGN], s[DISC])
        return s

    def best(self, lines: list[str], table: list[list[tuple[str, float]]]) -> list[int]:
        """The states of the best path; among equals the one with new text."""
        width = len(STATES)
        rows = [self.line(f) for f in table]
        best = np.full(3 * width, -np.inf)
        for k in range(width):
            best[(width if k == NEW else 0) + k] = self.start[k] + rows[0][k]
        back = []
        for line, s in zip(lines[1:], rows[1:]):
            ways = best[:, None] + self.steps[conditions(line)]
            step = ways.argmax(axis=0)
            back.append(step)
            best = ways[step, self.all] + np.tile(s, 3)
        at = len(best) - 1 - int(best[::-1].argmax())
        path = [at % width]
        for step in reversed(back):
            at = int(step[at])
            path.append(at % width)
        return path[::-1]


@lru_cache(maxsize=1)
def fitted() -> Model:
    return Model(json.loads(files("quarrybed.llm").joinpath("mail_weights.json").read_text("utf-8")))


def label_lines(text: str | None, parent: str | None = None, parent_whole: bool = False, sender: str | None = None) -> list[int]:
    """The state of each line of ``text`` (split at line feeds) by the best path through the model."""
    if not text:
        return []
    lines = text.split("\n")
    return fitted().best(lines, features(lines, answered(parent), parent_whole, sender or ""))


def mail_lines(df: DataFrame, id_col: str = "entry_id", body: str = "body_preview", message_id: str = "message_id", in_reply_to: str = "in_reply_to", cut_col: str | None = "body_truncated", sender: str | None = "from_header") -> DataFrame:
    """``record_id, line_no, label, line`` of every line of every message, lines counted from 0.

    The message answered is looked up by its id. Messages are joined to those they answer only where they name one, so
    messages without ``in_reply_to`` are not shuffled; a message that very many answer is split by adaptive skew handling.

    Defined results: null and empty bodies give no lines; blank lines are labelled like others; a repeated message id
    stands for the least body among them; a missing, null or unknown ``in_reply_to`` means that there is nothing to
    compare with; repeated rows give repeated lines; texts are read whole; other columns are not read.
    """
    cut = F.coalesce(F.col(cut_col).cast("boolean"), F.lit(False)) if cut_col else F.lit(False)
    mails = df.select(F.col(id_col).cast("bigint").alias("i"), F.col(body).cast("string").alias("b"), F.trim(F.col(in_reply_to)).alias("r"), (F.col(sender).cast("string") if sender else F.lit(None).cast("string")).alias("f"))
    # only messages that are answered are brought to their answers
    asked = mails.where("r is not null").select("r").distinct()
    found = df.where(F.col(message_id).isNotNull() & F.col(body).isNotNull()).select(F.trim(F.col(message_id)).alias("r"), F.col(body).cast("string").alias("b"), cut.alias("c")).join(asked, "r", "left_semi")
    known = found.groupBy("r").agg(F.min(F.struct("b", "c")).alias("p"))
    known = known.select("r", F.col("p.b").alias("pb"), (~F.col("p.c")).alias("pw"))
    answers = mails.where("r is not null").join(known, "r", "left").select("i", "b", "f", "pb", "pw")
    first = mails.where("r is null").select("i", "b", "f", F.lit(None).cast("string").alias("pb"), F.lit(None).cast("boolean").alias("pw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos, labels, texts = [], [], [], []
            for i, b, f, pb, pw in zip(*[c.to_pylist() for c in batch.columns]):
                for no, (k, line) in enumerate(zip(label_lines(b, pb, bool(pw), f), (b or "").split("\n"))):
                    ids.append(i)
                    nos.append(no)
                    labels.append(STATES[k])
                    texts.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int64()), pa.array(labels, pa.string()), pa.array(texts, pa.string())], ["record_id", "line_no", "label", "line"])

    return answers.unionByName(first).mapInArrow(run, "record_id bigint, line_no bigint, label string, line string")


def new_text(df: DataFrame, **columns) -> DataFrame:
    """``record_id, new_text``: each message's own new lines joined by line feeds, '' if it has none. One row per id."""
    lines = mail_lines(df, **columns)
    own = F.when(F.col("label") == "new", F.struct("line_no", "line"))
    return lines.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(own)), lambda x: x.line), "\n").alias("new_text"))
