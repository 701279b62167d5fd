"""Fits the weights of the mail model on composed messages whose lines are labelled by how they were composed.

    python -m quarrybed.llm.fit_mail CASE OUT.json

No message of the case is labelled, so messages are put together: sentences of a bounded sample of the case's documents
(``DOCUMENTS``) as new, quoted and answered text, and greetings, closings, signatures, device lines, notices and the ways in
which mail programs quote and forward, in four languages. ``MESSAGES`` of them, seeded, are the labelled sample; a fifth of
it is held out. Fitting begins with the weights given (the present ones) and is an averaged structured perceptron: after each message whose best
labelling is wrong, the features of the right path gain and those of the wrong one lose. Labels of quoted text are told
apart as far as the states need; the held-out figures are those of the question asked: is a line new or not.
"""

from __future__ import annotations

import json
import random
import sys
from collections import defaultdict

from quarrybed.llm import mailtext
from quarrybed.llm.mailtext import BARE, DISC, ENDING, INTRO, NEW, QUOTE, SIGN, STATES, Model

#: Bounds of the labelled sample, rounds over it, size of a step, seed.
MESSAGES, DOCUMENTS, ROUNDS, STEP, SEED = 8_000, 2_000, 4, 0.02, 23

#: Weights that fitting leaves as they are: a line without any form of an introduction, a signature or a notice is none of them,
#: whatever stands beside it.
HELD = frozenset({("features", "intro:none", INTRO), ("features", "sign:none", SIGN), ("features", "legal:0,0", DISC)})

WORDS = {
    "en": {
        "greeting": ["Hi {g},", "Hello {g}", "Dear {g},", "Dear all,", "Good morning,", "Hi team,", "Hello"],
        "closing": ["Best regards", "Kind regards,", "Regards,", "Thanks,", "Many thanks", "Cheers,", "Yours sincerely,", "Best wishes,", "Thank you", "BR"],
        "role": ["Project Manager", "Head of Sales, {c}", "Senior Consultant", "Office Assistant, {c}", "{c}"],
        "device": ["Sent from my phone", "Sent from my tablet", "Get the Mail app for phones", "Sent via mobile"],
        "notice": ["This e-mail and any attachments are confidential and intended only for the addressee. If you have received it in error, please notify the sender and delete it.", "The information in this message may be privileged. Unauthorised copying or disclosure is prohibited.", "We accept no liability for viruses in this message. Please think of the environment before printing.", "{c} is registered in the commercial register. The views expressed are those of the sender."],
        "said": ["On {d} at {t}, {n} <{a}> wrote:", "On {d} {n} wrote:", "{n} <{a}> writes:"],
        "header": [("From", "Sent", "To", "Subject"), ("From", "Date", "Subject", "To")],
        "forward": ["-----Original Message-----", "---------- Forwarded message ----------", "Begin forwarded message:"],
        "list": ["To unsubscribe from this mailing list, write to {a}", "You receive this because you are on the mailing list {a}"],
    },
    "de": {
        "greeting": ["Hallo {g},", "Liebe {g},", "Sehr geehrte Damen und Herren,", "Guten Tag,", "Liebe Kollegen,", "Guten Morgen {g},"],
        "closing": ["Mit freundlichen Grüßen", "Viele Grüße", "Beste Grüße,", "Danke", "MfG", "Herzliche Grüße", "Vielen Dank"],
        "role": ["Leiter Vertrieb", "Sachbearbeiterin, {c}", "{c}", "Projektleitung"],
        "device": ["Von meinem Telefon gesendet", "Gesendet von meinem Handy"],
        "notice": ["Diese Nachricht ist vertraulich und nur für den Empfänger bestimmt. Wenn Sie sie irrtümlich erhalten haben, bitten wir Sie, sie zu löschen.", "Unbefugte Weitergabe ist untersagt. Für Schäden übernehmen wir keine Haftung.", "Bitte denken Sie an die Umwelt, bevor Sie diese Nachricht ausdrucken."],
        "said": ["Am {d} um {t} schrieb {n} <{a}>:", "Am {d} schrieb {n}:"],
        "header": [("Von", "Gesendet", "An", "Betreff")],
        "forward": ["-----Ursprüngliche Nachricht-----", "-------- Weitergeleitete Nachricht --------"],
        "list": ["Zum Abmelden schreiben Sie an {a}"],
    },
    "fr": {
        "greeting": ["Bonjour {g},", "Bonjour,", "Cher {g},", "Chère {g},", "Bonsoir,"],
        "closing": ["Cordialement,", "Bien à vous", "Bien cordialement", "Merci", "Salutations distinguées,", "Amicalement"],
        "role": ["Responsable commercial", "Assistante, {c}", "{c}"],
        "device": ["Envoyé de mon téléphone", "Envoyé depuis mon mobile"],
        "notice": ["Ce message est confidentiel et réservé à ses destinataires. Si vous l'avez reçu par erreur, merci de nous en informer et de le détruire.", "Toute divulgation est interdite. Pensez à l'environnement avant d'imprimer."],
        "said": ["Le {d} à {t}, {n} <{a}> a écrit :", "Le {d}, {n} a écrit :"],
        "header": [("De", "Envoyé", "À", "Objet")],
        "forward": ["-----Message d'origine-----", "-------- Message transféré --------"],
        "list": ["Pour se désabonner, écrire à {a}"],
    },
    "es": {
        "greeting": ["Hola {g},", "Buenos días,", "Estimado {g},", "Estimada {g},", "Buenas tardes"],
        "closing": ["Un saludo", "Saludos cordiales,", "Atentamente,", "Gracias", "Un abrazo,"],
        "role": ["Jefe de ventas", "Asistente, {c}", "{c}"],
        "device": ["Enviado desde mi móvil"],
        "notice": ["Este mensaje es confidencial y se dirige solo a su destinatario. Si lo ha recibido por error, elimínelo y avise al remitente.", "Queda prohibida su divulgación. Piense en el medio ambiente antes de imprimir."],
        "said": ["El {d} a las {t}, {n} <{a}> escribió:", "El {d}, {n} escribió:"],
        "header": [("De", "Enviado", "Para", "Asunto")],
        "forward": ["-----Mensaje original-----", "-------- Mensaje reenviado --------"],
        "list": ["Para darse de baja, escriba a {a}"],
    },
}


def _wrap(text: str, width: int) -> list[str]:
    out, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) + 1 > width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*out, line]


class Composer:
    """Messages of labelled lines. ``sentences`` by language, ``names`` as (given, family)."""

    def __init__(self, sentences: dict[str, list[str]], names: list[tuple[str, str]], rng: random.Random):
        self.sentences, self.names, self.rng = sentences, names, rng

    def pick(self, xs):
        return xs[self.rng.randrange(len(xs))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def person(self) -> dict:
        g, f = self.pick(self.names)
        house = self.pick(["Alderson", "Brimley", "Castrel", "Dunmore", "Eckhart"])
        return {"n": f"{g} {f}", "g": g, "a": f"{g}.{f}@{house}.example".lower().replace(" ", ""), "c": f"{house} {self.pick(['Group', 'Consulting', 'GmbH', 'Ltd', 'SA'])}"}

    def fill(self, text: str, who: dict) -> str:
        r = self.rng
        d = self.pick([f"{r.randrange(1, 29):02}/{r.randrange(1, 13):02}/20{r.randrange(10, 27)}", f"{r.randrange(1, 29):02}.{r.randrange(1, 13):02}.20{r.randrange(10, 27)}", f"Mon, Mar {r.randrange(1, 29)}, 20{r.randrange(10, 27)}"])
        return text.format(d=d, t=f"{r.randrange(8, 20):02}:{r.randrange(60):02}", **who)

    def prose(self, lang: str, least: int, most: int, width: int) -> list[str]:
        out = []
        for _ in range(self.rng.randrange(1, 3)):
            text = " ".join(self.pick(self.sentences[lang]) for _ in range(self.rng.randrange(least, most + 1)))
            out += _wrap(text, width) if width else [text]
        return out

    def own(self, lang: str, who: dict, width: int, body: int, end: int) -> list[tuple[str, int]]:
        """What one sender writes: greeting, prose, closing, signature, notice."""
        w, out = WORDS[lang], []
        if self.chance(0.6):
            out.append((self.fill(self.pick(w["greeting"]), self.person()), body))
        out += [(x, body) for x in self.prose(lang, 1, 3, width)]
        if self.chance(0.15):
            out.append((self.pick(["1) 14 % | 20 | 3", "Re: no. Yes.", "12 September: open.", "Sent: three. Kept: one.", "> 30 % of it is done."]), body))
        if self.chance(0.3):  # nothing follows, or a notice alone
            if self.chance(0.5):
                notice = self.fill(self.pick(w["notice"]), who)
                out += [(x, DISC if end == SIGN else end) for x in (_wrap(notice, width) if width else [notice])]
            return out
        if self.chance(0.6):
            out.append((self.pick(w["closing"]), end))
        elif self.chance(0.2):
            out.append((self.pick(["--", "__", "—", "***"]), end))
        if self.chance(0.7):
            out.append((who["n"], end))
            if self.chance(0.5):
                out.append((self.fill(self.pick(w["role"]), who), end))
            r = self.rng
            for line in (f"{self.pick(['Tel. ', 'm ', 'Phone: ', ''])}+{r.randrange(30, 50)} {r.randrange(100, 999)} {r.randrange(10000, 99999)}", f"{self.pick(['Mail: ', 'E: ', ''])}{who['a']}", f"{r.randrange(1, 200)} Harbour Road"):
                if self.chance(0.45):
                    out.append((line, end))
        if self.chance(0.12):
            out.append((self.pick(w["device"]), end))
        if self.chance(0.2):
            notice = self.fill(self.pick(w["notice"]), who)
            out += [(x, DISC if end == SIGN else end) for x in (_wrap(notice, width) if width else [notice])]
        if self.chance(0.04):
            out.append(("_" * r.randrange(20, 50) if self.chance(0.3) and (r := self.rng) else self.fill(self.pick(w["list"]), who), DISC if end == SIGN else end))
        return out

    def message(self) -> tuple[str, list[str], list[int], str, bool, str]:
        """(language, lines, labels, answered text, whether it is whole, sender)."""
        rng = self.rng
        lang = self.pick(list(WORDS))
        w, me, other = WORDS[lang], self.person(), self.person()
        width = self.pick([0, 0, 60, 72, 78])
        mine = self.own(lang, me, width, NEW, SIGN)
        kind = rng.random()
        theirs = self.own(lang, other, self.pick([0, 72]), BARE, ENDING)
        parent = "\n".join(x for x, _ in theirs)
        if kind < 0.25:
            lines, parent = mine, ""
        elif kind < 0.6:  # marked quotation, before or after, or in pieces
            mark = self.pick(["> ", ">", "| ", ">> ", ": "])
            quoted = [(mark + x, QUOTE) for x, _ in theirs]
            if self.chance(0.4):  # some marks were lost on the way, or lines wrapped behind them
                lost = 0.5 if self.chance(0.3) else 0.15
                quoted = [(x, BARE) if k and self.chance(lost) else (mark + x, QUOTE) for k, (x, _) in enumerate(theirs)]
            elif self.chance(0.3):  # wrapped lines whose rest lost the mark
                wrapped = []
                for x, _ in quoted:
                    cut = x.rfind(" ", 0, len(x) - rng.randrange(4, 30)) if len(x) > 60 and self.chance(0.5) else -1
                    wrapped += [(x[:cut], QUOTE), (x[cut + 1 :], QUOTE)] if cut > 40 else [(x, QUOTE)]
                quoted = wrapped
            if self.chance(0.25):  # answers between the lines
                quoted = [y for x in quoted for y in ([x, (self.pick(self.sentences[lang]), NEW)] if self.chance(0.2) else [x])]
            said = [(self.fill(self.pick(w["said"]), other), INTRO)] if self.chance(0.8) else []
            if said and self.chance(0.2) and "<" in said[0][0]:
                a, b = said[0][0].split("<", 1)
                said = [(a.rstrip(), INTRO), ("<" + b, INTRO)]
            block = said + quoted
            lines = block + mine if self.chance(0.45) else mine + block
            if self.chance(0.15) and len(quoted) > 4 and len(mine) > 2:
                cut = rng.randrange(2, len(quoted) - 1)
                lines = said + quoted[:cut] + [(x, NEW) for x in self.prose(lang, 1, 2, width)] + quoted[cut:] + mine
        elif kind < 0.78:  # a forwarded or answered message below, without marks
            keys = self.pick(w["header"])
            values = [f"{other['n']} <{other['a']}>", "12 March 2021 09:14", me["n"], self.pick(["Re: the draft", "Next week", "FW: list"])]
            block = ([(self.pick(w["forward"]), INTRO)] if self.chance(0.5) else []) + [(f"{k}: {v}", INTRO) for k, v in zip(keys, values)] + theirs
            lines = mine + block
            if self.chance(0.5):
                parent = ""
        else:  # the text answered stands above or below, with an introduction or with nothing before it
            said = [(self.fill(self.pick(w["said"]), other), INTRO)] if self.chance(0.4) else []
            lines = mine + said + theirs if self.chance(0.5) else said + theirs + mine
            if not said and self.chance(0.5):
                lines = [row for row in theirs if row[1] == BARE] + mine
        return lang, [x for x, _ in lines], [k for _, k in lines], parent, self.chance(0.7), f"{me['n']} <{me['a']}>"


def _paths(model: Model, lines: list[str], table: list, states: list[int], out: dict, sign: float) -> None:
    """Add the features of a labelling, times ``sign``, to ``out``."""
    mode, before = 0, None
    for line, found, k in zip(lines, table, states):
        row = model.line(found)
        greeted, header = mailtext.conditions(line)
        for name, value in found:
            out["features", name, k] += sign * value
            if k == ENDING:
                out["features", name, SIGN if row[SIGN] >= row[DISC] else DISC] += sign * value
        if before is None:
            out["start", k] += sign
        else:
            out["transitions", before, k] += sign
            if k == NEW:
                if greeted:
                    out["greeted", before] += sign
                if mode == 2:
                    out["reopened",] += sign
        if k == NEW:
            mode = mode or 1
        elif mode == 1 and before is not None and (k in (SIGN, DISC) or header and k == INTRO):
            mode = 2
        before = k


def _added(weights: dict, change: dict, by: float) -> dict:
    out = json.loads(json.dumps(weights))
    for key, v in change.items():
        kind, *rest = key
        v *= by
        if kind == "features":
            row = out["features"].setdefault(rest[0], {})
            row[STATES[rest[1]]] = row.get(STATES[rest[1]], 0.0) + v
        elif kind == "transitions":
            row = out["transitions"].setdefault(STATES[rest[0]], {})
            row[STATES[rest[1]]] = row.get(STATES[rest[1]], 0.0) + v
        elif kind == "reopened":
            out["reopened"] += v
        else:
            out[kind][STATES[rest[0]]] = out[kind].get(STATES[rest[0]], 0.0) + v
    return out


def fit(weights: dict, messages: list, rounds: int = ROUNDS, step: float = STEP) -> dict:
    """The average of the weights after each message."""
    total: dict = defaultdict(float)  # change of the weights, and its sum over time weighted by when it came
    late: dict = defaultdict(float)
    model, t, n = Model(weights), 0, rounds * len(messages)
    for _ in range(rounds):
        for lines, table, want in messages:
            t += 1
            got = model.best(lines, table)
            if [k == NEW for k in got] == [k == NEW for k in want]:
                continue
            change: dict = defaultdict(float)
            _paths(model, lines, table, want, change, 1.0)
            _paths(model, lines, table, got, change, -1.0)
            for key, v in change.items():
                if v and key not in HELD:
                    total[key] += v * step
                    late[key] += v * step * (n - t + 1) / n
            model = Model(_added(weights, total, 1.0))
    return _added(weights, late, 1.0)


def held_out(model: Model, messages: list, langs: list[str]) -> dict[str, tuple[float, float, int]]:
    """Recall and precision of new lines, and their number, by language."""
    sums: dict = defaultdict(lambda: [0, 0, 0])
    for (lines, table, want), lang in zip(messages, langs):
        for a, b in zip(want, model.best(lines, table)):
            for key in (lang, "all"):
                sums[key][0] += a == NEW
                sums[key][1] += b == NEW
                sums[key][2] += a == b == NEW
    return {k: (round(both / max(1, true), 4), round(both / max(1, found), 4), true) for k, (true, found, both) in sorted(sums.items())}


def main(case: str, out: str) -> None:
    from quarrybed.session import session, table

    spark = session("fit", "local[4]")
    rng = random.Random(SEED)
    docs = table(spark, case, "documents").where("lang is not null and n_chars between 200 and 5000").orderBy("doc_id").limit(DOCUMENTS).select("lang", "text").collect()
    sentences: dict[str, list[str]] = defaultdict(list)
    for lang, text in docs:
        for s in " ".join(text.split()).replace("? ", "?|").replace(". ", ".|").split("|"):
            if 30 <= len(s) <= 160 and s[0].isupper() and s[-1] in ".?" and s.count(" ") >= 4 and "@" not in s:
                sentences[lang].append(s)
    parts = table(spark, case, "name_lexicon").where("name_part is not null").orderBy("name_part").collect()
    given, family = ([r.name_part for r in parts if r.part_kind == k and r.name_part[:1].isupper()] for k in ("given", "family"))
    names = [(rng.choice(given), rng.choice(family)) for _ in range(500)]
    composer = Composer(sentences, names, rng)
    made = [composer.message() for _ in range(MESSAGES)]
    rows = [(lines, mailtext.features(lines, mailtext.answered(parent), whole, sender), labels) for _, lines, labels, parent, whole, sender in made]
    cut = MESSAGES * 4 // 5
    weights = json.loads(mailtext.files("quarrybed.llm").joinpath("mail_weights.json").read_text("utf-8"))
    langs = [m[0] for m in made]
    print("before", held_out(Model(weights), rows[cut:], langs[cut:]))
    weights = fit(weights, rows[:cut])
    rounded = json.loads(json.dumps(weights), parse_float=lambda x: round(float(x), 3))
    print("after", held_out(Model(rounded), rows[cut:], langs[cut:]))
    with open(out, "w", encoding="utf-8") as f:
        json.dump(rounded, f, ensure_ascii=False, indent=1, sort_keys=True)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:3])
