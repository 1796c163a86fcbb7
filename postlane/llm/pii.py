"""Problem 5: personal information in free text."""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.llm.quotes import CLOSINGS
from postlane.llm.gazetteers import LEGAL_FORMS, TRADES, fold, short_form_table

TYPES = ("email", "phone", "id_number", "street_address", "name")

# Words that announce an identity number of a person.
ID_WORDS = (
    "passport|passeport|pasaporte|paszport\\w*|paspoort\\w*|reisepass\\w*|social security|ssn|national id|national insurance|identity|identity card|id card|tax id|tax number|tin|"
    "personalausweis\\w*|ausweis\\w*|steuer-?id\\w*|steuernummer|steueridentifikationsnummer|sozialversicherung\\w*|dni|nie|nif|número de identidad|documento de identidad|seguridad social|"
    "carte d.identité|pièce d.identité|sécurité sociale|numéro fiscal|pesel|nip|dow[oó]d\\w*|numer identyfikacyjny|burgerservicenummer|bsn|identiteits\\w*|id-nummer|codice fiscale|carta d.identità|cpf|personnummer|id"
)
# Words that announce a telephone number, and words around records that aren't about persons.
PHONE_WORDS = "tel|phone|telefon\\w*|téléphone|teléfono|telefoon|mobil\\w*|mobile|cell|fax|call|ring|reach me|rufen|erreich\\w*|joindre|appel\\w*|llam\\w*|bereiken|bel|numerem|zadzwo\\w*|[tmf]"
RECORD_WORDS = "po|so|order|reference|ref|ticket|invoice|rechnung|facture|factura|faktura|factuur|vorgang|dossier|asunto|sprawa|sprawę|zaak|case|version|no\\. of|renamed it|see|siehe|voir|véase|zob|zie|genannt|nombre|naam|nom|nazwę na"
# Words of streets.
STREET_TAIL = "street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|square|sq|boulevard|blvd|terrace|close|way|place|pl|crescent|row|walk|gardens|hill|parkway|pkwy|highway|hwy|mews|grove"
STREET_HEAD = "rue|avenue|boulevard|bd|place|allée|impasse|chemin|quai|route|cours|calle|avenida|avda\\.?|plaza|paseo|camino|carrer|ronda|travesía|via|viale|piazza|corso|largo|rua|praça|ul\\.|ulica|al\\.|aleja|pl\\.|os\\.|plac"
STREET_WORD = "straße|strasse|str\\.|gasse|allee|weg|platz|ring|damm|ufer|chaussee|steig|speicher|markt|straat|laan|pad|gracht|kade|plein|dijk|singel|steeg|hof|gatan|vägen"
STREET_LONE = "Speicher|Gracht|Markt|Straße|Gasse|Weg|Platz|Allee|Ring|Damm|Ufer|Tor|Graben|Berg|Hof|Anger|Steg"

_JOIN = re.compile(r"(?<=[^\n]{30})[ \t]*\r?\n((?:[ \t]*(?:[>|»]|[^\W\d_]{1,3}>)[ \t]?)*)(?=[^\s>|»\-*_])")
_DOMAIN = re.compile(r"@[\w\-]+(?:\.[\w\-]+)+")
_DOT_WORD = r"(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\[punkt\]|\(punkt\)|\[\.\]|\(\.\))\s?|\s(?:dot|punkt|punto|point|kropka|punt)\s)"
_DOT = rf"(?:{_DOT_WORD}|\.)"
_SPELLED = re.compile(rf"((?:[\w.+\-]+{_DOT_WORD})*[\w.+\-]+)(?:\s?(?:\[at\]|\(at\)|\{{at\}}|\[a\]|\[ät\]|\(ät\)|\[arroba\]|\(arroba\)|\[małpa\]|\(małpa\)|\[@\]|\(@\))\s?|\s(?:at|arroba|małpa|arobase|chiocciola)\s|\s@\s|\s@(?=\w)|(?<=\w)@\s)([\w\-]+(?:{_DOT}[\w\-]+)*?{_DOT}[a-z]{{2,}})\b", re.I)
_HINT = re.compile(rf"[\[({{](?:at|ät|@|arroba|małpa|a)[\])}}]|\s@|@\s|\s(?:at|arroba|małpa|arobase|chiocciola)\s(?=[\w\-]+{_DOT}[\w\-])", re.I)
#: What every separator contains, in lower case.
_HINT_PARTS = (" @", "@ ", "\n@", "@\n", "@\r", "\t@", "@\t", "@]", "@)", "@}", " at ", "\nat ", "\tat ", "at\n", "(at", "[at", "{at", "[a]", "(a)", "{a}", "ät", "arroba", "małpa", "arobase", "chiocciola")
_NUMBER = re.compile(r"(?<![\w.\-/#+(])(?:\+\d|\(\+?\d{1,4}\)|[A-Z]{3} (?=\d{6}\b)|[A-Z]{0,3}\d)\w*(?:(?:[ .\-/()]{1,2}|[ \t]*\r?\n(?:[ \t]*(?:[>|»]|[^\W\d_]{1,3}>)[ \t]?)*)\d+|-[A-Z]\b)*(?:\s?ext\.?\s?\d{1,5})?")
_ID_WORD = re.compile(rf"(?<!\w)(?:{ID_WORDS})(?!\w)[^\d\n]{{0,34}}$", re.I)
_PHONE_WORD = re.compile(rf"(?<!\w)(?:{PHONE_WORDS})\.?(?!\w)[^\d\n]{{0,46}}$", re.I)
_RECORD_WORD = re.compile(rf"(?<!\w)(?:{RECORD_WORDS})(?!\w)[ .:#(\[]{{0,3}}$", re.I)
# the shapes of the number, with digits as 9 and capital letters as A
_PHONE_SHAPE = re.compile(
    r"\+9{1,3}[ .\-/(9)]{7,}$|\(9{3}\) ?9{3}-9{4}$|\(9{3}\) ?9{4} ext\.? ?9+$|9{3}\.9{3}\.9{4}$|9{3}-9{3}-9{4}$|0[9]{2,4}[/\-] ?9{5,9}$|0?9{4} 9{6}$|99 99 99 99 99$|09{3} 9{3} 9{3}$|9{4} 9{3} 9{3}$|009{1,3}[ .\-/9]{7,}$|9{3} 9{3} 9{4}$|\+9{8,14}$|9{2,5} 9{5,8}$"
)
_ID_SHAPE = re.compile(
    r"A9{8}$|9{4} 9{4} 9{2}$|9{3}-99-9{4}$|A99A99A9{3}$|99 9{3} 9{3} 9{3}$|9{8}-?A$|A-?9{7}-?A$|9{11}$|A{3} ?9{6}$|9{9}$|9{4}\.99\.9{3}$|9 99 99 99 9{3} 9{3}(?: 99)?$|9{10}$|9{12,13}$|9{15}$|A{2} ?99 ?99 ?99 ?A$|9{3}\.9{3}\.9{3}-99$|A{1,2}9{7,9}$|9{3} 9{3} 9{3}$|9{6}[-+]9{4}$|9{3}-9{3}-99-99$|[9A]{9}$"
)
# streets are looked for around house numbers
_HOUSE = re.compile(r"(?<![\w/.,+#\-])\d{1,6}(?![\d.:%])[a-zA-Z]?(?!\w)")
_PARTICLE = r"(?:(?:de|du|des|d|la|las|los|del|le|les|di|della|van|der|den|da|do|dos|św\.) |l['’]|d['’])*"
_AFTER_HOUSE = re.compile(
    rf",? (?:(?-i:[A-Z])[\w'’]+ ){{1,3}}(?:{STREET_TAIL})\b|,? (?:bis,? )?(?:{STREET_HEAD}) {_PARTICLE}(?-i:[A-ZÀ-ÖØ-Ž])[\w'’]+(?:[ \-]{_PARTICLE}(?-i:[A-ZÀ-ÖØ-Ž])[\w'’]+){{0,3}}", re.I
)
_BEFORE_HOUSE = re.compile(
    rf"(?<!\w)(?:(?:{STREET_HEAD}) {_PARTICLE}(?-i:[A-ZÀ-ÖØ-Ž])[\w'’.]+(?:[ \-]{_PARTICLE}(?-i:[A-ZÀ-ÖØ-Ž])[\w'’.]+){{0,3}},?(?: n[°ºo]\.?)? "
    rf"|(?-i:[A-ZÄÖÜ])[\w\-]{{2,}}(?:{STREET_WORD}) |(?:(?-i:Am|An der|Auf dem|Im|In der|Zum|Zur) )?(?:(?-i:[A-ZÄÖÜ])[\w\-]+ ){{1,2}}(?-i:{STREET_LONE}) )$", re.I
)
_WORD_ENDS = tuple(x.lower() for x in f"{STREET_WORD.replace('str' + chr(92) + '.', 'str.')}|{STREET_LONE}".split("|"))
_HEAD_STARTS = tuple(re.sub(r"\W.*$", "", x) + (". " if "." in x else " ") for x in STREET_HEAD.split("|"))
_ADDRESS_WORD = re.compile(r"(?:address|anschrift|adresse|dirección|adres|courier|lieferung|livraison|entrega|levering|przesyłka|visit|office|an|au|a|to|naar|na|ir|aller|:)\W*(?:\w+ ){0,3}$", re.I)
_LINE_START = re.compile(r"(?:^|\n)[ \t>|»A-Z]*$")

_CAP = re.compile(r"(?<![\w@/+\-])[A-ZÀ-ÖØ-ÞĀ-Ž][^\W\d_]*(?:['’\-](?=[^\W\d_])[^\W\d_]+)*")
_NEXT = re.compile(r"[ \t]+(?:[A-ZÀ-ÖØ-ÞĀ-Ž]\.[ \t]+)?([A-ZÀ-ÖØ-ÞĀ-Ž][^\W\d_]+(?:['’\-][^\W\d_]+)*)(?![@\d_])")
_NEXT_INITIAL = re.compile(r"\.[ \t]+([A-ZÀ-ÖØ-ÞĀ-Ž][^\W\d_]{2,}(?:['’\-][^\W\d_]+)*)(?![@\d_])")
_PREVIOUS = re.compile(r"(?<![\w@./+\-])([A-ZÀ-ÖØ-ÞĀ-Ž][^\W\d_]{2,}(?:['’\-][^\W\d_]+)*)(,[ \t]+|[ \t]+)$")
_WROTE = "wrote|writes|schrieb|écrit|escribi|napisa|pisze|schreef"
_HEADER = re.compile(rf"{_WROTE}|<[^>\n]*@|\b(?:From|Von|Od|Van)\b ?:|^\W*De ?:|\d:\d\d,? $")
# names without capitals stand where mail programs print them
_PRINTED = ("wrote", "schrieb", "écrit", "escribi", "napisa", "pisze", "schreef", "From: ", "Von: ", "De: ", "Od: ", "Van: ")
_PRINTED_IN = re.compile("|".join(_PRINTED))
_LOWER = re.compile(r"(?<![\w@./+\-])([a-zà-öø-ÿāăąćčďęěğłńňóőřśšşťůűźżž]{2,}) +([a-zà-öø-ÿāăąćčďęěğłńňóőřśšşťůűźżž]{4,})(?=[ \t]*(?:<|\n|:|,|$| (?:wrote|writes|schrieb|a écrit|escribi|napisa|pisze|schreef)))")

_SHORT = short_form_table()
# Capitalised words that often follow or precede a given name without being a family name.
NOT_SURNAME = set(
    "atlas index pilot gateway bridge desk register rollout sprint stack planner portal relay ledger archive beacon street road lane avenue ave team hello hi dear hallo liebe lieber guten bonjour hola beste "
    "from to sent subject von an betreff gesendet de para enviado asunto od do temat van aan onderwerp objet envoyé monday tuesday wednesday thursday friday saturday sunday january february march april may june july august "
    "september october november december mon tue wed thu fri sat sun jan feb mar apr jun jul aug sep oct nov dec the and die der das wir ich es sie der nous il elle je le la les el los las una nosotros my our please could "
    "would if when nobody somebody reference thanks we it there if let vielen dank bitte wenn unser mein meine notre mon votre nuestro mi su nasz moja onze mijn als ik het op am on le el with as or so und oder ou y e i en of van voor regards grüße sincerely via lists re fwd fw aw".split()
) | {t for t in TRADES} | {x.rstrip(".") for x in LEGAL_FORMS}


def _near_given() -> dict[str, str]:
    """Each given name without one of its letters, for spellings that are off by one."""
    out: dict[str, str] = {}
    for g in _SHORT:
        if len(g) >= 6:
            for i in range(len(g)):
                out.setdefault(g[:i] + g[i + 1 :], g)
    return out


_NEAR = _near_given()
CLOSING_WORDS = {fold(w) for line in CLOSINGS.splitlines() for c in line.split("|") for w in c.split()}
_KIND: dict[str, int] = {}


def _given(word: str) -> int:
    """2: a given name or short form; 1: off by one letter from one; 0: neither."""
    got = _KIND.get(word)
    if got is None:
        if len(_KIND) > 300_000:
            _KIND.clear()
        f = fold(word)
        if f in _SHORT:
            got = 2
        elif len(f) >= 5 and (any(f[:i] + f[i + 1 :] in _NEAR or f[:i] + f[i + 1 :] in _SHORT and len(f) > 5 for i in range(len(f))) or f in _NEAR):
            got = 1
        else:
            got = 0
        _KIND[word] = got
    return got


def flatten(text: str) -> str:
    """The text with wrapped lines joined by blanks in place of the line end and quote marks; every position stays."""
    return _JOIN.sub(lambda m: " " * len(m.group(0)), text) if "\n" in text else text


_DOTTED = re.compile(r"\d{3}\.\d{3}\.")
_DATE = re.compile(r"(?:19|20)\d\d[-./]\d|\d{1,2}[./]\d{1,2}[./](?:19|20)\d\d")
_BAR = re.compile(r"(?:^|\n|\|)[ \t>|»]*(?:[A-Za-z]{1,6}\.?:? ?)?$")
_GAP = re.compile(r"\s+(?:(?:[>|»]|[^\W\d_]{1,3}>)\s*)*")


_STOP = re.compile(r"[\d\n]")
_DOT_WORD_END = re.compile(_DOT_WORD + "$", re.I)
#: A dot in words has ten characters at most.
_DOT_WORD_SIZE = 10


class _Lines:
    """Where the lines of a text and the runs without digits begin, for rules that look back; each text is walked once."""

    def __init__(self, flat: str):
        self.flat, self.stops, self.line, self.header = flat, None, (0, -1), False

    def since_digit(self, at: int) -> int:
        """The place after the last digit or line end before ``at``."""
        if self.stops is None:
            self.stops = [m.end() for m in _STOP.finditer(self.flat)]
        k = bisect.bisect_right(self.stops, at)
        return self.stops[k - 1] if k else 0

    def in_header(self, at: int) -> bool:
        """Whether a mail program printed the line: the head of a quoted or forwarded mail."""
        lo, hi = self.line
        if not lo <= at <= hi:
            lo, hi = self.flat.rfind("\n", 0, at) + 1, self.flat.find("\n", at)
            hi = len(self.flat) if hi < 0 else hi
            self.line, self.header = (lo, hi), _HEADER.search(self.flat, lo, hi) is not None
        return self.header


def _word_before(flat: str, at: int) -> tuple[int, bool]:
    """``(start, comma)`` of the word that ends in blanks, or a comma and blanks, at ``at``; start is -1 if there is none."""
    i = at
    while i and flat[i - 1] in " \t":
        i -= 1
    if i == at:
        return -1, False
    comma = i > 0 and flat[i - 1] == ","
    end = i - comma
    j = end
    while j and (flat[j - 1].isalpha() or flat[j - 1] in "'’-"):
        j -= 1
    while j < end and not flat[j].isalpha():
        j += 1
    return (j, comma) if j < end else (-1, comma)


def _spelled_start(flat: str, at: int) -> int:
    """Where the local part of an address in words begins that ends before ``at``: words joined by dots in words."""
    i = at
    while i and flat[i - 1] in " \t":
        i -= 1
    while True:
        while i and (flat[i - 1].isalnum() or flat[i - 1] in "_.+-"):
            i -= 1
        m = _DOT_WORD_END.search(flat, max(0, i - _DOT_WORD_SIZE), i)
        if not m or m.start() == 0 or not (flat[m.start() - 1].isalnum() or flat[m.start() - 1] in "_.+-"):
            return i
        i = m.start()


def _shape(s: str) -> str:
    return "".join("9" if c.isdigit() else "A" if c.isalpha() and c.isupper() else c for c in s)


def candidates(text: str, subject: bool) -> Iterator[tuple[int, int, str, tuple[int, ...]]]:
    """``(start, end, type, votes)``: spans with the votes of the labelers of their type: 1 for, 0 none, -1 against."""
    flat = flatten(text)
    lines = _Lines(flat)
    taken = []
    at = flat.find("@")
    while at >= 0:
        a = at
        while a and (flat[a - 1].isalnum() or flat[a - 1] in "._+-"):
            a -= 1
        m = _DOMAIN.match(flat, at) if a < at else None
        if m:
            tld = m.group(0).rpartition(".")[2]
            yield a, m.end(), "email", (1, 0, 1 if tld.isalpha() and len(tld) > 1 else -1, 0)
            taken.append((a, m.end()))
        at = flat.find("@", m.end() if m else at + 1)
    last = -1
    low = flat.lower()
    # a separator can only be where one of these is
    for hint in _HINT.finditer(flat) if any(w in low for w in _HINT_PARTS) else ():
        if hint.start() < last:
            continue
        m = _SPELLED.match(flat, _spelled_start(flat, hint.start()))
        if not m or m.start() < last or any(a < m.end() and m.start() < b for a, b in taken):
            continue
        words = re.search(r"[\[({]|\s(?:dot|punkt|punto|point|kropka|punt)\s", m.group(0), re.I) is not None
        local = m.group(1)
        yield m.start(), m.end(), "email", (0, 1, 1 if m.group(2)[-2:].isalpha() else -1, 1 if words or "@" in m.group(0) else -1 if local.isalpha() and len(local) < 6 else 0)
        taken.append((m.start(), m.end()))
        last = m.end()
    streets = []
    heads = any(x in low for x in _HEAD_STARTS)
    for h in _HOUSE.finditer(flat):
        a, b = h.span()
        if streets and a < streets[-1][1]:
            continue
        m = _AFTER_HOUSE.match(flat, b)
        start, end = (a, m.end()) if m else (-1, -1)
        if not m:
            slice_ = flat[lines.since_digit(a) : a]
            word = slice_.rstrip(" ,")
            word = word[word.rfind(" ") + 1 :].lower()
            if not slice_.endswith(" ") or not (word.endswith(_WORD_ENDS) or heads):
                continue
            m = _BEFORE_HOUSE.search(slice_)
            if not m:
                continue
            start, end = a - len(slice_) + m.start(), b
        before = flat[flat.rfind("\n", 0, start) + 1 : start] if start < 200 else flat[max(flat.rfind("\n", 0, start), lines.since_digit(start) - 1) + 1 : start]
        yield start, end, "street_address", (1, 1 if _LINE_START.search(before) or _ADDRESS_WORD.search(before) else 0, 1, -1 if _RECORD_WORD.search(before) else 0)
        streets.append((start, end))
    for m in _NUMBER.finditer(flat):
        s = m.group(0).rstrip(" .-/(")
        if "\n" in s:
            # a number that is whole before the line end doesn't go on after it
            short = s[: s.index("\n")].rstrip()
            whole = _shape(_GAP.sub(" ", short))
            if _PHONE_SHAPE.match("0" + whole[1:] if short[:1] == "0" else whole) or _PHONE_SHAPE.match(whole) or _ID_SHAPE.match(whole):
                s = short
        digits = sum(map(str.isdigit, s))
        if digits < 6:
            continue
        if any(a < m.end() and m.start() < b for a, b in taken) or any(a < m.start() + 1 and m.start() < b for a, b in streets):
            continue
        start = m.start()
        before = flat[lines.since_digit(start) : start]
        squeezed = _GAP.sub(" ", s)
        shape = _shape(squeezed)
        id_shape = _ID_SHAPE.match(shape) is not None
        phone_shape = _PHONE_SHAPE.match("0" + shape[1:] if squeezed[0] == "0" else shape) is not None or _PHONE_SHAPE.match(shape) is not None
        lead = squeezed[0] in "+(0" or _DOTTED.match(squeezed) is not None
        sure_phone = phone_shape and lead and not id_shape
        id_word = not sure_phone and _ID_WORD.search(before) is not None
        if id_shape or (id_word and digits >= 6):
            record = not id_word and _RECORD_WORD.search(before) is not None
            yield start, start + len(s), "id_number", (1 if id_shape else 0, 1 if id_word else -1, -1 if record else 0, -1 if phone_shape and not id_word else 0)
        phone_word = not sure_phone and not id_word and _PHONE_WORD.search(before) is not None
        if phone_shape or (phone_word and digits >= 7 and not id_word):
            if _DATE.match(squeezed):
                continue
            bar = sure_phone or _BAR.search(flat[flat.rfind('\n', 0, start) + 1 : start] if start == 0 or flat[start - 1] != '\n' else '') is not None
            yield start, start + len(s), "phone", (1 if phone_shape else -1, 1 if phone_word or bar else 0, -1 if id_word else 0, 1 if lead else -1)
    yield from _names(flat, subject, lines)


def _names(flat: str, subject: bool, lines: _Lines) -> Iterator[tuple[int, int, str, tuple[int, ...]]]:
    used, known, size = -1, _KIND, len(flat)
    for m in _CAP.finditer(flat):
        a, b = m.span()
        if a < used:
            continue
        w = m.group(0)
        if b - a == 1:
            # an initial before a family name
            n = _NEXT_INITIAL.match(flat, b)
            p = None
            if b < size and flat[b] == "." and flat[a - 2 : a - 1] == "," and (at := _word_before(flat, a)[0]) >= 0:
                p = _PREVIOUS.match(flat, at, a)
            if p and fold(p.group(1)) not in NOT_SURNAME and _given(p.group(1)) < 2:
                start = p.start(1)
                if start >= used:
                    v = (0, 1, 1 if lines.in_header(start) or start and flat[start - 1] == " " else 0, 0)
                    yield start, b + 1, "name", v
                    used = b + 1
                continue
            if not n or (a > 1 and flat[a - 1] == "."):
                continue
            s = n.group(1)
            given_before = a > 1 and flat[a - 1] == " " and (at := _word_before(flat, a)[0]) >= 0 and _given(flat[at:a].rstrip(" ,\t")) == 2
            if fold(s) in NOT_SURNAME or given_before:
                continue
            yield a, n.end(1), "name", (1, 1, 1 if lines.in_header(a) else 0, 0)
            used = n.end(1)
            continue
        g = known.get(w)
        if g is None:
            g = _given(w)
        if not g or (b < size and flat[b] in "@_" or b + 1 < size and flat[b] == "." and flat[b + 1].isalnum()):
            continue
        n = _NEXT.match(flat, b)
        p = None
        if a > 3 and flat[a - 1] in " \t" and (flat[a - 2] == "," or flat[a - 2].isupper() or flat[a - 2] in " \t") and (at := _word_before(flat, a)[0]) >= 0:
            p = _PREVIOUS.match(flat, at, a)
        best = None
        if n:
            s = n.group(1)
            ok = len(s) >= 3 and fold(s) not in NOT_SURNAME and (_given(s) < 2 or s.isupper())
            trade = not ok or (m2 := _NEXT.match(flat, n.end(1))) is not None and fold(m2.group(1)) in TRADES and g == 1
            if ok:
                best = (a, n.end(1), (1 if g == 2 else -1, 1, 1 if g < 2 and lines.in_header(a) else 0, -1 if trade else 0))
        if p and p.start(1) >= used:
            s, comma = p.group(1), p.group(2)[0] == ","
            ok = fold(s) not in NOT_SURNAME and _given(s) < 2 and fold(s) not in CLOSING_WORDS
            start = p.start(1)
            line = lines.in_header(start)
            opens = start == 0 or flat[start - 1] == "\n" or _LINE_START.search(flat, max(0, start - 12), start) is not None or flat[max(0, start - 2) : start] in (". ", "? ", "! ")
            if ok and (comma or s.isupper()) and (line or s.isupper() or not opens):
                v = (1 if g == 2 else -1, 1, 1, 0 if line or not comma or not subject else 0)
                if best is None or sum(v) > sum(best[2]) or not comma or line:
                    best = (start, b, v)
        if best is None:
            continue
        yield best[0], best[1], "name", best[2]
        if sum(best[2]) > 0:
            used = best[1]
    starts = () if not any(x in flat for x in _PRINTED) else sorted({flat.rfind("\n", 0, m.start()) + 1 for m in _PRINTED_IN.finditer(flat)})
    for lo in starts:
        hi = flat.find("\n", lo)
        for m in _LOWER.finditer(flat, lo, size if hi < 0 else hi):
            x, y = m.group(1), m.group(2)
            gx, gy = _given(x), _given(y)
            if (gx == 2 or gy == 2 or gx == 1) and fold(y) not in NOT_SURNAME and fold(x) not in NOT_SURNAME:
                yield m.start(), m.end(), "name", (1 if max(gx, gy) == 2 else 0, 1, 1, 0 if max(gx, gy) == 2 else -1)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder in place of each span; everything else stays."""
    out, at = [], 0
    for a, b, t in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{t.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def reliabilities(patterns: Counter, rounds: int = 50) -> tuple[dict, dict]:
    """``(reliability, posterior)`` by EM over vote patterns ``(type, votes) -> count``.

    The model of a type: a candidate is as likely real as not, and a labeler that doesn't abstain is right with its own
    probability, the same for real and false candidates, and no worse than chance. All labelers start equal; expectation
    weighs every vote by the log odds of its labeler, maximisation counts how often each agrees with the result (with a prior
    of 4 right and 1 wrong). A labeler that votes for everything, as a shape may, so ends without weight.
    ``reliability[type]`` is one probability a labeler; ``posterior[(type, votes)]`` that of the candidate being real.
    """
    reliability, posterior = {}, {}
    for t in TYPES:
        rows = [(v, n) for (k, v), n in patterns.items() if k == t]
        if not rows:
            continue
        votes, n = np.array([v for v, _ in rows], dtype=float), np.array([c for _, c in rows], dtype=float)
        right = np.full(votes.shape[1], 0.8)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(votes @ np.log(right / (1 - right)), -30, 30)))
            agrees = ((votes > 0) * q[:, None] + (votes < 0) * (1 - q)[:, None]) * n[:, None]
            right = np.clip((agrees.sum(0) + 4) / (((votes != 0) * n[:, None]).sum(0) + 5), 0.5, 0.995)
        reliability[t] = right
        posterior |= {(t, v): float(p) for (v, _), p in zip(rows, q)}
    return reliability, posterior


#: Places of the span classifier's hashed features, and how many results a worker keeps for reuse.
SLOTS, KEPT = 1 << 14, 200_000
_SIGNS = "@.-/+(),"


def _char_class(c: str) -> str:
    return "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c


def span_key(text: str, a: int, e: int, kind: str, votes: tuple[int, ...]) -> tuple:
    """What the classifier sees of a candidate: type, votes, size, ends, blanks and signs of the span, and the word and signs around it."""
    span = text[a:e]
    i = a
    while i and text[i - 1] in " \t:.#([\"'":
        i -= 1
    j = i
    while j and text[j - 1].isalpha():
        j -= 1
    before, after = text[a - 1 : a], text[e : e + 1]
    signs = "".join([x for x in _SIGNS if x in span])
    return kind, votes, min(40, e - a) >> 2, _char_class(span[0]), _char_class(span[-1]), span.count(" "), signs, text[j:i].lower(), before, after


def span_features(key: tuple) -> tuple[int, ...]:
    """The hashed features of a ``span_key``."""
    kind, votes, *rest = key
    parts = [f"{n} {x}" for n, x in enumerate(rest)] + [f"vote {n} {v}" for n, v in enumerate(votes)]
    return tuple(zlib.crc32(f"{kind} {x}".encode()) % SLOTS for x in parts)


def fit_spans(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 300, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Logistic weights of the slots, by batch gradient steps, from ``(features, posterior, count)``; slot ``SLOTS`` is the bias."""
    w = np.zeros(SLOTS + 1)
    if not rows:
        return w
    x = np.array([(*f, SLOTS) for f, _, _ in rows])
    y, n = np.array([p for _, p, _ in rows]), np.array([c for _, _, c in rows], dtype=float)
    n /= n.sum()
    seen = np.zeros_like(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat(n * (p - y), x.shape[1]), SLOTS + 1) + l2 * w
        seen += g * g
        w -= rate * g / np.sqrt(seen + 1e-12)
    return w


def _candidate_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for b in batches:
        for subject, body in zip(b["subject"], b["body_text"]):
            for text, s in ((subject, True), (body, False)):
                if text:
                    seen.update(span_key(text, a, e, t, v) for a, e, t, v in candidates(text, s))
    yield pd.DataFrame([(k[0], list(k[1]), list(span_features(k)), c) for k, c in seen.items()], columns=["kind", "votes", "features", "n"])


def train(emails: DataFrame, mails: int = 4000) -> np.ndarray:
    """The weights of the span classifier, from the candidates of about ``mails`` rows chosen by a hash of their id.

    The labelers' votes in the sample give their reliabilities and each candidate's posterior (``reliabilities``); the
    classifier is fitted on the posteriors. Rows are chosen in their place, so no text moves; what reaches the driver is
    the sample's candidates as numbers.
    """
    share = min(1.0, mails / max(1, emails.count()))
    limit = int(share * (1 << 30))
    sample = emails.where(F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), "pos"), F.lit(1 << 30)) < limit) if share < 1 else emails
    found = sample.select("subject", "body_text").mapInPandas(_candidate_batches, "kind string, votes array<int>, features array<int>, n bigint").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).collect()
    patterns: Counter = Counter()
    for r in found:
        patterns[(r.kind, tuple(r.votes))] += r.n
    _, posterior = reliabilities(patterns)
    return fit_spans([(tuple(r.features), posterior[(r.kind, tuple(r.votes))], r.n) for r in sorted(found)])


def probability(weights: np.ndarray, features: tuple[int, ...]) -> float:
    return float(1 / (1 + np.exp(-max(-30.0, min(30.0, weights[list(features)].sum() + weights[SLOTS])))))


def _judge(weights: np.ndarray):
    """The probability of a candidate, kept by its features."""
    known: dict = {}

    def of(text: str, a: int, e: int, kind: str, votes: tuple[int, ...]) -> float:
        key = span_key(text, a, e, kind, votes)
        p = known.get(key)
        if p is None:
            if len(known) >= KEPT:
                known.clear()
            p = known[key] = probability(weights, span_features(key))
        return p

    return of


def spans(emails: DataFrame, train_mails: int = 4000) -> DataFrame:
    """``pos, id, field, start_pos, end_pos, pii_type, score`` of each occurrence in ``subject`` and ``body_text``.

    Labelers - patterns, word lists and context rules - vote on candidate spans. Expectation-maximisation over the
    votes in a sample of about ``train_mails`` mails estimates how far each labeler is right; a logistic span classifier on the
    span's shape, its surroundings and the votes, trained on the posteriors, scores every candidate of every text. Where spans of the same type overlap, the first stays.

    Positions count Unicode code points from 1; ``end_pos`` is the position after the last. Wrapped and quoted
    lines are read as one, positions unchanged. Null and empty texts have no spans; texts are read whole, however
    long; repeated rows give repeated spans; an empty table gives no rows. Rows without id are kept with a null id.
    """
    model = train(emails, train_mails)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = _judge(model)
        for b in batches:
            out = []
            for pos, i, subject, body in zip(b["pos"], b["id"], b["subject"], b["body_text"]):
                for field, text in (("subject", subject), ("body_text", body)):
                    if not text:
                        continue
                    end_of = dict.fromkeys(TYPES, -1)
                    for a, e, t, v in candidates(text, field == "subject"):
                        p = judge(text, a, e, t, v)
                        if p >= 0.5 and a >= end_of[t]:
                            end_of[t] = e
                            out.append((pos, i, field, a + 1, e + 1, t, p))
            yield pd.DataFrame(out, columns=["pos", "id", "field", "start_pos", "end_pos", "pii_type", "score"])

    return emails.select("pos", "id", "subject", "body_text").mapInPandas(find, "pos bigint, id string, field string, start_pos bigint, end_pos bigint, pii_type string, score double")


def found_spans(emails: DataFrame) -> DataFrame:
    """``id, field, start_pos, pii_type`` of each occurrence, each mail once (its first row)."""
    first = emails.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("pos").alias("pos"))
    return spans(emails).join(first, ["id", "pos"], "left_semi").select("id", "field", "start_pos", "pii_type")


def masked_texts(emails: DataFrame, train_mails: int = 4000) -> DataFrame:
    """``pos, id, subject, body_text`` with typed placeholders in place of what ``spans`` finds; null stays null."""
    model = train(emails, train_mails)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = _judge(model)

        def mask(text: str | None, subject: bool) -> str | None:
            if not text:
                return text
            return masked(text, [(a, e, t) for a, e, t, v in candidates(text, subject) if judge(text, a, e, t, v) >= 0.5])

        for b in batches:
            yield b.assign(subject=[mask(x, True) for x in b["subject"]], body_text=[mask(x, False) for x in b["body_text"]])

    return emails.select("pos", "id", "subject", "body_text").mapInPandas(run, "pos bigint, id string, subject string, body_text string")
