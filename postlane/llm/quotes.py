"""Problem 2: the text that a mail's sender newly wrote."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.llm import boosting, conversations
from postlane.llm.gazetteers import LEGAL_FORMS, fold, short_form_table
from postlane.operators.ranking import running
from postlane.session import cut, stage

# Phrases of mail in English, German, French, Spanish, Polish, Dutch, Italian, Portuguese and Swedish.
CLOSINGS = """cheers|kind regards|best regards|warm regards|warmest regards|regards|many thanks and best wishes|many thanks|best wishes|all the best|best|yours sincerely|yours faithfully|yours truly|sincerely|thanks|thank you|thanks and regards|thx|take care|talk soon|see you
mit freundlichen grüßen|mit freundlichem gruß|freundliche grüße|mfg|beste grüße|viele grüße|liebe grüße|herzliche grüße|schöne grüße und bis bald|schöne grüße|vg|lg|bis bald|gruß|grüße|danke|vielen dank und viele grüße|hochachtungsvoll
cordialement|bien cordialement|sincères salutations|salutations distinguées|bien à vous|merci et bonne journée|bonne journée|bonne soirée|à bientôt|amicalement|cdlt|merci
saludos|saludos cordiales|un saludo|un cordial saludo|atentamente|muchas gracias y un abrazo|un abrazo|gracias|muchas gracias|hasta pronto
pozdrawiam|pozdrowienia|z poważaniem|z wyrazami szacunku|serdecznie pozdrawiam i dziękuję|serdecznie pozdrawiam|serdeczne pozdrowienia|dziękuję|pozdr|do usłyszenia
met vriendelijke groet|met vriendelijke groeten|vriendelijke groet|vriendelijke groeten|groeten|groetjes|groet|mvg|alvast bedankt en tot snel|alvast bedankt|tot snel|bedankt|hartelijke groet
cordiali saluti|distinti saluti|saluti|un saluto|a presto|grazie|atenciosamente|cumprimentos|com os melhores cumprimentos|obrigado|obrigada|abraços|med vänliga hälsningar|vänliga hälsningar|hälsningar|mvh|tack|tack och hej då|hej då|med venlig hilsen|venlig hilsen"""
WROTE = r"(?:wrote|writes|schrieb|schreibt|a écrit|écrit|escribió|escribe|napisał\(a\)|napisał|napisała|pisze|schreef|schrijft|ha scritto|scrisse|escreveu|skrev|skriver)"
HEADS = (
    "From|Sent|To|Subject|Date|Cc|Bcc|Von|Gesendet|An|Betreff|Datum|Kopie|De|Envoyé|À|A|Objet|Date d'envoi|Enviado|Enviado el|Para|Asunto|Fecha|Od|Wysłano|Do|Temat|Data|DW|"
    "Van|Verzonden|Aan|Onderwerp|Da|Inviato|Oggetto|Från|Skickat|Till|Ämne|Reply-To"
)
FORWARDED = r"(?:original message|forwarded|ursprüngliche nachricht|weitergeleitet\w*|message d.origine|message transféré|mensaje original|mensaje reenviado|wiadomość oryginalna|wiadomość przekazana|oorspronkelijk bericht|doorgestuurd|messaggio originale|messaggio inoltrato|ursprungligt meddelande|vidarebefordra\w*)"
DEVICE = (
    r"^(?:sent from (?:my|a|the)\b|sent (?:via|with|using)\b|get (?:the )?\w+(?: app)? for\b|gesendet (?:von|mit|über)\b|von mein\w+ .{1,30} gesendet|envoyé (?:de|depuis|avec)\b|enviado (?:desde|con)\b|wysłane? (?:z|za pomocą)\b|verstuurd (?:vanaf|met|via)\b|verzonden (?:vanaf|met|via)\b|inviato da\b|skickat från\b|enviado do\b)"
)
WARNING = (
    r"^(?:\W*\[?(?:ext|extern\w*|zewnętrzn\w*|externo|esterno)\b[\]:\s].*|\W*(?:caution|warning|achtung|attention|atención|uwaga|let op|attenzione|varning)\s?:.*|\W*external (?:mail|e-?mail|sender|message)\b.*)"
)
NOTICE = (
    "confidential|privileged|addressee|virus|liabilit|registered office|company no|views above|no contract|do not bind|our consent|before you print|vertraulich|rechtlich nicht bindend|ausdrucken|irrtümlich|confidentiel|n'engage pas|planète|d'imprimer|vinculante|confidencial|imprimir|poufn|wydrukujesz|vertrouwelijk|afdrukt|geadresseerde|riservat|konfidentiell"
).split("|")
FOOTER = (
    "unsubscribe|signed up for our|to stop these|change your preferences|do not reply to this|automatic message|unseren rundbrief|abmelden können|abbestellen|auf diese automatische|désabonn|lettre d'information|abonné à notre|ne pas répondre à ce|message automatique|nuestro boletín|darse de baja|no responda a este|mensaje automático|nasz biuletyn|wypisać|prosimy nie odpowiadać|automatyczną wiadomość|onze nieuwsbrief|afmelden kan|automatische bericht|disiscriver|avregistrera"
).split("|")
SALUTATION = r"^(?:hi|hello|hey|dear|good (?:morning|afternoon|evening|day)|hallo|liebe\w*|guten (?:tag|morgen|abend)|sehr geehrte\w*|moin|bonjour|bonsoir|cher|chère|salut|hola|buen[oa]s|estimad\w+|querid\w+|cześć|dzień dobry|witam|szanown\w+|goede\w*|beste|geachte|ciao|buongiorno|gentile|olá|hej|god morgon)\b.{0,60}$"
PS = re.compile(r"^(?:p\.? ?p?\.? ?s\.?|pd|ps|n\.?b\.?)\s*[:.)\-]?\s", re.I)

_CLOSE = re.compile(rf"^(?:{'|'.join(sorted((re.escape(c) for l in CLOSINGS.splitlines() for c in l.split('|')), key=len, reverse=True))})(?P<mark>[,.!]*)(?P<rest>\s+\S.{{0,40}})?$", re.I)
_MARK = re.compile(r"^\s*(?:(?:[>|»]|[^\W\d_]{1,3}>)[ \t]?)+")
_RULE = re.compile(r"^\s*(?:[-_=*~#+.]{2,})\s*$")
_SEP = re.compile(rf"^\s*-{{2,}}\s*.*{FORWARDED}.*-{{2,}}\s*$|^\s*(?:begin forwarded message|anfang der weitergeleiteten nachricht|début du message (?:réexpédié|transféré)|inicio del mensaje reenviado|początek (?:przekazanej|przekazywanej) wiadomości|begin doorgestuurd bericht|inizio messaggio inoltrato)\s*:\s*$", re.I)
_HEAD = re.compile(rf"^\s*\**(?:{HEADS})\s?:\**\s*(?P<value>.*)$")
_INTRO_START = re.compile(r"^(?:On|Am|Le|El|Op|W dniu|Dnia|Il|Em|Den|\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b.*|.{2,80}<[^>]*@[^>]*>|.{2,60}\b" + WROTE + r"\b)")
_INTRO = re.compile(rf"^(?P<intro>(?:(?=.{{0,160}}?\d{{1,2}}[.:h]\d{{2}}).{{4,220}}?\b{WROTE}(?:\s(?:on|am|le|el|op|w dniu|dnia)\s.{{4,60}}?\d{{1,2}}[:.h]\d{{2}})?(?:\s?:|$))|(?:(?:On|Am|Op)\s.{{6,60}}?\d{{1,2}}:\d{{2}},?\s(?:schrieb|schreef)\s.{{2,120}}?:(?=\s|$)))\s*(?P<rest>.*)$", re.S)
_DEVICE, _WARNING, _SALUTE = (re.compile(x, re.I) for x in (DEVICE, WARNING, SALUTATION))
_PHONE = re.compile(r"\d[\d ().\-/]{6,}\d")
_SLASH = re.compile(r"^/[^\W\d_]{1,3}$")
_WORD = re.compile(r"\w+")
_VISIBLE = re.compile(r"[^\s​-‏ - ⁠-⁤﻿­]")
_LEGAL_END = tuple(f" {x}{dot}" for x in LEGAL_FORMS for dot in ("", "."))
_SHORT = {k: set(v) for k, v in short_form_table().items()}


class _Beginning(dict):
    """Whether three characters can begin what ``expression`` matches, by its own rules of case, kept by the characters.

    A cheap condition that must hold before the expression itself is tried. Each of its alternatives has to begin with two
    or three letters (or spaces after the first), none of them optional, or with ``\\W*``; alternatives further inside only let more through.
    """

    def __init__(self, expression: str):
        starts = sorted(set(re.findall(r"(?:\(\?:|\||^)(\w[\w ]{1,2})", expression)))
        self.begins = re.compile("|".join(starts + [r"\W"] * (r"\W*" in expression)), re.I)

    def __missing__(self, three: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        got = self[three] = self.begins.match(three) is not None
        return got


_MAY_CLOSE, _MAY_DEVICE, _MAY_WARN, _MAY_SALUTE = (_Beginning(x) for x in (CLOSINGS.replace("\n", "|"), DEVICE, WARNING, SALUTATION))
_RULE_MARKS = frozenset("-_=*~#+.")
_WROTE_WORDS = WROTE[3:-1].replace("\\", "").split("|")
#: One of them stands in every line that ``WROTE`` finds anything in.
_WROTE_PARTS = [w for w in _WROTE_WORDS if not any(v != w and v in w for v in _WROTE_WORDS)]

FEATURES = (
    "depth marked_run marked_alone after_intro intro header inline_quote rule closing since_closing sign_mark contact device notice warning footer frequency overlap words ps salutation name_line from_end after_footer start_of_parent company after_sign"
).split()
_AT = {f: i for i, f in enumerate(FEATURES)}
#: Beside the features, for the evidence that labels the sample: whether the line stands in the parent word for word.
IN_PARENT, N = len(FEATURES), len(FEATURES) + 1


def _quotes(text: str) -> bool:
    """Whether the text has a sign that ``_MARK`` needs."""
    return ">" in text or "|" in text or "»" in text


_ASCII_WORDS = "".join(c if c.isalnum() or c == "_" else " " for c in map(chr, range(128)))


def _words(text: str) -> list[str]:
    """What ``_WORD`` finds."""
    return text.translate(_ASCII_WORDS).split() if text.isascii() else _WORD.findall(text)


def _grams(w: list[str]) -> Iterator[tuple]:
    return zip(w, w[1:], w[2:], w[3:], w[4:])


_FOLDS: dict[str, str] = {}


def _folded(word: str) -> str:
    got = _FOLDS.get(word)
    if got is None:
        if len(_FOLDS) > 200_000:
            _FOLDS.clear()
        got = _FOLDS[word] = fold(word)
    return got


_OWN: dict[tuple, tuple[set, set]] = {}


def _names(sender: str | None, name: str | None) -> tuple[set, set]:
    """The folded words of a sender's name and address, and the given names they may be short for."""
    got = _OWN.get((sender, name))
    if got is None:
        if len(_OWN) > 100_000:
            _OWN.clear()
        own = {_folded(w) for w in _words(name or "")}
        own |= {w for w in re.split(r"[^a-z]+", fold((sender or "").partition("@")[0])) if w}
        got = _OWN[sender, name] = own, set().union(*[_SHORT.get(w, ()) for w in own])
    return got


def _bin(v: float) -> int:
    return 0 if v <= 0 else min(7, 1 + int(v * 6.99))


def line_features(body: str, sender: str | None, name: str | None, parent: str | None, frequent: set, hashes, evidence: bool = True) -> tuple[list[int], np.ndarray]:
    """``(line numbers, features)`` of the lines that aren't blank, by the block they lie in; the last column is ``IN_PARENT``, without ``evidence`` 0.

    A block is a run of lines up to a blank line, a change of quote marks, an introduction of a quote or a header. Contact
    density, overlap with the parent and quote depth are the block's, the rest tells the marks of the line and above it.
    """
    lines = body.split("\n")
    if "\r" in body:
        lines = [x.rstrip("\r") for x in lines]
    n = len(lines)
    text = [x.strip() for x in lines]
    blank = [not x or x[0] > "\xff" and not _VISIBLE.search(x) for x in text]
    out = [bytearray(N) for _ in range(n)]
    mark = [None if b or not _quotes(x) else _MARK.match(x) for x, b in zip(lines, blank)] if _quotes(body) else [None] * n
    head = [":" in t and _HEAD.match(t) is not None for t in text]
    sep = [(t[:2] == "--" or t[-1:] == ":") and _SEP.match(t) is not None for t in text]
    # an introduction ends, four lines at most, in a word that stands for writing
    wrote = [w for w in _WROTE_PARTS if w in body]
    intro = {k - back for w in wrote for k, t in enumerate(text) if w in t for back in range(4)}
    # their words count in lines without a mark only
    plain = "\n".join([t for t, m in zip(text, mark) if m is None]).lower()
    footers, notices = [w for w in FOOTER if w in plain], [w for w in NOTICE if w in plain]
    sh, parent_lines = None, set()
    if parent:
        above = parent.split("\n")
        if _quotes(parent):
            above = [_MARK.sub("", x) if _quotes(x) else x for x in above]
        sh = set(_grams(_words("\n".join(above))))
        if evidence:
            parent_lines = {t for t in (x.strip() for x in above) if t.count(" ") >= 3}
        first = next((_words(x)[:6] for x, y in zip(above, parent.split("\n")) if _VISIBLE.search(y)), [])

    def overlap(words: list[str]) -> float:
        if not sh or len(words) < 5:
            return 0.0
        return sum(map(sh.__contains__, _grams(words))) / (len(words) - 4)

    own, full = _names(sender, name)
    # paragraphs: runs of lines that aren't blank, split where the quote depth begins or ends
    signed = quoted = footed = False
    since = 0
    i = 0
    intro_before = False
    keep = [k for k in range(n) if not blank[k]]
    last_text = keep[-1] if keep else -1
    unmarked_rest = None
    while i < n:
        if blank[i]:
            i += 1
            continue
        if mark[i]:
            j = i
            while j < n and not blank[j] and mark[j]:
                j += 1
            run = j - i
            prev = i > 0 and not blank[i - 1]
            own_line = False
            if run == 1 and prev and not intro_before and not quoted:
                # a line of the sender's own that merely begins with a quote sign
                own_line = overlap(_words(_MARK.sub("", lines[i]))) < 0.5
            for k in range(i, j):
                signs = mark[k].group(0)
                out[k][0], out[k][1] = min(7, max(1, signs.count(">") + signs.count("|") + signs.count("»"))), min(7, run)
                out[k][2], out[k][3] = own_line, intro_before
                out[k][18] = min(7, lines[k].count(" "))
            intro_before = False
            i = j
            continue
        t = text[i]
        # the lines that introduce a quote
        begun = sep[i] or (i + 1 < n and head[i + 1] and _RULE.match(t) is not None)
        heads = 0
        if begun or head[i]:
            k = i + 1 if begun else i
            while k < n and blank[k]:
                k += 1
            h0 = k
            while k < n and not blank[k] and not mark[k] and head[k]:
                heads += 1
                k += 1
            if heads >= 2 or (begun and heads >= 1) or (begun and not _RULE.match(t)):
                end = k if heads else i + 1
                for q in range(i, end):
                    if not blank[q]:
                        out[q][5] = 1
                i = end
                while end < n and blank[end]:
                    end += 1
                intro_before = True
                if end < n and not mark[end]:
                    quoted = True
                continue
        if i in intro and _INTRO_START.match(t):
            joined, found = t, None
            for extra in range(4):
                k = i + extra
                if k >= n or blank[k] or mark[k]:
                    break
                if extra:
                    joined += "\n" + text[k]
                m = _INTRO.match(joined)
                if m:
                    found = (k, m.group("rest").strip())
                    break
            if found:
                k, rest = found
                for q in range(i, k + 1):
                    out[q][4] = 1
                i = k + 1
                while k + 1 < n and blank[k + 1]:
                    k += 1
                intro_before = True
                if rest or (k + 1 < n and not mark[k + 1]):
                    quoted = True
                    out[i - 1][6] = 1
                continue
        intro_before = False
        # a paragraph of unmarked lines, up to a blank line, a mark or an introduction
        j = i
        while j < n and not blank[j] and not mark[j] and (j == i or not (sep[j] or (j in intro and _INTRO_START.match(text[j]) and _INTRO.match("\n".join(text[j : j + 3]))) or (head[j] and j + 1 < n and head[j + 1]))):
            j += 1
        lap = 0.0
        begins = False
        if sh and not quoted:
            words = _words("\n".join(lines[i:j]))
            lap = overlap(words)
            begins = len(first) >= 2 and words[: len(first)] == first
            if lap > 0.5 or begins:
                rest_words = [w for k in range(i, n) if not blank[k] and not mark[k] for w in _words(lines[k])]
                whole = overlap(rest_words)
                if whole >= 0.75 and (len(rest_words) >= 20 or begins) and len(rest_words) >= 5:
                    quoted = True
                    lap = max(lap, whole)
        if quoted:
            for k in range(i, j):
                out[k][6], out[k][17], out[k][24] = 1, _bin(lap), begins
            i = j
            continue
        near_end = last_text - i <= 8
        contact = sum(["@" in x or _PHONE.search(x) is not None for x in text[i:j]]) / (j - i) if signed or near_end else 0.0
        ps = PS.match(t) is not None
        # the block of a firm at the end of its mail
        firm = near_end and not ps and j > last_text and len(text[i].split()) <= 6 and all(len(x.split()) <= 8 for x in text[i:j]) and (
            text[i].lower().endswith(_LEGAL_END) or (j - i > 1 and bool(own & {_folded(w) for w in _words(text[i])[:2]}) and any(c.isdigit() or c == "@" for x in text[i + 1 : j] for c in x))
        )
        signed = signed or firm
        contact, lap = _bin(contact), _bin(lap)
        for k in range(i, j):
            x = text[k]
            nw = x.count(" ") + 1
            f = out[k]
            f[7] = x[0] in _RULE_MARKS and _RULE.match(x) is not None
            close = None if ps or nw > 9 or not _MAY_CLOSE[x[:3]] else _CLOSE.match(x)
            if close and close.group("rest") and not (1 <= len(close.group("rest").split()) <= 3 and close.group("rest").strip()[0].isupper() and close.group("rest").strip()[-1] not in ".?!:"):
                close = None
            f[8] = close is not None
            slash = x[0] == "/" and _SLASH.match(x) is not None
            f[10] = 1 if slash else 2 if f[7] else 0
            f[11] = contact
            f[12] = nw <= 12 and _MAY_DEVICE[x[:3]] and _DEVICE.match(x) is not None
            warn = (k == i or f[7]) and _MAY_WARN[x[:3]] and _WARNING.match(x) is not None
            f[14] = warn
            low = x.lower() if footers or notices or nw <= 6 else ""
            foot = bool(footers) and any(w in low for w in footers)
            f[15] = foot
            f[16] = 1 if frequent and hashes is not None and hashes[k] in frequent else 0
            if notices and (signed or f[16]) and any(w in low for w in notices):
                f[13] = 1 if signed else 2
            f[17] = lap
            f[18] = min(7, nw)
            f[19] = ps
            f[20] = k == i and nw <= 8 and _MAY_SALUTE[x[:3]] and _SALUTE.match(x) is not None
            if nw <= 6:
                tokens = [_folded(w) for w in _words(x)]
                f[21] = 0 < len(tokens) <= 4 and all(w in own or len(w) == 1 or w in _SHORT and not full.isdisjoint(_SHORT[w]) for w in tokens)
                f[25] = low.endswith(_LEGAL_END) or (1 < len(tokens) <= 5 and tokens[0] in own)
            f[22] = min(7, last_text - k)
            f[24] = begins
            if ps:
                continue
            if f[7] and (k == i or k == j - 1 or signed):
                signed = True
            if close or slash:
                signed = True
            if foot:
                footed = signed = True
            if warn and not signed:
                f[14] = 2
                continue
            if k > i and f[14] == 0 and j - i <= 3 and not signed and all(out[q][14] for q in range(i, k)):
                f[14] = 3  # the wrapped rest of a warning
                continue
            f[9] = min(7, since)
            if f[12]:
                continue
            f[23] = footed
            f[26] = signed
            since += signed
        i = j
    for k in keep if parent_lines else ():
        out[k][IN_PARENT] = _MARK.sub("", lines[k]).strip() in parent_lines
    return [k + 1 for k in keep], np.frombuffer(b"".join([out[k] for k in keep]), dtype=np.uint8).reshape(-1, N)


FEATURE_SCHEMA = "sender string, hashes array<bigint>, features binary"


def _frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for body, sender, name, parent, frequent, hashes in zip(*[b[c] for c in ("body", "sender", "name", "parent", "frequent", "hashes")]):
            if frequent is None:  # whether a line repeats can't be told
                continue
            no, x = line_features(body, sender, name, parent, set(frequent), hashes)
            rows.append((sender, [hashes[k - 1] for k in no], x.tobytes()))
        yield pd.DataFrame(rows, columns=["sender", "hashes", "features"])


#: A line that so many senders of the sample use isn't anybody's own; own text has so many words a line; a line that stands
#: below the last own line in such a share of its mails belongs to their ends.
SHARED_SENDERS, OWN_WORDS, AT_END = 2, 5, 0.9


def places(x: np.ndarray, hashes, used_by: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(own, repeats, zone)`` of a mail's lines, from where else they stand.

    ``own``: neither the parent, nor the sender's other mails, nor ``SHARED_SENDERS`` senders have the line, and it has ``OWN_WORDS``
    words. ``repeats``: the sender's mails or so many senders have it. ``zone``: 0 above the first own line, 1 among them, 2 below the
    last one; -1 in a mail without own lines.
    """
    frequent = x[:, _AT["frequency"]] > 0
    taken = x[:, IN_PARENT] > 0
    shared = np.array([used_by.get(h, 0) >= SHARED_SENDERS for h in hashes], dtype=bool)
    unmarked = (x[:, _AT["depth"]] == 0) | (x[:, _AT["marked_run"]] == 1)  # one line alone may just begin with a quote sign
    own = (x[:, _AT["words"]] >= OWN_WORDS) & ~taken & ~frequent & ~shared & unmarked & (x[:, _AT["overlap"]] < 3)
    at, place = np.flatnonzero(own), np.arange(len(x))
    zone = np.full(len(x), -1) if not len(at) else np.where(place < at[0], 0, np.where(place <= at[-1], 1, 2))
    return own, (frequent | shared) & ~taken & (x[:, _AT["depth"]] == 0), zone


def labelled(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """``(features, label)`` of the lines with evidence, of ``(sender, hashes, features)`` rows.

    The labels come from where else a line stands, not from marks or word lists: a line of the parent, word for word, is taken over;
    an own line is new; a line that repeats is not new if it stands below the last own line in ``AT_END`` of its mails, and new if it
    stands among own lines. Above the first own line there are salutations and warnings, which occur alike; there alone the words of
    a warning decide. All other lines have no evidence and are left out.

    Each line comes twice, the second time without the two features that the evidence is close to (frequency and
    overlap), so that the trees also learn what else tells such lines.
    """
    senders: dict[int, set] = {}
    for sender, hashes, _ in rows:
        for h in hashes:
            senders.setdefault(h, set()).add(sender)
    used_by = {h: len(v) for h, v in senders.items()}
    seen: dict[int, list] = {}
    parts = []
    for _, hashes, f in rows:
        x = np.frombuffer(f, dtype=np.uint8).reshape(-1, N)
        own, repeats, zone = places(x, hashes, used_by)
        parts.append((x, hashes, own, repeats, zone))
        for k in np.flatnonzero(repeats & (zone >= 0)):
            at = seen.setdefault(hashes[k], [0, 0])
            at[0] += 1
            at[1] += zone[k] == 2
    xs, ys = [np.zeros((0, N), np.uint8)], [np.zeros(0, int)]
    for x, hashes, own, repeats, zone in parts:
        ends = np.array([(c := seen.get(h, (0, 0)))[0] > 1 and c[1] >= AT_END * c[0] for h in hashes], dtype=bool)
        y = np.full(len(x), 2)
        y[repeats & (zone == 2) & ends] = 1
        y[repeats & (zone == 1)] = 0
        y[repeats & (zone == 0)] = (x[:, _AT["warning"]] > 0)[repeats & (zone == 0)]
        y[x[:, IN_PARENT] > 0] = 1
        y[own] = 0
        xs.append(x[y < 2])
        ys.append(y[y < 2])
    x, y = np.concatenate(xs)[:, :IN_PARENT], np.concatenate(ys)
    hidden = x.copy()
    hidden[:, [_AT["frequency"], _AT["overlap"]]] = 0
    return np.concatenate([x, hidden]), np.concatenate([y, y])


def _trimmed(line):
    return F.trim(F.regexp_replace(line, "\r", ""))


def _mails(emails: DataFrame) -> DataFrame:
    """One row per id, the first delivered, with what finds the parent and the sender; no text."""
    reply, refs = conversations.names_in(F.col("in_reply_to")), conversations.names_in(F.col("references_json"))
    narrow = emails.where(F.col("id").isNotNull()).select(
        "id", "pos", F.xxhash64(F.lower("sender_email")).alias("sender"), conversations.real_value(F.col("thread_id")).alias("thread"),
        F.coalesce(F.get(reply, F.lit(0)), F.get(refs, F.size(refs) - 1)).alias("name"), F.get(conversations.names_in(F.col("provider_message_id")), F.lit(0)).alias("message_id"),
    )
    return narrow.groupBy("id").agg(F.min_by(F.struct(*[c for c in narrow.columns if c != "id"]), "pos").alias("m")).select("id", "m.*")


def parents(mails: DataFrame) -> DataFrame:
    """``id, parent``: the mail that the header names (in_reply_to, without it the last reference), else the one before in the thread."""
    names = mails.select(F.col("id").alias("name"), F.col("id").alias("target")).unionByName(mails.where("message_id is not null").select(F.col("message_id").alias("name"), F.col("id").alias("target")))
    by_name = mails.where("name is not null").select("id", "name").join(names, "name").where("id != target").groupBy("id").agg(F.min("target").alias("named"))
    numbered = stage(running(mails.where("thread is not null").select("id", "thread", "pos"), "thread", [F.col("pos")], name="n").select("id", F.xxhash64("thread").alias("thread"), "n"), "thread-order")
    by_thread = numbered.join(numbered.select("thread", (F.col("n") + 1).alias("n"), F.col("id").alias("earlier")), ["thread", "n"]).select("id", "earlier")
    return by_name.join(by_thread, "id", "full").select("id", F.coalesce("named", "earlier").alias("parent"))


def context(emails: DataFrame, mails: DataFrame, links: DataFrame, frequent: DataFrame, bounded: bool = False) -> DataFrame:
    """``id, body, sender, name, parent, frequent, hashes, above_sender, above_name`` of the mails in ``mails``.

    The parent's text is its whole body, quoted lines included: what it quotes is the text of the older mails of the
    conversation. The texts move twice: once keyed by id, both as what is judged and as parents (the same columns, so that
    it is one exchange), once from the parents to the mails that answer them. Whatever else is known of a mail is joined to
    its id first, so that no text moves by sender.
    ``bounded``: ``mails`` and ``links`` are a sample of bounded size, which is broadcast instead.
    """
    small = F.broadcast if bounded else (lambda df: df)
    text = emails.where(F.col("id").isNotNull() & F.col("body_text").rlike(conversations.VISIBLE)).select("id", "pos", F.col("body_text").alias("body"), F.lower("sender_email").alias("sender"), F.col("sender_name").alias("name"))
    known = mails.select("id", "pos", F.col("sender").alias("s")).join(frequent.withColumnRenamed("sender", "s"), "s", "left").select("id", "pos", "frequent")
    above = text.select(F.col("id").alias("parent"), F.col("pos").alias("ppos"), F.col("body").alias("above"), F.col("sender").alias("above_sender"), F.col("name").alias("above_name"))
    above = above.join(small(links), ["parent", "ppos"]).select("id", "pos", "above", "above_sender", "above_name")
    hashes = F.transform(F.split("body", "\n"), lambda x: F.xxhash64(_trimmed(x)))
    return text.join(small(known), ["id", "pos"]).join(small(above), ["id", "pos"], "left").select("id", "body", "sender", "name", F.col("above").alias("parent"), "frequent", hashes.alias("hashes"), "above_sender", "above_name")


def frequent_lines(emails: DataFrame, mails: DataFrame, share: float = 0.05) -> DataFrame:
    """``sender, frequent``: hashes of the lines, of any length, that stand in at least ``share`` of a sender's mails, and in two at least.

    A share bounds their number by the mean number of lines over the share, however many mails the sender has.
    """
    written = F.filter(F.transform(F.split("body_text", "\n"), _trimmed), lambda x: F.length(x) >= 2)
    lines = emails.where("id is not null").select(F.xxhash64(F.lower("sender_email")).alias("sender"), F.explode(F.array_distinct(F.transform(written, lambda x: F.xxhash64(x)))).alias("h"))
    per = lines.groupBy("sender", "h").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    total = mails.groupBy("sender").agg(F.count(F.lit(1)).alias("m"))
    return per.join(total, "sender").where(F.col("c") >= F.col("m") * share).groupBy("sender").agg(F.collect_list("h").alias("frequent"))


def train(rows: DataFrame, trees: int = 40, depth: int = 5) -> dict:
    """Trees fitted on the lines with evidence in a bounded sample of mails."""
    got = rows.mapInPandas(_frame, FEATURE_SCHEMA).toPandas()
    x, y = labelled(list(zip(got.sender, got.hashes, got.features)))
    return boosting.fit(x, y, trees, depth)


def not_new_lines(emails: DataFrame, train_mails: int = 3000) -> DataFrame:
    """``id, line_no, score``: every line that isn't blank with the probability that its sender did not newly write it.

    Bodies are cut into blocks at blank lines and where quote marks, introductions of quotes or warnings begin and
    end. Trees judge the lines by the quote depth and
    the contact density of their block, how often the sender uses the line, how much of the block stands in the
    parent (shares of five-word shingles) and the marks around it. They are boosted on the lines of about ``train_mails`` mails, labelled by
    ``labelled``: where else in the conversation and the sample a line stands.

    Mails count once per id; null and blank bodies, and mails without id, give no rows. Lines are split at line
    feeds and counted from 1; a line of white space or invisible characters only is blank. An empty table gives no rows.
    """
    mails = stage(_mails(emails), "mails")
    links = parents(mails).join(mails.select(F.col("id").alias("parent"), F.col("pos").alias("ppos")), "parent")
    links = cut(links.join(mails.select("id", "pos"), "id"))
    frequent = cut(frequent_lines(emails, mails))
    # about train_mails mails, chosen where they are by a hash of their id
    share = int(min(1.0, train_mails / max(1, mails.count())) * (1 << 30))
    chosen = cut(mails.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < share))
    their_links = cut(links.join(F.broadcast(chosen.select("id")), "id"))
    their_lines = cut(frequent.join(F.broadcast(chosen.select("sender").distinct()), "sender"))
    model = train(context(emails, chosen, their_links, their_lines, bounded=True))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                ids, nos, xs = [], [], []
                for i, body, sender, name, parent, frequent, hashes in zip(*[part[c] for c in ("id", "body", "sender", "name", "parent", "frequent", "hashes")]):
                    no, x = line_features(body, sender, name, parent, set() if frequent is None else set(frequent.tolist()), hashes.tolist(), evidence=False)
                    ids += [i] * len(no)
                    nos += no
                    xs.append(x)
                x = np.concatenate(xs) if xs else np.zeros((0, N), np.uint8)
                yield pd.DataFrame({"id": ids, "line_no": np.array(nos, dtype=np.int64), "score": boosting.predict(model, x[:, :IN_PARENT])})

    return context(emails, mails, links, frequent).mapInPandas(judge, "id string, line_no bigint, score double")


def found_lines(emails: DataFrame) -> DataFrame:
    """``id, line_no`` of each line that wasn't newly written by the mail's sender."""
    return not_new_lines(emails).where("score >= 0.5").select("id", "line_no")


def new_texts(emails: DataFrame) -> DataFrame:
    """``id, new_text``: the newly written lines of each mail, joined by line feeds, outer blank lines left out."""
    lines = not_new_lines(emails).where("score >= 0.5").groupBy("id").agg(F.collect_set("line_no").alias("drop"))
    first = emails.where(F.col("id").isNotNull()).groupBy("id").agg(F.min_by("body_text", "pos").alias("body"))
    parts = F.split("body", "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains(F.coalesce("drop", F.array().cast("array<bigint>")), (i + 1).cast("bigint")))
    text = F.regexp_replace(F.array_join(kept, "\n"), r"^\s*\n|\s+$", "")
    return first.join(lines, "id", "left").select("id", F.regexp_replace(text, r"\n(\s*\n){2,}", "\n\n").alias("new_text"))
