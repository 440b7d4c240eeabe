"""Personal information in free text: mentions of e-mail addresses, phones, identity numbers, addresses and names.

Generators with high recall propose spans, which may overlap; boosted trees judge each span by its format and
context; thresholds calibrated by kind select the mentions, and overlaps are resolved by probability. The
generators anchor on cheap signs (an @, a run of digits, a capital), so that plain text costs little. Words of names
come from the input's own mail headers and from a short list of common given names; names without any listed word are
proposed by form (capitalised words in a row, initials, particles, "Family, Given", a word alone on its line) and
judged by context. No name of the training data is kept. The evidence of neighbouring words is learned; see train_pii.py.

Results: null, blank and junk texts have no mentions; a repeated row counts once; positions count Unicode
characters from 0 and exclude labels, titles, quotes and brackets; names inside e-mail addresses don't count.
Texts are read whole. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm import gbt
from papyra.session import spread

KINDS = ("email", "phone", "id_number", "address", "name")

# ---------------------------------------------------------------- generators

#: Endings of mail domains that a spelled-out address may have.
_TLD = "com|org|net|edu|gov|info|biz|io|eu|de|at|ch|fr|be|es|it|pt|nl|pl|ru|jp|uk|us|ca|example|test|invalid|localhost"
_EMAIL = re.compile(r"[^\W_](?:[\w.+%'-]*\w)?(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?)(?:[\w-]+(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?))+[A-Za-z]{2,}", re.I)
_SPELLED = re.compile(rf"[\w+%-]+(?:(?:\.|\s+dot\s+)[\w+%-]+)*\s+(?:at|@)\s+[\w-]+(?:(?:\.|\s+dot\s+)[\w-]+)*(?:\.|\s+dot\s+)(?:{_TLD})\b(?!\s?@)", re.I)
_AT = re.compile(r"@|[\[({]\s?at\s?[\])}]", re.I)
#: What only looks like an address: a handle, a version, a name at a bare host; the trees judge it.
_LIKE = re.compile(r"(?:[^\W_](?:[\w.+%'-]*\w)?)?@[^\W_](?:[\w.-]*\w)?")
_AT_WORD = re.compile(r"\sat\s+[\w-]+(?:\.|\s+dot\s+)\w", re.I)

_G = r"(?:[ \xa0]?[().\-/‑–]{0,2}[ \xa0]?|\)?\r?\n(?:> ?)*(?!\d{1,4}[a-z]?,?\s[A-Za-zÀ-ÿ])\(?)"
_NUMBER = re.compile(rf"(?<![\w@.+])(?!\d{{4}}-\d\d-\d\d(?!\d))[+(]{{0,2}}\d(?:{_G}\d){{6,17}}(?!\d)(?:[ -]?[A-Z]\b)?")

#: What identity papers, social security, tax and licence numbers are called.
_ID_LABEL = re.compile(
    r"""(?<!\w)(?:SSN|NINO|NI\s+(?:number|no)|NIR|NIE|N\.\s?I\.\s?E\.|DNI|D\.\s?N\.\s?I\.|NIF|N\.\s?I\.\s?F\.|INSEE|BSN|PESEL|CPF|DL|IdNr|ID\s+card|Tax\s+ID|TIN|ITIN
    |soc(?:ial|\.)?\s+sec(?:urity|\.)?|national\s+insurance|passport|driver'?s\s+licen[cs]e|driving\s+licen[cs]e|identity\s+card|permanent\s+resident\s+card
    |Steuer-?\s?(?:ID|Identifikationsnummer|nummer|Nr)|Steueridentifikationsnummer|Identifikationsnummer|Personalausweis(?:nummer)?|Ausweis(?:nummer)?|Reisepass(?:nummer)?|F[üu]hrerschein(?:nummer)?|Sozialversicherungs(?:nummer|nr)|Rentenversicherungsnummer
    |s[ée]curit[ée]\s+sociale|num[ée]ro\s+fiscal|passeport|carte\s+(?:nationale\s+)?d['’]identit[ée]|permis\s+de\s+conduire
    |documento\s+nacional\s+de\s+identidad|identidad|pasaporte|permiso\s+de\s+conducir|carn[ée]\s+de\s+conducir|seguridad\s+social
    |codice\s+fiscale|carta\s+d['’]identit[àa]|passaporto|patente)(?!\w)""",
    re.I | re.X,
)
_ID_VALUE = re.compile(r"(?:[\s>:#.°№\-]|n\.?º|n°|no\b|nr\b|num(?:ber|mer|éro|ero)?\b|número\b|ID\b|is\b|lautet\b|est\b|es\b|der\b|:)*((?=[A-Z0-9 .\-/\xa0\n]*\d)[A-Z0-9](?:[ \xa0.\-/]?[A-Z0-9]|\n(?:> ?)*[A-Z0-9](?=[A-Z0-9 ]*\d)){4,22})", re.I)
_ID_FORM = re.compile(r"(?<![\w.-])(?:\d{3}[- ]\d{2}[- ]\d{4}|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-CEGHJ-PR-TW-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[12] ?\d\d ?(?:0[1-9]|1[0-2]) ?\d\d ?\d{3} ?\d{3} ?\d\d|[A-Z]\d{3}-\d{4}-\d{4})(?![\w-])")

_EN_TYPES = "close|avenue|ave|road|rd|street|st|lane|ln|hill|terrace|drive|dr|court|ct|way|square|sq|place|row|crescent|gardens|boulevard|blvd|grove|mews|parade|walk"
_ADDRESS = [
    re.compile(rf"(?<![\w.,/-])\d{{1,4}}[a-z]?,?\s(?:[A-Z][\w'’-]+\s){{1,3}}(?:{_EN_TYPES})\b", re.I),
    re.compile(r"(?<!\w)(?:[A-ZÄÖÜ][\wäöüß-]*?(?:str\.|stra(?:ß|ss)e|weg|platz|ring|allee|gasse|ufer|damm|steig|chaussee|promenade)|(?:Am|An der|Auf der|Im|In der|Zum|Zur)\s[A-ZÄÖÜ][\wäöüß-]+|[A-ZÄÖÜ][\wäöüß-]+er\s(?:Stra(?:ß|ss)e|Str\.|Weg|Platz|Ring|Allee|Gasse))\s{1,2}\d{1,4}\s?[a-z]?(?!\w)", re.I),
    re.compile(r"(?<![\w.-])\d{1,4}(?:\s(?:bis|ter|quater))?,?\s(?:rue|avenue|av\.|all[ée]e|impasse|quai|place|pl\.|boulevard|bd\.?|chemin|cours|passage|square|route|ruelle|voie|sentier)\s(?:de\sla\s|du\s|des\s|de\sl['’]|de\s|d['’]|la\s|le\s|les\s)?[\wÀ-ÿ'’-]+", re.I),
    re.compile(r"(?<!\w)(?:calle|c/|c\.|avda\.?|avenida|av\.|paseo|p\.º|plaza|pza\.?|pl\.|camino|ronda|traves[íi]a|carrera|glorieta|v[íi]a)\s?(?:de\sla\s|del\s|de\slos\s|de\slas\s|los\s|las\s|la\s|el\s|de\s)?[\wÀ-ÿ'’-]+(?:\s[A-Z][\wÀ-ÿ-]+)?,?\s(?:n\.?º\s?)?\d{1,4}(?!\w)", re.I),
]
#: A town with its code right before a street.
_TOWN_BEFORE = re.compile(r"(?:[A-Z]{1,2}-)?\d{4,5}\s[^\W\d_][\w-]+(?:\s(?:am|an der|im|ob der|bei|sur|del|de la|de)\s[^\W\d_][\w-]+|\s[^\W\d_][\w-]+)?[,;]?\s?$")
_TOWN_BEFORE_EN = re.compile(r"[A-Z][a-z]+,?\s[A-Z]{1,2}\s?\d{1,5}(?:\s\d[A-Z]{2})?,\s$")

#: Titles, greetings and the like before a name.
_TITLE = re.compile(r"(?:\b(?:Mrs?|Ms|Miss|Mx|Dr|Prof|Sir|Herrn?|Frau|Fr|Mme|Mlle|Madame|Monsieur|M|Sra?|Srta|Se[ñn]ora?|Don|Doña|Sig|Dott)\.?)\s$", re.I)
_CUE = re.compile(r"(?:\b(?:Dear|Hello|Hi|Hallo|Liebe[r]?|Sehr geehrte[r]? (?:Herr|Frau)|Guten Tag|Good (?:morning|afternoon)|Bonjour|Cher|Ch[èe]re|Salut|Hola|Estimad[oa]|Querid[oa]|Mrs?|Ms|Dr|Prof|Herrn?|Frau|Mme|Mlle|Madame|Monsieur|Sra?|Srta|Se[ñn]ora?)\b\.?,?)\s+(?=([A-ZÀ-Þ][\w'’-]+(?:[ ](?:[A-Z]\.[ ])?(?:(?:von|van|de|di|da|del|der)[ ])?[A-ZÀ-Þ][\w'’-]+){0,2}))")
_GREETED = re.compile(r"(?:^|[\n>])[ ]?(?:Dear|Hello|Hi|Hallo|Liebe[r]?|Guten Tag|Good (?:morning|afternoon)|Bonjour|Cher|Ch[èe]re|Salut|Hola|Estimad[oa]|Querid[oa])\b,?\s+$")
_PARTICLE = {"von", "van", "de", "di", "da", "del", "der", "den", "du", "la", "le", "zu", "y", "ten", "ter", "dos", "das", "della"}

_WORD = re.compile(r"[^\W\d_]+")
_LINK = r"(?:[A-Z]\.[ ])?(?:(?:von|van|de la|de|di|da|del|der|zu|du|ten)[ ])?"
#: A capitalised word, with parts joined by hyphens or apostrophes, or an initial.
_CAPITAL = re.compile(r"[A-ZÀ-Þ](?:\.(?!\w)|[^\W\d_]*(?:[-'’][^\W\d_]+)*)")
#: What may stand between the words of a name: a space, and a particle.
_BETWEEN = re.compile(r"[ \xa0](?:(?:von|van|de la|de|di|da|del|der|zu|du|ten)[ ])?")
_PARTS = re.compile(r"(?:[-'’][A-ZÀ-Þ][^\W\d_]+)+")
#: Words of greetings and titles, which are no part of a name.
_NO_NAME = frozenset("dear hello hi hallo lieber liebe guten tag herr herrn frau bonjour cher chère salut hola estimado estimada querido querida mr mrs ms miss mx dr prof sir mme mlle madame monsieur señor señora sr sra srta don doña sig signor signora gentile caro cara geachte beste szanowny szanowna pan pani".split())
_DIGITS = re.compile(r"\d")


#: Words near which an identity number or a street may stand.
_ID_ANCHORS = """ssn nino ni nir nie n.i.e dni d.n.i n.\xa0i.\xa0e nif n.i.f insee bsn pesel cpf dl idnr tin itin tax sec security insurance passport licence license
identity resident steuer steuernummer steueridentifikationsnummer identifikationsnummer personalausweis personalausweisnummer ausweis ausweisnummer reisepass reisepassnummer führerschein
fuhrerschein führerscheinnummer sozialversicherungsnummer rentenversicherungsnummer sociale social fiscal passeport identité identite conduire identidad pasaporte conducir fiscale identità
passaporto patente card""".split()
_STREET_ENDS = "str. straße strasse weg platz ring allee gasse ufer damm steig chaussee promenade".split()
_STREET_HEADS = "rue avenue av. allée allee impasse quai place pl. boulevard bd chemin cours passage square route ruelle voie sentier calle c/ avda avda. avenida paseo plaza pza pza. camino ronda travesía carrera glorieta vía am im zum zur".split()


#: Common given names of the languages here, so that they count as such in any input.
GIVEN = """aaron adam agnieszka ahmed alan albert alejandro alexander alice amelia amina amy ana andrea andreas andrew andrzej angela anita anna anne antonio barbara beatriz ben bernard birgit brian carla carlos carmen caroline catherine
charles charlotte chiara christian christine christopher claire clara claudia daniel david deborah dennis diana diego dieter dmitri dorothy edward elena elias elisabeth elizabeth emily emma eric erik eva fatima felix fernando
francesca francesco frank frederic gabriel george giovanni giulia grace hans heinz helen helena henri henry ines ingrid irina isabel ivan jacob james jan jane javier jean jennifer jens jessica joan johannes john jonas jose
joseph juan julia julie jürgen karen karl katarzyna katharina kevin klaus krzysztof lars laura leon liam linda lisa louis lucas lucia lukas manuel marco margaret maria marie mark markus marta martin mary matteo matthew maurice
max michael michel miguel mohammed monika natalia nicolas nina oliver olga pablo patricia patrick paul peter petra philippe pierre piotr priya rachel richard robert roberto""".split()


class Lexicon:
    """Words of names from mail headers, common given names, and anchors of other generators, found by one pass of a keyword automaton."""

    def __init__(self, words: dict[str, str]):
        import ahocorasick

        kinds: dict[str, set[str]] = {}
        for k, group in (("i", _ID_ANCHORS), ("d", _STREET_ENDS), ("s", _STREET_HEADS), ("e", _EN_TYPES.split("|"))):
            for w in group:
                kinds.setdefault(w, set()).add(k)
        #: Common names that no header has count where they are written with a capital: some are words of a language.
        self.common = frozenset(GIVEN) - set(words)
        for w, k in {**dict.fromkeys(GIVEN, "g"), **words}.items():
            kinds.setdefault(w, set()).add(k)
        self.auto = ahocorasick.Automaton()
        for w, ks in kinds.items():
            self.auto.add_word(w, (len(w), "".join(sorted(ks))))
        self.auto.make_automaton()

    def find(self, low: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Name words (start, end, g or f), the longest of those that end together; and anchors (start, end, kinds)."""
        names, anchors, n = [], [], len(low)
        for last, (size, kinds) in self.auto.iter(low):
            b = last + 1
            if b < n and low[b].isalnum() and low[last] != "." and low[last] != "/":
                continue
            a = b - size
            if a and low[a - 1].isalnum():
                if "d" in kinds:
                    anchors.append((a, b, "d"))
                continue
            if kinds == "g" or kinds == "f":
                if names and names[-1][1] == b and names[-1][0] <= a:
                    continue
                while names and names[-1][0] >= a:
                    names.pop()
                names.append((a, b, kinds))
            else:
                anchors.append((a, b, kinds))
                if k := kinds.strip("deis"):
                    names.append((a, b, k))
        return names, anchors


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


def header_words(sender: str | None, name: str | None, to: list[str | None] | None) -> list[tuple[str, str]]:
    """(word, g or f) of the sender's name and of display names that agree with the address beside them."""
    out: list[tuple[str, str]] = []

    def add(first: str, rest: list[str]) -> None:
        out.extend((w.lower(), "g") for w in first.split("-"))
        out.extend((w.lower(), "f") for r in rest for w in re.split(r"[-'’]", r) if len(w) > 2 and w.lower() not in _PARTICLE)

    if name and len(name.split()) > 1:
        first, *rest = name.split()
        add(first, rest)
    for entry in [sender, *(to or [])]:
        m = re.match(r'\s*"?([^"<(]+?)"?\s*<([^@<>]+)@', entry or "")
        if not m:
            continue
        shown, local = m.group(1), fold(m.group(2))
        if "," in shown:
            back, _, front = shown.partition(",")
            shown = f"{front.strip()} {back.strip()}"
        words = shown.split()
        if len(words) > 1 and fold(words[0]) in local and fold(words[-1]).replace("-", "") in local.replace("-", "") and "," in entry.partition("<")[0]:
            add(words[0], words[1:])
    return out


def name_words(mails: DataFrame) -> dict[str, str]:
    """Word -> g or f, of all mail headers; counts are summed in batches first, and only the words reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter(wk for row in zip(*[c.to_pylist() for c in batch.columns]) for wk in header_words(*row))
            ws = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in ws], pa.string()), pa.array([n[x] * (1 if x[1] == "g" else -1) for x in ws], pa.int64())], ["w", "n"])

    sums = mails.select("from_email", "from_name", "to_emails").mapInArrow(run, "w string, n bigint").filter("length(w) > 2").groupBy("w").agg(F.sum("n").alias("n"))
    out = {r.w: "g" if r.n >= 0 else "f" for r in sums.collect()}
    return {**{fold(w): k for w, k in out.items()}, **out}


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Spans:
    """Stretches that don't overlap, in order of their places; looked up by halving."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            self.add(a, b)

    def add(self, a: int, b: int) -> None:
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)

    def meets(self, a: int, b: int) -> bool:
        """Whether a stretch overlaps one of them."""
        k = bisect.bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def holds(self, place: int) -> bool:
        return self.meets(place, place + 1)


def emails(text: str) -> list[tuple[int, int]]:
    out, at = [], -1
    for m in _AT.finditer(text):
        if m.start() < at:
            continue
        lo = m.start()
        while lo > 0 and (text[lo - 1].isalnum() or text[lo - 1] in "._+%'-" or (m.start() - lo < 2 and text[lo - 1].isspace())):
            lo -= 1
        while lo < m.start() and not text[lo].isalnum():
            lo += 1
        got = _EMAIL.match(text, lo)
        if not got or not got.start() <= m.start() < got.end():  # from the word right before the @
            word = re.search(r"[^\W\d_]+\W{0,2}$", text[max(lo, m.start() - 100) : m.start()])
            got = _EMAIL.match(text, max(lo, m.start() - 100) + word.start()) if word else None
            got = got if got and got.start() <= m.start() < got.end() else None
        if got:
            out.append(got.span())
            at = got.end()
    if _AT_WORD.search(text):
        own = Spans(out)
        for m in _SPELLED.finditer(text):
            if not own.meets(*m.span()):
                out.append(m.span())
    return out


def address_like(text: str, mail: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Strings around an @ that have no form of an address."""
    own, out, at = Spans(mail), [], text.find("@")
    while at >= 0:
        lo = at
        while lo and (text[lo - 1].isalnum() or text[lo - 1] in "_.+%'-"):
            lo -= 1
        while lo < at and not text[lo].isalnum():
            lo += 1
        m = _LIKE.match(text, lo) or _LIKE.match(text, at)
        if m and m.end() > at and not own.meets(*m.span()) and not (out and out[-1][1] > m.start()):
            out.append(m.span())
        at = text.find("@", at + 1)
    return out


def numbers(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        head = text[a:b]
        if head[0] == "(" and ")" not in head[:7]:
            a += 1
        out.append((a, b))
    return out


def identity(text: str, anchors: list[tuple[int, int, str]], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: dict[int, int] = {}
    at = -1
    labelled = Spans()
    for a, b, kinds in anchors:
        if "i" in kinds and b > at:
            for m in _ID_LABEL.finditer(text, max(0, a - 24), min(len(text), b + 24)):
                at = max(at, m.end())
                v = _ID_VALUE.match(text, m.end(), m.end() + 60)
                if v and v.start(1) - m.end() <= 24:
                    out[v.start(1)] = v.end(1)
                    labelled.add(*v.span(1))
    for a, b in found:  # numbers of a known form without a label
        lo = a - 1 if a and text[a - 1] in "-" else a
        while lo > 0 and a - lo < 3 and text[lo - 1].isalpha():
            lo -= 1
        m = _ID_FORM.match(text, lo)
        if m and not labelled.meets(*m.span()):
            out[m.start()] = m.end()
            labelled.add(*m.span())
    return list(out.items())


def addresses(text: str, anchors: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    own = Spans()
    for a, b, kinds in anchors:
        near, after = text[max(0, a - 44) : a], text[b : b + 50]
        tries = []
        if "e" in kinds and _DIGITS.search(near):
            tries.append((_ADDRESS[0], max(0, a - 44), b + 1))
        if ("d" in kinds or "s" in kinds) and _DIGITS.search(after):
            tries.append((_ADDRESS[1], max(0, a - 30), b + 40))
        if "s" in kinds and _DIGITS.search(near):
            tries.append((_ADDRESS[2], max(0, a - 14), b + 40))
        if "s" in kinds and _DIGITS.search(after):
            tries.append((_ADDRESS[3], a, b + 50))
        for p, lo, hi in tries:
            for m in p.finditer(text, lo, min(len(text), hi)):
                x, y = m.span()
                if not x <= a < y or own.meets(x, y):
                    continue
                before = text[max(0, x - 48) : x]
                town = _TOWN_BEFORE.search(before) or _TOWN_BEFORE_EN.search(before)
                out.append((x - len(town.group()) if town else x, y))
                if not own.meets(*out[-1]):
                    own.add(*out[-1])
                else:
                    own.add(x, y)
    return out


_FRENCH = re.compile(r"\b(?:le|la|les|des|du|une|est|et|à|au|pour|qui|sa|a|avec|dans)\b")
_ENGLISH = re.compile(r"\b(?:the|of|and|to|in|for|with|is)\b")


def _french(near: str) -> bool:
    """Whether running text around is French, where M. is a title and no initial."""
    return len(_FRENCH.findall(near)) >= 3 and not _ENGLISH.search(near)


def names(text: str, tokens: list[tuple[int, int, str]], taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, shape): runs of name words, with initials and particles; shape is the kinds in order, u for words of cues only."""
    busy = Spans(taken)
    tokens = [t for t in tokens if not busy.holds(t[0])] if taken else tokens
    runs: list[list] = []
    for a, b, k in tokens:
        if runs:
            end, shape = runs[-1][1], runs[-1][2]
            gap = text[end:a]
            if len(gap) <= 12:
                inner = gap.strip(" \n>\r-,.'’")
                words = inner.lower().split()
                join = gap in ("-", "'", "’") or gap == " " or gap == ", " and shape[-1] == "f" and k == "g" or all(len(w.strip(".")) == 1 and w[0].isalpha() or w in _PARTICLE for w in words) and ("\n" not in gap or shape[-1] == "g" and k == "f" or "," in gap) and ("," not in gap or shape[-1] == "f" and k == "g") and not re.search(r"[.;:|\t]\s*$", gap.rstrip(" \n>") if not words else "")
                if "g" in shape and "f" in shape and gap not in ("-", "'", "’"):
                    join = False  # the name is whole
                if join and gap.strip(" ") == "" and "\n" not in gap and len(gap) > 1:
                    join = False
                if join:
                    runs[-1][1] = b
                    runs[-1][2] = shape + k
                    continue
        runs.append([a, b, k])
    spans = {}
    for a, b, shape in runs:
        if a > 1 and text[a - 1] == "-" and text[a - 2].isalpha():
            continue  # a part of a double name whose other part isn't listed
        # to the left: O', an initial, a particle; to the right an initial after a lone given name
        while True:
            before = text[max(0, a - 8) : a]
            m = re.search(r"(?:(?<!\w)[OD]['’]|(?<![\w.])(?:[A-Z]\.\s?){1,2}|(?<!\w)(?:von|van|di|da|del|der|zu|de la|de|du|ten)\s)$", before) if shape[0] == "f" or before.endswith(("'", "’")) else None
            if not m or m.group().strip() == "d'" or m.group().strip() == "M." and _french(text[max(0, a - 60) : b + 40]):
                break
            a -= len(m.group())
        m = re.match(r"\s[A-Z]\.(?!\w)", text[b : b + 4]) if shape[-1] == "g" else None
        b += len(m.group()) if m else 0
        m = _PARTS.match(text, b)  # the rest of a double name
        spans[a] = (a, m.end(), shape + "u") if m else (a, b, shape)
    reach: list[int] = []  # of the spans in order, how far any up to it reaches
    order = sorted(spans.values())
    for x, y, _ in order:
        reach.append(max(y, reach[-1] if reach else 0))
    begins = [x for x, _, _ in order]
    for m in _CUE.finditer(text):
        a, b = m.span(1)
        k = bisect.bisect_left(begins, b)
        if a not in spans and not (k and reach[k - 1] > a) and not busy.holds(a):
            spans[a] = (a, b, "u")
    return sorted(spans.values())


def capitalised(text: str, tokens: list[tuple[int, int, str]], taken: list[tuple[int, int]], known: set[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Names by form alone: two and three capitalised words or initials in a row, "Family, Given", words alone on a line.

    The shape has u for a word that isn't in the lexicon, i for an initial.
    """
    kinds = {(a, b): k for a, b, k in tokens}
    runs: list[list[tuple[int, int]]] = []
    spans: set[tuple[int, int]] = set()
    last, n = -1, len(text)
    for m in _CAPITAL.finditer(text):
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "@_./'’-") or b < n and (text[b].isalnum() or text[b] in "@_"):
            last = -1
            continue
        if b - a == 1 or text[a:b].lower() in _NO_NAME:
            last = -1
            continue
        if text[a:b] == "M." and _french(text[max(0, a - 60) : b + 40]):
            last = -1  # a title
            continue
        gap = text[last:a] if last >= 0 and a - last <= 7 else None
        if gap is not None and _BETWEEN.fullmatch(gap):
            runs[-1].append((a, b))
        else:
            if gap == ", " and text[b - 1] != "." and text[last - 1] != ".":
                spans.add((runs[-1][-1][0], b))
            runs.append([(a, b)])
        last = b
    for run in runs:
        if len(run) == 1:
            (a, b), = run
            if text[b - 1] != "." and (b == n or text[b] in "\r\n" or text[b : b + 2] in (" \n", " ")) and not text[text.rfind("\n", 0, a) + 1 : a].strip("> "):
                spans.add((a, b))
        for k in (2, 3):
            spans |= {(run[i][0], run[i + k - 1][1]) for i in range(len(run) - k + 1) if text[run[i + k - 1][1] - 1] != "."}
    out, busy = [], Spans(taken)
    for a, b in sorted(spans - known):
        if taken and busy.meets(a, b):
            continue
        words = [m.span() for m in _CAPITAL.finditer(text, a, b) if m.end() - m.start() > 1]
        if len(words) > 1 and all(y - x <= 4 and text[x:y].isupper() for x, y in words):
            continue  # a row of abbreviations
        out.append((a, b, "".join("i" if text[y - 1] == "." else _kind(kinds, text, x, y) for x, y in words)))
    return out


def _kind(kinds: dict[tuple[int, int], str], text: str, a: int, b: int) -> str:
    """The kind of a word in the lexicon; of a joined one, that of its parts."""
    if (a, b) in kinds:
        return kinds[a, b]
    parts = [kinds.get(m.span()) for m in _WORD.finditer(text, a, b)]
    return parts[-1] if parts and all(parts) else "u"


# ---------------------------------------------------------------- features


def masked(word: str) -> str:
    return _DIGITS.sub("0", word.lower())


_TOKENS = re.compile(r"[^\W\d_]+\.?|\d+|[^\w\s]")


def shape_of(span: str) -> str:
    """Digits, letters and separators of a span, runs of letters and digits by length class."""
    s = re.sub(r"\s", " ", span)
    s = re.sub(r"[a-zß-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]+", lambda m: "A" * min(len(m.group()), 2), s))
    return re.sub(r"\d+", lambda m: "0" * min(len(m.group()), 6), s)[:18]


_CAP_BEFORE = re.compile(r"(?:[A-ZÀ-Þ][\w'’-]*[^\W\d_],?|(?<!\w)[A-Z]\.)[ ]$")
_CAP_AFTER = re.compile(rf"[ ]{_LINK}[A-ZÀ-Þ][^\W\d_]")
_DATED = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}$")
#: A list or table right under a line, which makes the line a heading.
_ITEM_AFTER = re.compile(r"\s*\n\s*(?:[-–•*+]|\[|\(?\w[.)]|\d+(?:\.\d+)*[.)]?\s|[^\n]{0,24}(?:[|;\t/]|: ))")
_GROUP = re.compile(r"\d+")
#: What follows a given name whose family name the lexicon lacks: an initial, a particle, a hyphen, a word on the next line.
_NAME_AFTER = re.compile(rf"[-'’][A-ZÀ-Þ]|,[ ][A-ZÀ-Þ]|[ ](?:[A-Z]\.[ ]|(?:von|van|de|di|da|del|der|zu|du|ten)[ ])|\r?\n(?:> ?)*[A-ZÀ-Þ][^\W\d_]")
NUMERIC = ("length", "digits", "letters", "upper", "spaces", "dots", "dashes", "slashes", "plus", "paren", "first_zero", "groups", "line_start", "line_end", "tabular", "prev_digit", "next_digit", "title", "given", "family", "unknown", "commas", "dated", "in_word", "lower_text", "cap_before", "cap_after", "name_after", "at_first", "odd_end", "bare_host", "initials", "all_upper", "agrees", "blank_after", "at_start", "greeted", "list_after")
EVIDENCE = ("prev1", "prev2", "prev3", "next1", "next2", "shape", "first", "last")
#: Evidence of a name's own words counts against it only, so that trees don't learn the names of the training data by heart.
AGAINST = ("first", "last")


def mail_locals(text: str, mail: list[tuple[int, int]]) -> list[str]:
    """The folded parts before the @ of a text's addresses."""
    return [fold(text[a:b].partition("@")[0]) for a, b in mail]


def describe(text: str, a: int, b: int, shape: str, lower_text: bool, locals_: list[str] = ()) -> tuple[list[float], tuple[str, ...]]:
    """Numbers and evidence keys of one span; shape is that of a name, else empty."""
    s = text[a:b]
    left, right = text[max(0, a - 40) : a], text[b : b + 30]
    lt, rt = _TOKENS.findall(left[-24:]), _TOKENS.findall(right[:24])
    line = left.rpartition("\n")[2] if "\n" in left else left
    own = _WORD.findall(s)
    keys = (
        masked(lt[-1]) if lt else "^",
        masked(f"{lt[-2]} {lt[-1]}") if len(lt) > 1 else "^",
        masked(lt[-2]) if len(lt) > 1 else "^",
        masked(rt[0]) if rt else "$",
        masked(rt[1]) if len(rt) > 1 else "$",
        shape or shape_of(s),
        own[0].lower() if own else "",
        own[-1].lower() if own else "",
    )
    digits = 0 if shape else sum(map(str.isdigit, s))
    values = [
        b - a, digits, sum(map(str.isalpha, s)), sum(map(str.isupper, s)), s.count(" ") + s.count("\xa0"), s.count("."), s.count("-"), s.count("/"), s[:1] == "+", "(" in s,
        not shape and s.lstrip("+(").startswith("0"), 0 if shape else len(_GROUP.findall(s)), not line.strip(" >"), right[:1] in "\r\n", sum(map(left.count, "|\t;")) + sum(map(right.count, "|\t;")),
        left[-1:].isdigit() or left[-2:-1].isdigit(), right[:1].isdigit() or right[1:2].isdigit(), bool(_TITLE.search(left)), shape.count("g"), shape.count("f"), shape.count("u"), s.count(","),
        not shape and bool(_DATED.match(s)), left[-1:].isalnum() or left[-1:] in "@_", lower_text,
        bool(_CAP_BEFORE.search(left[-30:])), bool(_CAP_AFTER.match(right)), bool(_NAME_AFTER.match(right)),
        s[:1] == "@", not s[-2:].isalpha(), "@" in s and "." not in s.rpartition("@")[2],
        shape.count("i"), s.isupper(), bool(shape and locals_ and len(own[-1]) > 2 and any(fold(own[-1]) in x or len(own) > 1 and len(own[0]) > 2 and fold(own[0]) in x for x in locals_)),
        right.startswith(("\n\n", "\r\n\r\n")), not text[max(0, a - 3) : a].strip("# "), bool(_GREETED.search(left[-24:])), bool(_ITEM_AFTER.match(right)),
    ]
    return [float(v) for v in values], keys


def candidates(text: str, lexicon: Lexicon, hidden: Callable[[str], bool] | None = None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, name shape) of all proposals of all generators. Training hides words of the lexicon."""
    out: list[tuple[str, int, int, str]] = []
    mail = emails(text)
    low = _lower(text)
    words, anchors = lexicon.find(low)
    words = [w for w in words if text[w[0]].isupper() or low[w[0] : w[1]] not in lexicon.common]
    if hidden:
        words = [w for w in words if not hidden(low[w[0] : w[1]])]
    out += [("email", a, b, "") for a, b in [*mail, *address_like(text, mail)]]
    busy = Spans(mail)
    if _DIGITS.search(text):
        digits = [(a, b) for a, b in numbers(text) if not busy.holds(a)]
        out += [("phone", a, b, "") for a, b in digits]
        out += [("id_number", a, b, "") for a, b in identity(text, anchors, digits) if not busy.holds(a)]
        out += [("address", a, b, "") for a, b in addresses(text, anchors)]
    found = names(text, words, mail)
    out += [("name", a, b, k) for a, b, k in found]
    out += [("name", a, b, k) for a, b, k in capitalised(text, words, mail, {(a, b) for a, b, _ in found})]
    return out


class Judge:
    """Evidence tables, trees and thresholds of the trained model, and the lexicon of the input at hand."""

    def __init__(self, words: dict[str, str] | None = None) -> None:
        self.models, more = gbt.load("pii")
        self.lexicon = Lexicon(words or {})
        self.evidence = {k: [dict(t) for t in tables] for k, tables in more["evidence"].items()}
        self.threshold = more["threshold"]

    def rows(self, kind: str, found: list[tuple[list[float], tuple[str, ...]]]) -> np.ndarray:
        tables = self.evidence[kind]
        return np.array([v + [t.get(k, 0.0) for t, k in zip(tables, keys)] for v, keys in found], dtype=np.float32)

    def mentions(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the mentions of each text, in order."""
        spans: dict[str, list] = {k: [] for k in KINDS}
        facts: dict[str, list] = {k: [] for k in KINDS}
        for i, t in enumerate(texts):
            got = candidates(t, self.lexicon)
            if got:
                lower_text = t.islower()
                locals_ = mail_locals(t, [(a, b) for kind, a, b, _ in got if kind == "email"])
                for kind, a, b, shape in got:
                    spans[kind].append((i, a, b))
                    facts[kind].append(describe(t, a, b, shape, lower_text, locals_))
        chosen: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
        for kind in KINDS:
            if spans[kind]:
                p = self.models[kind].predict(self.rows(kind, facts[kind]))
                for (i, a, b), q in zip(spans[kind], p.tolist()):
                    if q >= self.threshold[kind]:
                        chosen[i].append((q - self.threshold[kind], a, b, kind))
        return [resolve(c) for c in chosen]


def resolve(found: list[tuple[float, int, int, str]]) -> list[tuple[int, int, str]]:
    """Of overlapping spans the surest; a name within an address or e-mail address gives way."""
    kept, own = [], Spans()
    for _, a, b, kind in sorted(found, key=lambda x: (x[3] == "name", x[3] == "phone", -x[0], x[1])):
        if not own.meets(a, b):
            own.add(a, b)
            kept.append((a, b, kind))
    return sorted(kept)


_judges: dict[frozenset, Judge] = {}


def judge(words: dict[str, str] | None = None) -> Judge:
    """The judge with these words of names; one is kept for the last words, one for none."""
    key = frozenset((words or {}).items())
    if key not in _judges:
        for old in [k for k in _judges if k]:
            del _judges[old]
        _judges[key] = Judge(words)
    return _judges[key]


# ---------------------------------------------------------------- operators


def find_mentions(df: DataFrame, key: str, field: str, column: str, words: dict[str, str] | None = None) -> DataFrame:
    """(key, field, item_no, char_start, char_end, pii_kind) of a column of texts or of arrays of texts."""
    kind = dict(df.dtypes)[key]
    listed = dict(df.dtypes)[column].startswith("array")
    rows = df.select(key, F.posexplode(column).alias("item_no", "t")) if listed else df.select(key, F.lit(0).alias("item_no"), F.col(column).alias("t"))
    rows = spread(rows.filter("t is not null and length(t) > 1"), key)

    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = judge(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                at, start, end, kinds = [], [], [], []
                for row, got in enumerate(own.mentions(part.column(2).to_pylist())):
                    for a, b, k in got:
                        at.append(row)
                        start.append(a)
                        end.append(b)
                        kinds.append(k)
                where = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(where), pa.array([field] * len(at), pa.string()), part.column(1).take(where), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(kinds, pa.string())],
                    [key, "field", "item_no", "char_start", "char_end", "pii_kind"],
                )

    return rows.mapInArrow(run, f"`{key}` {kind}, field string, item_no int, char_start int, char_end int, pii_kind string").distinct()


#: What stands for a mention in the redacted text.
PLACEHOLDER: Callable[[str], str] = lambda kind: f"[{kind.upper()}]"


def redact_text(text: str, mentions: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, kind in mentions:
        out += [text[last:a], PLACEHOLDER(kind)]
        last = b
    return "".join([*out, text[last:]])


def redact(df: DataFrame, key: str, column: str, words: dict[str, str] | None = None) -> DataFrame:
    """(key, item_no, redacted, n_mentions): the text, or each entry of an array of texts, with placeholders for its mentions; null stays null."""
    kind = dict(df.dtypes)[key]
    listed = dict(df.dtypes)[column].startswith("array")
    rows = df.select(key, F.posexplode(column).alias("item_no", "t")) if listed else df.select(key, F.lit(0).alias("item_no"), F.col(column).alias("t"))
    rows = spread(rows, key)

    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = judge(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = part.column(2).to_pylist()
                got = own.mentions([t or "" for t in texts])
                new = [None if t is None else redact_text(t, m) for t, m in zip(texts, got)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(new, pa.string()), pa.array([len(m) for m in got], pa.int32())], [key, "item_no", "redacted", "n_mentions"])

    return rows.mapInArrow(run, f"`{key}` {kind}, item_no int, redacted string, n_mentions int").distinct()
