"""Training of the personal-information model: python -m papyra.llm.train_pii DATA_DIR.

Names for the labels come from mail headers: words of the sender's name, and of display names that agree with the
address beside them. In two documents of three, half of these words are hidden from the generators, and in the others
all of them, so that the trees learn to tell names that no header gave from other capitalised words. No word of a name
goes into the model. Spans of all generators get weak labels by the rules here; evidence tables hold the log-odds of
neighbouring words and forms; trees are fitted on at most SAMPLE documents (a documented bound), thresholds are
set on documents left out, and the figures printed for names are those of documents left out with all words hidden.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter

import numpy as np

from papyra.llm import gbt, pii
from papyra.llm.train_textclass import doc_label

#: Most documents that a fit takes; entries of an evidence table.
SAMPLE, ENTRIES = 8_000, 250
#: The numbers of a span that the e-mail trees may test.
EMAIL_FORM = ("prev_digit", "next_digit", "in_word", "at_first", "odd_end", "bare_host")

#: Words before numbers that don't identify or reach a person.
_THINGS = set("batch order part number # invoice code checksum starts with version runs on case ticket no isbn serial room page pages shelf lot ref reference parcel shipment le am op il el dia dnia job".split())
_REACH = set("phone tel telefon téléphone tél mobile mobil móvil teléfono fax t at on or unter oder au al ou o call".split())
_MANY = set("all everyone everybody team colleagues colleague customer customers sir madam reader readers friend friends zusammen alle damen herren kollegen kolleginnen kunde kunden leser tous toutes collègues client clients lecteur lecteurs todos todas equipo colegas cliente clientes tutti colleghi".split())
_NOT_NAME_AFTER = set("gmbh ag ltd inc sarl sa llc kg press trust logistics data works team desk street road close avenue weg platz & und".split())


def lexicon_of(mails: list[tuple[str | None, str | None, list[str | None] | None]]) -> dict[str, str]:
    """Word -> g or f, by where it stands in names that agree with an address."""
    given, family = Counter(), Counter()

    for mail in mails:
        for w, k in pii.header_words(*mail):
            (given if k == "g" else family)[w] += 1
    out = {}
    for w in set(given) | set(family):
        if given[w] + family[w] >= 1 and len(w) > 2:
            out[w] = "g" if given[w] >= family[w] else "f"
    for w, k in list(out.items()):
        out.setdefault(pii.fold(w), k)
    return out


def weak(kind: str, text: str, a: int, b: int, shape: str, keys: tuple[str, ...], junk: bool, mail: list[tuple[int, int]]) -> int | None:
    """1, 0, or None where the rules say nothing."""
    s, left, right = text[a:b], text[max(0, a - 60) : a], text[b : b + 30]
    prev = re.findall(r"[^\W\d_]+|#|\d+", left.lower())
    last = prev[-1] if prev else ""
    if kind == "email":
        return 0 if re.search(r"@\s?\d|\d$", s) or pii._LIKE.fullmatch(s) and not pii._EMAIL.fullmatch(s) else 1
    if kind == "phone":
        digits = re.sub(r"\D", "", s)
        if junk or len(digits) < 9 or re.match(r"\d{1,3}(?:\.\d{1,3}){3}$", s) or re.match(r"\d{1,2}[./]\d{1,2}[./]\d{4}", s):
            return 0
        if re.search(r"\d/$", left) or re.match(r"/\d", right) or "/" in s and s.count("/") > 1:
            return 0
        if last in ("batch", "order", "part", "code", "invoice", "version", "#", "checksum") or re.search(r"(?:part number|invoice no\.?|starts with|runs on|number #|tracking code|order|batch)\s*$", left.lower().replace("\n", " ")):
            return 0
        if pii._ID_LABEL.search(text[max(0, a - 40) : a]) and re.search(r"(?:SSN|NINO|No\.?|number|ID|nummer|Nr\.?|NIR|INSEE|sociale|DNI|I\.|NIE|identidad|licen[cs]e|DL|Nummer)\s*[:#.]*\s*[A-Z]?-?\s*$", left, re.I):
            return 0
        if last in _REACH or s[0] in "+(" or re.match(r"0\d", digits) and digits != "0" * len(digits):
            return 1
        if re.match(r"(?:1[. -])?\d{3}[.  -]\d{3}[.  -]\d{4}$", s) or re.match(r"9\d{2}[  -]?\d{3}[  -]?\d{2,3}[  -]?\d{0,2}", s):
            return 1
        return 0
    if kind == "id_number":
        if junk:
            return 0
        bare = re.sub(r"\W", "", s)
        if pii._ID_LABEL.search(left[-40:]) and any(c.isdigit() for c in s) and len(bare) >= 6 and not re.search(r"[a-z]{3}", s if not text.islower() else ""):
            return 1
        if pii._ID_LABEL.search(left[-40:]) and sum(c.isdigit() for c in s) >= 3 and len(bare) >= 6:
            return 1
        return 0
    if kind == "address":
        if junk:
            return 0
        street = s.split()
        if re.search(r"vergadering|ring\s*\n|steig\s*\n", s) or s[0].islower() and not text.islower() and not re.match(r"c/|calle|avda", s):
            return 0
        if re.match(r"\d{1,4}[a-z]?,?\s[A-Z]", s) or re.match(r"[A-ZÄÖÜ]", s) or re.match(r"(?:[A-Z]-)?\d", s) or re.match(r"(?:c/|calle|avda|avenida|paseo|plaza|camino)", s, re.I):
            if re.search(r"\b(?:page|room|Seite|página|shelf|Level|Building)\b", s) or len(street) > 9:
                return 0
            return 1
        return None
    if junk:
        return 0
    nxt = re.match(r"\s*(&|\w+)", right)
    if nxt and nxt.group(1).lower() in _NOT_NAME_AFTER and not re.match(r"\s*und ", right):
        return 0
    if right and right[0] in "@/_" or left and left[-1:] in "@/_.+" and left[-2:-1].isalnum():
        return 0
    if set(shape) == {"u"}:  # proposed by a greeting or title only
        return 0 if s.split()[0].lower() in _MANY or len(s.split()) > 3 else 1
    if s[0].isupper() or text.islower() or len(shape) > 1 or re.match(r"(?:von|van|de|di|da|del|der|zu)\s", s):
        return 1
    return 0


def hider(i: int):
    """Which words of the lexicon are hidden in the i-th document: one half or the other, or all."""
    return (lambda w: zlib.crc32(w.encode()) % 2 == i % 2) if i % 3 else (lambda w: w not in _COMMON)


_COMMON = frozenset(pii.GIVEN)


def unlisted(text: str, a: int, b: int, lexicon: pii.Lexicon, words: list[tuple[int, int, str]], lower: set[str], alone: set[str]) -> int | None:
    """The label of a span that the whole lexicon doesn't give: None where it may be a name that no header has."""
    own = [m.span() for m in pii._CAPITAL.finditer(text, a, b)]
    known = {(x, y) for x, y, _ in words}
    first = own[0] if own else (a, b)
    if any(text[x:y].lower().strip(".") in lower for x, y in own if y - x > 2):
        return 0
    if len(own) == 1 and text[a:b].lower() in alone:
        return 0
    return None if first in known or text[first[1] - 1] == "." or len(own) == 1 or own[-1] in known and text[first[1] : first[1] + 1] == "," else 0


def labelled(i: int, text: str, lexicon: pii.Lexicon, hidden, lower: set[str] = frozenset(), alone: set[str] = frozenset()) -> list[tuple[str, list[float], tuple[str, ...], int]]:
    """(kind, values, keys, label) of the candidates of a document. A name is true where the whole lexicon and the rules give the same span."""
    got = pii.candidates(text, lexicon, hidden)
    if not got:
        return []
    junk, low = doc_label(text) == "junk", text.islower()
    mail = pii.emails(text)
    words, _ = lexicon.find(pii._lower(text))
    listed = {}
    for a, b, shape in pii.names(text, words, mail):
        listed[a, b] = weak("name", text, a, b, shape, pii.describe(text, a, b, shape, low)[1], junk, mail)
    out = []
    locals_ = pii.mail_locals(text, mail)
    for kind, a, b, shape in got:
        values, keys = pii.describe(text, a, b, shape, low, locals_)
        y = (listed[a, b] if (a, b) in listed else 0 if any(x < b and a < y and v for (x, y), v in listed.items()) else unlisted(text, a, b, lexicon, words, lower, alone)) if kind == "name" else weak(kind, text, a, b, shape, keys, junk, mail)
        if y is not None:
            out.append((kind, values, keys, y))
    return out


def checked(kind: str, model: gbt.Boosted) -> gbt.Boosted:
    """The model, if it has a tree: without one it would take every candidate."""
    if not model.trees:
        raise ValueError(f"the model of {kind} has no tree: its weak labels don't differ")
    return model


def main(data: str) -> None:
    import duckdb

    mails = duckdb.sql(f"select from_email, from_name, to_emails from '{data}/email_metadata.parquet'").fetchall()
    words = lexicon_of(mails)
    print(len(words), "words of names")
    rows = duckdb.sql(f"select result_id, any_value(content) from '{data}/extraction_results.parquet' where trim(content) <> '' group by 1 order by hash(result_id) limit {SAMPLE}").fetchall()
    texts = [t for _, t in rows] + [e for f, _, to in mails for e in [f, *(to or [])] if e and e.strip()]
    lexicon = pii.Lexicon(words)
    found: dict[str, list] = {k: [] for k in pii.KINDS}
    # words that are written in lower case in texts that have capitals
    often = Counter(w for t in texts if not t.islower() for w in re.findall(r"(?<![\w@.-])[a-zà-ÿ]{3,}(?![\w@-])", t))
    lower = {w for w, n in often.items() if n >= 3}
    # words that stand alone on a line again and again: headings and closings
    lines = Counter(m.lower() for t in texts for m in re.findall(r"^(?:> ?|#+ )*([^\W\d_]+),?[ ]?\r?$", t, re.M))
    alone = {w for w, n in lines.items() if n >= 5 and w not in words}
    for i, t in enumerate(texts):
        for kind, values, keys, y in labelled(i, t, lexicon, hider(i), lower, alone):
            found[kind].append((i, values, keys, y))
    evidence, models, threshold = {}, {}, {}
    for kind in pii.KINDS:
        fit = [f for f in found[kind] if f[0] % 5 < 3]
        held = [f for f in found[kind] if f[0] % 5 >= 3]
        tables = []
        base = math.log((sum(f[3] for f in fit) + 1) / (sum(1 - f[3] for f in fit) + 1))
        for slot in range(len(pii.EVIDENCE)):
            pos, neg = Counter(), Counter()
            for f in fit:
                (pos if f[3] else neg)[f[2][slot]] += 1
            score = {k: math.log((pos[k] + 0.5) / (neg[k] + 0.5)) - base * 0.5 for k in set(pos) | set(neg) if pos[k] + neg[k] >= 3}
            if pii.EVIDENCE[slot] in pii.AGAINST:
                score = {k: v for k, v in score.items() if v < 0 and kind == "name" and k not in words}
            top = sorted(score, key=lambda k: -(pos[k] + neg[k]))[: ENTRIES if pii.EVIDENCE[slot] not in pii.AGAINST else 2 * ENTRIES]
            tables.append({k: round(score[k], 2) for k in sorted(top)})
        evidence[kind] = tables
        x = lambda fs: np.array([v + [t.get(k, 0.0) for t, k in zip(tables, keys)] for _, v, keys, _ in fs], dtype=np.float32)
        y = np.array([f[3] for f in fit], dtype=float)
        hy = np.array([f[3] for f in held], dtype=float)
        rows = x(fit)
        if kind == "email":  # by form and neighbours, not by the sizes of the addresses here; every fourth row's neighbours are taken for unseen
            rows[:, [j for j, f in enumerate(pii.NUMERIC) if f not in EMAIL_FORM]] = 0
            rows[::4, len(pii.NUMERIC) :] = 0
        m = checked(kind, gbt.Boosted.fit(rows, y, trees=60, depth=5, rate=0.25))
        m.calibrate(x(held), hy)
        p = m.predict(x(held))
        grid = np.linspace(0.2, 0.8, 25)
        f1 = [2 * ((p >= g) & (hy == 1)).sum() / max(1, (p >= g).sum() + (hy == 1).sum()) for g in grid]
        # among thresholds that are as good within a thousandth or two, the one next to the middle
        best = np.flatnonzero(np.array(f1) >= max(f1) - (2e-3 if kind == "name" else 5e-4))
        threshold[kind] = float(grid[best[np.abs(grid[best] - (0.45 if kind == "name" else 0.5)).argmin()]])
        models[kind] = m
        if kind == "name":
            hid = np.array([f[0] % 3 == 0 for f in held])
            q = p[hid] >= threshold[kind]
            print("names with all words hidden: recall", round(float(q[hy[hid] == 1].mean()), 4), "precision", round(float(hy[hid][q].mean()), 4), "of", int(hy[hid].sum()))
        print(kind, len(fit), int(y.sum()), "held F1", round(max(f1), 4), "at", threshold[kind])
    gbt.save("pii", models, evidence=evidence, threshold=threshold)


if __name__ == "__main__":
    main(*sys.argv[1:])
