"""Language of documents and of the stretches within them, by a linear-chain conditional random field over words.

Every word has a score for each language from its affixes, character n-grams, script and lexicon membership; learned
transitions tie neighbouring words together; forward-backward gives each word's probabilities. A block (lines
between blank lines) has the language with most of its text; blocks with too few words take the language of the
blocks around them. See train_langseg.py for the fit.

Results: null, blank and junk contents have no language; a text without words has none either; ties go to the
first code in order; a repeated row counts once. Stretches in a language that isn't among the ten come out neither as
findings nor as segments, and break the runs around them. Texts are read whole. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyra.llm import gbt
from papyra.llm.textclass import batches_of, class_shares, decide
from papyra.session import spread

LANGS = ("deu", "eng", "fra", "ita", "jpn", "nld", "pol", "por", "rus", "spa")
#: How labels name these languages.
CODES = {
    "deu": "de deu ger german deutsch", "eng": "en eng english", "fra": "fr fra fre french français francais", "ita": "it ita italian italiano",
    "jpn": "ja jpn jp japanese 日本語", "nld": "nl nld dut dutch nederlands", "pol": "pl pol polish polski", "por": "pt por portuguese português portugues",
    "rus": "ru rus russian русский", "spa": "es spa spanish español espanol castellano",
}
_OF_CODE = {c: lang for lang, cs in CODES.items() for c in cs.split()}
#: Size of the table of hashed features; words that a block needs for a language of its own.
BUCKETS, FEW = 1 << 15, 4
#: Words that are worked on together: memory for the chains of a batch, whose lengths may differ widely.
TOGETHER = 1 << 18
#: The language of a block that is in none of LANGS, and the share of foreign letters that makes it so.
UNKNOWN, FOREIGN = -2, 0.03
#: Letters beyond a to z of each language (all letters, for Cyrillic); a Japanese text has kana.
LETTERS = {
    "deu": "äöüßéà", "eng": "éèêïöçñà", "fra": "àâæçéèêëîïôœùûüÿ", "ita": "àèéìíîòóùú", "nld": "áéèëêïíóöüúĳ", "pol": "ąćęłńóśźżé", "por": "áâãàçéêíóôõúü", "spa": "áéíñóúüç",
    "rus": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
}
#: A block needs this share of its text for a language of its own; a sole language below it doesn't overrule a label.
SURE = 0.75
#: And this share, where it isn't the language of most of the whole text.
SURE_OTHER = 0.9
#: Of a short block, which may be no more than a greeting or a signature, this share.
SHORT, SURE_SHORT = 12, 0.97

_WORD = re.compile(r"[^\W\d_]+")
_MAIL = re.compile(r"(?<![^\s@])[^\s@]*@[^\s@]+")
#: A letter that marks an item at the start of a line is no word.
_BULLET = re.compile(r"^[ \t]*o[ \t]+", re.M)


def label_of(code: str | None) -> str | None:
    """The language that a label names, whatever its spelling; None if it names none of these."""
    if code is None:
        return None
    return _OF_CODE.get(re.split(r"[-_]", code.strip().lower())[0])


def blocks_of(text: str) -> list[str]:
    """The groups of lines between lines that are empty or all white space."""
    out, own = [], []
    for line in re.split(r"\r\n|\n|\r", text):
        if line.strip():
            own.append(line)
        elif own:
            out.append("\n".join(own))
            own = []
    if own:
        out.append("\n".join(own))
    return out


def words_of(block: str) -> list[str]:
    """Words in lower case; runs of a script without spaces are cut into pieces of four characters."""
    out = []
    if "@" in block:
        block = _MAIL.sub(" ", block)
    for w in _WORD.findall(_BULLET.sub("", block.lower())):
        if w[0] >= "぀" and len(w) > 4:
            out += [w[i : i + 4] for i in range(0, len(w), 4)]
        else:
            out.append(w)
    return out


def foreign(block: str, lang: str) -> bool:
    """Whether the letters of a block tell that it isn't in its language.

    Of the letters in the language's script more than FOREIGN are none of its own, or most letters are in another
    script; Han text without kana is Chinese where Chinese particles are frequent.
    """
    if block.isascii():
        return lang in ("rus", "jpn")
    if lang == "jpn":
        signs = sum("\u3040" <= c <= "\u9fff" for c in block)
        return not _KANA.search(block) and sum(c in CHINESE for c in block) > FOREIGN * max(signs, 1)
    own, inside, odd, other = _OWN[lang], 0, 0, 0
    low, high = (0x400, 0x530) if lang == "rus" else (0, 0x250)
    for c, k in Counter(block.lower()).items():
        if c.isalpha():
            if low <= ord(c) < high:
                inside += k
                odd += k if c not in own else 0
            else:
                other += k
    return odd > FOREIGN * inside or other > 2 * inside


#: Fixed value: the most frequent particles and pronouns of written Chinese.
CHINESE = frozenset("的了是我们們这這个個不他她在吗嗎没沒")
_KANA = re.compile("[\u3040-\u30ff]")
_OWN = {lang: frozenset(signs if lang == "rus" else signs + "abcdefghijklmnopqrstuvwxyz") for lang, signs in LETTERS.items()}


def word_features(word: str) -> list[int]:
    """Buckets of a word's features: the word, prefixes, suffixes, character n-grams and script."""
    w = word
    if w[0] >= "぀":
        keys = ["script:cjk", *["c:" + c for c in w[:4]]]
    elif "Ѐ" <= w[0] <= "ӿ":
        keys = ["script:cyr", "w:" + w]
    else:
        p = f"<{w}>"
        keys = ["script:latin", "w:" + w, *[f"p{n}:{w[:n]}" for n in (2, 3) if len(w) > n], *[f"s{n}:{w[-n:]}" for n in (2, 3, 4) if len(w) > n]]
        keys += [f"n:{p[i : i + n]}" for n in (2, 3) for i in range(len(p) - n + 1)]
    return [zlib.crc32(k.encode("utf-8", "replace")) % BUCKETS for k in keys]


class Field:
    """The fitted field: scores of features, transitions, begin scores."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, begin: np.ndarray):
        self.weights, self.transition, self.begin = weights, transition, begin
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(LANGS)), dtype=np.float32)

    @classmethod
    def loaded(cls) -> Field:
        d = np.load(os.path.join(gbt.MODELS, "langseg.npz"))
        return cls(d["weights"].astype(np.float32), d["transition"].astype(np.float32), d["begin"].astype(np.float32))

    def scores_of(self, words: list[str]) -> np.ndarray:
        """Row numbers of words in `rows`, new words scored on the way."""
        place = self.place
        if len(place) > 300_000:
            place.clear()
        get = place.get
        ids = [get(w, -1) for w in words]
        if -1 in ids:
            for w in {w for w, i in zip(words, ids) if i < 0}:
                at = len(place)
                if at == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[at] = self.weights[word_features(w)].sum(0)
                place[w] = at
            ids = [place[w] for w in words]
        return np.array(ids, dtype=np.int64)

    def posteriors(self, chains: list[np.ndarray]) -> np.ndarray:
        """Probabilities of each word of each chain (rows of scores), in order, all chains of like length together."""
        total = sum(map(len, chains))
        out = np.zeros((total, len(LANGS)), dtype=np.float32)
        begins = np.concatenate([[0], np.cumsum([len(c) for c in chains])]).astype(np.int64)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        trans = np.exp(self.transition - self.transition.max())
        first = np.exp(self.begin - self.begin.max())
        parts: list[list[int]] = [[]]
        for i in order:
            if parts[-1] and (len(parts[-1]) + 1) * len(chains[i]) > TOGETHER:
                parts.append([])
            parts[-1].append(i)
        for part in parts:
            longest = len(chains[part[-1]]) if part else 0
            if not longest:
                continue
            e = np.zeros((len(part), longest, len(LANGS)), dtype=np.float32)
            mask = np.zeros((len(part), longest), dtype=bool)
            for r, i in enumerate(part):
                e[r, : len(chains[i])] = self.rows[chains[i]]
                mask[r, : len(chains[i])] = True
            e = np.exp(e - e.max(2, keepdims=True))
            alpha = np.empty_like(e)
            a = first * e[:, 0]
            alpha[:, 0] = a / a.sum(1, keepdims=True)
            for t in range(1, longest):
                a = (alpha[:, t - 1] @ trans) * e[:, t]
                a /= a.sum(1, keepdims=True)
                alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
            b = np.ones((len(part), len(LANGS)), dtype=np.float32)
            for t in range(longest - 1, -1, -1):
                p = alpha[:, t] * b
                alpha[:, t] = p / p.sum(1, keepdims=True)
                nb = (e[:, t] * b) @ trans.T
                nb /= nb.sum(1, keepdims=True)
                b = np.where(mask[:, t, None], nb, b)
            for r, i in enumerate(part):
                out[begins[i] : begins[i + 1]] = alpha[r, : len(chains[i])]
        return out


_field: list[Field] = []


def field() -> Field:
    if not _field:
        _field.append(Field.loaded())
    return _field[0]


def block_languages(texts: list[str]) -> list[list[tuple[int, float]]]:
    """For each text and block (language, confidence); language -1 where no block of the text has enough words, UNKNOWN where it is none of LANGS."""
    own = field()
    words: list[str] = []
    sizes: list[int] = []
    shape: list[int] = []
    blocks: list[str] = []
    for t in texts:
        bs = blocks_of(t)
        shape.append(len(bs))
        blocks += bs
        for b in bs:
            ws = words_of(b)
            words += ws
            sizes.append(len(ws))
    ids = own.scores_of(words)
    ends = np.cumsum(sizes)
    chains = [ids[e - n : e] for e, n in zip(ends, sizes)]
    p = own.posteriors(chains)
    weight = np.fromiter(map(len, words), dtype=np.float32, count=len(words))
    many = len(sizes)
    of = np.repeat(np.arange(many), sizes)
    mass = np.zeros((many, len(LANGS)))
    for k in range(len(LANGS)):
        mass[:, k] = np.bincount(of, p[:, k] * weight, minlength=many) if len(of) else 0
    total = mass.sum(1)
    best = mass.argmax(1)
    sure = mass.max(1) / np.maximum(total, 1e-9)
    counts = np.array(sizes)
    out, at = [], 0
    for n in shape:
        got = []
        main = int(mass[at : at + n].sum(0).argmax())
        enough = (counts[at : at + n] >= FEW) & (sure[at : at + n] >= np.where(best[at : at + n] == main, SURE, np.where(counts[at : at + n] <= SHORT, SURE_SHORT, SURE_OTHER)))
        if not enough.any() and n:
            # nothing long enough: the text as a whole
            whole = mass[at : at + n].sum(0)
            lang = int(whole.argmax()) if whole.sum() > 0 else -1
            got = [(lang, float(whole.max() / max(whole.sum(), 1e-9)))] * n
        else:
            last = next((int(best[at + i]) for i in range(n) if enough[i]), -1)
            for i in range(n):
                if enough[i]:
                    last = int(best[at + i])
                    got.append((last, float(sure[at + i])))
                else:  # too short to tell: the language of the blocks around it, with the mass it has here
                    got.append((last, float(mass[at + i, last] / total[at + i]) if total[at + i] else float(sure[at : at + n][enough].max())))
        got = [(UNKNOWN, c) if k >= 0 and counts[at + i] >= FEW and foreign(blocks[at + i], LANGS[k]) else (k, c) for i, (k, c) in enumerate(got)]
        out.append(got)
        at += n
    return out


def placed_words(text: str) -> list[list[tuple[str, int, int]]]:
    """For each block its words in lower case with their places in the text."""
    lowered = text.lower()
    if len(lowered) != len(text):  # letters that lower() makes longer stay as they are
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    plain = _BULLET.sub(lambda m: " " * len(m.group()), _MAIL.sub(lambda m: " " * len(m.group()), lowered) if "@" in lowered else lowered)
    out: list[list[tuple[str, int, int]]] = []
    open_, last = False, 0
    for m in re.finditer(r"\r\n|\n|\r|\Z", text):
        a, b, last = last, m.start(), m.end()
        if not text[a:b].strip():
            open_ = False
            continue
        if not open_:
            out.append([])
            open_ = True
        for w in _WORD.finditer(plain, a, b):
            x, y = w.span()
            if w.group()[0] >= "぀" and y - x > 4:
                out[-1] += [(plain[i : min(i + 4, y)], i, min(i + 4, y)) for i in range(x, y, 4)]
            else:
                out[-1].append((w.group(), x, y))
    return out


def word_runs(texts: list[str]) -> list[list[tuple[int, int, int, str, float]]]:
    """For each text (block_no, char_start, char_end, language, confidence) of the stretches within its blocks.

    Each word has its likeliest language; a stretch of fewer than FEW words joins the neighbour in whose language it has
    more mass. Confidence is the mean probability of the stretch's words.
    """
    own = field()
    placed = [(i, b, ws) for i, t in enumerate(texts) for b, ws in enumerate(placed_words(t)) if ws]
    chains = [own.scores_of([w for w, _, _ in ws]) for _, _, ws in placed]
    p = own.posteriors(chains)
    out: list[list[tuple[int, int, int, str, float]]] = [[] for _ in texts]
    at = 0
    for i, b, ws in placed:
        q = p[at : at + len(ws)]
        at += len(ws)
        best = q.argmax(1)
        cuts = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(ws)]
        runs = [[x, y, int(best[x])] for x, y in zip(cuts, cuts[1:])]
        while len(runs) > 1 and min(y - x for x, y, _ in runs) < FEW:
            k = min(range(len(runs)), key=lambda r: (runs[r][1] - runs[r][0], r))
            x, y, _ = runs[k]
            near = max((j for j in (k - 1, k + 1) if 0 <= j < len(runs)), key=lambda j: (q[x:y, runs[j][2]].sum(), -j))
            lo, hi = min(k, near), max(k, near)
            runs[lo : hi + 1] = [[runs[lo][0], runs[hi][1], runs[near][2]]]
            if lo and runs[lo - 1][2] == runs[lo][2]:
                runs[lo - 1 : lo + 1] = [[runs[lo - 1][0], runs[lo][1], runs[lo][2]]]
                lo -= 1
            if lo + 1 < len(runs) and runs[lo + 1][2] == runs[lo][2]:
                runs[lo : lo + 2] = [[runs[lo][0], runs[lo + 1][1], runs[lo][2]]]
        for x, y, k in runs:
            lang = "und" if y - x >= FEW and foreign(texts[i][ws[x][1] : ws[y - 1][2]], LANGS[k]) else LANGS[k]
            out[i].append((b, ws[x][1], ws[y - 1][2], lang, float(q[x:y, k].mean())))
    return out


def findings(langs: list[tuple[int, float]], labels: list[str | None] | None) -> list[tuple[int, str, float]]:
    """(block_no, language, confidence): runs of blocks if languages differ, else the one language where the label isn't exactly it."""
    known = [x for x in langs if x[0] >= 0]
    if not known:
        return []
    if len({k for k, _ in known}) == 1 and len(known) == len([x for x in langs if x[0] != -1]):
        lang = LANGS[known[0][0]]
        named = {label_of(c) for c in labels or []}
        sure = max(c for _, c in known)
        if named == {lang} or sure < SURE and len(named) == 1 and None not in named:
            return []
        return [(0, lang, sure)]
    out, last = [], -1
    for i, (k, c) in enumerate(langs):
        if k == -1:
            continue
        if k != last and k >= 0:
            out.append((i, LANGS[k], c))
        last = k
    return out


def segment(df: DataFrame, key: str = "result_id", text: str = "content", labels: str = "detected_languages", only_findings: bool = True) -> DataFrame:
    """(key, block_no, lang, confidence): wrong or missing labels and mixed texts; or with only_findings off every text's runs."""
    kind = dict(df.dtypes)[key]
    rows = spread(df.select(key, text, labels), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(2).to_pylist()
            for at, texts in batches_of(batch.column(1).to_pylist()):
                junk = decide(class_shares(texts)) == 3
                keep = [i for i in range(len(at)) if not junk[i]]
                row, no, lang, sure = [], [], [], []
                for i, langs in zip(keep, block_languages([texts[i] for i in keep])):
                    for b, name, c in findings(langs, given[at[i]] if only_findings else None):
                        row.append(at[i])
                        no.append(b)
                        lang.append(name)
                        sure.append(c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())],
                    [key, "block_no", "lang", "confidence"],
                )

    return rows.mapInArrow(run, f"`{key}` {kind}, block_no int, lang string, confidence double").dropDuplicates([key, "block_no"])


def stretches(df: DataFrame, key: str = "result_id", text: str = "content") -> DataFrame:
    """(key, block_no, char_start, char_end, lang, confidence): every stretch in one language within the blocks of each text.

    und stands for a language that isn't among the ten; null, blank and junk texts have no stretch.
    """
    kind = dict(df.dtypes)[key]
    rows = spread(df.select(key, text), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in batches_of(batch.column(1).to_pylist()):
                junk = decide(class_shares(texts)) == 3
                keep = [i for i in range(len(at)) if not junk[i]]
                found = [(at[i], *r) for i, rs in zip(keep, word_runs([texts[i] for i in keep])) for r in rs]
                cols = list(zip(*found)) or [()] * 6
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
                where, *rest = [pa.array(v, t) for v, t in zip(cols, types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), *rest], [key, "block_no", "char_start", "char_end", "lang", "confidence"])

    return rows.mapInArrow(run, f"`{key}` {kind}, block_no int, char_start int, char_end int, lang string, confidence double").dropDuplicates([key, "block_no", "char_start"])
