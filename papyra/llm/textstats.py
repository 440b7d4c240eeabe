"""Text statistics by line, block and document, computed on arrays of code points without a loop over rows.

A block is a run of lines between blank lines. Statistics of a document: words, mean word length, share of
letters, upper-case letters, digits, symbols, damaged characters, vowels and common words, share of lines that end
in punctuation or begin like an item, delimiters and column gaps by line and how even they are.
"""

from __future__ import annotations

import unicodedata

import numpy as np

#: The most usual function words of ten languages.
COMMON = """
the a an of and to in is was for on with at by from that this it as be are or not before after we which so but were has have
der die das und ein eine den des in auf mit von zu ist nicht für noch vor nach im am alle wegen dem sich wir um aber bei
le la les un une des du de et à en au pour avec sans sur est ce dans par qui que ne pas nous il se plus
el los las una del y con sin por es al este lo no se su nos antes
il lo gli i uno di della e per su che è questo non si nella
o os as um uma do da das em no na com sem para não que dos
de het een en van op met zonder voor na dat die aan door naar te er bij nog niet om
w z na do od po przed pod bez jest nie że ale ten ta już przez oraz dla się
и в на с до от по под без не что но это уже из для все после к у он как
""".split()

(OTHER, LOWER, UPPER, CJK, DIGIT, BLANK, NEWLINE, ENDING, COMMA, PIPE, TAB, MARK, SYMBOL, DAMAGED, DASHDOT) = range(15)


def _classes() -> np.ndarray:
    of = np.full(0x110000, OTHER, dtype=np.uint8)
    for p in range(0x110000):
        cat = unicodedata.category(chr(p))
        if cat in ("Ll", "Mn", "Mc"):
            of[p] = LOWER
        elif cat in ("Lu", "Lt"):
            of[p] = UPPER
        elif cat in ("Lo", "Lm"):
            of[p] = CJK if p >= 0x2E80 else LOWER
        elif cat == "Nd":
            of[p] = DIGIT
        elif cat == "Zs":
            of[p] = BLANK
        elif cat[0] == "P":
            of[p] = MARK
        elif cat[0] in "SN":
            of[p] = SYMBOL
        elif cat in ("Cc", "Cn", "Co", "Cs"):
            of[p] = DAMAGED
    for signs, kind in ((".!?。…！？", ENDING), (",;:、，；", COMMA), ("|│¦", PIPE), ("\t", TAB), ("\n", NEWLINE), ("\r", BLANK), ("�□¤¶", DAMAGED), ("#$%&*+<=>@[\\]^_`{}~§¬°/", SYMBOL), ("\xad​‍﻿", OTHER)):
        for s in signs:
            of[ord(s)] = kind
    return of


_tables: dict = {}


def tables() -> dict:
    if not _tables:
        _tables["class"] = _classes()
        fold = np.arange(0x110000, dtype=np.uint32)
        for p in range(0x250, 0x530):
            lower = chr(p).lower()
            if len(lower) == 1:
                fold[p] = ord(lower)
        for p in range(0x250):
            lower = chr(p).lower()
            if len(lower) == 1:
                fold[p] = ord(lower)
        _tables["fold"] = fold
        vowel = np.zeros(0x110000, dtype=bool)
        for p in range(0x530):
            if unicodedata.normalize("NFD", chr(p))[0].lower() in "aeiouyаеёиоуыэюяæœøіієї":
                vowel[p] = True
        _tables["vowel"] = vowel
        hashes = np.unique(word_hashes(" ".join(COMMON))[0])
        _tables["common"] = hashes
    return _tables


_P = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    have = _tables.get("powers")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, _P, dtype=np.uint64)
        p[0] = 1
        _tables["powers"] = have = np.multiply.accumulate(p)
    return have[:n]


def word_hashes(text: str | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, length) of each run of letters, letters in lower case."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if isinstance(text, str) else text
    of = tables()["class"] if "class" in _tables else _tables.setdefault("class", _classes())
    kind = of[points]
    letter = (kind == LOWER) | (kind == UPPER) | (kind == CJK)
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z
    fold = _tables.get("fold")
    low = fold[points] if fold is not None else np.array([ord(chr(p).lower()[0]) for p in points], dtype=np.uint32)
    lengths = end - start
    # position within the word, so that a word's hash doesn't depend on its place
    offset = np.arange(len(points)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(points)]])))
    offset = np.minimum(np.where(letter, offset, 0), 4095)
    term = np.where(letter, (low.astype(np.uint64) + np.uint64(1)) * _powers(4096)[offset], np.uint64(0))
    total = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
    h = total[end] - total[start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, start, lengths


NAMES = (
    ["log_n"]
    + [f"share_{k}" for k in ("lower", "upper", "cjk", "digit", "blank", "ending", "comma", "pipe", "tab", "mark", "symbol", "damaged", "dash", "semicolon", "colon", "slash", "vowel", "common", "mojibake", "run", "gap", "initial")]
    + ["word_length", "longest_word", "words_a_line", "ends", "item", "dots", "letters_a_word_lone"]
)
WIDTH = len(NAMES)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, document, characters) of each line that isn't blank: its own, its block's, its document's statistics, and evenness."""
    t = tables()
    joined = "\n\x00\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = t["class"][points]
    newline = kind == NEWLINE
    ends = np.flatnonzero(newline)
    starts = np.concatenate([[0], ends[:-1] + 1])
    kind = np.where(points == 0, BLANK, kind)
    n = len(starts)

    def lines(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (total[ends] - total[starts]).astype(np.float32)

    separator = points[starts] == 0
    ink = lines((kind != BLANK) & (kind != TAB) & ~newline)
    blank_line = ink == 0
    doc = np.cumsum(separator)
    keep = ~blank_line & ~separator
    # blocks: runs of lines that aren't blank
    block = np.cumsum(blank_line | separator)

    prev = np.concatenate([[0], points[:-1]])
    nxt = np.concatenate([points[1:], [0]])
    space = (kind == BLANK) | (kind == TAB)
    pspace, nspace = np.concatenate([[True], space[:-1] | newline[:-1]]), np.concatenate([space[1:] | newline[1:], [True]])
    letter = (kind == LOWER) | (kind == UPPER) | (kind == CJK)
    h, ws, wl = word_hashes(points)
    line_of = np.searchsorted(ends, ws)
    words = np.bincount(line_of, minlength=n).astype(np.float32)
    at = np.searchsorted(t["common"], h)
    at[at == len(t["common"])] = 0
    common = np.bincount(line_of, t["common"][at] == h, minlength=n).astype(np.float32)
    longest = np.zeros(n, dtype=np.float32)
    np.maximum.at(longest, line_of, wl)
    lone = np.bincount(line_of, wl == 1, minlength=n).astype(np.float32)
    initial = np.bincount(line_of, kind[ws] == UPPER, minlength=n).astype(np.float32)

    counts = {
        "lower": lines(kind == LOWER), "upper": lines(kind == UPPER), "cjk": lines(kind == CJK), "digit": lines(kind == DIGIT),
        "blank": lines(kind == BLANK), "ending": lines(kind == ENDING), "comma": lines(kind == COMMA), "pipe": lines(kind == PIPE),
        "tab": lines(kind == TAB), "mark": lines(kind == MARK), "symbol": lines(kind == SYMBOL), "damaged": lines(kind == DAMAGED),
        "dash": lines((points == 0x2D) | (points == 0x5F) | (points == 0x3D)), "semicolon": lines(points == 0x3B), "colon": lines((points == 0x3A) & nspace),
        "slash": lines(points == 0x2F), "vowel": lines(t["vowel"][points]),
        "mojibake": lines((points >= 0xC0) & (points <= 0xFF) & (((nxt >= 0x80) & (nxt <= 0xBF)) | (nxt == 0xFFFD)) | (points == 0xFFFD)),
        "run": lines((points == prev) & ~space & ~newline & (points != 0)),
        "gap": lines((kind == BLANK) & np.concatenate([[False], (kind == BLANK)[:-1]]) & ~nspace),
    }
    # dotted leaders and rules: the same sign four times
    four = np.zeros(len(points), dtype=bool)
    four[3:] = (points[3:] == points[2:-1]) & (points[2:-1] == points[1:-2]) & (points[1:-2] == points[:-3])
    dots = (lines(four & ((kind == ENDING) | (kind == MARK) | (kind == SYMBOL))) > 0).astype(np.float32)
    length = (ends - starts).astype(np.float32)

    # first and last sign of each line
    inked = np.flatnonzero(~space & ~newline & (points != 0))
    if len(inked):
        f = np.minimum(np.searchsorted(inked, starts), len(inked) - 1)
        first = inked[f]
        la = np.maximum(np.searchsorted(inked, ends) - 1, 0)
        last = inked[la]
    else:
        first = last = starts
    lastk, lastp = kind[last], points[last]
    quoted = np.isin(lastp, [0x22, 0x27, 0x201D, 0x201C, 0x29, 0xBB])
    before = kind[np.maximum(last - 1, 0)]
    closes = ((lastk == ENDING) | (quoted & (before == ENDING))) & (dots == 0)
    fk, fp = kind[first], points[first]
    second = np.minimum(first + 1, len(points) - 1)
    third, fourth = np.minimum(first + 2, len(points) - 1), np.minimum(first + 3, len(points) - 1)
    bullet = (np.isin(fp, [0x2D, 0x2B, 0x2A, 0x2022, 0x2013, 0x2014, 0xB7, 0x25AA, 0x25CF, 0x6F, 0x5B]) & (space[second] | (fp == 0x5B)))
    closing = np.isin(points, [0x2E, 0x29])
    number = (fk == DIGIT) & (closing[second] | (closing[third] & (kind[second] == DIGIT)) | (closing[fourth] & (kind[second] == DIGIT) & (kind[third] == DIGIT)))
    lettered = ((fk == UPPER) | (fk == LOWER)) & ((kind[second] == TAB) | closing[second])
    bracketed = (fp == 0x28) & closing[third]
    item = (bullet | number | lettered | bracketed).astype(np.float32)

    def assemble(group: np.ndarray | None) -> np.ndarray:
        if group is None:
            up = lambda v: v
            back = slice(None)
            count = np.ones(n, dtype=np.float32)
            top = longest
        else:
            m = int(group[-1]) + 1
            up = lambda v: np.bincount(group, np.where(keep, v, 0), minlength=m).astype(np.float32)
            back = group
            count = np.maximum(np.bincount(group, keep, minlength=m), 1).astype(np.float32)
            top = np.zeros(m, dtype=np.float32)
            np.maximum.at(top, group[keep], longest[keep])
        size = np.maximum(up(length), 1)
        w = np.maximum(up(words), 1)
        c = {k: up(v) for k, v in counts.items()}
        letters = np.maximum(c["lower"] + c["upper"], 1)
        cols = [np.log1p(size)]
        for k in ("lower", "upper", "cjk", "digit", "blank", "ending", "comma", "pipe", "tab", "mark", "symbol", "damaged", "dash", "semicolon", "colon", "slash"):
            cols.append(c[k] / size)
        cols += [np.minimum(c["vowel"] / letters, 1), up(common) / w, c["mojibake"] / size, c["run"] / size, c["gap"] / size, up(initial) / w]
        cols += [(letters + c["cjk"]) / w, np.minimum(top, 200), up(words) / count, up(closes) / count, up(item) / count, up(dots) / count, up(lone) / w]
        return np.column_stack(cols).astype(np.float32)[back]

    own, blocks, docs = assemble(None), assemble(block), assemble(doc)
    m = int(doc[-1]) + 1 if n else 1
    size = np.maximum(np.bincount(doc, keep, minlength=m), 1)
    extra = []
    for v in (counts["pipe"], counts["tab"], counts["semicolon"], counts["comma"] - counts["semicolon"] - counts["colon"], counts["gap"]):
        mean = np.bincount(doc, np.where(keep, v, 0), minlength=m) / size
        var = np.maximum(np.bincount(doc, np.where(keep, v * v, 0), minlength=m) / size - mean**2, 0)
        some = np.bincount(doc, keep & (v > 0), minlength=m) / size
        extra += [mean[doc], (np.sqrt(var) / (mean + 0.1))[doc], some[doc]]
    extra.append(np.log1p(size)[doc])
    bm = int(block[-1]) + 1 if n else 1
    extra.append(np.log1p(np.bincount(block, keep, minlength=bm))[block])
    x = np.column_stack([own, blocks, docs, *extra]).astype(np.float32)[keep]
    return x, doc[keep], ink[keep]


ALL_NAMES = [f"{level}_{k}" for level in ("line", "block", "doc") for k in NAMES] + [f"{s}_{k}" for s in ("pipe", "tab", "semicolon", "comma", "gap") for k in ("mean", "uneven", "some")] + ["lines", "block_lines"]
