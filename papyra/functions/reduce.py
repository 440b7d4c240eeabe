"""Token reduction beyond stop words, and the parts of it that need whole documents: Python over Arrow batches.

Levels: off, light, moderate, aggressive, maximum; an unknown one is moderate. Code in backticks and fences is kept as
it is from moderate on. Aggressive thins out common words and keeps the best sentences; with semantic scoring it also
drops words of low score, and maximum replaces or cuts words by their class. Sizes of words are in UTF-8 bytes where
the scores say so.

Results: null stays null; a text of fewer than four words isn't thinned; at least one sentence and one word stay.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LEVELS = ("off", "light", "moderate", "aggressive", "maximum")
_FENCE = re.compile(r"```.*?```", re.S)
_INLINE = re.compile(r"`[^`\n]+`")

# Weights of the sentence score.
EDGE, IDEAL, IDEAL_WORDS, NUMERIC, CAPS, LONG, LONG_BYTES, PUNCTUATION, DIVERSITY, ENTROPY = 0.3, 0.2, (3, 25), 0.3, 0.25, 0.2, 8, 0.15, 0.15, 0.1
# Scores of words by themselves, and words of a wider sense.
WEIGHTS = {"result": 0.8, "conclusion": 0.8, "important": 0.7, "significant": 0.7, "analysis": 0.7, "method": 0.6, "data": 0.6, "system": 0.6, "performance": 0.6, "improvement": 0.6, "process": 0.5, "algorithm": 0.5, "function": 0.5, "model": 0.5, "implementation": 0.5}
HYPERNYMS = {"car": "vehicle", "dog": "animal", "apple": "fruit", "chair": "furniture", "book": "publication", "computer": "device", "algorithm": "method", "implementation": "approach", "optimization": "improvement", "analysis": "study"}
# Fixed value: characters of Chinese words that carry meaning.
RADICALS = frozenset("学智能技术法算理科研究发展系统模型方式过程结构功效应分析计数据信息处语言文生成产用作为变化转换提高网络神经机器人工自然复")
# Fixed value: ASCII punctuation.
MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def collapse(text: str, each: bool = False) -> str:
    """Of a run of ! ? . , the first stays; with `each`, only repeats of one and the same ! ? or , are dropped."""
    return re.sub(r"([!?,])\1+", r"\1", text) if each else re.sub(r"([!?.,])[!?.,]+", r"\1", text)


def light(text: str, each: bool = False) -> str:
    text = re.sub(r"<!--.*?-->", "", collapse(text, each))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" {2,}", " ", text)).strip()


def older_light(text: str) -> str:
    """The older profile: repeats of one mark, comments over several lines, marks that trail after spaces join the word."""
    text = re.sub(r"<!--.*?-->", "", re.sub(r"([!?.,;:])\1+", r"\1", text), flags=re.S)
    text = re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+([!?.,;:])(?=\s|$)", r"\1", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def parts(word: str) -> tuple[str, str, str]:
    """A word's marks before, its core from the first to the last letter or digit, and its marks after."""
    m = re.match(r"([^\w]|_)*", word)
    a = m.end()
    b = len(word)
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[:a], word[a:b], word[b:]


def _core(w: str) -> str:
    return "".join(c for c in w if c.isalpha()).lower()


def keeps(w: str, stop: set[str], patterns: tuple[re.Pattern, ...] = ()) -> bool:
    """Whether a word stays: of a pattern to keep, all capitals or no letters, with a digit, of one byte, or no stop word."""
    if any(p.search(w) for p in patterns):
        return True
    if len(w.encode()) > 1 and re.fullmatch(r"[^a-z\x80-\U0010ffff]+", w) or re.search(r"[0-9]", w):
        return True
    core = _core(w)
    return len(core.encode()) <= 1 or core not in stop


def moderate(text: str, stop: set[str], markdown: bool = False, code: bool = True, patterns: tuple[re.Pattern, ...] = ()) -> str:
    """Stop words out; code kept; with `markdown`, headings, items and table rows are kept as whole lines."""
    saved: list[str] = []

    def hide(m: re.Match) -> str:
        saved.append(m.group())
        return f"\x00{len(saved) - 1}\x00"

    text = light(text)
    if code:
        text = _INLINE.sub(hide, _FENCE.sub(hide, text))
    drop = lambda t: " ".join(w for w in t.split() if keeps(w, stop, patterns))
    if markdown:
        out = "\n".join(x if re.match(r"#{1,6}\s|[ \t]*[-*+]\s|\s*\|.*\|\s*$", x) else drop(x) for x in text.split("\n"))
    else:
        out = drop(text)
    while "\x00" in out and saved:
        again = re.sub("\x00(\\d+)\x00", lambda m: saved[int(m.group(1))], out)
        if again == out:
            break
        out = again
    return out


def has_cjk(text: str) -> bool:
    return any("一" <= c <= "鿿" for c in text)


def tokens(text: str) -> list[str]:
    """Words between white space; one with Chinese characters in pieces of two characters."""
    out: list[str] = []
    for w in text.split():
        out += [w[i : i + 2] for i in range(0, len(w), 2)] if has_cjk(w) else [w]
    return out


def _important(w: str) -> bool:
    size, upper = len(w.encode()), sum(map(str.isupper, w))
    if size > 1 and upper == len(w) or any(map(str.isnumeric, w)) or size > 10 or 1 < upper < size:
        return True
    if not has_cjk(w):
        return False
    return any(c in RADICALS for c in w) or len(w) == 2 and any(0x4E00 <= ord(c) <= 0x51FF or 0x6700 <= ord(c) <= 0x68FF or 0x7500 <= ord(c) <= 0x76FF for c in w)


def thin(text: str) -> str:
    """Words stay that are important, rare and not short, or long; where fewer than a third would, those of three letters."""
    words = tokens(text)
    if len(words) < 4:
        return text
    cores = [_core(w) for w in words]
    freq = Counter(c for c in cores if c)
    mean = sum(len(c) for c in cores if c) / sum(freq.values()) if freq else 5.0
    cjk = has_cjk(text)
    kept = [w for w, c in zip(words, cores) if not c or _important(w) or freq[c] <= 2 and len(c) >= 0.8 * mean or len(c) >= 1.5 * mean]
    if len(kept) < len(words) // (5 if cjk else 3):
        kept = [w for w, c in zip(words, cores) if not c or len(c) >= 3 or _important(w)]
    return ("" if cjk else " ").join(kept)


def entropy(text: str) -> float:
    counts = Counter(text.lower())
    n = sum(counts.values())
    return min(5.0, -sum(v / n * math.log2(v / n) for v in counts.values())) if n else 0.0


def sentence_score(s: str, at: int, n: int) -> float:
    score = EDGE * (at in (0, n - 1))
    words = s.split()
    if not words:
        return score
    k = len(words)
    score += IDEAL * (IDEAL_WORDS[0] <= k <= IDEAL_WORDS[1])
    share = lambda f: sum(map(f, words)) / k
    score += NUMERIC * share(lambda w: any(map(str.isnumeric, w)))
    score += CAPS * share(lambda w: len(w.encode()) > 1 and all(map(str.isupper, w)))
    score += LONG * share(lambda w: len(w.encode()) > LONG_BYTES)
    score += PUNCTUATION * sum(c in MARKS for w in words for c in w) / len(s.encode())
    # different words count up to three fifths of all; once that many are met, no more are looked for
    unique, most = set(), math.ceil(0.6 * k)
    for w in words:
        unique.add(_core(w))
        if len(unique) >= most:
            break
    return score + DIVERSITY * len(unique) / k + ENTROPY * entropy(s)


def select_sentences(text: str, share: float = 0.4) -> str:
    """The best sentences, two fifths and at least one, in their order; one or two sentences stay as they are."""
    found = [s.strip() for s in re.split(r"[.!?]", text)]
    found = [s for s in found if s]
    n = len(found)
    if n <= 2:
        return text
    best = sorted(range(n), key=lambda i: (-sentence_score(found[i], i, n), i))[: max(1, math.ceil(share * n))]
    return ". ".join(found[i] for i in sorted(best))


def _bare(w: str) -> str:
    return "".join(c for c in w if c.isalnum()).lower()


def technical(w: str) -> bool:
    return len(w.encode()) > 6 and ("_" in w or sum(map(str.isupper, w)) > 1 or w.endswith(("tion", "ment", "ing")))


def word_scores(words: list[str]) -> list[float]:
    """Of each word its own weight, what its neighbours add, and the logarithm of its share of the text."""
    n = len(words)
    bare = [_bare(w) for w in words]
    count = Counter(bare)

    def own(w: str) -> float:
        if w in WEIGHTS:
            return WEIGHTS[w]
        return min(1.0, 0.3 + min(0.2, 0.02 * len(w.encode())) + 0.2 * w[:1].isupper() + 0.15 * any(map(str.isnumeric, w)) + 0.25 * technical(w))

    def near(i: int) -> float:
        add = 0.1 * (i in (0, n - 1))
        for c in words[max(0, i - 2) : i + 3]:
            if c != bare[i]:
                add += 0.05 if technical(bare[i]) and technical(c) else 0.02 * c[:1].isupper()
        return min(0.3, add)

    return [own(b) + near(i) + (math.log(count[b] / n) + 1) * 0.1 for i, b in enumerate(bare)]


def semantic(text: str, threshold: float = 0.3) -> str:
    """The words whose score reaches the threshold."""
    words = text.split()
    return " ".join(w for w, s in zip(words, word_scores(words)) if s >= threshold)


def compress(text: str, target: float | None = None) -> str:
    """Words of low score by a wider one; with a target share to drop, only the words of the highest scores stay, in order."""
    words = text.split()
    scores = word_scores(words)
    if target is None:
        return " ".join(HYPERNYMS.get(_bare(w), w) if s < 0.5 else w for w, s in zip(words, scores))
    most = max(1, int((1 - target) * len(words)))
    best = sorted(range(len(words)), key=lambda i: -scores[i])[:most]
    return " ".join(words[i] for i in sorted(best))


def reduce_text(text: str | None, level: str = "moderate", stop: set[str] = frozenset(), markdown: bool = False, code: bool = True, patterns: tuple[re.Pattern, ...] = (), scored: bool = False, threshold: float = 0.3, target: float | None = None) -> str | None:
    """A text at a level. `scored` turns the scores of words on, which maximum then compresses by `target`."""
    if text is None:
        return None
    text = nfc(text)
    level = level.lower() if level.lower() in LEVELS else "moderate"
    if level == "off":
        return text
    if level == "light":
        return light(text)
    out = moderate(text, stop, markdown, code, patterns)
    if level == "moderate":
        return out
    out = select_sentences(thin(out))
    if scored:
        out = semantic(out, threshold)
        if level == "maximum":
            out = compress(out, target)
    return out


def reduce(df: DataFrame, key: str, text: str, stop: str, level: str = "aggressive", **options) -> DataFrame:
    """(key, reduced, chars, chars_left, tokens, tokens_left); options are those of reduce_text."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [reduce_text(t, level, set(s or []), **options) for t, s in zip(texts, batch.column(2).to_pylist())]
            num = lambda f, xs: pa.array([None if x is None else f(x) for x in xs], pa.int64())
            count = lambda x: len(x.split())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), num(len, texts), num(len, out), num(count, texts), num(count, out)], [key, "reduced", "chars", "chars_left", "tokens", "tokens_left"])

    return df.select(key, text, stop).mapInArrow(run, f"`{key}` {kind}, reduced string, chars bigint, chars_left bigint, tokens bigint, tokens_left bigint")
