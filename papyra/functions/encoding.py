"""Text of bytes whose encoding isn't known: by label, byte-order mark, UTF-8, then the legacy encoding that reads best."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Encodings tried where the likeliest leaves errors, in order, and the confidence one of them needs.
ATTEMPTS, ENOUGH = ("cp1255", "iso8859-8", "cp1256", "iso8859-6", "cp1252", "cp1251"), 0.5
#: Encodings among which the likeliest is chosen: name, and the ranges of its letters beyond ASCII.
CANDIDATES = {
    "cp1252": "À-ÖØ-öø-ÿŒœŠšŽžŸ€„“”’", "cp1250": "ĄąĆćĘęŁłŃńÓóŚśŹźŻżČčĎďĚěŇňŘřŠšŤťŮůŽžŐőŰűÄäÖöÜüßÁáÉéÍíÝý", "cp1251": "А-яЁёЂ-џҐґ", "koi8-r": "А-яЁё", "cp1253": "Ά-ώ", "cp1254": "ĞğİıŞşÇçÖöÜü", "cp1255": "א-ת", "cp1256": "ء-ي", "shift_jis": "ぁ-んァ-ヶ一-龠", "euc_jp": "ぁ-んァ-ヶ一-龠", "gb18030": "一-龠", "big5": "一-龠", "euc_kr": "가-힣",
}
LATIN = ("cp1252", "cp1250", "cp1254")
# The most frequent signs of texts in encodings that share their code space.
COMMON = {"cp1251": frozenset("оеаинтсрОЕАИНТСР"), "koi8-r": frozenset("оеаинтсрОЕАИНТСР"), "cp1255": frozenset("יוהלאתרמשםב"), "gb18030": frozenset("的一是了我不在人们有来他这上着个地到大里说就去子得也和那要下看天时过出小么起你都把好还多没为又可家学只以主会样年想生同老"), "big5": frozenset("的一是了我不在人們有來他這上著個地到大裡說就去子得也和那要下看天時過出小麼起你都把好還多沒為又可家學只以主會"), "shift_jis": frozenset("のをにはがでとるすましたてい。、"), "euc_jp": frozenset("のをにはがでとるすましたてい。、")}
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_LETTER = {name: re.compile(f"[{signs}]") for name, signs in CANDIDATES.items()}
_WORDS = re.compile(r"[^\W\d_]+")


def confidence(text: str) -> float:
    """Share of readable signs, less what damaged ones cost."""
    size = len(text.encode("utf-8", "replace"))
    if not size:
        return 0.0
    readable = sum(c.isspace() or "!" <= c <= "~" for c in text)
    damage = len(re.findall("�+", text)) + 2 * len(_CONTROL.findall(text))
    cyrillic = sum(len(m.encode()) for m in re.findall("[Ѐ-ӿ]{3,}", text))
    return max(0.0, min(1.0, (readable - damage) / size - (0.3 if cyrillic > 0.1 * size else 0.0)))


def repair(text: str) -> str:
    """Without control characters, replacement characters and loose combining marks."""
    return re.sub("[̀-ͯ]+", "", re.sub("�+", "", _CONTROL.sub("", text)))


def _plausible(text: str, name: str) -> float:
    """How well a decoded text fits an encoding: its own letters, in words of one script and of usual case."""
    high = [c for c in text if ord(c) > 127]
    if not high:
        return 1.0
    own = len(_LETTER[name].findall(text)) / len(high)
    words = [w for w in _WORDS.findall(text) if any(ord(c) > 127 for c in w)]
    odd = sum(1 for w in words if not (w.islower() or w.isupper() or w.istitle()) and any(map(str.islower, w)) and any(map(str.isupper, w)))
    mixed = sum(1 for w in words if any(c.isascii() for c in w) and name in ("cp1251", "koi8-r", "cp1253", "cp1255", "cp1256"))
    letters = sum(map(str.isalpha, high)) / len(high)
    if name in LATIN:  # in a Latin text most letters of a word are plain
        foreign = sum(1 for w in words if sum(ord(c) > 127 for c in w) > 0.6 * len(w) and len(w) > 2)
        own -= 1.5 * foreign / max(1, len(words))
    if name in COMMON:
        own += sum(c in COMMON[name] for c in high) / len(high)
    return own + 0.5 * letters - (odd + mixed) / max(1, len(words)) - 0.5 * len(_CONTROL.findall(text)) / len(high)


def guess(data: bytes) -> str:
    """The likeliest encoding of bytes that aren't UTF-8."""
    best, found = -9.0, "cp1252"
    for name in CANDIDATES:
        try:
            score = _plausible(data.decode(name), name)
        except (UnicodeDecodeError, LookupError):
            continue
        if score > best + 1e-9:
            best, found = score, name
    return found


def safe_decode(data: bytes | None, label: str | None = None) -> str | None:
    """The text of bytes; never fails. A label that is known wins; empty bytes give the empty text, null stays null."""
    if data is None or not data:
        return None if data is None else ""
    if label:
        try:
            return repair(data.decode(label, "replace"))
        except LookupError:
            pass
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return repair(data.decode(name, "replace"))
    try:
        return repair(data.decode("utf-8"))
    except UnicodeDecodeError:
        pass
    try:
        return repair(data.decode(guess(data)))
    except UnicodeDecodeError:
        pass
    for name in ATTEMPTS:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if confidence(text) > ENOUGH:
            return repair(text)
    return repair(data.decode("cp1252", "replace"))


@pandas_udf(StringType())
def _decoded(data: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series([safe_decode(None if d is None else bytes(d), x) for d, x in zip(data, label)])


def decoded(data: Column, label: Column) -> Column:
    """safe_decode as a column."""
    return _decoded(data, label)


def is_boundary(data: bytes, at: int) -> bool:
    """Whether a place in UTF-8 bytes lies between characters."""
    return 0 <= at <= len(data) and (at == len(data) or data[at] & 0xC0 != 0x80)
