"""Encoding against the tokenizer library; mixing shares; splitting of oversized texts."""

import os
import random

import pytest

from papyra.llm import mixing, split
from papyra.llm import tokenise as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.TOKENIZER_PATH), reason="no vocabulary here")

ODD = ["", " ", "\n", "a", "a  b", " a", "a ", "a \n b\n\nc", "it's we'll", "x²+½ ⅷ", "<|endoftext|>", "a\x1cb", "日本語のテキスト。", "​﻿", "0" * 5000, "ab" * 4000, "_a__b_", "é́", "퟿", "tab\tx \t y", "🙂🙂 ok", "A" * 70 + " b"]


def library():
    import tiktoken

    with open(T.TOKENIZER_PATH, "rb") as f:
        return tiktoken.Encoding("x", pat_str=T.SPLIT, mergeable_ranks=T.read_ranks(f.read()), special_tokens={})


def test_words_join_to_the_text():
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice("ab1 \n\t.'_é²中　") for _ in range(rng.randrange(30)))
        assert "".join(T.words_of(t)) == t == "".join(T.pieces_of(t))
        import regex

        assert T.words_of(t) == regex.findall(T.SPLIT, t)
        assert [w for p in T.pieces_of(t) for w in T.words_of(p)] == T.words_of(t)


def test_automaton_is_exact_and_shares_suffixes():
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 8))) for _ in range(900)}
    a = T.Automaton.compile({w: list(range(len(w))) for w in words})
    order = sorted(words)
    probe = order + [b"", b"d", b"abcabcabcabc", b"a" * 9]
    got = a.ranks(probe)
    assert got[: len(order)].tolist() == list(range(len(order)))
    assert [r for w, r in zip(probe, got) if w not in words] == [-1] * sum(w not in words for w in probe)
    assert len(a.keys) < sum(map(len, words))  # fewer arcs than letters: prefixes and suffixes are shared
    assert T.Automaton.compile({}).ranks([b"x"]).tolist() == [-1]


def test_encode_equals_library(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, None])] + [(0, "")]
    got = T.encode(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    own = library()
    assert len(got) == len(rows)
    for r in got:
        t = dict(rows)[r.doc_id]
        assert r.ids == (own.encode_ordinary(t) if t else [])
    assert T.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    counts = {r.doc_id: r.n_tokens for r in T.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(counts[r.doc_id] == len(r.ids) for r in got)


def test_poisson_inverse():
    assert mixing._cdf(0.0, 2) == [1.0, 1.0] and 0.36 < mixing._cdf(1.0, 1)[0] < 0.37


def test_mix_reaches_shares(spark):
    rows = [(i, "word " * (20 + i % 7), ["Big-Source", "small", None, "other"][0 if i % 10 else (i // 10) % 4]) for i in range(3000)]
    docs = spark.createDataFrame([*rows, rows[0], (9999, None, "small"), (9998, "", "small")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big_source", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.shares(docs, targets).collect()}
    assert abs(got["big_source"].actual_share - 2 / 3) < 0.01 and abs(got["small"].actual_share - 1 / 3) < 0.01 and got["absent"].actual_share == 0
    m = mixing.mix(docs, targets).collect()
    uses = {}
    for r in m:
        uses[(r.source, r.doc_id)] = uses.get((r.source, r.doc_id), 0) + 1
    assert max(n for (s, _), n in uses.items() if s == "small") <= 4 and max(n for (s, _), n in uses.items() if s == "big_source") == 1
    assert [r.shuffle_key for r in m] == sorted(r.shuffle_key for r in m)
    assert sum(r.n_tokens for r in m) == sum(r.selected_tokens for r in got.values())
    assert mixing.mix(docs.limit(0), targets).count() == 0


CUTS = [("a " * 300 + "\n\n" + "b " * 300, "paragraph"), ("a " * 300 + "\n" + "b " * 300, "line"), ("a " * 300 + ". " + "b " * 300, "sentence"), ("a " * 700, "word"), ("a" * 1001, "character"), ("あ" * 600 + "。" + "い" * 600, "sentence"),
        ("x" * 1000 + "　" * 50, "paragraph"), ("a" * 600 + "\n \t\n" + "b" * 600, "paragraph"), ("a" * 600 + "\r\n\r\n" + "b" * 600, "paragraph"), ("a" * 600 + "\x1c" + "b" * 600, "character")]


@pytest.mark.parametrize("text,want", CUTS)
def test_cut_level(text, want):
    assert split.cut_level(text) == want


def test_pieces_hold_their_contract():
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice(["word ", "other ", "end. ", "\n", "\n\n", "longer", "é", "。"]) for _ in range(rng.randrange(150, 900)))
        if len(text) <= 1000:
            continue
        spans = split.pieces(text)
        assert all(0 < b - a <= 1000 for a, b in spans) and all(text[a:b] == text[a:b].strip(split.WHITE) for a, b in spans)
        assert all(c[0] > a[0] for a, c in zip(spans, spans[1:]))
        covered = [False] * len(text)
        for a, b in spans:
            covered[a:b] = [True] * (b - a)
        assert all(covered[i] or text[i] in split.WHITE for i in range(len(text)))
        assert all(a[1] - c[0] <= 200 for a, c in zip(spans, spans[1:]))


def test_split_frame(spark):
    long = "Ein Satz über Äpfel. " * 90
    rows = [(1, long, 5), (1, long, 5), (2, None, 1), (3, "", 1), (4, "short", 1), (None, "x" * 2500, 1)]
    got = split.split_oversized(spark.createDataFrame(rows, "chunk_id bigint, content string, piece_no int")).collect()
    assert {r.chunk_id for r in got} == {1, None}
    for r in got:
        src = long if r.chunk_id == 1 else "x" * 2500
        assert src.encode()[r.byte_start : r.byte_end].decode() == r.content == src[r.char_start : r.char_end]
        assert r.token_count == len(library().encode_ordinary(r.content))
    assert split.split_oversized(spark.createDataFrame([], "chunk_id bigint, content string")).count() == 0


def test_caps_of_any_size_and_policies(spark):
    docs = spark.createDataFrame([(i, "word " * 11, "a") for i in range(50)] + [(100 + i, "word " * 11, "b") for i in range(1000)], "doc_id bigint, text string, source string")
    one = spark.createDataFrame([("a", 1.0, 200)], "source string, target_share double, max_repeats int")
    got = mixing.shares(docs, one).first()
    assert got.at_cap and got.selected_tokens == 200 * got.source_tokens and got.shortfall == 0 and got.actual_share == 1.0
    both = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    shared = {r.source: r for r in mixing.shares(docs, both).collect()}
    assert abs(shared["a"].actual_share - 0.5) < 0.01 and shared["b"].selected_tokens < shared["b"].source_tokens
    kept = {r.source: r for r in mixing.shares(docs, both, policy="total").collect()}
    assert kept["a"].at_cap and kept["a"].shortfall > 0 and kept["b"].selected_tokens > 0.45 * sum(r.source_tokens for r in kept.values())
    assert mixing._cdf(float("inf"), 3) == [0.0] * 3 and mixing._cdf(900.0, 1000)[800] < 0.01


def test_fills_come_close_with_few_documents(spark):
    import random as r

    rng = r.Random(3)
    docs = spark.createDataFrame([(i, "word " * rng.choice((3, 7, 20, 90)), "ab"[i % 2]) for i in range(60)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.7, 3)], "source string, target_share double, max_repeats int")
    got = {x.source: x for x in mixing.shares(docs, targets).collect()}
    assert abs(got["a"].actual_share - 0.3) < 0.005 and all(x.shortfall <= 8 for x in got.values())


def test_lexicon_is_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", 2 + i % 50) for i in range(3000)], "word string, n bigint")
    for most in (0, 10, 500, 5000):
        assert T.most_frequent(counts, most).count() <= most
    assert T.most_frequent(counts, 5000).count() == 3000 and T.most_frequent(counts, 500).agg({"n": "min"}).first()[0] > 40


def test_split_is_linear():
    import time

    def took(n):
        text = "One sentence of some words stands here. " * n
        t = time.process_time()
        split.pieces(text)
        return time.process_time() - t

    took(500)
    assert took(8000) < 24 * max(took(1000), 0.01)


def test_split_costs_little_more_than_reading_the_words():
    import re
    import time

    rng = random.Random(5)
    text = " ".join(rng.choice(["paper", "river", "stone", "light", "Ämter", "year"]) for _ in range(60_000))

    def least(f):
        times = []
        for _ in range(3):
            t = time.process_time()
            f()
            times.append(time.process_time() - t)
        return min(times)

    words = least(lambda: [(m.group().lower(), m.start()) for m in re.finditer(r"[^\W_]+", text)])
    assert least(lambda: split.pieces(text)) < 8 * words


def test_groups_of_texts_equal_their_definitions(monkeypatch):
    """Boundaries by patterns, similarity by counting words, each text on its own."""
    import re
    from bisect import bisect_left
    from collections import Counter

    monkeypatch.setattr(split, "GROUP", 3000)
    w = re.escape(split.WHITE)
    patterns = [rf"\n(?=[{w}]*\n)[{w}]*\n|^[{w}]*\n|\n[{w}]*$", "\n", rf"(?<=[.!?])(?=[{w}])|(?<=。)", f"[{w}]+"]
    rng = random.Random(6)
    signs = ["word ", "Other ", "End. ", "\n", "\n \n", "\r\n", "longer", "É", "。", "あい", "漢字漢字漢字語", "　", "\x85", "x_y", "!", "Σ", "ΑΣ ", "İ", "漢İ漢字", "\0", "😀", "ǅ ", " " * 120]
    texts = ["", " ", "\n", "\n\n", "Σ", "İa b"]
    for _ in range(60):
        own = rng.sample(signs, rng.randrange(2, 9))
        texts.append("".join(rng.choice(own) for _ in range(rng.randrange(1, 250))))
    texts.append("")
    seen = []
    for start, group in split.grouped(texts):
        for k, text in enumerate(group.texts):
            assert text == texts[start + k]
            seen.append(start + k)
            assert list(group.own_places[k]) == [sorted({m.end() for m in re.finditer(p, text)} - {0, len(text)}) for p in patterns]
            words = []
            for m in re.finditer(r"[^\W_]+", text):
                x = m.group().lower()
                words += [(x[i : i + 2], m.start() + i) for i in range(0, len(x) - 1, 2)] if len(x) > 3 and ord(x[0]) >= 0x3040 else [(x, m.start())]
            cohesion = group.cohesion(k)
            for place in group.own_places[k][3]:
                i = bisect_left(words, place, key=lambda x: x[1])
                a, b = (Counter(x for x, _ in part) for part in (words[max(0, i - split.BLOCK) : i], words[i : i + split.BLOCK]))
                norm = (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5
                assert cohesion.similarity(place) == (sum(n * b[x] for x, n in a.items()) / norm if norm else 0.0)
            places = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(20))})
            assert group.byte_places(k, places) == [len(text[:p].encode()) for p in places]
    assert seen == list(range(len(texts)))


@pytest.mark.parametrize("words,gap", [(60, 2000), (45, 900), (10, 1500)])
def test_short_pieces_before_much_white_space_end(words, gap):
    import signal

    def late(*_):
        raise TimeoutError

    signal.signal(signal.SIGALRM, late)
    signal.alarm(20)
    try:
        text = ("ab " * words + " " * gap) * 4
        spans = split.pieces(text)
    finally:
        signal.alarm(0)
    assert all(c[0] > a[0] for a, c in zip(spans, spans[1:])) and all(0 < b - a <= 1000 for a, b in spans)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered for i, x in enumerate(text) if x != " ")
