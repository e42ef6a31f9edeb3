"""Likeness of texts against the standard library, splitting and dealing against plain versions."""

import itertools
from difflib import SequenceMatcher

import numpy as np
from hypothesis import given, settings, strategies as st

from seglume.functions import parsing, similarity
from seglume.operators import align

TEXT = st.one_of(st.text("ab", max_size=120), st.text("abcdefg 的了好", max_size=120))


@given(TEXT, TEXT, st.integers(0, 3))
@settings(max_examples=300, deadline=None)
def test_ratio_is_the_library_s(a, b, cut):
    b = a[: len(a) // 2] + b[cut:] + a[len(a) // 2 + cut :]
    want = SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 0.0
    small, similarity.SMALL = similarity.SMALL, 0
    try:
        assert abs(similarity.ratio(a, b) - want) < 1e-12
    finally:
        similarity.SMALL = small


@given(st.lists(st.one_of(TEXT, st.text(max_size=12), st.sampled_from(("", "a" * 64, "ab" * 33))), min_size=4, max_size=8))
@settings(max_examples=200, deadline=None)
def test_ratios_of_many_pairs_are_the_library_s(texts):
    texts += [t[1:] + t[:1] for t in texts]
    i, j = np.divmod(np.arange(len(texts) ** 2), len(texts))
    want = [SequenceMatcher(None, texts[x], texts[y], autojunk=False).ratio() if texts[x] or texts[y] else 0.0 for x, y in zip(i, j)]
    assert similarity.ratios(texts, texts, i, j).tolist() == want
    assert similarity.ratios(texts, texts, i[:3], j[:3]).tolist() == want[:3]


@given(TEXT, TEXT)
@settings(max_examples=300, deadline=None)
def test_bound_is_a_bound(a, b):
    assert similarity.similarity_bound(a, b) >= similarity.piece_similarity(a, b) - 1e-12


def test_likeness_of_short_texts():
    assert similarity.piece_similarity("ab", "xabyz") == 0.82
    assert similarity.piece_similarity("abxx", "yyab") == 0.75
    assert similarity.piece_similarity("axb", "ayyb") == 0.68
    assert similarity.piece_similarity("", "a") == similarity.piece_similarity(None, None) == 0.0
    assert similarity.short_match("好", "好吧") and not similarity.short_match("的", "了")
    assert not similarity.short_match("天气好", "好", "天气好啊")


@given(st.lists(st.sampled_from("aa bb, cc. d! e; f— gg".split()), max_size=9), st.lists(st.sampled_from((0.5, 1.0, 2.0)), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_demerge_is_the_cheapest_partition(parts, durations):
    text = " ".join(parts)
    chunks, n = parsing.text_chunks(text), len(durations)
    got = parsing.demerge(text, durations)
    assert len(got) == n and " ".join(x for x in got if x) == " ".join(c for c, _ in chunks)
    if len(chunks) <= n:
        return

    def cost(cuts):
        total, words = 0.0, [len(c.split()) for c, _ in chunks]
        for d, (a, b) in zip(durations, itertools.pairwise((0, *cuts, len(chunks)))):
            want = d / sum(durations) * sum(words)
            total += 10 * ((sum(words[a:b]) - want) / max(1.0, want)) ** 2 + sum(parsing.OVER_MARK[level] for _, level in chunks[a : b - 1])
        return total

    every = list(itertools.combinations(range(1, len(chunks)), n - 1))
    own = next(c for c in every if [" ".join(x for x, _ in chunks[a:b]) for a, b in itertools.pairwise((0, *c, len(chunks)))] == got)
    assert cost(own) <= min(map(cost, every)) + 1e-6


def test_sentences():
    split = parsing.split_sentences
    assert split("Gặp Mr. An lúc 3.14 giờ, v.v. rồi. Xong!") == ["Gặp Mr. An lúc 3.14 giờ, v.v. rồi .", "Xong !"]
    assert split("Trần... Trần ca. Ừ…") == ["Trần ... Trần ca .", "Ừ …"]
    assert split("a b c, d e f; g", max_words=4, max_chars=20) == ["a b c ,", "d e f ;", "g"]
    assert split("a b c d e f g h", 3, 100, hard=True) == ["a b c", "d e f", "g h"]
    assert split(None) == split(" .,! ") == []


def test_items_take_their_sources():
    texts = [f"đây là câu số {i} của một truyện dài và câu này nói về {w}" for i, w in enumerate("mưa nắng gió biển núi rừng sông hồ".split())]
    items = [(i, texts[2 * i] + texts[2 * i + 1]) for i in range(4)]
    assert [r.src for r in align.align_batch(items, list(enumerate(texts)))] == [[0, 1], [2, 3], [4, 5], [6, 7]]


def test_dots_within_words():
    split = parsing.split_sentences
    assert split("U.S.A. is big. Yes") == ["U.S.A. is big .", "Yes"]
    assert split("Gặp v. v. rồi. Xong!") == ["Gặp v. v. rồi .", "Xong !"] and split("Việc v . v . khác. x") == ["Việc v . v . khác .", "x"]
    assert split("A. Nguyễn đi. B") == ["A .", "Nguyễn đi .", "B"] and split("3.14. Next. e.g. this") == ["3.14 .", "Next .", "e.g. this"]
    assert split("Gặp Dr. Xong") == ["Gặp Dr. Xong"] and split("Gặp Dr.") == ["Gặp Dr ."]


def test_evidence_of_short_texts():
    assert similarity.evidence("ab", "ab") > similarity.evidence("ab", "axb") > similarity.evidence("ab", "xxa") > similarity.evidence("ab", "xy") == 0
    assert similarity.short_match("走了吧", "走了没") and not similarity.short_match("的吗", "的啊吧x") and not similarity.short_match("", "a")
    assert not similarity.short_match("abcdefgh", "abcdefgh")  # not short
