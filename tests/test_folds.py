"""Folds, parsing and alignment as plain functions: by hand-written cases, brute force and invariants."""

import itertools
import json
import random

import pytest

from seglume.functions import parsing, similarity
from seglume.operators import align, folds


def rows(*times, **more):
    return [{"seq": i + 1, "start_ms": s, "end_ms": e} | {k: v[i] for k, v in more.items()} for i, (s, e) in enumerate(times)]


def test_overlaps_part_in_the_middle():
    got = list(folds.split_overlaps()(rows((0, 1000), (800, 2000), (2000, 1900))))
    assert got == [(1, 0, 890), (2, 910, 2000), (3, 2000, 2500)]
    assert list(folds.split_overlaps()([])) == []


def test_batches_have_at_most_the_size_and_characters():
    rng = random.Random(1)
    for _ in range(50):
        own = [{"seq": i, "chars": rng.randint(0, 40)} for i in range(rng.randint(0, 30))]
        got = dict(folds.pack_batches(5, 60)(own))
        for b in set(got.values()):
            members = [r for r in own if got[r["seq"]] == b]
            assert len(members) <= 5 and (len(members) == 1 or sum(r["chars"] for r in members) <= 60)


def test_turns_follow_the_merged_end_and_skip_rows_without_voice():
    own = rows((0, 5000), (1000, 2000), (5500, 6000), (7000, 8000), speaker=["a", "A ", "a", "a"], raw_ms=[100, 200, None, 300])
    assert list(folds.speaker_turns()(own)) == [(1, 1, 0), (2, 1, 100), (4, 2, 0)]
    blank = rows((0, 1), (2, 3), speaker=["", ""], raw_ms=[1, 1])
    assert [t for _, t, _ in folds.speaker_turns()(blank)] == [1, 2]


def test_fragments_join_only_when_small_and_close():
    own = rows((0, 100), (150, 300), (320, 500), (2000, 2100), text=["ab", "cdef", "gh.", "ij"], confidence=[0.5, 0.7, -1.0, 1.0])
    got = list(folds.merge_fragments()(own))
    assert [(s, e, t) for _, s, e, t, _ in got] == [(0, 300, "abcdef"), (320, 500, "gh."), (2000, 2100, "ij")]
    assert got[0][4] == 0.6


def test_word_groups_cut_at_pauses():
    own = [{"start_ms": 100 * i + (2000 if i > 5 else 0), "end_ms": 100 * i + 50 + (2000 if i > 5 else 0), "text": str(i)} for i in range(9)]
    assert [(g, n) for g, _, _, n, _ in folds.word_groups(own)] == [(1, 6), (2, 3)]
    assert list(folds.word_groups([])) == []


def test_chunks_cover_all_rows_once():
    rng = random.Random(2)
    for _ in range(30):
        t, own = 0, []
        for i in range(rng.randint(1, 200)):
            t += rng.choice((0, 100, 900, 12_000))
            own.append({"seq": i + 1, "start_ms": t, "end_ms": (t := t + rng.randint(50, 3000))})
        got = list(folds.pause_chunks(folds.PauseCuts(30_000, 30, 12))(own))
        assert got[0][1] == 1 and got[-1][2] == len(own)
        assert all(a[2] + 1 == b[1] for a, b in itertools.pairwise(got))


def test_borrowing_never_takes_more_than_is_spare():
    rng = random.Random(3)
    for _ in range(50):
        own = [{"seq": i, "start_ms": 1000 * i, "end_ms": 1000 * i + rng.randint(100, 1000), "raw_ms": rng.choice((None, rng.randint(0, 3000)))} for i in range(8)]
        got = {s: (a, b) for s, a, b in folds.borrow()(own)}
        for i, r in enumerate(own):
            lent = (got[i - 1][1] if i else 0) + (got[i + 1][0] if i < 7 else 0)
            slot = r["end_ms"] - r["start_ms"]
            assert lent <= max(0, max(100, slot) - (r["raw_ms"] or 0) / 1.3) + 2
            assert not (lent and sum(got[i]))


def test_stitching_replaces_a_cut_row_and_drops_repeats():
    own = [
        {"chunk": 0, "start_ms": 0, "end_ms": 1000, "text": "one", "window_end": 0}, {"chunk": 0, "start_ms": 9000, "end_ms": 10_000, "text": "two th", "window_end": 0},
        {"chunk": 1, "start_ms": 9000, "end_ms": 11_000, "text": "two three", "window_end": 10_000}, {"chunk": 1, "start_ms": 10_900, "end_ms": 12_000, "text": "four", "window_end": 10_000},
    ]
    assert list(folds.stitch()(own)) == [(1, 0, 1000, "one"), (2, 9000, 11_000, "two three"), (3, 11_020, 12_000, "four")]


def test_look_ahead_takes_rows_in_while_they_help():
    own = [{"seq": 1, "start_ms": 0, "end_ms": 100, "text": "ab", "block": "abcd"}, {"seq": 2, "start_ms": 200, "end_ms": 300, "text": "cd", "block": "abcd"}, {"seq": 3, "start_ms": 5000, "end_ms": 5100, "text": "x", "block": "x"}]
    assert [(a, b, t) for a, b, t, _ in folds.look_ahead(similarity.ratio)(own)] == [(1, 2, "abcd"), (3, 3, "x")]


# ---- similarity

def brute_subsequence(a, b):
    return max(len(x) for n in range(len(a) + 1) for x in itertools.combinations(a, n) if all(c in it for it in [iter(b)] for c in x))


def test_subsequence_and_stretch_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert similarity.subsequence(a, b) == brute_subsequence(a, b)
        assert similarity.stretch(a, b) == max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)


def test_scores_are_in_range_and_helped_for_short_texts():
    assert similarity.piece_similarity("abc", "abc") == 1 and similarity.piece_similarity("", "a") == 0
    assert similarity.piece_similarity("ab", "abxy") >= 0.82
    assert similarity.piece_similarity("axb", "acb") >= 0.6
    assert similarity.piece_similarity("abcdefgh", "abcdefghabcdefghabcdefgh") < similarity.ratio("abcdefgh", "abcdefghabcdefghabcdefgh")
    assert similarity.partial_ratio("cd", "abcdef") == 1 and similarity.partial_ratio("", "a") == 0
    assert similarity.sound_similarity("zhang san", "zang san") > similarity.sound_similarity("zhang san", "wang wu")
    assert similarity.short_match("先凡", "先凡有别") and not similarity.short_match("先凡", "天地玄黄宇宙洪荒")


# ---- parsing

def test_json_comes_back_from_every_kind_of_damage():
    value = [{"src": 1, "vi": 'a "b" }'}, {"src": 2, "vi": "c"}]
    text = json.dumps(value)
    assert parsing.load_json(text) == parsing.load_json(f"so:\n```json\n{text}\n```\nbye") == parsing.load_json(text[:-1] + ",]") == value
    for cut in range(len(text) - 1, 30, -1):
        assert parsing.load_json(text[:cut])[0] == value[0]
    assert parsing.load_json("") is None and parsing.load_json("no") is None
    assert parsing.load_json('[{"a": 1}, {"b": , {"c": 2}') in ([{"a": 1}, {"c": 2}], [{"a": 1}])


def test_scripts_in_each_grammar():
    assert parsing.parse_script("[Ann] (0.5 - 2): hello\n12. there\nBob: you\nplain") == [
        {"n": 1, "role": "Ann", "src": [], "text": "hello"}, {"n": 12, "role": None, "src": [], "text": "there"}, {"n": 3, "role": "Bob", "src": [], "text": "you"}, {"n": 4, "role": None, "src": [], "text": "plain"},
    ]
    assert parsing.parse_script('{"items": [{"src": [1, 2], "role": "x", "vi": "y"}]}') == [{"n": 1, "role": "x", "src": [1, 2], "text": "y"}]


@pytest.mark.parametrize(("run", "value"), [("二十三", "23"), ("二零二四", "2024"), ("十", "10"), ("一百零五", "105"), ("两千", "2000"), ("三万二千", "32000"), ("万", "10000")])
def test_numerals(run, value):
    assert parsing.numeral(run) == value


def test_sentences_keep_abbreviations_decimals_and_all_letters():
    text = "Mr. Hill paid 3.5 coins. He left! v.v. and more... So it goes"
    got = parsing.split_sentences(text)
    assert got[0].startswith("Mr. Hill paid 3.5 coins") and got[1].startswith("He left")
    keep = lambda x: [c for c in x if c.isalnum()]
    assert keep(" ".join(got)) == keep(text)
    long_ = ", ".join("word " * 10 for _ in range(6)).strip()
    assert all(len(x.split()) <= 26 for x in parsing.split_sentences(long_, 25))
    assert all(len(x.split()) <= 4 for x in parsing.split_sentences("a b c d e f g h i", 4, hard=True))
    assert parsing.split_sentences("") == [] == parsing.split_sentences("?!")


def brute_demerge(text, durations):
    chunks, n = parsing.text_chunks(text), len(durations)
    words, total = [max(1, len(c.split())) for c, _ in chunks], sum(max(1, len(c.split())) for c, _ in chunks)
    joint = [{1: 1000, 2: 2}.get(level, 20) for _, level in chunks]
    best = None
    for cuts in itertools.combinations(range(1, len(chunks)), n - 1):
        edges = [0, *cuts, len(chunks)]
        cost = 0.0
        for (a, b), d in zip(itertools.pairwise(edges), durations):
            want = d / sum(durations) * total
            cost += 10 * ((sum(words[a:b]) - want) / max(1.0, want)) ** 2 + sum(joint[a : b - 1])
        best = min(best, cost) if best is not None else cost
    return best


def test_demerge_is_the_cheapest_partition_and_loses_nothing():
    rng = random.Random(5)
    for _ in range(100):
        text = "".join(" ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(1, 4))) + rng.choice((", ", ". ", "; ")) for _ in range(rng.randint(1, 8))).strip()
        durations = [rng.choice((0.5, 1.0, 2.5)) for _ in range(rng.randint(1, 5))]
        got = parsing.demerge(text, durations)
        assert len(got) == len(durations) and " ".join(x for x in got if x) == " ".join(c for c, _ in parsing.text_chunks(text))
        chunks = parsing.text_chunks(text)
        if len(chunks) > len(durations):
            at, edges = 0, [0]
            for part in got:
                size = len(parsing.text_chunks(part))
                at += size
                edges.append(at)
            words, total = [max(1, len(c.split())) for c, _ in chunks], sum(max(1, len(c.split())) for c, _ in chunks)
            joint = [{1: 1000, 2: 2}.get(level, 20) for _, level in chunks]
            cost = sum(10 * ((sum(words[a:b]) - d / sum(durations) * total) / max(1.0, d / sum(durations) * total)) ** 2 + sum(joint[a : b - 1]) for (a, b), d in zip(itertools.pairwise(edges), durations))
            assert cost == pytest.approx(brute_demerge(text, durations))


def test_matches_are_longest_and_on_word_borders():
    m = parsing.Matcher.of({"art": "A", "art of war": "B", "孙子": "S", "子兵": "T"})
    assert m.find("The art of war, part art 孙子兵") == [(4, 14, "art of war", "B"), (21, 24, "art", "A"), (25, 27, "孙子", "S")]
    assert m.replace("孙子兵", lambda c: "?") == "S?"
    assert parsing.replace_once("ab b", [("ab", "b"), ("b", "z"), ("b ", "c")]) == "b b"


def test_a_gap_cuts_near_its_share_at_a_mark():
    assert parsing.cut_at_gap("one two three. four five", 3, 2) == ("one two three.", "four five")
    assert parsing.cut_at_gap("one", 1, 1) is None


# ---- alignment

def test_alignment_keeps_order_and_uses_each_source_once():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9)))
    for _ in range(40):
        sources = [(10 + i, word() + word()) for i in range(rng.randint(1, 25))]
        items, at = [], 0
        while at < len(sources):
            n = rng.randint(1, 3)
            text = "".join(t for _, t in sources[at : at + n])
            if rng.random() < 0.9:
                items.append((len(items) + 1, text if rng.random() < 0.8 else text[1:]))
            at += n
        got = align.align_batch(items, sources)
        used = [s for r in got for s in r.src]
        dropped = [s for r in got for s in r.dropped]
        assert len(got) == len(items) and used == sorted(set(used)) and not set(used) & set(dropped)
        if any(r.src for r in got):
            assert set(used) | set(dropped) == {s for s, _ in sources}


def test_alignment_of_exact_quotes_is_exact():
    sources = [(i, w) for i, w in enumerate(("tomorrow we leave", "the harbour is frozen", "nobody knows why", "so they waited"))]
    got = align.align_batch([(1, "tomorrow we leavethe harbour is frozen"), (2, "nobody knows why"), (3, "so they waited")], sources)
    assert [r.src for r in got] == [[0, 1], [2], [3]] and all(r.verdict == "clear" for r in got)
    assert align.align_batch([], sources) == [] and [r.src for r in align.align_batch([(1, "x")], [])] == [[]]
