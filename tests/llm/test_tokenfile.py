import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from seglume.llm import textbytes, tokenfile

DOCS = "doc_id long, text string, start string, block int"
P = tokenfile.TokenParams(public_tokenizers.path("word_bpe_49k.json"))
ENC = tokenfile.encoder(P)
ALPHABET = "aAbBzTSs09 '.,!<|>*&\n\téÉßÀñİıſΣσ̸́̌Jj’½中\U0001f600_-"


def direct(text):
    return [*ENC.tokenizer.encode(text, add_special_tokens=False).ids, 2]


@given(st.lists(st.one_of(st.text(ALPHABET, max_size=30), st.sampled_from(["don't stop's", "A<|endoftext|>b", "x≠y", "J̌.", "the,and&&&"])), max_size=5))
@settings(max_examples=300, deadline=None)
def test_pieces_encode_as_whole_texts(texts):
    for _, _, raw, offs in textbytes.slices(pa.array(texts, pa.string())):
        ids, n = ENC.encode(raw, offs)
        ends = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == [direct(t) for t in texts]


@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=60), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_blocks_round_trip(docs):
    p = tokenfile.TokenParams("", least_count=2)
    ids, n = np.array(sum(docs, []), np.uint32), np.array([len(d) for d in docs])
    block = tokenfile.unpack(tokenfile.pack([None, *range(1, len(docs))], ids, n, p))
    assert block.doc_ids == [None, *range(1, len(docs))]
    assert [tokenfile.read_document(block, i).tolist() for i in range(len(docs))] == docs
    assert tokenfile.read_block(block).tolist() == sum(docs, [])
    for i, (a, b) in enumerate(block.rules.tolist()):
        assert block.sizes[i] == len(tokenfile.expand(np.array([a, b]), block.rules, block.first_free))
    for i, d in enumerate(docs):
        for a in range(0, len(d), 7):
            assert tokenfile.read_range(block, i, a, a + 5).tolist() == d[a : a + 5]
    # no pair is left that two places (not overlapping) in documents hold
    at, counts = 0, {}
    for n_symbols in block.counts.tolist():
        own, seen = block.symbols[at : at + n_symbols].tolist(), {}
        at += n_symbols
        for k, pair in enumerate(zip(own, own[1:])):
            if seen.get(pair) != k - 1:
                counts[pair], seen[pair] = counts.get(pair, 0) + 1, k
    assert max(counts.values(), default=0) < 2


def test_a_range_touches_only_its_symbols():
    ids = np.tile(np.arange(64, dtype=np.uint32), 2000)
    block = tokenfile.unpack(tokenfile.pack([0], ids, np.array([len(ids)]), P))
    assert block.sizes.max() > 5_000  # a symbol for a long stretch, which must not be expanded whole
    touched, undo = [], tokenfile.undo
    tokenfile.undo = lambda s, *rest: (touched.append(len(s)), undo(s, *rest))[1]
    try:
        assert tokenfile.read_range(block, 0, 77_777, 77_787).tolist() == ids[77_777:77_787].tolist()
    finally:
        tokenfile.undo = undo
    assert max(touched) <= 12


def test_pieces_that_share_a_hash():
    a = "ab"
    for _ in range(9):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    for texts in ([a, b], [a], [b], [f"x {a} y {b} {a}"]):
        for _, _, raw, offs in textbytes.slices(pa.array(texts, pa.string())):
            ids, n = ENC.encode(raw, offs)
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [direct(t) for t in texts]


def test_a_tokenizer_with_other_rules_encodes_whole_texts():
    other = tokenfile.Encoder(tokenfile.TokenParams(public_tokenizers.path("byte_bpe_50k.json"), end_id=50256))
    texts = ["The  quick\n\nBROWN fox's 1234", "", "a,b"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, n = other.encode(raw, np.cumsum([0, *map(len, texts)]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*other.tokenizer.encode(t, add_special_tokens=False).ids, 50256] for t in texts]
    assert ENC.by_pieces and not other.by_pieces


def test_an_id_that_most_rows_have(spark):
    texts = [f"{w} text number {i}" for i in range(60) for w in ("one", "two")]
    docs = spark.createDataFrame([(7, t, "", 0) for t in texts] + [(3, "first", "", 0), (9, "last", "", 0)], DOCS)
    got = tokenfile.encode(docs, tokenfile.TokenParams(P.tokenizer, docs_per_shard=20), with_ids=True).collect()
    want = [direct(t) for t in ["first", *sorted(texts), "last"]]
    assert [r.ids for r in sorted(got, key=lambda r: r.start)] == want
    assert len({r.shard for r in got if r.doc_id == 7}) > 2


def test_repeats_shrink():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    block = tokenfile.unpack(tokenfile.pack([0], ids, np.array([len(ids)]), P))
    assert len(block.symbols) < len(ids) / 8 and (tokenfile.read_document(block, 0) == ids).all()


def test_written_and_read_back(spark):
    texts = ["The THE the, end", None, "", "don't — é", "word " * 40_000, "The THE the, end"]
    data = [(90 - 10 * i, t, "x", 1) for i, t in enumerate(texts)] + [(90, texts[0], "x", 1), (None, "null id", "", 0)]
    small = tokenfile.TokenParams(P.tokenizer, docs_per_shard=3, block_ids=50)
    got = tokenfile.encode(spark.createDataFrame(data, DOCS), small, with_ids=True).collect()
    want, at = [], 0
    for i, t, *_ in sorted(data, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = direct(t or "")
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted((tuple(r)[:4] + (r.ids,) for r in got), key=lambda r: r[1]) == want
    assert len({(r.shard, r.block) for r in got}) > 2
    assert tokenfile.encode(spark.createDataFrame([], DOCS), small).count() == 0


def test_known_pieces_are_found_without_sorting_or_offsets():
    """Known pieces come from the slots alone, new ones without the tokenizer's offsets; ids stay those of whole texts."""
    texts = ["don't stop the straße's quiouéchtion, naïve ÿ 12 a-b", "", "the the THE x≠y naïve"] * 3
    enc = tokenfile.Encoder(P)
    tokenizer = enc.tokenizer

    class Watched:
        def __getattr__(self, name):
            assert name != "encode_batch", "offsets of all words are asked for"
            return getattr(tokenizer, name)

    enc.tokenizer = Watched()
    for again in range(2):
        unique, np.unique = np.unique, np.unique if not again else lambda *a, **k: pytest.fail("known pieces are sorted")
        try:
            (_, _, raw, offs), = textbytes.slices(pa.array(texts))
            ids, n = enc.encode(raw, offs)
        finally:
            np.unique = unique
        ends = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == [direct(t) for t in texts]
