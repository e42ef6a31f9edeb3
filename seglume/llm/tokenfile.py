"""Token-id output in Re-Pair blocks.

Documents are encoded by a public tokenizer (its path is a parameter), get an end id each, and are written in the order
of their ids. Ids go into blocks of about ``block_ids``; each block has its own grammar: frequent pairs of neighbouring
symbols become nonterminals, the more frequent first where two overlap, again and again until no pair that a document
holds occurs ``least_count`` times. A block stores its rules, the length that each nonterminal expands to, and for each
document where its symbols begin and how many ids they make, so that any stretch of any document is decoded alone
(``read_range``): the lengths lead down to the symbols in it. Blocks are rows of a Parquet table (shard, block, counts,
bytes): the container brings splitting, checksums and a committer that survives lost tasks.

Encoding goes by pieces where the tokenizer's own rules allow it (lower case, white space dropped, letters, single digits
and other marks apart; this is checked when it is loaded): it never encodes across white space, nor across the border of
an ASCII letter or digit and an ASCII mark other than the apostrophe. Pieces that a worker has seen come from a bounded
table, by a 64-bit hash and then by their bytes; new ones from the tokenizer, a batch at a time. Should two pieces of a
slice or of the table share a hash, the slice's texts are encoded whole, as are all texts of a tokenizer with other
rules. Either way equals encoding the whole text at once, which the tests compare.

Nulls: a null text is empty and becomes the end id alone; a null id comes first. Repeated rows are encoded each, in the
order of (id, text). Texts longer than a block get a block for themselves. An empty table gives no blocks and no rows.
Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from seglume.llm.textbytes import SPACE, Words, hashes, map_texts, slices, word_mask, words
from seglume.storage import shared_dir


@dataclass(frozen=True)
class TokenParams:
    tokenizer: str
    end_id: int = 2
    #: A special token of the tokenizer, by text and id: it parts the pieces of a batch.
    mark: tuple[str, int] = ("<|endoftext|>", 49407)
    #: A shard has about so many bytes of text, or so many documents if they are short.
    shard_bytes: int = 12 << 20
    docs_per_shard: int = 20_000
    block_ids: int = 1 << 20
    #: A rule takes 12 bytes and saves 2 (or 4) with each use.
    least_count: int = 8
    lexicon: int = 500_000


# ---- the grammar

MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIIII")
_SLOTS = 1 << 20


def _slots(pairs: np.ndarray, bits: int) -> np.ndarray:
    spread = (pairs >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + pairs * np.uint64(0xC2B2AE3D27D4EB4F)
    return (spread >> np.uint64(64 - bits)).astype(np.int32)


def _pairs(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, their pairs, places left out): of a run of one symbol every other pair counts, from its left end."""
    left, right = symbols[at], symbols[at + 1]
    pair = left.astype(np.uint64) << np.uint64(32) | right
    twin = np.flatnonzero(left == right)  # only a symbol beside itself can overlap its own pair
    if not len(twin):
        return at, pair, at[:0]
    place = at[twin]
    again = np.zeros(len(twin), bool)
    again[1:] = (place[1:] == place[:-1] + 1) & (left[twin[1:]] == left[twin[:-1]])
    start = np.maximum.accumulate(np.where(again, 0, np.arange(len(twin))))
    odd = twin[(np.arange(len(twin)) - start) % 2 == 1]
    keep = np.ones(len(at), bool)
    keep[odd] = False
    return at[keep], pair[keep], at[odd]


def _frequent(pair: np.ndarray, least: int) -> np.ndarray:
    """The pairs that occur ``least`` times, the rarest first."""
    sorted_ = np.sort(pair)
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(pair) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(pair)))
    often, n = sorted_[first[n >= least]], n[n >= least]
    return often[np.argsort(n, kind="stable")]


def compress(ids: np.ndarray, last: np.ndarray, first_free: int, p: TokenParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, last): ``last`` marks the last symbol of a document, rules are (left, right) by nonterminal.

    In a round each occurrence of a frequent pair is replaced unless one that overlaps it is of a more frequent pair; a
    pair that keeps too few occurrences waits. A pair that was rare can become frequent only with a new symbol in it, so
    a round looks at places (``live``) with new symbols and at those whose pair may still be frequent."""
    symbols, last, rules, free = ids.astype(np.uint32), last.copy(), [], first_free
    live = np.ones(len(symbols), bool)
    while len(symbols) > 1:
        at, pair, odd = _pairs(symbols, np.flatnonzero(live[:-1] & ~last[:-1]))
        bits = min(_SLOTS.bit_length() - 1, max(10, len(at).bit_length()))
        slot = _slots(pair, bits)
        full = (np.bincount(slot, minlength=1 << bits) >= p.least_count)[slot]  # the others are rare for sure
        at, pair, slot = at[full], pair[full], slot[full]
        often = _frequent(pair, p.least_count)
        if not len(often):
            break
        owner = np.full(1 << bits, -1, np.int32)
        owner[_slots(often, bits)] = np.arange(len(often))  # of pairs with one slot, the most frequent goes first
        rank = owner[slot]
        mine = (rank >= 0) & (often[rank] == pair)
        live[:] = False
        live[at] = live[odd] = True
        at, rank = at[mine], rank[mine]
        beside = np.full(len(symbols) + 2, -1, np.int32)
        beside[at + 1] = rank
        take = (rank > beside[at]) & (rank >= beside[at + 2])
        kept = np.bincount(rank[take], minlength=len(often)) >= p.least_count
        if not kept.any():  # the most frequent one alone keeps all its occurrences
            kept[-1], take = True, rank == len(often) - 1
        take &= kept[rank]
        at, rank = at[take], rank[take]
        symbols[at] = (free + np.cumsum(kept) - 1)[rank]
        last[at] = last[at + 1]
        live[at] = live[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last, live = symbols[keep], last[keep], live[keep]
        new = often[kept]
        rules.append(np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        free += len(new)
    return symbols, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), last


def undo(symbols: np.ndarray, rules: np.ndarray, first_free: int) -> np.ndarray:
    """Each nonterminal replaced by its two symbols, once."""
    inner = np.flatnonzero(symbols >= first_free)
    width = np.ones(len(symbols), np.int64)
    width[inner] = 2
    at = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.uint32)
    out[at] = symbols
    pair = rules[symbols[inner] - first_free]
    out[at[inner]], out[at[inner] + 1] = pair[:, 0], pair[:, 1]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first_free: int) -> np.ndarray:
    """The ids of a run of symbols."""
    symbols = symbols.astype(np.uint32)
    while len(rules) and (symbols >= first_free).any():
        symbols = undo(symbols, rules, first_free)
    return symbols


def pack(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, p: TokenParams) -> bytes:
    """The bytes of a block: head, ids of documents (and which are null), their symbol and id counts, rules, expansion
    lengths, symbols."""
    last = np.zeros(len(ids), bool)
    ends = np.cumsum(lengths)
    last[ends - 1] = True
    first_free = int(ids.max()) + 1
    symbols, rules, last = compress(ids, last, first_free, p)
    counts = np.diff(np.flatnonzero(last), prepend=-1).astype("<u4")
    size = np.ones(first_free + len(rules), np.uint32)
    for i, (a, b) in enumerate(rules.tolist()):
        size[first_free + i] = size[a] + size[b]
    width = 2 if first_free + len(rules) <= 1 << 16 else 4
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(symbols), len(rules), first_free, width)
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [known, null, counts, lengths.astype("<u4"), rules.astype("<u4"), size[first_free:].astype("<u4"), symbols.astype(f"<u{width}")]
    return head + b"".join(x.tobytes() for x in parts)


@dataclass(frozen=True)
class Block:
    doc_ids: list[int | None]
    counts: np.ndarray  # symbols of each document
    lengths: np.ndarray  # ids of each document
    rules: np.ndarray
    sizes: np.ndarray  # ids that each nonterminal expands to
    symbols: np.ndarray
    first_free: int


def unpack(data: bytes) -> Block:
    magic, docs, _, n, rules, first_free, width = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at, out = _HEAD.size, []
    for kind, k in (("<i8", docs), ("<u1", docs), ("<u4", docs), ("<u4", docs), ("<u4", 2 * rules), ("<u4", rules), (f"<u{width}", n)):
        out.append(np.frombuffer(data, kind, k, at))
        at += out[-1].nbytes
    ids = [None if gone else d for d, gone in zip(out[0].tolist(), out[1].tolist())]
    return Block(ids, out[2], out[3], out[4].reshape(-1, 2), out[5], out[6], first_free)


def read_range(block: Block, i: int, begin: int, end: int) -> np.ndarray:
    """Ids begin to end (exclusive) of one document of a block. The expansion lengths tell at each level which symbols
    the range touches; the others are left out before the next one."""
    begin, end = max(0, begin), min(end, int(block.lengths[i]))
    if begin >= end:
        return np.zeros(0, np.uint32)
    at = int(block.counts[:i].sum())
    symbols, skip = block.symbols[at : at + int(block.counts[i])].astype(np.uint32), begin
    while True:
        inner = symbols >= block.first_free
        size = np.ones(len(symbols), np.int64)
        size[inner] = block.sizes[symbols[inner] - block.first_free]
        ends = np.cumsum(size)
        low, high = np.searchsorted(ends, (skip, skip + end - begin - 1), "right").tolist()
        skip -= int(ends[low] - size[low])
        symbols = symbols[low : high + 1]
        if not inner[low : high + 1].any():
            return symbols[skip : skip + end - begin]
        symbols = undo(symbols, block.rules, block.first_free)


def read_block(block: Block) -> np.ndarray:
    """The ids of all documents of a block: each nonterminal is expanded once, by its length, and copied."""
    spelled = expand(np.arange(block.first_free, block.first_free + len(block.rules)), block.rules, block.first_free)
    inner = block.symbols >= block.first_free
    rule = block.symbols[inner].astype(np.int64) - block.first_free
    sizes = block.sizes.astype(np.int64)
    size = np.ones(len(inner), np.int64)
    size[inner] = n = sizes[rule]
    ends, own = np.cumsum(size), np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    copied = np.ones(len(out), bool)
    copied[ends[~inner] - 1] = False
    out[~copied] = block.symbols[~inner]
    out[copied] = spelled[np.repeat((np.cumsum(sizes) - sizes)[rule] - own + n, n) + np.arange(own[-1] if len(own) else 0)]
    return out


def read_document(block: Block, i: int) -> np.ndarray:
    """The ids of one document of a block; only its own symbols are touched."""
    return read_range(block, i, 0, int(block.lengths[i]))


# ---- encoding

_INSIDE, _AS_IS = word_mask(SPACE, lower=False)
_NEAR = 21
_loaded: dict = {}


_FOLD = word_mask([])[1]
#: 1 for ASCII letters and digits, 2 for ASCII marks but the apostrophe: where neighbours make 3, pieces part.
_SIDE = np.array([1 if i < 128 and chr(i).isalnum() else 2 if 32 < i < 127 and chr(i) != "'" else 0 for i in range(256)], np.uint8)


def pieces_of(raw: np.ndarray, offs: np.ndarray, specials: list[bytes]) -> tuple[np.ndarray, Words]:
    """The bytes with A-Z in lower case (not before a byte that is not ASCII, which may combine), and the pieces."""
    body = raw.tobytes()
    if len(raw) < 2 or any(x in body for x in specials):  # a special token is found in the text as it stands
        return raw, words(raw, offs, _INSIDE)
    low = _FOLD[raw]
    low[:-1] = np.where(raw[1:] < 128, low[:-1], raw[:-1])
    low[-1] = raw[-1]
    on, side = _INSIDE[raw], _SIDE[raw]
    fresh = np.empty(len(raw) + 1, bool)  # a piece cannot go on over this border
    fresh[0] = fresh[-1] = True
    fresh[1:-1] = (side[1:] + side[:-1] == 3) | ~(on[1:] & on[:-1])
    fresh[offs] = True
    starts = np.flatnonzero(on & fresh[:-1])
    return low, Words(starts, np.flatnonzero(on & fresh[1:]) + 1, np.searchsorted(starts, offs))


#: The rules of a tokenizer for which ``pieces_of`` holds.
PIECE_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


def _same_bytes(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, n: np.ndarray) -> bool:
    """Are the stretches of lengths ``n`` at ``xs`` in x and at ``ys`` in y equal, all of them?"""
    ends = np.cumsum(n)
    step = np.arange(int(ends[-1]) if len(n) else 0, dtype=np.int32)
    begin = ends - n
    return bool((x[np.repeat((xs - begin).astype(np.int32), n) + step] == y[np.repeat((ys - begin).astype(np.int32), n) + step]).all())


class Encoder:
    """Ids of pieces, kept in a table that starts anew when it is full."""

    def __init__(self, p: TokenParams) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.p = Tokenizer.from_file(p.tokenizer), p
        rules = json.loads(self.tokenizer.to_str())
        self.by_pieces = all(rules.get(k) == v for k, v in PIECE_RULES.items()) and self.tokenizer.token_to_id(p.mark[0]) == p.mark[1]
        # units that end a word: by them the units of many words in one text come apart without their offsets
        suffix = rules["model"].get("end_of_word_suffix")
        units = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max([*units.values(), p.mark[1]], default=0) + 1, bool)
        self.ends_word[[i for u, i in units.items() if suffix and u.endswith(suffix)]] = True
        self.by_pieces &= bool(suffix)
        self.specials = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        #: By the first bits of a key the slot of the last piece that has them, and each slot's key (a hash of 0 is of none).
        self.near, self.keys = np.zeros(1 << _NEAR, np.int32), np.zeros(self.p.lexicon * 2, np.uint64)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.spelled, self.spent = np.zeros(1 << 20, np.uint8), 0
        self.at, self.size, self.spell_at, self.spell_size = (np.zeros(self.p.lexicon * 2, np.int64) for _ in range(4))

    def _store(self, keys: list[int], spelled: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, more, letters = len(self.slots), len(keys), b"".join(spelled)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.spent + len(letters) > len(self.spelled):
            self.spelled = np.concatenate([self.spelled, np.zeros_like(self.spelled)])
        while n + more > len(self.at):
            self.at, self.size, self.spell_at, self.spell_size, self.keys = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.spell_at, self.spell_size, self.keys))
        self.flat[self.used : self.used + len(ids)] = ids
        self.spelled[self.spent : self.spent + len(letters)] = np.frombuffer(letters, np.uint8)
        own = np.fromiter(map(len, spelled), np.int64, more)
        self.at[n : n + more], self.size[n : n + more] = self.used + np.cumsum(lengths) - lengths, lengths
        self.spell_at[n : n + more], self.spell_size[n : n + more] = self.spent + np.cumsum(own) - own, own
        self.keys[n : n + more] = own_keys = np.array(keys, np.uint64)
        self.near[(own_keys >> np.uint64(64 - _NEAR)).astype(np.int64)] = np.arange(n, n + more)
        self.used += len(ids)
        self.spent += len(letters)
        self.slots.update(zip(keys, range(n, n + more)))

    def learn(self, keys: list[int], spelled: list[bytes]) -> None:
        """Words of plain Latin letters are one unit each of the tokenizer, so many go into one text and come apart by
        unit; other pieces are parted by the mark."""
        pieces = b"\n".join(spelled).decode("utf-8", "replace").split("\n")  # no piece holds white space
        plain = [x.isalpha() and (x.isascii() or max(x) < "\u0100") for x in pieces]
        text, mark = self.p.mark
        for kind, join in ((True, " "), (False, f" {text} ")):
            own = [i for i, x in enumerate(plain) if x is kind]
            groups = [own[i : i + 512] for i in range(0, len(own), 512)]
            held = [[] if kind else [i for i in g if text in pieces[i]] for g in groups]  # pieces that hold the mark itself
            done = self.tokenizer.encode_batch_fast([join.join(["" if h and i in h else pieces[i] for i in g]) for g, h in zip(groups, held)], add_special_tokens=False)
            for g, h, e in zip(groups, held, done):
                ids = np.array(e.ids, np.uint32)
                if kind:
                    lengths = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
                else:
                    lengths = np.diff(np.concatenate([[-1], np.flatnonzero(ids == mark), [len(ids)]])) - 1
                    ids = ids[ids != mark]
                if len(lengths) != len(g):
                    raise RuntimeError("the tokenizer parts pieces in another way than this module takes for granted")
                for i in h:
                    k = g.index(i)
                    where = int(lengths[:k].sum())
                    alone = np.array(self.tokenizer.encode(pieces[i], add_special_tokens=False).ids, np.uint32)
                    ids, lengths[k] = np.concatenate([ids[:where], alone, ids[where:]]), len(alone)
                self._store([keys[i] for i in g], [spelled[i] for i in g], ids, lengths)

    def whole(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, each text at once."""
        body = raw.tobytes()
        texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        found = [[*e.ids, self.p.end_id] for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): ids of all texts of a slice with their end ids, and how many each text has."""
        if not self.by_pieces:
            return self.whole(raw, offs)
        if len(self.slots) > self.p.lexicon:
            self.clear()
        body, w = pieces_of(raw, offs, self.specials)
        key = hashes(body, w, _AS_IS)
        slot = self.near[(key >> np.uint64(64 - _NEAR)).astype(np.int64)].astype(np.int64)
        far = np.flatnonzero(self.keys[slot] != key)  # not known, or behind another piece of the same place
        if len(far):
            unique, where, inverse = np.unique(key[far], return_index=True, return_inverse=True)
            where, names = far[where], unique.tolist()
            slots = list(map(self.slots.get, names))
            new = [i for i, k in enumerate(slots) if k is None]
            if new:
                view, s, e = body.tobytes(), w.starts[where[new]].tolist(), w.ends[where[new]].tolist()
                self.learn([names[i] for i in new], [view[a:b] for a, b in zip(s, e)])
                for i in new:
                    slots[i] = self.slots[names[i]]
            slot[far] = np.array(slots, np.int64)[inverse]
        width = w.ends - w.starts
        if (self.spell_size[slot] != width).any() or not _same_bytes(self.spelled, self.spell_at[slot], body, w.starts, width):
            return self.whole(raw, offs)
        a, n = self.at[slot], self.size[slot]
        ends = np.concatenate([[0], np.cumsum(n)])
        # ids of pieces, one piece after another
        pick = np.repeat((a - ends[:-1]).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)
        docs = len(offs) - 1
        lengths = ends[w.first[1:]] - ends[w.first[:-1]]
        out = np.full(int(ends[-1]) + docs, self.p.end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(lengths + 1) - 1] = False
        out[keep] = self.flat[pick]
        return out, lengths + 1


def encoder(p: TokenParams) -> Encoder:
    """One for each worker process and parameters."""
    if p not in _loaded:
        _loaded.clear()
        _loaded[p] = Encoder(p)
    return _loaded[p]


# ---- writing and reading

_BLOCKS = "shard int, block int, n_docs long, n_ids long, data binary"


def _blocks(p: TokenParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, block = encoder(p), TaskContext.get().partitionId(), 0
        doc_ids, ids, lengths, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, ids, lengths, held, block
            n = np.concatenate(lengths)
            data = pack(doc_ids, np.concatenate(ids), n, p)
            row = [pa.array([x], kind) for x, kind in ((shard, pa.int32()), (block, pa.int32()), (len(doc_ids), pa.int64()), (int(n.sum()), pa.int64()), (data, pa.binary()))]
            doc_ids, ids, lengths, held, block = [], [], [], 0, block + 1
            return pa.RecordBatch.from_arrays(row, names=["shard", "block", "n_docs", "n_ids", "data"])

        for batch in batches:
            for a, b, raw, offs in slices(batch.column(1), 1 << 20):
                got, n = enc.encode(raw, offs)
                if held and held + len(got) > p.block_ids:
                    yield flush()
                doc_ids += batch.column(0).slice(a, b - a).to_pylist()
                ids.append(got)
                lengths.append(n)
                held += len(got)
        if doc_ids:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, params: TokenParams, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the blocks of all documents in ascending order of their ids."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shards = max(1, -(-n // params.docs_per_shard), -(-(size or 0) // params.shard_bytes))
    # rows that share an id part by the beginnings of their texts, which agree with the order of whole texts
    dealt = texts.repartitionByRange(shards, "doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 32))
    map_texts(dealt.sortWithinPartitions("doc_id", "text"), _blocks(params), _BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Of each document, from the blocks alone: doc_id, start, n_tokens, ids_crc32, shard, block (and ids)."""
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    schema = "shard int, block int, doc_id long, inner_start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                b = unpack(data)
                ids = read_block(b).astype("<u4")
                n = b.lengths.astype(np.int64)
                ends = np.cumsum(n)
                view = memoryview(ids)
                crc = [zlib.crc32(view[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())]
                k = len(n)
                cols = [pa.array(np.full(k, shard, np.int32)), pa.array(np.full(k, number, np.int32)), pa.array(b.doc_ids, pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[e - m : e].tolist() for e, m in zip(ends.tolist(), n.tolist())], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    # a row a shard first: the one window over all of them sees no blocks
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = F.sum("n_ids").over(W.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    starts = blocks.select("shard", "block", within.alias("inner")).join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("inner")).alias("block_start"))
    rows = blocks.select("shard", "block", "data").mapInArrow(run, schema).join(starts, ["shard", "block"])
    return rows.select("doc_id", (F.col("block_start") + F.col("inner_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "block", *(["ids"] if with_ids else []))


def encode(docs: DataFrame, params: TokenParams, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Writes the blocks below the shared folder and reads them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/seglume/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, params, id_col, text_col)
    return read_tokens(spark, path, with_ids)
