"""Secret scans: base patterns, and a linear-chain conditional random field over tokens.

Tokens are runs of letters, digits and ``+/_.-``; features of a token are its shape, the gap that stands before it, the
shapes of its neighbours, whether a naming word (password, token, key ...) stands up to two tokens before, what kind of
file it is in, and which words it and its neighbours are (by hash, of those that training saw several times). The field
has the tags begin, inside and outside; begin and inside weigh each feature on their own, against outside, and moves
between tags have weights too. It is trained here, by gradient ascent on sentences drawn from a seeded generator, and
decoded by Viterbi.

Viterbi runs where it can matter: if a token's better score for being in a secret is below all that the transitions, and
the next token's tag, could gain by it, any path through it gets better by stepping outside there, so that token is
outside in the best path and cuts the chain. The result equals a full decoding.

Nulls: a null text is empty and has no spans; a null id stays null. Repeated rows stay. Texts are scanned whole,
whatever their length. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seglume.llm.textbytes import hash_words, hashes, map_texts, slices, word_mask, words

#: Base patterns by kind, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

#: Words that name what follows.
NAMING = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "key", "pwd", "bearer", "credential", "credentials", "auth", "authorization", "access_key", "secret_key", "client_secret", "access_token", "private_key", "passphrase")
SHAPES = ("end", "word", "long word", "capitals", "digits", "numberish", "short mix", "mix", "long mix", "hex", "long hex", "capital code", "symbols", "words and symbols", "long with symbols", "other")
GAPS = ("space", "assign", "quote", "assign and quote", "other")
S = {name: i for i, name in enumerate(SHAPES)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in code points, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


# ---- features

_INSIDE, _FOLDED = word_mask([i for i in range(128) if not (chr(i).isalnum() or chr(i) in "+/_.-")])
_LUT = {
    "digit": np.array([48 <= i <= 57 for i in range(256)]),
    "upper": np.array([65 <= i <= 90 for i in range(256)]),
    "hex": np.array([48 <= i <= 57 or 97 <= i <= 102 for i in range(256)]),
    "mark": np.array([chr(i) in "+/_.-" for i in range(256)]),
    "wide": np.array([i >= 128 for i in range(256)]),
}
_EQUALS = np.array([chr(i) in "=:" for i in range(256)])
_QUOTE = np.array([chr(i) in "\"'`" for i in range(256)])


@dataclass
class Features:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of the first token of each text
    shape: np.ndarray
    gap: np.ndarray
    named: np.ndarray  # 0 no, 1 the token before names, 2 the one before that
    file: np.ndarray  # per text: 0 prose, 1 a naming word, 2 many assignments
    word: np.ndarray  # hash of the token in lower case


@cache
def _naming() -> np.ndarray:
    return np.sort(hash_words(list(NAMING)))


def _counts(lut: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(lut[raw], out=sums[1:])
    return sums[ends] - sums[starts]


def features(raw: np.ndarray, offs: np.ndarray) -> Features:
    w = words(raw, offs, _INSIDE)
    n, c = w.ends - w.starts, {k: _counts(v, raw, w.starts, w.ends) for k, v in _LUT.items()}
    # what stands between this token and the one before it in the same text
    before = np.concatenate([[0], w.ends[:-1]]) if len(n) else w.ends
    if len(n):
        heads = w.first[:-1][np.diff(w.first) > 0]
        before[heads] = offs[:-1][np.diff(w.first) > 0]
    eq, qu = _counts(_EQUALS, raw, before, w.starts), _counts(_QUOTE, raw, before, w.starts)
    wide = (w.starts - before > 3) & (eq == 0) & (qu == 0)
    gap = np.where(eq > 0, np.where(qu > 0, 3, 1), np.where(qu > 0, 2, np.where(wide, 4, 0))).astype(np.int8)

    letters = n - c["digit"] - c["mark"]
    shape = np.full(len(n), S["other"], np.int8)
    plain = (c["digit"] == 0) & (c["mark"] == 0)
    rules = [
        (plain & (n < 24), "word"),
        (plain & (n >= 24), "long word"),
        (plain & (c["upper"] == n) & (n > 1), "capitals"),
        ((c["mark"] > 0) & (c["digit"] == 0), "words and symbols"),
        ((letters == 0) & (c["mark"] == 0), "digits"),
        ((letters == 0) & (c["mark"] > 0) & (c["digit"] > 0), "numberish"),
        ((letters > 0) & (c["digit"] > 0) & (n < 8), "short mix"),
        ((letters > 0) & (c["digit"] > 0) & (n >= 8) & (n < 16), "mix"),
        ((letters > 0) & (c["digit"] > 0) & (n >= 16), "long mix"),
        ((letters > 0) & (c["digit"] > 0) & (c["mark"] > 0) & (n >= 16), "long with symbols"),
        ((c["hex"] == n) & (c["digit"] > 0) & (letters > 0) & (n >= 8), "hex"),
        ((c["hex"] == n) & (c["digit"] > 0) & (n >= 24), "long hex"),
        ((c["upper"] + c["digit"] == n) & (c["upper"] > 0) & (c["digit"] > 0) & (n >= 16), "capital code"),
        (c["mark"] == n, "symbols"),
        ((c["wide"] > 0) & (c["digit"] == 0), "word"),
    ]
    for where, name in rules:
        shape[where] = S[name]

    h, table = hashes(raw, w, _FOLDED), _naming()
    at = np.minimum(np.searchsorted(table, h), len(table) - 1) if len(h) else np.zeros(0, np.int64)
    names = table[at] == h if len(h) else np.zeros(0, bool)
    named = np.zeros(len(n), np.int8)
    text = w.text_of()
    if len(n) > 2:
        two = names[:-2] & (text[:-2] == text[2:])
        named[2:][two] = 2
    if len(n) > 1:
        one = names[:-1] & (text[:-1] == text[1:])
        named[1:][one] = 1
    file = np.zeros(len(offs) - 1, np.int8)
    if len(n):
        file[np.unique(text[names])] = 1
        lines = np.bincount(text[(gap == 1) | (gap == 3)], minlength=len(file))
        file[lines * 8 > np.maximum(8, w.per_text())] = 2
    return Features(w.starts, w.ends, w.first, shape, gap, named, file, h)


# ---- the field

TAGS = ("O", "B", "I")
#: Sizes of the weight tables: own shape, gap, naming, shape before, shape after, shape by naming, shape by gap, file, own
#: word, word before, word after (words by hash; number 0 is any other word and weighs nothing).
_WORDS = 1 << 12
_SIZES = (len(SHAPES), len(GAPS), 3, len(SHAPES), len(SHAPES), 3 * len(SHAPES), len(GAPS) * len(SHAPES), 3, _WORDS, _WORDS, _WORDS)
_FORBIDDEN = -1e9


@dataclass(frozen=True)
class Field:
    tables: tuple[np.ndarray, ...]  # values x (begin, inside)
    moves: np.ndarray  # [from, to] over O, B, I

    def scores(self, f: Features) -> np.ndarray:
        """Of each token, for beginning a secret and for being inside one, against outside."""
        out = np.zeros((len(f.shape), 2), np.float32)
        for table, i in zip(self.tables, indices(f)):
            out += table[i]
        return out

    def most(self) -> float:
        """What the transitions can gain at most by tagging a token B or I rather than O, with an I that follows turned
        into a B."""
        m, most = self.moves, -np.inf
        for before, own, after, last in itertools.product(range(3), (1, 2), range(3), range(3)):
            fixed = 1 if after == 2 else after
            had = m[before, own] + m[own, after] + m[after, last]
            if had > _FORBIDDEN / 2:
                most = max(most, had - m[before, 0] - m[0, fixed] - m[fixed, last])
        return most + 1e-3


def indices(f: Features) -> list[np.ndarray]:
    n = len(f.shape)
    heads = f.first[:-1][np.diff(f.first) > 0]

    def beside(x: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n > 1:
            before[1:], after[:-1] = x[:-1], x[1:]
        before[heads] = end
        after[heads[1:] - 1] = end
        after[n - 1 :] = end
        return before, after

    own, word = f.shape.astype(np.int64), (f.word >> np.uint64(52)).astype(np.int64)
    shapes, words_ = beside(own, S["end"]), beside(word, 0)
    file = np.repeat(f.file, np.diff(f.first))
    return [own, f.gap, f.named, *shapes, f.named * len(SHAPES) + own, f.gap.astype(np.int64) * len(SHAPES) + own, file, word, *words_]


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags (0 O, 1 B, 2 I) of one chain; both ends stand next to an outside."""
    m = moves.tolist()
    at, back = [0.0, _FORBIDDEN, _FORBIDDEN], []
    for begin, inside in scores.tolist():
        new, ptr = [], []
        for to, s in enumerate((0.0, begin, inside)):
            best = max(range(3), key=lambda a: at[a] + m[a][to])
            new.append(at[best] + m[best][to] + s)
            ptr.append(best)
        at = new
        back.append(ptr)
    tag = max(range(3), key=lambda a: at[a] + m[a][0])
    out = []
    for ptr in reversed(back):
        out.append(tag)
        tag = ptr[tag]
    return out[::-1]


def decode(scores: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """Tags of all tokens of many texts, each text a chain."""
    tags = np.zeros(len(scores), np.int8)
    turned = np.zeros(len(scores))  # what turning the next token's I into a B costs at most
    turned[:-1] = np.maximum(0, scores[1:, 1] - scores[1:, 0])
    open_ = np.flatnonzero(scores.max(axis=1) > -(field.most() + turned)) if len(scores) else tags
    if len(open_):
        text = np.searchsorted(first, open_, "right")
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(text) > 0)) + 1
        for run in np.split(open_, cut):
            tags[run] = viterbi(scores[run], field.moves)
    return tags


# ---- training

def sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Drawn texts with the spans of their secrets: assignments, keys in prose, and much that only looks alike."""
    rng = random.Random(seed)
    pick = lambda chars, lo, hi: "".join(rng.choice(chars) for _ in range(rng.randint(lo, hi)))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    word = lambda: rng.choice((pick(low, 1, 9), pick(low, 2, 14), pick(low, 2, 8).capitalize(), "é" + pick(low, 1, 5)))

    def secret() -> str:
        return rng.choice((
            lambda: pick(hexa, 32, 64), lambda: pick(hexa, 40, 40), lambda: "AKIA" + pick(up + dig, 16, 16), lambda: pick(low + up + dig, 16, 40),
            lambda: pick(low + up + dig + "+/_-", 20, 44), lambda: "ghp_" + pick(low + up + dig, 30, 36), lambda: "sk-" + pick(low + up + dig, 24, 48),
            lambda: pick(low, 4, 8) + pick(dig, 2, 4) + pick(up, 1, 4) + pick(dig, 1, 3),
        ))()

    def decoy() -> str:
        return rng.choice((
            lambda: pick(dig, 1, 12), lambda: f"+1 ({pick(dig, 3, 3)}) 555-{pick(dig, 4, 4)}", lambda: ".".join(pick(dig, 1, 3) for _ in range(4)),
            lambda: f"{word()}.{pick(dig, 2, 2)}@mail{pick(dig, 1, 1)}.example.com", lambda: f"https://www.{pick(low, 4, 12)}.org/{pick(low, 3, 9)}/{pick(dig, 2, 6)}",
            lambda: pick(up, 2, 12), lambda: pick(low, 24, 40), lambda: f"20{pick(dig, 2, 2)}-{pick(dig, 2, 2)}-{pick(dig, 2, 2)}", lambda: f"v{pick(dig, 1, 1)}.{pick(dig, 1, 2)}.{pick(dig, 1, 2)}",
            lambda: pick(low, 2, 4) + pick(dig, 1, 2), lambda: f"{word()}-{word()}-{word()}", lambda: f"{word()}: {word()}", lambda: f'{word()} = "{word()}"',
            lambda: f"{rng.choice(NAMING)} {word()}", lambda: f"the {rng.choice(NAMING)}: {word()} {word()}", lambda: pick(low, 3, 8) + "***", lambda: pick(low, 3, 8) + "&&&", lambda: "| " + word() + " |",
            lambda: f"{pick(low, 4, 9)}_{pick(low, 4, 9)}_{pick(low, 3, 9)}", lambda: f"size={pick(dig, 1, 5)}", lambda: "§ " + pick(dig, 1, 3) + "%",
        ))()

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            text += " ".join(decoy() if rng.random() < 0.25 else word() for _ in range(rng.randint(1, 8))) + rng.choice((" ", ". ", "\n"))
            if rng.random() < 0.5:
                q = rng.choice(('"', "'", ""))
                lead = rng.choice(("{k} = ", "{k}: ", "{k}=", "{k} is ", "export {k}=", "{k} ", "")).format(k=rng.choice(NAMING).upper() if rng.random() < 0.2 else rng.choice(NAMING))
                value = secret() if lead else rng.choice((pick(hexa, 32, 64), "AKIA" + pick(up + dig, 16, 16), "ghp_" + pick(low + up + dig, 30, 36), pick(low + up + dig + "+/", 32, 44)))
                text += lead + q
                spans.append((len(text.encode()), len((text + value).encode())))
                text += value + q + " "
        out.append((text, spans))
    return out


@cache
def trained(n: int = 600, seed: int = 11, rounds: int = 120, rate: float = 0.25, decay: float = 2e-3) -> Field:
    """Weights from ``n`` drawn sentences: gradient steps (Adam) on the mean log-likelihood less ``decay`` of the squares."""
    drawn = sentences(n, seed)
    encoded = [t.encode() for t, _ in drawn]
    raw = np.frombuffer(b"".join(encoded), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).astype(np.int64)
    f = features(raw, offs)
    want = np.zeros(len(f.shape), np.int64)
    for k, (_, spans) in enumerate(drawn):
        for a, b in spans:
            own = np.flatnonzero((f.starts >= offs[k] + a) & (f.ends <= offs[k] + b))
            want[own] = 2
            want[own[:1]] = 1
    # chains padded to one length: index -1 is padding
    length = np.diff(f.first)
    grid = np.full((n, length.max()), -1)
    for k in range(n):
        grid[k, : length[k]] = np.arange(f.first[k], f.first[k + 1])
    idx, moves = indices(f), np.array([[0.0, 0.0, _FORBIDDEN], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    # words that are rare in the sentences would be learnt by heart; they and all unseen ones weigh nothing
    known = np.bincount(idx[8], minlength=_WORDS) >= 5
    known[0] = False
    idx[8:] = [np.where(known[i], i, 0) for i in idx[8:]]
    fixed = [np.ones(k, bool) for k in _SIZES]
    for mask in fixed[8:]:
        mask[0] = False
    allowed = moves > _FORBIDDEN / 2
    params = [*(np.zeros((k, 2)) for k in _SIZES), moves]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    tagged = np.stack([want == 1, want == 2], axis=1).astype(float)
    seen = np.zeros((3, 3))
    for k in range(n):
        path = [0, *want[f.first[k] : f.first[k + 1]], 0]
        np.add.at(seen, (path[:-1], path[1:]), 1)
    for step in range(1, rounds + 1):
        score = sum(t[i] for t, i in zip(params[:-1], idx))
        marginal, expected = _marginals(score, grid, params[-1])
        miss = tagged - marginal
        grads = [np.stack([np.bincount(i, miss[:, tag], minlength=k) for tag in range(2)], axis=1) * on[:, None] for i, k, on in zip(idx, _SIZES, fixed)] + [np.where(allowed, seen - expected, 0)]
        for j, g in enumerate(grads):
            g = g / n - decay * np.where(params[j] > _FORBIDDEN / 2, params[j], 0)
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.99 * second[j] + 0.01 * g * g
            params[j] = params[j] + rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-8)
            if j == len(grads) - 1:
                params[j] = np.where(allowed, params[j], _FORBIDDEN)
    return Field(tuple(p.astype(np.float32) for p in params[:-1]), params[-1])


def _marginals(score: np.ndarray, grid: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward over all chains at once: each token's chances of B and I, expected transitions."""
    n, length = grid.shape
    emit = np.zeros((n, length, 3))
    emit[:, :, 1:] = np.where((grid >= 0)[:, :, None], score[grid], 0)
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    ahead = np.zeros((length + 1, n, 3))
    ahead[0] = [0, _FORBIDDEN, _FORBIDDEN]
    for t in range(length):
        new = lse(ahead[t][:, :, None] + moves[None], 1) + emit[:, t]
        ahead[t + 1] = np.where(grid[:, t, None] >= 0, new, ahead[t])
    back = np.zeros((length + 1, n, 3))
    back[length] = moves[:, 0]
    for t in range(length - 1, -1, -1):
        new = lse(moves[None] + (emit[:, t] + back[t + 1])[:, None, :], 2)
        back[t] = np.where(grid[:, t, None] >= 0, new, back[t + 1])
    total = lse(ahead[length] + moves[:, 0], 1)
    chance, expected = np.zeros(score.shape), np.zeros((3, 3))
    for t in range(length):
        on = grid[:, t] >= 0
        post = np.exp(ahead[t + 1] + back[t + 1] - total[:, None])
        chance[grid[on, t]] = post[on, 1:]
        pair = np.exp(ahead[t][:, :, None] + moves[None] + (emit[:, t] + back[t + 1])[:, None, :] - total[:, None, None])
        expected += pair[on].sum(axis=0)
    expected[:, 0] += np.exp(ahead[length] + moves[:, 0] - total[:, None]).sum(axis=0)
    return chance, expected


# ---- the scan

SCHEMA = "doc_id long, spans array<struct<start:long,end:long,kind:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
_GATES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")


def scan_slice(raw: np.ndarray, offs: np.ndarray, field: Field) -> list[list[dict]]:
    """Spans of each text of a slice."""
    f = features(raw, offs)
    tags = decode(field.scores(f), f.first, field)
    long_ = np.searchsorted(f.first, np.flatnonzero(f.ends - f.starts >= 16), "right") - 1
    hits = np.flatnonzero(tags)
    owner = np.searchsorted(f.first, hits, "right") - 1
    look = np.zeros(len(offs) - 1, bool)
    look[long_] = look[owner] = True
    view, out = memoryview(raw), []
    by_text = {}
    for h, k in zip(hits.tolist(), owner.tolist()):
        by_text.setdefault(k, []).append(h)
    for k in range(len(offs) - 1):
        body = bytes(view[offs[k] : offs[k + 1]])
        lower = body.lower()
        if not look[k] and not any(g in lower for g in _GATES):
            out.append([])
            continue
        text = body.decode("utf-8", "replace")
        found = base_spans(text)
        own = []
        for h in by_text.get(k, ()):
            a, b = int(f.starts[h] - offs[k]), int(f.ends[h] - offs[k])
            if tags[h] == 2 and own:
                own[-1][1] = b
            else:
                own.append([a, b])
        for a, b in own:
            a, b = len(body[:a].decode("utf-8", "replace")), len(body[:b].decode("utf-8", "replace"))
            if not any(x < b and a < y for x, _, y in found):
                found.append((a, 3, b))
        out.append([{"start": a, "end": b, "kind": KINDS[kind]} for a, kind, b in sorted(found)])
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and all spans (code points, end exclusive), base and the field's; one row a document."""
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [s for _, _, raw, offs in slices(batch.column(1)) for s in scan_slice(raw, offs, field)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN)], names=["doc_id", "spans"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA)


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count("crf").alias("n_crf"),
    )
