"""Texts that need a parser: JSON that a model broke, scripts in several grammars, numerals, sentence splitting,
dictionaries. Plain functions; ``arrays`` and ``texts`` make columns functions of them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# ---- JSON


def close_json(text: str, most: int = 40) -> str | None:
    """The longest beginning of a broken-off text that becomes JSON when its open brackets are closed; tries the last
    ``most`` places where a value may end."""
    ends = [i for i, c in enumerate(text) if c in "}]\""][-most:]
    for end in reversed(ends):
        head, stack, quoted, skip = text[: end + 1], [], False, False
        for c in head:
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
        if quoted:
            continue
        whole = head.rstrip().rstrip(",") + "".join(reversed(stack))
        try:
            json.loads(whole)
        except ValueError:
            continue
        return whole
    return None


def load_json(text: str | None) -> Any:
    """A value out of a model's answer: plain, in a code fence, among other words, with trailing commas, broken off, or
    object by object; None where nothing can be read."""
    body = (text or "").strip()
    fence = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", body, re.S)
    body = fence[1].strip() if fence else body
    begin = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return None
    body = body[begin:]
    for attempt in (body, re.sub(r",\s*([}\]])", r"\1", body)):
        try:
            return json.JSONDecoder().raw_decode(attempt)[0]
        except ValueError:
            pass
    closed = close_json(re.sub(r",\s*([}\]])", r"\1", body))
    if closed:
        return json.loads(closed)
    found = []
    for m in re.finditer(r"\{[^{}]*\}", body):
        try:
            found.append(json.loads(re.sub(r",\s*}", "}", m[0])))
        except ValueError:
            pass
    return found or None


def json_text(text: str | None) -> str | None:
    """``load_json`` as canonical JSON, so that ``from_json`` reads the rest."""
    value = load_json(text)
    return None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


# ---- scripts

_LINES = (
    re.compile(r"^\[(?P<role>[^\]]+)\]\s*\((?P<s>\d+(?:\.\d+)?)\s*-\s*(?P<e>\d+(?:\.\d+)?)\)\s*:\s*(?P<text>.+)$"),
    re.compile(r"^\[?(?P<n>\d+)\]?\s*[.:)\-|]\s*(?:\[(?P<role>[^\]]+)\]\s*:?)?\s*(?P<text>.+)$"),
    re.compile(r"^(?P<role>[^\W\d][\w ]{0,30}?)\s*:\s*(?P<text>.+)$"),
    re.compile(r"^(?P<text>.+)$"),
)


def parse_script(raw: str | None) -> list[dict]:
    """Rows of a script: JSON first (a list, or an object that holds one), else each line by the first grammar that
    fits: speaker and times, number, speaker, bare text. Rows have n, role, src, text."""
    value = load_json(raw) if re.search(r"[{\[]\s*[\"{\[]", raw or "") else None
    if isinstance(value, dict):
        value = next((v for v in value.values() if isinstance(v, list)), None)
    out = []
    if isinstance(value, list) and any(isinstance(x, dict) for x in value):
        for x in value:
            if not isinstance(x, dict):
                continue
            text = next((str(x[k]) for k in ("vi", "viet", "text", "translation") if x.get(k)), "")
            src = x.get("src")
            src = [int(i) for i in src if str(i).isdigit()] if isinstance(src, list) else [int(src)] if str(src).isdigit() else []
            if text.strip():
                out.append({"n": len(out) + 1, "role": str(x.get("role") or x.get("speaker") or "") or None, "src": src, "text": text.strip()})
        return out
    for line in (raw or "").splitlines():
        line = line.strip()
        if not line or line.startswith("```"):
            continue
        m = next(m for g in _LINES if (m := g.match(line)))
        own = m.groupdict()
        out.append({"n": int(own["n"]) if own.get("n") else len(out) + 1, "role": own.get("role"), "src": [], "text": own["text"].strip()})
    return out


# ---- numerals

#: Han digits and units.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
MYRIAD = "万"


def numeral(run: str) -> str:
    """A run of Han numerals in Arabic digits: by value, or digit by digit where no unit is in it."""
    if not any(c in UNITS or c == MYRIAD for c in run):
        return "".join(str(DIGITS[c]) for c in run)
    high, _, low = run.rpartition(MYRIAD)

    def below(part: str) -> int:
        total, digit = 0, 0
        for c in part:
            if c in DIGITS:
                digit = DIGITS[c]
            else:
                total, digit = total + (digit or 1) * UNITS[c], 0
        return total + digit

    if MYRIAD not in run:
        return str(below(run))
    return str(sum((below(p) or 1) * 10_000 for p in high.split(MYRIAD)) + below(low))


_RUN = re.compile("[" + "".join(DIGITS) + "".join(UNITS) + MYRIAD + "]+")


def arabic_numerals(text: str | None) -> str:
    return _RUN.sub(lambda m: numeral(m[0]), text or "")


# ---- splitting

#: Abbreviations whose dot ends no sentence; the letter of one that may be spelled with spaces.
ABBREVIATIONS = set("tp mr mrs ms dr gs pgs ts ths ks bs".split())
SPACED_LETTER = "v"

_SCAN = re.compile(r"(?P<end>[.!?\n]+|…+)|(?P<mid>[;,:—–]+)")


def _initial(text: str, dot: int) -> tuple[int, str]:
    """(where it stands, letter) of the single letter that a dot belongs to; (dot, "") without one."""
    at = dot - 1
    while at >= 0 and text[at].isspace():
        at -= 1
    alone = at >= 0 and text[at].isalpha() and not (at and text[at - 1].isalnum())
    if not alone or (at < dot - 1 and text[at].lower() != SPACED_LETTER):
        return dot, ""
    return at, text[at].lower()


def _chained(text: str, dot: int) -> bool:
    """Whether a dot and the one after it are those of two initials; only the spelled abbreviation has spaces in it."""
    _, letter = _initial(text, dot)
    other = text.find(".", dot + 1, dot + 12)
    if not letter or other < 0:
        return False
    at, follower = _initial(text, other)
    gap = text[dot + 1 : at]
    return bool(follower) and (not gap or (gap.isspace() and letter == follower == SPACED_LETTER))


def within_word(text: str, dot: int) -> bool:
    """Whether a dot ends no sentence, by what stands beside it: digits on both sides, another initial before or after its
    own, an abbreviation before it and a word after it."""
    before, after = text[dot - 1 : dot] if dot else "", text[dot + 1 : dot + 2]
    if before.isdigit() and after.isdigit():
        return True
    earlier = text.rfind(".", 0, dot)
    if _chained(text, dot) or (earlier >= 0 and _chained(text, earlier) and _initial(text, dot)[1]):
        return True
    begin = dot
    while begin and text[begin - 1].isalpha():
        begin -= 1
    word_after = text[dot + 2 : dot + 3] if after.isspace() else after
    return text[begin:dot].lower() in ABBREVIATIONS and word_after.isalnum()


def _packed(parts: Iterable[str], joins: Callable[[list[str], str], bool]) -> list[str]:
    """Neighbours put together, each group going on as long as ``joins`` says so."""
    groups: list[list[str]] = []
    for part in parts:
        if groups and joins(groups[-1], part):
            groups[-1].append(part)
        else:
            groups.append([part])
    return [" ".join(g) for g in groups]


def _sentences(text: str) -> Iterator[tuple[str, list[str]]]:
    """(sentence, its clauses), each with its mark after a space. A hesitation (at most two words before dots that go on)
    opens the sentence after it."""
    spaced = lambda a, b: f"{a.strip()} {b.strip()}".strip()
    opened, begin, at, clauses, goes_on = "", 0, 0, [], False
    for m in (*_SCAN.finditer(text), None):
        if m and m[0] == "." and within_word(text, m.start()):
            continue
        stop, mark = (m.start(), m[0].strip()) if m else (len(text), "")
        if opened.endswith(mark) and not text[begin:stop].strip():
            mark = ""  # the same mark again, after white space
        clause = spaced(text[at:stop], mark)
        if goes_on and clauses:
            clause = spaced(clauses.pop(), clause)
        clauses += [clause] if clause else []
        at, goes_on = (m.end() if m else stop), False
        if m and m.lastgroup == "mid":
            continue
        body = spaced(opened, text[begin:stop])
        whole = spaced(body, mark)
        goes_on = bool(m) and (m[0].strip().startswith("..") or "…" in m[0]) and len(body.split()) <= 2
        begin = at
        if goes_on:
            opened = whole
            continue
        if whole:
            yield whole, clauses
        opened, clauses = "", []


def split_sentences(text: str | None, max_words: int = 25, max_chars: int = 180, hard: bool = False) -> list[str]:
    """Sentences by their marks (not by the dots of abbreviations and decimals); long ones part again at middle marks,
    packed greedily; with ``hard`` also between words. A hesitation of at most two words stays with what follows. Pieces
    without a letter or digit go."""
    fits = lambda x: len(x) <= max_chars and len(x.split()) <= max_words
    within = lambda held, part: fits(" ".join([*held, part]))

    def beside(held: list[str], word: str) -> bool:
        capital = word[0].isupper() and not held[-1][0].isupper() and len(held) >= max(6, max_words // 2)
        return within(held, word) and not capital

    out: list[str] = []
    for sentence, clauses in _sentences((text or "").strip()):
        if fits(sentence):
            out.append(sentence)
            continue
        for short, group in groupby(clauses, key=fits):
            out += _packed(group, within) if short else chain.from_iterable(_packed(c.split(), beside) if hard else [c] for c in group)
    return [x for x in out if any(map(str.isalnum, x))]


SENTENCE, MIDDLE, NO_MARK = 1, 2, 0
#: Marks that end a chunk: level, and how it stands with digits ("between": no mark between two digits; "beside": none
#: beside a digit, but before white space or the end; "free": always a mark).
CHUNK_MARKS = {
    **dict.fromkeys("!?…", (SENTENCE, "free")),
    **dict.fromkeys(".", (SENTENCE, "beside")),
    **dict.fromkeys(":：", (SENTENCE, "between")),
    **dict.fromkeys(",，;；", (MIDDLE, "beside")),
    **dict.fromkeys("—–", (MIDDLE, "free")),
}
_MARK_RUN = re.compile(r"\.{3,}|[!?]+|[" + re.escape("".join(CHUNK_MARKS)) + "]")


def text_chunks(text: str) -> list[tuple[str, int]]:
    """(chunk, level of the mark that ends it: 1 sentence, 2 middle, 0 none)."""
    cuts = []
    for m in _MARK_RUN.finditer(text):
        level, rule = CHUNK_MARKS[m[0][0]]
        digit_before, after = text[: m.start()][-1:].isdigit(), text[m.end() : m.end() + 1]
        blocked = {"free": False, "between": digit_before and after.isdigit(), "beside": (digit_before or after.isdigit()) and bool(after.strip())}
        if len(m[0]) > 2 or not blocked[rule]:
            cuts.append((m.end(), level))
    begins = [0, *(end for end, _ in cuts)]
    pieces = ((text[a:b].strip(), level) for a, (b, level) in zip(begins, [*cuts, (len(text), NO_MARK)]))
    return [(piece, level) for piece, level in pieces if piece]


#: The cost of dealing chunks to segments: a weight of the squared relative error in words, and what it costs to let a
#: segment go on over the end of a chunk, by the level of its mark.
ERROR_WEIGHT = 10.0
OVER_MARK = {SENTENCE: 1000.0, MIDDLE: 2.0, NO_MARK: 20.0}


def demerge(text: str, durations: list[float]) -> list[str]:
    """Deals the chunks of a text to segments in order: one each while there are enough segments, else by the cheapest
    partition into stretches under the cost above. One step a segment, each over all (from, to) at once; of equal costs
    the earlier cut counts."""
    chunks, n = text_chunks(text) or [(text.strip(), SENTENCE)], len(durations)
    m = len(chunks)
    if m <= n:
        return [c for c, _ in chunks] + [""] * (n - m)
    words = np.concatenate([[0], np.cumsum([max(1, len(c.split())) for c, _ in chunks])])
    crossed = np.concatenate([[0], np.cumsum([OVER_MARK[level] for _, level in chunks])])
    wanted = np.array(durations) / max(0.1, sum(durations)) * words[-1]
    a, b = np.arange(m + 1)[:, None], np.arange(m + 1)[None, :]
    over = np.where(a < b, crossed[np.maximum(b - 1, 0)] - crossed[a], np.inf)
    cost, came = np.where(np.arange(m + 1) == 0, 0.0, np.inf), []
    for want in wanted:
        step = cost[:, None] + ERROR_WEIGHT * ((words[b] - words[a] - want) / max(1.0, want)) ** 2 + over
        came.append(step.argmin(axis=0))
        cost = step.min(axis=0)
    cuts = [m]
    for back in reversed(came):
        cuts.append(int(back[cuts[-1]]))
    cuts.reverse()
    return [" ".join(c for c, _ in chunks[i:j]) for i, j in zip(cuts, cuts[1:])]


def cut_at_gap(text: str, before: int, after: int) -> tuple[str, str] | None:
    """Parts a text where a silent gap falls: near the share of characters before it, best at a sentence's end, then at a
    middle mark, else between words; never within a number. None for fewer than two words."""
    words = text.split()
    if len(words) < 2:
        return None
    want = len(words) * before / max(1, before + after)

    def cost(i: int) -> float:
        end = words[i - 1][-1]
        inside = words[i - 1][-1].isdigit() and words[i][0].isdigit()
        return abs(i - want) - (3.5 if end in ".!?…" else 1.5 if end in ",;:—" else 0) + (100 if inside else 0)

    i = min(range(1, len(words)), key=lambda k: (cost(k), k))
    return " ".join(words[:i]), " ".join(words[i:])


# ---- dictionaries

@dataclass
class Matcher:
    """Longest matches of a dictionary's phrases, left to right, found in one pass through a tree of characters."""

    root: dict = field(default_factory=dict)
    longest: int = 0

    @classmethod
    def of(cls, phrases: dict[str, str]) -> Matcher:
        out = cls()
        for phrase, value in phrases.items():
            at = out.root
            for c in phrase.lower():
                at = at.setdefault(c, {})
            at.setdefault("", value)  # of phrases that differ in case only the first counts
            out.longest = max(out.longest, len(phrase))
        return out

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, text, value); a match of Latin letters must not begin or end within a word."""
        lower, out, i = text.lower(), [], 0
        latin = lambda k: 0 <= k < len(text) and text[k].isalnum() and text[k] < "⺀"
        while i < len(lower):
            at, hit = self.root, None
            for j in range(i, len(lower)):
                if (at := at.get(lower[j])) is None:
                    break
                if "" in at and not (latin(i) and latin(i - 1)) and not (latin(j) and latin(j + 1)):
                    hit = (i, j + 1, text[i : j + 1], at[""])
            if hit:
                out.append(hit)
                i = hit[1]
            else:
                i += 1
        return out

    def replace(self, text: str, unknown: Callable[[str], str] = lambda c: c) -> str:
        out, at = [], 0
        for a, b, _, value in self.find(text):
            out += [unknown(c) for c in text[at:a]] + [value]
            at = b
        return "".join(out + [unknown(c) for c in text[at:]])


def replace_once(text: str, rules: list[tuple[str, str]]) -> str:
    """All replacements in a single pass, the longest first; keys of one character are left out, of equal keys the first
    counts. What a replacement brings in is not replaced again."""
    first: dict[str, str] = {}
    for old, new in rules:
        if len(old) >= 2:
            first.setdefault(old, new)
    if not first:
        return text
    return re.sub("|".join(re.escape(k) for k in sorted(first, key=len, reverse=True)), lambda m: first[m[0]], text)


# ---- columns

def texts(function: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A function of a text for columns; nulls count as empty."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([function(v) for v in x.fillna("")], dtype=object)

    return run


def arrays(function: Callable[[str], list], kind: str = "string") -> Callable[[Column], Column]:
    """A function from a text to a list of values or structs, for columns."""

    @F.pandas_udf(f"array<{kind}>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([function(v) for v in x.fillna("")], dtype=object)

    return run
