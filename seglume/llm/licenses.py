"""License scans by ordered signature rules.

A text becomes lower-case words (letters, digits and what is not ASCII). Rules are regexes over the words joined by
single spaces, each gated by a keyword that must stand there first; a text without any gate's words costs one pass.
Hand-written signatures (``license_texts``) tell licenses by sentences of their own; beside them, names of licenses are
told in their forms of mention (identifier tag, address, full title, grant, bare name). All are ordered by priority.
Where detections overlap, one that lies within the interval of a kept one of higher priority (then longer, then earlier)
is suppressed; others stand beside each other. Time grows with the text and its detections, not with their square.

Base phrases are kept whatever else is found. Their places are counted separately.

Nulls: a null text is empty: no words, no labels, score 0; a null id stays null. Repeated rows stay. Very long texts
are scanned whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seglume.llm.license_texts import SIGNATURES
from seglume.llm.textbytes import MARKS, buffers, map_texts

#: Phrases whose places are counted, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Families: label stem, keyword, name as a regex over words, versions (empty: none), identifiers in tags.
FAMILIES = (
    ("mit", "mit", r"(?:the )?mit(?: x11| expat)?", (), "mit"),
    ("apache", "apache", r"(?:the )?apache(?: software)?", ("1", "1 1", "2"), "apache"),
    ("gpl", "general", r"(?:the )?(?:gnu )?general public", ("1", "2", "3"), "gpl"),
    ("gpl", "gpl", r"(?:the )?(?:gnu )?gpl", ("1", "2", "3"), "gpl"),
    ("lgpl", "lesser", r"(?:the )?(?:gnu )?lesser general public", ("2 1", "3"), "lgpl"),
    ("lgpl", "library", r"(?:the )?(?:gnu )?library general public", ("2",), "lgpl"),
    ("lgpl", "lgpl", r"(?:the )?(?:gnu )?lgpl", ("2", "2 1", "3"), "lgpl"),
    ("agpl", "affero", r"(?:the )?(?:gnu )?affero general public", ("1", "3"), "agpl"),
    ("agpl", "agpl", r"(?:the )?(?:gnu )?agpl", ("1", "3"), "agpl"),
    ("gfdl", "documentation", r"(?:the )?(?:gnu )?free documentation", ("1 1", "1 2", "1 3"), "gfdl"),
    ("bsd-2", "bsd", r"(?:the )?(?:simplified|freebsd|2 clause|two clause) bsd", (), "bsd 2 clause"),
    ("bsd-3", "bsd", r"(?:the )?(?:new|modified|revised|3 clause|three clause) bsd", (), "bsd 3 clause"),
    ("bsd-4", "bsd", r"(?:the )?(?:original|4 clause|four clause) bsd", (), "bsd 4 clause"),
    ("bsd", "bsd", r"(?:the )?bsd(?: style)?", (), "0bsd"),
    ("mpl", "mozilla", r"(?:the )?mozilla public", ("1", "1 1", "2"), "mpl"),
    ("epl", "eclipse", r"(?:the )?eclipse public", ("1", "2"), "epl"),
    ("eupl", "european", r"(?:the )?european union public", ("1", "1 1", "1 2"), "eupl"),
    ("cddl", "common", r"(?:the )?common development and distribution", ("1", "1 1"), "cddl"),
    ("cpl", "common", r"(?:the )?common public", ("1",), "cpl"),
    ("ipl", "ibm", r"(?:the )?ibm public", ("1",), "ipl"),
    ("isc", "isc", r"(?:the )?isc", (), "isc"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?", (), "zlib"),
    ("boost", "boost", r"(?:the )?boost software", ("1",), "bsl"),
    ("artistic", "artistic", r"(?:the )?(?:perl )?artistic", ("1", "2"), "artistic"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", (), "unlicense"),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl", ("1", "2"), "wtfpl"),
    ("python", "python", r"(?:the )?python(?: software foundation)?", ("2",), "psf"),
    ("ruby", "ruby", r"(?:the )?ruby", (), "ruby"),
    ("php", "php", r"(?:the )?php", ("3", "3 01"), "php"),
    ("postgresql", "postgresql", r"(?:the )?postgresql", (), "postgresql"),
    ("openssl", "openssl", r"(?:the )?openssl", (), "openssl"),
    ("ofl", "font", r"(?:the )?(?:sil )?open font", ("1", "1 1"), "ofl"),
    ("odbl", "database", r"(?:the )?open database", ("1",), "odbl"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public", (), "ms pl"),
    ("ms-rl", "microsoft", r"(?:the )?microsoft reciprocal", (), "ms rl"),
    ("osl", "open", r"(?:the )?open software", ("1", "2", "2 1", "3"), "osl"),
    ("afl", "academic", r"(?:the )?academic free", ("1 1", "1 2", "2", "2 1", "3"), "afl"),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois )?ncsa(?: open source)?", (), "ncsa"),
    ("upl", "permissive", r"(?:the )?universal permissive", ("1",), "upl"),
    ("bsl", "business", r"(?:the )?business source", ("1", "1 1"), "busl"),
    ("sspl", "server", r"(?:the )?server side public", ("1",), "sspl"),
    ("elastic", "elastic", r"(?:the )?elastic", ("1", "2"), "elastic"),
    ("qpl", "public", r"(?:the )?q public", ("1",), "qpl"),
    ("lppl", "latex", r"(?:the )?latex project public", ("1", "1 1", "1 2", "1 3"), "lppl"),
    ("vim", "vim", r"(?:the )?vim", (), "vim"),
    ("x11", "x11", r"(?:the )?x11", (), "x11"),
    ("blueoak", "blue", r"(?:the )?blue oak model", ("1",), "blueoak"),
    ("cecill", "cecill", r"(?:the )?cecill", ("1", "1 1", "2", "2 1"), "cecill"),
)
#: Creative Commons: parts, and their words in a full title.
COMMONS = (
    ("by", "attribution"),
    ("by-sa", "attribution sharealike|attribution share alike"),
    ("by-nd", "attribution noderivatives|attribution no derivatives|attribution noderivs"),
    ("by-nc", "attribution noncommercial|attribution non commercial"),
    ("by-nc-sa", "attribution noncommercial sharealike|attribution non commercial share alike"),
    ("by-nc-nd", "attribution noncommercial noderivatives|attribution noncommercial noderivs|attribution non commercial no derivatives"),
)
VERSION_OF_COMMONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
GRANT = r"(?:licen[sc]ed|released|distributed|published|available|provided|covered|relicensed)(?: \w+){0,2} under(?: the)?(?: terms of)?(?: the)? "
#: Words of an address before the part that names the license.
SITES = {"apache": "apache org licenses", "gpl": "gnu org licenses", "lgpl": "gnu org licenses", "agpl": "gnu org licenses", "gfdl": "gnu org licenses", "mpl": "mozilla org mpl", "mit": "opensource org licenses", "epl": "eclipse org legal"}
@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    weight: float


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    made = []

    def rule(label: str, keyword: str, body: str, priority: int, weight: float) -> None:
        made.append(Rule(label, keyword.encode(), re.compile(f"(?<= )(?:{body})(?= )".encode()), priority, weight))

    for stem, keyword, name, versions, tag in FAMILIES:
        for v in (*versions, ""):
            label = f"{stem}-{v.replace(' ', '.')}" if v else stem
            number = f" (?:version |v ?)?{v}(?: 0)?" if v else ""
            more = 10 if v else 0
            later = "(?: or later| or any later version)?"
            rule(label, "spdx", f"spdx license identifier {tag}{f' {v}(?: 0)?' if v else ''}(?: only| or later)?", 90 + more, 0.99)
            rule(label, keyword, f"{GRANT}{name}(?: licen[sc]e)?{number}{later}", 70 + more, 0.95)
            rule(label, keyword, f"{name} licen[sc]e{number}{later}", 50 + more, 0.85)
            if v:
                rule(label, keyword, f"{name}{number} licen[sc]e", 55, 0.85)
            if stem in SITES:
                rule(label, "licenses" if "licenses" in SITES[stem] else stem, f"{SITES[stem]} (?:license )?(?:old licenses )?{tag}{f' {v}' if v else ''}(?: 0)?", 80 + more, 0.95)
    for parts, title in COMMONS:
        words = parts.replace("-", " ")
        for v in (*VERSION_OF_COMMONS, ""):
            label = f"cc-{parts}" + (f"-{v.replace(' ', '.')}" if v else "")
            number, more = (f" (?:version )?{v}", 10) if v else ("", 0)
            longer = len(parts)  # by-nc-sa before by-nc before by, where they begin alike
            rule(label, "spdx", f"spdx license identifier cc {words}{number}", 90 + more + longer, 0.99)
            rule(label, "cc", f"{GRANT}(?:an? )?cc {words}{number}", 70 + more + longer, 0.95)
            rule(label, "cc", f"cc {words}{number}", 50 + more + longer, 0.8)
            rule(label, "commons", f"creative commons (?:{title})(?: licen[sc]e)?{number}", 60 + more + longer, 0.9)
            rule(label, "creativecommons", f"creativecommons org licenses {words}{number}", 80 + more + longer, 0.95)
    for label, keyword, body, priority in SIGNATURES:
        rule(label, keyword, body, priority, priority / 100)
    return tuple(sorted(made, key=lambda r: -r.priority))


@cache
def keywords() -> dict[bytes, tuple[int, ...]]:
    found: dict[bytes, list[int]] = {}
    for i, r in enumerate(rules()):
        found.setdefault(r.keyword, []).append(i)
    return {k: tuple(v) for k, v in found.items()}


#: One of these is in every text that the name of a license or a base phrase can match.
NAME_GATES = (b"licen", b"spdx", b" cc ", b"creative commons", b"creativecommons org", b"gpl", b" under ", b"mozilla org", b"eclipse org", b"gnu org")


@cache
def gates() -> tuple[bytes, ...]:
    """One of these stands in the joined words wherever a rule or base phrase can match, so most texts stop here: the gates
    of names, and the words of those signatures that have none of them."""
    own = {keyword.encode() for _, keyword, _, _ in SIGNATURES}
    return (*NAME_GATES, *sorted(k for k in own if not any(g in b" " + k + b" " for g in NAME_GATES)))


_WORDS = bytes(32 if i in MARKS else i + 32 if 65 <= i <= 90 else i for i in range(256))


def places(joined: bytes, phrase: str) -> list[int]:
    """Byte offsets in `` w1 w2 ... `` where the phrase's words stand."""
    want, out, at = f" {phrase} ".encode(), [], -1
    while (at := joined.find(want, at + 1)) >= 0:
        out.append(at + 1)
    return out


def uncovered(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, rule), best first: those that lie in no kept interval before them. Kept intervals that no other kept
    one covers have starts and ends in the same order, so the last that begins no later has the furthest end."""
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for a, b, i in hits:
        k = bisect_right(starts, a)
        if k and ends[k - 1] >= b:
            continue
        kept.append((a, b, i))
        # what this interval covers no longer matters
        low, high = bisect_left(starts, a), bisect_right(ends, b)
        starts[low:high], ends[low:high] = [a], [b]
    return kept


def detect(joined: bytes) -> list[tuple[int, int, Rule]]:
    """Kept detections (start, end, rule) in bytes of the joined words, highest priority first."""
    hits = []
    for keyword, which in keywords().items():
        if keyword in joined:
            for i in which:
                hits += [(m.start(), m.end(), i) for m in rules()[i].pattern.finditer(joined)]
    hits.sort(key=lambda h: (-rules()[h[2]].priority, h[0] - h[1], h[0], h[2]))
    return [(a, b, rules()[i]) for a, b, i in uncovered(hits)]


def scan_text(text: bytes) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, int, float]]]:
    """Number of words; base places and detections as (first word, words, label, ...)."""
    words = text.translate(_WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    if not any(g in joined for g in gates()):
        return len(words), [], []
    base = [(i, len(p.split()), label) for p, label in BASE.items() for i in places(joined, p)]
    found = detect(joined)
    if not base and not found:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    at = lambda i: int(np.searchsorted(spaces, i)) - 1
    return len(words), [(at(i), n, label) for i, n, label in base], [(at(a), at(b) - at(a) + 1, r.label, r.priority, r.weight) for a, b, r in found]


SCHEMA = (
    "doc_id long, n_words long, base array<struct<word:long,words:long,label:string>>, "
    "detections array<struct<word:long,words:long,label:string,priority:int,weight:double>>"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("base", pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))),
        ("detections", pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("weight", pa.float64())]))),
    ]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [[f.name for f in _ARROW.field(k).type.value_type] for k in (2, 3)]
    for batch in batches:
        raw, offs = buffers(batch.column(1))
        view = memoryview(raw)
        rows = [scan_text(bytes(view[a:b])) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        cols = [pa.array([[dict(zip(names[k], x)) for x in r[k + 1]] for r in rows], _ARROW.field(k + 2).type) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), *cols], schema=_ARROW)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base places and kept detections; one row a document."""
    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), _scan, SCHEMA)


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    own = F.transform("base", lambda x: x["label"])
    every = F.concat(own, F.transform("detections", lambda x: x["label"]))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    # the chance that all detections err; a base phrase counts as one of weight 0.95
    doubt = F.aggregate("detections", F.lit(1.0), lambda acc, x: acc * (1 - x["weight"])) * F.when(F.size("base") > 0, 0.05).otherwise(1.0)
    start = F.transform("base", lambda x: x["word"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(every).alias("labels"),
        (1 - doubt).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
