"""Text functions as column expressions: they stay in the JVM and in whole-stage code generation.

Patterns are Java's; ``(?U)`` makes letters, digits and white space those of Unicode. Null texts count as empty unless a
function says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def _col(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def replace_all(text: str | Column, *rules: tuple[str, str]) -> Column:
    """Regex replacements one after another."""
    out = _col(text)
    for pattern, new in rules:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(new))
    return out


def squeeze(text: str | Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(replace_all(text, (r"(?U)\s+", " ")))


#: Sound tags that speech recognition writes.
SOUND_TAGS = "music|laughter|applause|singing|silence|blank_audio"


def clean_speech(text: str | Column, spaces: bool = True) -> Column:
    """Without sound tags; white space squeezed, or dropped for scripts that have none."""
    bare = replace_all(text, (rf"(?i)\[(?:{SOUND_TAGS})\]|\((?:{SOUND_TAGS})\)", ""))
    return squeeze(bare) if spaces else replace_all(bare, (r"(?U)\s+", ""))


#: Brackets around a line's number, words before it, marks after it.
NUMBER_BRACKETS = ("[]", "()", "{}", "【】")
NUMBER_WORDS = ("câu", "thoại", "đoạn", "stt", "dòng", "line")
NUMBER_ENDS = ".:-–—"


def _numbering() -> tuple[str, ...]:
    """A number in brackets, after a word, of a total, or before a mark; a later form is tried on what is left."""
    quoted = lambda marks: "".join(rf"\{c}" for c in marks)
    boxed = "|".join(rf"\{a}\s*\d+\s*\{b}" for a, b in NUMBER_BRACKETS)
    loose, closed = f"[{quoted(NUMBER_ENDS)}\\s]*", quoted(NUMBER_ENDS + ")/]")
    return rf"^(?:{boxed}){loose}", rf"(?iu)^(?:{'|'.join(NUMBER_WORDS)})\s*\d+\s*[{closed}\s]*", rf"^\d+/\d+\s*{loose}", rf"^\d+\s*[{closed}]+\s*"


NUMBERING = _numbering()


def strip_numbering(text: str | Column) -> Column:
    """Without a leading number of a line, in any of five forms."""
    return F.trim(replace_all(F.trim(_col(text)), *((p, "") for p in NUMBERING), (r"(?U)^[^\w\s(\[{]+", "")))


def clean_for_voice(text: str | Column) -> Column:
    """A line to be spoken: no numbering, single spaces, no doubled commas and stops but the ellipsis."""
    return replace_all(
        strip_numbering(text), (r"(?U)\s+", " "), (r",[,.\s]*,", ","), (r",\.+", "."), (r"\.,+", ","), (r"\.{4,}", "..."), (r"(?<!\.)\.\.(?!\.)", ".")
    )


#: A letter of the Han script, and marks that end a spoken line.
HAN = r"[一-鿿]"
ENDED = r"[.!?,:;…—\-]$"


def has_han(text: str | Column) -> Column:
    return _col(text).rlike(HAN)


def strip_han(text: str | Column) -> Column:
    return F.trim(replace_all(text, (HAN, "")))


def end_mark(text: str | Column) -> Column:
    """With a stop at the end, unless a mark is there."""
    t = F.trim(_col(text))
    return F.when(t.rlike(ENDED), t).otherwise(F.concat(t, F.lit(".")))


def key_text(text: str | Column) -> Column:
    """For comparing source texts: no numbering, letters of Han and Latin script and digits only, lower case."""
    bare = replace_all(text, (r"^\s*\[\d+\][.:\s]*", ""), (r"^\s*\d+[.:\-]\s+", ""))
    return F.lower(replace_all(bare, (r"[^一-鿿A-Za-z0-9]", "")))


#: Tags for the system within a script: locks, lengths, limits, stage directions.
SYSTEM_TAGS = r"(?iu)\[(?:lock|khóa|dur|duration|max|limit|id|idx)[^\]]*\]|\((?:lock|dur|duration|max|limit)[^)]*\)|<[^<>]{1,40}>"


def strip_system_tags(text: str | Column) -> Column:
    return squeeze(replace_all(text, (SYSTEM_TAGS, " ")))


def sentence(text: str | Column, source: str | Column) -> Column:
    """A clean sentence: no tags or numbering, an end mark (its own, else the source's, else a stop), a capital first."""
    bare = strip_numbering(strip_system_tags(text))
    mark = F.regexp_extract(F.trim(_col(source)), r"([.!?…。！？])$", 1)
    mark = F.translate(F.when(mark == "", F.lit(".")).otherwise(mark), "。！？", ".!?")
    full = F.when(bare.rlike(r"[.!?…]$"), bare).otherwise(F.concat(F.regexp_replace(bare, r"[,;:\s]+$", ""), mark))
    return F.when(bare == "", bare).otherwise(F.concat(F.upper(F.substring(full, 1, 1)), F.substr(full, F.lit(2))))


#: Names for the narrator.
NARRATOR = ("narrator", "narration", "người kể", "người kể chuyện", "dẫn truyện", "nar")


def role(text: str | Column) -> Column:
    """Synonyms of the narrator become NARRATOR; a single letter becomes a part's name."""
    t = F.trim(_col(text))
    return F.when(F.lower(t).isin(*NARRATOR) | (t == ""), F.lit("NARRATOR")).when(t.rlike(r"^[A-Za-z]$"), F.concat(F.lit("Vai "), F.upper(t))).otherwise(t)


#: Marks after which a clause ends.
CLAUSE_ENDS = ",;:.!?…—–"


def clauses(text: str | Column) -> Column:
    """Clauses with their marks, in order: a cut after each run of marks; marks before any word go, unless they are all
    there is."""
    marks = f"[{CLAUSE_ENDS}]"
    bare = F.regexp_replace(_col(text), rf"^{marks}+(?=[^{CLAUSE_ENDS}])", "")
    return F.filter(F.transform(F.split(bare, rf"(?<={marks})(?!{marks})"), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(text: str | Column, patterns: tuple[str, ...]) -> Column:
    """Lines that match none of the patterns, joined again; blank lines go."""
    lines = F.transform(F.split(_col(text), r"\r?\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike("(?iu)^(?:" + "|".join(patterns) + ")$"))
    return F.array_join(kept, "\n")


#: Whole lines that are advertisement.
AD_LINES = (
    r"https?://\S+",
    r"www\.\S+",
    r"m\.[a-zA-Z0-9.-]+\.[a-zA-Z]+",
    r"请记住本书首发域名：.*",
    r"最新章节txt下载：.*",
    r"本书域名：.*",
    r"手机用户请浏览.*阅读.*",
    r"一秒记住【.*】.*",
    r"百度搜索【.*】.*",
    r"【\s*推荐下.*换源.*】",
    r"p\s*s\s*[：:].*求.*",
    r"\(?笔趣阁\)?",
    r"\(?UU看书\)?",
    r"\(?全本小说网\)?",
    r"\(?起点中文网\)?",
    r"\(?看书神站\)?",
    r"\(?飞卢小说网\)?",
)
#: Lines that a crawler adds (counts of words, times), and those that end a chapter.
CRAWLER_LINES = (r"\d+\s*(?:字|Chữ|từ)", r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}", r"(?:本章完|全书完|全剧终)")
#: What authors ask for in brackets.
PLEAS = ("求追读", "求月票", "求推荐", "求收藏", "求花", "求鲜花", "求订", "求打赏", "求订阅", "本章完", "全书完", "全剧终")
#: Variant characters in chapters, and the usual ones.
CHAPTER_VARIANTS = (("杓子", "勺子"), ("握杓", "握勺"), ("裏面", "里面"), ("這裏", "这里"), ("那裏", "那里"), ("麼", "么"))


def chapter(text: str | Column, lines: tuple[str, ...] = AD_LINES + CRAWLER_LINES, variants: tuple[tuple[str, str], ...] = CHAPTER_VARIANTS) -> Column:
    """(title, body) of a raw chapter: the first line that is left, and the others without line ends between them. Lines of
    advertisement and of the crawler go, so do a chapter number before the text and pleas in brackets; variant characters
    become usual ones."""
    t = replace_all(text, (r"(?iu)^\s*Chương\s*\d+\s*[:\-–]\s*", ""), (rf"[（(]\s*(?:{'|'.join(PLEAS)})[!！]?\s*[）)]", ""), (r"(?<=[一-鿿])著", "着"))
    for old, new in variants:
        t = F.replace(t, F.lit(old), F.lit(new))
    kept = F.split(drop_boilerplate(t, lines), "\n")
    return F.struct(F.get(kept, F.lit(0)).alias("title"), F.array_join(F.slice(kept, 2, F.greatest(F.lit(0), F.size(kept) - 1)), "").alias("body"))


#: Lines that say nothing, by what is wrong with them: music marks only, one character over and over (four at least), a
#: period of two to four characters at least four times.
EMPTY_SHAPES = {
    "music": r"[♪♫🎵🎶\s.,!?…—\-_]+",
    "one character": r"(?s)(?=.{4})([^ ])(?: *\1)*",
    "short period": r"(?s)(.{2,4})\2{3,}",
}
_EMPTY_LINE = "^(?:" + "|".join(f"(?:{p})" for p in EMPTY_SHAPES.values()) + ")$"


def is_hallucination(text: str | Column, no_speech: Column, log_prob: Column, promo: tuple[str, ...] = ()) -> Column:
    """Lines that recognition made up: blank ones, those of ``EMPTY_SHAPES``, promotion, and what its own scores call
    silence (a lower bar for one or two characters)."""
    t = F.trim(_col(text))
    bar = F.when(F.length(t) <= 2, 0.5).otherwise(0.85)
    silent = (no_speech > bar) & (log_prob < -1.0)
    advert = F.exists(F.array(*map(F.lit, promo)), lambda p: F.contains(t, p)) if promo else F.lit(False)
    return (t == "") | t.rlike(_EMPTY_LINE) | advert | silent


def word_count(text: str | Column) -> Column:
    """Runs between white space."""
    return F.regexp_count(_col(text), F.lit(r"(?U)\S+"))


def token_count(text: str | Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_count(_col(text), F.lit(r"(?U)\b\w+\b"))


def numbered_line(text: str | Column) -> tuple[Column, Column]:
    """Number and rest of a line such as ``12. text`` (null and the line where there is no number)."""
    n = F.regexp_extract(_col(text), r"^\s*(\d+)\s*[.:)\-]", 1)
    return F.when(n != "", n.try_cast("int")), F.trim(replace_all(text, (r"^\s*\d+\s*[.:)\-]\s*", "")))


def placeholders(text: str | Column, tokens: str | Column) -> Column:
    """found, missing and valid: how many of the tokens are in the text (whatever the case, spaces or dashes for
    underscores); how many may be missing depends on their number."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    flat = F.lower(replace_all(text, (r"[\s_\-]+", "")))
    found = F.size(F.filter(tokens, lambda k: F.contains(flat, F.lower(F.regexp_replace(k, r"[\s_\-]+", "")))))
    n, missing = F.size(tokens), F.size(tokens) - found
    enough = (found * 100) >= (n * 35)
    valid = F.when(n <= 3, True).when(n <= 7, (found >= 1) | (missing <= 4)).when(n <= 15, (missing <= 6) | enough).otherwise((missing <= 10) | enough)
    return F.struct(found.alias("found"), missing.alias("missing"), valid.alias("valid"))


def transliterate(text: str | Column, names: Column | None = None) -> Column:
    """Each character by a map of readings, capitalised and spaced; characters without one stay."""
    chars = F.split(_col(text), "")
    return F.array_join(F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.initcap(F.coalesce(F.element_at(names, c), c)) if names is not None else c), " ")


def reading_of_name(text: str | Column, readings: Column, special: Column | None = None) -> Column:
    """A name as its special form, where it has one; else each Han character by its reading, capitalised and spaced, and
    all else as it is."""
    t = F.trim(_col(text))
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    spelled = F.transform(chars, lambda c: F.coalesce(F.when(c.rlike(HAN), F.concat(F.lit(" "), F.initcap(F.element_at(readings, c)), F.lit(" "))), c))
    out = squeeze(F.array_join(spelled, ""))
    return out if special is None else F.coalesce(F.element_at(special, t), out)


def fallback_readings(names: DataFrame, known: DataFrame) -> DataFrame:
    """(char, reading) of characters without a known reading (char, reading), from names (name, reading) of two to four
    characters that are read word by word; the reading found most often, of equal ones the first."""
    words = F.split(F.trim(F.split("reading", "/")[0]), r"\s+")
    chars = F.filter(F.split(F.trim("name"), ""), lambda c: c != "")
    pairs = names.select(chars.alias("c"), words.alias("w")).where("size(c) between 2 and 4 and size(c) = size(w)")
    each = pairs.select(F.explode(F.arrays_zip("c", "w")).alias("x")).select(F.col("x.c").alias("char"), F.lower("x.w").alias("reading"))
    n = each.join(known.select("char"), "char", "left_anti").groupBy("char", "reading").agg(F.count("*").alias("n"))
    return n.groupBy("char").agg(F.min_by("reading", F.struct(-F.col("n"), "reading")).alias("reading"))


def mask_secret(text: str | Column) -> Column:
    """The first and last four characters of a key; stars only where it is short."""
    t = _col(text)
    return F.when(F.length(t) <= 8, F.repeat(F.lit("*"), F.length(t))).otherwise(F.concat(F.substring(t, 1, 4), F.lit("..."), F.substring(t, -4, 4)))


def hash_token(text: str | Column) -> Column:
    """Four upper-case hex digits of a text."""
    return F.upper(F.substring(F.md5(_col(text)), 1, 4))


def safe_title(text: str | Column) -> Column:
    """Letters, digits, spaces, dashes and underscores only."""
    return F.trim(replace_all(text, (r"(?U)[^\w \-]", "")))


#: A video's hosts and page; the patterns of its keys and parts in ``video_url`` are fixed, too.
VIDEO_HOSTS = r"(?i)bilibili\.com|b23\.tv"
VIDEO_PAGE = "https://www.bilibili.com/video/"


def video_url(text: str | Column) -> Column:
    """The canonical address of a video, whatever the form in which it was given; other addresses stay."""
    u = F.trim(_col(text))
    bv, av = F.regexp_extract(u, r"(?i)(BV[a-zA-Z0-9]{10})", 1), F.regexp_extract(u, r"(?i)/(av\d+)|\b(av\d+)\b", 0)
    part = F.regexp_extract(u, r"[?&]p=(\d+)", 1)
    tail = F.when(part != "", F.concat(F.lit("?p="), part)).otherwise("")
    known = u.rlike(VIDEO_HOSTS)
    bare = u.rlike(r"(?i)^(BV[a-zA-Z0-9]{10}|av\d+)$")
    return (
        F.when(bare, F.concat(F.lit(VIDEO_PAGE), u))
        .when(known & (bv != ""), F.concat(F.lit(VIDEO_PAGE), bv, tail))
        .when(known & (av != ""), F.concat(F.lit(VIDEO_PAGE), F.ltrim(av, F.lit("/")), tail))
        .otherwise(u)
    )


def best_split(words: str | Column, target: Column, joiners: tuple[str, ...] = ("và", "nhưng", "thì", "mà", "nên", "vì", "and", "but")) -> Column:
    """Where to cut an array of words near a place: close to it, better after a comma or before a joining word. The
    number of words before the cut (0 for fewer than two words)."""


    def best(w: Column) -> Column:
        after, before = F.slice(w, 2, F.greatest(F.lit(0), F.size(w) - 1)), F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 1))
        seam = F.zip_with(before, after, lambda x, y: F.when(x.rlike(r"[,;:]$"), 3).otherwise(0) + F.when(F.lower(y).isin(*joiners), 2).otherwise(0))
        return -F.array_max(F.transform(seam, lambda v, i: F.struct((v - F.abs(i + 1 - target)).alias("worth"), (-i - 1).alias("less"))))["less"]

    w = F.col(words) if isinstance(words, str) else words
    return F.when(F.size(w) < 2, 0).otherwise(_bound(w, best))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: within a lambda a name is a slot, elsewhere an expression to repeat."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def karaoke(text: str | Column, duration_cs: Column) -> Column:
    """Words with time tags: hundredths of a second by characters, ten at least; the last takes what is left."""
    split = F.filter(F.split(F.trim(_col(text)), r"\s+"), lambda x: x != "")
    sizes = _bound(split, lambda w: F.struct(w.alias("w"), F.size(w).alias("n"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("chars")))
    total = lambda s: F.greatest(duration_cs.cast("int"), s["n"] * 10)
    own = lambda s, x: F.greatest(F.lit(10), F.bround(total(s) * (F.length(x) / s["chars"])).cast("int"))
    shares = _bound(sizes, lambda s: F.struct(s["w"].alias("w"), total(s).alias("total"), F.transform(F.slice(s["w"], 1, F.greatest(F.lit(0), s["n"] - 1)), lambda x: own(s, x)).alias("cs")))
    rest = lambda r: F.greatest(F.lit(10), r["total"] - F.aggregate(r["cs"], F.lit(0), lambda a, x: a + x))
    timed = _bound(shares, lambda r: F.zip_with(F.concat(r["cs"], F.array(rest(r))), r["w"], lambda c, x: F.concat(F.lit("{\\kf"), c.cast("string"), F.lit("}"), x)))
    return F.when(F.size(split) == 0, "").otherwise(F.array_join(timed, " "))


# ---- times as text, from integer milliseconds

def clock(ms: str | Column, separator: str = ",") -> Column:
    """HH:MM:SS,mmm."""
    t = F.greatest(F.lit(0), F.col(ms) if isinstance(ms, str) else ms).cast("long")
    part = lambda by, mod: F.floor(t / by) % mod
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(t / 3_600_000), part(60_000, 60), part(1000, 60), t % 1000)


def clock_from_seconds(seconds: Column, how: str) -> Column:
    """The three ways to make milliseconds of seconds: round all, truncate, or round the fraction and stop at 999."""
    s = F.greatest(F.lit(0.0), seconds)
    if how == "round":
        return clock(F.bround(s * 1000).cast("long"))
    if how == "truncate":
        return clock(F.floor(s) * 1000 + F.floor((s - F.floor(s)) * 1000))
    return clock(F.floor(s) * 1000 + F.least(F.lit(999), F.bround((s - F.floor(s)) * 1000)).cast("long"))


def clock_centi(ms: str | Column) -> Column:
    """H:MM:SS.cc, hundredths rounded and at most 99."""
    t = F.greatest(F.lit(0), F.col(ms) if isinstance(ms, str) else ms).cast("long")
    cs = F.least(F.lit(99), F.floor((t % 1000 + 5) / 10))
    return F.format_string("%d:%02d:%02d.%02d", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, cs)


def ms_of_clock(text: str | Column) -> Column:
    """Milliseconds of H:MM:SS.cc or HH:MM:SS,mmm; null for other texts."""
    t = _col(text)
    pattern = r"^\s*(\d+):(\d{2}):(\d{2})[.,](\d{2,3})\s*$"
    g = lambda i: F.regexp_extract(t, pattern, i)
    fraction = F.rpad(g(4), 3, "0").try_cast("long")
    return F.when(t.rlike(pattern), g(1).try_cast("long") * 3_600_000 + g(2).try_cast("long") * 60_000 + g(3).try_cast("long") * 1000 + fraction)


def crop(width: Column, height: Column, top_pct: Column, bottom_pct: Column, ratio_w: int, ratio_h: int) -> Column:
    """x, y, w, h (even numbers) of the largest middle part in a ratio, after cutting off the top and the bottom."""
    even = lambda c: (F.floor(c / 2) * 2).cast("int")
    top = even(height * top_pct / 100)
    left = height - top - even(height * bottom_pct / 100)
    w = even(F.least(width, left * ratio_w / ratio_h))
    h = even(F.least(left, w * ratio_h / ratio_w))
    return F.struct(even((width - w) / 2).alias("x"), (top + even((left - h) / 2)).cast("int").alias("y"), w.alias("w"), h.alias("h"))


# ---- lines for a voice, answers that hold JSON, kinds of stories

#: What a Vietnamese voice misreads, and what it reads right, in this order.
MISREAD = (
    (r"(?i)v\.v\.?", "vân vân"),
    (r"(?iU)\b(?:v[\-/]v|vv)\b", "vân vân"),
    (r"(?U)\bVI\b|\bVi\b", "Vy"),
    (r"(?U)\bvi\b", "vy"),
    (r"(?U)\b[eE]\s+ngại\b", "è ngại"),
    (r"(?U)\b[eE]\s+rằng\b", "è rằng"),
    (r"(?U)\b[eE]\s+là\b", "è là"),
    (r"(?U)\b[eE]\s+sợ\b", "lo sợ"),
    (r"(?U)\b[eE]\s+dè\b", "dè dặt"),
    (r"(?U)\b[eE]\s+thẹn\b", "thẹn thùng"),
    (r"(?U)\b[eE]\s*!+", "Ê!"),
    (r"(?U)\b[eE]\s*\?+", "Ể?"),
    (r"(?U)\b[eE]\s*(?:\.{2,}|…)", "Ơ..."),
    (r"(?U)\b([aA])(?=[aA]+\b)|(?<=[aA]' )([aA])\b", "$1$2' "),
    (r"(?U)\bA\s+([A-ZÀ-Ỹ][a-zà-ỹ]*)", "A' $1"),
    (r"(?iU)\ba\s+ha\b", "À ha"),
    (r"(?U)\b[aA]\s*!+", "Á!"),
    (r"(?U)\b[aA]\s*(?:\.{2,}|…)", "À..."),
    (r"(?U)\b[aA]\s*,", "À,"),
)
#: Brackets and quotes become spaces, marks within a line semicolons, marks at its end go.
VOICE_MARKS = (
    (r"[\"“”„‟«»()\[\]{}/／\\]+", " "),
    (r"(?U)\s+", " "),
    (r"\.{3,}|…", ";"),
    (r"[.!?:;]+(?=\s|$)", ";"),
    (r"\s*;\s*", "; "),
    (r";+", ";"),
    (r"[.,!?…:;—\-_\s]+$", ""),
)


def for_voice(text: str | Column) -> Column:
    """A line as it is sent to a voice: no numbering, misread words spelled out, one semicolon at its end."""
    out = F.trim(replace_all(strip_numbering(text), *MISREAD, *VOICE_MARKS))
    return F.when(out == "", out).otherwise(F.concat(out, F.lit(";")))


def value_of_json(text: str | Column, name: str = "vi") -> Column:
    """The value of a field, where a text is or holds a JSON object with it; else the text on one line."""
    t = F.trim(_col(text))
    quoted = F.regexp_extract(t, rf"[\"']{name}[\"']\s*:\s*[\"']([^\"']+)[\"']", 1)
    other = F.get_json_object(F.regexp_extract(t, r"(?s)(\{.*\})", 1), f"$.{name}")
    bare = replace_all(t, (rf"^\s*\{{+\s*[\"']?i[\"']?\s*:\s*\d+\s*,\s*[\"']?{name}[\"']?\s*:\s*[\"']?", ""), (r"[\"']?\s*\}+\s*[.,;]?\s*$", ""))
    looks = F.contains(t, F.lit("{")) | F.contains(t, F.lit(f'"{name}"')) | F.contains(t, F.lit(f"'{name}'"))
    found = F.when(looks, F.coalesce(F.nullif(F.trim(quoted), F.lit("")), other, bare)).otherwise(t)
    return F.trim(replace_all(found, (r"[\r\n\t]+", " ")))


#: Kinds of stories and words that tell them, the first kind with a word counts.
GENRES = (
    ("sci_fi_apocalypse", ("求生", "公路", "末世", "末日", "丧尸", "废土", "zombie", "tận thế", "mạt thế", "避难所", "庇护所", "防空洞", "安全屋")),
    ("system_reincarnation", ("系统", "升级", "签到", "hệ thống", "thăng cấp", "属性面板", "杀戮点")),
    ("urban_supernatural", ("序列", "异能", "觉醒", "超能", "诡异", "抓鬼", "灵异", "quỷ dị", "linh dị")),
    ("urban", ("公司", "集团", "董事长", "总裁", "警官", "巡捕", "医院", "医生", "学校", "大学", "同学")),
)
DEFAULT_GENRE = "xianxia"


def genre(text: str | Column, kinds: tuple = GENRES, default: str = DEFAULT_GENRE) -> Column:
    """The first kind of which a word is in the text."""
    low, out = F.lower(_col(text)), F.lit(None)
    for name, words in reversed(kinds):
        hit = low.rlike("|".join(words))
        out = F.when(hit, name).otherwise(out)
    return F.coalesce(out, F.lit(default))


def genre_by_weight(text: str | Column, kinds: tuple, default: str = DEFAULT_GENRE) -> Column:
    """The kind whose words in the text weigh most: kinds are (name, ((word, weight), ...)); of equal ones the first, and
    the default where nothing is found. A word counts each time."""
    low = F.lower(_col(text))
    weighed = [F.struct(sum((F.regexp_count(low, F.lit(re.escape(word))) * weight for word, weight in words), F.lit(0)).alias("w"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(kinds)]
    best = F.array_max(F.array(*weighed))
    return F.when(best["w"] > 0, best["name"]).otherwise(F.lit(default))


#: Beginnings that a name must not have.
NAME_JUNK = r"(?iu)^(?:tên|tên là|gọi là|nhân vật|ông|bà|name|called)\s*[:\-]?\s+"


def clean_name(name: str | Column, source: str | Column, readings: Column | None = None) -> Column:
    """A name without Han characters and leading words; where nothing is left, the source's characters by their
    readings."""
    out = F.trim(replace_all(strip_han(name), (NAME_JUNK, ""), (r"(?U)\s+", " ")))
    return F.when(out != "", out).otherwise(transliterate(source, readings))
