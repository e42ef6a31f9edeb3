"""Files of segments: JSON in its several shapes, subtitle and script texts, recognition payloads; and their writers.

Readers parse with expressions over ``spark.read.text``/``json``; writers make a text column and let Spark's committer
place the files, one folder a project, so that each project's lines lie in one file in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from seglume.functions.text import _bound, clock, clock_centi, karaoke, ms_of_clock, replace_all, strip_han, strip_numbering
from seglume.sources import project_files

# ---- readers

ENTITY = "struct<raw:string,viet:string,type:string,role:string,desc:string,category:string,gender:string>"
ENTITIES = f"struct<entities:array<{ENTITY}>,characters:array<{ENTITY}>,terms:array<{ENTITY}>>"


def entities(rows: DataFrame, column: str = "value") -> DataFrame:
    """Entity files in any shape (a list; an object with a list; one with characters and terms), one JSON text a row, as
    rows: the other columns, place, raw, viet, type, role. A text that is not JSON has none."""
    rest = [c for c in rows.columns if c != column]
    flat, whole = F.from_json(column, f"array<{ENTITY}>"), F.from_json(column, ENTITIES)
    with_type = lambda part, kind, note: F.transform(F.coalesce(part, F.array().cast(f"array<{ENTITY}>")), lambda e: F.struct(e["raw"].alias("raw"), e["viet"].alias("viet"), (F.lit(kind) if kind else F.coalesce(e["type"], F.lit("OTHER"))).alias("type"), F.coalesce(e["role"], e["category"], e["desc"], F.lit(note)).alias("role")))
    listed = lambda part: F.transform(part, lambda e: F.struct(e["raw"].alias("raw"), e["viet"].alias("viet"), F.coalesce(e["type"], F.lit("NAME")).alias("type"), F.coalesce(e["desc"], e["role"], F.lit("")).alias("role")))
    named = F.concat(with_type(whole["characters"], "NAME", ""), with_type(whole["terms"], None, ""))
    found = F.when(F.ltrim(column).startswith("["), listed(flat)).when(F.size(F.coalesce(whole["entities"], F.array().cast(f"array<{ENTITY}>"))) > 0, listed(whole["entities"])).otherwise(named)
    return rows.select(*rest, F.posexplode(found).alias("place", "e")).select(*rest, "place", "e.*")


def with_fallback(rows: DataFrame, other: DataFrame, key: str = "project") -> DataFrame:
    """Rows of ``other`` only for keys of which ``rows`` has none."""
    return rows.unionByName(other.join(rows.select(key).distinct(), key, "left_anti").select(*rows.columns))


def voices(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """A voice catalogue (one JSON list), of one language whatever its case."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.where(F.lower("lan") == lang.lower()) if lang else rows


WORDS = "array<struct<text:string,start_time:long,end_time:long>>"
PAYLOAD = f"struct<utterances:array<struct<text:string,start_time:long,end_time:long,words:{WORDS}>>>"


def utterances(rows: DataFrame, column: str = "value") -> DataFrame:
    """Recognition payloads (JSON) as rows: the other columns, seq, text, start_ms, end_ms, words."""
    rest = [c for c in rows.columns if c != column]
    out = rows.select(*rest, F.posexplode(F.from_json(column, PAYLOAD)["utterances"]).alias("seq", "u"))
    times = [F.coalesce(f"u.{c}_time", F.lit(0)).alias(f"{c}_ms") for c in ("start", "end")]
    return out.select(*rest, (F.col("seq") + 1).alias("seq"), F.coalesce("u.text", F.lit("")).alias("text"), *times, F.coalesce("u.words", F.array().cast(WORDS)).alias("words"))


def mean_confidence(words: Column) -> Column:
    """The mean of the words' confidence that is given, to four digits; -1 without any."""
    known = F.filter(words, lambda c: c.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) > 0, F.round(total / F.size(known), 4)).otherwise(F.lit(-1.0))


def ass_dialogues(lines: DataFrame, column: str = "value") -> DataFrame:
    """Subtitle events of ``Dialogue:`` lines (ten fields, the text last): the other columns, start_ms, end_ms, style,
    speaker, text."""
    rest = [c for c in lines.columns if c != column]
    f = F.split(F.trim(column), ",", 10)
    rows = lines.where(F.trim(column).startswith("Dialogue:")).withColumn("_f", f).where("size(_f) = 10")
    at = lambda i: F.get("_f", F.lit(i))
    return rows.select(*rest, ms_of_clock(at(1)).alias("start_ms"), ms_of_clock(at(2)).alias("end_ms"), at(3).alias("style"), at(4).alias("speaker"), at(9).alias("text"))


SRT = r"(?s)^\s*(\d+)\s*\n(\d+:\d{2}:\d{2},\d{3})\s*-->\s*(\d+:\d{2}:\d{2},\d{3})[ \t]*(?:\n(.*))?$"


def srt_blocks(files: DataFrame, column: str = "value") -> DataFrame:
    """Subtitle blocks of whole files (one text a row): the other columns, seq, start_ms, end_ms, text."""
    rest = [c for c in files.columns if c != column]
    parts = F.split(F.regexp_replace(column, "\r", ""), r"\n\s*\n")
    rows = files.select(*rest, F.explode(parts).alias("_b")).where(F.col("_b").rlike(SRT))
    g = lambda i: F.regexp_extract("_b", SRT, i)
    return rows.select(*rest, g(1).cast("long").alias("seq"), ms_of_clock(g(2)).alias("start_ms"), ms_of_clock(g(3)).alias("end_ms"), F.regexp_replace(g(4), r"\s+$", "").alias("text"))


def byte_range(header: Column, size: Column) -> Column:
    """(first, last) of ``bytes=a-b``, ``bytes=a-`` or ``bytes=-n``, clamped to the file; null if it lies beyond."""
    a, b = (F.regexp_extract(header, r"bytes=(\d*)-(\d*)", i) for i in (1, 2))
    first = F.when(a != "", a.try_cast("long")).otherwise(F.greatest(F.lit(0), size - b.try_cast("long")))
    last = F.when((a != "") & (b != ""), F.least(b.try_cast("long"), size - 1)).otherwise(size - 1)
    return F.when((first < size) & (first <= last), F.struct(first.alias("first"), last.alias("last")))


# ---- writers

def srt_text(seq: str = "seq", start: str = "start_ms", end: str = "end_ms", text: str = "text") -> Column:
    return F.format_string("%d\n%s --> %s\n%s\n", F.col(seq), clock(start), clock(end), F.coalesce(text, F.lit("")))


def script_text(speaker: str = "speaker", start: str = "start_ms", end: str = "end_ms", text: str = "text") -> Column:
    seconds = lambda c: F.format_string("%d.%02d", F.floor((F.col(c) + 5) / 1000), F.floor((F.col(c) + 5) / 10) % 100)
    return F.format_string("[%s] (%s - %s): %s", F.coalesce(speaker, F.lit("")), seconds(start), seconds(end), F.coalesce(text, F.lit("")))


#: Head of a subtitle file.
ASS_HEAD = """[Script Info]
ScriptType: v4.00+
PlayResX: {width}
PlayResY: {height}

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, OutlineColour, Bold, Outline, Alignment, MarginV
Style: Main,Arial,{size},&H00FFFFFF,&H00000000,1,3,2,{margin}

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"""


def ass_text(start: str = "start_ms", end: str = "end_ms", speaker: str = "speaker", text: str = "text") -> Column:
    body = F.regexp_replace(F.coalesce(text, F.lit("")), "\r?\n", F.lit("\\\\N"))
    return F.format_string("Dialogue: 0,%s,%s,Main,%s,0,0,0,,%s", clock_centi(start), clock_centi(end), F.regexp_replace(F.coalesce(speaker, F.lit("")), ",", " "), body)


#: The height for which sizes of letters are given, and least sizes in pixels.
REFERENCE_HEIGHT = 360
LEAST_FONT, LEAST_MASK_FONT, LEAST_PADDING, LEAST_MARGIN = 16, 18, 12, 2


def karaoke_style(width: int, height: int, font: int = 14, band_bottom_pct: float = 0.0, band_pct: float = 14.0) -> dict[str, int]:
    """Size and margin of a caption whose middle lies in the middle of a band above the lower edge: width, height, size,
    margin, for ``ASS_HEAD``."""
    size = max(LEAST_FONT, round(font * max(1.0, height / REFERENCE_HEIGHT)))
    middle = height * (band_bottom_pct + band_pct / 2) / 100
    return {"width": width, "height": height, "size": size, "margin": max(LEAST_MARGIN, round(middle - size / 2))}


#: How long a caption and a mask stand at least.
LEAST_CAPTION_MS, LEAST_MASK_MS = 300, 200


def caption(text: str | Column) -> Column:
    """A translated line as a caption: no Han characters, numbering or doubled marks; null where no letter or digit is
    left."""
    bare = replace_all(strip_han(text), (r"\s+([,.!?;:])", "$1"), (r"\s{2,}", " "))
    out = replace_all(strip_numbering(bare), (r"[,.]+,", ","), (r"[,.]+\.", "."))
    return _bound(out, lambda x: F.when(x.rlike(r"[\p{L}\p{N}]"), x))


def karaoke_line(text: str = "translated_text", start: str = "start_ms", end: str = "end_ms", tags: bool = True) -> Column:
    """An event with a time tag for each word (or the plain caption); null for rows without a caption."""
    last = F.greatest(F.col(end), F.col(start) + LEAST_CAPTION_MS)
    words = lambda said: karaoke(said, F.floor((last - F.col(start)) / 10).cast("int")) if tags else said
    return _bound(caption(text), lambda said: F.when(said.isNotNull(), F.format_string("Dialogue: 0,%s,%s,Main,,0,0,0,,%s", clock_centi(start), clock_centi(last), words(said))))


def mask_text(text: str = "text", start: str = "start_ms", end: str = "end_ms", width: int = 1920, height: int = 1080, font: int = 32, margin_pct: float = 8.0) -> Column:
    """A filled box over the source's subtitle for as long as it stands, as wide as its characters and no wider than the
    picture; null for rows without text (tags in braces are none)."""
    scale = max(1.0, height / REFERENCE_HEIGHT)
    size, pad, margin = max(LEAST_MASK_FONT, round(font * scale)), max(LEAST_PADDING, round(LEAST_PADDING * scale)), max(4, round(height * margin_pct / 100))
    shown = F.trim(replace_all(text, (r"\{[^}]*\}", "")))
    wide = F.least(F.lit(width), F.length(shown) * size + 2 * pad).cast("int")
    left = F.floor((F.lit(width) - wide) / 2).cast("int")
    top, bottom = height - margin - size - 2 * pad, height - margin
    box = F.format_string(f"m %d {top} l %d {top} l %d {bottom} l %d {bottom}", left, left + wide, left + wide, left)
    last = F.greatest(F.col(end), F.col(start) + LEAST_MASK_MS)
    return F.when(shown != "", F.format_string("Dialogue: 0,%s,%s,Main,,0,0,0,,{\\p1}%s{\\p0}", clock_centi(start), clock_centi(last), box))


#: Durations of an audit record, in milliseconds; seconds with two digits in the file.
AUDIT_TIMES = ("start", "end", "target", "raw", "trimmed", "voice")


def audit_record(index: str = "seq", cut_head: str = "cut_head_ms", cut_tail: str = "cut_tail_ms", speed_pct: str = "speed_pct") -> Column:
    """What was done to a line's voice, as a JSON object: from columns <name>_ms of ``AUDIT_TIMES``."""
    seconds = lambda c: F.format_string("%d.%02d", F.floor((F.col(c) + 5) / 1000).cast("long"), (F.floor((F.col(c) + 5) / 10) % 100).cast("long"))
    times = [x for name in AUDIT_TIMES for x in (F.lit(f', "{name}": '), seconds(f"{name}_ms"))]
    trimmed = F.when((F.col(cut_head) > 0) | (F.col(cut_tail) > 0), "true").otherwise("false")
    speed = F.format_string("%d.%02d", F.floor(F.col(speed_pct) / 100).cast("long"), (F.col(speed_pct) % 100).cast("long"))
    return F.concat(
        F.lit('{"tts_index": '), F.col(index).cast("string"), *times, F.lit(', "speed": '), speed, F.lit(', "trimmed_voice": '), trimmed,
        F.lit(', "cut_head_ms": '), F.col(cut_head).cast("string"), F.lit(', "cut_tail_ms": '), F.col(cut_tail).cast("string"), F.lit("}"),
    )


def write_audit(rows: DataFrame, path: str) -> None:
    """``<project>.json``: a list of the records of each project in order."""
    project_files.write(rows, audit_record(), path, "json", head="[", joint=",", tail="]")


def write_karaoke(segs: DataFrame, path: str, width: int = 1920, height: int = 1080, tags: bool = True) -> None:
    """``<project>.ass`` with a head and an event for each translated line, in order."""
    # of an array, or Spark makes each line twice: once for a filter
    rows = segs.withColumn("_line", F.explode(F.array_compact(F.array(karaoke_line(tags=tags)))))
    project_files.write(rows, F.col("_line"), path, "ass", head=ASS_HEAD.format(**karaoke_style(width, height)))


def write_lines(segs: DataFrame, line: Column, path: str, head: str | None = None, key: str = "project", order: str = "seq") -> None:
    """A folder for each project, its lines in order."""
    rows = segs.select(key, F.col(order).cast("long").alias("_o"), line.alias("value"))
    if head is not None:
        rows = rows.unionByName(segs.select(key).distinct().select(key, F.lit(None).cast("long").alias("_o"), F.lit(head).alias("value")))
    rows.repartition(key).sortWithinPartitions(key, F.col("_o").asc_nulls_first()).drop("_o").write.partitionBy(key).mode("overwrite").text(path)


def write_json(segs: DataFrame, path: str, key: str = "project") -> None:
    """A folder for each project, a JSON object a line."""
    segs.repartition(key).sortWithinPartitions(key, "seq").write.partitionBy(key).mode("overwrite").json(path)


def finished_only(segs: DataFrame, done: Column) -> DataFrame:
    """Rows of an intermediate export; the project's state is left alone."""
    return segs.where(done)


def replace_stage(table: DataFrame, rows: DataFrame, stage: str, key: str = "project") -> DataFrame:
    """The table with a stage's rows of these projects replaced by ``rows``, numbered from 1 in their order."""
    numbered = rows.withColumn("seq", F.row_number().over(W.partitionBy(key).orderBy("seq")).cast("long")).withColumn("stage", F.lit(stage))
    gone = numbered.select(key).distinct().withColumn("stage", F.lit(stage))
    return table.join(gone, [key, "stage"], "left_anti").select(*table.columns).unionByName(numbered, allowMissingColumns=True)


def write_stages(table: DataFrame, path: str) -> None:
    """Parquet by stage; a later write replaces only the stages that it has."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage").parquet(path)


def migrate(old: DataFrame, wanted: DataFrame) -> DataFrame:
    """Old rows with all wanted columns (missing ones null), in their order; columns that are gone are dropped."""
    empty = wanted.limit(0)
    return empty.unionByName(old.select(*[c for c in old.columns if c in wanted.columns]), allowMissingColumns=True)
