"""How texts sound whose characters have several readings: a table of readings (char, syllable), not one spelling a text.

A character is the set of its readings, with confusable sounds merged. Two texts may sound the same if they are equally
long and each pair of characters has a reading in common; an equality join on the sounds of the first two characters
proposes such pairs, the sets decide. Likeness aligns two texts so that what matches weighs most: a whole syllable one, an
initial alone 0.3. As a character is matched once, its best reading hangs on its partner only, so one table of weights per
pair of places replaces trying all readings of both texts.

Characters without a reading sound like themselves. Null and empty texts sound like nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from seglume.functions.similarity import CONFUSED_FINALS, CONFUSED_INITIALS

#: What an equal initial is worth where the syllables differ.
INITIAL = 0.3


def merged(syllable: Column) -> Column:
    """A syllable with its confusable initial and final merged (the first rule that fits of each)."""
    low = F.lower(F.trim(syllable))
    head, tail = low, F.lit(None).cast("string")
    for said, taken in reversed(CONFUSED_INITIALS):
        head = F.when(low.startswith(said), F.concat(F.lit(taken), F.substr(low, F.lit(len(said) + 1)))).otherwise(head)
    for said, taken in reversed(CONFUSED_FINALS):
        tail = F.when(head.endswith(said), F.concat(F.substr(head, F.lit(1), F.length(head) - len(said)), F.lit(taken))).otherwise(tail)
    return F.coalesce(tail, head)


def sounded(texts: DataFrame, readings: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, text, sounds: of each character in order the set of its merged readings (sorted)."""
    sets = readings.select("char", merged(F.col("syllable")).alias("s")).groupBy("char").agg(F.sort_array(F.collect_set("s")).alias("sounds"))
    chars = F.filter(F.split(F.col(text_col), ""), lambda c: c != "")
    each = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.posexplode(chars).alias("at", "char")).join(sets, "char", "left")
    own = F.struct("at", F.coalesce("sounds", F.array("char")).alias("s"))
    return each.groupBy("id", "text").agg(F.transform(F.sort_array(F.collect_list(own)), lambda x: x["s"]).alias("sounds"))


def homophones(sounds: DataFrame) -> DataFrame:
    """(a, b): ids of different texts that may sound the same, a < b."""
    rows = sounds.withColumn("n", F.size("sounds"))
    second = F.when(F.col("n") > 1, F.get("sounds", F.lit(1))).otherwise(F.array(F.lit("")))
    keyed = rows.select("id", "text", "sounds", "n", F.explode(F.get("sounds", F.lit(0))).alias("s0"), second.alias("_second")).select("id", "text", "sounds", "n", "s0", F.explode("_second").alias("s1"))
    other = keyed.select("n", "s0", "s1", F.col("id").alias("b"), F.col("text").alias("_text"), F.col("sounds").alias("_sounds"))
    met = keyed.join(other, ["n", "s0", "s1"]).where((F.col("id") < F.col("b")) & (F.col("text") != F.col("_text")))
    same = F.forall(F.zip_with("sounds", "_sounds", F.arrays_overlap), lambda x: x)
    # two characters may share several readings, so a pair may come several times
    return met.where(same).select(F.col("id").alias("a"), "b").distinct()


def best_path(a: list[list[str]], b: list[list[str]]) -> float:
    """Twice the weight of the best alignment of two texts' sounds over both lengths."""
    if not a or not b:
        return 0.0
    row = [0.0] * (len(b) + 1)
    for x in a:
        heads, above = {s[:1] for s in x}, 0.0
        new = [0.0]
        for j, y in enumerate(b, 1):
            weight = 1.0 if not set(x).isdisjoint(y) else INITIAL if any(s[:1] in heads for s in y) else 0.0
            new.append(max(row[j], new[-1], above + weight))
            above = row[j]
        row = new
    return 2 * row[-1] / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    lists = lambda x: [] if x is None else [list(s) for s in x]
    return pd.Series([best_path(lists(x), lists(y)) for x, y in zip(a, b)])


def sound_likeness(a: str, b: str) -> Column:
    """``best_path`` of two columns of ``sounds``."""
    return _likeness(F.col(a), F.col(b))
