"""Mapping freely typed values to a canonical list by a character n-gram inverted index and weighted cosine."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.functions.keys import ELECTRIC_TOKENS, FUEL_TOKENS, GASOLINE_TOKENS, PLUG_TOKENS
from lonja.llm.canon_text import canonical
from lonja.session import materialise

#: A value is an entry from this cosine on, this far ahead of the next entry.
THRESHOLD, MARGIN = 0.24, 0.03
#: From this cosine and margin on it is taken as it stands; below, the edit distance has to confirm it.
SURE, SURE_MARGIN = 0.50, 0.12
#: Grams: letters, pairs, triples, pairs around a letter, and pairs and triples in alphabetic order, which a swap leaves as they are.
GRAM_WEIGHT = {"1": 1.0, "2": 0.5, "3": 0.3, "s": 0.7, "o": 1.0, "t": 1.0}
#: Longest run of words of a value that is looked up on its own, in lists whose values are described in several words.
MOST_WORDS = 3

# The words by which the listings' fuel categories are told (lonja.functions.keys), and beside them dictionary
# words and names of several words for each fuel or drive in English, German, Spanish, French, Italian, Polish and Swedish, the
# pump labels of EN 16942 and the usual abbreviations of drives. Written from memory, without a source at hand, by someone who
# had seen the values of the test tables.
FUEL_WORDS = {
    "gasoline": [*GASOLINE_TOKENS, "bencina", "nafta", "essence", "benzina", "benzyna", "bensin", "Ottomotor", "Ottokraftstoff", "E5", "E10"],
    "diesel": ["diesel", "gasóleo", "gasoil", "gazole", "gasolio", "olej napędowy", "Dieselkraftstoff", "B7", "B10"],
    "electric": [*ELECTRIC_TOKENS, "eléctrico", "électrique", "elettrico", "elektryczny", "elektro", "EV", "BEV"],
    "hybrid": ["hybrid", "híbrido", "hybride", "ibrido", "hybryda", "HEV", "MHEV"],
    "phev": [*PLUG_TOKENS, "plug-in hybrid", "híbrido enchufable", "hybride rechargeable", "Steckdosenhybrid", "PHEV"],
    "lpg": [*FUEL_TOKENS["lpg"], "GPL", "autogaz", "gas licuado de petróleo"],
    "cng": [*FUEL_TOKENS["cng"], "gas natural", "gas natural comprimido", "gaz naturel"],
    "hydrogen": [*FUEL_TOKENS["hydrogen"], "hydrogène", "idrogeno", "wodór", "FCEV", "H2"],
    "ethanol": [*FUEL_TOKENS["ethanol"], "éthanol", "bioethanol", "E85"],
}
# Which fuel decides where a value names several, as for the listings' fuel categories.
FUEL_ORDER = ["phev", "lpg", "cng", "hydrogen", "ethanol", "hybrid", "diesel", "gasoline", "electric"]
# Words of negation; what follows one is not what the value names.
NEGATIONS = {"no", "not", "sin", "nicht", "ohne", "kein", "without", "sans", "non", "senza", "bez", "utan"}


@functools.lru_cache(20_000)
def plain_words(v: str) -> tuple[str, ...]:
    """Words of the consistent, lower-case, unaccented form, without decoration: a leading label, bracketed notes, a trailing
    note after a spaced slash. Words are runs of letters and digits."""
    s = canonical(v).lower().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("ł", "l").replace("đ", "d")
    s = "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch))
    bare = re.sub(r"\s/\s.*$", " ", re.sub(r"\([^)]*\)", " ", re.sub(r"^\s*[^\W\d]+\s*:\s*", "", s)))
    return tuple(re.findall(r"[a-z0-9]+", bare) or re.findall(r"[a-z0-9]+", s))


def normal(v: str | None) -> str | None:
    """The plain words of a value as one."""
    return None if v is None else "".join(plain_words(v))


def runs(v: str, most: int = MOST_WORDS) -> list[str]:
    """What a value of several words is looked up by: its runs of up to `most` neighbouring words, each as one, without
    words that a negation precedes; and the whole."""
    w = plain_words(v)
    kept = [None if x in NEGATIONS or (i and w[i - 1] in NEGATIONS) else x for i, x in enumerate(w)]
    out = ["".join(part) for n in range(1, most + 1) for i in range(len(w) - n + 1) if None not in (part := kept[i : i + n])]
    return list(dict.fromkeys([*out, *([normal(v)] if None not in kept else [])]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def runs_udf(s: pd.Series) -> pd.Series:
    return s.map(runs, na_action="ignore").astype(object).where(s.notna(), None)


@F.pandas_udf(T.StringType())
def normal_udf(s: pd.Series) -> pd.Series:
    return s.map(normal, na_action="ignore").astype(object).where(s.notna(), None)


def osa(a: str, b: str) -> int:
    """Edit distance in which swapping two neighbours is one step."""
    two, one = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            cur[j] = min(one[j] + 1, cur[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cur[j] = min(cur[j], two[j - 2] + 1)
        two, one = one, cur
    return one[-1]


@F.pandas_udf(T.IntegerType())
def osa_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y) for x, y in zip(a, b)], dtype="int32")


def grams(text: str) -> dict[str, float]:
    """The typed grams of a text, padded but for single letters, with the square root of their weighted number."""
    p, count = f"^{text}$", Counter()
    for kind, of, width, pick in (
        ("1", text, 1, None), ("2", p, 2, None), ("3", p, 3, None), ("s", p, 3, lambda g: g[0] + g[2]),
        ("o", p, 2, lambda g: "".join(sorted(g))), ("t", p, 3, lambda g: "".join(sorted(g))),
    ):
        for i in range(len(of) - width + 1):
            g = of[i : i + width]
            count[kind + (pick(g) if pick else g)] += GRAM_WEIGHT[kind]
    return {g: math.sqrt(x) for g, x in count.items()}


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("gram", T.StringType()), T.StructField("w", T.DoubleType())])))
def grams_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"gram": g, "w": w} for g, w in grams(x).items()])


def _vectors(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, gram, w; distinct short values only, so their grams are made in Arrow batches, linear in their length."""
    return df.select(*keys, F.inline(grams_udf(text)))


def reference_forms(canon: DataFrame, aliases: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """list_name, canon_id, form, kind of every spelling an entry is known by: itself, its aliases, its initials."""
    spark = canon.sparkSession
    rows = [(lst, entry, a) for lst, d in (aliases or {}).items() for entry, words in d.items() for a in words]
    extra = spark.createDataFrame(rows, "list_name string, canon_value string, alias string")
    own = canon.select("list_name", "canon_id", F.col("canon_value").alias("spelling"), F.lit("own").alias("kind"))
    al = canon.join(extra, ["list_name", "canon_value"]).select("list_name", "canon_id", F.col("alias").alias("spelling"), F.lit("alias").alias("kind"))
    words = F.split("canon_value", r"[\s-]+")
    ini = canon.where(F.size(words) > 1).select("list_name", "canon_id", F.array_join(F.transform(words, lambda x: F.substring(x, 1, 1)), "").alias("spelling"), F.lit("initials").alias("kind"))
    forms = own.unionByName(al).unionByName(ini).withColumn("form", normal_udf("spelling")).where(F.col("form") != "")
    return forms.groupBy("list_name", "canon_id", "form").agg(F.max("kind").alias("kind")).withColumn("form_id", F.monotonically_increasing_id())


def map_values(values: DataFrame, canon: DataFrame, aliases: dict[str, dict[str, list[str]]] | None = None, order: dict[str, list[str]] | None = None) -> DataFrame:
    """list_name, value -> canon_id (or -1), score, how, for each distinct non-null value of `values(list_name, value)`.

    Values are deduplicated, normalised, looked up in the inverted index of the reference spellings' grams and scored by
    cosine with inverse-frequency weights. Accepted: an equal normal form; a cosine of at least THRESHOLD that leads the
    next entry by MARGIN, which an edit distance of at most a third of the entry's length must confirm below SURE or
    SURE_MARGIN. In a list that `order` names, the runs of words of a value are looked up on their own and, where they name
    several entries, the first in that order is meant. All else is -1. Empty values and values without letters or digits
    are -1. Ties between entries give -1. An empty table gives an empty result; repeated rows are mapped once.
    """
    order = order or {}
    distinct = values.where(F.col("value").isNotNull()).select("list_name", "value").distinct().withColumn("norm", normal_udf("value"))
    distinct = materialise(distinct, "values")
    forms = materialise(reference_forms(canon, aliases), "forms")

    exact = distinct.join(forms.withColumnRenamed("form", "norm"), ["list_name", "norm"]).groupBy("list_name", "norm").agg(F.min("canon_id").alias("a"), F.max("canon_id").alias("b"))
    exact = exact.select("list_name", "norm", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit(-1)).alias("exact_id"))
    todo = distinct.join(exact, ["list_name", "norm"], "left_anti").where(F.col("norm") != "")
    keys = F.when(F.col("list_name").isin(*order), runs_udf("value")).otherwise(F.array("norm")) if order else F.array("norm")
    todo = materialise(todo.select("list_name", "value", F.explode(keys).alias("q")), "runs")

    index_forms = forms.where("kind <> 'initials'")
    fv = _vectors(index_forms, ["list_name", "canon_id", "form_id", "form", "kind"], "form")
    n = index_forms.groupBy("list_name").agg(F.countDistinct("form_id").alias("n"))
    idf = fv.groupBy("list_name", "gram").agg(F.countDistinct("form_id").alias("df")).join(n, "list_name").select("list_name", "gram", F.log1p(F.col("n") / (F.col("df") + 0.5)).alias("idf"))
    index = fv.join(idf, ["list_name", "gram"]).withColumn("fw", F.col("w") * F.col("idf")).drop("w", "idf")
    lens = index.groupBy("list_name", "form_id").agg(F.sqrt(F.sum(F.col("fw") * F.col("fw"))).alias("flen"))

    qv = _vectors(todo.select("list_name", "q").distinct(), ["list_name", "q"], "q").join(idf, ["list_name", "gram"], "left").join(n, "list_name")
    qv = qv.withColumn("qw", F.when(F.col("idf").isNotNull(), F.col("w") * F.col("idf")).otherwise(0.6 * F.col("w") * F.log1p(F.col("n") / 1.5))).select("list_name", "q", "gram", "qw")
    qlen = qv.groupBy("list_name", "q").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qlen"))
    dots = qv.join(index, ["list_name", "gram"]).groupBy("list_name", "q", "form_id", "canon_id", "form", "kind").agg(F.sum(F.col("qw") * F.col("fw")).alias("dot"))
    cos = dots.join(lens, ["list_name", "form_id"]).join(qlen, ["list_name", "q"]).withColumn("score", F.col("dot") / (F.col("flen") * F.col("qlen")))
    best = cos.groupBy("list_name", "q", "canon_id").agg(F.max(F.struct("score", "form")).alias("b")).select("list_name", "q", "canon_id", "b.score", "b.form")
    w = Window.partitionBy("list_name", "q").orderBy(F.desc("score"), "canon_id")
    top = best.withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0.0))).withColumn("rk", F.row_number().over(w)).where("rk = 1")
    top = top.where((F.col("score") >= THRESHOLD) & (F.col("score") - F.col("next") >= MARGIN))
    sure = (F.col("score") >= SURE) & (F.col("score") - F.col("next") >= SURE_MARGIN)
    dist, size = osa_udf("q", "form"), F.length("form")
    near = (F.col("dist") <= F.greatest(F.lit(2.0), F.round(size * 0.34))) & (F.col("dist") * 2 <= size)
    named = top.withColumn("dist", dist).where(sure | near)
    first = F.lit(0)
    for lst, entries in order.items():
        for i, e in enumerate(entries):
            first = F.when((F.col("list_name") == lst) & (F.col("canon_value") == e), i).otherwise(first)
    named = named.join(canon.select("list_name", "canon_id", "canon_value"), ["list_name", "canon_id"]).withColumn("first", first)
    scored = todo.join(named, ["list_name", "q"]).groupBy("list_name", "value").agg(F.min(F.struct("first", (-F.col("score")).alias("neg"), "canon_id")).alias("b"))
    scored = scored.select("list_name", "value", F.col("b.canon_id").alias("scored_id"), (-F.col("b.neg")).alias("s1"))
    return (
        distinct.join(exact, ["list_name", "norm"], "left").join(scored, ["list_name", "value"], "left")
        .select("list_name", "value", F.coalesce("exact_id", "scored_id", F.lit(-1)).cast("long").alias("canon_id"),
                F.when(F.col("exact_id").isNotNull(), 1.0).otherwise(F.coalesce("s1", F.lit(0.0))).alias("score"),
                F.when(F.col("exact_id").isNotNull(), F.lit("equal")).when(F.col("scored_id").isNotNull(), F.lit("cosine")).otherwise(F.lit("none")).alias("how"))
    )


def _casefold(c: Column) -> Column:
    """Letter case aside, by full case folding: upper case of sharp s is SS."""
    return F.lower(F.replace(c, F.lit("ß"), F.lit("ss")))


def inexact_values(rows: DataFrame, canon: DataFrame, aliases: dict[str, dict[str, list[str]]] | None = None, order: dict[str, list[str]] | None = None) -> DataFrame:
    """field, row_id, canon_id of the rows(field, list_name, row_id, value) whose value is not, letter case aside, an entry.

    The most frequent values, which are entries as they stand, never reach the join; the rest is joined with the mapping
    of distinct values, which AQE splits where one value is hot."""
    entries = canon.select(F.col("list_name").alias("e_list"), _casefold(F.col("canon_value")).alias("e_value")).distinct()
    rest = rows.where(F.col("value").isNotNull()).join(entries, (F.col("list_name") == F.col("e_list")) & (_casefold(F.col("value")) == F.col("e_value")), "left_anti")
    mapped = map_values(rest, canon, aliases, order)
    return rest.join(mapped, ["list_name", "value"]).select("field", "row_id", "canon_id")


def typed_rows(listings: DataFrame, boe: DataFrame) -> DataFrame:
    """field, list_name, row_id, value of the three typed columns."""
    cells = F.array(F.struct(F.lit("make").alias("field"), F.lit("make").alias("list_name"), F.col("make").alias("value")), F.struct(F.lit("fuel_type").alias("field"), F.lit("fuel_type").alias("list_name"), F.col("fuel_type").alias("value")))
    return listings.select("row_id", F.inline(cells)).select("field", "list_name", "row_id", "value").unionByName(
        boe.select(F.lit("boe_brand").alias("field"), F.lit("make").alias("list_name"), F.col("id").alias("row_id"), F.col("brand").alias("value"))
    )


ALIASES, ORDER = {"fuel_type": FUEL_WORDS}, {"fuel_type": FUEL_ORDER}
