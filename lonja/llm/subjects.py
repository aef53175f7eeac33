"""Subject areas of documents: weighted terms, a multi-pattern automaton, sentence shares against calibrated thresholds."""

from __future__ import annotations

import functools
import html
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.session import materialise, parallelism

#: The share of a text's sentences an area must take; `calibrate` may move it within GRID by the labelled sample, for a
#: subject of its own from MIN_LABELS texts on.
SHARE, MIN_LABELS = 0.2, 40
GRID = (0.16, 0.17, 0.18, 0.19, 0.2, 0.21, 0.22)
#: The least sum of term weights over the square root of its length that a sentence must have; `calibrate` chooses.
VOTES, VOTE = (0.08, 0.15, 0.25, 0.4), 0.15
#: Counts of terms that a task of the fit holds before it hands them on.
HELD = 500_000
#: Terms that are broadcast, at most.
MOST_TERMS = 200_000
#: Longest term in words, least support, least share of its texts with the label, least log-likelihood gain.
MAX_WORDS, MIN_TEXTS, MIN_PRECISION, MIN_GAIN = 4, 2, 0.6, 4.0
SEED_WEIGHT = 1.5

# Curated terms of each area in Spanish, German and English, folded to lower case without accents.
CURATED = {
    1: "impuesto; cuota tributaria; hacienda; iva; steuer; umsatzsteuer; vorsteuer; finanzamt; tax; vat; duty; allowance",
    2: "matriculacion; homologacion; ficha tecnica; permiso de circulacion; zulassung; fahrzeugbrief; typgenehmigung; registration; licensing office; type approval",
    3: "par motor; turbo; cilindros; inyeccion; cambio de marchas; drehmoment; hubraum; turbolader; getriebe; torque; gearbox; cylinder; camshaft",
    4: "bateria; autonomia; carga rapida; enchufar; akku; ladesaule; reichweite; schnellladen; battery; charging point; range; inverter",
    5: "emisiones; co2; particulas; zona de bajas emisiones; umweltzone; stickoxid; partikelfilter; emission; climate; smog; nitrogen oxide",
    6: "depreciacion; valor residual; demanda; oferta; restwert; wertverlust; angebot; nachfrage; resale; depreciation; asking price; market share",
    7: "leasing; prestamo; financiar; seguro; darlehen; versicherung; finanzierung; monatsrate; loan; insurance; instalment; interest rate",
    8: "revision; aceite; frenos; averia; zahnriemen; olwechsel; bremsen; werkstatt; oil change; brake pads; coolant; servicing",
    9: "transporte; camion; entrega; porte; spedition; lieferung; autotransporter; frachtbrief; delivery; shipment; carrier; freight",
    10: "carrera; boxes; circuito; vuelta rapida; rennen; rennstrecke; boxenstopp; rallye; race; pit stop; fastest lap; grid",
    11: "aplicacion; pantalla; navegador; actualizacion; software; bildschirm; sprachassistent; bluetooth; app; touchscreen; update; navigation",
    12: "airbag; cinturon; choque; frenada de emergencia; aufprall; gurt; notbremse; unfall; seat belt; crash test; emergency braking; collision",
}

_TAG = re.compile(r"<[^>]*>")
_BREAK = re.compile(r"(?<=[.!?])\s+|\n+")
_WORDS = re.compile(r"[a-z0-9]+")
_NUMBER = re.compile(r"(?<![a-z0-9])[0-9]+(?![a-z0-9])")


class _Plain(dict):
    """Code point -> its compatibility decomposition without combining marks, filled as characters occur."""

    def __missing__(self, code: int) -> str:
        self[code] = "ss" if code == 0xDF else "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        return self[code]


_PLAIN = _Plain()


def fold(text: str) -> str:
    if "<" in text:
        text = _TAG.sub(" ", text)
    t = (html.unescape(text) if "&" in text else text).lower()
    return t if t.isascii() else t.translate(_PLAIN)


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence of the whole text. A one- or two-word answer belongs to the question before it;
    numbers are all one word; empty sentences do not count."""
    out: list[list[str]] = []
    asked = False
    for part in _BREAK.split(_NUMBER.sub("9", fold(text or ""))):
        words = _WORDS.findall(part)
        if words and not (asked and len(words) <= 2):
            out.append(words)
        asked = part.rstrip().endswith("?")
    return out


def ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, MAX_WORDS + 1) for i in range(len(words) - n + 1)}


def labelled_ids(labels: DataFrame) -> DataFrame:
    """doc_id, subjects of all labelled texts. Written, so that its size is known where texts and hits are joined with it."""
    return materialise(labels.where("doc_id is not null and subject_id is not null").groupBy("doc_id").agg(F.collect_set("subject_id").alias("subjects")), "labels")


def labelled_sample(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text, subjects of the labelled texts, of repeated ids one text; in partitions of a hash, so that the fit is
    shared out."""
    return docs.select("doc_id", "text").join(ids, "doc_id").repartition(parallelism(docs.sparkSession), "doc_id").dropDuplicates(["doc_id"])


def fit_terms(sample: DataFrame) -> dict[str, dict[int, float]]:
    """term -> {subject: weight} before rarity. A term's weight is its log odds of the label against the label's own odds;
    curated terms join with a fixed weight unless the sample speaks against them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in batches:
            for text, subjects in zip(pdf["text"], pdf["subjects"]):
                seen = set().union(*map(ngrams, sentences(text)), [""])
                for s in (0, *(int(x) for x in subjects if x)):
                    n.update((g, s) for g in seen)
                if len(n) > HELD:  # added up below
                    yield pd.DataFrame([(g, s, c) for (g, s), c in n.items()], columns=["term", "subject", "n"])
                    n.clear()
        yield pd.DataFrame([(g, s, c) for (g, s), c in n.items()], columns=["term", "subject", "n"])

    counts = sample.mapInPandas(count, "term string, subject int, n long").groupBy("term", "subject").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("term").agg(F.max(F.when(F.col("subject") == 0, F.col("n"))).alias("m"), F.map_from_entries(F.collect_list(F.struct("subject", "n"))).alias("by"))
    counts = materialise(counts, "counts")
    curated = {t.strip(): s for s, ts in CURATED.items() for t in ts.split(";")}
    all_row = counts.where("term = ''").collect()
    total = all_row[0].m if all_row else 0
    base = {s: n / total for s, n in all_row[0].by.items() if s} if total else {}
    odds = F.create_map(*[F.lit(x) for kv in base.items() for x in kv]) if base else F.create_map().cast("map<int,double>")

    def worth(e: Column) -> Column:
        """Whether a subject's gain may suffice; it is settled below."""
        m, x, q = F.col("m"), e["value"], odds[e["key"]]
        gain = x * F.log(x / m / q) + F.when(m > x, (m - x) * F.log((1 - x / m) / (1 - q))).otherwise(0.0)
        return (e["key"] != 0) & (x >= MIN_PRECISION * m - 1e-6) & (q < 1) & (gain >= MIN_GAIN - 1e-6)

    keep = counts.where(((F.col("m") >= MIN_TEXTS) & F.exists(F.map_entries("by"), worth)) | F.col("term").isin(*curated)).where("term <> ''")
    terms: dict[str, dict[int, float]] = {t: {s: SEED_WEIGHT} for t, s in curated.items()}
    for r in keep.collect():
        m = r.m
        if r.term in curated and m >= 5 and r.by.get(curated[r.term], 0) < MIN_PRECISION * m:
            terms.pop(r.term, None)
        for s, x in r.by.items():
            p, q = x / m, base.get(s, 0)
            if not s or m < MIN_TEXTS or p < MIN_PRECISION or not 0 < q < 1:
                continue
            gain = x * math.log(p / q) + ((m - x) * math.log((1 - p) / (1 - q)) if m > x else 0)
            if gain >= MIN_GAIN:
                terms.setdefault(r.term, {})[s] = round(math.log((x + 0.3) / (m - x + 0.3)) - math.log(q / (1 - q)), 4)
    if len(terms) > MOST_TERMS:
        raise ValueError("too many terms to broadcast")
    return prune(terms)


def prune(terms: dict[str, dict[int, float]]) -> dict[str, dict[int, float]]:
    """Drops a term that holds a shorter term of the same subject with at least nine tenths of its weight."""
    kept = {}
    for t, by in terms.items():
        w = t.split()
        parts = [" ".join(w[i : i + n]) for n in range(1, len(w)) for i in range(len(w) - n + 1)]
        left = {s: x for s, x in by.items() if not any(terms.get(p, {}).get(s, -1) >= 0.9 * x for p in parts)}
        if left:
            kept[t] = left
    return kept


@functools.lru_cache(4)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        a.add_word(f" {term} ", i)
    a.make_automaton()
    return a


HITS = T.StructType([T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("term", T.ArrayType(T.IntegerType()))])


def text_hits(text: str | None, automaton) -> tuple[list[int], list[int], list[int]]:
    """Words of each sentence, and the sentences and terms of the hits, each term once a sentence."""
    sents = sentences(text)
    if not sents:
        return [], [], []
    parts, starts, at = [], [], 0
    for w in sents:
        starts.append(at)
        part = " " + " ".join(w) + " "
        parts.append(part)
        at += len(part) + 1
    seen = {(bisect_right(starts, end) - 1, term) for end, term in automaton.iter("|".join(parts))}
    found = sorted(seen)
    return [len(w) for w in sents], [k for k, _ in found], [t for _, t in found]


def document_hits(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, words, at, term of each text: one pass of the automaton over the whole text."""
    items = docs.sparkSession.sparkContext.broadcast(tuple(terms))

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.DataFrame:
        a = _automaton(items.value)
        return pd.DataFrame([text_hits(t, a) for t in texts], columns=HITS.fieldNames())

    return docs.select("doc_id", hits("text").alias("h")).select("doc_id", "h.*")


def weigh_terms(hits: DataFrame, terms: dict[str, dict[int, float]]) -> np.ndarray:
    """Weights by term and subject: those of the fit times half plus half the term's rarity, which is counted over all
    documents, curated and other terms alike."""
    n = hits.agg(F.count("*").alias("n")).collect()[0].n
    seen = dict(hits.select(F.explode(F.array_distinct("term")).alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect())
    out = np.zeros((len(terms), 1 + max((s for by in terms.values() for s in by), default=0)), "float32")
    for i, by in enumerate(terms.values()):
        rarity = math.log(1 + n / max(1, seen.get(i, 0))) / math.log(1 + max(n, 1))
        for s, x in by.items():
            out[i, s] = x * (0.5 + 0.5 * rarity)
    return out


def batch_shares(pdf: pd.DataFrame, weights: np.ndarray, vote: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, subject, share of sentences) of a batch. A sentence belongs to the subject with the largest sum of term weights,
    the lower number among equals, if that sum over the square root of its words exceeds the vote."""
    count = pdf["words"].map(len).to_numpy(dtype="int64") if len(pdf) else np.zeros(0, "int64")
    first = np.cumsum(count) - count
    words = np.concatenate([np.asarray(w, "int64") for w in pdf["words"]]) if count.sum() else np.zeros(0, "int64")
    if not len(words):
        return (np.zeros(0, "int64"),) * 2 + (np.zeros(0),)
    hits = pdf["at"].map(len).to_numpy(dtype="int64")
    at = np.concatenate([np.asarray(a, "int64") for a in pdf["at"]]) + np.repeat(first, hits)
    term = np.concatenate([np.asarray(t, "int64") for t in pdf["term"]])
    score = np.stack([np.bincount(at, weights[term, s], len(words)) for s in range(weights.shape[1])], axis=1)
    best = score.argmax(axis=1)
    won = (score[np.arange(len(words)), best] / np.sqrt(words) > vote) & (best > 0)
    row = np.repeat(np.arange(len(pdf)), count)[won]
    pair, n = np.unique(row * weights.shape[1] + best[won], return_counts=True)
    return pair // weights.shape[1], pair % weights.shape[1], n / count[pair // weights.shape[1]]


def subject_shares(hits: DataFrame, weights: np.ndarray, votes: tuple[float, ...] = (VOTE,)) -> DataFrame:
    """doc_id, vote, subject_id, share of sentences, for every subject with a sentence in the text."""
    table = hits.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            for v in votes:
                row, subject, share = batch_shares(pdf, table.value, v)
                yield pd.DataFrame({"doc_id": ids[row], "vote": v, "subject_id": subject.astype("int32"), "share": share})

    return hits.mapInPandas(run, f"doc_id {dict(hits.dtypes)['doc_id']}, vote double, subject_id int, share double")


def calibrate(hits: DataFrame, labels: DataFrame, weights: np.ndarray) -> tuple[float, dict[int, float], float]:
    """The vote with the best F1 on the labelled sample, the share of each subject with enough labels, and that of all others:
    the nearest to SHARE among those within 0.002 of the best F1."""
    got = subject_shares(hits.join(labels.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), weights, VOTES).join(labels, "doc_id")
    hit = F.array_contains("subjects", F.col("subject_id"))
    aggs = [F.count_if((F.col("share") >= t - 1e-9) & hit).alias(f"h{i}") for i, t in enumerate(GRID)] + [F.count_if(F.col("share") >= t - 1e-9).alias(f"a{i}") for i, t in enumerate(GRID)]
    rows = got.groupBy("vote", "subject_id").agg(*aggs).collect()  # a few subjects
    true = {r.s: r.n for r in labels.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select(F.explode("subjects").alias("s")).where("s <> 0").groupBy("s").agg(F.count("*").alias("n")).collect()}

    def best(own: list, n: int) -> tuple[float, float]:
        f1 = [2 * sum(r[f"h{i}"] for r in own) / max(1, sum(r[f"a{i}"] for r in own) + n) for i in range(len(GRID))]
        top = max(f1)
        return top, min((t for t, f in zip(GRID, f1) if f >= top - 0.002), key=lambda t: abs(t - SHARE))

    by_vote = {v: [r for r in rows if r.vote == v] for v in VOTES}
    score = {v: best(own, sum(true.values()))[0] for v, own in by_vote.items()}
    vote = min((v for v in VOTES if score[v] >= max(score.values()) - 0.001), key=lambda v: abs(v - VOTE))
    share = best(by_vote[vote], sum(true.values()))[1]
    own = {s: best([r for r in by_vote[vote] if r.subject_id == s], n)[1] for s, n in true.items() if n >= MIN_LABELS}
    return vote, own, share


def document_subjects(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, subject_id, share: every subject that takes at least its calibrated share of a text's sentences.

    Null and empty texts, and texts of markup only, have no subject. Texts are read whole, once. A doc_id that occurs twice
    is assessed twice. Without labels the curated terms, SHARE and VOTE are used as they stand."""
    ids = labelled_ids(labels)
    terms = fit_terms(labelled_sample(docs, ids))
    hits = materialise(document_hits(docs, list(terms)), "hits")
    weights = weigh_terms(hits, terms)
    vote, own, share = calibrate(hits, ids, weights)
    least = F.lit(share)
    for s, t in own.items():
        least = F.when(F.col("subject_id") == s, t).otherwise(least)
    return subject_shares(hits, weights, (vote,)).where(F.col("share") >= least - 1e-9).select("doc_id", "subject_id", "share")
