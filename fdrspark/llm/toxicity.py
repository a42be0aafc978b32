"""Toxicity by a classifier that is held to equal scores when identity terms are swapped."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fdrspark.llm.common import fold_of, slices, stored, table, texts, trimmed

#: Most labelled rows of each class that the classifier learns from, taken by hash order.
SAMPLE = 4000
#: Most terms that it weighs, those that tell the classes apart best; and texts of the sample that a term must stand in.
TERMS, LEAST_DOCS = 400, 5
#: The ridge on a term's weight is RIDGE * (SURE / z) ** 4 for its two-sample z: what tells little weighs little, without a bound that cuts it off.
RIDGE, SURE = 0.1, 10.0
#: Weight of the score changes of swapped sentences, as many times their mean as there are rows.
FAIR = 1.0
#: Words that stand for mentions of groups besides the listed ones: at most so many, in between these shares of the texts of either class, |z| below 1, MATES of like frequency standing for one another.
MENTIONS, MENTION_SHARES, MENTION_Z, MATES = 40, (0.05, 0.5), 1.0, 4
THRESHOLD = 0.7
STEM = 5

#: Identity terms; those of one line stand for one another.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("american", "mexican", "chinese", "african", "european", "indian"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly"),
)

_TERM = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def terms_of(text: str) -> set[str]:
    """The words of a text in lower case, and of longer ones the first five characters, which inflected forms share."""
    words = set(_TERM.findall(text.lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE) -> DataFrame:
    """(id, text, label): at most ``most`` labelled rows of each class, by the hash order of their ids.

    An id that is labelled more than once counts once, as toxic if any label says
    so. Only ids whose hash is among the least go on to be sorted: some more than
    ``most`` of a class, however many it has.
    """
    one = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("label"))
    one = stored(one.filter("label IN (0, 1)"), "labels")
    n = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64("i").bitwiseAND(F.lit(2**52 - 1)) / F.lit(2.0**52)
    share = F.when(F.col("label") == 1, F.lit((1.2 * most + 200) / max(1, n.get(1, 0)))).otherwise(F.lit((1.2 * most + 200) / max(1, n.get(0, 0))))
    order = Window.partitionBy("label").orderBy("place", "i")
    picked = one.withColumn("place", place).filter(F.col("place") < share).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("i", "label")
    # picked has 2 * most rows of two numbers at the most, whatever the input is.
    joined = docs.select(F.col(id_col).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), F.col("d") == F.col("i"))
    return joined.select(F.col("i").alias("id"), "text", "label")


def term_table(sample: DataFrame) -> DataFrame:
    """(term, pos, n, z): in how many toxic texts, and how many in all, each term of the sample stands, and the z of the two shares."""

    def run(batches):
        for batch in batches:
            out, label = [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms_of(t)
                out += found
                label += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(label, pa.int32())], names=["term", "label"])

    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    each = sample.select("text", "label").mapInArrow(trimmed(run), "term string, label int").groupBy("term").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    p, q, share = F.col("pos") / pos, (F.col("n") - F.col("pos")) / neg, F.col("n") / (pos + neg)
    each = each.withColumn("z", (p - q) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-12)).withColumn("p", p).withColumn("q", q)
    return stored(each, "toxic_terms")


def telling_terms(table: DataFrame, *, most: int = TERMS, least_docs: int = LEAST_DOCS) -> dict[str, float]:
    """The terms whose presence tells the classes apart best, and their |z|."""
    best = table.filter(F.col("n") >= least_docs).select("term", F.abs("z").alias("z")).orderBy(F.desc("z"), "term").limit(most)
    return {r["term"]: r["z"] for r in best.collect()}


def mention_groups(table: DataFrame, *, most: int = MENTIONS, shares: tuple[float, float] = MENTION_SHARES, least_z: float = MENTION_Z, mates: int = MATES) -> tuple[tuple[str, ...], ...]:
    """Words of the labelled texts themselves that stand for neutral mentions, as groups that are swapped among each other.

    They stand in a middling share of the texts of both classes alike, so that
    a difference between them says nothing about toxicity: |z| is below ``least_z``.
    The commonest ``most`` of them are taken, neighbours in frequency make a group.
    """
    low, high = shares
    alike = table.filter((F.abs("z") < least_z) & F.col("p").between(low, high) & F.col("q").between(low, high) & F.col("term").rlike(r"^\p{L}{3,}$"))
    words = [r["term"] for r in alike.orderBy(F.desc("n"), "term").limit(most).collect()]
    groups = [tuple(words[i : i + mates]) for i in range(0, len(words), mates)]
    return tuple(g for g in groups if len(g) > 1)


def swaps(text: str, place: dict[str, int], groups=IDENTITY) -> list[tuple[list[int], list[int]]]:
    """For each sentence with a term of a group, and each term that may stand for it: the features lost and gained.

    A listed identity term also gives way to a word that has no feature, as any
    neutral noun.
    """
    mates = {t: g for g in groups for t in g}
    listed = {t for g in IDENTITY for t in g}
    out = []
    for s in _SENTENCE.findall(text.lower()):
        found = set(_TERM.findall(s))
        for t in found & mates.keys():
            lost = [place[x] for x in (t, t[:STEM] + "*") if x in place and (x == t or len(t) > STEM)]
            for other in (*mates[t], *([None] if t in listed else [])):
                if other != t and other not in found:
                    gained = [place[x] for x in (other, (other or "")[:STEM] + "*") if x in place and (x == other or len(other or "") > STEM)]
                    if lost or gained:
                        out.append((sorted(lost), sorted(gained)))
    return out


class Classifier:
    """Logistic over the presence of terms; ``weights[-1]`` is the bias."""

    def __init__(self, terms: list[str], weights: np.ndarray):
        self.terms, self.weights, self.groups, self.swapped = terms, weights, (), 0
        self.weight = dict(zip(terms, weights[:-1].tolist(), strict=True))

    def score(self, text: str) -> float:
        logit = self.weights[-1] + sum(map(self.weight.__getitem__, sorted(terms_of(text) & self.weight.keys())))
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def fit(rows: list[tuple[list[int], int]], deltas: list[tuple[list[int], list[int], int]], terms: list[str], *, sure: np.ndarray | None = None, ridge: float = RIDGE, fair: float = FAIR, steps: int = 40) -> Classifier:
    """Newton steps on the log loss, both classes weighing alike, + ridge on the weights + the squared score changes of all swaps.

    deltas are (features lost, features gained, how often). ``sure`` has the |z| of
    each term; what tells little has the larger ridge.
    """
    d = len(terms) + 1
    x = np.zeros((len(rows), d))
    y = np.zeros(len(rows))
    for i, (features, label) in enumerate(rows):
        x[i, features] = 1
        y[i] = label
    x[:, -1] = 1
    heavy = np.where(y == 1, (len(y) - y.sum()) / max(1.0, y.sum()), 1.0)
    z = np.full(d - 1, SURE) if sure is None else np.clip(sure, 0.5, None)
    penalty = np.diag(np.append(ridge * (SURE / z) ** 4, 1e-6))
    total = sum(n for *_, n in deltas)
    for lost, gained, n in deltas:
        v = np.zeros(d)
        v[lost] += 1
        v[gained] -= 1
        at = np.flatnonzero(v)
        penalty[np.ix_(at, at)] += fair * len(rows) * n / total * np.outer(v[at], v[at])
    w = np.zeros(d)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (heavy * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (heavy * (y - p)) - penalty @ w)
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(terms, w)


def train(docs: DataFrame, labels: DataFrame, *, groups=IDENTITY, fair: float = FAIR, most: int = SAMPLE, **columns) -> Classifier:
    """The classifier from a bounded sample of labelled rows; without rows of both classes it scores 0.5 throughout.

    The groups whose terms are swapped are the listed ones and those that
    ``mention_groups`` finds in the sample; the classifier keeps them as ``groups``.
    Swaps are counted where the texts are, so that the driver gets a row per kind.
    """
    sample = stored(labelled_sample(docs, labels, most=most, **columns), "toxic_sample")
    if sample.select("label").distinct().count() < 2:
        return Classifier([], np.zeros(1))
    counted = term_table(sample)
    told, groups = telling_terms(counted), (*groups, *mention_groups(counted))
    swapped = {t for g in groups for t in g}
    terms = sorted({*told, *swapped})
    place = {t: i for i, t in enumerate(terms)}

    def features(batches):
        for batch in batches:
            found = [sorted(place[t] for t in terms_of(s) & place.keys()) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)], names=["id", "features", "label"])

    def changes(batches):
        for batch in (part for b in batches for part in slices(b, 0)):
            count = Counter((tuple(a), tuple(b)) for s in texts(batch, 0) for a, b in swaps(s, place, groups))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], kind), pa.array([k[1] for k in count], kind), pa.array(count.values(), pa.int64())], names=["lost", "gained", "n"])

    i = sample.schema["id"].dataType.simpleString()
    kept = sample.select("id", "text", "label").mapInArrow(trimmed(features), f"id {i}, features array<int>, label int").collect()
    # A row for each pair of terms of a group at the most.
    moved = sample.select("text").mapInArrow(trimmed(changes), "lost array<int>, gained array<int>, n long").groupBy("lost", "gained").agg(F.sum("n").alias("n")).collect()
    rows = [(r["features"], r["label"]) for r in sorted(kept, key=lambda r: str(r["id"]))]
    deltas = sorted((r["lost"], r["gained"], r["n"]) for r in moved)
    # Terms of groups have the least ridge: what they may weigh is for the swaps to say.
    model = fit(rows, deltas, terms, sure=np.array([SURE if t in swapped else told[t] for t in terms]), fair=fair)
    model.groups, model.swapped = groups, sum(n for *_, n in deltas)
    return model


def swap_change(docs: list[str], model: Classifier) -> float:
    """How far the score's logit of a text moves, on average over all swaps of its sentences."""
    place = {t: i for i, t in enumerate(model.terms)}
    moves = [abs(model.weights[lost].sum() - model.weights[gained].sum()) for t in docs for lost, gained in swaps(t, place, model.groups)]
    return float(np.mean(moves)) if moves else 0.0


def score(docs: DataFrame, model: Classifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of each row of docs, by the presence of weighed terms anywhere in its whole text.

    Null counts as empty; an empty text has the score of a text without any
    weighed term. Rows stand alone, repeated ones alike; an empty table gives none;
    other columns, whatever their names, are not read.
    """

    def run(batches):
        for batch in (part for b in batches for part in slices(b, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in texts(batch, 1)], pa.float64())], names=[batch.schema.field(0).name, "score"])

    d = docs.select(F.col(id_col), F.col(text_col))
    return d.mapInArrow(trimmed(run), f"`{id_col}` {d.schema[0].dataType.simpleString()}, score double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold_of("doc_id") != 1))
    return score(docs, model).select("doc_id", (fold_of("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
