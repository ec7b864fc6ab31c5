"""Language ID by hierarchical discrimination.

Linear support vector machines over hashed byte bigrams and trigrams first tell language families apart, one against
one, and then, within the family that won, its languages, again one against one. They have no intercept, so a text's
length doesn't matter and the sum of the weights of its n-grams decides. They are fitted on the driver, on a sample of
labelled rows with a documented bound; prediction runs over all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, ship, table

#: Families of frequent languages. A language that is not named here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "mr", "ne", "bn", "pa", "gu", "ur"],
}
UNKNOWN = "und"
BUCKET_BITS = 15
SAMPLE_ROWS = 400  # of each language at most
SLICE_BYTES = 1 << 20
#: Bytes of ASCII that are not letters count as spaces.
TABLE = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def family(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all trigrams and bigrams of all texts, one column each, and where each text begins. The spaces put
    around a text keep its n-grams free of its neighbours'."""
    parts = [b" " + t.lower().encode("utf-8", "surrogatepass").translate(TABLE) + b"  " for t in texts]
    data = np.frombuffer(b"".join(parts) + b"  ", np.uint8).astype(np.uint32)
    pair = (data[:-2] << np.uint32(8)) | data[1:-1]
    three = (((pair << np.uint32(8)) | data[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    two = (((pair + np.uint32(1)) * np.uint32(2246822519)) >> np.uint32(32 - BUCKET_BITS + 1)) + np.uint32(1 << BUCKET_BITS)
    ends = np.cumsum([len(p) for p in parts])
    return np.stack([three, two]), np.append(0, ends[:-1])


FEATURES = (1 << BUCKET_BITS) + (1 << (BUCKET_BITS - 1))


def sums(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """For each text and weight vector the mean weight of its n-grams."""
    out, part, size = [], [], 0
    for k, text in enumerate(texts):
        part.append(text)
        size += len(text)
        if size >= SLICE_BYTES or k == len(texts) - 1:
            codes, starts = coded(part)
            count = np.diff(np.append(starts, codes.shape[1]))
            out.append(np.stack([np.add.reduceat(w[codes[0]].astype(np.float64) + w[codes[1]], starts) / count for w in weights], 1))
            part, size = [], 0
    return np.concatenate(out) if out else np.empty((0, len(weights)))


def examples(text: str) -> list[np.ndarray]:
    """A labelled text teaches as a whole and by a few short stretches, as there are short documents too."""
    w = text.split()
    stretches = [" ".join(w[i : i + 8]) for i in range(0, len(w), max(8, len(w) // 3))][:3] if len(w) > 16 else []
    out = []
    for t in [text, *stretches]:
        codes, _ = coded([t])
        index, count = np.unique(codes.ravel(), return_counts=True)
        value = np.sqrt(count)
        out.append((index, value / np.linalg.norm(value)))
    return out


def fit_svm(positive: list, negative: list, epochs: int = 8, c: float = 1e-4) -> np.ndarray:
    """Averaged stochastic subgradient descent on the hinge loss, both sides weighing the same."""
    rng = np.random.default_rng(5)
    w, total, scale, seen = np.zeros(FEATURES), np.zeros(FEATURES), 1.0, 0
    both = [(x, 1.0) for x in positive] + [(x, -1.0) for x in negative]
    share = {1.0: len(both) / 2 / max(1, len(positive)), -1.0: len(both) / 2 / max(1, len(negative))}
    for epoch in range(epochs):
        for k in rng.permutation(len(both)):
            (index, value), y = both[k]
            seen += 1
            rate = 1.0 / (1.0 + c * 10 * seen)
            scale *= 1 - c * rate
            if y * scale * (w[index] @ value) < 1:
                w[index] += rate * y * share[y] * value / scale
        if epoch >= epochs // 2:
            total += scale * w
    return (total / max(1, epochs - epochs // 2)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    duels: list[tuple[str, str, str]]  # level ("" or a family), first, second
    weights: np.ndarray
    least: float = 0.0  # scores below it are lower than labelled texts have

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        margins = sums(texts, self.weights) if len(self.duels) else np.zeros((len(texts), 0))
        names, scores = [], []
        members: dict[str, list[str]] = {}
        for lang in self.languages:
            members.setdefault(family(lang), []).append(lang)
        index = {d: k for k, d in enumerate(self.duels)}
        for row in margins:
            one, first = self._winner("", self.families, row, index)
            two, second = self._winner(one, members[one], row, index)
            names.append(two)
            scores.append(float(1 / (1 + np.exp(-10 * min(first, second)))))
        return names, scores

    @staticmethod
    def _winner(level: str, names: list[str], row: np.ndarray, index: dict) -> tuple[str, float]:
        """Most duels won, then the larger sum of margins, then the name; and the margin over the runner-up."""
        if len(names) == 1:
            return names[0], 1.0
        won, margin = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            m = float(row[index[level, a, b]])
            won[a if m >= 0 else b] += 1
            margin[a] += m
            margin[b] -= m
        order = sorted(names, key=lambda x: (-won[x], -margin[x], x))
        a, b = sorted(order[:2])
        return order[0], abs(float(row[index[level, a, b]]))


def fit(labelled: Iterable[tuple[str, str]]) -> Model:
    """labelled: (language, text) rows of the sample."""
    by: dict[str, list] = {}
    taught = [(lang, text) for lang, text in labelled if has_letter(text)]
    for lang, text in taught:
        by.setdefault(lang, []).extend(examples(text))
    languages = sorted(by)
    families = sorted({family(x) for x in languages})
    duels, weights = [], []
    for a, b in combinations(families, 2):
        duels.append(("", a, b))
        weights.append(fit_svm(*[[x for lang in languages if family(lang) == f for x in by[lang]] for f in (a, b)]))
    for f in families:
        for a, b in combinations([x for x in languages if family(x) == f], 2):
            duels.append((f, a, b))
            weights.append(fit_svm(by[a], by[b]))
    model = Model(languages, families, duels, np.array(weights, np.float32).reshape(len(duels), FEATURES))
    names, scores = model.predict([t for _, t in taught]) if taught else ([], [])
    margins = [np.log(s / (1 - s)) for (lang, _), name, s in zip(taught, names, scores, strict=True) if lang == name and 0 < s < 1]
    model.least = float(1 / (1 + np.exp(-min(margins) / 2))) if margins else 0.0  # half the least margin of a text told right
    return model


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2. A row without an id is not held out, and teaches nothing either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on sample_rows different labelled rows of each language at most (fewer by chance where ids repeat): those
    with the smallest hashes of id and text over the whole table, so that reruns agree."""
    rows = docs.select(F.col("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row for each language
    if not counts:
        return Model([], [], [], np.zeros((0, FEATURES), np.float32))
    share = F.pmod("h", F.lit(1_000_003)) / 1_000_003.0
    bound = F.element_at(F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(2.0 * sample_rows / n))]), F.col("lang"))
    near = rows.where(share < bound).groupBy("lang", "h").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_003)), "h"))
    sample = near.withColumn("k", first).where(F.col("k") <= sample_rows).select("lang", "r.doc_id", "r.text").collect()
    return fit((r.lang, r.text) for r in sorted(sample, key=lambda r: (r.lang, r.doc_id, r.text)))


def predictor(model: Model):
    """A vectorised function from texts to (lang_pred, score)."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if has_letter(t)] if model.languages else []
        for at in range(0, len(known), 256):
            part = known[at : at + 256]
            for k, name, score in zip(part, *model.predict([texts[k] for k in part]), strict=True):
                names[k], scores[k] = name, score
        release()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0; so is everything where there is nothing to learn
    from. Repeated rows are predicted each; other columns are not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    model = model or train(docs, text_col, lang_col)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(model)(F.col(text_col)).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def _letters():
    @F.arrow_udf("boolean")
    def letters(texts: pa.Array) -> pa.Array:
        return pa.array(map(has_letter, texts.to_pylist()), pa.bool_())

    return letters


def known_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language can be told, with all their columns; where lang is null, it is the predicted one.

    Rejected are texts without a letter (null and empty ones too) and those that no language wins clearly: whose score
    is below ``Model.least``, the score at half the least margin with which a labelled text of the sample is told right.
    Where there is nothing to learn from, all texts with a letter stay. Repeated rows are judged each.
    """
    ship(docs.sparkSession)
    model = train(docs, text_col, lang_col)
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
    if not model.languages:
        letter = _letters()
        return docs.where(letter(F.col(f"`{text_col}`")))
    judged = judged.withColumn("_p", predictor(model)(F.col(f"_all.`{text_col}`"))).where((F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= model.least))
    return judged.select(*[(F.coalesce(F.col(f"_all.`{c}`"), F.col("_p.lang_pred")) if c == lang_col else F.col(f"_all.`{c}`")).alias(c) for c in docs.columns])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
