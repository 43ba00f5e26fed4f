"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text: densities of lexicon words by their strength, how many of them stand near a
second-person pronoun, capitals, punctuation, and rates of obfuscated spellings (digits and symbols inside words,
stretched letters, words that are in the lexicon only when read without them). The lexicon is learned: stems
(first letters of words, and whole words) with the lower bound of their share of toxic documents.

Learning takes a bounded sample of labelled documents (``SAMPLE_ROWS``, one row for each different text),
dealt into folds by the text. A document of the sample is counted by a lexicon of the other folds, or features would
look better than they are. Spark's trees learn from all folds but the first, and Spark's isotonic regression
from what they say of the first. Scoring is one pass: features in Arrow batches, trees and calibration on the JVM side.
What is equal after calibration keeps the order of the trees by a thousandth of their own probability.

Defined results: a null text is an empty one and gets a score like any other; null labels, labels without a
document and null keys teach nothing; of an id's labels the worst holds, of equal texts' too; without both
labels in the sample every score is the share of label 1, 0 without labels; repeated rows are scored each; columns besides key and text
are not returned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model as Fitted
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterloom.llm.common import by_batches
from shutterloom.session import fresh_path, remove, written

#: Labelled documents that are learned from, at most: those with the least hash of their key (its low 20 bits).
SAMPLE_ROWS = 40_000
#: Lengths of stems besides whole words; a stem counts if so many toxic documents of the sample hold it, and the
#: lower bound of its share of toxic ones (of so many standard errors) reaches WEAK; STEMS at most, the most telling first.
STEM_LENGTHS, STEM_DOCS, ERRORS, WEAK, STRONG, STEMS = (4, 5, 7), 3, 2.0, 0.35, 0.7, 20_000
#: Parts of the sample by the hash of the text.
FOLDS = 3
TREES, DEPTH, STEP, BINS, LEAF = 40, 4, 0.2, 64, 5
#: Words around a lexicon word in which a pronoun counts; the share of the trees' own probability in a score.
NEAR, TIES = 5, 1e-3
#: Words that a task remembers the properties of, and stems that it counts before it passes the counts on.
KNOWN, HELD = 300_000, 400_000
#: Pronouns of the second person in English, German, French and Spanish.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
#: What stands for a letter in disguised words.
DISGUISE = str.maketrans("013457@$!|", "oieastasii")
EDGES = ".,;:!?\"'()[]{}<>«»¡¿…-–—*_~`|/\\"
#: By place: all capitals, weight, weight found in disguise only, second person, marks, runs of marks, disguised.
PROPERTIES = 7
NAMES = ("log_words", "strong_a_word", "weak_a_word", "log_strong", "log_distinct", "most", "second_most", "weight_a_word", "strong_near_you", "you_a_word", "capitals_a_letter", "shouted_a_word", "marks_a_word", "mark_runs_a_word", "disguised_a_word", "found_in_disguise_a_word")
STRETCHED, SYMBOL, RUN = re.compile(r"([^\W\d_])\1\1"), re.compile(r"[\d@$*|!]"), re.compile(r"[!?.]{2}")
#: Capitals with and without accents.
CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")


def stems(word: str) -> list[str]:
    """First letters of a word in lower case, and the word itself with a stop."""
    return [word[:n] for n in STEM_LENGTHS if len(word) > n] + [f"{word}."] if len(word) > 2 else []


def plain(word: str) -> str:
    return word.strip(EDGES).lower()


class Words(dict):
    """Place of each word in a table of properties, which are computed once a word; 0 for those that have none."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.table, self.used = lexicon, np.zeros((1024, PROPERTIES), np.float32), 1
        #: What all words that the lexicon knows begin with.
        self.begin = {s[: STEM_LENGTHS[0]] for s in lexicon}

    def clear(self) -> None:
        super().clear()
        self.used = 1

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(s, 0.0) for s in stems(word)), default=0.0) if f"{word}."[: STEM_LENGTHS[0]] in self.begin else 0.0

    def __missing__(self, raw: str) -> int:
        core = raw.strip(EDGES)
        word = core.lower()
        pure, stretched = core.isalpha(), STRETCHED.search(word) is not None
        marks = raw.count("!") + raw.count("?") if len(core) < len(raw) else 0
        run = len(raw) - len(core) > 1 and RUN.search(raw) is not None
        shouted = len(core) > 2 and core.isupper()
        weight, hidden, disguised = self.weight(word), 0.0, stretched
        if not pure or stretched:
            disguised = stretched or (SYMBOL.search(core) is not None and any(map(str.isalpha, core)))
            if not weight and disguised:
                bare = re.sub(r"[^\w]|[\d_]", "", word.translate(DISGUISE))
                hidden = max(self.weight(bare), self.weight(re.sub(r"(.)\1\1+", r"\1", bare)))
        you = word in YOU
        if not (weight or hidden or you or marks or run or shouted or disguised):
            self[raw] = 0
            return 0
        at = self[raw] = self.used
        self.used += 1
        if at >= len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[at] = shouted, weight or hidden, hidden, you, marks, run, disguised
        return at


def features(text: str | None, words: Words) -> list[float]:
    """The features of one text, see ``NAMES``."""
    tokens = text.split() if text else []
    if not tokens:
        return [0.0] * len(NAMES)
    if len(words) > KNOWN:
        words.clear()
    at = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    place = np.flatnonzero(at)
    x = words.table[at[place]]
    n, total, weight = len(tokens), x.sum(0, dtype=np.float64), x[:, 1]
    told = weight >= WEAK
    strong, you, near = int((weight >= STRONG).sum()), place[x[:, 3] > 0], 0
    if told.any() and len(you):
        here = place[told]
        after = np.searchsorted(you, here)
        gap = np.minimum(np.abs(you[np.minimum(after, len(you) - 1)] - here), np.abs(you[np.maximum(after - 1, 0)] - here))
        near = int((gap <= NEAR).sum())
    different = np.sort(words.table[np.unique(at[place[told]])][:, 1])[::-1]
    most = [*different[:2].tolist(), 0.0, 0.0][:2]
    letters = sum(map(len, tokens))
    capitals, hidden = len(CAPITALS.findall(text)) / letters, int((x[:, 2] > 0).sum()) / n
    shouted, weights, _, _, marks, runs, disguised = total / n
    by_word = [np.log1p(n), strong / n, (int(told.sum()) - strong) / n, np.log1p(strong), np.log1p(len(different)), *most, weights]
    return [*by_word, near / n, len(you) / n, capitals, shouted, marks, runs, disguised, hidden]


def with_features(docs: DataFrame, key: str, text: str, lexicons: list[dict[str, float]], others: list[str] = [], fold: str | None = None) -> DataFrame:  # noqa: B006
    """(key, others, features array): by the lexicon of the row's fold, or the first one."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicons)  # STEMS entries each at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Words(x) for x in sent.value]
        for batch in batches:
            folds = batch.column(2).to_pylist() if fold else [0] * batch.num_rows
            out = [features(t, known[k]) for t, k in zip(batch.column(1).to_pylist(), folds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + bool(fold) + i) for i in range(len(others))), pa.array(out, pa.list_(pa.float64()))], names=[key, *others, "features"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *others)) + ", features array<double>"
    return by_batches(docs.select(key, text, *([fold] if fold else []), *others), run, schema)


def _stem_counts(taught: DataFrame, text: str) -> DataFrame:
    """(stem, toxic_k, n_k for each fold k): documents that hold a stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            for (k, toxic), of in held.items():
                same = lambda v, of=of: pa.array(np.full(len(of), v), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(of.keys(), pa.string()), same(k), same(toxic), pa.array(of.values(), pa.int64())], names=["stem", "fold", "toxic", "n"])
            held.clear()

        held: dict[tuple[int, int], Counter[str]] = {}
        for batch in batches:
            for t, k, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((k, toxic), Counter()).update({s for w in set(map(plain, set((t or "").split()))) for s in stems(w)})
            if sum(map(len, held.values())) >= HELD:
                yield from counted()
        yield from counted()

    counts = by_batches(taught.select(text, "fold", F.col("label").cast("int")), run, "stem string, fold int, toxic int, n long").groupBy("stem")
    return counts.agg(*(f.alias(f"{name}_{k}") for k in range(FOLDS) for name, f in (("toxic", F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == 1), F.col("n")).otherwise(0))), ("n", F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0))))))


def lower_bound(toxic: Column | float, n: Column | float, root=np.sqrt):
    """Lower end of Wilson's interval of a share."""
    z2, share = ERRORS**2, toxic / n
    return (share + z2 / (2 * n) - ERRORS * root(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def _lexicon(counts: list[dict], without: int | None = None) -> dict[str, float]:
    out = {}
    for r in counts:
        toxic, n = (sum(r[f"{c}_{k}"] for k in range(FOLDS) if k != without) for c in ("toxic", "n"))
        if toxic >= STEM_DOCS and (share := float(lower_bound(toxic, n))) >= WEAK:
            out[r["stem"]] = share
    return out


@dataclass
class Model:
    """Lexicon, trees, calibration; without trees every score is ``share``."""

    lexicon: dict[str, float]
    trees: Fitted | None
    calibration: Fitted | None
    share: float

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds ``score`` to rows with an array of features."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.share))
        own = self.trees.transform(rows.withColumn("vector", array_to_vector("features")))
        own = own.withColumn("own", vector_to_array("probability")[1])
        out = self.calibration.transform(own)
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - TIES) * F.col("calibrated") + TIES * F.col("own")))
        return out.withColumn("score", score).drop("vector", "rawPrediction", "probability", "prediction", "own", "calibrated")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled documents (1: toxic)."""
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max((F.col(label) == 1).cast("int")).alias("label"))
    # the documented bound; so it can be broadcast. What can't be among the least hashes stays where it is: each task
    # would send as many rows otherwise
    share = min(1.0, (rows * 1.5 + 1000) / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) <= share * (1 << 20)).orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 20)), key).limit(rows)
    taught = docs.select(key, F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(sample), key)
    taught = taught.withColumn("at", F.xxhash64("text")).groupBy("at").agg(F.first("text").alias("text"), F.max("label").alias("label"))
    path = fresh_path(spark, "taught")
    taught = written(taught.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "at"), F.lit(FOLDS)).cast("int")), "taught", path)
    both = {(r["label"], r["fold"] == 0): r["n"] for r in taught.groupBy("label", "fold").agg(F.count("*").alias("n")).groupBy("label", "fold").agg(F.sum("n").alias("n")).collect()}
    toxic, n = sum(v for (y, _), v in both.items() if y == 1), sum(both.values())

    toxic_of, n_of = (sum((F.col(f"{c}_{k}") for k in range(FOLDS)), F.lit(0)) for c in ("toxic", "n"))
    telling = _stem_counts(taught, "text").where(toxic_of >= STEM_DOCS).withColumn("bound", lower_bound(toxic_of, n_of, F.sqrt)).where(F.col("bound") >= WEAK * 0.8)
    counts = [r.asDict() for r in telling.orderBy(F.desc(F.col("bound") * F.log1p(toxic_of)), "stem").limit(STEMS).collect()]
    lexicons = [_lexicon(counts, k) for k in range(FOLDS)]
    rows_of = with_features(taught.withColumn("rest", F.col("fold")), "at", "text", lexicons, ["label", "rest"], "fold")
    seen_path = fresh_path(spark, "features")
    # bounded by the sample; in one part, so that the trees' few hundred small jobs are one task each
    seen = written(rows_of.repartition(1).sortWithinPartitions("at"), "features", seen_path)
    out = Model(_lexicon(counts), None, None, toxic / n if n else 0.0)
    apart = {(r["label"], r["first"]) for r in seen.select("label", (F.col("rest") == 0).alias("first")).distinct().collect()}
    if {(0, False), (1, False)} <= apart:
        learn = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=BINS, minInstancesPerNode=LEAF, seed=42)
        vectors = seen.withColumn("vector", array_to_vector("features"))
        trees = learn.fit(vectors.where("rest <> 0").select("vector", "label"))
        # without both labels in the first fold, what the trees learned from calibrates them
        held = vectors.where("rest = 0") if {(0, True), (1, True)} <= apart else vectors
        own = trees.transform(held).select(vector_to_array("probability")[1].alias("own"), F.col("label").cast("double"))
        calibration = IsotonicRegression(featuresCol="own", labelCol="label", predictionCol="calibrated").fit(own)
        out = Model(out.lexicon, trees, calibration, out.share)
    remove(spark, path)
    remove(spark, seen_path)
    return out


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row."""
    rows = model.scored(with_features(docs, key, text, [model.lexicon]))
    return rows.select(key, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
