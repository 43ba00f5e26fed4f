"""Quality rules: a learned decision list as Spark conditional expressions.

Statistics of whole texts are native column expressions. From labelled documents (a bounded sample,
``SAMPLE_ROWS``) sequential covering learns rules for bad documents: a rule grows by the threshold
literal with the best FOIL gain on two thirds of the sample, is pruned on the other third, and the
rows that it covers are taken out before the next one. The rules become one ordered
``CASE WHEN ... THEN false ... ELSE true END``. Word stems that mark toxic texts are learned from the
same sample by aggregation; their number in a text is one more statistic. Rules see it out of fold: the
stems that a row is counted by come from the other folds, or they would look better than they are.

Defined results: a null text has no words and so fails the base rules; labels that are null or have
no document teach nothing; of an id's labels the worst holds, of its texts the least is learned from;
without any labels the list is empty and only the base rules reject. A column named as ``into`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterloom.session import fresh_path, remove, written

#: Labelled documents that are learned from, at most: those with the least hash of their key.
SAMPLE_ROWS = 20_000
#: Stems are the first letters of words, of these lengths. One is a marker (or a hint) if so many toxic
#: documents of the sample hold it, and of all that hold it this share is toxic; the most frequent count.
STEM_LENGTHS, STEM_DOCS, MARKER_SHARE, HINT_SHARE, STEMS = (4, 5, 7, 12), 5, 0.97, 0.8, 400
#: Threshold candidates for each statistic, literals in a rule, rules, and the least precision of a rule.
CUTS, LITERALS, RULES, PRECISION = 32, 4, 16, 0.75
#: Parts of the sample by the hash of the key.
FOLDS = 3
SPACE = r"[\x20\x09-\x0D]+"
#: Statistics that rules may test; ratios come from these counts.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_capitals", "n_exclamations", "n_digits", "n_markers", "n_hints")


def let(value: Column, body) -> Column:
    """``body`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, n: int = 5) -> Column:
    """Words under windows of n words that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        def length(at: Column) -> Column:
            steps = F.transform(at, lambda p, j: F.when(j == 0, n).otherwise(F.least(F.lit(n), p - F.get(at, j - 1))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(placed, lambda s: let(twice(s), length)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
    return F.when(F.size(words) < n, 0).otherwise(let(windows, covered))


def _stems(words: Column) -> Column:
    """Distinct stems of all lengths; a word no longer than a length is its own stem."""
    lower = F.array_distinct(F.transform(words, F.lower))
    return let(lower, lambda ws: F.array_distinct(F.concat(*(F.transform(ws, lambda w, n=n: F.substring(w, 1, n)) for n in STEM_LENGTHS))))


def statistics(text: Column, markers: tuple[str, ...] = (), hints: tuple[str, ...] = ()) -> Column:
    """A struct of counts over the whole text; see ``COUNTS``."""
    whole = F.coalesce(text, F.lit(""))

    def of(t: Column, words: Column, lines: Column) -> Column:
        known = [F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in (markers, hints)]
        found = let(_stems(words), lambda x: F.struct(*(F.size(F.array_intersect(x, k)).alias(n) for k, n in zip(known, ("markers", "hints"), strict=True)))) if markers or hints else F.struct(F.lit(0).alias("markers"), F.lit(0).alias("hints"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
            F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclamations"),
            F.regexp_count(t, F.lit("[0-9]")).cast("long").alias("n_digits"),
            found["markers"].cast("long").alias("n_markers"),
            found["hints"].cast("long").alias("n_hints"),
        )

    def split(t: Column) -> Column:
        words = F.filter(F.split(t, SPACE), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(words, lambda w: let(lines, lambda x: of(t, w, x)))

    return let(whole, split)


def ratios(s: Column) -> dict[str, Column]:
    """The statistics that rules test, from a struct of counts."""
    per_word = lambda name: s[name] / F.greatest(s["n_words"], F.lit(1))
    return {
        "n_words": s["n_words"].cast("double"),
        "chars_a_word": per_word("word_chars"),
        "symbols_a_word": per_word("n_symbols"),
        "dup_lines_a_line": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        "repeats_a_word": per_word("n_repeat_words"),
        "words_a_line": s["n_words"] / F.greatest(s["n_lines"], F.lit(1)),
        "distinct_a_word": per_word("n_distinct_words"),
        "capitals_a_char": s["n_capitals"] / F.greatest(s["word_chars"], F.lit(1)),
        "exclamations_a_word": per_word("n_exclamations"),
        "digits_a_word": per_word("n_digits"),
        "n_markers": s["n_markers"].cast("double"),
        "n_hints": s["n_hints"].cast("double"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, at least?, threshold): such documents are bad."""

    literals: tuple[tuple[str, bool, float], ...]

    def column(self, values: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, at_least, cut in self.literals:
            out = out & (values[name] >= cut if at_least else values[name] < cut)
        return out

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, at_least, cut in self.literals:
            column = x[:, names.index(name)]
            out &= column >= cut if at_least else column < cut
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if up else '<'} {cut:.6g}" for n, up, cut in self.literals)


def _grown(x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    covered, literals = np.ones(len(x), bool), []
    while len(literals) < LITERALS and (~bad & covered).any():
        at = np.flatnonzero(covered)
        p, n = int(bad[at].sum()), int((~bad[at]).sum())
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for j, name in enumerate(names):
            order = at[np.argsort(x[at, j], kind="stable")]
            values, bad_before = x[order, j], np.concatenate([[0], np.cumsum(bad[order])])
            for cut in np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1)[1:])):
                below = int(np.searchsorted(values, cut))
                for at_least in (True, False):
                    rows = p + n - below if at_least else below
                    hits = p - int(bad_before[below]) if at_least else int(bad_before[below])
                    if hits and rows < p + n:
                        gain = hits * (np.log2(hits / rows) - base)
                        if gain > best[0]:
                            best = (gain, (name, at_least, float(cut)))
        if best[1] is None:
            break
        literals.append(best[1])
        covered &= Rule((best[1],)).covers(x, names)
    return Rule(tuple(literals))


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> float:
    inside = rule.covers(x, names)
    p, n = (bad & inside).sum(), (~bad & inside).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learned(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Rule]:
    """Rules by sequential covering, in order."""
    rules: list[Rule] = []
    third = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < RULES and (bad & left & ~third).sum() >= 3:
        rule = _grown(x[left & ~third], bad[left & ~third], names)
        shorter = [Rule(rule.literals[:k]) for k in range(len(rule.literals), 0, -1)]
        if not shorter:
            break
        rule = max(shorter, key=lambda r: _worth(r, x[left & third], bad[left & third], names))
        inside = rule.covers(x, names) & left
        if not (inside & bad).any() or (inside & bad).sum() < PRECISION * inside.sum():
            break
        rules.append(rule)
        left &= ~inside
    return rules


@dataclass(frozen=True)
class Model:
    """Stems of toxic words and the decision list."""

    markers: tuple[str, ...]
    hints: tuple[str, ...]
    rules: tuple[Rule, ...]

    def verdict(self, s: Column) -> Column:
        """Whether the list keeps a document with these statistics: its first fitting rule rejects."""
        values, out = ratios(s), None
        for rule in self.rules:
            out = F.when(rule.column(values), False) if out is None else out.when(rule.column(values), False)
        return out.otherwise(True) if out is not None else F.lit(True)


def _fold(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(key)), F.lit(FOLDS)).cast("int")


def _stem_sets(counts: list[dict], without: int | None = None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Markers and hints by the counts of all folds but one."""
    kinds: tuple[list, list] = [], []
    for r in counts:
        toxic, n = (r[c] - (r[f"{c}_{without}"] if without is not None else 0) for c in ("toxic", "n"))
        if toxic >= STEM_DOCS and toxic >= HINT_SHARE * n:
            kinds[toxic < MARKER_SHARE * n].append((-toxic, r["stem"]))
    return tuple(tuple(stem for _, stem in sorted(k)[:STEMS]) for k in kinds)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from documents labelled with quality (0: bad) and toxic (1: bad)."""
    known = labels.select(F.col(key), (F.col("toxic") == 1).alias("toxic"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where(F.col(key).isNotNull() & F.col("bad").isNotNull())
    known = known.groupBy(key).agg(F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"), F.max("bad").alias("bad"))
    sample = known.orderBy(F.xxhash64(key), key).limit(rows)  # the documented bound; so it can be broadcast
    labelled = docs.select(key, text).join(F.broadcast(sample), key)
    path = fresh_path(docs.sparkSession, "taught")
    taught = written(labelled.groupBy(key, "toxic", "bad").agg(F.min(text).alias(text)).withColumn("fold", _fold(key)), "taught", path)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != "")
    stems = taught.select("toxic", "fold", F.explode(_stems(words)).alias("stem")).groupBy("stem")
    each = [f.alias(f"{name}_{k}") for k in range(FOLDS) for name, f in (("toxic", F.count_if(F.col("toxic") & (F.col("fold") == k))), ("n", F.count_if(F.col("fold") == k)))]
    counts = stems.agg(F.count_if("toxic").alias("toxic"), F.count("*").alias("n"), *each)
    # a stem that no choice of folds can take stays behind; the others number STEM_DOCS-ths of a sample's stems at most
    counts = [r.asDict() for r in counts.where((F.col("toxic") >= STEM_DOCS) & (F.greatest(*(F.col("toxic") - F.col(f"toxic_{k}") - HINT_SHARE * (F.col("n") - F.col(f"n_{k}")) for k in range(FOLDS)), F.col("toxic") - HINT_SHARE * F.col("n")) >= 0)).collect()]
    values = ratios(F.struct(*COUNTS))
    x, bad, at, names = [], [], [], list(values)
    for k in range(FOLDS):
        s = taught.where(F.col("fold") == k).select("bad", F.xxhash64(key).alias("at"), statistics(F.col(text), *_stem_sets(counts, k)).alias("s")).select("bad", "at", *(F.col(f"s.{c}") for c in COUNTS))
        for r in s.select("at", "bad", *(v.alias(n) for n, v in values.items())).collect():
            x.append([r[n] for n in names])
            bad.append(r["bad"])
            at.append((r["at"], *x[-1]))
    remove(docs.sparkSession, path)
    order = sorted(range(len(at)), key=at.__getitem__)
    x = np.array([x[i] for i in order], float).reshape(len(order), len(names))
    return Model(*_stem_sets(counts), tuple(learned(x, np.array([bad[i] for i in order], bool), names)))


def judged(docs: DataFrame, model: Model, text: str = "text", into: str = "quality_judgement") -> DataFrame:
    """All rows with a struct column: the counts, base_failed, and kept."""

    def judgement(s: Column) -> Column:
        failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
        return F.struct(*(s[c].alias(c) for c in COUNTS), failed.alias("base_failed"), (~failed & model.verdict(s)).alias("kept"))

    return docs.withColumn(into, let(statistics(F.col(text), model.markers, model.hints), judgement))
