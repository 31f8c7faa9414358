"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose statistic exceeds a cutoff. In every stratum labelled documents are split by a hash of
their id. One part proposes: starting with all rules off, the step that tightens one rule to one of its cutoffs and catches
most bad documents for the good ones it loses is taken, again and again, which gives a sequence of rule sets, each
rejecting more than the one before. The other part, the holdout, decides: in that order, a rule set is certified while the
exact binomial (Clopper-Pearson) upper bound of the share of good documents that it rejects as a whole stays within the
risk. Testing in a fixed order up to the first failure needs no correction for the number of sets; the error level is
divided by the number of strata (Bonferroni), so that with probability ``1 - level`` no stratum loses more than ``risk`` of
its good documents to all rules together. Among certified sets the one that parts the proposing part best is taken, the
earliest on ties; a stratum with too few labels certifies none, and its rules stay off.

A document with fewer than 50 words, or with more than half of its words in repeated three-word windows, fails the base.

Null texts count as empty (they fail the base); texts of any length are measured as a whole; null strata are a stratum of
their own; labels of unknown documents and null labels are ignored; a document labelled twice counts twice; repeated rows
are judged each by itself; an empty table gives an empty result; other columns, whatever their names, are ignored by
:func:`judge` and kept by :func:`keep`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, require, text_hash, trimmed
from .statistics import Surface, surfaces

#: Rules: statistic, and its cutoffs from loosest to tightest.
RULES = {
    "symbols_per_word": (lambda s: s.per_word(s.n_symbols), (4.0, 2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03)),
    "marks_per_word": (lambda s: s.per_word(s.n_marks), (4.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05)),
    "upper_share": (lambda s: s.n_upper / max(1, s.n_upper + s.n_lower), (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12)),
    "repeat_share": (lambda s: s.per_word(s.n_repeat_words), (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.07, 0.05)),
    "same_next_share": (lambda s: s.per_word(s.n_same_next), (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.07, 0.05, 0.03)),
    "dup_line_share": (lambda s: s.n_dup_lines / max(1, s.n_lines), (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Thresholds are broadcast up to so many strata; beyond, they are joined by shuffle.
BROADCAST_STRATA = 10_000
#: A rejected good document weighs as so many rejected bad ones (in shares) when a certified rule set is chosen.
GOOD_WEIGHS = 50.0
#: One labelled document of so many proposes, the others certify.
PROPOSES = 3


def base_failed(s: Surface) -> bool:
    return s.n_words < 50 or 100 * s.n_repeat_words > 50 * s.n_words


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials with chance p, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return math.exp(top) * sum(math.exp(x - top) for x in logs)


def certified(rejected_good: int, good: int, risk: float, level: float) -> bool:
    """The Clopper-Pearson upper bound, at ``level``, of the share of good documents rejected is at most ``risk``."""
    return good > 0 and rejected_good < risk * good and binomial_cdf(rejected_good, good, risk) <= level


def rejected(passed: np.ndarray, depths: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which rows a rule set rejects. ``passed``: by rule, how many of its cutoffs a row exceeds; ``depths``: by rule, the
    number of the cutoff in force, counted from the loosest, 0 where the rule is off."""
    return (passed + depths > lengths).any(axis=1)


def proposed(passed: np.ndarray, good: np.ndarray, bad: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The sequence of rule sets (depths) on rows with so many good and bad documents: each time the step with the most bad
    documents caught for good ones lost (one more than are lost, so that losing none isn't worth everything), the more
    bad ones on ties, then the first rule, then the loosest cutoff, until nothing more is caught."""
    depths, left, sequence = np.zeros(len(lengths), dtype=np.int64), np.ones(len(passed), dtype=bool), []
    while True:
        best: tuple = (0.0, 0)
        step = None
        for r, n in enumerate(lengths):
            # from the tightest cutoff on: what exceeds all, all but one, ... of the rule's cutoffs
            b, g = (np.cumsum(np.bincount(passed[left, r], weights=w[left], minlength=n + 1)[:0:-1]) for w in (bad, good))
            for d in range(depths[r] + 1, n + 1):
                value = (b[d - 1] / (g[d - 1] + 1), b[d - 1])
                if value > best:
                    best, step = value, (r, d)
        if step is None:
            return sequence
        depths = depths.copy()
        depths[step[0]] = step[1]
        left &= ~rejected(passed, depths, lengths)
        sequence.append(depths)


def choose(passed: np.ndarray, good: np.ndarray, bad: np.ndarray, proposes: np.ndarray, lengths: np.ndarray, risk: float, level: float) -> np.ndarray | None:
    """The depths of the rule set in force in a stratum. Rows hold so many ``good`` and ``bad`` documents each; those that
    ``proposes`` marks propose, the others certify."""
    best, chosen = 0.0, None
    held, tried = good * ~proposes, (good * proposes, bad * proposes)
    for depths in proposed(passed, *tried, lengths):
        out = rejected(passed, depths, lengths)
        if not certified(int(held[out].sum()), int(held.sum()), risk, level):
            break
        gain = tried[1][out].sum() / max(1, tried[1].sum()) - GOOD_WEIGHS * tried[0][out].sum() / max(1, tried[0].sum())
        if gain > best:
            best, chosen = gain, depths
    return chosen


def _exceeded(x, cuts: tuple[float, ...]):
    """How many of the cutoffs x exceeds."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: x > c))


def measure(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum, base statistics, base_failed and the rules' statistics, one row per document."""
    require(docs, "doc_id", "text", stratum)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("stratum", T.StringType()), *[T.StructField(n, T.LongType()) for n in BASE], T.StructField("base_failed", T.BooleanType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(surfaces(batch.column(2)))
            columns = [batch.column(0), batch.column(1), *[pa.array([getattr(s, n) for s in found], pa.int64()) for n in BASE], pa.array([base_failed(s) for s in found], pa.bool_()), pa.array([[f(s) for f, _ in RULES.values()] for s in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), "text").mapInArrow(trimmed(run), schema)


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = 0.06, level: float = 0.05) -> DataFrame:
    """(stratum, cutoffs array<double>, null where the rule is off) from documents labelled 1 (good) or 0 (bad)."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = measured.where(~F.col("base_failed")).select("doc_id", "stratum", "x").join(known, "doc_id")
    passed = F.array(*[_exceeded(F.get("x", k), cuts) for k, (_, cuts) in enumerate(RULES.values())])
    # A histogram over the grid of cutoffs, whose size the grid bounds.
    counted = rows.groupBy("stratum", passed.alias("passed"), (text_hash("doc_id") % PROPOSES == 0).alias("proposes")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    counted = materialise(counted, "rule-counts")
    strata = max(1, counted.select("stratum").distinct().count())
    cuts = [c for _, c in RULES.values()]
    lengths = np.array(list(map(len, cuts)))

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        depths = choose(np.stack(pdf["passed"].to_list()), pdf["good"].to_numpy(), pdf["bad"].to_numpy(), pdf["proposes"].to_numpy(), lengths, risk, level / strata)
        chosen = [None] * len(cuts) if depths is None else [own[d - 1] if d else None for own, d in zip(cuts, depths, strict=True)]
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "cutoffs": [chosen]})

    return materialise(counted.groupBy("stratum").applyInPandas(select, "stratum string, cutoffs array<double>"), "thresholds")


def _with_cutoffs(df: DataFrame, limits: DataFrame, stratum: str, name: str = "__cutoffs") -> DataFrame:
    limits = limits.select(F.col("stratum").alias(f"{name}_of"), F.col("cutoffs").alias(name))
    if limits.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    return df.join(limits, F.col(stratum).cast("string").eqNullSafe(F.col(f"{name}_of")), "left").drop(f"{name}_of")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.06, level: float = 0.05) -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, kept."""
    measured = materialise(measure(docs, stratum), "measured")
    limits = thresholds(measured, labels, risk, level)
    broken = F.exists(F.arrays_zip(F.col("x"), F.col("__cutoffs")), lambda z: z["x"] > z["__cutoffs"])
    kept = ~F.col("base_failed") & ~F.coalesce(broken, F.lit(False))
    return _with_cutoffs(measured, limits, "stratum").select("doc_id", *BASE, "base_failed", kept.alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.06, level: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    limits = thresholds(materialise(measure(docs, stratum), "measured"), labels, risk, level)
    names = docs.columns
    own = next(n for n in (f"__cutoffs{i}" for i in range(len(names) + 1)) if not {n, f"{n}_of"} & set(names))
    with_limits = _with_cutoffs(docs, limits, stratum, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = surfaces(batch.column(batch.schema.get_field_index("text")))
            cutoffs = batch.column(batch.schema.get_field_index(own)).to_pylist()
            good = [not base_failed(s) and not any(c is not None and f(s) > c for (f, _), c in zip(RULES.values(), cuts or (), strict=False)) for s, cuts in zip(found, cutoffs, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select(names)

    return with_limits.mapInArrow(trimmed(run), docs.schema)
