"""Quality rules as a learned decision list.

Sequential covering: on labelled statistics, a rule is a conjunction of thresholds that grows by the condition with
the best information gain and is pruned on held-out rows; the rows that it covers are put aside and the next rule is
learned. The list becomes one ordered Spark conditional expression: the first rule that fits decides, else the
document stays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, workers_find_us

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_marked", "n_distinct")
#: Statistics that rules may test: shares, so that a document's length alone never decides.
FEATURES = {
    "mean_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"), "digits_per_char": ("n_digits", "word_chars"), "marked_share": ("n_marked", "n_words"), "distinct_share": ("n_distinct", "n_words"),
}
#: At most so many labelled rows fit the list: the first by a hash of their ids.
SAMPLE = 20_000


def measure(text: str) -> tuple[int, ...]:
    """COUNTS and MORE of a text. Words are runs of anything but ASCII white space."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    plain = raw.translate(None, SYMBOLS)
    seen: set[str] = set()
    lines = [line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c")]
    dup = 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    threes = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(threes)) < len(threes):
        often = {t for t, c in Counter(threes).items() if c > 1}
        covered = bytearray(n)
        for i, t in enumerate(threes):
            if t in often:
                covered[i : i + 3] = b"\1\1\1"
        repeat = sum(covered)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    return n, word_chars, len(raw) - len(plain), dup, repeat, len(lines), upper, digits, sum(w[-1] in b"!?" for w in words), len(set(words))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, COUNTS, MORE) for every row; a null text has no words."""
    workers_find_us(docs.sparkSession)
    kept = ["doc_id", *keep]
    names = [*kept, *COUNTS, *MORE]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in (*COUNTS, *MORE))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            rows = [measure(t.as_py() or "") for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))] if rows else [*batch.columns[: len(kept)], *(pa.array([], pa.int64()) for _ in (*COUNTS, *MORE))], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v >= self.value if self.above else v < self.value

    def column(self) -> Column:
        top, bottom = FEATURES[self.feature]
        v = F.col(top) / F.greatest(F.col(bottom), F.lit(1))
        return v >= self.value if self.above else v < self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.value:g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, and how often it was right and wrong on the rows that no earlier rule covers."""

    conditions: tuple[Condition, ...]
    right: int
    wrong: int

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions])

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> list[Condition]:
    """Conditions added one by one, each with the largest gain in information about bad rows, until none is wrong."""
    conditions: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(conditions) < most and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain_best = None, 0.0
        for k, feature in enumerate(FEATURES):
            v, b = x[inside, k], bad[inside]
            for value in np.unique(np.quantile(v, np.linspace(0.01, 0.99, 99))):
                for above in (True, False):
                    m = v >= value if above else v < value
                    p, n = (b & m).sum(), (~b & m).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > gain_best + 1e-9:
                            best, gain_best = Condition(feature, above, float(f"{value:.6g}")), gain
        if best is None:
            break
        conditions.append(best)
        inside &= best.holds(x)
    return conditions


def _prune(conditions: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Final conditions go as long as (right - wrong) / (right + wrong) on held-out rows does not fall."""

    def worth(cs: list[Condition]) -> float:
        m = Rule(tuple(cs), 0, 0).holds(x)
        p, n = (bad & m).sum(), (~bad & m).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
        conditions = conditions[:-1]
    return conditions


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.98, max_rules: int = 12, max_conditions: int = 3, seed: int = 7, patience: int = 6) -> list[Rule]:
    """A decision list of rules that reject. A rule that is wrong too often on the rows left is not taken.

    Another is then grown from another split of these rows; learning stops when `patience` rules in a row were not taken.
    """
    rng = np.random.default_rng(seed)
    left, rules, failed = np.ones(len(x), bool), [], 0
    while len(rules) < max_rules and failed < patience and (bad & left).sum() >= 5:
        at = np.flatnonzero(left)
        rng.shuffle(at)
        grow, hold = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
        conditions = _grow(x[grow], bad[grow], max_conditions) if bad[grow].any() else []
        if not conditions:
            failed += 1
            continue
        conditions = _prune(conditions, x[hold], bad[hold])
        m = Rule(tuple(conditions), 0, 0).holds(x) & left
        right, wrong = int((bad & m).sum()), int((~bad & m).sum())
        if right < 5 or right < precision * (right + wrong):
            failed += 1
            continue
        failed = 0
        rules.append(Rule(tuple(conditions), right, wrong))
        left &= ~m
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, precision: float = 0.98) -> list[Rule]:
    """Rules from at most sample labelled documents (label column quality: 0 is bad), the first by a hash of doc_id.

    Labels without a document or a value count for nothing; of a document's different labels the least holds, of its
    different texts the one with the least statistics. The order of the rows plays no part. With no bad or no good rows
    the list is empty.
    """
    marked = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most sample rows of two numbers
    known = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    measures = F.struct(*COUNTS, *MORE)
    one = statistics(known, keep=("quality",)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(measures).alias("m"))
    rows = one.select("quality", "m.*", F.xxhash64("doc_id").alias("__h"), F.col("doc_id").alias("__id")).toPandas().sort_values(["__h", "__id"])
    if not len(rows):
        return []
    x = np.column_stack([rows[a].to_numpy(float) / np.maximum(rows[b].to_numpy(float), 1) for a, b in FEATURES.values()])
    return learn(x, rows["quality"].to_numpy() == 0, precision)


def rejected_by(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that fits, else null: one ordered conditional expression."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), number).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row: doc_id, *keep, COUNTS, MORE, base_failed, rule (number of the rule that rejects, or null), kept."""
    return statistics(docs, keep=keep).withColumn("base_failed", base_failed()).withColumn("rule", rejected_by(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def measured(text: Column) -> Column:
    """struct of COUNTS and MORE: only the text goes to Python; a row's other columns stay in the JVM."""

    @F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in (*COUNTS, *MORE)]))
    def run(texts: pa.Array) -> pa.Array:
        rows = [measure(t.as_py() or "") for t in texts]
        columns = zip(*rows, strict=True) if rows else [[] for _ in (*COUNTS, *MORE)]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*COUNTS, *MORE])

    return run(text.cast("string"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that the base or a learned rule rejects; all columns stay, also odd names, nulls and repeated rows."""
    workers_find_us(docs.sparkSession)
    rules = fit(docs, labels, sample)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all"), measured(F.col("text")).alias("__m"))
    flat = whole.select("__all", "__m.*")
    return flat.filter(~base_failed() & rejected_by(rules).isNull()).select("__all.*")
