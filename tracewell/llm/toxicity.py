"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words fall into classes: insult, threat, target, negation, reported speech.  Five small transducers read a
clause's classes; each turns a word into a factor of its weight and remembers what the next words need.  Their
composition is one automaton that adds up the weights of a clause.  An insult counts more with a target in its
clause, less under a negation or in reported speech.  A document is scored by its matched clauses, never by
words outside of them; the clause weights are turned into a probability by the labelled rows.

Insults are learned: words, and stems of `STEM` letters that start words, which mark labelled rows.  The other classes
are the fixed lists below.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import stage

SEED_INSULTS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
THREATS = ("kill", "hurt", "beat", "destroy", "punish", "shoot", "stab", "strangle", "burn")
TARGETS = ("you", "your", "yours", "yourself", "he", "him", "she", "her", "they", "them", "u", "ur")
NEGATIONS = ("not", "no", "never", "nobody", "isn't", "aren't", "wasn't", "don't", "without")
REPORTS = ("said", "says", "called", "calls", "wrote", "quoted", "quote", "reportedly", "allegedly")
#: A learned insult stands in at least this number of labelled toxic texts.
MIN_TEXTS = 8
#: Lower bound of its log-odds, at 1.96 standard errors.
MIN_ODDS = 2.0
#: Letters of a learned stem; of stems that start each other, the surest one stays.
STEM = range(4, 9)
#: A negation reaches this many words on.
SCOPE = 3
THREAT_WEIGHT = 2.0
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_CLAUSE = re.compile(r"[.!?;:\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Upper edges of the clause-weight bins that are calibrated.
EDGES = np.array([0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0, 20.0])

# Each transducer: states, and step(state, class) -> (state, factor on the weight of the word read).
TRANSDUCERS = {
    "insult": (1, lambda s, c: (0, 1.0)),
    "threat": (1, lambda s, c: (0, THREAT_WEIGHT if c == THREAT else 1.0)),
    "target": (2, lambda s, c: (1 if c == TARGET else s, 1.5 if s else 1.0)),
    "negation": (SCOPE + 1, lambda s, c: (SCOPE if c == NEGATION else max(s - 1, 0), 0.3 if s else 1.0)),
    "report": (2, lambda s, c: (1 if c == REPORT else s, 0.4 if s else 1.0)),
}


def compose() -> tuple[np.ndarray, np.ndarray]:
    """Product of the transducers: tables next state and factor by (state, class); state 0 starts a clause."""
    sizes = [n for n, _ in TRANSDUCERS.values()]
    states = list(product(*map(range, sizes)))
    number = {s: i for i, s in enumerate(states)}
    nxt, factor = np.zeros((len(states), 6), int), np.ones((len(states), 6))
    for s, c in product(states, range(6)):
        steps = [f(x, c) for x, (_, f) in zip(s, TRANSDUCERS.values(), strict=True)]
        nxt[number[s], c] = number[tuple(x for x, _ in steps)]
        factor[number[s], c] = np.prod([w for _, w in steps])
    return nxt, factor


class Grammar:
    def __init__(self, insults: dict[str, float]):
        self.stems = {w[:-1]: x for w, x in insults.items() if w.endswith("*")}
        insults = {w: x for w, x in insults.items() if not w.endswith("*")}
        self.weight = {w: 1.0 for w in THREATS} | insults
        self.kind = {w: k for k, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, insults)) for w in words}
        self.next, self.factor = (x.tolist() for x in compose())
        whole = "|".join(map(re.escape, sorted(self.weight, key=len, reverse=True)))
        begun = "".join(f"|{re.escape(x)}" for x in sorted(self.stems))
        self.hit = re.compile(rf"(?<![^\W\d_])(?:(?:{whole})(?![^\W\d_]){begun})")

    def read(self, word: str) -> tuple[int, float]:
        """Class and weight of a word: by itself, else by its shortest stem."""
        if word in self.kind:
            return self.kind[word], self.weight.get(word, 0.0)
        stem = next((word[:k] for k in STEM if word[:k] in self.stems), None)
        return (INSULT, self.stems[stem]) if stem else (OTHER, 0.0)

    def clause(self, text: str) -> float:
        """Weight of one clause in lower case: an insult counts by itself, a threat only with a target before or behind it."""
        read = [self.read(w) for w in _TOKEN.findall(text)]
        aimed, state, total = any(k == TARGET for k, _ in read), 0, 0.0
        for k, weight in read:
            if k == INSULT or k == THREAT and aimed:
                total += weight * self.factor[state][k]
            state = self.next[state][k]
        return total

    def score(self, text: str | None) -> tuple[float, int]:
        """Weight of the matched clauses and their number."""
        low = (text or "").lower()
        total, n, at = 0.0, 0, 0
        while m := self.hit.search(low, at):
            begin = max((e.end() for e in _CLAUSE.finditer(low, at, m.start())), default=at)
            end = _CLAUSE.search(low, m.end())
            stop = end.start() if end else len(low)
            w = self.clause(low[begin:stop])
            total, n, at = total + w, n + (w > 0), end.end() if end else len(low)
        return total, n


def learn_insults(labelled: DataFrame) -> dict[str, float]:
    """Words and stems (`stem*`) that mark toxic texts and their weights (log-odds), from rows (text, toxic).

    Equal texts count once.  The counts cover all labelled rows; all words and stems that are sure enough come back.
    """
    rows = labelled.where("text is not null and toxic is not null").groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}']+"))).alias("w")).where("w <> ''")
    c = stage(words.groupBy("w").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")), "toxic-words")

    def marked(counts: DataFrame) -> list:
        x = counts.withColumn("b", F.col("n") - F.col("a"))
        a, b = F.col("a") + 0.5, F.col("b") + 0.5
        x = x.withColumn("odds", F.log(a / (bad + 1)) - F.log(b / (good + 1))).withColumn("low", F.col("odds") - 1.96 * F.sqrt(1 / a + 1 / b))
        x = x.where((F.col("a") >= MIN_TEXTS) & (F.col("low") > MIN_ODDS))
        return x.orderBy(F.desc("low"), "w").select("w", "odds").collect()

    whole = marked(c)
    rest = c.where(~F.col("w").isin([*SEED_INSULTS, *(r["w"] for r in whole)]))
    stems = rest.select(F.explode(F.transform(F.sequence(F.lit(STEM.start), F.lit(STEM.stop - 1)), lambda k: F.when(F.length("w") > k, F.substring("w", 1, k)))).alias("w"), "a", "n")
    got = list(whole)
    kept: list[str] = []
    for r in marked(stems.where("w is not null").groupBy("w").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))):
        if not any(r["w"].startswith(x) or x.startswith(r["w"]) for x in kept):
            kept.append(r["w"])
            got.append({"w": r["w"] + "*", "odds": r["odds"]})
    known = set(TARGETS) | set(NEGATIONS) | set(REPORTS)
    return {w: 6.0 for w in SEED_INSULTS} | {r["w"]: min(6.0, float(r["odds"])) for r in got if r["w"] not in known and _TOKEN.fullmatch(r["w"].rstrip("*"))}


def _weigh(batches: Iterator[pa.RecordBatch], grammar) -> Iterator[pa.RecordBatch]:
    g = grammar.value
    for batch in batches:
        got = [g.score(t) for t in batch.column("text").to_pylist()]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([w for w, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())], names=[*keep, "clause_weight", "n_clauses"])


def clause_weights(docs: DataFrame, insults: dict[str, float]) -> DataFrame:
    """All columns of `docs` but text, with clause_weight and n_clauses; a null or empty text has 0 of both.

    Columns of these names are replaced.  Rows are scored one by one, so repeated rows get equal scores.
    """
    from pyspark.sql.types import DoubleType, LongType, StructType

    docs = docs.drop("clause_weight", "n_clauses")
    schema = StructType([f for f in docs.schema if f.name != "text"]).add("clause_weight", DoubleType()).add("n_clauses", LongType())
    sent = docs.sparkSession.sparkContext.broadcast(Grammar(insults))
    return docs.mapInArrow(lambda it: _weigh(it, sent), schema)


def bin_of(weight):
    """Number of the clause-weight bin: 0 for no matched clause."""
    return sum((F.when(weight > float(e), 1).otherwise(0) for e in EDGES), F.lit(0))


def calibrate(weighed: DataFrame) -> list[float]:
    """Share of toxic rows by bin over all rows (clause_weight, toxic), smoothed and made to rise with the weight."""
    n = {r["b"]: (r["bad"], r["n"]) for r in weighed.where("toxic is not null").groupBy(bin_of(F.col("clause_weight")).alias("b")).agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).collect()}
    prior = [0.02, *np.linspace(0.3, 0.98, len(EDGES))]
    blocks = []
    for b in range(len(EDGES) + 1):
        bad, m = n.get(b, (0, 0))
        blocks.append([bad + 2 * prior[b], m + 2.0, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            x = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], x, strict=True)]
    return [bad / m for bad, m, k in blocks for _ in range(k)]


def probability(weight, rates: list[float]):
    """Rate of the row's bin, rising a little inside of it with the weight so that ties are few."""
    base = F.get(F.array(*[F.lit(float(r)) for r in rates]), bin_of(weight))
    return base + (1 - base) * 0.05 * weight / (weight + 10)
