"""Toxicity by weak supervision.

Voters. Lexicon voters say "toxic" where a word of theirs occurs: fixed lists of insults by severity, and
words that the labelled sample associates with toxic texts. Pattern voters look at address and insult side by
side, at shouting, at insult density, and say "clean" where none of this is found. All abstain elsewhere.

Label model. A generative model of hidden label and votes: each voter casts a vote of either kind with probabilities
that depend on the label, which give its accuracy; an abstention says nothing. The model is fitted by expectation
maximisation on the votes alone, from the start that any "toxic" vote is right; voters count as better than chance. The correlation of each pair of voters
within the labels is estimated with it; voters that repeat each other share their weight. Human labels give the share of
toxic texts, and at the end two numbers that calibrate the posterior; no text's posterior sees its own label otherwise.

Classifier. An L1-penalised logistic regression over words is trained on the posterior labels; the score of a
text is its probability. Scoring reads whole texts.

The sample: the ``SAMPLE`` labelled rows of least hash among those whose texts have ``SAMPLE_CHARS`` characters at
most; it bounds what reaches the driver, and only its rows' labels are used. Rows are chosen by hashes of id and text
before texts move, and rows that repeat id, text and label count once.

Defined results: null texts are empty; empty texts score as a text without words; no labels, or labels of one
class, leave the fixed voters alone; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import block_of, bound_batches, local_rows

SAMPLE = 4_000
SAMPLE_CHARS = 12_000
LEARNED = 40  # words and stems learned as voters
STEMS = (4, 5, 6)  # bytes of the beginnings of words that count as features
ALIKE = 0.6  # correlation within the labels from which voters share their weight
ODDS = 1.4  # least lower bound of the log odds of a learned word
RIGHT = 0.7  # least accuracy of a voter
PRIOR = 0.1  # share of toxic texts assumed where labels tell nothing

# Insults in common use, mild and strong.
MILD = "clown fool loser lame trash garbage dumb silly stupid jerk liar coward joke ugly lazy useless".split()
STRONG = "idiot moron scum pathetic worthless disgusting vermin imbecile retard bastard pig filth degenerate hateful".split()
ADDRESS = "you your youre ur u".split()

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased runs of letters (and of bytes beyond ASCII)."""
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split()


def features(text: str) -> set[bytes]:
    """The words of a text and the beginnings of its longer words (after ``^``), so that inflected forms meet."""
    out = set(words(text))
    for w in list(out):
        out.update(b"^" + w[:n] for n in STEMS if len(w) > n)
    return out


def weight_of(text: str, weights: dict[bytes, float], stems: set[bytes]) -> float:
    """Sum of the weights of a text's features; stems: the first ``STEMS[0]`` bytes of what can weigh."""
    n, found = STEMS[0], set()
    for w in set(words(text)):
        if w[:n] in stems:
            found.add(w)
            found.update(b"^" + w[:k] for k in STEMS if len(w) > k)
    return sum(sorted(weights[f] for f in weights.keys() & found))


def stems_of(weights: dict[bytes, float]) -> set[bytes]:
    return {f.lstrip(b"^")[: STEMS[0]] for f in weights}


class Bags:
    """The features of texts as arrays of numbers: those that ``least`` texts or more hold.

    A first pass counts texts by feature hash in an array of fixed size, so that the many features of one or two
    texts never become entries of a dictionary; the second numbers the rest.
    """

    SLOTS = 1 << 22

    def __init__(self, texts: list[str], least: int = 4):
        seen = np.zeros(self.SLOTS, dtype=np.int32)
        for t in texts:
            seen[list({crc32(f) % self.SLOTS for f in features(t)})] += 1
        may = seen >= least
        number: dict[bytes, int] = {}
        rows = [np.array([number.setdefault(f, len(number)) for f in sorted(features(t)) if may[crc32(f) % self.SLOTS]], dtype=np.int32) for t in texts]
        df = np.bincount(np.concatenate([*rows, np.zeros(0, dtype=np.int32)]), minlength=len(number))
        keep = np.full(len(number), -1, dtype=np.int32)
        names = sorted(f for f, k in number.items() if df[k] >= least)
        for k, f in enumerate(names):
            keep[number[f]] = k
        self.names = names
        self.rows = [r[r >= 0] for r in (keep[r] for r in rows)]

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """Texts per feature among the chosen ones."""
        return np.bincount(np.concatenate([*(r for r, c in zip(self.rows, chosen, strict=True) if c), np.zeros(0, dtype=np.int32)]), minlength=len(self.names))


def learned_lexicon(bags: Bags, labels: np.ndarray, top: int = LEARNED) -> list[bytes]:
    """Words and stems of which a labelled text is toxic rather than clean: by the lower bound of the log odds, best first."""
    a, b = bags.counts(labels > 0), bags.counts(labels <= 0)
    n1, n0 = max(int(labels.sum()), 1), max(int((1 - labels).sum()), 1)
    bound = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)) - 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    # Toxic words spread over toxic texts; words of one copied text don't.
    found = [(-a[k] * bound[k], w) for k, w in enumerate(bags.names) if a[k] >= max(5, 0.01 * n1) and len(w) >= 4 and bound[k] > ODDS]
    return [w for _, w in sorted(found)[:top]]


def votes(texts: list[str], learned: list[bytes]) -> np.ndarray:
    """Rows by voters: 1 toxic, -1 clean, 0 no vote."""
    mild, strong, address = ({w.encode() for w in x} for x in (MILD, STRONG, ADDRESS))
    lexicon = mild | strong | set(learned)
    singles = sorted(mild | strong | set(learned))
    at = {w: k for k, w in enumerate(singles)}
    shout = re.compile(r"\b[A-Z]{4,}\b")
    out = np.zeros((len(texts), len(singles) + 6), dtype=np.int8)
    for i, t in enumerate(texts):
        ws = words(t)
        insults = {w for w in set(ws) if w in lexicon or any(b"^" + w[:k] in lexicon for k in STEMS if len(w) > k)}
        hits = [w for w in ws if w in insults]
        for w in insults:
            for f in (w, *(b"^" + w[:k] for k in STEMS if len(w) > k)):
                if f in at:
                    out[i, at[f]] = 1
        near = any(ws[k] in insults and address & set(ws[max(0, k - 3) : k]) for k in range(len(ws))) if hits else False
        n = len(singles)
        out[i, n] = 1 if near else 0
        out[i, n + 1] = 1 if len(hits) >= 2 else 0
        out[i, n + 2] = 1 if len(hits) > 0.005 * max(len(ws), 1) else -1 if not hits else 0
        out[i, n + 3] = 1 if any(w in strong for w in hits) else 0
        out[i, n + 4] = -1 if not hits and len(ws) >= 5 else 0
        out[i, n + 5] = 1 if hits and len(shout.findall(t)) > 0.2 * max(len(ws), 1) else 0
    return out


class LabelModel:
    """Per-voter vote probabilities by hidden label; ``weight`` shares what correlated voters repeat."""

    def __init__(self, prior: float = PRIOR, rounds: int = 200):
        self.prior, self.rounds = prior, rounds

    def fit(self, v: np.ndarray) -> LabelModel:
        """Fits votes (rows by voters: 1 toxic, -1 clean, 0 none)."""
        q = np.where((v > 0).any(1), 0.95, 0.01)
        # Before the fit can take what voters repeat for evidence.
        self.correlation = self._correlation(v, q)
        excess = np.where(np.abs(self.correlation) > ALIKE, np.abs(self.correlation), 0)
        np.fill_diagonal(excess, 0)
        self.weight = 1 / (1 + excess.sum(1))
        for _ in range(self.rounds):
            self._maximise(v, q)
            new = self.posterior(v)
            done = np.abs(new - q).max(initial=0) < 1e-5
            q = new
            if done:
                break
        return self

    def _maximise(self, v: np.ndarray, q: np.ndarray) -> None:
        """Probabilities of a vote of each kind (row 0 clean, row 1 toxic) by label."""
        self.p = np.empty((2, 2, v.shape[1]))  # label, vote, voter
        for y, w in ((0, 1 - q), (1, q)):
            for k, kind in enumerate((-1, 1)):
                self.p[y, k] = ((w[:, None] * (v == kind)).sum(0) + 0.02) / (w.sum() + 0.1)

    def log_odds(self, v: np.ndarray) -> np.ndarray:
        even = np.log(self.prior / (1 - self.prior))
        clean, toxic = np.log(self.p[1] / self.p[0])
        # A voter is better than chance: a vote that it casts is right with the probability RIGHT at least.
        toxic, clean = np.maximum(toxic, np.log(RIGHT / (1 - RIGHT)) - even), np.minimum(clean, -np.log(RIGHT / (1 - RIGHT)) - even)
        return even + (self.weight * np.where(v > 0, toxic, np.where(v < 0, clean, 0))).sum(1)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        return logistic(self.log_odds(v))

    def accuracy(self) -> np.ndarray:
        """Of each voter, the probability that a vote it casts is right."""
        right = self.prior * self.p[1, 1] + (1 - self.prior) * self.p[0, 0]
        wrong = self.prior * self.p[1, 0] + (1 - self.prior) * self.p[0, 1]
        return right / (right + wrong)

    @staticmethod
    def _correlation(v: np.ndarray, q: np.ndarray) -> np.ndarray:
        total = np.zeros((v.shape[1], v.shape[1]))
        for w in (1 - q, q):
            w = w / max(w.sum(), 1e-9)
            x = v - (w[:, None] * v).sum(0)
            cov = (x * w[:, None]).T @ x
            sd = np.sqrt(np.clip(np.diag(cov), 1e-6, None))
            total += cov / np.outer(sd, sd) / 2
        return total


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrated(z: np.ndarray, labels: np.ndarray, steps: int = 100) -> np.ndarray:
    """Probabilities from log odds by a line fitted to the labels (Platt's scaling, by bounded Newton steps)."""
    line, x = np.array([1.0, 0.0]), np.column_stack([z, np.ones(len(z))])
    for _ in range(steps):
        p = logistic(x @ line)
        slope = x.T @ (p - labels) + 1e-3 * (line - [1, 0])
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(bend, slope), -1, 1)
        line = line - step
        if np.abs(step).max() < 1e-6:
            break
    return logistic(x @ line)


def train(bags: Bags, target: np.ndarray, penalty: float = 0.002, steps: int = 250) -> tuple[dict[bytes, float], float]:
    """L1-penalised logistic regression on feature presence, by accelerated proximal gradient steps."""
    vocab = bags.names
    if not vocab or not len(target):
        return {}, float(np.log(PRIOR / (1 - PRIOR)))
    rows = np.repeat(np.arange(len(bags.rows)), [len(r) for r in bags.rows])
    cols = np.concatenate(bags.rows)
    n = len(bags.rows)
    share = float(np.clip(target.mean(), 0.01, 0.99))
    balance = np.where(target >= 0.5, 0.5 / share, 0.5 / (1 - share))
    balance /= balance.mean()
    # Columns are scaled by their deviation, so that one step length fits common and rare words.
    scale = 1 / np.sqrt(np.bincount(cols, minlength=len(vocab)) / n + 1e-3)
    w = z = np.zeros(len(vocab))
    bias = zb = 0.0
    step, t = 0.02, 1.0
    for _ in range(steps):
        margin = np.bincount(rows, weights=(z * scale)[cols], minlength=n) + zb
        g = balance * (logistic(margin) - target) / n
        grad = np.bincount(cols, weights=g[rows], minlength=len(vocab)) * scale
        new = z - step * grad * 4
        new = np.sign(new) * np.clip(np.abs(new) - step * penalty * 4, 0, None)
        new_bias = zb - step * g.sum() * 4
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t1 * (new - w), new_bias + (t - 1) / t1 * (new_bias - bias)
        w, bias, t = new, new_bias, t1
    return {k: float(w[i] * scale[i]) for i, k in enumerate(vocab) if abs(w[i]) > 1e-9}, float(bias)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[bytes, float], float]:
    """Word weights and bias, from the bounded sample of labelled rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = labels.where(usable & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    all_ = docs.select(F.col(id_col).alias("i"), F.xxhash64(text).alias("h"))
    order = [F.xxhash64("i", "h"), "i", "h", "y"]
    chosen = local_rows(docs.sparkSession, all_.join(seen, "i").distinct().orderBy(*order).limit(SAMPLE).collect(), "i long, h long, y int")
    texts = docs.select(F.col(id_col).alias("d"), F.xxhash64(text).alias("t_h"), text.alias("t"))
    found = texts.join(F.broadcast(chosen), (F.col("d") == F.col("i")) & (F.col("t_h") == F.col("h")))
    # Texts are bounded once they are chosen.
    rows = sorted(found.select("d", "y", block_of(F.col("t"), SAMPLE_CHARS).alias("t")).dropDuplicates(["d", "y", "t"]).collect())
    y = np.array([r["y"] for r in rows], dtype=float)
    texts = [r["t"] for r in rows]
    bags = Bags(texts)
    lexicon = learned_lexicon(bags, y) if 0 < y.sum() < len(y) else []
    if not rows:
        z = {w.encode(): 4.0 for w in MILD + STRONG}
        return z, float(np.log(PRIOR / (1 - PRIOR)))
    ballots = votes(texts, lexicon)
    odds = LabelModel(float(np.clip(y.mean(), 0.02, 0.5))).fit(ballots).log_odds(ballots)
    return train(bags, calibrated(odds, y) if 0 < y.sum() < len(y) else logistic(odds))


def score(docs: DataFrame, weights: dict[bytes, float], bias: float, text_col: str = "text") -> Column:
    bound_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        stems = stems_of(weights)
        for texts in batches:
            z = np.array([bias + weight_of(t, weights, stems) for t in texts], dtype=float)
            yield pd.Series(logistic(z))

    return probability(F.coalesce(F.col(text_col), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``score`` and ``predicted``; ``held_out`` is an expression over the id."""
    weights, bias = learn(docs, labels, ~held_out, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), score(docs, weights, bias, text_col).alias("score"))
    return rows.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; all columns as they came."""
    weights, bias = learn(docs, labels, ~held_out, id_col, text_col)
    return docs.where(score(docs, weights, bias, text_col) < 0.5)
