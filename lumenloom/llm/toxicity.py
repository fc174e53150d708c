"""Toxicity by weak supervision.

Voters: words of a fixed lexicon, patterns, and word beginnings found in labelled texts.
A generative label model sees nothing but the votes on a bounded sample of all texts,
labelled or not; it estimates each voter's accuracy and the correlations between voters,
and gives each text of the sample a posterior label. A linear classifier is trained on
those posterior labels and scores every text. Labels choose voters and say how frequent
toxic texts are; neither the label model nor the classifier sees one.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import base, worker
from lumenloom.llm.language_id import fold

# Common insults.
LEXICON = ("bastard", "clown", "disgusting", "dumb", "filth", "fool", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "ugly", "vermin", "worthless")
# Forms in which abuse comes, whatever its words, and what a text holds where the form can stand.
PATTERNS = (
    (r"\byou(?:'re| are)? (?:a |an |such |so )", "you"), (r"\bshut up\b", "shut up"), (r"\bgo to hell\b", "go to hell"),
    (r"\bi hate\b", "i hate"), (r"\bkill (?:you|your)", "kill you"), (r"!{3,}", "!!!"), (r"[@#$%*]{3,}", ""),
)

_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = [(re.compile(p), held) for p, held in PATTERNS]
BEGINNINGS = (4, 5, 6)
#: A word beginning votes if its share among toxic texts is at least this many times that among clean ones.
VOTER_RATIO = 40


def beginnings(word: str) -> list[str]:
    """The word itself, marked as whole, and its beginnings."""
    return [word + "$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


@dataclass
class ToxicityModel:
    voters: dict[str, int]  # word feature -> voter; the patterns follow
    keep: np.ndarray  # the sum of voters that vote toxic, as a mask
    weights: np.ndarray
    bias: float

    @property
    def size(self) -> int:
        return len(self.voters) + len(PATTERNS)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([features(*c, self.keep) for c in voter_counts(self.voters, texts)]) if texts else np.zeros((0, self.size + 3))
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def _is_letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def _matcher(voters: dict[str, int]) -> ahocorasick.Automaton:
    """Finds all voters' strings in one pass over a text."""
    of_string: dict[str, list[tuple[int, bool]]] = {}
    for f, v in voters.items():
        of_string.setdefault(f.removesuffix("$"), []).append((v, f.endswith("$")))
    automaton = ahocorasick.Automaton()
    for x, own in of_string.items():
        automaton.add_word(x, (len(x), own))
    automaton.make_automaton()
    return automaton


def voter_counts(voters: dict[str, int], texts: list[str | None]) -> list[tuple[np.ndarray, int]]:
    """For each whole text, how often each voter fires, and the text's words (runs without white space)."""
    automaton, out = _matcher(voters), []
    for text in texts:
        low = (text or "").lower()
        count = np.zeros(len(voters) + len(PATTERNS))
        for end, (n, own) in automaton.iter(low):
            start = end - n + 1
            if start and _is_letter(low[start - 1]):
                continue
            ends_here = end + 1 == len(low) or not _is_letter(low[end + 1])
            for v, whole in own:
                count[v] += ends_here or not whole
        for k, (p, held) in enumerate(_PATTERNS):
            if held in low:
                count[len(voters) + k] = sum(1 for _ in p.finditer(low))
        out.append((count, len(low.split())))
    return out


def ratio_of(toxic: float, clean: float, n1: int, n0: int) -> float:
    """How many times more frequent something is among ``n1`` toxic than among ``n0`` clean texts."""
    return (toxic + 0.5) / (n1 + 1) / ((clean + 0.5) / (n0 + 1))


def specific(found: dict[str, tuple[int, int]], n1: int, n0: int) -> list[str]:
    """The beginnings of ``found`` (in how many toxic and clean texts each is) that tell something by themselves: also where the most frequent longer one that begins with it is not."""
    longer: dict[str, tuple[int, int]] = {}
    for f, n in found.items():
        word = f.removesuffix("$")
        for k in range(1, len(word) + (f != word)):
            longer[word[:k]] = max(longer.get(word[:k], (0, 0)), n)
    return [f for f, (toxic, clean) in found.items() if ratio_of(toxic - longer.get(f, (0, 0))[0], max(0, clean - longer.get(f, (0, 0))[1]), n1, n0) >= VOTER_RATIO]


def features(count: np.ndarray, words: int, keep: np.ndarray) -> np.ndarray:
    """Saturated counts, and over all voters kept: the log count, the rate, and how many differ."""
    hits = (count * keep).sum()
    return np.concatenate([np.minimum(count, 3.0) / 3.0, [np.log1p(hits), min(1.0, 20.0 * hits / max(1, words)), np.log1p((count * keep > 0).sum())]])


def label_model(votes: np.ndarray, doubtful: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 per row, accuracy per voter, correlations between voters, from the votes alone.

    ``votes`` (rows, voters; booleans) says who fired; who does not abstains. EM over a two-class
    model in which each voter fires with its own probability in each class, and silence of
    all has one. Voters that are correlated given the label share their evidence:
    each one's log ratio is divided by one plus its correlations with those who fire, too. ``doubtful``
    voters are estimated by the posteriors of a model of the others, and have a part in
    the model themselves only where that says that they are right more often than not.
    """
    n, k = votes.shape
    if doubtful is not None and doubtful.any():
        posterior, accuracy, correlation = label_model(votes & ~doubtful, rounds=rounds)
        accuracy = (posterior @ votes + 0.5) / (votes.sum(axis=0) + 1.0)
        joins = doubtful & (accuracy > 0.5)
        if joins.any():
            posterior, again, correlation = label_model(votes & (joins | ~doubtful), rounds=rounds)
            accuracy = np.where(doubtful & ~joins, accuracy, again)
        return posterior, accuracy, correlation
    # Rows with the same votes, such as all silent ones, are one row with a weight.
    _, first, back, weight = np.unique(np.packbits(votes, axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    votes = votes[first].astype(np.float64)
    some = votes.any(axis=1)
    posterior = np.where(some, 0.9, 0.01)
    correlation = np.eye(k)
    for _ in range(rounds):
        toxic, clean = posterior * weight, (1 - posterior) * weight
        one, zero = toxic.sum(), clean.sum()
        any1, any0 = (toxic[some].sum() + 0.5) / (one + 1.0), (clean[some].sum() + 0.5) / (zero + 1.0)
        fire1 = (toxic @ votes + 0.05) / (one + 1.0)
        fire0 = (clean @ votes + 0.05) / (zero + 1.0)
        rest = votes - (posterior[:, None] * fire1 + (1 - posterior)[:, None] * fire0)
        sd = np.sqrt(np.maximum(weight @ rest**2 / n - (weight @ rest / n) ** 2, 0.0)) + 1e-6
        correlation = ((rest * weight[:, None]).T @ rest) / n / np.outer(sd, sd)
        np.fill_diagonal(correlation, 1.0)
        share = votes / (1.0 + votes @ np.maximum(correlation - np.eye(k), 0.0))
        prior = np.clip(one / n, 1e-4, 0.9999)
        log_odds = np.log(prior / (1 - prior)) + np.where(some, 0.0, np.log((1 - any1) / (1 - any0))) + share @ np.log(fire1 / fire0)
        after = 1.0 / (1.0 + np.exp(-np.clip(log_odds, -40, 40)))
        done = np.abs(after - posterior).max() < 1e-4
        posterior = after
        if done:
            break
    accuracy = ((posterior * weight) @ votes + 0.5) / (weight @ votes + 1.0)
    return posterior[back.ravel()], accuracy, correlation


def train_linear(x: np.ndarray, soft: np.ndarray, share: np.ndarray, steps: int = 30, penalty: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method; ``share`` are row weights that sum to one."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, hold = np.zeros(x1.shape[1]), np.full(x1.shape[1], penalty)
    hold[-1] = 1e-9
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x1 @ w, -40, 40)))
        gradient = x1.T @ ((p - soft) * share) + hold * w
        curve = (x1 * (np.maximum(p * (1 - p), 1e-6) * share)[:, None]).T @ x1 + np.diag(hold)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample_per_label: int = 3000, voters_from: int = 20_000, sample_rows: int = 6000, found: int = 300, seed: int = 3) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    At most about ``voters_from`` labelled rows of each label are used to choose voters,
    taken by a hash of doc_id; labels other than 0 and 1, and labels of a doc_id that
    disagree, are left out. Voters are the fixed lexicon and at most ``found`` word
    beginnings whose share among toxic texts is at least VOTER_RATIO times that among
    clean ones, also where a longer one does not vote already. The label model sees the votes on about ``sample_per_label`` of these
    texts of each label, without their labels, and on about ``sample_rows`` of all texts.
    The share of toxic labels sets how much either class weighs in the classifier. Without
    usable labels the fixed lexicon and patterns vote alone. Rows that repeat count as
    often as they stand; null texts are empty.
    """
    spark = docs.sparkSession
    base.ship(spark)
    agreed = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_hi")).where("toxic = _hi").drop("_hi")
    counts = {int(r["toxic"]): r["count"] for r in agreed.groupBy("toxic").count().collect()}
    keep = few = F.lit(False)
    turn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    for label, n in counts.items():
        keep = keep | ((F.col("toxic") == label) & (turn < int(1_000_000 * min(1.0, voters_from / n))))
        few = few | ((F.col("toxic") == label) & (turn < int(1_000_000 * min(1.0, sample_per_label / n))))
    # Bounded by the parameter: some thousand identifiers, whatever the corpus holds.
    chosen = agreed.where(keep).withColumn("_few", few)
    some = 1_000_000 * min(1.0, sample_rows / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1_000_000)) < some
    sample = base.materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").where(F.col("toxic").isNotNull() | drawn).withColumn("_few", drawn | F.coalesce("_few", F.lit(False))), "toxic-sample")

    def tally(batches):
        worker.enter("toxicity")
        seen = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                seen.update({f for w in set(_WORD.findall((text or "").lower())) for f in beginnings(w)})
                if len(seen) > 100_000:  # bounded memory; the counts are summed up later
                    yield counted(seen)
                    seen = Counter()
        yield counted(seen)

    def counted(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["f", "n"])

    toxic_rows, clean_rows = sample.where("toxic = 1"), sample.where("toxic = 0")
    n1, n0 = toxic_rows.count(), clean_rows.count()
    voters = {w + "$": i for i, w in enumerate(LEXICON)}
    if n1 and n0:
        least = max(3, n1 // 200)
        in_toxic = toxic_rows.mapInArrow(tally, "f string, n long").groupBy("f").agg(F.sum("n").alias("toxic")).where(F.col("toxic") >= least)
        in_clean = clean_rows.mapInArrow(tally, "f string, n long").groupBy("f").agg(F.sum("n").alias("clean"))
        ratio = (F.col("toxic") + 0.5) / (n1 + 1) / ((F.coalesce("clean", F.lit(0)) + 0.5) / (n0 + 1))
        best = in_toxic.join(in_clean, "f", "left").withColumn("ratio", ratio).where(F.col("ratio") >= VOTER_RATIO).orderBy(F.desc(F.log("ratio") * F.sqrt("toxic")), "f").limit(4 * found).collect()
        for f in specific({r["f"]: (r["toxic"], r["clean"] or 0) for r in best}, n1, n0)[:found]:
            voters.setdefault(f, len(voters))

    def fire(batches):
        worker.enter("toxicity")
        for batch in batches:
            rows = voter_counts(voters, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([c.astype(np.float32).tobytes() for c, _ in rows], pa.binary()), pa.array([w for _, w in rows], pa.int64())], names=["x", "words"])

    got = sorted((r["x"], r["words"]) for r in sample.where("_few").select("doc_id", "text").mapInArrow(fire, "x binary, words long").collect())
    size = len(voters) + len(PATTERNS)
    if not got or not n1 or not n0:
        trusted = np.array([1.0] * len(LEXICON) + [0.0] * (size - len(LEXICON)))
        return ToxicityModel(voters, trusted, np.concatenate([np.zeros(size), [2.0, 2.0, 2.0]]), -3.5)
    count = np.stack([np.frombuffer(x, dtype=np.float32) for x, _ in got])
    return learned(voters, count, np.array([w for _, w in got]), counts[1] / (counts[0] + counts[1]))


def learned(voters: dict[str, int], count: np.ndarray, words: np.ndarray, prior: float) -> ToxicityModel:
    """The classifier trained on the label model's posteriors of the rows of ``count`` (rows, voters); ``prior`` is the share of toxic texts."""
    # Words were chosen for this task; forms stand in many texts.
    posterior, accuracy, _ = label_model(count > 0, np.arange(count.shape[1]) >= len(voters))
    trusted = (accuracy >= 0.7).astype(np.float64)
    # The sample holds toxic texts more often than the corpus does; the weights undo that.
    inside = min(max(float(posterior.mean()), 1e-6), 1 - 1e-6)
    share = posterior * prior / inside + (1 - posterior) * (1 - prior) / (1 - inside)
    # Silent texts have the same features and posterior: they are one row.
    loud = np.flatnonzero((count > 0).any(axis=1))
    silent = np.setdiff1d(np.arange(len(count)), loud)
    rows = np.concatenate([loud, silent[:1]])
    share = np.concatenate([share[loud], [share[silent].sum()] * len(silent[:1])])
    posterior = posterior[rows]
    x = np.stack([features(count[k].astype(np.float64), int(words[k]), trusted) for k in rows.tolist()])
    weights, bias = train_linear(x, posterior, share / share.sum())
    return ToxicityModel(voters, trusted, weights, bias)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text of ``docs``; no shuffle.

    Null counts as empty; equal texts, and so repeated rows, get equal scores; an empty
    table gives no rows; other columns are ignored.
    """
    base.ship(docs.sparkSession)

    def run(batches):
        worker.enter("toxicity")
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 512):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array(model.scores(texts.slice(at, 512).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; texts do not move.

    A score equal to the threshold is rejected. Null texts count as empty and stay as null;
    repeated rows stay or go together; an empty table gives no rows.
    """
    base.ship(docs.sparkSession)
    where = docs.columns.index("text")

    def run(batches):
        worker.enter("toxicity")
        for batch in batches:
            texts, keep = batch.column(where), []
            for at in range(0, batch.num_rows, 512):
                keep += (model.scores(texts.slice(at, 512).to_pylist()) < threshold).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text of ``documents``; labels are learned from two of three folds."""
    docs, labels = base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    held_out = fold(F.col("doc_id"), 3) == 1
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
