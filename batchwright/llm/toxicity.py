"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes (insult, threat, target, intent, negation, report, other, each with or
without a quote mark). Three weighted transducers, each a table of states and arcs, are composed
into one: the first marks reported speech, the second what is negated, the third joins insults
and threats with their targets. Weights multiply along the composition, so each clause is read
once. A document is judged by its matched clauses, not by isolated words: a negated or reported
insult weighs little, an aimed one more than a bare one.

The insult lexicon is a short fixed list plus stems learned from labelled texts: words and
word beginnings that toxic texts have and clean ones lack. A logistic calibrator turns clause
weights into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.llm.calibration import Logistic, fold, labelled_sample
from batchwright.llm.common import ids_and_text, map_batches, received, send
from batchwright.llm.transducer import build, compose
from batchwright.storage import materialize

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE_PER_CLASS = 6000
#: Entries of the learned lexicon, at most: those that the most toxic texts have.
LEXICON_ENTRIES = 3000
#: Letters of a stem.
STEM_LETTERS = range(3, 8)
#: Toxic texts that must have an entry, and how much rarer it must be in clean texts.
MIN_SUPPORT, MAX_CLEAN_RATIO = 8, 0.02
#: Clean texts that are taken to have each entry besides those that do: rare entries weigh less.
SMOOTHING = 3.0
#: Log odds that an entry must have.
MIN_WEIGHT = 3.3
HELD_OUT_FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7

OTHER, INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT = range(7)

# Words of the grammar.
WORDS = {
    INSULT: "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool imbecile jerk filth vermin",
    THREAT: "kill hurt destroy burn beat shoot stab punish crush strangle",
    TARGET: "you your yours yourself u ur he she they them him her his their people everyone",
    INTENT: "will shall gonna going must should want ll i'll we'll",
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't ain't nobody neither without",
    REPORT: "said says say called calls wrote writes claimed quoted told heard mentioned reported word term",
}
#: Weight of a fixed insult; learned ones carry their log odds.
INSULT_WEIGHT = 5.0
_FIXED = {word: kind for kind, words in WORDS.items() for word in words.split()}

_ENDS = (".", "!", "?", ";", ":")
_QUOTES = "\"“”«»„"
_EDGE = "".join(chr(c) for c in range(33, 128) if not chr(c).isalpha()) + "“”«»„…¡¿–—"


def core(token: str) -> str:
    """A token without the punctuation and digits around it, in lower case."""
    return token.strip(_EDGE).lower()


# A negation word covers the next NEGATED_WORDS words.
NEGATED_WORDS = 3
NEGATED_FACTOR, REPORTED_FACTOR, AIMED_FACTOR = 0.25, 0.3, 1.5
# What came before in a clause, and a class, to what has come now; other classes change nothing.
JOINED = {
    ("start", TARGET): "target",
    ("start", INTENT): "intent",
    ("target", INTENT): "intent",
    ("target", TARGET): "target",
    ("intent", TARGET): "target",
    ("start", INSULT): "insult",
    ("insult", TARGET): "aimed",
    ("target", INSULT): "aimed",
    ("intent", THREAT): "threat",
    ("threat", TARGET): "aimed",
}
CLASSES = (OTHER, INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT)
NOTHING, BARE, AIMED_BEFORE, AIMED_AFTER = range(4)


def _reported(state, symbol):
    """(report verb read, inside quotes): a verb covers the rest of its clause, quotes what they hold."""
    (verb, inside), (kind, quote) = state, symbol
    covered = verb or kind == REPORT or inside or quote
    hit = kind in (INSULT, THREAT)
    return (verb or kind == REPORT, inside != quote), (kind, covered and hit), REPORTED_FACTOR if covered and hit else 1.0


def _negated(left, symbol):
    """Words that the last negation still covers."""
    kind, reported = symbol
    hit = kind in (INSULT, THREAT) and left > 0
    after = NEGATED_WORDS if kind == NEGATION else max(left - 1, 0)
    return after, (kind, reported, hit), NEGATED_FACTOR if hit else 1.0


def _joined(before, symbol):
    """Insults count, threats where an intent stands before them; a target before an insult makes it aimed."""
    kind, reported, negated = symbol
    after = JOINED.get((before, kind), before)
    if kind == INSULT or kind == THREAT and before == "intent":
        aimed = before in ("target", "aimed")
        return after, (AIMED_BEFORE if aimed else BARE, reported, negated), AIMED_FACTOR if aimed else 1.0
    role = AIMED_AFTER if kind == TARGET and before in ("insult", "threat") else NOTHING
    return after, (role, False, False), 0.0


REPORTS = build((False, False), [(kind, quote) for kind in CLASSES for quote in (False, True)], _reported)
NEGATIONS = build(0, [(kind, reported) for kind in CLASSES for reported in (False, True)], _negated)
CLAUSES = build("start", [(kind, r, n) for kind in CLASSES for r in (False, True) for n in (False, True)], _joined)
GRAMMAR = compose(compose(REPORTS, NEGATIONS), CLAUSES)


@dataclass
class Match:
    """One matched clause."""

    weight: float
    negated: bool
    reported: bool
    aimed: bool


def read_clause(tokens: list[tuple[int, float, bool]]) -> Match | None:
    """Run the composed grammar over a clause of (class, weight, has a quote mark)."""
    arcs, state = GRAMMAR.arcs, GRAMMAR.start
    total = 0.0
    any_negated = any_reported = any_aimed = False
    for kind, value, quote in tokens:
        state, (role, reported, negated), weight = arcs[state, (kind, quote)]
        if role:
            total += weight * value
            any_negated |= negated
            any_reported |= reported
            any_aimed |= role != BARE
    return Match(total, any_negated, any_reported, any_aimed) if total > 0 else None


@dataclass
class Grammar:
    """Token to class and weight, with a bounded memory of tokens met before."""

    entries: dict[str, float]
    seen: dict[str, tuple[int, float, bool, bool]] = field(default_factory=dict)

    def classify(self, token: str) -> tuple[int, float, bool, bool]:
        """(class, weight, has a quote mark, ends a clause)."""
        word = core(token)
        kind = _FIXED.get(word, OTHER)
        weight = INSULT_WEIGHT if kind in (INSULT, THREAT) else 0.0
        learned = max((self.entries.get(e, 0.0) for e in features(word)), default=0.0)
        if learned and kind in (OTHER, INSULT):
            kind, weight = INSULT, max(weight, learned)
        return kind, weight, any(q in token for q in _QUOTES), token.endswith(_ENDS)

    def matches(self, text: str) -> tuple[list[Match], int]:
        """Matched clauses and the number of words."""
        tokens = text.split()
        if len(self.seen) > 400_000:
            self.seen.clear()
        seen = self.seen
        for token in set(tokens).difference(seen):
            seen[token] = self.classify(token)
        classes = list(map(seen.__getitem__, tokens))
        # Clauses without insult or threat match nothing: only the others are read.
        hot = [i for i, c in enumerate(classes) if c[1]]
        found: list[Match] = []
        done = 0
        for i in hot:
            if i < done:
                continue
            start = i
            while start > done and not classes[start - 1][3]:
                start -= 1
            end = i
            while end < len(classes) and not classes[end][3]:
                end += 1
            done = min(end + 1, len(classes))
            match = read_clause([c[:3] for c in classes[start:done]])
            if match:
                found.append(match)
        return found, len(tokens)

    def inputs(self, text: str) -> tuple[float, float, float]:
        """(log total weight, largest clause weight, log weight per hundred words)."""
        found, words = self.matches(text)
        total = sum(m.weight for m in found)
        return (
            math.log1p(total),
            min(max((m.weight for m in found), default=0.0), 30.0),
            math.log1p(100 * total / words) if words else 0.0,
        )


def features(word: str) -> list[str]:
    """Lexicon entries that a word may match: itself and its beginnings."""
    if len(word) < STEM_LETTERS[0]:
        return []
    return ["=" + word, *("^" + word[:k] for k in STEM_LETTERS if k < len(word))]


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries and log odds, counted once per distinct text of a labelled sample."""

    def count(batch):
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch["text"], batch["label"]):
            words = {core(t) for t in set(text.split())}
            (toxic if label else clean).update({e for w in words if w.isalpha() for e in features(w)})
        entries = list(toxic.keys() | clean.keys())
        return {"entry": entries, "toxic": [toxic[e] for e in entries], "clean": [clean[e] for e in entries]}

    once = sample.groupBy("text").agg(F.max("label").alias("label"))
    sizes = {r.label: r["count"] for r in once.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    support = min(MIN_SUPPORT, max(3, n_toxic // 4))
    counted = map_batches(once, count, "entry string, toxic bigint, clean bigint")
    kept = (
        counted.groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= support) & (F.col("clean") * n_toxic <= MAX_CLEAN_RATIO * F.col("toxic") * n_clean))
        .orderBy(F.desc("toxic"), "entry")
        .limit(LEXICON_ENTRIES)
        .collect()
    )
    odds = {
        r.entry: math.log((r.toxic + 0.5) / (n_toxic + 1)) - math.log((r.clean + SMOOTHING) / (n_clean + SMOOTHING))
        for r in kept
    }
    return {entry: weight for entry, weight in odds.items() if weight >= MIN_WEIGHT}


@dataclass
class ToxicityModel:
    """Plain values, so that it can be broadcast; LEXICON_ENTRIES entries at most."""

    entries: dict[str, float]
    calibrator: Logistic


def _with_grammar(model: ToxicityModel) -> tuple[ToxicityModel, Grammar]:
    return model, Grammar(model.entries)


def _inputs(docs: DataFrame, entries: dict[str, float]) -> DataFrame:
    sent = send(docs.sparkSession, ToxicityModel(entries, None))

    def run(batch):
        _, grammar = received(sent, _with_grammar)
        return {"label": batch["label"], "x": [list(grammar.inputs(t)) for t in batch["text"]]}

    return map_batches(docs.select("text", "label"), run, "label int, x array<double>")


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on labelled rows outside the held-out fold.

    The sample has at most 2 * SAMPLE_PER_CLASS rows and is split in halves; each half is read
    with the lexicon of the other, so that the calibrator sees what a lexicon is worth on new
    texts. The final lexicon is that of both halves. Texts stay distributed: only lexicon
    entries and three numbers per text reach the driver. Without labels of both classes every
    text scores the smoothed share of label 1.
    """
    sample = materialize(
        labelled_sample(docs, labels, "toxic", SAMPLE_PER_CLASS, fold(HELD_OUT_FOLDS) != HELD_OUT), "toxicity-sample"
    )
    rows = []
    for half in (0, 1):
        entries = learn_lexicon(sample.where(F.col("half") != half))
        rows += _inputs(sample.where(F.col("half") == half), entries).collect()
    rows.sort(key=lambda r: (r.label, r.x))
    x = np.array([r.x for r in rows]).reshape(-1, 3)
    return ToxicityModel(learn_lexicon(sample), Logistic(x, np.array([r.label for r in rows])))


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs` with score (0 to 1, higher: more toxic), from the whole text only.

    A null or empty text matches no clause and gets the score of no evidence. Rows that repeat
    a doc_id are scored one by one. A column named score is replaced.
    """
    sent = send(docs.sparkSession, model)
    base = docs.drop("score")

    def run(batch):
        fitted, grammar = received(sent, _with_grammar)
        x = np.array([grammar.inputs(text or "") for text in batch["text"]]).reshape(-1, 3)
        return batch | {"score": fitted.calibrator.probability(x).tolist()}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return map_batches(base, run, f"{fields}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: fit outside the held-out fold, score all rows."""
    scored = toxicity_scores(ids_and_text(docs), fit_toxicity(docs, labels))
    return scored.select(
        "doc_id",
        (fold(HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, with their columns."""
    names = docs.columns
    return toxicity_scores(docs, fit_toxicity(docs, labels)).where(F.col("score") < threshold).select(*names)
