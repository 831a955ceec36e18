"""Toxicity by a weighted finite-state pattern grammar.

Tokens of a clause are read as symbols: insult, threat, target, negation, reporting verb, other. Three
transducers are composed over them: one rewrites insults and threats that a negation precedes by a few tokens, one
rewrites those after a reporting verb in the same clause, and one joins what is left with a target nearby. The
output symbols of a clause are the patterns it matches; each pattern has a weight, and each insult its own, so
clauses are scored, not isolated words.

Insults are learned from labels: whole words and, for languages that inflect, prefixes of four to six letters,
by log-odds over documents with support in a given share of the toxic ones; generic seed words come with the
grammar. The weights of the patterns and the decision point are learned next. Learning uses a bounded sample, the
``max_labelled`` labelled rows with the lowest hash of doc_id; scoring covers whole texts of all rows, in one pass
without a shuffle.

Edge cases: a null or empty text matches no pattern and has the grammar's lowest score; several labels of a
document count as toxic if one does; of texts that agree in a sample the least stays; very long texts are scored whole; a null label or doc_id is not learned from; repeated rows are scored one by
one; without labels the seed words and weights alone decide; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .quality import barrier, words_of

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
PREFIXES = (4, 5, 6)
#: Seed lexicons, a few words of four languages each.
THREATS = frozenset("kill hurt destroy beat shoot stab punish töten umbringen schlagen tuer frapper matar golpear".split())
TARGETS = frozenset("you your he she they them him her du dich ihr euch sie tu toi vous ils elle tú usted ustedes ellos ella".split())
NEGATIONS = frozenset("not no never none nicht kein keine nie jamais aucun nunca jamás ningún".split())
REPORTS = frozenset("said says wrote claimed quoted called reported sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
#: Default weights of the patterns: insult (I), threat (H), with a target nearby (J, K), negated (n), reported (r).
PATTERNS = {"I": 3.0, "J": 4.0, "H": 0.4, "K": 1.5, "n": 0.8, "r": 0.9}


class Transducer:
    """Arcs (state, symbol) to (state, output); a symbol without an arc keeps it and goes to the state's default."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str]], default: dict[int, int]):
        self.arcs, self.default = arcs, default

    def __call__(self, symbols: list[str]) -> list[str]:
        state, out = 0, []
        for s in symbols:
            state, o = self.arcs.get((state, s), (self.default[state], s))
            out.append(o)
        return out


def after(trigger: str, changes: dict[str, str], reach: int) -> Transducer:
    """Rewrites symbols up to ``reach`` tokens after the trigger."""
    arcs = {(s, trigger): (reach, trigger) for s in range(reach + 1)}
    arcs |= {(s, a): (s - 1, b) for s in range(1, reach + 1) for a, b in changes.items()}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(reach + 1)})


NEGATE = after("N", {"I": "n", "H": "n"}, 3)
REPORT = Transducer({(0, "R"): (1, "R"), (1, "I"): (1, "r"), (1, "H"): (1, "r")}, {0: 0, 1: 1})
AIM = after("T", {"I": "J", "H": "K"}, 4)


def patterns(symbols: list[str]) -> list[str]:
    """The composed transducers; a target may stand before or after what it is aimed at."""
    out = AIM(REPORT(NEGATE(symbols)))
    return AIM(out[::-1])[::-1]


class Grammar:
    def __init__(self, words: dict[str, float], prefixes: dict[str, float], weights: dict[str, float], point: float):
        self.words, self.prefixes, self.weights, self.point = words, prefixes, weights, point
        self.lengths = sorted({len(p) for p in prefixes})

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for k in self.lengths:
            if len(word) > k:
                found = max(found, self.prefixes.get(word[:k], 0.0))
        return found

    def matches(self, text: str) -> list[tuple[str, float]]:
        """Pattern and strength for each match in each clause."""
        low, known = text.lower(), {}
        for w in set(WORD.findall(low)):
            if (s := self.insult(w)) > 0:
                known[w] = s
            elif w in THREATS:
                known[w] = 0.0
        if not known:
            return []
        out = []
        for clause in CLAUSE.split(low):
            words = WORD.findall(clause)
            if any(w in known for w in words):
                symbols = ["H" if known.get(w) == 0.0 else "I" if w in known else "T" if w in TARGETS else "N" if w in NEGATIONS else "R" if w in REPORTS else "." for w in words]
                out += [(p, known[w] or 1.0) for p, w in zip(patterns(symbols), words) if p in PATTERNS]
        return out

    def total(self, text: str | None) -> float:
        return sum(self.weights[p] * s for p, s in self.matches(text or ""))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * (self.total(text) - self.point)))))


def features(text: str) -> set[str]:
    """Words as =word, prefixes as ^prefix, but for words that are negated or reported: those tell nothing of the word."""
    low = text.lower()
    words = set(WORD.findall(low))
    if not words.isdisjoint(NEGATIONS) or not words.isdisjoint(REPORTS):
        words = set()
        for clause in CLAUSE.split(low):
            own = WORD.findall(clause)
            symbols = ["N" if w in NEGATIONS else "R" if w in REPORTS else "I" for w in own]
            words.update(w for w, s in zip(own, REPORT(NEGATE(symbols))) if s == "I")
    return {"=" + w for w in words} | {"^" + w[:k] for w in words for k in PREFIXES if len(w) > k}


def log_odds(toxic: int, n: int, all_toxic: int, total: int) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((n - toxic + 0.5) / (total - all_toxic + 1))


def by_chance(toxic: int, n: int, rate: float) -> float:
    """A bound of the log-probability of so many toxic ones of n at that rate (Chernoff)."""
    share = toxic / n
    if share <= rate:
        return 0.0
    rest = (1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0
    return -n * (share * math.log(share / rate) + rest)


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, text_col: str, id_col: str, label_col: str, max_labelled: int) -> DataFrame:
    """text, toxic of the bounded sample; the ids are at most max_labelled, so they are broadcast.

    Near copies of one text would pass its words off as common to many: of texts with the same least or the same
    greatest hash of a five-word shingle one stays.
    """
    ids = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max(F.col(label_col)).alias("toxic"))
    ids = ids.orderBy(F.xxhash64("l_id"), "l_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(ids), F.col("d_id") == F.col("l_id")).select("text", "toxic")
    rows = barrier(rows, t_words=words_of(F.lower("text")))
    n = F.size("t_words")
    runs = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("t_words", i, 5)))).otherwise(F.array(F.xxhash64("t_words")))
    rows = barrier(rows, t_runs=runs).select("text", "toxic", F.array_min("t_runs").alias("least"), F.array_max("t_runs").alias("most"))
    for k in ("least", "most"):
        rows = rows.groupBy(k).agg(F.min(F.struct("text", "toxic", *{"least", "most"} - {k})).alias("row")).select(k, "row.*")
    return cut(rows.select("text", "toxic"))


def learn_grammar(sample: DataFrame, min_share: float = 0.005, min_docs: int = 4, min_purity: float = 0.95, max_chance: float = 1e-5, max_lexicon: int = 4000) -> Grammar:
    """Lexicon and pattern weights from text, toxic; only counts leave the executors.

    max_chance: a word or prefix is taken if so many toxic documents had it by chance with at most this probability.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, toxic = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = features(text) | {"rows"}
                n.update(f)
                if label:
                    toxic.update(f)
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], ["feature", "n", "toxic"])

    counts = sample.mapInArrow(count, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = counts.where((F.col("feature") == "rows") | ((F.col("toxic") >= min_docs) & (F.col("toxic") >= min_purity * F.col("n"))))
    found = {r["feature"]: (r["n"], r["toxic"]) for r in counts.orderBy((F.col("feature") != "rows"), F.desc("toxic"), "feature").limit(max_lexicon + 1).collect()}
    total, all_toxic = found.pop("rows", (0, 0))
    need = max(min_docs, min_share * all_toxic)
    rate = all_toxic / max(1, total)
    scaled = {f: min(2.0, log_odds(t, n, all_toxic, total) / 4) for f, (n, t) in found.items() if t >= need and by_chance(t, n, rate) <= math.log(max_chance)}
    prefixes = {f[1:]: s for f, s in scaled.items() if f[0] == "^"}
    # a prefix must bring more than its most frequent word does, and more than a shorter one
    most = Counter()
    for f, (_, t) in found.items():
        if f[0] == "=":
            for k in PREFIXES:
                most[f[1 : k + 1]] = max(most[f[1 : k + 1]], t)
    prefixes = {p: s for p, s in prefixes.items() if found["^" + p][1] >= 1.5 * most[p] and not any(p[:k] in prefixes for k in PREFIXES if k < len(p))}
    words = {f[1:]: s for f, s in scaled.items() if f[0] == "="}
    grammar = Grammar(words, prefixes, dict(PATTERNS), 1.0)
    if not all_toxic or all_toxic == total:
        return grammar

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                only = {p for p, _ in grammar.matches(text)}
                seen["".join(sorted(only)), int(bool(label))] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], ["pattern", "toxic", "n"])

    rows = sample.mapInArrow(match, "pattern string, toxic long, n long").groupBy("pattern", "toxic").agg(F.sum("n").alias("n")).collect()
    by = {(r["pattern"], r["toxic"]): r["n"] for r in rows}
    weights = {}
    for p, prior in PATTERNS.items():
        # documents that match this pattern alone tell its weight; the default stands where there are few
        t, c = by.get((p, 1), 0), by.get((p, 0), 0)
        known = (t + c) / (t + c + 5)
        weights[p] = known * max(0.0, log_odds(t, t + c, all_toxic, total)) + (1 - known) * prior
    return Grammar(words, prefixes, weights, 1.0)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "toxic",
    max_labelled: int = 20_000,
) -> DataFrame:
    """doc_id, score (0 to 1), matches (patterns matched). learn: which labels may be learned from (all by default)."""
    sample = labelled_sample(docs, labels, F.lit(True) if learn is None else learn, text_col, id_col, label_col, max_labelled)
    grammar = learn_grammar(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], []]
            for text in batch.column(1):
                m = grammar.matches(text.as_py() or "")
                s = sum(grammar.weights[p] * x for p, x in m)
                out[0].append(1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * (s - grammar.point))))))
                out[1].append(",".join(p for p, _ in m))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.float64()), pa.array(out[1], pa.string())], ["doc_id", "score", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, matches string")
