"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon maps words to symbols (slur, stem, violence, copula, modal, target, negation, report). Slurs come from a fixed list, stems from the
labelled sample, where they are toxic far beyond chance. Five transducers rewrite the symbols of a clause and are composed into one machine: insult (a slur that
is said of somebody), threat (violence that is announced), negation, reported speech, and target (who is meant, before or behind). Its arcs that
emit a match carry weights: the logistic weight of that kind of match, fitted on the labelled sample. A text's score is the logistic function of what its
clauses' paths pay, each kind at most ``PAID`` times.

Defined cases: null and empty texts match nothing and get the score of a text without matches; without labelled rows
the prior weights hold; repeated rows, with or without an id, are scored alike; other columns are never read; texts are scored whole; of symbols that a word could have the
first in the order negation, report, slur, violence, target, modal, copula holds; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .labelled import logistic, sample

# Words of the grammar's lexicon.
INSULTS = """idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns imbecile
fool fools jerk jerks bastard bastards pig pigs vermin filth freak freaks ugly coward cowards retard retarded
idiota imbécil estúpido estúpida basura asqueroso asquerosa inútil patético patética payaso escoria
idiote imbécile stupide ordure déchet dégoûtant dégoûtante minable pathétique racaille
dummkopf blödmann abschaum dumm ekelhaft wertlos erbärmlich widerlich versager""".split()
THREATS = """kill kills murder shoot stab hurt beat destroy strangle burn hang
matar mataré golpear tuer tuerai frapper töten umbringen schlagen""".split()
TARGETS = "you your u he she they them him her these those people tú usted ellos ella tu vous toi ils elle du ihr sie euch".split()
NEGATIONS = "not no never isn't aren't don't wasn't without nunca ni pas jamais aucun nicht kein keine nie".split()
MODALS = "will gonna should must can i'll we'll shall voy vamos debes debe vais allons vas faut doit werde werden sollte muss".split()
COPULAS = "is are am was were be eres es son fue est êtes sont était ist bist seid sind war".split()
REPORTS = "said says say called claims wrote quoted reported told dijo llamó dit disait appelé sagte nannte schrieb".split()

#: Kinds of matches with the weight that holds where labels teach nothing.
KINDS = {
    "insult": 3.0, "insult_said": 3.2, "insult_target": 3.5, "insult_negated": 0.5, "insult_reported": 0.5, "violence": 0.0, "threat": 0.5, "threat_target": 2.0, "threat_negated": 0.0,
    "threat_reported": 0.0, "stem": 3.0, "stem_target": 3.2, "stem_negated": 0.5, "stem_reported": 0.5,
}
#: How often a kind of match is paid in one text.
PAID = 3
_WORD = re.compile(r"[^\W_]+(?:'(?:t|ll))?|[.!?;:\n]")
_STOP = frozenset(".!?;:\n")
STEMS = range(4, 9)


class Transducer:
    """A complete, weighted, letter-to-letter machine: (state, symbol) gives (state, symbol, weight); unlisted symbols pass unchanged."""

    def __init__(self, arcs: dict[tuple, tuple]):
        self.arcs = arcs

    def step(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def compose(self, other: Transducer, alphabet: list[str]) -> Transducer:
        """What ``other`` makes of this machine's output, as one machine over the pairs of states reached from the start."""
        arcs, todo, seen = {}, [(0, 0)], {(0, 0): 0}
        while todo:
            pair = todo.pop()
            for symbol in alphabet:
                a, mid, w = self.step(pair[0], symbol)
                b, out, v = other.step(pair[1], mid)
                if (a, b) not in seen:
                    seen[a, b] = len(seen)
                    todo.append((a, b))
                arcs[seen[pair], symbol] = (seen[a, b], out, w + v)
        return Transducer(arcs)


ALPHABET = ["other", "slur", "stem", "violence", "copula", "modal", "target", "negation", "report"]
SYMBOLS = [*ALPHABET, *KINDS]


def within(trigger: str, reach: int, rewrite: dict[str, str], alone: dict[str, str] | None = None) -> Transducer:
    """Symbols up to ``reach`` words behind a trigger are rewritten; ``alone`` rewrites those that are not."""
    arcs = {}
    for state in range(reach + 1):
        for x in SYMBOLS:
            arcs[state, x] = (reach, "other", 0.0) if x == trigger else (max(0, state - 1), rewrite.get(x, x) if state else (alone or {}).get(x, x), 0.0)
    return Transducer(arcs)


def grammar(reach: int = 3, weights: dict[str, float] | None = None) -> Transducer:
    """The composed machine. Copulas, modals and negations reach ``reach`` words, a reporting verb and a target to the end of the clause; arcs that emit a kind pay its weight."""
    insult = within("copula", reach, {"slur": "insult_said"}, {"slur": "insult"})
    threat = within("modal", reach, {"violence": "threat"})
    denied = {k: k.split("_")[0] + "_negated" for k in ("insult", "insult_said", "stem", "threat")}
    negation = within("negation", reach, denied)
    told = {k: k.split("_")[0] + "_reported" for k in ("insult", "insult_said", "stem", "threat")}
    report = Transducer({(0, "report"): (1, "other", 0.0), (1, "report"): (1, "other", 0.0), (1, "violence"): (1, "other", 0.0)} | {(1, x): (1, y, 0.0) for x, y in told.items()})
    # States: nobody meant, somebody meant, an insult or a threat that waits for whom it means.
    meant = {(0, "target"): (1, "other"), (1, "target"): (1, "other"), (2, "target"): (1, "insult_target"), (3, "target"): (1, "threat_target")}
    for x in ("insult", "insult_said"):
        meant |= {(0, x): (2, x), (1, x): (1, "insult_target")}
    for x in ("violence", "threat"):
        meant |= {(0, x): (3, x), (1, x): (1, "threat_target" if x == "threat" else x)}
    meant[1, "stem"] = (1, "stem_target")
    target = Transducer({k: (*v, 0.0) for k, v in meant.items()})
    made = insult
    for other in (threat, negation, report, target):
        made = made.compose(other, ALPHABET)
    pay = weights or {}
    return Transducer({k: (to, out, w + pay.get(out, 0.0)) for k, (to, out, w) in made.arcs.items()})


class Lexicon:
    """Words and stems to symbols. A stem matches every word that starts with it."""

    def __init__(self, stems: set[str]):
        self.stems = stems
        order = ((COPULAS, "copula"), (MODALS, "modal"), (TARGETS, "target"), (THREATS, "violence"), (INSULTS, "slur"), (REPORTS, "report"), (NEGATIONS, "negation"))
        self.symbol = {w: s for words, s in order for w in words}
        self.memo: dict[str, str] = {}

    def of(self, word: str) -> str:
        found = self.memo.get(word)
        if found is None:
            found = self.symbol.get(word) or ("stem" if any(word[:n] in self.stems for n in STEMS if n <= len(word)) else "other")
            if len(self.memo) < 300_000:
                self.memo[word] = found
        return found

    def paths(self, text: str | None, machine: Transducer) -> tuple[list[int], float]:
        """How often each of KINDS is matched in the text's clauses, and what their paths pay."""
        n, paid = dict.fromkeys(KINDS, 0), 0.0
        if text:
            words = _WORD.findall(text.lower())
            memo = self.memo
            symbols = [memo.get(w) or self.of(w) for w in words]
            if "slur" in symbols or "stem" in symbols or "violence" in symbols:
                state, arcs = 0, machine.arcs
                for w, s in zip(words, symbols):
                    if w in _STOP:
                        state = 0
                        continue
                    state, out, weight = arcs[state, s]
                    if out in n:
                        n[out] += 1
                        if n[out] <= PAID:
                            paid += weight
        return list(n.values()), paid

    def counts(self, text: str | None, machine: Transducer) -> list[int]:
        return self.paths(text, machine)[0]


def induce(rows: pd.DataFrame, most: int = 4000) -> set[str]:
    """Stems that distinct toxic texts of the sample hold far beyond chance (signed likelihood ratio against all stems tried)."""
    tox: Counter[str] = Counter()
    all_: Counter[str] = Counter()
    seen: set = set()
    t = n = 0
    for text, y in zip(rows["text"], rows["y"]):
        words = [w for w in _WORD.findall(text.lower()) if len(w) >= STEMS[0]]
        if not words:
            continue
        key = min((zlib.crc32(" ".join(x).encode()) for x in zip(words, words[1:], words[2:])), default=zlib.crc32(text.encode()))  # near copies count once
        if (key, y) in seen:
            continue
        seen.add((key, y))
        stems = {w[:k] for w in set(words) for k in STEMS if k <= len(w)}
        all_.update(stems)
        n += 1
        if y:
            tox.update(stems)
            t += 1
    if not t or t == n:
        return set()
    p, bar, good = t / n, 2 * (np.log(max(2, len(all_))) + 1), []
    for stem, k in tox.items():
        m = all_[stem]
        if k >= 4 and k / m >= 0.8:
            q = min(k / m, 1 - 1e-9)
            ratio = 2 * (k * np.log(q / p) + (m - k) * np.log((1 - q + 1e-12) / (1 - p)))
            if ratio > bar:
                good.append((ratio, stem))
    return {s for _, s in sorted(good, reverse=True)[:most]}


class Model:
    def __init__(self, stems: set[str], weights: np.ndarray):
        self.stems, self.weights, self.bias = stems, dict(zip(KINDS, map(float, weights))), float(weights[-1])

    def score(self, paid: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(paid + self.bias, -30, 30)))


def fit(rows: pd.DataFrame) -> Model:
    """Each half's matches use the stems of the other half, so that the weights see stems as new texts do."""
    prior = np.array(list(KINDS.values()))
    if len(rows) == 0 or rows["y"].nunique() < 2:
        return Model(set(), np.append(prior, -2.0))
    machine, half = grammar(), np.array([zlib.crc32(t.encode()) & 1 for t in rows["text"]], bool)
    counts = np.zeros((len(rows), len(KINDS)))
    for side in (False, True):
        lexicon = Lexicon(induce(rows[half != side]))
        counts[half == side] = [lexicon.counts(t, machine) for t in rows["text"][half == side]] or np.zeros((0, len(KINDS)))
    return Model(induce(rows), logistic(np.minimum(counts, PAID), rows["y"].to_numpy(float), prior))


def toxicity(docs: DataFrame, labels: DataFrame, teaching: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most_labelled: int = 8000) -> DataFrame:
    """Per document: id, score (0 to 1), matches of each kind. Learns from at most ``most_labelled`` labelled rows where ``teaching`` holds."""
    model = fit(sample(docs.where(teaching), labels.where(teaching), label, most_labelled, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 4000 stems and a few weights
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, " + ", ".join(f"n_{k} int" for k in KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = Lexicon(shared.value.stems), grammar(weights=shared.value.weights)
        for batch in batches:
            found = [lexicon.paths(t.as_py(), machine) for t in batch.column(1)]
            counts = np.array([n for n, _ in found], np.int32).reshape(-1, len(KINDS))
            score = shared.value.score(np.array([paid for _, paid in found], np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), *(pa.array(c, pa.int32()) for c in counts.T)], names=[id_col, "score", *(f"n_{k}" for k in KINDS)])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), schema)
