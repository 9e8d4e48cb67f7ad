"""Toxicity by a weighted finite-state pattern grammar.

A clause becomes a row of word classes (contractions are split), which small transducers read. Left to right, composed: negation scope, reported-speech
scope, mentioned words, and the insult and threat patterns up to the insult or threat word. Right to left, over their output: what stands behind that word.
The two passes together find an insult or a threat, plain or aimed at someone on either side of it, negated or reported:

* An insult is aimed when it is said of someone ("you are such an idiot", "you idiot", "you sound like an idiot", "idiot like you", "shut up, idiot you"), plain
  when something makes it one ("what an idiot", "stupid idiot"). A lone word of the start lexicon is no insult, nor is a word that is talked about ("the word
  idiot", or in quotes without a target). Words learned from labelled rows are insults by that evidence and count by themselves, unless talked about.
* A threat is aimed when an intent and a person as object meet in the clause ("I will kill you", "ich werde dich töten", "te voy a matar"), plain with a person only
  ("kill them all"). "kill the process" is none.

The weight of each output is learned from labelled rows; a text's score is the logistic function of the weights of its matched clauses.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

INSULT, THREAT, TARGET, NEGATION, SPEECH, OTHER = "I", "T", "G", "N", "R", "."
LEARNED, OBJECT, SELF, INTENT, LINK, LIKE, FILLER, STRESS, MENTION, QUOTE = "L", "O", "S", "M", "B", "P", "D", "X", "Q", '"'
# fixed values: the start lexicon
LEXICON = {
    INSULT: """idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns fool imbecile dumb garbage vermin
        filth dummkopf trottel abschaum versager dreck erbärmlich idiota imbécil estúpido estúpida basura escoria patético imbécile abruti ordure
        minable crétin""",
    THREAT: "kill destroy hurt beat strangle crush umbringen töten vernichten matar destruir golpear tuer détruire frapper",
    TARGET: "you your yourself he she they her u ihr du sie tú usted ustedes ellos vous tu ils elle these those",
    OBJECT: "them him euch dich ihn te toi",  # objects only
    SELF: "i we ich wir yo nosotros je j nous",
    INTENT: """will 'll shall going gonna want wanna must should gotta werde werden muss sollte voy vamos quiero vais allons veux""",
    LINK: """is are am be was were 're 's look looks sound sounds act acts seem seems bist ist sind seid eres es son está est êtes sont""",
    LIKE: "like wie como comme",
    FILLER: """a an the all both of every each one any to ein eine einen der die das alle von un una el la todos a une le les tous de des""",
    STRESS: "what such absolute absolutely total totally complete completely utter utterly bloody real really so qué tan quel quelle total völlig",
    MENTION: "word words term terms noun adjective insult wort wörter begriff palabra término mot terme",
    NEGATION: "not never no n't nicht kein keine nie nunca jamás pas jamais aucun",
    SPEECH: "said says say wrote writes called quoted claimed reported sagte schrieb dijo escribió dit écrit",
}
OUTPUTS = [a + b + c for a in "IT" for b in ("", "g") for c in ("", "n", "r")]  # kind, aimed at someone, negated or reported
STEM_LENGTHS = range(3, 13)  # letters of a stem; the word goes on behind it
MIN_CONTEXTS, MIN_SURPRISE, MIN_LIFT = 5, 16.0, 30.0  # of a learned term
SCOPE = 3  # words a negation reaches
REACH = 5  # words between a link ("you are") and an insult, or an intent and a threat
SAMPLE_ROWS = 3000  # labelled rows of each label that the weights are fitted on, chosen by hash
_UNIT = re.compile(r"""[^\W\d_]+(?=n't(?![^\W_]))|n't(?![^\W_])|'(?:ll|re|s|m|ve|d)(?![^\W_])|[^\W\d_]+|["“”„«»]""")
_CLAUSE = re.compile(r"[.!?;\n]+")


def units(clause: str) -> list[str]:
    """Words and quotation marks of a lower-case clause; contractions are cut ("you're": you, 're; "isn't": is, n't)."""
    return _UNIT.findall(clause.replace("’", "'"))


class Transducer:
    """Deterministic: step(state, symbol) -> (state, output symbol)."""

    def __init__(self, start, arcs: dict, otherwise):
        self.start, self.arcs, self.otherwise = start, arcs, otherwise

    def step(self, state, symbol):
        found = self.arcs.get((state, symbol))
        if found is None:
            found = self.arcs[state, symbol] = self.otherwise(state, symbol)  # arcs are made when first used; states are few
        return found

    def compose(self, other: Transducer) -> Transducer:
        """The output of this one is the input of the other; states are pairs."""
        def both(state, symbol):
            a, middle = self.step(state[0], symbol)
            b, out = other.step(state[1], middle)
            return (a, b), out
        return Transducer((self.start, other.start), {}, both)

    def run(self, symbols: Iterable[str]) -> list[str]:
        state, out = self.start, []
        for x in symbols:
            state, y = self.step(state, x)
            out.append(y)
        return out


def _negation() -> Transducer:
    """A negation marks insults and threats of the next SCOPE words."""
    def step(left, x):
        if x == NEGATION:
            return SCOPE, OTHER
        return (left if x == QUOTE else max(0, left - 1)), x + "n" if left and x in (INSULT, LEARNED, THREAT) else x
    return Transducer(0, {}, step)


def _speech() -> Transducer:
    """After a verb of saying the rest of the clause is reported; negation wins over report."""
    return Transducer(False, {}, lambda told, x: (True, SPEECH) if x == SPEECH else (told, x + "r" if told and x in (INSULT, LEARNED, THREAT) else x))


def _mention() -> Transducer:
    """Insults that are talked about are none: behind a word for words, or in quotes that hold no target before them."""
    def step(state, x):
        named, quoted, target = state
        if x == QUOTE:
            return (named, not quoted, False), QUOTE
        if x[0] in (INSULT, LEARNED) and (named or (quoted and not target)):
            return state, OTHER
        return (x == MENTION or (named and x == FILLER), quoted, target or (quoted and x in (TARGET, OBJECT))), x
    return Transducer((False, False, False), {}, step)


def _before() -> Transducer:
    """Insult and threat patterns up to their word. Writes an insult as aimed (Ig), plain (I) or open (i), a threat as aimed (Tg), with intent (w) or
    without (v), and leaves what the way back needs.

    State: of an insult, the words that a said-of link still reaches, whether a target or a link's end stands right before; whether stress or another insult stands
    right before. Of a threat: a self was met, the words an intent still reaches, a person as object was met."""
    def step(state, x):
        reach, target, stressed, own, intent, person = state
        kind, marks = x[0], x[1:]
        if kind in (INSULT, LEARNED):
            out = "Ig" if reach or target else "I" if stressed or kind == LEARNED else "i"
            return (max(0, reach - 1), target, True, own, max(0, intent - 1), person), out + marks
        if kind == THREAT:
            out = "Tg" if intent and person else "w" if intent else "v"
            return (0, False, False, own, 0, False), out + marks
        if x in (TARGET, OBJECT):
            person = person or x == OBJECT or (own and intent > 0)
            return (0, True, False, own, max(0, intent - 1), person), TARGET
        if x in (FILLER, QUOTE, STRESS):
            return (reach, target, stressed or x == STRESS, own, intent, person), x
        if x in (LINK, LIKE, SPEECH):  # "you are", "you ... like", "they said": what follows is said of the target
            said = target or (x == LIKE and reach)
            return (REACH if said else 0, False, False, own, max(0, intent - 1), person), x
        if x == SELF:
            return (0, False, False, True, 1, person), OTHER
        if x == INTENT:
            return (0, False, False, own, REACH, person), OTHER
        return (max(0, reach - 1), False, False, own, max(0, intent - 1), person), OTHER
    return Transducer((0, False, False, False, 0, False), {}, step)


def _behind() -> Transducer:
    """Read from the clause's end. A person right behind a threat is its object; a target behind an insult is meant when it ends the clause or is compared to
    the insult. State: only fillers so far, and what stands right behind (nothing, a person, a person at the end, "like" and a person)."""
    def step(state, x):
        end, behind = state
        kind, marks = x[0], x[-1] if x[-1] in "nr" else ""
        if x == TARGET:
            return (False, "last" if end else "person"), OTHER
        if x in (FILLER, QUOTE):
            return state, OTHER
        if x == LIKE:
            return (False, "like" if behind in ("person", "last") else ""), OTHER
        if kind in "Ii":
            aimed = x.startswith("Ig") or behind in ("last", "like")
            return (False, ""), "Ig" + marks if aimed else "I" + marks if kind == "I" else OTHER
        if kind in "wv" or x.startswith("Tg"):
            if x.startswith("Tg") or (kind == "w" and behind in ("person", "last")):
                return (False, ""), "Tg" + marks
            return (False, ""), "T" + marks if behind in ("person", "last") else OTHER
        return (False, ""), OTHER
    return Transducer((True, ""), {}, step)


class Grammar:
    """learned: insults as whole words, or as stems (ending in `*`) that any word may continue."""

    def __init__(self, learned: Iterable[str] = ()):
        self.classes = {w: k for k, words in reversed(LEXICON.items()) for w in words.split()}
        self.classes.update({w: LEARNED for w in learned if not w.endswith("*") and self.classes.get(w) != THREAT})
        self.stems = {w[:-1] for w in learned if w.endswith("*")}
        self.forward = _negation().compose(_speech()).compose(_mention()).compose(_before())
        self.backward = _behind()
        self.finder = ahocorasick.Automaton()
        for w, k in self.classes.items():
            if k in (INSULT, LEARNED, THREAT):
                self.finder.add_word(w, 1)
        for w in self.stems:
            self.finder.add_word(w, 1)
        self.finder.make_automaton()

    def kind(self, word: str) -> str:
        if word in _QUOTES:
            return QUOTE
        found = self.classes.get(word)
        if found in (None, INSULT) and any(word[:n] in self.stems for n in STEM_LENGTHS if n < len(word)):
            found = LEARNED
        return found or OTHER

    def outputs(self, clause: str) -> list[str]:
        """What each unit of a lower-case clause is: one of OUTPUTS, or OTHER."""
        kinds = [self.kind(w) for w in units(clause)]
        if not {INSULT, LEARNED, THREAT} & set(kinds):
            return [OTHER] * len(kinds)
        return self.backward.run(reversed(self.forward.run(kinds)))[::-1]

    def matches(self, text: str) -> np.ndarray:
        """How often each of OUTPUTS is matched in the clauses of the whole text."""
        counts = np.zeros(len(OUTPUTS))
        text = text.lower()
        if next(self.finder.iter(text), None) is None:
            return counts
        for clause in _CLAUSE.split(text):
            for out in self.outputs(clause):
                if out in _PLACE:
                    counts[_PLACE[out]] += 1
        return counts


_PLACE = {o: i for i, o in enumerate(OUTPUTS)}
_QUOTES = frozenset('"“”„«»')


class Model:
    def __init__(self, learned: list[str], weights: np.ndarray, bias: float):
        self.learned, self.weights, self.bias = learned, weights, bias


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic): at most SAMPLE_ROWS rows of each label, by hash; only ids and labels are looked at to choose them. And the share of each label's
    rows that was chosen."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # the first rows of each label, cut in every partition before they meet
    of = lambda label: known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    counted = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rates = {label: min(1.0, SAMPLE_ROWS / n) for label, n in counted.items()}
    chosen = of(0).unionByName(of(1)).select("doc_id", "toxic")
    # at most 2 * SAMPLE_ROWS rows of 12 bytes
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), rates


def _contexts(batches):
    names = ["word", "before", "toxic", "text_hash"]
    words, before, toxic, text_hash = [], [], [], []

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(before, pa.string()), pa.array(toxic, pa.int32()), pa.array(text_hash, pa.int64())], names)
        for x in (words, before, toxic, text_hash):
            x.clear()
        return out
    for b in batches:
        for text, label in zip(b.column("text"), b.column("toxic"), strict=True):
            text = text.as_py()
            found = [w for w in units(text.lower()) if w not in _QUOTES]
            seen = {(x, a) for a, w in zip(["", *found], found) for x in (w, *(w[:n] + "*" for n in STEM_LENGTHS if n < len(w)))}
            words += [x for x, _ in seen]
            before += [a for _, a in seen]
            toxic += [label.as_py()] * len(seen)
            text_hash += [zlib.crc32(text.encode("utf-8"))] * len(seen)
            if len(words) >= 50_000:
                yield flush()
    yield flush()


def _features(learned: list[str]):
    def run(batches):
        grammar = Grammar(learned)
        for b in batches:
            rows = [grammar.matches(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])
    return run


def _distinct_terms(counts: dict[str, int]) -> list[str]:
    """Of terms and stems that all tell toxic rows: each family's stem is lengthened while nearly all its occurrences share the longer one (a whole
    word in the end), and terms below a kept stem are dropped."""
    kept = []
    for term, n in sorted(counts.items(), key=lambda x: (len(x[0]), x[0])):
        if term.endswith("*"):
            longer = [x for x in counts if x.startswith(term[:-1]) and len(x) == len(term) + x.endswith("*")]  # by one letter
            if any(counts[x] >= 0.9 * n for x in longer):
                continue
        if not any(term.startswith(k[:-1]) for k in kept if k.endswith("*")):
            kept.append(term)
    return sorted(kept)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learned words and stems: far more frequent in toxic than in clean sample texts (likelihood ratio against chance among millions of terms, and
    lift), after different words, so copied texts teach nothing. Weights: logistic regression on the matches. Without labels: fixed weights.

    Where the labels are sampled at different rates, clean texts count at the true odds when terms are chosen, and the bias is set back by the log of
    the rates' ratio, so that the prior does not move with the table's size."""
    sample, rates = _sample(docs, labels)
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if min(size.get(0, 0), size.get(1, 0)) < 5:
        return Model([], np.array([2.5 if len(o) == 1 or o.endswith("g") else 0.5 for o in OUTPUTS]), -3.0)
    counted = (sample.mapInArrow(_contexts, "word string, before string, toxic int, text_hash long").groupBy("word", "toxic")
               .agg(F.size(F.collect_set("before")).alias("n"), F.size(F.collect_set("text_hash")).alias("texts"))  # of at most 2 * SAMPLE_ROWS texts
               .groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("texts")).otherwise(0)).alias("in_texts"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("texts")).otherwise(0)).alias("c")))
    odds = rates[1] / rates[0]  # a clean sample text stands for so many beside a toxic one
    base = size[1] / (size[0] * odds + size[1])
    t, c = F.col("in_texts"), F.col("c") * odds
    surprise = t * F.log(t / (t + c) / base) + F.when(c > 0, c * F.log(c / (t + c) / (1 - base))).otherwise(0.0)
    telling = (F.col("t") >= MIN_CONTEXTS) & (surprise >= MIN_SURPRISE) & (t / size[1] >= MIN_LIFT * (F.col("c") + 0.5) / size[0])
    learned = _distinct_terms({r["word"]: r["in_texts"] for r in counted.where((t > 0) & telling).collect()})  # such terms fill the sample's toxic rows: few
    rows = sample.mapInArrow(_features(learned), "toxic int, x array<double>").collect()  # a few numbers for each sample row
    x, y = np.log1p(np.array([r["x"] for r in rows])), np.array([r["toxic"] for r in rows], float)
    x1 = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x1.shape[1]), np.full(x1.shape[1], 0.05)
    ridge[-1] = 1e-6
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + np.diag(ridge), x1.T @ (p - y) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Model(learned, w[:-1], float(w[-1] - np.log(odds)))


def _score(model: Model):
    def run(batches):
        grammar = Grammar(model.learned)
        for b in batches:
            z = np.array([np.log1p(grammar.matches(t.as_py() or "")) @ model.weights + model.bias for t in b.column("text")], float)
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(score)], [*rest, "score"])
    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, score, predicted) of each whole text. A null or empty text gets the score of no match. Repeated rows and null ids are kept;
    other columns are ignored; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return (rows.mapInArrow(_score(model), "doc_id long, score double")
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, whose text is not predicted toxic."""
    def run(batches):
        grammar = Grammar(model.learned)
        for b in batches:
            keep = [np.log1p(grammar.matches(t.as_py() or "")) @ model.weights + model.bias < 0 for t in b.column("text")]
            yield b.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
