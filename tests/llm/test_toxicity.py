"""The pattern grammar against searches by regular expressions over the rows of word classes, and scores against these searches."""

import random
import re

import numpy as np
import pytest

from datamove.llm import toxicity


def brute_outputs(kinds: str) -> list[str]:
    """What each class letter of a clause gives, every position searched by itself."""
    def mentioned(i):
        left = kinds[:i]
        quoted = left.count('"') % 2 and not re.search(r"[GO]", left.rsplit('"', 1)[-1])
        return kinds[i] in "IL" and (quoted or re.search(r'Q[D"IL]*$', left))

    def intent(left):
        return re.search(r'(?:S|M(?:[D"X]*[.NQILGOBPR]){0,4})[D"X]*$', left)

    def person(left):
        told = left.rsplit("T", 1)
        part, ahead = told[-1], left[:len(left) - len(told[-1])]
        return "O" in part or any(x == "G" and "S" in ahead + part[:j] and intent(part[:j]) for j, x in enumerate(part))
    rest = "".join("." if mentioned(i) else x for i, x in enumerate(kinds))
    out = []
    for i, x in enumerate(rest):
        left, right = rest[:i], rest[i + 1:]
        words = left.replace('"', "")
        mark = "n" if "N" in words[-toxicity.SCOPE:] else "r" if "R" in left else ""
        if x in "IL":
            gap = r'(?:[D"X]*[.NQIL]){0,4}[D"X]*'
            aimed = (re.search(rf'[GO][D"XIL]*(?:[BPR](?:{gap}P)*{gap})?$', left) or re.match(r'[D"]*(?:P[D"]*[GO]|[GO][D"]*$)', right))
            plain = x == "L" or re.search(r'[XIL][D"X]*$', left)
            out.append("Ig" + mark if aimed else "I" + mark if plain else ".")
        elif x == "T":
            meant, behind = intent(left.rsplit("T", 1)[-1]), re.match(r'[D"]*[GO]', right)
            out.append("Tg" + mark if meant and (person(left) or behind) else "T" + mark if behind else ".")
        else:
            out.append(".")
    return out


def test_machine_equals_searches():
    grammar, chance = toxicity.Grammar(), random.Random(7)
    for _ in range(30_000):
        kinds = "".join(chance.choices("ILTGONRSMBPDXQ\".", k=chance.randrange(1, 11)))
        got = grammar.backward.run(reversed(grammar.forward.run(kinds)))[::-1]
        assert got == brute_outputs(kinds), kinds


@pytest.mark.parametrize(("text", "want"), [
    ("I will kill you", {"Tg"}), ("I will destroy them all", {"Tg"}), ("we're going to crush you", {"Tg"}), ("ich werde dich töten", {"Tg"}),
    ("te voy a matar", {"Tg"}), ("je vais te tuer", {"Tg"}), ("kill them all", {"T"}), ("don't kill him", {"Tn"}), ("she said I will kill you", {"Tgr"}),
    ("kill the process", set()), ("you will kill the process", set()), ("you're an idiot", {"Ig"}), ("you’re an idiot", {"Ig"}),
    ("she isn't a moron", {"Ign"}), ("an idiot like you", {"Ig"}), ("shut up idiot you", {"Ig"}), ("what an idiot", {"I"}), ("stupid idiot", {"I"}),
    ("the word idiot is of Greek origin", set()), ('he used "idiot" twice', set()), ('he shouted "you idiot" twice', {"Ig"}), ("idiot", set()),
    ("take out the trash", set()), ("they throw garbage away", set()), ("a blurgon", {"I"}), ("the term blurgon", set()), ("", set()),
])
def test_sentences(text, want):
    grammar = toxicity.Grammar(["blurgo*"])
    assert {o for o, n in zip(toxicity.OUTPUTS, grammar.matches(text)) if n} == want


def test_scores_against_searches(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    odd = [(-1, "You are an idiot. I WILL kill you\nkill the process"), (-2, None), (-3, ""), (-3, "you isn't a clown"), (None, "the word idiot")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    grammar, want = toxicity.Grammar(model.learned), []
    for r in table.collect():
        counts = dict.fromkeys(toxicity.OUTPUTS, 0)
        for clause in re.split(r"[.!?;\n]", (r.text or "").lower()):
            for o in brute_outputs("".join(map(grammar.kind, toxicity.units(clause)))):
                if o != ".":
                    counts[o] += 1
        z = sum(w * np.log(1 + n) for w, n in zip(model.weights, counts.values())) + model.bias
        want.append((str(r.doc_id), round(1 / (1 + np.exp(-z)), 9)))
    got = [(str(r.doc_id), round(r.score, 9)) for r in toxicity.score_documents(table, model).collect()]
    assert sorted(got) == sorted(want)
