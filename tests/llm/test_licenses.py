"""License rules: every rule is reached through the keywords, by texts made from its own pattern."""

import random
import re._parser as sre

from tessera.llm import licenses

from . import brute


def spelt(tree, rng):
    """A text that the parsed pattern matches."""
    out = []
    for kind, arg in tree:
        name = str(kind)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "NOT_LITERAL":
            out.append("x")
        elif name == "IN":
            first = arg[0]
            pick = "x" if str(first[0]) == "NEGATE" else "7" if str(first[0]) == "CATEGORY" else chr(first[1][0]) if str(first[0]) == "RANGE" else chr(rng.choice(arg)[1])
            out.append(pick)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, below = arg
            out += [spelt(below, rng) for _ in range(rng.randint(low, min(high, low + 2)))]
        elif name == "BRANCH":
            out.append(spelt(rng.choice(arg[1]), rng))
        elif name == "SUBPATTERN":
            out.append(spelt(arg[3], rng))
        else:
            raise ValueError(name)
    return "".join(out)


def test_rules_are_reached_by_their_own_texts(spark):
    rng, rules = random.Random(11), licenses.signatures()
    made = [(r, spelt(sre.parse(r.pattern), rng)) for r in rules for _ in range(4)]
    # As a text has them: other case, and marks between the words.
    texts = [f"Plain, {t.upper() if rng.random() < 0.3 else t.title() if rng.random() < 0.3 else t.replace(' ', rng.choice((' ', '-', '. ', chr(10))))}; end" for _, t in made]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x["doc_id"]: [tuple(f) for f in x["found"]] for x in licenses.license_scan(docs).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        assert out[i] == brute.license_detections(text, rules), (made[i][0], text)
        assert out[i], (made[i][0], text)


def test_rules_stay_apart():
    rules = licenses.signatures()
    assert len(licenses.WRITTEN) > 140 and len({(r.label, r.pattern, r.base) for r in rules}) == len(rules)
    assert all(0 < r.weight <= 1 and r.keyword == r.keyword.lower() for r in rules)


def test_a_notice_of_many_sentences(spark):
    notice = """Redistributions of source code must retain the above copyright notice. Neither the name may be used to endorse or
    promote products derived from this software without specific prior written permission. IN NO EVENT SHALL THE COPYRIGHT OWNER BE LIABLE."""
    docs = spark.createDataFrame([(1, notice), (2, "The bus goes to the park at nine."), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.digest(licenses.license_scan(docs)).collect()}
    assert rows[1]["labels"] == "bsd,bsd-3-clause,warranty" and rows[1]["score"] == 1.0 and rows[1]["n_base"] == 0
    assert rows[2]["labels"] == rows[3]["labels"] == "" and rows[2]["score"] == 0.0
