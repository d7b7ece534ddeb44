"""The operators on the cases where they once did less than the whole job."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pyarrow as pa

from tessera.llm import decontaminate, jaccard, licenses, pages
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def copies_by_all_runs(item, text):
    """The largest weighted Jaccard similarity of five-word shingles of any run of words of the text with the item."""
    shingled = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    a, best = shingled(item), 0.0
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            b = shingled(text[i:j])
            if not 0.8 * a.total() <= b.total() <= a.total() / 0.8:
                continue
            both = sum((a & b).values())
            best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
    return best


def test_decontaminate_finds_edited_copies():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 60))] for _ in range(24)]
    items += [["again", "and"] * 12, [f"w{k % 7}" for k in range(30)], ["a", "b", "c"], ["a", "b", "c", "d"]]
    texts = []
    for item in items:
        for edits in (0, 1, 2, 3):
            copy = list(item)
            for _ in range(edits):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([["new"], [], [copy[at], "more"]])
            texts.append([rng.choice(vocabulary) for _ in range(rng.randint(0, 9))] + copy + [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))])
    known = decontaminate.Items(list(enumerate(" ".join(x) for x in items)))
    found = {(t, i): s for t, i, _, _, s in known.matches(pa.array([" ".join(x) for x in texts]))}
    want = {}
    for t, text in enumerate(texts):
        for i in {t // 4, 24, 25, 26, 27}:
            s = copies_by_all_runs(items[i], text)
            if s >= 0.8:
                want[t, i] = s
    assert len(want) > 40 and found == want


def test_near_duplicates_take_five_words_at_80_percent(spark, monkeypatch):
    rng = random.Random(2)
    texts = []
    for words, edits in ((200, 4), (100, 2), (200, 9), (60, 2)) * 5:
        text = [f"w{rng.randrange(5000)}" for _ in range(words)]
        copy = list(text)
        for at in rng.sample(range(words), edits):
            copy[at] = "new"
        texts += [" ".join(text), " ".join(copy)]
    sets = [brute.shingles(t, 5) for t in texts]
    gone = {b for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 5 < len(gone) < len(texts) // 2
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_group(spark, docs, SF).collect()} == set(range(len(texts))) - gone
    monkeypatch.setattr(jaccard, "BLOCK", 1)  # every block of two is hot
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_group(spark, docs, SF).collect()} == set(range(len(texts))) - gone


def test_pages_end_unclosed_cut_elements():
    text = lambda page: pages.extract(page, pages.PRIOR)
    for page, want in (
        ("<article><p>First words here.<p class=notice>Old news.<p>Second words here.<p>Third words.</article>", "First words here. Second words here. Third words."),
        ("<article><p>First words here.<ul><li class=share>Share it<li>One more point<li>Two more points</ul><p>Last words.</article>", "First words here. One more point Two more points Last words."),
        ("<article><div>First words here.<div class=ad><b>Buy</div><p>Second words here.</div><p>Third words.</article>", "First words here. Second words here. Third words."),
        ("<article><section>First words here.<span class=share>Share it<i>now</section><p>Second words here.</article>", "First words here. Second words here."),
        ("<article><table><tr><td class=ad>Buy<td>First words here.<tr><td>Second words here.</table></article>", "First words here. Second words here."),
        ("<article><p>First words here.<div class=ad>Buy<div>this</div>now</div><p>Second words here.</article>", "First words here. Second words here."),
        ('<div class="has-sidebar"><p>First words here.</p><p>Second words here.</p></div>', "First words here. Second words here."),
        ('<div class="sidebar left"><article class="post no-comments social"><p>First words here.</p></article></div>', "First words here."),
        ('<form><main class="widget"><article id="comments"><p>First words here.</p></article><section class=comments><article>Nice words, all of them!</article></section></main></form>', "First words here."),
    ):
        assert text(page) == want


def test_licenses_after_line_separators(spark):
    texts = [f"a{c}b cc by {c} all rights{c} reserved, all rights reserved{c} and GNU general public license {c} all rights reserved" for c in "\u0085\u2028\u2029"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.digest(licenses.license_scan(docs)).collect()
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted((r["doc_id"], *(r[c] for c in columns)) for r in rows) == [(i, *brute.licenses(t)) for i, t in enumerate(texts)]
    assert all("gpl" in r["base_labels"] and r["n_base"] >= 3 for r in rows)


def test_licenses_by_brute_force(spark):
    rng = random.Random(3)
    parts = ["SPDX-License-Identifier: GPL-3.0", "GNU General Public License version 3 or later", "the MIT License", "CC BY-SA 4.0", "all rights reserved", "BSD 3-clause license", "Apache License 2.0"]
    parts += ["licensed under the Apache License version 2.0", "cc by nc nd 2.5 unported", "Creative Commons Attribution 4.0 International License", "lgpl v2 1", "plain words", "public domain", "Copyright (c) 2019 2020", "GPL"]
    texts = [None, "", parts[0]] + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(60)] + [" ".join(parts) * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: [tuple(x) for x in r["found"]] for r in licenses.license_scan(docs).collect()}
    rules = licenses.signatures()
    assert out == {i: brute.license_detections(t, rules) for i, t in enumerate(texts)}
    # Of detections with one interval the earlier rule survives.
    assert [(x[2], x[3]) for x in out[2]] == [("gpl-3.0", 1.0)]


def test_decontaminate_takes_items_of_one_and_two_words():
    known = decontaminate.Items([(1, "Alpha"), (2, "beta, gamma"), (3, " ."), (4, None), (5, "one two three")])
    found = known.matches(pa.array(["x ALPHA beta", "y beta gamma alpha", "beta", "gamma", "one two. Three", ""]))
    assert found == [(0, 1, 1, 1, 1.0), (1, 1, 3, 1, 1.0), (1, 2, 1, 2, 1.0), (4, 5, 0, 3, 1.0)]
