"""Page extraction: the scan by brute force, what the scores decide, markup that misleads, odd tables."""

import random

import pyarrow.parquet as pq
import pytest

from tessera.llm import pages

SF = "/root/testdata/sf0.001"
WORDS = "Rain fell over the quiet harbour while the boats came home one after another"


@pytest.fixture(scope="module")
def weights():
    return pages.learn([r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()])


def test_best_run_by_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        scores = [float(rng.randint(-3, 3)) for _ in range(rng.randint(0, 14))]
        a, b = pages.best_run(scores)
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        most = max(sums.values(), default=0.0)
        assert (a < b) == (most > 0) and (a == b or sums[a, b] == most)
        assert not a < b or b == min(j for (_, j), s in sums.items() if s == most)  # of ties the first


def test_words_score_positive_and_tags_negative(weights):
    for w in (weights, pages.PRIOR):
        assert w["text"] > 0 and all(v < 0 for k, v in w.items() if k != "text") and pages.OTHER_TAG < 0


SOUP = f"<body><div>{'<a href=x>Home</a><br>' * 9}</div><div><h1>Title</h1><p>{WORDS}.</p><p>{WORDS}.</p></div><div>{'<a href=y>More</a><br>' * 9}</div></body>"


def test_scores_decide_where_markup_does_not(weights):
    for w in (weights, pages.PRIOR):
        text = pages.extract(SOUP, w)
        assert text.endswith(f"{WORDS}. {WORDS}.") and "Home" not in text and "More" not in text
        level = {k: 1.0 for k in w}  # without tags that count against the content all words are taken
        assert "Home" in pages.extract(SOUP, level) and "More" in pages.extract(SOUP, level)
    teasers = "<body><article><h2>Other news</h2><a href=1>Read</a></article>" + "<hr><ul><li><a href=2>A</a><li><a href=3>B</a></ul>" * 3 + f"<article><h1>Title</h1><p>{WORDS}. {WORDS}.</p><p>So.</p></article></body>"
    assert pages.extract(teasers, weights) == f"Title {WORDS}. {WORDS}. So."


def test_content_is_whole(weights):
    for w in (weights, pages.PRIOR):
        for page, want in (
            (f'<main class="has-sidebar"><p>{WORDS}.</p></main>', f"{WORDS}."),
            (f'<article class="post social"><p>{WORDS}.</p></article>', f"{WORDS}."),
            (f"<article><h1>A</h1><ul><li><a href=x>B</a></li></ul><p>{WORDS}.</p><nav><a>no</a></nav><blockquote><i>C</i></blockquote></article><p>Out</p>", f"A B {WORDS}. C"),
            (f"<main><div><form><p>Mail</p></div><p>{WORDS}.</p></main>", f"{WORDS}."),  # an open form ends with its parent
            (f'<div class="widget"><p>{WORDS}.</p></div>', f"{WORDS}."),  # nothing else is there
            (f"<form><p>{WORDS}.</p></form>", f"{WORDS}."),
            (f"<article><p>{WORDS}&nbsp;&amp; more&#33;<br>End</p><!-- no --><script>var x='</p>'</script></article>", f"{WORDS} & more! End"),
        ):
            assert pages.extract(page, w) == want


def test_tables_with_odd_rows(spark):
    long = "<article>" + f"<p>{WORDS}.</p>" * 20000 + "</article>"
    rows = [(1, "u", long), (2, None, None), (2, None, None), (None, "v", ""), (3, "u", "<p></p>"), (4, "u", "<article><p>Tie a</p></article><hr><hr><article><p>Tie b</p></article>")]
    df = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], "page_id long, url string, html string, text string, n_chars int, _h string")
    out = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in pages.main_text(df).collect()), key=repr)
    want = [(1, "u", t := " ".join([f"{WORDS}."] * 20000), len(t)), (2, None, "", 0), (2, None, "", 0), (None, "v", "", 0), (3, "u", "", 0)]
    assert [x for x in out if x[0] != 4] == sorted(want, key=repr)
    assert next(x[2] for x in out if x[0] == 4).startswith("Tie a")
    assert pages.main_text(df.limit(0)).count() == 0
