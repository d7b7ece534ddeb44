"""The pipeline's stages over odd rows, each by itself, and the whole against plain Python."""

import public_tokenizers
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tessera.llm import pieces, quality
from tests.llm import brute
from tests.llm.test_jaccard import by_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean, component_id long, _hit int, found string"


def stored(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def good():
    ids = {r["doc_id"] for r in stored("labels") if r["quality"] == 1}
    texts = [r["text"] for r in stored("documents") if r["doc_id"] in ids]
    items = [r["text"] for r in stored("benchmark")]
    return [t for t in texts if not brute.quality(t)[5] and not any(x in t for x in items) and not brute.secrets(t)[4]][:12]


@pytest.fixture(scope="module")
def docs(spark, good):
    item = stored("benchmark")[0]["text"]
    texts = [None, "", " \n", *good, good[0], good[1] + f" {item} " + good[2], good[3] + " password = abcdefgh1234 end", "\n".join(good) + " own words " * 4 + " ".join(f"u{k}" for k in range(100_000))]
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[4]), (None, f"{good[4]} {item}"), (7, "other text of that id")]
    return spark.createDataFrame([(i, t, "en", "s", 1, "r", False, 3, 1, "f") for i, t in rows], SCHEMA).repartition(3).cache()


def got(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_over_odd_rows(spark, docs, good):
    rows = got(docs)
    names = docs.columns
    good_rows = corpus_pipeline.keep_good(spark, docs, SF)
    assert good_rows.columns == names
    kept = got(good_rows)
    verdicts = quality.quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()
    assert kept and sorted((i for i, _ in kept), key=repr) == sorted((r["doc_id"] for r in verdicts), key=repr)
    assert all(not brute.quality(t)[5] for _, t in kept) and [r for r in kept if r in rows] == kept

    one = corpus_pipeline.keep_one_of_group(spark, docs, SF)
    assert one.columns == names
    lowest = {i: c for i, _, c in by_rows(rows, 5, 80)}
    want = {(i, t) for i, t in rows if i is not None and lowest[i] == i}
    assert 3 + len(good) not in {i for i, _ in want}  # the copy of good[0]
    assert got(one) == sorted([*want, *(r for r in rows if r[0] is None)], key=repr)

    clean = corpus_pipeline.drop_benchmarks(spark, docs, SF)
    item = stored("benchmark")[0]["text"]
    assert clean.columns == names and got(clean) == [r for r in rows if item not in (r[1] or "")]

    safe = corpus_pipeline.redact_secrets(spark, docs, SF)
    assert safe.columns == names and all(r["n_chars"] == len(r["text"]) for r in safe.collect())
    want = [(i, (t or "").replace("password = abcdefgh1234", "[REDACTED]")) for i, t in rows]
    assert got(safe) == sorted(want, key=repr)

    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    out = corpus_pipeline.encode(spark, docs, SF).collect()
    assert sorted(((r["doc_id"], model.decode(r["ids"])) for r in out), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_stages_over_no_rows(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.encode(spark, docs.limit(0), SF).count() == 0
