"""The corpus pipeline as a whole, and its stages on odd tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c

ENGLISH = "the house is in the town and it was built by the people of the place who had come from the sea with their ships "
GERMAN = "das haus ist in der stadt und es wurde von den leuten gebaut die mit ihren schiffen von der see gekommen sind "


def table(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # Names that clash with results, one with a dot, and a type that can't be ordered.
    return d.withColumns({"source": F.lit("s"), "n": F.lit(1), "score": F.lit(2.0), "email": F.lit("x"), "__k0": F.lit(3)}).withColumn("a.b", F.lit(4)).withColumn("more", F.create_map(F.lit("k"), F.lit(1)))


def rows():
    words = [w for w in (ENGLISH + GERMAN).split()]
    # Texts without runs in common.
    text = lambda k: " ".join(words[(k * 7 + j * (k + 3)) % len(words)] + str(k) for j in range(60)) + (" " + ENGLISH if k % 2 else " " + GERMAN)
    out = [(k, text(k), "en" if k % 2 else "de") for k in range(30)]
    out += [(100, text(3), "en"), (101, text(3) + " end", "en"), (5, text(5), "en"), (7, text(41), "en"), (None, text(43), "en"), (None, text(45), None)]
    out += [(200, None, "en"), (201, "", None), (202, "123 456", "de"), (203, "bench " * 13 + "x", "en"), (204, "write to joe@x.org or +1 555 123 4567 " + ENGLISH, "en")]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("sf"))
    table(spark, rows()).write.parquet(f"{p}/documents.parquet")
    spark.createDataFrame([("b", "bench " * 13), ("n", None)], "item_id string, text string").write.parquet(f"{p}/benchmark.parquet")
    return p


def test_run(spark, folder):
    got = {r["doc_id"]: r for r in c.run(spark, folder).collect()}
    assert all(r["round_trip"] for r in got.values())
    assert {200, 201, 202, 203, 100, 101} & got.keys() == set()  # no language, contaminated, copies
    assert set(range(30)) <= got.keys() and 204 in got and None in got


def test_stages_keep_columns_and_rows(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        after = stage(spark, d, folder).cache()
        assert after.columns == d.columns and dict(after.dtypes) == dict(d.dtypes)
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in after.select("doc_id").collect()]
            assert sorted(i for i in ids if i is not None) == [*range(30), 203, 204] and ids.count(None) == 2
        if name == "personal_data":
            assert "joe@x.org" not in after.where("doc_id = 204").first()["text"]
        d = after


@pytest.mark.parametrize("stage", [f for _, f in c.STAGES])
def test_empty_tables(spark, folder, stage):
    assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet").limit(0), folder).count() == 0


def test_stages_leave_each_other_no_memory(monkeypatch):
    """A stage's task begins without the words that another stage's tasks keep in its worker, and gives memory back at its end."""
    from marlstone.llm import common, sentencepiece_viterbi

    ended = []
    monkeypatch.setattr(common, "give_back", lambda: ended.append(1))
    model = c.tokenizer_path("piece_bpe_32k.model")
    kept = sentencepiece_viterbi._codec(model)
    own = common.lean(lambda batches: (b + 1 for b in batches), forget=False)
    assert list(own(iter([1, 2]))) == [2, 3] and sentencepiece_viterbi._codec(model) is kept and len(ended) == 1
    other = common.lean(lambda batches: (b + 1 for b in batches))
    assert list(other(iter([]))) == [] and not sentencepiece_viterbi._CODECS and len(ended) == 2


def test_batches_are_worked_on_in_parts(spark):
    """More rows than a part has, of any text, keep their order and values."""
    rows = [(k, None if k % 7 == 0 else "" if k % 11 == 0 else f"{ENGLISH if k % 2 else GERMAN}{k}", "en" if k % 2 else "de") for k in range(2300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    ids = c.tokens(spark, d, "").collect()
    assert [r["doc_id"] for r in ids] == list(range(2300)) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in ids)
    assert all((r["n_tokens"] > 0) == bool(t) for r, (_, t, _) in zip(ids, rows))
    stays = c.language(spark, d, "").collect()
    assert [(r["doc_id"], r["text"]) for r in stays] == [(k, t) for k, t, _ in rows if t]
