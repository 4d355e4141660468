import corpus_pipeline
from tidemark.llm._common import written
from tidemark.llm import decontam, jaccard, language, substrings

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    kept = written(corpus_pipeline.identify_language(spark, docs, SF), "t")
    assert kept.columns == docs.columns
    assert ids(kept) == ids(language.identify(docs, language.fit(docs)).filter("not rejected"))
    one = written(corpus_pipeline.drop_near_duplicates(spark, kept, SF), "t")
    assert ids(one) == ids(jaccard.jaccard_join(kept).filter("doc_id = component_id")) and one.count() < kept.count()
    cut = written(corpus_pipeline.cut_repeated_substrings(spark, one, SF), "t")
    assert ids(cut) == ids(one)
    left = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in substrings.dedup(one).collect()}
    assert all(abs(len(r["text"].encode()) - left[r["doc_id"]]) <= 3 * 8 and r["n_chars"] == len(r["text"]) for r in cut.collect())
    clean = written(corpus_pipeline.decontaminate(spark, cut, SF), "t")
    assert ids(clean) == sorted(set(ids(cut)) - set(ids(decontam.contaminated(cut, bench))))
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, clean, SF).collect()} == set(ids(clean))


def test_stages_on_hard_cases(spark, hard):
    docs = hard
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == hard.columns
    assert corpus_pipeline.pack(spark, docs, SF).count() >= docs.count()


def test_near_duplicates_go_by_row(spark):
    """One row of each group stays: with repeated rows, texts without doc_id, and unlike texts under one doc_id."""
    import random

    r = random.Random(3)
    a, b, c, d = ([f"w{r.randrange(10**6)}" for _ in range(50)] for _ in range(4))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (5, near(a)), (5, " ".join(b)), (6, " ".join(c)), (6, " ".join(c)), (7, near(c)), (None, " ".join(d)), (None, near(d)), (8, None), (8, None), (None, ""), (9, "?")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, part string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    left = [x for x in got if x != (None, " ".join(d)) and x != (None, near(d))]
    assert left == sorted([(1, " ".join(a)), (5, " ".join(b)), (6, " ".join(c)), (8, None), (8, None), (None, ""), (9, "?")], key=str) and len(got) == len(left) + 1


def test_stages_on_an_empty_table(spark, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_lean_functions_give_the_same():
    from tidemark.llm._common import lean

    def stream(batches):
        for b in batches:
            yield b + 1

    def group(t):
        return t * 2

    def both(key, left, right):
        return key, left + right

    assert list(lean(stream)([1, 2])) == [2, 3] and lean(group)(4) == 8 and lean(both)("k", 1, 2) == ("k", 3)
