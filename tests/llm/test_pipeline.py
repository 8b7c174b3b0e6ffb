import corpus_pipeline
from talkgrain.llm import decontaminate
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert after.columns == corpus_pipeline.COLUMNS
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        if name == "near_dedup":
            assert after.count() == corpus_pipeline.near_duplicates(docs).where("kept").count()
        if name == "decontamination":
            gone = docs.join(after, "doc_id", "left_anti").select("doc_id")
            leaked = decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").distinct()
            assert gone.subtract(leaked).count() == 0 == leaked.subtract(gone).count()
        if name in ("language_id", "secret_scan"):
            assert after.count() == docs.count()
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_on_odd_rows_and_nothing(spark):
    for docs in (cases.odd(spark), cases.empty(spark)):
        docs = docs.select(corpus_pipeline.COLUMNS)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_stages_leave_clashing_columns_behind(spark):
    docs = cases.odd(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == corpus_pipeline.COLUMNS
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() >= docs.count() and dict(packed.dtypes)["length"] == "bigint"


def test_stages_decide_row_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    a, b, c = (cases.prose(i, 60) for i in (11, 12, 13))
    secret = "password=own8live99"
    texts = {
        "language_id": ([(None, "12 34 !!"), (None, a), (1, "!!"), (1, b)], [(None, a), (1, b)]),
        "near_dedup": ([(1, a), (1, a), (1, b), (2, b), (3, ""), (3, ""), (None, a), (None, c)], [(1, a), (1, b), (3, ""), (None, c)]),
        "decontamination": ([(None, item), (None, a), (1, f"{b} {item} {c}"), (1, b)], [(None, a), (1, b)]),
        "secret_scan": ([(None, f"x {secret} y"), (1, f"{a} {secret} y"), (1, b), (1, f"{secret} z")], [(None, "x [SECRET] y"), (1, f"{a} [SECRET] y"), (1, b), (1, "[SECRET] z")]),
    }
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given, want = texts[name]
        # a clear language for every text with a letter
        docs = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in given], cases.SCHEMA)
        after = stage(spark, docs, SF)
        assert after.columns == corpus_pipeline.COLUMNS
        assert sorted(cases.texts(after), key=key) == sorted(want, key=key), name
