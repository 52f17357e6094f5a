"""Plans whose cost a task or a row grows with the input: what they may not hold."""

from almoneda.hierarchy import cpv_ancestors
from almoneda.plans import testbind

D = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_codes_are_joined_with_their_ancestors_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(testbind, "TASK_PARTS", 500)
    codes = testbind.cpv_dim(spark, D)
    assert "Broadcast" not in plan(cpv_ancestors(codes)) and f", {-(-spark.read.parquet(f'{D}/part.parquet').count() // 500)})" in plan(codes)


def test_names_are_normalized_by_expressions_that_spark_compiles(spark):
    from almoneda.functions.scalar import LEGAL_FORMS, normalize_name

    def fold(text):
        words, out, opened = "".join(c if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789ÁÉÍÓÚÜÑ" else " " for c in text.upper()).split(), [], False
        for w in words:
            lone = len(w) == 1 and not w.isdigit()
            out = [*out[:-1], out[-1] + w] if lone and opened else [*out, w]
            opened = lone
        return " ".join([w for w in out if w not in LEGAL_FORMS] or out) or None

    texts = ["a b c", "S.L. a", "A 1 B C9", "sa", "Obras S. A. U. SL ñ é x.SL", "S L S A", "", " . ", "SLX COOP-SA B", "1 2 S,A", "UTE a.b UTE c"]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", normalize_name("x").alias("y"))
    assert "lambda" not in plan(df) and {r.x: r.y for r in df.collect()} == {x: fold(x) for x in texts}
    assert df.filter("y IS NULL").count() == 2


def test_postings_are_made_with_one_shuffle(spark, tmp_path):
    from pyspark.sql import functions as F

    from almoneda import postings
    from almoneda.search import n_tokens, tokens

    texts = ["a b a, a; B c", None, "", " , ", "b " * 9 + "İx ñ9", "c c a"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert docs.filter(F.size(tokens("text")) != n_tokens("text")).count() == 0
    found = {}
    for batch in (1, 7, 10_000):  # lists go on over batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            index = postings.Index(spark, str(tmp_path / str(batch)), range_docs=16).build(docs)
            posts = spark.read.parquet(f"{tmp_path}/{batch}/segments/*/postings").drop("segment").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len({(r.term, r.place) for r in posts}) == len(posts) and all(r.df == len(r.posts) and r.posts == sorted(r.posts) for r in posts)
        for r in posts:
            level = {}
            for p in r.posts:
                level.setdefault(p.tf.bit_length(), []).append(p)
            assert sorted((p.tf, p.dl) for p in r.peaks) == sorted((max(p.tf for p in x), min(p.dl for p in x)) for x in level.values())
        found[batch] = {(p.doc_id, r.term): p.tf for r in posts for p in r.posts}
        assert index.segments()[0][1] == len(texts)
    want = {}
    for k, ws in [(r.doc_id, r.ws) for r in docs.select("doc_id", tokens("text").alias("ws")).collect()]:
        for w in ws:
            want[k, w] = want.get((k, w), 0) + 1
    assert found == dict.fromkeys(found, want)
