from credence.operators.tfidf import fit_tfidf, transform_tfidf
from credence.plans import corpora
from credence.streaming.incremental import prepare_rows, process_available, read_new_files


def test_row_local_steps_accept_a_stream(spark, sf, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    docs = corpora.documents(spark, sf).drop("_ord")
    first, second = docs.where("subset = 'en'"), docs.where("subset <> 'en'")
    first.write.parquet(src)
    process_available(prepare_rows(read_new_files(spark, src)), out, ckpt)
    assert spark.read.parquet(out).count() == prepare_rows(first).count()
    second.write.mode("append").parquet(src)
    process_available(prepare_rows(read_new_files(spark, src)), out, ckpt)
    got = spark.read.parquet(out)
    assert sorted(map(str, got.collect())) == sorted(map(str, prepare_rows(docs).select(got.columns).collect()))

    model = fit_tfidf(docs, "text", max_features=50)
    process_available(
        transform_tfidf(read_new_files(spark, src), "id", "text", model), out + "_w", ckpt + "_w")
    assert spark.read.parquet(out + "_w").count() == transform_tfidf(docs, "id", "text", model).count()
