"""Named queries over the given tables, one per operator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from credence.functions.text import clean_text, url_domain
from credence.operators import (
    classify, context, experiments, fusion, metrics, preprocess, profile, runs, split, tfidf,
)
from credence.plans import corpora
from credence.schema import COUNT_COLUMNS, ORDER
from credence.session import stage
from credence.sources import claims, reviews, snapshots



def _round(df: DataFrame, columns, digits=6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# ---- sources ----------------------------------------------------------------


def src_reviews_content_engagement(spark, d):
    labels = corpora.table(spark, d, "labels")
    docs = corpora.table(spark, d, "documents")
    news_id = F.col("doc_id").cast("string").alias("news_id")
    subset = F.lit("HealthStory").alias("subset")
    review_rows = labels.select(
        subset, news_id,
        (F.col("quality") * 4 + 1 - F.col("toxic")).cast("string").alias("rating"),
        F.when(F.col("toxic") == 1, "").otherwise("reviewer").alias("news_source"),
        F.lit("agency").alias("source"),
        F.col("doc_id").alias(ORDER),
    )
    content = docs.select(
        subset, news_id, F.substring_index("text", "\n", 1).alias("title"), "text"
    )
    counts = corpora.engagement(spark, d).select(
        subset, F.col("user_id").cast("string").alias("news_id"), *COUNT_COLUMNS
    )
    return reviews.assemble_reviews(review_rows, content, counts).drop(ORDER)


def src_snapshot_csv(spark, d):
    rows = corpora.table(spark, d, "pages").select(
        F.lit("News").alias("kind"),
        F.when(F.col("page_id") % 2 == 1, "Fake").otherwise("Real").alias("lab"),
        F.lit("05-01-2020").alias("snapshot"),
        F.col("page_id").cast("string").alias("row_id"),
        F.col("url").alias("news_url"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.when(F.col("url").startswith("https"), F.col("html")).alias("content"),
        F.col("url").alias("abstract"),
        F.when(F.col("url").startswith("https"), F.replace("url", F.lit("/"), F.lit("\t"))).alias("tweet_id"),
    )
    return snapshots.snapshot_rows(rows)


def src_claims_union(spark, d):
    items = corpora.table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("claim_id"), F.col("text").alias("claim"),
        F.col("text").alias("main_text"),
        F.when(F.col("item_id") % 3 == 0, "mixture").when(F.col("item_id") % 3 == 1, "true")
        .otherwise("false").alias("label"),
    )
    turns = corpora.table(spark, d, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("claim_id"), F.col("role").alias("claim"),
        F.col("text").alias("main_text"),
        F.when(F.col("role") == "user", "true").otherwise("unproven").alias("label"),
    )
    return claims.claim_rows(items.unionByName(turns))


def url_domain_query(spark, d):
    return corpora.table(spark, d, "pages").select("page_id", url_domain("url").alias("domain"))


def standardize(spark, d):
    return corpora.documents(spark, d).drop(ORDER)


def feature_metadata(spark, d):
    docs = corpora.documents(spark, d)
    text = tfidf.fit_tfidf(docs, "text")
    model = corpora.context_model(spark, d)
    masked = context.context_availability(docs, COUNT_COLUMNS)
    return runs.feature_metadata(text, model, masked)


def _ten_thousandths(c):
    scaled = F.transform(c, lambda v: F.round(v.cast("double") * 10000).cast("long").cast("string"))
    return F.array_join(scaled, ",")


def fusion_inputs(spark, d):
    return corpora.fusion_inputs(spark, d).select(
        "id", _ten_thousandths("text_features").alias("text_features"),
        F.concat_ws(
            "|", F.col("context_features.size").cast("string"), F.array_join("context_features.indices", ","),
            _ten_thousandths("context_features.values"),
        ).alias("context_features"),
        F.col("context_mask").cast("int").alias("context_mask"), "label", "domain_label",
    )


# ---- cleaning, de-duplication, splits ---------------------------------------


def handle_missing(spark, d):
    return preprocess.handle_missing(corpora.documents(spark, d)).select(
        "id", "title", "text", "label", "source"
    )


def clean_pages(spark, d):
    return corpora.texts(spark, d, "pages").select("page_id", clean_text("html").alias("text"))


def text_stats_basic(spark, d):
    return preprocess.add_text_stats(corpora.texts(spark, d, "documents")).select(
        "doc_id", "text_len", "word_count"
    )


def dedup_id(spark, d):
    """Events as a table with many rows per user: the first event of each user."""
    events = corpora.table(spark, d, "events")
    return preprocess.keep_first(events, "user_id", "event_id").select(
        "user_id", "event_id", "event_type", "value"
    )


def dedup_text(spark, d):
    docs = corpora.documents(spark, d)
    return preprocess.remove_duplicates(docs).select("id", "subset", F.md5("text").alias("text_md5"))


def pipeline_counts(spark, d):
    return preprocess.pipeline_counts(corpora.documents(spark, d))


def preprocess_dataset(spark, d):
    return preprocess.preprocess_dataset(corpora.documents(spark, d)).select(
        "id", "label", "split", "text_len", "word_count", "n_tweets", "has_engagement"
    )


def _processed(spark, d, corpus=corpora.documents):
    """Cleaned, de-duplicated labelled documents with text statistics, written once:
    what follows reads it several times."""
    rows, _ = preprocess.clean_and_deduplicate(corpus(spark, d))
    return stage(rows.drop(ORDER, "split"), "processed")


def _processed_all(spark, d):
    """The processed rows of every corpus."""
    parts = [_processed(spark, d, c) for c in (corpora.documents, corpora.pages, corpora.benchmark)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def split_70_15_15(spark, d):
    return split.split_dataset(_processed(spark, d)).select("id", "label", "split")


def _split_60(spark, d):
    """The processed rows with their part, written once for all that reads them."""
    rows = split.split_labeled_data(
        _processed(spark, d), text_column="text", label_column="label"
    )
    return stage(rows, "split")


def split_60_20_20(spark, d):
    return _split_60(spark, d).select("id", "label", "split")


def split_label_pivot(spark, d):
    return profile.split_label_pivot(split.split_dataset(_processed(spark, d)))


def contract_checks(spark, d):
    return split.contract_checks(corpora.documents(spark, d), "text", "label")


def preview(spark, d):
    return profile.preview(corpora.documents(spark, d)).select("id", "subset", "title", "label")


# ---- profiles and distributions ---------------------------------------------


def profile_missing(spark, d):
    return profile.profile_missing(corpora.documents(spark, d))


def profile_duplicates(spark, d):
    return profile.profile_duplicates(corpora.documents(spark, d))


def profile_labels(spark, d):
    return profile.profile_labels(corpora.documents(spark, d))


def profile_context(spark, d):
    return profile.profile_context(corpora.documents(spark, d))


def inspect(spark, d):
    return profile.inspect_dataframe(corpora.all_corpora(spark, d), "all")


def class_distribution(spark, d):
    """Of the processed rows of all corpora; labels and keys tell which rows these are, so no text is written."""
    parts = [
        preprocess.first_occurrences(preprocess.handle_missing(c(spark, d)), extra=("dataset", "label"))
        for c in (corpora.documents, corpora.pages, corpora.benchmark)
    ]
    return _round(profile.class_distribution(parts[0].unionByName(parts[1]).unionByName(parts[2])), ["share"])


def describe_by_label(spark, d):
    out = profile.describe_by_label(_processed(spark, d))
    return _round(out, ["mean", "std", "min", "q25", "q50", "q75", "max"])


def clip_p99(spark, d):
    return profile.clip_tail(_processed(spark, d), "word_count").select("id", "word_count")


def hist_by_label(spark, d):
    return profile.hist_by_label(_processed(spark, d), "text_len")


def hist_engagement(spark, d):
    return profile.hist_engagement(_processed(spark, d))


def describe_by_dataset(spark, d):
    out = profile.describe_by_label(_processed_all(spark, d), by=["dataset", "label"])
    return _round(out, ["mean", "std", "min", "q25", "q50", "q75", "max"])


def hist_by_dataset(spark, d):
    """Each dataset clipped and binned on its own range."""
    return profile.hist_by_label(_processed_all(spark, d), "word_count", by=["dataset"])


def context_availability(spark, d):
    return profile.profile_context(_processed_all(spark, d), by=["dataset"])


def mask_counts(spark, d):
    masked = context.context_availability(corpora.documents(spark, d), COUNT_COLUMNS)
    return _round(profile.mask_counts(masked), ["pct"]).withColumn(
        "context_available", F.col("context_available").cast("int")
    )


def class_weights(spark, d):
    train = _split_60(spark, d).where("split = 'train'")
    return _round(classify.class_weights(train), ["weight"])


# ---- text features ----------------------------------------------------------


def text_statistics(spark, d):
    out = tfidf.extract_text_statistics(corpora.texts(spark, d, "documents"), "text")
    names = [c for c in out.columns if c.startswith("text_")]
    return _round(out.select("doc_id", *names), names)


def text_statistics_pages(spark, d):
    out = tfidf.extract_text_statistics(corpora.texts(spark, d, "pages"), "html")
    names = [c for c in out.columns if c.startswith("text_")]
    return _round(out.select("page_id", *names), names)


def tfidf_terms(spark, d):
    return tfidf.count_terms(corpora.texts(spark, d, "documents"), "doc_id", "text")


def tfidf_vocab(spark, d):
    model = tfidf.fit_tfidf(corpora.texts(spark, d, "documents"), "text")
    return _round(model.vocabulary(spark), ["idf"])


def tfidf_vocab_min_df(spark, d):
    model = tfidf.fit_tfidf(
        corpora.texts(spark, d, "documents"), "text", max_features=1000, min_df=0.05,
        ngram_range=(1, 1),
    )
    return _round(model.vocabulary(spark), ["idf"])


def tfidf_weights(spark, d):
    docs = corpora.texts(spark, d, "documents")
    model = tfidf.fit_tfidf(docs, "text")
    return _round(tfidf.transform_tfidf(docs, "doc_id", "text", model), ["weight"], 5)


def tfidf_joined(spark, d):
    """The weights of ``tfidf_weights`` from a joined vocabulary of any size."""
    docs = corpora.texts(spark, d, "documents")
    vocabulary, n = tfidf.fit_vocabulary(docs, "text")
    counts = tfidf.count_terms(docs, "doc_id", "text")
    return _round(tfidf.weigh_terms(counts, "doc_id", stage(vocabulary, "vocabulary"), n), ["weight"], 5)


def tfidf_transform(spark, d):
    rows = _split_60(spark, d)
    model = tfidf.fit_tfidf(rows.where("split = 'train'"), "text")
    held_out = rows.where("split = 'test'")
    return _round(tfidf.transform_tfidf(held_out, "id", "text", model), ["weight"], 5)


def leakage_check(spark, d):
    """Vocabulary terms by where they occur: none may be missing from training."""
    rows = _split_60(spark, d)
    train, held_out = rows.where("split = 'train'"), rows.where("split <> 'train'")
    vocabulary = tfidf.fit_tfidf(train, "text").vocabulary(spark).select("term")

    def terms_of(frame, flag):
        terms = tfidf.count_terms(frame, "id", "text").select("term").distinct()
        return terms.withColumn(flag, F.lit(1))

    found = vocabulary.join(terms_of(train, "in_train"), "term", "left").join(
        terms_of(held_out, "in_held_out"), "term", "left"
    )
    return found.agg(
        F.count("*").alias("vocabulary_terms"),
        F.count_if(F.col("in_train").isNull()).alias("not_in_train"),
        F.count_if(F.col("in_held_out").isNotNull()).alias("also_held_out"),
    )


# ---- context features -------------------------------------------------------


def context_mask(spark, d):
    out = context.context_availability(
        corpora.documents(spark, d), [*COUNT_COLUMNS, "source", "label_raw"]
    )
    return _round(out, ["context_availability_fraction"], 4).select(
        "id", F.col("context_available").cast("int").alias("context_available"),
        "context_availability_fraction",
    )


def context_numeric(spark, d):
    out = context.context_numeric(
        corpora.documents(spark, d), "id", corpora.context_model(spark, d)
    )
    return _round(out, ["value"])


def context_onehot(spark, d):
    return context.context_onehot(
        corpora.documents(spark, d), "id", corpora.context_model(spark, d)
    )


def context_features_long(spark, d):
    _, out = context.fit_context_features(
        corpora.documents(spark, d), "id",
        numeric_columns=corpora.CONTEXT_NUMERIC, categorical_columns=corpora.CONTEXT_CATEGORICAL,
    )
    return _round(out, ["value"])


def context_transform(spark, d):
    """Fitted on labelled documents, applied to the unlabelled ones."""
    docs = corpora.documents(spark, d)
    model = context.fit_context(
        docs.where("label is not null"),
        numeric_columns=corpora.CONTEXT_NUMERIC, categorical_columns=corpora.CONTEXT_CATEGORICAL,
    )
    return _round(context.transform_context(docs.where("label is null"), "id", model), ["value"])


# ---- metrics on a deterministic score ---------------------------------------

SCORES = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def binary_metrics(spark, d):
    out = metrics.binary_metrics(corpora.hash_predictions(spark, d))
    return _round(out, [*SCORES, "average_precision"])


def roc_points(spark, d):
    return _round(metrics.roc_points(corpora.hash_predictions(spark, d)), ["fpr", "tpr"])


def pr_points(spark, d):
    return _round(metrics.pr_points(corpora.hash_predictions(spark, d)), ["precision", "recall"])


def roc_auc(spark, d):
    return _round(
        metrics.roc_auc(corpora.hash_predictions(spark, d), by=["context_mask"]), ["roc_auc"]
    )


def avg_precision(spark, d):
    return _round(
        metrics.average_precision(corpora.hash_predictions(spark, d), by=["context_mask"]),
        ["average_precision"],
    )


def confusion(spark, d):
    return metrics.confusion(corpora.hash_predictions(spark, d), [0, 1])


def weighted_metrics(spark, d):
    return _round(metrics.weighted_metrics(corpora.hash_predictions(spark, d), score="score"), SCORES)


def class_report(spark, d):
    out = metrics.class_report(corpora.hash_predictions(spark, d))
    return _round(out, ["precision", "recall", "f1"])


def _two_models(spark, d):
    first = corpora.hash_predictions(spark, d).select("id", "label", "score", "prediction")
    second = first.withColumn("score", corpora.hash_score(F.concat(F.col("id"), F.lit("#2"))))
    second = second.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return first.withColumn("model", F.lit("A")).unionByName(second.withColumn("model", F.lit("B")))


def model_comparison(spark, d):
    out = experiments.model_comparison(_two_models(spark, d))
    return _round(out, [*SCORES, "average_precision"])


def missing_context(spark, d):
    out = experiments.missing_context(corpora.hash_predictions(spark, d))
    return _round(out, ["context_available", "context_missing"])


def final_metrics(spark, d):
    return _round(experiments.final_metrics(corpora.hash_predictions(spark, d)), SCORES)


def exp_c_compare(spark, d):
    both = _two_models(spark, d)
    ours = metrics.weighted_metrics(both.where("model = 'A'"), score="score")
    base = metrics.binary_metrics(both.where("model = 'B'"))
    out = experiments.compare_with_baseline(
        experiments.metrics_long(ours, experiments.WEIGHTED),
        experiments.metrics_long(base, metrics.METRICS),
    )
    return _round(out, ["model", "baseline"])


# ---- models -----------------------------------------------------------------


def _baseline(spark, d, build):
    rows = _split_60(spark, d)
    model = build().fit(rows.where("split = 'train'"))
    scored = model.predict(rows.where("split = 'test'").select("id", "text", "label"))
    return _round(scored.select("id", "label", "prediction", "score"), ["score"], 4)


def baseline_predictions(spark, d):
    return _baseline(spark, d, classify.build_baseline)


def balanced_predictions(spark, d):
    return _baseline(spark, d, classify.build_balanced_baseline)


def imbalance_experiment(spark, d):
    return _round(
        experiments.imbalance_experiment(_split_60(spark, d)), [*SCORES, "average_precision"]
    )


def zero_shot_metrics(spark, d):
    """A baseline fitted on documents, scored on the two other corpora."""
    train = _processed(spark, d)
    model = classify.build_baseline().fit(train)
    target = corpora.pages(spark, d).unionByName(corpora.benchmark(spark, d))
    target = preprocess.handle_missing(target).select("id", "dataset", "text", "label")
    return _round(experiments.zero_shot_metrics(model.predict(target)), SCORES)


def rule_weights(shape: fusion.FusionShape) -> np.ndarray:
    """Small weights from a rule, so that SQL can compute the same network."""
    parts = []
    for layer, (fan_in, fan_out) in enumerate(shape.layers().values()):
        i, j = np.meshgrid(np.arange(fan_in + 1), np.arange(fan_out), indexing="ij")
        parts.append((((i * 7 + j * 13 + layer * 5) % 11 - 5) / (10.0 * np.sqrt(fan_in))).ravel())
    return np.concatenate(parts)


def _rule_model(inputs):
    dims = inputs.select(
        F.size("text_features").alias("t"), F.col("context_features.size").alias("c")
    ).first()
    shape = fusion.FusionShape(
        dims["t"], dims["c"], domain_hidden=fusion.CONFIG["hidden_dim"] // 2
    )
    return fusion.FittedFusion(shape, rule_weights(shape))


def _staged_inputs(spark, d):
    """The model input table, written once and read by every later step."""
    return stage(corpora.fusion_inputs(spark, d), "fusion-inputs")


def _scored(spark, d):
    inputs = _staged_inputs(spark, d)
    return _rule_model(inputs).domain_scores(inputs)


def gated_scores(spark, d):
    out = _scored(spark, d).select(
        "id", "context_mask", "gate", F.col("logits")[0].alias("logit_0"),
        F.col("logits")[1].alias("logit_1"), "prediction", "score",
    )
    out = out.withColumn("context_mask", F.col("context_mask").cast("int"))
    return _round(out, ["gate", "logit_0", "logit_1", "score"], 5)


def gate_stats(spark, d):
    out = profile.gate_stats(_scored(spark, d)).withColumn(
        "context_mask", F.col("context_mask").cast("int")
    )
    return _round(out, ["mean", "std", "min", "max"], 5)


def gate_hist(spark, d):
    rounded = _round(_scored(spark, d), ["gate"], 6)
    return profile.gate_hist(rounded).withColumn("context_mask", F.col("context_mask").cast("int"))


def feature_contract(spark, d):
    """The input table with rows broken by the first digit of their id's digest."""
    inputs = _staged_inputs(spark, d)
    shape = _rule_model(inputs).shape
    digit = F.substring(F.md5("id"), 1, 1)
    text, context_ = F.col("text_features"), F.col("context_features")
    broken = inputs.withColumns(
        {
            "text_features": F.when(digit == "1", F.slice(text, 1, shape.text_dim - 1)).when(digit != "0", text),
            "context_features": F.when(digit == "2", context_.withField("size", 2 * context_["size"])).otherwise(context_),
            "context_mask": F.when(digit == "3", 2).otherwise(F.col("context_mask")),
            "label": F.when(digit == "4", None).otherwise(F.col("label")),
        }
    )
    return fusion.feature_contract(broken, shape.text_dim, shape.context_dim)


def forward_metrics(spark, d):
    """Loss, accuracy and F1 that training computes after an epoch, at the rule weights."""
    inputs = _staged_inputs(spark, d)
    model = _rule_model(inputs)
    cells = fusion.validation_counts(inputs, model.shape, spark.sparkContext.broadcast(model.params))
    return _round(fusion.validation_summary(cells), ["loss", "accuracy", "f1"], 5)


def domain_scores(spark, d):
    return _round(_scored(spark, d).select("id", "domain_label", "domain_score"), ["domain_score"], 5)


def domain_bce(spark, d):
    return _round(fusion.domain_bce(_scored(spark, d)), ["loss"], 5)


def _fusion_split(spark, d):
    inputs = _staged_inputs(spark, d)
    return split.split_labeled_data(
        inputs.withColumn("text", F.lit("features")), text_column="text", label_column="label"
    )


def _train(spark, d, rows, **options):
    train = rows.where("split = 'train'")
    dims = train.select(
        F.size("text_features").alias("t"), F.col("context_features.size").alias("c")
    ).first()
    shape = fusion.FusionShape(
        dims["t"], dims["c"], domain_hidden=options.pop("domain_hidden", 0)
    )
    return fusion.train_fusion(
        train, rows.where("split = 'validation'"), shape, **options
    )


def fusion_history(spark, d):
    _, history = _train(spark, d, _fusion_split(spark, d))
    return history


def fusion_final_metrics(spark, d):
    rows = _fusion_split(spark, d)
    model, _ = _train(spark, d, rows)
    return experiments.final_metrics(model.score(rows.where("split = 'test'")))


def domain_history(spark, d):
    """Adversarial training: English source rows, other languages as target."""
    rows = _fusion_split(spark, d)
    config = fusion.CONFIG
    _, history = _train(
        spark, d, rows, domain_hidden=config["hidden_dim"] // 2,
        adversarial_lambda=config["domain_lambda"],
    )
    return history


def fusion_zero_shot(spark, d):
    """Trained on source-domain rows, scored on the target domain."""
    rows = _fusion_split(spark, d)
    model, _ = _train(spark, d, rows.where("domain_label = 0"))
    target = rows.where("domain_label = 1")
    return experiments.zero_shot_metrics(model.score(target), by=["domain_label"])


QUERIES = {
    f.__name__: f
    for f in (
        src_reviews_content_engagement, src_snapshot_csv, src_claims_union, standardize,
        feature_metadata, fusion_inputs, handle_missing, clean_pages, text_stats_basic, dedup_id,
        dedup_text, pipeline_counts, preprocess_dataset, split_70_15_15, split_60_20_20,
        split_label_pivot, contract_checks, preview, profile_missing, profile_duplicates,
        profile_labels, profile_context, inspect, class_distribution, describe_by_label, describe_by_dataset,
        hist_by_dataset, clip_p99,
        hist_by_label, hist_engagement, context_availability, mask_counts, class_weights,
        text_statistics, text_statistics_pages, tfidf_terms, tfidf_vocab, tfidf_vocab_min_df,
        tfidf_weights, tfidf_joined, tfidf_transform, leakage_check, context_mask, context_numeric,
        context_onehot, context_features_long, context_transform, binary_metrics, roc_points,
        pr_points, roc_auc, avg_precision, confusion, weighted_metrics, class_report,
        model_comparison, missing_context, final_metrics, exp_c_compare, baseline_predictions,
        balanced_predictions, imbalance_experiment, zero_shot_metrics, gated_scores, gate_stats,
        gate_hist, feature_contract, domain_scores, domain_bce, forward_metrics,
        fusion_history,
        fusion_final_metrics, domain_history, fusion_zero_shot,
    )
}
QUERIES["url_domain"] = url_domain_query


def flagship(spark, d) -> DataFrame:
    """Rows, share and mean words per split and label of the processed corpus."""
    done = preprocess.preprocess_dataset(corpora.documents(spark, d))
    return done.groupBy("split", "label").agg(
        F.count("*").alias("n"), F.round(F.avg("word_count"), 6).alias("mean_words")
    )


QUERIES["flagship"] = flagship
