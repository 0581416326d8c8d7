"""The whole run: audit, clean, split, select, fit, evaluate.

``spark-submit reviewloom/plans/review_run.py REVIEWS OUTPUT [UNSEEN]``

Each stage writes a table under the output folder, and the next stage reads
it: lineage stays short, lost executors cost one stage at most, and the test
set is scored once for all reports. A run that has ended early goes on, when it
is started again, with the first stage that is not finished; see ``manifest``.
"""

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import audit, cleaning, metrics, models, scoring, splitting
from reviewloom.plans.manifest import Stages, table_digest
from reviewloom.session import drop_staged
from reviewloom.sources.reviews import read_reviews, validate_input
from reviewloom.sources.tables import load_pipeline, save_pipeline, write_report, write_table


def _score(df, model, settings):
    text = df.withColumn("_text", models.model_text(settings["text_option"], "raw"))
    return scoring.score_batch(
        text, model, "_text", text_mode=settings["text_mode"], with_probabilities=True
    ).drop("_text")


def clean(reviews: DataFrame) -> DataFrame:
    """Cleaned reviews; ids need not be unique."""
    return cleaning.clean_reviews(reviews)


def run_review_pipeline(
    reviews: DataFrame,
    output: str,
    unseen: DataFrame | None = None,
    seeds=range(42, 142),
    grid=models.EXPERIMENTS,
    text_mode="raw",
    **solver,
) -> dict[str, DataFrame]:
    """Run every stage and return the tables written.

    ``unseen``: ``review_text``, ``domain``, ``expected_sentiment`` and
    ``is_qualitative``; it must not share a text with the reviews.
    """
    spark = reviews.sparkSession
    stages = Stages(spark, output)
    stages.source("input", table_digest(validate_input(reviews)))
    # Read many times below: landed once, whatever the format of the source.
    reviews = stages.table("reviews", lambda: reviews, ["input"])
    stages.run("audit", lambda path: write_report(audit.audit_report(reviews), path), ["reviews"])
    tables = {
        "cleaning": stages.table("cleaning", lambda: cleaning.cleaning_report(reviews), ["reviews"]),
        "duplicates": stages.table(
            "duplicates", lambda: cleaning.duplicate_summary(cleaning.prepare_reviews(reviews)), ["reviews"]
        ),
    }
    cleaned = tables["cleaned"] = stages.table("cleaned", lambda: clean(reviews), ["reviews"])

    def split(path):
        labelled, seed, divergence = splitting.best_group_split(cleaned, seeds=seeds)
        write_table(labelled, path, partition_by=["split"])
        splitting.assert_no_leakage(spark.read.parquet(path))
        return {"seed": seed, "divergence": divergence}

    drawn = stages.run("splits", split, ["cleaned"], seeds=list(seeds))
    splits = tables["splits"] = stages.read("splits")
    tables["split_report"] = stages.table(
        "split_report",
        lambda: splitting.split_report(splits).withColumns({name: F.lit(drawn[name]) for name in ("seed", "divergence")}),
        ["splits"],
    )
    train, val, test = (splits.filter(F.col("split") == s) for s in splitting.SPLITS)

    fitting = {"grid": [repr(config) for config in grid], "text_mode": text_mode, **solver}
    results = tables["experiments"] = stages.table(
        "experiments", lambda: models.run_experiments(train, val, grid, text_mode, **solver), ["splits"], **fitting
    )

    def fit(path):
        best = models.select_best(results).first()
        model, settings = models.train_final(train, val, best, text_mode=text_mode, **solver)
        save_pipeline(model, path, **settings)

    stages.run("model", fit, ["splits", "experiments"], **fitting)
    model, settings = load_pipeline(spark, f"{output}/model")

    scored = tables["scored"] = stages.table("scored", lambda: _score(test, model, settings), ["splits", "model"])
    reports = {
        "report": metrics.classification_report,
        "confusion": metrics.confusion_matrix,
        "comparison": lambda rows: metrics.baseline_comparison(metrics.metric_values(rows)),
        "categories": metrics.domain_metrics,
    }
    for name, report in reports.items():
        tables[name] = stages.table(name, lambda report=report: report(scored), ["scored"])

    if unseen is not None:
        stages.source("unseen input", table_digest(unseen))

        def answer():
            metrics.assert_no_overlap(unseen, cleaned, "review_text")
            return scoring.score_batch(
                unseen, model, "review_text", text_mode=settings["text_mode"], with_probabilities=True
            )

        answers = tables["unseen"] = stages.table("unseen", answer, ["unseen input", "cleaned", "model"])
        tables["unseen_report"] = stages.table("unseen_report", lambda: metrics.unseen_benchmark(answers), ["unseen"])

    tables["parity"] = stages.table(
        "parity",
        lambda: metrics.parity_check(scored, _score(test, *load_pipeline(spark, f"{output}/model")), "review_id"),
        ["scored", "model"],
    )
    return tables


if __name__ == "__main__":
    session = SparkSession.builder.appName("review run").getOrCreate()
    source, target, *more = sys.argv[1:]
    unseen_schema = "domain string, expected_sentiment string, review_text string, is_qualitative boolean"
    run_review_pipeline(
        read_reviews(session, source),
        target,
        unseen=read_reviews(session, more[0], unseen_schema) if more else None,
    )
    drop_staged(session)
