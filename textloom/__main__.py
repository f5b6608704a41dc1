"""The jobs from the command line: python -m textloom preprocess | sentence-model | pretrain | train."""

from __future__ import annotations

import argparse
import sys

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PRESETS, preset
from .operators import embeddings
from .plans import pipelines
from .sources import tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, about: str) -> argparse.ArgumentParser:
        p = jobs.add_parser(name, help=about, description=about)
        p.add_argument("--preset", choices=sorted(PRESETS), default="reviews")
        p.add_argument("--output", required=True, help="folder to write, as Parquet")
        return p

    p = job("preprocess", "Tokens and labels of delimited files.")
    p.add_argument("--labeled", nargs="*", default=[], help="files or patterns with labels")
    p.add_argument("--unlabeled", nargs="*", default=[], help="files or patterns without labels")
    p.add_argument("--sentences", action="store_true", help="split texts into sentences")
    p.add_argument("--model", help="folder of a sentence model")
    p.add_argument("--sample-labeled", type=int, help="rows of each class")
    p.add_argument("--sample-unlabeled", type=int, help="rows without a label")
    p.add_argument("--seed", type=int, default=0)
    p = job("sentence-model", "A sentence model of the texts of delimited files.")
    p.add_argument("--input", nargs="+", required=True)
    p.add_argument("--least", type=int, default=1, help="types seen less often keep no context")
    p = job("pretrain", "Word vectors of preprocessed sentences.")
    p.add_argument("--input", required=True)
    p.add_argument("--algorithm", choices=("word2vec", "glove"))
    p.add_argument("--embedding", choices=("word2vec", "doc2vec"))
    p.add_argument("--size", type=int, help="dimensions")
    p.add_argument("--limit", type=int, help="documents")
    p.add_argument("--workers", type=int, default=1)
    p = job("train", "A classifier of preprocessed sentences, with its search, report and ROC curve.")
    p.add_argument("--input", required=True)
    p.add_argument("--vectors", help="folder of word vectors")
    p.add_argument("--classifier", choices=("lr", "svm", "random_forest", "boost"))
    p.add_argument("--features", nargs="+", choices=("bow", "embedding"))
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--sample-labeled", type=int, help="rows of each class; 0 for all")
    return top


def _files(spark: SparkSession, paths: list[str], options: dict) -> DataFrame | None:
    return tables.read_delimited(spark, paths, **options) if paths else None


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("doc", F.monotonically_increasing_id())


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    config = preset(args.preset)
    if args.job == "preprocess":
        own = config["preprocess"] | {"random_state": args.seed}
        if args.sample_labeled is not None:
            own["sample_labeled"] = {0: args.sample_labeled, 1: args.sample_labeled}
        if args.sample_unlabeled is not None:
            own["sample_unlabeled"] = args.sample_unlabeled
        config["preprocess"] = own
        model = pipelines.load_sentence_model(spark, args.model) if args.model else None
        read = [_files(spark, p, config["data"]["options"]) for p in (args.labeled, args.unlabeled)]
        _keyed(pipelines.preprocess(*read, config, as_sentences=args.sentences, model=model)).write.mode("overwrite").parquet(args.output)
    elif args.job == "sentence-model":
        rows = tables.project_fields(_files(spark, args.input, config["data"]["options"]), {"X": config["data"]["labeled"]["X"]})
        learned = pipelines.learn_sentence_model(rows, config["tokenizer"], least=args.least)
        learned.save(args.output)
        learned.release()
    elif args.job == "pretrain":
        config["pretrain"] |= {k: v for k, v in (("algorithm", args.algorithm), ("embedding", args.embedding)) if v}
        for name in ("word2vec", "doc2vec", "glove"):
            config[name] |= {"size": args.size} if args.size else {}
        embeddings.save(pipelines.pretrain(spark.read.parquet(args.input), config, limit=args.limit, workers=args.workers), args.output)
    else:
        own = {"classifier": args.classifier, "features": args.features and tuple(args.features)}
        config["train"] |= {k: v for k, v in own.items() if v}
        if args.sample_labeled is not None:
            config["train"]["sample_labeled"] = {0: args.sample_labeled, 1: args.sample_labeled} if args.sample_labeled else None
        vectors = embeddings.load(spark, args.vectors) if args.vectors else None
        out = pipelines.train(spark.read.parquet(args.input), config, vectors, folds=args.folds)
        for name in ("search", "report", "roc", "auc"):
            getattr(out, name).write.mode("overwrite").parquet(f"{args.output}/{name}")
        for i, stage in enumerate(out.model.bestModel.stages):  # fitted stages; those that only make columns have nothing to keep
            if isinstance(stage, MLWritable):
                stage.write().overwrite().save(f"{args.output}/stage-{i}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    run(args, spark or SparkSession.builder.appName(f"textloom {args.job}").getOrCreate())
    return 0


if __name__ == "__main__":
    sys.exit(main())
