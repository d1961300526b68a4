"""Command line over files: ``python -m compoundry.cli <command> INPUT OUTPUT_PREFIX``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet folders or files, else a delimited table with typed columns."""
    from compoundry.sources.files import detect_format, read_delimited

    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if detect_format(path) not in ("csv", "tsv"):
        raise ValueError(f"not a table: {path}")
    return read_delimited(spark, path)


def curate(spark, args):
    from compoundry.operators.binding import bind_columns
    from compoundry.operators.curation import CurationConfig, curate as run
    from compoundry.sources.sinks import write_curation

    df = read_any(spark, args.input)
    if "row_index" not in df.columns:
        # an order that does not follow the layout of the files: by the row's content
        df = df.withColumn("row_index", F.xxhash64(*df.columns))
    found = bind_columns(df, "row_index")
    pick = lambda role: getattr(args, role, None) or found[role]
    if not pick("smiles") or not pick("activity"):
        raise SystemExit("No structure or activity column found; name them.")
    cfg = CurationConfig(smiles=pick("smiles"), activity=pick("activity"), name=found["name"], unit=pick("unit"), relation=found["relation"],
                         endpoint=found["endpoint"], target_endpoint=args.endpoint, aggregation=args.aggregation,
                         relation_policy="allow_inequalities" if args.inequalities else "exact_only")
    return write_curation(run(df, cfg), args.output, args.format)


def import_file(spark, args):
    from compoundry.operators.intake import import_summary, import_summary_rows
    from compoundry.sources.files import import_molecules
    from compoundry.sources.sinks import write_tables

    rows = import_molecules(spark, args.input, reject_duplicates=args.reject_duplicates)
    return write_tables({"accepted": rows.where("accepted"), "rejected": rows.where("not accepted"),
                         "summary": import_summary_rows(import_summary(rows))}, args.output, args.format)


def qc(spark, args):
    from compoundry.chem import facts, kernels
    from compoundry.operators import quality
    from compoundry.sources.files import import_molecules
    from compoundry.sources.sinks import write_tables

    rows = import_molecules(spark, args.input).select("row_index", "name", "smiles")
    parsed = facts.facts(facts.with_structure(rows, "smiles")).drop("mol")
    out = quality.quality_control(parsed.withColumn("duplicate_key", F.coalesce(kernels.canonical(F.col("smiles")), F.lit(""))))
    parts = {p: quality.partition(out, p) for p in ("clean", "problem", "rejected")}
    return write_tables({**parts, "summary": quality.quality_summary_rows(out)}, args.output, args.format)


def descriptors(spark, args):
    from compoundry.operators.descriptors import FilterConfig, filter_descriptors
    from compoundry.operators.models import usable_features
    from compoundry.sources.sinks import write_tables

    df = numeric(read_any(spark, args.input))
    cols = usable_features(df, args.target or "_none", args.ident, 0.0, False)
    res = filter_descriptors(df, cols, FilterConfig(target=args.target or ""))
    return write_tables({"filtered": res.data, "filter_report": res.report}, args.output, args.format)


def numeric(df: DataFrame) -> DataFrame:
    """Text columns that hold only numbers become numbers."""
    from compoundry.operators.profile import infer_roles, with_roles

    return with_roles(df, infer_roles(df))


def train(spark, args):
    from compoundry.operators import models
    from compoundry.sources.sinks import write_tables

    res = models.train(numeric(read_any(spark, args.input)), args.target, args.ident, args.model)
    models.save_model(res.model, f"{args.output}.model")
    return write_tables({"predictions": res.predictions, "metrics": res.metrics}, args.output, args.format, res.summary)


def validate(spark, args):
    from compoundry.operators import validation
    from compoundry.sources.sinks import write_tables

    d = validation.residual_diagnostics(read_any(spark, args.input))
    return write_tables({"validation_metrics": validation.metrics_by_split(d), "residual_diagnostics": d, "outliers": validation.outliers(d),
                         "validation_summary": validation.validation_summary(d)}, args.output, args.format)


def domain(spark, args):
    from compoundry.operators import domain as dom
    from compoundry.sources.sinks import write_tables

    ref = numeric(read_any(spark, args.reference))
    query = numeric(read_any(spark, args.input))
    cfg = dom.DomainConfig(use_mahalanobis=True)
    fit = dom.fit_domain(ref, dom.shared_columns(ref, query), cfg)
    out = dom.explain_domain(dom.score_domain(fit, query), cfg)
    return write_tables({"ad_results": out, "out_of_domain": out.where("not in_ad"), "ad_summary": dom.domain_summary(fit, out)}, args.output, args.format)


def report(spark, args):
    from compoundry.operators.reporting import build_report, write_report

    opt = lambda p: read_any(spark, p) if p else None
    return write_report(build_report(numeric(read_any(spark, args.input)), opt(args.metrics), opt(args.predictions), opt(args.domain)), args.output)


COMMANDS = {"curate": curate, "import": import_file, "qc": qc, "descriptors": descriptors, "train": train, "validate": validate,
            "domain": domain, "report": report}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="compoundry")
    parser.add_argument("command", choices=list(COMMANDS))
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--format", default="csv")
    for name in ("smiles", "activity", "unit", "target", "reference", "metrics", "predictions", "domain"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--endpoint", default="")
    parser.add_argument("--aggregation", default="median")
    parser.add_argument("--ident", default="compound_id")
    parser.add_argument("--model", default="ridge")
    parser.add_argument("--inequalities", action="store_true")
    parser.add_argument("--reject-duplicates", action="store_true")
    args = parser.parse_args(argv)
    from compoundry.plans.registry import ship_package

    session = spark or SparkSession.builder.appName("compoundry").getOrCreate()
    ship_package(session)  # the workers import the package too
    print(json.dumps(COMMANDS[args.command](session, args), indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
