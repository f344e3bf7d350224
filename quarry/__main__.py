"""Command line: run one analysis from its original input files and write every
answer as a parquet table under ``--out`` (nothing is collected to the driver).

    spark-submit -m quarry weblog --log access_log.gz --rank-name <org> --out results/q1
    python -m quarry glms --csv encounters.csv --out results/q2
    python -m quarry wide --train train.csv --test test.csv --out results/q3a
    python -m quarry scaling --train train.csv --test test.csv --out results/q3b
    python -m quarry recommender --ratings ratings.csv --scores genome-scores.csv --tags genome-tags.csv --out results/q4
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame

from quarry.session import get_spark


def _write(tables: dict[str, DataFrame], out: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(out, name))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="cmd", required=True)
    w = sub.add_parser("weblog")
    w.add_argument("--log", required=True)
    w.add_argument("--rank-name", default=None, help="organisation whose rank to report")
    w.add_argument("--rank-class", default=None, help="host class to rank it in (default: every class)")
    g = sub.add_parser("glms")
    g.add_argument("--csv", required=True)
    for name in ("wide", "scaling"):
        s = sub.add_parser(name)
        s.add_argument("--train", required=True)
        s.add_argument("--test", required=True)
        s.add_argument("--n-features", type=int, default=None, help="checked against the files' width")
    sub.choices["wide"].add_argument("--fraction", type=float, default=0.01)
    r = sub.add_parser("recommender")
    r.add_argument("--ratings", required=True)
    r.add_argument("--scores", required=True)
    r.add_argument("--tags", required=True)
    for s in (w, g, r, *[sub.choices[n] for n in ("wide", "scaling")]):
        s.add_argument("--out", required=True)
        s.add_argument("--master", default=None, help="only for local runs; spark-submit sets the master")
    a = p.parse_args(argv)

    from quarry.plans import analyses
    spark = get_spark(a.master)
    if a.cmd == "weblog":
        res = analyses.web_logs(spark, a.log, a.rank_name, a.rank_class)
        cube = res.pop("cube")
        _write(res, a.out)
        cube.unpersist()
    elif a.cmd == "glms":
        _write(analyses.encounter_glms(spark, a.csv), a.out)
    elif a.cmd == "wide":
        _write(analyses.wide_tuning(spark, a.train, a.test, a.fraction, n_features=a.n_features), a.out)
    elif a.cmd == "scaling":
        long, _ = analyses.sample_size_scaling(spark, a.train, a.test, results_path=os.path.join(a.out, "results"),
                                               n_features=a.n_features)
        _write({"long": long}, a.out)
    elif a.cmd == "recommender":
        res = analyses.recommender(spark, a.ratings, a.scores, a.tags)
        _write(res, a.out)


if __name__ == "__main__":
    main()
