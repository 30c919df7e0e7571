"""python -m corpusmill --config FILE: a full generation run. python -m corpusmill build-cases --count N --output PATH: the case file."""

from __future__ import annotations

import argparse
import logging
import os
import sys


def path_from(env: str) -> str:
    """The path that an environment variable names; RuntimeError where it is unset or empty."""
    value = os.environ.get(env)
    if not value:
        raise RuntimeError(f"the environment variable {env} is not set")
    return os.path.expanduser(value)


def build_cases(argv: list[str]) -> int:
    """Writes the eleven variants of each number as JSON lines; returns their count."""
    parser = argparse.ArgumentParser(prog="corpusmill build-cases")
    parser.add_argument("--count", type=int, required=True, help="how many numbers")
    parser.add_argument("--output", help="folder of JSON lines; without it, the one that --output-env names")
    parser.add_argument("--output-env", default="CORPUSMILL_CASES", help="environment variable with the folder")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--operator-min", type=int, default=800)
    parser.add_argument("--operator-max", type=int, default=999)
    args = parser.parse_args(argv)
    from pyspark.sql import SparkSession

    from .operators.phone import expand_variants, phone_numbers
    from .sources.jsonl import write_lines

    spark = SparkSession.builder.appName("build-cases").getOrCreate()
    numbers = phone_numbers(spark, args.count, args.operator_min, args.operator_max, args.seed)
    write_lines(expand_variants(numbers, args.seed).drop("index"), args.output or path_from(args.output_env), "overwrite")
    return args.count * 11


def main(argv: list[str] | None = None) -> dict | int:
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] == "build-cases":
        return build_cases(argv[1:])
    parser = argparse.ArgumentParser(prog="corpusmill")
    parser.add_argument("--config", required=True, help="YAML file of the project")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    from pyspark.sql import SparkSession

    from .plans.runner import Generator
    from .sources.config import load_project

    project = load_project(args.config)
    spark = SparkSession.builder.appName(project.run.name).getOrCreate()
    return Generator(spark, project).run()


if __name__ == "__main__":
    main()
