"""python -m spoofscan: the package's tables as files. `export DIR` writes the homoglyph data and prints what it wrote."""

from __future__ import annotations

import argparse


def _options() -> argparse.ArgumentParser:
    options = argparse.ArgumentParser("spoofscan", description=__doc__)
    options.add_argument("what", choices=("export",))
    options.add_argument("directory", help="where the files go; what is there under their names is replaced")
    options.add_argument("--unicode", metavar="FOLDER", help="take the answers from a folder of Unicode's own files")
    return options


def main(arguments: list[str] | None = None) -> int:
    given = _options().parse_args(arguments)
    from pyspark.sql import SparkSession

    from .sources.export import export
    from .sources.folder import DIRECTORY

    spark = SparkSession.builder.getOrCreate()
    if given.unicode:
        spark.conf.set(DIRECTORY, given.unicode)
    for path in export(spark, given.directory):
        print(path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
