"""Text-identity safety and training-data preparation on Spark."""

from __future__ import annotations

__version__ = "0.2.0"


def ship(spark) -> str:
    """Send the package to a session's workers, for drivers that start outside an environment where it is installed."""
    import pathlib
    import tempfile
    import zipfile

    here = pathlib.Path(__file__).parent
    path = pathlib.Path(tempfile.mkdtemp(prefix="spoofscan-")) / "spoofscan.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, file.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(path))
    return str(path)
