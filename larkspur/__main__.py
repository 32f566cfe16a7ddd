"""python -m larkspur shapes SOURCE TARGET [append] | query NAME FOLDER TARGET, each with key=value settings such as master=, appname= and config=FILE."""

from __future__ import annotations

import json
import pathlib
import sys
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import SparkSession

DEFAULTS = {"master": "local[*]", "appname": "larkspur"}


def settings(arguments: Sequence[str], defaults: Mapping[str, object] = DEFAULTS, read: Callable[[str], bytes] = lambda p: pathlib.Path(p).read_bytes()) -> dict:
    """Defaults, overlaid by the JSON file that config= names, then by the other key=value arguments."""
    given = dict(a.split("=", 1) for a in arguments if "=" in a)
    stored = json.loads(read(given.pop("config"))) if "config" in given else {}
    return {**defaults, **stored, **given}


def main(arguments: Sequence[str], spark: SparkSession | None = None) -> None:
    found, words = settings(arguments), [a for a in arguments if "=" not in a]
    if len(words) < 3 or words[0] not in ("shapes", "query"):
        sys.exit(__doc__)
    spark = spark or SparkSession.builder.master(str(found["master"])).appName(str(found["appname"])).getOrCreate()
    if words[0] == "shapes":
        from larkspur.operators import geo

        geo.shapes_to_parquet(spark, words[1], words[2], "append" in words[3:])
    else:
        from larkspur.plans import catalog

        catalog.QUERIES[words[1]](spark, words[2]).write.mode("overwrite").parquet(words[3])


if __name__ == "__main__":
    main(sys.argv[1:])
