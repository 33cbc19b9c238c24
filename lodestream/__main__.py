"""``python -m lodestream validate FILE...``: judge observation files; exit code 1 if a record is rejected.
``python -m lodestream check-library FILE...``: judge class libraries; exit code 1 if one has an issue.
``python -m lodestream settings [NAME=VALUE...]``: every setting and where it comes from.
"""

from __future__ import annotations

import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestream import config
from lodestream.sources import library
from lodestream.sources.observations import read_jsonl


def validate(paths: list[str]) -> int:
    spark, bad = SparkSession.builder.getOrCreate(), 0
    for path in paths:
        judged = read_jsonl(spark, path)
        for row in judged.where(F.size("issues") > 0).select("file", F.substring("text", 1, 80).alias("text"), "issues").toLocalIterator():
            bad += 1
            print(f"FAIL {row['file']}: {row['text']} {'; '.join(row['issues'])}")
    return int(bad > 0)


def check_library(paths: list[str]) -> int:
    bad = 0
    for path in paths:
        for issue in library.issues(library.parse(Path(path).read_text(), path)):
            bad += 1
            print(f"FAIL {path}: {issue}")
    return int(bad > 0)


def show_settings(pairs: list[str]) -> int:
    for name, s in config.settings(dict(p.split("=", 1) for p in pairs), os.environ).items():
        print(f"{name} = {s.value} ({s.source})")
    return 0


COMMANDS = {"validate": validate, "check-library": check_library, "settings": show_settings}


def main(args: list[str]) -> int:
    if not args or args[0] not in COMMANDS or args[0] != "settings" and len(args) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    return COMMANDS[args[0]](args[1:])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
