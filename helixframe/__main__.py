"""Run registered queries from the command line: ``python -m helixframe list`` or ``python -m helixframe QUERY FOLDER [OUT]``."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from helixframe import registry

    found = registry.queries()
    if args[:1] == ["list"]:
        print("\n".join(sorted(found)))
        return 0
    if len(args) not in (2, 3) or args[0] not in found:
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    df = found[args[0]](SparkSession.builder.getOrCreate(), args[1])
    if len(args) == 3:
        df.write.parquet(args[2])
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
