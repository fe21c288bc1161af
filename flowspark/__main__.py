"""``python -m flowspark [SCRIPT...] [--stream NAME=PATH[:ORDER,...]] [--serve --host H --port P] [--verbose] [--version]``"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans.engine import Engine
from .server import VERSION, serve, shown
from .sources.files import read_rows


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("flowspark", description="Runs scripts of the pipe language, or serves them.")
    p.add_argument("scripts", nargs="*")
    p.add_argument("--stream", action="append", default=[], metavar="NAME=PATH[:ORDER,...]")
    p.add_argument("--serve", action="store_true")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=3333)
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--version", action="version", version=VERSION)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("flowspark").getOrCreate()
    engine = Engine(spark)
    for s in a.stream:
        name, _, rest = s.partition("=")
        path, _, order = rest.partition(":") if "://" not in rest else (rest, "", "")
        engine.register_stream(name, read_rows(spark, path), order.split(",") if order else None)
    ok = True
    for path in a.scripts:
        with open(path, encoding="utf-8") as f:
            for r in engine.run_script(f.read()):
                r.value = shown(r.value)
                ok &= r.success
                if a.verbose or r.value is not None or not r.success:
                    print(json.dumps(r.as_dict(), default=str))
    if a.serve:
        serve(engine, a.host, a.port, a.verbose).serve_forever()
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
