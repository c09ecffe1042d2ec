"""``python -m logtide``: see logtide.cli."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from logtide.cli import run

if __name__ == "__main__":
    session = SparkSession.builder.appName("logtide").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    code = run(sys.argv[1:], session)
    session.stop()
    sys.exit(code)
