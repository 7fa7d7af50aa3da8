"""Command line: run a script over tables, encode rows as packs, decode packs, write to a log, read its current rows."""

from __future__ import annotations

import argparse
import csv
import io
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.log import merge
from granary.plans.engine import Engine
from granary.plans.staging import numbered
from granary.sources import files, packs

LOG = "id string, p string, signer string, time long"


def shown(df: DataFrame, form: str) -> str:
    """A result as csv, json or text; columns of one name get _2, _3 and so on. Rows come a partition at a time."""
    columns = df.columns
    if form == "csv":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(columns)
        writer.writerows(["" if v is None else v for v in r] for r in files.csv_rows(df).toLocalIterator())
        return out.getvalue()
    if form == "json":
        return json.dumps([json.loads(r[0]) for r in files.json_rows(df).toLocalIterator()], ensure_ascii=False)
    return files.text_table(columns, df.toLocalIterator()) + "\n"


def run_sql(spark: SparkSession, script: str, tables: dict[str, str], form: str = "text") -> str:
    """Results of all statements; tables are Parquet, CSV or JSON files by name."""
    e = Engine(spark)
    for name, path in tables.items():
        if path.endswith((".csv", ".tsv")):
            e.write(name, files.typed(files.read_csv(e.spark, path)))
        elif path.endswith(".json"):
            e.write(name, files.read_json_rows(e.spark, path))
        else:
            e.attach(name, e.spark.read.parquet(path))
    return "".join(shown(r, form) if isinstance(r, DataFrame) else f"{r}\n" for r in e.run(script))


def encode(spark: SparkSession, path: str, key: str | None = None, most: int = packs.BYTES_MOST) -> dict:
    """A CSV file as packs, with the number of rows and of repeated keys."""
    df = files.read_csv(spark, path)
    key = key or df.columns[0]
    held = packs.write_packs(df.coalesce(1), key, most).collect()
    total, distinct = df.agg(F.count(F.lit(1)), F.countDistinct(key)).first()
    return {"rows": total, "columns": len(df.columns), "key": key, "duplicate_keys": total - distinct, "packs": [r.p for r in held]}


def decode(spark: SparkSession, payloads: list[str], form: str = "csv") -> str:
    """The records of packs, deleted ones left out."""
    log = spark.createDataFrame([(k, p) for k, p in enumerate(payloads)], "n long, p string")
    rows = packs.decode(log).filter("NOT deleted")
    names = [r[0] for r in rows.select(F.posexplode(F.map_keys("values")).alias("at", "c")).groupBy("c").agg(F.min("at").alias("at")).orderBy("at", "c").collect()]
    return shown(rows.orderBy("n", "record").select(*[F.col("values")[c].alias(c) for c in names]), form)


def read_log(spark: SparkSession, folder: str, form: str = "csv") -> str:
    """Current rows of a folder of log files (one JSON object a line, in the order of their time)."""
    log = spark.read.schema(LOG).json(folder)
    rows = packs.decode(log).withColumn("seq", F.col("time") * packs.RECORDS_MOST + F.col("record"))
    held = merge(rows.select("key", "seq", "values", "deleted"), "key", "seq", "deleted")
    names = [r[0] for r in rows.select(F.posexplode(F.map_keys("values")).alias("at", "c")).groupBy("c").agg(F.min("at").alias("at")).orderBy("at", "c").collect()]
    return shown(held.orderBy("first_seq").select(*[F.col("values")[c].alias(c) for c in names]), form)


def write(spark: SparkSession, path: str, folder: str, key: str | None = None, signer: str | None = None) -> int:
    """Append a CSV file's rows to a folder of log files, as packs of the times after the log's last; the number of packs."""
    df = files.read_csv(spark, path)
    try:
        last = spark.read.schema(LOG).json(folder).agg(F.max("time")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    held = numbered(packs.write_packs(df, key or df.columns[0], packs.BYTES_MOST), "time", 0 if last is None else last + 1)
    held.select("id", "p", F.lit(signer).cast("string").alias("signer"), "time").write.mode("append").json(folder)
    return held.count()


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="granary")
    sub = p.add_subparsers(dest="what", required=True)
    s = sub.add_parser("sql")
    s.add_argument("script")
    s.add_argument("--table", action="append", default=[], metavar="NAME=PATH")
    for name in ("encode", "decode", "read"):
        sub.add_parser(name).add_argument("path")
    w = sub.add_parser("write")
    w.add_argument("path")
    w.add_argument("folder")
    w.add_argument("--key")
    w.add_argument("--signer")
    for c in sub.choices.values():
        c.add_argument("--format", choices=["csv", "json", "text"], default="text" if c is s else "csv")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("granary").getOrCreate()
    if a.what == "sql":
        print(run_sql(spark, a.script, dict(t.split("=", 1) for t in a.table), a.format), end="")
    elif a.what == "encode":
        print(json.dumps(encode(spark, a.path), ensure_ascii=False))
    elif a.what == "decode":
        with open(a.path, encoding="utf-8") as f:
            print(decode(spark, f.read().splitlines(), a.format), end="")
    elif a.what == "write":
        print(json.dumps({"packs": write(spark, a.path, a.folder, a.key, a.signer)}))
    else:
        print(read_log(spark, a.path, a.format), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
