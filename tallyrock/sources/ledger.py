"""Readers and writers of the ledger's tables, with declared schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrock.sources.shared import cut

SCHEMAS = {
    "ledger": "case_id long, id long, file_id long, bank string, account_id string, row_index int, posting_date date, direction string, amount double, amount_kwd double, currency string, channel string, counterparty_name string, counterparty_bank string, counterparty_country string, narrative string, running_balance double, is_internal_transfer boolean, internal_pair_id long, flags array<string>",
    "cases": "case_id long, subject_name string, declared_occupation string, income double, declared_business_activity string, expected_countries array<string>, notes string, status string",
    "bank_files": "file_id long, case_id long, filename string, bank string, rows_parsed long, rows_skipped long, quality double, issues array<string>, accounts array<string>, period_start date, period_end date, total_credits double, total_debits double",
    "runs": "id long, case_id long, created_at timestamp, probability double, log_odds double, band string, rule_hits array<struct<rule_id:string,fired:boolean,weight:double,txn_ids:array<bigint>>>, features array<struct<key:string,value:double,zone:string>>, list_version string, exact long, strong long, possible long",
    "dispositions": "id long, run_id long, decision string, analyst_name string, notes string, created_at timestamp",
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One of ``SCHEMAS`` from Parquet; columns that the files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_jdbc(spark: SparkSession, name: str, url: str, table: str, parts: int = 16, **options: str) -> DataFrame:
    """The same from a database, read in ``parts`` ranges between its least and largest case."""
    ends = spark.read.format("jdbc").options(url=url, query=f"SELECT min(case_id) AS low, max(case_id) AS high FROM {table}", **options).load().first()
    low, upper = ends[0] or 0, (ends[1] or 0) + 1
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="case_id", lowerBound=str(low), upperBound=str(upper), numPartitions=str(parts), **options)
    df = reader.load()
    wanted = spark.createDataFrame([], SCHEMAS[name]).schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])


#: Signs that may part the cells of a line.
SEPARATORS = (",", ";", "\t", "|")
SEPARATOR_ROWS = 10


def _cells(line: Column, sep: str) -> Column:
    """Cells of a record; quoted ones may hold the separator, line ends and doubled quotes. Empty cells are null."""
    part = re.escape(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{part}("[^"]*+(?:""[^"]*+)*+"|[^{part}]*)'), F.lit(1))
    bare = F.split(line, part, -1)
    raw = F.when(line.contains('"'), raw).otherwise(bare)
    plain = lambda c: F.when(c.startswith('"') & (F.length(c) > 1), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(raw, lambda c: F.nullif(plain(c), F.lit("")))


def _numbered(lines: DataFrame) -> DataFrame:
    """``lines`` (path, block, at, value) with row_index, the line's place in its file: its place in its split and the lines of the splits before."""
    splits = lines.groupBy("path", "block").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("_before", F.coalesce(before, F.lit(0)))
    # written, so that Spark knows its size and need not shuffle the lines for it
    return lines.join(cut(splits.drop("_n"), "statement-splits"), ["path", "block"]).select("path", "value", (F.col("at") - F.col("_first") + F.col("_before")).cast("int").alias("row_index"))


def _records(lines: DataFrame) -> DataFrame:
    """Lines whose quotes stay open joined with those that follow, as (path, row_index, value) of whole records.

    Only files that have such a line are put in order for it.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumn("_quotes", quotes)
    odd = cut(lines.where("_quotes % 2 = 1").select("path").distinct(), "statement-files")
    if odd.isEmpty():
        return lines.drop("_quotes")
    order = Window.partitionBy("path").orderBy("row_index")
    begins = (F.coalesce(F.sum("_quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 0).cast("int")
    some = lines.join(odd, "path", "left_semi").withColumn("_begins", begins).withColumn("_record", F.sum("_begins").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "value"))), lambda x: x["value"]), "\n")
    joined = some.groupBy("path", "_record").agg(text.alias("value")).select("path", "value", (F.col("_record") - 1).cast("int").alias("row_index"))
    return lines.join(odd, "path", "left_anti").select("path", "value", "row_index").unionByName(joined)


def read_statement_rows(spark: SparkSession, path: str, sep: str | None = None, bundled: bool = False) -> DataFrame:
    """(file_id, sheet, row_index, cells, filename, path) of delimited exports with any number of columns; a file is one sheet.

    ``file_id`` is a hash of the path. Rows keep the order of their file, which may be read in
    several splits. Without ``sep`` the separator is the sign that is most frequent in a file's
    first rows. The name of a file that Spark wrote is that of its folder.

    ``bundled`` files hold many exports each, so that exports by the hundred thousand need not be files of their own:
    every line begins with its export's name and a tab, and an export's lines stand together in one file.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    if bundled:
        name = F.substring_index("value", "\t", 1)
        read = read.select(F.substr("value", F.length(name) + 2).alias("value"), F.concat("path", F.lit("/"), name).alias("path"), "block", "at")
    rows = _records(_numbered(cut(read, "statement-lines")))
    rows = rows.withColumn("value", F.when(F.col("row_index") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))
    if sep is None:
        bare = F.regexp_replace("value", '"[^"]*"', "")
        count = lambda s: F.sum(F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))))
        most = F.greatest(*[F.struct(count(s).alias("n"), F.lit(-k).alias("k")) for k, s in enumerate(SEPARATORS)])
        found = rows.where(F.col("row_index") < SEPARATOR_ROWS).groupBy("path").agg((-most["k"]).alias("_sep"))
        found = cut(found, "statement-separators")
        cells = F.coalesce(*[F.when(F.col("_sep") == k, _cells(F.col("value"), s)) for k, s in enumerate(SEPARATORS)])
        rows = rows.join(found, "path").withColumn("cells", cells)
    else:
        rows = rows.withColumn("cells", _cells(F.col("value"), sep))
    steps = F.split("path", "/")
    folder, name = F.regexp_extract(F.element_at(steps, -2), "([^=]*)$", 1), F.element_at(steps, -1)
    return rows.select(F.xxhash64("path").alias("file_id"), F.lit("1").alias("sheet"), "row_index", "cells", F.when(name.startswith("part-"), folder).otherwise(name).alias("filename"), "path")


def _replace(df: DataFrame, path: str, *parts: str) -> None:
    """Write ``df``; partitions that it has rows of are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_runs(runs: DataFrame, path: str, batch: str = "0") -> None:
    """One nested row per case and run, by day of the run and batch. A batch that is written again replaces itself."""
    _replace(runs.withColumns({"run_date": F.to_date("created_at"), "batch": F.lit(batch)}), path, "run_date", "batch")


#: Buckets of cases that a written ledger has.
BUCKETS = 64


def write_ledger(txns: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The ledger by bucket of cases. Buckets that ``txns`` has rows of are replaced, so it must hold all of a bucket's cases."""
    _replace(txns.withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int")), path, "bucket")


def merge_flags(spark: SparkSession, path: str, pairs: DataFrame, hits: DataFrame, scored: DataFrame, buckets: int = BUCKETS) -> None:
    """Set pair marks and flags of the ``scored`` cases (case_id) anew in a written ledger; all else stays.

    Only the cases' buckets are read and replaced. Spark writes what replaces them apart and moves it there at the end, so a
    job that fails before leaves the ledger as it was, and one that runs twice changes nothing more.
    """
    # written, so that Spark knows its size and need not shuffle the ledger for it
    cases = cut(scored.select("case_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int")), "merged-cases")
    some = [r["bucket"] for r in cases.select("bucket").distinct().collect()]
    old = spark.read.parquet(path).where(F.col("bucket").isin(some))
    columns = [c for c in old.columns if c != "bucket"]
    ours = lambda df: df.join(cases.select("case_id"), "case_id", "left_semi")
    mine = ours(old).select(*[c for c in columns if c not in ("flags", "is_internal_transfer", "internal_pair_id")])
    anew = flag_ledger(mine, ours(pairs), ours(hits)).select(*columns)
    write_ledger(old.join(cases.select("case_id"), "case_id", "left_anti").select(*columns).unionByName(anew), path, buckets)


def flag_ledger(txns: DataFrame, pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """The ledger with pair marks and the fired rules that name each row as evidence, all set anew."""
    from tallyrock.operators.netting import mark_internal

    named = hits.where("fired").select("case_id", F.explode("txn_ids").alias("id"), "rule_id").groupBy("case_id", "id").agg(F.sort_array(F.collect_set("rule_id")).alias("flags"))
    marked = mark_internal(txns.drop("flags"), pairs).join(named, ["case_id", "id"], "left")
    return marked.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
