"""Statement rows of differently laid-out files to one ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrock.constants import AMOUNT_WORDS, BIC_BANKS, COLUMN_ROLES, CREDIT_TYPES, CREDIT_VALUES, DATE_WORDS, DEBIT_TYPES, DEBIT_VALUES, FILENAME_BANKS, FX_TO_KWD, NARRATIVE_HEADERS, OTHER_WORDS
from tallyrock.functions.names import name_tokens, refers_to_subject
from tallyrock.functions.narrative import ascii_edges, parse_amount, parse_date, with_channel, with_party
from tallyrock.sources.shared import cut

MOST_SHEETS, HEADER_ROWS, MOST_EMPTY, LABEL_HEADERS, BANK_ROWS = 10, 25, 80, 40, 200


def header_text(cell: Column) -> Column:
    """A header as roles read it: signs as blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(cell, F.lit("")), r"[_\-./]+", " "), r"\s+", " ")))


def find_header(rows: DataFrame) -> DataFrame:
    """(file_id, sheet, header_index, header): of the first 25 rows the first with the best score, of 4 or more; of a file's first ten sheets."""
    score = lambda t: F.when((F.length(t) > 60) | t.isNull(), 0).when(t.rlike(f"{DATE_WORDS}|{AMOUNT_WORDS}"), 2).when(t.rlike(OTHER_WORDS), 1).otherwise(0)
    texts = F.transform("cells", lambda c: F.when(c.isNotNull(), header_text(c)))
    head = rows.where(F.col("row_index") < HEADER_ROWS).withColumn("score", F.aggregate(texts, F.lit(0), lambda s, t: s + score(t)))
    head = head.withColumn("nth", F.dense_rank().over(Window.partitionBy("file_id").orderBy("sheet"))).where(F.col("nth") <= MOST_SHEETS)
    ranked = head.withColumn("r", F.row_number().over(Window.partitionBy("file_id", "sheet").orderBy(F.desc("score"), "row_index")))
    return ranked.where("r = 1 and score >= 4").select("file_id", "sheet", F.col("row_index").alias("header_index"), F.col("cells").alias("header"))


def column_maps(headers: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """(file_id, sheet, header_index, header, roles map<string,int>, narratives array<int>), one row per file and sheet.

    Each role takes the first free header that fits it; every free header of a narrative is one
    of ``narratives``. ``supplied`` (file_id, named map<string,string>) gives roles by header
    text, and replaces what would be found; where ``named`` is null, roles are found. Sheets
    without a date and an amount are left out. ``supplied`` may have credit_values array<string>: an
    indicator that is none of them then means a debit.
    """
    headers = cut(headers, "found-headers")
    # files of one layout share their header; patterns are literal, so each is compiled once
    known = headers.select("header").distinct().withColumn("_texts", F.transform("header", header_text))
    places = F.when(F.size("header") > 0, F.sequence(F.lit(0), F.size("header") - 1)).otherwise(F.array().cast("array<int>"))

    def fitting(must: str, also: str, never: str) -> Column:
        fits = lambda h: (h != "") & h.rlike(ascii_edges(must)) & h.rlike(ascii_edges(also)) & ~h.rlike(never)
        return F.filter("_places", lambda i: fits(F.get(F.col("_texts"), i)))

    def claim(taken: Column, role: Column) -> Column:
        free = F.get(F.filter(role["fits"], lambda i: ~F.array_contains(F.map_values(taken), i)), 0)
        return F.when(~F.map_contains_key(taken, role["role"]) & free.isNotNull(), F.map_concat(taken, F.create_map(role["role"], free))).otherwise(taken)

    fits = F.array(*[F.struct(F.lit(r).alias("role"), fitting(m, x, n).alias("fits")) for r, m, x, n in COLUMN_ROLES])
    known = known.withColumn("_places", places).withColumn("_fits", fits)
    known = cut(known.withColumn("roles", F.aggregate("_fits", F.create_map().cast("map<string,int>"), claim)).drop("_fits"), "headers")
    df = headers.join(known, "header")
    if supplied is not None:
        df = df.join(supplied, "file_id", "left")
        at = lambda name: F.array_position(F.col("_texts"), header_text(name)).cast("int") - 1
        given = F.map_filter(F.transform_values("named", lambda _, v: at(v)), lambda _, v: v >= 0)
        df = df.withColumn("roles", F.coalesce(given, F.col("roles"))).drop("named", "bank_label")
    told = F.filter("_places", lambda i: ~F.array_contains(F.map_values("roles"), i) & F.get(F.col("_texts"), i).rlike(NARRATIVE_HEADERS))
    narrative = F.element_at("roles", F.lit("narrative"))
    df = df.withColumn("narratives", F.when(narrative.isNotNull(), F.array(narrative)).otherwise(told))
    has = lambda *names: F.exists(F.array(*[F.map_contains_key("roles", F.lit(n)) for n in names]), lambda x: x)
    return df.where(has("date") & has("amount", "debit", "credit", "kwd")).drop("_texts", "_places")


def resolve_direction(debit: Column, credit: Column, amount: Column, indicator: Column, kind: Column, credit_values: Column | None = None) -> Column:
    """struct(direction, amount, reason): from two columns, else an amount with what its indicator or type says, else its sign.

    Where ``credit_values`` are given, an indicator is a credit if it is one of them, else a debit.
    """
    made = lambda d, a, r: F.struct(F.lit(d).cast("string").alias("direction"), a.cast("double").alias("amount"), F.lit(r).cast("string").alias("reason"))
    none = F.lit(None)
    has = lambda c: F.coalesce(c, F.lit(0.0)) != 0
    said, typed = F.lower(F.trim(F.coalesce(indicator, F.lit("")))), F.lower(F.coalesce(kind, F.lit("")))
    given = F.coalesce(F.transform(credit_values, lambda v: F.lower(v)) if credit_values is not None else F.lit(None).cast("array<string>"), F.array().cast("array<string>"))
    told = (F.size(given) > 0) & (said != "")
    return (
        F.when(has(debit) & has(credit), made(None, none, "both_sides"))
        .when(has(debit), made("debit", F.abs(debit), None))
        .when(has(credit), made("credit", F.abs(credit), None))
        .when(~has(amount), made(None, none, "no_amount"))
        .when(told & F.array_contains(given, said), made("credit", F.abs(amount), None))
        .when(told, made("debit", F.abs(amount), None))
        .when(said.rlike(CREDIT_VALUES), made("credit", F.abs(amount), None))
        .when(said.rlike(DEBIT_VALUES), made("debit", F.abs(amount), None))
        .when(typed.rlike(CREDIT_TYPES), made("credit", F.abs(amount), None))
        .when(typed.rlike(DEBIT_TYPES), made("debit", F.abs(amount), None))
        .when(amount < 0, made("debit", F.abs(amount), None))
        .otherwise(made("credit", F.abs(amount), None))
    )


def to_kwd(rows: DataFrame, amount: str, currency: str, countervalue: str) -> DataFrame:
    """``rows`` with ``kwd``: the countervalue unless zero or missing, else by the rate; unknown currencies pass at 1."""
    rate = F.create_map(*[F.lit(x) for kv in FX_TO_KWD.items() for x in kv])
    other = F.col(amount) * F.coalesce(F.element_at(rate, F.upper(F.trim(currency))), F.lit(1.0))
    return rows.withColumn("kwd", F.when(F.coalesce(F.col(countervalue), F.lit(0.0)) != 0, F.abs(countervalue)).otherwise(other))


TEXT_ROLES = ("currency", "account", "code", "type", "indicator", "from_name", "to_name", "name", "from_bank", "to_bank", "bank", "from_country", "to_country", "country")


AMOUNT_ROLES = ("kwd", "balance", "debit", "credit", "amount")


def table_rows(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows below each header that are not empty. More than 80 empty rows one after the other end a sheet."""
    # the places of roles are looked up once for each sheet, not for each row
    places = maps.withColumns({f"_at_{r}": F.element_at("roles", F.lit(r)) for r in ("date", *AMOUNT_ROLES, *TEXT_ROLES)}).drop("header", "roles")
    df = rows.join(places, ["file_id", "sheet"]).where(F.col("row_index") > F.col("header_index"))
    full = F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    # only sheets that have so many empty rows are put in order for it
    long = df.where(~full).groupBy("file_id", "sheet").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_EMPTY)
    long = cut(long.select("file_id", "sheet"), "long-gaps")
    if long.isEmpty():
        return df.where(full)
    rest = df.join(long, ["file_id", "sheet"], "left_anti").where(full)
    return rest.unionByName(_before_gaps(df.join(long, ["file_id", "sheet"], "left_semi"), full))


def _before_gaps(df: DataFrame, full: Column) -> DataFrame:
    w = Window.partitionBy("file_id", "sheet").orderBy("row_index")
    df = df.withColumn("_full", full).withColumn("_run", F.sum(F.col("_full").cast("int")).over(w))
    df = df.withColumn("_empties", F.sum((~F.col("_full")).cast("int")).over(Window.partitionBy("file_id", "sheet", "_run").orderBy("row_index")))
    return df.withColumn("_ended", F.max((F.col("_empties") > MOST_EMPTY).cast("int")).over(w)).where("_full and _ended = 0").drop("_full", "_run", "_empties", "_ended")


def parse_cells(table: DataFrame) -> DataFrame:
    """Rows with dates, amounts and the texts of their roles; narratives are joined by bars."""
    cell = lambda role: F.nullif(F.trim(F.get("cells", F.col(f"_at_{role}"))), F.lit(""))
    told = F.filter(F.transform("narratives", lambda i: F.trim(F.get(F.col("cells"), i))), lambda c: F.coalesce(c, F.lit("")) != "")
    df = table.withColumns({"narrative": F.nullif(F.array_join(told, " | "), F.lit("")), **{r: cell(r) for r in TEXT_ROLES}})
    # one parser for all amounts, and one for the date: five copies of it would be more code than the JVM compiles
    amounts = F.transform(F.array(*[cell(r) for r in AMOUNT_ROLES]), parse_amount)
    df = df.withColumns({"_amounts": amounts, "posting_date": F.get(F.transform(F.array(cell("date")), parse_date), 0)})
    return df.select("*", *[F.get("_amounts", k).alias(f"_{r}") for k, r in enumerate(AMOUNT_ROLES)]).drop("_amounts", "cells", "narratives", *[c for c in table.columns if c.startswith("_at_")])


def parse_rows(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows below each file's header with date, direction, amounts, party, bank, country and channel, and the reason where one is skipped.

    Cells are parsed into a table of their own, the only one of all rows: what narratives say is
    read from it once for each narrative and joined to its rows.
    """
    df = parse_cells(table_rows(rows, maps))
    df = df.withColumn("_d", resolve_direction(F.col("_debit"), F.col("_credit"), F.coalesce("_amount", "_kwd"), F.col("indicator"), F.col("type"), F.col("credit_values") if "credit_values" in df.columns else None)).drop("credit_values")
    # rows without a date are no transactions; those without an amount either are no rows at all
    stated = F.coalesce("_debit", "_credit", "_amount").isNotNull()
    reason = F.when(F.col("posting_date").isNull(), "no_date").otherwise(F.col("_d.reason"))
    df = df.withColumns({"_stated": stated, "direction": F.col("_d.direction"), "amount": F.col("_d.amount"), "reason": reason, "currency": F.upper(F.coalesce("currency", F.lit("KWD"))), "countervalue": F.col("_kwd"), "running_balance": F.col("_balance")})
    df = df.drop("_d", "_kwd", "_balance", "_debit", "_credit", "_amount")
    side = lambda what: F.coalesce(F.when(F.col("direction") == "credit", F.col(f"from_{what}")).otherwise(F.col(f"to_{what}")), F.col(what))
    party = side("name")
    party = F.when(~F.lower(F.coalesce(party, F.lit(""))).contains("central bank"), party)
    df = df.withColumns({"_name": party, "counterparty_bank": side("bank"), "counterparty_country": side("country")})
    df = cut(df.drop(*[r for r in TEXT_ROLES if r not in ("currency", "account", "code", "type")]), "cells")
    # behind the table, as Spark would move it before the parsers and parse for it once more
    df = with_party(df.where("posting_date is not null or _stated").drop("_stated"), "narrative")
    df = df.withColumn("counterparty_name", F.coalesce("_name", "_party")).drop("_name", "_party")
    extra = F.nullif(F.concat_ws(" ", "code", "type"), F.lit(""))
    df = df.withColumns({"_extra": extra, "_named": F.col("counterparty_name").isNotNull()})
    df = with_channel(df, "narrative", "_extra", "direction", "_named").withColumnRenamed("_channel", "channel").drop("_extra", "_named")
    df = to_kwd(df, "amount", "currency", "countervalue").withColumnRenamed("kwd", "amount_kwd")
    return df.withColumn("currency", F.when(F.col("currency") == "KD", "KWD").otherwise(F.col("currency")))


def bank_labels(files: DataFrame, maps: DataFrame, parsed: DataFrame) -> DataFrame:
    """(file_id, filename, label, party_banks) for ``infer_bank``: file name, sheet and headers, and the banks of a file's first rows."""
    sheets = parsed.select("file_id", "sheet").distinct()
    heads = maps.join(sheets, ["file_id", "sheet"], "left_semi").select("file_id", F.concat_ws(" ", "sheet", F.array_join(F.slice("header", 1, LABEL_HEADERS), " ")).alias("head"))
    first = parsed.where("reason is null").withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy("row_index"))).where(F.col("r") <= BANK_ROWS)
    banks = first.groupBy("file_id").agg(F.concat_ws(" ", F.collect_set("counterparty_bank")).alias("party_banks"))
    df = files.join(heads, "file_id", "left").join(banks, "file_id", "left")
    return df.select("file_id", "filename", F.concat_ws(" ", "filename", "head").alias("label"), "party_banks")


#: What a report says of rows that are no transactions.
REASONS = {
    "no_date": "row without a parsable date (subtotal/footer)", "both_sides": "row with both debit and credit amounts",
    "no_amount": "row without a monetary amount (non-financial entry)", "no_direction": "row with no direction evidence",
}
NOTED_ROLES = ("date", "amount", "kwd", "debit", "credit", "indicator", "type", "balance", "account", "currency")


def mapping_notes(maps: DataFrame, parsed: DataFrame) -> DataFrame:
    """(file_id, notes array<string>) of the sheets that were taken: where the header stands, the columns' roles, and the rows skipped by reason."""
    taken = maps.join(parsed.select("file_id", "sheet").distinct(), ["file_id", "sheet"], "left_semi")
    head = lambda i: F.trim(F.get("header", i))
    roles = F.array(*[F.when(F.map_contains_key("roles", F.lit(r)), F.concat(F.lit(f"{r}="), head(F.element_at("roles", F.lit(r))))) for r in NOTED_ROLES])
    told = F.concat(F.lit("narrative=["), F.array_join(F.transform("narratives", head), ", "), F.lit("]"))
    columns = F.concat(F.lit("Column map: "), F.array_join(F.filter(F.concat(roles, F.array(F.when(F.size("narratives") > 0, told))), lambda x: x.isNotNull()), ", "))
    found = taken.select("file_id", F.array_compact(F.array(F.when(F.col("header_index") > 0, F.concat(F.lit("Header detected on sheet row "), F.col("header_index") + 1, F.lit("."))), columns)).alias("_head"))
    said = F.coalesce(*[F.when(F.col("reason") == k, v) for k, v in REASONS.items()], "reason")
    skipped = F.concat(F.lit("Skipped "), "n", F.when(F.col("n") == 1, " row: ").otherwise(" rows: "), said, F.lit("."))
    lines = skip_reasons(parsed).groupBy("file_id").agg(F.sort_array(F.collect_list(skipped)).alias("_skipped"))
    return found.join(lines, "file_id", "left").select("file_id", F.concat("_head", F.coalesce("_skipped", F.array().cast("array<string>"))).alias("notes"))


def skip_reasons(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).groupBy("file_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def best_sheet(parsed: DataFrame) -> DataFrame:
    """Rows of each file's sheet with most transactions."""
    counts = parsed.where("reason is null").groupBy("file_id", "sheet").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), "sheet"))).where("r = 1")
    # written, so that Spark knows its size and need not shuffle the rows for it
    return parsed.join(cut(best.select("file_id", "sheet"), "best-sheets"), ["file_id", "sheet"], "left_semi")


def infer_bank(files: DataFrame) -> DataFrame:
    """(file_id, bank) from ``label`` (file name, sheet and headers) and ``party_banks``; else the file name."""
    found = F.lit(None).cast("string")
    for pattern, bank in reversed(BIC_BANKS):
        found = F.when(F.concat_ws(" ", "label", "party_banks").rlike(f"(?i){pattern}"), bank).otherwise(found)
    for pattern, bank in reversed(FILENAME_BANKS):
        found = F.when(F.col("label").rlike("(?i)" + ascii_edges(pattern)), bank).otherwise(found)
    return files.select("file_id", F.coalesce(found, F.regexp_replace("filename", r"(?i)\.(xlsx?|csv)$", "")).alias("bank"))


def suppress_self(txns: DataFrame, cases: DataFrame) -> DataFrame:
    """Counterparties that say no more than the subject's own name become null."""
    subjects = cut(cases.select("case_id", name_tokens(F.col("subject_name")).alias("_subject")), "subjects")
    df = txns.join(subjects, "case_id", "left").withColumn("_tokens", name_tokens(F.col("counterparty_name")))
    own = F.coalesce(refers_to_subject(F.col("_tokens"), F.col("_subject")), F.lit(False))
    return df.withColumn("counterparty_name", F.when(~own, F.col("counterparty_name"))).drop("_subject", "_tokens")


def fill_account(txns: DataFrame) -> DataFrame:
    return txns.withColumn("account_id", F.coalesce(F.nullif(F.trim("account_id"), F.lit("")), F.concat("bank", F.lit(" - main account"))))
