"""Sanctions lists and the screening of names against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrock.constants import NON_DISTINCTIVE
from tallyrock.functions.names import name_tokens, names_likely_same, refers_to_subject
from tallyrock.operators.identities import spellings
from tallyrock.sources.shared import cut

LEAST = {"OFAC": 1000, "UN": 100}
TIERS = ("exact", "strong", "possible")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=False, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def _value(name: str) -> Column:
    t = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when((t != "") & (t != "-0-"), t)


def read_ofac(spark: SparkSession, sdn_path: str, alt_path: str) -> DataFrame:
    """(list, entry_id, type, programs, names array<struct<text,tokens,is_alias>>, reference, listed_on, remarks); aliases are unlike in tokens."""
    sdn = _csv(spark, sdn_path)
    main = sdn.select(F.trim("_c0").alias("n"), _value("_c1").alias("name"), F.coalesce(F.lower(_value("_c2")), F.lit("entity")).alias("type"), F.split(F.coalesce(_value("_c3"), F.lit("")), r"\] \[").alias("programs"), (_value("_c11") if "_c11" in sdn.columns else F.lit(None).cast("string")).alias("remarks")).where("n rlike '^[0-9]+$' and name is not null")
    kind = F.lower(F.regexp_replace("_c2", "[^A-Za-z]", ""))
    alt = _csv(spark, alt_path).where(kind.isin("aka", "fka", "nka")).select(F.trim("_c0").alias("n"), _value("_c3").alias("text")).where("text is not null")
    alt = alt.withColumn("tokens", name_tokens(F.col("text"))).where(F.size("tokens") > 0).groupBy("n", "tokens").agg(F.min("text").alias("text"))
    alt = alt.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("text", "tokens", F.lit(True).alias("is_alias")))).alias("aliases"))
    own = F.array(F.struct(F.col("name").alias("text"), name_tokens(F.col("name")).alias("tokens"), F.lit(False).alias("is_alias")))
    return main.join(alt, "n", "left").select(F.lit("OFAC").alias("list"), F.concat(F.lit("SDN-"), "n").alias("entry_id"), "type", "programs", F.when(F.col("aliases").isNull(), own).otherwise(F.concat(own, F.filter("aliases", lambda a: a["tokens"] != name_tokens(F.col("name"))))).alias("names"), *[F.lit(None).cast("string").alias(c) for c in ("reference", "listed_on")], "remarks")


def read_un_list(spark: SparkSession, path: str) -> DataFrame:
    """Individuals and entities of the consolidated XML list, in the columns of ``read_ofac``."""
    person = "DATAID string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, UN_LIST_TYPE string, REFERENCE_NUMBER string, LISTED_ON string, COMMENTS1 string, INDIVIDUAL_ALIAS array<struct<ALIAS_NAME:string>>"
    firm = "DATAID string, FIRST_NAME string, UN_LIST_TYPE string, REFERENCE_NUMBER string, LISTED_ON string, COMMENTS1 string, ENTITY_ALIAS array<struct<ALIAS_NAME:string>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    def shaped(df: DataFrame, kind: str, parts: list[str], alias: str) -> DataFrame:
        made = lambda text, is_alias: F.struct(text.alias("text"), name_tokens(text).alias("tokens"), F.lit(is_alias).alias("is_alias"))
        known = F.filter(F.coalesce(F.col(alias), F.array().cast("array<struct<ALIAS_NAME:string>>")), lambda a: F.coalesce(F.trim(a["ALIAS_NAME"]), F.lit("")) != "")
        names = F.concat(F.array(made(F.concat_ws(" ", *[F.trim(p) for p in parts]), False)), F.transform(known, lambda a: made(F.trim(a["ALIAS_NAME"]), True)))
        return df.select(F.lit("UN").alias("list"), F.concat(F.lit("UN-"), "DATAID").alias("entry_id"), F.lit(kind).alias("type"), F.filter(F.array(F.trim("UN_LIST_TYPE")), lambda x: x.isNotNull()).alias("programs"), names.alias("names"), *[F.nullif(F.trim(c), F.lit("")).alias(n) for c, n in (("REFERENCE_NUMBER", "reference"), ("LISTED_ON", "listed_on"), ("COMMENTS1", "remarks"))])

    people = shaped(read("INDIVIDUAL", person), "individual", ["FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME"], "INDIVIDUAL_ALIAS")
    return people.unionByName(shaped(read("ENTITY", firm), "entity", ["FIRST_NAME"], "ENTITY_ALIAS"))


def guard_list_size(entries: DataFrame) -> DataFrame:
    """(list, n, status): a list that is implausibly short makes screening unavailable, never clean."""
    counts = entries.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    known = entries.sparkSession.createDataFrame(list(LEAST.items()), "list string, least long")
    return known.join(counts, "list", "left").select("list", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) < F.col("least"), "unavailable").otherwise("complete").alias("status"))


def names_to_screen(txns: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, key, tokens, display, n, is_subject): distinct names of a case, without the subject's own, and the subject."""
    said = spellings(txns).withColumnRenamed("scope", "case_id").where("kind = 'name'")
    named = said.groupBy("case_id", "key").agg(F.first("tokens").alias("tokens"), F.min("display").alias("display"), F.sum("n").alias("n"))
    subject = cases.select("case_id", name_tokens(F.col("subject_name")).alias("st"), "subject_name")
    others = named.join(subject, "case_id", "left").where(~F.coalesce(refers_to_subject(F.col("tokens"), F.col("st")), F.lit(False))).select("case_id", "key", "tokens", "display", "n", F.lit(False).alias("is_subject"))
    own = subject.where(F.size("st") > 0).select("case_id", F.concat(F.lit("name:"), F.array_join("st", " ")).alias("key"), F.col("st").alias("tokens"), F.col("subject_name").alias("display"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("is_subject"))
    return others.unionByName(own)


def screen(names: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, entry_id, list, tier, listed_name, alias): the best name of each entry that a name may be.

    ``listed_name`` is the entry's primary name; ``alias`` the alias that matched, else null.

    Names are screened once however many cases have them. Candidates meet so that words that
    many names share bring no pairs of their own: equal sets of tokens meet by the set; names
    that are alike but for initials by their first letters and a shared token of three letters,
    where one of the two has a token of at most two; and those that share two distinctive tokens
    by each two of them.
    """
    queries = names.select("key", "tokens").dropDuplicates(["key"]).where(F.exists("tokens", lambda t: F.length(t) >= 3))
    primary = F.get(F.filter("names", lambda n: ~n["is_alias"]), 0)["text"]
    listed = entries.select("list", "entry_id", primary.alias("primary"), F.inline("names")).where(F.size("tokens") > 0).select("list", "entry_id", "primary", "text", F.col("tokens").alias("lt"), "is_alias").distinct()
    rare = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda t: (F.length(t) >= 3) & ~t.isin(*NON_DISTINCTIVE))))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), " ")
    short = lambda c: F.exists(c, lambda t: F.length(t) <= 2)

    def blocks(tokens: str, initials: Column) -> Column:
        two = F.flatten(F.transform(rare(tokens), lambda x, i: F.transform(F.filter(rare(tokens), lambda y: y > x), lambda y: F.concat(F.lit("2:"), x, F.lit(" "), y))))
        letters = joined(F.transform(tokens, lambda t: F.substring(t, 1, 1)))
        near = F.transform(F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= 3)), lambda t: F.concat(initials, letters, F.lit(" "), t))
        return F.concat(F.array(F.concat(F.lit("=:"), joined(tokens))), two, near)

    # "s:" asks a side without short tokens for those with one; "f:" is the other way round, both where both have one
    a = queries.select("*", F.explode(F.array_distinct(F.concat(blocks("tokens", F.lit("s:")), F.when(short("tokens"), blocks("tokens", F.lit("f:"))).otherwise(F.array().cast("array<string>"))))).alias("block"))
    b = listed.select("*", F.explode(F.array_distinct(F.concat(blocks("lt", F.lit("f:")), F.when(short("lt"), blocks("lt", F.lit("s:"))).otherwise(F.array().cast("array<string>"))))).alias("block"))
    both = a.join(b, "block").drop("block").distinct()
    distinctive = lambda c: F.filter(c, lambda t: (F.length(t) >= 3) & ~t.isin(*NON_DISTINCTIVE))
    shared = F.size(F.filter(distinctive("tokens"), lambda t: F.array_contains("lt", t)))
    tier = F.when(F.array_sort("tokens") == F.array_sort("lt"), 0).when(names_likely_same(F.col("tokens"), F.col("lt")), 1).when(shared >= 2, 2)
    ranked = both.withColumn("t", tier).where("t is not null").withColumn("r", F.row_number().over(Window.partitionBy("key", "entry_id").orderBy("t", "is_alias", "text")))
    return ranked.where("r = 1").select("key", "entry_id", "list", F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("t") + 1).alias("tier"), F.coalesce("primary", "text").alias("listed_name"), F.when(F.col("is_alias"), F.col("text")).alias("alias"))


def top_matches(names: DataFrame, matches: DataFrame, per_name: int = 5, per_case: int = 25) -> tuple[DataFrame, DataFrame]:
    """The matches a case keeps, and its totals by tier over them and the subject's."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    best = matches.withColumn("rank", rank).withColumn("m", F.row_number().over(Window.partitionBy("key").orderBy("rank", "listed_name", "entry_id"))).where(F.col("m") <= per_name)
    named = names.join(best.groupBy("key").agg(F.min("rank").alias("best")), "key")
    kept = named.withColumn("c", F.row_number().over(Window.partitionBy("case_id", "is_subject").orderBy("best", F.desc("n"), "key"))).where((F.col("c") <= per_case) | F.col("is_subject"))
    out = kept.join(best, "key").select("case_id", "key", "display", "n", "is_subject", "entry_id", "list", "tier", "listed_name", "alias")
    return out, out.groupBy("case_id").agg(*[F.count_if(F.col("tier") == t).alias(t) for t in TIERS])


def screening(txns: DataFrame, cases: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, one row a case of status, names screened and totals).

    A list that is implausibly short makes the screening of every case unavailable: it has no
    matches and no totals then, which is not a clean result.
    """
    short = [r["list"] for r in guard_list_size(entries).where("status = 'unavailable'").collect()]  # one row a list
    asked = cut(names_to_screen(txns, cases), "asked")
    matches, totals = top_matches(asked, cut(screen(asked, entries), "matches"))
    if short:
        none = [F.lit(None).cast("long").alias(t) for t in TIERS]
        status = cases.select("case_id", F.lit("unavailable").alias("status"), F.lit("implausibly few entries: " + ", ".join(sorted(short))).alias("reason"), F.lit(0).cast("long").alias("names"), *none)
        return matches.where("false"), status
    counted = asked.groupBy("case_id").agg(F.count(F.lit(1)).alias("names"))
    status = cases.select("case_id").join(counted, "case_id", "left").join(totals, "case_id", "left").fillna(0, ["names", *TIERS])
    return matches, status.select("case_id", F.lit("complete").alias("status"), F.lit(None).cast("string").alias("reason"), "names", *TIERS)


def changed_entries(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of ``new`` that ``old`` lacks or has otherwise, list and entry_id of all that differ) of two versions of the lists."""
    marked = lambda df: df.withColumn("_mark", F.xxhash64(*[F.to_json(F.struct(c)) for c in ("type", "programs", "names")]))
    key = ["list", "entry_id"]
    before, after = marked(old).select(*key, F.col("_mark").alias("_was")), marked(new)
    added = after.join(before, key, "left").where(~F.col("_mark").eqNullSafe(F.col("_was"))).drop("_mark", "_was")
    gone = before.join(after.select(*key, "_mark"), key, "left").where(~F.col("_mark").eqNullSafe(F.col("_was"))).select(*key)
    return added, gone.union(added.select(*key)).distinct()


def rescreened(names: DataFrame, matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``screen(names, new)`` from ``matches``, which is ``screen(names, old)``: only entries that differ are screened."""
    added, differ = changed_entries(old, new)
    kept = matches.join(differ, ["list", "entry_id"], "left_anti").select(*matches.columns)
    return kept.unionByName(screen(names, cut(added, "changed-entries")).select(*matches.columns))


def rescreen_stale(runs: DataFrame, version: str, names: DataFrame, entries: DataFrame, before: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(case_id, totals before and after) of latest runs that were screened on another list version and change.

    ``before``, the matches of the last version and its entries, lets only what differs be screened. A list
    that is implausibly short changes nothing: its result would be worse than the one that stands.
    """
    w = Window.partitionBy("case_id").orderBy(F.desc("created_at"), F.desc("id"))
    stale = runs.withColumn("r", F.row_number().over(w)).where("r = 1").where(~F.col("list_version").eqNullSafe(F.lit(version)))
    if not guard_list_size(entries).where("status = 'unavailable'").isEmpty():
        stale = stale.where("false")
    some = names.join(stale.select("case_id"), "case_id", "left_semi")
    _, now = top_matches(some, screen(some, entries) if before is None else rescreened(some, before[0].join(some.select("key").distinct(), "key", "left_semi"), before[1], entries))
    both = stale.select("case_id", "exact", "strong", "possible").join(now.select("case_id", *[F.col(t).alias(f"new_{t}") for t in TIERS]), "case_id", "left").fillna(0)
    return both.where(" or ".join(f"{t} <> new_{t}" for t in TIERS))
