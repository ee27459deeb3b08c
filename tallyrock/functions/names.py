"""Names as tokens, and when two of them may be one party."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrock.constants import HONORIFICS, LEGAL_SUFFIXES


def _strip(tokens: Column) -> Column:
    """Without leading honorifics and trailing legal forms, but never without any token."""
    one = "(?:" + "|".join(HONORIFICS) + ")"
    end = "(?:" + "|".join(LEGAL_SUFFIXES) + ")"
    line = F.regexp_replace(F.array_join(tokens, " "), f"^(?:{one} )+(?=.)", "")
    line = F.regexp_replace(line, f"^(.+?)(?: {end})+$", "$1")
    return F.array_remove(F.split(line, " "), "")


def name_tokens(col: Column) -> Column:
    """Upper-cased tokens of A-Z and 0-9; ``AL`` is joined to what follows it."""
    line = F.regexp_replace(F.upper(F.coalesce(col, F.lit(""))), r"[^A-Z0-9\s ]", " ")
    line = F.regexp_replace(line, r"(?<![A-Z0-9_])AL[\s-]+(?=[A-Z0-9])", "AL")
    return _strip(F.array_remove(F.split(F.trim(line), r"[\s ]+"), ""))


def parse_identity(col: Column) -> Column:
    """struct(kind, key, display, tokens); null where nothing identifies a party."""
    shown = F.trim(F.regexp_replace(col, r"[\s ]+", " "))
    tokens, none = name_tokens(shown), F.array().cast("array<string>")
    account, insta = F.regexp_extract(shown, r"(?i)^account ([0-9X]{3,})$", 1), F.regexp_extract(shown, r"(?i)^instapay ([0-9X][0-9X-]{2,})$", 1)
    made = lambda kind, key, t: F.struct(F.lit(kind).alias("kind"), key.alias("key"), shown.alias("display"), t.alias("tokens"))
    return (
        F.when(account != "", made("account_ref", F.concat(F.lit("acct:"), F.upper(account)), none))
        .when(insta != "", made("instapay_ref", F.concat(F.lit("ip:"), F.upper(insta)), none))
        .when((shown != "") & (F.size(tokens) > 0), made("name", F.concat(F.lit("name:"), F.array_join(tokens, " ")), tokens))
    )


def parsed_names(names: DataFrame) -> DataFrame:
    """(spelling, who) of the distinct ``spelling``s; a filter on ``who`` belongs behind a ``cut``, as Spark would move it to the rows before they are made distinct."""
    return names.distinct().select("spelling", parse_identity(F.col("spelling")).alias("who"))


def covered_by(a: Column, b: Column) -> Column:
    """Each token of ``a`` is in ``b``, or one of the two is an initial of the other."""
    short = lambda t: F.length(t) <= 2
    fits = lambda x: F.exists(b, lambda y: (x == y) | (short(x) & y.startswith(x)) | (~short(x) & short(y) & x.startswith(y)))
    return F.forall(a, fits)


def names_likely_same(a: Column, b: Column) -> Column:
    shared = F.exists(F.array_intersect(a, b), lambda t: F.length(t) >= 3)
    return (F.size(a) > 0) & (F.size(b) > 0) & shared & covered_by(a, b) & covered_by(b, a)


def refers_to_subject(a: Column, subject: Column) -> Column:
    return (F.size(a) > 0) & (F.size(subject) > 0) & covered_by(a, subject)


def name_similarity(a: Column, b: Column) -> Column:
    """Common words of two names, of more than one letter, over the fewer of the two; 0 where one has none."""

    def words(col: Column) -> Column:
        line = F.regexp_replace(F.upper(F.coalesce(col, F.lit(""))), r"(?<![A-Z0-9_])AL[-\s]", "AL")
        line = F.regexp_replace(line, r"[^A-Zء-ي ]+", " ")
        return F.array_distinct(F.filter(F.split(F.trim(line), " +"), lambda w: F.length(w) > 1))

    x, y = words(a), words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))), F.lit(0.0))
