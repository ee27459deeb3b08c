"""Predicates and parsers of statement text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrock.constants import BLACK_LIST, GREY_LIST, PATTERNS
from tallyrock.sources.shared import cut

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    """The pattern with \\b as a boundary of ASCII words only, and \\s with the no-break space."""
    return pattern.replace(r"\b", _EDGE).replace(r"\s", r"[\s ]")


def matches(col: Column, name: str) -> Column:
    return col.rlike("(?i)" + ascii_edges(PATTERNS[name]))


def is_self(narrative: Column) -> Column:
    return F.coalesce(matches(narrative, "self"), F.lit(False))


def is_crypto(narrative: Column) -> Column:
    return F.coalesce(matches(narrative, "crypto"), F.lit(False))


def is_vague(narrative: Column) -> Column:
    """Null, shorter than six characters (inner blanks count) without figures and signs, or at most two words that say nothing."""
    bare = F.regexp_replace(F.regexp_replace(narrative, r"[0-9\-_/:#.]+", " "), r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")
    words = F.filter(F.split(bare, r"[\s\x{A0}]+"), lambda w: w != "")
    empty = (F.size(words) <= 2) & F.forall(words, lambda w: matches(w, "vague"))
    return narrative.isNull() | (narrative == "") | (F.length(bare) < 6) | empty


def country_risk(country: Column) -> Column:
    c = F.upper(F.trim(country))
    return F.when(c.isin(*BLACK_LIST), "black").when(c.isin(*GREY_LIST), "grey")


def identifiable(name: Column) -> Column:
    n = F.trim(name)
    masked = n.rlike("(?i)" + ascii_edges(r"^(account|instapay)\b")) | n.rlike(r"(?i)^[0-9X\s.-]+$")
    return F.coalesce(~masked & (F.length(n) >= 3), F.lit(False))


def classify_channel(narrative: Column, extra: Column, direction: Column, has_party: Column) -> Column:
    """One of ten channels; the first pattern that fits, in this order."""
    t = F.lower(F.trim(F.concat_ws(" ", F.coalesce(narrative, F.lit("")), F.coalesce(extra, F.lit("")))))
    said, credit = t != "", direction == "credit"
    debit = ~credit
    is_ = lambda name: said & matches(t, name)
    moved = F.when(credit, "transfer_in").otherwise("transfer_out")
    return (
        F.when(credit & is_("cash_deposit"), "cash_deposit")
        .when(debit & is_("atm"), "cash_withdrawal")
        .when(credit & is_("salary"), "salary")
        .when(debit & is_("pos"), "pos")
        .when(is_("cheque"), "cheque")
        .when(is_("interest"), "interest")
        .when(debit & is_("fee"), "fee")
        .when(is_("transfer"), moved)
        .when(is_("cash"), F.when(credit, "cash_deposit").otherwise("cash_withdrawal"))
        .when(credit & ~has_party & is_("deposit"), "cash_deposit")
        .when(debit & ~has_party & is_("withdrawal"), "cash_withdrawal")
        .when(has_party, moved)
        .otherwise("other")
    )


def with_channel(rows: DataFrame, narrative: str, extra: str, direction: str, has_party: str) -> DataFrame:
    """``rows`` with ``_channel``; what rows say alike is classified once, however many say it."""
    names = [narrative, extra, direction, has_party]
    known = rows.select(*[F.col(n).alias(f"_said_{k}") for k, n in enumerate(names)]).distinct()
    known = cut(known.withColumn("_channel", classify_channel(*[F.col(f"_said_{k}") for k in range(4)])), "channels")
    same = reduce(and_, (F.col(n).eqNullSafe(F.col(f"_said_{k}")) for k, n in enumerate(names)))
    return rows.join(known, same, "left").drop(*[f"_said_{k}" for k in range(4)])


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def parse_date(col: Column) -> Column:
    """A real calendar day from 1990 to 2035: ISO, ``d MMM yyyy``, day before month (or after), or a serial day number."""
    return once(F.trim(col.cast("string")), lambda t: once(_date(t), lambda d: F.when(F.year(d).between(1990, 2035), d)))


def _date(t: Column) -> Column:
    full = lambda y: F.when(F.length(y) > 2, y.cast("int")).when(y.cast("int") < 50, y.cast("int") + 2000).otherwise(y.cast("int") + 1900)
    made = lambda y, m, d: F.concat(y.cast("string"), F.lit("-"), m.cast("string"), F.lit("-"), d.cast("string")).try_cast("date")
    part = lambda pattern, k: F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))
    iso, named, slash = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"(?i)^(\d{1,2})[\s-]([a-z]{3})[a-z]*[\s-](\d{2,4})", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})"
    month = F.array_position(F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()]), F.lower(F.regexp_extract(t, named, 2))).cast("int")
    a, b, y = part(slash, 1).cast("int"), part(slash, 2).cast("int"), full(part(slash, 3))
    serial = F.when(t.rlike(r"^\d{5}(?:\.\d+)?$"), F.try_to_number(F.regexp_extract(t, r"^(\d{5})", 1), F.lit("99999")).cast("int"))
    return (
        F.when(t.rlike(iso), made(part(iso, 1).cast("int"), part(iso, 2).cast("int"), part(iso, 3).cast("int")))
        .when(t.rlike(named), F.when(month > 0, made(full(part(named, 3)), month, part(named, 1).cast("int"))))
        .when(t.rlike(slash), F.coalesce(made(y, b, a), made(y, a, b)))
        .when(serial.between(20000, 60000), F.date_add(F.lit("1899-12-30").cast("date"), serial))
    )


def parse_amount(col: Column) -> Column:
    """A signed number; brackets or a trailing DR turn the sign, commas group thousands or stand for the point."""
    return once(F.trim(col.cast("string")), _amount)


#: Amounts that need no more than their commas and brackets taken off.
_PLAIN = r"^(?:[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?|\([+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?\))\z"


def _amount(t: Column) -> Column:
    plain = F.translate(t, "(,)", "").try_cast("double")
    return F.when(t.rlike(_PLAIN), F.when(t.startswith("("), -plain).otherwise(plain)).otherwise(_odd_amount(t))


def _odd_amount(t: Column) -> Column:
    boxed = t.rlike(r"^\(.*\)$")
    t = F.when(boxed, F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    turned = boxed | t.rlike("(?i)" + ascii_edges(r"\bdr\b\.?$"))
    bare = F.regexp_replace(F.regexp_replace(t, "(?i)" + ascii_edges(r"\b(cr|dr)\b\.?"), ""), r"[^0-9.,+-]", "")
    number = F.when(bare.rlike(r",\d{3}(\D|$)|\d,\d{3}"), F.regexp_replace(bare, ",", "")).otherwise(F.regexp_replace(bare, ",", "."))
    value = F.nullif(F.regexp_extract(number, r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1), F.lit("")).try_cast("double")
    return F.when(turned, -value).otherwise(value)


def extract_party(narrative: Column) -> Column:
    """The counterparty that a narrative names, by seven patterns in order; null when there is none."""
    n = F.trim(F.regexp_replace(narrative, r"[\s ]+", " "))
    got = lambda pattern, k=1: F.nullif(F.regexp_extract(n, "(?i)" + pattern, k), F.lit(""))
    masked = r"(?i)^[0-9X\s.-]+$"
    insta = got(r"instapay[^:]*:\s*\d+\s*[-–]\s*([0-9X]{4,})")
    said = F.trim(got(r"transfer\s+from[:\s]+(?:[0-9X]{5,}\s+)?([A-Z][A-Za-z .'-]{3,40})"))
    sender = F.trim(F.regexp_replace(said, r"[.,#|].*$", ""))
    sender = F.when((F.length(sender) >= 4) & ~matches(said, "stop_name") & ~sender.rlike(masked), F.substr(sender, F.lit(1), F.lit(40)))
    account = F.coalesce(got(r"transfer\s+(?:from|to)[:\s]+([0-9X]{4,})"), got(r"account transfer\s+(?:from|to)\s+([0-9X]{4,})"), got(r"operations\s+to\s+#\s*([0-9X]{4,})"))
    swift = F.trim(got(r"swift[^|]*\|[^|]*KWD\s*,\s*([A-Z][A-Za-z .'-]{2,40}?)\s*\|"))
    swift = F.when((F.length(swift) >= 3) & ~matches(swift, "stop_name") & ~swift.rlike("(?i)^(normal|kwd|usd|eur)$") & ~swift.rlike(masked), F.substr(swift, F.lit(1), F.lit(40)))
    lines = F.transform(F.split(narrative, r"\r?\n"), lambda x: F.trim(x))
    head = F.get(lines, F.lit(0))
    shop = F.when(head.rlike(r"(?i)^POS\s*PRCH") & (F.size(lines) > 1), F.get(lines, F.lit(1))).otherwise(F.nullif(F.regexp_extract(head, r"(?i)^POS-(.{3,})$", 1), F.lit("")))
    shop = F.trim(F.get(F.split(shop, r"\s{2,}"), F.lit(0)))
    shop = F.when((F.length(shop) >= 4) & shop.rlike("[A-Za-z]{3}") & ~matches(shop, "stop_name") & ~shop.rlike("(?i)^(purchase|kuwait|kwt|visa|mastercard|knet)$"), F.substr(shop, F.lit(1), F.lit(40)))
    return F.coalesce(F.concat(F.lit("InstaPay "), insta), sender, F.concat(F.lit("Account "), account), swift, shop)


def with_party(rows: DataFrame, narrative: str) -> DataFrame:
    """``rows`` with ``_party``, the counterparty that each narrative names; each is read once, however many rows have it."""
    known = rows.select(F.col(narrative).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    known = cut(known.withColumn("_party", extract_party(F.col("_text"))), "parties-named")
    return rows.join(known, F.col(narrative) == F.col("_text"), "left").drop("_text")
