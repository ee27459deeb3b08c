"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. Kinds: email, ip, card, phone, and, beyond these four, iban (kept
when its remainder by 97 is 1) and ssn (kept when a context word stands nearby). A span has
code points [start, end) and a score: the kind's base, plus ``NEAR_BONUS`` when one of the
kind's context words lies within ``NEAR`` code points. Kinds of the first four stay whatever
their score; the others need ``threshold``.

Patterns are possessive and may only start where an earlier start could not reach the same
place, which finds the same leftmost matches without quadratic scans of long runs. Spans get
their places by running sums over all of a text's parts, so n spans take n log n steps.

Defined results: a null or empty text has no spans. Repeated rows each get a row. Null ids
stay. Empty tables give empty results. Other columns are left alone; names that begin with
``_p_`` are used for scratch columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrock.llm.text import lower_ascii, table

NEAR, NEAR_BONUS, THRESHOLD = 40, 0.3, 0.5
#: Code points in a block of a text.
BLOCK = 256
SPAN = "struct<kind:string,start:int,end:int,score:double>"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"

#: kind: pattern, what must be in the text at all, base score, context words.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "address|host|server|login"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "[0-9]{2}|[0-9][ -][0-9]", 0.8, "card|visa|credit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|tel|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.9, "iban|account|bank"),
    "ssn": (r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.3, "ssn|social|security|tax"),
}
BASE_KINDS = ("email", "ip", "card", "phone")


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether a number's digits pass: every second one from the right counts twice, less 9 if over 9."""
    figures = F.transform(F.split(F.reverse(digits(match)), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    worth = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(worth, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1."""
    bare = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda s, c: F.when(c == "", s).otherwise((s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.length(bare).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), step) == 1)


CHECKS = {
    "ip": lambda m: m.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"),
    "card": lambda m: F.when(F.length(digits(m)).between(16, 19), luhn(m)).otherwise(False),
    "phone": lambda m: F.length(digits(m)).between(8, 15),
    "iban": mod97,
}


def running(values: Column, join) -> Column:
    """For each place ``join`` of all values up to it, by doubled steps: n log n calls for n values."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    reach = lambda k: F.pow(F.lit(2), k).cast("int")
    return F.aggregate(steps, values, lambda done, k: F.transform(done, lambda x, i: F.when(i >= reach(k), join(x, F.get(done, i - reach(k)))).otherwise(x)))


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points, so that a part of it can be read without walking all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part_of(blocks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.substr(some, start - first * BLOCK + 1, end - start)


def spans_of(kind: str, clean: str, blocks: str, threshold: float) -> Column:
    """Accepted spans of one kind, by start. ``clean`` holds no \\x01 or \\x02 and has the text's length."""
    pattern, trigger, base, words = KINDS[kind]
    parts = F.split(F.regexp_replace(clean, pattern, "\x01$0\x02"), "[\x01\x02]")  # outside, match, outside, ...
    ends = running(F.transform(parts, F.length), lambda a, b: a + b)

    def span(x: Column, i: Column) -> Column:
        part, end = x["part"], x["end"]
        start = end - F.length(part)
        near = F.concat(part_of(F.col(blocks), F.greatest(start - NEAR, F.lit(0)), start), F.lit(" "), part_of(F.col(blocks), end, end + NEAR))
        score = F.lit(base) + F.when(lower_ascii(near).rlike(rf"(?<![a-z])(?:{words})"), NEAR_BONUS).otherwise(0.0)
        good = CHECKS[kind](part) if kind in CHECKS else F.lit(True)
        if kind not in BASE_KINDS:
            good = F.when(good, score >= threshold).otherwise(False)
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))
        return F.when((i % 2 == 1) & good, one)

    placed = F.zip_with(parts, ends, lambda part, end: F.struct(part.alias("part"), end.alias("end")))
    return F.when(F.col(clean).rlike(trigger), F.filter(F.transform(placed, span), lambda s: s.isNotNull())).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``spans``, an array of (kind, start, end, score) by kind as listed, then start."""
    df = docs.withColumn("_p_clean", F.translate(F.coalesce(F.col(text), F.lit("")), "\x01\x02", "\x03\x03"))
    df = df.withColumn("_p_blocks", blocks_of(F.col("_p_clean")))
    df = df.withColumns({f"_p_{k}": spans_of(k, "_p_clean", "_p_blocks", threshold) for k in KINDS})
    return df.withColumn("spans", F.concat(*[f"_p_{k}" for k in KINDS])).drop("_p_clean", "_p_blocks", *[f"_p_{k}" for k in KINDS])


def let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by ``[KIND]`` of its first span."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def joined(x: Column) -> Column:
        # a run begins where no earlier span reaches; up to there its predecessor reached
        begins = F.transform(x["ordered"], lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.when(i > 0, F.get(x["reach"], i - 1)).otherwise(0).alias("from")))
        begins = F.filter(begins, lambda r: (r["from"] <= r["start"]))
        pieces = F.transform(begins, lambda r: F.concat(part_of(x["blocks"], r["from"], r["start"]), F.lit("["), F.upper(r["kind"]), F.lit("]")))
        return F.concat(F.array_join(pieces, ""), part_of(x["blocks"], F.array_max(x["reach"]), F.length(text)))

    reach = lambda o: running(F.transform(o, lambda s: s["end"]), F.greatest)
    with_reach = lambda o: F.struct(o.alias("ordered"), reach(o).alias("reach"), blocks_of(text).alias("blocks"))
    return F.when(F.size(spans) > 0, let(ordered, lambda o: let(with_reach(o), joined))).otherwise(text)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return df.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"))
