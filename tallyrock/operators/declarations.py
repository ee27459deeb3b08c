"""Self-reported wealth forms, read to typed items and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The sections of a form, and which of its fields is which column of an item.
SECTION_FIELDS = {
    "minorChildren": {"label": "name", "kind": "relation", "id_type": "idType", "id_number": "idNumber", "date_text": "dateOfBirth"},
    "realEstate": {"owner_name": "ownerName", "label": "location", "kind": "propertyType", "area_sqm": "areaSqm", "ownership_pct": "ownershipPct"},
    "usufructRights": {"owner_name": "beneficiaryName", "label": "location", "kind": "usageType", "area_sqm": "areaSqm"},
    "securities": {"owner_name": "ownerName", "label": "company", "kind": "instrumentType", "country": "companyCountry", "quantity": "quantityOrPct", "listed": "listed"},
    "bankAccountsAndDeposits": {"owner_name": "ownerName", "label": "institution", "kind": "kind", "country": "institutionCountry", "value": "valueKwd"},
    "debtsOwed": {"owner_name": "debtorName", "label": "creditor", "country": "creditorCountry", "value": "amountKwd", "date_text": "finalRepaymentDate"},
    "valuableMovables": {"owner_name": "ownerName", "label": "description", "item_count": "count", "value": "totalValueKwd"},
}
# The form's printed examples: the owner, a company, and the cells of each example row.
EXAMPLE_OWNER, EXAMPLE_COMPANY, EXAMPLE_CHILDREN = "أحمد محمد فهد", "أولاد محمد فهد", ("خالد", "بدر")
EXAMPLE_CELLS = (
    ("realEstate", {"label": "حطين", "area_sqm": 500, "ownership_pct": 50}),
    ("realEstate", {"label": "لندن", "area_sqm": 200, "ownership_pct": 25}),
    ("usufructRights", {"label": "الجليعة", "area_sqm": 2000}),
    ("usufructRights", {"label": "الفحيحيل", "area_sqm": 500}),
    ("securities", {"label": "زين", "quantity": ("2000",), "kind": "اسهم"}),
    ("securities", {"quantity": ("50%", "50"), "kind": "حصة"}),
    ("bankAccountsAndDeposits", {"label": "الوطني", "value": 10000, "kind": "حساب"}),
    ("bankAccountsAndDeposits", {"label": "بوبيان", "value": 50000, "kind": "وديعة"}),
    ("debtsOwed", {"label": "الوطني", "value": 15000}),
    ("debtsOwed", {"label": "الائتمان", "value": 60000}),
    ("valuableMovables", {"label": "سيارات", "item_count": 2, "value": 25000}),
    ("valuableMovables", {"label": "ساعات", "item_count": 5, "value": 12000}),
)
CIVIL_ID_KIND = "مدنية"

NUMBERS, FLAGS = ("area_sqm", "ownership_pct", "value", "item_count"), ("listed",)
TEXTS = ("owner_name", "label", "kind", "country", "quantity", "date_text", "id_type", "id_number")
_EVERY = "uncertain:boolean,corrected:boolean,page:int,asWritten:string,alternates:array<string>,notes:string"
_KIND = lambda c: "double" if c in NUMBERS else "boolean" if c in FLAGS else "string"
SECTIONS = tuple(SECTION_FIELDS)
SCHEMA = (
    "case_id long, declarant struct<name:string,civil_id:string,phone:string,home_phone:string,work_phone:string,occupation:string,nationality:string,residence:string,salary:double>, sectionsMarkedNone array<string>, "
    + ", ".join(f"{name} array<struct<{','.join(f'{f}:{_KIND(c)}' for c, f in fields.items())},{_EVERY}>>" for name, fields in SECTION_FIELDS.items())
)


# The limits of what a form may say: rows of a section, characters of a text, and the ranges of numbers.
MOST_ROWS = {"minorChildren": 15, "realEstate": 25, "usufructRights": 25, "securities": 30, "bankAccountsAndDeposits": 30, "debtsOwed": 25, "valuableMovables": 25}
MOST_LETTERS = {"owner_name": 160, "kind": 80, "country": 80, "quantity": 60, "date_text": 40, "id_type": 60, "id_number": 60, "label": 200, "asWritten": 300, "notes": 240, "name": 160, "civil_id": 40, "phone": 40, "home_phone": 40, "work_phone": 40, "occupation": 160, "nationality": 80, "residence": 80}
RANGES = {"area_sqm": (0, 10_000_000), "ownership_pct": (0, 100), "value": (0, 100_000_000), "item_count": (0, 10_000), "salary": (0, 1_000_000), "page": (1, 500)}
MOST_ALTERNATES, MOST_TICKS = 4, 10

_PEOPLE = ("name", "civil_id", "phone", "home_phone", "work_phone", "occupation", "nationality", "residence", "salary")
#: The same shape with every value as it was written.
RAW = (
    f"case_id string, declarant struct<{','.join(f'{c}:string' for c in _PEOPLE)}>, sectionsMarkedNone array<string>, _broken string, "
    + ", ".join(f"{name} array<struct<{','.join(f'{f}:string' for f in fields.values())},uncertain:string,corrected:string,page:string,asWritten:string,alternates:array<string>,notes:string>>" for name, fields in SECTION_FIELDS.items())
)


def limited_text(col: Column, most: int) -> Column:
    return F.nullif(F.substr(F.trim(col), F.lit(1), F.lit(most)), F.lit(""))


def limited_number(col: Column, low: float, high: float) -> Column:
    """A number, or a text of one with Western or Arabic digits and groups of them; null where it is none or out of range."""
    n = F.regexp_replace(western_digits(col), r"[,\s\u066C\u060C]", "").try_cast("double")
    return F.when(n.between(low, high), n)


def _forms(spark: SparkSession, path: str) -> DataFrame:
    options = {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select("value", F.from_json("value", RAW, options).alias("f")).select("value", "f.*")


def read_declarations(spark: SparkSession, path: str) -> DataFrame:
    """Forms of ``SCHEMA`` from JSON, one in each line, coerced field by field; one bad field costs no other.

    Texts are trimmed and cut to their limits, numbers may be texts and are null out of range, sections
    keep as many rows as a form has room for. Lines that are no forms are in ``broken_declarations``.
    """
    def row(name: str, x: Column) -> Column:
        typed = []
        for c, f in SECTION_FIELDS[name].items():
            kind = _KIND(c)
            value = limited_number(x[f], *RANGES[c]) if kind == "double" else x[f].try_cast("boolean") if kind == "boolean" else limited_text(x[f], MOST_LETTERS[c])
            typed.append(value.alias(f))
        page = F.floor(limited_number(x["page"], *RANGES["page"]) + 0.5).cast("int")
        others = F.slice(F.filter(F.transform(x["alternates"], lambda t: limited_text(t, 200)), lambda t: t.isNotNull()), 1, MOST_ALTERNATES)
        marks = [F.coalesce(x[m] == "true", F.lit(False)).alias(m) for m in ("uncertain", "corrected")]
        return F.struct(*typed, *marks, page.alias("page"), limited_text(x["asWritten"], MOST_LETTERS["asWritten"]).alias("asWritten"), others.alias("alternates"), limited_text(x["notes"], MOST_LETTERS["notes"]).alias("notes"))

    person = F.struct(*[(limited_number(F.col(f"declarant.{c}"), *RANGES[c]) if c == "salary" else limited_text(F.col(f"declarant.{c}"), MOST_LETTERS[c])).alias(c) for c in _PEOPLE])
    shaped = lambda name: F.transform(F.slice(name, 1, MOST_ROWS[name]), lambda x: row(name, x)).alias(name)
    sections = [shaped(name) for name in SECTIONS]
    ticks = F.slice(F.filter(F.transform("sectionsMarkedNone", lambda t: limited_text(t, 60)), lambda t: t.isNotNull()), 1, MOST_TICKS)
    good = _forms(spark, path).where("_broken is null").withColumn("case_id", F.col("case_id").try_cast("long")).where("case_id is not null")
    return good.select("case_id", F.when(F.col("declarant").isNotNull(), person).alias("declarant"), ticks.alias("sectionsMarkedNone"), *sections)


def broken_declarations(spark: SparkSession, path: str) -> DataFrame:
    """(line) of lines that are no JSON or name no case."""
    return _forms(spark, path).where(F.col("_broken").isNotNull() | F.col("case_id").try_cast("long").isNull()).select(F.col("value").alias("line"))


def declaration_items(forms: DataFrame) -> DataFrame:
    """(case_id, section, row_index, typed columns, reading marks) of all sections; rows without a label go, others keep their index."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))

    def section(name: str) -> DataFrame:
        rows = forms.select("case_id", F.lit(name).alias("section"), F.posexplode(name).alias("row_index", "i"))
        made = {c: (clean(F.col(f"i.{f}")) if _KIND(c) == "string" else F.col(f"i.{f}")) for c, f in SECTION_FIELDS[name].items()}
        marks = [F.coalesce(F.col(f"i.{m}"), F.lit(False)).alias(m) for m in ("uncertain", "corrected")]
        rest = [F.col("i.page").alias("page"), clean(F.col("i.asWritten")).alias("as_written"), F.coalesce("i.alternates", F.array().cast("array<string>")).alias("alternates"), clean(F.col("i.notes")).alias("notes")]
        typed = [made.get(c, F.lit(None)).cast(_KIND(c)).alias(c) for c in (*TEXTS, *NUMBERS, *FLAGS)]
        return rows.select("case_id", "section", "row_index", *typed, *marks, *rest)

    out = section(SECTIONS[0])
    for name in SECTIONS[1:]:
        out = out.unionByName(section(name))
    return out.where("label is not null")


def declarants(forms: DataFrame) -> DataFrame:
    text = lambda c: F.nullif(F.trim(f"declarant.{c}"), F.lit("")).alias(c)
    return forms.select("case_id", *[text(c) for c in ("name", "civil_id", "phone", "home_phone", "work_phone", "occupation", "nationality", "residence")], "declarant.salary")


def profile_from_declaration(forms: DataFrame) -> DataFrame:
    d = declarants(forms)
    countries = declaration_items(forms).where(F.col("section").isin("securities", "bankAccountsAndDeposits", "debtsOwed")).groupBy("case_id").agg(F.sort_array(F.collect_set("country")).alias("held"))
    every = F.array_distinct(F.filter(F.concat(F.array("nationality", "residence"), F.coalesce("held", F.array().cast("array<string>"))), lambda c: c.isNotNull()))
    return d.join(countries, "case_id", "left").select("case_id", F.col("name").alias("subject_name"), "occupation", F.col("civil_id").alias("reference"), F.when(F.col("salary") > 0, F.col("salary")).alias("income"), every.alias("expected_countries"))


def section_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("case_id", "section").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("total"))


def western_digits(col: Column) -> Column:
    return F.translate(col, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def arabic_key(col: Column) -> Column:
    """Text with diacritics dropped, letter variants folded and separators as single blanks."""
    bare = F.regexp_replace(western_digits(col), "[ً-ْٰـ]", "")
    return F.lower(F.trim(F.regexp_replace(F.translate(bare, "أإآٱىةؤئ", "اااايهوي"), r"[\s\-_/.,:;()]+", " ")))


def form_date(col: Column) -> Column:
    """d/m/y or y/m/d as ISO; anything else is kept."""
    t = F.trim(western_digits(col))
    p = lambda pattern, k: F.regexp_extract(t, pattern, k)
    ymd, dmy = r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})$", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
    iso = F.when(t.rlike(ymd), F.concat_ws("-", p(ymd, 1), F.lpad(p(ymd, 2), 2, "0"), F.lpad(p(ymd, 3), 2, "0"))).when(t.rlike(dmy), F.concat_ws("-", p(dmy, 3), F.lpad(p(dmy, 2), 2, "0"), F.lpad(p(dmy, 1), 2, "0")))
    return F.when(F.try_to_date(iso, "yyyy-MM-dd").isNotNull(), iso).otherwise(t)


def civil_id(col: Column) -> Column:
    d = F.regexp_replace(western_digits(col), "[^0-9]", "")
    return F.when(F.length(d) == 12, d)


def kuwait_phone(col: Column) -> Column:
    d = F.regexp_replace(F.regexp_replace(western_digits(col), "[^0-9]", ""), "^(?:00)?965(?=[0-9]{8}$)", "")
    return F.when(F.length(d) == 8, d)


def misread_name(col: Column) -> Column:
    return F.coalesce(western_digits(col).rlike("[0-9A-Za-z]"), F.lit(False))


def two_options(col: Column) -> Column:
    return F.coalesce(col.rlike(r"(?i)/|(?<![A-Za-z])or(?![A-Za-z])|(^|\s)أو(\s|$)"), F.lit(False))


PLACEHOLDER = r"(?i)^\W*(illegible|unreadable|unclear|not (?:legible|clear|visible|provided)|n/?a|unknown|غير (?:واضح|مقروء))\W*$"


def scrub_placeholders(df: DataFrame, columns: list[str]) -> DataFrame:
    """Reader's notes become null; ``uncertain`` lists the columns they stood in."""
    noted = lambda c: F.coalesce(F.col(c).rlike(PLACEHOLDER), F.lit(False))
    marks = F.array_compact(F.array(*[F.when(noted(c), c) for c in columns]))
    df = df.withColumn("uncertain", marks)
    return df.withColumns({c: F.when(~noted(c), F.col(c)) for c in columns})


def is_example() -> Column:
    """Whether an item repeats one of the form's printed examples.

    The printed owner with two copied cells, or all of three or more copied cells, or a place
    holder that only examples have.
    """
    key = lambda c: arabic_key(F.coalesce(F.col(c), F.lit("")))
    has = lambda c, text: key(c).contains(arabic_key(F.lit(text)))
    owner = has("owner_name", EXAMPLE_OWNER)
    out = F.lit(False)
    for section, cells in EXAMPLE_CELLS:
        same = [has(c, v) if isinstance(v, str) else key(c).isin(*v) if isinstance(v, tuple) else F.coalesce(F.abs(F.col(c) - v) < 0.5, F.lit(False)) for c, v in cells.items()]
        hits = sum((x.cast("int") for x in same), F.lit(0))
        out = out | ((F.col("section") == section) & ((owner & (hits >= 2)) | (F.lit(len(same) >= 3) & (hits == len(same)))))
    marked = lambda c: F.coalesce(western_digits(F.col(c)).rlike("[xX×٭]{2,}"), F.lit(False))
    child = marked("id_number") | marked("date_text") | (has("label", EXAMPLE_OWNER) & (has("label", EXAMPLE_CHILDREN[0]) | has("label", EXAMPLE_CHILDREN[1])))
    out = out | ((F.col("section") == "minorChildren") & child) | ((F.col("section") == "securities") & has("label", EXAMPLE_COMPANY))
    return out | ((F.col("section") == "debtsOwed") & marked("date_text"))


def drop_example_rows(items: DataFrame) -> DataFrame:
    """Items without those copied from the form's printed examples."""
    return items.where(~is_example())


def flag_uncertain(people: DataFrame, first: str = "0123456789") -> DataFrame:
    """Declarants with implausible ids, phones and names marked, ids and phones cleaned, and a salary of 0 as null.

    A phone has eight digits, the first of them one of ``first``.
    """
    phones = [c for c in ("phone", "home_phone", "work_phone") if c in people.columns]
    bad = {"civil_id": F.col("civil_id").isNotNull() & civil_id(F.col("civil_id")).isNull(), "name": misread_name(F.col("name"))}
    bad |= {c: F.col(c).isNotNull() & ~F.coalesce(F.substring(kuwait_phone(F.col(c)), 1, 1).isin(*first), F.lit(False)) for c in phones}
    marks = F.array_compact(F.array(*[F.when(v, k) for k, v in bad.items()]))
    cleaned = {"civil_id": F.coalesce(civil_id(F.col("civil_id")), F.col("civil_id"))} | {c: F.when(bad[c], western_digits(F.col(c))).otherwise(F.col(c)) for c in phones}
    return people.withColumns({"uncertain": marks, "salary": F.when(F.col("salary") != 0, F.col("salary"))} | cleaned)


def flag_uncertain_items(items: DataFrame) -> DataFrame:
    """Items whose owner's or child's name, civil id or kind is implausible are marked; civil ids are cleaned."""
    name = F.when(F.col("section") == "minorChildren", F.col("label")).otherwise(F.col("owner_name"))
    civil = (F.col("section") == "minorChildren") & arabic_key(F.coalesce("id_type", F.lit(""))).contains(arabic_key(F.lit(CIVIL_ID_KIND))) & F.col("id_number").isNotNull()
    wrong = civil & civil_id(F.col("id_number")).isNull()
    two = F.col("section").isin("bankAccountsAndDeposits", "realEstate") & two_options(F.col("kind"))
    return items.withColumns({"uncertain": F.col("uncertain") | misread_name(name) | wrong | two, "id_number": F.when(civil & ~wrong, civil_id(F.col("id_number"))).otherwise(F.col("id_number"))})


def none_ticks(forms: DataFrame, items: DataFrame) -> DataFrame:
    """(case_id, section) of sections that were ticked as none; a tick beside rows that are left is dropped."""
    ticks = forms.select("case_id", F.explode(F.array_distinct("sectionsMarkedNone")).alias("section")).where(F.col("section").isin(*SECTIONS))
    return ticks.join(items.select("case_id", "section").distinct(), ["case_id", "section"], "left_anti")


def intake_queue(cases: DataFrame, disclosures: DataFrame, people: DataFrame) -> DataFrame:
    """Cases in intake with their disclosure, newest upload first."""
    df = cases.where("status = 'intake'").join(disclosures, "case_id").join(people.select("case_id", F.col("name").alias("declarant")), "case_id", "left")
    return df.orderBy(F.desc("uploaded_at"), "case_id")
