"""Lists, rates, patterns, thresholds and the rule table of the scoring model."""

from __future__ import annotations

from dataclasses import dataclass

# Rates to KWD.
FX_TO_KWD = {
    "KWD": 1.0, "KD": 1.0, "USD": 0.307, "EUR": 0.334, "GBP": 0.388, "SAR": 0.0819, "AED": 0.0836, "QAR": 0.0843,
    "BHD": 0.814, "OMR": 0.798, "EGP": 0.0063, "INR": 0.0037, "PKR": 0.0011, "PHP": 0.0053, "LKR": 0.001,
    "BDT": 0.0026, "NPR": 0.0023, "JOD": 0.433, "TRY": 0.0075, "CNY": 0.0424, "JPY": 0.002,
}

# Countries under a call for action, and under increased monitoring.
BLACK_LIST = ("IRAN", "IR", "NORTH KOREA", "DPRK", "KP", "MYANMAR", "MM")
GREY_LIST = (
    "SYRIA", "SY", "YEMEN", "YE", "SOUTH SUDAN", "SS", "DR CONGO", "DRC", "CD", "HAITI", "HT", "VENEZUELA", "VE",
    "MONACO", "MC", "CROATIA", "HR", "MALI", "ML", "MOZAMBIQUE", "MZ", "NAMIBIA", "NA", "NIGERIA", "NG",
    "BURKINA FASO", "BF", "CAMEROON", "CM", "VIETNAM", "VN", "ALGERIA", "DZ", "ANGOLA", "AO", "COTE D'IVOIRE", "CI",
    "LEBANON", "LB", "BULGARIA", "BG",
)

# Name patterns of banks, by file text and by BIC.
FILENAME_BANKS = (
    ("بوبيان|boubyan", "Boubyan Bank"),
    (r"الوطني|\bnbk\b", "National Bank of Kuwait"),
    (r"بيتك|التمويل|\bkfh\b", "Kuwait Finance House"),
    ("الخليج|gulf", "Gulf Bank"),
    (r"التجاري|commercial|\bcbk\b", "Commercial Bank of Kuwait"),
    ("الأهلي|الاهلي|ahli", "Al Ahli Bank of Kuwait"),
    ("برقان|burgan", "Burgan Bank"),
    ("وربة|warba", "Warba Bank"),
)
BIC_BANKS = (
    ("BOUB", "Boubyan Bank"), ("NBOK|NBKK", "National Bank of Kuwait"), ("KFIN|KFHK", "Kuwait Finance House"), ("GULB", "Gulf Bank"),
    ("CBKU|COMB", "Commercial Bank of Kuwait"), ("ABKK", "Al Ahli Bank of Kuwait"), ("BRGN|BURG", "Burgan Bank"),
    ("KWIB", "Kuwait International Bank"), ("WRBA|WARB", "Warba Bank"),
)

# Patterns of narratives. \b is an ASCII word boundary; see narrative.matches.
PATTERNS = {
    "cash_deposit": r"cash\s?dep|cdm|cash in|deposit.*cash|إيداع نقد|ايداع نقد|ايداع كاش",
    "deposit": r"deposit|إيداع|ايداع",
    "atm": r"\batm\b|cash\s?w(?:ithdrawal|d)|\bcwd\b|\bwdl\b|سحب نقدي|سحب الي|سحب آلي",
    "withdrawal": r"withdraw|سحب",
    "salary": r"salary|payroll|راتب|رواتب|wages",
    "pos": r"\bpos\b|point of sale|knet|purchase|مشتريات|نقطة بيع",
    "cheque": r"cheque|chq|\bcheck\b|شيك",
    "fee": r"\bfee\b|charge|commission|\bcomm\b|عمولة|رسوم|svc chg|service chg",
    "interest": r"interest|profit share|murabaha|dividend|فوائد|فائدة|أرباح|ارباح",
    "transfer": r"transfer|\btrf\b|\btt\b|swift|wire|remit|instapay|insta pay|instant pay|\biban\b|حوالة|تحويل|مناقلة",
    "self": r"own account|own transfer|self|same customer|بين حساباته|حسابه الآخر|تحويل ذاتي|لنفس العميل",
    "cash": r"cash|نقد",
    "crypto": r"\b(binance|usdt|usdc|btc|eth\b|bitcoin|ethereum|crypto|digital currency|virtual currency|coinbase|kraken|kucoin|okx|bybit|bitoasis|rain exchange|nft)\b",
    "vague": r"^(transfer|trf|payment|pmt|misc|general|other|deposit|credit|debit|حوالة|تحويل|دفعة|ايداع|إيداع|مبلغ|عام)\.?$",
    "stop_name": r"^(from|fro|ref|kwd|usd|eur|through|via|the|own|self|transfer|to)\b",
}

# Words of headers that tell a table's head from other rows.
DATE_WORDS, AMOUNT_WORDS = "date", "amount|debit|credit|balance"
OTHER_WORDS = r"desc|narrat|remark|detail|particular|type|account|currency|reference|country|bank|name|code|num\b"

# What a header must hold, must also hold and must not hold for a role; a role's rows are tried in order, and
# the roles claim their headers in this order.
COLUMN_ROLES = (
    ("indicator", r"^(d c|dc|d/c|dr cr|drcr|c d|cd)$|\bdc\b|indicator.*d|d.*indicator|debit.*credit|credit.*debit", "", "^$"),
    ("kwd", r"amount|amnt|value", r"(\bcv\b|\bkd\b|kwd|local|equiv|counter)", "^$"),
    ("debit", "debit", "", "credit|card|date"),
    ("credit", "credit", "", "debit|card|date"),
    ("amount", r"(^|\s)(amount|amnt|amt)(\s|$)|transaction amount|trans amount|txn amount", "", "fee|charge"),
    ("date", r"(operation|transaction|trans|txn|post|posting|entry|process)\s?date", "", "^$"),
    ("date", "date", "", "value date|birth|maturity|expiry"),
    ("date", "value date", "", "^$"),
    ("balance", r"balance|\bbal\b", "", "available"),
    ("balance", "balance", "", "^$"),
    ("currency", r"currenc|\bccy\b|\bcurr\b", "", "^$"),
    ("account", r"(account|acct|\bac\b|acc)\s?(num|no|number|id)|iban", "", "^$"),
    ("account", "^account$", "", "^$"),
    ("code", r"(tran|trans|transaction|txn|operation)\s?code|^code$", "", "^$"),
    ("from_name", r"(from|order|sender|payer|remit)[a-z ]*name", "", "^$"),
    ("to_name", r"(to|benef|receiv|payee)[a-z ]*name", "", "^$"),
    ("name", r"counterpart|benefic|payee|payer|second party|^(?!.*(account name|customer name|file name|bank name|holder)).*name", "", "^$"),
    ("from_bank", r"(from|order|sender|remit)[a-z ]*(bank|bic|swift)", "", "^$"),
    ("to_bank", r"(to|benef|receiv)[a-z ]*(bank|bic|swift)", "", "^$"),
    ("bank", r"(bank|bic|swift)", "", "date|amount"),
    ("from_country", r"(from|order|sender|remit)[a-z ]*countr", "", "^$"),
    ("to_country", r"(to|benef|receiv)[a-z ]*countr", "", "^$"),
    ("country", "countr", "", "^$"),
    ("type", r"(transaction|trans|txn)?\s?type$", "", "code"),
    ("type", "^transaction$|^operation$", "", "^$"),
)
NARRATIVE_HEADERS = "desc|narrat|remark|detail|particular|purpose|memo|statement text"

# What an indicator or a type column says of the direction.
CREDIT_VALUES, DEBIT_VALUES = r"^(c|cr|credit|dep|deposit|in)$|credit|إيداع|دائن", r"^(d|dr|debit|wd|withdrawal|out)$|debit|سحب|مدين"
CREDIT_TYPES, DEBIT_TYPES = "credit|دائن", "debit|مدين"

# Words that a party's name may begin or end with.
HONORIFICS = ("MR", "MRS", "MS", "DR", "ENG", "SHEIKH", "SHAIKH", "SAYED", "SAYYID", "SYED")
LEGAL_SUFFIXES = ("CO", "COMPANY", "EST", "ESTABLISHMENT", "LLC", "WLL", "KSC", "KSCC", "KSCP", "SAL", "FZE", "FZC", "LTD", "LIMITED", "INC", "CORP", "SPC", "SARL")


# Words of listed names that never make a match of their own.
NON_DISTINCTIVE = ("AND", "THE", "FOR", "OF", "BIN", "IBN", "ABU", "ABD", "UMM", "GENERAL", "TRADING", "INTERNATIONAL", "GROUP")


@dataclass(frozen=True)
class Thresholds:
    """Numbers that a run may change."""

    cash_limit: float = 3000.0
    near_low: float = 2400.0
    prior: float = 0.02
    probability_cap: float = 0.97
    residual_cap: float = 0.9


@dataclass(frozen=True)
class Rule:
    rule_id: str
    family: str
    weight: float
    floor: float


# Weights (log likelihood ratios) and floors of the rules, in their order.
RULES = (
    Rule("R-STRUCT-01", "structuring", 1.1, 0.25),
    Rule("R-STRUCT-02", "structuring", 1.4, 0.35),
    Rule("R-STRUCT-03", "structuring", 0.8, 0.15),
    Rule("R-SMURF-01", "structuring", 0.9, 0.2),
    Rule("R-LAYER-01", "layering", 1.0, 0.3),
    Rule("R-LAYER-02", "layering", 0.9, 0.2),
    Rule("R-LAYER-03", "layering", 1.2, 0.35),
    Rule("R-CIRC-01", "layering", 0.7, 0.12),
    Rule("R-CASH-01", "cash", 1.1, 0.3),
    Rule("R-CASH-02", "cash", 0.5, 0.08),
    Rule("R-GEO-01", "geo", 0.9, 0.2),
    Rule("R-VEL-01", "temporal", 0.6, 0.1),
    Rule("R-DORM-01", "temporal", 0.8, 0.18),
    Rule("R-NARR-01", "narrative", 0.5, 0.08),
    Rule("R-FUNNEL-01", "network", 1.0, 0.25),
    Rule("R-VA-01", "R-VA-01", 0.6, 0.12),
    Rule("R-BENF-01", "statistical", 0.4, 0.05),
)

# The features in their order, by which equal ones are admitted as evidence.
FEATURE_KEYS = (
    "total_turnover_kwd", "income_multiple", "cash_share", "cash_to_income_peak", "near_threshold_density", "same_day_multibank_cash_days", "aggregate_threshold_evasion",
    "bank_fragmentation_index", "round_number_share", "benford_mad", "pass_through_ratio", "dwell_median_days", "quick_out_share", "relay_chain_count", "internal_circulation_share",
    "velocity_burst_z", "dormancy_reactivation", "weekend_share", "structural_break_factor", "counterparty_concentration_hhi", "fan_in_count", "high_risk_geo_share",
    "narrative_vagueness_share", "unexplained_inflow_share", "crypto_exposure_count",
)

# The rule that already counts a feature's signal.
COVERED_BY = {
    "near_threshold_density": "R-STRUCT-01", "same_day_multibank_cash_days": "R-STRUCT-02", "aggregate_threshold_evasion": "R-STRUCT-03",
    "bank_fragmentation_index": "R-SMURF-01", "pass_through_ratio": "R-LAYER-01", "quick_out_share": "R-LAYER-02",
    "dwell_median_days": "R-LAYER-02", "relay_chain_count": "R-LAYER-03", "internal_circulation_share": "R-CIRC-01",
    "cash_to_income_peak": "R-CASH-01", "income_multiple": "R-CASH-01", "cash_share": "R-CASH-01", "round_number_share": "R-CASH-02",
    "high_risk_geo_share": "R-GEO-01", "velocity_burst_z": "R-VEL-01", "dormancy_reactivation": "R-DORM-01",
    "narrative_vagueness_share": "R-NARR-01", "unexplained_inflow_share": "R-NARR-01", "benford_mad": "R-BENF-01",
    "fan_in_count": "R-FUNNEL-01", "counterparty_concentration_hhi": "R-FUNNEL-01", "crypto_exposure_count": "R-VA-01",
}
