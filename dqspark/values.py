"""Fixed values shared by the operators.

Everything in this file is a lookup value that results depend on: word lists,
thresholds and labels.  Operators take them as defaults of parameters, so a
caller can pass their own.
"""

# --- fixed values: text read as "missing" by the CSV reader -----------------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- fixed values: the white space of Unicode and the separators 1c to 1f ---
WHITE_SPACE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: pairs of upper-cased texts that make a column boolean-like
# (the second of each pair is its negative value)
BOOLEAN_PAIRS = (
    ("TRUE", "FALSE"),
    ("YES", "NO"),
    ("Y", "N"),
    ("1", "0"),
    ("AVAILABLE", "NOT AVAILABLE"),
    ("ENABLED", "DISABLED"),
)

# --- fixed values: lower-cased texts read as true by detection rules --------
TRUE_TEXTS = ("true", "t", "yes", "y", "1")

# --- fixed values: separators of a list packed into one text ----------------
LIST_SEPARATORS = "[;,|>]|->"

# --- fixed values: exclusive options; name parts of the columns and the texts
# that count as "chosen"
EXCLUSIVE_OPTIONS = (
    (("window", "aisle"), ("Window", "Aisle")),
    (("window_seat", "aisle_seat"), ("true", "True", "Y", "Yes", "1")),
    (("seat_type",), ("Window,Aisle", "window,aisle", "Both")),
)

# --- fixed values: conflicting terms by column-name part --------------------
CONFLICTING_TERMS = (
    (("status", "booking_status", "flight_status"), ("cancelled", "confirmed")),
    (("active", "inactive"), ("true", "false")),
    (("available", "sold"), ("yes", "no")),
)

# --- fixed values: name parts of columns that must not be negative / extreme
NON_NEGATIVE_NAMES = ("price", "fare", "cost", "amount", "duration", "distance", "age")
EXTREME_NAMES = ("price", "fare", "cost")

# --- fixed values: name parts that pair a count column with a list column ---
COUNT_NAMES = ("count", "number", "num", "qty", "total", "size", "length")
LIST_NAMES = ("list", "items", "names", "details", "locations")

# --- fixed values: characters that make a text unusual ----------------------
SPECIAL_CHARACTERS = "@#$%&*"

# --- fixed values: words of a question that ask for an order ----------------
DESCENDING_WORDS = ("most", "highest", "top", "largest", "biggest", "max")
ASCENDING_WORDS = ("least", "lowest", "smallest", "min")

# --- fixed values: defaults of an issue without details ---------------------
UNKNOWN_CATEGORY = "unknown"
DEFAULT_SEVERITY = "medium"
DEFAULT_FIX = "Manual review required"
DEFAULT_SCORE = 85
CROSS_FIELD_CATEGORY = "cross-field relationship validation"

# --- fixed values: rename suggestions starting so are not names -------------
NO_NAME_PREFIX = "Use clear"

# --- fixed values: fill texts -----------------------------------------------
UNKNOWN_TEXT = "Unknown"
NOT_AVAILABLE_TEXT = "N/A"

# --- fixed values: thresholds and labels of the strategy suggestion ---------
HIGH_MISSING_PCT = 50
LOW_MISSING_PCT = 5
SKEW_LIMIT = 0.5
LOW_CARDINALITY = 0.1
SUGGESTIONS = {
    "drop": "Consider dropping column or using constant value",
    "median_low": "median (low missing rate)",
    "mode_low": "mode (low missing rate)",
    "mean": "mean (normally distributed)",
    "median_skewed": "median (skewed distribution)",
    "median_few": "median (safe choice)",
    "mode_text": "mode (categorical)",
    "constant": "constant value or consider advanced imputation",
    "datetime": "forward_fill or interpolate",
    "default": "mode (default)",
}

# --- fixed values: sizes ----------------------------------------------------
MAX_FLAGS = 63
MAX_LISTED_COMBINATIONS = 256
SAMPLE_ROWS = 150
CONTEXT_TURNS = 3
ANSWER_LENGTH = 300
MIN_SIMILARITY = 0.92

# --- fixed values: first and last line of a context text --------------------
CONTEXT_HEADER = "Previous Q&A (most recent first):"
CONTEXT_FOOTER = (
    "When the new question uses pronouns like 'this/that/these/it' or says 'same airline',"
    " interpret them using the most recent relevant Q&A above."
)

# Functions a stored rule may call: they look at the values of one row, give the
# same result each time and reach nothing outside it.
RULE_FUNCTIONS = frozenset("""
abs add_months array array_contains array_distinct array_except array_intersect array_join array_max array_min
array_position array_remove array_size array_sort between bit_count bround btrim cardinality cast ceil ceiling
char_length character_length coalesce concat concat_ws contains date date_add date_diff date_format date_part
date_sub date_trunc datediff day dayname dayofmonth dayofweek dayofyear div double element_at elt endswith equal_null
exists exp extract filter float floor forall format_number from_unixtime get greatest hour if ifnull ilike initcap
instr int isnan isnotnull isnull last_day lcase least left len length levenshtein like ln locate log log10 log2 lower
lpad ltrim make_date map_contains_key map_keys map_values md5 minute mod month monthname months_between nanvl next_day
not nullif nullifzero nvl nvl2 octet_length overlay pmod positive position pow power quarter regexp regexp_count
regexp_extract regexp_extract_all regexp_instr regexp_like regexp_replace repeat replace reverse right rint rlike round
rpad rtrim second sequence sha2 sign signum size slice soundex split split_part sqrt startswith string struct substr
substring substring_index timestamp timestampdiff timestampadd to_date to_number to_timestamp transform translate trim
try_add try_divide try_element_at try_multiply try_subtract try_to_date try_to_number try_to_timestamp typeof ucase
unix_date unix_micros unix_millis unix_seconds unix_timestamp upper weekday weekofyear width_bucket xxhash64 year
zeroifnull to_timestamp_ntz to_timestamp_ltz timestamp_micros timestamp_millis timestamp_seconds negative aggregate
zip_with arrays_overlap collate character_length
""".split())
