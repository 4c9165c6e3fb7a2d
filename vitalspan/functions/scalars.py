"""Column expressions: predicates, cleaning, dates, codes, labels. No Python UDFs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- predicates and branches ------------------------------------------------------------------------------


def if_else3(cond: Column, yes: Column, no: Column) -> Column:
    """Branch that stays unknown (NULL) when the condition is unknown."""
    return F.when(cond, yes).when(~cond, no)


def swap_if(cond: Column, x, y, null_keeps: bool = False) -> tuple[Column, Column]:
    """Exchange two columns where ``cond`` holds. An unknown condition blanks both unless ``null_keeps``."""
    x, y = _c(x), _c(y)
    if null_keeps:
        return F.when(cond, y).otherwise(x), F.when(cond, x).otherwise(y)
    return if_else3(cond, y, x), if_else3(cond, x, y)


def all_equal(columns: Sequence[str], value) -> Column:
    """True when every listed column equals ``value``."""
    return reduce(lambda a, b: a & b, [F.col(c) == F.lit(value) for c in columns])


def any_true(*conds: Column) -> Column:
    """Three-valued OR, with unknown read as false."""
    return F.coalesce(reduce(lambda a, b: a | b, conds), F.lit(False))


def matches_prefix(x, *patterns: str) -> Column:
    """Regular-expression match anchored at the start; the alternation is grouped before anchoring."""
    return _c(x).rlike("^(?:" + "|".join(patterns) + ")")


def between_or_unknown(x, lo, hi) -> Column:
    """Closed range test in which any unknown operand passes."""
    return F.coalesce(_c(x).between(_c(lo), _c(hi)), F.lit(True))


def recode(x, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Replace exact values; others stay as they are, or become ``default``."""
    x = _c(x)
    out = reduce(lambda acc, kv: acc.when(x == F.lit(kv[0]), F.lit(kv[1])), mapping.items(), F)
    return out.otherwise(x if default is None else default)


def recode_prefix(x, mapping: Mapping[str, object], default=None) -> Column:
    """First matching prefix decides; NULL and unmatched values become ``default``."""
    x = _c(x)
    out = reduce(lambda acc, kv: acc.when(x.startswith(kv[0]), F.lit(kv[1])), mapping.items(), F)
    return out.otherwise(F.lit(default))


# --- text ------------------------------------------------------------------------------------------------------


def extract(x, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, NULL when there is none."""
    return F.nullif(F.regexp_extract(_c(x), pattern, group), F.lit(""))


def split_feature(x) -> dict[str, Column]:
    """``group_name[_value]`` as three columns; missing parts are NULL."""
    x = _c(x)
    part = lambda i: F.nullif(F.split_part(x, F.lit("_"), F.lit(i)), F.lit(""))
    return {"fgroup": part(1), "fname": part(2), "fvalue": part(3)}


def feature_stem(x) -> Column:
    """The ``group_name`` part of a feature, NULL without a name."""
    x = _c(x)
    return F.when(F.instr(x, "_") > 0, F.substring_index(x, "_", 2))


def normalise_code(code) -> Column:
    """Four-character codes get the unspecified leaf '9', longer ones are cut to five characters."""
    code = _c(code)
    return F.when(F.length(code) == 4, F.concat(code, F.lit("9"))).otherwise(F.substring(code, 1, 5))


# Roman numerals used by clinical classes.
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6}


def roman_to_int(x) -> Column:
    """Integer of the first Roman numeral in a text, NULL without one."""
    token = extract(x, "[IV]+")
    return reduce(lambda acc, kv: acc.when(token == kv[0], F.lit(kv[1])), ROMAN.items(), F)


def signed_fixed(x, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f", _c(x).cast("double"))


def estimate_label(estimate, lower, upper, digits: int = 1, bound_digits: int = 1) -> Column:
    """``+1.2 [-0.3; +2.7]``; NULL when any part is NULL."""
    return F.concat(
        F.when(_c(estimate).isNotNull(), signed_fixed(estimate, digits)), F.lit(" ["),
        F.when(_c(lower).isNotNull(), signed_fixed(lower, bound_digits)), F.lit("; "),
        F.when(_c(upper).isNotNull(), signed_fixed(upper, bound_digits)), F.lit("]"),
    )


# --- numbers ---------------------------------------------------------------------------------------------------


def clean_range(x, lo=None, hi=None) -> Column:
    """Values outside the closed range become NULL."""
    x = _c(x)
    keep = F.lit(True)
    if lo is not None:
        keep = keep & (x >= F.lit(lo))
    if hi is not None:
        keep = keep & (x <= F.lit(hi))
    return F.when(keep, x)


def rescale_above(x, limit: float, divisor: float) -> Column:
    """Unit repair: values above ``limit`` are divided."""
    x = _c(x)
    return if_else3(x > limit, x / F.lit(float(divisor)), x)


def cap(x, limit: float) -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), F.least(x, F.lit(float(limit))))


def min_max(x, lo, hi) -> Column:
    return (_c(x) - F.lit(float(lo))) / F.lit(float(hi) - float(lo))


def from_min_max(x, lo, hi) -> Column:
    return _c(x) * F.lit(float(hi) - float(lo)) + F.lit(float(lo))


def bounds_label(lo, hi, closed_low: bool = False) -> str:
    return f"{'[' if closed_low else '('}{lo:g},{hi:g}]"


def cut_breaks(x, breaks: Sequence[float], include_lowest: bool = False, labels: Sequence[str] | None = None) -> Column:
    """Right-closed bins with interval labels; outside the breaks (and on the first break) NULL."""
    x = _c(x)
    out = F
    for i, (lo, hi) in enumerate(zip(breaks, breaks[1:])):
        closed = include_lowest and i == 0
        above = x >= F.lit(float(lo)) if closed else x > F.lit(float(lo))
        text = labels[i] if labels else bounds_label(lo, hi, closed)
        out = out.when(above & (x <= F.lit(float(hi))), F.lit(text))
    return out.otherwise(F.lit(None).cast("string"))


def equal_width_bins(x, width: float, lo: float, hi: float) -> Column:
    """Right-closed bins of one width; the first bin includes its lower edge."""
    edges = [lo + i * width for i in range(int(round((hi - lo) / width)) + 1)]
    return cut_breaks(x, edges, include_lowest=True)


def censor_at(time, event, tau) -> tuple[Column, Column]:
    """Administrative censoring: ``(time, event)`` as observed when follow-up ends at ``tau``."""
    time, event = _c(time), _c(event)
    tau = _c(tau) if isinstance(tau, (str, Column)) else F.lit(tau)
    late = time > tau
    return F.when(late, tau).otherwise(time), F.when(late, F.lit(False)).otherwise(event)


# --- dates -----------------------------------------------------------------------------------------------------


def excel_serial_to_date(text) -> Column:
    """Spreadsheet serial day number (as text) to date; day 0 is 1899-12-30."""
    return F.date_add(F.lit("1899-12-30").cast("date"), _c(text).try_cast("int"))


def datetime_from_parts(day, hour=None, minute=None) -> Column:
    """Date plus hours and minutes; missing parts count as zero."""
    zero = F.lit(0)
    h = zero if hour is None else F.coalesce(_c(hour), zero)
    m = zero if minute is None else F.coalesce(_c(minute), zero)
    return _c(day).cast("timestamp_ntz") + F.make_dt_interval(zero, h, m, F.lit(0).cast("decimal(18,6)"))


def parse_ymd_hm(text) -> Column:
    """Text ``yyyy-mm-dd hh:mm`` to a timestamp without time zone; NULL when it does not parse."""
    return _c(text).try_cast("timestamp_ntz")


def elapsed_days(start, end) -> Column:
    """Days from ``start`` to ``end`` with the fraction kept (timestamps)."""
    micros = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    return micros / F.lit(86_400_000_000.0)


def age_years(born, at) -> Column:
    """Calendar-exact age: full anniversaries plus the share of the running year, two decimals."""
    born, at = _c(born), _c(at)
    years = F.year(at) - F.year(born)
    full = F.when(F.add_months(born, years * 12) > at, years - 1).otherwise(years)
    last, following = F.add_months(born, full * 12), F.add_months(born, (full + 1) * 12)
    return F.round(full + F.datediff(at, last) / F.datediff(following, last), 2)


def age_days_at(age_at_index, index_date, event_date) -> Column:
    """Age in days at an event, from the age in years at the index date (rounded to whole days)."""
    return F.round(_c(age_at_index) * F.lit(365.25)).cast("bigint") + F.datediff(_c(event_date), _c(index_date))
