"""Scalar helpers as column expressions: security codes, dates, units, safe numbers and text cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ingest_ts_code(code: Column) -> Column:
    """Bare code to ts_code when landing data: 6 is SH, 8 and 4 are BJ, others SZ; null unless six digits."""
    c = F.trim(code)
    suffix = F.when(c.startswith("6"), ".SH").when(c.startswith("8") | c.startswith("4"), ".BJ").otherwise(".SZ")
    return F.when(c.rlike(r"^\d{6}$"), F.concat(c, suffix))


def app_ts_code(code: Column) -> Column:
    """Bare code to ts_code in the application: 5 is SH too; what is not six characters long stays as it is."""
    suffix = F.when(code.rlike("^[65]"), ".SH").when(code.rlike("^[84]"), ".BJ").otherwise(".SZ")
    return F.when(F.length(code) == 6, F.concat(code, suffix)).otherwise(code)


def bare_code(ts_code: Column) -> Column:
    return F.split_part(ts_code, F.lit("."), F.lit(1))


def instrument(ts_code: Column) -> Column:
    """``600000.SH`` to ``SH600000``; a code without a dot stays."""
    return F.when(ts_code.contains("."), F.concat(F.split_part(ts_code, F.lit("."), F.lit(2)), bare_code(ts_code))).otherwise(ts_code)


def from_instrument(name: Column) -> Column:
    """``SH600000`` back to ``600000.SH``; other shapes stay."""
    n = F.upper(F.trim(name))
    return F.when(n.rlike(r"^(SH|SZ|BJ)\d{6}$"), F.concat(F.substring(n, 3, 6), F.lit("."), F.substring(n, 1, 2))).otherwise(n)


def storage_code(code: Column) -> Column:
    """Upper-cased and trimmed; a dotted code is kept, a bare one gets the application's suffix."""
    c = F.upper(F.trim(code))
    return F.when(c.contains("."), c).otherwise(app_ts_code(c))


def hk_code(code: Column) -> Column:
    """Hong Kong codes: digits only, padded to five places."""
    d = F.regexp_replace(F.upper(F.trim(code)), r"^HK|\.HK$", "")
    return F.when(d.rlike(r"^\d{1,5}$"), F.lpad(d, 5, "0")).otherwise(d)


def looks_like_etf(code: Column) -> Column:
    return bare_code(code).rlike(r"^(15|16|18|50|51|52|56|58)\d{4}$")


def any_date(text: Column) -> Column:
    """A date from ``YYYYMMDD``, ``YYYY-MM-DD`` or a timestamp text; null if it is none of them."""
    t = F.trim(text)
    return F.coalesce(F.try_to_date(F.when(t.rlike(r"^\d{8}$"), t), "yyyyMMdd"), F.try_to_date(F.when(t.rlike(r"^\d{4}-\d\d-\d\d"), F.substring(t, 1, 10)), "yyyy-MM-dd"))


def bucket_start(ts: Column, minutes: int) -> Column:
    """The start of the bucket of so many minutes, counted from midnight."""
    day = F.date_trunc("day", ts)
    passed = F.unix_timestamp(ts) - F.unix_timestamp(day)
    return F.timestamp_seconds(F.unix_timestamp(day) + F.floor(passed / (60 * minutes)) * (60 * minutes))


def li_to_yuan(price: Column) -> Column:
    return price / 1000.0


def hand_to_share(volume: Column) -> Column:
    return volume * 100


def wan_to_yuan(amount: Column) -> Column:
    return amount * 10000


def json_rating(doc: Column, *paths: str) -> Column:
    """The first JSON path with a value."""
    return F.coalesce(*(F.get_json_object(doc, p) for p in paths))


def safe_float(text: Column) -> Column:
    """A number from text with thousands separators or a percent sign; null for anything else."""
    return F.regexp_replace(F.trim(text), "[,%]", "").try_cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def comma_list(text: Column) -> Column:
    """The trimmed, non-empty parts of a comma list."""
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def ordered_concat(values: Column, sep: str = ",") -> Column:
    """An aggregate: distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(values)), sep)


def cut(text: Column, length: int, mark: str = "...") -> Column:
    """The text, cut to a length with a mark where it was longer."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))).otherwise(text)
