"""Column expressions for one cell: tests, coercions and the cleaning rewrites."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tallywork.functions import fixed

NUMERIC = (T.NumericType,)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_number(dtype: T.DataType) -> bool:
    """Booleans count as numbers, as they do in role discovery."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def dtype_of(df, column: str) -> T.DataType:
    return df.schema[column].dataType


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def number(c: Column) -> Column:
    """The cell as a number, or null; never an error. NaN counts as missing."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def text(c: Column) -> Column:
    return c.cast("string")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(fixed.WHITE_SPACE))


def undecorated(c: Column) -> Column:
    """Number left after dropping everything but digits, dots and minus signs."""
    plain = number(text(c))
    return F.coalesce(plain, number(F.regexp_replace(text(c), fixed.DECORATION, "")))


def timestamp(c: Column) -> Column:
    tries = [F.try_to_timestamp(text(c), F.lit(f)) for f in fixed.DATE_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def seconds(c: Column) -> Column:
    """Seconds on the wall clock since 1970, whatever the session's time zone."""
    clock = F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")
    return F.unix_date(c.cast("date")) * 86400.0 + F.coalesce(clock, F.lit(0.0))


# ---------------------------------------------------------------------------- tests


def has_currency(c: Column, pattern: str = fixed.CURRENCY_CLEAN) -> Column:
    return F.coalesce(text(c).rlike(pattern), F.lit(False))


def starts_free(c: Column) -> Column:
    return F.coalesce(F.lower(strip(text(c))).startswith("free"), F.lit(False))


def is_number_word(c: Column) -> Column:
    words = F.lower(strip(text(c))).isin(fixed.DETECTED_NUMBER_WORDS)
    return F.coalesce(words, F.lit(False))


def is_vague(c: Column) -> Column:
    return F.coalesce(strip(text(c)).rlike(fixed.VAGUE_CELL), F.lit(False))


def is_vague_word(c: Column) -> Column:
    return F.coalesce(F.lower(strip(text(c))).isin(fixed.VAGUE_WORDS), F.lit(False))


def has_embedded_text(c: Column) -> Column:
    return F.coalesce(text(c).rlike(fixed.EMBEDDED_TEXT), F.lit(False))


def is_finished(c: Column) -> Column:
    return F.coalesce(F.lower(strip(text(c))).isin(fixed.FINISHED_WORDS), F.lit(False))


def same_value(a: Column, b: Column) -> Column:
    """Equal, both missing, or equal once both read as numbers ('80' and 80.0)."""
    def plain(c: Column) -> Column:
        return number(F.regexp_replace(text(c), ",", ""))

    equal = text(a).eqNullSafe(text(b))
    return equal | F.coalesce(plain(a) == plain(b), F.lit(False))


# ------------------------------------------------------------------------- rewrites


def number_text(c: Column) -> Column:
    """Text form of a matched number: whole numbers without a point, others as decimals."""
    whole = c.try_cast("decimal(38,0)").cast("string")
    return F.when(c.contains("."), c.try_cast("double").cast("string")).otherwise(whole)


def without_currency(c: Column) -> Column:
    bare = strip(F.regexp_replace(text(c), fixed.CURRENCY_CLEAN, ""))
    return F.when(bare != "nan", bare)


def first_number(c: Column) -> Column:
    found = F.regexp_replace(F.regexp_extract(text(c), fixed.FIRST_NUMBER, 0), ",", "")
    return F.when(text(c).rlike(fixed.FIRST_NUMBER), F.coalesce(number_text(found), c)).otherwise(c)


def _word_pattern() -> str:
    longest_first = sorted(fixed.NUMBER_WORDS, key=len, reverse=True)
    return r"\b(" + "|".join(longest_first) + r")\b"


def words_to_number(c: Column) -> Column:
    """Fold the number words of a cell: hundreds multiply, thousands close a group."""
    words = F.regexp_extract_all(F.lower(text(c)), F.lit(_word_pattern()), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in fixed.NUMBER_WORDS.items() for x in kv])
    values = F.transform(words, lambda w: F.element_at(table, w))

    def step(acc: Column, n: Column) -> Column:
        scaled = F.when(acc.current == 0, 1).otherwise(acc.current)
        total = F.when(n == 1000, acc.total + scaled * 1000).otherwise(acc.total)
        current = (
            F.when(n == 1000, 0).when(n == 100, scaled * 100).otherwise(acc.current + n)
        )
        return F.struct(total.alias("total"), current.alias("current"))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("current"))
    folded = F.aggregate(values, start, step, lambda a: a.total + a.current)
    return F.when(F.size(words) > 0, folded.cast("string")).otherwise(c)


def time_to_number(c: Column) -> Column:
    """The number before the first time unit; the unit itself is not converted."""
    found = F.regexp_extract(text(c), fixed.TIME_AMOUNT, 1)
    return F.when(text(c).rlike(fixed.TIME_AMOUNT), number_text(found)).otherwise(c)


def composite_sum(c: Column) -> Column:
    """Sum of the amounts in a cell that holds two or more of them."""
    found = F.regexp_extract_all(text(c), F.lit(fixed.MONEY_AMOUNT), F.lit(1))
    amounts = F.transform(found, lambda a: F.regexp_replace(a, ",", "").try_cast("double"))
    total = F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x)
    shown = F.when(total == F.floor(total), F.floor(total).cast("string")).otherwise(
        total.cast("string")
    )
    return F.when(F.size(found) >= 2, F.coalesce(shown, c)).otherwise(c)


def free_as_zero(c: Column) -> Column:
    return F.when(starts_free(c), F.lit("0")).otherwise(c)


def without_vague(c: Column) -> Column:
    return F.when(~is_vague(c), c)


def title_case(c: Column) -> Column:
    """Capital after every non-letter, small letters otherwise."""
    low = F.split(F.lower(c), "")
    letters = F.transform(
        low,
        lambda ch, i: F.when(
            (i == 0) | ~F.coalesce(F.get(low, i - 1), F.lit("")).rlike(r"\p{L}"), F.upper(ch)
        ).otherwise(ch),
    )
    return F.array_join(letters, "")


def neutralised(c: Column) -> Column:
    return F.when(c.rlike(fixed.FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)
