"""Cleaning steps with a cell-level audit, carried in the rows themselves.

While a plan runs, the frame holds two helper columns: ``_alive`` (not dropped yet) and
``_log`` (array of audit entries of this row). Nothing is joined back to build the audit,
and a dropped row stays until the end, so its entry survives. Without a row-order column
only row-local steps run and nothing is logged; that is the streaming form.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tallywork.errors import Refusal, need_columns
from tallywork.functions import cells, fixed
from tallywork.functions.cells import is_number, is_text, number, quoted, text
from tallywork.operators.manipulate import casted, fractional, most_common
from tallywork.operators.ordering import dense_ordinal, exact_quantiles
from tallywork.operators.outliers import Policy, extreme_test

ENTRY = (
    "struct<row:bigint,column:string,original_value:string,new_value:string,"
    "operation:string,rule:string>"
)
AUDIT_SCHEMA = (
    "row long, column string, original_value string, new_value string, "
    "operation string, rule string"
)
DROPPED = "<dropped>"


def fenced(df: DataFrame) -> DataFrame:
    """The same rows, with filters kept above them.

    A filter moves below a projection by copying the projected expressions into itself. In a
    chain of rewrites each one mentions its input several times, so the copies multiply;
    columns that come out of a generator are not copied.
    """
    row = F.struct(*[quoted(c).alias(c) for c in df.columns])
    return df.select(F.inline(F.array(row)))


@dataclass
class Run:
    """A frame in the middle of a cleaning plan."""

    df: DataFrame
    rid: str | None = None
    policy: Policy = field(default_factory=Policy)
    notes: list = field(default_factory=list)  # audit rows about whole columns
    dropped: bool = False

    @classmethod
    def start(cls, df, rid=None, policy=None):
        if rid is not None:
            need_columns(df, [rid])
            df = df.withColumn("_alive", F.lit(True)).withColumn(
                "_log", F.array().cast(f"array<{ENTRY}>")
            )
        return cls(df, rid, policy or Policy())

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("_alive", "_log")]

    def has(self, column) -> bool:
        return column in self.columns

    def kind(self, column):
        return cells.dtype_of(self.df, column)

    def alive(self, *columns: str) -> DataFrame:
        """Rows not dropped so far, with only the columns a statistic needs."""
        if self.rid is None:
            raise Refusal("this step looks at the whole table and needs the row-order column")
        kept = [quoted(c) for c in (columns or self.columns)]
        if not self.dropped:
            return self.df.select(*kept)
        return fenced(self.df.select(*kept, "_alive")).where("_alive").drop("_alive")

    def _append(self, when: Column, column, old: Column, new: Column, op, rule) -> Column:
        entry = F.struct(
            (quoted(self.rid).cast("long") + 1).alias("row"), F.lit(column).alias("column"),
            text(old).alias("original_value"), text(new).alias("new_value"),
            F.lit(op).alias("operation"), F.lit(rule).alias("rule"),
        )
        return F.when(
            F.col("_alive") & F.coalesce(when, F.lit(False)), F.array_append("_log", entry)
        ).otherwise(F.col("_log"))

    def log(self, when, column, old, new, op, rule) -> None:
        if self.rid is not None:
            self.df = self.df.withColumn("_log", self._append(when, column, old, new, op, rule))

    def rewrite(self, column: str, new: Column, op: str, rule: str) -> None:
        """Replace a column; cells that really changed are logged."""
        order = self.df.columns
        self.df = self.df.withColumn("_new", new)
        old, made = quoted(column), F.col("_new")
        self.log(~cells.same_value(old, made), column, old, made, op, rule)
        self.df = self.df.select(
            *[made.alias(c) if c == column else quoted(c) for c in order]
        )

    def drop(self, when: Column, column, op, rule, old=None, new=None, quiet=None) -> None:
        """Drop rows; ``quiet`` rows go too, but unlogged."""
        gone = F.coalesce(when, F.lit(False))
        if self.rid is None:
            also = F.coalesce(quiet, F.lit(False)) if quiet is not None else F.lit(False)
            self.df = self.df.where(~gone & ~also)
            return
        none = F.lit(None).cast("string")
        self.log(gone, column, none if old is None else old, none if new is None else F.lit(new),
                 op, rule)
        if quiet is not None:
            gone = gone | F.coalesce(quiet, F.lit(False))
        self.dropped = True
        self.df = self.df.withColumn("_alive", F.col("_alive") & ~gone)

    def note(self, column, old, new, op, rule) -> None:
        self.notes.append((0, column, old, new, op, rule))

    def cleaned(self) -> DataFrame:
        if self.rid is None:
            return self.df
        return self.alive()

    def audit(self) -> DataFrame:
        spark = self.df.sparkSession
        notes = spark.createDataFrame(self.notes, AUDIT_SCHEMA)
        if self.rid is None:
            return notes
        # explode_outer: a plain explode would push "_log is not empty" into every step
        entries = self.df.select(F.explode_outer("_log").alias("e")).where("e IS NOT NULL")
        return entries.select("e.*").unionByName(notes)


# --------------------------------------------------------------------- whole columns


def clean_column_names(run, column=None):
    """NBSP to space, outer spaces gone, runs of spaces collapsed."""
    names = {}
    for c in run.columns:
        tidy = " ".join(part for part in c.replace("\u00a0", " ").strip().split(" ") if part)
        if tidy != c:
            names[c] = tidy
    if len({names.get(c, c) for c in run.columns}) < len(run.columns):
        raise Refusal("clean_column_names would give two columns the same name")
    run.df = run.df.select(*[quoted(c).alias(names.get(c, c)) for c in run.df.columns])
    if run.rid in names:
        run.rid = names[run.rid]
    for old, new in names.items():
        run.note(old, old, new, "clean_column_names",
                 "Column name normalised (NBSP/whitespace removed)")


def drop_empty_columns(run, column=None):
    counts = run.alive().agg(*[F.count(quoted(c)).alias(c) for c in run.columns]).first()
    for i, c in enumerate(run.columns):
        if counts[i] == 0:
            run.df = run.df.drop(quoted(c))
            run.note(c, "(entire column)", DROPPED, "drop_empty_columns",
                     "column without any value removed")


def rename_column(run, column, new_name=None):
    if run.has(column) and new_name:
        run.df = run.df.withColumnRenamed(column, new_name)


# ------------------------------------------------------------------------- whole rows


def drop_incomplete_responses(
    run, column=None, progress_column="Progress", finished_column="Finished", min_progress=100
):
    if not run.has(progress_column):
        return
    progress = number(quoted(progress_column))
    low = progress < F.lit(min_progress)
    if run.has(finished_column):
        low = low & ~cells.is_finished(quoted(finished_column))
    run.drop(
        low, progress_column, "drop_incomplete_responses",
        f"unfinished answer removed: progress is below {min_progress}",
        old=F.concat(F.lit("Progress="), text(quoted(progress_column))), new=DROPPED,
    )


def drop_rows(run, column=None, indices=()):
    """Drop by 0-based position in the frame as it is at this step."""
    wanted = sorted({i for i in indices if isinstance(i, int) and i >= 0})
    if not wanted:
        return
    placed = dense_ordinal(run.alive(run.rid).withColumnRenamed(run.rid, "_r"), "_r")
    rids = [r["_r"] for r in placed.where(F.col("_ord").isin(wanted)).collect()]
    cells_text = F.to_json(F.struct(*[quoted(c) for c in run.columns]))
    run.drop(quoted(run.rid).isin(rids), "_row_", "drop_rows",
             "row taken out by its position", old=cells_text, new=DROPPED)


def drop_null(run, column):
    if run.has(column):
        run.drop(quoted(column).isNull(), column, "drop_null",
                 "row removed: this column has to be filled")


def deduplicate(run, column=None, subset=None):
    """Keep the first row per key.

    The first row ids come from an aggregate and return by a join on the unique row id,
    so a key shared by a third of the table never meets in one task.
    """
    keys = list(subset or [c for c in run.columns if c != run.rid])
    need_columns(run.df, keys)
    firsts = (
        run.alive(*{*keys, run.rid}).groupBy(*[quoted(k) for k in keys]).agg(F.min(quoted(run.rid)).alias("_r"))
        .select(F.col("_r").alias("_first"))
    )
    columns = run.df.columns
    run.df = run.df.join(firsts, quoted(run.rid) == F.col("_first"), "left")
    run.drop(F.col("_first").isNull(), "(duplicate)", "deduplicate", "repeat of an earlier row removed")
    run.df = run.df.select(*[quoted(c) for c in columns])


def remove_outliers(run, column, threshold=None):
    """Drop rows beyond the quartile fences; rows without a value go as well, unlogged."""
    if not run.has(column) or not is_number(run.kind(column)) or run.policy.method == "none":
        return
    q1, q3 = exact_quantiles(run.alive(column), {"x": number(quoted(column))}, [0.25, 0.75])["x"]
    if q1 is None:
        run.drop(F.lit(False), column, "remove_outliers", "", quiet=quoted(column).isNull())
        return
    reach = run.policy.row_reach(threshold) * (q3 - q1)
    x = number(quoted(column))
    run.drop(
        (x < F.lit(q1 - reach)) | (x > F.lit(q3 + reach)), column, "remove_outliers",
        "row removed: beyond the quartile fences", quiet=x.isNull(),
    )


# ------------------------------------------------------------------------ cell rewrites


def _cell_step(op, rule, rewrite, applies=is_text):
    def step(run, column):
        if run.has(column) and applies(run.kind(column)):
            run.rewrite(column, rewrite(quoted(column)), op, rule)

    step.__name__ = op
    return step


strip_whitespace = _cell_step(
    "strip_whitespace", "blanks at both ends cut", cells.strip)
remove_currency_symbols = _cell_step(
    "remove_currency_symbols", "currency sign taken off the amount",
    cells.without_currency)
extract_number = _cell_step(
    "extract_number", "number read out of the text", cells.first_number)
convert_number_words = _cell_step(
    "convert_number_words", "spelled-out number written in digits", cells.words_to_number)
convert_time_to_number = _cell_step(
    "convert_time_to_number", "duration turned into a number",
    cells.time_to_number)
free_to_zero = _cell_step(
    "free_to_zero", "an entry meaning no cost became 0", cells.free_as_zero)
remove_vague_entries = _cell_step(
    "remove_vague_entries", "entry without a definite amount emptied",
    cells.without_vague)
sum_composite_expenses = _cell_step(
    "sum_composite_expenses", "listed amounts added up",
    cells.composite_sum)


def cap_extreme_values(run, column, max_value=None):
    """Values above the ceiling become null; they are not clamped."""
    if run.has(column) and max_value is not None:
        over = F.coalesce(number(quoted(column)) > F.lit(max_value), F.lit(False))
        run.rewrite(column, F.when(~over, quoted(column)), "cap_extreme_values",
                    f"above the ceiling of {max_value}, emptied")


def fill_null(run, column, strategy=None, value=None):
    if not run.has(column):
        return
    numeric, fill = is_number(run.kind(column)), None
    if strategy == "mean" and numeric:
        fill = run.alive(column).agg(F.avg(number(quoted(column)))).first()[0]
    elif strategy == "median" and numeric:
        fill = exact_quantiles(run.alive(column), {"x": number(quoted(column))}, [0.5])["x"][0]
    elif strategy == "mode":
        fill = most_common(run.alive(column), column)
    elif not strategy:
        fill = value
    if fill is None:
        return
    kind = run.kind(column)
    if numeric and isinstance(fill, float) and not fill.is_integer():
        kind = "double"
    made = F.coalesce(quoted(column).cast(kind), F.lit(fill).cast(kind))
    run.rewrite(column, made, "fill_null", f"gap filled by {strategy or 'value'}")


def cast_type(run, column, target_type="str"):
    """Unparsable cells become null; a fractional column asked to be int stays as it is."""
    if not run.has(column):
        return
    made = casted(quoted(column), target_type)
    if made is None or target_type not in ("int", "float", "datetime", "str"):
        return
    if target_type == "int" and fractional(run.alive(column), column):
        return
    run.rewrite(column, made, "cast_type", f"read as {target_type}")


def standardize_values(run, column, mapping=None):
    if not run.has(column) or not mapping:
        return
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    c = quoted(column)
    made = F.when(F.map_contains_key(table, c), F.element_at(table, c)).otherwise(c)
    run.rewrite(column, F.when(c.isNotNull(), made), "standardize_values",
                "spelling replaced by the mapped one")


# ------------------------------------------------------------------------------ flags


def _mark(run, flagged: Column, flag_column: str, word: str) -> None:
    if not run.has(flag_column):
        run.df = run.df.withColumn(flag_column, F.lit(""))
    marked = F.btrim(F.concat(text(quoted(flag_column)), F.lit(word + " ")))
    marked = F.when(flagged, marked).otherwise(quoted(flag_column))
    run.df = run.df.withColumn(flag_column, marked)


def flag_extreme_outliers(run, column, threshold=None, flag_column="_flagged"):
    """Null out extreme values and mark their rows; a mostly-text column is read as number."""
    if not run.has(column) or run.policy.method == "none":
        return
    if not is_number(run.kind(column)):
        x = number(quoted(column))
        if run.alive(column).agg(F.count(x)).first()[0] < fixed.MIN_CLEANING_VALUES:
            return
        run.df = run.df.withColumn(column, x)
    test = extreme_test(run.alive(column), column, run.policy, threshold)
    if test is None or run.alive(column).where(test(quoted(column))).isEmpty():
        return
    run.df = run.df.withColumn("_extreme", test(quoted(column)))
    _mark(run, F.col("_extreme"), flag_column, f"OUTLIER:{column}")
    rule = f"extreme value emptied, its row marked ({run.policy.describe(threshold)})"
    run.rewrite(column, F.when(~F.col("_extreme"), quoted(column)), "flag_extreme_outliers", rule)
    run.df = run.df.drop("_extreme")


def flag_contextual_fraud(run, column, threshold=None, flag_column="_flagged", reason=None):
    """Mark rows whose value is above the threshold; the value stays."""
    if not run.has(column) or threshold is None:
        return
    reason = reason or f"unlikely {column}"
    test = F.coalesce(number(quoted(column)) > F.lit(threshold), F.lit(False))
    if run.rid is not None and run.alive(column).where(test).isEmpty():
        return
    run.log(test, column, quoted(column), quoted(column), "flag_contextual_fraud",
            f"{reason}: above {threshold}")
    _mark(run, test, flag_column, f"FRAUD:{reason}")


STEPS = {
    f.__name__: f
    for f in (
        clean_column_names, drop_empty_columns, drop_incomplete_responses, drop_rows,
        strip_whitespace, remove_currency_symbols, extract_number, convert_number_words,
        convert_time_to_number, free_to_zero, remove_vague_entries, sum_composite_expenses,
        flag_extreme_outliers, flag_contextual_fraud, cap_extreme_values, fill_null,
        drop_null, cast_type, deduplicate, rename_column, standardize_values, remove_outliers,
    )
}


def clean(df: DataFrame, operation: str, column=None, rid=None, policy=None, **params) -> DataFrame:
    """One cleaning step as a plain DataFrame function."""
    run = Run.start(df, rid, policy)
    STEPS[operation](run, column, **params)
    return run.cleaned()
