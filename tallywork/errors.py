class Refusal(ValueError):
    """An operator was asked for something the data or the arguments cannot support."""


def need_columns(df, names):
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise Refusal(f"Columns not found: {missing}. Available: {df.columns[:20]}")
