"""Texts judged by a table of rules: one projection made from its rows; adding a rule is adding a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

RULES = "rule string, role string, dimension string, kind string, field string, pattern string, low double, high double, weight double"
LEVELS = "dimension string, signals int, score double"
#: Overall scores from which a text is accepted, kept, tried again.
ACTIONS = ((4.7, "accept_candidate"), (4.3, "keep_pending"), (4.0, "needs_retry"))


def table(spark: SparkSession, rows: list[tuple], schema: str = RULES) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _flat(df: DataFrame, field: str) -> Column:
    """A field as lower-case text; parts of an array joined by blanks."""
    c = F.array_join(field, " ") if dict(df.dtypes)[field].startswith("array") else F.col(field)
    return F.lower(F.coalesce(c, F.lit("")))


def measure(df: DataFrame, rule: Row) -> Column:
    """The number that a rule bounds: words, characters or items of its fields, items that match, matches of its pattern, or which of its phrases stand in a text."""
    fields = rule.field.split("+")
    text = F.concat_ws(" ", *[_flat(df, f) for f in fields])
    if rule.kind == "words":
        return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    if rule.kind == "chars":
        return F.length(text)
    if rule.kind == "items":
        return F.coalesce(F.size(F.filter(fields[0], lambda x: F.trim(x) != "")), F.lit(0))
    if rule.kind == "items_like":
        return F.coalesce(F.size(F.filter(fields[0], lambda x: F.lower(F.trim(x)).rlike(rule.pattern))), F.lit(0))
    if rule.kind == "matches":
        return F.regexp_count(text, F.lit(rule.pattern))
    if rule.kind == "phrases":
        return sum((F.when(F.contains(text, F.lit(p)), 1).otherwise(0) for p in rule.pattern.split("|")), F.lit(0))
    raise ValueError(f"rule {rule.rule}: no kind {rule.kind}")


def holds(df: DataFrame, rule: Row) -> Column:
    """Whether a rule's number is within its bounds; an open bound is null."""
    n = measure(df, rule)
    return (F.lit(True) if rule.low is None else n >= rule.low) & (F.lit(True) if rule.high is None else n <= rule.high)


def judged(df: DataFrame, rules: DataFrame, levels: DataFrame) -> DataFrame:
    """Adds reasons (required rules that fail, in their order), scores (a map of dimensions), overall (their mean, two places) and action.

    rules: role `require` (a reason if it fails), `signal` (counts for its dimension if it holds), `penalty` (takes its weight from
    its dimension if it holds, down to 1). levels: a dimension's score from so many signals on. Both tables are read once, on the
    driver (a few hundred rows of rules), and become columns of one projection."""
    got, steps = rules.collect(), levels.collect()
    dimensions = sorted({s.dimension for s in steps})
    reasons = F.array_compact(F.array(*[F.when(~holds(df, r), F.lit(r.rule)) for r in got if r.role == "require"])) if any(r.role == "require" for r in got) else F.array().cast("array<string>")
    out = df.withColumn("reasons", reasons)
    out = out.withColumns({f"__n_{d}": sum((F.when(holds(df, r), 1).otherwise(0) for r in got if r.role == "signal" and r.dimension == d), F.lit(0)) for d in dimensions})
    scores = {}
    for d in dimensions:
        score = F.lit(1.0)
        for s in sorted((s for s in steps if s.dimension == d), key=lambda s: s.signals):
            score = F.when(F.col(f"__n_{d}") >= s.signals, s.score).otherwise(score)
        for r in got:
            if r.role == "penalty" and r.dimension == d:
                score = F.when(holds(df, r), F.greatest(F.lit(1.0), score - r.weight)).otherwise(score)
        scores[d] = score
    out = out.withColumn("scores", F.create_map(*[x for d, c in scores.items() for x in (F.lit(d), c)]))
    mean = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, b: a + b) / len(dimensions)
    action = F.lit("reject")
    for least, name in reversed(ACTIONS):
        action = F.when(F.col("overall") >= least, name).otherwise(action)
    return out.withColumn("overall", F.round(mean, 2)).withColumn("action", action).drop(*[f"__n_{d}" for d in dimensions])
