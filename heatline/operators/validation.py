"""Validation as violation rows: each rule is a Column, a row's failed rules one array, exploded on demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: standard error codes, and older codes with the one they became ----
STANDARD_CODES = (
    "INVALID_INPUT", "UNIT_MISMATCH", "OUT_OF_DOMAIN", "MISSING_DATA", "MULTIPLE_SPECIES_MATCH", "PHASE_MISMATCH", "TEMPERATURE_RANGE_ERROR",
    "REACTION_NOT_BALANCED", "NUMERICAL_ERROR", "MODEL_NOT_APPLICABLE", "UNKNOWN_MODEL", "INTERNAL_ERROR",
)
LEGACY_CODES = {
    "DIMENSION_MISMATCH": "UNIT_MISMATCH", "UNSUPPORTED_CONVERSION": "UNIT_MISMATCH", "PARSE_ERROR": "INVALID_INPUT", "NO_DATA": "MISSING_DATA",
    "OUT_OF_RANGE": "OUT_OF_DOMAIN", "UNSUPPORTED_REACTION": "MODEL_NOT_APPLICABLE",
}


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule): one row for each rule that fails; a rule that comes out null doesn't fail."""
    failed = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(failed).alias("rule"))


def required(value: Column) -> Column:
    """Missing, or an empty text."""
    return value.isNull() | (value.cast("string") == "")


def number_rules(name: str, text: Column, *, needed: bool = True, low: float | None = None, high: float | None = None) -> dict[str, Column]:
    """Rules of a numeric field given as text: missing, not a number, not finite, too low, too high."""
    empty = required(text)
    value = text.try_cast("double")
    infinite = F.isnan(value) | (F.abs(value) == float("inf"))
    usable = ~empty & value.isNotNull() & ~infinite
    out = {f"{name}: missing": empty if needed else F.lit(False), f"{name}: not a number": ~empty & value.isNull(), f"{name}: not finite": ~empty & infinite}
    if low is not None:
        out[f"{name}: below {low:g}"] = usable & (value < low)
    if high is not None:
        out[f"{name}: above {high:g}"] = usable & (value > high)
    return out


def normalised_code(code: Column) -> Column:
    """Older codes become standard ones, unknown ones INTERNAL_ERROR, empty ones null."""
    known = F.coalesce(*[F.when(code == old, F.lit(new)) for old, new in LEGACY_CODES.items()], code)
    return F.when(F.coalesce(code, F.lit("")) != "", F.when(known.isin(*STANDARD_CODES), known).otherwise("INTERNAL_ERROR"))


def status(success: Column, code: Column) -> Column:
    """success, rejected for errors of input or domain, error for internal ones."""
    return F.when(success, "success").when(code == "INTERNAL_ERROR", "error").otherwise("rejected")


def allowed_actions(risk: Column, answerable: Column, evidence: Column, capability: Column, information: Column) -> Column:
    """The default actions of a labelled request, first rule that fits."""
    act = lambda *names: F.array(*map(F.lit, names))
    gone, enough = capability == "unavailable", information == "sufficient"
    return (
        F.when(risk == "review_required", act("escalate"))
        .when(answerable.isin("ambiguous_request", "missing_task_information"), act("clarify"))
        .when((evidence == "none") & (answerable == "answerable"), act("answer"))
        .when((evidence == "optional") & gone, act("answer"))
        .when((evidence == "optional") & enough, act("answer", "call"))
        .when(evidence == "optional", act("answer", "clarify"))
        .when((evidence == "required") & gone, act("refuse"))
        .when((evidence == "required") & enough, act("call"))
        .when(evidence == "required", act("clarify"))
    )


def action_policy(labels: DataFrame, overrides: DataFrame, task: str) -> DataFrame:
    """(task, actions, defaults, outcome): whether each label's actions are what the policy says.

    ``labels`` has the five statuses and ``allowed_actions``; ``overrides`` (task, default_actions,
    accepted_actions) lists exceptions.  An exception holds only if both of its sets are the
    present ones, so it lapses when the policy changes; of several for a task any may hold.  Outcomes: default, override, differs,
    no actions, unknown action, no default.  Order and repeats of actions don't count.
    """
    known = F.array(*map(F.lit, ("answer", "call", "clarify", "refuse", "escalate")))
    bag = lambda c: F.array_sort(F.array_distinct(c))
    own = bag(F.coalesce(F.col("allowed_actions"), F.array().cast("array<string>")))
    statuses = ("risk_status", "answerability", "evidence_requirement", "capability_status", "information_status")
    rows = labels.select(task, own.alias("actions"), bag(allowed_actions(*map(F.col, statuses))).alias("defaults"))
    listed = overrides.select(F.col(task), bag("default_actions").alias("defaults"), bag("accepted_actions").alias("actions"), F.lit(True).alias("_listed")).distinct()
    outcome = (
        F.when(F.size("actions") == 0, "no actions")
        .when(F.size(F.array_except("actions", known)) > 0, "unknown action")
        .when(F.col("defaults").isNull(), "no default")
        .when(F.col("actions") == F.col("defaults"), "default")
        .when(F.col("_listed"), "override")
        .otherwise("differs")
    )
    return rows.join(listed, [task, "defaults", "actions"], "left").select(task, "actions", "defaults", outcome.alias("outcome"))


def account_rules(name: Column, mail: Column, secret_length: Column) -> dict[str, Column]:
    return {
        "missing": required(name) | required(mail) | secret_length.isNull(),
        "name length": ~F.length(name).between(3, 20),
        "mail form": ~mail.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"),
        "secret length": secret_length < 8,
    }


def similarity_class(flags: list[Column]) -> Column:
    """low for 0 or 1 agreeing features, medium for 2 or 3, high for more."""
    score = sum((f.cast("int") for f in flags), F.lit(0))
    return F.when(score <= 1, "low").when(score <= 3, "medium").otherwise("high")
