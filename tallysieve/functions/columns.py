"""Evidence rules as Column expressions.

Everything here is `Column -> Column` and stays in whole-stage codegen. Rules read
the evidence columns by name; `prefix` selects one side of a pair table
(`positive_count_target`, `negative_count_target`, ...).

A zero control count means "not observed". No rule below turns it into evidence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the evidence model: channel names, channel weights, shrinkage
# constants, audit thresholds.
CHANNELS = ("competition", "control", "supplement")
CHANNEL_WEIGHTS = (2.0, 1.0, 1.0)
TARGET_SHRINK = 20.0
CONTROL_SHRINK = 5.0
SUPPORT_CUTOFFS = (2, 5, 10, 20, 50, 100)
COVERAGE_CUTOFFS = (5, 10, 20)
ZERO_CAPS = (0, 1, 5)
LN2 = math.log(2)
LN10 = math.log(10)
COUNT_COLUMNS = ("count_target", "count_competitor", "count_control")
Z_COLUMNS = ("z_target", "z_competitor", "z_control")
PART_KEYS = ("k12", "k13", "k23")


def _side(prefix: str):
    return lambda name: F.col(f"{prefix}{name}")


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- keys and codes --------------------------------------------------------


def valid_key(key: Column | str) -> Column:
    key = as_col(key)
    return key.isNotNull() & (F.trim(key) != "")


def code_fields(code: Column | str) -> Column:
    """All dash-separated fields when there are exactly four non-empty ones, else null."""
    fields = F.split(as_col(code), "-", -1)
    strict = (F.size(fields) == 4) & F.forall(fields, lambda x: x != "")
    return F.when(strict, fields)


def code_fields_loose(code: Column | str) -> Column:
    """At most four fields, the last keeping any further dashes; null when fewer."""
    fields = F.split(as_col(code), "-", 4)
    return F.when(F.size(fields) == 4, fields)


def library_name(code: Column | str) -> Column:
    return code_fields(code).getItem(0)


def part_key(fields: Column, first: int, second: int) -> Column:
    return F.concat_ws(":", fields.getItem(0), fields.getItem(first), fields.getItem(second))


def part_columns(fields: Column) -> dict[str, Column]:
    """library, the three parts and the three two-part keys of a split code."""
    return {
        "library": fields.getItem(0),
        "b1": fields.getItem(1),
        "b2": fields.getItem(2),
        "b3": fields.getItem(3),
        "k12": part_key(fields, 1, 2),
        "k13": part_key(fields, 1, 3),
        "k23": part_key(fields, 2, 3),
    }


def part_key_rows(prefix: str = "") -> Column:
    """The three two-part keys as rows: array of (key_kind, part_key)."""
    side = _side(prefix)
    return F.array(
        *[F.struct(F.lit(kind).alias("key_kind"), side(kind).alias("part_key")) for kind in PART_KEYS]
    )


def varied_position(kind: Column) -> Column:
    return F.when(kind == "k12", "b3").when(kind == "k13", "b2").otherwise("b1")


def join_list(values: Column | str) -> Column:
    return F.concat_ws(";", F.transform(as_col(values), lambda x: x.cast("string")))


def integer_set(text: Column | str) -> Column:
    fields = F.filter(F.split(F.coalesce(as_col(text), F.lit("")), ";"), lambda x: x != "")
    return F.array_distinct(F.transform(fields, lambda x: x.cast("int")))


def jaccard(a: Column | str, b: Column | str) -> Column:
    a, b = as_col(a), as_col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def multi_part_valid(text: Column | str, is_valid) -> Column:
    """Every `;`-separated part satisfies `is_valid(part)`."""
    return F.forall(F.split(as_col(text), ";"), is_valid)


# --- counts ----------------------------------------------------------------


def checked_count(value: Column | str) -> Column:
    """Fail the job on a negative or non-finite count."""
    value = as_col(value)
    number = value.cast("double")
    bad = (number < 0) | F.isnan(number) | (number == float("inf"))
    return F.when(bad, F.raise_error(F.lit("negative or non-finite count")).cast("double")).otherwise(number)


def control_evidence(control: Column | str, supplement: Column | str) -> Column:
    return F.greatest(as_col(control), as_col(supplement))


def log_ratio(target: Column | str, competitor: Column | str, pseudocount: float = 0.5) -> Column:
    if pseudocount <= 0:
        raise ValueError("pseudocount must be positive")
    return F.log((checked_count(target) + pseudocount) / (checked_count(competitor) + pseudocount))


def count_fold(a: Column | str, b: Column | str) -> Column:
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    return F.greatest(a / F.nullif(b, F.lit(0.0)), b / F.nullif(a, F.lit(0.0)))


def count_band(value: Column | str) -> Column:
    v = as_col(value)
    return (
        F.when(v <= 1, "le1").when(v < 5, "gt1_lt5").when(v < 10, "5_lt10").when(v < 20, "10_lt20").otherwise("ge20")
    )


# --- hit rules -------------------------------------------------------------


def strict_hit(prefix: str = "", control: str = "count_control") -> Column:
    c = _side(prefix)
    t, i, n = c("count_target"), c("count_competitor"), c(control)
    return (t > 3) & ((i == 0) | (i < 0.1 * t)) & ((n == 0) | (n < 0.1 * t)) & (c("historic_hits") < 5)


def _clean_binder(minimum_target: int, control_ratio: float, maximum_history: int) -> Column:
    t = F.col("count_target")
    return (
        (t >= minimum_target)
        & (F.col("control_evidence") < control_ratio * t)
        & (F.col("historic_hits") <= maximum_history)
    )


def competition_sensitive(
    sensitive_ratio: float = 0.1, minimum_target: int = 4, control_ratio: float = 0.1, maximum_history: int = 4
) -> Column:
    return _clean_binder(minimum_target, control_ratio, maximum_history) & (
        F.col("count_competitor") < sensitive_ratio * F.col("count_target")
    )


def competition_retained(
    retained_ratio: float = 0.5, minimum_target: int = 4, control_ratio: float = 0.1, maximum_history: int = 4
) -> Column:
    return _clean_binder(minimum_target, control_ratio, maximum_history) & (
        F.col("count_competitor") >= retained_ratio * F.col("count_target")
    )


def eval_label() -> Column:
    """1 sensitive, 0 retained, -1 neither."""
    return F.when(competition_sensitive(), 1).when(competition_retained(), 0).otherwise(-1)


def unobserved_anchor() -> Column:
    t = F.col("count_target")
    return (
        (t >= 3)
        & (F.col("count_competitor") < 0.1 * t)
        & (F.col("control_evidence") == 0)
        & (F.col("historic_hits") < 5)
    )


def informative() -> Column:
    return (
        (F.col("count_target") >= 2)
        | (F.col("count_competitor") > 0)
        | (F.col("count_control") > 0)
        | (F.col("count_control_supplement") > 0)
        | (F.col("historic_hits") > 0)
    )


def ablation_scope(bucket_limit: int = 14) -> Column:
    return F.col("informative") | (F.col("sample_bucket") < bucket_limit)


def counter_evidence(with_history: bool = False) -> Column:
    rule = (F.col("count_competitor") > 0) | (F.col("control_evidence") > 0)
    return rule | (F.col("historic_hits") >= 5) if with_history else rule


def low_target() -> Column:
    return (
        (F.col("count_target") <= 3)
        & (F.col("count_competitor") == 0)
        & (F.col("control_evidence") == 0)
        & (F.col("historic_hits") < 5)
    )


# --- evidence channels -----------------------------------------------------


def mean_counts() -> dict[str, Column]:
    """Counts per source row; the supplement has its own row count."""
    n = F.greatest(F.col("source_rows"), F.lit(1))
    m = F.greatest(F.col("supplement_rows"), F.lit(1))
    return {
        "mean_target": checked_count("count_target") / n,
        "mean_competitor": checked_count("count_competitor") / n,
        "mean_control": checked_count("count_control") / n,
        "mean_supplement": checked_count("count_control_supplement") / m,
    }


def observed_evidence() -> dict[str, Column]:
    """Proxy and confidence per channel, both zero unless target and control were seen."""
    means = mean_counts()
    t = means["mean_target"]
    result = {}
    for k, control in enumerate(("mean_competitor", "mean_control", "mean_supplement")):
        c = means[control]
        seen = (t > 0) & (c > 0)
        shrink = t / (t + TARGET_SHRINK) * c / (c + CONTROL_SHRINK) / (1 + F.col("historic_hits"))
        result[f"proxy_{k}"] = F.when(seen, F.log1p(t) - F.log1p(c)).otherwise(F.lit(0.0))
        result[f"confidence_{k}"] = F.when(seen, shrink).otherwise(F.lit(0.0))
    return result


def evidence_intervals(zero_cap: int) -> dict[str, Column]:
    """Lower/upper proxy and confidence per channel; a positive cap bounds zero competitors.

    Reads proxy_k / confidence_k as columns.
    """
    if zero_cap not in ZERO_CAPS:
        raise ValueError("zero_cap must be 0, 1 or 5")
    result = {}
    for k in range(3):
        result[f"lower_{k}"] = F.col(f"proxy_{k}")
        result[f"upper_{k}"] = F.col(f"proxy_{k}")
        result[f"interval_confidence_{k}"] = F.col(f"confidence_{k}")
    if zero_cap:
        means = mean_counts()
        t = means["mean_target"]
        background = F.greatest(means["mean_control"], means["mean_supplement"])
        added = (t >= 5) & (means["mean_competitor"] == 0)
        weak = 0.05 * t / (t + TARGET_SHRINK) / (1 + F.col("historic_hits")) / (1 + background / t)
        result["lower_0"] = F.when(added, F.log1p(t) - math.log1p(zero_cap)).otherwise(F.col("proxy_0"))
        result["upper_0"] = F.when(added, F.log1p(t)).otherwise(F.col("proxy_0"))
        result["interval_confidence_0"] = F.when(added, weak).otherwise(F.col("confidence_0"))
    return result


def count_reliability() -> Column:
    """Trust in a pair: target support of the winner, observed control of the loser."""
    t = checked_count("positive_count_target")
    c = checked_count(F.greatest("negative_count_competitor", "negative_control_evidence"))
    return t / (t + TARGET_SHRINK) * c / (c + CONTROL_SHRINK)


def raw_targets() -> dict[str, Column]:
    """Nine regression targets: five log counts, four clipped z-scores."""
    counts = ("count_target", "count_competitor", "count_control", "count_control_supplement", "historic_hits")
    zs = ("z_target", "z_competitor", "z_control", "z_control_supplement")
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(-20.0)), F.lit(20.0))
    return {**{f"y_{c}": F.log1p(F.col(c)) for c in counts}, **{f"y_{z}": clip(z) for z in zs}}


def active_score(value=None) -> Column:
    """Target evidence minus competitor, background and history, on the nine targets."""
    v = value or (lambda name: raw_targets()[name])
    target = v("y_count_target") + 0.25 * v("y_z_target")
    competitor = v("y_count_competitor") + 0.25 * v("y_z_competitor")
    control = v("y_count_control") + 0.25 * v("y_z_control")
    supplement = v("y_count_control_supplement") + 0.25 * v("y_z_control_supplement")
    return target - competitor - 0.5 * F.greatest(control, supplement) - 0.25 * v("y_historic_hits")


def evidence_weight() -> Column:
    total = (
        F.col("count_target")
        + F.col("count_competitor")
        + F.col("count_control")
        + F.col("count_control_supplement")
        + F.col("historic_hits")
    )
    return F.least(F.greatest(1 + F.log1p(total), F.lit(1.0)), F.lit(5.0))


# --- pairs -----------------------------------------------------------------


def dominates(positive: str = "positive_", negative: str = "negative_") -> Column:
    p, n = _side(positive), _side(negative)
    return (
        (p("count_target") > n("count_target"))
        & (p("count_competitor") <= n("count_competitor"))
        & (p("control_evidence") <= n("control_evidence"))
        & ((n("count_competitor") > 0) | (n("control_evidence") > 0))
    )


def pair_class(positive: str = "positive_", negative: str = "negative_") -> Column:
    """Strong, weak or no (null) ordering of a pair."""
    # fixed values: the two class names as pair tables carry them
    p, n = _side(positive), _side(negative)
    no_worse = (p("count_competitor") <= n("count_competitor")) & (p("control_evidence") <= n("control_evidence"))
    seen = (n("count_competitor") > 0) | (n("control_evidence") > 0)
    return F.when(
        (p("count_target") > n("count_target")) & no_worse,
        F.when(seen, "control_confirmed_dominance").otherwise("target_dominance_without_control_confirmation"),
    )


def pair_class_weight(pair_type: Column) -> Column:
    return F.when(pair_type == "control_confirmed_dominance", 1.0).otherwise(0.35)


def competition_weight(margin: Column) -> Column:
    return 1 + F.least(margin / LN10, F.lit(2.0))


def matched_weight(positive_target: Column, negative_target: Column) -> Column:
    margin = F.log1p(positive_target) - F.log1p(negative_target)
    return 1 + F.least(margin, F.lit(3.0)) / 3


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def win_credit(difference: Column) -> Column:
    return F.when(difference > 0, 1.0).when(difference == 0, 0.5).otherwise(0.0)


def smooth_l1(difference: Column) -> Column:
    d = F.abs(difference)
    return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)
