"""Column expressions for beliefs, evidence, severity, units and time. All are built from Spark's own functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beliefs stay within this log-odds range.
LOG_ODDS_LIMIT = 20.0
#: Half-lives in seconds of claims by kind (fixed values).
HALF_LIFE_S = {"position": 180, "pose": 180, "presence": 600, "ownership": 86400, "tag_read": 3600, "default": 600}
#: Rank of modalities on the chain; others are off it (fixed values).
MODALITY_RANK = {"observed": 0, "inferred": 1, "predicted": 2, "planned": 3}
#: unit -> (factor to the base unit, offset, dimension).
UNITS = {
    "m": (1.0, 0.0, "[length]"), "mm": (1e-3, 0.0, "[length]"), "cm": (1e-2, 0.0, "[length]"), "km": (1e3, 0.0, "[length]"), "inch": (0.0254, 0.0, "[length]"),
    "rad": (1.0, 0.0, "[]"), "deg": (math.pi / 180, 0.0, "[]"),
    "s": (1.0, 0.0, "[time]"), "ms": (1e-3, 0.0, "[time]"), "min": (60.0, 0.0, "[time]"), "h": (3600.0, 0.0, "[time]"),
    "kg": (1.0, 0.0, "[mass]"), "g": (1e-3, 0.0, "[mass]"), "lb": (0.45359237, 0.0, "[mass]"),
    "kelvin": (1.0, 0.0, "[temperature]"), "degC": (1.0, 273.15, "[temperature]"), "degF": (5 / 9, 273.15 - 32 * 5 / 9, "[temperature]"),
}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clip(x, low: float, high: float) -> Column:
    """`x` within two bounds; null stays null (`least` and `greatest` alone would pass it over)."""
    return F.when(_c(x).isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), _c(x))))


def log_odds(p, limit: float = LOG_ODDS_LIMIT) -> Column:
    q = clip(p, 1e-9, 1 - 1e-9)
    return clip(F.log(q / (1 - q)), -limit, limit)


def sigmoid(x, limit: float = LOG_ODDS_LIMIT) -> Column:
    return 1 / (1 + F.exp(-clip(x, -limit, limit)))


def entropy(p, base: float = 2.0) -> Column:
    """Entropy of a Bernoulli belief in bits, or in nats with base e."""
    q = clip(p, 1e-12, 1 - 1e-12)
    return -(q * F.log(q) + (1 - q) * F.log(1 - q)) / math.log(base)


def js_distance(p, q) -> Column:
    """Jensen-Shannon distance of two Bernoulli beliefs, base 2: 0 to 1; null if one is null."""
    p, q = clip(p, 0, 1), clip(q, 0, 1)
    m = (p + q) / 2

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / b)).otherwise(F.lit(0.0))

    def kl(a: Column) -> Column:
        return part(a, m) + part(1 - a, 1 - m)

    return F.when(p.isNotNull() & q.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), (kl(p) + kl(q)) / 2)))


def lookup(key, table: dict, default=None) -> Column:
    """The value of a fixed table; `default` where the key is missing."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(_c(key) == k, F.lit(v)).otherwise(out)
    return out


def decayed_confidence(conf, kind, elapsed_s) -> Column:
    """Confidence halved for each half-life of the kind; none for missing or future times."""
    half = lookup(kind, {k: float(v) for k, v in HALF_LIFE_S.items()}, float(HALF_LIFE_S["default"]))
    t = _c(elapsed_s)
    return F.when(t.isNull() | (t <= 0) | (half <= 0), _c(conf)).otherwise(_c(conf) * F.pow(F.lit(0.5), t / half))


def weibull_survival(elapsed_s, median_s: float, shape: float = 1.5) -> Column:
    scale = median_s / math.log(2) ** (1 / shape)
    return F.exp(-F.pow(F.greatest(_c(elapsed_s), F.lit(0.0)) / scale, F.lit(shape)))


def continuation(elapsed_s, step_s: float, median_s: float, shape: float = 1.5) -> Column:
    """Chance that a state which has lasted `elapsed_s` lasts one more step."""
    now = weibull_survival(elapsed_s, median_s, shape)
    return F.when(now <= 0, F.lit(0.0)).otherwise(F.least(weibull_survival(_c(elapsed_s) + step_s, median_s, shape) / now, F.lit(1.0)))


def safe_log(p) -> Column:
    return F.log(F.greatest(_c(p), F.lit(1e-12)))


def confusion_llr(says, true_positive, false_positive) -> Column:
    """Log-likelihood ratio of a record's yes or no, from the source's confusion rates."""
    tp, fp = _c(true_positive), _c(false_positive)
    return F.when(_c(says), safe_log(tp) - safe_log(fp)).otherwise(safe_log(1 - tp) - safe_log(1 - fp))


def gaussian_log_likelihood(x, mean, stddev) -> Column:
    z = (_c(x) - _c(mean)) / _c(stddev)
    return -0.5 * z * z - F.log(_c(stddev) * math.sqrt(2 * math.pi))


def normal_quantile(p: float) -> float:
    """Quantile of the standard normal distribution, for a parameter."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def implausible_offset(offset_s, mean_s, stddev_s, percentile: float = 0.95) -> Column:
    return F.abs(_c(offset_s)) > F.abs(_c(mean_s) + _c(stddev_s) * normal_quantile(percentile))


def reliability_step(observations) -> Column:
    return 1 / (_c(observations) + 10.0)


def reliability_update(outcome, tp, fp, mean_s, lag_s, observations) -> dict[str, Column]:
    """New rates after a resolved case: a wrong record moves the false-positive rate up, a right one the true-positive."""
    step = reliability_step(observations)
    wrong = _c(outcome) == "physical_correct"
    return {
        "new_fp": F.when(wrong, F.greatest(F.least(_c(fp) + step * 0.5, _c(tp) - 1e-6), F.lit(0.0))).otherwise(_c(fp)),
        "new_tp": F.when(wrong, _c(tp)).otherwise(F.least(_c(tp) + step * 0.5, F.lit(1.0))),
        "new_mean_s": F.coalesce(_c(mean_s) + step * (_c(lag_s) - _c(mean_s)), _c(mean_s)),
    }


def systematic_bias(kind, lag_s, magnitude) -> Column:
    """Whether a recurring bias explains a reporting lag."""
    lag, hours = _c(lag_s), F.coalesce(F.when(_c(magnitude) != 0, _c(magnitude)), F.lit(8.0))
    return F.coalesce(
        F.when(_c(kind) == "month_end_batch", lag.between(0, 31 * 86400)).when(_c(kind) == "shift_boundary", F.abs(lag) <= hours * 3600).otherwise(F.lit(False)),
        F.lit(False),
    )


def value_at_stake(asset, sla, safety) -> Column:
    return (_c(asset) + _c(sla)) * (1 + _c(safety))


def severity(value, confidence, persistence, norm) -> Column:
    return clip(0.4 * _c(value) + 0.3 * _c(confidence) + 0.2 * _c(persistence) + 0.1 * _c(norm), 0, 1)


def exceedance_risk(observed, limit, steepness: float = 8.0) -> Column:
    """Risk of a value above its limit, by how far it is above relative to the limit; 0 without a positive limit."""
    over = (_c(observed) - _c(limit)) / _c(limit)
    return F.when((_c(limit) > 0) & (over > 0), 1 - 1 / (1 + steepness * over)).otherwise(F.lit(0.0))


def information_gain(prior, reliability) -> Column:
    return F.greatest(F.lit(0.0), entropy(prior) * (2 * _c(reliability) - 1))


def propagate_confidence(parts, how: str = "min") -> Column:
    """Confidence of a conclusion from those of its supports; unknown ones are left out."""
    known = F.filter(_c(parts), lambda x: x.isNotNull())
    if how == "min":
        return F.array_min(known)
    one = F.when(F.size(known) > 0, F.lit(1.0))
    if how == "product":
        return F.aggregate(known, one, lambda a, x: a * x)
    return 1 - F.aggregate(known, one, lambda a, x: a * (1 - x))


def bayes_factor(observed, expected, alternative, scale: float = 0.1) -> Column:
    def like(mean) -> Column:
        return F.exp(-F.pow(_c(observed) - _c(mean), F.lit(2)) / (2 * scale**2))

    return like(alternative) / F.greatest(like(expected), F.lit(1e-12))


def prediction_set(p, level: float) -> Column:
    return F.when(_c(p) >= level, F.lit("1")).when(1 - _c(p) >= level, F.lit("0")).otherwise(F.lit("0,1"))


def wilson_interval(k, n, ci: float = 0.95) -> dict[str, Column]:
    z = normal_quantile(1 - (1 - ci) / 2)
    p, n = _c(k) / _c(n), _c(n)
    denom, center = 1 + z**2 / n, p + z**2 / (2 * n)
    margin = z * F.sqrt(p * (1 - p) / n + z**2 / (4 * n * n))
    return {"point": p, "ci_low": F.greatest(F.lit(0.0), (center - margin) / denom), "ci_high": F.least(F.lit(1.0), (center + margin) / denom)}


def temperature_scale(logit, t: float) -> Column:
    x = _c(logit) / t
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def convert_unit(value, from_unit, to_unit) -> Column:
    """Value in another unit of the same dimension; null for unknown units or other dimensions."""
    f = [lookup(from_unit, {k: v[i] for k, v in UNITS.items()}) for i in range(3)]
    t = [lookup(to_unit, {k: v[i] for k, v in UNITS.items()}) for i in range(3)]
    return F.when(f[2] == t[2], (_c(value) * f[0] + f[1] - t[1]) / t[0])


def event_id(ms, key) -> Column:
    """A UUID of version 7 from milliseconds and a key: the same input always gives the same id."""
    time = F.lpad(F.lower(F.hex(_c(ms))), 12, "0")
    h = F.sha2(_c(key), 256)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 4, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), F.substring(h, 1, 3)), F.concat(variant, F.substring(h, 5, 3)), F.substring(h, 8, 12))


def event_id_ms(uid) -> Column:
    return F.conv(F.replace(F.substring(_c(uid), 1, 13), F.lit("-"), F.lit("")), 16, 10).cast("long")


def iso_duration_seconds(text) -> Column:
    """Seconds of an ISO duration of days, hours, minutes and seconds; null for anything else."""
    shape = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"

    def part(i: int) -> Column:
        x = F.regexp_extract(_c(text), shape, i)
        return F.when(x == "", F.lit(0.0)).otherwise(x.try_cast("double"))

    total = part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)
    return F.when(_c(text).rlike(shape) & _c(text).rlike(r"\d"), total)


def modality_rank(m) -> Column:
    return lookup(m, MODALITY_RANK)


def transition_allowed(old, new, allowed: list[tuple[str, str]]) -> Column:
    pair = F.concat_ws(">", _c(old), _c(new))
    return pair.isin([f"{a}>{b}" for a, b in allowed])


def requires_approval(risk, required_if, severity_) -> Column:
    return F.when(_c(risk).isin("medium", "high"), True).when(_c(required_if) == "always", True).when(_c(required_if) == "severity>=high", _c(severity_) >= 0.7).otherwise(False)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(_c(v), lambda x: x.cast("double") / n)).otherwise(F.transform(_c(v), lambda x: x.cast("double")))


def compose_transform(a, b) -> Column:
    """Product of two 4 x 4 rigid transforms, row-major arrays of 16."""
    a, b = _c(a), _c(b)
    return F.array(*[sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)])


def invert_transform(a) -> Column:
    """Inverse of a rigid transform: rotation transposed, translation turned and negated."""
    a = _c(a)
    rows = []
    for i in range(3):
        rows += [a[4 * k + i] for k in range(3)] + [-(a[i] * a[3] + a[4 + i] * a[7] + a[8 + i] * a[11])]
    return F.array(*rows, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])


def rotation_z(angle, x=0.0, y=0.0, z=0.0) -> Column:
    a = _c(angle)
    values = [F.cos(a), -F.sin(a), 0.0, x, F.sin(a), F.cos(a), 0.0, y, 0.0, 0.0, 1.0, z, 0.0, 0.0, 0.0, 1.0]
    return F.array(*[_c(v).cast("double") for v in values])


def text_tokens(text) -> Column:
    """A cheap token estimate: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(_c(text)) / 4).cast("int"))
