"""Names of runs, methods and metrics: labels made and read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strength_label(method: str, delta: float | None = None, lam: float | None = None, alpha: float | None = None, ngram: int | None = None) -> str:
    """The label of a method's strength: ``control``, ``delta2``, ``lambda0_5``, or ``alpha0_1-k3`` for others with a mixing share and a context length."""

    def short(value: float | None, name: str) -> str:
        if value is None:
            raise ValueError(f"{name} must be set for {method} runs")
        return f"{value:g}".replace(".", "_")

    if method == "control":
        return "control"
    if method == "radioactive":
        return f"delta{short(delta, 'delta')}"
    if method == "ads":
        return f"lambda{short(lam, 'lam')}"
    if alpha is not None and ngram is not None:
        return f"alpha{short(alpha, 'alpha')}-k{ngram}"
    raise ValueError(f"unsupported method: {method}")


def needs_think(model: Column) -> Column:
    """Whether a model's name asks for an opened thinking mark."""
    low = F.lower(model)
    return low.contains("r1") & low.contains("qwen")


def experiment_parts(name: Column) -> Column:
    """Struct (proxy, dataset) of ``teacher_proxy_dataset_nN``; nulls below three parts. The last ``_n`` begins the count."""
    at = F.length(name) - F.instr(F.reverse(name), "n_")  # characters before the last _n
    prefix = F.when(name.contains("_n"), F.substring(name, F.lit(1), at - 1)).otherwise(name)
    parts = F.split(prefix, "_")
    enough = F.size(parts) >= 3
    rest = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "_")
    return F.struct(F.when(enough, F.get(parts, F.lit(1))).alias("proxy"), F.when(enough, rest).alias("dataset"))


def metrics_dir_parts(name: Column) -> Column:
    """Struct (student, method, lr, epochs) of a ``{student}_{method}_lr{lr}_e{epochs}`` name; nulls if it is none.

    The last ``_lr`` ends the method, the first ``_e`` behind it the rate, and the first ``_`` the student.
    """
    pattern = r"(?s)^([^_]*)_(.*)_lr((?:(?!_lr|_e).)*)_e((?:(?!_lr).)*)$"
    found = name.rlike(pattern)
    return F.struct(*(F.when(found, F.regexp_extract(name, pattern, i + 1)).alias(n) for i, n in enumerate(("student", "method", "lr", "epochs"))))


def method_bucket(method: Column) -> Column:
    """``radioactive``, ``ads`` or ``control`` by the label's beginning; raises for others."""
    out = F.raise_error(F.concat(F.lit("unrecognised method label: "), F.coalesce(method, F.lit("null")))).cast("string")
    for kind in ("control", "ads", "radioactive"):
        out = F.when(method.startswith(kind), kind).otherwise(out)
    return out


def method_label(method: Column) -> Column:
    """What a plot says of a method: δ= or λ= and its strength."""
    dash = F.instr(method, "-")
    tail = F.when(dash > 0, F.substr(method, dash + 1)).otherwise(method)
    tail = F.replace(F.replace(F.replace(tail, F.lit("delta"), F.lit("")), F.lit("lambda"), F.lit("")), F.lit("_"), F.lit("."))
    kind = method_bucket(method)
    return F.concat(F.when(kind == "radioactive", "δ=").when(kind == "ads", "λ=").otherwise(""), tail)


def teacher_metric(mean_nll: Column, forced: Column, raw: Column) -> Column:
    """Struct (value, label): the mean NLL if there is one, else the forced, else the raw accuracy; nulls without any."""
    label = F.when(mean_nll.isNotNull(), "mean_nll").when(forced.isNotNull(), "answer_forced_accuracy").when(raw.isNotNull(), "raw_accuracy")
    return F.struct(F.coalesce(mean_nll, forced, raw).cast("double").alias("value"), label.alias("label"))


def labelled_paths(values: Iterable[str]) -> dict[str, str]:
    """``label=path`` arguments as a mapping; labels must be there and differ."""
    out: dict[str, str] = {}
    for value in values:
        label, mark, path = value.partition("=")
        label = label.strip()
        if not mark or not label or label in out:
            raise ValueError(f"not a new label=path: {value!r}")
        out[label] = path
    return out


def distinct_in_order(values: Iterable, least: int = 1) -> list:
    """The values once each in order of their first place; raises below ``least``."""
    out = list(dict.fromkeys(values))
    if len(out) < least:
        raise ValueError(f"at least {least} different values are needed")
    return out
