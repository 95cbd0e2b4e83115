"""Effect metrics of reference and alternative scores, over numbers and arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once for each row, not once for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log2_ratio(ref: Column, alt: Column, eps: float = EPS) -> Column:
    """log2((alt + eps) / (ref + eps)); null where a side is not positive (F-18, F-22)."""
    return F.when((ref + eps > 0) & (alt + eps > 0), F.log2((alt + eps) / (ref + eps)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))  # F-24


def softmax(a: Column) -> Column:
    """Softmax of an array, shifted by its maximum (F-24)."""
    powers = _let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))
    return _scaled(powers)


def _scaled(a: Column) -> Column:
    """An array scaled to sum 1."""
    return _let(a, lambda e: _let(_sum(e), lambda s: F.transform(e, lambda x: x / s)))


def logits_to_probs(logits: Column, method: str = "sigmoid", reduction: str | Callable[[Column], Column] | None = "mean") -> Column:
    """An array of logits as probabilities by sigmoid, softmax or log_softmax, reduced by mean, sum, a function of the array, or not at all (F-24)."""
    ways = {"sigmoid": lambda a: F.transform(a, sigmoid), "softmax": softmax, "log_softmax": lambda a: F.transform(softmax(a), F.ln)}
    if method not in ways:
        raise ValueError(f"no such method: {method}")
    if reduction is not None and not callable(reduction) and reduction not in ("mean", "sum"):
        raise ValueError(f"no such reduction: {reduction}")
    probs = ways[method](logits)
    if reduction is None:
        return probs
    return _let(probs, reduction if callable(reduction) else lambda a: _sum(a) / (F.size(a) if reduction == "mean" else F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(eps))  # F-25


def kl_divergence(p: Column, q: Column, low: float = 1e-10) -> Column:
    """Of two arrays, clipped at ``low`` and scaled to sum 1 (F-29)."""
    p, q = (_scaled(F.transform(x, lambda v: F.greatest(v, F.lit(low)))) for x in (p, q))
    return _sum(F.zip_with(p, q, lambda x, y: x * F.ln(x / y)))


def js_divergence(p: Column, q: Column) -> Column:
    middle_of = _let(F.struct(p.alias("p"), q.alias("q")), lambda s: F.zip_with(s["p"], s["q"], lambda x, y: (x + y) / 2))
    return _let(middle_of, lambda m: (kl_divergence(p, m) + kl_divergence(q, m)) / 2)  # F-27, textbook form


def entropy(a: Column, eps: float = 1e-8) -> Column:
    """Of an array scaled to sum 1 (F-32)."""
    return -_sum(F.transform(_scaled(a), lambda x: x * F.ln(x + eps)))


def delta_metrics(ref: Column, alt: Column) -> dict[str, Column]:
    """Mean, absolute mean, squared mean, signed maximum of differences, and COVR, of two arrays (F-19)."""
    d = F.zip_with(alt, ref, lambda x, y: x - y)
    n = F.size(d)
    covr = F.array_max(F.zip_with(ref, alt, lambda r, a: F.abs(log2_ratio(r, a))))
    return {"delta_mean": _sum(d) / n, "delta_abs_mean": _sum(F.transform(d, F.abs)) / n, "delta_sq_mean": dot(d, d) / n, "delta_max": F.array_max(d), "covr": covr}


def nonzero_mean(x: Column) -> Column:
    return F.avg(F.nullif(x, F.lit(0.0)))  # F-37


def middle(a: Column, n: int) -> Column:
    """The middle n elements of an array (S-07, S-08)."""
    return F.slice(a, F.greatest(F.floor((F.size(a) - n) / 2).cast("int") + 1, F.lit(1)), n)


#: How effects of each modality are scored (aggregation, scaling, eps, bins around the centre).
SCORING = {
    "rnaseq": ("mean", "log", 0.001, None),
    "atac": ("sum", "log2_ratio", 1.0, 501),
    "dnase": ("sum", "log2_ratio", 1.0, 501),
    "cage": ("sum", "log2_ratio", 1.0, 501),
    "procap": ("sum", "log2_ratio", 1.0, 501),
    "chip_tf": ("sum", "log2_ratio", 1.0, 501),
    "chip_histone": ("sum", "log2_ratio", 1.0, 2001),
    "splice_sites": ("max_abs_diff", None, 0.0, None),
    "splice_site_usage": ("max_abs_diff", None, 0.0, None),
    "splice_junctions": ("max_abs_log_diff", "log", 1.0, None),
    "contact_maps": ("mean_abs_diff", None, 0.0, None),
}


def _mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def _positive_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def around_centre(a: Column, width: int | None) -> Column:
    """``width`` bins around the centre of an array, all without a width."""
    if width is None:
        return a
    middle_ = F.floor(F.size(a) / 2).cast("int")
    start = F.greatest(middle_ - width // 2, F.lit(0))
    end = F.least(middle_ + width // 2 + 1, F.size(a))
    return F.slice(a, start + 1, end - start)


def fold_change(ref: Column, alt: Column, modality: str, centred: bool = True) -> Column:
    """Log fold change of two arrays as a modality is scored (F-17)."""
    how, scaling, eps, width = SCORING[modality]
    if centred:
        ref, alt = around_centre(ref, width), around_centre(alt, width)
    if how in ("max_abs_diff", "mean_abs_diff", "max_abs_log_diff"):
        log = how == "max_abs_log_diff"
        gaps = F.zip_with(ref, alt, lambda r, a: F.abs(_positive_log(a + eps) - _positive_log(r + eps)) if log else F.abs(a - r))
        return _mean(gaps) if how == "mean_abs_diff" else F.array_max(gaps)
    total = _sum if how == "sum" else _mean
    r, a = total(ref), total(alt)
    if scaling == "log":
        return _positive_log(a + eps) - _positive_log(r + eps)
    return log2_ratio(r, a, eps) if scaling == "log2_ratio" else a - r


def covr(ref: Column, alt: Column) -> Column:
    """The greatest absolute log2 ratio of two arrays (F-18)."""
    return F.array_max(F.zip_with(ref, alt, lambda r, a: F.abs(log2_ratio(r, a))))


def element_effects(ref: Column, alt: Column, how: str, as_abs: bool = False) -> Column:
    """delta, abs_delta or log2_ratio of each pair of elements of two arrays (F-22, F-23)."""
    ways = {"delta": lambda r, a: a - r, "abs_delta": lambda r, a: F.abs(a - r), "log2_ratio": lambda r, a: log2_ratio(r, a)}
    out = F.zip_with(ref, alt, ways[how])
    return F.transform(out, F.abs) if as_abs else out


def aggregated(values: list[Column], how: str) -> Column:
    """mean, max or sum of metrics of several modalities (F-21)."""
    total = sum(values[1:], values[0])
    return F.greatest(*values) if how == "max" else total / len(values) if how == "mean" else total


def kl_pointwise(wt: Column, mut: Column) -> Column:
    """Mean of q (ln q - p) for the sigmoid means p and q of two arrays of logits: divergence that takes p as a log already (F-26)."""
    p, q = (_mean(F.transform(x, sigmoid)) for x in (wt, mut))
    return q * (F.ln(q) - p)


def js_pointwise(wt: Column, mut: Column) -> Column:
    """The same divergence of either side from their mean, halved (F-27)."""
    p, q = (_mean(F.transform(x, sigmoid)) for x in (wt, mut))
    m = (p + q) / 2
    return (m * (F.ln(m) - p) + m * (F.ln(m) - q)) / 2


def probability_difference(wt: Column, mut: Column) -> Column:
    return _mean(F.transform(mut, sigmoid)) - _mean(F.transform(wt, sigmoid))  # F-28


def log_ratio_mean(wt: Column, mut: Column) -> Column:
    """Mean of ln(mut / wt) over two arrays of probabilities (F-30)."""
    return _mean(F.zip_with(wt, mut, lambda w, m: F.ln(m / w)))


def windows_mean(a: Column, width: int) -> Column:
    """Means of windows without overlap, a remainder dropped."""
    if width == 1:
        return a
    at = F.sequence(F.lit(0), F.floor(F.size(a) / width).cast("int") - 1)
    return F.transform(at, lambda k: _mean(F.slice(a, k * width + 1, F.lit(width))))


def multiscale_entropy(a: Column, scales: tuple[int, ...] = (1, 2, 3), eps: float = 1e-8) -> Column:
    """Entropy of the softmax of an array at each scale (F-33). The array holds as many elements as the largest scale."""
    return F.array(*(_let(softmax(windows_mean(a, s)), lambda p: -_sum(F.transform(p, lambda x: x * F.ln(x + eps)))) for s in scales))


def complexity_index(entropies: Column, scales: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Area under the entropies over scales, by trapezoids (F-33)."""
    return sum(((entropies[k] + entropies[k + 1]) / 2 * (scales[k + 1] - scales[k]) for k in range(len(scales) - 1)), F.lit(0.0))


def median_of(a: Column, lower: bool = False) -> Column:
    """Median of an array; the lower middle one of an even number if ``lower`` (F-35)."""
    mid = lambda s: F.element_at(s, F.floor((F.size(s) + 1) / 2).cast("int"))
    high = lambda s: F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)
    return _let(F.array_sort(a), lambda s: mid(s) if lower else (mid(s) + high(s)) / 2)


def median_absolute_deviation(a: Column, lower: bool = False) -> Column:
    return _let(median_of(a, lower), lambda m: median_of(F.transform(a, lambda x: F.abs(x - m)), lower))  # F-35


def deviation(a: Column, unbiased: bool = True) -> Column:
    """Standard deviation of an array, with or without Bessel's correction (F-36)."""
    squares = _let(_mean(a), lambda m: _sum(F.transform(a, lambda x: (x - m) * (x - m))))
    return F.sqrt(squares / (F.size(a) - 1 if unbiased else F.size(a)))


def splice_gain_loss(ref: dict[str, Column], alt: dict[str, Column], annotated: dict[str, Column]) -> dict[str, Column]:
    """Gain outside and loss inside of annotated sites, for acceptor and donor (F-38). Without annotation nothing is masked."""
    out = {}
    for site in ("acceptor", "donor"):
        d, mask = alt[site] - ref[site], annotated.get(site)
        out[f"{site}_gain"] = d if mask is None else d * (1 - mask)
        out[f"{site}_loss"] = -d if mask is None else -d * mask
    return out
