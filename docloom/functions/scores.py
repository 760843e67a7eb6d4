"""Percentiles, rates and confidence scores with the semantics the analytics need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def floor_percentile(values: Column, ratio: float) -> Column:
    """sorted[floor((n - 1) * ratio)] of an array without nulls; null if it is empty."""
    return F.get(F.array_sort(values), F.floor((F.size(values) - 1) * F.lit(ratio)).cast("int"))


def rate(part: Column, whole: Column) -> Column:
    """0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def math_round(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ocr_run_score(class_confidence, supported, token_confidence, tokens, length, success) -> Column:
    """0.52 class + 0.32 supported + 0.1 tokens' confidence + 0.03 each for token count and length; failed runs 0."""
    s = 0.52 * col(class_confidence) + F.when(col(supported), 0.32).otherwise(0.0) + 0.1 * col(token_confidence)
    s = s + 0.03 * F.least(col(tokens), F.lit(240)) / 240 + 0.03 * F.least(col(length), F.lit(6000)) / 6000
    return F.when(col(success) & (col(length) > 0), F.round(s, 6)).otherwise(0.0)


def field_confidence(token, candidate, agreement, adjudicated, issues, checksum_valid, critical) -> Column:
    """The best signal from 0.66 up, less issues, more for a valid check digit or a critical field without issues."""
    best = F.greatest(F.lit(0.66), col(token), col(candidate), 0.52 + 0.38 * col(agreement), col(adjudicated))
    less = best - F.least(F.lit(0.18), 0.05 * col(issues))
    checked = F.when(col(checksum_valid), F.greatest(less, F.lit(0.99))).otherwise(less)
    return clamp(checked + F.when(col(critical) & (col(issues) == 0), 0.04).otherwise(0.0), 0.05, 0.99)


def integrity(run_valid, mrz_valid, cross_side, quality, agreement) -> Column:
    """From 0.74; null run, zone or cross-side results say nothing but the last, which costs 0.05."""
    s = F.lit(0.74) + F.when(col(run_valid), 0.12).when(~col(run_valid), -0.22).when(col(mrz_valid), 0.14).when(~col(mrz_valid), -0.25).otherwise(0.0)
    s = s + F.when(col(cross_side), 0.08).when(~col(cross_side), -0.20).otherwise(-0.05)
    s = s + F.when(col(quality) < 0.55, -0.14).when(col(quality) >= 0.82, 0.04).otherwise(0.0)
    s = s + F.when(col(agreement) < 0.65, -0.12).when(col(agreement) >= 0.90, 0.05).otherwise(0.0)
    return clamp(s, 0.05, 0.99)


def risk_band(score: Column | str) -> Column:
    return F.when(col(score) >= 0.82, "low").when(col(score) >= 0.62, "medium").otherwise("high")


def capture_conditions(quality, blur, glare, crop, coverage, skew, perspective) -> Column:
    """Ordered tags of how a page was captured; clean if nothing else holds."""
    quality, blur, glare, crop, coverage = map(col, (quality, blur, glare, crop, coverage))
    clean = (quality >= 0.86) & (blur < 0.2) & (glare < 0.18) & (crop >= 0.95)
    tags = F.array_compact(F.array(
        F.when(clean, "clean"), F.when(quality < 0.8, "low_quality"), F.when(blur >= 0.24, "blur"), F.when(glare >= 0.24, "glare"), F.when((crop < 0.94) | (coverage < 0.82), "cropped"),
        F.when(coverage < 0.58, "small_document_in_frame"), F.when(coverage < 0.58, "needs_zoom_crop"), F.when(F.abs(col(skew)) >= 2.5, "tilt"), F.when(col(perspective), "perspective"),
        F.when((quality < 0.72) & (glare < 0.18), "low_light"), F.when((quality < 0.58) | (blur >= 0.36), "extreme_low_quality"),
    ))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("clean")))


def issue_penalty(high, medium, other) -> Column:
    """0.09, 0.045 and 0.02 for an issue by severity, 0.35 at most."""
    return F.least(F.lit(0.35), 0.09 * col(high) + 0.045 * col(medium) + 0.02 * col(other))


def validation_confidence(high, medium, other) -> Column:
    return F.round(clamp(0.96 - issue_penalty(high, medium, other), 0.05, 0.99), 3)


def confidence_reasons(quality, ocr, consensus, integrity, penalty) -> Column:
    """What a document's confidence rests on, in that order; nulls and a penalty of 0 say nothing."""
    named = (("quality", col(quality)), ("ocr", col(ocr)), ("consensus", col(consensus)), ("integrity", col(integrity)), ("validation_penalty", F.when(col(penalty) > 0, col(penalty))))
    return F.array_compact(F.array(*(F.when(c.isNotNull(), F.format_string(f"{name}=%.2f", c.cast("double"))) for name, c in named)))


def skew_angle(corners: Column) -> Column:
    """Degrees that a page is turned by, from its corners (arrays of x and y: top left, top right, bottom right, bottom left): the mean slope of its upper and lower edge, each taken as one pixel wide at least; 0 without four corners."""
    slope = lambda a, b: (corners[b][1] - corners[a][1]) / F.greatest(F.lit(1.0), corners[b][0] - corners[a][0])
    return F.when(F.size(corners) == 4, F.round(F.degrees(F.atan((slope(0, 1) + slope(3, 2)) / 2)), 3)).otherwise(F.lit(0.0))
