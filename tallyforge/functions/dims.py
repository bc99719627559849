"""Static dimensions: labels, regions, label groups and confidence policies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The label space (id, code, country, region).
LABELS = (
    (0, "AE", "United Arab Emirates", "gulf"),
    (1, "BH", "Bahrain", "gulf"),
    (2, "DJ", "Djibouti", "east_africa"),
    (3, "DZ", "Algeria", "maghreb"),
    (4, "EG", "Egypt", "nile"),
    (5, "IQ", "Iraq", "iraqi"),
    (6, "JO", "Jordan", "levant"),
    (7, "KM", "Comoros", "east_africa"),
    (8, "KW", "Kuwait", "gulf"),
    (9, "LB", "Lebanon", "levant"),
    (10, "LY", "Libya", "maghreb"),
    (11, "MA", "Morocco", "maghreb"),
    (12, "MR", "Mauritania", "maghreb"),
    (13, "OM", "Oman", "gulf"),
    (14, "PS", "Palestine", "levant"),
    (15, "QA", "Qatar", "gulf"),
    (16, "SA", "Saudi Arabia", "gulf"),
    (17, "SD", "Sudan", "nile"),
    (18, "SO", "Somalia", "east_africa"),
    (19, "SY", "Syria", "levant"),
    (20, "TD", "Chad", "sahel"),
    (21, "TN", "Tunisia", "maghreb"),
    (22, "YE", "Yemen", "gulf"),
)
# Groups of labels; a label may stand in several, in the order of its local index.
GROUPS = {
    "maghreb": ("MA", "DZ", "TN", "LY", "MR"),
    "levant": ("LB", "SY", "PS", "JO"),
    "gulf": ("AE", "BH", "KW", "QA", "OM", "SA", "YE"),
    "arabian": ("SA", "YE", "OM"),
    "nile": ("EG", "SD"),
    "east_africa": ("DJ", "KM", "SO"),
}

CODES = tuple(code for _, code, _, _ in LABELS)
COUNTRIES = tuple(country for _, _, country, _ in LABELS)
LABEL_REGIONS = tuple(region for _, _, _, region in LABELS)
REGIONS = tuple(sorted(set(LABEL_REGIONS)))
N = len(LABELS)


@dataclass(frozen=True)
class Policy:
    name: str
    min_score: float
    min_margin: float
    max_entropy: float | None = None
    weak_region: bool = False
    weak_top1: bool = False


# Confidence policies, in report order.
POLICIES = (
    Policy("strong_model_only", 0.95, 0.50),
    Policy("sure_model_only", 0.98, 0.75, 0.60),
    Policy("ultra_sure_model_only", 0.99, 0.85, 0.40),
    Policy("sure_with_weak_region", 0.98, 0.75, 0.60, weak_region=True),
    Policy("sure_with_weak_top1", 0.98, 0.75, 0.60, weak_top1=True),
)
# Buckets as (from, to, name), the lower limit inside.
CONFIDENCE_BUCKETS = (
    (0.0, 0.50, "<0.50"),
    (0.50, 0.70, "0.50-0.70"),
    (0.70, 0.85, "0.70-0.85"),
    (0.85, 0.95, "0.85-0.95"),
    (0.95, 0.98, "0.95-0.98"),
    (0.98, 1.0000001, ">=0.98"),
)
DURATION_BUCKETS = (
    (0.0, 3.0, "<3s"),
    (3.0, 10.0, "3-10s"),
    (10.0, 20.0, "10-20s"),
    (20.0, 30.0, "20-30s"),
    (30.0, 60.0, "30-60s"),
    (60.0, float("inf"), ">=60s"),
)
CHUNK_BUCKETS = ("1", "2", "3-4", "5-8", "9+")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELS), "id int, code string, country string, region string")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REGIONS)), "region_id int, region string")


def groups(spark: SparkSession) -> DataFrame:
    rows = [(g, k, code, CODES.index(code)) for g, codes in GROUPS.items() for k, code in enumerate(codes)]
    return spark.createDataFrame(rows, "label_group string, local_idx int, code string, id int")


def policies(spark: SparkSession) -> DataFrame:
    rows = [(k, p.name, p.min_score, p.min_margin, p.max_entropy, p.weak_region, p.weak_top1) for k, p in enumerate(POLICIES)]
    return spark.createDataFrame(rows, "position int, policy string, min_score double, min_margin double, max_entropy double, weak_region boolean, weak_top1 boolean")
