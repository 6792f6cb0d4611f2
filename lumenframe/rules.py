"""Advice from a profile and an anomaly summary: a repair plan and recommendations.

Each rule is a condition on the payloads; the rules run on the driver over small dicts."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import times
from .operators.profile import is_missing
from .operators.quantiles import medians


def _item(issue: str, columns: list[str], action: str, safe: bool, impact: str) -> dict:
    return {"issue": issue, "columns": columns, "recommended_action": action, "auto_fix_safe": safe, "expected_impact": impact}


def _geo_issues(profile: dict) -> int:
    g = profile["geospatial_summary"]
    return sum(g.get(k) or 0 for k in ("invalid_coordinate_pairs", "missing_coordinate_pairs", "invalid_latitude_values", "invalid_longitude_values"))


def _absent(profile: dict, expected: list[str] | None) -> list[str]:
    return [c for c in expected or [] if c not in profile["column_types"]]


def top_columns(records: list[dict], n: int) -> list[str]:
    return [c for c, _ in Counter(c for r in records for c in r.get("affected_columns", [])).most_common(n)]


def fix_plan(profile: dict, anomalies: dict, expected: list[str] | None = None) -> list[dict]:
    plan = []
    if absent := _absent(profile, expected):
        plan.append(_item("required columns are absent", absent, "Obtain the columns from the source.", False, "high"))
    for c, m in profile["missing_values"].items():
        pct = m["pct"]
        if pct > 30:
            plan.append(_item(f"{pct}% missing", [c], "Drop the column, or collect it anew.", False, "high"))
        elif pct >= 5:
            how = "median" if profile["column_types"].get(c) == "numeric" else "most common value"
            plan.append(_item(f"{pct}% missing", [c], f"Fill with the {how} and add a column that marks filled rows.", True, "medium"))
        elif pct > 0:
            plan.append(_item(f"{pct}% missing", [c], "Drop the rows.", True, "low"))
    if profile["duplicate_rows"]:
        plan.append(_item(f"{profile['duplicate_rows']} duplicate rows", [], "Keep the first of each.", True, "medium"))
    for c, n in profile["invalid_dates"].items():
        if n:
            plan.append(_item(f"{n} invalid dates", [c], "Set them to null and parse the rest.", True, "medium"))
    if n := _geo_issues(profile):
        g = profile["geospatial_summary"]
        plan.append(_item(f"{n} coordinate faults", [c for c in (g["latitude_column"], g["longitude_column"]) if c], "Check the pairs against the source.", False, "high"))
    if profile["constant_columns"]:
        plan.append(_item("constant columns", profile["constant_columns"], "Drop them.", True, "low"))
    if profile["high_cardinality_columns"]:
        plan.append(_item("very many categories", profile["high_cardinality_columns"], "Group or hash the values.", False, "medium"))
    if profile["skewed_numeric_columns"]:
        plan.append(_item("skewed numbers", list(profile["skewed_numeric_columns"]), "Consider a log transform.", False, "medium"))
    if out := [c for c, n in profile["outlier_counts"].items() if n]:
        plan.append(_item("outliers", out, "Review before clipping.", False, "high"))
    if mixed := [c for c, n in profile["type_mismatch_counts"].items() if n]:
        plan.append(_item("mixed types", mixed, "Split or convert the values.", False, "medium"))
    if anomalies.get("suspicious_count"):
        plan.append(_item("suspicious rows", top_columns(anomalies["records"], 5), "Review the listed rows.", False, "high"))
    return plan or [_item("no issues", [], "Nothing to do.", True, "low")]


def recommendations(profile: dict, anomalies: dict, expected: list[str] | None = None) -> list[str]:
    names = lambda cs, n: ", ".join(list(cs)[:n])
    out = []
    if absent := _absent(profile, expected):
        out.append(f"Add the required columns {names(absent, 6)}.")
    if profile["duplicate_rows"]:
        out.append(f"Remove {profile['duplicate_rows']} duplicate rows.")
    missing = sorted(((m["pct"], c) for c, m in profile["missing_values"].items() if m["count"]), key=lambda x: -x[0])
    if missing:
        out.append("Fill missing values: " + ", ".join(f"{c} ({p:.1f}%)" for p, c in missing[:4]) + ".")
    if profile["constant_columns"]:
        out.append(f"Constant columns carry nothing: {names(profile['constant_columns'], 5)}.")
    if profile["high_cardinality_columns"]:
        out.append(f"Very many categories: {names(profile['high_cardinality_columns'], 4)}.")
    if bad := [c for c, n in profile["invalid_dates"].items() if n]:
        out.append(f"Repair dates in {names(bad, 4)}.")
    g = profile["geospatial_summary"]
    if (n := _geo_issues(profile)) and g["latitude_column"] and g["longitude_column"]:
        out.append(f"Check {n} coordinate faults.")
    if mixed := [c for c, n in profile["type_mismatch_counts"].items() if n]:
        out.append(f"Mixed types in {names(mixed, 4)}.")
    if profile["skewed_numeric_columns"]:
        out.append("Skewed numbers may need a transform.")
    if far := [c for c, n in profile["outlier_counts"].items() if n]:
        out.append(f"Review outliers in {names(far, 5)}.")
    if anomalies.get("records"):
        out.append(f"Suspicious rows concentrate in {names(top_columns(anomalies['records'], 4), 4) or 'no single column'}.")
    if not anomalies.get("suspicious_count"):
        out.append("No suspicious rows were found.")
    return out or ["No action is needed."]


def apply_fixes(df: DataFrame, plan: list[dict], profile: dict) -> DataFrame:
    """``df`` after the plan's safe steps: duplicates, constant columns, few missing rows, filled
    medium gaps with a marking column, and dates parsed, those that are none set to null. NaN is missing too."""
    for step in (p for p in plan if p["auto_fix_safe"]):
        cols, what = step["columns"], step["issue"]
        if "duplicate" in what:
            df = df.dropDuplicates()
        elif what == "constant columns":
            df = df.drop(*cols)
        elif "invalid dates" in what:
            for c in cols:
                df = times.ordered(df, c)
        elif "missing" in what and cols:
            c = cols[0]
            if step["expected_impact"] == "low":
                df = df.filter(~is_missing(df, c))
            else:
                numeric = profile["column_types"].get(c) == "numeric"
                value = medians(df, {c: F.col(f"`{c}`")})[c] if numeric else df.agg(F.mode(f"`{c}`")).first()[0]
                df = df.withColumn(f"{c}_was_missing", is_missing(df, c)).withColumn(c, F.when(is_missing(df, c), F.lit(value)).otherwise(F.col(f"`{c}`")))
    return df
