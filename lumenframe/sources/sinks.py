"""Payloads as JSON: checked, made safe, and written to any store that Spark writes."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .readers import TableError, json_safe

#: What each part of an analysis has, and of which kind.
PROFILE = {"row_count": int, "column_count": int, "column_types": dict, "missing_values": dict, "duplicate_rows": int, "invalid_dates": dict, "outlier_counts": dict, "geospatial_summary": dict, "column_health": list}
ANOMALIES = {"total_rows": int, "suspicious_count": int, "severity_breakdown": dict, "anomaly_type_breakdown": dict, "anomaly_category_breakdown": dict, "anomaly_groups": list, "quality_anomalies": dict, "time_series_events": list, "anomaly_score_distribution": list, "records": list, "recommendations": list, "auto_fix_plan": list, "analysis_metadata": dict}


def checked(payload: dict) -> dict:
    """``payload`` as JSON can hold it; TableError names what is absent or of another kind."""
    wrong = [f"{part}.{k}" for part, of in (("profile", PROFILE), ("anomalies", ANOMALIES)) for k, kind in of.items() if not isinstance(payload.get(part, {}).get(k), kind)]
    wrong += [f"records.{i}.score" for i, r in enumerate(payload.get("anomalies", {}).get("records", [])) if not 0 <= r["score"] <= 1]
    if wrong or not isinstance(payload.get("dataset_id"), str):
        raise TableError(f"not an analysis: {', '.join(wrong) or 'dataset_id'}")
    return json_safe(payload)


def write_json(spark: SparkSession, payload: dict, path: str) -> None:
    """One line of JSON in the folder ``path``. A payload is bounded: lists are cut, counts are one for each column or kind."""
    spark.createDataFrame([(json.dumps(checked(payload), default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
