"""The HTML report of an analysis; every value is escaped."""

from __future__ import annotations

from collections.abc import Iterable
from html import escape


def _table(head: list[str], rows: Iterable[Iterable]) -> str:
    body = "".join("<tr>" + "".join(f"<td>{escape(str('' if v is None else v))}</td>" for v in r) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(f"<th>{escape(h)}</th>" for h in head) + f"</tr>{body}</table>" if body else "<p>None.</p>"


def html_report(name: str, profile: dict, anomalies: dict) -> str:
    g = profile["geospatial_summary"]
    missing = sorted(profile["missing_values"].items(), key=lambda x: -x[1]["pct"])[:10]
    sections = [
        ("Table", _table(["rows", "columns", "duplicate rows"], [[profile["row_count"], profile["column_count"], profile["duplicate_rows"]]])),
        ("Severity", _table(["severity", "rows"], anomalies["severity_breakdown"].items())),
        ("Groups", _table(["category", "rows", "top score", "columns", "signals"], [[x["category"], x["count"], x["top_score"], ", ".join(c["name"] for c in x["top_affected_columns"]), ", ".join(s["name"] for s in x["signals"])] for x in anomalies["anomaly_groups"]])),
        ("Types", _table(["type", "rows"], anomalies["anomaly_type_breakdown"].items())),
        ("Data quality", _table(["issue", "count", "columns"], [[k, v["count"], ", ".join(v["columns"])] for k, v in anomalies["quality_anomalies"].items()])),
        ("Coordinates", _table(["latitude", "longitude", "valid", "invalid", "missing"], [[g["latitude_column"], g["longitude_column"], g["valid_coordinate_pairs"], g["invalid_coordinate_pairs"], g["missing_coordinate_pairs"]]] if g["has_geospatial_data"] else [])),
        ("Events", _table(["column", "kind", "position", "time", "deviation", "threshold", "what happened"], [[e[k] for k in ("column", "kind", "pos", "timestamp", "deviation", "threshold", "message")] for e in anomalies["time_series_events"][:40]])),
        ("Missing values", _table(["column", "count", "%"], [[c, m["count"], m["pct"]] for c, m in missing if m["count"]])),
        ("Recommendations", "<ul>" + "".join(f"<li>{escape(r)}</li>" for r in anomalies["recommendations"]) + "</ul>"),
        ("Repair plan", _table(["issue", "columns", "action", "safe", "impact"], [[p["issue"], ", ".join(p["columns"]), p["recommended_action"], p["auto_fix_safe"], p["expected_impact"]] for p in anomalies["auto_fix_plan"]])),
        ("Suspicious rows", _table(["key", "score", "severity", "types", "explanation"], [[r["key"], r["score"], r["severity"], ", ".join(r["types"]), r["explanation"]] for r in anomalies["records"][:30]])),
    ]
    body = "".join(f"<section><h2>{escape(t)}</h2>{h}</section>" for t, h in sections)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(name)}</title></head><body><h1>{escape(name)}</h1>{body}</body></html>"
