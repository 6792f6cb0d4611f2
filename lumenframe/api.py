"""The engine: tables registered once, profiled, analysed, reported, in jobs if wanted."""

from __future__ import annotations

import math
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules
from .config import DEFAULT, Config
from .operators import profile, quality, sampling, times
from .plans import analysis, explain
from .report import html_report
from .session import Owner, into, owned, written
from .sources.readers import capabilities, metadata, read_table, url_filename, with_row_index
from .sources.sinks import write_json


class NotFound(KeyError):
    """No such table or job."""


class Dataset:
    """One table; results are kept, and rules run anew for each set of expected columns."""

    def __init__(self, name: str, df: DataFrame, config: Config = DEFAULT):
        self.id, self.name, self.config = uuid.uuid4().hex, name, config
        #: What the results are made from; it goes with close().
        self.owner = Owner(df.sparkSession)
        with into(self.owner):
            self.df = df if "row_index" in df.columns else with_row_index(df)
        self._profile: dict | None = None
        self._analysis: Analysis | None = None
        self._lock = threading.RLock()

    def close(self) -> None:
        """Deletes the tables behind the results."""
        with self._lock:
            if self.owner.users:
                self._analysis = None
                self.owner.let_go()

    @property
    def data(self) -> DataFrame:
        return self.df.drop("row_index")

    def preview(self) -> dict:
        return {"dataset_id": self.id, "filename": self.name, **metadata(self.df)}

    def profile(self) -> dict:
        with self._lock:
            if self._profile is None:
                with owned(self.df.sparkSession):
                    self._profile = build_profile(self.data, self.config)
            return self._profile

    def anomalies(self, top_n: int | None = None, expected_columns: list[str] | None = None) -> dict:
        top_n = self.config.top_n if top_n is None else top_n
        if not 1 <= top_n <= 1000:
            raise ValueError("top_n is 1 to 1000")
        with self._lock:
            p = self.profile()
            if self._analysis is None:  # once, for every top_n
                self._analysis = Analysis(self.df, p, self.config, self.owner)
            with owned(self.df.sparkSession):
                a = self._analysis.payload(top_n)
        return a | {"recommendations": rules.recommendations(p, a, expected_columns), "auto_fix_plan": rules.fix_plan(p, a, expected_columns)}

    def analyze(self, top_n: int | None = None, expected_columns: list[str] | None = None) -> dict:
        return {"dataset_id": self.id, "profile": self.profile(), "anomalies": self.anomalies(top_n, expected_columns)}

    def sampled(self, top_n: int | None = None, expected_columns: list[str] | None = None, rows: int | None = None) -> dict:
        """analyze() of a uniform sample of rows (config.sample_rows), for a first look at a huge table. Rows and missing cells are exact, from one scan of
        the table; duplicates come from a sample of kinds; other counts are scaled by the share of rows, once, and ``intervals`` tells
        how far off they may be. Shares, types, quantiles, scores and the listed rows are the sample's."""
        spark, config = self.df.sparkSession, self.config
        with owned(spark):
            plain, scan = profile._plain(self.data), profile.Scan(self.data)
            for c in plain:
                scan.add("missing", c, value=F.count_if(profile.is_missing(self.data, c)))
            exact = scan.run()
            n = exact["rows",]
            size = min(n, max(config.sample_least, rows or config.sample_rows))
            part = written(sampling.hash_sample(self.df, "row_index", size, config.seed)) if size < n else self.df
            p = build_profile(part.drop("row_index"), config)
            owner = Owner(spark)
            try:
                a = Analysis(part, p, config, owner).payload(config.top_n if top_n is None else top_n)
            finally:
                owner.let_go()
            copies = sampling.scaled_duplicates(self.data, n, size)
        intervals: dict[str, tuple[int, int]] = {}

        def up(path: str, hits: int) -> int:
            found, low, high = sampling.scaled(hits, size, n)
            intervals[path] = (low, high)
            return found

        def up_all(path: str, of: dict) -> dict:
            return {k: up(f"{path}.{k}", v) for k, v in of.items()}

        missing = {c: {"count": exact["missing", c], "pct": round(100 * exact["missing", c] / n, 2) if n else 0.0} for c in plain}
        p = p | {"row_count": n, "missing_values": missing, "duplicate_rows": copies[0], "column_health": profile.with_missing(p["column_health"], {c: m["pct"] for c, m in missing.items()})}
        p |= {k: up_all(k, p[k]) for k in ("invalid_dates", "outlier_counts", "type_mismatch_counts")}
        g = p["geospatial_summary"]
        p["geospatial_summary"] = g | up_all("geospatial_summary", {k: v for k, v in g.items() if k.endswith(("_pairs", "_values"))})
        intervals["duplicate_rows"] = copies[1:]
        # set by what the table says, not scaled again
        known = {"missing_values": sum(m["count"] for m in missing.values()), "duplicates": copies[0], "extreme_skew": a["quality_anomalies"]["extreme_skew"]["count"]}
        issues = {k: v | {"count": known[k] if k in known else up(f"quality_anomalies.{k}", v["count"])} for k, v in a["quality_anomalies"].items()}
        types = {k: v for k, v in a["anomaly_type_breakdown"].items() if not k.startswith("data_quality_")}
        a = a | {"total_rows": n, "quality_anomalies": issues, "suspicious_count": up("suspicious_count", a["suspicious_count"]), "severity_breakdown": up_all("severity_breakdown", a["severity_breakdown"])}
        a["anomaly_type_breakdown"] = up_all("anomaly_type_breakdown", types) | {f"data_quality_{k}": v["count"] for k, v in issues.items()}
        a["anomaly_category_breakdown"] = {c: min(n, sum(a["anomaly_type_breakdown"].get(t, 0) for t in of)) for c, of in analysis.CATEGORIES.items()} | {"data_quality": sum(v["count"] for v in issues.values())}
        a["anomaly_groups"] = [x | {"count": sum(v["count"] for v in issues.values()) if x["category"] == "data_quality" else up(f"anomaly_groups.{x['category']}", x["count"]), "severity_breakdown": up_all(f"anomaly_groups.{x['category']}", x["severity_breakdown"])} for x in a["anomaly_groups"]]
        a["analysis_metadata"] = {"analysis_mode": "sampled", "approximate": size < n, "sampled_rows": size, "sampled_ratio": round(size / max(1, n), 6), "intervals": intervals}
        a |= {"recommendations": rules.recommendations(p, a, expected_columns), "auto_fix_plan": rules.fix_plan(p, a, expected_columns)}
        return {"dataset_id": self.id, "profile": p, "anomalies": a}

    def write(self, path: str, top_n: int | None = None, expected_columns: list[str] | None = None) -> None:
        """analyze() as JSON at ``path``."""
        write_json(self.df.sparkSession, self.analyze(top_n, expected_columns), path)

    def report(self, top_n: int | None = None, expected_columns: list[str] | None = None) -> str:
        return html_report(self.name, self.profile(), self.anomalies(top_n, expected_columns))

    def repaired(self) -> DataFrame:
        p = self.profile()
        return rules.apply_fixes(self.data, rules.fix_plan(p, {"records": []}), p)


def build_profile(df: DataFrame, config: Config = DEFAULT) -> dict:
    """The profile of ``df``. All counts and shares come from one scan, samples, quantiles, distinct values, dates and places from
    one or a few more each: the number of Spark jobs doesn't depend on the number of columns."""
    plain, scan = profile._plain(df), profile.Scan(df)
    kinds = {c: profile.kind_of(df, c) for c in plain}
    for c in plain:
        scan.add("missing", c, value=F.count_if(profile.is_missing(df, c)))
        if config.distinct == "by need":
            scan.add("distinct", c, value=profile.distinct_sketch(df, c))
        if kinds[c] != "time":
            x = profile.as_number(df, c)
            for name, test in (("castable", x.isNotNull()), ("lat_share", x.between(-90, 90)), ("lon_share", x.between(-180, 180))):
                scan.add(name, c, value=F.round(F.avg(test.cast("double")), 6))
        if kinds[c] == "number":
            scan.add("whole", c, value=profile.whole_share(df, c))
            known = F.when(~profile.is_missing(df, c), F.col(f"`{c}`").cast("double"))
            n = F.count(known)
            scan.add("skew", c, value=F.skewness(known) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))
    got = scan.run()
    rows = got["rows",]
    present = {c: rows - got["missing", c] for c in plain}
    if config.distinct == "by need":
        unique = profile.distinct_by_need(df, {c: got["distinct", c] for c in plain}, present)
    else:
        unique = {r["column"]: (r["distinct_values"], True) for r in profile.distinct(df, plain).collect()} if plain else {}
    stats = {c: {"rows": rows, "missing": got["missing", c], "distinct_values": unique[c][0]} for c in plain}
    sampled = profile.samples(df, [c for c in plain if kinds[c] != "time"], 500)
    types = profile.typed(df, stats, {c: got.get(("whole", c)) for c in plain}, {c: v[: profile.SAMPLE] for c, v in sampled.items()})
    of = lambda *of_types: [c for c, t in types.items() if t in of_types]
    numeric, texts = [c for c in of("numeric")], of("categorical", "text")
    skewed = {c: round(got["skew", c], 3) for c in numeric if got.get(("skew", c)) is not None and math.isfinite(got["skew", c]) and abs(got["skew", c]) > 1}
    outliers = {r["column"]: r["outliers"] for r in (profile.iqr_outliers(df, numeric).collect() if numeric else [])}
    mixed = {}
    for c in texts:
        castable = (got["castable", c] or 0.0) * rows / present[c] if present[c] and kinds[c] == "text" else 1.0
        if 0.2 <= castable < 0.95:
            mixed[c] = present[c] - round((got["castable", c] or 0.0) * rows)
    dates = {c: there - valid for c, (there, valid) in times.counted(df, of("date")).items()}
    places = [{"column": c, **{k: got[k, c] for k in ("castable", "lat_share", "lon_share")}} for c in plain if kinds[c] != "time"]
    lat, lon = profile.pick_coordinates(places)
    summary = dict.fromkeys(("valid_coordinate_pairs", "invalid_coordinate_pairs", "missing_coordinate_pairs", "invalid_latitude_values", "invalid_longitude_values"), 0) | {"bbox": None}
    if lat and lon:
        g = profile.geo_summary(df, lat, lon).first().asDict()
        summary = {"valid_coordinate_pairs": g["valid_pairs"], "invalid_coordinate_pairs": g["invalid_pairs"], "missing_coordinate_pairs": g["missing_pairs"], "invalid_latitude_values": g["invalid_latitude"], "invalid_longitude_values": g["invalid_longitude"], "bbox": {k: g[k] for k in ("min_lat", "max_lat", "min_lon", "max_lon")}}
    likely = []
    for c in texts:
        like = [v for v in sampled.get(c, []) if v.strip().upper().startswith(tuple(profile.GEOMETRIES.split("|"))) and "(" in v]
        if sampled.get(c) and len(like) >= 0.6 * len(sampled[c]):
            likely.append(c)
    shapes = profile.invalid_geometries(df, likely)
    summary |= {"has_geospatial_data": bool((lat and lon) or shapes), "latitude_column": lat, "longitude_column": lon, "geometry_columns": list(shapes), "invalid_geometry_values": sum(shapes.values())}
    health = []
    high = [c for c in texts if stats[c]["distinct_values"] > 50 and stats[c]["distinct_values"] > 0.5 * rows]
    constant = [c for c in stats if stats[c]["distinct_values"] <= 1]
    for c, s in stats.items():
        pct = round(100 * s["missing"] / rows, 2) if rows else 0.0
        issues = [n for n, on in (
            (profile.MISSING, s["missing"]), ("constant", c in constant), ("high cardinality", c in high), ("invalid dates", dates.get(c)), ("type mismatch", mixed.get(c)), ("skewed", c in skewed), ("outliers", outliers.get(c)),
            ("invalid coordinates", c in (lat, lon) and (summary["invalid_latitude_values"] if c == lat else summary["invalid_longitude_values"])), ("invalid geometries", shapes.get(c))) if on]
        health.append({"column": c, "type": types[c], "missing_pct": pct, "unique_count": s["distinct_values"], "unique_exact": unique[c][1], "status": profile.status_of(pct, issues), "issues": issues})
    return {
        "row_count": rows, "column_count": len(df.columns), "column_types": types, "missing_values": {c: {"count": s["missing"], "pct": round(100 * s["missing"] / rows, 2) if rows else 0.0} for c, s in stats.items()},
        "duplicate_rows": profile.duplicate_rows(df).first()[0], "constant_columns": constant, "high_cardinality_columns": high, "invalid_dates": dates, "skewed_numeric_columns": skewed,
        "outlier_counts": outliers, "type_mismatch_counts": mixed, "geospatial_summary": summary, "column_health": health}


class Analysis:
    """All that the detectors found in ``df`` (with ``row_index``). What they write on their way is deleted once the labelled rows are
    written for ``owner``; a payload only lists them."""

    def __init__(self, df: DataFrame, p: dict, config: Config, owner: Owner):
        with owned(df.sparkSession):
            self._judge(df, p, config, owner)

    def _judge(self, df: DataFrame, p: dict, config: Config, owner: Owner) -> None:
        self.df, self.p, self.config = df, p, config
        types, g = p["column_types"], p["geospatial_summary"]
        data = df.drop("row_index")
        filled = [c for c in types if types[c] == "numeric" and p["missing_values"][c]["count"] < p["row_count"]]
        kinds = {c: t for c, t in types.items() if t in ("categorical", "text")}
        distinct = {h["column"]: h["unique_count"] for h in p["column_health"]}
        spellings = [c for c in kinds if distinct[c] <= 200]
        faulty = quality.summary(written(quality.by_column(data, filled, spellings, [c for c, t in types.items() if t == "date"], (g["latitude_column"], g["longitude_column"]) if g["latitude_column"] and g["longitude_column"] else None))).collect()  # seven rows
        issues = {r["issue"]: {"count": r["n"], "columns": r["columns"]} for r in faulty}
        counts = {k: v["count"] for k, v in issues.items()}
        against = 0 < config.lof_switch < p["row_count"]
        trained = min(p["row_count"], config.lof_rows) if against else p["row_count"]
        base = {"total_rows": p["row_count"], "quality_anomalies": issues, "analysis_metadata": {"analysis_mode": "full", "approximate": against, "sampled_rows": trained, "sampled_ratio": round(trained / max(1, p["row_count"]), 6)}}
        self.base, self.order, self.every, self.counts, self.filled = base, None, None, counts, filled
        if not filled:
            return
        order = self.order = times.best_time(df, [c for c, t in types.items() if t == "date"])
        work = times.ordered(df, order) if order else df
        contexts = [c for c, t in types.items() if t == "categorical" and 1 < distinct[c] <= config.context_values][: config.context_columns]
        coordinates = (g["latitude_column"], g["longitude_column"]) if g["latitude_column"] and g["longitude_column"] else None
        base_rows = analysis.series_base(work, "row_index", filled, order) if order else None
        events = written(analysis.events_of(work, "row_index", filled, order, config, base_rows)) if order else None
        self.every = owner.written(analysis.judged(work, "row_index", filled, order, contexts, coordinates, config, events).select("row_index", "raw", "score", "severity", "types", "category", "categories", "affected", "action", "methods", "why", "beyond", "iso_norm", "lof_norm"))
        self.shown: list = []
        if order:
            listed = written(analysis.listed(events, filled, config))
            places = {c: i for i, c in enumerate(filled)}
            self.shown = sorted(explain.enriched(listed, base_rows, order, [c for c in filled if c != order]).collect(), key=lambda e: (places[e["column"]], analysis.KINDS.index(e["kind"]), e["pos"]))

    def payload(self, top_n: int) -> dict:
        """Breakdowns over all rows, groups, events, and the ``top_n`` most suspicious rows: only these reach the driver."""
        df, config, order, every, counts, shown, base = self.df, self.config, self.order, self.every, self.counts, self.shown if self.every is not None else [], self.base
        p, data = self.p, self.df.drop("row_index")
        if self.every is None:
            return base | {"suspicious_count": 0, "severity_breakdown": {"low": p["row_count"]}, "anomaly_type_breakdown": {}, "anomaly_category_breakdown": {}, "anomaly_groups": [], "time_series_events": [], "anomaly_score_distribution": [], "records": []}
        # breakdowns are over all rows; only lists are over the visible ones
        counted = analysis.breakdowns(every).collect()
        sums = {r["name"]: r["n"] for r in counted if r["what"] == "type"}
        categories = {c: sum(sums[t] for t in of) for c, of in analysis.CATEGORIES.items()} | {"data_quality": sum(counts.values())}
        severities = {r["name"]: r["n"] for r in counted if r["what"] == "severity"}
        found = analysis.visible(every)
        first = [F.desc("score"), F.desc(F.size("types")), "row_index"]
        records_of = df.select("row_index", analysis.record_of(df, ("row_index",)).alias("record"), (F.col(f"`{order}`") if order else F.lit(None)).cast("string").alias("time_text"))

        def described(few: DataFrame) -> DataFrame:
            """``few`` listed rows with their record, reasons and explanation; only ``few`` is broadcast."""
            joined = records_of.join(F.broadcast(few), "row_index").withColumn("reasons", explain.reasons(config))
            return joined.withColumn("explanation", explain.explanation(F.col("time_text") if order else None, order or ""))

        groups = explain.groups(found, "row_index", counts, described)
        rows = described(found.orderBy(*first).limit(top_n)).orderBy(*first).collect()
        told: dict[int, list[str]] = {}
        for e in shown:
            if len(told.setdefault(e["row_index"], [])) < 2:
                told[e["row_index"]].append(e["message"])
        records = []
        for r in rows:
            of_time = told.get(r["row_index"], [])
            records.append({"key": r["row_index"], "score": r["score"], "severity": r["severity"], "category": r["category"], "categories": r["categories"], "types": r["types"], "methods": r["methods"], "reasons": r["reasons"], "time_details": of_time, "action": r["action"], "record": r["record"],
                            "affected_columns": r["affected"], "explanation": r["explanation"] + (f" Series: {of_time[0]}." if of_time else "")})
        return base | {
            "suspicious_count": sum(x["count"] for x in groups if x["category"] != "data_quality"), "severity_breakdown": severities, "anomaly_type_breakdown": sums | {f"data_quality_{k}": n for k, n in counts.items()}, "anomaly_category_breakdown": categories,
            "anomaly_groups": groups,
            "time_series_events": [e.asDict() for e in shown], "anomaly_score_distribution": [r["score"] for r in every.orderBy(F.desc("raw"), "row_index").limit(400).collect()], "records": records}


@dataclass
class Job:
    job_id: str
    status: str = "queued"
    stage: str = "queued"
    progress: float = 0.0
    error: str | None = None
    result: dict | None = None
    created: float = field(default_factory=time.time)
    finished: float | None = None


class Engine:
    def __init__(self, spark: SparkSession, config: Config = DEFAULT):
        self.spark, self.config = spark, config
        self._tables: dict[str, Dataset] = {}
        self._jobs: dict[str, Job] = {}

    def register(self, name: str, df: DataFrame) -> Dataset:
        made = Dataset(name, df, self.config)
        self._tables[made.id] = made
        return made

    def load(self, path: str) -> Dataset:
        return self.register(path.rstrip("/").rsplit("/", 1)[-1], read_table(self.spark, path, max_mb=self.config.max_mb))

    def load_url(self, url: str, staged: str, filename: str | None = None) -> Dataset:
        """The table of a web address whose bytes are staged at the path ``staged`` in a store
        that all executors read; downloading isn't Spark's work."""
        name = url_filename(url, filename)
        return self.register(name, read_table(self.spark, staged, max_mb=self.config.max_mb))

    def remove(self, dataset_id: str) -> None:
        """Forgets a table and deletes what its results were made from."""
        self.get(dataset_id).close()
        del self._tables[dataset_id]

    def get(self, dataset_id: str) -> Dataset:
        if dataset_id not in self._tables:
            raise NotFound(dataset_id)
        return self._tables[dataset_id]

    def submit_analysis(self, path: str, top_n: int | None = None, expected_columns: list[str] | None = None) -> str:
        """Starts an analysis in the background; its Spark jobs carry the job's id as a tag."""
        job = Job(uuid.uuid4().hex)
        self._jobs[job.job_id] = job

        def run() -> None:
            self.spark.addTag(job.job_id)
            try:
                job.status, job.stage, job.progress = "running", "reading", 5.0
                data = self.load(path)
                job.stage, job.progress = "profiling", 35.0
                data.profile()
                job.stage, job.progress = "analyzing", 64.0
                job.result = data.analyze(top_n, expected_columns)
                job.status, job.stage, job.progress = "completed", "done", 100.0
            except Exception as e:
                job.status, job.error = "failed", str(e)
            finally:
                job.finished = time.time()

        InheritableThread(target=run, daemon=True).start()
        return job.job_id

    def job(self, job_id: str) -> Job:
        if job_id not in self._jobs:
            raise NotFound(job_id)
        return self._jobs[job_id]

    def capabilities(self) -> dict:
        return capabilities(self.config.max_mb)
