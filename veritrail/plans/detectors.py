"""Detectors of an audit: a registry without repeated ids, selection, and runs in which a detector's failure is a row."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.stored import stored
from veritrail.operators import audit, rot

ISSUE = "id string, detector_id string, severity string, confidence string, file string, line int, message string"


@dataclass(frozen=True)
class Detector:
    """run gives issues from a context of tables; skip gives a reason not to run, or None."""

    id: str
    audit_type: str
    areas: tuple[str, ...]
    run: Callable[[dict], DataFrame]
    skip: Callable[[dict], str | None] | None = None


@dataclass(frozen=True)
class AuditRun:
    """issues (detector_ord and the columns of ISSUE), errors (detector_id, message, category), skipped (detector_id, reason), all with the detector's place."""

    issues: DataFrame
    errors: DataFrame
    skipped: DataFrame
    counts: DataFrame
    exit: DataFrame


def registry(detectors: Iterable[Detector]) -> tuple[Detector, ...]:
    """The detectors in order; an id that is there already is refused."""
    found: dict[str, Detector] = {}
    for d in detectors:
        if d.id in found:
            raise ValueError(f'Duplicate audit detector id: "{d.id}".')
        found[d.id] = d
    return tuple(found.values())


def select(detectors: Iterable[Detector], types: Iterable[str], areas: Iterable[str]) -> tuple[Detector, ...]:
    """Those of a type in ``types`` with an area in ``areas``, in registry order."""
    types, areas = set(types), set(areas)
    return tuple(d for d in detectors if d.audit_type in types and areas & set(d.areas))


def run(spark: SparkSession, detectors: Iterable[Detector], context: dict, fail_on: str = "none") -> AuditRun:
    """Runs detectors one by one, each by an action of its own into the shared folder.

    A detector that fails, while it is planned or in a task, gives an error row
    and no issue; the others go on. Issues keep the registry's order, and the
    first of each id counts.
    """
    found, errors, skipped = [], [], []
    for place, d in enumerate(detectors):
        try:
            reason = d.skip(context) if d.skip else None
            if reason is not None:
                skipped.append((place, d.id, reason))
                continue
            columns = [c.split()[0] for c in ISSUE.split(", ")]
            found.append(stored(d.run(context).select(F.lit(place).alias("detector_ord"), *columns)))
        except Exception as e:  # noqa: BLE001 - whatever a detector raises is its result
            errors.append((place, d.id, str(e).strip().split("\n")[0]))
    issues = spark.createDataFrame([], f"detector_ord int, {ISSUE}")
    for df in found:
        issues = issues.unionByName(df)
    issues = issues.groupBy("id").agg(F.min_by(F.struct(*issues.columns), F.struct("detector_ord", "file", "line", "message")).alias("i")).select("i.*")
    failed = spark.createDataFrame(errors, "detector_ord int, detector_id string, message string").withColumn("category", audit.error_category(F.col("message")))
    left = spark.createDataFrame(skipped, "detector_ord int, detector_id string, reason string")
    return AuditRun(issues, failed, left, audit.severity_counts(issues), audit.exit_decision(issues, fail_on, len(errors)))


def _any(*frames: DataFrame) -> DataFrame:
    whole = frames[0]
    for df in frames[1:]:
        whole = whole.unionByName(df)
    return whole


def _needs(*tables: str) -> Callable[[dict], str | None]:
    return lambda context: next((f"no {t} given" for t in tables if t not in context), None)


#: Contexts hold tables: docs, sources, tests and files (path, content), scripts (name, command), and what a check asks besides.
DETECTORS = registry(
    [
        Detector("stale-command-reference", "code-rot", ("docs", "package"), lambda c: rot.stale_commands(c["docs"], c["scripts"]), _needs("docs", "scripts")),
        Detector("docs-code-mismatch", "code-rot", ("docs",), lambda c: rot.feature_claims(c["docs"], c["features"]), _needs("docs", "features")),
        Detector("package-release-rot", "code-rot", ("package",), lambda c: rot.version_mismatch(c["package"], c["lock"]), _needs("package", "lock")),
        Detector("duplicate-implementation", "code-rot", ("cli", "package"), lambda c: rot.duplicate_basenames(c["sources"]), _needs("sources")),
        Detector("dead-code-candidate", "code-rot", ("cli",), lambda c: rot.unreferenced_files(c["sources"], c["files"], c.get("entry_points", [])), _needs("sources", "files")),
        Detector("test-rot", "code-rot", ("tests",), lambda c: _any(rot.focused_tests(c["tests"]), rot.stale_test_commands(c["tests"], c["scripts"])), _needs("tests", "scripts")),
        Detector("architecture-drift", "code-rot", ("docs", "cli"), lambda c: rot.stale_paths(c["docs"], c["files"]), _needs("docs", "files")),
        Detector("dependency-environment-rot", "code-rot", ("docs", "package"), lambda c: rot.package_manager_mismatch(c["docs"]), _needs("docs")),
        Detector("cross-platform-rot", "code-rot", ("cli", "package"), lambda c: _any(rot.posix_scripts(c["scripts"], c["docs"]), rot.cross_platform_sources(c["sources"])), _needs("scripts", "docs", "sources")),
        Detector("security-validation-assumption-rot", "code-rot", ("docs", "cli", "package"), lambda c: rot.security_claims(c["docs"], c.get("version"), c.get("scenarios_exist", False), c.get("android_exists", False)), _needs("docs")),
    ]
)
