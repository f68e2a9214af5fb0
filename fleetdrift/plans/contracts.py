"""Contract scan: calls against the best description of each host, and against what changed since."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import contracts
from ..session import cut_lineage
from ..sources import apispecs


@dataclass
class ContractReport:
    checked: DataFrame
    summary: DataFrame
    gone: DataFrame
    hits: DataFrame | None
    notes: DataFrame


def check(calls: DataFrame, candidates: DataFrame, now: Column, previous: DataFrame | None = None) -> ContractReport:
    """Calls, operations and the verdicts on the calls are written once: the first two are read out of text.

    ``calls``: all calls, resolved or not. ``candidates``: vendor (the host), seq, url, provenance, updated_at, body.

    Only a description its provider controls, and that is current, supports a claim; every other host gets a note.
    ``previous``: vendor, body of the earlier version.
    """
    calls = cut_lineage(calls, "calls")
    best = cut_lineage(contracts.best_descriptions(candidates), "descriptions")
    sure = urls.can_assert_breakage(F.col("provenance"), F.col("updated_at"), now)
    readable = apispecs.is_spec(F.col("body"))
    usable = best.filter(F.coalesce(sure & readable, F.lit(False))).select(F.col("vendor").alias("host"), "body")
    read = apispecs.read_operations(usable, ["host"])
    operations = cut_lineage(apispecs.operations(read, ["host"]), "operations")
    bases = apispecs.read_bases(usable, ["host"])
    described = cut_lineage(contracts.described_endpoints(operations, bases, ["host"]), "endpoints")
    resolved = calls.filter("resolved")
    checked = cut_lineage(contracts.check_calls(resolved, described), "checked-calls")
    summary = contracts.contract_summary(checked, calls)
    gone = contracts.gone_findings(checked)
    hits = None
    if previous is not None:
        hits = since(resolved, gone, usable, previous)
    hosts = resolved.select("repo", "host").distinct().join(best.withColumnRenamed("vendor", "host"), "host", "left")
    note = (
        F.when(F.col("provenance").isNull(), "no API description could be located, so its calls were not checked")
        .when(F.col("body").isNull(), "the description was located but not fetched")
        .when(
            ~sure,
            F.concat(
                F.lit("not authoritative, so nothing is claimed from it — "),
                urls.describe_provenance(F.col("url"), F.col("provenance"), F.col("updated_at"), now),
            ),
        )
        .when(~readable, "the description could not be read as OpenAPI or Swagger")
    )
    notes = hosts.select("repo", "host", note.alias("note")).filter("note IS NOT NULL")
    return ContractReport(checked, summary, gone, hits, notes)


def since(resolved: DataFrame, gone: DataFrame, usable: DataFrame, previous: DataFrame) -> DataFrame:
    """Changes between two versions of a description that touch a call, less what is already reported as gone."""
    old = previous.select(F.col("vendor").alias("host"), F.col("body").alias("old_body"))
    both = usable.join(old, "host").select(
        F.col("host").alias("vendor"),
        "body",
        "old_body",
        apispecs.is_spec(F.col("old_body")).alias("before_ok"),
        F.lit(True).alias("after_ok"),
    )
    new_read = cut_lineage(apispecs.read_operations(both.select("vendor", "body"), ["vendor"]), "new-operations")
    old_read = cut_lineage(apispecs.read_operations(both.select("vendor", F.col("old_body").alias("body")), ["vendor"]), "old-operations")
    keys = ["vendor"]
    changes = contracts.diff_specs(
        apispecs.operations(old_read, keys),
        apispecs.operations(new_read, keys),
        apispecs.operation_params(old_read, keys),
        apispecs.operation_params(new_read, keys),
        both.select("vendor", "before_ok", "after_ok"),
    ).withColumnRenamed("vendor", "host")
    old_ops = apispecs.operations(old_read, keys).withColumnRenamed("vendor", "host")
    old_bases = apispecs.read_bases(both.select("vendor", F.col("old_body").alias("body")), keys).withColumnRenamed("vendor", "host")
    spans = contracts.spanning_routes(old_ops, ["host"])
    endpoints = spans.join(old_bases, "host").select("host", "route", F.concat("base", "route").alias("full"), "spans")
    return contracts.not_reported(contracts.match_changes(resolved, changes, endpoints), gone)
