"""The two end-to-end results: what a comparison tells, and what a snapshot can prove."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import stored
from ..operators import coverage, graph, summaries


def report(changes: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    """Z3: the summary tables of ranked findings, and a flat row for each.

    A6 to A9, A18 to A21, G2, W7, W10, W11, S7. One scan of the findings gives the counts of six
    tables; they are read for links, lists and flat rows besides: give a written table.
    """
    edges = graph.link_findings(findings)
    clusters = stored(graph.build_clusters(edges), "clusters")
    counts = stored(summaries.condensed(findings), "counts")
    return {
        "changes": summaries.change_summary(changes),
        "findings": summaries.finding_summary(counts),
        "owners": summaries.owner_bucket_matrix(counts),
        "figures": summaries.measured_figures(counts),
        "stories": summaries.order_stories(summaries.stories(counts)),
        "screens": summaries.order_screens(summaries.screens(counts)),
        "screen_totals": summaries.screen_totals(counts),
        "screen_items": summaries.order_screen_items(findings, 12),
        "clusters": graph.order_clusters(graph.cluster_summary(findings, clusters)),
        "by_owner": summaries.top_n_per_group(findings, "owner", 8, F.col("bucket") != "housekeeping"),
        "by_bucket": summaries.top_n_per_group(findings, "bucket", 40),
        "flat": summaries.flatten_findings(graph.annotate(findings, clusters)),
    }


def audit(facts: DataFrame, listing: DataFrame, scope: DataFrame, places: DataFrame | None = None) -> dict[str, DataFrame]:
    """What snapshots read of their trees, which references lead nowhere, and which facts lie outside the scope.

    F6, F10, A10 to A16, J7, J14, U5, U6. ``places`` are the facts' paths (else those of ``facts``,
    which then needs the kinds of ``graph.REFERRING`` alone); see ``facts.first_places``.
    """
    read = stored(coverage.coverage_join(listing, scope), "read")
    unresolved = stored(graph.unresolved_references(facts), "unresolved")
    return {
        "coverage": coverage.coverage(read),
        "directories": coverage.missed_by_directory(read),
        "areas": coverage.missed_by_area(read),
        "shared": coverage.multi_surface_files(read),
        "missed": coverage.missed_paths(read, 400),
        "unresolved": unresolved,
        "closure": graph.closure_summary(unresolved),
        "violations": coverage.violations_by_suffix(coverage.scope_violations(facts if places is None else places, scope)),
    }
