"""Rule mining end to end.

``facts`` + ``schema`` -> clusters -> candidates -> scores -> thresholds ->
de-duplication -> rules. Candidates and their classification are schema-level
tables. Data-level work (fact sets, degrees, pairs, value sets) happens once per scoring
plan; what it persists is released as soon as the values of the rules are computed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import MIN_CONF, MIN_HEAD_COVERAGE
from ..functions.ids import NameIds, counted_by_ids
from ..functions.sizing import broadcast_if_small, materialize_small
from ..operators.candidates import CANDIDATE_COLUMNS, classify, ordered_subsets
from ..operators.clusters import KINDS, MIN_CLUSTER_SIZE, all_clusters
from ..operators.facts import (
    CHECK, bit_names, counted_facts, largest_objects, property_sizes, sizes_from_counts, sizes_from_sets, typed_counts, typed_facts, typed_sets)
from ..operators.measure_binding import score_binding
from ..operators.measure_join import score_join
from ..operators.rules import to_rules

MEASURES = ("join", "binding")


def candidate_rules(facts: DataFrame, schema: DataFrame, atoms: int = 3,
                    clusters: DataFrame | None = None, method: str = "exact",
                    min_cluster_size: int = MIN_CLUSTER_SIZE, sizes: DataFrame | None = None,
                    **hash_params) -> DataFrame:
    """Distinct candidates ``(head, body1, body2)`` from clusters.

    Three-atom rules come from clusters of every kind, two-atom rules from
    domain+range clusters only.
    """
    if clusters is None:
        kinds = KINDS if atoms == 3 else ("domain_range",)
        sizes = sizes if sizes is not None else property_sizes(facts)
        with_facts = sizes.select("property")
        clusters = all_clusters(schema, with_facts, method, kinds, min_cluster_size, **hash_params)
    return ordered_subsets(clusters, atoms)


@dataclass
class Counted:
    """What one pass over the facts gives a measure: ``ids``, distinct typed facts by ids ``counts`` (``typed_sets`` or ``typed_counts``
    for the join measure, persisted as ``kept``), their bag sizes by id, and by name as ``named``."""

    ids: NameIds
    counts: DataFrame
    kept: DataFrame
    sizes: DataFrame
    named: DataFrame


def typed_sets_or_counts(own: DataFrame, typed: DataFrame) -> DataFrame:
    """What the join measure keeps of the facts: their property sets as one number, or a row for each property when these are too many for that."""
    names = bit_names(typed)
    return typed_counts(own, typed, True) if names is None else typed_sets(own, typed, names)


def count_once(facts: DataFrame, schema: DataFrame, measure: str = "join", one_object_per_subject: bool = False) -> Counted:
    """``Counted`` of ``facts``, which are read once (again only when names share an id)."""
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; expected one of {MEASURES}")
    if measure == "join" and one_object_per_subject:
        raise ValueError("one_object_per_subject is a view of the binding measure only")
    ends = ("v_lo", "v_hi") if measure == "join" else ("subject", "object")
    if one_object_per_subject:  # the largest object by name, so before names become ids; sizes stay those of all facts
        ids, counts, kept = counted_by_ids(largest_objects(facts), schema, lambda own, typed: typed_facts(own, typed, CHECK, "n"), ends)
    else:
        make = typed_sets_or_counts if measure == "join" else lambda own, typed: counted_facts(own, typed, True)
        ids, counts, kept = counted_by_ids(facts, schema, make, ends)
    sizes = materialize_small(sizes_from_sets(counts) if "mask" in counts.columns else sizes_from_counts(counts))
    names = ids.encode(schema.select("property", F.col("property").alias("name")), ["property"])
    named = materialize_small(names.join(sizes, "property").select(F.col("name").alias("property"), "n"))
    return Counted(ids, counts, kept, sizes, named)


def score(facts: DataFrame, schema: DataFrame, candidates: DataFrame, measure: str = "join",
          one_object_per_subject: bool = False) -> DataFrame:
    """Scores of every candidate, before thresholds."""
    return score_classified(facts, schema, classify(candidates, schema), measure, one_object_per_subject)


def score_candidates(facts: DataFrame, schema: DataFrame, atoms: int, measure: str = "join",
                     one_object_per_subject: bool = False) -> DataFrame:
    """Scores of the cluster candidates, before thresholds; clusters and measure share one pass over the facts."""
    return score_made(facts, schema, lambda sizes: classify(candidate_rules(facts, schema, atoms, sizes=sizes), schema),
                      measure, one_object_per_subject)


def score_made(facts: DataFrame, schema: DataFrame, make: Callable[[DataFrame], DataFrame], measure: str = "join",
               one_object_per_subject: bool = False) -> DataFrame:
    """Scores of the ``classify`` rows that ``make`` gives for the bag sizes ``(property, n)`` of the typed properties with facts."""
    c = count_once(facts, schema, measure, one_object_per_subject)
    return score_counted(c, schema, make(c.named), measure)


def score_classified(facts: DataFrame, schema: DataFrame, classified: DataFrame, measure: str = "join",
                     one_object_per_subject: bool = False) -> DataFrame:
    """Scores of ``classify``'s rows."""
    return score_made(facts, schema, lambda _: classified, measure, one_object_per_subject)


def score_counted(c: Counted, schema: DataFrame, classified: DataFrame, measure: str,
                  sizes: DataFrame | None = None, thresholds: tuple[float, float] | None = None) -> DataFrame:
    """Scores of ``classify``'s rows on counted facts, which are released. The measures work on ids; the names come back on the scored rules.

    ``sizes`` (by id) may be passed in when the caller has others. With ``thresholds`` the join measure
    leaves out rules that cannot reach them before it evaluates these.
    """
    rules, typed = c.ids.rules(classified), c.ids.schema(schema)
    sizes = sizes if sizes is not None else c.sizes
    scored = (score_join(c.counts, typed, rules, sizes, c.counts, thresholds) if measure == "join"
              else score_binding(c.counts, typed, rules, sizes=sizes, counts=c.counts))
    c.kept.unpersist()
    return c.ids.restore(scored, broadcast_if_small(schema.select("property")), CANDIDATE_COLUMNS)


def mine(facts: DataFrame, schema: DataFrame, atoms: int = 3, measure: str = "join",
         clusters: DataFrame | None = None, candidates: DataFrame | None = None,
         method: str = "exact", min_conf: float = MIN_CONF,
         min_hc: float = MIN_HEAD_COVERAGE, one_object_per_subject: bool = False,
         min_cluster_size: int = MIN_CLUSTER_SIZE, drop_duplicates: bool = True,
         sizes: DataFrame | None = None, prune: bool = True, **hash_params) -> DataFrame:
    """Mine ``atoms``-atom Horn rules scored with ``measure`` ("join" or "binding").

    Returns ``(head, body1, body2, conf, fitness, rule)``; ``body2`` is null for
    two-atom rules. Empty inputs give an empty, typed frame. ``sizes`` are the bag sizes ``(property, n)`` when the caller has
    them (a store's manifest has); else they are counted. ``prune`` lets the join measure bound supports by degrees first and
    evaluate only rules that may pass; the result is the same.
    """
    if atoms not in (2, 3):
        raise ValueError("rules have 2 or 3 atoms")
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; expected one of {MEASURES}")
    # one pass over the facts serves ids, bag sizes, clusters and every measure
    c = count_once(facts, schema, measure, one_object_per_subject)
    known = (materialize_small(c.ids.encode(sizes.join(schema, "property", "leftsemi").select("property", "n"), ["property"]))
             if sizes is not None else None)
    if candidates is None:
        named = sizes.join(schema, "property", "leftsemi").select("property", "n") if sizes is not None else c.named
        candidates = candidate_rules(facts, schema, atoms, clusters, method, min_cluster_size, named, **hash_params)
    else:
        candidates = candidates.select("head", "body1", F.col("body2").cast("string"))
    scored = score_counted(c, schema, classify(candidates, schema), measure, known, (min_conf, min_hc) if prune else None)
    return to_rules(scored, schema, min_conf, min_hc, drop_duplicates)
