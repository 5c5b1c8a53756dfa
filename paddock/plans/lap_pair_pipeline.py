"""All stages of the lap-pair analysis over a table of pairs."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame

from paddock.functions.storage import stored
from paddock.operators import matching, rules, traces, zones


class LapPairAnalysis:
    """Align, detect, match, compare, diagnose, advise and report every pair at once.

    A stage runs when it is first asked for. Those that several others read are written to the
    shared folder, so that each is planned and computed once.
    """

    def __init__(self, pairs: DataFrame, trace: DataFrame, points: int = 201):
        self.points = points
        self._pairs, self._trace = pairs, trace

    @cached_property
    def trace(self) -> DataFrame:
        return stored(self._trace, "trace")

    @cached_property
    def pairs(self) -> DataFrame:
        return stored(self._pairs, "pairs")

    @cached_property
    def aligned(self) -> DataFrame:
        return stored(traces.align(self.pairs, self.trace, self.points), "aligned")

    @cached_property
    def zones(self) -> DataFrame:
        return stored(zones.braking_zones(self.trace), "zones")

    @cached_property
    def entries(self) -> DataFrame:
        return stored(zones.corner_entries(self.trace, self.zones), "entries")

    @cached_property
    def exits(self) -> DataFrame:
        return stored(zones.corner_exits(self.trace, self.entries), "exits")

    @cached_property
    def corners(self) -> DataFrame:
        return stored(zones.corners(self.zones, self.entries, self.exits), "corners")

    def _times(self, parts: list[tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
        return stored(traces.time_deltas(matching.places(self.pairs, parts), self.pairs, self.trace, self.points), "times")

    @cached_property
    def times(self) -> DataFrame:
        """Time deltas at the places of all kinds of parts, for stages that need every kind: the trace is sorted for them once."""
        return self._times([(self.zones, matching.ZONE_PLACES), (self.entries, matching.ENTRY_PLACES), (self.exits, matching.EXIT_PLACES)])

    def _deltas(self, name: str, compute: Callable, parts: DataFrame, fields: tuple[str, ...]) -> DataFrame:
        """Deltas of one kind of parts. Stages of that kind alone need only its places."""
        times = self.times if "times" in self.__dict__ else self._times([(parts, fields)])
        return stored(compute(self.pairs, parts, times), name)

    @cached_property
    def zone_deltas(self) -> DataFrame:
        return self._deltas("zone-deltas", matching.zone_deltas, self.zones, matching.ZONE_PLACES)

    @cached_property
    def entry_deltas(self) -> DataFrame:
        return self._deltas("entry-deltas", matching.entry_deltas, self.entries, matching.ENTRY_PLACES)

    @cached_property
    def exit_deltas(self) -> DataFrame:
        return self._deltas("exit-deltas", matching.exit_deltas, self.exits, matching.EXIT_PLACES)

    @cached_property
    def corner_deltas(self) -> DataFrame:
        return self._deltas("corner-deltas", matching.corner_deltas, self.corners, matching.CORNER_PLACES)

    @cached_property
    def issues(self) -> DataFrame:
        _ = self.times  # before the deltas, which then read those of all kinds
        return rules.all_issues(self.zone_deltas, self.entry_deltas, self.exit_deltas)

    @cached_property
    def corner_issues(self) -> DataFrame:
        issues = self.issues  # before the corners' deltas, for the same reason
        return stored(rules.corner_issues(self.corner_deltas, issues), "corner-issues")

    @cached_property
    def advice(self) -> DataFrame:
        return rules.advice(self.corner_issues)

    @cached_property
    def plan(self) -> DataFrame:
        return rules.coaching_plan(self.advice)

    @cached_property
    def report(self) -> DataFrame:
        issues = self.issues
        return rules.report(self.pairs, self.corner_deltas, issues, self.advice, self.plan)
