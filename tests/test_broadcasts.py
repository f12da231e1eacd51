"""The files of frames are small, their rows aren't: no query may broadcast them, whatever their size on disk says."""

import pytest

import flicker.plans.benchmark as B
from flicker.registry import QUERIES

from .conftest import DATA


class Planned(Exception):
    """Raised where a first intermediate table would be written."""


def children(node):
    return [node.children().apply(i) for i in range(node.children().size())]


def rows_of_frames(node):
    """Whether a plan's rows are those of the written frames, without a sum or a limit on the way."""
    if "flicker-frames" in node.simpleString(1000) and "Scan" in node.nodeName():
        return True
    return node.nodeName() in ("Project", "Filter", "Generate", "ColumnarToRow") and rows_of_frames(children(node)[0])


def broadcast_frames(df):
    """The joins of a plan that broadcast frames."""

    def walk(node):
        own = [node.nodeName()] if "Broadcast" in node.nodeName() and rows_of_frames(node.left() if node.buildSide().toString() == "BuildLeft" else node.right()) else []
        return own + [x for c in children(node) for x in walk(c)]

    return walk(df._jdf.queryExecution().sparkPlan())


def plans(monkeypatch, spark, name, sf="sf0.001", whole=False):
    """The plans of the tables that a query writes after its frames, and its last one. whole: only the first of them."""
    seen, write = [], B.persisted

    def persisted(df, what):
        seen.append(df)
        if whole:
            raise Planned
        return write(df, what)

    monkeypatch.setattr(B, "persisted", persisted)
    try:
        seen.append(QUERIES[name](spark, f"{DATA}/{sf}"))
    except Planned:
        pass
    return seen


def check(monkeypatch, spark, name, *how):
    found = plans(monkeypatch, spark, name, *how)
    assert any("flicker-frames" in df._jdf.queryExecution().sparkPlan().toString() for df in found)
    assert [broadcast_frames(df) for df in found] == [[] for _ in found]


#: Queries without a selection of a whole grid.
ONE_PLAN = [
    "discovery_frequency",
    "cell_vs_run_weight",
    "composite_decision",
    "whole_cell_vs_run_weight",
    "whole_clean_control",
    "whole_composite_decision",
    "whole_equal_weight_rollup",
    "whole_metrics_all",
    "whole_paired_interval",
    "candidate_grid",
    "clean_control",
    "equal_weight_rollup",
    "matched_baseline",
    "measured_seconds",
    "metrics_all",
]
#: These need validation runs, which the smallest size hasn't.
LARGER = [
    "paired_all_methods",
    "summary_table",
    "decision_against_all",
    "decision_of_selected",
]
#: Their selections take long; what follows is planned as with the small grid.
FIRST_PLAN = [
    "whole_matched_baseline",
    "whole_same_t_of_selected",
    "whole_select_baseline",
    "whole_summary_table",
]


@pytest.mark.parametrize("name", ONE_PLAN)
def test_frames_are_not_broadcast(monkeypatch, spark, name):
    check(monkeypatch, spark, name)


@pytest.mark.parametrize("name", LARGER)
def test_frames_are_not_broadcast_in_larger_query(monkeypatch, spark, name):
    check(monkeypatch, spark, name, "sf0.01")


@pytest.mark.parametrize("name", FIRST_PLAN)
def test_frames_are_not_broadcast_in_selection(monkeypatch, spark, name):
    check(monkeypatch, spark, name, "sf0.001", True)
