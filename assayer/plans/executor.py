"""Runs a bound table: a few aggregations, each of which returns one row.

A  one aggregation without a shuffle beyond one row a task: row count, non-null
   values, nulls, cast errors, row-local rules, relations, moments.
B  one more for rules on the distance from the mean, with A's moments.
C  one grouped count for each unique column.
D  one plan for all monotone columns, which compares neighbours where they were read.

A, C and D don't depend on each other and run as concurrent jobs.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import spec
from assayer.errors import RuleTypeError
from assayer.operators.moments import measured, moments, statistical_violation
from assayer.operators.order import count_breaks
from assayer.operators.relations import relation_title, relation_violation
from assayer.operators.rows import count_violations
from assayer.operators.unique import count_repeats
from assayer.plans.compiler import BoundTable
from assayer.results import CAST_FAILURE, RuleResult, ValidationResult
from assayer.sources.frame import with_order

#: Aggregates in one pass; a table with more is scanned again for the rest.
WIDTH = 400


def _row(df: DataFrame, aggregates: list[Column]) -> dict:
    out: dict = {}
    for at in range(0, len(aggregates), WIDTH):
        out |= df.agg(*aggregates[at : at + WIDTH]).first().asDict()
    return out


def pass_a(table: BoundTable, compat: bool) -> list[Column]:
    """The aggregates of the row-local pass."""
    out = [F.count(F.lit(1)).alias("rows")]
    for i, column in enumerate(table.columns.values()):
        out += [F.count(column.raw).alias(f"valid_{i}")]
        if column.mismatched:
            continue
        if column.checked and column.spec.kind != spec.STRING:
            out.append(F.count_if(column.raw.isNotNull() & column.value.isNull()).alias(f"cast_{i}"))
        out += [count_violations(rule, column.value, column.spec.kind).alias(f"rule_{i}_{j}") for j, rule in enumerate(column.spec.rules) if rule.stage == spec.ROW]
        if column.spec.of(spec.STATISTICAL):
            mean, deviation = moments(measured(column.value, column.spec.kind, compat))
            out += [mean.alias(f"mean_{i}"), deviation.alias(f"deviation_{i}")]
    for i, relation in enumerate(table.relations):
        left, right = (table.columns[n] for n in (relation.left, relation.right))
        out += [F.count_if(relation_violation(rule, left.value, right.value, left.spec.kind == spec.FLOAT)).alias(f"relation_{i}_{j}") for j, rule in enumerate(relation.rules)]
    return out


def pass_b(table: BoundTable, found: dict) -> list[Column]:
    """Aggregates of the rules that need moments."""
    out = []
    for i, column in enumerate(table.columns.values()):
        if not column.mismatched:
            out += [F.count_if(statistical_violation(rule, column.value, found[f"mean_{i}"], found[f"deviation_{i}"])).alias(f"rule_{i}_{j}") for j, rule in enumerate(column.spec.rules) if rule.stage == spec.STATISTICAL]
    return out


def pass_c(table: BoundTable) -> dict[int, DataFrame]:
    """By column, the plan that counts its repeats."""
    return {i: count_repeats(table.source.frame, column.value, column.spec.kind == spec.STRING) for i, column in enumerate(table.columns.values()) if not column.mismatched and column.spec.of(spec.UNIQUE)}


def pass_d(table: BoundTable, order_by: list[str] | None) -> tuple[DataFrame, list[tuple[int, int]]] | None:
    """The plan for all monotone columns, and which rule each of its counts is for."""
    checks = [(i, j, rule.kind, column.value) for i, column in enumerate(table.columns.values()) if not column.mismatched for j, rule in enumerate(column.spec.rules) if rule.stage == spec.ORDER]
    if not checks:
        return None
    source = table.source
    if order_by:
        ranged = with_order(source.frame, order_by, [value for *_, value in checks])
        plan = count_breaks(ranged.placed, [(kind, F.col(f"value_{k}")) for k, (_, _, kind, _) in enumerate(checks)], ranged.block)
    elif source.ordered:
        plan = count_breaks(source.placed, [(kind, value) for _, _, kind, value in checks], source.block)
    else:
        raise RuleTypeError(f"{table.spec.name}: rows of a DataFrame have no order; give order_by for is_increasing and is_decreasing")
    return plan, [(i, j) for i, j, _, _ in checks]


def _named(rules: tuple[spec.RuleSpec, ...], compat: bool) -> list[tuple[str, list[int]]]:
    """Reported names with the rules behind each: a repeated name gets a number, or is merged in compat."""
    out: dict[str, list[int]] = {}
    last = {r.kind: j for j, r in enumerate(rules) if r.stage in (spec.UNIQUE, spec.NULLS)}
    for j, rule in enumerate(rules):
        if rule.kind in last and last[rule.kind] != j:
            continue  # of repeated null or uniqueness rules the last holds
        name, n = rule.name, 2
        while name in out and not compat:
            name, n = f"{rule.name}#{n}", n + 1
        out.setdefault(name, []).append(j)
    return [*out.items()]


def execute(table: BoundTable, order_by: list[str] | None = None, compat: bool = False) -> ValidationResult:
    frame = table.source.frame
    repeats, breaks = pass_c(table), pass_d(table, order_by)
    with ThreadPoolExecutor(max_workers=4) as pool:
        first = pool.submit(_row, frame, pass_a(table, compat))
        unique = {i: pool.submit(lambda plan=plan: plan.first()["errors"]) for i, plan in repeats.items()}
        ordered = pool.submit(lambda: breaks[0].first().asDict()) if breaks else None
        found = first.result()
        late = pass_b(table, found)
        found |= _row(frame, late) if late else {}
        counts = {i: f.result() for i, f in unique.items()}
        for k, (i, j) in enumerate(breaks[1] if breaks else ()):
            found[f"rule_{i}_{j}"] = ordered.result()[f"errors_{k}"]
    return _results(table, found, counts, compat)


def _results(table: BoundTable, found: dict, repeats: dict[int, int], compat: bool) -> ValidationResult:
    rows = found["rows"]
    out = ValidationResult(table.spec.name, rows, warnings=table.warnings)
    failed: set[str] = set()
    for i, (name, column) in enumerate(table.columns.items()):
        valid, rules = found[f"valid_{i}"], column.spec.rules
        out.valid_values[name] = valid
        results = []
        bad = found.get(f"cast_{i}", 0)
        dead = bad == valid and valid > 0  # nothing was cast: other rules would only repeat that
        if dead:
            failed.add(name)
        for title, members in _named(rules, compat):
            stages = {rules[j].stage for j in members}
            threshold = rules[members[-1] if stages & {spec.UNIQUE, spec.NULLS} else members[0]].threshold
            if stages == {spec.NULLS}:
                errors = rows - valid
            elif column.mismatched or dead:
                continue
            elif stages == {spec.UNIQUE}:
                errors = repeats[i]
            else:
                errors = sum(found[f"rule_{i}_{j}"] for j in members)
            results.append(RuleResult(title, errors, threshold, rows))
        if column.mismatched:
            results.insert(0, RuleResult("DowncastFailure", rows, 0.0, rows))
        if column.checked:
            results.insert(0, RuleResult("TypeCheck", bad, column.spec.type_threshold, rows, CAST_FAILURE if dead else None))
        if compat:
            for r in results:
                if r.error_count == valid:
                    r.set_error_message(CAST_FAILURE)
        out.columns[name] = results
    for i, relation in enumerate(table.relations):
        if not failed & {relation.left, relation.right}:
            out.relations.setdefault(relation.name, []).extend(RuleResult(relation_title(rule), found[f"relation_{i}_{j}"], rule.threshold, rows) for j, rule in enumerate(relation.rules))
    return out
