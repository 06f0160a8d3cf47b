"""Texts for people: summaries of attempts, reports and sweeps."""

from __future__ import annotations

import json
from typing import Any


def attempt_summary(stats: dict[str, Any], sources: dict[str, int], top: list[tuple[str, int]]) -> str:
    lines = [f"{stats['record_count']} attempts ({stats['weighted_count']} weighted), {stats['unique_tasks']} tasks"]
    lines += [f"  {k}: {n}" for k, n in sorted(sources.items())]
    lines += [f"  {name} length p50 {stats[f'{name}_length_p50']}, p90 {stats[f'{name}_length_p90']}" for name in ("decoder_input", "raw_output")]
    return "\n".join([*lines, "  top tasks: " + ", ".join(f"{t} ({n})" for t, n in top)])


def proof_summary(report: dict[str, Any]) -> str:
    t, o = report["throughput"], report["outcomes"]
    lines = [f"run {report['run_id']}: {report['terminal_count']} of {report['expected_jobs']} jobs" + ("" if report["complete"] else " (not complete)")]
    lines.append(f"  {report['wall_seconds']:.1f} s, {t['overall_samples_per_second']:.2f} samples/s" + "".join(f", {k} {v:.2f}/s" for k, v in sorted(t["by_stage"].items())))
    lines.append(f"  parsed {o['parse_success_count']}, tested {o['tests_ran_count']}, passed {o['all_tests_passed_count']}, without a test {o['missing_test_count']}")
    return "\n".join(lines + [f"  {k}: {n}" for k, n in sorted(o["outcome_kind_counts"].items())])


def sweep_table(report: dict[str, Any]) -> str:
    rows = [f"{'workers':>8} {'swapped':>8} {'samples/s':>10} {'gained':>8} {'reliable':>9}"]
    for x in report["steps"]:
        rows.append(f"{x['workers']:>8} {'yes' if x['swapped'] else 'no':>8} {x['samples_per_second']:>10.2f} {x['terminals_after'] - x['terminals_before']:>8} {'yes' if x['reliable'] else 'no':>9}")
    return "\n".join([*rows, f"best: {report['best_workers']} workers, {report['best_samples_per_second']:.2f} samples/s ({report['stop_reason']})"])


def run_text(document: dict[str, Any]) -> str:
    """A run's metadata."""
    seed = document.get("seed") or {}
    lines = [f"run {document['run_id']}", *(f"  {k}: {v}" for k, v in sorted(document.get("init", {}).items()))]
    return "\n".join(lines + ([f"  seeded from {seed['source']}: {seed['expected_jobs']} jobs, ids {seed['sample_ids_hash'][:12]}"] if seed else ["  not seeded"]))


def test_line(outcome: dict[str, Any]) -> str:
    """One line for a test outcome."""
    rate = outcome.get("test_pass_rate")
    return f"{outcome['sample_id']}: {outcome['outcome_kind']}" + (f", {rate:.2f} passed" if rate is not None else "")


test_line.__test__ = False


def pretty(document: Any) -> str:
    """JSON with sorted keys and two spaces of indentation."""
    return json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False, default=str)


def _clipped(text: str | None, size: int) -> str:
    text = text or ""
    return text if len(text) <= size else text[: size - 3] + "..."


def spot_check_text(task_id: str, sides: dict[str, dict[str, Any]], size: int = 400) -> str:
    """Two attempts of a task under each other: sides by their source, rows of flat attempts."""
    lines = [f"task {task_id}: one attempt per source; their inputs differ by design"]
    for source, row in sides.items():
        lines += ["", f"{source}: sample {row['sample_id']}, run {row.get('run_id') or '-'}, model {row.get('provenance_model') or '-'}"]
        if source == "pool":
            lines.append(f"  seen {row.get('provenance_occurrence_count')} times, pool attempt {row.get('provenance_pool_attempt_id') or '-'}")
        if row.get("provenance_dec_llm_config_id"):
            lines.append(f"  profile {row['provenance_dec_llm_config_id']}")
        for name in ("decoder_input", "raw_output"):
            lines += [f"  {name}:", *(f"    {x}" for x in _clipped(row[name], size).splitlines())]
    return "\n".join(lines)


def worker_table(workers: list[dict[str, Any]]) -> str:
    if not workers:
        return "no workers"
    return "\n".join(f"{w['worker_id']}: {'+'.join(w['stages'])}, {w['concurrency']} tasks, {w['status']}" for w in workers)
