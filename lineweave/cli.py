"""python -m lineweave.cli COMMAND ...: clean, validate, config, and one command for each step."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from .plans import clean as plans
from .plans.config import DEDUP, MERGE, CleanConfig, load_config, save_config


def _precision(text: str) -> float | str:
    return text if text == "auto" else float(text)


#: option, parameter, and how argparse reads it
_OPTIONS: dict[str, tuple[str, dict[str, Any]]] = {
    "--metric-crs": ("metric_crs", {}),
    "--snap-precision": ("snap_precision", {"type": _precision}),
    "--overlap-tolerance": ("overlap_tolerance", {"type": float}),
    "--simplify-tolerance": ("simplify_tolerance", {"type": float}),
    "--prune-epsilon": ("prune_epsilon", {"type": float}),
    "--dedup-policy": ("dedup_policy", {"choices": DEDUP}),
    "--keep-parallel": ("keep_parallel_edges", {"action": argparse.BooleanOptionalAction}),
    "--check-paths": ("check_geometry_paths", {"action": argparse.BooleanOptionalAction}),
    "--preserve-field": ("preserve_fields", {"action": "append"}),
    "--merge-degree2": ("merge_degree2_nodes", {"action": argparse.BooleanOptionalAction}),
    "--merge-policy": ("merge_attribute_policy", {"choices": MERGE}),
    "--merge-mode": ("merge_mode", {"choices": ("single_pass", "fixpoint")}),
    "--max-length-ratio": ("merge_max_length_ratio", {"type": float}),
    "--remove-small-components": ("remove_small_components", {"action": argparse.BooleanOptionalAction}),
    "--min-component-features": ("min_component_features", {"type": int}),
    "--min-component-length": ("min_component_length", {"type": float}),
    "--min-features": ("min_component_features", {"type": int}),
    "--min-length": ("min_component_length", {"type": float}),
    "--near-miss": ("near_miss", {"choices": ("ignore", "cut")}),
    "--pairing-batch-size": ("pairing_batch_size", {"type": int}),
    "--pairing-bearing-delta": ("pairing_bearing_delta_deg", {"type": float}),
    "--pairing-length-ratio-min": ("pairing_length_ratio_min", {"type": float}),
    "--pairing-length-ratio-max": ("pairing_length_ratio_max", {"type": float}),
    "--pairing-overlap-alpha": ("pairing_overlap_alpha", {"type": float}),
    "--strict": ("strict_validation", {"action": argparse.BooleanOptionalAction}),
    "--progress": ("progress_bar", {"action": argparse.BooleanOptionalAction}),
}
_ALWAYS = ("--metric-crs", "--strict", "--progress")
#: command: what it runs, its options, and its own defaults
_STEPS: dict[str, tuple[Callable, tuple[str, ...], dict[str, Any]]] = {
    "clean": (plans.clean_file, tuple(k for k in _OPTIONS if k not in ("--min-features", "--min-length")), {}),
    "explode": (plans.run_explode, _ALWAYS, {}),
    "snap": (plans.run_snap, (*_ALWAYS, "--snap-precision"), {}),
    "split": (plans.run_split, (*_ALWAYS, "--snap-precision", "--overlap-tolerance", "--near-miss"), {}),
    "deoverlap": (plans.run_deoverlap, (*_ALWAYS, "--overlap-tolerance", "--dedup-policy", "--keep-parallel", "--check-paths", "--snap-precision"), {}),
    "merge-degree2": (plans.run_merge_degree2, (*_ALWAYS, "--merge-policy", "--max-length-ratio", "--merge-mode"), {}),
    "simplify": (plans.run_simplify, (*_ALWAYS, "--simplify-tolerance", "--prune-epsilon"), {}),
    "remove-components": (plans.run_remove_components, (*_ALWAYS, "--min-features", "--min-length"), {"min_component_features": 2, "min_component_length": 10.0}),
}


def table(rows: dict[str, Any]) -> str:
    """Two columns of plain text."""
    wide = max(map(len, rows), default=0)
    return "\n".join(f"{k.replace('_', ' '):<{wide}}  {f'{v:.3f}' if isinstance(v, float) else v}" for k, v in rows.items())


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lineweave")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, options, _) in _STEPS.items():
        c = commands.add_parser(name)
        c.add_argument("input")
        c.add_argument("output")
        c.add_argument("--config", dest="config_file", help="a file of parameters; options given here come before it")
        c.add_argument("--report", dest="report_file", help="write the report to this JSON file")
        c.add_argument("-v", "--verbose", action="count", default=0)
        for o in options:
            dest, how = _OPTIONS[o]
            c.add_argument(o, dest=dest, default=argparse.SUPPRESS, **how)
    v = commands.add_parser("validate")
    v.add_argument("input")
    v.add_argument("--config", dest="config_file")
    v.add_argument("-v", "--verbose", action="count", default=0)
    f = commands.add_parser("config")
    f.add_argument("output")
    f.add_argument("--format", default="yaml", choices=("yaml", "json"))
    return parser


def run(argv: list[str] | None = None) -> dict[str, Any] | None:
    """Do what the arguments say; a step's report."""
    o = vars(_parser().parse_args(argv))
    command = o.pop("command")
    if command == "config":
        save_config(CleanConfig(), o["output"], o["format"])
        return None
    given = load_config(o.pop("config_file")) if o.get("config_file") else None
    if command == "validate":
        issues, stats = plans.check_file(o["input"], given)
        print("\n".join(f"{i}. {x}" for i, x in enumerate(issues, 1)) or "no issues found")
        if o["verbose"]:
            print(table(stats))
        return {"issues": issues, **stats}
    step, _, own = _STEPS[command]
    known = {k: v for k, v in o.items() if k in {f.name for f in dataclasses.fields(CleanConfig)} and k != "verbose"}
    config = dataclasses.replace(given or CleanConfig(**own), **known)
    report = step(o["input"], o["output"], config)[1]
    if o["verbose"]:
        print(table({k: v for k, v in report.items() if k != "config"}))
    if o["report_file"]:
        Path(o["report_file"]).write_text(json.dumps(report, indent=2, default=str))
    return report


def main(argv: list[str] | None = None) -> None:
    try:
        run(argv)
    except (ValueError, OSError) as e:
        print(f"lineweave: {e}", file=sys.stderr)
        sys.exit(1)


if __name__ == "__main__":
    main()
