"""One decision row as text. Formatting only: every number comes from the row."""

from __future__ import annotations

MEANING = {
    "pin_violation": "the instrument's settings changed within an epoch; record a rebaseline first",
    "suite_drift": "the item set changed between runs; scores are not comparable",
    "insufficient_data": "too few runs or items to say anything",
    "both_crossed": "the control set moved, and that doesn't explain the system's move",
    "judge_only": "the control set moved, and that explains the system's move",
    "race_failed": "the system's score moved, but the control set is too small to rule the instrument out",
    "system_only": "the system's score moved while the control set, able to see it, did not",
    "no_crossing": "neither process has crossed its threshold",
}


def _number(v, form: str = "+.3f") -> str:
    return "-" if v is None else format(v, form)


def _interval(lo, hi) -> str:
    return f"[{_number(lo)}, {_number(hi)}]"


def lines(row: dict) -> list[tuple[str, str]]:
    return [
        ("stream", row["stream_id"]),
        ("verdict", "refused" if row["refused"] else row["verdict"]),
        ("rule", f"{row['rule_id']}: {MEANING[row['rule_id']]}"),
        ("system shift", f"{_interval(row['system_shift_lo'], row['system_shift_hi'])}, first crossed at monitored run {_number(row['system_crossed_at'], 'd')}"),
        ("anchor shift", f"{_interval(row['anchor_shift_lo'], row['anchor_shift_hi'])}, first crossed at monitored run {_number(row['anchor_crossed_at'], 'd')}"),
        ("corrected shift", _interval(row["corrected_lo"], row["corrected_hi"])),
        ("smallest provable instrument shift", _number(row["min_shift"], ".3f")),
        ("runs", f"{row['n_runs']} of the system, {row['n_anchor_runs']} monitored of the control set"),
    ]


def block(row: dict) -> str:
    width = max(len(k) for k, _ in lines(row))
    return "\n".join(f"{k.ljust(width)}  {v}" for k, v in lines(row))


def markdown(row: dict, title: str = "Drift attribution") -> str:
    return "\n".join([f"## {title}", "", "| | |", "|---|---|", *(f"| {k} | {v} |" for k, v in lines(row))])


def summary(row: dict) -> str:
    return f"{row['stream_id']}: {'refused' if row['refused'] else row['verdict']} ({row['rule_id']})"
