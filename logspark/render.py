"""Plain-text reports out of the small result tables."""

from __future__ import annotations

from collections.abc import Sequence


def stamp(ts) -> str:
    return ts.isoformat() if ts is not None else "?"


def entry(r) -> str:
    """L{line} [{time}] {level} {message}, continuation lines indented."""
    head = " ".join([f"L{r['line_number']}", *([f"[{stamp(r['ts'])}]"] if r["ts"] else []), *([r["level"]] if r["level"] else [])])
    first, *rest = r["message"].split("\n")
    return "\n".join([f"{head} {first}", *[" " * (len(f"L{r['line_number']}") + 1) + x for x in rest]])


def size(n: int) -> str:
    value = float(n)
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if value < 1024 or unit == "TB":
            return f"{int(value)} B" if unit == "B" else f"{value:.1f} {unit}"
        value /= 1024
    return ""


def overview(path: str, n_bytes: int, summary, levels: Sequence, ends: Sequence) -> str:
    out = [f"File: {path}", f"Size: {size(n_bytes)} ({n_bytes} bytes) | Lines: {summary['lines']}"]
    if summary["first_ts"] or summary["last_ts"]:
        out.append(f"Time: {stamp(summary['first_ts'])} → {stamp(summary['last_ts'])}")
    if levels:
        out.append("Levels: " + " ".join(f"{r['level']}={r['count']}" for r in levels))
    for part in ("head", "tail"):
        if lines := [r["raw"] for r in ends if r["part"] == part]:
            out += ["", f"--- {part.title()} ---", *lines]
    return "\n".join(out)


def matches(found: Sequence, counts) -> str:
    head = f"Matches: {counts['matches']} (scanned {counts['scanned']})" + " [truncated]" * bool(counts["truncated"])
    return "\n".join([head, *([""] if found else []), *map(entry, found)])


def segment(found: Sequence, total: int, limit: int) -> str:
    head = f"Segment: {len(found)} entries ({total} total)" + " [truncated]" * (len(found) >= limit)
    return "\n".join([head, *([""] if found else []), *map(entry, found)])


def errors(groups: Sequence, summary) -> str:
    text = [f"{summary['total_errors']} errors in {len(groups)} groups."]
    if summary["by_content"]:
        text.append("(No standard log levels found; used content heuristics.)")
    if groups:
        text.append("Top: " + ", ".join(f"'{g['fingerprint']}' ({g['count']}x)" for g in groups[:3]) + ".")
    out = ["Summary: " + " ".join(text)]
    for g in groups:
        out += ["", f"--- {g['count']}x ---", f"Fingerprint: {g['fingerprint']}"]
        for title, line, ts in (("First: ", "first_line", "first_ts"), ("Last:  ", "last_line", "last_ts")):
            out.append(f"{title}L{g[line]}" + (f" {stamp(g[ts])}" if g[ts] else ""))
        if g["stack_trace"]:
            out += ["Stack trace:", *[f"  {x}" for x in g["stack_trace"].split("\n")]]
    return "\n".join(out)


def stats(span, levels: Sequence, histogram: Sequence, label: str, patterns: Sequence, peak) -> str:
    text = [f"{span['entries']} entries" + (f" over {span['span_text']}" if span["span_text"] else "") + "."]
    if span["errors"]:
        text.append(f"{span['error_pct']:.1f}% errors.")
    if peak:
        text.append(f"Peak: {peak['count']} at {stamp(peak['bucket_start'])}.")
    out = ["Summary: " + " ".join(text)]
    if levels:
        out += ["", "Levels: " + " ".join(f"{r['level']}={r['count']}" for r in levels)]
    if histogram:
        out += ["", f"Histogram ({label} buckets):", *[f"  {stamp(r['bucket_start'])}  {r['count']}" for r in histogram]]
    if patterns:
        out += ["", "Top patterns:", *[f"  {r['count']:>4}x {r['pattern']}" for r in patterns]]
    return "\n".join(out)


def compare(files: dict[str, str], summary, unique: Sequence, shared: Sequence, outliers: Sequence, threshold: float, scored: bool) -> str:
    tag = lambda r: (f"[{r['p_look']:.2f}] " if scored else "", f"[{r['level']}] " if r["level"] else "")
    text = [f"{summary['patterns']} patterns across {len(files)} files ({summary['shared']} shared)."]
    by_label = {x: [r for r in unique if r["file_label"] == x] for x in files}
    for label, rows in by_label.items():
        if rows:
            mark = " [error]" if rows[0]["level"] in ("ERROR", "FATAL", "CRITICAL") else ""
            text.append(f"{label}: {summary[f'unique_{label}']} unique (top: '{rows[0]['pattern']}' {rows[0]['count']}x{mark})")
    if outliers:
        text.append(f"Biggest outlier: '{outliers[0]['pattern']}' ({outliers[0]['ratio']}x ratio)")
    out = ["Files: " + " ".join(f"{k}={v}" for k, v in files.items()), "Summary: " + " ".join(text)]
    for label, rows in by_label.items():
        if rows:
            out += ["", f"=== Unique to {label} ({summary[f'unique_{label}']} total) ==="]
            out += [f"  {tag(r)[0]}{r['count']:>4}x {tag(r)[1]}{r['pattern']}" for r in rows]
    if shared:
        n = summary["shared"]
        out += ["", f"=== Shared (top {len(shared)} of {n}) ===" if len(shared) < n else f"=== Shared ({n}) ==="]
        out += [f"  {tag(r)[0]}" + " ".join(f"{x}={r[f'count_{x}']}" for x in files) + f" {tag(r)[1]}{r['pattern']}" for r in shared]
    if outliers:
        out += ["", f"=== Frequency outliers (ratio >= {threshold}) ==="]
        out += [f"  {tag(r)[0]}{r['ratio']}x low={r['low']} high={r['high']} {tag(r)[1]}{r['pattern']}" for r in outliers]
    return "\n".join(out)


def classification(path: str, counts, captured: Sequence, threshold: float, output: str, seconds: float) -> str:
    share = 100 * counts["look"] / counts["total"] if counts["total"] else 0.0
    lines = [f"L{r['line_number']} [{r['p_look']:.3f}] {r['raw']}" for r in captured]
    if output == "look_only":
        out = [f"File: {path}", f"Lines: {counts['total']:,} total | {counts['look']:,} LOOK ({share:.1f}%)"]
        out += [f"Showing {len(lines)} of {counts['look']:,} LOOK lines (threshold={threshold})", "", *lines]
        if counts["look"] > len(lines):
            out.append(f"... ({counts['look'] - len(lines)} more LOOK lines not shown, increase max_look_lines)")
        return "\n".join(out)
    out = [f"File: {path}", f"Lines: {counts['total']:,} total | {counts['look']:,} LOOK ({share:.1f}%) | {counts['skip']:,} SKIP"]
    out += [f"Performance: {seconds:.2f}s ({counts['total'] / seconds if seconds else 0:,.0f} lines/sec)", f"Threshold: {threshold}"]
    if captured:
        p = [r["p_look"] for r in captured]
        out.append(f"Confidence: {sum(x >= 0.9 for x in p)} high (>=0.9) | {sum(0.7 <= x < 0.9 for x in p)} medium (0.7-0.9) | {sum(x < 0.7 for x in p)} low (<0.7)")
        out += ["", f"--- Sample LOOK lines ({min(30, len(lines))} of {len(lines)} captured, {counts['look']:,} total) ---", *lines[:30]]
        if len(lines) > 30:
            out.append(f"... ({len(lines) - 30} more captured lines)")
    return "\n".join(out)
