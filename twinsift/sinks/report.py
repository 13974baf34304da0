"""Console text and JSON of a report."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions import formatting as T
from twinsift.operators.report import group_report, group_savings, totals

# fixed values: rules and phrases of the console report, which those who read it by script rely on
RULE, THIN = "=" * 80, "-" * 40
NO_GROUPS = "No duplicate {media}s found."
HEADING = "DUPLICATE {media} GROUPS FOUND: {groups}"
HEADING_FILES = " ({files} duplicate files)"
GROUP = "Group {number}:"
MEMBER = ("  • {path}", "    Resolution: {resolution}", "    {label}: {value}", "    Size: {size}", "    Similarity: {similarity}", "")
SAVINGS = "Potential space savings by removing duplicates: {size}"
SAVED = "Results saved to: {file}"


def json_groups(groups: DataFrame, infos: DataFrame, media: str = "image") -> DataFrame:
    """(group_id, members): the members of a group as a JSON array in rank order."""
    middle = [F.col("format")] if media == "image" else [F.col("duration")]
    item = F.struct(F.col("path"), T.resolution_text("width", "height").alias("resolution"), *middle, F.col("file_size").alias("size"), F.col("similarity"))
    rows = groups.join(infos, "path").select("group_id", F.struct("rank", item.alias("item")).alias("r"))
    listed = rows.groupBy("group_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return listed.select("group_id", F.to_json(F.transform("r", lambda r: r["item"]), {"ignoreNullFields": "false"}).alias("members"))


def write_json(groups: DataFrame, infos: DataFrame, target: str, media: str = "image") -> bool:
    """Write the report as one JSON file; without groups nothing is written and the result is False.

    Groups are streamed to the driver one partition at a time; the file, not memory, holds them.
    """
    summary = totals(group_savings(groups, infos)).first()
    if not summary["total_groups"]:
        return False
    with open(target, "w", encoding="utf-8") as f:
        f.write('{\n  "duplicate_groups": [')
        for n, row in enumerate(json_groups(groups, infos, media).orderBy("group_id").toLocalIterator()):
            text = json.dumps(json.loads(row["members"]), indent=2).replace("\n", "\n    ")
            f.write(("," if n else "") + "\n    " + text)
        f.write("\n  ],\n")
        keys = ["total_groups", *(["total_duplicates"] if media == "image" else []), "potential_savings_bytes"]
        f.write(",\n".join(f'  "{k}": {summary[k]}' for k in keys) + "\n}")
    return True


def report_lines(groups: DataFrame, infos: DataFrame, media: str = "image") -> Iterator[str]:
    """The console report, line by line."""
    summary = totals(group_savings(groups, infos)).first()
    if not summary["total_groups"]:
        yield NO_GROUPS.format(media=media)
        return
    files = HEADING_FILES.format(files=summary["total_duplicates"]) if media == "image" else ""
    yield from (RULE, HEADING.format(media=media.upper(), groups=summary["total_groups"]) + files, RULE)
    label, column = ("Format", "format") if media == "image" else ("Duration", "duration")
    current = None
    for row in group_report(groups, infos, media).orderBy("group_id", "rank").toLocalIterator():
        if row["group_id"] != current:
            current = row["group_id"]
            yield from (GROUP.format(number=current), THIN)
        shown = {"path": row["path"], "resolution": row["resolution"], "label": label, "value": row[column], "size": row["size"], "similarity": row["similarity_text"]}
        yield from (line.format(**shown) for line in MEMBER)
    saved = groups.sparkSession.range(1).select(T.size_text(F.lit(summary["potential_savings_bytes"])).alias("s")).first()["s"]
    yield from (RULE, SAVINGS.format(size=saved), RULE)


def print_report(groups: DataFrame, infos: DataFrame, media: str = "image", output: str | None = None, say: Callable[[str], None] = print) -> None:
    """Print the report and, with ``output``, write the JSON file."""
    for line in report_lines(groups, infos, media):
        say(line)
    if output and write_json(groups, infos, output, media):
        say(SAVED.format(file=output))
