"""python -m corvane FOLDER [--json] [--list N|full|none] [--mermaid F] [--plantuml F] [--svg F] [--folders F] [--treemap F] [--strict] [--fix]"""

from __future__ import annotations

import argparse
import os
import sys


def mode(value: str) -> int | None:
    named = {"full": None, "none": 0, "partial": 10}
    if value in named:
        return named[value]
    if value.isdigit() and int(value) > 0:
        return int(value)
    raise argparse.ArgumentTypeError(f"{value!r} is neither full, partial, none nor a positive number")


def show(spark, config, what: str, as_json: bool, listed: int | None) -> int:
    """An inventory of the tree, without the analysis."""
    import json

    from corvane.sources import inventory, tree

    scanned = tree.classified(tree.read_tree(spark, config.root), list(config.exclude))
    facts = tree.extract(scanned.where("reason is null and is_dart and not is_test"))
    df = {"literals": inventory.literals, "ignores": inventory.ignores}[what](facts) if what != "excluded" else tree.excluded(scanned).orderBy("path")
    found = [r.asDict(recursive=True) for r in (df if listed is None else df.limit(listed)).collect()]
    print(json.dumps(found, indent=2) if as_json else "\n".join(" ".join(map(str, r.values())) for r in found))
    return 0


def fix(spark, config) -> int:
    """Write sorted members and imports of sources and sorted keys of translation files back; returns how many files change.

    New contents are made on the executors and come to the driver one part at a time, where they're written.
    """
    from corvane.plans.project import project_of
    from corvane.sources import inventory, tree, translations
    from corvane.sources.store import materialize

    scanned = materialize(tree.classified(tree.read_tree(spark, config.root), list(config.exclude)), "tree")
    project, _ = project_of(scanned, config.root)
    kept = scanned.where("reason is null")
    made = inventory.fixes(kept.where("is_dart and content is not null and not endswith(path, '.g.dart')"), project.name)
    changed = 0
    for r in made.unionByName(inventory.fixed_translations(translations.translation_files(kept.where("not is_dir")))).toLocalIterator():
        with open(os.path.join(config.root, r["path"]), "w", encoding="utf-8") as f:
            f.write(r["new_content"])
        changed += 1
    return changed


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corvane", description="Quality of a source tree, as Spark queries over its facts.")
    p.add_argument("folder", nargs="?", default=".")
    p.add_argument("--json", action="store_true")
    p.add_argument("--list", type=mode, default=10)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--strict", action="store_true")
    p.add_argument("--fix", action="store_true", help="sort members, imports and translation files first, in place")
    p.add_argument("--show", choices=("literals", "ignores", "excluded"), help="an inventory instead of the report")
    for sink in ("mermaid", "plantuml", "svg", "folders", "treemap", "issues"):
        p.add_argument(f"--{sink}")
    args = p.parse_args(argv)

    from dataclasses import replace

    from pyspark.sql import SparkSession

    from corvane.operators.graph import placed_edges
    from corvane.plans.project import analyze
    from corvane.sources import graph_text, reports
    from corvane.sources.config import load_config

    spark = SparkSession.builder.appName("corvane").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    config = load_config(args.folder)
    config = replace(config, exclude=tuple(dict.fromkeys([*config.exclude, *args.exclude])), strict=config.strict or args.strict)
    if args.fix:
        print(f"{fix(spark, config)} files changed")
    if args.show:
        return show(spark, config, args.show, args.json, args.list)
    a = analyze(spark, config.root, config)
    score = a.result.first()["score"]
    if args.json:
        print(reports.as_json(a))
    else:
        title, line, *rest = reports.text_report(a, args.list)
        band = "excellent" if score >= 95 else "good" if score >= 85 else "fair" if score >= 70 else "poor"
        print("\n".join([title, reports.colored(line, band, dict(os.environ) if sys.stdout.isatty() else {"NO_COLOR": "1"}), *rest]))
    placed = placed_edges(a.edges, a.layers)
    at = lambda given, name: reports.output_path(given, config.root, name)
    for path, name, make in ((args.mermaid, "graph.mmd", graph_text.mermaid), (args.plantuml, "graph.puml", graph_text.plantuml)):
        if path:
            with open(at(path, name), "w", encoding="utf-8") as f:
                f.writelines(r["text"] + "\n" for r in make(placed, a.layers).toLocalIterator())
    for path, name, make in ((args.svg, "files.svg", reports.files_svg), (args.folders, "folders.svg", reports.folders_svg), (args.treemap, "sizes.svg", reports.treemap_svg)):
        if path:
            with open(at(path, name), "w", encoding="utf-8") as f:
                f.write(make(a))
    if args.issues:
        reports.write_issues(a, args.issues)
    return reports.exit_code(score, config.strict)


if __name__ == "__main__":
    sys.exit(main())
