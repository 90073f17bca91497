"""Command line: python -m termweave COMMAND ... (one local Spark session for each call)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("termweave").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _show(df) -> None:
    for line in df.toJSON().toLocalIterator():
        print(line)


def _texts(spark, args):
    return spark.createDataFrame([(k, t) for k, t in enumerate(args.text)], "text_id int, text string")


def _requested(args):
    from pyspark.sql import functions as F

    return F.array(*map(F.lit, args.scope)) if args.scope else None


def run(args) -> int:
    from pyspark.sql import functions as F

    from termweave.operators import drift, evaluate, lint, match, nearmiss, resolve, review, safety, scout, versions
    from termweave.plans import workflows
    from termweave.sources import behaviour, diff, files, layout, store, vocabulary as V

    spark, c = _session(), args.command
    load = lambda path, check=True: V.load(spark, path, check=check)
    if c == "init":
        print(layout.init(args.root, args.force))
    elif c == "status":
        print(json.dumps(layout.inspect(args.root), sort_keys=True))
    elif c == "validate":
        bad = V.integrity_problems(load(args.vocabulary, check=False))
        _show(bad)
        return int(not bad.isEmpty())
    elif c == "lint":
        _show(lint.lint(load(args.vocabulary, check=False)))
    elif c == "match":
        _show(match.match_all(_texts(spark, args), match.surface_dimension(load(args.vocabulary)), _requested(args)))
    elif c == "resolve":
        _show(resolve.resolve(_texts(spark, args), load(args.vocabulary), _requested(args)))
    elif c == "guard":
        _show(resolve.guard(_texts(spark, args).withColumn("tool_name", F.lit(args.tool)), load(args.vocabulary), _requested(args)))
    elif c == "suggest":
        _show(nearmiss.suggest(spark.createDataFrame([(t,) for t in args.text], "name string"), load(args.vocabulary)))
    elif c == "validate-queries":
        bad = behaviour.query_problems(behaviour.read_queries(spark, args.queries))
        _show(bad)
        return int(not bad.isEmpty())
    elif c == "check":
        m = evaluate.metrics(*evaluate.run_evaluation(behaviour.read_queries(spark, args.queries), load(args.vocabulary)))
        _show(m)
        return int(m.where("metric = 'overall' AND passed < total").count())
    elif c == "check-merge":
        lines = diff.added_lines(spark, diff.git_diff(args.root, args.base, args.head))
        u = drift.unknown_identifiers(lines, load(args.vocabulary))
        _show(u if args.all else u.where("review_kind <> 'unresolved_identifier'"))
    elif c in ("ingest", "discover", "scan"):
        docs, skipped = files.read_documents(files.discover(spark, str(Path(args.root).resolve())))
        if c == "ingest":
            _show(docs.drop("text"))
            _show(skipped)
        elif c == "discover":
            _show(scout.ranked(scout.discover(docs, most=args.limit)))
        else:
            out = workflows.scan(docs, load(args.vocabulary) if args.vocabulary else None, most=args.limit)
            w = store.Workspace(spark, f"file://{Path(args.root).resolve()}/.termweave")
            w.upsert("documents", docs)
            w.upsert("candidates", out["candidates"])
            w.upsert("packs", out["packs"])
            print(json.dumps(w.summary(), sort_keys=True))
    elif c == "safety":
        _show(safety.scan(_texts(spark, args), id_col="text_id"))
    elif c == "diff":
        _show(versions.diff(load(args.before), load(args.after)))
    elif c == "merge":
        three = tuple(load(p, check=False) for p in (args.base, args.ours, args.theirs))
        merged, clash = versions.merge(*three)
        _show(merged.terms.drop("term_ord", "replacement_id"))
        _show(clash)
        return int(not clash.isEmpty())
    elif c == "migrations":
        _show(versions.migrations(load(args.vocabulary)))
    elif c == "policy":
        _show(review.check_policy(spark.createDataFrame([(args.mode, args.action, None, args.role)], "mode string, action string, actor string, role string")))
    elif c == "events":
        _show(store.Workspace(spark, args.workspace).events(args.decision))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="termweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str, **options):
        s = sub.add_parser(name)
        for x in positional:
            s.add_argument(x)
        for k, v in options.items():
            s.add_argument("--" + k.replace("_", "-"), **v)
        return s

    scope, text = {"action": "append", "default": []}, {"action": "append", "default": [], "required": True}
    add("init", "root", force={"action": "store_true"})
    add("status", "root")
    for name in ("validate", "lint", "migrations"):
        add(name, "vocabulary")
    for name in ("match", "resolve", "suggest"):
        add(name, "vocabulary", text=text, scope=scope)
    add("guard", "vocabulary", text=text, scope=scope, tool={"required": True})
    add("validate-queries", "queries")
    add("check", "vocabulary", "queries")
    add("check-merge", "vocabulary", "root", base={"default": "main"}, head={"default": "HEAD"}, all={"action": "store_true"})
    for name in ("ingest", "discover", "scan"):
        add(name, "root", limit={"type": int, "default": 20}, vocabulary={})
    add("safety", text=text)
    add("diff", "before", "after")
    add("merge", "base", "ours", "theirs")
    add("policy", "mode", "action", role={})
    add("events", "workspace", decision={})
    return p


if __name__ == "__main__":
    sys.exit(run(parser().parse_args()))
