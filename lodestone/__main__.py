"""Command line: python -m lodestone scan|scan-history|validate-patch|validate|rules|explain|baseline|waivers|report|profiles|init|doctor."""

from __future__ import annotations

import argparse
import json
import sys

from . import api, config
from .sinks import reports


def _spark():
    from .session import local_session

    return local_session("lodestone")


def _settings(a: argparse.Namespace) -> dict:
    return config.load(a.config, a.profile) if a.config else config.build({}, a.profile)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--path", default=".")
    common.add_argument("--config")
    common.add_argument("--profile")
    common.add_argument("--format", default="text")
    common.add_argument("--base-ref", help="only findings on lines changed since")
    for name in ("scan", "validate-patch", "scan-history", "report", "validate", "doctor"):
        sub.add_parser(name, parents=[common])
    for name in ("baseline", "waivers", "init"):
        sub.add_parser(name, parents=[common]).add_argument("--out", default={"baseline": "baseline.json", "init": "lodestone.json"}.get(name))
    sub.add_parser("rules")
    sub.add_parser("profiles")
    sub.add_parser("explain").add_argument("rule")
    a = p.parse_args(argv)
    out = sys.stdout.write
    try:
        if a.command == "rules":
            out("".join(f"{r['id']}  {r['level']}  {r['unit']}\n" for r in api.rules()))
        elif a.command == "profiles":
            out(json.dumps({n or "default": config.build({}, n)["quality"] for n in config.PROFILES}, indent=2) + "\n")
        elif a.command == "explain":
            out(json.dumps(api.explain(a.rule), indent=2) + "\n")
        elif a.command == "validate":
            _settings(a)
            out("settings are valid\n")
        elif a.command == "init":
            with open(a.out, "x", encoding="utf-8") as f:
                json.dump(config.DEFAULTS, f, indent=2)
        elif a.command == "doctor":
            out(f"python {sys.version.split()[0]}, rules {len(api.rules())}, spark {_spark().version}\n")
        elif a.command == "scan-history":
            found = api.scan_history(_spark(), a.path)
            api.write_report(found.selectExpr("*", "'security' as section"), a.format, out)
            return int(not found.where("severity = 'fail'").isEmpty())
        elif a.command == "validate-patch":
            found, hidden = api.scan_patch(_spark(), a.path, sys.stdin.read(), _settings(a))
            api.write_report(found, a.format, out)
            return reports.exit_code(reports.summary(found, hidden))
        elif a.command == "waivers":
            held, spark = _settings(a), _spark()
            files = api.files_from_tree(spark, a.path, tuple(held["exclude"]) + (".git/**",))
            today = api.date.today().isoformat()
            out(json.dumps(api.waiver_audit(api.suppressed(api.evaluate(files, held), files, held, today), held, today), indent=2) + "\n")
        else:
            found, hidden = api.scan(_spark(), a.path, _settings(a), a.base_ref)
            if a.command == "baseline":
                reports.write_baseline(found, a.out)
                return 0
            api.write_report(found, a.format, out)
            return reports.exit_code(reports.summary(found, hidden))
    except (ValueError, FileExistsError) as wrong:
        sys.stderr.write(f"{wrong}\n")
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
