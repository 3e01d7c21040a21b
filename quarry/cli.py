"""Command line: JSON unless --text; exit 1 on failure, 2 if a request cannot be answered."""

from __future__ import annotations

import argparse
import difflib
import json
import sys
from pathlib import Path

from quarry.functions.classify import CATEGORIES
from quarry.index import Busy, Index, NotIndexed
from quarry.settings import ConfigError, as_toml, load

METRICS = {"lexical": "bm25", "vector": "cosine"}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *scopes: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--root", "-r", default=".")
        p.add_argument("--config", type=Path)
        p.add_argument("--git")
        p.add_argument("--rev", default="HEAD")
        p.add_argument("--text", action="store_true")
        for s in scopes:
            p.add_argument(*(["-l"] if s == "lang" else []), f"--{s}", nargs="+", default=[])
        return p

    s = add("search", "content", "lang", "include", "exclude")
    s.add_argument("query", nargs="+")
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--code", choices=["full", "signature", "none"], default="full")
    for name in ("defs", "refs"):
        add(name, "lang").add_argument("name")
    s = add("symbols", "content", "lang", "include", "exclude")
    s.add_argument("pattern", nargs="?", default="*")
    s.add_argument("--tag", choices=["def", "ref"])
    s.add_argument("--count-by", choices=["name", "lang", "file", "tag", "content"])
    s.add_argument("--limit", type=int)
    for name in ("index", "init"):
        add(name).add_argument("--force", action="store_true")
    add("status")
    add("config")
    add("clear").add_argument("--dry-run", action="store_true")
    return top


def _show(out: dict, as_text: bool) -> None:
    if not as_text:
        print(json.dumps(out))
        return
    for k, v in out.items():
        if isinstance(v, list):
            for row in v:
                print("  ".join(f"{a}={b}" for a, b in row.items()))
        else:
            print(f"{k}: {v}")


def _check_langs(index: Index, langs: list[str]) -> None:
    have = sorted(r.lang for r in index.table("file").select("lang").distinct().collect())
    for lang in langs:
        if have and lang not in have:
            near = difflib.get_close_matches(lang, have, 1, 0.6)
            raise NotIndexed(f"--lang {lang!r} matches no indexed language, " + (f"did you mean {near[0]!r}?" if near else f"this index has: {', '.join(have)}"))


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(argv)
    try:
        if a.git:
            from quarry.sources.tree import checkout

            a.root = checkout(a.git, a.rev, str(Path.home() / ".cache" / "quarry"))
        settings = load(a.config, Path(a.root, "quarry.toml"))
        if a.command == "config":
            print(as_toml(settings), end="")
            return 0
        if a.command == "init":
            target = Path(a.root, "quarry.toml")
            if target.exists() and not a.force:
                raise FileExistsError(f"{target} exists")
            target.write_text(as_toml(settings))
            return 0
        if a.command in ("search", "symbols") and (bad := set(a.content) - {*CATEGORIES, "all"}):
            print(f"unknown content: {', '.join(sorted(bad))}", file=sys.stderr)
            return 2 if a.command == "search" else 1
        if spark is None:
            from quarry.session import session

            spark = session(master="local[*]")
        index = Index(spark, a.root, settings)
        if a.command == "clear":
            _show({"cleared": index.clear(a.dry_run)}, a.text)
            return 0
        if a.command == "index":
            _show(index.refresh(a.force), a.text)
            return 0
        index.fresh()
        rows = lambda df: [r.asDict() for r in df.collect()]
        if a.command == "status":
            _show({r.kind: r.n for r in index.status().collect()}, a.text)
        elif a.command in ("defs", "refs"):
            found = rows((index.definitions if a.command == "defs" else index.references)(a.name, a.lang or None))
            _check_langs(index, a.lang)
            keys = ("name", "tag", "path", "start_line", "end_line", "lang", "content_type", "enclosing", "signature")
            split: dict[str, int] = {}
            for r in found:
                split[r["content_type"]] = split.get(r["content_type"], 0) + 1
            _show({"name": a.name, "count": len(found), "by_content_type": dict(sorted(split.items(), key=lambda kv: -kv[1])), "symbols": [{k: r[k] for k in keys if r.get(k) is not None} for r in found]}, a.text)
        elif a.command == "symbols":
            where = {"pattern": a.pattern, "tag": a.tag, "content": a.content, "langs": a.lang, "include": a.include, "exclude": a.exclude}
            if a.count_by:
                counts, total = index.symbol_counts(a.count_by, a.limit, **where)
                _show(total.first().asDict() | {"counts": rows(counts)}, a.text)
            else:
                found = rows(index.symbols(limit=a.limit, **where).select("name", "tag", "path", "start_line", "end_line", "lang", "content_type"))
                _show({"count": len(found), "symbols": found}, a.text)
            _check_langs(index, a.lang)
        else:
            q = spark.createDataFrame([(0, " ".join(a.query))], "query_id int, query string")
            hits = rows(index.search(q, a.k, a.content, a.lang, a.include, a.exclude).orderBy("rank"))
            _check_langs(index, a.lang)
            drop = {"full": ("signature",), "signature": ("code",), "none": ("signature", "code")}[a.code] + ("query_id", "rank")
            shown = [{k: v for k, v in h.items() if k not in drop} | {"score": round(h["score"], 4), "tiers": {METRICS.get(t, t): round(-x if t == "lexical" else x, 4) for t, x in (h["tiers"] or {}).items()}} for h in hits]
            _show({"query": " ".join(a.query), "count": len(shown), "results": shown}, a.text)
        return 0
    except NotIndexed as e:
        print(e, file=sys.stderr)
        return 2
    except (Busy, ConfigError, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
