"""Command line for the application stages (see ``gazette.app``).

  python -m gazette seed     --root R --media M.parquet --user-media UM.parquet
  python -m gazette ingest   --root R --feeds FEEDS.parquet        (feed_url, body)
  python -m gazette crawl    --root R --pages PAGES.parquet --run-ts 2024-02-01T00:00:00
  python -m gazette work     --root R [--stream]
  python -m gazette deliver  --root R [--all-langs]
  python -m gazette timeline --root R --user 8 [--page 0] [--lang en|all]
  python -m gazette detail   --root R --article 42 --lang en

Run it with spark-submit (or plain python for local mode); the session's
``spark.checkpoint.dir`` must name shared storage on a cluster.
"""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gazette")
    sub = p.add_subparsers(dest="cmd", required=True)

    def cmd(name):
        s = sub.add_parser(name)
        s.add_argument("--root", required=True, help="folder of the stored tables")
        return s

    s = cmd("seed")
    s.add_argument("--media", help="parquet of media with rule columns")
    s.add_argument("--user-media", help="parquet of subscriptions")
    s.add_argument("--csv", help="instead: the CSV of media and rules; one user is subscribed to all of them")
    s.add_argument("--email", default="reader@example.com")
    s.add_argument("--lang", default="zh-CN")
    cmd("check")
    s = cmd("delete-media")
    s.add_argument("--id", type=int, action="append", required=True)
    s = cmd("ingest")
    s.add_argument("--feeds", required=True, help="parquet of (feed_url, body)")
    s = cmd("crawl")
    s.add_argument("--pages", required=True, help="parquet of fetched pages (url, html)")
    s.add_argument("--run-ts", required=True)
    s.add_argument("--target-lang", default="zh-CN")
    s.add_argument("--media-by-host", action="store_true")
    s = cmd("work")
    s.add_argument("--stream", action="store_true")
    s.add_argument("--every", help="with --stream: go on running, a micro-batch each such interval, e.g. '20 seconds'")
    s.add_argument("--model", help="the model function as module:name (default: an echo, for trying things out)")
    s.add_argument("--large", action="store_true", help="ask the large model")
    s = cmd("deliver")
    s.add_argument("--all-langs", action="store_true")
    s.add_argument("--by-message-media", action="store_true", help="the media that an article's jobs name, not its feed's")
    s = cmd("timeline")
    s.add_argument("--user", type=int, required=True)
    s.add_argument("--page", type=int, default=0)
    s.add_argument("--lang", default="en", help="a language code, or 'all'")
    s = cmd("detail")
    s.add_argument("--article", type=int, required=True)
    s.add_argument("--lang", required=True)
    return p


def _model(spark, name: str | None):
    """The function that ``module:name`` names; a module of one file is shipped to
    the executors (a package comes with ``--py-files``)."""
    from .operators.enrich import echo_model

    if name is None:
        return echo_model
    module, _, function = name.partition(":")
    found = importlib.import_module(module)
    if "." not in module and not hasattr(found, "__path__"):
        spark.sparkContext.addPyFile(found.__file__)
    return getattr(found, function)


def main(argv: list[str] | None = None, spark=None):
    args = _parser().parse_args(argv)
    from . import app
    from .session import build_session, configure

    spark = configure(spark) if spark is not None else build_session()
    if args.cmd == "seed" and args.csv:
        print(app.seed_from_csv(spark, args.root, args.csv, args.email, args.lang), "media")
    elif args.cmd == "check":
        df = app.check(spark, args.root).where("n_rows > 0")
        df.show(100, truncate=60)
        return df
    elif args.cmd == "delete-media":
        for name, n in app.delete_media(spark, args.root, args.id).items():
            print(n, "rows of", name)
    elif args.cmd == "seed":
        app.seed(spark, args.root, spark.read.parquet(args.media), spark.read.parquet(args.user_media))
    elif args.cmd == "ingest":
        print(app.ingest(spark, args.root, spark.read.parquet(args.feeds)), "articles added")
    elif args.cmd == "crawl":
        n = app.crawl(spark, args.root, spark.read.parquet(args.pages),
                      dt.datetime.fromisoformat(args.run_ts), args.target_lang, args.media_by_host)
        print(n, "articles crawled")
    elif args.cmd == "work":
        trigger = {"processingTime": args.every} if args.every else None
        app.work(spark, args.root, _model(spark, args.model), args.stream, args.large, trigger)
    elif args.cmd == "deliver":
        app.deliver(spark, args.root, args.all_langs, args.by_message_media)
    elif args.cmd == "timeline":
        lang = None if args.lang == "all" else args.lang
        df = app.timeline(spark, args.root, args.user, args.page, lang)
        df.show(truncate=60)
        return df
    elif args.cmd == "detail":
        df = app.detail(spark, args.root, args.article, args.lang)
        df.show(truncate=60, vertical=True)
        return df
    return None


if __name__ == "__main__":
    main(sys.argv[1:])
