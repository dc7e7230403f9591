"""``python -m longweave VERB DATASET ...``: stages on a data set's folder; ``pipeline -p CONFIG`` runs them all."""

from __future__ import annotations

import argparse

from longweave.plans import verbs
from longweave.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="longweave")
    sub = p.add_subparsers(dest="verb", required=True)
    for name, v in verbs.VERBS.items():
        s = sub.add_parser(name, help=(v.run.__doc__ or "").split("\n")[0])
        s.add_argument("dataset", help="folder of the data set's tables")
        for key, default in v.options.items():
            if isinstance(default, bool):
                s.add_argument(f"--{key}", action="store_true")
            else:
                s.add_argument(f"--{key}", type=type(default), default=default)
    s = sub.add_parser("pipeline", help="all stages by a configuration file")
    s.add_argument("-p", "--profile", required=True, help="TOML file")
    return p


def main(argv: list[str] | None = None) -> None:
    given = vars(parser().parse_args(argv))
    name = given.pop("verb")
    spark = local_session()
    if name == "pipeline":
        print(verbs.run_pipeline(spark, verbs.Config.read(given["profile"])))
        return
    got = verbs.apply(verbs.Store(spark, given.pop("dataset")), name, **given)
    for key, value in (got or {}).items():
        print(key, value, sep="\t")


if __name__ == "__main__":
    main()
