"""Command line: `--type hin2eng --input TEXT` prints the Latin spelling of TEXT."""

from __future__ import annotations

import argparse

from varnika.functions.rules import hindi2english

#: The kinds of conversion by name.
KINDS = {"hin2eng": hindi2english}


def main(argv: list[str] | None = None) -> int:
    """-1 and the usage if an argument is missing, else 0 and one line: the spelling, empty for a kind that isn't known."""
    parser = argparse.ArgumentParser(prog="varnika", description=__doc__)
    for name, meaning in (("--type", f"one of {', '.join(KINDS)}"), ("--input", "the text")):
        parser.add_argument(name, help=meaning)
    given = vars(parser.parse_args(argv))
    if not all(given.values()):
        parser.print_usage()
        return -1
    convert = KINDS.get(given["type"], lambda _: "")
    print(convert(given["input"]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
