"""Command line of the text problems: ``python -m quarrybed.llm queries`` or ``run NAME CASE OUT``."""

from __future__ import annotations

import sys

from quarrybed.llm import queries


def main(args: list[str]) -> int:
    known = queries.queries()
    if args[:1] == ["queries"]:
        print("\n".join(sorted(known)))
        return 0
    if len(args) != 4 or args[0] != "run" or args[1] not in known:
        print("usage: queries | run NAME CASE OUT", file=sys.stderr)
        return 2
    from quarrybed.session import session

    known[args[1]](session("quarrybed"), args[2]).write.mode("errorifexists").parquet(args[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
