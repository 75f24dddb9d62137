"""``python -m axiomloom.tables2txt FILE...``: every table of the files as CSV text."""

import sys

from .sources.tables import TableError, text_of


def main(paths: list[str]) -> int:
    try:
        for path in paths:
            sys.stdout.write(text_of(path))
        return 0
    except (TableError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
