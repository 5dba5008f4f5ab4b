"""The console: one command a line."""

from __future__ import annotations

import re
import sys

from tidelog.store import Store

# Page size, characters shown of a value, and what a part of a line is; the lines of _shown are fixed too.
PAGE, SHOWN = 30, 300
_PART = re.compile(r"""[^\s"']+|"[^"]*"|'[^']*'""")
HELP = """PUT key <value | -s file> | GET key [-d file [-a]] | DELETE key
RangeScan start end [page] [size] | PrefixScan prefix [page] [size]
NewBF key n p | DeleteBF key | BFAdd key <value | -s file> | BFHasKey key <value | -s file>
NewCMS key epsilon delta | DeleteCMS key | CMSAdd key <value | -s file> | CMSGet key <value | -s file>
NewHLL key p | DeleteHLL key | HLLAdd key <value | -s file> | HLLEstimate key
SHAddFingerprint key text | SHDeleteFingerprint key | SHGetHammingDistance key key
HELP | EXIT"""


def split(line: str) -> list[str]:
    """Words and quoted parts; from the third on, double quotes around a non-empty part are taken off, single ones never."""
    parts = _PART.findall(line)
    return [p[1:-1] if i >= 2 and len(p) >= 3 and p[0] == p[-1] == '"' else p for i, p in enumerate(parts)]


def _flag(p: str, name: str) -> bool:
    return p.lower() in (f"-{name}", f"/{name}")


def _shown(page: int, size: int, records: list[tuple[str, bytes]]) -> str:
    lines = [f"Page {page}, page size {size}", "(K - key, V - value)"]
    for i, (k, v) in enumerate(records):
        text = v[:SHOWN].decode(errors="replace") + ("..." if len(v) > SHOWN else "")
        lines.append(f"  Record {i} - K: {k}  V: {text}")
    return "\n".join(lines)


def _value(a: list[str]) -> bytes:
    """The value behind a key: given, or with -s that of a file."""
    if len(a) == 2:
        return a[1].encode()
    if len(a) > 2 and _flag(a[1], "s"):
        with open(a[2], "rb") as f:
            return f.read()
    raise ValueError("invalid arguments")


def _get(db: Store, a: list[str]) -> str:
    if len(a) in (0, 2):
        raise ValueError("invalid arguments")
    target, mode = None, "wb"
    if len(a) == 4:
        if _flag(a[1], "d") and _flag(a[3], "a"):
            target, mode = a[2], "ab"
        elif _flag(a[2], "d") and _flag(a[1], "a"):
            target, mode = a[3], "ab"
        else:
            raise ValueError("invalid arguments")
    elif len(a) >= 3:
        if not _flag(a[1], "d"):
            raise ValueError("invalid arguments")
        target = a[2]
    value = db.get(a[0])
    if target is None:
        return (value or b"").decode(errors="replace")
    with open(target, mode) as f:
        f.write(value or b"")
    return ""


def _paged(a: list[str], at: int) -> tuple[int, int]:
    return int(a[at]) if len(a) > at else 1, int(a[at + 1]) if len(a) > at + 1 else PAGE


def _range(db: Store, a: list[str]) -> str:
    page, size = _paged(a, 2)
    return _shown(page, size, db.range_scan(a[0], a[1], page, size))


def _prefix(db: Store, a: list[str]) -> str:
    page, size = _paged(a, 1)
    return _shown(page, size, db.prefix_scan(a[0], page, size))


def _say(x) -> str:
    return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


#: Name, least arguments, what it does.
COMMANDS = {
    "put": (2, lambda db, a: _say(db.put(a[0], _value(a)))),
    "get": (1, _get),
    "delete": (1, lambda db, a: _say(db.delete(a[0]))),
    "rangescan": (2, _range),
    "prefixscan": (1, _prefix),
    "newbf": (3, lambda db, a: _say(db.new_bf(a[0], int(a[1]), float(a[2])))),
    "deletebf": (1, lambda db, a: _say(db.delete_bf(a[0]))),
    "bfadd": (2, lambda db, a: _say(db.bf_add(a[0], _value(a)))),
    "bfhaskey": (2, lambda db, a: _say(db.bf_has_key(a[0], _value(a)))),
    "newcms": (3, lambda db, a: _say(db.new_cms(a[0], float(a[1]), float(a[2])))),
    "deletecms": (1, lambda db, a: _say(db.delete_cms(a[0]))),
    "cmsadd": (2, lambda db, a: _say(db.cms_add(a[0], _value(a)))),
    "cmsget": (2, lambda db, a: _say(db.cms_get(a[0], _value(a)))),
    "newhll": (2, lambda db, a: _say(db.new_hll(a[0], int(a[1])))),
    "deletehll": (1, lambda db, a: _say(db.delete_hll(a[0]))),
    "hlladd": (2, lambda db, a: _say(db.hll_add(a[0], _value(a)))),
    "hllestimate": (1, lambda db, a: _say(db.hll_estimate(a[0]))),
    "shaddfingerprint": (2, lambda db, a: _say(db.sh_add_fingerprint(a[0], a[1]))),
    "shdeletefingerprint": (1, lambda db, a: _say(db.sh_delete_fingerprint(a[0]))),
    "shgethammingdistance": (2, lambda db, a: _say(db.sh_hamming_distance(a[0], a[1]))),
}


def execute(line: str, db: Store) -> tuple[bool, str]:
    """(whether to end, what to print) of one line; errors are raised."""
    parts = split(line)
    if not parts:
        raise ValueError("invalid command")
    name, args = parts[0].lower(), parts[1:]
    if name in ("help", "?", "commands"):
        return False, HELP
    if name in ("exit", "quit", "q"):
        db.close()
        return True, ""
    if name not in COMMANDS:
        raise ValueError("invalid command")
    least, run = COMMANDS[name]
    if len(args) < least:
        raise ValueError("invalid arguments")
    return False, run(db, args)


def main(db: Store, lines=sys.stdin, out=print) -> None:
    out("Type HELP for list of commands")
    for line in lines:
        try:
            end, text = execute(line, db)
        except Exception as x:
            out(f"Error: {x}")
            continue
        if text:
            out(text)
        if end:
            return
    db.close()
