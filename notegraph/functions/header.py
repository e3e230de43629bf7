"""The header grammar: a subset of YAML with scalars, lists and nulls, one level deep."""

from __future__ import annotations

import re

# The lines of the grammar.
_ITEM = re.compile(r"^\s+-\s*(.*)$")
_FIELD = re.compile(r"^([A-Za-z_][A-Za-z_0-9]*)\s*:\s*(.*)$")


def unquoted(s: str) -> str:
    return s[1:-1] if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'" else s


def parse_header(raw: str) -> tuple[dict, dict, list, list]:
    """(scalars, lists, keys, inline_lists) of a header's lines; an empty value is a null scalar; a later key replaces an earlier."""
    values: dict[str, str | list[str] | None] = {}
    inline: list[str] = []
    open_list: list[str] | None = None
    lines = raw.split("\n")
    for i, line in enumerate(lines):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item = _ITEM.match(line)
        if item and open_list is not None:
            open_list.append(unquoted(item[1].strip()))
            continue
        field = _FIELD.match(line)
        if not field:
            continue
        key, value = field[1], field[2].strip()
        open_list = None
        if not value:
            if i + 1 < len(lines) and _ITEM.match(lines[i + 1]):
                open_list = []
                values[key] = open_list
            else:
                values[key] = None
        elif value.startswith("[") and value.endswith("]"):
            inner = value[1:-1].strip()
            values[key] = [unquoted(x.strip()) for x in inner.split(",")] if inner else []
            inline += [key] if key not in inline else []
        else:
            values[key] = unquoted(value)
    scalars = {k: v for k, v in values.items() if not isinstance(v, list)}
    return scalars, {k: v for k, v in values.items() if isinstance(v, list)}, list(values), inline


def entries(raw: str) -> list[tuple[str, str]]:
    """(field, lines) of a header's entries: a field starts in the first column and owns all lines up to the next; lines before the first have field ''."""
    out: list[tuple[str, str]] = []
    for line in raw.split("\n"):
        if ":" in line and line[0] not in " \t-#":
            out.append((line.split(":", 1)[0].strip(), line))
        elif out:
            out[-1] = (out[-1][0], out[-1][1] + "\n" + line)
        else:
            out.append(("", line))
    return out
