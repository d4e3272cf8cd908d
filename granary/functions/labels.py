"""Labels: a string map for each content, selectors and filter expressions over it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_labels(text: Column) -> Column:
    """Labels given as a JSON object of strings; null if it is none."""
    return F.from_json(text, "map<string,string>")


def set_label(labels: Column, key: str, value: str) -> Column:
    kept = F.map_filter(F.coalesce(labels, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), F.lit(value)))


def unset_label(labels: Column, key: str) -> Column:
    return F.map_filter(labels, lambda k, _: k != key)


def selector(labels: Column, text: str) -> Column:
    """`k=v`, `k!=v`, `k~part` or `k` (exists), joined by commas that mean "and". A missing key
    is never selected."""
    found = F.lit(True)
    for term in text.split(","):
        m = re.fullmatch(r"\s*([^=~!\s]+)\s*(!=|=|~)?\s*(.*?)\s*", term)
        if not m or (m[2] is None and m[3]):
            raise ValueError(f"not a label selector: {term!r}")
        value = F.try_element_at(labels, F.lit(m[1]))
        tests = {"=": value == m[3], "!=": value != m[3], "~": F.contains(value, F.lit(m[3])), None: value.isNotNull()}
        found = found & F.coalesce(tests[m[2]], F.lit(False))
    return found


_TOKEN = re.compile(r"""\s*(?:(\(|\))|([A-Za-z_]\w*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s()"']+))|(AND|OR|NOT)\b)""")


def filter_expression(text: str, columns: dict[str, Column], labels: Column | None = None) -> Column:
    """A boolean expression of `field="value"` terms with NOT, AND, OR (in that order) and
    brackets; a field that ends with `label_select` holds a label selector."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a filter expression: {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    place = 0

    def peek(word: str) -> bool:
        return place < len(tokens) and (tokens[place][6] == word or tokens[place][1] == word)

    def either() -> Column:
        nonlocal place
        left = both()
        while peek("OR"):
            place += 1
            left = left | both()
        return left

    def both() -> Column:
        nonlocal place
        left = single()
        while peek("AND"):
            place += 1
            left = left & single()
        return left

    def single() -> Column:
        nonlocal place
        if peek("NOT"):
            place += 1
            return ~single()
        if peek("("):
            place += 1
            inner = either()
            if not peek(")"):
                raise ValueError("a bracket is not closed")
            place += 1
            return inner
        if place >= len(tokens) or tokens[place][2] is None:
            raise ValueError("a term is missing")
        token = tokens[place]
        place += 1
        value = next(x for x in (token[3], token[4], token[5]) if x is not None)
        if labels is not None and token[2].endswith("label_select"):
            return selector(labels, value)
        if token[2] not in columns:
            raise ValueError(f"no such field: {token[2]}")
        return F.coalesce(columns[token[2]] == value, F.lit(False))

    out = either()
    if place != len(tokens):
        raise ValueError("the expression does not end")
    return out
