"""Project files and index documents read from XML.

The parser is an Arrow-batched UDF: Spark's own XML reader differs on prefixes, repeated and
mixed elements, and cannot tell malformed input from absent values. A tree of (tag, text before
the first child, children) is built by expat; entity declarations are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.schema import POM, POM_NAMESPACE

_PLACEHOLDER = re.compile(r"\$\{([^}]+)\}")
PASSES = 10


class Node:
    __slots__ = ("children", "tag", "text")

    def __init__(self, tag: str) -> None:
        self.tag, self.text, self.children = tag, "", []

    def all(self, name: str, spaces: tuple[str, ...] = (POM_NAMESPACE + "}", "")) -> list[Node]:
        """Children of a name in the first of the namespaces that has any."""
        for space in spaces:
            if found := [c for c in self.children if c.tag == space + name]:
                return found
        return []

    def first(self, name: str) -> Node | None:
        return next(iter(self.all(name)), None)

    def value(self, name: str, default: str = "") -> str:
        found = self.first(name)
        return default if found is None else found.text


def tree(body: bytes | str | None) -> Node | None:
    """The root of a document, null if it is malformed or declares entities."""
    if body is None:
        return None
    parser = expat.ParserCreate(namespace_separator="}")
    top = Node("")
    stack = [top]

    def start(tag: str, _: dict) -> None:
        node = Node(tag)
        stack[-1].children.append(node)
        stack.append(node)

    def text(data: str) -> None:
        if not stack[-1].children:
            stack[-1].text += data

    def refuse(*_: object) -> None:
        raise ValueError("entities are not allowed")

    parser.StartElementHandler, parser.EndElementHandler = start, lambda _: stack.pop()
    parser.CharacterDataHandler, parser.EntityDeclHandler = text, refuse
    parser.buffer_text = True
    try:
        parser.Parse(body.encode() if isinstance(body, str) else bytes(body), True)
    except (expat.ExpatError, ValueError, UnicodeError, LookupError):
        return None
    return top.children[0]


def properties(root: Node) -> dict[str, str]:
    """Placeholders' values: the project's own fields, then <properties>, which win."""
    fields = ("groupId", "artifactId", "version", "packaging", "name", "description", "url")
    out = {f"project.{f}": v for f in fields if (v := root.value(f, "jar" if f == "packaging" else ""))}
    block = root.first("properties")
    for child in block.children if block else []:
        if child.text:
            out[child.tag.replace(POM_NAMESPACE + "}", "")] = child.text.strip()
    return out


def resolve(text: str, values: dict[str, str]) -> str:
    for _ in range(PASSES):
        new = _PLACEHOLDER.sub(lambda m: values.get(m[1], m[0]), text)
        if new == text:
            break
        text = new
    return text


#: What becomes of a field's text: an empty one is null, it stays as it is, or it is compared.
OR_NULL, AS_IS, IS_TRUE = (lambda text: text or None), str, "true".__eq__

#: The fields of a record: (field, path of elements, value where there is none, what becomes of
#: it). Those of LISTED are arrays of records, one for each element of a name.
FIELDS = [("name", ("name",), "", OR_NULL), ("description", ("description",), "", OR_NULL), ("packaging", ("packaging",), "jar", OR_NULL), ("url", ("url",), "", OR_NULL), ("scm_url", ("scm", "url"), "", OR_NULL)]
LISTED = {
    "licenses": ("license", [("name", ("name",), "", AS_IS), ("url", ("url",), "", AS_IS)]),
    "dependencies": ("dependency", [
        ("group_id", ("groupId",), "", AS_IS), ("artifact_id", ("artifactId",), "", AS_IS), ("version", ("version",), "", AS_IS), ("scope", ("scope",), "", OR_NULL), ("optional", ("optional",), "", IS_TRUE),
    ]),
}


def record(node: Node, fields: list[tuple], values: dict[str, str]) -> dict:
    """A record of `fields` below a node."""
    out: dict = {}
    for field, (*above, name), default, become in fields:
        at: Node | None = node
        for step in above:
            at = at.first(step) if at else None
        out[field] = become(resolve(at.value(name, default), values) if at else "")
    return out


def pom_fields(body: bytes | str | None) -> dict | None:
    """The record of a project file; null if it cannot be read."""
    root = tree(body)
    if root is None:
        return None
    values = properties(root)
    out = record(root, FIELDS, values)
    for field, (element, fields) in LISTED.items():
        block = root.first(field)
        out[field] = None if block is None else [record(x, fields, values) for x in block.all(element)]
    return out


_PARSED = T.StructType([T.StructField("ok", T.BooleanType()), *POM.fields])


@F.pandas_udf(_PARSED)
def _parse(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in bodies:
        rows = [pom_fields(x) for x in batch]
        yield pd.DataFrame([{"ok": x is not None} | (x or dict.fromkeys(POM.names)) for x in rows], columns=_PARSED.names)


def parsed_pom(body: Column) -> Column:
    """struct(ok, fields of POM): ok is false where the body cannot be read."""
    return _parse(body)


_INDEX = T.StructType([T.StructField("ok", T.BooleanType()), *(T.StructField(n, T.StringType()) for n in ("group_id", "artifact_id", "version"))])


def index_fields(body: bytes | str | None) -> dict:
    """Group, artifact and version that an index document names, by bare tags only."""
    root = tree(body)
    if root is None:
        return {"ok": False, "group_id": None, "artifact_id": None, "version": None}
    of = lambda name: next((c.text for c in root.all(name, ("",))), None)
    return {"ok": True, "group_id": of("groupId") or "", "artifact_id": of("artifactId") or "", "version": of("version")}


@F.pandas_udf(_INDEX)
def _parse_index(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in bodies:
        yield pd.DataFrame([index_fields(x) for x in batch], columns=_INDEX.names)


def parsed_index(body: Column) -> Column:
    """struct(ok, group_id, artifact_id, version) of an index document."""
    return _parse_index(body)


def as_json(value: Column) -> Column:
    """Licenses or dependencies of a package as a JSON array of objects."""
    return F.to_json(value)


def from_json(text: Column, field: str) -> Column:
    """That field of a package from its JSON; null if it is none."""
    return F.from_json(text, POM[field].dataType)
