"""Edits of XML sidecars that leave all else as it is, byte for byte.

A text is parsed for where its elements and tags begin and end; edits are replacements of such ranges, made from the last
to the first, and the result must parse again. Names are told apart by namespace, not by prefix."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame

# Namespaces, codes of labels, versions of operations and the parameters all steps share.
RDF, DT = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://darktable.sf.net/"
CRS, XMP, OWN = "http://ns.adobe.com/camera-raw-settings/1.0/", "http://ns.adobe.com/xap/1.0/", "urn:gristmill:1.0"
PREFIXES = {RDF: "rdf", DT: "darktable", CRS: "crs", XMP: "xmp", OWN: "gm"}
PORTION, ROWS = 2_000_000, 1000  # fixed values: characters and rows after which edited texts leave a task's Python
LABELS = {"red": 0, "yellow": 1, "green": 2}
CROP_VERSION, TURN_VERSION, TURN_BYTES, BLEND_VERSION = 1, 5, 892, 14
BLEND = "gz11eJxjYIAACQYYOOHEgAZY0QWAgBGLGANDgz0Ej1Q+dcF/IADRAGpyHQU="
EMPTY = f'<x:xmpmeta xmlns:x="adobe:ns:meta/">\n <rdf:RDF xmlns:rdf="{RDF}">\n  <rdf:Description rdf:about=""/>\n </rdf:RDF>\n</x:xmpmeta>\n'


@dataclass
class Element:
    uri: str
    name: str
    attributes: dict[tuple[str, str], str]
    scope: dict[str, str]
    start: int
    head: int = 0  # behind the start tag
    end: int = 0  # behind the element
    children: list[Element] = field(default_factory=list)

    def child(self, uri: str, name: str) -> Element | None:
        return next((c for c in self.children if (c.uri, c.name) == (uri, name)), None)


def _qualified(name: str, scope: dict[str, str], attribute: bool) -> tuple[str, str]:
    prefix, colon, local = name.rpartition(":")
    return ("" if attribute and not colon else scope.get(prefix, "")), local


def _tag_end(data: bytes, at: int) -> int:
    quote = 0
    while True:
        c = data[at]
        if quote:
            quote = 0 if c == quote else quote
        elif c in b"\"'":
            quote = c
        elif c == 0x3E:
            return at + 1
        at += 1


def parsed(data: bytes) -> list[Element]:
    """All elements in order of their start. ValueError if the text is not well-formed."""
    parser = expat.ParserCreate("utf-8")
    every: list[Element] = []
    stack: list[Element] = []

    def begin(name: str, attributes: dict[str, str]) -> None:
        scope = stack[-1].scope if stack else {"xml": "http://www.w3.org/XML/1998/namespace"}
        declared = {k.partition(":")[2]: v for k, v in attributes.items() if k == "xmlns" or k.startswith("xmlns:")}
        scope = scope | declared if declared else scope  # shared by elements that declare nothing
        own = {_qualified(k, scope, True): v for k, v in attributes.items() if k != "xmlns" and not k.startswith("xmlns:")}
        at = parser.CurrentByteIndex
        e = Element(*_qualified(name, scope, False), own, scope, at, _tag_end(data, at))
        if stack:
            stack[-1].children.append(e)
        stack.append(e)
        every.append(e)

    def finish(_: str) -> None:
        e = stack.pop()
        e.end = e.head if data[e.head - 2 : e.head] == b"/>" else _tag_end(data, parser.CurrentByteIndex)

    parser.StartElementHandler, parser.EndElementHandler = begin, finish
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise ValueError(f"not well-formed: {e}") from None
    finally:
        # a parser and its handlers hold each other, and with them every element, until the collector happens to run
        parser.StartElementHandler = parser.EndElementHandler = None
    return every


def replaced(data: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    for start, end, new in sorted(edits, reverse=True):
        data = data[:start] + new + data[end:]
    return data


def prefix_for(uri: str, scope: dict[str, str]) -> tuple[str, bool]:
    """A prefix for a namespace, and whether it has to be declared."""
    known = next((p for p, u in scope.items() if p and u == uri), None)
    if known:
        return known, False
    name = PREFIXES[uri]
    while name in scope:
        name += "1"
    return name, True


def with_attributes(data: bytes, e: Element, values: dict[tuple[str, str], str | None], opened: bool = False) -> bytes:
    """The start tag of an element with attributes set, or dropped where None; the others as they are written. opened:
    the tag no longer ends the element."""
    tag = data[e.start : e.head].decode()
    new = []
    for (uri, name), value in values.items():
        prefixes = [p for p, u in e.scope.items() if u == uri and p]
        pattern = rf"""\s+(?:{"|".join(map(re.escape, prefixes))}):{re.escape(name)}\s*=\s*("[^"]*"|'[^']*')""" if prefixes else None
        if value is None:
            tag = re.sub(pattern, "", tag) if pattern else tag
        elif pattern and (uri, name) in e.attributes:
            tag = re.sub(pattern, lambda m, v=value: m[0][: -len(m[1])] + quoteattr(v), tag, count=1)
        else:
            new.append((uri, name, value))
    closing = "/>" if tag.endswith("/>") else ">"
    body, scope = tag[: -len(closing)].rstrip(), dict(e.scope)
    for uri, name, value in new:
        prefix, declare = prefix_for(uri, scope)
        if declare:
            scope[prefix] = uri
            body += f"\n   xmlns:{prefix}={quoteattr(uri)}"
        body += f"\n   {prefix}:{name}={quoteattr(value)}"
    return (body + (">" if opened else closing)).encode()


def descriptions(every: list[Element]) -> list[Element]:
    found = [e for e in every if (e.uri, e.name) == (RDF, "Description") and any(p.uri == RDF and p.name == "RDF" and e in p.children for p in every)]
    if not found:
        raise ValueError("no description")
    return found


def crop_params(left: float, top: float, right: float, bottom: float) -> str:
    """Edges within 0..1 and at least a thousandth apart, as little-endian floats, and a free ratio; in hexadecimal."""
    left, top, right, bottom = (min(1.0, max(0.0, v)) for v in (left, top, right, bottom))
    return struct.pack("<4f2i", left, top, max(left + 0.001, right), max(top + 0.001, bottom), 0, 0).hex()


def turn_params(degrees: float) -> str:
    """A rotation without perspective or automatic crop."""
    return struct.pack("<8f2i4fi", degrees, 0, 0, 0, 28, 1, 100, 1, 0, 0, 0, 1, 0, 1, 0).ljust(TURN_BYTES, b"\0").hex()


def steps_of(crop: list[float] | None, angle: float | None, was_applied: bool, was_angle: float | None) -> list[tuple[str, int, str, int]]:
    """Steps that set a crop and its turn, or undo those that were set: operation, version, parameters, enabled."""
    if crop is None and not was_applied:
        return []
    turn = [("ashift", TURN_VERSION, turn_params(angle if crop and angle else 0), int(bool(crop and angle)))] if (crop and angle) or was_angle else []
    return [*turn, ("crop", CROP_VERSION, crop_params(*(crop or (0, 0, 1, 1))), int(crop is not None))]


def _step(p: str, r: str, number: int, operation: str, version: int, params: str, enabled: int) -> str:
    values = {"num": number, "operation": operation, "enabled": enabled, "modversion": version, "params": params, "multi_name": "", "multi_name_hand_edited": 0, "multi_priority": 0, "blendop_version": BLEND_VERSION, "blendop_params": BLEND}
    return f"<{r}:li" + "".join(f' {p}:{k}="{v}"' for k, v in values.items()) + "/>"


def _number(text: str | None, otherwise: int) -> int:
    return int(text) if text is not None and re.fullmatch(r"\s*-?\d+\s*", text) else otherwise


def edited_history(text: str | None, steps: list[tuple[str, int, str, int]], label: str) -> str:
    """A sidecar whose history ends with the steps. Entries from its history_end on go, as do their masks; new ones are
    numbered on from the last that stays; the label's colour replaces red, yellow and green, others stay."""
    data = (text or EMPTY).encode()
    d = descriptions(parsed(data))[0]
    p, declare = prefix_for(DT, d.scope)
    r = prefix_for(RDF, d.scope)[0]
    history, masks, colours = (d.child(DT, n) for n in ("history", "masks_history", "colorlabels"))
    seq = history.child(RDF, "Seq") if history else None
    if history and history.children and (seq is None or len(history.children) > 1):
        raise ValueError("a history of an unknown form")
    entries = seq.children if seq else []
    numbers = [_number(e.attributes.get((DT, "num")), i) for i, e in enumerate(entries)]
    end = _number(d.attributes.get((DT, "history_end")), len(entries))
    kept = [(e, n) for e, n in zip(entries, numbers, strict=True) if n < end]
    gone = {n for n in numbers if n >= end}
    after = max((n for _, n in kept), default=-1) + 1
    lines = [data[e.start : e.end].decode() for e, _ in kept] + [_step(p, r, after + i, *s) for i, s in enumerate(steps)]
    block = lambda name, items: f"<{p}:{name}><{r}:Seq>" + "".join(items) + f"</{r}:Seq></{p}:{name}>"
    codes = set()
    for li in (colours.child(RDF, "Seq").children if colours and colours.child(RDF, "Seq") else []):
        inner = re.fullmatch(rb"\s*(\d+)\s*", data[li.head : data.rfind(b"</", li.head, li.end)]) if li.end > li.head else None
        codes |= {int(inner[1])} if inner else set()
    codes = sorted(codes - set(LABELS.values()) | {LABELS[label]})
    parts = [(history, block("history", lines) if lines else ""), (colours, block("colorlabels", [f"<{r}:li>{c}</{r}:li>" for c in codes]))]
    edits = [(old.start, old.end, new.encode()) for old, new in parts if old]
    fresh = "".join(new for old, new in parts if not old)
    for mask in [m for s in (masks.children if masks else []) for m in s.children]:
        if _number(mask.attributes.get((DT, "mask_num")), -1) in gone:
            edits.append((mask.start, mask.end, b""))
    empty = data[d.head - 2 : d.head] == b"/>"
    values = {(DT, "history_end"): str(after + len(steps)), (DT, "history_current_hash"): None}
    if (DT, "xmp_version") not in d.attributes:
        values[DT, "xmp_version"] = "5"
    head = with_attributes(data, d, values, opened=empty)
    tag_name = re.match(rb"<([^\s/>]+)", data[d.start : d.head])[1]
    edits.append((d.start, d.head, head + fresh.encode() + (b"</" + tag_name + b">" if empty else b"")))
    new = replaced(data, edits)
    parsed(new)
    return new.decode()


def with_values(text: str | None, values: dict[tuple[str, str], str]) -> str:
    """A sidecar with properties set as attributes of its first description; they go wherever else they are stored, as
    attributes or as elements of any description."""
    data = (text or EMPTY).encode()
    found = descriptions(parsed(data))
    edits = [(c.start, c.end, b"") for d in found for c in d.children if (c.uri, c.name) in values]
    for d in found:
        there = {k: None for k in values if k in d.attributes}
        wanted = dict(values) if d is found[0] else there
        if wanted:
            edits.append((d.start, d.head, with_attributes(data, d, wanted)))
    new = replaced(data, edits)
    parsed(new)
    return new.decode()


def raw_values(crop: list[float] | None, was_applied: bool, label: str, revision: int) -> dict[tuple[str, str], str]:
    """The properties of a crop (in the stored orientation) and its label."""
    values = {(XMP, "Label"): label.capitalize(), (OWN, "Label"): label, (OWN, "Revision"): str(revision)}
    if crop is not None:
        values |= {(CRS, "HasCrop"): "True", (CRS, "CropAngle"): "0"}
        values |= {(CRS, f"Crop{side}"): f"{v:.6f}" for side, v in zip(("Left", "Top", "Right", "Bottom"), crop, strict=True)}
    elif was_applied:
        values[CRS, "HasCrop"] = "False"
    return values


def edited(sidecars: DataFrame, kind: str) -> DataFrame:
    """sidecars (path, text: null where there is none, crop array<double>: null for none, angle, was_applied, was_angle,
    label, revision) -> path, text, error: the text to be written. kind: "history" or "raw". A text that can't be edited
    gives an error and no text, so that the file stays. Python holds a batch of Arrow's, one text taken apart and a portion
    of edited ones, whatever the number of sidecars."""

    def one(row: dict) -> str:
        if kind == "raw":
            return with_values(row["text"], raw_values(row["crop"], bool(row["was_applied"]), row["label"], row["revision"]))
        return edited_history(row["text"], steps_of(row["crop"], row["angle"], bool(row["was_applied"]), row["was_angle"]), row["label"])

    def written(row: dict) -> tuple:
        try:
            return row["path"], one(row), None
        except (ValueError, KeyError, TypeError) as e:
            return row["path"], None, str(e)[:200]

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                out.append(written(batch.slice(i, 1).to_pylist()[0]))  # one text at a time
                size += len(out[-1][1] or "")
                if size >= PORTION or len(out) >= ROWS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(3)], names=["path", "text", "error"])
                    out, size = [], 0

    return sidecars.select("path", "text", "crop", "angle", "was_applied", "was_angle", "label", "revision").mapInArrow(run, "path string, text string, error string")
