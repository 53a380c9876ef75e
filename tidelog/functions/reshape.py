"""Reshaping JSON documents by a list of operations.

shift: a tree of keys whose leaves name where the value goes (a dotted path, or several); ``*`` matches the keys that no other
names, ``a|b`` either, and ``&`` in a path is the key that matched. default: adds what is missing or null. remove: takes keys out.
"""

from __future__ import annotations

import copy
import json

Spec = list[dict]


def _put(out: dict, path: str, value) -> None:
    *way, last = path.split(".")
    for k in way:
        nxt = out.get(k)
        if not isinstance(nxt, dict):
            nxt = out[k] = {}
        out = nxt
    if last not in out:
        out[last] = value
    else:  # a second value at a place makes a list
        out[last] = [*(out[last] if isinstance(out[last], list) else [out[last]]), value]


def _matches(spec: dict, doc: dict):
    named = {a: v for k, v in spec.items() if k != "*" for a in k.split("|")}
    for key, value in doc.items():
        if key in named:
            yield key, value, named[key]
        elif "*" in spec:
            yield key, value, spec["*"]


def shift(doc, spec: dict, out: dict | None = None) -> dict:
    out = {} if out is None else out
    if isinstance(doc, list):
        doc = {str(i): x for i, x in enumerate(doc)}
    if isinstance(doc, dict):
        for key, value, target in _matches(spec, doc):
            if isinstance(target, dict):
                shift(value, target, out)
            else:
                for path in target if isinstance(target, list) else [target]:
                    _put(out, path.replace("&", key), value)
    return out


def default(doc: dict, spec: dict) -> dict:
    for key, value in spec.items():
        if doc.get(key) is None:
            doc[key] = copy.deepcopy(value)
        elif isinstance(value, dict) and isinstance(doc[key], dict):
            default(doc[key], value)
    return doc


def remove(doc, spec: dict):
    if isinstance(doc, dict):
        for key, _, target in list(_matches(spec, doc)):
            if isinstance(target, dict) and isinstance(doc[key], dict):
                remove(doc[key], target)
            else:
                del doc[key]
    return doc


OPERATIONS = {"shift": shift, "default": default, "remove": remove}


def parse(spec: str | list) -> Spec:
    steps = json.loads(spec) if isinstance(spec, str) else spec
    for s in steps:
        if s.get("operation") not in OPERATIONS:
            raise ValueError(f"unknown operation {s.get('operation')!r}")
        if not isinstance(s.get("spec"), dict):
            raise ValueError(f"operation {s['operation']} has no spec")
    return steps


def reshape(text: str | None, steps: Spec) -> str | None:
    """The reshaped document as compact JSON; null where the text is no JSON object."""
    try:
        doc = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if not isinstance(doc, dict):
        return None
    for s in steps:
        doc = OPERATIONS[s["operation"]](doc, s["spec"])
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)
