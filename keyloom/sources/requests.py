"""One request's parameters to an identifier or a name query (driver side)."""

from __future__ import annotations

from keyloom.functions.kinds import KINDS

FACETS = ("qualifier", "street", "city", "region", "country")
# Other spellings of kinds.
SPELLINGS = {"place_id": "google_place_id"}


class BadRequest(ValueError):
    """A request that names no identifier, or too much."""


def identifier(params: dict[str, str]) -> tuple[str, str]:
    """(kind, raw value): ``id=kind:value`` first, then ``<kind>=value`` in the order of the registry, then other spellings."""
    if "id" in params:
        kind, colon, value = params["id"].partition(":")
        if not colon or kind not in KINDS:
            raise BadRequest(f"id must be KIND:VALUE with a kind of {', '.join(KINDS)}")
        return kind, value
    for name in [*KINDS, *SPELLINGS]:
        if name in params:
            return SPELLINGS.get(name, name), params[name]
    raise BadRequest(f"supply id=KIND:VALUE or one of {', '.join(KINDS)}")


def selected(params: dict[str, str]) -> str:
    """The one source that a request names: a kind, ``id``, ``input`` or ``name``; facets go with a name only."""
    named = [p for p in params if p in KINDS or p in SPELLINGS or p in ("id", "input", "name")]
    if len(named) != 1:
        raise BadRequest("name exactly one source")
    if named[0] != "name" and any(p in FACETS for p in params):
        raise BadRequest("qualifiers and addresses go with a name")
    if named[0] == "name" and not params["name"].strip():
        raise BadRequest("the name is blank")
    return SPELLINGS.get(named[0], named[0])
