"""Places in manifests that make something run: npm lifecycle scripts and privileged compose services, as byte spans."""

from __future__ import annotations

import json
import re

# Lifecycle keys and the rules they are reported under.
LIFECYCLE = {
    "preinstall": "npm-preinstall-v1",
    "install": "npm-install-v1",
    "postinstall": "npm-postinstall-v1",
    "prepare": "npm-prepare-v1",
    "prepublish": "npm-prepublish-v1",
    "prepublishOnly": "npm-prepublish-only-v1",
    "publish": "npm-publish-v1",
    "postpublish": "npm-postpublish-v1",
}
COMPOSE = ("compose.yaml", "compose.yml", "docker-compose.yaml", "docker-compose.yml")
PIECE = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}]', re.DOTALL)
SPACE = re.compile(rb"[ \t\r\n\x0c]*")


class Unreadable(ValueError):
    """Why a manifest's places cannot be told."""


def key_spans(data: bytes, key: bytes) -> list[tuple[int, int]]:
    """Spans, quotes included, of a key among the direct members of the outermost object."""
    found, depth = [], 0
    for m in PIECE.finditer(data):
        if m[0] == b"{":
            depth += 1
        elif m[0] == b"}":
            depth = max(depth - 1, 0)
        elif depth == 1 and m[0][1:-1] == key and data[SPACE.match(data, m.end()).end() :][:1] == b":":
            found.append(m.span())
    return found


def object_span(data: bytes, key: bytes) -> tuple[int, int] | None:
    """The object that is the value of the only such key, from brace to brace."""
    spans = key_spans(data, key)
    if len(spans) != 1:
        return None
    colon = SPACE.match(data, spans[0][1]).end()
    start = SPACE.match(data, colon + 1).end()
    if data[start : start + 1] != b"{":
        return None
    depth = 0
    for m in PIECE.finditer(data, start):
        depth += {b"{": 1, b"}": -1}.get(m[0], 0)
        if depth == 0:
            return start, m.end()
    return None


def lifecycle_spans(data: bytes) -> list[tuple[int, int, str, str, str]]:
    """(start, end, rule, category, severity) of lifecycle keys in a package manifest."""
    try:
        root = json.loads(data)
    except ValueError:
        raise Unreadable("invalid_json") from None
    if not isinstance(root, dict):
        raise Unreadable("root_not_object")
    if "scripts" not in root:
        return []
    scripts = root["scripts"]
    if not isinstance(scripts, dict):
        raise Unreadable("scripts_not_object")
    place = object_span(data, b"scripts")
    if place is None:
        raise Unreadable("scripts_key_encoding_unsupported")
    found = []
    for key, rule in LIFECYCLE.items():
        if key in scripts:
            if not isinstance(scripts[key], str):
                raise Unreadable("lifecycle_value_not_string")
            spans = key_spans(data[place[0] : place[1]], key.encode())
            if len(spans) != 1:
                raise Unreadable("lifecycle_key_ambiguous")
            found.append((place[0] + spans[0][0], place[0] + spans[0][1], rule, "lifecycle_hook", "informational"))
    return sorted(found)


def privilege_spans(data: bytes) -> list[tuple[int, int, str, str, str]]:
    """(start, end, rule, category, severity) of `privileged: true` in a service of a plainly written compose file."""
    try:
        data.decode()
    except UnicodeDecodeError:
        raise Unreadable("compose_non_utf8") from None
    if b"\t" in data:
        raise Unreadable("compose_tabs_unsupported")
    found, services, service, at = [], False, False, 0
    for raw in re.findall(rb"[^\n]*\n|[^\n]+", data):
        start, at = at, at + len(raw)
        line = re.sub(rb"\r?\n?\Z", b"", raw)
        bare = line.strip()
        if re.search(rb"[|>][-+]?\Z", bare):
            raise Unreadable("compose_block_scalar_unsupported")
        if re.search(rb"[&{\[]", bare) or bare.startswith((b"*", b"<<:")):
            raise Unreadable("compose_complex_yaml_unsupported")
        if not bare or bare.startswith(b"#"):
            continue
        indent = len(line) - len(line.lstrip())
        if indent == 0:
            service = False
            if bare == b"services:":
                if services:
                    raise Unreadable("compose_services_ambiguous")
                services = True
        elif services and indent == 2 and re.fullmatch(rb"[A-Za-z0-9_.-]+:", bare):
            service = True
        elif services and service and indent == 4:
            if bare == b"privileged: true":
                found.append((start + 4, start + 4 + len(b"privileged"), "compose-privileged-true-v1", "privilege", "medium"))
            elif bare.startswith(b"privileged:"):
                raise Unreadable("compose_privileged_syntax_unsupported")
    if not services:
        raise Unreadable("compose_services_not_canonical")
    return found
