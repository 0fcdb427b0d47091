"""Modules and profiles: what a run decodes and keeps."""

from __future__ import annotations

from wirelake.errors import WirelakeError

#: Modules and what each needs.
NEEDS = {
    "packet": (),
    "flow": ("packet",),
    "ip-reassembly": ("packet",),
    "tcp-stream": ("flow", "ip-reassembly"),
    "dns": ("tcp-stream",),
    "tls": ("tcp-stream",),
    "http": ("tcp-stream",),
    "ssh": ("tcp-stream",),
    "files": ("http",),
    "collector": (),
    "intel": (),
    "notices": (),
    "policy": (),
}
MODULE_OF_PREFIX = {"file": "files", "notice": "notices", "dns": "dns", "tls": "tls", "http": "http", "ssh": "ssh", "intel": "intel", "policy": "policy"}
PROFILES = {
    "packets": ("packet",),
    "flows": ("flow",),
    "protocols": ("dns", "tls", "http", "ssh"),
    "security": ("dns", "tls", "http", "ssh", "files", "intel", "notices", "policy"),
    "exports": ("collector",),
    "complete": tuple(NEEDS),
}


def closure(names: set[str]) -> set[str]:
    """The modules and all that they need."""
    unknown = names - NEEDS.keys()
    if unknown:
        raise WirelakeError(f"there is no module {', '.join(sorted(unknown))}")
    out: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in out:
            out.add(name)
            todo += NEEDS[name]
    return out


def resolve(profiles: tuple[str, ...] = ("complete",), enabled: tuple[str, ...] = (), disabled: tuple[str, ...] = ()) -> list[str]:
    """Modules that run, in order of need; to turn off what another needs is an error."""
    wanted: set[str] = set(enabled)
    for p in profiles:
        if p not in PROFILES:
            raise WirelakeError(f"there is no profile {p}")
        wanted |= set(PROFILES[p])
    on = closure(wanted - set(disabled))
    clash = on & set(disabled)
    if clash:
        raise WirelakeError(f"{', '.join(sorted(clash))} cannot be off: another module needs it")
    return [m for m in NEEDS if m in on]
