"""Loaders of configuration written as YAML: systems, types and allow-lists, strict about keys."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from .allow import AllowList
from .registry import TYPES, Policy, Registry, RegistryError, TypeSpec


class ConfigError(ValueError):
    """A configuration that can't be used; names the place, never a secret."""


def _parsed(text: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("YAML can't be read here: no yaml module") from e
    try:
        out = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {getattr(e, 'problem', e)}") from None
    if not isinstance(out, dict):
        raise ConfigError("the document is no mapping")
    return out


def _only(where: str, given: dict, known) -> None:
    if unknown := sorted(set(given) - set(known)):
        raise ConfigError(f"{where}: unknown key {', '.join(unknown)}")


SYSTEM_KEYS = (
    "id", "enabled", "mask_mode", "unmask_enabled", "types", "overrides", "combination_rule", "min_confidence", "allow_substrings", "trap_policy", "session_mode", "token_numbering", "hash_salt", "api_key_env",
)
SERVER_KEYS = ("listen", "max_body_bytes", "max_inflight", "mapping_ttl_sec", "mapping_max_entries", "request_deadline_ms", "inline_max_bytes", "historical_date_years", "heavy_inflight")
ROOT_KEYS = ("version", "server", "default_system", "systems", "pii_types_file", "allowlist_file", "dictionaries_dir", "llm")


@dataclass(frozen=True)
class Config:
    policies: dict[str, Policy]
    default_system: str
    ttl_seconds: int = 900
    most_entries: int = 200_000
    stateful: frozenset[str] = frozenset()
    files: dict[str, str] = field(default_factory=dict)
    llm: dict = field(default_factory=dict)


def load_config(text: str) -> Config:
    """Systems with their policies; refuses unknown keys, double ids, a missing or disabled default system."""
    root = _parsed(text)
    _only("config", root, ROOT_KEYS)
    if root.get("version") != 1:
        raise ConfigError("config: version is not 1")
    server = root.get("server") or {}
    _only("server", server, SERVER_KEYS)
    if not str(server.get("listen", "")).strip():
        raise ConfigError("server: listen is empty")
    policies, stateful = {}, set()
    for s in root.get("systems") or ():
        name = s.get("id") or "a system"
        _only(name, s, SYSTEM_KEYS)
        if name in policies:
            raise ConfigError(f"{name}: twice")
        types = s.get("types", "all")
        if s.get("session_mode") == "stateful":
            stateful.add(name)
        own = {k: s[k] for k in ("enabled", "mask_mode", "unmask_enabled", "overrides", "combination_rule", "min_confidence", "trap_policy", "token_numbering", "hash_salt") if k in s}
        try:
            policies[name] = Policy(name, None if isinstance(types, str) else tuple(types), allow_substrings=tuple(s.get("allow_substrings") or ()), **own)
        except RegistryError as e:
            raise ConfigError(str(e)) from None
    default = root.get("default_system")
    if default not in policies or not policies[default].enabled:
        raise ConfigError(f"default_system: {default} is not there or switched off")
    files = {k: root[k] for k in ("pii_types_file", "allowlist_file", "dictionaries_dir") if k in root}
    return Config(policies, default, server.get("mapping_ttl_sec", 900), server.get("mapping_max_entries", 200_000), frozenset(stateful), files, root.get("llm") or {})


def load_allow_list(text: str) -> AllowList:
    root = _parsed(text)
    _only("allow-list", root, ("public_persons", "organizations"))
    return AllowList(tuple(root.get("public_persons") or ()), tuple(root.get("organizations") or ()))


#: Keys of a type that this engine doesn't need: its name, a dictionary's.
IGNORED = ("name", "dictionary", "requires_companion")


def load_registry(text: str) -> Registry:
    """Types by data. What a built-in type of the same id has beyond the file (how it is found, its cheap test) stays."""
    root = _parsed(text)
    _only("types", root, ("context", "types", "pseudonym"))
    built_in = {t.id: t for t in TYPES}
    known = {f.name for f in fields(TypeSpec)} - {"hint", "found_by", "group"}
    out = []
    for t in root.get("types") or ():
        name = t.get("id") or "a type"
        _only(f"type {name}", t, known | set(IGNORED))
        old = built_in.get(name)
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in t.items() if k in known}
        if "patterns" in own:
            own["patterns"] = tuple(p.replace(r"(?-u:\b)", r"\b") for p in own["patterns"])
        if old is not None:
            extra = {"hint": old.hint, "found_by": old.found_by, "group": old.group, "companions": own.get("companions", old.companions)}
            same = own.get("patterns", ()) == old.patterns
            out.append(TypeSpec(**{**own, **extra, "hint": old.hint if same else ""}))
        else:
            if "token_label" not in own:
                own["token_label"] = name.upper()
            out.append(TypeSpec(**own))
    return Registry(tuple(out))
