"""Layered configuration."""

from __future__ import annotations

import copy
import json
import logging
import os
import sys


def merged(base: dict, over: dict) -> dict:
    """A new dict: `over` wins, dicts are merged at any depth."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def with_profile(config: dict, name: str | None = None) -> dict:
    """The configuration under its active profile; without one it stays, an unknown one is a KeyError."""
    name = name or config.get("active_profile")
    if not name:
        return copy.deepcopy(config)
    return merged(config, config.get("profiles", {})[name])


def load(path: str) -> dict:
    """JSON, or YAML where that library is there."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def for_older_readers(config: dict) -> dict:
    """A checkpoint's configuration under the keys that older readers know: what rotates positions apart from its base, the number type by its
    former name, and the general class of a tokenizer that is read from a file. Keys that aren't there are left out; the input stays."""
    out = copy.deepcopy(config)
    if (rope := out.pop("rope_parameters", None)) is not None:
        base = rope.pop("rope_theta", None)
        out |= {"rope_scaling": rope} | ({} if base is None else {"rope_theta": base})
    if (kind := out.pop("dtype", None)) is not None:
        out["torch_dtype"] = kind
    if out.get("tokenizer_class") == "TokenizersBackend":
        out["tokenizer_class"] = "PreTrainedTokenizerFast"
    return out


def logger(name: str = "kilnwork", path: str | None = None) -> logging.Logger:
    """The driver's log, to the console and, if there is a path, to that file too; asking again adds nothing twice."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    log.propagate = False
    wanted: dict[str, logging.Handler] = {"console": logging.StreamHandler(sys.stderr)}
    if path:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        wanted[os.path.realpath(path)] = logging.FileHandler(path, delay=True)
    for label, handler in wanted.items():
        if label not in {h.get_name() for h in log.handlers}:
            handler.set_name(label)
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            log.addHandler(handler)
    return log
