"""Parameters: defaults and the two presets, and files of KEY=VALUE with includes and variables."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class Parameters:
    """Limits and bands of an analysis; distances in bases."""

    min_contacts: float = 1e4
    max_contacts: float = 1e6
    max_undigested: float = 0.5
    max_trans: float = 0.2
    karyotype_log2: float = 1.0
    discard_below: float = 2**14.5
    near_band: tuple[float, float] = (2**14.5, 2**22)
    mitotic_band: tuple[float, float] = (2**21, 2**23.5)
    far_band: tuple[float, float] = (2**22.125, 2**27.75)
    domain_band: tuple[float, float] = (2**16.25, 2**21)
    insulation_scale: int = 300_000
    domain_quantile: float = 0.1
    domain_lengths: tuple[int, int] = (20_000, 4_000_000)
    border_reach: int = 10_000
    site: str = "GATC"
    min_segment: int = 16
    min_mapq: int = 36


DEFAULT = Parameters()
DIPLOID = replace(DEFAULT, min_contacts=2e4, max_contacts=7e5, max_undigested=0.55, max_trans=0.15, near_band=(2**14.5, 2**21))
HAPLOID = replace(DEFAULT, near_band=(2**14.5, 2**21))


def read_config(path: str, known: dict[str, str] | None = None, environment: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines; ``#include file`` reads another file in place, ${KEY} and $ENV{"NAME"} are replaced, other # lines are comments."""
    out = dict(known or {})
    env = os.environ if environment is None else environment
    for number, line in enumerate(Path(path).read_text().splitlines(), 1):
        line = line.strip()
        if line.startswith("#include"):
            other = line.split(None, 1)[1].strip().strip('"')
            out = read_config(str(Path(path).parent / other), out, env)
        elif line and not line.startswith("#"):
            key, mark, value = line.partition("=")
            if not mark:
                raise ValueError(f"{path}, line {number}: no value")
            value = re.sub(r'\$ENV\{"?(\w+)"?\}', lambda m: env[m[1]], value.strip())
            out[key.strip()] = re.sub(r"\$\{(\S+?)\}", lambda m: out[m[1]], value)
    return out


def arguments(words: list[str]) -> dict[str, str]:
    """``-key value`` pairs; ``@file`` reads a file of KEY=VALUE."""
    out: dict[str, str] = {}
    i = 0
    while i < len(words):
        if words[i].startswith("@"):
            out = read_config(words[i][1:], out)
            i += 1
        elif words[i].startswith("-") and i + 1 < len(words):
            out[words[i][1:]] = words[i + 1]
            i += 2
        else:
            raise ValueError(f"{words[i]!r} has no value")
    return out


def option(config: dict[str, str], key: str, default: str | None = None) -> str:
    if key not in config and default is None:
        raise KeyError(f"{key} is not set")
    return config.get(key, default or "")


def option_list(config: dict[str, str], key: str) -> list[str]:
    return [x.strip() for x in option(config, key).split(",") if x.strip()]
