"""Settings from an INI file, typed and with defaults."""

from __future__ import annotations

import configparser
from dataclasses import dataclass

from .planner import Options


@dataclass(frozen=True)
class Settings:
    dataset: str = "lake"
    k: int = 10
    vote_factor: float = 2.0
    k_coarse: int | None = None
    rollup: str = "decay_vote"
    munkres_threshold: float = 0.5
    code_bits: int = 18
    row_cap: int = 1000
    options: Options = Options()


def load(text: str) -> Settings:
    """Sections ``[dataset] [search] [semantic] [codes] [planner]``; what is missing keeps its default."""
    p = configparser.ConfigParser()
    p.read_string(text)
    d, o = Settings(), Options()
    opt = lambda s, k, f, x: f(p[s][k]) if p.has_option(s, k) and p[s][k] != "" else x
    flag = lambda v: v.strip().lower() in ("1", "true", "yes", "on")
    options = Options(
        opt("planner", "pushdown", flag, o.pushdown), opt("planner", "guard_width", int, o.guard_width), opt("planner", "exact_first", flag, o.exact_first),
        opt("planner", "exact_columns", int, o.exact_columns), opt("planner", "filtered_depth", int, o.filtered_depth),
    )
    return Settings(
        opt("dataset", "name", str, d.dataset), opt("search", "k", int, d.k), opt("semantic", "vote_factor", float, d.vote_factor), opt("semantic", "k_coarse", int, d.k_coarse),
        opt("semantic", "rollup", str, d.rollup), opt("semantic", "munkres_threshold", float, d.munkres_threshold), opt("codes", "bits", int, d.code_bits), opt("codes", "row_cap", int, d.row_cap), options,
    )
