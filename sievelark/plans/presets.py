"""Named sampling schedules and selection profiles."""

from __future__ import annotations

from dataclasses import dataclass, replace

from sievelark.operators.select import BinStop, Clusters, Farthest, GridStop, Rounds, Rule, Spread


@dataclass
class Schedule:
    name: str
    before: Rule = None
    after: Rule = None
    exhaustive: bool = False
    conformer_search: bool = False
    notes: str = ""


# fixed values: windows, distances, sizes and stopping rules of the named schedules
WINDOW = Spread(window=3.0, distance=0.05)
GRID_ROUNDS = Farthest(24, rounds=Rounds(4, 12, GridStop(min_rounds=3, patience=2)))
SITE_ROUNDS = Farthest(24, rounds=Rounds(4, 12, BinStop(min_rounds=2, patience=2)))
LINKED, FUZZY = Clusters(window=3.0, distance=0.05), Clusters(window=3.0, distance=0.05, method="fuzzy")

PRESETS = {s.name: s for s in (
    Schedule("multistage_default", Farthest(24), WINDOW), Schedule("multistage_iterative_fps_grid", GRID_ROUNDS, WINDOW),
    Schedule("multistage_iterative_fps_site", SITE_ROUNDS, WINDOW), Schedule("no_selection"), Schedule("fps_then_molclus", Farthest(12), WINDOW),
    Schedule("fps_then_hierarchical", Farthest(12), LINKED), Schedule("fps_then_fuzzy", Farthest(12), FUZZY))}

# fixed values: other names of the presets
ALIASES = {
    "default": "multistage_default", "multistage": "multistage_default", "molclus_like_default": "multistage_default",
    "adaptive_default": "multistage_iterative_fps_grid", "iterative_fps_default": "multistage_iterative_fps_grid",
    "iterative_grid": "multistage_iterative_fps_grid", "iterative_site": "multistage_iterative_fps_site",
    "none": "no_selection", "off": "no_selection", "disabled": "no_selection",
    "fps_molclus": "fps_then_molclus", "fps_then_energy_rmsd_window": "fps_then_molclus",
    "fps_hierarchical": "fps_then_hierarchical", "fps_fuzzy": "fps_then_fuzzy",
}


def preset_names() -> list[str]:
    return list(PRESETS)


def make_schedule(name: str = "multistage_default", **overrides) -> Schedule:
    """A fresh copy of a preset with the given fields replaced."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in PRESETS:
        raise ValueError(f"unsupported schedule: {name}; available: {', '.join(PRESETS)}")
    return replace(PRESETS[key], **{k: v for k, v in overrides.items() if v is not None})


def budget_schedule(k: int) -> Schedule:
    """The preset used in budget sweeps: ``k`` rows before relaxation, the window afterwards."""
    return make_schedule("multistage_default", name=f"budget_{k}", before=Farthest(k))


PRE_STRATEGIES: dict[str, Rule] = {"none": None, "fps": Farthest(24), "iterative_fps_grid": GRID_ROUNDS, "iterative_fps_site": SITE_ROUNDS}
POST_STRATEGIES: dict[str, Rule] = {"none": None, "window": WINDOW, "hierarchical": LINKED, "fuzzy": FUZZY, "fps": Farthest(12)}


def strategy_matrix() -> list[Schedule]:
    """Every combination of a selection before and one after relaxation."""
    return [Schedule(f"{a}__{b}", x, y) for a, x in PRE_STRATEGIES.items() for b, y in POST_STRATEGIES.items()]
