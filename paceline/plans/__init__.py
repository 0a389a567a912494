"""Query plans over the driver's tables."""

import importlib

AREAS = ["timing", "library", "study", "runs", "series", "trajectory", "pose", "fusion", "colour", "live", "lights", "tracking", "patches"]


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
