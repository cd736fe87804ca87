"""Every registered query by name."""

from importlib import import_module

_GROUPS = ("series", "market", "history", "scores", "text", "io")

CHECKS = {}
for _group in _GROUPS:
    for _check in import_module(f"{__package__}.entries_{_group}").CHECKS:
        if _check.name in CHECKS:
            raise ValueError(f"registered twice: {_check.name}")
        CHECKS[_check.name] = _check
