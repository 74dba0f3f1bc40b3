"""Typed settings: given > file > default, each with its source."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from .errors import ConfigError


@dataclass(frozen=True)
class Setting:
    key: str
    kind: type
    default: Any = None


class Settings:
    """Look up ``section.key`` among given values, then a TOML file."""

    def __init__(self, given: dict[str, str] | None = None, file: str | Path | None = None):
        self.given = dict(given or {})
        self.file: dict = {}
        if file is not None and Path(file).exists():
            try:
                self.file = tomllib.loads(Path(file).read_text())
            except tomllib.TOMLDecodeError as e:
                raise ConfigError(f"{file}: {e}") from None

    def get(self, setting: Setting) -> tuple[Any, str]:
        """(value, source), source being given, file or default."""
        if setting.key in self.given:
            return self._typed(setting, self.given[setting.key], text=True), "given"
        node: Any = self.file
        for part in setting.key.split("."):
            node = node.get(part) if isinstance(node, dict) else None
        if node is not None:
            return self._typed(setting, node, text=False), "file"
        return setting.default, "default"

    @staticmethod
    def _typed(setting: Setting, value: Any, text: bool) -> Any:
        try:
            if setting.kind is bool and text:
                return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[str(value).lower()]
            if setting.kind in (int, str, Path) and (text or setting.kind is Path):
                return setting.kind(value)
        except (KeyError, ValueError):
            raise ConfigError(f"{setting.key}: {value!r} is no {setting.kind.__name__}") from None
        if type(value) is not setting.kind:
            raise ConfigError(f"{setting.key}: {value!r} is no {setting.kind.__name__}")
        return value


def security_tier(settings: Settings) -> str:
    """off, mode or strict; strict wins."""
    strict = settings.get(Setting("security.strict", bool, False))[0]
    return "strict" if strict else "mode" if settings.get(Setting("security.mode", bool, False))[0] else "off"
