"""YAML, where a reader of it is installed."""

from __future__ import annotations

try:
    import yaml
except ImportError:  # JSON specs still work

    class yaml:  # noqa: N801
        @staticmethod
        def safe_load(_):
            raise RuntimeError("YAML specs need PyYAML; write the spec as JSON")
