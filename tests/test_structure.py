"""The raster engine stands without the training-data subpackage."""

import pathlib
import re

ROOT = pathlib.Path(__file__).parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "rasterloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+\S*\bllm\b", path.read_text(), re.M), path


def test_every_query_has_sql():
    from rasterloom.plans import catalog, surface

    assert set(catalog.QUERIES) == set(catalog.ORACLES) and set(surface.QUERIES) == set(surface.ORACLES)
    assert not set(catalog.QUERIES) & set(surface.QUERIES)
