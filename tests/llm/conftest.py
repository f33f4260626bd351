import pytest


@pytest.fixture(autouse=True)
def shared_folder(tmp_path, monkeypatch):
    """Every test has its own scratch folder, cleared with it."""
    import importlib

    scratch = importlib.import_module("recengine.llm._scratch")
    monkeypatch.setattr(scratch, "scratch_root", lambda spark: f"file://{tmp_path}")
