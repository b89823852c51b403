import sys

import pytest

import __spark_entry__ as entry


def test_entry_works_without_the_optional_package(monkeypatch):
    for gone in ("glintframe.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, gone, None)
    assert len(entry.queries()) > 100 and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_text_query_is_registered_if_the_package_is_there():
    if entry._optional("glintframe.llm.queries"):
        assert {n.split("_")[0] for n in entry.queries() if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
        assert "pipeline" in entry.queries()


def test_errors_inside_the_optional_package_are_not_hidden(monkeypatch, tmp_path):
    (tmp_path / "broken_extra.py").write_text("import a_module_that_is_not_there\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError, match="a_module_that_is_not_there"):
        entry._optional("broken_extra")
    assert entry._optional("nothing_of_this_name") is None
