import __spark_entry__ as e


def test_names_and_sql():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(e.__file__).parent / "weirstone"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "weirstone.llm" not in p.read_text().replace("``llm``", "")
