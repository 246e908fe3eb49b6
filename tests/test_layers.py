import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def imported(path):
    for n in ast.walk(ast.parse(path.read_text())):
        if isinstance(n, ast.ImportFrom) and n.module:
            yield n.module
        elif isinstance(n, ast.Import):
            yield from (a.name for a in n.names)


def test_the_core_does_not_import_the_text_operators():
    for f in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "tessera").parts:
            assert not [m for m in imported(f) if m.startswith("tessera.llm")], f


def test_functions_do_not_import_operators():
    for f in (ROOT / "tessera" / "functions").glob("*.py"):
        assert not [m for m in imported(f) if m.startswith(("tessera.operators", "tessera.plans"))], f
