"""Names that a query reads off an imported module exist there, also those no test reaches."""
import ast
import inspect
import types

from cataloom.workloads import checks, finder, snapshots, texts


def test_names_of_modules_exist():
    missing = []
    for module in (checks, finder, snapshots, texts):
        for node in ast.walk(ast.parse(inspect.getsource(module))):
            owner = getattr(module, node.value.id, None) if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) else None
            if isinstance(owner, types.ModuleType) and not hasattr(owner, node.attr):
                missing.append(f"{module.__name__}:{node.lineno} {node.value.id}.{node.attr}")
    assert not missing
