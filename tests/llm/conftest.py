import pytest

from symlake.llm import bytespans, common, phrases, repeats


@pytest.fixture(scope="session", autouse=True)
def keep_shuffles():
    """Tests shuffle so little that collecting garbage after each table would take most of their time."""
    patch = pytest.MonkeyPatch()
    for module in (common, repeats, phrases, bytespans):
        patch.setattr(module, "free_shuffles", lambda spark: None)
    yield
    patch.undo()
