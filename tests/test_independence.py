"""Detection must not know the truth that it is measured by."""

from pathlib import Path

import maskloom.operators as operators

FOLDER = Path(operators.__file__).parent


def test_detection_does_not_refer_to_truths():
    for name in ("rules", "detect", "profiles", "layout", "dictionary", "cells", "structured", "resolve"):
        text = (FOLDER / f"{name}.py").read_text()
        assert "truth" not in text.lower() and "evaluate" not in text and "compare" not in text, name
