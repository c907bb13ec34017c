"""Steps in the shared folder."""

from pathlib import Path

import pytest

from runlens import session


def test_stored_steps_are_cleared(spark):
    kept = session.scratch_path(spark, "never-written")
    step = session.stored(spark.range(5), "numbers")
    (file,) = {Path(f.removeprefix("file:")).parent for f in step.inputFiles()}
    assert step.count() == 5 and file.exists()
    assert session.clear_scratch(spark) >= 1
    assert not file.exists() and not Path(kept.removeprefix("file:")).exists()
    assert session.clear_scratch(spark) == 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|not exist|NOT_FOUND"):
        step.count()
