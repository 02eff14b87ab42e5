"""Lines without a quantity or a number, which the SQL takes as spans without an end (or a start)."""

import random

import pytest
from test_odd_lines import NO_QUANTITY, differing

NO_NUMBER = [(1, None, 5.0, 0.06, 0.04, "A", "O"), (1, None, 6.0, 0.06, 0.04, "R", "O"), (2, 1, 5.0, 0.06, 0.04, "A", "O"), (2, None, 6.0, 0.06, 0.04, "A", "O"), (3, None, 5.0, 0.06, 0.04, "A", "F"), (3, 2, 5.0, 0.06, 0.04, "N", "O")]
BESIDE = [(4, 1, 30.0, 0.06, 0.04, "A", "O"), (4, 2, None, 0.06, 0.04, "R", "O"), (4, 4, None, 0.06, 0.04, "R", "O"), (4, 5, 7.0, 0.06, 0.04, "N", "O"), (5, 2, None, 0.06, 0.04, "A", "F"), (5, 1, 40.0, 0.06, 0.04, "N", "O")]
_R = random.Random(5)
MIXED = [(_R.choice([*range(40), None]), _R.choice([1, 2, 3, 4, 5, None]), _R.choice([None, None, -12.0, 0.0, 4.0, 10.0, 17.0, 33.0]), 0.06, 0.04, _R.choice("ARN"), _R.choice("OF")) for _ in range(240)]
LINES = {"no quantity": NO_QUANTITY, "no number": NO_NUMBER, "beside": BESIDE, "mixed": MIXED}


@pytest.mark.parametrize("kind", LINES)
@pytest.mark.parametrize("name", ["a10_span_coverage", "i9_shared_length", "t7_dice_iou"])
def test_as_in_sql(spark, tmp_path, name, kind):
    got, want = differing(spark, tmp_path, name, LINES[kind])
    assert got == want
