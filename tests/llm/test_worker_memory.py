"""What a task has freed does not stay with the worker."""

import os
import sys

import numpy as np
import pytest

from scorelens.llm import common


def held_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_freed_memory_goes_back_to_the_system():
    blocks = [np.ones(60_000, dtype=np.uint8) for _ in range(3000)]
    last = blocks.pop()  # memory below it is not given back by itself
    blocks.clear()
    before = held_mb()
    common.give_back()
    assert held_mb() < before - 50 and last.all()
