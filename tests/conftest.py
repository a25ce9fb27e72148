"""Shared fixtures: one local SparkSession for the whole run."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from recensio.session import local_session

    s = local_session(cores=8, shuffle_partitions=8, app="recensio-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
